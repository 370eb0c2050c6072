"""Toxicity scores of texts whose offensive words may be disguised.

The writer is seen as a noisy channel: letters turn into look-alikes (1d10t, @$$, Cyrillic or full-width twins), are
starred, repeated (iddiot, idiooot), spaced or dotted out (i d i o t, id iot, idi-ot over two lines), or have invisible
characters between them. A token spans a lattice of possible letters; the Viterbi path through it under a character
trigram model, with a cost per change, is the restored word. Restored words are the features of a logistic regression,
fitted to labelled rows; an inflected word has the feature of the word that it is a form of. Each dot, hyphen, comma or
space inside a token or a run of fragments is a word break or nothing, as the path decides. A token without a sign, gap or
double letter has a lattice of one path, itself, so only the others are decoded; a number stays a number.

The language model counts the trigrams of all documents, every one of them: letters beyond a-z fall into 64 classes, so it
is an array of fixed size, which is broadcast. Features and regression are fitted to a bounded sample: ``SAMPLE`` labelled
documents, those of least id hash among the ones that may be learned from; all words that are common in different toxic
documents and contexts, and toxic enough there, are kept. Every text is scored whole. Of a token with gaps the ``PATHS``
likeliest readings within ``NEAR`` of the best are looked at, with a sign for any letter ``WILD_PATHS``, of others the likeliest: a reading that is less likely than
these is not held against a writer.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import spare_name, staged, struct, table

#: Labelled documents to learn from at most; contexts, and documents, that a feature needs in toxic ones.
SAMPLE, LEAST_CONTEXTS = 20_000, 6
#: Partitions of the sample at least, and bytes of its texts in one.
LEAST_PARTS, PART_BYTES = 24, 4 << 20
#: How many times likelier in toxic documents a feature must be.
LEAST_ODDS = 8.0
#: A longer word has the feature of a word that it begins with, of so many letters at least, if it adds so many at most.
STEM, ENDING = 4, 3
#: Penalty on the weights, against the sum of errors over a word's documents: rare words get little weight.
PENALTY = 0.02
#: Tokens whose features a worker keeps; contexts of features that it gathers before it hands them on.
KEPT, CONTEXTS = 400_000, 100_000

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Letters that a look-alike may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "*": LETTERS, "#": LETTERS, "~": LETTERS}
#: Marks at the end of clauses; marks around words.
ENDS = ".,;:!?"
OUTER = ".,;:?\"'()[]{}<>-%&"
#: The first of them, to tell which fragments may belong together.
LIKELY = str.maketrans({c: x[0] for c, x in LOOKALIKES.items()})
#: Lower-case letters of other scripts that look like Latin ones.
TWINS = dict(zip("аеорсухіјѕԁһкмнтвгпиαειοκνρτυχ", "aeopcyxijsdhkmhtbrnuaeiokvptux", strict=True))
#: Letters that are counted each for itself, and classes of the others.
CLASSES = 64
CHANGE = -1.0  # log cost of a look-alike or a shortened run

TWIN = "".join(TWINS)
EDGES = re.compile(r"^[^\w@$(|+]+|[^\w@$|+]+$")
SIGNS = re.compile(rf"[0-9@$!|+(€#*~._\-·,;:/ {TWIN}]|(.)\1\1")
DOUBLED = re.compile(r"(.)\1")
#: What stands for letters in a token that has none, if there are two of them; digits alone are a number.
MARKS = re.compile(r"[@$!|+(€#*].*[@$!|+(€#*]")
#: Three or more words of one or two characters, of which one must have one, in a text that begins and ends with a space.
SPACED = re.compile(r"\s(\S{1,2}(?:\s+\S{1,2}){2,})(?=\s)")
#: Characters that are not seen; full-width forms.
HIDDEN, WIDE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]"), re.compile("[\uff01-\uff5e]+")
UNPLAIN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff\uff01-\uff5e]")
RUN = re.compile(r"(.)\1+", re.DOTALL)
GAP = re.compile(r"[.\-_·,;:/ \t]")
#: Readings of a token with gaps, and of one with a sign for any letter, and the log cost by which they may be worse than
#: the best.
PATHS, WILD_PATHS, NEAR = 8, 64, 8.0
WILD = re.compile("[*#~]")
#: Gaps, which are a word break or nothing, or a run of one character.
PARTS = re.compile(r"([.\-_·,;:/ \t]+)|(.)\2*", re.DOTALL)


def crc_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; rows of remainder 0 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def visible(text: str | None) -> str:
    """A text in lower case, full-width forms as their plain ones, without characters that are not seen."""
    text = text or ""
    if not text.isascii() and UNPLAIN.search(text):
        text = WIDE.sub(lambda m: unicodedata.normalize("NFKC", m[0]), HIDDEN.sub("", text))
    return text.lower()


def letter_class(c: str) -> int:
    """0 for the space, 1 to 26 for a-z, then 64 classes of other characters (Latin-1's letters have one each)."""
    return 0 if c == " " else ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % CLASSES


SIZE = 27 + CLASSES


@dataclass
class LetterModel:
    """Character trigrams with additive smoothing; words are padded by two spaces before and one after."""

    counts: np.ndarray = field(default_factory=lambda: np.zeros((SIZE, SIZE, SIZE), dtype=np.int64))

    def __post_init__(self):
        self.pairs, self.letters = self.counts.sum(axis=2), max(30, int((self.counts.sum(axis=(0, 1)) > 0).sum()))
        self.logs: dict[str, float] = {}

    def __getstate__(self):
        return {"counts": self.counts}

    def __setstate__(self, state):
        self.counts = state["counts"]
        self.__post_init__()

    def count(self, gram: str) -> int:
        return int(self.counts[tuple(map(letter_class, gram))])

    def log(self, two: str, c: str) -> float:
        found = self.logs.get(two + c)
        if found is None:
            if len(self.logs) >= KEPT:
                self.logs.clear()
            i, j, k = map(letter_class, two + c)
            found = self.logs[two + c] = math.log((self.counts[i, j, k] + 0.1) / (self.pairs[i, j] + 0.1 * self.letters))
        return found


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each gap and each run of equal characters its readings with their log costs.

    A twin of a Latin letter may be that one in a token that has Latin letters too.
    """
    steps, mixed = [], any(x in LETTERS for x in token)
    for part in PARTS.finditer(token):
        if part[1]:
            steps.append([("", 0.0), (" ", 0.0)])
            continue
        c, n = part[2], len(part[0])
        readings = [(c, 0.0)] if c.isalpha() else [(r, CHANGE) for r in LOOKALIKES.get(c, "")]
        if mixed and c in TWINS:
            readings.append((TWINS[c], CHANGE))
        step = []
        for r, cost in readings:
            if n <= 2:
                step.append((r * n, cost))
            if n > 1:
                step += [(r, cost + CHANGE)] if n <= 2 else [(r, cost + CHANGE), (r * 2, cost + CHANGE)]
        if not readings:
            step = [("", 0.0)]
        steps.append(step)
    return steps


def best_paths(token: str, model: LetterModel, k: int) -> list[tuple[float, str]]:
    """The k likeliest readings behind a token with their scores, best first, by states of two letters.

    A path is a chain of its last letters and the path before, so time and memory are linear in the token's length.
    """
    states: dict[str, list[tuple[float, tuple | None]]] = {"  ": [(0.0, None)]}
    for step in [*lattice(token), [(" ", 0.0)]]:
        new: dict[str, list[tuple[float, tuple | None]]] = {}
        for two, paths in states.items():
            for letters, cost in step:
                more, state = cost, two
                for c in letters:
                    if c == " " and state == "  ":
                        continue  # no empty words
                    more += model.log(state, c)
                    state = "  " if c == " " else state[1] + c
                new.setdefault(state, []).extend((score + more, (letters, path) if letters else path) for score, path in paths)
        states = {state: sorted(paths, key=lambda p: -p[0])[:k] if len(paths) > 1 else paths for state, paths in new.items()}
    found = []
    for score, path in states["  "]:
        letters = []
        while path:
            letters.append(path[0])
            path = path[1]
        found.append((score, " ".join("".join(reversed(letters)).split())))
    return found


def viterbi(token: str, model: LetterModel) -> str:
    """The likeliest words behind a token."""
    return best_paths(token, model, 1)[0][1]


def disguised(token: str) -> bool:
    """Whether a token has signs besides double letters."""
    return bool(SIGNS.search(token)) and (any(c.isalpha() for c in token) or bool(MARKS.search(token)))


def restore(token: str, model: LetterModel) -> str:
    """A lower-case token or spaced run without outer punctuation, decoded, maybe to several words."""
    token = EDGES.sub("", token)
    return viterbi(token, model) if disguised(token) or (DOUBLED.search(token) and token.isalpha()) else token


def written(token: str, model: LetterModel) -> str:
    """As restored, but double letters as they are: what to learn from."""
    token = EDGES.sub("", token)
    return viterbi(token, model) if disguised(token) else token


def readings(token: str, model: LetterModel) -> set[str]:
    """The words of the likeliest reading; where gaps may be breaks, of each of ``PATHS`` within ``NEAR`` of it, and of
    the ``WILD_PATHS`` likeliest where a sign may be any letter; of a token with no sign but double letters, itself too.

    Letters alone do not tell "a idiot" from "ai diot", or "off" from "of", so both are looked at.
    """
    token = EDGES.sub("", token)
    if not disguised(token):
        return {token, restore(token, model)} if token else set()
    wild = WILD.search(token)
    if not GAP.search(token) and not wild:
        return set(viterbi(token, model).split())
    found = best_paths(token, model, WILD_PATHS if wild else PATHS)
    return {w for score, words in found if wild or score >= found[0][0] - NEAR for w in words.split()}


def single(word: str) -> str:
    """The word with each run of a character cut to one."""
    return RUN.sub(r"\1", word)


def spaced_runs(text: str) -> list[str]:
    """Runs of three or more words of one or two characters, one blank between each two; lines end like words."""
    runs = [m[1].split() for m in SPACED.finditer(f" {text} ")]
    return [" ".join(r) for r in runs if min(map(len, r)) == 1]


def spaced_words(text: str) -> list[str]:
    """The characters of each such run."""
    return [run.replace(" ", "") for run in spaced_runs(text)]


def stems(word: str) -> list[str]:
    """The word and the shorter ones that it may be a form of, longest first."""
    return [word, *[word[:n] for n in range(len(word) - 1, max(STEM, len(word) - ENDING) - 1, -1)]]


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts of trigrams, by their place in the model's array; a word counts once per document."""
    counts = np.zeros(SIZE**3, dtype=np.int64)
    for batch in batches:
        words: Counter = Counter()
        for t in batch["text"]:
            words.update(set(visible(t).split()))
        plain: Counter = Counter()
        for w, n in words.items():
            if not w.isalpha():
                w = EDGES.sub("", w)
            if w.isalpha():
                plain[w] += n
        # all words padded and in a row; the trigrams that begin in a word's last two places belong to none
        c = np.frombuffer("".join([f"  {w} " for w in plain]).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        c = np.where(c == 32, 0, np.where((c >= 97) & (c <= 122), c - 96, 27 + c % CLASSES))
        length = np.fromiter(map(len, plain), dtype=np.int64, count=len(plain)) + 3
        n = np.repeat(np.fromiter(plain.values(), dtype=np.int64, count=len(plain)), length)
        n[np.cumsum(length) - 1] = n[np.cumsum(length) - 2] = 0
        if len(c):
            places = (c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:]
            counts += np.bincount(places, weights=n[:-2], minlength=SIZE**3).astype(np.int64)
    at = np.flatnonzero(counts)
    yield pd.DataFrame({"place": at, "n": counts[at]})


def _contexts(letters, only: frozenset | None):
    """Rows (word, hash of the words around it, hash of the document), each once per batch; copies of a document have the
    same contexts. ``letters`` is a broadcast letter model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[str]] = {}
        model = letters.value

        def words_of(token: str) -> list[str]:
            if token not in known:
                if len(known) >= KEPT:
                    known.clear()
                known[token] = written(token, model).split()
            return known[token]

        found, columns = set(), ["word", "context", "doc"]
        for text in (t for batch in batches for t in batch["text"]):
            text = visible(text)
            doc = xxhash.xxh64_intdigest(text) >> 1
            words = [w for token in text.split() for w in words_of(token)]
            around = ["", *words, ""]
            for i, w in enumerate(words):
                if only is None or w in only:
                    found.add((w, xxhash.xxh64_intdigest(f"{around[i]} {around[i + 2]}") >> 1, doc))
            found.update((w, doc, doc) for run in spaced_runs(text) for w in words_of(run) if only is None or w in only)
            if len(found) >= CONTEXTS:
                yield pd.DataFrame(list(found), columns=columns)
                found = set()
        if found:
            yield pd.DataFrame(list(found), columns=columns)

    return run


@dataclass
class ToxicityModel:
    letters: LetterModel
    weights: dict[str, float]
    bias: float

    def __post_init__(self):
        self.numbers = {f: i for i, f in enumerate(self.weights)}
        self.values = np.array(list(self.weights.values()), dtype=float)
        self.known: dict[str, tuple[int, ...]] = {}
        self.begun = {f[:n] for f in self.weights for n in range(1, len(f))}
        self.longest = max(map(len, self.weights), default=0)
        self.singles = {single(f) for f in self.weights}
        twins: dict[str, list[str]] = {}
        for t, c in TWINS.items():
            twins.setdefault(c, [c]).append(t)
        #: Two letters that a token with a feature begins with, if the first is not doubled.
        self.heads = {x + y for f in self.weights for x in twins.get(f[0], f[0]) for y in twins.get(f[1], f[1])}

    def __getstate__(self):
        return {"letters": self.letters, "weights": self.weights, "bias": self.bias}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def feature(self, word: str) -> int | None:
        """The number of the longest of the model's words that a word is, or is a form of."""
        return next((self.numbers[x] for x in stems(word) if x in self.numbers), None)

    def worth(self, token: str) -> bool:
        """False if no reading of a token without signs but double letters can have a feature.

        All readings are the same once runs are cut to one letter, so a word of the model cut likewise must begin them.
        """
        if not DOUBLED.search(token):
            return False
        cut = single(token)
        return any(cut[:n] in self.singles for n in range(1, len(cut) + 1)) if len(cut) < 64 else True

    def plain(self, token: str) -> bool:
        """True for tokens of letters that cannot have a feature, by length and beginning."""
        return token.isalpha() and (len(token) < STEM or token[:2] not in self.heads and token[0] != token[1])

    def token(self, token: str) -> tuple[int, ...]:
        """The numbers of the model's features in a token."""
        hit = self.known.get(token)
        if hit is None:  # most tokens are neither disguised nor begin like a feature: these are not worth keeping
            bare = token.strip(OUTER)
            if self.plain(bare):
                return ()
            bare = EDGES.sub("", token)
            words = sorted(readings(bare, self.letters)) if disguised(bare) or self.worth(bare) else (bare,)
            hit = tuple(sorted({f for f in map(self.feature, words) if f is not None}))
            if len(self.known) >= KEPT:
                self.known.clear()
            self.known[token] = hit
        return hit

    def fragments(self, tokens: list[str]) -> list[str]:
        """Neighbouring tokens that make a word of the model together, one blank between each two.

        Whether they are that word is for the letter model to say, against their being words of their own.
        """
        found, begun, most = [], self.begun, self.longest
        for i, t in enumerate(tokens):
            if t in begun or t[-1] not in ENDS and not t.isalpha() and len(t) <= most and t.rstrip("-").translate(LIKELY) in begun:
                parts = [t.rstrip("-")]
                joined = parts[0].translate(LIKELY)
                while joined in begun and i + len(parts) < len(tokens):
                    parts.append(EDGES.sub("", tokens[i + len(parts)]))
                    joined += parts[-1].translate(LIKELY)
                    if self.feature(joined) is not None:
                        found.append(" ".join(parts))
                        break
        return found

    def found(self, text: str | None) -> list[int]:
        text = visible(text)
        hits: set[int] = set()
        known, tokens = self.known.get, text.split()
        heads = self.heads
        for t in set(tokens):
            if t.isalpha() and (len(t) < STEM or t[:2] not in heads and t[0] != t[1]):  # as ``plain``
                continue
            hit = known(t)
            if hit is None:
                hit = self.token(t)
            if hit:
                hits.update(hit)
        for s in spaced_runs(text):
            hits.update(self.token(s))
        for s in self.fragments(tokens):
            word = viterbi(s, self.letters)
            if " " not in word and (f := self.feature(word)) is not None:
                hits.add(f)
        return sorted(hits)

    def score(self, text: str | None) -> float:
        x = self.bias + self.values[self.found(text)].sum()
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, x))))


def logistic(rows: list[list[int]], labels: np.ndarray, n: int, l2: float = PENALTY, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on sets of binary features, by accelerated gradient steps."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.array([f for r in rows for f in r], dtype=np.int64)
    w, b, vw, vb = np.zeros(n), math.log((labels.mean() + 1e-6) / (1 - labels.mean() + 1e-6)), np.zeros(n), 0.0
    seen = np.maximum(np.bincount(feature, minlength=n), 1)
    for _ in range(rounds):
        x = np.clip(b + np.bincount(at, weights=w[feature], minlength=len(rows)), -30, 30)
        error = 1 / (1 + np.exp(-x)) - labels
        vw = 0.9 * vw - 0.3 * (np.bincount(feature, weights=error[at], minlength=n) + l2 * w) / seen
        vb = 0.9 * vb - 0.3 * error.mean()
        w, b = w + vw, b + vb
    return w, float(b)


def letter_model(docs: DataFrame, text_col: str = "text") -> LetterModel:
    """The trigrams of all texts: at most ``SIZE``^3 sums, whatever the corpus."""
    grams = docs.select(F.col(text_col).alias("text")).mapInPandas(_grams, struct("place long, n long")).groupBy("place").agg(F.sum("n").alias("n"))
    counts = np.zeros(SIZE**3, dtype=np.int64)
    found = grams.toPandas()
    counts[found["place"].to_numpy(dtype=np.int64)] = found["n"]
    return LetterModel(counts.reshape(SIZE, SIZE, SIZE))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> ToxicityModel:
    """Learns from ``labels`` (doc_id, toxic 0 or 1) of rows that are not held out. Without both classes, a constant model.

    An id with labels of both kinds teaches nothing. Of an id that ``docs`` has more than once the least text is taken.
    Null ids, and ids without a document, are left out; a null text counts as empty.
    """
    may = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)").where(crc_fold(F.col("id")) != 0)
    agreed = may.groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other")
    chosen = agreed.select("id", "toxic").orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    rows = staged(rows.groupBy("id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic")), "toxicity-sample")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.repartition(max(LEAST_PARTS, size // PART_BYTES), "id")
    counts = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return ToxicityModel(LetterModel(), {}, -5.0 if 1 not in counts else 5.0)

    letters = letter_model(docs, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(letters)

    def contexts(toxic: int, only: frozenset | None, of: int = 1) -> DataFrame:
        part = rows.where((F.col("toxic") == toxic) & (F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(of)) == 0))
        found = part.mapInPandas(_contexts(sent, only), struct("word string, context long, doc long"))
        return found.groupBy("word").agg(F.countDistinct("context").alias("n"), F.countDistinct("doc").alias("docs"))

    common = contexts(1, None).where((F.col("n") >= LEAST_CONTEXTS) & (F.col("docs") >= LEAST_CONTEXTS) & (F.length("word") >= STEM))
    bad = {r.word: r.n for r in common.collect()}  # bounded by the sample
    scale, good = counts[0] / counts[1], {}

    def odds(f: str) -> float:
        return (bad[f] * scale + 0.5) / (good.get(f, 0) + 0.5)

    # what part of the clean rows shows to be common there cannot reach the odds any more: its contexts are not gathered
    for of in (16, 1):
        good = {r.word: r.n for r in contexts(0, frozenset(bad), of).collect()}
        bad = {f: n for f, n in bad.items() if odds(f) >= LEAST_ODDS}
    kept = sorted(bad, key=lambda f: (-bad[f] * math.log(odds(f)), f))

    untrained = docs.sparkSession.sparkContext.broadcast(ToxicityModel(letters, dict.fromkeys(kept, 0.0), 0.0))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(untrained.value.found)

    fitted = [(r[0], r[1]) for r in rows.select(found("text"), "toxic").collect()]  # at most ``sample`` short lists
    w, b = logistic([r[0] for r in fitted], np.array([r[1] for r in fitted], dtype=float), len(kept))
    return ToxicityModel(letters, dict(zip(kept, w.tolist(), strict=True)), b)


def scorer(model: ToxicityModel, spark: SparkSession):
    """The score as a function of a column; the model is broadcast (an array of 6 MB and some words)."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(sent.value.score, na_action=None).astype(float)

    return score


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if score >= 0.5).

    A null or empty text has no features and gets the score of the bias alone. A null id is not held out. Repeated rows
    are scored alike; other columns are ignored.
    """
    scored = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(crc_fold(F.col(id_col)) == 0, F.lit(False)).alias("held_out"), scorer(model, docs.sparkSession)(text_col).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity_filter(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under 0.5, with all their columns as they are."""
    s = spare_name(docs, "toxicity")
    return docs.withColumn(s, scorer(model, docs.sparkSession)(text_col)).where(F.col(s) < 0.5).drop(s)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
