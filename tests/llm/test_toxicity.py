import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity as X
from tidemark.llm.shared import table

DATA = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return X.fit(table(spark, DATA, "documents"), table(spark, DATA, "labels"))


def test_held_out(spark, model):
    docs = table(spark, DATA, "documents")
    got = X.score_documents(docs, model).join(table(spark, DATA, "labels"), "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    right = n.get((1, 1), 0) + n.get((0, 0), 0)
    assert right / sum(n.values()) > 0.97 and n.get((1, 1), 0) > 0.8 * (n.get((1, 1), 0) + n.get((1, 0), 0))


def test_fold_is_crc32(spark):
    got = spark.range(50).select("id", X.crc_fold(F.col("id")).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)


@pytest.mark.parametrize(("written", "meant"), [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("idioooot", "idiot"), ("m0r0n", "moron"), ("st*pid", "stupid"), ("p4th3t1c", "pathetic"), ("plain", "plain"), ("2024", "2024"), ("iddiot", "idiot"), ("1d10t" + 40 * "0", "idioto"), ("@n1m@l", "animal"), ("", ""), ("***", "")])
def test_restores(model, written, meant):
    assert X.restore(written, model.letters) == meant


def test_spaced_out(model):
    assert X.spaced_words("an i d i o t here") == ["anidiot"] and X.spaced_words("here i  d\ti o t there") == ["idiot"]
    assert X.spaced_words("you id io t") == ["idiot"] and X.spaced_words("it is so") == [] and X.spaced_words("i am") == []
    assert model.score("you are an i d i o t") > model.score("you are an animal")


def test_viterbi_is_the_best_path(model):
    from itertools import product

    def brute(token):
        best = None
        for path in product(*X.lattice(token)):
            word, score, two = "".join(p[0] for p in path), sum(p[1] for p in path), "  "
            for c in word + " ":
                score += model.letters.log(two, c)
                two = two[1] + c
            best = max(best, (score, word)) if best else (score, word)
        return best[1]

    for token in ("1d10t", "m0r0n", "tr4$h", "ab1e", "sccc0re"):
        assert X.viterbi(token, model.letters) == brute(token)


def test_odd_rows(odd, empty, model):
    got = X.score_documents(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got) and all(r.held_out is not None for r in got)
    assert X.toxicity_filter(odd, model).columns == odd.columns and X.score_documents(empty, model).count() == 0


def test_without_labels(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert X.fit(odd, labels).score("anything") < 0.5


@pytest.mark.parametrize(("written", "meant"), [("a i d i o t", "idiot"), ("s t u p i d m o r o n", "stupid"), ("s t u p i d m o r o n", "moron"), ("well-1d10t", "idiot"), ("idiot,moron", "idiot"), ("idiot,moron", "moron"), ("idi" + 40 * "o" + "t", "idiot")])
def test_breaks_are_decoded(model, written, meant):
    assert meant in X.readings(written, model.letters)
    assert model.score(f"you are {written}") > model.score("you are here")


def test_long_tokens_are_decoded_in_linear_time(model):
    assert X.restore("1d10t-" * 20_000 + "m0r0n", model.letters).split()[-1] == "moron"


def test_language_model_counts_every_document(spark):
    docs = spark.createDataFrame([(1, "good day"), (2, "awful day"), (3, "zyzzyx zyzzyx"), (4, "zyzzyx"), (5, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    assert X.fit(docs, labels).letters.count("zyz") == 2


@pytest.mark.parametrize("written", ["id io t", "i  d  i  o  t", "iddiot", "iidiiot", "m o r on", "1ddiot"])
def test_fragments_and_double_letters_are_read(model, written):
    plain = model.score("you are here and there")
    assert model.score(f"you are {written} there") > plain + 0.1


def test_tokens_of_marks_alone_are_decoded(model):
    assert X.disguised("@$$") and not X.disguised("455") and X.restore("@$$", model.letters) in ("as", "ass")


def test_score_equals_brute_force(model):
    """All paths of each token, those near the best, the features of their words, the sigmoid of the sum of weights."""
    from itertools import product
    from math import exp

    def paths(token):
        found = {}
        for path in product(*X.lattice(token)):
            word, score, two = "".join(p[0] for p in path), sum(p[1] for p in path), "  "
            for c in word + " ":
                if c == " " and two == "  ":
                    continue
                score += model.letters.log(two, c)
                two = "  " if c == " " else two[1] + c
            word = " ".join(word.split())
            found[word] = max(score, found.get(word, score))
        return sorted(((s, w) for w, s in found.items()), reverse=True)

    def feature(word):
        forms = [f for f in model.weights if word == f or (word.startswith(f) and len(f) >= X.STEM and len(word) - len(f) <= X.ENDING)]
        return max(forms, key=len, default=None)

    def brute(text):
        hits, tokens = set(), text.split()
        for token in {*tokens, *X.spaced_runs(text)}:
            token = X.EDGES.sub("", token)
            if not token:
                continue
            found = paths(token) if any(c.isalpha() or c in "@$" for c in token) else [(0, token)]
            wild = X.WILD.search(token)
            near = [w for s, w in found[: X.WILD_PATHS if wild else X.PATHS] if wild or X.GAP.search(token) and s >= found[0][0] - X.NEAR] or [found[0][1]]
            words = {w for n in near for w in n.split()} | ({token} if token.isalpha() else set())
            hits |= {feature(w) for w in words}
        for i in range(len(tokens)):
            for j in range(i + 2, len(tokens) + 1):
                best = paths(" ".join(tokens[i:j]))[0][1] if feature("".join(tokens[i:j])) and all(t.isalpha() for t in tokens[i:j]) else " "
                hits |= {feature(best)} if " " not in best else set()
        return 1 / (1 + exp(-max(-30, min(30, model.bias + sum(model.weights[f] for f in hits if f)))))

    for text in ("you are an idiot", "you iddiot go", "a 1d10t and a m0r0n", "well i d i o t here", "st*pid, letter book", "nothing of note here", "1990 or 12,5", "", "@$$ off", "an id iot here", "worth less than", "stupidity", "t*ash"):
        assert model.score(text) == pytest.approx(brute(text), abs=1e-9), text


def test_conflicting_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (3, None), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 0), (2, 1), (3, 1), (3, 1), (None, 1), (9, 1)], "doc_id long, toxic int")
    assert 0 <= X.fit(docs, labels).score("a") <= 1


@pytest.mark.parametrize("text", ["It is worth it", "The path through the valley is worth the walk.", "in disguise", "worth less than that", "a b c d e f g", "x = 1\ny = 2\nz = 3", "", "Смотри на солнце", "C:/i/d/x"])
def test_clean_prose_is_left_alone(model, text):
    assert model.score(text) < 0.1


def test_licences_and_reference_prose_are_left_alone(model):
    import re
    from glob import glob
    from pydoc_data.topics import topics

    texts = [open(f, errors="replace").read() for f in glob("/usr/share/common-licenses/*")] + list(topics.values())
    parts = [p for t in texts for p in re.split(r"\n\s*\n", t) if p.strip()]
    assert sum(model.score(p) >= 0.5 for p in parts) <= 0.001 * len(parts) and len(parts) > 2000


@pytest.mark.parametrize("written", ["id iot", "idi-\not", "i\nd\ni\no\nt", "i*iot", "idi\u200bot", "id\u00adiot", "ｉｄｉｏｔ", "idi\u043et", "IDIOT", "idiots", "idi#t", "i~iot", "1d 10t"])
def test_one_disguised_word_is_enough(model, written):
    assert model.score(f"you are {written} there") >= 0.5, written


def test_letters_of_all_scripts_have_a_class():
    assert len({X.letter_class(c) for c in "abcdefghijklmnopqrstuvwxyz àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþßÿ"}) == 26 + 1 + 32
    assert all(0 <= X.letter_class(c) < X.SIZE for c in "ж漢𝒳\u0301")


def test_weights_come_from_documents(spark):
    """A word that is common in one toxic document, or in copies of one, is no feature; one of many documents is."""
    many = [(i, f"text of calls{i} blorgo and{i} more") for i in range(12)]
    one = [(100, " ".join(f"n{k} zzzbad m{k}" for k in range(40)))] + [(101 + i, "the very same yyybad words of a copied text") for i in range(12)]
    clean = [(200 + i, f"plain text number {i} of the clean kind") for i in range(60)]
    docs = spark.createDataFrame(many + one + clean, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id < 200 AS INT) AS toxic")
    words = set(X.fit(docs, labels).weights)
    assert "blorgo" in words and not words & {"zzzbad", "yyybad"}
