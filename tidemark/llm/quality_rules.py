"""Quality rules: a base of word and repetition counts, then zstandard compression bands.

How far a text shrinks says how predictable it is. Repetitive text (templates, loops, symbol noise) shrinks too far;
encoded or random text hardly at all. The ratio of sound text goes on falling with length, so the least ratio does too
and the greatest (``limits``), for the whole document and for its fixed chunks, which find a bad stretch inside a long
document that looks sound as a whole. Tables and symbol noise shrink like prose; a chunk with too many symbols is bad
whatever its ratio. Everything is decided per row in one narrow pass; nothing is shuffled.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import spare_name, struct, table

LEVEL = 3
#: The last chunk of a longer text has this length too and overlaps the one before; a shorter text is one chunk.
CHUNK_BYTES = 1024
#: The least ratio at 1,024 bytes, its power of the length, and the part of it that letters of several bytes take away.
#: Clean licence texts and reference prose have 0.42 there, 0.36 at 4 KB, 0.36 at 35 KB and 0.24 at 500 KB.
FLOOR, FALL, SEVERAL = 0.36, 0.2, 0.35
#: The greatest ratio of endless text, what is added to it at 1,024 bytes, the power by which that falls, and the part
#: by which letters of several bytes raise the whole. At 300, 512 and 1,024 bytes clean English has up to 0.84, 0.73 and
#: 0.64, Chinese 1.03, 0.97 and 0.86; random base64 has 0.93 at 300, 0.87 at 400 and 0.81 at 800.
TOP, MORE, SINK, RAISE = 0.60, 0.10, 0.88, 0.25
#: The greatest share of symbols among the bytes of a chunk that are no spaces: labelled junk has 0.067 at least, nine in
#: ten chunks of Markdown with tables 0.062 at most, prose hardly any.
MOST_SYMBOLS = 0.06
ASCII = bytes(range(128))
#: More than this share of chunks outside the band rejects the document.
BAD_CHUNKS = 0.3

SYMBOLS = "#*$%&|<>"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_BYTES, SYMBOL_BYTES = SPACES.encode(), SYMBOLS.encode()
RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_bytes long, ratio double, n_chunks long, n_bad_chunks long, kept boolean"


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    text = text or ""
    words = text.encode("utf-8").split()  # of bytes: exactly the six ASCII spaces
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    dup, seen = 0, set()
    for line in text.split("\n"):
        if line.strip(SPACES):
            dup += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, end = Counter(windows), 0  # end: words before it are counted already
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return len(words), chars, symbols, dup, repeated


def limits(data: bytes) -> tuple[float, float]:
    """The ratios below which text of this length and script is repetitive and above which it is no text."""
    several = len(data.translate(None, ASCII)) / len(data)
    least = FLOOR * (1024 / len(data)) ** FALL * (1 - SEVERAL * several)
    return least, (TOP + MORE * (1024 / len(data)) ** SINK) * (1 + RAISE * several)


def within(data: bytes, packer: zstandard.ZstdCompressor) -> bool:
    least, top = limits(data)
    return least <= len(packer.compress(data)) / len(data) <= top


def few_symbols(data: bytes) -> bool:
    seen = len(data.translate(None, SPACE_BYTES))
    return seen - len(data.translate(None, SPACE_BYTES + SYMBOL_BYTES)) <= MOST_SYMBOLS * seen


def compression(text: str | None, packer: zstandard.ZstdCompressor) -> tuple[int, float | None, int, int, bool]:
    """Bytes, ratio of the whole text, chunks, bad chunks, and whether all is within the limits."""
    data = (text or "").encode("utf-8")
    if not data:
        return 0, None, 0, 0, True
    ratio = len(packer.compress(data)) / len(data)
    least, top = limits(data)
    starts = [*range(0, len(data) - CHUNK_BYTES, CHUNK_BYTES), max(0, len(data) - CHUNK_BYTES)]
    chunks = [data[i : i + CHUNK_BYTES] for i in starts]
    bad = sum(not (few_symbols(c) and within(c, packer)) for c in chunks)
    return len(data), ratio, len(chunks), bad, least <= ratio <= top and bad <= BAD_CHUNKS * len(chunks)


@F.pandas_udf(struct(RESULT))
def judge_texts(texts: pd.Series) -> pd.DataFrame:
    packer = zstandard.ZstdCompressor(level=LEVEL)
    rows = []
    for text in texts:
        base = base_counts(text)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        more = compression(text, packer)
        rows.append((*base, failed, *more[:4], not failed and more[4]))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the counts of ``RESULT`` and the verdict ``kept``.

    Every text with a word is judged whole and by its chunks: a text up to ``CHUNK_BYTES`` is one chunk, the last chunk of
    a longer one overlaps the one before. The limits widen as texts get shorter, since few bytes say little: under some 400
    bytes even random letters are within them. A null or empty text has no words and fails the base; a null id stays null; repeated rows are judged alike, each
    on its own; other columns are ignored. An empty table gives an empty result.
    """
    return docs.select(F.col(id_col).alias("doc_id"), judge_texts(text_col).alias("q")).select("doc_id", "q.*")


def quality_filter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns as they are."""
    q = spare_name(docs, "quality")
    return docs.withColumn(q, judge_texts(text_col)).where(F.col(q)["kept"]).drop(q)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))
