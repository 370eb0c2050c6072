import zlib

import numpy as np
import pytest

from tidemark.llm import token_files as T
from tidemark.llm.shared import shared_dir
from tidemark.llm.token_ids import _encoder, default_tokenizer

from .test_packing import library_ids


@pytest.fixture
def path(spark, tmp_path):
    return f"{tmp_path}/container"


def test_round_trip(spark, documents, texts, path):
    T.write_container(documents, path)
    rows = {r.doc_id: r for r in T.read_container(spark, path).collect()}
    start = 0
    for doc in sorted(texts):
        ids = [*library_ids(texts[doc]), T.END_ID]
        r = rows[doc]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and bytes(r.ids) == np.array(ids, "<u4").tobytes()
        start += len(ids)
    one = sorted(texts)[17]
    assert T.read_document(spark, path, one) == [[*library_ids(texts[one]), T.END_ID]] and T.read_document(spark, path, -5) == []


def test_wrong_dictionary_is_refused(spark, documents, path):
    T.write_container(documents.limit(5), path)
    bad = spark.createDataFrame([("0" * 64, b"something else")], "dict_hash string, dictionary binary")
    bad.write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(ValueError):
        T.read_container(spark, path)


def test_odd_rows(spark, odd, empty, path):
    T.write_container(odd, path)
    rows = T.read_container(spark, path, with_ids=False).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 3, 4, 5, 2**60 + 1] and [r.n_tokens for r in rows if r.doc_id in (2, 3)] == [1, 1]
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()
    T.write_container(empty, path + "-empty")
    assert T.read_container(spark, path + "-empty").count() == 0
    assert shared_dir(spark)


@pytest.mark.parametrize("text", ["", " ", "  ", "a  b", " a", "a ", "\n\n a  b", "a \n b", "x\x1c y\x85 z\xa0 w", "<|endoftext|> and <|endoftext|>", "don't we'll I'M", "12 345,6  7", "日本語 テキスト", "é combining", "🙂 🙃  x", "\t tab", "a" * 300 + " b"])
def test_units_encode_as_the_library(text):
    assert np.frombuffer(_encoder(default_tokenizer()).encode(text), "<u4").tolist() == library_ids(text)


def test_large_ids_beside_nulls(spark, large_ids, path, monkeypatch):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        T.write_container(large_ids, path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows = T.read_container(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 2**60 + 1, 2**60 + 2]
    by_id = {r.doc_id: r.text for r in large_ids.collect()}
    for doc in (2**60 + 1, 2**60 + 2):
        assert T.read_document(spark, path, doc) == [[*library_ids(by_id[doc]), T.END_ID]]


def test_large_vocabularies_take_four_bytes(spark, documents, path, monkeypatch):
    monkeypatch.setattr(T, "vocabulary_size", lambda p: 100_000)
    T.write_container(documents.limit(3), path)
    row = T.read_container(spark, path).first()
    assert spark.read.parquet(f"{path}/blocks").first().width == 4 and zlib.crc32(bytes(row.ids)) == row.ids_crc32
