import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from throughdoor.llm import tokenstore
from throughdoor.llm.queries import QUERIES, vocabulary

TEXTS = [(None, "null key"), (1, None), (2, ""), (3, " a  b \n\n c\t\td "), (4, "x \n\ny   z"),
         (5, "a\x1cb \x1c c\x0b\x0cd"), (6, "\r\nfoo\r\n bar"), (7, "<|endoftext|> x <|endoftext|>y"), (8, " lead"),
         (9, "trail "), (9, "trail \n"), (9, "\n"), (10, "naïve 日本語 😀😀 a​b c  d"),
         (11, "word " * 20000), (12, "x" * 30000), (13, "it's 12'34 can't\n've")]


def same(rows, texts):
    tokenizer, start = Tokenizer.from_file(vocabulary()), 0
    assert len(rows) == len(texts)
    for row, (key, text) in zip(rows, texts):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (
            key, start, len(ids), zlib.crc32(ids.tobytes())), text
        start += len(ids)


def test_round_trip_of_hard_texts(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    same(tokenstore.stored(df, vocabulary()).orderBy("start").collect(), TEXTS)
    assert tokenstore.stored(df.limit(0), vocabulary()).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_round_trip(spark, sf):
    folder = f"/root/testdata/{sf}"
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    same(QUERIES["op6_token_ids"](spark, folder).orderBy("start").collect(), [tuple(r) for r in texts])


def test_many_small_segments_and_lookup(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenstore, "SEGMENT_DOCS", 3)
    path = str(tmp_path / "ids")
    tokenstore.write(spark.createDataFrame(TEXTS, "doc_id long, text string"), path, vocabulary())
    rows = tokenstore.lookup(spark, path, [9, 3, 77]).collect()
    assert sorted(r["key"] for r in rows) == [3, 9, 9, 9]
    same(tokenstore.documents(spark, path).orderBy("start").collect(), TEXTS)


def test_index_is_minimal_and_refuses_strangers():
    keys = np.arange(0, 300_000, 3, dtype=np.uint64) * np.uint64(7919)
    index = tokenstore.Index.from_bytes(tokenstore.build_index(keys, np.arange(len(keys), dtype=np.uint32)))
    assert (index.find(keys) == np.arange(len(keys))).all()
    assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))
    assert (index.find(keys + np.uint64(1)) >= 0).sum() <= 1
    assert len(tokenstore.build_index(keys[:0], np.zeros(0, np.uint32))) == 16
