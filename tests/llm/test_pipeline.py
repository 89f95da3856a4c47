import pyspark.sql.functions as F

import corpus_pipeline
from test_minhash import brute
from throughdoor.llm import decontaminate, mixing


def test_stages_keep_the_columns_and_hand_on_what_they_keep(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, out = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = out[name] = spark.read.parquet(str(tmp_path / name))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == names
            assert docs.dtypes == before.dtypes
            assert docs.exceptAll(before.unionAll(before)).count() == 0
    ids = {k: {r["doc_id"] for r in v.select("doc_id").collect()} for k, v in out.items()}
    rows = [tuple(r) for r in out["language"].select("doc_id", "text").collect()]
    assert ids["near_duplicates"] == {c for _, c in brute(rows).values()}
    leaks = decontaminate.contaminated(out["near_duplicates"], spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert ids["decontamination"] == ids["near_duplicates"] - {r["doc_id"] for r in leaks.collect()}
    taken = {r["doc_id"]: r["copies"] for r in mixing.mixed(out["decontamination"]).collect()}
    have = {r["doc_id"]: r["count"] for r in out["mixture"].groupBy("doc_id").count().collect()}
    assert have == {k: v for k, v in taken.items() if v}
    assert out["token_ids"].count() == out["mixture"].count()
    assert out["token_ids"].orderBy(F.desc("start")).first()["doc_id"] == max(ids["mixture"])
    same = corpus_pipeline.run(spark, folder)
    assert same.exceptAll(out["token_ids"]).count() == 0 and same.count() == out["token_ids"].count()


def test_rows_that_share_a_doc_id_leave_one(spark):
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "a b c d e f", "en", "t", 11),
            (3, None, "en", None, None), (None, "q w e r t y", "en", "s", 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, df, "")
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == [1, 3, None]
    assert got.columns == df.columns
