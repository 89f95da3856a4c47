import zlib

import numpy as np
import pyarrow as pa
import pytest

from throughdoor.llm import langid, toxicity
from throughdoor.llm.queries import QUERIES


def held(doc_id, parts, part):
    return zlib.crc32(str(doc_id).encode()) % parts == part


def test_language_query_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op2_language"](spark, folder).collect()
    assert len(rows) == len(docs)
    assert all(r["held_out"] == held(r["doc_id"], 4, 2) and 0 <= r["score"] <= 1 for r in rows)
    own = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in rows if r["held_out"]]
    assert sum(own) / len(own) > 0.99


def test_language_does_not_see_keys_or_held_out_rows(spark):
    rows = [(i, t, l) for i in range(200) for t, l in [("abc abd abe", "xx") if i % 2 else ("uvw uvx uvz", "yy")]]
    wrong = [(i, t, ("yy" if l == "xx" else "xx") if held(i, 4, 2) else l) for i, t, l in rows]
    schema = "doc_id long, text string, lang string"
    a = langid.identified(spark.createDataFrame(rows, schema)).collect()
    b = langid.identified(spark.createDataFrame(wrong, schema)).collect()
    assert sorted(a) == sorted(b)


def test_language_defined_cases(spark):
    rows = [(1, "abc def", "en", 1), (2, "ßü öä", "de", 1), (3, None, "en", 1), (4, "123 !!", None, 1), (5, "", "de", 1),
            (6, "日本", None, 1), (None, "ABC", None, 1), (7, "x" * 300_000, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r["doc_id"]: r for r in langid.identified(df).collect()}
    assert [got[i]["lang_pred"] for i in (3, 4, 5)] == ["und"] * 3 and got[None]["lang_pred"] == "en"
    assert got[6]["lang_pred"] in ("de", "en") and got[None]["held_out"] is False
    kept = langid.accepted(df)
    assert kept.columns == df.columns and not {3, 4, 5} & {r["doc_id"] for r in kept.collect()}
    none = langid.identified(df.limit(0))
    assert none.count() == 0
    blind = langid.identified(df.withColumn("lang", df["lang"].substr(100, 1)).replace("", None, "lang")).collect()
    assert {r["lang_pred"] for r in blind} == {"und"}


def test_texts_are_read_apart():
    use = langid.Settings()
    one, bounds, _ = langid.grams(["ab", "", "a b é"], use)
    alone, _, _ = langid.grams(["a b é"], use)
    assert sorted(one[bounds[2]:bounds[3]]) == sorted(alone) and bounds[1] == bounds[2]


def test_toxicity_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op1_toxicity"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == held(r["doc_id"], 5, 0) and 0 <= r["score"] <= 1
               and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    known = [(r["score"], labels[r["doc_id"]]) for r in rows if r["doc_id"] in labels and r["held_out"]]
    bad, good = [s for s, y in known if y], [s for s, y in known if not y]
    assert sum(b > g for b in bad for g in good) / (len(bad) * len(good)) > 0.6


def texts(n):
    return [(i, ["the muslim baker is idiot scum", "the christian baker is a kind person", "a kind baker sells bread",
                 "muslim readers like bread", None, ""][i % 6], 1 if i % 6 == 0 else 0) for i in range(n)]


def test_swapping_a_group_does_not_move_the_score(spark):
    df = spark.createDataFrame(texts(300), "key long, text string, label int")
    asked = pa.array(["muslim bakers came", "christian bakers came"])
    free = toxicity.train(df, toxicity.Settings(swap_penalty=0.0)).score(asked)
    held_ = toxicity.train(df).score(asked)
    assert abs(held_[0] - held_[1]) < 0.2 * abs(free[0] - free[1])


def test_toxicity_defined_cases(spark):
    rows = texts(120)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "scum"), (0, "scum"), (500, "x" * 300_000)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == 123 and all(r["score"] is not None for r in got)
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    blind = toxicity.scored(docs, labels.limit(0)).collect()
    assert {r["score"] for r in blind} == {0.5}
    assert toxicity.scored(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("rows", [10, 3000])
def test_the_fit_sees_a_bounded_sample(spark, rows):
    df = spark.createDataFrame(texts(rows), "key long, text string, label int")
    seen = []
    fit = toxicity.fit
    try:
        toxicity.fit = lambda labels, *a: (seen.append(len(labels)), fit(labels, *a))[1]
        toxicity.train(df, toxicity.Settings(fit_rows=1000, steps=2))
    finally:
        toxicity.fit = fit
    assert seen[0] == rows if rows < 1000 else 850 < seen[0] <= 1000


def plain_fit(labels, texts, left, right, use):
    """The same minimisation on dense rows, one loop and no scaling tricks."""
    def dense(packed):
        out = np.zeros((len(packed), use.buckets))
        for row, b in zip(out, packed):
            found = np.frombuffer(b, np.int32)
            np.add.at(row, found, 1 / np.sqrt(max(len(found), 1)))
        return out

    often = sum((row > 0).astype(int) for row in dense(texts)) >= use.least_rows
    x, one, two = (dense(p) * often for p in (texts, left, right))
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    counts = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    counts = counts / counts.sum()
    level = counts @ labels
    w, bias, m, v = np.zeros(use.buckets), np.log(level / (1 - level)), 0.0, 0.0
    for step in range(1, use.steps + 1):
        off = (1 / (1 + np.exp(-(x @ w + bias))) - labels) * counts
        change = (one - two) @ w
        grad = x.T @ off + use.ridge * w + 2 * use.swap_penalty / len(one) * ((one - two).T @ change)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        w = w - use.rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-5)
        bias -= 0.1 * off.sum()
    return w * often, bias


def test_the_fit_against_dense_rows():
    use = toxicity.Settings(buckets=512, steps=40)
    rows = texts(60)
    named = ["the muslim baker is here", "a christian came"]

    def packed(column):
        return [flat[a:b].tobytes() for _, flat, bounds in toxicity.features(pa.array(column, pa.string()), use)
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    data = [packed([t or "" for _, t, _ in rows]), packed(named), packed([toxicity.swapped(t) for t in named])]
    labels = np.array([float(y) for *_, y in rows])
    model = toxicity.fit(labels, *data, use)
    w, bias = plain_fit(labels, *data, use)
    assert np.allclose(model.weights, w, atol=1e-6) and abs(model.bias - bias) < 1e-8


def test_a_rare_label_is_caught(spark):
    rows = [(i, "you are scum and an idiot" if i % 20 == 0 else f"a kind baker sells bread number {i % 7}", int(i % 20 == 0))
            for i in range(600)]
    model = toxicity.train(spark.createDataFrame(rows, "key long, text string, label int"))
    got = model.score(pa.array(["that scum again", "what an idiot", "bread for the baker", "muslim bakers sell bread"]))
    assert (got[:2] >= 0.5).all() and (got[2:] < 0.5).all()


def test_toxicity_repeated_rows_and_clashing_columns(spark):
    rows = texts(60)
    docs = spark.createDataFrame([(i, t, 9.0, 1, "x") for i, t, _ in rows] * 2,
                                 "doc_id long, text string, score double, predicted int, label string")
    labels = spark.createDataFrame([(i, y, "z") for i, _, y in rows] * 2, "doc_id long, toxic int, text string")
    got = toxicity.scored(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert len(got.collect()) == 120 and len(got.distinct().collect()) == 60
