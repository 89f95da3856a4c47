import re

import pytest

from throughdoor.llm import mixing
from throughdoor.llm.queries import QUERIES


def targets(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    """Share by weight, stop at the limit, share the excess again until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    got, free, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while free and left > 1e-9:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if unit * weight[s] >= most * sizes[s]}
        if not full:
            for s in free:
                got[s] = unit * weight[s]
            break
        for s in full:
            got[s] = most * sizes[s]
            left -= got[s]
        free -= full
    return got


def check(rows, texts, near):
    sizes = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] % max(r["size"], 1) == 0
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = targets(sizes)
    for s in sizes:
        own = [r for r in rows if r["source"] == s]
        assert {r["source_size"] for r in own} == {sizes[s]}
        assert all(abs(r["target"] - want[s]) < 1e-6 * max(1, want[s]) for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= near(s)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    folder = f"/root/testdata/{sf}"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op4_mixing"](spark, folder).collect()
    assert len(rows) == len(texts)
    assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or "")) for r in rows)
    # ten documents a source on the smallest tables: whole copies come as near as they can
    near = max(r["size"] for r in rows) / 4 if sf == "sf0.001" else 200
    check(rows, texts, lambda s: near)
    again = QUERIES["op4_mixing"](spark, folder).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_defined_cases(spark):
    rows = [(i, None if i % 7 == 0 else f"s{i % 3}", ["", "a b c", None, "x " * 50][i % 4], i) for i in range(60)]
    rows += [(None, "s1", "q q q", 0), (5, "s1", "z z", 0), (5, "s1", "z z", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size int")
    got = mixing.mixed(df).collect()
    assert len(got) == len(rows)
    check(got, rows, lambda s: 60)
    mix = mixing.repeated(df)
    assert mix.columns == df.columns and mix.count() == sum(r["copies"] for r in got)
    assert mixing.mixed(df.limit(0)).count() == 0 and mixing.repeated(df.limit(0)).count() == 0


def test_draws_do_not_depend_on_partitions_and_long_texts_are_likelier(spark):
    rows = [(i, "one", "w " * (2 if i % 2 else 64)) for i in range(2000)] + [(9999, "two", "w " * 90_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    a = mixing.mixed(df.repartition(3), mixing.Settings(weights=(1, 9), share=0.7)).collect()
    b = mixing.mixed(df.repartition(11), mixing.Settings(weights=(1, 9), share=0.7)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    copies = {k: [r["copies"] for r in a if r["source"] == "one" and (r["size"] > 2) == k] for k in (True, False)}
    assert sum(copies[True]) / len(copies[True]) > 2 * sum(copies[False]) / len(copies[False])


@pytest.mark.parametrize("long, words", [(1, 40_000), (4, 20_000)])
def test_very_long_texts_do_not_end_the_draw(spark, long, words):
    """The rest of the order is used, wherever a text stands that does not fit."""
    for salt in ("a", "b", "c"):
        rows = [(i, "one", "w " * (50 + i * 37 % 301)) for i in range(800)]
        rows += [(10_000 + i, "one", "w " * words) for i in range(long)] + [(9999, "two", "w " * 200_000)]
        df = spark.createDataFrame(rows, "doc_id long, source string, text string")
        got = [r for r in mixing.mixed(df, mixing.Settings(weights=(1, 9), share=0.4, salt=salt)).collect() if r["source"] == "one"]
        taken, target = sum(r["taken"] for r in got), got[0]["target"]
        assert target - 50 < taken <= target + 0.5
