import numpy as np
import pytest
from pyspark.sql import functions as F

from throughdoor.llm import negatives
from throughdoor.llm.queries import QUERIES



def moved():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))


def brute(rows, use=negatives.Settings()):
    """rows: (id, vector, label), the label as compared."""
    rows = [(i, [float(x) for x in v], y) for i, v, y in rows if v is not None and y is not None
            and all(x is not None and np.isfinite(x) for x in v)]
    width = max([len(v) for _, v, _ in rows], default=0)
    x = [[int(np.floor(use.scale * c)) for c in v] + [0] * (width - len(v)) for _, v, _ in rows]
    out = []
    for a, (i, _, y) in enumerate(rows):
        if i is None or i % use.every:
            continue
        score = [sum(p * q for p, q in zip(x[a], v)) for v in x]
        order = sorted(range(len(rows)), key=lambda j: (-score[j], rows[j][0] is None, rows[j][0] or 0))
        for p in [j for j in order if j != a and rows[j][2] == y][: use.positives]:
            under = [j for j in order if rows[j][2] != y and use.low * score[p] <= 100 * score[j] <= use.high * score[p]]
            out += [(i, rows[p][0], r + 1, rows[j][0], score[p], score[j]) for r, j in enumerate(under[: use.negatives])]
    return sorted(out, key=str)


def relabelled(rows):
    return [(i, v, (y + 1) % 10 if i is not None and y is not None and i % 7 == 0 else y) for i, v, y in rows]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_brute_force(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = [tuple(r) for r in QUERIES["op12_hard_negatives"](spark, folder).collect()]
    assert sorted(got, key=str) == brute(relabelled(rows)) and got


SCHEMA = "vec_id long, embedding array<double>, label int, slot int, row string, score int"


def test_cases_and_blocks(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 6))
    rows = [(i, (centres[i % 4] + 0.6 * rng.normal(size=6)).tolist(), int(rng.integers(0, 5))) for i in range(600)]
    rows += rows[:30] + rows[:3]  # repeated rows, anchors among them
    rows += [(700, None, 1), (701, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (702, [float("nan")] * 6, 1), (703, [0.0] * 6, 2),
             (800, [0.0] * 6, 2), (704, [], 1), (705, [1.0, 2.0], 3), (900, [1.0] * 6, None), (None, centres[0].tolist(), 3),
             (None, centres[1].tolist(), 1), (706, [float("inf")] * 6, 1), (1000, [0.5] * 9, 9)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(5)
    want = brute(relabelled(rows))
    for use in (negatives.Settings(), negatives.Settings(block_bytes=1500)):  # one block, and many
        assert sorted([tuple(r) for r in negatives.mined(df, label=moved(), use=use).collect()], key=str) == want
    assert negatives.mined(df.limit(0)).collect() == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 16)) * 300
    x = np.floor(np.repeat(centres, 50, axis=0) + rng.normal(size=(300, 16)) * 40)
    x = np.concatenate([x, x[:5], -x[:5], np.zeros((2, 16))])
    references = centres / np.sqrt((centres**2).sum(axis=1))[:, None]
    length, angle = negatives.lengths_and_angles(x, references)
    low, high = negatives.score_bounds(length, angle, length, angle, 1e-6)
    score = x @ x.T
    assert (low <= score).all() and (score <= high).all()
    assert (high < 0.8 * length[:, None] * length).mean() > 0.5  # most pairs of other clusters are ruled out


def test_large_components_are_refused(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0], 1), (1, [1.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match="exact integers end"):
        negatives.mined(df).collect()
