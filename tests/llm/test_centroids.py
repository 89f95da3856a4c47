import hashlib

import numpy as np
import pytest

from throughdoor.llm import centroids
from throughdoor.llm.queries import QUERIES


def brute(rows, use=centroids.Settings()):
    rows = [(i, [int(np.floor(use.scale * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == use.dims and all(x is not None and np.isfinite(x) for x in v)]
    mark = lambda i: (i is None, hashlib.sha256(f"{use.salt}:{i}".encode()).hexdigest())
    centre = [v for _, v in sorted(rows, key=lambda r: (*mark(r[0]), np.array(r[1], "<i4").tobytes()))[: use.clusters]]
    square = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    nearest = lambda v: min((square(v, c), k) for k, c in enumerate(centre))
    for _ in range(use.rounds):
        of = [nearest(v)[1] for _, v in rows]
        for k in range(len(centre)):
            mine = [v for (_, v), o in zip(rows, of) if o == k]
            if mine:
                centre[k] = [sum(c) // len(mine) for c in zip(*mine)]
    at = [nearest(v) for _, v in rows]
    sums = {k: sum(d for d, o in at if o == k) for _, k in at}
    print_of = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    return sorted([(i, k, d, sums[k], sum(sums.values()), print_of[k]) for (i, _), (d, k) in zip(rows, at)], key=str)


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted([tuple(r) for r in QUERIES["op13_centroids"](spark, folder).collect()], key=str) == brute(rows)


def test_cases(spark):
    rng = np.random.default_rng(3)
    use = centroids.Settings(clusters=9, dims=3, rounds=6)
    rows = [(int(i), np.round(rng.normal(size=3), 1).tolist()) for i in range(300)]
    rows += rows[:60] + [(500, None), (501, [1.0, 2.0]), (502, [1.0, None, 1.0]), (503, [float("nan")] * 3), (504, []),
                         (505, [float("-inf"), 0.0, 0.0]), (None, [0.5, 0.5, 0.5]), (506, [0.0] * 3), (507, [-3.5, 9.0, 30.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cluster int, v string")
    got = sorted([tuple(r) for r in centroids.clustered(df.repartition(4), use=use).collect()], key=str)
    assert got == brute(rows, use)
    few = rows[:4] + rows[:4]  # fewer vectors than clusters, and equal centroids
    small = spark.createDataFrame(few, "vec_id long, embedding array<double>")
    assert sorted([tuple(r) for r in centroids.clustered(small, use=use).collect()], key=str) == brute(few, use)
    assert centroids.clustered(df.limit(0)).collect() == []


@pytest.mark.parametrize("k", [1, 2, 40, 300])
def test_search_is_exact_and_spares_distances(k):
    rng = np.random.default_rng(k)
    centres = np.floor(rng.normal(size=(k, 8)) * 500 + rng.normal(size=(k, 1)) * 2000).astype(np.int64)
    centres[k // 2:] = centres[: k - k // 2]  # equal centroids: the smaller number wins
    x = np.floor(rng.normal(size=(700, 8)) * 500 + rng.normal(size=(700, 1)) * 2000).astype(np.int64)
    x[:k] = centres[:700]
    far = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    ranked = centroids.Ranked(centres)
    who, best = ranked.nearest(x)
    assert (who == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()
    if k >= 40:
        assert ranked.scored < 0.5 * len(x) * k


def test_large_components_and_tables_are_refused(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="exact integers end"):
        centroids.clustered(df, use=centroids.Settings(dims=2)).collect()
    with pytest.raises(ValueError):
        centroids.Settings(clusters=1 << 20)
