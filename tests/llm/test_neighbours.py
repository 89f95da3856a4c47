import numpy as np

from throughdoor.llm import neighbours
from throughdoor.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    good = [(v, np.array(e, dtype=np.float64), l) for v, e, l in rows
            if v is not None and l is not None and e is not None and None not in e and np.isfinite(np.array(e, float)).all()
            and np.any(np.array(e, float) != 0)]
    links, top = {}, {}
    for key in {(l, len(e)) for _, e, l in good}:
        ids = [v for v, e, l in good if (l, len(e)) == key]
        x = np.stack([e for v, e, l in good if (l, len(e)) == key])
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= threshold
        at = np.arange(len(ids))
        while True:
            low = np.where(near, at[None, :], len(ids)).min(axis=1)
            if (low == at).all():
                break
            at = low
        order = np.array(ids)
        for i, v in enumerate(ids):
            links[v] = int(near[i].sum()) - 1
            top[v] = int(order[at == at[i]].min())
    return links, top


def check(got, rows, least_share=1.0):
    links, top = brute(rows)
    assert len(got) == len(rows)
    right = 0
    for r in got:
        v = r["vec_id"]
        want = (links.get(v, 0), top.get(v, v))
        assert r["n_links"] <= want[0]
        right += (r["n_links"], r["component_id"]) == want
        assert r["kept"] == (v is None or v == r["component_id"])
    assert right >= least_share * len(rows), (right, len(rows))


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = QUERIES["op3_neighbours"](spark, folder).collect()
    check(got, rows, 0.99)
    # too few links for the audit's sample to hold one is no recall at all
    assert got[0]["audit_recall"] is None if got[0]["audit_links"] == 0 else got[0]["audit_recall"] >= 0.9


def test_dense_regions_copies_and_pairs(spark):
    rng = np.random.default_rng(1)
    rows, centre = [], rng.normal(size=32)
    for i in range(150):  # dense: far more links than a list holds
        rows.append((i, (centre + rng.normal(size=32) * 0.15).tolist(), 1))
    for i in range(150, 200):  # equal vectors
        rows.append((i, [1.0] + [0.0] * 31, 1))
    for i in range(200, 600, 2):  # lonely pairs in noise
        x = rng.normal(size=32)
        rows += [(i, x.tolist(), i % 3), (i + 1, (x * 2 + rng.normal(size=32) * 0.1).tolist(), i % 3)]
    got = neighbours.near_duplicates(spark.createDataFrame(rows, SCHEMA), neighbours.Settings(block=32)).collect()
    links, top = brute([(v, np.float32(e).tolist(), l) for v, e, l in rows])
    right = sum((r["n_links"], r["component_id"]) == (links[r["vec_id"]], top[r["vec_id"]]) for r in got)
    assert right >= 0.97 * len(rows)


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1),
            (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1),
            (12, [1e-30, 0.0], 1), (13, [1e30, 1e28], 1), (None, [1.0, 0.0], 1), (14, [-1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = neighbours.near_duplicates(df).collect()
    check(got, rows)
    assert neighbours.near_duplicates(df.limit(0)).count() == 0


def test_a_pair_between_two_dense_groups_joins_them(spark):
    rng = np.random.default_rng(5)
    axes = np.linalg.qr(rng.normal(size=(32, 3)))[0].T

    def at(degrees):  # on the arc from the first group's centre to the second's
        return np.cos(np.radians(degrees)) * axes[0] + np.sin(np.radians(degrees)) * axes[1]

    rows = []
    for i in range(1000):
        rows.append((i, (at(0 if i < 500 else 45) + rng.normal(size=32) * 0.012).tolist(), 1))
    rows += [(1000, at(12).tolist(), 1), (1001, at(33).tolist(), 1)]  # 21 degrees apart, each near its whole group
    rows += [(1100 + i, (axes[2] + rng.normal(size=32) * 0.012).tolist(), 1) for i in range(100)]  # far from both
    rows = [(v, np.float32(e).tolist(), l) for v, e, l in rows]
    links, top = brute(rows)
    assert {top[v] for v in range(1002)} == {0} and top[1100] == 1100
    got = neighbours.near_duplicates(spark.createDataFrame(rows, SCHEMA), neighbours.Settings(block=64)).collect()
    check(got, rows)
    assert {r["audit_recall"] for r in got} == {1.0}


def test_rare_links_among_many_vectors(spark):
    rng = np.random.default_rng(9)
    noise = rng.normal(size=(20_000, 48))
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    rows = [(i, x.tolist(), 1) for i, x in enumerate(noise)]
    for i in range(60):  # pairs just above the threshold
        side = rng.normal(size=48)
        side -= (side @ noise[i]) * noise[i]
        side /= np.linalg.norm(side)
        rows.append((20_000 + i, (0.934 * noise[i] + np.sqrt(1 - 0.934 ** 2) * side).tolist(), 1))
    got = {r["vec_id"]: r for r in neighbours.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    found = sum(got[20_000 + i]["component_id"] == i for i in range(60))
    assert found >= 59, found


def test_a_label_below_the_audit_is_compared_exactly(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(0, 400, 2):
        x = rng.normal(size=32)
        rows += [(i, x.tolist(), i % 3), (i + 1, (x + rng.normal(size=32) * 0.2).tolist(), i % 3)]
    rows = [(v, np.float32(e).tolist(), l) for v, e, l in rows]
    nothing = lambda groups, use, number=0: spark.createDataFrame([], "u long, v long, sim float")
    monkeypatch.setattr(neighbours, "meetings", nothing)
    got = neighbours.near_duplicates(spark.createDataFrame(rows, SCHEMA), neighbours.Settings(block=32, most_rounds=2)).collect()
    check(got, rows)
    assert {r["audit_recall"] for r in got} == {1.0} and got[0]["audit_links"] > 0


def test_no_evidence_is_no_recall(spark):
    got = neighbours.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1)], SCHEMA)).collect()
    assert {(r["audit_recall"], r["audit_links"]) for r in got} == {(None, 0)}
