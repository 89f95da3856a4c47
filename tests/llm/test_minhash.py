import collections
import random
import re

import pytest

from throughdoor.llm import minhash
from throughdoor.llm.stored import Shelf, components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, percent=85):
    sets = {}
    for d, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[d] = frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    where = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for d, s in sets.items():
        shared = collections.Counter(e for x in s for e in where[x] if e > d)
        for e, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = find(d), find(e)
                top[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def check(got, rows):
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_brute_force(spark, sf):
    from throughdoor.llm.queries import QUERIES

    folder = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    check(QUERIES["op9_minhash"](spark, folder).collect(), [tuple(r) for r in rows])


def test_families_of_edited_copies_and_a_shared_passage(spark):
    """Chains, near misses and a passage that most texts hold; small cells so that lists are split."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base, passage, rows = [word() for _ in range(120)], [word() for _ in range(70)], []
    for i in range(150):
        text = list(base)
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(len(text))] = word()
        rows.append((i, " ".join(text)))
    for i in range(150, 300):
        rows.append((i, " ".join([word() for _ in range(rng.randint(0, 60))] + passage)))
    chain = [word() for _ in range(150)]
    for i in range(300, 320):
        rows.append((i, " ".join(chain[3 * (i - 300): 3 * (i - 300) + 90])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    check(minhash.near_duplicates(df, minhash.Settings(block=8)).collect(), rows)


def test_defined_cases(spark):
    rows = [(None, "a b c d e f"), (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One TWO"), (6, "one two three"),
            (7, "É a b c d"), (8, "é a b c d"), (9, "a b c d e f"), (9, "a b c d e f"), (10, "a b c d e f"),
            (10, "q r s t u"), (11, "Q R S T U"), (12, "x " * 50000), (13, "x x x x x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    of = {r["doc_id"]: r["component_id"] for r in got}
    assert of == {None: None, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 9, 10: 9, 11: 9, 12: 12, 13: 12}
    assert [r["kept"] for r in got if r["doc_id"] in (None, 9)] == [True] * 3
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["component"] for r in components(Shelf(spark, "t"), df).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))
