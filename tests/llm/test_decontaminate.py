import collections
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from throughdoor.llm import decontaminate
from throughdoor.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, least=0.8):
    """Best share of the item's weight over all windows of the item's size."""
    def weight(s):
        size = sum(len(w.encode()) for w in s)
        return 5 if size < 32 else 6 if size < 64 else 7

    out = {}
    for j, (item_id, text) in enumerate(items):
        w = split(text)
        k = min(5, len(w))
        if not w:
            continue
        item = collections.Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
        total = sum(n * weight(s) for s, n in item.items())
        for i, (doc_id, body) in enumerate(docs):
            d = split(body)
            if not any(tuple(d[a:a + k]) in item for a in range(len(d) - k + 1)):
                continue
            best = 0
            for a in range(max(1, len(d) - len(w) + 1)):
                here = d[a:a + len(w)]
                c = collections.Counter(tuple(here[b:b + k]) for b in range(len(here) - k + 1))
                best = max(best, sum(min(n, c[s]) * weight(s) for s, n in item.items()) / total)
            if best >= least:
                out[i, j] = (doc_id, item_id, round(best, 9))
    return sorted(out.values(), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_brute_force(spark, sf):
    folder = f"/root/testdata/{sf}"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    rows = QUERIES["op7_decontamination"](spark, folder).collect()
    got = sorted(((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in rows), key=str)
    assert got == brute(docs, items)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "short item"), (3, ""), (4, None),
         (5, "one two three four five six seven eight nine ten eleven twelve"), (6, "a a a a a a a a")]
DOCS = [(1, "x y One two three FOUR five six seven eight nine ten eleven twelve z"),
        (2, "one two three four five six seven eight nine ten eleven XX"), (3, "a very short item here"), (4, None),
        (5, ""), (None, "short item"), (7, "one two three four"), (8, "a " * 5000), (9, "clean text without such a thing"),
        (1, "short item"), (11, "one two three four five six SEVEN! eight nine ten eleven twelve")]


def test_defined_cases_and_blocks(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    small = decontaminate.Settings(block_bytes=40)  # several passes
    for use in (decontaminate.Settings(), small):
        rows = decontaminate.contaminated(docs, items, use).collect()
        got = sorted(((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in rows), key=str)
        assert got == brute(DOCS, ITEMS)
        named = docs.withColumn("item_id", docs["doc_id"])
        left = decontaminate.clean(named, items, use)
        assert left.columns == named.columns
        assert sorted(r["doc_id"] for r in left.collect()) == [4, 5, 7, 9, 11]
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0


def test_the_blocks_find_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 256, (400, 16), dtype=np.uint8)
    asked = np.concatenate([prints[:200], rng.integers(0, 256, (100, 16), dtype=np.uint8)])
    flips = rng.random((300, 128)) < rng.random(300)[:, None] * 0.5
    asked ^= np.packbits(flips, axis=1)
    for radius in (0, 3, 47, 60):
        index = decontaminate.HammingIndex(prints, radius)
        a, b, far = index.near(asked)
        all_ = np.bitwise_count(asked[:, None] ^ prints[None, :]).sum(axis=2)
        want = np.argwhere(all_ <= radius)
        assert sorted(zip(a.tolist(), b.tolist())) == sorted(map(tuple, want.tolist()))
        assert (far == all_[a, b]).all()


@pytest.mark.parametrize("case", ["even", "heavy", "repeated", "short"])
def test_windows_that_share_enough_stay_within_the_radius(case):
    """At the threshold itself; recall above 0.999 in each case."""
    rng = np.random.default_rng(4)
    n = 10 if case == "short" else 50
    lost = n // 5
    own = rng.integers(0, 1 << 63, (4000, n), dtype=np.uint64)
    if case == "repeated":
        own[:, :lost] = own[:, :1]
    other = own.copy()
    other[:, :lost] = rng.integers(0, 1 << 63, (4000, lost), dtype=np.uint64)
    if case == "repeated":
        other[:, :lost] = other[:, :1]
    weights = np.full(own.shape, 5)
    theirs = weights.copy()
    if case == "heavy":
        theirs[:, :lost] = 7
    far = np.bitwise_count(decontaminate.simhash(own, weights) ^ decontaminate.simhash(other, theirs)).sum(axis=1)
    assert (far <= decontaminate.Settings().radius).mean() > 0.999


def test_rows_come_through_the_index_alone(monkeypatch):
    screen = decontaminate.Screen([1], [ITEMS[0][1]], decontaminate.Settings())
    texts = pa.array([DOCS[0][1]])
    assert [h[1] for h in screen.hits(texts)] == [0]
    nothing = tuple(np.zeros((3, 0), np.int64))
    monkeypatch.setattr(decontaminate.HammingIndex, "near", lambda self, asked: nothing)
    assert list(screen.hits(texts)) == []


def test_clashing_columns_and_an_item_far_inside(spark):
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(1, long + " " + ITEMS[0][1] + " " + long, 7, 8, 9.0), (2, long, 7, 8, 9.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int, first_word int, similarity double")
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    got = decontaminate.contaminated(docs, items).collect()
    assert [tuple(r) for r in got] == [(1, 1, 60_000, 12, 0, 1.0)]
    assert [r["doc_id"] for r in decontaminate.clean(docs, items).collect()] == [2]


def test_a_batch_is_searched_in_little_memory():
    """Two tasks of an executor search at once beside its heap: 8 MB of short texts, far fewer bytes of arrays."""
    screen = decontaminate.Screen([1], [ITEMS[0][1]], decontaminate.Settings())
    texts = pa.array([f"{i} " + "plain words of no item " * 90 for i in range(4000)] + [DOCS[0][1]])
    tracemalloc.start()
    try:
        found = [h[:2] for h in screen.hits(texts)]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == [(4000, 0)]
    assert most < 20 << 20


def test_workers_hand_their_memory_back(spark, monkeypatch):
    """Both ways through the documents give freed memory back when a task ends."""
    runs, plain = [], decontaminate.words.trimmed
    monkeypatch.setattr(decontaminate.words, "trimmed", lambda run: runs.append(run) or plain(run))
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    decontaminate.clean(docs, items)
    decontaminate.contaminated(docs, items)
    assert len(runs) == 2


@pytest.mark.parametrize("extra", [150, 300, 1000, 20000])
def test_a_long_word_at_an_item_does_not_hide_it(extra):
    rng = np.random.default_rng(extra)
    docs, items = [], []
    for i in range(60):
        item = [f"w{n}" for n in rng.integers(0, 100_000, 40)]
        glued = "".join(rng.choice(list("abcdefgh"), extra))
        items.append((i, " ".join(item)))
        at = (39, 0, 20)[i % 3]  # glued to the last, the first, or in place of a word within
        body = item[:at] + [glued if at == 20 else item[at] + glued if at else glued + item[at]] + item[at + 1:]
        docs.append((i, " ".join(["before"] * 9 + body + ["behind"] * 9)))
    screen = decontaminate.Screen([i for i, _ in items], [t for _, t in items], decontaminate.Settings())
    got = [(docs[row][0], screen.ids[item], round(alike, 9))
           for row, item, *_, alike in screen.hits(pa.array([t for _, t in docs]))]
    assert len(got) == 60 and sorted(got, key=str) == brute(docs, items)
