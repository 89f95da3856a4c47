import collections
import re

from throughdoor.llm import preferences
from throughdoor.llm.queries import QUERIES

SCHEMA = "pair_id long, turn long, role string, text string"
CHOSEN = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo <|end|>"), (1, 2, "user", "more"), (1, 3, "assistant", "A"),
          (2, 0, "user", "x"), (2, 0, "user", "x"), (3, 0, "user", "q"), (None, 0, "user", "z"), (4, None, "a", "b")]
REJECTED = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo <|end|>"), (1, 2, "user", "mére"), (1, 3, "assistant", "B"),
            (2, 0, "user", "x"), (5, 0, "assistant", None)]


def test_defined_cases(spark):
    rows = preferences.formatted(spark.createDataFrame(CHOSEN, SCHEMA), spark.createDataFrame(REJECTED, SCHEMA))
    one = {r["pair_id"]: r for r in preferences.assembled(rows).collect()}
    assert set(one) == {1, 2, 3, 5}
    assert one[1]["prompt"] == "<|user|>\nhi<|end|>\n<|assistant|>\nyo < |end|><|end|>\n"
    assert one[1]["chosen"] == "<|user|>\nmore<|end|>\n<|assistant|>\nA<|end|>\n"
    start, end = one[1]["chosen_loss"][0]
    assert one[1]["chosen"][start:end] == "A<|end|>\n"
    assert one[2]["prompt"] and not one[2]["chosen"] and not one[2]["rejected"]
    assert one[3]["chosen"] and not one[3]["prompt"] and one[3]["chosen_loss"] == []
    assert one[5]["rejected"] == "<|assistant|>\n<|end|>\n"
    plan = rows._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    nothing = spark.createDataFrame([], SCHEMA)
    assert preferences.formatted(nothing, nothing).count() == 0


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    talks = collections.defaultdict(list)
    for r in spark.read.parquet(f"{folder}/conversations.parquet").orderBy("conv_id", "turn").collect():
        talks[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
    last = {c: max((t for t in turns if t[1] == "assistant"), default=None) for c, turns in talks.items()}
    want = []
    show = lambda role, text: f"<|{role}|>\n{text.replace('<|', '< |')}<|end|>\n"
    for c, turns in talks.items():
        other = last.get(c ^ 1)
        if not last[c] or not other:
            continue
        for t, role, text in turns:
            if t < last[c][0] or (t == last[c][0] and text == other[2]):
                want.append((c, "prompt", t, show(role, text), False))
            elif t == last[c][0]:
                want += [(c, "chosen", t, show(role, text), True), (c, "rejected", t, show(role, other[2]), True)]
    got = [(r["pair_id"], r["part"], r["turn"], r["text"], r["loss"]) for r in QUERIES["op8_preferences"](spark, folder).collect()]
    assert sorted(got) == sorted(want) and want
