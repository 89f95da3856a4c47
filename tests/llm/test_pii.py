import hashlib
import re

import pytest

from throughdoor.llm import pii

BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
TEXTS = [None, "", "a@b.com_x@y.com", "x@@a.b, a@b, a@b.c.", "1.2.3.4.5.6.7.8 0001.2.3.256 000000000000255.1.1.1",
         "é😀 a@b.co 4111 1111 1111 1111, 4111-1111-1111-1111x 41111111111111111 visa",
         "+1 (717) 555-0202 +123456789 ++1 23 (4) 56-78.9)", "a" * 20000, "1" * 20000, "1 " * 20000,
         "a@" + "b." * 20000, "+1" + " " * 20000, "4222 2222 2222 2 1.1.1.1-2.2.2.2", "%+-" * 9000 + "@a.b",
         "DE89 3704 0044 0532 0130 00 and IBAN GB82WEST12345698765432, GB82WEST12345698765433"]


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    out = []
    for k, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if (k == 1 and any(int(x) > 255 for x in m.group().split(".")) or k == 2 and not (12 <= len(d) <= 19 and luhn(d))
                    or k == 3 and not 9 <= len(d) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def assert_same(rows, texts):
    for row in rows:
        want = brute(texts[row["doc_id"]])
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert row["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), texts[row["doc_id"]]
        assert [row[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(x[1] == i for x in want) for i in range(4)]


def test_spans_on_hard_texts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    rows = pii.digest(df).collect()
    assert len(rows) == len(TEXTS)
    assert_same(rows, TEXTS)
    ibans = {r["doc_id"]: r for r in rows}[len(TEXTS) - 1]
    assert ibans["n_iban"] == 2 and "iban:0:27" in ibans["spans"]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_brute_force(spark, sf):
    from throughdoor.llm.queries import QUERIES

    folder = f"/root/testdata/{sf}"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op10_pii"](spark, folder).collect()
    assert len(rows) == len(texts)
    assert_same(rows, texts)


def test_context_raises_the_score_and_mask_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, "call me: +123456789", 7), (2, "see +123456789 there", 8)], "doc_id long, text string, pii int")
    found = {r["doc_id"]: r["pii"] for r in pii.find(df).collect()}
    assert found[1][0]["score"] > found[2][0]["score"]
    masked = {r["doc_id"]: r for r in pii.mask(df).collect()}
    assert masked[2]["masked"] == "see [PHONE] there" and masked[2]["pii"] == 8


def test_no_python_in_the_plan_and_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    plan = pii.digest(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert pii.digest(df).count() == 0
