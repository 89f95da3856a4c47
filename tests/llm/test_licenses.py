import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from throughdoor.llm import licenses, words
from throughdoor.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(text):
    w = split(text)
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    places = [i for i, _ in hits]
    return len(w), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))


def distance(a, b):
    """Edits from a to b."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def brute_labels(text):
    """Labels of the notices within their edits of some run of whole words."""
    w, out = split(text), set()
    for n in licenses.NOTICES:
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                run = " ".join(w[i:j])
                if len(run) > len(n.text) + n.edits:
                    break
                if set(n.whole) <= set(w[i:j]) and distance(run, n.text) <= n.edits:
                    out.add(n.label)
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_brute_force(spark, sf):
    folder = f"/root/testdata/{sf}"
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op11_licenses"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score == 1) >= (r.n_base > 0)


CASES = [
    (1, "Released under the MIT-License.\nMIT\tLICENSE mit license"), (2, "released under the MIT Licence"), (3, None), (4, ""),
    (5, "Apache License, apache, license; Apachelicense"), (6, "GNU Lesser General Public Licnse"), (7, "commit license kit license"),
    (None, "general public license"), (1, "Released under the MIT-License.\nMIT\tLICENSE mit license"), (9, "é mit license é"),
    (10, "x " * 200_000 + "the Apache License here " + "y " * 200_000), (11, "MIT License " * 5_000),
    (12, "Permission is hereby granted, free of charges, to any persn obtaining a copy"), (13, " . - "), (14, "all right reserved")]


def test_cases(spark):
    df = spark.createDataFrame([(i, t, "a", 1, 2) for i, t in CASES], "doc_id long, text string, spans string, id int, body int")
    rows = licenses.digest(df).collect()
    key = lambda r: str(r)
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows], key=key) == sorted(
        [(i, *brute(t)) for i, t in CASES], key=key)
    by = {r.doc_id: r for r in rows}
    assert by[2].labels == "mit" and by[2].base_labels == "" and by[2].score == pytest.approx(10 / 11)
    assert by[2].spans[0].asDict() == {"label": "mit", "found": "mit licence", "first_word": 3, "n_words": 2, "edits": 1}
    assert by[6].labels == "gpl,lgpl" and by[7].labels == "" and by[7].score == 0
    assert by[12].labels == "mit" and by[14].labels == "reserved"
    assert by[11].n_base == 5_000 and by[10].first_word == 200_001
    assert licenses.digest(df.limit(0)).collect() == []


def test_pieces_cover_the_notice():
    for n in licenses.NOTICES:
        pieces = licenses.pieces_of(n.text, n.edits)
        assert "".join(p for _, p in pieces) == n.text and len(pieces) == n.edits + 1
        assert all(n.text[a: a + len(p)] == p and p for a, p in pieces)


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_every_edited_notice_is_found(data):
    n = data.draw(st.sampled_from([x for x in licenses.NOTICES if len(x.text) < 40]))
    text = list(n.text)
    for _ in range(data.draw(st.integers(0, n.edits))):
        at = data.draw(st.integers(0, len(text) - 1))
        how = data.draw(st.sampled_from("ids"))
        text[at: at + 1] = {"i": [data.draw(st.sampled_from("aexz")), *text[at: at + 1]], "d": [],
                            "s": [data.draw(st.sampled_from("aexz"))]}[how]
    text = f"{data.draw(st.sampled_from(['', 'some ', 'public license ']))}{''.join(text)}{data.draw(st.sampled_from(['', ' more', ' license']))}"
    piece = next(words.pieces(pa.array([text])))
    [(count, body)] = licenses.folded(piece)
    assert count == len(split(text))
    got = {licenses.NOTICES[s.notice].label for s in licenses.Scanner().spans(body)}
    assert got == brute_labels(text)
