import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from throughdoor.llm import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def sets_of(texts):
    out = []
    for piece, sets, bounds in words.shingle_sets(pa.array(texts, pa.string())):
        out += [sets[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    return out


def brute_sets(texts, k=5):
    out = []
    for text in texts:
        w = WORD.findall(lower(text or ""))
        out.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


text = st.text(alphabet="aB é\n\t \x0b1.", max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), text), max_size=8))
def test_sets_agree_with_tuples(texts):
    got, want = sets_of(texts), brute_sets(texts)
    assert [len(x) for x in got] == [len(x) for x in want]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def test_hashes_do_not_depend_on_the_piece():
    texts = ["one two three four five six", "two", None, "", "x" * 5000, "one two three four five six"]
    column = pa.array(texts, pa.string())
    flat = [h for p in words.pieces(column, limit=8) for h in words.word_hashes(p, words.split(p))]
    whole = [h for p in words.pieces(column) for h in words.word_hashes(p, words.split(p))]
    assert flat == whole


def test_beginnings():
    column = pa.array(["abcdef abcxyz ab"], pa.string())
    piece = next(words.pieces(column))
    found = words.split(piece)
    three, all_ = words.word_hashes(piece, found, 3, 99)
    assert three[0] == three[1] != three[2] and len(set(all_.tolist())) == 3
