"""License scans: fuzzy search for short notices.

A notice of n characters may be found with up to k edits. Cut into k + 1
pieces, at least one of them then stands unchanged (pigeonhole), so an exact
search for all pieces of all notices at once finds every candidate. Where a
piece stands, the regex library's bounded-error matching looks for the whole
notice in the window the piece allows, takes the match with the fewest edits
and reports its span. A match begins and ends with a word.

Texts are searched as their words, A-Z folded, one space between. Words are
runs of bytes other than 0x00-0x2F, 0x3A-0x60 and 0x7B-0x7F after folding; in
UTF-8 that is the same rule by code points.

Defined results: null text is empty, and an empty text has no words, no spans
and score 0. Texts of any length are searched whole; time grows with the
length and the number of seeds. Repeated rows, repeated and null ids each give
a row of their own. Of several matches of one notice that overlap, those
without edits all count; of the others the one with the fewest edits, then the
first, and none that overlaps one without edits. An empty table gives an empty
result. Only id and text are read, so further columns cannot clash.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from throughdoor.llm import words


@dataclass(frozen=True)
class Notice:
    label: str
    text: str  # words, folded, one space between
    base: bool = False
    whole: tuple[str, ...] = ()  # words that a match must hold unchanged

    @property
    def edits(self) -> int:
        return max(1, len(self.text) // 12)


# The three phrases asked for, then wordings from the public texts of common licenses.
NOTICES = (
    Notice("mit", "mit license", True, ("mit",)),
    Notice("apache", "apache license", True),
    Notice("gpl", "general public license", True),
    Notice("agpl", "gnu affero general public license", whole=("gnu",)),
    Notice("lgpl", "gnu lesser general public license", whole=("gnu",)),
    Notice("fdl", "gnu free documentation license", whole=("gnu",)),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose"),
    Notice("bsd", "redistribution and use in source and binary forms"),
    Notice("bsd", "bsd license", whole=("bsd",)),
    Notice("bsd", "2 clause bsd license", whole=("bsd", "2")),
    Notice("bsd", "3 clause bsd license", whole=("bsd", "3")),
    Notice("isc", "isc license", whole=("isc",)),
    Notice("mpl", "mozilla public license"),
    Notice("epl", "eclipse public license"),
    Notice("boost", "boost software license"),
    Notice("unlicense", "free and unencumbered software released into the public domain"),
    Notice("cc-by", "licensed under cc by", whole=("cc", "by")),
    Notice("cc-by", "creative commons attribution"),
    Notice("cc0", "cc0 1 0 universal", whole=("cc0",)),
    Notice("reserved", "all rights reserved", whole=("all",)),
)

_GAPS = np.ones(256, dtype=bool)
_GAPS[[*range(0x30, 0x3A), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"): ord("Z") + 1] += 32


def folded(piece: words.Piece) -> list[tuple[int, str]]:
    """(number of words, the words with one space before, between and behind) of each row."""
    found = words.split(piece, _GAPS)
    data = _FOLD[piece.data]
    gap = _GAPS[piece.data]
    data[gap] = 0x20
    keep = ~gap
    keep[found.end[found.end < len(keep)]] = True  # the first gap behind a word
    upto = np.concatenate([[0], np.cumsum(keep)])
    kept = data[keep].tobytes()
    counts = np.diff(found.bounds).tolist()
    out = []
    for n, first, last, a, b in zip(counts, found.bounds[:-1].tolist(), found.bounds[1:].tolist(),
                                    piece.offsets[:-1].tolist(), piece.offsets[1:].tolist()):
        # a row's own part, from its first word to the end of its last
        text = kept[upto[found.start[first]]: upto[found.end[last - 1]]] if n else b""
        out.append((n, f" {text.decode('utf-8', 'replace')} "))
    return out


def pieces_of(text: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece) of edits + 1 pieces of nearly equal length."""
    edges = [round(i * len(text) / (edits + 1)) for i in range(edits + 2)]
    return [(a, text[a:b]) for a, b in zip(edges[:-1], edges[1:])]


@dataclass(frozen=True)
class Span:
    """Characters begin:end of the folded text, ``edits`` away from the notice."""

    notice: int
    begin: int
    end: int
    edits: int


class Scanner:
    """All notices, ready to be looked for."""

    def __init__(self, notices: tuple[Notice, ...] = NOTICES):
        self.notices = notices
        self.seeds = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(notices):
            for offset, piece in pieces_of(n.text, n.edits):
                found.setdefault(piece, []).append((i, offset))
        for piece, where in found.items():
            self.seeds.add_word(piece, (len(piece), tuple(where)))
        self.seeds.make_automaton()
        self.patterns = [regex.compile(f" ((?:{regex.escape(n.text)}){{e<={n.edits}}}) ", regex.BESTMATCH) for n in notices]
        self.verify = lru_cache(maxsize=20_000)(self._verify)  # windows are short, and license lines repeat

    def _verify(self, i: int, window: str) -> tuple[int, int, int] | None:
        """Where the notice stands best in the window, and its edits."""
        match = self.patterns[i].search(window)
        if not match:
            return None
        held = match.group(1).split(" ")
        if any(w not in held for w in self.notices[i].whole):
            return None
        return (*match.span(1), sum(match.fuzzy_counts))

    def spans(self, text: str) -> list[Span]:
        """All spans in a folded text, by begin, end and notice."""
        exact, near = set(), set()
        tried = set()  # seeds of one place ask for the same window
        for last, (size, where) in self.seeds.iter(text):
            for i, offset in where:
                notice = self.notices[i]
                begin = last + 1 - size - offset  # if nothing is edited before the piece
                if (i, begin) in tried:
                    continue
                tried.add((i, begin))
                end = begin + len(notice.text)
                if begin > 0 and text.startswith(notice.text, begin) and text[begin - 1] == " " and text[end] == " ":
                    exact.add(Span(i, begin, end, 0))
                    continue
                low = max(0, begin - notice.edits - 1)
                found = self.verify(i, text[low: end + notice.edits + 1])
                if found:
                    (exact if found[2] == 0 else near).add(Span(i, low + found[0], low + found[1], found[2]))
        return sorted(exact | self._apart(exact, near), key=lambda s: (s.begin, s.end, s.notice))

    @staticmethod
    def _apart(exact: set[Span], near: set[Span]) -> set[Span]:
        """Of overlapping spans of a notice, the one with the fewest edits, then the first."""
        out: set[Span] = set()
        for i in {s.notice for s in near}:
            marks = sorted([s for s in near | exact if s.notice == i], key=lambda s: (s.begin, s.end))
            at = 0
            while at < len(marks):  # runs of spans that overlap one another
                run, end = [marks[at]], marks[at].end
                at += 1
                while at < len(marks) and marks[at].begin < end:
                    run.append(marks[at])
                    end = max(end, marks[at].end)
                    at += 1
                taken: list[Span] = []
                for s in sorted(run, key=lambda s: (s.edits, s.begin, s.end)):
                    if s.edits == 0 or all(s.end <= t.begin or t.end <= s.begin for t in taken):
                        taken.append(s)
                out.update(taken)
        return out


SPAN = T.StructType([
    T.StructField("label", T.StringType()), T.StructField("notice", T.StringType()), T.StructField("found", T.StringType()),
    T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("edits", T.IntegerType()),
    T.StructField("base", T.BooleanType())])


def scanned(df: DataFrame, id_column: str = "doc_id", text: str = "text",
            notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """(id, n_words, spans) of every row; spans by place.

    A span names the notice and its label, the words that stand there, the
    number of the first (from 0) and how many they are, and the edits. ``base``
    is a phrase asked for that stands there without any.
    """
    schema = T.StructType([
        T.StructField("id", df.schema[id_column].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(SPAN))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        kind = pa.list_(pa.struct([
            ("label", pa.string()), ("notice", pa.string()), ("found", pa.string()), ("first_word", pa.int64()),
            ("n_words", pa.int64()), ("edits", pa.int32()), ("base", pa.bool_())]))
        for b in batches:
            for piece in words.pieces(b.column(1)):
                counts, spans = [], []
                for n, body in folded(piece):
                    counts.append(n)
                    spans.append(list(_told(scanner, body)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(piece.first, piece.rows), pa.array(counts, pa.int64()), pa.array(spans, kind)],
                    names=["id", "n_words", "spans"])

    return df.select(F.col(id_column).alias("id"), F.col(text).alias("body")).mapInArrow(scan, schema)


def _told(scanner: Scanner, body: str) -> Iterator[dict]:
    at = word = 0
    for s in scanner.spans(body):
        word += body.count(" ", at, s.begin)  # a space stands before every word
        at = s.begin
        notice, found = scanner.notices[s.notice], body[s.begin: s.end]
        yield {"label": notice.label, "notice": notice.text, "found": found, "first_word": word - 1,
               "n_words": found.count(" ") + 1, "edits": s.edits, "base": notice.base and s.edits == 0}


def digest(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts, places and labels of its notices, and a score.

    The score is the largest unedited share of a notice found, 0 without any.
    """
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["first_word"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    share = F.transform("spans", lambda s: 1 - s["edits"] / F.length(s["notice"]))
    return scanned(df, id_column, text).select(
        F.col("id").alias(id_column), "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(share), F.lit(0.0)).alias("score"),
        F.transform("spans", lambda s: F.struct(
            s["label"].alias("label"), s["found"].alias("found"), s["first_word"].alias("first_word"),
            s["n_words"].alias("n_words"), s["edits"].alias("edits"))).alias("spans"))
