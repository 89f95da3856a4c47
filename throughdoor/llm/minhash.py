"""Near-duplicate documents by a join of inverted signature coordinates.

Texts with the same shingle set are one class, and one document stands for it.
Every representative is posted under its (coordinate, value) tokens. Two sets
as alike as the threshold asks agree in at least ``least_equal`` of
``coordinates`` coordinates, so they share a token among the
``coordinates - least_equal + 1`` rarest of either: only those are posted
(prefix), and the other coordinates are probed in the signatures of the pairs
that meet (skip). What agrees often enough is confirmed on the full sets.

Only components are asked for, so the members of a posting list are first
compared with one of them alone, another one in every list and round;
afterwards only pairs of a list that are not yet in one component are compared,
in cells of bounded size, and a cell gives members and joining links, never
pairs. What a list of near copies moves is therefore about its length.

Chance of missing a pair: a pair at similarity s agrees in Binomial(64, s)
coordinates. At s = 0.85 fewer than 38 agree about once in seven million pairs;
a missed pair changes a component only if no other path joins the two.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from throughdoor.llm import words
from throughdoor.llm.stored import Shelf, components


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    percent: int = 85  # of the union that the intersection must reach
    coordinates: int = 64
    least_equal: int = 38
    order_buckets: int = 1 << 18  # tokens are ordered by the load of their bucket
    block: int = 128  # members of a long list compared in one cell
    rounds: int = 2  # of comparing lists with one member each

    @property
    def prefix(self) -> int:
        return self.coordinates - self.least_equal + 1


_SEEDS = words.mix(np.arange(1, 1025, dtype=np.uint64))
_A, _B = _SEEDS[:512] | np.uint64(1), _SEEDS[512:]

FEATURES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()),
    T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()),
    T.StructField("signature", T.BinaryType())])


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums by row modulo 2**64; empty rows are 0."""
    upto = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(values)])
    return upto[bounds[1:]] - upto[bounds[:-1]]


def signatures(sets: np.ndarray, bounds: np.ndarray, coordinates: int) -> np.ndarray:
    """(rows, coordinates) minima of hashed sets; rows must not be empty."""
    out = np.empty((len(bounds) - 1, coordinates), dtype=np.uint32)
    for i in range(coordinates):
        hashed = (sets ^ _B[i]) * _A[i]
        out[:, i] = np.minimum.reduceat(hashed, bounds[:-1]) >> np.uint64(32)
    return out


def binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as a binary column."""
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    """The rows of a binary column of equal lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, width), dtype)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)
    at = ends[column.offset]
    raw = np.frombuffer(data, np.uint8)[at: ends[column.offset + len(column)]]
    return raw.view(dtype).reshape(len(column), width)


def features(docs: DataFrame, use: Settings) -> DataFrame:
    """Set size, two set hashes and the signature of every document."""
    k, coordinates = use.shingle, use.coordinates

    @words.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, sets, bounds in words.shingle_sets(batch.column(1), k):
                ids = batch.column(0).slice(piece.first, piece.rows)
                counts = np.diff(bounds)
                some = counts > 0
                signed = np.zeros((piece.rows, coordinates), dtype=np.uint32)
                if some.any():
                    signed[some] = signatures(sets, np.append(bounds[:-1][some], bounds[-1]), coordinates)
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(counts.astype(np.int64)),
                    pa.array(row_sums(words.mix(sets), bounds).view(np.int64)),
                    pa.array(row_sums(words.mix(sets ^ _B[0]), bounds).view(np.int64)),
                    binary(signed)], names=FEATURES.names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FEATURES)


def _tokens(signed: np.ndarray) -> np.ndarray:
    return (np.arange(signed.shape[1], dtype=np.uint64) << np.uint64(32)) | signed


def bucket_loads(signed: DataFrame, use: Settings) -> np.ndarray:
    """How many tokens fall into each of ``order_buckets`` hash buckets.

    The table has a fixed size, whatever the input. It serves only to put the
    tokens in an order that has the frequent ones last; any order is right.
    """
    coordinates, buckets = use.coordinates, use.order_buckets

    @words.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            tokens = _tokens(matrix(batch.column(0), np.uint32, coordinates))
            load += np.bincount((words.mix(tokens) % np.uint64(buckets)).ravel().astype(np.int64), minlength=buckets)
        at = np.flatnonzero(load)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(load[at])], names=["bucket", "n"])

    table = (signed.select("signature").mapInArrow(run, "bucket long, n long")
             .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
    load = np.zeros(buckets, dtype=np.uint64)
    load[table["bucket"].to_numpy()] = np.minimum(table["n"].to_numpy(), (1 << 32) - 1)
    return load


def prefixes(signed: DataFrame, load: np.ndarray, use: Settings) -> DataFrame:
    """``signed`` (rep, n_shingles, signature) with ``prefix``: which coordinates are among the rarest, a bit for each."""
    coordinates = use.coordinates

    @words.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                rare = _rare(_tokens(matrix(part.column(2), np.uint32, coordinates)), load, use)
                bits = np.bitwise_or.reduce(np.uint64(1) << rare.astype(np.uint64), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(bits.view(np.int64))], names=["rep", "n_shingles", "signature", "prefix"])

    return signed.select("rep", "n_shingles", "signature").mapInArrow(
        run, "rep long, n_shingles long, signature binary, prefix long")


def _rare(tokens: np.ndarray, load: np.ndarray, use: Settings) -> np.ndarray:
    """The coordinates of the rarest tokens of every row."""
    mixed = words.mix(tokens)
    order = (load[mixed % np.uint64(use.order_buckets)] << np.uint64(32)) | (mixed >> np.uint64(32))
    return np.argsort(order, axis=1, kind="stable")[:, :use.prefix]


def postings(signed: DataFrame, load: np.ndarray, use: Settings) -> DataFrame:
    """(token, rep): every representative under its rarest tokens."""
    coordinates, prefix = use.coordinates, use.prefix

    @words.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                tokens = _tokens(matrix(part.column(1), np.uint32, coordinates))
                rare = _rare(tokens, load, use)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.take_along_axis(tokens, rare, 1).ravel().view(np.int64)),
                    pa.array(np.repeat(part.column(0).to_numpy(), prefix))], names=["token", "rep"])

    return signed.select("rep", "signature").mapInArrow(run, "token long, rep long")


def agreeing(pairs: DataFrame, signed: DataFrame, use: Settings) -> DataFrame:
    """The pairs (a, b) whose signatures agree often enough."""
    coordinates, least = use.coordinates, use.least_equal

    @words.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (matrix(batch.column(i), np.uint32, coordinates) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((one == two).sum(axis=1) >= least))

    with_a = pairs.join(signed.select(F.col("rep").alias("a"), F.col("signature").alias("one")), "a")
    with_b = with_a.join(signed.select(F.col("rep").alias("b"), F.col("signature").alias("two")), "b")
    return with_b.select("a", "b", "one", "two").mapInArrow(run, "a long, b long").distinct()


def sets_of(docs: DataFrame, use: Settings) -> DataFrame:
    """(id, items): the full shingle sets of ``docs`` (id, text)."""
    k = use.shingle

    @words.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, sets, bounds in words.shingle_sets(batch.column(1), k):
                items = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(piece.first, piece.rows), items], names=["id", "items"])

    return docs.select("id", "text").mapInArrow(run, "id long, items array<long>")


def confirmed(shelf: Shelf, sets: DataFrame, pairs: DataFrame, use: Settings) -> DataFrame:
    """The pairs (a, b) whose full sets are as alike as asked."""
    ids = shelf.put(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    asked = shelf.only(sets, "id", ids)
    both = (pairs.join(asked.select(F.col("id").alias("a"), F.col("items").alias("one")), "a")
            .join(asked.select(F.col("id").alias("b"), F.col("items").alias("two")), "b"))
    shared = F.size(F.array_intersect("one", "two"))
    counted = both.select("a", "b", shared.cast("long").alias("shared"),
                          (F.size("one") + F.size("two")).cast("long").alias("total"))
    return shelf.put(counted.where(100 * F.col("shared") >= use.percent * (F.col("total") - F.col("shared")))
                     .select("a", "b").distinct(), "links")


def stars(live: DataFrame, label: DataFrame | None, number: int) -> DataFrame:
    """Pairs (a, b) of one member of each list with the others, known pairs aside."""
    if label is None:
        named = live.withColumn("component", F.col("rep"))
    else:
        named = live.join(label, live["rep"] == label["node"], "left").select(
            "token", "rep", F.coalesce("component", "rep").alias("component"))
    centre = F.min_by(F.struct("rep", "component"), F.xxhash64("rep", "token", F.lit(number)))
    lists = named.groupBy("token").agg(
        F.min("component").alias("least"), F.max("component").alias("most"), centre.alias("centre")
    ).where("least <> most").select("token", "centre")
    pairs = named.join(lists, "token").where(F.col("component") != F.col("centre.component"))
    return pairs.select(F.least("rep", "centre.rep").alias("a"), F.greatest("rep", "centre.rep").alias("b")).distinct()


def cells(mixed: DataFrame, label: DataFrame, use: Settings) -> DataFrame:
    """Cells of the lists that hold several components: (token, i, j, members).

    A list of up to ``block`` members is one cell. In a longer one, the members
    of its largest component and the others are dealt into blocks by hash, and
    a cell is a pair of blocks; two blocks of the largest component have
    nothing to compare and make none.
    """
    rep, token, block = F.col("rep"), F.col("token"), use.block
    named = mixed.join(label, mixed["rep"] == label["node"], "left").select(
        token, rep, F.coalesce("component", "rep").alias("component"))
    by_component = named.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
    lists = by_component.groupBy("token").agg(
        F.sum("n").alias("all"), F.max("n").alias("most"), F.count(F.lit(1)).alias("components"),
        F.max_by("component", F.struct("n", "component")).alias("main")).where("components > 1")
    own = F.ceil(F.col("most") / block).cast("int")  # blocks of the largest component
    rest = F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("most")) / block)).cast("int")
    spread = F.abs(F.xxhash64("rep") % (1 << 30)).cast("int")
    dealt = named.join(lists, "token").select(
        token, rep, "component", own.alias("own"), rest.alias("rest"),
        F.when(F.col("all") <= block, 0)
        .when(F.col("component") == F.col("main"), spread % own)
        .otherwise(own + spread % rest).alias("at"), (F.col("all") <= block).alias("short"))
    partners = (F.when(F.col("short"), F.array(F.lit(0)))
                .when(F.col("at") < F.col("own"), F.sequence(F.col("own"), F.col("own") + F.col("rest") - 1))
                .otherwise(F.sequence(F.lit(0), F.col("own") + F.col("rest") - 1)))
    return dealt.select(token, rep, "component", "at", F.explode(partners).alias("other")).select(
        token, F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at", rep, "component")


def mixed_lists(live: DataFrame, label: DataFrame) -> DataFrame:
    """The postings of lists whose members are in more than one component."""
    named = live.join(label, live["rep"] == label["node"], "left").select(
        "token", "rep", F.coalesce("component", "rep").alias("component"))
    lists = named.groupBy("token").agg(
        F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
    return named.select("token", "rep").join(lists.select("token"), "token", "left_semi")


def survivors(mixed: DataFrame, label: DataFrame, known: DataFrame, use: Settings) -> DataFrame:
    """Members of cells that may be like a member of another component there.

    ``known``: rep, signature, prefix, n_shingles. Sets too different in size
    are not alike; other pairs are compared by their signatures. A pair is
    looked at in one list only, that of the first coordinate that both were
    posted under.
    """
    coordinates, least, percent = use.coordinates, use.least_equal, use.percent
    member = F.struct("rep", "component", "at", "n_shingles", "prefix", "signature")
    grouped = (cells(mixed, label, use).join(known, "rep").groupBy("token", "i", "j")
               .agg(F.collect_list(member).alias("members")).where(F.size("members") > 1))
    axes = np.arange(coordinates, dtype=np.uint64)

    @words.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ends, flat = lists.offsets.to_numpy(), lists.values
            rep, component, at, items, prefix = (flat.field(i).to_numpy() for i in range(5))
            signed = matrix(flat.field(5), np.uint32, coordinates)
            posted = ((prefix.view(np.uint64)[:, None] >> axes) & np.uint64(1)).astype(bool)
            token, i, j = (batch.column(c).to_numpy() for c in range(3))
            good, cell = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for row in range(batch.num_rows):
                here = slice(ends[row], ends[row + 1])
                c, s, x, n, p = component[here], signed[here], at[here], items[here], posted[here]
                ask = np.triu(c[:, None] != c[None, :])
                ask &= 100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n)
                if i[row] != j[row]:
                    ask &= x[:, None] != x[None, :]
                one, two = np.nonzero(ask)
                hit = np.zeros(len(c), dtype=bool)
                for cut in range(0, len(one), 1 << 14):
                    a, b = one[cut: cut + (1 << 14)], two[cut: cut + (1 << 14)]
                    equal = s[a] == s[b]
                    first = (equal & p[a] & p[b]).argmax(axis=1)
                    yes = (equal.sum(axis=1) >= least) & (first == token[row] >> 32)
                    hit[a[yes]] = hit[b[yes]] = True
                good.append(np.flatnonzero(hit) + ends[row])
                cell.append(np.full(int(hit.sum()), row))
            good, cell = np.concatenate(good), np.concatenate(cell)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (token[cell], i[cell], j[cell], rep[good], component[good], at[good])],
                names=["token", "i", "j", "rep", "component", "at"])

    return grouped.select("token", "i", "j", "members").mapInArrow(
        run, "token long, i int, j int, rep long, component long, at int")


def overlaps(items: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sizes of all intersections of the given sets (items of set k: ends[k]:ends[k+1])."""
    n = len(ends) - 1
    _, column, times = np.unique(items, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), np.diff(ends))
    common = times[column] > 1  # what one set alone has is in no intersection
    place = np.cumsum(times > 1) - 1
    row, column = row[common], place[column[common]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n, n), dtype=np.float32)
    width = max(64, (1 << 21) // n)  # columns at a time, so the block stays small
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        block = np.zeros((n, width), dtype=np.float32)
        block[row[a:b], column[a:b] - at] = 1
        out += block @ block.T
    return out.astype(np.int64)


def bridges(shelf: Shelf, cells_left: DataFrame, sets: DataFrame, use: Settings) -> DataFrame:
    """Links between components, confirmed on the full sets inside each cell.

    A cell gives no more links than it takes to join its components.
    """
    percent = use.percent
    member = F.struct("rep", "component", "items")
    ids = shelf.put(cells_left.select("rep").distinct(), "ids")
    sets = shelf.only(sets, "id", ids)
    grouped = (cells_left.join(sets, cells_left["rep"] == sets["id"]).groupBy("token", "i", "j")
               .agg(F.collect_list(member).alias("members")))

    @words.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            ends, flat = lists.offsets.to_numpy(), lists.values
            rep, component = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            bounds, items = flat.field(2).offsets.to_numpy(), flat.field(2).values.to_numpy()
            found: list[tuple[int, int]] = []
            for row in range(batch.num_rows):
                a, b = ends[row], ends[row + 1]
                r, c, own = rep[a:b], component[a:b], bounds[a: b + 1]
                size = np.diff(own)
                both = overlaps(items[own[0]: own[-1]], own - own[0])
                alike = 100 * both >= percent * (np.add.outer(size, size) - both)
                alike &= c[:, None] != c[None, :]
                top = {x: x for x in c.tolist()}
                for p, q in zip(*(x.tolist() for x in np.nonzero(np.triu(alike)))):
                    x, y = int(c[p]), int(c[q])
                    while top[x] != x:
                        x = top[x]
                    while top[y] != y:
                        y = top[y]
                    if x != y:
                        top[max(x, y)] = min(x, y)
                        found.append((int(r[p]), int(r[q])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return grouped.select("members").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, use: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Texts are lower-cased in A-Z; words are runs of non-white-space. Documents
    link where intersection / union of their shingle sets reaches
    ``percent`` / 100. A text of fewer than ``shingle`` words is one shingle. A
    text without words, or null, has an empty set and links with nothing; so
    has a row with a null doc_id, whose component is null and which is kept.
    Rows that share a doc_id are one document with several texts: a link of one
    is a link of all. Every row of the smallest doc_id of a component is kept.
    """
    shelf = Shelf(docs.sparkSession, "minhash")
    feats = shelf.put(features(docs, use), "features")
    sets = ["set_a", "set_b", "n_shingles"]
    usable = feats.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = shelf.put(usable.groupBy(*sets).agg(
        F.min("doc_id").alias("rep"), F.min_by("signature", "doc_id").alias("signature")), "classes")
    signed = classes.select("rep", "n_shingles", "signature")
    load = bucket_loads(signed, use)
    posted = postings(signed, load, use)
    lists = posted.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    live = shelf.put(posted.join(lists.select("token"), "token", "left_semi"), "live")

    repeated = usable.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    links = (usable.join(repeated, "doc_id", "left_semi").join(classes.select(*sets, "rep"), sets)
             .where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    reps = shelf.put(live.select("rep").distinct(), "reps")
    named = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"))
    texts = shelf.put(sets_of(shelf.only(named, "id", reps), use), "sets")
    label = None
    for number in range(use.rounds):
        pairs = shelf.put(agreeing(stars(live, label, number), signed, use), "pairs")
        links = links.union(confirmed(shelf, texts, pairs, use))
        label = shelf.put(components(shelf, links), "label")

    mixed = shelf.put(mixed_lists(live, label), "mixed")
    known = prefixes(shelf.only(signed, "rep", reps), load, use)
    left = shelf.put(survivors(mixed, label, known, use), "survivors")
    links = links.union(shelf.put(bridges(shelf, left, texts, use), "bridges"))
    shelf.clear(texts)
    label = shelf.put(components(shelf, links), "label")

    grouped = feats.select("doc_id", *sets).join(classes.select(*sets, "rep"), sets, "left")
    named = grouped.join(label, grouped["rep"] == label["node"], "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))
    return named.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
