"""Near-duplicate vectors by NN-descent.

Every vector has a list of neighbours. The lists start from small groups of
vectors that fall on the same side of random planes; a vector is in as many
groups as two vectors at the threshold need to meet in one with chance
``together``, whatever the size of their label. In each round, a vector
introduces its neighbours, and those that list it, to each other, and a pair
enters the lists it improves. Pairs above the threshold come before all others
and, among themselves, in random order, so that a full list is a fair sample of
a dense region.

A list that is full of pairs above the threshold is saturated. Two saturated
vectors can both have dropped their pair, so those of different components are
compared exactly, in blocks that are skipped where their centres and radii rule
a link out. A component with a saturated vector then has all its pairs counted
in blocks. A sample of vectors is compared with all others to audit the recall of
each label; rounds go on until it is reached. All vectors of a label that stays
below are treated like saturated ones, which is exact. The links that result are
audited again.

Equal vectors are one node with a count. Vectors of a label are never brought
together in one task: all groups have a bounded size.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from throughdoor.llm.minhash import binary, matrix
from throughdoor.llm.stored import Shelf, components


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.93
    listed: int = 16  # neighbours in a list
    planes: int = 24  # of a starting code, as many of them used as a label's size needs
    together: float = 0.995  # chance that two vectors at the threshold share a code
    group: int = 48  # vectors of a starting group, about; one of over four times as many is divided
    introduced: int = 4  # new neighbours that one meeting may give a vector
    block: int = 512  # vectors of a counted block
    least_rounds: int = 2
    most_rounds: int = 8
    audited: int = 1_000  # vectors compared with all others
    recall: float = 0.99
    slack: float = 0.004  # of the half precision that the search uses


def nodes_of(vectors: DataFrame) -> DataFrame:
    """``vectors`` (vec_id, embedding, label) with ``usable`` and the key of equal vectors.

    Usable: id and label are there, all components are finite, one is not zero.
    """
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & finite
              & F.exists(e, lambda x: x != 0))
    return vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(usable, F.lit(False)).alias("usable"),
        F.concat_ws(":", F.col("label").cast("string"), F.size(e)).alias("space"),
        F.xxhash64(e).alias("h1"), F.xxhash64(F.reverse(e), F.lit(7)).alias("h2"))


def _unit(column: pa.Array) -> list[np.ndarray]:
    """Vectors of a list column in double precision, scaled to length 1."""
    flat, ends = column.values.to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()
    out = []
    for a, b in zip(ends[:-1], ends[1:]):
        x = flat[a:b] / np.abs(flat[a:b]).max()  # so that no square overflows or vanishes
        out.append(x / np.sqrt((x * x).sum()))
    return out


def planes_of(n: Column, group: int, use: Settings) -> Column:
    """Planes that part ``n`` vectors into groups of about ``group``."""
    return F.least(F.lit(use.planes), F.greatest(F.lit(0), F.ceil(F.log2(n / group)))).cast("int")


def starts(bits: int, use: Settings) -> int:
    """Codes of ``bits`` planes that two vectors at the threshold need to share one.

    A plane parts them with the chance of their angle over pi.
    """
    alike = (1 - np.arccos(use.threshold) / np.pi) ** bits
    return 1 if bits == 0 else int(np.ceil(np.log(1 - use.together) / np.log(1 - alike)))


def coded(shelf: Shelf, nodes: DataFrame, use: Settings) -> DataFrame:
    """(node, space, half, bits, codes): unit vectors in half precision, and their plane codes."""
    bits = planes_of(F.col("n"), use.group, use).alias("bits")
    sizes = shelf.put(nodes.groupBy("space").agg(F.count(F.lit(1)).alias("n")).select("space", bits), "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(use.planes)
        most = starts(use.planes, use) * use.planes
        for batch in batches:
            halves, codes = [], []
            for x, k in zip(_unit(batch.column(2)), batch.column(3).to_pylist()):
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng(len(x)).normal(size=(most, len(x)))
                n = starts(k, use)
                # the first code has all its planes: blocks are dealt by it
                sides = (planes[len(x)][: n * use.planes] @ x > 0).reshape(n, use.planes)
                halves.append(x.astype(np.float16).tobytes())
                codes.append((sides * weights).sum(axis=1).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(halves, pa.binary()), batch.column(3),
                 pa.array(codes, pa.list_(pa.int32()))], names=["node", "space", "half", "bits", "codes"])

    return nodes.join(sizes, "space").select("node", "space", "embedding", "bits").mapInArrow(
        run, "node long, space string, half binary, bits int, codes array<int>")


def _halves(column: pa.Array) -> np.ndarray:
    """The unit vectors (float32) of a group; they share a length."""
    width = len(column[0].as_py()) // 2
    return matrix(column, np.float16, width).astype(np.float32)


def meetings(groups: DataFrame, use: Settings, number: int = 0) -> DataFrame:
    """(u, v, sim): for the members of each group, the best others that beat their list.

    ``groups`` has ``members``: array of (node, kth, half). Of several pairs
    above the threshold, chance decides which go first, anew in each round.
    """
    schema = "u long, v long, sim float"
    most, near = use.introduced, use.threshold - use.slack

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            ends, flat = lists.offsets.to_numpy(), lists.values
            node, kth = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]]
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                own, first = np.unique(node[a:b], return_index=True)
                if len(own) < 2:
                    continue
                x = _halves(flat.field(2).slice(a, b - a))[first]
                sims = x @ x.T
                np.fill_diagonal(sims, -2)
                n = min(most, len(own) - 1)
                rank = sims
                if (sims >= near).any():
                    chance = np.random.default_rng([number, len(own), int(own.sum()) & 0x7FFFFFFF]).random(sims.shape)
                    rank = np.where(sims >= near, 2 + chance, sims)
                best = np.argpartition(-rank, n - 1, axis=1)[:, :n]
                sim = np.take_along_axis(sims, best, 1)
                good = sim > kth[a:b][first][:, None]
                out[0].append(np.repeat(own, n)[good.ravel()])
                out[1].append(own[best][good])
                out[2].append(sim[good])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in out], names=["u", "v", "sim"])

    return groups.select("members").mapInArrow(run, schema)


def best_of(edges: DataFrame, use: Settings) -> DataFrame:
    """The lists: per u, the pairs above the threshold in random order, then the most alike."""
    near = F.col("sim") >= use.threshold - use.slack
    order = Window.partitionBy("u").orderBy(
        near.desc(), F.when(near, F.xxhash64("u", "v")), F.col("sim").desc(), "v")
    one = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    return one.withColumn("place", F.row_number().over(order)).where(F.col("place") <= use.listed)


def starting(search: DataFrame, use: Settings) -> DataFrame:
    """Groups of vectors of one label that share a plane code, the largest divided."""
    rows = search.select("node", "half", "space", "bits", F.posexplode("codes").alias("number", "code"))
    rows = rows.withColumn("code", F.expr("code & (shiftleft(1, bits) - 1)")).drop("bits")
    key = ["space", "number", "code"]
    crowd = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("crowd"))
    part = F.pmod(F.xxhash64("node", "number"), F.ceil(F.col("crowd") / (4 * use.group)))
    member = F.struct("node", F.lit(-1.0).cast("float").alias("kth"), "half")
    return rows.join(crowd, key).withColumn("part", part).groupBy(*key, "part").agg(
        F.collect_list(member).alias("members"))


def introductions(graph: DataFrame, search: DataFrame, use: Settings) -> DataFrame:
    """Groups to meet: a vector's neighbours and those that list it.

    A vector that very many list has them dealt over several groups, each with
    its own neighbours.
    """
    worst = graph.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("low"))
    kth = worst.select(F.col("u").alias("node"), F.when(
        F.col("n") >= use.listed, F.least(F.col("low"), F.lit(use.threshold - use.slack).cast("float"))
    ).otherwise(-1.0).cast("float").alias("kth"))
    known = search.select("node", "half").join(kth, "node", "left").select(
        "node", "half", F.coalesce("kth", F.lit(-1.0).cast("float")).alias("kth"))
    crowd = graph.groupBy(F.col("v").alias("w")).agg(F.count(F.lit(1)).alias("crowd"))
    parts = crowd.select("w", F.ceil(F.col("crowd") / (2 * use.listed)).cast("int").alias("parts"))
    back = graph.select(F.col("v").alias("w"), F.col("u").alias("node")).join(parts, "w").select(
        "w", "node", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    ahead = graph.select(F.col("u").alias("w"), F.col("v").alias("node")).join(parts, "w", "left").select(
        "w", "node", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    member = F.struct("node", "kth", "half")
    return back.union(ahead).join(known, "node").groupBy("w", "part").agg(F.collect_list(member).alias("members"))


def exact(pairs: DataFrame, nodes: DataFrame, use: Settings) -> DataFrame:
    """The pairs (a, b) whose cosine in double precision reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = _unit(batch.column(2)), _unit(batch.column(3))
            good = [float(x @ y) >= use.threshold for x, y in zip(one, two)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    of = lambda end, name: nodes.select(F.col("node").alias(end), F.col("embedding").alias(name))
    return pairs.join(of("a", "one"), "a").join(of("b", "two"), "b").select("a", "b", "one", "two").mapInArrow(
        run, "a long, b long")


def near_pairs(graph: DataFrame, use: Settings) -> DataFrame:
    ends = graph.where(F.col("sim") >= use.threshold - use.slack)
    return ends.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


def audit_pairs(nodes: DataFrame, use: Settings) -> DataFrame:
    """(a, b, space): all pairs of a fixed sample of ``audited`` nodes with nodes like them."""
    sample = nodes.orderBy(F.xxhash64("node", F.lit(3)), "node").limit(use.audited).select(
        "node", "space", "embedding").toArrow().combine_chunks()
    groups: dict[str, tuple] = {}
    if sample.num_rows:
        units = _unit(sample["embedding"].chunk(0))
        spaces = sample["space"].to_pylist()
        for space in set(spaces):
            at = [i for i, s in enumerate(spaces) if s == space]
            groups[space] = (sample["node"].to_numpy()[at], np.stack([units[i] for i in at]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, units = batch.column(0).to_numpy(), _unit(batch.column(2))
            spaces = np.array(batch.column(1).to_pylist(), dtype=object)
            out, of = [np.zeros((2, 0), np.int64)], []
            for space, (asked, x) in groups.items():
                at = np.flatnonzero(spaces == space)
                if len(at):
                    p, q = np.nonzero(np.stack([units[i] for i in at]) @ x.T >= use.threshold)
                    out.append(np.stack([asked[q], node[at[p]]])[:, asked[q] != node[at[p]]])
                    of += [space] * out[-1].shape[1]
            found = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[0]), pa.array(found[1]), pa.array(of, pa.string())], names=["a", "b", "space"])

    return nodes.select("node", "space", "embedding").mapInArrow(run, "a long, b long, space string")


def saturated(graph: DataFrame, use: Settings) -> DataFrame:
    """Nodes whose whole list is above the threshold."""
    near = F.sum((F.col("sim") >= use.threshold - use.slack).cast("int"))
    return graph.groupBy(F.col("u").alias("node")).agg(near.alias("near")).where(
        F.col("near") >= use.listed).select("node")


def below(truth: DataFrame, graph: DataFrame, use: Settings) -> list[str]:
    """The spaces whose lists miss too many audit pairs; saturated nodes are judged by the final links."""
    full = saturated(graph, use)
    asked = truth.join(full, truth["a"] == full["node"], "left_anti")
    pairs = asked.select("space", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = pairs.join(near_pairs(graph, use).withColumn("there", F.lit(1)), ["a", "b"], "left")
    share = found.groupBy("space").agg((F.count("there") / F.count(F.lit(1))).alias("share"))
    # at most a space for each audited node
    return sorted(r["space"] for r in share.where(F.col("share") < use.recall).collect())


def audited_links(truth: DataFrame, links: DataFrame, inside: DataFrame) -> tuple[int, int]:
    """How many audit pairs there are, and how many are a link or lie in one counted component.

    ``inside``: (node, component) of the components whose pairs are all counted.
    """
    pairs = truth.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = pairs.join(links.distinct().withColumn("there", F.lit(True)), ["a", "b"], "left")
    for end in ("a", "b"):
        found = found.join(inside.select(F.col("node").alias(end), F.col("component").alias("c" + end)), end, "left")
    there = F.coalesce("there", F.col("ca") == F.col("cb"), F.lit(False))
    n, hit = found.agg(F.count(F.lit(1)), F.count_if(there)).first()
    return n, hit


def bridges(shelf: Shelf, members: DataFrame, use: Settings) -> DataFrame:
    """(a, b): a link for every two components of a space that a link joins, found exactly.

    ``members``: (node, space, codes, component, embedding). They are dealt into
    blocks by a plane code. Two blocks are compared unless they hold one
    component alone, or their centres are further apart than both radii and the
    threshold's angle.
    """
    sizes = members.groupBy("space").agg(F.count(F.lit(1)).alias("n"))
    sizes = shelf.put(sizes.select("space", planes_of(F.col("n"), use.block, use).alias("bits")), "bits")
    coded_ = members.join(sizes, "space").withColumn(
        "code", F.expr("codes[0] & (shiftleft(1, bits) - 1)"))
    crowd = coded_.groupBy("space", "code").agg(F.count(F.lit(1)).alias("crowd"))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("crowd") / use.block))
    at = F.col("code").cast("long") * (1 << 32) + part
    dealt = shelf.put(coded_.join(crowd, ["space", "code"]).select(
        "space", at.alias("at"), "node", "component", "embedding"), "dealt")

    def ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centres, radii = [], []
            lists = batch.column(4)
            for a, b in zip(lists.offsets.to_numpy()[:-1].tolist(), lists.offsets.to_numpy()[1:].tolist()):
                x = np.stack(_unit(lists.values.slice(a, b - a)))
                centre = x.sum(axis=0)
                size = np.sqrt(centre @ centre)
                centre = centre / size if size > 1e-9 else x[0]
                centres.append(centre.tolist())
                radii.append(float(np.arccos(np.clip((x @ centre).min(), -1, 1))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(4)] + [pa.array(centres, pa.list_(pa.float64())), pa.array(radii, pa.float64())],
                names=["space", "at", "low", "high", "centre", "radius"])

    balls = shelf.put(dealt.groupBy("space", "at").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.collect_list("embedding").alias("x")
    ).mapInArrow(ball, "space string, at long, low long, high long, centre array<double>, radius double"), "balls")
    one, two = balls.alias("one"), balls.alias("two")
    cosine = F.expr("aggregate(zip_with(one.centre, two.centre, (x, y) -> x * y), 0D, (s, x) -> s + x)")
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    reach = F.col("one.radius") + F.col("two.radius") + float(np.arccos(use.threshold)) + 1e-6
    alone = F.greatest("one.high", "two.high") == F.least("one.low", "two.low")
    met = one.join(two, (F.col("one.space") == F.col("two.space")) & (F.col("one.at") <= F.col("two.at"))).where(
        ~alone & (apart <= reach)).select(F.col("one.space").alias("space"), F.col("one.at").alias("i"), F.col("two.at").alias("j"))
    sides = met.select("space", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("at"))
    cells = sides.join(dealt, ["space", "at"]).groupBy("space", "i", "j").agg(
        F.collect_list(F.struct("node", "component", "at", "embedding")).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends, flat = lists.offsets.to_numpy(), lists.values
            node, component, at = (flat.field(k).to_numpy() for k in range(3))
            out = [np.zeros((2, 0), np.int64)]
            for row, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                i, j = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                x, own, of = np.stack(_unit(flat.field(3).slice(a, b - a))), node[a:b], component[a:b]
                p, q = np.flatnonzero(at[a:b] == i), np.flatnonzero(at[a:b] == j)
                alike = (x[p] @ x[q].T >= use.threshold) & (of[p][:, None] != of[q][None, :])
                r, s = np.nonzero(alike)
                ends_of = np.sort(np.stack([of[p[r]], of[q[s]]]), axis=0)
                first = np.unique(ends_of, axis=1, return_index=True)[1]
                out.append(np.sort(np.stack([own[p[r[first]]], own[q[s[first]]]]), axis=0))
            found = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

    return cells.select("i", "j", "members").mapInArrow(run, "a long, b long")


def counted(members: DataFrame, use: Settings) -> DataFrame:
    """(node, links) within components (component, node, embedding, copies), in blocks.

    Every pair of blocks of a component is one cell; a cell gives sums per node,
    never pairs.
    """
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / use.block).cast("int")
    dealt = members.join(sizes, "component").select(
        "component", "node", "embedding", "copies", blocks.alias("blocks"),
        F.pmod(F.xxhash64("node"), blocks).cast("int").alias("at"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = F.struct("node", "copies", "at", "embedding")
    cells = dealt.groupBy("component", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j")).agg(
        F.collect_list(member).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends, flat = lists.offsets.to_numpy(), lists.values
            node, copies, at = (flat.field(k).to_numpy() for k in range(3))
            for row, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                i, j = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                x = np.stack(_unit(flat.field(3).slice(a, b - a)))
                alike = x @ x.T >= use.threshold
                np.fill_diagonal(alike, False)
                if i != j:
                    alike &= at[a:b][:, None] != at[a:b][None, :]
                links = (alike * copies[a:b][None, :]).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[a:b]), pa.array(links.astype(np.int64))], names=["node", "links"])

    return cells.select("i", "j", "members").mapInArrow(run, "node long, links long").groupBy("node").agg(
        F.sum("links").alias("links"))


def descend(shelf: Shelf, nodes: DataFrame, use: Settings) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """The neighbour lists, the coded vectors, the pairs of the audit, and the spaces that stay below it."""
    search = shelf.put(coded(shelf, nodes, use), "search")
    truth = shelf.put(audit_pairs(nodes, use), "audit")
    graph = shelf.put(best_of(meetings(starting(search, use), use), use), "graph")
    low: list[str] = []
    for number in range(use.most_rounds):
        found = meetings(introductions(graph, search, use), use, number + 1)
        better = shelf.put(best_of(graph.select("u", "v", "sim").union(found), use), "graph")
        shelf.clear(graph)
        graph = better
        if number + 1 >= use.least_rounds:
            low = below(truth, graph, use)
            if not low:
                break
    return graph, search, truth, low


def near_duplicates(vectors: DataFrame, use: Settings = Settings()) -> DataFrame:
    """vec_id, n_links, component_id, kept, audit_recall, audit_links for every row of ``vectors``.

    ``vectors``: vec_id, embedding, label. Vectors of one label and length link
    where their cosine reaches the threshold. A vector that is null, zero or
    holds a null or non-finite component, or has no label, links with nothing
    and is its own component; a null vec_id likewise, with a null component.
    Rows that repeat are vectors of their own. ``audit_links`` is the number of
    links of a sample, compared with all vectors, and ``audit_recall`` the share
    of them that the result holds; null if there are none, which proves nothing.
    """
    shelf = Shelf(vectors.sparkSession, "neighbours")
    rows = nodes_of(vectors)
    key = ["space", "h1", "h2"]
    nodes = shelf.put(rows.where("usable").groupBy(*key).agg(
        F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.min_by("embedding", "vec_id").alias("embedding")),
        "nodes")
    graph, search, truth, low = descend(shelf, nodes, use)
    links = shelf.put(exact(near_pairs(graph, use), nodes, use), "links")
    label = shelf.put(components(shelf, links), "label")
    full = saturated(graph, use)
    if low:
        full = full.union(search.where(F.col("space").isin(low)).select("node")).distinct()
    full = shelf.put(full, "saturated")
    members = full.join(label, "node", "left").join(search.select("node", "space", "codes"), "node").join(
        nodes.select("node", "embedding"), "node").select(
        "node", "space", "codes", F.coalesce("component", "node").alias("component"), "embedding")
    joined = shelf.put(bridges(shelf, members, use), "bridges")
    if not joined.isEmpty():
        links = links.union(joined).distinct()
        label = shelf.put(components(shelf, links), "label")

    dense = shelf.put(label.join(full, "node").select("component").distinct(), "dense")
    whole = label.join(dense, "component")
    asked, held = audited_links(truth.select("a", "b"), links, whole)
    inside = whole.join(nodes.select("node", "embedding", "copies"), "node")
    in_blocks = counted(inside, use)
    both = links.union(links.select("b", "a")).toDF("node", "other")
    outside = both.join(label, "node").join(dense, "component", "left_anti")
    by_pair = outside.join(nodes.select(F.col("node").alias("other"), "copies"), "other").groupBy("node").agg(
        F.sum("copies").alias("links"))
    degree = shelf.put(in_blocks.union(by_pair), "degree")

    classes = nodes.select(*key, "node", "copies").join(degree, "node", "left").join(label, "node", "left")
    classes = classes.select(*key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                             F.coalesce("component", "node").alias("component"))
    good = rows.where("usable").select("vec_id", *key).join(classes, key).select("vec_id", "n_links", "component")
    rest = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long"), F.col("vec_id"))
    out = good.union(rest).toDF("vec_id", "n_links", "component_id")
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    return out.withColumn("kept", kept).withColumn(
        "audit_recall", F.lit(held / asked if asked else None).cast("double")).withColumn(
        "audit_links", F.lit(asked).cast("long"))
