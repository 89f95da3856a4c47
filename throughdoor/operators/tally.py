"""Counts of the methods' views, added up in tasks on Arrow batches.

A row of the backtest's pool belongs to every scenario of its replicate. As a
fan-out each row would be scored and labelled once per scenario and its values
shuffled; here a task holds a block of rows, codes each feature's distinct values
once, and takes scores, labels and weights of every key from these codes in
numpy. What leaves a task are sums by value or by design vector.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import small_table
from . import binning

BLOCK_ROWS = 100_000  # rows a task works on at once


@dataclass
class Fan:
    """Rows that count in several keys.

    ``rows`` have the columns ``on``, the features, ``bad`` (the true outcome) and ``design_w``;
    ``flags`` say per slot if a row is accepted, and ``places`` (keys, on, slot) in
    which keys, by which slot, the rows with equal ``on`` count. ``draw`` is a row's own uniform number.
    """

    rows: DataFrame
    on: list
    flags: list
    places: DataFrame
    draw: Column


@dataclass
class Group:
    """Rows of one key: ``s`` 1 accepted, 0 declined, -1 unknown; outcomes, weights and scores."""

    s: np.ndarray
    bad: np.ndarray
    w: np.ndarray
    draw: np.ndarray
    pd: np.ndarray | None = None
    propensity: np.ndarray | None = None


class _Card:
    """Bins and coefficients of one key, over a block's distinct values."""

    def __init__(self, row, numeric, categorical, beta=None):
        self.coder = binning._Coder(0, row, numeric, categorical)
        self.beta = None if beta is None else [float(b) for b in beta]

    def scores(self, maps, numbers):
        """P(bad) of the rows, to twelve places as ``scorecard.settled`` has it."""
        eta = np.full(len(numbers[0]), self.beta[0])
        for beta, woes, at, number in zip(self.beta[1:], self.coder.woes, maps, numbers):
            eta += (beta * woes[at])[number]
        with np.errstate(over="ignore"):
            return np.rint(1.0 / (1.0 + np.exp(-eta)) * 1e12) / 1e12


def _cards(look: DataFrame, keys, numeric, categorical) -> dict:
    names = [c for c in look.columns if "__" in c] + (["beta"] if "beta" in look.columns else [])
    return {tuple(r[k] for k in keys): _Card(r, numeric, categorical, r["beta"] if "beta" in names else None)
            for r in look.select(*keys, *names).collect()}


class Tally:
    """Passes over a fan with the scorecards that score its rows."""

    def __init__(self, fan: Fan, keys, numeric, categorical, baseline, propensity=None):
        self.fan, self.keys = fan, list(keys)
        self.numeric, self.categorical = list(numeric), list(categorical)
        self.feats = self.numeric + self.categorical
        self.base = _cards(baseline.lookup, keys, numeric, categorical)
        self.approval = _cards(propensity.lookup, keys, numeric, categorical) if propensity else None
        self.found: dict = {}
        self.who, used = {}, [c for c in fan.places.columns if c not in self.keys and c not in ("slot", *fan.on)]
        for r in fan.places.drop(*used).collect():
            key = tuple(r[k] for k in self.keys)
            if key in self.base and (self.approval is None or key in self.approval):
                kid = len(self.who)
                self.who[kid] = key
                self.found.setdefault(tuple(r[c] for c in fan.on), []).append((kid, int(r["slot"])))
        self.ids = small_table(fan.rows.sparkSession, [(*key, kid) for kid, key in self.who.items()], T.StructType(
            [baseline.lookup.schema[k] for k in self.keys] + [T.StructField("_kid", T.IntegerType())]))

    def run(self, each: Callable, schema: T.StructType) -> DataFrame:
        """What ``each(kid, group, values, texts, numbers, base maps, approval maps)`` yields over all blocks.

        ``each`` yields lists of Arrow arrays in the order of ``schema``.
        """
        on, flags = [f"_o{i}" for i in range(len(self.fan.on))], [f"_f{i}" for i in range(len(self.fan.flags))]
        numeric, categorical = [f"_n{i}" for i in range(len(self.numeric))], [f"_t{i}" for i in range(len(self.categorical))]
        cols = [F.col(c).alias(a) for c, a in zip(self.fan.on, on)]
        cols += [F.coalesce(c.cast("tinyint"), F.lit(-1).cast("tinyint")).alias(a) for c, a in zip(self.fan.flags, flags)]
        cols += [F.col(c).cast("double").alias(a) for c, a in zip(self.numeric, numeric)]
        cols += [F.coalesce(F.col(c).cast("string"), F.lit(binning.MISSING_LEVEL)).alias(a)
                 for c, a in zip(self.categorical, categorical)]
        cols += [F.col("bad").cast("double").alias("_bad"), F.col("design_w").cast("double").alias("_w"), self.fan.draw.alias("_draw")]
        who, found, base, approval = self.who, self.found, self.base, self.approval
        names = schema.names

        def work(batches):
            for block in binning.blocks(batches, BLOCK_ROWS):
                plain = lambda c: block.column(c).fill_null(np.nan).to_numpy()
                values = [binning.distinct_values(block.column(c)) for c in numeric]
                texts = [binning.distinct_texts(block.column(c)) for c in categorical]
                bad, w, draw = plain("_bad"), np.nan_to_num(plain("_w")), plain("_draw")
                kinds = [block.column(c).to_numpy() for c in flags]
                for own, at in binning.groups_of(block, on):
                    if own not in found:
                        continue
                    numbers = [x[at] for _, x in [*values, *texts]]
                    mine = bad[at], w[at], draw[at]
                    for kid, slot in found[own]:
                        key = who[kid]
                        card = base[key]
                        bm = card.coder.maps(values, texts)
                        group = Group(kinds[slot][at], *mine, card.scores(bm, numbers))
                        am = None
                        if approval is not None:
                            am = approval[key].coder.maps(values, texts)
                            group.propensity = approval[key].scores(am, numbers)
                        for arrays in each(kid, group, values, texts, numbers, bm, am):
                            yield pa.RecordBatch.from_arrays(arrays, names=names)

        return self.fan.rows.select(*cols).mapInArrow(work, schema)

    def with_keys(self, found: DataFrame) -> DataFrame:
        return found.join(self.ids, "_kid").drop("_kid")

    def design_cells(self) -> DataFrame:
        """(keys, z__*, x__*, s, y, w, n, w2): rows of equal design vectors in the approval and the outcome equation."""
        zs, xs = [f"z__{f}" for f in self.feats], [f"x__{f}" for f in self.feats]
        sums, base, approval, who = ["n", "w", "w2"], self.base, self.approval, self.who

        def each(kid, g, values, texts, numbers, bm, am):
            seen = g.s == 1
            coders = [approval[who[kid]].coder, base[who[kid]].coder]
            columns = [m[x] for m, x in zip([*am, *bm], [*numbers, *numbers])]
            woes = [*coders[0].woes, *coders[1].woes]
            columns += [seen.astype(np.int64), (seen & (g.bad > 0)).astype(np.int64)]
            flag = np.array([0.0, 1.0])
            got, added = binning.added_up(columns, [*woes, flag, flag], [np.ones(len(g.s)), g.w, g.w * g.w])
            yield [pa.array(np.full(len(added[0]), kid, dtype=np.int32)), *[pa.array(x) for x in [*got, *added]]]

        schema = T.StructType([T.StructField("_kid", T.IntegerType())] + [
            T.StructField(c, T.DoubleType()) for c in [*zs, *xs, "s", "y", *sums]])
        by = ["_kid", *zs, *xs, "s", "y"]
        found = self.run(each, schema).groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])
        return self.with_keys(found).select(*self.keys, *zs, *xs, "s", "y", "w", F.col("n").cast("bigint").alias("n"), "w2")

    def declined_means(self, label: Callable, names) -> DataFrame:
        """(keys, names): means over a key's declined rows of what ``label(key, group)`` gives for each name."""
        sums, who = [f"_s{i}" for i in range(len(names))], self.who

        def each(kid, g, *_):
            out = g.s == 0
            if out.any():
                yield [pa.array([kid], pa.int32()), pa.array([float(out.sum())]),
                       *[pa.array([float(x[out].sum())]) for x in label(who[kid], g)]]

        schema = T.StructType([T.StructField("_kid", T.IntegerType())] + [T.StructField(c, T.DoubleType()) for c in ["_n", *sums]])
        found = self.run(each, schema).groupBy("_kid").agg(*[(F.sum(c) / F.sum("_n")).alias(n) for c, n in zip(sums, names)])
        return self.with_keys(found)

    def totals(self, views: list) -> DataFrame:
        """``binning.by_variant`` of the views' totals by value: (keys, tags, feature, value, level, n_rows, sw, swy).

        ``views`` are pairs of ``weigh(key, group)``, which gives (n, w, wy) of each of
        its variants, and the tags of these variants.
        """
        who, many = self.who, sum(len(tags) for _, tags in views)
        sums, feats, n_num = [f"_s{i}" for i in range(3 * many)], self.feats, len(self.numeric)
        weighers = [weigh for weigh, _ in views]

        def each(kid, g, values, texts, numbers, bm, am):
            counts = [np.nan_to_num(x) for weigh in weighers for v in weigh(who[kid], g) for x in v]
            for f, ((distinct, _), number) in enumerate(zip([*values, *texts], numbers)):
                size = len(distinct) + (f < n_num)  # nulls come after the numeric values
                added = [np.bincount(number, x, size) for x in counts]
                kept = np.flatnonzero(np.sum([added[i] > 0 for i in range(0, len(added), 3)], axis=0))
                if f < n_num:
                    value = pa.array(np.append(distinct, 0.0)[kept], mask=kept == len(distinct))
                    level = pa.nulls(len(kept), pa.string())
                else:
                    value = pa.nulls(len(kept), pa.float64())
                    level = pa.array([distinct[i] for i in kept], pa.string())
                yield [pa.array(np.full(len(kept), kid, dtype=np.int32)), pa.array(np.full(len(kept), f, dtype=np.int32)),
                       value, level, *[pa.array(x[kept]) for x in added]]

        schema = T.StructType([T.StructField("_kid", T.IntegerType()), T.StructField("_f", T.IntegerType()),
                               T.StructField("value", T.DoubleType()), T.StructField("level", T.StringType())]
                              + [T.StructField(c, T.DoubleType()) for c in sums])
        found = self.run(each, schema).groupBy("_kid", "_f", "value", "level").agg(*[F.sum(c).alias(c) for c in sums])
        tags = [t for _, ts in views for t in ts]
        per = F.explode(F.array(*[F.struct(
            *[F.lit(x).alias(k) for k, x in t.items()], F.col(sums[3 * i]).cast("bigint").alias("n_rows"),
            F.col(sums[3 * i + 1]).alias("sw"), F.col(sums[3 * i + 2]).alias("swy")) for i, t in enumerate(tags)])).alias("v")
        name = F.get(F.array(*[F.lit(f) for f in feats]), F.col("_f")).alias("feature")
        out = self.with_keys(found.select("_kid", name, "value", "level", per).select("_kid", "feature", "value", "level", "v.*"))
        return out.where("n_rows > 0").select(*self.keys, *tags[0], "feature", "value", "level", "n_rows", "sw", "swy")

    def cells(self, views: list, look: DataFrame) -> DataFrame:
        """(keys, tags, WOE columns, sw, swy) of the views under their own bins, ``look``; one row per design vector."""
        tags = [t for _, ts in views for t in ts]
        own = list(tags[0])
        cards = _cards(look, [*self.keys, *own], self.numeric, self.categorical)
        weighers, who, xs = [weigh for weigh, _ in views], self.who, [f"{f}__woe" for f in self.feats]
        places = [tuple(t[k] for k in own) for t in tags]

        def each(kid, g, values, texts, numbers, bm, am):
            counts = [v for weigh in weighers for v in weigh(who[kid], g)]
            for i, (_, w, wy) in enumerate(counts):
                card = cards.get((*who[kid], *places[i]))
                if card is None:
                    continue
                w, wy = np.nan_to_num(w), np.nan_to_num(wy)
                at = np.flatnonzero(w > 0)
                if not len(at):
                    continue
                full = len(at) == len(w)
                columns = [m[x if full else x[at]] for m, x in zip(card.coder.maps(values, texts), numbers)]
                got, added = binning.added_up(columns, card.coder.woes, [w, wy] if full else [w[at], wy[at]])
                yield [pa.array(np.full(len(added[0]), kid, dtype=np.int32)), pa.array(np.full(len(added[0]), i, dtype=np.int32)),
                       *[pa.array(x) for x in [*got, *added]]]

        schema = T.StructType([T.StructField("_kid", T.IntegerType()), T.StructField("_v", T.IntegerType())] + [
            T.StructField(c, T.DoubleType()) for c in [*xs, "sw", "swy"]])
        found = self.run(each, schema).groupBy("_kid", "_v", *xs).agg(F.sum("sw").alias("sw"), F.sum("swy").alias("swy"))
        named = small_table(self.fan.rows.sparkSession, [(*p, i) for i, p in enumerate(places)], T.StructType(
            [look.schema[k] for k in own] + [T.StructField("_v", T.IntegerType())]))
        return self.with_keys(found.join(named, "_v")).select(*self.keys, *own, *xs, "sw", "swy")
