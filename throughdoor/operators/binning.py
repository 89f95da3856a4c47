"""Weight-of-evidence binning, weight-aware and keyed.

Rows are reduced to totals per (feature, value) first, numeric values and
category levels in one aggregation, and everything later works on those. A row
may count in many variants (policies, methods, assumed multiples): each variant
is a few conditional sums of that one aggregation, and variants become rows only
afterwards. The greedy merge sees at most 3 * max_bins pre-bins per
(key, feature).
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BinRules
from ..runtime import localize, materialize, small_table
from .ordered import quantiles

MISSING_LEVEL = "__MISSING__"
OTHER_LEVEL = "__OTHER__"


@dataclass
class Variant:
    """One way to count a row: ``n`` times, with weight ``w`` and bad weight ``wy``.

    A row that is not part has 0 in all three. ``tags`` are the variant's own
    key columns, made of literals and of the rows' keys.
    """

    n: Column
    w: Column
    wy: Column
    tags: dict

    @classmethod
    def plain(cls, y: str, w: str) -> Variant:
        return cls(F.lit(1), F.col(w), F.col(w) * F.col(y), {})


def totals(rows: DataFrame, by, numeric, categorical, variants) -> DataFrame:
    """(by, feature, value, level) with the sums of every variant, from one scan.

    Equal sums of several variants are kept once.
    """
    nothing = {"value": F.lit(None).cast("double"), "level": F.lit(None).cast("string")}
    level = lambda f: F.coalesce(F.col(f).cast("string"), F.lit(MISSING_LEVEL))
    each = [{**nothing, "value": F.col(f).cast("double"), "feature": F.lit(f)} for f in numeric]
    each += [{**nothing, "level": level(f), "feature": F.lit(f)} for f in categorical]
    at = F.explode(F.array(*[F.struct(*[c[k].alias(k) for k in ("feature", "value", "level")]) for c in each]))
    sums, _ = _sums(variants)
    long = rows.select(*by, *[c.alias(k) for k, c in sums.items()], at.alias("at"))
    return long.groupBy(*by, *[F.col(f"at.{k}").alias(k) for k in ("feature", "value", "level")]).agg(
        *[F.sum(k).alias(k) for k in sums])


def _sums(variants) -> tuple[dict, list]:
    """Distinct summands by name, and each variant's three names."""
    names, sums, used = {}, {}, []
    for v in variants:
        mine = []
        for c in (v.n, v.w, v.wy):
            name = names.setdefault(str(c), f"_t{len(names)}")
            sums[name] = c.cast("double")
            mine.append(name)
        used.append(mine)
    return sums, used


def by_variant(found: DataFrame, keys, variants) -> DataFrame:
    """``totals`` with a row per variant that has rows there."""
    _, used = _sums(variants)
    each = F.explode(F.array(*[F.struct(
        *[c.alias(k) for k, c in v.tags.items()], F.col(n).cast("bigint").alias("n_rows"),
        F.col(w).alias("sw"), F.col(y).alias("swy")) for v, (n, w, y) in zip(variants, used)]))
    tags = list(variants[0].tags)
    rest = ["feature", "value", "level"]
    out = found.select(*[k for k in keys if k not in tags], *rest, each.alias("v"))
    return out.select(*[F.col(f"v.{k}") if k in tags else F.col(k) for k in keys], *rest,
                      "v.n_rows", "v.sw", "v.swy").where("n_rows > 0")


def counted(rows: DataFrame, keys, keep, variants) -> DataFrame:
    """Rows times the variants they count in: (keys, keep, w, wy). Never written."""
    tags = list(variants[0].tags)
    each = [F.struct(*[c.alias(k) for k, c in v.tags.items()], v.w.cast("double").alias("w"),
                     v.wy.cast("double").alias("wy")) for v in variants]
    own = [k for k in keys if k not in tags]
    if len(each) == 1:
        out = rows.select(*own, *keep, each[0].alias("v"))
    else:
        out = rows.select(*own, *keep, F.explode(F.array(*each)).alias("v"))
    return out.where("v.w > 0").select(
        *[F.col(f"v.{k}") if k in tags else F.col(k) for k in keys], *keep, "v.w", "v.wy")


def value_histogram(rows: DataFrame, keys, numeric, y: str, w: str) -> DataFrame:
    """(keys, feature, value) -> row count, weight and bad weight."""
    one = [Variant.plain(y, w)]
    return by_variant(totals(rows, keys, numeric, [], one), keys, one).drop("level")


def pre_bins(hist: DataFrame, keys, spec: BinRules) -> DataFrame:
    """Pre-bin totals between distinct quantile cuts; bin -1 holds the missing."""
    by = [*keys, "feature"]
    probs = [k * (1.0 / (3 * spec.most)) for k in range(1, 3 * spec.most)]
    cuts = quantiles(hist, by, "value", probs, rows="n_rows")
    cuts = localize(cuts.select(*by, F.array_distinct("q").alias("cuts")), "cuts")
    return to_bins(hist, cuts, by, len(probs))


def to_bins(hist: DataFrame, cuts: DataFrame, by, max_cuts: int) -> DataFrame:
    at = F.when(F.col("value").isNull(), F.lit(-1)).otherwise(bin_index("value", "cuts", max_cuts + 1))
    totals = hist.join(cuts, list(by), "left").withColumn("bin_no", at).groupBy(*by, "bin_no").agg(
        F.sum("sw").alias("sw"), F.sum("swy").alias("swy"))
    return totals.join(cuts, list(by), "left")


class _Ladder:
    """Adjacent bins of one feature; ``fuse(i)`` joins rung i with rung i + 1.

    Sums of fractional weights depend on row order in their last digits, so
    comparisons are made on shares and rates rounded to nine places: equal bins
    stay equal however the rows were partitioned.
    """

    def __init__(self, tops, weight, bad, total):
        self.tops, self.weight, self.bad, self.total = list(tops), list(weight), list(bad), total

    def __len__(self):
        return len(self.tops)

    def shares(self):
        return np.round(np.array(self.weight) / self.total, 9)

    def rates(self):
        return np.array(self.bad) / np.maximum(np.array(self.weight), 1e-12)

    def fuse(self, i):
        self.weight[i] += self.weight.pop(i + 1)
        self.bad[i] += self.bad.pop(i + 1)
        self.tops.pop(i)


def coarsen(tops, weight, bad, total: float, spec: BinRules) -> _Ladder:
    """Merge pre-bins: too-small ones first, then trend breaks, then to size."""
    ladder = _Ladder(tops, weight, bad, max(total, 1e-300))
    while len(ladder) > 2 and min(ladder.shares()) < spec.least_share:
        share = ladder.shares()
        i = int(np.argmin(share))
        left = share[i - 1] if i > 0 else np.inf
        right = share[i + 1] if i + 1 < len(ladder) else np.inf
        ladder.fuse(i - 1 if left <= right else i)
    if spec.one_way and len(ladder) > 2:
        rates = ladder.rates()
        place = np.arange(len(rates)) - (len(rates) - 1) / 2.0
        trend = np.sign(np.round(place @ rates, 9))  # sign of the correlation with the bin number
        for _ in range(100 if trend else 0):
            moves = np.round(np.diff(ladder.rates()) * trend, 9)
            if len(ladder) <= 2 or moves.min() >= 0:
                break
            ladder.fuse(int(np.argmin(moves)))
    while len(ladder) > spec.most:
        share = ladder.shares()
        ladder.fuse(int(np.argmin(np.round(share[:-1] + share[1:], 9))))
    return ladder


def numeric_bins(hist: DataFrame, keys, spec: BinRules) -> DataFrame:
    by = [*keys, "feature"]
    pre = pre_bins(hist, keys, spec)
    schema = T.StructType(
        [f for f in pre.schema.fields if f.name in by]
        + [T.StructField(n, t) for n, t in [
            ("bin_no", T.IntegerType()), ("lo", T.DoubleType()), ("hi", T.DoubleType()),
            ("is_missing", T.BooleanType()), ("n", T.DoubleType()), ("bad", T.DoubleType())]])

    def merge(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                who = [row[k] for k in by]
                at, sw, swy = row["at"], np.asarray(row["sw"]), np.asarray(row["swy"])
                seen = at >= 0
                if seen.any():
                    tops = [*row["cuts"], np.inf]
                    weight, bad = np.zeros(len(tops)), np.zeros(len(tops))
                    weight[at[seen]], bad[at[seen]] = sw[seen], swy[seen]
                    got = coarsen(tops, weight, bad, sw.sum(), spec)
                    bottoms = [np.nan, *got.tops[:-1]]
                    out += [(*who, i, a, np.nan if np.isinf(b) else b, False, n, m) for i, (a, b, n, m)
                            in enumerate(zip(bottoms, got.tops, got.weight, got.bad))]
                if not seen.all():
                    i = int(np.argmin(at))
                    out.append((*who, len(got.tops) if seen.any() else 0, np.nan, np.nan, True,
                                sw[i], swy[i]))
            yield pd.DataFrame(out, columns=schema.names)

    # one row per (keys, feature), holding at most 3 * max_bins + 1 pre-bins
    rungs = pre.groupBy(*by).agg(
        F.expr("array_sort(collect_list(struct(bin_no, sw, swy)))").alias("r"),
        F.max("cuts").alias("cuts"))
    rungs = rungs.select(*by, "cuts", F.expr("r.bin_no").alias("at"), F.expr("r.sw").alias("sw"),
                         F.expr("r.swy").alias("swy"))
    tasks = max(pre.sparkSession.sparkContext.defaultParallelism, 1)
    merged = rungs.repartition(tasks, *by).mapInPandas(merge, schema)
    sided = merged.select(
        *by, "bin_no", F.nanvl("lo", F.lit(None).cast("double")).alias("lo"),
        F.nanvl("hi", F.lit(None).cast("double")).alias("hi"), "is_missing", "n", "bad")
    return sided.select(
        *by, F.lit("numeric").alias("kind"), "bin_no",
        F.when(F.col("is_missing"), F.lit("MISSING")).otherwise(F.concat(
            F.lit("("), _short("lo", "-inf"), F.lit(", "), _short("hi", "inf"), F.lit("]"))
        ).alias("label"),
        "lo", "hi", F.lit(None).cast("string").alias("category"), "is_missing", "n", "bad")


def _short(edge: str, unbounded: str):
    """Edge as text with four significant digits."""
    c = F.col(edge)
    power = F.floor(F.log10(F.greatest(F.abs(c), F.lit(1e-9)))) - 3
    unit = F.pow(F.lit(10.0), power.cast("double"))
    text = F.regexp_replace((F.rint(c / unit) * unit).cast("decimal(24,9)").cast("string"),
                            r"\.?0+$", "")
    return F.when(c.isNull(), F.lit(unbounded)).when(c == 0, F.lit("0")).otherwise(text)


def category_bins(rows: DataFrame, keys, feature: str, y: str, w: str, spec: BinRules) -> DataFrame:
    """Levels with little weight pooled; nulls are a level of their own."""
    one = [Variant.plain(y, w)]
    return level_bins(materialize(by_variant(totals(rows, keys, [], [feature], one), keys, one), "levels"), keys, spec)


def level_bins(by_level: DataFrame, keys, spec: BinRules) -> DataFrame:
    """Bins of all categorical features from (keys, feature, level, sw, swy)."""
    by = [*keys, "feature"]
    total = localize(by_level.groupBy(*by).agg(F.sum("sw").alias("all_w")), "level-weight")
    rare = F.col("sw") / F.col("all_w") < F.lit(spec.rare_share)
    pooled = (by_level.join(total, by)
              .withColumn("level", F.when(rare, F.lit(OTHER_LEVEL)).otherwise(F.col("level")))
              .groupBy(*by, "level").agg(F.sum("sw").alias("n"), F.sum("swy").alias("bad")))
    # every kept level holds rare_share of the weight, so this window is short
    order = Window.partitionBy(*by).orderBy("level")
    return pooled.select(
        *by, F.lit("categorical").alias("kind"),
        (F.row_number().over(order) - 1).cast("int").alias("bin_no"), F.col("level").alias("label"),
        F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
        F.col("level").alias("category"), F.lit(False).alias("is_missing"), "n", "bad")


def weigh(bins: DataFrame, keys, spec: BinRules) -> DataFrame:
    """Bad rate, smoothed WOE and IV of each bin; the missing bin takes part."""
    of = Window.partitionBy(*keys, "feature")
    bad, good = F.col("bad") + spec.pseudo_count, F.col("good") + spec.pseudo_count
    pb, pg = bad / F.sum(bad).over(of), good / F.sum(good).over(of)
    out = bins.withColumn("good", F.col("n") - F.col("bad"))
    out = out.withColumn("_pb", pb).withColumn("_pg", pg)
    lone = F.col("is_missing") & (F.count(F.lit(1)).over(of) == 1)
    woe = F.when(lone, F.lit(0.0)).otherwise(F.ln(F.col("_pg") / F.col("_pb")))
    return (out.withColumn("bad_rate", F.col("bad") / F.greatest(F.col("n"), F.lit(1e-12)))
            .withColumn("woe", woe)
            .withColumn("iv", (F.col("_pg") - F.col("_pb")) * F.col("woe"))
            .drop("_pb", "_pg"))


def fit_bins(rows: DataFrame, keys, numeric, categorical, y: str = "bad", w: str = "w",
             spec: BinRules = BinRules()) -> DataFrame:
    """The bins table: one row per (keys, feature, bin)."""
    return variant_bins(rows, keys, keys, numeric, categorical, [Variant.plain(y, w)], spec)


def variant_bins(rows: DataFrame, by, keys, numeric, categorical, variants, spec: BinRules = BinRules(),
                 only: DataFrame | None = None) -> DataFrame:
    """The bins tables of all variants, from one scan of ``rows``.

    ``by`` are key columns of the rows, ``keys`` those of the result: some of
    ``by`` and the variants' tags. ``only`` has the key values to fit.
    """
    each = by_variant(totals(rows, by, numeric, categorical, variants), keys, variants)
    if only is not None:
        each = each.join(only, only.columns, "left_semi")
    return bins_of(each, keys, numeric, categorical, spec)


def bins_of(each: DataFrame, keys, numeric, categorical, spec: BinRules = BinRules()) -> DataFrame:
    """The bins tables from totals by value (keys, feature, value, level, n_rows, sw, swy)."""
    each = materialize(each, "totals")
    parts = []
    if numeric:
        parts.append(numeric_bins(each.where(F.col("feature").isin(*numeric)).drop("level"), keys, spec))
    if categorical:
        parts.append(level_bins(each.where(F.col("feature").isin(*categorical)), keys, spec))
    bins = parts[0]
    for p in parts[1:]:
        bins = bins.unionByName(p)
    return materialize(weigh(bins, keys, spec), "bins")


def iv_table(bins: DataFrame, keys) -> DataFrame:
    return bins.groupBy(*keys, "feature").agg(
        F.sum("iv").alias("iv"), F.count(F.lit(1)).alias("n_bins"))


def lookup_row(bins: DataFrame, keys, numeric, categorical) -> DataFrame:
    """All bins of a key in one row: edges and WOE arrays, level maps."""
    cols = []
    for f in numeric:
        mine = (F.col("feature") == f) & ~F.col("is_missing")
        cols += [
            F.array_sort(F.collect_list(F.when(mine, F.col("hi")))).alias(f"{f}__edges"),
            F.transform(F.array_sort(F.collect_list(F.when(mine, F.struct("bin_no", "woe")))),
                        lambda s: s["woe"]).alias(f"{f}__woes"),
            F.max(F.when((F.col("feature") == f) & F.col("is_missing"), F.col("woe"))
                  ).alias(f"{f}__gap"),
        ]
    for f in categorical:
        cols.append(F.map_from_entries(F.collect_list(
            F.when(F.col("feature") == f, F.struct("category", "woe")))).alias(f"{f}__levels"))
    return bins.groupBy(*keys).agg(*cols)


def bin_index(value: str, edges: str, max_bins: int):
    """Number of edges below ``value``: bins are (lo, hi]. Both are column names."""
    return F.expr(" + ".join(
        f"coalesce(int(`{value}` > get(`{edges}`, {i})), 0)" for i in range(max_bins - 1)))


def woe_columns(numeric, categorical, max_bins: int, suffix: str = "__woe"):
    """WOE of each feature, for rows joined with their ``lookup_row``."""
    out = []
    for f in numeric:
        at = bin_index(f, f"{f}__edges", max_bins)
        seen = F.coalesce(F.get(f"{f}__woes", at), F.lit(0.0))
        gap = F.coalesce(F.col(f"{f}__gap"), F.lit(0.0))
        out.append(F.when(F.col(f).isNull(), gap).otherwise(seen).alias(f + suffix))
    for f in categorical:
        levels = F.col(f"{f}__levels")
        level = F.coalesce(F.col(f).cast("string"), F.lit(MISSING_LEVEL))
        out.append(F.coalesce(F.try_element_at(levels, level),
                              F.try_element_at(levels, F.lit(OTHER_LEVEL)),
                              F.lit(0.0)).alias(f + suffix))
    return out


def encode(rows: DataFrame, bins: DataFrame, keys, numeric, categorical, max_bins: int = 8):
    """Rows with one ``<feature>__woe`` column per feature."""
    one = localize(lookup_row(bins, keys, numeric, categorical), "lookup")
    return rows.join(one, list(keys)).select(
        *[rows[c] for c in rows.columns], *woe_columns(numeric, categorical, max_bins))


# --- equal design vectors, counted in numpy on Arrow batches --------------------
HELD_ROWS = 1_000_000  # coded rows a task holds before it adds them up
CODES = 2**62
BLOCK_ROWS = 50_000  # rows a task decodes at once
DENSE = 16  # possible codes a row up to which all are counted


class _Coder:
    """Bins of one key: codes of design vectors, and their WOEs."""

    def __init__(self, kid, row, numeric, categorical):
        self.kid, self.edges, self.levels, self.woes = kid, [], [], []
        for f in numeric:
            woes = [0.0 if x is None else x for x in row[f"{f}__woes"] or []]
            edges = np.asarray(row[f"{f}__edges"] or [], dtype=float)
            woes += [0.0] * (len(edges) + 1 - len(woes))
            self.edges.append(edges)
            self.woes.append(np.array([*woes[:len(edges) + 1], row[f"{f}__gap"] or 0.0]))  # the last one is for nulls
        for f in categorical:
            levels = dict(row[f"{f}__levels"] or {})
            self.levels.append({x: i for i, x in enumerate(levels)})
            self.woes.append(np.array([*[x or 0.0 for x in levels.values()], levels.get(OTHER_LEVEL) or 0.0]))
        self.sizes = [len(x) for x in self.woes]

    def maps(self, values, texts):
        """Bin number of each distinct value, a feature at a time; the last one of a numeric feature is for nulls."""
        out = [np.append(np.searchsorted(edges, distinct, side="left"), len(edges) + 1)
               for edges, (distinct, _) in zip(self.edges, values)]
        return out + [np.array([levels.get(x, len(levels)) for x in names], dtype=np.int64)
                      for levels, (names, _) in zip(self.levels, texts)]

    def codes(self, values, texts, at):
        """A column of bin numbers per feature for the rows ``at``."""
        return [m[number[at]] for m, (_, number) in zip(self.maps(values, texts), [*values, *texts])]


def blocks(batches, rows: int):
    """Batches joined to tables of at least ``rows`` rows, but for the last."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def distinct_values(column):
    """Distinct values of a numeric column and each row's number among them, nulls last."""
    column = column.combine_chunks()
    gone = pc.is_null(column).to_numpy(zero_copy_only=False)
    distinct, number = np.unique(column.fill_null(0.0).to_numpy(zero_copy_only=False)[~gone], return_inverse=True)
    out = np.full(len(gone), len(distinct), dtype=np.int64)
    out[~gone] = number.reshape(-1)
    return distinct, out


def distinct_texts(column):
    d = column.combine_chunks().dictionary_encode()
    return d.dictionary.to_pylist(), d.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _added(coder, held):
    """Distinct design vectors of the held rows with their sums."""
    columns = [np.concatenate(x) for x in zip(*[h[0] for h in held])]
    weights = [np.concatenate(x) for x in zip(*[h[1] for h in held])]
    return added_up(columns, coder.woes, weights)


def added_up(columns, woes, weights):
    """WOEs of the distinct vectors of bin numbers, and each weight's sum over their rows."""
    sizes = [len(x) for x in woes]
    space = int(np.prod(np.array(sizes, dtype=object)))
    if space < CODES:
        code = np.zeros(len(weights[0]), dtype=np.int64)
        for size, c in zip(sizes, columns):
            code = code * size + c
        if space <= DENSE * len(code):  # few possible codes: count them all, without a sort
            found = np.flatnonzero(np.bincount(code, minlength=space))
            return ([x[i] for x, i in zip(woes, np.unravel_index(found, sizes))],
                    [np.bincount(code, w, space)[found] for w in weights])
        _, first, group = np.unique(code, return_index=True, return_inverse=True)
    else:
        _, first, group = np.unique(np.stack(columns, axis=1), axis=0, return_index=True, return_inverse=True)
    group = group.reshape(-1)
    return [x[c[first]] for x, c in zip(woes, columns)], [np.bincount(group, w, len(first)) for w in weights]


def groups_of(batch, names):
    """(values, row numbers) of the rows with equal values in the columns ``names``."""
    n, code = batch.num_rows, np.zeros(batch.num_rows, dtype=np.int64)
    for c in names:
        column = batch.column(c)
        d = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode()
        number = d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        _, code = np.unique(code * (len(d.dictionary) + 1) + number, return_inverse=True)
        code = code.reshape(-1)
    order = np.argsort(code, kind="stable")
    cuts = np.flatnonzero(np.diff(code[order])) + 1 if n else []
    for at in np.split(order, cuts):
        yield tuple(batch.column(c)[int(at[0])].as_py() for c in names), at


def designs(rows: DataFrame, keys, look: DataFrame, numeric, categorical, variants, of=F.col, more=None) -> DataFrame:
    """Rows times variants as (keys, WOE columns, sw, swy, more), one row per design vector.

    ``of`` gives a feature's column of the rows; ``more`` are further sums by
    name, the same for all variants.

    ``look`` has the ``lookup_row`` of every key. Keys that neither the rows nor
    the variants have fan out; columns of ``look`` besides the keys that are
    columns of the rows, too, are joined on. Rows are coded and added up in
    tasks, so neither the fan-out nor the variants are shuffled.
    """
    keys, numeric, categorical = list(keys), list(numeric), list(categorical)
    feats, tags, more = numeric + categorical, list(variants[0].tags), more or {}
    on = tags + [c for c in look.columns if c in rows.columns and c not in tags and c not in feats]
    names, cols, used = {}, [], []

    def sent(c, kind=None):
        at = (str(c), kind)
        if at not in names:
            names[at] = f"_c{len(names)}"
            cols.append((c.cast(kind) if kind else c).alias(names[at]))
        return names[at]

    for v in variants:
        used.append(([sent(v.tags[k]) if k in tags else sent(F.col(k)) for k in on], [
            sent(c, "double") for c in (v.w, v.wy, *more.values())]))
    numbers = [sent(of(f), "double") for f in numeric]
    words = [sent(F.coalesce(of(f).cast("string"), F.lit(MISSING_LEVEL))) for f in categorical]
    coders, found = [], {}
    known = look.select(*keys, *[c for c in on if c not in keys], *[
        c for c in look.columns if "__" in c]).collect()
    for i, row in enumerate(known):
        coders.append(_Coder(i, row, numeric, categorical))
        found.setdefault(tuple(row[k] for k in on), []).append(i)
    held_rows, block_rows, xs, sums = HELD_ROWS, BLOCK_ROWS, [f"{f}__woe" for f in feats], ["sw", "swy", *more]

    def matched(batch, key_columns):
        """(coders, row numbers) of every key in the batch."""
        for who, at in groups_of(batch, key_columns):
            if None not in who and who in found:
                yield found[who], at

    def collapse(batches):
        held, size = {}, 0

        def flush():
            for kid, parts in held.items():
                got, weights = _added(coders[kid], parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(weights[0]), kid, dtype=np.int32)), *[pa.array(x) for x in [*got, *weights]]],
                    names=["_kid", *xs, *sums])

        for batch in blocks(batches, block_rows):
            plain = lambda c: batch.column(c).fill_null(0.0).to_numpy()
            values = [distinct_values(batch.column(c)) for c in numbers]
            texts = [distinct_texts(batch.column(c)) for c in words]
            groups = {}
            for key_columns, weight_columns in used:
                if (mine := tuple(key_columns)) not in groups:
                    groups[mine] = list(matched(batch, key_columns))
                weights = [plain(c) for c in weight_columns]
                counts = ~(weights[0] <= 0)
                for kids, at in groups[mine]:
                    at = at[counts[at]]
                    if not len(at):
                        continue
                    for kid in kids:
                        held.setdefault(kid, []).append((coders[kid].codes(values, texts, at), [w[at] for w in weights]))
                        size += len(at)
                if size >= held_rows:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    schema = T.StructType([T.StructField("_kid", T.IntegerType())] + [
        T.StructField(c, T.DoubleType()) for c in [*xs, *sums]])
    found_cells = rows.select(*cols).mapInArrow(collapse, schema).groupBy("_kid", *xs).agg(*[F.sum(c).alias(c) for c in sums])
    ids = small_table(rows.sparkSession, [(*[row[k] for k in keys], i) for i, row in enumerate(known)],
                      T.StructType([look.schema[k] for k in keys] + [T.StructField("_kid", T.IntegerType())]))
    return found_cells.join(ids, "_kid").select(*keys, *xs, *sums)
