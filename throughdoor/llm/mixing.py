"""Mixing sources to target sizes with Pareto order sampling.

A source's target becomes expected copies of its documents: proportional to a
document weight that grows with the logarithm of the size, never above
``most``. Whole copies are certain. What is left of the expectation is a
document's inclusion probability, and documents are taken in the order of their
random odds divided by their inclusion odds. One that exceeds the words still
missing is passed over, and the order goes on until nothing fits. If words are
missing then, the order is gone through again for one more copy, up to ``most``.

The order is never sorted as a whole: words are summed by slices of the order,
the slice that crosses the target is cut again, and only its rows are ranked.
What ends a run is passed over, and the next run starts behind it with what is
missing then, among the documents that fit. What a document gets follows from
a row per source and weight class and its source's runs, so texts are not
shuffled; only for doc_ids that repeat is the sum of their rows joined.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from throughdoor.llm.stored import Shelf

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Settings:
    weights: tuple = (5, 2, 1)  # of the sources by code point, null last, repeating
    share: float = 1.5  # of all words that the mix holds
    most: int = 2  # copies of a document, and of a source's words
    salt: str = "mix"


def size(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def weight_class(words: Column) -> Column:
    """1 for one word, one more for each doubling; the weight of a document."""
    return F.length(F.bin(words))


def draw(key: Column, salt: str) -> Column:
    """Uniform in (0, 1), the same for a key in every run and on every machine."""
    text = F.md5(F.concat(F.lit(salt + ":"), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(text, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sized: DataFrame, use: Settings) -> DataFrame:
    """(source, source_size, target): shares by weight, none above ``most`` times its size.

    Sources in ascending order of what a unit of weight could take at most; the
    level at which all shares add up is the largest one that stays below the
    limit of the first source it does not fill.
    """
    w, full = F.col("w"), F.col("full")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in use.weights]), place % len(use.weights) + 1)
    limits = by_source.select("source", "source_size", weight.alias("w"), (F.col("source_size") * use.most).alias("full"))
    order = Window.orderBy(full / w, "w", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum(full).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(w).over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    level = (total * use.share - before) / rest
    tried = limits.withColumn("level", level)
    level = F.max(F.when(F.col("level") * w <= full, F.col("level"))).over(everything)
    return tried.withColumn("level", level).select(
        "source", "source_size", F.least(full.cast("double"), F.coalesce(F.col("level") * w, full)).alias("target"))


def expectations(sized: DataFrame, goals: DataFrame, use: Settings) -> DataFrame:
    """Per source and weight class: certain copies, inclusion probability, words missing."""
    klass, words = F.col("klass"), F.col("words")
    by_class = (sized.where("size > 0").groupBy("source", weight_class(F.col("size")).alias("klass"))
                .agg(F.sum("size").alias("words")))
    table = by_class.join(goals.withColumnRenamed("source", "goal_source"),
                          F.col("source").eqNullSafe(F.col("goal_source")))
    order = Window.partitionBy("source").orderBy(klass.desc())
    above = F.coalesce(F.sum(words).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * use.most
    rest = F.sum(klass * words).over(order.rowsBetween(0, Window.unboundedFollowing))
    table = table.withColumn("rate", (F.col("target") - above) / rest)
    source = Window.partitionBy("source")
    rate = F.coalesce(F.max(F.when(F.col("rate") * klass <= use.most, F.col("rate"))).over(source),
                      F.lit(float(use.most)) / F.min(klass).over(source))
    table = table.withColumn("copies", F.least(F.lit(float(use.most)), rate * klass))
    certain = F.floor(F.col("copies") + 1e-9)
    table = table.withColumn("certain", certain).withColumn(
        "chance", F.greatest(F.lit(0.0), F.col("copies") - F.col("certain")))
    missing = F.col("target") - F.sum(F.col("certain") * words).over(source)
    return table.select("source", "klass", "certain", "chance", missing.alias("missing"))


def ranked(rows: DataFrame, use: Settings) -> DataFrame:
    """``rows`` with ``rank_key``: random odds over inclusion odds; null where no chance."""
    u, chance = draw(F.col("doc_id"), use.salt), F.col("chance")
    odds = (u / (1 - u)) / (chance / (1 - chance))
    return rows.withColumn("rank_key", F.when((chance > 0) & (F.col("size") > 0), odds))


SLICES = 4096


def grouped(rows: DataFrame) -> DataFrame:
    """What the order holds: (source, rank_key, doc_id, size, members, certain, missing).

    Rows of one doc_id and rank are taken together; ``size`` is their sum.
    """
    return rows.where("rank_key IS NOT NULL").groupBy("source", "rank_key", "doc_id").agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("members"), F.first("certain").alias("certain"),
        F.first("missing").alias("missing"))


def cutoffs(rows: DataFrame) -> DataFrame:
    """Per source, where its run ends: (source, high, inclusive, gap).

    ``rows``: source, doc_id, size, rank_key, missing, one row per rank_key and
    doc_id. They are taken in order until the next one no longer fits into what
    is missing; ``gap`` is what then still is.
    """
    at = F.col("rank_key") / (1 + F.col("rank_key")) * SLICES
    coarse = F.floor(at).cast("int")
    fine = F.floor((at - F.floor(at)) * SLICES).cast("int")
    part = rows.select(
        "source", "doc_id", "size", "rank_key", "missing", coarse.alias("coarse"), fine.alias("fine"),
        F.lit(0).cast("long").alias("base"))
    for name in ("coarse", "fine"):
        order = Window.partitionBy("source").orderBy(name)
        sums = part.groupBy("source", name).agg(
            F.sum("size").alias("n"), F.first("missing").alias("missing"), F.first("base").alias("base"))
        upto = F.col("base") + F.sum("n").over(order)
        sums = sums.select("source", F.col(name).alias("cut"), (upto - F.col("n")).alias("before"), upto.alias("upto"),
                           "missing")
        # the slice that reaches what is missing, or the last one
        cut = sums.withColumn("last", F.max("cut").over(Window.partitionBy("source"))).where(
            "(before < missing AND missing <= upto) OR (cut = last AND upto < missing)")
        cut = cut.select(F.col("source").alias("cut_source"), "cut", "before")
        part = part.join(cut, F.col("source").eqNullSafe(F.col("cut_source")) & (F.col(name) == F.col("cut"))).select(
            "source", "doc_id", "size", "rank_key", "missing", "fine", F.col("before").alias("base"))
    order = Window.partitionBy("source").orderBy("rank_key", F.col("doc_id").asc_nulls_first())
    upto = F.col("base") + F.sum("size").over(order)
    # half a word allows for the rounding of the target
    picked = part.withColumn("upto", upto).withColumn("taken", F.col("upto") <= F.col("missing") + 0.5)
    key = F.struct("rank_key", "doc_id")
    last = picked.groupBy("source").agg(
        F.max(F.when(F.col("taken"), key)).alias("yes"), F.min(key).alias("first"), F.first("missing").alias("missing"),
        F.coalesce(F.max(F.when(F.col("taken"), F.col("upto"))), F.min(F.col("base"))).alias("sum"))
    # where the slice has no taken row, everything before its first row is taken
    return last.select("source", F.coalesce("yes", "first").alias("high"), F.col("yes").isNotNull().alias("inclusive"),
                       (F.col("missing") - F.col("sum")).alias("gap"))


def key_of(rows: DataFrame) -> Column:
    return F.struct(rows["rank_key"].alias("rank_key"), rows["doc_id"].alias("doc_id"))  # a null doc_id is the first


def runs_of(shelf: Shelf, groups: DataFrame, use: Settings) -> DataFrame:
    """(source, runs): the parts of the order that are taken, until nothing more fits.

    A run takes what lies above ``low`` and not above ``high`` and has at most
    ``most`` words; those of turn 1 and on give copies on top of turn 0's. A
    turn's run leaves less missing than the document that ended it needs, so
    that one does not come up again.
    """
    state = shelf.put(groups.groupBy("source").agg(F.first("missing").alias("gap")), "gaps")
    runs = None
    for turn in range(use.most):
        low = state.select(F.col("source").alias("s"), "gap", F.lit(None).cast(groups.select(key_of(groups)).schema[0].dataType).alias("low"))
        while True:
            open_ = groups.drop("missing").join(low, groups["source"].eqNullSafe(low["s"])).where(
                (F.col("size") <= F.col("gap") + 0.5) & (F.col("certain") + turn < use.most)
                & (F.col("low").isNull() | (key_of(groups) > F.col("low")))).withColumnRenamed("gap", "missing")
            found = shelf.put(cutoffs(open_).withColumnRenamed("source", "f_source").withColumnRenamed("gap", "left"), "cutoffs")
            if found.isEmpty():
                break
            both = low.join(found, low["s"].eqNullSafe(found["f_source"]))
            run = F.struct(F.lit(turn).alias("turn"), "low", "high", "inclusive", (F.col("gap") + 0.5).alias("most"))
            now = shelf.put(both.select(F.col("s").alias("source"), run.alias("run"), F.col("left").alias("gap")), "run")
            runs = now.select("source", "run") if runs is None else runs.union(now.select("source", "run"))
            low = now.select(F.col("source").alias("s"), "gap", F.col("run.high").alias("low"))
            state = state.join(now.select(F.col("source").alias("n_source"), F.col("gap").alias("left")),
                               F.col("source").eqNullSafe(F.col("n_source")), "left").select(
                "source", F.coalesce("left", "gap").alias("gap"))
            state = shelf.put(state, "gaps")
    if runs is None:
        runs = cutoffs(groups.limit(0)).select("source", F.struct(
            F.lit(0).alias("turn"), F.lit(None).cast("struct<rank_key:double,doc_id:bigint>").alias("low"), "high", "inclusive",
            F.lit(0.0).alias("most")).alias("run"))
    return shelf.put(runs.groupBy("source").agg(F.collect_list("run").alias("runs")), "runs")


def with_runs(rows: DataFrame, runs: DataFrame, repeats: DataFrame, use: Settings) -> DataFrame:
    """``rows`` with ``extra``: the runs that take a row's group. ``repeats``: groups of several rows."""
    many = repeats.select(F.col("source").alias("m_source"), F.col("rank_key").alias("m_key"), F.col("doc_id").alias("m_id"),
                          F.col("size").alias("group_size"))
    rows = rows.join(many, rows["source"].eqNullSafe(many["m_source"]) & (rows["rank_key"] == many["m_key"])
                     & rows["doc_id"].eqNullSafe(many["m_id"]), "left").drop("m_source", "m_key", "m_id")
    own = runs.withColumnRenamed("source", "r_source")
    joined = rows.join(own, rows["source"].eqNullSafe(own["r_source"]), "left")
    key = F.struct(F.col("rank_key"), F.col("doc_id"))
    n = F.coalesce("group_size", "size")
    taken = F.filter("runs", lambda r: (r["low"].isNull() | (key > r["low"]))
                     & ((key < r["high"]) | (r["inclusive"] & (key == r["high"])))
                     & (n <= r["most"]) & (F.col("certain") + r["turn"] < use.most))
    extra = F.when(F.col("rank_key").isNotNull() & F.col("runs").isNotNull(), F.size(taken)).otherwise(0)
    return joined.withColumn("extra", extra).drop("r_source", "runs", "group_size")


def plan(shelf: Shelf, sized: DataFrame, use: Settings) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Targets, expectations by class, runs and repeated groups, each a written table."""
    goals = shelf.put(targets(sized, use), "targets")
    expected = shelf.put(expectations(sized, goals, use), "expected")
    groups = shelf.put(grouped(with_chance(sized, expected, use)), "groups")
    runs = runs_of(shelf, groups, use)
    repeats = shelf.put(groups.where("members > 1").select("source", "rank_key", "doc_id", "size"), "repeats")
    shelf.clear(groups)
    return goals, expected, runs, repeats


def with_chance(rows: DataFrame, expected: DataFrame, use: Settings) -> DataFrame:
    table = expected.select(F.col("source").alias("e_source"), "klass", "certain", "chance", "missing")
    same = rows["source"].eqNullSafe(table["e_source"]) & (weight_class(rows["size"]) == table["klass"])
    joined = rows.join(table, same, "left").drop("e_source", "klass")
    return ranked(joined, use)


def with_copies(rows: DataFrame, expected: DataFrame, runs: DataFrame, repeats: DataFrame, use: Settings) -> DataFrame:
    """``rows`` (doc_id, source, size, ...) with ``copies``; empty texts get none."""
    joined = with_runs(with_chance(rows, expected, use), runs, repeats, use)
    copies = (F.coalesce(F.col("certain"), F.lit(0)) + F.col("extra")).cast("int")
    return joined.withColumn("copies", copies).drop("certain", "chance", "missing", "rank_key", "extra")


def mixed(docs: DataFrame, use: Settings = Settings()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken per row of ``docs``.

    ``docs``: doc_id, source, text. A null source is a source of its own, the
    last one. Null texts and texts without words have size 0 and are not taken.
    Rows that share a doc_id share their draw. A source's words taken stay
    below its target by less than the smallest document that could be taken
    once more.
    """
    shelf = Shelf(docs.sparkSession, "mixing")
    sized = shelf.put(docs.select("doc_id", "source", size(docs["text"]).alias("size")), "sizes")
    goals, expected, runs, repeats = plan(shelf, sized, use)
    goals = goals.withColumnRenamed("source", "g_source")
    rows = with_copies(sized, expected, runs, repeats, use)
    rows = rows.join(goals, rows["source"].eqNullSafe(goals["g_source"]), "left")
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies",
                       (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def repeated(docs: DataFrame, use: Settings = Settings()) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, same columns."""
    shelf = Shelf(docs.sparkSession, "mixing")
    sized = shelf.put(docs.select("doc_id", "source", size(docs["text"]).alias("size")), "sizes")
    _, expected, runs, repeats = plan(shelf, sized, use)
    names = docs.columns
    own = docs.select("doc_id", "source", size(docs["text"]).alias("size"), F.struct(*[docs[c] for c in names]).alias("row"))
    rows = with_copies(own, expected, runs, repeats, use).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        *[F.col("row")[c].alias(c) for c in names])
