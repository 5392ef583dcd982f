"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Targets: sources in code point order (null last) have the weights 5, 2, 1, 5, ...
and share the words of all sources; none may exceed ``max_repeat`` times its own
words, and what it can't take is shared again by weight among the others.  The
level is found by a few aggregations over the table of sources; only scalars
reach the driver.

Sampling: a source whose target is r times its words first gives every document
floor(r) certain whole copies.  The rest of the target is drawn by Pareto order
sampling: a document's inclusion probability is proportional to a power of its
size, ``u / (1 - u)`` with a uniform u from its id is divided by its inclusion
odds, and the documents with the smallest quotients are taken as long as their
words stay within the rest; the one document behind them whose size fills what is
left best closes the sample.  Documents whose probability reaches one come first.

The cut is found without sorting a source in one task: quotients are mapped to
(0, 1) and parted into 4096 bins per source, whose words are summed before the
shuffle; only the bin in which the rest is reached is parted again, and so on
until single ranks remain.

Defined results: null texts have size 0 and are taken 0 words; rows of equal id (or
none), source and size are numbered from 0 and drawn one by one, each with a rank of its
own from id, source, size and number; which of them has which number is open, so a
rerun takes as many of them; an empty table gives an empty result; only id, source and
text are read.  Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shroud.llm.common import WORD, columns, cut

WEIGHTS = (5, 2, 1)
BINS = 4096
LEVELS = 3
RANGES = 32


def size_of(text_col: str) -> Column:
    """Words of the text; null: 0."""
    return F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")


def sizes(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    rows = columns(docs, doc_id=id_col, source=source_col, text=text_col)
    return rows.select("doc_id", "source", size_of("text").alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: float = 3.0) -> DataFrame:
    """``source, source_size, target`` for each source."""
    sums = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    # rank by code point: ranges in order, counted, then numbered within
    by = [F.col("source").asc_nulls_last()]
    ranged = cut(sums.repartitionByRange(RANGES, *by).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over RANGES rows
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    firsts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.col("first") + F.row_number().over(Window.partitionBy("part").orderBy(*by)) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    ranked = cut(ranged.join(firsts, "part").withColumn("place", place).select("source", "source_size", weight.cast("double").alias("weight")))
    cap, level = F.col("source_size") * F.lit(max_repeat), 0.0
    total = float(ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    while True:  # words per unit of weight among the sources below their cap
        free = F.col("weight") * F.lit(level) < cap
        taken, open_weight = ranked.agg(F.sum(F.when(~free, cap).otherwise(0.0)), F.sum(F.when(free, F.col("weight")).otherwise(0.0))).first()
        risen = (total - (taken or 0.0)) / open_weight if open_weight else level
        if risen <= level * (1 + 1e-12):
            break
        level = risen
    return ranked.select("source", "source_size", F.least(cap, F.col("weight") * F.lit(level)).alias("target"))


def _uniform(*cols: Column) -> Column:
    """In (0, 1), from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit("pareto"), *cols), 12) + F.lit(0.5)) / F.lit(float(1 << 52))


def numbered(rows: DataFrame, by: tuple[str, ...], name: str = "occurrence") -> DataFrame:
    """``name``: a number from 0 for the rows of equal ``by`` (nulls are equal).

    The rows must be a table or a checkpoint: a task's number has to mean the same rows
    to every reader.  Counts by task and rows within one: no group meets in one task.
    """
    placed = rows.withColumn("__task", F.spark_partition_id())
    upto = Window.partitionBy(*by).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*by, "__task").agg(F.count("*").alias("__n"))
    firsts = counts.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(by)), F.col("__task").alias("__t"), F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__first"))
    within = placed.withColumn("__at", F.row_number().over(Window.partitionBy(*by, "__task").orderBy(F.lit(0))) - 1)
    same = F.col("__task") == F.col("__t")
    for i, c in enumerate(by):
        same = same & within[c].eqNullSafe(F.col(f"__{i}"))
    joined = within.join(firsts, same)
    return joined.select(*(within[c] for c in rows.columns), (F.col("__first") + F.col("__at")).cast("long").alias(name))


def _same_source(frame: DataFrame, others: DataFrame, also: tuple[str, ...] = ()) -> Column:
    on = frame["source"].eqNullSafe(others["source"])
    for c in also:
        on = on & (frame[c] == others[c])
    return on


def _inclusion(sized: DataFrame, wanted: DataFrame, size_power: float) -> DataFrame:
    """``source, scale``: inclusion is ``least(1, scale * size ** size_power)``, with the
    expected words of a source equal to its ``rest`` over size classes an eighth of
    a doubling wide (at most some 400 of them)."""
    step = F.floor(F.log2("size") * 8)
    classes = sized.where("size > 0").groupBy("source", step.alias("step")).agg(F.sum("size").cast("double").alias("words"), F.sum(F.col("size") * F.pow("size", F.lit(size_power))).alias("moment"))
    classes = classes.join(wanted.select("source", "rest").where("rest > 0").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # if the classes above one are certain, the scale follows from the rest of the words
    above = Window.partitionBy("source").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source")
    certain = F.coalesce(F.sum("words").over(above), F.lit(0.0))
    moments = F.sum("moment").over(whole) - F.coalesce(F.sum("moment").over(above), F.lit(0.0))
    scaled = classes.select("source", ((F.col("rest") - certain) / moments).alias("scale"), F.pow(F.lit(2.0), F.col("step") / 8 * size_power).alias("top"))
    fits = F.when((F.col("scale") > 0) & (F.col("scale") * F.col("top") <= 1), F.col("scale"))
    return scaled.groupBy("source").agg(F.coalesce(F.max(fits), F.max("scale")).alias("scale"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, max_repeat: float = 3.0, size_power: float = 0.5) -> DataFrame:
    """``doc_id, source, size, occurrence, source_size, target, copies, taken`` for every row."""
    sized = cut(numbered(cut(sizes(docs, id_col, source_col, text_col)), ("doc_id", "source", "size")))
    goals = targets(sized, weights, max_repeat)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goals = goals.withColumn("whole", F.least(F.floor(ratio + 1e-9), F.lit(int(max_repeat))).cast("long"))
    goals = cut(goals.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))))
    scales = _inclusion(sized, goals, size_power).withColumnRenamed("source", "s")
    goals = cut(goals.join(scales, goals["source"].eqNullSafe(scales["s"]), "left").drop("s"))
    # goals has a row per source: joined on (source, salt), for a source may hold a third of all rows
    salts = 16
    spread = goals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size", "occurrence"), F.lit(salts)).cast("int"))
    rows = salted.join(spread, _same_source(salted, spread, ("salt",)), "left").select(salted["doc_id"], salted["source"], "size", "occurrence", "source_size", "target", "whole", "rest", "scale")
    p = F.least(F.lit(1.0), F.coalesce(F.col("scale"), F.lit(0.0)) * F.pow("size", F.lit(size_power)))
    u = _uniform(F.col("doc_id"), F.col("size"), F.col("source"), F.col("occurrence"))
    # xi = (u / (1 - u)) / (p / (1 - p)); xi / (1 + xi) keeps its order within (0, 1)
    rank = F.when(p > 0, u * (1 - p) / (u * (1 - p) + (1 - u) * p)).otherwise(1.0)
    # certain documents (p = 1) keep the order of u among themselves, before all others
    ranked = cut(rows.withColumn("rank", F.when(p >= 1, u / 2).otherwise(0.5 + rank / 2)).withColumn("extra", F.when((F.col("rest") > 0) & (F.col("size") > 0), F.lit(None)).otherwise(F.lit(False))))
    cuts = _cuts(ranked)
    spread = cuts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumnRenamed("source", "s").withColumnRenamed("salt", "t")
    salted = ranked.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size", "occurrence"), F.lit(salts)).cast("int"))
    joined = salted.join(spread, salted["source"].eqNullSafe(spread["s"]) & (salted["salt"] == spread["t"]), "left")
    extra = F.coalesce(F.col("extra"), (F.col("rank") <= F.col("cut")) | F.coalesce(F.col("rank") == F.col("closing"), F.lit(False)), F.lit(False))
    copies = F.col("whole") + F.when(extra, 1).otherwise(0)
    return joined.select("doc_id", "source", "size", "occurrence", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _cuts(ranked: DataFrame) -> DataFrame:
    """``source, cut, closing``: the sample is the ranks up to ``cut``, the last whose words
    stay within the source's rest, and the one of rank ``closing``."""
    drawn = ranked.where("extra is null").select("source", "rank", "size", "rest")
    # the open bin of each source: [lo, lo + width), the words before it
    open_ = drawn.groupBy("source").agg(F.max("rest").alias("rest")).select("source", "rest", F.lit(0.0).alias("lo"), F.lit(0).cast("long").alias("before"))
    width = 1.0
    for _ in range(LEVELS):
        width /= BINS
        inside = _inside(drawn, open_, width * BINS)
        bins = inside.groupBy("source", "lo", "before", "rest", F.least(F.lit(BINS - 1), F.floor((F.col("rank") - F.col("lo")) / width)).alias("bin")).agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        summed = bins.withColumn("prior", F.col("before") + F.coalesce(F.sum("words").over(upto), F.lit(0)))
        last = summed.where(F.col("prior") < F.col("rest")).groupBy("source", "rest", "lo").agg(F.max("bin").alias("bin"), F.max("prior").alias("before"))
        open_ = cut(last.select("source", "rest", (F.col("lo") + F.col("bin") * width).alias("lo"), "before"))
    inside = _inside(drawn, open_, width)
    ranks = inside.groupBy("source", "rest", "before", "lo", "rank").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("rank")
    summed = ranks.withColumn("after", F.col("before") + F.sum("words").over(upto)).withColumn("prior", F.col("after") - F.col("words"))
    whole = F.col("after") <= F.col("rest")
    cuts = summed.groupBy("source", "rest").agg(
        F.coalesce(F.max(F.when(whole, F.col("rank"))), F.min("lo")).alias("cut"), F.coalesce(F.max(F.when(whole, F.col("after"))), F.min("before")).alias("words")
    )
    cuts = cut(cuts.withColumn("gap", F.col("rest") - F.col("words")))
    # the document behind the cut that fills the gap best closes the sample, if that brings it nearer
    later = _salted_join(drawn.drop("rest"), cuts).where(F.col("rank") > F.col("cut"))
    miss = F.abs(F.col("size") - F.col("gap"))
    least = later.where(miss < F.col("gap")).groupBy("source").agg(F.min(miss).alias("miss"))
    closing = _salted_join(later.select("source", "rank", miss.alias("own")), least).where(F.col("own") == F.col("miss")).groupBy("source").agg(F.min("rank").alias("closing"))
    closing = closing.withColumnRenamed("source", "s")
    return cuts.join(closing, cuts["source"].eqNullSafe(closing["s"]), "left").select("source", "cut", "closing")


def _salted_join(rows: DataFrame, per_source: DataFrame, salts: int = 16) -> DataFrame:
    """Each row with its source's columns; a source's rows are spread over ``salts`` keys."""
    spread = per_source.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumnRenamed("source", "s")
    salted = rows.withColumn("t", F.pmod(F.xxhash64("rank"), F.lit(salts)).cast("int"))
    return salted.join(spread, salted["source"].eqNullSafe(spread["s"]) & (F.col("t") == F.col("salt"))).drop("s", "t", "salt")


def _inside(drawn: DataFrame, open_: DataFrame, width: float) -> DataFrame:
    joined = _salted_join(drawn.drop("rest"), open_)
    return joined.where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("lo") + F.lit(width))).select("source", "rank", "size", "rest", "lo", "before")
