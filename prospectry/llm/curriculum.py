"""Mixing sources to target weights by a time-varying curriculum.

A source's target is its share of the words to take, by weight, held under ``CAP`` times what the
source has. Over the run (time 0 to 1) a source's weight follows a schedule; the integral of the
schedule, scaled to the target, is the source's cumulative demand. A document that starts at word
``c`` of its source's stream is needed when the demand reaches ``c``: the inverse of the cumulative
demand is its position, and sorting by position gives the training order.

Only DataFrame functions. Places of a source's documents are spread over ``4096`` buckets by the md5
of their id, so no window or join sees more than a bucket of a source, and no texts; the window over
rows sees the equal rows of one id; the windows over the table of sources see one row for each source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import packed, written
from .words import n_words

WEIGHTS = (1, 2, 3)
CAP = 3
#: Weight of a source at equal steps of the run's time; sources take them in turn.
SCHEDULES = ((1.0, 0.75, 0.5), (1.0, 1.0, 1.0), (0.5, 0.75, 1.0))


def _turn(rank: Column, values: Sequence) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP
) -> DataFrame:
    """``source, source_size`` to ``source, source_size, rank, target``.

    All sizes are shared out by weight. Sources in the order of size by weight meet their cap
    first; one is capped if the words left, shared among it and those after it, would exceed its
    cap. What is left at the first uncapped one gives the rate for all the others. Sums are
    integers, so reruns agree to the last bit. An empty table gives no rows.
    """
    ranked = sizes.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", _turn(F.col("rank"), weights).cast("bigint"))
    full = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    onward = full.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = ranked.withColumns({
        "left": F.sum("source_size").over(everything)
        - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)),
        "sharing": F.sum("weight").over(onward),
    }).withColumn(
        "capped",
        F.col("left") * F.col("weight") > F.col("source_size") * cap * F.col("sharing"))
    rate = F.min(F.when(~F.col("capped"), F.struct(
        F.col("source_size") / F.col("weight"), F.col("rank"), F.col("left"), F.col("sharing")))
    ).over(everything)
    return left.withColumn("rate", rate).select(
        "source", "source_size", "rank",
        F.when(F.col("capped"), (F.col("source_size") * cap).cast("double"))
        .otherwise(F.col("weight") * F.col("rate.left") / F.col("rate.sharing"))
        .alias("target"))


def demand_time(share: Column, schedule: Sequence[float]) -> Column:
    """Time at which a source with this schedule has handed out ``share`` (0 to 1) of its words.

    The schedule is linear between equally spaced knots, so its integral is quadratic within a
    step and is inverted in closed form.
    """
    steps = len(schedule) - 1
    areas = [(schedule[i] + schedule[i + 1]) / (2 * steps) for i in range(steps)]
    sums = [0.0]
    for a in areas:
        sums.append(sums[-1] + a)
    wanted, time = share * F.lit(sums[-1]), None
    for i in reversed(range(steps)):
        part = wanted - F.lit(sums[i])
        slope = (schedule[i + 1] - schedule[i]) * steps
        root = F.sqrt(F.greatest(
            F.lit(schedule[i] ** 2) + part * F.lit(2 * slope), F.lit(0.0)))
        below = F.lit(schedule[i]) + root
        at = F.lit(i / steps) + F.when(below > 0, part * F.lit(2.0) / below).otherwise(F.lit(0.0))
        time = at if time is None else F.when(wanted < F.lit(sums[i + 1]), at).otherwise(time)
    return F.least(time, F.lit(1.0))


def curriculum(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    cap: int = CAP,
    schedules: Sequence[Sequence[float]] = SCHEDULES,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row for each row of ``docs`` (``doc_id, text, source`` and any others): the struct
    ``doc`` with the columns named by ``keep`` (all by default), ``size``, ``source_size``,
    ``target``, ``start`` (first word of the document in its source's stream), ``epochs`` (whole
    passes), ``cut`` (words of one more, partial pass), ``taken``, ``turn`` (of its schedule).

    A source hands out whole passes over its stream, then the words up to its target's floor: all
    its documents are taken whole but for the one at which the target falls. Null texts have size
    0 and are never taken; a null source is a source of its own, the last; rows with the same id
    follow each other by size and text hash, equal rows in any order. No rows, no result.
    """
    mark = F.when(F.col("text").isNotNull(), F.xxhash64("text"))
    rows = docs.select(F.struct("source", "doc_id", mark.alias("mark")).alias("place"), packed(docs, keep), "text")
    # places are worked out on narrow rows: a text is moved once to meet its place, and once by the sort
    sizes = rows.select("place", n_words(F.col("text")).alias("size")).groupBy("place").agg(
        F.first("size").alias("size"), F.count("*").alias("copies"))
    sizes = sizes.select(
        "place", "size", (F.col("size") * F.col("copies")).alias("words"), F.col("place.source").alias("source"),
        F.md5(F.coalesce(F.col("place.doc_id").cast("string"), F.lit("")).cast("binary")).alias("key"),
    ).withColumn("bucket", F.substring("key", 1, 3))
    sizes = written(sizes)
    buckets = written(sizes.groupBy("source", "bucket").agg(F.sum("words").alias("bucket_size")))
    targets = source_targets(
        buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, cap)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = buckets.select(
        F.col("source").alias("_source"), F.col("bucket").alias("_bucket"),
        F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("offset"))
    targets = targets.withColumnRenamed("source", "_of")
    offsets = offsets.join(targets, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "size", "place").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    places = sizes.withColumn("before", F.sum("words").over(inside) - F.col("words")).join(
        offsets,
        F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket"))
    ).select("place", "size", "source_size", "target", "rank", (F.col("offset") + F.col("before")).alias("first"))
    # equal rows follow each other
    copy = F.row_number().over(Window.partitionBy("place").orderBy("size")) - 1
    placed = rows.select("place", "doc").join(written(places), "place").withColumn(
        "start", F.col("first") + copy * F.col("size"))
    size, total = F.col("size"), F.floor("target").cast("bigint")
    passes = F.when(F.col("source_size") > 0, F.floor(total / F.col("source_size")).cast("bigint")).otherwise(F.lit(0))
    return placed.withColumn("epochs", passes.cast("bigint")).withColumn(
        "cut", F.least(size, F.greatest(
            F.lit(0).cast("bigint"),
            total - F.col("epochs") * F.col("source_size") - F.col("start")))
    ).select(
        "doc", "size", "source_size", "target", "start", "epochs", "cut",
        (F.col("epochs") * size + F.col("cut")).alias("taken"),
        F.pmod(F.col("rank") - 1, F.lit(len(schedules))).cast("int").alias("turn"))


def position(offset: Column, schedules: Sequence[Sequence[float]] = SCHEDULES) -> Column:
    """Training position (0 to 1) of the word at ``offset`` of what a source hands out."""
    share = F.when(F.col("target") > 0, offset / F.col("target")).otherwise(F.lit(0.0))
    out = F.lit(None).cast("double")
    for i, schedule in enumerate(schedules):
        out = F.when(F.col("turn") == i, demand_time(share, schedule)).otherwise(out)
    return out


def training_order(
    plan: DataFrame, schedules: Sequence[Sequence[float]] = SCHEDULES
) -> DataFrame:
    """One row for each pass over a document, sorted by range over ``position``: ``doc``, ``epoch``
    (from 0), ``words`` (of this pass; fewer than ``size`` for the cut one), ``position``."""
    passes = plan.filter("taken > 0").select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("epochs"))).alias("epoch"))
    return passes.withColumn(
        "words", F.when(F.col("epoch") < F.col("epochs"), F.col("size")).otherwise(F.col("cut"))
    ).filter("words > 0").withColumn(
        "position", position(F.col("epoch") * F.col("source_size") + F.col("start"), schedules)
    ).select("doc", "epoch", "words", "position", "start").orderBy("position", "epoch", "start")
