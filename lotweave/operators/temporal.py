"""Events inferred from panels, splits in time, windows, and drift between parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotweave.operators.ranking import global_rank
from lotweave.operators.tabular import keep_last
from lotweave.session import Scratch


def inferred_events(panel: DataFrame, entity: str, order: list[str], date: str, value: str, least_change: float = 0.05) -> DataFrame:
    """(entity, event_value, event_date): the latest row of each entity at which its date changed and its value moved by more than least_change.

    A change is against the entity's row before in the order; the date of a first row counts as changed, but it has no value
    before. Rows without an entity are left out.
    """
    w = Window.partitionBy(entity).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    seen = panel.where(F.col(entity).isNotNull()).withColumns({"_v": F.lag(value).over(w), "_d": F.lag(date).over(w)})
    moved = F.abs(F.try_divide(F.col(value) - F.col("_v"), F.col("_v"))) > least_change
    hits = seen.where(~F.col(date).eqNullSafe(F.col("_d")) & F.col(date).isNotNull() & (F.col(value) > 0) & moved)
    last = keep_last(hits.select(entity, value, date, *[c for c in order if c not in (entity, value, date)]), [entity], [F.col(date), *[F.col(c) for c in order]])
    return last.select(entity, F.col(value).alias("event_value"), F.col(date).alias("event_date"))


def temporal_split(df: DataFrame, date: str, tie: str, scratch: Scratch, shares: tuple[float, float] = (0.7, 0.15), labels: tuple[str, str, str] = ("train", "validation", "test")) -> DataFrame:
    """df with ``split``: the earliest part, the next, and the rest, cut at whole numbers of rows; rows without a date are of the first."""
    dated = df.where(F.col(date).isNotNull())
    n = dated.count()
    ranked = global_rank(dated, [F.col(date), F.col(tie)], scratch, "_rank")
    a, b = int(n * shares[0]), int(n * (shares[0] + shares[1]))
    out = ranked.withColumn("split", F.when(F.col("_rank") < a, labels[0]).when(F.col("_rank") < b, labels[1]).otherwise(labels[2])).drop("_rank")
    return out.unionByName(df.where(F.col(date).isNull()).withColumn("split", F.lit(labels[0])))


def split_within(df: DataFrame, group: str, date: str, tie: str, labels: tuple[str, str, str] = ("train", "val", "test"), share: float = 0.15) -> DataFrame:
    """df's dated rows with ``split``: in each group the last floor(share n) are the third part, as many before them the second.

    Ranks come from counts by date, so only rows of one date are ranked among themselves.
    """
    dated = df.where(F.col(date).isNotNull() & F.col(group).isNotNull())
    days = dated.groupBy(group, date).agg(F.count("*").alias("_k"))
    w = Window.partitionBy(group).orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumns({"_before": F.coalesce(F.sum("_k").over(w), F.lit(0)), "_n": F.sum("_k").over(Window.partitionBy(group))}).drop("_k")
    ranked = dated.join(days, [group, date]).withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy(group, date).orderBy(tie)) - 1)
    part = F.floor(F.col("_n") * share)
    out = ranked.withColumn("split", F.when(F.col("_rank") >= F.col("_n") - part, labels[2]).when(F.col("_rank") >= F.col("_n") - 2 * part, labels[1]).otherwise(labels[0]))
    return out.drop("_before", "_n", "_rank")


def trailing_window(events: DataFrame, date: str, anchors: DataFrame, anchor_date: str, days: int = 365, least: int = 1000, least_dated: float = 0.1) -> DataFrame:
    """Events in the window of ``days`` up to the anchors' median date, both ends in; all events with a date if fewer than a tenth of
    the anchors have one, or the window has no more than ``least`` events. Adds ``in_window``.

    The branch is decided inside one plan, from two aggregated rows.
    """
    known = events.where(F.col(date).isNotNull())
    when = F.unix_micros(F.col(anchor_date).cast("timestamp"))
    end = anchors.agg(F.median(when).cast("long").alias("_end"), (F.count(anchor_date) >= F.count("*") * least_dated).alias("_dated"))
    micros = days * 86_400_000_000
    t = F.unix_micros(F.col(date).cast("timestamp"))
    flagged = known.crossJoin(F.broadcast(end)).withColumn("in_window", F.coalesce(F.col("_dated") & t.between(F.col("_end") - micros, F.col("_end")), F.lit(False)))  # one row
    enough = flagged.agg((F.count_if("in_window") > least).alias("_enough"))
    return flagged.crossJoin(F.broadcast(enough)).where("in_window or not _enough").drop("_end", "_dated", "_enough")  # one row


def histogram_bin(c: Column, low: Column, high: Column, bins: int) -> Column:
    """The bin, from 1, of equal width; the last is closed on the right."""
    return F.least(F.floor((c - low) / (high - low) * bins).cast("int") + 1, F.lit(bins))


def drift(df: DataFrame, part: str, columns: list[str], bins: int = 20, least: int = 10) -> DataFrame:
    """(measure, part_a, part_b, js_distance): Jensen-Shannon distance (square root, natural logarithm) between the parts' histograms.

    Bins of equal width over all parts; a column with fewer than ``least`` values is left out.
    One pass collects the histograms: columns x parts x bins numbers, whatever the table's size.
    """
    long = df.select(part, F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in columns])).alias("r")).select(part, "r.*").where(F.col("v").isNotNull() & ~F.isnan("v") & F.col(part).isNotNull())
    span = long.groupBy("measure").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).where(F.col("n") >= least)
    counted = long.join(F.broadcast(span), "measure").withColumn("bin", F.when(F.col("hi") > F.col("lo"), histogram_bin(F.col("v"), F.col("lo"), F.col("hi"), bins)).otherwise(1))  # a row for each column
    hist = counted.groupBy("measure", part, "bin").agg(F.count("*").alias("k"))
    parts = hist.select("measure", part).distinct()
    dense = parts.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins)))).join(hist, ["measure", part, "bin"], "left")
    total = Window.partitionBy("measure", part)
    dense = dense.join(F.broadcast(span.select("measure", "lo", "hi")), "measure").withColumn("q", F.coalesce("k", F.lit(0)) / F.sum("k").over(total) / ((F.col("hi") - F.col("lo")) / bins) + 1e-10)  # a row for each column
    dense = dense.withColumn("q", F.col("q") / F.sum("q").over(total)).select("measure", part, "bin", "q")
    a = dense.select("measure", F.col(part).alias("part_a"), "bin", F.col("q").alias("p"))
    b = dense.select("measure", F.col(part).alias("part_b"), "bin", "q")
    m = (F.col("p") + F.col("q")) / 2
    js = F.sum(F.col("p") * F.ln(F.col("p") / m) + F.col("q") * F.ln(F.col("q") / m)) / 2
    return a.join(b, ["measure", "bin"]).where("part_a < part_b").groupBy("measure", "part_a", "part_b").agg(F.sqrt(F.greatest(js, F.lit(0.0))).alias("js_distance"))
