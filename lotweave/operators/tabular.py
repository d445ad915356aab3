"""Cleaning, filtering, deduplication, set operations and equi-joins of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotweave.operators.ranking import global_rank
from lotweave.session import Scratch


def rename_and_drop(df: DataFrame, names: dict[str, str], drop: list[str] = ()) -> DataFrame:
    """Columns renamed and dropped; names df doesn't have are ignored."""
    return df.drop(*[c for c in drop if c in df.columns]).withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def not_in(c: str, values: list) -> Column:
    """Not one of the values; null counts as not one of them."""
    return ~F.col(c).isin(*values) | F.col(c).isNull()


def with_coordinates(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Rows whose coordinates are both there and not zero."""
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & (F.col(lat) != 0) & (F.col(lon) != 0))


def where_flag(df: DataFrame, column: str, value) -> DataFrame:
    """Rows with the flag, if df has the column; else all."""
    return df.where(F.col(column) == value) if column in df.columns else df


def number(c: Column | str) -> Column:
    """A double from text such as '$1,200'; null for what is none, and for NaN."""
    c = F.col(c) if isinstance(c, str) else c
    x = F.translate(F.trim(c.cast("string")), "$,", "").try_cast("double")
    return F.when(~F.isnan(x), x)


def clean_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with those of the columns it has as numbers."""
    return df.withColumns({c: number(c) for c in columns if c in df.columns})


def between_or_null(c: str, low: float, high: float) -> Column:
    """The value, or null outside [low, high]; rows stay."""
    return F.when(F.col(c).between(low, high), F.col(c))


def keep_range(df: DataFrame, c: str, low: float, high: float) -> DataFrame:
    """Rows whose value is missing or in [low, high]."""
    return df.where(F.col(c).isNull() | F.isnan(c) | F.col(c).between(low, high))


def rooms_from_area(area: Column, units: Column, each: float = 350.0, low: int = 1, high: int = 8) -> Column:
    """Rooms estimated from floor area per unit (0 or missing units count as 1), rounded half to even and clipped; null without an area."""
    u = F.when(units.isNull() | (units == 0), 1.0).otherwise(units.cast("double"))
    per = F.bround(area / u / each, 0)
    return F.when(per.isNotNull() & ~F.isnan(per), F.least(F.greatest(per, F.lit(float(low))), F.lit(float(high))))


def latest_only(df: DataFrame, c: str) -> DataFrame:
    """Rows with the largest value of c; that value is one row, joined as such."""
    return df.join(F.broadcast(df.agg(F.max(c).alias(c))), c)  # one row


def pad_id(c: Column, width: int = 10) -> Column:
    """An id with zeros in front up to the width; longer ones stay whole."""
    t = F.trim(c)
    return F.when(F.length(t) < width, F.lpad(t, width, "0")).otherwise(t)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each value of the keys: the first in the order, which must be total; null keys are dropped.

    The first is a minimum of a struct, aggregated before the shuffle, so a key that holds much of the table gathers nowhere.
    """
    known = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    rest = F.struct(*[c for c in df.columns if c not in keys])
    return known.groupBy(*keys).agg(F.min_by(rest, at).alias("_r")).select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """As keep_first(), but the last in the order."""
    known = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    at = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    rest = F.struct(*[c for c in df.columns if c not in keys])
    return known.groupBy(*keys).agg(F.max_by(rest, at).alias("_r")).select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def clean_ids(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Ids trimmed, missing and empty ones dropped, the first row of each kept."""
    return keep_first(df.withColumn(key, F.trim(key)).where(F.col(key) != ""), [key], order)


def left_join_one(df: DataFrame, other: DataFrame, on: dict[str, str], columns: list[str], order: list[Column]) -> DataFrame:
    """df, with columns of the first matching row of other in the order; rows without a match have nulls, none is multiplied."""
    one = keep_first(other, list(on.values()), order).select(*[F.col(b).alias(f"_j_{b}") for b in on.values()], *columns)
    cond = reduce(lambda a, b: a & b, [df[a] == one[f"_j_{b}"] for a, b in on.items()])
    return df.join(one, cond, "left").drop(*[f"_j_{b}" for b in on.values()])


def union_distinct(parts: list[DataFrame], keys: list[str], order: list[Column]) -> DataFrame:
    """All parts by column name, one row for each value of the keys."""
    return keep_first(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), keys, order)


def ratios(df: DataFrame, of: dict[str, tuple[str, str]], drop: list[str] = ()) -> DataFrame:
    """df with each numerator over its denominator (null for 0), where df has both; raw columns dropped."""
    out = df.withColumns({n: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")) for n, (a, b) in of.items() if a in df.columns and b in df.columns})
    return out.drop(*[c for c in drop if c in df.columns])


def share_of_sum(df: DataFrame, name: str, parts: list[str], total: str) -> DataFrame:
    """df with the sum of those parts it has (missing ones count 0) over the total."""
    have = [c for c in parts if c in df.columns]
    if not have or total not in df.columns:
        return df
    return df.withColumn(name, F.try_divide(reduce(lambda a, b: a + b, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in have]), F.col(total).cast("double")))


def first_column(df: DataFrame, names: list[str]) -> str | None:
    """The first of the names that df has; decided while planning."""
    return next((n for n in names if n in df.columns), None)


def valid_log_outcome(df: DataFrame, c: str, out: str = "y") -> DataFrame:
    """Rows with a finite, positive value, and its natural logarithm."""
    return df.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0) & (F.col(c) < float("inf"))).withColumn(out, F.ln(c))


def dense_columns(df: DataFrame, columns: list[str], most_missing: float = 0.5) -> tuple[DataFrame, list[str]]:
    """(df with missing values of the kept columns as 0, the kept columns): those with a smaller part missing than most_missing.

    The parts are one aggregated row.
    """
    gaps = df.agg(*[F.avg((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("double")).alias(c) for c in columns]).first()
    kept = [c for c in columns if gaps[c] is not None and gaps[c] < most_missing]
    return df.withColumns({c: F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(0.0)) for c in kept}), kept


def label_numbers(df: DataFrame, c: str, out: str) -> DataFrame:
    """df with the number, from 0, of its label among the sorted distinct labels. Only these are ranked, over ranges, in as many tasks as there are partitions."""
    labels = df.where(F.col(c).isNotNull()).select(c).distinct()
    return df.join(global_rank(labels, [F.col(c)], Scratch(df.sparkSession), out), c, "left")


def hashed_indicators(df: DataFrame, number_col: str, bins: int, prefix: str) -> DataFrame:
    """df with an indicator for each remainder of a label's number by bins."""
    return df.withColumns({f"{prefix}{i}": (F.pmod(F.col(number_col), F.lit(bins)) == i).cast("int") for i in range(bins)})


def frequent_classes(df: DataFrame, c: str, least: int) -> DataFrame:
    """Rows whose class has at least so many rows; classes are counted before the shuffle."""
    return df.join(df.groupBy(c).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(c), c, "left_semi")


def threshold_counts(df: DataFrame, c: str, bounds: list[tuple[str, float, float]]) -> DataFrame:
    """(name, n, mean): rows within each pair of bounds, in one pass."""
    aggs = [F.struct(F.lit(n).alias("name"), F.count_if(F.col(c).between(lo, hi)).alias("n"), F.avg(F.when(F.col(c).between(lo, hi), F.col(c))).alias("mean")) for n, lo, hi in bounds]
    return df.agg(*[a.alias(f"_{i}") for i, a in enumerate(aggs)]).select(F.explode(F.array(*[F.col(f"_{i}") for i in range(len(aggs))])).alias("r")).select("r.*")


def release(df: DataFrame, drop: list[str], vector: str | None = None, prefix: str = "emb_", size: int = 0) -> DataFrame:
    """df without the columns that may not be published, and a vector as numbered columns."""
    out = df.drop(*[c for c in drop if c in df.columns])
    return out if vector is None else out.select(*[c for c in out.columns if c != vector], *[F.col(vector)[i].alias(f"{prefix}{i}") for i in range(size)])


def summary(df: DataFrame, group: str, c: str) -> DataFrame:
    """(group, n, mean, median, sd, low, high) of a column's values that are there."""
    v = F.when(~F.isnan(c), F.col(c))
    return df.groupBy(group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_samp(v).alias("sd"), F.min(v).alias("low"), F.max(v).alias("high"))


def match_rates(df: DataFrame, group: str, conditions: dict[str, Column]) -> DataFrame:
    """(group, n, a share for each condition): how often each holds; a null one doesn't."""
    return df.groupBy(group).agg(F.count("*").alias("n"), *[F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(name) for name, c in conditions.items()])


def without_columns_unmatched(df: DataFrame, flag: str, prefix: str, least: float = 0.5) -> DataFrame:
    """df without the columns of a prefix, where the flag holds for less than ``least`` of the rows that have it; decided from one aggregated row."""
    rate = df.agg(F.avg(F.col(flag).cast("double")).alias("r")).first()["r"]
    return df.drop(*[c for c in df.columns if c.startswith(prefix) and c != flag]) if rate is not None and rate < least else df


def with_columns_of(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """df beside other's columns, row by row by their key; rows of df alone have nulls. other has each key once; else use left_join_one()."""
    return df.join(other, key, "left")


def large_shapes(df: DataFrame, area: Column, polygon: Column, least: float) -> DataFrame:
    """Rows that aren't polygons, and polygons of at least so large an area."""
    return df.where(~F.coalesce(polygon, F.lit(False)) | (area >= least))
