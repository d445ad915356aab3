"""Filling of missing values from like records, with a mark for every value filled."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotweave.session import Scratch


@dataclass(frozen=True)
class Numeric:
    """A numeric column, usable from low to high; whole: its fills are whole numbers, else they have three decimals."""

    name: str
    low: float
    high: float
    whole: bool = False

    def usable(self) -> Column:
        c = F.col(self.name).cast("double")
        return F.when(~F.isnan(c) & c.between(self.low, self.high), c)


@dataclass(frozen=True)
class Category:
    """A column with the given values, case and blanks around them ignored."""

    name: str
    values: tuple[str, ...]

    def usable(self) -> Column:
        c = F.upper(F.regexp_replace(self.name, r"^\s+|\s+$", ""))
        return F.when(c.isin(*self.values), c)


#: A level of at most this many groups is broadcast with its means.
FEW_GROUPS = 20_000


def fill_from_like(
    df: DataFrame,
    numeric: list[Numeric],
    category: list[Category],
    groups: list[tuple[list[Column], float]],
    scratch: Scratch,
    rounds: int = 8,
    tolerance: float = 5e-3,
    finer: tuple[list[tuple[list[Column], float]], float] = ((), 1.0),
) -> DataFrame:
    """df with each column's missing values filled; ``<column>_missing`` says which had no usable value, ``<column>_filled`` which of these were filled.

    groups are the edges: records are neighbours if they agree in all columns of one of the groups, which
    counts with the group's weight; a group with a null column ties nothing. Labels are propagated over
    them: in each round every group takes the mean of its members' numbers and of their
    category distributions, and every missing value takes the weighted mean of its groups, while observed
    values stay clamped; it ends when no number moves by more than ``tolerance`` of its column's range and no share by more than
    ``tolerance``, or after ``rounds`` rounds. Records that agree in all groups' columns move alike, so the rounds run over one
    row for each such cell, whose sums are aggregated before any shuffle; a group's edges are never listed. Means of a
    level of few groups (cities, all records) are broadcast, so that no group of a large part of all rows is shuffled.
    finer, (groups, weight of what was propagated so far), are the edges of a last round, of numbers only: those so narrow that a cell would be hardly more than a record.

    A fill is the propagated mean (to three decimals, or rounded half to even where whole) or the likeliest category (the first in
    order of ``values`` among equals). All records together are the last group, with a very small weight, so a
    value stays null, missing but not filled, only if the column has no usable value at all. Observed numbers keep
    their value, observed categories come out trimmed and in upper case. An empty table gives an empty table.
    """

    def key(i: int, cols: list[Column]) -> Column:
        return F.concat(F.lit(str(i)), *[x for k in cols for x in (F.lit("\u0001"), k.cast("string"))])  # null if one of them is

    keys = {f"_g{i}": key(i, cols) for i, (cols, _) in enumerate(groups)}
    keys[f"_g{len(groups)}"] = F.lit("all")
    weights = dict(zip(keys, [*[w for _, w in groups], 1e-6]))
    narrow = {f"_f{i}": key(i, cols) for i, (cols, _) in enumerate(finer[0])}
    weights |= dict(zip(narrow, [w for _, w in finer[0]]))
    rows = df.withColumns({f"_v_{c.name}": c.usable() for c in [*numeric, *category]} | keys | narrow)

    def name(of: list[Column]) -> Column:  # 128 bits: no two of any number of cells share a name by chance
        return F.unhex(F.md5(F.concat_ws("\u0002", *[F.coalesce(k, F.lit("\u0003")) for k in of])))

    rows = rows.withColumn("_cell", name([F.col(k) for k in keys]))
    rows = rows.withColumn("_fine", name([F.hex("_cell"), *[F.col(k) for k in narrow]]) if narrow else F.col("_cell"))

    # slots: each number is one, each category's share of each value is one
    slots: list[tuple[float, str, Column]] = [(c.high - c.low, f"_v_{c.name}", F.col(f"_v_{c.name}")) for c in numeric]
    for c in category:
        slots += [(1.0, f"_v_{c.name}", (F.col(f"_v_{c.name}") == v).cast("double")) for v in c.values]

    def sums(many: int) -> list[Column]:
        return [x for i, (_, has, value) in enumerate(slots[:many]) for x in (F.sum(value).alias(f"s{i}"), F.count(has).alias(f"n{i}"), F.count_if(F.col(has).isNull()).alias(f"m{i}"))]

    def mean(i: int) -> Column:
        known = F.when(F.col(f"e{i}").isNotNull(), F.col(f"m{i}")).otherwise(0)
        return F.try_divide(F.sum(F.coalesce(f"s{i}", F.lit(0.0)) + F.coalesce(F.col(f"e{i}") * F.col(f"m{i}"), F.lit(0.0))), F.sum(F.col(f"n{i}") + known)).alias(f"h{i}")

    def hubs_of(table: DataFrame, levels: list[str]) -> DataFrame:
        some = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.lit(weights[k]).alias("w"), F.col(k).alias("k"))) for k in levels]))
        return table.withColumn("_hub", F.explode(some))

    def gathered(table: DataFrame, of: str, levels: list[str], many: int) -> DataFrame:
        """(of, a0, b0, ...): sums of weighted means of a cell's groups, and of the weights, by a shuffle of all cells to their groups."""
        hubs = hubs_of(table, levels)
        means = hubs.groupBy("_hub").agg(*[mean(i) for i in range(many)])
        both = [x for i in range(many) for x in (F.sum(F.col("_hub.w") * F.col(f"h{i}")).alias(f"a{i}"), F.sum(F.when(F.col(f"h{i}").isNotNull(), F.col("_hub.w"))).alias(f"b{i}"))]
        return hubs.select(of, "_hub").join(means, "_hub").groupBy(of).agg(*both)

    cells = rows.groupBy("_cell", *keys).agg(*sums(len(slots)))
    cells = scratch.cut(cells.withColumns({f"e{i}": F.lit(None).cast("double") for i in range(len(slots))}))
    counted = cells.agg(*[F.approx_count_distinct(k).alias(k) for k in keys]).first()
    few, many = [k for k in keys if counted[k] <= FEW_GROUPS * 9 // 10], [k for k in keys if counted[k] > FEW_GROUPS * 9 // 10]
    names = [f"h{i}" for i in range(len(slots))]
    for _ in range(rounds):
        if many:
            placed = cells.join(gathered(cells, "_cell", many, len(slots)), "_cell", "left")
        else:
            placed = cells.withColumns({f"{x}{i}": F.lit(None).cast("double") for i in range(len(slots)) for x in "ab"})
        if few:
            means = hubs_of(cells, few).groupBy(F.col("_hub.k").alias("_k")).agg(*[mean(i) for i in range(len(slots))]).select("_k", F.struct(*names).alias("_h"))
            for k in few:  # the same table each time, of FEW_GROUPS rows a level at most: it is broadcast once
                placed = placed.join(F.broadcast(means.select(F.col("_k").alias(f"_k{k}"), F.col("_h").alias(f"_h{k}"))), F.col(k) == F.col(f"_k{k}"), "left")
        estimate = {}
        for i, n in enumerate(names):
            top, below = F.coalesce(f"a{i}", F.lit(0.0)), F.coalesce(f"b{i}", F.lit(0.0))
            for k in few:
                h = F.col(f"_h{k}")[n]
                top, below = top + F.coalesce(h * weights[k], F.lit(0.0)), below + F.when(h.isNotNull(), weights[k]).otherwise(0.0)
            estimate[f"e{i}"] = F.try_divide(top, below)
        moved = F.array_max(F.array(*[F.when(F.col(f"m{i}") > 0, F.coalesce(F.abs(estimate[f"e{i}"] - F.col(f"e{i}")) / scale, F.when(estimate[f"e{i}"].isNotNull(), 1.0).otherwise(0.0))).otherwise(0.0) for i, (scale, _, _) in enumerate(slots)]))
        later = scratch.cut(placed.withColumn("_moved", moved).withColumns(estimate).select(*cells.columns, "_moved"))
        scratch.drop(cells)
        cells = later.drop("_moved")
        scratch.paths[id(cells)] = scratch.paths.pop(id(later))
        if (later.agg(F.max("_moved").alias("most")).first()["most"] or 0.0) <= tolerance:
            break

    found = [f"e{i}" for i in range(len(slots))]
    if narrow and numeric:
        some = rows.groupBy("_fine", "_cell", *narrow).agg(*sums(len(numeric))).join(cells.select("_cell", *found), "_cell")
        some = scratch.cut(some)
        near = gathered(some, "_fine", [*narrow], len(numeric))
        both = {f"e{i}": F.coalesce(F.try_divide(F.col(f"e{i}") * finer[1] + F.col(f"a{i}"), finer[1] + F.col(f"b{i}")), F.col(f"e{i}")) for i in range(len(numeric))}
        out = rows.join(some.join(near, "_fine", "left").withColumns(both).select("_fine", *found), "_fine")
    else:
        out = rows.join(cells.select("_cell", *found), "_cell")
    done: dict[str, Column] = {}
    at = 0
    for c in numeric:
        fill = F.greatest(F.least(F.col(f"e{at}"), F.lit(c.high)), F.lit(c.low))
        fill = F.when(F.col(f"e{at}").isNotNull(), F.bround(F.round(fill, 6), 0) if c.whole else F.round(fill, 3))
        done[c.name] = F.coalesce(f"_v_{c.name}", fill).cast(df.schema[c.name].dataType)
        done[f"{c.name}_missing"] = F.col(f"_v_{c.name}").isNull()
        done[f"{c.name}_filled"] = F.col(f"_v_{c.name}").isNull() & F.col(f"e{at}").isNotNull()
        at += 1
    for c in category:
        es = [F.col(f"e{at + j}") for j in range(len(c.values))]
        best = F.array_max(F.array(*[F.struct(F.round(e, 9).alias("e"), F.lit(-j).alias("j"), F.lit(v).alias("v")) for j, (e, v) in enumerate(zip(es, c.values))]))
        done[c.name] = F.coalesce(f"_v_{c.name}", F.when(es[0].isNotNull(), best["v"]))
        done[f"{c.name}_missing"] = F.col(f"_v_{c.name}").isNull()
        done[f"{c.name}_filled"] = F.col(f"_v_{c.name}").isNull() & es[0].isNotNull()
        at += len(c.values)
    return out.withColumns(done).select(*df.columns, *[f"{c.name}_{m}" for c in [*numeric, *category] for m in ("missing", "filled")])


#: Which values of a parcel are usable.
PARCEL_NUMBERS = [Numeric("bedrooms", 0, 20, True), Numeric("year_built", 1700, 2026, True), Numeric("bldg_area_sqft", 100, 1_000_000)]
PARCEL_LABELS = [Category("land_use", ("R1", "R2", "R3", "R4", "CD", "A"))]


def _size_class(c: str, shift: float) -> Column:
    """Number of a class of sizes that are within a factor of the square root of two, null for sizes that aren't positive."""
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v) & (v > 0), F.floor(F.round(F.log2(v) * 2, 9) + shift))


def parcel_groups() -> tuple[list[tuple[list[Column], float]], tuple[list[tuple[list[Column], float]], float]]:
    """The edges of parcels: those of place and units, and the finer ones of like size in a block, with the weight of the former.

    Parcels of a block are similar if their lots are within a factor of the square root of two, and so are their assessed totals; two gratings, each half a class from the
    other, join those on either side of a class's edge. Size tells nothing of the land use.
    """
    text = {c: F.lower(F.trim(c)) for c in ("block", "zip", "city")}
    units = F.when(F.col("units_res") >= 0, F.least(F.col("units_res"), F.lit(50)))
    area, block = [text["city"], text["zip"]], [text["city"], text["zip"], text["block"]]
    out = [([*block, units], 8.0), (block, 4.0), ([*area, units], 2.0), (area, 1.0), ([text["city"], units], 0.5), ([text["city"]], 0.1)]
    return out, ([([*block, _size_class(c, shift)], 4.0) for c in ("lot_area_sqft", "assessed_total") for shift in (0.0, 0.5)], 6.0)


def fill_parcels(parcels: DataFrame, scratch: Scratch, rounds: int = 8) -> DataFrame:
    """parcels with bedrooms, year_built, bldg_area_sqft and land_use filled from parcels of the block, zip and city, of as many units, and of like size and value."""
    groups, finer = parcel_groups()
    return fill_from_like(parcels, PARCEL_NUMBERS, PARCEL_LABELS, groups, scratch, rounds, finer=finer)
