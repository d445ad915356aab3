"""Splits that keep related records together."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotweave.functions.text import zip5
from lotweave.operators.components import tie_groups
from lotweave.session import Scratch

#: A bitset has at most this many bits.
BITSET_BITS = 1 << 22


def related_groups(df: DataFrame, scratch: Scratch, id_col: str = "emb_id", zip_col: str = "zip", parcel_col: str = "parcel_id") -> DataFrame:
    """(id, group): records with the same zip or the same parcel_id, directly or over other records, share a group.

    ``group`` is ``0:<smallest zip of the group>``, or ``1:<smallest parcel_id>`` in a group without a zip, or
    null for a record that has neither, which is related to none. An empty or blank parcel_id ties nothing.
    """
    parcel = F.trim(F.col(parcel_col))
    return tie_groups(df, id_col, [zip5(F.col(zip_col)), F.when(parcel != "", parcel)], scratch)


def _closest_sum(left: dict[int, int], goal: int, bits: int) -> tuple[dict[int, int], int]:
    """How many groups of each size to take so that their total comes closest to the goal (the smaller of two), and that total.

    A bitset holds all totals that size multiplicities (1, 2, 4, ... groups of a size at once) can make; each total remembers the item
    that made it first, from which it is traced back. It ends as soon as the goal itself can be made.
    """
    if goal <= 0:
        return {}, 0
    unit = -(-(2 * goal + 2) // bits)
    length = 2 * goal // unit + 2
    aim, mask, reach = round(goal / unit), (1 << length) - 1, 1
    owner, items = np.full(length, -1, dtype=np.int32), []
    for s in sorted(left):
        n, step = min(left[s], 2 * goal // s), 1
        while n > 0:
            take = min(step, n)
            w = max(1, round(s * take / unit))
            fresh = (reach << w) & mask & ~reach
            if fresh:
                seen = np.unpackbits(np.frombuffer(fresh.to_bytes(-(-length // 8), "little"), dtype=np.uint8), bitorder="little")
                owner[np.flatnonzero(seen)] = len(items)
                reach |= fresh
            items.append((s, take, w))
            n, step = n - take, step * 2
        if reach >> aim & 1:
            break
    made = np.concatenate(([0], np.flatnonzero(owner >= 0)))
    at = int(made[np.abs(made - aim).argmin()])
    out: dict[int, int] = {}
    while at > 0:
        s, take, w = items[owner[at]]
        out[s] = out.get(s, 0) + take
        at -= w
    return out, sum(s * n for s, n in out.items())


def _take(left: dict[int, int], goal: int, bits: int) -> dict[int, int]:
    """Groups of each size whose total comes closest to the goal.

    First each size gives its share, and a bitset of the rest's totals makes up what is missing, be the table
    however large. Where that misses the goal and all totals fit in the bitset, the closest of them is taken.
    """
    total = sum(s * n for s, n in left.items())
    part = {s: n * goal // total for s, n in left.items()} if total else {}
    need = goal - sum(s * n for s, n in part.items())
    for s in sorted(left, reverse=True):  # what the sizes' shares were rounded down by may still be more than the bitset holds
        if 2 * need + 2 > bits:
            more = min(left[s] - part[s], (need - bits // 4) // s)
            if more > 0:
                part[s] += more
                need -= more * s
    rest, made = _closest_sum({s: n - part[s] for s, n in left.items()}, need, bits)
    if made != need and 2 * goal + 2 <= bits:
        return _closest_sum(left, goal, bits)[0]
    return {s: part.get(s, 0) + rest.get(s, 0) for s in {*part, *rest} if part.get(s, 0) + rest.get(s, 0)}


def closest_counts(sizes: dict[int, int], shares: list[float], bits: int = BITSET_BITS) -> list[dict[int, int]]:
    """How many groups of each size go to each split so that the splits' totals come closest to the shares.

    For every split but the largest, taken from the smallest share up, the total closest to the target that
    the groups left over can make is chosen; see _take(). The largest split takes the rest.
    """
    total = sum(s * n for s, n in sizes.items())
    left, out = dict(sizes), [dict() for _ in shares]
    order = sorted(range(len(shares)), key=lambda i: (shares[i], -i))
    for i in order[:-1]:
        out[i] = _take(left, math.floor(shares[i] * total + 0.5), bits)
        left = {s: n - out[i].get(s, 0) for s, n in left.items() if n > out[i].get(s, 0)}
    out[order[-1]] = left
    return out


def assign_splits(df: DataFrame, groups: DataFrame, scratch: Scratch, names: tuple[str, ...] = ("train", "validation", "test"), shares: tuple[float, ...] = (0.7, 0.15, 0.15), id_col: str = "emb_id", seed: int = 7) -> DataFrame:
    """(id, group, split) for every row of groups(id, group); a group is never divided.

    Sizes' multiplicities (at most about the square root of twice the rows) go to the driver, where the
    groups of each size are dealt out; which groups of a size go where follows a hash of the group and the seed. Groups of
    one size may be most of the table, so they are ranked over hash ranges, never in one task.
    """
    if len(names) != len(shares) or abs(sum(shares) - 1) > 1e-9:
        raise ValueError("the shares must be as many as the names and sum to 1")
    keyed = groups.withColumn("_g", F.coalesce("group", F.concat(F.lit("~"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))))
    keyed = scratch.cut(keyed)
    # the hash range keeps the ranking of equal sizes in many tasks
    sizes = keyed.groupBy("_g").agg(F.count("*").alias("_size")).withColumn("_h", F.xxhash64("_g", F.lit(seed)))
    sizes = scratch.cut(sizes.withColumn("_range", F.shiftright("_h", 54).cast("int")))
    counts = sizes.groupBy("_size", "_range").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.sum("n").over(Window.partitionBy("_size").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
    found = {r["_size"]: r["n"] for r in sizes.groupBy("_size").agg(F.count("*").alias("n")).collect()}
    dealt = closest_counts(found, list(shares))
    bounds, rows = {s: 0 for s in found}, []
    for name, part in zip(names, dealt):
        for s, n in part.items():
            if n:
                rows.append((s, bounds[s], bounds[s] + n, name))
                bounds[s] += n
    plan = df.sparkSession.createDataFrame(rows, "_size long, lo long, hi long, split string")
    ranked = sizes.join(counts.select("_size", "_range", F.coalesce("before", F.lit(0)).alias("before")), ["_size", "_range"])
    ranked = ranked.withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("_size", "_range").orderBy("_h", "_g")) - 1)
    split = ranked.join(plan, (ranked["_size"] == plan["_size"]) & (ranked["rank"] >= plan["lo"]) & (ranked["rank"] < plan["hi"])).select("_g", "split")
    return keyed.join(split, "_g").select(id_col, "group", "split")


def split_report(df: DataFrame, assigned: DataFrame, shares: dict[str, float], id_col: str = "emb_id", zip_col: str = "zip", parcel_col: str = "parcel_id") -> DataFrame:
    """(split, records, target, broken): each split's records, those it should have, and how many zips and parcels it shares with another split.

    ``broken`` is counted anew from df's own columns, a row of which assigned (id, group, split) must know; it is 0 for every split.
    """
    parcel = F.trim(F.col(parcel_col))
    keys = F.array_compact(F.array(F.concat(F.lit("0:"), zip5(F.col(zip_col))), F.when(parcel != "", F.concat(F.lit("1:"), parcel))))
    tied = df.select(id_col, F.explode(keys).alias("key")).join(assigned.select(id_col, "split").distinct(), id_col)
    crossing = tied.groupBy("key").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b")
    broken = crossing.select(F.explode(F.array("a", "b")).alias("split")).groupBy("split").agg(F.count("*").alias("broken"))
    wanted = df.sparkSession.createDataFrame(list(shares.items()), "split string, share double")
    n = assigned.agg(F.count("*").alias("n"))
    rest = max(shares, key=shares.get)
    out = wanted.join(assigned.groupBy("split").agg(F.count("*").alias("records")), "split", "left").join(broken, "split", "left").crossJoin(F.broadcast(n))  # one row
    out = out.withColumn("_t", F.floor(F.col("share") * F.col("n") + 0.5))
    others = out.where(F.col("split") != rest).agg(F.sum("_t").alias("_o"))
    target = F.when(F.col("split") == rest, F.col("n") - F.col("_o")).otherwise(F.col("_t"))
    return out.crossJoin(F.broadcast(others)).select("split", F.coalesce("records", F.lit(0)).alias("records"), target.alias("target"), F.coalesce("broken", F.lit(0)).alias("broken"))  # one row
