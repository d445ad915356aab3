"""Joining address records on the place they name."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lotweave.llm.addresses import AddressParser, Locale, complete, spelling_distance
from lotweave.llm.splits import zip5
from lotweave.operators.components import connected_components
from lotweave.session import Scratch

#: Names shorter than this are never taken for misspelt ones (main and maine, park and bark are streets of their own), nor
#: names shorter than the second for ones two edits away.
LEAST_LENGTH, LEAST_FOR_TWO = 6, 8
#: Of two spellings, the rarer is a street of its own if it names this many houses or more, and at least a fifth as many as the other.
ESTABLISHED, FIFTH = 5, 5
#: A spelling two edits from another is a slip if it names at most a tenth as many houses, or if neither names more than this many.
TENTH, RARE = 10, 2


def parse_records(records: DataFrame, locale: Locale | None = None) -> DataFrame:
    """(id, city, zip, number, head, side, name, kind) of records(id, number, address, zip, city) that name a place.

    number may be null where the address holds it. Zips come out as five digits (a missing one from the address itself) or null, cities by their usual names.
    """
    loc = locale or Locale()
    schema = "id bigint, city string, zip string, number string, head string, side string, name string, kind string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser, memo = AddressParser(loc), {}
        for b in batches:
            rows = []
            for i, number, address, code, city in zip(b["id"], b["number"], b["address"], b["zip"], b["city"]):
                p = parser.parse(address, number)
                if p.name:
                    c = (city or "").strip().lower()
                    rows.append((i, memo.setdefault(c, loc.cities.get(c, c)), code or p.zip or None, p.number, p.head, p.side, p.name, p.kind))
            yield pd.DataFrame(rows, columns=["id", "city", "zip", "number", "head", "side", "name", "kind"])

    need = records.where("id is not null and address is not null").select("id", "number", "address", zip5(F.col("zip")).alias("zip"), "city")
    return need.mapInPandas(run, schema)


def _without(name: Column, times: int) -> Column:
    """The name and all that is left of it after dropping up to so many letters, as hashes."""

    def drop(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))

    out = F.array_union(F.array(name), drop(name))
    for _ in range(times - 1):
        out = F.array_distinct(F.flatten(F.transform(out, lambda s: F.array_union(F.array(s), drop(s)))))
    return F.transform(out, lambda s: F.xxhash64(s))


@F.pandas_udf(IntegerType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([spelling_distance(x, y) for x, y in zip(a, b)])


def _letters(s: Column) -> Column:
    return F.array_join(F.array_sort(F.split(s, "")), "")


def _swapped(a: Column, b: Column) -> Column:
    """Whether swapping two neighbouring letters of a gives b."""
    return F.exists(F.sequence(F.lit(1), F.length(a) - 1), lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b)


def _one_edit(a: str, b: str) -> Column:
    """Whether two names of two letters or more are at most one edit (insert, drop, replace, swap of neighbours) apart."""
    x, y = F.col(a), F.col(b)
    plain = F.levenshtein(x, y, 2)
    return (plain.between(0, 1)) | ((plain == 2) & (F.length(x) == F.length(y)) & _swapped(x, y))


def _two_edits(pairs: DataFrame) -> DataFrame:
    """Those of pairs(name, other, ...) at most two edits apart.

    Two edits are at most two plain ones, or, where a swap is among them, three or four of which the letters, in order, differ by two at most; only these few are measured in Python.
    """
    plain, letters = F.levenshtein("name", "other", 4), F.levenshtein(_letters(F.col("name")), _letters(F.col("other")), 2)
    kept = pairs.withColumn("_d", plain).where(F.col("_d").between(0, 2) | ((F.col("_d") > 2) & (letters >= 0)))
    return kept.withColumn("_e", _distance("name", "other")).where("_d <= 2 or _e <= 2").drop("_d", "_e")


def _alike(streets: DataFrame, times: int, least: int) -> DataFrame:
    keyed = streets.where(F.length("name") >= least).select("city", "zip", "name", "n", F.explode(_without(F.col("name"), times)).alias("key"))
    other = keyed.select("city", "zip", "key", F.col("name").alias("other"), F.col("n").alias("m"))
    # sizes are guessed before the letters are dropped, so a broadcast could be a hundred times as large as planned
    return keyed.join(other.hint("merge"), ["city", "zip", "key"]).where("name < other").select("city", "zip", "name", "other", "n", "m").distinct()


def _both_ways(pairs: DataFrame) -> DataFrame:
    there = F.struct("name", "other", "n", "m")
    back = F.struct(F.col("other").alias("name"), F.col("name").alias("other"), F.col("m").alias("n"), F.col("n").alias("m"))
    return pairs.select("city", "zip", F.explode(F.array(there, back)).alias("_p")).select("city", "zip", "_p.*")


def same_streets(streets: DataFrame, scratch: Scratch) -> DataFrame:
    """(city, zip, name, root) of streets(city, zip, name, n): spellings of one street in one zip share a root. n counts the different houses a spelling names, so copies of a record don't count.

    A spelling joins that of the most houses a single edit away, if that has more (of equals, the first by letters)
    and isn't another street by ESTABLISHED and FIFTH. A spelling of LEAST_FOR_TWO letters or more that joins none so joins that of the most
    houses two edits away, if it names at most a tenth as many, or, where both are rare since no record has the right spelling, the first by
    letters. Candidates share what is left after dropping letters, so no two names of a zip are
    compared without need; and as each spelling joins one other, slips of two streets don't tie the streets together.
    """
    ahead = F.struct((-F.col("m")).alias("m"), F.col("other"))
    one = _both_ways(_alike(streets, 1, LEAST_LENGTH).where(_one_edit("name", "other")))
    one = one.where(f"(m > n or (m = n and other < name)) and not (n >= {ESTABLISHED} and n * {FIFTH} >= m)")
    joined = scratch.cut(one.groupBy("city", "zip", "name").agg(F.min_by("other", ahead).alias("other")))
    alone = scratch.cut(streets.join(joined.select("city", "zip", "name"), ["city", "zip", "name"], "left_anti"))
    two = _both_ways(_two_edits(_alike(alone, 2, LEAST_FOR_TWO)))
    two = two.where(f"(n * {TENTH} <= m) or (n <= {RARE} and m <= {RARE} and (m > n or (m = n and other < name)))")
    two = two.groupBy("city", "zip", "name").agg(F.min_by("other", ahead).alias("other"))

    def node(c: str) -> Column:
        return F.concat_ws("\u0001", "city", "zip", c)

    edges = joined.unionAll(two).select(node("name").alias("u"), node("other").alias("v"))
    roots = scratch.cut(connected_components(edges, scratch)).select(F.col("node").alias("_n"), "root")
    named = streets.withColumn("_n", node("name")).join(roots, "_n", "left")
    return named.select("city", "zip", "name", F.coalesce("root", "_n").alias("root"))


def find_zips(lost: DataFrame, streets: DataFrame) -> DataFrame:
    """(city, name, zip, root) for names(city, name) of records without a zip, where the street is in one zip of the city only.

    streets(city, zip, name, root). The closest spelling counts. A name found in no zip of its city gets an
    empty zip and is its own root; one found in several zips is left out, for it names no one street.
    """
    near = lost.select("city", "name", F.explode(_without(F.col("name"), 1)).alias("key"))
    known = streets.select("city", F.col("name").alias("other"), "zip", "root", F.explode(_without(F.col("name"), 1)).alias("key"))
    pairs = near.join(known.hint("merge"), ["city", "key"]).select("city", "name", "other", "zip", "root").distinct()
    # names that share a key by dropping one letter each are at most two edits apart
    far = F.when(_one_edit("name", "other"), 1).otherwise(2)
    pairs = pairs.withColumn("d", F.when(F.col("name") == F.col("other"), 0).otherwise(far)).where(f"d = 0 or length(name) >= {LEAST_LENGTH}")
    best = pairs.groupBy("city", "name").agg(F.min("d").alias("d")).join(pairs, ["city", "name", "d"])
    where = best.groupBy("city", "name").agg(F.count_distinct("zip").alias("zips"), F.min("zip").alias("zip"), F.min("root").alias("root"))
    out = lost.join(where, ["city", "name"], "left").where("zips is null or zips = 1")
    return out.select("city", "name", F.coalesce("zip", F.lit("")).alias("zip"), F.coalesce("root", F.concat_ws("\u0001", "city", F.lit(""), "name")).alias("root"))


def complete_variants(variants: DataFrame) -> DataFrame:
    """(root, head, side, kind, full) of variants(root, head, side, kind): ``full`` has the missing parts filled in; see complete().

    A street has at most as many variants as the locale has heads x sides x types.
    """
    schema = "root string, head string, side string, kind string, full string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for root, found in zip(b["root"], b["found"]):
                vs = [(v["head"], v["side"], v["kind"]) for v in found]
                rows += [(root, *v, " ".join(w)) for v, w in zip(vs, complete(vs))]
            yield pd.DataFrame(rows, columns=["root", "head", "side", "kind", "full"])

    return variants.groupBy("root").agg(F.collect_set(F.struct("head", "side", "kind")).alias("found")).mapInPandas(run, schema)


def place_of(records: DataFrame, scratch: Scratch, locale: Locale | None = None) -> DataFrame:
    """(id, place): records of records(id, number, address, zip, city) with the same place name the same place.

    The keys are joined from the largest to the smallest: city and zip; the street in it, over misspellings; its direction,
    type and head, missing ones taken from the street's other records if these leave no choice; the house number, with its
    letter or range. Units, floors, house names and parts of a building make no difference. A record without
    a number or street, or without a zip on a street of several zips, is left out. Repeated ids have a row each.
    """
    parsed = scratch.cut(parse_records(records, locale))
    streets = parsed.where("zip is not null").groupBy("city", "zip", "name").agg(F.count_distinct("number").alias("n"))
    rooted = scratch.cut(same_streets(scratch.cut(streets), scratch))
    lost = parsed.where("zip is null").select("city", "name").distinct()
    found = find_zips(lost, rooted)
    a = parsed.where("zip is not null").join(rooted, ["city", "zip", "name"])
    b = parsed.where("zip is null").drop("zip").join(found, ["city", "name"])
    cols = ["id", "root", "head", "side", "kind", "number"]
    placed = scratch.cut(a.select(*cols).unionAll(b.select(*cols)))
    full = complete_variants(placed.select("root", "head", "side", "kind").distinct())
    return placed.join(full, ["root", "head", "side", "kind"]).select("id", F.concat_ws("\u0001", "root", "full", "number").alias("place"))


def same_place_pairs(places: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of all records of places(id, place) with the same place."""
    a = places.select("place", F.col("id").alias("id_a"))
    b = places.select("place", F.col("id").alias("id_b"))
    return a.join(b, "place").where("id_a < id_b").select("id_a", "id_b").distinct()


def all_records(assessments: DataFrame, listings: DataFrame) -> DataFrame:
    """(id, number, address, zip, city) of both tables."""
    a = assessments.select(F.col("assess_id").alias("id"), F.col("st_num").alias("number"), F.col("st_name").alias("address"), F.col("zipcode").alias("zip"), F.lit("boston").alias("city"))
    return a.unionAll(listings.select(F.col("listing_id").alias("id"), F.lit(None).cast("string").alias("number"), "address", "zip", F.col("city_name").alias("city")))
