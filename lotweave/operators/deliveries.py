"""Messages delivered at least once: keep exactly one delivery of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotweave.operators.components import connected_components
from lotweave.session import Scratch

#: The listing site's host, and how its pages of a home end.
SITE = r"(?:[a-z0-9-]+\.)*listings\.example"
HOME = rf"(?i)^(?:(?:https?:)?//{SITE}(?::\d+)?)?/(?:[^?#]*/)?home/(\d+)/*(?:[?#].*)?$"


def home_of(url: Column) -> Column:
    """The home a url of the listing site leads to, whatever its host, case, slashes, query and fragment; else null."""
    found = F.regexp_extract(F.trim(url), HOME, 1)
    return F.when(found != "", F.regexp_replace(found, "^0+(?=.)", ""))


def message_keys(df: DataFrame) -> DataFrame:
    """df with ``_home`` and ``_place``, the two identifiers of a delivery, null where absent, and ``_loose``.

    ``_home`` is the home its url leads to, or the url itself where that is no home's page.
    ``_place`` is its address (case and amount of white space ignored), city_name and price; a missing part makes it null.
    ``_loose`` says that it has no url, so that its place stands for it.
    """
    url = F.trim(F.regexp_replace("url", r"\s+", " "))
    address = F.lower(F.trim(F.regexp_replace("address", r"\s+", " ")))
    whole = (address != "") & F.col("city_name").isNotNull() & F.col("price").isNotNull() & ~F.isnan("price")
    return df.withColumns(
        {
            "_loose": F.coalesce(url == "", F.lit(True)),
            "_home": F.when(url != "", F.coalesce(F.concat(F.lit("0:"), home_of(url)), F.concat(F.lit("1:"), url))),
            "_place": F.when(whole, F.concat_ws("\u0001", F.lit("2:"), address, "city_name", F.col("price").cast("string"))),
        }
    )


def identify(df: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows, names): df, written once with ``_tag``, unique; and (_tag, delivered_at, delivery_id, _message), the message the same for all its deliveries, null if one has no identifier.

    Only a place that some delivery without a url has can tie deliveries together. Its distinct pairs
    with homes are the edges whose components carry the ties over; all other deliveries keep their own identifier.
    Other columns than those of the identifiers stay out of every join.
    """
    rows = scratch.cut(df.withColumn("_tag", F.monotonically_increasing_id()))
    slim = message_keys(rows.select("_tag", "delivered_at", "delivery_id", "address", "city_name", "price", "url"))
    slim = scratch.cut(slim.select("_tag", "delivered_at", "delivery_id", "_home", "_place", "_loose"))
    live = slim.where("_loose and _place is not null").select("_place").distinct()
    pairs = slim.where("not _loose and _place is not null").select("_home", "_place").distinct()
    edges = pairs.join(live, "_place", "left_semi").select(F.col("_home").alias("u"), F.col("_place").alias("v"))
    roots = connected_components(edges, scratch).select(F.col("node").alias("_key"), "root")
    keyed = slim.select("_tag", "delivered_at", "delivery_id", F.coalesce("_home", "_place").alias("_key"))
    tied = keyed.join(scratch.cut(roots), "_key", "left")
    return rows, scratch.cut(tied.select("_tag", "delivered_at", "delivery_id", F.coalesce("root", "_key").alias("_message")))


def split_deliveries(df: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): exactly one delivery of each message, and all other deliveries, with df's columns.

    df has delivery_id, delivered_at, address, city_name, price, url, and any others. Kept is the delivery
    with the smallest delivered_at (missing ones last), then the smallest delivery_id, then any of equal rows.
    A delivery without url and place is a message of its own. Empty tables give empty tables.

    Identifiers are split by their aggregated frequency: those of one delivery pass as they are, only
    repeated ones are ranked, and the rest of both is what is kept. The rank needed is the first, so it is a
    minimum, which is aggregated before the shuffle and never gathers a hot message in one task.
    """
    rows, names = identify(df, scratch)
    order = F.struct(F.col("delivered_at").isNull(), "delivered_at", F.col("delivery_id").isNull(), "delivery_id", "_tag")
    counts = names.where("_message is not null").groupBy("_message").agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    repeated = counts.where("_n > 1").select("_message", F.col("_first._tag").alias("_keep"))
    later = scratch.cut(names.select("_message", "_tag").join(repeated, "_message").where("_tag <> _keep").select("_tag"))
    return rows.join(later, "_tag", "left_anti").select(*df.columns), rows.join(later, "_tag", "left_semi").select(*df.columns)


def fold_batch(stored: DataFrame, batch: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) of all stored and newly arrived deliveries together, whichever arrived first."""
    return split_deliveries(stored.unionByName(batch), scratch)
