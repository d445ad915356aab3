"""The analysis table in full: outcome, embedding and what is known of the place, from listings, parcels, crime, amenities and the census."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotweave.functions.text import classify, zip5
from lotweave.operators.proximity import containing, locate
from lotweave.operators.spatial import counts_around, nearest, nearest_by_category
from lotweave.operators.tabular import dense_columns, hashed_indicators, label_numbers, valid_log_outcome, with_coordinates
from lotweave.session import Scratch
from lotweave.sources.readers import first_existing

CRIMES = ["violent", "property", "quality_of_life", "other"]
AMENITIES = ["food_dining", "retail", "services", "recreation", "transportation", "education"]
PROPERTY = ["bedrooms", "year_built", "bldg_area_sqft", "lot_area_sqft", "units_res"]
#: What is measured of a parcel's surroundings.
CONTEXT = ["income", "home_value", *[f"crime_{c}" for c in [*CRIMES, "total"]], *[f"amenity_{c}" for c in [*AMENITIES, "total"]], "amenity_diversity", *[f"dist_{c}_m" for c in AMENITIES[3:]]]


def load_analysis(spark: SparkSession, folder: str, city: str, model: str | None = None) -> tuple[DataFrame, DataFrame | None] | None:
    """(embeddings, parcels) of a city as its stages wrote them, of a named embedding model if given; the parcels as far as they were enriched, or none; None without embeddings."""
    suffix = "" if model is None else "_" + model.replace("/", "_").replace("-", "_")
    emb = first_existing(spark, [f"{folder}/{city}_embeddings{suffix}.parquet"])
    if emb is None:
        return None
    return emb, first_existing(spark, [f"{folder}/{city}_parcels_{stage}.parquet" for stage in ("micro_geo", "amenities")])


def parcel_context(parcels: DataFrame, crime: DataFrame, amenities: DataFrame, block_groups: DataFrame, scratch: Scratch, crime_m: float = 300.0, amenity_m: float = 500.0) -> DataFrame:
    """(row_id, latitude, longitude, PROPERTY, CONTEXT, crime_temporal_match) of the parcels that have coordinates.

    crime_temporal_match says that the parcel's sale date lies within the incidents' dates; null without a sale date.
    """
    sites = scratch.cut(with_coordinates(parcels).select("row_id", "latitude", "longitude", "sale_date", "geometry", *PROPERTY))
    point = sites.select("row_id", "latitude", "longitude")
    places = with_coordinates(amenities.select("osm_id", "category", "subcategory", "latitude", "longitude").distinct())
    incidents = with_coordinates(crime).select("latitude", "longitude", classify(F.col("offense_desc"), F.col("city")).alias("category"))
    out = sites.drop("geometry").join(counts_around(point, incidents, "row_id", crime_m, "category", CRIMES, "crime_").drop("crime_entropy"), "row_id")
    out = out.join(counts_around(point, places, "row_id", amenity_m, "category", AMENITIES, "amenity_").drop("amenity_entropy"), "row_id")
    out = out.join(counts_around(point, places, "row_id", amenity_m, "subcategory", [], "kind_").select("row_id", F.col("kind_entropy").alias("amenity_diversity")), "row_id")
    out = out.join(nearest_by_category(point, places, "row_id", "category", AMENITIES[3:], scratch), "row_id", "left")
    hit = containing(locate(sites.select("row_id", "latitude", "longitude", "geometry")).select("row_id", "_x", "_y"), block_groups.select("geoid", "geometry"))
    one = hit.groupBy(F.col("p.row_id").alias("row_id")).agg(F.min("t.geoid").alias("geoid"))
    known = lambda c: F.when(F.col(c) >= 0, F.col(c).cast("double"))
    census = block_groups.select("geoid", known("median_household_income").alias("income"), known("median_home_value").alias("home_value"))
    out = out.join(one.join(census, "geoid").drop("geoid"), "row_id", "left")
    dates = crime.agg(F.min("incident_date").alias("_lo"), F.max("incident_date").alias("_hi"))
    out = out.crossJoin(F.broadcast(dates)).withColumn("crime_temporal_match", F.col("sale_date").between(F.col("_lo"), F.col("_hi")))  # one row
    return scratch.cut(out.select("row_id", "latitude", "longitude", *PROPERTY, *CONTEXT, "crime_temporal_match"))


def usable_vector(vector: str) -> Column:
    """Whether a vector is there and has no missing or NaN number."""
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))


def audit_rows(df: DataFrame, vector: str = "emb", price: str = "price", least: int = 30) -> DataFrame:
    """Rows fit for an audit: a whole vector, coordinates and a positive price; none at all if they are fewer than ``least``."""
    there = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    fit = df.where(usable_vector(vector) & there("latitude") & there("longitude") & there(price) & (F.col(price) > 0))
    n = fit.agg(F.count("*").alias("_n"))
    return fit.crossJoin(F.broadcast(n)).where(F.col("_n") >= least).drop("_n")  # one row


@dataclass
class Analysis:
    """rows: id, city, emb, y, label, lat, lon, income, and the confounders ``names``; what is known of how they were chosen."""

    rows: DataFrame
    names: list[str]
    crime_temporal_ok: bool
    crime_dropped: bool


def features_and_target(emb: DataFrame, context: DataFrame | None, scratch: Scratch, drop_mismatched_crime: bool = False, bins: int = 20) -> Analysis:
    """The outcome and all confounders of the listings with a positive price.

    Every listing takes the property and surroundings of the parcel nearest to it, however far. Confounders of which half or more is missing are left out, others' gaps are 0.
    Crime counts are left out, if so asked, where fewer than half of the dated parcels lie in the crime's dates. Without parcels and coordinates, indicators of the zip's
    number by ``bins`` stand in.
    """
    rows = valid_log_outcome(emb.withColumn("price", F.col("price").cast("double")), "price").select(F.col("emb_id").alias("id"), "city", "emb", "y", zip5(F.col("zip")).alias("label"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    ok = True
    names = ["lat", "lon"]
    if context is not None:
        found = context.agg(F.avg(F.col("crime_temporal_match").cast("double")).alias("m")).first()["m"]
        ok = found is None or found >= 0.5
        taken = [*PROPERTY, *[c for c in CONTEXT if not (drop_mismatched_crime and not ok and c.startswith("crime_"))]]
        points = rows.select("id", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
        hit = nearest(points, context.select("row_id", "latitude", "longitude"), "id", "row_id", scratch).select("id", "row_id")
        rows = rows.join(hit.join(context.select("row_id", *taken), "row_id").drop("row_id"), "id", "left")
        names += taken
    rows, names = dense_columns(rows.withColumn("_income", F.col("income") if "income" in rows.columns else F.lit(0.0)), names)
    if not names:
        rows = hashed_indicators(label_numbers(rows, "label", "_z"), "_z", bins, "zip_").drop("_z")
        names = [f"zip_{i}" for i in range(bins)]
    return Analysis(rows.withColumnRenamed("_income", "raw_income"), names, ok, drop_mismatched_crime and not ok)


def study_rows(a: Analysis) -> DataFrame:
    """The rows as the audits take them: id, city, emb, y, w (the confounders as an array), label, lat, lon."""
    return a.rows.where(usable_vector("emb")).select("id", "city", F.transform("emb", lambda x: x.cast("double")).alias("emb"), "y", F.array(*[F.col(n).cast("double") for n in a.names]).alias("w"), "label", "lat", "lon")
