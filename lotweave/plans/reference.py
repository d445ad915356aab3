"""Queries of the reference's own operators over the test tables, and SQL to hold them against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotweave.functions import text as tx
from lotweave.functions.geo import rings_area, rings_centroid, wkt_polygons
from lotweave.operators import audit as au
from lotweave.operators import counterfactual as cf
from lotweave.operators import estimate as es
from lotweave.operators import identification as idn
from lotweave.operators import spatial as sp
from lotweave.operators import tabular as tb
from lotweave.operators import temporal as tm
from lotweave.operators import vocabulary as vo
from lotweave.operators.proximity import containing, locate
from lotweave.session import Scratch
from lotweave.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
AMENITIES = ["food_dining", "retail", "services", "recreation", "transportation", "education"]
NEAR_M, FAR_M = 300.0, 500.0


def query(sql: str | None = None):
    """Register a query under its name, with SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _sites(spark: SparkSession, folder: str) -> DataFrame:
    return tb.with_coordinates(table(spark, folder, "parcels")).select("row_id", "latitude", "longitude")


def _amenities(spark: SparkSession, folder: str) -> DataFrame:
    return tb.with_coordinates(table(spark, folder, "amenities").select("osm_id", "category", "subcategory", "latitude", "longitude").distinct())


#: SQL of the distance on a sphere between p and t.
_M = "2 * 6371000 * asin(sqrt(pow(sin(radians(t.latitude - p.latitude) / 2), 2) + cos(radians(p.latitude)) * cos(radians(t.latitude)) * pow(sin(radians(t.longitude - p.longitude) / 2), 2)))"
_SITES = "sites as (select row_id, latitude, longitude from parcels where latitude is not null and longitude is not null and latitude <> 0 and longitude <> 0)"
_PLACES = "places as (select distinct osm_id, category, subcategory, latitude, longitude from amenities where latitude is not null and longitude is not null and latitude <> 0 and longitude <> 0)"


def _crosswalk_sql() -> str:
    whens = []
    for category, cities in tx.OFFENCES.items():
        hits = [f"(city = '{c}' and ({' or '.join(f'contains(upper(trim(offense_desc)), {chr(39)}{t}{chr(39)})' for t in terms)}))" for c, terms in cities.items()]
        whens.append(f"when {' or '.join(hits)} then '{category}'")
    return "case " + " ".join(whens) + " else 'other' end"


# ---- spatial enrichment


@query(f"""
with {_SITES}, inc as (select latitude, longitude, {_crosswalk_sql()} as category from crime where latitude <> 0 and longitude <> 0),
pair as (select p.row_id, t.category from sites p join inc t on abs(t.latitude - p.latitude) < 0.004 where {_M} <= {NEAR_M}),
c as (select row_id, category, count(*) as k from pair group by all),
g as (select row_id, sum(k) filter (category = 'violent') as violent, sum(k) filter (category = 'property') as property, sum(k) filter (category = 'quality_of_life') as quality_of_life, sum(k) filter (category = 'other') as other, sum(k) as total, ln(sum(k)) - sum(k * ln(k)) / sum(k) as entropy from c group by row_id)
select sites.row_id, coalesce(violent, 0)::bigint as crime_violent, coalesce(property, 0)::bigint as crime_property, coalesce(quality_of_life, 0)::bigint as crime_quality_of_life, coalesce(other, 0)::bigint as crime_other, coalesce(total, 0)::bigint as crime_total, abs(round(coalesce(entropy, 0), 6)) as crime_entropy from sites left join g using (row_id)
""")
def radius_enrich(spark, folder):
    incidents = tb.with_coordinates(table(spark, folder, "crime")).select("latitude", "longitude", tx.classify(F.col("offense_desc"), F.col("city")).alias("category"))
    out = sp.counts_around(_sites(spark, folder), incidents, "row_id", NEAR_M, "category", ["violent", "property", "quality_of_life", "other"], "crime_")
    return out.withColumn("crime_entropy", F.abs(F.round("crime_entropy", 6)))


@query(f"""
with {_SITES}, {_PLACES}, pair as (select p.row_id, coalesce(t.category, '') as category, coalesce(t.subcategory, '') as sub from sites p join places t on abs(t.latitude - p.latitude) < 0.006 where {_M} <= {FAR_M}),
g as (select row_id, {', '.join(f"count(*) filter (category = '{c}') as {c}" for c in AMENITIES)}, count(*) as total from pair group by row_id),
s as (select row_id, ln(sum(k)) - sum(k * ln(k)) / sum(k) as h from (select row_id, sub, count(*) as k from pair group by all) group by row_id)
select sites.row_id, {', '.join(f'coalesce({c}, 0) as amenity_{c}' for c in AMENITIES)}, coalesce(total, 0) as amenity_total, round(coalesce(total, 0) / (pi() * 0.25), 6) as amenity_total_density, abs(round(coalesce(h, 0), 6)) as amenity_diversity
from sites left join g using (row_id) left join s using (row_id)
""")
def amenity_diversity(spark, folder):
    sites, places = _sites(spark, folder), _amenities(spark, folder)
    counts = sp.counts_around(sites, places, "row_id", FAR_M, "category", AMENITIES, "amenity_").drop("amenity_entropy")
    kinds = sp.counts_around(sites, places, "row_id", FAR_M, "subcategory", [], "kind_").select("row_id", F.abs(F.round("kind_entropy", 6)).alias("amenity_diversity"))
    return rounded(sp.densities(counts, ["amenity_total"], FAR_M / 1000).join(kinds, "row_id"), "amenity_total_density")


@query(f"""
with {_SITES}, {_PLACES}, d as (select p.row_id, {', '.join(f"min({_M}) filter (category = '{c}') as dist_{c}_m" for c in ('recreation', 'transportation', 'education'))} from sites p, places t group by p.row_id)
select row_id, {', '.join(f'round(dist_{c}_m, 3) as dist_{c}_m' for c in ('recreation', 'transportation', 'education'))} from d
""")
def nearest_amenity(spark, folder):
    kinds = ["recreation", "transportation", "education"]
    out = sp.nearest_by_category(_sites(spark, folder), _amenities(spark, folder), "row_id", "category", kinds, Scratch(spark))
    return rounded(out, *[f"dist_{c}_m" for c in kinds], digits=3)


@query(f"""
with {_SITES}, l as (select listing_id, latitude, longitude from listings where latitude is not null and longitude is not null),
r as (select p.listing_id, t.row_id, {_M} as m, row_number() over (partition by p.listing_id order by {_M}, t.row_id) as k from l p, sites t)
select listing_id, row_id, round(m, 3) as metres, year_built, assessed_total from r join parcels using (row_id) where k = 1
""")
def nearest_transfer(spark, folder):
    listings = table(spark, folder, "listings").select("listing_id", "latitude", "longitude")
    donors = tb.with_coordinates(table(spark, folder, "parcels")).select("row_id", "latitude", "longitude", "year_built", "assessed_total")
    return rounded(sp.take_over(listings, donors, "listing_id", "row_id", ["year_built", "assessed_total"], Scratch(spark)), "metres", digits=3)


@query(f"""
with l as (select listing_id, latitude, longitude from listings where latitude is not null and longitude is not null),
r as (select p.listing_id, t.listing_id as other_id, {_M} as m, row_number() over (partition by p.listing_id order by {_M}, t.listing_id) as rank from l p, l t where p.listing_id <> t.listing_id)
select listing_id, other_id, round(m, 3) as metres, rank from r where rank <= 5
""")
def five_nearest(spark, folder):
    listings = table(spark, folder, "listings").select("listing_id", "latitude", "longitude")
    others = listings.withColumnRenamed("listing_id", "other_id")
    return rounded(sp.nearest(listings, others, "listing_id", "other_id", Scratch(spark), k=5, skip_self=True), "metres", digits=3)


@query(f"""
with {_SITES}, s as (select row_id, city, latitude, longitude from parcels join sites using (row_id, latitude, longitude)),
g as (select p.city, p.row_id, min({_M}) as m from s p join s t on p.city = t.city and p.row_id <> t.row_id group by all)
select city, count(*) as n, round(avg(m), 3) as mean_gap_m from g group by city
""")
def mean_gap_by_city(spark, folder):
    points = tb.with_coordinates(table(spark, folder, "parcels")).select("row_id", "city", "latitude", "longitude")
    return rounded(sp.mean_gap_by_group(points, "row_id", "city", Scratch(spark)), "mean_gap_m", digits=3)


@query("""
with ring as (select geoid, part, string_split(trim(part, '()'), ',') as pts from (select geoid, unnest(regexp_extract_all(geometry, '[(]?[(][^()]+[)]')) as part from block_groups)),
pt as (select geoid, part, generate_subscripts(pts, 1) as i, trim(unnest(pts)) as p from ring),
xy as (select geoid, part, i, string_split(p, ' ')[1]::double as x, string_split(p, ' ')[2]::double as y from pt),
edge as (select geoid, x as x0, y as y0, lead(x) over w as x1, lead(y) over w as y1 from xy window w as (partition by geoid, part order by i)),
inside as (select row_id, geoid from parcels join edge on x1 is not null and ((y0 > latitude) <> (y1 > latitude)) and longitude < (x1 - x0) * (latitude - y0) / (y1 - y0) + x0
  where latitude is not null and longitude is not null group by all having count(*) % 2 = 1),
one as (select row_id, min(geoid) as geoid from inside group by row_id)
select row_id, geoid, case when median_household_income >= 0 then median_household_income end as income, round(median_home_value / nullif(race_total, 0), 6) as value_per_head
from parcels left join one using (row_id) left join block_groups using (geoid)
""")
def census_attributes(spark, folder):
    parcels = table(spark, folder, "parcels")
    located = locate(parcels.where("latitude is not null and longitude is not null").select("row_id", "latitude", "longitude", "geometry")).select("row_id", "_x", "_y")
    groups = table(spark, folder, "block_groups")
    hit = containing(located, groups.select("geoid", "geometry")).groupBy(F.col("p.row_id").alias("row_id")).agg(F.min("t.geoid").alias("geoid"))
    attrs = tb.ratios(groups, {"value_per_head": ("median_home_value", "race_total")}).select("geoid", F.when(F.col("median_household_income") >= 0, F.col("median_household_income")).alias("income"), "value_per_head")
    return rounded(parcels.select("row_id").join(hit, "row_id", "left").join(attrs, "geoid", "left"), "value_per_head").select("row_id", "geoid", "income", "value_per_head")


@query("""
with ring as (select geoid, part, starts_with(part, '((') as outer_ring, string_split(trim(part, '()'), ',') as pts from (select geoid, unnest(regexp_extract_all(geometry, '[(]?[(][^()]+[)]')) as part from block_groups)),
pt as (select geoid, part, outer_ring, generate_subscripts(pts, 1) as i, trim(unnest(pts)) as p from ring),
xy as (select geoid, part, outer_ring, i, string_split(p, ' ')[1]::double as x, string_split(p, ' ')[2]::double as y from pt),
o as (select geoid, min(x) as ox, min(y) as oy from xy group by 1),
edge as (select geoid, part, outer_ring, x - ox as x0, y - oy as y0, lead(x) over w - ox as x1, lead(y) over w - oy as y1, ox, oy from xy join o using (geoid) window w as (partition by geoid, part order by i)),
m as (select geoid, part, case when outer_ring then 1 else -1 end as sg, sum(x0 * y1 - x1 * y0) / 2 as a, sum((x0 + x1) * (x0 * y1 - x1 * y0)) / 6 as mx, sum((y0 + y1) * (x0 * y1 - x1 * y0)) / 6 as my, any_value(ox) as ox, any_value(oy) as oy from edge where x1 is not null group by all)
select geoid, round(sum(sg * abs(a)) * 1e6, 3) as area_e6, round(sum(sg * sign(a) * mx) / sum(sg * abs(a)) + any_value(ox), 6) as x, round(sum(sg * sign(a) * my) / sum(sg * abs(a)) + any_value(oy), 6) as y from m group by geoid
""")
def polygon_measures(spark, folder):
    shapes = table(spark, folder, "block_groups").select("geoid", wkt_polygons(F.col("geometry")).alias("r")).where("r is not null")
    shapes = shapes.select("geoid", F.round(rings_area(F.col("r")) * 1e6, 3).alias("area_e6"), rings_centroid(F.col("r")).alias("c"))
    return shapes.where("area_e6 > 0").select("geoid", "area_e6", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"))


@query("""
with e as (select min(latitude) a0, max(latitude) a1, min(longitude) o0, max(longitude) o1 from listings),
l as (select greatest(ceil((latitude - a0) / ((a1 - a0) / 20)), 1)::int - 1 as a, greatest(ceil((longitude - o0) / ((o1 - o0) / 20)), 1)::int - 1 as o from listings, e where latitude is not null and longitude is not null)
select least(a, 19) || '_' || least(o, 19) as cell, count(*) as n from l group by 1
""")
def grid_cells(spark, folder):
    rows = table(spark, folder, "listings").where("latitude is not null and longitude is not null")
    return sp.grid_labels(rows).groupBy("cell").agg(F.count("*").alias("n"))


# ---- cleaning, deduplication, joins, set operations


@query("select incident_id, offense_desc, loaded_at from crime where incident_id is not null qualify row_number() over (partition by incident_id order by loaded_at desc nulls last, offense_desc desc nulls last) = 1")
def last_load(spark, folder):
    rows = table(spark, folder, "crime").select("incident_id", "offense_desc", "loaded_at")
    return tb.keep_last(rows, ["incident_id"], [F.col("loaded_at"), F.col("offense_desc")])


@query("select trim(parcel_id) as parcel_id, row_id from parcels where trim(parcel_id) <> '' qualify row_number() over (partition by trim(parcel_id) order by row_id) = 1")
def clean_parcel_ids(spark, folder):
    return tb.clean_ids(table(spark, folder, "parcels").select("parcel_id", "row_id"), "parcel_id", [F.col("row_id")])


@query("""
with s as (select o_custkey, o_orderdate, o_orderkey, try_cast(translate('$' || (o_totalprice::decimal(18, 2))::varchar, '$,', '') as double) as price from orders)
select c_custkey, price as last_price, o_orderdate as last_date from customer left join (select * from s where price > 0 qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1) on c_custkey = o_custkey
""")
def latest_sale(spark, folder):
    text = F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    sales = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate", tb.number(text).alias("price")).where("price > 0")
    last = tb.keep_last(sales, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    out = tb.left_join_one(table(spark, folder, "customer").select("c_custkey"), last, {"c_custkey": "o_custkey"}, ["price", "o_orderdate"], [F.col("price")])
    return out.select("c_custkey", F.col("price").alias("last_price"), F.col("o_orderdate").alias("last_date"))


@query("""
select row_id, case when bldg_area_sqft is not null and not isnan(bldg_area_sqft) then least(greatest(round_even(bldg_area_sqft / coalesce(nullif(units_res, 0), 1) / 350, 0), 1), 8) end as rooms, true as imputed from parcels
""")
def rooms_estimated(spark, folder):
    return table(spark, folder, "parcels").select("row_id", tb.rooms_from_area(F.col("bldg_area_sqft"), F.col("units_res")).alias("rooms"), F.lit(True).alias("imputed"))


@query("""
select row_id, case when year_built between 1700 and 2026 then year_built end as year_built, case when not isnan(sale_price) then sale_price end as sale_price from parcels
where sale_price is null or isnan(sale_price) or sale_price between 200000 and 5000000
""")
def ranges_kept(spark, folder):
    rows = tb.keep_range(table(spark, folder, "parcels").select("row_id", "year_built", "sale_price"), "sale_price", 200_000, 5_000_000)
    return rows.select("row_id", tb.between_or_null("year_built", 1700, 2026).alias("year_built"), tb.number("sale_price").alias("sale_price"))


@query("select assess_id, try_cast(replace(replace(trim(st_num), '$', ''), ',', '') as double) as st_num, case when not isnan(living_area) then living_area end as living_area, case when length(trim(pid)) < 10 then lpad(trim(pid), 10, '0') else trim(pid) end as pid from boston_assessment")
def numbers_cleaned(spark, folder):
    rows = tb.clean_numbers(table(spark, folder, "boston_assessment").select("assess_id", "st_num", "living_area", "pid"), ["st_num", "living_area", "absent"])
    return rows.withColumn("pid", tb.pad_id(F.col("pid")))


@query("""
with u as (select url, address, price, 0 as age from listings union all select url, address, price, 1 from search_results)
select url, address, price from u where url is not null qualify row_number() over (partition by url order by age, address nulls first, price nulls first) = 1
""")
def union_dedup(spark, folder):
    a = table(spark, folder, "listings").select("url", "address", "price", F.lit(0).alias("age"))
    b = table(spark, folder, "search_results").select("url", "address", "price", F.lit(1).alias("age"))
    return tb.union_distinct([a, b], ["url"], [F.col("age"), F.col("address"), F.col("price")]).select("url", "address", "price")


@query("select land_use, count(*) as n from parcels where (land_use not in ('CD', 'A') or land_use is null) and latitude is not null and longitude is not null and latitude <> 0 and longitude <> 0 group by 1")
def filtered_counts(spark, folder):
    rows = tb.with_coordinates(tb.where_flag(table(spark, folder, "parcels"), "active", True)).where(tb.not_in("land_use", ["CD", "A"]))
    return rows.groupBy("land_use").agg(F.count("*").alias("n"))


@query("select land_use, count(*) as n from parcels where land_use in (select land_use from parcels group by 1 having count(*) >= 50) group by 1")
def frequent_classes(spark, folder):
    return tb.frequent_classes(table(spark, folder, "parcels").select("land_use"), "land_use", 50).groupBy("land_use").agg(F.count("*").alias("n"))


@query("select o_orderkey, o_orderdate from orders where o_orderdate = (select max(o_orderdate) from orders)")
def latest_roll(spark, folder):
    return tb.latest_only(table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")


@query("select p.row_id, " + ", ".join(f"case when z is null then null else (z % 5 = {i})::int end as zip_{i}" for i in range(5)) + " from parcels p left join (select zip, dense_rank() over (order by zip) - 1 as z from (select distinct zip from parcels where zip is not null)) using (zip)")
def zip_indicators(spark, folder):
    rows = tb.label_numbers(table(spark, folder, "parcels").select("row_id", "zip"), "zip", "z")
    return tb.hashed_indicators(rows, "z", 5, "zip_").drop("zip", "z")


@query("""
select name, count(p.price) as n, round(avg(p.price), 4) as mean from (values ('wide', 25000, 25000000), ('middle', 200000, 5000000), ('narrow', 400000, 1500000)) b(name, lo, hi) left join listings p on p.price between lo and hi group by name
""")
def threshold_sweep(spark, folder):
    bounds = [("wide", 25_000, 25_000_000), ("middle", 200_000, 5_000_000), ("narrow", 400_000, 1_500_000)]
    return rounded(tb.threshold_counts(table(spark, folder, "listings"), "price", bounds), "mean", digits=4)


@query("select count(*) as n, round(avg(ln(sale_price)), 6) as mean_y, round(avg(coalesce(case when not isnan(lot_area_sqft) then lot_area_sqft end, 0)), 4) as mean_lot from parcels where sale_price > 0 and not isnan(sale_price)")
def outcome_features(spark, folder):
    rows, kept = tb.dense_columns(table(spark, folder, "parcels"), ["lot_area_sqft", "bldg_area_sqft"])
    rows = tb.valid_log_outcome(rows, tb.first_column(rows, ["close_price", "sale_price"]))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("mean_y"), F.round(F.avg("lot_area_sqft" if "lot_area_sqft" in kept else F.lit(None)), 4).alias("mean_lot"))


@query("select emb_id, city, " + ", ".join(f"emb[{i + 1}] as emb_{i}" for i in range(32)) + " from listing_embeddings")
def release_panel(spark, folder):
    return tb.release(table(spark, folder, "listing_embeddings"), ["parcel_id", "zip", "latitude", "longitude", "price"], "emb", size=32)


# ---- time


@query("""
with p as (select *, lag(o_totalprice) over w as v, lag(m) over w as d from (select o_custkey, o_orderdate, o_orderkey, o_totalprice, date_trunc('month', o_orderdate)::date as m from orders) window w as (partition by o_custkey order by o_orderdate, o_orderkey))
select o_custkey, o_totalprice as event_value, strftime(m, '%Y-%m-%d') as event_date from p where m is distinct from d and o_totalprice > 0 and abs((o_totalprice - v) / nullif(v, 0)) > 0.05 qualify row_number() over (partition by o_custkey order by m desc, o_orderdate desc, o_orderkey desc) = 1
""")
def inferred_sales(spark, folder):
    panel = table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice", F.trunc("o_orderdate", "month").alias("m"))
    found = tm.inferred_events(panel, "o_custkey", ["o_orderdate", "o_orderkey"], "m", "o_totalprice")
    return found.withColumn("event_date", F.date_format("event_date", "yyyy-MM-dd"))


@query("""
with d as (select row_id, row_number() over (order by sale_date, row_id) - 1 as r, count(*) over () as n from parcels where sale_date is not null)
select row_id, case when r < floor(n * 0.7) then 'train' when r < floor(n * 0.85) then 'validation' else 'test' end as split from d union all select row_id, 'train' from parcels where sale_date is null
""")
def temporal_split(spark, folder):
    return tm.temporal_split(table(spark, folder, "parcels").select("row_id", "sale_date"), "sale_date", "row_id", Scratch(spark)).select("row_id", "split")


@query("""
with d as (select row_id, row_number() over (partition by city order by sale_date, row_id) - 1 as r, count(*) over (partition by city) as n from parcels where sale_date is not null and city is not null)
select row_id, case when r >= n - floor(n * 0.15) then 'test' when r >= n - 2 * floor(n * 0.15) then 'val' else 'train' end as split from d
""")
def release_split(spark, folder):
    return tm.split_within(table(spark, folder, "parcels").select("row_id", "city", "sale_date"), "city", "sale_date", "row_id").select("row_id", "split")




@query("""
with a as (select median(epoch_us(sale_date)) + 1400 * 86400000000::bigint as e from parcels), f as (select city, epoch_us(incident_date) between cast(e as bigint) - 365 * 86400000000::bigint and cast(e as bigint) as hit from crime, a where incident_date is not null)
select city, count(*) as n, count(*) filter (hit) as n_in_window from f where hit or not (select count(*) filter (hit) > 1000 from f) group by 1
""")
def incident_window(spark, folder):
    anchors = table(spark, folder, "parcels").select((F.col("sale_date") + F.expr("interval 1400 days")).alias("at"))
    events = table(spark, folder, "crime").select("city", "incident_date")
    return tm.trailing_window(events, "incident_date", anchors, "at").groupBy("city").agg(F.count("*").alias("n"), F.count_if("in_window").alias("n_in_window"))


@query("""
with l as (select city, 'year_built' as measure, year_built::double as v from parcels where year_built is not null union all select city, 'lot_area_sqft', lot_area_sqft from parcels where lot_area_sqft is not null and not isnan(lot_area_sqft)),
s as (select measure, min(v) as lo, max(v) as hi from l group by 1),
b as (select measure, city, least(floor((v - lo) / (hi - lo) * 20)::int + 1, 20) as bin, count(*) as k from l join s using (measure) where city is not null group by all),
g as (select measure, city, bin, coalesce(k, 0) as k from (select distinct measure, city from b) cross join (select unnest(range(1, 21)) as bin) left join b using (measure, city, bin)),
d as (select measure, city, bin, k / sum(k) over (partition by measure, city) / ((hi - lo) / 20) + 1e-10 as q from g join s using (measure)),
q as (select measure, city, bin, q / sum(q) over (partition by measure, city) as q from d)
select measure, a.city as part_a, b.city as part_b, round(sqrt(greatest(sum(a.q * ln(a.q / ((a.q + b.q) / 2)) + b.q * ln(b.q / ((a.q + b.q) / 2))) / 2, 0)), 4) as js_distance from q a join q b using (measure, bin) where a.city < b.city group by all
""")
def drift_between_cities(spark, folder):
    return rounded(tm.drift(table(spark, folder, "parcels"), "city", ["year_built", "lot_area_sqft"]), "js_distance", digits=4)


# ---- texts


@query(f"select coalesce(city, '?') as city, {_crosswalk_sql()} as category, count(*) as n from crime group by all")
def classify_terms(spark, folder):
    rows = table(spark, folder, "crime").select(F.coalesce("city", F.lit("?")).alias("city"), tx.classify(F.col("offense_desc"), F.col("city")).alias("category"))
    return rows.groupBy("city", "category").agg(F.count("*").alias("n"))


_KINDS = "UNIT|APT|STE|SUITE|FL|FLOOR|RM|ROOM|PH"


def _normal_sql(c: str) -> str:
    t = rf"regexp_replace(regexp_replace(trim(upper({c})), '\s*[#,]\s*({_KINDS})?\s*\S*$', ''), '\s+({_KINDS})\s+\S*$', '')"
    for a, b in [*zip("NSEW", ("NORTH", "SOUTH", "EAST", "WEST")), *[(a.upper(), b.upper()) for a, b in tx.SUFFIXES.items()]]:
        t = rf"regexp_replace({t}, '\b{a}\b', '{b}', 'g')"
    return rf"coalesce(regexp_replace(trim(regexp_replace({t}, '\s+', ' ', 'g')), '\.+$', ''), '')"


@query(f"select listing_id, {_normal_sql('address')} as norm from listings")
def normalize_address(spark, folder):
    return table(spark, folder, "listings").select("listing_id", tx.normalize_address(F.col("address")).alias("norm"))


@query(f"""
with known as (select norm, max_by(latitude, delivery_id) as lat, max_by(longitude, delivery_id) as lon from (select delivery_id, latitude, longitude, {_normal_sql('address')} as norm from search_results where latitude is not null and longitude is not null) where length(norm) > 3 group by norm),
want as (select listing_id, zip, norm, array_to_string(string_split(norm, ' ')[1:2], ' ') as prefix, len(string_split(norm, ' ')) as parts from (select listing_id, zip, {_normal_sql('address')} as norm from listings where latitude is null or longitude is null)),
pre as (select w.listing_id, min(k.lat) as lat, min(k.lon) as lon from want w join known k on starts_with(k.norm, w.prefix) where parts >= 2 group by 1 having count(*) = 1),
centre as (select zip, avg(latitude) as lat, avg(longitude) as lon from listings where latitude is not null and longitude is not null and zip is not null group by 1)
select w.listing_id, case when k.norm is not null then 'exact' when pre.listing_id is not null then 'prefix' when c.zip is not null then 'zip' else 'none' end as how, round(coalesce(k.lat, pre.lat, c.lat), 6) as latitude, round(coalesce(k.lon, pre.lon, c.lon), 6) as longitude
from want w left join known k on w.norm = k.norm left join pre using (listing_id) left join centre c on w.zip = c.zip
""")
def address_lookup(spark, folder):
    found = tb.with_coordinates(table(spark, folder, "search_results")).select("delivery_id", "latitude", "longitude", tx.normalize_address(F.col("address")).alias("norm")).where(F.length("norm") > 3)
    known = found.groupBy("norm").agg(F.max_by(F.struct("latitude", "longitude"), "delivery_id").alias("k"))
    rows = table(spark, folder, "listings")
    want = rows.where("latitude is null or longitude is null").select("listing_id", "zip", tx.normalize_address(F.col("address")).alias("norm"))
    want = want.withColumns({"parts": F.size(F.split("norm", " ")), "prefix": F.concat_ws(" ", F.slice(F.split("norm", " "), 1, 2)), "first": F.element_at(F.split("norm", " "), 1)})
    # a longer name starts with the prefix only if its first word does, so the first word is the key
    by_first = known.select(F.element_at(F.split("norm", " "), 1).alias("first"), F.col("norm").alias("other"), "k")
    hits = want.where("parts >= 2").select("listing_id", "prefix", "first").join(by_first, "first").where(F.startswith("other", "prefix"))
    pre = hits.groupBy("listing_id").agg(F.count("*").alias("c"), F.min("k").alias("p")).where("c = 1").drop("c")
    centre = rows.where("latitude is not null and longitude is not null and zip is not null").groupBy("zip").agg(F.struct(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude")).alias("z"))
    out = want.join(known, "norm", "left").join(pre, "listing_id", "left").join(centre, "zip", "left")
    how = F.when(F.col("k").isNotNull(), "exact").when(F.col("p").isNotNull(), "prefix").when(F.col("z").isNotNull(), "zip").otherwise("none")
    at = F.coalesce("k", "p", "z")
    return out.select("listing_id", how.alias("how"), F.round(at["latitude"], 6).alias("latitude"), F.round(at["longitude"], 6).alias("longitude"))


def _clean_sql(c: str) -> str:
    t = rf"lower(trim(regexp_replace(regexp_replace({c}, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')))"
    for a, b in [*tx.CONTRACTIONS, *[(p, "") for p in tx.BOILERPLATE]]:
        t = f"replace({t}, '{a.replace(chr(39), chr(39) * 2)}', '{b}')"
    return f"coalesce(trim(regexp_replace({t}, '{tx.ADDRESS}', '[ADDRESS]', 'g')), '')"


@query(f"select listing_id, {_clean_sql('description')} as clean from listings")
def clean_descriptions(spark, folder):
    return table(spark, folder, "listings").select("listing_id", tx.clean_description(F.col("description")).alias("clean"))


def _slot_sql(c: str, patterns: list[str]) -> str:
    t = f"regexp_replace(coalesce({c}, ''), '[–—]', '-', 'g')"
    words = "[" + ", ".join(f"'{w}'" for w in tx.NUMBER_WORDS) + "]"
    parts = []
    for p in patterns:
        m = f"replace(lower(regexp_extract({t}, '(?i){p}', 1)), ',', '')"
        parts.append(f"coalesce(try_cast(nullif({m}, '') as double), nullif(list_position({words}, {m}), 0)::double)")
    return f"coalesce({', '.join(parts)})"


@query("select listing_id, " + ", ".join(f"{_slot_sql('description', ps)} as {s}" for s, ps in tx.SLOTS.items()) + " from listings")
def extract_slots(spark, folder):
    return table(spark, folder, "listings").select("listing_id", tx.slots(F.col("description")).alias("s")).select("listing_id", "s.*")


@query(
    "with p as (select d.doc_id, " + ", ".join(f"{_slot_sql('d.text', ps)} as a_{s}, {_slot_sql('l.description', ps)} as b_{s}" for s, ps in tx.SLOTS.items()) + " from documents d join listings l using (listing_id)) select doc_id, "
    + ", ".join(f"coalesce(abs(a_{s} - b_{s}) < 1e-6, true) as {s}" for s in tx.SLOTS) + " from p"
)
def slots_agree(spark, folder):
    d = table(spark, folder, "documents").where("listing_id is not null").select("doc_id", "listing_id", tx.slots(F.col("text")).alias("a"))
    rows = d.join(table(spark, folder, "listings").select("listing_id", tx.slots(F.col("description")).alias("b")), "listing_id")
    return rows.select("doc_id", tx.slots_match(F.col("a"), F.col("b")).alias("m")).select("doc_id", "m.*")


def _places_sql(c: str) -> str:
    t = f"lower(coalesce({c}, ''))"
    for p in tx.PLACE_WORDS:
        t = rf"regexp_replace({t}, '\b{p}\b', '', 'g')"
    return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"


@query(rf"""
with t as (select listing_id, {_places_sql('description')} as ablated, trim(regexp_replace(lower(coalesce(description, '')), '\s+', ' ', 'g')) as whole from listings)
select listing_id, ablated, case when whole = '' then 0 else len(string_split(whole, ' ')) end - case when ablated = '' then 0 else len(string_split(ablated, ' ')) end as removed from t
""")
def ablate_places(spark, folder):
    rows = table(spark, folder, "listings").select("listing_id", F.coalesce("description", F.lit("")).alias("d"), tx.without_places(F.col("description")).alias("ablated"))
    return rows.select("listing_id", "ablated", (tx.n_words(F.col("d")) - tx.n_words(F.col("ablated"))).alias("removed"))


_VOCAB = r"list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]{3,}')))"


@query(
    f"with w as (select unnest({_VOCAB}) as word from documents where text is not null), c as (select word, count(*) as df from w group by 1 order by 2 desc, 1 limit 200) select word, df, case "
    + " ".join(f"when word in ({', '.join(chr(39) + x + chr(39) for x in ws)}) then '{n}'" for n, ws in tx.WORD_CLASSES.items())
    + " else 'generic_other' end as class from c"
)
def word_classes(spark, folder):
    df = vo.words_of(table(spark, folder, "documents"), "text", []).groupBy("word").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "word").limit(200)
    return df.withColumn("class", tx.word_class(F.col("word")))


@query(f"""
with d as (select source as l, {_VOCAB} as w from documents where source is not null and text is not null), n as (select count(*) as n from d), bl as (select l, count(*) as nl from d group by 1),
e as (select l, unnest(w) as word from d), k as (select word, l, count(*) as k from e group by all), f as (select word, sum(k) as df from k group by 1 having sum(k) >= 5),
g as (select f.word, f.df, bl.l, bl.nl, coalesce(k.k, 0) as k from f cross join bl left join k on k.word = f.word and k.l = bl.l),
s as (select word, any_value(df)::bigint as df, -sum(case when k > 0 then k / df * ln(k / df) else 0 end) as h1, -sum(case when nl > k then (nl - k) / (n - df) * ln((nl - k) / (n - df)) else 0 end) as h0, -sum(nl / n * ln(nl / n)) as h, any_value(n) as n from g, n group by word)
select word, df, round(h - df / n * h1 - (n - df) / n * h0, 6) as gain from s order by round(h - df / n * h1 - (n - df) / n * h0, 9) desc, word limit 100
""")
def label_words(spark, folder):
    return rounded(vo.information_gain(table(spark, folder, "documents"), "text", "source"), "gain")


@query(r"""
with t as (select doc_id, text, regexp_extract_all(text, '([A-Za-z][A-Za-z''-]*)', 1) as w from documents where text is not null),
m as (select doc_id, text, w, len(w)::double as n, greatest(len(regexp_extract_all(text, '([.!?]+)(?:\s|$)', 1)), 1)::double as s, list_sum(list_transform(w, lambda x: length(x)))::double as c, list_sum(list_transform(w, lambda x: greatest(len(regexp_extract_all(lower(x), '([aeiouy]+)', 1)), 1)))::double as y from t where len(w) > 0)
select doc_id, n as n_words, s as n_sentences, round(c / n, 6) as mean_word_length, round(len(list_distinct(list_transform(w, lambda x: lower(x)))) / n, 6) as type_token_ratio, round((length(text) - length(replace(text, ',', ''))) / n, 6) as comma_per_word,
  round(206.835 - 1.015 * n / s - 84.6 * y / n, 5) as flesch_reading_ease, round(4.71 * c / n + 0.5 * n / s - 21.43, 5) as automated_readability, round(len(list_filter(w, lambda x: lower(x) = 'the')) / n, 6) as fw_the from m
""")
def style_measures(spark, folder):
    rows = table(spark, folder, "documents").where("text is not null").select("doc_id", tx.style(F.col("text"), ["the", "and"]).alias("s")).where("s is not null").select("doc_id", "s.*")
    keep = ["doc_id", "n_words", "n_sentences", "mean_word_length", "type_token_ratio", "comma_per_word", "flesch_reading_ease", "automated_readability", "fw_the"]
    rows = rounded(rows.select(*keep), "mean_word_length", "type_token_ratio", "comma_per_word", "fw_the")
    return rounded(rows, "flesch_reading_ease", "automated_readability", digits=5)


@query(r"""
with d as (select listing_id as id, list_filter(regexp_extract_all(lower(description), '[\p{L}\p{N}_]{2,}'), lambda x: not list_contains(['the', 'and', 'of', 'in', 'to', 'is', 'it', 'by', 'for', 'with'], x)) as w from listings where description is not null),
t as (select id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from d), tf as (select id, term, count(*) as tf from t group by all),
k as (select term, count(*) as df, sum(tf) as cf from tf group by 1 having count(*) >= 2 order by cf desc, term limit 5000), n as (select count(*) as n from d),
x as (select id, term, tf * (ln((1 + n) / (1 + df)) + 1) as w from tf join k using (term), n)
select id as listing_id, count(*) as terms, round(max(w) / sqrt(sum(w * w)), 6) as top_weight from x group by id
""")
def tfidf_weights(spark, folder):
    w = vo.tf_idf(table(spark, folder, "listings"), "listing_id", "description", ["the", "and", "of", "in", "to", "is", "it", "by", "for", "with"])
    return w.groupBy("listing_id").agg(F.count("*").alias("terms"), F.round(F.max("w"), 6).alias("top_weight"))


_WEIGHTS_SQL = SQL["tfidf_weights"][: SQL["tfidf_weights"].rindex("select id as listing_id")]


@query(f"""{_WEIGHTS_SQL}, s as (select id, term, w / sqrt(sum(w * w) over (partition by id)) as w from x), nb as (select listing_id as id, other_id from ({SQL['five_nearest']})),
m as (select nb.id, term, sum(w) as m from nb join s on s.id = other_id group by all), ln as (select id, sqrt(sum(m * m)) as l from m group by id), dots as (select id, sum(w * m) as dot from s join m using (id, term) group by id)
select id as listing_id, round(1 - coalesce(dot, 0) / l, 6) as uniqueness from ln left join dots using (id)
""")
def text_uniqueness(spark, folder):
    """How far a description's words are from those of its five nearest neighbours."""
    scratch = Scratch(spark)
    listings = table(spark, folder, "listings")
    w = scratch.cut(vo.tf_idf(listings, "listing_id", "description", ["the", "and", "of", "in", "to", "is", "it", "by", "for", "with"]))
    near = sp.nearest(listings, listings.select(F.col("listing_id").alias("other_id"), "latitude", "longitude"), "listing_id", "other_id", scratch, k=5, skip_self=True)
    return rounded(vo.uniqueness(w, near, "listing_id", "other_id"), "uniqueness")


# ---- estimates

_TREATED = "case when emb[1] is not null then emb[1]::double end"


def _study(spark: SparkSession, folder: str) -> DataFrame:
    """emb_id, city, y (log price), t (the first component of the embedding, in deviations), z (emb's second component)."""
    rows = tb.valid_log_outcome(table(spark, folder, "listing_embeddings").where("emb is not null and city is not null"), "price")
    rows = rows.select("emb_id", "city", "y", F.col("emb")[0].cast("double").alias("e"), F.col("emb")[1].cast("double").alias("z"), "latitude", "longitude")
    return es.z_score(rows, "e", "t").drop("e")


_STUDY = """
with base as (select emb_id, city, ln(price) as y, emb[1]::double as e, emb[2]::double as z, ('0x' || substr(md5(emb_id || '|42'), 1, 8))::bigint % 5 as fold from listing_embeddings where price > 0 and not isnan(price) and emb is not null and city is not null),
study as (select emb_id, city, y, z, fold, (e - avg(e) over ()) / stddev_pop(e) over () as t from base),
part as (select city, fold, count(*) as n, sum(y) as sy, sum(t) as st from study group by all),
mean as (select a.city, a.fold, sum(b.sy) / sum(b.n) as my, sum(b.st) / sum(b.n) as mt from part a join part b on a.city = b.city and a.fold <> b.fold group by all),
res as (select study.*, y - my as y_res, t - mt as t_res from study join mean using (city, fold))
"""
_THETA = "th as (select avg(t_res * y_res) / avg(t_res * t_res) as theta, avg(t_res * t_res) as tt from res), sc as (select res.*, theta, (y_res - theta * t_res) * t_res / tt as psi from res, th)"


def _residuals(spark: SparkSession, folder: str) -> DataFrame:
    return es.residuals_by_group(_study(spark, folder), "emb_id", "y", "t", "city")


@query("select ('0x' || substr(md5(emb_id || '|42'), 1, 8))::bigint % 5 as fold, count(*) as n from listing_embeddings group by 1")
def fold_sizes(spark, folder):
    return table(spark, folder, "listing_embeddings").select(es.fold(F.col("emb_id")).alias("fold")).groupBy("fold").agg(F.count("*").alias("n"))


@query(_STUDY + ", " + _THETA + ", s as (select any_value(theta) as theta, sqrt(var_samp(psi) / count(*)) as se, count(*) as n from sc) select round(theta, 6) as theta, round(se, 6) as se, round(theta - 1.96 * se, 6) as ci_low, round(theta + 1.96 * se, 6) as ci_high, round(2.8 * se, 6) as mde, n from s")
def effect_by_group_means(spark, folder):
    return rounded(es.partial_linear(_residuals(spark, folder)), "theta", "se", "ci_low", "ci_high", "mde")


@query(_STUDY + ", " + _THETA + """, q as (select list_distinct([quantile_cont(z, 0.25), quantile_cont(z, 0.5), quantile_cont(z, 0.75)]) as e from sc),
c as (select len(list_filter(e, lambda x: z > x)) as cell, count(*) as n, avg(psi) as mean, stddev_samp(psi) / sqrt(count(*)) as se from sc, q group by 1 having count(*) >= 5)
select cell::int as cell, n, round(mean, 6) as mean, round(se, 6) as se, round(mean - 1.96 * se, 6) as ci_low, round(mean + 1.96 * se, 6) as ci_high from c
""")
def score_cells(spark, folder):
    return rounded(es.quantile_cells(es.scores(_residuals(spark, folder)), "z", "psi"), "mean", "se", "ci_low", "ci_high")


@query(_STUDY + ", " + _THETA + """, q as (select [quantile_cont(z, 0.25), quantile_cont(z, 0.5), quantile_cont(z, 0.75)] as e from sc),
c as (select len(list_filter(e, lambda x: z > x)) as cell, count(*) as n, avg(psi) as mean, stddev_samp(psi) / sqrt(count(*)) as se from sc, q group by 1),
g as (select sum(mean * n) / sum(n) as m from c) select round(sum(pow((mean - m) / se, 2)), 5) as wald, count(*) - 1 as df from c, g
""")
def heterogeneity_wald(spark, folder):
    return rounded(es.wald(es.quantile_cells(es.scores(_residuals(spark, folder)), "z", "psi")), "wald", digits=5)


@query(_STUDY + ", " + _THETA + """, s as (select any_value(theta) as theta, sqrt(var_samp(y_res - theta * t_res) / var_samp(t_res)) as scale, stddev_samp(y_res) as sd_y from sc)
select round(theta, 6) as theta, round(scale, 6) as scale, round(sd_y, 6) as sd_y, round(sqrt((-pow(theta, 2) + sqrt(pow(theta, 4) + 4 * pow(scale, 2) * pow(theta, 2))) / (2 * pow(scale, 2))), 6) as rv, round(exp(0.91 * abs(theta) / sd_y) + sqrt(exp(0.91 * abs(theta) / sd_y) * (exp(0.91 * abs(theta) / sd_y) - 1)), 6) as e_value from s
""")
def sensitivity(spark, folder):
    return rounded(es.robustness_columns(es.bias_scale(_residuals(spark, folder))), "theta", "scale", "sd_y", "rv", "e_value")


@query(_STUDY + """, w as (select res.*, latitude::double as latitude, longitude::double as longitude from res join listing_embeddings using (emb_id) where latitude is not null and longitude is not null),
l as (select 'latitude' as covariate, latitude as x, y_res, t_res from w union all select 'longitude', longitude, y_res, t_res from w union all select 'z', z, y_res, t_res from w),
c as (select covariate, x - avg(x) over (partition by covariate) as x, y_res, t_res from l where x is not null),
r as (select covariate, pow(sum(x * y_res), 2) / sum(x * x) / sum(y_res * y_res) as r2_y, pow(sum(x * t_res), 2) / sum(x * x) / sum(t_res * t_res) as r2_t from c group by 1)
select covariate, round(r2_y, 6) as r2_y, round(r2_t, 6) as r2_t from r
""")
def strongest_covariates(spark, folder):
    rows = _residuals(spark, folder).where("latitude is not null and longitude is not null")
    return rounded(es.strongest_covariates(rows, ["latitude", "longitude", "z"]), "r2_y", "r2_t")


@query("""
with b as (select ln(price) as y, (emb[1] > 0)::int as d, city, ('0x' || substr(md5(emb_id || '|42'), 1, 8))::bigint % 5 as fold from listing_embeddings where price > 0 and not isnan(price) and emb is not null and city is not null),
m as (select city, avg(y) filter (d = 1) as m1, avg(y) filter (d = 0) as m0, least(greatest(avg(d), 0.05), 0.95) as e from b group by 1),
p as (select m1 - m0 + d * (y - m1) / e - (1 - d) * (y - m0) / (1 - e) as psi from b join m using (city))
select round(avg(psi), 6) as ate, round(sqrt(var_samp(psi) / count(*)), 6) as se, round(avg(psi) - 1.96 * sqrt(var_samp(psi) / count(*)), 6) as ci_low, round(avg(psi) + 1.96 * sqrt(var_samp(psi) / count(*)), 6) as ci_high, round(2.8 * sqrt(var_samp(psi) / count(*)), 6) as mde, count(*) as n from p
""")
def doubly_robust_means(spark, folder):
    rows = tb.valid_log_outcome(table(spark, folder, "listing_embeddings").where("emb is not null and city is not null"), "price").select("city", "y", (F.col("emb")[0] > 0).cast("int").alias("d"))
    means = rows.groupBy("city").agg(F.avg(F.when(F.col("d") == 1, F.col("y"))).alias("m1"), F.avg(F.when(F.col("d") == 0, F.col("y"))).alias("m0"), F.avg("d").alias("e"))
    return rounded(es.doubly_robust(rows.join(means, "city"), "d", "y", "m0", "m1", "e"), "ate", "se", "ci_low", "ci_high", "mde")


@query("""
with a as (select row_id, ln(lot_area_sqft) as y, city, coalesce(case when year_built between 1700 and 2026 then year_built end, 0)::double as t, ('0x' || substr(md5(row_id || '|42'), 1, 8))::bigint % 5 as fold from parcels where lot_area_sqft > 0 and not isnan(lot_area_sqft) and city is not null),
part as (select city, fold, count(*) as n, sum(y) as sy, sum(t) as st from a group by all), mean as (select p.city, p.fold, sum(q.sy) / sum(q.n) as my, sum(q.st) / sum(q.n) as mt from part p join part q on p.city = q.city and p.fold <> q.fold group by all),
res as (select y - my as y_res, t - mt as t_res from a join mean using (city, fold)), th as (select avg(t_res * y_res) / avg(t_res * t_res) as theta, avg(t_res * t_res) as tt from res), sc as (select theta, (y_res - theta * t_res) * t_res / tt as psi from res, th)
select round(any_value(theta), 9) as theta, round(sqrt(var_samp(psi) / count(*)), 9) as se, count(*) as n from sc
""")
def placebo_outcome(spark, folder):
    """A property of the parcel, which no text can move, as outcome; taken by name, and no longer among the confounders."""
    rows = tb.valid_log_outcome(table(spark, folder, "parcels").where("city is not null"), "lot_area_sqft").withColumn("t", F.coalesce(tb.between_or_null("year_built", 1700, 2026), F.lit(0)).cast("double"))
    return rounded(es.partial_linear(es.residuals_by_group(rows.select("row_id", "city", "y", "t"), "row_id", "y", "t", "city")), "theta", "se", digits=9).select("theta", "se", "n")


@query("""
with a as (select emb_id, coalesce(city, '') as s, price, row_number() over (partition by coalesce(city, '') order by ('0x' || substr(md5(emb_id || '|0'), 1, 8))::bigint, emb_id) as r from listing_embeddings),
b as (select coalesce(city, '') as s, price as permuted, row_number() over (partition by coalesce(city, '') order by ('0x' || substr(md5(emb_id || '|9'), 1, 8))::bigint, emb_id) as r from listing_embeddings)
select emb_id, permuted from a join b using (s, r)
""")
def permuted_within_city(spark, folder):
    return es.permute_within(table(spark, folder, "listing_embeddings").select("emb_id", "city", "price"), "emb_id", "price", "city", 9).select("emb_id", "permuted")


@query("""
with a as (select emb_id, row_number() over (order by emb_id) as r from listing_embeddings), b as (select price as permuted, row_number() over (order by ('0x' || substr(md5(emb_id || '|9'), 1, 8))::bigint, emb_id) as r from listing_embeddings)
select emb_id, permuted from a join b using (r)
""")
def permuted_rows(spark, folder):
    return es.permute(table(spark, folder, "listing_embeddings").select("emb_id", "price"), "emb_id", "price", 9, Scratch(spark)).select("emb_id", "permuted")


@query("""
with d as (select emb_id, ln(price) as v from listing_embeddings where price > 0 and not isnan(price)),
u as (select b, v, ('0x' || substr(md5(emb_id || '#' || b || '|7'), 1, 7))::bigint / 268435456.0 as u from d, (select unnest(range(1, 101)) as b)),
c as (select list_sum(list_transform(range(0, 8), lambda k: case when u >= list_sum(list_transform(range(0, k + 1), lambda j: exp(-1) / factorial(j::int))) then 1 else 0 end)) as k, b, v from u),
m as (select b, sum(v * k) / sum(k) as m from c group by 1)
select round((select avg(v) from d), 6) as mean, round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high from m
""")
def bootstrap_interval(spark, folder):
    rows = tb.valid_log_outcome(table(spark, folder, "listing_embeddings"), "price").select("emb_id", "y")
    return rounded(es.bootstrap_mean(rows, "emb_id", "y", 100), "mean", "low", "high")


@query("""
with t as (select l_linestatus as arm, l_discount as theta, l_tax as se, l_discount - 1.96 * l_tax as lo, l_discount + 1.96 * l_tax as hi, 0.05 as truth from lineitem)
select arm, count(*) as n_ok, round(avg(theta - truth), 6) as bias, round(stddev_samp(theta), 6) as sd, round(sqrt(avg(pow(theta - truth, 2))), 6) as rmse, round(avg((lo <= truth and truth <= hi)::int), 6) as coverage, round(avg(hi - lo), 6) as ci_length, round(avg(case when se > 0 then (abs(theta / se) > 1.96)::int end), 6) as power from t group by arm
""")
def replicate_summary(spark, folder):
    t, s = F.col("l_discount").cast("double"), F.col("l_tax").cast("double")
    rows = table(spark, folder, "lineitem").select(F.col("l_linestatus").alias("arm"), t.alias("theta"), s.alias("se"), (t - 1.96 * s).alias("ci_low"), (t + 1.96 * s).alias("ci_high"), F.lit(0.05).alias("truth"))
    return rounded(es.replicate_summary(rows, ["arm"], "truth"), "bias", "sd", "rmse", "coverage", "ci_length", "power")


@query("""
with p as (select emb_id, ln(price) as a, city, ('0x' || substr(md5(emb_id || '|42'), 1, 8))::bigint % 5 as fold from listing_embeddings where price > 0 and not isnan(price) and city is not null),
m as (select x.city, x.fold, sum(y.s) / sum(y.n) as h from (select distinct city, fold from p) x join (select city, fold, sum(a) as s, count(*) as n from p group by all) y on x.city = y.city and x.fold <> y.fold group by all),
f as (select fold, avg(abs(exp(h) - exp(a))) as mae, avg(abs(exp(h) - exp(a)) / greatest(exp(a), 1)) as mape, sqrt(avg(pow(exp(h) - exp(a), 2))) as rmse from p join m using (city, fold) group by fold)
select round(avg(mae), 2) as mae, round(stddev_samp(mae), 2) as mae_sd, round(avg(mape), 6) as mape, round(stddev_samp(mape), 6) as mape_sd, round(avg(rmse), 2) as rmse, round(stddev_samp(rmse), 2) as rmse_sd from f
""")
def fold_errors(spark, folder):
    rows = tb.valid_log_outcome(table(spark, folder, "listing_embeddings").where("city is not null"), "price").select("emb_id", "city", "y", F.lit(0.0).alias("t"))
    rows = es.residuals_by_group(rows, "emb_id", "y", "t", "city").withColumn("p", F.col("y") - F.col("y_res"))
    out = es.fold_errors(rows, "fold", "y", "p")
    return rounded(rounded(out, "mae", "mae_sd", "rmse", "rmse_sd", digits=2), "mape", "mape_sd")


@query("""
with t as (select city as a, case when land_use in ('R1','R2','R3','R4','CD','A') then land_use end as b, count(*) as n from parcels where city is not null and land_use in ('R1','R2','R3','R4','CD','A') group by all),
ab as (select ln(sum(n)) - sum(n * ln(n)) / sum(n) as h from t), a as (select ln(sum(n)) - sum(n * ln(n)) / sum(n) as h from (select sum(n) as n from t group by a)), b as (select ln(sum(n)) - sum(n * ln(n)) / sum(n) as h from (select sum(n) as n from t group by b))
select round(a.h + b.h - ab.h, 6) as mi, round(a.h, 6) as h_a, round(b.h, 6) as h_b, round(2 * (a.h + b.h - ab.h) / (a.h + b.h), 6) as nmi from ab, a, b
""")
def label_information(spark, folder):
    rows = table(spark, folder, "parcels").where(F.col("land_use").isin("R1", "R2", "R3", "R4", "CD", "A")).select("city", "land_use")
    return rounded(es.mutual_information(rows, "city", "land_use"), "mi", "h_a", "h_b", "nmi")


@query("""
with d as (select ln(lot_area_sqft) as y, year_built::double as x from parcels where lot_area_sqft > 0 and not isnan(lot_area_sqft) and year_built between 1700 and 2026),
f as (select regr_slope(y, x) as b, regr_intercept(y, x) as a, regr_r2(y, x) as r2, count(*) as n, avg(x) as mx, sum(x * x) - count(*) * avg(x) * avg(x) as sxx from d),
u as (select (x - mx) as c, sxx, pow((y - a - b * x) / (1 - (1.0 / n + pow(x - mx, 2) / sxx)), 2) as u from d, f)
select round((select b from f), 8) as slope, round(sqrt(sum(u * c * c)) / any_value(sxx), 8) as slope_se, round((select r2 from f), 6) as r2, (select n from f) as n from u
""")
def least_squares(spark, folder):
    rows = tb.valid_log_outcome(table(spark, folder, "parcels").where("year_built between 1700 and 2026"), "lot_area_sqft").select("y", F.col("year_built").cast("double").alias("x"))
    fit = es.least_squares(rows, ["x"], "y")
    slope, se = fit["coefficients"]["x"]
    return spark.createDataFrame([(round(slope, 8), round(se, 8), round(fit["r2"], 6), fit["n"])], "slope double, slope_se double, r2 double, n long")


@query("""
select * from (values ('T-C-L-X-Y', true), ('T-C-L-Y', true), ('T-C-Y', true), ('T-L-C-Y', true), ('T-L-X-Y', true), ('T-L-Y', true), ('T-X-L-C-Y', true), ('T-X-L-Y', true), ('T-X-Y', true)) v(path, blocked)
""")
def graph_paths(spark, folder):
    return idn.path_table(spark, idn.GRAPH, "T", "Y", {"L", "X", "C"})


# ---- models, simulations and rewrites: no SQL, held against properties and brute force in the tests


def _analysis(spark: SparkSession, folder: str) -> DataFrame:
    return au.feature_rows(table(spark, folder, "listing_embeddings"), table(spark, folder, "parcels"), ["year_built", "bldg_area_sqft", "lot_area_sqft", "bedrooms"], tx.zip5)


@query()
def linear_effect(spark, folder):
    rows = _analysis(spark, folder).select("id", "y", F.col("emb")[0].alias("e"), *[F.col("w")[i].alias(f"w{i}") for i in range(6)])
    return es.partial_linear(es.linear_residuals(es.z_score(rows, "e", "t"), "id", "y", "t", [f"w{i}" for i in range(6)]))


@query()
def principal_components(spark, folder):
    return au.components(_analysis(spark, folder), 3).select("id", "pcs")


@query()
def cluster_information(spark, folder):
    return au.cluster_label_nmi(_analysis(spark, folder), 20, 1)


for _name, _f in {
    "boosted_effect": lambda d: au.partial_linear_by_city(d, 30, 3),
    "doubly_robust_boosted": lambda d: au.doubly_robust_by_city(d, 30, 3, 200),
    "segment_effects": lambda d: au.by_outcome_segment(d),
    "backdoor_gain": lambda d: au.backdoor_gain(d),
    "randomization_test": lambda d: au.randomization(d, 5),
    "placebo_treatments": lambda d: au.placebos(d, 6),
    "seed_stability": lambda d: au.seed_stability(d, 4),
    "confounder_escalation": lambda d: au.escalation(d, ["lat", "lon", "year_built", "bldg_area_sqft", "lot_area_sqft", "bedrooms"]),
    "label_accuracy": lambda d: au.label_accuracy(d),
    "deconfounded_probe": lambda d: au.deconfounded(d, 30),
    "spatial_rank_correlation": lambda d: au.spatial_rank_correlation(d),
}.items():

    def _run(spark, folder, f=_f):
        return f(_analysis(spark, folder))

    _run.__name__ = _name
    query()(_run)


@query()
def city_transfer(spark, folder):
    return au.transfer(_analysis(spark, folder), 5)


@query()
def capacity_ladder(spark, folder):
    return au.capacity_ladder(spark, 1000, 2)


@query()
def simulation_grid(spark, folder):
    return es.replicate_summary(au.monte_carlo(spark, [200, 400], [0.0, 0.1], 4), ["estimator", "n", "truth"], "truth")


@query()
def rewrite_arms(spark, folder):
    rows = table(spark, folder, "listings").where("description is not null")
    return cf.pass_rates(cf.rewrites(rows, "listing_id", "description", F.coalesce("city_name", F.lit("the city"))))
