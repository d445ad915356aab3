"""Queries of readers, writers and small operators over the test tables, and SQL to hold them against."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotweave.functions import text as tx
from lotweave.functions.geo import rings_area, wkt_polygons
from lotweave.operators import counterfactual as cf
from lotweave.operators import estimate as es
from lotweave.operators import simulate as si
from lotweave.operators import spatial as sp
from lotweave.operators import tabular as tb
from lotweave.plans import reference as rf
from lotweave.plans.registry import registry
from lotweave.session import Scratch
from lotweave.sources import readers as rd
from lotweave.sources import requests as rq
from lotweave.sources import writers as wr
from lotweave.sources.tables import table

QUERIES, SQL, query = registry()
rounded = rf.rounded


# ---- files written and read again


@query("select incident_id, beat, city from crime where incident_id is not null")
def csv_round_trip(spark, folder):
    """Written with a header in each file, read again with three of its columns."""
    path = f"{Scratch(spark).root}/csv"
    wr.append_csv(table(spark, folder, "crime").where("incident_id is not null").select("incident_id", "beat", "city", "offense_desc"), path)
    return rd.read_csv(spark, path, columns=["incident_id", "beat", "city"])


@query("select row_id, city, zip, block from parcels where city is not null")
def parts_round_trip(spark, folder):
    """Written as a folder for each city, read again."""
    path = f"{Scratch(spark).root}/parts"
    wr.write_parts(table(spark, folder, "parcels").where("city is not null").select("row_id", "zip", "block", "city"), path, ["city"])
    return spark.read.schema("row_id long, zip string, block string, city string").parquet(path)


@query("select city, count(*) as n, count(zip) as zips, max(case when zip = 'none' then zip end) as nothing from parcels group by city")
def report_round_trip(spark, folder):
    path = f"{Scratch(spark).root}/report"
    rows = table(spark, folder, "parcels").groupBy("city").agg(F.count("*").alias("n"), F.count("zip").alias("zips"), F.max(F.when(F.col("zip") == "none", F.col("zip"))).alias("nothing"))
    wr.write_report(rows, path)
    return spark.read.schema("city string, n long, zips long, nothing string").json(path)


@query("select geoid, case when median_household_income >= 0 then median_household_income end as income, case when race_total >= 0 then race_total::double end as people from block_groups")
def census_answer(spark, folder):
    """Block groups as a census service gives them, arrays of text with the names first, read by the reader of such answers."""
    cells = table(spark, folder, "block_groups").select("city", F.array(F.coalesce(F.col("median_household_income").cast("string"), F.lit("-666666666")), F.coalesce(F.col("race_total").cast("string"), F.lit("-1")), F.substring("geoid", 1, 5), F.substring("geoid", 6, 99)).alias("r"))
    head = F.array(F.array(*[F.lit(n) for n in ("B19013", "B02001", "county", "group")]))
    answers = cells.groupBy("city").agg(F.to_json(F.concat(head, F.collect_list("r"))).alias("j"))  # a fixed table of some hundred rows
    return rd.header_rows(answers, "j", {"B19013": "income", "B02001": "people"}, ["county", "group"])


@query("select osm_id, category, coalesce(subcategory, '') as subcategory, name, latitude, longitude from amenities where latitude is not null and longitude is not null and category is not null")
def map_answer(spark, folder):
    """Amenities as a map service gives them, nodes and ways, read by the reader of such answers."""
    rows = table(spark, folder, "amenities").where("category is not null")
    way, place = F.col("osm_id") % 2 == 0, F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    tags = F.create_map(F.lit("amenity"), F.when(F.col("osm_id") % 3 == 0, F.col("subcategory")), F.lit("shop"), F.when(F.col("osm_id") % 3 != 0, F.col("subcategory")), F.lit("name"), F.col("name"))
    element = F.struct(F.col("osm_id").alias("id"), F.when(way, "way").otherwise("node").alias("type"), F.when(~way, F.col("latitude")).alias("lat"), F.when(~way, F.col("longitude")).alias("lon"), F.when(way, place).alias("center"), F.map_filter(tags, lambda k, v: v.isNotNull()).alias("tags"))
    answers = rows.select("category", F.to_json(F.struct(F.array(element).alias("elements"))).alias("j"))
    return rd.map_elements(answers, "j", F.col("category"))


@query("select address, city_name, state, zip, latitude, longitude, price, url from listings")
def search_answer(spark, folder):
    """Listings as a search gives them, behind its guarding prefix, read by the reader of such answers."""
    value = lambda c: F.struct(c.alias("value"))
    home = F.struct(value(F.col("address")).alias("streetLine"), F.col("city_name").alias("city"), "state", "zip", value(F.struct("latitude", "longitude")).alias("latLong"), value(F.col("price")).alias("price"), "url")
    answers = table(spark, folder, "listings").select(F.concat(F.lit("{}&&"), F.to_json(F.struct(F.struct(F.array(home).alias("homes")).alias("payload")))).alias("j"))
    return rd.search_results(answers, "j")


@query(r"select listing_id, coalesce(nullif(trim(regexp_replace(description, '\s+', ' ', 'g')), ''), 'nor this') as found from listings where description is not null")
def page_answer(spark, folder):
    """Descriptions inside pages of a listing, found by the reader of such pages; where that place is blank, the next one counts."""
    t = tx.replace_all(F.col("description"), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")])
    page = F.concat(F.lit("<html><body><p class='intro'>Not this</p><div class='house-Remarks'><b>"), t, F.lit("</b></div><p class='description'>nor this</p></body></html>"))
    return table(spark, folder, "listings").where("description is not null").select("listing_id", rd.page_description(page).alias("found"))


@query("""
with old as (select address, description, 'first' as source, 0 as age from listings where listing_id % 2 = 0), new as (select address, description, '' as source, 1 as age from listings where listing_id % 2 = 1 and length(description) > 50)
select address, description, source from (select * from old union all select * from new)
qualify row_number() over (partition by address order by age, description nulls first, source) = 1
""")
def imported_descriptions(spark, folder):
    rows = table(spark, folder, "listings")
    old = rows.where("listing_id % 2 = 0").select("address", "description", F.lit("first").alias("source"))
    return rd.import_descriptions(old, rows.where("listing_id % 2 = 1").select("address", "description"), ["address", "description"], {"source": ""}, "address")


@query("""
select emb_id, zip from listing_embeddings order by ('0x' || substr(md5(emb_id || '|42'), 1, 8))::bigint, emb_id limit 200
""")
def sampled_pairs(spark, folder):
    """A seeded sample of 200, the same in any engine: the sample is the feature."""
    return si.hash_sample(table(spark, folder, "listing_embeddings").select("emb_id", "zip"), "emb_id", 200)


@query("""
with b as (select city, printf('(%.4f,%.4f,%.4f,%.4f)', min(latitude), min(longitude), max(latitude), max(longitude)) as box from amenities where latitude is not null and longitude is not null group by city)
select city, '[out:json][timeout:300];(node["amenity"~"school|library"]' || box || ';way["amenity"~"school|library"]' || box || ';);out center;' as request from b
""")
def map_requests(spark, folder):
    """What a map service is asked for the extent of each city."""
    b = table(spark, folder, "amenities").where("latitude is not null and longitude is not null").groupBy("city").agg(F.min("latitude").alias("s"), F.min("longitude").alias("w"), F.max("latitude").alias("n"), F.max("longitude").alias("e"))
    return b.select("city", rq.map_request(F.col("s"), F.col("w"), F.col("n"), F.col("e"), "amenity", ["school", "library"]).alias("request"))


# ---- columns, rows, sets


@query("select row_id as id, land_use as usage, zip from parcels")
def standard_columns(spark, folder):
    return tb.rename_and_drop(table(spark, folder, "parcels").select("row_id", "land_use", "zip", "block", "geometry"), {"row_id": "id", "land_use": "usage", "absent": "x"}, ["block", "geometry", "gone"])


@query("select row_id, active from (select row_id, units_res > 0 as active from parcels) where active = true")
def active_only(spark, folder):
    return tb.where_flag(table(spark, folder, "parcels").select("row_id", (F.col("units_res") > 0).alias("active")), "active", True)


@query(rf"""
select geoid, round(area_e6, 2) as area_e6 from ({rf.SQL['polygon_measures']}) where area_e6 >= 150
union all select row_id::varchar, null from parcels where geometry like 'POINT%'
""")
def large_shapes(spark, folder):
    """Points stay; polygons stay from an area on."""
    groups = table(spark, folder, "block_groups").select("geoid", "geometry")
    points = table(spark, folder, "parcels").where("geometry like 'POINT%'").select(F.col("row_id").cast("string").alias("geoid"), "geometry")
    shapes = groups.unionAll(points).withColumn("r", wkt_polygons(F.col("geometry"))).where("r is not null")
    polygon = ~F.col("geometry").startswith("POINT")
    kept = tb.large_shapes(shapes.withColumn("area_e6", F.when(polygon, F.round(rings_area(F.col("r")) * 1e6, 3))), F.col("area_e6"), polygon, 150.0)
    return rounded(kept.select("geoid", "area_e6"), "area_e6", digits=2)


@query("select row_id, round((coalesce(bedrooms, 0) + coalesce(units_res, 0)) / nullif(year_built, 0), 9) as share from parcels")
def parts_of_whole(spark, folder):
    out = tb.share_of_sum(table(spark, folder, "parcels").select("row_id", "bedrooms", "units_res", "year_built"), "share", ["bedrooms", "units_res", "absent"], "year_built")
    return rounded(out.select("row_id", "share"), "share", digits=9)


@query("select row_id, case when (select avg((sale_price > 0)::int::double) from parcels) >= 0.5 then lot_area_sqft end as crime_total from parcels where (select avg((sale_price > 1e12)::int::double) from parcels where sale_price is not null) < 0.5")
def unmatched_columns(spark, folder):
    """Of two tables the one whose flag mostly holds keeps its columns, the other loses them."""
    rows = table(spark, folder, "parcels").select("row_id", F.col("lot_area_sqft").alias("crime_total"), (F.col("sale_price") > 0).alias("good"), (F.col("sale_price") > 1e12).alias("bad"))
    kept, lost = tb.without_columns_unmatched(rows, "good", "crime_"), tb.without_columns_unmatched(rows, "bad", "crime_")
    assert "crime_total" not in lost.columns
    return kept.select("row_id", "crime_total")


@query("""
with k as (select lower(trim(address)) as a, case when regexp_full_match(trim(zip), '[0-9]+') then trim(zip)::int end as z, price, latitude, row_number() over (partition by lower(trim(address)), case when regexp_full_match(trim(zip), '[0-9]+') then trim(zip)::int end order by delivery_id desc) as r from search_results where address is not null and case when regexp_full_match(trim(zip), '[0-9]+') then trim(zip)::int end is not null)
select listing_id, round(coalesce(case when k.a is not null then k.price end, (select avg(price) from search_results)), 4) as price, round(coalesce(case when k.a is not null then k.latitude end, (select avg(latitude) from search_results)), 6) as latitude, k.a is not null as matched
from listings l left join k on lower(trim(l.address)) = k.a and case when regexp_full_match(trim(l.zip), '[0-9]+') then trim(l.zip)::int end = k.z and r = 1
""")
def aligned_rows(spark, folder):
    known = table(spark, folder, "search_results").select("delivery_id", "address", "zip", "price", "latitude")
    out = cf.aligned(table(spark, folder, "listings").select("listing_id", "address", "zip"), known, ["price", "latitude"], F.col("delivery_id"))
    return rounded(rounded(out.select("listing_id", "price", "latitude", "matched"), "price", digits=4), "latitude")


@query("select emb_id, e.zip, e.price, l.description from listing_embeddings e left join listings l on e.emb_id = l.listing_id")
def joined_by_id(spark, folder):
    texts = table(spark, folder, "listings").select(F.col("listing_id").alias("emb_id"), "description")
    return tb.with_columns_of(table(spark, folder, "listing_embeddings").select("emb_id", "zip", "price"), texts, "emb_id")


@query("select listing_id, address from listings order by listing_id limit 100")
def first_listings(spark, folder):
    """A cap on listings is the feature."""
    return table(spark, folder, "listings").select("listing_id", "address").orderBy("listing_id").limit(100)


@query("select 'both' as side, zip from (select zip from parcels intersect select zip from documents) union all select 'parcels only', zip from (select zip from parcels except select zip from documents)")
def set_operations(spark, folder):
    a, b = table(spark, folder, "parcels").select("zip"), table(spark, folder, "documents").select("zip")
    return a.intersect(b).select(F.lit("both").alias("side"), "zip").unionAll(a.subtract(b).select(F.lit("parcels only").alias("side"), "zip"))


@query("select city, count(v) as n, round(avg(v), 4) as mean, median(v) as median, round(stddev_samp(v), 4) as sd, min(v) as low, max(v) as high from (select city, case when not isnan(sale_price) then sale_price end as v from parcels) group by city")
def price_summary(spark, folder):
    return rounded(tb.summary(table(spark, folder, "parcels"), "city", "sale_price"), "mean", "sd", digits=4)


@query("select city, count(*) as n, round(avg((latitude is not null and longitude is not null)::int), 6) as located, round(avg(coalesce(sale_price > 0, false)::int), 6) as sold from parcels group by city")
def match_rates(spark, folder):
    rows = table(spark, folder, "parcels")
    return rounded(tb.match_rates(rows, "city", {"located": F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), "sold": F.col("sale_price") > 0}), "located", "sold")


@query("""
with l as (select city, unnest([{'measure': 'lot_area_sqft', 'v': lot_area_sqft}, {'measure': 'year_built', 'v': year_built::double}], recursive := true) from parcels where city in ('boston', 'sf')),
k as (select * from l where v is not null and not isnan(v)), n as (select measure, count(*) filter (city = 'boston') as n_a, count(*) filter (city = 'sf') as n_b, median(v) filter (city = 'boston') as median_a, median(v) filter (city = 'sf') as median_b from k group by 1),
s as (select measure, v, count(*) filter (city = 'boston') as ka, count(*) filter (city = 'sf') as kb from k group by all), c as (select measure, sum(ka) over w as ca, sum(kb) over w as cb from s window w as (partition by measure order by v))
select measure, any_value(n_a) as n_a, any_value(n_b) as n_b, any_value(median_a) as median_a, any_value(median_b) as median_b, round(max(abs(ca / n_a - cb / n_b)), 6) as ks from c join n using (measure) group by measure
""")
def part_balance(spark, folder):
    """How alike two cities' parcels are: medians, and the largest gap of their distribution functions."""
    return rounded(es.two_sample_distance(table(spark, folder, "parcels"), "city", "boston", "sf", ["lot_area_sqft", "year_built"]), "ks")


_LISTED = "listed as (select listing_id, latitude, longitude, price from listings where latitude is not null and longitude is not null and price > 0)"


@query(f"""
with {_LISTED}, sold as (select row_id, latitude, longitude, sale_price from parcels where latitude is not null and longitude is not null and latitude <> 0 and longitude <> 0 and sale_price > 0),
d as (select p.listing_id, p.price, t.sale_price, {rf._M} as m, row_number() over (partition by p.listing_id order by {rf._M}, t.row_id) as k from listed p join sold t on abs(t.latitude - p.latitude) < 0.002 where {rf._M} <= 100),
r as (select unnest([10, 20, 50, 100])::int as radius)
select radius, count(*) as n, round(corr(ln(price), ln(sale_price)), 6) as rho, round(median(sale_price / price), 6) as median_ratio, round(stddev_samp(ln(sale_price) - ln(price)), 6) as sd_log from d join r on m <= radius where k = 1 group by radius
""")
def price_check(spark, folder):
    """Asked prices against the recorded price of the nearest sold parcel, within growing distances."""
    listed = table(spark, folder, "listings").where("latitude is not null and longitude is not null and price > 0").select("listing_id", "latitude", "longitude", "price")
    sold = tb.with_coordinates(table(spark, folder, "parcels")).where("sale_price > 0").select("row_id", "latitude", "longitude", "sale_price")
    return rounded(sp.price_check(listed, sold, "listing_id", "row_id", "price", "sale_price", [10, 20, 50, 100]), "rho", "median_ratio", "sd_log")


@query("""
with b as (select distinct zip from parcels where zip is not null), r as (select zip, dense_rank() over (order by zip) - 1 as r, count(*) over () as n from b)
select row_id, round(case when n = 1 then -1.0 else 2.0 * r / (n - 1) - 1 end, 9) as z from parcels left join r using (zip)
""")
def place_scores(spark, folder):
    return rounded(si.place_scores(table(spark, folder, "parcels").select("row_id", "zip"), "zip").select("row_id", "z"), "z", digits=9)


# ---- texts


@query("""
with a as (select assess_id, try_cast(trim(st_num) as double) as n, trim(st_name) as s from boston_assessment)
select assess_id, case when n is not null and not isnan(n) and s <> '' and length(trunc(n)::bigint || ' ' || s) > 3 then trunc(n)::bigint || ' ' || s end as address from a
""")
def built_addresses(spark, folder):
    return table(spark, folder, "boston_assessment").select("assess_id", tx.built_address(F.col("st_num"), F.col("st_name")).alias("address"))


@query(f"select listing_id, length(clean)::int as letters from ({rf.SQL['clean_descriptions']}) where length(clean) > 20")
def long_descriptions(spark, folder):
    rows = table(spark, folder, "listings").select("listing_id", tx.clean_description(F.col("description")).alias("cleaned"))
    return rows.where(F.length("cleaned") > 20).select("listing_id", F.length("cleaned").alias("letters"))


@query(r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as released from documents where length(trim(regexp_replace(text, '\s+', ' ', 'g'))) > 0")
def release_texts(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.squeeze(F.col("text")).alias("released")).where(F.length("released") > 0)


def _tag_sql() -> str:
    whens = [f"when w in ({', '.join(chr(39) + x + chr(39) for x in words)}) then '{tag}'" for tag, words in tx.FUNCTION_WORDS.items()]
    whens += [f"when ends_with(w, '{end}') and length(w) > {len(end) + 1} then '{tag}'" for end, tag in tx.ENDINGS]
    return f"case {' '.join(whens)} else 'NN' end"


def _share_sql(tags: list[str]) -> str:
    return f"len(list_filter(t, lambda x: x in ({', '.join(chr(39) + x + chr(39) for x in tags)})))"


_PLUS, _MINUS = ["NN", "NNS", "NNP", "NNPS", "JJ", "JJR", "JJS", "IN", "DT"], ["PRP", "PRP$", "WP", "WP$", "VB", "VBD", "VBG", "VBN", "VBP", "VBZ", "MD", "RB", "RBR", "RBS", "WRB", "UH"]


@query(f"""
with w as (select doc_id, list_transform(regexp_extract_all(lower(text), '[a-z]+'), lambda w: {_tag_sql()}) as t from documents where text is not null)
select doc_id, {', '.join(f"round({_share_sql(ts)} / len(t), 6) as {name}" for name, ts in tx.TAG_CLASSES.items())}, round((100 * ({_share_sql(_PLUS)} - {_share_sql(_MINUS)}) / len(t) + 100) / 2, 5) as formality from w where len(t) > 0
""")
def text_tags(spark, folder):
    """Shares of word classes, and how formal a text is."""
    rows = table(spark, folder, "documents").where("text is not null").select("doc_id", tx.word_tags(F.col("text")).alias("t")).where("size(t) > 0")
    out = rows.select("doc_id", tx.tag_shares(F.col("t")).alias("s"), tx.formality(F.col("t")).alias("formality")).select("doc_id", "s.*", "formality")
    return rounded(rounded(out, *tx.TAG_CLASSES), "formality", digits=5)


@query(f"""
with w as (select doc_id, list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*'), lambda x: lower(x)) as w from documents where text is not null),
f as (select unnest([{', '.join(chr(39) + w + chr(39) for w in tx.function_words())}]) as word), c as (select doc_id, len(w) as n, unnest(w) as word from w where len(w) > 0)
select word, round(sum(k / n), 5) as total from (select doc_id, n, word, count(*) as k from c group by all) join f using (word) group by word
""")
def function_word_shares(spark, folder):
    """The shares of the sorted function words, summed over all texts."""
    words = tx.function_words()
    rows = table(spark, folder, "documents").where("text is not null").select(tx.style(F.col("text"), words).alias("s")).where("s is not null")
    sums = rows.agg(*[F.sum(F.col("s")[f"fw_{w}"]).alias(w) for w in words])
    long = sums.select(F.explode(F.array(*[F.struct(F.lit(w).alias("word"), F.round(w, 5).alias("total")) for w in words])).alias("r")).select("r.*")
    return long.where("total > 0")


@query("""
select listing_id, city_name as city, price from listings where city_name is not null
""")
def repaired_answers(spark, folder):
    """Objects inside a model's fenced and chatty answers."""
    rows = table(spark, folder, "listings").where("city_name is not null").select("listing_id", F.to_json(F.struct(F.col("city_name").alias("city"), "price")).alias("j"))
    answer = F.when(F.col("listing_id") % 2 == 0, F.concat(F.lit("```json\n"), F.col("j"), F.lit("\n```"))).otherwise(F.concat(F.lit("Here it is: "), F.col("j"), F.lit(" - done")))
    return rows.select("listing_id", F.from_json(tx.json_inside(answer), "city string, price double").alias("o")).select("listing_id", "o.*")


_SUB = "case " + " ".join(f"when z = {k} then '{v}'" for k, v in cf.SUBMARKETS.items()) + f" else '{cf.OTHER_SUBMARKET}' end"
_NAMES = "[" + ", ".join(f"'{s}'" for s in cf.SUBMARKET_ZIPS) + "]"
_ZIPS = "case s " + " ".join(f"when '{k}' then {v}" for k, v in cf.SUBMARKET_ZIPS.items()) + " end"


@query(f"""
with m as (select n_nationkey, 94100 + n_nationkey as z from nation), s as (select n_nationkey, {_SUB} as s from m)
select n_nationkey, s as submarket, {_ZIPS}::int as zip, list_aggregate(list_filter({_NAMES}, lambda x: x <> s)[1:3], 'string_agg', '|') as targets from s
""")
def swap_targets(spark, folder):
    """The submarket of a zip, the zip that stands for it, and the first three other submarkets."""
    rows = table(spark, folder, "nation").select("n_nationkey", cf.submarket((F.lit(94100) + F.col("n_nationkey")).cast("string")).alias("submarket"))
    return rows.select("n_nationkey", "submarket", cf.submarket_zip(F.col("submarket")).alias("zip"), F.array_join(cf.swap_targets(F.col("submarket")), "|").alias("targets"))


# ---- places and vectors


@query("""
with o as (select avg(latitude) as lat0, avg(longitude) as lon0 from listings)
select listing_id, round((longitude - lon0) * cos(radians(lat0)) * pi() / 180 * 6371000, 3) as x, round((latitude - lat0) * pi() / 180 * 6371000, 3) as y from listings, o where latitude is not null and longitude is not null
""")
def projected(spark, folder):
    rows = table(spark, folder, "listings").where("latitude is not null and longitude is not null").select("listing_id", "latitude", "longitude")
    o = rows.agg(F.avg("latitude").alias("a"), F.avg("longitude").alias("b"))
    out = rows.crossJoin(F.broadcast(o)).select("listing_id", sp.project(F.col("latitude"), F.col("longitude"), F.col("a"), F.col("b")).alias("p"))  # one row
    return rounded(out.select("listing_id", "p.*"), "x", "y", digits=3)


@query("""
with v as (select emb_id, list_transform(emb, lambda x: x::double) as e from listing_embeddings where emb is not null), n as (select emb_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v),
m as (select median(norm) as m from n)
select a.emb_id, round(a.norm, 6) as norm, (a.norm > m)::int as above, round(sqrt(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: pow(a.e[i] - b.e[i], 2)))), 6) as euclid, round(1 - list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) / (a.norm * b.norm), 6) as cosine
from n a join m on true left join n b on b.emb_id = a.emb_id + 1
""")
def vector_distances(spark, folder):
    """Lengths of vectors, which are above the median, and distances to the vector of the next id."""
    v = table(spark, folder, "listing_embeddings").where("emb is not null").select("emb_id", F.transform("emb", lambda x: x.cast("double")).alias("e")).withColumn("norm", sp.length(F.col("e")))
    m = v.agg(F.median("norm").alias("m"))
    b = v.select((F.col("emb_id") - 1).alias("emb_id"), F.col("e").alias("f"), F.col("norm").alias("norm_b"))
    out = v.crossJoin(F.broadcast(m)).join(b, "emb_id", "left")  # one row
    out = out.select("emb_id", "norm", (F.col("norm") > F.col("m")).cast("int").alias("above"), sp.euclid(F.col("e"), F.col("f")).alias("euclid"), (1 - sp.dot(F.col("e"), F.col("f")) / (F.col("norm") * F.col("norm_b"))).alias("cosine"))
    return rounded(out, "norm", "euclid", "cosine")


@query("select geoid, true as sound from block_groups where geometry is not null union all select 'bad' || n_nationkey, false from nation")
def sound_shapes(spark, folder):
    """Shapes whose rings can't be read are told, and left to the caller; nothing is mended silently."""
    good = table(spark, folder, "block_groups").where("geometry is not null").select("geoid", "geometry")
    bad = table(spark, folder, "nation").select(F.concat(F.lit("bad"), F.col("n_nationkey")).alias("geoid"), F.lit("POLYGON ((1 2, x 4))").alias("geometry"))
    return good.unionAll(bad).select("geoid", wkt_polygons(F.col("geometry")).isNotNull().alias("sound"))


@query("""
with d as (select emb_id, coalesce(city, '') as s, ('0x' || substr(md5(emb_id || '|42'), 1, 8))::bigint as h from listing_embeddings),
r as (select s, (row_number() over (partition by s order by h, emb_id) - 1) % 5 as fold from d)
select s as city, fold::int as fold, count(*) as n from r group by all
""")
def stratified_fold_sizes(spark, folder):
    rows = table(spark, folder, "listing_embeddings").select("emb_id", "city")
    return es.stratified_folds(rows, "emb_id", "city").groupBy(F.coalesce("city", F.lit("")).alias("city"), "fold").agg(F.count("*").alias("n"))
