"""The pN_ queries of the core's own problems, and SQL to hold them against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotweave.operators.deliveries import split_deliveries
from lotweave.operators.impute import fill_parcels
from lotweave.operators.proximity import containing, locate, near
from lotweave.session import Scratch
from lotweave.sources.tables import table

FIELDS = ["bedrooms", "year_built", "bldg_area_sqft", "land_use"]
NEAR_M = 60.0


def p2_filled(spark: SparkSession, folder: str) -> DataFrame:
    """parcels, filled, with the marks."""
    return fill_parcels(table(spark, folder, "parcels"), Scratch(spark))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    need = table(spark, folder, "parcels").select("row_id", "city", "zip", "block", "units_res", "lot_area_sqft", "assessed_total", *FIELDS)
    filled = fill_parcels(need, Scratch(spark))
    marks = F.array_compact(F.array(*[F.when(F.col(f"{f}_missing"), F.lit(f)) for f in FIELDS]))
    return filled.select("row_id", F.explode(marks).alias("field"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    crime = table(spark, folder, "crime").select("incident_id", "latitude", "longitude")
    amenities = table(spark, folder, "amenities").select("osm_id", "latitude", "longitude").distinct()
    pairs = near(crime, amenities, NEAR_M).select(F.lit("near").alias("kind"), F.col("p.incident_id").alias("point_id"), F.col("t.osm_id").cast("string").alias("target_id"))
    parcels = locate(table(spark, folder, "parcels").select("row_id", "latitude", "longitude", "geometry")).select("row_id", "_x", "_y")
    groups = table(spark, folder, "block_groups").select("geoid", "geometry")
    within = containing(parcels, groups).select(F.lit("in").alias("kind"), F.col("p.row_id").cast("string").alias("point_id"), F.col("t.geoid").alias("target_id"))
    known = "point_id is not null and target_id is not null"
    return pairs.where(known).distinct().unionAll(within.where(known).distinct())


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    need = table(spark, folder, "search_results").select("delivery_id", "delivered_at", "address", "city_name", "price", "url")
    return split_deliveries(need, Scratch(spark))[1].select("delivery_id")


def p4_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The whole rows of the deliveries that remain."""
    return split_deliveries(table(spark, folder, "search_results"), Scratch(spark))[0]


QUERIES = {"p2_found": p2_found, "p2_filled": p2_filled, "p3_found": p3_found, "p4_found": p4_found, "p4_kept": p4_kept}

SQL: dict[str, str] = {}
SQL["p2_found"] = """
with v as (select row_id,
  case when bedrooms between 0 and 20 then 1 end b,
  case when year_built between 1700 and 2026 then 1 end y,
  case when not isnan(bldg_area_sqft) and bldg_area_sqft between 100 and 1000000 then 1 end a,
  case when upper(trim(regexp_replace(land_use, '^\\s+|\\s+$', '', 'g'))) in ('R1','R2','R3','R4','CD','A') then 1 end l from parcels)
select row_id, 'bedrooms' as field from v where b is null
union all select row_id, 'year_built' from v where y is null
union all select row_id, 'bldg_area_sqft' from v where a is null
union all select row_id, 'land_use' from v where l is null
"""
_SPACES = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def _filled_sql(rounds: int = 8, tolerance: float = 5e-3) -> str:
    """The propagation in SQL, a cell and slot to a row; a round after one that moved nothing by more than the tolerance repeats it. Then the last round of the finer edges."""
    uses = ("R1", "R2", "R3", "R4", "CD", "A")
    block, area, units = "c || chr(1) || z || chr(1) || b", "c || chr(1) || z", "u"
    size = lambda v, d: f"floor(round(log2({v}) * 2, 9) + {d})::bigint"
    edges = [(f"{block} || chr(1) || {units}", 8), (block, 4), (f"{area} || chr(1) || {units}", 2), (area, 1), (f"c || chr(1) || {units}", 0.5), ("c", 0.1), ("'all'", 1e-6)]
    finer = [f"{block} || chr(1) || {size(v, d)}" for v in ("lot", "total") for d in (0, 0.5)]
    slots = [("b_v", "20.0"), ("y_v", "326.0"), ("a_v", "999900.0")]
    numbers = " union all ".join(f"select cell, {i} as slot, {scale} as scale, sum({v}) as s, count({v}) as n, count(*) - count({v}) as m from v group by cell" for i, (v, scale) in enumerate(slots))
    shares = " union all ".join(f"select cell, {i}, 1.0, sum(case when l_v = '{u}' then 1.0 when l_v is not null then 0.0 end), count(l_v), count(*) - count(l_v) from v group by cell" for i, u in enumerate(uses, 3))
    sql = f"""
with p as (select *, lower(trim(city)) as c, lower(trim(zip)) as z, lower(trim(block)) as b, case when units_res >= 0 then least(units_res, 50) end as u,
    case when lot_area_sqft > 0 and not isnan(lot_area_sqft) then lot_area_sqft end as lot, case when assessed_total > 0 and not isnan(assessed_total) then assessed_total end as total,
    case when bedrooms between 0 and 20 then bedrooms::double end as b_v, case when year_built between 1700 and 2026 then year_built::double end as y_v,
    case when not isnan(bldg_area_sqft) and bldg_area_sqft between 100 and 1000000 then bldg_area_sqft end as a_v,
    case when upper({_SPACES.format('land_use')}) in {uses} then upper({_SPACES.format('land_use')}) end as l_v from parcels),
k as (select *, {', '.join(f"'{i}:' || {e}::varchar as g{i}" for i, (e, _) in enumerate(edges))}, {', '.join(f"'{i}:' || {e}::varchar as f{i}" for i, e in enumerate(finer))} from p),
v as materialized (select *, concat_ws(chr(2), {', '.join(f"coalesce(g{i}, '-')" for i in range(len(edges)))}) as cell from k),
slot as materialized ({numbers} union all {shares}),
hub as materialized ({' union all '.join(f"select distinct cell, g{i} as hub, {w}::double as w from v where g{i} is not null" for i, (_, w) in enumerate(edges))}),
e0 as (select cell, slot, scale, m, null::double as e, false as still from slot)"""
    for r in range(1, rounds + 1):
        sql += f""",
h{r} as (select hub, slot, sum(coalesce(s, 0) + coalesce(e * slot.m, 0)) / nullif(sum(n + case when e is not null then slot.m else 0 end), 0) as h from slot join e{r - 1} using (cell, slot) join hub using (cell) group by hub, slot),
f{r} as (select cell, slot, sum(w * h) / nullif(sum(case when h is not null then w end), 0) as e from hub join h{r} using (hub) group by cell, slot),
e{r} as materialized (select o.cell, o.slot, scale, m, case when still then o.e else f.e end as e,
    still or coalesce(max(case when m > 0 then coalesce(abs(f.e - o.e) / scale, case when f.e is not null then 1.0 else 0.0 end) else 0.0 end) over (), 0) <= {tolerance} as still from e{r - 1} o left join f{r} f using (cell, slot))"""
    wide = ", ".join(f"max(e) filter (slot = {i}) as e{i}" for i in range(9))
    best = f"list_sort([{', '.join(f'{{e: round(e{i}, 9), j: {-i}, v: {chr(39)}{u}{chr(39)}}}' for i, u in enumerate(uses, 3))}], 'desc')[1].v"
    numbers = " union all ".join(f"select row_id, {i} as slot, {v} as v, e{i} as e, f0, f1, f2, f3 from v join w using (cell)" for i, (v, _) in enumerate(slots))
    near = " union all ".join(f"select row_id, slot, v, e, f{i} as hub from x where f{i} is not null" for i in range(4))
    final = " ".join(f"left join (select row_id, e as d{i} from z where slot = {i}) using (row_id)" for i in range(3))
    return f"""{sql},
w as (select cell, {wide} from e{rounds} group by cell),
x as ({numbers}),
y as ({near}),
means as (select hub, slot, avg(coalesce(v, e)) as h from y group by hub, slot),
z as (select x.row_id, x.slot, coalesce((any_value(x.e) * 6 + sum(4 * h)) / (6 + sum(case when h is not null then 4 end)), any_value(x.e)) as e from x left join y using (row_id, slot) left join means on means.hub = y.hub and means.slot = y.slot group by x.row_id, x.slot)
select parcels.* replace (coalesce(b_v, round_even(round(least(greatest(d0, 0), 20), 6), 0))::int as bedrooms, coalesce(y_v, round_even(round(least(greatest(d1, 1700), 2026), 6), 0))::int as year_built,
    coalesce(a_v, round(least(greatest(d2, 100), 1000000), 3)) as bldg_area_sqft, coalesce(l_v, case when e3 is not null then {best} end) as land_use),
  b_v is null as bedrooms_missing, b_v is null and e0 is not null as bedrooms_filled, y_v is null as year_built_missing, y_v is null and e1 is not null as year_built_filled,
  a_v is null as bldg_area_sqft_missing, a_v is null and e2 is not null as bldg_area_sqft_filled, l_v is null as land_use_missing, l_v is null and e3 is not null as land_use_filled
from parcels join v using (row_id) join w using (cell) {final}
"""


SQL["p2_filled"] = _filled_sql()
_DELIVERY = """
with recursive s as (
  select delivery_id, delivered_at, city_name, price,
    case when trim(coalesce(url, '')) = '' then null else coalesce('0:' || nullif(regexp_extract(lower(trim(url)), '^(?:(?:https?:)?//(?:[a-z0-9-]+[.])*listings[.]example(?::[0-9]+)?)?/(?:[^?#]*/)?home/([0-9]+)/*(?:[?#].*)?$', 1), ''), '1:' || trim(url)) end as home,
    case when price is not null and city_name is not null and trim(address) <> '' then '2:' || trim(regexp_replace(lower(address), '\\s+', ' ', 'g')) || chr(1) || city_name || chr(1) || price end as place
  from search_results),
live as (select distinct place from s where home is null and place is not null),
k as (select s.*, coalesce(home, place, '3:' || delivery_id) as key, case when place in (select place from live) then place end as tie from s),
edge as (select distinct home as a, tie as b from k where home is not null and tie is not null),
both_ways as (select a, b from edge union all select b, a from edge),
reach(n, m) as (select a, a from both_ways union select r.n, e.b from reach r join both_ways e on r.m = e.a),
root as (select n, min(m) as r from reach group by n),
msg as (select k.*, coalesce(r, key) as message from k left join root on key = n),
ranked as (select *, row_number() over (partition by message order by delivered_at nulls last, delivery_id) as rn from msg)
"""
SQL["p4_found"] = _DELIVERY + "select delivery_id from ranked where rn > 1"
SQL["p4_kept"] = _DELIVERY + "select search_results.* from search_results join ranked using (delivery_id) where rn = 1"
SQL["p3_found"] = """
with a as (select distinct osm_id, latitude, longitude from amenities where latitude is not null and longitude is not null),
c as (select distinct incident_id, latitude, longitude from crime where latitude is not null and longitude is not null and incident_id is not null),
nearby as (select distinct 'near' as kind, incident_id as point_id, osm_id::varchar as target_id from c join a
  on c.latitude between a.latitude - 0.001 and a.latitude + 0.001
  where 2 * 6371000 * asin(sqrt(pow(sin(radians(a.latitude - c.latitude) / 2), 2)
    + cos(radians(c.latitude)) * cos(radians(a.latitude)) * pow(sin(radians(a.longitude - c.longitude) / 2), 2))) <= 60),
ring(src, id, part, outer_ring, pts) as (
  select 'b', geoid, part, starts_with(part, '(('), string_split(trim(part, '()'), ',') from (select geoid, unnest(regexp_extract_all(geometry, '[(]?[(][^()]+[)]')) as part from block_groups)
  union all
  select 'p', row_id::varchar, part, starts_with(part, '(('), string_split(trim(part, '()'), ',')
  from (select row_id, unnest(case when geometry like 'POINT%' then ['(' || geometry[7:]] else regexp_extract_all(geometry, '[(]?[(][^()]+[)]') end) as part
        from parcels where latitude is null or longitude is null)),
pt as (select src, id, part, outer_ring, generate_subscripts(pts, 1) as i, trim(unnest(pts)) as p from ring),
xy as (select src, id, part, outer_ring, i, string_split(p, ' ')[1]::double as x, string_split(p, ' ')[2]::double as y from pt),
edge as (select src, id, part, outer_ring, x as x0, y as y0, lead(x) over w as x1, lead(y) over w as y1 from xy window w as (partition by src, id, part order by i)),
o as (select src, id, min(x) as ox, min(y) as oy from xy group by 1, 2),
mom as (select src, id, part, outer_ring,
    sum((x0 - ox) * (y1 - oy) - (x1 - ox) * (y0 - oy)) / 2 as ar,
    sum((x0 + x1 - 2 * ox) * ((x0 - ox) * (y1 - oy) - (x1 - ox) * (y0 - oy))) / 6 as mx,
    sum((y0 + y1 - 2 * oy) * ((x0 - ox) * (y1 - oy) - (x1 - ox) * (y0 - oy))) / 6 as my
  from edge join o using (src, id) where x1 is not null group by all),
centre as (select id, sum(case when outer_ring then 1 else -1 end * sign(ar) * mx) / sum(case when outer_ring then 1 else -1 end * abs(ar)) + any_value(ox) as x,
    sum(case when outer_ring then 1 else -1 end * sign(ar) * my) / sum(case when outer_ring then 1 else -1 end * abs(ar)) + any_value(oy) as y
  from mom join o using (src, id) where src = 'p' group by id having sum(abs(ar)) > 0),
place as (select row_id::varchar as id, longitude as x, latitude as y from parcels where latitude is not null and longitude is not null
  union all select * from centre
  union all select id, x, y from xy where src = 'p' and id in (select id from ring group by id having count(*) = 1 and max(len(pts)) = 1)),
within_ as (select 'in' as kind, place.id as point_id, edge.id as target_id from place join edge on edge.src = 'b' and x1 is not null
    and ((y0 > y) <> (y1 > y)) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0
  group by 1, 2, 3 having count(*) % 2 = 1)
select * from nearby union all select * from within_
"""
