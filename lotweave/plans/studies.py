"""Queries of the full analysis table and the studies on it, of rewrites, simulations and theory, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotweave.functions import numeric as nm
from lotweave.functions import text as tx
from lotweave.operators import audit as au
from lotweave.operators import counterfactual as cf
from lotweave.operators import estimate as es
from lotweave.operators import features as ft
from lotweave.operators import identification as idn
from lotweave.operators import simulate as si
from lotweave.operators import spatial as sp
from lotweave.operators import theory as th
from lotweave.operators import vocabulary as vo
from lotweave.plans import reference as rf
from lotweave.plans.registry import registry
from lotweave.session import Scratch
from lotweave.sources.tables import table

QUERIES, SQL, query = registry()
rounded = rf.rounded


# ---- the analysis table


def _context(spark: SparkSession, folder: str, scratch: Scratch) -> DataFrame:
    return ft.parcel_context(table(spark, folder, "parcels"), table(spark, folder, "crime"), table(spark, folder, "amenities"), table(spark, folder, "block_groups"), scratch)


def _features(spark: SparkSession, folder: str, drop: bool = False) -> ft.Analysis:
    scratch = Scratch(spark)
    return ft.features_and_target(table(spark, folder, "listing_embeddings"), _context(spark, folder, scratch), scratch, drop)


def _study(spark: SparkSession, folder: str) -> DataFrame:
    """The rows with all confounders, written once."""
    a = _features(spark, folder)
    return Scratch(spark).cut(ft.study_rows(a).where("city is not null and lat is not null and lon is not null"))


_CONTEXT_SQL = f"""
with sites as (select row_id, latitude, longitude, sale_date, bedrooms::double as bedrooms, year_built::double as year_built, bldg_area_sqft, lot_area_sqft, units_res::double as units_res from parcels where latitude is not null and longitude is not null and latitude <> 0 and longitude <> 0),
{rf._PLACES}, inc as (select latitude, longitude, {rf._crosswalk_sql()} as category from crime where latitude <> 0 and longitude <> 0),
cp as (select p.row_id, t.category from sites p join inc t on abs(t.latitude - p.latitude) < 0.004 where {rf._M} <= 300),
cg as (select row_id, {', '.join(f"count(*) filter (category = '{c}') as crime_{c}" for c in ft.CRIMES)}, count(*) as crime_total from cp group by row_id),
ap as (select p.row_id, coalesce(t.category, '') as category, coalesce(t.subcategory, '') as sub from sites p join places t on abs(t.latitude - p.latitude) < 0.006 where {rf._M} <= 500),
ag as (select row_id, {', '.join(f"count(*) filter (category = '{c}') as amenity_{c}" for c in ft.AMENITIES)}, count(*) as amenity_total from ap group by row_id),
ad as (select row_id, ln(sum(k)) - sum(k * ln(k)) / sum(k) as h from (select row_id, sub, count(*) as k from ap group by all) group by row_id),
dd as (select p.row_id, {', '.join(f"min({rf._M}) filter (category = '{c}') as dist_{c}_m" for c in ft.AMENITIES[3:])} from sites p, places t group by p.row_id),
ring as (select geoid, part, string_split(trim(part, '()'), ',') as pts from (select geoid, unnest(regexp_extract_all(geometry, '[(]?[(][^()]+[)]')) as part from block_groups)),
pt as (select geoid, part, generate_subscripts(pts, 1) as i, trim(unnest(pts)) as p from ring), xy as (select geoid, part, i, string_split(p, ' ')[1]::double as x, string_split(p, ' ')[2]::double as y from pt),
edge as (select geoid, x as x0, y as y0, lead(x) over w as x1, lead(y) over w as y1 from xy window w as (partition by geoid, part order by i)),
inside as (select row_id, geoid from sites join edge on x1 is not null and ((y0 > latitude) <> (y1 > latitude)) and longitude < (x1 - x0) * (latitude - y0) / (y1 - y0) + x0 group by all having count(*) % 2 = 1),
one as (select row_id, min(geoid) as geoid from inside group by row_id),
census as (select row_id, case when median_household_income >= 0 then median_household_income::double end as income, case when median_home_value >= 0 then median_home_value::double end as home_value from one join block_groups using (geoid)),
ctx as (select sites.*, income, home_value, {', '.join(f'coalesce(crime_{c}, 0) as crime_{c}' for c in [*ft.CRIMES, 'total'])}, {', '.join(f'coalesce(amenity_{c}, 0) as amenity_{c}' for c in [*ft.AMENITIES, 'total'])}, coalesce(h, 0) as amenity_diversity, {', '.join(f'dist_{c}_m' for c in ft.AMENITIES[3:])},
  sale_date between (select min(incident_date) from crime) and (select max(incident_date) from crime) as crime_temporal_match
  from sites left join census using (row_id) left join cg using (row_id) left join ag using (row_id) left join ad using (row_id) left join dd using (row_id)),
l as (select emb_id, city, price, latitude, longitude from listing_embeddings where price > 0 and not isnan(price)),
near_ as (select p.emb_id, t.row_id from l p, sites t where p.latitude is not null and p.longitude is not null qualify row_number() over (partition by p.emb_id order by {rf._M}, t.row_id) = 1),
full_ as (select l.emb_id as id, l.latitude as lat, l.longitude as lon, ln(price) as y, ctx.* exclude (row_id, latitude, longitude, sale_date) from l left join near_ using (emb_id) left join ctx using (row_id))
"""
_ALL = ["lat", "lon", *ft.PROPERTY, *ft.CONTEXT]


@query(_CONTEXT_SQL + f"select id, round(y, 9) as y, {', '.join(f'abs(round(coalesce(case when not isnan({c}::double) then {c}::double end, 0), 4)) as {c}' if c not in ('lat', 'lon') else f'round(coalesce({c}, 0), 6) as {c}' for c in _ALL)} from full_")
def features_table(spark, folder):
    """Outcome and all confounders; of a confounder too often missing, a column of nulls."""
    a = _features(spark, folder)
    rows = a.rows.select("id", F.round("y", 9).alias("y"), *[F.col(c).cast("double").alias(c) if c in a.names else F.lit(None).cast("double").alias(c) for c in _ALL])
    rows = rounded(rows, "lat", "lon")
    return rows.withColumns({c: F.abs(F.round(c, 4)) for c in _ALL[2:]})


@query(_CONTEXT_SQL + f"select name, round(avg(gap::int), 9) as missing, avg(gap::int) < 0.5 as kept from (select unnest([{', '.join(f'{{name: {chr(39)}{c}{chr(39)}, gap: {c} is null or isnan({c}::double)}}' for c in _ALL)}], recursive := true) from full_) group by name")
def feature_columns(spark, folder):
    """How much of each confounder is missing, and whether it stays."""
    scratch = Scratch(spark)
    context = _context(spark, folder, scratch)
    rows = table(spark, folder, "listing_embeddings").where("price > 0 and not isnan(price)").select(F.col("emb_id").alias("id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    hit = sp.nearest(rows.select("id", F.col("lat").alias("latitude"), F.col("lon").alias("longitude")), context.select("row_id", "latitude", "longitude"), "id", "row_id", scratch).select("id", "row_id")
    full = rows.join(hit.join(context.drop("latitude", "longitude"), "row_id"), "id", "left")
    gap = lambda c: F.avg((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("double"))
    s = full.agg(*[gap(c).alias(c) for c in _ALL])
    long = s.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("missing")) for c in _ALL])).alias("r")).select("r.*")
    return long.select("name", F.round("missing", 9).alias("missing"), (F.col("missing") < 0.5).alias("kept"))


@query("select city, count(*) as n from listing_embeddings where emb is not null and len(emb) > 0 and len(list_filter(emb, lambda x: x is null or isnan(x))) = 0 and latitude is not null and longitude is not null and price > 0 and not isnan(price) and not isnan(latitude) and not isnan(longitude) and city is not null group by city")
def audit_rows(spark, folder):
    return ft.audit_rows(table(spark, folder, "listing_embeddings").where("city is not null")).groupBy("city").agg(F.count("*").alias("n"))


@query()
def audit_report(spark, folder):
    """The audit of each city's embeddings, with all confounders."""
    return au.report(_study(spark, folder))


@query()
def independence_tests(spark, folder):
    return au.independence(_study(spark, folder), permutations=500)


@query()
def regression_sensitivity(spark, folder):
    return au.regression_sensitivity(_study(spark, folder))


@query()
def model_verdicts(spark, folder):
    return au.model_verdicts(_study(spark, folder))


@query()
def price_models(spark, folder):
    """Prices from structured columns, and from these with the embedding."""
    return au.price_models(_study(spark, folder))


@query()
def embedding_models(spark, folder):
    """The effect with the given embedding, and with the shorter one that its first half is."""
    rows = _study(spark, folder).withColumnRenamed("emb", "given").withColumn("half", F.slice("given", 1, 16))
    return au.embedding_effects(rows, ["given", "half"])


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """id, city, label, description of the listings that have a text and a zip."""
    rows = table(spark, folder, "listings").where("description is not null")
    return rows.select(F.col("listing_id").alias("id"), F.coalesce("city_name", F.lit("")).alias("city"), tx.zip5(F.col("zip")).alias("label"), "description").where("label is not null")


@query()
def place_ablation(spark, folder):
    """How much of the labels is told by embeddings of whole texts, and of texts without place names."""
    rows = _texts(spark, folder).select("id", "city", "label", cf.text_vector(F.col("description")).alias("whole"), cf.text_vector(tx.without_places(F.col("description"))).alias("ablated"))
    return au.ablation(Scratch(spark).cut(rows), "whole", "ablated")


@query()
def style_against_embedding(spark, folder):
    """How well a text's zip is told from its style, and from its embedding."""
    style = tx.style(F.col("description"), tx.function_words())
    rows = _texts(spark, folder).withColumn("s", style).where("s is not null")
    names = [f.name for f in rows.schema["s"].dataType.fields]
    tags = tx.tag_shares(tx.word_tags(F.col("description")))
    rows = Scratch(spark).cut(rows.select("id", "label", "description", "s", tags.alias("tags")))
    vector = F.array(*[F.coalesce(F.col("s")[n].cast("double"), F.lit(0.0)) for n in names], *[F.coalesce(F.col("tags")[n], F.lit(0.0)) for n in tx.TAG_CLASSES])
    rows = rows.select("id", F.lit("all").alias("city"), "label", vector.alias("style"), cf.text_vector(F.col("description")).alias("hashed"))
    return au.style_and_embedding(Scratch(spark).cut(rows), "style", "hashed")


@query()
def label_told_by_text(spark, folder):
    """Which source a text is told to come from, against its own: rows of a confusion table."""
    rows = table(spark, folder, "documents").where("text is not null and source is not null").select("doc_id", "text", "source")
    held = F.pmod(es.hash_number(F.col("doc_id"), 5), F.lit(5)) == 0
    model = cf.label_classifier(rows.where(~held), "text", "source")
    return model.transform(rows.where(held)).groupBy("source", "told").agg(F.count("*").alias("n"))


@query()
def uniqueness_effect(spark, folder):
    """Whether words that stand out from the neighbours' go with price: a regression with robust errors, and the effect adjusted for all confounders."""
    scratch = Scratch(spark)
    listings = table(spark, folder, "listings")
    w = scratch.cut(vo.tf_idf(listings, "listing_id", "description", sorted(tx.function_words())))
    near = sp.nearest(listings, listings.select(F.col("listing_id").alias("other_id"), "latitude", "longitude"), "listing_id", "other_id", scratch, k=5, skip_self=True)
    unique = scratch.cut(vo.uniqueness(w, near, "listing_id", "other_id"))
    rows = listings.where("price > 0").select("listing_id", F.ln("price").alias("y"), "latitude", "longitude").join(unique, "listing_id").where("latitude is not null and longitude is not null")
    rows = scratch.cut(es.z_score(rows, "uniqueness", "t"))
    fit = es.least_squares(rows, ["t", "latitude", "longitude"], "y")
    coefficient, se = fit["coefficients"]["t"]
    adjusted = es.partial_linear(es.linear_residuals(rows, "listing_id", "y", "t", ["latitude", "longitude"])).select(F.lit("adjusted").alias("model"), "theta", "se", "n")
    return adjusted.unionAll(spark.createDataFrame([("regression", coefficient, se, fit["n"])], "model string, theta double, se double, n long"))


# ---- sensitivity


@query(rf._STUDY + ", " + rf._THETA + """, s as (select any_value(theta) as theta, sqrt(var_samp(psi) / count(*)) as se, sqrt(var_samp(y_res - theta * t_res) / var_samp(t_res)) as scale, stddev_samp(y_res) as sd_y from sc),
q as (select *, greatest(abs(theta) - 1.959963984540054 * se, 0) as near_ from s), e as (select *, exp(0.91 * near_ / sd_y) as rr from q)
select round(sqrt(least(greatest((-pow(near_, 2) + sqrt(pow(near_, 4) + 4 * pow(scale, 2) * pow(near_, 2))) / (2 * pow(scale, 2)), 0), 1)), 6) as rv_alpha, round(case when near_ > 0 then rr + sqrt(rr * (rr - 1)) else 1 end, 6) as e_value_interval, round(abs(theta) / (abs(theta) + 2 * se), 6) as regression_robustness from e
""")
def robust_intervals(spark, folder):
    """How strong a confounder must be to take significance away, by three measures."""
    res = Scratch(spark).cut(rf._residuals(spark, folder))
    fit, scale = es.partial_linear(res).first(), es.bias_scale(res).first()
    row = (round(nm.robustness_value_alpha(fit["theta"], fit["se"], scale["scale"]), 6), round(nm.e_value_interval(fit["theta"], fit["se"], scale["sd_y"]), 6), round(nm.regression_robustness(fit["theta"], fit["se"]), 6))
    return spark.createDataFrame([row], "rv_alpha double, e_value_interval double, regression_robustness double")


@query()
def prior_sensitivity(spark, folder):
    """The effect under confounders whose strengths are drawn from a prior."""
    scale = es.bias_scale(rf._residuals(spark, folder)).first()
    return es.beta_priors(spark, scale["theta"], scale["scale"])


@query("""
with d as (select city = 'sf' as own, avg(ln(price)) as theta, stddev_samp(ln(price)) / sqrt(count(*)) as se from listing_embeddings where price > 0 and not isnan(price) and city is not null group by city = 'sf', emb_id % 8 having count(*) > 1 and stddev_samp(ln(price)) > 0),
p as (select avg(theta) as mu, stddev_samp(theta) as sigma, median(se) as se from d where not own), f as (select avg(theta) as theta, avg(se) as se from d where own)
select round(mu, 6) as mu, round(sigma, 6) as sigma, round(sigma / p.se, 6) as inflation, round((theta - mu) / greatest(sigma, f.se), 6) as z from p, f
""")
def calibrated_estimate(spark, folder):
    """An estimate held against the spread of placebo ones: a city's mean price against that of eight parts of the others'."""
    rows = table(spark, folder, "listing_embeddings").where("price > 0 and not isnan(price) and city is not null").withColumn("own", F.col("city") == "sf")
    by = rows.groupBy("own", F.pmod("emb_id", F.lit(8)).alias("part")).agg(F.avg(F.ln("price")).alias("theta"), (F.stddev_samp(F.ln("price")) / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("n")).where("n > 1 and se > 0")
    placebos = [(r["theta"], r["se"]) for r in by.where("not own").collect()]  # eight rows
    own = by.where("own").agg(F.avg("theta").alias("theta"), F.avg("se").alias("se")).first()
    c = nm.calibrate(placebos, own["theta"], own["se"])
    return spark.createDataFrame([tuple(round(c[k], 6) for k in ("mu", "sigma", "inflation", "z"))], "mu double, sigma double, inflation double, z double")


@query()
def resampled_mean(spark, folder):
    """The mean price with an interval over resamples of row numbers."""
    return es.index_bootstrap(table(spark, folder, "listing_embeddings").where("price > 0 and not isnan(price)").withColumn("v", F.ln("price")), "emb_id", "v", most=10_000_000)


# ---- rewrites


def _rewritten(spark: SparkSession, folder: str) -> DataFrame:
    """(listing_id, arm, passed, baseline, predicted) of the rewrites of all texts, scored by a text effect fitted on the listings."""
    scratch = Scratch(spark)
    listings = table(spark, folder, "listings").where("description is not null and latitude is not null and longitude is not null")
    known = listings.where("price > 0").select("listing_id", F.ln("price").alias("y"), "latitude", "longitude", cf.text_vector(F.col("description")).alias("v"))
    fit = cf.text_direction(scratch.cut(known), "v", "y", ["latitude", "longitude"], "listing_id")
    own = listings.withColumn("own", cf.text_part(cf.text_vector(F.col("description")), fit))
    arms = cf.rewrites(own, "listing_id", "description", F.coalesce("city_name", F.lit("the city")), keep=("description", "own"))
    same = F.col("rewrite").eqNullSafe(F.col("description"))
    # texts stay where they are: only what a rewrite adds to the prediction is written; an unchanged text has its own
    effect = F.when(same, F.col("own")).otherwise(cf.text_part(F.col("v"), fit))
    arms = scratch.cut(arms.withColumn("v", cf.text_vector(F.when(~same, F.col("rewrite")))).select("listing_id", "arm", "passed", effect.alias("effect")))
    places = listings.groupBy("listing_id").agg(F.min("latitude").alias("latitude"), F.min("longitude").alias("longitude"))
    rows = arms.join(places, "listing_id").withColumn("baseline", cf.confounded_part(["latitude", "longitude"], fit))
    return rows.select("listing_id", "arm", "passed", "baseline", (F.col("baseline") + F.col("effect")).alias("predicted"))


@query()
def rewrite_effects(spark, folder):
    """The mean change of the predicted outcome of each arm's valid rewrites against the identical text, with intervals."""
    rows = Scratch(spark).cut(_rewritten(spark, folder))
    own = rows.where("arm = 'identity'").groupBy("listing_id").agg(F.min("predicted").alias("own"))
    changes = rows.where("passed and arm <> 'identity'").join(own, "listing_id").select("listing_id", "arm", (F.col("predicted") - F.col("own")).alias("change"))
    return cf.arm_effects(changes, "arm", "listing_id", "change")


@query("""
with d as (select listing_id, coalesce(city_name, '') as arm, (length(address) - 20) / 100.0 as change from listings where address is not null),
u as (select arm, change, b, ('0x' || substr(md5(listing_id || '#' || b || '|7'), 1, 7))::bigint / 268435456.0 as u from d, (select unnest(range(1, 101)) as b)),
c as (select list_sum(list_transform(range(0, 8), lambda k: case when u >= list_sum(list_transform(range(0, k + 1), lambda j: exp(-1) / factorial(j::int))) then 1 else 0 end)) as k, b, change, arm from u),
m as (select arm, b, sum(change * k) / nullif(sum(k), 0) as m from c group by 1, 2), q as (select arm, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from m group by arm)
select arm, count(*) as n, round(avg(change), 6) as mean_change, round(any_value(lo), 6) as low, round(any_value(hi), 6) as high, round((exp(avg(change)) - 1) * 100, 6) as percent from d join q using (arm) group by arm
""")
def group_changes(spark, folder):
    """The same means and intervals over groups of listings, of a change that SQL knows too."""
    rows = table(spark, folder, "listings").where("address is not null").select("listing_id", F.coalesce("city_name", F.lit("")).alias("arm"), ((F.length("address") - 20) / F.lit(100.0)).alias("change"))
    return rounded(cf.arm_effects(rows, "arm", "listing_id", "change", 100), "mean_change", "low", "high", "percent")


# ---- simulated markets


@query("""
with v as (select zip, list_transform(emb, lambda x: x::double) as e from listing_embeddings where emb is not null and zip is not null),
w as (select count(*) as n, list_sum(list(e[1])) / count(*) as m1, list_sum(list(e[2])) / count(*) as m2 from v)
select zip as label, count(*) as n, count(*) >= 10 as own, round(case when count(*) >= 10 then avg(e[1]) else any_value(m1) end, 6) as m1, round(case when count(*) >= 10 then avg(e[2]) else any_value(m2) end, 6) as m2 from v, w group by zip
""")
def generator_bins(spark, folder):
    """Each zip's distribution of embeddings: here its rows and the first two means."""
    s = si.bin_summaries(table(spark, folder, "listing_embeddings"), "zip", "emb")
    return s.select("label", "n", "own", F.round(F.col("mean")[0], 6).alias("m1"), F.round(F.col("mean")[1], 6).alias("m2"))


@query("""
with d as (select ln(price) as y, emb[1]::double as e from listing_embeddings where emb is not null and price > 0 and not isnan(price))
select round(var_samp(y), 6) as var_outcome, round(var_samp(e), 6) as var_projection, round(sqrt(0.05 / 0.95 * var_samp(y) / var_samp(e)), 6) as slope from d
""")
def calibrated_slope(spark, folder):
    """The slope at which text makes up a twentieth of the outcome's variance."""
    rows = table(spark, folder, "listing_embeddings").where("emb is not null and price > 0 and not isnan(price)").select(F.ln("price").alias("y"), F.col("emb")[0].cast("double").alias("e"))
    return rounded(si.variance_share_slope(rows, F.col("y"), F.col("e"), 0.05), "var_outcome", "var_projection", "slope")


@query()
def simulated_estimators(spark, folder):
    """Bias, coverage and power of four estimators in markets made like the given one, text having no effect or one of known size."""
    gen = si.generator_of(si.bin_summaries(table(spark, folder, "listing_embeddings").withColumn("zip", tx.zip5(F.col("zip"))), "zip", "emb"))
    return es.replicate_summary(si.replicates(spark, gen, sizes=(500,), shares=(0.0, 0.05), reps=5), ["estimator", "n", "share"], "truth")


# ---- theory


@query()
def bound_chain(spark, folder):
    return th.bound_chain(th.probe_bounds(spark, 2000, 2))


@query()
def reversed_game(spark, folder):
    return th.reversed_game(spark)


@query()
def ladder_gate(spark, folder):
    return th.ladder_gate(spark, 1500, 2)


@query()
def identity_gap(spark, folder):
    return th.identity_gap(spark)


@query()
def consistency_rate(spark, folder):
    return th.rate_of(th.consistency(spark))


@query("""
select regr_slope(ln(e), ln(m)) between -0.7 and -0.3 as in_band, count(*) as sizes, round(regr_slope(ln(e), ln(m)), 6) as slope from (select l_linenumber::double as m, avg(abs(l_discount - 0.02)) / sqrt(l_linenumber) as e from lineitem group by l_linenumber)
""")
def rate_of_errors(spark, folder):
    """The same slope over errors that SQL knows too."""
    m = F.col("l_linenumber").cast("int").alias("m")
    rows = table(spark, folder, "lineitem").select(m, (F.abs(F.col("l_discount") - 0.02) / F.sqrt(F.col("l_linenumber"))).alias("error"))
    return rounded(th.rate_of(rows), "slope")


@query()
def saddle_sweep(spark, folder):
    return th.saddle_summary(th.saddle_sweep(spark))


@query()
def adjusted_graph_effect(spark, folder):
    return th.adjusted_effect(spark)


@query("""
with recursive e(u, v) as (values ('L', 'X'), ('L', 'C'), ('L', 'T'), ('L', 'Y'), ('X', 'T'), ('X', 'Y'), ('C', 'T'), ('C', 'Y')), s as (select u, v from e union all select v, u from e),
p(node, path) as (select 'T', ['T'] union all select s.v, list_append(path, s.v) from p join s on p.node = s.u where p.node <> 'Y' and not list_contains(path, s.v)),
r(a, b) as (select u, u from e union select v, v from e union select r.a, e.v from r join e on r.b = e.u),
full_ as (select path, list_aggregate(path, 'string_agg', '-') as name from p where node = 'Y'),
inner_ as (select name, path[i] as m, (select count(*) from e where (u = path[i - 1] and v = path[i]) or (u = path[i + 1] and v = path[i])) = 2 as collider from (select *, unnest(range(2, len(path))) as i from full_)),
b as (select name, bool_or(case when collider then not exists (select 1 from r where r.a = m and r.b in ('L', 'X', 'C')) else m in ('L', 'X', 'C') end) as blocked from inner_ group by name)
select name as path, coalesce(blocked, false) as blocked from full_ left join b using (name)
""")
def computed_paths(spark, folder):
    """All paths between text and outcome, and whether place, property and context block them."""
    return idn.path_table(spark, idn.GRAPH, "T", "Y", {"L", "X", "C"})
