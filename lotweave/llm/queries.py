"""The pN_ queries of this subpackage, and SQL to hold them against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotweave.llm import mixing, neardup, pii, places, repetition, splits, tokens
from lotweave.session import Scratch
from lotweave.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "listing_embeddings").select("emb_id", "zip", "parcel_id")
    groups = splits.related_groups(rows, Scratch(spark))
    return groups.where("group like '0:%'").select("emb_id", F.substring("group", 3, 5).alias("group_zip"))


def p1_splits(spark: SparkSession, folder: str) -> DataFrame:
    rows, scratch = table(spark, folder, "listing_embeddings").select("emb_id", "zip", "parcel_id"), Scratch(spark)
    return splits.assign_splits(rows, splits.related_groups(rows, scratch), scratch)


def p1_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Records each split has and should have, and the zips and parcels it shares with others."""
    rows, scratch = table(spark, folder, "listing_embeddings").select("emb_id", "zip", "parcel_id"), Scratch(spark)
    assigned = scratch.cut(splits.assign_splits(rows, splits.related_groups(rows, scratch), scratch))
    return splits.split_report(rows, assigned, {"train": 0.7, "validation": 0.15, "test": 0.15})


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    tagger = pii.tagger_for(table(spark, folder, "given_names"))
    found = pii.find(table(spark, folder, "listings").where("listing_id is not null"), tagger, "listing_id", "description")
    return found.select("listing_id", "kind", "found").distinct()


def p5_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """listing_id, and the description with placeholders."""
    tagger = pii.tagger_for(table(spark, folder, "given_names"))
    return pii.redact(table(spark, folder, "listings").select("listing_id", "description"), tagger, "description").drop("description")


def _places(spark: SparkSession, folder: str) -> DataFrame:
    records = places.all_records(table(spark, folder, "boston_assessment"), table(spark, folder, "listings"))
    return places.place_of(records, Scratch(spark))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return places.same_place_pairs(_places(spark, folder))


def p6_places(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every record, and how many records name it."""
    found = _places(spark, folder)
    return found.join(found.groupBy("place").agg(F.count("*").alias("records")), "place").select("id", "place", "records")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "listings").select("listing_id", "description")
    return neardup.NearDuplicates(rows, Scratch(spark), "listing_id", "description", length=3, least=0.6).pairs()


def p7_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The same for the texts of documents, in runs of five words at 0.8, counting repeated runs: a class and a number of links each."""
    rows = table(spark, folder, "documents").select("doc_id", "text")
    return neardup.NearDuplicates(rows, Scratch(spark), "doc_id", "text", counted=True).groups()


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_table(table(spark, folder, "documents").select("doc_id", "text"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """The capped sources in the report of the whole mixture."""
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), Scratch(spark))[1].where("capped").select("source")


def p9_mixed(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), Scratch(spark))[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), Scratch(spark))[1]


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents inside the band of token entropy that a repeated share of 0.3 allows, and with that share by the exact measure."""
    return repetition.repeated_shares(table(spark, folder, "documents").select("doc_id", "text")).where("repeated_share >= 0.3").select("doc_id")


def p10_report(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.report(table(spark, folder, "documents"), Scratch(spark))


QUERIES = {"p1_found": p1_found, "p1_splits": p1_splits, "p1_shares": p1_shares, "p5_found": p5_found, "p5_redacted": p5_redacted, "p6_found": p6_found, "p6_places": p6_places, "p7_found": p7_found, "p7_groups": p7_groups, "p8_ids": p8_ids, "p9_found": p9_found, "p9_mixed": p9_mixed, "p9_shares": p9_shares, "p10_found": p10_found, "p10_report": p10_report}

SQL: dict[str, str] = {}
SQL["p1_found"] = """
with recursive s as (
  select emb_id, trim(parcel_id) as parcel, regexp_extract(zip, '^\\s*(?:[A-Za-z.]+[\\s:#-]*)*([0-9]{1,9})(?:[.]0*)?(?:\\s*-\\s*[0-9]{4})?\\s*$', 1) as d from listing_embeddings),
k as (select emb_id, nullif('1:' || parcel, '1:') as p, case when d = '' then null else '0:' || nullif(case when length(d) <= 5 then lpad(d, 5, '0') else left(lpad(d, 9, '0'), 5) end, '00000') end as z from s),
edge as (select distinct z as a, p as b from k where z is not null and p is not null),
many as (select b from edge group by b having count(*) > 1),
live as (select * from edge where b in (select b from many)),
both_ways as (select a, b from live union select b, a from live),
reach(n, m) as (select a, a from both_ways union select r.n, e.b from reach r join both_ways e on r.m = e.a),
root as (select n, min(m) as r from reach group by n),
zips as (select a as n, coalesce(r, a) as r from (select distinct z as a from k where z is not null) left join root on a = n),
parcels_ as (select b as n, min(zips.r) as r from edge join zips on a = zips.n group by b)
select emb_id, substr(coalesce(zips.r, parcels_.r), 3) as group_zip from k left join zips on z = zips.n left join parcels_ on p = parcels_.n
where coalesce(zips.r, parcels_.r) is not null
"""
# a split's target can be met where single records are left to fill it with, so the records must be as many as the target
SQL["p1_shares"] = """
with t as (select count(*) as n, floor(0.15 * count(*) + 0.5)::bigint as k from listing_embeddings)
select 'train' as split, n - 2 * k as records, n - 2 * k as target, 0::bigint as broken from t
union all select 'validation', k, k, 0 from t union all select 'test', k, k, 0 from t
"""
SQL["p10_found"] = """
with w as (select doc_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) as w from documents),
r as (select doc_id, list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' ')) as r from w where len(w) >= 5)
select doc_id from r where 1 - len(list_distinct(r)) / len(r) >= 0.3
"""
SQL["p7_found"] = """
with w as (select listing_id as id, list_transform(regexp_extract_all(description, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) as w from listings where listing_id is not null),
t as (select id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as t from w where len(w) >= 3),
e as (select id, len(t) as n, unnest(t) as t from t),
both_ as (select a.id as id_a, b.id as id_b, count(*) as k, any_value(a.n) as n, any_value(b.n) as m from e a join e b on a.t = b.t and a.id < b.id group by 1, 2)
select id_a, id_b from both_ where k / (n + m - k) >= 0.6
"""
SQL["p7_groups"] = """
with recursive w as (select doc_id as id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), lambda x: lower(x)) as w from documents where text is not null),
r as (select id, unnest(list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' '))) as run from w where len(w) >= 5),
b as (select id, run, count(*) as c from r group by all), bag as (select id, md5(string_agg(run || ':' || c, '|' order by run)) as h, sum(c) as n from b group by id),
cls as (select id, n, min(id) over (partition by h) as rep from bag), rb as (select b.*, n from b join cls using (id) where cls.id = rep),
k as (select x.id as a, y.id as b, sum(least(x.c, y.c)) as k, any_value(x.n) as n, any_value(y.n) as m from rb x join rb y on x.run = y.run and x.id < y.id group by 1, 2),
links as (select a, b from k where k / (n + m - k) >= 0.8), both_ways as (select a, b from links union all select b, a from links),
reach(n, m) as (select a, a from both_ways union select r.n, e.b from reach r join both_ways e on r.m = e.a), root as (select n, min(m) as r from reach group by n),
ends as (select a, count(*) as links from both_ways group by a)
select id, rep, coalesce(r, rep) as "group", coalesce(links, 0) as links from cls left join root on rep = root.n left join ends on rep = a
"""
