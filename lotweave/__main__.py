"""Command line: python -m lotweave COMMAND --tables FOLDER [--out FOLDER] [--only NAME ...] [--skip NAME ...] [--city CITY ...]."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotweave.plans import formats, problems, reference, studies
from lotweave.session import get_spark, ship
from lotweave.sources import readers, writers

#: The queries of each command, in the order they run; ``all`` runs the stages one after another.
COMMANDS: dict[str, list[str]] = {
    "enrich": ["clean_parcel_ids", "inferred_sales", "radius_enrich", "amenity_diversity", "nearest_amenity", "census_attributes", "p3_found"],
    "clean": ["clean_descriptions", "normalize_address", "address_lookup", "p4_kept", "p2_filled"],
    "split": ["temporal_split", "release_split", "drift_between_cities"],
    "analyse": ["features_table", "backdoor_gain", "doubly_robust_boosted", "boosted_effect", "segment_effects", "randomization_test"],
    "audit": ["audit_report", "independence_tests", "model_verdicts"],
    "cate": ["score_cells", "heterogeneity_wald", "seed_stability"],
    "sensitivity": ["sensitivity", "robust_intervals", "prior_sensitivity", "strongest_covariates", "regression_sensitivity"],
    "controls": ["placebo_outcome", "placebo_treatments", "calibrated_estimate"],
    "mechanism": ["label_words", "word_classes", "style_measures", "style_against_embedding"],
    "rewrites": ["rewrite_arms", "rewrite_effects"],
    "simulate": ["simulation_grid", "simulated_estimators"],
    "replicate": ["uniqueness_effect", "price_models"],
    "theory": ["graph_paths", "adjusted_graph_effect", "bound_chain", "identity_gap", "consistency_rate", "ladder_gate", "reversed_game", "saddle_sweep"],
}
STAGES = ["enrich", "clean", "split", "analyse"]
#: Results of at most this many rows are also printed and written as one JSON file, larger ones as Parquet.
SHORT = 1000


def known() -> dict:
    return {k: f for m in (problems, reference, formats, studies) for k, f in m.QUERIES.items()}


def plan(command: str, only: list[str] | None, skip: list[str] | None) -> list[str]:
    """The names of the queries to run; unknown names are refused."""
    names = [q for c in STAGES for q in COMMANDS[c]] if command == "all" else [] if command == "query" else COMMANDS[command]
    wanted = list(only or names)
    missing = sorted({*wanted, *(skip or [])} - set(known()))
    if missing:
        raise SystemExit(f"no such query: {', '.join(missing)}")
    return [n for n in wanted if n not in (skip or [])]


def run(spark: SparkSession, names: list[str], folder: str, out: str | None, cities: list[str] | None = None) -> dict[str, str]:
    """Run queries one after another; one that fails is told and doesn't stop the others. What became of each."""
    became = {}
    for name in names:
        began = time.time()
        try:
            df = known()[name](spark, folder)
            if cities and "city" in df.columns:
                df = df.where(F.col("city").isin(*cities))
            keep(df, name, out)
            became[name] = f"{time.time() - began:.1f} s"
        except Exception as e:  # the next query has other inputs
            became[name] = f"failed: {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
        print(f"{name}: {became[name]}", file=sys.stderr, flush=True)
    return became


def keep(df: DataFrame, name: str, out: str | None) -> None:
    if out is None:
        df.show(20, truncate=60)
        return
    path = f"{out.rstrip('/')}/{name}"
    df.write.mode("overwrite").parquet(path)
    rows = df.sparkSession.read.schema(df.schema).parquet(path)
    if rows.count() <= SHORT:
        writers.write_report(rows, f"{path}.json")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="lotweave", description=__doc__)
    p.add_argument("command", choices=["all", "query", "list", "import", *COMMANDS])
    p.add_argument("--tables", help="folder of Parquet tables")
    p.add_argument("--out", help="folder for results; without it they are shown")
    p.add_argument("--only", nargs="*", help="queries to run, instead of all of the command")
    p.add_argument("--skip", nargs="*", help="queries to leave out")
    p.add_argument("--city", nargs="*", help="cities to keep, where a result has a city")
    p.add_argument("--file", help="import: a CSV file of descriptions")
    a = p.parse_args(argv)
    if a.command == "list":
        print("\n".join(sorted(known())))
        return 0
    if not a.tables:
        p.error("--tables is needed")
    names = plan(a.command, a.only, a.skip) if a.command != "import" else []
    spark = spark or get_spark("lotweave")
    readers.register(spark)
    ship(spark)
    if a.command == "import":
        if not (a.file and a.out):
            p.error("import needs --file and --out")
        old = spark.read.parquet(f"{a.tables}/listings.parquet").select("address", "description").where("description is not null")
        new = readers.read_csv(spark, a.file)
        readers.import_descriptions(old, new, ["address", "description"], {}, "address").write.mode("overwrite").parquet(f"{a.out}/descriptions")
        return 0
    became = run(spark, names, a.tables, a.out, a.city)
    return 1 if any(v.startswith("failed") for v in became.values()) else 0


if __name__ == "__main__":
    raise SystemExit(main())
