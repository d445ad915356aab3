"""Mixing sources to target shares of the total size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotweave.llm.tokens import count_table
from lotweave.session import Scratch

#: Each source's documents fall into this many blocks by a hash; a power of two.
BLOCKS = 1024


def sized(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, source, n_tokens, block), written; documents without a source are left out, null texts have 0 tokens."""
    need = documents.where("source is not null").select("doc_id", "source", "text")
    counted = count_table(need)
    return scratch.cut(counted.withColumn("_h", F.xxhash64("doc_id", F.lit(17))).withColumn("block", F.pmod("_h", F.lit(BLOCKS)).cast("int")))


def mixture(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, own_tokens, total_tokens, quota_tokens, capped), one row per source of targets.

    The total size is the tokens of all documents with a source. A source's quota is its share of that, at most
    ``max_repeats`` times its own tokens; ``capped`` says that its target can't be reached.
    A source without documents has 0 tokens. A null max_repeats allows none, a null share wants none.
    """
    own = docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("own_tokens"))
    total = own.agg(F.coalesce(F.sum("own_tokens"), F.lit(0)).alias("total_tokens"))
    out = targets.where("source is not null").select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
    out = out.join(own, "source", "left").crossJoin(F.broadcast(total))  # total is one row
    out = out.fillna(0, ["n_docs", "own_tokens"])
    most, want = F.col("max_repeats") * F.col("own_tokens"), F.col("target_share") * F.col("total_tokens")
    return out.withColumns({"quota_tokens": F.least(most.cast("double"), want), "capped": most < want})


def _split(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source for each shard: a tree that halves the shards and draws the left half's blocks at random."""
    if shards == 1:
        return counts[None, :]
    left = shards // 2
    n = int(counts.sum())
    take = n * left // shards
    # marginals, as numpy's sampler of a source at a time: each is hypergeometric given those before
    drawn, rest, need = np.zeros_like(counts), n, take
    for i, c in enumerate(counts):
        rest -= int(c)
        drawn[i] = rng.hypergeometric(int(c), rest, need) if need and c else 0
        need -= int(drawn[i])
    return np.vstack([_split(drawn, left, rng), _split(counts - drawn, shards - left, rng)])


def mix(documents: DataFrame, targets: DataFrame, scratch: Scratch, shards: int = 8, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(mixed, report). mixed: (shard, doc_id, source, copy, n_tokens), rows of a shard together and in shuffled order.

    A source gives whole copies of itself while its quota lasts, then the blocks of one more copy up to the quota, and of
    the last block the documents that still fit; copies never exceed max_repeats. So each source misses its quota by less than
    a document of the last block. Blocks are dealt to shards by a multivariate-hypergeometric tree over exact counts of
    blocks (sources x shards numbers, on the driver); each shard draws disjoint blocks in an order permuted by a hash, and shuffles
    its documents locally. report: mixture() with ``mixed_tokens``, ``real_share`` and ``repeats``.
    A repeated doc_id is a document each time. Empty documents or targets give an empty mixture.
    """
    docs = sized(documents, scratch)
    plan = scratch.cut(mixture(docs, targets))
    # tokens before each block of a source, in the order of blocks: at most BLOCKS numbers a source
    blocks = docs.groupBy("source", "block").agg(F.sum("n_tokens").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("before", before).join(plan.select("source", "quota_tokens", "own_tokens"), "source")
    blocks = blocks.where("own_tokens > 0").withColumns({"whole": F.floor(F.col("quota_tokens") / F.col("own_tokens")).cast("int")})
    blocks = blocks.withColumn("rest", F.col("quota_tokens") - F.col("whole") * F.col("own_tokens"))
    last = F.col("before") < F.col("rest")
    copies = F.sequence(F.lit(1), F.col("whole") + last.cast("int"))
    units = blocks.where(F.col("whole") + last.cast("int") > 0).withColumn("copy", F.explode(copies))
    units = scratch.cut(
        units.select("source", "block", "copy", F.when(F.col("copy") > F.col("whole"), F.col("rest") - F.col("before")).alias("room"))
        .withColumn("_o", F.xxhash64("source", "block", "copy", F.lit(seed)))
        .withColumn("nth", F.row_number().over(Window.partitionBy("source").orderBy("_o")) - 1)
    )
    found = units.groupBy("source").agg(F.count("*").alias("n")).orderBy("source").collect()  # a row a source
    rows = []
    if found:
        table = _split(np.array([r["n"] for r in found], dtype=np.int64), shards, np.random.default_rng(seed))
        ends = table.cumsum(axis=0)
        rows = [(r["source"], k, int(ends[k, i] - table[k, i]), int(ends[k, i])) for i, r in enumerate(found) for k in range(shards) if table[k, i]]
    deal = documents.sparkSession.createDataFrame(rows, "source string, shard int, lo long, hi long")
    dealt = units.join(deal, (units["source"] == deal["source"]) & (units["nth"] >= deal["lo"]) & (units["nth"] < deal["hi"])).select(units["source"], "block", "copy", "room", "shard")
    # the last block's documents are ranked among themselves only: one 1024th of a source
    cut = dealt.where("room is not null").select("source", "block", "copy", "room", "shard")
    partial = docs.join(cut, ["source", "block"])
    upto = F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    partial = partial.withColumn("upto", upto).where("upto <= room")
    full = docs.join(dealt.where("room is null"), ["source", "block"])
    cols = ["shard", "doc_id", "source", "copy", "n_tokens"]
    mixed = scratch.cut(full.select(*cols).unionAll(partial.select(*cols)))
    real = mixed.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"))
    all_mixed = mixed.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all_mixed"))
    report = plan.join(real, "source", "left").fillna(0, ["mixed_tokens"]).crossJoin(F.broadcast(all_mixed))  # one row
    report = report.withColumns({"real_share": F.try_divide("mixed_tokens", "all_mixed"), "repeats": F.try_divide("mixed_tokens", "own_tokens")}).drop("all_mixed")
    # by range, so that a shard is as many tasks and files as its size asks for
    shuffled = mixed.withColumn("_o", F.xxhash64("doc_id", "copy", F.lit(seed))).repartitionByRange("shard", "_o").sortWithinPartitions("shard", "_o").drop("_o")
    return shuffled, report
