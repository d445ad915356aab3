"""Which words tell a label, and how much a text's words stand out from its neighbours'."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotweave.functions.text import vocabulary


def words_of(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    return df.where(F.col(text).isNotNull()).select(*keep, F.explode(vocabulary(F.col(text))).alias("word"))


def information_gain(df: DataFrame, text: str, label: str, least: int = 5, top: int = 100) -> DataFrame:
    """(word, df, gain) of the words that tell most about a label (nats), ties by word: entropy of the label less that given the word's presence.

    One pass explodes words and counts them by label before the shuffle; all else is on the counts.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    by_label = rows.groupBy(F.col(label).alias("l")).agg(F.count("*").alias("nl"))
    n = by_label.agg(F.sum("nl").alias("n"), (F.ln(F.sum("nl")) - F.sum(F.col("nl") * F.ln("nl")) / F.sum("nl")).alias("h"))
    hit = words_of(rows.withColumn("l", F.col(label)), text, ["l"]).groupBy("word", "l").agg(F.count("*").alias("k"))
    df_of = hit.groupBy("word").agg(F.sum("k").alias("df")).where(F.col("df") >= least)
    cells = hit.join(df_of, "word").join(by_label, "l")

    def part(x: Column) -> Column:
        return F.when(x > 0, x * F.ln(x)).otherwise(0.0)

    # labels without the word count whole among the rows without it: all of them, less those with the word
    every = by_label.agg(F.sum(F.col("nl") * F.ln("nl")).alias("every"))
    s = cells.groupBy("word", "df").agg(F.sum(part(F.col("k"))).alias("with_"), F.sum(part(F.col("nl") - F.col("k")) - part(F.col("nl"))).alias("less"))
    s = s.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(every))  # one row each
    d, m = F.col("df"), F.col("n") - F.col("df")
    given = (d * F.ln(d) - F.col("with_") + part(m) - (F.col("every") + F.col("less"))) / F.col("n")
    return s.select("word", "df", (F.col("h") - given).alias("gain")).orderBy(F.round("gain", 9).desc(), "word").limit(top)


def tf_idf(df: DataFrame, key: str, text: str, stop: list[str], least: int = 2, most_terms: int = 5000) -> DataFrame:
    """(key, term, w): words and pairs of words of each text, weighted by ln((1 + n) / (1 + df)) + 1 and scaled to length 1.

    Of terms in at least ``least`` texts, the ``most_terms`` most frequent count, ties by term: that is the measure's vocabulary.
    """
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1)), lambda w: ~w.isin(*stop))
    rows = df.where(F.col(text).isNotNull()).select(key, words.alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))).otherwise(F.array().cast("array<string>"))
    tf = rows.select(key, F.explode(F.concat("w", pairs)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    n = rows.agg(F.count("*").alias("n"))
    kept = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where(F.col("df") >= least).orderBy(F.desc("cf"), "term").limit(most_terms)
    w = tf.join(kept, "term").crossJoin(F.broadcast(n)).select(key, "term", (F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))  # one row
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("_l"))
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("_l")).alias("w"))


def uniqueness(weights: DataFrame, neighbours: DataFrame, key: str, other: str) -> DataFrame:
    """(key, uniqueness): 1 less the cosine of a text's weights and the mean of its neighbours'."""
    theirs = neighbours.select(key, other).join(weights.select(F.col(key).alias(other), "term", "w"), other)
    mean = theirs.groupBy(key, "term").agg(F.sum("w").alias("m"))
    length = mean.groupBy(key).agg(F.sqrt(F.sum(F.col("m") ** 2)).alias("_l"))
    dot = weights.join(mean, [key, "term"]).groupBy(key).agg(F.sum(F.col("w") * F.col("m")).alias("d"))
    return length.join(dot, key, "left").select(key, (1 - F.coalesce("d", F.lit(0.0)) / F.col("_l")).alias("uniqueness"))
