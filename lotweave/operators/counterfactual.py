"""Rewrites of texts in several arms: generated, validated against the facts and the fluency of the original, and scored."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotweave.functions.text import SLOTS, slots, slots_kept, slots_match, without_places

#: The arms of an experiment, and what each asks of a generator.
ARMS = {"identity": "Repeat the text.", "style_swap": "Rewrite the text in the style of {target}. Keep every number.", "style_stripped": "Rewrite the text plainly, without any word that tells the place. Keep every number.", "place_removed": "Leave out every name of a place."}


def prompt(arm: Column, text: Column, target: Column) -> Column:
    """What a generator is given, as JSON."""
    task = None
    for name, words in ARMS.items():
        t = F.replace(F.lit(words), F.lit("{target}"), target)
        task = F.when(arm == name, t) if task is None else task.when(arm == name, t)
    return F.to_json(F.struct(task.alias("task"), text.alias("text")))


def echo(arm: Column, text: Column) -> Column:
    """The generator that stands in where none is reachable: the text itself, without place words in the arm that removes them."""
    return F.when(arm == "place_removed", without_places(text)).otherwise(text)


#: Up to so many pairs, letter pairs are counted and looked up in a square table, else by sorting and searching.
MOST_CELLS = 1 << 22


def _lowered(text: Column) -> Column:
    """A text whose letter pairs are counted: lower case, as many letters as it had; null for fewer than two."""
    return F.when(F.length(text) >= 2, F.substring(F.lower(text), F.lit(1), F.length(text)))


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, one after another; lengths)."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"), np.array([len(t) for t in texts], dtype=np.int64)


def _coded(points: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Places in the sorted ``chars``; their number for points that aren't there."""
    table = np.full(int(max(points.max(), chars.max())) + 1, len(chars), dtype=np.int64)
    table[chars] = np.arange(len(chars))
    return table[points]


def letter_model(df: DataFrame, text: str) -> DataFrame:
    """(gram, logp) of letter pairs, with one added to each count: at most some thousand rows for texts of one alphabet."""

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            points, lengths = _letters(list(pdf["t"]))
            chars = np.unique(points) if len(points) < 1000 else np.flatnonzero(np.bincount(points))
            at, k = _coded(points, chars), len(chars)
            inside = np.ones(len(points), dtype=bool)
            inside[np.cumsum(lengths) - 1] = False  # a text's last letter begins no pair
            pairs = (at[:-1] * k + at[1:])[inside[:-1]]
            if k * k <= MOST_CELLS:
                n = np.bincount(pairs, minlength=k * k)
                found = np.flatnonzero(n)
                n = n[found]
            else:
                found, n = np.unique(pairs, return_counts=True)
            yield pd.DataFrame({"gram": [chr(chars[p // k]) + chr(chars[p % k]) for p in found], "n": n})

    counted = df.select(_lowered(F.col(text)).alias("t")).where("t is not null").mapInPandas(counts, "gram string, n long")
    first = Window.partitionBy(F.substring("gram", 1, 1))  # some thousand rows
    n = counted.groupBy("gram").agg(F.sum("n").alias("n"))
    return n.select("gram", F.ln((F.col("n") + 1) / (F.sum("n").over(first) + F.count("*").over(first) + 1)).alias("logp"))


def perplexity(model: DataFrame) -> Callable[[Column], Column]:
    """What gives exp of the mean surprise of a text's letter pairs, unseen ones at the model's lowest; null for fewer than two letters. The model goes to every worker."""
    grams = model.collect()  # as many as an alphabet has pairs
    first, second = (np.array([ord(r["gram"][i]) for r in grams], dtype=np.int64) for i in range(2))
    logp, chars = np.array([r["logp"] for r in grams]), np.unique(np.concatenate([first, second]))
    k = len(chars) + 1  # one more for letters that aren't in the model
    pairs = np.searchsorted(chars, first) * k + np.searchsorted(chars, second)
    order = np.argsort(pairs)
    pairs, logp = pairs[order], logp[order]
    shared = model.sparkSession.sparkContext.broadcast((chars, pairs, logp))

    @F.pandas_udf("double")
    def measured(texts: pd.Series) -> pd.Series:
        chars, pairs, logp = shared.value
        out, known = np.full(len(texts), np.nan), texts.notna().to_numpy()
        if known.any() and len(pairs):
            points, lengths = _letters(list(texts[known]))
            at = _coded(points, chars)
            mine = at[:-1] * k + at[1:]
            if k * k <= MOST_CELLS:
                table = np.full(k * k, logp.min())
                table[pairs] = logp
                value = table[mine]
            else:
                place = np.minimum(np.searchsorted(pairs, mine), len(pairs) - 1)
                value = np.where(pairs[place] == mine, logp[place], logp.min())
            ends = np.cumsum(lengths)
            value = np.append(value, 0.0)
            value[ends - 1] = 0.0  # a text's last letter begins no pair
            out[known] = np.exp(np.minimum(-np.add.reduceat(value, ends - lengths) / (lengths - 1), 50.0))
        return pd.Series(out)

    return lambda text: measured(_lowered(text))


def rewrites(df: DataFrame, key: str, text: str, target: Column, generate: Callable[[Column, Column], Column] = echo, most_ratio: float = 3.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, arm, prompt, rewrite, facts_kept, fluent, passed, and columns to keep) for each text and arm: facts must agree where both have them, and perplexity may grow to most_ratio times.

    Each text is judged by itself, where it is: only the letter model's counts are shuffled. A rewrite that is the text itself has its facts and perplexity.
    """
    base = df.where(F.length(F.trim(text)) > 0).select(key, F.col(text).alias("_t"), target.alias("_target"), *keep)
    surprise = perplexity(letter_model(base, "_t"))
    known = base.withColumns({"_a": slots(F.col("_t")), "_p0": surprise(F.col("_t"))})
    arms = known.withColumn("arm", F.explode(F.array(*[F.lit(a) for a in ARMS])))
    out = arms.withColumns({"prompt": prompt(F.col("arm"), F.col("_t"), F.col("_target")), "rewrite": generate(F.col("arm"), F.col("_t"))})
    out = out.withColumn("_new", F.when(~F.col("rewrite").eqNullSafe(F.col("_t")), F.col("rewrite")))
    out = out.withColumn("_p1", surprise(F.col("_new")))
    same = F.col("rewrite").eqNullSafe(F.col("_t"))
    own = F.forall(F.array(*[slots_match(F.col("_a"), F.col("_a"))[s] for s in SLOTS]), lambda x: x)
    out = out.withColumn("facts_kept", F.when(same, own).otherwise(slots_kept(F.col("_a"), F.col("_new"))))
    fluent = F.coalesce(F.when(same, F.col("_p0")).otherwise(F.col("_p1")) <= most_ratio * F.col("_p0"), F.lit(False))
    return out.withColumn("fluent", fluent).withColumn("passed", F.col("fluent") & F.col("facts_kept")).select(key, "arm", "prompt", "rewrite", "facts_kept", "fluent", "passed", *keep)


def pass_rates(checked: DataFrame) -> DataFrame:
    """(arm, n, facts_kept, fluent, passed): shares of an arm's rewrites that pass each check."""
    return checked.groupBy("arm").agg(F.count("*").alias("n"), *[F.avg(F.col(c).cast("double")).alias(c) for c in ("facts_kept", "fluent", "passed")])


#: The submarket a zip belongs to, the zip that stands for a submarket, and the submarket of all other zips.
SUBMARKETS = {94110: "Mission District", 94103: "SoMa", 94114: "Castro", 94131: "Noe Valley", 94121: "Richmond", 94122: "Sunset", 94123: "Marina", 94115: "Pacific Heights", 94109: "Pacific Heights", 94107: "SoMa", 94105: "SoMa"}
SUBMARKET_ZIPS = {"Mission District": 94110, "SoMa": 94103, "Castro": 94114, "Noe Valley": 94131, "Richmond": 94121, "Sunset": 94122, "Marina": 94123, "Pacific Heights": 94115}
OTHER_SUBMARKET = "Mission District"


def _looked_up(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def submarket(code: Column) -> Column:
    """The submarket of a zip, a default for those without one."""
    return F.coalesce(_looked_up(SUBMARKETS, code.try_cast("int")), F.lit(OTHER_SUBMARKET))


def submarket_zip(name: Column) -> Column:
    """The zip that stands for a submarket; null for an unknown one."""
    return _looked_up(SUBMARKET_ZIPS, name)


def swap_targets(own: Column, k: int = 3) -> Column:
    """The first k submarkets other than one's own."""
    return F.slice(F.filter(F.array(*[F.lit(s) for s in SUBMARKET_ZIPS]), lambda s: ~s.eqNullSafe(own)), 1, k)


def aligned(texts: DataFrame, known: DataFrame, values: list[str], order: Column) -> DataFrame:
    """texts(address, zip, ...) with values of the last row of known (in the order, which must be total) with its address and zip, case and blanks at the ends aside; else the means of all rows, and whether one matched."""
    key = lambda: [F.lower(F.trim("address")).alias("_a"), F.col("zip").try_cast("int").alias("_z")]
    last = known.select(*key(), F.struct(*values).alias("_v"), order.alias("_o")).where("_a is not null and _z is not null").groupBy("_a", "_z").agg(F.max_by("_v", "_o").alias("_v"))
    means = known.agg(*[F.avg(v).alias(f"_m_{v}") for v in values])
    t = texts.select("*", *key())
    out = t.join(last, ["_a", "_z"], "left").crossJoin(F.broadcast(means))  # one row
    return out.select(*[F.col(c) for c in texts.columns], *[F.coalesce(F.col("_v")[v].cast("double"), F.col(f"_m_{v}")).alias(v) for v in values], F.col("_v").isNotNull().alias("matched"))


def text_vector(c: Column, size: int = 64, seed: int = 0) -> Column:
    """An encoder that needs no model: words, hashed with a sign into ``size`` numbers and scaled to length 1; zeros for a text without words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))

    @F.pandas_udf("array<double>")
    def summed(hashes: pd.Series) -> pd.Series:
        n, h = np.array([len(x) for x in hashes], dtype=np.int64), np.concatenate([np.zeros(0, dtype=np.int64), *hashes]).astype(np.int64)
        at = np.repeat(np.arange(len(n)), n) * size + h % size
        v = np.bincount(at, np.where(h % 3 == 0, -1.0, 1.0), len(n) * size).reshape(len(n), size)
        norm = np.sqrt((v * v).sum(axis=1, keepdims=True))  # sums of whole numbers, so exact in any order
        return pd.Series(list(v / np.where(norm > 0, norm, 1.0)))

    return summed(F.transform(words, lambda w: F.xxhash64(w, F.lit(seed))))


def text_direction(df: DataFrame, vector: str, y: str, confounders: list[str], key: str) -> dict:
    """A linear text effect to score rewrites with: the first component of vectors (mean, loadings, scale), the effect of its scaled score on y given the
    confounders, cross-fitted, with its error, and a linear prediction of y from the confounders. All come from sums over the rows; d (d + 3) / 2 numbers go to the driver."""
    import numpy as np

    from lotweave.operators.audit import first_component
    from lotweave.operators.estimate import linear_residuals, moments, partial_linear

    mean, load = first_component(df, vector)
    score = F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(x)) for x in load]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) - float(mean @ load)
    s = df.agg(F.stddev_pop(score).alias("s")).first()["s"] or 1.0
    rows = df.withColumn("_t", score / float(s))
    fit = partial_linear(linear_residuals(rows, key, y, "_t", confounders)).first()
    m = moments(rows, [*confounders, y])[None]
    p = len(confounders) + 1
    scale = np.sqrt(np.maximum(np.diag(m)[:p], 1e-300))
    beta = np.linalg.solve(m[:p, :p] / np.outer(scale, scale) + 1e-8 * np.eye(p), m[:p, p] / scale) / scale
    return {"mean": mean, "load": load, "scale": float(s), "theta": fit["theta"] or 0.0, "se": fit["se"], "beta": beta}


def text_part(vector: Column, fit: dict) -> Column:
    """What a text's vector adds to the predicted outcome."""
    dot = F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(x)) for x in fit["load"]]), lambda u, v: u * v), F.lit(0.0), lambda s, x: s + x)
    return (dot - float(fit["mean"] @ fit["load"])) / fit["scale"] * float(fit["theta"])


def confounded_part(confounders: list[str], fit: dict) -> Column:
    """The outcome predicted from the confounders."""
    base = F.lit(float(fit["beta"][0]))
    for b, c in zip(fit["beta"][1:], confounders):
        base = base + float(b) * F.col(c).cast("double")
    return base


def scored(df: DataFrame, vector: str, confounders: list[str], fit: dict) -> DataFrame:
    """df with ``baseline``, the outcome predicted from the confounders, and ``predicted``, with the effect of the text's vector added; nothing is collected."""
    return df.withColumn("baseline", confounded_part(confounders, fit)).withColumn("predicted", F.col("baseline") + text_part(F.col(vector), fit))


def arm_effects(changes: DataFrame, arm: str, key: str, change: str, resamples: int = 2000) -> DataFrame:
    """(arm, n, mean_change, low, high, percent): each arm's mean change with an interval over resamples, and what it implies in percent.

    Resamples weigh rows by Poisson(1) numbers from a hash of key and resample, the same in any engine, drawn once for all arms of a key and summed over blocks of keys before the shuffle.
    """
    from lotweave.operators.draws import poisson_weights

    rows = changes.where(F.col(change).isNotNull())
    tasks = 4 * changes.sparkSession.sparkContext.defaultParallelism
    # by number, or adaptive execution would put these rows, small as they are, in one task
    narrow = rows.where(F.col(arm).isNotNull()).select(F.col(arm).alias("arm"), F.col(key).cast("string").alias("key"), F.col(change).cast("double").alias("change")).repartition(tasks, "key")

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("arm", kind="stable")
        at, keys = pd.factorize(pdf["key"], use_na_sentinel=False)
        new = (pdf["arm"] != pdf["arm"].shift()).to_numpy()
        starts, change = np.flatnonzero(new), pdf["change"].to_numpy(float)
        s, w = np.empty((resamples, len(starts)), dtype=np.longdouble), np.empty((resamples, len(starts)))
        for b, drawn in enumerate(poisson_weights([None if pd.isna(k) else k for k in keys], resamples)):
            k = drawn[at]
            s[b], w[b] = np.add.reduceat((change * k).astype(np.longdouble), starts), np.add.reduceat(k, starts)
        return pd.DataFrame({"arm": np.tile(pdf["arm"].to_numpy()[starts], resamples), "b": np.repeat(np.arange(1, resamples + 1), len(starts)), "s": s.ravel().astype(float), "rest": (s - s.astype(float)).ravel().astype(float), "w": w.ravel()})

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in batches:
            held, n = [*held, pdf], n + len(pdf)
            if n >= 30_000:
                yield summed(pd.concat(held))
                held, n = [], 0
        if n:
            yield summed(pd.concat(held))

    @F.pandas_udf("double")
    def total(parts: pd.Series) -> pd.Series:
        """Exact, so blocks and their order change nothing."""
        return parts.map(math.fsum)

    drawn = narrow.mapInPandas(blocks, f"arm {changes.schema[arm].dataType.simpleString()}, b int, s double, rest double, w double")
    sums = drawn.groupBy(F.col("arm").alias(arm), "b").agg(F.flatten(F.collect_list(F.array("s", "rest"))).alias("s"), F.sum("w").alias("w"))  # two numbers a block
    means = sums.select(arm, "b", F.try_divide(total("s"), "w").alias("m"))
    ends = means.groupBy(arm).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    out = rows.groupBy(arm).agg(F.count("*").alias("n"), F.avg(change).alias("mean_change")).join(ends, arm)
    return out.select(arm, "n", "mean_change", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), ((F.exp("mean_change") - 1) * 100).alias("percent"))


def label_classifier(df: DataFrame, text: str, label: str, size: int = 4096, least: int = 2, strength: float = 1.0):
    """A pipeline model that tells a text's label: words and pairs, hashed, weighted by rarity (terms in fewer than ``least`` texts count nothing), scaled to length 1, and a multinomial logistic regression. Fitted over tasks; df has a row a text."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, IndexToString, Normalizer, SQLTransformer, StringIndexer

    rows = df.where(F.col(text).isNotNull() & F.col(label).isNotNull())
    n = rows.count()
    names = StringIndexer(inputCol=label, outputCol="_label", handleInvalid="skip").fit(rows)
    pairs = SQLTransformer(statement="select *, concat(_words, if(size(_words) > 1, transform(sequence(1, size(_words) - 1), i -> concat(_words[i - 1], ' ', _words[i])), cast(array() as array<string>))) as _terms from __THIS__")
    words = SQLTransformer(statement=f"select *, regexp_extract_all(lower(coalesce(`{text}`, '')), r'([\\p{{L}}\\p{{N}}_]{{2,}})', 1) as _words from __THIS__")
    stages = [words, pairs, HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=size), IDF(inputCol="_tf", outputCol="_idf", minDocFreq=least), Normalizer(inputCol="_idf", outputCol="_v")]
    stages += [names, LogisticRegression(featuresCol="_v", labelCol="_label", regParam=1 / (strength * max(n, 1)), maxIter=50, standardization=False, predictionCol="_p", rawPredictionCol="_raw", probabilityCol="_prob"), IndexToString(inputCol="_p", outputCol="told", labels=names.labels)]
    return Pipeline(stages=stages).fit(rows)
