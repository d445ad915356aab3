"""Near-duplicate records by BagMinHash signatures, bands and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lotweave.llm.words import find_words
from lotweave.operators.components import connected_components
from lotweave.session import Scratch

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def bag_signatures(owner: np.ndarray, element: np.ndarray, count: np.ndarray, owners: int, size: int) -> np.ndarray:
    """(owners x size) BagMinHash signatures of multisets: element (64-bit hash) with its count, and the multiset it is in.

    Weights are discretised at 0, 1, 2, 4, 8, ...; each interval of an element has its own Poisson process, as
    fast as the interval is wide, seeded by element and interval. A point has a time, a component of the signature and a level in its interval;
    it counts if the level is within the element's weight, so an interval that the weight covers only in part is split
    point by point, alike in all multisets. A component keeps its earliest time. Two multisets' components are equal with
    the probability of their weighted Jaccard similarity. Processes that are past the latest component of their multiset are given up,
    all others advance together, a few points at a time.
    """
    sig = np.full(owners * size, np.inf)
    top = int(count.max()).bit_length() if len(count) else 0
    own, seed, low, width, weight = [], [], [], [], []
    for k in range(top + 1):
        lo, hi = (0, 1) if k == 0 else (1 << (k - 1), 1 << k)
        hit = count > lo
        if hit.any():
            own.append(owner[hit])
            seed.append(mix64(element[hit] + np.uint64((int(_GOLD) * (k + 1)) & (2**64 - 1))))
            low.append(np.full(hit.sum(), float(lo)))
            width.append(np.full(hit.sum(), float(hi - lo)))
            weight.append(count[hit].astype(float))
    if not own:
        return sig.reshape(owners, size)
    own, seed, low, width, weight = map(np.concatenate, (own, seed, low, width, weight))
    time, done, step = np.zeros(len(own)), 0, 8
    while len(own):
        i = np.arange(done, done + step, dtype=np.uint64)
        h = mix64(seed[:, None] + _GOLD * (i[None, :] + np.uint64(1)))
        wait = -np.log(((h >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32) / width[:, None]
        at = time[:, None] + np.cumsum(wait, axis=1)
        part = ((h & np.uint64(0xFFFFFFFF)) % np.uint64(size)).astype(np.int64)
        slot = own[:, None] * size + part
        split = weight < low + width
        if split.any():
            level = low[:, None] + width[:, None] * ((mix64(h) >> np.uint64(11)).astype(np.float64) * 2.0**-53)
            keep = level < weight[:, None]
            np.minimum.at(sig, slot[keep], at[keep])
        else:
            np.minimum.at(sig, slot.ravel(), at.ravel())
        latest = sig.reshape(owners, size).max(axis=1)
        time, done = at[:, -1], done + step
        on = time < latest[own]
        own, seed, low, width, weight, time = own[on], seed[on], low[on], width[on], weight[on], time[on]
        step = min(step * 2, 256)
    return sig.reshape(owners, size)


def band_hashes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(multisets x bands): one 64-bit hash of each band's rows and number."""
    bits = np.ascontiguousarray(signatures).view(np.uint64).reshape(len(signatures), bands, rows)
    out = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD), bits.shape[:2]).copy()
    for r in range(rows):
        out = mix64(out ^ bits[:, :, r]) + _GOLD
    return out.view(np.int64)


def shingles(text: str, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Signed 64-bit hashes of a text's distinct runs of ``length`` words (lower case), in order, and how often each occurs."""
    words = [w.lower() for w in find_words(text)]
    if len(words) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    import xxhash

    ids = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
    n = len(words) - length + 1
    h = np.zeros(n, dtype=np.uint64)
    for k in range(length):
        h = mix64(h + _GOLD) ^ ids[k : k + n]
        h = mix64(h)
    return np.unique(h.view(np.int64), return_counts=True)


#: Texts signed together, and runs of words in them, at most (a text with more runs is signed alone).
TOGETHER, MOST_RUNS = 256, 100_000


def _bags(ids: list, texts: list, length: int, counted: bool) -> Iterator[list[tuple]]:
    """Lists of (id, hashes, counts) of the texts that have any."""
    out, size = [], 0
    for i, t in zip(ids, texts):
        e, c = shingles(t or "", length)
        if len(e):
            if out and (len(out) == TOGETHER or size + len(e) > MOST_RUNS):
                yield out
                out, size = [], 0
            out.append((i, e, c if counted else np.ones_like(c)))
            size += len(e)
    if out:
        yield out


def sign(df: DataFrame, id_col: str, text_col: str, length: int, bands: int, rows: int, counted: bool) -> DataFrame:
    """(id, same, shingles, counts, bands): ``same`` is a hash of all shingles and counts, equal for equal bags.

    Texts without a run of ``length`` words are left out.
    """
    schema = "id bigint, same string, shingles array<bigint>, counts array<int>, bands array<bigint>"
    size = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            for bags in _bags(b.column(0).to_pylist(), b.column(1).to_pylist(), length, counted):
                lens = np.array([len(e) for _, e, _ in bags])
                element, count = np.concatenate([e for _, e, _ in bags]), np.concatenate([c for _, _, c in bags])
                sig = bag_signatures(np.repeat(np.arange(len(bags)), lens), element.view(np.uint64), count, len(bags), size)
                keys = band_hashes(sig, bands, rows)
                ends = pa.array(np.concatenate(([0], np.cumsum(lens))), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i, _, _ in bags], pa.int64()),
                        pa.array([xxhash.xxh3_128_hexdigest(e.tobytes() + c.tobytes()) for _, e, c in bags]),
                        pa.ListArray.from_arrays(ends, pa.array(element)),
                        pa.ListArray.from_arrays(ends, pa.array(count.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(bags) + 1) * bands, pa.int32()), pa.array(keys.ravel())),
                    ],
                    names=["id", "same", "shingles", "counts", "bands"],
                )

    return df.select(F.col(id_col).cast("bigint"), F.col(text_col)).where(F.col(text_col).isNotNull()).mapInArrow(run, schema)


@F.pandas_udf(DoubleType())
def _overlap(a: pd.Series, m: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
    """Weighted Jaccard similarity of two bags, each as sorted hashes and counts."""
    out = []
    for x, p, y, q in zip(a, m, b, n):
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        hit = y[at] == x
        both = np.minimum(p[hit], q[at[hit]]).sum()
        out.append(both / (p.sum() + q.sum() - both))
    return pd.Series(out, dtype="float64")


class NearDuplicates:
    """Classes of equal bags of word runs, and all links between different ones.

    classes: (id, rep) for every text that has a run of words; rep is the smallest id with the same bag.
    links: (rep_a, rep_b, similarity), rep_a < rep_b, of the representatives whose bags' weighted Jaccard similarity (of the
    plain sets, unless ``counted``) is ``least`` or more. Copies are collapsed first and never paired with
    each other. Signatures are cut into bands; representatives that share a band are candidates, however many,
    unless their sizes rule the similarity out, and every candidate pair is verified exactly. With the default 80 bands of 5 rows, a pair at 0.65 is missed with a probability of 5e-5,
    one at 0.8 with 2e-14.
    """

    def __init__(self, df: DataFrame, scratch: Scratch, id_col: str, text_col: str, length: int = 5, least: float = 0.8, bands: int = 80, rows: int = 5, counted: bool = False):
        signed = scratch.cut(sign(df, id_col, text_col, length, bands, rows, counted))
        first = signed.groupBy("same").agg(F.min("id").alias("rep"))
        self.classes = scratch.cut(signed.select("id", "same").join(first, "same").select("id", "rep").distinct())
        reps = signed.join(first.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"])
        # plain sets need no counts, which would be carried along with every pair
        weight = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c) if counted else F.size("shingles").cast("bigint")
        reps = scratch.cut(reps.select("id", "shingles", weight.alias("n"), *(["counts"] if counted else []), "bands"))
        keys = reps.select("id", "n", F.explode("bands").alias("band"))
        # bands of one representative only are dropped before the join; the counts need no shuffle of their own beyond the join's
        shared = keys.groupBy("band").agg(F.count("*").alias("k")).where("k > 1").select("band")
        live = scratch.cut(keys.join(shared, "band", "left_semi"))
        a, b = live.select("band", F.col("id").alias("rep_a"), F.col("n").alias("n_a")), live.select("band", F.col("id").alias("rep_b"), F.col("n").alias("n_b"))
        # two bags can't share more than the smaller has
        fits = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * least
        pairs = a.join(b, "band").where((F.col("rep_a") < F.col("rep_b")) & fits).select("rep_a", "rep_b").distinct()
        left = reps.select(F.col("id").alias("rep_a"), F.col("shingles").alias("x"), *([F.col("counts").alias("p")] if counted else []))
        right = reps.select(F.col("id").alias("rep_b"), F.col("shingles").alias("y"), *([F.col("counts").alias("q")] if counted else []))
        both = F.size(F.array_intersect("x", "y"))
        similarity = _overlap("x", "p", "y", "q") if counted else both / (F.size("x") + F.size("y") - both)
        seen = pairs.join(left, "rep_a").join(right, "rep_b").select("rep_a", "rep_b", similarity.alias("similarity"))
        self.links = scratch.cut(seen.where(F.col("similarity") >= least))
        self.scratch = scratch

    def groups(self) -> DataFrame:
        """(id, rep, group, links): each text's class, the smallest id of its group of linked classes, and its links to other classes."""
        roots = connected_components(self.links.select(F.col("rep_a").alias("u"), F.col("rep_b").alias("v")), self.scratch)
        ends = self.links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
        out = self.classes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").join(ends, "rep", "left")
        return out.select("id", "rep", F.coalesce("root", "rep").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))

    def pairs(self) -> DataFrame:
        """(id_a, id_b), id_a < id_b, of all texts that are alike, copies among each other too: as many rows as that has."""
        a, b = self.classes.select("rep", F.col("id").alias("i")), self.classes.select("rep", F.col("id").alias("j"))
        copies = a.join(b, "rep").where("i < j").select(F.col("i").alias("id_a"), F.col("j").alias("id_b"))
        across = self.links.join(a.withColumnRenamed("rep", "rep_a"), "rep_a").join(b.withColumnRenamed("rep", "rep_b"), "rep_b")
        return copies.unionAll(across.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")))
