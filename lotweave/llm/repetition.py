"""Repetition inside one document: token statistics by public vocabularies first, then the exact share of repeated runs of words."""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotweave.llm.tokens import MEMO, MEMO_LETTERS, encoder, vocabulary_file
from lotweave.llm.words import distinct_runs, find_words, number_words, word_ids

RUN = 5
_pieces: dict[int, object] = {}


def _piece_model(model: bytes):
    if hash(model) not in _pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=model)
        _pieces[hash(model)] = m, np.fromiter((m.is_byte(i) for i in range(m.get_piece_size())), dtype=bool)
    return _pieces[hash(model)]


def script_of(text: str) -> str:
    """The script most letters of a text are in, by the first word of their Unicode names; ``none`` without letters."""
    counts: dict[str, int] = {}
    letters, n = np.unique(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), return_counts=True)
    for c, k in zip(letters.tolist(), n.tolist()):
        if chr(c).isalpha():
            name = unicodedata.name(chr(c), "UNKNOWN").split(" ", 1)[0]
            counts[name] = counts.get(name, 0) + k
    return min(counts, key=lambda s: (-counts[s], s)).lower() if counts else "none"


class TokenBand:
    """Rejects texts that can't be repetitive, by the entropy of their tokens.

    A text's words (lower case, a blank before each) are encoded word by word, so a word has the same tokens wherever it stands. If
    a share of ``least`` or more of its runs of words are repeats, each of these, n of them, starts a pair of neighbouring tokens that has occurred before;
    so of all P pairs at most P - n differ, and their entropy is at most log2(P - n) bits. A text above this band is not
    repetitive, whatever its language or script: the band follows from the definition, not from any data. The others are measured exactly.
    """

    def __init__(self, ranks: bytes, run: int, least: float):
        self.encode, self.run, self.least = encoder(ranks).encode, run, least
        self.memo: dict[str, list[int]] = {}

    def pair_entropy(self, words: list[str]) -> tuple[int, float]:
        """(pairs, entropy in bits) of neighbouring tokens of the words."""
        out, memo = array("i"), self.memo
        for w in words:
            ids = memo.get(w)
            if ids is None:
                ids = self.encode(" " + w)
                if len(memo) < MEMO and len(w) <= MEMO_LETTERS:
                    memo[w] = ids
            out.extend(ids)
        ids = np.frombuffer(out, dtype=np.int32).astype(np.int64)
        pairs = np.sort(ids[:-1] << 32 | ids[1:])
        if not len(pairs):
            return 0, 0.0
        n = np.diff(np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1], [True]))))
        return len(pairs), float(np.log2(len(pairs)) - (n * np.log2(n)).sum() / len(pairs))

    def inside(self, words: list[str]) -> tuple[bool, float]:
        """Whether the words may be repetitive, and the entropy."""
        runs = len(words) - self.run + 1
        if runs < 1:
            return False, 0.0
        pairs, entropy = self.pair_entropy(words)
        left = pairs - np.ceil(self.least * runs - 1e-9)
        return bool(left < 1 or entropy <= np.log2(left) + 1e-9), entropy


def repeated_shares(df: DataFrame, text_col: str = "text", run: int = RUN, least: float = 0.3, ranks: bytes | None = None) -> DataFrame:
    """df's columns but for the text, ``pair_entropy``, ``in_band`` and ``repeated_share``, in one pass without a shuffle.

    ``in_band``: the token band doesn't rule out a share of ``least`` or more; only then the share is measured, else it is null. So
    ``repeated_share >= least`` holds for exactly the texts it holds for by definition. Texts of fewer than ``run`` words, and null ones, are
    out of the band, with an entropy of 0.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks or vocabulary_file())  # a vocabulary, about 1 MB
    keep = [c for c in df.columns if c != text_col]
    names = ["pair_entropy", "in_band", "repeated_share"]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + ["pair_entropy double", "in_band boolean", "repeated_share double"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = TokenBand(shared.value, run, least)
        for batch in batches:
            entropy, inside, share = [], [], []
            for text in batch.column(text_col).to_pylist():
                words = [w.lower() for w in find_words(text or "")]
                hit, h = band.inside(words)
                entropy.append(h)
                inside.append(hit)
                share.append(None)
                if hit:
                    n, distinct = distinct_runs(*number_words(words), run)
                    share[-1] = 1 - distinct / n
            cols = [pa.array(entropy, pa.float64()), pa.array(inside, pa.bool_()), pa.array(share, pa.float64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *cols], names=[*keep, *names])

    return df.select(*keep, text_col).mapInArrow(work, schema)


def measure(df: DataFrame, text_col: str = "text", run: int = RUN, ranks: bytes | None = None, pieces: bytes | None = None) -> DataFrame:
    """df's columns but for the text, and what is measured of each text, in one pass without a shuffle.

    ``n_runs`` and ``repeated_share``: runs of ``run`` successive words, and 1 minus the part of distinct ones among them;
    0 for fewer words and for null texts. ``chars_per_token`` and ``token_entropy`` (bits, of the text's own
    distribution of tokens) by byte_bpe_50k, ``byte_share``: the part of piece_bpe_32k's pieces that are single bytes it has no piece for;
    all null for empty and null texts. ``script``: that of most letters.
    """
    spark = df.sparkSession.sparkContext
    shared = spark.broadcast((ranks or vocabulary_file(), pieces or vocabulary_file("piece_bpe_32k.model")))  # two vocabularies, about 1.5 MB
    keep = [c for c in df.columns if c != text_col]
    names = ["n_runs", "repeated_share", "chars_per_token", "token_entropy", "byte_share", "script"]
    kinds = ["bigint", "double", "double", "double", "double", "string"]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"`{n}` {k}" for n, k in zip(names, kinds)])

    def one(text: str, tokens, model, is_byte) -> tuple:
        ids, n_kinds = word_ids(text)
        n, distinct = distinct_runs(ids, n_kinds, run)
        out = array("i")
        tokens.encode_into(text, out)
        if not out:
            return 0, 0.0, None, None, None, "none"
        used = np.bincount(np.frombuffer(out, dtype=np.int32))
        p = used[used > 0] / len(out)
        sp = np.asarray(model.encode(text, num_threads=1), dtype=np.int32)
        share = float(is_byte[sp].mean()) if len(sp) else 0.0
        return n, 1 - distinct / n if n else 0.0, len(text) / len(out), float(-(p * np.log2(p)).sum()), share, script_of(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, (model, is_byte) = encoder(shared.value[0]), _piece_model(shared.value[1])
        for batch in batches:
            rows = [one(t or "", tokens, model, is_byte) for t in batch.column(text_col).to_pylist()]
            types = [pa.int64(), *[pa.float64()] * 4, pa.string()]
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *cols], names=[*keep, *names])

    return df.select(*keep, text_col).mapInArrow(work, schema)


MEASURES = ("chars_per_token", "token_entropy", "byte_share")


def fertility_bands(measured: DataFrame, group: str = "band_group", low: float = 0.005, high: float = 0.995) -> DataFrame:
    """(group, <measure>_low, <measure>_high): each group's band of each measure, between two quantiles over all its documents."""
    return measured.groupBy(group).agg(*[F.percentile_approx(m, [low, high], 10_000).alias(m) for m in MEASURES]).select(group, *[F.col(m)[i].alias(f"{m}_{side}") for m in MEASURES for i, side in enumerate(("low", "high"))])


def report(df: DataFrame, scratch, threshold: float = 0.3) -> DataFrame:
    """Every document (doc_id, lang, text) with its measures, ``band_group``, ``repetitive`` and ``outside``.

    A band group is the language (the label's part before a hyphen, in lower case), or the script where there is no label.
    ``repetitive``: a repeated share of the threshold or more. ``outside``: the measures outside their group's bands.
    """
    measured = measure(df.select("doc_id", "lang", "text"))
    label = F.lower(F.trim(F.regexp_extract("lang", r"^\s*([A-Za-z]+)", 1)))
    measured = scratch.cut(measured.withColumn("band_group", F.when(label != "", label).otherwise(F.concat(F.lit("script:"), "script"))))
    out = measured.join(fertility_bands(measured), "band_group")
    outside = F.array_compact(F.array(*[F.when((F.col(m) < F.col(f"{m}_low")) | (F.col(m) > F.col(f"{m}_high")), F.lit(m)) for m in MEASURES]))
    return out.select(*measured.columns, (F.col("repeated_share") >= threshold).alias("repetitive"), outside.alias("outside"))
