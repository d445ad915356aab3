"""Exact byte-pair encoding by backtracking, and counting and decoding of tokens.

The test of which tokens may stand side by side is the published one of backtracking encoders for byte pairs (as in rust-gems' bpe crate).
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: How byte_bpe_50k cuts a text into pieces before merging; a fixed value of the public vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces kept with their ids in a worker, and their letters at most; others are encoded anew each time.
MEMO, MEMO_LETTERS = 200_000, 64


def vocabulary_file(name: str = "byte_bpe_50k.tiktoken") -> bytes:
    """The bytes of a public vocabulary installed beside Python, read on the driver and sent to the workers."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


class BacktrackingEncoder:
    """Encodes pieces in time linear in their length.

    The longest token at each place is found with an Aho-Corasick automaton, which sees no more of the piece than the longest
    token there is; it stands if it may follow the token before it, else a shorter one is tried, else the token before is taken back. Two tokens may stand side by side
    if no merge of higher priority would join the end of one to the start of the other, which the table of pairs
    decides while both are split down to bytes. A place from which no way led on is never tried again.
    """

    def __init__(self, ranks: bytes, pieces: str = PIECES):
        import ahocorasick
        import regex

        pairs = [line.split() for line in ranks.splitlines() if line]
        self.tokens = [b""] * len(pairs)
        for text, rank in pairs:
            self.tokens[int(rank)] = base64.b64decode(text)
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        self.find = regex.compile(pieces).findall
        self.machine = ahocorasick.Automaton()
        for i, t in enumerate(self.tokens):
            self.machine.add_word(t.decode("latin-1"), i)
        self.machine.make_automaton()
        self.longest = max(map(len, self.tokens))
        self.memo: dict[str, array] = {}
        # offsets into all tokens' bytes, for decoding
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in self.tokens])))
        self.bytes = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.shorter = [self._shorter(t) for t in self.tokens]
        self.joined: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = []
        for i, t in enumerate(self.tokens):
            self.halves.append(self._halves(i, t))

    def _shorter(self, token: bytes) -> int:
        for n in range(len(token) - 1, 0, -1):
            if (i := self.ids.get(token[:n])) is not None:
                return i
        return -1

    def _halves(self, i: int, token: bytes) -> tuple[int, int]:
        """The two tokens whose merge made this one; a byte is its own halves."""
        left = self.shorter[i]
        while left >= 0:
            right = self.ids.get(token[len(self.tokens[left]) :])
            if right is not None and left < i and right < i and self.side_by_side(left, right):
                self.joined[left, right] = i
                return left, right
            left = self.shorter[left]
        return i, i

    def side_by_side(self, a: int, b: int) -> bool:
        """Whether a, then b can stand next to each other in an encoding."""
        limit, joined, halves = 1 << 62, self.joined, self.halves
        while True:
            made = joined.get((a, b))
            if made is not None and made < limit:
                return False
            if a > b:  # a was made later, so it is undone first: only its right half touches b
                limit, a = a, halves[a][1]
                if a == limit:
                    limit, b = b + 1, halves[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, halves[b][0]
                if b + 1 == limit:
                    limit, a = a, halves[a][1]
                    if a == limit:
                        return True

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        text, end = piece.decode("latin-1"), len(piece)
        longest, tokens, shorter, fits, reach = self.machine.iter_long, self.tokens, self.shorter, self.side_by_side, self.longest
        open_at, out, at = bytearray(b"\x01") * (end + 1), [], 0
        token = next(longest(text[:reach]))[1]
        while True:
            to = at + len(tokens[token])
            if open_at[to] and (not out or fits(out[-1], token)):
                out.append(token)
                at = to
                if at == end:
                    return out
                token = next(longest(text[at : at + reach]))[1]
            elif (less := shorter[token]) >= 0:
                token = less
            else:
                open_at[at] = 0
                token = out.pop()
                at -= len(tokens[token])

    def encode_into(self, text: str, out: array) -> None:
        memo = self.memo
        for piece in self.find(text):
            ids = memo.get(piece)
            if ids is None:
                ids = array("i", self.encode_piece(piece.encode()))
                if len(memo) < MEMO and len(piece) <= MEMO_LETTERS:
                    memo[piece] = ids
            out.extend(ids)

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        if text:
            self.encode_into(text, out)
        return out.tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; exact for ids of a text."""
        parts = [self.bytes[self.offsets[i] : self.offsets[i + 1]] for i in ids]
        return np.concatenate(parts).tobytes().decode("utf-8", errors="replace") if parts else ""


_built: dict[int, BacktrackingEncoder] = {}


def encoder(ranks: bytes) -> BacktrackingEncoder:
    """One encoder a worker and vocabulary."""
    key = hash(ranks)
    if key not in _built:
        _built[key] = BacktrackingEncoder(ranks)
    return _built[key]


def encode_table(df: DataFrame, text_col: str = "text", out_col: str = "ids", ranks: bytes | None = None) -> DataFrame:
    """df's columns but for the text, and ``out_col``: the ids of the whole text, without special tokens.

    Strings of special tokens in a text are ordinary text. Empty and null texts give an empty list, never null.
    One pass over each partition, without a shuffle; ids go from worker to JVM as Arrow buffers.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks or vocabulary_file())  # a vocabulary, about 1 MB
    keep = [c for c in df.columns if c not in (text_col, out_col)]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"`{out_col}` array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared.value)
        for batch in batches:
            values, offsets = array("i"), array("i", [0])
            for text in batch.column(text_col).to_pylist():
                if text:
                    e.encode_into(text, values)
                offsets.append(len(values))
            ids = pa.ListArray.from_arrays(pa.array(np.frombuffer(offsets, dtype=np.int32)), pa.array(np.frombuffer(values, dtype=np.int32) if values else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], ids], names=[*keep, out_col])

    return df.select(*keep, text_col).mapInArrow(run, schema)


def count_table(df: DataFrame, text_col: str = "text", out_col: str = "n_tokens", ranks: bytes | None = None) -> DataFrame:
    """df's columns but for the text, and the number of its tokens; 0 for empty and null texts."""
    shared = df.sparkSession.sparkContext.broadcast(ranks or vocabulary_file())  # a vocabulary, about 1 MB
    keep = [c for c in df.columns if c not in (text_col, out_col)]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"`{out_col}` bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared.value)
        for batch in batches:
            counts = []
            for text in batch.column(text_col).to_pylist():
                ids = array("i")
                if text:
                    e.encode_into(text, ids)
                counts.append(len(ids))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(counts, pa.int64())], names=[*keep, out_col])

    return df.select(*keep, text_col).mapInArrow(run, schema)
