"""Personal data in free text: found by a conditional random field, replaced by typed placeholders."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotweave.llm.addresses import Locale
from lotweave.llm.crf import Chain, train
from lotweave.llm.pii_table import COUNT_WORDS, GOODS_WORDS, ID_WORDS, KINDS, PLACE_WORDS, REACH_WORDS, ROLE_WORDS, SMALL, TITLES, WORDS, labelled_texts

#: plain words, which are most; e-mail addresses; joined words; numbers with their letters, signs and separators; words; any other sign.
TOKENS = re.compile(
    r"[^\W\d_]+(?=[ ,;:)!?\n]|\.?(?:\s|$))|[\w.+-]+@[\w-]+(?:\.[\w-]+)*\w"
    r"|[^\W\d_]*\d[^\W_]*(?:[./-][^\W_]*\d[^\W_]*)*(?:,\d{3}(?!\d))*(?![\w+]*[._+][^\W\d_])"
    r"|\w+(?:[._+-]+\w+)*(?<=[\w])(?=\s*(?:@|\[at\]|\(at\)))|\w+(?:[._+]\w+)+"
    r"|[^\W\d_]+(?:['’-][^\W\d_]+)*|\S"
)
LABELS = ["O"] + [f"{b}-{k}" for k in KINDS for b in "BI"]
#: Texts tagged side by side, and tokens in them with padding, at most (a longer text is tagged alone).
SIDE_BY_SIDE, MOST_TOKENS = 1024, 200_000
#: Distinct tokens whose scores a tagger keeps; beyond them it starts anew.
MOST_KEPT = 50_000
_LOCALE = Locale()
_TYPES, _SIDES, _HEADS = set(_LOCALE.types), set(_LOCALE.sides), set(_LOCALE.heads)
_UNITS = set(_LOCALE.units.split("|")) | {"#"}
_TITLES = {t.lower().strip(".") for t in TITLES}
_MONTHS = {w.lower() for k in ("month", "day") for w in WORDS[k]}
_LISTS = (("title", _TITLES), ("type", _TYPES), ("side", _SIDES), ("head", _HEADS), ("unit", _UNITS), ("time", _MONTHS), ("place", PLACE_WORDS), ("good", GOODS_WORDS), ("role", ROLE_WORDS), ("reach", REACH_WORDS), ("id", ID_WORDS), ("count", COUNT_WORDS), ("small", frozenset(SMALL)))


def shape_of(token: str) -> str:
    """Letters as x or X, runs of them once; digits as 9, each."""
    out = re.sub(r"[^\W\d_]", lambda m: "X" if m[0].isupper() else "x", token)
    return re.sub(r"x+", "x", re.sub(r"X{3,}", "XX", re.sub(r"\d", "9", out)))


#: What stands before a token: MIXED texts have small and large letters, others tell nothing by them; STARTS: it begins a sentence.
MIXED, STARTS = 1, 2


def features_of(token: str, where: int, given: frozenset[str]) -> list[str]:
    """What is seen of a token: its word, its shape with and without case, and the lists it is in. Case counts only where a text has both."""
    low, mixed = token.lower(), where & MIXED
    if "@" in token and len(token) > 1:
        return ["b", "mail"]
    shape = shape_of(token if mixed else low)
    out = ["b", f"t={shape.lower()}", f"s={shape}" if mixed else f"f={shape}"]
    if token.isdigit() or not any(c.isdigit() for c in token):
        out.append(f"w={low}")
    out += [f"l={n}" for n, words in _LISTS if low in words]
    if low in given:
        out.append("l=given")
    if where & STARTS:
        out.append("first")
    if token.isalpha():
        out.append(f"n={min(len(token), 8)}")
        if mixed:
            out.append("cap" if token[0].isupper() else "low")
            if len(token) > 1 and token.isupper():
                out.append("upper")
    elif "-" in token and token.replace("-", "").isalpha():
        out.append("hyphen" + ("" if not mixed else "-cap" if token[0].isupper() else "-low"))
    elif any(c.isdigit() for c in token):
        out += ["digit", f"d={min(sum(c.isdigit() for c in token), 11)}", f"q={shape[:4]}"]
        if any(c.isalpha() for c in token):
            out.append("mixed")
    return out


def cut(text: str) -> tuple[list[tuple[int, int]], list[tuple[str, int]]]:
    """(start, end) of each token; the token itself and where it stands."""
    places, tokens, fresh, last = [], [], True, 0
    mixed, lines = MIXED if text != text.lower() and text != text.upper() else 0, "\n" in text
    for m in TOKENS.finditer(text):
        a, b = place = m.span()
        if lines and text.find("\n", last, a) >= 0:
            fresh = True
        token = text[a:b]
        places.append(place)
        tokens.append((token, mixed | STARTS if fresh else mixed))
        if b - a == 1:
            fresh = token in ".!?*•" or (token == "-" and (fresh or text[max(0, a - 1) : a].isspace()))
        else:
            fresh = False
        last = b
    return places, tokens


class Tagger:
    """Finds personal data. Trained from the small labelled table; given: first names, a sample."""

    def __init__(self, given: frozenset[str], index: dict[str, int], chain: Chain):
        self.given, self.index, self.chain = given, index, chain
        self._forget()

    def __getstate__(self) -> tuple:
        return self.given, self.index, self.chain

    def __setstate__(self, state: tuple) -> None:
        self.given, self.index, self.chain = state
        self._forget()

    def _forget(self) -> None:
        """No token's scores are known but those of no token, in row 0."""
        self.kept: dict[tuple[str, int], int] = {}
        self.scores = np.zeros((1024, *self.chain.weights.shape[1:]), np.float32)

    @classmethod
    def trained(cls, given: list[str], rows: int = 2500, seed: int = 5, unknown: float = 0.3, texts: list | None = None) -> Tagger:
        """rows bounds the labelled table; the same rows and seed give the same tagger.

        A share ``unknown`` of the tokens is learned from without its word, as a text's words are mostly in no table.
        """
        known = frozenset(g.lower() for g in given)
        texts = texts or labelled_texts(sorted(given), rows, seed)
        rng = np.random.default_rng(seed)
        vocab: dict[tuple[str, int, bool], int] = {}
        seqs, tags = [], []
        for text, spans in texts:
            where, tokens = cut(text)
            label = [0] * len(tokens)
            for lo, hi, kind in spans:
                inside = [i for i, (a, b) in enumerate(where) if a < hi and b > lo]
                for j, i in enumerate(inside):
                    label[i] = LABELS.index(("I-" if j else "B-") + kind)
            bare = rng.random(len(tokens)) < unknown
            seqs.append([vocab.setdefault((*t, bool(u)), len(vocab)) for t, u in zip(tokens, bare)])
            tags.append(label)
        index: dict[str, int] = {}
        features = [[index.setdefault(f, len(index)) for f in features_of(t, s, known) if not (u and f.startswith("w="))] for t, s, u in vocab]
        # a word seen once says nothing that its shape doesn't
        uses = np.bincount([x for seq in seqs for t in seq for x in features[t]], minlength=len(index))
        rare = {i for f, i in index.items() if f.startswith("w=") and uses[i] < 4}
        kept = {f: i for i, f in enumerate(f for f, i in index.items() if i not in rare)}
        old = {i: kept[f] for f, i in index.items() if f in kept}
        features = [[old[x] for x in fs if x in old] for fs in features]
        longest = max(map(len, seqs))
        x = np.full((len(seqs), longest), len(vocab))
        y = np.zeros((len(seqs), longest), dtype=np.int64)
        for i, (s, t) in enumerate(zip(seqs, tags)):
            x[i, : len(s)], y[i, : len(t)] = s, t
        chain = train(x, np.array([len(s) for s in seqs]), y, features, len(kept), len(LABELS))
        return cls(known, kept, chain)

    def _rows(self, tokens: list[tuple[str, int]], new: list[list[int]]) -> list[int]:
        """The rows of the tokens' scores; features of tokens seen for the first time are added to ``new``."""
        kept, index = self.kept, self.index
        for key in tokens:
            if key not in kept:
                kept[key] = len(kept) + 1
                new.append([index[f] for f in features_of(*key, self.given) if f in index])
        return [kept[key] for key in tokens]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of the items in each text, in order."""
        cuts = [cut(t) for t in texts]
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if len(self.kept) > MOST_KEPT:
            self._forget()
        before, new = len(self.kept) + 1, []
        seqs = [self._rows(c, new) for _, c in cuts]
        if new:
            need = before + len(new)
            if need > len(self.scores):
                self.scores = np.concatenate([self.scores[:before], np.zeros((max(need, 2 * before) - before, *self.scores.shape[1:]), np.float32)])
            self.scores[before:need] = self.chain.scores_of(new)
        order = sorted((i for i, s in enumerate(seqs) if s), key=lambda i: len(seqs[i]))
        at = 0
        while at < len(order):
            some = [order[at]]
            while at + len(some) < len(order) and len(some) < SIDE_BY_SIDE and len(seqs[order[at + len(some)]]) * (len(some) + 1) <= MOST_TOKENS:
                some.append(order[at + len(some)])
            at += len(some)
            lengths = np.array([len(seqs[i]) for i in some])
            x = np.zeros((len(some), int(lengths.max())), dtype=np.int64)
            for k, i in enumerate(some):
                x[k, : lengths[k]] = seqs[i]
            found = self.chain.viterbi(self.chain.emissions(x, self.scores), lengths)
            for k, i in enumerate(some):
                out[i] = self._items(texts[i], cuts[i][0], found[k, : lengths[k]])
        return out

    def _items(self, text: str, places: list[tuple[int, int]], labels: np.ndarray) -> list[tuple[int, int, str]]:
        out, n, j = [], len(places), 0
        for i in np.flatnonzero(labels).tolist():
            if i < j:
                continue
            kind, j = (int(labels[i]) - 1) // 2, i + 1
            while j < n and labels[j] == 2 * kind + 2:
                j += 1
            if span := checked(text, places[i][0], places[j - 1][1], KINDS[kind]):
                out.append((*span, KINDS[kind]))
        return out


def checked(text: str, lo: int, hi: int, kind: str) -> tuple[int, int] | None:
    """The item without punctuation around it, or none if it can't be of its kind.

    The point of a shortened last word of an address belongs to it where the sentence plainly goes on, or has a point of its own.
    """
    opening = "(+" if kind == "phone" else ""
    while lo < hi and not text[lo].isalnum() and text[lo] not in opening:
        lo += 1
    while lo < hi and not text[hi - 1].isalnum():
        hi -= 1
    item = text[lo:hi]
    digits = sum(c.isdigit() for c in item)
    if kind == "phone":
        lo += len(item) - len(item.lstrip("".join({c for c in item if not c.isdigit() and c not in opening})))
        item = text[lo:hi]
        if item.startswith("(") and ")" not in item:
            lo, item = lo + 1, item[1:]
        # an extension belongs to the number, whole or begun
        begun = re.search(r"(?i)(?<![^\W\d_])(?:ext|x|extension)$", item)
        if more := re.match(r"(?i)\.?\s*\d{1,5}\b" if begun else r"(?i),?\s*(?:ext\.?|extension|x)\s*\d{1,5}\b", text[hi:]):
            hi += more.end()
        hi = lo + len(re.sub(r"(?i)\s*\b(?:ext|x|extension)$", "", text[lo:hi]))
        return (lo, hi) if digits >= 7 else None
    if kind == "email":
        return (lo, hi) if "@" in item or re.search(r"\bat\b", item.lower()) else None
    if kind == "id_number":
        return (lo, hi) if digits >= 5 else None
    if kind == "street_address":
        if not item[:1].isdigit() or not re.search(r"[^\W\d_]{2}", item):
            return None
        # a unit belongs to the address, whole or begun
        begun = re.search(rf"(?i)(?:^|\s)(?:{_LOCALE.units})$", item)
        if more := re.match(r"\.?\s*#?\s*\d+[^\W\d_]?\b", text[hi:]) if begun else re.match(rf"(?i)\.?,?\s*(?:(?:{_LOCALE.units})\b\.?\s*#?|#)\s*(?:\d+[a-z]?|[a-z]\d*)\b", text[hi:]):
            return lo, hi + more.end()
        last = re.search(r"[^\W\d_]+$", item)
        if last and last[0].lower() in (_TYPES | _SIDES) and text[hi : hi + 1] == ".":
            after = text[hi + 1 : hi + 3]
            if after[:1] in (".", ",", ";", ":", ")") or (after[:1].isspace() and after[1:].islower() and not text.islower()):
                hi += 1
        return lo, hi
    if more := re.match(r"\.\s?[^\W\d_]+(?:-[^\W\d_]+)*", text[hi:]) if re.search(r"(?:^|\s)[^\W\d_]$", item) else None:
        hi += more.end()  # an initial, and the family name after it
    item = text[lo:hi]
    return (lo, hi) if re.search(r"[^\W\d_]{2}", item) and not digits else None


@lru_cache(maxsize=4)
def _trained(given: tuple[str, ...], rows: int, seed: int) -> Tagger:
    return Tagger.trained(list(given), rows, seed)


#: A list of first names goes to every worker; a larger one is refused, not cut.
MOST_NAMES = 1_000_000


def tagger_for(given_names: DataFrame, rows: int = 2500, seed: int = 5) -> Tagger:
    """A tagger with all first names of given_names, which are features only; more than MOST_NAMES are refused."""
    names = given_names.select(F.trim("given_name").alias("g")).where("g <> ''").distinct()
    if names.count() > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} first names")
    return _trained(tuple(sorted(r["g"] for r in names.collect())), rows, seed)


def find(df: DataFrame, tagger: Tagger, id_col: str, text_col: str) -> DataFrame:
    """(id_col, start, end, kind, found) of every item; start and end count characters from 0. Null and empty texts have none."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(tagger)  # a few MB, bounded by the labelled table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, SIDE_BY_SIDE):
                part = b.slice(lo, SIDE_BY_SIDE)
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = shared.value.spans(texts)
                rows = [(i, *s) for i, spans in enumerate(found) for s in spans]
                ids = part.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                cols = [pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.string()), pa.array([texts[r[0]][r[1] : r[2]] for r in rows], pa.string())]
                yield pa.RecordBatch.from_arrays([ids, *cols], names=[id_col, "start", "end", "kind", "found"])

    return df.select(id_col, text_col).where(F.col(text_col).isNotNull()).mapInArrow(run, f"`{id_col}` {kind}, start int, end int, kind string, found string")


def redact(df: DataFrame, tagger: Tagger, text_col: str, out_col: str = "redacted") -> DataFrame:
    """df with out_col: the text with each item replaced by ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[STREET_ADDRESS]`` or ``[PERSON_NAME]``; null for null."""
    shared = df.sparkSession.sparkContext.broadcast(tagger)  # a few MB, bounded by the labelled table
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in df.columns if c != out_col] + [f"`{out_col}` string"])
    keep = [c for c in df.columns if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, SIDE_BY_SIDE):
                part = b.slice(lo, SIDE_BY_SIDE)
                texts = part.column(text_col).to_pylist()
                out = []
                for t, spans in zip(texts, shared.value.spans([t or "" for t in texts])):
                    for a, z, kind in reversed(spans):
                        t = f"{t[:a]}[{kind.upper()}]{t[z:]}"
                    out.append(t)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(out, pa.string())], names=[*keep, out_col])

    return df.select(*keep).mapInArrow(run, schema)
