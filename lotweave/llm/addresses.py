"""Which address records denote the same place."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field


def _table(text: str) -> dict[str, str]:
    """'street: st str' lines to {'st': 'street', 'str': 'street', 'street': 'street'}."""
    out = {}
    for line in text.strip().splitlines():
        full, _, short = line.partition(":")
        out |= {s: full.strip() for s in [full.strip(), *short.split()]}
    return out


@dataclass(frozen=True)
class Locale:
    """The abbreviations, number words and cities of a locale's addresses."""

    types: dict[str, str] = field(
        default_factory=lambda: _table("""
street: st str
avenue: av ave
road: rd
lane: la ln
drive: dr drv
boulevard: boul blvd bl
court: crt ct
place: pl plc
terrace: ter terr
square: sq
circle: cir circ
way: wy
parkway: pkwy pky
highway: hwy
alley: aly
row:
path:
wharf: whf
plaza: plz
trail: trl
""")
    )
    sides: dict[str, str] = field(default_factory=lambda: _table("north: n no\nsouth: s so\neast: e\nwest: w"))
    heads: dict[str, str] = field(default_factory=lambda: _table("saint: st ste sainte\nmount: mt\nfort: ft"))
    units: str = "apartment|apt|unit|suite|ste|floor|fl|room|rm|penthouse|ph"
    numbers: tuple[str, ...] = tuple("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split())
    cities: dict[str, str] = field(default_factory=lambda: {"boston": "boston", "new york": "new york", "brooklyn": "new york", "nyc": "new york", "san francisco": "san francisco", "sf": "san francisco"})
    states: tuple[str, ...] = ("ma", "ny", "ca")
    no_places: tuple[str, ...] = ("rear lot", "private way", "harbor strip")


@dataclass(frozen=True)
class Place:
    number: str = ""
    head: str = ""
    side: str = ""
    name: str = ""
    kind: str = ""
    zip: str = ""


class AddressParser:
    """Parts of an address: house number (with its letter or range), direction, street's name and type.

    Units, floors, names of houses, parts of a building, city, state and zip are left out; abbreviations are expanded, and
    the order of the parts makes no difference. What has no house number or no street's name names no place.
    """

    NUMBER = r"\d+(?:\s*[-–&/]\s*\d+)?(?:\s*[-–]?\s*[a-d](?![a-z]))?"

    def __init__(self, locale: Locale | None = None):
        self.locale = loc = locale or Locale()
        cities = "|".join(sorted(map(re.escape, loc.cities), key=len, reverse=True))
        self.tail = re.compile(rf"[\s,]+(?:(?:{cities})|(?:{'|'.join(loc.states)})|\d{{5}}(?:-\d{{4}})?)[\s.,]*$")
        self.unit = re.compile(rf"(?:\b(?:{loc.units})\b\.?\s*#?\s*|#\s*)(?:\d+\s*[a-z]?|[a-z]\d*)(?![\w])|\b\d+(?:st|nd|rd|th)\s+(?:floor|fl)\b\.?|\([^)]*\)|\s+-\s+[a-z][a-z ]*$")
        self.part = re.compile(r"^(?:(?:rear|front|side|back|upper|lower|carriage|coach)\b.*|.*\b(?:bldg|building|house|cottage|annex))\.?$")
        self.words = {w: str(i) for i, w in enumerate(loc.numbers)}
        named = "|".join(loc.numbers[1:])
        self.sign = re.compile(rf"\bno\s+({self.NUMBER}|{named})$")
        self.first, self.last = re.compile(rf"^({self.NUMBER}|\d+\s+\d+(?=\s+[a-z])|(?:{named})(?=\s+\w))(?=\s|$)"), re.compile(rf"(?:^|\s)({self.NUMBER}|{named})$")

    def number(self, text: str | None) -> str:
        """A house number: zeros in front and '.0' left out, '12 a' and '12-a' as '12a', '12 14' as '12-14'."""
        t = re.sub(r"\s+", " ", (text or "").strip().lower())
        t = self.words.get(t, t)
        if not (m := re.fullmatch(r"0*(\d+)(?:\.0+)?(?:\s*[-–&/ ]\s*0*(\d+)(?:\.0+)?)?\s*[-–]?\s*([a-z]?)", t)):
            return ""
        low, high, letter = m.groups()
        return "" if low == "0" else f"{low}{letter}" if high is None or high == low else f"{low}-{high}{letter}"

    def parse(self, address: str | None, number: str | None = None) -> Place:
        t = unicodedata.normalize("NFKC", address or "").lower()
        t = re.sub(r"\s+", " ", t).strip(" .,")
        code = ""
        while m := self.tail.search(t):
            code = code or re.sub(r"\D", "", m[0])[:5]
            t = t[: m.start()]
        given = self.number(number)
        found, street = given, ""
        for piece in self.unit.sub(" ", t).split(","):
            piece = re.sub(r"\s+", " ", piece.replace(".", " ").replace("#", " ")).strip(" -")
            if not piece or self.part.match(piece):
                continue
            for pattern in (self.sign, self.first, self.last):
                if not given and not found and (m := pattern.search(piece)):
                    found = self.number(m[1])
                    piece = (piece[: m.start()] + " " + piece[m.end() :]).strip()
                    break
            words = piece.split()
            if not street and words and any(len(w) > 1 for w in words):
                street = " ".join(words)
        if not found or not street or street in self.locale.no_places:
            return Place()
        return self.street(found, street.split(), code)

    def street(self, number: str, words: list[str], code: str = "") -> Place:
        loc, head, side, kind = self.locale, "", "", ""
        if len(words) > 1 and words[-1] in loc.sides:
            side, words = loc.sides[words[-1]], words[:-1]
        if len(words) > 1 and words[0] in loc.sides:
            side, words = side or loc.sides[words[0]], words[1:]
        if len(words) > 1 and words[-1] in loc.types:
            kind, words = loc.types[words[-1]], words[:-1]
        if len(words) > 1 and words[-1] in loc.sides:
            side, words = side or loc.sides[words[-1]], words[:-1]
        if len(words) > 1 and words[0] in loc.heads:
            head, words = loc.heads[words[0]], words[1:]
        return Place(number, head, side, " ".join(words), kind, code)


def spelling_distance(a: str, b: str, most: int = 2) -> int:
    """Edits (insert, drop, replace, swap of neighbours) that turn a into b; most + 1 if more are needed."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    last, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, last, row = last, row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], before[j - 2] + 1)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def complete(variants: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """For each (head, side, kind) a street is written with, that with missing parts filled in.

    A missing part takes the only value that the street's variants agreeing in all other given parts have; if they have
    several, or none, it stays missing. Parts are filled from the given ones, not from those filled before.
    """

    def agree(v, w, but):
        return all(i == but or not v[i] or not w[i] or v[i] == w[i] for i in range(3))

    out = []
    for v in variants:
        full = list(v)
        for i in range(3):
            if not v[i]:
                seen = {w[i] for w in variants if w[i] and agree(v, w, i)}
                if len(seen) == 1:
                    full[i] = seen.pop()
        out.append(tuple(full))
    return out
