"""Cleaning, coding and measuring of texts as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotweave.functions.geo import let

#: Contractions in the order they are expanded.
CONTRACTIONS = [("won't", "will not"), ("can't", "cannot"), ("n't", " not"), ("'re", " are"), ("'ve", " have"), ("'ll", " will"), ("'d", " would"), ("'m", " am"), ("'s", " is")]
#: Phrases of advertisements that say nothing, removed in this order.
BOILERPLATE = ["for more information", "call today", "schedule a showing", "contact us", "click here", "virtual tour", "open house", "price reduced", "must see", "won't last", "act fast"]
#: Fixed value: a whole postal address inside a lower-case text.
ADDRESS = r"\d+\s+\w+\s+(street|st|avenue|ave|road|rd|drive|dr|lane|ln|way|place|pl|court|ct|boulevard|blvd),?\s*\w*,?\s*\w{2}\s*\d{5}"
#: Street types' abbreviations, in the order they are expanded.
SUFFIXES = {"st": "street", "str": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "dr": "drive", "rd": "road", "ln": "lane", "ct": "court", "pl": "place", "ter": "terrace", "cir": "circle", "pkwy": "parkway", "hwy": "highway", "sq": "square", "wy": "way"}
#: Categories of offences by city and the terms that mark them; the first category with a term in the description counts.
OFFENCES = {
    "violent": {"boston": ["HOMICIDE", "ASSAULT", "ROBBERY", "AGGRAVATED ASSAULT", "ASSAULT - AGGRAVATED", "MANSLAUGHTER"], "nyc": ["FELONY ASSAULT", "ROBBERY", "MURDER & NON-NEGL. MANSLAUGHTER", "RAPE"], "sf": ["HOMICIDE", "ROBBERY", "ASSAULT"]},
    "property": {"boston": ["BURGLARY", "LARCENY", "AUTO THEFT", "LARCENY FROM MOTOR VEHICLE", "RESIDENTIAL BURGLARY", "COMMERCIAL BURGLARY"], "nyc": ["BURGLARY", "GRAND LARCENY", "GRAND LARCENY OF MOTOR VEHICLE", "PETIT LARCENY"], "sf": ["BURGLARY", "LARCENY THEFT", "MOTOR VEHICLE THEFT"]},
    "quality_of_life": {"boston": ["VANDALISM", "DISORDERLY CONDUCT", "DRUG VIOLATION", "LIQUOR VIOLATION"], "nyc": ["CRIMINAL MISCHIEF & RELATED OF", "OFFENSES AGAINST PUBLIC ADMINI"], "sf": ["VANDALISM", "DRUG OFFENSE", "DISORDERLY CONDUCT"]},
}
#: Number words, and the patterns of each fact in the order they are tried; the first match that is a number counts.
NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
_W, _NUM, _INT = f"(?:{'|'.join(NUMBER_WORDS)})", r"(\d+(?:,\d{3})*(?:\.\d+)?)", r"(\d+)"
SLOTS = {
    "beds": [rf"{_INT}\s*[-\s]?bed(?:room)?s?\b", rf"({_W})\s*[-\s]?bed(?:room)?s?\b", rf"\b{_INT}\s*br\b"],
    "baths": [rf"{_NUM}\s*[-\s]?bath(?:room)?s?\b", rf"({_W})\s*[-\s]?bath(?:room)?s?\b", rf"\b{_NUM}\s*ba\b"],
    "sqft": [rf"{_NUM}\s*(?:sq\.?\s*ft\.?|square\s*feet|square\s*foot|sf)\b", rf"approximately\s*{_NUM}\s*(?:sq|square)"],
    "year_built": [r"built\s+in\s+(\d{4})\b", r"\bcirca\s+(\d{4})\b", r"originally\s+(?:built|crafted|constructed)\s+in\s+(\d{4})", r"\b(\d{4})\s*(?:-built|construction)\b"],
    "lot_sqft": [rf"lot\s*(?:size|area)?\s*(?:of|:)?\s*{_NUM}\s*(?:sq|square)", rf"{_NUM}\s*(?:sq\.?\s*ft\.?|square\s*feet)\s*lot\b"],
    "parking": [rf"{_INT}\s*[-\s]?car\s*garage", rf"({_W})\s*[-\s]?car\s*garage", rf"parking\s*for\s*{_INT}\b", rf"{_INT}\s*parking\s*spaces?"],
    "stories": [rf"{_INT}[-\s]?stor(?:y|ies|ey|eys)\b", rf"({_W})[-\s]?stor(?:y|ies|ey|eys)\b", rf"{_INT}[-\s]?level\b"],
}
#: For each of those patterns, parts of words without one of which it can't match.
SLOT_WORDS = {
    "beds": [["bed"], ["bed"], ["br"]],
    "baths": [["bath"], ["bath"], ["ba"]],
    "sqft": [["sq", "sf"], ["approximately"]],
    "year_built": [["built"], ["circa"], ["originally"], ["built", "construction"]],
    "lot_sqft": [["lot"], ["lot"]],
    "parking": [["garage"], ["garage"], ["parking"], ["parking"]],
    "stories": [["stor"], ["stor"], ["level"]],
}
#: Words that name places, removed from texts to see what is left without them.
PLACE_WORDS = [
    r"\d{5}", "manhattan", "brooklyn", "bronx", "queens", "staten island", "upper east", "upper west", "lower east", "chelsea", "soho", "tribeca", "williamsburg", "bushwick", "park slope", "dumbo",
    "south end", "back bay", "beacon hill", "jamaica plain", "mission", "noe valley", "pacific heights", "sunset", "richmond", "north beach", "haight", "castro", "soma", "downtown", "midtown", "uptown",
    "village", "heights", "hill", "park", "ave", "street", "st",
]
#: Categories of words, tried in this order.
WORD_CLASSES = {
    "place_name": "north south east west noe mission sunset richmond marina nob pacific presidio bayview excelsior castro haight telegraph ingleside lakeside outer inner downtown uptown bernal potrero glen st fremont brooklyn bronx queens manhattan bay midtown upper lower williamsburg astoria harlem chelsea tribeca soho dumbo allston brighton cambridge brookline somerville jamaica".split(),
    "architectural": "victorian edwardian prewar postwar craftsman tudor colonial modern loft brownstone townhouse condo cottage mansion duplex triplex stories story shingle stucco brick wood frame siding facade".split(),
    "amenity": "park subway transit bart muni school freeway highway shopping dining restaurants cafes boutique steps blocks near close minutes walk walking trail trails garden yard".split(),
    "aesthetic": "stunning charming beautiful elegant luxurious lovely spectacular gorgeous exquisite rare unique premier prestigious private secluded tranquil serene iconic renovated updated remodeled pristine turnkey".split(),
    "formality": "offering presents boasts features appointed appointments discerning connoisseur appreciation incomparable".split(),
}


def replace_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, c)


def squeeze(c: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_description(c: Column) -> Column:
    """Tags and phrases of advertisements removed, white space squeezed, lower case, contractions expanded, addresses as [ADDRESS]; '' for null.

    Contractions go first, so a phrase with one in it never matches.
    """
    t = F.lower(squeeze(F.regexp_replace(c, "<[^>]+>", "")))
    t = replace_all(replace_all(t, CONTRACTIONS), [(p, "") for p in BOILERPLATE])
    return F.coalesce(F.trim(F.regexp_replace(t, ADDRESS, "[ADDRESS]")), F.lit(""))


def normalize_address(c: Column) -> Column:
    """Upper case, units stripped, directions and street types spelt out, white space squeezed, no points at the end; '' for null."""
    kinds = "UNIT|APT|STE|SUITE|FL|FLOOR|RM|ROOM|PH"
    t = F.regexp_replace(F.trim(F.upper(c)), rf"\s*[#,]\s*({kinds})?\s*\S*$", "")
    t = F.regexp_replace(t, rf"\s+({kinds})\s+\S*$", "")
    for short, full in [*zip("NSEW", ("NORTH", "SOUTH", "EAST", "WEST")), *[(a.upper(), b.upper()) for a, b in SUFFIXES.items()]]:
        t = F.regexp_replace(t, rf"\b{short}\b", full)
    return F.coalesce(F.regexp_replace(squeeze(t), r"\.+$", ""), F.lit(""))


def classify(description: Column, city: Column, table: dict[str, dict[str, list[str]]] | None = None) -> Column:
    """The first category one of whose terms for the city is in the description; else other."""
    t = F.trim(F.upper(F.coalesce(description, F.lit(""))))
    out = None
    for category, cities in (table or OFFENCES).items():
        hit = reduce(lambda a, b: a | b, [(city == name) & reduce(lambda a, b: a | b, [F.contains(t, F.lit(x)) for x in terms]) for name, terms in cities.items()])
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise("other")


def _dashed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[–—]", "-")


def _number(t: Column, low: Column, name: str) -> Column:
    """The first number of a fact in a text whose dashes are plain, given in lower case too; a pattern is tried only if those before it found none, and where one of its words is."""

    def value(m: Column) -> Column:
        word = F.array_position(F.array(*[F.lit(w) for w in NUMBER_WORDS]), m)
        return F.when(m != "", F.coalesce(m.try_cast("double"), F.when(word > 0, word.cast("double"))))

    found = [let(F.lower(F.regexp_replace(F.regexp_extract(t, f"(?i){p}", 1), ",", "")), value) for p in SLOTS[name]]
    return F.coalesce(*[F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in ws]), v) for ws, v in zip(SLOT_WORDS[name], found)])


def _searched(text: Column, body: Callable[[Column, Column], Column]) -> Column:
    return let(_dashed(text), lambda t: let(F.lower(t), lambda low: body(t, low)))


def slots(text: Column) -> Column:
    """All facts of a text, as a struct of doubles."""
    return _searched(text, lambda t, low: F.struct(*[_number(t, low, s).alias(s) for s in SLOTS]))


def slots_kept(a: Column, text: Column) -> Column:
    """Whether a text agrees with all of a struct of facts, or says nothing; it is searched only for facts that the struct has."""
    return _searched(text, lambda t, low: reduce(lambda x, y: x & y, [a[s].isNull() | F.coalesce(F.abs(a[s] - _number(t, low, s)) < 1e-6, F.lit(True)) for s in SLOTS]))


def slots_match(a: Column, b: Column) -> Column:
    """For each fact, whether both texts agree on it, or one says nothing."""
    return F.struct(*[F.coalesce(F.abs(a[s] - b[s]) < 1e-6, F.lit(True)).alias(s) for s in SLOTS])


def without_places(c: Column) -> Column:
    """Lower case, place words removed (of two at one point, the first of the list), white space squeezed.

    One search for all of them: no word overlaps a later start of one before it, and what a removal leaves makes no new one.
    """
    first = {}
    for p in PLACE_WORDS:
        first.setdefault(p[0], []).append(p[1:])
    words = "|".join(rf"{a}(?:{'|'.join(rest)})" if a.isalpha() else "|".join(a + r for r in rest) for a, rest in first.items())
    return squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), rf"\b(?:{words})\b", ""))


def n_words(c: Column) -> Column:
    """Words between white space."""
    t = squeeze(c)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def word_class(w: Column) -> Column:
    """The first category that has the word, else generic_other; place names in any case."""
    out = None
    for name, words in WORD_CLASSES.items():
        hit = (F.lower(w) if name == "place_name" else w).isin(*words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("generic_other")


def vocabulary(c: Column) -> Column:
    """Distinct words of three letters or more, lower case."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.array_distinct(F.filter(runs, lambda w: w.rlike("^[a-z]{3,}$")))


def style(c: Column, function_words: list[str]) -> Column:
    """Surface measures of a text: words, sentences, lengths, variety, punctuation, readability, and shares of function words; null for texts without words."""
    sents = F.greatest(F.size(F.regexp_extract_all(c, F.lit(r"([.!?]+)(?:\s|$)"), F.lit(1))), F.lit(1)).cast("double")

    def measured(low: Column) -> Column:
        n = F.size(low).cast("double")
        letters = F.aggregate(low, F.lit(0), lambda s, w: s + F.length(w)).cast("double")
        syllables = F.aggregate(low, F.lit(0), lambda s, w: s + F.greatest(F.size(F.regexp_extract_all(w, F.lit("([aeiouy]+)"), F.lit(1))), F.lit(1))).cast("double")

        def per_word(sign: str) -> Column:
            return (F.length(c) - F.length(F.replace(c, F.lit(sign), F.lit("")))) / n

        def share(word: str) -> Column:
            return F.size(F.filter(low, lambda x: x == word)) / n

        fields = {
            "n_words": n, "n_sentences": sents, "mean_sentence_length": n / sents, "mean_word_length": letters / n, "type_token_ratio": F.size(F.array_distinct(low)) / n, "log_n_words": F.ln(n),
            "comma_per_word": per_word(","), "semicolon_per_word": per_word(";"), "exclaim_per_word": per_word("!"), "question_per_word": per_word("?"),
            "flesch_reading_ease": 206.835 - 1.015 * n / sents - 84.6 * syllables / n, "flesch_kincaid_grade": 0.39 * n / sents + 11.8 * syllables / n - 15.59,
            "automated_readability": 4.71 * letters / n + 0.5 * n / sents - 21.43, "coleman_liau": 5.88 * letters / n - 29.6 * sents / n - 15.8,
        }
        fields |= {f"fw_{w}": share(w) for w in function_words}
        return F.when(F.size(low) > 0, F.struct(*[v.alias(k) for k, v in fields.items()]))

    # the words are found once, however many measures there are
    return let(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z][a-z'-]*)"), F.lit(1)), measured)


def formality(tags: Column) -> Column:
    """Heylighen-Dewaele F of an array of Penn Treebank tags: shares of deictic classes against contextual ones; null without tags."""
    plus = ["NN", "NNS", "NNP", "NNPS", "JJ", "JJR", "JJS", "IN", "DT"]
    minus = ["PRP", "PRP$", "WP", "WP$", "VB", "VBD", "VBG", "VBN", "VBP", "VBZ", "MD", "RB", "RBR", "RBS", "WRB", "UH"]
    n = F.size(tags)
    return F.when(n > 0, (100 * (F.size(F.filter(tags, lambda t: t.isin(*plus))) - F.size(F.filter(tags, lambda t: t.isin(*minus)))) / n + 100) / 2)


def json_inside(c: Column) -> Column:
    """The object in a model's answer: fences off, from the first brace to the last; null without."""
    t = F.regexp_replace(F.trim(c), r"^```(?:json)?\s*|\s*```$", "")
    found = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def zip5(c: Column) -> Column:
    """The five-digit code of a zip however written (label, +4, decimals, lost zeros in front); null without one or for zeros."""
    digits = F.regexp_extract(c, r"^[\s\p{Z}]*(?:[A-Za-z.]+[\s\p{Z}:#-]*)*(\d{1,9})(?:\.0*)?(?:[\s\p{Z}]*-[\s\p{Z}]*\d{4})?[\s\p{Z}]*$", 1)
    code = F.when(F.length(digits) <= 5, F.lpad(digits, 5, "0")).otherwise(F.substring(F.lpad(digits, 9, "0"), 1, 5))
    return F.when((digits != "") & (code != "00000"), code)


#: Words without meaning of their own, by their Penn Treebank tag; the sorted list of them is what style counts.
FUNCTION_WORDS = {
    "DT": "a all an another any both each either every few many more most neither no some such that the these this those".split(),
    "IN": "about above after against as at because before below between by down during for from if in into of off on out over than through to under until up while with".split(),
    "PRP": "he her hers herself him himself his i it its itself me my myself our ours ourselves she their theirs them themselves they us we you your yours yourself".split(),
    "WP": "what which who whom whose".split(),
    "MD": "can could may might must shall should will would".split(),
    "VBZ": "am are be been being did do does doing had has have having is was were".split(),
    "WRB": "how when where why".split(),
    "RB": "again also further here just not now once only own same so then there too very".split(),
    "CC": "and but nor or yet".split(),
}
#: Endings that tell a word's tag, tried in order; other words are nouns.
ENDINGS = [("ly", "RB"), ("ing", "VBG"), ("ed", "VBD"), ("ize", "VB"), ("ful", "JJ"), ("ous", "JJ"), ("ive", "JJ"), ("able", "JJ"), ("ible", "JJ"), ("al", "JJ"), ("ic", "JJ"), ("less", "JJ")]
#: The seven classes whose shares are counted.
TAG_CLASSES = {"noun": ["NN"], "verb": ["VB", "VBD", "VBG", "VBZ", "MD"], "adjective": ["JJ"], "adverb": ["RB", "WRB"], "pronoun": ["PRP", "WP"], "preposition": ["IN"], "determiner": ["DT"]}


def function_words(most: int = 200) -> list[str]:
    """The first of the sorted function words."""
    return sorted(w for ws in FUNCTION_WORDS.values() for w in ws)[:most]


def word_tags(c: Column) -> Column:
    """A tag for each word of a text, from the list of function words and endings: a stand-in for a tagger, which may be put in its place."""

    def tag(w: Column) -> Column:
        out = None
        for name, words in FUNCTION_WORDS.items():
            out = F.when(w.isin(*words), name) if out is None else out.when(w.isin(*words), name)
        for end, name in ENDINGS:
            out = out.when(F.endswith(w, F.lit(end)) & (F.length(w) > len(end) + 1), name)
        return out.otherwise("NN")

    return F.transform(F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1)), tag)


def tag_shares(tags: Column) -> Column:
    """A struct of the shares of the seven classes; null without tags."""
    n = F.size(tags)

    def share(kinds: list[str]) -> Column:
        return F.size(F.filter(tags, lambda t: t.isin(*kinds))) / n

    return F.when(n > 0, F.struct(*[share(kinds).alias(name) for name, kinds in TAG_CLASSES.items()]))


def built_address(number: Column, street: Column) -> Column:
    """The whole house number, a blank and the street; null if either is missing, the number isn't one, or nothing but a few letters comes of it."""
    n = F.trim(number).try_cast("double")
    out = F.concat_ws(" ", n.cast("bigint").cast("string"), F.trim(street))
    return F.when(n.isNotNull() & ~F.isnan(n) & (F.trim(street) != "") & (F.length(out) > 3), out)
