"""Edge cases, brute force, round trips and held-out accuracy of the operators for texts."""

import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotweave.llm import mixing, neardup, pii, places, repetition, splits, tokens
from lotweave.llm.addresses import AddressParser, complete, spelling_distance
from lotweave.llm.crf import Chain
from lotweave.llm.pii_table import WITH, WITHOUT, labelled_texts
from lotweave.llm.words import distinct_runs, word_ids

ODD = ["", " ", "\n\n", "a", "é", "́", "中文字", "😀👍🏽", "<|endoftext|> x", "'s 's'll", "  a   b ", "0" * 50, "a" * 3000, "ab" * 1500, "　x y", "ﬁ ﬂ", "x\x00y", "﻿"]


# ---- splits


@pytest.mark.parametrize(
    ("text", "code"),
    [("21325", "21325"), (" 00422 ", "00422"), ("476.0", "00476"), ("21305-6266", "21305"), ("213299864", "21329"), ("zip 21341", "21341"), ("ZIP: 98756", "98756"), ("MA 00455", "00455"), ("US-98729", "98729"), ("443", "00443"), ("4404326", "00440"), ("0", None), ("00000", None), ("00000-1234", None), ("nan", None), ("N/A", None), ("", None), (None, None), ("unknown", None), ("12 34", None)],
)
def test_zip5(spark, text, code):
    assert spark.createDataFrame([(text,)], "z string").select(splits.zip5(F.col("z"))).first()[0] == code


def test_splits_keep_groups_whole(spark, scratch):
    r = random.Random(1)
    rows = [(i, f"{r.randint(1, 400):05}" if r.random() < 0.6 else None, f"p{r.randint(1, 900)}" if r.random() < 0.3 else " ", "x") for i in range(1500)] + [(1, "00001", None, "x")]
    df = spark.createDataFrame(rows, "emb_id long, zip string, parcel_id string, group string")
    groups = splits.related_groups(df, scratch)
    assert groups.count() == 1501
    out = splits.assign_splits(df, groups, scratch).toPandas()
    assert len(out) == 1501
    assert (out[out.group.notna()].groupby("group").split.nunique() == 1).all()
    share = out.split.value_counts(normalize=True)
    assert abs(share["train"] - 0.7) < 0.01 and abs(share["test"] - 0.15) < 0.01


def test_splits_of_nothing_and_of_one_group(spark, scratch):
    df = spark.createDataFrame([(i, "12345", None) for i in range(9)], "emb_id long, zip string, parcel_id string")
    assert splits.assign_splits(df, splits.related_groups(df, scratch), scratch).select("split").distinct().count() == 1
    assert splits.assign_splits(df, splits.related_groups(df.limit(0), scratch), scratch).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_closest_counts_is_closest(seed):
    r = random.Random(seed)
    sizes = {s: r.randint(1, 3) for s in r.sample(range(1, 15), 3)}
    total = sum(s * n for s, n in sizes.items())
    got = splits.closest_counts(sizes, [0.7, 0.3])
    assert all(sum(p.get(s, 0) for p in got) == n for s, n in sizes.items())
    items = [s for s, n in sizes.items() for _ in range(n)]
    best = min(abs(sum(c) - round(0.3 * total)) for k in range(len(items) + 1) for c in itertools.combinations(items, k))
    assert abs(sum(s * n for s, n in got[1].items()) - round(0.3 * total)) == best


@pytest.mark.parametrize("seed", range(6))
def test_closest_counts_of_many_records(seed):
    """Beyond the bitset, and with sizes of a long tail, the totals still meet the targets."""
    r = random.Random(seed)
    sizes = {1: 5_000_000} | {r.randint(2, 3_000_000): r.randint(1, 40) for _ in range(300)}
    total = sum(s * n for s, n in sizes.items())
    got = splits.closest_counts(sizes, [0.7, 0.15, 0.15], 1 << 16)
    assert all(sum(p.get(s, 0) for p in got) == n for s, n in sizes.items())
    for part in got[1:]:
        assert sum(s * n for s, n in part.items()) == int(0.15 * total + 0.5)
    few = {s * 1000: n for s, n in {7: 3, 11: 2, 400: 1, 950: 2}.items()}
    assert sum(p.get(7000, 0) for p in splits.closest_counts(few, [0.5, 0.5], 1 << 10)) == 3


# ---- tokens


@pytest.fixture(scope="module")
def encoder():
    return tokens.BacktrackingEncoder(tokens.vocabulary_file())


def test_encoder_against_the_library(encoder):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    r = random.Random(0)
    texts = [x for x in ODD if x] + ["".join(r.choices("abcdeéñ中😀 \n\t'0129.,-<|>", k=r.randint(1, 60))) for _ in range(2000)]
    assert [encoder.encode(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [encoder.decode(encoder.encode(x)) for x in texts] == texts
    assert encoder.encode(None) == encoder.encode("") == []


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "a", "的一是不了人我在有他这"])
def test_encoder_is_linear_in_a_piece(encoder, letters):
    r, took = random.Random(3), []
    for n in (40_000, 160_000):
        piece = "".join(r.choice(letters) for _ in range(n)).encode()
        began = time.perf_counter()
        assert b"".join(encoder.tokens[i] for i in encoder.encode_piece(piece)) == piece
        took.append(time.perf_counter() - began)
    assert took[1] < 4 * took[0] * 2 + 0.1  # four times the letters; quadratic would be sixteen times the time


def test_encode_table(spark):
    df = spark.createDataFrame([(1, "a b", "z"), (2, "", None), (3, None, None), (1, "a b", "z")], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in tokens.encode_table(df).collect())
    assert got == [(1, [64, 275]), (1, [64, 275]), (2, []), (3, [])]
    assert tokens.encode_table(df.limit(0)).count() == 0
    assert sorted(r["n_tokens"] for r in tokens.count_table(df).collect()) == [0, 0, 2, 2]


# ---- mixing


def test_mixing(spark, scratch, folder):
    docs, targets = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/mix_targets.parquet")
    mixed, report = mixing.mix(docs, targets, scratch, shards=3)
    m, r = mixed.toPandas(), report.toPandas().set_index("source")
    assert not m.duplicated(["doc_id", "copy"]).any() and set(m.shard) <= {0, 1, 2}
    assert (m.groupby("source").copy.max() <= r.max_repeats.loc[sorted(set(m.source))]).all()
    most = docs.where("text is not null").count()
    assert most and ((r.quota_tokens - r.mixed_tokens) >= -1e-6).all() and ((r.quota_tokens - r.mixed_tokens) < 1500).all()
    assert r.real_share.sum() == pytest.approx(1)


def test_mixing_edges(spark, scratch):
    docs = spark.createDataFrame([(1, "a b c", "s"), (2, None, "s"), (3, "", "s"), (4, "x", None), (1, "a b c", "s")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("s", 1.0, 2), ("gone", 0.5, 9), (None, 0.1, 1), ("null", None, None)], "source string, target_share double, max_repeats int")
    got = {r["source"]: r for r in mixing.mixture(mixing.sized(docs, scratch), targets).collect()}
    assert set(got) == {"s", "gone", "null"} and not got["s"]["capped"] and got["gone"]["capped"] and not got["null"]["capped"]
    mixed, report = mixing.mix(docs.limit(0), targets.limit(0), scratch)
    assert mixed.count() == 0 and report.count() == 0


def test_splitting_tree_deals_all_blocks():
    counts = np.array([5, 0, 130, 17])
    for shards in (1, 2, 3, 8):
        t = mixing._split(counts, shards, np.random.default_rng(0))
        assert t.shape == (shards, 4) and (t.sum(axis=0) == counts).all() and t.sum(axis=1).ptp() <= shards if hasattr(t, "ptp") else np.ptp(t.sum(axis=1)) <= shards


# ---- repetition


def test_runs_against_brute_force():
    r = random.Random(2)
    for text in [*ODD, *[" ".join(r.choices(["a", "B", "b", "c1"], k=r.randint(0, 60))) for _ in range(100)]]:
        w = [x.lower() for x in re.findall(r"[^\W_]+", text)]
        want = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        assert distinct_runs(*word_ids(text), 5) == (len(want), len(set(want)))
    ids = np.arange(20000) % 9973
    assert distinct_runs(ids, 9973, 5) == (19996, 9973)


def test_band_loses_no_repetitive_text():
    r, band = random.Random(4), repetition.TokenBand(tokens.vocabulary_file(), 5, 0.3)
    for k in range(400):
        words = [r.choice(["the", "Straße", "x1", "中文字", "refrigerator", "a", "42"][: r.randint(1, 7)]) if r.random() < 0.3 else f"w{r.randint(0, 50 + k)}" for _ in range(r.randint(0, 80))]
        if words and r.random() < 0.7:  # repeat a part, as often as it takes to come near the threshold
            lo = r.randrange(len(words))
            words += words[lo : lo + r.randint(1, 40)]
        words = [w.lower() for w in words]
        runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        share = 1 - len(set(runs)) / len(runs) if runs else 0
        assert share < 0.3 or band.inside(words)[0]


def test_repeated_shares(spark):
    texts = [*ODD, None, "one two three four five " * 40, " ".join(f"w{i}" for i in range(5000))]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, repeated int")
    got = {r["doc_id"]: r for r in repetition.repeated_shares(df).collect()}
    assert len(got) == len(texts) and got[len(ODD)]["repeated_share"] is None and not got[len(ODD)]["in_band"]
    assert got[len(ODD) + 1]["repeated_share"] > 0.9 and not got[len(ODD) + 2]["repeated_share"]
    assert repetition.repeated_shares(df.limit(0)).count() == 0


def test_measures(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None, "one two three four five " * 40])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in repetition.measure(df).collect()}
    assert len(got) == len(ODD) + 2 and got[len(ODD)]["repeated_share"] == 0.0 and got[len(ODD)]["chars_per_token"] is None
    assert got[len(ODD) + 1]["repeated_share"] > 0.9 and got[6]["script"] == "cjk"
    assert repetition.measure(df.limit(0)).count() == 0


# ---- near-duplicates


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    a = {int(k): int(v) for k, v in zip(rng.integers(0, 2**63, 60), rng.integers(1, 9, 60))}
    b = dict(list(a.items())[:40]) | {int(k): 2 for k in rng.integers(0, 2**63, 20)}
    b = {k: max(1, v - (i % 3)) for i, (k, v) in enumerate(b.items())}
    own = np.repeat([0, 1], [len(a), len(b)])
    sig = neardup.bag_signatures(own, np.array([*a, *b], dtype=np.uint64), np.array([*a.values(), *b.values()]), 2, 4096)
    keys = set(a) | set(b)
    true = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    assert np.isfinite(sig).all() and abs((sig[0] == sig[1]).mean() - true) < 0.035


def test_near_duplicates_against_all_pairs(spark, scratch):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(40):
        base = r.choices(vocab, k=r.randint(20, 60))
        for _ in range(r.randint(1, 4)):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = r.choice(vocab)
            texts.append(" ".join(w).upper() if r.random() < 0.3 else " ".join(w))
    texts += ["a b", "", None, *[texts[0]] * 5]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").withColumn("id", F.lit("clash"))

    def bag(t, n, counted):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        out = {}
        for k in range(len(w) - n + 1):
            out[tuple(w[k : k + n])] = out.get(tuple(w[k : k + n]), 0) + 1
        return out if counted else dict.fromkeys(out, 1)

    for counted in (False, True):
        bags = [bag(t, 3, counted) for t in texts]
        want = set()
        for i, j in itertools.combinations(range(len(texts)), 2):
            if bags[i] and bags[j]:
                both = sum(min(v, bags[j].get(k, 0)) for k, v in bags[i].items())
                if both / (sum(bags[i].values()) + sum(bags[j].values()) - both) >= 0.65:
                    want.add((i, j))
        found = neardup.NearDuplicates(df, scratch, "i", "t", 3, 0.65, counted=counted)
        assert {tuple(x) for x in found.pairs().collect()} == want
    groups = {x["id"]: x for x in found.groups().collect()}
    assert len(groups) == sum(1 for b in bags if b) and groups[len(texts) - 1]["rep"] == 0
    assert neardup.NearDuplicates(df.limit(0), scratch, "i", "t").pairs().count() == 0


def test_planted_bags_are_all_found(spark, scratch):
    """800 texts that repeat sentences 2 to 9 times, in families whose members repeat them more or less often: all links at a weighted similarity of 0.8 are found, and no other."""
    r, texts = random.Random(11), []
    for f in range(100):
        sentences = [" ".join(f"f{f}w{r.randint(0, 400)}" for _ in range(r.randint(8, 14))) for _ in range(6)]
        times = [r.randint(2, 9) for _ in sentences]
        for _ in range(8):
            mine = [max(0, n + r.choice([0, 0, 0, 0, 1, -1])) for n in times]
            texts.append((f, " ".join(s for s, n in zip(sentences, mine) for _ in range(n))))
    bags = []
    for _, t in texts:
        e, c = neardup.shingles(t, 5)
        bags.append(dict(zip(e.tolist(), c.tolist())))
    want, first = set(), {}
    for i, b in enumerate(bags):
        first.setdefault(tuple(sorted(b.items())), i)
    reps = sorted(first.values())
    for i, j in itertools.combinations(reps, 2):
        if texts[i][0] == texts[j][0]:
            both = sum(min(n, bags[j].get(k, 0)) for k, n in bags[i].items())
            if both / (sum(bags[i].values()) + sum(bags[j].values()) - both) >= 0.8:
                want.add((i, j))
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "id long, t string")
    found = neardup.NearDuplicates(df, scratch, "id", "t", counted=True)
    got = {(x["rep_a"], x["rep_b"]) for x in found.links.collect()}
    print(len(want), len(got & want))
    assert len(want) > 300 and got == want


# ---- places


@pytest.mark.parametrize(
    ("address", "number", "want"),
    [
        ("# 7A, 86 Gund St", None, ("86", "", "", "gund", "street")), ("1 River UNIT 2B", None, ("1", "", "", "river", "")), ("135 Sav Cir (rear)", None, ("135", "", "", "sav", "circle")),
        ("Hub  House, 45 Ste Kivton Ave", None, ("45", "saint", "", "kivton", "avenue")), ("Kerfot 151", None, ("151", "", "", "kerfot", "")), ("LANLEY LN, NO. 154, Boston, MA 00431", None, ("154", "", "", "lanley", "lane")),
        ("Five Chestnut Street", None, ("5", "", "", "chestnut", "street")), ("Vig Way Eight", None, ("8", "", "", "vig", "way")), ("40 Sid Pkwy S, Unit 7D, San Francisco", None, ("40", "", "south", "sid", "parkway")), ("W Pas Str 122 A, Boston", None, ("122a", "", "west", "pas", "street")),
        ("88 & 89 Vus Pl", None, ("88-89", "", "", "vus", "place")), ("87 Kam Road, 2nd floor", None, ("87", "", "", "kam", "road")), ("115 Sup Av - carriage house", None, ("115", "", "", "sup", "avenue")), ("SO DACK  PKWY", "0083.0", ("83", "", "south", "dack", "parkway")),
        ("ST BEFF STR", "83 84", ("83-84", "saint", "", "beff", "street")), ("108 No. Kond", None, ("108", "", "north", "kond", "")), ("REAR LOT", None, ("", "", "", "", "")), ("", "5", ("", "", "", "", "")), (None, None, ("", "", "", "", "")), ("Main St", None, ("", "", "", "", "")),
    ],
)
def test_addresses(address, number, want):
    p = AddressParser().parse(address, number)
    assert (p.number, p.head, p.side, p.name, p.kind) == want


def test_spelling_and_completion():
    assert [spelling_distance(*x) for x in (("abc", "abc"), ("abcd", "acbd"), ("abc", "abx"), ("abcd", "badc"), ("", "ab"), ("abc", "xyz"))] == [0, 1, 1, 2, 2, 3]
    assert complete([("", "", "lane"), ("", "north", "lane"), ("", "", "")]) == [("", "north", "lane")] * 3
    assert complete([("", "", "lane"), ("", "", "street"), ("", "", "")])[2] == ("", "", "")


def test_places(spark, scratch):
    rows = [
        (1, "12", "OAKTREE ST", "443", "boston"), (2, None, "12 oaktree street apt 3, Boston", "00443", "Boston"), (3, None, "Oaktere, No. 12", "00443-1111", "Boston"), (4, None, "12A Oaktree St", "00443", "Boston"), (5, None, "12 Oaktree St", None, "Boston"),
        (6, None, "12 Oaktree St", "00444", "Boston"), (7, None, "12 Elmwood Ln", "00444", "Boston"), (8, None, "12 Elmwood", None, "Boston"), (9, None, "12 Elmwood Ct", "00444", "Boston"), (10, None, None, "00444", "Boston"), (11, None, "PRIVATE WAY", "00444", "Boston"), (12, None, "12 Elmwood Ln", "00444", "Boston"),
    ]
    df = spark.createDataFrame(rows, "id long, number string, address string, zip string, city string").withColumn("place", F.lit("clash"))
    pairs = {tuple(r) for r in places.same_place_pairs(places.place_of(df, scratch)).collect()}
    assert pairs == {(1, 2), (1, 3), (2, 3), (7, 12)}
    assert places.place_of(df.limit(0), scratch).count() == 0


# ---- personal data


@pytest.fixture(scope="module")
def tagger():
    return pii.Tagger.trained("Aisha Carmen Celeste Colin Devon Elspeth Felix Fiona Greta Hana Ingrid Jonas Katya Lucia Marta Nadia Odile Pavel Priya Ravi Sabine Tobias Vera Xavier Yuki Zelda".split())


def accuracy(tagger, held) -> tuple[float, float]:
    hit = found = true = 0
    for (text, spans), got in zip(held, tagger.spans([t for t, _ in held])):
        a, b = ({(lo, hi - (text[hi - 1] == "."), k) for lo, hi, k in s} for s in (spans, got))
        hit, found, true = hit + len(a & b), found + len(b), true + len(a)
    return hit / found, hit / true


def test_accuracy_on_patterns_no_training_row_has():
    """Trained with every other pattern, tested on the others."""
    some = labelled_texts(["Carmen", "Omar", "Felix", "Ada"], 1500, 5, WITH[::2], WITHOUT[::2])
    held = labelled_texts(["Piotr", "Nadia"], 300, 77, WITH[1::2], WITHOUT[1::2], made=0.0)
    precision, recall = accuracy(pii.Tagger.trained(["Carmen", "Omar", "Felix", "Ada", "Piotr", "Nadia"], texts=some), held)
    print(precision, recall)
    assert precision > 0.9 and recall > 0.9


def test_training_sentences_are_not_in_the_tagged_texts(spark, folder):
    """Neither a whole pattern, whatever stands in its places, nor a run of four of its words."""
    texts = [r[0].lower() for r in spark.read.parquet(f"{folder}/listings.parquet").where("description is not null").select("description").collect()]
    every = "\n".join(texts)
    for pattern in {*WITH, *WITHOUT}:
        literal = [re.findall(r"[a-z]+", part) for part in re.split(r"\{\w+\}", pattern.lower())]
        for words in literal:
            for i in range(len(words) - 3):
                run = words[i : i + 4]
                assert not re.search(r"(?<![a-z])" + "[^a-z]+".join(run) + r"(?![a-z])", every), pattern
        if sum(map(len, literal)) > 2:
            assert not re.search(r"(?:^|[.!?\n-] *)" + re.sub(r"\\\{\w+\\\}", r"[^.\\n;:,]{1,30}", re.escape(pattern.lower())) + r"(?:$| |\n)", every), pattern


def test_items(tagger):
    text = "The spare set is with Mr. Orlan, 12 Fort Bramwick Rd.. Weekdays +1 (617) 555-0101 ext. 4, weekends 555-0199. Docket 2082-557-0132 is closed. Notes go to anna.b @ mail.invalid by Friday. Lessee: Vole, Carmen, SSN: 900112222."
    got = [(text[a:b], k) for a, b, k in tagger.spans([text])[0]]
    assert got == [("Orlan", "person_name"), ("12 Fort Bramwick Rd.", "street_address"), ("+1 (617) 555-0101 ext. 4", "phone"), ("555-0199", "phone"), ("anna.b @ mail.invalid", "email"), ("Vole, Carmen", "person_name"), ("900112222", "id_number")]


def test_redaction(spark, tagger):
    rows = [(1, "Call Felix Moran at 617-555-0100 for a visit."), (2, None), (3, ""), (4, "x " * 5000), (1, "Call Felix Moran at 617-555-0100 for a visit.")]
    df = spark.createDataFrame(rows, "id long, description string").withColumn("kind", F.lit("clash"))
    got = pii.redact(df, tagger, "description").orderBy("id").collect()
    assert [r["redacted"] for r in got] == ["Call [PERSON_NAME] at [PHONE] for a visit."] * 2 + [None, "", "x " * 5000]
    assert pii.find(df, tagger, "id", "description").count() == 4 and pii.find(df.limit(0), tagger, "id", "description").count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    chain = Chain(np.zeros((1, 9, 3), np.float32), rng.normal(size=(3, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32))
    e = rng.normal(size=(2, 5, 3)).astype(np.float32)
    got = chain.viterbi(e, np.array([5, 3]))
    for row, n in ((0, 5), (1, 3)):
        best = max(itertools.product(range(3), repeat=n), key=lambda p: chain.first[p[0]] + sum(e[row, t, x] for t, x in enumerate(p)) + sum(chain.steps[a, b] for a, b in zip(p, p[1:])))
        assert tuple(got[row, :n]) == best
