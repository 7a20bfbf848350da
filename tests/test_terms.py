"""Terms by one automaton against the regular expressions of single terms, and names that nobody knows."""

import random

import pytest
from pyspark.sql import functions as F

from agroloom.functions import text as T
from agroloom.operators import terms

TEXTS = ["the rate is", "irate", "rate_x rate", "गेहूं की फसल", "अगेहूं", "Café CAFÉ", None, "", "pink  bollworm!", "ਰੰਗ ਰਂਗ", "wheat9 wheat-9", "ratewheat"]
TERMS = ["rate", "wheat", "गेहूं", "café", "café", "pink  bollworm", "ਰੰਗ", "", "9", "e", None]


@pytest.mark.parametrize("mode", ["stem", "name"])
@pytest.mark.parametrize("share", [1 << 20, 8])
def test_found_as_by_single_patterns(spark, mode, share):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    got = {(r.id, r.term) for r in terms.found_terms(texts, spark.createDataFrame([(t,) for t in TERMS], "term string"), mode, lexicon_bytes=share).collect()}
    want = set()
    for t in filter(None, TERMS):
        want |= {(r.id, t) for r in texts.withColumn("text", T.nfc("text")).filter(T.contains_term(F.col("text"), t, mode)).collect()}
    assert got == want and (0, "rate") in got and (1, "rate") not in got


def test_both_spellings_of_a_nasal(spark):
    texts = spark.createDataFrame([(1, "ਰਂਗ"), (2, "ਰੰਗ")], "id long, text string")
    asked = spark.createDataFrame([("ਰੰਗ",)], "term string")
    assert [sorted(r.id for r in terms.found_terms(texts, asked, fold=f).collect()) for f in (False, True)] == [[2], [1, 2]]


def test_ten_thousand_terms(spark):
    r = random.Random(1)
    words = sorted({"".join(r.choices("abcdef", k=r.randint(3, 7))) for _ in range(14_000)})
    texts = [(i, " ".join(r.choices(words, k=30)) + " " + r.choice(words) + "x") for i in range(60)]
    lexicon = words[::2] + [w for w in words[1::2] if len(w) > 5]
    assert len(lexicon) > 5_000
    got = {(x.id, x.term) for x in terms.found_terms(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(w,) for w in lexicon], "term string")).collect()}
    assert got == {(i, w) for i, t in texts for w in set(t.split()) & set(lexicon)}


def test_whole_words_are_held_as_words_not_as_an_automaton():
    """100,000 words take a set; only terms that may lie inside words, or hold more than one, take an automaton."""
    held = terms.Held([f"word{i}" for i in range(100_000)] + ["pink  bollworm", "गेहूं", "Rate"], "stem", False)
    assert len(held.automaton) == 2 and len(held.words) == 100_001
    assert held.found("word7 xword8 word9x rate pink  bollworm अगेहूं") == {"word7", "Rate", "pink  bollworm", "गेहूं"}
    assert len(terms.Held(["wheat", "rust"], "part", False).automaton) == 2


def test_unknown_names(spark):
    chunks = spark.createDataFrame([("Cotton", "Leaf Curl Virus and Para wilt"), ("Wheat", "yellow rust"), (None, "loose smut")], "crop string, text string")
    asked = [(1, "cotton", "parawilt", "parawilt"), (2, "cotton", "golden wilt", "golden wilt"), (3, "wheat", "stripe rust", "stripe rust"), (3, "wheat", "yellow  rust", "rust"), (4, "wheat", "leaf curl virus", "curl virus"), (5, None, "cotton leaf curl virus", "curl virus"), (6, None, "blue rot", "blue rot"), (6, None, "ash rot", "ash rot")]
    got = {r.item_id: r.unknown for r in terms.unknown_names(spark.createDataFrame(asked, "item_id long, crop string, name string, short string"), chunks).collect()}
    assert got == {1: [], 2: ["golden wilt"], 3: [], 4: ["leaf curl virus"], 5: [], 6: ["ash rot", "blue rot"]}
