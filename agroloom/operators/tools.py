"""Look-ups behind an answer: places and states, market prices with fall-backs, sections of official schemes."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agroloom.functions.lexicon import Entries, any_term, first_match
from agroloom.functions.numbers import longest_first
from agroloom.functions.text import NO_WORD_AFTER, NO_WORD_BEFORE, letters_only

PLACES: Entries = (("Ludhiana", ("ludhiana", "ਲੁਧਿਆਣਾ")), ("Sangrur", ("sangrur", "ਸੰਗਰੂਰ")), ("Karnal", ("karnal", "करनाल")), ("Delhi", ("delhi", "दिल्ली")))
STATES: Entries = (("Punjab", ("punjab", "पंजाब", "ਪੰਜਾਬ")), ("Haryana", ("haryana", "हरियाणा")), ("Uttar Pradesh", ("uttar pradesh", "उत्तर प्रदेश")), ("Madhya Pradesh", ("madhya pradesh", "मध्य प्रदेश")))
#: Short codes that are states only after in, at or for.
STATE_CODES = (("up", "Uttar Pradesh"), ("mp", "Madhya Pradesh"))
#: Words before and after a place, and words that stand there without being one; crop words come on top. Parameters, with a
#: vocabulary of our own.
BEFORE_PLACE, AFTER_PLACE = ("in", "at", "for", "near"), ("mein", "vich", "me", "main", "ch", "ka", "ke", "ki", "da")
NOT_PLACES = (
    "this", "that", "the", "my", "our", "your", "one", "today", "tomorrow", "week", "month", "year", "season", "now", "here", "there", "aaj", "kal", "yahan",
    "field", "fields", "farm", "farms", "soil", "khet", "zameen", "village", "gaon", "area", "country", "india", "crop", "crops", "fasal", "seed", "plant", "plants", "leaf", "leaves",
    "rain", "barish", "weather", "mausam", "spray", "water", "pani", "price", "prices", "rate", "rates", "bhav", "mandi", "market", "msp", "dam",
)
#: Another source's spelling of four districts.
SPELLINGS = {"bathinda": "bhatinda", "firozpur": "ferozpur", "fatehgarhsahib": "fatehgarh", "rupnagar": "ropar"}


def crop_words(crops: Entries) -> tuple[str, ...]:
    """All ASCII words of crop names."""
    return tuple(sorted({w for _, terms in crops for t in terms if t.isascii() for w in t.lower().split()}))


def state_named(text: Column, states: Entries = STATES) -> Column:
    """The state that a whole place name stands for: an alias or code alone, or an alias of another script inside."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"^[ ?.!,]+|[ ?.!,]+$", "")
    codes = {name: code for code, name in STATE_CODES}

    def is_state(name: str, terms: tuple[str, ...]) -> Column:
        out = clean.isin(*(unicodedata.normalize("NFC", t) for t in terms), *([codes[name]] if name in codes else []))
        for t in terms:
            out = out if t.isascii() else out | F.contains(clean, F.lit(t))
        return out

    return F.coalesce(*(F.when(is_state(n, terms), F.lit(n)) for n, terms in states), F.lit(None).cast("string"))


def place_candidates(text: Column, not_places: tuple[str, ...], before: tuple[str, ...] = BEFORE_PLACE, after: tuple[str, ...] = AFTER_PLACE) -> Column:
    """One or two words behind one of ``before``, then single words in front of one of ``after``; none of ``not_places``."""
    name, clean = "[a-z]{3,}", F.lower(text)
    leads, ends = longest_first(before), longest_first(after)
    forms = (rf"(?:{leads})\s+({name}(?:\s+{name})?)", rf"({name})\s+(?:{ends})")
    found = F.concat(*(F.regexp_extract_all(clean, F.lit(NO_WORD_BEFORE + form + NO_WORD_AFTER), 1) for form in forms))
    real = F.transform(found, lambda m: F.array_join(F.filter(F.split(m, r"\s+"), lambda w: ~w.isin(*not_places)), " "))
    return F.array_distinct(F.filter(real, lambda m: m != ""))


def detect_place(text: Column, places: Entries = PLACES, states: Entries = STATES, not_places: tuple[str, ...] = NOT_PLACES) -> Column:
    """Best guess: a known place, else a state anywhere in the text, else the first candidate, in title case."""
    code = F.regexp_extract(F.lower(text), rf"{NO_WORD_BEFORE}(?:in|at|for)\s+({longest_first(c for c, _ in STATE_CODES)}){NO_WORD_AFTER}", 1)
    by_code = F.coalesce(*(F.when(code == c, F.lit(n)) for c, n in STATE_CODES))
    return F.coalesce(first_match(text, places, "name"), by_code, first_match(text, states, "name"), F.initcap(F.try_element_at(place_candidates(text, not_places), F.lit(1))))


def same_place(ours: Column, theirs: Column) -> Column:
    """Whether two spellings name one place: equal letters, one the beginning of the other, or ours inside theirs."""
    a, b = letters_only(ours), letters_only(theirs)
    a = F.coalesce(*(F.when(a == k, F.lit(v)) for k, v in SPELLINGS.items()), a)
    return b.startswith(a) | a.startswith(b) | F.contains(b, a)


def with_state(asked: DataFrame, place_states: DataFrame, gazetteer: DataFrame, place: str = "district") -> DataFrame:
    """``asked`` with the state of its place: the built-in table (place, state) first, then a gazetteer (name, state) by
    equal name; null where neither knows it. A name that several rows of a table share gets the smallest state."""
    key = F.lower(F.trim(F.col(place)))
    one = lambda t, name, out: t.groupBy(F.lower(F.trim(F.col(name))).alias("_k")).agg(F.min("state").alias(out))
    rows = asked.withColumn("_k", key).join(one(place_states, "place", "_own"), "_k", "left").join(one(gazetteer, "name", "_far"), "_k", "left")
    return rows.withColumn("state", F.coalesce("_own", "_far")).drop("_k", "_own", "_far")


PRICE = ("market", "district", "day", "low", "high", "modal")


def newest(prices: DataFrame, by: list[str], most: int = 5) -> DataFrame:
    """Per key: ``prices`` of its newest day, at most ``most`` in order of market and district, as an array."""
    last = prices.groupBy(*by).agg(F.max("day").alias("day"))
    today = prices.join(last, [*by, "day"])
    order = Window.partitionBy(*by).orderBy("market", "district", "modal")
    top = today.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most)
    return top.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_n", *PRICE))).alias("prices"))


def lookup(asked: DataFrame, prices: DataFrame, name: str) -> DataFrame:
    """``asked`` (id, commodity, state, district) with prices, local and source: the rows of the district, else of the
    whole state; prices without a number are left out, null where there are none."""
    known = prices.filter(F.col("modal").isNotNull())
    near = newest(known, ["commodity", "state", "district_key"]).withColumnRenamed("prices", "_near")
    wide = newest(known, ["commodity", "state"]).withColumnRenamed("prices", "_wide")
    rows = asked.withColumn("district_key", F.lower("district")).join(near, ["commodity", "state", "district_key"], "left").join(wide, ["commodity", "state"], "left")
    found = F.coalesce("_near", "_wide")
    return rows.select("id", "commodity", "state", "district", found.alias("prices"), F.col("_near").isNotNull().alias("local"), F.when(found.isNotNull(), F.lit(name)).alias("source"))


def first_source(asked: DataFrame, sources: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Each question's prices from the first source (name, prices, error) that has any; else all errors, joined."""
    out = None
    for i, (name, prices, error) in enumerate(sources):
        part = lookup(asked, prices, name).withColumn("_i", F.lit(i)).withColumn("_error", F.lit(error))
        out = part if out is None else out.unionByName(part)
    got = F.struct("prices", "local", "source")
    errors = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_error"))), lambda e: e["_error"]), "; ")
    best = out.groupBy("id", "commodity", "state", "district").agg(F.min_by(F.when(F.col("prices").isNotNull(), got), F.when(F.col("prices").isNotNull(), F.col("_i"))).alias("b"), errors.alias("errors"))
    no_place = F.col("state").isNull()
    error = F.when(no_place, "no place given").when(F.col("b").isNull(), F.col("errors"))
    return best.select("id", "commodity", "state", "district", F.col("b.prices").alias("prices"), F.coalesce("b.local", F.lit(False)).alias("local"), F.col("b.source").alias("source"), error.alias("error"))


def average_days(records: DataFrame, price: tuple[str, ...], title: tuple[str, ...]) -> DataFrame:
    """Rows (…, day, modal) of wide records: each price column has its date, "29 Sep, 2026", in a title column. Columns
    without a price or with a title that is no date give no row."""
    pairs = F.array(*(F.struct(F.to_date(F.try_to_timestamp(F.col(t), F.lit("d MMM, yyyy"))).alias("day"), F.col(p).cast("double").alias("modal")) for p, t in zip(price, title, strict=True)))
    rest = [c for c in records.columns if c not in (*price, *title)]
    return records.select(*rest, F.explode(pairs).alias("p")).select(*rest, "p.day", "p.modal").filter("day IS NOT NULL AND modal IS NOT NULL")


def scheme_sections(questions: DataFrame, sections: DataFrame, defaults: tuple[str, ...], always: tuple[str, ...], text: str = "text", most: int = 3) -> DataFrame:
    """(id, ids, matched): for each question (id, text) the sections whose keywords it names, most matches first, ties in
    file order, three at most; the default ones if it names none; sections that every answer needs go in front.

    ``sections`` (section, ord, keywords) is a scheme's file: its few rows become one expression, no join.
    """
    listed = sections.orderBy("ord").collect()  # the rows of one official file
    hits = [F.struct(sum((any_term(F.lower(F.col(text)), (k,)).cast("int") for k in r.keywords), F.lit(0)).alias("n"), F.lit(-r.ord).alias("ord"), F.lit(r.section).alias("section")) for r in listed]
    named = F.slice(F.reverse(F.array_sort(F.filter(F.array(*hits), lambda h: h["n"] > 0))), 1, most)
    chosen = F.when(F.size(named) > 0, F.transform(named, lambda h: h["section"])).otherwise(F.array(*map(F.lit, defaults)))
    front = F.array_except(F.array(*map(F.lit, always)).cast("array<string>"), chosen)
    return questions.select("id", F.concat(front, chosen).alias("ids"), (F.size(named) > 0).alias("matched"))
