"""Quantiles by selection, claims by buckets, amounts and percentages: each against brute force or the stated rule."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from agroloom.functions import numbers as N
from agroloom.operators import claims, reports


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("r")).first().r


@pytest.mark.parametrize(
    ("text", "amounts"),
    [
        ("apply 3.5.2 kg", ["2 kg"]),
        ("10 - 20 - 30 g", ["30 g"]),
        ("5 to 6 to 7 days", ["7 day"]),
        ("80-125 g or 30-day, 5 kilometres", ["125 g", "30 day", "80 g"]),
        ("in 3 weeks, 2 l", ["2 l", "3 week"]),
    ],
)
def test_amounts(spark, text, amounts):
    assert one(spark, N.amounts_in(F.col("t")), text) == amounts


def test_unitless_ranges_back_no_amount(spark):
    rows = spark.createDataFrame([("10 - 20 - 30 g", "10 20 30 g")], "a string, s string")
    assert N.with_unbacked(rows, "a", "s").first().unbacked == []


@pytest.mark.parametrize(("hits", "of", "said"), [(1, 8, "1/8 (12%)"), (3, 8, "3/8 (38%)"), (1, 200, "1/200 (0%)"), (1, 3, "1/3 (33%)")])
def test_halves_go_to_the_even_per_cent(spark, hits, of, said):
    assert spark.range(of).agg(reports.hits(F.col("id") < hits).alias("h")).first().h == said


def test_selection(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice([1.0, 1.0, 7.5, None, r.random() * 100])) for _ in range(900)] + [("one", 3.0), ("none", None)] + [("same", 2.0)] * 50
    frame = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = reports.nth_values(frame, "g", "v", {"least": lambda n: n * 0, "mid": lambda n: F.floor(n / 2), "p95": reports.place_of(0.95, "floor"), "other": reports.place_of(0.95, "count")}).collect()
    by = {}
    for g, v in rows:
        if v is not None:
            by.setdefault(g, []).append(v)
    want = {}
    for g, vs in by.items():
        vs, n = sorted(vs), len(vs)
        want[g] = (vs[0], vs[n // 2], vs[95 * (n - 1) // 100], vs[max(95 * n // 100 - 1, 0)])
    assert {x.g: (x.least, x.mid, x.p95, x.other) for x in got} == want
    assert reports.exact_quantile(frame.limit(0), "g", "v", 0.95, "floor").count() == 0


def test_claims_by_buckets(spark):
    r = random.Random(3)
    periods = ["month", "year", "quintal", None]
    money = lambda: r.choice([100.0, 100.4, 100.5, 99.6, 1200.0, 1200.3, 1199.5, 8.33])
    facts = [(r.randrange(6), money(), r.choice(periods)) for _ in range(25)]
    asked = [(i, r.randrange(8), money(), r.choice(periods)) for i in range(200)] + [(900, None, 5.0, None), (901, 1, None, "year")]
    got = claims.against_facts(spark.createDataFrame(asked, "i long, k long, rupees double, period string"), spark.createDataFrame(facts, "k long, rupees double, period string"), "k").collect()
    per = {"month": 12, "year": 1}
    exact = lambda v: Fraction(str(v))

    def compared(a, p, b, q):
        if p == q or p is None or q is None:
            return abs(exact(a) - exact(b)) < Fraction(1, 2)
        return abs(exact(a) * per[p] - exact(b) * per[q]) < Fraction(1, 2) if p in per and q in per else None

    edge = 0
    for x in got:
        mine = [(b, q) for k, b, q in facts if k == x.k]
        if x.rupees is None:
            continue
        found = [compared(x.rupees, x.period, b, q) for b, q in mine]
        near = any(f is not None and abs(abs(x.rupees * per.get(x.period, 1) - b * per.get(q, 1)) - 0.5) < 1e-9 for f, (b, q) in zip(found, mine, strict=True))
        edge += near  # half a rupee apart, up to rounding: either answer is right
        assert near or x.same == any(f for f in found if f is not None)
        assert x.comparable == any(f is not None for f in found)
        assert (x.lowest, x.highest) == (min((b for b, _ in mine), default=None), max((b for b, _ in mine), default=None))
    assert len(got) == len(asked) and any(x.same for x in got) and edge < 100
