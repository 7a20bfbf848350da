"""Operators of the engine on small tables, and every registered query against its SQL."""

import json
import os
import random
import time

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from agroloom.functions import lexicon as L
from agroloom.functions import numbers as N
from agroloom.functions.lexicon import Lexicon
from agroloom.functions import text as T
from agroloom.operators import chunking, claims, dialog, logs, reports, review, rules, tools
from agroloom.operators import retrieval as R
from agroloom.operators.index import build
from agroloom.plans import catalog
from agroloom.plans import retrieval_queries as queries_of_retry
from agroloom.sources import readers, sinks
from agroloom.streaming import streams

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column, **values):
    names = list(values) or ["x"]
    row = tuple(values.values()) or (1,)
    return spark.createDataFrame([row], ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long'}" for n, v in zip(names, row))).select(column.alias("r")).first().r


@pytest.mark.parametrize(("text", "term", "mode", "found"), [("the rate is", "rate", "stem", True), ("irate", "rate", "stem", False), ("हिrate", "rate", "stem", True), ("गेहूं की", "गेहूं", "name", True), ("अगेहूं", "गेहूं", "name", False), ("अगेहूं", "गेहूं", "stem", True), ("x", "", "stem", False)])
def test_terms(spark, text, term, mode, found):
    assert one(spark, T.contains_term(F.col("t"), term, mode), t=text) is found


def test_tokens_and_stems(spark):
    assert one(spark, T.search_tokens(F.col("t")), t="A big-bad  Wolf’s é $5 co‍op") == ["big", "bad", "wolf", "co", "op"]
    assert [one(spark, T.stem(F.col("t")), t=w) for w in ("berries", "glass", "spraying", "king")] == ["berry", "gla", "spray", "king"]
    assert one(spark, T.clean_query(F.col("t")), t=" - how  now ? ? ?") == "how now?"
    assert one(spark, T.evidence_sentences(F.col("t")), t="* One two three four. Short one.\nOne two three four.") == ["One two three four."]
    assert one(spark, T.for_speech(F.col("t")), t="## Use *this* [link](http://x.y) http://a.b now") == "Use this link now"


def model_windows(text, header, size, overlap):
    room = size - len(header) if size - len(header) >= 100 else size
    held = [s.strip() for s in text.split(". ")]
    held = [s if s.endswith(".") else s + "." for s in held if s]
    out, cur, fresh = [], [], False
    for s in held:
        if fresh and len(" ".join([*cur, s])) > room:
            out.append(header + " ".join(cur))
            tail = []
            for k in range(1, len(cur) + 1):
                if overlap and len(" ".join(cur[-k:])) <= overlap:
                    tail = cur[-k:]
            if not tail and overlap:
                w = cur[-1].split()
                while w and len(" ".join(w)) > overlap:
                    w = w[1:]
                tail = [" ".join(w)] if w else []
            cur, fresh = tail, False
        cur.append(s)
        fresh = True
    return out + ([header + " ".join(cur)] if fresh else [])


@pytest.mark.parametrize(("size", "overlap"), [(120, 30), (200, 0), (150, 149), (400, 90)])
def test_chunk_windows(spark, size, overlap):
    text = ". ".join(f"sentence {i} " + "word " * (i * 7 % 23) for i in range(30))
    got = one(spark, chunking.windows(F.col("t"), F.lit("[h] "), size, overlap), t=text)
    assert got == model_windows(text, "[h] ", size, overlap)


@pytest.mark.parametrize("overlap", [0, 12, 40])
def test_windows_of_random_sentences(overlap):
    r = random.Random(overlap)
    for _ in range(200):
        held = [" ".join(chr(97 + r.randrange(26)) * r.randint(1, 9) for _ in range(r.randint(1, 12))) + "." for _ in range(r.randint(0, 25))]
        assert ["[h] " + w for w in chunking.windows_of(held, 110, overlap)] == model_windows(" ".join(held), "[h] ", 114, overlap)


def test_windows_of_a_very_long_section():
    held = ["word " * 9 + "end."] * 1_000_000  # 50 MB
    began = time.time()
    assert len(chunking.windows_of(held, 1000, 150)) > 50_000 and time.time() - began < 30




def test_chunk_sizes_and_documents(spark, tmp_path):
    with pytest.raises(ValueError, match="overlap"):
        chunking.check_sizes(100, 100)
    (tmp_path / "a.json").write_text(json.dumps({"document_title": "Rust", "sections": [{"section_title": "One", "symptoms": "N/A", "recommended_action": "Spray.", "critical_safety_warning": "Gloves"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"kind": "pau_package_of_practices", "document_title": "Book", "sections": [{"section_title": "E", "pau_text": ""}, {"section_title": "F", "pau_text": "Sow early.", "pages": "3-4"}]}))
    rows = {r.chunk_id: r for r in chunking.chunk_documents(readers.json_documents(spark, str(tmp_path))).collect()}
    assert set(rows) == {"a_s0_c0", "b_s1_c0"}
    assert rows["a_s0_c0"].text == "Crop: General Agriculture (All season)\nSource: ICAR\nTopic: One\nRecommended action: Spray.\nWarning: Gloves" and rows["a_s0_c0"].has_warning
    assert rows["b_s1_c0"].text == "Crop: General Agriculture (All season)\nTopic: F\nAdvice: Sow early." and rows["b_s1_c0"].reference == "Book, pages 3-4"
    long = chunking.chunk_documents(readers.json_documents(spark, str(tmp_path)), 120, 0).filter("doc_id = 'b'").first()
    assert long.text == rows["b_s1_c0"].text
    (tmp_path / "c.json").write_text(json.dumps({"sections": [{"section_title": "One", "symptoms": "Later file."}]}))
    held = {r.section: r.symptoms for r in readers.original_sections(readers.json_documents(spark, str(tmp_path))).collect()}
    assert held["One"] == "Later file." and held["E"] is None


def test_fusion_arithmetic(spark):
    a = spark.createDataFrame([(1, "x", 1, 0.0), (1, "y", 2, 0.0)], "item_id int, key string, rank int, score double")
    b = spark.createDataFrame([(1, "y", 1, 0.0), (1, "z", 2, 0.0)], "item_id int, key string, rank int, score double")
    rows = R.fuse([a, b], "key").orderBy("rank").collect()
    assert [r.key for r in rows] == ["y", "x", "z"] and rows[0].score == round(1 / 62 + 1 / 61, 6) and rows[0].rank_0 == 2
    assert R.fuse([a.limit(0), b.limit(0)], "key").count() == 0


def test_bm25_repeats_and_no_match(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma gamma"), (3, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "gamma gamma"), (2, "nothing")], "item_id long, text string")
    twice, once = (R.bm25(docs, q, repeats=r).collect() for r in (True, False))
    assert len(twice) == 1 and twice[0].doc_id == 2 and abs(twice[0].score - 2 * once[0].score) < 1e-5


def test_unsure_queries_are_searched_again(spark, tmp_path):
    docs = spark.createDataFrame([(1, "sand sand sand stone stone river"), (2, "sand stone cloud zebra quill"), (3, "sand river"), (4, "stone river"), (5, None)], "doc_id long, text string").withColumn("source", F.concat(F.lit("s"), "doc_id")).withColumn("lang", F.lit("en"))
    asked = spark.createDataFrame([(1, "sand sand sand stone stone stone river zebra quill"), (2, "zebra"), (3, "unheard of"), (4, "zebra quill "), (5, None)], "item_id long, text string")
    lex = Lexicon(crops=(("Cloud", ("river",)),), pests=(("S1", ("river",)),), pest_crops=(("S1", ("Cloud",)),), topics=(("stripes", ("zebra",)),), topic_titles=(("stripes", "quill"),), english=())
    index = build(docs, str(tmp_path / "ix"))
    crops = asked.withColumn("crop", F.when(F.col("item_id") == 1, "Cloud"))
    again = {r.item_id: r.text for r in queries_of_retry.retry_queries(crops, lex).collect()}
    assert again == {1: "Cloud zebra quill", 2: "zebra quill"}
    first = {r.item_id: (r.doc_id, r.rank_0, r.rank_1) for r in queries_of_retry.hybrid_of(index, queries_of_retry.section_of(docs), asked).filter("rank = 1").collect()}
    got = {r.item_id: (r.doc_id, r.status) for r in queries_of_retry.corrective(docs, asked, index, lex).collect()}
    assert first[1][0] == 1 and first[1][1:] != (1, 1)
    assert got[1] == (2, "corrected")
    titled = Lexicon(crops=(("en", ("river",)),), pests=(("S1", ("sand",)),), pest_crops=(("S1", ("en",)),), topics=lex.topics)
    got = {r.item_id: (r.doc_id, r.status) for r in queries_of_retry.corrective(docs, asked, index, titled).collect()}
    assert got[1] == (1, "confident")  # its section "s1/en" is titled for what the question names


def test_index_round_trip(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "alpha beta"), ("c2", "beta gamma")], "chunk_id string, text string")
    sinks.save_index(chunks, str(tmp_path / "ix"))
    held, index = sinks.load_index(spark, str(tmp_path / "ix"))
    assert index.table("postings").agg(F.sum("n")).first()[0] == 4 and not sinks.is_stale(held, chunks)
    assert sinks.is_stale(held, chunks.withColumn("text", F.upper("text")))
    with pytest.raises(ValueError, match="dimensions"):
        sinks.load_index(spark, str(tmp_path / "ix"), 768)
    embed = lambda rows: rows.select("key", F.lit(1.0).alias("v"))
    assert [sinks.grow_cache(chunks, embed, str(tmp_path / "cache"), spark).count() for _ in range(2)] == [2, 2]


def test_numbers(spark):
    assert one(spark, N.numbers_in(F.col("t")), t="1. Manual\nuse 2,000 or 1,00,000 in the second week, 01.50") == ["1.5", "100000", "2", "2000"]
    assert one(spark, N.amounts_in(F.col("t")), t="80-125 liters and 400 gm for 30-day") == ["125 l", "30 day", "400 g", "80 l"]
    unbacked = lambda a, s: N.with_unbacked(spark.createDataFrame([(a, s)], "a string, s string"), "a", "s").first().unbacked
    assert unbacked("400 ml twice in 7 days", "400 g for seven or 7 days") == ["400 ml"]
    assert unbacked("wait 6 weeks, 1.0 litre", "after six weeks 1 l") == [] and unbacked("२,००० and 5%", "2000 rupees and 5 per cent") == []
    money = one(spark, N.money_facts(F.col("t")), t="Rs 2 lakh per year. Then Rs 500 a month. Rs 12,000 per month! 12000 rupees every year? हर महीने 300 रुपये")
    assert [(m.rupees, m.period) for m in money] == [(200000.0, "year"), (500.0, "month"), (12000.0, "month"), (12000.0, "year"), (300.0, "month")]
    assert [m.words for m in money][2:4] == ["Rs 12,000 per month", "12000 rupees every year"]
    assert one(spark, N.same_money(F.lit(100.0), F.lit("month"), F.lit(1200.0), F.lit("year"))) is True
    assert one(spark, N.same_money(F.lit(100.0), F.lit("month"), F.lit(100.0), F.lit("quintal"))) is None
    assert [one(spark, N.readable(F.col("v")), v=v) for v in (5.44, 13.6, 2720.0, 10.0)] == ["5.44", "13.6", "2,720", "10"]
    scaled = lambda t, acres: one(spark, N.scale_doses(F.col("t"), F.lit(acres)), t=t).split("\n\n_Totals")[0]
    assert scaled("Use 400 g per acre.\nWait 3 kg here.", 2.0) == "Use 400 g per acre (800 g for your 2 acres).\nWait 3 kg here."
    assert scaled("Mix 200-300 g of 25 WG in 100 to 150 litres per acre.", 4.0) == "Mix 200-300 g (0.8-1.2 kg for your 4 acres) of 25 WG in 100 to 150 litres per acre (400-600 litres for your 4 acres)."
    assert scaled("प्रति एकड़ 80 ग्राम", 34.0) == "प्रति एकड़ 80 ग्राम (2.72 kg for your 34 acres)" and scaled("400 g per acre", 0.0) == "400 g per acre"


@pytest.mark.parametrize(
    ("question", "intent"),
    [("hello", "greeting"), ("pm-kisan money", "scheme_query"), ("msp of maize", "market_price"), ("seed rate of wheat", "general_agriculture"), ("who won cricket", "out_of_scope"), ("can I spray today", "weather"), ("spray again today?", "general_agriculture"), ("is phorate ok", "safety_query"), ("banana leaves", "crop_not_covered"), ("weeds in field", "topic_not_covered"), ("aphid in cotton", "topic_not_covered"), ("aphid in wheat", "crop_question"), ("wheat ilaj", "crop_question"), ("urea", "general_agriculture"), ("", "general_agriculture")],
)
def test_intents(spark, question, intent):
    r = rules.classify(spark.createDataFrame([(question,)], "text string")).first()
    assert r.intent == intent


def test_chapters_and_lexicons(spark):
    r = rules.classify(spark.createDataFrame([("weeds in wheat",)], "text string"), chapters=True).first()
    assert (r.intent, r.use_chapters, r.crop) == ("crop_question", True, "Wheat")
    entries = (("a", ("rust",)), ("b", ("yellow rust",)), ("c", ("stem rust x",)))
    assert one(spark, L.longest_match(F.col("t"), entries), t="yellow rust") == "b" and one(spark, L.first_match(F.col("t"), entries), t="yellow rust") == "a"


def test_tri_state_eligibility(spark):
    e = lambda profile, owns, flag: one(spark, rules.eligibility(F.lit(profile), F.lit(owns).cast("boolean"), [(F.lit(flag).cast("boolean"), "pensioner")], F.lit(None).cast("boolean"))).asDict()
    assert e(False, None, None)["status"] == "needs_info" and e(True, None, None)["status"] == "needs_info"
    assert e(True, True, None)["status"] == "likely_eligible" and e(True, True, True)["reasons"] == ["pensioner"] and e(True, False, True)["reasons"] == ["no_land", "pensioner"]


def test_status_rules(spark):
    none = F.array().cast("array<string>")
    no = F.lit(False)
    s = lambda intent, source, checks=none, **k: one(spark, rules.evidence_status(F.lit(intent), F.lit(source).cast("string"), k.get("more", no), no, checks, k.get("weak", no), no))
    assert s("greeting", None) == "not_applicable" and s("crop_question", None) == "not_verified" and s("crop_question", "x") == "verified"
    assert s("crop_question", "x", F.array(F.lit("unverified"))) == "partially_verified" and s("weather", "x", weak=F.lit(True)) == "partially_verified"
    assert [one(spark, c) for c in rules.weather_advice(F.lit(41), F.lit(20), F.lit(36))] == ["no_spray_rain", "light"]
    g = one(spark, rules.grounding(F.col("a"), F.col("c")), a="spray early with water", c="early spraying")
    assert g.ratio == 0.5 and g.grounded and one(spark, rules.grounding(F.col("a"), F.col("c")), a="x", c="").ratio == 0.0


TALKS = {
    # conversation: turns of (text, intent, crop, topic, place, answer's needs_crop), then (intent, crop, topic, place, rule) of the last one
    1: ([("u", "crop_question", "Wheat", "Aphid", None, False), ("kal?", "weather", None, None, "Delhi", False), ("what dose is that", "general_agriculture", None, None, None, False)], ("general_agriculture", "Wheat", "Aphid", None, "same_crop")),
    2: ([("price", "market_price", None, "Market prices", None, False), ("Sangrur?", "general_agriculture", None, None, None, False)], ("market_price", None, "Market prices", "Sangrur", "place_reply")),
    3: ([("rate in Delhi", "market_price", None, "Market prices", "Delhi", False), ("hello", "greeting", None, None, None, False), ("rice rate", "market_price", None, "Market prices", None, False)], ("market_price", None, "Market prices", "Delhi", "price")),
    4: ([("rate in Delhi", "market_price", None, "Market prices", "Delhi", False), ("and mustard?", "general_agriculture", "Mustard", None, None, False)], ("market_price", None, "Market prices", "Delhi", "price_follow_up")),
    5: ([("kcc loan", "scheme_query", None, "KCC", None, False), ("how do I claim for my wheat", "crop_question", "Wheat", "Rust", None, False)], ("scheme_query", None, "KCC", None, "scheme_follow_up")),
    6: ([("rain in Delhi", "weather", None, "Weather and spraying", "Delhi", False), ("irrigation?", "general_agriculture", None, None, None, False)], ("weather", None, "Weather and spraying", "Delhi", "weather_follow_up")),
    7: ([("aphid in wheat", "crop_question", "Wheat", "Aphid", None, False), ("what about mustard", "general_agriculture", "Mustard", "Agronomy/General", None, False)], ("crop_question", "Mustard", "Aphid", None, "new_crop")),
    8: ([("leaves turn brown", "general_agriculture", None, None, None, True), ("wheat", "general_agriculture", "Wheat", None, None, False)], ("crop_question", "Wheat", None, None, "crop_reply")),
    9: ([("aphid in wheat", "crop_question", "Wheat", "Aphid", None, False), ("which variety resists this", "topic_not_covered", None, "varieties", None, False)], ("crop_question", "Wheat", "Aphid", None, "same_crop")),
    10: ([("aphid in wheat", "crop_question", "Wheat", "Aphid", None, False), ("weeds", "topic_not_covered", None, "weeds", None, False)], ("topic_not_covered", None, "weeds", None, "closed")),
}


def talks(spark):
    rows = [(c, n, t, i, 0.7 if i == "topic_not_covered" else 0.9, crop, topic, place, False, asks) for c, (turns, _) in TALKS.items() for n, (t, i, crop, topic, place, asks) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, turn long, text string, intent string, confidence double, crop string, topic string, place string, use_chapters boolean, needs_crop boolean")


def test_dialogue(spark):
    got = {(r.conv_id, r.turn): (r.intent, r.crop, r.topic, r.place, r.rule) for r in dialog.resolved(talks(spark)).collect()}
    assert {c: got[c, len(turns) - 1] for c, (turns, _) in TALKS.items()} == {c: want for c, (_, want) in TALKS.items()}
    book = {r.conv_id: (r.intent, r.crop, r.topic, r.use_chapters) for r in dialog.resolved(talks(spark), chapters=True).filter("turn = 1").collect()}
    assert book[10] == ("crop_question", "Wheat", "weeds weed control", True)


def test_places_and_terms(spark):
    place = lambda t: one(spark, tools.detect_place(F.col("t")), t=t)
    assert [place(t) for t in ("rain in nashik today", "moga vich bhav", "weather in UP", "pick up now", "ਸੰਗਰੂਰ ਮੰਡੀ")] == ["Nashik", "Moga", "Uttar Pradesh", None, "Sangrur"]
    assert one(spark, rules.search_terms(F.col("t")), t="नदी में खरपतवार, zinc") == "weeds weed control zinc fertilizer application"
    assert one(spark, rules.weather_topics(F.col("t")), t="spray water before irrigation") == ["irrigation"]
    assert tools.crop_words((("Rice", ("basmati rice", "धान")),)) == ("basmati", "rice")


def test_claims(spark):
    checks = lambda c, **v: [(x.kind, x.status) for x in one(spark, c, **v)]
    proof = F.array(F.col("e"))
    assert checks(claims.money_checks(F.col("q"), proof), q="Since it gives ₹12,000 per month, how?", e="It pays Rs 6,000 per year in 3 instalments.") == [("money", "contradicted")]
    assert checks(claims.money_checks(F.col("q"), proof), q="500 rupees a month?", e="Rs 6000 yearly") == [("money", "supported")]
    assert checks(claims.money_checks(F.col("q"), proof), q="Rs 500 per acre", e="Rs 500 per quintal") == [("money", "unverified")]
    assert checks(claims.dose_checks(F.col("q"), proof), q="100 g Actara per acre", e="Spray 40 g of actara. 100 g tilt.") == [("dose", "contradicted")]
    assert checks(claims.dose_checks(F.col("q"), proof), q="use 5 kg in water", e="5 kg") == []
    assert one(spark, claims.unknown_diseases(F.col("q"), F.col("e")), q="treat para wilt and golden blight", e="parawilt of cotton") == []
    assert one(spark, claims.premise_clause(F.col("q")), q="I heard that the state buys all, is it so?") == "the state buys all"


def test_logs_and_reports(spark):
    assert one(spark, logs.dedupe_key(F.col("t")), t="Aphids of the Rice in 2025 information") == "aphid paddy"
    assert one(spark, logs.skipped(F.col("t"), ("junk",)), t="short") and not one(spark, logs.skipped(F.col("t"), ("junk",)), t="a long enough question?")
    frame = spark.createDataFrame([("a", float(i)) for i in range(1, 41)], "g string, v double")
    assert reports.exact_quantile(frame, "g", "v", 0.95, "floor").first().v == 38.0 and frame.agg(reports.nth(F.col("v"), 0.95, "floor").alias("x")).first().x == 38.0
    assert frame.agg(reports.hits(F.col("v") > 30).alias("h")).first().h == "10/40 (25%)" and frame.limit(0).agg(reports.hits(F.col("v") > 30).alias("h")).first().h == "n/a"


def test_review_queue(spark):
    answers = spark.createDataFrame([("q1", "t1", ["pesticide"]), ("q2", "t1", [])], "question string, created string, reasons array<string>")
    queue = review.submit(answers)
    i = queue.first().id
    done = review.reviewed(queue, spark.createDataFrame([(i, "unsafe", 2), (i, "nonsense", 3)], "id string, verdict string, changed int")).first()
    assert (done.status, done.verdict) == ("reviewed", "unsafe")
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "id string, changed int, v string")
    assert review.latest(log).first().v == "y"


def test_sources(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id": "a", "status": "pending"}\n\n{broken\n')
    assert [r.id for r in readers.json_lines(spark, str(tmp_path / "r.jsonl")).collect()] == ["a"]
    (tmp_path / "c.csv").write_text('QueryText,KccAns,Crop,DistrictName\n"a ""b""\nc",d,e,f\n')
    assert readers.call_log(spark, str(tmp_path / "c.csv")).first().QueryText == 'a "b"\nc'
    (tmp_path / "p.json").write_text(json.dumps({"crops": {"bajra": {"season": "k", "msp": 5}}}))
    assert readers.support_prices(spark, str(tmp_path / "p.json")).first().name == "bajra"
    assert readers.optional_json(spark, str(tmp_path / "none.json"), "a string").count() == 0
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(readers.MarketPrices)
    rows = json.dumps([{"state": "P", "market": "m1"}, {"state": "Q", "market": "m2"}])
    frame = spark.read.format("market_prices").option("rows", rows).load()
    assert frame.count() == 2 and [r.market for r in frame.filter("state = 'Q'").collect()] == ["m2"]
    sinks.export_csv(spark.createDataFrame([(["a", "b"],)], "l array<string>"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first().l == "a; b"


def test_streams(spark, tmp_path):
    turns = talks(spark)
    turns.write.parquet(str(tmp_path / "turns"))
    stream = dialog.marked(spark.readStream.schema(turns.schema).parquet(str(tmp_path / "turns")))
    q = streams.dialogue(stream).writeStream.format("memory").queryName("dialogue").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    columns = ["conv_id", "turn", "intent", "crop", "topic", "place", "follow_up_of", "rule"]
    assert sorted(map(str, spark.sql("SELECT * FROM dialogue").select(*columns).collect())) == sorted(map(str, dialog.resolved(turns).select(*columns).collect()))
    answers = spark.createDataFrame([("q1", "t1", ["pesticide"])], "question string, created string, reasons array<string>")
    answers.write.parquet(str(tmp_path / "answers"))
    streams.append_reviews(spark.readStream.schema(answers.schema).parquet(str(tmp_path / "answers")), str(tmp_path / "log"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1
    calls = spark.sql("SELECT 's' AS source, timestamp'2026-01-01 00:00:00' + make_dt_interval(0, 0, m, 0) AS ts, m <> 0 AS ok FROM VALUES (0), (5), (15) AS t(m)")
    assert [r.skipped for r in streams.open_circuit(calls).orderBy("ts").collect()] == [False, True, False]


@pytest.fixture(scope="session")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are absent")
@pytest.mark.parametrize("name", [n for n in catalog.queries()])
def test_query_equals_its_sql(spark, oracle, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    if name not in catalog.oracle_sql():
        raise AssertionError(f"{name} has no SQL")
    want = oracle.execute(catalog.oracle_sql()[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (f[columns].astype(str).sort_values(columns).reset_index(drop=True) for f in (got, want))
    assert a.equals(b)


def test_dose_totals_name_no_value_twice(spark):
    """The plan of a total stays small: a value that is written twice inside a higher-order function is computed twice."""
    plan = spark.range(1).select(N.dose_total(F.concat(F.col("id").cast("string"), F.lit("5-10 kg")), F.lit(3.5)).alias("t"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract(") == 3 and plan.count("element_at(") == 2


def test_windows_hold_few_rows_as_objects(spark, monkeypatch):
    """Rows of an Arrow batch become Python objects a slice at a time, nulls and empty texts too."""
    made = []
    monkeypatch.setattr(chunking.F, "arrow_udf", lambda kind: lambda f: made.append(f) or F.udf(lambda s, h: None, kind))
    chunking.windows(F.col("t"), F.col("h"), 40, 10)
    monkeypatch.undo()
    rows = [[f"Sentence {i} of row {n}." for i in range(5)] for n in range(300)] + [None, []]
    text, head = pa.array(rows, pa.list_(pa.string())), pa.array(["[h] "] * 302)
    sizes = []
    plain = pa.array
    monkeypatch.setattr(chunking.pa, "array", lambda x, *a: (sizes.append(len(x)), plain(x, *a))[1])
    got = made[0](text, head).to_pylist()
    assert max(sizes) <= chunking.SLICE < 300 and got[300:] == [None, []] and len(got) == 302
    assert got[7] == ["[h] " + w for w in chunking.windows_of(rows[7], 40, 10)]


def plan_of(spark, column, **named):
    """The analysed plan of a column over columns of text."""
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in named.items())).select(column.alias("c"))._jdf.queryExecution().analyzed().toString()


def test_dose_checks_name_no_value_twice(spark):
    """Doses of the evidence are read once for each claim, its sentences once for all."""
    plan = plan_of(spark, claims.dose_checks(F.col("q"), F.array(F.col("e"))), q="5 g tilt", e="6 g of tilt.")
    assert plan.count("regexp_extract_all(") == 2 and plan.count("split(") == 1


def test_a_premise_is_cut_once(spark):
    plan = plan_of(spark, claims.unchecked_premise(F.col("q"), F.array().cast(claims.CHECK), F.array(F.lit("a"))), q="Since it rains, what now?")
    assert plan.count("everybody knows") == 1


def test_terms_share_one_look_at_borders(spark):
    """The pattern of many terms finds what the patterns of single terms find, longest first, and looks at borders once."""
    terms = ("rain", "rain today", "now", "क्यों", "क्योंकि")
    assert T.any_of(terms).count(T.NO_WORD_BEFORE) == 1
    single = "(?i)(?:" + "|".join(T.term_pattern(t) for t in sorted(terms, key=lambda t: (-len(t), t))) + ")"
    texts = ["Rain today now", "rains now_ NOW", "xrain rain", "क्योंकि क्यों rain", "", None, "rain todayx", "nowक्यों"]
    both = spark.createDataFrame([(t,) for t in texts], "t string").select(*(F.regexp_extract_all("t", F.lit(p), 0).alias(n) for n, p in (("a", T.any_of(terms)), ("b", single)))).collect()
    assert all(r.a == r.b for r in both) and both[0].a == ["Rain today", "now"] and both[1].a == ["NOW"]


def test_a_lexicon_lowers_a_text_once_and_looks_for_bytes_first(spark):
    entries = (("one", ("rain", "hail")), ("two", ("गेहूं", "")), ("none", ("",)), ("three", ("late  wheat",)))
    for matched in (L.all_matches(F.col("t"), entries), L.longest_match(F.col("t"), entries)):
        plan = plan_of(spark, matched, t="rain")
        assert plan.count("lower(") == 1 and plan.count("Contains(") == 4
    texts = ["RAIN गेहूं", "rains hailx", "late  wheat, hail", "", None, "late wheat अगेहूं"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(L.all_matches(F.col("t"), entries).alias("a"), L.longest_match(F.col("t"), entries).alias("l")).collect()
    assert [r.a for r in got] == [["one", "two"], [], ["one", "three"], [], [], ["two"]]
    assert [r.l for r in got] == ["two", None, "three", None, None, "two"]
