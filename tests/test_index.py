"""The stored index against plain BM25: numeric and string keys, ties, nulls, updates, compaction, many small spans."""

import glob
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agroloom.operators import index as I
from agroloom.operators import retrieval as R
from agroloom.operators.numbering import number_by_range
from agroloom.plans import retrieval_queries
from agroloom.sources.shared import discard, shared_dir, written

WORDS = "wheat rust aphid spray water seed zinc sowing rate borer leaf field mandi price".split()


def corpus(seed, n, key):
    r = random.Random(seed)
    return [(key(i), " ".join(r.choices(WORDS, [3**-j for j in range(len(WORDS))], k=r.randint(1, 40)))) for i in range(n)]


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "wheat rust"), (2, "price of wheat wheat wheat"), (3, "mandi price borer leaf"), (4, "nothing known"), (5, None), (6, "zinc")], "item_id long, text string")


def hits(index, asked, k=7, **how):
    return sorted((r.item_id, r["rank"], r.key, r.score) for r in I.search(index, asked, k, **how).hits.collect())


def plain(docs, asked, k=7, **how):
    return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in R.ranked(R.bm25(docs, asked, **how), k).collect())


def test_search_equals_plain_bm25(spark, asked, tmp_path):
    rows = [*corpus(1, 2500, lambda i: i), (5000, None), (5001, ""), *((6000 + i, "zinc zinc") for i in range(30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = I.build(docs, str(tmp_path / "ix"))
    assert hits(index, asked) == plain(docs, asked)
    assert hits(index, asked, kind="okapi", repeats=False) == plain(docs, asked, kind="okapi", repeats=False)
    read, of = I.search(index, asked, 7).share()
    assert 0 < read < of


def test_updates_and_compaction_equal_a_rebuild(spark, asked, tmp_path):
    key = lambda i: f"doc_{i % 7}_s{i}"
    before = spark.createDataFrame(corpus(2, 300, key), "chunk_id string, text string")
    changed = [(k, t + " rust zinc") if n % 4 == 0 else (k, t) for n, (k, t) in enumerate(corpus(2, 340, key)) if n % 9]
    now = spark.createDataFrame(changed, "chunk_id string, text string")
    index = I.build(before, str(tmp_path / "ix"), "chunk_id")
    one = I.update(index, now, "chunk_id")
    two = I.compact(one)
    want = plain(now.withColumnRenamed("chunk_id", "doc_id"), asked)
    assert hits(one, asked) == want and hits(two, asked) == want
    assert (len(one.manifest.segments), len(one.manifest.removed)) == (2, 1) and two.manifest.removed == []
    rebuilt = I.build(now, str(tmp_path / "new"), "chunk_id")
    df = lambda ix: sorted(map(tuple, ix.terms().select("term", "df").collect()))
    assert df(one) == df(two) == df(rebuilt) and two.avgdl == one.avgdl == rebuilt.avgdl
    vectors = lambda ix: sorted((r.id, bytes(r.v)) for r in ix.vectors().collect())
    assert vectors(one) == vectors(two) == vectors(rebuilt)
    same = I.update(two, now, "chunk_id")
    assert same.manifest.version == two.manifest.version
    gone = I.update(two, now.limit(0), "chunk_id")
    assert hits(gone, asked) == [] and hits(I.opened(spark, str(tmp_path / "ix")), asked) == []


def test_old_readers_keep_their_state_and_writers_dont_collide(spark, asked, tmp_path):
    docs = spark.createDataFrame(corpus(3, 50, lambda i: i), "doc_id long, text string")
    index = I.build(docs, str(tmp_path / "ix"), vectors=False)
    before = hits(index, asked)
    I.update(index, docs.filter("doc_id < 20"), vectors=False)
    assert hits(index, asked) == before
    with pytest.raises(RuntimeError, match="someone else"):
        I.update(index, docs.filter("doc_id < 10"), vectors=False)


def test_no_index_is_an_error(spark, tmp_path):
    with pytest.raises(RuntimeError, match="build one first"):
        I.opened(spark, str(tmp_path))


def test_empty_index(spark, asked, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert hits(I.build(empty, str(tmp_path / "ix")), asked) == []


def test_dense_search_over_string_keys(spark):
    docs = spark.createDataFrame([("wheat_s0_c0", "wheat rust"), ("wheat_s1_c0", "aphid"), ("a", "aphid")], "chunk_id string, text string")
    q = spark.createDataFrame([(1, "aphid")], "item_id long, text string")
    got = R.dense_top_k(R.unit_vectors(docs, "chunk_id"), R.unit_vectors(q, "item_id"), 2).orderBy("rank").collect()
    assert [r.doc_id for r in got] == ["a", "wheat_s1_c0"]


def test_numbers_by_range(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice([None, 1, 2, 2, 3]), i) for i in range(500)]
    frame = spark.createDataFrame(rows, "g string, v long, i long").repartition(7)
    got = number_by_range(frame, [F.col("v").desc(), "i"], ("g",), "n", "size").collect()
    by = {}
    for g, v, i in sorted(rows, key=lambda x: (-(x[1] or 0), x[2])):
        by.setdefault(g, []).append(i)
    assert {(x.g, x.i): (x.n, x.size) for x in got} == {(g, i): (n, len(ids)) for g, ids in by.items() for n, i in enumerate(ids)}
    assert sorted(x.n for x in number_by_range(frame, ["v"]).collect()) == list(range(500))
    assert number_by_range(frame.limit(0), ["v"]).count() == 0


def test_postings_are_never_rows_of_a_shuffle(spark, tmp_path):
    rows = [(i, " ".join(WORDS[j % 14] + str(j % 50) for j in range(i, i + 60))) for i in range(3000)]
    index = I.build(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), str(tmp_path / "ix"), vectors=False)
    forward = index.table("forward")
    plan = I.posting_rows(forward)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "collect_list" not in plan
    held = {(r.term, n): (tf, dl) for r in index.table("postings").collect() for n, tf, dl in zip(r.nums, r.tfs, r.dls, strict=True)}
    want = {(t, r.num): (tf, r.dl) for r in forward.collect() for t, tf in zip(r.terms, r.tfs, strict=True)}
    assert held == want and index.table("postings").groupBy("term", "span").count().filter("count > 1").count() == 0


def test_hashed_rows_are_shuffled_once_and_repeated_ids_are_one_text(spark):
    rows = spark.createDataFrame([(1, "wheat rust a"), (1, "wheat"), (2, None), (3, ""), (4, "a b")], "doc_id long, text string")
    got = R.hashed(rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(id") == 1 and "md5" not in plan
    one = spark.createDataFrame([(1, "wheat rust a wheat"), (4, "a b")], "doc_id long, text string")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, R.hashed(one).collect()))


def test_coded_vectors_are_the_same_unit_vectors_in_an_eighth_of_the_bytes(spark):
    texts = ["wheat rust a", "", "wheat " * 90, "zinc sowing " * 9000]
    held = {r.id: bytes(r.v) for r in R.unit_vectors(spark.createDataFrame(enumerate(texts), "doc_id long, text string")).collect()}
    assert [len(held[i]) for i in range(4)] == [257, 257, 513, 1025]
    weights = [R.bucket_weights(t.split(), {}).astype(float) for t in texts]
    want = np.stack([x / (np.sqrt((x * x).sum()) or 1) for x in weights])
    assert np.array_equal(R.unit_rows([held[i] for i in range(4)]), want)
    assert np.array_equal(R.unit_rows([held[0], want[2].tobytes(), held[1]]), want[[0, 2, 1]])


def test_pieces_of_spans_are_shuffled_and_not_rows(spark, tmp_path):
    index = I.build(spark.createDataFrame(corpus(5, 2600, lambda i: i), "doc_id long, text string").repartition(2), str(tmp_path / "ix"), vectors=False)
    rows = I.posting_rows(index.table("forward"))
    assert "Exchange hashpartitioning(span" in (plan := rows._jdf.queryExecution().executedPlan().toString()) and "piece#" in plan
    cut = index.table("forward").repartition(5)  # a span's rows in any task and order
    sign = lambda d: sorted(map(str, d.collect()))
    assert sign(I.posting_rows(cut)) == sign(rows) and I.posting_rows(cut.limit(0)).count() == 0


def test_json_records_of_chunks_are_packed_and_go(spark, tmp_path, monkeypatch):
    rows = [(i, f"wheat rust {i} " * (30 + i), "web", "en") for i in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(retrieval_queries, "FILE_ROWS", 2)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).coalesce(1)
    retrieval_queries.as_json(docs, str(tmp_path / "json"))
    assert len(glob.glob(f"{tmp_path}/json/*.json.gz")) == 5
    before = set(glob.glob(f"{shared_dir(spark)}/tables/json-*"))
    chunks = retrieval_queries.chunk_table_of(spark, str(tmp_path))
    assert set(glob.glob(f"{shared_dir(spark)}/tables/json-*")) == before
    assert chunks.count() == sum(-(-len(r[1]) // retrieval_queries.PIECE) for r in rows)


def test_texts_may_go_before_postings_are_made(spark, asked, tmp_path):
    docs = spark.createDataFrame(corpus(6, 200, lambda i: i), "doc_id long, text string")
    held, seen = written(docs, "texts"), []
    gone = lambda: (discard(held), seen.append(len(glob.glob(f"{tmp_path}/ix/*/postings"))))
    index = I.build(held, str(tmp_path / "ix"), texts_read=gone)
    assert seen == [0] and not glob.glob(f"{held.written_at}/*") and hits(index, asked) == plain(docs, asked)
