import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from lodewright.functions import embedders
from lodewright.functions.embedders import embedded, hashing
from lodewright.operators import checks, dense, fusion, lexical, metrics

DOCS = [("d1", "random forest classifier for cardiac outcomes"), ("d2", "convolutional neural network for imaging"), ("d3", "support vector machine for tabular data")]


def ranking(spark, rows, modality="text"):
    return spark.createDataFrame([("q", i, modality, r) for i, r in rows], "query_id string, item_id string, modality string, rank int")


def listed(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("rank").collect()]


def test_bm25_value_and_padding(spark):
    docs = spark.createDataFrame(DOCS, "doc_id string, text string")
    q = spark.createDataFrame([("a", "random forest"), ("b", "random random"), ("c", "nothing here")], "query_id string, question string")
    top = lexical.top_k(docs, q, 3).orderBy("query_id", "rank").collect()
    assert [r["item_id"] for r in top] == ["d1", "d2", "d3"] * 3
    assert top[0]["score"] == pytest.approx(1.9005687947632073)
    assert top[3]["score"] == pytest.approx(1.9005687947632073)
    assert [r["score"] for r in top[6:]] == [0.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        lexical.top_k(docs, q, 0)


def test_reciprocal_ranks(spark):
    a, b = ranking(spark, [("x", 1), ("y", 2)]), ranking(spark, [("y", 1), ("z", 2)], "visual")
    got = listed(fusion.reciprocal_rank([a, b]), "item_id", "score", "modality")
    assert [g[0] for g in got] == ["y", "x", "z"]
    assert [g[1] for g in got] == pytest.approx([0.0325224749, 0.0163934426, 0.0161290323], abs=1e-9)
    assert got[0][2] == "fused:text+visual"
    swapped = {r["item_id"]: r["score"] for r in fusion.reciprocal_rank([b, a]).collect()}
    assert swapped == pytest.approx({g[0]: g[1] for g in got})
    weighted = fusion.reciprocal_rank([ranking(spark, [("x", 1)]), ranking(spark, [("x", 2)], "graph")], 60, [1.0, 0.3])
    assert weighted.first()["score"] == pytest.approx(0.0212321524)
    with pytest.raises(ValueError):
        fusion.reciprocal_rank([a], 60, [1.0, 2.0])
    with pytest.raises(ValueError):
        fusion.reciprocal_rank([a], 0)


def test_interleaving_and_regions(spark):
    places = fusion.interleaved(ranking(spark, [("t1", 1), ("t2", 2)]), ranking(spark, [("v1", 1)], "visual"))
    assert [r["item_id"] for r in places.orderBy("place").collect()] == ["t1", "v1", "t2"]
    chunks = spark.createDataFrame([("c1", ["r1"]), ("c2", ["r1", "r2"])], "chunk_id string, source_region_ids array<string>")
    two = fusion.interleaved(ranking(spark, [("c1", 1), ("c2", 2)]), ranking(spark, [("v9", 3)], "visual"))
    assert [r["region_id"] for r in fusion.as_regions(two, chunks).orderBy("rank").collect()] == ["r1", "v9", "r2"]


def test_dense_ties_and_zero_vectors(spark):
    items = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0])], "item_id long, embedding array<double>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    got = listed(dense.top_k(items, q, 9), "item_id", "score")
    assert got == [(1, 1.0), (3, 1.0), (2, 0.0)]
    with pytest.raises(PythonException, match="different dimensions"):
        dense.top_k(items, spark.createDataFrame([("q", [1.0])], "query_id string, embedding array<double>"), 1).collect()
    assert dense.top_k(items.limit(0), q, 3).count() == 0 and dense.top_k(items, q.limit(0), 3).count() == 0
    odd = spark.createDataFrame([(5, None), (6, [None, 1.0]), (None, [1.0, 0.0]), (7, [1.0, 1.0])], "item_id long, embedding array<double>")
    assert [r["item_id"] for r in dense.top_k(odd, q, 9).collect()] == [7]


def test_dense_search_in_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, y = rng.integers(-3, 4, (400, 6)), rng.integers(-3, 4, (90, 6))
    items = spark.createDataFrame([(f"i{i:03d}", v.tolist()) for i, v in enumerate(x.astype(float))], "item_id string, embedding array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y.astype(float))], "query_id long, embedding array<double>")
    whole = sorted(map(tuple, dense.top_k(items, q, 7).select("query_id", "rank", "item_id").collect()))
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1), 1e-30)[:, None]
    s = np.round(unit(y) @ unit(x).T, 9)
    assert whole == [(i, r + 1, f"i{j:03d}") for i in range(90) for r, j in enumerate(np.lexsort((np.arange(400), -s[i]))[:7])]
    for name, value in (("QUERY_BLOCK", 16), ("ITEM_BLOCK", 32), ("SENT_BYTES", 1000)):
        monkeypatch.setattr(dense, name, value)
    assert sorted(map(tuple, dense.top_k(items, q, 7).select("query_id", "rank", "item_id").collect())) == whole


def test_random_floor_is_stable_and_distinct(spark):
    items = spark.createDataFrame([(f"i{n}",) for n in range(50)], "item_id string")
    q = spark.createDataFrame([("a",), ("b",)], "query_id string")
    first, again = (sorted(map(tuple, fusion.random_floor(items, q, 5).select("query_id", "item_id", "rank").collect())) for _ in range(2))
    assert first == again
    assert len({x[:2] for x in first}) == 10
    assert fusion.random_floor(items.limit(3), q, 5).count() == 6
    many = spark.createDataFrame([(f"i{n}",) for n in range(500)], "item_id string")
    assert len({tuple(r)[:2] for r in fusion.random_floor(many, q, 5).collect()}) == 10


def test_hashing_embedder(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("accuracy model, accuracy",), (None,)], "t string").select(embedded(F.col("t"), hashing(64)).alias("v"))
    v, empty = (r["v"] for r in df.collect())
    assert v[8] == 2 and v[12] == 1 and sum(v) == 3 and sum(empty) == 0


def test_guards(spark):
    checks.unique(spark.range(3), "id")
    with pytest.raises(ValueError):
        checks.unique(spark.range(3).union(spark.range(1)), "id")


def log(spark, rows):
    return spark.createDataFrame(rows, "system string, qa_id string, query_type string, gold_region_ids array<string>, retrieved_region_ids array<string>")


def test_metrics(spark):
    rows = [("s", "1", "x", ["c"], ["a", "b", "c"]), ("s", "2", "x", ["a", "d"], ["a", "b", "c", "d"]), ("s", "3", "y", [], ["a"]), ("s", "4", "y", ["a"], [])]
    got = {r["qa_id"]: r for r in metrics.per_question(log(spark, rows), (3, 5)).collect()}
    assert (got["1"]["recall_3"], got["1"]["ndcg_3"], got["1"]["rr"]) == pytest.approx((1.0, 0.5, 1 / 3))
    assert got["1"]["precision_5"] == pytest.approx(1 / 3)  # divided by what was returned
    assert got["2"]["ndcg_5"] == pytest.approx(0.8772153153)
    assert all(got[i][c] == 0.0 for i in "34" for c in ("recall_5", "precision_5", "ndcg_5", "rr"))
    report = {(r["segment"]): r for r in metrics.by_segment(metrics.per_question(log(spark, rows), (5,))).collect()}
    assert report["overall"]["n"] == 4 and report["x"]["n"] == 2
    assert report["overall"]["mrr"] == pytest.approx((1 / 3 + 1) / 4)


def test_deltas_fall_back_to_overall(spark):
    cols = "system string, segment string, recall_5 double, mrr double"
    report = spark.createDataFrame([("b", "overall", 0.5, 0.4), ("e", "overall", 0.75, 0.5), ("e", "x", 1.0, 1.0)], cols)
    got = {r["segment"]: (r["recall_5"], r["mrr"]) for r in metrics.deltas(report, "b", "e").collect()}
    assert got == {"overall": (0.25, 0.1), "x": (0.5, 0.6)}


def test_interval(spark):
    df = spark.createDataFrame([("a", v) for v in (0.8, 0.9, 0.7, 1.0, 0.6)] + [("b", 0.5)], "s string, v double")
    got = {r["s"]: tuple(r)[1:] for r in metrics.interval(df, "v", "s").collect()}
    assert got["a"] == (5, 0.8, 0.6614, 0.9386)
    assert got["b"] == (1, 0.5, 0.5, 0.5)


def test_embedder_takes_texts_by_bytes_and_forgets_words(spark, monkeypatch):
    monkeypatch.setattr(embedders, "SLICE_BYTES", 100, raising=False)
    monkeypatch.setattr(embedders, "KNOWN_WORDS", 10, raising=False)
    seen = []

    def watched(texts):
        seen.append(sum(len(t) for t in texts))
        return embed(texts)

    embed = hashing(16)()
    texts = [f"one{i} two{i} three{i}" for i in range(60)] + ["", None, "x" * 300]
    got = pa.concat_arrays(list(embedders._lists(pa.array(texts), watched))).to_pylist()
    assert got == hashing(16)()([t or "" for t in texts]).tolist() and len(got) == len(texts)
    assert len(seen) > 10 and max(seen[:-1]) <= 100
    assert len(embed.__closure__[-1].cell_contents.__closure__[-1].cell_contents) <= 11
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r["v"] for r in df.select(embedded(F.col("t"), hashing(16)).alias("v")).collect()] == got


def test_scores_hold_some_pairs_of_query_and_document_at_a_time(spark, monkeypatch):
    docs = spark.createDataFrame([(f"D{i:04d}", f"common word{i % 50} text{i % 7}") for i in range(2000)], "doc_id string, text string").coalesce(1)
    asked = spark.createDataFrame([(f"Q{i:02d}", f"common word{i}") for i in range(20)], "query_id string, question string")
    whole = {(r["query_id"], r["doc_id"]): r["score"] for r in lexical.scores(docs, asked).collect()}
    monkeypatch.setattr(lexical, "TASK_PAIRS", 4000, raising=False)
    monkeypatch.setattr(lexical, "TASK_DOCS", 10, raising=False)
    scored = lexical.scores(docs, asked)
    assert {(r["query_id"], r["doc_id"]): r["score"] for r in scored.collect()} == pytest.approx(whole, rel=1e-12) and len(whole) == 40_000
    by_task = [r["count"] for r in scored.groupBy(F.spark_partition_id()).count().collect()]
    assert max(by_task) <= 2 * 4000
