import io
import json
import struct
import tarfile

from pyspark.sql import functions as F

from lodewright import doctor, schema
from lodewright.sources import readers, writers
from lodewright.streaming import ingest


def shard(path, samples):
    with tarfile.open(path, "w") as tar:
        for name, data in samples:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 640, 480)
PAGE = json.dumps({"annotations": [{"bbox": [0, 0, 50, 50], "category_id": 1}]}).encode()


def test_shards(spark, tmp_path):
    shard(tmp_path / "shard-000000.tar", [("A_1.png", PNG), ("A_1.json", PAGE), ("A_2.png", PNG), ("A_3.json", PAGE)])
    rows = readers.page_sizes(readers.samples(spark, readers.shard_paths(str(tmp_path), readers.Ingest())))
    got = rows.collect()
    assert [(r["key"], r["width"], r["height"]) for r in got] == [("A_1", 640, 480)]
    assert readers.samples(spark, str(tmp_path), max_pages=2, complete=False).count() == 2


def test_corpus_and_graph_json(spark, tmp_path):
    (tmp_path / "corpus.json").write_text(json.dumps({"regions": [{"region_id": "a", "doc_id": "d", "region_type": "text"}], "chunks": [{"chunk_id": "c", "source_region_ids": ["a"]}]}, indent=1))
    regions, chunks = readers.corpus(spark, str(tmp_path / "corpus.json"), whole=True)
    assert regions.first()["text"] is None and chunks.first()["source_region_ids"] == ["a"]
    (tmp_path / "graph.json").write_text(json.dumps({"nodes": [{"id": "m:x", "name": "x"}], "edges": []}))
    nodes, edges = readers.graph(spark, str(tmp_path / "graph.json"), whole=True)
    assert nodes.count() == 1 and edges.count() == 0
    (tmp_path / "log.json").write_text(json.dumps({"s": [{"qa_id": "1", "gold_region_ids": ["a"], "retrieved_region_ids": []}]}))
    assert readers.retrieval_log(spark, str(tmp_path / "log.json"), whole=True).first()["system"] == "s"


def test_caches(spark, tmp_path):
    assert readers.cache(spark, str(tmp_path / "none")).count() == 0
    rows = spark.createDataFrame([("k", "v")], "key string, reply string")
    writers.new_cache_rows(rows, str(tmp_path / "cache"))
    writers.new_cache_rows(rows, str(tmp_path / "cache"))
    assert [tuple(r) for r in readers.cache(spark, str(tmp_path / "cache")).collect()] == [("k", "v")]
    (tmp_path / "cache" / "part-broken.parquet").write_bytes(b"PAR1 no parquet at all PAR1")
    assert readers.cache(spark, str(tmp_path / "cache")).count() == 1


def test_writers(spark, tmp_path):
    report = spark.createDataFrame([("b", "x", 1, 0.5, 0.5), ("b", "overall", 1, 0.5, 0.5), ("a", "overall", 1, 1.0, 1.0)], "system string, segment string, n long, recall_5 double, mrr double")
    writers.comparison(report, str(tmp_path / "csv"), ["b", "a"])
    lines = next((tmp_path / "csv").glob("part*.csv")).read_text().splitlines()
    assert [x.split(",")[:2] for x in lines[1:]] == [["b", "overall"], ["b", "x"], ["a", "overall"]]
    writers.results({"a": 1, "_b": 2}, tmp_path / "r.json")
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": 1}
    assert "recall@5" in writers.console(report, 5)
    writers.stage_tables({"staged_report": report}, str(tmp_path / "stage"))
    assert spark.sql("SELECT count(*) AS n FROM staged_report").first()["n"] == 3
    q = spark.createDataFrame([("t", "q?", "x", ["r"], None, "d")], schema.QUESTIONS)
    writers.questions(q, str(tmp_path / "q"))
    assert readers.questions(spark, str(tmp_path / "q")).first()["gold_region_ids"] == ["r"]


def test_exports_read_back_as_they_were(spark, tmp_path):
    n = spark.range(1000)
    i = F.col("id").cast("string")
    tables = {
        "regions": n.select(F.concat(F.lit("D_0#r"), i).alias("region_id"), F.lit("D").alias("doc_id"), F.lit("0").alias("page_id"), F.lit("text").alias("region_type"), F.struct(*[F.col("id").cast("double").alias(c) for c in "xywh"]).alias("bbox"), F.concat(F.lit("line one\nline \"two\" "), i).alias("text"), F.lit("p.png").alias("image_path"), (F.col("id") / 1000).alias("ocr_confidence")),
        "chunks": n.select(F.concat(F.lit("c"), i).alias("chunk_id"), F.lit("D").alias("doc_id"), F.lit("0").alias("page_id"), F.lit("t").alias("text"), F.array(i, F.lit("x")).alias("source_region_ids")),
        "nodes": n.select(F.concat(F.lit("method:"), i).alias("id"), i.alias("name"), F.lit("method").alias("entity_type"), F.array(i).alias("source_region_ids")),
        "edges": n.select(i.alias("head"), F.lit("t").alias("tail"), F.lit("uses").alias("relation_type"), i.alias("source_region_id")),
        "questions": n.select(i.alias("qa_id"), F.lit("q?").alias("question"), F.lit("multi_hop").alias("query_type"), F.array(i).alias("gold_region_ids"), F.lit("a").alias("gold_answer"), F.lit("D").alias("doc_id")),
        "log": n.select((F.col("id") % 2).cast("string").alias("system"), i.alias("qa_id"), F.lit("q?").alias("question"), F.lit("x").alias("query_type"), F.array(i).alias("gold_region_ids"), F.array().cast("array<string>").alias("retrieved_region_ids")),
    }
    same = lambda a, b: sorted(map(repr, a.select(sorted(b.columns)).collect())) == sorted(map(repr, b.select(sorted(b.columns)).collect()))
    for whole in (False, True):
        at = lambda name, w=whole: str(tmp_path / f"{name}-{w}")
        writers.corpus(tables["regions"], tables["chunks"], at("corpus"), whole)
        writers.graph(tables["nodes"], tables["edges"], at("graph"), whole)
        writers.questions(tables["questions"], at("questions"), whole)
        writers.retrieval_log(tables["log"], at("log"), whole)
        back = dict(zip(("regions", "chunks"), readers.corpus(spark, at("corpus"), whole), strict=True))
        back |= dict(zip(("nodes", "edges"), readers.graph(spark, at("graph"), whole), strict=True))
        back |= {"questions": readers.questions(spark, at("questions"), whole), "log": readers.retrieval_log(spark, at("log"), whole)}
        assert [name for name in tables if not same(back[name], tables[name])] == []


def test_crops_are_found_under_their_names(spark, tmp_path):
    rows = spark.createDataFrame([(f"D_0#r{i}", bytes([i, 1, 2])) for i in range(200)], "region_id string, image binary")
    named = writers.crops(rows, str(tmp_path / "crops"))
    got = {r["region_id"]: bytes(r["content"]) for r in readers.images(spark, str(tmp_path / "crops"), named).collect()}
    assert got == {f"D_0#r{i}": bytes([i, 1, 2]) for i in range(200)}
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "D_0_r7.png").write_bytes(PNG)
    assert [r["region_id"] for r in readers.images(spark, str(tmp_path / "files"), named, files=True).collect()] == ["D_0#r7"]


def test_verification_summary(spark):
    rows = [("a", "overall", 4, 0.5, 0.5, 0.25), ("b", "overall", 4, 0.75, 0.5, 0.5), ("b", "x", 2, 0.5, 0.5, 0.5)]
    said = writers.verification(spark.createDataFrame(rows, "system string, segment string, n long, recall_5 double, ndcg_5 double, mrr double"), 5, "a", "b")
    assert "a: 4 questions, recall@5 0.5000" in said and "b against a: recall@5 +0.2500" in said


def test_incremental_ingest(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows = lambda key: spark.createDataFrame([(key, 100, 100, PAGE.decode())], ingest.PAGES)
    for key in ("A_1", "A_2"):
        rows(key).write.mode("append").json(src)
        ingest.ingest(spark, src, out, check)
    assert sorted(r["region_id"] for r in spark.read.parquet(out).collect()) == ["A_1#r000", "A_2#r000"]


def test_windowed_counts(spark):
    events = spark.createDataFrame([("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:02:00", "a", 2.0)], "ts string, event_type string, value double")
    got = ingest.windowed_counts(events.withColumn("ts", F.to_timestamp("ts"))).first()
    assert (got["n"], got["total"]) == (2, 3.0)


def test_doctor():
    assert doctor.main() == 0
