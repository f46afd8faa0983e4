import json

import pytest
from pyspark.sql import functions as F

from lodewright.conf import Chunking, Settings, SettingsError
from lodewright.operators import evidence, extraction, graph, models, questions, regions
from lodewright.schema import CHUNKS, REGIONS


def page(payload):
    return ("DOC_1", 1000, 1300, payload if isinstance(payload, str) else json.dumps(payload))


def parsed(spark, *payloads):
    return regions.parse(spark.createDataFrame([page(p) for p in payloads], "key string, width int, height int, payload string"))


def test_parse_keeps_places_and_drops(spark):
    annotations = [
        {"bbox": [10, 10, 100, 50], "category_id": 1},
        {"bbox": [10, 10, 100, 50], "category_id": 99},
        {"category_id": 2},
        {"bbox": [10, 10, 1, 1], "category_id": 2},
        {"bbox": [2000, 10, 50, 50], "category_id": 2},
        {"bbox": [990, 10, 100, 50], "category_id": 5},
    ]
    got = {r["region_id"]: r for r in parsed(spark, {"annotations": annotations}).collect()}
    assert set(got) == {"DOC_1#r000", "DOC_1#r005"}
    assert got["DOC_1#r005"]["bbox"]["w"] == 10 and got["DOC_1#r005"]["page_id"] == "1"


@pytest.mark.parametrize("wrap", [lambda a: a, lambda a: {"regions": a}, lambda a: {"objects": a}, lambda a: {"boxes": a}])
def test_payload_shapes(spark, wrap):
    assert parsed(spark, wrap([{"bbox": [0, 0, 50, 50], "label": "table"}, "noise"])).count() == 1


def test_unusable_payloads_give_nothing(spark):
    assert parsed(spark, "not json", {"other": 1}, []).count() == 0


def region(i, kind, text, y=0.0, x=0.0):
    return (f"D_1#r{i:03d}", "D", "1", kind, (float(x), float(y), 100.0, 20.0), text, None, 0.9)


def test_chunks(spark):
    rows = [region(0, "title", "short"), region(1, "text", "a" * 50), region(2, "figure", "b" * 50), region(3, "text", None)]
    df = spark.createDataFrame(rows, REGIONS)
    chunks = regions.region_chunks(df).collect()
    assert [c["chunk_id"] for c in chunks] == ["D_1#r001#c0"]  # visual text never enters the text index
    regions.validate(df, regions.region_chunks(df))


def test_windows(spark):
    df = spark.createDataFrame([region(0, "text", "x" * 1200, y=5), region(1, "text", "y" * 799, y=1)], REGIONS)
    got = regions.window_chunks(df).orderBy("chunk_id").collect()
    assert [len(c["text"]) for c in got] == [900, 900, 500]
    assert got[0]["text"].startswith("y") and got[0]["source_region_ids"] == ["D_1#r001", "D_1#r000"]
    assert got[2]["source_region_ids"] == ["D_1#r000"]


def test_validation_reports_all_rules(spark):
    df = spark.createDataFrame([region(0, "text", "x"), region(0, "text", "x")], REGIONS)
    chunks = spark.createDataFrame([("c", "D", "1", " ", ["nowhere"])], CHUNKS)
    with pytest.raises(regions.CorpusError) as e:
        regions.validate(df, chunks)
    assert all(w in str(e.value) for w in ("duplicate region ids", "dangling", "blank"))


def test_reading_cache(spark):
    df = spark.createDataFrame([region(0, "text", None), region(1, "text", None)], REGIONS)
    cache = spark.createDataFrame([("D_1#r000", "signi- ficant", 0.5)], "region_id string, text string, confidence double")
    from pyspark.sql import functions as F

    engine = lambda missing: missing.select("region_id", F.lit("read").alias("text"), F.lit(1.0).alias("confidence"))
    got = {r["region_id"]: (r["text"], r["ocr_confidence"]) for r in regions.read_text(df, cache, engine).collect()}
    assert got == {"D_1#r000": ("significant", 0.5), "D_1#r001": ("read", 1.0)}


SENTENCE = "We used a random forest and an SVM; accuracy and AUC of 0.87 appear in Fig. 2 on the Cardio dataset."


def graph_of(spark, *texts):
    r = spark.createDataFrame([(f"r{i}", t) for i, t in enumerate(texts)], "region_id string, text string")
    m = extraction.mentions(r)
    nodes = graph.build_nodes(m)
    return m, nodes, graph.build_edges(extraction.relations(r, m), nodes)


def test_extraction(spark):
    m, nodes, edges = graph_of(spark, SENTENCE, "too short", SENTENCE.replace("random", "Random"))
    ids = {r["id"]: r for r in nodes.collect()}
    assert set(ids) == {"method:random forest", "method:svm", "metric:accuracy", "metric:auc", "figure_ref:fig. 2", "dataset:cardio dataset", "finding:accuracy = 0.87"}
    assert ids["method:random forest"]["name"] == "random forest" and ids["method:random forest"]["source_region_ids"] == ["r0"]
    found = {(r["head"], r["tail"], r["relation_type"]) for r in edges.collect()}
    assert ("metric:accuracy", "finding:accuracy = 0.87", "has_value") in found
    assert ("method:svm", "metric:auc", "evaluated_by") in found
    assert ("metric:auc", "figure_ref:fig. 2", "reported_in") in found
    both = {r["id"]: r["source_region_ids"] for r in graph.build_nodes(m, "accumulate").collect()}
    assert both["method:svm"] == ["r0", "r2"]


def test_links_expansion_paths(spark):
    _, nodes, edges = graph_of(spark, SENTENCE)
    q = spark.createDataFrame([("q", "Does the  RANDOM forest beat svms?"), ("n", "nothing")], "query_id string, question string")
    seeds = graph.link(q, nodes)
    assert [(r["query_id"], r["node_id"]) for r in seeds.collect()] == [("q", "method:random forest")]
    reach = {r["node_id"]: r["depth"] for r in graph.expand(seeds, nodes, edges, 2).collect()}
    assert reach["method:random forest"] == 0 and reach["metric:auc"] == 1 and reach["method:svm"] == 2
    assert graph.expand(seeds, nodes, edges, 0).count() == 1
    with pytest.raises(ValueError):
        graph.expand(seeds, nodes, edges, -1)
    paths = [r["path"] for r in graph.paths(seeds, nodes, edges, 2).orderBy("n").collect()]
    assert len(paths) == 5 and all(p[0] == "method:random forest" for p in paths)
    text = graph.describe(graph.expand(seeds, nodes, edges, 1), nodes, edges).first()["description"]
    assert "- random forest --evaluated_by--> accuracy" in text
    lone = graph.describe(graph.expand(seeds, nodes, edges, 0), nodes, edges).first()["description"]
    assert lone == "(no graph relations found)"


def test_model_replies(spark):
    reply = {"entities": [{"name": "CNN", "type": "method"}, {"name": "x", "type": "planet"}, {"name": "AUC", "type": "metric"}], "relations": [{"head": "cnn", "tail": "AUC", "type": "evaluated_by"}, {"head": "CNN", "tail": "gone", "type": "t"}]}
    replies = spark.createDataFrame([("r", "```json\n" + json.dumps(reply) + "\n```"), ("s", "garbage")], "region_id string, reply string")
    entities, kept, dropped = extraction.from_replies(replies)
    assert {r["node_id"] for r in entities.collect()} == {"method:cnn", "metric:auc"}
    assert [(r["head"], r["tail"]) for r in kept.collect()] == [("method:cnn", "metric:auc")]
    assert dropped.first()["dropped"] == 1


def test_batches(spark):
    r = spark.createDataFrame([(f"r{i}", "t" * 2000) for i in range(7)], "region_id string, text string")
    asked = extraction.batches(r, 5)
    one = asked.filter("index = 0").first()
    replies = spark.createDataFrame([(one["batch"], json.dumps({"results": [{"index": 0, "entities": []}, {"index": 0}, {"index": 9}]}))], "batch string, reply string")
    got, rest = extraction.split_batch_replies(asked, replies)
    assert [g["region_id"] for g in got.collect()] == [one["region_id"]] and rest.count() == 6


def test_models(spark):
    slept = []
    calls = iter([models.TransientError("busy", 7), models.TransientError("busy"), "ok"])

    def call():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert models.patient(call, 5, slept.append) == "ok" and slept == [7, 2.0]
    assert models.is_transient(429) and models.is_transient(503) and not models.is_transient(401)
    now = [0.0]
    pace = models.Pace(30, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    pace.wait(), pace.wait()
    assert now[0] == 2.0
    asked = models.keyed(spark.createDataFrame([("p",), ("p",), ("q",)], "prompt string"), "stub", "m")
    cache = asked.limit(0).select("key").withColumn("reply", asked["key"])
    fresh = models.complete(asked, cache, lambda: lambda p, s: p.upper())
    assert sorted(r["reply"] for r in fresh.collect()) == ["P", "Q"]
    assert models.misses(asked, fresh).count() == 0


def test_prompts(spark):
    q = spark.createDataFrame([("a", "why 100%?"), ("b", "what?")], "query_id string, question string")
    lines = spark.createDataFrame([("a", 1, 1, "[r1] (figure on page 1 of D) figure region"), ("a", 0, 1, "[c1] (text) body %s")], "query_id string, part int, rank int, line string")
    got = {r["query_id"]: r for r in evidence.stub_answers(evidence.prompts(q, lines)).collect()}
    assert got["a"]["evidence"].startswith("[c1] (text) body %s\n\n[r1]") and "[c1]" in got["a"]["prompt"]
    assert got["b"]["prompt"] is None and got["b"]["answer"] == "Not stated in the provided context."


def test_questions(spark):
    from pyspark.sql import functions as F

    pool = spark.createDataFrame([("text_answerable", f"s{i}", "D", ["r"], "alpha beta gamma", "p") for i in range(4)], "query_type string, source string, doc_id string, gold_region_ids array<string>, passage string, prompt string")
    reply = F.when(F.col("source") == "s0", F.lit('{"question": "alpha beta gamma"}')).when(F.col("source") == "s1", "bad").otherwise('{"question": "entirely different words"}')
    got = questions.accepted(pool.withColumn("reply", reply), 5)
    assert sorted(r["qa_id"] for r in got.collect()) == ["text_0000", "text_0001"]
    assert {r["query_type"]: r["n"] for r in questions.statistics(got).collect()} == {"text_answerable": 2, "total": 2}


def test_settings():
    assert Settings.from_mapping({"retrieval": {"top_k": 3}}).retrieval.top_k == 3
    assert Settings.load("/nowhere.yaml") == Settings()
    for bad in ({"nope": {}}, {"retrieval": {"nope": 1}}, {"retrieval": {"top_k": 0}}, {"llm": {"temperature": 0.5}}, {"chunk": {"overlap_chars": 900}}, {"eval": {"primary_k": 4}}):
        with pytest.raises(SettingsError):
            Settings.from_mapping(bad)
    assert Chunking().strategy == "region"


def test_a_settings_file_of_all_sections(tmp_path):
    (tmp_path / "s.yaml").write_text(
        "seed: 42\npaths: {data_dir: d, cache_dir: c}\ningest: {dataset_url_template: 'x-{i:06d}.tar', tesseract_cmd: ''}\nmodels: {text_embed_model: m, embed_batch_size: 8, device: auto, enable_captions: false}\n"
        "llm: {backend: ollama, local_model: q, cache_enabled: true, base_url: '', api_key_env: ''}\nretrieval: {use_bm25_floor: true}\n"
        "kg: {entity_types: [method, metric], max_regions_for_extraction: 9}\neval: {n_questions_per_type: 3, judge_enabled: true, judge_sample_size: 4, include_random_floor: false}\n"
    )
    s = Settings.load(tmp_path / "s.yaml")
    assert (s.paths.data_dir, s.models.embed_batch_size, s.kg.max_regions_for_extraction, s.eval.judge_sample_size) == ("d", 8, 9, 4)


def test_graph_steps_hold_some_regions_at_a_time(spark, monkeypatch):
    text = "We train a CNN on the Atlas9 dataset; the recall of %d.5%% is given in Table %d."
    rows = [(f"R{i // 2:04d}", text % (i % 90, i % 7)) for i in range(2000)]  # two rows for each id
    one_file = spark.createDataFrame(rows, "region_id string, text string").coalesce(1)
    whole = sorted(map(str, extraction.mentions(one_file).collect()))
    monkeypatch.setattr(extraction, "TASK_REGIONS", 100, raising=False)
    monkeypatch.setattr(graph, "TASK_MENTIONS", 500, raising=False)
    found = extraction.mentions(one_file)
    assert sorted(map(str, found.collect())) == whole
    by_task = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(by_task) >= 10 and max(by_task) <= len(whole) / 5
    nodes = {r["id"]: r["source_region_ids"] for r in graph.build_nodes(found).collect()}
    assert nodes["method:cnn"] == ["R0000"] and nodes["finding:recall = 89.5%"] == ["R0044"]
    edges = graph.build_edges(extraction.relations(one_file, found), graph.build_nodes(found), "last").collect()
    assert {(r["head"], r["tail"]): r["source_region_id"] for r in edges}["method:cnn", "metric:recall"] == "R0999"


def test_rows_of_windows_carry_no_page(spark):
    rows = [("D_0#r%03d" % i, "D", "0", "text", (0.0, 10.0 * i, 100.0, 9.0), f"line {i} " + "word " * 60, None, None) for i in range(40)]
    found = regions.window_chunks(spark.createDataFrame(rows, REGIONS))

    def nodes(plan):
        yield plan
        for i in range(plan.children().length()):
            yield from nodes(plan.children().apply(i))

    opened = [p for p in nodes(found._jdf.queryExecution().optimizedPlan()) if p.nodeName() == "Generate"]
    assert opened and all("whole#" not in p.output().mkString(" ") and "parts#" not in p.output().mkString(" ") for p in opened)
    whole = " ".join(r[5].strip() for r in rows)
    got = found.orderBy("chunk_id").collect()
    assert [r["text"] for r in got] == [whole[i : i + 900].strip() for i in range(0, len(whole), 750) if len(whole[i : i + 900].strip()) >= 40]
    assert got[0]["source_region_ids"] == ["D_0#r000", "D_0#r001", "D_0#r002"]
