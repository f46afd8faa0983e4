"""Every catalogue query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from lodewright import catalog, catalog_systems, registry, schema  # noqa: F401
from lodewright.conf import Settings, SettingsError
from lodewright.plans import evaluation, systems

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        return round(float(v), 5) if isinstance(v, float) or hasattr(v, "dtype") else v

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(cell(v) for v in row) for row in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    if name not in registry.ORACLE_SQL:
        assert got.count() > 0
        return
    got, want = got.toPandas(), duck.execute(registry.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got), plain(want)
    assert len(a) == len(b)
    number = lambda v: float(v) if isinstance(v, (int, float, bool)) else v
    assert [tuple(map(number, r)) for r in a] == [tuple(map(number, r)) for r in b]


def test_entry(spark):
    report = catalog_systems.eval_four_systems(spark, DATA)
    assert {r["system"] for r in report.collect()} == {"baseline_text_rag", "enhanced_multimodal_kg", "bm25_lexical_floor", "random_floor"}


def test_one_question_is_answered(spark):
    chunks = spark.createDataFrame([("c1", "d", "0", "random forest accuracy", ["r1"]), ("c2", "d", "0", "nothing of that kind", ["r2"])], schema.CHUNKS)
    regions = spark.createDataFrame([], schema.REGIONS)
    c = systems.Corpus(chunks, regions, systems.embed(chunks, "chunk_id"))
    (row,) = systems.all_of(c)[systems.BASELINE].ask("Which accuracy has the random forest?").collect()
    assert row["evidence"].startswith("[c1] (text) random forest") and row["answer"].startswith("Stub answer")


def test_payload_and_judge_sample(spark):
    rows = [("a", "overall", 2, 0.5, 0.5), ("a", "x", 1, 1.0, 1.0), ("b", "overall", 2, 0.75, 0.5), ("b", "x", 1, 0.5, 0.5)]
    report = spark.createDataFrame(rows, "system string, segment string, n long, recall_5 double, mrr double")
    answers = spark.createDataFrame([("a", f"q{i}", "why?", "see [c1]" if i else "not stated", 0.5, i > 0, None, ["c1"]) for i in range(9)], "system string, qa_id string, question string, answer string, latency_s double, has_evidence boolean, gold_answer string, retrieved array<string>")
    asked = evaluation.judge_prompts(answers, 4)
    assert asked.count() == 4 and "[c1]" in asked.first()["prompt"] and "(not available)" in asked.first()["prompt"]
    known = spark.createDataFrame([("c1",)], "id string")
    judged = spark.createDataFrame([("a", '{"faithfulness": 1, "relevance": 0.5}'), ("a", "no json")], "system string, reply string")
    made = evaluation.answer_report(answers, known, judged)
    (row,) = made.collect()
    assert (row["n"], row["support_rate"], row["citation_validity"], row["faithfulness_mean"], row["relevance_n"], row["mean_latency_s"]) == (9, 1.0, 1.0, 1.0, 1, 0.5)
    out = evaluation.payload(Settings(), report, made, "a", "b")
    assert out["deltas"]["overall"] == {"recall_5": 0.25, "mrr": 0.0} and out["systems"]["a"]["answers"]["n"] == 9 and out["systems"]["b"]["by_segment"]["x"]["n"] == 1 and out["n_questions"] == 2


def test_headline_results_need_a_model():
    with pytest.raises(SettingsError):
        evaluation.refuse_stub(Settings())
    evaluation.refuse_stub(Settings(), allow_stub=True)


def test_answers_of_texts_alone_build_no_graph(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("the graph is not needed")

    monkeypatch.setattr(catalog_systems.extraction, "mentions", refuse)
    assert catalog_systems.eval_answers(spark, DATA).count() == 1
