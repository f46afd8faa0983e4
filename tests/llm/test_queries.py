"""The registered queries on small tables, and the pipeline's stages one after the other."""

import collections

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from lodewright.llm import chat_format, common, license_scan, minhash_forest, mixing, pretokens, quality_rules, queries
from test_search import WORDS, components

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.execute(queries.ORACLE_SQL[name]).fetchdf()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda df: sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


def test_stages(spark):
    docs = common.table(spark, DATA, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stage(stage(spark, docs, DATA), f"test-{name}")
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "mixing", "packing"]
    assert sizes[0] > sizes[1] > 0 and sizes[1] >= sizes[2] > 0 and sizes[4] > 0


def test_stages_take_empty_and_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, taken long"
    for rows in ([], [(1, None, None, None, None, 1), (1, "", "en", "s", 0, 2), (None, "w " * 30 + "end.", None, "s", 62, 3)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = common.stage(stage(spark, docs, DATA), f"odd-{name}")


def test_stages_against_brute_force(spark):
    docs = common.stage(corpus_pipeline.quality(spark, common.table(spark, DATA, "documents"), DATA), "brute-quality")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    first = components(rows, 5, 80)
    kept = common.stage(corpus_pipeline.near_duplicates(spark, docs, DATA), "brute-near")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in first.items() if i == c)

    mixed = common.stage(corpus_pipeline.source_mixing(spark, kept, DATA), "brute-mix")
    whole = {r["doc_id"]: r for r in kept.collect()}
    sizes, taken = collections.Counter(), collections.Counter()
    for r in whole.values():
        sizes[r["source"]] += len(WORDS.findall(r["text"]))
    for r in mixed.collect():
        assert whole[r["doc_id"]]["text"].startswith(r["text"]) and r["n_chars"] == len(r["text"])
        taken[r["source"]] += len(WORDS.findall(r["text"]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    want, free, left = {}, set(order), float(sum(sizes.values()))
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            break
        want |= {s: 3.0 * sizes[s] for s in over}
        left, free = left - sum(3 * sizes[s] for s in over), free - over
    want |= {s: weight[s] * level for s in free}
    assert all(abs(taken[s] - want[s]) <= 2 for s in order)

    pieces = collections.defaultdict(list)
    for r in corpus_pipeline.sequence_packing(spark, mixed, DATA).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
    library = pretokens.encoder(queries.tokenizer_path("word_bpe_49k.json")).library
    tokens = collections.Counter()
    for r in mixed.collect():
        tokens[r["doc_id"]] += len(library.encode(r["text"], add_special_tokens=False).ids) + 1
    assert {i: sum(p[1] for p in ps) for i, ps in pieces.items()} == tokens


def test_very_long_texts_are_taken_whole(spark):
    words = [f"w{i}" for i in range(200_000)]
    body = "\n".join(" ".join(words[i : i + 10]) + "." for i in range(0, len(words), 10))
    rows = [(1, body, "en", "s", len(body)), (2, body + " more.", "en", "t", len(body) + 6), (3, "short text", "en", "s", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_forest.groups(docs).collect()}
    assert near == {1: (199_998, 1), 2: (199_999, 1), 3: (1, 3)}
    judged = {r["doc_id"]: (r["n_words"], r["kept"]) for r in quality_rules.assess(docs).collect()}
    assert judged == {1: (200_000, True), 2: (200_001, True), 3: (2, False)}
    assert sum(r["taken"] for r in mixing.words_taken(docs).collect()) == pytest.approx(400_003, abs=3)
    assert {r["doc_id"]: r["license_id"] for r in license_scan.scan(docs).collect()} == {1: None, 2: None, 3: None}
    said = spark.createDataFrame([(1, 0, "assistant", body)], "conv_id long, turn long, role string, text string")
    shown = chat_format.render(chat_format.fold(chat_format.events_of_turns(said)))
    assert shown.select(chat_format.masked(F.col("formatted"), F.col("loss_spans"))).first()[0] == body
