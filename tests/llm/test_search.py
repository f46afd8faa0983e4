"""Near duplicates and nearest neighbours against brute force."""

import random
import re

import numpy as np
import pytest

from lodewright.llm import anisotropic_ann as ann
from lodewright.llm import common
from lodewright.llm import minhash_forest as forest

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def components(texts, width, percent):
    sets = {}
    for i, t in texts:
        w = WORDS.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if 100 * min(len(sets[a]), len(sets[b])) < percent * max(len(sets[a]), len(sets[b])):
                continue
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def family(r, n, size=120, edits=4):
    base = [f"w{r.randint(0, 10**6)}" for _ in range(size)]
    out = [" ".join(base)]
    for _ in range(n - 1):
        words = list(base)
        for _ in range(r.randint(0, edits)):
            words[r.randrange(size)] = f"x{r.randint(0, 10**6)}"
        out.append(" ".join(words).upper() if r.random() < 0.2 else "\t".join(words))
    return out


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_groups_are_those_of_brute_force(spark, width, percent):
    r = random.Random(9)
    texts = [t for n in (1, 2, 5, 60) for t in family(r, n)] + ["a b c d"] * 5 + ["a b", "A B", "", " ", "one", None, "One"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 3, "z") for i, t in rows], "doc_id long, text string, a long, component_id string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in forest.groups(df, width, percent).collect()}
    want = components(rows, width, percent)
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_one_of_each_group_and_odd_rows(spark):
    schema = "doc_id long, text string, __row string"
    df = spark.createDataFrame([(2, "a b c d e f", "p"), (1, "A b c d e f", "q"), (1, "A b c d e f", "q"), (3, None, "r"), (None, "lonely text here", "s")], schema)
    out = forest.one_of_each_group(df)
    assert out.columns == df.columns
    assert sorted(((x["doc_id"] or 0), x["text"]) for x in out.collect() if x["text"]) == [(0, "lonely text here"), (1, "A b c d e f")]
    assert forest.groups(df.limit(0)).count() == 0 and forest.one_of_each_group(df.limit(0)).count() == 0


def test_null_and_repeated_ids_are_kept_by_their_texts(spark):
    rows = [(None, "one text of its own"), (None, "another text with other words"), (5, "first text under five"), (5, "second and different under five"), (None, "first text under FIVE")]
    out = forest.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x["doc_id"] or 0, x["text"]) for x in out) == sorted((i or 0, t) for i, t in rows[:4])


def star(r, n, size=1000, edits=20):
    """(doc_id, text) of a text and n copies of it, each linked to it and mostly not to another; the text has the largest id."""
    base = [f"w{k}" for k in range(size)]
    rows = []
    for i in range(n):
        words = list(base)
        for k in r.sample(range(size), edits):
            words[k] = f"x{r.randint(0, 10**9)}"
        rows.append((i, " ".join(words)))
    return [*rows, (n, " ".join(base))]


def test_a_text_meets_each_of_its_many_copies(spark):
    rows = star(random.Random(4), 1200)
    got = forest.groups(spark.createDataFrame(rows, "doc_id long, text string")).select("component_id").distinct().collect()
    assert [x["component_id"] for x in got] == [0]


def test_regions_go_on_over_the_borders_of_ranges(spark, monkeypatch):
    monkeypatch.setattr(forest, "ROWS_PER_RANGE", 2)
    rows = star(random.Random(8), 14)
    got = forest.groups(spark.createDataFrame(rows, "doc_id long, text string")).select("component_id").distinct().collect()
    assert [x["component_id"] for x in got] == [0]


@pytest.mark.parametrize("block", [512, 16])
def test_members_that_no_hub_links_all_meet(spark, monkeypatch, block):
    monkeypatch.setattr(forest, "BLOCK", block)
    r = random.Random(6)
    base = [f"w{k}" for k in range(1000)]
    rows = []
    for pair in range(60):  # two near copies each of a text that is not there, 80 words from the other pairs' texts
        words = list(base)
        for k in r.sample(range(1000), 80):
            words[k] = f"x{r.randint(0, 10**9)}"
        for i in range(2):
            words[r.randrange(1000)] = f"y{r.randint(0, 10**9)}"
            rows.append((2 * pair + i, " ".join(words)))
    got = {x["doc_id"]: x["component_id"] for x in forest.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 2 * 2 for i in range(120)}


def test_shared_shingles_are_counted_exactly():
    rng = np.random.default_rng(5)
    common_part = rng.integers(0, 1 << 62, 3000, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(common_part, 400), rng.integers(0, 1 << 62, 90, dtype=np.uint64)])) for _ in range(60)]
    sets += [sets[3], np.zeros(0, np.uint64), sets[5][:50]]
    x = forest.Block.of([(i, i, v.tobytes()) for i, v in enumerate(sets)])
    y = forest.Block.of([(i, i, v.tobytes()) for i, v in enumerate(sets[20:], 20)])
    want = [[len(np.intersect1d(a, b)) for b in sets[20:]] for a in sets]
    assert forest.shared(x, y).tolist() == want
    links = forest.linked(x, y, 10)
    tied = forest.spanning(links, x, y).to_pydict()
    assert 0 < len(tied["a"]) < 2 * len(sets)
    for a, b in zip(tied["a"], tied["b"], strict=True):
        both = len(np.intersect1d(sets[a], sets[b]))
        assert a < b and 100 * both >= 10 * (len(sets[a]) + len(sets[b]) - both)


def test_rows_of_one_id_cost_one_set_each_text(spark):
    rows = [(1, "one text of the same words as others have")] * 300 + [(1, "quite another text under the same id here")] * 300 + [(2, "ONE text of the same words as others have")]
    got = forest.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 601 and {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(1, 1, True), (2, 1, False)}


def test_all_links_of_real_texts_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = components([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 5, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in forest.groups(docs, 5, 80).collect()}
    assert got == want


@pytest.mark.parametrize("local", [1_000_000, 0])
def test_components_of_long_chains(spark, monkeypatch, local):
    monkeypatch.setattr(forest, "LOCAL_LINKS", local)
    chain = [(i, i + 1) for i in range(100, 140)] + [(1, 2)]
    with common.Scratch(spark) as scratch:
        links = lambda rows: spark.createDataFrame(rows, "a long, b long")
        labels = forest.components(links(chain), scratch)
        assert {r["node"]: r["component"] for r in labels.collect()} == {i: 100 for i in range(100, 141)} | {1: 1, 2: 1}
        more = forest.relabelled(labels, links([(2, 120), (7, 9), (139, 140), (9, 50)]), scratch)
        assert {r["node"]: r["component"] for r in more.collect()} == {i: 1 for i in [1, 2, *range(100, 141)]} | {7: 7, 9: 7, 50: 7}


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")


@pytest.mark.parametrize("group_rows", [1 << 20, 700])
def test_recall_and_exact_scores(spark, monkeypatch, group_rows):
    monkeypatch.setattr(ann, "GROUP_ROWS", group_rows)
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(30, 24))[rng.integers(0, 30, 3000)] + 0.6 * rng.normal(size=(3000, 24))).astype(np.float32)
    x *= rng.uniform(0.5, 2, (3000, 1)).astype(np.float32)
    rows = [(i, x[i].tolist(), "r") for i in range(3000)]
    df = frame(spark, rows)
    got = ann.search(df, ann.query_ids(df["vec_id"])).collect()
    d = x.astype(np.float64)
    hits = 0
    for q in range(0, 3000, 20):
        s = d @ d[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(3000), -s))[:20]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and all(r["score"] == pytest.approx(s[r["vec_id"]], rel=1e-12) for r in mine)
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(best.tolist()))
    assert hits / (150 * 20) >= 0.95


def _spread(kind, rng, n, dim):
    x = rng.normal(size=(n, dim))
    if kind == "close clusters":
        return rng.normal(size=(4, dim))[rng.integers(0, 4, n)] + 0.002 * x
    if kind == "lengths of many orders":
        return x * np.exp(2 * rng.normal(size=(n, 1)))
    if kind == "few directions":
        return x * np.exp(-np.arange(dim) / 3)
    return x * np.where(np.arange(n) % 7, 1e-30, 1e30)[:, None]


@pytest.mark.parametrize("kind", ["close clusters", "lengths of many orders", "few directions", "far scales"])
def test_recall_on_rows_that_codes_tell_little_of(spark, kind):
    n, dim = 9000, 32
    x = _spread(kind, np.random.default_rng(3), n, dim)
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "vec_id long, embedding array<double>")
    asks = df["vec_id"] % 100 == 0
    found = {}
    for r in ann.search(df, asks, keep=20).collect():
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    hits = 0
    for q in range(0, n, 100):
        s = x @ x[q]
        s[q] = -np.inf
        last = np.sort(s)[-20]
        assert len(found[q]) == 20 and all(a == pytest.approx(s[i], rel=1e-9, abs=1e-12 * abs(last)) for a, i in found[q])
        hits += sum(a >= last - 1e-9 * abs(last) for a, _ in found[q])
    assert hits / (20 * n / 100) >= 0.99


def test_close_clusters_with_as_many_candidates_as_the_rule_keeps(spark):
    n = 12000
    x = _spread("close clusters", np.random.default_rng(5), n, 16)
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "vec_id long, embedding array<double>")
    got = ann.search(df, df["vec_id"] % 200 == 0).groupBy("query_id").min("score").collect()
    assert len(got) == 60 and all(r[1] >= np.sort(np.delete(x @ x[r[0]], r[0]))[-20] - 1e-9 for r in got)


def test_an_id_that_fills_the_first_candidates(spark):
    rng = np.random.default_rng(6)
    rows = [(0, [1.0, 0.0])] + [(1, [9.0, float(y)]) for y in rng.normal(size=9000)] + [(i, [float(i), 1.0]) for i in range(2, 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in ann.search(df, df["vec_id"] == 0, k=5).orderBy("rank").collect()]
    assert got == [(1, 1, 9.0), (2, 7, 7.0), (3, 6, 6.0), (4, 5, 5.0), (5, 4, 4.0)]


def test_more_candidates_are_kept_of_larger_tables():
    assert [ann.kept(n) for n in (10, 50_000, 200_000, 5_000_000)] == [400, 400, 800, 4000]


def test_ties_across_the_cut_go_to_smaller_ids(spark):
    df = frame(spark, [(i, [1.0, 0.0] if i else [2.0, 0.0], "r") for i in range(60, -1, -1)])
    got = [(r["rank"], r["vec_id"]) for r in ann.search(df, df["vec_id"] == 0).orderBy("rank").collect()]
    assert got == [(i, i) for i in range(1, 21)]


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0, 2.0], "a"), (1, [2.0, 1.0], "a"), (2, None, "a"), (3, [0.0, 0.0], "a"), (4, [float("nan"), 1.0], "a"), (5, [float("inf"), 1.0], "a"), (6, [1.0, None], "a"), (7, [1.0], "a"), (None, [1.0, 1.0], "a"), (8, [2.0, 1.0], "b"), (20, None, "c"), (8, [2.0, 1.0], "b")]
    df = frame(spark, rows)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(df, ann.query_ids(df["vec_id"])).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 4.0), (0, 2, 8, 4.0)]
    assert ann.search(df.limit(0), ann.query_ids(df["vec_id"])).count() == 0
    lone = frame(spark, [(0, [1.0, 1.0], "a")])
    assert ann.search(lone, ann.query_ids(lone["vec_id"])).count() == 0


def test_anisotropic_loss_favours_the_direction_of_the_vector():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    def along(book):
        v = book._split(x)
        e = (v - book.centers[np.arange(book.parts), book.encode(x)]).reshape(len(x), -1)[:, :16]
        return float(((e * x).sum(1) ** 2).mean())

    assert along(ann.Codebook(16, 0.5).fit(x)) < along(ann.Codebook(16, 0.0).fit(x))
