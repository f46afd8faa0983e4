"""The catalogue: queries of single operators, each with DuckDB SQL of the same result; systems are in ``catalog_systems``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog_sql as S
from . import inputs as I
from .conf import Graph
from .functions import boxes, text, vectors
from .operators import dense, evidence, extraction, fusion, graph, lexical, metrics, models, questions, regions
from .registry import query
from .staging import stage

def joined(ids: str):
    return F.array_join(F.col(ids), ",")


# ------------------------------------------------------------------ layout pages


def layout_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each order: its lines as JSON annotations, some of unknown type, some outside the page."""
    li = I.table(spark, sf_dir, "lineitem")
    whole = lambda c: F.floor(c + 0.5).cast("double")
    box = F.array(F.col("l_quantity") * 10, whole(F.col("l_discount") * 1000), whole(F.floor("l_extendedprice") / 128), whole(F.col("l_tax") * 5000))
    one = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.struct(box.alias("bbox"), (F.col("l_linenumber") % 7).alias("category_id")).alias("a"))
    grouped = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(one)).alias("l"))
    payload = F.to_json(F.struct(F.transform("l", lambda x: x["a"]).alias("annotations")))
    return grouped.select(F.format_string("ORD_%d", "l_orderkey").alias("key"), F.lit(400).alias("width"), F.lit(60).alias("height"), payload.alias("payload"))


_LAYOUT = """WITH a AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, floor(l_discount * 1000 + 0.5), floor(floor(l_extendedprice) / 128 + 0.5), floor(l_tax * 5000 + 0.5)) - 1 AS idx, l_linenumber % 7 AS cat,
  l_quantity * 10 AS x, floor(l_discount * 1000 + 0.5) AS y, floor(floor(l_extendedprice) / 128 + 0.5) AS w, floor(l_tax * 5000 + 0.5) AS h FROM lineitem),
c AS (SELECT *, least(greatest(x, 0), 400) AS x0, least(greatest(y, 0), 60) AS y0, least(greatest(x + w, 0), 400) AS x1, least(greatest(y + h, 0), 60) AS y1 FROM a WHERE cat BETWEEN 1 AND 5),
k AS (SELECT *, greatest(0, x1 - x0) AS cw, greatest(0, y1 - y0) AS ch FROM c)"""


@query(_LAYOUT + """ SELECT printf('ORD_%d#r%03d', l_orderkey, idx) AS region_id, 'ORD' AS doc_id, l_orderkey::VARCHAR AS page_id,
  (['text', 'title', 'list', 'table', 'figure'])[cat] AS region_type, round(x0, 4) AS x, round(y0, 4) AS y, round(cw, 4) AS w, round(ch, 4) AS h, round(cw * ch, 2) AS area
  FROM k WHERE cw >= 8 AND ch >= 8""")
def region_parse_clip(spark, sf_dir):
    r = regions.parse(layout_pages(spark, sf_dir))
    return r.select("region_id", "doc_id", "page_id", "region_type", *[F.round(F.col(f"bbox.{c}"), 4).alias(c) for c in "xywh"], F.round(boxes.area(F.col("bbox")), 2).alias("area"))


@query(_LAYOUT + " SELECT (SELECT count(*) FROM a) AS total, count(*) AS kept, (SELECT count(*) FROM a) - count(*) AS dropped FROM k WHERE cw >= 8 AND ch >= 8")
def region_parse_stats(spark, sf_dir):
    pages = layout_pages(spark, sf_dir)
    return regions.parse_statistics(pages, regions.parse(pages))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'PMC' || o_custkey WHEN 1 THEN 'A_B' ELSE 'NoSuffix' || o_orderkey END AS doc_id,
  CASE o_orderkey % 3 WHEN 2 THEN '0' ELSE o_orderkey::VARCHAR END AS page_id FROM orders""")
def key_split(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    key = F.when(k % 3 == 0, F.concat(F.lit("PMC"), c, F.lit("_"), k)).when(k % 3 == 1, F.concat(F.lit(" A_B_"), k)).otherwise(F.concat(F.lit("NoSuffix"), k))
    return I.table(spark, sf_dir, "orders").select("o_orderkey", boxes.key_parts(key).alias("p")).select("o_orderkey", "p.*")


@query("""SELECT l_orderkey, l_linenumber, (CASE WHEN crop THEN x0 END)::INT AS x0, (CASE WHEN crop THEN y0 END)::INT AS y0, (CASE WHEN crop THEN x1 END)::INT AS x1, (CASE WHEN crop THEN y1 END)::INT AS y1
  FROM (SELECT *, x1 > x0 AND y1 > y0 AS crop FROM (SELECT l_orderkey, l_linenumber, greatest(0, round_even(l_quantity / 2, 0)) AS x0, greatest(0, round_even(l_quantity, 0)) AS y0,
    least(30, round_even(l_quantity / 2 + l_linenumber, 0)) AS x1, least(20, round_even(l_quantity + 5, 0)) AS y1 FROM lineitem))""")
def crop_geometry(spark, sf_dir):
    b = boxes.box(F.col("l_quantity") / 2, F.col("l_quantity"), F.col("l_linenumber"), F.lit(5.0))
    out = I.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", boxes.crop(b, F.lit(30), F.lit(20)).alias("c"))
    return out.select("l_orderkey", "l_linenumber", *[F.col(f"c.{n}").alias(n) for n in ("x0", "y0", "x1", "y1")])


# ------------------------------------------------------------------ text and chunks


@query("""SELECT doc_id, md5(trim(regexp_replace('significant fi and ffl ' || text, '\\s+', ' ', 'g'))) AS cleaned FROM documents""")
def clean_text(spark, sf_dir):
    raw = F.concat(F.lit("signi-  ficant ﬁ\nand \t ﬄ "), F.col("text"))
    return I.table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_ocr(raw)).alias("cleaned"))


@query("""SELECT lang, count(*) AS attempted, count(*) FILTER (n = 0) AS empty, count(*) FILTER (n > 0 AND n < 60) AS below_min_chars, round(count(*) FILTER (n = 0) / count(*), 4) AS empty_rate,
  round(count(*) FILTER (n >= 60) / count(*), 4) AS usable_rate, round(avg(quality) FILTER (n > 0), 4) AS mean_confidence
  FROM (SELECT d.lang, length(trim(d.text)) AS n, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) GROUP BY lang""")
def ocr_stats_by_lang(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents").join(I.table(spark, sf_dir, "labels"), "doc_id", "left")
    read = d.select("lang", F.lit("text").alias("region_type"), "text", F.col("quality").cast("double").alias("ocr_confidence"))
    return regions.reading_statistics(read, "lang", min_chars=60)


_CHUNKED = "WITH " + I.REGIONS_SQL + ", ch AS (SELECT region_id || '#c0' AS chunk_id, doc_id, trim(text) AS text, region_id FROM regions WHERE region_type IN ('text', 'title', 'list') AND length(trim(text)) >= 40)"


@query(_CHUNKED + " SELECT chunk_id, doc_id, md5(text) AS text_md5, region_id AS sources FROM ch")
def region_chunks(spark, sf_dir):
    c = regions.region_chunks(I.regions(spark, sf_dir))
    return c.select("chunk_id", "doc_id", F.md5("text").alias("text_md5"), joined("source_region_ids").alias("sources"))


_WINDOWS = "WITH " + I.REGIONS_SQL + """, u AS (SELECT *, trim(text) AS t FROM regions WHERE region_type IN ('text', 'title', 'list') AND length(trim(text)) >= 20),
sp AS (SELECT doc_id, region_id, t, i, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM u),
pg AS (SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS whole FROM u GROUP BY doc_id),
w AS (SELECT doc_id, whole, unnest(range(0, greatest(1, length(whole)), 750)) AS f FROM pg),
v AS (SELECT doc_id, f, f // 750 AS n, substr(whole, f + 1, 900) AS win FROM w),
kept AS (SELECT * FROM v WHERE length(trim(win)) >= 40)"""


@query(_WINDOWS + """ SELECT printf('%s_0#w%03d', k.doc_id, k.n) AS chunk_id, k.doc_id, md5(trim(k.win)) AS text_md5,
  coalesce((SELECT string_agg(s.region_id, ',' ORDER BY s.i) FROM sp s WHERE s.doc_id = k.doc_id AND s.s < k.f + length(k.win) AND s.s + length(s.t) > k.f), '') AS sources FROM kept k""")
def window_chunks(spark, sf_dir):
    c = regions.window_chunks(I.regions(spark, sf_dir))
    return c.select("chunk_id", "doc_id", F.md5("text").alias("text_md5"), joined("source_region_ids").alias("sources"))


@query(_WINDOWS + " SELECT s.region_id, count(*) AS n_chunks FROM sp s JOIN kept k ON s.doc_id = k.doc_id AND s.s < k.f + length(k.win) AND s.s + length(s.t) > k.f GROUP BY 1")
def window_chunk_sources(spark, sf_dir):
    c = regions.window_chunks(I.regions(spark, sf_dir))
    return c.select(F.explode("source_region_ids").alias("region_id")).groupBy("region_id").agg(F.count(F.lit(1)).alias("n_chunks"))


@query(_CHUNKED + """, broken AS (SELECT * FROM ch UNION ALL SELECT chunk_id, doc_id, ' ', region_id || 'x' FROM ch WHERE ends_with(region_id, '0'))
  SELECT 'no regions' AS rule, (count(*) = 0)::BIGINT AS n FROM regions UNION ALL SELECT 'duplicate region ids', count(*) FROM (SELECT region_id FROM regions GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'duplicate chunk ids', count(*) FROM (SELECT chunk_id FROM broken GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'dangling source regions', count(*) FROM broken WHERE region_id NOT IN (SELECT region_id FROM regions) UNION ALL SELECT 'degenerate boxes', 0
  UNION ALL SELECT 'blank chunks', count(*) FROM broken WHERE trim(text) = ''""")
def corpus_validation(spark, sf_dir):
    r = I.regions(spark, sf_dir)
    c = regions.region_chunks(r)
    bad = c.filter(F.element_at("source_region_ids", 1).endswith("0")).withColumns({"text": F.lit(" "), "source_region_ids": F.transform("source_region_ids", lambda x: F.concat(x, F.lit("x")))})
    return regions.violations(r, c.unionByName(bad))


@query(_CHUNKED + " SELECT count(*) AS regions, count(DISTINCT doc_id) AS documents, count(DISTINCT doc_id) AS pages, count(*) FILTER (region_type IN ('table', 'figure')) AS visual_regions, (SELECT count(*) FROM ch) AS chunks FROM regions")
def corpus_summary(spark, sf_dir):
    r = I.regions(spark, sf_dir)
    return regions.summary(r, regions.region_chunks(r))


# ------------------------------------------------------------------ lexical retrieval


@query("WITH " + S.tokens("documents", "doc_id", "text", "t") + " SELECT (SELECT count(*) FROM documents) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS avgdl, count(*) AS n_tokens FROM t")
def token_stats(spark, sf_dir):
    return lexical.statistics(I.table(spark, sf_dir, "documents")).withColumn("avgdl", F.round("avgdl", 6))


@query("WITH " + S.tokens("documents", "doc_id", "text", "t") + """ SELECT term, count(DISTINCT id) AS df, round(greatest(0, ln(1 + ((SELECT count(*) FROM documents) - count(DISTINCT id) + 0.5) / (count(DISTINCT id) + 0.5))), 6) AS idf FROM t GROUP BY term""")
def idf_table(spark, sf_dir):
    return lexical.document_frequencies(I.table(spark, sf_dir, "documents")).withColumn("idf", F.round("idf", 6))


@query("WITH " + S.tokens("documents", "doc_id", "text", "t") + " SELECT id AS doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2")
def term_frequencies(spark, sf_dir):
    return lexical.term_frequencies(I.table(spark, sf_dir, "documents"))


_BM25 = f"WITH {S.QUESTIONS}, {S.CHUNKS}, {S.bm25('b', 'c', 'chunk_id', 'text', 5)}"


@query(_BM25 + " SELECT query_id, item_id, round(score, 6) AS score, rank::INT AS rank FROM b")
def bm25_topk(spark, sf_dir):
    r = lexical.top_k(I.document_chunks(spark, sf_dir), I.questions(spark, sf_dir), 5, "chunk_id")
    return r.withColumn("score", F.round("score", 6))


@query(f"WITH {S.QUESTIONS}, {S.GOLD}" + """, t AS (SELECT id, list_distinct(list(term)) AS terms FROM (SELECT q.query_id AS id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS term FROM q) WHERE term NOT IN (""" + S._STOP + """) GROUP BY id),
d AS (SELECT id, list_distinct(list(term)) AS terms FROM (SELECT printf('R%07d', doc_id) AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) WHERE term NOT IN (""" + S._STOP + """) GROUP BY id)
SELECT g.query_id, g.region_id, round(len(list_intersect(t.terms, d.terms)) / len(t.terms), 6) AS overlap, len(list_intersect(t.terms, d.terms)) / len(t.terms) > 0.6 AS rejected FROM gold g JOIN t ON t.id = g.query_id JOIN d ON d.id = g.region_id""")
def lexical_overlap(spark, sf_dir):
    pairs = I.gold(spark, sf_dir).join(I.questions(spark, sf_dir), "query_id").join(I.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    o = text.lexical_overlap(F.col("question"), F.col("text"))
    return pairs.select("query_id", F.format_string("R%07d", "doc_id").alias("region_id"), F.round(o, 6).alias("overlap"), (o > 0.6).alias("rejected"))


# ------------------------------------------------------------------ vectors


@query("""SELECT doc_id, slot::INT AS slot, count(*) AS n FROM (SELECT doc_id, ((instr('0123456789abcdef', substr(md5(t), 31, 1)) - 1) * 16 + instr('0123456789abcdef', substr(md5(t), 32, 1)) - 1) % 64 AS slot
  FROM (SELECT doc_id, regexp_replace(unnest(regexp_split_to_array(lower(text), '\\s+')), '[^\\p{L}\\p{N}]', '', 'g') AS t FROM documents) WHERE t <> '') GROUP BY 1, 2""")
def hash_embed_slots(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(vectors.hash_slots(F.col("text"), 64)).alias("slot")).groupBy("doc_id", "slot").agg(F.count(F.lit(1)).alias("n"))


def _vectors(spark, sf_dir):
    e = I.table(spark, sf_dir, "embeddings")
    items = e.select(F.col("vec_id").alias("item_id"), "embedding", "label")
    return items, e.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("query_label"))


def _half(part: DataFrame, first: bool) -> DataFrame:
    half = F.size("embedding") / 2
    return part.withColumn("embedding", F.slice("embedding", F.lit(1) if first else half.cast("int") + 1, half.cast("int")))


def _two_rankings(spark, sf_dir, k=10):
    items, asked = _vectors(spark, sf_dir)
    return [dense.top_k(_half(items, f), _half(asked, f), k).withColumn("modality", F.lit(m)) for f, m in ((True, "text"), (False, "visual"))]


def _cosine(name: str, vec: str, k: int) -> str:
    return f"""{name} AS (SELECT query_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS item_id, list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) AS score
  FROM (SELECT vec_id, {vec} AS v FROM e WHERE vec_id % 20 = 0) a CROSS JOIN (SELECT vec_id, {vec} AS v FROM e) b)) WHERE rank <= {k})"""


_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_TWO = f"WITH {_E}, {_cosine('a', 'v[1:len(v) // 2]', 10)}, {_cosine('b', 'v[len(v) // 2 + 1:]', 10)}"


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def l2_norms(spark, sf_dir):
    return dense.norms(I.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", F.round("norm", 6).alias("norm"))


@query(f"WITH {_E}, {_cosine('d', 'v', 10)} SELECT query_id, item_id, round(score, 6) AS score, rank::INT AS rank FROM d")
def dense_topk(spark, sf_dir):
    items, asked = _vectors(spark, sf_dir)
    return dense.top_k(items, asked, 10).withColumn("score", F.round("score", 6))


@query(f"WITH {_E}, {_cosine('d', 'v', 5)} SELECT q.label, count(*) AS n, round(avg((i.label = q.label)::INT), 6) AS precision_5 FROM d JOIN e q ON q.vec_id = d.query_id JOIN e i ON i.vec_id = d.item_id GROUP BY 1")
def dense_label_precision(spark, sf_dir):
    items, asked = _vectors(spark, sf_dir)
    hits = dense.top_k(items, asked, 5).join(items.select("item_id", "label"), "item_id").join(asked.select("query_id", "query_label"), "query_id")
    return hits.groupBy(F.col("query_label").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("label") == F.col("query_label")).cast("int")), 6).alias("precision_5"))


def _rrf(weights: tuple[float, float], k: int) -> str:
    return _TWO + f""", u AS (SELECT query_id, item_id, rank, 0 AS s, {weights[0]} AS w, 'text' AS m FROM a UNION ALL SELECT query_id, item_id, rank, 1, {weights[1]}, 'visual' FROM b),
g AS (SELECT query_id, item_id, sum(w / (60 + rank)) AS score, 'fused:' || string_agg(m, '+' ORDER BY s) AS modality, min(s * 1000 + rank) AS seen FROM u GROUP BY 1, 2)
SELECT query_id, item_id, round(score, 6) AS score, modality, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen, item_id) AS rank FROM g) WHERE rank <= {k}"""


@query(_rrf((1.0, 1.0), 10))
def rrf_text_vector(spark, sf_dir):
    return fusion.reciprocal_rank(_two_rankings(spark, sf_dir), 60, top_n=10).withColumn("score", F.round("score", 6))


@query(_rrf((1.0, 0.3), 5))
def rrf_weighted(spark, sf_dir):
    return fusion.reciprocal_rank(_two_rankings(spark, sf_dir), 60, [1.0, 0.3], 5).withColumn("score", F.round("score", 6))


@query(_TWO + " SELECT query_id, item_id, min(rank)::INT AS rank FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2")
def rank_dedupe(spark, sf_dir):
    a, b = _two_rankings(spark, sf_dir)
    return fusion.best_of_each(a.unionByName(b)).select("query_id", "item_id", "rank")


@query(_TWO + """, f AS (SELECT query_id, item_id, min(rank * 2 + m) AS place_at FROM (SELECT *, 0 AS m FROM a UNION ALL SELECT *, 1 FROM b) GROUP BY 1, 2)
  SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY place_at)::INT AS place FROM f""")
def interleave_modalities(spark, sf_dir):
    return fusion.interleaved(*_two_rankings(spark, sf_dir))


# ------------------------------------------------------------------ graph


def _graph(spark, sf_dir):
    r = I.graph_regions(spark, sf_dir)
    m = stage(extraction.mentions(r), "mentions")
    nodes = stage(graph.build_nodes(m), "nodes")
    return m, nodes, stage(graph.build_edges(extraction.relations(r, m), nodes), "edges"), graph.link(I.graph_questions(spark, sf_dir), nodes)


_G = f"WITH {I.GRAPH_REGIONS_SQL}, {I.GRAPH_QUESTIONS_SQL}, {S.graph()}"


@query(_G + " SELECT id, name, entity_type, region_id AS source_region_id FROM nodes")
def kg_entities(spark, sf_dir):
    return _graph(spark, sf_dir)[1].select("id", "name", "entity_type", F.element_at("source_region_ids", 1).alias("source_region_id"))


@query(_G + " SELECT node_id AS id, count(DISTINCT region_id) AS n_regions, min(region_id) AS first_region, max(region_id) AS last_region FROM m GROUP BY 1")
def kg_provenance(spark, sf_dir):
    n = graph.build_nodes(_graph(spark, sf_dir)[0], "accumulate")
    r = F.col("source_region_ids")
    return n.select("id", F.size(r).cast("long").alias("n_regions"), F.element_at(r, 1).alias("first_region"), F.element_at(r, -1).alias("last_region"))


@query(_G + " SELECT head, tail, relation_type, source_region_id FROM edges")
def kg_relations(spark, sf_dir):
    return _graph(spark, sf_dir)[2]


@query(_G + " SELECT head, tail, relation_type, max(region_id) AS source_region_id FROM rel WHERE head IN (SELECT id FROM nodes) AND tail IN (SELECT id FROM nodes) GROUP BY 1, 2, 3")
def kg_edges_last(spark, sf_dir):
    """Edges that name the region of their last statement."""
    r = I.graph_regions(spark, sf_dir)
    m = stage(extraction.mentions(r), "mentions")
    return graph.build_edges(extraction.relations(r, m), graph.build_nodes(m), keep="last")


@query(_G + " SELECT node_id AS id, region_id, row_number() OVER (PARTITION BY node_id ORDER BY region_id)::INT - 1 AS pos FROM (SELECT DISTINCT node_id, region_id FROM m WHERE node_id IN (SELECT node_id FROM seeds))")
def kg_node_regions(spark, sf_dir):
    """All regions of the nodes that questions name."""
    m, _, _, seeds = _graph(spark, sf_dir)
    return graph.regions_of(graph.build_nodes(m, "accumulate"), seeds.select(F.col("node_id").alias("id")))


@query("WITH " + I.REGIONS_SQL + " SELECT region_id, md5(text) AS text_md5 FROM regions WHERE region_type IN ('text', 'title', 'list') AND text <> '' ORDER BY region_id LIMIT 400")
def kg_input(spark, sf_dir):
    """The regions that extraction by a language model is asked about: the first 400 with text, which is the setting's meaning."""
    return regions.graph_input(I.regions(spark, sf_dir), Graph().max_regions_for_extraction).select("region_id", F.md5("text").alias("text_md5"))


@query(_G + " SELECT region_id, name AS finding FROM m WHERE entity_type = 'finding'")
def kg_findings(spark, sf_dir):
    return _graph(spark, sf_dir)[0].filter("entity_type = 'finding'").select("region_id", F.col("name").alias("finding"))


@query(_G + " SELECT 'node' AS kind, entity_type AS type, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', relation_type, count(*) FROM edges GROUP BY 2")
def kg_stats(spark, sf_dir):
    _, nodes, edges, _ = _graph(spark, sf_dir)
    return graph.statistics(nodes, edges)


@query(_G + " SELECT query_id, node_id, rank::INT AS rank FROM seeds")
def kg_link(spark, sf_dir):
    return _graph(spark, sf_dir)[3]


@query(_G + " SELECT query_id, node_id, depth::INT AS depth FROM reach1")
def kg_expand_1(spark, sf_dir):
    _, nodes, edges, seeds = _graph(spark, sf_dir)
    return graph.expand(seeds, nodes, edges, 1)


@query(_G + " SELECT query_id, node_id, depth::INT AS depth FROM reach2")
def kg_expand_2(spark, sf_dir):
    _, nodes, edges, seeds = _graph(spark, sf_dir)
    return graph.expand(seeds, nodes, edges, 2)


@query(_G + """ SELECT query_id, n::INT AS n, path FROM (SELECT s.query_id, row_number() OVER (PARTITION BY s.query_id ORDER BY s.rank, w.v) AS n, s.node_id || ' > ' || w.v AS path FROM seeds s JOIN ways w ON w.u = s.node_id AND w.v <> s.node_id) WHERE n <= 5""")
def kg_paths(spark, sf_dir):
    _, nodes, edges, seeds = _graph(spark, sf_dir)
    return graph.paths(seeds, nodes, edges, 1).select("query_id", "n", F.array_join("path", " > ").alias("path"))


@query(_G + """, s0 AS (SELECT query_id, rank AS sr, node_id FROM seeds),
one AS (SELECT query_id, sr, w.v AS target, min(s0.node_id || ' > ' || w.v) AS path FROM s0 JOIN ways w ON w.u = s0.node_id AND w.v <> s0.node_id GROUP BY 1, 2, 3),
two AS (SELECT o.query_id, o.sr, w.v AS target, min(o.path || ' > ' || w.v) AS path FROM one o JOIN s0 ON s0.query_id = o.query_id AND s0.sr = o.sr JOIN ways w ON w.u = o.target AND w.v <> o.target AND w.v <> s0.node_id
  WHERE NOT EXISTS (SELECT 1 FROM one x WHERE x.query_id = o.query_id AND x.sr = o.sr AND x.target = w.v) GROUP BY 1, 2, 3)
SELECT query_id, n::INT AS n, path FROM (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY sr, target) AS n FROM (SELECT * FROM one UNION ALL SELECT * FROM two)) WHERE n <= 40""")
def kg_paths_2(spark, sf_dir):
    """Paths of up to two edges."""
    _, nodes, edges, seeds = _graph(spark, sf_dir)
    return graph.paths(seeds, nodes, edges, 2, 40).select("query_id", "n", F.array_join("path", " > ").alias("path"))


@query(_G + """, o AS (SELECT r.query_id, n.region_id, min(((s.node_id IS NOT NULL)::INT)::VARCHAR || r.node_id) AS place_at FROM reach1 r JOIN nodes n ON n.id = r.node_id LEFT JOIN seeds s ON s.query_id = r.query_id AND s.node_id = r.node_id GROUP BY 1, 2)
  SELECT query_id, region_id, rank::INT AS rank FROM (SELECT query_id, region_id, row_number() OVER (PARTITION BY query_id ORDER BY place_at) AS rank FROM o) WHERE rank <= 5""")
def kg_regions(spark, sf_dir):
    _, nodes, edges, seeds = _graph(spark, sf_dir)
    return graph.expansion_regions(seeds, nodes, edges, 1, 5)


@query(_G + """, l AS (SELECT a.query_id, '- ' || h.name || ' --' || e.relation_type || '--> ' || t.name AS line, row_number() OVER (PARTITION BY a.query_id ORDER BY e.source_region_id, e.relation_type, e.head, e.tail) AS n
  FROM edges e JOIN reach1 a ON a.node_id = e.head JOIN reach1 b ON b.node_id = e.tail AND b.query_id = a.query_id JOIN nodes h ON h.id = e.head JOIN nodes t ON t.id = e.tail)
  SELECT query_id, string_agg(line, chr(10) ORDER BY n) AS description FROM l WHERE n <= 20 GROUP BY 1""")
def kg_describe(spark, sf_dir):
    _, nodes, edges, seeds = _graph(spark, sf_dir)
    return graph.describe(graph.expand(seeds, nodes, edges, 1), nodes, edges)


# ------------------------------------------------------------------ answers, judges, caches


def _answers(spark, sf_dir) -> DataFrame:
    c = I.table(spark, sf_dir, "conversations")
    answer = F.concat("text", F.lit(" [c"), F.col("conv_id"), F.lit("] [ t"), F.col("turn") % 3, F.lit(" ] []"), F.when(F.col("turn") % 4 == 3, " Not stated in the text.").otherwise(""))
    return c.select("conv_id", "turn", "role", F.format_string("%d/%d", "conv_id", "turn").alias("answer_id"), answer.alias("answer"))


@query("SELECT conv_id, turn, 'c' || conv_id || ',t' || (turn % 3) AS citations FROM conversations")
def citation_extract(spark, sf_dir):
    return _answers(spark, sf_dir).select("conv_id", "turn", F.array_join(text.citations(F.col("answer")), ",").alias("citations"))


@query("""SELECT role, count(*) AS n_citing, round(avg(((conv_id % 2 = 0)::INT + (turn % 3 = 1)::INT) / 2), 6) AS citation_validity FROM conversations GROUP BY role""")
def citation_validity(spark, sf_dir):
    a = _answers(spark, sf_dir)
    known = a.filter("conv_id % 2 = 0").select(F.concat(F.lit("c"), "conv_id").alias("id")).distinct().unionByName(spark.sql("SELECT 't1' AS id"))
    out = metrics.citation_validity(a.select("role", "answer_id", text.citations(F.col("answer")).alias("citations")), known, "role")
    return out.withColumn("citation_validity", F.round("citation_validity", 6))


@query("SELECT role, count(*) AS n, round(avg((turn % 4 = 3 OR turn > 1)::INT), 6) AS support_rate FROM conversations GROUP BY role")
def support_rate(spark, sf_dir):
    a = _answers(spark, sf_dir)
    return a.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(text.supported(F.col("answer"), F.col("turn") > 1).cast("int")), 6).alias("support_rate"))


@query("""SELECT d.source, count(*) AS n, round(avg(quality), 4) AS mean, round(greatest(0, avg(quality) - coalesce(1.96 * stddev_samp(quality) / sqrt(count(*)), 0)), 4) AS ci95_low,
  round(least(1, avg(quality) + coalesce(1.96 * stddev_samp(quality) / sqrt(count(*)), 0)), 4) AS ci95_high FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1""")
def judge_ci(spark, sf_dir):
    rows = I.table(spark, sf_dir, "labels").join(I.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    reply = F.format_string('Scores: {"faithfulness": %d, "relevance": 1}', "quality")
    return metrics.interval(rows.select("source", text.judged(reply)["faithfulness"].alias("score")), "score", "source")


@query("SELECT conv_id, turn, sha256('stub' || chr(0) || 'm' || chr(0) || role || chr(0) || text || chr(0)) AS key FROM conversations")
def cache_keys(spark, sf_dir):
    key = text.cache_key(F.lit("stub"), F.lit("m"), F.col("text"), F.col("role"))
    return I.table(spark, sf_dir, "conversations").select("conv_id", "turn", key.alias("key"))


def _cached(spark, sf_dir):
    asked = models.keyed(I.table(spark, sf_dir, "conversations").withColumnRenamed("text", "prompt"), "stub", "m")
    return asked, asked.filter("conv_id % 2 = 0").select("key", F.lit("reply").alias("reply")).distinct()


_CACHED = "WITH k AS (SELECT conv_id, sha256('stub' || chr(0) || 'm' || chr(0) || chr(0) || text || chr(0)) AS key FROM conversations), h AS (SELECT DISTINCT key FROM k WHERE conv_id % 2 = 0)"


@query(_CACHED + " SELECT DISTINCT key FROM k WHERE key NOT IN (SELECT key FROM h)")
def cache_misses(spark, sf_dir):
    return models.misses(*_cached(spark, sf_dir)).select("key")


@query(_CACHED + " SELECT count(*) FILTER (key IN (SELECT key FROM h)) AS hits, count(*) FILTER (key NOT IN (SELECT key FROM h)) AS misses, round(count(*) FILTER (key IN (SELECT key FROM h)) / count(*), 4) AS hit_rate FROM k")
def cache_stats(spark, sf_dir):
    return models.cache_statistics(*_cached(spark, sf_dir))


@query(f"WITH {S.QUESTIONS} SELECT query_id, 'Stub answer derived from the provided context [' || substr(sha256('Evidence: ' || question), 1, 8) || '].' AS answer FROM q")
def stub_answers(spark, sf_dir):
    asked = I.questions(spark, sf_dir).select("query_id", F.concat(F.lit("Evidence: "), "question").alias("prompt"))
    return evidence.stub_answers(asked).select("query_id", "answer")


@query("""WITH """ + I.REGIONS_SQL + """, ch AS (SELECT doc_id FROM regions WHERE region_type IN ('text', 'title', 'list') AND length(trim(text)) >= 40), p AS (
  SELECT 'text_answerable' AS query_type, count(*) AS n FROM regions WHERE region_type IN ('text', 'title', 'list') AND length(trim(text)) > 200
  UNION ALL SELECT 'visual_requiring', count(*) FROM regions WHERE region_type IN ('table', 'figure') AND length(text) > 20 UNION ALL SELECT 'multi_hop', count(*) FROM (SELECT doc_id FROM ch GROUP BY 1 HAVING count(*) >= 2)) SELECT * FROM p""")
def qa_pools(spark, sf_dir):
    r = I.regions(spark, sf_dir)
    chunks = regions.region_chunks(r)
    pool = questions.text_pool(chunks).unionByName(questions.visual_pool(r)).unionByName(questions.pair_pool(chunks))
    return pool.groupBy("query_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, (CASE WHEN h > 0 AND h < 20 THEN greatest(1, floor(w * (20::DOUBLE / h))) ELSE w END)::INT AS width, (CASE WHEN h > 0 AND h < 20 THEN 20 ELSE h END)::INT AS height FROM (SELECT l_orderkey, l_linenumber, l_quantity::INT AS w, (l_linenumber * 5)::INT AS h FROM lineitem)")
def ocr_upscale(spark, sf_dir):
    """Sizes of crops before reading: low ones are enlarged in proportion."""
    size = boxes.upscaled(F.col("l_quantity").cast("int"), (F.col("l_linenumber") * 5).cast("int"), 20)
    out = I.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", size.alias("s"))
    return out.select("l_orderkey", "l_linenumber", F.col("s")["width"].alias("width"), F.col("s")["height"].alias("height"))


@query("WITH " + I.REGIONS_SQL + """, k AS (SELECT region_id, CASE WHEN i % 2 = 0 THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) ELSE trim(regexp_replace('read ' || text, '\\s+', ' ', 'g')) END AS t, CASE WHEN i % 2 = 0 THEN 0.5 ELSE 0.9 END AS c FROM regions)
  SELECT region_id, md5(t) AS text_md5, c::DOUBLE AS ocr_confidence FROM k""")
def ocr_regions(spark, sf_dir):
    """Regions read anew: every other one from a cache, the rest by an engine."""
    r = I.regions(spark, sf_dir)
    number = F.regexp_extract("region_id", "(\\d+)$", 1).cast("int")
    cache = r.filter(number % 2 == 0).select("region_id", "text", F.lit(0.5).alias("confidence"))
    read = I.regions(spark, sf_dir).select("region_id", F.concat(F.lit("read \n"), F.coalesce("text", F.lit(""))).alias("text"), F.lit(0.9).alias("confidence"))
    engine = lambda missing: missing.select("region_id").join(read, "region_id")
    return regions.read_text(r, cache, engine).select("region_id", F.md5("text").alias("text_md5"), "ocr_confidence")


@query(f"WITH {S.QUESTIONS}, {S.GOLD}" + """, n AS (SELECT q.query_type, q.query_id, count(g.region_id) AS c FROM q LEFT JOIN gold g ON g.query_id = q.query_id GROUP BY 1, 2)
  SELECT coalesce(query_type, 'total') AS query_type, count(*) AS n, round(avg(c), 2) AS mean_gold_regions FROM n GROUP BY ROLLUP (query_type)""")
def qa_stats(spark, sf_dir):
    return questions.statistics(I.question_set(spark, sf_dir))


_PAIRS = _CHUNKED + """, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ('0x' || substr(md5('42/' || chunk_id), 1, 15))::BIGINT, chunk_id) AS n, count(*) OVER (PARTITION BY doc_id) AS c FROM ch)"""


@query(_PAIRS + " SELECT a.doc_id, a.region_id || ',' || b.region_id AS gold, md5(a.text || ' ' || b.text) AS passage_md5 FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.n = 1 AND b.n = 2 WHERE a.c >= 2")
def qa_pairs(spark, sf_dir):
    """The two chunks that each document's multi-hop question is asked about."""
    pairs = questions.pair_pool(regions.region_chunks(I.regions(spark, sf_dir)))
    return pairs.select("doc_id", joined("gold_region_ids").alias("gold"), F.md5("passage").alias("passage_md5"))
