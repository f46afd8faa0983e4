"""Shared pieces of the catalogue's DuckDB SQL."""

from __future__ import annotations

from .functions.text import STOPWORDS, STUB_DIGEST
from .operators import lexicon
from .operators.evidence import PROMPT

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def tokens(rel: str, id_col: str, text: str, name: str) -> str:
    """CTEs: every token of a relation, in ``name`` (id, term)."""
    return f"""{name} AS (SELECT id, term FROM (SELECT {id_col} AS id, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS term FROM {rel}) WHERE term NOT IN ({_STOP}))"""


def bm25(name: str, docs: str, doc_id: str, text: str, k: int) -> str:
    """CTEs that end in ``name`` (query_id, item_id, score, rank) for queries ``q`` (query_id, question)."""
    n = name
    return f"""{tokens(docs, doc_id, text, n + '_t')},
{tokens('q', 'query_id', 'question', n + '_q')},
{n}_len AS (SELECT d.{doc_id} AS id, count(t.term) AS dl FROM {docs} d LEFT JOIN {n}_t t ON t.id = d.{doc_id} GROUP BY 1),
{n}_tf AS (SELECT id, term, count(*) AS tf FROM {n}_t GROUP BY 1, 2),
{n}_df AS (SELECT term, greatest(0, ln(1 + ((SELECT count(*) FROM {docs}) - count(*) + 0.5) / (count(*) + 0.5))) AS idf FROM {n}_tf GROUP BY 1),
{n}_s AS (SELECT a.id AS query_id, f.id AS item_id, sum(d.idf * f.tf * 2.5 / (f.tf + 1.5 * (0.25 + 0.75 * l.dl / (SELECT avg(dl) FROM {n}_len)))) AS score
  FROM {n}_q a JOIN {n}_tf f ON f.term = a.term JOIN {n}_df d ON d.term = a.term JOIN {n}_len l ON l.id = f.id GROUP BY 1, 2),
{n} AS (SELECT * FROM (SELECT q.query_id, d.{doc_id} AS item_id, coalesce(s.score, 0) AS score,
    row_number() OVER (PARTITION BY q.query_id ORDER BY round(coalesce(s.score, 0), 9) DESC, d.{doc_id}) AS rank
  FROM q CROSS JOIN {docs} d LEFT JOIN {n}_s s ON s.query_id = q.query_id AND s.item_id = d.{doc_id}) WHERE rank <= {k})"""


def distinct_tokens(column: str) -> str:
    """The distinct tokens of a text as a list."""
    return f"list_distinct([x FOR x IN regexp_extract_all(lower({column}), '[a-z0-9]+') IF x NOT IN ({_STOP})])"


def hashed(name: str, items: str, queries: str, k: int) -> str:
    """CTEs that end in ``name`` (query_id, item_id, score, rank): cosine similarity of hashed tokens, for a select of (id, text) and a relation of (query_id, question)."""
    n = name
    return f"""{n}_i AS ({items}),
{n}_t AS (SELECT k, id, ((instr('0123456789abcdef', substr(md5(t), 31, 1)) - 1) * 16 + instr('0123456789abcdef', substr(md5(t), 32, 1)) - 1) % 64 AS slot FROM (
  SELECT k, id, regexp_replace(unnest(regexp_split_to_array(lower(text), '\\s+')), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS t FROM (SELECT 'd' AS k, id, text FROM {n}_i UNION ALL SELECT 'q', query_id, question FROM {queries})) WHERE t <> ''),
{n}_v AS (SELECT k, id, slot, count(*)::DOUBLE AS n FROM {n}_t GROUP BY 1, 2, 3),
{n}_n AS (SELECT k, id, sqrt(sum(n * n)) AS norm FROM {n}_v GROUP BY 1, 2),
{n}_p AS (SELECT a.id AS query_id, b.id AS item_id, sum(a.n * b.n) AS dot FROM {n}_v a JOIN {n}_v b ON a.slot = b.slot AND a.k = 'q' AND b.k = 'd' GROUP BY 1, 2),
{n}_s AS (SELECT u.query_id, i.id AS item_id, coalesce(p.dot / (x.norm * y.norm), 0) AS score FROM {queries} u CROSS JOIN {n}_i i LEFT JOIN {n}_p p ON p.query_id = u.query_id AND p.item_id = i.id
  LEFT JOIN {n}_n x ON x.k = 'q' AND x.id = u.query_id LEFT JOIN {n}_n y ON y.k = 'd' AND y.id = i.id),
{n} AS (SELECT query_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM {n}_s) WHERE rank <= {k})"""


def random_floor(name: str, items: str, queries: str, k: int, seed: int = 42, draws: int = 16) -> str:
    """CTEs that end in ``name`` (query_id, item_id, rank): items at drawn places of a seeded order; more than ``draws`` * ``k`` items."""
    n, number = name, "('0x' || substr(md5({}), 1, 15))::BIGINT"
    return f"""{n}_o AS (SELECT id, row_number() OVER (ORDER BY {number.format(f"'{seed}/' || id")}, id) - 1 AS spot FROM ({items})),
{n}_c AS (SELECT count(*) AS c FROM {n}_o),
{n}_d AS (SELECT query_id, i, {number.format(f"'{seed}/' || query_id || '/' || i")} % c AS spot FROM (SELECT query_id, unnest(range({draws * k})) AS i FROM {queries}), {n}_c),
{n} AS (SELECT d.query_id, o.id AS item_id, d.rank FROM (SELECT query_id, spot, row_number() OVER (PARTITION BY query_id ORDER BY min(i), spot) AS rank FROM {n}_d GROUP BY 1, 2) d JOIN {n}_o o ON o.spot = d.spot WHERE d.rank <= {k})"""


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def prompt(evidence: str, question: str, example: str) -> str:
    """The answer prompt as SQL."""
    a, b, c, d = PROMPT.split("%s")
    return f"{quoted(a)} || {evidence} || {quoted(b)} || {question} || {quoted(c)} || coalesce(nullif({example}, ''), 'id') || {quoted(d)}"


def stub(prompt: str) -> str:
    """The offline model's answer to a prompt without triggers, as SQL."""
    return f"{quoted(STUB_DIGEST[0])} || substr(sha256({prompt}), 1, 8) || {quoted(STUB_DIGEST[1])}"


QUESTIONS = """q AS (SELECT printf('B%05d', item_id) AS query_id, text AS question, (['text_answerable', 'visual_requiring', 'multi_hop'])[item_id % 3 + 1] AS query_type FROM benchmark)"""
CHUNKS = "c AS (SELECT printf('D%07d', doc_id) AS chunk_id, text FROM documents)"
GOLD = "gold AS (SELECT q.query_id, printf('R%07d', d.doc_id) AS region_id FROM q JOIN documents d ON contains(d.text, q.question))"


def scores(log: str) -> str:
    """CTEs that end in ``per`` (system, query_id, query_type, measures) for ``log`` (system, query_id, region_id, rank)."""
    ks = (1, 3, 5, 10)
    measures = ", ".join(
        f"""coalesce(sum(CASE WHEN hit AND rank <= {k} THEN 1 ELSE 0 END), 0) / nullif(max(n_gold), 0)::DOUBLE AS r{k},
coalesce(sum(CASE WHEN hit AND rank <= {k} THEN 1 ELSE 0 END), 0) / nullif(sum(CASE WHEN rank <= {k} THEN 1 ELSE 0 END), 0)::DOUBLE AS p{k},
sum(CASE WHEN hit AND rank <= {k} THEN 1 / log2(rank + 1) ELSE 0 END) / nullif(list_sum([1 / log2(x + 1) FOR x IN range(1, least(max(n_gold), {k}) + 1)]), 0) AS g{k}"""
        for k in ks
    )
    means = ", ".join(f"round(avg(coalesce(r{k}, 0)), 6) AS recall_{k}, round(avg(coalesce(p{k}, 0)), 6) AS precision_{k}, round(avg(coalesce(g{k}, 0)), 6) AS ndcg_{k}" for k in ks)
    return f"""ng AS (SELECT q.query_id, q.query_type, count(g.region_id) AS n_gold FROM q LEFT JOIN gold g ON g.query_id = q.query_id GROUP BY 1, 2),
systems AS (SELECT DISTINCT system FROM {log}),
per AS (SELECT s.system, n.query_id, n.query_type, coalesce(max(CASE WHEN hit THEN 1.0 / rank END), 0) AS rr, {measures}
  FROM systems s CROSS JOIN ng n LEFT JOIN (SELECT l.*, g.region_id IS NOT NULL AS hit FROM {log} l LEFT JOIN gold g ON g.query_id = l.query_id AND g.region_id = l.region_id) h
    ON h.system = s.system AND h.query_id = n.query_id GROUP BY 1, 2, 3),
report AS (SELECT system, coalesce(query_type, 'overall') AS segment, count(*) AS n, {means}, round(avg(rr), 6) AS mrr FROM per GROUP BY GROUPING SETS ((system), (system, query_type)))"""


def mentions() -> str:
    """CTEs that end in ``m`` (region_id, entity_type, g, i, name, node_id), first mention of a node in a region."""
    parts = [("method", p, 0) for p in lexicon.METHOD_PATTERNS] + [("metric", lexicon.METRIC_PATTERN, 1), ("figure_ref", lexicon.FIGURE_PATTERN, 0), ("dataset", lexicon.DATASET_PATTERN, 1)]
    selects = [
        f"SELECT region_id, '{kind}' AS entity_type, {g} AS g, generate_subscripts(x, 1) AS i, unnest(x) AS raw FROM (SELECT region_id, regexp_extract_all(text, '{p}', {group}) AS x FROM gregions WHERE length(trim(text)) >= 40)"
        for g, (kind, p, group) in enumerate(parts)
    ]
    f = lexicon.FINDING_PATTERN
    selects.append(
        f"SELECT region_id, 'finding', {len(parts)}, generate_subscripts(a, 1), unnest(a) || ' = ' || trim(unnest(b)) FROM (SELECT region_id, regexp_extract_all(text, '{f}', 1) AS a, regexp_extract_all(text, '{f}', 2) AS b FROM gregions WHERE length(trim(text)) >= 40)"
    )
    union = "\nUNION ALL ".join(selects)
    return f"""raw AS ({union}),
named AS (SELECT *, entity_type || ':' || lower(name) AS node_id FROM (SELECT region_id, entity_type, g, i, trim(regexp_replace(raw, '\\s+', ' ', 'g'), ' .,;:') AS name FROM raw) WHERE name <> '' AND length(name) <= 60),
m AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY region_id, node_id ORDER BY g, i) = 1)"""


def graph() -> str:
    """CTEs that end in ``nodes`` (id, name, entity_type, region_id) and ``edges``."""
    return f"""{mentions()},
nodes AS (SELECT node_id AS id, name, entity_type, region_id FROM m QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY region_id, g, i) = 1),
rel AS (
  SELECT a.node_id AS head, b.node_id AS tail, 'evaluated_by' AS relation_type, a.region_id FROM m a JOIN m b ON a.region_id = b.region_id WHERE a.entity_type = 'method' AND b.entity_type = 'metric'
  UNION ALL SELECT a.node_id, b.node_id, 'reported_in', a.region_id FROM m a JOIN m b ON a.region_id = b.region_id WHERE a.entity_type IN ('method', 'metric') AND b.entity_type = 'figure_ref'
  UNION ALL SELECT 'metric:' || lower(split_part(name, ' = ', 1)), node_id, 'has_value', region_id FROM named WHERE entity_type = 'finding'),
edges AS (SELECT head, tail, relation_type, min(region_id) AS source_region_id FROM rel WHERE head IN (SELECT id FROM nodes) AND tail IN (SELECT id FROM nodes) GROUP BY 1, 2, 3),
ways AS (SELECT head AS u, tail AS v FROM edges UNION SELECT tail, head FROM edges),
seeds AS (SELECT query_id, id AS node_id, rank FROM (SELECT q.query_id, n.id, row_number() OVER (PARTITION BY q.query_id ORDER BY length(n.name) DESC, n.id) AS rank
  FROM gquestions q JOIN nodes n ON length(n.name) >= 3 AND regexp_matches(regexp_replace(lower(q.question), '\\s+', ' ', 'g'), '(^|[^a-z0-9_])' || regexp_escape(lower(n.name)) || '([^a-z0-9_]|$)')) WHERE rank <= 5),
hop1 AS (SELECT DISTINCT s.query_id, w.v AS node_id FROM seeds s JOIN ways w ON w.u = s.node_id),
reach1 AS (SELECT query_id, node_id, min(depth) AS depth FROM (SELECT query_id, node_id, 0 AS depth FROM seeds UNION ALL SELECT query_id, node_id, 1 FROM hop1) GROUP BY 1, 2),
hop2 AS (SELECT DISTINCT r.query_id, w.v AS node_id FROM reach1 r JOIN ways w ON w.u = r.node_id),
reach2 AS (SELECT query_id, node_id, min(depth) AS depth FROM (SELECT * FROM reach1 UNION ALL SELECT query_id, node_id, 2 FROM hop2) GROUP BY 1, 2)"""
