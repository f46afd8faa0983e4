"""Writers: stage tables as Parquet; exports as JSON and CSV."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_tables(tables: dict[str, DataFrame], root: str) -> None:
    """Each table as Parquet and as a temporary view of its name, so that SQL reaches it."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        df.sparkSession.read.parquet(f"{root}/{name}").createOrReplaceTempView(name)


def index(items: DataFrame, path: str) -> None:
    items.select("item_id", "embedding", "modality").write.mode("overwrite").parquet(path)


def _document(path: str, **tables: DataFrame) -> None:
    """The tables as arrays of one JSON document: the exchange form, for what fits into one value."""
    whole = None
    for name, df in tables.items():
        rows = df.select(F.struct(*df.columns).alias("r")).agg(F.sort_array(F.collect_list("r")).alias(name))
        whole = rows if whole is None else whole.crossJoin(rows)  # one row each
    whole.select(F.to_json(F.struct(*tables))).coalesce(1).write.mode("overwrite").text(path)


def _lines(path: str, **tables: DataFrame) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def corpus(regions: DataFrame, chunks: DataFrame, path: str, whole: bool = False) -> None:
    """Regions and chunks as JSON lines in two folders, or (``whole``) as one document."""
    (_document if whole else _lines)(path, regions=regions, chunks=chunks)


def graph(nodes: DataFrame, edges: DataFrame, path: str, whole: bool = False) -> None:
    """Nodes in order of their id, edges in order of their statement."""
    if whole:
        _document(path, nodes=nodes, edges=edges)
    else:
        _lines(path, nodes=nodes.orderBy("id"), edges=edges.orderBy("source_region_id", "head", "tail"))


def questions(rows: DataFrame, path: str, whole: bool = False) -> None:
    if whole:
        listed = rows.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*rows.columns)))))
        listed.coalesce(1).write.mode("overwrite").text(path)
    else:
        rows.write.mode("overwrite").json(path)


def retrieval_log(log: DataFrame, path: str, whole: bool = False) -> None:
    """A log's rows as JSON lines, or (``whole``) as one document that maps systems to their records."""
    if not whole:
        log.write.mode("overwrite").json(path)
        return
    record = F.struct(*[c for c in log.columns if c != "system"])
    systems = log.groupBy("system").agg(F.sort_array(F.collect_list(record)).alias("records"))
    mapped = systems.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("system", "records")))).alias("m"))
    mapped.select(F.to_json("m")).coalesce(1).write.mode("overwrite").text(path)


def new_cache_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def comparison(report: DataFrame, path: str, systems: list[str]) -> None:
    """One CSV: each system's overall row first, then its segments by name."""
    place = F.array_position(F.array(*[F.lit(s) for s in systems]), F.col("system"))
    ordered = report.orderBy(place, F.col("segment") != "overall", "segment")
    ordered.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def results(payload: dict, path: str | Path) -> None:
    """The payload as JSON; keys that start with an underscore stay out."""
    public = {k: v for k, v in payload.items() if not k.startswith("_")}
    Path(path).write_text(json.dumps(public, indent=2, default=str), encoding="utf-8")


def crops(rows: DataFrame, root: str) -> DataFrame:
    """Image bytes (region_id, image) as a table with a row for each crop; returns region_id and image_path, the name under which the table has it."""
    named = rows.select("region_id", F.concat(F.lit(root.rstrip("/") + "/"), F.replace("region_id", F.lit("#"), F.lit("_")), F.lit(".png")).alias("image_path"), "image")
    named.write.mode("overwrite").parquet(root)
    return named.sparkSession.read.parquet(root).select("region_id", "image_path")


def console(report: DataFrame, k: int) -> str:
    """The comparison as aligned lines."""
    rows = report.select("system", "segment", "n", f"recall_{k}", "mrr").orderBy("system", F.col("segment") != "overall", "segment").collect()
    head = f"{'system':<26}{'segment':<20}{'n':>5}{'recall@' + str(k):>12}{'mrr':>9}"
    return "\n".join([head, *(f"{r[0]:<26}{r[1]:<20}{r[2]:>5}{r[3]:>12.4f}{r[4]:>9.4f}" for r in rows)])


def verification(report: DataFrame, k: int, baseline: str | None = None, enhanced: str | None = None) -> str:
    """What a saved log gives again: each system's overall figures, and the gap in recall between two of them."""
    rows = {r["system"]: r for r in report.filter("segment = 'overall'").collect()}
    lines = [f"{name}: {r['n']} questions, recall@{k} {r[f'recall_{k}']:.4f}, ndcg@{k} {r[f'ndcg_{k}']:.4f}, mrr {r['mrr']:.4f}" for name, r in sorted(rows.items())]
    if baseline in rows and enhanced in rows:
        lines.append(f"{enhanced} against {baseline}: recall@{k} {rows[enhanced][f'recall_{k}'] - rows[baseline][f'recall_{k}']:+.4f}")
    return "\n".join(lines)
