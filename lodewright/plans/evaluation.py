"""Evaluation of systems side by side: one log, one report by grouping sets, deltas."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..conf import Settings, SettingsError
from ..functions import text
from ..operators import fusion, metrics


def refuse_stub(settings: Settings, allow_stub: bool = False) -> None:
    """Headline results with generated answers need a real model."""
    if settings.llm.backend == "stub" and settings.eval.generate_answers and not allow_stub:
        raise SettingsError("the stub model gives no reportable answers; choose a model, turn generation off or allow the stub")


def log(questions: DataFrame, retrieved: dict[str, DataFrame]) -> DataFrame:
    """A row for each system and question (qa_id, question, query_type, gold_region_ids), also where nothing was retrieved."""
    parts = []
    for system, regions in retrieved.items():
        lists = fusion.ranked_list(regions).select(F.col("query_id").alias("qa_id"), F.col("retrieved").alias("retrieved_region_ids"))
        row = questions.select(F.lit(system).alias("system"), "qa_id", "question", "query_type", "gold_region_ids")
        parts.append(row.join(lists, "qa_id", "left").withColumn("retrieved_region_ids", F.coalesce("retrieved_region_ids", F.array().cast("array<string>"))))
    return reduce(DataFrame.unionByName, parts)


def report(log_rows: DataFrame, k_values: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """Scores by system and segment; a saved log gives the same report again."""
    return metrics.by_segment(metrics.per_question(log_rows, k_values))


JUDGE_PROMPT = (
    "Rate the answer below for faithfulness to the evidence and for relevance to the question, each from 0 to 1. "
    'Reply with JSON only: {"faithfulness": 0.0, "relevance": 0.0}.\n\nQuestion: %s\n\nEvidence:\n%s\n\nReference answer: %s\n\nAnswer: %s'
)


def judge_prompts(answers: DataFrame, sample: int) -> DataFrame:
    """Prompts (system, qa_id, prompt) for the first ``sample`` questions of each system in order of qa_id.

    ``answers`` has (system, qa_id, question, answer, gold_answer, retrieved ids); the evidence is named by its ids.
    """
    order = Window.partitionBy("system").orderBy("qa_id")
    first = answers.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= sample)
    named = F.array_join(F.transform("retrieved", lambda i: F.concat(F.lit("["), i, F.lit("]"))), "\n")
    shown = F.when(F.size("retrieved") > 0, named).otherwise("(none)")
    gold = F.coalesce(F.nullif(F.col("gold_answer"), F.lit("")), F.lit("(not available)"))
    return first.select("system", "qa_id", F.format_string(JUDGE_PROMPT, "question", shown, gold, "answer").alias("prompt"))


def answer_report(answers: DataFrame, known_ids: DataFrame, judged: DataFrame) -> DataFrame:
    """A row for each system: mean latency, citation validity, support rate, and the judge's means with intervals.

    ``answers`` has (system, qa_id, answer, latency_s, has_evidence); ``judged`` has (system, reply);
    replies that do not parse are left out.  A system without citations or scores has zeros there.
    """
    base = answers.groupBy("system").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.coalesce(F.avg("latency_s"), F.lit(0.0)), 4).alias("mean_latency_s"),
        F.round(F.avg(text.supported(F.col("answer"), F.col("has_evidence")).cast("int")), 4).alias("support_rate"),
    )
    cited = answers.select("system", F.col("qa_id").alias("answer_id"), text.citations(F.col("answer")).alias("citations"))
    valid = metrics.citation_validity(cited, known_ids, "system").select("system", F.round("citation_validity", 4).alias("citation_validity"))
    scores = judged.select("system", text.judged(F.col("reply")).alias("s")).filter("s is not null").select("system", "s.*")
    out = base.join(valid, "system", "left")
    for measure in ("faithfulness", "relevance"):
        part = metrics.interval(scores, measure, "system").toDF("system", *[f"{measure}_{c}" for c in ("n", "mean", "ci95_low", "ci95_high")])
        out = out.join(part, "system", "left")
    return out.na.fill(0)


def payload(settings: Settings, report: DataFrame, answers: DataFrame | None = None, baseline: str | None = None, enhanced: str | None = None) -> dict:
    """The results as one mapping: settings that matter, systems with their overall and segment scores, deltas.

    Reads as many rows as there are systems times segments.
    """
    systems: dict = {}
    n_questions = 0
    for row in report.collect():
        r = row.asDict()
        system, segment = r.pop("system"), r.pop("segment")
        at = systems.setdefault(system, {"overall": {}, "by_segment": {}})
        if segment == "overall":
            at["overall"], n_questions = r, max(n_questions, r["n"])
        else:
            at["by_segment"][segment] = r
    for row in answers.collect() if answers is not None else ():
        r = row.asDict()
        systems.setdefault(r.pop("system"), {}).update(answers=r)
    out = {
        "config": {
            "seed": settings.seed,
            "llm_backend": settings.llm.backend,
            "text_embed_model": settings.models.text_embed_model,
            "clip_model": settings.models.clip_model,
            "top_k": settings.retrieval.top_k,
            "kg_extractor": settings.kg.extractor,
        },
        "n_questions": n_questions,
        "generation_evaluated": answers is not None,
        "systems": systems,
    }
    if baseline in systems and enhanced in systems:
        gaps = metrics.deltas(report, baseline, enhanced, settings.eval.primary_k).collect()
        out["deltas"] = {r["segment"]: {k: v for k, v in r.asDict().items() if k != "segment"} for r in gaps}
    return out
