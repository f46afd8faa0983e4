"""Four retrieval systems over one corpus, as plans over all questions at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..conf import Retrieval
from ..functions.embedders import embedded, hashing
from ..operators import dense, evidence, fusion, graph, lexical
from ..staging import stage

BASELINE, ENHANCED, BM25, RANDOM = "baseline_text_rag", "enhanced_multimodal_kg", "bm25_lexical_floor", "random_floor"


@dataclass
class Corpus:
    """Tables of a corpus: chunks and regions, vectors of chunks and of visual regions' text and images, a graph."""

    chunks: DataFrame
    regions: DataFrame
    text_index: DataFrame
    visual_index: DataFrame | None = None
    image_index: DataFrame | None = None
    nodes: DataFrame | None = None
    edges: DataFrame | None = None


def embed(rows: DataFrame, id_col: str, text: str = "text", dim: int = 64, modality: str = "text") -> DataFrame:
    return rows.select(F.col(id_col).alias("item_id"), embedded(F.col(text), hashing(dim)).alias("embedding"), F.lit(modality).alias("modality"))


def query_vectors(questions: DataFrame, dim: int = 64) -> DataFrame:
    return questions.select("query_id", embedded(F.col("question"), hashing(dim)).alias("embedding"))


def baseline(c: Corpus, vectors: DataFrame, k: int = 5) -> DataFrame:
    return dense.top_k(c.text_index, vectors, k).withColumn("modality", F.lit("text"))


def bm25(c: Corpus, questions: DataFrame, k: int = 5) -> DataFrame:
    return lexical.top_k(c.chunks, questions, k, id_col="chunk_id").withColumn("modality", F.lit("lexical"))


def random(c: Corpus, questions: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    return fusion.random_floor(c.chunks.select(F.col("chunk_id").alias("item_id")), questions, k, seed)


def visual(c: Corpus, vectors: DataFrame, image_vectors: DataFrame | None, settings: Retrieval) -> DataFrame | None:
    """Visual regions by their text and by their image: fused where a question has hits by text, else by image alone."""
    by_text = dense.top_k(c.visual_index, vectors, settings.top_k).withColumn("modality", F.lit("visual_text")) if c.visual_index is not None else None
    by_image = dense.top_k(c.image_index, image_vectors, settings.top_k).withColumn("modality", F.lit("image")) if c.image_index is not None else None
    if by_text is None or by_image is None:
        return by_text if by_image is None else by_image
    both = by_image.join(by_text.select("query_id").distinct(), "query_id", "left_semi")
    alone = by_image.join(by_text.select("query_id").distinct(), "query_id", "left_anti")
    fused = fusion.reciprocal_rank([by_text, both], settings.rrf_k, top_n=settings.top_k)
    return fused.unionByName(alone.select(*fused.columns))


def graph_hits(c: Corpus, questions: DataFrame, settings: Retrieval) -> DataFrame:
    """Chunks of the regions that a question's entities lead to, in corpus order, as a ranking."""
    seeds = stage(graph.link(questions, c.nodes), "graph-seeds")
    regions = graph.expansion_regions(seeds, c.nodes, c.edges, settings.graph_hops, settings.max_graph_regions)
    carried = c.chunks.select("chunk_id", F.explode("source_region_ids").alias("region_id"))
    chunks = regions.join(carried, "region_id").select("query_id", F.col("chunk_id").alias("item_id")).distinct()
    order = Window.partitionBy("query_id").orderBy("item_id")
    ranked = chunks.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= settings.max_graph_regions)
    return ranked.select("query_id", "item_id", (1.0 / F.col("rank")).alias("score"), F.lit("graph").alias("modality"), "rank")


def enhanced(c: Corpus, questions: DataFrame, vectors: DataFrame, settings: Retrieval = Retrieval(), image_vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:  # noqa: B008
    """Rankings of chunks (dense and graph, fused) and of visual regions; their ids never mix."""
    rankings = [dense.top_k(c.text_index, vectors, settings.candidate_k).withColumn("modality", F.lit("text"))]
    weights = [settings.text_weight]
    if c.nodes is not None:
        rankings.append(graph_hits(c, questions, settings))
        weights.append(settings.graph_weight)
    fused = fusion.reciprocal_rank(rankings, settings.rrf_k, weights, settings.top_k)
    return fused, visual(c, vectors, image_vectors, settings)


def retrieved_regions(c: Corpus, text: DataFrame, visual_hits: DataFrame | None = None) -> DataFrame:
    """(query_id, region_id, rank): a system's hits, modalities interleaved, as regions."""
    none = text.limit(0)
    places = fusion.interleaved(text, visual_hits if visual_hits is not None else none)
    return fusion.as_regions(places, c.chunks)


def answers(c: Corpus, questions: DataFrame, text: DataFrame, visual_hits: DataFrame | None = None, settings: Retrieval = Retrieval(), responses: dict | None = None) -> DataFrame:  # noqa: B008
    """Answers of the offline model on a system's evidence, with prompt and evidence."""
    lines = evidence.text_lines(text, c.chunks)
    if visual_hits is not None:
        lines = lines.unionByName(evidence.visual_lines(visual_hits, c.regions))
    if c.nodes is not None and visual_hits is not None:
        seeds = stage(graph.link(questions, c.nodes), "graph-seeds")
        reached = stage(graph.expand(seeds, c.nodes, c.edges, settings.graph_hops), "graph-reached")
        lines = lines.unionByName(evidence.graph_lines(graph.describe(reached, c.nodes, c.edges)))
    return evidence.stub_answers(evidence.prompts(questions, lines), responses)


class System:
    """One system over a corpus: ``retrieve`` ranks for questions (query_id, question), ``answer`` answers them."""

    def __init__(self, name: str, corpus: Corpus, ranked: Callable[[DataFrame], tuple[DataFrame, DataFrame | None]], settings: Retrieval):
        self.name, self.corpus, self.ranked, self.settings = name, corpus, ranked, settings

    def retrieve(self, questions: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Rankings of chunks and, if the system has them, of visual regions."""
        return self.ranked(questions)

    def regions(self, questions: DataFrame) -> DataFrame:
        return retrieved_regions(self.corpus, *self.retrieve(questions))

    def answer(self, questions: DataFrame, responses: dict | None = None) -> DataFrame:
        """(query_id, question, evidence, prompt, answer) by the offline model."""
        return answers(self.corpus, questions, *self.retrieve(questions), self.settings, responses)

    def ask(self, question: str, responses: dict | None = None) -> DataFrame:
        """One question's answer: a row like those of ``answer``."""
        asked = self.corpus.chunks.sparkSession.createDataFrame([("question", question)], "query_id string, question string")
        return self.answer(asked, responses)


def all_of(c: Corpus, settings: Retrieval = Retrieval(), seed: int = 42, dim: int = 64) -> dict[str, System]:  # noqa: B008
    """The four systems over a corpus, by name."""
    ranked = {
        BASELINE: lambda q: (baseline(c, query_vectors(q, dim), settings.top_k), None),
        ENHANCED: lambda q: enhanced(c, q, query_vectors(q, dim), settings),
        BM25: lambda q: (bm25(c, q, settings.top_k), None),
        RANDOM: lambda q: (random(c, q, settings.top_k, seed), None),
    }
    return {name: System(name, c, f, settings) for name, f in ranked.items()}
