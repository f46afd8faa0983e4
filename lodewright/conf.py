"""Validated settings.  They live on the driver; their values become literals of plans."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from pathlib import Path


class SettingsError(ValueError):
    """A setting is unknown or out of range."""


# Names of sections and settings in a settings file, and their defaults.


@dataclass(frozen=True)
class Paths:
    data_dir: str = "data"
    artifacts_dir: str = "artifacts"
    results_dir: str = "results"
    cache_dir: str = "artifacts/llm_cache"


@dataclass(frozen=True)
class Ingest:
    dataset_url_template: str = "shard-{i:06d}.tar"
    num_shards: int = 1
    max_pages: int = 200
    min_region_side_px: float = 8.0
    min_ocr_chars: int = 20
    ocr_lang: str = "eng"
    ocr_psm: int = 6
    ocr_min_crop_height: int = 200
    tesseract_cmd: str = ""
    save_crops: bool = True


@dataclass(frozen=True)
class Chunking:
    strategy: str = "region"
    window_chars: int = 900
    overlap_chars: int = 150
    min_chunk_chars: int = 40


@dataclass(frozen=True)
class Models:
    text_embed_model: str = "hashing-64"
    text_embed_revision: str | None = None
    clip_model: str = "hashing-64"
    clip_revision: str | None = None
    caption_model: str = ""
    enable_captions: bool = False
    embed_batch_size: int = 32
    device: str = "auto"


@dataclass(frozen=True)
class Llm:
    backend: str = "stub"
    model: str = "stub"
    local_model: str = ""
    max_tokens: int = 800
    temperature: float = 0.0
    cache_enabled: bool = True
    base_url: str = ""
    api_key_env: str = ""
    timeout_s: float = 90.0
    max_retries: int = 5
    requests_per_minute: float = 30.0


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 5
    candidate_k: int = 20
    rrf_k: int = 60
    use_bm25_floor: bool = True
    graph_hops: int = 1
    max_graph_regions: int = 5
    text_weight: float = 1.0
    graph_weight: float = 0.3


@dataclass(frozen=True)
class Graph:
    extractor: str = "rule"
    entity_types: tuple[str, ...] = ("method", "metric", "dataset", "finding", "figure_ref")
    max_regions_for_extraction: int = 400
    batch_size: int = 5


@dataclass(frozen=True)
class Evaluation:
    k_values: tuple[int, ...] = (1, 3, 5, 10)
    primary_k: int = 5
    n_questions_per_type: int = 25
    judge_enabled: bool = True
    judge_sample_size: int = 60
    include_random_floor: bool = True
    generate_answers: bool = True


_SECTIONS = {"paths": Paths, "ingest": Ingest, "chunk": Chunking, "models": Models, "llm": Llm, "retrieval": Retrieval, "kg": Graph, "eval": Evaluation}
BACKENDS = ("stub", "local", "anthropic", "groq", "together", "openrouter", "ollama", "openai_compatible")


@dataclass(frozen=True)
class Settings:
    seed: int = 42
    paths: Paths = field(default_factory=Paths)
    ingest: Ingest = field(default_factory=Ingest)
    chunk: Chunking = field(default_factory=Chunking)
    models: Models = field(default_factory=Models)
    llm: Llm = field(default_factory=Llm)
    retrieval: Retrieval = field(default_factory=Retrieval)
    kg: Graph = field(default_factory=Graph)
    eval: Evaluation = field(default_factory=Evaluation)

    @classmethod
    def from_mapping(cls, raw: dict | None) -> Settings:
        values: dict = {}
        for key, value in (raw or {}).items():
            if key == "seed":
                values[key] = int(value)
                continue
            if key not in _SECTIONS:
                raise SettingsError(f"unknown section: {key}")
            known = {f.name for f in dataclasses.fields(_SECTIONS[key])}
            if odd := sorted(set(value or {}) - known):
                raise SettingsError(f"unknown settings in {key}: {', '.join(odd)}")
            values[key] = _SECTIONS[key](**{k: tuple(v) if isinstance(v, list) else v for k, v in (value or {}).items()})
        return cls(**values).validated()

    @classmethod
    def load(cls, path: str | Path) -> Settings:
        """Settings of a YAML file; a missing file means the defaults."""
        import yaml

        path = Path(path)
        return cls.from_mapping(yaml.safe_load(path.read_text(encoding="utf-8")) if path.exists() else None)

    def validated(self) -> Settings:
        rules = (
            (self.retrieval.top_k > 0, "top_k must be positive"),
            (self.retrieval.candidate_k >= self.retrieval.top_k, "candidate_k must reach top_k"),
            (self.retrieval.graph_hops >= 0, "graph_hops must not be negative"),
            (self.eval.primary_k in self.eval.k_values, "primary_k must be one of k_values"),
            (all(k > 0 for k in self.eval.k_values), "k_values must be positive"),
            (self.llm.backend in BACKENDS, f"llm backend must be one of {BACKENDS}"),
            (self.llm.temperature == 0, "temperature must be 0 for repeatable results"),
            (self.llm.requests_per_minute >= 0, "requests_per_minute must not be negative"),
            (self.kg.extractor in ("rule", "llm"), "extractor must be rule or llm"),
            (self.chunk.strategy in ("region", "window"), "chunk strategy must be region or window"),
            (0 <= self.chunk.overlap_chars < self.chunk.window_chars, "overlap must be smaller than the window"),
        )
        if failed := [text for good, text in rules if not good]:
            raise SettingsError("; ".join(failed))
        return self
