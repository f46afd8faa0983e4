"""Language models behind one protocol, with a cache table, pacing and retries.

``complete`` asks for each distinct cache miss once, inside Arrow batches.  A model is a factory
that gives a function from (prompt, system) to a reply; each Python worker calls it once.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..conf import Llm
from ..functions.text import cache_key
from ..staging import stage

Model = Callable[[], Callable[[str, str | None], str]]


class TransientError(RuntimeError):
    """A failure worth another try; ``wait_s`` is what the service asked for, if anything."""

    def __init__(self, message: str, wait_s: float | None = None):
        super().__init__(message)
        self.wait_s = wait_s


def is_transient(status: int) -> bool:
    """Rate limits and server faults pass; other client errors do not."""
    return status == 429 or 500 <= status < 600


def backoff_s(attempt: int, wait_s: float | None = None, most: float = 30.0) -> float:
    return wait_s if wait_s is not None else min(2.0**attempt, most)


def patient(call: Callable[[], str], max_retries: int = 5, sleep: Callable[[float], None] = time.sleep) -> str:
    for attempt in range(max_retries + 1):
        try:
            return call()
        except TransientError as e:
            if attempt == max_retries:
                raise
            sleep(backoff_s(attempt, e.wait_s))
    raise AssertionError("unreachable")


class Pace:
    """Waits so that calls keep an interval; a rate of 0 does not wait."""

    def __init__(self, per_minute: float, clock=time.monotonic, sleep=time.sleep):
        self.gap, self.clock, self.sleep, self.last = (60.0 / per_minute if per_minute > 0 else 0.0), clock, sleep, None

    def wait(self) -> None:
        now = self.clock()
        if self.last is not None and self.gap and now - self.last < self.gap:
            self.sleep(self.gap - (now - self.last))
        self.last = self.clock()


def keyed(prompts: DataFrame, backend: str, model: str, system: str | None = None) -> DataFrame:
    return prompts.withColumn("key", cache_key(F.lit(backend), F.lit(model), F.col("prompt"), F.lit(system) if system else None))


def misses(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct keys and prompts that the cache (key, reply) lacks."""
    return asked.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def cache_statistics(asked: DataFrame, cache: DataFrame) -> DataFrame:
    hit = asked.join(cache.select("key").distinct().withColumn("hit", F.lit(1)), "key", "left")
    hits, n = F.count("hit"), F.count(F.lit(1))
    return hit.agg(hits.alias("hits"), (n - hits).alias("misses"), F.round(F.coalesce(hits / F.nullif(n, F.lit(0)), F.lit(0.0)), 4).alias("hit_rate"))


def complete(asked: DataFrame, cache: DataFrame, model: Model, system: str | None = None, per_minute: float = 0, max_retries: int = 5) -> DataFrame:
    """New cache rows (key, reply).  A paced model is asked from one task, as its rate holds for the client as a whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, pace = model(), Pace(per_minute)
        for batch in batches:
            replies = []
            for prompt in batch["prompt"]:
                pace.wait()
                replies.append(patient(lambda p=prompt: ask(p, system), max_retries).strip())
            yield pd.DataFrame({"key": batch["key"], "reply": replies})

    todo = misses(asked, cache).select("key", "prompt")
    return (stage(todo, "model-misses").repartition(1) if per_minute else todo).mapInPandas(run, "key string, reply string")


# Addresses of services with the common chat interface, and the variables that hold their keys.
SERVICES = {
    "openai": ("https://api.openai.com/v1", "OPENAI_API_KEY"),
    "groq": ("https://api.groq.com/openai/v1", "GROQ_API_KEY"),
    "together": ("https://api.together.xyz/v1", "TOGETHER_API_KEY"),
    "openrouter": ("https://openrouter.ai/api/v1", "OPENROUTER_API_KEY"),
    "ollama": ("http://localhost:11434/v1", ""),
}


def hosted(model: str, service: str = "", base_url: str = "", api_key_env: str = "", max_tokens: int = 800, timeout_s: float = 90.0) -> Model:
    """A model behind the common chat interface: one of ``SERVICES`` by name, or any ``base_url``.

    The key is read from the environment of the worker that asks.  Rate limits, server faults and
    lost connections are transient; other refusals raise at once.
    """
    known_url, known_key = SERVICES.get(service, ("", ""))
    url, key_name = (base_url or known_url).rstrip("/"), api_key_env or known_key
    if not url:
        raise ValueError(f"no address for {service or 'the model'}: give base_url")

    def load() -> Callable[[str, str | None], str]:
        key = os.environ.get(key_name, "") if key_name else ""
        if key_name and not key:
            raise ValueError(f"the environment has no {key_name}")
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})

        def ask(prompt: str, system: str | None) -> str:
            said = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": prompt}]
            body = json.dumps({"model": model, "messages": said, "max_tokens": max_tokens, "temperature": 0}).encode()
            try:
                with urllib.request.urlopen(urllib.request.Request(f"{url}/chat/completions", body, headers), timeout=timeout_s) as reply:
                    return json.load(reply)["choices"][0]["message"]["content"] or ""
            except urllib.error.HTTPError as e:
                if is_transient(e.code):
                    after = e.headers.get("Retry-After", "")
                    raise TransientError(f"status {e.code}", float(after) if after.replace(".", "", 1).isdigit() else None) from e
                raise RuntimeError(f"the model refused: status {e.code}") from e
            except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
                raise TransientError(str(e)) from e

        return ask

    return load


def of(settings: Llm) -> Model:
    """The model that settings name; ``stub`` and ``local`` are given by the caller, as they are code."""
    if settings.backend not in SERVICES and settings.backend != "openai_compatible":
        raise ValueError(f"{settings.backend} has no service; give a model factory")
    return hosted(settings.model, settings.backend, settings.base_url, settings.api_key_env, settings.max_tokens, settings.timeout_s)
