"""Model back-ends and the agent that calls them from tasks.

``RuleBackend`` needs no network and is deterministic. The HTTP back-ends take
their endpoint and key as arguments and use the standard library only.
"""

from __future__ import annotations

import json
import re
import time
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.reasoning.prompts import RANGE_SYSTEM, WINDOW_SYSTEM
from tideline.sources.tables import settle


class Backend(Protocol):
    def generate(self, system: str, user: str, temperature: float) -> str: ...


def generate_with_retry(backend: Backend, system: str, user: str, temperature: float = 0.0, attempts: int = 3, wait: float = 1.0) -> str:
    """Tries again after 1, 2, 4 ... times ``wait`` seconds; the last failure is raised."""
    for turn in range(attempts):
        try:
            return backend.generate(system, user, temperature)
        except Exception:
            if turn == attempts - 1:
                raise
            time.sleep(wait * 2**turn)
    raise ValueError("no attempts")


@dataclass
class RuleBackend:
    """Answers by plain rules on the prompt: a window is anomalous by its metrics of level high, a range by high CUSUM."""

    per_mark: float = 0.3
    level: float = 5.0

    def generate(self, system: str, user: str, temperature: float) -> str:
        if user.startswith("t residual cusum mean"):
            points = [(int(i), float(c)) for i, c in re.findall(r"^(\d+) [-\d.]+ ([-\d.]+) ", user, re.M)]
            ranges: list[dict[str, int]] = []
            for i, c in points:
                if c >= self.level:
                    if ranges and ranges[-1]["end"] == i:
                        ranges[-1]["end"] = i + 1
                    else:
                        ranges.append({"start": i, "end": i + 1})
            return json.dumps({"anomalies": ranges})
        out = []
        for block in re.split(r"(?m)^(?=# \d+$)", user):
            if found := re.match(r"# (\d+)", block):
                high = re.findall(r'"metric":"(\w+)"[^}]*"level":"high"', block)
                out.append({"window_index": int(found[1]), "is_anomaly": bool(high), "confidence": min(1.0, self.per_mark * len(high)), "reasoning": f"{len(high)} metrics are high", "evidence_cited": high})
        return json.dumps({"results": out})


@dataclass
class HttpBackend:
    """A chat endpoint: ``style`` is ``openai`` (messages, JSON mode), ``anthropic`` or ``gemini`` (the system text goes first)."""

    url: str
    key: str
    model: str
    style: str = "openai"
    max_tokens: int = 4096
    timeout: float = 120.0

    def request(self, system: str, user: str, temperature: float) -> tuple[dict, dict]:
        """Body and headers of one call."""
        if self.style == "openai":
            messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
            return {"model": self.model, "messages": messages, "temperature": temperature, "response_format": {"type": "json_object"}}, {"Authorization": f"Bearer {self.key}", "api-key": self.key}
        if self.style == "anthropic":
            return {"model": self.model, "system": system, "messages": [{"role": "user", "content": user}], "temperature": temperature, "max_tokens": self.max_tokens}, {"x-api-key": self.key, "anthropic-version": "2023-06-01"}
        if self.style == "gemini":
            return {"contents": [{"parts": [{"text": f"{system}\n\n{user}"}]}], "generationConfig": {"temperature": temperature}}, {"x-goog-api-key": self.key}
        raise ValueError(self.style)

    def generate(self, system: str, user: str, temperature: float) -> str:
        body, headers = self.request(system, user, temperature)
        call = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
        with urllib.request.urlopen(call, timeout=self.timeout) as reply:
            found = json.load(reply)
        if self.style == "openai":
            return found["choices"][0]["message"]["content"]
        return found["content"][0]["text"] if self.style == "anthropic" else found["candidates"][0]["content"]["parts"][0]["text"]


def create_backend(kind: str = "rule", **options) -> Backend:
    """``rule``, or a style of :class:`HttpBackend`."""
    return RuleBackend(**options) if kind == "rule" else HttpBackend(style={"azure_openai": "openai", "claude": "anthropic"}.get(kind, kind), **options)


def ask(prompts: DataFrame, backend: Backend, system: str | None = None, temperature: float = 0.0, attempts: int = 3) -> DataFrame:
    """``prompts`` with ``reply`` (null after the last failed attempt) and ``error``. Filter before: every row is a call.

    Without ``system`` each row's own column of that name is used.
    """
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields], "reply string, error string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies, errors = [], []
            for prompt, own in zip(batch["prompt"], batch["system"] if system is None else [system] * len(batch), strict=True):
                try:
                    replies.append(generate_with_retry(backend, own, prompt, temperature, attempts))
                    errors.append(None)
                except Exception as failed:  # a failed call is a row without a reply
                    replies.append(None)
                    errors.append(str(failed))
            yield batch.assign(reply=pd.Series(replies, index=batch.index, dtype=object), error=pd.Series(errors, index=batch.index, dtype=object))

    return prompts.mapInPandas(run, schema)


def ask_cached(prompts: DataFrame, backend: Backend, system: str, cache: str, temperature: float = 0.0, attempts: int = 3) -> DataFrame:
    """As :func:`ask`, but prompts that were answered before take the reply from the table at ``cache``, and new replies are added to it."""
    spark = prompts.sparkSession
    keyed = prompts.withColumn("__key", F.sha2(F.concat_ws("\0", F.lit(system), F.col("prompt"), F.lit(str(temperature))), 256))
    try:
        known = spark.read.schema("__key string, reply string").parquet(cache).groupBy("__key").agg(F.min("reply").alias("reply"))
    except AnalysisException:  # nothing was answered yet
        known = spark.createDataFrame([], "__key string, reply string")
    old = settle(keyed.join(known, "__key"), "known-replies")
    new = settle(ask(keyed.join(known, "__key", "left_anti").dropDuplicates(["__key"]).select("__key", "prompt"), backend, system, temperature, attempts), "new-replies")
    new.where("reply is not null").select("__key", "reply").write.mode("append").parquet(cache)
    fresh = keyed.join(new.select("__key", "reply", "error"), "__key")
    return old.withColumn("error", F.lit(None).cast("string")).unionByName(fresh).drop("__key")


def ask_windows(prompts: DataFrame, backend: Backend, temperature: float = 0.0) -> DataFrame:
    return ask(prompts, backend, WINDOW_SYSTEM, temperature)


def ask_ranges(prompts: DataFrame, backend: Backend, temperature: float = 0.0) -> DataFrame:
    """Each series' own ``max_ranges`` goes into its instructions."""
    system = F.replace(F.lit(RANGE_SYSTEM), F.lit("{max_ranges}"), F.col("max_ranges").cast("string"))
    return ask(prompts.withColumn("system", system), backend, None, temperature).drop("system")
