"""A remote model as a batch function: the client is passed in, results of earlier calls are reused, tests use a stub."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .expr import cache_key


def stub_client(prompt: str) -> str:
    """A fixed answer for each prompt: an object with values drawn from the prompt's hash."""
    h = hashlib.md5(prompt.encode()).digest()
    return json.dumps({"valence": round(h[0] / 255, 3), "arousal": round(h[1] / 255, 3), "tension": round(h[2] / 255, 3), "words": len(prompt.split())})


def call_model(prompts: DataFrame, client: Callable[[str], str], model: str = "stub", cache: DataFrame | None = None) -> DataFrame:
    """prompts (.., prompt) with cache_key, response and error. Prompts are asked once each, those in the cache (cache_key, response)
    not at all; a failing call gives an error and no response."""
    keyed = prompts.withColumn("cache_key", cache_key(F.lit(model), F.col("prompt")))
    asked = keyed.groupBy("cache_key").agg(F.first("prompt").alias("prompt"))
    if cache is not None:
        asked = asked.join(cache.select("cache_key"), "cache_key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b["prompt"]:
                try:
                    out.append((client(p), None))
                except Exception as e:  # the row carries the error
                    out.append((None, f"{type(e).__name__}: {e}"[:200]))
            yield b[["cache_key"]].assign(response=[o[0] for o in out], error=[o[1] for o in out])

    answers = asked.mapInPandas(run, "cache_key string, response string, error string")
    if cache is not None:
        answers = answers.unionByName(cache.select("cache_key", "response", F.lit(None).cast("string").alias("error")))
    return keyed.join(answers, "cache_key", "left")
