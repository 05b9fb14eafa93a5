"""Proposals of an external model: a connector that any callable can stand in for.

The engine takes proposals as tables. Where a model is at hand, answers() sends each distinct prompt
that the cache lacks to it, in batches per partition, and returns rows for the cache.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from veilgraph.plans.arbitration import cache_misses


def answers(prompts: DataFrame, cache: DataFrame, judge: Callable[[str, str, str], dict | None], tries: int = 2) -> DataFrame:
    """(key, answer JSON) of prompts(model, system, prompt) that the cache lacks; failures give no row."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            for r in batch.to_pylist():
                for _ in range(tries):
                    got = judge(r["model"], r["system"], r["prompt"])
                    if isinstance(got, dict):
                        keys.append(r["key"])
                        out.append(json.dumps(got, sort_keys=True))
                        break
            yield pa.record_batch([pa.array(keys, pa.string()), pa.array(out, pa.string())], ["key", "answer"])

    return cache_misses(prompts, cache).select("key", "model", "system", "prompt").mapInArrow(ask, "key string, answer string")
