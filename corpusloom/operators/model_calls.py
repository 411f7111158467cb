"""Calls of a chat model for tables of prompts: each prompt once, several at a time in a task, with retries, a deadline and a check of
the reply."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as TooLate
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ChatModel(Protocol):
    """A client that lives on an executor. It answers a prompt with a JSON object of the schema's fields."""

    def chat_json(self, prompt: str, schema: dict) -> dict: ...


_KINDS = {"string": str, "boolean": bool, "array": list, "number": (int, float), "object": dict}
#: Calls at once in a task, attempts for a prompt, seconds between them (doubled each time), and seconds for a prompt in all.
CALLS, ATTEMPTS, PAUSE, DEADLINE = 4, 3, 0.5, 120.0


def schema_issue(reply: object, schema: dict, optional: tuple[str, ...] = ()) -> str | None:
    """How a reply misses the fields and kinds that were asked for, or None. A number is not a truth value."""
    if not isinstance(reply, dict):
        return "the reply is no object"
    for name, kind in schema.items():
        if name not in reply or reply[name] is None:
            if name in optional:
                continue
            return f"the reply has no {name}"
        if not isinstance(reply[name], _KINDS[kind]) or (kind == "number" and isinstance(reply[name], bool)):
            return f"{name} is no {kind}"
    return None


_REPLY = "key string, reply string, error string, attempts int, seconds double"


def call_model(prompts: DataFrame, model: Callable[[], ChatModel], schema: dict, store: Callable[[DataFrame], DataFrame], optional: tuple[str, ...] = (), calls: int = CALLS, attempts: int = ATTEMPTS, pause: float = PAUSE, deadline: float = DEADLINE) -> DataFrame:
    """``prompts`` with reply (JSON; null where no attempt gave one that fits the schema), error, attempts and seconds. Equal prompts are one call;
    ``store`` writes a table and reads it back, so that no model is asked twice. A null prompt is not asked. A call that doesn't come back before
    the deadline is given up; its thread is left to end by itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = model()

        def one(prompt: str) -> tuple[str | None, str | None, int, float]:
            began, error = time.monotonic(), None
            for attempt in range(1, attempts + 1):
                try:
                    reply = client.chat_json(prompt, schema)
                    error = schema_issue(reply, schema, optional)
                    if error is None:
                        return json.dumps(reply, ensure_ascii=False), None, attempt, time.monotonic() - began
                except Exception as e:  # noqa: BLE001 - whatever a client raises belongs to its row
                    error = f"{type(e).__name__}: {e}"
                wait = pause * 2 ** (attempt - 1)
                if attempt < attempts and time.monotonic() - began + wait < deadline:
                    time.sleep(wait)
                else:
                    break
            return None, error, attempt, time.monotonic() - began

        pool = ThreadPoolExecutor(calls)
        for batch in batches:
            began, futures = time.monotonic(), [pool.submit(one, p) for p in batch["prompt"]]
            rows = []
            for k, (key, future) in enumerate(zip(batch["key"], futures, strict=True)):
                try:  # a place in the queue has its turn after those before it
                    left = began + deadline * (k // calls + 1) - time.monotonic()
                    rows.append((key, *future.result(max(0.0, left))))
                except TooLate:
                    future.cancel()
                    rows.append((key, None, f"no reply within {deadline:g} seconds", attempts, deadline))
            yield pd.DataFrame(rows, columns=["key", "reply", "error", "attempts", "seconds"])
        pool.shutdown(wait=False, cancel_futures=True)

    keyed = prompts.withColumn("key", F.sha2(F.col("prompt").cast("binary"), 256))
    asked = keyed.filter("prompt is not null").groupBy("key").agg(F.first("prompt").alias("prompt"))  # equal keys are equal prompts
    replies = store(asked.mapInPandas(run, _REPLY))
    return keyed.join(replies, "key", "left").drop("key")
