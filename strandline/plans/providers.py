"""What needs a model or a reader from outside: plain protocols, called batch by batch where the rows are.

The defaults are deterministic and offline: no hints, no vectors, an answer that echoes the context's begin, and a
judge that passes everything. A provider that fails, or that takes longer than its policy allows, is asked again as often
as that says, and then yields its default, so a job goes on without it; a status column tells what happened.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.text import unfenced

HINTS = "struct<sub_queries:array<string>,likely_criteria:array<string>,likely_chapters:array<string>,key_concepts:array<string>>"
#: How many of each hint are used.
LIMITS = {"sub_queries": 4, "likely_criteria": 6, "likely_chapters": 4, "key_concepts": 5}


class Provider(Protocol):
    def __call__(self, texts: list[str]) -> list[str | None]: ...


def no_hints(texts: list[str]) -> list[str | None]:
    return [None] * len(texts)


def echo(texts: list[str]) -> list[str | None]:
    return [t[:200] for t in texts]


def passes(texts: list[str]) -> list[str | None]:
    return ['{"verdict": "PASS"}'] * len(texts)


@dataclass(frozen=True)
class Policy:
    """How a provider is called: texts in a call, seconds that a call may take, calls after the first that fails, the
    pause before each (longer each time), and what stands for a reply in the end (None: the error's name)."""

    texts: int = 64
    seconds: float | None = None
    retries: int = 0
    pause: float = 0.0
    default: str | None = None


#: Calls of a task that were given up but still run; with more, the oldest is waited for.
GIVEN_UP = 8


class Caller:
    """One client of a task, called by a policy."""

    def __init__(self, client: Provider, policy: Policy):
        self.client, self.policy, self.running = client, policy, []

    def once(self, texts: list[str]) -> list[str | None]:
        """The replies; raises what the provider raises, or that it is late."""
        if self.policy.seconds is None:
            return self.checked(texts, self.client(texts))
        box: list = []

        def work() -> None:
            try:
                box.append((self.client(texts), None))
            except Exception as error:  # handed over to the caller
                box.append((None, error))

        self.running = [t for t in self.running if t.is_alive()]
        if len(self.running) >= GIVEN_UP:
            self.running.pop(0).join()
        thread = threading.Thread(target=work, daemon=True)
        thread.start()
        thread.join(self.policy.seconds)
        if not box:
            self.running.append(thread)
            raise TimeoutError
        found, error = box[0]
        if error is not None:
            raise error
        return self.checked(texts, found)

    @staticmethod
    def checked(texts: list[str], found) -> list[str | None]:
        found = list(found)
        if len(found) != len(texts):
            raise ValueError("a provider must give one reply for each text")
        return found

    def __call__(self, texts: list[str]) -> tuple[list[str | None], str]:
        """Replies and a status: ok, retried, late or failed."""
        status = "ok"
        for k in range(self.policy.retries + 1):
            try:
                return self.once(texts), status
            except Exception as error:  # a reply like any other, and visible as one
                last = error
                status = "retried"
                time.sleep(self.policy.pause * (k + 1) if k < self.policy.retries else 0)
        reply = self.policy.default if self.policy.default is not None else f"[ERROR {type(last).__name__}]"
        return [reply] * len(texts), "late" if isinstance(last, TimeoutError) else "failed"


def ask(
    rows: DataFrame, column: str, out: str, make: Callable[[], Provider] | Provider, default: str | None = None, factory: bool = False, policy: Policy | None = None, status: str | None = None
) -> DataFrame:
    """Add ``out``: a provider's replies to ``column``, and with ``status`` a column that says how they came. With
    ``factory``, ``make`` gives one client per task. ``policy``: how it is called."""
    policy = policy or Policy(default=default)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = Caller(make() if factory else make, policy)
        for pdf in batches:
            texts, found, told = pdf[column].fillna("").tolist(), [], []
            for at in range(0, len(texts), policy.texts):
                some = texts[at : at + policy.texts]
                replies, how = call(some)
                found += replies
                told += [how] * len(some)
            more = {out: pd.Series(found, index=pdf.index, dtype=object)} | ({status: pd.Series(told, index=pdf.index, dtype=object)} if status else {})
            yield pdf.assign(**more)

    names = [out, status] if status else [out]
    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, *[T.StructField(n, T.StringType()) for n in names]]))


def hints(replies: DataFrame, column: str) -> DataFrame:
    """Replies as hints, empty where a reply is missing or isn't such JSON, cut to the limits."""
    h = F.from_json(unfenced(F.col(column)), HINTS)
    parts = [F.slice(F.coalesce(h[k], F.array().cast("array<string>")), 1, n).alias(k) for k, n in LIMITS.items()]
    return replies.withColumn("hints", F.struct(*parts))
