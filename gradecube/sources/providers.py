"""Calls to the providers of models, never more at once than each allows.

The rows of a provider are dealt to a fixed number of slots, each a Spark partition of its own with a small pool of
threads; slots times threads is the provider's limit. So the limit holds over the whole cluster without a lock or a
service, and a provider with few calls at once holds up no other. Each task makes its clients when they are first
asked for and closes them at its end.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from threading import Lock
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .responders import retried

#: Calls at once that each provider allows.
LIMITS = {
    "openai": 8,
    "anthropic": 8,
    "google": 3,
    "grok": 8,
    "deepseek": 8,
    "together": 8,
    "perplexity": 8,
    "kimi": 10,
    "mistral": 2,
    "minimax": 8,
}
#: Fixed value: calls at once of any other provider.
OTHERS = 5
#: Threads of a slot at most.
POOL = 4


class Client(Protocol):
    def ask(self, model_id: str, prompt: str) -> tuple[str, int, int]:
        """The reply and the tokens in and out; an exception if the call failed."""


class Clients:
    """One client for each key, made when first asked for and closed with the others."""

    def __init__(self, connect: Callable[[str], Client]):
        self.connect, self.made, self.lock = connect, {}, Lock()

    def of(self, key: str) -> Client:
        with self.lock:
            if key not in self.made:
                self.made[key] = self.connect(key)
            return self.made[key]

    def close(self) -> None:
        """Close every client that can be closed; one that fails does not keep the others open."""
        for client in self.made.values():
            if hasattr(client, "close"):
                with suppress(Exception):
                    client.close()
        self.made.clear()


def slots(providers: list[str], limits: dict[str, int] | None = None, pool: int = POOL) -> list[tuple[str, int]]:
    """provider and threads of each slot; the threads of a provider's slots add up to its limit."""
    out = []
    for p in providers:
        limit = max(1, (limits or LIMITS).get(p, OTHERS))
        n = -(-limit // pool)
        out += [(p, limit // n + (k < limit % n)) for k in range(n)]
    return out


def asked(requests: DataFrame, providers: list[str], connect: Callable[[str], Client], limits: dict[str, int] | None = None, pool: int = POOL) -> DataFrame:
    """requests (provider, model_id, prompt and any others) with text, in_tok, out_tok, seconds and error of each call.

    A call that fails gives a row with its error and no text. providers: all that occur; a row of any other, or of none,
    is given an error, for no slot keeps its limit. Run it without speculation, as a second copy of a task would call
    beside the first; a task that is started anew after a loss calls again.
    """
    dealt = slots(sorted(set(providers)), limits, pool)
    first, many, threads = {}, {}, {}
    for k, (p, n) in enumerate(dealt):
        first.setdefault(p, k)
        many[p] = many.get(p, 0) + 1
        threads[k] = n
    names = requests.columns
    known = lambda table, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("provider")), F.lit(other)) if table else F.lit(other)
    slot = known(first, len(dealt)) + F.pmod(F.xxhash64("model_id", "prompt"), known(many, 1)).cast("int")
    rows = requests.withColumn("_slot", slot).repartitionById(len(dealt) + 1, F.col("_slot"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clients = Clients(connect)

        def call(row: tuple) -> tuple:
            provider, model_id, prompt, at = row
            began = time.time()
            if at not in threads:
                return None, 0, 0, 0.0, f"unknown provider: {provider}"
            try:
                client = clients.of(provider)
                text, i, o = retried(client.ask, model_id, prompt)
                return text, i, o, time.time() - began, None
            except Exception as e:  # the error is the row's result
                return None, 0, 0, time.time() - began, str(e)[:200]

        try:
            for b in batches:
                at = b.column("_slot").to_pylist()
                with ThreadPoolExecutor(threads.get(at[0], 1) if at else 1) as workers:
                    out = list(workers.map(call, zip(*(b.column(c).to_pylist() for c in ("provider", "model_id", "prompt")), at, strict=True)))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], names=[*names, "text", "in_tok", "out_tok", "seconds", "error"])
        finally:
            clients.close()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    return rows.mapInArrow(run, schema + ", text string, in_tok long, out_tok long, seconds double, error string")
