"""Blocking pops: pushes and waiting clients of a key meet first come, first served, as a stream, or in one go where all
is known. Lists give the item that came first, sorted sets the member of the least or greatest score."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from keelson.sources.keyspace import numbered

OUT = "key string, client string, value string"
STATE = "items array<string>, waiting array<string>, until array<long>"


def serve(largest: bool | None, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows (key, at, kind, client, value, score, timeout_ms): a push brings a value, a pop a client that waits so long (0:
    without end). largest None is a list; else the value of the greatest or least score goes, ties by value."""
    items, waiting, until = (list(x) for x in state.get) if state.exists else ([], [], [])
    items = [json.loads(x) for x in items]  # (score, value)
    rows = pd.concat(list(batches)).sort_values("at", kind="stable") if not state.hasTimedOut else None
    out: list[tuple[str, str, str]] = []
    now = state.getCurrentProcessingTimeMs()
    if rows is not None:
        for r in rows.itertuples(index=False):
            if r.kind == "push":
                items.append([float(r.score) if largest is not None else 0.0, r.value])
            else:
                waiting.append(r.client)
                until.append(now + int(r.timeout_ms) if r.timeout_ms else 1 << 62)
            while items and waiting:
                at = 0 if largest is None else items.index((max if largest else min)(items))
                out.append((key[0], waiting.pop(0), items.pop(at)[1]))
                until.pop(0)
    alive = [i for i, t in enumerate(until) if t > now]
    waiting, until = [waiting[i] for i in alive], [until[i] for i in alive]
    if items or waiting:
        state.update(([json.dumps(x) for x in items], waiting, until))
        if until and min(until) < 1 << 62:
            state.setTimeoutDuration(max(1, min(until) - now))
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=["key", "client", "value"])


def blocking_pops(requests: DataFrame, largest: bool | None = None) -> DataFrame:
    """(key, client, value) as clients are served; requests is a stream of (key, at, kind, client, value, score, timeout_ms).

    Clients' time runs out by the clock, so a query goes on for as long as it may be asked; one with the trigger
    `once` serves what has come and ends, and the next goes on from its checkpoint.
    """
    return requests.groupBy("key").applyInPandasWithState(partial(serve, largest), OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def in_turn(clients: DataFrame, items: DataFrame) -> DataFrame:
    """Items (key, place, ...) that are there before any client comes, given to clients (key, client, at) in their order:
    the n-th client gets the item at place n. Clients beyond the last item wait on."""
    placed = numbered(clients, ["key"], F.asc("at"), F.asc("client"), name="place").select("key", "client", "place")
    return placed.join(items, ["key", "place"]).drop("place")
