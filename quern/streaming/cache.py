"""A semantic answer cache as keyed streaming state: entries expire, and the least lately used go first."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "query_id long, hit boolean, entry long, similarity double"
STATE = "entries string"


def cache_step(rows: pd.DataFrame, entries: list[dict], ttl: float, capacity: int, least: float) -> list[tuple[int, bool, int | None, float | None]]:
    """Look up and store rows (query_id, ts seconds, norm, vector) in order of time; `entries` is changed in place.

    The same normalised question is a hit at once; otherwise the nearest live entry, if it is near enough.
    A miss is stored. Beyond the capacity the entry that was used longest ago goes.
    """
    out = []
    for r in rows.sort_values(["ts", "query_id"]).itertuples():
        entries[:] = [e for e in entries if r.ts - e["stored"] <= ttl]
        found, near = next((e for e in entries if e["norm"] == r.norm), None), 1.0
        if found is None and entries:
            v = np.asarray(r.vector, float)
            size = np.linalg.norm(v)
            sims = [float(np.dot(v, e["vector"]) / max(1e-9, size * np.linalg.norm(e["vector"]))) if len(e["vector"]) == len(v) else 0.0 for e in entries]
            best = int(np.argmax(sims))
            if sims[best] >= least:
                found, near = entries[best], sims[best]
        if found is not None:
            found["used"] = r.ts
            out.append((int(r.query_id), True, found["id"], near))
            continue
        entries.append({"id": int(r.query_id), "norm": r.norm, "vector": [float(x) for x in r.vector], "stored": float(r.ts), "used": float(r.ts)})
        if len(entries) > capacity:
            entries.remove(min(entries, key=lambda e: e["used"]))
        out.append((int(r.query_id), False, None, None))
    return out


def cached(asks: DataFrame, key: str, ttl: float = 900.0, capacity: int = 128, least: float = 0.93) -> DataFrame:
    """OUTPUT rows for a stream of asks (key, query_id, ts seconds, norm, vector), with a cache of each key.

    A key's state is `capacity` entries at most, whatever the stream's length.
    """

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entries = json.loads(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames))
        out = cache_step(rows, entries, ttl, capacity, least)
        state.update((json.dumps(entries),))
        yield pd.DataFrame(out, columns=["query_id", "hit", "entry", "similarity"]).astype({"entry": "Int64"})

    return asks.groupBy(key).applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
