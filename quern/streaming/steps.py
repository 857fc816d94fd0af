"""Frames of answers in the making, and timers of what is left open, as keyed streaming state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FRAMES = "request_id long, pos int, frame string"
ALERTS = "request_id long, voted long, hours int"
MICROS = 1_000_000


def frame(kind: str, data: dict) -> str:
    return f"event: {kind}\ndata: {json.dumps(data, ensure_ascii=False)}\n\n"


def step_frames(state: dict, rows: list[tuple[int, str, str]], words: int = 4) -> list[tuple[int, str]]:
    """Take rows (seq, kind, text) of one request into `state`, and return the frames (pos, frame) that are due.

    Steps count from 0 and go out in this order, each once, however they arrive; a repeated number is passed over. kind: node, answer_delta,
    final or error. The last two end the request. An answer of which no part went out before is
    sent in parts of `words` words ahead of the final frame.
    """
    out = []

    def send(kind: str, data: dict) -> None:
        out.append((state["pos"], frame(kind, data)))
        state["pos"] += 1

    for seq, kind, text in rows:
        if seq >= state["next"] and not state["done"]:
            state["held"].setdefault(str(seq), [kind, text])
    while not state["done"] and str(state["next"]) in state["held"]:
        kind, text = state["held"].pop(str(state["next"]))
        state["next"] += 1
        if kind == "node":
            send("node", {"step": text})
        elif kind == "answer_delta":
            state["parts"] += 1
            send("answer_delta", {"delta": text})
        else:
            if kind == "final" and not state["parts"]:
                said = text.split(" ")
                for i in range(0, len(said), words):
                    send("answer_delta", {"delta": " ".join(said[i : i + words]) + " " * (i + words < len(said))})
            send(kind, {"answer" if kind == "final" else "error": text})
            state["done"], state["held"] = True, {}
    return out


def _by_request(key: tuple, frames: Iterator[pd.DataFrame], *columns: str) -> dict[int | None, list[tuple]]:
    """The rows of each request of a run of ids, in the order in which they came; rows without an id are a run of their own."""
    out: dict[int | None, list[tuple]] = {}
    for f in frames:
        for request, *row in zip(f["request_id"].tolist() if not pd.isna(key[0]) else [None] * len(f), *[f[c].tolist() for c in columns]):
            out.setdefault(request, []).append(tuple(row))
    return out


def _run(span: int) -> Column:
    """Requests whose ids differ in the last `span` bits only are a run: one state, and one call of Python for all of them."""
    return F.shiftright(F.col("request_id").cast("long"), span)


def answer_frames(steps: DataFrame, words: int = 4, span: int = 10) -> DataFrame:
    """FRAMES of a stream of steps (request_id, seq, kind, text), in order by request and once, over restarts too.

    A request's state is the steps that wait for one before them; of an ended one only a few numbers stay. Runs of 2**span ids share a row of state.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own, out = json.loads(state.get[0]) if state.exists else {}, []
        for request, rows in _by_request(key, frames, "seq", "kind", "text").items():
            mine = own.setdefault(str(request), {"next": 0, "pos": 0, "parts": 0, "done": False, "held": {}})
            out += [(request, pos, text) for pos, text in step_frames(mine, rows, words)]
        state.update((json.dumps(own),))
        yield pd.DataFrame(out, columns=["request_id", "pos", "frame"])

    return steps.withColumn("run", _run(span)).groupBy("run").applyInPandasWithState(step, FRAMES, "waiting string", "append", GroupStateTimeout.NoTimeout)


def age_alerts(state: dict, rows: list[tuple[int, str]], now: int | None, hours: tuple[int, ...]) -> list[tuple[int, int]]:
    """Take rows (micros, kind) into `state` and return the alerts (voted, hours) that are due by them, or by the watermark `now`.

    A downvote opens an item and starts its timers, another one starts them anew; an upvote or a resolution cancels them. A timer
    fires if what comes next for the request is later than it.
    """
    out = []

    def fire(until: int) -> None:
        while state["voted"] is not None and state["stage"] < len(hours):
            due = state["voted"] + hours[state["stage"]] * 3600 * MICROS
            if due >= until:
                break
            out.append((state["voted"], hours[state["stage"]]))
            state["stage"] += 1

    for ts, kind in sorted(rows):
        fire(ts)
        state["voted"], state["stage"] = (ts, 0) if kind == "down" else (None, 0)
    if now is not None:
        fire(now)
    return out


def open_item_alerts(changes: DataFrame, hours: tuple[int, ...] = (6, 48), late: str = "10 minutes", span: int = 13) -> DataFrame:
    """ALERTS of a stream of changes (request_id, ts, kind: down, up or resolved): items that stay open for so many hours.

    Timers run in event time: the watermark, `late` behind the newest change, fires those of requests of which nothing more is heard. An open
    item's state is two numbers. Runs of 2**span ids share a row of state, whose timer is that of the item that is due next.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = {None if k == "None" else int(k): v for k, v in json.loads(state.get[0]).items()} if state.exists else {}
        rows = {} if state.hasTimedOut else _by_request(key, frames, "micros", "kind")
        mark, out, left = state.getCurrentWatermarkMs(), [], {}
        for request in {**own, **rows}:
            voted, stage = own.get(request, (None, 0))
            mine = {"voted": voted, "stage": stage}
            out += [(request, *x) for x in age_alerts(mine, rows.get(request, []), mark * 1000 if mark > 0 else None, hours)]
            if mine["voted"] is not None and mine["stage"] < len(hours):
                left[request] = (mine["voted"], mine["stage"])
        if left:
            state.update((json.dumps(left if None not in left else {"None": left[None]}),))
            due = min(voted + hours[stage] * 3600 * MICROS for voted, stage in left.values()) // 1000
            state.setTimeoutTimestamp(max(due, mark + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["request_id", "voted", "hours"])

    timed = changes.selectExpr("request_id", "cast(ts AS timestamp) AS ts", "unix_micros(cast(ts AS timestamp)) AS micros", "kind").withWatermark("ts", late)
    return timed.withColumn("run", _run(span)).groupBy("run").applyInPandasWithState(step, ALERTS, "open string", "append", GroupStateTimeout.EventTimeTimeout)
