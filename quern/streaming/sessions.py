"""Session memory and ingestion jobs as streams."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "session_id string, turn int, question string, effective_question string, applied boolean"


def remember(turns: DataFrame, cap: int = 20, idle: str | None = None) -> DataFrame:
    """OUTPUT rows for a stream of turns (session_id, turn, question, route, own array<string>, cue boolean).

    A session's state is its last `cap` turns' entities; a question without entities that is short or refers
    back takes the first two of the latest document turn that has any.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory: list[list[str]] = json.loads(state.get[0]) if state.exists else []
        out = []
        for r in pd.concat(list(frames)).sort_values("turn").itertuples():
            own, question = list(r.own), r.question.strip()
            inherited = next((m for m in reversed(memory) if m), [])[:2]
            applied = not own and bool(inherited) and (r.cue or len(question.split()) <= 6)
            out.append((key[0], int(r.turn), r.question, f"{question} {' '.join(inherited)}" if applied else question, applied))
            memory = [*memory, own if r.route == "document" else []][-cap:]
        state.update((json.dumps(memory),))
        yield pd.DataFrame(out, columns=["session_id", "turn", "question", "effective_question", "applied"])

    return turns.groupBy("session_id").applyInPandasWithState(step, OUTPUT, "memory string", "append", GroupStateTimeout.NoTimeout)


def latency_buckets(events: DataFrame, bounds: tuple[float, ...]) -> DataFrame:
    """(route, slot, n): running counts by bucket, the histogram's state."""
    slot = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("value") / 1000))
    return events.groupBy(F.col("event_type").alias("route"), slot.alias("slot")).agg(F.count("*").alias("n"))


KEPT = "bucket int, version long, session_id string, last long"


def newest_sessions(lasts: dict[str, int], rows: list[tuple[str, int]], cap: int) -> dict[str, int]:
    """The `cap` sessions of latest activity after rows (session_id, micros); equal times go by the smaller id. What is late changes nothing that is newer."""
    for session, ts in rows:
        lasts[session] = max(ts, lasts.get(session, ts))
    return dict(sorted(lasts.items(), key=lambda x: (-x[1], x[0]))[:cap])


def live_sessions(turns: DataFrame, cap: int = 200, buckets: int = 16) -> DataFrame:
    """KEPT rows for a stream of turns (session_id, ts): after each batch the sessions that a bucket keeps, under a rising version.

    The least recently active sessions go, over all keys: the newest `cap` of all are among the newest `cap` of their
    bucket, so a bucket's state has `cap` sessions at most and merged_sessions() finds those that stay.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, lasts = json.loads(state.get[0]) if state.exists else (0, {})
        rows = [(s, int(t)) for f in frames for s, t in zip(f["session_id"], f["micros"])]
        lasts = newest_sessions(lasts, rows, cap)
        state.update((json.dumps([version + 1, lasts]),))
        yield pd.DataFrame([(key[0], version + 1, s, t) for s, t in lasts.items()], columns=["bucket", "version", "session_id", "last"])

    session = F.col("session_id").cast("string")
    rows = turns.where("session_id IS NOT NULL AND ts IS NOT NULL").select(F.pmod(F.xxhash64(session), F.lit(buckets)).cast("int").alias("bucket"), session.alias("session_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    return rows.groupBy("bucket").applyInPandasWithState(step, KEPT, "kept string", "append", GroupStateTimeout.NoTimeout)


def merged_sessions(kept: DataFrame, cap: int = 200) -> DataFrame:
    """(session_id, last): the newest sessions of all buckets' last versions; a bucket has `cap` rows at most."""
    newest = kept.groupBy("bucket").agg(F.max("version").alias("version"))
    return kept.join(newest, ["bucket", "version"]).orderBy(F.desc("last"), "session_id").limit(cap).select("session_id", "last")


JOBS = "job_id string, doc string, state string, error string, chunks long"


def ingest_jobs(files: DataFrame, out: str, checkpoint: str, jobs: str):
    """Take files as they arrive, each as a job that is queued, processing and then done or failed.

    A batch's chunks are a folder of `out`, the rows JOBS of each of its steps a folder of `jobs`, and both are written again
    if a batch is. A file without a reader or without any text fails with the reason, and the others go on.
    """
    from ..jobs.ingest import chunks_of_files
    from ..sources import documents
    from ..sources.tables import kept

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        named = batch.select(F.substring(F.sha2("path", 256), 1, 16).alias("job_id"), "doc", "path")

        def put(rows: DataFrame, step: int) -> None:
            rows.selectExpr("job_id", "doc", "state", "cast(error AS string) AS error", "cast(chunks AS long) AS chunks").write.mode("overwrite").parquet(f"{jobs}/batch={number}/step={step}")

        begun = lambda state: named.select("job_id", "doc", F.lit(state).alias("state"), F.lit(None).alias("error"), F.lit(None).alias("chunks"))
        put(begun("queued"), 0)
        put(begun("processing"), 1)
        chunks_of_files(batch).where(F.trim("text") != "").write.mode("overwrite").parquet(f"{out}/job={number}")
        counts = spark.read.schema("doc string").parquet(f"{out}/job={number}").groupBy("doc").agg(F.count("*").alias("chunks"))
        reasons = kept(documents.unread(batch))
        ended = named.join(reasons, "path", "left").join(counts, "doc", "left")
        error = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("chunks").isNull(), "no extractable text")
        put(ended.select("job_id", "doc", F.when(error.isNull(), "done").otherwise("failed").alias("state"), error.alias("error"), F.when(error.isNull(), F.col("chunks")).alias("chunks")), 2)

    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(run).start()


def job_states(jobs: DataFrame) -> DataFrame:
    """JOBS as they are now: the last step of the last batch of each, of rows with batch and step."""
    last = F.max_by(F.struct("doc", "state", "error", "chunks"), F.struct("batch", "step"))
    return jobs.groupBy("job_id").agg(last.alias("now")).select("job_id", "now.*")
