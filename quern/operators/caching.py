"""Answers served again: for each ask the cache entry of its own question, or else the nearest that is still live."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranking as R


def live_matches(entries: DataFrame, asks: DataFrame, *, ttl: float, least: float = 0.93, block: int = 2_048) -> DataFrame:
    """(query_id, tier, entry, similarity) of every ask: exact, near or miss. Rows on both sides: (id, ts, norm, top_k, vector).

    An entry is live for asks after it, up to `ttl` later. The latest live entry of the same normal question comes first, whatever its
    top_k; else the nearest live one by cosine of the same top_k, if it is at least `least` near; ties go to the smaller id.

    Both tiers meet by stretches of time as long as an entry lives, so an ask looks at two of them; exact questions are reduced to
    the latest of a stretch and question first. Near ones are compared in blocks of asks that are neighbours in time.
    """
    stretch = F.floor(F.col("ts") / ttl)
    own = asks.withColumn("stretch", stretch)
    both = own.withColumn("stretch", F.explode(F.array(F.col("stretch"), F.col("stretch") - 1)))
    known = entries.select(stretch.alias("stretch"), "norm", F.col("ts").alias("stored"), F.col("id").alias("entry"))
    met = both.select("id", "ts", "norm", "stretch").join(known, ["norm", "stretch"]).where((F.col("stored") < F.col("ts")) & (F.col("ts") - F.col("stored") <= ttl))
    exact = met.groupBy("id").agg(F.max_by("entry", F.struct("stored", "entry")).alias("exact"))
    near = _nearest(entries, asks.join(exact, "id", "left_anti"), ttl, least, block)
    rows = asks.select(F.col("id").alias("query_id")).join(exact.withColumnRenamed("id", "query_id"), "query_id", "left").join(near, "query_id", "left")
    tier = F.when(F.col("exact").isNotNull(), "exact").when(F.col("near").isNotNull(), "near").otherwise("miss")
    return rows.select("query_id", tier.alias("tier"), F.coalesce("exact", "near").alias("entry"), F.when(F.col("exact").isNotNull(), 1.0).otherwise(F.col("score")).alias("similarity"))


def _nearest(entries: DataFrame, asks: DataFrame, ttl: float, least: float, block: int) -> DataFrame:
    spark, out = entries.sparkSession, None
    kind = entries.schema["id"].dataType.simpleString()
    places = -(-max(1, asks.count()) // block)
    edges = asks.select(F.col("ts").cast("double").alias("ts")).approxQuantile("ts", [i / places for i in range(1, places)], 0.001) if places > 1 else []
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        t = F.col("ts").cast("double")
        part = asks.where((F.lit(True) if low is None else t > low) & (F.lit(True) if high is None else t <= high))
        held = part.select("id", t.alias("ts"), F.col("top_k").cast("string").alias("top_k"), "vector").toArrow()
        if not held.num_rows:
            continue
        q = np.array(held.column("vector").to_pylist(), float)
        q /= np.maximum(np.linalg.norm(q, axis=1), 1e-9)[:, None]
        when = held.column("ts").to_numpy()
        shared = spark.sparkContext.broadcast((held.column("id").to_numpy(), when, np.array(held.column("top_k").to_pylist(), object), q))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, when, kinds, q = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                order = np.argsort(batch.column(0).to_numpy(zero_copy_only=False), kind="stable")
                entry, ts = batch.column(0).to_numpy(zero_copy_only=False)[order], batch.column(1).to_numpy()[order]
                same = np.array(batch.column(2).to_pylist(), object)[order]
                x = np.asarray(batch.column(3).flatten(), float).reshape(len(entry), -1)[order]
                score = q @ (x / np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]).T
                age = when[:, None] - ts
                score[(age <= 0) | (age > ttl) | (kinds[:, None] != same) | (np.round(score, 6) < least)] = -np.inf
                at = np.argmax(np.round(score, 6), axis=1)
                top = score[np.arange(len(ids)), at]
                good = np.isfinite(top)
                yield pa.RecordBatch.from_arrays([pa.array(ids[good]), pa.array(entry[at][good]), pa.array(top[good])], ["query_id", "chunk_id", "score"])

        live = entries.where((t < float(when.max())) & (t >= float(when.min()) - ttl))
        found = live.select("id", t.alias("ts"), F.col("top_k").cast("string").alias("top_k"), "vector").mapInArrow(best, f"query_id {kind}, chunk_id {kind}, score double")
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], f"query_id {kind}, chunk_id {kind}, score double")
    return R.top_k(out, 1).select("query_id", F.col("chunk_id").alias("near"), "score")
