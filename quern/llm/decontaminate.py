"""Benchmark decontamination by winnowing.

A fingerprint is the hash of k consecutive words. Of each window of `span - k + 1` fingerprints the
least is kept, in documents and in benchmark items alike, so a shared run of `span` words always
shares a kept fingerprint. Kept fingerprints are joined, and each meeting is extended word by word to
both sides; runs of `span` words or more are hits. Items of fewer words are looked up whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, plain, text_slices
from .wordhash import runs, winnowed, words

SPAN, GRAM = 10, 5
#: Benchmark fingerprints up to which they are sent to every task (some 150 bytes each); beyond, documents' fingerprints are shuffled to them.
BROADCAST_LIMIT = 200_000

_HIT = pa.struct([("fp", pa.int64()), ("pos", pa.int32()), ("size", pa.int32()), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64()))])
_HIT_SQL = "fp:bigint,pos:int,size:int,left:array<bigint>,right:array<bigint>"


def _sides(hashes: np.ndarray, row_of: np.ndarray, at: np.ndarray, size: np.ndarray, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """The words next to each run, nearest first, SPAN - GRAM to each side; `fill` beyond the row."""
    reach, n = SPAN - GRAM, len(hashes)
    step = np.arange(reach)
    sides = []
    for place in (at[:, None] - 1 - step, (at + size)[:, None] + step):
        safe = np.clip(place, 0, max(0, n - 1))
        sides.append(np.where((place == safe) & (row_of[safe] == row_of[at][:, None]), hashes[safe].view(np.int64), fill))
    return sides[0], sides[1]


def _list(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.ravel()))


def _kept(hashes: np.ndarray, counts: np.ndarray, short: tuple[int, ...], item_side: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, word position in the slice, run length, row of each word, first word of each row)."""
    row_of = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    grams = runs(hashes, GRAM)
    at = winnowed(grams, row_of, GRAM, SPAN - GRAM + 1)
    found = [(grams[at], at, np.full(len(at), GRAM))]
    for m in short:
        if item_side:
            at = first[counts == m]
        else:
            at = np.arange(max(0, len(hashes) - m + 1))
            at = at[row_of[at] == row_of[at + m - 1]]
        found.append((runs(hashes, m)[at] ^ np.uint64(m * 0x9E3779B97F4A7C15 % 2**64), at, np.full(len(at), m)))
    prints, at, size = (np.concatenate(x) for x in zip(*found))
    size = np.where(np.arange(len(size)) < len(found[0][0]), 0, size)  # 0: a winnowed run, which is extended
    return prints.view(np.int64), at, size, row_of, first


def item_fingerprints(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, fp, size, left, right) of the kept fingerprints of benchmark items; size > 0: a whole short item."""
    source = plain(items, id_col, text_col).toDF("item_id", "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                hashes, counts = words(data, offsets)
                prints, at, size, row_of, _ = _kept(hashes, counts, tuple(range(1, SPAN)), True)
                left, right = _sides(hashes, row_of, at, np.where(size, size, GRAM), 1)
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row_of[at])), pa.array(prints), pa.array(size.astype(np.int32)), _list(left), _list(right)], ["item_id", "fp", "size", "left", "right"])

    kind = source.schema["item_id"].dataType.simpleString()
    return source.mapInArrow(scan, f"item_id {kind}, fp long, size int, left array<long>, right array<long>").distinct()


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """(doc_id, text_key, n_words, spans, items): one row per input row.

    spans: array of (start, stop) word positions that are hit; items: ids of the items that hit, sorted
    as strings. text_key is a 64-bit hash of the text, by which rows of one id are told apart.

    Words are compared by 64-bit hashes. Null texts have no words, in documents as in items; items
    without words never hit. Items without an id hit but are not listed. Repeated rows each return a row,
    repeated items count once, and an empty table on either side gives no hits. Other columns are ignored.
    """
    import xxhash

    spark = docs.sparkSession
    source = plain(docs, id_col, text_col).toDF("doc_id", "text")
    prints = item_fingerprints(benchmark, item_col, item_text_col)
    sizes = [r[0] for r in prints.where("size > 0").select("size").distinct().collect()]  # at most SPAN - 1 numbers
    short, wanted, few = tuple(sorted(sizes)), None, False
    if prints.limit(broadcast_limit + 1).count() <= broadcast_limit:
        few = True
        wanted = spark.sparkContext.broadcast(np.unique(prints.select("fp").distinct().toArrow().column(0).to_numpy()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                hashes, counts = words(data, offsets)
                fps, at, size, row_of, first = _kept(hashes, counts, short, False)
                if wanted is not None:
                    known = wanted.value
                    place = np.minimum(np.searchsorted(known, fps), max(0, len(known) - 1))
                    hit = np.flatnonzero(known[place] == fps) if len(known) else np.zeros(0, np.int64)
                    fps, at, size = fps[hit], at[hit], size[hit]
                n = len(counts)
                # each row begins with an element without fingerprint, which stands for the row itself
                order = np.argsort(np.concatenate([np.arange(n), row_of[at]]), kind="stable")
                real = order >= n
                pick = order[real] - n
                at, size, fps = at[pick], size[pick], fps[pick]
                full = {"fp": np.zeros(len(order), np.int64), "pos": np.full(len(order), -1, np.int32), "size": np.full(len(order), -1, np.int32)}
                full["fp"][real], full["pos"][real], full["size"][real] = fps, at - first[row_of[at]], size
                left, right = (np.zeros((len(order), SPAN - GRAM), np.int64) for _ in range(2))
                if len(at):
                    left[real], right[real] = _sides(hashes, row_of, at, np.where(size, size, GRAM), 0)
                items = pa.StructArray.from_arrays([pa.array(full["fp"], mask=~real), pa.array(full["pos"]), pa.array(full["size"]), _list(left), _list(right)], fields=list(_HIT))
                ends = np.concatenate([[0], np.cumsum(1 + np.bincount(row_of[at], minlength=n))]).astype(np.int32)
                whole = data.tobytes()
                keys = np.array([xxhash.xxh64_intdigest(whole[offsets[i] : offsets[i + 1]], 42) for i in range(n)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(keys), pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), items)], ["doc_id", "text_key", "n_words", "hits"])

    kind = source.schema["doc_id"].dataType.simpleString()
    scanned = materialise(source.mapInArrow(scan, f"doc_id {kind}, text_key long, n_words long, hits array<struct<{_HIT_SQL}>>"))  # a task runs one Python function at a time
    hits = scanned.select("doc_id", "text_key", "n_words", F.explode("hits").alias("h")).select("doc_id", "text_key", "n_words", "h.*")
    other = prints.select("item_id", "fp", F.col("size").alias("i_size"), F.col("left").alias("i_left"), F.col("right").alias("i_right"))
    if few:
        met = hits.join(F.broadcast(other), "fp", "left")
    else:  # rows that stand for documents have no fingerprint and don't go through the join
        nothing = [F.lit(None).cast(other.schema[c].dataType).alias(c) for c in other.columns if c != "fp"]
        met = hits.where("fp is not null").join(other, "fp").unionByName(hits.where("fp is null").select("*", *nothing))
    item_kind = prints.schema["item_id"].dataType.simpleString()

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c, b=batch: b.column(b.schema.get_field_index(c))
            n = batch.num_rows
            pos, size = get("pos").to_numpy(zero_copy_only=False), get("size").to_numpy(zero_copy_only=False)
            met = np.asarray(get("i_size").is_valid())
            start, stop = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
            if met.any():
                side = lambda c: np.asarray(get(c).filter(pa.array(met)).flatten()).reshape(-1, SPAN - GRAM)
                reach = [np.cumprod(side(c) == side(f"i_{c}"), axis=1).sum(axis=1) for c in ("left", "right")]
                p, s, i = pos[met], size[met], get("i_size").filter(pa.array(met)).to_numpy(zero_copy_only=False)
                good = (s == i) & ((s > 0) | (reach[0] + reach[1] + GRAM >= SPAN))
                start[met] = np.where(good, np.where(s > 0, p, p - reach[0]), -1)
                stop[met] = np.where(good, np.where(s > 0, p + s, p + GRAM + reach[1]), -1)
            mark = pos < 0
            keep = pa.array(np.flatnonzero(mark | (start >= 0)))
            spans = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], names=["start", "stop"], mask=pa.array(start < 0))
            out = [get("doc_id"), get("text_key"), get("n_words"), pa.array(mark.astype(np.int64)), spans, get("item_id")]
            yield pa.RecordBatch.from_arrays([x.take(keep) for x in out], ["doc_id", "text_key", "n_words", "rows", "span", "item_id"])

    spans = met.mapInArrow(extend, f"doc_id {kind}, text_key long, n_words long, rows long, span struct<start:int,stop:int>, item_id {item_kind}")
    found = spans.groupBy("doc_id", "text_key", "n_words").agg(F.sum("rows").cast("int").alias("rows"), F.collect_set("span").alias("spans"), F.collect_set("item_id").alias("items"))
    found = found.withColumn("items", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return found.select("doc_id", "text_key", "n_words", "spans", "items", F.explode(F.array_repeat(F.lit(0), F.col("rows"))).alias("_")).drop("_")


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """find_contamination() with counts and a digest of the items: the form of query op3."""
    words_hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["stop"] - 1)))))
    found = find_contamination(docs, benchmark, **options)
    return found.select(
        "doc_id",
        "n_words",
        F.when(F.size("spans") > 0, words_hit).otherwise(0).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", drop_limit: int = 1_000_000, **options) -> DataFrame:
    """`docs` without the rows that hold a benchmark passage; clean rows and all columns stay as they are.

    Rows are judged one by one, also those that repeat an id or have none. Null texts hold nothing and stay. An empty
    table on either side drops nothing. drop_limit: rows to drop (some 50 bytes each) up to which they are
    broadcast; beyond, the texts are shuffled to them.
    """
    found = find_contamination(docs, benchmark, id_col=id_col, text_col=text_col, **options).where(F.size("spans") > 0)
    bad = materialise(found.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text")).distinct())
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))) == F.col("__text"))
    kept = docs.join(F.broadcast(bad) if bad.count() <= drop_limit else bad, same, "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
