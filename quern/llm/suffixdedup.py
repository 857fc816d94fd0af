"""Removal of long byte strings that occur earlier in the corpus, by prefix doubling.

Doubling ranks the positions of the corpus by the strings of a length that begin there, then pairs the rank at a
position with that at an offset, which makes the rank for a greater length; it goes on until a rank is unique or
the length reaches the threshold. Byte positions of a corpus are too many to be sorted over and over, so the
first ranks are sparse. Every `size`-byte string has an anchor, the least gram in it (see anchors.py),
and equal strings have it at the same distance from their start. A row is an anchor with the range of
distances at which strings belong to it. Its name is a hash of what all its strings share (the core);
the whole is a hash of all bytes of its strings together.

 * A core that occurs once: none of the row's strings repeats. The row is unique and is done.
 * A whole that occurs earlier: all of the row's strings do. Their bytes are removed, the row is done.
 * Otherwise the range is cut into blocks of at most BLOCK distances, whose cores are longer.

This is done for cores of GRAM and then of `size` - BLOCK + 1 bytes. What is left are a few positions in a hundred, and
these are doubled one by one: Spark sorts the pairs of names of two strings of a quarter of the size and ranks those that
occur twice, drops the positions whose pair is their own, ranks the halves at the offset in the same way, and
sorts the pairs of ranks, which stand for strings of the whole size. The answer is exact, up to 64-bit hashes of what is named. Tasks settle repeated wholes among their own rows before they shuffle any, so a passage in
a third of all documents sends few rows; counts are pre-aggregated and joined back by joins that Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .anchors import prefix_sums, stretch, window_anchors
from .common import discard, materialise, plain, text_slices
from .wordhash import mix

GRAM = 24
#: Distances in a block's range; its core is `size` less this plus one bytes.
BLOCK = 32
#: Rows that a task holds to settle repeats among them.
HELD = 100_000
#: Bytes of text or context that a task works on at once.
SLICE = 1 << 18

_ROW = "removed boolean, core long, whole long, doc long, at int, near int, far int"
_FIELDS = ("core", "whole", "doc", "at", "near", "far")


def _settle(rows: dict[str, np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows to go on with, (document, start, stop) of bytes to remove) of the rows that a task holds.

    Of rows with one whole all but the earliest are repeats. The rows' wholes are told apart by core, whole
    and range.
    """
    order = np.lexsort((rows["at"], rows["doc"]))
    key = mix(rows["core"].view(np.uint64) ^ mix(rows["whole"].view(np.uint64) + (rows["near"].astype(np.uint64) << np.uint64(8)) + rows["far"].astype(np.uint64)))
    order = order[np.argsort(key[order], kind="stable")]
    sorted_key = key[order]
    new = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
    first = order[np.repeat(new, np.diff(np.concatenate([new, [len(order)]])))]
    same = (rows["core"][order] == rows["core"][first]) & (rows["whole"][order] == rows["whole"][first])
    later = same & ((rows["doc"][order] != rows["doc"][first]) | (rows["at"][order] != rows["at"][first]))
    gone = order[later]
    start, stop = rows["at"][gone] - rows["far"][gone], rows["at"][gone] - rows["near"][gone] + size
    return np.sort(order[~later]), merged(rows["doc"][gone], start, stop)


def merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Rows (document, start, stop) with touching stretches of a document joined."""
    if not len(doc):
        return np.zeros((0, 3), np.int64)
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order].astype(np.int64), stop[order].astype(np.int64)
    new_doc = np.concatenate([[True], doc[1:] != doc[:-1]])
    group = np.cumsum(new_doc)
    shift = group * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + shift)
    new = new_doc | np.concatenate([[True], start[1:] + shift[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return np.column_stack([doc[at], start[at], np.maximum.reduceat(stop, at)])


def _batch(rows: dict[str, np.ndarray], keep: np.ndarray, gone: np.ndarray, context: list[bytes] | None = None) -> pa.RecordBatch:
    n, g = len(keep), len(gone)
    pad = lambda x, t: np.concatenate([x, np.zeros(g, t)]).astype(t)
    columns = [
        pa.array(np.arange(n + g) >= n),
        pa.array(pad(rows["core"][keep], np.int64)),
        pa.array(pad(rows["whole"][keep], np.int64)),
        pa.array(np.concatenate([rows["doc"][keep], gone[:, 0]])),
        pa.array(pad(rows["at"][keep], np.int32)),
        pa.array(np.concatenate([rows["near"][keep], gone[:, 1]]).astype(np.int32)),
        pa.array(np.concatenate([rows["far"][keep], gone[:, 2]]).astype(np.int32)),
    ]
    names = ["removed", *_FIELDS]
    if context is not None:
        columns.append(pa.array([context[i] for i in keep.tolist()] + [b""] * g, pa.binary()))
        names.append("context")
    return pa.RecordBatch.from_arrays(columns, names)


def _anchored(source: DataFrame, size: int) -> DataFrame:
    """A row an anchor; of removed stretches: start in near, stop in far."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []

        def settled() -> pa.RecordBatch:
            rows = {k: np.concatenate([h[k] for h in held]) for k in _FIELDS}
            return _batch(rows, *_settle(rows, size))

        for batch in batches:
            for part, data, at in text_slices(batch, SLICE):
                total = prefix_sums(data)
                row, anchor, first, last = window_anchors(total, at, size, GRAM)
                if not len(row):
                    continue
                ids = part.column(0).to_numpy(zero_copy_only=False)
                held.append({"core": stretch(total, anchor, anchor + GRAM), "whole": stretch(total, first, last + size), "doc": ids[row], "at": (anchor - at[row]).astype(np.int32), "near": (anchor - last).astype(np.int32), "far": (anchor - first).astype(np.int32)})
                if sum(len(h["at"]) for h in held) >= HELD:
                    yield settled()
                    held.clear()
        if held:
            yield settled()

    return source.mapInArrow(scan, _ROW)


def _packed(docs: DataFrame) -> DataFrame:
    """Texts compressed, for joins that shuffle them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part, data, at in text_slices(batch):
                whole = data.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([squeeze(whole[at[i] : at[i + 1]]) for i in range(part.num_rows)], pa.binary())], ["doc", "packed"])

    return docs.mapInArrow(pack, "doc long, packed binary")


def _with_context(packed: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """The rows with the bytes of their strings."""
    by_doc = rows.groupBy("doc").agg(F.collect_list(F.struct("at", "near", "far")).alias("anchors"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        doc, at, near, far, context, held = [], [], [], [], [], 0

        def out() -> pa.RecordBatch:
            made = [pa.array(doc, pa.int64()), *[pa.array(x, pa.int32()) for x in (at, near, far)], pa.array(context, pa.binary())]
            for x in (doc, at, near, far, context):
                x.clear()
            return pa.RecordBatch.from_arrays(made, ["doc", "at", "near", "far", "context"])

        for batch in batches:
            for i in range(batch.num_rows):
                text, anchors = unpack(batch.column(1)[i].as_py()), batch.column(2)[i].values
                for a, c, f in zip(*[anchors.field(k).to_pylist() for k in range(3)]):
                    doc.append(batch.column(0)[i].as_py())
                    at.append(a)
                    near.append(c)
                    far.append(f)
                    context.append(text[a - f : a - c + size])
                    held += len(context[-1])
                    if held > SLICE:
                        yield out()
                        held = 0
        yield out()

    return packed.join(by_doc, "doc").select("doc", "packed", "anchors").mapInArrow(cut, "doc long, at int, near int, far int, context binary")


def _context_slices(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[dict[str, np.ndarray], list[bytes], np.ndarray]]:
    """(doc, at, near and far; contexts; where each begins in all of them) of runs of rows whose contexts, column `place`, have about SLICE bytes."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(place)).to_numpy(zero_copy_only=False)
        piece = np.cumsum(sizes) // SLICE
        for lo, hi in zip(first := np.flatnonzero(np.diff(piece, prepend=-1)).tolist(), [*first[1:], batch.num_rows]):
            part = batch.slice(lo, hi - lo)
            columns = {k: part.column(part.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in ("doc", "at", "near", "far")}
            yield columns, part.column(place).to_pylist(), np.cumsum(sizes[lo:hi], dtype=np.int64) - sizes[lo:hi]


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows cut at multiples of BLOCK distances, with the core and the whole of each part."""
    core_size = size - BLOCK + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, texts, begin in _context_slices(batches, 4):
            total = prefix_sums(np.frombuffer(b"".join(texts), np.uint8))
            block = r["near"] // BLOCK
            n = r["far"] // BLOCK - block + 1
            of = np.repeat(np.arange(len(n)), n)
            b = block[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            low, high = np.maximum(r["near"][of], b * BLOCK), np.minimum(r["far"][of], b * BLOCK + BLOCK - 1)
            zero = begin[of] + r["far"][of]  # where the anchor is
            core = zero - b * BLOCK  # all strings of the block hold the bytes from here on, core_size of them
            rows = {"core": stretch(total, core, core + core_size), "whole": stretch(total, zero - high, zero - low + size), "doc": r["doc"][of], "at": r["at"][of], "near": low, "far": high}
            context = [texts[i][f - h : f - c + size] for i, f, h, c in zip(of.tolist(), r["far"][of].tolist(), high.tolist(), low.tolist())]
            yield _batch(rows, *_settle(rows, size), context)

    return rows.mapInArrow(cut, _ROW + ", context binary")


def _positions(blocks: DataFrame, size: int) -> DataFrame:
    """(doc, start, a, b, c, d): a row for every string of the blocks.

    a to d: names of the strings of a quarter of the size that begin there and at the offsets at which two of them make a half,
    and of those that make the other half.
    """
    half = -(-size // 2)
    quarter = -(-half // 2)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, texts, begin in _context_slices(batches, 4):
            total = prefix_sums(np.frombuffer(b"".join(texts), np.uint8))
            n = (r["far"] - r["near"] + 1).astype(np.int64)
            of = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            start = ((r["at"] - r["far"])[of] + step).astype(np.int32)
            names = [stretch(total, x, x + quarter) for x in (begin[of] + step + offset for offset in (0, half - quarter, size - half, size - quarter))]
            yield pa.RecordBatch.from_arrays([pa.array(r["doc"][of]), pa.array(start), *map(pa.array, names)], ["doc", "start", *"abcd"])

    return blocks.select("doc", "at", "near", "far", "context").mapInArrow(spread, "doc long, start int, a long, b long, c long, d long")


def _reranked(rows: DataFrame, a: str, b: str, rank: str) -> DataFrame:
    """The rows whose pair (a, b) another row has as well, with its rank among the sorted pairs instead of it."""
    pairs = materialise(rows.groupBy(a, b).count().where("count > 1").orderBy(a, b).select(a, b, F.monotonically_increasing_id().alias(rank)))
    out = materialise(rows.join(pairs, [a, b]).drop(a, b))
    discard(pairs)
    return out


def _doubled(blocks: DataFrame, size: int) -> DataFrame:
    """(doc, start) of the strings of the blocks that start earlier as well."""
    first = _reranked(_positions(blocks, size), "a", "b", "left")  # by the first half, from names of its quarters
    both = _reranked(first, "c", "d", "right")  # by the half at the offset; what was unique is gone
    discard(first)
    firsts = materialise(both.groupBy("left", "right").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    out = materialise(both.join(firsts, ["left", "right"]).where(F.struct("doc", "start") != F.col("first")).select("doc", "start"))
    discard(both, firsts)
    return out


def _again(rows: DataFrame) -> DataFrame:
    """Mark the rows whose whole occurs earlier. Tasks have settled their own, so a whole has at most a row a task."""
    by = Window.partitionBy("core", "whole", "near", "far").orderBy("doc", "at")
    return materialise(rows.withColumn("again", F.rank().over(by) > 1))


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose core another row has as well."""
    cores = materialise(rows.groupBy("core").count().where("count > 1").select("core"))
    return rows.join(cores, "core")


def _ranges(rows: DataFrame, removed: Column, start: Column, stop: Column) -> DataFrame:
    return rows.where(removed).select("doc", start.alias("start"), stop.alias("stop"))


def repeated_stretches(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 100) -> DataFrame:
    """(doc, start, stop): stretches of bytes that are covered by strings of `size` bytes that start earlier; they may overlap."""
    source = plain(docs, id_col, text_col).toDF("doc", "text").where("doc is not null").withColumn("doc", F.col("doc").cast("long"))
    return _stretches(source, _packed(source), size)


def _stretches(source: DataFrame, packed: DataFrame, size: int) -> DataFrame:
    if not BLOCK + GRAM <= size < 128 + GRAM:
        raise ValueError(f"size must be from {BLOCK + GRAM} to {127 + GRAM}")
    settled = lambda rows: _ranges(rows, F.col("removed"), F.col("near"), F.col("far"))
    covered = lambda rows: _ranges(rows, F.col("again"), F.col("at") - F.col("far"), F.col("at") - F.col("near") + size)
    anchored = materialise(_anchored(source, size))
    ranked = _again(_shared(anchored.where("not removed").drop("removed")))
    stretches = [materialise(settled(anchored).union(covered(ranked)))]
    discard(anchored)
    blocks = materialise(_blocks(_with_context(packed, _shared(ranked.where("not again")).select("doc", "at", "near", "far"), size), size))
    discard(ranked)
    ranked = _again(_shared(blocks.where("not removed").drop("removed")))
    stretches.append(materialise(settled(blocks).union(covered(ranked))))
    discard(blocks)
    left = materialise(_shared(ranked.where("not again")).select("doc", "at", "near", "far", "context"))
    discard(ranked)
    again = _doubled(left, size)
    discard(left)
    return stretches[0].union(stretches[1]).union(again.select("doc", "start", (F.col("start") + size).alias("stop")))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 100) -> DataFrame:
    """(doc_id, kept, spans): one row per input row; the bytes that stay, and the removed runs as (start, stop) of bytes.

    A byte goes if a string of `size` bytes that covers it also starts earlier: in a document of a smaller id,
    or in the same one. All is judged on the input. What stays may not be valid UTF-8, hence bytes.

    Ids are whole numbers. Null texts are empty. Rows without an id keep all and remove nothing. Rows that
    repeat an id are one document, whose earlier copy they aren't: none is removed for the other. An empty
    table gives an empty result; other columns are ignored; very long texts are treated whole.
    """
    source = plain(docs, id_col, text_col).toDF("doc", "text").withColumn("doc", F.col("doc").cast("long"))
    packed = _packed(source)
    by_doc = _stretches(source.where("doc is not null"), packed, size).groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        doc, kept, spans, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, span)], ["doc_id", "kept", "spans"])
            for x in (doc, kept, spans):
                x.clear()
            return made

        for batch in batches:
            for i in range(batch.num_rows):
                text, found = unpack(batch.column(1)[i].as_py()), batch.column(2)[i]
                pairs = []
                if found.is_valid:
                    pairs = np.column_stack([found.values.field(k).to_numpy(zero_copy_only=False) for k in range(2)])
                    pairs = merged(np.zeros(len(pairs), np.int64), pairs[:, 0], np.minimum(pairs[:, 1], len(text)))[:, 1:].tolist()
                ends = [0, *[x for p in pairs for x in p], len(text)]
                doc.append(batch.column(0)[i].as_py())
                kept.append(b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2])))
                spans.append([{"start": a, "stop": b} for a, b in pairs])
                held += len(text)
                if held > SLICE:
                    yield out()
                    held = 0
        yield out()

    out = packed.join(by_doc, "doc", "left").select("doc", "packed", "found").mapInArrow(cut, "doc_id long, kept binary, spans array<struct<start:bigint,stop:bigint>>")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def repeats_report(docs: DataFrame, **options) -> DataFrame:
    """remove_repeats() with counts and a digest of what stays: the form of query op4."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    found = remove_repeats(docs, **options).withColumn("n_removed", removed)
    return found.select("doc_id", (F.octet_length("kept") + F.col("n_removed")).cast("long").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
