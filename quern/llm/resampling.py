"""Importance resampling towards a target distribution: hashed word n-grams, log-ratio gains, a Gumbel draw.

Words and runs of words fall into buckets by their CRC. A bucket's gain compares its share in the target
with that in the corpus; a document's weight is the mean gain of its features, and the highest weights plus
fixed Gumbel noise are drawn, which samples without replacement in proportion to the weights' exponentials.

Texts are split by Arrow kernels and dictionary-encoded a slice at a time; n-grams are shifted dictionary
indices, and only distinct ones are hashed. The corpus is read twice, once for the counts of buckets and
once for the weights; no text and no feature is shuffled.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, plain, text_slices

#: What separates words, after lower-casing: all of ASCII but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: monotonically_increasing_id() holds the partition above so many bits.
_PLACE_BITS = 33


def features(data: np.ndarray, at: np.ndarray, *, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, row of each feature, its bucket) of texts that lie in `data` from at[i] to at[i+1]; features are all runs of 1 to `longest` words."""
    texts = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(np.ascontiguousarray(data)))  # an array of its own: ascii_lower reads slices of others wrongly
    parts = pc.split_pattern_regex(pc.ascii_lower(texts), SEPARATORS)
    words, row = pc.list_flatten(parts), pc.list_parent_indices(parts)
    whole = pc.not_equal(words, "")
    coded, row = words.filter(whole).dictionary_encode(), row.filter(whole).to_numpy()
    index, vocabulary = coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.large_binary()).to_pylist()
    crc = np.fromiter(map(zlib.crc32, vocabulary), np.int64, len(vocabulary))
    rows, found = [row], [crc[index] % buckets]
    gram = index
    for n in range(2, longest + 1):  # a run is the run without its last word, and that word
        inside = row[n - 1 :] == row[: len(row) - n + 1]
        pairs, gram_of = np.unique(gram[: len(inside)] * len(vocabulary) + index[n - 1 :], return_inverse=True)
        start, last = (pairs // max(1, len(vocabulary))).tolist(), (pairs % max(1, len(vocabulary))).tolist()
        crc = np.fromiter((zlib.crc32(b" " + vocabulary[w], int(crc[g])) for g, w in zip(start, last, strict=True)), np.int64, len(pairs))
        gram = gram_of
        rows.append(row[: len(inside)][inside])
        found.append(crc[gram][inside] % buckets)
    return np.bincount(row, minlength=len(texts)), np.concatenate(rows), np.concatenate(found)


def bucket_counts(texts: DataFrame, *, buckets: int, longest: int) -> np.ndarray:
    """Features of all rows by bucket; a task sends one row a bucket at most, and the driver sees as many."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, at in text_slices(batch):
                n += np.bincount(features(data, at, buckets=buckets, longest=longest)[2], minlength=buckets)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of each bucket's smoothed share in the target over that in the corpus, floored."""
    k, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(y + 1) * float(s + k) / (float(x + 1) * float(t + k)))) for x, y in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, *, longest: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of (doc_id, text)."""

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(gains)
        for batch in batches:
            for rows, data, at in text_slices(batch):
                words, row, bucket = features(data, at, buckets=len(gains), longest=longest)
                order = np.argsort(row, kind="stable") if longest > 1 else slice(None)
                each = pc.take(table, pa.array(bucket[order])).to_numpy()
                n = np.bincount(row, minlength=len(words))
                total = np.zeros(len(n), np.int64)
                if len(each):
                    total[n > 0] = np.add.reduceat(each, (np.cumsum(n) - n)[n > 0])
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(weights, f"doc_id {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", longest: int = 1, buckets: int = 10_000, seed: int = 2024, min_words: int = 20, percent: int = 10) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of `docs`; rank is null where the row isn't drawn.

    Of the rows with at least `min_words` words, floor(percent of them) of the highest scores are drawn and
    ranked from 1. target: texts of the distribution to draw towards.

    Null texts have no words, texts without words weigh 0. A null id counts as the empty text in the noise, and comes
    first among ties; rows that repeat an id and a score follow each other, each with a rank of its own. An empty
    corpus gives an empty result; an empty target compares with an even share of all buckets. Other columns are ignored.
    """
    docs = plain(docs, id_col, text_col).toDF("doc_id", "text")
    counts = [bucket_counts(x.select(F.col("text").cast("string").alias("text")), buckets=buckets, longest=longest) for x in (docs, plain(target, target_text_col).toDF("text"))]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = weighed(docs, bucket_gains(*counts), longest=longest).withColumn("score", F.col("weight") + noise)
    scored = materialise(scored.withColumn("row", F.monotonically_increasing_id()))
    fit = F.col("n_words") >= min_words
    by_score = {r["score"]: r["n"] for r in scored.where(fit).groupBy("score").agg(F.count("*").alias("n")).collect()}  # scores are whole numbers between the least gain and the largest plus noise: some 100,000 at most
    drawn, above, cut = sum(by_score.values()) * percent // 100, 0, None
    for score in sorted(by_score, reverse=True):
        if above >= drawn:
            break
        cut, above = score, above + by_score[score]
    out = ["doc_id", "n_features", "weight", "score"]
    if cut is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    front = fit & (F.col("score") >= cut)
    ranked = _ranked(scored.where(front)).select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return scored.where(~front).select(*out, F.lit(None).cast("long").alias("rank")).unionByName(ranked)


def _ranked(rows: DataFrame) -> DataFrame:
    """`rows` with a rank by falling score and rising id, from sorted ranges and their sizes: no task sees them all."""
    spark = rows.sparkSession
    order = [F.desc("score"), F.asc("doc_id"), F.asc("row")]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = materialise(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    before, offsets = 0, []
    for r in sorted(table.groupBy(F.shiftright("place", _PLACE_BITS).alias("part")).agg(F.count("*").alias("n")).collect()):  # a row a range
        offsets.append((r["part"], before))
        before += r["n"]
    offsets = spark.createDataFrame(offsets, "part long, before long")
    ranked = table.withColumn("part", F.shiftright("place", _PLACE_BITS)).join(F.broadcast(offsets), "part")
    return ranked.withColumn("rank", F.col("before") + F.col("place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) + 1)


def draw(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that resample() draws, with their own columns; rows of a drawn id all stay, a null id is never drawn."""
    chosen = resample(docs, target, id_col=id_col, **options)
    ids = materialise(chosen.where(F.col("rank").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(id_col)).distinct())
    return docs.join(ids, id_col, "left_semi").select(*[docs[f"`{c}`"] for c in docs.columns])
