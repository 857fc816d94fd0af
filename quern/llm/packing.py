"""Packing of documents into token sequences by lexical retrieval.

Documents are dealt to shards of about equal size so that related ones meet. A document's tokens, weighted by idf and
hashed to a short vector, lie nearest to one of a few centroids, and what the centroid leaves of the vector is
largest in one dimension; neighbouring cells of the two fill a shard, and larger cells are cut by a hash, so that copies of one
text can't fill a task. In its task each shard builds a BM25 inverted index over its documents' tokens, with the document
frequencies of the whole corpus. A seed document asks the index for the nearest documents that are still
unused; they fill the seed's window in order of score. What does not fit is cut: the rest of that
document begins the next window as its seed. So only a shard's last sequence has padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_pair_encoding, discard, give_back, materialise, plain, text_slices, texts_of

_SPECIAL = "<|endoftext|>"
_IDS = 1 << 16
#: Dimensions of a document's vector, and for each token its own one and a sign.
_DIMS = 128
_DIM_OF, _SIGN = (np.random.default_rng(20240303).integers(0, n, _IDS) for n in (_DIMS, 2))


@lru_cache(maxsize=2)
def _tokenizer(vocabulary: str | None):
    from tokenizers import Tokenizer
    import public_tokenizers

    return Tokenizer.from_file(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))


def encode(text: str, vocabulary: str | None = None, ranks: str | None = None) -> list[int]:
    """Token ids of a text as the tokenizer file gives them, without added special tokens.

    The same vocabulary as ranks gives the same ids several times as fast; a text that spells the special
    token goes to the tokenizer itself, and so does every text if only `vocabulary` is given.
    """
    if (vocabulary and not ranks) or _SPECIAL in text:
        return _tokenizer(vocabulary).encode(text, add_special_tokens=False).ids
    return byte_pair_encoding(ranks).encode_ordinary(text)


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)


class ShardIndex:
    """BM25 over the documents of one shard, with tokens as terms; idf: of the whole corpus, by token (None: the shard's own)."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray | None = None, k1: float = 1.2, b: float = 0.75) -> None:
        self.n = len(docs)
        lengths = np.array([len(d) for d in docs], float)
        terms, owners, weights = [], [], []
        norm = k1 * (1 - b + b * lengths / max(1.0, lengths.mean()))
        for i, ids in enumerate(docs):
            ordered = np.sort(ids, kind="stable")
            new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            tf = np.diff(np.concatenate([new, [len(ordered)]]))
            terms.append(ordered[new])
            owners.append(np.full(len(new), i, np.int32))
            weights.append((tf * (k1 + 1) / (tf + norm[i])).astype(np.float32))
        self.terms = terms
        flat = np.concatenate(terms)
        order = np.argsort(flat, kind="stable")
        self.owner, self.weight = np.concatenate(owners)[order], np.concatenate(weights)[order]
        self.df = np.bincount(flat, minlength=_IDS)
        self.end = np.cumsum(self.df)
        idf = idf_of(self.df, self.n) if idf is None else idf
        self.weight *= np.repeat(idf, self.df)  # in order of the terms
        # terms that many documents hold are columns of a matrix, which has at most 8 cells a posting
        often = np.flatnonzero(self.df * 8 > self.n)
        self.column = np.full(len(self.df), -1, np.int64)
        self.column[often] = np.arange(len(often))
        self.often = np.zeros((self.n, len(often)), np.float32)
        for k, t in enumerate(often.tolist()):
            part = slice(self.end[t] - self.df[t], self.end[t])
            self.often[self.owner[part], k] = self.weight[part]

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of every document for all of a document's distinct terms."""
        own = self.terms[doc]
        column = self.column[own]
        asked = np.zeros(self.often.shape[1], np.float32)
        asked[column[column >= 0]] = 1
        rare = own[(column < 0) & (self.df[own] > 1)]  # no other document holds a term of one
        sizes = self.df[rare]
        at = np.repeat(self.end[rare] - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
        return (self.often @ asked + np.bincount(self.owner[at], self.weight[at], self.n)).astype(np.float32)


def _filled(docs: list[np.ndarray], window: int, idf: np.ndarray | None = None, batch: int = 16) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece of a shard."""
    index, out = ShardIndex(docs, idf), []
    unused, left, first_unused = np.ones(len(docs), bool), len(docs), 0
    sequence, offset, seed, done = 0, 0, -1, 0
    near: list[int] = []
    while left or seed >= 0:
        if seed < 0:  # next document: the nearest to the window's seed that shares a term with it, or else the first unused one
            while near and not unused[near[-1]]:
                near.pop()
            if offset and not near:
                score = np.where(unused, index.scores(window_seed), np.float32(0))
                top = np.argpartition(-score, batch)[:batch] if len(score) > batch else np.arange(len(score))
                top = top[score[top] > 0]
                near = top[np.lexsort((-top, score[top]))].tolist()  # best last
            if near:
                seed = near.pop()
            else:
                while not unused[first_unused]:
                    first_unused += 1
                seed = first_unused
            unused[seed], left, done = False, left - 1, 0
        if offset == 0:
            window_seed, near = seed, []
        take = min(window - offset, len(docs[seed]) - done)
        out.append((seed, done, take, sequence, offset))
        done, offset = done + take, offset + take
        if done == len(docs[seed]):
            seed = -1
        if offset == window:
            sequence, offset = sequence + 1, 0
    return out


def _vectors(docs: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """A vector of length one (or zero) for each document: its tokens' idf, hashed to _DIMS dimensions."""
    flat = np.concatenate([np.zeros(0, np.uint16), *docs])
    row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    x = np.bincount(row * _DIMS + _DIM_OF[flat], idf[flat] * (2.0 * _SIGN[flat] - 1), len(docs) * _DIMS).reshape(-1, _DIMS)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(np.round(x @ centres.T, 6), axis=1)  # rounded: the same for any batch that a vector is in


def _centres(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """At most n centroids of length one of the sample's vectors, by cosine."""
    x = np.unique(np.round(x, 9), axis=0)
    centres = x[np.random.default_rng(5).permutation(len(x))[:n]]
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return centres


def _dealt(sizes: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """(first shard, shards) of each cell: cells in order share one until it has `most` bytes, larger cells have shards of their own."""
    out, shard, held = {}, 0, 0
    for cell in sorted(sizes):
        size = sizes[cell]
        if held and held + size > most:
            shard, held = shard + 1, 0
        parts = max(1, -(-size // most))
        out[cell] = (shard, parts)
        shard, held = (shard + parts, 0) if parts > 1 else (shard, held + size)
    return out


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, shard_bytes: int = 4 << 20, sample: int = 4_000, clusters: int = 512, vocabulary: str | None = None, ranks: str | None = None, separator: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences of at most `window` ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    vocabulary, ranks: paths on the executors of a tokenizer file and of the same vocabulary as tiktoken
    ranks, of at most 65,536 ids (None: the public one that is installed). shard_bytes: text of a shard.
    sample, clusters: bounds of the documents that the centroids are fitted on, and of the centroids, of which there
    are else as many as shards; every document is dealt, and document frequencies are those of all documents.

    A document is its ids and then the separator. Null texts count as empty and give the separator alone;
    null ids stay null; repeated rows are packed as often as they are there; an empty table gives an
    empty result; other columns are ignored. Very long texts are cut over as many windows as they need.
    The layout depends on the rows only, not on how they are partitioned.
    """
    spark = docs.sparkSession
    source = plain(docs, id_col, text_col).toDF("doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    n, total = source.agg(F.count("*"), F.sum(F.octet_length("text") + 1)).first()
    drawn = source.select(F.xxhash64("doc_id", "text").alias("h"), "text").where(F.pmod("h", F.lit(1_000_000)) < max(1, min(1_000_000, int(1_100_000 * sample / max(1, n)))))
    cells = np.zeros((1, _DIMS)), np.ones(_IDS, np.float32)
    wanted = min(clusters, -(-(total or 0) // shard_bytes))

    def encoded(part: pa.RecordBatch) -> list[np.ndarray]:
        return [np.array([*encode(t, vocabulary, ranks), separator], np.uint16) for t in texts_of(part)]

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in text_slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.bincount(d, minlength=_IDS).nonzero()[0].astype(np.uint16).tobytes() for d in encoded(part)], pa.binary())], ["h", "terms"])

    if wanted > 1:
        few = materialise(drawn.mapInArrow(sampled, "h long, terms binary"))
        found = few.limit(2 * sample).toArrow().sort_by("h")
        discard(few)
        terms = [np.frombuffer(x, np.uint16) for x in found.column("terms").to_pylist()]
        rough = idf_of(np.bincount(np.concatenate([np.zeros(0, np.uint16), *terms]), minlength=_IDS), len(terms))
        if terms:
            cells = _centres(_vectors(terms, rough), wanted), rough
    shared = spark.sparkContext.broadcast(cells)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, rough = shared.value
        for batch in batches:
            for part, data, at in text_slices(batch):
                ids = encoded(part)
                x = _vectors(ids, rough)
                near = _nearest(x, centres)
                cell = near * 2 * _DIMS + np.argmax(np.round(np.column_stack([x - centres[near], centres[near] - x]), 6), axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(cell), pa.array(np.diff(at) + 1), pa.array([d.tobytes() for d in ids], pa.binary())], ["doc_id", "h", "cell", "size", "ids"])

    table = materialise(source.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).mapInArrow(placed, f"doc_id {kind}, h long, cell long, size long, ids binary"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(_IDS, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                df[np.unique(np.frombuffer(ids.as_buffer(), np.uint16))] += 1
        term = df.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df[term])], ["term", "df"])

    found = table.select("ids").mapInArrow(counted, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # at most 65,536 rows
    df = np.zeros(_IDS, np.int64)
    df[found.column("term").to_numpy()] = found.column("df").to_numpy()
    idf = spark.sparkContext.broadcast(idf_of(df, n))
    dealt = _dealt({r["cell"]: r["size"] for r in table.groupBy("cell").agg(F.sum("size").alias("size")).collect()}, shard_bytes)  # at most clusters * 256 rows
    plan = spark.createDataFrame([(c, first, parts) for c, (first, parts) in dealt.items()], "cell long, first long, parts long")
    sharded = table.join(F.broadcast(plan), "cell").select("doc_id", "h", (F.col("first") + F.pmod("h", F.col("parts"))).alias("shard"), "ids")

    def packed(group: pa.Table) -> pa.Table:
        group = group.sort_by("h")  # of the id and the text: what stays in any order are repeated rows
        order = np.argsort([-len(x) for x in group.column("ids").to_pylist()], kind="stable")  # long documents seed first
        group = group.take(pa.array(order))
        docs = [np.frombuffer(x, np.uint16) for x in group.column("ids").to_pylist()]
        shard = group.column("shard")[0].as_py()
        pieces = np.array(_filled(docs, window, idf.value), np.int64)
        ids = [docs[d][s : s + n].astype("<u4") for d, s, n in pieces[:, :3].tolist()]
        columns = {
            "doc_id": group.column("doc_id").take(pa.array(pieces[:, 0])),
            "start": pa.array(pieces[:, 1]),
            "length": pa.array(pieces[:, 2]),
            "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64()),
            "doc_tokens": pa.array(np.array([len(d) for d in docs], np.int64)[pieces[:, 0]]),
            "sequence_id": pa.array((shard << 32) + pieces[:, 3]),
            "offset": pa.array(pieces[:, 4]),
        }
        if keep_ids:
            columns["ids"] = pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))
        give_back()
        return pa.table(columns)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * keep_ids
    return sharded.groupBy("shard").applyInArrow(packed, schema)
