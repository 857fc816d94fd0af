"""Near-duplicate documents by SimHash fingerprints and sharded BK-trees.

Fingerprints within two bits are linked. Four blocks of 16 bits leave two blocks untouched by two
changed bits, so fingerprints that can be linked share a shard: a pair of blocks and its value. Each
shard's task builds the shard's tree, keyed by Hamming distance to the parent, and looks its own
fingerprints up in it along the edges within the radius. The trees grow with the corpus, hence they
are not broadcast: each is built where its shard is. A shard of many fingerprints is cut again by
the same rule over its 32 open bits, and if need be over the 16 that are open then: 8 open bits are left,
so a shard holds at most the limit or 256 fingerprints, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, plain, text_slices
from .components import components
from .nearcopies import near_copies

RADIUS = 2


def shingle_bits(data: bytes) -> int:
    """64-bit SimHash of the 3-word shingles of a UTF-8 text, 0 if it has no word."""
    import xxhash

    words = data.lower().split()  # bytes: only A-Z, and the white space 20 and 09 to 0D
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) > 2 else [b" ".join(words)]
    n, digest = max(1, len(words) - 2), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, 42) for s in shingles), np.uint64, n)
    octets = hashes.view(np.uint8).reshape(n, 8)  # least significant first
    if n < 4096:
        set_in = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        table = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
        set_in = np.concatenate([np.bincount(octets[:, k], minlength=256) @ table for k in range(8)])
    return int(np.packbits(set_in * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, bits): one row per input row; bits is the fingerprint as a signed 64-bit number."""
    source = plain(docs, id_col, text_col).toDF("doc_id", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in text_slices(batch):
                whole = data.tobytes()
                bits = np.array([shingle_bits(whole[at[i] : at[i + 1]]) for i in range(len(at) - 1)], np.uint64)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(bits.view(np.int64))], ["doc_id", "bits"])

    return source.mapInArrow(hashed, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, bits long")


class BKTree:
    """Children keyed by integer Hamming distance to the parent."""

    def __init__(self, radius: int) -> None:
        self.radius, self.root = radius, None

    def add(self, bits: int) -> list[int]:
        """Insert a fingerprint; those already there within the radius."""
        if self.root is None:
            self.root = (bits, {})
            return []
        found, todo, radius = [], [self.root], self.radius
        while todo:
            value, children = todo.pop()
            d = (value ^ bits).bit_count()
            if d <= radius:
                found.append(value)
            todo += [child for edge, child in children.items() if d - radius <= edge <= d + radius]
        node = self.root
        while (child := node[1].get(d := (node[0] ^ bits).bit_count())) is not None:
            node = child
        node[1][d] = (bits, {})
        return found


def _spanning_links(members: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect what the radius connects within a shard: at most one less than its members."""
    tree, parent, out = BKTree(radius), {}, []

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for bits in members:
        parent[bits] = bits
        for near in tree.add(bits):
            p, q = top(near), top(bits)
            if p != q:
                parent[p] = q
                out.append((near, bits))
    return out


def _masks(open_bits: list[int], fixed: int) -> list[int]:
    """The fixed bits with two of four equal parts of the open ones, as signed numbers."""
    size = len(open_bits) // 4
    parts = [sum(1 << b for b in open_bits[k * size : (k + 1) * size]) for k in range(4)]
    return [int(np.uint64(fixed | parts[i] | parts[j]).view(np.int64)) for i, j in combinations(range(4), 2)]


def _open(mask: int) -> list[int]:
    return [b for b in range(64) if not (mask >> b) & 1]


def near_links(prints: DataFrame, shard_limit: int = 2048) -> DataFrame:
    """(a, b): links among distinct fingerprints `bits` that connect all pairs within RADIUS bits.

    shard_limit: fingerprints of a shard from which it is cut again. No candidate is dropped.
    """
    pool, shards = prints.select("bits", F.lit(0).cast("long").alias("mask")), None
    masks = [0]
    for depth in range(3):
        children = {m: _masks(_open(m), m & (2**64 - 1)) for m in masks}
        masks = sorted({c for own in children.values() for c in own})
        below = F.create_map(*[x for m, own in children.items() for x in (F.lit(m).cast("long"), F.array(*[F.lit(c).cast("long") for c in own]))])
        keyed = pool.select("bits", F.explode(below[F.col("mask")]).alias("mask")).withColumn("part", F.col("bits").bitwiseAND(F.col("mask")))
        keyed = keyed.distinct() if depth else keyed
        sizes = keyed.groupBy("mask", "part").agg(F.count("*").alias("n")).where("n > 1")
        sized = keyed.join(sizes, ["mask", "part"])
        small = sized if depth == 2 else sized.where(F.col("n") <= shard_limit)
        shards = small.select("bits", "mask", "part") if shards is None else shards.union(small.select("bits", "mask", "part"))
        pool = sized.where(F.col("n") > shard_limit).select("bits", "mask")
    shards = shards.groupBy("mask", "part").agg(F.collect_list("bits").alias("members"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [link for members in batch.column(0).to_pylist() for link in _spanning_links([m & (2**64 - 1) for m in sorted(members)], RADIUS)]
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    return shards.select("members").mapInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_limit: int = 2048) -> DataFrame:
    """(doc_id, bits, component_id): one row per input row.

    component_id is the smallest id reachable over fingerprints at most two bits apart, itself included.
    Copies share a fingerprint and are linked once. Null texts count as empty: they have no word, the
    fingerprint zero, and one group. Null ids are passed over by the minimum (a group of null ids only
    has a null component). Repeated rows each return a row; an empty table gives an empty result.
    """
    prints = materialise(fingerprints(docs, id_col, text_col))
    distinct = prints.groupBy("bits").agg(F.min("doc_id").alias("least"))
    members = components(near_links(distinct.select("bits"), shard_limit))
    rooted = distinct.join(members.select(F.col("node").alias("bits"), "root"), "bits", "left").select("bits", "least", F.coalesce("root", "bits").alias("root"))
    rooted = materialise(rooted)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("bits", "component_id")
    return prints.join(named, "bits").select("doc_id", "bits", "component_id")


def near_duplicate_report(docs: DataFrame, **options) -> DataFrame:
    """near_duplicates() with the fingerprint as 16 hexadecimal digits: the form of query op2."""
    return near_duplicates(docs, **options).select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_limit: int = 1_000_000) -> DataFrame:
    """`docs` with one row of each group of near duplicates: the one of the smallest id, and of its texts that of the least hash.

    SimHash comes first: texts of one fingerprint, and of those that near_links() finds at most two bits apart, are checked on their whole sets of shingles.
    near_copies() goes on from these links to the copies that two bits don't show, and makes the components of both. Rows without an id stay. Rows that repeat an id with texts of different groups stay with each of them; of rows that
    repeat both the id and the text one stays. broadcast_limit: rows to drop (some 50 bytes each) up to which they are
    broadcast; beyond, the texts are shuffled to them.
    """
    text = F.col(f"`{text_col}`")
    prints = materialise(fingerprints(docs.select(F.xxhash64(text).alias("of_text"), text.alias("text")), "of_text").distinct())
    links = materialise(near_links(prints.select("bits").distinct()))
    found = near_copies(docs, id_col=id_col, text_col=text_col, prints=prints.toDF("of_text", "print"), print_links=links).where("doc_id is not null")
    discard(prints, links)
    stays = found.groupBy("component").agg(F.min(F.struct("doc_id", "of_text")).alias("stays"))
    gone = materialise(found.join(stays, "component").where(F.struct("doc_id", "of_text") != F.col("stays")).select(F.col("doc_id").alias("__id"), F.col("of_text").alias("__text")).distinct())
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col("__text"))
    kept = docs.join(F.broadcast(gone) if gone.count() <= broadcast_limit else gone.hint("shuffle_hash"), same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    twice = materialise(found.groupBy("doc_id", "of_text").count().where("count > 1").select(F.col("doc_id").alias("__id"), F.col("of_text").alias("__text")))
    if twice.isEmpty():
        return kept
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = kept.join(twice, same, "left_semi").groupBy(F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`"))).agg(F.first(row).alias("__row")).select("__row")
    return kept.join(twice, same, "left_anti").unionByName(once.select(*[F.col("__row")[c].alias(c) for c in docs.columns]))
