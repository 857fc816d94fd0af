"""Near copies by exact Jaccard similarity of five-word shingles; candidates by min-hash bands.

A SimHash can't search for this rule: at a similarity of 0.8 two fingerprints differ in some 9 of 64 bits, and no
shards of blocks are both small and complete at such a radius. Two texts are candidates if one of 32 bands of five
minima agrees, which passes over a pair of similarity 0.8 with a chance of 3e-6, and of 0.9 with 1e-12. Every
link is checked on the whole sets of shingles.

Pairs of a band's group would grow with its square. So each member is first checked against the least one of
its group; in small groups, members that this leaves in different components are then compared with each other, by bitmaps
that bound the difference of two sets from below and so lose none. Large groups that aren't one component by then, as of texts
that share a passage and little else, are dealt again by their rarest shingles, of which two sets of the similarity
always share one. What these groups leave is checked in rounds: first the next possible partner of each
member, then sixteen more, 256 more and so on, as long as any has partners outside its component; so a large group of copies
is joined after few links of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, plain, text_slices
from .components import stars

BANDS, ROWS = 32, 5
_RANDOM = np.random.default_rng(20240302)
_FLIP = _RANDOM.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64)
_TIMES = _RANDOM.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)
_JOIN = _RANDOM.integers(0, 2**64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_MAP_BITS = 10


def shingle_set(data: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a UTF-8 text; a text of fewer words is one shingle."""
    import xxhash

    words = data.lower().split()  # bytes: only A-Z, and the white space 20 and 09 to 0D
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*[words[k:] for k in range(size)])) if len(words) >= size else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, 42) for s in shingles), np.uint64, max(1, len(words) - size + 1)))


def set_digest(own: np.ndarray) -> int:
    """64-bit digest of a set, signed; 0 of the empty one. Equal sets are exact copies under the rule."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 7)).view(np.int64)) if len(own) else 0


def band_keys(own: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(own), 512):
        np.minimum(least, ((own[None, k : k + 512] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    return (least.reshape(BANDS, ROWS) * _JOIN).sum(axis=1, dtype=np.uint64).view(np.int64)


def parity_map(own: np.ndarray) -> bytes:
    """1,024 bits, each the parity of the members that fall on it: two sets differ in at least as many members as bits."""
    odd = np.bincount((own.view(np.uint64) >> np.uint64(64 - _MAP_BITS)).astype(np.int64), minlength=1 << _MAP_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return plain(docs, id_col, text_col).toDF("doc_id", "text").select("doc_id", F.xxhash64("text").alias("of_text"), "text")


def signatures(source: DataFrame, size: int) -> DataFrame:
    """(doc_id, of_text, bits, bands): digest of the set and its band keys."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in text_slices(batch):
                whole = data.tobytes()
                bits, bands = [], []
                for i in range(len(at) - 1):
                    own = shingle_set(whole[at[i] : at[i + 1]], size)
                    bits.append(set_digest(own))
                    bands.append(band_keys(own) if len(own) else np.zeros(0, np.int64))
                ends = np.cumsum([0, *map(len, bands)]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bands)))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(bits, pa.int64()), keys], ["doc_id", "of_text", "bits", "bands"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(signed, f"doc_id {kind}, of_text long, bits long, bands array<long>")


def _sets(source: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(bits, n, map, members) of the sets of the rows (rid, rtext), each once."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, at in text_slices(batch):
                whole = data.tobytes()
                own = [shingle_set(whole[at[i] : at[i + 1]], size) for i in range(len(at) - 1)]
                ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
                members = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([set_digest(x) for x in own], pa.int64()), pa.array([len(x) for x in own], pa.int64()), pa.array([parity_map(x) for x in own], pa.binary()), members], ["bits", "n", "map", "members"])

    rows = source.join(wanted.hint("shuffle_hash"), (F.col("of_text") == F.col("rtext")) & F.col("doc_id").eqNullSafe(F.col("rid")), "left_semi")
    return rows.select("text").mapInArrow(hashed, "bits long, n long, map binary, members array<long>").dropDuplicates(["bits"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose sets have a Jaccard similarity of `percent` or more."""
    sets = sets.select("bits", "members")
    both = pairs.join(sets.toDF("a", "of_a"), "a").join(sets.toDF("b", "of_b"), "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return both.where((100 + percent) * common >= percent * (F.size("of_a") + F.size("of_b"))).select("a", "b")


def _possible(group: list[dict], percent: int, low: int, high: int) -> Iterator[tuple[np.ndarray, bool]]:
    """For each member its low-th up to high-th later member, as rows (a, b), that the bitmaps and sizes don't rule out, without those in its component; and whether it has more."""
    bits, n, root, block, pivot = (np.array([x[c] for x in group], np.int64) for c in ("bits", "n", "root", "block", "pivot"))
    maps = np.frombuffer(b"".join(x["map"] for x in group), np.uint64).reshape(len(group), -1)
    crossing = len(np.unique(block)) > 1
    for i in range(len(group) - 1):
        differ = np.maximum(np.bitwise_count(maps[i + 1 :] ^ maps[i]).sum(axis=1, dtype=np.int64), np.abs(n[i + 1 :] - n[i]))
        ok = (100 + percent) * differ <= (100 - percent) * (n[i + 1 :] + n[i])
        ok &= (bits[i] != pivot[i]) & (bits[i + 1 :] != pivot[i])  # checked before
        if crossing:
            ok &= block[i + 1 :] != block[i]
        place = np.flatnonzero(ok)
        now = place[low:high]
        now = now[root[i + 1 :][now] != root[i]]
        more = bool((root[i + 1 :][place[high:]] != root[i]).any())
        if len(now) or more:
            other = bits[i + 1 :][now]
            yield np.column_stack([np.minimum(other, bits[i]), np.maximum(other, bits[i])]), more


def _prefix_keys(sets: DataFrame, percent: int, most: int = 1_000_000) -> DataFrame:
    """(bits, key): the rarest members of each set, enough of them that two sets of the similarity share one.

    Sets with an overlap of `percent` of their own members meet in what is left of each when all but so many
    of the rarest go, in any order that is the same for all sets. Members of several sets come last, by their number of sets; these
    counts are broadcast, at most `most` of them: beyond that only those of 2, 4, 8 and so on or more sets are told apart from rare ones.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            member, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(member), pa.array(n)], ["member", "n"])

    counts = materialise(sets.select("members").mapInArrow(counted, "member long, n long").groupBy("member").agg(F.sum("n").alias("n")).where("n > 1"))
    least = 2
    while counts.where(F.col("n") >= least).count() > most:
        least *= 2
    table = counts.where(F.col("n") >= least).orderBy("member").toArrow()
    shared = sets.sparkSession.sparkContext.broadcast((table.column("member").to_numpy(), table.column("n").to_numpy()))
    discard(counts)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                own = batch.column(1)[row].values.to_numpy()
                n = np.zeros(len(own), np.int64)
                if len(known):
                    at = np.searchsorted(known, own).clip(0, len(known) - 1)
                    n = np.where(known[at] == own, number[at], 0)
                order = np.lexsort((own, n))[: len(own) + 1 + (-percent * len(own) // 100)]
                key = own[order][n[order] > 0] if least == 2 else own[order]  # the others are of this set alone
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), batch.column(0)[row].as_py())), pa.array(key)], ["bits", "key"])

    return sets.select("bits", "members").mapInArrow(prefixes, "bits long, key long")


def _groups(keyed: DataFrame) -> DataFrame:
    """(key, bits, pivot, held) of keys that several sets have; of keys with just the same sets one stays."""
    check = lambda seed: F.sum(F.xxhash64(F.lit(seed), "bits").cast("decimal(38,0)"))
    groups = keyed.groupBy("key").agg(F.min("bits").alias("pivot"), F.count("*").alias("held"), check(0).alias("one"), check(1).alias("two")).where("held > 1")
    groups = groups.groupBy("pivot", "held", "one", "two").agg(F.min("key").alias("key"))
    return materialise(keyed.join(groups, "key").select("key", "bits", "pivot", "held"))


def _undecided(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of those groups of three or more that hold several components.

    Such a group has a member in another component than its least one, and most of these pairs belong to many groups.
    """
    pairs = groups.where("held > 2 and bits <> pivot").select("pivot", "bits").distinct()
    named = pairs.join(roots.toDF("bits", "of_bits"), "bits", "left").join(roots.toDF("pivot", "of_pivot"), "pivot", "left")
    apart = named.where(F.coalesce("of_bits", "bits") != F.coalesce("of_pivot", "pivot")).select("pivot", "bits")
    keys = groups.join(apart, ["pivot", "bits"], "left_semi").select("key").distinct()
    return materialise(groups.join(keys, "key", "left_semi"))


def near_stars(source: DataFrame, distinct: DataFrame, *, size: int, percent: int, group_limit: int, large: int, hints: DataFrame | None = None) -> DataFrame:
    """(u, v): the components of the distinct sets, as of stars(), by checked links that connect all candidates of the similarity. hints: more pairs (a, b) to check."""
    keyed = distinct.select("bits", F.explode("bands").alias("key"))
    shared = _groups(keyed)
    asked = shared.select("bits") if hints is None else shared.select("bits").union(hints.select("a")).union(hints.select("b"))
    wanted = distinct.join(asked.distinct(), "bits", "left_semi").select(F.col("row.doc_id").alias("rid"), F.col("row.of_text").alias("rtext"))
    sets = materialise(_sets(source, wanted, size))

    def compared(members: DataFrame, roots: DataFrame, low: int, high: int) -> DataFrame:
        named = sets.select("bits", "n", "map").join(roots.toDF("bits", "root"), "bits", "left").select("bits", "n", "map", F.coalesce("root", "bits").alias("root"))
        left = members.join(named, "bits")
        blocks = F.ceil(F.col("held") / group_limit)
        left = left.withColumn("block", F.pmod(F.xxhash64("bits"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        dealt = left.groupBy("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.array_sort(F.collect_list(F.struct("bits", "n", "root", "block", "pivot", "map"))).alias("members"))
        return materialise(dealt.select("members").mapInArrow(_comparing(percent, low, high), "a long, b long, more boolean"))

    def grown(roots: DataFrame | None, pairs: DataFrame) -> DataFrame:
        """The components with the links among more pairs; those before go in as the stars they are."""
        new = materialise(_confirmed(pairs.distinct(), sets, percent))
        if roots is not None and new.isEmpty():
            discard(new)
            return roots
        out = stars(new if roots is None else new.union(roots.toDF("a", "b")))
        discard(new, *[roots] * (roots is not None))
        return out

    pivots = lambda groups: groups.where("bits <> pivot").select(F.col("pivot").alias("a"), F.col("bits").alias("b"))
    roots = grown(None, pivots(shared) if hints is None else pivots(shared).union(hints))
    undecided = _undecided(shared, roots)
    found = compared(undecided.where(F.col("held") <= large), roots, 0, large)
    roots = grown(roots, found.where("a is not null").select("a", "b"))
    hot = undecided.where(F.col("held") > large).select("bits").distinct()
    rare = _groups(_prefix_keys(sets.join(hot, "bits", "left_semi"), percent))
    discard(shared, undecided, found)
    roots, low, width = grown(roots, pivots(rare)), 0, 1
    while True:
        before, rare = rare, _undecided(rare, roots)  # a group of one component stays so
        found = compared(rare, roots, low, low + width)
        roots = grown(roots, found.where("a is not null").select("a", "b"))
        more = not found.where("more").isEmpty()
        discard(found, before)
        if not more:
            discard(sets, rare)
            return roots
        low, width = low + width, 16 * width


def _comparing(percent: int, low: int, high: int):
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(found: list[np.ndarray], more: bool) -> pa.RecordBatch:
            pairs = np.concatenate([np.zeros((0, 2), np.int64), *found])
            columns = [pa.array([*pairs[:, k].tolist(), *[None] * more], pa.int64()) for k in range(2)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([False] * len(pairs) + [True] * more, pa.bool_())], ["a", "b", "more"])

        for batch in batches:
            found, held, rest = [], 0, False
            for k in range(batch.num_rows):
                for pairs, more in _possible(batch.column(0)[k].as_py(), percent, low, high):
                    rest |= more
                    found.append(pairs)
                    held += len(pairs)
                    if held > 100_000:
                        yield table(found, False)
                        found, held = [], 0
            yield table(found, rest)

    return compared


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, group_limit: int = 4096, large: int = 4, prints: DataFrame | None = None, print_links: DataFrame | None = None) -> DataFrame:
    """(doc_id, of_text, component, component_id): one row per input row; of_text is a hash of the text, component a key of the group.

    component_id is the smallest id reachable over texts whose shingles of `size` words have a Jaccard similarity of
    `percent` of 100 or more, itself included. Null texts count as empty and are one group with the empty ones.
    Null ids are passed over by the minimum. group_limit: members of a group that a task compares with as many. large: members from
    which a band's group is dealt again by rarest shingles. prints, print_links: (of_text, print) and links (a, b) of prints by another method; texts
    of a print, or of two that are linked, are first checked through the least one of each.
    """
    source = _source(docs, id_col, text_col)
    signed = materialise(signatures(source, size))
    distinct = signed.groupBy("bits").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "of_text")).alias("row"), F.first("bands").alias("bands"))
    distinct = materialise(distinct)
    hints = None
    if prints is not None:
        met = distinct.select("bits", F.col("row.of_text").alias("of_text")).join(prints, "of_text").select("bits", "print")
        least = materialise(met.groupBy("print").agg(F.min("bits").alias("pivot")))
        own = met.join(least, "print").where("bits <> pivot").select(F.col("pivot").alias("a"), F.col("bits").alias("b"))
        hints = materialise(own.union(print_links.join(least.toDF("a", "of_a"), "a").join(least.toDF("b", "of_b"), "b").select("of_a", "of_b")))
        discard(least)
    roots = near_stars(source, distinct, size=size, percent=percent, group_limit=group_limit, large=large, hints=hints)
    rooted = distinct.select("bits", "least").join(roots.toDF("bits", "root"), "bits", "left").select("bits", "least", F.coalesce("root", "bits").alias("component"))
    rooted = materialise(rooted)
    discard(distinct, roots, *[hints] * (hints is not None))
    least = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "component").select("bits", "component", "component_id")
    out = materialise(signed.select("doc_id", "of_text", "bits").join(named, "bits").select("doc_id", "of_text", "component", "component_id"))
    discard(signed, rooted)
    return out
