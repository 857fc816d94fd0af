"""Approximate nearest neighbours by an inverted multi-index.

Vectors are scaled to length one and cut into two halves; each half is quantised by its own centroids.
A pair of centroids is a cell. A query walks over the cells by the sum of its halves' distances to the two
centroids, with a heap, until the cells hold enough entries, and these are reranked by their cosine.

The centroids grow with the root of the rows, and what is enough is learnt at every size in the same way: a few
rows' true neighbours are found among all rows, and the walk of these rows tells how far one has to go for the recall
that is asked for. Neighbouring cells form regions of a bounded number of entries, and neighbouring queries blocks
of a bounded number of queries; a task compares a block with a region that one of its queries visits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, plain


def _kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """At most k centroids of the sample's rows."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * x @ centres.T).clip(0)


def cells_by_distance(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of places, by the sum of two lists' values: the multi-sequence walk over their sorted orders."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(a[i]), int(b[j])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (first[a[p]] + second[b[q]], p, q))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def _dealt(counts: dict[int, int], piece: int) -> list[tuple[int, int, int]]:
    """(cell, first group, groups): runs of cells that hold at most `piece` together, larger cells in groups of their own."""
    out, group, held = [], 0, 0
    for cell in sorted(counts):
        n = counts[cell]
        if held and held + n > piece:
            group, held = group + 1, 0
        parts = -(-n // piece)
        out.append((cell, group, parts))
        group, held = (group + parts, 0) if parts > 1 else (group, held + n)
    return out


def _grouped(rows: DataFrame, dealt: list[tuple[int, int, int]], name: str) -> DataFrame:
    """`rows` with the group of their cell; a table of a row a cell is broadcast, at most centroids squared."""
    table = rows.sparkSession.createDataFrame(dealt, "cell long, first long, parts long")
    return rows.join(F.broadcast(table), "cell").withColumn(name, F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).drop("first", "parts")


def _best_of(index: DataFrame, ids: np.ndarray, trial: np.ndarray, k: int, kind: str) -> list:
    """(trial row, cell of one of its k nearest rows): exact, `trial` against all rows; at most k times its rows."""
    shared = index.sparkSession.sparkContext.broadcast((ids, trial))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        cells, score = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(2))
                cosine = q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
                cosine[own[:, None] == batch.column(1).to_numpy(zero_copy_only=False)] = -np.inf
                score, cells = np.hstack([score, cosine]), np.hstack([cells, np.broadcast_to(batch.column(0).to_numpy(), cosine.shape)])
                keep = np.argsort(-score, axis=1, kind="stable")[:, :k]
                score, cells = np.take_along_axis(score, keep, 1), np.take_along_axis(cells, keep, 1)
        row = np.repeat(np.arange(len(q)), score.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(cells.ravel()), pa.array(score.ravel())], ["row", "cell", "score"])

    found = index.select("cell", "id", "v").mapInArrow(compared, "row long, cell long, score double").where(F.col("score") > float("-inf"))
    top = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "cell"))
    return found.withColumn("r", top).where(F.col("r") <= k).select("row", "cell").collect()


def nearest(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, centroids: int | None = None, sample: int = 20_000, trials: int = 200, recall: float = 0.96, share: float | None = None, piece: int = 4_096) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows by cosine, other than rows of its own id.

    centroids: of each half (None: a quarter of the root of the rows, from 4 to 1,024). sample: bound of the rows that
    the centroids are fitted on; every row is indexed. share: a query visits cells until they hold that share
    of all rows (None: learnt from `trials` rows, whose true neighbours it finds with the given recall).
    piece: entries of a region and, by half of it, queries of a block.

    Ties go to the smaller id. Rows without an id take no part, nor do vectors that are null, zero, of another
    length than most, or hold null or non-finite components. Of rows with equal vectors only
    the k + 1 smallest ids can be among a query's nearest, so more of them aren't compared: nothing is lost.
    An empty table on either side gives an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession

    def proper(df: DataFrame) -> DataFrame:
        v = F.col("v")
        ok = F.col("id").isNotNull() & v.isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
        return plain(df, id_col, vector_col).toDF("id", "v").where(ok)

    rows = proper(vectors).distinct()
    asked = materialise(proper(queries).distinct())
    # the k + 1 least ids of equal vectors, first in parts of a group and then of what the parts keep
    digest = F.xxhash64("v")
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("id"))
    parts = rows.withColumns({"digest": digest, "part": F.pmod(F.xxhash64("id"), F.lit(64))}).withColumn("r", rank("digest", "v", "part")).where(F.col("r") <= k + 1)
    kept = materialise(parts.withColumn("r", rank("digest", "v")).where(F.col("r") <= k + 1).select("id", "v"))
    total = kept.count()
    kind = kept.schema["id"].dataType.simpleString()
    vector = kept.schema["v"].dataType.simpleString()
    if total == 0 or asked.isEmpty():
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    centroids = centroids or int(min(1024, max(4, np.ceil(np.sqrt(total) / 4))))
    drawn = kept if total <= sample else kept.where(F.pmod(F.xxhash64("id", "v"), F.lit(1_000_000)) < int(1_000_000 * sample / total))
    table = drawn.select("v").limit(2 * sample).toArrow()
    size = int(np.median([len(x) for x in table.column("v").combine_chunks().to_pylist()]))
    learnt = np.array([x for x in table.column("v").to_pylist() if len(x) == size])
    learnt /= np.linalg.norm(learnt, axis=1, keepdims=True)
    half = max(1, size // 2)
    books = spark.sparkContext.broadcast((_kmeans(learnt[:, :half], centroids), _kmeans(learnt[:, half:], centroids) if size > half else np.zeros((1, 0))))
    whole, asked = kept, asked.where(F.size("v") == size)

    def placed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors of length one, and the distances of their halves to the centroids."""
        one, two = books.value
        x = _matrix(column)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return x, _distances(x[:, :half], one), _distances(x[:, half:], two)

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, first, second = placed(batch.column(1))
                cell = np.argmin(first, axis=1) * second.shape[1] + np.argmin(second, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(0), batch.column(1)], ["cell", "id", "v"])

    schema = f"cell long, id {kind}, v {vector}"
    index = materialise(kept.where(F.size("v") == size).mapInArrow(celled, schema))
    counts = lambda df: {r["cell"]: r["n"] for r in df.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # noqa: E731  at most centroids * centroids rows
    held = counts(index)
    if share is None:
        picked = index.orderBy(F.xxhash64("id"), "id").limit(trials).select("id", "v").toArrow()
        x, first, second = placed(picked.column("v").combine_chunks())
        cells = np.array(sorted(held))
        n = np.array([held[c] for c in cells.tolist()])
        needed = []
        far = first[:, cells // second.shape[1]] + second[:, cells % second.shape[1]]
        for r in _best_of(index, picked.column("id").to_numpy(), x, k, kind):
            needed.append(n[far[r["row"]] <= far[r["row"], np.searchsorted(cells, r["cell"])]].sum() / total)
        share = float(np.quantile(needed, recall)) if needed else 1.0
    enough = share * total
    regions, asked_at = _dealt(held, piece), materialise(asked.mapInArrow(celled, schema))
    to_region = spark.sparkContext.broadcast({c: (held[c], g, parts) for c, g, parts in regions})
    blocked = _grouped(asked_at, _dealt(counts(asked_at), max(1, piece // 2)), "block").select("block", "id", "v")

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with the regions that it visits and how far it goes."""
        cells = to_region.value
        for batch in batches:
            if not batch.num_rows:
                continue
            _, first, second = placed(batch.column(2))
            who, where, reach = [], [], []
            for q in range(batch.num_rows):
                seen, touched, far = 0, set(), 0.0
                for i, j in cells_by_distance(first[q], second[q]):
                    if found := cells.get(i * second.shape[1] + j):
                        n, group, parts = found
                        touched.update(range(group, group + parts))
                        seen, far = seen + n, first[q, i] + second[q, j]
                    if seen >= enough:
                        break
                who += [q] * len(touched)
                where += sorted(touched)
                reach += [far] * len(touched)
            at = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int64()), batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(reach, pa.float64())], ["region", "block", "query_id", "q", "reach"])

    visits = materialise(blocked.repartition(spark.sparkContext.defaultParallelism, "id").mapInArrow(walked, f"region long, block long, query_id {kind}, q {vector}, reach double"))
    wanted = visits.groupBy("region", "block").count().select(F.col("region").alias("region"), F.col("block").alias("for_block"))
    entries = _grouped(index, regions, "region").join(wanted, "region")

    def compared(key: tuple, entries: pa.Table, questions: pa.Table) -> pa.Table:
        entries, questions = entries.sort_by("id").combine_chunks(), questions.combine_chunks()
        found = [], [], []
        if entries.num_rows and questions.num_rows:
            ids, cell, x = entries.column("id").to_numpy(), entries.column("cell").to_numpy(), _matrix(entries.column("v").chunk(0))
            x = x / np.sqrt((x * x).sum(axis=1))[:, None]
            asking, reach = questions.column("query_id").to_numpy(), questions.column("reach").to_numpy()
            q, first, second = placed(questions.column("q").chunk(0))
            i, j = cell // second.shape[1], cell % second.shape[1]
            most = min(k + 1, len(ids))
            for lo in range(0, len(q), 256):
                cosine = q[lo : lo + 256] @ x.T
                out_of_reach = first[lo : lo + 256][:, i] + second[lo : lo + 256][:, j] > reach[lo : lo + 256, None] + 1e-9
                cosine[out_of_reach | (asking[lo : lo + 256, None] == ids)] = -np.inf
                bar = np.partition(cosine, len(ids) - most, axis=1)[:, len(ids) - most]
                row, col = np.nonzero((cosine >= bar[:, None] - 1e-12) & np.isfinite(cosine))
                for out, made in zip(found, (asking[lo + row], ids[col], cosine[row, col])):
                    out.append(made)
        kinds = entries.schema.field("id").type, entries.schema.field("id").type, pa.float64()
        return pa.table([pa.array(np.concatenate(f) if f else [], t) for f, t in zip(found, kinds)], ["query_id", "vec_id", "score"])

    near = entries.groupBy("region", "for_block").cogroup(visits.groupBy("region", "block")).applyInArrow(compared, f"query_id {kind}, vec_id {kind}, score double")
    # the score once more in double precision, component by component, so that equal vectors tie exactly; what is next to the last one is a candidate as well
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    last = F.max(F.when(F.col("rank") == k, F.col("score"))).over(Window.partitionBy("query_id"))
    best = near.withColumn("rank", F.row_number().over(by)).withColumn("last", last).where(F.col("last").isNull() | (F.col("score") >= F.col("last") - 1e-9)).select("query_id", "vec_id").distinct()
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    exact = best.join(whole.toDF("vec_id", "v"), "vec_id").join(asked.toDF("query_id", "q"), "query_id").select("query_id", "vec_id", (dot("v", "q") / (F.sqrt(dot("v", "v")) * F.sqrt(dot("q", "q")))).alias("score"))
    return exact.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbour_report(vectors: DataFrame, *, id_col: str = "vec_id", every: int = 50, **options) -> DataFrame:
    """Rows whose id is divisible by `every` are the queries: the form of query op9."""
    return nearest(vectors, vectors.where(F.col(id_col) % every == 0), id_col=id_col, **options)
