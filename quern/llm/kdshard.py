"""Sharding by a k-d tree over metadata, with DataFrame functions only.

Each level splits every node at the weighted median, by bytes, of its widest dimension. A row's place
along a dimension is a 62-bit number: 16 bits of the dimension's coordinate and below them finer bits
of it, if it is a number, and a hash of the row that breaks ties. A median is found by 8 bits at a time:
bytes are summed by node and value of those bits, which are at most 256 sums a node, and the value where half
of the node's bytes lie is opened further until what is left undecided is small. The tree itself is a few
numbers a node and is what the driver sees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialise

_STEPS = (54, 46, 38, 30, 22, 14, 6, 0)  # 8 bits at a time, from the top
_TIE = (1 << 31) - 1


def _places(rows: DataFrame, numbers: list[str], names: list[str]) -> DataFrame:
    """Columns d0, d1, ... with each row's place along the dimensions."""
    bounds = rows.agg(*[f(F.col(c).cast("double")).alias(f"{p}_{c}") for c in numbers for p, f in (("lo", F.min), ("hi", F.max))]).first() if numbers else None
    tie = F.xxhash64("doc_id", "size", "text_crc32").bitwiseAND(F.lit(_TIE))
    made = []
    for c in names:
        made.append(F.shiftleft(F.pmod(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")), F.lit(1 << 16)).cast("long"), 46) + F.shiftleft(tie, 15))
    for c in numbers:
        low, high = bounds[f"lo_{c}"], bounds[f"hi_{c}"]
        span = (high - low) if low is not None and high > low else 1.0
        share = (F.coalesce(F.col(c).cast("double"), F.lit(low or 0.0)) - F.lit(low or 0.0)) / F.lit(span)
        made.append(F.shiftleft(F.least(F.floor(share * _TIE).cast("long"), F.lit(_TIE).cast("long")), 31) + tie)
    return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("node"), *[m.alias(f"d{k}") for k, m in enumerate(made)])


def _by_node(rows: DataFrame, **values: dict[int, int]) -> DataFrame:
    """`rows` with numbers looked up by node; rows of other nodes go. A table of a row a node, at most the shards."""
    nodes = sorted(set.intersection(*[set(v) for v in values.values()]))
    lines = [F.struct(F.lit(n).alias("node"), *[F.lit(int(v[n])).cast("long").alias(name) for name, v in values.items()]) for n in nodes]
    table = rows.sparkSession.range(1).select(F.inline(F.array(*lines)))
    return rows.join(F.broadcast(table), "node")


def _along(dims: int) -> Column:
    """A row's place along the dimension `axis` that its node is split by."""
    place = F.col("d0")
    for k in range(1, dims):
        place = F.when(F.col("axis") == k, F.col(f"d{k}")).otherwise(place)
    return place


def _split(rows: DataFrame, dims: int, tolerance: float) -> tuple[dict[int, int], dict[int, int]]:
    """(dimension, threshold) of each node; what lies at the threshold or beyond goes to the right."""
    spread = rows.groupBy("node").agg(F.sum("size").alias("bytes"), *[(F.shiftright(F.max(f"d{k}"), 46) - F.shiftright(F.min(f"d{k}"), 46)).alias(f"w{k}") for k in range(dims)]).collect()  # a row a node
    axis = {r["node"]: max(range(dims), key=lambda k, r=r: (r[f"w{k}"], -k)) for r in spread}
    total = {r["node"]: r["bytes"] for r in spread}
    want = {n: b // 2 for n, b in total.items()}
    prefix, below, live = dict.fromkeys(total, 0), dict.fromkeys(total, 0), set(total)
    for i, shift in enumerate(_STEPS):
        if not live:
            break
        start = {n: prefix[n] >> _STEPS[i - 1] if i else 0 for n in live}
        seen = _by_node(rows, axis={n: axis[n] for n in live}, start=start, rest={n: want[n] - below[n] for n in live})
        seen = seen.select("node", "size", "rest", "start", _along(dims).alias("place"))
        if i:
            seen = seen.where(F.shiftright("place", _STEPS[i - 1]) == F.col("start"))
        bins = seen.groupBy("node", F.shiftright("place", shift).alias("bin")).agg(F.sum("size").alias("bytes"), F.max("rest").alias("rest"))
        run = F.sum("bytes").over(Window.partitionBy("node").orderBy("bin"))
        at = bins.withColumn("upto", run).where(F.col("upto") > F.col("rest"))
        for r in at.groupBy("node").agg(F.min(F.struct("bin", "bytes", "upto")).alias("r")).collect():  # a row a node
            n, b = r["node"], r["r"]
            prefix[n], left = b["bin"] << shift, b["upto"] - b["bytes"]
            if b["bytes"] <= tolerance * total[n] or shift == 0:
                if want[n] - below[n] - left > b["bytes"] / 2:  # nearer to the half with this bin on the left
                    prefix[n] += 1 << shift
                live.discard(n)
            below[n] += left
    return axis, prefix


def kd_shards(docs: DataFrame, *, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", numbers: tuple[str, ...] = ("doc_id", "size"), names: tuple[str, ...] = ("source", "lang"), tolerance: float = 1e-4, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every input row with its shard and its place in it.

    size: the text's UTF-8 bytes plus one. shards: a power of two; with target_bytes it is instead the
    least power of two whose shards hold at most about that many bytes. numbers, names: metadata columns
    (and size) by value and by hashed name; columns that aren't there are passed over.

    Null texts are empty (size 1), null metadata counts as the least number or the empty name. Ties are
    broken by a hash of the row; rows that repeat an id and a text can't be told apart and stay together.
    An empty table gives an empty result. Other columns are ignored.
    """
    numbers = tuple(c for c in numbers if c == "size" or c in docs.columns)
    names = tuple(c for c in names if c in docs.columns)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *[F.col(f"`{c}`").alias(f"m_{c}") for c in {*numbers, *names} - {"size"}])
    base = materialise(base)
    base = base.withColumns({"m_size": F.col("size")})
    rows = _places(base, [f"m_{c}" for c in numbers], [f"m_{c}" for c in names])
    dims = len(numbers) + len(names)
    if target_bytes:
        whole, shards = rows.agg(F.sum("size")).first()[0] or 0, 1
        while whole > shards * target_bytes:
            shards *= 2
    levels = shards.bit_length() - 1
    for _ in range(levels):
        axis, threshold = _split(rows, dims, tolerance)
        if not axis:
            break
        right = (_along(dims) >= F.col("threshold")).cast("int")
        rows = _by_node(rows, axis=axis, threshold=threshold).select("doc_id", "size", "text_crc32", (F.col("node") * 2 + right).alias("node"), *[f"d{k}" for k in range(dims)])
    placed = rows.select("doc_id", "size", "text_crc32", F.col("node").alias("shard"))
    return _numbered(materialise(placed))


def _numbered(placed: DataFrame, rows_a_part: int = 50_000) -> DataFrame:
    """Gapless slots in each shard, from counts of parts of it: no task sees a whole shard."""
    parts = max(64, placed.count() // rows_a_part)
    parted = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(parts)).cast("int"))
    counts = parted.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    return parted.withColumn("inside", inside).join(offsets, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("inside") - 1).cast("long").alias("slot"))


def shard_report(docs: DataFrame, **options) -> DataFrame:
    """kd_shards() under the law of near-equal bytes: the form of query op6."""
    return kd_shards(docs, **options).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard"))
