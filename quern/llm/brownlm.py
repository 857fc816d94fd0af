"""Class-based n-gram scoring: exchange clustering, class transitions and word emissions.

All words of a table of the most frequent ones are assigned to classes so that the classes' bigrams tell
most of each other (the exchange criterion). The few most frequent are exchanged one by one from their bigrams. For
the whole table, each sweep is a Spark job: tasks count the classes on both sides of every word, the
counts are summed by word, and the words' partitions decide on moves against the class-by-class table, which is all
that is broadcast. Words beyond the table, which are the rarest, belong to classes by their length. A text's
probability is the product of class transitions and of words within their classes, both smoothed.

Counts cover all training rows. The counts of up to `table_size` most frequent words go to every task, a
bounded table; what other words a text holds is shuffled and joined to the full table of counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fold_remainder, materialise, plain, text_slices

#: Not a word, since it is white space: the end of a text.
END = b"\n"
#: Words of the table are at most so long, which bounds its bytes.
WORD_BYTES = 64
_LENGTHS = 8
_FIXED = 1 + _LENGTHS  # classes that aren't clustered: the end, and words by length


def tokens(data: bytes) -> list[bytes]:
    """Words of the lower-cased text (A-Z only), by the white space 20 and 09 to 0D, then the end."""
    out = data.lower().split()
    out.append(END)
    return out


def _by_length(size: np.ndarray) -> np.ndarray:
    return 1 + np.minimum(size, 2 * _LENGTHS - 1) // 2


def _slice_tokens(data: np.ndarray, at: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    whole, out, counts = data.tobytes(), [], np.empty(len(at) - 1, np.int64)
    for i in range(len(at) - 1):
        before = len(out)
        out += tokens(whole[at[i] : at[i + 1]])
        counts[i] = len(out) - before
    return out, counts


def word_counts(docs: DataFrame, text_col: str = "text", flush: int = 300_000) -> DataFrame:
    """(word binary, c): counts over all rows, pre-aggregated in each task; the end is not among them."""
    source = plain(docs, text_col).toDF("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])

        for batch in batches:
            for _, data, at in text_slices(batch):
                whole = data.tobytes()
                for i in range(len(at) - 1):
                    held.update(whole[at[i] : at[i + 1]].lower().split())
                if len(held) >= flush:
                    yield out()
                    held.clear()
        yield out()

    return source.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def encode_words(docs: DataFrame, table: dict[bytes, int], *, id_col: str = "doc_id", text_col: str = "text", flag: Column | None = None) -> DataFrame:
    """(row, doc_id, flag, ids, rare): tokens as 32-bit numbers; below _FIXED: the end or a length of a word outside the table, and these words with their counts."""
    source = plain(docs, id_col, text_col).toDF("doc_id", "text").withColumn("row", F.monotonically_increasing_id()).withColumn("flag", F.lit(True) if flag is None else flag)
    shared = docs.sparkSession.sparkContext.broadcast(table)  # bounded by the table's size and WORD_BYTES

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = {**shared.value, END: -_FIXED}.get
        for batch in batches:
            for rows, data, at in text_slices(batch):
                found, n = _slice_tokens(data, at)
                ids = _FIXED + np.fromiter(map(get, found, repeat(-_FIXED - 1)), np.int32, len(found))
                outside = np.flatnonzero(ids < 0)
                ids[outside] = _by_length(np.fromiter(map(len, map(found.__getitem__, outside.tolist())), np.int32, len(outside)))
                ends = np.cumsum(n)
                cut = np.searchsorted(outside, np.concatenate([[0], ends]))
                held = [list(Counter(map(found.__getitem__, outside[a:b].tolist())).items()) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
                pairs = [p for h in held for p in h]
                words = pa.StructArray.from_arrays([pa.array([w for w, _ in pairs], pa.binary()), pa.array([k for _, k in pairs], pa.int32())], names=["word", "k"])
                offsets = pa.array(np.cumsum([0, *map(len, held)]).astype(np.int32))
                numbers = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((4 * np.concatenate([[0], ends])).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([rows.column(2), rows.column(0), rows.column(3), numbers, pa.ListArray.from_arrays(offsets, words)], ["row", "doc_id", "flag", "ids", "rare"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return materialise(source.mapInArrow(encoded, f"row long, doc_id {kind}, flag boolean, ids binary, rare array<struct<word:binary,k:int>>"), compression="zstd")


def _pairs(batches: Iterator[pa.RecordBatch], column: int, tokens_at_once: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the token before, number of the token) of runs of rows; an end is before a row's first token."""
    for batch in batches:
        held, size = [], 0
        for k, row in enumerate(batch.column(column)):
            held.append(np.frombuffer(row.as_buffer(), np.int32))
            size += len(held[-1])
            if size >= tokens_at_once or k + 1 == batch.num_rows:
                ids = np.concatenate(held)
                yield np.concatenate([[0], ids[:-1]]), ids  # the last token of a row is the end, so the first one's is before it
                held, size = [], 0


def class_bigrams(encoded: DataFrame, class_of: np.ndarray, classes: int) -> np.ndarray:
    """Counts of neighbouring classes over all rows of `ids`; class_of: by number of the token."""
    shared = encoded.sparkSession.sparkContext.broadcast(class_of)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = np.zeros(classes * classes, np.int64), shared.value
        for before, here in _pairs(batches, 0):
            values, counts = np.unique(of[before] * classes + of[here], return_counts=True)
            held[values] += counts
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(held[seen])], ["pair", "c"])

    out = np.zeros(classes * classes)
    found = encoded.select("ids").mapInArrow(pairs, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()  # at most classes * classes numbers
    out[found.column("pair").to_numpy()] = found.column("c").to_numpy()
    return out.reshape(classes, classes)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange_classes(bigrams: np.ndarray, classes: int, sweeps: int = 4) -> np.ndarray:
    """Class of each row of `bigrams`: the first _FIXED keep their own, the others move while the criterion grows.

    The criterion is the sum of n log n over class bigrams less twice that over classes, as usual for exchange.
    """
    n, total = len(bigrams), _FIXED + classes
    of = np.concatenate([np.arange(_FIXED), _FIXED + np.arange(n - _FIXED) % classes])
    one_hot = np.zeros((n, total))
    one_hot[np.arange(n), of] = 1
    to, from_ = bigrams @ one_hot, bigrams.T @ one_hot  # by word and class: what follows it, what it follows
    joint = one_hot.T @ to
    mass = bigrams.sum(axis=0)
    size = one_hot.T @ mass
    for _ in range(sweeps):
        moved = 0
        for w in range(_FIXED, n):
            here, right, left, own = of[w], to[w].copy(), from_[w].copy(), bigrams[w, w]
            right[here] -= own
            left[here] -= own
            joint[here] -= right
            joint[:, here] -= left
            joint[here, here] -= own
            size[here] -= mass[w]
            c = np.arange(_FIXED, total)
            gain = (_xlogx(joint[c] + right) - _xlogx(joint[c])).sum(axis=1) + (_xlogx(joint[:, c] + left[:, None]) - _xlogx(joint[:, c])).sum(axis=0)
            d = joint[c, c]
            gain += _xlogx(d + right[c] + left[c] + own) - _xlogx(d + right[c]) - _xlogx(d + left[c]) + _xlogx(d)
            gain -= 2 * (_xlogx(size[c] + mass[w]) - _xlogx(size[c]))
            best = int(c[np.argmax(gain)])
            if gain[best - _FIXED] <= gain[here - _FIXED] + 1e-9:
                best = here
            joint[best] += right
            joint[:, best] += left
            joint[best, best] += own
            size[best] += mass[w]
            if best != here:
                moved += 1
                of[w] = best
                to[:, here] -= bigrams[:, w]
                to[:, best] += bigrams[:, w]
                from_[:, here] -= bigrams[w]
                from_[:, best] += bigrams[w]
        if not moved:
            break
    return of


def _moved(here: np.ndarray, right: np.ndarray, left: np.ndarray, joint: np.ndarray, size: np.ndarray, may: np.ndarray) -> np.ndarray:
    """The class that is best for each word by the exchange criterion, all others staying where they are.

    right, left: by word, counts of the classes behind and before it; here: its class. A word with itself is not told apart from its class.
    """
    out, mass = here.copy(), right.sum(axis=1)
    for w in np.flatnonzero(may).tolist():
        r, l, a = right[w], left[w], here[w]
        table, sizes = joint, size
        if a >= _FIXED:  # the word leaves its class before it looks for one
            table, sizes = joint.copy(), size.copy()
            table[a] -= r
            table[:, a] -= l
            np.maximum(table, 0, out=table)
            sizes[a] -= mass[w]
        to, from_ = np.flatnonzero(r), np.flatnonzero(l)
        part, across = table[_FIXED:, to], table[from_, _FIXED:]
        gain = (_xlogx(part + r[to]) - _xlogx(part)).sum(axis=1) + (_xlogx(across + l[from_, None]) - _xlogx(across)).sum(axis=0)
        gain -= 2 * (_xlogx(sizes[_FIXED:] + mass[w]) - _xlogx(sizes[_FIXED:]))
        best = int(np.argmax(gain))
        if a < _FIXED or gain[best] > gain[a - _FIXED] + 1e-9:
            out[w] = _FIXED + best
    return out


def sweep_classes(encoded: DataFrame, class_of: np.ndarray, total: int, turn: int) -> np.ndarray:
    """One sweep of the exchange over the whole table; class_of: by number of the token, `total` classes.

    Words that are still in a class by length all get a class. Of the others a half may move in a sweep, so that words
    that suit each other don't change places for ever.
    """
    spark, n = encoded.sparkSession, len(class_of)
    shared = spark.sparkContext.broadcast(class_of)
    names = [f"r{c}" for c in range(total)] + [f"l{c}" for c in range(total)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        held = np.zeros((n, 2 * total), np.int32)
        flat = held.reshape(-1)
        for before, here in _pairs(batches, 0):
            for code in (before.astype(np.int64) * 2 * total + of[here], here.astype(np.int64) * 2 * total + total + of[before]):
                values, counts = np.unique(code, return_counts=True)
                flat[values] += counts.astype(np.int32)
        seen = _FIXED + np.flatnonzero(held[_FIXED:].any(axis=1))
        for lo in range(0, len(seen), 5_000):
            part = seen[lo : lo + 5_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *[pa.array(held[part, k].astype(np.int64)) for k in range(2 * total)]], ["word", *names])

    by_word = materialise(encoded.select("ids").mapInArrow(counted, "word long, " + ", ".join(f"{c} long" for c in names)).groupBy("word").agg(*[F.sum(c).alias(c) for c in names]))
    joint = spark.sparkContext.broadcast(class_bigrams(encoded, class_of, total))

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, of = joint.value, shared.value
        for batch in batches:
            if batch.num_rows:
                word = batch.column(0).to_numpy()
                counts = np.column_stack([c.to_numpy() for c in batch.columns[1:]]).astype(float)
                may = (of[word] < _FIXED) | ((word // 7 + turn) % 2 == 0)
                best = _moved(of[word], counts[:, :total], counts[:, total:], table, table.sum(axis=0), may)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(best)], ["word", "class"])

    out = class_of.copy()
    found = materialise(by_word.mapInArrow(decided, "word long, class long"))
    moved = found.toArrow()  # a row a word of the table
    out[moved.column("word").to_numpy()] = moved.column("class").to_numpy()
    discard(by_word, found)
    return out


@dataclass
class BrownModel:
    """Log probabilities (base 10), by number of the token: the end, words outside the table by length, then the table."""

    counts: np.ndarray  # of the end and of the table's words; 0 for lengths
    class_of: np.ndarray
    step: np.ndarray  # class to class
    class_mass: np.ndarray  # tokens by class, and for classes by length also types and one unseen
    train_tokens: int
    types: int

    @property
    def base_mass(self) -> float:
        return float(np.log10(self.train_tokens + self.types + 1))

    def emissions(self) -> np.ndarray:
        """log10 of the probability of each token within its class; of words outside the table without their own count."""
        out = np.log10(np.where(self.class_of < _FIXED, self.counts + 1, self.counts)) - self.class_mass[self.class_of]
        out[0] = 0.0  # the only word of its class
        return out


def frequent_words(counts: DataFrame, most: int) -> pa.Table:
    """At most `most` of the most frequent words, the most frequent first.

    A few hundred sums over logarithmic steps of the count tell from which count on the words fit; so no task sorts
    or gathers more than it has, and equal counts are in or out together.
    """
    short = counts.where(F.octet_length("word") <= WORD_BYTES).withColumn("step", F.floor(F.log2("c") * 64))
    least, total = None, 0
    for r in sorted(short.groupBy("step").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"]):
        total += r["n"]
        if total > most:
            break
        least = r["step"]
    kept = short.where(F.col("step") >= F.lit(least)) if least is not None else short.limit(0)
    return kept.select("word", "c").toArrow().sort_by([("c", "descending"), ("word", "ascending")])


def fit_brown(encoded: DataFrame, counts: DataFrame, top: pa.Table, ends: int, *, clustered: int = 1_000, classes: int = 40, sweeps: int = 3, weight: float = 0.9) -> BrownModel:
    """The model of the training rows, encode_words() by the table `top`, given their word_counts() and their number.

    clustered: words that are exchanged one by one, to begin with; sweeps: over the whole table.
    weight: of the class bigrams against the class shares in the transitions.
    """
    lengths, c = pa.compute.binary_length(top.column("word")).to_numpy(), top.column("c").to_numpy()
    first = min(clustered, len(c))
    class_of = np.concatenate([np.arange(_FIXED), _by_length(lengths)]).astype(np.int64)
    if first:
        alone = class_of.copy()
        alone[_FIXED : _FIXED + first] = _FIXED + np.arange(first)
        of = exchange_classes(class_bigrams(encoded, alone, _FIXED + first), max(1, min(classes, first)))
        total = int(of.max()) + 1
        class_of[_FIXED : _FIXED + first] = of[_FIXED:]
        for turn in range(sweeps if len(c) > first else 0):
            class_of = sweep_classes(encoded, class_of, total, turn)
    else:
        total = _FIXED
    joint = class_bigrams(encoded, class_of, total)
    mass = joint.sum(axis=0)
    share = (mass + 1) / (mass.sum() + total)
    step = weight * joint / np.maximum(joint.sum(axis=1, keepdims=True), 1) + (1 - weight) * share
    step = np.where(joint.sum(axis=1, keepdims=True) > 0, step, share)
    length = F.lit(1) + F.floor(F.least(F.octet_length("word"), F.lit(2 * _LENGTHS - 1)) / 2).cast("int")
    kinds = counts.groupBy(length.alias("kind")).agg(F.count("*").alias("types"), F.sum("c").alias("c")).collect()  # one row a length class
    class_mass = np.maximum(mass, 1.0)
    class_mass[1:_FIXED] = 1.0
    for r in kinds:
        class_mass[r["kind"]] += r["types"] + r["c"]
    moved = class_of[_FIXED:] >= _FIXED  # these have left the classes by length
    np.subtract.at(class_mass, _by_length(lengths[moved]), c[moved] + 1.0)
    types, tokens_in = sum(r["types"] for r in kinds), sum(r["c"] for r in kinds)
    return BrownModel(np.concatenate([[ends], np.zeros(_FIXED - 1), c]).astype(float), class_of, np.log10(step), np.log10(class_mass), tokens_in + ends, types + (ends > 0))


def score_texts(encoded: DataFrame, model: BrownModel, counts: DataFrame) -> DataFrame:
    """(doc_id, flag, n_tokens, n_known, base_score, score, perplexity): one row per row of encode_words(), of the whole text.

    base_score: add-one unigrams; score: the class model; both log10 of the text's probability.
    """
    model_of = encoded.sparkSession.sparkContext.broadcast(model)  # bounded by the table and the classes

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of.value
        emit, log_count, known = m.emissions(), np.log10(m.counts + 1), m.counts > 0
        log_count[1:_FIXED] = 0.0  # of words outside the table it is added later
        for batch in batches:
            n, of_ids, ours = [], [], []
            for ids in batch.column(3):
                i = np.frombuffer(ids.as_buffer(), np.int32)
                c = m.class_of[i]
                n.append(len(i))
                of_ids.append((int(known[i].sum()), float(log_count[i].sum()) - len(i) * m.base_mass))
                ours.append(float((emit[i] + m.step[np.concatenate([[0], c[:-1]]), c]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array([k for k, _ in of_ids], pa.int64()), pa.array([b for _, b in of_ids], pa.float64()), pa.array(ours, pa.float64()), batch.column(4)], ["row", "doc_id", "flag", "n_tokens", "n_known", "base", "model", "rare"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    near = materialise(encoded.mapInArrow(scored, f"row long, doc_id {kind}, flag boolean, n_tokens long, n_known long, base double, model double, rare array<struct<word:binary,k:int>>"))
    rare = near.where(F.size("rare") > 0).select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.k")
    later = rare.join(counts, "word").groupBy("row").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("gain"))
    whole = near.drop("rare").join(later, "row", "left")
    gain = F.coalesce("gain", F.lit(0.0))
    return whole.select("doc_id", "flag", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), (F.col("base") + gain).alias("base_score"), (F.col("model") + gain).alias("score")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def lm_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", table_size: int = 200_000, **options) -> DataFrame:
    """Learn from the rows outside the held-out fold, score all: the form of query op7.

    table_size: bound of the words that are clustered and that the driver and the tasks hold.

    Null texts are empty: their only token is the end. Rows without an id aren't held out and are learnt
    from. Repeated rows count and return as often as they are there; an empty table gives an empty
    result, and one without training rows scores every token as unseen. Other columns are ignored.
    """
    held_out = F.coalesce(fold_remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    source = plain(docs, id_col, text_col).toDF("doc_id", "text")
    train = source.where(~held_out)
    counts = materialise(word_counts(train))
    top = frequent_words(counts, table_size)
    encoded = encode_words(source, {w: i for i, w in enumerate(top.column("word").to_pylist())}, flag=held_out)
    model = fit_brown(encoded.where(~F.col("flag")), counts, top, train.count(), **options)
    scored = score_texts(encoded, model, counts)
    return scored.select("doc_id", F.col("flag").alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
