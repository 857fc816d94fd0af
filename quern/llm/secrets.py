"""Secret scans: patterns of known secrets, and a token-efficiency test for random strings.

A natural word is covered by few entries of a byte-pair vocabulary, a random string by many: a run
of secret-like characters whose characters-per-token ratio under a tiktoken vocabulary is low counts
as random. Known digests and identifiers are excluded first. One scan of each text, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_pair_encoding, plain, text_slices, texts_of

#: Kinds in the order that breaks ties of the same start; the last is the method's own.
KINDS = ("assign", "access", "hex", "random")

_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Runs that can have RUN_CHARS characters; a look-ahead passes quickly over words that are short.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])(?<![A-Za-z0-9+/_=-]\.)(?=[A-Za-z0-9+/_=.-]{20})[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*")
#: Least characters of a run that is tested.
RUN_CHARS = 20
_NUMBER = re.compile(r"[0-9.+/_=-]+")
#: UUIDs, and hexadecimal digests by their lengths: SHA-512, SHA-384, SHA-256, SHA-224, SHA-1, MD5.
_IDENTIFIER = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|" + "|".join(f"[0-9a-f]{{{n}}}|[0-9A-F]{{{n}}}" for n in (128, 96, 64, 56, 40, 32)) + r")(?![0-9A-Za-z])")


def random_run(run: str, vocabulary: str | None, max_ratio: float, letters_ratio: float) -> bool:
    """Whether a run has few characters per token; digests, UUIDs and numbers are identifiers, not secrets.

    Without the identifiers in it a run must still have a part of RUN_CHARS characters.
    """
    if len(run) < RUN_CHARS or _NUMBER.fullmatch(run):
        return False
    if max(map(len, _IDENTIFIER.sub(" ", run).split(" "))) < RUN_CHARS:
        return False
    most = max_ratio if any(c.isdigit() for c in run) else letters_ratio
    return len(run) <= most * len(byte_pair_encoding(vocabulary).encode_ordinary(run))


def secret_spans(text: str, vocabulary: str | None, max_ratio: float, letters_ratio: float) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by kind as listed in KINDS."""
    found: list[tuple[int, int, int]] = []
    lowered = text.lower()
    if any(k in lowered for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    base = sorted(found)
    for m in _RUN.finditer(text):
        start, end = m.span()
        if end - start >= RUN_CHARS and not any(s < end and start < e for s, _, e in base) and random_run(m[0], vocabulary, max_ratio, letters_ratio):
            found.append((start, 3, end))
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, max_ratio: float = 2.0, letters_ratio: float = 1.85, keep_text: bool = False) -> DataFrame:
    """One row per input row: the id, and `spans` array<struct<kind,start,end>> (empty where none).

    vocabulary: path of a tiktoken rank file on the executors (None: the public one that is installed).
    max_ratio, letters_ratio: characters per token up to which a run of RUN_CHARS or more secret-like characters is
    random, with and without digits in it; single dots may stand in a run.

    Null texts count as empty, a null id stays null, repeated rows each return their own row, an empty
    table gives an empty result, and other columns are ignored. Very long texts are scanned whole.
    """
    source = plain(docs, id_col, text_col).toDF("doc_id", "text")
    kept = source.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, _ in text_slices(batch):
                spans = [[{"kind": k, "start": s, "end": e} for k, s, e in secret_spans(t, vocabulary, max_ratio, letters_ratio)] for t in texts_of(rows)]
                out = [rows.column(0), pa.array(spans, span)]
                yield pa.RecordBatch.from_arrays([*out, rows.column(1)][: 3 if keep_text else 2], ["doc_id", "spans", "text"][: 3 if keep_text else 2])

    return source.mapInArrow(scan, f"doc_id {kept}, spans array<struct<kind:string,start:int,end:int>>" + ", text string" * keep_text)


def spans_as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined in the given order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, **options) -> DataFrame:
    """scan_secrets() with counts and a digest of the pattern spans: the form of query op1."""
    found = scan_secrets(docs, **options)
    base = F.filter("spans", lambda s: s["kind"] != F.lit(KINDS[-1]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == F.lit(kind))).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(spans_as_text(base).cast("binary"), 256).alias("base_sha256"),
        spans_as_text(F.col("spans")).alias("spans"),
        count("random").alias("n_random"),
    )


def redact_secrets(docs: DataFrame, *, text_col: str = "text", mark: str = "<SECRET>", vocabulary: str | None = None, max_ratio: float = 2.0, letters_ratio: float = 1.85) -> DataFrame:
    """`docs` with every secret span of the text replaced by `mark`; all rows and columns stay.

    A column n_chars, where there is one, becomes the length of the new text of changed rows.
    Overlapping spans are replaced together; null texts stay null.
    """
    schema, at = docs.schema, docs.schema.fieldNames().index(text_col)

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, _ in text_slices(batch, name=text_col):
                values = rows.column(at).to_pylist()
                for i, text in enumerate(values):
                    if text and (spans := secret_spans(text, vocabulary, max_ratio, letters_ratio)):
                        out, done = [], 0
                        for _, start, end in spans:
                            if start >= done:
                                out += [text[done:start], mark]
                            done = max(done, end)
                        values[i] = "".join([*out, text[done:]])
                columns = [rows.column(i) for i in range(rows.num_columns)]
                columns[at] = pa.array(values, columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, schema=rows.schema)

    changed = docs.mapInArrow(redact, schema)
    if "n_chars" in docs.columns:
        kind = schema["n_chars"].dataType
        changed = changed.withColumn("n_chars", F.when(F.contains(F.col(text_col), F.lit(mark)), F.length(text_col)).otherwise(F.col("n_chars")).cast(kind))
    return changed.select(*[F.col(f"`{c}`") for c in docs.columns])
