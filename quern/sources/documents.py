"""Files of a corpus as rows: text by its encoding, other kinds through a reader that is given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("md", "txt", "markdown", "pdf")


def corpus_files(spark: SparkSession, folder: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(path, doc, kind, content) of the files below a folder, without any below a folder named assets."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(k for kind in kinds for k in (kind, kind.upper())) + "}").load(folder)
    doc = F.element_at(F.split("path", "/"), -1)
    return files.where(~F.col("path").contains("/assets/")).select("path", doc.alias("doc"), F.lower(F.element_at(F.split("path", r"\."), -1)).alias("kind"), "content")


def decoded(content: Column) -> Column:
    """UTF-8, or else Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def text_pages(files: DataFrame) -> DataFrame:
    """(doc, doc_kind, pages, words): a text file is one page. Other kinds are left to unread()."""
    texts = files.where(F.col("kind").isin("md", "txt", "markdown")).select("doc", F.lit("text").alias("doc_kind"), decoded(F.col("content")).alias("page"))
    return texts.select("doc", "doc_kind", F.array("page").alias("pages"), F.size(F.regexp_extract_all("page", F.lit(r"\S+"), F.lit(0))).alias("words"))


def unread(files: DataFrame) -> DataFrame:
    """(path, reason) of files that text_pages() passes over."""
    return files.where(~F.col("kind").isin("md", "txt", "markdown")).select("path", F.concat(F.lit("no reader for ."), "kind").alias("reason"))


def frames(stream: DataFrame) -> DataFrame:
    """(pos, event, data) of server-sent events in rows (value string); frames without data or with bad JSON go."""
    parts = stream.select(F.posexplode(F.split(F.regexp_replace("value", "\r\n", "\n"), "\n\n")).alias("pos", "f"))
    event = F.regexp_extract("f", r"(?m)^event: ?(.*)$", 1)
    data = F.array_join(F.regexp_extract_all("f", F.lit(r"(?m)^data: ?(.*)$"), F.lit(1)), "\n")
    rows = parts.select("pos", F.when(event == "", "message").otherwise(event).alias("event"), data.alias("data"))
    return rows.where((F.col("data") != "") & F.try_parse_json("data").isNotNull())
