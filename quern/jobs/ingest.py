"""Ingestion: files of a folder become the tables that retrieval reads. `python -m quern.jobs.ingest FOLDER OUT [--reset]`"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import chunking, indexed
from ..operators import ranking as R
from ..sources import documents, tables

CHUNKS = "chunk_id string, doc string, doc_kind string, page int, section string, text string, token_count int, is_figure boolean"


def figure_chunks(figures: DataFrame) -> DataFrame:
    """Chunks of figure captions, rows (doc, page, figure_no, caption); a page may have several."""
    return figures.select(F.concat_ws("::", "doc", F.lit("fig"), F.concat(F.lit("p"), "page"), "figure_no").alias("chunk_id"), "doc", F.lit("pdf").alias("doc_kind"), F.col("page").cast("int").alias("page"), F.lit("[Figure]").alias("section"), F.concat(F.lit("[Figure] "), "caption").alias("text"), X.approx_tokens(F.col("caption")).alias("token_count"), F.lit(True).alias("is_figure"))


def chunks_of_files(files: DataFrame, target: int = 380, least: int = 60, overlap: int = 1) -> DataFrame:
    """CHUNKS of corpus files."""
    pages = documents.text_pages(files).withColumn("pages", F.transform("pages", X.clean_page))
    cut = chunking.chunk_pages(pages, target, least, overlap).join(pages.select("doc", "doc_kind"), "doc")
    ids = F.concat("doc", F.lit("::p"), "page", F.lit("::"), F.substring(F.sha2("text", 256), 1, 16), chunking.repeat_mark(F.col("repeat")))
    return cut.select(ids.alias("chunk_id"), "doc", "doc_kind", "page", "section", "text", "token_count", F.lit(False).alias("is_figure"))


def numbered(chunks: DataFrame) -> DataFrame:
    """Chunks with their place in their document, for neighbours and ties."""
    return chunks.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc").orderBy("page", "chunk_id")))


def _index(spark: SparkSession, chunks: DataFrame) -> dict:
    """The tables that retrieval reads: chunks, vectors, and those of indexed.index_tables()."""
    keyed = chunks.select("chunk_id", R.search_text(chunks).alias("text"))
    return {"chunks": chunks, **indexed.index_tables(keyed), "vectors": R.hash_vectors(chunks, "chunk_id", "text")}


def ingest(spark: SparkSession, folder: str, out: str, reset: bool = False, figures: DataFrame | None = None) -> DataFrame:
    """Read a folder, replace its documents in the tables of `out`, and return counts by document.

    figures: captions of the documents' figures, as figure_chunks() takes them. The tables are published together as a new version
    (tables.latest() names it); until all are written, and if a run fails, readers see the version before.
    """
    new = chunks_of_files(documents.corpus_files(spark, folder))
    if figures is not None:
        new = new.unionByName(figure_chunks(figures))
    new = tables.kept(new)
    old = tables.current(spark, tables.latest(spark, out, "chunks"), new.schema)
    chunks = tables.kept(new if reset else tables.replace_documents(old, new))
    tables.publish(spark, out, _index(spark, chunks))
    return doc_stats(chunks)


def reset(spark: SparkSession, out: str) -> None:
    """A version without any chunk, posting block, term or vector."""
    tables.publish(spark, out, _index(spark, spark.createDataFrame([], CHUNKS)))


def doc_stats(chunks: DataFrame) -> DataFrame:
    words = F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    return chunks.groupBy("doc").agg(F.count("*").alias("chunks"), F.count_distinct("page").alias("pages"), F.sum(words).alias("words"), F.count_if("is_figure").alias("figures"))


if __name__ == "__main__":
    ingest(SparkSession.builder.appName("ingest").getOrCreate(), sys.argv[1], sys.argv[2], "--reset" in sys.argv[3:]).show(truncate=False)
