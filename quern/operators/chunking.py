"""Cutting texts into chunks of sentences."""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def greedy_chunks(units: Column, target: int = 380, overlap: int = 1) -> Column:
    """Array of (text, token_count): units are gathered until `target` tokens, the last `overlap` begin the next chunk.

    A fold over the units in Spark's own expressions, one row a document. What is left behind the last full
    chunk is a chunk of its own if it holds more than the carried overlap.
    """
    if overlap not in (0, 1):
        raise ValueError("overlap must be 0 or 1")
    sized = F.transform(units, lambda u: F.struct(u.alias("t"), X.approx_tokens(u).alias("n")))
    start = F.struct(F.array().cast("array<struct<text:string,token_count:int>>").alias("done"), F.array().cast("array<string>").alias("held"), F.lit(0).alias("size"), F.lit(0).alias("fresh"))
    end = lambda s: F.when(s["fresh"] > 0, F.concat(s["done"], F.array(_chunk(s["held"], s["size"])))).otherwise(s["done"])
    return F.aggregate(sized, start, lambda s, u: _fold(s, u, target, overlap), end)


def _chunk(held: Column, size: Column) -> Column:
    return F.struct(F.array_join(held, "\n").alias("text"), size.alias("token_count"))


def _fold(s: Column, u: Column, target: int, overlap: int) -> Column:
    full = s["size"] + u["n"] >= target
    none = F.array().cast("array<string>")
    carried = F.array(u["t"]) if overlap else none
    return F.struct(
        F.when(full, F.concat(s["done"], F.array(_chunk(F.concat(s["held"], F.array(u["t"])), s["size"] + u["n"])))).otherwise(s["done"]).alias("done"),
        F.when(full, carried).otherwise(F.concat(s["held"], F.array(u["t"]))).alias("held"),
        F.when(full, u["n"] if overlap else F.lit(0)).otherwise(s["size"] + u["n"]).alias("size"),
        F.when(full, F.lit(0)).otherwise(s["fresh"] + 1).alias("fresh"),
    )


def repeat_mark(repeat: Column) -> Column:
    """What the id of a chunk has besides its text's hash if the text came before in its document and page: how often it did."""
    return F.when(repeat > 0, F.concat(F.lit("::"), repeat.cast("string"))).otherwise("")


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: int = 380, overlap: int = 1) -> DataFrame:
    """(doc_id, chunk_no, chunk_id, text, token_count); ids are stable, from the text's hash."""
    held = docs.select(F.col(id_col).alias("doc_id"), X.units(F.coalesce(text_col, F.lit(""))).alias("units"))
    cut = held.select("doc_id", greedy_chunks(F.col("units"), target, overlap).alias("chunks"))
    before = lambda c, i: F.size(F.filter(F.slice("chunks", F.lit(1), i), lambda x: x["text"] == c["text"]))
    cut = cut.select("doc_id", F.posexplode(F.transform("chunks", lambda c, i: F.struct(c["text"].alias("text"), c["token_count"].alias("token_count"), before(c, i).alias("repeat")))).alias("chunk_no", "c"))
    chunk_id = F.concat(F.col("doc_id").cast("string"), F.lit("::p1::"), F.substring(F.sha2("c.text", 256), 1, 16), repeat_mark(F.col("c.repeat")))
    return cut.select("doc_id", "chunk_no", chunk_id.alias("chunk_id"), F.col("c.text").alias("text"), F.col("c.token_count").alias("token_count"))


_HEADING = re.compile(r"#{1,4}\s+")
_SHORT = 90


def _pieces(text: str) -> list[str]:
    """A text of fewer than _SHORT characters, or else what stands between its . ! ? ; and : marks."""
    return [text] if len(text) < _SHORT else [x.strip() for x in re.split(r"(?<=[.!?;:])\s+", text) if x.strip()]


def page_units(page: str) -> list[str]:
    """Headings, table rows as they are, and sentences; long ones are cut at semicolons and colons too."""
    out: list[str] = []
    for block in filter(None, map(str.strip, re.split(r"(?<=[.!?])\s+|\n{2,}", page.strip()))):
        lines = [line for line in map(str.strip, block.split("\n")) if line]
        if _HEADING.match(block):
            out.append(block)
        elif len(lines) > 1 and any(line[0] == "|" for line in lines):
            for line in lines:
                out += [line] if line[0] == "|" else _pieces(line)
        else:
            out += _pieces(block)
    return out


def _size(text: str) -> int:
    return max(1, round(len(text.split()) * 1.3))


def _page_chunks(pages: list[str], target: int, least: int, overlap: int, section_mode: str) -> list[tuple[int, str, str, int]]:
    """(page, section, text, tokens). Every chunk but a page's last one leaves its last `overlap` units to the next.

    A heading ends what has `least` tokens; a table goes on up to twice the target. A rest below `least`
    tokens, with what it was left, joins the chunk before it, which may be of an earlier page.
    """
    done: list[tuple[int, str, str, int]] = []
    for number, page in enumerate(pages or [], 1):
        units = page_units(page or "")
        named = [u.lstrip("#").strip() if _HEADING.match(u) else None for u in units]
        section = next((s for s in named if s is not None), "")
        held: list[str] = []
        size = 0

        def flush(label: str) -> None:
            nonlocal held, size
            text = "\n".join(held)
            done.append((number, label, text, _size(text)))
            held = held[-overlap:] if overlap else []
            size = _size("\n".join(held))

        for k, unit in enumerate(units):
            if named[k] is not None:
                before, section = section, named[k]
                if held and _size("\n".join(held)) >= least:
                    flush(section if section_mode == "reference" else before)
            held.append(unit)
            size += _size(unit)
            in_table = unit[0] == "|" and k + 1 < len(units) and units[k + 1][0] == "|"
            if size >= target and (size >= 2 * target or not in_table):
                flush(section)
        rest = "\n".join(held)
        if rest and done and _size(rest) < least:
            at, label, text, _ = done.pop()
            done.append((at, label, f"{text}\n{rest}", _size(f"{text}\n{rest}")))
        elif rest:
            flush(section)
    return done


def chunk_pages(pages: DataFrame, target: int = 380, least: int = 60, overlap: int = 1, section_mode: str = "own") -> DataFrame:
    """(doc, page, section, chunk_no, text, token_count, repeat) of rows (doc, pages array<string>), with headings, tables and small rests.

    repeat: earlier chunks of the page with the same text. section_mode: a chunk that a heading ends has its own section, or with "reference" that of the heading.

    The rules look back and forth within a document, so each document's pages are read by one Python call.
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, own in zip(frame["doc"], frame["pages"]):
                seen: Counter[tuple[int, str]] = Counter()
                for k, (p, s, t, n) in enumerate(_page_chunks(list(own) if own is not None else [], target, least, overlap, section_mode)):
                    rows.append((doc, p, s, k, t, n, seen[p, t]))
                    seen[p, t] += 1
            yield pd.DataFrame(rows, columns=["doc", "page", "section", "chunk_no", "text", "token_count", "repeat"])

    return pages.select("doc", "pages").mapInPandas(cut, f"doc {pages.schema['doc'].dataType.simpleString()}, page int, section string, chunk_no int, text string, token_count int, repeat int")


class _Window:
    """Neighbouring parts with the length of their joined text, so that nothing is joined before it is a piece."""

    def __init__(self, mark: str) -> None:
        self.mark, self.parts, self.length = mark, deque(), -len(mark)

    def grown(self, part: str) -> int:
        return self.length + len(self.mark) + len(part)

    def add(self, part: str) -> None:
        self.length = self.grown(part)
        self.parts.append(part)

    def drop_first(self) -> None:
        self.length -= len(self.mark) + len(self.parts.popleft())

    def text(self) -> str:
        return self.mark.join(self.parts)


def split_recursively(text: str, size: int = 1000, overlap: int = 150, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")) -> list[str]:
    """Pieces of at most `size` characters, cut at the first separator that makes them small enough; linear in the text for each separator."""
    if len(text) <= size:
        return [text] if text.strip() else []
    mark = next((s for s in separators if s == "" or s in text))
    finer = separators[separators.index(mark) + 1 :] or ("",)
    pieces: list[str] = []
    held = _Window(mark)
    for part in text.split(mark) if mark else text:
        if len(part) > size:
            pieces += [held.text(), *split_recursively(part, size, overlap, finer)]
            held = _Window(mark)
            continue
        if held.grown(part) > size:
            pieces.append(held.text())
            while held.parts and (held.length > overlap or held.grown(part) > size):
                held.drop_first()
        held.add(part)
    return [x for x in [*pieces, held.text()] if x.strip()]


def recursive_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1000, overlap: int = 150) -> DataFrame:
    """(doc_id, chunk_no, text) by split_recursively()."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(i, k, p) for i, t in zip(frame["doc_id"], frame["text"]) for k, p in enumerate(split_recursively(t or "", size, overlap))], columns=["doc_id", "chunk_no", "text"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInPandas(cut, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, chunk_no int, text string")
