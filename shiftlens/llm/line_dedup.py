"""Removal of repeated multi-line passages by overlapping line chunks.

Every two neighbouring lines are a chunk, and so is a line of ``solo_words`` words or
more. So all chunks of a passage are the same wherever it stands, and together they
cover it from its first line to its last: a run of two or more lines that occurred
before goes whole, whatever stands around it. A shorter line by itself is never removed.
All documents' chunks are grouped by hash, lines compared by bytes; of a chunk
that occurs more than once the document with the smallest doc_id (of several texts under
it, the one with the smallest hash) keeps its first occurrence, every other one is
removed. The first occurrence of any line always stays, since each removed line is part
of a chunk that occurred before it.

A chunk is known by its lines' hashes. The lines' text is shuffled once, pre-aggregated,
so a line that a third of all documents share is one row a task; narrow (document, chunk)
rows are counted and meet the repeated chunks, and each document's removals meet its
text. Memory: one batch and one text.

Defined results: null text stays null and has no lines; empty text stays empty; lines
end at ``\\n`` only; a row is known by its doc_id and text, so that rows repeating both
share their fate; null ids come last; an empty table gives an empty result; an input
column named lines_removed is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_128_digest

from .common import map_rows, materialize, slices, unused

LAST = 2**63 - 1
#: The hashes of a chunk's two lines.
KEY = ["a1", "a2", "b1", "b2"]


def chunks(text: str, solo_words: int = 40) -> list[tuple[int, int]]:
    """(first line, line after the last) of the chunks that may be removed; they overlap."""
    lines = text.split("\n")
    out = [(i, i + 2) for i in range(len(lines) - 1)]
    solo = [(i, i + 1) for i, line in enumerate(lines) if len(line) >= 2 * solo_words - 1 and len(line.split()) >= solo_words]
    return sorted(out + solo) if solo else out


Hash = Callable[[bytes], tuple[int, int]]


def hash_pair(data: bytes) -> tuple[int, int]:
    d = xxh3_128_digest(data)
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def line_rows(docs: DataFrame, solo_words: int, hashed: Hash) -> DataFrame:
    """The hash and text of each line that is in a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: set[str] = set()
            size = 0
            for cell in batch.column(0):
                text = cell.as_py()
                if text and chunks(text, solo_words):
                    out.update(text.split("\n"))
                    size += len(text)
                if size > 1 << 21:
                    yield pack(out)
                    out, size = set(), 0
            yield pack(out)

    def pack(lines: set[str]) -> pa.RecordBatch:
        keys = [hashed(x.encode("utf-8", "surrogatepass")) for x in lines]
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(lines, pa.string())], names=["l1", "l2", "line"])

    return docs.select("text").mapInArrow(run, "l1 long, l2 long, line string")


def chunk_rows(docs: DataFrame, solo_words: int, hashed: Hash) -> DataFrame:
    """A row per chunk: the row and lines that it stands in, and the hashes of its lines (zeros for none)."""
    names = ["doc_id", "th", "first", "after", *KEY]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, th, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = cell.as_py()
                found = chunks(text, solo_words) if text else []
                if found:
                    keys = [hashed(x.encode("utf-8", "surrogatepass")) for x in text.split("\n")]
                    rows += [(doc_id, th, a, b, *keys[a], *(keys[a + 1] if b - a == 2 else (0, 0))) for a, b in found]
                if len(rows) > 1 << 13:
                    yield pack(rows)
                    rows = []
            yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    schema = "doc_id long, th long, first int, after int, " + ", ".join(f"{k} long" for k in KEY)
    return docs.select(docs["doc_id"].cast("long"), F.xxhash64("text").alias("th"), "text").mapInArrow(run, schema)


def repeated_chunks(docs: DataFrame, solo_words: int, hashed: Hash = hash_pair) -> DataFrame:
    """The line hashes and keeper (doc_id and text hash, the smallest) of each chunk that occurs more than once.

    Lines are compared by bytes: one whose hash stands for two different texts is in no
    chunk here, so nothing is removed by a collision.
    """
    clash = line_rows(docs, solo_words, hashed).groupBy("l1", "l2", "line").count().groupBy("l1", "l2").count().where("count > 1").select("l1", "l2")
    clash = materialize(clash, "clashes")
    row = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "th")
    again = chunk_rows(docs, solo_words, hashed).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("keeper")).where("n > 1")
    for x, y in (KEY[:2], KEY[2:]):
        again = again.join(clash, (F.col(x) == F.col("l1")) & (F.col(y) == F.col("l2")), "left_anti")
    return again.select(*KEY, "keeper")


def dedup_lines(docs: DataFrame, solo_words: int = 40, hashed: Hash = hash_pair) -> DataFrame:
    """The input's columns with the text less its repeated chunks, plus lines_removed, a row per input row."""
    row, th, cuts_of = unused(docs, "__id", "__th", "__cuts")
    again = materialize(repeated_chunks(docs, solo_words, hashed), "chunks")
    found = chunk_rows(docs, solo_words, hashed).join(again, KEY)
    keeps = (F.coalesce("doc_id", F.lit(LAST)) == F.col("keeper.id")) & (F.col("th") == F.col("keeper.th"))
    # the keeper keeps the first occurrence; its later ones go as well
    mark = F.struct("first", "after", F.when(keeps, F.col("a1")).alias("kept1"), F.when(keeps, F.col("a2")).alias("kept2"))
    cuts = found.groupBy("doc_id", "th").agg(F.collect_set(mark).alias(cuts_of))
    cuts = cuts.select(F.coalesce("doc_id", F.lit(LAST)).alias(row), F.col("th").alias(th), cuts_of)
    base = docs.select("*", F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias(row), F.xxhash64("text").alias(th))
    marked = base.join(cuts.hint("shuffle_hash"), [row, th], "left")

    others = [c for c in docs.columns if c not in ("text", "lines_removed")]
    at = [c for c in docs.columns if c != "lines_removed"].index("text")
    plain = [F.col(f"`{c}`") for c in others]
    schema = docs.select(*plain).schema.add("text", "string").add("lines_removed", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, removed = [], []
            for cell, marks in zip(batch.column(len(others)), batch.column(len(others) + 1), strict=True):
                text, n = cut(cell.as_py(), marks.as_py())
                texts.append(text)
                removed.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(texts, pa.string()), pa.array(removed, pa.int64())], names=[*others, "text", "lines_removed"])

    out = map_rows(marked.select(*plain, "text", cuts_of), run, schema)
    return out.select(*plain[:at], "text", *plain[at:], "lines_removed")


def cut(text: str | None, marks: list[dict] | None) -> tuple[str | None, int]:
    """The text without its marked chunks (but for the first of each that it is to keep), and the lines removed."""
    if text is None or not marks:
        return text, 0
    lines = text.split("\n")
    keep, seen = [True] * len(lines), set()
    for m in sorted(marks, key=lambda m: m["first"]):
        mine = tuple(lines[m["first"] : m["after"]])
        if (m["kept1"], m["kept2"]) != (None, None) and mine not in seen:
            seen.add(mine)
            continue
        keep[m["first"] : m["after"]] = [False] * (m["after"] - m["first"])
    gone = len(lines) - sum(keep)
    return ("\n".join(x for x, k in zip(lines, keep, strict=True) if k), gone) if gone else (text, 0)


