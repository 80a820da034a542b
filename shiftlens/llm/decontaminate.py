"""Benchmark decontamination by the q-gram lemma over diagonal bands.

Texts and items are lower-cased with runs of white space as one space. A place within
``e`` edits of an item of ``n`` characters shares at least ``n + 1 - q - e * q`` of the
item's q-grams with it, on diagonals that differ by at most ``e``. So shared q-grams
are counted, by item, in bands of ``2 (e + 1)`` diagonals that overlap by half; bands
that reach the bound are verified by a banded alignment of the whole item.

Items are dealt into blocks of about ``block_chars`` characters; a task a block writes
the index of its q-grams into the shared folder. The documents are scanned once: a task
takes texts of some megabytes at a time through the blocks one after another, so that a
worker holds one block's index and the driver none. An item is never cut, so a block is
as large as its longest item. Documents are never shuffled; a long
text goes in overlapping pieces.

Defined results: null or empty texts and items match nothing; items under q characters
match exactly; rows repeat with repeated input rows; equal items each match; empty
tables give empty results. The index stays in the shared folder as long as the result
is to be read.
"""

from __future__ import annotations

import functools
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_rows, new_path

Q = 10
RATE = 0.08
PIECE = 1 << 20
#: Characters of items a block, and of texts that go through the blocks at a time.
BLOCK_CHARS, TEXT_CHARS = 2_000_000, 4_000_000
SLOTS = 22
BASE = 0x9E3779B97F4A7C15
SCHEMA = "doc_id long, item_id long, first long, after long, edits int"


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def gram_hashes(c: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit polynomial hash of every q-gram, by doubling."""
    if len(c) < q:
        return np.empty(0, np.uint64)
    have = {1: c.astype(np.uint64)}
    power = {k: np.uint64(pow(BASE, k, 1 << 64)) for k in range(1, q + 1)}
    w = 1
    while 2 * w <= q:
        h = have[w]
        have[2 * w] = h[:-w] * power[w] + h[w:]
        w *= 2
    h, at = have[w], w
    while at < q:
        w = max(x for x in have if at + x <= q)
        h = h[: len(c) - at - w + 1] * power[w] + have[w][at : at + len(c) - at - w + 1]
        at += w
    return h


Hashed = tuple[np.ndarray, np.ndarray]


def hash_text(text: str, q: int) -> Hashed:
    """The text's characters and the hashes of its q-grams."""
    c = codes(text)
    return c, gram_hashes(c, q)


def budget(n: int, q: int = Q, rate: float = RATE) -> int:
    """Edits allowed for an item of n characters; the q-gram bound stays at least 1."""
    return max(0, min(int(rate * n), (n - q) // q))


class Index:
    """The q-grams of a block of items (id, text, how often)."""

    def __init__(self, items: list[tuple[int | None, str, int]], q: int = Q, rate: float = RATE):
        texts = [codes(t) for _, t, _ in items]
        grams = [gram_hashes(c, q) for c in texts]
        h = np.concatenate([*grams, np.empty(0, np.uint64)])
        order = np.argsort(h, kind="stable")
        hashes, first = np.unique(h[order], return_index=True)
        item = np.repeat(np.arange(len(items), dtype=np.int32), [len(g) for g in grams])
        at = np.concatenate([*(np.arange(len(g), dtype=np.int32) for g in grams), np.empty(0, np.int32)])
        none = [i is None for i, _, _ in items]
        self.load(
            q=np.array([q]),
            rate=np.array([rate]),
            ids=np.array([0 if i is None else i for i, _, _ in items], np.int64),
            none=np.array(none, bool),
            times=np.array([n for _, _, n in items], np.int64),
            ends=np.cumsum([len(c) for c in texts], dtype=np.int64),
            texts=np.concatenate([*texts, np.empty(0, "<u4")]),
            hashes=hashes,
            first=first.astype(np.int32),
            item=item[order],
            at=at[order],
        )

    def load(self, **arrays: np.ndarray) -> None:
        self.arrays = arrays
        self.q, rate = int(arrays["q"][0]), float(arrays["rate"][0])
        self.ids = [None if n else int(i) for i, n in zip(arrays["ids"], arrays["none"], strict=True)]
        self.times = arrays["times"]
        self.codes = np.split(arrays["texts"], arrays["ends"][:-1]) if len(self.ids) else []
        self.hashes, self.first, self.item, self.at = (arrays[k] for k in ("hashes", "first", "item", "at"))
        n = np.array([len(c) for c in self.codes], np.int64)
        self.edits = np.array([budget(k, self.q, rate) for k in n], np.int64)
        self.need = n - self.q + 1 - self.edits * self.q
        self.short = [k for k in range(len(n)) if 0 < n[k] < self.q]
        self.count = np.diff(np.append(self.first, len(self.item)))
        self.slots = np.zeros(1 << SLOTS, bool)
        self.slots[self.hashes >> np.uint64(64 - SLOTS)] = True
        long = n >= self.q
        self.least = int(self.need[long].min()) if long.any() else 0
        self.span = int((n + 2 * self.edits).max()) if len(n) else 0

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.arrays)
        return out.getvalue()

    @classmethod
    def parse(cls, data: bytes) -> Index:
        index = cls.__new__(cls)
        index.load(**np.load(io.BytesIO(data)))
        return index

    def text(self, k: int) -> str:
        return self.codes[k].tobytes().decode("utf-32-le", "surrogatepass")

    def bands(self, c: np.ndarray, h: np.ndarray) -> list[tuple[int, int]]:
        """(item, lowest diagonal) of the bands that share enough q-grams with the text, given its q-grams' hashes."""
        if not self.least or not len(h):
            return []
        p = np.flatnonzero(self.slots[h >> np.uint64(64 - SLOTS)])
        if len(p) < self.least:
            return []
        k = np.searchsorted(self.hashes, h[p])
        k[k == len(self.hashes)] = 0
        real = self.hashes[k] == h[p]
        p, k = p[real], k[real]
        if len(p) < self.least:
            return []
        # positions from which, or up to which, enough shared grams stand within the longest item's reach
        ahead = np.searchsorted(p, p + self.span) - np.arange(len(p))
        dense = np.flatnonzero(ahead >= self.least)
        if not len(dense):
            return []
        cover = np.zeros(len(p) + 1, np.int64)
        np.add.at(cover, dense, 1)
        np.add.at(cover, dense + ahead[dense], -1)
        live = np.cumsum(cover[:-1]) > 0
        p, k = p[live], k[live]
        n = self.count[k]
        rows = np.repeat(self.first[k] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        item, at, p = self.item[rows].astype(np.int64), self.at[rows].astype(np.int64), np.repeat(p, n)
        enough = np.bincount(item, minlength=len(self.ids)) >= np.maximum(self.need, 1)
        keep = enough[item]
        item, at, p = item[keep], at[keep], p[keep]
        if not len(p):
            return []
        step = self.edits[item] + 1
        low = (p - at) // step
        shift = int(len(c) + self.span + 2)
        band = np.concatenate([low, low - 1])
        key = (np.concatenate([item, item]) * (2 * shift) + band + shift) * np.int64(self.span + 1) + np.concatenate([at, at])
        key = np.unique(key) // (self.span + 1)  # an item's gram counts once in a band
        found, n = np.unique(key, return_counts=True)
        which, band = found // (2 * shift), found % (2 * shift) - shift
        good = n >= self.need[which]
        return [(int(i), int(b * (self.edits[i] + 1))) for i, b in zip(which[good], band[good], strict=True)]

    def align(self, c: np.ndarray, item: int, low: int) -> tuple[int, int, int] | None:
        """(edits, first, after) of the best place of the whole item from a band's diagonals on, within budget."""
        e, pattern = int(self.edits[item]), self.codes[item]
        lo, width = low - e, 2 * (e + 1) + 2 * e
        one, far = np.int64(1 << 40), np.int64(1 << 60)
        reach = np.arange(width, dtype=np.int64)
        t = lo + reach
        row = np.where((t >= 0) & (t <= len(c)), t, far)  # cost and start, packed
        padded = np.zeros(len(pattern) + width, np.uint32)
        a, b = max(0, lo), min(len(c), lo + len(pattern) + width)
        if b > a:
            padded[a - lo : b - lo] = c[a:b]
        inside = np.zeros(len(padded) + 1, bool)
        inside[max(0, a - lo) : max(0, b - lo) + 1] = True
        ramp = reach * one
        for i, ch in enumerate(pattern):
            new = row + (padded[i : i + width] != ch) * one
            new[:-1] = np.minimum(new[:-1], row[1:] + one)
            new[~inside[i + 1 : i + 1 + width]] = far
            row = np.minimum.accumulate(new - ramp) + ramp
        k = int(row.argmin())
        cost, start = divmod(int(row[k]), 1 << 40)
        return (cost, start, lo + len(pattern) + k) if cost <= e else None

    def matches(self, text: str, hashed: Hashed | None = None) -> list[tuple[int, int, int, int]]:
        """(item, first, after, edits) in a normalised text; of overlapping places of an item the best."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        for off in range(0, max(1, len(text)), PIECE):
            c, h = hashed or hash_text(text[off : off + PIECE + 2 * self.span], self.q)
            for item, low in self.bands(c, h):
                if got := self.align(c, item, low):
                    found.setdefault(item, []).append((got[0], got[1] + off, got[2] + off))
        for k in self.short:
            item = self.text(k)
            at = text.find(item)
            while at >= 0:
                found.setdefault(k, []).append((0, at, at + len(item)))
                at = text.find(item, at + len(item))
        out = []
        for item, places in sorted(found.items()):
            kept: list[tuple[int, int, int]] = []
            for p in sorted(set(places)):
                if all(p[2] <= x[1] or x[2] <= p[1] for x in kept):
                    kept.append(p)
            out += [(item, a, b, n) for n, a, b in sorted(kept, key=lambda x: x[1])]
        return out


def store(uri: str):
    """The file system and path of a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@functools.lru_cache(maxsize=1)
def index_of(path: str) -> Index:
    """The one index that a worker holds."""
    system, name = store(path)
    with system.open_input_stream(name) as f:
        return Index.parse(f.read())


def normalised_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([normalise(t.as_py()) for t in batch.column(1)], pa.string())], names=["item_id", "text"])


def write_index(benchmark: DataFrame, q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> list[str]:
    """The paths of the blocks' indexes; only their number and names reach the driver."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").mapInArrow(normalised_items, "item_id long, text string")
    items = items.where("text != ''").groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("times"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    folder = new_path(benchmark.sparkSession, "items")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(None if pd.isna(i) else int(i), t, int(n)) for i, t, n in zip(pdf["item_id"], pdf["text"], pdf["times"], strict=True)]
        data = Index(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])), q, rate).dump()
        system, root = store(folder)
        system.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.npz"  # of a task that runs twice, the name that it returns counts
        with system.open_output_stream(f"{root}/{name}") as out:
            out.write(data)
        return pd.DataFrame({"name": [name]})

    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, -(-total // block_chars)))).alias("block")
    # null ids become not-a-number on the way, so ids travel as text
    dealt = items.select(F.col("item_id").cast("string").alias("item_id"), "text", "times", block)
    return sorted(f"{folder}/{r['name']}" for r in dealt.groupBy("block").applyInPandas(build, "name string").collect())


def portions(batches: Iterator[pa.RecordBatch], at: int, q: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[str, Hashed | None]]]]:
    """The batches in pieces of about TEXT_CHARS characters, with their normalised texts.

    Texts that are one piece come with their hashes, so that these serve all blocks.
    """
    for batch in batches:
        begin, texts, size = 0, [], 0
        for k, cell in enumerate(batch.column(at)):
            text = normalise(cell.as_py())
            texts.append((text, hash_text(text, q) if len(text) <= PIECE else None))
            size += len(text)
            if size >= TEXT_CHARS or k == len(batch) - 1:
                yield batch.slice(begin, k + 1 - begin), texts
                begin, texts, size = k + 1, [], 0


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, first, after (in the normalised text) and edits, a row per leaked item and place."""
    paths = write_index(benchmark, q, rate, block_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, 1, q):
            ids = batch.column(0).to_pylist()
            for path in paths:
                index, out = index_of(path), []
                for doc_id, (text, hashed) in zip(ids, texts, strict=True):
                    for i, a, b, n in index.matches(text, hashed):
                        out += [(doc_id, index.ids[i], a, b, n)] * int(index.times[i])
                cols = list(zip(*out, strict=True)) if out else [[]] * 5
                kinds = [pa.int64()] * 4 + [pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "first", "after", "edits"])

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, SCHEMA)


def drop_leaked(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents in which no item is found; the input's columns."""
    at = docs.columns.index("text")
    paths = write_index(benchmark, q, rate, block_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, at, q):
            clean = [True] * len(texts)
            for path in paths:
                index = index_of(path)
                clean = [c and not index.matches(*t) for c, t in zip(clean, texts, strict=True)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return map_rows(docs, run, docs.schema)
