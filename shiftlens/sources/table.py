"""Snapshots as DataFrames: CSV files and typed DataFrames under one shape.

A ``Table`` has a column ``row_ord`` that grows with the record order (partition and
place in it, without gaps), text columns ``c0 .. cN`` named on the driver by ``headers``,
so no header can clash with another or with a name of the engine, and ``extra``, set for
records with more fields than the header. CSV cells hold bytes as Latin-1 text, which
keeps every byte and the byte order.

``row_ord`` is computed, so two evaluations of a table may give a record two places:
a sort samples its bounds anew, a scan may be split otherwise. Whatever relies on places
pins the table first, which writes the records and their places once.

A CSV file is read line by line in splits. Of a file with quotes, a first pass over the
lines that hold one finds what each split does to an open quote; the driver strings
that together (two flags a split), and then every split is cut into records by itself,
with the lines that end its last record taken from the splits after it.
"""

from __future__ import annotations

import csv
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from shiftlens.functions.text import is_blank
from shiftlens.plans.refusal import Refused

from . import dialect as d
from .shared import materialize


#: A UTF-8 byte order mark, as Latin-1.
BOM = "\xef\xbb\xbf"
Step = Callable[[str, bool], bool | None]


@dataclass
class Table:
    df: DataFrame
    headers: list[bytes]
    name: str
    encoding: str = "latin-1"
    dialect: d.Dialect | None = None
    side: str = ""
    pinned: bool = False

    def column_of(self, name: bytes) -> int | None:
        return self.headers.index(name) if name in self.headers else None

    def bytes_of(self, text: str) -> bytes:
        return text.encode(self.encoding, "surrogatepass")

    def pin(self) -> DataFrame:
        """The records with places that stay: written once, in one evaluation, and read back from there on."""
        if not self.pinned:
            self.df, self.pinned = materialize(self.df, "records"), True
        return self.df

    def record_number(self, row_ord: int) -> int:
        """The place, from 1, of a record of the pinned table."""
        return self.pin().where(F.col("row_ord") <= row_ord).count()

    def refuse_extra(self, some: bool) -> None:
        """Refuse the first record with more fields than the header, if there is one."""
        if some:
            at = self.pin().where("extra").agg(F.min("row_ord")).first()[0]
            raise Refused("E_HEADERS", {"file": self.side, "issue": "extra_fields", "record": self.record_number(at)})

    def check_width(self) -> None:
        """The same by a pass of its own, for when no other pass over the records is to come."""
        self.refuse_extra(bool(self.df.where("extra").take(1)))


def from_frame(df: DataFrame, name: str, order: str | None = None) -> Table:
    """A DataFrame as a snapshot. Nulls are missing; a typed number's text is within the number grammar.

    ``order`` names the column that gives the record order; without one the order is
    that of the frame's partitions. Where the order matters the frame is evaluated once
    and pinned; by key it is evaluated more than once, and has to give the same rows.
    """
    cols = [F.coalesce(F.col(f"`{f.name.replace('`', '``')}`").cast("string"), F.lit("")).alias(f"c{i}") for i, f in enumerate(df.schema.fields)]
    if order:
        by = F.col(f"`{order.replace('`', '``')}`")
        df = df.repartitionByRange(by).sortWithinPartitions(by)
    return Table(df.select(F.monotonically_increasing_id().alias("row_ord"), *cols, F.lit(False).alias("extra")), [f.name.encode() for f in df.schema.fields], name, "utf-8")


def read_head(spark: SparkSession, path: str, n: int, side: str) -> bytes:
    """The first bytes of a file in any store that the engine reads."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
        try:
            return bytes(stream.readNBytes(n))
        finally:
            stream.close()
    except Exception as e:
        said = str(getattr(e, "java_exception", e)).splitlines()[0]
        raise Refused("E_IO", {"file": side, "error": said}) from e


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """The file's lines as bytes without a BOM, the offset and length of the split they start in, and whether they hold a quote."""
    meta = F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_block_length").alias("size")
    raw = F.col("value").cast("binary")
    marked = (F.monotonically_increasing_id() == 0) & (F.substring(raw, 1, len(BOM)) == F.lit(BOM.encode("latin-1")))
    line = F.when(marked, F.substring(raw, len(BOM) + 1, 2**31 - 1)).otherwise(raw)
    return spark.read.option("lineSep", "\n").text(path).select(*meta, line.alias("line"), F.contains("value", F.lit('"')).alias("quoted"))


def by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], Iterator[str]]]:
    """((offset, length), lines) of each split that a task reads, in order."""

    def lines() -> Iterator[tuple[tuple[int, int], str]]:
        for batch in batches:
            texts = b"\n".join(batch.column(2).to_pylist()).decode("latin-1").split("\n") if len(batch) else []
            yield from zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), texts, strict=True)

    for split, group in groupby(lines(), key=lambda x: x[0]):
        yield split, (line for _, line in group)


def quote_effects(spark: SparkSession, path: str, steps: list[tuple[Callable[..., Step], str, bool]]) -> list[dict[tuple[int, int], tuple]]:
    """For each kind of step: what it makes of a closed and of an open quote, by split, over the splits that hold quotes.

    Only lines with a quote leave the engine, and two values a split and step come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [make(c, b) for make, c, b in steps]
        for split, lines in by_split(batches):
            states: list[list[bool | None]] = [[False, True] for _ in made]
            for line in lines:
                for step, state in zip(made, states, strict=True):
                    if state[0] is state[1]:  # both ways have met
                        if state[0] is not None:
                            state[0] = state[1] = step(line, state[0])
                    else:
                        state[:] = [None if x is None else step(line, x) for x in state]
            cells = [[split[0]] * len(made), [split[1]] * len(made), list(range(len(made))), [s[0] for s in states], [s[1] for s in states]]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=["block", "size", "step", "closed", "open"])

    quoted = split_lines(spark, path).where("quoted").select("block", "size", "line")
    out: list[dict] = [{} for _ in steps]
    for r in quoted.mapInArrow(run, "block long, size long, step int, closed boolean, open boolean").collect():
        out[r["step"]][r["block"], r["size"]] = (r["closed"], r["open"])
    return out


def walk(effects: dict[tuple[int, int], tuple]) -> list[tuple[tuple[int, int], bool | None]]:
    """Each split that holds quotes and whether one is open at its end (None: an error in it or before it)."""
    out, state = [], False
    for split in sorted(effects):
        state = None if state is None else effects[split][state]
        out.append((split, state))
    return out


def check_quotes(spark: SparkSession, path: str, delimiters: str) -> tuple[d.Fits, bool]:
    """Whether the whole file's quotes fit each delimiter and escape mode, and whether it has any."""
    tests = [(c, b) for c in dict.fromkeys(delimiters) for b in (False, True)]
    found = quote_effects(spark, path, [(d.quote_checker, c, b) for c, b in tests])
    return {t: not e or walk(e)[-1][1] is False for t, e in zip(tests, found, strict=True)}, any(found)


def find_header(data: bytes, chosen: d.Dialect, sep: str | None) -> tuple[list[str], int] | None:
    """The header's fields, and the place after it in ``data``; None where the data ends before it does."""
    text = d.skip_blank_lines(data).decode("latin-1")
    at = 0
    for end, fields in d.records(text, chosen.delimiter, chosen.backslash):
        if not is_lead(text[at:end], fields, chosen, sep):
            return fields, len(data) - len(text) + end
        at = end
    return None


def is_lead(raw: str, fields: list[str], chosen: d.Dialect, sep: str | None) -> bool:
    """Whether a record before the header is none: a line of blanks, a blank field, or the ``sep=`` line."""
    return not raw.strip(" \t\r\n") or len(fields) == 1 and d.blank(fields) or sep is not None and d.delimiter_is_sep(fields, sep, chosen.delimiter)


def from_csv(spark: SparkSession, path: str, side: str, forced: str | None = None, aliases: dict[bytes, bytes] | None = None) -> Table:
    """A CSV file as a snapshot; refused where it can't be read exactly.

    Records that are too wide are flagged only; the pass that first reads all of them
    (keys, or record counts) refuses the first one.
    """
    size = d.HEAD
    head = read_head(spark, path, size, side)
    data = d.guard(head, side)
    sep = d.sep_line(data)
    given = forced or sep
    whole = len(head) < size
    fits, quoted = (None, b'"' in data) if whole else check_quotes(spark, path, "".join(map(chr, d.CANDIDATES)) + (given or ""))
    if given:
        if not d.skip_blank_lines(data):
            raise Refused("E_HEADERS", {"file": side, "issue": "missing_header"})
        chosen = d.escape_mode(data, given, side, fits)
    else:
        chosen = d.detect(data, side, fits)

    found = find_header(data, chosen, sep)
    while not whole and (found is None or found[1] == len(data)):  # a header longer than what has been read
        size *= 8
        head = read_head(spark, path, size, side)
        data, whole = d.guard(head, side), len(head) < size
        found = find_header(data, chosen, sep)
    if found is None:
        raise Refused("E_HEADERS", {"file": side, "issue": "missing_header"})
    header, end = found
    names = d.header_names(header, aliases or {}, side)
    if quoted:
        rows = quoted_records(spark, path, chosen, sep, len(names))
        first = rows.where("not lead").select("row_ord").first()
    else:
        rows = plain_records(spark, path, chosen.delimiter, len(names))
        # the first record with the header's fields; what stands before it has others
        mark = [F.col(f"c{i}").isin(f, BOM + f) if i == 0 else F.col(f"c{i}") == f for i, f in enumerate(header)]
        first = rows.where(F.forall(F.array(*mark), lambda x: x)).select("row_ord").first()
    if first is None:
        raise Refused("E_IO", {"file": side, "error": "the file changed while it was read"})
    # a flag, not the cells, is filtered on: the optimizer would carry conditions on every cell through the plan
    rows = rows.where((F.col("row_ord") > first["row_ord"]) & ~F.col("void"))
    return Table(rows.select(F.monotonically_increasing_id().alias("row_ord"), *(f"c{i}" for i in range(len(names))), "extra"), names, path, "latin-1", chosen, side)


def fit_width(parts: Column, n: int) -> tuple[list[Column], Column]:
    """A record's n cells, short ones padded, and whether it has further fields that aren't blank."""
    cells = [F.coalesce(F.get(parts, F.lit(i)), F.lit("")) for i in range(n)]
    return cells, F.exists(F.slice(parts, n + 1, F.greatest(F.size(parts) - n, F.lit(0))), lambda x: ~is_blank(x))


def plain_records(spark: SparkSession, path: str, delimiter: str, n: int) -> DataFrame:
    """Records of a file without quotes: the engine's splittable reader.

    It flags records whose width differs; those alone are split again from their text.
    """
    names = [f"c{i}" for i in range(n)]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, "_raw"]])
    reader = spark.read.schema(schema).option("sep", delimiter).option("quote", "").option("escape", "\0").option("encoding", "ISO-8859-1")
    df = reader.option("header", False).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_raw").option("columnPruning", False).option("maxColumns", max(20_480, n + 1)).option("maxCharsPerColumn", -1).csv(path)
    parts = F.split("_raw", re.escape(delimiter), -1)
    odd = F.col("_raw").isNotNull()
    fitted, wide = fit_width(parts, n)
    cells = [F.when(odd, x).otherwise(F.coalesce(F.col(c), F.lit(""))).alias(c) for c, x in zip(names, fitted, strict=True)]
    # the reader wants a column besides the raw text, whatever is asked of the result
    odd = odd & (F.length(F.coalesce(F.col("c0"), F.lit(""))) >= 0)
    extra = F.coalesce(odd & wide, F.lit(False))
    void = is_blank(F.concat(*cells)) & ~extra
    return df.select(F.monotonically_increasing_id().alias("row_ord"), *cells, extra.alias("extra"), void.alias("void"))


def quoted_records(spark: SparkSession, path: str, chosen: d.Dialect, sep: str | None, n: int) -> DataFrame:
    """Records of a file with quotes, cut exactly, split by split.

    ``lead`` marks records that can only stand before the header. Memory is a batch of
    lines and one record; the driver holds what records that cross a split's end have
    in the splits after it.
    """
    step_of = (d.field_tracker, chosen.delimiter, chosen.backslash)
    known = walk(quote_effects(spark, path, [step_of])[0])
    quoted = {split for split, _ in known}
    # splits after the one at ``lo``, up to ``hi``, start inside a record
    after = [split[0] for split, _ in known[1:]] + [2**63 - 1]
    crossed = [(split[0], hi) for (split, is_open), hi in zip(known, after, strict=True) if is_open]
    lows = [lo for lo, _ in crossed]

    def starts_inside(block: int) -> bool:
        k = bisect_left(lows, block) - 1
        return k >= 0 and block <= crossed[k][1]

    lines = split_lines(spark, path).select("block", "size", "line")
    tails = record_ends(lines, starts_inside, lows, step_of) if crossed else {}
    kinds = [*[pa.string()] * n, *[pa.bool_()] * 3]
    names = [*(f"c{i}" for i in range(n)), "extra", "void", "lead"]

    def cut(split: tuple[int, int], lines: Iterator[str]) -> Iterator[tuple[str, list[str]]]:
        """(raw text, fields) of the records that begin in a split."""
        step, is_open, skip, held = step_of[0](*step_of[1:]), starts_inside(split[0]), starts_inside(split[0]), []

        def flush() -> Iterator[tuple[str, list[str]]]:
            text, at = "\n".join(held) + "\n", 0
            for end, fields in d.records(text, chosen.delimiter, chosen.backslash):
                yield text[at:end], fields
                at = end

        for line in lines:
            if '"' not in line:
                if is_open:
                    if not skip:
                        held.append(line)
                elif "\r" not in line:
                    if line:
                        yield line, line.split(chosen.delimiter)
                else:
                    for part in filter(None, line.split("\r")):
                        yield part, part.split(chosen.delimiter)
                continue
            if split not in quoted:
                raise ValueError(f"{path}: its splits changed between two passes")
            began, is_open = is_open, step(line, is_open)
            if not (began or is_open or chosen.backslash or "\r" in line):
                yield line, next(csv.reader((line,), delimiter=chosen.delimiter))  # a record by itself; the same cells, faster
            elif not skip:
                held.append(line)
                if not is_open:
                    yield from flush()
                    held = []
            elif not is_open:
                skip = False
        if is_open and not skip:
            held += tails.get(split[0], [])
            yield from flush()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(2**31 - 1)
        rows: list[tuple] = []
        for split, lines in by_split(batches):
            for raw, f in cut(split, lines):
                void = d.blank(f)
                lead = (void or sep is not None) and is_lead(raw, f, chosen, sep)
                rows.append((*f, False, void, lead) if len(f) == n else (*f[:n], *[""] * (n - len(f)), not d.blank(f[n:]), void, lead))
                if len(rows) >= 20_000:
                    yield pack(rows)
                    rows = []
        yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    fields = ", ".join(f"c{i} string" for i in range(n))
    rows = lines.mapInArrow(run, f"{fields}, extra boolean, void boolean, lead boolean")
    return rows.select(F.monotonically_increasing_id().alias("row_ord"), "*")


def record_ends(lines: DataFrame, starts_inside: Callable[[int], bool], crossed: list[int], step_of: tuple) -> dict[int, list[str]]:
    """For each split whose last record crosses its end, that record's lines in the splits after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = step_of[0](*step_of[1:])
        for (block, _), texts in by_split(batches):
            held, is_open = [], starts_inside(block)
            while is_open and (line := next(texts, None)) is not None:
                held.append(line.encode("latin-1"))
                is_open = step(line, True)
            cells = [pa.array([block] * len(held), pa.int64()), pa.array(held, pa.binary()), pa.array([is_open] * len(held), pa.bool_())]
            yield pa.RecordBatch.from_arrays(cells, names=["block", "line", "goes_on"])

    heads: dict[int, tuple[list[str], bool]] = {}
    for r in lines.where(F.col("block") > crossed[0]).mapInArrow(run, "block long, line binary, goes_on boolean").collect():
        heads.setdefault(r["block"], ([], r["goes_on"]))[0].append(r["line"].decode("latin-1"))
    out: dict[int, list[str]] = {}
    blocks = sorted(heads)
    for lo in crossed:
        out[lo] = []
        for block in blocks[bisect_right(blocks, lo) :]:
            out[lo] += heads[block][0]
            if not heads[block][1]:
                break
    return out
