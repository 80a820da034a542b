"""Records keep their places, and a file with quotes reads alike however it is split."""

import csv
import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from shiftlens.operators import align
from shiftlens.plans.compare import compare
from shiftlens.sources import dialect as d
from shiftlens.sources import table


@contextmanager
def settings(spark, **conf):
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def places_off(records, n):
    """How many of the records 1 .. n, sorted by a descending key n-1 .. 0, have another number than their place."""
    return records.where(F.col("rec") != n - F.col("c0").cast("long")).count()


@pytest.mark.parametrize("adaptive,n", [("true", 1_000_000), ("false", 20_000)])
def test_places_of_sorted_and_shuffled_frames(spark, adaptive, n):
    with settings(spark, **{"spark.sql.adaptive.enabled": adaptive, "spark.sql.shuffle.partitions": "8"}):
        ids = spark.range(0, n, 1, 16)
        down = ids.repartition(11).orderBy(F.desc("id"))
        records, total = align.numbered(table.from_frame(down, "old"))
        assert total == n and records.count() == n and places_off(records, n) == 0
        by_column, total = align.numbered(table.from_frame(ids.repartition(7).select((-F.col("id")).alias("at"), "id"), "old", "at"))
        assert total == n and by_column.where(F.col("rec") != n - F.col("c1").cast("long")).count() == 0


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_reordered_frames_need_a_key(spark, adaptive):
    with settings(spark, **{"spark.sql.adaptive.enabled": adaptive}):
        old = spark.range(0, 3000, 1, 5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
        new = old.repartition(6).orderBy(F.desc("k")).withColumn("v", F.col("v") + F.when(F.col("k") == 3, 1).otherwise(0))
        v = compare(spark, old, new)
        assert v.refusal.code == "E_NEED_KEY" and v.refusal.detail["suggested_keys"][0] == b"k"


def torture(rng, delimiter):
    """A file whose fields hold line ends, quotes and delimiters, with records of other widths and blank ones."""
    cells = ["", "plain", " x ", "1,234", "caf\xe9", '"', '""', "a\nb", "\n", "\n\n", "\r\n", "\r", "x" * 90, f"a{delimiter}b", 'say "hi"\nthere', "mid\"quote"]
    quoted = lambda c: '"' + c.replace('"', '""') + '"'
    lines = ["", " \t", delimiter.join(["id", '"na\nme"', "value"])]
    for i in range(60):
        row = [str(i), *(quoted(rng.choice(cells)) if rng.random() < 0.6 else rng.choice(["", "plain", " y "]) for _ in range(rng.choice([2, 2, 2, 1])))]
        lines.append(delimiter.join(row) + rng.choice(["", "", delimiter, delimiter + '" "']))
        if rng.random() < 0.1:
            lines.append(rng.choice(["", "  ", delimiter * 2, '""']))
    return rng.choice(["", "\xef\xbb\xbf"]) + rng.choice(["\n", "\r\n"]).join(lines) + rng.choice(["", "\n"])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quoted_files_at_every_split(spark, tmp_path, monkeypatch, seed):
    rng = random.Random(seed)
    delimiter = ",;\t"[seed % 3]
    text = torture(rng, delimiter)
    path = str(tmp_path / "t.csv")
    (tmp_path / "t.csv").write_bytes(text.encode("latin-1"))
    want = []
    for _, f in d.records(d.skip_blank_lines(text.removeprefix(table.BOM).encode("latin-1")).decode("latin-1"), delimiter, False):
        if not d.blank(f):
            want.append([*f[:3], *[""] * (3 - len(f))])
    for split in (11, 67, 1 << 20):
        if split == 67:  # more than the head, so that quotes are checked split by split as well
            monkeypatch.setattr(d, "HEAD", 256)
        with settings(spark, **{"spark.sql.files.maxPartitionBytes": str(split)}):
            t = table.from_csv(spark, path, "old")
            assert t.dialect == d.Dialect(delimiter, False) and t.headers == [b"id", b"na\nme", b"value"]
            got = t.df.orderBy("row_ord").select("c0", "c1", "c2").collect()
        assert [list(r) for r in got] == want[1:], split


@pytest.mark.parametrize(
    "body,want",
    [('id,v\n"a\\"b",1\n"c\nd",2\n', True), ('id,v\n"a""b",1\n"c\\\n",2\n', False), ('id,v\n"a",1\n"b"x,2\n', "E_CSV_PARSE"), ('id,v\n"a",1\n"b,2\n', "E_CSV_PARSE")],
)
def test_quotes_of_large_files(spark, tmp_path, monkeypatch, body, want):
    monkeypatch.setattr(d, "HEAD", 12)
    (tmp_path / "t.csv").write_text(body)
    with settings(spark, **{"spark.sql.files.maxPartitionBytes": "7"}):
        fits, some = table.check_quotes(spark, str(tmp_path / "t.csv"), ",;")
    assert some
    for b in (False, True):
        assert fits[",", b] == (not d.quote_error(body, ",", b)) and fits[";", b] == (not d.quote_error(body, ";", b))
    if want == "E_CSV_PARSE":
        assert not fits[",", False] and not fits[",", True]
    else:
        assert fits[",", want]


def test_line_steps_equal_the_whole_text():
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice(['"', '"', ",", "\n", "\\", "a", "\r", '""']) for _ in range(rng.randint(1, 14)))
        for b in (False, True):
            check, state = d.quote_checker(",", b), False
            track, is_open = d.field_tracker(",", b), False
            for line in text.split("\n"):
                state = None if state is None else check(line, state)
                is_open = track(line, is_open)
            assert (state is not False) == d.quote_error(text, ",", b), (text, b)
            # a field is open at the end if and only if a closing quote makes a difference to it
            ends = [end for end, _ in d.records(text + "\n#,#\n", ",", b)]
            assert is_open == (not ends or [f for _, f in d.records(text + "\n#,#\n", ",", b)][-1] != ["#", "#"]), (text, b)


def test_single_lines_read_alike_by_the_fast_way():
    rng = random.Random(6)
    for delimiter in (",", "\x01", " "):
        step = d.field_tracker(delimiter, False)
        for _ in range(6000):
            line = "".join(rng.choice(['"', '"', delimiter, "a", " ", "\\", '""', "\t", "'"]) for _ in range(rng.randint(1, 12)))
            if '"' in line and not step(line, False):
                assert [next(csv.reader((line,), delimiter=delimiter))] == [f for _, f in d.records(line + "\n", delimiter, False)]
