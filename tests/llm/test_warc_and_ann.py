import base64
import hashlib

import numpy as np

from shiftlens.llm import ann, warc
from shiftlens.llm.common import new_path


def test_round_trip(spark):
    rows = [(1, "http://a/ b\r\nc", "<p>é</p>"), (2, None, "<p>é</p>"), (5, "http://x", None), (4, "http://y", ""), (7, "u", "WARC/1.1\r\n\r\n\r\n"), (9, "u", "z" * 500_000), (3, "u", "<p>é</p>"), (None, "u", "<p>é</p>"), (9, "u", "z" * 500_000)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, key string")
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None]
        kind = "response" if i == max(same) else "revisit"
        want.append([i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, None if kind == "response" else max(same)])
    want[-1][3:] = ["revisit", 9]  # a repeated row: one of the two is the response
    assert sorted(map(str, (list(r) for r in warc.round_trip(pages).collect()))) == sorted(map(str, want))
    assert warc.round_trip(pages.limit(0)).count() == 0
    kinds = [r.record_type for r in warc.round_trip(pages, least=9).collect()]
    assert kinds.count("revisit") == 4  # of the <p> group three, of the long one one


def test_pushdown_and_skipping(spark):
    path = new_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([(1, "u1", "a"), (2, "u2", "a"), (3, "u3", "b")], "page_id long, url string, html string"), path)
    full = warc.read_archives(spark, path).where("record_type = 'response'")
    assert {(r.target_uri, bytes(r.payload)) for r in full.collect()} == {("u2", b"a"), ("u3", b"b")}
    reader = warc.WarcReader({"path": path, "payload": "false"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_length",), 3)]))
    assert left == [GreaterThan(("payload_length",), 3)]
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["target_uri"], r["refers_to"], r["payload_length"], r["payload"]) for r in rows] == [("u1", "<urn:page:2>", 1, None)]


def test_plain_archives_are_read_too(spark, tmp_path):
    rec = "WARC/1.1\r\nWARC-Type: {}\r\nWARC-Record-ID: <urn:{}>\r\nContent-Length: {}\r\n\r\n{}\r\n\r\n"
    (tmp_path / "a.warc").write_text(rec.format("warcinfo", 0, 3, "abc") + rec.format("resource", 1, 4, "\r\n\r\n"), newline="")
    got = warc.read_archives(spark, str(tmp_path)).orderBy("record_id").collect()
    assert [(r.record_type, r.payload_length, bytes(r.payload)) for r in got] == [("warcinfo", 3, b"abc"), ("resource", 4, b"\r\n\r\n")]


def test_only_headers_are_inflated():
    import io

    data = ("WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 900000\r\n\r\n" + "".join(map(chr, np.random.default_rng(0).integers(32, 126, 900_000))) + "\r\n\r\n").encode()
    one = warc.member(data)
    raw = io.BytesIO(one + one)
    b = warc.Bytes(raw, 0, len(one) * 2)
    assert b.head(0)[0]["content-length"] == "900000" and b.stop == len(one) and len(b.data) < 10_000


def brute(rows, k, every):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float32).astype(np.float64)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = (x * x[i]).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[200:260] = x[200]  # a group of copies
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, n int")
    got = {}
    for r in ann.search(df, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(rows, 10, 20)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert np.mean([len(set(got[q]) & set(w)) / 10 for q, w in want.items()]) >= 0.9
    assert got[200] == want[200] and got[240] == want[240]  # copies: the smallest other ids


def test_repeated_ids_are_rows_of_their_own(spark):
    """Brute force over rows: an id may stand for several vectors; a wholly repeated row counts once."""
    rng = np.random.default_rng(9)
    rows = {(int(i), tuple(float(v) for v in rng.integers(-3, 4, 3))) for i in rng.integers(0, 60, 150)}
    rows = sorted(r for r in rows if any(r[1]))
    want = []
    for i, x in rows:
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j) for j, y in rows if (j, y) != (i, x))[:7]
            want += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored, 1)]
    assert len({i for i, _ in rows if i % 20 == 0}) < sum(i % 20 == 0 for i, _ in rows)  # some query id has several vectors
    df = spark.createDataFrame([(i, list(x)) for i, x in [*rows, *rows[::3]]], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, ann.search(df, k=7, recall=1.0).collect())) == sorted(want)


def test_codes_are_packed_and_tables_read_them():
    rng = np.random.default_rng(5)
    for dim in (10, 24):  # an odd and an even number of subspaces
        x = rng.normal(size=(300, dim))
        index = ann.fit(x, 3)
        cell, codes = index.encode(x)
        packed = ann.pack_codes(codes)
        assert packed.shape[1] == (codes.shape[1] + 1) // 2 and packed.dtype == np.uint8
        q = rng.normal(size=(5, dim))
        near = index.books[np.arange(codes.shape[1]), codes].reshape(len(x), -1)[:, :dim]
        got = np.stack([t.ravel().take(packed + np.arange(packed.shape[1]) * 256).sum(1) for t in index.tables(q)])
        assert np.allclose(got, q @ near.T)


def test_shards_hold_every_cell_once():
    sizes = {c: n for c, n in enumerate([5, 0 + 3, 40, 2, 2, 9, 11, 1, 30])}
    deal = ann.shards_of(sizes, 10)
    held = {}
    for c, (first, pieces) in deal.items():
        assert pieces == -(-sizes[c] // 10)
        for s in range(first, first + pieces):
            held.setdefault(s, []).append(c)
    for s, cells in held.items():
        assert len(cells) == 1 or sum(sizes[c] for c in cells) <= 10, (s, cells)
    assert sorted(held) == list(range(len(held)))


def test_anisotropic_codes_lower_the_weighted_error():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = ann.fit(x, 4)
    cell, codes = index.encode(x)
    r, u = index.parts(x - index.cells[cell]), index.parts(x)
    plain = np.stack([((r[:, k, None] - index.books[k]) ** 2).sum(2).argmin(1) for k in range(r.shape[1])], 1)

    def loss(c):
        e = r - index.books[np.arange(r.shape[1]), c]
        return (e**2).sum((1, 2)) + (index.eta - 1) * (e * u).sum((1, 2)) ** 2

    assert index.eta > 1 and (loss(codes) <= loss(plain) + 1e-12).all()


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (40, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (7, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.search(df).collect()}
    assert got == {(0, 1): (20, 1.0), (0, 2): (1, 0.5), (0, 3): (7, -1.0), (20, 1): (0, 1.0), (20, 2): (1, 0.5), (20, 3): (7, -1.0)}
    assert ann.search(df.limit(0)).count() == 0
