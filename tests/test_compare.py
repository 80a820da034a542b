import json

import pytest

from shiftlens.operators import repro
from shiftlens.operators.cells import coverage
from shiftlens.plans import capsule
from shiftlens.plans.compare import compare
from shiftlens.plans.options import CompareOptions
from shiftlens.plans.render import to_dict, to_json, to_text
from shiftlens.sources import ledger, profile


@pytest.fixture
def run(spark, tmp_path):
    def go(old, new, **options):
        for side, body in (("old", old), ("new", new)):
            (tmp_path / f"{side}.csv").write_bytes(body if isinstance(body, bytes) else body.encode())
        return compare(spark, str(tmp_path / "old.csv"), str(tmp_path / "new.csv"), **options)

    return go


def code(v):
    return v.refusal.code if v.refusal else v.outcome


def test_real_change_in_record_order(run):
    v = run("id,region,amount\nA,US,100\nB,EU,200\n", "id,region,amount\nA,US,100\nB,EU,260\n", explicit=True)
    d = to_dict(v)
    assert (v.outcome, v.exit_code) == ("REAL_CHANGE", 1)
    assert d["contributors"] == [{"row_id": "u8:2", "column": "u8:amount", "old": 200.0, "new": 260.0, "delta": 60.0, "contribution": 60.0, "share": 1.0, "cumulative_share": 1.0}]
    assert list(d["counts"].values()) == [2, 2, 2, 3, 3, 3, 0, 0, 1, 2, 1]
    assert "1. 2.amount  +60  (200 -> 260)" in to_text(v)
    assert json.loads(to_json(v)) == d


def test_keyed_with_key_excluded_and_values_redacted(run):
    v = run("id,value,other\nA,1,foo\nB,2,bar\nC,3,baz\n", "id,value,other\nC,3,baz\nB,5,bar\nA,1,foo\n", key="id")
    assert v.outcome == "REAL_CHANGE" and v.counts["columns_common"] == 2 and v.metrics["total_change"] == 3
    assert set(to_dict(v)["contributors"][0]) == {"row_id", "column", "share", "cumulative_share"}


def test_no_change_and_no_numeric(run):
    v = run("value,score\n1,2\n3,4\n", "value,score\n1,2\n3,4\n")
    assert (v.outcome, v.metrics) == ("NO_REAL_CHANGE", {"total_change": 0.0, "max_abs_delta": 0.0, "top_k_coverage": None})
    v = run("id,name\nA,x\n", "id,name\nA,x\n", key="id")
    assert code(v) == "E_NO_NUMERIC" and v.counts["rows_aligned"] == 1 and v.metrics["total_change"] is None


@pytest.mark.parametrize(
    "old,new,options,want,detail",
    [
        ("id,amount\nA,100.50\nB,200.75\n", "id,amount\nA,100.50\nB,\n", {"key": "id"}, "E_MISSINGNESS", {"file": "old", "column": "u8:amount", "value": "u8:200.75", "key": "u8:B"}),
        ("id,amount\nA,100\nB,200\n", "id,amount\nA,abc\nB,210\n", {"key": "id"}, "E_MIXED_TYPES", {"file": "new", "column": "u8:amount", "value": "u8:abc", "key": "u8:A"}),
        ("a,b\n10,1\noops,2\n", "a,b\n11,1\n12,2\n", {}, "E_MIXED_TYPES", {"file": "old", "column": "u8:a", "value": "u8:oops", "record": 2}),
        ("id,v\nA,1\n", "id,v\nA,1\n", {"key": "zz"}, "E_NO_KEY", {"key_column": "u8:zz"}),
        ("id,v\nA,1\n \t,2\n", "id,v\nA,1\nB,2\n", {"key": "id"}, "E_KEY_EMPTY", {"file": "old", "record": 2, "column": "u8:id"}),
        ("id,v\nA,1\nB,2\n", "id,v\nA,1\n\nA ,2\nB,2\n", {"key": "id"}, "E_KEY_DUP", {"file": "new", "record": 2, "key": "u8:A"}),
        ("id,v\nA,1\nB,2\n", "id,v\nA,1\nC,2\n", {"key": "id"}, "E_KEY_MISMATCH", {"missing_in_new": 1, "extra_in_new": 1, "missing_samples": ["u8:B"], "extra_samples": ["u8:C"]}),
        ("id,v\nA,1\nB,1\n", "id,v\nA,1\n", {}, "E_ROWCOUNT", {"rows_old": 2, "rows_new": 1, "suggested_keys": ["u8:id"]}),
        ("id,value\na,1\nb,2\n", "id,value\nb,3\na,4\n", {}, "E_NEED_KEY", {"suggested_keys": ["u8:id", "u8:value"]}),
        ("id,v\nA,1,x\n", "id,v\nA,1\n", {"delimiter": ","}, "E_HEADERS", {"file": "old", "issue": "extra_fields", "record": 1}),
        ("only\n1\n", "only\n1\n", {}, "E_DIALECT", {"file": "old", "tied_delimiters": [",", "\t", ";", "|", "^"], "suggestion": "sep=,"}),
        ("id,v\nA,1\n", 'id,v\nA,"1\n', {}, "E_CSV_PARSE", {"file": "new", "line": None, "column": None}),
        ("id,v\nA,1\n", "id,v\nA,2\n", {"audit_fields": True}, "E_AUDIT_FIELDS_REQUIRES_EXHAUSTIVE", {}),
        ("id,v\nA,1\n", "id,v\nA,2\n", {"audit_fields": True, "exhaustive": True}, "E_AUDIT_FIELDS_REQUIRES_PROFILE", {}),
        ("id,v\nA,1\n", "id,v\nA,2\n", {"profile": "p", "profile_id": "q"}, "E_AMBIGUOUS_PROFILE", {"profile_path": "p", "profile_id": "q"}),
    ],
)
def test_refusals(run, old, new, options, want, detail):
    v = run(old, new, **options)
    assert code(v) == want and to_dict(v)["refusal"]["detail"] == detail and v.exit_code == 2
    assert f"Reason ({want})" in to_text(v)


def test_missing_file(spark, tmp_path):
    v = compare(spark, str(tmp_path / "none.csv"), str(tmp_path / "none.csv"))
    assert code(v) == "E_IO" and v.refusal.detail["file"] == "old"


def test_quoted_wide_short_and_byte_cells(run):
    old = b'id,note,v\nA,"x,\ny",1\nB,\xff,"1,000"\n , ,\nC,z\n'
    new = b'id,note,v\nA,"x,\ny",1\nB,\xff,"1,500",, \nC,z\n'
    v = run(old, new, key="id")
    assert v.outcome == "REAL_CHANGE" and v.metrics["total_change"] == 500 and v.counts["rows_old"] == 3
    plain = run(old.replace(b'"x,\ny"', b"x").replace(b'"1,000"', b"1000"), new.replace(b'"x,\ny"', b"x").replace(b'"1,500"', b"1500"), key="id", delimiter=",")
    assert plain.metrics["total_change"] == 500 and plain.counts == v.counts


def test_sep_line_bom_and_blank_lines(run):
    v = run(b"\xef\xbb\xbfsep=;\nid;v\n1;2\n", b"\n \t\nid;v\n1;3\n")
    assert v.outcome == "REAL_CHANGE" and v.dialects["old"].delimiter == ";"


def test_diffuse_and_exhaustive(run):
    head = "id," + ",".join(f"v{i}" for i in range(1, 31))
    old, new = f"{head}\nA,{','.join(['0'] * 30)}\n", f"{head}\nA,{','.join(['1'] * 30)}\n"
    v = run(old, new, key="id")
    assert code(v) == "E_DIFFUSE" and abs(v.metrics["top_k_coverage"] - 25 / 30) < 1e-12
    v = run(old, new, key="id", exhaustive=True)
    assert v.outcome == "REAL_CHANGE" and len(v.contributors) == 30 and [c.column for c in v.contributors[:3]] == [b"v1", b"v10", b"v11"]
    v = run(old, new, key="id", exhaustive=True, max_audit_changes=2)
    assert code(v) == "E_AUDIT_LIMIT" and v.refusal.detail["changed_cells"] == 30 and v.counts["numeric_cells_changed"] is None


def test_profile_scope_key_aliases_and_field_audit(run, tmp_path):
    reg = tmp_path / "reg"
    reg.mkdir()
    (reg / "registry.json").write_text("{}")
    (reg / "m.json").write_text(json.dumps([{"input": i, "canonical_id": c, "canonical_type": k, "rule_id": "r"} for i, c, k in (("Number", "id", "column_name"), ("No.", "id", "column_name"), ("x", "id", "other"))]))
    p = tmp_path / "p.yaml"
    p.write_text("profile_id: p1 # comment\nprofile_sha256: abc\ncolumn_registry: reg\ninclude_columns: [id, status, kind, absent]\nkey:\n  - id\n")
    old, new = "Number,status,kind,skip\nB,open,a,1\nA,open,a,1\n", "No.,status,kind,skip\nB,closed,a,9\nA,shut,b,9\n"
    v = run(old, new, profile=str(p), exhaustive=True, audit_fields=True, explicit=True)
    assert v.outcome == "REAL_CHANGE" and v.counts["columns_common"] == 2
    assert [(c.row, c.column, c.new) for c in v.field_changes] == [(b"A", b"kind", b"b"), (b"A", b"status", b"shut"), (b"B", b"status", b"closed")]
    assert code(run(old, new, profile=str(p), key="id")) == "E_KEY_CONFLICT"
    assert code(run(old, new, profile_id="nope", profile_dir=str(tmp_path))) == "E_PROFILE_NOT_FOUND"
    assert run(old, new, profile_id="p1", profile_dir=str(tmp_path), exhaustive=True, audit_fields=True).outcome == "REAL_CHANGE"
    (reg / "m.json").write_text("[1]")
    assert code(run(old, new, profile=str(p))) == "E_PROFILE_REGISTRY"
    parsed = profile.parse_profile(p.read_text())
    assert profile.parse_profile(profile.render_profile(parsed)) == profile.Profile(parsed.include, parsed.key, parsed.key_labels, parsed.profile_id, parsed.sha256, parsed.column_registry)
    root = capsule.write_capsule(run(old, new, key="Number"), "text", str(tmp_path / "caps"))
    assert root and json.loads(open(f"{root}/manifest.json").read())["outcome"] == "REFUSAL"


def test_old_file_is_refused_before_new_file_and_key(run, spark, tmp_path):
    wide = {"file": "old", "issue": "extra_fields", "record": 2}
    v = run("id,v\nA,1\n \nB,2,x\nB,2,y\n", "id,v\nA,1\nB,2,x\n", delimiter=",", key="id")
    assert code(v) == "E_HEADERS" and v.refusal.detail == wide
    v = compare(spark, str(tmp_path / "old.csv"), str(tmp_path / "none.csv"), delimiter=",", key="id")
    assert code(v) == "E_HEADERS" and v.refusal.detail == wide
    assert run("id,v\nA,1\n \nB,2,x\n", "id,v\nA,1\n", delimiter=",", key="zz").refusal.detail == wide


def test_record_numbers_over_many_splits(run, spark):
    lines = [f"{i},{i * 7 % 1000}" for i in range(1, 2001)]
    old = "id,v\n" + "\n \n".join(lines) + "\n"
    new = "\n".join(["id,v", *lines[:1500], "1501,-5", *lines[1501:]]) + "\n"
    moved = "\n".join(["id,v", *lines[1:], lines[0]]) + "\n"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        v = run(old, new, explicit=True)
        assert v.outcome == "REAL_CHANGE" and [(c.row, c.column, c.new) for c in v.contributors] == [(b"1501", b"v", -5.0)] and v.counts["rows_aligned"] == 2000
        v = run(old, moved)
        assert code(v) == "E_NEED_KEY" and v.refusal.detail["suggested_keys"] == [b"id"]
        wide = old.replace("1999,993", "1999,993,x")
        assert run(wide, new, delimiter=",").refusal.detail == {"file": "old", "issue": "extra_fields", "record": 1999}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_frames_nulls_and_types(spark):
    old = spark.createDataFrame([("a", 1.5, None, "x"), ("b", 2.0, None, "x")], "k string, v double, w int, t string")
    new = spark.createDataFrame([("b", 2.0, None, "y"), ("a", 4.0, None, "x")], "k string, v double, w int, t string")
    v = compare(spark, old, new, key="k")
    assert v.outcome == "REAL_CHANGE" and v.metrics["total_change"] == 2.5 and v.counts["numeric_columns"] == 1
    gone = spark.createDataFrame([("b", None, 1, "y"), ("a", 4.0, 1, "x")], "k string, v double, w int, t string")
    assert code(compare(spark, old, gone, key="k")) == "E_MISSINGNESS"
    assert code(compare(spark, old.limit(0), new.limit(0), key="k")) == "E_NO_NUMERIC"


def test_ties_at_the_cut_go_to_earlier_columns(spark):
    names = [f"c{i:02d}" for i in range(26, 0, -1)]
    row = lambda x: spark.range(1).selectExpr("'k' as k", *(f"{x}.0D as {n}" for n in names))
    v = compare(spark, row(0), row(1), key="k", threshold=0.96)
    assert [c.column.decode() for c in v.contributors] == sorted(names)[1:]  # the last column, c01, is cut


def test_coverage():
    assert coverage([10, 5], 18, 0.9).kind == "diffuse"
    c = coverage([6, 3, 1], 10, 0.9)
    assert (c.kind, c.count, c.covered) == ("prefix", 2, 1.0)
    assert coverage([], 0.0, 0.9).kind == "none" and coverage([1], float("inf"), 0.5).kind == "none"


def test_options_are_checked():
    for bad in ({"threshold": 0}, {"threshold": 1.1}, {"tolerance": -1}, {"max_audit_changes": 0}):
        with pytest.raises(ValueError):
            CompareOptions(**bad)


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "l" / "ledger.jsonl")
    assert ledger.count(ledger.scan(spark, path)) == 0
    for i in range(5):
        ledger.append(path, ledger.make_record("t" if i % 2 else "u", "1", [{"path": f"/x/{i}.csv", "hash": f"sha256:{i}", "bytes": i}], {"k": i}, "REAL_CHANGE", 1, "out", f"2026-01-0{i + 1}T00:00:00Z"))
    with open(path, "a") as f:
        f.write("not json\n{}\n")
    df = ledger.scan(spark, path)
    assert ledger.count(df) == 5 and ledger.count(df, tool="t", outcome="real_change") == 2
    assert [r.ts[:10] for r in ledger.query(df, 2, since="2026-01-02T00:00:00Z").collect()] == ["2026-01-02", "2026-01-03"]
    assert ledger.last(df).first().inputs[0].bytes == 4 and ledger.count(df, input_hash="256:3") == 1
    assert ledger.table_lines(ledger.last(df).collect())[0].endswith("4.csv")


def test_repro(spark):
    a = spark.createDataFrame([("r1", 5), ("r2", 1)], "row_id string, place int")
    b = spark.createDataFrame([("r1", 0), ("r3", 2)], "row_id string, place int")
    assert [r.row_id for r in repro.select_rows([a, b]).collect()] == ["r2", "r1", "r3"]
    assert repro.select_columns(b"k", [[b"a", b"k"], [b"b"]], 2) == [b"k", b"a"]
