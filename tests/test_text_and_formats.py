import os
import random
import re

import pytest
from pyspark.sql import functions as F

from shiftlens.functions import formats as f
from shiftlens.functions import text

ACCEPT = {"123": 123.0, "-123": -123.0, "+123": 123.0, "1e6": 1e6, "-1.2E-3": -0.0012, "1,234": 1234.0, "1,234,567.89": 1234567.89, "$1,234.56": 1234.56, "-$1,234.56": -1234.56, "$-1,234.56": -1234.56, "+$1,234.56": 1234.56, "(123.45)": -123.45, "($-1,234.56)": -1234.56, "1.": 1.0, ".5": 0.5, "1,234.": 1234.0, "\t7 ": 7.0, "(-5)": -5.0}
REJECT = ["", "$", "12,34", "1,23,456", "1,234,56.78", ",123", "123,", "1,234.5.6", "+$-1", "--1", "NaN", "inf", "-inf", "1e400", "1d", "0x1", "1e", "5-", "1 2", "()", "- 5", "1e1.5", "\u0661"]


def numbers(spark, tokens):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, t string")
    return [r.x for r in df.select("i", text.parse_numeric(F.col("t")).alias("x")).orderBy("i").collect()]


def test_numbers(spark):
    assert numbers(spark, list(ACCEPT)) == list(ACCEPT.values())
    assert numbers(spark, REJECT) == [None] * len(REJECT)


def test_numbers_equal_the_grammar_written_out(spark):
    def plain(t):
        t = t.strip(" \t")
        if not re.match(text.NUMBER, t):
            return None
        x = float(re.sub(r"[$,()]", "", t))
        return -abs(x) if t.startswith("(") else x

    rng = random.Random(2)
    tokens = ["".join(rng.choice("0019,.-+$()eE d") for _ in range(rng.randint(1, 7))) for _ in range(8000)]
    assert numbers(spark, tokens) == [plain(t) for t in tokens]


def test_missing_and_tolerance(spark):
    tokens = ["", " \t ", "NA", "n/a", "Null", "nan", "none", "-", " - ", "0", "NA_", "NULLS", "--"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, t string")
    assert [r.m for r in df.select("i", text.is_missing(F.col("t")).alias("m")).orderBy("i").collect()] == [True] * 9 + [False] * 4


def test_identifiers():
    assert f.ident_json(b"a b") == "u8:a b" and f.ident_json(b"\xff") == "hex:ff" and f.ident_json(b"a\t") == "hex:6109"
    assert f.ident_human(b"u8:x") == "u8:u8:x" and f.ident_human(b"x") == "x" and f.ident_human(b"\x01") == "hex:01"
    assert f.parse_identifier("hex:DEad") == b"\xde\xad" and f.parse_identifier("u8:hex:1") == b"hex:1" and f.parse_identifier("k") == b"k"
    for bad in ("hex:1", "hex:zz"):
        with pytest.raises(ValueError):
            f.parse_identifier(bad)


@pytest.mark.parametrize("x,want", [(0.0, "0"), (1e-9, "1e-9"), (7e-10, "7e-10"), (1842100.0, "1842100"), (0.5, "0.5"), (1e21, "1e21"), (-2.5, "-2.5"), (1.25e-7, "1.25e-7")])
def test_shortest(x, want):
    assert f.shortest(x) == want and float(f.shortest(x)) == x


def test_values():
    assert f.value(1234567.0) == "1,234,567" and f.signed(60) == "+60" and f.signed(-1.5) == "-1.5" and f.signed(0) == "+0" and f.percent(0.956) == "95.6%"


def test_diagnostics(capsys):
    import json

    from shiftlens import cli
    from shiftlens.plans import refusal

    assert cli.main(["doctor"]) in (0, 1) and "checks" in json.loads(capsys.readouterr().out)
    cli.main(["doctor", "report"])
    assert {"ok", "findings", "capabilities"} <= set(json.loads(capsys.readouterr().out))
    assert cli.main(["doctor", "docs"]) == 0
    out = capsys.readouterr().out
    assert all(code in out for code in refusal.REASONS)
    assert cli.main(["doctor", "triage", "E_IO"]) == 0 and cli.main(["doctor", "triage"]) == 2 and cli.main(["doctor", "triage", "E_NONE"]) == 2
    capsys.readouterr()
    assert cli.main(["doctor", "--fix"]) == 2 and capsys.readouterr().out == ""
    assert cli.main(["no", "such", "--describe"]) == 0


def test_schema_names_the_fields_of_the_json_form(capsys):
    import json

    from shiftlens import cli
    from shiftlens.plans.compare import Verdict
    from shiftlens.plans.options import CompareOptions
    from shiftlens.plans.render import to_dict

    assert cli.main(["--schema"]) == 0
    schema = json.loads(capsys.readouterr().out)
    given = to_dict(Verdict("NO_REAL_CHANGE", CompareOptions(), {"old": "a", "new": "b"}))
    assert set(schema["required"]) <= set(given) <= set(schema["properties"])
    assert list(given["counts"]) == schema["properties"]["counts"]["required"]
    shown = to_dict(Verdict("NO_REAL_CHANGE", CompareOptions(exhaustive=True), {"old": "a", "new": "b"}, field_changes=[]))
    assert set(shown) <= set(schema["properties"])


def test_digest_of_a_file(tmp_path):
    from shiftlens.sources import ledger

    (tmp_path / "f").write_bytes(b"x" * 300_000)
    assert ledger.file_digest(str(tmp_path / "f")) == (ledger.digest(b"x" * 300_000), 300_000)


def test_places_of_the_ledger_and_profiles(tmp_path, monkeypatch, capsys):
    from shiftlens.sources import paths

    monkeypatch.setenv("HOME", str(tmp_path))
    for name in (paths.LEDGER, paths.PROFILES, paths.HOME):
        monkeypatch.delenv(name, raising=False)
    assert paths.ledger_path() == str(tmp_path / ".shiftlens" / "ledger.jsonl") and not capsys.readouterr().err
    older = tmp_path / paths.OLDER[0]
    (older / "profiles").mkdir(parents=True)
    (older / "ledger.jsonl").write_text("{}\n")
    (older / "profiles" / "a.yaml").write_text("profile_id: a\n")
    for _ in range(2):  # the copy is made once
        assert open(paths.ledger_path()).read() == "{}\n" and (paths.profile_folder() / "a.yaml").read_text() == "profile_id: a\n"
    assert capsys.readouterr().err.count("copied") == 2
    assert os.stat(paths.ledger_path()).st_mode & 0o777 == 0o600 and (paths.profile_folder()).stat().st_mode & 0o777 == 0o700
    monkeypatch.setenv(paths.LEDGER, "/elsewhere")
    assert paths.ledger_path() == "/elsewhere"


def test_shortest_is_normalised_and_in_unit_is_not():
    assert [f.shortest(k * 1e12) for k in (0, 9, 10, 12, 5870)] == ["0", "9e12", "1e13", "1.2e13", "5.87e15"]
    assert [f.in_unit(f.shortest(k * 1e12), 12) for k in (0, 9, 10, 12, 5870)] == ["0", "9e12", "10e12", "12e12", "5870e12"]
