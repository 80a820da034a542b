import random

import pytest

from shiftlens.plans.refusal import Refused
from shiftlens.sources import dialect as d


def outcome(data: bytes, forced: str | None = None):
    """The dialect and escape mode, or the code of the refusal, as the source would find it."""
    try:
        data = d.guard(data, "old")
        sep = d.sep_line(data)
        given = forced or sep
        found = d.escape_mode(data, given, "old") if given else d.detect(data, "old")
        rows = [f for _, f in d.records(d.skip_blank_lines(data).decode("latin-1"), found.delimiter, found.backslash)]
        rows = [f for f in rows if not (sep and d.delimiter_is_sep(f, sep, found.delimiter))]
        if not rows:
            raise Refused("E_HEADERS", {"issue": "missing_header"})
        d.header_names(rows[0], {}, "old")
        return found.delimiter, found.backslash
    except Refused as r:
        return r.code


CASES = [
    (b"h1,h2;h3\n1,2;3\n", "E_DIALECT"),
    (b'sep=,\ncol\n"a\\"b"\n', (",", True)),
    (b'id,comment\n1,"path C:\\temp\\file"\n', (",", False)),
    (b"id,value\nA,1\nB,3\n", (",", False)),
    (b"   \n\t\t\nid,value\nA,1\n", (",", False)),
    (b" \n\t\n", "E_HEADERS"),
    (b"", "E_HEADERS"),
    (b"\xef\xbb\xbfid,value\n1,10\n2,20", (",", False)),
    (b"id^value\nA^1\nB^2\n", ("^", False)),
    (b"id,value\r\n1,10\r\n2,20\r\n", (",", False)),
    (b"name,name\nA,B\n", "E_HEADERS"),
    (b"id,value\nA,\x001\n", "E_ENCODING"),
    (b"\xff\xfei\x00d\x00", "E_ENCODING"),
    (b"\x00\x00\xfe\xff\x00\x00\x00i", "E_ENCODING"),
    (b'id,value\nA,"12"x\n', "E_CSV_PARSE"),
    (b'id,value\nA,"123\n', "E_CSV_PARSE"),
    (b"only\n1\n", "E_DIALECT"),
    (b"sep==\nid=value=note\nA=10=ok\n", ("=", False)),
    (b"sep=,\n", "E_HEADERS"),
    (b"id|name|value\n1|alpha|10\n", ("|", False)),
    (b'id;name;note\n1;"Doe; Jane";"semi; inside"\n', (";", False)),
    (b"id\tname\tvalue\n1\t alpha \t 10\n", ("\t", False)),
    (b'id,comment\n1,"quote ""inside"""\n', (",", False)),
    (b"caf\xe9,value\n1,2\n", (",", False)),
]


@pytest.mark.parametrize("data,want", CASES, ids=range(len(CASES)))
def test_outcomes(data, want):
    assert outcome(data) == want


def test_forced_control_delimiter():
    assert outcome(b"id\x01value\nA\x011\n", d.delimiter_option("0x01")) == ("\x01", False)


def test_delimiter_options():
    assert d.delimiter_option("Comma") == "," and d.delimiter_option("0x09") == "\t" and d.delimiter_option(";") == ";"
    for bad in ("", "ab", "0x0", "0x0a", '"', "é", "0x80"):
        with pytest.raises(ValueError):
            d.delimiter_option(bad)


def test_ties_that_read_alike_take_the_first_candidate():
    with pytest.raises(Refused) as e:
        d.detect(b"a,b\tc\n1,2\t3\n", "old")
    assert e.value.detail["tied_delimiters"] == [",", "\t"]


def slow_quote_error(text, delimiter, backslash):
    inside, i = False, 0
    while i < len(text):
        c, after = text[i], text[i + 1 : i + 2]
        if inside and backslash and c == "\\" and after == '"':
            i += 2
            continue
        if c == '"':
            if inside and after == '"':
                i += 2
                continue
            if inside and after and after not in delimiter + "\r\n":
                return True
            inside = not inside
        i += 1
    return inside


def test_quote_check_equals_a_plain_automaton():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice('"",\\a\n') for _ in range(rng.randint(0, 9)))
        for backslash in (False, True):
            assert d.quote_error(text, ",", backslash) == slow_quote_error(text, ",", backslash), (text, backslash)


def test_records():
    read = lambda t, b=False: [f for _, f in d.records(t, ",", b)]
    assert read('a,"b,\n""c""",\r\n\r\n,\rx') == [["a", 'b,\n"c"', ""], ["", ""], ["x"]]
    assert read('"a\\"b",c', True) == [['a"b', "c"]]
    assert read('""\n') == [[""]]


def test_header_names():
    assert d.header_names([" a ", "", "b"], {b"b": b"c"}, "old") == [b"a", b"__shiftlens_col_2", b"c"]
    with pytest.raises(Refused) as e:
        d.header_names(["a", "b"], {b"b": b"a"}, "new")
    assert e.value.detail == {"file": "new", "issue": "duplicate", "name": b"a"}
