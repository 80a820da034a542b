"""CSV dialects, on the bytes of a file: encoding guard, ``sep=`` line, delimiter detection, exact records."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from shiftlens.plans.refusal import Refused

#: Candidate delimiters in order of preference, sample size, names of delimiters.
CANDIDATES = b",\t;|^"
SAMPLE_RECORDS, SAMPLE_BYTES = 200, 64 << 10
NAMES = {"comma": ",", "tab": "\t", "semicolon": ";", "pipe": "|", "caret": "^"}
BOMS = ((b"\xff\xfe\x00\x00", "utf32"), (b"\x00\x00\xfe\xff", "utf32"), (b"\xff\xfe", "utf16"), (b"\xfe\xff", "utf16"))
GUARD = 8192
HEAD = 4 << 20


@dataclass(frozen=True)
class Dialect:
    delimiter: str
    backslash: bool = False

    def to_json(self) -> dict:
        return {"delimiter": self.delimiter, "quote": '"', "escape": "\\" if self.backslash else None}


def valid_delimiter(b: int) -> bool:
    return 1 <= b <= 0x7F and b not in b'"\r\n'


def delimiter_option(text: str) -> str:
    """A name, ``0xNN`` or a single ASCII character."""
    if text.lower() in NAMES:
        return NAMES[text.lower()]
    if re.fullmatch(r"0[xX][0-9A-Fa-f]{2}", text):
        b = int(text, 16)
    elif len(text) == 1 and ord(text) < 128:
        b = ord(text)
    else:
        raise ValueError(f"delimiter {text!r}: give a name, 0xNN or one ASCII character")
    if not valid_delimiter(b):
        raise ValueError(f"delimiter {text!r} can't be used")
    return chr(b)


def guard(head: bytes, side: str) -> bytes:
    """The head without a UTF-8 BOM; other encodings are refused."""
    for bom, issue in BOMS:
        if head.startswith(bom):
            raise Refused("E_ENCODING", {"file": side, "issue": issue})
    head = head.removeprefix(b"\xef\xbb\xbf")
    if b"\0" in head[:GUARD]:
        raise Refused("E_ENCODING", {"file": side, "issue": "nul_byte"})
    return head


def lines_of(data: bytes) -> Iterator[bytes]:
    for line in data.split(b"\n"):
        yield line.removesuffix(b"\r")


def skip_blank_lines(data: bytes) -> bytes:
    """From the first line that is more than spaces, tabs and carriage returns."""
    m = re.match(rb"(?:[ \t\r]*\n)*", data)
    rest = data[m.end() :]
    return b"" if not rest.strip(b" \t\r\n") else rest


def sep_line(data: bytes) -> str | None:
    """The delimiter that the first line with content sets by ``sep=``."""
    for line in lines_of(data):
        if line.strip(b" \t\r"):
            return chr(line[4]) if len(line) == 5 and line.startswith(b"sep=") and valid_delimiter(line[4]) else None
    return None


def inside(backslash: bool, strict: bool) -> str:
    """What may stand between quotes; in the strict reading a backslash escapes nothing but a quote."""
    if not backslash:
        return r'(?:[^"]|"")*+'
    return r'(?:[^"\\]|\\"|\\(?!")|"")*+' if strict else r'(?:[^"\\]|\\.|"")*+'


def quote_checker(delimiter: str, backslash: bool) -> Callable[[str, bool], bool | None]:
    """(line, whether a quote is open at its start) -> whether one is open at its end, or None for an error.

    Any quote outside quotes opens; a closing one has to stand before a delimiter or line end.
    The text may be several lines, without the last line end.
    """
    field = f'"{inside(backslash, True)}'
    closed = re.compile(rf'[^"]*+(?:{field}"(?=[{re.escape(delimiter)}\r\n]|\Z)[^"]*+)*+')
    rest = re.compile(rf"{field}\Z")

    def step(line: str, is_open: bool) -> bool | None:
        line = f'"{line}' if is_open else line
        end = closed.match(line).end()
        return False if end == len(line) else True if rest.match(line, end) else None

    return step


def quote_error(text: str, delimiter: str, backslash: bool) -> bool:
    """Whether a quote is left open, or closed before anything but a delimiter or line end."""
    return quote_checker(delimiter, backslash)(text, False) is not False


def field_tracker(delimiter: str, backslash: bool) -> Callable[[str, bool], bool]:
    """(line, whether a field is open at its start) -> whether ``records`` has a quoted field open at its end."""
    d = re.escape(delimiter)
    closed = re.compile(rf'(?:(?:"{inside(backslash, False)}"[^{d}\r\n]*+|(?!")[^{d}\r\n]*+)[{d}\r\n])*+', re.S)

    def step(line: str, is_open: bool) -> bool:
        line = f'"{line}\n' if is_open else f"{line}\n"
        return closed.match(line).end() < len(line)

    return step


def records(text: str, delimiter: str, backslash: bool) -> Iterator[tuple[int, list[str]]]:
    """(characters consumed, fields) of each record; lines without a character are none."""
    d = re.escape(delimiter)
    one = re.compile(rf'(?:"({inside(backslash, False)})(?:"|\Z)([^{d}\r\n]*)|([^{d}\r\n]*))({d}|\r\n|\r|\n|\Z)', re.S)
    at, fields, n = 0, [], len(text)
    while at < n or fields:
        m = one.match(text, at)
        quoted, tail, plain, end = m.groups()
        if quoted is not None:
            value = quoted.replace('""', '"')
            value = re.sub(r'\\(.)', r"\1", value, flags=re.S) + tail if backslash else value + tail
        else:
            value = plain
        at = m.end()
        if end == delimiter:
            fields.append(value)
            if at >= n:
                fields.append("")
                yield at, fields
                return
            continue
        if fields or value or quoted is not None:
            fields.append(value)
            yield at, fields
        fields = []


def blank(fields: list[str]) -> bool:
    return not any(f.strip(" \t") for f in fields)


@dataclass
class Sample:
    delimiter: str
    backslash: bool
    width: int
    rows: list[list[str]]
    score: tuple[int, int, int]


#: For each delimiter and escape mode, whether the quotes of the whole file fit it.
Fits = dict[tuple[str, bool], bool]


def sample(text: str, delimiter: str, backslash: bool, fits: Fits | None = None) -> Sample | None:
    """The header and the first records under a delimiter, and how well they fit it.

    ``fits`` tells what the text can't, as it is but the start of a file.
    """
    if not fits[delimiter, backslash] if fits is not None else quote_error(text, delimiter, backslash):
        return None
    header, rows = None, []
    for at, fields in records(text, delimiter, backslash):
        if header is None:
            if len(fields) == 1 and blank(fields):
                continue
            header = fields
        elif not blank(fields):
            rows.append(fields)
        if len(rows) >= SAMPLE_RECORDS or at >= SAMPLE_BYTES:
            break
    if header is None:
        return None
    width = len(header)
    shaped = []
    for f in [header, *rows]:
        f = [*f, *[""] * (width - len(f))]
        while len(f) > width and not f[-1].strip(" \t"):
            f.pop()
        shaped.append(f)
    counts = Counter(map(len, shaped))
    fields, often = max(counts.items(), key=lambda x: (x[1], x[0]))
    return Sample(delimiter, backslash, width, shaped, (len(shaped), often, fields))


def detect(data: bytes, side: str, fits: Fits | None = None) -> Dialect:
    """The best-fitting candidate; refused if several fit alike and read differently."""
    data = skip_blank_lines(data)
    if not data:
        raise Refused("E_HEADERS", {"file": side, "issue": "missing_header"})
    text = data.decode("latin-1")
    found = [s for c in CANDIDATES if (s := sample(text, chr(c), False, fits) or sample(text, chr(c), True, fits))]
    if not found:
        raise Refused("E_CSV_PARSE", {"file": side, "line": None, "column": None})
    best = max(s.score for s in found)
    tied = [s for s in found if s.score == best]
    if any(s.rows != tied[0].rows for s in tied[1:]):
        names = [s.delimiter for s in tied]
        raise Refused("E_DIALECT", {"file": side, "tied_delimiters": names, "suggestion": f"--delimiter {delimiter_name(names[0])}"})
    if tied[0].width == 1:
        only = tied[0].delimiter
        raise Refused("E_DIALECT", {"file": side, "tied_delimiters": [s.delimiter for s in tied], "suggestion": f"sep={only}" if 0x21 <= ord(only) <= 0x7E else f"--delimiter {delimiter_name(only)}"})
    return Dialect(tied[0].delimiter, tied[0].backslash)


def delimiter_name(c: str) -> str:
    return next((k for k, v in NAMES.items() if v == c), f"0x{ord(c):02x}")


def escape_mode(data: bytes, delimiter: str, side: str, fits: Fits | None = None) -> Dialect:
    """RFC quoting if the whole input fits it, else backslash escapes, else refused."""
    text = data.decode("latin-1")
    for backslash in (False, True):
        if fits[delimiter, backslash] if fits is not None else not quote_error(text, delimiter, backslash):
            return Dialect(delimiter, backslash)
    raise Refused("E_CSV_PARSE", {"file": side, "line": None, "column": None})


def header_names(fields: list[str], aliases: dict[bytes, bytes], side: str) -> list[bytes]:
    """Trimmed, aliased and unique names; an empty one gets its place as name."""
    out: list[bytes] = []
    for i, f in enumerate(fields, 1):
        name = f.strip(" \t").encode("latin-1") or f"__shiftlens_col_{i}".encode()
        out.append(aliases.get(name, name))
    if repeats := [n for k, n in enumerate(out) if n in out[:k]]:
        raise Refused("E_HEADERS", {"file": side, "issue": "duplicate", "name": repeats[0]})
    return out


def delimiter_is_sep(fields: list[str], sep: str, delimiter: str) -> bool:
    """Whether a record is the ``sep=`` line, read under a delimiter."""
    return delimiter.join(fields) == f"sep={sep}"
