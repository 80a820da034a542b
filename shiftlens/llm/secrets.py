"""Secret scans: fixed patterns, plus sliding-window entropy over long strings.

Three base kinds are found by pattern. Beyond them, every candidate string (a run of
base64 characters) is swept by a window whose character counts, and so whose Shannon
entropy, are updated by one character in and one out. The terms are scaled integers, so
their running sum is exact however long the string. The character class of the
candidate (hex, lower- or upper-case alphanumeric, mixed) sets the entropy it has to
reach. Windows over the bound that touch join into one span. Allow-listed strings
(UUIDs, paths, words in a word's case, numbers) are suppressed, as are spans that hold
a placeholder or that a base match covers.

Rows are independent: no shuffle, one pass, memory bounded by a batch and one text.
Defined results: null or empty text gives zero counts, the digest of the empty string
and empty spans; repeated rows repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "entropy")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Bits that a window of 20 characters must reach, by the candidate's class.
BITS = (("hex", re.compile(r"[0-9a-fA-F]+"), 3.1), ("lower", re.compile(r"[0-9a-z]+"), 3.6), ("upper", re.compile(r"[0-9A-Z]+"), 3.6), ("mixed", re.compile(r".*", re.S), 3.9))
ALLOWED = tuple(
    re.compile(p)
    for p in (
        r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # UUID
        r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[-_/](?:[A-Z]?[a-z]+|[A-Z]+))*",  # words, with joints
        r"[a-z]*(?:[A-Z][a-z]{2,})+",  # words, joined by their capitals
        r"[-+/_=0-9]+",  # numbers and rules
        r"(?:/?[A-Za-z][a-z]*/)+[A-Za-z0-9_-]{0,12}",  # paths
    )
)
PLACEHOLDER = re.compile("EXAMPLE|example|placeholder|XXXX|xxxx|0000000|1234567")
#: c * log2(c) for a count in a window, in whole units of 2 ** -40.
UNIT = 1 << 40
TERM = [0, *(round(c * math.log2(c) * UNIT) for c in range(1, WINDOW + 1))]
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def hot_windows(s: str, bound: float) -> list[tuple[int, int]]:
    """Merged (start, end) of the windows of ``s`` that reach ``bound`` bits."""
    need = round((math.log2(WINDOW) - bound) * WINDOW * UNIT) + WINDOW  # entropy = log2(n) - sum(c log c) / n; each term is rounded
    counts: dict[str, int] = {}
    total, spans = 0, []
    for i, c in enumerate(s):
        if i >= WINDOW:
            old = s[i - WINDOW]
            n = counts[old]
            counts[old] = n - 1
            total += TERM[n - 1] - TERM[n]
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += TERM[n + 1] - TERM[n]
        if i >= WINDOW - 1 and total <= need:
            start = i - WINDOW + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches; offsets in code points."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def entropy_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        s, at = m.group(), m.start()
        if any(p.fullmatch(s) for p in ALLOWED):
            continue
        bound = next(b for _, p, b in BITS if p.fullmatch(s))
        hot = [(a, b) for a, b in hot_windows(s, bound) if not PLACEHOLDER.search(s, a, b)]
        out += [(at + a, 3, at + b) for a, b in hot if not any(x <= at + a and at + b <= y for x, _, y in base)]
    return out


def scan(text: str | None) -> tuple[int, int, int, str, str]:
    text = text or ""
    longest = max(map(len, text.split()), default=0)
    base = base_spans(text) if longest >= 16 or any(c in text for c in ":=") else []
    more = entropy_spans(text, base) if longest >= WINDOW else []
    say = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
    n = [sum(k == i for _, k, _ in base) for i in range(3)]
    return (*n, hashlib.sha256(say(base).encode()).hexdigest(), say(sorted(base + more)))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans, a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t.as_py()) for t in batch.column(1)]
            cols = list(zip(*found, strict=True)) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, SCHEMA)
