import hashlib
import math
import random
import re

from shiftlens.llm import secrets


def plain(text):
    """The base rules as written: match, then drop what is too short."""
    rules = [
        (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
        (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    ]
    return sorted((m.start(), k, m.end()) for k, (rx, ok) in enumerate(rules) for m in rx.finditer(text) if ok(m))


def test_base_spans_equal_the_plain_rules():
    rng = random.Random(3)
    bits = ["password", "Secret", "token", "API_KEY", "apikey", ":", "=", " ", '"', "'", "AKIA", "AKIA0123456789ABCD", "deadbeef", "0123456789abcdef" * 2, "x", "é", "ſecret", "\n", "abcdefgh", "ABC12345", "."]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert secrets.base_spans(text) == plain(text), repr(text)


def test_windows_equal_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        s = "".join(rng.choice("abcdefABCDEF0123456789+/xyz") for _ in range(rng.randint(20, 60)))
        hot = set()
        for i in range(len(s) - secrets.WINDOW + 1):
            w = s[i : i + secrets.WINDOW]
            if -sum(c / 20 * math.log2(c / 20) for c in map(w.count, set(w))) >= 3.7 - 1e-9:
                hot |= set(range(i, i + secrets.WINDOW))
        got = {k for a, b in secrets.hot_windows(s, 3.7) for k in range(a, b)}
        assert got == hot


def test_entropy_adds_spans_and_allow_list_suppresses():
    key = "q7Zp2Lk9Xv4Bn8Rt1Wm6Yc3"
    n = secrets.scan(f"see {key} there")
    assert n[:3] == (0, 0, 0) and n[4] == f"entropy:4:{4 + len(key)}"
    assert n[3] == hashlib.sha256(b"").hexdigest()
    for fine in ("123e4567-e89b-12d3-a456-426614174000", "internationalisation-of-everything", "usr/local/share/something", "0987654321-0987654321-0987654321", "EXAMPLE" + key):
        assert secrets.scan(f"see {fine} there")[4] == ""


def test_sums_stay_exact_over_a_very_long_string():
    rng = random.Random(5)
    s = "".join(rng.choices("abcdefABCDEF0123456789+/xyz", k=400_000))
    for bound in (3.6, 3.9):
        at = 399_000
        want = [(a + at, b + at) for a, b in secrets.hot_windows(s[at:], bound)]
        assert [x for x in secrets.hot_windows(s, bound) if x[0] > at + 20] == [x for x in want if x[0] > at + 20]


def test_only_the_span_with_a_placeholder_is_suppressed():
    key = "q7Zp2Lk9Xv4Bn8Rt1Wm6Yc3"
    calm = "a" * 30
    assert secrets.scan(f"{key}{calm}EXAMPLE{calm}")[4].startswith("entropy:0:")
    assert secrets.scan("see qZpLkXvBnRtWmYcFhJdGsTa there")[4]  # letters only, but no word's case
    assert not secrets.scan("see getElementsByClassNameAndValue there")[4]


def test_query_edge_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "password = hunter2hunter2"), (3, "password = hunter2hunter2"), (None, "z" * 300_000)], "doc_id long, text string")
    got = {tuple(r) for r in secrets.scan_secrets(docs).collect()}
    span = "assign:0:25"
    assert got == {
        (1, 0, 0, 0, hashlib.sha256(b"").hexdigest(), ""),
        (2, 0, 0, 0, hashlib.sha256(b"").hexdigest(), ""),
        (3, 1, 0, 0, hashlib.sha256(span.encode()).hexdigest(), span),
        (None, 0, 0, 0, hashlib.sha256(b"").hexdigest(), ""),
    }
    assert secrets.scan_secrets(docs.limit(0)).count() == 0
