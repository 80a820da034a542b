import hashlib
import re
from collections import defaultdict
from math import floor

from shiftlens.llm import mixing, url_filter


def plain_mix(rows, weights=(5, 2, 1), share=1.5, cap=2.0):
    size = lambda t: len(re.findall(mixing.WORD, t or ""))
    total = defaultdict(int)
    for _, s, t in rows:
        total[s] += size(t)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, target = share * sum(total.values()), set(order), dict.fromkeys(order, 0.0)
    while open_:
        full = {s for s in open_ if left * w[s] / sum(w[x] for x in open_) > cap * total[s]}
        if not full:
            target |= {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
            break
        for s in full:
            target[s] = cap * total[s]
        left -= sum(target[s] for s in full)
        open_ -= full
    out, before = [], defaultdict(int)
    key = lambda r: (hashlib.md5(f"mix:{'' if r[0] is None else r[0]}:{hashlib.md5((r[2] or '').encode()).hexdigest()}".encode()).hexdigest(), r[0] or 0, size(r[2]))
    for i, s, t in sorted(rows, key=key):
        n, budget = size(t), floor(target[s] + 1e-9)
        epochs = budget // max(1, total[s])
        out.append((i, n, total[s], epochs * n + min(n, max(0, budget - epochs * total[s] - before[s]))))
        before[s] += n
    return out, target


def test_mix_equals_brute_force(spark):
    rows = [(i, ["a", "b", "c", "d", None, "é"][min(5, i % 11)], "w " * (i * 7 % 23)) for i in range(300)]
    rows += [(1000, "empty", None), (1001, "empty", ""), (1001, "empty", ""), (None, "a", "x y\x0bz")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, _range int")
    got = mixing.mix_sources(docs).collect()
    want, target = plain_mix(rows)
    assert sorted(((r.doc_id, r["size"], r.source_size, r.taken) for r in got), key=str) == sorted(want, key=str)
    assert all(abs(r.target - target[r.source]) < 1e-6 and r.taken <= 2 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(5)).collect()))


def test_rows_that_share_an_id_are_spread_and_ties_are_settled(spark):
    rows = [(None, "a", f"{'w ' * (i % 5 + 1)}{i}", "en") for i in range(400)] + [(1, "a", "same words here", lang) for lang in ("en", "de", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, lang string")
    first = sorted(map(str, mixing.mix_sources(docs, share=0.5, keep=("text", "lang")).collect()))
    assert first == sorted(map(str, mixing.mix_sources(docs.repartition(7, "lang", "text"), share=0.5, keep=("text", "lang")).collect()))
    want, _ = plain_mix([r[:3] for r in rows], share=0.5)
    assert sorted((r["size"], r.taken) for r in mixing.mix_sources(docs, share=0.5).collect()) == sorted((w[1], w[3]) for w in want)


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix_sources(empty).count() == 0
    silent = spark.createDataFrame([(1, "a", None), (2, None, " ")], "doc_id long, source string, text string")
    assert [(r.target, r.taken) for r in mixing.mix_sources(silent).collect()] == [(0.0, 0), (0.0, 0)]


def plain_url(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, default))
    return host, path, rule, verdict


def test_urls_equal_brute_force(spark):
    rules = [*url_filter.RULES, ("b.com", "/", "block"), ("a.b.com", "/x", "allow"), ("a.b.com", "/", "block"), ("é.com", "/", "block"), ("a.b.com", "/", "allow"), ("b.com", "", "block")]
    hosts = ["com", "a.com", "b.com", "a.b.com", "c.a.b.com", "ab.com", "example.com", "WWW.Example.com", "m.example.com", "x.net", "net", "é.com", "ü.é.com", "", "a..com", "com.", "İ.com", "b.com:80"]
    paths = ["", "/", "/en/", "/en", "/es/q?x#y", "/fr/", "?a/en/", "#/en/", "/x/y", "/en/\nz"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme/en/", "://", "a://b://c/d"]
    pages = spark.createDataFrame([(i % 150, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = sorted(map(str, (tuple(r) for r in url_filter.judge_urls(pages, url_filter.rules_frame(spark, rules)).collect())))
    assert got == sorted(str((i % 150, *plain_url(u, rules))) for i, u in enumerate(urls))
    deep = [(".".join(f"l{i}" for i in range(n, 0, -1)), "/" if n % 3 else "/x", "block" if n % 2 else "allow") for n in range(1, 13)]
    some = [(i, f"http://{'s.' * (i % 2)}{h}/{'x' * (i % 3)}") for i, (h, _, _) in enumerate(deep * 4)] + [(100 + i, f"http://n{i}.l2.l1/") for i in range(40)]
    got = sorted(map(str, (tuple(r) for r in url_filter.judge_urls(spark.createDataFrame(some, "page_id long, url string"), url_filter.rules_frame(spark, deep)).collect())))
    assert got == sorted(str((i, *plain_url(u, deep))) for i, u in some)
    none = url_filter.judge_urls(pages, url_filter.rules_frame(spark, ()), default="block").collect()
    assert len(none) == len(urls) and all(r.rule is None and r.verdict == "block" for r in none)
    assert url_filter.judge_urls(pages.limit(0), url_filter.rules_frame(spark)).count() == 0
