"""Periodic runs and URL filters against brute force, with odd rows, hot hosts and planted cases."""

import hashlib
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from strandforge.llm import queries, runs, url_filter


def plain_runs(t, exponent, shortest):
    """Every period tried at every place."""
    out, n = set(), len(t)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and t[j] == t[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(shortest, exponent * q):
                w = t[i : i + length]
                if not any(all(w[x] == w[x + d] for x in range(length - d)) for d in range(1, q)):
                    out.add((i, length, q))
            i = j + 1
    return sorted(out)


def plain_edges(t):
    out = []
    for i in range(len(t)):
        j = i + 1
        while j < len(t) and t[j:] >= t[i:]:
            j += 1
        k = 0
        while j + k < len(t) and t[i + k] == t[j + k]:
            k += 1
        out.append((j, k))
    return out


def word_lists(number, longest=40):
    rng = random.Random(3)
    for _ in range(number):
        n, k = rng.randint(0, longest), rng.choice([1, 2, 2, 3, 4])
        if rng.random() < 0.5:
            t, root = [], [rng.randrange(k) for _ in range(rng.randint(1, 8))]
            while len(t) < n:
                t += root if rng.random() < 0.8 else [rng.randrange(k)]
            yield t[:n]
        else:
            yield [rng.randrange(k) for _ in range(n)]


def test_lyndon_edges_are_the_next_smaller_suffixes():
    for t in word_lists(4000):
        nxt, common = runs.lyndon_edges(t)
        assert list(zip(nxt, common, strict=True)) == plain_edges(t), t


def test_runs_are_those_of_every_period_and_place():
    for t in word_lists(4000):
        for exponent, shortest in ((2, 1), (3, 6), (4, 6)):
            assert runs.word_runs(t, exponent, shortest) == plain_runs(t, exponent, shortest), t


def test_runs_take_linear_time():
    fib, last = [0, 1], [0]
    while len(fib) < 200_000:
        fib, last = fib + last, fib
    for t in ([0] * 200_000, [0, 1] * 100_000, fib[:200_000], ([0] * 447 + [1]) * 447):
        began = time.time()
        runs.lyndon_edges(t)
        assert time.time() - began < 5
    assert runs.word_runs([0, 1] * 100_000) == [(0, 200_000, 2)]


def test_query_of_runs_is_brute_force_over_the_table(spark, sf):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    some = 0
    for doc_id, text in docs:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 3000:
            continue  # quadratic here; the planted cases below are long
        found = plain_runs(words, 4, 6)
        some += bool(found)
        drop = {i for s, m, q in found for i in range(s + q, s + m)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want = (len(found), *best, None if best[2] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))
        assert got[doc_id] == want, doc_id
    assert some > 10


def test_runs_of_odd_rows(spark):
    table = [(1, None), (2, ""), (3, " \t\n"), (None, "a a a a a a b"), (4, "a a a a a b"), (5, "x " + "é ü\n" * 5000 + "y"), (5, "x " + "é ü\n" * 5000 + "y"), (6, "no run here")]
    docs = spark.createDataFrame([(*r, "z", [1]) for r in table], "doc_id long, text string, starts string, lengths array<int>")
    got = sorted((str(r.doc_id), r.n_words, r.starts, r.lengths, r.periods, r.collapsed) for r in runs.find_runs(docs).collect())
    assert got == sorted([
        ("1", 0, [], [], [], ""), ("2", 0, [], [], [], ""), ("3", 0, [], [], [], ""), ("None", 7, [0], [6], [1], "a b"), ("4", 6, [], [], [], "a a a a a b"),
        ("5", 10_002, [1], [10_000], [2], "x é ü y"), ("5", 10_002, [1], [10_000], [2], "x é ü y"), ("6", 3, [], [], [], "no run here"),
    ])
    assert runs.longest_run(runs.find_runs(docs.limit(0))).count() == 0
    one = {r.doc_id: r for r in runs.longest_run(runs.find_runs(docs)).collect()}
    assert one[None][1:6] == (1, 0, 6, 1, 6000)
    assert one[6][2:6] == (None, None, None, None)
    assert one[6].runs_sha256 == hashlib.sha256(b"").hexdigest()


def test_overlapping_runs_drop_a_word_once(spark):
    words = "a a a a a a a b a a a a a a a b a a a a a a a b a a a a a a a b".split()
    found = runs.word_runs(words)
    assert found == plain_runs(words, 4, 6)
    assert {q for _, _, q in found} == {1, 8}
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    assert runs.collapse(words, found) == [w for i, w in enumerate(words) if i not in drop]


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        ("https://A.Example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/"),
        ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1"),
        ("http://notexample.org/en/12", "notexample.org", "/en/12", "org/"),
        ("http://b.com/fr/", "b.com", "/fr/", "com/fr/"),
        ("http://b.com/de/x", "b.com", "/de/x", "com/de/"),
        ("http://b.com/de", "b.com", "/de", None),
        ("http://b.org", "b.org", "", None),
        ("http://b.org?q=/", "b.org", "", None),
        ("http://bcom/fr/x", "bcom", "/fr/x", None),
        ("x://y://z.org/a", "y:", "//z.org/a", None),
        ("no scheme.org/es/", "", "", None),
        ("", "", "", None),
        (None, "", "", None),
        ("http://É.ORG/#/a", "É.org", "/", "org/"),
    ],
)
def test_hosts_paths_and_rules(spark, url, host, path, rule):
    r = url_filter.judge_urls(spark.createDataFrame([(1, url)], "page_id long, url string")).first()
    assert (r.host, r.path, r.rule) == (host, path, rule)
    if rule is not None:
        assert r.verdict == {h + p: v for h, p, v in url_filter.RULES}[rule]


def test_templates_learn_from_their_labels(spark):
    """A host whose labelled shop pages are all blocked and whose news are allowed; its unlabelled pages follow their template."""
    rules = [("h.x", f"/shop/{k}", "block") for k in range(1, 6)] + [("h.x", f"/news/{k}", "allow") for k in range(1, 6)]
    pages = [(i, f"http://h.x/shop/{i}") for i in range(1, 80)] + [(1000 + i, f"http://h.x/news/{i}.html") for i in range(1, 80)] + [(5000 + i, f"http://other.x/shop/{i}") for i in range(1, 30)]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), rules).collect()}
    assert len(got) == len(pages)
    assert (got[12].rule, got[67].rule) == ("h.x/shop/1", None)
    unlabelled = [r for r in got.values() if r.rule is None]
    assert {r.verdict for r in unlabelled if r.host == "h.x" and r.path.startswith("/shop/")} == {"block"}
    assert {r.verdict for r in unlabelled if r.path.startswith("/news/")} == {"allow"}
    assert {r.verdict for r in unlabelled if r.host == "other.x"} == {"allow"}


def test_varying_words_and_alike_branches_become_wildcards(spark):
    pages = [(i, f"http://h.x/tag/word{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(300)] + [(1000 + i, f"http://h.x/{lang}/{i}") for i in range(40) for lang in ("en", "fr")] + [(2000 + i, "http://h.x/about") for i in range(40)]
    got = {(r.path, r.template) for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    assert {t for p, t in got if p.startswith("/tag/")} == {"/tag/*"}
    assert {t for p, t in got if p == "/about"} == {"/about"}
    deep = spark.createDataFrame([(1, "http://h.x/a/b/c/d/e"), (2, "http://h.x/" + "a/" * 50_000), (3, "http://h.x/0123456789abcdef-0123")], "page_id long, url string")
    assert {r.page_id: r.template for r in url_filter.judge_urls(deep, wide=100).collect()}[1].endswith("/**")


def test_urls_odd_rows_and_equal_to_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(5)
    hosts = ["hot.example.com"] * 5 + ["a.com", "b.example.org", "c.net", "d.com", "e.net"]
    urls = [f"https://{rng.choice(hosts)}/{rng.choice(['en', 'fr', 'de', 'es', 'about', 'tag' + str(rng.randrange(9)), 'w' + chr(97 + rng.randrange(26))])}/{rng.choice(['', str(rng.randrange(99)), 'x.html', 'p/q/r/s', 'slug-' + chr(97 + rng.randrange(26))])}" for _ in range(3000)]
    pages = [(i, u, "x", "y") for i, u in enumerate([*urls, None, "", "http://", "://a", "http://h/<n>/*/**", urls[0]])] + [(None, urls[1], "x", "y"), (None, urls[1], "x", "y")]
    table = spark.createDataFrame(pages, "page_id long, url string, host string, template string")
    got = url_filter.judge_urls(table)
    cols = sorted(got.columns)
    table.write.parquet(str(tmp_path / "p"))
    con = duckdb.connect()
    con.execute(f"create view pages as select page_id, url from '{tmp_path}/p/*.parquet'")
    want = con.sql(f"select {', '.join(cols)} from ({url_filter.judge_sql()})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(*cols).collect())
    assert len(want) == len(pages)
    assert {r.verdict for r in got.collect()} == {"allow", "block"}
    assert url_filter.judge_urls(table.limit(0)).count() == 0


def test_url_query_equals_its_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    got = queries.op12_url_filter(spark, sf)
    cols = sorted(got.columns)
    assert sorted(map(str, con.sql(f"select {', '.join(cols)} from ({queries.ORACLES['op12_url_filter']})").fetchall())) == sorted(str(tuple(r)) for r in got.select(*cols).collect())
    assert got.filter(F.col("host").isNull() | F.col("path").isNull() | F.col("verdict").isNull()).count() == 0
