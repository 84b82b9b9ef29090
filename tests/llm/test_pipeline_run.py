"""The pipeline from documents to copies, against its stages' operators called one by one."""

import hashlib
import math
from collections import Counter

import corpus_pipeline
import numpy as np
from strandforge.llm import decontaminate, language, pii, simhash


def test_run_keeps_what_every_stage_keeps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = [(r.doc_id, r._copy) for r in corpus_pipeline.run(spark, sf).select("doc_id", "_copy").collect()]
    known = {r.doc_id for r in language.identify_language(docs).collect() if r.lang_pred != "und"}
    some = docs.filter(docs.doc_id.isin(list(known)))
    heads = {r.component_id for r in simhash.simhash_groups(some).collect()}  # the least id of each group stays
    leaked = {r.doc_id for r in decontaminate.find_leaks(some.filter(some.doc_id.isin(list(heads))), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    copies = {}
    for d, c in got:
        copies.setdefault(d, []).append(c)
    assert copies and set(copies) <= heads - leaked
    assert all(sorted(c) == list(range(len(c))) for c in copies.values())
    # a mean of about one copy: Poisson leaves out about e^-1 of the documents
    assert 0.4 < len(copies) / len(heads - leaked) < 0.9


def test_run_is_every_stage_recomputed(spark, sf):
    """All rows of run(): kept ones by union-find over all pairs and by alignment with whole texts, masks by span, copies by summed Poisson terms."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    told = language.identify_language(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert {r.doc_id for r in told if r.lang_pred == "und"} == {i for i, r in docs.items() if not any(c.isalpha() for c in r.text or "")}
    some = sorted(r.doc_id for r in told if r.lang_pred != "und" and r.score >= 0.5)
    prints = {i: simhash.fingerprint(docs[i].text) & (2**64 - 1) for i in some}
    root = {i: i for i in some}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(some):
        for j in some[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    heads = [i for i in some if find(i) == i]
    items = [decontaminate.tokens(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = lambda ws, n: {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}
    numbers: dict = {}
    ids = lambda ws: np.array([numbers.setdefault(w, len(numbers)) for w in ws])

    def leaks(text):
        words = decontaminate.tokens(text)
        own = grams(words, 3)
        return any(own & grams(x, 3) and decontaminate.smith_waterman(ids(x), ids(words))[0] >= len(x) for x in items)

    clean = [i for i in heads if not leaks(docs[i].text)]
    assert 0 < len(clean) < len(heads) < len(some)

    def masked(text):
        out, at = "", 0
        for kind, s, e in sorted(pii.find_pii(text)[1], key=lambda x: (x[1], -x[2])):
            out += (text[at:s] + f"<{kind}>") if s >= at else ""
            at = max(at, e)
        return out + text[at:]

    size = Counter(docs[i].source for i in clean)
    want = Counter()
    for i in clean:
        d = docs[i]
        mean, u = len(clean) / len(size) / size[d.source], int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:13], 16) / 16**13
        n, total = 0, math.exp(-mean)
        while total <= u:
            n += 1
            total += math.exp(-mean + n * math.log(mean) - math.lgamma(n + 1))
        text = masked(d.text)
        for copy in range(n):
            want[i, d.source, d.lang, text, d.n_chars if text == d.text else len(text), copy] += 1
    got = Counter((r.doc_id, r.source, r.lang, r.text, r.n_chars, r._copy) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want
    assert any("<email>" in k[3] for k in want)
