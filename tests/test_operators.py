"""Frames, rules, retrieval, conservation, curation and evaluation on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandforge.functions import seq
from strandforge.operators import conservation, curation, evaluate, index, orf, rank, rules, similarity, viewer
from strandforge.plans import pipeline


def window(spark, *seqs):
    return spark.createDataFrame([(f"r{i}", s, 0) for i, s in enumerate(seqs)], "record_id string, sequence string, window_start int")


def plain_orfs(s, lo, hi):
    out = set()
    flip = s[::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca"))
    for strand, own in (("+", s), ("-", flip)):
        up = own.upper()
        for i in range(len(up) - 2):
            if up[i : i + 3] in ("ATG", "GTG", "TTG"):
                stop = next((j for j in range(i + 3, len(up) - 2, 3) if up[j : j + 3] in ("TAA", "TAG", "TGA")), None)
                if stop is not None and lo <= (stop - i) // 3 <= hi:
                    a, b = (i, stop) if strand == "+" else (len(s) - stop, len(s) - i)
                    out.add((strand, i % 3 if strand == "+" else -(i % 3 + 1), a, b, own[i:stop]))
    return out


@pytest.mark.parametrize("tile", [30, 1200])
def test_frames_equal_a_plain_scan(spark, tile):
    rng = random.Random(3)
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (0, 2, 3, 29, 30, 31, 500, 2500)] + ["".join(rng.choice("acgtN") for _ in range(300))]
    got = {}
    for r in orf.orfs(window(spark, *seqs), 3, 40, tile).collect():
        got.setdefault(r.record_id, set()).add((r.strand, r.frame, r.genomic_start, r.genomic_end, r.dna))
    for i, s in enumerate(seqs):
        assert got.get(f"r{i}", set()) == plain_orfs(s, 3, 40)


def test_nested_starts_share_a_stop(spark):
    found = orf.orfs(window(spark, "ATGGGGGGGGTGGGGGGGTAG"), 3, 120, strands=("+",)).collect()
    assert {r.start_codon for r in found} == {"ATG", "GTG"} and len(found) == 2
    (one,) = orf.orfs(window(spark, "ATGAAATAA"), 2, 3, strands=("+",)).collect()
    assert (one.genomic_start, one.genomic_end) == (0, 6)


def test_windows_and_ids(spark):
    s = spark.createDataFrame([("a", "ACGTACGTAC", [(2, 6)], "x"), ("b", "ACGTACGTAC", [(2, 6)], "product"), ("c", "ACGT", None, None)], "record_id string, sequence string, region_ranges array<struct<start:int,end:int>>, region_source string")
    assert [(r.record_id, r.window_start, r.sequence) for r in orf.windows_of(s).orderBy("record_id").collect()] == [("a", 2, "GTAC"), ("b", 0, "ACGTACGTAC"), ("c", 0, "ACGT")]
    assert orf.windows_of(s, True).filter("record_id = 'b'").first().window_start == 2
    ids = spark.createDataFrame([(1, "rec"), (2, " rec "), (3, None), (4, "rec")], "index int, record_id string")
    assert [r.record_id for r in orf.dedupe_record_ids(ids).orderBy("index").collect()] == ["rec", "rec__2", "segment_3", "rec__3"]
    f = spark.createDataFrame([("g", "r", 1, "region", ["Knot"], 0, 5), ("g", "r", 2, "region", ["knot"], 5, 5), ("g", "r", 3, "cluster", ["knotpeptide"], 5, 9), ("g", "r", 4, "CDS", ["knot"], 5, 9)], "gbk_file string, record_id string, ordinal int, type string, products array<string>, start int, end int")
    assert [(r.region_index, r.region_start) for r in orf.indexed_regions(f, "knot").orderBy("region_index").collect()] == [(1, 0), (2, 5)]


def score(spark, leader, core, names, inverted=False):
    rule_set = rules.ruleset()
    rule_set |= {
        "leader_length": {"enabled": True, "weight": 0.7, "parameters": {"min": 10, "max": 30}},
        "leader_motifs": {"enabled": True, "weight": 0.6, "parameters": {"motifs": ["TQ", "PL"]}},
        "glycine_rich_core": {"enabled": True, "weight": 0.5, "parameters": {"min_ratio": 0.3}},
        "tail_lock_residue": {"enabled": True, "weight": 0.9, "parameters": {"region_start": 4, "residues": ["F", "W"], "require_at_least": 2}},
        "forbidden_core_patterns": {"enabled": True, "weight": 2.0, "parameters": {"patterns": ["PP", "CC"], "penalty_per_match": -1.5}},
    }
    s = core + leader if inverted else leader + core
    df = spark.createDataFrame([(s, len(core if inverted else leader))], "sequence string, position int")
    got = rules.score_sites(df, rule_set, inverted).first()
    return [got.score_breakdown.get(n) for n in names]


def test_rules_one_by_one(spark):
    lead = "M" * 10 + "TA"
    assert score(spark, lead, "G" + "A" * 15, ["core_start", "leader_penultimate", "core_length", "glycine_rich", "forbidden_pattern"]) == pytest.approx([1.2, 1.0, 1.0, None, None])
    assert score(spark, lead, "PAAAAAADAAAAAAFFAA", ["core_start", "ring_closure", "steric_lock", "tail_lock"]) == pytest.approx([-1.6, 4.95, 1.0, 0.9])
    assert score(spark, lead, "AAAAAAAAAAAAAAAA", ["ring_closure", "steric_lock"]) == [-22.5, None]
    assert score(spark, "M" * 9 + "G", "GPPA" + "G" * 12, ["cleavage_motif", "forbidden_pattern", "glycine_rich", "leader_length"]) == pytest.approx([0.48, -3.0, 0.5, 0.7])
    assert score(spark, "YAAPALTQ", "GAAA", ["leader_signature", "leader_motif", "leader_length", "core_length"]) == pytest.approx([1.2, 0.6, -0.7, -1.0])
    assert score(spark, "K" * 12, "D" * 12, ["charge_transition"]) == pytest.approx([0.4])
    assert score(spark, "GAAAAAAAAAA", "A" * 15 + "G", ["cleavage_motif", "leader_penultimate", "leader_motif"], inverted=True) == pytest.approx([0.48, None, None])
    assert score(spark, "", "G" * 14, ["cleavage_motif", "charge_transition", "hydrophobicity", "leader_signature"]) == [None] * 4


def test_prediction_known_and_edge_cases(spark):
    rows = [("a", "MKKVYEAPTLVRLGSFRKQTGLLGRSGNDRLILSKN"), ("k", "K" * 60), ("short", "MK"), ("low", " mkkvyeaptlvrlgsfrkqtgllgrsgndrlilskn ")]
    got = {}
    for r in rules.predict(spark.createDataFrame(rows, "id string, sequence string"), "id").orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r)
    assert got["a"][0].core == "LLGRSGNDRLILSKN" and round(got["a"][0].score, 2) == 10.18 and got["a"][0].confidence == "high"
    assert [r.score for r in got["a"]] == sorted((r.score for r in got["a"]), reverse=True)
    assert got["k"][0].confidence == "low" and "short" not in got and got["low"][0].core == got["a"][0].core
    given = rules.score_given_cores(spark.createDataFrame([("a", rows[0][1], "LLGRSGNDRLILSKN"), ("b", rows[0][1], "WWW")], "name string, sequence string, core string")).orderBy("name").collect()
    assert (given[0].core_rank, given[0].core_rank_total, given[0].core_positions) == (1, 17, [21]) and given[1].core_score is None


def test_rule_sets(tmp_path):
    base = rules.ruleset()
    assert rules.ruleset("strict")["core_length"]["parameters"]["min"] == 13 and base["core_length"]["parameters"]["min"] == 10
    changed = rules.update_rule(base, "core_length", enabled=False, parameters={"max": 50})
    assert base["core_length"]["enabled"] and changed["core_length"]["parameters"]["max"] == 50
    at = str(tmp_path / "r.json")
    rules.save_rules(changed, at)
    assert rules.load_rules(at) == changed and rules.load_rules(at + "x") == base
    with pytest.raises(KeyError):
        rules.update_rule(base, "nothing")


def test_retrieval(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "candidate_id long, embedding array<double>")
    r = spark.createDataFrame([("x", "L1", 0, [0.9, 0.1]), ("y", "L1", 1, [0.0, 1.0]), ("z", "L2", 2, [0.9, 0.1])], "ref_id string, locus string, ref_ord long, embedding array<double>")
    for block in (1, 100):
        got = {x.candidate_id: x for x in similarity.score_candidates(q, r, 2, block).collect()}
        assert got[1].best_match_id == "x" and got[2].best_similarity == 0.0 and got[2].best_match_id == "x"
    g = spark.createDataFrame([(1, "L1", 0.9), (1, "L2", 0.4)], "candidate_id long, locus string, similarity double")
    assert [similarity.top_n_mean(g, n).first()[1] for n in (0, 1, 2, 9)] == pytest.approx([0.9, 0.9, 0.65, 0.65])


def test_ranking(spark):
    s = spark.createDataFrame([("r", "a", "M" * 30, 0.9, None, 1), ("r", "b", "M" * 30, 0.1, 0.5, 2), ("r", "c", "M" * 30, 0.2, None, 3)], "record_id string, candidate_id string, protein string, best_similarity double, top_n_mean_similarity double, ord int")
    order = lambda **k: [r.candidate_id for r in rank.rank_candidates(s, **k).orderBy("rank").collect()]
    assert order() == ["b", "a", "c"] and order(mode="best_similarity") == ["a", "c", "b"]
    assert order(min_rule_score=50.0) == []
    z = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "z_score double")
    assert [r[0] for r in rank.by_z(z).collect()][:2] == [3.0, 1.0]
    e = spark.createDataFrame([("c", 2, 10.0, 1, "a"), ("c", 2, 12.0, 1, "b"), ("c", 1, 10.0, 1, "c"), ("d", 0, None, 0, "a")], "case_id string, match_count int, median_distance double, locus_span int, gbk_path string").withColumns({"record_id": F.lit(""), "start": F.lit(0), "end": F.lit(0)})
    got = {(r.case_id, r.gbk_path): (r.locus_rank, r.ambiguous) for r in rank.rank_loci(e, 5).collect()}
    assert got == {("c", "a"): (1, True), ("c", "b"): (2, True), ("c", "c"): (3, False), ("d", "a"): (1, False)}


def identity(spark, peptides):
    df = spark.createDataFrame([(1, p) for p in peptides], "g int, peptide string")
    row = conservation.pairwise_identity(df, ["g"]).first()
    return row and row.identity


def test_conservation(spark):
    assert identity(spark, ["MAG", "MAR"]) == pytest.approx(2 / 3)
    assert identity(spark, ["AAAA", "AAAAZZ"]) == 1.0 and identity(spark, ["AA", "AA", "AB"]) == pytest.approx((1 + 0.5 + 0.5) / 3)
    assert identity(spark, ["AAA"]) is None and identity(spark, []) is None
    cds = spark.createDataFrame([("f", "r", 0, 12, "-", "1", "ATGAAACCCGGG", "g", None, None, None), ("f", "r", 0, 12, "-", "1", "ATGAAACCCGGG", "g", None, None, None), ("f", "r", 3, 12, "+", "2", "AAACCCGGG", " ", "t", None, None)], "gbk_file string, record_id string, start int, end int, strand string, codon_start string, genomic string, gene string, locus_tag string, protein_id string, product string")
    got = {r.gene_name: r for r in conservation.gene_instances(cds).collect()}
    assert got["g"].codons == ["CCC", "GGG", "TTT", "CAT"] and len(got) == 2
    assert (got["t"].cds_prefix, got["t"].codons, got["t"].remainder) == ("A", ["AAC", "CCG"], "GG")


def test_shuffle_keeps_protein_and_codons(spark):
    rng = random.Random(9)
    rows = [(i, ["ATG"] + [rng.choice(["GCA", "GCC", "GCG", "TTA", "CTG", "TAA", "AAA"]) for _ in range(rng.randint(0, 30))]) for i in range(20)]
    from strandforge.functions.seq import amino_acid

    df = spark.createDataFrame(rows, "i int, codons array<string>").withColumn("aas", F.transform("codons", lambda c: amino_acid(c, stop="X")))
    out = df.withColumn("s", conservation.shuffled_codons(F.col("codons"), F.col("aas"), F.lit(1), F.col("i"))).withColumn("after", F.transform("s", lambda c: amino_acid(c, stop="X"))).collect()
    assert all(sorted(r.s) == sorted(r.codons) and r.after == r.aas and r.s[0] == r.codons[0] for r in out)
    assert all(b == "TAA" for r in out for a, b in zip(r.codons, r.s, strict=True) if a == "TAA")
    assert any(r.s != r.codons for r in out)


def test_curation(spark):
    d = spark.createDataFrame([(0, "a", "S1", 1), (1, "b", "S2", 2), (2, "c", "S1", 3)], "index long, id string, sequence string, ord int")
    assert sorted(r.id for r in curation.merge_sources([d, d.withColumn("id", F.lit("z"))]).collect()) == ["a", "b"]
    new = spark.createDataFrame([(0, "q", "S9", 1), (1, "r", "S9", 2), (2, "a", "S8", 3), (3, "t", "S1", 4)], "index long, id string, sequence string, ord int")
    assert [r.id for r in curation.append_new(d, new).collect()] == ["q"]
    left = curation.delete_rows(d, F.col("id") == "b")
    assert sorted((r["index"], r.id) for r in left.collect()) == [(0, "a"), (1, "c")]
    assert sorted((r["index"], r.id) for r in curation.insert_rows(left, new.limit(2)).collect()) == [(0, "a"), (1, "c"), (2, "q"), (3, "r")]
    assert curation.search(d, "s2").count() == 1
    t = curation.curated_table(spark.createDataFrame([(" ", "x"), ("p", "y")], "` Name ` string, `ALT` string"), {"name": ["name", "alt"], "gone": ["nope"]})
    assert [tuple(r) for r in t.collect()] == [("x", None), ("p", None)]


def test_index_and_stream(spark, tmp_path):
    from strandforge.streaming import index_stream

    o = spark.createDataFrame([("P", "g1"), ("P", "g1"), ("P", "g2"), ("Q", "g1")], "protein string, gbk_file string")
    got = {r.protein: (r.instance_count, r.genome_count) for r in index.build_index(o).collect()}
    assert got == {"P": (3, 2), "Q": (1, 1)}
    twice = index.merge_genomes(o, o)
    assert twice.count() == 3
    rng = random.Random(5)
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for k in range(2):
        rows = [(f"r{k}{i}", "".join(rng.choice("ACGT") for _ in range(300))) for i in range(4)]
        spark.createDataFrame(rows, index_stream.SEGMENTS).write.mode("append").parquet(src)
        index_stream.run_index_stream(index_stream.segment_stream(spark, src), out, check, min_aa=5).awaitTermination()
    stream = {tuple(r) for r in index_stream.read_index(spark, out).select("protein", "instance_count", "genome_count").collect()}
    records = spark.read.parquet(src).withColumn("gbk_file", F.col("record_id"))
    whole = records.select("gbk_file", "record_id", F.lit(1).alias("ordinal"), F.lit("region").alias("type"), F.array(F.lit("knot")).alias("products"), F.lit(0).alias("start"), F.length("sequence").alias("end"))
    batch = pipeline.index_pipeline(records, whole, "knot", min_aa=5)
    assert stream == {tuple(r) for r in batch.select("protein", "instance_count", "genome_count").collect()}


def test_evaluation_and_viewer(spark):
    s = spark.createDataFrame([("l", 1, 0.9, False, 9.0), ("l", 2, 0.8, True, 5.0), ("l", 3, 0.7, True, 8.0), ("m", 4, 0.5, False, None)], "locus string, candidate_id int, best_similarity double, is_holdout boolean, rule_score double")
    got = {r.locus: r for r in evaluate.holdout_ranks(s, {"rank7": 7.0}).collect()}
    assert (got["l"].rank, got["l"].rank7, got["l"].candidate_count, round(got["l"].top1_top2_gap, 6)) == (2, 2, 3, 0.1)
    assert got["m"].rank is None and got["m"].top1_top2_gap is None
    r = evaluate.recall(evaluate.holdout_ranks(s)).first()
    assert (r.recall_1, r.recall_5) == (0.0, 0.5)
    iv = spark.createDataFrame([("r", "a", 0, 10), ("r", "b", 5, 8), ("r", "c", 6, 20), ("r", "d", 8, 9), ("r", "e", 10, 12)], "record_id string, candidate_id string, start int, end int")
    assert {x.candidate_id: x.lane for x in viewer.pack_lanes(iv, ["record_id"]).collect()} == {"a": 0, "b": 1, "c": 2, "d": 1, "e": 0}


def test_known_precursors_both_ways(spark):
    c = spark.createDataFrame([("MAAACDEFGHIKL",), ("MKK",), ("",)], "protein string")
    r = spark.createDataFrame([("CDEFGHIK",), ("KK",), ("WWWWWWWWWW",), ("",)], "sequence string")
    for most in (5000, 0):
        assert {x.protein: x.is_known_precursor for x in pipeline.mark_known(c, r, most).collect()} == {"MAAACDEFGHIKL": True, "MKK": True, "": False}


def test_missing_score_is_an_error(spark):
    c = spark.createDataFrame([("a",), ("b",)], "candidate_id string")
    s = spark.createDataFrame([("a", 0.5)], "candidate_id string, best_similarity double")
    with pytest.raises(Exception, match="no score for b"):
        pipeline.checked_join(c, s).collect()
    with pytest.raises(ValueError):
        pipeline.Config(score_mode="other")


def test_retrieval_benchmark_against_a_plain_one(spark, sf):
    from strandforge import queries

    docs = spark.createDataFrame(queries.segments(spark, sf).orderBy("doc_id").limit(40).toPandas())
    records = docs.select(F.col("gbk_file").alias("gbk_path"), "record_id", "sequence")
    cds = records.select("gbk_path", "record_id", F.lit(100).alias("start"), F.lit(160).alias("end"), F.concat(F.lit("a"), F.pmod(F.hash("record_id"), F.lit(4)).cast("string")).alias("accession"))
    found = orf.with_protein(orf.orfs(records.withColumn("window_start", F.lit(0)))).select("record_id", "protein").collect()
    acc = {r.record_id: r.accession for r in cds.collect()}
    vec = lambda p: [((len(p) * (k + 3) + ord(p[k % len(p)]) * 7) % 23) / 23 + 0.01 for k in range(6)]
    proteins = sorted({r.protein for r in found})
    longest = {}
    for r in sorted(found, key=lambda r: (len(r.protein), r.protein)):
        longest[r.record_id] = r.protein
    refs = sorted({(acc[i], p) for i, p in longest.items()})
    references = spark.createDataFrame([(a, p, f"r{k}", k, vec(p)) for k, (a, p) in enumerate(refs)], "accession string, sequence string, ref_id string, ref_ord long, embedding array<double>")
    embeddings = spark.createDataFrame([(p, vec(p)) for p in proteins], "protein string, embedding array<double>")
    ranks, held, summary = evaluate.retrieval_benchmark(records, cds, references, embeddings, full_genome=True)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5)
    want = {}
    for i, a in acc.items():
        mine = [r.protein for r in found if r.record_id == i]
        own = {p for b, p in refs if b == a}
        if not own & set(mine):
            continue
        score = [(max(cos(vec(p), vec(q)) for b, q in refs if b != a), p in own) for p in mine]
        top = max(s for s, h in score if h)
        want[i] = (1 + sum(s > top + 1e-9 for s, _ in score), sum(s > top - 1e-9 for s, _ in score), len(mine), sum(h for _, h in score))
    got = {r.locus.split(":")[1]: r for r in ranks.collect()}
    assert set(got) == set(want) and len(want) >= 20
    for i, (low, high, n, h) in want.items():
        assert low <= got[i]["rank"] <= high and got[i].candidate_count == n and got[i].holdout_match_count == h
    s = summary.first()
    assert s.loci == len(want) <= s.loci_total == 40 and 0 <= s.recall_1 <= s.recall_5 <= 1 and s.sequences >= 1
    assert held.count() >= len(want) and {"rank", "rank_rule7", "rank_rule8"} <= set(held.columns)
    assert evaluate.retrieval_benchmark(records, cds, references, embeddings, flank=20, strict=True)[2].first().loci <= len(want)


def test_an_empty_target_set_is_an_error(spark):
    s = spark.createDataFrame([("a", "ACGT" * 40, False)], "record_id string, sequence string, is_target boolean").withColumn("region_ranges", F.lit(None).cast("array<struct<start:int,end:int>>")).withColumn("region_source", F.lit(None).cast("string"))
    with pytest.raises(ValueError, match="no target"):
        pipeline.extract_candidates(s, pipeline.Config(target_only=True))


def test_given_loci_and_frame_mode(spark, sf):
    from strandforge import queries

    hits, cds = queries._hits(spark, sf), queries._cds(spark, sf)
    top = conservation.select_loci(conservation.locus_keys(hits), 2, 3)
    whole = {tuple(r[c] for c in conservation.LOCUS): r for r in conservation.conservation_test(hits, cds, limit=3, iterations=5, seed=1).collect()}
    given = {tuple(r[c] for c in conservation.LOCUS): r for r in conservation.conservation_test(hits, cds, iterations=5, seed=1, loci=top).collect()}
    assert whole == given and len(given) == 3
    unseen = top.withColumn("gene_name", F.lit("no gene"))
    assert conservation.conservation_test(hits, cds, iterations=2, loci=unseen).count() == 0
    raw = spark.createDataFrame([("g", "1", "2", "3", "4", "x"), ("g", "1", "2", "3", "4", "5")], "gene_name string, orf_frame string, gene_start string, gene_end string, orf_start string, orf_end string")
    assert conservation.clean_hits(raw).count() == 1


def test_null_counts_in_parts(spark):
    """Counts sent early, in several blocks and for genes of several lengths give what counts sent once give."""
    rng = random.Random(4)
    bases = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    cds = [("f", f"r{i}", 0, n, "+-"[i % 2], "1", bases(n), "g", None, None, None) for i, n in enumerate([60, 60, 90, 90, 120, 60, 90])]
    cds = spark.createDataFrame(cds, "gbk_file string, record_id string, start int, end int, strand string, codon_start string, genomic string, gene string, locus_tag string, protein_id string, product string")
    loci = spark.createDataFrame([("g", "antisense", "-", -1, 2, 5), ("g", "out_of_frame", "+", 1, 0, 3)], "gene_name string, match_type string, orf_strand string, orf_frame int, bin_first int, bin_last int")
    windows = conservation.locus_windows(loci, conservation.gene_instances(cds))
    # 21 iterations are two blocks, and the first one's rows are those of a run of one block
    got = [{(r._locus, r.iteration): (r.null_survival, r.null_identity) for r in conservation.null_rows(conservation.null_counts(windows, n, held_bytes=held), n).collect()} for n, held in ((21, 0), (21, 1 << 20), (3, 1 << 20))]
    assert len(got[0]) == 42 and got[0] == {k: (pytest.approx(a), b if b is None else pytest.approx(b)) for k, (a, b) in got[1].items()}
    assert all(got[0][k] == (pytest.approx(a), b if b is None else pytest.approx(b)) for k, (a, b) in got[2].items())
    assert any(b is not None for _, b in got[0].values()) and all(0 <= a <= 1 for a, _ in got[0].values())


def test_conservation_against_a_plain_null(spark, sf):
    """Survival, identity and the null of one locus, codon by codon."""
    import hashlib

    from strandforge import queries

    hits, cds = queries._hits(spark, sf), queries._cds(spark, sf)
    got = conservation.conservation_test(hits, cds, limit=4, iterations=6, seed=3).collect()
    genes = {r.record_id: r for r in cds.collect()}
    comp = str.maketrans("ACGT", "TGCA")
    code = {a + b + c: seq.AMINO[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}

    def peptide(bases, r):
        own = bases[::-1].translate(comp) if r.orf_strand == "-" else bases
        off = (abs(r.orf_frame) - 1) % 3 if r.orf_strand == "-" else r.orf_frame % 3
        return "".join(code[own[k : k + 3]] for k in range(off, len(own) - 2, 3))

    def identity(peps):
        alive = [p for p in peps if p and "*" not in p]
        pairs = [(a, b) for i, a in enumerate(alive) for b in alive[i + 1 :]]
        return sum(sum(x == y for x, y in zip(a, b)) / min(len(a), len(b)) for a, b in pairs) / len(pairs) if pairs else None

    for r in got:
        own = [g for g in genes.values() if g.gene == r.gene_name]
        s, e = -(-r.bin_first * 192 // 20), -(-(r.bin_last + 1) * 192 // 20)
        peps = [peptide(g.genomic[s:e], r) for g in own]
        assert r.evaluated_instances == len(own) and r.survival == pytest.approx(sum(bool(p) and "*" not in p for p in peps) / len(peps))
        assert r.identity == pytest.approx(identity(peps)) if identity(peps) is not None else r.identity is None
        assert r.observed_survived == sum(bool(p) and "*" not in p for p in peps)
        null, lived = [], []
        for it in range(1, 7):
            moved = []
            for g in own:
                cds_ = g.genomic[::-1].translate(comp) if g.strand == "-" else g.genomic
                cells = [cds_[k : k + 3] for k in range(0, 192, 3)]
                free = {}
                for i, c in enumerate(cells, 1):
                    if i > 1 and code[c] != "*":
                        free.setdefault(code[c], []).append(i)
                key = lambda i, g=g, it=it: hashlib.md5(":".join(map(str, [3, r.gene_name, f"{g.gbk_file}::{g.record_id}", g.start, it, i])).encode()).hexdigest()
                out = list(cells)
                for places in free.values():
                    for to, i in zip(places, sorted(places, key=lambda i: (key(i), i))):
                        out[to - 1] = cells[i - 1]
                text = "".join(out)
                moved.append(peptide((text[::-1].translate(comp) if g.strand == "-" else text)[s:e], r))
            null.append(identity(moved))
            lived.append(sum(bool(p) and "*" not in p for p in moved) / len(moved))
        assert r.null_samples_survival == 6 and r.null_survival_mean == pytest.approx(np.mean(lived)) and r.null_survival_std == pytest.approx(np.std(lived), abs=1e-12)
        assert r.p_survival == pytest.approx((sum(x >= r.survival - 1e-12 for x in lived) + 1) / 7)
        told = [x for x in null if x is not None]
        if told:
            assert r.null_mean == pytest.approx(sum(told) / len(told))
            if r.identity is not None:
                assert r.p_value == pytest.approx((sum(x >= r.identity - 1e-12 for x in told) + 1) / (len(told) + 1))


def test_top_loci_of_one_block_and_of_many(spark):
    """Blocks of any size, chunks and shares give the n best loci that a full sort gives; equal similarities keep the references' order."""
    rng = np.random.default_rng(2)
    vectors = rng.integers(-2, 3, (90, 4)).astype(float)  # many equal directions
    refs = [(f"r{i}", f"l{i % 17}", i, v.tolist()) for i, v in enumerate(vectors)]
    cands = [(i, v.tolist()) for i, v in enumerate(rng.integers(-2, 3, (40, 4)).astype(float))]
    references = spark.createDataFrame(refs, "ref_id string, locus string, ref_ord long, embedding array<double>")
    candidates = spark.createDataFrame(cands, "candidate_id long, embedding array<double>")
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    for n in (1, 3, 50):
        want = {}
        for i, v in cands:
            best = {}
            for ref_id, locus, o, w in refs:
                key = (-round(float(unit(v) @ unit(w)), 9), o, ref_id)
                best[locus] = min(best.get(locus, key), key)
            want[i] = [(k[0], locus) for locus, k in sorted(best.items(), key=lambda x: x[1])][:n]
        for block, chunk in ((1000, 1000), (20, 7), (1, 1000)):
            got = {r.candidate_id: r.best for r in similarity.top_loci(candidates, references, n, block, chunk).collect()}
            assert set(got) == set(want)
            for i, best in got.items():
                assert [-round(x.similarity, 9) + 0.0 for x in best] == [s + 0.0 for s, _ in want[i]]
                assert len({x.locus for x in best}) == len(best)
    none = similarity.score_candidates(candidates, references.limit(0))
    assert none.count() == 0


def test_what_is_shuffled_does_not_grow_with_the_loci(spark):
    """100,000 loci: without blocks nothing is shuffled, with blocks each hands on n structs a candidate."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(100_000, 4))
    import pandas as pd

    references = spark.createDataFrame(pd.DataFrame({"ref_id": [f"r{i}" for i in range(100_000)], "locus": [f"l{i}" for i in range(100_000)], "ref_ord": range(100_000), "embedding": vectors.tolist()}))
    cands = rng.normal(size=(30, 4))
    candidates = spark.createDataFrame(pd.DataFrame({"candidate_id": range(30), "embedding": cands.tolist()}))
    sims = (cands / np.linalg.norm(cands, axis=1, keepdims=True)) @ (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).T
    for block in (100_000, 30_000):
        got = similarity.score_candidates(candidates, references, 5, block)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString() or block < 100_000
        for r in got.collect():
            best = np.sort(sims[r.candidate_id])[::-1][:5]
            assert r.best_similarity == pytest.approx(best[0])
            assert r.top_n_mean_similarity == pytest.approx(best.mean())
            assert r.best_match_id == f"r{int(np.argmax(sims[r.candidate_id]))}"
    assert similarity.top_loci(candidates, references, 5, 30_000).select(F.max(F.size("best"))).first()[0] == 5


def test_embedding_batches_and_pooling(spark):
    from strandforge.plans import embed

    for lengths in ([5, 5, 6, 9, 100, 3], [], [7], [50] * 9):
        ranges = list(embed.batches_of(lengths, 20, 3))
        assert [i for a, b in ranges for i in range(a, b)] == list(range(len(lengths)))
        assert all(b - a <= 3 and (b - a == 1 or max(lengths[a:b]) * (b - a) <= 20) for a, b in ranges)
    states, mask = np.arange(24.0).reshape(2, 4, 3), np.array([[0, 1, 1, 0], [0, 0, 0, 0]])
    got = embed.pooled(states, mask)
    assert got.tolist() == [[4.5, 5.5, 6.5], [0.0, 0.0, 0.0]]
    native = spark.createDataFrame([(states[0].tolist(), [bool(x) for x in mask[0]])], "r array<array<double>>, m array<boolean>").select(seq.masked_mean(F.col("r"), F.col("m"))).first()[0]
    assert native == got[0].tolist()


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    from strandforge.plans import embed

    folder = str(tmp_path)

    def load():
        import os
        import uuid

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def model(texts):
            n = max(map(len, texts))
            return np.array([[[float(len(t))]] * n for t in texts]), np.array([[i < len(t) for i in range(n)] for t in texts])

        return model

    df = spark.createDataFrame([("M" * (1 + i % 40),) for i in range(500)] + [(None,), ("",)], "protein string")
    got = {r.protein: r.embedding for r in embed.embed(df, load, f"length-{folder}", most_residues=64).collect()}
    embed.embed(df, load, f"length-{folder}").collect()
    assert got == {"M" * n: [float(n)] for n in range(1, 41)}
    pids = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(pids) == len(set(pids))


def test_progress_tells_every_stage_without_a_job_of_its_own(spark, sf):
    from strandforge import queries
    from strandforge.plans.progress import Progress

    own, emb = queries._pipeline_inputs(spark, sf)
    refs = queries.references(spark, sf).withColumn("sequence", queries._reference_sequence(F.col("ref_ord")))
    jobs = lambda group: len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    def run(group, progress):
        spark.sparkContext.setJobGroup(group, group)
        try:
            return len(pipeline.run_pipeline(own, emb, refs, progress=progress).collect())
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    told = []
    p = Progress(told.append)
    plain, counted = run("plain", None), run("counted", p)
    p.tell_all()
    assert plain == counted
    assert jobs("counted") <= jobs("plain") + 1  # adaptive planning may split a job differently, no counting job is added
    assert [m[:5] for m in told] == [f"[{k}/6]" for k in range(1, 7)]
    assert told[0] == f"[1/6] {own.count()} segments" and told[5] == f"[6/6] {counted} results"


def test_exact_medians_of_hot_groups(spark):
    from strandforge.operators.ordered import exact_medians

    rng = random.Random(8)
    table = [("hot", rng.randrange(50) if i % 2 else rng.random() * 1e6) for i in range(6000)] + [("even", 1.0), ("even", 4.0), ("one", 7.0), ("none", None), (None, 2.0), (None, 3.0), (None, None)] + [("same", 5.0)] * 9
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in table], "g string, v double")
    want = {r.g: r.m for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    for accuracy in (10_000, 100):
        assert {r.g: r.median for r in exact_medians(df, ["g"], "v", accuracy=accuracy).collect()} == want
        assert exact_medians(df, [], "v", "m", accuracy).first().m == df.agg(F.median("v")).first()[0]
    assert exact_medians(df.limit(0), ["g"], "v").count() == 0


def test_numbers_by_buckets_are_those_of_one_window(spark, sf):
    from strandforge import queries

    found = queries.found_orfs(spark, sf).withColumn("record_id", F.lit("one"))  # one hot record
    found = found.withColumn("window_start", (F.col("doc_id") % 3).cast("int")).withColumn("nt_start", (F.col("nt_start") + 1000 * F.col("doc_id")).cast("int"))
    plain = {(r.doc_id, r.strand, r.frame, r.nt_start, r.dna): r.candidate_id for r in orf.with_candidate_ids(found).collect()}
    for bucket in (500, 40_000):
        assert {(r.doc_id, r.strand, r.frame, r.nt_start, r.dna): r.candidate_id for r in orf.with_candidate_ids(found, bucket=bucket).collect()} == plain
    ids = spark.createDataFrame([(i, [" a", "a ", None, ""][i % 4]) for i in range(40)], "index long, record_id string")
    assert sorted(map(tuple, orf.dedupe_record_ids(ids, bucket=7).collect())) == sorted(map(tuple, orf.dedupe_record_ids(ids).collect()))


def test_lanes_of_a_large_record_are_packed_by_islands(spark):
    rng = random.Random(9)
    table = [(g, f"c{i:04}", s, s + rng.choice([0, 1, 5, 30, 200])) for g in ("a", "b", None) for i, s in enumerate(rng.randrange(4000) for _ in range(300))]
    df = spark.createDataFrame(table, "record_id string, candidate_id string, start int, end int")
    want = {}
    for g in ("a", "b", None):
        ends = []
        for _, name, s, e in sorted((r for r in table if r[0] == g), key=lambda r: (r[2], r[1])):
            k = next((i for i, x in enumerate(ends) if s >= x), len(ends))
            ends[k : k + 1] = [max([e, *ends[k : k + 1]])]
            want[g, name] = k
    for bucket in (50, 10_000):
        assert {(r.record_id, r.candidate_id): r.lane for r in viewer.pack_lanes(df, ["record_id"], bucket=bucket).collect()} == want
        held = viewer.islands(df, ["record_id"], bucket).groupBy("record_id", "_island").count().agg(F.max("count")).first()[0]
        assert held < 300


def test_core_benchmark_and_its_files(spark, tmp_path):
    from strandforge.sources import tables

    lead = "MKTLLAVAVALLASGAATA"
    rows = [("a", "k1", "g1", "GGAGHVPEYFVGIGTPISFYG", lead + "GGAGHVPEYFVGIGTPISFYG"), ("b", "k1", "g2", "CCCC", lead + "GGAGHVPEYFVGIGTPISFYG"), ("c", "k2", "g1", lead[3:], lead + "GGAGHVPEYFVGIGTPISFYG"), ("d", "k3", "g3", "", "MKT"), ("e", "k3", "g3", "GG", None)]
    given = spark.createDataFrame(rows, "candidate_id string, case_id string, core_group string, core_aa string, protein_sequence string")
    summary, cases, misses = evaluate.core_benchmark(given, {"default": rules.ruleset(), "strict": rules.ruleset("strict")})
    s = {r.variant: r for r in summary.collect()}
    assert {(r.candidates, r.groups, r.cases) for r in s.values()} == {(3, 2, 2)}
    assert s["default"].group_top_5 >= s["default"].candidate_top_5
    why = {(r.variant, r.candidate_id): r.true_status for r in misses.collect()}
    assert why["default", "b"] == "not in protein" and why["default", "c"] == "site not allowed"
    assert all(r.rank is None for r in cases.filter("candidate_id = 'b'").collect())
    tables.write_core_benchmark(summary, cases, misses, str(tmp_path))
    assert spark.read.json(str(tmp_path / "core_summary")).count() == 2
    back = spark.read.csv(str(tmp_path / "core_misses"), sep="\t", header=True)
    assert back.count() == misses.count() and set(back.columns) == set(misses.columns)


def test_best_by_locus_of_one_block_and_of_many(spark):
    rng = np.random.default_rng(12)
    refs = [(f"r{i}", [None, "a", "b", "c"][i % 4], i, rng.normal(size=3).tolist()) for i in range(60)]
    cands = [(f"c{i}", rng.normal(size=3).tolist()) for i in range(25)] + [("zero", [0.0, 0.0, 0.0])]
    references, candidates = spark.createDataFrame(refs, "ref_id string, locus string, ref_ord long, embedding array<double>"), spark.createDataFrame(cands, "candidate_id string, embedding array<double>")
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    want = {}
    for name, v in cands:
        for ref_id, locus, o, w in refs:
            s = (round(float(unit(v) @ unit(w)), 9), -o, ref_id)
            want[name, locus] = max(want.get((name, locus), s), s)
    for block, chunk in ((100, 100), (13, 4)):
        got = {(r.candidate_id, r.locus): (round(r.similarity, 9), -r.ref_ord, r.ref_id) for r in similarity.best_by_locus(candidates, references, block, chunk).collect()}
        assert got == want
        whole = {(r.candidate_id, k): s for r in similarity.similarity_rows(candidates, references, block).collect() for k, s in zip(r.ref_ids, r.similarities, strict=True)}
        assert len(whole) == len(refs) * len(cands)
        assert similarity.best_by_locus(candidates, references.limit(0), block).count() == 0


def test_known_sequences_by_their_rarest_stretch(spark):
    """Common stretches, short references and absent ones against plain containment."""
    rng = random.Random(13)
    hot = "MKTAYIAKQR"
    proteins = ["".join(rng.choice("ACD") for _ in range(rng.randint(0, 30))) for _ in range(150)] + [hot + "".join(rng.choice("ACD") for _ in range(12)) for _ in range(60)] + [None]
    refs = [hot + proteins[160][10:15], hot + "CCCCCCCC", "AC", "D", "zz", "ACDACDAC", "", None, *(p[3:14] for p in proteins[:40]), *(p[1:6] for p in proteins[40:50])]
    c = spark.createDataFrame([(p, i) for i, p in enumerate(proteins)], "protein string, k int")
    r = spark.createDataFrame([(x,) for x in refs], "sequence string")
    wanted = {x.upper() for x in refs if x}
    for most in (0, 10_000):
        got = {x.k: x.is_known_precursor for x in pipeline.mark_known(c, r, most).collect()}
        assert {k: bool(v) for k, v in got.items()} == {i: p is not None and any(x in p for x in wanted) for i, p in enumerate(proteins)}


def test_a_score_equal_to_the_cutoff_meets_it(spark):
    # 0.8 * 0.2 + 4.5 * 0.6 + 0.5 + ... : sums of tenths that doubles miss by a rounding
    rng = random.Random(5)
    rows = [("".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(60)),) for _ in range(200)]
    sites = rules.cleavage_sites(spark.createDataFrame(rows, "sequence string"), rules.ruleset()).select("sequence", "score", F.round("score", 9).alias("whole")).collect()
    assert all(r.score == r.whole for r in sites)
    best = {r.sequence: r.rule_score_raw for r in rules.best_rule_score(spark.createDataFrame(rows, "sequence string")).collect()}
    assert best == {s: max(r.score for r in sites if r.sequence == s) for (s,) in rows}


def test_running_sums_start_anew_in_each_row(spark):
    df = spark.createDataFrame([("GAG",), ("",), (None,), ("\u00e9G",)], "sequence string")
    got = [r.s for r in df.select(seq.running_sums(F.col("sequence"), {"G": 0.1, "A": 1}).alias("s")).collect()]
    assert got == [[0.0, 0.1, 1.1, 1.1 + 0.1], [0.0], [0.0], [0.0, 0.0, 0.1]]


def test_a_plan_scores_a_site_without_counting_its_letters(spark):
    p = rules.cleavage_sites(spark.createDataFrame([("M" * 60,)], "sequence string"), rules.ruleset())
    assert "translate(" not in p._jdf.queryExecution().optimizedPlan().toString()


def test_edited_rows_are_numbered_without_gaps_over_many_partitions(spark):
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(0, 60_000, 1, 6).select(F.col("id").alias("index"), F.repeat(F.lit("x"), 20).alias("name"))
        got = sorted(r["index"] for r in curation.delete_rows(df, F.col("index") % 7 == 0).collect())
        assert got == list(range(len(got)))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)


def test_a_null_protein_is_not_known(spark):
    p = spark.createDataFrame([("xAAAAAAAAAAx",), ("xCCx",), ("",), (None,)], "protein string")
    for refs in (["AAAAAAAAAA"], ["CC"], ["AAAAAAAAAA", "CC"], [""]):
        r = spark.createDataFrame([(x,) for x in refs], "sequence string")
        got = [x.is_known_precursor for x in pipeline.mark_known(p, r).collect()]
        assert got == ["AAAAAAAAAA" in refs, "CC" in refs, False, False]


def test_a_matrix_over_blocks_has_one_row_a_candidate(spark, sf, monkeypatch):
    from functools import partial

    from strandforge.queries import QUERIES

    want = sorted(map(tuple, QUERIES["similarity_matrix"](spark, sf).collect()))
    monkeypatch.setattr(similarity, "similarity_rows", partial(similarity.similarity_rows, block_rows=40))
    assert sorted(map(tuple, QUERIES["similarity_matrix"](spark, sf).collect())) == want


def test_nearest_loci_are_those_of_all_references_and_few_are_looked_at(monkeypatch):
    """Random and clustered vectors, zero vectors, copies, and a locus without a name, against all products."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 8))
    refs = np.concatenate([centres[rng.integers(0, 60, 3000)] + rng.normal(size=(3000, 8)) * 0.05, np.zeros((5, 8))])
    refs[10:20] = refs[0]
    names = [None if k % 41 == 7 else f"l{k % 41}" for k in range(len(refs))]
    ords = rng.permutation(len(refs))
    block = similarity.Block(pa.array(names, pa.string()), pa.array(ords), pa.array([str(k) for k in range(len(refs))]), pa.array(list(refs), pa.list_(pa.float64())))
    own = np.concatenate([centres[rng.integers(0, 60, 300)] + rng.normal(size=(300, 8)) * 0.05, rng.normal(size=(50, 8)), np.zeros((1, 8))])
    own = similarity._matrix(pa.array(list(own), pa.list_(pa.float64())))
    sims = own @ block.vectors.T
    for n in (1, 2, 5, 100):
        of, ref, sim = block.nearest_loci(own, n)
        for k in range(len(own)):
            best = {}
            for j in np.lexsort((block.ords, -np.round(sims[k], 9))):
                best.setdefault(block.names[block.number[j]], j)
            wanted = list(best.values())[:n]
            np.testing.assert_allclose(sim[of == k], sims[k, wanted], atol=1e-9)
            assert ref[of == k][0] == wanted[0]
    block.in_cells()
    angle = np.arccos(np.clip(own @ block.pivots.T, -1, 1))
    least = block._reached(own, np.argmax(own @ block.pivots.T, axis=1), 2)
    near = np.cos(np.maximum(angle - block.width, 0)) >= least[:, None]
    looked_at = (near * [len(c) for c in block.cells]).sum(axis=1)[:300]
    assert looked_at.mean() < len(refs) / 4


def test_references_of_several_blocks_meet_candidates_in_bounded_groups(spark):
    """By bytes, not rows alone: narrow vectors make few blocks, so few rows are shuffled again and again."""
    c = spark.range(300).select(F.col("id").alias("candidate_id"), F.array(*(F.sin(F.col("id") * k) for k in range(1, 5))).alias("embedding"))
    r = spark.range(45_000).select(F.col("id").cast("string").alias("ref_id"), (F.col("id") % 7).cast("string").alias("locus"), F.col("id").alias("ref_ord"), F.array(*(F.cos(F.col("id") * k) for k in range(1, 5))).alias("embedding"))
    sizes = lambda ids, vectors, refs: iter([similarity.pa.RecordBatch.from_arrays([ids.slice(0, 1), similarity.pa.array([len(refs.ords) * len(ids)])], names=["candidate_id", "n"])])
    _, blocks = similarity.over_blocks(c, r, sizes, "candidate_id {}, n long")
    assert blocks == 1
    found, blocks = similarity.over_blocks(c, r, sizes, "candidate_id {}, n long", 10_000, 100)
    groups = [x.n for x in found.collect()]
    assert blocks == 5 and len(groups) == 15 and sum(groups) == 300 * 45_000 and max(groups) < 140 * 10_000


def test_a_vector_that_many_proteins_share_is_compared_once(spark, monkeypatch):
    dna = [("r1", "ATG" + "GCA" * 24 + "TAA"), ("r2", "ATG" + "GCC" * 25 + "TAA"), ("r3", "ATG" + "GAA" * 26 + "TAA")]
    own = spark.createDataFrame([(r, s, None, None) for r, s in dna], "record_id string, sequence string, region_ranges array<struct<start:int,end:int>>, region_source string")
    found = pipeline.extract_candidates(own, pipeline.Config()).select("protein").distinct()
    vectors = found.withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)))
    refs = spark.createDataFrame([("x", "l", 1, [1.0, 0.0], "M"), ("y", "k", 2, [0.0, 1.0], "W")], "ref_id string, locus string, ref_ord long, embedding array<double>, sequence string")
    compared = []

    def watched(candidates, *a):
        compared.append(candidates.count())
        return similarity.score_candidates(candidates, *a)

    monkeypatch.setattr(pipeline, "score_candidates", watched)
    rows = pipeline.run_pipeline(own, vectors, refs).collect()
    assert found.count() > 1 and compared == [1]
    assert len(rows) >= found.count() and {(r.best_match_id, round(r.best_similarity, 6), round(r.top_n_mean_similarity, 6)) for r in rows} == {("y", 0.894427, 0.670820)}


def test_embeddings_are_made_once_though_they_are_counted(spark, tmp_path):
    """A model is dear: what it gives is written before it is counted and compared in several blocks."""
    own = spark.createDataFrame([("r1", "ATG" + "GCA" * 24 + "TAA", None, None)], "record_id string, sequence string, region_ranges array<struct<start:int,end:int>>, region_source string")
    seen = str(tmp_path / "seen")

    def load():
        def states(texts):
            with open(seen, "a") as f:
                f.write("".join(f"{t}\n" for t in texts))
            return np.ones((len(texts), 3, 2)), np.ones((len(texts), 3), bool)

        return states

    refs = spark.createDataFrame([("x", "l", 1, "MW"), ("y", "k", 2, "WW")], "ref_id string, locus string, ref_ord long, sequence string")
    rows = pipeline.run_embedded_pipeline(own, refs, load, "counted").collect()
    assert sorted(open(seen).read().split()) == sorted({r.protein for r in rows} | {"MW", "WW"})


def test_looking_up_a_kept_index_makes_its_candidates_twice_at_most(spark, tmp_path):
    from strandforge.operators import kept_index

    made, at = str(tmp_path / "made"), str(tmp_path / "index")
    kept_index.add_batch(spark.createDataFrame([("MA", "g"), ("MC", "g"), ("MA", "h")], "protein string, gbk_file string"), at, 0, 2)

    def noted(batches):
        for b in batches:
            with open(made, "a") as f:
                f.write("".join(f"{x}\n" for x in b.column(0).to_pylist()))
            yield b

    asked = spark.createDataFrame([("MA",), ("MW",)], "protein string").coalesce(1).mapInArrow(noted, "protein string")
    got = {tuple(r) for r in kept_index.lookup(asked, at, 2).select("protein", "instance_count", "genome_count").collect()}
    assert got == {("MA", 2, 2), ("MW", 0, 0)}
    assert open(made).read().split().count("MA") <= 2


def test_retrieval_keeps_two_accessions_of_a_candidate_and_no_names(spark, sf, monkeypatch):
    from strandforge.queries import QUERIES

    sizes = []

    def watched(candidates, references, n):
        assert references.filter("ref_id <> ''").isEmpty()
        best = similarity.top_loci(candidates, references, n)
        sizes.append(best.select(F.max(F.size("best"))).first()[0])
        return best

    monkeypatch.setattr(evaluate, "top_loci", watched, raising=False)
    QUERIES["retrieval_windows"](spark, sf)
    assert sizes == [2]


def test_md5_of_pairs_and_its_order():
    """hashes made as arrays are those of hashlib for leads of any length, and ties of leading bits are sorted by all bits."""
    import hashlib

    from strandforge.functions.hashes import by_hash, md5_of_pairs

    first, second = [1, 9, 10, 99, 100, 1000], [2, 9, 10, 64, 100, 12345]
    for n in range(135):
        lead = bytes((7 * n + k) % 256 for k in range(n))
        want = [[hashlib.md5(lead + f"{i}:{k}".encode()).digest() for k in second] for i in first]
        got = md5_of_pairs(lead, first, second)
        assert [[int(x).to_bytes(8, "big") + int(y).to_bytes(8, "big") for x, y in zip(*pair, strict=True)] for pair in zip(*got, strict=True)] == want
    rng = np.random.default_rng(1)
    halves = rng.integers(0, 3, (2, 50, 40)).astype(np.uint64)
    halves[0] |= np.uint64(1 << 63)
    group = np.sort(rng.integers(0, 4, 40)).astype(np.uint64)
    for k, row in enumerate(by_hash(halves, group)):
        assert row.tolist() == sorted(range(40), key=lambda i: (group[i], halves[0, k, i], halves[1, k, i], i))
    halves = rng.integers(0, 2**64, (2, 50, 40), dtype=np.uint64)
    for k, row in enumerate(by_hash(halves, group)):
        assert row.tolist() == sorted(range(40), key=lambda i: (group[i], halves[0, k, i]))


def test_counts_of_the_null_do_not_grow_with_the_tasks(spark):
    """a task holds few genes, so a locus's counts are sent by few tasks, not by all."""
    rng = random.Random(7)
    cds = [(f"f{i}", f"r{i}", 0, 60, "+-"[i % 2], "1", "".join(rng.choice("ACGT") for _ in range(60)), f"g{i % 8}", None, None, None) for i in range(160)]
    cds = spark.createDataFrame(cds, "gbk_file string, record_id string, start int, end int, strand string, codon_start string, genomic string, gene string, locus_tag string, protein_id string, product string")
    loci = spark.createDataFrame([(f"g{k}", "antisense", "-", -1, 2, 5) for k in range(8)], "gene_name string, match_type string, orf_strand string, orf_frame int, bin_first int, bin_last int")
    windows = conservation.locus_windows(loci, conservation.gene_instances(cds))
    counts = conservation.null_counts(windows, 3).filter("len = 0").collect()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(r.seen for r in counts) == 160 and len(counts) <= 8 + tasks - 1 < 8 * tasks


def test_references_of_many_blocks_pass_by_candidates_that_move_once(spark):
    """the rows are those of one block, like vectors included; a candidate is shuffled once, and no results are merged."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6))
    refs = centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 6)) * 0.2
    refs[100:200] = refs[0]
    own = np.concatenate([centres[rng.integers(0, 12, 300)] + rng.normal(size=(300, 6)) * 0.2, refs[:40], np.zeros((3, 6))])
    references = spark.createDataFrame([(f"r{i}", f"l{i % 23}" if i % 31 else None, int(o), v) for i, (o, v) in enumerate(zip(rng.permutation(1500), refs.tolist()))], "ref_id string, locus string, ref_ord long, embedding array<double>")
    candidates = spark.createDataFrame(list(enumerate(own.tolist())), "candidate_id long, embedding array<double>")
    for n in (1, 4, 40):
        want = {r.candidate_id: r.best for r in similarity.top_loci(candidates, references, n).collect()}
        for block, chunk in ((400, 60), (70, None), (1499, 1000)):
            found = similarity.top_loci(candidates, references, n, block, chunk)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "CoGroup" not in plan and "collect_list" not in plan
            assert {r.candidate_id: r.best for r in found.collect()} == want


def test_a_protein_has_few_leading_stretches_and_equal_windows_the_same(spark):
    """what meets the references isn't every stretch of a protein; common ones and all lengths are found all the same."""
    rng = random.Random(3)
    proteins = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(rng.randint(0, 70))) for _ in range(300)] + ["\u00e9" * 30, "A" * 60, None]
    p = spark.createDataFrame([(x,) for x in proteins], "protein string")
    rows = p.select("protein", pipeline.leading_stretches(F.col("protein"), [20], 8).alias("g")).collect()
    windows = [(r.g, r.protein[i : i + 20]) for r in rows if r.protein for i in range(len(r.protein) - 19)]
    alone = spark.createDataFrame([(w,) for _, w in windows], "w string").distinct().select("w", pipeline.leading_stretches(F.col("w"), [20], 8).alias("g")).collect()
    led = {r.w: r.g for r in alone}
    assert all(len(led[w]) == 1 and led[w][0] in g for g, w in windows)
    assert sum(len(r.g) for r in rows) < sum(max(0, len(r.protein or "") - 7) for r in rows) / 3
    refs = [x[a : a + n] for x in proteins[:60] for a, n in [(rng.randint(0, 20), rng.choice([3, 8, 9, 11, 16, 21, 34, 55]))]] + ["A" * 50, "\u00e9" * 9, "A" * 61, "QQQQQQQQQQQQ"]
    r = spark.createDataFrame([(x,) for x in refs], "sequence string")
    wanted = {x.upper() for x in refs if x}
    for pairs in (0, 1_000_000):
        got = {x.protein: x.is_known_precursor for x in pipeline.mark_known(p, r, 0, pairs=pairs).collect()}
        assert {k: bool(v) for k, v in got.items()} == {x: x is not None and any(w in x for w in wanted) for x in proteins}


def test_totals_of_a_matrix_are_those_of_its_rows_and_batches_are_bounded(spark, monkeypatch):
    """a task hands on four numbers of a row; where the matrix itself is asked for, no batch has more than so many similarities."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    own, refs = rng.normal(size=(70, 5)), rng.normal(size=(300, 5))
    candidates = spark.createDataFrame(list(enumerate(own.tolist())), "candidate_id long, embedding array<double>")
    references = spark.createDataFrame([(f"r{i}", f"l{i % 7}", i, v) for i, v in enumerate(refs.tolist())], "ref_id string, locus string, ref_ord long, embedding array<double>")
    sims = (own / np.linalg.norm(own, axis=1, keepdims=True)) @ (refs / np.linalg.norm(refs, axis=1, keepdims=True)).T
    for block in (None, 80):
        got = {r.candidate_id: r[1:] for r in similarity.similarity_totals(candidates, references, block).collect()}
        assert len(got) == 70
        for k, row in enumerate(sims):
            assert got[k] == pytest.approx((300, row.sum(), row.min(), row.max()))
        seen = {}
        for r in similarity.similarity_rows(candidates, references, block).collect():
            seen.setdefault(r.candidate_id, {}).update(zip(r.ref_ids, r.similarities))
        assert all(seen[k] == pytest.approx({f"r{i}": x for i, x in enumerate(row)}) for k, row in enumerate(sims))
    works = []
    monkeypatch.setattr(similarity, "over_blocks", lambda c, r, work, *a: (works.append(work) or c, 1))
    monkeypatch.setattr(similarity, "HELD", 3000)
    similarity.similarity_rows(candidates, references)
    block = similarity.Block(*(pa.array(x) for x in (["l"] * 300, range(300), [f"r{i}" for i in range(300)])), pa.array(list(refs), pa.list_(pa.float64())))
    batches = list(works[0](pa.array(range(70)), own, block))
    assert sum(b.num_rows for b in batches) == 70 and max(len(b.column(2).flatten()) for b in batches) <= 3000


def _noting(at: str):
    """Notes each row's first column in a file while it goes by."""

    def noted(batches):
        for b in batches:
            with open(at, "a") as f:
                f.write("".join(f"{x}\n" for x in b.column(0).to_pylist()))
            yield b

    return noted


def test_a_protein_is_searched_for_once_in_a_retrieval(spark, sf, monkeypatch, tmp_path):
    """F2, F3: the rules score what is written, so the search isn't made again for them."""
    from collections import Counter

    from strandforge.queries import QUERIES

    at = str(tmp_path / "seen")

    def watched(candidates, references, n):
        best = similarity.top_loci(candidates, references, n)
        return best.mapInArrow(_noting(at), best.schema)

    monkeypatch.setattr(evaluate, "top_loci", watched)
    for name in ("retrieval_windows", "retrieval_full_genome"):
        open(at, "w").close()
        QUERIES[name](spark, sf)
        assert set(Counter(open(at).read().split()).values()) == {1}


def test_frames_and_proteins_of_letters_that_are_not_ascii(spark):
    """frames and proteins are found over whole batches; a letter whose upper case is longer moves what follows it, in its own frame alone."""
    rows = [("ATGGGGGGGTAA",), ("atgggggggtaa",), ("\u00e9ATGGGGGGGTAAC",), ("ATG\u00dfGGGGGTAA",), ("\ufb06ATGGGGTAA",), ("",), (None,), ("ATGGGGTA",), ("A",)]
    one = spark.createDataFrame(rows, "sequence string").withColumn("window_start", F.lit(0))
    got = sorted((r.nt_start, r.nt_len, r.dna, r.protein) for r in orf.with_protein(orf.orfs(one, 1, 9, strands=("+",))).collect())
    assert [x[:2] for x in got if x[2].isascii()] == [(0, 9), (0, 9), (1, 6), (1, 9)]
    assert {x[3] for x in got if x[2].isascii()} == {"MGG", "MG"}
    p = spark.createDataFrame([("GTGTAATAG",), ("ttgNNN",), ("TAA",), ("GT",), (None,), ("\u00dfTGTAAT",)], "d string")
    assert [r.p for r in p.select(seq.translate_bacterial(F.col("d")).alias("p")).collect()] == ["M*", "MX", "", "", None, "XV"]


def test_the_pipeline_queries_read_the_documents_once(spark, sf, monkeypatch):
    """segments are written once, and the frames, embeddings and exports come from them."""
    from strandforge import queries

    made, kept = [], queries.cut
    monkeypatch.setattr(queries, "cut", lambda df: made.append(df.columns) or kept(df))
    for name in ("semantic_pipeline_rule_cutoff", "nested_export", "flat_export", "embedded_pipeline", "retrieval_windows"):
        made.clear()
        df = queries.QUERIES[name](spark, sf)
        assert sum("sequence" in c and "doc_id" in c for c in made) == 1
        assert not any(f.endswith("documents.parquet") for f in df.inputFiles())


def test_sites_scored_as_arrays_are_those_of_the_rules(spark, monkeypatch):
    """F2, F3, F5: every preset, and rule sets that arrays don't know, give the best score of all sites as rows."""
    rng = random.Random(11)
    rows = [("".join(rng.choice("ACDEFGHIKLMNPQRSTVWYX*é") for _ in range(rng.randint(0, 80))),) for _ in range(400)] + [("  mkLIKLGKKAKKKTKGGGAAADDDEEEFFFLLL ",), ("",), (None,)]
    p = spark.createDataFrame(rows, "sequence string")
    base = rules.ruleset()
    sets = [rules.ruleset(k) for k in ("default", "strict", "permissive", "discovery")]
    sets += [rules.update_rule(base, "hydrophobicity_transition", parameters={"window_size": 0}), rules.update_rule(base, "leader_signature_motifs", parameters={"patterns": {"AG": 1.0}, "allow_regex": False}), {k: base[k] for k in ("steric_lock_region", "ring_closure_residue")}, {}]
    other = [rules.update_rule(base, "leader_signature_motifs", parameters={"patterns": {"A+$": 1.0}}), {**base, "glycine_rich_core": {"enabled": True, "weight": 1.0, "parameters": {"min_ratio": 0.1}}}]
    assert all(rules._array_scorer(r) is not None for r in sets) and not any(rules._array_scorer(r) for r in other)
    assert "MapInArrow" in rules.best_rule_score(p)._jdf.queryExecution().executedPlan().toString()
    got = [sorted(map(str, rules.best_rule_score(p, r).collect())) for r in sets]
    monkeypatch.setattr(rules, "_array_scorer", lambda r: None)
    assert got == [sorted(map(str, rules.best_rule_score(p, r).collect())) for r in sets]
