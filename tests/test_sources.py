"""Readers and writers."""

import pytest
from pyspark.sql import functions as F

from strandforge.sources import fasta, genbank, tables

GENBANK = """LOCUS       REC1         40 bp    DNA     linear   BCT 01-JAN-2000
DEFINITION  made up.
ACCESSION   REC1
VERSION     REC1.2
FEATURES             Location/Qualifiers
     source          1..40
     region          5..30
                     /product="Knotpeptide
                     cluster"
     CDS             complement(4..12)
                     /gene="abcA"
                     /codon_start=2
                     /product="a ""quoted"" name"
                     /translation="MKV
                     LLA"
     CDS             join(<1..6,10..>21)
                     /locus_tag="t_2"
                     /pseudo
ORIGIN
        1 atgaaaccct ttggacgtac gtacgtacgt tagctagcta
//
LOCUS       REC2         6 bp
FEATURES             Location/Qualifiers
     CDS             2..5
ORIGIN
        1 acgtac
//
"""


def test_genbank(spark, tmp_path):
    (tmp_path / "a.gbk").write_text(GENBANK)
    (tmp_path / "b.gb").write_text("not a record")
    (tmp_path / "c.txt").write_text("ignored")
    r = genbank.read_genbank(spark, str(tmp_path))
    assert r.filter("corrupt is not null").count() == 1
    assert [x.record_id for x in r.filter("corrupt is null").orderBy("record_index").collect()] == ["REC1.2", "REC2"]
    assert genbank.read_genbank(spark, str(tmp_path), 1).filter("corrupt is null").count() == 1
    s = genbank.folder_segments(spark, str(tmp_path), "knot").orderBy("index").collect()
    assert s[0].is_target and not s[1].is_target and len(s[0].sequence) == 40
    assert [tuple(x) for x in s[0].region_ranges] == [(4, 30)]
    a, b = s[0].cds
    assert (a.start, a.end, a.strand, a.gene_name, a.translation, a.product) == (3, 12, "-", "abcA", "MKVLLA", 'a "quoted" name')
    assert (b.start, b.end, b.strand, b.locus_tag) == (0, 21, "+", "t_2")
    c = genbank.cds_features(r).filter("gene = 'abcA'").first()
    assert (c.codon_start, c.genomic) == ("2", "AAACCCTTT")
    assert tables.segment_summary(genbank.segments(r, "knot")).filter("record_id = 'REC1.2'").first().num_cds == 2


def test_locations():
    assert genbank.location("join(complement(5..9),20..30)") == (4, 30, "?")
    assert genbank.location("complement(join(1..3,J00194.1:7..9))") == (0, 9, "-")
    assert genbank.location("42") == (41, 42, "+") and genbank.location("?") is None


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "in.fasta").write_text(">a|locus=1 some words\nmka\nLLV\n>empty\n\n> b\nGG\r\n")
    (tmp_path / "none.fasta").write_text("")
    read = lambda *p, **k: sorted(tuple(r) for r in fasta.read_fasta(spark, *p, **k).collect())
    assert read(str(tmp_path / "in.fasta")) == [("a|locus=1", "MKALLV"), ("b", "GG")]
    assert read(str(tmp_path / "in.fasta"), upper=False, keep_empty=True) == [("a|locus=1", "mkaLLV"), ("b", "GG"), ("empty", "")]
    assert read(str(tmp_path / "in.fasta"), full_header=True)[0] == ("a|locus=1 some words", "MKALLV")
    assert read(str(tmp_path / "none.fasta")) == []
    df = spark.createDataFrame([("x", "A" * 200, "d"), ("y", "C", "")], "id string, sequence string, description string")
    fasta.write_fasta(df, str(tmp_path / "out"), 80, "description")
    assert read(str(tmp_path / "out")) == [("x", "A" * 200), ("y", "C")]
    assert max(len(x) for r in fasta.format_fasta(df, 80).collect() for x in r.value.split("\n")) == 80
    parsed = spark.range(1).select(fasta.parse_records(F.lit("junk\n>h one\nAC\nGT\n>k\n")).alias("r")).first().r
    assert [tuple(x) for x in parsed] == [("h one", "ACGT"), ("k", "")]
    p = spark.createDataFrame([("p1", "MM", 0), ("p2", "KK", 1)], "id string, sequence string, ord int")
    c = spark.createDataFrame([("p1", "p1_c2", "M", 2), ("p1", "p1_c1", "MM", 1)], "parent string, id string, sequence string, rank int")
    assert [r.id for r in fasta.interleave_cores(p, c).collect()] == ["p1", "p1_c1", "p1_c2", "p2"]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("n", "MK")], "name string, sequence string")
    for suffix in ("csv", "tsv", "json"):
        at = str(tmp_path / f"set.{suffix}")
        tables.write_dataset(df, at)
        assert [tuple(r) for r in tables.read_dataset(spark, at, "name string, sequence string").collect()] == [("n", "MK")]
    with pytest.raises(PermissionError):
        tables.write_dataset(df, str(tmp_path / "x.csv"), read_only=True)
    with pytest.raises(ValueError):
        tables.write_dataset(df, str(tmp_path / "x.xyz"))
    (tmp_path / "x.faa").write_text(">a\nMK\n")
    assert [tuple(r) for r in tables.import_entries(spark, str(tmp_path / "x.faa")).collect()] == [("a", "MK")]
    with pytest.raises(ValueError):
        tables.import_entries(spark, str(tmp_path / "x.bin"))
    (tmp_path / "lab.csv").write_text("﻿Name;Core\nx;AA\n", encoding="utf-8")
    assert tables.read_semicolon_table(spark, str(tmp_path / "lab.csv")).columns == ["Name", "Core"]
    (tmp_path / "b.txt").write_text("> one\nPrecursor mk-ka\nCore: KA\n\n>two\nPrecursor: MM\n")
    assert [tuple(r) for r in tables.read_blocks(spark, str(tmp_path / "b.txt")).collect()] == [("one", "MKKA", "KA")]
    assert tables.read_blocks(spark, str(tmp_path / "b.txt"), core_required=False).count() == 2
    assert spark.range(1).select(tables.core_of_description(F.lit("x core=gga y")).alias("c")).first().c == "GGA"
    (tmp_path / "sets").mkdir()
    for n in ("training", "mine"):
        (tmp_path / "sets" / f"{n}.csv").write_text("a\n")
    assert [r.name for r in tables.list_sets(spark, str(tmp_path / "sets"), "*.csv").collect()] == ["mine"]


def test_html_table(spark):
    cells = "".join(f"<td>c{i}</td>" for i in range(8))
    page = f"<table><tr><th>Class</th></tr><tr><td>A</td><td><a href='http://x/y'>P <b>1</b> &amp; 2</a>{cells}</tr><tr><td>B</td>{cells}</tr><tr><td>A</td></tr></table>"
    got = tables.class_table(spark.createDataFrame([(page,)], "html string")).collect()
    assert len(got) == 1 and (got[0].ambler_class, got[0].protein_name, got[0].genpept_id, got[0].natural_or_acquired) == ("A", "P 1 & 2", "c2", "")
    assert got[0].genpept_link == "" and got[0].sequence_link == ""


def test_region_rows(spark):
    schema = "assembly_id string, acc string, record_number int, region_number int, start_pos int, end_pos int, description string, best_mibig_hit_acc string, best_mibig_hit_similarity int"
    df = spark.createDataFrame([("NC_1", "a", 1, 3, 5, 9, None, "BGC1", 80), (None, None, 1, 3, None, None, "d", None, None)], schema)
    a, b = tables.region_rows(df, "http://h", "http://m").collect()
    assert (a.cluster_url, a.gbk_url, a.mibig_url) == ("http://h/output/NC_1/index.html#r1c3", "http://h/output/NC_1/NC_1.gbk", "http://m/go/BGC1")
    assert (b.cluster_url, b.gbk_url, b.mibig_url, b.acc) == ("", "", "", "")


def test_missing_dataset_is_empty(spark, tmp_path):
    empty = tables.read_dataset(spark, str(tmp_path / "none.csv"))
    assert empty.count() == 0 and empty.columns[:2] == ["name", "sequence"]


def test_loci_table(spark, tmp_path):
    at = tmp_path / "loci.tsv"
    at.write_text("gene_name\tmatch_type\torf_strand\torf_frame\tbin_start\tbin_end\tz_score\na\tx\t+\t1\t0\t3\t1.5\nb\tx\t+\t1\t0\t3\t\nc\tx\t-\t-2\t4\t9\t7.25\n")
    got = tables.read_loci(spark, str(at)).collect()
    assert [(r.gene_name, r.bin_first, r.bin_last) for r in got] == [("c", 4, 9), ("a", 0, 3), ("b", 0, 3)]
    assert tables.read_loci(spark, str(at), 1).count() == 1
    at.write_text("gene_name\tmatch_type\na\tx\n")
    with pytest.raises(ValueError, match="bin_end, bin_start, orf_frame, orf_strand"):
        tables.read_loci(spark, str(at))


def test_benchmark_outputs_and_selection(spark, tmp_path):
    ranks = spark.createDataFrame([("l", 1)], "locus string, rank int")
    tables.write_benchmark(ranks, ranks, ranks.selectExpr("count(*) as loci"), str(tmp_path / "b"))
    assert spark.read.csv(str(tmp_path / "b/holdout_topk"), sep="\t", header=True).first().locus == "l"
    assert spark.read.json(str(tmp_path / "b/holdout_summary")).first().loci == 1
    tables.write_selection(ranks, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first()["rank"] == 1


def test_path_list_scan(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "a.gbk").write_text(GENBANK)
    (tmp_path / "x" / "b.gb").write_text(GENBANK)
    both = genbank.read_genbank(spark, [str(tmp_path / "a.gbk"), str(tmp_path / "x" / "b.gb")])
    assert both.select("gbk_file").distinct().count() == 2


def test_nested_export_has_all_fields(spark):
    import json

    s = spark.createDataFrame([("r", "ACGTACGT", True, "f.gbk", [(0, 6, "+", "MK", None, "t1", "p")])], "record_id string, sequence string, is_target boolean, source_file string, cds array<struct<start:int,end:int,strand:string,translation:string,protein_id:string,locus_tag:string,product:string>>")
    c = spark.createDataFrame([("r", "c1", 2, "MK"), ("r", "c2", 1, "MV")], "record_id string, candidate_id string, rank int, protein string")
    (row,) = tables.nested_results(s, c, {"model": "m"}).collect()
    told = json.loads(row.json)
    assert set(told) == {"record_id", "is_target", "segment_length_nt", "num_annotated_cds", "num_candidates", "candidates", "annotated_cds", "source_file", "coordinate_system", "pipeline_metadata"}
    assert [x["candidate_id"] for x in told["candidates"]] == ["c2", "c1"] and set(told["candidates"][0]) == set(tables.CANDIDATE)
    assert told["annotated_cds"][0]["length_nt"] == 6 and told["pipeline_metadata"] == {"model": "m"} and told["num_annotated_cds"] == 1
    flat = tables.flat_results(c, s)
    assert flat.columns == ["record_id", "is_target", "candidate_id", "protein_sequence", "rank"]


def _many_records(n, rng):
    out = []
    for i in range(n):
        bases = "".join(rng.choice("acgt") for _ in range(rng.randint(0, 150)))
        body = "\n".join(f"{k + 1:>9} {bases[k : k + 60]}" for k in range(0, len(bases), 60))
        out.append(f"LOCUS       R{i} {len(bases)} bp\nVERSION     R{i}.1\nFEATURES             Location/Qualifiers\n     CDS             1..{max(1, len(bases))}\n                     /gene=\"g{i}\"\nORIGIN\n{body}\n//\n")
    return out


def test_a_large_genbank_file_is_read_by_many_tasks(spark, tmp_path):
    """Parts that begin anywhere in a record give every record once, numbered by its place in the file."""
    import random

    records = _many_records(120, random.Random(7))
    (tmp_path / "big.gbk").write_text("".join(records))
    (tmp_path / "small.gb").write_text(records[3])
    held = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in (97, 350, 1013, 10_000, 1 << 27):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            r = genbank.read_genbank(spark, str(tmp_path))
            if size < 1 << 20:
                assert spark.read.text(str(tmp_path / "big.gbk"), lineSep="\n//").rdd.getNumPartitions() > 2
            got = sorted((x.gbk_file.rsplit("/", 1)[1], x.record_index, x.record_id, x.sequence, len(x.features), x.corrupt) for x in r.collect())
            want = [("big.gbk", i + 1, f"R{i}.1", next(genbank.parse_genbank(t))[2], 1, None) for i, t in enumerate(records)] + [("small.gb", 1, "R3.1", next(genbank.parse_genbank(records[3]))[2], 1, None)]
            assert got == sorted(want), size
            first = genbank.read_genbank(spark, str(tmp_path), 2).collect()
            assert sorted((x.gbk_file.rsplit("/", 1)[1], x.record_id) for x in first) == [("big.gbk", "R0.1"), ("big.gbk", "R1.1"), ("small.gb", "R3.1")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held[0])
        spark.conf.set("spark.sql.files.openCostInBytes", held[1])


def test_a_bad_record_costs_no_other(spark, tmp_path):
    good = _many_records(2, __import__("random").Random(1))
    (tmp_path / "a.gbk").write_bytes((good[0] + "junk\n//\n" + good[1]).replace("\n", "\r\n").encode() + b"\n\xff\n")
    rows = sorted(genbank.read_genbank(spark, str(tmp_path)).collect(), key=lambda r: r.record_index)
    assert [(r.record_index, r.record_id) for r in rows] == [(1, "R0.1"), (2, None), (3, "R1.1"), (4, None)]
    assert [r.corrupt for r in rows] == [None, "no LOCUS line", None, "no LOCUS line"]


def test_fasta_split_anywhere(spark, tmp_path):
    import random

    rng = random.Random(5)
    want = [(f"s{i}", "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 90)))) for i in range(150)]
    (tmp_path / "a.fa").write_text("".join(f">{k} d\n" + "\n".join(s[x : x + 20] for x in range(0, len(s), 20)) + "\n" for k, s in want))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in (61, 333, 2000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            assert sorted(map(tuple, fasta.read_fasta(spark, str(tmp_path)).collect())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held[0])
        spark.conf.set("spark.sql.files.openCostInBytes", held[1])


def test_json_datasets_of_either_form(spark, tmp_path):
    """An object a line, an array, and an object over many lines; written sets come back whole."""
    import json

    rows = [{"name": f"n{i}", "sequence": "MK" * i} for i in range(30)]
    (tmp_path / "lines.json").write_text("\n" + "\n".join(map(json.dumps, rows)))
    (tmp_path / "array.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "one.json").write_text(json.dumps(rows[3], indent=1))
    read = lambda name: sorted((r.name, r.sequence) for r in tables.read_dataset(spark, str(tmp_path / name), "name string, sequence string").collect())
    want = sorted((r["name"], r["sequence"]) for r in rows)
    assert read("lines.json") == read("array.json") == want and read("one.json") == [("n3", "MKMKMK")]
    tables.write_dataset(spark.createDataFrame(rows, "name string, sequence string"), str(tmp_path / "set.json"))
    assert read("set.json") == want
