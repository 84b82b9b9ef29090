"""Sequence and text functions: exact values and properties."""

import random

import pytest
from pyspark.sql import functions as F

from strandforge.functions import seq, text


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_translation(spark):
    got = one(spark, *(seq.translate_bacterial(F.lit(d)).alias(f"c{i}") for i, d in enumerate(["GTGAAATAA", "TTGAAATAG", "ATGAAATAA", "ATGGTGTAA", "atggtgtaa", "AT", "ATGNNN", "TAA", ""])))
    assert got == ("MK", "MK", "MK", "MV", "MV", "", "MX", "", "")


def test_window_translation(spark):
    w = F.lit("ATGAAATTTCCC")
    assert one(spark, seq.translate_window(w, F.lit("-"), F.lit(-1)).alias("a"), seq.translate_window(w, F.lit("-"), F.lit(-2)).alias("b"), seq.translate_window(w, F.lit("+"), F.lit(1)).alias("c"), seq.translate_window(w, F.lit("+"), F.lit(1), "one").alias("d")) == ("GKFH", "GNF", "*NF", "MKFP")


def test_reverse_complement_is_an_involution(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("ACGTacgtRYKMNn") for _ in range(rng.randint(0, 40))),) for _ in range(50)]
    df = spark.createDataFrame(rows, "s string")
    assert df.filter(seq.reverse_complement(seq.reverse_complement(F.col("s"))) != F.col("s")).count() == 0
    assert one(spark, seq.reverse_complement(F.lit("AACGTn")).alias("a")) == ("nACGTT",)


def test_charge_and_hydropathy(spark):
    def charge(s, ph=7.0):
        plus = {**seq.PK_POSITIVE}
        total = 1 / (10 ** (ph - seq.PK_N_BY_RESIDUE.get(s[0], seq.PK_N)) + 1) - 1 / (10 ** (seq.PK_C_BY_RESIDUE.get(s[-1], seq.PK_C) - ph) + 1)
        return total + sum(1 / (10 ** (ph - plus[c]) + 1) for c in s if c in plus) - sum(1 / (10 ** (seq.PK_NEGATIVE[c] - ph) + 1) for c in s if c in seq.PK_NEGATIVE)

    for s in ("GGAGHVPEYFVGIGTPISFYG", "MKKVYEAPTLVRLGSFRKQTG", "E", "AD"):
        c, h = one(spark, seq.net_charge(F.lit(s)).alias("c"), seq.hydropathy_mean(F.lit(s)).alias("h"))
        assert c == pytest.approx(charge(s), abs=1e-9)
        assert h == pytest.approx(sum(seq.HYDROPATHY[x] for x in s) / len(s), abs=1e-9)
    assert one(spark, seq.net_charge(F.lit("")).alias("c"), seq.hydropathy_mean(F.lit("XZ")).alias("h")) == (0.0, 0.0)


def test_bins_and_their_windows(spark):
    assert one(spark, seq.bins_of(F.lit(0), F.lit(1000), F.lit(999), F.lit(1000), 20).alias("b"))[0] == (19, 19)
    assert one(spark, seq.bins_of(F.lit(0), F.lit(10), F.lit(10), F.lit(20), 20).alias("b")) == (None,)
    rng = random.Random(2)
    rows = [(n := rng.randint(20, 3000), s := rng.randint(0, n - 1), rng.randint(s + 1, n)) for _ in range(300)]
    df = spark.createDataFrame(rows, "n int, s int, e int").withColumn("b", seq.bins_of(F.lit(0), F.col("n"), F.col("s"), F.col("e"), 20))
    w = df.withColumn("w", seq.window_of_bins(F.col("b.first"), F.col("b.last"), F.col("n"), 20))
    assert w.filter((F.col("w.start") > F.col("s")) | (F.col("w.end") < F.col("e"))).count() == 0  # the bins cover what made them


def test_statistics(spark):
    assert one(spark, seq.p_value(F.lit(1), F.lit(3)).alias("a"), seq.p_value(F.lit(0), F.lit(0)).alias("b"), seq.z_score(F.lit(3.0), F.lit(1.0), F.lit(0.0)).alias("c"), seq.z_score(F.lit(3.0), F.lit(1.0), F.lit(2.0)).alias("d")) == (0.5, None, None, 1.0)


def test_vectors(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    got = one(spark, seq.cosine(v(1.0, 2.0), v(2.0, 4.0)).alias("a"), seq.cosine(v(1.0, 0.0), v(0.0, 3.0)).alias("b"), seq.cosine(v(1.0, 1.0), v(-1.0, -1.0)).alias("c"), seq.cosine(v(0.0, 0.0), v(1.0, 1.0)).alias("d"))
    assert got == pytest.approx((1.0, 0.0, -1.0, 0.0))
    rows = F.array(v(9.0), v(1.0), v(2.0), v(3.0), v(9.0))
    assert one(spark, seq.masked_mean(rows, v(False, True, True, True, False)).alias("m"))[0] == [2.0]
    assert one(spark, seq.masked_mean(rows, v(*[False] * 5)).alias("m"))[0] == [0.0]


def test_text_functions(spark):
    got = one(
        spark,
        text.normalise_accession(F.lit(" WP_1.2 x")).alias("a"), text.normalise_accession(F.lit("Unknown")).alias("b"), text.normalise_accession(F.lit("WP_031104469.1c")).alias("c"),
        text.slug(F.lit("  A b/C ")).alias("d"), text.slug(F.lit("///")).alias("e"), text.header_token(F.lit("x|locus=l1|pep=p"), "pep").alias("f"),
        text.inject_locus(F.lit("a|b=1"), F.lit("L")).alias("g"), text.inject_locus(F.lit("a|locus=Z|b"), F.lit("L")).alias("h"), text.accession_or_link(F.lit(" "), F.lit("http://x/y/ABC_1/?q")).alias("i"),
        text.candidate_id(F.lit("r"), F.lit(7)).alias("j"), text.candidate_id(F.lit("r"), F.lit(12345)).alias("k"), text.confidence(F.lit(8.0)).alias("l"), text.hit_at(F.lit(None).cast("int"), 5).alias("m"),
        text.frame_label(F.lit("-"), F.lit(-2)).alias("n"), text.frame_label(F.lit("+"), F.lit(0)).alias("o"), text.product_class(F.lit("Knot precursor B2 protein")).alias("p"), text.product_class(F.lit(None).cast("string")).alias("q"),
    )
    assert got == ("WP_1", "", "WP_031104469.1c", "a_bc", "unnamed", "p", "a|locus=L|b=1", "a|locus=Z|b", "ABC_1", "r|orf0007", "r|orf12345", "high", 0, "-2", "+0", "peptidase", "other")
    assert one(spark, text.occurrences(F.lit("AAAA"), F.lit("AA")).alias("a"), text.core_matches(F.lit("ILV"), F.lit("LLV")).alias("b"), text.core_matches(F.lit(""), F.lit("")).alias("c"), text.core_is_suffix(F.lit("MKGGIXX"), F.lit("GGL"), 2).alias("d")) == ([0, 1, 2], True, False, True)
    with pytest.raises(Exception, match="no locus"):
        one(spark, text.require_locus(F.lit("a|b")).alias("x"))


def test_codon_start(spark):
    df = spark.createDataFrame([("1",), ("3",), ("9",), ("x",), (None,)], "c string")
    assert [r[0] for r in df.select(text.codon_start(F.col("c")).alias("n")).collect()] == [1, 3, 1, 1, 1]


def test_functions_in_sql(spark):
    from strandforge.functions.register import register

    register(spark)
    got = tuple(spark.sql("select reverse_complement('AACGTn') a, translate_bacterial('ttgaaatag') b, translate_bacterial('AT') c, vector_cosine(array(1D, 2D), array(2D, 4D)) d, vector_cosine(array(0D), array(1D)) e, length(peptide_digest('MK')) f, core_group('ILI') g").first())
    want = one(spark, text.core_group(F.lit("LLL")).alias("g"))[0]
    assert got[:3] == ("nACGTT", "MK", "") and got[3] == pytest.approx(1.0) and got[4:] == (0.0, 32, want)
    rows = spark.sql("select * from six_frame_orfs('ATGAAATAA', 2, 3)").collect()
    assert [tuple(r) for r in rows] == [("+", 0, 0, 6, "ATGAAA")]
