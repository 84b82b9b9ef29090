"""Building, merging and editing reference datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandforge.functions.seq import interval_distance, window_around
from strandforge.functions.text import core_is_prefix, core_is_suffix, sequence_hash, slug
from strandforge.lineage import cut
from strandforge.operators.ordered import exact_medians
from strandforge.operators.orf import orfs, with_protein
from strandforge.operators.rank import keep_first, rank_loci


def curated_table(raw: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns by trimmed lower-case name; each field is the first non-blank among its aliases."""
    low = raw.toDF(*(c.strip().lower() for c in raw.columns))
    pick = lambda names: F.coalesce(*(F.when(F.trim(low[n].cast("string")) != "", F.trim(low[n].cast("string"))) for n in names if n in low.columns), F.lit(None).cast("string"))
    return low.select(*(pick(names).alias(field) for field, names in aliases.items()))


def search(df: DataFrame, text: str | None = None, source: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows of a source with the text in any column, whatever its case."""
    if source is not None:
        df = df.filter(F.col("source") == source)
    if text:
        any_column = None
        for c in columns or df.columns:
            one = F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(text.lower()))
            any_column = one if any_column is None else any_column | one
        df = df.filter(any_column)
    return df


def merge_sources(parts: list[DataFrame], key: str = "sequence", ordinal: str = "ord") -> DataFrame:
    """All parts; of rows with one key the first part's first row stays."""
    out = None
    for k, p in enumerate(parts):
        own = p.withColumn("_part", F.lit(k))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return keep_first(out, [key], ["_part", ordinal]).drop("_part")


def merge_entries(old: DataFrame, new: DataFrame, dedupe: bool = False, key: str = "sequence", ordinal: str = "ord") -> tuple[DataFrame, int]:
    """(all rows, how many were added): new rows after the old ones, with ``dedupe`` the first of each sequence alone.  One job counts both."""
    out = merge_sources([old, new], key, ordinal) if dedupe else old.unionByName(new, allowMissingColumns=True)
    counts = out.agg(F.count("*").alias("n")).join(old.agg(F.count("*").alias("before")), how="cross").first()  # one row each
    return out, max(0, counts.n - counts.before)


def append_new(old: DataFrame, new: DataFrame, key: str = "sequence", id_column: str = "id", ordinal: str = "ord") -> DataFrame:
    """The rows to add: neither their sequence nor their id is known, and each comes once."""
    fresh = new.join(old.select(key).distinct(), key, "left_anti").join(old.select(id_column).distinct(), id_column, "left_anti")
    return keep_first(keep_first(fresh, [key], [ordinal]), [id_column], [ordinal])


def update_curated(curated: DataFrame, entries: DataFrame, generated: DataFrame, source: str, orientation: str = "leader_core", added_at: str = "", origin: str = "") -> tuple[DataFrame, DataFrame]:
    """(the curated table with new entries, the verified sequences: generated ones, then curated ones, each once).

    ``curated``: the table's ten columns; ``entries``: name, sequence, core, ord; ``generated``: id, sequence, ord.  A sequence or id that
    is known isn't added again.
    """
    clean = entries.withColumn("sequence", F.upper(F.regexp_replace("sequence", "[^A-Za-z]", ""))).filter("sequence <> ''")
    locus = F.concat(F.lit("curated_"), sequence_hash(F.col("sequence")))
    made = clean.withColumn("locus", locus).withColumn("id", F.concat("locus", F.lit("|locus="), F.col("locus"), F.lit("|name="), slug(F.col("name")), F.lit(f"|source={source}")))
    added = append_new(curated, made, "sequence", "id", "ord").select(
        "id", "name", "sequence", F.length("sequence").alias("length"), F.coalesce("core", F.lit("")).alias("core"), F.lit(orientation).alias("orientation"), "locus", F.lit(source).alias("source"), F.lit(added_at).alias("added_at"), F.lit(origin).alias("input"),
    )
    table = curated.select(added.columns).unionByName(added)
    verified = merge_sources([generated.select("id", "sequence", F.col("ord").cast("string").alias("ord")), table.select("id", "sequence", F.col("id").alias("ord"))], "sequence", "ord").drop("ord")
    return table, verified


def renumber(df: DataFrame, ordinal: str = "index") -> DataFrame:
    """Consecutive numbers in the present order, by counting the rows before each range partition: no single task sees all rows.

    Ranges are sampled anew whenever a plan runs, so rows are written with their partition before they are counted and numbered.
    """
    ranged = cut(df.repartitionByRange(ordinal).withColumn("_p", F.spark_partition_id()))
    ranged = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(ordinal)))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_c"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")  # one row a partition
    return ranged.join(F.broadcast(before), "_p").withColumn(ordinal, (F.col("_before") + F.col("_k") - 1).cast("long")).drop("_p", "_k", "_before")


def update_rows(df: DataFrame, at: Column, values: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(at, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_rows(df: DataFrame, at: Column, ordinal: str = "index") -> DataFrame:
    return renumber(df.filter(~F.coalesce(at, F.lit(False))), ordinal)


def insert_rows(df: DataFrame, rows: DataFrame, ordinal: str = "index") -> DataFrame:
    """New rows after the last one, numbered on."""
    last = df.agg(F.coalesce(F.max(ordinal), F.lit(-1)).alias("_last"))
    own = renumber(rows, ordinal).join(F.broadcast(last), how="cross")  # last is one row
    return df.unionByName(own.withColumn(ordinal, (F.col("_last") + 1 + F.col(ordinal)).cast("long")).drop("_last"))


def anchor_loci(cds: DataFrame, accessions: DataFrame, records: DataFrame, flank: int = 20_000) -> DataFrame:
    """Windows around the coding sequences of wanted proteins, with their bases.

    ``cds``: gbk_path, record_id, start, end, accession; ``accessions``: case_id, accession, core; ``records``: gbk_path, record_id, sequence.
    """
    hit = cds.join(accessions, "accession").join(records, ["gbk_path", "record_id"])
    s, e = window_around(F.col("start"), F.col("end"), F.length("sequence"), flank)
    return hit.withColumn("window_start", s.cast("int")).withColumn("window_end", e.cast("int")).withColumn("sequence", F.substr("sequence", F.col("window_start") + 1, F.col("window_end") - F.col("window_start")))


def locus_candidates(loci: DataFrame, min_aa: int = 20, max_aa: int = 120, slack: int = 0, inverted: bool = False) -> DataFrame:
    """Open frames of the windows whose protein ends (inverted: begins) with the case's core."""
    found = with_protein(orfs(loci, min_aa, max_aa))
    test = core_is_prefix if inverted else core_is_suffix
    return found.filter(test(F.col("protein"), F.col("core"), slack)).withColumn("distance", interval_distance(F.col("start"), F.col("end"), F.col("genomic_start"), F.col("genomic_end")))


def locus_stats(loci: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches, median distance (null without) and span of every locus; the candidates are written once, and the exact medians gather in no task."""
    key = ["case_id", "gbk_path", "record_id", "start", "end"]
    candidates = cut(candidates.select(*key, "distance", "genomic_start", "genomic_end"))
    stats = candidates.groupBy(*key).agg(F.count("*").alias("match_count"), (F.max("genomic_end") - F.min("genomic_start")).alias("locus_span")).join(exact_medians(candidates, key, "distance", "median_distance"), key)
    out = loci.select(*key).distinct().join(stats, key, "left")
    return out.withColumn("match_count", F.coalesce("match_count", F.lit(0)).cast("long")).withColumn("locus_span", F.coalesce("locus_span", F.lit(0)))


def case_stats(ranked: DataFrame, cases: DataFrame, inverted: bool = False) -> DataFrame:
    """One row: cases, mapped, matched, unambiguous, ambiguous and unmatched ones; loci scanned, included, and included though ambiguous; the orientation."""
    by_case = ranked.groupBy("case_id").agg(F.max("match_count").alias("best"), F.bool_or("ambiguous").alias("amb"), F.count("*").alias("loci"), F.count_if(F.col("match_count") > 0).alias("matched_loci"), F.count_if((F.col("match_count") > 0) & F.col("ambiguous")).alias("amb_loci"))
    every = cases.select("case_id").distinct().join(by_case, "case_id", "left")
    hit = F.coalesce(F.col("best") > 0, F.lit(False))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return every.agg(
        F.count("*").alias("total_cases"), F.count("loci").alias("mapped"), F.count_if(hit).alias("cases_with_match"), F.count_if(hit & ~F.col("amb")).alias("cases_unambiguous"),
        F.count_if(hit & F.col("amb")).alias("cases_ambiguous"), F.count_if(F.col("loci").isNotNull() & ~hit).alias("cases_no_match"), total("loci", "loci_scanned"), total("matched_loci", "loci_included"), total("amb_loci", "ambiguous_loci_included"),
    ).withColumn("orientation", F.lit("core_leader" if inverted else "leader_core"))


def build_dataset(cds: DataFrame, cases: DataFrame, records: DataFrame, flank: int = 20_000, ambiguous_within: int = 1000, inverted: bool = False, **orf_limits) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, ranked loci, statistics) of the cases: anchor, search, match, rank.

    ``cases``: case_id, accession, core; one without an accession or core is counted and not searched.  ``cds`` and ``records`` as in ``anchor_loci``.
    """
    sound = cases.filter((F.coalesce("accession", F.lit("")) != "") & (F.coalesce("core", F.lit("")) != ""))
    loci = anchor_loci(cds, sound, records, flank)
    found = locus_candidates(loci, inverted=inverted, **orf_limits)
    ranked = rank_loci(locus_stats(loci, found), ambiguous_within)
    best = ranked.filter((F.col("match_count") > 0) & ((F.col("locus_rank") == 1) | F.col("ambiguous")))
    key = ["case_id", "gbk_path", "record_id", "start", "end"]
    return found.join(best.select(*key, "locus_rank"), key), ranked, case_stats(ranked, cases, inverted)
