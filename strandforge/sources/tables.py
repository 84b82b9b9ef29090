"""Dataset tables, labelled blocks, HTML tables and nested exports."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandforge.functions.text import header_token, normalise_accession
from strandforge.sources.fasta import read_fasta

#: Fields of a dataset.
DATASET = "name string, sequence string, full_precursor string, leader string, core string, source string, validation_status string"
PROTECTED = ("training", "validation")


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_dataset(spark: SparkSession, path: str, schema: str | None = DATASET) -> DataFrame:
    """CSV, TSV or JSON by suffix, any other as CSV; broken lines are skipped, a path that isn't there is an empty table.

    JSON may be one array or object over many lines, or an object a line, as ``write_dataset`` writes it.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema or DATASET)
    suffix = PurePosixPath(path).suffix.lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if suffix == ".json":
        first = spark.read.text(path).filter(F.trim("value") != "").first()
        lines = first is not None and first.value.strip().startswith("{") and first.value.strip().endswith("}")
        return reader.json(path, multiLine=not lines, mode="DROPMALFORMED")
    return reader.csv(path, sep="\t" if suffix == ".tsv" else ",", header=True, mode="DROPMALFORMED", enforceSchema=False)


def import_entries(spark: SparkSession, path: str) -> DataFrame:
    """Dataset rows from FASTA, CSV, TSV or JSON by suffix; any other suffix is an error."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix in (".fasta", ".fa", ".faa"):
        return read_fasta(spark, path).withColumnRenamed("id", "name")
    if suffix in (".csv", ".tsv", ".json"):
        return read_dataset(spark, path)
    raise ValueError(f"no importer for {suffix or 'a path without suffix'}")


def read_semicolon_table(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon-separated with a byte-order mark, which belongs to no column name."""
    df = spark.read.csv(path, sep=";", header=True)
    return df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))


def write_dataset(df: DataFrame, path: str, read_only: bool = False, mode: str = "overwrite") -> None:
    if read_only:
        raise PermissionError("this dataset is read-only")
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".json":
        df.write.mode(mode).json(path)
    elif suffix in (".csv", ".tsv"):
        df.write.mode(mode).csv(path, sep="\t" if suffix == ".tsv" else ",", header=True)
    else:
        raise ValueError(f"no writer for {suffix or 'a path without suffix'}")


def read_blocks(spark: SparkSession, path: str | list[str], core_required: bool = True) -> DataFrame:
    """Blocks of ``>name``, ``Precursor:`` and ``Core:`` lines as (name, precursor, core), letters only."""
    text = spark.read.text(path, lineSep=">").filter(F.trim("value") != "")
    letters = lambda k: F.upper(F.regexp_replace(F.regexp_extract("value", rf"(?im)^\s*{k}(?:[^\n:]*:)?([^\n]*)", 1), "[^A-Za-z]", ""))
    out = text.select(F.trim(F.substring_index("value", "\n", 1)).alias("name"), letters("precursor").alias("precursor"), letters("core").alias("core")).filter("precursor <> ''")
    return out.filter("core <> ''") if core_required else out.withColumn("core", F.when(F.col("core") != "", F.col("core")))


def core_of_description(description: Column) -> Column:
    """Letters after core: or core= in a FASTA description; null without."""
    s = F.upper(F.regexp_extract(description, "(?i)core[:=]([A-Za-z]+)", 1))
    return F.when(s != "", s)


#: The named references that tables of this kind use.
_REFERENCES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def _plain(cell: Column) -> Column:
    """Trimmed text pieces of a cell, joined by one space."""
    text = F.trim(F.regexp_replace(F.regexp_replace(cell, r"(?s)<[^>]*>", " "), r"\s+", " "))
    for name, char in _REFERENCES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(text)


def html_rows(html: Column) -> Column:
    """Table rows of a page: arrays of struct(text, href) of their td cells, the href of a cell's first link; rows without one are none."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=</tr|<tr\b|$)"), F.lit(1))
    cell = lambda c: F.struct(_plain(c).alias("text"), F.regexp_extract(c, r"""(?is)<a\b[^>]*href\s*=\s*["']?([^"'\s>]+)""", 1).alias("href"))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<td\b[^>]*>(.*?)(?=</td|<td\b|$)"), F.lit(1)), cell))
    return F.filter(cells, lambda r: F.size(r) > 0)


#: Fields of a class table: name, cell, and whether it is the text, the link or an accession.
CLASS_FIELDS = [
    ("ambler_class", 0, "text"), ("protein_name", 1, "text"), ("alt_names", 2, "text"), ("subfamily", 3, "text"), ("genpept_id", 4, "id"), ("genpept_link", 4, "href"), ("genbank_id", 5, "id"), ("genbank_link", 5, "href"),
    ("pubmed", 6, "text"), ("sequence_link", 7, "href"), ("pdb_count", 8, "text"), ("mutants", 9, "text"), ("phenotype", 10, "text"), ("functional_info", 11, "text"), ("natural_or_acquired", 12, "text"),
]


def class_table(pages: DataFrame, wanted: str = "A", least: int = 8) -> DataFrame:
    """Rows with enough cells whose first is the wanted class; missing later cells are empty."""
    rows = pages.select(F.posexplode(html_rows(F.col("html"))).alias("row", "cells")).filter((F.size("cells") >= least) & (F.col("cells")[0]["text"] == wanted))

    def field(cell: int, kind: str) -> Column:
        value = F.coalesce(F.try_element_at("cells", F.lit(cell + 1))["href" if kind == "href" else "text"], F.lit(""))
        return normalise_accession(value, unknown_is_empty=False, drop_version=False) if kind == "id" else value

    return rows.select("row", *(field(cell, kind).alias(name) for name, cell, kind in CLASS_FIELDS))


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*href\s*=\s*["']?([^"'\s>]+)"""), F.lit(1))


def region_rows(regions: DataFrame, base: str, cluster_base: str) -> DataFrame:
    """Search hits as rows; addresses are derived only where assembly, record and region are known, and are empty otherwise."""
    c = {n: F.col(n) for n in ("assembly_id", "record_number", "region_number")}
    own = F.coalesce(c["assembly_id"], F.lit(""))
    whole = (own != "") & c["record_number"].isNotNull() & c["region_number"].isNotNull()
    best = F.coalesce("best_mibig_hit_acc", F.lit(""))
    address = lambda *parts: F.when(whole, F.concat(F.lit(f"{base}/output/"), own, *parts)).otherwise(F.lit(""))
    return regions.select(
        own.alias("assembly_id"), F.coalesce("acc", F.lit("")).alias("acc"), "record_number", "region_number", "start_pos", "end_pos", F.coalesce("description", F.lit("")).alias("description"),
        address(F.lit("/index.html#r"), c["record_number"].cast("string"), F.lit("c"), c["region_number"].cast("string")).alias("cluster_url"),
        address(F.lit("/"), own, F.lit(".gbk")).alias("gbk_url"),
        best.alias("best_mibig_hit_acc"), F.coalesce(F.col("best_mibig_hit_similarity").cast("string"), F.lit("")).alias("best_mibig_hit_similarity"),
        F.when(best != "", F.concat(F.lit(f"{cluster_base}/go/"), best)).otherwise(F.lit("")).alias("mibig_url"),
    )


#: The flat export's columns, in their order; the segment's target flag is the second.
FLAT = [
    "record_id", "is_target", "candidate_id", "protein_sequence", "dna_sequence", "aa_length", "frame", "strand", "genomic_start", "genomic_end", "start_codon",
    "is_alt_start", "best_similarity", "best_match_id", "top_n_mean_similarity", "embedding_score", "combined_score", "rule_score_raw", "rule_orientation", "is_known_precursor", "genome_count",
]
#: Fields of a candidate and of a coding sequence in the nested export.
CANDIDATE = [
    "candidate_id", "protein_sequence", "dna_sequence", "aa_length", "strand", "frame", "genomic_start", "genomic_end",
    "best_similarity", "best_match_id", "top_n_mean_similarity", "embedding_score", "is_known_precursor", "rule_orientation", "rule_score_raw", "genome_count",
]
CODING = ["start", "end", "strand", "translation", "protein_id", "locus_tag", "product"]


def _exported(results: DataFrame) -> DataFrame:
    """The plan's columns under the export's names."""
    return results.withColumnsRenamed({"protein": "protein_sequence", "dna": "dna_sequence", "aa_len": "aa_length"})


def flat_results(results: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """A row for each candidate: the known columns first, in their order, then the rest.  ``segments`` (record_id, is_target) brings the flag."""
    out = _exported(results)
    if segments is not None and "is_target" not in out.columns:
        out = out.join(segments.select("record_id", "is_target"), "record_id")
    first = [c for c in FLAT if c in out.columns]
    return out.select(*first, *(c for c in out.columns if c not in first))


def nested_results(segments: DataFrame, results: DataFrame, metadata: dict[str, str] | None = None) -> DataFrame:
    """One row a record that has candidates: its facts, its candidates by rank and its coding sequences; ``json`` is all of it as one document.

    A field that the plan lacks is null.  A record's candidates and coding sequences are one row.
    """
    out = _exported(results)
    fields = lambda names, have, of: [(of(c) if c in have else F.lit(None).cast("string")).alias(c) for c in names]
    lists = out.groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.struct(*fields(CANDIDATE, out.columns, F.col)).alias("c")))).alias("_ranked"))
    lists = lists.select("record_id", F.transform("_ranked", lambda x: x["c"]).alias("candidates"))
    if "cds" in segments.columns:
        have = segments.schema["cds"].dataType.elementType.names
        coding = F.transform(F.coalesce("cds", F.array()), lambda c: F.struct(*fields(CODING, have, lambda n: c[n]), F.greatest(F.lit(0), c["end"] - c["start"]).alias("length_nt")))
    else:
        coding = F.array().cast("array<struct<start:int,end:int,strand:string,translation:string,protein_id:string,locus_tag:string,product:string,length_nt:int>>")
    told = F.create_map(*(F.lit(x) for pair in sorted((metadata or {}).items()) for x in pair)) if metadata else F.lit(None).cast("map<string,string>")
    source = F.col("source_file") if "source_file" in segments.columns else F.col("gbk_file") if "gbk_file" in segments.columns else F.lit(None).cast("string")
    whole = segments.withColumn("_coding", coding).join(lists, "record_id").select(
        "record_id", "is_target", F.length("sequence").alias("segment_length_nt"), F.size("_coding").alias("num_annotated_cds"), F.size("candidates").alias("num_candidates"), "candidates",
        F.col("_coding").alias("annotated_cds"), source.alias("source_file"), F.lit("0-based half-open").alias("coordinate_system"), told.alias("pipeline_metadata"),
    )
    return whole.withColumn("json", F.to_json(F.struct(*whole.columns), {"ignoreNullFields": "false"}))


def segment_summary(segments: DataFrame) -> DataFrame:
    return segments.select("record_id", "gbk_file", F.length("sequence").alias("length_nt"), F.size("cds").alias("num_cds"), "is_target")


def list_sets(spark: SparkSession, path: str, pattern: str = "*", protected: tuple[str, ...] = PROTECTED) -> DataFrame:
    """(name, path, bytes) of the files of a folder whose base name isn't protected; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return files.select(name.alias("name"), "path", F.col("length").alias("bytes")).filter(~F.col("name").isin(*protected))


#: Columns that a table of loci must have.
LOCI = ["gene_name", "match_type", "orf_strand", "orf_frame", "bin_start", "bin_end"]


def read_loci(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Loci of a TSV, the highest z_score first where there is one, ``limit`` of them; a missing column is an error.

    Bins are called as in the conservation test.  Rows that tie in z keep the order of their keys.
    """
    raw = spark.read.csv(path, sep="\t", header=True)
    if missing := sorted(set(LOCI) - set(raw.columns)):
        raise ValueError(f"loci without {', '.join(missing)}")
    z = F.expr("try_cast(z_score as double)") if "z_score" in raw.columns else F.lit(None).cast("double")
    own = raw.select("gene_name", "match_type", "orf_strand", F.col("orf_frame").cast("int"), F.col("bin_start").cast("int").alias("bin_first"), F.col("bin_end").cast("int").alias("bin_last"), z.alias("z_score"))
    own = own.orderBy(F.when(F.isnan("z_score"), None).otherwise(F.col("z_score")).desc_nulls_last(), "gene_name", "match_type", "orf_strand", "orf_frame", "bin_first", "bin_last")
    return own if limit is None else own.limit(limit)


def sequences_by_accession(entries: DataFrame, key: str = "pep") -> DataFrame:
    """(accession, sequences, n): the sequences of every accession that headers name by ``key=``, in order.  ``entries``: id, sequence."""
    named = entries.withColumn("accession", normalise_accession(header_token(F.col("id"), key))).filter("accession <> ''")
    return named.groupBy("accession").agg(F.sort_array(F.collect_list("sequence")).alias("sequences"), F.count("*").alias("n"))


def with_table_rows(fasta: DataFrame, table: DataFrame, accession: str = "accession") -> DataFrame:
    """FASTA records with their row of a table by accession; a record without one keeps nulls.  ``fasta``: id, sequence."""
    own = fasta.withColumn("_a", F.element_at(F.split("id", r"\s+"), 1))
    once = table.dropDuplicates([accession]).withColumnRenamed(accession, "_b")
    joined = own.join(once, F.col("_a") == F.col("_b"), "left")
    return joined.select(F.col("_a").alias("accession"), "sequence", F.length("sequence").alias("sequence_length"), *(c for c in once.columns if c != "_b"))


def matched_accessions(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """One row: accessions that were wanted, and those of them that were found."""
    every = wanted.select("accession").distinct().join(found.select("accession").distinct().withColumn("_f", F.lit(1)), "accession", "left")
    return every.agg(F.count("*").alias("wanted"), F.count("_f").alias("matched"))


def write_benchmark(ranks: DataFrame, held_out: DataFrame, summary: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A benchmark's three outputs: ranks by locus and held-out candidates as TSV, the summary as JSON."""
    ranks.write.mode(mode).csv(f"{path}/holdout_topk", sep="\t", header=True)
    held_out.write.mode(mode).csv(f"{path}/holdout_candidates", sep="\t", header=True)
    summary.write.mode(mode).json(f"{path}/holdout_summary")


def write_core_benchmark(summary: DataFrame, cases: DataFrame, misses: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The core benchmark's three outputs, by variant: the summary as JSON, cases and misses as TSV."""
    summary.write.mode(mode).json(f"{path}/core_summary")
    cases.write.mode(mode).partitionBy("variant").csv(f"{path}/core_cases", sep="\t", header=True)
    misses.write.mode(mode).partitionBy("variant").csv(f"{path}/core_misses", sep="\t", header=True)


def write_selection(selection: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Selected candidates as JSON lines; FASTA goes through ``write_fasta``."""
    selection.write.mode(mode).json(path)
