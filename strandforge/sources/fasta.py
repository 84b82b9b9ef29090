"""FASTA: a splittable reader and writers, in columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_records(text: Column) -> Column:
    """Array of struct(header, sequence) of a FASTA text; what precedes the first > is no record."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), text), r"\n[\x20\t]*>"), lambda x, i: i > 0)
    return F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "\n", 1)).alias("header"), F.regexp_replace(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 1), r"\s+", "").alias("sequence")))


def read_fasta(spark: SparkSession, path: str | list[str], upper: bool = True, keep_empty: bool = False, full_header: bool = False) -> DataFrame:
    """(id, sequence) of FASTA files; the id is the header's first token.  A record is a line of the reader, so large files are split."""
    lines = spark.read.text(path, lineSep="\n>")
    whole = F.regexp_replace("value", r"\r", "")
    head = F.regexp_replace(F.substring_index(whole, "\n", 1), r"^\s*>", "")
    seq = F.regexp_replace(F.substr(whole, F.length(F.substring_index(whole, "\n", 1)) + 1), r"\s+", "")
    # only a file's first record still has its >; a file that starts with none has junk there, which has no header
    own = lines.select(F.trim(head).alias("header"), (F.upper(seq) if upper else seq).alias("sequence")).filter("header <> ''")
    ids = F.col("header") if full_header else F.element_at(F.split("header", r"\s+"), 1)
    return own.filter((F.col("sequence") != "") | F.lit(keep_empty)).select(ids.alias("id"), "sequence")


def wrap(seq: Column, width: int = 60) -> Column:
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def format_fasta(df: DataFrame, width: int = 60, description: str | None = None) -> DataFrame:
    head = F.concat(F.lit(">"), F.col("id"))
    if description:
        head = F.concat(head, F.when(F.coalesce(F.col(description), F.lit("")) != "", F.concat(F.lit(" "), F.col(description))).otherwise(F.lit("")))
    return df.select(F.concat(head, F.lit("\n"), wrap(F.col("sequence"), width)).alias("value"))


def write_fasta(df: DataFrame, path: str, width: int = 60, description: str | None = None, mode: str = "error") -> None:
    format_fasta(df, width, description).write.mode(mode).text(path)


def interleave_cores(precursors: DataFrame, cores: DataFrame) -> DataFrame:
    """Export order: each precursor, then its cores.  ``precursors``: id, sequence, ord; ``cores``: parent, id, sequence, rank."""
    a = precursors.select("id", "sequence", F.col("ord").alias("_o"), F.lit(0).alias("_k"))
    b = cores.join(precursors.select(F.col("id").alias("parent"), F.col("ord").alias("_o")), "parent").select("id", "sequence", "_o", F.col("rank").alias("_k"))
    return a.unionByName(b).orderBy("_o", "_k").select("id", "sequence")
