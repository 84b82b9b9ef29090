"""GenBank: a splittable reader by records, parsed in the executors."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandforge.operators.orf import PRODUCT, dedupe_record_ids

EXTENSIONS = "*.{gb,gbk,gbff,genbank}"
FEATURE = "struct<type:string,start:int,end:int,strand:string,ordinal:int,qualifiers:map<string,array<string>>>"
SCHEMA = f"gbk_file string, record_index int, record_id string, sequence string, features array<{FEATURE}>, corrupt string"
_NUMBER = re.compile(r"[<>]?(\d+)")
_KEY = re.compile(r"^ {5}(\S+)\s+(.*)$")


def location(text: str) -> tuple[int, int, str] | None:
    """Outer span, 0-based half open, and strand of a location; of mixed strands it is ?."""
    numbers = [int(x) for x in _NUMBER.findall(re.sub(r"[A-Za-z_][\w.]*:", "", text))]
    if not numbers:
        return None
    inner = re.sub(r"complement\((?:[^()]|\([^()]*\))*\)", "", text)
    flipped = "complement" in text
    mixed = flipped and bool(_NUMBER.search(inner))
    return min(numbers) - 1, max(numbers), "?" if mixed else "-" if flipped else "+"


def _feature(kind: str, lines: list[str], ordinal: int) -> tuple | None:
    split = next((i for i, x in enumerate(lines) if x.startswith("/")), len(lines))
    place = location("".join(lines[:split]))
    if place is None:
        return None
    qualifiers: dict[str, list[str]] = {}
    name = None
    for x in lines[split:]:
        if x.startswith("/") and (name is None or not open_quote):
            name, eq, value = x[1:].partition("=")
            qualifiers.setdefault(name, []).append(value if eq else "")
        elif name is not None:
            glue = "" if name == "translation" else " "
            qualifiers[name][-1] += glue + x
        open_quote = name is not None and qualifiers[name][-1].count('"') % 2 == 1
    clean = {k: [v.strip().removeprefix('"').removesuffix('"').replace('""', '"') for v in vs] for k, vs in qualifiers.items()}
    return kind, *place, ordinal, clean


def parse_genbank(text: str, limit: int | None = None) -> Iterator[tuple[int, str, str, list[tuple]]]:
    """(index from 1, id, sequence, features) of a file's records; the id is the version, else the accession, else the locus."""
    index = 0
    for chunk in re.split(r"^//[ \t]*$", text, flags=re.MULTILINE):
        if not chunk.strip():
            continue
        head = re.search(r"^LOCUS\s+(\S+)", chunk, re.MULTILINE)
        if head is None:
            raise ValueError("no LOCUS line")
        names = [m[1] for k in ("VERSION", "ACCESSION") if (m := re.search(rf"^{k}\s+(\S+)", chunk, re.MULTILINE))]
        origin = re.search(r"^ORIGIN.*?$(.*)", chunk, re.MULTILINE | re.DOTALL)
        sequence = re.sub(r"[^A-Za-z]", "", origin[1]).upper() if origin else ""
        features, kind, lines = [], None, []
        table = re.search(r"^FEATURES.*?$(.*?)(?=^\S|\Z)", chunk, re.MULTILINE | re.DOTALL)
        for row in [*(table[1].split("\n") if table else []), "     end"]:
            m = _KEY.match(row) if row != "     end" else None
            if m or row == "     end":
                if kind and (f := _feature(kind, lines, len(features))):
                    features.append(f)
                kind, lines = (m[1], [m[2].strip()]) if m else (None, [])
            elif row.strip():
                lines.append(row.strip())
        index += 1
        yield index, (names or [head[1]])[0], sequence, features
        if limit is not None and index >= limit:
            return


def read_genbank(spark: SparkSession, path: str | list[str], record_limit: int | None = None, recursive: bool = False, pattern: str = EXTENSIONS) -> DataFrame:
    """One row a record of the files whose names match ``pattern``; a record that can't be parsed gives a row with its error in ``corrupt``.

    Files come through Spark's text reader (any store it knows) with the record's end as the line's, so a large file is read by
    many tasks, each from the first record that begins in its part, and only a single record must fit in a row.  A line that
    begins with // ends a record.  ``record_limit`` keeps the first records of each file; a task parses no more of its part.
    """
    texts = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).text(path, lineSep="\n//")
    part = F.struct(*(F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_block_start", "file_block_length", "file_size")))
    texts = texts.select("value", part.alias("part")).select(F.make_valid_utf8("value").alias("value"), "part.*").filter(F.rlike("value", F.lit(r"\S")))
    found = texts.select("file_path", "file_block_start", "value").mapInPandas(lambda batches: _records(batches, record_limit), f"file_block_start long, {SCHEMA}")
    # a part of a file that isn't the first counts on from the records before it
    counts = texts.filter(F.col("file_block_length") < F.col("file_size")).groupBy("file_path", "file_block_start").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1))
    shift = counts.select(F.col("file_path").alias("_path"), F.col("file_block_start").alias("_start"), F.coalesce(before, F.lit(0)).alias("_before")).filter("_start > 0")
    out = found.join(shift, (F.col("gbk_file") == F.col("_path")) & (F.col("file_block_start") == F.col("_start")), "left")
    out = out.withColumn("record_index", (F.col("record_index") + F.coalesce("_before", F.lit(0))).cast("int"))
    if record_limit is not None:
        out = out.filter(F.col("record_index") <= record_limit)
    return out.select("gbk_file", "record_index", "record_id", "sequence", "features", "corrupt")


def _records(batches: Iterator[pd.DataFrame], limit: int | None) -> Iterator[pd.DataFrame]:
    """The records of a task's parts of files, numbered from 1 within each part."""
    keys = ("type", "start", "end", "strand", "ordinal", "qualifiers")
    part, n = None, 0
    for pdf in batches:
        rows = []
        for name, start, text in zip(pdf["file_path"], pdf["file_block_start"], pdf["value"], strict=True):
            n = n + 1 if part == (name, start) else 1
            part = name, start
            if limit is not None and n > limit:
                continue
            try:
                _, key, sequence, features = next(parse_genbank(text))
                rows.append((start, name, n, key, sequence, [dict(zip(keys, x, strict=True)) for x in features], None))
            except ValueError as e:
                rows.append((start, name, n, None, None, [], str(e)))
        yield pd.DataFrame(rows, columns=["file_block_start", "gbk_file", "record_index", "record_id", "sequence", "features", "corrupt"])


def segments(records: DataFrame, word: str) -> DataFrame:
    """record_id, index, sequence, cds, region_ranges, region_source, is_target, gbk_file of sound records; targets are those with a region or cluster whose product has ``word``."""
    value = lambda f, k: F.element_at(F.try_element_at(f["qualifiers"], F.lit(k)), 1)
    cds = F.transform(F.filter("features", lambda f: f["type"] == "CDS"), lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), f["strand"].alias("strand"), *(value(f, k).alias(n) for k, n in (("translation", "translation"), ("protein_id", "protein_id"), ("locus_tag", "locus_tag"), ("product", "product"), ("gene", "gene_name")))))
    products = lambda f: F.coalesce(F.try_element_at(f["qualifiers"], F.lit("product")), F.try_element_at(f["qualifiers"], F.lit("products")), F.array().cast("array<string>"))
    mine = F.filter("features", lambda f: f["type"].isin("region", "cluster") & F.exists(products(f), lambda p: F.contains(F.lower(p), F.lit(word))) & (f["end"] > f["start"]))
    out = records.filter("corrupt is null").withColumn("cds", cds).withColumn("region_ranges", F.transform(mine, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"))))
    out = out.withColumn("is_target", F.size("region_ranges") > 0).withColumn("region_source", F.when(F.col("is_target"), PRODUCT))
    return out.select("record_id", F.col("record_index").alias("index"), "sequence", "cds", "region_ranges", "region_source", "is_target", "gbk_file")


def folder_segments(spark: SparkSession, path: str, word: str, **options) -> DataFrame:
    """All segments of a folder by file and record, with unique ids."""
    own = segments(read_genbank(spark, path, **options), word).withColumn("_o", F.struct("gbk_file", "index"))
    return dedupe_record_ids(own, "_o").drop("_o")


def cds_features(records: DataFrame) -> DataFrame:
    """Coding sequences as rows: gbk_file, record_id, start, end, strand, codon_start, genomic and names."""
    f = records.filter("corrupt is null").select("gbk_file", "record_id", "sequence", F.explode(F.filter("features", lambda x: x["type"] == "CDS")).alias("f"))
    value = lambda k: F.element_at(F.try_element_at("f.qualifiers", F.lit(k)), 1).alias(k)
    return f.select("gbk_file", "record_id", "f.start", "f.end", "f.strand", value("codon_start"), F.substr("sequence", F.col("f.start") + 1, F.col("f.end") - F.col("f.start")).alias("genomic"), *(value(k) for k in ("gene", "locus_tag", "protein_id", "product")))
