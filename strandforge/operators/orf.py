"""Exhaustive six-frame open reading frames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandforge.functions.seq import STARTS, STOPS, bases, codon_numbers, reverse_complement, translate_bacterial
from strandforge.functions.text import candidate_id
from strandforge.operators.ordered import numbered

#: Bases whose starts one tile owns.
TILE = 1200
_STARTS, _STOPS = (codon_numbers(bases("".join(x)))[::3] for x in (STARTS, STOPS))
#: Source of region ranges that a product annotation tells.
PRODUCT = "product"


def _tiles(own: Column, tile: int, reach: int) -> Column:
    """struct(at, piece) of consecutive stretches of ``tile`` bases, each with the next one's first ``reach``."""
    after = F.slice(own, 2, F.greatest(F.lit(0), F.size(own) - 1))
    return F.transform(F.arrays_zip(own.alias("c"), after.alias("d")), lambda x, k: F.struct((k * tile).alias("at"), F.concat(x["c"], F.coalesce(F.substr(x["d"], F.lit(1), F.lit(reach)), F.lit(""))).alias("piece")))


def _frames(piece: Column, tile: int, min_aa: int, max_aa: int) -> Column:
    """struct(f, i, n): in frame f of a piece, a start at codon i and the codons before its stop."""

    def found(s: pa.Array) -> pa.Array:
        texts = [x or "" for x in s.to_pylist()]
        # upper case may be longer than a letter that isn't ASCII, so such a piece's frames are read one by one
        odd = [k for k, x in enumerate(texts) if not x.isascii()]
        own = [x if x.isascii() else "" for x in texts] + [texts[k][f:].upper() for k in odd for f in range(3)]
        row = np.r_[np.arange(len(texts)), np.repeat(np.array(odd, int), 3)]
        shift = np.r_[np.zeros(len(texts), int), np.tile(np.arange(3), len(odd))]
        letters, ends = bases("".join(own)), np.cumsum([0, *map(len, own)])
        of = np.repeat(np.arange(len(own)), np.diff(ends))[:-2]
        codon = np.where(of == np.repeat(np.arange(len(own)), np.diff(ends))[2:], codon_numbers(letters), -1)
        at = np.arange(len(codon)) - ends[of]
        # by piece and frame, and by place within these: the next stop is the one that follows a start
        key = (of * 3 + at % 3) * (len(letters) + 1) + at
        stops = np.sort(key[np.isin(codon, _STOPS)])
        begun = np.flatnonzero(np.isin(codon, _STARTS) & (at + shift[of] < tile) & ((of < len(texts)) | (at % 3 == 0)))
        after = np.searchsorted(stops, key[begun])
        begun, after = begun[after < len(stops)], after[after < len(stops)]
        n = stops[after] - key[begun]
        good = (stops[after] // (len(letters) + 1) == key[begun] // (len(letters) + 1)) & (n >= 3 * min_aa) & (n <= 3 * max_aa + 2)
        begun, n = begun[good], n[good] // 3
        rows = row[of[begun]]
        order = np.argsort(rows, kind="stable")
        begun, n, rows = begun[order], n[order], rows[order]
        fields = [(at[begun] % 3 + shift[of[begun]]), at[begun] // 3, n]
        hits = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in fields], ["f", "i", "n"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(len(texts) + 1)).astype(np.int32)), hits)

    return F.arrow_udf(found, "array<struct<f:int,i:int,n:int>>")(piece)


def orfs(windows: DataFrame, min_aa: int = 20, max_aa: int = 120, tile: int = TILE, strands: tuple[str, ...] = ("+", "-")) -> DataFrame:
    """One row for every start codon whose next in-frame stop lies min_aa to max_aa codons on.

    ``windows`` has ``sequence`` and ``window_start`` (of the sequence in its record) beside columns that are carried.
    A sequence is cut into tiles of starts; each tile sees far enough beyond its end for the longest open
    frame, so the result is exact, no row below carries a whole contig, and nothing is shuffled; all steps are linear in the
    bases.  The stop is not part of a frame and a start without a stop gives none.  Adds strand, frame (0..2, or
    -1..-3), nt_start (within the strand), genomic_start, genomic_end, dna (in its own case), start_codon, aa_len, nt_len.
    """
    carried = [c for c in windows.columns if c != "sequence"]
    reach = 3 * (max_aa + 2)
    tile = max(tile, reach)
    both = windows.select(*carried, F.length("sequence").alias("_len"), F.explode(F.array(*(F.struct(F.lit(s).alias("strand"), (F.col("sequence") if s == "+" else reverse_complement(F.col("sequence"))).alias("own")) for s in strands))).alias("_s"))
    parts = both.filter("_len >= 3").select(*carried, "_len", "_s.strand", F.regexp_extract_all("_s.own", F.lit(f"(?s).{{1,{tile}}}"), F.lit(0)).alias("_parts"))
    tiles = parts.select(*carried, "_len", "strand", F.explode(_tiles(F.col("_parts"), tile, reach)).alias("_t"))
    tiles = tiles.select(*carried, "_len", "strand", F.col("_t.at").alias("_at"), F.col("_t.piece").alias("_piece"))
    found = tiles.select("*", F.explode(_frames(F.col("_piece"), tile, min_aa, max_aa)).alias("_o"))
    place = F.col("_o.i") * 3 + F.col("_o.f")
    nt_start, nt_len = F.col("_at") + place, F.col("_o.n") * 3
    frame = nt_start % 3
    minus = F.col("strand") == "-"
    return found.select(
        *carried,
        "strand",
        F.when(minus, -(frame + 1)).otherwise(frame).cast("int").alias("frame"),
        nt_start.cast("int").alias("nt_start"),
        (F.col("window_start") + F.when(minus, F.col("_len") - nt_start - nt_len).otherwise(nt_start)).cast("int").alias("genomic_start"),
        (F.col("window_start") + F.when(minus, F.col("_len") - nt_start).otherwise(nt_start + nt_len)).cast("int").alias("genomic_end"),
        F.substr("_piece", place + 1, nt_len).alias("dna"),
        F.upper(F.substr("_piece", place + 1, F.lit(3))).alias("start_codon"),
        F.col("_o.n").cast("int").alias("aa_len"),
        nt_len.cast("int").alias("nt_len"),
    )


def with_protein(found: DataFrame) -> DataFrame:
    """Adds protein and is_alt_start; the length filter came before, so only kept frames are translated."""
    return found.withColumn("protein", translate_bacterial(F.col("dna"))).withColumn("is_alt_start", F.col("start_codon").isin("GTG", "TTG"))


def with_candidate_ids(found: DataFrame, record: str = "record_id", bucket: int | None = None) -> DataFrame:
    """Numbers a record's frames over its windows: forward before reverse, by frame, stop and start.

    With a ``bucket`` of bases, records as long as a chromosome are numbered by many tasks: each strand, frame and stretch of stops is
    one task's, and counts of those before it give its first number.  The ids are the same; the frames are then read twice.
    """
    stop = F.col("nt_start") + F.col("nt_len")
    if bucket is None:
        order = Window.partitionBy(record).orderBy("window_start", "strand", F.abs("frame"), stop, "nt_start")
        return found.withColumn("candidate_id", candidate_id(F.col(record), F.row_number().over(order)))
    coarse = [F.col("window_start"), F.col("strand"), F.abs("frame"), F.floor(stop / bucket)]
    return numbered(found, [record], coarse, [stop, F.col("nt_start")], "_n").withColumn("candidate_id", candidate_id(F.col(record), F.col("_n"))).drop("_n")


def windows_of(segments: DataFrame, restrict: bool = False) -> DataFrame:
    """The parts of segments to search: their region ranges, unless they come from product annotation and aren't restricted to.

    ``segments``: record_id, sequence, region_ranges (array of struct start, end), region_source.
    """
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("sequence").alias("end")))
    use = (F.size(F.coalesce("region_ranges", F.array().cast("array<struct<start:int,end:int>>"))) > 0) & ~((F.coalesce("region_source", F.lit("")) == PRODUCT) & ~F.lit(restrict))
    one = segments.withColumn("_w", F.explode(F.when(use, F.col("region_ranges")).otherwise(whole)))
    s, e = F.greatest(F.lit(0), F.col("_w.start")), F.least(F.length("sequence"), F.col("_w.end"))
    keep = [c for c in segments.columns if c not in ("sequence", "region_ranges", "region_source")]
    return one.filter(e > s).select(*keep, F.substr("sequence", s + 1, e - s).alias("sequence"), s.cast("int").alias("window_start"))


def indexed_regions(features: DataFrame, word: str) -> DataFrame:
    """Region and cluster features whose product has the word, numbered from 1 by record; an empty interval takes no number."""
    mine = features.filter(F.col("type").isin("region", "cluster") & F.exists("products", lambda p: F.contains(F.lower(p), F.lit(word))) & (F.col("end") > F.col("start")))
    number = F.row_number().over(Window.partitionBy("gbk_file", "record_id").orderBy("ordinal"))
    return mine.withColumn("region_index", number).select("record_id", "gbk_file", "region_index", F.col("start").alias("region_start"), F.col("end").alias("region_end"))


def region_orfs(regions: DataFrame, records: DataFrame, min_aa: int = 20, max_aa: int = 120) -> DataFrame:
    """Open reading frames of every region of every record."""
    joined = regions.join(records.select("gbk_file", "record_id", "sequence"), ["gbk_file", "record_id"])
    cut = joined.select("gbk_file", "record_id", "region_index", F.substr("sequence", F.col("region_start") + 1, F.col("region_end") - F.col("region_start")).alias("sequence"), F.col("region_start").alias("window_start"))
    return with_protein(orfs(cut, min_aa, max_aa))


def dedupe_record_ids(segments: DataFrame, ordinal: str = "index", bucket: int | None = None) -> DataFrame:
    """Trims ids; a blank one becomes segment_<ordinal>, the nth repeat gets __n.

    With a ``bucket`` of (whole-number) ordinals, an id that very many segments share is numbered by many tasks.
    """
    base = F.when(F.trim(F.coalesce("record_id", F.lit(""))) == "", F.concat(F.lit("segment_"), F.col(ordinal).cast("string"))).otherwise(F.trim("record_id"))
    based = segments.withColumn("_base", base)
    if bucket is None:
        named = based.withColumn("_n", F.row_number().over(Window.partitionBy("_base").orderBy(ordinal)))
    else:
        named = numbered(based, ["_base"], [F.floor(F.col(ordinal) / bucket)], [F.col(ordinal)], "_n")
    return named.withColumn("record_id", F.when(F.col("_n") > 1, F.concat("_base", F.lit("__"), F.col("_n").cast("string"))).otherwise(F.col("_base"))).drop("_base", "_n")
