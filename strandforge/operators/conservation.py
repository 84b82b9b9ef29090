"""Alternate-frame conservation against a synonymous-codon permutation null."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandforge.functions.hashes import by_hash, md5_of_pairs
from strandforge.functions.seq import AMINO, bins_of, codon_residues, codons, frame_offset, p_value, reverse_complement, translate_window, window_of_bins, z_score
from strandforge.functions.text import codon_start, first_of
from strandforge.lineage import cut
from strandforge.operators.rules import dealt

LOCUS = ["gene_name", "match_type", "orf_strand", "orf_frame", "bin_first", "bin_last"]


def clean_hits(raw: DataFrame) -> DataFrame:
    """Rows whose coordinates are whole numbers."""
    numbers = ["orf_frame", "gene_start", "gene_end", "orf_start", "orf_end"]
    return raw.withColumns({c: F.expr(f"try_cast({c} as int)") for c in numbers}).dropna(subset=numbers)


def find_hits(orfs: DataFrame, cds: DataFrame) -> DataFrame:
    """Open frames that overlap a coding sequence of their record in another frame or on the other strand.

    Frames meet genes by record and 10 kb cell of position, so a large record is no all-pairs join; a pair is kept in the
    cell of its first common base.
    """
    cell = lambda s, e: F.explode(F.sequence(F.floor(s / 10_000), F.floor((e - 1) / 10_000)))
    o = orfs.select("gbk_file", "record_id", F.col("strand").alias("orf_strand"), F.col("frame").alias("orf_frame"), F.col("genomic_start").alias("orf_start"), F.col("genomic_end").alias("orf_end")).withColumn("_cell", cell(F.col("orf_start"), F.col("orf_end")))
    g = cds.select("gbk_file", "record_id", "gene_name", F.col("strand").alias("gene_strand"), F.col("start").alias("gene_start"), F.col("end").alias("gene_end")).filter("gene_end > gene_start").withColumn("_cell", cell(F.col("gene_start"), F.col("gene_end")))
    both = o.join(g, ["gbk_file", "record_id", "_cell"])
    first = F.greatest("orf_start", "gene_start")
    both = both.filter((F.least("orf_end", "gene_end") > first) & (F.floor(first / 10_000) == F.col("_cell")))
    in_frame = F.when(F.col("gene_strand") == "-", F.pmod(F.col("gene_end") - F.col("orf_end"), F.lit(3)) == 0).otherwise(F.pmod(F.col("orf_start") - F.col("gene_start"), F.lit(3)) == 0)
    kind = F.when(F.col("orf_strand") != F.col("gene_strand"), "antisense").when(~in_frame, "out_of_frame")
    return both.withColumn("match_type", kind).filter("match_type is not null").drop("_cell", "gene_strand")


def locus_keys(hits: DataFrame, bins: int = 20, outside: bool = False) -> DataFrame:
    """Hits by locus, with distinct records; hits outside of their gene are dropped, or kept under null bins."""
    b = bins_of(F.col("gene_start"), F.col("gene_end"), F.col("orf_start"), F.col("orf_end"), bins)
    keyed = hits.withColumn("_b", b).withColumn("bin_first", F.col("_b.first")).withColumn("bin_last", F.col("_b.last"))
    return (keyed if outside else keyed.filter("_b is not null")).groupBy(*LOCUS).agg(F.count("*").alias("hit_events"), F.countDistinct("gbk_file", "record_id").alias("hit_genomes"))


def select_loci(keys: DataFrame, min_genomes: int, limit: int | None) -> DataFrame:
    """Loci seen in enough records; with a ``limit`` the most widespread of them."""
    own = keys.filter(F.col("hit_genomes") >= min_genomes)
    return own if limit is None else own.orderBy(F.desc("hit_genomes"), F.desc("hit_events"), *LOCUS).limit(limit)


def frame_mode(hits: DataFrame) -> DataFrame:
    """One row: ``zero`` where frame 0 is seen, else ``one`` where frame 3 is, else ``zero``."""
    seen = lambda k: F.coalesce(F.bool_or(F.col("orf_frame") == k), F.lit(False))
    return hits.agg(F.when(seen(0), "zero").when(seen(3), "one").otherwise("zero").alias("frame_mode"))


def gene_instances(cds: DataFrame, names: DataFrame | None = None, field: str = "auto") -> DataFrame:
    """Coding sequences as codons: one row an instance, paralogs kept, repeats of the same place dropped.

    ``cds``: gbk_file, record_id, start, end, strand, codon_start, genomic (the span's bases on the plus strand), gene, locus_tag, protein_id, product.
    """
    name = first_of(F.col("gene"), F.col("locus_tag"), F.col("protein_id"), F.col("product")) if field == "auto" else first_of(F.col(field))
    own = cds.withColumn("gene_name", name).filter("gene_name is not null")
    if names is not None:
        own = own.join(names.select("gene_name").distinct(), "gene_name", "left_semi")
    coding = F.when(F.col("strand") == "-", reverse_complement(F.col("genomic"))).otherwise(F.col("genomic"))
    own = own.withColumn("_cds", F.upper(coding)).withColumn("codon_start", codon_start(F.col("codon_start").cast("string")))
    body = F.substr("_cds", F.col("codon_start"))
    own = own.withColumn("cds_prefix", F.left("_cds", F.col("codon_start") - 1)).withColumn("codons", codons(body)).withColumn("aas", codon_residues(body))
    own = own.withColumn("remainder", F.right(body, F.pmod(F.length(body), F.lit(3)))).withColumn("gene_len", F.length("_cds")).withColumn("record_uid", F.concat_ws("::", "gbk_file", "record_id"))
    return own.select("gene_name", "record_uid", "start", "end", "strand", "codon_start", "genomic", "cds_prefix", "codons", "aas", "remainder", "gene_len").dropDuplicates(["record_uid", "start", "end", "strand", "codon_start"])


def locus_windows(loci: DataFrame, instances: DataFrame, bins: int = 20) -> DataFrame:
    """The stretch of every instance of a locus's gene that the locus's bins cover."""
    w = loci.join(instances, "gene_name").withColumn("_w", window_of_bins(F.col("bin_first"), F.col("bin_last"), F.col("gene_len"), bins))
    w = w.filter("_w.end > _w.start").withColumn("rel_start", F.col("_w.start")).withColumn("rel_end", F.col("_w.end"))
    return w.withColumn("window_seq", F.substr("genomic", F.col("rel_start") + 1, F.col("rel_end") - F.col("rel_start"))).drop("_w")


def window_peptide(windows: DataFrame, mode: str = "zero") -> DataFrame:
    return windows.withColumn("peptide", translate_window(F.col("window_seq"), F.col("orf_strand"), F.col("orf_frame"), mode))


def survives(peptide: Column) -> Column:
    return (peptide != "") & ~F.contains(peptide, F.lit("*"))


def agreements(lengths: str) -> Column:
    """Over all pairs of peptides with one residue at one place, the sum of 1 / the shorter length; (len, n) by ascending length."""
    # of two lengths the shorter divides: by ascending length, an entry meets those before it at their own
    step = lambda acc, x: F.struct((acc["t"] + x["n"] * (x["n"] - 1) / 2 / x["len"] + x["n"] * acc["w"]).alias("t"), (acc["w"] + x["n"] / x["len"]).alias("w"))
    return F.aggregate(lengths, F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("w")), step, lambda acc: acc["t"])


def pairwise_identity(peptides: DataFrame, group: list[str]) -> DataFrame:
    """Mean over pairs of (equal residues / the shorter length); null for fewer than two peptides, empty ones don't count.

    No pair is formed: a pair of lengths a <= b agrees at a place wherever both have one residue, so counts by length, place and
    residue give the agreements of all pairs of those lengths at once.
    """
    own = peptides.filter("peptide <> ''").select(*group, F.length("peptide").alias("len"), "peptide")
    letters = F.posexplode(F.transform(F.sequence(F.lit(1), F.col("len")), lambda i: F.substr("peptide", i, F.lit(1)))).alias("at", "residue")
    counts = own.select(*group, "len", letters).groupBy(*group, "at", "residue", "len").agg(F.count("*").alias("n"))
    lengths = counts.groupBy(*group, "at", "residue").agg(F.sort_array(F.collect_list(F.struct("len", "n"))).alias("l"))  # one entry a length
    agreed = lengths.groupBy(*group).agg(F.sum(agreements("l")).alias("agreed"))
    pairs = own.groupBy(*group).agg(F.count("*").alias("n"))
    return pairs.join(agreed, group, "left").select(*group, F.when(F.col("n") > 1, F.col("agreed") / (F.col("n") * (F.col("n") - 1) / 2)).alias("identity")).filter("identity is not null")


def shuffled_codons(codon: Column, aas: Column, *seeds: Column) -> Column:
    """The codons with those of each amino acid dealt anew among its places by seeded hashes.

    The first codon and codons of X stay; the protein and the multiset of codons are kept.  Any engine with MD5 repeats it.
    """
    cells = F.transform(F.arrays_zip(codon.alias("c"), aas.alias("aa")), lambda x, k: F.struct(x["aa"].alias("aa"), (k + 1).alias("i"), x["c"].alias("c")))
    is_free = lambda x: (x["i"] >= 2) & (x["aa"] != "X")
    by_place = F.array_sort(F.filter(cells, is_free))
    hashed = F.transform(F.filter(cells, is_free), lambda x: F.struct(x["aa"].alias("aa"), F.md5(F.concat_ws(":", *(s.cast("string") for s in seeds), x["i"].cast("string"))).alias("h"), x["i"].alias("i"), x["c"].alias("c")))
    moved = F.zip_with(by_place, F.array_sort(hashed), lambda a, b: F.struct(a["i"].alias("i"), b["c"].alias("c")))
    kept = F.transform(F.filter(cells, lambda x: ~is_free(x)), lambda x: F.struct(x["i"].alias("i"), x["c"].alias("c")))
    return F.transform(F.array_sort(F.concat(moved, kept)), lambda x: x["c"])


RESIDUES = "".join(sorted(set(AMINO) | {"X"}))
#: Iterations whose counts travel in one row.
ITERATIONS = 20
#: Instances of a gene that are translated together.
TOGETHER = 256
#: Hashes that are made together: their words stay in a core's cache.
AT_ONCE = 16_000
_COUNTS = "_locus long, block int, len int, seen long, alive binary, counts binary"


def with_windows(instances: DataFrame, loci: DataFrame, bins: int = 20, mode: str = "zero") -> DataFrame:
    """Adds ``w`` to rows of gene_name and gene_len: the windows of all the gene's loci, as struct(locus, minus, skip, start, end).

    A locus is named by a hash of its key.  A gene has as many loci as pairs of bins, frames and kinds allow, so its
    windows fit in a row; genes without a locus go.
    """
    locus = F.struct(F.xxhash64(*LOCUS).alias("locus"), (F.col("orf_strand") == "-").alias("minus"), frame_offset(F.col("orf_frame"), F.col("orf_strand"), mode).alias("skip"), "bin_first", "bin_last")
    of_gene = loci.groupBy("gene_name").agg(F.collect_list(locus).alias("_l"))
    place = lambda x: window_of_bins(x["bin_first"], x["bin_last"], F.col("gene_len"), bins)
    placed = F.transform("_l", lambda x: F.struct(x["locus"].alias("locus"), x["minus"].alias("minus"), x["skip"].alias("skip"), place(x)["start"].alias("start"), place(x)["end"].alias("end")))
    return instances.join(of_gene, "gene_name").withColumn("w", F.filter(placed, lambda x: x["end"] > x["start"])).drop("_l")


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By byte: the complement and the number of a base (99: none); by codon number (64: unknown): the residue."""
    complement = np.arange(256, dtype=np.uint8)
    for x, y in zip(b"ACGTUacgtuRYKMBDHVrykmbdhv", b"TGCAAtgcaaYRMKVHDByrmkvhdb", strict=True):
        complement[x] = y
    place = np.full(256, 99, np.int16)
    for k, c in enumerate("TCAG"):
        place[ord(c)] = place[ord(c.lower())] = k
    return complement, place, np.array([RESIDUES.index(c) for c in AMINO + "X"], np.int8)


def _frames(p: np.ndarray, residue: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of bases' numbers: the residue that begins at each base, and how many stops its frame has before it."""
    acids = residue.take(np.minimum(16 * p[:, :-2] + 4 * p[:, 1:-1] + p[:, 2:], 64))
    n = -(-acids.shape[1] // 3)
    stops = np.zeros((len(p), n + 1, 3), np.int32)
    padded = np.zeros((len(p), n * 3), bool)
    padded[:, : acids.shape[1]] = acids == RESIDUES.index("*")
    np.cumsum(padded.reshape(len(p), n, 3), axis=1, out=stops[:, 1:])
    return acids, stops.reshape(len(p), -1)


class _Tally:
    """Counts by locus and length that a task holds of one gene until they pass ``most`` bytes; ``sent`` gives them as rows and forgets them."""

    def __init__(self, iterations: int, most: int) -> None:
        self.iterations, self.most = iterations, most
        self.gene, self.size = None, 0
        self.held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self.seen: dict[int, int] = {}
        self.waiting: dict[tuple[int, int], list[np.ndarray]] = {}
        self.cells = 0

    def add(self, locus: int, length: int, cells: np.ndarray) -> None:
        """Cells of the flat counts to be raised by one: those of many instances are counted together, which spares most of the cache misses."""
        self.waiting.setdefault((locus, length), []).append(cells)
        self.cells += cells.size
        if self.cells > 2_000_000:
            self.settle()

    def settle(self) -> None:
        for key, cells in self.waiting.items():
            counts = self.held[key][1].reshape(-1)
            np.add(counts, np.bincount(np.concatenate(cells), minlength=counts.size), out=counts, casting="unsafe")
        self.waiting.clear()
        self.cells = 0

    def turn(self, gene: str) -> Iterator[pa.RecordBatch]:
        """Before the rows of a gene: what is held of another one, or is too much, is sent."""
        if self.size > self.most or gene != self.gene:
            yield from self.sent()
            self.gene, self.size = gene, 0

    def of(self, locus: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        if (locus, length) not in self.held:
            self.held[locus, length] = (np.zeros(self.iterations, np.int64), np.zeros((self.iterations, length, len(RESIDUES)), np.int32))
            self.size += self.held[locus, length][1].nbytes
        return self.held[locus, length]

    def sent(self) -> Iterator[pa.RecordBatch]:
        def packed(counts: np.ndarray) -> bytes:
            top = counts.max(initial=0)  # the narrowest numbers that hold them
            return counts.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max)).tobytes()

        self.settle()
        rows = [(locus, block, 0, n, b"", b"") for locus, n in self.seen.items() for block in range(-(-self.iterations // ITERATIONS))]
        for (locus, length), (alive, counts) in self.held.items():
            for block, at in enumerate(range(0, self.iterations, ITERATIONS)):
                rows.append((locus, block, length, 0, packed(alive[at : at + ITERATIONS]), packed(counts[at : at + ITERATIONS])))
        for at in range(0, len(rows), 1000):
            of = [pa.array(x, t) for x, t in zip(zip(*rows[at : at + 1000], strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(of, names=["_locus", "block", "len", "seen", "alive", "counts"])
        self.held.clear()
        self.seen.clear()


def observed_counts(instances: DataFrame, loci: DataFrame, bins: int = 20, mode: str = "zero", held_bytes: int = 128 << 20) -> DataFrame:
    """Rows as of ``null_counts``, of one iteration: the peptides of the instances as they are.

    Instances of one gene and length are translated together, at most some hundreds at once: both strands from every base on are all
    six frames, and running counts of stops by frame tell what survives, so a window is two lookups and a slice.  Only
    counts are shuffled, at most one row a task, locus and length, however many instances a gene has.
    """
    own = instances.select("gene_name", "gene_len", "genomic", F.xxhash64("record_uid", "start", "end", "strand", "codon_start").alias("_h"))
    parts = own.groupBy("gene_name", "gene_len").agg(F.ceil(F.count("*") / TOGETHER).alias("_parts"))
    groups = own.join(parts, ["gene_name", "gene_len"]).groupBy("gene_name", "gene_len", F.pmod("_h", F.col("_parts")).alias("_part")).agg(F.collect_list("genomic").alias("bases"))
    rows = with_windows(groups, loci, bins, mode).select("gene_name", "gene_len", "bases", "w")
    complement, place, residue = _tables()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally(1, held_bytes)
        for b in batches:
            for k in range(b.num_rows):
                gene, n = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                yield from tally.turn(gene)
                w = b.column(3).slice(k, 1).flatten()
                locus, minus, skip, start, end = (w.field(i).to_numpy(zero_copy_only=False) for i in range(5))
                bases = np.frombuffer("".join(b.column(2)[k].as_py()).encode("ascii", "replace"), np.uint8).reshape(-1, n)
                both = [_frames(place[x], residue) for x in (bases, complement[bases[:, ::-1]])] if n >= 3 else []
                first, length = np.where(minus, n - end, start) + skip, (end - start - skip) // 3
                for name, back, s, m in zip(locus.tolist(), minus.tolist(), first.tolist(), length.tolist(), strict=True):
                    tally.seen[name] = tally.seen.get(name, 0) + len(bases)
                    if m < 1:
                        continue
                    acids, stops = both[back]
                    alive = np.flatnonzero(stops[:, s + 3 * m] == stops[:, s])
                    if len(alive):
                        survived, counts = tally.of(name, m)
                        survived[0] += len(alive)
                        of = acids[alive, s : s + 3 * m : 3] + np.arange(m) * len(RESIDUES)
                        counts[0] += np.bincount(of.ravel(), minlength=m * len(RESIDUES)).reshape(m, -1).astype(np.int32)
        yield from tally.sent()

    return dealt(rows).sortWithinPartitions("gene_name").mapInArrow(run, _COUNTS)


def window_stats(loci: DataFrame, instances: DataFrame, bins: int = 20, mode: str = "zero") -> DataFrame:
    """LOCUS, evaluated_instances, observed_survived, survival and identity (null for fewer than two survivors) of every locus that has windows."""
    found = null_rows(observed_counts(instances, loci, bins, mode), 1)
    named = loci.select(F.xxhash64(*LOCUS).alias("_locus"), *LOCUS)
    return named.join(found, "_locus").select(*LOCUS, F.col("seen").alias("evaluated_instances"), F.col("alive").alias("observed_survived"), F.col("null_survival").alias("survival"), F.col("null_identity").alias("identity"))


def null_counts(windows: DataFrame, iterations: int, seed: int = 0, mode: str = "zero", held_bytes: int = 128 << 20) -> DataFrame:
    """``null_of_genes`` for rows of a locus and an instance each, as ``locus_windows`` gives them."""
    instance = ["gene_name", "record_uid", "start", "end", "strand", "codon_start"]
    whole = ["cds_prefix", "codons", "aas", "remainder"]
    window = F.struct(F.xxhash64(*LOCUS).alias("locus"), (F.col("orf_strand") == "-").alias("minus"), frame_offset(F.col("orf_frame"), F.col("orf_strand"), mode).alias("skip"), F.col("rel_start").alias("start"), F.col("rel_end").alias("end"))
    return null_of_genes(windows.groupBy(*instance).agg(*(F.first(c).alias(c) for c in whole), F.collect_list(window).alias("w")), iterations, seed, held_bytes)


def null_of_genes(genes: DataFrame, iterations: int, seed: int = 0, held_bytes: int = 128 << 20) -> DataFrame:
    """(_locus, block, len, seen, alive, counts): residues of the windows' peptides after a shuffle of their genes' codons.

    A row is a locus, a block of ITERATIONS iterations and a length: ``alive`` holds by iteration how many peptides of that length
    survive, ``counts`` by iteration, place and residue how many of them have it there; ``seen`` counts all windows, in rows of
    length 0.  Tasks count before they send, gene by gene, so that a locus's rows don't grow with its gene's instances; a count is
    sent early where a gene's counts pass ``held_bytes``.  The rows of a key are to be summed.

    A gene's instance (``genes`` has one a row, with its windows as of ``with_windows``) is shuffled once an iteration, as by
    ``shuffled_codons`` seeded with seed, gene, record, start and iteration, and every locus of the gene reads its window off the
    same shuffle.  All iterations of an instance are one matrix in Python: column expressions took ten times as long.
    """
    complement, place, residue = _tables()
    numbers = [place, place[complement], place[complement[complement]]]  # of a base, of its complement, and of that one's

    def drawn(row: dict) -> np.ndarray:
        """Which codon stands at each place, a row for each iteration."""
        by_aa: dict[str, list[int]] = {}
        for i, aa in enumerate(row["aas"]):
            if i and aa != "X":
                by_aa.setdefault(aa, []).append(i)
        # equal codons that change places leave the gene as it is
        dealt_anew = [places for places in by_aa.values() if len({row["codons"][i] for i in places}) > 1]
        at = np.broadcast_to(np.arange(len(row["codons"])), (iterations, len(row["codons"]))).copy()
        if dealt_anew:
            to = np.array([i for places in dealt_anew for i in places])
            group = np.repeat(np.arange(len(dealt_anew), dtype=np.uint64), [len(x) for x in dealt_anew])
            lead = f"{seed}:{row['gene_name']}:{row['record_uid']}:{row['start']}:".encode()
            ascending = np.sort(to)
            some = max(1, AT_ONCE // len(to))
            parts = [md5_of_pairs(lead, range(k, min(k + some, iterations + 1)), (ascending + 1).tolist()) for k in range(1, iterations + 1, some)]
            at[:, to] = to[by_hash(np.concatenate(parts, axis=1)[:, :, np.searchsorted(ascending, to)], group)]
        return at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally(iterations, held_bytes)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                for row in b.slice(at, 256).to_pylist():
                    yield from tally.turn(row["gene_name"])
                    codons = np.frombuffer("".join(row["codons"]).encode(), np.uint8).reshape(-1, 3)
                    ends = [np.frombuffer(row[c].encode(), np.uint8) for c in ("cds_prefix", "remainder")]
                    size, back = 3 * len(codons) + len(ends[0]) + len(ends[1]), row["strand"] == "-"
                    places = drawn(row)

                    def strand(minus: bool) -> tuple[np.ndarray, np.ndarray]:  # of the record, not of the gene
                        own = numbers[back + minus]  # noqa: B023
                        coding = own[codons].take(places, axis=0).reshape(iterations, -1)  # noqa: B023
                        whole = np.concatenate([np.broadcast_to(own[ends[0]], (iterations, len(ends[0]))), coding, np.broadcast_to(own[ends[1]], (iterations, len(ends[1])))], axis=1)  # noqa: B023
                        return _frames(whole[:, ::-1] if back != minus else whole, residue)  # noqa: B023

                    read: dict[bool, tuple[np.ndarray, np.ndarray]] = {}
                    for w in row["w"]:
                        locus, minus, end = w["locus"], w["minus"], min(w["end"], size)
                        tally.seen[locus] = tally.seen.get(locus, 0) + 1
                        s, m = (size - end if minus else w["start"]) + w["skip"], (end - w["start"] - w["skip"]) // 3
                        if m < 1:
                            continue
                        if minus not in read:
                            read[minus] = strand(minus)
                        acids, stops = read[minus]
                        alive = np.flatnonzero(stops[:, s + 3 * m] == stops[:, s])
                        if len(alive):
                            tally.of(locus, m)[0][alive] += 1
                            of = acids[alive, s : s + 3 * m : 3] + (np.arange(m) * len(RESIDUES) + alive[:, None] * (m * len(RESIDUES)))
                            tally.add(locus, m, of.ravel())
        yield from tally.sent()

    # a task holds few genes: what it sends are counts by locus of its genes, so with all genes in all tasks they grew with the tasks
    own = genes.select("gene_name", "record_uid", "start", "strand", "cds_prefix", "codons", "aas", "remainder", "w")
    tasks = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return own.repartitionByRange(tasks, "gene_name", F.xxhash64("record_uid", "start", "strand")).sortWithinPartitions("gene_name").mapInArrow(run, _COUNTS)


def null_rows(counts: DataFrame, iterations: int) -> DataFrame:
    """Survival and mean identity of every locus and iteration from ``null_counts``, with the windows seen and those alive.

    Rows of a locus and block come to one task by ascending length and are summed as they come; it holds the sums of one length.
    Identity is that of ``pairwise_identity``: of two lengths the shorter divides, so a length meets the shorter ones at their own.
    """

    def unpacked(data: bytes, shape: tuple[int, ...]) -> np.ndarray:
        return np.frombuffer(data, f"u{len(data) // math.prod(shape)}").reshape(shape)

    def closed(locus: int, block: int, seen: int, alive: np.ndarray, agreed: np.ndarray) -> list[tuple]:
        pairs = alive * (alive - 1) / 2
        identity = agreed / np.maximum(pairs, 1)
        return [(locus, block * ITERATIONS + 1 + i, alive[i] / max(seen, 1), float(identity[i]) if pairs[i] >= 1 else None, seen, int(alive[i])) for i in range(len(alive))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(r.values()) for b in batches for r in b.to_pylist())
        types = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
        batch = lambda done: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), types, strict=True)], names=["_locus", "iteration", "null_survival", "null_identity", "seen", "alive"])
        done: list[tuple] = []
        for (locus, block), of_key in groupby(rows, key=lambda r: r[:2]):
            k = min(ITERATIONS, iterations - block * ITERATIONS)
            seen, alive, agreed, before = 0, np.zeros(k, np.int64), np.zeros(k), np.zeros((k, 0, len(RESIDUES)))
            for m, of_length in groupby(of_key, key=lambda r: r[2]):
                if not m:
                    seen = sum(r[3] for r in of_length)
                    continue
                n = np.zeros((k, m, len(RESIDUES)), np.int64)
                for r in of_length:
                    alive += unpacked(r[4], (k,)).astype(np.int64)
                    n += unpacked(r[5], n.shape).astype(np.int64)
                before = np.concatenate([before, np.zeros((k, m - before.shape[1], len(RESIDUES)))], axis=1)
                agreed += (n * (n - 1) / 2 / m + n * before).sum(axis=(1, 2))
                before += n / m
            done += closed(locus, block, seen, alive, agreed)
            if len(done) > 4000:
                yield batch(done)
                done = []
        if done:
            yield batch(done)

    key = ["_locus", "block"]
    return counts.repartition(*key).sortWithinPartitions(*key, "len").mapInArrow(run, "_locus long, iteration int, null_survival double, null_identity double, seen long, alive long")


def survival(peptides: DataFrame, group: list[str]) -> DataFrame:
    return peptides.groupBy(*group).agg(F.avg(survives(F.col("peptide")).cast("double")).alias("survival"), F.count("*").alias("n"))


def spread(value: str) -> Column:
    """Population deviation; what sums of equal numbers leave by rounding is 0."""
    std = F.stddev_pop(value)
    return F.when(std < 1e-12, F.lit(0.0)).otherwise(std)


def conservation_test(hits: DataFrame, cds: DataFrame, bins: int = 20, min_genomes: int = 2, limit: int | None = 200, iterations: int = 200, seed: int = 0, mode: str = "auto", loci: DataFrame | None = None) -> DataFrame:
    """Survival and identity of every selected locus against its own null, the highest z first.

    ``loci`` names the loci to test (their hits are counted where there are any, else 0); without it they are selected from the
    hits.  ``mode`` zero or one says how frames are numbered, auto reads it from the frames of the loci, or of the hits.
    """
    keys = cut(locus_keys(hits, bins, outside=True))  # the hits are read once
    counted = keys.filter("bin_first is not null")
    if mode == "auto":
        mode = frame_mode(keys if loci is None else loci).first()[0]  # one row
    if loci is None:
        own = select_loci(counted, min_genomes, limit)
    else:
        own = loci.select(*LOCUS).distinct().join(counted, LOCUS, "left").select(*LOCUS, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("hit_events", "hit_genomes")))
    loci = cut(own)  # read by every later step
    instances = cut(gene_instances(cds, loci))
    genes = with_windows(instances, loci, bins, mode)
    observed = cut(window_stats(loci, instances, bins, mode))
    number = F.xxhash64(*LOCUS).alias("_locus")
    records = genes.select("record_uid", F.explode("w.locus").alias("_locus")).distinct().groupBy("_locus").agg(F.count("*").alias("evaluated_records"))
    # a number stands for a locus's names in the rows of the null
    null = null_rows(null_of_genes(genes, iterations, seed), iterations)
    seen = null.drop("seen", "alive").join(observed.select(number, *LOCUS, "survival", "identity"), "_locus")
    seen = seen.repartition("_locus").sortWithinPartitions("_locus", "iteration")  # means and deviations are summed in one order
    at_least = lambda null, own: F.count_if(F.col(null) > F.col(own) - 1e-12)
    stats = seen.groupBy("_locus", *LOCUS).agg(
        F.avg("null_survival").alias("null_survival_mean"), spread("null_survival").alias("null_survival_std"), at_least("null_survival", "survival").alias("ge_survival"), F.count("null_survival").alias("null_samples_survival"),
        F.avg("null_identity").alias("null_mean"), spread("null_identity").alias("null_std"), at_least("null_identity", "identity").alias("ge"), F.count("null_identity").alias("null_n"),
    )
    out = loci.join(observed, LOCUS).join(stats, LOCUS).join(records, "_locus").drop("_locus")
    out = out.withColumn("z_score", z_score(F.col("identity"), F.col("null_mean"), F.col("null_std"))).withColumn("p_value", F.when(F.col("identity").isNotNull(), p_value(F.col("ge"), F.col("null_n"))))
    out = out.withColumn("p_survival", p_value(F.col("ge_survival"), F.col("null_samples_survival"))).drop("ge", "ge_survival")
    return out.orderBy(F.col("z_score").desc_nulls_last(), *LOCUS)


def null_summary(values: DataFrame, group: list[str], value: str) -> DataFrame:
    """Mean and population deviation; one value, and equal ones, have deviation 0."""
    return values.groupBy(*group).agg(F.avg(value).alias("null_mean"), spread(value).alias("null_std"), F.count(value).alias("null_n"))
