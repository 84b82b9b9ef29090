"""Sequence functions as native columns.  Coordinates are 0-based and half open."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard code's amino acids, codons in TCAG order (index 16 b1 + 4 b2 + b3).
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: Starts and stops of the bacterial code.
STARTS, STOPS, ALT_STARTS = ("ATG", "GTG", "TTG"), ("TAA", "TAG", "TGA"), ("GTG", "TTG")
#: Kyte-Doolittle hydropathy.
HYDROPATHY = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5,
    "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}
#: Bjellqvist pK of side chains and ends, and of ends by their residue.
PK_POSITIVE = {"K": 10.0, "R": 12.0, "H": 5.98}
PK_NEGATIVE = {"D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}
PK_N, PK_C = 7.5, 3.55
PK_N_BY_RESIDUE = {"A": 7.59, "M": 7.0, "S": 6.93, "P": 8.36, "T": 6.82, "V": 7.44, "E": 7.7}
PK_C_BY_RESIDUE = {"D": 4.55, "E": 4.75}


_BASE = np.full(128, 4, np.uint8)
for _k, _letter in enumerate("TCAG"):
    _BASE[ord(_letter)] = _BASE[ord(_letter.lower())] = _k
#: Amino acids by codon number; a codon with another letter is X.
_AMINO = np.array([ord(AMINO[16 * a + 4 * b + c] if max(a, b, c) < 4 else "X") for a in range(5) for b in range(5) for c in range(5)], np.uint8)


def bases(text: str) -> np.ndarray:
    """Letters as numbers: T, C, A and G, in either case, from 0, and 4 for any other."""
    return _BASE[np.frombuffer(text.encode(), np.uint8)] if text.isascii() else _BASE[np.minimum(np.frombuffer(text.encode("utf-32-le"), "<u4"), 127)]


def codon_numbers(letters: np.ndarray) -> np.ndarray:
    """The number of the codon that begins at each base but the last two."""
    own = letters.astype(np.int16)
    return 25 * own[:-2] + 5 * own[1:-1] + own[2:]


def amino_acid(codon: Column, unknown: str = "X", stop: str = "*") -> Column:
    """One codon's amino acid: two lookups in short constant strings, no map."""
    at = [F.instr(F.lit("TCAG"), F.substring(codon, k, 1)) for k in (1, 2, 3)]
    whole = (F.length(codon) == 3) & (at[0] > 0) & (at[1] > 0) & (at[2] > 0)
    letter = F.substr(F.lit(AMINO), 16 * (at[0] - 1) + 4 * (at[1] - 1) + at[2], F.lit(1))
    if stop != "*":
        letter = F.when(letter == "*", stop).otherwise(letter)
    return F.when(whole, letter).otherwise(F.lit(unknown))


def codons(dna: Column) -> Column:
    """Whole codons from the first base on; a rest of one or two bases is left."""
    return F.regexp_extract_all(dna, F.lit("(?s)..."), F.lit(0))


def codon_residues(dna: Column) -> Column:
    """Amino acids by codon for conservation work: stops and unknown codons are X."""
    return F.transform(codons(F.upper(dna)), lambda c: amino_acid(c, stop="X"))


def translate_bacterial(dna: Column) -> Column:
    """Protein of a coding sequence: upper case, under three bases "", one closing stop dropped, GTG or TTG first is M."""

    def translated(s: pa.Array) -> pa.Array:
        given = s.to_pylist()
        texts = [x if x is None or x.isascii() else x.upper() for x in given]
        size = np.array([len(x or "") // 3 * 3 for x in texts], int)
        letters = _AMINO[codon_numbers(bases("".join(x[:n] for x, n in zip(texts, size.tolist(), strict=True) if x)))[::3]]
        whole, out, at = letters.tobytes().decode(), [], 0
        for x, n in zip(texts, (size // 3).tolist(), strict=True):
            protein = whole[at : at + n].removesuffix("*")
            at += n
            out.append(None if x is None else "M" + protein[1:] if protein and x[:3].upper() in ALT_STARTS else protein)
        return pa.array(out, pa.string())

    return F.arrow_udf(translated, "string")(dna)


def is_alt_start(codon: Column) -> Column:
    return F.upper(codon).isin(*ALT_STARTS)


def reverse_complement(dna: Column) -> Column:
    """Case is kept; ambiguity letters have their complements."""
    return F.reverse(F.translate(dna, "ACGTUacgtuRYKMBDHVrykmbdhv", "TGCAAtgcaaYRMKVHDByrmkvhdb"))


def frame_offset(frame: Column, strand: Column, mode: Column | str = "zero") -> Column:
    """Bases to skip: minus frames and mode ``one`` count from 1, mode ``zero`` from 0."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    return F.when((strand == "-") | (mode == "one"), F.pmod(F.abs(frame) - 1, F.lit(3))).otherwise(F.pmod(frame, F.lit(3))).cast("int")


def translate_window(dna: Column, strand: Column, frame: Column, mode: Column | str = "zero") -> Column:
    """Translation of a window, reversed for the minus strand, from its frame's offset on; stops are *."""
    own = F.when(strand == "-", reverse_complement(dna)).otherwise(dna)
    body = F.upper(F.substr(own, frame_offset(frame, strand, mode) + 1))
    return F.array_join(F.transform(codons(body), lambda c: amino_acid(c)), "")


def residue_count(seq: Column, letters: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def residue_ratio(seq: Column, letter: str) -> Column:
    return F.when(F.length(seq) > 0, residue_count(seq, letter) / F.length(seq)).otherwise(F.lit(0.0))


def hydropathy_mean(seq: Column) -> Column:
    """Mean Kyte-Doolittle value; unknown residues count 0, an empty sequence is 0."""
    tenths = sum((F.lit(round(10 * v)) * residue_count(seq, k) for k, v in sorted(HYDROPATHY.items())), F.lit(0))
    return F.when(F.length(seq) > 0, tenths / (10 * F.length(seq))).otherwise(F.lit(0.0))


def net_charge(seq: Column, ph: float = 7.0) -> Column:
    """Charge at a pH from residue counts and end groups; an empty sequence has none."""
    end_pk = lambda end, table, usual: 1.0 * F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[end], F.lit(usual))
    plus = sum((residue_count(seq, k) * F.lit(1 / (10 ** (ph - v) + 1)) for k, v in PK_POSITIVE.items()), 1 / (F.pow(F.lit(10.0), F.lit(ph) - end_pk(F.substring(seq, 1, 1), PK_N_BY_RESIDUE, PK_N)) + 1))
    minus = sum((residue_count(seq, k) * F.lit(1 / (10 ** (v - ph) + 1)) for k, v in PK_NEGATIVE.items()), 1 / (F.pow(F.lit(10.0), end_pk(F.substring(seq, -1, 1), PK_C_BY_RESIDUE, PK_C) - F.lit(ph)) + 1))
    return F.when(F.length(seq) > 0, plus - minus).otherwise(F.lit(0.0))


#: Charge that each residue's side chain adds, at pH 7.
SIDE_CHARGE = {**{k: 1 / (10 ** (7.0 - v) + 1) for k, v in PK_POSITIVE.items()}, **{k: -1 / (10 ** (v - 7.0) + 1) for k, v in PK_NEGATIVE.items()}}


def end_charge(first: Column, last: Column, ph: float = 7.0) -> Column:
    """Charge of the two ends of a sequence that has residues, by its first and last one."""
    n_end, c_end = F.lit(1 / (10 ** (ph - PK_N) + 1)), F.lit(-1 / (10 ** (PK_C - ph) + 1))
    for k, v in PK_N_BY_RESIDUE.items():
        n_end = F.when(first == k, F.lit(1 / (10 ** (ph - v) + 1))).otherwise(n_end)
    for k, v in PK_C_BY_RESIDUE.items():
        c_end = F.when(last == k, F.lit(-1 / (10 ** (v - ph) + 1))).otherwise(c_end)
    return n_end + c_end


def running_sums(seq: Column, weights: dict[str, float]) -> Column:
    """Array of n + 1 sums of the letters' weights: of the first 0, 1, ..., n letters.  Other letters weigh nothing; null counts as empty."""
    table = np.zeros(128)
    for k, v in weights.items():
        table[ord(k)] = v

    def sums(s: pa.Array) -> pa.Array:
        texts = [x or "" for x in s.to_pylist()]
        own = table[np.minimum(np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"), 127)]
        ends = np.cumsum([0, *map(len, texts)])
        out = np.zeros(len(own) + len(texts))
        for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):  # each from its own start: sums don't depend on a batch's other rows
            np.cumsum(own[a:b], out=out[a + i + 1 : b + i + 1])
        return pa.ListArray.from_arrays(pa.array((ends + np.arange(len(ends))).astype(np.int32)), pa.array(out))

    return F.arrow_udf(sums, "array<double>")(seq)


def interval_distance(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Gap between half-open intervals; touching or overlapping is 0."""
    return F.greatest(F.lit(0), s2 - e1, s1 - e2)


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.least(e1, e2) > F.greatest(s1, s2)


def window_around(start: Column, end: Column, length: Column, flank: int) -> tuple[Column, Column]:
    return F.greatest(F.lit(0), start - flank), F.least(length, end + flank)


def bins_of(gene_start: Column, gene_end: Column, orf_start: Column, orf_end: Column, bins: int) -> Column:
    """struct(first, last) bin of the overlap with a gene, null without one; bin = int((x - gene_start) / length * bins)."""
    s, e, n = F.greatest(gene_start, orf_start), F.least(gene_end, orf_end), gene_end - gene_start
    one = lambda x: F.least(F.lit(bins - 1), F.greatest(F.lit(0), ((x - gene_start) / n * bins).cast("int")))
    return F.when((n > 0) & (e > s), F.struct(one(s).alias("first"), one(e - 1).alias("last")))


def window_of_bins(first: Column, last: Column, length: Column, bins: int) -> Column:
    """struct(start, end) of bases whose bin lies in first..last: the inverse of the bins, by integer ceiling."""
    up = lambda x: F.floor((x * length + bins - 1) / bins).cast("int")
    return F.struct(F.greatest(F.lit(0), F.least(length, up(first))).alias("start"), F.greatest(F.lit(0), F.least(length, up(last + 1))).alias("end"))


def p_value(at_least: Column, n: Column) -> Column:
    """Empirical (ge + 1) / (n + 1); null without replicates."""
    return F.when(n > 0, (at_least + 1) / (n + 1))


def z_score(observed: Column, mean: Column, std: Column) -> Column:
    return F.when(std > 0, (observed - mean) / std)


def l2_normalise(vector: Column) -> Column:
    """Unit vector of doubles; the zero vector stays."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(l2_normalise(a), l2_normalise(b))


def masked_mean(rows: Column, mask: Column) -> Column:
    """Mean of the vectors whose mask is true, by component; the divisor is at least 1."""
    kept = F.filter(F.arrays_zip(rows.alias("v"), mask.alias("m")), lambda x: x["m"])
    width = F.size(F.element_at(rows, 1))
    zero = F.transform(F.sequence(F.lit(1), width), lambda _: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda acc, x: F.zip_with(acc, x["v"], lambda p, q: p + q.cast("double")))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))


def _blake2b(s: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else hashlib.blake2b(x.encode(), digest_size=16).hexdigest() for x in s], index=s.index, dtype="object")


def peptide_digest(seq: Column) -> Column:
    """BLAKE2b-128 in hex, which the JVM lacks: a typed Arrow UDF.  Joins inside the library use the sequence itself."""
    return F.pandas_udf(_blake2b, "string")(seq)
