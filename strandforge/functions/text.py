"""Identifier, header and label functions as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_letters(x: Column) -> Column:
    return F.upper(F.regexp_replace(x, "[^A-Za-z]", ""))


def strip_upper(x: Column) -> Column:
    return F.upper(F.trim(x))


def leucine(x: Column) -> Column:
    """Isoleucine and leucine as one letter."""
    return F.translate(F.upper(x), "I", "L")


def core_group(core: Column) -> Column:
    return F.concat(F.lit("core_"), F.substring(F.sha1(leucine(core)), 1, 10))


def sequence_hash(seq: Column) -> Column:
    return F.substring(F.sha1(seq), 1, 10)


def slug(x: Column, most: int = 60) -> Column:
    s = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"\s+", "_"), "[^a-z0-9_.-]", ""), 1, most)
    return F.when(s == "", F.lit("unnamed")).otherwise(s)


def normalise_accession(x: Column, unknown_is_empty: bool = True, drop_version: bool = True) -> Column:
    """First token of an accession without its version, no-break spaces counting as spaces; null is empty, ``unknown`` too where asked."""
    s = F.trim(F.translate(F.coalesce(x, F.lit("")), "\u00a0", " "))
    s = F.element_at(F.split(s, r"\s+"), 1)
    if unknown_is_empty:
        s = F.when(F.lower(s) == "unknown", F.lit("")).otherwise(s)
    return F.regexp_replace(s, r"\.[0-9]+$", "") if drop_version else s


def header_token(header: Column, key: str) -> Column:
    """Value of ``key=`` among pipe-separated tokens; null where there is none."""
    s = F.regexp_extract(header, rf"(?:^|\|){key}=([^|]*)", 1)
    return F.when(s != "", s)


def protein_token(header: Column) -> Column:
    return F.coalesce(header_token(header, "prot"), header)


def require_locus(header: Column) -> Column:
    return F.coalesce(header_token(header, "locus"), F.raise_error(F.concat(F.lit("no locus token in "), header)).cast("string"))


def derive_locus(header: Column) -> Column:
    """The protein token, else the header's first word."""
    return F.coalesce(header_token(header, "prot"), F.element_at(F.split(F.trim(header), r"\s+"), 1))


def inject_locus(header: Column, locus: Column) -> Column:
    """A locus token after the first segment, unless there is one."""
    head, tail = F.substring_index(header, "|", 1), F.substr(header, F.length(F.substring_index(header, "|", 1)) + 1)
    return F.when(F.contains(header, F.lit("locus=")), header).otherwise(F.concat(head, F.lit("|locus="), locus, tail))


def accession_or_link(accession: Column, link: Column) -> Column:
    """The accession, or where it is blank the last part of the link's path."""
    part = F.element_at(F.split(F.regexp_replace(F.regexp_replace(F.trim(link), r"[?#].*$", ""), "/+$", ""), "/"), -1)
    own = F.trim(F.coalesce(accession, F.lit("")))
    return F.coalesce(F.when(own != "", own), F.when(part != "", part), F.lit(""))


def core_matches(a: Column, b: Column) -> Column:
    """Equal cores with I and L alike; an empty one matches nothing."""
    return (F.length(a) > 0) & (leucine(a) == leucine(b))


def core_is_suffix(protein: Column, core: Column, slack: int = 0) -> Column:
    p, c = leucine(protein), leucine(core)
    return (F.length(c) > 0) & (p.endswith(c) | F.contains(F.right(p, F.length(c) + slack), c))


def core_is_prefix(protein: Column, core: Column, slack: int = 0) -> Column:
    p, c = leucine(protein), leucine(core)
    return (F.length(c) > 0) & (p.startswith(c) | F.contains(F.left(p, F.length(c) + slack), c))


def occurrences(seq: Column, core: Column) -> Column:
    """0-based places of all, also overlapping, occurrences."""
    last = F.length(seq) - F.length(core)
    return F.when((F.length(core) > 0) & (last >= 0), F.filter(F.sequence(F.lit(0), last), lambda i: F.substr(seq, i + 1, F.length(core)) == core)).otherwise(F.array().cast("array<int>"))


def candidate_id(record: Column, number: Column) -> Column:
    """record|orf0001; wider numbers keep all their digits."""
    digits = number.cast("string")
    return F.concat(record, F.lit("|orf"), F.when(F.length(digits) >= 4, digits).otherwise(F.lpad(digits, 4, "0")))


def confidence(score: Column) -> Column:
    return F.when(score >= 8, "high").when(score >= 5, "medium").otherwise("low")


def hit_at(rank: Column, k: int) -> Column:
    """1 where there is a rank of at most k."""
    return F.coalesce(rank <= k, F.lit(False)).cast("int")


def display_interval(start: Column, end: Column) -> tuple[Column, Column]:
    """1-based inclusive bounds of a half-open interval."""
    return start + 1, end


def first_of(*columns: Column) -> Column:
    """The first that is neither null nor blank, trimmed."""
    return F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in columns))


def frame_label(strand: Column, frame: Column) -> Column:
    return F.when(frame.isNull(), "unk").when(strand == "-", F.concat(F.lit("-"), F.abs(frame).cast("string"))).otherwise(F.concat(F.lit("+"), F.abs(frame).cast("string")))


#: Product words by class; the first class with a word in the name wins.
PRODUCT_CLASSES = {
    "peptidase": ["b2 protein", "peptidase", "protease"],
    "cyclase": ["cyclase", "isopeptide", "transglutaminase"],
    "b_protein": ["asparagine synthase", "asparagine synthetase", "b1 protein", "b3 protein"],
    "precursor": ["precursor"],
    "transporter": ["transporter", "abc", "export"],
    "regulator": ["regulator", "transcription"],
}


def product_class(product: Column, more: dict[str, list[str]] | None = None) -> Column:
    """Class of a gene product by the words in its name; ``more`` has further words by class."""
    text, out = F.lower(F.coalesce(product, F.lit(""))), None
    for name, words in PRODUCT_CLASSES.items():
        hit = text.rlike("|".join(words + (more or {}).get(name, [])))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def codon_start(x: Column) -> Column:
    """1, 2 or 3; anything else is 1."""
    n = F.try_to_number(x, F.lit("9")).cast("int") if hasattr(F, "try_to_number") else x.cast("int")
    return F.when(n.isin(1, 2, 3), n).otherwise(F.lit(1))
