"""The sequence functions by name in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandforge.functions.seq import ALT_STARTS, AMINO, STARTS, STOPS, _blake2b

_CODON = f"if(length(c) = 3 and instr('TCAG', substr(c, 1, 1)) > 0 and instr('TCAG', substr(c, 2, 1)) > 0 and instr('TCAG', substr(c, 3, 1)) > 0, substr('{AMINO}', 16 * (instr('TCAG', substr(c, 1, 1)) - 1) + 4 * (instr('TCAG', substr(c, 2, 1)) - 1) + instr('TCAG', substr(c, 3, 1)), 1), 'X')"
_BODY = f"regexp_replace(array_join(transform(regexp_extract_all(upper(dna), '(?s)...', 0), c -> {_CODON}), ''), '[*]$', '')"
#: Native SQL functions: name, parameters, result, body.
NATIVE = [
    ("reverse_complement", "dna string", "string", "reverse(translate(dna, 'ACGTUacgtuRYKMBDHVrykmbdhv', 'TGCAAtgcaaYRMKVHDByrmkvhdb'))"),
    ("translate_bacterial", "dna string", "string", f"case when length(dna) < 3 then '' when substr(upper(dna), 1, 3) in ('{ALT_STARTS[0]}', '{ALT_STARTS[1]}') and {_BODY} <> '' then concat('M', substr({_BODY}, 2)) else {_BODY} end"),
    ("vector_dot", "a array<double>, b array<double>", "double", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    ("vector_cosine", "a array<double>, b array<double>", "double", "coalesce(vector_dot(a, b) / nullif(sqrt(vector_dot(a, a)) * sqrt(vector_dot(b, b)), 0), 0D)"),
    ("core_group", "core string", "string", "concat('core_', substr(sha1(translate(upper(core), 'I', 'L')), 1, 10))"),
]


@F.udtf(returnType="strand string, frame int, nt_start int, nt_end int, dna string")
class SixFrameOrfs:
    """Frames of one sequence, for ad-hoc SQL; tables go through the operator."""

    def eval(self, sequence: str, min_aa: int, max_aa: int):
        flip = (sequence or "")[::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca"))
        for strand, own in (("+", sequence or ""), ("-", flip)):
            up = own.upper()
            for f in range(3):
                starts: list[int] = []
                for i in range(f, len(up) - 2, 3):
                    codon = up[i : i + 3]
                    if codon in STARTS:
                        starts.append(i)
                    elif codon in STOPS:
                        for s in starts:
                            if min_aa <= (i - s) // 3 <= max_aa:
                                yield strand, f if strand == "+" else -(f + 1), s, i, own[s:i]
                        starts = []


def register(spark: SparkSession) -> None:
    """Session functions: the native ones, ``peptide_digest`` (an Arrow UDF) and the table function ``six_frame_orfs``."""
    for name, parameters, result, body in NATIVE:
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {result} return {body}")
    spark.udf.register("peptide_digest", F.pandas_udf(_blake2b, "string"))
    spark.udtf.register("six_frame_orfs", SixFrameOrfs)
