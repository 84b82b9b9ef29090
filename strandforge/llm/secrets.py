"""Secret scans over an incremental blob ledger, in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandforge.llm.common import cut, join_by_key, text_of

#: Rule kinds in listing order: (kind, pattern, cheap test, group, least length of the group).
RULES = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"(?:[Dd]|[Tt]|[Nn]|[Yy])[\"']?\x20*[:=]", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", "AKIA", 0, 20),
    ("hex", r"[0-9a-f]+", r"[0-9a-f]{24}", 0, 24),
]
RULE_VERSION = 1
SPAN = "array<struct<kind:string,rank:int,start:int,end:int>>"
FINDINGS = f"blob string, rule_version int, spans {SPAN}"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def spans_of(text: Column, kind: str, rank: int, pattern: str, test: str, group: int, least: int) -> Column:
    """Spans (code points, end exclusive) of the leftmost non-overlapping matches that are long enough.

    Splitting at the pattern gives the pieces between matches, so running lengths of pieces and matches are positions.
    """
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    if group == 0 and kind == "hex":  # a run of 24 or more is found as such; shorter runs needn't be cut out
        long_run = pattern.replace("+", f"{{{least},}}")
        pieces, hits = F.split(text, long_run, -1), F.regexp_extract_all(text, F.lit(long_run), F.lit(0))
        values = hits
    cells = F.arrays_zip(
        F.transform(F.slice(pieces, 1, F.size(hits)), lambda x: F.char_length(x)).alias("gap"),
        F.transform(hits, lambda x: F.char_length(x)).alias("len"),
        F.transform(values, lambda x: F.char_length(x)).alias("value"),
    )
    one = lambda start, end: F.array(F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), start.alias("start"), end.alias("end")))
    none = F.array().cast(SPAN)

    def walk(some: Column, at: Column) -> Column:
        """Spans of consecutive cells of which the first begins at ``at``."""
        begin = F.struct(at.alias("at"), none.alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["len"]).alias("at"), F.when(x["value"] >= least, F.concat(acc["out"], one(acc["at"] + x["gap"], acc["at"] + x["gap"] + x["len"]))).otherwise(acc["out"]).alias("out"))
        return F.aggregate(some, begin, step, lambda acc: acc["out"])

    def walk_blocks(cells_: Column) -> Column:
        """The same by blocks of the root of the number: an array that grows by a step is copied by every step."""
        side = F.ceil(F.sqrt(F.size(cells_))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(cells_), side), lambda i: F.slice(cells_, i, side))
        return let(blocks, lambda own: F.flatten(F.transform(F.arrays_zip(own.alias("b"), starts(own).alias("s")), lambda x: walk(x["b"], x["s"]))))

    def starts(blocks: Column) -> Column:
        lengths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + x["len"]))
        after = F.aggregate(lengths, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))
        return F.slice(after, 1, F.size(after) - 1)

    spans = let(cells, lambda c: F.when(F.size(c) <= 64, walk(c, F.lit(0))).otherwise(walk_blocks(c)))
    return F.when(text.rlike(test), spans).otherwise(none)


def scan_blobs(blobs: DataFrame, rules: list[tuple] | None = None, version: int = RULE_VERSION) -> DataFrame:
    """(blob, rule_version, spans) of blobs (blob, text); spans by start, then kind as listed."""
    every = F.concat(*(spans_of(F.col("text"), kind, k, *rest) for k, (kind, *rest) in enumerate(rules or RULES)))
    by_place = F.transform(F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.struct(s["kind"].alias("kind"), s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end")))
    return blobs.select("blob", F.lit(version).alias("rule_version"), by_place.alias("spans"))


def new_findings(versions: DataFrame, seen: DataFrame | None = None, version: int = RULE_VERSION, rules: list[tuple] | None = None) -> DataFrame:
    """Scan the blobs of ``versions`` (doc_id, text) that ``seen`` (blob, rule_version) lacks at this rule version.

    A blob's address is the SHA-256 of its UTF-8 bytes; each is scanned once, in the version with the least id.
    Texts move once, to the addresses they stand for; only ids and addresses are aggregated.
    """
    held = versions.select("doc_id", F.sha2(text_of(), 256).alias("blob"))
    first = held.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    if seen is not None:
        first = first.join(seen.filter(F.col("rule_version") == version).select("blob").distinct(), "blob", "left_anti")
    texts = versions.select("doc_id", text_of().alias("text"))
    todo = texts.join(first.hint("shuffle_hash"), texts.doc_id.eqNullSafe(first.doc_id)).select("blob", "text", F.sha2("text", 256).alias("own"))
    found = scan_blobs(todo.filter("own = blob").select("blob", "text"), rules, version)
    return found.groupBy("blob", "rule_version").agg(F.any_value("spans").alias("spans"))  # repeated rows share a blob


def with_paths(versions: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, blob, spans) for every row of ``versions``, from findings ``known`` of one rule version.

    Only blobs with a finding are joined back; those that a thousandth of all paths share are broadcast.
    """
    paths = versions.select("doc_id", F.sha2(text_of(), 256).alias("blob"))
    told = known.filter(F.size("spans") > 0).select("blob", "spans")
    counted = cut(paths.join(told.select("blob"), "blob", "left_semi").groupBy("blob").agg(F.count("*").alias("n")).join(told, "blob"))
    back = join_by_key(paths, counted, "blob", "n", versions.count(), "left")
    return back.select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, version: int = RULE_VERSION, rules: list[tuple] | None = None) -> tuple[DataFrame, DataFrame]:
    """(every path's spans, new ledger entries): unseen blobs are scanned, known ones come from the ledger.

    ``versions``: doc_id, text; ``ledger``: blob, rule_version, spans of earlier runs.  Findings carry the ``version`` of the rules
    that they were scanned with.  Null text counts as empty and has no spans; very long texts are scanned whole, in time that grows
    with their matches to the power 1.5.  Every input row gives one row (doc_id, blob, spans), repeated rows and null ids included; an
    empty table gives none.  Spans that begin together come by kind as listed.  Extra columns are ignored.
    """
    fresh = cut(new_findings(versions, ledger, version, rules))
    known = fresh if ledger is None else fresh.unionByName(ledger.filter(F.col("rule_version") == version).select(fresh.columns)).dropDuplicates(["blob"])
    return with_paths(versions, known), fresh


def scan_with_ledger(versions: DataFrame, folder: str, version: int = RULE_VERSION, rules: list[tuple] | None = None) -> DataFrame:
    """``scan_versions`` against the ledger kept as Parquet in ``folder`` of the shared file system, which gets the new entries.

    A folder that doesn't exist yet is an empty ledger.  Entries are appended by one committed write; a job that dies before it
    leaves the ledger as it was, and two jobs at once at worst enter a blob twice, which counts once.
    """
    spark = versions.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    held = spark.read.schema(FINDINGS).parquet(folder) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None
    new_findings(versions, held, version, rules).write.mode("append").parquet(folder)
    known = spark.read.schema(FINDINGS).parquet(folder).filter(F.col("rule_version") == version).dropDuplicates(["blob"])
    return with_paths(versions, known)


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets_sql() -> str:
    """The query's rows in DuckDB's SQL: the same patterns, positions from the pieces between the matches."""
    parts = []
    for rank, (kind, pattern, _, group, least) in enumerate(RULES):
        p = (pattern.replace("+", f"{{{least},}}") if kind == "hex" else pattern).replace("'", "''")
        parts.append(f"select r, '{kind}' as kind, {rank} as rank, {least} as least, regexp_extract_all(t, '{p}') as m, regexp_extract_all(t, '{p}', {group}) as v, string_split_regex(t, '{p}') as s from d where regexp_matches(t, '{p}')")
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
a as ({' union all '.join(parts)}),
k as (select *, unnest(range(1, len(m) + 1)) as k from a),
x as (select r, kind, rank, list_sum(list_transform(s[1:k], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda y: length(y))), 0) as st, length(m[k]) as n from k where length(v[k]) >= least),
g as (select r, string_agg(kind || ':' || st::bigint || ':' || (st + n)::bigint, ',' order by st, rank) as spans, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex from x group by r)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (r)"""
