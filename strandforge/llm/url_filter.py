"""URL filters: explicit rules by host and path, then the purity of path templates that a tree of each host's paths gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandforge.llm.common import cut, join_by_key

#: (host, path, verdict): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A segment of these letters is an identifier.
_IDENTIFIER = "^[0-9a-fA-F-]{16,}$"
#: What may follow a segment: nothing, one with a number or identifier, a word, or more levels than the tree has.
_NEXT = ["end", "number", "word", "deeper"]


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, with A-Z lower-cased; empty without ``://`` and for null."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty without ``://`` and for null."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise("")
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null; rules of one length count in the order given."""
    fit = lambda h, p: ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
    longest = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    return F.coalesce(*(F.when(fit(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in longest), F.lit(None).cast("struct<rule:string,verdict:string>"))


def segments(path: Column, depth: int) -> Column:
    """The path's segments with their variable parts as wildcards: identifiers ``<x>``, numbers ``<n>``; what lies deeper than ``depth`` is one ``**``."""
    shape = lambda s: F.when(F.rlike(s, F.lit(_IDENTIFIER)), "<x>").otherwise(F.regexp_replace(s, "[0-9]+", "<n>"))
    whole = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), shape)
    return F.when(F.size(whole) > depth, F.concat(F.slice(whole, 1, depth), F.array(F.lit("**")))).otherwise(whole)


def _sums(*names: str) -> list[Column]:
    return [F.sum(x).alias(x) for x in names]


def _few(df: DataFrame, rows: int) -> DataFrame:
    """A table of counts in a partition for each 100,000 rows: many small ones would each leave files for every level's shuffles."""
    return df.coalesce(max(1, -(-rows // 100_000)))


def _generalised(paths: DataFrame, level: int, wide: int, rows: int) -> DataFrame:
    """``paths`` (host, template, segs, n, labelled, bad) with one more segment in ``template``, those that vary or resemble their siblings as ``*``.

    A word that is one of at least ``wide`` under its parent and rarer than a ``wide``-th of it varies.  A branch resembles the
    pool of its siblings if what follows it is spread like what follows them (total variation within 0.1 and 1 / sqrt(n)) and
    its share of bad labels is theirs (within 0.05 and two standard errors).  Each branch meets its parent's sums, never its
    siblings, so the work is linear in the branches.  ``rows`` is how many paths there are.
    """
    seg, after = F.get("segs", F.lit(level)), F.get("segs", F.lit(level + 1))
    follows = {"end": after.isNull(), "deeper": after == "**", "number": F.contains(after, F.lit("<"))}
    follows["word"] = ~(follows["end"] | F.coalesce(follows["deeper"] | follows["number"], F.lit(False)))
    node = F.concat("host", F.lit("\n"), "template")
    open_ = paths.filter(F.size("segs") > level).withColumns({"node": node, "seg": seg, "branch": F.concat(node, F.lit("/"), seg)})
    counted = open_.withColumns({f"_{x}": F.when(F.coalesce(follows[x], F.lit(False)), F.col("n")).otherwise(0) for x in _NEXT})
    sums = ["n", "labelled", "bad", *(f"_{x}" for x in _NEXT)]
    branches = cut(_few(counted.groupBy("node", "seg", "branch").agg(*_sums(*sums), F.count("*").alias("rows")), rows))
    is_word = ~F.contains("seg", F.lit("<"))
    parents = branches.groupBy("node").agg(F.count("*").alias("branches"), F.sum(is_word.cast("long")).alias("words"), *(F.sum(x).alias(f"p{x}") for x in sums))
    both = join_by_key(branches, parents.withColumn("size", F.col("branches")), "node", "size", branches.count())
    spread = sum((F.abs(F.col(f"_{x}") / F.col("n") - F.col(f"p_{x}") / F.col("pn")) for x in _NEXT), F.lit(0.0)) / 2
    share = F.col("pbad") / F.greatest("plabelled", F.lit(1))
    alike = (spread <= 0.1 + 1 / F.sqrt("n")) & ((F.col("labelled") == 0) | (F.abs(F.col("bad") / F.greatest("labelled", F.lit(1)) - share) <= 0.05 + 2 * F.sqrt(share * (1 - share) / F.greatest("labelled", F.lit(1)))))
    varies = is_word & (F.col("words") >= wide) & (F.col("n") * wide < F.col("pn"))
    named = both.select("branch", "rows", F.when((F.col("seg") != "**") & (varies | ((F.col("branches") > 1) & alike)), "*").otherwise(F.col("seg")).alias("as_"))
    moved = join_by_key(open_, named, "branch", "rows", open_.count()).withColumn("template", F.concat("template", F.lit("/"), "as_"))
    return cut(_few(moved.select(paths.columns).unionByName(paths.filter(F.size("segs") <= level)), rows))


def path_templates(urls: DataFrame, depth: int = 3, wide: int = 10) -> DataFrame:
    """(raw, host, template, n, labelled, bad): for every distinct host and row of segments (``raw`` names both), its template and counts.

    ``urls`` has host, segs, and ``bad`` (1, 0 or null where there is no label).  Equal rows are summed before anything is dealt;
    the tree then grows level by level from the root.
    """
    raw = F.concat("host", F.lit("\n"), F.array_join("segs", "/"))
    paths = urls.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    paths = cut(paths.withColumns({"raw": raw, "template": F.lit("")}))
    rows = paths.count()
    paths = _few(paths, rows)
    for level in range(depth + 1):
        paths = _generalised(paths, level, wide, rows)
    return paths.drop("segs")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, reject: float = 0.8, weight: float = 5.0, depth: int = 3, wide: int = 10, id_col: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for every row.

    The longest of the ``rules`` that fits decides, and what rules decide labels the other paths: a template's purity is its share
    of blocked labels, shrunk by ``weight`` pages towards its host's share, which is shrunk towards that of all labels, which is
    shrunk towards 0.  Templates at or above ``reject`` are blocked where no rule fits, else allowed.  Templates are each host's own.

    A null url and one without ``://`` have an empty host and path, and are judged like any other; an empty path fits no rule; a very long path is
    told apart in its first ``depth`` segments and whether there are more.  Equal rows give equal rows, a null id is kept,
    an empty table gives an empty result, and extra columns of any name are ignored.
    """
    url = F.col("url").cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("by", fitting_rule(F.col("host"), F.col("path"), RULES if rules is None else rules)).withColumn("segs", segments(F.col("path"), depth))
    labelled = rows.select("host", "segs", F.when(F.col("by").isNotNull(), (F.col("by.verdict") == "block").cast("int")).alias("bad"))
    paths = path_templates(labelled, depth, wide)
    templates = paths.withColumn("key", F.concat("host", F.lit("\n"), "template")).groupBy("host", "key").agg(*_sums("n", "labelled", "bad"), F.count("*").alias("rows"))
    templates = cut(_few(templates, paths.count()))
    hosts = templates.groupBy("host").agg(F.count("*").alias("of"), F.sum("labelled").alias("hl"), F.sum("bad").alias("hb"))
    total = templates.agg(F.coalesce(F.sum("labelled"), F.lit(0)).alias("l"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("t"), F.coalesce(F.sum("rows"), F.lit(0)).alias("r")).first()
    over = F.lit(total.b) / (F.lit(total.l) + weight)
    of_host = (F.col("hb") + weight * over) / (F.col("hl") + weight)
    purity = F.round((F.col("bad") + weight * of_host) / (F.col("labelled") + weight), 9)
    rated = join_by_key(templates, hosts, "host", "of", total.t).select("key", "rows", purity.alias("purity"))
    keyed = paths.select("raw", "n", "template", F.concat("host", F.lit("\n"), "template").alias("key"))
    by_path = join_by_key(keyed, rated, "key", "rows", total.r).select("raw", "n", "template", "purity")
    judged = join_by_key(rows.withColumn("raw", F.concat("host", F.lit("\n"), F.array_join("segs", "/"))), cut(_few(by_path, total.r)), "raw", "n", total.n)
    verdict = F.coalesce("by.verdict", F.when(F.col("purity") >= reject, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("by.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")


def judge_sql(rules: list[tuple[str, str, str]] | None = None, reject: float = 0.8, weight: float = 5.0, depth: int = 3, wide: int = 10) -> str:
    """The same in DuckDB's SQL, one block of common tables for each level of the tree."""
    longest = sorted(RULES if rules is None else rules, key=lambda r: -len(r[0] + r[1]))
    fits = " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{h}{p}'" for h, p, _ in longest)
    says = " ".join(f"when '{h}{p}' then '{v}'" for h, p, v in longest)
    nexts = {"e": "nx is null", "d": "nx = '**'", "m": "nx <> '**' and contains(nx, '<')", "w": "nx <> '**' and not contains(nx, '<')"}
    levels = []
    for k in range(depth + 1):
        spread = " + ".join(f"abs({x} / n - p{x} / pn)" for x in ("e", "m", "w", "d"))
        levels.append(f"""
o{k} as (select *, segs[{k + 1}] seg, segs[{k + 2}] nx from p{k} where len(segs) > {k}),
b{k} as (select host, template, seg, sum(n)::bigint n, sum(labelled)::bigint labelled, sum(bad)::bigint bad, {", ".join(f"sum(case when {c} then n else 0 end)::bigint {x}" for x, c in nexts.items())} from o{k} group by 1, 2, 3),
a{k} as (select host, template, count(*) branches, sum((not contains(seg, '<'))::int) words, sum(n)::bigint pn, sum(labelled)::bigint pl, sum(bad)::bigint pb, {", ".join(f"sum({x})::bigint p{x}" for x in nexts)} from b{k} group by 1, 2),
s{k} as (select b{k}.*, branches, words, pn, pb / greatest(pl, 1) share, ({spread}) / 2 spread from b{k} join a{k} using (host, template)),
n{k} as (select host, template, seg, case when seg <> '**' and ((not contains(seg, '<') and words >= {wide} and n * {wide} < pn)
  or (branches > 1 and spread <= 0.1::double + 1::double / sqrt(n) and (labelled = 0 or abs(bad / greatest(labelled, 1) - share) <= 0.05::double + 2::double * sqrt(share * (1 - share) / greatest(labelled, 1))))) then '*' else seg end name from s{k}),
p{k + 1} as (select o.host, o.segs, o.n, o.labelled, o.bad, o.template || '/' || name as template from o{k} o join n{k} using (host, template, seg)
  union all select host, segs, n, labelled, bad, template from p{k} where len(segs) <= {k}),""")
    return rf"""
with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
hp as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from u),
f as (select *, case {fits} end rule, [case when regexp_matches(x, '{_IDENTIFIER}') then '<x>' else regexp_replace(x, '[0-9]+', '<n>', 'g') end for x in string_split(path, '/') if x <> ''] whole from hp),
g as (select page_id, host, path, rule, case rule {says} end said, case when len(whole) > {depth} then list_append(whole[1:{depth}], '**') else whole end segs from f),
p0 as (select host, segs, count(*) n, count(said) labelled, coalesce(sum((said = 'block')::int), 0)::bigint bad, '' as template from g group by host, segs),{"".join(levels)}
t as (select host, template, sum(labelled)::bigint labelled, sum(bad)::bigint bad from p{depth + 1} group by 1, 2),
h as (select host, sum(labelled)::bigint hl, sum(bad)::bigint hb from t group by 1),
z as (select sum(labelled)::bigint l, sum(bad)::bigint b from t),
r as (select host, template, round((bad + {weight}::double * ((hb + {weight}::double * (b / (l + {weight}::double))) / (hl + {weight}::double))) / (labelled + {weight}::double), 9) purity from t join h using (host), z)
select page_id, g.host, path, rule, coalesce(said, case when purity >= {reject}::double then 'block' else 'allow' end) verdict, template, purity
from g join p{depth + 1} using (host, segs) join r using (host, template)"""
