"""Quality rules of documents and of the hosts they come from."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandforge.llm.common import cut, join_by_key, map_rows, text_of

_SYMBOLS = re.compile(r"[#*$%&|<>]")
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at \x20 and \x09-\x0D alone
    chars = sum(map(len, (w.decode("utf-8", "surrogatepass") for w in words))) if not text.isascii() else sum(map(len, words))
    dup, lines = 0, set()
    if "\n" in text:
        for line in text.split("\n"):
            if line in lines:
                dup += bool(line.encode("utf-8", "surrogatepass").split())
            else:
                lines.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen, twice = set(), set()
        for w in windows:
            (twice if w in seen else seen).add(w)
        upto = 0  # words before this place are counted
        for i, w in enumerate(windows):
            if w in twice:
                repeated += i + 3 - max(upto, i)
                upto = i + 3
    return len(words), chars, len(_SYMBOLS.findall(text)), dup, repeated


def host_verdicts(measured: DataFrame, host: str, worst: float = 0.5) -> DataFrame:
    """(host, n, failures, rate, host_kept): failure rates by host, shrunk with an empirical beta prior.

    The prior's mean and concentration come from the moments of the hosts' raw rates: m (1 - m) / v - 1, at least 1 and at
    most a million, and with one host or no spread a million (every host gets the mean).  A host goes when its shrunk rate exceeds
    ``worst``.  A null host is a host of its own.
    """
    by_host = measured.groupBy(host).agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failures")).withColumn("raw", F.col("failures") / F.col("n"))
    prior = by_host.agg(F.avg("raw").alias("m"), F.var_pop("raw").alias("v"))
    strength = F.when(F.coalesce("v", F.lit(0.0)) < 1e-9, F.lit(1e6)).otherwise(F.least(F.lit(1e6), F.greatest(F.lit(1.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1)))
    rate = (F.col("failures") + F.col("m") * F.col("s")) / (F.col("n") + F.col("s"))
    rated = by_host.join(F.broadcast(prior), how="cross").withColumn("s", strength).withColumn("rate", F.round(rate, 9))  # prior is one row
    return rated.select(host, "n", "failures", "rate", (F.col("rate") <= worst).alias("host_kept"))


def quality_rules(docs: DataFrame, host: str = "source", worst: float = 0.5) -> DataFrame:
    """(doc_id, the five measures, base_failed, host_rate, kept) for every row.

    base_failed: under 50 words, or over half of the words repeated.  kept: not base_failed, and the host's shrunk
    failure rate is at most ``worst``.  Null and empty texts have no words and fail; a very long text is
    one word list at a time.  Repeated rows give as many rows; a null id is kept and a null host is a host.  An empty table gives an
    empty result, extra columns are ignored.  A host at exactly ``worst`` stays.  Every text is measured once: the measures are
    written before they are summed by host, and the verdicts, one row a host, are joined back.
    """
    base = map_rows(docs.select(text_of().alias("text"), F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host")), measure, "doc_id long, host string, " + ", ".join(f"{m} long" for m in MEASURES), 1)
    base = cut(base.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))))
    verdicts = cut(host_verdicts(base, "host", worst))
    joined = join_by_key(base, verdicts.select("host", "n", "rate", "host_kept"), "host", "n", verdicts.agg(F.sum("n")).first()[0] or 0)
    return joined.select("doc_id", *MEASURES, "base_failed", F.col("rate").alias("host_rate"), (~F.col("base_failed") & F.col("host_kept")).alias("kept"))


def quality_sql(worst: float = 0.5) -> str:
    """The same in DuckDB's SQL."""
    return rf"""
with d as (select row_number() over () r, doc_id, source, coalesce(text, '') t from documents),
w as (select r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w from d),
g as (select r, unnest(range(1, greatest(len(w) - 1, 1))) i, w from w where len(w) >= 3),
g3 as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] s from g),
tw as (select r, i from (select r, i, count(*) over (partition by r, s) c from g3) where c > 1),
rep as (select r, count(distinct i + o) n from tw, range(0, 3) o(o) group by r),
l as (select r, unnest(string_split(t, chr(10))) line from d),
lc as (select r, sum(c - 1) n from (select r, line, count(*) c from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by r, line) group by r),
m as (select d.doc_id, d.source, len(w.w)::bigint n_words, length(regexp_replace(d.t, '[\x20\x09-\x0D]+', '', 'g'))::bigint word_chars, length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols,
  coalesce(lc.n, 0)::bigint n_dup_lines, coalesce(rep.n, 0)::bigint n_repeat_words from d join w using (r) left join lc using (r) left join rep using (r)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m),
h as (select source, count(*) n, sum(base_failed::int) f, sum(base_failed::int) / count(*)::double raw from b group by source),
p as (select avg(raw) m, var_pop(raw) v from h),
s as (select m, case when coalesce(v, 0) < 1e-9 then 1e6 else least(1e6, greatest(1.0, m * (1 - m) / v - 1)) end s from p),
k as (select source, round((f + m * s) / (n + s), 9) rate from h, s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, k.rate as host_rate, not base_failed and k.rate <= {worst} as kept
from b join k on b.source is not distinct from k.source"""
