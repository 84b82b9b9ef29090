"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandforge.llm.common import cut, fresh, join_by_key

#: Uniform numbers come from the first 13 hex digits (52 bits) of an MD5, so any engine can repeat them.
_STEPS = float(1 << 52)
#: Copies of a document that are made at once.
_BLOCK = 4096
#: Numbers of all sources' tables together that are broadcast (32 MB).
MOST_CELLS = 4_000_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 13), 16, 10).cast("double") / F.lit(_STEPS)


def poisson_cdf(mean: float) -> tuple[int, np.ndarray]:
    """The least k told apart, and P(X <= k) from it on up to beyond any 52-bit uniform number.

    What lies outside 10 standard deviations and 20 is below 2^-60.  Terms come from their ratios, by logarithms from the
    mode, and are scaled to sum 1: nothing underflows, and the numbers grow with the root of the mean only.
    """
    if mean <= 0:
        return 0, np.ones(1)
    wide = 10 * mean**0.5 + 20
    low, high, mode = max(0, int(mean - wide)), int(np.ceil(mean + wide)), int(mean)
    up = np.cumsum(np.log(mean / np.arange(mode + 1, high + 1)))
    down = np.cumsum(np.log(np.arange(mode, low, -1) / mean))[::-1]
    below = np.cumsum(np.exp(np.concatenate([down, [0.0], up])))
    return low, below / below[-1]


def _with_cdf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for source, mean in zip(*(c.to_pylist() for c in b.columns), strict=True):
            low, cdf = poisson_cdf(mean)
            yield pa.RecordBatch.from_arrays([pa.array([source], pa.string()), pa.array([low], pa.int64()), pa.array([cdf], pa.list_(pa.float64()))], names=["source", "low", "cdf"])


def replication_rates(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0) -> DataFrame:
    """(source, n, mean): each source's expected copies of a document.

    ``weights`` are target shares by source (they are scaled to sum 1 over the sources that occur; a source without one
    gets none); without them every source gets the same share.  ``size`` is the target size as a multiple of the input's rows.  A null
    source is a source of its own.
    """
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        share = F.lit(1.0)
    else:
        share = F.coalesce(F.create_map(*(x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(float(v)))))[F.coalesce("source", F.lit(""))], F.lit(0.0))
    weighed = n.withColumn("w", share)
    total = weighed.agg(F.sum("n").alias("rows"), F.sum("w").alias("all_w"))
    mean = F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w") * F.col("rows") * F.lit(size) / F.col("n")).otherwise(F.lit(0.0))
    return weighed.join(F.broadcast(total), how="cross").select("source", "n", mean.alias("mean"))  # total is one row


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, size: float = 1.0, seed: int = 17, most_cells: int = MOST_CELLS) -> DataFrame:
    """Every document as often as its inverted Poisson count says, in a global shuffle order.

    Adds _copy (0, 1, ...) and _order (the shuffle key, a hash of the row and the copy; rows come in its order within partitions
    that are dealt by its hash).  A document's count depends on its id, its source's mean and the seed alone, so a lost task repeats
    it.  A null id counts as an empty one, a null source is a source, a null or empty text is a document like any other, and a very
    long one is never held more than once.  Rows with the same id share their count, and repeated rows are drawn each; rows that are
    equal in all columns tie in the shuffle order.  An empty table gives an empty result.  Other columns are carried; where one is
    called _copy or _order, the new one has underscores after its name.

    Documents move once, to their place in the order: the sources' tables are broadcast if together they hold at most
    ``most_cells`` numbers.  Beyond that only the hot sources' are, and the documents of the others meet them by source.
    """
    u_, low_, cdf_, n_, block_, copy_, order_ = (fresh(x, docs) for x in ("_u", "_low", "_cdf", "_n", "_block", "_copy", "_order"))
    source_ = fresh("_source", docs)
    means = cut(replication_rates(docs.select(F.col("source").cast("string")), weights, size))
    sums = means.agg(F.sum("n").alias("rows"), F.sum(40 + 20 * F.sqrt("mean")).alias("cells")).first()
    rates = means.select("source", "mean").mapInArrow(_with_cdf, "source string, low long, cdf array<double>").toDF(source_, low_, cdf_)
    drawn = docs.withColumn(u_, uniform(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    if (sums.cells or 0) <= most_cells:
        drawn = drawn.join(F.broadcast(rates), F.col("source").eqNullSafe(F.col(source_)))
    else:
        counted = rates.join(means.select(F.col("source").alias("_s"), F.col("n").alias(n_)), F.col(source_).eqNullSafe(F.col("_s"))).drop("_s")
        drawn = join_by_key(drawn, counted.withColumnRenamed(source_, "source"), "source", n_, sums.rows)
    drawn = drawn.withColumn(n_, (F.col(low_) + F.size(F.filter(cdf_, lambda c: c <= F.col(u_)))).cast("int"))
    # blocks of copies, so that no array holds all copies of a document
    blocks = drawn.filter(F.col(n_) > 0).withColumn(block_, F.explode(F.sequence(F.lit(0), F.col(n_) - 1, F.lit(_BLOCK))))
    copies = blocks.withColumn(copy_, F.explode(F.sequence(F.col(block_), F.least(F.col(block_) + F.lit(_BLOCK - 1), F.col(n_) - 1))))
    hashed = [F.col(c) for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    keyed = copies.withColumn(order_, F.xxhash64(F.lit(seed), *hashed, copy_))
    return keyed.select(*docs.columns, copy_, order_).repartition(order_).sortWithinPartitions(order_)


def mix_sql(seed: int = 17) -> str:
    """The same draw in DuckDB's SQL, for uniform weights and size 1."""
    return f"""
with n as (select source, count(*)::double n from documents group by source),
rates as (select source, (1.0::double / (select count(*) from n)) * (select sum(n) from n) / n as mean from n),
terms as (select source, mean, unnest(range(0, ceil(mean + 10 * sqrt(mean) + 20)::int + 1)) k from rates),
cdf as (select source, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) over (partition by source order by k) c from terms),
steps as (select source, list(c order by k) cdf from cdf group by source),
drawn as (select d.doc_id, d.source, d.lang, d.n_chars, d.text, len(list_filter(s.cdf, lambda c: c <= ('0x' || substr(md5('{seed}:' || coalesce(d.doc_id::varchar, '')), 1, 13))::bigint / {_STEPS})) copies
  from documents d join steps s on d.source is not distinct from s.source)
select doc_id, source, lang, n_chars, text, unnest(range(0, copies))::int as _copy from drawn where copies > 0"""
