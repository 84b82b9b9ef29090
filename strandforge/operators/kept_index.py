"""A peptide occurrence index that is kept on disk and grows by batches, at a cost that follows the batch and not the index.

Three Parquet folders.  ``pairs`` (peptide, genome, n, fresh) has each batch in partitions of its own by hash bucket of the peptide;
``fresh`` tells pairs that no earlier batch had.  ``genomes`` has each batch's genomes, so that a batch of new genomes needn't look at
older pairs.  ``counts`` has one row a peptide for all batches up to ``upto``, by bucket; what came later is added when it is read, and
``fold`` takes it in from time to time.  A batch that runs again replaces its own partitions, and a folded batch isn't added again, so
counts stay exact after a run that broke off anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandforge.lineage import cut

PAIRS = "protein string, gbk_file string, n long, fresh boolean, batch long, bucket int"
GENOMES = "gbk_file string, batch long"
COUNTS = "protein string, instance_count long, genome_count long, upto long, bucket int"


def bucket_of(protein: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(protein), F.lit(buckets)).cast("int")


def _put(df: DataFrame, path: str, by: list[str]) -> None:
    """Write over the partitions that ``df`` has rows of, and no others; files are of even size, also of a large bucket."""
    df.hint("rebalance", *by).write.partitionBy(*by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The folder's rows; none before its first batch."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def read_pairs(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, f"{root}/pairs", PAIRS)


def add_batch(orfs: DataFrame, root: str, batch: int, buckets: int = 64) -> dict[str, int]:
    """Take a batch of frames (protein, gbk_file) into the index at ``root``; how many frames, pairs and genomes it had, and how many pairs were fresh.

    ``buckets`` is fixed for the life of an index, and batches are numbered upwards.  The same number again replaces what it had
    put, so a repeated batch changes nothing.  Older pairs are read only if some genome came in an earlier batch, and then only
    those of such genomes.
    """
    spark = orfs.sparkSession
    pairs = cut(orfs.groupBy("protein", "gbk_file").agg(F.count("*").alias("n")).withColumn("bucket", bucket_of(F.col("protein"), buckets)))
    own = pairs.select("gbk_file").distinct()
    known = _read(spark, f"{root}/genomes", GENOMES).filter(F.col("batch") < batch).select("gbk_file").distinct()
    again = cut(own.join(known, "gbk_file", "left_semi"))
    if again.isEmpty():
        marked = pairs.withColumn("fresh", F.lit(True))
    else:
        older = read_pairs(spark, root).filter(F.col("batch") < batch).join(again, "gbk_file", "left_semi").select("bucket", "protein", "gbk_file").distinct()
        marked = pairs.join(older.withColumn("_old", F.lit(True)), ["bucket", "protein", "gbk_file"], "left").withColumn("fresh", F.col("_old").isNull()).drop("_old")
    number = F.lit(batch).cast("long")
    _put(marked.withColumn("batch", number), f"{root}/pairs", ["batch", "bucket"])
    _put(own.withColumn("batch", number), f"{root}/genomes", ["batch"])
    counts = read_pairs(spark, root).filter(F.col("batch") == batch).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("frames"), F.count("*").alias("pairs"), F.count_if("fresh").alias("fresh")).first()
    return counts.asDict()


def _marks(spark: SparkSession, root: str) -> DataFrame:
    """(bucket, upto) of the counts: one row a bucket."""
    return _read(spark, f"{root}/counts", COUNTS).groupBy("bucket").agg(F.max("upto").alias("_upto"))


def _parts(spark: SparkSession, root: str) -> DataFrame:
    """(bucket, protein, instance_count, genome_count) to be summed by protein: the counts, and the pairs of later batches."""
    base = _read(spark, f"{root}/counts", COUNTS).select("bucket", "protein", "instance_count", "genome_count")
    later = read_pairs(spark, root).join(F.broadcast(_marks(spark, root)), "bucket", "left").filter(F.col("batch") > F.coalesce("_upto", F.lit(-1)))
    return base.unionByName(later.select("bucket", "protein", F.col("n").alias("instance_count"), F.col("fresh").cast("long").alias("genome_count")))


def _summed(parts: DataFrame, *by: str) -> DataFrame:
    return parts.groupBy(*by).agg(F.sum("instance_count").alias("instance_count"), F.sum("genome_count").alias("genome_count"))


def read_counts(spark: SparkSession, root: str) -> DataFrame:
    """(protein, instance_count, genome_count, aa_len) over all batches: instances are added, a genome counts once however many batches it came in."""
    return _summed(_parts(spark, root), "bucket", "protein").select("protein", "instance_count", "genome_count", F.length("protein").alias("aa_len"))


def fold(spark: SparkSession, root: str, upto: int) -> int:
    """Take all batches up to number ``upto``, the last one, into ``counts``; how many buckets were written.

    Buckets are replaced one by one, each with the number that it covers, so a fold that breaks off leaves every bucket whole and
    the next one goes on.
    """
    summed = cut(_summed(_parts(spark, root), "bucket", "protein").withColumn("upto", F.lit(upto).cast("long")))  # read before its folder is written over
    _put(summed, f"{root}/counts", ["bucket"])
    return summed.select("bucket").distinct().count()


def fold_due(spark: SparkSession, root: str, batch: int, after: int) -> bool:
    """Whether ``after`` batches or more have come since the last fold."""
    mark = _marks(spark, root).agg(F.min("_upto")).first()[0]
    return batch - (-1 if mark is None else mark) >= after


def lookup(candidates: DataFrame, root: str, buckets: int = 64, most_broadcast: int = 1_000_000) -> DataFrame:
    """Adds instance_count and genome_count of each candidate's ``protein``, 0 for an unknown one; null proteins are unknown.

    The index is read only in the buckets asked for.  The distinct proteins are broadcast while they are at most ``most_broadcast``,
    and of the index only what they find is shuffled; more of them are joined by shuffle.
    """
    spark = candidates.sparkSession
    asked = candidates.select(F.col("protein").alias("_asked")).filter("_asked is not null").distinct()
    asked = cut(asked.withColumn("_bucket", bucket_of(F.col("_asked"), buckets)))  # counted, then joined
    wanted = {r[0]: r[1] for r in asked.groupBy("_bucket").count().collect()}  # at most ``buckets`` rows
    small = sum(wanted.values()) <= most_broadcast
    held = _parts(spark, root).filter(F.col("bucket").isin(list(wanted)))
    found = _summed(held.join(F.broadcast(asked) if small else asked, (F.col("protein") == F.col("_asked")) & (F.col("bucket") == F.col("_bucket"))), "_asked")
    found = found.select("_asked", F.col("instance_count").alias("_i"), F.col("genome_count").alias("_g"))
    out = candidates.join(F.broadcast(found) if small else found, candidates["protein"] == F.col("_asked"), "left")
    return out.withColumns({"instance_count": F.coalesce("_i", F.lit(0)).cast("long"), "genome_count": F.coalesce("_g", F.lit(0)).cast("long")}).drop("_asked", "_i", "_g")
