"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandforge.lineage import cut, ensure_checkpoint_dir  # noqa: F401


def text_of(name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows of the evaluation fold: crc32 of the id's decimal text mod 4 is 2.  A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fresh(name: str, df: DataFrame) -> str:
    """The name, with underscores after it while ``df`` has a column called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def least_hashed(ids: DataFrame, by: str, most: dict, seed: int) -> DataFrame:
    """(doc_id, ``by``, order) of the rows with the least hash of the id, so many of each class of ``by``.

    ``most`` has (row count, rows wanted) by class.  A hash bound that about four times the
    wanted rows meet comes first, so what a task ranks doesn't grow with the table.
    """
    spark = ids.sparkSession
    shares = spark.createDataFrame([(k, min(1 << 40, int((1 << 40) * (4 * w + 50) / max(1, n))), w) for k, (n, w) in most.items()], f"_class {dict(ids.dtypes)[by]}, _bound long, _most int")
    hashed = ids.withColumn("order", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)))
    some = hashed.join(F.broadcast(shares), F.col(by) == F.col("_class")).filter(F.col("order") < F.col("_bound"))  # shares: one row a class
    rank = F.row_number().over(Window.partitionBy(by).orderBy("order", "doc_id"))
    return some.select("doc_id", by, "order", "_most").distinct().withColumn("_rank", rank).filter(F.col("_rank") <= F.col("_most")).select("doc_id", by, "order")


def join_by_key(rows: DataFrame, table: DataFrame, key: str, n: str, total: int, how: str = "inner", most: int = 1000) -> DataFrame:
    """``rows`` joined with ``table``, which has one row a key and in column ``n`` how many of the ``total`` rows hold it.

    Keys of more than a ``most``-th of all rows, of which there are fewer than ``most``, travel by broadcast; the others are
    shuffled, so a hot key's rows stay where they are.  Nulls are a key like any other.  ``how`` is inner or left; ``n`` is dropped.
    """
    own = fresh("_key", rows)
    named = table.withColumnRenamed(key, own)
    same = rows[key].eqNullSafe(named[own])
    hot = named.filter(F.col(n) > max(1, total // most))
    if hot.isEmpty():
        return rows.join(named.drop(n), same, how).drop(own)
    first = rows.join(F.broadcast(hot.drop(n)), same)  # fewer than ``most`` rows
    rest = rows.join(F.broadcast(hot.select(own)), same, "left_anti").join(named.filter(F.col(n) <= max(1, total // most)).drop(n), same, how)
    return first.unionByName(rest).drop(own)


def map_rows(df: DataFrame, fn: Callable[..., tuple], schema: str, n_in: int, rows_at_once: int = 256) -> DataFrame:
    """One output row for each input row: ``fn(*first n_in columns)`` gives the columns after the carried rest.

    ``df`` has the ``n_in`` arguments first and carried columns after them; ``schema`` names the carried columns
    and then fn's outputs.  Batches are cut into short slices, so memory follows a few hundred texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = None
        for whole in batches:
            for at in range(0, whole.num_rows, rows_at_once):
                b = whole.slice(at, rows_at_once)
                args = [b.column(i).to_pylist() for i in range(n_in)]
                got = list(zip(*(fn(*x) for x in zip(*args, strict=True)), strict=True))
                carried = [b.column(i) for i in range(n_in, b.num_columns)]
                if out_schema is None:
                    out_schema = _arrow_schema(schema)
                new = [pa.array(v, type=out_schema.field(len(carried) + i).type) for i, v in enumerate(got)]
                cols = [c.cast(out_schema.field(i).type) for i, c in enumerate(carried)] + new
                yield pa.RecordBatch.from_arrays(cols, schema=out_schema)

    return df.mapInArrow(run, schema)


_ARROW = {
    "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()),
}


def _arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([pa.field(n, _ARROW[t]) for n, t in (x.split() for x in ddl.split(","))])


def record_batch(ddl: str, columns: Iterable[list]) -> pa.RecordBatch:
    schema = _arrow_schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
