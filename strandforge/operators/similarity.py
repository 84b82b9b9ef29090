"""Cosine retrieval of candidates against a labelled reference set."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Bytes of one block of references, and of one share of candidates that meets it: what a task holds of each, or a broadcast carries.
BLOCK_BYTES = 32 << 20
#: Bytes of a share of candidates that meets all references in turn: what a task holds of them.
SHARE_BYTES = 64 << 20
#: Bytes that a row has beside its vector.
BESIDE = 64
#: References, about, that tell where in space a candidate lies.
PIVOTS = 1024
#: Candidates that are multiplied with a block at once, and similarities that are held at once.
AT_ONCE = 256
SEARCHED = 8192
HELD = 1 << 21
#: References that are dealt to cells at once.
STEP = 2048
#: What a bound may lose by rounding.
SLACK = 1e-9
#: What the angle to a cell may lose by rounding: that of a small angle is many times what its cosine loses.
WIDE = 1e-7
#: What a product of two numbers below 1 loses in 32 bits.
SHORT = 6e-8
#: What is done with some candidates (ids, unit vectors) and a block of references.
Work = Callable[[pa.Array, np.ndarray, "Block"], Iterator[pa.RecordBatch]]


class Block:
    """References by locus, and in their own order within one, as unit vectors."""

    def __init__(self, locus: pa.Array, ords: pa.Array, ids: pa.Array, vectors: pa.Array) -> None:
        number, names = pd.factorize(locus.to_pandas(), use_na_sentinel=False)
        ords = ords.to_numpy(zero_copy_only=False)
        order = np.lexsort((ords, number))
        self.vectors, self.ords, self.number, self.names = _matrix(vectors)[order], ords[order], number[order], [x if isinstance(x, str) else None for x in names]
        self.ids = ids.to_pandas().to_numpy()[order]
        self.firsts = np.flatnonzero(np.r_[True, np.diff(self.number) > 0])
        self.ends = np.r_[self.firsts[1:], len(order)]
        self.loci = len(self.firsts)
        self.pivots: np.ndarray | None = None

    def in_cells(self) -> None:
        """Deal the references to the nearest of some of them; a cell's references stay in order, and the cell knows how wide it is."""
        every = max(1, int(len(self.vectors) ** 0.5 / 2))
        self.pivots = self.vectors[every // 2 :: every]
        short = self.pivots.T.astype(np.float32)  # any pivot will do, as the angle to it is then taken exactly
        cell = np.concatenate([np.argmax(self.vectors[at : at + STEP].astype(np.float32) @ short, axis=1) for at in range(0, len(self.vectors), STEP)])
        angle = np.arccos(np.clip(np.einsum("ij,ij->i", self.vectors, self.pivots[cell]), -1, 1))
        held = np.argsort(cell, kind="stable")
        bounds = np.searchsorted(cell[held], np.arange(len(self.pivots) + 1))
        self.cells = [held[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.sizes = np.diff(bounds)
        self.width = np.array([angle[c].max(initial=0) for c in self.cells])

    def nearest_loci(self, vectors: np.ndarray, n: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of a vector, number of a reference, similarity): each vector's n best loci by their best references, in order.

        A vector at angle a from a pivot has no similarity above cos(a - w) to a cell of width w, so cells that cannot reach what its
        own surroundings give n loci of are left out, and the result is that of all references.  ``least``: similarities that n loci
        elsewhere are known to reach (minus infinity: none known); what is below them isn't looked for.
        """
        if self.pivots is None:
            self.in_cells()
        n = min(n, self.loci)
        to_pivot = vectors @ self.pivots.T
        least = np.full(len(vectors), -np.inf) if least is None else least.copy()
        bare = np.flatnonzero(np.isneginf(least))
        if len(bare):
            least[bare] = self._reached(vectors[bare], np.argmax(to_pivot[bare], axis=1), n)
        least -= SLACK
        # a is at most w + arccos(least), as cosines; beyond half a turn every cell is reached
        most = np.arccos(np.clip(least, -1, 1))
        reached = to_pivot.T + WIDE >= np.c_[np.cos(self.width), -np.sin(self.width)] @ np.stack([np.cos(most), np.sin(most)])
        if self.width.max(initial=0) + most.max(initial=0) >= np.pi:
            reached |= self.width[:, None] + most >= np.pi
        found = [], [], []
        short, loose = vectors.astype(np.float32), (least - (vectors.shape[1] + 4) * SHORT).astype(np.float32)
        for k in np.flatnonzero(reached.any(axis=1) & (self.sizes > 0)):
            cell, near = self.cells[k], np.flatnonzero(reached[k])
            step, refs = max(1, HELD // len(cell)), self.vectors[cell].T.astype(np.float32)
            for at in range(0, len(near), step):
                own = near[at : at + step]
                i, j = np.divmod(np.flatnonzero(short[own] @ refs >= loose[own, None]), len(cell))
                # few are left: exactly, and alike for like vectors
                i, j = own[i], cell[j]
                sims = np.einsum("ij,ij->i", vectors[i], self.vectors[j])
                good = sims >= least[i]
                if good.any():
                    for out, x in zip(found, self._best(i[good], j[good], sims[good]), strict=True):
                        out.append(x)
        if not found[0]:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        of, ref, sim = self._best(*(np.concatenate(x) for x in found))
        kept = _first(n, of, sim, self.ords[ref])
        return of[kept], ref[kept], sim[kept]

    def _best(self, of: np.ndarray, ref: np.ndarray, sim: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best reference of each vector and locus; of equal ones the first."""
        order = np.lexsort((self.ords[ref], -sim, self.number[ref], of))
        of, ref, sim = of[order], ref[order], sim[order]
        new = np.r_[True, (of[1:] != of[:-1]) | (self.number[ref[1:]] != self.number[ref[:-1]])][: len(of)]
        return of[new], ref[new], sim[new]

    def _reached(self, vectors: np.ndarray, nearest: np.ndarray, n: int) -> np.ndarray:
        """By vector a similarity that n loci reach, from the cells around its nearest pivot; minus infinity where these have fewer loci."""
        out = np.full(len(vectors), -np.inf)
        for k in np.unique(nearest):
            around = np.argsort(-(self.pivots @ self.pivots[k]), kind="stable")
            size = np.cumsum(self.sizes[around])
            refs = np.concatenate([self.cells[c] for c in around[: int(np.searchsorted(size, 512)) + 1]])
            refs = np.sort(refs)  # by locus
            firsts = np.flatnonzero(np.r_[True, np.diff(self.number[refs]) > 0])
            if len(firsts) < n:
                continue
            own = np.flatnonzero(nearest == k)
            step = max(1, HELD // len(refs))
            for at in range(0, len(own), step):
                best = np.maximum.reduceat(vectors[own[at : at + step]] @ self.vectors[refs].T, firsts, axis=1)
                out[own[at : at + step]] = np.partition(best, best.shape[1] - n, axis=1)[:, best.shape[1] - n]
        return out


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Equally long lists of numbers as unit rows, the zero vector as it is; without a number there is one column."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    m = flat.reshape(len(vectors), -1).astype(float) if len(flat) else np.zeros((len(vectors), 1))
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms > 0, norms, 1)


def _first(n: int, of: np.ndarray, sim: np.ndarray, ords: np.ndarray) -> np.ndarray:
    """The places of each vector's n best entries, in order."""
    order = np.lexsort((ords, -sim, of))
    of = of[order]
    return order[np.arange(len(of)) - np.searchsorted(of, of) < n]


class Found:
    """Some candidates, and each one's n best loci among the references that they have met."""

    def __init__(self, ids: pa.Array, vectors: np.ndarray, n: int) -> None:
        self.ids, self.vectors, self.n = ids, vectors, n
        self.least = np.full(len(ids), -np.inf)
        self.of, self.sim, self.ord, self.id, self.locus = (np.zeros(0, x) for x in (int, float, np.int64, object, object))

    def meet(self, refs: Block) -> None:
        of, ref, sim = refs.nearest_loci(self.vectors, self.n, self.least)
        if not len(of):
            return
        names = np.array(refs.names, object)
        of, sim, ords = np.r_[self.of, of], np.r_[self.sim, sim], np.r_[self.ord, refs.ords[ref]]
        ids, locus = np.r_[self.id, refs.ids[ref]], np.r_[self.locus, names[refs.number[ref]]]
        number = pd.factorize(locus, use_na_sentinel=False)[0]
        order = np.lexsort((ords, -sim, number, of))
        same = np.r_[False, (of[order][1:] == of[order][:-1]) & (number[order][1:] == number[order][:-1])]
        best = order[~same]
        best = best[_first(self.n, of[best], sim[best], ords[best])]
        self.of, self.sim, self.ord, self.id, self.locus = of[best], sim[best], ords[best], ids[best], locus[best]
        ends = np.searchsorted(self.of, np.arange(len(self.ids)), side="right")
        full = np.flatnonzero(ends - np.searchsorted(self.of, np.arange(len(self.ids))) == self.n)
        self.least[full] = self.sim[ends[full] - 1]

    def batch(self) -> pa.RecordBatch:
        return _best_arrays(self.ids, self.of, self.sim, self.ord, self.id, self.locus)


def _best_arrays(own: pa.Array, of: np.ndarray, sim: np.ndarray, ords: np.ndarray, ids: np.ndarray, locus: np.ndarray | list) -> pa.RecordBatch:
    """A row for each candidate, with its entries (which come by candidate, the best first) as an array."""
    fields = [pa.array(sim), pa.array(-ords), pa.array(ids, pa.string()), pa.array(locus, pa.string())]
    ends = np.searchsorted(of, np.arange(len(own) + 1)).astype(np.int32)
    return pa.RecordBatch.from_arrays([own, pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, fields=list(_STRUCT)))], names=["candidate_id", "best"])


def _regions(pivots: np.ndarray, held: np.ndarray, most: int) -> list[np.ndarray]:
    """Pivots in regions that hold at most ``most`` candidates, where one pivot doesn't hold more; cut where a region's pivots differ most."""
    out, open_ = [], [np.arange(len(pivots))]
    while open_:
        own = open_.pop()
        parts = -(-int(held[own].sum()) // most)
        if parts <= 1 or len(own) == 1:
            out.append(own)
            continue
        own = own[np.argsort(pivots[own, np.argmax(pivots[own].var(axis=0))], kind="stable")]
        upto = np.cumsum(held[own])
        at = min(max(1, int(np.searchsorted(upto, upto[-1] * (parts // 2) / parts)) + 1), len(own) - 1)
        open_ += [own[:at], own[at:]]
    return out


def _measured(references: DataFrame) -> tuple[int, int]:
    """(how many references there are, numbers of a vector)."""
    return tuple(references.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first())


def _rows_of(most: int, width: int) -> int:
    """Rows with vectors that ``most`` bytes hold."""
    return max(1, most // (8 * max(1, width) + BESIDE))


def _named_refs() -> list[Column]:
    return [F.col("locus").cast("string").alias("locus"), F.col("ref_ord").cast("long").alias("ref_ord"), F.col("ref_id").cast("string").alias("ref_id"), F.col("embedding").cast("array<double>").alias("embedding")]


def _with_one_block(candidates: DataFrame, references: DataFrame, work: Work, made: str) -> DataFrame:
    shared = candidates.sparkSession.sparkContext.broadcast(references.select(*_named_refs()).toArrow().combine_chunks())  # at most a block's rows

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = Block(*(c.combine_chunks() for c in shared.value.columns)) if shared.value.num_rows else None
        for b in batches:
            if refs is not None and b.num_rows:
                yield from work(b.column(0), _matrix(b.column(1)), refs)

    return candidates.select("candidate_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(whole, made)


def over_blocks(candidates: DataFrame, references: DataFrame, work: Work, schema: str, block_rows: int | None = None, chunk_rows: int | None = None) -> tuple[DataFrame, int]:
    """(what ``work`` gives for all candidates and each block of references, how many blocks there are).

    ``candidates``: candidate_id, embedding; ``references``: ref_id, locus, ref_ord, embedding.  References of one block (a checked
    number of bytes, or ``block_rows``) are broadcast, and nothing is shuffled.  More of them stay off the driver: every block
    meets every share of the candidates (of as many bytes, or ``chunk_rows``) as one group, so no task meets all candidates or all
    references, and a row is shuffled once for each block or share of the other side.  What ``work`` gives goes on batch by batch.
    ``schema`` has {} for the type of candidate_id.
    """
    total, width = _measured(references)
    made = schema.format(dict(candidates.dtypes)["candidate_id"])
    of_bytes = _rows_of(BLOCK_BYTES, width)
    block_rows, chunk_rows = block_rows or of_bytes, chunk_rows or of_bytes
    if total <= block_rows:
        return _with_one_block(candidates, references, work, made), 1
    vector = F.col("embedding").cast("array<double>").alias("embedding")
    blocks, shares = -(-total // block_rows), max(1, -(-candidates.count() // chunk_rows))
    spread = lambda to: F.explode(F.sequence(F.lit(0), F.lit(to - 1)).cast("array<long>"))
    kind = dict(candidates.dtypes)["candidate_id"]
    none = [F.lit(None).cast(t).alias(c) for c, t in (("locus", "string"), ("ref_ord", "long"), ("ref_id", "string"))]
    refs = references.select(F.pmod(F.xxhash64("ref_id", "ref_ord", "locus"), F.lit(blocks)).alias("block"), spread(shares).alias("share"), F.lit(True).alias("is_ref"), F.lit(None).cast(kind).alias("candidate_id"), *_named_refs())
    own = candidates.select(spread(blocks).alias("block"), F.pmod(F.xxhash64("candidate_id"), F.lit(shares)).alias("share"), F.lit(False).alias("is_ref"), "candidate_id", *none, vector)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, theirs = [], []
        for b in batches:
            mine.append(b.filter(pc.invert(b.column(2))))
            theirs.append(b.filter(b.column(2)))
        mine, theirs = (pa.Table.from_batches(x).combine_chunks() for x in (mine, theirs))
        if mine.num_rows and theirs.num_rows:
            yield from work(mine.column(3).combine_chunks(), _matrix(mine.column(7).combine_chunks()), Block(*(theirs.column(i).combine_chunks() for i in range(4, 8))))

    return own.union(refs).groupBy("block", "share").applyInArrow(met, made), blocks


def group_max(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("candidate_id", "locus").agg(F.max("similarity").alias("similarity"))


def top_n_mean(grouped: DataFrame, n: int) -> DataFrame:
    """Mean of each candidate's n best loci; n is at least 1, fewer loci give the mean of all."""
    order = Window.partitionBy("candidate_id").orderBy(F.desc("similarity"), "locus")
    return grouped.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= max(1, n)).groupBy("candidate_id").agg(F.avg("similarity").alias("top_n_mean_similarity"))


def best_by_locus(candidates: DataFrame, references: DataFrame, block_rows: int | None = None, chunk_rows: int | None = None) -> DataFrame:
    """(candidate_id, locus, ref_id, ref_ord, similarity): each candidate's best reference of every locus, by matrix products.

    ``candidates`` and ``references`` as in ``over_blocks``.  A task keeps each locus's best of a block, so pairs are never rows; the results of
    several blocks meet in a partial aggregation by candidate and locus.
    """

    def every(ids: pa.Array, vectors: np.ndarray, refs: Block) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(ids), AT_ONCE):
            sims = vectors[at : at + AT_ONCE] @ refs.vectors.T
            best = np.stack([np.argmax(sims[:, a:b], axis=1) + a for a, b in zip(refs.firsts, refs.ends, strict=True)], axis=1)
            n, m = best.shape
            locus = pa.array([refs.names[refs.number[j]] for j in refs.firsts] * n, pa.string())
            of = np.repeat(np.arange(at, at + n), m)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), locus, pa.array(refs.ids[best].ravel(), pa.string()), pa.array(refs.ords[best].ravel()), pa.array(np.take_along_axis(sims, best, 1).ravel())], names=["candidate_id", "locus", "ref_id", "ref_ord", "similarity"])

    found, blocks = over_blocks(candidates, references, every, "candidate_id {}, locus string, ref_id string, ref_ord long, similarity double", block_rows, chunk_rows)
    if blocks == 1:
        return found
    best = found.groupBy("candidate_id", "locus").agg(F.max(F.struct("similarity", (-F.col("ref_ord")).alias("o"), "ref_id")).alias("b"))
    return best.select("candidate_id", "locus", F.col("b.ref_id").alias("ref_id"), (-F.col("b.o")).alias("ref_ord"), F.col("b.similarity").alias("similarity"))


_FOUND = "array<struct<similarity:double,o:long,ref_id:string,locus:string>>"
_STRUCT = pa.struct([("similarity", pa.float64()), ("o", pa.int64()), ("ref_id", pa.string()), ("locus", pa.string())])


def top_loci(candidates: DataFrame, references: DataFrame, n: int = 5, block_rows: int | None = None, chunk_rows: int | None = None) -> DataFrame:
    """(candidate_id, best): each candidate's n best loci, as an array of struct(similarity, ref_ord, ref_id, locus), the best first.

    A locus counts by its best reference; equal similarities keep the references' order.  References of one block are broadcast, and
    nothing is shuffled.  More of them pass by each share of the candidates (``_in_turn``), block after block, so a candidate moves once,
    its n best loci are whole where they are found, and what moves doesn't grow with the loci.
    """
    n = max(1, n)
    total, width = _measured(references)
    block_rows = block_rows or _rows_of(BLOCK_BYTES, width)
    made = f"candidate_id {dict(candidates.dtypes)['candidate_id']}, best {_FOUND}"

    def selected(ids: pa.Array, vectors: np.ndarray, refs: Block) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(ids), SEARCHED):
            of, ref, sim = refs.nearest_loci(vectors[at : at + SEARCHED], n)
            yield _best_arrays(ids.slice(at, SEARCHED), of, sim, refs.ords[ref], refs.ids[ref], [refs.names[k] for k in refs.number[ref].tolist()])

    if total <= block_rows:
        found = _with_one_block(candidates, references, selected, made)
    else:
        found = _in_turn(candidates, references, n, total, width, block_rows, chunk_rows, made)
    return found.select("candidate_id", _named(F.col("best")).alias("best"))


def _in_turn(candidates: DataFrame, references: DataFrame, n: int, total: int, width: int, block_rows: int, chunk_rows: int | None, made: str) -> DataFrame:
    """Candidates in shares that lie together in space; past each share all references, those of its own region first.

    Regions are told by the nearest of some references.  A task holds a share of bounded bytes (``chunk_rows``) and one block; what its
    candidates have found bounds what later blocks are searched for, which come from ever farther away, so most of their cells are
    left out.  A reference is shuffled once for each share.  Where a row lies decides the work's order and amount, never the result.
    """
    vector = F.col("embedding").cast("array<double>").alias("embedding")
    some = references.filter(F.pmod(F.xxhash64("ref_id", "ref_ord", "locus"), F.lit(-(-total // PIVOTS))) == 0).select(vector).limit(2 * PIVOTS).toArrow()
    pivots = np.unique(_matrix(some.column(0).combine_chunks()), axis=0) if some.num_rows else np.zeros((1, width))
    spark = candidates.sparkSession
    shared = spark.sparkContext.broadcast(pivots)

    def located(rows: DataFrame) -> DataFrame:
        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    own = _matrix(b.column(b.num_columns - 1))
                    cell = np.concatenate([np.argmax(own[at : at + SEARCHED] @ shared.value.T, axis=1) for at in range(0, len(own), SEARCHED)])
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], names=[*b.schema.names, "cell"])

        return rows.mapInArrow(nearest, StructType([*rows.schema.fields, StructField("cell", IntegerType())]))

    held = np.zeros(len(pivots), int)
    for cell, count in located(candidates.select(vector)).groupBy("cell").count().collect():  # a row a pivot
        held[cell] = count
    tasks = 2 * spark.sparkContext.defaultParallelism
    share_rows = chunk_rows or max(1, min(_rows_of(SHARE_BYTES, width), -(-int(held.sum()) // tasks)))
    regions = _regions(pivots, held, share_rows)
    region, first, parts = (np.zeros(len(pivots), int) for _ in range(3))
    shares, centres = 0, []
    for k, own in enumerate(regions):
        many = -(-int(held[own].sum()) // share_rows)
        region[own], first[own], parts[own] = k, shares, max(1, many)
        shares += many
        centre = (pivots[own] * held[own, None]).sum(axis=0)
        centres.append(centre / (np.linalg.norm(centre) or 1))
    near = np.array(centres) @ np.array(centres).T
    turn = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1)
    turns = [(k, int(s), int(turn[r, k])) for r, own in enumerate(regions) if held[own].any() for s in range(first[own[0]], first[own[0]] + parts[own[0]]) for k in range(len(regions))]
    placed = lambda rows, **of: rows.join(F.broadcast(spark.createDataFrame([(i, *(int(x[i]) for x in of.values())) for i in range(len(pivots))], ", ".join(["cell int", *(f"{k} int" for k in of)]))), "cell")
    own = placed(located(candidates.select("candidate_id", vector)), first=first, parts=parts)
    kind = dict(candidates.dtypes)["candidate_id"]
    own = own.select((F.col("first") + F.pmod(F.xxhash64("candidate_id"), F.col("parts"))).cast("int").alias("share"), F.lit(-1).alias("turn"), "candidate_id", *(F.lit(None).cast(t).alias(c) for c, t in (("locus", "string"), ("ref_ord", "long"), ("ref_id", "string"))), "embedding")
    refs = placed(located(references.select(*_named_refs())), region=region).join(F.broadcast(spark.createDataFrame(turns, "region int, share int, turn int")), "region")
    refs = refs.select("share", "turn", F.lit(None).cast(kind).alias("candidate_id"), "locus", "ref_ord", "ref_id", "embedding")
    both = own.union(refs).repartitionById(max(1, shares), F.col("share")).sortWithinPartitions("turn")

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[Found] = []
        ids, vectors, waiting = [], [], []

        def meet() -> None:
            if ids:
                every, own = pa.concat_arrays(ids), np.concatenate(vectors)
                found.extend(Found(every.slice(at, SEARCHED), own[at : at + SEARCHED], n) for at in range(0, len(own), SEARCHED))
                ids.clear()
            if waiting and found:
                refs = pa.Table.from_batches(waiting).combine_chunks()
                block = Block(*(refs.column(i).combine_chunks() for i in range(3, 7)))
                for some in found:
                    some.meet(block)
            waiting.clear()

        for b in batches:
            k = int(np.searchsorted(b.column(1).to_numpy(), 0))  # candidates come first
            if k:
                ids.append(b.column(2).slice(0, k))
                vectors.append(_matrix(b.column(6).slice(0, k)))
            if k < b.num_rows:
                waiting.append(b.slice(k))
            if sum(len(x) for x in waiting) >= block_rows:
                meet()
        meet()
        for some in found:
            yield some.batch()

    return both.mapInArrow(passed, made)


def _named(best: Column) -> Column:
    return F.transform(best, lambda x: F.struct(x["similarity"].alias("similarity"), (-x["o"]).alias("ref_ord"), x["ref_id"].alias("ref_id"), x["locus"].alias("locus")))


def score_candidates(candidates: DataFrame, references: DataFrame, n: int = 5, block_rows: int | None = None) -> DataFrame:
    """(candidate_id, best_similarity, best_match_id, top_n_mean_similarity)."""
    best = top_loci(candidates, references, n, block_rows).filter(F.size("best") > 0)
    mean = F.aggregate("best", F.lit(0.0), lambda t, x: t + x["similarity"]) / F.size("best")
    return best.select("candidate_id", F.col("best")[0]["similarity"].alias("best_similarity"), F.col("best")[0]["ref_id"].alias("best_match_id"), mean.alias("top_n_mean_similarity"))


def similarity_rows(candidates: DataFrame, references: DataFrame, block_rows: int | None = None) -> DataFrame:
    """The similarity matrix: a row for each candidate and block, with the block's reference ids and similarities as arrays.

    A batch has a bounded number of similarities.  What is asked of whole rows alone is better asked of ``similarity_totals``.
    """

    def matrix(ids: pa.Array, vectors: np.ndarray, refs: Block) -> Iterator[pa.RecordBatch]:
        names, step = pa.array(refs.ids, pa.string()), max(1, HELD // len(refs.vectors))
        for at in range(0, len(ids), step):
            sims = vectors[at : at + step] @ refs.vectors.T
            ends = pa.array(np.arange(len(sims) + 1, dtype=np.int32) * len(names))
            yield pa.RecordBatch.from_arrays([ids.slice(at, step), pa.ListArray.from_arrays(ends, pa.concat_arrays([names] * len(sims))), pa.ListArray.from_arrays(ends, pa.array(sims.ravel()))], names=["candidate_id", "ref_ids", "similarities"])

    return over_blocks(candidates, references, matrix, "candidate_id {}, ref_ids array<string>, similarities array<double>", block_rows)[0]


def similarity_totals(candidates: DataFrame, references: DataFrame, block_rows: int | None = None) -> DataFrame:
    """(candidate_id, refs, total, least, most): the number, sum, least and greatest of each row of the similarity matrix.

    All products are made, but a task keeps four numbers of a candidate and block, so what is held and what moves doesn't grow with
    the references.
    """

    def totals(ids: pa.Array, vectors: np.ndarray, refs: Block) -> Iterator[pa.RecordBatch]:
        step = max(1, HELD // len(refs.vectors))
        for at in range(0, len(ids), step):
            sims = vectors[at : at + step] @ refs.vectors.T
            yield pa.RecordBatch.from_arrays([ids.slice(at, step), *(pa.array(x) for x in (np.full(len(sims), sims.shape[1]), sims.sum(axis=1), sims.min(axis=1), sims.max(axis=1)))], names=["candidate_id", "refs", "total", "least", "most"])

    found, blocks = over_blocks(candidates, references, totals, "candidate_id {}, refs long, total double, least double, most double", block_rows)
    if blocks == 1:
        return found
    return found.groupBy("candidate_id").agg(F.sum("refs").alias("refs"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))
