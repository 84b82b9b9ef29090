"""SimHash near-duplicates, linked through sharded BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandforge.llm.common import cut, fresh, join_by_key, map_rows, record_batch, text_of
from strandforge.llm.components import connected_components

#: Members of a subtree; a shard with more is split into subtrees that are matched pair by pair.
SUBTREE = 4096
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, words: int = 4) -> int:
    """Majority bits of the XXH64 (seed 42) of the text's word shingles, as an unsigned number; no words: 0."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        digests = xxhash.xxh64_digest(joined, 42)
    else:
        spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
        starts, ends = [0, *(x + 1 for x in spaces)], [*spaces, len(joined)]
        h = xxhash.xxh64_digest
        digests = b"".join([h(joined[s:e], 42) for s, e in zip(starts, ends[words - 1 :], strict=False)])
    table = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    if len(table) < 256:
        counts = np.unpackbits(table, axis=1).sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(table[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(table)).tobytes(), "big")


class BKTree:
    """Children are keyed by their integer Hamming distance to the parent."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.children: list[list[tuple[int, int]]] = [[] for _ in values]
        todo = [np.arange(len(values))] if len(values) else []
        while todo:  # the first of a set is its root; the others part by distance to it
            own = todo.pop()
            if len(own) == 1:
                continue
            rest = own[1:]
            d = np.bitwise_count(values[rest] ^ values[own[0]])
            order = np.argsort(d, kind="stable")
            rest, d = rest[order], d[order]
            cuts = np.flatnonzero(np.diff(d)) + 1
            for part, k in zip(np.split(rest, cuts), d[np.concatenate(([0], cuts))].tolist(), strict=True):
                self.children[own[0]].append((k, int(part[0])))
                todo.append(part)

    def visit(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, indices of the queries within the radius of it); only edges within the radius are followed."""
        todo = [(0, np.arange(len(queries)))] if len(self.values) else []
        while todo:
            node, own = todo.pop()
            d = np.bitwise_count(queries[own] ^ self.values[node]).astype(np.int16)
            if (near := d <= radius).any():
                yield node, own[near]
            for k, child in self.children[node]:
                if (keep := np.abs(d - k) <= radius).any():
                    todo.append((child, own[keep]))


def spanning_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``left`` (right None) or between ``left`` and ``right``, as pairs of values."""
    queries = left if right is None else right
    base = 0 if right is None else len(left)
    every = left if right is None else np.concatenate([left, right])
    label = np.arange(len(every))
    for node, near in BKTree(left).visit(queries, radius):
        found = label[near + base]
        if (odd := found != label[node]).any():
            label[np.isin(label, np.append(np.unique(found[odd]), label[node]))] = label[node]
    _, first = np.unique(label, return_index=True)
    root = np.zeros(len(every), np.int64)
    root[label[first]] = first
    root = root[label]
    moved = np.flatnonzero(root != np.arange(len(every)))
    return list(zip(every[moved].tolist(), every[root[moved]].tolist(), strict=True))


def shard_bits(n: int, radius: int = 4) -> list[list[tuple[int, int]]]:
    """Shard layouts: fingerprints within the radius agree wholly on at least one of the returned sets of bit ranges.

    With p parts and p - radius of them agreeing by the pigeonhole principle, more parts give longer keys; the layout
    is the first whose shards hold a few dozen of n random fingerprints.
    """
    for parts in range(radius + 1, 2 * radius + 1):
        edges = [64 * i // parts for i in range(parts + 1)]
        ranges = [(edges[i], edges[i + 1]) for i in range(parts)]
        keys = [list(x) for x in combinations(ranges, parts - radius)]
        if n <= 48 << min(sum(b - a for a, b in k) for k in keys):
            break
    return keys


def _keys(layout: list[list[tuple[int, int]]]) -> Column:
    """An array of (band, value): a fingerprint's bits in every set of ranges."""
    keys = []
    for k, ranges in enumerate(layout):
        value, width = F.lit(0).cast("long"), 0
        for a, b in ranges:
            value = value.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")), width))
            width += b - a
        keys.append(F.struct(F.lit(k).alias("band"), value.alias("value")))
    return F.array(*keys)


def link_fingerprints(distinct: DataFrame, radius: int = 4, subtree: int = SUBTREE) -> DataFrame:
    """Distinct fingerprints (fp long, least long) to a spanning forest (a, b, a_least, b_least) of all links within the radius.

    A shard is one value of one set of agreeing bits.  Its fingerprints go to BK-trees of at most about ``subtree``
    members, and every member is sent as a query to each tree of its own shard and no other; a task holds two subtrees
    at a time whatever the shard's size.  A shard of so many trees that copying its members to each would exceed the
    finest layout is dealt again by that layout first.  Trees travel by shuffle, not broadcast: all trees together
    grow with the corpus.  A task returns a spanning forest, never the pairs of a group.
    """
    n = distinct.count()
    finest = shard_bits(1 << 62, radius)
    group = ["band", "value", "band2", "value2"]
    members = distinct.select("fp", "least", F.explode(_keys(shard_bits(n, radius))).alias("k"))
    members = members.select("fp", "least", "k.band", "k.value", F.lit(-1).alias("band2"), F.lit(0).cast("long").alias("value2"))
    sizes = cut(members.groupBy(group).agg(F.count("*").alias("n")).filter("n > 1"))
    dense = sizes.filter(F.col("n") > subtree * len(finest))
    sized = members.join(sizes.filter(F.col("n") <= subtree * len(finest)), group)
    if not dense.isEmpty():
        again = members.join(dense.select(group), group, "left_semi").select("fp", "least", "band", "value", F.explode(_keys(finest)).alias("k"))
        again = again.select("fp", "least", "band", "value", F.col("k.band").alias("band2"), F.col("k.value").alias("value2"))
        sized = sized.unionByName(again.join(again.groupBy(group).agg(F.count("*").alias("n")).filter("n > 1"), group))
    tasks = (
        sized.withColumn("subs", F.ceil(F.col("n") / subtree).cast("long"))
        .withColumn("sub", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("subs")).cast("int"))
        .select(*group, "fp", "least", "sub", F.explode(F.sequence(F.lit(0), (F.col("subs") - 1).cast("int"))).alias("other"))
        .select(*group, F.least("sub", "other").alias("i"), F.greatest("sub", "other").alias("j"), "sub", "fp", "least")
    )
    dealt = [*group, "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_key = [], None

        def links() -> list[tuple[int, int, int | None, int | None]]:
            sub_, fp = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            fp = fp.view(np.uint64)
            if held_key[4] == held_key[5]:
                found = spanning_links(np.sort(fp), None, radius)
            else:
                found = spanning_links(fp[sub_ == held_key[4]], fp[sub_ == held_key[5]], radius)
            if not found:
                return []
            least = {f: m for part in held for f, m in zip(part[1].view(np.uint64).tolist(), part[2], strict=True)}
            return [(a, b, least[a], least[b]) for a, b in found]

        out: list[tuple] = []
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(8)]
            least = b.column(8).to_pylist()
            change = np.zeros(b.num_rows, bool)
            for c in cols[:6]:
                change[1:] |= c[1:] != c[:-1]
            at = [0, *np.flatnonzero(change).tolist(), b.num_rows]
            for s, e in zip(at[:-1], at[1:], strict=True):
                key = tuple(int(c[s]) for c in cols[:6])
                if held_key is not None and key != held_key:
                    out += links()
                    held = []
                held_key = key
                held.append((cols[6][s:e], cols[7][s:e], least[s:e]))
            if len(out) > 50_000:
                yield _edges(out)
                out = []
        if held:
            out += links()
        yield _edges(out)

    return tasks.repartition(*dealt).sortWithinPartitions(*dealt).mapInArrow(run, "a long, b long, a_least long, b_least long")


def _edges(pairs: list[tuple]) -> pa.RecordBatch:
    a, b = (np.array([x[i] for x in pairs], np.uint64).view(np.int64) for i in (0, 1))
    return record_batch("a long, b long, a_least long, b_least long", [a, b, [x[2] for x in pairs], [x[3] for x in pairs]])


def _fingerprints(docs: DataFrame) -> DataFrame:
    signed = lambda t: ((x := fingerprint(t)) - (1 << 64 if x >> 63 else 0),)
    some = docs.select(text_of().alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    return cut(map_rows(some.select("text", "doc_id", F.xxhash64("text").alias("mark")), signed, "doc_id long, mark long, fp long", 1))


def _rooted(prints: DataFrame, radius: int, subtree: int) -> DataFrame:
    """(fp, n, least, component_id, root) of every fingerprint: its rows, its least id, the component's least id and fingerprint.

    Nodes are (no id, least id, fingerprint), so the component's least node has its least id and nothing is dealt by component.
    """
    least = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    node = lambda fp, m: F.struct(F.col(m).isNull().alias("no_id"), F.col(m).alias("least"), F.col(fp).alias("fp"))
    edges = link_fingerprints(least.select("fp", "least"), radius, subtree).select(node("a", "a_least").alias("a"), node("b", "b_least").alias("b"))
    roots = connected_components(edges).select(F.col("node.fp").alias("_fp"), "root")
    return least.join(roots, F.col("fp") == F.col("_fp"), "left").select("fp", "n", "least", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("root.least")).alias("component_id"), F.coalesce("root.fp", "fp").alias("root"))


def simhash_groups(docs: DataFrame, radius: int = 4, subtree: int = SUBTREE) -> DataFrame:
    """(doc_id, fp long, component_id) for every row of ``docs`` (doc_id, text; other columns are ignored).

    Null and empty texts have fingerprint 0 and are linked like any other; a very long text is hashed whole.  Rows with the same id
    and text give as many rows.  component_id is the least id among all rows of the component; a null id is never the least, and a
    component without any id has a null one.  A bit that is set in exactly half the hashes is 0.  An empty table gives an empty result.
    """
    prints = _fingerprints(docs)
    by_print = cut(_rooted(prints, radius, subtree).select("fp", "n", "component_id"))
    return join_by_key(prints.select("doc_id", "fp"), by_print, "fp", "n", by_print.agg(F.sum("n")).first()[0] or 0).select("doc_id", "fp", "component_id")


def keep_one_per_group(docs: DataFrame, radius: int = 4, subtree: int = SUBTREE) -> DataFrame:
    """One row of ``docs`` for every near-duplicate group: that with the least id, a row without an id only where none has one.

    Rows are told apart by id and text, so rows that share an id and differ in text are judged each, and rows without an id
    stay where they are alone.  Of rows of a group that tie in the id the one with the least hash of the text stays, and of rows
    equal in id and text any one.  Null and empty texts are one group; very long texts are hashed whole.  An empty table gives an
    empty one.  All columns are kept, whatever their names.
    """
    prints = _fingerprints(docs)
    rooted = cut(_rooted(prints, radius, subtree).select("fp", "n", "root"))
    total = rooted.agg(F.sum("n")).first()[0] or 0
    node = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("mark").alias("mark"))
    # the least of a fingerprint's rows first, so that a group's rows are never dealt by group
    firsts = prints.groupBy("fp").agg(F.min(node).alias("least"))
    heads = firsts.join(rooted, "fp").groupBy("root").agg(F.min("least").alias("least"))
    id_, mark_, rows_ = (fresh(x, docs) for x in ("_id", "_mark", "_rows"))
    chosen = heads.select(F.col("least.id").alias(id_), F.col("least.mark").alias(mark_)).distinct()
    several = prints.groupBy(F.col("doc_id").alias("d"), F.col("mark").alias("m")).agg(F.count("*").alias(rows_))
    chosen = cut(chosen.join(several, F.col(id_).eqNullSafe(F.col("d")) & (F.col(mark_) == F.col("m"))).select(id_, mark_, rows_))
    kept = docs.join(chosen, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(text_of()) == F.col(mark_)))
    if chosen.filter(F.col(rows_) > 1).isEmpty():
        return kept.select(docs.columns)
    once = kept.filter(F.col(rows_) == 1)
    return once.unionByName(kept.filter(F.col(rows_) > 1).dropDuplicates([id_, mark_])).select(docs.columns)
