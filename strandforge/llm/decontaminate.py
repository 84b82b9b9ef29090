"""Benchmark decontamination: rare n-gram seeds, a bound on the score, then Smith-Waterman alignment."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandforge.llm.common import record_batch, text_of

_TOKEN = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words of a block of test items; one block's seeds are broadcast at a time.
BLOCK_WORDS = 1_000_000
#: Share of an item's seeds, the rarest in the corpus, whose windows are aligned first.
RARE = 0.8


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def smith_waterman(item: np.ndarray, window: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[int, int, int]:
    """(best local score, start, end) of word ids; start and end are the aligned words of ``window``, end exclusive.

    A row is one vector step: with a linear gap, gaps along the row are a running maximum.
    """
    n = len(window)
    j = np.arange(n + 1)
    score = np.zeros(n + 1, np.int64)
    begin = j.copy()
    best, found = 0, (0, 0)
    for w in item:
        diag = score[:-1] + np.where(window == w, match, mismatch)
        up = score[1:] + gap
        row = np.zeros(n + 1, np.int64)
        start = j.copy()
        take_diag = diag >= up
        row[1:] = np.where(take_diag, diag, up)
        start[1:] = np.where(take_diag, begin[:-1], begin[1:])
        fresh = row <= 0
        row[fresh] = 0
        start[fresh] = j[fresh]
        lifted = row - gap * j  # a gap of k words along the row costs k gaps
        top = np.maximum.accumulate(lifted)
        along = top > lifted
        if along.any():
            at = np.maximum.accumulate(np.where(~along, j, 0))
            row = top + gap * j
            start = start[at]
            gone = row <= 0
            row[gone], start[gone] = 0, j[gone]
        score, begin = row, start
        k = int(score.argmax())
        if score[k] > best:
            best, found = int(score[k]), (int(begin[k]), k)
    return best, *found


class SeedIndex:
    """The n-grams of a block of test items; items of fewer than n words are one shorter n-gram each."""

    def __init__(self, items: list[list[str]], n: int = 3):
        self.n = n
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for ws in items for w in ws}))}
        self.items = {k: np.array([self.vocabulary[w] for w in ws], np.int64) for k, ws in enumerate(items) if ws}
        self.counts = {k: np.unique(ids, return_counts=True) for k, ids in self.items.items()}
        by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, ids in self.items.items():
            by_length.setdefault(min(n, len(ids)), []).append((self.keys(ids, min(n, len(ids))), k))
        #: For each length: its seeds' keys (ascending, distinct), the number of the first, where each one's places begin, their items and offsets.
        self.tables: dict[int, tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.seeds = 0
        for m, parts in sorted(by_length.items()):
            every = np.concatenate([x for x, _ in parts])
            item = np.concatenate([np.full(len(x), k) for x, k in parts])
            offset = np.concatenate([np.arange(len(x)) for x, _ in parts])
            order = np.lexsort((offset, item, every))
            keys, first = np.unique(every[order], return_index=True)
            self.tables[m] = (keys, self.seeds, np.append(first, len(every)), item[order], offset[order])
            self.seeds += len(keys)

    @staticmethod
    def keys(ids: np.ndarray, m: int) -> np.ndarray:
        """64-bit keys of the runs of m word ids; equal keys are compared again by the alignment."""
        out = np.zeros(max(0, len(ids) - m + 1), np.uint64)
        for i in range(m):
            out = (out ^ ids[i : i + len(out)].astype(np.uint64)) * _MIX
            out ^= out >> np.uint64(29)
        return out

    def number(self, text: str) -> np.ndarray:
        """A text's words as numbers of the vocabulary; 0 is a word of no item."""
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in _TOKEN.findall(text.lower())], np.int64)

    def found(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, indices into its table, places in the text) of the seeds of each length that a text holds."""
        for m, (keys, *_) in self.tables.items():
            if len(ids) < m:
                continue
            run = ids[: len(ids) - m + 1] > 0
            for i in range(1, m):
                run = run & (ids[i : i + len(run)] > 0)
            places = np.flatnonzero(run)
            if len(places):
                text_keys = self.keys(ids, m)[places]
                at = np.minimum(np.searchsorted(keys, text_keys), len(keys) - 1)
                hit = keys[at] == text_keys
                if hit.any():
                    yield m, at[hit], places[hit]

    def rare(self, documents: np.ndarray, share: float = RARE) -> list[np.ndarray]:
        """Places of each length's table, as flags, whose seed is among the ``share`` of its item's that the fewest documents hold; ties stay.

        What is rare is told item by item, so it doesn't depend on the number of documents.
        """
        wanted = []
        for keys, number, first, item, _ in self.tables.values():
            n = np.repeat(documents[number : number + len(keys)], np.diff(first))
            order = np.lexsort((n, item))
            starts = np.flatnonzero(np.r_[True, item[order][1:] != item[order][:-1]])
            sizes = np.diff(np.append(starts, len(order)))
            limit = n[order][starts + np.ceil(sizes * share).astype(int) - 1]
            most = np.zeros(len(order), n.dtype)
            most[order] = np.repeat(limit, sizes)
            wanted.append(n <= most)
        return wanted

    def windows(self, ids: np.ndarray, rare: list[np.ndarray] | None = None) -> Iterator[tuple[int, int, int]]:
        """(item, first word, end) of the stretches of a text that seeds of one item point to, those of a rare seed first.

        A seed points to where its item would begin; stretches whose beginnings lie within half of the item are one.
        """
        items, begins, seldom = [], [], []
        lengths = list(self.tables)
        for m, at, places in self.found(ids):
            _, _, first, item, offset = self.tables[m]
            many = first[at + 1] - first[at]
            where = np.repeat(first[at], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            place = np.repeat(places, many)
            seldom.append(np.ones(len(where), bool) if rare is None else rare[lengths.index(m)][where])
            items.append(item[where])
            begins.append(place - offset[where])
        if not sum(map(len, items)):
            return
        item, begin, led = np.concatenate(items), np.concatenate(begins), np.concatenate(seldom)
        order = np.lexsort((begin, item))
        item, begin, led = item[order], begin[order], led[order]
        owners = np.unique(item)
        slack = np.array([len(self.items[k]) // 2 + 2 for k in owners.tolist()], np.int64)[np.searchsorted(owners, item)]
        new = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > slack[1:])])
        ends = np.append(new[1:], len(item))
        for k in np.argsort(~np.logical_or.reduceat(led, new), kind="stable").tolist():
            s, e = int(new[k]), int(ends[k])
            length, room = len(self.items[int(item[s])]), int(slack[s])
            yield int(item[s]), max(0, int(begin[s]) - room), min(len(ids), int(begin[e - 1]) + length + room)

    def most_matches(self, item: int, window: np.ndarray) -> int:
        """Words that an alignment of the item and the window can match at most: those that both have, as often as both do."""
        words, counts = self.counts[item]
        at = np.minimum(np.searchsorted(words, window), len(words) - 1)
        return int(np.minimum(np.bincount(at[words[at] == window], minlength=len(words)), counts).sum())

    def leaks(self, ids: np.ndarray, least: float, rare: list[np.ndarray] | None, known: dict) -> Iterator[tuple[int, float, int, int]]:
        """(item, ratio, first word, end) of the windows whose alignment reaches ``least``; ``known`` keeps those of equal windows.

        Windows of rare seeds come first.  A window whose words in common can't reach what its item has already reached is not aligned.
        """
        best: dict[int, float] = {}
        for item, first, end in self.windows(ids, rare):
            own, window = self.items[item], ids[first:end]
            if self.most_matches(item, window) / len(own) < best.get(item, least):
                continue
            key = (item, window.tobytes())
            if key not in known:
                known[key] = smith_waterman(own, window)
            score, start, stop = known[key]
            if (ratio := score / (2 * len(own))) >= least:
                best[item] = max(ratio, best.get(item, least))
                yield item, round(ratio, 6), first + start, first + stop


_INDEXES: dict[str, SeedIndex] = {}


def _index_of(key: str, items: list[tuple[int, list[str]]], n: int) -> SeedIndex:
    """The worker's index of a block: built by its first task, kept for the others; of earlier blocks two stay."""
    if key not in _INDEXES:
        while len(_INDEXES) > 2:
            del _INDEXES[next(iter(_INDEXES))]
        _INDEXES[key] = SeedIndex([ws for _, ws in items], n)
    return _INDEXES[key]


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The test items (id, words), so many at a time that a block has about ``block_words`` words (a single longer item is a block)."""
    items = benchmark.filter(F.col("item_id").isNotNull()).select(text_of().alias("text"), F.col("item_id").cast("long"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # a word counts once, and again for every 16 characters, so that long words are bounded too
            yield record_batch("words long", [[sum(1 + len(w) // 16 for w in tokens(t)) for t in b.column(0).to_pylist()]])

    words = items.mapInArrow(measure, "words long").agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    blocks = -(-words // block_words) or 1
    for k in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text", F.lit(3)), F.lit(blocks)) == k) if blocks > 1 else items
        yield [(r.item_id, tokens(r.text)) for r in own.orderBy("item_id", "text").collect()]  # bounded by block_words


def _rare_seeds(texts: DataFrame, shared, key: str, n: int, share: float) -> list[np.ndarray]:
    """Flags of the rare seeds of a block, from the number of documents that hold each seed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index_of(key, shared.value, n)
        sums = np.zeros(index.seeds, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                for text in b.column(0).slice(at, 512).to_pylist():
                    for m, seeds, _ in index.found(index.number(text)):
                        sums[index.tables[m][1] + np.unique(seeds)] += 1
        some = np.flatnonzero(sums)
        for s in range(0, len(some), 100_000):
            part = some[s : s + 100_000]
            yield record_batch("seed long, n long", [part, sums[part]])

    index = _index_of(key, shared.value, n)
    got = texts.select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()  # at most a block's words
    documents = np.zeros(index.seeds, np.int64)
    documents[got["seed"].to_numpy()] = got["n"].to_numpy()
    return index.rare(documents, share)


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, n: int = 3, share: float = RARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, ratio, start_word, end_word): alignments of test items in documents, the best of each pair.

    A first pass counts in how many documents each of the items' n-grams occurs.  The n-grams then join documents to items: windows
    that one of the rarest ``share`` of an item's points to are aligned first, if the words they share with the item could reach
    the ratio, and those of common n-grams alone only where they could also beat what the item has reached by then.  So ``share``
    changes the work and no row.  ratio is the Smith-Waterman score (match 2, mismatch and gap -1, lower-cased words) over that of the item with
    itself; 0.5 lets about one word in three be replaced or dropped.

    Test items come in blocks of a bounded number of words, so what is broadcast or counted is bounded; every block meets every document.
    Null and empty texts, and items without a word, match nothing; very long texts are read whole.  Repeated rows are one document by
    id: each (doc_id, item_id) is returned once, by the highest ratio, then the earliest start, then the latest end.  Rows
    without an id are ignored.  Empty tables give an empty result.  Other columns are ignored, whatever their names.
    """
    texts = docs.filter(F.col("doc_id").isNotNull()).select(text_of().alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    schema = "doc_id long, item_id long, ratio double, start_word long, end_word long"
    found = None
    for items in _blocks(benchmark, block_words):
        shared, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
        rare = docs.sparkSession.sparkContext.broadcast(_rare_seeds(texts, shared, key, n, share))

        def align(batches: Iterator[pa.RecordBatch], shared=shared, rare=rare, key=key) -> Iterator[pa.RecordBatch]:
            index = _index_of(key, shared.value, n)
            for b in batches:
                for at in range(0, b.num_rows, 512):
                    out: list[tuple] = []
                    known: dict = {}
                    for text, doc in zip(b.column(0).slice(at, 512).to_pylist(), b.column(1).slice(at, 512).to_pylist(), strict=True):
                        out += [(doc, shared.value[item][0], *rest) for item, *rest in index.leaks(index.number(text), least, rare.value, known)]
                    yield record_batch(schema, list(zip(*out, strict=True)) or [[]] * 5)

        part = texts.mapInArrow(align, schema)
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("ratio", (-F.col("start_word")).alias("s"), "end_word")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.ratio", (-F.col("best.s")).alias("start_word"), F.col("best.end_word").alias("end_word"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, n: int = 3, share: float = RARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents without a leaked test item, found as by ``find_leaks``.

    Every row is judged by its own text: rows without an id and rows that share one like any other, repeated rows each.  Null and
    empty texts stay; very long ones are read whole.  Empty tables drop nothing.  All columns are kept, whatever their names.
    """
    at_text = docs.columns.index("text")
    texts, kept = docs.select(text_of().alias("text")), docs
    for items in _blocks(benchmark, block_words):
        shared, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
        rare = docs.sparkSession.sparkContext.broadcast(_rare_seeds(texts, shared, key, n, share))

        def clean(batches: Iterator[pa.RecordBatch], shared=shared, rare=rare, key=key) -> Iterator[pa.RecordBatch]:
            index = _index_of(key, shared.value, n)
            for b in batches:
                for at in range(0, b.num_rows, 512):
                    part, known = b.slice(at, 512), {}
                    yield part.filter(pa.array([next(index.leaks(index.number(t or ""), least, rare.value, known), None) is None for t in part.column(at_text).to_pylist()], pa.bool_()))

        kept = kept.mapInArrow(clean, docs.schema)
    return kept
