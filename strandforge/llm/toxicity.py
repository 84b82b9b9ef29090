"""Toxicity by compression distance: two zstandard dictionaries, one window a word."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandforge.llm.common import cut, held_out, least_hashed, record_batch, text_of

_WORD = re.compile(r"\w+")
LEVEL = 15
#: Predicted label 1 from this score on.
DECISION = 0.3
#: Words of one training text that are learnt from.
LONG_WORDS = 200_000
#: Gains are counted from -GAINS up to below GAINS.
GAINS = 64
_CACHE: dict[str, dict[str, int]] = {}
_CACHE_WORDS, _CACHE_LETTERS = 600_000, 64
_CODES: dict[str, bytes] = {}


def _code(c: str) -> bytes:
    v = _CODES.get(c)
    if v is None:
        v = _CODES[c] = hashlib.blake2b(c.encode("utf-8", "surrogatepass"), digest_size=4).digest()
    return v


def expand(words: list[str]) -> bytes:
    """Each character as a fixed 4-byte code, so that one word is long enough for the compressor to tell matches from literals."""
    return b"".join(map(_code, " " + " ".join(words) + " "))


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass(frozen=True)
class DistanceModel:
    """Both dictionaries, the window threshold, and the calibration from a text's window statistics to a probability."""

    toxic: bytes
    ordinary: bytes
    threshold: int
    weights: tuple[float, ...]

    def coders(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        out = []
        for data in (self.toxic, self.ordinary):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False))
        return out[0], out[1]

    def scorer(self):
        """text -> score; a window's gain (ordinary length less toxic length) is kept for a bounded number of words."""
        if not self.toxic:
            return lambda text: self.weights[0]
        toxic, ordinary = (c.compress for c in self.coders())
        gains = _CACHE.setdefault(hashlib.sha1(self.toxic + self.ordinary).hexdigest(), {})

        def score(text: str) -> float:
            got = []
            for w in words_of(text):
                g = gains.get(w)
                if g is None:
                    q = expand([w])
                    g = len(ordinary(q)) - len(toxic(q))
                    if len(w) <= _CACHE_LETTERS:
                        if len(gains) >= _CACHE_WORDS:
                            gains.clear()
                        gains[w] = g
                got.append(g)
            z = sum(a * b for a, b in zip(self.weights, statistics(got, self.threshold), strict=True))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def statistics(gains: list[int], threshold: int) -> tuple[float, ...]:
    """A text's window statistics: windows beyond the threshold and two levels on either side of it, and the largest gain."""
    n = len(gains)
    out = [1.0, max(0, max(gains, default=0)) / 4, math.log1p(n) / 8]
    for t in range(threshold - 2, threshold + 3, 2):
        over = sum(g >= t for g in gains)
        out += [over * 50 / n if n else 0.0, math.log1p(over)]
    return tuple(out)


def sampled_words(text: str, most: int = LONG_WORDS) -> list[str]:
    """A training text's words; of one with more than ``most`` a seeded sample from all over it, so that one row is bounded."""
    words = words_of(text)
    return words if len(words) <= most else random.Random(len(words)).sample(words, most)


def train_dictionaries(toxic: list[list[str]], ordinary: list[list[str]], toxic_bytes: int = 65536, ordinary_bytes: int = 262144, toxic_words: int = 60_000, ordinary_words: int = 200_000) -> tuple[bytes, bytes] | None:
    """A dictionary of toxic and one of ordinary text (lists of words); None where there is too little of either.

    The toxic one's text is the windows that mark toxic documents: words in at least 3 of them and there at least six times as
    frequent, by documents, as in ordinary ones.  The ordinary one's text is that of ordinary documents.  Of each a seeded
    sample of at most so many words is compressed into the dictionary.
    """
    in_t, in_o = (Counter(w for ws in x for w in set(ws)) for x in (toxic, ordinary))
    marks = {w for w, c in in_t.items() if c >= 3 and c / max(1, len(toxic)) > 6 * (in_o[w] + 0.5) / max(1, len(ordinary))}
    rng = random.Random(0)
    data = []
    for texts, keep, most, size in ((toxic, marks, toxic_words, toxic_bytes), (ordinary, None, ordinary_words, ordinary_bytes)):
        words = [w for ws in texts for w in ws if keep is None or w in keep]
        words = rng.sample(words, min(most, len(words)))
        try:
            data.append(zstandard.train_dictionary(size, [expand(words[i : i + 8]) for i in range(0, len(words), 8)], k=80, d=8).as_bytes())
        except zstandard.ZstdError:
            return None
    return data[0], data[1]


def fold_gains(data: tuple[bytes, bytes], texts: list[list[str]]) -> list[np.ndarray]:
    """How many windows of each text have which gain, from -GAINS up to below GAINS."""
    coder_t, coder_o = (c.compress for c in DistanceModel(*data, 0, ()).coders())
    known: dict[str, int] = {}
    out = []
    for ws in texts:
        for w in ws:
            if w not in known:
                q = expand([w])
                known[w] = max(-GAINS, min(GAINS - 1, len(coder_o(q)) - len(coder_t(q)))) + GAINS
        out.append(np.bincount([known[w] for w in ws], minlength=2 * GAINS).astype(np.int32))
    return out


def calibrate(data: tuple[bytes, bytes], unseen: list[tuple[int, np.ndarray]], allow: float = 1e-3) -> DistanceModel:
    """Threshold and weights from texts (label, gains) that the dictionaries they were measured with haven't seen.

    ``allow`` is the share of ordinary windows that may pass the threshold.
    """
    flat = sum((g for y, g in unseen if not y), np.zeros(2 * GAINS, np.int64))
    beyond = flat[::-1].cumsum()[::-1] / max(1, flat.sum())
    threshold = next((t for t in range(1, GAINS) if beyond[t + GAINS] <= allow), GAINS)
    x = np.array([statistics(np.repeat(np.arange(-GAINS, GAINS), g).tolist(), threshold) for _, g in unseen])
    y = np.array([float(y) for y, _ in unseen])
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps of ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.05 * np.eye(len(w)), x.T @ (y - p) - 0.05 * w)
        w += step
        if abs(step).max() < 1e-6:
            break
    return DistanceModel(*data, threshold, tuple(w.tolist()))


def train_toxicity_model(
    docs: DataFrame, labels: DataFrame, most_toxic: int = 1500, most_ordinary: int = 3000, most_chars: int = 8_000_000, folds: int = 3,
    long_words: int = LONG_WORDS, toxic_words: int = 60_000, ordinary_words: int = 200_000,
) -> DistanceModel:
    """Fit on a bounded sample of labelled rows that aren't held out: by class the rows with the least hash of the id, up to a
    number of rows and, beyond the first, of characters; of a text of more than ``long_words`` words a
    sample of them.  At most ``toxic_words`` and ``ordinary_words`` of their words go into the dictionaries.

    An executor trains the dictionaries of all the sample, others those without each fold and what these gain on it; the driver
    gets both dictionaries and a row of counts for each sampled text, and fits threshold and weights.
    """
    told = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    told = told.withColumn("toxic", F.when(F.col("toxic") == 1, 1).otherwise(0))
    counts = {r.toxic: (r["count"], most_toxic if r.toxic else most_ordinary) for r in told.groupBy("toxic").count().collect()}  # two rows
    ids = least_hashed(told, "toxic", counts, 5)
    some = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(ids), "doc_id")  # ids: most_toxic + most_ordinary rows
    some = some.groupBy("doc_id", "toxic", "order").agg(F.min("text").alias("text"))
    by_order = Window.partitionBy("toxic").orderBy("order", "doc_id")
    before = F.sum(F.char_length("text")).over(by_order) - F.char_length("text")
    some = cut(some.withColumn("before", before).withColumn("fold", F.row_number().over(by_order) % folds).filter(F.col("before") <= most_chars).select("toxic", "fold", "order", "doc_id", "text"))
    sizes = {r.toxic: r["count"] for r in some.groupBy("toxic").count().collect()}
    base = DistanceModel(b"", b"", 0, ((sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2),))  # too little text to learn from: the base rate for all

    def train(sample):
        k = int(sample["k"].iloc[0])
        sample = sample.sort_values(["order", "doc_id"])
        rows = [(y, f, sampled_words(t, long_words)) for y, f, t in zip(sample["toxic"].tolist(), sample["fold"].tolist(), sample["text"].tolist(), strict=True)]
        data = train_dictionaries(*([ws for y, f, ws in rows if y == label and f != k] for label in (1, 0)), toxic_words=toxic_words, ordinary_words=ordinary_words)
        empty = {"k": k, "toxic": b"", "ordinary": b"", "label": -1, "gains": b""}
        if data is None or k == folds:
            return pd.DataFrame([empty | ({} if data is None else {"toxic": data[0], "ordinary": data[1]})])
        own = [(y, ws) for y, f, ws in rows if f == k]
        return pd.DataFrame([empty | {"label": y, "gains": g.tobytes()} for (y, _), g in zip(own, fold_gains(data, [ws for _, ws in own]), strict=True)] or [empty])

    dealt = some.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(folds))))
    got = dealt.groupBy("k").applyInPandas(train, "k int, toxic binary, ordinary binary, label int, gains binary").collect()  # a row for each sampled text
    whole = next(((bytes(r.toxic), bytes(r.ordinary)) for r in got if r.k == folds and r.toxic), None)
    unseen = [(r.label, np.frombuffer(bytes(r.gains), np.int32)) for r in sorted(got, key=lambda r: (r.k, r.label, bytes(r.gains))) if r.label >= 0]
    if whole is None or len(unseen) < sum(sizes.values()):
        return base
    return calibrate(whole, unseen)


def score_toxicity(docs: DataFrame, labels: DataFrame | None = None, model: DistanceModel | None = None, **bounds: int) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; labels, language, source and id are no inputs of a score.

    ``bounds`` are those of ``train_toxicity_model``'s sample.
    Null and empty texts have no windows and get the calibration's lowest evidence; very long texts are scored whole.  Without
    anything to learn from every score is the base rate.  An id that is labelled several times is toxic if any label says so; rows that
    tie in the sample's order come by id.  A score of exactly 0.3 is predicted 1.  Repeated rows give as many rows, a null id is kept,
    an empty table gives none, extra columns are ignored.
    """
    model = model or train_toxicity_model(docs, labels, **bounds)
    shared = docs.sparkSession.sparkContext.broadcast((model.toxic, model.ordinary, model.threshold, model.weights))  # two dictionaries of set size
    schema = "doc_id long, held_out boolean, score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = DistanceModel(*shared.value).scorer()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                got = [score(t) for t in part.column(0).to_pylist()]
                yield record_batch(schema, [part.column(1), part.column(2), got, [int(s >= DECISION) for s in got]])

    return docs.select(text_of().alias("text"), F.col("doc_id").cast("long"), held_out().alias("held_out")).mapInArrow(run, schema)
