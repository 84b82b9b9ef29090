"""Language identification with a blended-spectrum string kernel."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandforge.llm.common import held_out, least_hashed, record_batch, text_of

#: Buckets of the hashed n-gram space.
BUCKETS = 1 << 17
_LETTER: np.ndarray | None = None


def _is_letter(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters; those beyond U+FFFF, rare, are looked up one by one."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(i).isalpha() for i in range(0x10000)] + [False])
    out = _LETTER[np.minimum(codes, 0x10000)]
    if len(high := np.flatnonzero(codes > 0xFFFF)):
        points, at = np.unique(codes[high], return_inverse=True)
        out[high] = np.array([chr(c).isalpha() for c in points.tolist()])[at]
    return out


def ngram_presence(text: str, longest: int = 4) -> np.ndarray:
    """Sorted buckets of the n-grams (n = 1..longest) that occur in the lower-cased text, with runs of non-letters as one space; empty if it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _is_letter(codes)
    if not is_letter.any():
        return np.zeros(0, np.int64)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    codes = np.where(is_letter, codes, np.uint32(32))[keep]
    codes = np.concatenate((np.array([32], np.uint32), codes, np.array([32], np.uint32)))
    mark = np.zeros(BUCKETS, bool)
    rolled = np.zeros(len(codes), np.uint32)
    for n in range(1, longest + 1):
        if len(codes) < n:
            break
        rolled = (rolled[: len(codes) - n + 1] + codes[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
        rolled ^= rolled >> np.uint32(15)
        mark[(rolled * np.uint32(0x85EBCA6B)) >> np.uint32(15)] = True
    return np.flatnonzero(mark)


@dataclass(frozen=True)
class KernelModel:
    """Scores are K(x, landmarks) @ beta; ``weights`` is landmarks' presence, transposed, times beta, so that a batch is one product.

    ``buckets`` names the n-grams that a landmark has, one row of ``weights`` each; others add nothing to a kernel value.
    """

    languages: list[str]
    buckets: np.ndarray
    weights: np.ndarray
    sharpness: float

    def scores(self, presence: list[np.ndarray]) -> np.ndarray:
        """One-versus-rest scores of a batch: the presence matrix (texts by landmarks' n-grams) times the folded weights."""
        column = np.full(BUCKETS, -1, np.int32)
        column[self.buckets] = np.arange(len(self.buckets))
        matrix = np.zeros((len(presence), len(self.buckets)), np.float32)
        for row, p in zip(matrix, presence, strict=True):
            at = column[p]
            row[at[at >= 0]] = 1 / np.sqrt(max(1, len(p)))
        return (matrix @ self.weights).astype(float)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        presence = [ngram_presence(t) for t in texts]
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        f = self.scores(presence)
        e = np.exp(self.sharpness * (f - f.max(axis=1, keepdims=True)))
        share = e / e.sum(axis=1, keepdims=True)
        best = f.argmax(axis=1)
        return (
            [self.languages[k] if len(p) else "und" for k, p in zip(best.tolist(), presence, strict=True)],
            [float(s[k]) if len(p) else 0.0 for s, k, p in zip(share, best.tolist(), presence, strict=True)],
        )


def kernel(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Normalised presence kernel |x and y| / sqrt(|x| |y|)."""
    dense = np.zeros((BUCKETS, len(b)), np.float32)
    for j, y in enumerate(b):
        dense[y, j] = 1 / np.sqrt(max(1, len(y)))
    return np.stack([dense[x].sum(axis=0) / np.sqrt(max(1, len(x))) for x in a]) if a else np.zeros((0, len(b)))


def fit(presence: list[np.ndarray], langs: list[str], landmarks_per_language: int = 60, ridge: float = 1e-2, sharpness: float = 4.0) -> KernelModel:
    """Kernel ridge regression on the Nyström features of landmarks, one column of targets for each language."""
    rows = [i for i, p in enumerate(presence) if len(p)]
    names = sorted({langs[i] for i in rows})
    if not names:
        return KernelModel([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), sharpness)
    chosen = [i for n in names for i in [i for i in rows if langs[i] == n][:landmarks_per_language]]
    x, marks = [presence[i] for i in rows], [presence[i] for i in chosen]
    c, w = kernel(x, marks).astype(float), kernel(marks, marks).astype(float)
    y = np.array([[1.0 if langs[i] == n else -1.0 for n in names] for i in rows])
    weigh = np.array([len(rows) / (len(names) * sum(langs[j] == langs[i] for j in rows)) for i in rows])[:, None]
    beta = np.linalg.lstsq(c.T @ (weigh * c) + ridge * len(rows) / len(names) * w + 1e-6 * np.eye(len(marks)), c.T @ (weigh * y), rcond=None)[0]
    weights = np.zeros((BUCKETS, len(names)), np.float32)
    for b, m in zip(beta, marks, strict=True):
        weights[m] += (b / np.sqrt(len(m))).astype(np.float32)
    buckets = np.flatnonzero(weights.any(axis=1))
    return KernelModel(names, buckets, weights[buckets], sharpness)


def train_language_model(docs: DataFrame, per_language: int = 300, landmarks_per_language: int = 60) -> KernelModel:
    """Fit on at most ``per_language`` rows of each language, those with the least hash of the id.

    Rows count that aren't held out and have a language, an id and a letter.  The executors turn the whole texts into n-gram
    buckets; the driver gets those buckets alone, at most BUCKETS for each sampled row.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = {r.lang: (r["count"], per_language) for r in known.groupBy("lang").count().collect()}  # one row a language, as the model's columns
    ids = least_hashed(known.select("doc_id", "lang"), "lang", counts, 11).select("doc_id").distinct()
    some = known.select(text_of().alias("text"), F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"))
    some = some.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("r")).select("r.text", "r.lang", "doc_id")  # ids: per_language rows a language; a repeated id counts once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                texts = b.column(0).slice(at, 64).to_pylist()
                got = [ngram_presence(t).astype(np.int32).tobytes() for t in texts]
                yield record_batch("doc_id long, lang string, grams binary", [b.column(2).slice(at, 64), b.column(1).slice(at, 64), got])

    rows = sorted(some.mapInArrow(run, "doc_id long, lang string, grams binary").collect(), key=lambda r: (r.doc_id, r.lang, bytes(r.grams)))
    rng = np.random.default_rng(0).permutation(len(rows))
    return fit([np.frombuffer(bytes(rows[i].grams), np.int32) for i in rng], [rows[i].lang for i in rng], landmarks_per_language)


def identify_language(docs: DataFrame, model: KernelModel | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; lang, source and id are no inputs of a prediction.

    Null texts, empty ones and texts without a letter (of any script) give ``und`` and score 0; so does every row when there is
    nothing to learn from.  Very long texts are read whole.  A null id is not held out.  Repeated rows give as many rows, an empty
    table gives none, extra columns are ignored.  score is the softmax share of the winning one-versus-rest value.  Equal values go to
    the first language by name.
    """
    model = model or train_language_model(docs)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.languages, model.buckets, model.weights, model.sharpness))  # BUCKETS x languages floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = KernelModel(*shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                lang, score = own.predict(part.column(0).to_pylist())
                yield record_batch("doc_id long, held_out boolean, lang_pred string, score double", [part.column(1), part.column(2), lang, score])

    inputs = docs.select(text_of().alias("text"), F.col("doc_id").cast("long"), held_out().alias("held_out"))
    return inputs.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def reject_unidentified(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """Documents whose language was recognised: not ``und``, and with at least that share of the softmax (half: more than all other
    languages together).

    Null texts, empty ones and those without a letter go; a very long text is judged whole.  Without anything to learn from no
    document has a language.  A score of exactly ``least_score`` stays; between languages that tie the first by name wins.  Repeated
    rows are judged each, a null id or source doesn't matter, an empty table gives an empty one.  Every column is kept, whatever its name.
    """
    model = train_language_model(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.buckets, model.weights, model.sharpness))
    schema, at_text = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = KernelModel(*shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                lang, score = own.predict([x or "" for x in part.column(at_text).to_pylist()])
                yield part.filter(pa.array([n != "und" and s >= least_score for n, s in zip(lang, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, schema)
