"""Sequence embeddings by a model that the caller brings: loaded once a worker, fed with batches of even length, pooled by mask."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandforge.operators.rules import dealt

#: Sequences to (states, mask): states by sequence, position and component, and which positions are residues.
Model = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]
#: The models that this Python worker has loaded, by name; they last as long as the worker, not a task.
_LOADED: dict[str, Model] = {}


def loaded(name: str, load: Callable[[], Model]) -> Model:
    """The worker's model of that name, loaded on first use."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def pooled(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of each sequence's states over its residues; marks of begin, end and padding don't count, and the divisor is at least 1."""
    kept = mask.astype(bool)
    total = np.where(kept[..., None], states, 0).sum(axis=1, dtype=float)
    return total / np.maximum(kept.sum(axis=1), 1)[:, None]


def batches_of(lengths: list[int], most_residues: int, most_rows: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive sequences whose padded size stays within ``most_residues``; a longer sequence is a batch of its own."""
    at = 0
    while at < len(lengths):
        end, widest = at, 0
        while end < len(lengths) and end - at < most_rows and (end == at or max(widest, lengths[end]) * (end - at + 1) <= most_residues):
            widest = max(widest, lengths[end])
            end += 1
        yield at, end
        at = end


def embed(sequences: DataFrame, load: Callable[[], Model], name: str, column: str = "protein", most_residues: int = 16_384, most_rows: int = 256) -> DataFrame:
    """(``column``, embedding) of the distinct sequences; null and empty ones have none.

    ``load`` gives the model and runs once in each Python worker under ``name``.  Within a task sequences come by length, so a batch
    has little padding and memory follows ``most_residues``, not the longest sequence of some random batch.
    """
    own = dealt(sequences.select(column).filter(F.length(column) > 0).distinct()).withColumn("_n", F.length(column)).sortWithinPartitions("_n", column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(name, load)
        for b in batches:
            texts = b.column(0).to_pylist()
            for at, end in batches_of(b.column(1).to_pylist(), most_residues, most_rows):
                vectors = pooled(*model(texts[at:end]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), pa.array(list(vectors), pa.list_(pa.float64()))], names=[column, "embedding"])

    return own.mapInArrow(run, f"{column} string, embedding array<double>")
