"""Row counts of a plan's stages, observed while the plan runs."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def observed(seen: Observation, name: str) -> int:
    """A counter's value after the action; 0 where the optimiser knew the rows to be none and left the counter out."""
    try:
        return seen.get[name]
    except Py4JJavaError:
        return 0


class Progress:
    """Stages of a lazy plan and what is told of them.

    ``stage`` puts a counter into the plan; no job is run for it.  ``tell_all``, after the action that ran the plan, tells each
    stage's message in order; it waits for counters that have not run yet.
    """

    def __init__(self, tell: Callable[[str], None], stages: int = 6) -> None:
        self.tell, self.stages = tell, stages
        self._open: list[tuple[int, str, Observation]] = []

    def stage(self, df: DataFrame, number: int, message: str) -> DataFrame:
        """``df`` with a counter; ``message`` has {rows} for its rows."""
        seen = Observation()
        self._open.append((number, message, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"))

    def tell_all(self) -> None:
        for number, message, seen in sorted(self._open, key=lambda x: x[0]):
            self.tell(f"[{number}/{self.stages}] {message.format(rows=observed(seen, 'rows'))}")
        self._open = []
