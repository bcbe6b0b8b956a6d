"""Version times: pluggable clocks, and stamping of whole batches."""

from __future__ import annotations

import threading
import time
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.numbering import with_position


class Clock(Protocol):
    """A source of version times in nanoseconds; a later call must not give a smaller time."""

    def time(self) -> int: ...


class HybridClock:
    """Wall-clock nanoseconds that never repeat or go back, whatever the wall clock does.

    ``high_water`` is the largest time given out before, as a store's manifest keeps it.
    """

    def __init__(self, high_water: int = 0, wall=time.time_ns):
        self._last, self._wall, self._lock = high_water, wall, threading.Lock()

    def time(self) -> int:
        return self.reserve(1)

    def reserve(self, n: int) -> int:
        """The first of ``n`` consecutive times that are this caller's alone."""
        with self._lock:
            first = max(self._wall(), self._last + 1)
            self._last = first + max(n, 1) - 1
            return first

    @property
    def high_water(self) -> int:
        return self._last


def stamp(rows: DataFrame, base: int, order: list[str]) -> DataFrame:
    """``rows`` with ``ts`` = ``base`` + place in ``order``, from 0; no two rows share a time."""
    return with_position(rows, [F.col(c) for c in order], "ts", first=base)
