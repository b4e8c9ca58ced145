"""Time, memory of the driver, and progress, for logs. What executors use is in Spark's own metrics."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

log = logging.getLogger("rowlens")


@dataclass
class Timing:
    name: str
    seconds: float = 0.0


@contextmanager
def timer(name: str) -> Iterator[Timing]:
    """Measures a block; the seconds are there, and logged, after it, also if it fails."""
    out, began = Timing(name), time.perf_counter()
    try:
        yield out
    finally:
        out.seconds = time.perf_counter() - began
        log.info("%s took %.3f s", name, out.seconds)


def driver_memory_mb() -> float:
    """Resident memory of this process."""
    with open("/proc/self/status", encoding="ascii") as f:
        return next(int(line.split()[1]) / 1024 for line in f if line.startswith("VmRSS"))


@dataclass
class MemoryUse:
    before_mb: float
    after_mb: float = 0.0

    @property
    def added_mb(self) -> float:
        return self.after_mb - self.before_mb


@contextmanager
def memory_use(warn_mb: float | None = None) -> Iterator[MemoryUse]:
    """What a block adds to the driver's memory; a log warning above ``warn_mb``."""
    out = MemoryUse(driver_memory_mb())
    try:
        yield out
    finally:
        out.after_mb = driver_memory_mb()
        if warn_mb is not None and out.added_mb > warn_mb:
            log.warning("the driver's memory grew by %.0f MB", out.added_mb)


def progress(items: Iterable, total: int | None = None, every: int = 1000, name: str = "items") -> Iterator:
    """Passes items through and logs count, share and rate after each ``every`` of them."""
    began = time.perf_counter()
    for n, item in enumerate(items, 1):
        yield item
        if n % every == 0 or n == total:
            share = f" ({100 * n / total:.0f} %)" if total else ""
            log.info("%d %s%s, %.0f a second", n, name, share, n / max(time.perf_counter() - began, 1e-9))
