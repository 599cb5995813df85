"""Several jobs of one driver side by side."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

T = TypeVar("T")
THREADS = 8
POOL = "spark.scheduler.pool"


def in_parallel(spark: SparkSession, jobs: Sequence[Callable[[], T]], threads: int = THREADS) -> list[T]:
    """Results of ``jobs`` in their order; at most ``threads`` run at once.

    Each thread submits to a scheduler pool of its own: in fair mode (``spark.scheduler.mode``) they share the cluster
    evenly, else tasks of a later job fill what an earlier one leaves idle. The first error ends the whole.
    """
    def run(numbered: tuple[int, Callable[[], T]]) -> T:
        at, job = numbered
        spark.sparkContext.setLocalProperty(POOL, f"parallel-{at % threads}")
        try:
            return job()
        finally:
            spark.sparkContext.setLocalProperty(POOL, None)

    if threads <= 1 or len(jobs) <= 1:
        return [job() for job in jobs]
    with ThreadPool(min(threads, len(jobs))) as pool:
        return pool.map(inheritable_thread_target(spark)(run), list(enumerate(jobs)), chunksize=1)
