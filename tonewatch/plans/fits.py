"""Jobs run side by side, a bounded number at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

POOL = "spark.scheduler.pool"


def side_by_side(spark: SparkSession, jobs: Iterable[Callable], most: int) -> list:
    """Results of the jobs in their order, run at most ``most`` at a time.

    Each thread has a scheduler pool of its own, so that under fair scheduling a
    short job does not wait for a long one; the first failure is raised.
    """
    context = spark.sparkContext

    def run(number: int, job: Callable):
        context.setLocalProperty(POOL, f"fits-{number % most}")
        try:
            return job()
        finally:
            context.setLocalProperty(POOL, None)

    with ThreadPoolExecutor(most) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(run), i, job) for i, job in enumerate(jobs)]
        return [x.result() for x in started]
