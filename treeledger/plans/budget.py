"""A time limit and a way to cancel that reach into running jobs."""

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Event, Thread

from pyspark.sql import SparkSession

LOOK_SECONDS = 0.1


class TimedOut(TimeoutError):
    """The budget ran out before publication; nothing was published."""


class Cancelled(RuntimeError):
    """Someone cancelled the work before publication; nothing was published."""


class Budget:
    """What is left of a time limit. Whichever of cancelling and running out comes first is kept as the reason."""

    def __init__(self, seconds: float | None, cancel: Event | None):
        self.started, self.seconds, self.cancel = time.monotonic(), seconds, cancel
        self.reason: Exception | None = None

    @property
    def elapsed(self) -> float:
        return round(time.monotonic() - self.started, 3)

    def look(self) -> Exception | None:
        if self.reason is None:
            if self.cancel is not None and self.cancel.is_set():
                self.reason = Cancelled("cancelled; nothing is published")
            elif self.seconds is not None and self.elapsed > self.seconds:
                self.reason = TimedOut(f"not finished within {self.seconds} seconds; nothing is published")
        return self.reason

    def check(self) -> float:
        """Seconds spent so far, or the reason to stop."""
        if self.look() is not None:
            raise self.reason
        return self.elapsed


@contextmanager
def time_budget(spark: SparkSession, seconds: float | None = None, cancel: Event | None = None) -> Iterator[Budget]:
    """Work within a budget. Jobs started inside carry a tag, and a watchdog cancels them when the budget ends.

    The tag goes along to threads that inherit this one's properties. Jobs of others are not
    touched. A failure after the end of the budget is reported as that end.
    """
    budget = Budget(seconds, cancel)
    if seconds is None and cancel is None:
        yield budget
        return
    tag, done = f"budget-{uuid.uuid4().hex}", Event()

    def watch() -> None:
        while not done.wait(LOOK_SECONDS):
            if budget.look() is not None:  # again and again: a stage in between may start another job
                spark.sparkContext.cancelJobsWithTag(tag)

    spark.sparkContext.addJobTag(tag)
    watchdog = Thread(target=watch, daemon=True)
    watchdog.start()
    try:
        yield budget
    except Exception as error:
        if budget.reason is not None and error is not budget.reason:
            raise budget.reason from error
        raise
    finally:
        done.set()
        watchdog.join()
        spark.sparkContext.removeJobTag(tag)
