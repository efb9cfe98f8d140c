"""Wall-clock time of driver-side calls, such as those of functions that run a Spark action."""

from __future__ import annotations

import functools
import inspect
import logging
import time
from collections.abc import Callable
from contextlib import contextmanager

log = logging.getLogger(__name__)


@contextmanager
def clock(name: str, report: Callable[[str, float], None] | None = None):
    """Report a block's seconds, also where it raises."""
    start = time.perf_counter()
    try:
        yield
    finally:
        seconds = time.perf_counter() - start
        report(name, seconds) if report else log.info("%s took %.4f seconds", name, seconds)


def timed(function: Callable, report: Callable[[str, float], None] | None = None) -> Callable:
    """`function`, or coroutine function, with each of its calls under clock()."""
    if inspect.iscoroutinefunction(function):

        async def call(*args, **kwargs):
            with clock(function.__name__, report):
                return await function(*args, **kwargs)

    else:

        def call(*args, **kwargs):
            with clock(function.__name__, report):
                return function(*args, **kwargs)

    return functools.wraps(function)(call)
