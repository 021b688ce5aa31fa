"""A run: one timestamp, the DataFrames it caches and what is closed with it."""

from __future__ import annotations

import atexit
import secrets
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

_lock = threading.Lock()
_current: Run | None = None


class Run:
    """Context of a run; closing it releases its cached DataFrames and calls its callbacks once."""

    def __init__(self, task: str, seed: int | None = None) -> None:
        self.task = task
        self.seed = seed if seed is not None else secrets.randbits(31)
        self.started = time.strftime("%Y-%m-%dT%H:%M:%S")
        self.closed = False
        self._cached: dict[str, DataFrame] = {}
        self._callbacks: list[Callable[[Run], None]] = []

    def cached(self, key: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The DataFrame of ``key``, built and persisted at its first use in this run."""
        if key not in self._cached:
            self._cached[key] = build().persist()
        return self._cached[key]

    def on_close(self, callback: Callable[[Run], None]) -> None:
        self._callbacks.append(callback)

    def close(self) -> None:
        if self.closed:
            return
        self.closed = True
        for df in self._cached.values():
            df.unpersist()
        for callback in self._callbacks:
            callback(self)

    def __enter__(self) -> Run:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def begin_or_attach(task: str, seed: int | None = None) -> Run:
    """The open run of the same task, else a new one; an open run of another task is closed first."""
    global _current
    with _lock:
        if _current is not None and not _current.closed:
            if _current.task == task:
                return _current
            _current.close()
        _current = Run(task, seed)
        return _current


def _close_open() -> None:
    if _current is not None:
        try:
            _current.close()
        except Exception:  # noqa: BLE001 - the session may be gone
            pass


atexit.register(_close_open)
