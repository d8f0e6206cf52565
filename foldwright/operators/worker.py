"""Service loops: a step again and again, idle waits, retries for ever, a graceful stop."""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence

from foldwright.functions.backoff import IDLE, RETRY, Backoff

#: What happened, and the number of items or the error.
Listener = Callable[[str, object], None]


class Worker:
    """Calls ``step``, which handles a batch and returns the number of its items, until it is told to stop.

    After a batch with items the next follows at once; empty ones wait longer and longer; a step that raises is tried again
    after a backoff of its own, for ever. A stop is seen between steps and ends any wait.
    """

    def __init__(self, name: str, step: Callable[[], int], *, idle: Backoff = IDLE, retry: Backoff = RETRY, listeners: Sequence[Listener] = (), wait: Callable[[threading.Event, int], object] | None = None) -> None:
        self.name, self.step, self.idle, self.retry, self.listeners = name, step, idle, retry, listeners
        self.wait = wait or (lambda stop, ms: stop.wait(ms / 1000))
        self.done = self.errors = 0

    def _tell(self, what: str, value: object) -> None:
        for listener in self.listeners:
            listener(what, value)

    def run(self, stop: threading.Event) -> None:
        empty = failed = 0
        self._tell("started", self.name)
        while not stop.is_set():
            try:
                n = self.step()
            except Exception as problem:
                failed += 1
                self.errors += 1
                self._tell("failed", problem)
                self.wait(stop, self.retry.delay(failed))
                continue
            failed, empty = 0, 0 if n else empty + 1
            self.done += n
            self._tell("batch", n)
            if empty:
                self.wait(stop, self.idle.delay(empty))
        self._tell("stopped", self.name)

    def start(self, stop: threading.Event) -> threading.Thread:
        thread = threading.Thread(target=self.run, args=(stop,), name=self.name, daemon=True)
        thread.start()
        return thread
