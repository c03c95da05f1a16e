"""Live progress: a line for each batch of a stream, and a monitor that prints a state at intervals."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


def line(done: int, total: int, elapsed: float, active: int = 0, failed: int = 0, width: int = 20) -> str:
    """One line of progress, as functions.monitor.format_progress gives it for columns."""
    part = min(1.0, max(0.0, done / total)) if total > 0 else 0.0
    filled = round(part * width)
    speed = done / elapsed if elapsed > 0 else 0.0
    left = 0.0 if total and done >= total else (total - done) / speed if done > 0 and elapsed > 0 else None
    return f"[{'#' * filled}{'-' * (width - filled)}] {part * 100:3.0f}% {done}/{total} | {speed:.1f}/s | left {'-' if left is None else f'{left:.0f} s'} | active {active} | failed {failed}"


class BatchProgress(StreamingQueryListener):
    """Hands a line with the rows so far and the rate to `printer` after each batch."""

    def __init__(self, total: int = 0, printer: Callable[[str], None] = print):
        self.total, self.printer, self.done, self.began = total, printer, 0, time.monotonic()

    def onQueryStarted(self, event) -> None:
        self.began = time.monotonic()

    def onQueryProgress(self, event) -> None:
        self.done += event.progress.numInputRows
        self.printer(line(self.done, self.total or self.done, time.monotonic() - self.began))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class Monitor:
    """Prints get_state() every interval seconds until it is left; state: done, total, elapsed[, active, failed]."""

    def __init__(self, get_state: Callable[[], dict], interval: float = 1.0, printer: Callable[[str], None] = print):
        self.get_state, self.interval, self.printer = get_state, interval, printer
        self._end = threading.Event()

    def _run(self) -> None:
        while not self._end.wait(self.interval):
            self.printer(line(**self.get_state()))

    def __enter__(self) -> Monitor:
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *exc) -> None:
        self._end.set()
        self._thread.join()
        self.printer(line(**self.get_state()))
