"""Time of steps in the log, and the log itself."""

from __future__ import annotations

import logging
import time
from pathlib import Path
from types import TracebackType

log = logging.getLogger("weftwork")


class Timer:
    """Logs ``Time title: wall (processor) unit`` where its block ends; from a minute on in minutes, then hours."""

    def __init__(self, title: str, shown: bool = True):
        self.title, self.shown, self.line = title, shown, ""

    def __enter__(self) -> Timer:
        self.wall, self.processor = time.time(), time.process_time()
        return self

    def __exit__(self, kind: type[BaseException] | None, value: BaseException | None, trace: TracebackType | None) -> None:
        self.line = line(self.title, time.time() - self.wall, time.process_time() - self.processor)
        if self.shown:
            log.info(self.line)


def line(title: str, wall: float, processor: float) -> str:
    unit = "seconds"
    for larger in ("minutes", "hours"):
        if wall >= 60:
            wall, processor, unit = wall / 60, processor / 60, larger
    return f"Time {title}: {wall:.1f} ({processor:.1f}) {unit}"


def start_log(path: str | None = None, form: str = "%(asctime)s %(levelname)s: %(message)s", verbose: bool = False) -> None:
    """Logs to the console, warnings only unless ``verbose``, and all to a file where one is given."""
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    handlers[0].setLevel(logging.INFO if verbose else logging.WARNING)
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        handlers.append(logging.FileHandler(path, encoding="utf-8"))
    for old in log.handlers[:]:
        log.removeHandler(old)
    for handler in handlers:
        handler.setFormatter(logging.Formatter(form))
        log.addHandler(handler)
    log.setLevel(logging.INFO)
