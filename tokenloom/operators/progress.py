"""Progress of long jobs, as lines of a log on the driver."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

log = logging.getLogger("tokenloom")
MIB = 1 << 20


class Progress:
    """Logs how far a job is, how fast it goes and how long the rest takes: after every
    ``every`` steps, and else when ``seconds`` have gone by. ``clock`` gives the time."""

    def __init__(
        self,
        what: str,
        total: float,
        unit: str = "",
        every: int = 100,
        seconds: float = 2.0,
        clock: Callable[[], float] = time.monotonic,
    ) -> None:
        self.what, self.total, self.unit, self.every, self.seconds, self.clock = what, total, unit, every, seconds, clock
        self.done, self.steps = 0.0, 0
        self.began = self.said = clock()

    def step(self, amount: float = 1) -> None:
        self.done += amount
        self.steps += 1
        now = self.clock()
        if self.steps % self.every == 0 or now - self.said >= self.seconds or self.done >= self.total:
            self.said = now
            log.info("%s", self.line(now))

    def line(self, now: float) -> str:
        """``merges: 50 of 200, 25 %, 10.0/s, 15 s left``."""
        took = max(now - self.began, 1e-9)
        rate = self.done / took
        left = (self.total - self.done) / rate if rate > 0 else float("inf")
        share = 100 * self.done / self.total if self.total else 100.0
        unit = f" {self.unit}" if self.unit else ""
        shown = f"{self.done:g} of {self.total:g}{unit}"
        ahead = f"{left:.0f} s left" if left != float("inf") else "no end in sight"
        return f"{self.what}: {shown}, {share:.0f} %, {rate:.1f}{unit}/s, {ahead}"

    def on_merge(self, merge: dict) -> None:
        """For ``on_merge`` of training."""
        self.step()


def mib(size: int) -> float:
    return round(size / MIB, 3)
