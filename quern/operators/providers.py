"""Embedding services behind any client: batches, retries, a request limiter and a token budget.

A client is a function from a list of texts to vectors that raises ``Busy`` when the service asks to slow down and
``Transient`` for failures worth another try. ``Service`` makes an embedder of it, which ``embed.embed`` runs in each
worker; partitions are the parallelism. The clock and sleep are parameters, so tests need no waiting.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from quern.operators.catalog import retry_delay

Client = Callable[[list[str]], list[list[float]]]


class Transient(Exception):
    """A failure that another try may get over."""


class Busy(Transient):
    """Too many requests."""


@dataclass
class Limiter:
    """Requests at a time: halved after ``patience`` refusals in a row, one more after ``streak`` successes in a row."""

    most: int = 4
    patience: int = 3
    streak: int = 10
    allowed: int = 0
    refused: int = 0
    served: int = 0

    def __post_init__(self) -> None:
        self.allowed = self.allowed or self.most

    def success(self) -> None:
        self.refused, self.served = 0, self.served + 1
        if self.served >= self.streak:
            self.allowed, self.served = min(self.most, self.allowed + 1), 0

    def busy(self) -> None:
        self.served, self.refused = 0, self.refused + 1
        if self.refused >= self.patience:
            self.allowed, self.refused = max(1, self.allowed // 2), 0


@dataclass
class Budget:
    """Tokens a minute: ``wait`` says how long until so many may be used, and uses them."""

    per_minute: int
    clock: Callable[[], float] = time.monotonic
    left: float = field(init=False)
    at: float = field(init=False)

    def __post_init__(self) -> None:
        self.left, self.at = float(self.per_minute), self.clock()

    def wait(self, tokens: int) -> float:
        now = self.clock()
        self.left = min(float(self.per_minute), self.left + (now - self.at) * self.per_minute / 60)
        self.at = now
        self.left -= min(tokens, self.per_minute)
        return max(0.0, -self.left * 60 / self.per_minute)


@dataclass
class Service:
    """An embedder over a client; made anew from its parts in each worker."""

    client: Client
    batch: int = 2000
    max_tokens: int = 280_000
    attempts: int = 5
    base: float = 1.0
    most: float = 30.0
    limiter: Limiter = field(default_factory=Limiter)
    budget: Budget | None = None
    sleep: Callable[[float], None] = time.sleep

    def batches(self, texts: list[str]) -> list[list[str]]:
        out: list[list[str]] = []
        used = 0
        for t in texts:
            n = (len(t.encode("utf-8", "surrogatepass")) + 3) // 4
            if not out or len(out[-1]) >= self.batch or used + n > self.max_tokens:
                out.append([])
                used = 0
            out[-1].append(t)
            used += n
        return out

    def _ask(self, texts: list[str]) -> list[list[float]]:
        for attempt in range(1, self.attempts + 1):
            if self.budget is not None:
                self.sleep(self.budget.wait(sum((len(t.encode("utf-8", "surrogatepass")) + 3) // 4 for t in texts)))
            try:
                out = self.client(texts)
            except Transient as e:
                if isinstance(e, Busy):
                    self.limiter.busy()
                if attempt == self.attempts:
                    raise
                self.sleep(self.base * 0.5 + retry_delay(attempt, self.base, self.most, 0.5))
                continue
            if len(out) != len(texts):
                raise ValueError(f"{len(out)} vectors for {len(texts)} texts")
            self.limiter.success()
            return out
        raise ValueError("no attempts")

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Vectors in the order of the texts."""
        rows = [v for part in self.batches(texts) for v in self._ask(part)]
        return np.array(rows, dtype=np.float32)
