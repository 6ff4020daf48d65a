"""Settings of search, chunking and the property graph."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Default path boosts, pattern and factor; penalties then bonuses.
PENALTIES = [
    ("/tests/", 0.5), ("/test/", 0.5), ("__tests__", 0.5), ("_test.", 0.5), (".test.", 0.5), (".spec.", 0.5), ("test_", 0.5),
    ("/mocks/", 0.4), ("/mock/", 0.4), (".mock.", 0.4), ("/fixtures/", 0.4), ("/testdata/", 0.4),
    ("/generated/", 0.4), (".generated.", 0.4), (".gen.", 0.4), (".md", 0.6), ("/docs/", 0.6),
]
BONUSES = [("/src/", 1.1), ("/lib/", 1.1), ("/app/", 1.1)]


@dataclass(frozen=True)
class Chunking:
    """Sizes in tokens of four bytes; out-of-range values fall back to the defaults."""

    size: int = 512
    overlap: int = 50

    def resolved(self) -> tuple[int, int]:
        size = self.size if self.size > 0 else 512
        overlap = self.overlap if self.overlap >= 0 else 50
        return size, size // 10 if overlap >= size else overlap


@dataclass(frozen=True)
class Search:
    hybrid: bool = False
    rrf_k: int = 60
    boost: bool = True
    dedup: bool = True
    penalties: list[tuple[str, float]] = field(default_factory=lambda: list(PENALTIES))
    bonuses: list[tuple[str, float]] = field(default_factory=lambda: list(BONUSES))

    @property
    def k(self) -> int:
        return self.rrf_k if self.rrf_k > 0 else 60


@dataclass(frozen=True)
class Graph:
    similarity: float = 0.5
    drift: float = 0.35
    group_cap: int = 100
    hub_callees: int = 50
    min_co_calls: int = 2
    co_call_norm: float = 5.0
    max_symbols: int = 500
    max_edges: int = 2000
