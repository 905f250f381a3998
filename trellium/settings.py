"""Knobs, argument ranges and the names that results use."""

from __future__ import annotations

from dataclasses import dataclass

METRICS = ("l2", "cosine", "ip")
SCORINGS = ("ppr", "membership")
REASONS = ("filter_first", "term_cond", "scan_budget", "stream_end_unknown")


def _within(name: str, value: float, low: float, high: float) -> None:
    if value is None or not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}, not {value}")


@dataclass(frozen=True)
class Settings:
    """What holds for all searches of a session."""

    graph_work_budget: int = 65536
    #: Rows that a vector stream may deliver; 0: all.
    vector_scan_budget: int = 0
    graph_scoring: str = "ppr"
    ppr_alpha: float = 0.15
    ppr_rmax: float = 1e-3
    join_order_threshold: float = 0.10
    join_order_cost_ratio: float = 4.0
    join_order_mode: str = "threshold"

    def __post_init__(self):
        _within("graph_work_budget", self.graph_work_budget, 128, 1 << 30)
        _within("vector_scan_budget", self.vector_scan_budget, 0, 1 << 31)
        _within("ppr_alpha", self.ppr_alpha, 1e-4, 0.9999)
        _within("ppr_rmax", self.ppr_rmax, 1e-12, 1)
        _within("join_order_cost_ratio", self.join_order_cost_ratio, 0, 1e9)
        if self.graph_scoring not in SCORINGS:
            raise ValueError(f"graph_scoring must be one of {SCORINGS}")
        if self.join_order_mode not in ("threshold", "cost"):
            raise ValueError("join_order_mode must be threshold or cost")


@dataclass(frozen=True)
class Request:
    """Arguments of one batch of fused searches."""

    k: int
    term_cond: int = 0
    m_seeds: int = 4
    hops: int = 2
    #: None and 0: any type.
    edge_type: int | None = 0
    metric: str = "l2"
    #: A condition in SQL over the entity columns; rows where it is null or false are rejected.
    where: str = ""

    def __post_init__(self):
        _within("k", self.k, 1, 10_000)
        _within("hops", self.hops, 0, 8)
        _within("m_seeds", self.m_seeds, 0, 10_000)
        _within("term_cond", self.term_cond, 0, float("inf"))
        if self.where is None:
            raise ValueError("where must not be null; an empty text accepts every row")
        if self.metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}")

    @property
    def window(self) -> int:
        """Accepted candidates among which seeds are chosen."""
        return max(8 * self.m_seeds, self.m_seeds + 32) if self.m_seeds else 0
