"""Options of the constructions, and logging."""

from __future__ import annotations

import logging
from dataclasses import dataclass, fields

from .errors import InvalidValue

#: Exponent of matrix multiplication used in thresholds; there is no numeric library to detect here.
OMEGA = 2.5

logger = logging.getLogger("hopline")
logger.addHandler(logging.NullHandler())


@dataclass(frozen=True)
class Refinement:
    """Each may be off without harm to results' soundness.

    ``label_compress``, ``hop_bounded_bfs``, ``tight_tc_trigger``, ``skip_condense`` and ``parallel`` are
    accepted and change nothing: labels are always digests, balls are always whole, the tight threshold
    always holds, an acyclic graph condenses to itself and every job is parallel.
    """

    degree_ordered_pivots: bool = True
    enable_tc_pruning: bool = True
    skip_trivial_part: bool = True
    adaptive_sampling: bool = True
    label_compress: bool = True
    hop_bounded_bfs: bool = True
    tight_tc_trigger: bool = True
    skip_condense: bool = True
    parallel: bool = True

    @classmethod
    def from_dict(cls, options: dict[str, bool]) -> Refinement:
        if unknown := set(options) - {f.name for f in fields(cls)}:
            raise InvalidValue(f"unknown options: {sorted(unknown)}")
        return cls(**options)


def configure_logging(level: int = logging.INFO) -> None:
    """A handler for the library's logger; the root logger is left alone."""
    if not any(isinstance(h, logging.StreamHandler) and not isinstance(h, logging.NullHandler) for h in logger.handlers):
        logger.addHandler(logging.StreamHandler())
    logger.setLevel(level)
