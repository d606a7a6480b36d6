"""Driver-side arithmetic: parameters, thresholds and bounds as functions of sizes."""

from __future__ import annotations

import math
from dataclasses import dataclass

from ..errors import InvalidValue


@dataclass(frozen=True)
class ShortcutParameters:
    k: float
    rho: float
    max_level: int
    beta: float
    realised_hops: float


def shortcut_parameters(n: int, m: int, omega: float = 3.0) -> ShortcutParameters:
    """Parameters of the shortcut construction for n vertices and m edges.

    ``beta`` is the asymptotic hop target, ``realised_hops`` what the levels taken together keep to.
    """
    if n < 1:
        raise InvalidValue("a graph without vertices has no parameters")
    k = max(2.0, math.log2(n))
    beta = paper_beta(n, m, omega)
    rho = min(math.sqrt(n), max(1.0, math.sqrt(n) / beta))
    levels = max(1, math.floor(math.log(n) / math.log(k)) + 1)
    return ShortcutParameters(k, rho, levels, beta, levels * max(2.0, math.ceil(rho)) + 1)


def paper_beta(n: int, m: int, omega: float = 3.0) -> float:
    return (n**omega / m) ** (1 / (2 * omega - 2)) if m else math.inf


def hopset_parameters(n: int, m: int) -> ShortcutParameters:
    beta = (n**3 / m) ** 0.25 if m else math.inf
    k = max(2.0, math.log2(n))
    levels = max(1, math.floor(math.log(n) / math.log(k)) + 1)
    return ShortcutParameters(k, min(math.sqrt(n), max(1.0, math.sqrt(n) / beta)), levels, beta, math.inf)


def clamp(x: float, low: float, high: float) -> float:
    return min(high, max(low, x))


def density_aware_constant(rho: float, k: float) -> float:
    """10 on dense graphs, down to 1 where rho is small against k."""
    return 10.0 * clamp(rho / max(1.0, k), 0.1, 1.0) if rho > 0 and k > 1 else 10.0


def target_part_size(n: int, level: int, k: float) -> int:
    return max(1, int(n / k ** (level + 2)))


def adaptive_scale(largest_part: int, n: int, level: int, k: float) -> float:
    """By how much the next level samples more (small parts) or less (large ones)."""
    return clamp(target_part_size(n, level, k) / largest_part, 0.1, 10.0) if largest_part > 0 and n > 1 and k > 1 else 1.0


def pivot_probability(k: float, level: int, n: int, constant: float) -> float:
    return min(1.0, constant * k ** (level + 1) * math.log2(n) / n) if n > 1 else 0.0


def closure_threshold(k: float, n: int, rho: float, omega: float = 2.5) -> float:
    """Ball size up to which its closure is cheaper than sampling."""
    log_n = math.log2(n) if n > 1 else 0.0
    wide = k**2 * log_n**2 * rho**2
    return min(wide, (rho * n * k * log_n) ** (1 / omega)) if rho > 0 and log_n > 0 else wide


def ball_threshold(k: float, n: int, rho: float) -> float:
    return k**2 * (math.log2(n) if n > 1 else 0.0) ** 2 * rho**2


def _log(n: int) -> float:
    return max(1.0, math.log2(n + 2))


def shortcut_work(n: int, m: int, rho: float, omega: float = 3.0) -> float:
    return _log(n) * (m + n * rho ** (2 * omega - 2))


def shortcut_depth(n: int, rho: float) -> float:
    return _log(n) * math.sqrt(n) / rho


def hopset_work(n: int, m: int, rho: float, epsilon: float) -> float:
    return _log(n) * (m / epsilon**2 + n * rho**4)


def hopset_depth(n: int, m: int, rho: float) -> float:
    return _log(n) * (n**3 / max(1, m)) ** 0.25 / rho


def shortcut_size_bound(n: int, rho: float) -> float:
    return _log(n) * n * rho**2


def hopset_size_bound(n: int, epsilon: float, rho: float) -> float:
    return _log(n) * (n / epsilon**2 + n * rho**2)


def closed_form_upper_bound(n: int, m: int) -> float:
    return n**2 + m * math.sqrt(n)


def closed_form_lower_bound_path(n: int) -> int:
    """A path of any length needs no shortcut to keep reachability."""
    return 0
