"""Parameters of every operator, in one frozen record."""

from __future__ import annotations

from dataclasses import dataclass, field


def _weights() -> dict[str, float]:
    # Contribution of each signal to the risk score.
    return {
        "zscore": 1.0, "hierarchy": 0.8, "nlp": 0.9, "roundsum": 0.7, "nearthr": 0.9, "smurf": 1.3, "yoyo": 1.2, "loan": 1.1, "freq": 0.9, "recurrent": 0.6,
        "sna_cycle": 1.2, "sna_triangle": 0.7, "quid": 1.4, "reference_reuse": 1.0, "change_point": 1.1, "new_edge": 1.0,
    }


@dataclass(frozen=True)
class Params:
    smurf_days: int = 7
    smurf_thresholds: tuple[float, ...] = (10_000.0, 20_000.0)
    yoyo_hours: int = 8
    yoyo_tolerance: float = 0.02
    loan_days: int = 60
    loan_min_ratio: float = 0.5
    freq_days: int = 30
    freq_count: int = 5
    recurrent_months: int = 3
    burst_hours: int = 2
    burst_min_tx: int = 5
    work_start: int = 8
    work_end: int = 20
    burst_off_ratio: float = 0.6
    near_thresholds: tuple[float, ...] = (17_000.0, 85_000.0, 92_500.0)
    near_delta: float = 10.0
    round_bases: tuple[int, ...] = (10, 50, 100, 500, 1000)
    quid_days: int = 3
    quid_min_score: float = 2.2
    reference_days: int = 30
    reference_min_len: int = 4
    change_amount_ratio: float = 4.0
    change_count_ratio: float = 3.0
    change_gap_months: int = 3
    change_history_months: int = 2
    strict_hierarchy: bool = False
    weights: dict[str, float] = field(default_factory=_weights)


DEFAULTS = Params()
#: name -> days; None: all of the data.
TIMEFRAMES: dict[str, int | None] = {"ultimo_mes": 30, "ultimos_3_meses": 90, "todo_el_tiempo": None}
