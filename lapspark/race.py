"""One entry point over the laps, stints and positions of any number of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lapspark.operators import laps as L
from lapspark.operators import positions as P
from lapspark.operators import stints as S
from lapspark.operators import strategy as X


class RaceAnalysis:
    """The race questions as methods; every answer is a DataFrame keyed by ``session_key``."""

    def __init__(self, laps: DataFrame, stints: DataFrame, position: DataFrame) -> None:
        self.laps = L.normalise_laps(laps)
        self.stints = stints
        self.position = position

    def clean_laps(self) -> DataFrame:
        return L.clean_laps(self.laps)

    def lap_positions(self) -> DataFrame:
        return P.lap_positions(self.position, self.laps)

    def rolling_pace(self, window: int = 5) -> DataFrame:
        return L.rolling_pace(self.laps, window)

    def gap_to_leader(self) -> DataFrame:
        return L.gap_to_leader(self.laps)

    def detect_undercuts(self, lookahead: int = 3) -> DataFrame:
        return X.detect_undercuts(self.laps, self.stints, self.position, lookahead)

    def project_finishing_order(self, laps_remaining: int, window: int = 5) -> DataFrame:
        return X.project_finish(self.laps, self.stints, self.position, laps_remaining, window)

    def tyre_degradation(self) -> DataFrame:
        return S.stint_degradation(self.laps, self.stints)

    def pace_summary(self) -> DataFrame:
        return L.pace_summary(L.clean_laps(self.laps))

    def undercut_windows(self, threshold_seconds: float = 1.5) -> DataFrame:
        return X.undercut_windows(self.laps, self.stints, threshold_seconds)

    def latest_pace(self, window: int = 5, top_n: int = 5, drivers: DataFrame | None = None) -> DataFrame:
        return L.latest_pace(self.laps, window, top_n, drivers)

    def latest_gaps(self, drivers: DataFrame | None = None) -> DataFrame:
        return L.latest_gaps(self.laps, drivers)
