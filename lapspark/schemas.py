"""Table schemas and the column checks applied on ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "array<double>": T.ArrayType(T.DoubleType()),
}


def _schema(text: str) -> T.StructType:
    """A struct from "name type, name type"; needs no running session, unlike a DDL string."""
    fields = [part.split() for part in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


LAPS = _schema(
    "session_key int, driver_number int, lap_number int, lap_duration double, "
    "is_pit_out_lap boolean, st_speed int, date_start timestamp"
)
STINTS = _schema(
    "session_key int, driver_number int, stint_number int, compound string, "
    "tyre_age_at_start int, lap_start int, lap_end int"
)
POSITION = _schema("session_key int, driver_number int, position int, date timestamp")
CAR_DATA = _schema(
    "session_key int, driver_number int, date timestamp, speed double, throttle double, "
    "brake double, n_gear int, rpm int"
)
DRIVERS = _schema(
    "session_key int, driver_number int, name_acronym string, full_name string, "
    "team_name string, team_colour string"
)
MEETINGS = _schema("meeting_key int, meeting_name string, year int")
SESSIONS = _schema(
    "session_key int, meeting_key int, session_name string, session_type string, "
    "date_start timestamp, date_end timestamp"
)
AUDIT_LOG = _schema(
    "ts string, feature string, model string, latency_ms double, prompt_tokens long, "
    "completion_tokens long, total_tokens long, success boolean, error_type string"
)
OUTLINES = _schema("gp_name string, x array<double>, y array<double>")

# --- fixed values: feature lists, bounds, session labels, grid sizes, race constants, prices ---
TRACE_POINTS = 200
OUTLINE_POINTS = 500
DISPLAY_POINTS = 1000
MIN_SAMPLES_PER_LAP = 10
SAFETY_CAR_RATIO = 1.10
DEGRADATION_PER_LAP = 0.07
DEGRADATION_FREE_LAPS = 20
PROMPT_PRICE_PER_MILLION = 0.15
COMPLETION_PRICE_PER_MILLION = 0.60

BASE_FEATURES = [
    "mean_speed", "throttle_mean", "throttle_std", "brake_events", "steer_std", "gear_changes",
]
STYLE_FEATURES = [
    "mean_speed", "max_speed", "min_speed",
    "throttle_mean", "throttle_std", "throttle_pickup_pct",
    "brake_mean", "brake_events", "trail_brake_score",
    "steer_std", "gear_changes", "coasting_pct",
]
MODEL_FEATURES = [
    "lap_time_seconds", "mean_speed", "max_speed", "min_speed", "throttle_mean",
    "throttle_std", "brake_mean", "brake_events", "gear_changes", "steer_std",
]
FEATURE_BOUNDS = {
    "lap_time_seconds": (60.0, 200.0),
    "mean_speed": (50.0, 380.0),
    "max_speed": (80.0, 420.0),
    "min_speed": (0.0, 250.0),
    "throttle_mean": (0.0, 100.0),
    "throttle_std": (0.0, 60.0),
    "brake_mean": (0.0, 100.0),
    "brake_events": (0.0, 200.0),
    "gear_changes": (0.0, 1500.0),
    "steer_std": (0.0, 100.0),
}
OTHER_BOUNDS = (-1e9, 1e9)
SESSION_LABELS = {
    "R": "Race",
    "Q": "Qualifying",
    "S": "Sprint",
    "SS": "Sprint Shootout",
    "FP1": "Practice 1",
    "FP2": "Practice 2",
    "FP3": "Practice 3",
}
# Request limits: lowest and highest value.
ARGUMENT_LIMITS = {"window": (2, 15), "top_n": (1, 20), "lookahead": (1, 10), "laps_remaining": (1, 80)}
# Twelve-dimensional driving-style profiles in STYLE_FEATURES order: name, era, vector.
STYLE_PROFILES = [
    ("Michael Schumacher", "1991–2012", [0.85, 0.80, 0.55, 0.80, 0.35, 0.78, 0.90, 0.88, 0.85, 0.0, 0.78, 0.05]),
    ("Ayrton Senna", "1984–1994", [0.80, 0.75, 0.90, 0.75, 0.65, 0.70, 0.85, 0.80, 0.80, 0.0, 0.75, 0.04]),
    ("Alain Prost", "1980–1993", [0.75, 0.70, 0.65, 0.85, 0.25, 0.88, 0.40, 0.45, 0.20, 0.0, 0.60, 0.08]),
    ("Fernando Alonso", "2001–present", [0.70, 0.65, 0.72, 0.72, 0.28, 0.68, 0.38, 0.42, 0.18, 0.0, 0.72, 0.55]),
    ("Sebastian Vettel", "2007–2022", [0.82, 0.78, 0.68, 0.76, 0.40, 0.74, 0.60, 0.85, 0.55, 0.0, 0.76, 0.07]),
    ("Lewis Hamilton", "2007–present", [0.85, 0.80, 0.74, 0.75, 0.30, 0.72, 0.25, 0.38, 0.28, 0.0, 0.68, 0.06]),
    ("Max Verstappen", "2015–present", [0.88, 0.85, 0.72, 0.72, 0.78, 0.68, 0.45, 0.60, 0.55, 0.0, 0.70, 0.12]),
    ("Kimi Räikkönen", "2001–2021", [0.78, 0.72, 0.70, 0.80, 0.22, 0.85, 0.35, 0.40, 0.15, 0.0, 0.65, 0.04]),
    ("Carlos Sainz", "2015–present", [0.76, 0.70, 0.75, 0.74, 0.55, 0.72, 0.65, 0.68, 0.62, 0.0, 0.72, 0.10]),
    ("Nico Rosberg", "2006–2016", [0.80, 0.75, 0.68, 0.82, 0.30, 0.82, 0.30, 0.42, 0.22, 0.0, 0.66, 0.14]),
]
# --- end of fixed values ---


def ensure_columns(df: DataFrame, schema: T.StructType) -> tuple[DataFrame, list[str]]:
    """Add absent required columns as typed nulls; extra columns stay. Returns what was missing."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    types = {f.name: f.dataType for f in schema.fields}
    return df.withColumns({c: F.lit(None).cast(types[c]) for c in missing}), missing
