"""Schemas, label dimension and parameter tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: The label set, in order of id.
CLASSES = [
    "normal",
    "traffic_accident",
    "traffic_congestion",
    "stalled_or_broken_down_vehicle",
    "vehicle_blocking_traffic",
    "wrong_way_driving",
    "road_spill_or_debris",
    "waterlogging_or_flood",
    "fire",
    "smoke",
    "fighting_or_violence",
    "loitering_or_suspicious_presence",
]
NORMAL = "normal"
#: Classes that need the long scale.
DWELL = [
    "loitering_or_suspicious_presence",
    "stalled_or_broken_down_vehicle",
    "fighting_or_violence",
    "wrong_way_driving",
]
#: Fixed values: (window, stride) in seconds by scale.
SCALES = {"short": (4.0, 2.0), "long": (32.0, 8.0)}
#: Component weights by level (alert, match, timing).
LEVEL_WEIGHTS = [(2, 0.2, 0.5, 0.3), (3, 0.2, 0.4, 0.4)]
#: Overlap thresholds of the general evaluation and of the official score.
GENERAL_TAUS, OFFICIAL_TAU = [0.1, 0.3, 0.5], 0.5

_S, _D, _I, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


GROUND_TRUTH = _struct(("video_id", _S), ("is_anomaly", _B), ("class_name", _S), ("start_time_sec", _D), ("end_time_sec", _D), ("description_summary", _S))
VIDEOS = _struct(("video_id", _S), ("filename", _S))
PREDICTION = _struct(("video_id", _S), ("class_name", _S), ("start_time_sec", _D), ("end_time_sec", _D), ("score", _D), ("is_anomaly", _B))
VERDICT = _struct(("video_id", _S), ("start_time_sec", _D), ("end_time_sec", _D), ("class_name", _S), ("score", _D), ("window_ms", _D), ("n_frames", _I), ("raw", _S))
EXPORT_INDEX = _struct(("id", _S), ("class_name", _S), ("video_id", _S), ("start", _D), ("end", _D), ("n_frames", _I))
SEGMENT = _struct(("start_sec", _D), ("end_sec", _D), ("source_path", _S), ("source_start_sec", _D), ("class_name", _S))
TIMELINE_EVENT = _struct(("class_name", _S), ("start_time_sec", _D), ("end_time_sec", _D))
TIMELINE = _struct(("video_id", _S), ("duration_sec", _D), ("segments", T.ArrayType(SEGMENT)), ("events", T.ArrayType(TIMELINE_EVENT)))
POLICY = _struct(("policy_id", _I), ("theta_high", _D), ("theta_low", _D), ("merge_gap_sec", _D), ("min_duration_sec", _D), ("max_window_gap_sec", _D))
RUNTIME = _struct(
    ("model_name", _S), ("call_count", _I), ("total_time_ms", _D), ("average_time_ms", _D), ("p50_time_ms", _D), ("p95_time_ms", _D), ("max_time_ms", _D),
    ("call_times_ms", T.ArrayType(_D)),
)
RUNTIME_METADATA = _struct(("frames_processed", _I), ("chunks_processed", _I), ("end_to_end_internal_time_ms", _D), ("model_runtimes", T.ArrayType(RUNTIME)))
ENTRY_EVENT = _struct(("class_name", _S), ("start_time_sec", _D), ("end_time_sec", _D), ("explanation", _S))
ENTRY = _struct(("video_id", _S), ("events", T.ArrayType(ENTRY_EVENT)), ("runtime_metadata", RUNTIME_METADATA))
SUBMISSION = _struct(
    ("schema_version", _S), ("submission_id", _S), ("model_name", _S),
    ("run_metadata", _struct(("total_wall_time_ms", _D), ("hardware", _S))), ("predictions", T.ArrayType(ENTRY)),
)

#: The default aggregation policy.
DEFAULT_POLICY = {"theta_high": 0.5, "theta_low": 0.35, "merge_gap_sec": 5.0, "min_duration_sec": 0.0, "max_window_gap_sec": 8.0}


def class_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(CLASSES)), "class_id int, class_name string")


def policies(spark: SparkSession, *rows: dict) -> DataFrame:
    """One policy a row; what a row leaves out is the default. Numbered from 0."""
    full = [DEFAULT_POLICY | r for r in rows or ({},)]
    for r in full:
        if r["theta_low"] > r["theta_high"]:
            raise ValueError(f"theta_low {r['theta_low']} is above theta_high {r['theta_high']}")
    names = POLICY.fieldNames()[1:]
    return spark.createDataFrame([(k, *(float(r[n]) for n in names)) for k, r in enumerate(full)], POLICY)
