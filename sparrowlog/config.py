"""Data set settings, the feature registry and the normalised schemas."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import types as T

IMPRESSION = T.StructType([
    T.StructField("impression_id", T.LongType()), T.StructField("user_id", T.StringType()), T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("candidates", T.ArrayType(T.StringType())), T.StructField("clicked", T.ArrayType(T.StringType())), T.StructField("history", T.ArrayType(T.StringType())),
    T.StructField("history_timestamps", T.ArrayType(T.TimestampNTZType())), T.StructField("recency_seconds", T.DoubleType()),
])
ARTICLE = T.StructType([
    T.StructField("article_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("abstract", T.StringType()), T.StructField("body", T.StringType()),
    T.StructField("category", T.StringType()), T.StructField("entities", T.ArrayType(T.StringType())), T.StructField("published_time", T.TimestampNTZType()),
    T.StructField("total_inviews", T.IntegerType()), T.StructField("total_pageviews", T.IntegerType()), T.StructField("total_read_time", T.FloatType()),
])

#: Lifetime totals: known only after the fact, so nothing that scores may read them.
FORBIDDEN = ("total_inviews", "total_pageviews", "total_read_time")

#: The point-in-time features in the order they are written.
FEATURES = (
    "bm25", "emb", "pop_causal", "pop_rank", "emb_rank", "n_cands", "pop_rel_max", "pop_24h", "pop_velocity", "exp_causal", "exp_24h", "exp_velocity",
    "exp_rank", "exp_rel_max", "age_hours", "recency", "cat_match", "hist_len", "ent_overlap", "user_read", "user_scroll", "engage_sim",
)


@dataclass(frozen=True)
class Dataset:
    """One log: which adapter reads it, where it is cut in time, and what it lacks."""

    name: str
    loader: str = "nested"
    val_start: str = "2024-01-20 00:00:00"
    test_start: str = "2024-01-25 00:00:00"
    language: str = "english"
    stem: bool = False
    history_len: int = 30
    fields: tuple[str, ...] = ("title", "abstract", "body")
    pop_window_h: float | None = 6.0
    entity_alpha: float = 0.3
    lacks: frozenset[str] = field(default_factory=frozenset)

    def features(self) -> tuple[str, ...]:
        return tuple(f for f in FEATURES if f not in self.lacks)


#: What a log without publication times and engagement records can't give.
NO_ENGAGEMENT = frozenset({"age_hours", "recency", "user_read", "user_scroll", "engage_sim"})


def datasets(path: str | Path) -> dict[str, Dataset]:
    """Data sets of a YAML file: name -> settings."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    tuples = {"fields": tuple, "lacks": frozenset}
    return {name: Dataset(name=name, **{k: tuples.get(k, lambda x: x)(v) for k, v in (cfg or {}).items()}) for name, cfg in raw.items()}
