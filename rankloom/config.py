"""Tunables shared by operators and plans."""

from __future__ import annotations

from dataclasses import dataclass, field

# Thresholds and fractions of the feature, sampling, evaluation
# and monitoring stages.
MIN_USER_RATINGS = 20
MIN_ITEM_RATINGS = 5
TRAIN_FRACTION = 0.8
VAL_FRACTION = 0.1
POSITIVE_RATING = 4.0
RATING_RANGE = (0.5, 5.0)
YEAR_RANGE = (1995, 2024)
RECENCY_DECAY = 1e-7
NEGATIVES_TRAIN = 4
NEGATIVES_VAL = 1
EVAL_NEGATIVES = 99
COVERAGE_USERS = 500
COVERAGE_K = 10
RANK_CUTOFFS = (5, 10, 20)
BATCH_ROWS = 4_096
PSI_BINS = 10
PSI_WARN = 0.1
PSI_FAIL = 0.2
PROMOTION_METRIC = "NDCG@10"
# Names of the branches after the drift gate, and of the split in a manifest.
NEXT_STEPS = ("promote_model", "block_and_alert")
SPLIT_STRATEGY = "temporal_per_user"
SEED = 42
MONITORED_USER_FEATURES = ("user_avg_rating", "user_rating_count")
MONITORED_ITEM_FEATURES = ("item_avg_rating", "item_rating_count", "item_recency_score")
MONITORED_FEATURES = MONITORED_USER_FEATURES + MONITORED_ITEM_FEATURES

# Physical limits. A window group never holds more rows than MAX_GROUP_ROWS;
# beyond it operators switch to a form that spreads the group over tasks.
MAX_GROUP_ROWS = 5_000_000
# Rows a side may have before it is hinted for broadcast.
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 32 * 2**20
# Rows of one bucket of histories, and of one item that meet in a task of a join.
BUCKET_ROWS = 4_000_000
MAX_ITEM_ROWS = 4_000_000
# Longest array a generator row may carry before it is exploded.
EXPLODE_CHUNK = 4_096


@dataclass(frozen=True)
class FeatureConfig:
    """Settings of the feature plan."""

    min_user_ratings: int = MIN_USER_RATINGS
    min_item_ratings: int = MIN_ITEM_RATINGS
    train_fraction: float = TRAIN_FRACTION
    val_fraction: float = VAL_FRACTION
    # "all": features see every kept rating. "train": only the training part.
    feature_scope: str = "all"
    # Columns that, after (timestamp, movieId), make a user's history totally ordered.
    tie_columns: tuple[str, ...] = field(default=())
    max_group_rows: int = MAX_GROUP_ROWS
    # User and item tables of more rows are joined without a broadcast.
    max_broadcast_rows: int = MAX_BROADCAST_ROWS
    bucket_rows: int = BUCKET_ROWS
    max_item_rows: int = MAX_ITEM_ROWS

    def __post_init__(self) -> None:
        if self.feature_scope not in ("all", "train"):
            raise ValueError(f"feature_scope must be 'all' or 'train', not {self.feature_scope!r}")
        if not 0 < self.train_fraction + self.val_fraction <= 1:
            raise ValueError("train and validation fractions must sum to (0, 1]")

    @property
    def history_order(self) -> tuple[str, ...]:
        return ("timestamp", "movieId", *self.tie_columns)
