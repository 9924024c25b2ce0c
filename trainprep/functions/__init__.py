"""Column-level building blocks: counter-based hashes and distributed order."""

from trainprep.functions.hashing import h60, h60_unit, stable_hash, TWO_POW_60  # noqa: F401
from trainprep.functions.order import prefix_agg, prefix_sum, dense_rank_by, RankStats, key_stats  # noqa: F401
