"""trainprep: the data side of language-model training as Spark jobs.

Corpus mixing, normalising, deterministic splits, tokenising, shard packing,
batching, multiple-choice scoring and metric roll-ups, expressed with the
DataFrame / SQL / Structured Streaming APIs.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions shipped to executors (Arrow UDFs, stateful streaming functions) are
# pickled by value, so executors need no installed copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from trainprep.session import get_session, checkpoint_dir, materialize  # noqa: E402,F401

__all__ = ["get_session", "checkpoint_dir", "materialize"]
