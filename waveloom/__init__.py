"""Waveform and channel-data analytics as Spark DataFrame operators.

A *channel* is a long, typed, 1-D series addressed by ``sample_idx``. The
canonical tables are

``channels(channel_id, length, ...)``
    one row per channel (small: the catalog),
``samples(channel_id, sample_idx, v, ...)``
    one row per sample, clustered by (channel_id, sample_idx),
``buckets(channel_id, level, bucket, n, total, mn, mx, pv, dl, m2)``
    the rollup: bucket states at several resolutions.

Every operator is a function from DataFrames to a DataFrame.
"""

import sys

from pyspark import cloudpickle

from .session import builder, configure, shared_dir

__all__ = ["builder", "configure", "shared_dir"]

# Functions that run in Python workers travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
