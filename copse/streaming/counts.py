"""Line counts by language of files that keep arriving, as a streaming aggregate.

The same column functions as in the batch plans; only the sums by language are state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copse.operators import scan
from copse.operators.counts import SUMS


def running_counts(files: DataFrame) -> DataFrame:
    """``language, files, code, comment, blank, total, complexity`` of a stream of ``path, content``; for update or complete mode."""
    measured = scan.measured(scan.with_lines(files))
    return measured.groupBy("language").agg(F.count("*").alias("files"), *[F.sum(c).alias(c) for c in SUMS])
