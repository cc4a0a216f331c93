"""What operators need from the session: a shared folder, and a way to cut a plan's lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written stages that the session names and all executors share.

    Only a local session without one (as in tests) gets a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Rows that fill a part of a narrow table.
PART_ROWS = 250_000


def gathered(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut``, read in as many parts as its rows fill, and its number of rows.

    What is left of a large table after a filter lies in as many parts as the table had; every shuffle of it would write
    that many files.
    """
    out = cut(df)
    n = out.count()
    return out.coalesce(max(1, -(-n // PART_ROWS))), n
