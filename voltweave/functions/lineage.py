"""Cutting lineage in iterative plans, and how many tasks compute-bound stages get."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_folder(df: DataFrame) -> str:
    """The folder that spark.checkpoint.dir names.

    Where that is unset a local session gets a temporary folder; on a cluster, whose machines do not share one, a
    RuntimeError says what to set.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="vw-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back.

    Unlike checkpoint(), the copy has the size of its files, not an estimate multiplied up by every
    join of every round, which makes planning of later rounds slower and slower.
    """
    path = f"{shared_folder(df)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(df: DataFrame) -> int:
    """Partitions for stages whose work does not show in their bytes, which adaptive execution would merge into one task."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
