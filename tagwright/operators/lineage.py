"""Cutting of lineage between the rounds of an iterative operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame

_OWN: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed and read back from the folder in ``spark.checkpoint.dir``.

    Where that is unset in local mode a temporary folder stands in; on a cluster it must be set, as
    no other machine would see such a folder.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            at = tempfile.mkdtemp(prefix="tagwright-")
            _OWN.append(at)
            atexit.register(shutil.rmtree, at, ignore_errors=True)
        sc.setCheckpointDir(at)
    return df.checkpoint()
