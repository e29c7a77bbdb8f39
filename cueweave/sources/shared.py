"""The folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir or setCheckpointDir names.

    Where neither is set, one of this machine is made, which goes with the process; only a session that runs on this machine alone gets one.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where:
        known = sc._jsc.sc().getCheckpointDir()
        where = known.get() if known.isDefined() else getattr(sc, "_cueweave_shared", None)
    if not where:
        if not re.fullmatch(r"local(\[[\d*]+(,\s*\d+)?\])?", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="cueweave-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        where = sc._cueweave_shared = "file://" + own
    return where.rstrip("/")
