"""Tables computed once where several parts of a plan read them."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once to the folder that ``spark.checkpoint.dir`` names and read from there from now on, so that a lost executor loses nothing.

    Where a session names no folder, a local master gets a temporary one, as in tests; on a cluster that is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="kept-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
