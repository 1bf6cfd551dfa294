"""Folders for tables between steps, in the folder that all machines share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid


def scratch(spark, name: str) -> str:
    """A new path below spark.checkpoint.dir; below a temporary folder only where that is unset and all tasks run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no folder that all machines share")
        own = tempfile.mkdtemp(prefix="locusframe-scratch-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
    return f"{found.rstrip('/')}/locusframe/{name}-{uuid.uuid4().hex}"
