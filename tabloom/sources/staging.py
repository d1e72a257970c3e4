"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid


def place(spark) -> str:
    """A new path in the folder that executors share. Only a local master may do without the setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="tabloom-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/files-{uuid.uuid4().hex}"


def staged(df):
    """df as a table in the shared folder, so that what follows reads it and does not make it again."""
    df.write.parquet(path := place(df.sparkSession))
    return df.sparkSession.read.schema(df.schema).parquet(path)
