"""Claimed blocks of uids: two jobs never write the same id.

A uid is a millisecond and a suffix of 36^5 values, so a job owns its ids as
soon as it owns its milliseconds.  A millisecond is owned by whoever created
its file in one shared folder; creation fails if the file exists.  A job of
over 36^5 rows claims several neighbouring milliseconds.
"""

from __future__ import annotations

import os
import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from fieldmill.functions.keys import SUFFIX_SPACE
from fieldmill.session import checkpoint_dir


def create_new(spark: SparkSession, folder: str, name: str) -> bool:
    """Create an empty file; False if it exists already."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder, name)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getScheme() == "file":  # the Hadoop call looks first and creates then: not exclusive here
        local = path.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            os.close(os.open(local, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            return True
        except FileExistsError:
            return False
    try:
        fs.create(path, False).close()
        return True
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise


def claim_base(spark: SparkSession, rows: int, below: int = 0, folder: str | None = None,
               now_ms: int | None = None) -> int:
    """A ``base_ms`` for ``generate_uid``: rows 0..rows-1, and the ``below``
    numbers that count downwards from it, get ids no other claim of the same
    folder has.  ``folder`` must be one for all jobs (default: below the
    shared checkpoint folder); ``now_ms``: clock reading to begin at.

    A taken millisecond moves the block behind it; files of an attempt that
    moved stay as unused claims.  No rows claim one millisecond.
    """
    folder = folder or os.path.join(checkpoint_dir(spark), "fieldmill-uids")
    up, down = max(1, -(-rows // SUFFIX_SPACE)), -(-below // SUFFIX_SPACE)
    first = (int(time.time() * 1000) if now_ms is None else int(now_ms)) - down
    at = first
    while at < first + down + up:
        if not create_new(spark, folder, f"ms-{at}"):
            first = at + 1
        at += 1
    return first + down
