"""A folder that the driver and all executors share, and what this process keeps there."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}
_MADE: list[tuple[SparkSession, str, int]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where that is unset, a local session has a temporary folder for the life of
    the application; on a cluster, whose executors would each write to a disk of their own, it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="semlake-")
        found = _OWN[app]
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other table has; what is written there goes with the process, or by ``drop_shared``."""
    path = f"{shared_dir(spark)}/semlake/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path, threading.get_ident()))
    return path


def _drop(made: tuple[SparkSession, str, int]) -> None:
    spark, path, _ = made
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended already
        pass


def drop_path(path: str) -> None:
    """Remove one path of ``shared_path``."""
    for made in [m for m in _MADE if m[1] == path]:
        _MADE.remove(made)
        _drop(made)


@contextmanager
def passing():
    """What this thread writes under ``shared_path`` within the block goes at its end, but for the paths put into the set it gives."""
    mark, me, kept = len(_MADE), threading.get_ident(), set()
    yield kept
    for made in [m for m in _MADE[mark:] if m[2] == me and m[1] not in kept]:
        _MADE.remove(made)
        _drop(made)


@atexit.register
def drop_shared() -> None:
    """Remove what was written so far under ``shared_path``; frames that still read it end here."""
    while _MADE:
        _drop(_MADE.pop())
