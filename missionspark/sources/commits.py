"""Tables that change in one step: readers see what was published last, whole.

Data is written to a folder of its own first.  Publishing is one rename of a
small file to the next number below ``commits``; a rename to a name that is
taken fails, so of two writers one is told.  What was written and never
published is seen by nobody.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has published meanwhile."""


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the commits that are there, ascending."""
    path, system = _files(spark, f"{root}/commits")
    if not system.exists(path):
        return []
    names = [s.getPath().getName() for s in system.listStatus(path)]
    return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and n[0] != "_")


def folders(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders right below ``root``."""
    path, system = _files(spark, root)
    return sorted(s.getPath().getName() for s in system.listStatus(path) if s.isDirectory()) if system.exists(path) else []


def committed(spark: SparkSession, root: str) -> dict | None:
    """What was published last."""
    known = numbers(spark, root)
    if not known:
        return None
    path, system = _files(spark, f"{root}/commits/{known[-1]:010d}.json")
    stream = system.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def publish(spark: SparkSession, root: str, content: dict, after: int | None = None) -> int:
    """Publishes ``content`` and gives its number; with ``after``, only if that is the last number."""
    known = numbers(spark, root)
    last = known[-1] if known else 0
    if after is not None and after != last:
        raise Conflict(f"{root} is at {last}, not at {after}")
    staged, system = _files(spark, f"{root}/commits/_{uuid.uuid4().hex}")
    stream = system.create(staged, False)
    try:
        stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    finally:
        stream.close()
    target, _ = _files(spark, f"{root}/commits/{last + 1:010d}.json")
    if system.exists(target) or not system.rename(staged, target):
        system.delete(staged, False)
        raise Conflict(f"{root} has a commit {last + 1} already")
    return last + 1
