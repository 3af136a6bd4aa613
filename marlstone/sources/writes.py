"""Parquet sinks: overwrite and append, staged beside the target and put in place whole.

Files are moved by Hadoop's FileSystem, so a target may be on any file system that Spark writes to.  Where
a rename is not atomic, as on object stores, readers may see the change happen; a failure is rolled back
all the same.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from marlstone.errors import InvalidConfigError, StorageError, UnsupportedError
from marlstone.sources.files import Files

MODES = ("overwrite", "append")


def is_single_file(path: str) -> bool:
    return path.endswith(".parquet")


def put_in_place(files: Files, stage: str, target: str) -> None:
    """Rename the target away, the stage in, and back again if that fails."""
    backup = f"{target}.{uuid.uuid4().hex}.backup"
    had = files.exists(target)
    if had:
        files.move(target, backup)
    try:
        files.move(stage, target)
    except (OSError, Py4JJavaError):
        if had:
            files.move(backup, target)
        raise
    if had:
        files.remove(backup)


def _parts(files: Files, folder: str) -> list[str]:
    return [f for f in files.names(folder) if f.startswith("part-") and f.endswith(".parquet")]


def _append(files: Files, stage: str, made: list[str], target: str) -> list[str]:
    """Move the new files in behind the old ones; if one fails, those already moved are taken out again."""
    used = [int(m[1]) for f in _parts(files, target) if (m := re.match(r"part-(\d+)\.parquet$", f))]
    first, out = max(used, default=-1) + 1, []
    try:
        for i, old in enumerate(made):
            files.move(f"{stage}/{old}", f"{target}/part-{first + i:05d}.parquet")
            out.append(f"{target}/part-{first + i:05d}.parquet")
    except (OSError, Py4JJavaError):
        for path in out:
            files.remove(path)
        raise
    return out


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", files: int | None = None) -> list[str]:
    """Write ``df`` and return the new files.

    A path with the ending .parquet is one file, which one task writes; another is a folder of
    part-00000.parquet and so on, as many as the plan has partitions or ``files``.
    """
    if mode not in MODES:
        raise InvalidConfigError(f"mode is one of {MODES}, not {mode!r}")
    target, store = path.rstrip("/"), Files(df.sparkSession)
    single = is_single_file(target)
    if single and mode == "append":
        raise UnsupportedError("a single file can't be appended to")
    stage = f"{target}.{uuid.uuid4().hex}.stage"
    try:
        store.make_folder(store.parent(target))
        (df.coalesce(1) if single else df.coalesce(files) if files else df).write.parquet(stage)
        made = _parts(store, stage)
        if single:
            put_in_place(store, f"{stage}/{made[0]}", target)
            return [target]
        if mode == "append" and store.is_folder(target):
            return _append(store, stage, made, target)
        for name in store.names(stage):
            if name not in made:
                store.remove(f"{stage}/{name}")
        names = [f"part-{i:05d}.parquet" for i in range(len(made))]
        for old, new in zip(made, names):
            store.move(f"{stage}/{old}", f"{stage}/{new}")
        put_in_place(store, stage, target)
        return [f"{target}/{n}" for n in names]
    except (OSError, Py4JJavaError) as e:
        if isinstance(e, PySparkException):
            raise
        raise StorageError(f"{path}: {e}") from e
    finally:
        store.remove(stage)
