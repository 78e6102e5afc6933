"""Content hashes of files, read in pieces by executors, and a second look at each file after its hash."""

# A task has files of about TASK_BYTES, whatever the tree's size.

from __future__ import annotations

import hashlib
import os
import time

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import domain as D
from .tree import classify, shortened

#: Bytes read at once.
PIECE = 1 << 20
TASK_BYTES = 1 << 30
SCHEMA = "relative_path binary, content_hash binary, hash_status string, code string, message string"


def digest(path: bytes) -> bytes:
    h = hashlib.sha256()
    with open(path, "rb", buffering=0) as f:
        while piece := f.read(PIECE):
            h.update(piece)
    return h.digest()


def free_bytes(path: str) -> int:
    s = os.statvfs(path)
    return s.f_bavail * s.f_frsize


def hashed(files: DataFrame, root: bytes, faults: dict | None = None, least: int = 4, batch: int = 1000, pause: float = 0.0, disk: str | None = None, floor: int = 0) -> DataFrame:
    """For each row of files (relative_path, size_bytes, mtime_ns) its hash, or an error and no hash.

    A file whose size or time has moved since it was listed keeps the hash that was read, is marked, and has an error beside it. Rows are dealt over
    tasks by bytes, ``least`` tasks at least. After every ``batch`` rows a task pauses and looks at the free space of ``disk``; once that is
    below the floor it gives no further rows.
    """
    import errno

    odd = {os.fsencode(k): v for k, v in (faults or {}).items()}

    def one(rel: bytes, size: int, mtime: int) -> tuple:
        path = os.path.join(root, rel)
        try:
            if rel in odd and odd[rel] != "MOVED":
                number = getattr(errno, odd[rel])
                raise OSError(number, os.strerror(number))
            found = digest(path)
            about = os.stat(path)
        except OSError as e:
            return rel, None, None, classify(e), shortened(e.strerror or str(e))
        if odd.get(rel) == "MOVED" or about.st_size != size or max(0, about.st_mtime_ns) != mtime:
            return rel, found, D.MOVED, D.MOVED, "size or modification time changed while the file was read"
        return rel, found, D.HASH_COMPLETE, None, None

    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                rows = [one(*r) for r in pdf.iloc[i : i + batch].itertuples(index=False)]
                yield pd.DataFrame(rows, columns=["relative_path", "content_hash", "hash_status", "code", "message"])
                if pause:
                    time.sleep(pause)
                if disk is not None and free_bytes(disk) < floor:
                    return

    size = files.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
    return files.select("relative_path", "size_bytes", "mtime_ns").repartition(max(least, size // TASK_BYTES + 1)).mapInPandas(run, SCHEMA)
