"""Versioned Parquet tables in one folder.

A version is a manifest that names the directories of each table. Writers put new directories beside the old ones and
publish the manifest after the one they have read, under a name that must not exist; readers use the newest manifest. So a crash
leaves unused directories and never a torn catalogue, and no writer undoes what another published. Writers remove directories that no
manifest of the last while names.
"""

from __future__ import annotations

import fcntl
import json
import os
import shutil
import time
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domain as D
from .settings import CatalogueError

APPLICATION, VERSION = "snapledger", 1
#: Seconds for which directories that a newer version has replaced stay, for readers that began before.
GRACE = 3600.0


class Store:
    def __init__(self, spark: SparkSession, root: Path):
        self.spark, self.root = spark, Path(root)
        self.manifests = self.root / "_manifest"

    # manifests

    def exists(self) -> bool:
        return self.manifests.is_dir() and any(self.manifests.glob("v*.json"))

    def open(self, create: bool = False) -> Store:
        """Check that the folder is a catalogue of this version; an empty or missing one is adopted when ``create``."""
        if self.exists():
            m = self.manifest()
            if m.get("application_id") != APPLICATION:
                raise CatalogueError(D.EXIT_CONFIG, f"{self.root} belongs to another application")
            if m.get("schema_version") != VERSION:
                raise CatalogueError(D.EXIT_CONFIG, f"{self.root} has version {m.get('schema_version')}, not {VERSION}")
        elif self.root.exists() and (not self.root.is_dir() or any(p.name != "_manifest" for p in self.root.iterdir())):
            raise CatalogueError(D.EXIT_CONFIG, f"{self.root} is not a catalogue")
        elif create:
            self.manifests.mkdir(parents=True, exist_ok=True)
            self.publish({t: [] for t in D.TABLES} | {"stage": []}, 0)
        return self

    def manifest(self) -> dict:
        newest = max(self.manifests.glob("v*.json"))
        return json.loads(newest.read_text())

    def publish(self, tables: dict[str, list[str]], read: int) -> int:
        """Make these directories the version after the one that was ``read``; fails if another writer has published it."""
        n = read + 1
        temp = self.manifests / f".{uuid.uuid4().hex}"
        with open(temp, "w") as f:
            json.dump({"application_id": APPLICATION, "schema_version": VERSION, "version": n, "tables": tables}, f)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(temp, self.manifests / f"v{n:012d}.json")
        except FileExistsError as e:
            raise CatalogueError(D.EXIT_BUSY, "another writer published first") from e
        finally:
            temp.unlink()
        return n

    def commit(self, **changed: list[str]) -> int:
        now = self.manifest()
        return self.publish(now["tables"] | changed, now["version"])

    def sweep(self, grace: float = GRACE) -> list[str]:
        """Remove what no manifest of the last ``grace`` seconds names, unless it is as young itself; the newest manifest always counts. For the holder of the lock. Gives the directories removed."""
        limit = time.time() - grace
        versions = sorted(self.manifests.glob("v*.json"))
        until = [p.stat().st_mtime for p in versions[1:]] + [float("inf")]  # a version is in force until the next is published
        young = [p for p, t in zip(versions, until, strict=True) if t > limit]
        used = {d for p in young for dirs in json.loads(p.read_text())["tables"].values() for d in dirs}
        gone = []
        for top in [*D.TABLES, "stage"]:
            for where in self.root.glob(f"{top}/*/*"):
                name = str(where.relative_to(self.root))
                if name not in used and where.stat().st_mtime <= limit:
                    gone.append(name)
        gone += [str(w.relative_to(self.root)) for w in self.root.glob("work/*") if w.stat().st_mtime <= limit]
        for p in versions:
            if p not in young:
                p.unlink(missing_ok=True)
        for name in gone:
            shutil.rmtree(self.root / name, ignore_errors=True)
        for top in [*D.TABLES, "stage"]:
            for part in self.root.glob(f"{top}/*"):
                if not any(part.iterdir()):
                    part.rmdir()
        return gone

    # tables

    def table(self, name: str) -> DataFrame:
        return self.read(self.manifest()["tables"][name], D.STAGE if name == "stage" else D.TABLES[name])

    def read(self, dirs: list[str], schema) -> DataFrame:
        if not dirs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[str(self.root / d) for d in dirs])

    def write(self, df: DataFrame, name: str, schema, part: str = "all") -> str:
        """A new directory with df's rows in the table's columns; its name within the catalogue. ``part`` says which rows of the table it holds."""
        where = f"{name}/{part}/{uuid.uuid4().hex}"
        columns = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
        df.select(*columns).write.option("compression", "zstd").parquet(str(self.root / where))
        return where

    def rows(self, name: str) -> list[dict]:
        """A small table, of bases or scans, as dicts."""
        return [r.asDict() for r in self.table(name).collect()]

    def written_rows(self, name: str, rows: list[dict]) -> list[str]:
        schema = D.TABLES[name]
        df = self.spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)
        return [self.write(df.coalesce(1), name, schema)]

    # one writer

    @property
    def lock_file(self) -> Path:
        return self.manifests / "writer.lock"

    def holder(self) -> int | None:
        """The process that holds the lock; 0 if it hasn't said who it is yet."""
        try:
            with open(self.lock_file) as f:
                try:
                    fcntl.flock(f, fcntl.LOCK_SH | fcntl.LOCK_NB)
                except BlockingIOError:
                    return int(f.read() or 0)
        except (FileNotFoundError, ValueError):
            pass
        return None

    @contextmanager
    def writing(self):
        """Hold the writer's lock. The system gives it back when its holder ends, however that ends, and the file stays, so there is nothing to take over."""
        with open(self.lock_file, "a+") as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except BlockingIOError as e:
                raise CatalogueError(D.EXIT_BUSY, f"{self.root} is being written by process {self.holder() or 'unknown'}") from e
            f.truncate(0)
            f.write(str(os.getpid()))
            f.flush()
            try:
                yield
            finally:
                f.truncate(0)

    def free_bytes(self) -> int:
        s = os.statvfs(self.root)
        return s.f_bavail * s.f_frsize


def now_ns() -> int:
    return time.time_ns()
