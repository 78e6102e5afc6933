"""Queries over a real tree: the documents are written as files, listed, scanned three times, and the catalogue's tables read back.

A document is the file source/lang/doc_id.txt. Those whose id ends in 0 have a hidden name, those whose id ends in 1 have a link beside
them. Before the second scan every seventh file changes and every seventh goes; that scan is stopped once, then finds src1 unreadable
and can't read some of the changed files. The third finds all in order. Two scans of history are kept.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue.ingest import ingest
from ..catalogue.settings import Settings
from ..catalogue.store import Store
from ..functions import domain as D
from ..sources.tree import Tree
from .snapshots import table

MTIME = 1_700_000_000_000_000_000


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors see: below spark.checkpoint.dir; of the machine only where the session runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        at = urlparse(named)
        if at.scheme not in ("", "file"):
            raise RuntimeError("these queries list files, so spark.checkpoint.dir must be a mounted folder")
        os.makedirs(at.path, exist_ok=True)
        return tempfile.mkdtemp(prefix="snapledger-tree-", dir=at.path)
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="snapledger-tree-")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.when(F.col("doc_id") % 10 == 0, ".").otherwise(""), F.col("doc_id").cast("string"), F.lit(".txt"))
    where = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), name)
    return table(spark, sf_dir, "documents").select("doc_id", where.alias("path"), F.coalesce("text", F.lit("")).alias("text"))


def _write(rows: DataFrame, root: str) -> None:
    """Files of rows(doc_id, path, text), written by tasks; a null text removes one."""

    def run(batches):
        n = 0
        for pdf in batches:
            for doc_id, path, text in pdf.itertuples(index=False):
                at = os.path.join(root, path)
                n += 1
                if text is None:
                    os.unlink(at)
                    continue
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(at, "wb") as f:
                    f.write(text.encode())
                os.utime(at, ns=(0, MTIME + int(doc_id) * 1_000_003))
                if doc_id % 10 == 1 and not os.path.lexists(f"{at}.link"):
                    os.symlink(at, f"{at}.link")
        yield pd.DataFrame({"n": [n]})

    rows.mapInPandas(run, "n long").agg(F.sum("n")).collect()


class World:
    """The tree and the catalogue of one set of tables, made once a session. ``after``: the tables' directories after each scan."""

    made: dict[tuple[str, str], World] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.root = _folder(spark)
        atexit.register(shutil.rmtree, self.root, ignore_errors=True)
        self.tree = os.path.join(self.root, "tree")
        os.makedirs(self.tree)
        docs = _paths(spark, sf_dir)
        _write(docs, self.tree)
        settings = Settings(catalogue_path=os.path.join(self.root, "catalogue"), minimum_free_space_mib=1, keep_scans=2)
        self.store, self.outcomes, self.after = Store(spark, settings.root), [], []

        def scan(**options):
            self.outcomes.append(ingest(spark, settings, self.tree, **options))
            self.after.append(self.store.manifest()["tables"])

        scan()
        changed = docs.filter("doc_id % 7 = 1").withColumn("text", F.concat("text", F.lit("!")))
        _write(changed.unionByName(docs.filter("doc_id % 7 = 2").withColumn("text", F.lit(None).cast("string"))), self.tree)
        scan(cancelled=lambda: True)
        scan(walk_faults={"src1": "EACCES"}, hash_faults={r["path"]: "EACCES" for r in docs.filter("doc_id % 70 = 1").select("path").collect()})
        scan()

    def read(self, k: int, name: str) -> DataFrame:
        return self.store.read(self.after[k][name], D.TABLES[name])


def world(spark: SparkSession, sf_dir: str) -> World:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in World.made:
        World.made[key] = World(spark, sf_dir)
    return World.made[key]


def listed(spark: SparkSession, root: str, **options: str) -> DataFrame:
    spark.dataSource.register(Tree)
    return spark.read.format(Tree.name()).options(path=root, **options).load()


#: t: the tree's files at first; v: those that are listed; u: after the change; the numbers that scans see.
SQL = """with t as (select doc_id, coalesce(source, 'none') as src, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || case when doc_id % 10 = 0 then '.' else '' end || doc_id || '.txt' as path, coalesce(text, '') as text,
 1700000000000000000 + doc_id * 1000003 as mtime, doc_id % 7 as c, doc_id % 70 = 1 as bad from documents),
v as (select *, src = 'src1' as shut, case when c = 1 then text || '!' else text end as later from t where doc_id % 10 <> 0)
"""
