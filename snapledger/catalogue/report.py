"""What the commands print: TOML, so that people and programs can read it alike."""

from __future__ import annotations

import json
import sys
import time
from pathlib import Path

from pyspark.sql import functions as F

from ..functions import domain as D
from ..functions.formatting import ago_text, human_text
from ..operators import status as S
from . import settings as C
from .ingest import Outcome
from .store import Store, now_ns


def _section(name: str, **values) -> list[str]:
    """A TOML table; values that are None or empty are left out. Strings are quoted as JSON does, which TOML reads."""
    shown = [f"{k} = {json.dumps(v)}" for k, v in values.items() if v is not None and v != "" and v != []]
    return [f"[{name}]", *shown, ""] if shown else []


def _notes(o: Outcome) -> list[str]:
    """What a reader should know beyond the numbers."""
    out = []
    if o.unreadable_dirs:
        out.append(f"{o.unreadable_dirs} folder(s) would not list, so nothing is known of their contents")
    if o.unreadable:
        out.append(f"{o.unreadable} known file(s) lie at or below paths that failed; they keep their last state")
    if o.low_space:
        out.append(f"ended early because less than {human_text(o.required_free)} was left on the catalogue's disk")
    if o.base_unreadable:
        out.append("the top folder failed to list, which would have looked like the loss of everything")
    if o.status != D.COMPLETE:
        out.append("what was read is kept; the next ingest of this folder carries on from there")
    return out


def scan_lines(root: Path, base: Path, settings: C.Settings, o: Outcome) -> list[str]:
    out = _section("scan", number=o.scan_id, folder=str(base), catalogue=str(root), outcome=o.status, carried_on=o.resumed or None, seconds=round(o.duration_ms / 1000, 2), tasks=settings.workers, batch=settings.writer_batch_rows)
    out += _section("read", files=o.staged, size=human_text(o.discovered_bytes), hashed=o.hashed, hashed_size=human_text(o.hashed_bytes), hashes_from_catalogue=o.reused_baseline, hashes_from_earlier_attempt=o.reused_stage, failures=o.errors, failed_paths=o.unreadable_paths or None)
    out += _section("left_out", hidden=o.excluded_hidden or None, other_mounts=o.excluded_mount or None, links=o.excluded_symlink or None)
    if o.status == D.COMPLETE:
        out += _section("difference", added=o.added, updated=o.updated, deleted=o.deleted, unchanged=o.unchanged, present=o.present)
        out += _section("history", changes_dropped=o.pruned_changes or None, tombstones_dropped=o.pruned_files or None)
    out += _section("disk", free_at_start=human_text(o.free_before), kept_free=human_text(o.required_free), rule=o.estimate_source)
    return out + _section("remarks", text=_notes(o))


def status_lines(spark, settings: C.Settings) -> list[str]:
    """Reads only: no lock, no version, no folder is made."""
    out = _section("settings", files=[str(p) for p in C.candidates() if p.exists()], **settings.policy, kept_free=human_text(settings.floor), scans_of_history=settings.keep_scans)
    store = Store(spark, settings.root)
    if not store.exists():
        return [*out, *_section("catalogue", folder=str(settings.root), exists=False)]
    store.open()
    bases, scans, now = store.table("bases"), store.table("scans"), now_ns()
    rows = S.baselines(bases, scans).join(S.resumable(scans), "base_id", "left").join(S.policy_differences(bases, settings.policy), "base_id", "left").orderBy(F.col("base_id")).collect()
    out += _section("catalogue", folder=str(store.root), exists=True, folders=len(rows), written_by_process=store.holder())
    for r in rows:
        done = r["baseline_scan_id"] is not None and r["finished_at_ns"] is not None
        out += _section(
            f"folder.{r['base_id']}", path=r["base_path"], baseline=r["baseline_scan_id"] if done else None, age=ago_text(r["finished_at_ns"], now) if done else None, files=(r["present_count"] or 0) if done else None,
            unfinished=r["scan_id"], unfinished_state=r["status"] if r["scan_id"] is not None else None, unfinished_age=ago_text(r["started_at_ns"], now) if r["scan_id"] is not None else None, settings_that_differ=r["differs"] or None,
        )
    return out


def prune_lines(root: Path, settings: C.Settings, found: list[dict], apply: bool) -> list[str]:
    done = "applied" if apply else "preview"
    out = _section("history", catalogue=str(root), scans_kept=settings.keep_scans or "all", mode=done, rows=sum(r["changes"] + r["files"] for r in found))
    for r in found:
        out += _section(f"folder.{r['base_id']}", path=r["base_path"], oldest_scan_kept=r["cutoff"], changes=r["changes"], tombstones=r["files"])
    return out


class Meter:
    """How far a scan is, on one line of a terminal; silent elsewhere. The files of the last baseline serve as an estimate until they are exceeded."""

    def __init__(self, out=sys.stderr, every: float = 0.25):
        self.out, self.every, self.last, self.shown = out, every, 0.0, False

    def __call__(self, seen: int, done: int, before: int) -> None:
        if not self.out.isatty() or time.monotonic() - self.last < self.every:
            return
        self.last, self.shown = time.monotonic(), True
        share = f", about {done * 100 // before} %" if 0 < done <= before else ""
        self.out.write(f"\x1b[2K\r{done} of {seen} files{share}")
        self.out.flush()

    def close(self) -> None:
        if self.shown:
            self.out.write("\x1b[2K\r")
            self.out.flush()
