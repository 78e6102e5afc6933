"""Scans of real trees: each test builds one, scans it, changes it and scans it again."""

import os
import signal
import subprocess
import sys
import time
import tomllib
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from snapledger.__main__ import main
from snapledger.catalogue import ingest as I
from snapledger.catalogue import report
from snapledger.catalogue.settings import CatalogueError, Settings, load
from snapledger.catalogue.store import Store


class Box:
    def __init__(self, spark, tmp):
        self.spark, self.tree, self.settings = spark, tmp / "tree", Settings(workers=2, catalogue_path=str(tmp / "store"), minimum_free_space_mib=1)
        self.tree.mkdir()

    def write(self, name, text="x"):
        path = os.path.join(os.fsencode(self.tree), name if isinstance(name, bytes) else os.fsencode(name))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(text)

    def scan(self, code=0, **options):
        out = I.ingest(self.spark, self.settings, self.tree, **options)
        assert out.exit_code == code, (out, report.scan_lines(self.settings.root, self.tree, self.settings, out))
        if out.status == "complete":
            assert out.added + out.updated + out.unchanged == out.staged
        return out

    def table(self, name):
        return Store(self.spark, self.settings.root).table(name)

    def files(self):
        rows = self.table("files").collect()
        assert len({(r["base_id"], bytes(r["relative_path"])) for r in rows}) == len(rows) == len({r["file_id"] for r in rows})
        assert all(len(r["content_hash"]) == 32 for r in rows)
        return {bytes(r["relative_path"]): r for r in rows}

    def presence(self, name):
        return self.files()[name]["presence"]

    def changes(self, scan):
        return {bytes(r["relative_path"]): (r["change_kind"], r["field_mask"]) for r in self.table("changes").filter(F.col("scan_id") == scan).collect()}


@pytest.fixture
def box(spark, tmp_path):
    return Box(spark, tmp_path)


def test_fresh_rerun_edit_rename_remove_resurrect(box):
    for name in ("a.txt", "sub/b.txt", "sub/deeper/c.TXT"):
        box.write(name, name)
    out = box.scan()
    assert (out.staged, out.added, out.present, out.errors, out.hashed, out.resumed) == (3, 3, 3, 0, 3, False)
    first = box.files()
    assert (first[b"sub/deeper/c.TXT"]["parent_path"], first[b"sub/deeper/c.TXT"]["name"], first[b"sub/deeper/c.TXT"]["extension"], first[b"a.txt"]["parent_path"]) == ("sub/deeper", "c.TXT", "txt", None)

    out = box.scan()
    assert (out.hashed, out.reused_baseline, out.unchanged, out.added + out.updated + out.deleted) == (0, 3, 3, 0)
    assert box.changes(2) == {} and box.files()[b"a.txt"]["metadata_from_scan_id"] == 1

    box.write("a.txt", "another length")
    os.rename(box.tree / "sub/b.txt", box.tree / "sub/moved.txt")
    out = box.scan()
    assert (out.updated, out.added, out.deleted, out.unchanged, out.hashed) == (1, 1, 1, 1, 2)
    assert box.changes(3) == {b"a.txt": ("updated", 11), b"sub/b.txt": ("deleted", 16), b"sub/moved.txt": ("added", 31)}
    dead = box.files()[b"sub/b.txt"]
    assert (dead["presence"], dead["deleted_in_scan_id"], dead["file_id"]) == ("deleted", 3, first[b"sub/b.txt"]["file_id"])

    box.write("sub/b.txt", "back again")
    out = box.scan()
    back = box.files()[b"sub/b.txt"]
    assert (out.added, back["presence"], back["deleted_in_scan_id"], back["file_id"], back["metadata_from_scan_id"]) == (1, "present", None, dead["file_id"], 4)
    old = box.table("changes").filter("scan_id = 4").first()
    assert (old["old_size_bytes"], old["new_size_bytes"]) == (9, 10)

    os.utime(box.tree / "a.txt", ns=(1, 5))
    assert box.scan().updated == 1
    assert box.changes(5) == {b"a.txt": ("updated", 2)}


def test_hidden_and_symlinks_and_policy(box):
    box.write("visible.txt")
    box.write(".hidden.txt")
    box.write(".hiddendir/inside.txt")
    os.symlink(box.tree / "visible.txt", box.tree / "link.txt")
    os.symlink(box.tree / "nowhere", box.tree / "broken")
    out = box.scan()
    assert (out.staged, out.excluded_hidden, out.excluded_symlink) == (1, 2, 2)
    box.settings = replace(box.settings, skip_hidden=False)
    with pytest.raises(CatalogueError) as e:
        box.scan()
    assert e.value.code == 6 and box.presence(b"visible.txt") == "present"
    assert "skip_hidden" in box.table("bases").first()["last_error"]
    assert any(line.startswith("settings_that_differ = ") and "skip_hidden" in line for line in report.status_lines(box.spark, box.settings))


def test_followed_links_end_and_are_rows_of_their_own(box):
    box.settings = replace(box.settings, follow_symlinks=True)
    box.write("a/b/c/deep.txt")
    box.write("a/top.txt")
    os.symlink("../..", box.tree / "a/b/c/back")
    os.symlink(box.tree / "a/top.txt", box.tree / "link.txt")
    os.symlink(box.tree / "gone", box.tree / "broken")
    out = box.scan()
    assert {p for p in box.files()} >= {b"a/b/c/deep.txt", b"a/top.txt", b"link.txt"} and out.staged == 3
    assert box.table("errors").first()["error_code"] == "not_found"


def test_deep_tree(box):
    deep = "/".join(["d"] * 300)
    box.write(f"{deep}/bottom.txt")
    out = box.scan()
    assert (out.staged, out.unreadable_dirs) == (1, 0)


def test_unreadable_directory_shields_and_restores_silently(box):
    for name in ("open/a.txt", "locked/b.txt", "lockedtoo/c.txt", "vanishing/d.txt"):
        box.write(name)
    box.scan()
    os.rename(box.tree / "lockedtoo", box.tree / "elsewhere")
    out = box.scan(code=7, walk_faults={"locked": "EACCES", "vanishing": "ENOENT"})
    assert (out.unreadable_dirs, out.unreadable, out.unreadable_paths, out.deleted) == (1, 1, 1, 2)
    assert [box.presence(p) for p in (b"locked/b.txt", b"lockedtoo/c.txt", b"vanishing/d.txt")] == ["unreadable", "deleted", "deleted"]
    assert b"locked/b.txt" not in box.changes(2)
    os.rename(box.tree / "elsewhere", box.tree / "lockedtoo")
    out = box.scan()
    assert box.presence(b"locked/b.txt") == "present" and b"locked/b.txt" not in box.changes(3) and out.hashed == 3
    assert box.files()[b"locked/b.txt"]["metadata_from_scan_id"] == 3


def test_unreadable_base_isnt_promoted(box):
    box.write("a.txt")
    box.scan()
    out = box.scan(code=1, walk_faults={"": "EACCES"})
    assert (out.status, box.presence(b"a.txt")) == ("partial", "present")
    scan = box.table("scans").filter("scan_id = 2").first()
    assert (scan["status"], scan["failure_code"]) == ("partial", "base_unreadable")
    out = box.scan()
    assert (out.resumed, out.scan_id, out.errors) == (True, 2, 0)


def test_stopped_scan_resumes(box):
    for i in range(40):
        box.write(f"f{i:03}.txt", str(i))
    box.settings = replace(box.settings, writer_batch_rows=10)
    asked = []
    out = box.scan(code=130, batches=1, cancelled=lambda: len(asked.append(1) or asked) > 3)
    assert out.status == "cancelled" and 0 < out.hashed < 40 and not box.files()
    os.unlink(box.tree / "f000.txt")
    again = box.scan(batches=1)
    assert again.resumed and again.scan_id == out.scan_id and again.staged == 39 and again.hashed < 40
    assert again.reused_stage + again.hashed == 39 and len(box.files()) == 39
    assert box.table("stage").isEmpty()


def test_low_space(box, monkeypatch):
    box.write("a.txt")
    free = iter([10**12, 0, 0, 0, 0])
    monkeypatch.setattr(Store, "free_bytes", lambda self: next(free))
    out = box.scan(code=5)
    assert (out.status, out.low_space) == ("partial", True) and box.table("scans").first()["failure_code"] == "low_space"
    monkeypatch.setattr(Store, "free_bytes", lambda self: 0)
    with pytest.raises(CatalogueError) as e:
        box.scan()
    assert e.value.code == 5


def test_bytes_in_names_and_odd_files(box):
    box.write("plain.txt")
    box.write(b"dir/od\xffd\xfename.txt")
    box.write("line\nbreak.txt")
    os.mkfifo(box.tree / "fifo")
    assert box.scan().staged == 3
    row = box.files()[b"dir/od\xffd\xfename.txt"]
    assert (row["name"], row["extension"]) == ("od�d�name.txt", "txt")
    assert box.scan().unchanged == 3


def test_hash_faults(box):
    for name in ("kept", "moved", "locked", "gone"):
        box.write(name)
    box.scan()
    for name in ("moved", "locked", "gone"):
        box.write(name, "longer")
    box.write("new")
    out = box.scan(hash_faults={"moved": "MOVED", "locked": "EACCES", "gone": "ENOENT", "new": "EACCES"})
    assert (out.changed_during_hash, out.errors, out.unreadable, out.deleted) == (1, 4, 1, 1)
    assert [box.presence(p) for p in (b"moved", b"locked", b"gone")] == ["present", "unreadable", "deleted"] and b"new" not in box.files()
    assert box.files()[b"moved"]["hash_status"] == "changed_during_hash"
    assert sorted(r["stage"] for r in box.table("errors").filter("scan_id = 2").collect()) == ["hash", "hash", "hash", "worker"]


def test_retention_and_several_bases(box, tmp_path, capsys, monkeypatch):
    box.write("a.txt")
    box.write("b.txt")
    other = tmp_path / "other"
    other.mkdir()
    (other / "z").write_text("z")
    I.ingest(box.spark, box.settings, other)
    box.scan()
    os.unlink(box.tree / "b.txt")
    for k in range(4):
        box.write("a.txt", "x" * (k + 5))
        box.scan()
    keep = replace(box.settings, keep_scans=2)
    store = Store(box.spark, box.settings.root)
    shown = I.prune(store, keep)
    assert [(r["cutoff"], r["changes"], r["files"]) for r in shown] == [(None, 0, 0), (5, 5, 1)]
    before = box.table("changes").count()
    assert I.prune(store, keep, apply=True) == shown
    assert box.table("changes").count() == before - 5 and b"b.txt" not in box.files() and b"z" in box.files()
    assert I.prune(store, keep)[1]["changes"] == 0
    box.settings = keep
    box.write("a.txt", "once more")
    assert box.scan().pruned_changes == 1


def test_catalogue_is_guarded(box, tmp_path):
    assert tomllib.loads("\n".join(report.status_lines(box.spark, box.settings)))["catalogue"]["exists"] is False and not box.settings.root.exists()
    box.settings.root.mkdir()
    (box.settings.root / "foreign.db").write_text("x")
    with pytest.raises(CatalogueError) as e:
        box.scan()
    assert e.value.code == 3
    (box.settings.root / "foreign.db").unlink()
    box.write("a")
    box.scan()
    store = Store(box.spark, box.settings.root)
    with store.writing():
        assert store.holder() == os.getpid()
        with pytest.raises(CatalogueError) as e:
            box.scan()
    assert e.value.code == 4 and store.holder() is None
    store.lock_file.write_text("999999999")
    box.scan()
    with pytest.raises(CatalogueError):
        I.ingest(box.spark, box.settings, tmp_path / "missing")
    assert box.table("bases").count() == 1
    version = store.manifest()["version"]
    report.status_lines(box.spark, box.settings)
    assert store.manifest()["version"] == version


def test_settings_files(tmp_path):
    system, user = tmp_path / "system.toml", tmp_path / "user.toml"
    system.write_text('[scan]\nworkers = 3\nskip_hidden = false\n[history]\nkeep_scans = 4\n')
    user.write_text('[scan]\nworkers = "auto"\n[storage]\ncatalogue_path = "~/c"\n')
    s = load([system, user, tmp_path / "absent"])
    assert (s.skip_hidden, s.keep_scans, 1 <= s.workers <= 4, s.root.name) == (False, 4, True, "c")
    for bad in ("[scan]\nworkes = 1\n", "[scan]\nworkers = 0\n", "[scan]\nskip_hidden = 1\n", "[scam]\n", "[scan", '[scan]\nhash_policy = "never"\n'):
        user.write_text(bad)
        with pytest.raises(CatalogueError) as e:
            load([user])
        assert e.value.code == 3


def test_commands(box, tmp_path, monkeypatch, capsys):
    home = tmp_path / "home"
    (home / ".config/snapledger").mkdir(parents=True)
    (home / ".config/snapledger/snapledger.toml").write_text(f'[scan]\nworkers = 1\n[storage]\ncatalogue_path = "{tmp_path}/cli"\nminimum_free_space_mib = 1\n')
    monkeypatch.setenv("HOME", str(home))
    assert main(["nonsense"], box.spark) == 2 and main(["history", "prune", "--now"], box.spark) == 2
    assert main(["history", "prune", "--apply"], box.spark) == 0 and not (tmp_path / "cli").exists()
    capsys.readouterr()
    box.write("a.txt")
    before = signal.getsignal(signal.SIGINT)
    assert main(["ingest", str(box.tree)], box.spark) == 0
    assert signal.getsignal(signal.SIGINT) is before
    assert main(["status"], box.spark) == 0
    out = capsys.readouterr().out
    ingested, status = (tomllib.loads("[" + part) for part in out.split("[", 1)[1].split("[settings]")[0:1] + ["settings]" + out.split("[settings]")[1]])
    assert (ingested["difference"], ingested["scan"]["outcome"]) == ({"added": 1, "updated": 0, "deleted": 0, "unchanged": 0, "present": 1}, "complete")
    assert status["folder"]["1"]["baseline"] == 1 and "unfinished" not in status["folder"]["1"]


def dirs(root):
    return {str(p.relative_to(root)) for top in ("bases", "scans", "files", "changes", "errors", "stage", "work") for p in (root / top).glob("*" if top == "work" else "*/*")}


def test_replaced_and_pruned_directories_are_removed(box):
    box.settings = replace(box.settings, keep_scans=1)
    store = Store(box.spark, box.settings.root)
    for k in range(3):
        box.write("a.txt", "x" * (k + 1))
        box.scan()
    named = {d for dirs_ in store.manifest()["tables"].values() for d in dirs_}
    assert dirs(store.root) > named  # young ones stay for readers
    assert not any(d.startswith("work/") for d in dirs(store.root))
    files = box.files()
    gone = store.sweep(grace=0)
    assert gone and dirs(store.root) == named and box.files() == files and len(list(store.manifests.glob("v*.json"))) == 1
    old = time.time() - 7200
    for p in [*store.manifests.glob("v*.json"), store.root / "work/crashed", store.root / "files/b1/crashed"]:
        if p.suffix != ".json":
            p.mkdir(parents=True)
        os.utime(p, (old, old))
    assert sorted(store.sweep()) == ["files/b1/crashed", "work/crashed"] and box.files() == files
    box.write("b.txt")
    assert box.scan().added == 1


def test_no_writer_undoes_what_another_published(box):
    box.write("a.txt")
    box.scan()
    store = Store(box.spark, box.settings.root)
    read = store.manifest()
    store.commit(errors=[])
    with pytest.raises(CatalogueError) as e:
        store.publish(read["tables"], read["version"])
    assert e.value.code == 4


def test_lock_ends_with_its_holder(box, tmp_path):
    box.write("a.txt")
    box.scan()
    store = Store(box.spark, box.settings.root)
    code = "import fcntl, os, sys, time; f = open(sys.argv[1], 'a+'); fcntl.flock(f, fcntl.LOCK_EX); f.truncate(0); f.write(str(os.getpid())); f.flush(); print('held', flush=True); time.sleep(600)"
    other = subprocess.Popen([sys.executable, "-c", code, str(store.lock_file)], stdout=subprocess.PIPE)
    try:
        other.stdout.readline()
        assert store.holder() == other.pid
        with pytest.raises(CatalogueError) as e:
            box.scan()
        assert e.value.code == 4
    finally:
        other.kill()
        other.wait()
    assert store.holder() is None and box.scan().unchanged == 1


def test_catalogue_of_the_working_directory_goes_first(box, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert box.settings.root == tmp_path / "store"
    (tmp_path / "snapledger-catalogue").mkdir()
    assert box.settings.root == tmp_path / "snapledger-catalogue"
    box.write("a.txt")
    box.scan()
    assert Store(box.spark, tmp_path / "snapledger-catalogue").exists() and not (tmp_path / "store").exists()


def test_tasks_pause_and_stop_at_the_floor(box, monkeypatch):
    """Rows after the batch that met the floor are left for the next attempt, which a look in between can't hide."""
    from snapledger.sources import hashing

    for i in range(30):
        box.write(f"f{i}", str(i))
    observed = box.spark.createDataFrame([(f"f{i}".encode(), 1 if i < 10 else 2, 0) for i in range(30)], "relative_path binary, size_bytes long, mtime_ns long")
    began = time.time()
    assert hashing.hashed(observed, os.fsencode(box.tree), least=1, batch=10, pause=0.4, disk=str(box.tree), floor=1).count() == 30 and time.time() - began > 1.1
    assert hashing.hashed(observed, os.fsencode(box.tree), least=1, batch=10, disk=str(box.tree), floor=1 << 62).count() == 10
    whole = hashing.hashed
    monkeypatch.setattr(I, "hashed", lambda *a: whole(*a[:3], 1, 10, 0.0, a[6], 1 << 62))
    out = box.scan(code=5)
    assert (out.status, out.low_space, out.hashed) == ("partial", True, 10)
    monkeypatch.setattr(I, "hashed", whole)
    again = box.scan()
    assert (again.resumed, again.reused_stage, again.hashed, again.staged) == (True, 10, 20, 30)


def test_birth_time_and_progress(box):
    began = time.time_ns()
    box.write("a.txt")
    box.write("b.txt")
    seen = []
    box.scan(progress=lambda *a: seen.append(a))
    assert seen == [(2, 2, 0)]
    for r in box.files().values():
        assert r["created_ns"] is None or abs(r["created_ns"] - began) < 60 * 10**9

    class Terminal(list):
        write, flush, isatty = list.append, lambda self: None, lambda self: True

    out = Terminal()
    meter = report.Meter(out, every=0)
    meter(10, 5, 20)
    meter(50, 30, 20)
    meter.close()
    assert "5 of 10 files, about 25 %" in out[0] and "%" not in out[1] and len(out) == 3


def test_mounts_are_left_out_by_device(box, monkeypatch):
    """What lies on another device is skipped and counted, file or folder, unless mounts are crossed."""
    from snapledger.sources.tree import Walk

    for name in ("own/a", "far/b", "c"):
        box.write(name)
    for skip, paths, skips in ((True, {b"c", b"own/a"}, 1), (False, {b"c", b"own/a", b"far/b"}, 0)):
        walk = Walk(os.fsencode(box.tree), skip_mount_boundaries=skip, devices={"far": 99})
        rows = list(walk.rows(b""))
        assert {r[1] for r in rows if r[0] == "file"} == paths and sum(r[8] == "mount" for r in rows) == skips
    walk = Walk(os.fsencode(box.tree), devices={"c": 99})
    assert [r[8] for r in walk.rows(b"") if r[0] == "skip"] == ["mount"]
