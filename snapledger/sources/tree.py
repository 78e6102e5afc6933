"""A directory tree as a table: a Python data source that lists files and says which paths it could not read.

Options: path (of the tree), skip_hidden, skip_mount_boundaries, follow_symlinks (true or false), partitions, and
for tests faults, a JSON object of error names by path that are raised instead of reading, and devices, one of device numbers by path.

Rows have a ``kind``: ``file``, ``error`` or ``skip``. The tree is cut into subtrees that tasks list independently; when
links are followed a task must know all directories that were visited, so there is one task.
"""

from __future__ import annotations

import base64
import ctypes
import errno
import json
import os
import stat
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import domain as D

SCHEMA = "kind string, relative_path binary, size_bytes long, mtime_ns long, created_ns long, code string, message string, listing boolean, reason string, n long"
#: Longest message, in bytes.
MESSAGE_BYTES = 300
#: Directories that the driver lists at most to find subtrees for the tasks.
SPLIT_LISTINGS = 256


def classify(e: OSError) -> str:
    """The catalogue's code of an error."""
    if e.errno in (errno.EMFILE, errno.ENFILE):
        return D.EXHAUSTED
    if e.errno == errno.ENOENT:
        return D.NOT_FOUND
    if e.errno in (errno.EACCES, errno.EPERM):
        return D.NO_PERMISSION
    if e.errno == errno.EILSEQ:
        return D.BAD_DATA
    return D.IO_ERROR


def shortened(message: str) -> str:
    data = message.encode("utf-8", "replace")
    return message if len(data) <= MESSAGE_BYTES else data[:MESSAGE_BYTES].decode("utf-8", "ignore") + "…"


class _Statx(ctypes.Structure):
    """The system's struct statx, up to the birth time."""

    _fields_ = [("mask", ctypes.c_uint32), ("_a", ctypes.c_uint8 * 76), ("born_s", ctypes.c_int64), ("born_ns", ctypes.c_uint32), ("_b", ctypes.c_uint8 * 164)]


BIRTH, NO_FOLLOW, HERE = 0x800, 0x100, -100


def born_ns(path: bytes, about: os.stat_result, follow: bool) -> int | None:
    """When a file was made, in nanoseconds; None where the system or the file system doesn't say, or before 1970."""
    found = getattr(about, "st_birthtime_ns", None)
    if found is None:
        try:
            call = ctypes.CDLL(None, use_errno=True).statx
        except AttributeError:
            return None
        out = _Statx()
        if call(HERE, ctypes.c_char_p(path), 0 if follow else NO_FOLLOW, BIRTH, ctypes.byref(out)) or not out.mask & BIRTH:
            return None
        found = out.born_s * 1_000_000_000 + out.born_ns
    return found if found >= 0 else None


class Walk:
    """Lists a tree below a root, with one directory open at a time. The empty relative path is the root itself."""

    def __init__(self, root: bytes, skip_hidden=True, skip_mount_boundaries=True, follow_symlinks=False, faults=None, devices=None):
        self.root, self.skip_hidden, self.one_device, self.follow = root, skip_hidden, skip_mount_boundaries, follow_symlinks
        self.faults = {os.fsencode(k): v for k, v in (faults or {}).items()}
        self.devices = {os.fsencode(k): v for k, v in (devices or {}).items()}
        self.device: int | None = None
        self.visited: set[tuple[int, int]] = set()

    def _check(self, rel: bytes) -> None:
        if rel in self.faults:
            number = getattr(errno, self.faults[rel])
            raise OSError(number, os.strerror(number))

    def _error(self, rel: bytes, e: OSError, listing: bool = False) -> tuple:
        return ("error", rel, None, None, None, classify(e), shortened(e.strerror or str(e)), listing, None, 1)

    @staticmethod
    def _skipped(reason: str) -> tuple:
        return ("skip", None, None, None, None, None, None, None, reason, 1)

    def start(self) -> None:
        if self.device is None:
            self.device = os.stat(self.root).st_dev

    def listing(self, rel: bytes) -> tuple[list[tuple], list[bytes]]:
        """Rows of one directory, and the directories below it that are to be listed."""
        rows: list[tuple] = []
        below: list[bytes] = []
        try:
            self._check(rel)
            self.start()
            with os.scandir(os.path.join(self.root, rel) if rel else self.root) as found:
                entries = sorted(found, key=lambda e: e.name)
        except OSError as e:
            return [self._error(rel, e, True)], []
        for entry in entries:
            own = os.path.join(rel, entry.name)
            if self.skip_hidden and entry.name.startswith(b"."):
                rows.append(self._skipped("hidden"))
                continue
            try:
                self._check(own + b"!")  # a fault of the entry itself, not of listing or reading it
                if entry.is_symlink():
                    if not self.follow:
                        rows.append(self._skipped("symlink"))
                        continue
                    about = os.stat(os.path.join(self.root, own))
                else:
                    about = entry.stat(follow_symlinks=False)
            except OSError as e:
                rows.append(self._error(own, e))
                continue
            if not (stat.S_ISDIR(about.st_mode) or stat.S_ISREG(about.st_mode)):
                continue
            if self.one_device and self.devices.get(own, about.st_dev) != self.device:
                rows.append(self._skipped("mount"))
            elif stat.S_ISREG(about.st_mode):
                born = born_ns(os.path.join(self.root, own), about, entry.is_symlink())
                rows.append(("file", own, about.st_size, max(0, about.st_mtime_ns), born, None, None, None, None, 1))
            elif not self.follow:
                below.append(own)
            elif (about.st_dev, about.st_ino) not in self.visited:
                self.visited.add((about.st_dev, about.st_ino))
                below.append(own)
        return rows, below

    def rows(self, rel: bytes) -> Iterator[tuple]:
        """Rows of a whole subtree; directories wait on a list, so depth costs no open handles."""
        waiting = [rel]
        while waiting:
            rows, below = self.listing(waiting.pop())
            yield from rows
            waiting.extend(reversed(below))


class Subtrees(InputPartition):
    def __init__(self, roots: list[bytes], rows: list[tuple]):
        self.roots, self.rows = roots, rows


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        flag = lambda k, default: options.get(k, default).lower() == "true"
        path = options["path_base64"] if "path_base64" in options else base64.b64encode(os.fsencode(options["path"])).decode()
        self.root = base64.b64decode(path)
        self.settings = {
            "skip_hidden": flag("skip_hidden", "true"), "skip_mount_boundaries": flag("skip_mount_boundaries", "true"), "follow_symlinks": flag("follow_symlinks", "false"),
            "faults": json.loads(options.get("faults", "{}")), "devices": json.loads(options.get("devices", "{}")),
        }
        self.wanted = int(options.get("partitions", "8"))

    def partitions(self) -> list[Subtrees]:
        if self.settings["follow_symlinks"]:
            return [Subtrees([b""], [])]
        walk, roots, rows, listed = Walk(self.root, **self.settings), [b""], [], 0
        while roots and len(roots) < 4 * self.wanted and listed < SPLIT_LISTINGS:
            own, below = walk.listing(roots.pop(0))
            listed += 1
            rows += own
            roots += below
        parts = [Subtrees(roots[i :: self.wanted], []) for i in range(min(self.wanted, len(roots)))]
        return [Subtrees([], rows), *parts]

    def read(self, partition: Subtrees) -> Iterator[tuple]:
        yield from partition.rows
        for root in partition.roots:
            walk = Walk(self.root, **self.settings)
            try:
                walk.start()
            except OSError as e:
                yield walk._error(b"", e, True)
                continue
            yield from walk.rows(root)


class Tree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "snapledger_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))
