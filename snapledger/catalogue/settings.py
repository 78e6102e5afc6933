"""Settings from a system file with a user file over it, key by key."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from ..functions import domain as D


class CatalogueError(Exception):
    """Something that ends a command, with its exit code."""

    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


#: Settings that a file may have, and their types.
KEYS: dict[str, dict[str, type | tuple]] = {
    "scan": {"workers": (int, str), "writer_batch_rows": (int, str), "throttle_ms_after_batch": int, "hash_policy": str, "skip_hidden": bool, "skip_mount_boundaries": bool, "follow_symlinks": bool},
    "storage": {"catalogue_path": str, "minimum_free_space_mib": int},
    "history": {"keep_scans": int},
}
#: A catalogue of this name in the working directory goes before the one that is set.
LOCAL = "snapledger-catalogue"
SYSTEM_FILE = Path("/etc/xdg/snapledger/snapledger.toml")


def candidates() -> list[Path]:
    home = os.environ.get("HOME")
    return [SYSTEM_FILE] + ([Path(home, ".config/snapledger/snapledger.toml")] if home else [])


@dataclass(frozen=True)
class Settings:
    workers: int = field(default_factory=lambda: min(4, max(1, (os.cpu_count() or 1) // 2)))
    writer_batch_rows: int = 1000
    throttle_ms_after_batch: int = 0
    hash_policy: str = D.HASH_POLICY
    skip_hidden: bool = True
    skip_mount_boundaries: bool = True
    follow_symlinks: bool = False
    catalogue_path: str = "~/.local/share/snapledger/catalogue"
    minimum_free_space_mib: int = 500
    keep_scans: int = 0

    @property
    def policy(self) -> dict[str, bool]:
        return {name: getattr(self, name) for name in D.POLICY}

    @property
    def floor(self) -> int:
        return self.minimum_free_space_mib << 20

    @property
    def root(self) -> Path:
        """The folder LOCAL where commands are run, if there is one; else the one that is set."""
        own = Path.cwd() / LOCAL
        return own if own.exists() else Path(self.catalogue_path).expanduser()


def _checked(path: Path) -> dict:
    try:
        found = tomllib.loads(path.read_text())
    except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError) as e:
        raise CatalogueError(D.EXIT_CONFIG, f"{path}: {e}") from e
    out = {}
    for section, values in found.items():
        if section not in KEYS or not isinstance(values, dict):
            raise CatalogueError(D.EXIT_CONFIG, f"{path}: unknown section {section}")
        for key, value in values.items():
            kind = KEYS[section].get(key)
            if kind is None:
                raise CatalogueError(D.EXIT_CONFIG, f"{path}: unknown key {section}.{key}")
            if not isinstance(value, kind) or (isinstance(value, bool) and kind is not bool) or (isinstance(value, int) and value < 0):
                raise CatalogueError(D.EXIT_CONFIG, f"{path}: {section}.{key} has a wrong value")
            out[key] = value
    return out


def load(files: list[Path] | None = None) -> Settings:
    """Later files go over earlier ones; a file that is there but can't be read or has an unknown key is an error."""
    values: dict = {}
    for path in candidates() if files is None else files:
        if path.exists():
            values |= _checked(path)
    for key in ("workers", "writer_batch_rows"):
        if values.get(key) == "auto":
            del values[key]
        elif key in values and (isinstance(values[key], str) or values[key] < 1):
            raise CatalogueError(D.EXIT_CONFIG, f"{key}: a positive number or auto")
    if values.get("hash_policy", D.HASH_POLICY) != D.HASH_POLICY:
        raise CatalogueError(D.EXIT_CONFIG, f"scan.hash_policy: unknown policy {values['hash_policy']}")
    return Settings(**values)
