"""Names, codes and schemas of the catalogue's tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the catalogue's format.
PRESENT, UNREADABLE, DELETED = "present", "unreadable", "deleted"
ADDED, UPDATED, REMOVED = "added", "updated", "deleted"
UNCHANGED, TOMBSTONE, HELD = "unchanged", "tombstone", "unreadable"
SIZE_BIT, MTIME_BIT, MIME_BIT, HASH_BIT, PRESENCE_BIT = 1, 2, 4, 8, 16
ALL_BITS = SIZE_BIT + MTIME_BIT + MIME_BIT + HASH_BIT + PRESENCE_BIT
RUNNING, COMPLETE, CANCELLED, PARTIAL, FAILED = "running", "complete", "cancelled", "partial", "failed"
RESUMABLE = (RUNNING, CANCELLED, FAILED, PARTIAL)
NOT_FOUND, NO_PERMISSION, BAD_DATA, IO_ERROR, EXHAUSTED = "not_found", "permission_denied", "invalid_data", "io_error", "resource_exhausted"
MOVED = "changed_during_hash"
#: A path with one of these has unknown contents; it isn't proof that anything is gone.
UNREADABLE_CODES = (NO_PERMISSION, IO_ERROR, BAD_DATA, EXHAUSTED)
HASH_COMPLETE = "complete"
HASH_ALGORITHM = "sha256"
HASH_POLICY = "reuse_when_metadata_matches"
EXIT_OK, EXIT_ERROR, EXIT_USAGE, EXIT_CONFIG, EXIT_BUSY, EXIT_SPACE, EXIT_POLICY, EXIT_INCOMPLETE, EXIT_CANCELLED = 0, 1, 2, 3, 4, 5, 6, 7, 130
POLICY = ("skip_hidden", "skip_mount_boundaries", "follow_symlinks")

_L, _S, _B, _Y = T.LongType(), T.StringType(), T.BinaryType(), T.BooleanType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_CONTENT = {
    "relative_path": _B, "parent_path": _S, "name": _S, "extension": _S, "size_bytes": _L, "mtime_ns": _L, "created_ns": _L, "mime_type": _S, "mime_source": _S,
    "hash_algorithm": _S, "content_hash": _B, "hash_status": _S,
}
BASES = _schema(base_id=_L, base_path=_S, created_at_ns=_L, last_complete_scan_id=_L, skip_hidden=_Y, skip_mount_boundaries=_Y, follow_symlinks=_Y, last_error=_S)
SCANS = _schema(
    scan_id=_L, base_id=_L, baseline_scan_id=_L, status=_S, started_at_ns=_L, finished_at_ns=_L, skip_hidden=_Y, skip_mount_boundaries=_Y, follow_symlinks=_Y,
    workers=_L, writer_batch_rows=_L, throttle_ms_after_batch=_L, hash_policy=_S, discovered_files=_L, discovered_bytes=_L, staged_files=_L, staged_bytes=_L,
    hashed_files=_L, hashed_bytes=_L, changed_during_hash=_L, added_count=_L, updated_count=_L, deleted_count=_L, unchanged_count=_L, error_count=_L,
    present_count=_L, excluded_hidden=_L, excluded_mount=_L, excluded_symlink=_L, unreadable_dirs=_L, free_bytes_before=_L, free_bytes_after=_L,
    required_free_bytes=_L, estimate_source=_S, duration_ms=_L, failure_code=_S, failure_message=_S,
)
FILES = _schema(file_id=_L, base_id=_L, **_CONTENT, presence=_S, metadata_from_scan_id=_L, deleted_in_scan_id=_L)
STAGE = _schema(scan_id=_L, base_id=_L, **_CONTENT, complete=_Y, chunk=_L)
CHANGES = _schema(
    scan_id=_L, base_id=_L, relative_path=_B, change_kind=_S, field_mask=_L, old_size_bytes=_L, new_size_bytes=_L, old_mtime_ns=_L, new_mtime_ns=_L,
    old_mime_type=_S, new_mime_type=_S, old_content_hash=_B, new_content_hash=_B,
)
ERRORS = _schema(scan_id=_L, relative_path=_B, stage=_S, error_code=_S, message=_S)
TABLES = {"bases": BASES, "scans": SCANS, "files": FILES, "changes": CHANGES, "errors": ERRORS}
