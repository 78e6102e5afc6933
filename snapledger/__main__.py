"""Commands: ingest PATH, status, history prune [--apply]."""

from __future__ import annotations

import signal
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .catalogue import ingest as I
from .catalogue import report, settings
from .catalogue.store import Store
from .functions import domain as D


def main(args: list[str], spark: SparkSession | None = None) -> int:
    session = lambda: spark or SparkSession.builder.appName("snapledger").getOrCreate()
    try:
        match args:
            case ["ingest", base]:
                own, stopped = settings.load(), []
                before = signal.signal(signal.SIGINT, lambda *_: stopped.append(1))
                meter = report.Meter()
                try:
                    out = I.ingest(session(), own, base, cancelled=lambda: bool(stopped), progress=meter)
                finally:
                    meter.close()
                    signal.signal(signal.SIGINT, before)
                print("\n".join(report.scan_lines(own.root, Path(base).resolve(), own, out)))
                return out.exit_code
            case ["status"]:
                print("\n".join(report.status_lines(session(), settings.load())))
                return D.EXIT_OK
            case ["history", "prune", *rest] if rest in ([], ["--apply"]):
                own, apply = settings.load(), bool(rest)
                store = Store(session(), own.root)
                if not store.exists():
                    print("\n".join(report.prune_lines(own.root, own, [], apply)))
                    return D.EXIT_OK
                store.open()
                if apply:
                    with store.writing():
                        found = I.prune(store, own, apply=True)
                        store.sweep()
                else:
                    found = I.prune(store, own)
                print("\n".join(report.prune_lines(own.root, own, found, apply)))
                return D.EXIT_OK
        print("usage: snapledger ingest PATH | status | history prune [--apply]", file=sys.stderr)
        return D.EXIT_USAGE
    except settings.CatalogueError as e:
        print(f"error: {e}", file=sys.stderr)
        return e.code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
