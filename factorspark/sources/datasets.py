"""Dataset manifests in JSON, and receipts that spare a second validation of unchanged files."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from datetime import datetime, timezone
from enum import Enum
from pathlib import Path

from pyspark.sql import SparkSession

from ..artifacts import identity, reuse, store, write_json
from ..errors import DataError
from .plugins import Manifest, save_manifest, validate


class Status(str, Enum):
    PASS = "PASS"
    QUARANTINE = "QUARANTINE"
    FAIL = "FAIL"


@dataclass(frozen=True)
class DatasetManifest:
    dataset: str
    version: str
    schema_hash: str
    content_hash: str
    status: Status
    rows: int
    ingested_at: str
    parents: tuple[str, ...] = ()
    issues: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.status is Status.PASS and self.issues:
            raise DataError("a dataset that passes has no issues")
        if datetime.fromisoformat(self.ingested_at).tzinfo is None:
            raise DataError("ingested_at needs a time zone")
        object.__setattr__(self, "ingested_at", datetime.fromisoformat(self.ingested_at).astimezone(timezone.utc).isoformat())


def write_manifest(path: str | Path, m: DatasetManifest) -> None:
    write_json(path, asdict(m) | {"status": m.status.value})


def read_manifest(path: str | Path) -> DatasetManifest:
    raw = json.loads(Path(path).read_text(encoding="utf-8"))
    return DatasetManifest(**(raw | {"status": Status(raw["status"]), "parents": tuple(raw["parents"]), "issues": tuple(raw["issues"])}))


def _signature(path: str) -> list:
    """Names, sizes and times of the files below a local path."""
    root = Path(path.removeprefix("file://"))
    files = [root] if root.is_file() else sorted(p for p in root.rglob("*") if p.is_file())
    return [(str(p.relative_to(root.parent)), p.stat().st_size, p.stat().st_mtime_ns) for p in files]


def validate_once(spark: SparkSession, m: Manifest, cache: str | Path) -> dict:
    """``validate``, or the stored receipt of an earlier one if neither manifest nor files have changed since.

    Files whose state cannot be seen from the driver (any scheme but file) are always validated.
    """
    if any("://" in p and not p.startswith("file://") for p in m.paths):
        return validate(spark, m)
    own = identity([asdict(m), [_signature(p) for p in m.paths]])
    path = Path(cache) / f"{own}.json"
    found = reuse(path, own)
    return found["report"] | {"reused": True} if found else store(path, own, {"report": validate(spark, m)})["report"] | {"reused": False}


def export(spark: SparkSession, m: Manifest, path: str | Path) -> dict:
    """Write the dataset's manifest where its files pass; the report says why not."""
    report = validate(spark, m)
    if report["status"] == "PASS":
        save_manifest(m, path)
    return report
