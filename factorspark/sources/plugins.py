"""Extension datasets: a manifest that declares fields and their clocks, checks, and scans."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from datetime import time
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DataError
from ..plans.model import Basis, FieldSpec
from .bars import among

#: Declared types and their Spark types; those that may enter expressions; the decision clock.
TYPES = {"bool": T.BooleanType(), "float32": T.FloatType(), "float64": T.DoubleType(), "int32": T.IntegerType(), "int64": T.LongType(), "string": T.StringType()}
NUMERIC = ("float32", "float64", "int32", "int64")
CLOCK = time(15, 0)


@dataclass(frozen=True)
class DeclaredField:
    name: str
    dtype: str
    unit: str = "ratio"
    basis: str | None = None
    day_offset: int = 0
    local_time: str = "15:00:00"

    def usable(self) -> bool:
        """Whether a signal of the same day's close may read it."""
        return self.dtype in NUMERIC and (self.day_offset < 0 or (self.day_offset == 0 and time.fromisoformat(self.local_time) <= CLOCK))


@dataclass(frozen=True)
class Manifest:
    dataset: str
    version: str
    keys: tuple[str, str]
    paths: tuple[str, ...]
    fields: tuple[DeclaredField, ...]
    rows: int | None = None
    start: str | None = None
    end: str | None = None
    content_hash: str | None = None

    def specs(self) -> tuple[FieldSpec, ...]:
        return tuple(FieldSpec(f.name, unit=f.unit, basis=Basis(f.basis) if f.basis else None) for f in self.fields if f.usable())


def load_manifest(path: str | Path) -> Manifest:
    import yaml

    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(raw, dict) or not {"dataset", "version", "keys", "paths", "fields"} <= raw.keys():
        raise DataError(f"{path} is no dataset manifest")
    fields = tuple(DeclaredField(**f) for f in raw["fields"])
    unknown = [f.name for f in fields if f.dtype not in TYPES]
    if unknown:
        raise DataError(f"fields of unsupported types: {unknown}")
    root = Path(path).parent
    paths = tuple(str(p) if "://" in str(p) or Path(p).is_absolute() else str(root / p) for p in raw["paths"])
    return Manifest(raw["dataset"], str(raw["version"]), tuple(raw["keys"]), paths, fields, raw.get("rows"), raw.get("start"), raw.get("end"), raw.get("content_hash"))


def save_manifest(m: Manifest, path: str | Path) -> None:
    import yaml

    body = {"dataset": m.dataset, "version": m.version, "keys": list(m.keys), "paths": list(m.paths), "fields": [vars(f) for f in m.fields], "rows": m.rows, "start": m.start, "end": m.end, "content_hash": m.content_hash}
    Path(path).write_text(yaml.safe_dump(body, sort_keys=True), encoding="utf-8")


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Hash of a set of files, whatever their order and names: digests are taken where the files are read."""
    files = reduce(DataFrame.unionByName, [spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p) for p in paths])
    digests = sorted(r["h"] for r in files.select(F.sha2("content", 256).alias("h")).collect())  # a row a file
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def scan(spark: SparkSession, m: Manifest, fields: list[str] | None = None, start: str | None = None, end: str | None = None, codes: list | None = None) -> DataFrame:
    """(code, date, fields): columns pruned and filters pushed to the files."""
    df = spark.read.parquet(*m.paths)
    code, date = m.keys
    if start is not None:
        df = df.filter(F.col(date) >= F.lit(start).cast(df.schema[date].dataType))
    if end is not None:
        df = df.filter(F.col(date) <= F.lit(end).cast(df.schema[date].dataType))
    if codes is not None:
        df = among(df, code, codes)
    return df.select(F.col(code).alias("code"), F.to_date(date).alias("date"), *(fields or [f.name for f in m.fields]))


def validate(spark: SparkSession, m: Manifest) -> dict:
    """Check files against the manifest; the report's status is PASS or FAIL with reasons."""
    df = spark.read.parquet(*m.paths)
    reasons = []
    for f in m.fields:
        if f.name not in df.columns:
            reasons.append(f"missing field {f.name}")
        elif df.schema[f.name].dataType != TYPES[f.dtype]:
            reasons.append(f"{f.name} is {df.schema[f.name].dataType.simpleString()}, declared {f.dtype}")
    missing = [k for k in m.keys if k not in df.columns]
    if missing:
        return {"status": "FAIL", "reasons": [*reasons, f"missing keys {missing}"]}
    if not isinstance(df.schema[m.keys[1]].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        reasons.append("the time key must be a date or a timestamp")
    n, lo, hi, nulls = df.agg(F.count("*"), F.min(m.keys[1]).cast("date").cast("string"), F.max(m.keys[1]).cast("date").cast("string"), F.count_if(F.col(m.keys[0]).isNull() | F.col(m.keys[1]).isNull())).first()
    if nulls:
        reasons.append(f"{nulls} rows without a key")
    if not df.groupBy(*m.keys).count().filter("count > 1").limit(1).isEmpty():
        reasons.append("keys repeat")
    if m.rows is not None and n != m.rows:
        reasons.append(f"{n} rows, declared {m.rows}")
    if (m.start is not None and lo is not None and lo > str(m.start)) or (m.end is not None and hi is not None and hi < str(m.end)):
        reasons.append(f"covers {lo} to {hi}, declared {m.start} to {m.end}")
    if m.content_hash is not None and fingerprint(spark, list(m.paths)) != m.content_hash:
        reasons.append("content differs from the declared hash")
    return {"status": "FAIL" if reasons else "PASS", "reasons": reasons, "rows": n, "start": lo, "end": hi}


def merge_sources(frames: list[DataFrame]) -> DataFrame:
    """Full outer join of sources on (code, date); a field may come from one source only."""
    names = [c for f in frames for c in f.columns if c not in ("code", "date")]
    if len(names) != len(set(names)):
        raise DataError("two sources give the same field")
    return reduce(lambda a, b: a.join(b, ["code", "date"], "full_outer"), frames)
