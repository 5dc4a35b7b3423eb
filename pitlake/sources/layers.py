"""Layered storage, raw payloads, canonical JSON, reports and requests."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import time
from collections.abc import Callable, Mapping, Sequence
from pathlib import PurePosixPath
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlake.sources import stores

LAYERS = ("raw", "bronze", "silver", "gold")


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def initialize(spark: SparkSession, root: str, databases: bool = False) -> dict[str, str]:
    """The folder of each layer, made where it is missing; with `databases` also a database for each but raw."""
    out = {}
    for layer in LAYERS:
        fs, where = _fs(spark, f"{root.rstrip('/')}/{layer}")
        fs.mkdirs(where)
        out[layer] = where.toString()
        if databases and layer != "raw":
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {layer} LOCATION '{out[layer]}'")
    return out


def write_raw(spark: SparkSession, root: str, relative: str, payload: bytes) -> str:
    """Write a payload once under root/raw; a path that leaves it, or exists, raises."""
    parts = PurePosixPath(relative)
    if parts.is_absolute() or ".." in parts.parts or not parts.parts:
        raise ValueError(f"not a path inside the raw layer: {relative!r}")
    fs, where = _fs(spark, f"{root.rstrip('/')}/raw/{parts}")
    if fs.exists(where):
        raise FileExistsError(str(parts))
    out = fs.create(where, False)
    try:
        out.write(bytearray(payload))
    finally:
        out.close()
    return where.toString()


def canonical_json(value: Any) -> bytes:
    """Compact JSON with sorted keys, the same bytes for equal values."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def canonical_column(columns: Sequence[str]) -> Column:
    """The same form for rows of flat columns, made without Python: sorted keys, nulls kept."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"})


def fingerprint(artifact: Mapping[str, Any], leave_out: tuple[str, ...] = ("certified_at",)) -> str:
    """The first 16 hex digits of the SHA-256 of an artifact without its time."""
    return hashlib.sha256(canonical_json({k: v for k, v in artifact.items() if k not in leave_out})).hexdigest()[:16]


def write_report(spark: SparkSession, path: str, report: Mapping[str, Any]) -> str:
    """A small report as indented JSON with sorted keys, replacing an older one."""
    fs, where = _fs(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(json.dumps(report, sort_keys=True, indent=2, ensure_ascii=False).encode() + b"\n"))
    finally:
        out.close()
    return path


def write_artifact(spark: SparkSession, folder: str, artifact: Mapping[str, Any]) -> str:
    """An artifact under the name of its fingerprint; one that is there already is left alone."""
    path = f"{folder.rstrip('/')}/{fingerprint(artifact)}.json"
    fs, where = _fs(spark, path)
    return path if fs.exists(where) else write_report(spark, path, artifact)


def request(season: int | None = None, start: dt.date | None = None, end: dt.date | None = None, first: int = 1876, this_year: int | None = None) -> dict[str, Any]:
    """Parameters of a schedule request: a season or a range of dates, never both."""
    if (season is None) == (start is None and end is None):
        raise ValueError("either a season or a range of dates")
    if season is not None:
        if isinstance(season, bool) or not first <= season <= (this_year or dt.date.today().year) + 1:
            raise ValueError(f"no such season: {season!r}")
        return {"season": season}
    if start is None or end is None or start > end:
        raise ValueError(f"not a range of dates: {start} to {end}")
    return {"startDate": start.isoformat(), "endDate": end.isoformat()}


class FetchError(Exception):
    """A request that failed, with its status where there is one."""

    def __init__(self, status: int | None = None):
        super().__init__(f"status {status}")
        self.status = status


def fetch(get: Callable[[], Any], retries: int = 3, backoff: float = 0.5, interval: float = 0.4, last: list[float] | None = None, sleep=time.sleep, clock=time.monotonic) -> Any:
    """get() at most every `interval` seconds, again after 0.5, 1, 2 ... seconds where it fails; a client error but 429 isn't tried again."""
    last = last if last is not None else []
    for attempt in range(retries + 1):
        if last and (wait := interval - (clock() - last[-1])) > 0:
            sleep(wait)
        last[:] = [clock()]
        try:
            return get()
        except FetchError as e:
            if attempt == retries or (e.status is not None and 400 <= e.status < 500 and e.status != 429):
                raise
            sleep(backoff * 2**attempt)


def flatten(df: DataFrame, joint: str = "_") -> DataFrame:
    """Struct columns replaced by their fields, at any depth."""
    while any(isinstance(f.dataType, T.StructType) for f in df.schema.fields):
        out = []
        for f in df.schema.fields:
            if isinstance(f.dataType, T.StructType):
                out += [df[f.name][s.name].alias(f"{f.name}{joint}{s.name}") for s in f.dataType.fields]
            else:
                out.append(df[f.name])
        df = df.select(*out)
    return df


def ingest(spark: SparkSession, root: str, relative: str, payload: bytes, parse: Callable[[DataFrame], DataFrame], store: str, key: list[str], published: str | None = None) -> dict[str, Any]:
    """One payload into a store: its hash is compared with the published one, the bytes kept once, the rows appended by key.

    A payload that is kept already isn't written again; rows that are stored with other content raise before anything is appended.
    """
    sha = hashlib.sha256(payload).hexdigest()
    if published is not None and sha != published:
        raise ValueError(f"payload {sha} isn't the published {published}")
    fs, where = _fs(spark, f"{root.rstrip('/')}/raw/{relative}")
    if not fs.exists(where):
        write_raw(spark, root, relative, payload)
    rows = parse(spark.createDataFrame([(payload.decode(),)], "payload string"))
    return {"sha256": sha} | stores.append_new(rows, store, key)
