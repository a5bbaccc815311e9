"""Small parts around the engine: rate limits, caches, backups, external resolvers, build stamps (UI-04..06, SR-17, SF-31)."""

from __future__ import annotations

import json
import time
from collections import OrderedDict
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BACKUP_SCHEMA, BACKUP_VERSION = "klangwerk-backup", 1
MOST_BARS, MOST_BAR_CHARS, MOST_BACKUP_CHARS = 5000, 4000, 8_000_000


class RateLimiter:
    """UI-05: a bucket of ``capacity`` requests for each key, refilled by ``per_second``.  Keys idle for long, then the oldest,
    are forgotten beyond ``most`` of them."""

    def __init__(self, capacity: float = 16, per_second: float = 8, most: int = 4096, idle: float = 120.0, now: Callable[[], float] = time.monotonic):
        self.capacity, self.per_second, self.most, self.idle, self.now = capacity, per_second, most, idle, now
        self.buckets: OrderedDict[str, tuple[float, float]] = OrderedDict()

    def take(self, key: str, cost: float = 1.0) -> tuple[bool, float]:
        """Whether a request may pass, and the seconds until it might."""
        at = self.now()
        if key not in self.buckets and len(self.buckets) >= self.most:
            for k in [k for k, (_, t) in self.buckets.items() if at - t > self.idle]:
                del self.buckets[k]
            while len(self.buckets) >= self.most:
                self.buckets.popitem(last=False)
        left, since = self.buckets.pop(key, (self.capacity, at))
        left = min(self.capacity, left + (at - since) * self.per_second)
        passes = left >= cost
        self.buckets[key] = (left - cost if passes else left, at)
        return passes, 0.0 if passes else (cost - left) / self.per_second


class LastUsed:
    """UI-06: the results of the last ``most`` different keys; a failed load is not kept."""

    def __init__(self, most: int = 384):
        self.most, self.kept = max(8, min(4096, most)), OrderedDict()

    def get(self, key, load: Callable):
        """(value, whether it was kept)."""
        if key in self.kept:
            self.kept.move_to_end(key)
            return self.kept[key], True
        value = load()
        self.kept[key] = value
        if len(self.kept) > self.most:
            self.kept.popitem(last=False)
        return value, False


def export_backup(document: str, bars: Iterable[tuple[str, str]], preferences: dict | None = None) -> str:
    """UI-04: a document's bars (id, text) as one text."""
    rows = [{"id": i, "text": t} for i, t in bars]
    _check_bars(rows)
    return json.dumps({"schema": BACKUP_SCHEMA, "version": BACKUP_VERSION, "document": document, "bars": rows, "preferences": preferences or {}}, ensure_ascii=False, sort_keys=True)


def _check_bars(rows) -> None:
    if not isinstance(rows, list) or len(rows) > MOST_BARS or not all(isinstance(r, dict) and isinstance(r.get("text"), str) and len(r["text"]) <= MOST_BAR_CHARS and r.get("id") for r in rows):
        raise ValueError("the backup's bars are not within the limits")
    if len({r["id"] for r in rows}) != len(rows):
        raise ValueError("the backup names a bar twice")


def import_backup(text: str) -> dict:
    """UI-04: the checked content of a backup; an error names what is wrong."""
    if len(text) > MOST_BACKUP_CHARS:
        raise ValueError("the backup is too large")
    value = json.loads(text)
    if not isinstance(value, dict) or value.get("schema") != BACKUP_SCHEMA:
        raise ValueError("this is no backup")
    if value.get("version") != BACKUP_VERSION:
        raise ValueError(f"backup version {value.get('version')} is not supported")
    _check_bars(value.get("bars"))
    return {"document": str(value.get("document", "")), "bars": [(r["id"], r["text"]) for r in value["bars"]], "preferences": dict(value.get("preferences") or {})}


def resolved_by(df: DataFrame, column: str, resolver: Callable[[], Callable[[list[str]], list[str | None]]], name: str, batch: int = 500) -> DataFrame:
    """SR-17: adds what an outside tool says of each value (null for null).  ``resolver`` is called once a task and returns a
    function of up to ``batch`` different values, so a process or connection is opened once and asked in bulk."""
    from pyspark.sql.types import StringType, StructType

    at, schema = df.columns.index(column), StructType([*df.schema.fields]).add(name, StringType())

    def run(batches):
        import pyarrow as pa

        ask = None
        for b in batches:
            values = b.column(at).to_pylist()
            known, fresh = {None: None}, list(dict.fromkeys(v for v in values if v is not None))
            for k in range(0, len(fresh), batch):
                ask = ask or resolver()
                known.update(zip(fresh[k : k + batch], ask(fresh[k : k + batch]), strict=True))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([known[v] for v in values], pa.string())], [*b.schema.names, name])

    return df.mapInArrow(run, schema)


def build_stamp() -> Column:
    """SF-31: the time of a build as ISO 8601 in UTC."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def json_array(text: Column | str) -> Column:
    """SF-24: an array of strings from JSON; empty if it is none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def json_object(text: Column | str) -> Column:
    """SF-24: a map of strings from JSON; empty if it is none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
