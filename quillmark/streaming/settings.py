"""Settings that change while a stream runs.

A settings document is read before each batch, whole, from a path that Spark can read. One that cannot be read or understood leaves the
last good one in force, which is kept beside the stream's output, so that a restart finds it too. A batch works with one snapshot: its
passes make the plan, its version stands on every row. Passes that cannot be built are reported when the set of them changes.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events, passes


def _labels(listed: list[dict], kind: str) -> tuple[tuple[str, str], ...]:
    if kind == "entity":
        return tuple((x["label"], x.get("description") or "") for x in listed if x.get("label"))
    return tuple((x.get("id") or "", x.get("text") or "") for x in listed)


def pass_of(x: dict[str, Any]) -> passes.CustomPass:
    """A pass as a settings document states it."""
    kind, subsets = x.get("kind") or "", x.get("labels_by_cond") or {}
    hints = tuple((y.get("text") or y.get("id"), y["description"]) for y in x.get("labels") or [] if y.get("description")) if kind != "entity" else ()
    return passes.CustomPass(
        x.get("key") or "", kind, _labels(x.get("labels") or [], kind), x.get("title") or "", x.get("version") or None, x.get("cls_threshold"),
        x.get("condition_on") or None, tuple((k, _labels(v, kind)) for k, v in sorted(subsets.items())), bool(x.get("is_system")), hints,
    )


@dataclass(frozen=True)
class Settings:
    """What a batch works with. version: a digest of the document."""

    version: str
    customs: tuple[passes.CustomPass, ...] = ()
    rejected: tuple[tuple[str, str], ...] = ()
    include_entity_text: bool = False
    telemetry: dict[str, Any] = field(default_factory=dict)

    @staticmethod
    def parse(text: str) -> Settings:
        import hashlib

        read = json.loads(text)
        if not isinstance(read, dict):
            raise ValueError("a settings document is an object")
        listed = ((read.get("enrichment_schema") or {}).get("passes") or {}).values()
        kept, why = passes.screen([pass_of(x) for x in listed])
        told = {k: v for k, v in (read.get("client_telemetry") or {}).items() if v is not None}
        plain = json.dumps(read, sort_keys=True)  # however it is laid out
        return Settings(hashlib.sha256(plain.encode()).hexdigest()[:16], tuple(sorted(kept, key=lambda p: p.key)), tuple(sorted(why.items())), bool(read.get("include_entity_text")), told)

    def gated(self, rows: DataFrame, key: str = "event_id") -> DataFrame:
        """Client events as the document's telemetry lets them pass."""
        t = self.telemetry
        return events.gate(rows, t.get("min_severity", "info"), float(t.get("sample_rate", 1.0)), bool(t.get("enabled", True)), key)


@dataclass
class Holder:
    """Reads the document at `path`; `kept`: where the last good one is written."""

    path: str
    kept: str
    reported: str = ""

    def _text(self, spark: SparkSession, path: str) -> str:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        stream = fs.open(where)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _keep(self, spark: SparkSession, text: str) -> None:
        where = spark._jvm.org.apache.hadoop.fs.Path(self.kept)
        out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def snapshot(self, spark: SparkSession) -> Settings:
        """The document as it is now; else the last good one; else none at all."""
        try:
            text = self._text(spark, self.path)
            found = Settings.parse(text)
            self._keep(spark, text)
            return found
        except Exception:  # noqa: BLE001  whatever is wrong with it, it is not taken
            pass
        try:
            return Settings.parse(self._text(spark, self.kept))
        except Exception:  # noqa: BLE001
            return Settings("none")

    def news(self, found: Settings) -> list[tuple[str, str]]:
        """Rejected passes, if they are others than last time; their order does not matter."""
        digest = passes.rejects_digest(dict(found.rejected))
        changed, self.reported = digest != self.reported, digest
        return list(found.rejected) if changed else []


def enriched(rows: DataFrame, holder: Holder, write: Callable[[DataFrame, int], None], backend: passes.Backend | None = None, keep: list[str] | None = None, reject: Callable[[str, str], None] | None = None, gating: bool = True):
    """A writer whose batches are profiled by the passes in force when they begin; write takes the profiles (with `settings_version`)."""

    def batch(part: DataFrame, i: int) -> None:
        now = holder.snapshot(part.sparkSession)
        for key, reason in holder.news(now) if reject else []:
            reject(key, reason)
        write(passes.profiles(part, backend, gating, list(now.customs), keep).withColumn("settings_version", F.lit(now.version)), i)

    return rows.writeStream.foreachBatch(batch)
