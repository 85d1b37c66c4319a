"""Releases: immutable snapshots under a key, with status events and an ACTIVE reader.

A store is a folder that all executors see. A release is a list of parts, folders of rows that are
written once, under a path of their own, and never touched again. What happened stands in events,
one numbered file each, that are created only if absent: of several writers one gets the next number,
the others read again what has changed and decide anew. Which release is ACTIVE follows from the
events (the newest activation wins, earlier ones are SUPERSEDED), so a flip is one small file and a
failed load leaves the ACTIVE release, and every older one, as it is.

A release can grow by a part: only the new rows are written. Its fingerprint is that of all its rows
and is added up from those of its parts. ``compact`` writes many small parts as one, apart from
publishing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placemetrics.functions.hashing import fingerprint_of, multiset_sums
from placemetrics.sources import files

PART = T.StructType([T.StructField("path", T.StringType()), T.StructField("row_count", T.LongType()), T.StructField("sums", T.ArrayType(T.StringType()))])
EVENTS = T.StructType([
    T.StructField("seq", T.LongType(), False), T.StructField("release_key", T.StringType(), False), T.StructField("event", T.StringType(), False),
    T.StructField("parts", T.ArrayType(PART)), T.StructField("row_count", T.LongType()), T.StructField("reason", T.StringType()),
    T.StructField("increment", T.StringType())])

#: Column that names the increment of a row of a grown release.
INCREMENT = "increment_key"


class Unavailable(LookupError):
    """There is no ACTIVE release; an empty result would be a different statement."""


class PublishFailed(RuntimeError):
    """The load was recorded as FAILED and the ACTIVE release was left alone."""


class Store:
    """One named release line (panel, scores, rent, ...) inside a shared folder."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.base = spark, f"{root.rstrip('/')}/{name}"

    def events(self) -> DataFrame:
        if not files.exists(self.spark, f"{self.base}/events"):
            return self.spark.createDataFrame([], EVENTS)
        return self.spark.read.schema(EVENTS).json(f"{self.base}/events")

    def releases(self) -> DataFrame:
        """One row per release: current status, parts, rows, reason."""
        return release_status(self.events())

    def _top(self) -> int:
        top = self.events().agg(F.max("seq")).first()[0]
        return -1 if top is None else top

    def _commit(self, seq: int, key: str, event: str, parts: Sequence[dict] | None = None, rows: int | None = None, reason: str | None = None, increment: str | None = None) -> bool:
        """Record an event under this number; false if another writer has taken it."""
        row = {"seq": seq, "release_key": key, "event": event, "parts": parts, "row_count": rows, "reason": reason, "increment": increment}
        return files.create_once(self.spark, f"{self.base}/events/{seq:020d}.json", json.dumps(row) + "\n")

    def _record(self, key: str, event: str, parts: Sequence[dict], reason: str | None = None) -> None:
        """Record an event that holds whatever others do."""
        while not self._commit(self._top() + 1, key, event, parts, None, reason):
            pass

    def status(self, key: str) -> str | None:
        row = self.releases().where(F.col("release_key") == key).select("status").first()
        return row[0] if row else None

    def _write(self, df: DataFrame, key: str) -> str:
        path = f"{self.base}/data/{key}/{uuid.uuid4().hex}"
        df.write.mode("error").parquet(path)
        return path

    def publish(self, df: DataFrame, key: str, verify: Callable[[DataFrame], Sequence[str]] | None = None,
                reactivate: bool = False, sort_by: Sequence[str] = ()) -> str:
        """Write under a key, read back, verify, activate. Returns the outcome.

        The same key ACTIVE is a no-op; SUPERSEDED may be reactivated; PENDING or FAILED is
        loaded again. ``verify`` gets the rows as written and returns what is wrong with them.
        Every load writes to a path of its own, so what an older event names stays as it was.
        """
        part = None
        while True:
            top, now = self._top(), self.releases().where(F.col("release_key") == key).first()
            status = now["status"] if now else None
            if status == "ACTIVE":
                if part:  # another writer was first
                    files.delete(self.spark, part["path"])
                return "ALREADY_ACTIVE"
            if part is None and reactivate and status == "SUPERSEDED":
                if self._commit(top + 1, key, "ACTIVE", [p.asDict() for p in now["parts"]], now["row_count"]):
                    return "REACTIVATED"
                continue
            if part is None:
                part = self._load(df, key, verify, sort_by)
                continue
            if self._commit(top + 1, key, "ACTIVE", [part], part["row_count"]):
                return "PUBLISHED"

    def _load(self, df: DataFrame, key: str, verify: Callable[[DataFrame], Sequence[str]] | None, sort_by: Sequence[str]) -> dict:
        """A written and verified part; on a fault the rows go and the record of the failure stays."""
        path = f"{self.base}/data/{key}/{uuid.uuid4().hex}"
        self._record(key, "PENDING", [{"path": path, "row_count": None, "sums": None}])
        try:
            (df.sortWithinPartitions(*sort_by) if sort_by else df).write.mode("error").parquet(path)
            written = self.spark.read.schema(df.schema).parquet(path)
            rows = written.count()
            problems = list(verify(written)) if verify else []
            if problems:
                raise PublishFailed("; ".join(problems))
        except Exception as e:
            files.delete(self.spark, path)
            self._record(key, "FAILED", [], str(e))
            if isinstance(e, PublishFailed):
                raise
            raise PublishFailed(str(e)) from e
        return {"path": path, "row_count": rows, "sums": None}

    def append(self, df: DataFrame, increment: str) -> str:
        """Activate a release of the rows of the ACTIVE one and of these, which name their increment in ``INCREMENT``.

        Only the new rows are written. An increment that was appended before is dropped. The key of the
        release is the fingerprint of all its rows, added up from the sums of its parts.
        """
        part = None
        while True:
            top = self._top()
            if not self.events().where((F.col("event") == "ACTIVE") & (F.col("increment") == increment)).isEmpty():
                if part:
                    files.delete(self.spark, part["path"])
                return "ALREADY_HELD"
            if part is None:
                rows = df.withColumn(INCREMENT, F.lit(increment))
                part = self._summed({"path": self._write(rows, increment), "row_count": None, "sums": None})
                continue
            active = self._active()
            parts = [self._summed(p.asDict()) for p in active["parts"]] if active else []
            parts.append(part)
            sums = [sum(int(p["sums"][i]) for p in parts) for i in range(len(part["sums"]))]
            rows = sum(p["row_count"] for p in parts)
            if self._commit(top + 1, f"r-{fingerprint_of(sums, rows)}", "ACTIVE", parts, rows, increment=increment):
                return "APPENDED"

    def _summed(self, part: dict) -> dict:
        """The part with its rows counted and their hashes summed, once for each part."""
        if part["sums"] is not None:
            return part
        rows = self.spark.read.parquet(part["path"])
        found = multiset_sums(rows, sorted(rows.columns)).first()
        return {"path": part["path"], "row_count": found["row_count"], "sums": [str(s) for s in found["sums"]]}

    def compact(self, most: int = 16, target_rows: int = 1 << 30) -> bool:
        """Write the parts smaller than ``target_rows`` as one if there are more than ``most``; the release, its key and its rows stay the same.

        The parts before stay where older events name them. If another writer was first, nothing changes.
        """
        top, active = self._top(), self._active()
        parts = [self._summed(p.asDict()) for p in active["parts"]] if active else []
        small = [p for p in parts if p["row_count"] < target_rows]
        if len(parts) <= most or len(small) < 2:
            return False
        merged = self._write(self.spark.read.parquet(*[p["path"] for p in small]), active["release_key"])
        sums = [str(sum(int(p["sums"][i]) for p in small)) for i in range(len(small[0]["sums"]))]
        one = {"path": merged, "row_count": sum(p["row_count"] for p in small), "sums": sums}
        if self._commit(top + 1, active["release_key"], "ACTIVE", [p for p in parts if p["row_count"] >= target_rows] + [one], active["row_count"]):
            return True
        files.delete(self.spark, merged)
        return False

    def _active(self) -> Row | None:
        return self.releases().where("status = 'ACTIVE'").first()

    def has_active(self) -> bool:
        return self._active() is not None

    def read_active(self) -> DataFrame:
        """Rows of the ACTIVE release; raises when there is none."""
        row = self._active()
        if row is None:
            raise Unavailable(f"no ACTIVE release in {self.base}")
        return self.spark.read.parquet(*[p["path"] for p in row["parts"]])


def release_status(events: DataFrame) -> DataFrame:
    """Current status per release out of its events."""
    last = events.groupBy("release_key").agg(F.max_by(F.struct("event", "parts", "row_count", "reason", "seq"), "seq").alias("l"))
    top = events.where("event = 'ACTIVE'").agg(F.max("seq").alias("_top"))
    j = last.crossJoin(F.broadcast(top))        # one row
    status = F.when((F.col("l.event") == "ACTIVE") & (F.col("l.seq") < F.col("_top")), "SUPERSEDED").otherwise(F.col("l.event"))
    return j.select("release_key", status.alias("status"), "l.parts", "l.row_count", "l.reason", "l.seq")


def publish_outcome(requests: DataFrame, releases: DataFrame, reactivate: Column, key: str = "release_key") -> DataFrame:
    """What publishing each requested key would do."""
    j = requests.join(releases.select(key, F.col("status").alias("_s")), key, "left")
    return j.withColumn("outcome", F.when(F.col("_s").isNull(), "NEW").when(F.col("_s") == "ACTIVE", "ALREADY_ACTIVE")
                        .when((F.col("_s") == "SUPERSEDED") & reactivate, "REACTIVATED").otherwise("REPLACED")).drop("_s")


def active_releases(releases: DataFrame, by: Sequence[str]) -> DataFrame:
    """Latest ACTIVE release per line, or UNAVAILABLE."""
    active = F.col("status") == "ACTIVE"
    g = releases.groupBy(*by).agg(F.max_by("release_key", F.when(active, F.struct("activated_at", "release_key"))).alias("_k"),
                                  F.count(F.when(active, 1)).alias("active_count"))
    return g.select(*by, F.when(F.col("active_count") > 0, F.col("_k")).otherwise("UNAVAILABLE").alias("release_key"), "active_count")


def verify_written(df: DataFrame, measure: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, rows with the measure and rows without it."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"), F.count(measure).alias("with_measure"),
                               F.count(F.when(F.col(measure).isNull(), 1)).alias("without_measure"))


def snapshot_scores(refs: DataFrame, releases: DataFrame, scores: DataFrame, areas: DataFrame) -> DataFrame:
    """Score of an ACTIVE or SUPERSEDED release onto plans; only SCORED rows of known areas, else null."""
    ok = releases.where(F.col("status").isin("ACTIVE", "SUPERSEDED")).select("release_key", F.lit(True).alias("_r"))
    s = scores.where("status = 'SCORED'").select("release_key", "industry_code", "area_code", "score", "monthly_revenue")
    j = (refs.join(ok, "release_key", "left").join(s, ["release_key", "industry_code", "area_code"], "left")
             .join(areas.select("area_code", "area_name"), "area_code", "left"))
    use = F.coalesce("_r", F.lit(False)) & F.col("score").isNotNull() & F.col("area_name").isNotNull()
    return j.select(*refs.columns, *[F.when(use, F.col(c)).alias(c) for c in ("score", "monthly_revenue", "area_name")], use.alias("snapshot"))
