"""Sinks and the latest-snapshot table.

The snapshot table holds one row per entity with its newest feature snapshot: the
key ``fs:v1:<entity>``, the JSON payload and an expiry. It is a parquet directory
in ``bucket = pmod(hash(entity_id), n_buckets)``; an upsert writes only the
buckets touched by the incoming rows, to a new version, so a micro-batch costs in
proportion to the entities it touches, not the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velocis.functions.scalar import snapshot_key
from velocis.operators.rolling import latest_per_entity
from velocis.schemas import DEFAULT, SNAPSHOT_TTL_SECONDS, WindowSet, integer_feature


def keyed_json(df: DataFrame, key: str = "entity_id") -> DataFrame:
    """``key`` = entity id, ``value`` = JSON of the whole row (S3)."""
    return df.select(F.col(key).cast("string").alias("key"),
                     F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"))


def snapshot_payload(windows: WindowSet = DEFAULT) -> F.Column:
    """JSON document of a snapshot row with ``computed_at_ms``."""
    fields = [F.col("entity_id"), F.unix_millis(F.col("computed_at")).alias("computed_at_ms")]
    fields += [F.col(c) for c in windows.feature_columns()] + [F.col("merchant_category")]
    return F.to_json(F.struct(*fields))


def snapshot_json(snap: DataFrame, windows: WindowSet = DEFAULT) -> DataFrame:
    """Snapshot -> ``entity_id, payload``."""
    return snap.select("entity_id", snapshot_payload(windows).alias("payload"))


def payload_schema(windows: WindowSet = DEFAULT) -> T.StructType:
    fs = [T.StructField("entity_id", T.StringType()), T.StructField("computed_at_ms", T.LongType())]
    for c in windows.feature_columns():
        fs.append(T.StructField(c, T.IntegerType() if integer_feature(c) else T.DoubleType()))
    fs.append(T.StructField("merchant_category", T.StringType()))
    return T.StructType(fs)


def snapshot_records(latest: DataFrame, windows: WindowSet = DEFAULT,
                     ttl_s: float = SNAPSHOT_TTL_SECONDS) -> DataFrame:
    """Stored form of snapshots: key, payload, expiry."""
    us = F.col("us") if "us" in latest.columns else F.unix_micros(F.col("computed_at"))
    ttl = int(ttl_s * 1_000_000)
    base = latest.withColumn("us", us)
    if "computed_at" not in base.columns:
        base = base.withColumn("computed_at", F.timestamp_micros("us"))
    base = base.withColumn("payload", snapshot_payload(windows))
    keep = [c for c in base.columns if c not in ("us", "computed_at", "payload")]
    return base.select(snapshot_key(F.col("entity_id")).alias("key"), *keep,
                       F.col("us").alias("computed_at_us"),
                       (F.col("us") + F.lit(ttl)).alias("expires_at_us"), "payload")


def read_snapshots(records: DataFrame, as_of_us, windows: WindowSet = DEFAULT) -> DataFrame:
    """Decode stored snapshots valid at ``as_of_us``.

    Expired rows and undecodable payloads are misses. ``as_of_us`` is a
    column or a literal epoch-micros value.
    """
    at = as_of_us if isinstance(as_of_us, F.Column) else F.lit(int(as_of_us))
    dec = records.withColumn("_p", F.from_json(F.col("payload"), payload_schema(windows),
                                               {"mode": "PERMISSIVE"}))
    ok = (F.col("expires_at_us") > at) & F.col("_p.entity_id").isNotNull() & \
        (F.col("_p.entity_id") == F.col("entity_id"))
    payload_names = set(payload_schema(windows).fieldNames())
    stored = [c for c in records.columns if c not in payload_names and c not in ("payload", "bucket")]
    return dec.where(ok).select(*stored, *[F.col(f"_p.{c}") for c in payload_schema(windows).fieldNames()
                                           if c != "entity_id"], F.col("_p.entity_id").alias("entity_id"))


class SnapshotTable:
    """Versioned latest-snapshot table, bucketed by entity hash.

    A version writes the buckets it touches to ``data/version=v`` (one file a
    bucket) and then one manifest: for every bucket the version that holds it.
    Nothing is overwritten, and a version exists only once its manifest is
    committed, so a writer that dies leaves the table as it was. Size
    ``n_buckets`` so that a bucket fits a task.
    """

    def __init__(self, spark: SparkSession, path: str, windows: WindowSet = DEFAULT,
                 n_buckets: int = 64, ttl_s: float = SNAPSHOT_TTL_SECONDS):
        self.spark, self.path, self.windows = spark, path.rstrip("/"), windows
        self.n_buckets, self.ttl_s = n_buckets, ttl_s

    def _bucket(self) -> F.Column:
        return F.pmod(F.hash(F.col("entity_id")), F.lit(self.n_buckets)).cast("int")

    def manifest(self) -> tuple[int, dict[int, int]]:
        """Newest committed version (0: none) and the version of each bucket
        (at most n_buckets rows). Only the newest manifest is read."""
        versions = self.versions()
        return (versions[-1], self._held(versions[-1])) if versions else (0, {})

    def versions(self) -> list[int]:
        """Committed versions that are kept, ascending."""
        fs = self._fs()
        return [v for v in self._numbers("manifest", "version")
                if fs.exists(self._path(f"manifest/version={v}/_SUCCESS"))]

    def _held(self, version: int) -> dict[int, int]:
        m = self.spark.read.schema("bucket int, held_by long").parquet(f"{self.path}/manifest/version={version}")
        return {r["bucket"]: r["held_by"] for r in m.collect()}

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._path("data").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, folder: str, key: str) -> list[int]:
        """The numbers of the sub-folders ``key=<number>``."""
        fs, path = self._fs(), self._path(folder)
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{key}="))

    def exists(self) -> bool:
        return self.manifest()[0] > 0

    def read(self, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The newest committed version (or a kept older one), or some buckets of it."""
        version, held = self.manifest() if version is None else (version, self._held(version))
        wanted = {b: v for b, v in held.items() if buckets is None or b in buckets}
        if not version:
            raise ValueError(f"no snapshot table at {self.path}")
        t = self.spark.read.parquet(f"{self.path}/data")
        on = F.lit(False)
        for v in sorted(set(wanted.values())):  # partition filters: only these folders are read
            on = on | ((F.col("version") == v) & F.col("bucket").isin([b for b, x in wanted.items() if x == v]))
        return t.where(on).drop("version")

    def upsert(self, features: DataFrame) -> int:
        """Merge new snapshots (any number per entity) into the table and
        return the new version: the touched buckets, with the new rows, reduced
        to the newest row per entity. Merging the same rows again (a replayed
        micro-batch) gives the same content."""
        cols = ["entity_id", "transaction_id", "us"] + self.windows.feature_columns() + ["merchant_category"]
        new = latest_per_entity(features.select(*cols), order=("us", "transaction_id"))
        new = snapshot_records(new, self.windows, self.ttl_s).withColumn("bucket", self._bucket()).persist()
        try:
            touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most n_buckets
            version, held = self.manifest()
            merged = new
            if version and any(b in held for b in touched):
                cur = self.read(touched)
                merged = latest_per_entity(cur.unionByName(new.select(*cur.columns)),
                                           order=("computed_at_us", "transaction_id")).select(*new.columns)
            version += 1
            merged.repartition(max(1, min(len(touched), self.n_buckets)), "bucket") \
                .withColumn("version", F.lit(version)).write.mode("overwrite") \
                .option("partitionOverwriteMode", "dynamic").partitionBy("version", "bucket") \
                .parquet(f"{self.path}/data")
            self._commit(version, held | {b: version for b in touched})
            return version
        finally:
            new.unpersist()

    def _commit(self, version: int, held: dict[int, int]) -> None:
        self.spark.createDataFrame(sorted(held.items()), "bucket int, held_by long").coalesce(1) \
            .write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")

    def vacuum(self, keep: int = 2) -> int:
        """Drop all but the newest ``keep`` versions; returns the number of
        bucket folders deleted.

        Manifests go first: a bucket folder is deleted only when no manifest
        names it, so a vacuum that dies leaves every kept version whole and the
        next one finds the rest. Folders of a version that is being written (above
        the newest manifest) are left alone. Readers of an older version need it
        kept until they are done."""
        versions = self.versions()
        if not versions or keep < 1:
            return 0
        fs, live = self._fs(), {(v, b) for k in versions[-keep:] for b, v in self._held(k).items()}
        for v in versions[:-keep]:
            fs.delete(self._path(f"manifest/version={v}"), True)
        gone = [(v, b) for v in self._numbers("data", "version") if v <= versions[-1]
                for b in self._numbers(f"data/version={v}", "bucket") if (v, b) not in live]
        for v, b in gone:
            fs.delete(self._path(f"data/version={v}/bucket={b}"), True)
        return len(gone)

    def lookup(self, as_of_us, entities: DataFrame | None = None) -> DataFrame:
        """Snapshots valid at ``as_of_us``, of all entities or of those in
        ``entities(entity_id)``: only their buckets are read."""
        if entities is None:
            return read_snapshots(self.read(), as_of_us, self.windows)
        keys = entities.select(F.col("entity_id").cast("string").alias("entity_id")).distinct()
        buckets = [r[0] for r in keys.select(self._bucket()).distinct().collect()]  # at most n_buckets
        return read_snapshots(self.read(buckets).join(keys, "entity_id", "left_semi"), as_of_us, self.windows)
