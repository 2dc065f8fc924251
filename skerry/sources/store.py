"""Collections of rows by a key, merged when they are read.

A collection is a folder with *base* and *delta* folders, each dealt to buckets by a hash of the key, and
*manifests*: one small file per version that names the folders of each bucket.  An upsert or a deletion
writes its own rows as a delta and a new manifest, nothing else.  A reader takes the last whole manifest
and keeps it, since folders never change: it has a snapshot, whatever is written meanwhile.  Reading lays
the newest row of each key over the base; :meth:`Collection.compact` does so for good, in the buckets whose
deltas have grown to a share of their base.  :meth:`Collection.vacuum` deletes what no kept version names.

Defined results: of rows with equal keys in one upsert the last counts (by ``order``, else as they stand
in the input); a null key is an error, as is a vector of other dimensions; a deletion of unknown keys changes
nothing; of two writers that began with the same version the later one gets an error and may begin anew.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skerry.sources import files

BUCKETS = 16
#: Keys of deltas that may be broadcast to the base's readers.
BROADCAST_KEYS = 200_000
#: A bucket is compacted once its deltas have this share of its base's rows.
COMPACT_SHARE = 0.25

_BUCKET, _DELETED, _VERSION, _PLACE = "_bucket", "_deleted", "_version", "_place"


class Collection:
    """Rows with ``key`` and, if ``dimensions`` are given, an ``embedding`` of so many numbers."""

    def __init__(self, spark: SparkSession, path: str, dimensions: int | None = None, key: str = "chunk_id", buckets: int = BUCKETS):
        self.spark, self.path, self.dimensions, self.key, self.buckets = spark, path.rstrip("/"), dimensions, key, buckets

    # --- versions

    def versions(self) -> list[int]:
        return [int(name.split("-")[1].split(".")[0]) for name in files.names(self.spark, f"{self.path}/manifest-*.json")]

    def _manifest(self, version: int | None = None) -> dict | None:
        """A version's manifest, or the last one's; one that is still being written isn't there yet."""
        for number in [version] if version is not None else reversed(self.versions()):
            try:
                return json.loads(files.read_text(self.spark, f"{self.path}/manifest-{number:012d}.json"))
            except json.JSONDecodeError:
                continue
        return None

    def _commit(self, manifest: dict) -> None:
        files.create_text(self.spark, f"{self.path}/manifest-{manifest['version']:012d}.json", json.dumps(manifest))

    # --- writing

    def _checked(self, rows: DataFrame) -> DataFrame:
        key = F.when(F.col(self.key).isNotNull(), F.col(self.key)).otherwise(F.raise_error(F.lit("a row has no key")))
        rows = rows.withColumn(self.key, key)
        if self.dimensions is None:
            return rows
        wrong = F.raise_error(F.lit(f"a vector hasn't {self.dimensions} dimensions"))
        return rows.withColumn("embedding", F.when(F.size("embedding") == self.dimensions, F.col("embedding")).otherwise(wrong))

    def _last(self, rows: DataFrame, order: Column | None) -> DataFrame:
        """The last row of each key."""
        columns = [c for c in rows.columns if c != _PLACE]
        placed = rows.withColumn(_PLACE, F.monotonically_increasing_id() if order is None else order)
        record = F.struct(*[c for c in columns if c != self.key], F.lit(0).alias(_PLACE))
        last = placed.groupBy(self.key).agg(F.max_by(record, F.col(_PLACE)).alias("r"))
        return last.select(*[F.col(c) if c == self.key else F.col(f"r.`{c}`") for c in columns])

    def _written(self, rows: DataFrame, kind: str, buckets: list[int] | None = None) -> tuple[str, dict[str, int]]:
        """Write rows by bucket; the folder and the number of rows of each bucket."""
        folder = f"{kind}-{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")
        n = len(buckets) if buckets is not None else self.buckets
        rows.withColumn(_BUCKET, bucket).repartition(n, _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
        if not files.names(self.spark, f"{self.path}/{folder}/{_BUCKET}=*"):
            return folder, {}
        counts = self.spark.read.schema(f"{_BUCKET} int").parquet(f"{self.path}/{folder}").groupBy(_BUCKET).count().collect()  # a row per bucket
        return folder, {str(r[_BUCKET]): r["count"] for r in counts}

    def write(self, rows: DataFrame, order: Column | None = None) -> None:
        """Replace all rows."""
        before = self._manifest()
        rows = self._last(self._checked(rows), order)
        folder, counts = self._written(rows, "base")
        base = {b: {"folder": folder, "rows": n} for b, n in counts.items()}
        self._commit({"version": before["version"] + 1 if before else 0, "schema": rows.schema.json(), "base": base, "deltas": []})

    def upsert(self, rows: DataFrame, order: Column | None = None) -> None:
        """Put rows in place of those with their keys, and add the others; writes these rows only."""
        before = self._manifest()
        if before is None:
            return self.write(rows, order)
        schema = StructType.fromJson(json.loads(before["schema"]))
        place = F.monotonically_increasing_id() if order is None else order
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema], place.alias(_PLACE))
        self._delta(before, self._last(self._checked(rows), F.col(_PLACE)).withColumn(_DELETED, F.lit(False)))

    def delete(self, keys: DataFrame) -> None:
        """Mark the rows of ``keys`` (a column named as the key) as deleted."""
        before = self._manifest()
        if before is None:
            return
        schema = StructType.fromJson(json.loads(before["schema"]))
        rows = keys.select(F.col(self.key).cast(schema[self.key].dataType)).filter(F.col(self.key).isNotNull()).distinct()
        rows = rows.select(*[F.col(f.name) if f.name == self.key else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
        self._delta(before, rows.withColumn(_DELETED, F.lit(True)))

    def _delta(self, before: dict, rows: DataFrame) -> None:
        version = before["version"] + 1
        folder, counts = self._written(rows.withColumn(_VERSION, F.lit(version).cast("long")), "delta")
        if counts:
            self._commit(before | {"version": version, "deltas": [*before["deltas"], {"folder": folder, "rows": counts}]})

    def compact(self, share: float = COMPACT_SHARE) -> list[int]:
        """Rewrite the buckets whose deltas have at least ``share`` of their base's rows; which these were."""
        before = self._manifest()
        if before is None:
            return []
        grown = {}
        for delta in before["deltas"]:
            for b, n in delta["rows"].items():
                grown[b] = grown.get(b, 0) + n
        due = sorted(int(b) for b, n in grown.items() if n >= share * before["base"].get(b, {"rows": 0})["rows"])
        if not due:
            return []
        folder, counts = self._written(self._merged(before, due), "base", due)
        base = {b: x for b, x in before["base"].items() if int(b) not in due} | {b: {"folder": folder, "rows": n} for b, n in counts.items()}
        deltas = [{"folder": d["folder"], "rows": {b: n for b, n in d["rows"].items() if int(b) not in due}} for d in before["deltas"]]
        self._commit(before | {"version": before["version"] + 1, "base": base, "deltas": [d for d in deltas if d["rows"]]})
        return due

    def vacuum(self, keep: int = 2) -> None:
        """Delete versions but the last ``keep`` ones, and the folders that these don't name; readers of older ones lose them."""
        kept = self.versions()[-keep:]
        named = {f for v in kept for m in [self._manifest(v)] if m for f in [*(x["folder"] for x in m["base"].values()), *(d["folder"] for d in m["deltas"])]}
        for version in self.versions()[:-keep]:
            files.delete(self.spark, f"{self.path}/manifest-{version:012d}.json")
        for folder in files.names(self.spark, f"{self.path}/base-*") + files.names(self.spark, f"{self.path}/delta-*"):
            if folder not in named:
                files.delete(self.spark, f"{self.path}/{folder}")

    def reset(self) -> None:
        """Delete everything."""
        files.delete(self.spark, self.path)

    # --- reading

    def rows(self, version: int | None = None) -> DataFrame | None:
        """A snapshot of a version, the last one if none is named; None where nothing was written."""
        manifest = self._manifest(version)
        return None if manifest is None else self._merged(manifest)

    def lookup(self, keys: DataFrame) -> DataFrame | None:
        """The rows of ``keys``; only their buckets are read."""
        manifest = self._manifest()
        if manifest is None:
            return None
        bucket = F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")
        asked = [r["b"] for r in keys.select(bucket.alias("b")).distinct().filter("b is not null").collect()]  # a row per bucket
        return self._merged(manifest, asked).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def _merged(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest["schema"]))

        def mine(b: str) -> bool:
            return buckets is None or int(b) in buckets

        def read(paths: list[str], kind: StructType) -> DataFrame:
            return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

        base = read([f"{self.path}/{x['folder']}/{_BUCKET}={b}" for b, x in manifest["base"].items() if mine(b)], schema)
        laid = [(d["folder"], b, n) for d in manifest["deltas"] for b, n in d["rows"].items() if mine(b)]
        if not laid:
            return base
        kind = StructType([*schema.fields, *StructType.fromDDL(f"{_DELETED} boolean, {_VERSION} bigint").fields])
        deltas = read([f"{self.path}/{folder}/{_BUCKET}={b}" for folder, b, _ in laid], kind)
        if len({folder for folder, _, _ in laid}) > 1:
            deltas = self._last(deltas, F.col(_VERSION))
        keys = deltas.select(self.key)
        keys = F.broadcast(keys) if sum(n for _, _, n in laid) <= BROADCAST_KEYS else keys
        return base.join(keys, self.key, "left_anti").select(*schema.names).unionByName(deltas.filter(~F.col(_DELETED)).select(*schema.names))
