"""A keyed table in a shared folder: upserts, deletes, whole-key replacement, reading as of a version, listing, expiry.

Rows lie in buckets by a hash of their key.  A change reads and writes only the buckets its keys fall in, each as one new folder,
so files never pile up and need no later compaction.  A version is a manifest that names the folder of every bucket; it is
written beside and renamed into place, so readers see the old version or the new one.  One writer at a time.  A change that
brings the number of a batch that was applied before is left out, so a stream's repeated batches count once.

Defined cases: a null key is a key like others; of rows of a batch with equal keys `upsert` keeps the one with the largest `order`
(ties: the largest digest of the whole row), `replace` keeps all; an empty change makes a version with the same rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 16) -> None:
        self.spark, self.path, self.key = spark, path, key
        base = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
        kept = self._manifest(self.latest()) if self.latest() else None
        self.buckets = kept["buckets"] if kept else buckets

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _numbers(self) -> list[int]:
        at = self._at("versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit())

    def latest(self) -> int:
        """The newest version; 0 before the first."""
        return max(self._numbers(), default=0)

    def _manifest(self, version: int) -> dict:
        """Schema, batch and the folder of each bucket: a few bytes for each bucket, whatever the rows."""
        if version not in self._numbers():
            raise ValueError(f"no version {version} under {self.path}")
        return json.loads(self.spark.read.text(f"{self.path}/versions/{version}", wholetext=True).first().value)

    def _commit(self, manifest: dict) -> int:
        version = self.latest() + 1
        tmp, done = self._at("versions", f".new-{uuid.uuid4().hex}"), self._at("versions", str(version))
        out = self._fs.create(tmp, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(done) or not self._fs.rename(tmp, done):
            raise RuntimeError(f"another writer made version {version} of {self.path}")
        return version

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _rows(self, manifest: dict, only: set[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/data/{f}/__bucket={b}" for b, f in manifest["folders"].items() if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows as of a version, by default the newest."""
        return self._rows(self._manifest(version or self.latest()))

    def versions(self) -> DataFrame:
        """(version, batch, touched, n_rows) of every version that is kept."""
        found = [(v, self._manifest(v)) for v in self._numbers()]
        rows = [(v, m["batch"], m["touched"], sum(m["rows"].values())) for v, m in found]
        return self.spark.createDataFrame(rows, "version long, batch long, touched int, n_rows long")

    def replace(self, rows: DataFrame, keys: DataFrame | None = None, batch: int | None = None) -> int:
        """Drop every row whose key is among `keys` (by default those of rows), then add rows; the version that holds the result."""
        now = self.latest()
        old = self._manifest(now) if now else {"schema": rows.schema.jsonValue(), "folders": {}, "rows": {}, "batch": None}
        if batch is not None and old["batch"] is not None and batch <= old["batch"]:
            return now
        names = T.StructType.fromJson(old["schema"]).names
        name, made = uuid.uuid4().hex, f"{self.path}/changes/{uuid.uuid4().hex}"
        # The change is written once: which buckets it touches and what goes into them are read from the same rows.
        rows.select(*names).withColumn("__bucket", self._bucket()).write.parquet(f"{made}/rows")
        new = self.spark.read.parquet(f"{made}/rows")
        (keys if keys is not None else rows).select(self.key).distinct().withColumn("__bucket", self._bucket()).write.parquet(f"{made}/keys")
        gone = self.spark.read.parquet(f"{made}/keys")
        touched = {str(r[0]) for r in gone.select("__bucket").union(new.select("__bucket")).distinct().collect()}  # as many as buckets at most
        held = self._rows(old, touched).withColumn("__bucket", self._bucket())
        same = held["__bucket"].eqNullSafe(gone["__bucket"]) & held[self.key].eqNullSafe(gone[self.key])
        merged = held.join(gone, same, "left_anti").select(*names, "__bucket").union(new.select(*names, "__bucket"))
        merged.hint("rebalance", F.col("__bucket")).write.partitionBy("__bucket").parquet(f"{self.path}/data/{name}")
        counted = self._counts(name)
        keep = lambda of: {b: v for b, v in of.items() if b not in touched}
        done = self._commit({
            "schema": old["schema"], "buckets": self.buckets, "batch": old["batch"] if batch is None else batch, "touched": len(touched),
            "folders": keep(old["folders"]) | {b: name for b in counted}, "rows": keep(old["rows"]) | counted,
        })
        self._fs.delete(self._at(made[len(self.path) + 1 :]), True)
        return done

    def _counts(self, name: str) -> dict[str, int]:
        if not any(s.getPath().getName().startswith("__bucket=") for s in self._fs.listStatus(self._at("data", name))):
            return {}
        return {str(r[0]): r[1] for r in self.spark.read.parquet(f"{self.path}/data/{name}").groupBy("__bucket").count().collect()}

    def upsert(self, rows: DataFrame, order: str, deleted: Column | None = None, batch: int | None = None) -> int:
        """Of each key the newest row of the batch takes the place of the one before; where `deleted` holds for it, the key goes."""
        digest = F.xxhash64(F.to_json(F.struct(*rows.columns)))
        rank = F.row_number().over(W.partitionBy(self.key).orderBy(F.desc_nulls_last(order), F.desc(digest)))
        newest = rows.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")
        live = newest if deleted is None else newest.filter(~F.coalesce(deleted, F.lit(False)))
        return self.replace(live, rows.select(self.key), batch)

    def upsert_stream(self, stream: DataFrame, order: str, checkpoint: str, deleted: Column | None = None):
        """Upsert all that a stream holds now, batch by batch; a started query that ends by itself."""
        put = lambda rows, batch: self.upsert(rows, order, deleted, batch)
        return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()

    def expire(self, keep: int = 1) -> list[int]:
        """Forget all but the newest versions, and delete the folders that none of those kept names; the numbers forgotten."""
        numbers = self._numbers()
        gone, kept = numbers[: max(0, len(numbers) - keep)], numbers[-keep:]
        used = {f for v in kept for f in self._manifest(v)["folders"].values()}
        for v in gone:
            self._fs.delete(self._at("versions", str(v)), False)
        for s in self._fs.listStatus(self._at("data")):
            if s.getPath().getName() not in used:
                self._fs.delete(s.getPath(), True)
        return gone
