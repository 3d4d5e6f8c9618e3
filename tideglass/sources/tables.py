"""Stored tables that are written by key (K01-K14): Parquet in buckets of the key, and a manifest a version.

A write stages its changes, reads only the buckets that hold their keys, merges with an operator of
``operators.upserts`` and writes these buckets to a new folder. The version appears with one rename of
its manifest, which names every bucket's folder: readers see whole versions, and a writer that is lost
before the rename leaves nothing but files that no manifest names. Where two writers meet, the second
rename fails; its buckets are kept if the other write touched none of them, and merged anew otherwise.
A manifest also carries cursors and the last batch of each stream, so that rows, cursor and the mark
that a batch is done become visible together; a batch that comes again changes nothing.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import upserts
from ..session import checkpointed

def query_id(batch: DataFrame, otherwise: str) -> str:
    """The id of the streaming query whose ``foreachBatch`` runs: kept by its checkpoint, new with a new one."""
    return batch.sparkSession.sparkContext._jsc.sc().getLocalProperty("sql.streaming.queryId") or otherwise


Merge = Callable[[DataFrame, DataFrame], DataFrame]
ATTEMPTS = 20


@dataclass(frozen=True)
class Snapshot:
    """One version: the folder of each bucket that has rows, the cursors, and the last batch of each stream."""

    version: int = 0
    buckets: dict[str, str] = field(default_factory=dict)
    cursors: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class Conflict(RuntimeError):
    """Other writers were first, ``ATTEMPTS`` times in a row."""


class KeyedTable:
    """keys: the columns that tell rows apart, without nulls; bucket_by: those that choose the bucket, keys of a parent for its children.

    Choose ``buckets`` so that one bucket is one task's work; it is fixed for the life of the table.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], bucket_by: list[str] | None = None, buckets: int = 32):
        self.spark, self.path, self.schema, self.keys, self.bucket_by, self.buckets = spark, path.rstrip("/"), schema, keys, bucket_by or keys, buckets

    def _hadoop(self, path: str):
        made = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return made, made.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, files = self._hadoop(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json")]

    def snapshot(self, version: int | None = None) -> Snapshot:
        """A version as it was, or the newest; version 0 is the table before its first write."""
        version = max(self.versions(), default=0) if version is None else version
        if version == 0:
            return Snapshot()
        text = self.spark.read.text(f"{self.path}/manifests/{version:020d}.json", wholetext=True).first()[0]
        return Snapshot(**json.loads(text))

    def _publish(self, new: Snapshot) -> bool:
        """Whether ``new`` became a version; not if another writer has taken its number."""
        draft, files = self._hadoop(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(json.dumps(asdict(new)).encode())
        out.close()
        final, _ = self._hadoop(f"{self.path}/manifests/{new.version:020d}.json")
        files.mkdirs(final.getParent())
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        no_overwrite = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, context.makeQualified(final), no_overwrite)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            files.delete(draft, False)
            return False
        return True

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    def _rows(self, at: Snapshot, buckets: list[str]) -> DataFrame:
        folders = [f"{self.path}/{at.buckets[b]}/_bucket={b}" for b in buckets if b in at.buckets]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        at = self.snapshot(version)
        return self._rows(at, sorted(at.buckets))

    def _touched(self, keys: DataFrame) -> list[str]:
        return sorted(str(r[0]) for r in keys.select(self._bucket()).distinct().collect())  # at most `buckets` rows

    def near(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """All rows of the buckets that hold the ``bucket_by`` columns of ``keys``."""
        return self._rows(self.snapshot(version), self._touched(keys))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Rows with the ``bucket_by`` columns of ``keys``, from their buckets alone."""
        own = keys.select(*self.bucket_by).distinct()
        return self.near(own).join(own, self.bucket_by, "left_semi")

    def commit(self, changes: DataFrame, merge: Merge, batch: tuple[str, int] | None = None, cursors: Callable[[dict], dict] | None = None, touching: DataFrame | None = None) -> Snapshot:
        """Merge ``changes`` into the buckets of their keys (or those of ``touching``) and publish a version.

        merge: (old rows of these buckets, changes) to their new rows. batch: (stream, id), ids of a
        stream ascend; a batch at or below the last one is done. cursors: from the old cursors to the new.
        """
        base = self.snapshot()
        if batch and base.batches.get(batch[0], -1) >= batch[1]:
            return base
        changes = checkpointed(changes)
        touched, merged_from, made = self._touched(changes if touching is None else touching), None, {}
        for _ in range(ATTEMPTS):
            if batch and base.batches.get(batch[0], -1) >= batch[1]:
                return base
            old = {b: base.buckets.get(b) for b in touched}
            if old != merged_from:  # first, or another writer changed one of these buckets
                merged_from, made = old, self._write(merge(self._rows(base, touched), changes)) if touched else {}
            kept = {b: f for b, f in base.buckets.items() if b not in old}
            new = Snapshot(base.version + 1, kept | made, base.cursors | (cursors(base.cursors) if cursors else {}), base.batches | ({batch[0]: batch[1]} if batch else {}))
            if self._publish(new):
                return new
            base = self.snapshot()
        raise Conflict(self.path)

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """The buckets of ``rows``, each one task's work, in a new folder."""
        folder = f"data/{uuid.uuid4().hex}"
        columns = self.spark.createDataFrame([], self.schema).columns
        dealt = rows.select(*columns).withColumn("_bucket", self._bucket()).repartition("_bucket")
        dealt.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        return {n.removeprefix("_bucket="): folder for n in self._names(folder) if n.startswith("_bucket=")}

    def replace(self, new: DataFrame, **how) -> Snapshot:
        """Rows of ``new`` replace those of their key."""
        return self.commit(new, lambda old, rows: upserts.replace_rows(old, rows, self.keys), **how)

    def replace_children(self, parents: DataFrame, new: DataFrame, **how) -> Snapshot:
        """All rows of ``parents`` (the ``bucket_by`` columns) go, ``new`` come (K05); a parent may be left without any."""
        gone = checkpointed(parents.select(*self.bucket_by).unionByName(new.select(*self.bucket_by)).distinct())
        return self.commit(new, lambda old, rows: old.join(gone, self.bucket_by, "left_anti").unionByName(rows.select(*old.columns)), touching=gone, **how)

    def supply(self, new: DataFrame, **how) -> Snapshot:
        """Only the columns of ``new`` change; unseen keys are added."""
        return self.commit(new, lambda old, rows: upserts.upsert_supplied(old, rows, self.keys), **how)

    def fill_gaps(self, new: DataFrame, **how) -> Snapshot:
        """Known values stay."""
        return self.commit(new, lambda old, rows: upserts.fill_gaps(old, rows, self.keys), **how)

    def insert_absent(self, new: DataFrame, **how) -> Snapshot:
        return self.commit(new, lambda old, rows: upserts.insert_absent(old, rows, self.keys), **how)

    def supersede(self, decisions: DataFrame, now: Column, **how) -> Snapshot:
        """The active rows of decided keys are closed, the decisions become active (K13); key: the first of ``bucket_by``."""
        return self.commit(decisions, lambda old, rows: upserts.supersede(old, rows, self.bucket_by[0], now), **how)

    def vacuum(self, keep: int = 1, older_than: float = 0) -> int:
        """Delete all but the last ``keep`` versions, and the folders that only they name.

        older_than: only files that are so many seconds old, which must be longer than a write takes
        where others may be under way.
        """
        versions, latest = self.versions(), (time.time() - older_than) * 1000
        stay = versions[-keep:]
        named = {f.removeprefix("data/") for v in stay for f in self.snapshot(v).buckets.values()}
        gone = [f"data/{n}" for n in self._names("data") if n not in named] + [f"drafts/{n}" for n in self._names("drafts")] + [f"manifests/{v:020d}.json" for v in versions if v not in stay]
        deleted = 0
        for name in gone:
            path, files = self._hadoop(f"{self.path}/{name}")
            if files.getFileStatus(path).getModificationTime() <= latest:
                deleted += files.delete(path, True)
        return deleted
