"""Several tables that change together: a manifest names the files of all of them, and writing it is the switch.

A table's rows are dealt to buckets by their keys. A commit rewrites the buckets that its
changes touch, beside the old ones, and then writes one manifest that points to the new
buckets and, for all others, to the old. Until the manifest is there readers see what was
before, in every table; a commit whose manifest is there is not made again. What has to follow
a commit is a hook with a name, and is marked once it has run.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Merge = Callable[[DataFrame, DataFrame], DataFrame]


def upsert(*keys: str) -> Merge:
    """Changed rows stand for the old ones of their keys."""
    return lambda old, new: old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def replace_documents(doc: str = "doc_id", version: str = "version") -> Merge:
    """An import session: all old rows of the documents that come again go, and new ones get the next version."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        last = old.groupBy(doc).agg(F.max(version).alias("__v"))
        fresh = new.join(last, doc, "left").withColumn(version, (F.coalesce("__v", F.lit(0)) + 1).cast(old.schema[version].dataType))
        return old.join(new.select(doc).distinct(), doc, "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))

    return merge


@dataclass
class Store:
    """Tables under one folder of a shared file system: schema, bucket keys and merge rule by name."""

    spark: SparkSession
    path: str
    schemas: dict[str, str]
    keys: dict[str, Sequence[str]]
    merges: dict[str, Merge]
    buckets: int = 64
    hooks: dict[str, Callable[[Store, int], None]] = field(default_factory=dict)

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path.rstrip("/"), *parts)))

    def _fs(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _write(self, text: str, *parts: str) -> None:
        """A small file that is there whole or not at all."""
        fs, draft = self._fs(), self._at("_draft", "-".join(parts))
        out = fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.mkdirs(self._at(*parts[:-1]))
        if not fs.rename(draft, self._at(*parts)) and not fs.exists(self._at(*parts)):
            raise OSError(f"could not write {parts[-1]}")

    def commits(self) -> list[int]:
        """The numbers of the commits that are made, in order."""
        fs, root = self._fs(), self._at("_commits")
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(root) if s.getPath().getName().endswith(".json")) if fs.exists(root) else []

    def manifest(self, number: int | None = None) -> dict[str, dict[str, str]]:
        """Of each table the folder of each bucket, after a commit (the last one by default)."""
        made = self.commits()
        number = number if number is not None else made[-1] if made else None
        if number is None:
            return {name: {} for name in self.schemas}
        lines = self.spark.read.text(str(self._at("_commits", f"{number:012d}.json")), wholetext=True).collect()
        return json.loads(lines[0].value)

    def _rows(self, name: str, folders: Sequence[str]) -> DataFrame:
        reader = self.spark.read.schema(self.schemas[name])
        return reader.parquet(*(str(self._at(f)) for f in folders)) if folders else self.spark.createDataFrame([], self.schemas[name])

    def table(self, name: str, number: int | None = None) -> DataFrame:
        """A table's rows as of a commit (the last one by default)."""
        return self._rows(name, sorted(self.manifest(number)[name].values()))

    def _bucket(self, name: str):
        return F.pmod(F.xxhash64(*self.keys[name]), F.lit(self.buckets)).cast("int").alias("__bucket")

    def commit(self, number: int, changes: dict[str, DataFrame]) -> bool:
        """Merge ``changes`` into their tables and switch all of them at once; False if this commit was made before.

        Only touched buckets are read and written. Files of a commit that broke off are written over when it runs again.
        """
        fresh = number not in self.commits()
        if fresh:
            old = self.manifest()
            new = {name: dict(old.get(name, {})) for name in self.schemas}
            for name, delta in changes.items():
                rows = delta.select(*(c.split()[0] for c in self.schemas[name].split(", ")), self._bucket(name))
                # As many numbers as there are buckets at most.
                touched = [r[0] for r in rows.select("__bucket").distinct().collect()]
                if not touched:
                    continue
                before = self._rows(name, [old[name][str(b)] for b in touched if str(b) in old.get(name, {})])
                merged = self.merges[name](before, rows.drop("__bucket"))
                folder = f"{name}/{number:012d}"
                merged.withColumn("__bucket", self._bucket(name)).repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(str(self._at(folder)))
                there = {s.getPath().getName() for s in self._fs().listStatus(self._at(folder))}
                for b in touched:
                    # A bucket whose rows all went has no folder.
                    new[name].pop(str(b), None)
                    if f"__bucket={b}" in there:
                        new[name][str(b)] = f"{folder}/__bucket={b}"
            self._write(json.dumps(new), "_commits", f"{number:012d}.json")
        for name, hook in self.hooks.items():
            if not self._fs().exists(self._at("_hooks", f"{number:012d}-{name}")):
                hook(self, number)
                self._write("", "_hooks", f"{number:012d}-{name}")
        return fresh

    def clean(self, keep: int = 2) -> int:
        """Delete the files that none of the last ``keep`` commits names; how many folders went. No reader of an older commit may be at work."""
        made, fs = self.commits()[-keep:], self._fs()
        used = {folder for n in made for buckets in self.manifest(n).values() for folder in buckets.values()}
        gone = 0
        for name in self.schemas:
            for commit in fs.listStatus(self._at(name)) if fs.exists(self._at(name)) else ():
                if int(commit.getPath().getName()) > (made[-1] if made else -1):
                    continue  # a commit that is being made
                for bucket in fs.listStatus(commit.getPath()):
                    folder = f"{name}/{commit.getPath().getName()}/{bucket.getPath().getName()}"
                    if bucket.isDirectory() and folder not in used:
                        fs.delete(bucket.getPath(), True)
                        gone += 1
        return gone


def stream_commits(stream: DataFrame, store: Store, checkpoint: str, split: Callable[[DataFrame], dict[str, DataFrame]]):
    """A query that makes every batch one commit; ``split`` gives each table's part of it. A batch that runs again changes nothing."""
    return stream.writeStream.foreachBatch(lambda batch, number: store.commit(number, split(batch))).option("checkpointLocation", checkpoint)
