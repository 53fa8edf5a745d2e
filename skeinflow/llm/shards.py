"""Size-tiered compaction of immutable shards under a versioned manifest (DataFrame functions only).

A store is a folder with shard files and numbered manifests. append() writes arrivals as small shards; compact() merges runs of shards of
similar size (one tier: within a factor of FANOUT) into files of at most the target size. A run is due when it has FANOUT shards, or when two or more fill
over half the target, so no tier of whatever size is stuck. Either becomes visible by one manifest, which is written under another name and
renamed to the next free number; if another writer took that number, the commit is tried again on top of it.

A manifest holds what its version adds and removes, and every CHECKPOINT versions the whole list, so a commit costs what it changes.
Readers use one version's shards, so they see it as a whole. Merged shards stay for readers of former versions until vacuum(), which deletes the files
that none of the last few versions names (those of lost tasks and failed commits too).

Rows are moved as they are, with all columns, nulls, repeats and very long texts; merging reads a run's files in one task as a
stream and shuffles nothing, so a key that holds a third of all rows makes no difference. An empty arrival adds no shard; an empty store reads as no rows.
A null arrival is an arrival of its own, after all others, which come in order of their numbers, or else of their text.
"""

from __future__ import annotations

import json
import math
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET_BYTES = 128 << 20
FANOUT = 4
#: Runs merged by one job: each is one task and one file.
RUNS_AT_ONCE = 64
#: Versions between two manifests with the whole list.
CHECKPOINT = 16


def size_of(shards: list[dict]) -> int:
    return sum(s["bytes"] for s in shards)


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.path, self.target, self.fanout = spark, path.rstrip("/"), target_bytes, fanout
        self.schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._at(self.path).getFileSystem(self.conf)
        for d in ("data", "manifest"):
            self.fs.mkdirs(self._at(f"{self.path}/{d}"))

    def _at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    # manifests

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self._at(f"{self.path}/manifest"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _load(self, version: int) -> dict:
        stream = self.fs.open(self._at(f"{self.path}/manifest/v{version:08d}.json"))
        try:
            return json.loads(str(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> dict:
        """The version and its shards, by default the last; version 0 is the empty store."""
        last = self.versions()
        version = version if version is not None else (last[-1] if last else 0)
        changes, at = [], version
        while at and "shards" not in (found := self._load(at)):
            changes.append(found)
            at -= 1
        shards = {s["file"]: s for s in (found["shards"] if at else [])}
        for change in reversed(changes):
            for f in change["remove"]:
                shards.pop(f, None)
            shards |= {s["file"]: s for s in change["add"]}
        return {"version": version, "shards": list(shards.values())}

    def commit(self, add: list[dict], remove: set[str]) -> dict:
        """Adds and removes shards in one new version. A removed shard must be in the version that this builds on."""
        while True:
            now = self.manifest()
            if not remove <= {s["file"] for s in now["shards"]}:
                raise RuntimeError("shards to be merged are no longer in the store: another compaction was first")
            version = now["version"] + 1
            shards = [s for s in now["shards"] if s["file"] not in remove] + add
            new = {"version": version} | ({"shards": shards} if version % CHECKPOINT == 0 else {"add": add, "remove": sorted(remove)})
            if self._publish(new, f"{self.path}/manifest/v{version:08d}.json"):
                return {"version": version, "shards": shards}

    def _publish(self, manifest: dict, at: str) -> bool:
        temporary = f"{self.path}/manifest/.{uuid.uuid4().hex}"
        out = self.fs.create(self._at(temporary), False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._rename(temporary, at):
            return True
        self.fs.delete(self._at(temporary), False)
        return False

    def _rename(self, a: str, b: str) -> bool:
        """Renames if b isn't there; the file system decides which of two writers was first, and the other one gets False."""
        package = self.jvm.org.apache.hadoop.fs
        option = getattr(package, "Options$Rename")
        none = self.spark.sparkContext._gateway.new_array(option, 1)
        none[0] = option.NONE
        context = package.FileContext.getFileContext(self._at(a).toUri(), self.conf)
        try:
            context.rename(self._at(a), self._at(b), none)
        except Py4JJavaError:
            if self.fs.exists(self._at(b)):
                return False
            raise
        return True

    # shards

    def _files(self, folder: str) -> list[dict]:
        out = []
        files = self.fs.listFiles(self._at(folder), True)
        while files.hasNext():
            f = files.next()
            if f.getPath().getName().endswith(".parquet"):
                at = f.getPath().toString()
                out.append({"file": at[at.rindex("/data/") + 1 :], "bytes": f.getLen()})
        return sorted(out, key=lambda s: s["file"])

    def _write(self, df: DataFrame, *by: str) -> str:
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").partitionBy(*by).parquet(folder)
        return folder

    def tier(self, size: int) -> int:
        """Tiers of sizes: each up to fanout times the one below; shards from half the target on are full (-1)."""
        return -1 if 2 * size > self.target else int(math.log(max(size, 1), self.fanout))

    def append(self, df: DataFrame) -> dict:
        """Commits the rows of df as new shards."""
        return self.commit(self._files(self._write(df.select(*self.schema.names))), set())

    def append_arrivals(self, df: DataFrame, arrival: Column) -> list[dict]:
        """Commits df as one arrival after the other, in order of arrival's values. One pass writes all; each commit adds one arrival's shards."""
        name = "__arrival"
        while name in self.schema.names:
            name += "_"
        folder = self._write(df.select(*self.schema.names, arrival.alias(name)), name)
        files: dict[str, list[dict]] = {}
        for s in self._files(folder):
            files.setdefault(s["file"].split(f"/{name}=")[1].split("/")[0], []).append(s)

        def order(k: str):
            return (2, 0, k) if k == "__HIVE_DEFAULT_PARTITION__" else (0, int(k), k) if k.lstrip("-").isdigit() else (1, 0, k)

        return [self.commit(files[k], set()) for k in sorted(files, key=order)]

    def runs(self) -> list[list[dict]]:
        """Runs of similarly sized shards that are due to be merged."""
        tiers: dict[int, list[dict]] = {}
        for s in self.manifest()["shards"]:
            tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        out: list[list[dict]] = []
        for k in sorted(t for t in tiers if t >= 0):
            run: list[dict] = []
            for s in tiers[k]:
                if run and size_of(run) + s["bytes"] > self.target:
                    out.append(run)
                    run = []
                run.append(s)
            out.append(run)
        return [r for r in out if len(r) >= self.fanout or (len(r) > 1 and self.tier(size_of(r)) < 0)]

    def read_files(self, shards: list[dict]) -> DataFrame:
        if not shards:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{s['file']}" for s in shards))

    def compact(self) -> dict:
        """Merges until no run is due. Old shards stay until vacuum()."""
        while due := self.runs():
            for k in range(0, len(due), RUNS_AT_ONCE):
                some = due[k : k + RUNS_AT_ONCE]
                merged = reduce(DataFrame.unionByName, (self.read_files(r).coalesce(1) for r in some))
                self.commit(self._files(self._write(merged)), {s["file"] for r in some for s in r})
        return self.manifest()

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the files that none of the last keep versions names, and manifests that these don't build on. Only while no one writes."""
        last = self.versions()
        kept = last[-keep:]
        named = {s["file"] for v in kept for s in self.manifest(v)["shards"]}
        loose = [s for s in self._files(f"{self.path}/data") if s["file"] not in named]
        for s in loose:
            self.fs.delete(self._at(f"{self.path}/{s['file']}"), False)
        base = next((v for v in reversed(last) if v <= kept[0] and "shards" in self._load(v)), 0)
        for v in last:
            if v < base:
                self.fs.delete(self._at(f"{self.path}/manifest/v{v:08d}.json"), False)
        return len(loose)

    def read(self, version: int | None = None) -> DataFrame:
        return self.read_files(self.manifest(version)["shards"])
