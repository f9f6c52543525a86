"""Mutable tables as a base, deltas and append logs under one manifest, which a commit swaps once.

Rows lie in folders by a bucket of their key. A commit writes a delta of whole rows (or marks of rows that are
gone) and rows of logs, and then one small manifest with the next number; a reader takes the greatest number, so a
writer that dies before that changes nothing, and of two writers that began with the same state one gets
``Conflict``. A read takes each key's newest row; with some keys it reads only their buckets. Compaction rewrites
the buckets that deltas touch.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import file_system


class Conflict(Exception):
    """Another writer has published a version since this one's state was read."""


class Versioned:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---- manifests

    def version(self) -> int:
        fs, at = file_system(self.spark, f"{self.path}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def state(self) -> dict:
        """The manifest in force."""
        fs, at = file_system(self.spark, f"{self.path}/manifests/{self.version():012d}")
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, state: dict) -> int:
        """Make a state the one in force: a whole file is renamed to the next number, which fails if it is taken."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        fs, draft = file_system(self.spark, f"{self.path}/manifests/draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        _, at = file_system(self.spark, f"{self.path}/manifests/{state['version']:012d}")
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        try:
            files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            files.rename(draft, at, gateway.new_array(rename, 0))
        except Exception as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {state['version']} is there already") from e
            raise
        return state["version"]

    # ---- writing

    def _bucket(self, state: dict):
        return F.pmod(F.xxhash64(state["key"]), F.lit(state["buckets"])).cast("int")

    def _written(self, rows: DataFrame, state: dict, tag: str) -> tuple[str, list[int]]:
        """Rows as a new folder by buckets; a bucket of any size is written by several tasks."""
        folder = f"{tag}-{uuid.uuid4().hex}"
        placed = rows.withColumn("bucket", self._bucket(state))
        placed.repartitionByRange("bucket", state["key"]).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        fs, at = file_system(self.spark, f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return folder, [int(n.split("=")[1]) for n in names if n.startswith("bucket=")]

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str = "id", buckets: int = 64) -> Versioned:
        """A new table of ``rows``, which have distinct keys."""
        table = cls(rows.sparkSession, path)
        state = {"version": 1, "schema": rows.schema.json(), "key": key, "buckets": buckets, "deltas": [], "logs": {}, "notes": {}}
        folder, hit = table._written(rows, state, "base")
        table._publish(state | {"base": {str(b): folder for b in hit}})
        return table

    def commit(self, changes: DataFrame | None = None, logs: dict[str, DataFrame] | None = None, notes: dict | None = None, since: dict | None = None, used: dict[str, list[str]] | None = None) -> int:
        """Publish changes (whole rows, one a key, with an optional column ``gone``) and rows of logs together.

        ``since`` is the state that they were made from (the one in force by default). ``used`` are folders of logs
        that the changes have taken up; they leave the log.
        """
        state = since or self.state()
        new = json.loads(json.dumps(state)) | {"version": state["version"] + 1}
        if changes is not None:
            names = [*self.schema(state).fieldNames()]
            rows = changes.select(*names, F.coalesce(F.col("gone"), F.lit(False)).alias("gone") if "gone" in changes.columns else F.lit(False).alias("gone"))
            folder, hit = self._written(rows, state, "delta")
            new["deltas"].append({"folder": folder, "version": new["version"], "buckets": hit})
        for name, rows in (logs or {}).items():
            folder = f"log-{name}-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.path}/{folder}")
            held = new["logs"].setdefault(name, {"schema": rows.schema.json(), "folders": []})
            held["folders"].append(folder)
        for name, folders in (used or {}).items():
            new["logs"][name]["folders"] = [f for f in new["logs"][name]["folders"] if f not in folders]
        new["notes"] |= notes or {}
        return self._publish(new)

    def compact(self, since: dict | None = None) -> int:
        """Rewrite the buckets that deltas touch, without rows that are gone."""
        state = since or self.state()
        touched = sorted({b for d in state["deltas"] for b in d["buckets"]})
        base = {b: f for b, f in state["base"].items() if int(b) not in touched}
        if touched:
            folder, hit = self._written(self._rows(state, touched), state, "base")
            base |= {str(b): folder for b in hit}
        return self._publish(state | {"version": state["version"] + 1, "base": base, "deltas": []})

    def vacuum(self) -> int:
        """Remove folders that the state in force doesn't name: of dead writers and of earlier versions. To be run
        when no reader or writer of an earlier state is left. Returns how many went."""
        state = self.state()
        named = {"manifests", *state["base"].values(), *(d["folder"] for d in state["deltas"]), *(f for x in state["logs"].values() for f in x["folders"])}
        fs, at = file_system(self.spark, self.path)
        gone = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName() not in named]
        for path in gone:
            fs.delete(path, True)
        return len(gone)

    # ---- reading

    def schema(self, state: dict | None = None):
        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads((state or self.state())["schema"]))

    def _parquet(self, schema, folders: dict[str, list[int]]) -> DataFrame:
        paths = [f"{self.path}/{folder}/bucket={b}" for folder, buckets in folders.items() for b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _rows(self, state: dict, buckets: list[int] | None = None) -> DataFrame:
        from pyspark.sql.types import BooleanType, StructField, StructType

        wanted = None if buckets is None else set(buckets)
        schema, key = self.schema(state), state["key"]
        folders: dict[str, list[int]] = {}
        for b, folder in state["base"].items():
            if wanted is None or int(b) in wanted:
                folders.setdefault(folder, []).append(int(b))
        base = self._parquet(schema, folders)
        deltas = []
        marked = StructType([*schema.fields, StructField("gone", BooleanType())])
        for d in state["deltas"]:
            hit = [b for b in d["buckets"] if wanted is None or b in wanted]
            if hit:
                deltas.append(self._parquet(marked, {d["folder"]: hit}).withColumn("__version", F.lit(d["version"])))
        if not deltas:
            return base
        every = reduce(DataFrame.unionByName, deltas)
        newest = every.groupBy(key).agg(F.max_by(F.struct(*marked.fieldNames()), "__version").alias("row")).select("row.*")
        kept = newest.where("NOT gone").drop("gone")
        return base.join(newest.select(key), key, "left_anti").select(*schema.fieldNames()).unionByName(kept)

    def read(self, keys: DataFrame | None = None, state: dict | None = None) -> DataFrame:
        """Current rows, or those of some keys (a column of the key's name), whose buckets alone are read."""
        state = state or self.state()
        if keys is None:
            return self._rows(state)
        wanted = keys.select(state["key"]).distinct()
        hit = [r[0] for r in wanted.select(self._bucket(state)).distinct().collect()]
        return self._rows(state, hit).join(wanted, state["key"], "left_semi")

    def log(self, name: str, schema: str, state: dict | None = None) -> DataFrame:
        """Rows of a log; empty with ``schema`` where nothing was logged."""
        held = (state or self.state())["logs"].get(name, {"folders": []})
        paths = [f"{self.path}/{f}" for f in held["folders"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
