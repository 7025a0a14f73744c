"""An append log of keyed rows: what an upsert writes follows its batch, not the table.

A commit writes its rows, and tombstones of deleted keys, to a folder of its own and then publishes a
manifest, a small file that names the folders of a version. Readers take the folders of one manifest, so
they see whole commits only, and the last row of each key. Compaction writes that view as one folder and
publishes it; folders that the latest versions don't name are deleted later.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import deleted

#: Times that a commit is tried while others publish before it.
TRIES = 20


class Log:
    """The log at ``path`` of rows of ``schema``, which ``keys`` tell apart; ``partition`` names a key to lay rows out by."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], partition: str | None = None):
        self.spark, self.path, self.schema, self.keys, self.partition = spark, path.rstrip("/"), schema, keys, partition

    def _hadoop(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _versions(self) -> list[str]:
        folder = self._hadoop("_manifests")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        return sorted(n for s in files.listStatus(folder) if (n := s.getPath().getName()).endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """A version, the latest unless one is given: its number, its folders in order, and the last batch of each stream."""
        names = [n for n in self._versions() if version is None or int(n.split(".")[0]) == version]
        if not names:
            return {"version": 0, "folders": [], "streams": {}}
        path = self._hadoop(f"_manifests/{names[-1]}")
        source = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def _published(self, manifest: dict) -> bool:
        """Put a manifest in its place as a whole; False if another commit took the number."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        aside, place = self._hadoop(f"_manifests/.{uuid.uuid4().hex}"), self._hadoop(f"_manifests/{manifest['version']:012d}.json")
        files = aside.getFileSystem(conf)
        aside, place = files.makeQualified(aside), files.makeQualified(place)
        sink = files.create(aside, False)
        sink.write(bytearray(json.dumps(manifest).encode()))
        sink.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), conf).rename(aside, place, options)
        except Exception as error:  # noqa: BLE001
            files.delete(aside, False)
            if "FileAlreadyExistsException" not in str(error):
                raise
            return False
        return True

    def _write(self, rows: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        writer = rows.write
        (writer.partitionBy(self.partition) if self.partition else writer).parquet(f"{self.path}/{folder}")
        return folder

    def append(self, rows: DataFrame | None = None, gone: DataFrame | None = None, sequence: Column | None = None, stream: str | None = None, batch: int | None = None) -> int:
        """Commit ``rows`` and the deletion of the keys of ``gone``, and return the version that has them.

        Of several rows of a key in one commit the highest by ``sequence`` is kept, and a deletion comes before
        rows. A ``batch`` of a ``stream`` that is in the log already isn't written again.
        """
        now = self.manifest()
        if stream is not None and now["streams"].get(stream, -1) >= batch:
            return now["version"]
        if rows is None and gone is None:
            raise ValueError("neither rows nor keys to delete")
        parts = []
        if rows is not None:
            parts.append(rows.select(*self.schema.names, (sequence if sequence is not None else F.lit(None)).cast("double").alias("_order"), F.lit(False).alias("_gone")))
        if gone is not None:
            rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name not in self.keys]
            parts.append(gone.select(*self.keys, *rest, F.lit(None).cast("double").alias("_order"), F.lit(True).alias("_gone")))
        both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        place = F.row_number().over(Window.partitionBy(*self.keys).orderBy(F.col("_gone"), F.col("_order").desc_nulls_last()))
        last = both.withColumn("_place", place).filter("_place = 1").drop("_place", "_order")
        folder = self._write(last)
        for _ in range(TRIES):
            now = self.manifest()
            if stream is not None and now["streams"].get(stream, -1) >= batch:
                return now["version"]
            streams = now["streams"] | ({stream: batch} if stream is not None else {})
            made = {"version": now["version"] + 1, "folders": [*now["folders"], folder], "streams": streams}
            if self._published(made):
                return made["version"]
        raise RuntimeError(f"{TRIES} other commits came first")

    def read(self, version: int | None = None) -> DataFrame:
        """The last row of each key that isn't deleted, of the latest version or an earlier one."""
        return self._view(self.manifest(version)["folders"])

    def _view(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        stored = StructType(list(self.schema.fields)).add("_gone", "boolean")
        rows = None
        for number, folder in enumerate(folders):
            own = self.spark.read.schema(stored).parquet(f"{self.path}/{folder}").select(*self.schema.names, "_gone", F.lit(number).alias("_commit"))
            rows = own if rows is None else rows.unionByName(own)
        if len(folders) > 1:
            place = F.row_number().over(Window.partitionBy(*self.keys).orderBy(F.col("_commit").desc()))
            rows = rows.withColumn("_place", place).filter("_place = 1")
        return rows.filter(~F.col("_gone")).select(*self.schema.names)

    def compact(self) -> int:
        """Write the latest view as one folder and publish it; commits that come meanwhile stay behind it."""
        start = self.manifest()
        folder = self._write(self._view(start["folders"]).withColumn("_gone", F.lit(False)))
        for _ in range(TRIES):
            now = self.manifest()
            if now["folders"][: len(start["folders"])] != start["folders"]:
                deleted(self.spark, f"{self.path}/{folder}")  # compacted by another
                return now["version"]
            made = now | {"version": now["version"] + 1, "folders": [folder, *now["folders"][len(start["folders"]) :]]}
            if self._published(made):
                return made["version"]
        raise RuntimeError(f"{TRIES} other commits came first")

    def vacuum(self, keep: int = 1) -> int:
        """Delete what only versions before the last ``keep`` have, and return how many folders went.

        No commit may be under way, as its folder isn't in a version yet."""
        names = self._versions()
        old, kept = names[:-keep], names[-keep:]
        wanted = {f for n in kept for f in self.manifest(int(n.split(".")[0]))["folders"]}
        data = self._hadoop("data")
        files = data.getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = [f for s in (files.listStatus(data) if files.exists(data) else []) if (f := f"data/{s.getPath().getName()}") not in wanted]
        for name in [*(f"_manifests/{n}" for n in old), *gone]:
            deleted(self.spark, f"{self.path}/{name}")
        return len(gone)
