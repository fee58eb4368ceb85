"""Versioned folders behind one pointer: readers see one version whole, whatever its columns, while the next is written.

A table is a folder. Rows go to a folder of their own below it; ``_versions`` holds one small file per version, named by its
number, that tells which. A writer takes the next number by a rename that fails if the number is taken: of two
writers one wins, and the other gets ``Outpaced`` and may look again. Nothing is ever absent in between, and a crash
leaves at most a folder that no pointer names, which ``remove_old`` clears away.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTERS = "_versions"


class Outpaced(RuntimeError):
    """Another writer made the version that this one was about to make."""


@dataclass(frozen=True)
class Version:
    number: int
    folder: str
    schema: str
    rows: int


class VersionedTable:
    """A table at ``path`` of the store that Spark reaches under it."""

    def __init__(self, spark: SparkSession, path: str, fmt: str = "parquet"):
        self.spark, self.path, self.fmt = spark, path.rstrip("/"), fmt
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    def _list(self, folder: str) -> list:
        at = self._path(folder)
        return [s.getPath() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _read(self, number: int) -> Version:
        stream = self._fs.open(self._path(f"{self.path}/{POINTERS}/{number:010d}"))
        try:
            content = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(number, **json.loads(content))

    def numbers(self) -> list[int]:
        return sorted(int(p.getName()) for p in self._list(f"{self.path}/{POINTERS}") if p.getName().isdigit())

    def current(self) -> Version | None:
        known = self.numbers()
        return self._read(known[-1]) if known else None

    def read(self, number: int | None = None) -> DataFrame:
        """Rows of one version, the newest by default. What it reads stays the same whatever is written later."""
        version = self.current() if number is None else self._read(number)
        if version is None:
            raise FileNotFoundError(f"{self.path} has no version")
        schema = T.StructType.fromJson(json.loads(version.schema))
        return self.spark.read.schema(schema).format(self.fmt).load(f"{self.path}/{version.folder}")

    def write(self, df: DataFrame, after: int | None = None) -> Version:
        """Make ``df`` the next version, schema included.

        ``after`` is the number that the new rows follow from (the newest by default, 0 for none): if another version has
        come since, nothing changes and ``Outpaced`` is raised. Rows are counted while they are written and again where
        they lie.
        """
        last = (self.numbers() or [0])[-1] if after is None else after
        folder = f"v-{uuid.uuid4().hex[:12]}"
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format(self.fmt).mode("errorifexists").save(f"{self.path}/{folder}")
        written = self.spark.read.schema(df.schema).format(self.fmt).load(f"{self.path}/{folder}").count()
        if written != seen.get["rows"]:
            raise RuntimeError(f"{self.path}: {seen.get['rows']} rows read, {written} written")
        version = Version(last + 1, folder, df.schema.json(), written)
        self._point(version)
        return version

    def _point(self, version: Version) -> None:
        """Enter a version under its number, if that is free and follows the newest one."""
        target = self._path(f"{self.path}/{POINTERS}/{version.number:010d}")
        if (self.numbers() or [0])[-1] != version.number - 1:
            raise Outpaced(f"{self.path}: version {version.number} doesn't follow the newest one")
        aside = self._path(f"{self.path}/{POINTERS}/.{uuid.uuid4().hex}")
        content = {"folder": version.folder, "schema": version.schema, "rows": version.rows}
        stream = self._fs.create(aside, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(aside, target, options)  # fails where the target is there
        except Py4JJavaError as failure:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in failure.java_exception.getClass().getName():
                raise Outpaced(f"{self.path}: version {version.number} is taken") from None
            raise

    def remove_old(self, keep: int = 2) -> list[str]:
        """Remove versions before the newest ``keep``, and folders that a crash left; returns the folders that went.

        A reader that started before may still be at work on a version, and a writer on a folder without pointer: call this
        when both are older than any job.
        """
        numbers = self.numbers()
        kept = {self._read(n).folder for n in numbers[-keep:]}
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.path}/{POINTERS}/{n:010d}"), False)
        gone = [p for p in self._list(self.path) if p.getName().startswith("v-") and p.getName() not in kept]
        for p in gone:
            self._fs.delete(p, True)
        return sorted(p.getName() for p in gone)
