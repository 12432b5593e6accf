"""Published tables with versions: IO3 and IO5 as commits, and claimed numbers for the run log.

Rows are written aside as Parquet under ``<table>/data/<uuid>``. A commit then
puts a small manifest ``<table>/versions/<number>`` (each part's name and data
folder) under a number that did not exist: the manifest is written under a
temporary name and renamed without overwriting. Readers take the newest
manifest, so they see all of a commit or nothing; a job killed before its
commit leaves the old version readable, and ``vacuum`` removes what no kept
version names. Of two writers that commit at once one takes the next number
and the other starts again from its result. A part is a wave or a snapshot
date; a rerun replaces its part.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlens.sources.tables import merge_by_key

Parts = dict[str, str]


@dataclass(frozen=True)
class VersionedTables:
    spark: SparkSession
    root: str

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root.rstrip("/"), *names]))

    def _fs(self):
        path = self._path()
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[int]:
        fs, folder = self._fs(), self._path(name, "versions")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()) if fs.exists(folder) else []

    def parts(self, name: str, version: int | None = None) -> Parts:
        """Data folder of each part in the given (else the newest) version; none before the first commit."""
        have = self.versions(name)
        if not have:
            return {}
        path = self._path(name, "versions", f"{have[-1] if version is None else version:012d}")
        return json.loads(self.spark.read.text(path.toString(), wholetext=True).first()[0])

    def _put(self, name: str, version: int, text: str) -> bool:
        """Put a manifest under an unused number; False if another writer has taken it."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        temporary = self._path(name, "versions", f".{uuid.uuid4().hex}")
        fs = self._fs()
        fs.mkdirs(temporary.getParent())
        out = fs.create(temporary, False)
        out.write(bytearray(text.encode()))
        out.close()
        none = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
        try:
            context.rename(fs.makeQualified(temporary), fs.makeQualified(self._path(name, "versions", f"{version:012d}")), none)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            fs.delete(temporary, False)
            return False

    def commit(self, name: str, change: Callable[[Parts], Parts]) -> int:
        """Put ``change`` of the newest parts as the next version; made anew when another writer was first."""
        while True:
            have = self.versions(name)
            version = have[-1] + 1 if have else 1
            if self._put(name, version, json.dumps(change(self.parts(name, have[-1]) if have else {}))):
                return version

    def write_aside(self, df: DataFrame, name: str) -> str:
        path = self._path(name, "data", uuid.uuid4().hex).toString()
        df.write.parquet(path)
        return path

    def read(self, name: str, version: int | None = None, part: str | None = None) -> DataFrame:
        paths = self.parts(name, version)
        chosen = list(paths.values()) if part is None else [paths[part]]
        return self.spark.read.option("mergeSchema", "true").parquet(*chosen)

    def replace(self, name: str, new: Mapping[str, DataFrame]) -> int:
        """IO3: put each part's rows in place of what it held; other parts stay."""
        written = {part: self.write_aside(df, name) for part, df in new.items()}
        return self.commit(name, lambda old: {**old, **written})

    def publish_snapshot(self, df: DataFrame, name: str = "customer_features_fs",
                         keys: tuple[str, ...] = ("customer_id", "feature_ts")) -> int:
        """IO5: merge rows into the parts of their days: all new rows, and old ones whose key is not among them."""
        day = F.to_date("feature_ts")
        days = sorted(str(r[0]) for r in df.select(day).distinct().collect())  # the days of one publication

        def merged(old: Parts) -> Parts:
            out = {}
            for d in days:
                new = df.where(day == F.lit(d).cast("date"))
                out[d] = self.write_aside(merge_by_key(new, self.spark.read.parquet(old[d]), keys) if d in old else new, name)
            return {**old, **out}

        return self.commit(name, merged)

    def claim(self, name: str) -> int:
        """The next number of ``name``, which no other writer gets."""
        return self.commit(name, lambda old: old)

    def vacuum(self, name: str, keep: int = 1) -> int:
        """Delete data that none of the newest ``keep`` versions names (jobs under way not among them); how many folders went."""
        fs, folder = self._fs(), self._path(name, "data")
        held = {p.rsplit("/", 1)[1] for v in self.versions(name)[-keep:] for p in self.parts(name, v).values()}
        gone = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName() not in held] if fs.exists(folder) else []
        for path in gone:
            fs.delete(path, True)
        return len(gone)
