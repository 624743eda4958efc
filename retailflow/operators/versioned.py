"""Partitioned tables published in versions.

Data files are only ever added, below ``data/v<n>``; a version is a small manifest that
names, for each partition value, the version whose folder holds it. A manifest is written
aside and put in place by one rename, the last step of a publish: readers resolve one
manifest and see the whole old or the whole new content, whatever stopped in between. Going
back publishes an earlier manifest again, so the history stays, and so does what was
reverted.

There is one manifest entry for each partition value: partition by a column of bounded
range (seasons, departments).
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


class Conflict(RuntimeError):
    """Another writer has published this version."""


@dataclass
class VersionedTable:
    spark: SparkSession
    path: str
    key: str

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        return self._hadoop(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    # --- manifests -------------------------------------------------------------

    def versions(self) -> list[int]:
        found = self._files().globStatus(self._hadoop(f"{self.path}/manifest/*.json")) or []
        return sorted(int(f.getPath().getName().split(".")[0]) for f in found)

    def manifest(self, version: int) -> dict:
        """``schema`` (JSON), ``parts`` (partition folder -> version) and ``note``."""
        stream = self._files().open(self._hadoop(f"{self.path}/manifest/{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
        finally:
            stream.close()

    def _commit(self, version: int, content: dict) -> int:
        files = self._files()
        files.mkdirs(self._hadoop(f"{self.path}/manifest"))
        aside = self._hadoop(f"{self.path}/manifest/_{version}.tmp")
        stream = files.create(aside, True)
        stream.write(bytearray(json.dumps(content).encode("utf-8")))
        stream.close()
        place = self._hadoop(f"{self.path}/manifest/{version}.json")
        if files.exists(place) or not files.rename(aside, place):
            raise Conflict(f"version {version} of {self.path} is already there")
        return version

    # --- writing ---------------------------------------------------------------

    def _next(self) -> tuple[int, dict]:
        versions = self.versions()
        last = versions[-1] if versions else -1
        return last + 1, self.manifest(last) if versions else {"parts": {}}

    def _write(self, version: int, df: DataFrame) -> dict[str, int]:
        folder = f"{self.path}/data/v{version}"
        df.write.mode("overwrite").partitionBy(self.key).parquet(folder)
        made = self._files().globStatus(self._hadoop(f"{folder}/{self.key}=*")) or []
        return {f.getPath().getName(): version for f in made}

    def publish(self, df: DataFrame, values: list[str] | None = None, note: str = "") -> int:
        """Replace the partitions that ``df`` has rows of, and those named in ``values``.

        A named partition that ``df`` lacks becomes empty. Everything else stays.
        """
        version, before = self._next()
        gone = {self._folder(v) for v in values or ()}
        kept = {p: v for p, v in before["parts"].items() if p not in gone}
        parts = kept | self._write(version, df)
        return self._commit(version, {"schema": df.schema.json(), "parts": parts, "note": note})

    def overwrite(self, df: DataFrame, note: str = "") -> int:
        """Replace the whole content; ``df`` may read the table itself."""
        version, _ = self._next()
        parts = self._write(version, df)
        return self._commit(version, {"schema": df.schema.json(), "parts": parts, "note": note})

    def revert(self, version: int) -> int:
        """Make the content of ``version`` the current one; nothing is copied."""
        following, _ = self._next()
        return self._commit(following, self.manifest(version) | {"note": f"revert to {version}"})

    def vacuum(self, keep: int) -> None:
        """Delete all but the last ``keep`` manifests and data none of these names."""
        versions = self.versions()
        live = versions[-keep:]
        files, used = self._files(), set()
        for v in live:
            used |= {f"v{n}" for n in self.manifest(v)["parts"].values()}
        for v in versions[: -keep or None]:
            files.delete(self._hadoop(f"{self.path}/manifest/{v}.json"), False)
        for f in files.globStatus(self._hadoop(f"{self.path}/data/v*")) or []:
            number = int(f.getPath().getName()[1:])
            if f.getPath().getName() not in used and number <= versions[-1]:
                files.delete(f.getPath(), True)

    # --- reading ---------------------------------------------------------------

    def _folder(self, value) -> str:
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        return f"{self.key}={NO_VALUE if value is None else escape(str(value))}"

    def read(self, version: int | None = None) -> DataFrame:
        """The content of one version (the newest by default)."""
        content = self.manifest(self.versions()[-1] if version is None else version)
        schema = StructType.fromJson(json.loads(content["schema"]))
        by_version: dict[int, list[str]] = {}
        for part, v in sorted(content["parts"].items()):
            by_version.setdefault(v, []).append(f"{self.path}/data/v{v}/{part}")
        out = None
        for v, folders in by_version.items():
            reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/data/v{v}")
            df = reader.parquet(*folders).select(*schema.names)
            out = df if out is None else out.unionByName(df)
        return self.spark.createDataFrame([], schema) if out is None else out

    def journal(self) -> DataFrame:
        """One row for each version that is kept: version, note, partitions."""
        rows = [(v, m["note"], len(m["parts"])) for v in self.versions() for m in [self.manifest(v)]]
        return self.spark.createDataFrame(rows, "version bigint, note string, partitions bigint")
