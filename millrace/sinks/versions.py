"""What belongs to a stored table now: numbered lists of files or folders, the newest one counts.

Jobs write new files beside the old ones and then publish a list that names them. A job that fails
publishes nothing, so its files are never read; of two writers that start from one version only
the first can publish the next.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

FOLDER = "_versions"


class VersionConflict(RuntimeError):
    """Another writer has published first."""


class Versions:
    """The published lists of one table."""

    def __init__(self, spark: SparkSession, table: str):
        self._jvm = spark._jvm
        self._folder = self._path(f"{table.rstrip('/')}/{FOLDER}")
        self._files = self._folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def current(self) -> tuple[int, list[str]]:
        """The newest version and its entries; version 0 has none."""
        if not self._files.exists(self._folder):
            return 0, []
        names = [entry.getPath().getName() for entry in self._files.listStatus(self._folder)]
        numbers = [int(name) for name in names if name.isdigit()]
        if not numbers:
            return 0, []
        stream = self._files.open(self._path(f"{self._folder}/{max(numbers):012d}"))
        try:
            return max(numbers), self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
        finally:
            stream.close()

    def publish(self, after: int, entries: list[str]) -> int:
        """Make ``entries`` the version that follows ``after``."""
        if self.current()[0] != after:
            raise VersionConflict(f"version {after} is not the newest any more")
        self._files.mkdirs(self._folder)
        target = self._path(f"{self._folder}/{after + 1:012d}")
        draft = self._path(f"{self._folder}/draft-{self._jvm.java.util.UUID.randomUUID()}")
        stream = self._files.create(draft, False)
        stream.write("\n".join(entries).encode())
        stream.close()
        if self._files.exists(target) or not self._files.rename(draft, target):
            self._files.delete(draft, False)
            raise VersionConflict(f"version {after + 1} has been published by another writer")
        return after + 1

    def siblings(self, table: str, prefix: str, named: list[str]) -> list[str]:
        """Folders of the table that begin with ``prefix`` and are not named."""
        known = {entry.rstrip("/").rsplit("/", 1)[1] for entry in named}
        found = [entry.getPath() for entry in self._files.listStatus(self._path(table.rstrip("/")))]
        return [str(path) for path in found if path.getName().startswith(prefix) and path.getName() not in known]

    def delete(self, entries: list[str]) -> None:
        """Remove what no reader needs any more."""
        for entry in entries:
            self._files.delete(self._path(entry), True)
