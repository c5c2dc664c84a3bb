"""Tables that change by deltas: folders that are written once, read as one, and folded into a base from time to time.

A writer adds a numbered folder and never touches what is there, so readers of an earlier
state keep it and a repeated write of a batch changes nothing.  The state is the newest base
and all deltas after it.  What a write costs depends on its own rows.  A log has one writer
at a time: what another one adds while a base is written may fall behind that base.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


_NUMBER = re.compile(r"(delta-|batch_id=|_base-)(\d+)")


class DeltaLog:
    """Deltas ``batch_id=N`` or ``delta-N-DIGEST`` and bases ``_base-N`` (all up to N) below a folder, in one schema.

    Names with an underscore are unseen by plain readers of the folder, so a log without
    a base can be read as the parquet table that it is.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def claim(self, owner: str) -> None:
        """Let only this owner number the batches of the log; another one (a stream with another checkpoint) raises."""
        files, mark, jvm = self._files(), self._path("_owner"), self.spark._jvm
        if not files.exists(mark):
            out = files.create(mark, False)
            out.write(bytearray(owner.encode()))
            out.close()
        content = files.open(mark)
        known = jvm.org.apache.commons.io.IOUtils.toString(content, "UTF-8")
        content.close()
        if known != owner:
            raise ValueError(f"{self.folder} is the log of {known}, not of {owner}")

    def versions(self) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
        """Bases and deltas that are complete, by number."""
        files, top = self._files(), self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        names = [s.getPath().getName() for s in files.listStatus(top)] if files.exists(top) else []
        found = [(m[1], int(m[2]), n) for n in names if (m := _NUMBER.match(n)) and files.exists(self._path(f"{n}/_SUCCESS"))]
        return sorted((n, name) for kind, n, name in found if kind == "_base-"), sorted((n, name) for kind, n, name in found if kind != "_base-")

    def state(self) -> tuple[str | None, list[str]]:
        """The newest base, and the deltas after it."""
        bases, deltas = self.versions()
        last = bases[-1][0] if bases else -1
        return bases[-1][1] if bases else None, [name for n, name in deltas if n > last]

    def read(self, before: str | None = None) -> DataFrame:
        """All rows of the state; with ``before``, of the deltas in front of that one."""
        base, deltas = self.state()
        deltas = [d for d in deltas if before is None or (int(_NUMBER.match(d)[2]), d) < (int(_NUMBER.match(before)[2]), before)]
        reader = self.spark.read.schema(self.schema)
        frames = [reader.parquet(f"{self.folder}/{base}")] if base else []
        if deltas:
            frames.append(self.spark.read.schema(self.schema).option("basePath", self.folder).parquet(*(f"{self.folder}/{d}" for d in deltas)))
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], self.schema)

    def name(self, tag: str) -> str:
        """The delta of a tag (a batch of one stream, say): its own if it was written before, else the next free one."""
        digest = hashlib.sha256(tag.encode()).hexdigest()[:16]
        bases, deltas = self.versions()
        own = next((name for _, name in deltas if name.endswith(digest)), None)
        return own or f"delta-{max([n for n, _ in bases + deltas], default=-1) + 1:08d}-{digest}"

    def append(self, rows: DataFrame, name: str) -> bool:
        """Write a delta unless it is complete already; then its rows are there, and readers may be at them."""
        if self._files().exists(self._path(f"{name}/_SUCCESS")):
            return False
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return True

    def fold(self, short: Callable[[DataFrame], DataFrame], *, after: int = 0, keep: int = 2) -> bool:
        """Write a base of the state, made shorter, once more than ``after`` deltas have gathered; then forget what is behind older bases.

        The newest ``keep`` bases and all that is after the oldest of them stay, for readers
        that planned before this one.
        """
        base, deltas = self.state()
        if len(deltas) <= after:
            return False
        last = int(_NUMBER.match(deltas[-1])[2])
        short(self.read()).write.mode("overwrite").parquet(f"{self.folder}/_base-{last:08d}")
        bases, deltas = self.versions()
        if len(bases) > keep:
            border = bases[-keep][0]
            for n, name in bases + deltas:
                if n < border or n == border and not name.startswith("_base-"):
                    self._files().delete(self._path(name), True)
        return True
