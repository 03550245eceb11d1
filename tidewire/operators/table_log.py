"""A stored table as a log of deltas: a write costs what its own rows cost, and writers that meet both win.

Rows of a write go to a folder of their own. A commit is an entry in the log, a small file whose number must be free: its creation is atomic, so of
two writers that want one number the second takes the next. A read merges the entries by key, the newer row over the older
one or the other way round. Compaction writes the merged rows as one entry, which takes the place of those it has read and of no later ones.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Deltas that are merged at a read before a write compacts them.
COMPACT_AT = 32


class TableLog:
    def __init__(self, spark: SparkSession, folder: str, keys: list[str], keep_first: bool = False, compact_at: int = COMPACT_AT):
        self.spark, self.folder, self.keys, self.keep_first, self.compact_at = spark, folder.rstrip("/"), keys, keep_first, compact_at

    def _fs(self, of: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(of)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs, fs.makeQualified(path)

    def entries(self) -> dict[int, dict]:
        """Committed entries by number; a number that was claimed but never written is passed over."""
        fs, top = self._fs(f"{self.folder}/log")
        if not fs.exists(top):
            return {}
        out = {}
        for status in fs.listStatus(top):
            name = status.getPath().getName()
            if name.endswith(".json") and not name.startswith(".") and status.getLen():
                with_text = fs.open(status.getPath())
                try:
                    text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(with_text, "UTF-8")
                finally:
                    with_text.close()
                out[int(name.removesuffix(".json"))] = json.loads(text)
        return dict(sorted(out.items()))

    def _claimed(self, number: int, text: str) -> bool:
        fs, path = self._fs(f"{self.folder}/log/{number:012d}.json")
        if path.toUri().getScheme() == "file":  # Hadoop's local files are not created exclusively
            fs.mkdirs(path.getParent())
            try:
                with open(path.toUri().getPath(), "x") as out:
                    out.write(text)
                return True
            except FileExistsError:
                return False
        if fs.exists(path):
            return False
        try:
            out = fs.create(path, False)
        except Exception as e:  # the store's own word for a file that exists
            if "FileAlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _commit(self, entry: dict) -> int:
        fs, top = self._fs(f"{self.folder}/log")
        taken = [int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(top) if s.getPath().getName().endswith(".json") and not s.getPath().getName().startswith(".")] if fs.exists(top) else []
        number = max(taken, default=0) + 1
        while not self._claimed(number, json.dumps(entry)):
            number += 1
        return number

    def _written(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/data/{name}")
        return name

    def append(self, rows: DataFrame) -> int:
        """Commits ``rows``, of equal keys one, and tells the entry's number. Nothing that was stored before is read or written."""
        number = self._commit({"data": self._written(rows.dropDuplicates(self.keys))})
        if len(self._live()[1]) > self.compact_at:
            self.compact()
        return number

    def _live(self) -> tuple[int, dict[int, dict]]:
        """The entry up to which a compaction holds everything, and the entries that a read merges."""
        all_ = self.entries()
        packed = max((n for n, e in all_.items() if "upto" in e), key=lambda n: (all_[n]["upto"], n), default=None)
        upto = all_[packed]["upto"] if packed is not None else 0
        live = {n: e for n, e in all_.items() if n > upto and "upto" not in e}
        return upto, ({upto: all_[packed]} if packed is not None else {}) | live

    def _merged(self, live: dict[int, dict]) -> DataFrame | None:
        out = None
        for n, e in live.items():
            own = self.spark.read.parquet(f"{self.folder}/data/{e['data']}").withColumn("_entry", F.lit(n))
            out = own if out is None else out.unionByName(own, allowMissingColumns=True)
        if out is None or len(live) == 1:  # one entry has a key once
            return out.drop("_entry") if out is not None else None
        columns = [c for c in out.columns if c != "_entry"]
        pick = (F.min_by if self.keep_first else F.max_by)(F.struct(*columns), F.col("_entry"))
        return out.groupBy(*self.keys).agg(pick.alias("_row")).select("_row.*")

    def read(self) -> DataFrame | None:
        """The table as it is now, or None before the first write."""
        return self._merged(self._live()[1])

    def compact(self) -> int | None:
        """Writes what entries up to now hold as one; entries that are committed meanwhile stay beside it."""
        _, live = self._live()
        if len(live) < 2:
            return None
        return self._commit({"data": self._written(self._merged(live)), "upto": max(live)})
