"""What the operators share: the shared folder, cutting lineage, column names, ranks within skewed groups."""

from __future__ import annotations

import contextlib
import itertools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than these six; the same class is used by all operators.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or on a local master a new local one where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidewire-", dir=os.environ.get("TIDEWIRE_LOCAL_SCRATCH"))
        spark.sparkContext.setCheckpointDir(folder)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark reads it by, so that files written beside Spark land in the same store."""
    full = _path(spark, path)[1].toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def _path(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store, store.makeQualified(hadoop)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{qualified(spark, shared_folder(spark)).rstrip('/')}/tidewire/{name}-{uuid.uuid4().hex}"


_STEPS: list[list[str]] = []


@contextlib.contextmanager
def passing_steps(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that :func:`materialize` writes inside, at the end: what is wanted of them must be written before."""
    _STEPS.append([])
    try:
        yield
    finally:
        for path in _STEPS.pop():
            store, at = _path(spark, path)
            store.delete(at, True)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: lineage ends here, on storage that outlives executors."""
    path = new_folder(df.sparkSession, name)
    if _STEPS:
        _STEPS[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def source_bytes(df: DataFrame) -> int:
    """What the sources of ``df`` hold by Spark's estimate, of files their size; one that it doesn't know counts as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)


def parts_for(df: DataFrame, part_bytes: int = 256 << 20) -> int:
    """Partitions for a shuffle of all of ``df``: those of the session, or more if its sources would make them larger than ``part_bytes``."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-source_bytes(df) // part_bytes))


def materialize_counted(df: DataFrame, name: str = "step", **counts: Column) -> tuple[DataFrame, Row]:
    """:func:`materialize`, and with it numbers that are gathered while the rows are written: ``n`` and those of ``counts``."""
    seen = Observation()
    rows = materialize(df.observe(seen, F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(k) for k, c in counts.items()]), name)
    return rows, Row(**seen.get)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first ``name_k`` that no column of ``df`` has, compared without case."""
    taken = {c.lower() for c in df.columns}
    return next(x for x in itertools.chain([name], (f"{name}_{k}" for k in itertools.count(1))) if x.lower() not in taken)


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(col(name).cast("string"), F.lit(""))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once; inside a lambda an outer expression would be computed for each element."""
    return F.transform(F.array(value), then)[0]


def row_hash(df: DataFrame, but: Sequence[str] = (), seed: int | None = None) -> Column:
    """A 64-bit hash over all columns that can be hashed; rows that are equal throughout have equal hashes. Another seed gives another hash."""
    fit = [f.name for f in df.schema.fields if f.name not in but and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    columns = [col(x) for x in fit] if seed is None else [F.lit(seed), *map(col, fit)]
    return F.xxhash64(*columns) if columns else F.lit(0).cast("long")


#: Rows of a cell that :func:`ranked` numbers in one task, if salts are chosen by :func:`salts_for`.
CELL = 2_000_000


def salts_for(rows: int, least: int = 64) -> int:
    """Salts for a group of up to ``rows`` rows, so that a cell stays small however large the group is."""
    return max(least, -(-rows // CELL))


def ranked(df: DataFrame, group: Sequence[str], within: Sequence[Column], salt_of: Column, rank: str, salts: int = 64, strata: Column | None = None) -> DataFrame:
    """Adds ``rank`` (from 0, gapless) within ``group``, without ever gathering a group in one task.

    A group is cut into cells by ``strata`` (a coarse integer that comes first in the order) and a salt. Rows are
    numbered inside cells, and cells are placed by the running sum of their counts, a table with at most
    ``salts`` x strata rows a group whatever the input. ``df`` is read twice, so it should be materialized.
    """
    cell = [*group, "_stratum", "_salt"]
    cut = df.withColumn("_stratum", strata if strata is not None else F.lit(0)).withColumn("_salt", F.pmod(salt_of, F.lit(salts)))
    counts = cut.groupBy(*[col(c) for c in cell]).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*[col(c) for c in group]).orderBy("_stratum", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n").select(*[col(c).alias(f"_p_{c}") for c in cell], "_before")
    numbered = cut.withColumn("_k", F.row_number().over(Window.partitionBy(*[col(c) for c in cell]).orderBy(*within)) - 1)
    joined = numbered.join(placed, [col(c).eqNullSafe(col(f"_p_{c}")) for c in cell], "inner")
    return joined.withColumn(rank, col("_before") + col("_k")).drop("_stratum", "_salt", "_k", "_before", *[f"_p_{c}" for c in cell])
