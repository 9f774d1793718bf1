"""Session construction and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import fields, is_dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cores: int | str = 8, app_name: str = "vicinia", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="vicinia-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a written table in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_SHIPPED: set[str] = set()

#: What bounds the batches that Python workers get by bytes, as 10,000 rows may be texts of any length.
_BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Where the session does not bound the bytes of an Arrow batch, they are bound here.
    """
    sc = spark.sparkContext
    if spark.conf.get(_BATCH_BYTES[0], None) is None:
        spark.conf.set(*_BATCH_BYTES)
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="vicinia-code-")) / "vicinia.zip"
    with zipfile.ZipFile(archive, "w") as files:
        for source in sorted(package.rglob("*.py")):
            files.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """Give heavy per-row work a task per core where the input is too small to have them.

    An input of less than one file split per core, by the optimiser's estimate,
    is shuffled round-robin. A larger one already has enough splits and stays
    where it lies.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < split * cores else df


#: Tables written by :func:`cut` in this process that are not deleted yet.
_CUTS: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a table in the shared folder and drop its lineage.

    A written table outlives any executor, and later readers load only the
    columns they use.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    _CUTS.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_counting(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """:func:`cut`, with aggregates of the written rows, taken while they are written.

    Spark takes what the last stage observes once per task, however often the task runs.
    """
    seen = Observation()
    table = cut(df.observe(seen, *[value.alias(name) for name, value in counts.items()]))
    return table, seen.get


def _frames(value: object) -> Iterator[DataFrame]:
    if isinstance(value, DataFrame):
        yield value
    elif is_dataclass(value):
        for field in fields(value):
            yield from _frames(getattr(value, field.name))
    elif isinstance(value, dict | list | tuple):
        for part in value.values() if isinstance(value, dict) else value:
            yield from _frames(part)


@contextmanager
def job_tables(spark: SparkSession):
    """Delete the tables that are cut inside, but for those the kept results read.

    ``with job_tables(spark) as keep: ...; return keep(result)``
    """
    before = set(_CUTS)
    kept: list[object] = []

    def keep(result):
        kept.append(result)
        return result

    try:
        yield keep
    finally:
        used = {file.rpartition("/")[0].rpartition("/")[2] for f in _frames(kept) for file in f.inputFiles()}
        for path in [p for p in _CUTS if p not in before]:
            if path.rpartition("/")[2] not in used:
                folder = spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
                _CUTS.remove(path)
