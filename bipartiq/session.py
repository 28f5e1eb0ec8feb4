"""Sessions, the shared folder for intermediate tables, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import io
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []
_SHIPPED: set[str] = set()
#: Seconds of a written step beyond which its shuffle files are worth a garbage collection of the driver.
LONG_S = 5.0


def local_session(name: str = "bipartiq", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for one machine; on a cluster use the session that spark-submit gives."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it.

    Where the setting is absent a local master gets a temporary folder of its
    own. A cluster master gets a folder beside its warehouse if that lies in a
    shared file system; the default warehouse is a folder of each machine, where
    other machines' rows would be lost, so there it raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        if spark.sparkContext.master.startswith("local"):
            _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="bipartiq-")
        else:
            warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
            if warehouse.split(":")[0] in ("file", "local") or ":" not in warehouse:
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            _OWN_DIR[app] = warehouse + "/_bipartiq"
    return _OWN_DIR[app]


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: lineage ends here.

    The copy outlives any executor, so a lost executor never repeats the work
    before it, and each later use costs one scan. Copies go when the driver
    ends, or earlier through ``drop_materialized``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/bipartiq/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    began = time.monotonic()
    df.write.parquet(path)
    if time.monotonic() - began > LONG_S:
        spark.sparkContext._jvm.System.gc()  # else the step's shuffle files stay until the driver happens to collect its garbage
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized() -> None:
    """Delete every table that ``materialize`` wrote; DataFrames on them are dead afterwards."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session is gone, and its folder is the cluster's to clean
            return


atexit.register(drop_materialized)


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int = 100, limit: int = 32 << 20) -> DataFrame:
    """Hint a broadcast only where the counted rows prove the table small.

    A row of a hashed table takes about twice its own bytes. Beyond the limit the
    join shuffles, where adaptive execution splits hot keys.
    """
    return F.broadcast(df) if 2 * rows * row_bytes <= limit else df


def neutral_names(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """df with its key columns named k0__, k1__, ... so that no key clashes with a working column."""
    names = [f"k{i}__" for i in range(len(keys))]
    others = [F.col(f"`{c}`") for c in df.columns if c not in keys]
    return df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], *others), names


def named_back(df: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """The inverse: working names of keys give way to their own."""
    own = dict(zip(names, keys))
    return df.select(*[F.col(c).alias(own.get(c, c)) for c in df.columns])


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application.

    It travels as a zip file through the shared folder, so nothing needs to be
    installed on the machines or named in their paths.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, f"{root.name}/{source.relative_to(root)}")
    path = f"{shared_dir(spark)}/bipartiq/package-{uuid.uuid4().hex}/{root.name}.zip"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = files.create(target)
    stream.write(packed.getvalue())
    stream.close()
    files.deleteOnExit(target.getParent())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def slices(batches: Iterator[pa.RecordBatch], rows: int, size: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of so many rows and about so many bytes at most, a row at least.

    Whatever the session's own limits are: this bounds what a step works on at once.
    """
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            part = batch.slice(start, rows)
            while part.num_rows > 1 and part.nbytes > size:
                part = part.slice(0, part.num_rows // 2)
            yield part
            start += part.num_rows
