"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

PLAN_TEXT = 1 << 16
_made: dict[SparkSession, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a session on this machine alone (tests) gets a temporary folder; any other an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="foliospark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextlib.contextmanager
def _short_plans(spark: SparkSession):
    """The driver keeps a text of each plan, in which tables of constants would stand in full; a part of it is enough."""
    name, old = "spark.sql.maxPlanStringLength", spark.conf.get("spark.sql.maxPlanStringLength")
    spark.conf.set(name, str(PLAN_TEXT))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def saved(df: DataFrame, name: str, buckets: tuple[int, str] | None = None, **options) -> DataFrame:
    """Writes the rows as Parquet in the shared folder and reads them again, which cuts the lineage. buckets: how many, by which
    column; a later join or grouping by that column then reads them in place, without a shuffle.

    Shuffle files that nothing refers to any more can go then. The table goes with `forget`, at the latest when Python ends.
    """
    spark = df.sparkSession
    key = uuid.uuid4().hex
    path, writer = f"{shared_dir(spark)}/{name}-{key}", df.write.option("compression", "zstd").options(**options)
    with _short_plans(spark):
        if buckets:
            writer.format("parquet").bucketBy(*buckets).option("path", path).saveAsTable(f"{name}_{key}")
        else:
            writer.parquet(path)
    if spark not in _made:
        atexit.register(_remove, spark)
    _made.setdefault(spark, []).append(path)
    out = spark.table(f"{name}_{key}") if buckets else spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that `saved` made and that no later query reads; others stay as they are."""
    for t in tables:
        path = t.__dict__.get("saved_at")
        if path and path in _made.get(t.sparkSession, []):
            _delete(t.sparkSession, path)
            _made[t.sparkSession].remove(path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner find the shuffle files of queries that have ended, and the system have the driver's free memory."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    with contextlib.suppress(Py4JError):  # not every JVM has the command
        _trim(spark)


def _trim(spark: SparkSession) -> None:
    """Returns to the system what the driver's JVM has freed outside its heap: compilers of long queries leave much there."""
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    text, bean = jvm.java.lang.String, jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    kinds = [bean.getClass(), jvm.java.lang.Class.forName("java.lang.String"), jvm.java.lang.Class.forName("[Ljava.lang.Object;"), jvm.java.lang.Class.forName("[Ljava.lang.String;")]
    types, values = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
    for i, (kind, value) in enumerate(zip(kinds, [bean, "systemTrimNativeHeap", gateway.new_array(jvm.java.lang.Object, 0), gateway.new_array(text, 0)])):
        types[i], values[i] = kind, value
    # by the interface's method, as the server's own class isn't open
    invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", types)
    invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _remove(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):
        for path in _made.pop(spark, []):
            _delete(spark, path)
