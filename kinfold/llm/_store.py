"""Tables that cut lineage: written to the cluster's shared folder, so that a lost executor costs nothing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the context's checkpoint folder.

    Where neither is set, a session on one machine (as in tests) gets a temporary folder of its own; on a cluster, where
    executors would not see it, this is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="kinfold-")
            atexit.register(shutil.rmtree, _own[app], True)
        found = f"file://{_own[app]}"
    return found.rstrip("/")


_tables: list[tuple[str, object, object]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The table goes once no plan reads it any more, at the latest when the application ends. So whoever turns a result into an
    RDD keeps its DataFrame as long.
    """
    spark = df.sparkSession
    sweep(spark)
    path = f"{shared_dir(spark)}/kinfold-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    trim(spark)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    # Every plan that reads the table, be it copied or optimised, comes from one that has this very list of its files.
    files = out._jdf.queryExecution().analyzed().relation().location()
    _tables.append((spark.sparkContext.applicationId, spark.sparkContext._jvm.java.lang.ref.WeakReference(files), folder))
    return out


def sweep(spark: SparkSession) -> None:
    """Delete the tables whose plans the JVM has collected."""
    app, conf = spark.sparkContext.applicationId, spark.sparkContext._jsc.hadoopConfiguration()
    for entry in [t for t in _tables if t[0] == app and t[1].get() is None]:
        entry[2].getFileSystem(conf).delete(entry[2], True)
        _tables.remove(entry)


BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that long texts don't decide what a Python worker and its executor need.

    Spark reads this when a plan runs, which is after the operator has returned, so the setting stays with the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def trim(spark: SparkSession) -> bool:
    """Return to the system what the driver's JVM has freed outside its heap: planning a query leaves some in each thread's pool.

    By reflection, as the server's own class is not open to callers.
    """
    jvm = spark.sparkContext._jvm

    def array(kind, items: list):
        out = spark.sparkContext._gateway.new_array(kind, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    try:
        of = jvm.java.lang.Class.forName
        kinds = [of(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        invoke = of("javax.management.MBeanServerConnection").getMethod("invoke", array(jvm.java.lang.Class, kinds))
        command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(jvm.java.lang.Object, [command, "systemTrimNativeHeap", None, None]))
    except Py4JError:  # not this JVM
        return False
    return True


def free(spark: SparkSession) -> None:
    """Let go of tables and shuffle files whose DataFrames are gone: Spark frees these when the driver collects garbage."""
    import gc

    from kinfold.llm._kernel import give_back

    gc.collect()
    give_back()
    spark.sparkContext._jvm.System.gc()
    trim(spark)
    sweep(spark)
