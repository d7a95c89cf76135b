"""SparkSession construction and the shared checkpoint location.

Cluster jobs must cut lineage into the shared folder named by
``spark.checkpoint.dir``; only when that is unset (local tests) do we
create a scratch folder of our own.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # operators checkpoint small planning tables; remove them once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "velocis", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults.

    On a cluster ``master`` stays None and the launcher decides; tests pass
    ``local[*]`` and a small shuffle partition count.
    """
    _export_pythonpath()
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    checkpoint_dir(spark)
    return spark


def _export_pythonpath() -> None:
    """Put the package root on PYTHONPATH before the JVM starts, so Python
    processes the JVM launches (workers, the streaming runner that sets up
    stateful processors) can import the package."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    cur = os.environ.get("PYTHONPATH", "")
    if root not in cur.split(os.pathsep):
        os.environ["PYTHONPATH"] = root + (os.pathsep + cur if cur else "")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder. Only a local master may leave it unset (a
    scratch folder is made then); elsewhere that is an error, since driver
    and executors would each see a folder of their own."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="velocis-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint location for written tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, name) if "://" not in base else base.rstrip("/") + "/" + name


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Add this package as a zip (``addPyFile``, as ``--py-files`` would), so
    executors' Python workers can import it. Once per application."""
    import zipfile
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    fd, zpath = tempfile.mkstemp(prefix="velocis-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)


def ship_package(spark: SparkSession) -> None:
    """``ship_code``, and serialise the package's functions and classes by
    value: the driver-side runner that sets up stateful processors does not
    see ``addPyFile`` includes and could not import them."""
    import velocis
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(velocis)
    ship_code(spark)
