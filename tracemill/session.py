"""Session set-up, table access and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []
_SHIPPED: set[str] = set()


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tracemill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, so that they needn't have it installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parent
    # the driver serves the file as long as the application runs
    folder = tempfile.mkdtemp(prefix="tracemill-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/{root.name}-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where it is set.

    Where it is unset, our own is set: on one machine, as in tests, a new
    folder; on a cluster one beside the warehouse if that is no machine's own
    disk, else an error, since there is no folder that all executors share.
    """
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if held:
        return held
    if spark.sparkContext.master.startswith("local"):
        own = f"file://{tempfile.mkdtemp(prefix='tracemill-')}"
    else:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if warehouse.split(":", 1)[0] == "file" or ":/" not in warehouse:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = f"{warehouse}/_tracemill"
    spark.sparkContext.setCheckpointDir(own)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _delete(spark: SparkSession, path: str) -> None:
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark._jsc.hadoopConfiguration()).delete(held, True)


def _remove_written() -> None:
    session = SparkSession.getActiveSession()
    for path in _WRITTEN:
        try:
            if session is not None:
                _delete(session, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            return


atexit.register(_remove_written)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again.

    Cuts the lineage so that a lost executor costs no recomputation of what
    came before, and lets several branches read one result. Tables are removed
    at the end of the application, or by `discard` before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Removes written tables that nothing will read again, as those of a loop's last round; anything else is left alone."""
    for t in tables:
        path = getattr(t, "_written_at", None)
        if path in _WRITTEN:
            _WRITTEN.remove(path)
            _delete(t.sparkSession, path)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def tokenizer_dir() -> str:
    """Default folder of the public tokenizer files; every operator takes it as a parameter."""
    return os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
