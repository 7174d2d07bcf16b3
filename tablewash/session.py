"""Session helpers: a tuned local session for tests/bench and a shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid

from pyspark.sql import SparkSession


def local_session(
    cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tablewash", conf: dict | None = None
) -> SparkSession:
    """Local session used by tests and bench. Clusters pass their own session."""
    builder = SparkSession.builder
    for k, v in (conf or {}).items():
        builder = builder.config(k, v)
    spark = (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # checkpoint files are deleted once their DataFrame is no longer referenced
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared folder (HDFS / object store) and is
    used as is. Only when it is unset (tests) a private temporary folder is made.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the context
        if not path:
            raise ValueError("set spark.checkpoint.dir to a shared folder on the Spark Connect server") from None
        return path
    path = path or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder (HDFS / object store) for this cluster")
        path = tempfile.mkdtemp(prefix="tablewash-ckpt-")  # local mode only: one machine
        spark.conf.set("spark.checkpoint.dir", path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tablewash/{name}-{uuid.uuid4().hex[:12]}"


def is_local_path(path: str) -> bool:
    return "://" not in path or path.startswith("file:")


def local_os_path(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


def make_local_dirs(path: str) -> None:
    if is_local_path(path):
        os.makedirs(local_os_path(path), exist_ok=True)


_SHIPPED: set[str] = set()
_SHIP_LOCK = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Make ``tablewash`` importable in Python workers (for mapInPandas).

    Zips the package once per application and registers it with
    ``SparkContext.addPyFile`` (what ``spark-submit --py-files`` does): the zip
    is read only by the driver, and Spark copies it to every executor and puts
    it on the workers' path. A no-op when already shipped in this application."""
    import zipfile
    from pathlib import Path

    try:
        sc = spark.sparkContext
        app = sc.applicationId
    except Exception:  # noqa: BLE001 - Spark Connect session
        sc, app = None, f"connect:{spark.session_id}"
    with _SHIP_LOCK:  # jobs started from several threads ship the package once
        if app in _SHIPPED:
            return
        pkg = Path(__file__).resolve().parent
        out = Path(tempfile.mkdtemp(prefix="tablewash-pkg-")) / "tablewash.zip"
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for f in pkg.rglob("*.py"):
                z.write(f, str(Path("tablewash") / f.relative_to(pkg)))
        if sc is not None:
            sc.addPyFile(str(out))
        else:
            spark.addArtifacts(str(out), pyfile=True)
        _SHIPPED.add(app)
