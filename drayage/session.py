"""Session helpers: a local session for tests and benches, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local_scratch: dict[str, str] = {}


def local_session(app: str = "drayage", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-JVM session. A cluster job brings its own session and never calls this."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.scheduler.mode", "FAIR")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new, never reused folder below the shared folder named by ``spark.checkpoint.dir``.

    Executors on other hosts must see it, so a machine-local folder is only made up when the
    session runs in a single JVM and names none.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = _local_scratch.setdefault("dir", "") or tempfile.mkdtemp(prefix="drayage-")
        _local_scratch["dir"] = base
    return f"{base.rstrip('/')}/drayage/{purpose}-{uuid.uuid4().hex}"
