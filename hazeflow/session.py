"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime settings that results depend on (time zone, ANSI errors) or that the
# plans lean on (AQE re-plans joins and splits skewed partitions).
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# Set at start only: no call-site lookup for every expression built from Python.
STATIC_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def build_session(app: str = "hazeflow", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or get) a session; on a cluster leave `master` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **STATIC_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark
