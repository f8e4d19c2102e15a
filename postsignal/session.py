"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Observation, SparkSession

# What the library relies on; everything else is left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# Bytes of one batch that goes to Python. Long texts fill a batch of a fixed number of rows with any amount.
BATCH_BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
SETTINGS[BATCH_BYTES] = str(BATCH)


def build_session(app: str = "postsignal", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_utc(spark: SparkSession) -> SparkSession:
    """Times without an offset are UTC throughout; pin the session to it."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_small_batches(spark: SparkSession) -> SparkSession:
    """What Python workers hold of a task is bounded by bytes, in sessions built elsewhere too."""
    if spark.conf.get(BATCH_BYTES) != str(BATCH):  # Spark's default reads 67108864b
        spark.conf.set(BATCH_BYTES, str(BATCH))
    return spark


def observed(observation: Observation) -> dict:
    """The observed figures; none where Spark has found the plan empty and left the observation out."""
    try:
        return observation.get
    except Py4JJavaError as error:
        if "AssertionError" not in str(error.java_exception):
            raise
        return {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`.

    Only a local session may go without it: there one machine holds everything,
    and a new temporary folder is made once per session.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="postsignal-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path, not yet written, in the shared scratch folder."""
    return f"{scratch_root(spark).rstrip('/')}/postsignal/{label}-{uuid.uuid4().hex}"
