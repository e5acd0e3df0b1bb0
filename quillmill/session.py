"""Session settings and table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: What the expressions in this package rely on.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.chunkBase64String.enabled": "false",
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def get_session(master: str = "local[*]", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    """A session with the package's settings; for tests, benches and small machines."""
    builder = SparkSession.builder.master(master).appName("quillmill")
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"} | more
    return prepare(builder.config(map=conf).getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Puts the settings into a session made by someone else."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
