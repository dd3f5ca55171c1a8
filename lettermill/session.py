"""Session defaults for stand-alone use; operators never create a session themselves."""

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "lettermill", **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and any extra ``conf``.

    ``master`` is left to spark-submit when None, as on a cluster.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the parquet tables of a scale-factor folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
