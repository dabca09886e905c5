"""Spark sessions: one place for the settings that results or plans depend on."""

from pyspark.sql import SparkSession


def build_session(app: str = "tidewater", warehouse: str | None = None, catalog: dict[str, str] | None = None, object_store: dict[str, str] | None = None, **extra: str) -> SparkSession:
    """A session in UTC with adaptive execution.

    object_store: endpoint, access_key, secret_key of an S3-style store (path-style, no TLS unless the
    endpoint says https). catalog: name, type, warehouse and implementation class of a table catalog whose jar is
    on the class path. Nothing is opened until it is read.
    """
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    if warehouse:
        conf["spark.sql.warehouse.dir"] = warehouse
    if object_store:
        conf |= {
            "spark.hadoop.fs.s3a.endpoint": object_store["endpoint"],
            "spark.hadoop.fs.s3a.access.key": object_store.get("access_key", ""),
            "spark.hadoop.fs.s3a.secret.key": object_store.get("secret_key", ""),
            "spark.hadoop.fs.s3a.path.style.access": "true",
            "spark.hadoop.fs.s3a.connection.ssl.enabled": str(object_store["endpoint"].startswith("https")).lower(),
        }
    if catalog:
        name = catalog.get("name", "catalog")
        conf |= {f"spark.sql.catalog.{name}": catalog["class"], f"spark.sql.catalog.{name}.type": catalog.get("type", "hadoop"), f"spark.sql.catalog.{name}.warehouse": catalog["warehouse"]}
    return SparkSession.builder.appName(app).config(map=conf | extra).getOrCreate()
