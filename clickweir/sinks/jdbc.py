"""Optional write to a relational table. The driver jar is supplied by the cluster."""

from __future__ import annotations

from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame


def jdbc_options(database_url: str, table: str, writers: int = 8, batch_size: int = 5000) -> dict[str, str]:
    """Options from a ``postgres://user:password@host:port/name`` address.

    `writers` bounds the number of simultaneous connections.
    """
    parts = urlsplit(database_url)
    if parts.scheme not in ("postgres", "postgresql"):
        raise ValueError(f"not a PostgreSQL address: scheme {parts.scheme!r}")
    port = f":{parts.port}" if parts.port else ""
    query = f"?{parts.query}" if parts.query else ""
    options = {
        "url": f"jdbc:postgresql://{parts.hostname}{port}{parts.path}{query}",
        "dbtable": table,
        "driver": "org.postgresql.Driver",
        "numPartitions": str(writers),
        "batchsize": str(batch_size),
    }
    if parts.username:
        options["user"] = unquote(parts.username)
    if parts.password:
        options["password"] = unquote(parts.password)
    return options


def write_jdbc(df: DataFrame, database_url: str, table: str, mode: str = "append") -> None:
    """Not repeatable: a second append adds the rows a second time. Append to a staging table and merge there."""
    df.write.format("jdbc").options(**jdbc_options(database_url, table)).mode(mode).save()
