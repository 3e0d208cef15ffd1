"""Detection tables over the driver's star schema, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: {div}: integer division of the engine.
BOXES = """
    SELECT l_orderkey {div} 20 AS image_id,
           CAST(l_partkey % 3 AS INT) AS label,
           CAST(row_number() OVER (PARTITION BY l_orderkey {div} 20
             ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS box_id,
           CASE WHEN l_linestatus = 'O' THEN 'GT' ELSE 'DET' END AS kind,
           l_quantity * 2 AS x0, CAST(l_suppkey AS DOUBLE) AS y0,
           l_quantity * 2 + CAST(20 + l_partkey % 17 AS DOUBLE) AS x1,
           CAST(l_suppkey + 20 + l_orderkey % 13 AS DOUBLE) AS y1,
           CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 100003 AS DOUBLE) / CAST(100003 AS DOUBLE) AS score,
           CAST(l_partkey % 7 AS INT) AS dataset
    FROM lineitem"""

#: The same rows in Spark: lines are numbered before boxes are made of them, so that what is dealt to images is small, and the same for
#: every use of the boxes, which Spark then deals once.
NUMBERED_BOXES = """
    SELECT image_id, CAST(l_partkey % 3 AS INT) AS label, CAST(place AS BIGINT) AS box_id,
           CASE WHEN l_linestatus = 'O' THEN 'GT' ELSE 'DET' END AS kind,
           l_quantity * 2 AS x0, CAST(l_suppkey AS DOUBLE) AS y0,
           l_quantity * 2 + CAST(20 + l_partkey % 17 AS DOUBLE) AS x1,
           CAST(l_suppkey + 20 + l_orderkey % 13 AS DOUBLE) AS y1,
           CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 100003 AS DOUBLE) / CAST(100003 AS DOUBLE) AS score,
           CAST(l_partkey % 7 AS INT) AS dataset
    FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_linestatus, l_orderkey div 20 AS image_id,
                 row_number() OVER (PARTITION BY l_orderkey div 20 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place
          FROM lineitem ) AS numbered"""

SCORES = """
    SELECT labels.doc_id AS id, 1 - quality AS y, CAST(n_chars AS DOUBLE) AS u, lang AS grp, toxic
    FROM labels JOIN documents ON labels.doc_id = documents.doc_id"""

METER = "SELECT user_id, ts, event_id, value, event_type FROM events"

VIEWS = {"boxes": BOXES, "scores": SCORES, "meter": METER}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over the Parquet tables of sf_dir. Nothing is registered in the session."""
    sql = NUMBERED_BOXES if name == "boxes" else VIEWS[name].format(div="div")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if t in sql.split() or f"{t}." in sql}
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}} AS {t}").replace(f"JOIN {t}", f"JOIN {{{t}}} AS {t}")
    return spark.sql(sql, **used)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oracle(sql: str) -> str:
    """DuckDB SQL with the views that it names before it."""
    used = [f"{name} AS ({text.format(div='//')})" for name, text in VIEWS.items() if f"FROM {name}" in sql or f"JOIN {name}" in sql]
    body = sql.strip()
    if not used:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {', '.join(used)}, {body[14:]}"
    return f"WITH {', '.join(used)}, {body[4:]}" if body.upper().startswith("WITH") else f"WITH {', '.join(used)} {body}"
