"""Stand-in inputs derived from the driver's tables, for Spark and for DuckDB.

The same definition serves both; where the dialects differ, both are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ARCHIVE = "CASE event_type WHEN 'click' THEN 'radar' WHEN 'view' THEN 'lores' WHEN 'error' THEN 'hires' ELSE event_type END"

_PIXEL = "CASE WHEN i % 4 = 3 THEN CASE WHEN v > -0.15 THEN 255 ELSE 0 END ELSE CAST(floor(abs(CAST(v AS DOUBLE)) * 1000) AS INT) % 256 END"

_SPARK_EMB = "(SELECT vec_id, i, v FROM embeddings LATERAL VIEW posexplode(embedding) e AS i, v)"
_DUCK_EMB = "(SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings)"

#: name -> (Spark SQL, DuckDB SQL); {tables} are base tables, or fixtures named before.
FIXTURES: dict[str, tuple[str, str]] = {}


def _both(name: str, text: str) -> None:
    FIXTURES[name] = (text.replace("//", "DIV").replace("EMB", _SPARK_EMB), text.replace("EMB", _DUCK_EMB))


_both("tiles", f"SELECT DISTINCT {_ARCHIVE} AS archive, 6 AS z, CAST(event_id % 64 AS INT) AS x, CAST(user_id % 64 AS INT) AS y FROM events")
_both("tiles_z7", "SELECT DISTINCT 7 AS z, CAST(event_id % 128 AS INT) AS x, CAST(user_id % 128 AS INT) AS y FROM events")
_both(
    "scenes",
    "SELECT o_orderkey AS scene_id, o_orderdate AS ts, CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE 'C' END AS frequency_band, "
    "CASE WHEN o_orderpriority LIKE '1%' THEN 'EW' ELSE 'IW' END AS instrument_mode, CAST(o_orderkey % 101 AS INT) AS cloud_cover, "
    "CAST(o_custkey % 340 - 170 AS DOUBLE) AS west, CAST(o_orderkey % 150 - 75 AS DOUBLE) AS south, "
    "CAST(o_custkey % 340 - 170 + 4 AS DOUBLE) AS east, CAST(o_orderkey % 150 - 75 + 3 AS DOUBLE) AS north FROM orders",
)
_both(
    "aoi",
    "SELECT CAST(n_nationkey AS BIGINT) AS aoi_id, CAST((n_nationkey * 13) % 330 - 165 AS DOUBLE) AS west, CAST((n_nationkey * 7) % 140 - 70 AS DOUBLE) AS south, "
    "CAST((n_nationkey * 13) % 330 - 160 AS DOUBLE) AS east, CAST((n_nationkey * 7) % 140 - 65 AS DOUBLE) AS north FROM nation",
)
_both("pixels", f"SELECT vec_id AS tile, CAST(i // 16 AS INT) AS row, CAST((i // 4) % 4 AS INT) AS col, CAST(i % 4 AS INT) AS ch, {_PIXEL} AS value FROM EMB")
_both("patches", "SELECT vec_id AS sample, CAST(((i // 8) // 2) * 4 + (i % 8) // 2 AS INT) AS patch, CAST(((i // 8) % 2) * 2 + i % 2 AS INT) AS elem, CAST(v AS DOUBLE) AS v FROM EMB")

_BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in view as a DataFrame."""
    import re

    text = FIXTURES[name][0]
    for base in _BASE:
        text = re.sub(rf"\bFROM {base}\b", f"FROM parquet.`{sf_dir}/{base}.parquet`", text)
    return spark.sql(text)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tile, label, data): the ``pixels`` view as arrays, 4 x 4 x 4, rows then columns then channels."""
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS tile", "label", f"transform(embedding, (v, i) -> {_PIXEL}) AS data")


def with_fixtures(sql: str, *names: str, recursive: bool = False) -> str:
    """DuckDB SQL with the named stand-ins as CTEs; ``sql`` may begin with CTEs of its own."""
    head = ",\n".join(f"{n} AS ({FIXTURES[n][1]})" for n in names)
    word = "WITH RECURSIVE" if recursive else "WITH"
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{body[14:]}"
    if body.upper().startswith("WITH"):
        return f"{word} {head},\n{body[4:]}"
    return f"{word} {head}\n{body}"
