"""Reports, splits, accumulators and logs as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxwise.functions import scalars as S


def write_metrics_csv(df: DataFrame, path: str) -> None:
    """Writes a report with fractional columns as text of four decimals, blank where there is no finite value."""
    df.select(*(S.fixed4(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType | T.FloatType) else F.col(f.name) for f in df.schema)).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def flat(df: DataFrame) -> DataFrame:
    """df with the fields of its struct columns as columns of their own, named <column>_<field>."""
    return df.select(*(c for f in df.schema for c in ([F.col(f"{f.name}.{x.name}").alias(f"{f.name}_{x.name}") for x in f.dataType] if isinstance(f.dataType, T.StructType) else [F.col(f.name)])))


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", True).csv(path)


def read_metrics_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A report by its schema (S18): cells that are blank, 'nan' or no number at all are NULL, and text cells that are blank stay blank."""
    wanted = T.StructType.fromDDL(schema)
    raw = spark.read.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in wanted])).option("header", True).option("emptyValue", "").option("nullValue", "\0").csv(path)

    def cell(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.DoubleType | T.FloatType):
            return S.parse_float(F.trim(f.name)).cast(f.dataType)
        return F.coalesce(F.col(f.name), F.lit("")) if isinstance(f.dataType, T.StringType) else F.trim(f.name).try_cast(f.dataType)

    return raw.select(*(cell(f).alias(f.name) for f in wanted))


def finite_only(x: Column, kind: T.DataType) -> Column:
    """x with every number in it that is not finite as NULL, however deep."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        return S.finite_or_null(x)
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda v: finite_only(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(x, lambda _, v: finite_only(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(x.isNotNull(), F.struct(*(finite_only(x[f.name], f.dataType).alias(f.name) for f in kind)))
    return x


def to_json(df: DataFrame, keep: list[str]) -> DataFrame:
    """keep..., json: all other columns as one document, in which NaN and infinities are null."""
    rest = [f for f in df.schema if f.name not in keep]
    return df.select(*keep, F.to_json(F.struct(*(finite_only(F.col(f.name), f.dataType).alias(f.name) for f in rest)), {"ignoreNullFields": "false"}).alias("json"))


def append_log(df: DataFrame, path: str) -> None:
    """Adds rows to a log of JSON lines (S20); scalars are rows (step, tag, value)."""
    df.write.mode("append").json(path)


def write_split(split: DataFrame, path: str, key: str, seed: int, fraction: float, metadata: dict[str, str] | None = None) -> None:
    """Writes the rows (key, split) of statistics.split() as Parquet, and what describes them as one JSON document beside it.

    Members are rows and not two lists in one document, so a split may be of any size.
    """
    split.select(F.col(key).alias("image_id"), "split").write.mode("overwrite").parquet(f"{path}/members")
    counts = {side: F.count_if(F.col("split") == side) for side in ("frechet", "calibration")}
    about = split.agg(F.count(F.lit(1)).alias("pool_size"), F.lit(seed).cast("long").alias("seed"), F.lit(fraction).alias("calibration_fraction"), *(n.alias(f"num_{side}") for side, n in counts.items()))
    pairs = [F.lit(x) for item in (metadata or {}).items() for x in item]
    about.withColumn("metadata", F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")).coalesce(1).write.mode("overwrite").json(f"{path}/about")


def read_split(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(image_id, split), and the one row that describes them."""
    about = "pool_size long, seed long, calibration_fraction double, num_frechet long, num_calibration long, metadata map<string,string>"
    return spark.read.parquet(f"{path}/members"), spark.read.schema(about).json(f"{path}/about")


def chosen(rows: DataFrame, members: DataFrame, side: str) -> DataFrame:
    """The rows whose image_id a side of a split names."""
    return rows.join(members.where(F.col("split") == side).select("image_id"), "image_id", "left_semi")


def write_state(tables: dict[str, DataFrame], path: str) -> None:
    """Writes accumulators, such as means, counts, prototypes and distances, as one Parquet table each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_state(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
