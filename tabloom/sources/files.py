"""Text, JDBC and dataset sources and sinks.

Text files are read as strings, NA words become null, and the column
types then come either from a given schema (the production path: no
inference pass) or from one aggregate pass that checks which type every
non-null value of a column has: whole numbers, numbers, or the words
true and false.  Everything else, dates too, stays text.

Quoted fields may hold line breaks and doubled quotes.  Such a file cannot be
split, so one task reads one file: large inputs should be folders of files, or
be read with ``multi_line=False`` where no field has a line break.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.exprs import NA_TOKENS, na_to_null

# candidate types, narrowest first
_INFER_ORDER = ["bigint", "double", "boolean"]
# fixed values: the spellings read as booleans
TRUE_FALSE = ["true", "True", "TRUE", "false", "False", "FALSE"]


def _read_text_table(spark: SparkSession, path: str, sep: str, header: bool, names: list[str] | None,
                     multi_line: bool) -> DataFrame:
    reader = spark.read.option("header", header).option("sep", sep).option("inferSchema", False) \
        .option("nullValue", None).option("emptyValue", "").option("multiLine", multi_line) \
        .option("quote", '"').option("escape", '"')
    if names:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        return reader.schema(schema).csv(path)
    return reader.csv(path)


def infer_types(df: DataFrame) -> dict[str, str]:
    """Narrowest type every non-null text value of a column casts to (one aggregate pass)."""
    aggs = []
    for c in df.columns:
        aggs.append(F.count(F.col(c)).alias(f"{c}__n"))
        for t in _INFER_ORDER:
            fits = F.col(c).isin(TRUE_FALSE) if t == "boolean" else F.col(c).try_cast(t).isNotNull()
            aggs.append(F.count_if(fits).alias(f"{c}__{t}"))
    r = df.agg(*aggs).collect()[0]
    out = {}
    for c in df.columns:
        n = r[f"{c}__n"]
        out[c] = next((t for t in _INFER_ORDER if n > 0 and r[f"{c}__{t}"] == n), "string")
    return out


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",",
             header: bool = True, na_tokens=NA_TOKENS, infer: bool = True, multi_line: bool = True) -> DataFrame:
    """Delimited text with a header; NA words become null; types from ``schema`` or inferred.

    ``path`` may be a file, a folder, a glob or any URI the cluster file
    system reads (so it also serves URL-style sources).
    """
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    names = [f.name for f in schema.fields] if schema is not None else None
    raw = _read_text_table(spark, path, sep, header, names, multi_line)
    clean = raw.select(*[na_to_null(F.col(c), na_tokens).alias(c) for c in raw.columns])
    if schema is not None:
        return clean.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])
    if not infer:
        return clean
    types = infer_types(clean)
    return clean.select(*[F.col(c).try_cast(t).alias(c) if t != "string" else F.col(c) for c, t in types.items()])


def read_table(spark: SparkSession, path: str, schema=None, **kw) -> DataFrame:
    """Tab-separated text."""
    return read_csv(spark, path, schema, sep="\t", **kw)


def read_url(spark: SparkSession, uri: str, schema=None, **kw) -> DataFrame:
    """Delimited text at a URI (``file:``, ``hdfs:``, ``s3a:`` ... whatever the cluster is configured for)."""
    return read_csv(spark, uri, schema, **kw)


def read_sql(spark: SparkSession, url: str, table: str | None = None, query: str | None = None,
             user: str | None = None, password: str | None = None, driver: str | None = None,
             partition_column: str | None = None, lower_bound=None, upper_bound=None,
             num_partitions: int | None = None, fetch_size: int = 10_000) -> DataFrame:
    """JDBC table, or a query when one is given.

    With ``partition_column`` and bounds the read is split into
    ``num_partitions`` parallel range queries.
    """
    r = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch_size)
    if query:
        r = r.option("query", query)
    else:
        r = r.option("dbtable", table)
    for k, v in (("user", user), ("password", password), ("driver", driver)):
        if v is not None:
            r = r.option(k, v)
    if partition_column and not query:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower_bound)
             .option("upperBound", upper_bound).option("numPartitions", num_partitions or 8))
    return r.load()


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    """Delimited text with a header (one file per partition)."""
    df.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"').csv(path)


def write_predictions_csv(pred: DataFrame, path: str) -> None:
    write_csv(pred, path)


# ---------------------------------------------------------------- datasets

def _ensure_db(spark: SparkSession, database: str, location: str | None) -> None:
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`{loc}")


def save_dataset(df: DataFrame, name: str, database: str = "tabloom", location: str | None = None) -> None:
    """Store a dataset as a Parquet table (replacing only that dataset)."""
    _ensure_db(df.sparkSession, database, location)
    df.write.mode("overwrite").format("parquet").saveAsTable(f"`{database}`.`{name}`")


def load_dataset(spark: SparkSession, name: str, database: str = "tabloom") -> DataFrame:
    return spark.table(f"`{database}`.`{name}`")


def delete_dataset(spark: SparkSession, name: str, database: str = "tabloom") -> None:
    spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{name}`")


def list_datasets(spark: SparkSession, database: str = "tabloom") -> DataFrame:
    if not spark.catalog.databaseExists(database):
        return spark.createDataFrame([], "name string")
    return spark.sql(f"SHOW TABLES IN `{database}`").select(F.col("tableName").alias("name"))
