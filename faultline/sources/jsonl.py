"""JSON Lines tables: dead letters and diagnosis requests and responses."""

from pyspark.sql import DataFrame, SparkSession

from faultline import schemas as S

# Microseconds and zone are kept, so that a record reads back as written.
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON object per row; every key is written, the folder is created."""
    (
        df.write.mode(mode)
        .option("ignoreNullFields", "false")
        .option("timestampFormat", TIME_FORMAT)
        .json(path)
    )


def read_json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("timestampFormat", TIME_FORMAT).json(path)


def read_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    """Dead-letter records of a folder, whatever its batch folders."""
    return read_json_lines(spark, path, S.DEAD_LETTER).select(*S.DEAD_LETTER.names)
