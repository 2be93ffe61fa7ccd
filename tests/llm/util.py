from pyspark.sql import DataFrame, SparkSession


def frame(spark: SparkSession, rows: list[tuple], schema: str, parts: int = 3) -> DataFrame:
    return spark.createDataFrame(rows, schema).repartition(parts)
