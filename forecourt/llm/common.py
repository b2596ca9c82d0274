"""What several operators of this folder need."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from forecourt.session import checkpoint_dir

#: Characters that end a word, and the pattern of a run of them.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's checkpoint folder, which all executors share."""
    return f"{checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Cuts the lineage with a table that outlives any executor, and gives the reader a known size.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case; other letters stay, unlike ``lower``."""
    return F.translate(c, _UPPER, _UPPER.lower())


def as_text(c: Column) -> Column:
    """Null reads as the empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(df.schema[column].dataType)


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows as Python values; unlike with pandas, null numbers stay apart and large ones exact."""
    return zip(*(c.to_pylist() for c in batch.columns))
