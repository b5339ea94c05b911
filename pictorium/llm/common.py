"""Small shared pieces of the text operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of lower-cased UTF-8: digits, a-z and every non-ASCII character.
WORD_BYTES = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of an Arrow batch; null becomes the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def words_of(text: str) -> list[bytes]:
    """Words of a text with A-Z lower-cased (other letters stay)."""
    return WORD_BYTES.findall(text.encode("utf-8", "surrogatepass").lower())


def row_batches(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes``: one very long text
    makes a batch of its own, so memory in a Python worker stays bounded."""
    for batch in batches:
        n = batch.num_rows
        step = max(1, n * most_bytes // max(batch.nbytes, 1))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def with_columns(batch: pa.RecordBatch, keep: list[str], **new: pa.Array) -> pa.RecordBatch:
    arrays = [batch.column(c) for c in keep] + list(new.values())
    return pa.RecordBatch.from_arrays(arrays, names=keep + list(new))


def schema_plus(df: DataFrame, keep: list[str], **new: str) -> T.StructType:
    fields = [df.schema[c] for c in keep]
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields] + [T.StructField(n, _type(t), True) for n, t in new.items()])


def _type(ddl: str) -> T.DataType:
    return T._parse_datatype_string(ddl)


def crc_mod(column: Column, m: int) -> Column:
    """CRC-32 of the number written as text, modulo ``m``."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % m


#: Names the operators add to a frame for their own use.
OWN = "__llm_"


def single(df: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text`` of a frame, whatever else it carries."""
    return df.select("doc_id", "text")
