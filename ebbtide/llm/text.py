"""Word rules that the operators share, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_count(text: Column) -> Column:
    """Number of blank-separated words as a long; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, text, rest): every input row under a number of its own, with its other columns in one struct.

    A stage's own columns then clash with none of the input's, whatever their names; ``unpacked`` gives them back.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    rest = F.struct(F.lit(0).alias("none"), *[docs[f"`{c}`"].alias(f"c{k}") for k, c in enumerate(others)])
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), rest.alias("rest"))


def unpacked(rows: DataFrame, columns: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns that ``packed`` was given, in their order."""
    others = [c for c in columns if c not in (id_col, text_col)]
    own = {id_col: F.col("doc_id"), text_col: F.col("text")} | {c: F.col(f"rest.c{k}") for k, c in enumerate(others)}
    return rows.select(*[own[c].alias(c) for c in columns])


BATCH_BYTES = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """The frame as it is; its session's Arrow batches are held to 8 MB of rows unless a size is set already.

    Texts can be long, and a batch of 10,000 of them is held several times on its way to Python and back.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name, None) is None:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df
