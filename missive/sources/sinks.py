"""Writes that can be repeated without harm."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a cell of a spreadsheet holds at most, and the mark of a cut one.
CELL, CUT = 32_767, " [cut]"


def write_new(df: DataFrame, path: str) -> None:
    """JSON lines at a path where nothing is yet; an existing one fails the job."""
    df.write.mode("errorifexists").json(path)


def write_once(df: DataFrame, path: str) -> bool:
    """Parquet at a path, unless the same rows are there already; other rows there raise ValueError.

    Returns whether anything was written. Rows are compared as multisets, each side aggregated before it is shuffled.
    """
    try:
        there = df.sparkSession.read.parquet(path)
    except AnalysisException:
        df.write.mode("errorifexists").parquet(path)
        return True
    if sorted(there.dtypes) != sorted(df.dtypes) or not there.exceptAll(df.select(there.columns)).isEmpty() or not df.select(there.columns).exceptAll(there).isEmpty():
        raise ValueError(f"{path} holds other rows")
    return False


def sheet_cells(df: DataFrame) -> DataFrame:
    """df with every column as the text of a spreadsheet cell: nested values as JSON, control characters replaced, long texts cut."""
    out = []
    for name, kind in df.dtypes:
        c = F.to_json(name) if kind.startswith(("array", "struct", "map")) else F.col(f"`{name}`").cast("string")
        c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "�")
        out.append(F.when(F.length(c) > CELL, F.concat(F.substring(c, 1, CELL - len(CUT)), F.lit(CUT))).otherwise(c).alias(name))
    return df.select(*out)
