"""Line-oriented files: JSON lines, labelled sentences, judgments, columns of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Objects, one a line; blank lines are skipped, and a line that is no object of the schema fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def bad_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of the lines that hold no JSON object, blank ones aside: what a fail-fast read would stop at."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), "value")
    return lines.where((F.trim("value") != "") & (~F.trim("value").startswith("{") | F.try_parse_json("value").isNull()))


def read_labelled_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, label, sentence) of lines ``Yes|No<TAB>sentence``; another form fails the job."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.input_file_name().alias("path"), F.split("value", "\t").alias("p"))
    ok = (F.size("p") == 2) & F.col("p")[0].isin("Yes", "No")
    checked = F.when(ok, F.col("p")).otherwise(F.raise_error(F.lit("a line is no label, tab and sentence")).cast("array<string>"))
    return lines.select("path", checked[0].alias("label"), checked[1].alias("sentence"))


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """(file, verdict, spans) of lines ``file<TAB>verdict<TAB>offset<TAB>length...``, with spans as (start, end)."""
    p = F.split(F.trim("value"), r"\s+")
    n = F.slice(p, F.lit(3), F.greatest(F.size(p) - 2, F.lit(0)))
    spans = F.transform(F.sequence(F.lit(0), F.greatest(F.size(n) - 2, F.lit(0)), F.lit(2)), lambda i: F.struct(F.get(n, i).cast("int").alias("start"), (F.get(n, i).cast("int") + F.get(n, i + 1).cast("int")).alias("end")))
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(p[0].alias("file"), p[1].alias("verdict"), F.when(F.size(n) >= 2, spans).otherwise(F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))


def read_token_columns(spark: SparkSession, path: str) -> DataFrame:
    """(document, sentence_no, token_no, columns) of files of tokens in columns, with blank lines between sentences.

    Lines ``#begin document (name)`` and ``#end document`` bound documents; a file is read whole, since its lines
    take their sentence from those before.
    """

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text in b["value"]:
                name, sentence, token = None, 0, 0
                for line in text.splitlines():
                    s = line.strip()
                    if s.startswith("#begin document"):
                        name, sentence, token = s[len("#begin document") :].strip(" ();"), 0, 0
                    elif s.startswith("#end document"):
                        name = None
                    elif not s:
                        sentence, token = (sentence + 1, 0) if token else (sentence, 0)
                    elif name is not None:
                        out.append((name, sentence, token, s.split()))
                        token += 1
            yield pd.DataFrame(out, columns=["document", "sentence_no", "token_no", "columns"])

    return spark.read.text(path, wholetext=True).mapInPandas(part, "document string, sentence_no int, token_no int, columns array<string>")
