"""Raw input: 28 text columns, no inference, nothing lost in silence."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schemas import RAW_COLUMNS, RAW_SCHEMA

CORRUPT = "_corrupt_record"


#: A text literal of JSON; it cannot hold a line break.
_TEXT = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
_LEVELS = 6
#: An object with objects inside it, level by level.
_OBJECT = reduce(lambda inner, _: rf'\{{(?:[^{{}}"]++|{_TEXT}|{inner})*+\}}', range(_LEVELS), rf'\{{(?:[^{{}}"]++|{_TEXT})*+\}}')
_JUNK = r"\A[\s,\[\]]*\z"
_PARSED = StructType([*RAW_SCHEMA.fields, StructField(CORRUPT, StringType())])
#: How the names of all raw columns begin in a file.
_STARTS = sorted({'"' + re.split("(?<=_)", name)[0] for name in RAW_COLUMNS})


def read_bronze(
    spark: SparkSession,
    path: str | list[str],
    fmt: str = "json",
    multi_line: bool = False,
    keep_corrupt: bool = False,
) -> DataFrame:
    """Read raw records with the fixed all-text schema.

    ``json`` reads files of one array or of JSON lines as text, line by line, so they split like any
    text; a line may hold one record or several, with the brackets and commas of one or more arrays around
    them. ``multi_line`` is for records that span lines and for whole arrays on one line: such files are split before
    every opening brace instead, and so spread over tasks as well. ``csv`` expects the same header in
    every file and fails on another one; ``multi_line`` there allows line breaks inside quotes. Missing fields are
    NULL, extra fields are ignored.

    A piece of JSON that is no record fails the query, or, with ``keep_corrupt``, becomes a row with
    its text in ``_corrupt_record`` and NULL elsewhere, for ``Pipeline`` to count. So does a record with objects nested
    deeper than six levels. A line that does not parse as a whole is one corrupt row.
    """
    if fmt == "json":
        if multi_line:
            return _checked(_spanning(spark, path), keep_corrupt)
        return _checked(_texts(spark.read.text(path)), keep_corrupt)
    if fmt == "csv":
        # Spark takes the columns of one file for all; checking every header needs all columns read.
        text = (
            spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
            .option("enforceSchema", False).option("columnPruning", False).csv(path)
        )
        absent = {n: F.lit(None).cast("string") for n in RAW_COLUMNS if n not in text.columns}
        rows = text.withColumns(absent).select(*RAW_COLUMNS)
        return rows.withColumn(CORRUPT, F.lit(None).cast("string")) if keep_corrupt else rows
    raise ValueError(f"unknown raw format {fmt!r}; use 'json' or 'csv'")


def _record() -> Column:
    return F.from_json("_text", _PARSED, {"columnNameOfCorruptRecord": CORRUPT}).alias("_record")


def _texts(lines: DataFrame) -> DataFrame:
    """``value``, ``_text`` and ``_ok`` for every record of each line; a line with anything else in it is one row, not ok.

    Nearly all lines are a record with a bracket or comma at either end; its only closing brace is its last character.
    Those are cut by position. In others the records are matched with their texts and inner objects; brackets and commas
    between them, as where arrays were joined or nested, go.
    """
    value = F.trim("value")
    lead = F.substring(value, 1, 1).isin("[", ",").cast("int")
    trail = F.substring(value, -1, 1).isin("]", ",").cast("int")
    cut = lines.withColumn("_body", F.substr(value, lead + 1, F.length(value) - lead - trail))
    body = F.col("_body")
    plain = body.startswith("{") & (F.instr(body, "}") == F.length(body))
    only = F.regexp_like(F.regexp_replace("value", _OBJECT, ""), F.lit(_JUNK))
    # Records are matched apart; "}{" without a comma is read as two.
    found = F.when(plain, F.array(body)).when(only, F.regexp_extract_all("value", F.lit(_OBJECT), F.lit(0)))
    marked = cut.withColumns({"_texts": found, "_ok": found.isNotNull()})
    return marked.select("value", "_ok", F.explode(F.coalesce("_texts", F.array(F.lit(None).cast("string")))).alias("_text"))


def _spanning(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of files whose lines are not records.

    The opening brace is the separator, so a piece begins inside a record and ends with what comes before the next one.
    Nearly all pieces are one flat record, and are parsed where they lie. The others are parts of records with nested
    objects or braces in texts, broken records and the beginnings of files: neighbours among them are put together again,
    per split of a file and over its edges, and then read like lines. (An object in a field that nobody reads must not hold
    names of raw columns alone: it would be taken for a record, and what is around it for a corrupt one.)
    """
    pieces = (
        spark.read.option("lineSep", "{").text(path)
        .select("value", F.monotonically_increasing_id().alias("_at"), "_metadata.file_path", "_metadata.file_block_start")
    )
    # The trailing white space, commas and brackets; no record ends so.
    body = F.rtrim("value", F.lit(" \t\r\n,[]"))
    plain = (
        (F.instr(body, "}") == F.length(body))
        & F.col("value").rlike(r'\A\s*"\w+"\s*:')
        & reduce(Column.__or__, [F.contains("value", F.lit(start)) for start in _STARTS])
    )
    whole = F.concat(F.lit("{"), body)
    alone = pieces.filter(plain).select(whole.alias("value"), F.lit(True).alias("_ok"), whole.alias("_text"))

    split = Window.partitionBy("file_path", "file_block_start").orderBy("_at")
    numbered = pieces.filter(~plain).withColumns({"_n": F.row_number().over(split), "_island": F.col("_at") - F.row_number().over(split)})
    # Every piece follows a brace but the first of a file, which is never a record and so among these.
    first = (F.col("file_block_start") == 0) & (F.col("_n") == 1)
    text = F.concat(F.when(first, F.lit("")).otherwise(F.lit("{")), F.col("value"))
    islands = numbered.groupBy("file_path", "file_block_start", "_island").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", text.alias("text")))), lambda p: p["text"]), "").alias("value")
    )
    # An island that leaves a brace or a text open at the end of its split goes on in the next one. What an island starts
    # with is known where a plain record is before it in its split, and follows from the islands before otherwise.
    order = Window.partitionBy("file_path").orderBy("file_block_start", "_island")
    known = (F.coalesce(F.lag("file_block_start").over(order), F.lit(-1)) == F.col("file_block_start")).cast("int")
    chain = Window.partitionBy("file_path", "_chain").orderBy("file_block_start", "_island")
    before = chain.rowsBetween(Window.unboundedPreceding, -1)

    def braces(text: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(text, _TEXT, ""), r'"[\s\S]*', "")
        return F.regexp_count(bare, F.lit(r"\{")) - F.regexp_count(bare, F.lit(r"\}"))

    odd = F.regexp_replace("value", _TEXT, "").contains('"').cast("int")
    placed = islands.withColumn("_chain", F.sum(known).over(order)).withColumn("_odd", odd)
    placed = placed.withColumn("_inside", F.coalesce(F.sum("_odd").over(before), F.lit(0)) % 2)
    deeper = F.when(F.col("_inside") == 1, braces(F.concat(F.lit('"'), F.col("value")))).otherwise(braces(F.col("value")))
    placed = placed.withColumn("_deeper", deeper)
    closed = (F.coalesce(F.sum("_deeper").over(before), F.lit(0)) <= 0) & (F.col("_inside") == 0)
    grouped = (
        placed.withColumn("_new", closed.cast("int"))
        .withColumn("_group", F.sum("_new").over(order))
        .groupBy("file_path", "_group")
        .agg(F.array_sort(F.collect_list(F.struct("file_block_start", "_island", "value"))).alias("parts"))
        .select(F.array_join(F.transform("parts", lambda p: p["value"]), "").alias("value"))
    )
    # Read as a whole; failing that, from one line that begins with a brace to the next.
    lines = F.filter(F.split("value", r"\n(?=[\s,\[\]]*\{)"), lambda x: F.length(F.trim(x)) > 0)
    only = F.regexp_like(F.regexp_replace("value", _OBJECT, ""), F.lit(_JUNK))
    again = grouped.select(F.explode(F.when(only, F.array("value")).otherwise(lines)).alias("value"))
    return alone.unionByName(_texts(again))


def _checked(texts: DataFrame, keep_corrupt: bool) -> DataFrame:
    """The columns of each record; what does not parse is a corrupt row, whose fields are all NULL, or fails the query."""
    rows = texts.select("value", "_ok", _record())
    bad = ~F.col("_ok") | F.col("_record")[CORRUPT].isNotNull()
    fields = [F.col("_record")[name].alias(name) for name in RAW_COLUMNS]
    if keep_corrupt:
        return rows.select(*fields, F.when(bad, F.col("value")).alias(CORRUPT))
    message = F.concat(F.lit("malformed raw record: "), F.substring("value", 1, 200))
    checked = F.when(bad, F.raise_error(message)).otherwise(F.col("_record")[RAW_COLUMNS[0]])
    return rows.select(checked.alias(RAW_COLUMNS[0]), *fields[1:])


def sample(df: DataFrame, n: int = 1000) -> DataFrame:
    """Any ``n`` rows, for a cheap dry run.

    Taken a few partitions at a time until there are enough, so that a dry run does not scan
    everything; they pass through the driver, so keep ``n`` small.
    """
    return df.sparkSession.createDataFrame(df.take(n), df.schema)
