"""CSV tables with a header, free column order and several markers for a missing value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.functions.scalars import clean_numeric, na_to_null
from holdfast.operators.quality import join_one_to_one, validate
from holdfast.schema import CATEGORICAL_PREDICTORS, ID, NUMERIC_PREDICTORS, TARGET, customer_schema
from holdfast.session import durable


#: A written number. Spark's own cast also takes "1D" and "2F", which are codes in a file.
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?)\s*$"
WHOLE = r"^\s*[+-]?\d+(\.0*)?\s*$"


def _typed(name: str, kind: T.DataType) -> Column:
    """A text column as ``kind``; a value that is not of that kind fails the read."""
    value = na_to_null(F.col(f"`{name}`"))
    if isinstance(kind, T.StringType):
        return value.alias(name)
    if isinstance(kind, T.IntegralType):
        # "1" and "1.0" are both whole numbers; digits are kept exactly, without a double in between.
        fits, read = WHOLE, F.regexp_extract(value, r"([+-]?\d+)", 1).cast(kind)
    else:
        fits, read = NUMBER, value.cast(kind)
    wrong = F.raise_error(F.concat(F.lit(f"{name}: not {'a whole number' if fits == WHOLE else 'a number'}: "), value))
    return F.when(value.isNull(), F.lit(None).cast(kind)).when(value.rlike(fits), read).otherwise(wrong.cast(kind)).alias(name)


def read_raw(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Every column as text, named by the header; quotes inside a quoted field are doubled.

    ``multi_line`` allows line breaks in quoted fields (see ``read_records``). Without such fields, turn it off:
    the lines are then not written before they are parsed.
    """
    plain = spark.read.options(header=True, enforceSchema=False, escape='"', multiLine=multi_line).csv(path)
    if not multi_line:
        return plain
    names = plain.columns  # reads the first record
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in names)
    parsed = F.from_csv("text", schema, {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    records = read_records(spark, path)
    wrong = F.raise_error(F.concat(F.lit("Another header than the first file's: "), F.col("text")))
    same = F.concat_ws("\x1f", *[F.coalesce(F.col(f"r.`{c}`"), F.lit("")) for c in names]) == F.lit("\x1f".join(names))
    header = F.when(F.col("first"), F.when(same, True).otherwise(wrong.cast("boolean"))).otherwise(False)
    # A header has no values at all, so that checks of values may be made before it is left out.
    rows = records.withColumn("r", parsed).select(F.when(~header, F.col("r")).alias("r")).where("r is not null")
    return rows.select(*[F.col(f"r.`{c}`").alias(c) for c in names])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(``first``, ``text``): the records of all files, each read by as many tasks as it has blocks.

    A line break is inside a field if an odd number of quotes stands before it in its file. Each block counts its
    quotes; the blocks' parities, summed in file order, tell how each block begins. Blocks without an open quote
    hold whole records; lines of the others are numbered by the records that begin before them and put together.
    ``first`` marks the first record of a file. Lines end with a line feed or a carriage return and one; blank
    lines between records are left out.
    """
    block = ["file", "start"]
    lines = durable(spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("seq"), F.col("value")))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = lines.withColumn("odd", quotes % 2)
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    blocks = lines.groupBy(*block).agg(F.sum("odd").alias("odds"), F.min(F.when(~F.col("value").isin("", "\r"), F.col("seq"))).alias("head"))
    blocks = durable(blocks.withColumn("open", F.coalesce(F.sum("odds").over(before), F.lit(0)) % 2).select(
        *block, "open", ((F.col("odds") > 0) | (F.col("open") == 1)).alias("busy"),
        F.when(F.col("start") == 0, F.col("head")).alias("head")))
    placed = lines.join(blocks, block)
    whole = placed.where("not busy").select((F.col("seq") == F.col("head")).alias("first"), F.col("value").alias("text"))

    within = Window.partitionBy(*block).orderBy("seq")  # the lines of one block
    inside = (F.col("open") + F.coalesce(F.sum("odd").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) % 2
    busy = placed.where("busy").withColumn("begins", (inside == 0).cast("int"))
    busy = durable(busy.withColumn("number", F.sum("begins").over(within.rowsBetween(Window.unboundedPreceding, 0)))
                   .select(*block, "seq", "head", "value", "number"))
    # Lines before a block's first record belong to the last record of an earlier block.
    ends = busy.groupBy(*block).agg(F.max("number").alias("records"))
    last = F.last(F.when(F.col("records") > 0, F.struct("start", "records")), ignorenulls=True).over(before)
    ends = ends.select(*block, last.alias("earlier"))
    owner = F.when(F.col("number") > 0, F.struct("start", F.col("number").alias("records"))).otherwise(F.col("earlier"))
    joined = busy.join(ends, block).withColumn("owner", owner).groupBy("file", "owner").agg(
        F.sort_array(F.collect_list(F.struct("seq", "value"))).alias("parts"), F.min("seq").alias("seq"), F.max("head").alias("head"))
    text = F.array_join(F.transform("parts", lambda p: p["value"]), "\n")
    split = joined.select((F.col("seq") == F.col("head")).alias("first"), text.alias("text"))
    trimmed = whole.unionByName(split).select(F.coalesce("first", F.lit(False)).alias("first"), F.regexp_replace("text", "\r$", "").alias("text"))
    return trimmed.where("text <> ''")


def _all_match(raw: DataFrame, pattern: str) -> list[str]:
    row = raw.agg(*[F.count_if(na_to_null(F.col(f"`{c}`")).isNotNull() & ~F.col(f"`{c}`").rlike(pattern)).alias(c)
                    for c in raw.columns]).first()
    return [c for c in raw.columns if row[c] == 0]


def numeric_like(raw: DataFrame) -> list[str]:
    """Columns whose every present value is a number, found in one aggregation over the table."""
    return _all_match(raw, NUMBER)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read by ``schema`` (columns matched by name) or, without one, infer double or text per column."""
    raw = read_raw(spark, path)
    if schema is None:
        numbers = set(numeric_like(raw))
        schema = T.StructType([T.StructField(c, T.DoubleType() if c in numbers else T.StringType())
                               for c in raw.columns])
    return clean_numeric(raw.select(*[_typed(f.name, f.dataType) for f in schema]))


def read_customer_file(spark: SparkSession, path: str) -> DataFrame:
    """A customer file: known columns get their dictionary type, others are inferred."""
    raw = read_raw(spark, path)
    known = {*NUMERIC_PREDICTORS, *CATEGORICAL_PREDICTORS, ID, TARGET}
    extra = [c for c in raw.columns if c not in known]
    numbers = set(numeric_like(raw.select(*extra))) if extra else set()
    fields = {f.name: f.dataType for f in customer_schema(raw.columns)}
    kinds = {c: fields[c] if c in known else T.DoubleType() if c in numbers else T.StringType() for c in raw.columns}
    if ID in kinds and not _all_match(raw.select(ID), r"^\s*[+-]?\d{1,18}(\.0*)?\s*$"):
        kinds[ID] = T.StringType()  # ids as they come
    return clean_numeric(raw.select(*[_typed(c, kinds[c]) for c in raw.columns]))


def load_customers(spark: SparkSession, folder: str, client_file: str = "Client.csv",
                   record_file: str = "Record.csv") -> DataFrame:
    """Read both files, check keys and target, and join them one to one."""
    client = read_customer_file(spark, f"{folder}/{client_file}")
    record = read_customer_file(spark, f"{folder}/{record_file}")
    if ID in client.columns and ID in record.columns and client.schema[ID].dataType != record.schema[ID].dataType:
        client, record = (df.withColumn(ID, F.col(ID).cast("string")) for df in (client, record))
    validate(client, record)
    return join_one_to_one(record, client)


def write_table(df: DataFrame, path: str, missing: str = "NA") -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", missing).csv(path)
