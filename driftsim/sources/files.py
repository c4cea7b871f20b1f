"""Text sources and sinks: delimited ratings, block logs and JSON messages."""

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

from driftsim.functions.scoring import to_epoch
from driftsim.schemas import RATINGS, VOTES

MICROBATCH_JSON = (
    "user map<string,bigint>, item map<string,bigint>, rating map<string,double>, unixtimestamp map<string,bigint>"
)


def scan_ratings(spark: SparkSession, path: str, schema: StructType = RATINGS, sep: str = ",") -> DataFrame:
    """Headerless delimited ratings (or votes) with a fixed schema."""
    return spark.read.schema(schema).option("sep", sep).csv(path)


def ingest_delimited(spark: SparkSession, source: str, target: str, sep: str = "\t") -> DataFrame:
    """Sort a headerless delimited file by time and write it as csv."""
    rows = scan_ratings(spark, source, sep=sep)
    rows.orderBy("ts", *(c for c in rows.columns if c != "ts")).write.csv(target)
    return scan_ratings(spark, target)


def read_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(value) of every line. Spark's text reader knows UTF-8 only; the csv reader knows others."""
    if encoding.upper() in ("UTF-8", "UTF8"):
        return spark.read.text(path)
    reader = spark.read.schema("value string").option("encoding", encoding)
    # One column: no quotes, no escapes, and a separator that no line has.
    return reader.option("sep", "\u0001").option("quote", "").option("escape", "").option("maxCharsPerColumn", -1).csv(path)


def scan_block_log(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Votes from a log where a ``U`` line names the electee of the ``V`` lines after it."""
    lines = read_lines(spark, path, encoding).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
    )
    fields = F.split("value", "\t")
    kind = F.substring("value", 1, 1)
    parsed = lines.filter(kind.isin("U", "V")).select(
        "file", "start", "line", kind.alias("kind"), fields.alias("fields")
    )
    header = F.when(F.col("kind") == "U", F.try_element_at("fields", F.lit(2)).try_cast("long"))
    carried = carry_forward(parsed.withColumn("header", header), "header", "electee_id")
    return carried.filter(F.col("kind") == "V").select(
        "electee_id",
        F.try_element_at("fields", F.lit(3)).try_cast("long").alias("voter_id"),
        F.try_element_at("fields", F.lit(2)).try_cast("double").alias("vote"),
        to_epoch(F.try_element_at("fields", F.lit(4))).alias("ts"),
    )


def ingest_block_log(spark: SparkSession, source: str, target: str, encoding: str = "UTF-8") -> DataFrame:
    """Sort the votes of a block log by time and write them as csv."""
    votes = scan_block_log(spark, source, encoding)
    votes.orderBy("ts", "electee_id", "voter_id", "vote").write.csv(target)
    return scan_ratings(spark, target, VOTES)


def carry_forward(lines: DataFrame, value: str, name: str) -> DataFrame:
    """The last non-null ``value`` at or before each line of its file.

    Works per scan split, whose size the scan bounds, and hands the last value of each
    split on to the next: one row per split.
    """
    split = ["file", "start"]
    ends = lines.groupBy(*split).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col("line"))).alias("end")
    )
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    handed = ends.select(*split, F.last("end", ignorenulls=True).over(before).alias("handed"))
    inside = W.partitionBy(*split).orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow)
    return lines.join(handed, split).withColumn(
        name, F.coalesce(F.last(value, ignorenulls=True).over(inside), "handed")
    )


def microbatch_messages(batched: DataFrame) -> DataFrame:
    """One column-oriented JSON text per micro-batch; as long as the micro-batch."""
    index = (F.col("arrival") - F.min("arrival").over(W.partitionBy("batch"))).cast("string")

    def column(source: str, name: str) -> Column:
        entries = F.collect_list(F.struct("index", source))
        return F.map_from_entries(F.sort_array(entries)).alias(name)

    return (
        batched.withColumn("index", index)
        .groupBy("batch")
        .agg(
            column("user_id", "user"),
            column("item_id", "item"),
            column("rating", "rating"),
            column("ts", "unixtimestamp"),
        )
        .select("batch", F.to_json(F.struct("user", "item", "rating", "unixtimestamp")).alias("value"))
    )


def parse_columnar_json(messages: DataFrame) -> DataFrame:
    """Rows out of column-oriented JSON; other columns of ``messages`` stay."""
    rest = [c for c in messages.columns if c != "value"]
    doc = F.from_json("value", MICROBATCH_JSON)
    rows = messages.select(*rest, doc.alias("doc")).select("*", F.explode(F.map_keys("doc.user")).alias("index"))

    def at(field):
        return F.try_element_at(F.col(f"doc.{field}"), F.col("index"))

    return rows.select(
        *rest,
        F.col("index").cast("long").alias("arrival"),
        at("user").alias("user_id"),
        at("item").alias("item_id"),
        at("rating").alias("rating"),
        at("unixtimestamp").alias("ts"),
    )


def recommendation_messages(served: DataFrame) -> DataFrame:
    """One JSON array of strings per answer: the user, then the items by rank."""
    items = F.transform(F.sort_array(F.collect_list(F.when(F.col("item_id").isNotNull(), F.struct("rank", "item_id")))), lambda x: x.item_id)
    keys = [c for c in ("batch", "cutoff", "arrival", "user_id") if c in served.columns]
    whole = F.transform(F.concat(F.array("user_id"), F.col("items")), lambda x: x.cast("string"))
    return (
        served.groupBy(*keys)
        .agg(items.alias("items"))
        .select(*(k for k in keys if k != "user_id"), F.to_json(whole).alias("value"))
    )


def parse_recommendation_messages(messages: DataFrame) -> DataFrame:
    """(user_id, item_id, rank) out of JSON answers; an empty answer gives a null item."""
    rest = [c for c in messages.columns if c != "value"]
    parts = F.transform(F.from_json("value", "array<string>"), lambda x: x.cast("long"))
    return (
        messages.select(*rest, parts.alias("parts"))
        .select(
            *rest,
            F.element_at("parts", 1).alias("user_id"),
            F.posexplode_outer(F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0)))).alias(
                "pos", "item_id"
            ),
        )
        .select(*rest, "user_id", "item_id", (F.col("pos") + 1).alias("rank"))
    )
