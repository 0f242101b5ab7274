"""Line-delimited JSON: corpora, results, telemetry, logs, page trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORPUS = "chunk_id string, document_id string, _id string, title string, text string, content string"
RETRIEVAL = "qid string, question_id string, text string, question string, answer string, top_k_doc_id array<bigint>"
TELEMETRY = "ts double, type string, session_hash string, turn bigint, chars_saved bigint, tokens_saved bigint, doc_chars_saved bigint, block_chars_saved bigint, blocks_deduped bigint, blocks_total bigint, docs_deduped bigint, system_blocks_matched bigint, cumulative_chars_saved bigint"


def read_tolerant(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of readable lines; blank lines go, unreadable ones have ``malformed`` set and their text kept."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    own = T.StructType([*kind.fields, T.StructField("_malformed", T.StringType())])
    parsed = lines.select("value", F.from_json("value", own, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"}).alias("r"))
    return parsed.select("r.*", "value").withColumn("malformed", F.col("_malformed").isNotNull()).withColumnRenamed("value", "line").drop("_malformed")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title, text) of a corpus under any of the id and text names in use."""
    rows = spark.read.schema(CORPUS).json(path)
    return rows.select(F.coalesce("chunk_id", "document_id", "_id").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", "content").alias("text"))


def read_retrieval(spark: SparkSession, path: str) -> DataFrame:
    """(qid, text, answer, docs) of retrieval results; missing lists are empty, null ids go."""
    rows = spark.read.schema(RETRIEVAL).json(path)
    docs = F.filter(F.coalesce("top_k_doc_id", F.array().cast("array<bigint>")), lambda d: d.isNotNull())
    return rows.select(F.coalesce("qid", "question_id").alias("qid"), F.coalesce("text", "question").alias("text"), "answer", docs.alias("docs"))


def read_telemetry(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Telemetry records with ``at``, the time as a timestamp; as a stream of files if asked."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(TELEMETRY).json(path).withColumn("at", F.timestamp_seconds("ts"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(value): a log's lines."""
    return spark.read.text(path)


def read_page_trees(spark: SparkSession, path: str) -> DataFrame:
    """(doc_name, tree): one row a file of a nested page tree, named by the file without its ending."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_name"))
    return files.select(F.regexp_replace(F.regexp_replace("file", r"\.json$", ""), r"_structure$", "").alias("doc_name"), F.col("value").alias("tree"))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line; text stays as it is, not escaped to ASCII."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_results(scheduled: DataFrame, path: str, style: str = "jsonl", mode: str = "errorifexists") -> None:
    """Groups of scheduled contexts: one group a line, or ("json") one object a batch.

    Columns: batch, group_id, group_size, exec_pos, and what is to be written of each context.
    """
    rest = [c for c in scheduled.columns if c not in ("batch", "group_id", "group_size", "exec_pos")]
    item = F.struct("exec_pos", *rest)
    groups = scheduled.groupBy("batch", "group_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.max("group_size").alias("group_size"))
    if style == "json":
        groups = groups.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("group_id", "group_size", "items"))).alias("groups"))
    elif style != "jsonl":
        raise ValueError(f"unknown style {style!r}")
    write_jsonl(groups, path, mode)


def permuted(rows: DataFrame, order: DataFrame, index: str = "index") -> DataFrame:
    """``rows`` in the order of (index, position); positions of unknown rows go, a row named twice keeps its first position."""
    first = order.groupBy(index).agg(F.min("position").alias("position"))
    return rows.join(first, index).orderBy("position")


def append_telemetry(events: DataFrame, path: str, checkpoint: str | None = None):
    """Appends telemetry records, one compact object a line; a stream is written until stopped (the query is returned)."""
    own = events.select(*(c for c in events.columns if c in T._parse_datatype_string(TELEMETRY).names))
    if not events.isStreaming:
        own.write.mode("append").json(path)
        return None
    if checkpoint is None:
        raise ValueError("a stream needs a checkpoint folder")
    return own.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reorder_jsonl(spark: SparkSession, path: str, order: DataFrame, out: str, schema: str = RETRIEVAL) -> None:
    """Reads records, puts them in the order of (index, position), and writes them; ``index`` is a record's qid."""
    rows = spark.read.schema(schema).json(path).withColumn("index", F.coalesce("qid", "question_id"))
    write_jsonl(permuted(rows, order).drop("index", "position"), out)
