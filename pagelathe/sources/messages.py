"""Wire rows: tasks, results and payloads as JSON; topics as folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.sources import topic_log

TASK = "message_id string, task_id string, url string, domain string, priority int, engine_hint string, retry_count int, max_retries int"
RESULT = "task_id string, url string, status_code int, response_time_ms double, engine_used string, error_message string"
PAYLOAD = "task_id string, s3_bucket string, s3_raw_html_key string, s3_screenshot_key string, extraction_rules array<string>, callback_topic string"
#: Largest payload, in bytes.
MAX_PAYLOAD = 5_000_000
TOPICS = ["high", "normal", "low"]


def serialize(*columns: str | Column) -> Column:
    """JSON without the fields that are null."""
    return F.to_json(F.struct(*columns))


def parse(value: Column, schema: str) -> Column:
    """The row of a JSON text; broken texts give null fields and themselves in _corrupt_record."""
    return F.from_json(value, f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})


def good(messages: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """Parsed messages; broken ones are skipped."""
    return messages.select(parse(F.col(value), schema).alias("m")).where("m._corrupt_record IS NULL AND m IS NOT NULL").select("m.*").drop("_corrupt_record")


def broken(messages: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """The messages that good() skips, for a dead-letter sink."""
    return messages.select(value, parse(F.col(value), schema).alias("m")).where("m._corrupt_record IS NOT NULL OR m IS NULL").select(value)


def payload(task_id: Column, bucket: Column, html_key: Column, screenshot_key: Column | None = None, topic: str = "results") -> Column:
    """A pointer to stored HTML as JSON; never the HTML itself."""
    fields = [task_id.alias("task_id"), bucket.alias("s3_bucket"), html_key.alias("s3_raw_html_key")]
    if screenshot_key is not None:
        fields.append(screenshot_key.alias("s3_screenshot_key"))
    return serialize(*fields, F.array().cast("array<string>").alias("extraction_rules"), F.lit(topic).alias("callback_topic"))


def fits(message: Column) -> Column:
    return F.octet_length(message) <= MAX_PAYLOAD


def write_topics(messages: DataFrame, path: str, topic: str = "topic") -> None:
    """A folder for each topic."""
    messages.write.mode("append").partitionBy(topic).json(path)


def stream_topics(spark: SparkSession, path: str, schema: str = TASK, topics: list[str] = TOPICS, files: int = 500) -> DataFrame:
    """All topics together, without an order among them; files bounds what a micro-batch takes."""
    raw = spark.readStream.schema("value string, topic string").option("maxFilesPerTrigger", files).option("wholetext", False).format("text").load(path)
    return good(raw.where(F.col("topic").isin(topics)), schema)


def kafka_rows(messages: DataFrame, key: str = "task_id", topic: str = "topic", value: str = "value") -> DataFrame:
    """(key, value, topic) as the Kafka sink takes them."""
    return messages.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"), F.col(topic).alias("topic"))


def kafka_source(spark: SparkSession, servers: str, topics: list[str] = TOPICS, schema: str = TASK, offsets: int = 500, **options: str) -> DataFrame:
    """All topics of a Kafka cluster as one stream of parsed messages; offsets bounds what a micro-batch takes.

    Needs Spark's Kafka connector on the class path. Offsets are committed to the stream's checkpoint.
    """
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("maxOffsetsPerTrigger", offsets).options(**options)
    return good(reader.load().select(F.col("value").cast("string").alias("value")), schema)


def kafka_sink(messages: DataFrame, servers: str, checkpoint: str | None = None, **options: str):
    """Publishes rows of kafka_rows(): a batch at once (returns None), a stream from its checkpoint (returns the query)."""
    to = {"kafka.bootstrap.servers": servers} | options
    if not messages.isStreaming:
        return messages.write.format("kafka").options(**to).save()
    return messages.writeStream.format("kafka").options(**to).option("checkpointLocation", checkpoint).start()


def source(spark: SparkSession, conf: dict[str, str], schema: str = TASK) -> DataFrame:
    """The stream that a configuration names: Kafka where it has servers, a topic log where it has log, else folders under path.

    max_poll bounds what a micro-batch takes, group tells whose offsets are committed to a topic log.
    """
    if conf.get("servers"):
        return kafka_source(spark, conf["servers"], schema=schema, offsets=int(conf.get("max_poll", 500)))
    if conf.get("log"):
        topic_log.register(spark)
        options = {"path": conf["log"], "topics": ",".join(TOPICS), "max_poll": conf.get("max_poll", "0"), "group": conf.get("group", "default")}
        return good(spark.readStream.format("topic_log").options(**options).load(), schema)
    return stream_topics(spark, conf["path"], schema, files=int(conf.get("max_poll", 500)))


def publish(messages: DataFrame, conf: dict[str, str], key: str = "task_id") -> None:
    """Messages with columns key, topic and value to where source() reads them."""
    if conf.get("servers"):
        kafka_sink(kafka_rows(messages, key), conf["servers"])
    elif conf.get("log"):
        topic_log.register(messages.sparkSession)
        kafka_rows(messages, key).write.format("topic_log").option("path", conf["log"]).mode("append").save()
    else:
        messages.select("topic", "value").write.mode("append").partitionBy("topic").text(conf["path"])
