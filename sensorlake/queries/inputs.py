"""Operator inputs derived from the given tables, row for row."""

from __future__ import annotations

import itertools
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake import schemas
from sensorlake.session import prepare

# Example annotation key of the box documents built below.
ALIAS = "example.org/alias"

# Tasks that write logs at least, and the bytes of log lines from which there are more.
LOG_SLICES = 8
SLICE_BYTES = 32 << 20

METRIC_NAME = """CASE event_type
    WHEN 'click' THEN 'kafka_server_brokertopicmetrics_messagesin_total'
    WHEN 'view' THEN 'kafka_server_brokertopicmetrics_bytesin_total'
    WHEN 'purchase' THEN 'kafka_server_replicamanager_partitioncount'
    WHEN 'signup' THEN 'kafka_server_replicamanager_underreplicatedpartitions'
    ELSE 'jvm_threads_current' END"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def with_k(rows: DataFrame) -> DataFrame:
    """Events with the number in ``props``."""
    return rows.withColumn("k", F.regexp_extract("props", r"(\d+)", 1).try_cast("int"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def naive(df: DataFrame) -> DataFrame:
    """Timestamps as UTC wall-clock times, as the SQL check reads them."""
    zoned = {
        field.name: F.col(f"`{field.name}`").cast("timestamp_ntz")
        for field in df.schema.fields
        if field.dataType.typeName() == "timestamp"
    }
    return df.withColumns(zoned) if zoned else df


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(F.col(f"`{name}`"), 6) for name in names})


def points(rows: DataFrame) -> DataFrame:
    """Two traffic points per event; a few have no second one."""
    rows, k = with_k(rows), F.col("k")
    fields = F.array(
        F.struct(F.lit("rx_mibps").alias("_field"), F.col("value").alias("_value")),
        F.struct(F.lit("tx_mibps").alias("_field"), F.when(k >= 5, k * 0.5).alias("_value")),
    )
    return rows.select(
        F.col("ts").alias("_time"),
        F.when(F.col("event_type") == "signup", "disk_usage")
        .otherwise("network_traffic")
        .alias("_measurement"),
        F.col("event_type").alias("host"),
        F.concat(F.lit("eth"), F.col("user_id") % 4).alias("interfaces"),
        F.col("event_id").alias("seq"),
        F.inline(fields),
    ).filter(F.col("_value").isNotNull())


def hourly_points(rows: DataFrame) -> DataFrame:
    """The same points at the hour, so that later ones replace earlier ones."""
    hour = F.date_trunc("hour", F.col("_time").cast("timestamp"))
    return points(rows).withColumn("_time", hour)


def metric_points(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("ts").alias("_time"),
        F.lit("kafka_metrics").alias("_measurement"),
        F.expr(METRIC_NAME).alias("metric"),
        F.lit("value").alias("_field"),
        F.col("value").alias("_value"),
        F.col("event_id").alias("seq"),
    )


def metric_lines(rows: DataFrame) -> DataFrame:
    """One exposition line per event, with the odd lines a scrape may hold."""
    rows, k = with_k(rows), F.col("k")
    label = F.concat(F.lit('{topic="t '), (F.col("user_id") % 3).cast("string"), F.lit('"}'))
    name = F.concat(F.expr(METRIC_NAME), F.when(F.col("event_type") == "view", label).otherwise(""))
    number = F.col("value").cast("string")
    line = (
        F.when(k == 0, F.concat(F.lit("# HELP "), name, F.lit(" 5")))
        .when(k == 1, "")
        .when(k == 2, F.concat(name, F.lit(" -")))
        .when(k == 3, F.concat(name, F.lit(" +Inf")))
        .when(k == 4, name)
        .when(k == 5, F.concat(F.lit(" \t"), name, F.lit("  "), number, F.lit(" ")))
        .when(k == 6, F.concat(name, F.lit(" 1e3")))
        .when(k == 7, F.concat(name, F.lit(" 12d")))
        .otherwise(F.concat_ws(" ", name, number))
    )
    return rows.select("event_id", "ts", line.alias("value"))


def detection_messages(rows: DataFrame) -> DataFrame:
    """Detections in message envelopes; some cut off, empty, null or of a wrong type."""
    rows, k = with_k(rows), F.col("k")
    record = F.to_json(
        F.struct(
            F.col("user_id").alias("id"),
            F.col("event_type").alias("type"),
            (F.col("value") / 100).alias("confidence"),
            F.col("props").alias("extra"),
        )
    )
    body = (
        F.when(k == 0, F.lit(None).cast("string"))
        .when(k == 1, "")
        .when(k == 2, F.substring(record, 1, 12))
        .when(k == 3, F.concat(F.lit('{"id":"x",'), F.substring_index(record, ",", -3)))
        .when(k == 4, "[1, 2")
        .otherwise(record)
    )
    return envelope(rows, body, "detections")


def sensor_messages(rows: DataFrame) -> DataFrame:
    """Sensor records in message envelopes, some with bad times or cut off."""
    rows, k = with_k(rows), F.col("k")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    record = F.to_json(
        F.struct(
            F.when(k == 0, "yesterday").otherwise(stamp).alias("@timestamp"),
            F.col("user_id").alias("objId"),
            F.col("event_type").alias("rsctypeId"),
            F.col("value").alias("TEMPERATURE"),
            F.when(k > 50, F.col("value") + 1).alias("TEMPERATURE1"),
            k.cast("double").alias("HUMIDITY"),
            F.col("props").alias("unknown"),
        )
    )
    body = F.when(k == 1, F.substring(record, 1, 8)).when(k == 2, " ").otherwise(record)
    return envelope(rows, body, "sensors")


def position_messages(rows: DataFrame) -> DataFrame:
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    rows = with_k(rows)
    record = F.to_json(
        F.struct(
            F.when(F.col("k") >= 5, F.col("user_id")).alias("id"),
            F.col("event_type").alias("tag_id"),
            F.col("value").alias("x_position"),
            (-F.col("value")).alias("y_position"),
            stamp.alias("timestamp"),
            F.col("props").alias("anchor_info"),
        )
    )
    return envelope(rows, record, "positions")


def envelope(rows: DataFrame, body: Column, topic: str) -> DataFrame:
    return rows.select(
        F.col("event_id").cast("string").cast("binary").alias("key"),
        body.cast("binary").alias("value"),
        F.lit(topic).alias("topic"),
        F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.lit(0).alias("timestampType"),
    )


def command_messages(rows: DataFrame) -> DataFrame:
    """Commands that hold whole conversation texts, some of them not acceptable."""
    text, turn = F.col("text"), F.col("turn")
    plain = F.to_json(F.struct(text.alias("command"), (turn + 0.5).alias("duration")))
    body = (
        F.when(turn == 0, F.to_json(F.struct(text.alias("command"), turn.alias("duration"))))
        .when(turn == 1, F.to_json(F.struct(text.alias("command"), F.lit("5").alias("duration"))))
        .when(turn == 2, F.to_json(F.struct(F.lit("").alias("command"), turn.alias("duration"))))
        .when(turn == 3, F.to_json(F.struct(text.alias("command"), F.lit(True).alias("duration"))))
        .when(turn == 4, F.to_json(F.struct(turn.alias("duration"))))
        .when(turn == 5, F.concat(F.lit("["), plain, F.lit("]")))
        .when(turn == 6, F.concat(plain, F.lit("}")))
        .otherwise(plain)
    )
    return rows.select("conv_id", "turn", body.alias("value"))


def log_lines(documents: DataFrame) -> DataFrame:
    """Every line of every document as a container log line; French ones lack digits."""
    lines = documents.select("doc_id", "lang", F.posexplode(F.split("text", "\n")))
    digits = F.when(F.col("lang") == "fr", 6).otherwise(9)
    stamp = F.concat(
        F.lit("2024-01-02T03:04:05."), F.lpad(F.col("pos").cast("string"), digits, "0"), F.lit("Z")
    )
    line = F.concat_ws(" ", stamp, F.lit("stdout"), F.lit("F"), F.col("col"))
    return lines.select("doc_id", F.col("pos").alias("line_no"), line.alias("value"))


def grow_logs(lines: DataFrame, folder: str, part: int, *, rotate: bool = False) -> None:
    """Let the log file of each pod grow by its lines of a part; ``rotate`` renames every second file first.

    Tasks write as a container runtime does, to a place that all machines see. A
    pod may log more than one task should read, so the lines of a part are cut
    into slices by their hash, as many as their bytes ask for. Each task writes a
    slice, in each file behind the bytes of earlier parts and slices; one that
    runs again writes the same bytes there.
    """
    folder = folder.removeprefix("file://")
    lines = lines.withColumn("bytes", (F.octet_length("value") + 1).cast("long"))
    own, size = F.col("part") == part, F.col("bytes")
    pods = lines.filter(F.col("part") <= part).groupBy("pod")
    sizes = pods.agg(F.sum(F.when(own, 0).otherwise(size)).alias("before"), F.sum(F.when(own, size).otherwise(0)).alias("added")).collect()
    ends: dict[int | None, int] = {}
    for row in sizes:
        place = f"{folder}/ns_pod-{row['pod']}/app"
        os.makedirs(place, exist_ok=True)
        renamed = rotate and row["before"] > 0 and (row["pod"] or 0) % 2 == 0
        if renamed and not os.path.exists(f"{place}/0.log.rotated"):
            os.rename(f"{place}/0.log", f"{place}/0.log.rotated")
        open(f"{place}/0.log", "ab").close()
        ends[row["pod"]] = 0 if renamed else row["before"]

    slices = max(LOG_SLICES, -(-sum(row["added"] for row in sizes) // SLICE_BYTES))
    # Not the hash that deals lines to parts, which would leave slices empty.
    number = F.pmod(F.hash("doc_id", "line_no", "value"), F.lit(slices))
    sliced = lines.filter(own).select("pod", number.alias("slice"), F.col("value").cast("binary").alias("value"), "bytes")
    starts: dict[tuple[int | None, int], int] = {}
    found = sliced.groupBy("pod", "slice").agg(F.sum("bytes").alias("bytes")).collect()
    for row in sorted(found, key=lambda row: row["slice"]):
        starts[row["pod"], row["slice"]] = ends[row["pod"]]
        ends[row["pod"]] += row["bytes"]

    def write(rows):
        for key, texts in itertools.groupby(rows, key=lambda row: (row["pod"], row["slice"])):
            with open(f"{folder}/ns_pod-{key[0]}/app/0.log", "r+b", buffering=1 << 20) as file:
                file.seek(starts[key])
                file.writelines(bytes(row["value"]) + b"\n" for row in texts)

    dealt = sliced.drop("bytes").repartitionById(slices, F.col("slice"))
    dealt.sortWithinPartitions("pod", "slice", "value").foreachPartition(write)


def node_documents(orders: DataFrame) -> DataFrame:
    """An inventory document per order: one full node and one with parts missing."""
    role = F.lower(F.substring_index("o_orderpriority", "-", -1))
    labels = F.map_concat(
        F.create_map(F.lit("kubernetes.io/arch"), F.lit("amd64")),
        F.create_map(F.concat(F.lit("node-role.kubernetes.io/"), role), F.lit("")),
        F.when(
            F.col("o_orderstatus") == "O",
            F.create_map(F.lit("node-role.kubernetes.io/worker"), F.lit("")),
        ).otherwise(F.create_map(F.lit("zone"), F.lit("a"))),
    )
    conditions = F.when(
        F.col("o_orderstatus") == "F", F.array(F.lit("MemoryPressure"), F.lit("Ready"))
    ).when(F.col("o_orderstatus") == "O", F.array().cast("array<string>"))
    version = F.when(
        F.col("o_totalprice") >= 100_000,
        F.struct(F.concat(F.lit("v1."), F.col("o_custkey")).alias("kubeletVersion")),
    )
    created = F.date_format(
        F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"
    ).alias("creationTimestamp")
    name = F.concat(F.lit("node-"), F.col("o_orderkey"))
    full = F.to_json(
        F.struct(
            F.struct(name.alias("name"), labels.alias("labels"), created).alias("metadata"),
            F.struct(
                F.transform(conditions, lambda c: F.struct(c.alias("type"))).alias("conditions"),
                version.alias("nodeInfo"),
            ).alias("status"),
        )
    )
    bare = F.to_json(
        F.struct(
            F.struct(F.concat(name, F.lit("-b")).alias("name"), created).alias("metadata"),
            F.struct(version.alias("nodeInfo")).alias("status"),
        )
    )
    document = F.concat(F.lit('{"items":['), full, F.lit(","), bare, F.lit("]}"))
    return orders.select(document.alias("value"))


def box_documents(customers: DataFrame) -> DataFrame:
    """An inventory document per customer; each optional branch is missing somewhere."""
    nation = F.col("c_nationkey")
    record = F.struct(
        F.struct(
            F.col("c_name").alias("name"),
            F.when(
                F.col("c_mktsegment") != "BUILDING",
                F.create_map(F.lit(ALIAS), F.col("c_mktsegment")),
            ).alias("annotations"),
            F.when(nation != 1, F.lit("2024-01-01T00:00:00Z")).alias("creationTimestamp"),
        ).alias("metadata"),
        F.struct(
            F.when(
                nation > 3,
                F.struct(
                    F.concat(F.lit("rack-"), nation).alias("rack"),
                    F.when(nation > 5, "default").alias("cluster"),
                ),
            ).alias("metadata"),
            F.when(F.col("c_acctbal") > 0, F.struct(F.lit("Compute").alias("role"))).alias("group"),
        ).alias("spec"),
        F.struct(
            F.when(
                nation < 20,
                F.struct(
                    F.when(
                        nation < 15,
                        F.struct(F.concat(F.lit("10.0.0."), nation).alias("address")),
                    ).alias("primary")
                ),
            ).alias("access"),
            F.when(F.col("c_acctbal") > 100, "On").alias("power"),
            F.when(nation != 7, "Running").alias("state"),
            F.when(nation != 8, F.struct(F.lit("10Gbps").alias("speed"))).alias("network"),
            F.when(nation != 9, "v2").alias("version"),
        ).alias("status"),
    )
    return customers.select(
        F.concat(F.lit('{"items":['), F.to_json(record), F.lit("]}")).alias("value")
    )


def raw_metric_names(rows: DataFrame) -> DataFrame:
    """Bean attribute names as the broker reports them, some matched by no rule."""
    rows, k = with_k(rows), F.col("k").cast("string")
    kind = F.col("event_type")
    rate = F.concat(
        F.lit("kafka.server<type=BrokerTopicMetrics, name=Bytes"), k, F.lit("InPerSec><>Count")
    )
    gauge = F.concat(
        F.lit("kafka.server<type=ReplicaManager, name=Partition-"), k, F.lit("><>Value: 4")
    )
    other = F.concat(F.lit("org.apache.zookeeper<name=Conn"), k, F.lit("><>Value"))
    name = (
        F.when(kind == "click", rate)
        .when(kind == "view", gauge)
        .when(kind == "purchase", "kafka.server<type=KafkaServer, name=BrokerState><>Value")
        .when(kind == "signup", other)
        .otherwise(F.concat(F.lit("java.lang<type=Memory><>used"), k))
    )
    return rows.select("event_id", name.alias("name"))


def label_sets(rows: DataFrame) -> DataFrame:
    """Label sets with prefixed, clashing and missing labels."""
    user = F.col("user_id").cast("string")
    labels = F.map_concat(
        F.create_map(
            F.lit("container_name"), F.col("event_type"), F.lit("container_pod_zone"), user
        ),
        F.when(
            F.col("event_type") != "error",
            F.create_map(F.lit("__meta_kubernetes_namespace"), F.concat(F.lit("ns"), user)),
        ).otherwise(F.create_map(F.lit("namespace"), F.lit("stays-not"))),
        F.when(
            F.col("event_type") == "click",
            F.create_map(F.lit("node_name"), F.lit("n"), F.lit("zone"), F.lit("old")),
        ).otherwise(F.create_map(F.lit("pod_"), F.lit("bare"))),
    )
    return rows.select("event_id", labels.alias("labels"))


MESSAGE_COLUMNS = schemas.MESSAGE.fieldNames()
