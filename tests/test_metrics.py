import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sensorlake.functions import text
from sensorlake.operators import metrics
from sensorlake.plans import broker_metrics


def plain_rule(line: str, strip_lines: bool):
    """One line the plain way: (name, number) or None."""
    if strip_lines:
        line = line.strip()
    if not line or line.startswith("#"):
        return None
    head, blank, tail = line.rpartition(" ")
    if not blank or "_" in tail:
        return None
    try:
        return head.strip(), float(tail)
    except ValueError:
        return None


def parse(spark, lines, **options):
    df = spark.createDataFrame(list(enumerate(lines)), "n int, value string")
    rows = metrics.parse_lines(df, F.timestamp_seconds(F.lit(0)), keep=["n"], **options)
    return {row["n"]: (row["metric"], row["value"]) for row in rows.collect()}


def same(a, b):
    if a is None or b is None:
        return a is b
    equal = a[1] == b[1] or (math.isnan(a[1]) and math.isnan(b[1]))
    return a[0] == b[0] and equal


LINES = [
    "# HELP up 1", "", "   ", "up 1", '  up{a="x y"} 42.0  ', "up -", "up NaN", "up +Inf", "up -inf",
    "up 1e3", "up", "up  7", "up 1.", "up .5", "up 0x1p3", "up 12d", "up 12f", "up 1e", "up +nan",
    "up infinity", "up \t5", "up\t5", "a b c 3", " 4", "4 ", "up --1", "up 1,5", "up \u00a05", "up ٣",
    "up " + "9" * 5000, "# 5", " # 5", "up 5\r", "up 1e400",
]


@pytest.mark.parametrize("strip_lines", [True, False])
def test_lines_follow_the_plain_rule(spark, strip_lines):
    # Digits of other scripts are not part of the text format.
    lines = [line for line in LINES if "٣" not in line]
    found = parse(spark, lines, strip_lines=strip_lines)
    for n, line in enumerate(lines):
        assert same(found.get(n), plain_rule(line, strip_lines)), line


@settings(max_examples=5, deadline=None)
@given(seed=st.integers(0, 10**6))
def test_random_lines_follow_the_plain_rule(spark, seed):
    draw = random.Random(seed)
    pieces = ["up", " ", "  ", "#", "-", "1", "2.5", "e3", "NaN", "+Inf", "{a=\"b c\"}", "\t", "_", "inf"]
    lines = ["".join(draw.choices(pieces, k=draw.randint(0, 7))) for _ in range(500)]
    for strip_lines in (True, False):
        found = parse(spark, lines, strip_lines=strip_lines)
        for n, line in enumerate(lines):
            assert same(found.get(n), plain_rule(line, strip_lines)), repr(line)


def test_payload_lines(spark):
    payload = "up 1\r\n# c\n\ndown 2\rlast 3"
    df = spark.createDataFrame([(payload,)], "value string")
    rows = metrics.parse_lines(metrics.split_payload(df), F.current_timestamp())
    assert sorted((r["metric"], r["value"]) for r in rows.collect()) == [
        ("down", 2.0), ("last", 3.0), ("up", 1.0),
    ]
    assert payload.splitlines() == [r[0] for r in metrics.split_payload(df).collect()]


def test_name_filter_finds_the_name_anywhere(spark):
    names = ["x_" + metrics.IMPORTANT_METRICS[0] + '{a="b"}', metrics.IMPORTANT_METRICS[3], "jvm"]
    df = spark.createDataFrame([(n, 1.0) for n in names], "metric string, value double")
    assert sorted(r[0] for r in metrics.name_filter(df).collect()) == sorted(names[:2])
    assert df.select(metrics.row_text().alias("t")).first()["t"] == f"{names[0]}: 1.0"


def test_collect_makes_points(spark):
    lines = spark.createDataFrame([(f"{broker_metrics.RATED} 3",), ("jvm 1",)], "value string")
    (row,) = broker_metrics.collect(lines, F.timestamp_seconds(F.lit(5))).collect()
    assert (row["_measurement"], row["metric"], row["_field"], row["_value"]) == (
        "kafka_metrics", broker_metrics.RATED, "value", 3.0,
    )


RAW_NAMES = {
    "kafka.server<type=BrokerTopicMetrics, name=MessagesInPerSec><>Count":
        "kafka_server_brokertopicmetrics_messagesin_total",
    "kafka.server<type=BrokerTopicMetrics, name=BytesInPerSecond><>Count: 12":
        "kafka_server_brokertopicmetrics_bytesin_total",
    "kafka.server<type=ReplicaManager, name=PartitionCount><>Value":
        "kafka_server_replicamanager_partitioncount",
    "kafka.server<type=KafkaServer, name=BrokerState><>Value":
        "kafka_server_kafkaserver_brokerstate",
    "kafka.server<type=A-b, name=C. d><>Value": "kafka_server_a_b_c_d",
    "org.apache.zookeeper<name=Node$1Count><>Value": "zookeeper_node_1count",
    "java.lang<type=Memory><>used": None,
    "": None,
}


def test_first_matching_rule_names_the_metric(spark):
    df = spark.createDataFrame([(n,) for n in RAW_NAMES], "name string")
    rules = (*text.BROKER_RULES, *text.ZOOKEEPER_RULES)
    rows = metrics.rename(df, rules, drop_unmatched=False).collect()
    assert {r["name"]: r["metric"] for r in rows} == RAW_NAMES
    assert metrics.rename(df, rules).count() == 6


def test_a_name_does_not_start_with_a_digit(spark):
    rule = text.RenameRule("x(.+)", "$1")
    df = spark.createDataFrame([("x9a",)], "name string")
    assert metrics.rename(df, [rule]).first()["metric"] == "_9a"


def test_labels_of_a_metric(spark):
    metric = r'up{topic="a b",path="c:\\d\"e",n="1"}'
    df = spark.createDataFrame([(metric,), ("up",)], "metric string")
    rows = df.select(
        text.metric_labels(F.col("metric")).alias("l"), text.metric_base_name(F.col("metric")).alias("b")
    ).collect()
    assert rows[0]["l"] == {"topic": "a b", "path": r"c:\\d\"e", "n": "1"}
    assert rows[1]["l"] == {} and {r["b"] for r in rows} == {"up"}


def plain_relabel(labels):
    for prefix in ("container_", "pod_", "node_"):
        added = {k[len(prefix):]: v for k, v in labels.items() if k.startswith(prefix) and k != prefix}
        labels = {**labels, **added}
    for source, target in (("__meta_kubernetes_namespace", "namespace"), ("__meta_kubernetes_pod_name", "pod")):
        labels = {k: v for k, v in labels.items() if k != target}
        if source in labels and labels[source]:
            labels[target] = labels[source]
    return labels


def test_label_rules(spark):
    draw = random.Random(3)
    names = ["x", "container_x", "pod_x", "container_pod_x", "node_container_x", "pod_", "namespace",
             "pod", "__meta_kubernetes_namespace", "__meta_kubernetes_pod_name", "container_container_x"]
    sets = [{k: draw.choice(["a", "b", ""]) for k in draw.sample(names, draw.randint(0, 9))} for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(sets)), "n int, labels map<string,string>")
    for row in metrics.relabel(df).collect():
        assert row["labels"] == plain_relabel(sets[row["n"]]), sets[row["n"]]


def test_parsing_evaluates_each_line_once(spark):
    df = spark.createDataFrame([("up 1",)], "value string").repartition(2)
    costly = df.withColumn("value", F.regexp_replace("value", "x", "y"))
    plan = metrics.parse_lines(costly, F.current_timestamp())._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("regexp_replace") == 1
