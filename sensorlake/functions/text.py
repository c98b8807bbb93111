"""Column functions over metric names, label sets and log lines."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters a text strip removes, and the line ends of a payload.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# Fixed value: the forms a metric number may take. Possessive, so that a long
# digit run is read once.
NUMBER = (
    r"(?i)^[+-]?(?:inf(?:inity)?|nan|"
    r"(?:[0-9]++(?:\.[0-9]*+)?|\.[0-9]++)(?:e[+-]?[0-9]++)?)$"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def number(bare: Column) -> Column:
    """Text without outer blanks to double; null when it is not a number.

    ``NaN`` is a number.
    """
    return F.when(F.lower(bare).isin("+nan", "-nan"), F.lit(float("nan"))).when(
        bare.rlike(NUMBER), bare.try_cast("double")
    )


def after_last_space(text: Column) -> Column:
    return F.substring_index(text, " ", -1)


def before_last_space(text: Column) -> Column:
    """The part before the last space; null when there is no space."""
    head = F.length(text) - F.length(after_last_space(text)) - 1
    return F.when(head >= 0, text.substr(F.lit(1), head))


def contains_any(text: Column, names: Iterable[str]) -> Column:
    found = F.lit(False)
    for name in names:
        found = found | text.contains(name)
    return found


@dataclass(frozen=True)
class RenameRule:
    """A pattern searched in a raw name and the template of the new name."""

    pattern: str
    template: str


# Broker rules in order, then the coordination-service rule.
BROKER_RULES = (
    RenameRule(r"kafka.server<type=(.+), name=(.+)PerSec\w*><>Count", "kafka_server_$1_$2_total"),
    RenameRule(r"kafka.server<type=(.+), name=(.+)><>Value", "kafka_server_$1_$2"),
    RenameRule(
        r"kafka.server<type=KafkaServer, name=BrokerState><>Value", "kafka_server_broker_state"
    ),
    RenameRule(
        r"kafka.server<type=ReplicaManager, name=PartitionCount><>Value",
        "kafka_server_replica_manager_partition_count",
    ),
    RenameRule(
        r"kafka.server<type=GroupCoordinator, name=NumGroups><>Value",
        "kafka_server_group_coordinator_num_groups",
    ),
)
ZOOKEEPER_RULES = (RenameRule(r"org.apache.zookeeper<name=(.+)><>Value", "zookeeper_$1"),)


def renamed(raw: Column, rules: Sequence[RenameRule], lowercase: bool = True) -> Column:
    """The name the first matching rule gives; null when no rule matches.

    Patterns match anywhere in the raw name. Characters a metric name may not
    hold become one underscore, and a leading digit gets one.
    """
    branches = None
    for rule in rules:
        whole = rf"^[\s\S]*?(?:{rule.pattern})[\s\S]*$"
        name = F.regexp_replace(raw, whole, rule.template)
        hit = raw.rlike(rule.pattern)
        branches = F.when(hit, name) if branches is None else branches.when(hit, name)
    if branches is None:
        return F.lit(None).cast("string")
    safe = F.regexp_replace(branches, "[^a-zA-Z0-9:]+", "_")
    safe = F.regexp_replace(safe, "^([0-9])", "_$1")
    return F.lower(safe) if lowercase else safe


def metric_labels(metric: Column) -> Column:
    """The ``name="value"`` pairs of a metric's label text as a map."""
    pair = r'([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
    body = F.regexp_extract(metric, r"(?s)\{(.*)\}", 1)
    keys = F.regexp_extract_all(body, F.lit(pair), F.lit(1))
    values = F.regexp_extract_all(body, F.lit(pair), F.lit(2))
    return F.map_from_arrays(keys, values)


def metric_base_name(metric: Column) -> Column:
    return F.substring_index(metric, "{", 1)


# Label prefixes stripped in order, and labels copied afterwards.
LABEL_PREFIXES = ("container_", "pod_", "node_")
LABEL_COPIES = (
    ("__meta_kubernetes_namespace", "namespace"),
    ("__meta_kubernetes_pod_name", "pod"),
)


def relabel(
    labels: Column,
    prefixes: Sequence[str] = LABEL_PREFIXES,
    copies: Sequence[tuple[str, str]] = LABEL_COPIES,
) -> Column:
    """Apply the prefix rules in order, then the copies.

    A prefix rule adds each label that has the prefix under its bare name, in
    place of a label of that name. A copy sets the target label to the source's
    value; an absent or empty source removes the target. Relies on the session
    setting that the last entry of a key wins; without it Spark raises an error
    where two labels meet.
    """
    if prefixes:
        rules = F.array(*[F.lit(prefix) for prefix in prefixes])
        labels = F.aggregate(rules, labels, _strip_prefix)
    if copies:
        pairs = [F.struct(F.lit(a).alias("source"), F.lit(b).alias("target")) for a, b in copies]
        labels = F.aggregate(F.array(*pairs), labels, _copy_label)
    return labels


def _strip_prefix(labels: Column, prefix: Column) -> Column:
    found = F.map_filter(labels, lambda k, _: k.startswith(prefix) & (k != prefix))
    bare = F.transform_keys(found, lambda k, _: k.substr(F.length(prefix) + 1, F.length(k)))
    return F.map_concat(labels, bare)


def _copy_label(labels: Column, rule: Column) -> Column:
    value = F.try_element_at(labels, rule["source"])
    return F.when(
        F.coalesce(value, F.lit("")) != "",
        F.map_concat(labels, F.create_map(rule["target"], value)),
    ).otherwise(F.map_filter(labels, lambda k, _: k != rule["target"]))


# Fixed value: the container log line. Only a line feed ends it.
LOG_LINE = (
    r"(?d)^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{9}Z "
    r"[^\t\n\f\r ]+ [^\t\n\f\r ]+ [^\n]*\z"
)
