import json
from datetime import datetime

from sensorlake import schemas
from sensorlake.operators import inventory, logs
from sensorlake.sources import landed

ROLE = "node-role.kubernetes.io/"
NODES = [
    {
        "metadata": {
            "name": "n1",
            "creationTimestamp": "2024-01-01T00:00:00Z",
            "labels": {"arch": "x", ROLE + "control-plane": "", ROLE + "worker": "true"},
        },
        "status": {
            "conditions": [{"type": "MemoryPressure"}, {"type": "Ready"}],
            "nodeInfo": {"kubeletVersion": "v1.30"},
        },
    },
    {"metadata": {"name": "n2", "creationTimestamp": "2024-01-02T23:00:00Z"}, "status": {}},
    {
        "metadata": {"name": "n3", "creationTimestamp": "2024-01-02T23:59:30Z", "labels": {}},
        "status": {"conditions": [], "nodeInfo": {}},
    },
    {"metadata": {"name": "n4", "labels": {"a": "b"}}, "status": {"conditions": [{}]}},
]
WANTED = {
    ("n1", "Ready", "control-plane,worker", "2d", "v1.30"),
    ("n2", "N/A", "", "1h", "N/A"),
    ("n3", "N/A", "", "0m", "N/A"),
    ("n4", "N/A", "", None, "N/A"),
}
AS_OF = datetime(2024, 1, 3)


def test_nodes(spark):
    documents = spark.createDataFrame(
        [(json.dumps({"items": NODES[:2]}),), (json.dumps({"items": NODES[2:]}),), ("{}",)], "value string"
    )
    rows = inventory.nodes(inventory.explode_items(documents, schemas.NODE_ITEM), as_of=AS_OF)
    assert rows.columns == ["name", "status", "roles", "age", "version"]
    assert set(map(tuple, rows.collect())) == WANTED


def test_nodes_from_files(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"items": NODES}, indent=2))
    rows = inventory.nodes(landed.inventory_files(spark, str(folder), schemas.NODE_ITEM), as_of=AS_OF)
    assert set(map(tuple, rows.collect())) == WANTED


BOX = {
    "metadata": {
        "name": "b",
        "annotations": {"example.org/alias": "left"},
        "creationTimestamp": "2024-01-01T00:00:00Z",
    },
    "spec": {"metadata": {"rack": "r1", "cluster": "c1"}, "group": {"role": "Compute"}},
    "status": {
        "access": {"primary": {"address": "10.0.0.1"}},
        "power": "On",
        "state": "Running",
        "network": {"speed": "10G"},
        "version": "v1",
    },
}
FLAT = dict(
    name="b", alias="left", rack="r1", address="10.0.0.1", power="On", cluster="c1", role="Compute",
    state="Running", created_at="2024-01-01T00:00:00Z", updated_at="2024-01-01T00:00:00Z",
    network_speed="10G", version="v1",
)
BRANCHES = {
    ("metadata", "annotations"): ["alias"],
    ("metadata", "creationTimestamp"): ["created_at", "updated_at"],
    ("spec", "metadata"): ["rack", "cluster"],
    ("spec", "group"): ["role"],
    ("status", "access"): ["address"],
    ("status", "power"): ["power"],
    ("status", "state"): ["state"],
    ("status", "network"): ["network_speed"],
    ("status", "version"): ["version"],
}


def test_boxes_with_each_branch_missing(spark):
    documents, wanted = [{"items": [BOX]}], [FLAT]
    for (part, branch), columns in BRANCHES.items():
        box = json.loads(json.dumps(BOX))
        del box[part][branch]
        documents.append({"items": [box]})
        wanted.append({**FLAT, **dict.fromkeys(columns, "N/A")})
    df = spark.createDataFrame([(json.dumps(d),) for d in documents], "value string").coalesce(1)
    items = inventory.explode_items(df, schemas.BOX_ITEM)
    rows = inventory.boxes(items, alias_annotation="example.org/alias").collect()
    assert [row.asDict() for row in rows] == wanted


LOG_LINES = {
    "2025-01-01T00:00:00.123456789Z stdout F service started":
        ("2025-01-01T00:00:00.123456789Z", "stdout", "F", "service started"),
    "2025-01-01T00:00:00.123456789Z stderr P ": ("2025-01-01T00:00:00.123456789Z", "stderr", "P", ""),
    "2025-01-01T00:00:00.123456789Z stdout F  two  blanks ":
        ("2025-01-01T00:00:00.123456789Z", "stdout", "F", " two  blanks "),
    "2025-01-01T00:00:00.123456789Z stdout F tab\tand mark":
        ("2025-01-01T00:00:00.123456789Z", "stdout", "F", "tab\tand mark"),
    "2025-01-01T00:00:00.123456Z stdout F short": (None,) * 4,
    "2025-01-01T00:00:00.123456789Z stdout F": (None,) * 4,
    "2025-01-01T00:00:00.123456789Z  stdout F x": (None,) * 4,
    " 2025-01-01T00:00:00.123456789Z stdout F x": (None,) * 4,
    "2025-01-01T00:00:00.123456789Z stdout F " + "long " * 20_000:
        ("2025-01-01T00:00:00.123456789Z", "stdout", "F", "long " * 20_000),
    "2025-13-01T00:00:00.123456789Z stdout F month": 
        ("2025-13-01T00:00:00.123456789Z", "stdout", "F", "month"),
    "": (None,) * 4,
}


def test_log_lines(spark):
    df = spark.createDataFrame([(line,) for line in LOG_LINES], "value string")
    rows = logs.parse_logs(df)
    found = {r["body"]: (r["time"], r["stream"], r["tag"], r["message"]) for r in rows.collect()}
    assert found == LOG_LINES
    micros = rows.selectExpr("unix_micros(ts) AS u").filter("u IS NOT NULL").distinct().collect()
    assert micros == [(1735689600123456,)]
    assert logs.parse_logs(df, drop_unmatched=True).count() == 6


def test_log_files(spark, tmp_path):
    folder = tmp_path / "pods" / "ns_pod" / "app"
    folder.mkdir(parents=True)
    (folder / "0.log").write_text("2025-01-01T00:00:00.123456789Z stdout F hi\nnot a log line\n")
    rows = landed.log_files(spark, str(tmp_path / "pods/*/*/*.log")).collect()
    assert sorted(str(r["message"]) for r in rows) == ["None", "hi"]
    assert all(r["path"].endswith("0.log") for r in rows)
