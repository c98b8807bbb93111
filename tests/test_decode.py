import json

from pyspark.sql import functions as F

from sensorlake import schemas
from sensorlake.operators import decode


def messages(spark, *texts):
    rows = [(i, None if t is None else (t if isinstance(t, bytes) else t.encode())) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "n int, value binary")


def by_number(df):
    return {row["n"]: row for row in df.collect()}


DETECTIONS = (
    '{"id":1,"type":"car","confidence":0.9}',
    '{"id":2,"type":"car","confidence":0.89,"extra":[1]}',
    '{"id":3,"type":"bicycle","confidence":null}',
    '{"id":"four","type":"car","confidence":0.95}',
    '{"id":5,"type":"car","confi',
    "",
    None,
    "{}",
    "null",
    " \t ",
    b"\xff\xfe",
)


def test_decode_keeps_every_message(spark):
    rows = by_number(decode.decode_json(messages(spark, *DETECTIONS), schemas.DETECTIONS, keep=["n"]))
    assert len(rows) == len(DETECTIONS)
    assert tuple(rows[0])[1:] == (1, "car", 0.9)
    assert tuple(rows[1])[1:] == (2, "car", 0.89)
    assert tuple(rows[3])[1:] == (None, "car", 0.95)
    for n in (4, 5, 6, 7, 8, 9, 10):
        assert tuple(rows[n])[1:] == (None, None, None)


def test_threshold_includes_the_bound_and_drops_missing(spark):
    rows = decode.decode_json(messages(spark, *DETECTIONS), schemas.DETECTIONS, keep=["n"])
    kept = by_number(decode.threshold_filter(rows, "confidence", 0.9))
    assert sorted(kept) == [0, 3]


def test_reasons(spark):
    rows = by_number(
        decode.classify_messages(messages(spark, *DETECTIONS), schemas.DETECTIONS, keep=["n"])
    )
    reasons = [rows[n]["reject_reason"] for n in range(len(DETECTIONS))]
    assert reasons == [
        None, None, None, "bad_field", "malformed", "empty", "null_value", None, "malformed",
        "empty", "malformed",
    ]
    assert rows[4]["message"] == DETECTIONS[4]


def test_usable_messages(spark):
    rows = decode.classify_messages(messages(spark, *DETECTIONS), schemas.DETECTIONS, keep=["n"])
    assert sorted(by_number(rows.filter(decode.is_usable()))) == [0, 1, 2, 3, 7]
    assert sorted(by_number(rows.filter(decode.is_usable(strict=True)))) == [0, 1, 2, 7]
    assert sorted(by_number(rows.filter(~decode.is_usable()))) == [4, 5, 6, 8, 9, 10]


def test_sensor_columns_and_times(spark):
    rows = decode.decode_sensor(
        messages(
            spark,
            '{"@timestamp":"2025-03-30T00:00:00.000Z","objId":7,"rsctypeId":"r1","TEMPERATURE":21.5,"new":1}',
            '{"@timestamp":"2025-03-30T00:00:00Z","objId":8}',
            "broken",
        )
    )
    assert rows.columns == schemas.SENSOR.fieldNames()
    good = rows.filter("objId = 7 AND unix_seconds(`@timestamp`) = 1743292800")
    assert good.select("rsctypeId", "TEMPERATURE", "TEMPERATURE1").collect() == [("r1", 21.5, None)]
    assert rows.filter("objId = 8 AND `@timestamp` IS NULL").count() == 1
    assert rows.count() == 3


def test_positions_keep_nested_text_and_allow_a_missing_id(spark):
    rows = decode.decode_positions(
        messages(
            spark,
            '{"tag_id":"t","x_position":1,"y_position":2.5,"timestamp":"2025-03-30T00:00:00Z",'
            '"anchor_info":{"a":[1,2]}}',
        )
    )
    row = rows.first()
    assert row["id"] is None and row["x_position"] == 1.0
    assert json.loads(row["anchor_info"]) == {"a": [1, 2]}


def test_json_messages_round_trip(spark):
    rows = spark.createDataFrame(
        [(1, "kör\"s", 0.5), (2, None, None)], schemas.DETECTIONS
    )
    sent = decode.to_json_messages(rows, key="id")
    assert dict(sent.dtypes) == {"key": "binary", "value": "binary"}
    records = [json.loads(bytes(row["value"])) for row in sent.orderBy("key").collect()]
    assert records == [
        {"id": 1, "type": 'kör"s', "confidence": 0.5},
        {"id": 2, "type": None, "confidence": None},
    ]
    back = decode.decode_json(sent, schemas.DETECTIONS)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))


COMMANDS = {
    '{"command":"go","duration":2}': ("go", 2.0, "success"),
    '{"command":"go","duration":2.5}': ("go", 2.5, "success"),
    '{"command":"go","duration":1e3}': ("go", 1000.0, "success"),
    '{"command":"false","duration":0}': ("false", 0.0, "success"),
    '{"command":5,"duration":1}': ("5", 1.0, "success"),
    '{"command":"","duration":2}': ("", 2.0, "error"),
    '{"command":0,"duration":2}': ("0", 2.0, "error"),
    '{"command":null,"duration":2}': (None, 2.0, "error"),
    '{"duration":2}': (None, 2.0, "error"),
    '{"command":"go","duration":"2"}': ("go", None, "error"),
    '{"command":"go","duration":true}': ("go", None, "error"),
    '{"command":"go","duration":null}': ("go", None, "error"),
    '{"command":"go"}': ("go", None, "error"),
    '["go", 2]': (None, None, "error"),
    '{"command":"go","duration":2}}': (None, None, "error"),
    '{"command":"go","duration":2} more': (None, None, "error"),
    '{"command":"go","duration":2}]': (None, None, "error"),
    '{"command":"go","duration":2},"z":1': (None, None, "error"),
    '{"command":"go","dur': (None, None, "error"),
    "": (None, None, "error"),
}


def test_commands(spark):
    rows = by_number(decode.validate_commands(messages(spark, *COMMANDS), keep=["n"]))
    found = {
        text: (rows[n]["command"], rows[n]["duration"], rows[n]["status"])
        for n, text in enumerate(COMMANDS)
    }
    assert found == COMMANDS
    reasons = {row["message"] for row in rows.values()}
    assert reasons == {"Command sent successfully", "Invalid input", "Not a JSON object"}


def test_a_filter_on_decoded_fields_does_not_parse_twice(spark):
    rows = decode.decode_json(messages(spark, *DETECTIONS), schemas.DETECTIONS)
    plan = decode.threshold_filter(rows, "confidence", 0.9)._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("from_json") == 1


def test_decoding_needs_no_python_worker(spark):
    rows = decode.decode_sensor(messages(spark, *DETECTIONS))
    assert "Python" not in rows.filter(F.col("objId") > 1)._jdf.queryExecution().toString()
