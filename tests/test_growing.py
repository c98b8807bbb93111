"""Log files that grow while a stream reads them."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from sensorlake.queries import inputs
from sensorlake.sources import growing, landed
from sensorlake.streaming import jobs


@pytest.fixture
def pods(spark, tmp_path):
    class Pods:
        folder = tmp_path / "pods" / "a" / "c"
        log = folder / "0.log"
        table = str(tmp_path / "table")

        def add(self, text, name="0.log"):
            with open(self.folder / name, "ab") as file:
                file.write(text.encode())

        def read(self, **options):
            rows = landed.log_tail(spark, str(tmp_path / "pods/*/*/*.log*"), **options)
            query = jobs.start_append(rows, self.table, str(tmp_path / "marks"), available_now=True)
            assert query.awaitTermination(120)
            assert query.exception() is None
            stored = jobs.read_batches(spark, self.table)
            return sorted(r["body"] for r in stored.collect())

    Pods.folder.mkdir(parents=True)
    return Pods()


def test_lines_added_later_are_read_once(pods):
    pods.add("one\ntwo\nthr")
    assert pods.read() == ["one", "two"]
    pods.add("ee\n\nfive")
    assert pods.read() == ["", "one", "three", "two"]
    assert pods.read() == ["", "one", "three", "two"]
    pods.add("\r\n")
    assert pods.read() == ["", "five", "one", "three", "two"]


def test_rotation_and_writing_anew(pods):
    pods.add("a1\na2\n")
    assert pods.read() == ["a1", "a2"]
    pods.add("a3\n")
    os.rename(pods.log, f"{pods.log}.20250101")
    pods.add("b1\n")
    pods.add("zipped", "0.log.20240101.gz")
    assert pods.read() == ["a1", "a2", "a3", "b1"]
    pods.log.write_text("")  # emptied in place
    pods.add("c1 is longer than what was there\n")
    assert pods.read()[-1].startswith("c1")
    os.remove(f"{pods.log}.20250101")  # read to its end, so nothing is lost
    pods.add("c2\n")
    assert pods.read() == ["a1", "a2", "a3", "b1", "c1 is longer than what was there", "c2"]


def test_a_backlog_is_split_at_lines(pods):
    lines = [f"{k:05d} " + "é" * (k % 50) for k in range(3000)]
    pods.add("\n".join(lines) + "\n")
    assert pods.read(part_bytes=1000) == lines
    pods.add("x" * 20_000 + "\nlast\n")
    assert pods.read(part_bytes=1000) == sorted([*lines, "x" * 20_000, "last"])


def test_a_file_that_is_gone_with_unread_lines_is_an_error(tmp_path):
    (tmp_path / "0.log").write_text("a\nb\n")
    reader = growing.GrowingReader({"path": f"file://{tmp_path}/*.log", "fail_on_loss": "true"})
    start = reader.latestOffset()
    (tmp_path / "0.log").write_text("a\nb\nc\n")
    end = reader.latestOffset()
    (part,) = reader.partitions(start, end)
    assert (part.start, part.stop) == (4, 6)
    os.rename(tmp_path / "0.log", tmp_path / "1.log")
    assert [b.column(0).to_pylist() for b in reader.read(part)] == [["c"]]
    os.remove(tmp_path / "1.log")
    with pytest.raises(growing.LostLines):
        list(reader.read(part))
    with pytest.raises(growing.LostLines):
        reader.partitions(start, end)
    tolerant = growing.GrowingReader({"path": f"{tmp_path}/*.log", "fail_on_loss": "false"})
    assert tolerant.partitions(start, end) == [] and list(tolerant.read(part)) == []


def test_files_without_a_beginning_wait(tmp_path):
    reader = growing.GrowingReader({"path": f"{tmp_path}/*"})
    (tmp_path / "a").write_text("no end of line yet")
    assert reader.latestOffset() == {}
    (tmp_path / "a").write_text("y" * 300)
    assert list(reader.latestOffset().values()) == [0]
    with open(tmp_path / "a", "a") as file:
        file.write("\nz")
    assert list(reader.latestOffset().values()) == [301]


def test_no_task_takes_the_whole_log_of_a_pod(spark, tmp_path, monkeypatch):
    """a pod's log was written by one task, which read all parts before as well."""
    rows = [(k, 0, 5 if k % 10 else 4, k % 3, f"{k:04d} é" + "x" * 50) for k in range(3000)]
    rows += [(7, 0, 5, 2, "twice")] * 2 + [(9, 1, 6, 2, "a pod's first line"), (None, 0, None, 0, "no key"), (None, 1, None, 2, "")]
    lines = spark.createDataFrame(rows, "doc_id long, line_no int, pod long, part int, value string").repartition(3)
    monkeypatch.setattr(inputs, "SLICE_BYTES", 4000, raising=False)
    taken, write = [], type(lines).foreachPartition

    def watched(dealt, function):
        values = dealt.withColumn("value", F.col("value").cast("binary")).rdd
        taken.append(values.mapPartitions(lambda own: [sum(len(row["value"]) for row in own)]).collect())
        write(dealt, function)

    monkeypatch.setattr(type(lines), "foreachPartition", watched)

    def written(pod, name="0.log"):
        return (tmp_path / f"ns_pod-{pod}/app" / name).read_bytes()

    def expected(pod, *parts):
        return sorted(row[4] for row in rows if row[2] == pod and row[3] in parts)

    for part in range(3):
        before = [written(pod) for pod in (4, 5, None)] if part else [b""] * 3
        inputs.grow_logs(lines, f"file://{tmp_path}", part, rotate=part == 2)
        assert sum(taken[-1]) == sum(len(row[4].encode()) for row in rows if row[3] == part) and max(taken[-1]) < 2 * 4000
        once = {path: path.read_bytes() for path in tmp_path.glob("*/app/*")}
        inputs.grow_logs(lines, f"file://{tmp_path}", part, rotate=part == 2)
        assert once == {path: path.read_bytes() for path in tmp_path.glob("*/app/*")}
        for pod, old in zip((4, 5, None), before, strict=True):
            renamed = part == 2 and pod != 5
            assert sorted(written(pod).decode().splitlines()) == expected(pod, *([2] if renamed else range(part + 1)))
            assert written(pod, "0.log.rotated") == old if renamed else written(pod).startswith(old)
    assert written(6) == b"a pod's first line\n"
