"""Growing files: appended, half-written, rotated and replaced ones, over restarts."""

import json
import os
import random
import tempfile

import pytest

from vigil.streaming import growing as G
from vigil.streaming import streams as ST


def take(spark, d, part_bytes=G.PART_BYTES):
    """Run the stream from its checkpoint over what is there now; all rows so far."""
    ST.run_to_table(G.growing_lines(spark, f"{d}/in", "*.ndjson*", part_bytes), f"{d}/out", f"{d}/ck")
    return [r.value for r in spark.read.parquet(f"{d}/out").orderBy("path", "start").collect()]


@pytest.fixture()
def d():
    d = tempfile.mkdtemp(prefix="vigil-growing-", dir="/tmp")
    os.mkdir(f"{d}/in")
    return d


def add(d, name, text, mode="a"):
    with open(f"{d}/in/{name}", mode, newline="") as f:
        f.write(text)


def test_appended_and_half_lines_arrive_once(spark, d):
    add(d, "a.ndjson", "1\n2\nhal")
    add(d, "b.ndjson", "no line end yet")
    assert sorted(take(spark, d)) == ["1", "2"]
    add(d, "a.ndjson", "f\n4\r\n")
    add(d, "b.ndjson", "\n")
    assert sorted(take(spark, d)) == ["1", "2", "4", "half", "no line end yet"]
    assert sorted(take(spark, d)) == ["1", "2", "4", "half", "no line end yet"]


def test_rotated_and_replaced_files(spark, d):
    add(d, "a.ndjson", "1\n2\n")
    assert sorted(take(spark, d)) == ["1", "2"]
    add(d, "a.ndjson", "3\n")  # appended before the rotation, not read yet
    os.rename(f"{d}/in/a.ndjson", f"{d}/in/a.ndjson.1")
    add(d, "a.ndjson", "new\n")
    assert sorted(take(spark, d)) == ["1", "2", "3", "new"]
    os.rename(f"{d}/in/a.ndjson.1", f"{d}/in/a.ndjson.2")
    os.rename(f"{d}/in/a.ndjson", f"{d}/in/a.ndjson.1")
    add(d, "a.ndjson.1", "newer\n")
    assert sorted(take(spark, d)) == ["1", "2", "3", "new", "newer"]
    add(d, "a.ndjson.1", "new\n", "w")  # written anew and shorter
    assert sorted(take(spark, d)) == ["1", "2", "3", "new", "new", "newer"]


@pytest.mark.parametrize("part_bytes", [1, 7, 64, 1 << 20])
def test_parts_take_each_line_once(d, part_bytes):
    rng = random.Random(part_bytes)
    lines = ["x" * rng.choice([0, 1, 5, 30]) + str(k) + "é" * rng.choice([0, 3]) for k in range(60)] + ["", ""]
    add(d, "a.ndjson", "\n".join(lines) + "\nopen")
    reader = G.GrowingReader(f"{d}/in", "*", part_bytes)
    end = reader.latestOffset()
    got = [v for p in reader.partitions({}, end) for b in reader.read(p) for v in b.column(2).to_pylist()]
    assert got == lines
    half = {"a.ndjson": [end["a.ndjson"][0], len("\n".join(lines[:20]).encode()) + 1]}
    got = [v for p in reader.partitions(half, end) for b in reader.read(p) for v in b.column(2).to_pylist()]
    assert got == lines[20:]


def test_a_planned_range_survives_a_rename_but_not_a_loss(d):
    add(d, "a.ndjson", "1\n2\n")
    reader = G.GrowingReader(f"{d}/in", "*", 100)
    (part,) = reader.partitions({}, reader.latestOffset())
    os.rename(f"{d}/in/a.ndjson", f"{d}/in/b.ndjson")
    add(d, "a.ndjson", "other\n")
    assert [v for b in reader.read(part) for v in b.column(2).to_pylist()] == ["1", "2"]
    add(d, "b.ndjson", "gone\n", "w")
    with pytest.raises(FileNotFoundError):
        list(reader.read(part))


def test_blocks(d, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 5)
    monkeypatch.setattr(G, "BATCH_LINES", 3)
    add(d, "a.ndjson", "a long first line\nb\n\nanother long line\nc" + "\nd" * 9 + "\nand no end of it")
    reader = G.GrowingReader(f"{d}/in", "*", 11)
    got = [v for p in reader.partitions({}, reader.latestOffset()) for b in reader.read(p) for v in b.column(2).to_pylist()]
    assert got == ["a long first line", "b", "", "another long line", "c"] + ["d"] * 9


def test_same_first_lines_and_empty_folder(spark, d):
    assert G.GrowingReader(f"{d}/nowhere", "*", 10).latestOffset() == {}
    add(d, "a.ndjson", "head\n1\n")
    add(d, "b.ndjson", "head\n2\n")
    assert sorted(take(spark, d)) == ["1", "2", "head", "head"]
    add(d, "b.ndjson", "3\n")
    assert sorted(take(spark, d)) == ["1", "2", "3", "head", "head"]


def test_events(spark, d):
    rows = [{"type": "network_event", "timestamp": "2024-01-01 10:00:00", "src_ip": "1.2.3.4"}, {"timestamp": "2024-01-01 11:00:00"}]
    add(d, "network_event_20240101.ndjson", "".join(json.dumps(r) + "\n" for r in rows) + "not json\n\n")
    df = G.growing_events(spark, f"{d}/in")
    ST.run_to_table(df, f"{d}/out", f"{d}/ck")
    got = sorted((r.type, r.src_ip or "", r._corrupt_record or "") for r in spark.read.parquet(f"{d}/out").collect())
    assert got == [("network_event", "1.2.3.4", ""), ("unknown", "", ""), ("unknown", "", "not json")]


def test_ingest_of_a_growing_file(spark, d):
    from vigil.streaming.ingest import await_all, start_ingest

    def line(minute):
        return json.dumps({"type": "network_event", "timestamp": f"2024-01-01 10:{minute:02d}:00", "src_ip": "1.2.3.4", "dst_port": 22}) + "\n"

    name = "network_event_20240101.ndjson"
    for k, text in enumerate([line(0) + line(1)[:20], line(1)[20:] + "broken\n" + line(2), ""]):
        add(d, name, text)
        await_all(start_ingest(spark, f"{d}/in", f"{d}/out", f"{d}/ck", growing=True))
        rows = spark.read.parquet(f"{d}/out/tables/network").collect()
        assert len(rows) == [1, 3, 3][k] == len({r.id for r in rows})
    assert sorted(r.timestamp.minute for r in rows) == [0, 1, 2]
    assert spark.read.parquet(f"{d}/out/alerts").count() == 3
    assert [r.value for r in spark.read.text(f"{d}/out/routed/_quarantine").collect()] == ["broken"]
