"""Scale properties of the physical plans (regression guard)."""

import io
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as E
from tools.plan_report import summarise

SF = "/root/testdata/sf0.001"


def _plan(spark, name):
    df = E.queries()[name](spark, SF)
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", ["dedup_first", "per_source_latest", "first_seen_connections",
                                  "first_seen_commands"])
def test_topk_uses_partial_group_limit(spark, name):
    assert summarise(_plan(spark, name))["window_group_limits"] >= 1


def test_time_window_filter_reaches_scan(spark):
    """The bound (newest timestamp - 24 h) is a scalar subquery that the
    parquet scan itself hosts as a runtime data filter (row-group pruning)."""
    import re

    text = _plan(spark, "fetch_window_24h")
    scan_ids = re.findall(r"^\((\d+)\) Scan parquet", text, re.M)
    hosts = re.findall(r"Hosting operator id = (\d+)", text)
    assert set(scan_ids) & set(hosts)


def test_column_pruning(spark):
    s = summarise(_plan(spark, "cron_metrics"))
    assert all("props" not in r and "value" not in r for r in s["read_schema"])


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql()) - {n for n in E.oracle_sql() if n.startswith("stream_")}
                                        - {"throttle_alerts"}))
def test_no_python_and_no_cartesian(spark, name):
    text = _plan(spark, name)
    s = summarise(text)
    assert not s["python"], s["python"]
    assert "CartesianProduct" not in text


def _top_level_lists(args: str) -> list[str]:
    groups, depth, start = [], 0, None
    for i, ch in enumerate(args):
        if ch in "[(":
            if ch == "[" and depth == 0:
                start = i + 1
            depth += 1
        elif ch in "])":
            depth -= 1
            if ch == "]" and depth == 0 and start is not None:
                groups.append(args[start:i])
                start = None
    return groups


def _window_partition_specs(text):
    """Partition-column lists of every Window operator in a formatted plan
    ("" for a window without PARTITION BY)."""
    import re

    specs = []
    for block in re.split(r"\n\n", text):
        if re.match(r"^\(\d+\) Window\s*$", block.split("\n", 1)[0]):
            args = re.search(r"Arguments: (.*)", block)
            if not args:
                continue
            groups = _top_level_lists(args.group(1))
            if len(groups) >= 3:
                specs.append(groups[1])
            elif len(groups) == 2 and not re.search(r"\b(ASC|DESC)\b", groups[1]):
                specs.append(groups[1])
            else:
                specs.append("")
    return specs


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql()) - {n for n in E.oracle_sql() if n.startswith("stream_")}
                                        - {"throttle_alerts"}))
def test_no_single_partition_window(spark, name):
    specs = _window_partition_specs(_plan(spark, name))
    assert all(s.strip() for s in specs), specs
