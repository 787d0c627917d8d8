"""Entity schemas."""

from __future__ import annotations

from pyspark.sql import types as T

_f = T.StructField

PROCESS = T.StructType([
    _f("id", T.LongType()), _f("timestamp", T.TimestampType()), _f("pid", T.IntegerType()),
    _f("user_name", T.StringType()), _f("cpu", T.DoubleType()), _f("memory", T.DoubleType()),
    _f("virt", T.LongType()), _f("res", T.LongType()), _f("shr", T.LongType()), _f("s", T.StringType()),
    _f("time_used", T.StringType()), _f("command", T.StringType()), _f("hashed_command", T.StringType()),
])

NETWORK = T.StructType([
    _f("id", T.LongType()), _f("timestamp", T.TimestampType()), _f("src_ip", T.StringType()),
    _f("dst_ip", T.StringType()), _f("src_port", T.IntegerType()), _f("dst_port", T.IntegerType()),
    _f("flags", T.StringType()), _f("bytes_sent", T.LongType()), _f("duration", T.DoubleType()),
    _f("protocol", T.StringType()),
])

COMMANDS = T.StructType([
    _f("id", T.LongType()), _f("timestamp", T.TimestampType()), _f("user_name", T.StringType()),
    _f("command", T.StringType()), _f("pid", T.IntegerType()),
])

CRON = T.StructType([
    _f("id", T.LongType()), _f("timestamp", T.TimestampType()), _f("cron_file", T.StringType()),
    _f("job", T.StringType()),
])

FILE_EVENT = T.StructType([
    _f("timestamp", T.TimestampType()), _f("file", T.StringType()), _f("last_modified", T.TimestampType()),
])

# Superset of every event type's fields; timestamps stay text until typed.
EVENT_ENVELOPE = T.StructType([
    _f("type", T.StringType()), _f("timestamp", T.StringType()),
    _f("user", T.StringType()), _f("command", T.StringType()), _f("pid", T.LongType()),
    _f("file", T.StringType()), _f("last_modified", T.StringType()),
    _f("cron_file", T.StringType()), _f("job", T.StringType()),
    _f("src_ip", T.StringType()), _f("dst_ip", T.StringType()),
    _f("src_port", T.LongType()), _f("dst_port", T.LongType()), _f("flags", T.StringType()),
    _f("bytes_sent", T.LongType()), _f("duration", T.DoubleType()), _f("protocol", T.StringType()),
    _f("_corrupt_record", T.StringType()),
])

INCIDENT = T.StructType([
    _f("type", T.StringType()), _f("source", T.StringType()), _f("severity", T.StringType()),
    _f("description", T.StringType()), _f("timestamp", T.TimestampType()),
])
