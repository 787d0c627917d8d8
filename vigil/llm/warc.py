"""WARC archives in Zstandard: one frame per record, the dictionary in a leading
skippable frame.

Writing: payloads of equal bytes are grouped on a narrow (hash, id) table; the
largest id of a group is a ``response``, the others are ``revisit`` records
that refer to it.  Tasks stream their rows into archives in the shared folder
(``pyarrow.fs``; closed under a temporary name, then renamed) and return a
manifest.  Only archives named there are read, so what a lost or repeated
attempt left behind is never seen.

Reading: Spark's ``binaryFile`` source opens the archives, so any store that
Spark reads will do.  A task loads the dictionary, walks the frames, decodes
one frame at a time and checks each record: version line, mandatory headers,
declared length against the block, the closing empty lines, one record per
frame, the dictionary's id, HTTP length and SHA-1 digest of the payload.  A
record that fails comes back with its ``error``, never silently dropped.

* Null payloads count as empty; a null url becomes ``about:blank``.
* Equal rows of the largest id are all responses; a null id is smaller than
  any other, and its record refers by ``null``.
* An empty table gives no archive and an empty result; unread columns may have
  any name.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import Scratch, checked_broadcast
from vigil.session import shared_dir

ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
DICT_MAGIC = b"\x37\xa4\x30\xec"
#: Skippable frame that holds the dictionary (plain or as a Zstandard frame).
DICT_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:x-page:"

MANIFEST = "name string, records long, bytes long"
RECORDS = ("archive string, offset long, record_type string, record_id string, target_uri string, payload binary, "
           "payload_bytes long, payload_digest string, refers_to string, error string")


# -- one record -------------------------------------------------------------------------

def digest(payload: bytes) -> str:
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header value without characters that end or bend a line."""
    from urllib.parse import quote

    return "".join(c if c > " " and c != "\x7f" else quote(c) for c in value)


def record(page_id, url: str | None, payload: bytes, refers_to, revisit: bool, date: str) -> bytes:
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    name = "null" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{NAME}{name}>",
            f"WARC-Date: {date}", f"WARC-Target-URI: {_line(url) if url else 'about:blank'}",
            f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{NAME}{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of one record; ``error`` says what is wrong with it."""
    out = dict.fromkeys(("record_type", "record_id", "target_uri", "payload", "payload_bytes", "payload_digest", "refers_to", "error"))

    def fail(why: str) -> dict:
        return out | {"error": why}

    end = data.find(b"\r\n\r\n")
    if end < 0:
        return fail("no end of header")
    lines = data[:end].decode("utf-8", "replace").split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        return fail("no WARC version line")
    head: dict[str, str] = {}
    for x in lines[1:]:
        key, colon, value = x.partition(":")
        if not colon or not key.strip():
            return fail(f"malformed header line {x[:60]!r}")
        head.setdefault(key.strip().lower(), value.strip())
    for key in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if key not in head:
            return fail(f"no {key}")
    out |= {"record_type": head["warc-type"], "record_id": head["warc-record-id"].strip("<>"),
            "target_uri": head.get("warc-target-uri"), "refers_to": head.get("warc-refers-to", "").strip("<>") or None}
    if not head["content-length"].isdigit():
        return fail("content-length is no number")
    length, block = int(head["content-length"]), data[end + 4:]
    if len(block) < length + 4:
        return fail(f"block of {len(block)} bytes is shorter than content-length {length} and its end")
    if block[length:] != b"\r\n\r\n":
        return fail("no empty lines, or more than one record, behind the block")
    block = block[:length]
    named = head.get("warc-payload-digest")
    if named is not None:
        kind, _, value = named.partition(":")
        if kind.lower() != "sha1":
            return fail(f"unknown digest {kind[:20]}")
        out["payload_digest"] = value
    if not head.get("content-type", "").startswith("application/http"):
        out["payload"], out["payload_bytes"] = block, len(block)
        return out if named is None or digest(block) == out["payload_digest"] else fail("payload digest differs")
    cut = block.find(b"\r\n\r\n")
    if cut < 0:
        return fail("no end of HTTP header")
    http = {k.strip().lower(): v.strip() for k, _, v in
            (x.partition(":") for x in block[:cut].decode("latin-1").split("\r\n")[1:])}
    payload, said = block[cut + 4:], http.get("content-length", "")
    if out["record_type"] == "revisit":
        if out["refers_to"] is None or named is None:
            return fail("revisit without what it refers to, or without digest")
        if payload:
            return fail("revisit with a payload")
        return out | {"payload_bytes": int(said)} if said.isdigit() else fail("no HTTP length")
    out["payload"], out["payload_bytes"] = payload, len(payload)
    if said and (not said.isdigit() or int(said) != len(payload)):
        return fail("HTTP length differs")
    if named is not None and digest(payload) != out["payload_digest"]:
        return fail("payload digest differs")
    return out


# -- one archive ------------------------------------------------------------------------

def dictionary_frame(data: bytes) -> bytes:
    import zstandard

    packed = zstandard.ZstdCompressor(level=19).compress(data)
    body = packed if len(packed) < len(data) else data
    return struct.pack("<II", DICT_FRAME, len(body)) + body


def frame_end(buf: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, by its header and block sizes."""
    import zstandard

    head = bytes(buf[at:at + 18])
    params, pos = zstandard.get_frame_parameters(head), at + zstandard.frame_header_size(head)
    while True:
        if pos + 3 > len(buf):
            raise ValueError("frame is cut off")
        word = buf[pos] | buf[pos + 1] << 8 | buf[pos + 2] << 16
        last, kind, size = word & 1, word >> 1 & 3, word >> 3
        if kind == 3:
            raise ValueError("reserved block type")
        pos += 3 + (1 if kind == 1 else size)
        if last:
            pos += 4 * params.has_checksum
            if pos > len(buf):
                raise ValueError("frame is cut off")
            return pos


def read_archive(content: bytes) -> Iterator[dict]:
    """The records of one archive in order, each with the offset of its frame."""
    import zstandard

    buf, at, book, first = memoryview(content).cast("B"), 0, None, True
    plain = zstandard.ZstdDecompressor()
    blank = parse_record(b"")
    while at < len(buf):
        try:
            magic = struct.unpack_from("<I", buf, at)[0]
            if magic in SKIPPABLE:
                size = struct.unpack_from("<I", buf, at + 4)[0]
                body = bytes(buf[at + 8:at + 8 + size])
                if len(body) < size:
                    raise ValueError("skippable frame is cut off")
                if magic == DICT_FRAME and first:
                    body = plain.decompressobj().decompress(body) if body[:4] == ZSTD_MAGIC else body
                    if body[:4] != DICT_MAGIC:
                        raise ValueError("the leading skippable frame holds no dictionary")
                    book = zstandard.ZstdCompressionDict(body)
                at, first = at + 8 + size, False
                continue
            end = frame_end(buf, at)
        except (ValueError, struct.error, zstandard.ZstdError) as e:
            # Without the frame's end nothing behind it can be found.
            yield blank | {"offset": at, "error": f"archive: {e}"}
            return
        first = False
        frame = bytes(buf[at:end])
        try:
            wants = zstandard.get_frame_parameters(frame).dict_id
            if wants and (book is None or book.dict_id() != wants):
                raise ValueError(f"frame wants dictionary {wants}")
            data = zstandard.ZstdDecompressor(dict_data=book).decompressobj().decompress(frame) if book \
                else plain.decompressobj().decompress(frame)
            yield parse_record(data) | {"offset": at}
        except (ValueError, zstandard.ZstdError) as e:
            yield blank | {"offset": at, "error": f"frame: {e}"}
        at = end


# -- on Spark ---------------------------------------------------------------------------

def _payload(col: Column) -> Column:
    return F.coalesce(col.cast("binary"), F.lit(b""))


def train_dictionary(pages: DataFrame, id_col: str, payload_col: str, rows: int = 256, size: int = 16 * 1024) -> bytes | None:
    """A dictionary from at most ``rows`` records by hash order, 8 KB of each
    (it only helps compression; records are written whole).  None if there
    are too few to train one."""
    import zstandard

    order = F.xxhash64(id_col)
    first = [r[0] for r in pages.select(order.alias("o")).orderBy("o").limit(rows).collect()]  # numbers only
    few = (pages.where(order <= F.lit(max(first, default=0))).select(F.substring(_payload(F.col(payload_col)), 1, 8192).alias("p"))
           .limit(rows).collect())
    samples = [record(i, "http://example.com/", bytes(r.p), None, False, "1970-01-01T00:00:00Z") for i, r in enumerate(few)]
    try:
        return zstandard.train_dictionary(size, samples, d=8, k=256).as_bytes()
    except zstandard.ZstdError:
        return None


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_revisit_bytes: int = 0, max_archive_bytes: int = 16 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row into archives in ``folder``; the manifest
    (name, records, bytes), already written down."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"),
                        _payload(F.col(payload_col)).alias("_payload"))
    keyed = base.withColumn("_h", F.unhex(F.sha2("_payload", 256)))
    groups = scratch.cut(keyed.where(F.octet_length("_payload") >= min_revisit_bytes).groupBy("_h")
                         .agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_first")).where("_n > 1").drop("_n"), "groups")
    refer = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("_id"))
    rows = (keyed.join(checked_broadcast(groups), "_h", "left")
            .select(F.col("_id").cast("string").alias("id"), F.col("_url").alias("url"), F.col("_payload").alias("payload"),
                    F.when(refer, F.col("_first")).cast("string").alias("refers_to"), refer.alias("revisit")))
    book = train_dictionary(pages, id_col, payload_col)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import zstandard
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        trained = zstandard.ZstdCompressionDict(book) if book else None
        if trained:
            trained.precompute_compress(level=3)
        packer = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True) if not trained else \
            zstandard.ZstdCompressor(dict_data=trained, write_checksum=True)
        out, name, made, n, size = None, "", [], 0, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                store.move(f"{root}/.{name}.part", f"{root}/{name}")
                made.append((name, n, size))
                out = None

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.zst", 0, 0
                    out = store.open_output_stream(f"{root}/.{name}.part")
                    if book:
                        lead = dictionary_frame(book)
                        out.write(lead)
                        size += len(lead)
                frame = packer.compress(record(r["id"], r["url"], r["payload"], r["refers_to"], r["revisit"], date))
                out.write(frame)
                n, size = n + 1, size + len(frame)
                if size >= max_archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()),
                                          pa.array([m[2] for m in made], pa.int64())], names=["name", "records", "bytes"])

    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    if "://" not in folder and not folder.startswith("/"):
        raise ValueError("the archive folder must be an absolute path or a URI")
    return scratch.cut(rows.mapInArrow(write, MANIFEST), "manifest")


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """The records of all archives in ``folder`` (of those in ``manifest``), see ``RECORDS``."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
             .withColumn("name", F.element_at(F.split("path", "/"), -1)))
    if manifest is not None:
        files = files.join(checked_broadcast(manifest.select("name")), "name", "left_semi")

    fields = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(f, kinds[k]) for f, k in (x.split() for x in RECORDS.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                held, size = [], 0
                for rec in read_archive(content.as_buffer()):
                    held.append(rec | {"archive": name.as_py()})
                    size += len(rec["payload"] or b"") + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema=schema)

    assert fields[0] == "archive"
    return files.select("name", "content").mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame, id_col: str = "page_id", **kw) -> DataFrame:
    """Write ``pages`` into archives and read them back: the records with
    ``page_id`` and ``refers_to`` as ids of the table."""
    spark = pages.sparkSession
    kind = dict(pages.dtypes)[id_col]
    folder = shared_dir(spark, "warc-archives")
    manifest = write_archives(pages, folder, id_col=id_col, **kw)
    back = read_archives(spark, folder, manifest)

    def as_id(col: Column) -> Column:
        text = F.regexp_replace(col, f"^{NAME}", "")
        return F.when(text != "null", text).try_cast(kind)

    return back.withColumn("refers_to", as_id(F.col("refers_to"))).withColumn(id_col, as_id(F.col("record_id")))
