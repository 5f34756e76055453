"""Message recordings: one pass over a file gives its messages, channels and facts as a DataFrame.

A file is one task, read as a stream, so many recordings are read in parallel. Payloads are decoded
where they are read and dropped; what is kept of a message is its times, its header's time, and what
is wrong with it.
"""

from __future__ import annotations

import json
import math
import struct
import zlib
from collections.abc import Iterator
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SourceError
from ..functions.storage import Store
from .cdr import compile_schema
from .recording import EPISODES, Recording, Stream

MAGIC = b"\x89MCAP0\r\n"
#: The format's record types.
HEADER, FOOTER, SCHEMA, CHANNEL, MESSAGE, CHUNK, CHUNK_INDEX, ATTACHMENT, ATTACHMENT_INDEX, STATISTICS, METADATA, METADATA_INDEX, DATA_END = 1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12, 13, 15
ROWS = """kind string, pos long, channel_id int, topic string, log_time long, publish_time long, sequence long, header_stamp long, decode_error string,
    semantic array<string>, parents array<string>, children array<string>, message_encoding string, schema_id int, schema_name string, schema_encoding string, facts string"""
_BATCH = 4096


class Fields:
    """The fields of one record, in order."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def number(self, code: str) -> int:
        (out,) = struct.unpack_from("<" + code, self.raw, self.at)
        self.at += struct.calcsize("<" + code)
        return out

    def bytes(self, code: str = "I") -> bytes:
        n = self.number(code)
        if self.at + n > len(self.raw):
            raise ValueError("a record's field runs past the record")
        out, self.at = self.raw[self.at : self.at + n], self.at + n
        return out

    def text(self) -> str:
        return self.bytes().decode("utf-8")


def inner_records(raw: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(raw):
        op, n = struct.unpack_from("<BQ", raw, at)
        if at + 9 + n > len(raw):
            raise ValueError("a chunk's record runs past the chunk")
        yield op, raw[at + 9 : at + 9 + n]
        at += 9 + n


def unpacked(raw: bytes) -> bytes:
    """The records of a chunk, decompressed, their checksum tested."""
    f = Fields(raw)
    f.at = 16
    size, crc, kind, data = f.number("Q"), f.number("I"), f.text(), f.bytes("Q")
    if kind:
        data = pa.Codec(kind).decompress(data, size).to_pybytes()
    if len(data) != size or (crc and zlib.crc32(data) != crc):
        raise ValueError("the checksum of a chunk does not match")
    return data


def semantic_errors(schema: str, message: dict[str, Any]) -> tuple[list[str], list[str], list[str]]:
    """What is wrong with a decoded message of a known kind, and the edges of a transform tree."""
    bad: list[str] = []
    parents: list[str] = []
    children: list[str] = []
    finite = lambda xs: all(math.isfinite(float(x)) for x in xs)
    kind = schema.rpartition("/")[2]
    if kind == "JointState":
        names = len(message.get("name", []))
        for field in ("position", "velocity", "effort"):
            values = message.get(field, [])
            if values and len(values) != names:
                bad.append(f"{field} has {len(values)} values but name has {names} entries")
            if not finite(values):
                bad.append(f"JointState {field} contains a non-finite value")
    elif kind == "TFMessage":
        for t in message.get("transforms", []):
            parent, child = str(t.get("header", {}).get("frame_id", "")), str(t.get("child_frame_id", ""))
            if not parent or not child:
                bad.append("TF transform has an empty parent or child frame")
            elif parent == child:
                bad.append(f"TF transform self-references frame {parent!r}")
            parents.append(parent)
            children.append(child)
            for part in ("translation", "rotation"):
                vector = t.get("transform", {}).get(part)
                if vector is not None and not finite(vector.values()):
                    bad.append(f"TF {part} contains a non-finite value")
    elif kind == "Image":
        height, step, n = int(message.get("height", 0)), int(message.get("step", 0)), len(message.get("data", b""))
        if height <= 0 or step <= 0 or n != height * step:
            bad.append(f"Image payload has {n} bytes; expected height*step={height * step}")
    elif kind == "CompressedImage" and not message.get("data"):
        bad.append("CompressedImage payload is empty")
    return bad, parents, children


class Scan:
    """Reads a file once, record by record, and gives rows of ROWS."""

    def __init__(self, decode: bool | None):
        self.decode = decode  # None: as the header says
        self.schemas: dict[int, tuple[str, str, bytes]] = {}
        self.channels: dict[int, tuple[int, str, str]] = {}
        self.of: dict[int, Any] = {}
        self.facts: dict[str, Any] = {
            "profile": "", "library": "unknown", "summary": False, "chunk_indexes": 0, "attachments": 0, "metadata": 0, "data_channels": 0,
            "data_schemas": 0, "messages": 0, "error": None, "expected": None,
        }
        self.in_data = True
        self.rows: list[tuple] = []

    def read(self, stream: BinaryIO) -> Iterator[list[tuple]]:
        try:
            for op, raw in self._records(stream):
                self._record(op, raw, True)
                if len(self.rows) >= _BATCH:
                    yield self.rows
                    self.rows = []
        except (OSError, ValueError, struct.error, pa.ArrowException, KeyError) as e:
            self.facts["error"] = f"{type(e).__name__}: {e}"
        for k, (schema_id, topic, encoding) in sorted(self.channels.items()):
            name, kind, _ = self.schemas.get(schema_id, (None, None, b""))
            self.rows.append(("channel", None, k, topic, None, None, None, None, None, None, None, None, encoding, schema_id, name, kind, None))
        self.rows.append(("facts", *[None] * 15, json.dumps(self.facts)))
        yield self.rows

    def _records(self, stream: BinaryIO) -> Iterator[tuple[int, bytes]]:
        if stream.read(len(MAGIC)) != MAGIC:
            raise ValueError("the file does not begin as a message recording does")
        crc = zlib.crc32(MAGIC)
        while True:
            head = stream.read(9)
            if len(head) < 9:
                raise ValueError("the file ends before its last record")
            op, n = struct.unpack("<BQ", head)
            raw = stream.read(n)
            if len(raw) < n:
                raise ValueError("the file ends inside a record")
            if op == DATA_END:
                (want,) = struct.unpack("<I", raw[:4])
                if want and want != crc:
                    raise ValueError("the checksum of the data section does not match")
                self.in_data, crc = False, 0
                continue
            if op == FOOTER:
                start, _, want = struct.unpack("<QQI", raw[:20])
                if want and want != zlib.crc32(head + raw[:16], crc):
                    raise ValueError("the checksum of the summary does not match")
                self.facts["summary"] = start > 0
                if stream.read(len(MAGIC)) != MAGIC:
                    raise ValueError("the file does not end as a message recording does")
                return
            crc = zlib.crc32(raw, zlib.crc32(head, crc))
            yield op, raw

    def _record(self, op: int, raw: bytes, outer: bool) -> None:
        f, facts = Fields(raw), self.facts
        if op == HEADER:
            facts["profile"], facts["library"] = f.text(), f.text()
            if self.decode is None:
                self.decode = facts["profile"].lower() == "ros2"
        elif op == SCHEMA:
            k = f.number("H")
            self.schemas[k] = (f.text(), f.text(), f.bytes())
            facts["data_schemas"] += self.in_data
        elif op == CHANNEL:
            k, schema = f.number("H"), f.number("H")
            self.channels[k] = (schema, f.text(), f.text())
            facts["data_channels"] += self.in_data
        elif op == MESSAGE:
            self._message(f)
        elif op == CHUNK and outer:
            for inner, data in inner_records(unpacked(raw)):
                self._record(inner, data, False)
        elif op == ATTACHMENT:
            facts["attachments"] += 1
        elif op == METADATA:
            facts["metadata"] += 1
        elif op == CHUNK_INDEX:
            facts["chunk_indexes"] += 1
        elif op == STATISTICS:
            messages, schemas, channels, attachments, metadata = (f.number(c) for c in "QHIII")
            f.at += 20
            counts = f.bytes()
            facts["expected"] = {
                "message_count": messages, "channel_count": channels, "schema_count": schemas, "attachment_count": attachments, "metadata_count": metadata,
                "channels": {str(k): n for k, n in struct.iter_unpack("<HQ", counts)},
            }

    def _message(self, f: Fields) -> None:
        channel, sequence, log, publish = f.number("H"), f.number("I"), f.number("Q"), f.number("Q")
        schema_id, topic, encoding = self.channels[channel]
        stamp = error = semantic = parents = children = None
        if self.decode:
            try:
                decoder = self.of.get(channel)
                name, kind, text = self.schemas.get(schema_id, ("", None, b""))
                if decoder is None:
                    if encoding != "cdr" or kind != "ros2msg":
                        raise ValueError(f"unsupported encoding {encoding!r} with schema {kind!r}")
                    decoder = self.of[channel] = compile_schema(name, text.decode("utf-8"))
                message = decoder(f.raw[f.at :])
                at = message.get("header", {})
                at = at.get("stamp") if isinstance(at, dict) else None
                if isinstance(at, dict):
                    stamp = int(at.get("sec", 0)) * 1_000_000_000 + int(at.get("nanosec", 0))
                semantic, parents, children = semantic_errors(name, message)
            except Exception as e:  # noqa: BLE001 - a message that cannot be decoded is a finding
                error = f"{type(e).__name__}: {e}"
        self.rows.append(("message", self.facts["messages"], channel, topic, log, publish, sequence, stamp, error, semantic, parents, children, encoding, schema_id, None, None, None))
        self.facts["messages"] += 1


_TYPES = [
    pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()),
    pa.list_(pa.string()), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(),
]
_NAMES = [x.split()[0] for x in ROWS.replace("\n", " ").split(",")]


def scanned(spark: SparkSession, uri: str, decode: bool | None) -> DataFrame:
    """Rows of ROWS: messages in stored order, then channels, then one of facts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = pa.fs.FileSystem.from_uri(path)
                with fs.open_input_stream(at) as stream:
                    for rows in Scan(decode).read(stream):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)

    import pyarrow.fs  # noqa: F401 - so that workers know it by name

    return spark.createDataFrame([(uri,)], "uri string").mapInArrow(run, ROWS)


class Messages:
    """The tables of one message recording."""

    def __init__(self, recording: Recording, rows: DataFrame):
        self.all = rows
        self.source = recording.name
        self.channels = rows.where("kind = 'channel'").select("channel_id", "topic", "message_encoding", "schema_id", "schema_name", "schema_encoding")
        self.messages = rows.where("kind = 'message'").select("channel_id", "topic", "pos", "log_time", "publish_time", "sequence", "header_stamp", "decode_error", "semantic", "parents", "children")
        self.facts: dict[str, Any] = json.loads(rows.where("kind = 'facts'").select("facts").first().facts)


def open_messages(spark: SparkSession, store: Store, profile: str = "auto") -> Recording:
    if store.read(most=len(MAGIC)) != MAGIC:
        raise SourceError(f"{store.root} is not a message recording")
    decode = {"auto": None, "ros2": True, "generic": False}[profile]
    stem = store.name.rsplit(".", 1)[0]
    rec = Recording(spark, store, store.name, "mcap", "1.0", [], frozenset(), spark.createDataFrame([], EPISODES), 1)
    rec.messages = Messages(rec, rec.keep(scanned(spark, store.root, decode)))
    facts = rec.messages.facts
    rec.profile = profile if profile != "auto" else "ros2" if facts["profile"].lower() == "ros2" else "generic"
    rec.capabilities = frozenset({"mcap", "channels", "message_timestamps"} | ({"ros2", "ros2_decode"} if rec.profile == "ros2" else set()))
    channels = rec.messages.channels.orderBy("topic", "channel_id").collect()  # a row for each declared channel
    rec.streams = [Stream(c.topic, c.schema_name or c.message_encoding or "bytes", kind="image" if (c.schema_name or "").endswith(("/Image", "/CompressedImage")) else "message") for c in channels]
    rec.total_messages = facts["messages"]
    rec.episodes = spark.createDataFrame([(0, 0, stem, facts["messages"], None, None, None, [], None, None)], EPISODES)
    return rec
