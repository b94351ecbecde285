"""Exchange message files: minimal little-endian streams and the public big-endian market-data and order-entry formats.

Files are read by Spark as binary rows (any store, batch or stream) and decoded in Arrow batches, one task for each
file. A layout is a table: message type -> payload format, field names, canonical type, what to emit.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.schema import EXTRA_SCHEMA, NS
from tapeworks.session import ship

PRICE_UNIT = 1e-4
DAY_NS = 86_400 * NS
BLOCK = 50_000


@dataclass(frozen=True)
class Message:
    """payload format, its fields, canonical type: a fixed one, or with ± one by the side; None emits nothing."""

    format: str
    fields: str
    kind: str | None
    reason: str | None = None


#: Message layouts (fixed values of the formats).
ITCH_MINIMAL = {
    "A": Message("QcIQQ", "id side shares price stock", "LO±"),
    "F": Message("QcIQ4s", "id side shares price mpid", "LO±"),
    "E": Message("QI", "id shares", "MO+"),
    "C": Message("QIQ", "id shares price", "MO+"),
    "X": Message("QI", "id shares", "CX+"),
    "D": Message("Q", "id", "CX+"),
    "P": Message("QcIQ", "id side shares price", "MO?"),
    "U": Message("QQIQ", "id new shares price", "LO+"),
}
OUCH_MINIMAL = {
    "O": Message("QcIQ", "id side shares price", "LO±"),
    "U": Message("QQIQ", "id new shares price", "LO+"),
    "X": Message("QI", "id shares", "CX+"),
    "E": Message("QI", "id shares", "MO+"),
    "D": Message("Q", "id", "CX+"),
}
ITCH_50 = {
    "S": Message("c", "code", None),
    "R": Message("28s", "block", None),
    "L": Message("8sIII", "stock reference upper lower", None),
    "H": Message("8sccI", "stock state reserved state_reason", "META"),
    "A": Message("QcI8sI", "id side shares stock price", "LO±"),
    "F": Message("QcI8sI4s", "id side shares stock price mpid", "LO±"),
    "E": Message("QIQ", "id shares match", "MO+"),
    "C": Message("QIQcI", "id shares match printable price", "MO+"),
    "X": Message("QI", "id shares", "CX+"),
    "D": Message("Q", "id", "CX+"),
    "U": Message("QQII", "id new shares price", "LO+"),
    "P": Message("QcI8sIQ", "id side shares stock price match", "MO+"),
    "Q": Message("Q8sIQc", "shares stock price match cross", "MO+"),
    "B": Message("Q", "match", "CX+"),
    "Y": Message("8sc", "stock action", None),
    "V": Message("QQQ", "one two three", None),
    "W": Message("c", "level", None),
    "K": Message("8sIcI", "stock release qualifier price", None),
    "J": Message("8sIIII", "stock reference upper lower extension", None),
    "h": Message("8scc", "stock market action", None),
    "I": Message("QQc8sIIIcc", "paired imbalance direction stock far near reference cross variation", None),
    "N": Message("8sc", "stock interest", None),
    "O": Message("8scIIIQII", "stock eligibility lowest highest near time lower upper", None),
}
OUCH_42 = {
    "S": Message("c", "code", None),
    "A": Message("14scI8sI", "token side shares stock price", "LO±"),
    "O": Message("49s", "block", None),
    "U": Message("14s14sIII", "token_orig token_new shares price tif", "LO+"),
    "X": Message("14sI", "token shares", "CX+"),
    "C": Message("14sIc", "token shares reason", "CX+"),
    "E": Message("14sIQ", "token shares match", "MO+"),
    "T": Message("14sIIQ", "token shares price match", "MO+"),
    "D": Message("14s", "token", "CX+", "SYSTEM_CANCEL"),
    "B": Message("14sQc", "token match reason", "CX+"),
    "R": Message("14sc", "token reason", "CX+"),
    "P": Message("14sII", "token price shares", None),
}
#: Layout -> byte order, header format, messages. A header holds the type and, but for order entry, the time.
LAYOUTS = {
    "itch-minimal": ("<", "Qc", ITCH_MINIMAL),
    "ouch-minimal": ("<", "Qc", OUCH_MINIMAL),
    "itch-5.0": (">", "cHHHI", ITCH_50),
    "ouch-4.2": (">", "c", OUCH_42),
}
ARROW = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[f.dataType.simpleString()]) for f in EXTRA_SCHEMA.fields])


class Malformed(ValueError):
    """A message type that the layout doesn't have."""


def messages(content: bytes, layout: str, *, skip: bool = False) -> Iterator[tuple[str, int | None, dict]]:
    """(type, nanoseconds or None, fields) of each whole message; a cut-off message at the end is left out.

    With skip, bytes that begin no known message are passed over one by one.
    """
    order, head, table = LAYOUTS[layout]
    header = struct.Struct(order + head)
    bodies = {k: (struct.Struct(order + m.format), m.fields.split()) for k, m in table.items()}
    at = 0
    while at + header.size <= len(content):
        h = header.unpack_from(content, at)
        kind = (h[1] if head == "Qc" else h[0]).decode("latin-1")
        if kind not in bodies:
            if skip:
                at += 1
                continue
            raise Malformed(f"unknown message type {kind!r} at byte {at} of a {layout} file")
        body, names = bodies[kind]
        if at + header.size + body.size > len(content):
            return
        ts = h[0] if head == "Qc" else (h[3] << 32) | h[4] if head == "cHHHI" else None
        yield kind, ts, dict(zip(names, body.unpack_from(content, at + header.size), strict=True))
        at += header.size + body.size


def sniff(content: bytes, layouts: tuple[str, ...]) -> str:
    """The first layout that reads the beginning of the content without an unknown type, else the one that gets furthest."""
    reached = dict.fromkeys(layouts, 0)
    for layout in layouts:
        try:
            for _ in zip(range(16), messages(content[:4096], layout), strict=False):
                reached[layout] += 1
        except Malformed:
            continue
        if reached[layout]:
            return layout
    return max(layouts, key=reached.get)


def resolve_epoch_ns(ts: int | None, date_ns: int | None, tz_offset_s: int) -> int | None:
    """A time of day with a session date becomes an epoch time; epoch times stay."""
    if ts is None or date_ns is None or ts >= DAY_NS:
        return ts
    return date_ns - tz_offset_s * NS + ts


def canonical(kind: str, ts: int | None, f: dict, message: Message, *, side_aware: bool) -> dict | None:
    """The canonical row of one message, or None for those that are only passed over."""
    if message.kind is None:
        return None
    side = f["side"].decode("latin-1") if "side" in f else None
    sign = "-" if side == "S" else "+"
    event = message.kind.replace("±", sign).replace("?", sign if side_aware else "+")
    text = lambda k: f[k].decode("latin-1").strip() if k in f else None
    row = {"ts_ns": ts, "event_type": event, "side": side, "size": float(f.get("shares", 0)), "price": f["price"] * PRICE_UNIT if "price" in f else None, "token": text("token"), "token_orig": text("token_orig"), "token_new": text("token_new"), "match": f.get("match"), "reason": message.reason or text("reason")}
    if "state" in f:
        row |= {"trading_state": text("state"), "state_reason": f["state_reason"], "halted": text("state") in ("H", "P")}
    return row


def _decode(layout: str, date_ns: int | None, tz_offset_s: int, side_aware: bool, stop: bool, skip: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for symbol, content in zip(batch.column("symbol").to_pylist(), batch.column("content"), strict=True):
            content = content.as_py() or b""
            names = {"itch": ("itch-minimal", "itch-5.0"), "ouch": ("ouch-minimal", "ouch-4.2")}.get(layout, (layout,))
            likely = sniff(content, names) if len(names) > 1 else names[0]
            # A layout that gives no row leaves the file to the other one.
            seq, bad, read = 0, None, False
            for name in (likely, *(n for n in names if n != likely)):
                table, rows = LAYOUTS[name][2], []
                try:
                    for kind, ts, fields in messages(content, name, skip=skip):
                        row = canonical(kind, resolve_epoch_ns(ts, date_ns, tz_offset_s), fields, table[kind], side_aware=side_aware)
                        if row is not None:
                            rows.append(row | {"symbol": symbol, "venue": name.split("-")[0].upper(), "seq": seq})
                            seq += 1
                        if len(rows) >= BLOCK:
                            yield _frame(rows)
                            rows = []
                    read, bad = True, None
                except Malformed as e:
                    bad = e if seq else bad or e
                if rows:
                    yield _frame(rows)
                if seq:
                    break
            if bad and not stop and not read:
                raise bad


def _frame(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in ARROW], schema=ARROW)


def decode(files: DataFrame, layout: str, *, tick: float | None = None, adjust: float = 1.0, adjust_mode: str = "multiply", session_date: str | None = None, tz_offset_s: int = 0, side_aware: bool = False, stop_at_unknown: bool = False, skip_unknown: bool = False) -> DataFrame:
    """Canonical rows of files (symbol, content). layout: one of LAYOUTS, or itch or ouch to tell by the content.

    seq is the message's place in its file. An unknown message type is an error that names the byte; with
    stop_at_unknown the file's rows end there, with skip_unknown they go on at the next known type. Order-entry files hold no times: ts_ns is null.
    """
    date_ns = int(pd.Timestamp(session_date, tz="UTC").value) if session_date else None
    ship(files.sparkSession)
    rows = files.select(F.col("symbol").cast("string").alias("symbol"), "content").mapInArrow(partial(_decode, layout, date_ns, tz_offset_s, side_aware, stop_at_unknown, skip_unknown), EXTRA_SCHEMA)
    price = F.col("price") * adjust if adjust_mode == "multiply" else F.col("price") / adjust
    return rows.withColumn("price", F.rint(price / tick) * tick if tick else price)


def read_files(spark: SparkSession, path: str, layout: str, *, symbol: str | None = None, glob: str | None = None, stream: bool = False, **options) -> DataFrame:
    """Decoded rows of all files under path; the symbol is given or the file's stem. Streams read new files as they land."""
    reader = (spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if stream else spark.read).format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return decode(files.select((F.lit(symbol) if symbol else stem).alias("symbol"), "content"), layout, **options)


def encode(rows: list[tuple[str, int | None, dict]], layout: str) -> bytes:
    """Bytes of messages (type, time, fields), for fixtures and round trips."""
    order, head, table = LAYOUTS[layout]
    out = []
    for kind, ts, fields in rows:
        m = table[kind]
        values = []
        for name, code in zip(m.fields.split(), _codes(m.format), strict=True):
            v = fields.get(name, 0)
            values.append((v if isinstance(v, int) else 0) if code[-1] not in "sc" else (str(v) if v else "").encode("latin-1").ljust(int(code[:-1] or 1)))
        k = kind.encode()
        h = (ts, k) if head == "Qc" else (k, 0, 0, ts >> 32, ts & 0xFFFFFFFF) if head == "cHHHI" else (k,)
        out.append(struct.pack(order + head, *h) + struct.pack(order + m.format, *values))
    return b"".join(out)


def _codes(fmt: str) -> list[str]:
    import re

    return re.findall(r"\d*[a-zA-Z]", fmt)
