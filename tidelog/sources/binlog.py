"""Row-format binary logs of a MySQL source: files of events read into changes, and written, after the published protocol."""

from __future__ import annotations

import datetime as dt
import glob
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Fixed values of the protocol: the file's first bytes, event types and column types.
MAGIC = b"\xfebin"
QUERY, ROTATE, FORMAT, XID, TABLE_MAP, ROWS_QUERY, HEARTBEAT = 2, 4, 15, 16, 19, 29, 27
ROWS = {23: ("insert", 1), 24: ("update", 1), 25: ("delete", 1), 30: ("insert", 2), 31: ("update", 2), 32: ("delete", 2)}
TINY, SHORT, LONG, FLOAT, DOUBLE, TIMESTAMP, LONGLONG, INT24, DATE, TIME, DATETIME, YEAR = 1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12, 13
VARCHAR, BIT, TIMESTAMP2, DATETIME2, TIME2, JSON, NEWDECIMAL, ENUM, SET, BLOB, VAR_STRING, STRING, GEOMETRY = 15, 16, 17, 18, 19, 245, 246, 247, 248, 252, 253, 254, 255
_META_BYTES = {FLOAT: 1, DOUBLE: 1, VARCHAR: 2, VAR_STRING: 2, BIT: 2, NEWDECIMAL: 2, BLOB: 1, JSON: 1, GEOMETRY: 1, TIMESTAMP2: 1, DATETIME2: 1, TIME2: 1, STRING: 2, ENUM: 2, SET: 2}
_INTEGERS = {TINY: 1, SHORT: 2, INT24: 3, LONG: 4, LONGLONG: 8}
_DIGIT_BYTES = (0, 1, 1, 2, 2, 3, 3, 4, 4, 4)


class BinlogError(ValueError):
    """A file that isn't a readable log."""


@dataclass
class TableMap:
    table_id: int
    db: str
    name: str
    types: list[int]
    metas: list[tuple[int, ...]]
    columns: list[str] = field(default_factory=list)


def _length(b: bytes, at: int) -> tuple[int, int]:
    """A length-encoded number and the place after it."""
    first = b[at]
    if first < 251:
        return first, at + 1
    n = {252: 2, 253: 3, 254: 8}[first]
    return int.from_bytes(b[at + 1 : at + 1 + n], "little"), at + 1 + n


def _put_length(n: int) -> bytes:
    return bytes([n]) if n < 251 else b"\xfc" + n.to_bytes(2, "little") if n < 1 << 16 else b"\xfd" + n.to_bytes(3, "little") if n < 1 << 24 else b"\xfe" + n.to_bytes(8, "little")


# values


def decimal_size(precision: int, scale: int) -> int:
    whole = precision - scale
    return whole // 9 * 4 + _DIGIT_BYTES[whole % 9] + scale // 9 * 4 + _DIGIT_BYTES[scale % 9]


def _decimal_groups(precision: int, scale: int) -> tuple[list[int], list[int]]:
    whole = precision - scale
    return ([whole % 9] if whole % 9 else []) + [9] * (whole // 9), [9] * (scale // 9) + ([scale % 9] if scale % 9 else [])


def read_decimal(b: bytes, precision: int, scale: int) -> Decimal:
    """Groups of nine digits in four bytes; the first bit is set unless negative, and a negative number's bits are all flipped."""
    positive = bool(b[0] & 0x80)
    raw = bytes([b[0] ^ 0x80]) + b[1:]
    if not positive:
        raw = bytes(x ^ 0xFF for x in raw)
    at, digits = 0, ["", ""]
    for k, groups in enumerate(_decimal_groups(precision, scale)):
        for g in groups:
            n = _DIGIT_BYTES[g]
            digits[k] += str(int.from_bytes(raw[at : at + n], "big")).zfill(g)
            at += n
    return Decimal(("" if positive else "-") + (digits[0] or "0") + ("." + digits[1] if scale else ""))


def write_decimal(value: Decimal, precision: int, scale: int) -> bytes:
    text = str(abs(int(value.scaleb(scale).to_integral_value()))).zfill(precision)
    at, out = 0, b""
    for groups in _decimal_groups(precision, scale):
        for g in groups:
            out += int(text[at : at + g]).to_bytes(_DIGIT_BYTES[g], "big")
            at += g
    if value < 0:
        out = bytes(x ^ 0xFF for x in out)
    return bytes([out[0] ^ 0x80]) + out[1:]


def _fraction(b: bytes, digits: int) -> int:
    """Microseconds from the bytes of a fraction of so many digits."""
    n = (digits + 1) // 2
    return int.from_bytes(b[:n], "big") * 10 ** (6 - 2 * n) if n else 0


def _put_fraction(micros: int, digits: int) -> bytes:
    n = (digits + 1) // 2
    return (micros // 10 ** (6 - 2 * n)).to_bytes(n, "big") if n else b""


def _clock(micros: int) -> str:
    """A TIME as text; it may be negative or exceed a day."""
    sign, micros = ("-" if micros < 0 else ""), abs(micros)
    seconds, rest = divmod(micros, 1_000_000)
    return f"{sign}{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}" + (f".{rest:06d}" if rest else "")


def _moment(y, m, d, h=0, mi=0, s=0, us=0) -> str | None:
    """A date and time as text; None for one that doesn't exist, such as the zero date."""
    try:
        return dt.datetime(y, m, d, h, mi, s, us).isoformat(sep=" ")
    except ValueError:
        return None


def read_json(b: bytes) -> str:
    """JSON text of the binary JSON format."""
    return json.dumps(_json_value(b[0], b, 1), ensure_ascii=False) if b else "null"


def _json_value(kind: int, b: bytes, at: int):
    if kind in (0, 1, 2, 3):
        return _json_container(b, at, is_object=kind in (0, 1), large=kind in (1, 3))
    if kind == 4:
        return {0: None, 1: True, 2: False}[b[at]]
    if kind in (5, 6, 7, 8, 9, 10):
        n = {5: 2, 6: 2, 7: 4, 8: 4, 9: 8, 10: 8}[kind]
        return int.from_bytes(b[at : at + n], "little", signed=kind in (5, 7, 9))
    if kind == 11:
        return struct.unpack_from("<d", b, at)[0]
    if kind == 12:
        n, at = _json_length(b, at)
        return b[at : at + n].decode()
    if kind == 15:
        own = b[at]
        n, at = _json_length(b, at + 1)
        raw = b[at : at + n]
        return float(read_decimal(raw[2:], raw[0], raw[1])) if own == NEWDECIMAL else raw.hex()
    raise BinlogError(f"unknown JSON value {kind}")


def _json_length(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (b[at] & 0x7F) << shift
        at += 1
        if not b[at - 1] & 0x80:
            return n, at
        shift += 7


def _json_container(b: bytes, at: int, is_object: bool, large: bool):
    w = 4 if large else 2
    number = lambda p: int.from_bytes(b[p : p + w], "little")
    count, base, p = number(at), at, at + 2 * w
    keys = []
    if is_object:
        for _ in range(count):
            k, n = number(p), int.from_bytes(b[p + w : p + w + 2], "little")
            keys.append(b[base + k : base + k + n].decode())
            p += w + 2
    values = []
    for _ in range(count):
        kind = b[p]
        inline = kind in (4, 5, 6) or (large and kind in (7, 8))
        values.append(_json_value(kind, b, p + 1 if inline else base + number(p + 1)))
        p += 1 + w
    return dict(zip(keys, values, strict=True)) if is_object else values


def read_value(kind: int, meta: tuple[int, ...], b: bytes, at: int):
    """(value, place after it) of a column. Numbers are signed as stored; times, dates and exact numbers are text or Decimal, bytes are hex text."""
    if kind in _INTEGERS:
        n = _INTEGERS[kind]
        return int.from_bytes(b[at : at + n], "little", signed=True), at + n
    if kind in (VARCHAR, VAR_STRING, STRING):
        w = 2 if meta[0] > 255 else 1
        n = int.from_bytes(b[at : at + w], "little")
        return b[at + w : at + w + n].decode("utf-8", "replace"), at + w + n
    if kind == FLOAT:
        return struct.unpack_from("<f", b, at)[0], at + 4
    if kind == DOUBLE:
        return struct.unpack_from("<d", b, at)[0], at + 8
    if kind == NEWDECIMAL:
        n = decimal_size(*meta)
        return str(read_decimal(b[at : at + n], *meta)), at + n
    if kind == YEAR:
        return (b[at] + 1900 if b[at] else 0), at + 1
    if kind == DATE:
        v = int.from_bytes(b[at : at + 3], "little")
        day = _moment(v >> 9, v >> 5 & 15, v & 31)
        return day and day[:10], at + 3
    if kind == TIMESTAMP:
        v = int.from_bytes(b[at : at + 4], "little")
        return v and _moment(*dt.datetime.fromtimestamp(v, dt.UTC).timetuple()[:6]), at + 4
    if kind == TIMESTAMP2:
        v, n = int.from_bytes(b[at : at + 4], "big"), (meta[0] + 1) // 2
        return v and _moment(*dt.datetime.fromtimestamp(v, dt.UTC).timetuple()[:6], _fraction(b[at + 4 :], meta[0])), at + 4 + n
    if kind == DATETIME:
        v = int.from_bytes(b[at : at + 8], "little")
        day, clock = divmod(v, 1_000_000)
        return _moment(day // 10_000, day // 100 % 100, day % 100, clock // 10_000, clock // 100 % 100, clock % 100), at + 8
    if kind == DATETIME2:
        v, n = int.from_bytes(b[at : at + 5], "big") - (1 << 39), (meta[0] + 1) // 2
        month = v >> 22 & 0x1FFFF
        return _moment(month // 13, month % 13, v >> 17 & 31, v >> 12 & 31, v >> 6 & 63, v & 63, _fraction(b[at + 5 :], meta[0])), at + 5 + n
    if kind == TIME:
        v = int.from_bytes(b[at : at + 3], "little", signed=True)
        sign, v = (-1 if v < 0 else 1), abs(v)
        return _clock(sign * ((v // 10_000 * 60 + v // 100 % 100) * 60 + v % 100) * 1_000_000), at + 3
    if kind == TIME2:
        n = (meta[0] + 1) // 2
        v = int.from_bytes(b[at : at + 3 + n], "big") - (1 << (23 + 8 * n))
        sign, v = (-1 if v < 0 else 1), abs(v)
        whole, part = v >> 8 * n, v & ((1 << 8 * n) - 1)
        seconds = ((whole >> 12 & 1023) * 60 + (whole >> 6 & 63)) * 60 + (whole & 63)
        return _clock(sign * (seconds * 1_000_000 + part * 10 ** (6 - 2 * n))), at + 3 + n
    if kind == BIT:
        n = meta[1] + (meta[0] > 0)
        return int.from_bytes(b[at : at + n], "big"), at + n
    if kind in (ENUM, SET):
        return int.from_bytes(b[at : at + meta[1]], "little"), at + meta[1]
    if kind in (BLOB, GEOMETRY, JSON):
        n = int.from_bytes(b[at : at + meta[0]], "little")
        raw = b[at + meta[0] : at + meta[0] + n]
        return (read_json(raw) if kind == JSON else raw.hex()), at + meta[0] + n
    raise BinlogError(f"unknown column type {kind}")


def write_value(kind: int, meta: tuple[int, ...], value) -> bytes:
    """The bytes of a value, for the types that files are written with."""
    if kind in _INTEGERS:
        return int(value).to_bytes(_INTEGERS[kind], "little", signed=True)
    if kind in (VARCHAR, VAR_STRING, STRING):
        raw = value.encode()
        return len(raw).to_bytes(2 if meta[0] > 255 else 1, "little") + raw
    if kind in (FLOAT, DOUBLE):
        return struct.pack("<f" if kind == FLOAT else "<d", value)
    if kind == NEWDECIMAL:
        return write_decimal(Decimal(value), *meta)
    if kind == YEAR:
        return bytes([value - 1900 if value else 0])
    if kind == DATE:
        y, m, d = map(int, value.split("-"))
        return (y << 9 | m << 5 | d).to_bytes(3, "little")
    if kind == DATETIME2:
        t = dt.datetime.fromisoformat(value)
        v = ((t.year * 13 + t.month) << 22 | t.day << 17 | t.hour << 12 | t.minute << 6 | t.second) + (1 << 39)
        return v.to_bytes(5, "big") + _put_fraction(t.microsecond, meta[0])
    if kind == TIMESTAMP2:
        t = dt.datetime.fromisoformat(value).replace(tzinfo=dt.UTC)
        return int(t.timestamp()).to_bytes(4, "big") + _put_fraction(t.microsecond, meta[0])
    if kind == TIME2:
        m = re.fullmatch(r"(-?)(\d+):(\d\d):(\d\d)(?:\.(\d{6}))?", value)
        n = (meta[0] + 1) // 2
        v = (int(m[2]) << 12 | int(m[3]) << 6 | int(m[4])) << 8 * n | (int(m[5] or 0) // 10 ** (6 - 2 * n))
        return ((-v if m[1] else v) + (1 << (23 + 8 * n))).to_bytes(3 + n, "big")
    if kind == BIT:
        return int(value).to_bytes(meta[1] + (meta[0] > 0), "big")
    if kind in (ENUM, SET):
        return int(value).to_bytes(meta[1], "little")
    if kind in (BLOB, GEOMETRY):
        raw = bytes.fromhex(value)
        return len(raw).to_bytes(meta[0], "little") + raw
    raise BinlogError(f"can't write column type {kind}")


# events


def read_table_map(b: bytes) -> TableMap:
    table_id, at = int.from_bytes(b[:6], "little"), 8
    names = []
    for _ in range(2):
        n = b[at]
        names.append(b[at + 1 : at + 1 + n].decode())
        at += n + 2
    n, at = _length(b, at)
    kinds, at = list(b[at : at + n]), at + n
    _, at = _length(b, at)
    types, metas = [], []
    for kind in kinds:
        w = _META_BYTES.get(BLOB if kind in (249, 250, 251) else kind, 0)
        raw, at = b[at : at + w], at + w
        meta = tuple(raw)
        if kind in (249, 250, 251):
            kind = BLOB
        if kind in (VARCHAR, VAR_STRING):
            meta = (int.from_bytes(raw, "little"),)
        elif kind == STRING:
            real, size = raw
            if real & 0x30 != 0x30:  # the length's upper bits are hidden in the type
                real, size = real | 0x30, size | ((real & 0x30) ^ 0x30) << 4
            kind, meta = (real, (real, size)) if real in (ENUM, SET) else (STRING, (size,))
        types.append(kind)
        metas.append(meta)
    return TableMap(table_id, *names, types, metas)


def write_table_map(t: TableMap) -> bytes:
    kinds, metas = b"", b""
    for kind, meta in zip(t.types, t.metas, strict=True):
        kinds += bytes([STRING if kind in (ENUM, SET) else kind])
        if kind in (VARCHAR, VAR_STRING):
            metas += meta[0].to_bytes(2, "little")
        elif kind == STRING:
            metas += bytes([STRING ^ (meta[0] >> 4 & 0x30), meta[0] & 0xFF])
        elif kind in (ENUM, SET):
            metas += bytes([kind, meta[1]])
        else:
            metas += bytes(meta[: _META_BYTES.get(kind, 0)])
    name = lambda s: bytes([len(s.encode())]) + s.encode() + b"\0"
    nulls = b"\xff" * ((len(t.types) + 7) // 8)
    return t.table_id.to_bytes(6, "little") + b"\x01\0" + name(t.db) + name(t.name) + _put_length(len(t.types)) + kinds + _put_length(len(metas)) + metas + nulls


@lru_cache(4096)
def _flags(raw: bytes, n: int) -> tuple[bool, ...]:
    return tuple(bool(raw[k // 8] >> k % 8 & 1) for k in range(n))


def _bits(b: bytes, at: int, n: int) -> tuple[tuple[bool, ...], int]:
    w = (n + 7) // 8
    return _flags(b[at : at + w], n), at + w


def _read_row(b: bytes, at: int, t: TableMap, own: list[int]) -> tuple[dict, int]:
    """The row of the columns ``own``, and the place after it."""
    nulls, at = _bits(b, at, len(own))
    row = {}
    for k, null in zip(own, nulls, strict=True):
        name = t.columns[k] if k < len(t.columns) else f"c{k}"
        row[name] = None
        if not null:
            row[name], at = read_value(t.types[k], t.metas[k], b, at)
    return row, at


def read_rows(kind: int, b: bytes, maps: dict[int, TableMap]) -> tuple[TableMap, list[tuple[dict | None, dict | None]]]:
    """The table and the (before, after) rows of a rows event. A table that wasn't announced or differs in its number of columns is an error."""
    what, version = ROWS[kind]
    table_id, at = int.from_bytes(b[:6], "little"), 8
    if table_id not in maps:
        raise BinlogError(f"no table map for {table_id}")
    t = maps[table_id]
    if version == 2:
        at += int.from_bytes(b[at : at + 2], "little")
    n, at = _length(b, at)
    if n != len(t.types):
        raise BinlogError(f"{t.db}.{t.name} has {len(t.types)} columns, its rows {n}")
    first, at = _bits(b, at, n)
    second = first
    if what == "update":
        second, at = _bits(b, at, n)
    first, second = ([k for k, p in enumerate(present) if p] for present in (first, second))
    out = []
    while at < len(b):
        row, at = _read_row(b, at, t, first)
        if what == "update":
            after, at = _read_row(b, at, t, second)
            out.append((row, {**row, **after}))
        else:
            out.append((None, row) if what == "insert" else (row, None))
    return t, out


def write_rows(kind: int, t: TableMap, rows: list[tuple[list | None, list | None]]) -> bytes:
    n = len(t.types)
    present = bytes((1 << min(8, n - k)) - 1 for k in range(0, n, 8))
    out = t.table_id.to_bytes(6, "little") + b"\x01\0" + (b"\x02\0" if ROWS[kind][1] == 2 else b"") + _put_length(n) + present
    if ROWS[kind][0] == "update":
        out += present
    for pair in rows:
        for row in pair:
            if row is not None:
                nulls = sum(1 << k for k, v in enumerate(row) if v is None).to_bytes((n + 7) // 8, "little")
                out += nulls + b"".join([write_value(kind, meta, v) for kind, meta, v in zip(t.types, t.metas, row, strict=True) if v is not None])
    return out


def events(path: str, start: int = 4, bodies=lambda kind: True) -> Iterator[tuple[int, int, int, bytes]]:
    """(position, timestamp, type, body without checksum) of each event of a file from ``start`` on; one event is held at a time. A file cut within an event ends before it.

    The first event, which says whether there are checksums, is read in any case; what lies between is stepped over. Bodies are read, and
    checked, of the types ``bodies`` says; others are stepped over by their headers and give an empty body.
    """
    size_of = os.path.getsize(path)
    with open(path, "rb") as f:
        if f.read(4) != MAGIC:
            raise BinlogError(f"{path} isn't a binary log")
        checksum, first = 0, True
        while len(head := f.read(19)) == 19:
            at = f.tell() - 19
            ts, kind, _, size, _, _ = struct.unpack("<IBIIIH", head)
            if at + size > size_of:
                return
            body = b""
            if kind == FORMAT or bodies(kind):
                body = f.read(size - 19)
                if len(body) < size - 19:
                    return
                if kind == FORMAT:
                    checksum = 4 if len(body) > 57 + 5 and body[-5] == 1 else 0
                if checksum:
                    if zlib.crc32(head + body[:-4]) != int.from_bytes(body[-4:], "little"):
                        raise BinlogError(f"{path}: checksum at {at}")
                    body = body[:-4]
            else:
                f.seek(at + size)
            if at >= start:
                yield at, ts, kind, body
            if first and start > f.tell():
                f.seek(start)
            first = False


class Writer:
    """Writes a file of events with checksums."""

    def __init__(self, path: str, server: int = 1):
        self.f, self.server = open(path, "wb"), server  # noqa: SIM115
        self.f.write(MAGIC)
        self.event(FORMAT, 0, struct.pack("<H50sIB", 4, b"8.0.0", 0, 19) + bytes(40) + b"\x01")

    def event(self, kind: int, ts: int, body: bytes) -> int:
        at = self.f.tell()
        size = 19 + len(body) + 4
        head = struct.pack("<IBIIIH", ts, kind, self.server, size, at + size, 0)
        self.f.write(head + body + zlib.crc32(head + body).to_bytes(4, "little"))
        return at

    def query(self, ts: int, db: str, text: str) -> int:
        return self.event(QUERY, ts, struct.pack("<IIBHH", 1, 0, len(db.encode()), 0, 0) + db.encode() + b"\0" + text.encode())

    def rows(self, ts: int, kind: int, t: TableMap, rows: list) -> int:
        self.event(TABLE_MAP, ts, write_table_map(t))
        return self.event(kind, ts, write_rows(kind, t, rows))

    def commit(self, ts: int, xid: int) -> int:
        return self.event(XID, ts, xid.to_bytes(8, "little"))

    def rotate(self, name: str) -> None:
        self.event(ROTATE, 0, (4).to_bytes(8, "little") + name.encode())

    def close(self) -> None:
        self.f.close()


def file_number(path: str) -> int:
    """The number a log file ends with."""
    m = re.search(r"(\d+)$", os.path.basename(path))
    if not m:
        raise BinlogError(f"{path} has no number")
    return int(m[1])


def read_query(b: bytes) -> tuple[str, str]:
    n, status = b[8], int.from_bytes(b[11:13], "little")
    return b[13 + status : 13 + status + n].decode(), b[13 + status + n + 1 :].decode("utf-8", "replace")


SCHEMA = "log_offset bigint, row_no int, ts timestamp, rec_type int, db string, tbl string, before string, after string, changed array<string>, ddl string, query string"
_ARROW = pa.schema([("log_offset", pa.int64()), ("row_no", pa.int32()), ("ts", pa.timestamp("us", "UTC")), ("rec_type", pa.int32()), *((n, pa.string()) for n in ("db", "tbl", "before", "after")), ("changed", pa.list_(pa.string())), ("ddl", pa.string()), ("query", pa.string())])
#: Records in one Arrow batch.
BATCH_ROWS = 10_000


def complete(path: str, at: int = 4) -> int:
    """The place after the last whole event of a file that may still grow, looking from ``at`` on at headers only."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        while at + 19 <= size:
            f.seek(at)
            length = struct.unpack("<IBIIIH", f.read(19))[3]
            if length < 19 or at + length > size:
                break
            at += length
    return at


class _Maps(dict):
    """Table maps by id, with the names of their columns. An announcement that was read before isn't taken apart again."""

    def __init__(self, columns: dict[str, list[str]] | None):
        self.columns, self.known = columns or {}, {}

    def announce(self, body: bytes) -> None:
        t = self.known.get(body)
        if t is None:
            t = self.known[body] = read_table_map(body)
            t.columns = self.columns.get(f"{t.db}.{t.name}", [])
        self[t.table_id] = t


def _announced(path: str, before: int, columns: dict[str, list[str]] | None = None) -> _Maps:
    """The tables announced before a place of a file; other events are stepped over."""
    maps = _Maps(columns)
    for at, _, kind, body in events(path, bodies=lambda kind: kind == TABLE_MAP):
        if at >= before:
            break
        if kind == TABLE_MAP:
            maps.announce(body)
    return maps


#: The text of an image. json.dumps would make an encoder for each.
_json_text = json.JSONEncoder(ensure_ascii=False).encode


def changes(path: str, columns: dict[str, list[str]] | None = None, start: int = 0, end: int = 2**63) -> Iterator[tuple]:
    """The records of a file, as SCHEMA: rows with their images as JSON, BEGIN, COMMIT, ROLLBACK, DDL and heartbeats.

    ``columns``: names of the columns of "db.table"; others are c0, c1, ... A rotation must lead to the next file number. Reading begins at position ``start``:
    only if rows come whose table was announced before it, the announcements before it are looked up. What lies from ``end`` on isn't read. ``query`` is the statement that rows come
    from, where the source logs it.
    """
    number, maps, query, looked = file_number(path), _Maps(columns), None, False
    codes = {"insert": 0, "update": 1, "delete": 2}
    show = lambda row: None if row is None else _json_text(row)
    first = max(4, start & ((1 << 44) - 1)) if start >> 44 == number else 4
    for at, ts, kind, body in events(path, first):
        offset, when = number << 44 | at, dt.datetime.fromtimestamp(ts, dt.UTC)
        if offset >= end:
            return
        if kind == TABLE_MAP:
            maps.announce(body)
        elif kind == ROWS_QUERY:
            query = body[1:].decode("utf-8", "replace")
        elif kind in ROWS:
            if first > 4 and not looked and int.from_bytes(body[:6], "little") not in maps:
                maps, looked = _announced(path, at, columns), True
            t, rows = read_rows(kind, body, maps)
            for k, (before, after) in enumerate(rows):
                changed = [c for c in after if before.get(c) != after[c]] if before is not None and after is not None else None
                yield (offset, k, when, codes[ROWS[kind][0]], t.db, t.name, show(before), show(after), changed, None, query)
        elif kind == XID:
            query = None
            yield (offset, 0, when, 6, None, None, None, None, None, None, None)
        elif kind == QUERY:
            query = None
            db, text = read_query(body)
            word = text.strip().rstrip(";").upper()
            marker = {"BEGIN": 5, "START TRANSACTION": 5, "COMMIT": 6, "ROLLBACK": 7}.get(word, 4)
            yield (offset, 0, when, marker, db or None, None, None, None, None, text if marker == 4 else None, None)
        elif kind == HEARTBEAT:
            yield (offset, 0, when, 16, None, None, None, None, None, None, None)
        elif kind == ROTATE:
            following = file_number(body[8:].decode())
            if following not in (number, number + 1):
                raise BinlogError(f"{path} goes on with file {following}")


def change_batches(path: str, columns: dict[str, list[str]] | None = None, start: int = 0, end: int = 2**63) -> Iterator[pa.RecordBatch]:
    """changes() in Arrow batches."""
    records = changes(path, columns, start, end)
    while rows := list(islice(records, BATCH_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def seek_timestamp(paths: list[str], ts: int, strict: bool = False) -> tuple[str, int] | None:
    """The file and position of the first event at or after ``ts``: a binary search over the files' first events, then a scan.

    A time before all files is an error when ``strict``, else the begin. None if nothing is as late.
    """
    paths = sorted(paths, key=file_number)
    first = lambda p: next((t for _, t, k, _ in events(p) if k != FORMAT and t), 0)
    lo, hi = 0, len(paths)
    while lo < hi:
        mid = (lo + hi) // 2
        if first(paths[mid]) <= ts:
            lo = mid + 1
        else:
            hi = mid
    if not lo and strict:
        raise BinlogError("the log begins later")
    for path in paths[max(0, lo - 1) :]:
        for at, t, kind, _ in events(path):
            if kind not in (FORMAT, ROTATE) and t >= ts:
                return path, at
    return None


@dataclass
class _File(InputPartition):
    path: str
    start: int = 0
    end: int = 2**63

    def __post_init__(self):
        super().__init__(self.path)


class BinlogReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.columns = json.loads(options.get("columns", "{}"))
        self.start = int(options.get("startingoffset") or 0)

    def files(self) -> list[_File]:
        files = [f for f in glob.glob(self.path) if re.search(r"\d+$", f)]
        return [_File(f, self.start) for f in sorted(files, key=file_number) if file_number(f) >= self.start >> 44]

    def partitions(self):
        return self.files() or [_File("")]  # no file is as late as asked for

    def read(self, partition: _File):
        if not partition.path:
            return
        yield from change_batches(partition.path, self.columns, partition.start, partition.end)


class BinlogStream(DataSourceStreamReader):
    """Follows log files as they grow and rotate. An offset is the place after the last whole event of the last file."""

    def __init__(self, options):
        self.reader = BinlogReader(options)

    def initialOffset(self):  # noqa: N802
        return {"position": self.reader.start}

    def latestOffset(self):  # noqa: N802
        files = self.reader.files()
        return {"position": file_number(files[-1].path) << 44 | complete(files[-1].path)} if files else self.initialOffset()

    def partitions(self, start, end):
        inside = [f.path for f in self.reader.files() if start["position"] >> 44 <= file_number(f.path) <= end["position"] >> 44]
        return [_File(f, start["position"], end["position"]) for f in inside]

    def read(self, partition: _File):
        yield from self.reader.read(partition)

    def commit(self, end):
        """Files stay."""


class Binlog(DataSource):
    """format("tidelog_binlog"), one task a file. Options: path (a pattern of files all workers see), columns (JSON: "db.table" to names), startingOffset."""

    @classmethod
    def name(cls) -> str:
        return "tidelog_binlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return BinlogReader(self.options)

    def streamReader(self, schema):  # noqa: N802
        return BinlogStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Binlog)
