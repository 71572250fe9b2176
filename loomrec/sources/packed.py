"""Packed record files, string tables and curve files as DataFrames.

Files are read by Spark's own ``binaryFile`` and ``text`` sources, so any store that Spark reads
will do; a file is one row, and a task parses it without keeping more than its rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Header size, the flag of compressed payloads, and the mark of an oversize length.
HEADER, COMPRESSED, OVERSIZE = 24, 0x00040000, b"XXXX"
#: A payload that claims to be larger than this when unpacked is an error.
MOST_UNPACKED = 64 << 20

RECORD_SCHEMA = "path string, offset long, group_offset long, depth int, sig string, form_id long, flags long, form_version int, data_size long, payload binary, error string"
GROUP_SCHEMA = "path string, group_offset long, parent_offset long, depth int, group_type int, label binary, end_offset long"


def _walk(data: bytes) -> Iterator[tuple]:
    """('group', offset, parent, depth, type, label, end) and ('record', offset, group, depth, header fields...), in file order."""
    open_groups: list[tuple[int, int]] = []
    at = 0
    while at + HEADER <= len(data):
        while open_groups and at >= open_groups[-1][1]:
            open_groups.pop()
        parent = open_groups[-1][0] if open_groups else None
        sig, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if sig == b"GRUP":
            end = at + size
            if size < HEADER or end > (open_groups[-1][1] if open_groups else len(data)):
                raise ValueError(f"the group at {at} does not fit")
            yield "group", at, parent, len(open_groups), struct.unpack_from("<i", data, at + 12)[0], data[at + 8 : at + 12], end
            open_groups.append((at, end))
            at += HEADER
            continue
        if at + HEADER + size > len(data):
            return  # a record that was cut off ends the file
        flags, form_id, _, version = struct.unpack_from("<IIIH", data, at + 8)
        yield "record", at, parent, len(open_groups), sig, form_id, flags, version, size
        at += HEADER + size


def _unpacked(raw: bytes, flags: int) -> bytes:
    if not flags & COMPRESSED:
        return raw
    size = struct.unpack_from("<I", raw)[0]
    if size > MOST_UNPACKED:
        raise ValueError("the payload is too large")
    return zlib.decompressobj().decompress(raw[4:], size)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row a record; a payload that cannot be unpacked is null with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for x in _walk(data):
                    if x[0] != "record":
                        continue
                    _, at, group, depth, sig, form_id, flags, version, size = x
                    try:
                        payload, error = _unpacked(data[at + HEADER : at + HEADER + size], flags), None
                    except (ValueError, zlib.error, struct.error) as e:
                        payload, error = None, str(e)
                    rows.append((name, at, group, depth, sig.decode("latin-1"), form_id, flags, version, size, payload, error))
                    if len(rows) == 5000:
                        yield pd.DataFrame(rows, columns=columns).astype({"group_offset": "Int64"})
                        rows = []
                yield pd.DataFrame(rows, columns=columns).astype({"group_offset": "Int64"})

    return _files(spark, path).mapInPandas(run, RECORD_SCHEMA)


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """One row a group, with its parent and the offset of its end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in GROUP_SCHEMA.split(", ")]
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                rows = [(name, x[1], x[2], x[3], x[4], x[5], x[6]) for x in _walk(data) if x[0] == "group"]
                yield pd.DataFrame(rows, columns=columns).astype({"parent_offset": "Int64"})

    return _files(spark, path).mapInPandas(run, GROUP_SCHEMA)


def subrecords_of(payload: bytes | None) -> list[dict]:
    """The parts of a payload in order; XXXX gives the length of a next part that declares none."""
    out, at, oversize = [], 0, None
    while payload is not None and at + 6 <= len(payload):
        sig, size = payload[at : at + 4], struct.unpack_from("<H", payload, at + 4)[0]
        at += 6
        if sig == OVERSIZE and size == 4:
            oversize = struct.unpack_from("<I", payload, at)[0]
            at += 4
            continue
        size, oversize = (oversize, None) if oversize is not None and size == 0 else (size, None)
        out.append({"doc_index": len(out), "sig": sig.decode("latin-1"), "data": payload[at : at + size]})
        at += size
    return out


def subrecords(records: DataFrame) -> DataFrame:
    """form_id, doc_index, sig, data: a row for each part of each record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, s["doc_index"], s["sig"], s["data"]) for f, p in zip(batch["form_id"], batch["payload"], strict=True) for s in subrecords_of(p)]
            yield pd.DataFrame(rows, columns=["form_id", "doc_index", "sig", "data"])

    return records.select("form_id", "payload").mapInPandas(run, "form_id long, doc_index int, sig string, data binary")


def editor_ids(parts: DataFrame) -> DataFrame:
    """form_id, editor_id: the text of the first EDID part."""
    return parts.where("sig = 'EDID'").groupBy("form_id").agg(F.min_by("data", "doc_index").alias("d")).select("form_id", F.substring_index(F.decode("d", "UTF-8"), "\0", 1).alias("editor_id"))


def group_label(group_type: F.Column, label: F.Column) -> F.Column:
    """A label as text: a signature for top groups, x,y for grids, else the number."""
    little = F.conv(F.concat(*[F.hex(F.substring(label, k, 1)) for k in (4, 3, 2, 1)]), 16, 10).cast("long")
    half = lambda v: F.when(v >= 32768, v - 65536).otherwise(v)
    grid = F.concat(half(little % 65536).cast("string"), F.lit(","), half(F.shiftright(little, 16)).cast("string"))
    return F.when(group_type == 0, F.decode(label, "UTF-8")).when(group_type.isin(4, 5), grid).otherwise(little.cast("string"))


def read_strings(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """kind, lstring_id, text of a string table: kind strings is NUL-terminated, dlstrings and ilstrings have a length first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                count, size = struct.unpack_from("<II", data)
                begin = 8 + 8 * count
                if begin + size > len(data):
                    raise ValueError("a string table is shorter than it says")
                rows = []
                for k in range(count):
                    number, offset = struct.unpack_from("<II", data, 8 + 8 * k)
                    at = begin + offset
                    if kind == "strings":
                        text = data[at : data.index(b"\0", at)]
                    else:
                        text = data[at + 4 : at + 4 + struct.unpack_from("<I", data, at)[0]].rstrip(b"\0")
                    rows.append((kind, number, text.decode("utf-8", "replace")))
                yield pd.DataFrame(rows, columns=["kind", "lstring_id", "text"])

    return _files(spark, path).mapInPandas(run, "kind string, lstring_id long, text string")


def read_curves(spark: SparkSession, path: str) -> DataFrame:
    """curve_path, points in order of x: a JSON file is a list of points, or has one under curve or points; files without are left out."""
    point = "array<struct<x:double,y:double>>"
    text = spark.read.text(path, wholetext=True).select(F.lower(F.input_file_name()).alias("curve_path"), "value")
    held = F.from_json("value", f"curve {point}, points {point}")
    listed = F.ltrim("value").startswith("[")
    points = F.when(listed, F.from_json("value", point)).otherwise(F.coalesce(held["curve"], held["points"]))
    return text.select("curve_path", F.array_sort(points).alias("points")).where("size(points) > 0")
