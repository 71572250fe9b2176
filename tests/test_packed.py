"""Packed files from buffers made here."""

import json
import struct
import zlib

from pyspark.sql import functions as F

from loomrec.sources import packed


def part(sig, data):
    if len(data) > 0xFFFF:
        return b"XXXX" + struct.pack("<HI", 4, len(data)) + sig + struct.pack("<H", 0) + data
    return sig + struct.pack("<H", len(data)) + data


def record(sig, form_id, payload, flags=0):
    if flags & packed.COMPRESSED:
        payload = struct.pack("<I", len(payload)) + zlib.compress(payload)
    return sig + struct.pack("<IIIIHH", len(payload), flags, form_id, 0, 44, 0) + payload


def group(label, kind, body):
    return b"GRUP" + struct.pack("<I", 24 + len(body)) + label + struct.pack("<iII", kind, 0, 0) + body


def test_records_groups_and_parts(spark, tmp_path):
    big = b"x" * 70_000
    inner = group(struct.pack("<hh", -3, 5), 4, record(b"REFR", 0xFFFFFFFE, part(b"EDID", b"deep\0")))
    body = record(b"WEAP", 1, part(b"EDID", b"Sword\0") + part(b"DATA", big)) + record(b"WEAP", 2, part(b"EDID", b"Axe\0"), packed.COMPRESSED) + record(b"WEAP", 3, b"", 0) + inner
    data = record(b"TES4", 0, b"") + group(b"WEAP", 0, body) + record(b"CUTT", 9, b"gone")[:-2]
    (tmp_path / "a.bin").write_bytes(data)
    records = packed.read_records(spark, str(tmp_path / "*.bin"))
    rows = {r["form_id"]: r for r in records.collect()}
    assert set(rows) == {0, 1, 2, 3, 0xFFFFFFFE} and rows[0xFFFFFFFE]["depth"] == 2 and rows[0]["group_offset"] is None
    parts = packed.subrecords(records)
    names = {r["form_id"]: r["editor_id"] for r in packed.editor_ids(parts).collect()}
    assert names == {1: "Sword", 2: "Axe", 0xFFFFFFFE: "deep"}
    assert parts.where("sig = 'DATA'").select(F.length("data").alias("n")).first()["n"] == 70_000
    groups = packed.read_groups(spark, str(tmp_path / "*.bin")).select("depth", "parent_offset", packed.group_label(F.col("group_type"), F.col("label")).alias("label")).orderBy("depth").collect()
    assert [(r["depth"], r["label"]) for r in groups] == [(0, "WEAP"), (1, "-3,5")] and groups[1]["parent_offset"] == 24


def test_strings_and_curves(spark, tmp_path):
    (tmp_path / "a.strings").write_bytes(struct.pack("<IIIIII", 2, 8, 7, 0, 9, 4) + b"abc\0def\0")
    (tmp_path / "a.dlstrings").write_bytes(struct.pack("<IIII", 1, 8, 7, 0) + struct.pack("<I", 4) + b"xyz\0")
    assert {(r["lstring_id"], r["text"]) for r in packed.read_strings(spark, str(tmp_path / "a.strings"), "strings").collect()} == {(7, "abc"), (9, "def")}
    assert [r["text"] for r in packed.read_strings(spark, str(tmp_path / "a.dlstrings"), "dlstrings").collect()] == ["xyz"]
    for name, body in (("a", [{"x": 2, "y": 1}, {"x": 1, "y": 5}]), ("b", {"curve": [{"x": 0, "y": 1}]}), ("c", {"other": 1})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    curves = {r["curve_path"][-6:]: [tuple(p) for p in r["points"]] for r in packed.read_curves(spark, str(tmp_path / "*.json")).collect()}
    assert curves == {"a.json": [(1.0, 5.0), (2.0, 1.0)], "b.json": [(0.0, 1.0)]}
