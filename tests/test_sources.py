"""File formats, strict records, sinks and publishing."""

from __future__ import annotations

import struct
import zipfile

import pytest

from waymark.sources import containers, formats, sinks

GOOD = '{"id": 1, "t": 1.0, "ok": true, "name": "a"}'
ALLOWED = {"id": "int", "t": "number", "ok": "bool", "name": "string", "deep": "any"}


@pytest.mark.parametrize(
    ("line", "reason"),
    [
        (GOOD, None), ("", "blank line"), ("  ", "blank line"), ('{"id": 1, "id": 2}', "duplicate key id"), ('{"deep": {"a": 1, "\\u0061": 2}}', "duplicate key a"),
        ('{"id": 1, "t": NaN}', "constant NaN"), ('{"t": 1e999}', "nested too deep or not finite"), ("{", "not JSON"), ("[1]", "not an object"),
        ('{"ok": 1}', "field ok is not bool"), ('{"id": true}', "field id is not int"), ('{"other": 1}', "unknown field other"), ('{"deep": ' + "[" * 20 + "]" * 20 + "}", "nested too deep or not finite"),
    ],
)
def test_strict_record(line, reason):
    assert formats.check_record(line, ALLOWED) == reason


def test_strict_jsonl_file(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": 1.0}\n{"id": 2, "t": 1.0}\n{"id": 1, "t": 3.0}\n\n{"id": 4, "t": 4.0}')
    rows = formats.read_strict_jsonl(spark, str(tmp_path), allowed=ALLOWED, increasing="t", unique="id").orderBy("line").collect()
    assert [r["reason"] for r in rows] == [None, "t does not rise", "id repeats", "blank line", "no final newline"]


@pytest.mark.parametrize("fmt", ["raw", "rgbd", "rgbd_id", "toro"])
def test_pose_files_round_trip(spark, tmp_path, fmt):
    pose = [0.0, -1.0, 0.0, 1.5, 1.0, 0.0, 0.0, -2.0, 0.0, 0.0, 1.0, 3.0]
    poses = spark.createDataFrame([(1, 10.0, pose), (2, 11.0, [float(i % 5 == 0) for i in range(12)])], "id int, stamp double, pose array<double>")
    sinks.write_lines(sinks.pose_lines(poses, fmt).coalesce(1), str(tmp_path / fmt))
    back = formats.read_poses(spark, str(tmp_path / fmt), fmt).orderBy("line").collect()
    assert back[0]["pose"] == pytest.approx(pose, abs=1e-5) and len(back) == 2
    if fmt.startswith("rgbd"):
        assert [r["stamp"] for r in back] == [10.0, 11.0]


def test_g2o_is_written_but_not_read(spark):
    poses = spark.createDataFrame([(3, 0.0, [1.0, 0.0, 0.0, 5.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0])], "id int, stamp double, pose array<double>")
    assert sinks.pose_lines(poses, "g2o").first()["line"].startswith("VERTEX_SE3:QUAT 3 5.000000")
    with pytest.raises(ValueError, match="not read"):
        formats.read_poses(spark, "x", "g2o")


def test_point_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("x_m,Y,kind,nodeId\n1,2,FREE,7\nbad,2,free,8\n3,4,,\n")
    rows = [tuple(r) for r in formats.read_points(spark, str(tmp_path)).orderBy("x").collect()]
    assert rows == [(1.0, 2.0, 0.0, "free", None, 7), (3.0, 4.0, 0.0, "occupied", None, None)]


def test_point_files(spark, tmp_path):
    (tmp_path / "a.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n4 5 6\n")
    (tmp_path / "b.pcd").write_text("# c\nVERSION .7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nWIDTH 1\nHEIGHT 1\nPOINTS 1\nDATA ascii\n7 8 9\n")
    (tmp_path / "c.bin").write_bytes(struct.pack("<4f", 1, 1, 2, 0.5))
    rows = {(r["x"], r["y"], r["z"]) for r in containers.read_points(spark, str(tmp_path)).collect()}
    assert rows == {(1, 2, 3), (4, 5, 6), (7, 8, 9), (1, 1, 2)}


def test_pose_blobs(spark):
    df = spark.createDataFrame([(bytearray(struct.pack("<12f", *range(12))),), (bytearray(b"x"),), (None,)], "b binary")
    out = [r[0] for r in df.select(containers.pose_of_blob("b")).collect()]
    assert out == [[float(i) for i in range(12)], None, None]


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>hello</t></si></sst>")
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1"><v>4.5</v></c></row></sheetData></worksheet>')
    rows = [tuple(r)[1:] for r in containers.read_workbooks(spark, str(tmp_path / "*.xlsx")).orderBy("column").collect()]
    assert rows == [("S", 1, 1, "hello"), ("S", 1, 28, "4.5")]


def test_canonical_json_and_digest(spark):
    assert sinks.canonical_json('{"b": 1.0, "a": [2, -0.0, 0.5], "c": {"y": null, "x": "é"}}') == '{"a":[2,0,0.5],"b":1,"c":{"x":"é","y":null}}'
    df = spark.createDataFrame([('{"b":1,"a":2}',), ('{"a": 2.0, "b": 1}',), (None,)], "j string")
    digests = [r["sha256"] for r in sinks.with_canonical_digest(df, "j").collect()]
    assert digests[0] == digests[1] and digests[2] is None


def test_upsert_and_replace(spark):
    stored = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, label string, weight int")
    out = sinks.upsert(stored, spark.createDataFrame([(2, None, 7), (3, "c", 8)], "id int, label string, weight int"), "id")
    assert sorted(map(tuple, out.collect())) == [(1, "a", 5), (2, "b", 7), (3, "c", 8)]
    links = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "src int, dst int")
    out = sinks.replace_children(links, spark.createDataFrame([(1, 9)], "src int, dst int"), "src")
    assert sorted(map(tuple, out.collect())) == [(1, 9), (2, 3)]


def test_publish_moves_the_pointer_only_after_the_check(spark, tmp_path):
    base = f"file://{tmp_path}/store"
    sinks.publish(spark, spark.range(3), base, "v1")
    with pytest.raises(ValueError, match="check"):
        sinks.publish(spark, spark.range(0), base, "v2", check=lambda df: df.count() > 0)
    assert sinks.current_version(spark, base) == "v1"
    sinks.publish(spark, spark.range(4), base, "v3")
    assert sinks.current_version(spark, base) == "v3"


def test_pointers_without_a_version_and_stale_staging(spark, tmp_path):
    base = f"file://{tmp_path}/store"
    with pytest.raises(ValueError, match="no version"):
        sinks.current_version(spark, base)
    sinks.publish(spark, spark.range(3), base, "v1")
    sinks.publish(spark, spark.range(4), base, "v2")
    with pytest.raises(ValueError, match="already"):
        sinks.publish(spark, spark.range(4), base, "v1")
    assert sinks.current_version(spark, base) == "v2" and spark.read.parquet(f"{base}/v1").count() == 3
    (tmp_path / "store" / "CURRENT-000000000003").write_text("")  # a writer that has just made its pointer
    (tmp_path / "store" / "CURRENT-000000000004").write_text("v9")
    assert sinks.current_version(spark, base) == "v2"
    sinks.publish(spark, spark.range(5), base, "v5")
    assert sinks.current_version(spark, base) == "v5"
    assert sinks.remove_stale(spark, base, 3600) == 0 and sinks.remove_stale(spark, base, 0) == 1  # what the refused v1 left
    assert sinks.current_version(spark, base) == "v5"


def test_manifest(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc")
    row = sinks.manifest(spark, str(tmp_path)).first()
    assert (row["bytes"], row["sha256"]) == (3, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")
