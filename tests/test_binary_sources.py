"""MAT and XLSX readers against files that the tests write byte by byte."""

import struct
import zipfile
import zlib

import numpy as np
import pytest

from strideflow.operators import timeseries
from strideflow.sources import binary

NUMBER = {"f8": 9, "i4": 5, "u1": 2, "i2": 3}


def element(kind, data, order="<"):
    if 0 < len(data) <= 4:
        return struct.pack(order + "I", len(data) << 16 | kind) + data.ljust(4, b"\0")
    return struct.pack(order + "II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def array(name, x, order="<", stored="f8", kind=6, cells=None):
    shape = (len(cells), len(cells[0])) if cells else x.shape
    body = element(6, struct.pack(order + "II", 1 if cells else kind, 0), order) + element(5, struct.pack(f"{order}{len(shape)}i", *shape), order) + element(1, name.encode(), order)
    if cells:
        for column in zip(*cells, strict=True):
            for text in column:
                body += array("", np.array([[ord(c) for c in text]]), order, "u2", 4)
    else:
        body += element(4 if stored == "u2" else NUMBER[stored], np.asfortranarray(x).astype(order + stored).tobytes(order="F"), order)
    return element(14, body, order)


def mat(path, *arrays, order="<", packed=True):
    body = b"".join(struct.pack(order + "II", 15, len(z)) + z for a in arrays for z in [zlib.compress(a)]) if packed else b"".join(arrays)
    path.write_bytes(b"made by a test".ljust(124) + struct.pack(order + "H", 0x100) + (b"IM" if order == "<" else b"MI") + body)


@pytest.mark.parametrize("order,packed", [("<", True), (">", False)])
def test_centred_windows(spark, tmp_path, order, packed):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(6, 453))
    data[2, 400], data[4, 3] = np.nan, np.inf
    labels = np.array([[1, 7, 1], [2, 7, 2], [1, 8, 1], [3, 8, 1], [2, 9, 1], [1, 9, 2]])
    mat(tmp_path / "acc_data.mat", array("other", np.ones((2, 2)), order), array("acc_data", data, order), order=order, packed=packed)
    mat(tmp_path / "acc_labels.mat", array("acc_labels", labels, order, "u1"), order=order, packed=packed)
    mat(tmp_path / "acc_names.mat", array("acc_names", None, order, cells=[["Walking slowly", "Falling down"], ["Walk", "FallingB"]]), order=order, packed=packed)
    assert {tuple(r) for r in binary.activity_codes(spark, f"{tmp_path}/acc_names.mat").collect()} == {(1, "Walk"), (2, "FallingB")}
    got = {r.row: r for r in binary.centred_windows(spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 1, 5]  # rows 2 and 4 aren't finite, code 3 is unknown
    for k, r in got.items():
        assert (r.raw, r.subject, r.trial) == (["Walk", "FallingB"][labels[k, 0] - 1], labels[k, 1], labels[k, 2])
        assert [r.x, r.y, r.z] == [data[k, a * 151 + 11 : a * 151 + 139].tolist() for a in range(3)]


def test_broken_mat_files_raise(spark, tmp_path):
    good = array("v", np.arange(12.0).reshape(3, 4))
    with pytest.raises(ValueError, match="level 5"):
        list(binary.variables(b"nothing of the kind"))
    mat(tmp_path / "a.mat", good)
    with pytest.raises(ValueError, match="no variable"):
        list(binary.MatFiles.rows((tmp_path / "a.mat").open("rb"), {"variable": "w"}))
    with pytest.raises(ValueError, match="shape"):
        list(binary.MatFiles.rows((tmp_path / "a.mat").open("rb"), {"variable": "v", "columns": "5"}))
    raw = b"x".ljust(124) + struct.pack("<H", 0x100) + b"IM" + good
    with pytest.raises(ValueError, match="ends within"):
        list(binary.variables(raw[:-16]))
    mat(tmp_path / "c.mat", array("v", np.arange(6.0).reshape(2, 3), stored="i2"), array("t", np.array([[65, 66], [67, 68]]), stored="u1", kind=4))
    found = dict(binary.variables((tmp_path / "c.mat").read_bytes()))
    assert found["v"].tolist() == [[0, 1, 2], [3, 4, 5]] and found["t"].tolist() == [["AB"], ["CD"]]
    with pytest.raises(FileNotFoundError):
        binary.files_under(f"{tmp_path}/none.mat", ".mat")


def test_labels_and_data_of_other_lengths_raise(spark, tmp_path):
    mat(tmp_path / "acc_data.mat", array("acc_data", np.zeros((2, 453))))
    mat(tmp_path / "acc_labels.mat", array("acc_labels", np.ones((3, 3))))
    mat(tmp_path / "acc_names.mat", array("acc_names", None, cells=[["a", "b"], ["A", "B"]]))
    with pytest.raises(Exception, match="differ in shape"):
        binary.centred_windows(spark, str(tmp_path)).collect()


def workbook(path, rows, shared, styles="", first=""):
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f"<workbook {space}>{first}</workbook>")
        z.writestr("xl/styles.xml", f"<styleSheet {space}>{styles}</styleSheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {space}>" + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{''.join(rows)}</sheetData></worksheet>")


def test_sheets(spark, tmp_path):
    styles = '<numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="0.00&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>'
    rows = [
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>', '<row r="3"><c r="A3"><v>1.5</v></c><c r="AB3" t="inlineStr"><is><t>far</t></is></c></row>',
        '<row r="4"><c r="A4" s="1"><v>45000.5</v></c><c r="B4" s="2"><v>1</v></c><c r="C4" s="3"><v>2</v></c><c r="D4" t="b"><v>1</v></c><c r="E4" t="e"><v>#N/A</v></c><c r="F4" t="str"><v>f</v></c></row>', "<row><c><v>7</v></c><c/></row>",
    ]
    workbook(tmp_path / "a.xlsx", rows, ["<t>time</t>", "<r><t>la</t></r><r><t>bel</t></r>"], styles)
    spark.dataSource.register(binary.XlsxFiles)
    got = {r.line: r.cells for r in spark.read.format("xlsxfile").option("path", str(tmp_path)).load().collect()}
    assert got[1] == ["time", "label"] and got[3] == ["1.5", *[None] * 26, "far"] and got[5] == ["7", None]
    assert got[4] == ["2023-03-15 12:00:00", "1899-12-31 00:00:00", "2", "true", None, "f"]


def test_sheet_recording_into_label_runs(spark, tmp_path):
    cell = lambda c, k, v: f'<c r="{c}{k}"><v>{v}</v></c>' if not isinstance(v, str) else f'<c r="{c}{k}" t="inlineStr"><is><t>{v}</t></is></c>'
    said = [("timestamp", "ax", "label"), (40, 4.0, "walk"), (0, 0.0, "walk"), (20, 2.0, "walk"), (60, "?", "walk"), (80, 8.0, "run"), (100, 1.0, "walk")]
    workbook(tmp_path / "p.xlsx", [f'<row r="{k}">{"".join(cell(c, k, v) for c, v in zip("ABC", r, strict=True))}</row>' for k, r in enumerate(said, 1)], [])
    rows = binary.sheet_recording(spark, f"{tmp_path}/p.xlsx", ("timestamp", "x", "activity"), ("timestamp", "x"))
    rows = rows.selectExpr("'1' as session", "line as seq", "timestamp / 1000 as t", "x", "activity")
    runs = timeseries.label_runs(rows).orderBy("t").collect()
    assert [(round(r.t, 2), r.x, r.activity, r.run) for r in runs] == [(0.0, 0.0, "walk", 1), (0.02, 2.0, "walk", 1), (0.04, 4.0, "walk", 1), (0.08, 8.0, "run", 2), (0.1, 1.0, "walk", 3)]
