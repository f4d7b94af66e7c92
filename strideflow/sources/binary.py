"""Data sources for recordings in MAT (level 5) and XLSX files: one partition a file, rows as they are parsed.

    spark.dataSource.register(MatFiles)
    spark.read.format("matfile").option("path", folder).option("variable", "acc_data").load()

A MAT variable is held by its task, as its values stand column by column; of a sheet only the shared strings and one row are.
"""

from __future__ import annotations

import datetime
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass
class OneFile(InputPartition):
    uri: str


def files_under(path: str, suffix: str) -> list[str]:
    """URIs of a file, or of the files with that suffix under a folder, sorted."""
    from pyarrow import fs

    system, inner = (fs.LocalFileSystem(), re.sub("^file:/*", "/", path)) if path.startswith(("/", "file:")) else fs.FileSystem.from_uri(path)
    about = system.get_file_info(inner)
    if about.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [about] if about.is_file else system.get_file_info(fs.FileSelector(inner, recursive=True))
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) and not path.startswith("file:") else ""
    return sorted(prefix + f.path for f in found if f.is_file and f.path.lower().endswith(suffix))


def open_file(uri: str):
    from pyarrow import fs

    system, inner = (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)
    return system.open_input_file(inner)


class _Files(DataSource):
    suffix = ""

    def reader(self, schema):
        return _FileReader(self.options, self.suffix, type(self))


class _FileReader(DataSourceReader):
    def __init__(self, options: dict, suffix: str, kind: type):
        self.options, self.suffix, self.kind = dict(options), suffix, kind

    def partitions(self):
        return [OneFile(uri) for uri in files_under(self.options["path"], self.suffix)]

    def read(self, partition: OneFile):
        with open_file(partition.uri) as f:
            for row in self.kind.rows(f, self.options):
                yield (partition.uri, *row)


# --- MAT -----------------------------------------------------------------------------------------------------

#: Element types of the format, and the classes of its arrays.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
TEXTS = {16: "utf-8", 17: "utf-16", 18: "utf-32"}
MATRIX, COMPRESSED, CELL, STRUCTURE, OBJECT, CHARACTERS, SPARSE = 14, 15, 1, 2, 3, 4, 5


def elements(raw: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    """Type and data of the elements that stand end to end; compressed ones are unpacked."""
    at = 0
    while at + 8 <= len(raw):
        kind, size = struct.unpack_from(order + "II", raw, at)
        if kind >> 16:  # a small element: both halves of its first word, then up to four bytes
            kind, size, data = kind & 0xFFFF, kind >> 16, raw[at + 4 : at + 8]
            yield kind, data[:size]
            at += 8
            continue
        data = raw[at + 8 : at + 8 + size]
        if len(data) < size:
            raise ValueError("the MAT file ends within an element")
        at += 8 + size
        if kind == COMPRESSED:
            yield from elements(zlib.decompress(data), order)
        else:
            at += -size % 8
            yield kind, data


def matrix_of(data: bytes, order: str) -> tuple[str, np.ndarray]:
    """Name and values of an array: numbers, texts by row, or a grid of cells."""
    parts = list(elements(data, order))
    flags, shape = struct.unpack_from(order + "I", parts[0][1])[0], np.frombuffer(parts[1][1], order + "i4")
    name, kind = parts[2][1].decode("ascii"), flags & 0xFF
    if kind in (STRUCTURE, OBJECT, SPARSE) or kind > 15 or flags & 0x800:
        raise ValueError(f"variable {name!r}: structures, objects, sparse and complex arrays aren't read")
    if kind == CELL:
        cells = np.empty(len(parts) - 3, object)
        for k, (_, cell) in enumerate(parts[3:]):
            cells[k] = matrix_of(cell, order)[1] if cell else np.zeros((0, 0))
        return name, cells.reshape(shape, order="F")
    of, raw = parts[3] if len(parts) > 3 else (9, b"")
    if kind == CHARACTERS:
        text = raw.decode(TEXTS[of] + ("" if of == 16 else {"<": "-le", ">": "-be"}[order])) if of in TEXTS else "".join(map(chr, np.frombuffer(raw, order + NUMBERS[of]).tolist()))
        letters = np.array(list(text), object).reshape(shape, order="F")
        return name, np.array(["".join(row) for row in letters.reshape(shape[0], -1)], object).reshape(-1, 1)
    return name, np.frombuffer(raw, order + NUMBERS[of]).astype(float).reshape(shape, order="F")


def variables(raw: bytes) -> Iterator[tuple[str, np.ndarray]]:
    if len(raw) < 128 or raw[126:128] not in (b"IM", b"MI"):
        raise ValueError("no level 5 MAT file")
    order = "<" if raw[126:128] == b"IM" else ">"
    for kind, data in elements(raw[128:], order):
        if kind == MATRIX:
            yield matrix_of(data, order)


def _text(cell) -> str | None:
    while isinstance(cell, np.ndarray) and cell.size == 1:
        cell = cell.reshape(-1)[0]
    return str(cell).strip() if isinstance(cell, str) else None


class MatFiles(_Files):
    """path, row (from 0), values (numbers of the row), texts (of cells and characters). Options: path, variable, columns (least number).

    A file without the variable, or whose variable has fewer columns or not two dimensions, raises.
    """

    suffix = ".mat"

    @classmethod
    def name(cls) -> str:
        return "matfile"

    def schema(self) -> str:
        return "path string, row long, values array<double>, texts array<string>"

    @staticmethod
    def rows(f, options: dict) -> Iterator[tuple]:
        wanted = options["variable"]
        found = next((x for name, x in variables(f.read()) if name == wanted), None)
        if found is None:
            raise ValueError(f"there is no variable {wanted!r}")
        if found.ndim != 2 or found.shape[1] < int(options.get("columns", 0)):
            raise ValueError(f"variable {wanted!r} has the shape {found.shape}")
        for k, row in enumerate(found):
            yield (k, None, [_text(c) for c in row]) if found.dtype == object else (k, row.tolist(), None)


# --- XLSX ------------------------------------------------------------------------------------------------------

_SPACE = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _dates(book: zipfile.ZipFile) -> tuple[set[int], datetime.datetime]:
    """Styles that show dates, and day 0."""
    styles, names = set(), book.namelist()
    if "xl/styles.xml" in names:
        tree = ElementTree.fromstring(book.read("xl/styles.xml"))
        own = {int(x.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", x.get("formatCode", "")) for x in tree.iter(f"{_SPACE}numFmt")}
        formats = {n for n, code in own.items() if re.search("[ymdhs]", code.lower())} | set(range(14, 23)) | {45, 46, 47}
        for block in tree.iter(f"{_SPACE}cellXfs"):
            styles |= {k for k, x in enumerate(block) if int(x.get("numFmtId", 0)) in formats}
    first = any(x.get("date1904") in ("1", "true") for x in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_SPACE}workbookPr"))
    return styles, datetime.datetime(1904, 1, 1) if first else datetime.datetime(1899, 12, 30)


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheet_rows(book: zipfile.ZipFile, sheet: int = 1) -> Iterator[tuple[int, list[str | None]]]:
    """Number (from 1) and cells of each row that stands in the sheet; cells between those that stand there are null."""
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as f:
            for _, item in ElementTree.iterparse(f):
                if item.tag == f"{_SPACE}si":
                    shared.append("".join(t.text or "" for t in item.iter(f"{_SPACE}t")))
                    item.clear()
    styles, day0 = _dates(book)
    with book.open(f"xl/worksheets/sheet{sheet}.xml") as f:
        number, events = 0, ElementTree.iterparse(f, ("start", "end"))
        holder = None
        for event, row in events:
            if event == "start":
                holder = row if row.tag == f"{_SPACE}sheetData" else holder
                continue
            if row.tag != f"{_SPACE}row":
                continue
            number, cells = int(row.get("r", number + 1)), []
            for cell in row:
                at = _column(cell.get("r")) if cell.get("r") else len(cells)
                cells += [None] * (at - len(cells))
                cells.append(_cell(cell, shared, styles, day0))
            yield number, cells
            holder.clear()  # rows behind take no memory


def _cell(cell, shared: list[str], styles: set[int], day0: datetime.datetime) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_SPACE}t"))
    value = cell.findtext(f"{_SPACE}v")
    if value is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "true" if value == "1" else "false"
    if kind == "n" and int(cell.get("s", 0)) in styles:
        return (day0 + datetime.timedelta(milliseconds=round(float(value) * 86_400_000))).isoformat(sep=" ")
    return value


class XlsxFiles(_Files):
    """path, line (the row's number in the sheet), cells (texts; dates as ISO). Options: path, sheet (from 1)."""

    suffix = ".xlsx"

    @classmethod
    def name(cls) -> str:
        return "xlsxfile"

    def schema(self) -> str:
        return "path string, line long, cells array<string>"

    @staticmethod
    def rows(f, options: dict) -> Iterator[tuple]:
        source = f if hasattr(f, "seekable") and f.seekable() else io.BytesIO(f.read())
        with zipfile.ZipFile(source) as book:
            yield from sheet_rows(book, int(options.get("sheet", 1)))


# --- recordings in these files ------------------------------------------------------------------------------------


def activity_codes(spark: SparkSession, path: str) -> DataFrame:
    """code (from 1), raw: the short names in the second row of ``acc_names``."""
    spark.dataSource.register(MatFiles)
    rows = spark.read.format("matfile").option("path", path).option("variable", "acc_names").load().where("row = 1")
    return rows.select(F.posexplode("texts").alias("_k", "raw")).select((F.col("_k") + 1).cast("int").alias("code"), "raw")


def centred_windows(spark: SparkSession, folder: str, size: int = 128, samples: int = 151) -> DataFrame:
    """row, raw, subject, trial and arrays x, y, z: the middle ``size`` of ``samples`` of each axis.

    From ``acc_data.mat`` (three axes side by side), ``acc_labels.mat`` (code, subject, trial) and ``acc_names.mat`` in the folder.
    Other shapes or numbers of rows raise; rows with a value that isn't finite or with an unknown code are left out.
    """
    spark.dataSource.register(MatFiles)
    read = lambda name, columns: spark.read.format("matfile").options(path=f"{folder}/{name}.mat", variable=name, columns=str(columns)).load()
    data, labels = read("acc_data", 3 * samples), read("acc_labels", 3).select("row", *[F.col("values")[k].cast("int").alias(n) for k, n in enumerate(("code", "subject", "trial"))])
    n, least, most = data.agg(F.count("*"), F.min(F.size("values")), F.max(F.size("values"))).first()
    if n != labels.count() or n and (least, most) != (3 * samples, 3 * samples):
        raise ValueError("data and labels differ in shape from what was expected")
    finite = "forall(values, v -> v > double('-Infinity') and v < double('Infinity'))"
    both = data.where(finite).select("row", "values").join(labels, "row")
    axis = lambda k: F.slice("values", k * samples + (samples - size) // 2 + 1, size)
    codes = F.broadcast(activity_codes(spark, f"{folder}/acc_names.mat"))  # one row an activity
    return both.join(codes, "code").select("row", "raw", "subject", "trial", *[axis(k).alias(n) for k, n in enumerate("xyz")])


def sheet_recording(spark: SparkSession, path: str, columns: tuple[str, ...], numbers: tuple[str, ...], sheet: int = 1) -> DataFrame:
    """The sheet's rows below its first as named columns, ``numbers`` as doubles; ``line`` tells their order. Rows with a broken number are left out."""
    spark.dataSource.register(XlsxFiles)
    rows = spark.read.format("xlsxfile").options(path=path, sheet=str(sheet)).load()
    first = rows.groupBy("path").agg(F.min("line").alias("_first"))
    cells = [(F.get("cells", F.lit(k)).try_cast("double") if n in numbers else F.get("cells", F.lit(k))).alias(n) for k, n in enumerate(columns)]
    return rows.join(F.broadcast(first), "path").where("line > _first").select("path", "line", *cells).dropna(subset=list(numbers))
