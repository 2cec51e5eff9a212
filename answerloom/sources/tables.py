"""Reading survey files: delimited text in whatever encoding, Excel workbooks, Parquet and what else Spark reads."""

from __future__ import annotations

import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.ingest import guess_header_row

#: Only a really empty cell is null; words like "None" are answers.
NULL_VALUE = ""
DELIMITERS = (",", ";", "\t", "|")
ENCODINGS = ("utf-8", "cp1252", "latin-1")
BOM = chr(0xFEFF)
#: Bytes of a file that are looked at to guess its encoding and delimiter.
PROBE = 1 << 20
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def head_bytes(spark: SparkSession, path: str, n: int = PROBE) -> bytes:
    """The first bytes of a file in any store that Spark reads."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).open(jpath)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)))
    finally:
        stream.close()


def guess_encoding(data: bytes) -> str:
    for name in ENCODINGS:
        try:
            data.decode(name)
            return name
        except UnicodeDecodeError as e:
            if name == "utf-8" and e.start >= len(data) - 3 and e.reason == "unexpected end of data":
                return name  # the probe cut a character
    raise ValueError("the file is not text")


def guess_delimiter(line: str) -> str:
    return max(DELIMITERS, key=line.count) if any(map(line.count, DELIMITERS)) else ","


def _windows(df: DataFrame, encoding: str) -> DataFrame:
    """Spark does not read Windows-1252; it is ISO-8859-1 but for the 32 places from 0x80."""
    if encoding != "cp1252":
        return df
    places = [bytes([b]) for b in range(0x80, 0xA0)]
    pairs = [(p.decode("latin-1"), p.decode("cp1252", "ignore")) for p in places if p.decode("cp1252", "ignore")]
    old, new = ("".join(x) for x in zip(*pairs))
    return df.select([F.translate(F.col(f"`{c}`"), old, new).alias(c.translate(str.maketrans(old, new))) for c in df.columns])


#: Bytes of input for each core from which a table's own splits keep all cores busy.
SPLIT = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table read from few small files, dealt to all cores before heavy work on texts.

    A file of one row group is one task however many cores there are. Tables of
    more files than cores, or of enough bytes for each, stay as they are.
    """
    spark = df.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, df.inputFiles()
    if not files or len(files) >= cores:
        return df
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(files[0]).getFileSystem(spark._jsc.hadoopConfiguration())
    if sum(fs.getFileStatus(path(f)).getLen() for f in files) >= SPLIT * cores:
        return df
    return df.repartition(cores)


#: Bytes up to which a delimited file is read by one task, so that quoted values may have line breaks.
ONE_TASK = 64 << 20


def spans_lines(lines: list[str]) -> bool:
    """Whether a quoted value goes on in the next line: a line has an odd number of quotes."""
    return any(line.count('"') % 2 for line in lines[:-1])


def read_delimited(spark: SparkSession, path: str, header_row: int = 0, multi_line: bool | None = None) -> DataFrame:
    """A delimited file; encoding and delimiter are guessed from its start.

    multi_line: whether values may have line breaks, which makes the file one task.
    If not said, small files may, and large ones if values at the start do.
    """
    data = head_bytes(spark, path)
    if multi_line is None:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        size = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(jpath).getLength()
        multi_line = size <= ONE_TASK or spans_lines(data.decode("latin-1").splitlines())
    encoding = guess_encoding(data)
    lines = data.decode(encoding, "ignore").removeprefix(BOM).splitlines()
    line = lines[header_row] if len(lines) > header_row else ""
    charset = "UTF-8" if encoding == "utf-8" else "ISO-8859-1"
    reader = spark.read.option("sep", guess_delimiter(line)).option("encoding", charset).option("nullValue", NULL_VALUE).option("emptyValue", NULL_VALUE).option("quote", '"').option("escape", '"')
    if header_row:
        # the rows above the header go; the file is read as lines and parsed by the schema of its header
        import csv

        names = next(csv.reader([line], delimiter=guess_delimiter(line)))
        schema = StructType([StructField(n.removeprefix(BOM), StringType()) for n in names])
        # the text reader knows UTF-8 only, so such a file is decoded as it is read, whole
        body = spark.read.format("binaryFile").load(path).select(F.posexplode(F.split(F.decode("content", charset), "\r?\n")).alias("at", "value"))
        rows = body.where((F.col("at") > header_row) & (F.col("value") != "")).orderBy("at")
        parsed = rows.select(F.from_csv("value", ", ".join(f"`{f.name}` STRING" for f in schema), {"sep": guess_delimiter(line), "nullValue": NULL_VALUE, "quote": '"', "escape": '"'}).alias("r")).select("r.*")
        return _windows(parsed, encoding)
    df = reader.option("header", "true").option("multiLine", multi_line).csv(path)
    return _windows(df.toDF(*[c.removeprefix(BOM) for c in df.columns]), encoding)


# -- Excel ----------------------------------------------------------------


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def sheet_names(path: str) -> list[str]:
    with zipfile.ZipFile(path) as z:
        return [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS)]


def sheet_rows(path: str, sheet: int | str = 0):
    """Rows of a sheet as lists of str, float, bool or None, read from the workbook's XML as a stream."""
    with zipfile.ZipFile(path) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        sheets = list(book.find("m:sheets", _NS))
        pick = sheets[sheet] if isinstance(sheet, int) else next(s for s in sheets if s.get("name") == sheet)
        rels = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in rels if r.get("Id") == pick.get(_REL))
        strings: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                strings.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{{{_NS['m']}}}row":
                    continue
                cells: list = []
                for c in row.findall("m:c", _NS):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    kind, v = c.get("t"), c.find("m:v", _NS)
                    if kind == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                    elif v is None or v.text is None:
                        cells[at] = None
                    elif kind == "s":
                        cells[at] = strings[int(v.text)]
                    elif kind == "b":
                        cells[at] = v.text == "1"
                    elif kind in ("str", "e"):
                        cells[at] = v.text
                    else:
                        cells[at] = float(v.text)
                yield [None if c == "" else c for c in cells]
                row.clear()


def sheet_table(path: str, sheet: int | str = 0, header_row: int | str = "auto", skip_rows: int = 0) -> tuple[list[str], list[list]]:
    """(column names, rows) of a sheet; "auto" guesses which row is the header."""
    rows = list(sheet_rows(path, sheet))
    at = guess_header_row(rows) if header_row == "auto" else int(header_row)
    names: list[str] = []
    for k, cell in enumerate(rows[at] if rows else []):
        name, n = str(cell).strip() if cell is not None else f"column_{k}", 1
        while name in names:
            name, n = f"{str(cell).strip()}.{n}", n + 1
        names.append(name)
    body = [(r + [None] * len(names))[: len(names)] for r in rows[at + 1 + skip_rows :]]
    return names, [r for r in body if any(c is not None for c in r)]


def _text(cell) -> str | None:
    if cell is None or isinstance(cell, str):
        return cell
    return str(int(cell)) if isinstance(cell, float) and cell.is_integer() else str(cell)


class XlsxReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        o = self.options
        sheet = o.get("sheet", "0")
        header = o.get("header_row", "auto")
        _, rows = sheet_table(o["path"], int(sheet) if sheet.isdigit() else sheet, header if header == "auto" else int(header), int(o.get("skip_rows", "0")))
        for r in rows:
            yield tuple(map(_text, r))


class XlsxSource(DataSource):
    """``spark.read.format("xlsx").option("sheet", ...).load(path)``; all columns are text."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> StructType:
        o = self.options
        sheet = o.get("sheet", "0")
        header = o.get("header_row", "auto")
        names, _ = sheet_table(o["path"], int(sheet) if sheet.isdigit() else sheet, header if header == "auto" else int(header))
        return StructType([StructField(n, StringType()) for n in names])

    def reader(self, schema: StructType) -> XlsxReader:
        return XlsxReader(self.options)


def read_table(spark: SparkSession, path: str, sheet: int | str = 0, header_row: int | str = "auto", skip_rows: int = 0) -> DataFrame:
    """A survey file by its ending: workbook, Parquet, JSON, else delimited text."""
    low = path.lower()
    if low.endswith(".xlsx"):
        spark.dataSource.register(XlsxSource)
        return spark.read.format("xlsx").option("sheet", str(sheet)).option("header_row", str(header_row)).option("skip_rows", str(skip_rows)).load(path)
    if low.endswith((".parquet", ".parquet/")):
        return spark.read.parquet(path)
    if low.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    return read_delimited(spark, path, 0 if header_row == "auto" else int(header_row))


def preview(df: DataFrame, n: int = 8) -> DataFrame:
    return df.limit(n)
