"""Where results go: tables by question, JSON records, sheets."""

from __future__ import annotations

import re
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

RESERVED = ("Combined", "results", "results_codes", "spelling")
#: Rows a workbook sheet can have.
SHEET_ROWS = 1_048_576
#: Characters that XML cannot hold.
_CONTROL = re.compile("[%s]" % "".join(chr(c) for c in range(32) if c not in (9, 10, 13)))


def sheet_name(name: str) -> str:
    """A name a sheet may have; reserved ones get a mark."""
    out = re.sub(r"[\[\]:*?/\\]", "", name)[:31]
    return f"{out[:27]} (Q)" if out.lower() in {r.lower() for r in RESERVED} else out


def write_tables(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> dict[str, str]:
    """Each table in a folder of its own; the paths."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{folder.rstrip('/')}/{re.sub(r'[^A-Za-z0-9_-]+', '_', name)}"
        writer = df.write.mode("overwrite")
        (writer.option("header", "true").csv if kind == "csv" else writer.json if kind == "json" else writer.parquet)(paths[name])
    return paths


def write_workbook(tables: dict[str, DataFrame], path: str) -> None:
    """A workbook with a sheet for each table, for results that a person reads; a table that no sheet can hold raises ValueError."""

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_CONTROL.sub('', str(v)))}</t></is></c>'

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    names = [sheet_name(n) if n not in RESERVED else n for n in tables]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        sheets = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{sheets}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1)) + "</Relationships>")
        for k, df in enumerate(tables.values(), 1):
            with z.open(f"xl/worksheets/sheet{k}.xml", "w") as f:
                f.write(f'<worksheet xmlns="{main}"><sheetData><row>'.encode())
                f.write("".join(map(cell, df.columns)).encode() + b"</row>")
                for n, row in enumerate(df.toLocalIterator(), 2):
                    if n > SHEET_ROWS:
                        raise ValueError("the table has more rows than a sheet")
                    f.write(b"<row>" + "".join(map(cell, row)).encode() + b"</row>")
                f.write(b"</sheetData></worksheet>")
