"""Exports: CSV bundles with a manifest, and a minimal spreadsheet."""

from __future__ import annotations

import json
import os
import uuid
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def _files(df: DataFrame, path: str):
    """The file system of a path and the path in it, as the cluster's Hadoop configuration says."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    fs.setWriteChecksum(False)
    return jvm, conf, fs, fs.makeQualified(target)


def _replace(jvm, conf, staged, target) -> None:
    """`staged` takes the place of `target` in one step."""
    options = jvm.org.apache.hadoop.fs.Options.Rename
    array = jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
    jvm.java.lang.reflect.Array.set(array, 0, options.OVERWRITE)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(staged, target, array)


def write_csv(df: DataFrame, path: str) -> int:
    """One UTF-8 CSV file with BOM and header; the number of its rows.

    Tasks write their parts in parallel beside the target, in whatever file system that is; the parts are then appended to a
    temporary file there that replaces the target at once. Rows are counted as they are written.
    """
    jvm, conf, fs, target = _files(df, path)
    work = jvm.org.apache.hadoop.fs.Path(f"{target.toString()}.{uuid.uuid4().hex}")
    staged = jvm.org.apache.hadoop.fs.Path(f"{work.toString()}.csv")
    seen = Observation(uuid.uuid4().hex)
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("header", False).option("escape", '"').option("quoteAll", False).option("emptyValue", "").csv(work.toString())
    out = fs.create(staged, True)
    try:
        out.write(bytearray("\ufeff".encode() + (",".join(df.columns) + "\n").encode()))
        for name in sorted(f.getPath().toString() for f in fs.listStatus(work) if f.getPath().getName().startswith("part-")):
            part = fs.open(jvm.org.apache.hadoop.fs.Path(name))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            finally:
                part.close()
    finally:
        out.close()
    _replace(jvm, conf, staged, target)
    fs.delete(work, True)
    return int(seen.get["rows"])


def write_bundle(frames: dict[str, DataFrame], folder: str, version: int = 8, notes: list[str] | None = None) -> dict:
    """A CSV per frame and manifest.json with their counts."""
    counts = {name: write_csv(df, f"{folder}/{name}.csv") for name, df in frames.items()}
    manifest = {"schema_version": version, "files": {f"{n}.csv": c for n, c in counts.items()}, "notes": notes or []}
    write_json(next(iter(frames.values())), manifest, f"{folder}/manifest.json")
    return manifest


def write_json(df: DataFrame, report: dict | list, path: str) -> None:
    """A small report as JSON at a path of any file system the session of `df` knows; it replaces an older one at once."""
    jvm, conf, fs, target = _files(df, path)
    staged = jvm.org.apache.hadoop.fs.Path(f"{target.toString()}.{uuid.uuid4().hex}")
    out = fs.create(staged, True)
    try:
        out.write(bytearray(json.dumps(report, ensure_ascii=False, indent=2).encode()))
    finally:
        out.close()
    _replace(jvm, conf, staged, target)


def write_export(df: DataFrame, path: str, kind: str) -> int:
    """Rows as one CSV file, or as JSON lines in a folder; the number of rows. Raises for other kinds."""
    if kind == "csv":
        return write_csv(df, path)
    if kind == "json":
        seen = Observation(uuid.uuid4().hex)
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").json(path)
        return int(seen.get["rows"])
    raise ValueError(f"no export of the kind {kind}")


def _letters(n: int) -> str:
    """The name of column n, counted from 1."""
    name = ""
    while n:
        n, r = divmod(n - 1, 26)
        name = chr(65 + r) + name
    return name


def _cell(row: int, column: int, value) -> str:
    name = _letters(column + 1)
    if value is None:
        return ""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f'<c r="{name}{row}"><v>{value}</v></c>'
    return f'<c r="{name}{row}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def write_xlsx(df: DataFrame, path: str, sheet: str = "Leads", most_rows: int = 1_000_000) -> int:
    """A spreadsheet of one sheet with frozen header and filter, on the driver's machine. Raises beyond what a sheet holds."""
    last, n = _letters(max(1, len(df.columns))), 1
    staged = f"{path}.{uuid.uuid4().hex}"
    with zipfile.ZipFile(staged, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>')
        with z.open("xl/worksheets/sheet1.xml", "w") as out:
            out.write(b'<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData>')
            out.write(f'<row r="1">{"".join(_cell(1, i, c) for i, c in enumerate(df.columns))}</row>'.encode())
            for row in df.toLocalIterator():  # a partition at a time
                n += 1
                if n > most_rows + 1:
                    os.remove(staged)
                    raise ValueError(f"a sheet holds {most_rows} rows")
                out.write(f'<row r="{n}">{"".join(_cell(n, i, v) for i, v in enumerate(row))}</row>'.encode())
            out.write(f'</sheetData><autoFilter ref="A1:{last}{n}"/></worksheet>'.encode())
    os.replace(staged, path)
    return n - 1
