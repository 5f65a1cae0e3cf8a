"""Writing tables and reports. Data are written by the executors; only file names pass the driver."""

from __future__ import annotations

import glob
import os
import re
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape, quoteattr

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import kind_of
from ..operators import evaluation, profile
from ..plans import board
from ..session import new_folder, removed


def write_dataset(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def decimal_comma(df: DataFrame) -> DataFrame:
    """Fractional numbers as text with a decimal comma."""
    comma = lambda f: F.translate(F.col(f"`{f.name}`").cast("string"), ".", ",").alias(f.name)
    return df.select(*[comma(f) if isinstance(f.dataType, T.FractionalType) else F.col(f"`{f.name}`") for f in df.schema])


def write_csv(df: DataFrame, path: str, separator: str = ";", comma: bool = True, mode: str = "errorifexists", limit: int | None = None) -> None:
    rows = df if limit is None else df.limit(limit)
    (decimal_comma(rows) if comma else rows).write.mode(mode).options(sep=separator, header=True, encoding="UTF-8").csv(path)


def report(df: DataFrame) -> dict[str, DataFrame]:
    """The sheets of a report, one DataFrame each: variables, statistics, missing values, quality."""
    spark = df.sparkSession
    numeric = [f.name for f in df.schema if kind_of(f.dataType) == "numeric"]
    exact_at = profile.exact_quantiles(df, numeric, list(profile.QUANTILES.values())) if numeric else {}
    found, score, level = profile.quality_issues(df, exact_at)
    sheets = {
        "summary": spark.createDataFrame([(len(df.columns), df.count(), score, level)], "columns int, rows long, score int, level string"),
        "variables": profile.distinct_counts(df, df.columns),
        "missing": profile.null_counts(df),
        "quality": spark.createDataFrame([(i["column"], i["code"], i["severity"]) for i in found], "column string, code string, severity string"),
    }
    if numeric:
        sheets["statistics"] = profile.numeric_profile(df, numeric, exact_at=exact_at)
    return sheets


#: Rows a sheet of a workbook can hold below its header.
SHEET_ROWS = 1_048_575


#: Rows in a file of a sheet's part: what passes the driver at a time, as bytes.
PART_ROWS = 50_000
_PRINTABLE = re.compile(r"[^\t\n\r\x20-\uD7FF\uE000-\uFFFD\U00010000-\U0010FFFF]")
_HEAD = b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
_TAIL = b"</sheetData></worksheet>"


def _cell(v: object) -> str:
    """A number as a number, all else as text; a missing or non-finite one is empty."""
    if v is None:
        return "<c/>"
    if isinstance(v, int | float) and not isinstance(v, bool):
        return f"<c><v>{v!r}</v></c>" if v == v and abs(v) != float("inf") else "<c/>"
    text = escape(_PRINTABLE.sub("", str(v)), {"\n": "&#10;", "\r": "&#13;"})
    return f'<c t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def _row_xml(values: Iterable) -> str:
    return f"<row>{''.join(map(_cell, values))}</row>"


def _row_parts(df: DataFrame) -> Iterator[bytes]:
    """The rows of a frame as XML, one a line, in pieces of ``PART_ROWS`` lines. The executors write them; the driver
    passes on their files."""
    spark = df.sparkSession

    def lines(batches):
        import pyarrow as pa

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            yield pa.RecordBatch.from_pydict({"value": pa.array([_row_xml(v) for v in zip(*columns, strict=True)], pa.string())})

    plain = df.select(*[F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f"c{i}") if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(df.schema)])
    folder = new_folder(spark, "sheet")
    plain.mapInArrow(lines, "value string").write.option("maxRecordsPerFile", PART_ROWS).text(folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    for (path,) in sorted(files.select("path").collect()):
        yield bytes(spark.read.format("binaryFile").load(path).first()["content"])
    removed(spark, folder)


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """One xlsx file. The executors write the rows of every sheet as XML; the driver zips their files. A workbook is one file of
    at most ``SHEET_ROWS`` rows a sheet: a longer frame is split into several. For data without that bound use ``write_report``."""
    spark = next(iter(sheets.values())).sparkSession
    ns, doc = "http://schemas.openxmlformats.org", "officeDocument/2006/relationships"
    names: list[str] = []
    with tempfile.TemporaryFile() as whole:  # the driver's own scratch file, copied to where all can read it
        with zipfile.ZipFile(whole, "w", zipfile.ZIP_DEFLATED) as book:
            for title, df in sheets.items():
                parts, rest, number = _row_parts(df), b"", 0
                while number == 0 or rest:
                    number += 1
                    names.append(f"{title[:28]}{f'_{number}' if number > 1 else ''}")
                    room = SHEET_ROWS
                    with book.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as out:
                        out.write(_HEAD + _row_xml(df.columns).encode())
                        while room and (piece := rest or next(parts, b"")):
                            rest = b""
                            if (n := piece.count(b"\n")) > room:
                                lines = piece.split(b"\n")
                                piece, rest, n = b"\n".join(lines[:room]) + b"\n", b"\n".join(lines[room:]), room
                            out.write(piece)
                            room -= n
                        out.write(_TAIL)
                    rest = rest or next(parts, b"")
            listed = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
            book.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}/spreadsheetml/2006/main" xmlns:r="{ns}/{doc}"><sheets>{listed}</sheets></workbook>')
            targets = "".join(f'<Relationship Id="rId{i}" Type="{ns}/{doc}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
            book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{ns}/package/2006/relationships">{targets}</Relationships>')
            book.writestr("_rels/.rels", f'<Relationships xmlns="{ns}/package/2006/relationships"><Relationship Id="rId1" Type="{ns}/{doc}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
            parts_listed = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(names) + 1))
            book.writestr("[Content_Types].xml", f'<Types xmlns="{ns}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts_listed}</Types>')
        whole.seek(0)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
        try:
            while chunk := whole.read(1 << 20):
                out.write(bytearray(chunk))
        finally:
            out.close()


def report_workbook(df: DataFrame, path: str, model=None, steps: list | None = None) -> list[str]:
    """The report as one workbook, with the sheets its parts allow: summary, models, variables, holdout (with a trained ``model``), quality,
    statistics, plan (with cleaning ``steps``) and data. Returns their names."""
    spark = df.sparkSession
    base = report(df)
    text = lambda rows, schema: spark.createDataFrame(rows, schema)
    sheets = {"summary": base["summary"]}
    if model is not None:
        metric = evaluation.PRIMARY[model.task]
        sheets["models"] = text([(i, r["model"], metric, None if r[metric] is None else float(r[metric]), r["model"] == model.champion) for i, r in enumerate(model.leaderboard, 1)], "place int, model string, metric string, value double, champion boolean")
        sheets["variables"] = text([(i, c, float(v)) for i, (c, v) in enumerate(model.importance().items(), 1)], "place int, column string, share double")
        sheets["holdout"] = text([(m, None if v is None else float(v), *evaluation.CATALOGUE[m][::2]) for m, v in model.holdout.items() if m in evaluation.CATALOGUE], "metric string, value double, better string, meaning string")
    sheets["quality"] = base["quality"]
    if "statistics" in base:
        sheets["statistics"] = base["statistics"]
    if steps:
        sheets["plan"] = text([(i, s.op, s.column, str(s.params), s.reason, s.enabled) for i, s in enumerate(steps, 1)], "place int, op string, column string, parameters string, reason string, enabled boolean")
    sheets["data"] = df
    write_workbook(sheets, path)
    return list(sheets)


def write_board(df: DataFrame, spec: board.Spec | None, path: str, filters: dict | None = None, workbook: bool = False) -> None:
    """A dashboard as a workbook (KPIs, a sheet per chart, the filtered table), or as a folder of CSV per part."""
    parts = {str(k): v for k, v in board.run(df, filters, spec).items() if isinstance(v, DataFrame)}
    parts["data"] = board.apply_filters(df, filters or {})
    if workbook:
        write_workbook(parts, path)
        return
    for name, part in parts.items():
        write_csv(part, f"{path}/{re.sub(r'[^A-Za-z0-9_]+', '_', name)}")


#: Derby's types of Spark's; others are written as text.
_DERBY = {"boolean": "BOOLEAN", "byte": "SMALLINT", "short": "SMALLINT", "integer": "INTEGER", "long": "BIGINT", "float": "REAL", "double": "DOUBLE", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "string": "VARCHAR(32672)"}


def _derby_text(f: T.StructField) -> Column:
    """A field as Derby loads it: text in quotes, so that its spaces and line ends stay; null as nothing."""
    text = F.col(f"`{f.name}`").cast("string")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(text if f.dataType.typeName() in _DERBY and not isinstance(f.dataType, T.StringType) else quoted, F.lit(""))


def write_derby(tables: dict[str, DataFrame], folder: str) -> str:
    """A read-only Derby database below ``folder`` with the tables, and its address. An embedded database belongs to the process that opened
    it, and one that can be written to no other may open; from an archive every process of the cluster reads it. ``folder`` is one that all of them
    mount. The executors write the rows as text, and the database loads those files."""
    spark = next(iter(tables.values())).sparkSession
    hadoop, jvm = spark._jvm.org.apache.hadoop.fs, spark._jvm
    where = hadoop.Path(folder)
    where = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri()
    if where.getScheme() != "file":
        raise ValueError(f"{folder}: Derby reads from mounted folders only")
    mounted = where.getPath()
    with tempfile.TemporaryDirectory() as scratch:  # the database while it is written, in the driver's own folder
        driver, url = jvm.org.apache.derby.iapi.jdbc.AutoloadedDriver(), f"jdbc:derby:{scratch}/db"
        connection = driver.connect(f"{url};create=true", jvm.java.util.Properties())
        try:
            statement = connection.createStatement()
            for name, df in tables.items():
                kinds = [_DERBY.get(f.dataType.typeName(), "VARCHAR(32672)") for f in df.schema]
                columns = ", ".join(f'"{f.name}" {kind}' for f, kind in zip(df.schema, kinds, strict=True))
                statement.execute(f'CREATE TABLE "{name}" ({columns})')
                lines = f"{mounted}/{name}-rows"
                df.select(F.concat_ws(",", *[_derby_text(f) for f in df.schema])).write.text(f"file://{lines}")
                for path in sorted(glob.glob(f"{glob.escape(lines)}/part-*.txt")):
                    load = connection.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, ?, ?, ',', '\"', 'UTF-8', 0)")
                    load.setString(1, name)
                    load.setString(2, path)
                    load.execute()
                    load.close()
                removed(spark, f"file://{lines}")
            statement.close()
        finally:
            connection.close()
            try:
                driver.connect(f"{url};shutdown=true", jvm.java.util.Properties())
            except Py4JJavaError as e:  # how Derby says that it has closed the database
                if "08006" not in str(e.java_exception.getSQLState()):
                    raise
        with zipfile.ZipFile(f"{mounted}/db.jar", "w", zipfile.ZIP_STORED) as book:  # stored: pages are read by their place
            for path in sorted(glob.glob(f"{scratch}/db/**", recursive=True)):
                if os.path.isfile(path) and not path.endswith(".lck"):
                    book.write(path, os.path.relpath(path, scratch))
    return f"jdbc:derby:jar:({mounted}/db.jar)db"


def delete_dataset(spark: SparkSession, path: str) -> None:
    """Remove a written dataset; a folder that holds no Parquet written by Spark is refused."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop.Path(f"{path}/_SUCCESS")) or not fs.globStatus(hadoop.Path(f"{path}/*.parquet")):
        raise ValueError(f"{path} is not a dataset")
    fs.delete(where, True)


def write_report(df: DataFrame, path: str) -> None:
    """A folder per sheet: small ones in one file, the data in as many as they need."""
    for name, sheet in report(df).items():
        write_csv(sheet.coalesce(1), f"{path}/{name}")
    write_csv(df, f"{path}/data")
