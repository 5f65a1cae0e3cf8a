"""Reading tables: delimited text with sniffed form, JSON, Parquet, workbooks, JDBC.

Text is read as strings over the whole input and typed by a cleaning plan; a later block never loses a
column because the first block had another type."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from itertools import islice
from xml.etree import ElementTree
from xml.parsers import expat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import clean_columns, normalise_types

#: Separators that are tried, in this order.
SEPARATORS = (";", ",", "\t", "|")
SAMPLE_BYTES = 256_000


@dataclass(frozen=True)
class Form:
    encoding: str
    separator: str
    decimal: str


def sniff(head: bytes) -> Form:
    """Encoding, separator and decimal mark from the first bytes of a file."""
    encoding = "utf-8-sig" if head.startswith(b"\xef\xbb\xbf") else "utf-8"
    try:
        text = head.decode(encoding)
    except UnicodeDecodeError as e:
        cut = len(head) >= SAMPLE_BYTES and e.start > len(head) - 4  # the sample may end inside a character
        encoding = "utf-8" if cut else "latin-1"
        text = head.decode(encoding, "ignore")
    separator = choose_separator(text)
    commas, dots = len(re.findall(r"\d,\d", text)), len(re.findall(r"\d\.\d", text))
    return Form(encoding, separator, "," if separator != "," and commas > dots else ".")


def choose_separator(text: str) -> str:
    """The separator under which at least nine rows in ten have the header's number of fields."""
    lines, best = [x for x in text.splitlines()[:60] if x.strip()], (0.0, "\x01")
    for mark in SEPARATORS:
        counts = [len(r) for r in csv.reader(lines, delimiter=mark)]
        if not counts or counts[0] < 2:
            continue
        consistent = sum(n == counts[0] for n in counts) / len(counts)
        if consistent >= 0.9 and 100 * consistent + counts[0] > best[0]:
            best = (100 * consistent + counts[0], mark)
    return best[1]


def file_head(spark: SparkSession, path: str, size: int = SAMPLE_BYTES) -> bytes:
    """The first bytes of the first file (by name) at ``path``; only these are read."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((f for p in fs.globStatus(where) or [] for f in (fs.listStatus(p.getPath()) if p.isDirectory() else [p])), key=lambda f: f.getPath().getName())
    files = [f for f in found if not f.isDirectory() and f.getLen() and f.getPath().getName()[0] not in "._"]
    if not files:
        return b""
    stream = fs.open(files[0].getPath())
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def read_delimited(spark: SparkSession, path: str, form: Form | None = None) -> DataFrame:
    """All columns as text, missing tokens as null, malformed lines left out."""
    if form is None:
        form = sniff(file_head(spark, path))
    reader = spark.read.options(sep=form.separator, encoding="UTF-8" if form.encoding.startswith("utf-8") else "ISO-8859-1", header=True, mode="DROPMALFORMED", ignoreLeadingWhiteSpace=True, quote='"', escape='"')
    raw = reader.csv(path)
    return normalise_types(raw.toDF(*clean_columns([c.lstrip("\ufeff") for c in raw.columns])))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("mergeSchema", True).parquet(path)
    return df.toDF(*clean_columns(df.columns))


def read_json(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """JSON lines or whole documents; by default whatever the first character says."""
    if lines is None:
        first = spark.read.text(path).where(F.length(F.trim("value")) > 0).first()
        lines = bool(first) and first[0].strip().startswith("{") and first[0].strip().endswith("}")
    df = spark.read.json(path, multiLine=not lines)
    return df.toDF(*clean_columns(df.columns))


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


#: Built-in number formats that are dates or times.
_DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def _continuations(book: zipfile.ZipFile, sheet: int | str) -> list[str]:
    """The names of the sheets that continue one."""
    listed = [s.get("name") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{{{_NS['m']}}}sheet")]
    name, found = sheet if isinstance(sheet, str) else listed[sheet - 1], []
    while (more := f"{name[:28]}_{len(found) + 2}") in listed:
        found.append(more)
    return found


def _sheet_part(book: zipfile.ZipFile, sheet: int | str) -> str:
    """Path of the sheet's part, by its number or name in the workbook."""
    relation = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    listed = [(s.get("name"), s.get(relation)) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{{{_NS['m']}}}sheet")]
    wanted = [i for i, (name, _) in enumerate(listed, 1) if sheet in (i, name)]
    if not wanted:
        raise ValueError(f"no sheet {sheet!r}; there are {[n for n, _ in listed]}")
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = targets.get(listed[wanted[0] - 1][1], f"worksheets/sheet{wanted[0]}.xml")
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{{{_NS['m']}}}numFmt") if re.search(r"[dy]|m{2,}|h", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "").lower()))}
    styles = root.find("m:cellXfs", _NS)
    return {i for i, x in enumerate(styles if styles is not None else []) if int(x.get("numFmtId", 0)) in _DATE_FORMATS | own}


def _iso(serial: str) -> str:
    days = float(serial)
    moment = datetime(1899, 12, 30) + timedelta(days=days)
    return moment.strftime("%Y-%m-%d") if days == int(days) else moment.strftime("%Y-%m-%d %H:%M:%S")


class _Rows:
    """Handlers of a sheet's XML that keep nothing but the rows not yet taken from ``done``."""

    def __init__(self, shared: list[str], dates: set[int]) -> None:
        self.shared, self.dates, self.places = shared, dates, {}
        self.done: list[list[str | None]] = []
        self.row: list[str | None] | None = None
        self.cell: dict | None = None
        self.text: list[str] | None = None
        ns = _NS["m"]
        self.row_tag, self.cell_tag, self.value_tag, self.text_tag = (f"{ns} {t}" for t in ("row", "c", "v", "t"))

    def start(self, tag: str, given: dict) -> None:
        if tag == self.row_tag:
            self.row = []
        elif tag == self.cell_tag and self.row is not None:
            self.cell, self.value, self.inline = given, None, []
        elif self.cell is not None and (tag == self.text_tag or tag == self.value_tag):
            self.text = []

    def data(self, text: str) -> None:
        if self.text is not None:
            self.text.append(text)

    def end(self, tag: str) -> None:
        if tag == self.value_tag and self.text is not None:
            self.value, self.text = "".join(self.text) if self.value is None else self.value, None
        elif tag == self.text_tag and self.text is not None:
            self.inline.append("".join(self.text))
            self.text = None
        elif tag == self.cell_tag and self.cell is not None:
            self.add(self.cell, self.value)
            self.cell = None
        elif tag == self.row_tag and self.row is not None:
            if any(self.row):
                self.done.append(self.row)
            self.row = None

    def add(self, cell: dict, value: str | None) -> None:
        kind, letters = cell.get("t"), re.match(r"[A-Z]+", cell["r"]) if "r" in cell else None
        if letters is not None:
            if letters[0] not in self.places:
                self.places[letters[0]] = sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(letters[0]))) - 1
            self.row += [None] * (self.places[letters[0]] - len(self.row))
        if kind == "s" and value is not None:
            value = self.shared[int(value)]
        elif kind == "inlineStr":
            value = "".join(self.inline)
        elif value is not None and kind in (None, "n") and self.dates and int(cell.get("s", 0)) in self.dates:
            value = _iso(value)
        self.row.append(value)


def _cells(book: zipfile.ZipFile, sheet: int | str) -> Iterator[list[str | None]]:
    """The rows of a sheet that are not blank. The sheet is parsed in pieces, and no tree of it is kept."""
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
    rows, parser = _Rows(shared, _date_styles(book)), expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = rows.start, rows.end, rows.data
    with book.open(_sheet_part(book, sheet)) as source:
        while piece := source.read(1 << 16):
            parser.Parse(piece, False)
            yield from rows.done
            rows.done.clear()
    parser.Parse(b"", True)


def _books(batches: Iterator) -> Iterator[zipfile.ZipFile]:
    """The workbooks of Arrow batches of files: opened in their place if there is no ``content``, so that a task holds none as a whole."""
    for batch in batches:
        for row in batch.to_pylist():
            with zipfile.ZipFile(io.BytesIO(row["content"]) if "content" in row else re.sub("^file:/*", "/", row["path"])) as book:
                yield book


def _batch(values: list, kind: str):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({"cells": pa.array(values, pa.list_(pa.string()))} if kind == "cells" else {kind: pa.array(values, pa.int32())})


#: Rows of a sheet that a task passes on at a time.
BATCH_ROWS = 10_000


def read_workbook(spark: SparkSession, path: str, sheet: int | str = 1, continued: bool = False) -> DataFrame:
    """Workbooks (xlsx) as text columns: the first row that is not blank has the names. Files are read in parallel, one a task
    (a sheet has 1 048 576 rows at most). ``sheet`` is a number or a name; cells styled as dates become ISO text. With ``continued`` the
    sheets ``name_2``, ``name_3`` and so on, over which ``write_workbook`` deals a long table, follow ``name``, one a task. Tasks open
    mounted files in their place and read a sheet in pieces; of other file systems each task gets its file whole."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    mounted = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri().getScheme() == "file"
    files = spark.read.format("binaryFile").load(path).select("path", *([] if mounted else ["content"]))

    def part(place: int):
        """The rows of the sheet, or of the one that continues it in the given place; a file without that one has none."""

        def rows(batches):
            for book in _books(batches):
                titles = [sheet, *_continuations(book, sheet)] if continued else [sheet]
                cells = islice(_cells(book, titles[place]), 1, None) if place < len(titles) else iter(())
                while held := list(islice(cells, BATCH_ROWS)):
                    yield _batch(held, "cells")

        return files.mapInArrow(rows, "cells array<string>")

    def head(batches):
        yield _batch([next(_cells(book, sheet), []) for book in _books(batches)], "cells")

    def sheets(batches):
        yield _batch([1 + len(_continuations(book, sheet)) for book in _books(batches)], "n")

    first = files.orderBy("path").limit(1).mapInArrow(head, "cells array<string>").first()
    names = clean_columns(first["cells"]) if first else []
    most = (files.mapInArrow(sheets, "n int").agg(F.max("n")).first()[0] or 1) if continued else 1
    cells = part(0)
    for place in range(1, most):
        cells = cells.union(part(place))
    return normalise_types(cells.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)]))


#: Words by which a statement could change a server.
_WRITING = r"(?i)\b(insert|update|delete|merge|upsert|replace\s+into|drop|alter|create|truncate|grant|revoke|call|exec|execute|into|copy|vacuum|attach|pragma|lock|set)\b"


def read_only(sql: str) -> str:
    """The statement, if it is one SELECT or WITH and holds no word that writes outside of quotes and comments."""
    bare = re.sub(r"/\*.*?\*/", " ", re.sub(r"--[^\n]*", " ", re.sub(r"'(?:[^']|'')*'", "''", sql)), flags=re.S).strip().rstrip(";").strip()
    unquoted = re.sub(r'"[^"]*"|`[^`]*`|\[[^\]]*\]', '""', bare)
    if not re.match(r"(?i)(select|with)\b", bare) or ";" in unquoted or re.search(_WRITING, unquoted):
        raise ValueError("one SELECT or WITH query that only reads is allowed")
    return sql.strip().rstrip(";").strip()


def _limited(url: str, sql: str, limit: int | None) -> str:
    """The statement with its limit, for the server to apply."""
    if limit is None:
        return sql
    if url.startswith(("jdbc:sqlserver", "jdbc:jtds")):
        return f"SELECT TOP {int(limit)} * FROM ({sql}) q0"
    if url.startswith(("jdbc:oracle", "jdbc:derby", "jdbc:db2")):
        return f"SELECT * FROM ({sql}) q0 FETCH FIRST {int(limit)} ROWS ONLY"
    return f"SELECT * FROM ({sql}) q0 LIMIT {int(limit)}"


def read_jdbc(spark: SparkSession, url: str, sql: str, partition: tuple[str, int, int, int] | None = None, fetch: int = 10_000, limit: int | None = None, **options: str) -> DataFrame:
    """A read-only query as a subquery of the server, which applies ``limit``; ``partition`` is (column, lower, upper, number)."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=f"({_limited(url, read_only(sql), limit)}) q", fetchsize=fetch, **options)
    if partition:
        column, lower, upper, number = partition
        reader = reader.options(partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=number)
    return reader.load()


def jdbc_tables(spark: SparkSession, url: str, **options: str) -> DataFrame:
    """``schema`` and ``name`` of the server's tables and views, from its own catalogue."""
    if url.startswith("jdbc:derby"):
        sql = "SELECT s.SCHEMANAME AS \"schema\", t.TABLENAME AS \"name\" FROM SYS.SYSTABLES t JOIN SYS.SYSSCHEMAS s ON s.SCHEMAID = t.SCHEMAID WHERE t.TABLETYPE IN ('T', 'V')"
    elif url.startswith("jdbc:sqlite"):
        sql = "SELECT 'main' AS schema, name FROM sqlite_master WHERE type IN ('table', 'view')"
    elif url.startswith("jdbc:oracle"):
        sql = "SELECT owner AS \"schema\", table_name AS \"name\" FROM all_tables"
    else:
        sql = "SELECT table_schema AS \"schema\", table_name AS \"name\" FROM information_schema.tables WHERE table_schema NOT IN ('information_schema', 'pg_catalog')"
    return read_jdbc(spark, url, sql, **options).toDF("schema", "name").orderBy("schema", "name")


def jdbc_works(spark: SparkSession, url: str, **options: str) -> str | None:
    """None if a trivial query succeeds, else what the server says."""
    sql = "SELECT 1 AS one FROM SYSIBM.SYSDUMMY1" if url.startswith(("jdbc:derby", "jdbc:db2")) else "SELECT 1 AS one FROM dual" if url.startswith("jdbc:oracle") else "SELECT 1 AS one"
    try:
        read_jdbc(spark, url, sql, **options).first()
    except Exception as e:
        return str(e).strip().splitlines()[0][:300]
    return None


def union_blocks(blocks: list[DataFrame], by_name: bool = True) -> DataFrame:
    """Blocks of one dataset: by name (missing columns null), or renamed by position to the first block's names."""
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b, allowMissingColumns=True) if by_name else out.union(b.toDF(*out.columns))
    return out


def load_sample(df: DataFrame, columns: list[str] | None = None, limit: int | None = None, key: list[str] | None = None, seed: int = 7) -> DataFrame:
    """The asked columns; with a ``limit``, a seeded sample of about so many rows (exactly so many if a ``key`` is given)."""
    from ..operators.ranking import sample_rows

    chosen = df if columns is None else df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*columns, *(key or [])])])
    if limit is None:
        return chosen
    if key:
        return sample_rows(chosen, limit, key, seed)
    rows = chosen.count()
    return chosen if rows <= limit else chosen.sample(False, limit / rows, seed)


def page(df: DataFrame, order: list[str], limit: int = 100, offset: int = 0) -> DataFrame:
    """One page in a stated order: without one, pages would overlap."""
    return df.orderBy(*order).offset(offset).limit(limit)


def describe(df: DataFrame) -> DataFrame:
    from ..functions.values import kind_of

    rows = [(i, f.name, f.dataType.simpleString(), kind_of(f.dataType)) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, T.StructType().add("position", "integer").add("name", "string").add("type", "string").add("kind", "string"))
