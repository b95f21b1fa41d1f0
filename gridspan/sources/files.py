"""Readers and writers: CSV by the export rules, Markdown tables, workbook packages, versioned descriptors."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from io import BytesIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "path string, sheet string, r int, c int, kind string, value string, formula string"
#: Fixed names of the workbook package format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Uncompressed bytes of one part that a task agrees to unpack.
MOST_PART = 1 << 30


def write_csv(df: DataFrame, path: str) -> None:
    """Comma-separated values with a header, CRLF lines, quotes doubled; an LF within a value is written as CRLF too, and read as LF."""
    df.write.option("header", True).option("quote", '"').option("escape", '"').option("lineSep", "\r\n").option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """Comma-separated values of a known schema.

    Quoted line ends keep a file in one task; where no value holds any, `multi_line` False lets large files be split.
    """
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", multi_line).csv(path)


def to_csv_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """One column `line` of RFC 4180 records, without line ends."""
    quoted = [F.when(F.col(c).cast("string").rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    line = quoted[0]
    for q in quoted[1:]:
        line = F.concat(line, F.lit(","), q)
    return df.select(line.alias("line"))


def markdown_tables(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table, r, c, value) of the pipe tables in a text column; row 0 is the header.

    A table is a run of lines that start with a pipe and whose second line is a rule of dashes.
    """
    lines = docs.select(F.col(key).alias("key"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\r?\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    rule = r"^\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?$"
    from pyspark.sql import Window

    by_line = Window.partitionBy("key").orderBy("n")
    marked = lines.filter(F.col("line").startswith("|")).withColumn("gap", F.coalesce(F.col("n") - F.lag("n").over(by_line) != 1, F.lit(True)))
    grouped = marked.withColumn("table", F.sum(F.col("gap").cast("int")).over(by_line) - 1).withColumn("row", F.row_number().over(Window.partitionBy("key", "table").orderBy("n")) - 1)
    ruled = grouped.filter((F.col("row") == 1) & F.col("line").rlike(rule)).select("key", "table")
    body = grouped.join(ruled, ["key", "table"]).filter("row <> 1").withColumn("r", F.when(F.col("row") == 0, 0).otherwise(F.col("row") - 1))
    inner = F.regexp_replace(F.regexp_replace("line", r"^\|", ""), r"(?<!\\)\|$", "")
    return body.select("key", "table", "r", F.posexplode(F.split(inner, r"(?<!\\)\|")).alias("c", "value")).withColumn("value", F.replace(F.trim("value"), F.lit("\\|"), F.lit("|")))


def _place(ref: str) -> tuple[int, int]:
    letters, digits = re.fullmatch(r"([A-Z]+)([0-9]+)", ref).groups()
    n = 0
    for x in letters:
        n = n * 26 + ord(x) - 64
    return int(digits) - 1, n - 1


def _cells_of(data: bytes) -> Iterator[tuple[str, int, int, str, str | None, str | None]]:
    """Cells of a workbook package: sheets in order, rows streamed."""
    with zipfile.ZipFile(BytesIO(data)) as package:
        if any(i.file_size > MOST_PART for i in package.infolist()):
            raise ValueError("a part of the package is too large")
        names = set(package.namelist())
        strings = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(package.read("xl/sharedStrings.xml")):
                strings.append("".join(t.text or "" for t in item.iter(f"{MAIN}t")))
        targets = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(package.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(package.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
            target = targets[sheet.get(RELATION)].lstrip("/")
            with package.open(target if target.startswith("xl/") else f"xl/{target}") as part:
                for _, cell in ElementTree.iterparse(part):
                    if cell.tag != f"{MAIN}c":
                        if cell.tag == f"{MAIN}row":
                            cell.clear()
                        continue
                    raw, formula = cell.find(f"{MAIN}v"), cell.find(f"{MAIN}f")
                    kind = {"s": "text", "str": "text", "inlineStr": "text", "b": "bool", "e": "error"}.get(cell.get("t", "n"), "number")
                    value = raw.text if raw is not None else "".join(t.text or "" for t in cell.iter(f"{MAIN}t")) if cell.get("t") == "inlineStr" else None
                    if cell.get("t") == "s" and value is not None:
                        value = strings[int(value)]
                    elif kind == "bool" and value is not None:
                        value = "TRUE" if value == "1" else "FALSE"
                    yield (sheet.get("name"), *_place(cell.get("r")), kind if value is not None else "blank", value, formula.text if formula is not None else None)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """CELLS of all workbook packages under a path: a package is a task's unit, cells are streamed in batches."""
    names = [f.split()[0] for f in CELLS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for cell in _cells_of(data.as_py()):
                    rows.append((file, *cell))
                    if len(rows) == 50_000:
                        yield _batch(rows, names)
                        rows = []
                if rows:
                    yield _batch(rows, names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content").mapInArrow(run, CELLS)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def stale(cells: DataFrame) -> DataFrame:
    """Formula cells without a cached value: those that must be computed."""
    return cells.filter(F.col("formula").isNotNull() & (F.col("kind") == "blank"))


def used_range(cells: DataFrame) -> DataFrame:
    """(sheet, rows, columns) up to the last cell."""
    return cells.groupBy("sheet").agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("columns"))


def window(cells: DataFrame, sheet: str, r0: int, c0: int, r1: int, c1: int) -> DataFrame:
    """The cells of a rectangle."""
    return cells.filter((F.col("sheet") == sheet) & F.col("r").between(r0, r1) & F.col("c").between(c0, c1))


def typed(cells: DataFrame, text: str = "value") -> DataFrame:
    """Cells with kind and lanes by what their text shows: blank, TRUE/FALSE, a leading apostrophe for text, a number, else text."""
    c = F.col(text)
    quoted = c.startswith("'")
    n = F.when(~quoted & c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), c.try_cast("double"))
    flag = F.upper(c).isin("TRUE", "FALSE")
    kind = F.when(c.isNull() | (c == ""), "blank").when(flag, "bool").when(n.isNotNull(), "number").otherwise("text")
    return cells.withColumns({"kind": kind, "num": n, "bool": F.when(flag, F.upper(c) == "TRUE"), "txt": F.when(kind == "text", F.when(quoted, F.substr(c, F.lit(2))).otherwise(c))})
