"""Versioned Parquet tables: a write makes a new version, a pointer names the current one (SNK-01..04, SNK-08..10, SNK-12, SNK-14)."""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
from collections.abc import Callable, Sequence
from xml.sax.saxutils import escape

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.scans import laid_out, running
from ledgerloom.schema import difference, evolved


class VersionedTable:
    """All or nothing: readers see the version that the newest pointer names, which is made after its files are complete. Pointers are
    numbered and never overwritten: of two writers that started from one version, one gets the next number and the other does its change
    again on top of it. Works on any file system that Spark reaches and that creates files exclusively."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self, kind: str = "_versions") -> list[tuple[int, str]]:
        """Numbers and versions; a pointer that is still being written does not count."""
        fs, folder = self._fs(f"{self.root}/{kind}")
        if not fs.exists(folder):
            return []
        out = []
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            if name.isdigit() and (n := status.getLen()):
                stream = fs.open(status.getPath())
                try:
                    out.append((int(name), bytes(stream.readNBytes(int(n))).decode()))
                finally:
                    stream.close()
        return sorted(out)

    def current(self) -> str | None:
        versions = self._versions()
        return versions[-1][1] if versions else None

    def read(self, schema=None) -> DataFrame:
        version = self.current()
        if version is None:
            return self.spark.createDataFrame([], schema)
        return self._evolved(self.spark.read.parquet(f"{self.root}/{version}"))

    def declared(self) -> dict | None:
        """The newest declared schema: columns and the defaults of those added."""
        found = self._versions("_schemas")
        return json.loads(found[-1][1]) if found else None

    def _evolved(self, df: DataFrame) -> DataFrame:
        own = self.declared()
        return evolved(df, own["columns"], own["defaults"]) if own else df

    def declare(self, columns: str, defaults: dict | None = None, tries: int = 20) -> list[str]:
        """SNK-05: from now on the table has these columns (DDL): added ones are read as their default (else NULL) from files that lack them, and are
        written by the next change; columns that are not declared stay; types may only widen. Nothing is rewritten, and what is
        declared already changes nothing. The names of what was added."""
        for _ in range(tries):
            found = self._versions("_schemas")
            own = json.loads(found[-1][1]) if found else {"columns": "", "defaults": {}}
            now = self.read("_none int") if self.current() else None
            changes = difference(now.schema if now is not None else None, columns)
            if found and not changes["added"] and not changes["widened"]:
                return []
            both = own["defaults"] | (defaults or {})
            fs, folder = self._fs(f"{self.root}/_schemas")
            fs.mkdirs(folder)
            if self._publish(found[-1][0] + 1 if found else 0, json.dumps({"columns": columns, "defaults": both}), "_schemas"):
                return changes["added"]
        raise RuntimeError(f"{self.root}: other writers were first {tries} times")

    def _publish(self, number: int, version: str, kind: str = "_versions") -> bool:
        """Whether the pointer of this number is ours."""
        fs, pointer = self._fs(f"{self.root}/{kind}/{number:08d}")
        try:
            out = fs.create(pointer, False)
        except Py4JJavaError as e:
            if "Exist" in e.java_exception.getClass().getName():
                return False
            raise
        out.write(version.encode())
        out.close()
        return True

    def change(self, make: Callable[[DataFrame | None], DataFrame | None], tries: int = 20) -> None:
        """``make`` gets the current rows (None without a version) and gives the new ones (None: no change); again if another writer was first."""
        fs, folder = self._fs(f"{self.root}/_versions")
        for _ in range(tries):
            versions = self._versions()
            number, version = (versions[-1][0] + 1 if versions else 0), f"v-{uuid.uuid4().hex}"
            df = make(self._evolved(self.spark.read.parquet(f"{self.root}/{versions[-1][1]}")) if versions else None)
            if df is None:
                return
            df.write.parquet(f"{self.root}/{version}")
            fs.mkdirs(folder)
            if self._publish(number, version):
                return
            fs.delete(self._fs(f"{self.root}/{version}")[1], True)
        raise RuntimeError(f"{self.root}: other writers were first {tries} times")

    def replace(self, df: DataFrame) -> None:
        """SNK-04: a new version; only the last step, the creation of one pointer, makes it current."""
        self.change(lambda now: df)

    def append(self, rows: DataFrame) -> None:
        """SNK-01, SNK-09."""
        self.change(lambda now: rows if now is None else now.unionByName(rows, allowMissingColumns=True))

    def append_numbered(self, rows: DataFrame, order: Sequence[str], id_column: str = "id") -> None:
        """SNK-09: rows get ids that go on from the table's highest, in ``order``: numbered by range partitions, so no
        task holds all rows."""
        own = running(laid_out(rows.drop(id_column), [], order), [], {id_column: ("count", None)}).drop("part", "place")
        numbered = own.select(*rows.columns, *([id_column] if id_column not in rows.columns else []))

        def make(now: DataFrame | None) -> DataFrame:
            if now is None:
                return numbered
            top = now.agg(F.coalesce(F.max(id_column), F.lit(0))).first()[0]
            return now.unionByName(numbered.withColumn(id_column, F.col(id_column) + top), allowMissingColumns=True)

        self.change(make)

    def upsert(self, rows: DataFrame, key: Sequence[str]) -> None:
        """SNK-02, SNK-08: rows replace those of their key whole."""
        self.change(lambda now: rows if now is None else now.join(rows.select(*key), list(key), "left_anti").unionByName(rows, allowMissingColumns=True))

    def insert_new(self, rows: DataFrame, key: Sequence[str]) -> None:
        """SNK-10, SNK-12, SNK-14: rows whose key is new; those there are not refreshed."""
        self.change(lambda now: rows if now is None else now.unionByName(rows.join(now.select(*key), list(key), "left_anti"), allowMissingColumns=True))

    def vacuum(self, keep: int = 2) -> int:
        """Removes all but the newest versions (readers of older ones must be done); how many."""
        fs, _ = self._fs(self.root)
        old = self._versions()[: -max(1, keep)]
        for number, version in old:
            fs.delete(self._fs(f"{self.root}/_versions/{number:08d}")[1], False)
            fs.delete(self._fs(f"{self.root}/{version}")[1], True)
        return len(old)

    def delete(self, keys: DataFrame | None = None, /, **values: Sequence) -> int:
        """SNK-03: rows whose columns named in ``keys`` (any number of rows; nulls match nothing) or, with few values, in ``values``
        all have one of the values; how many."""
        if keys is not None and values:
            raise ValueError("give keys or values, not both")
        gone = F.lit(True)
        for column, allowed in values.items():
            gone = gone & F.coalesce(F.col(column).isin(*allowed), F.lit(False))
        n = 0

        def make(now: DataFrame | None) -> DataFrame | None:
            nonlocal n
            if now is None:
                return None
            hit = now.join(keys, list(keys.columns), "left_semi") if keys is not None else now.where(gone)
            n = hit.count()
            if not n:
                return None
            return now.join(keys, list(keys.columns), "left_anti").select(*now.columns) if keys is not None else now.where(~gone)

        self.change(make)
        return n


def markdown_table(rows: DataFrame, most: int = 10_000) -> str:
    """SNK-06, SNK-13: a report's rows as a Markdown table; more than ``most`` are no report but an error."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report has at most {most} rows")
    if not found:
        return "No rows.\n"
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in found]) + "\n"


def workbook(rows: Sequence, title: str = "Sheet1") -> bytes:
    """SNK-07: an .xlsx file of one sheet from a list of objects (their first one's keys are the header) or of lists. Numbers stay numbers."""
    if not rows or not isinstance(rows[0], (dict, list, tuple)):
        raise ValueError("rows are a list of objects or of lists")
    if isinstance(rows[0], dict):
        header = list(rows[0])
        rows = [header, *([r.get(h) for h in header] for r in rows if isinstance(r, dict))]

    def cell(place: str, x) -> str:
        if x is None:
            return ""
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return f'<c r="{place}"><v>{x}</v></c>'
        text = json.dumps(x, ensure_ascii=False) if isinstance(x, (dict, list, tuple)) else str(x)
        text = "".join(c for c in text if c >= " " or c in "\t\n\r")
        return f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    def column(i: int) -> str:
        return (column(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)

    body = "".join(f'<row r="{r}">{"".join(cell(f"{column(c)}{r}", x) for c, x in enumerate(row))}</row>' for r, row in enumerate(rows, 1))
    office, package = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    name = escape((re.sub(r"[\[\]:*?/\\\\]", " ", title) or "Sheet1")[:31], {'"': "&quot;"})
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="{name}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path, text in parts.items():
            z.writestr(path, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()


def upsert_vectors(table: VersionedTable, rows: DataFrame, metadata: Sequence[str] = ()) -> None:
    """SNK-11: vectors (vec_id, embedding) of length one with what they have of the metadata as JSON, by id; null and zero vectors are left out, of
    several with one id the largest stays."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = F.transform("embedding", lambda x: (x / F.col("_norm")).cast("float"))
    own = rows.withColumn("_norm", norm).where("_norm > 0").select("vec_id", unit.alias("embedding"), F.to_json(F.struct(*metadata) if metadata else F.create_map()).alias("metadata"))
    row = F.struct("embedding", "metadata")
    table.upsert(own.groupBy("vec_id").agg(F.max(row).alias("_row")).select("vec_id", "_row.*"), ["vec_id"])
