"""Tables, labels and named inputs of HTML pages as rows. The tags are read with the standard library in Arrow batches; what
the rows mean is decided in DataFrame operations."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseframe.functions.text import squeeze

PARTS = "part string, tbl int, row int, cell int, name string, value string"


#: What an ampersand may begin, and a character that no text holds, for those that begin no whole reference.
_REFERENCE, _PLAIN = re.compile("&(#[0-9]+;|#[xX][0-9A-Fa-f]+;|[A-Za-z][0-9A-Za-z]*;)?"), "\ufdd0"


def _whole_references(html: str) -> str:
    """Ampersands marked that don't begin a reference known and closed by a semicolon: they stand for themselves, whereas the parser
    would take the first letters of `&amp` or `&notes` as a reference."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else _PLAIN + m[0][1:], html)


class _Parts(HTMLParser):
    """(part, table, row, cell, name, value) in the order of the page: title, headings, links, cells, inputs."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple] = []
        self.tables, self.stack = -1, []  # open tables as [number, row, cell]
        self.text: list[tuple[str, list[str], tuple]] = []  # parts whose text is open

    def _at(self) -> tuple[int | None, int | None, int | None]:
        return tuple(self.stack[-1]) if self.stack else (None, None, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: (v or "").replace(_PLAIN, "&") for k, v in attrs}
        if tag == "table":
            self.tables += 1
            self.stack.append([self.tables, -1, -1])
        elif tag == "tr" and self.stack:
            self.stack[-1][1:] = [self.stack[-1][1] + 1, -1]
        elif tag in ("td", "th") and self.stack:
            self.stack[-1][2] += 1
            self.text.append((tag, [], (tag, *self._at(), "")))
        elif tag in ("title", "h1", "h2", "h3"):
            self.text.append((tag, [], (tag, None, None, None, "")))
        elif tag == "a":
            self.out.append(("link", *self._at(), a.get("href", ""), a.get("title", "")))
        elif tag == "input" and (a.get("name") or a.get("id")):
            checked = a.get("type") not in ("radio", "checkbox") or "checked" in a
            if checked:
                self.out.append(("input", *self._at(), a.get("name") or a.get("id"), a.get("value", "")))
        elif tag == "br":
            self.handle_data("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.stack:
            self.stack.pop()
        for i in range(len(self.text) - 1, -1, -1):
            if self.text[i][0] == tag:
                part, words, at = self.text.pop(i)
                self.out.append((*at, "".join(words)))
                break

    def handle_data(self, data: str) -> None:
        if self.text:
            self.text[-1][1].append(data.replace(_PLAIN, "&"))


def _parts(html: str) -> list[tuple]:
    parser = _Parts()
    parser.feed(_whole_references(html or ""))
    parser.close()
    return parser.out


def page_parts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, pos and the parts of each page."""
    kind = pages.schema[key].dataType.simpleString()

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, i, *p) for k, h in zip(frame[key], frame[html], strict=True) for i, p in enumerate(_parts(h))]
            out = pd.DataFrame(rows, columns=[key, "pos", "part", "tbl", "row", "cell", "name", "value"])
            yield out.astype({"tbl": "Int32", "row": "Int32", "cell": "Int32", "pos": "int32"})

    return pages.select(key, html).mapInPandas(read, f"{key} {kind}, pos int, {PARTS}").withColumn("value", squeeze("value"))


def table_rows(parts: DataFrame, key: str) -> DataFrame:
    """key, tbl, row and cells (texts in order) of every table row."""
    cells = parts.where(F.col("part").isin("td", "th") & F.col("row").isNotNull())
    return cells.groupBy(key, "tbl", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "value"))), lambda c: c["value"]).alias("cells"))


def header_records(parts: DataFrame, key: str, wanted: tuple[str, ...]) -> DataFrame:
    """key, tbl, row and a map from header to cell, of tables whose first row has all wanted headers; rows of another length go."""
    rows = table_rows(parts, key)
    heads = rows.where("row = 0").select(key, "tbl", F.col("cells").alias("head")).where(F.forall(F.array(*map(F.lit, wanted)), lambda w: F.array_contains("head", w)))
    body = rows.where("row > 0").join(heads, [key, "tbl"]).where(F.size("cells") == F.size("head"))
    return body.select(key, "tbl", "row", F.map_from_entries(F.filter(F.arrays_zip("head", "cells"), lambda e: e["head"] != "")).alias("record"))


def label_values(parts: DataFrame, key: str, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """key, name and value of two-cell rows (label, value); of several values of a label the first that is not empty. Only
    allowed labels leave this function, if a list is given."""
    rows = table_rows(parts, key).where(F.size("cells") == 2).select(key, F.rtrim(F.col("cells")[0], F.lit(": ")).alias("name"), F.col("cells")[1].alias("value"), F.struct("tbl", "row").alias("at"))
    rows = rows.where(F.col("name").isin(*allowed)) if allowed is not None else rows
    return rows.where("value <> ''").groupBy(key, "name").agg(F.min_by("value", "at").alias("value"))


def group_fields(parts: DataFrame, key: str, allowed: tuple[str, ...]) -> DataFrame:
    """key, grp and a map of fields from three-cell rows (group, field, value), allowed fields only, first values that are not
    empty."""
    rows = table_rows(parts, key).where(F.size("cells") == 3)
    rows = rows.select(key, F.col("cells")[0].alias("grp"), F.col("cells")[1].alias("name"), F.col("cells")[2].alias("value"), F.struct("tbl", "row").alias("at"))
    first = rows.where(F.col("name").isin(*allowed) & (F.col("value") != "")).groupBy(key, "grp", "name").agg(F.min_by("value", "at").alias("value"))
    return first.groupBy(key, "grp").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("fields"))


def inputs(parts: DataFrame, key: str, allowed: tuple[str, ...]) -> DataFrame:
    """key and a map of named inputs, allowed names only, the last value of a name."""
    last = parts.where((F.col("part") == "input") & F.col("name").isin(*allowed)).groupBy(key, "name").agg(F.max_by("value", "pos").alias("value"))
    return last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("inputs"))
