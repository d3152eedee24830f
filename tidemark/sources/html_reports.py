"""Rendered report tables to rows. The only scan that needs Python workers: HTML has no
built-in reader. All later logic runs on the rows it returns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "report_id string, row_idx int, label string, cells array<string>, periods array<date>, reason string"
_ARROW = pa.schema([("report_id", pa.string()), ("row_idx", pa.int32()), ("label", pa.string()), ("cells", pa.list_(pa.string())),
                    ("periods", pa.list_(pa.date32())), ("reason", pa.string())])
#: Header rows whose dates a task remembers: reports of one season share them.
KNOWN_HEADERS = 4096
# Bounds of HTML for spans.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


def _span(value: str | None, most: int) -> int:
    """A span attribute as browsers read it: leading digits, at least one."""
    digits = re.match(r"\s*([0-9]+)", value or "")
    return max(1, min(int(digits[1]), most)) if digits else 1


class _FirstTable(HTMLParser):
    """Cells of the first table as (is_header, text) rows; cells that span columns or rows are repeated.

    Tables inside a cell belong to nobody: their text is skipped and the outer table goes on after them.
    """

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[tuple[bool, str]]] = []
        self.found = False
        self._depth, self._text, self._spans = 0, None, (1, 1)
        self._header = self._done = False
        self._carried: dict[int, tuple[int, tuple[bool, str]]] = {}  # column: rows left, cell
        self._next: dict[int, tuple[int, tuple[bool, str]]] = {}

    def _fill(self) -> None:
        """Puts cells carried from rows above where the row has got to."""
        while len(self.rows[-1]) in self._carried:
            column = len(self.rows[-1])
            left, cell = self._carried.pop(column)
            self.rows[-1].append(cell)
            if left > 1:
                self._next[column] = (left - 1, cell)

    def _end_cell(self) -> None:
        if self._text is None:
            return
        self._fill()
        cell = (self._header, " ".join("".join(self._text).split()))
        columns, rows = self._spans
        for _ in range(columns):
            if rows > 1:
                self._next[len(self.rows[-1])] = (rows - 1, cell)
            self.rows[-1].append(cell)
        self._text = None

    def _end_row(self) -> None:
        self._end_cell()
        if self.rows and self._carried:
            self._fill()
            self._next |= self._carried
        self._carried = {}

    def handle_starttag(self, tag, attrs):
        if self._done:
            return
        if tag == "table":
            self._depth += 1
            self.found = True
        elif self._depth != 1:
            return
        elif tag == "tr":
            if self.rows:
                self._end_row()
                self._carried = self._next
            self._next = {}
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self._end_cell()
            given = dict(attrs)
            self._text, self._header = [], tag == "th"
            self._spans = _span(given.get("colspan"), MOST_COLUMNS), _span(given.get("rowspan"), MOST_ROWS)
        elif tag == "br" and self._text is not None:
            self._text.append(" ")

    def handle_data(self, data):
        if self._text is not None and self._depth == 1:
            self._text.append(data)

    def handle_endtag(self, tag):
        if self._done:
            return
        if tag == "table" and self._depth:
            self._depth -= 1
            if not self._depth:
                self.close_table()
        elif self._depth == 1 and tag in ("td", "th"):
            self._end_cell()

    def close_table(self) -> None:
        if self.rows and not self._done:
            self._end_row()
        self._done = True


def _dates(cells: list[str]) -> list:
    parsed = pd.to_datetime(pd.Series(cells, dtype="object"), errors="coerce", format="mixed")
    return [None if pd.isna(p) else p.date() for p in parsed]


def parse_table(html: str | None, dates_of: Callable[[list[str]], list] = _dates) -> tuple[list, list[tuple[str, list[str]]], str | None]:
    """(period dates, [(label, cells)], reason) of the first table; leading header rows name periods.

    Periods stand over the cells from the left; cells without one (a footnote) have no period. `reason`
    says why there are no rows.
    """
    if not html:
        return [], [], "no document"
    parser = _FirstTable()
    parser.feed(html)
    parser.close()
    parser.close_table()
    rows = [r for r in parser.rows if r]
    if not rows:
        return [], [], "no rows" if parser.found else "no table"
    n = 0
    while n < len(rows) and all(head for head, _ in rows[n]):
        n += 1
    body = [[text for _, text in r] for r in rows[n:]]
    width = max((len(r) for r in body), default=1) - 1
    header = [text for _, text in rows[n - 1]] if n else []
    dates = dates_of(header)
    periods = dates if dates and dates[0] is not None else dates[1:]  # a first cell without a date is the title
    return (periods + [None] * width)[:width], [(r[0], r[1:]) for r in body], None if body else "no rows"


def report_rows(reports: DataFrame) -> DataFrame:
    """(report_id, row_idx, label, cells, periods) from (report_id, html); a document without rows has one
    row that gives the `reason` instead."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, list] = {}

        def dates_of(cells: list[str]) -> list:
            key = tuple(cells)
            if key not in known:
                if len(known) >= KNOWN_HEADERS:
                    known.clear()
                known[key] = _dates(cells)
            return known[key]

        for batch in batches:
            out = []
            for report_id, html in zip(batch["report_id"].to_pylist(), batch["html"].to_pylist()):
                periods, rows, reason = parse_table(html, dates_of)
                out += [(report_id, i, label, cells, periods, None) for i, (label, cells) in enumerate(rows)]
                if reason:
                    out.append((report_id, None, None, None, None, reason))
            columns = zip(*out) if out else [()] * len(_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    return reports.select("report_id", "html").mapInArrow(scan, SCHEMA)
