"""A report as a workbook; the data goes through row by row."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from tallyward.operators.checks import ROW
from tallyward.plans.flags import plain
from tallyward.report.model import Report
from tallyward.sources.xlsx import Writer


def _widths(headers: list[str], wide: tuple[str, ...] = ()) -> list[float]:
    return [60 if h in wide or h.endswith("__review") else min(40, max(10, len(h) + 2)) for h in headers]


def _shown(v: object) -> object:
    v = plain(v)
    return v if v is None or isinstance(v, (str, int, float, bool)) else str(v)


def write_workbook(path: str, report: Report, data: DataFrame) -> None:
    """Sheets: Data, Missing Variables, Dataset Findings, Repeat Offenders, Run Info."""
    sheet = report.data
    book = Writer(path)

    def rows() -> Iterator[list[tuple[object, str]]]:
        yield [(h, f"head-{fill}" if fill else "head") for h, _, _, fill in sheet.columns]
        ordered = data.filter(f"{ROW} < {sheet.row_limit}").orderBy(ROW)
        for r in ordered.toLocalIterator():
            cells = sheet.cells.get(r[ROW], {})
            out: list[tuple[object, str]] = []
            for _, kind, source, _ in sheet.columns:
                if kind == "row-review":
                    out.append((sheet.row_reviews.get(r[ROW], ""), ""))
                elif kind == "source":
                    out.append((_shown(r[source]), cells[source][1] if source in cells else ""))
                else:
                    out.append((cells[source][0] if source in cells else "", ""))
            yield out
        if sheet.note:
            yield [(sheet.note, "")]

    def table(headers: list[str], body: list[tuple], note: str | None = None) -> Iterator[list[tuple[object, str]]]:
        yield [(h, "head") for h in headers]
        for r in body:
            fill = next((x for x in r if x in ("error", "warning", "info")), "") if "severity" in headers else ""
            yield [(v, fill if h == "severity" else "") for h, v in zip(headers, r)]
        if note:
            yield [(note, "")]

    book.sheet("Data", _widths([h for h, _, _, _ in sheet.columns]), rows())
    missing = ["variable", "title", "description", "group", "required"]
    book.sheet("Missing Variables", _widths(missing, ("description",)), table(missing, [(*r[:4], "yes" if r[4] else "no") for r in report.missing], report.missing_note))
    findings = ["rule_id", "source", "severity", "scope", "column", "message", "count"]
    book.sheet("Dataset Findings", _widths(findings, ("message",)), table(findings, report.findings))
    offenders = ["rule_id", "source", "severity", "targets", "count", "% rows", "comment"]
    book.sheet("Repeat Offenders", _widths(offenders, ("comment",)), table(offenders, report.offenders))
    book.sheet("Run Info", [24, 80], ([(a, "head" if b == "" and a else ""), (b, "")] for a, b in report.info), header=False)
    book.close()
