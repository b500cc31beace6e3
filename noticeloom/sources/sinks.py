"""Report files.

Each report is a folder of part files which, read in name order, are the document.
Nothing is written unless one of these is called with a folder. ``compression`` ("gzip") is that of the
part files; Spark reads them as they are, and one behind the other they are the document to ``zcat`` too.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from noticeloom.plans import reports
from noticeloom.session import write_out


def _stamp(now: datetime) -> str:
    return now.strftime("%Y%m%d_%H%M%S")


def _minute(now: datetime) -> str:
    return now.strftime("%Y-%m-%d %H:%M")


def write_lines(lines: DataFrame, path: str, compression: str | None = None) -> str:
    """Write lines that are in order as text: every task writes its stretch."""
    lines.select("line").write.text(path, compression=compression)
    return path


def save_json(opps: DataFrame, folder: str, now: datetime, name: str | None = None,
              compression: str | None = None) -> str:
    path = f"{folder}/{name or f'rfp_opportunities_{_stamp(now)}.json'}"
    return write_lines(reports.json_lines(opps, now.isoformat()), path, compression)


def save_markdown(opps: DataFrame, folder: str, now: datetime, name: str | None = None,
                  compression: str | None = None) -> str:
    path = f"{folder}/{name or f'rfp_report_{_stamp(now)}.md'}"
    return write_lines(reports.markdown_lines(opps, _minute(now)), path, compression)


def save_summary(opps: DataFrame, folder: str, now: datetime, name: str | None = None,
                 compression: str | None = None) -> str:
    path = f"{folder}/{name or f'rfp_summary_{_stamp(now)}.txt'}"
    return write_lines(reports.summary_lines(opps, _minute(now)), path, compression)


def save_records(opps: DataFrame, path: str) -> str:
    """Opportunities as JSON lines, one file set per region."""
    opps.write.partitionBy("region").json(path)
    return path


def save_all(opps: DataFrame, folder: str, now: datetime, compression: str | None = None) -> dict[str, str]:
    """All three reports of one moment; the opportunities are computed and numbered once."""
    opps = write_out(reports.with_places(opps), "opportunities")
    return {
        "json": save_json(opps, folder, now, compression=compression),
        "markdown": save_markdown(opps, folder, now, compression=compression),
        "summary": save_summary(opps, folder, now, compression=compression),
    }
