"""One call from registry to reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from noticeloom.functions.vocab import DEFAULT_WORDS, Words
from noticeloom.plans.opportunities import opportunities_from, page_parts, run_metrics
from noticeloom.session import write_out
from noticeloom.sources import registry as REG, sinks

_SAVE = {"json": sinks.save_json, "markdown": sinks.save_markdown, "summary": sinks.save_summary}


def run(
    registry: DataFrame,
    pages: DataFrame,
    documents: DataFrame,
    now: datetime,
    folder: str | None = None,
    formats: str = "all",
    utility_id: str | None = None,
    words: Words = DEFAULT_WORDS,
) -> tuple[DataFrame, dict[str, str], DataFrame]:
    """Opportunities of all active entries, or of one utility whether active or not.

    Also the reports written and, for each entry, whether its page was collected and parsed and
    what it gave. Reports go to ``folder``; without one nothing but the result is produced. An
    unknown ``utility_id`` is an error. ``words`` are the words, limits and switches of the run.
    """
    if utility_id is not None:
        registry = REG.by_id(registry, utility_id)
        if registry.isEmpty():
            raise LookupError(f"utility {utility_id} is not in the registry")
    active_only = utility_id is None
    parts = page_parts(registry, pages, active_only, words, documents=("any",))
    found = opportunities_from(parts, registry, documents, now.isoformat(), active_only, words)
    found = write_out(found, "opportunities")
    metrics = run_metrics(parts, registry, active_only)
    if folder is None or found.isEmpty():
        return found, {}, metrics
    wanted = tuple(_SAVE) if formats == "all" else (formats,)
    return found, {name: _SAVE[name](found, folder, now) for name in wanted}, metrics
