"""Word lists, patterns and limits that decide what counts as a notice.

Fixed values: results are only comparable when these are exactly as given, so
they are stated plainly here. Every operator takes them as default arguments
and can be given other words.
"""

from __future__ import annotations

from dataclasses import dataclass

# Header and page indicators, in order. Tables are tested with the first ten.
NOTICE_INDICATORS = (
    "request for proposal", "request for quotation", "request for information",
    "rfp", "rfq", "rfi", "rfo", "bid opportunity", "procurement notice",
    "solicitation", "tender", "invitation to bid", "itb", "invitation for bids",
    "competitive bidding", "contract opportunity", "vendor opportunity",
)
TABLE_INDICATORS = NOTICE_INDICATORS[:10]

# Words looked for in the class or id of a container.
CONTAINER_WORDS = ("rfp", "bid", "tender", "procurement", "opportunity")

# Words looked for in the text or address of a link.
LINK_WORDS = (
    "rfp", "rfq", "rfi", "rfo", "bid", "proposal", "procurement",
    "solicitation", "tender", "opportunity", "contract", "award",
)

# Words looked for in table rows and list items.
ROW_WORDS = ("rfp", "rfq", "bid", "proposal", "solicitation")

# Date labels; the first one found in the surrounding text wins.
DATE_LABELS = (
    "deadline", "due date", "submission date", "closing date",
    "issue date", "release date", "posted", "expires", "until",
)

CLOSED_WORDS = (
    "closed", "archived", "awarded", "completed", "expired",
    "cancelled", "canceled", "withdrawn",
)
OPEN_WORDS = ("open", "active", "current", "accepting", "now accepting")

# Patterns. (?U) gives \d, \s and \b their Unicode meaning.
MONTH_DATE = (
    r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}"
)
# The look at one letter first spares most places the word boundary and twelve names.
_MONTH_LETTER = r"(?=[JFMASOND])"
PLAIN_DATES = (
    r"(?iU)\d{1,2}/\d{1,2}/\d{2,4}",
    r"(?iU)\d{4}-\d{2}-\d{2}",
    r"(?iU)" + _MONTH_LETTER + r"\b" + MONTH_DATE,
)
CONTEXT_DATES = (
    r"(?iU)\d{1,2}[-/]\d{1,2}[-/]\d{2,4}",
    r"(?iU)\d{4}-\d{2}-\d{2}",
    r"(?iU)" + _MONTH_LETTER + MONTH_DATE,
)
ID_PREFIXES = ("RFP", "RFQ", "Solicitation", "Project", "Bid")
DOCUMENT_ID_PREFIXES = ID_PREFIXES[:4]
ID_TAIL = r"[#\s:-]*([A-Z0-9-]+)"
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"(?U)\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"

# Limits.
TITLE_CHARS = 200
DESCRIPTION_CHARS = 500
CONTEXT_CHARS = 50
MARKDOWN_SUMMARY_CHARS = 300
LISTING_TITLE_CHARS = 100
LISTING_DATES = 3
DOCUMENT_ID_CHARS = 2000
DOCUMENT_DATES_PER_PATTERN = 10
FALLBACK_LINKS = 10
DEFAULT_MAX_DOCUMENTS = 5
DEFAULT_MAX_DOCUMENTS_STRICT = 10

DEFAULT_DOCUMENT_TITLE = "PDF RFP Document"


@dataclass(frozen=True)
class Words:
    """The words, limits and switches of a run; None is no limit.

    ``whole_words``: every word of a list counts as a whole word only, so ``forbidden`` does not
    hold ``bid``. ``strict_dates``: whole dates only, so an ISO date is found once.
    """

    indicator: tuple[str, ...] = NOTICE_INDICATORS
    table: tuple[str, ...] = TABLE_INDICATORS
    container: tuple[str, ...] = CONTAINER_WORDS
    link: tuple[str, ...] = LINK_WORDS
    row: tuple[str, ...] = ROW_WORDS
    date_label: tuple[str, ...] = DATE_LABELS
    closed: tuple[str, ...] = CLOSED_WORDS
    open: tuple[str, ...] = OPEN_WORDS
    id_prefix: tuple[str, ...] = ID_PREFIXES
    fallback_links: int | None = FALLBACK_LINKS
    description_chars: int | None = DESCRIPTION_CHARS
    title_chars: int | None = TITLE_CHARS
    document_id_prefix: tuple[str, ...] = DOCUMENT_ID_PREFIXES
    document_id_chars: int | None = DOCUMENT_ID_CHARS
    document_dates: int | None = DOCUMENT_DATES_PER_PATTERN
    document_description_chars: int | None = DESCRIPTION_CHARS
    document_title_chars: int | None = TITLE_CHARS
    max_documents: int = DEFAULT_MAX_DOCUMENTS
    max_documents_strict: int = DEFAULT_MAX_DOCUMENTS_STRICT
    whole_words: bool = False
    strict_dates: bool = False


DEFAULT_WORDS = Words()
