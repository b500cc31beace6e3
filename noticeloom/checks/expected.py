"""What the named queries must return, as SQL over the benchmark tables.

For everything that goes through html, the answer is worked out from ``orders``
directly, without ever seeing a page.
"""

from __future__ import annotations

import re

EXPECTED: dict[str, str] = {}

_TITLE = """
  CASE c % 5 WHEN 0 THEN 'Bid' WHEN 1 THEN 'Proposal' WHEN 2 THEN 'RFP'
             WHEN 3 THEN CASE WHEN k % 2 = 0 THEN 'RFQ' ELSE 'Solicitation' END
             ELSE 'Contract' END
  || '-' || (k % 7) || CASE WHEN k % 3 = 0 THEN '' ELSE ' ' || substr(pr, 3) END
"""
_PHRASE = """
  CASE k % 4 WHEN 0 THEN 'due date ' || strftime(d, '%-m/%-d/%Y')
             WHEN 1 THEN 'posted ' || strftime(d, '%Y-%m-%d')
             WHEN 2 THEN 'deadline ' || strftime(d, '%b %-d, %Y')
             ELSE 'no date' END
  || CASE st WHEN 'F' THEN ' closed' WHEN 'O' THEN ' open' ELSE ' listed' END
  || CASE k % 6 WHEN 0 THEN ' mail u' || c || '@example.com'
                WHEN 1 THEN ' call 555-123-' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0')
                ELSE '' END
  || CASE WHEN c % 5 = 1 THEN ' project ' || (k % 100) ELSE '' END
  || CASE WHEN k % 11 = 0 THEN ' until 12/31/' || year(d) ELSE '' END
"""
_PAGE_URL = ("'https://u' || c || '.example.com/notices/index.html' || "
             "CASE WHEN ch = 0 THEN '' ELSE '?page=' || ch END")

# Views, each with the ones it needs; a query gets only what it names.
_VIEWS = {
    "n0": """SELECT o_custkey AS c, o_orderkey AS k, o_orderstatus AS st, o_orderpriority AS pr,
        CAST(o_orderdate AS DATE) AS d, o_orderkey // 50000 AS ch FROM orders""",
    "n1": f"SELECT *, {_TITLE} AS title, {_PHRASE} AS phrase FROM n0",
    "n": f"""SELECT *, title || ' ' || phrase AS text, c * 4294967296 + ch AS entry,
        {_PAGE_URL} AS page, 'https://u' || c || '.example.com' AS host FROM n1""",
    "reg": """SELECT c_custkey AS c, 'u' || c_custkey AS id, c_name AS name, r_name AS type,
        n_name || ', ' || r_name AS region, c_acctbal > 0 AS active,
        CASE WHEN c_custkey % 6 = 5 THEN NULL ELSE c_custkey % 6 END AS mx
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    # plain dates of each notice: by pattern, then by place
    "plain": r"""SELECT k, c, d, unnest(ds) AS date, generate_subscripts(ds, 1) - 1 AS pos FROM (
        SELECT k, c, d, list_concat(list_concat(
          regexp_extract_all(text, '\d{1,2}/\d{1,2}/\d{2,4}'),
          regexp_extract_all(text, '\d{4}-\d{2}-\d{2}')),
          regexp_extract_all(text, '(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}')) AS ds
        FROM n)""",
    "pats": r"""SELECT * FROM (VALUES
        (1, '\d{1,2}[-/]\d{1,2}[-/]\d{2,4}'), (2, '\d{4}-\d{2}-\d{2}'),
        (3, '(?i)(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}')
        ) AS p(pno, pat)""",
    "texts": "SELECT k, text FROM n",
    # dates with context of any texts(k, text)
    "m0": """SELECT k, text, pno, regexp_extract_all(text, pat) AS ms,
        regexp_split_to_array(text, pat) AS gaps FROM texts, pats""",
    "m1": """SELECT k, text, pno, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM m0
        WHERE len(ms) > 0""",
    "m2": """SELECT k, text, pno, i, ms[i] AS date,
        CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) AS BIGINT)
        + coalesce(CAST(list_sum(list_transform(ms[1:i-1], lambda g: length(g))) AS BIGINT), 0) AS off
        FROM m1""",
    "m3": """SELECT k, pno, i, date, trim(substr(text, greatest(off - 50, 0) + 1,
        off + length(date) + 50 - greatest(off - 50, 0))) AS context FROM m2""",
    "ctx": """SELECT k, row_number() OVER (PARTITION BY k ORDER BY pno, i) - 1 AS pos, date, context,
        CASE WHEN contains(lower(context), 'deadline') THEN 'deadline'
             WHEN contains(lower(context), 'due date') THEN 'due date'
             WHEN contains(lower(context), 'posted') THEN 'posted'
             WHEN contains(lower(context), 'until') THEN 'until'
             ELSE 'unknown' END AS type FROM m3""",
    "dated": """SELECT k, string_agg(date, '|' ORDER BY pos) AS dates,
        string_agg(type, '|' ORDER BY pos) AS types FROM ctx GROUP BY k""",
    # notices as opportunities
    "opp": """SELECT n.k, n.c, entry, name AS utility, id AS utility_id, type AS utility_type, region,
        title, text AS description, 'https://n.example.com/' || n.k AS url,
        'https://' || id || '.example.com' AS source_page,
        row_number() OVER (PARTITION BY name ORDER BY entry, n.k) AS idx
        FROM n JOIN reg USING (c)""",
    "head": """SELECT utility, count(*) AS n, arg_min(region, (entry, k)) AS region,
        arg_min(utility_type, (entry, k)) AS utility_type,
        arg_min(source_page, (entry, k)) AS source_page FROM opp GROUP BY utility""",
    # documents behind the links of layout 3
    "docs": """SELECT n.*, host || '/docs/' || k || '.pdf' AS durl,
        'Terms for ' || title || chr(10) || phrase || chr(10) || phrase AS dtext,
        CASE k % 4 WHEN 0 THEN title || ' details specification' WHEN 1 THEN 'Untitled' END AS mtitle,
        CASE WHEN k % 4 < 3 THEN k % 9 END AS npages FROM n WHERE k % 5 <> 0""",
    "ddates": r"""SELECT k, coalesce(array_to_string(list_sort(list_distinct(list_concat(list_concat(
          regexp_extract_all(dtext, '\d{1,2}/\d{1,2}/\d{2,4}')[1:10],
          regexp_extract_all(dtext, '\d{4}-\d{2}-\d{2}')[1:10]),
          regexp_extract_all(dtext, '(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}')[1:10]))), '|'), '')
        AS dates FROM docs""",
    "ids": r"""SELECT k, coalesce(nullif(regexp_extract(text, '(?i)RFP[#\s:-]*([A-Z0-9-]+)'), ''),
        nullif(regexp_extract(text, '(?i)RFQ[#\s:-]*([A-Z0-9-]+)'), ''),
        nullif(regexp_extract(text, '(?i)Solicitation[#\s:-]*([A-Z0-9-]+)'), ''),
        nullif(regexp_extract(text, '(?i)Project[#\s:-]*([A-Z0-9-]+)'), ''),
        nullif(regexp_extract(text, '(?i)Bid[#\s:-]*([A-Z0-9-]+)'), '')) AS rfp_id FROM n""",
    # all links of a listing page, in order
    "anchors": """SELECT entry, c, k, 0 AS part, title AS text,
          host || '/notices/tender-' || k || '.html#' || k AS url FROM n WHERE c % 5 = 4
        UNION ALL SELECT entry, c, k, 0, 'view', host || '/notices/n/' || k || '.html' FROM n WHERE c % 5 = 0
        UNION ALL SELECT entry, c, k, 0, 'more', host || '/p/' || k FROM n WHERE c % 5 = 1
        UNION ALL SELECT entry, c, k, 0, 'details', host || '/notices/index.html?id=' || k FROM n WHERE c % 5 = 2
        UNION ALL SELECT entry, c, k, 0, 'Document ' || k, host || '/docs/' || k || '.pdf' FROM n WHERE c % 5 = 3
        UNION ALL SELECT entry, c, k, 1, 'apply', 'https://files.example.com/'
          || CASE WHEN k % 2 = 1 THEN 'pdf/' ELSE '' END || k FROM n WHERE c % 5 = 3""",
    "doclinks": """SELECT *, row_number() OVER (PARTITION BY entry ORDER BY k, part) AS link_no
        FROM anchors WHERE contains(url, 'pdf')""",
    "strictlinks": """SELECT *, row_number() OVER (PARTITION BY entry ORDER BY k, part) AS link_no
        FROM anchors WHERE url LIKE '%.pdf'""",
    # blocks of layouts 2 and 3
    "blocks": """SELECT n.*, 1 AS strategy, 'Notice ' || title AS btitle,
          'Notice ' || title || ' ' || phrase || ' See details' AS btext,
          host || '/notices/index.html?id=' || k AS link1, NULL AS link2 FROM n WHERE c % 5 = 2
        UNION ALL SELECT n.*, 2, title || ' details',
          title || ' details ' || phrase || ' Document ' || k || ' apply',
          host || '/docs/' || k || '.pdf', 'https://files.example.com/'
          || CASE WHEN k % 2 = 1 THEN 'pdf/' ELSE '' END || k FROM n WHERE c % 5 = 3""",
    # fallback parts of layouts 0, 1 and 4
    "parts": """SELECT entry, c, k, d, page, ptext, url, pdates FROM (
          SELECT entry, c, k, d, page, title || ' ' || phrase || ' view' AS ptext,
            host || '/notices/n/' || k || '.html' AS url, TRUE AS pdates, 1 AS rn FROM n WHERE c % 5 = 0
          UNION ALL SELECT entry, c, k, d, page, title || 'more' || phrase, host || '/p/' || k, TRUE, 1
            FROM n WHERE c % 5 = 1
          UNION ALL SELECT entry, c, k, d, page, title, host || '/notices/tender-' || k || '.html#' || k,
            FALSE, row_number() OVER (PARTITION BY entry ORDER BY k) FROM n WHERE c % 5 = 4)
        WHERE rn <= 10""",
    # the lines of each notice's dates in the JSON report
    "jdates": """SELECT k, flatten(list(['        {', '          "date": "' || date || '",',
        '          "type": "' || type || '",', '          "context": "' || context || '"',
        '        }' || CASE WHEN pos + 1 < np THEN ',' ELSE '' END] ORDER BY pos)) AS ds
        FROM (SELECT *, count(*) OVER (PARTITION BY k) AS np FROM ctx) GROUP BY k""",
    "pdated": "SELECT k, string_agg(date, '|' ORDER BY pos) AS dates FROM plain GROUP BY k",
    # the records of each pipeline, before metadata
    "fallback_rec": """SELECT entry, parts.k, left(ptext, 200) AS title, ptext AS description,
        NULL AS rfp_id, url, page AS source_page, NULL AS source_type, CAST(NULL AS BOOLEAN) AS is_active,
        NULL AS email, NULL AS phone,
        CASE WHEN pdates THEN coalesce(dates, '') ELSE '' END AS dates,
        CASE WHEN pdates THEN coalesce(regexp_replace(dates, '[^|]+', 'unlabelled', 'g'), '')
             ELSE '' END AS date_types,
        CAST(NULL AS VARCHAR) AS links, CAST(NULL AS BIGINT) AS pdf_pages
        FROM parts LEFT JOIN pdated USING (k)""",
    "block_rec": r"""SELECT entry, blocks.k, btitle AS title, left(btext, 500) AS description,
        coalesce(nullif(regexp_extract(btext, '(?i)RFP[#\s:-]*([A-Z0-9-]+)'), ''),
          nullif(regexp_extract(btext, '(?i)RFQ[#\s:-]*([A-Z0-9-]+)'), ''),
          nullif(regexp_extract(btext, '(?i)Solicitation[#\s:-]*([A-Z0-9-]+)'), '')) AS rfp_id,
        link1 AS url, page AS source_page, 'html' AS source_type,
        CASE WHEN st = 'F' THEN FALSE WHEN st = 'O' THEN TRUE ELSE dates IS NOT NULL END AS is_active,
        CASE WHEN k % 6 = 0 THEN 'u' || c || '@example.com' END AS email,
        CASE WHEN k % 6 = 1 THEN '555-123-' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') END AS phone,
        coalesce(dates, '') AS dates, coalesce(types, '') AS date_types,
        concat_ws('|', link1, link2) AS links, CAST(NULL AS BIGINT) AS pdf_pages
        FROM (SELECT *, row_number() OVER (PARTITION BY entry, lower(btitle) ORDER BY k) AS rn
              FROM blocks) blocks LEFT JOIN bdated USING (k) WHERE rn = 1""",
    "bdated": """SELECT k, string_agg(date, '|' ORDER BY pno, i) AS dates,
        string_agg(CASE WHEN contains(lower(context), 'deadline') THEN 'deadline'
             WHEN contains(lower(context), 'due date') THEN 'due date'
             WHEN contains(lower(context), 'posted') THEN 'posted'
             WHEN contains(lower(context), 'until') THEN 'until'
             ELSE 'unknown' END, '|' ORDER BY pno, i) AS types FROM b3 GROUP BY k""",
    "document_rec": """SELECT l.entry, l.link_no, l.k,
        CASE WHEN k % 4 = 0 THEN mtitle WHEN k % 4 = 1 THEN 'Terms for ' || title
             ELSE 'Document ' || k END AS title,
        coalesce(nullif(mtitle, ''), 'Document ' || k) AS strict_title,
        left(dtext, 500) AS description, did.rfp_id, durl AS url, page AS source_page,
        'pdf' AS source_type, TRUE AS is_active, NULL AS email, NULL AS phone, dates,
        CASE WHEN dates = '' THEN '' ELSE regexp_replace(dates, '[^|]+', 'extracted_from_pdf', 'g')
          END AS date_types,
        CAST(NULL AS VARCHAR) AS links, CAST(npages AS BIGINT) AS npages, mx
        FROM doclinks l JOIN docs USING (k) JOIN ddates USING (k) JOIN did USING (k)
        JOIN reg ON reg.c = l.c WHERE l.part = 0""",
    "did": r"""SELECT k, coalesce(nullif(regexp_extract(substr(dtext, 1, 2000), '(?i)RFP[#\s:-]*([A-Z0-9-]+)'), ''),
        nullif(regexp_extract(substr(dtext, 1, 2000), '(?i)RFQ[#\s:-]*([A-Z0-9-]+)'), ''),
        nullif(regexp_extract(substr(dtext, 1, 2000), '(?i)Solicitation[#\s:-]*([A-Z0-9-]+)'), ''),
        nullif(regexp_extract(substr(dtext, 1, 2000), '(?i)Project[#\s:-]*([A-Z0-9-]+)'), '')) AS rfp_id
        FROM docs""",
    "meta": """SELECT DISTINCT entry, name AS utility, id AS utility_id, type AS utility_type, region
        FROM n JOIN reg USING (c) WHERE active""",
}
# The same context views once more, over block texts.
for _a, _b, _src in (("m0", "b0", "SELECT k, btext AS text FROM blocks"),
                     ("m1", "b1", None), ("m2", "b2", None), ("m3", "b3", None)):
    _sql = _VIEWS[_a]
    for _i in "0123":
        _sql = re.sub(rf"\bm{_i}\b", f"b{_i}", _sql)
    _VIEWS[_b] = _sql.replace("FROM texts, pats", "FROM btexts, pats")
_VIEWS["btexts"] = "SELECT k, btext AS text FROM blocks"


def _with(body: str) -> str:
    """``body`` preceded by the views it uses, in an order that works."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in _VIEWS:
            if name not in needed and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", sql):
                visit(_VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    ctes = ",\n".join(f"{name} AS ({_VIEWS[name]})" for name in needed)
    return f"WITH {ctes}\n{body}" if needed else body


def _expect(name: str, body: str) -> None:
    EXPECTED[name] = _with(body)


_first_page = "'https://u' || c || '.example.com/notices/index.html'"

# Sources
_expect("registry_scan", f"""SELECT id, name, type, region, {_first_page} AS rfp_url, active,
  CAST(mx AS BIGINT) AS max_pdfs_to_extract FROM reg""")
_expect("page_scan", """SELECT page_id, url, length(html) AS n_chars FROM pages
  WHERE html IS NOT NULL""")
_expect("document_scan", """SELECT doc_id, lang, source, length(text) AS n_chars FROM documents
  WHERE text IS NOT NULL""")
_expect("page_nodes", """SELECT page_id, tag, count(*) AS n FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >]', 1)) AS tag FROM pages)
  GROUP BY page_id, tag""")

# Filters
_expect("active_registry", "SELECT c * 4294967296 AS entry, id, name FROM reg WHERE active")
_expect("registry_by_id", f"""SELECT entry, id, name, page AS rfp_url FROM
  (SELECT DISTINCT entry, c, page FROM n WHERE c = 7 ORDER BY entry LIMIT 1) JOIN reg USING (c)""")
_any_word = "(contains({0}, 'tion') OR contains({0}, 'ción') OR contains({0}, 'ment'))"
_expect("keyword_filter", f"SELECT doc_id FROM documents WHERE {_any_word.format('lower(text)')}")

_expect("keyword_whole_words", r"""SELECT doc_id FROM documents WHERE regexp_matches(lower(text),
  '(^|[^\p{L}\p{N}\p{M}_])(the|und|ción)([^\p{L}\p{N}\p{M}_]|$)')""")

# Page parts
_raw_links = r"""SELECT page_id, pos AS seq, text, root || href AS link_url FROM (
  SELECT page_id, regexp_extract(url, '^(https?://[^/]*)', 1) AS root,
    unnest(range(1, len(hrefs) + 1)) AS pos,
    replace(unnest(hrefs), '&amp;', '&') AS href, replace(unnest(texts), '&amp;', '&') AS text
  FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs,
      regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS texts FROM pages))"""
_expect("page_links", _raw_links)
_expect("stream_incremental", _raw_links)
_expect("relevant_links", """SELECT entry AS page_id, seq, text, url AS link_url FROM (
  SELECT *, 1 + row_number() OVER (PARTITION BY entry ORDER BY k, part) AS seq FROM anchors)
  WHERE c % 5 = 4""")
_expect("relevant_links_words", f"""SELECT * FROM ({_raw_links})
  WHERE {_any_word.format('lower(text)')} OR {_any_word.format('lower(link_url)')}""")
_expect("table_rows", """SELECT entry AS page_id, row_number() OVER (PARTITION BY entry ORDER BY k) AS seq,
  title || ' ' || phrase || ' view' AS text, CAST(3 AS BIGINT) AS n_cells,
  'n/' || k || '.html' AS href FROM n WHERE c % 5 = 0""")
_expect("list_items", """SELECT entry AS page_id, row_number() OVER (PARTITION BY entry ORDER BY k) AS seq,
  title || 'more' || phrase AS text, '../p/' || k AS href FROM n WHERE c % 5 = 1""")
_expect("list_items_words", f"""SELECT page_id, text FROM (
  SELECT page_id, replace(unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1)),
    '&amp;', '&') AS text FROM pages) WHERE {_any_word.format('lower(text)')}""")
_expect("blocks_by_header", """SELECT entry AS page_id, row_number() OVER (PARTITION BY entry ORDER BY k) AS seq,
  'div' AS tag, btitle AS title, btext AS text FROM blocks WHERE strategy = 1""")
_expect("blocks_by_header_words", f"""SELECT page_id, 'p' AS tag FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1)) AS h FROM pages)
  WHERE {_any_word.format('lower(h)')}""")
_expect("blocks_by_class", """SELECT entry AS page_id, row_number() OVER (PARTITION BY entry ORDER BY k) AS seq,
  'div' AS tag, btitle AS title, btext AS text FROM blocks WHERE strategy = 2""")
_bid_table = """SELECT entry AS page_id, CAST(1 AS BIGINT) AS seq, 'table' AS tag,
  left('ItemDatesLink' || string_agg(title || phrase || 'view', '' ORDER BY k), 200) AS title,
  'Item Dates Link ' || string_agg(title || ' ' || phrase || ' view', ' ' ORDER BY k) AS text
  FROM n WHERE c % 5 = 0 GROUP BY entry"""
_expect("blocks_by_table", _bid_table)
_expect("page_blocks", """SELECT entry AS page_id, row_number() OVER (PARTITION BY entry ORDER BY k) AS seq,
  CAST(strategy AS BIGINT) AS strategy, btitle AS title FROM blocks""")
_expect("block_titles", f"""SELECT entry AS page_id, CAST(strategy AS BIGINT) AS strategy, btitle AS title
  FROM blocks UNION ALL SELECT page_id, CAST(3 AS BIGINT), title FROM ({_bid_table})""")
_expect("block_links", """SELECT page_id, seq, CAST(link_no AS BIGINT) AS link_no, text, link_url FROM (
  SELECT entry AS page_id, k, row_number() OVER (PARTITION BY entry ORDER BY k) AS seq, 1 AS link_no,
    CASE WHEN strategy = 1 THEN 'details' ELSE 'Document ' || k END AS text, link1 AS link_url FROM blocks
  UNION ALL SELECT entry, k, row_number() OVER (PARTITION BY entry ORDER BY k), 2, 'apply', link2
    FROM blocks WHERE strategy = 2)""")
_expect("document_links", """SELECT entry AS page_id, link_no, text, url AS link_url FROM doclinks""")
_expect("document_links_strict", """SELECT entry AS page_id, link_no, text, url AS link_url
  FROM strictlinks""")

_each = "(SELECT o_orderkey AS k FROM orders)"
_outer = "'bid ' || k || ' rfp ' || k || 'xbid alone rfp ' || k || ' x bid alone'"
_table = "'rfp ' || k || 'xbid alone'"
_items = "'proposal ' || k || 'rfq ' || k || 's'"
_long = "repeat('T', 250) || rtrim(repeat('word' || (k % 7) || ' ', 200))"
_expect("nested_nodes", f"""
  SELECT k AS page_id, 'div' AS tag, CAST(23 AS BIGINT) AS inside, NULL AS href,
    'bid ' || k || {_table} || {_items} || 'rfp ' || k || 'tender ' || k || 'deeper ' || k
    || 'itb ' || k || 'higher' || {_long} AS text FROM {_each}
  UNION ALL SELECT k, 'table', 9, NULL, 'bid ' || k || {_table} FROM {_each}
  UNION ALL SELECT k, 'tr', 8, NULL, 'bid ' || k || {_table} FROM {_each}
  UNION ALL SELECT k, 'td', 0, NULL, 'bid ' || k FROM {_each}
  UNION ALL SELECT k, 'td', 6, NULL, {_table} FROM {_each}
  UNION ALL SELECT k, 'table', 5, NULL, {_table} FROM {_each}
  UNION ALL SELECT k, 'tr', 2, NULL, 'rfp ' || k || 'x' FROM {_each}
  UNION ALL SELECT k, 'td', 0, NULL, 'rfp ' || k FROM {_each}
  UNION ALL SELECT k, 'td', 0, NULL, 'x' FROM {_each}
  UNION ALL SELECT k, 'tr', 1, NULL, 'bid alone' FROM {_each}
  UNION ALL SELECT k, 'td', 0, NULL, 'bid alone' FROM {_each}
  UNION ALL SELECT k, 'ul', 4, NULL, {_items} FROM {_each}
  UNION ALL SELECT k, 'li', 3, NULL, {_items} FROM {_each}
  UNION ALL SELECT k, 'ul', 2, NULL, 'rfq ' || k || 's' FROM {_each}
  UNION ALL SELECT k, 'li', 1, NULL, 'rfq ' || k || 's' FROM {_each}
  UNION ALL SELECT k, 'a', 0, 's' || k, 's' FROM {_each}
  UNION ALL SELECT k, 'h2', 0, NULL, v || k FROM {_each}, (VALUES ('rfp '), ('tender '), ('itb ')) AS t(v)
  UNION ALL SELECT k, 'hr', 0, NULL, '' FROM {_each}
  UNION ALL SELECT k, 'h3', 0, NULL, 'deeper ' || k FROM {_each}
  UNION ALL SELECT k, 'h1', 0, NULL, 'higher' FROM {_each}
  UNION ALL SELECT k, 'div', 1, NULL, {_long} FROM {_each}
  UNION ALL SELECT k, 'b', 0, NULL, repeat('T', 250) FROM {_each}""")
_expect("nested_rows", f"""
  SELECT k AS page_id, CAST(1 AS BIGINT) AS seq, {_outer} AS text, CAST(5 AS BIGINT) AS n_cells FROM {_each}
  UNION ALL SELECT k, 2, 'rfp ' || k || ' x', 2 FROM {_each}
  UNION ALL SELECT k, 3, 'rfp ' || k || ' x', 2 FROM {_each}""")
_expect("nested_items", f"""
  SELECT k AS page_id, CAST(1 AS BIGINT) AS seq, 'proposal ' || k || 'rfq ' || k || 's' AS text,
    's' || k AS href FROM {_each}
  UNION ALL SELECT k, s, 'rfq ' || k || 's', 's' || k FROM {_each}, (VALUES (2), (3)) AS v(s)""")
_expect("nested_headers", f"""
  SELECT k AS page_id, CAST(1 AS BIGINT) AS seq, 'hr' AS tag, '' AS text FROM {_each}
  UNION ALL SELECT k, 2, 'h3', 'deeper ' || k FROM {_each}""")
_expect("nested_tables", f"""
  SELECT k AS page_id, CAST(1 AS BIGINT) AS seq,
    'bid ' || k || ' rfp ' || k || ' x bid alone' AS text FROM {_each}
  UNION ALL SELECT k, 2, 'rfp ' || k || ' x bid alone' FROM {_each}""")
_expect("long_blocks", f"""SELECT k AS page_id, repeat('T', 200) AS title,
  left(repeat('T', 250) || ' ' || repeat('word' || (k % 7) || ' ', 200), 500) AS description FROM {_each}""")
_expect("long_document_facts", f"""SELECT k AS key, array_to_string(list_sort(list_transform(range(1, 11),
    lambda i: i || '/' || (k % 28 + 1) || '/2020')), '|') AS dates,
  CASE WHEN k % 2 = 1 THEN 'RFQ-' || k END AS rfp_id, CAST(14 AS BIGINT) AS n_dates,
  'RFP-' || k AS any_id FROM {_each}""")

# Functions over text
_expect("dates_plain", "SELECT k AS key, pos, date FROM plain")
_expect("dates_exploded", "SELECT k AS key, pos, date FROM ctx")
_expect("dates_context", "SELECT k AS key, pos, date, context FROM ctx")
_expect("dates_strict", """SELECT k AS key, row_number() OVER (PARTITION BY k ORDER BY pos) - 1 AS pos, date
  FROM ctx WHERE k % 4 <> 1 OR NOT regexp_matches(date, '^[0-9]{2}-[0-9]{2}-[0-9]{2}$')""")
_expect("date_labels", "SELECT k AS key, pos, type FROM ctx")
_expect("document_dates", "SELECT durl AS url, dates FROM docs JOIN ddates USING (k)")
_expect("notice_id", "SELECT k AS key, rfp_id FROM ids")
_expect("document_id", "SELECT durl AS url, rfp_id FROM docs JOIN did USING (k)")
_expect("contact_info", r"""SELECT doc_id,
  nullif(regexp_extract(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b'), '') AS email,
  nullif(regexp_extract(text, '\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}'), '') AS phone,
  CAST(NULL AS VARCHAR) AS name FROM documents""")
_expect("notice_status", """SELECT k AS key, CASE WHEN contains(text, 'closed') THEN FALSE
  WHEN contains(text, 'open') THEN TRUE ELSE dates IS NOT NULL END AS is_active
  FROM n LEFT JOIN dated USING (k)""")
_expect("resolve_urls", """SELECT k AS key, CASE k % 9
  WHEN 0 THEN host || '/a/b' || (k % 3) || '/d' || k WHEN 1 THEN host || '/a/d' || k
  WHEN 2 THEN host || '/r/' || k WHEN 3 THEN host || '/a/b' || (k % 3) || '/index.html?q=' || k
  WHEN 4 THEN host || '/a/b' || (k % 3) || '/index.html?x=1#f' || k
  WHEN 5 THEN 'https://h.example.com/' || k WHEN 6 THEN 'mailto:u' || k || '@example.com'
  WHEN 7 THEN host || '/y/' || k ELSE host || '/a/b' || (k % 3) || '/index.html?x=1' END AS resolved
  FROM n""")
_expect("document_titles", """SELECT durl AS url, CASE k % 4 WHEN 0 THEN mtitle
  WHEN 1 THEN 'Terms for ' || title ELSE 'Document ' || k END AS title FROM docs""")
_expect("document_stats", r"""SELECT doc_id, length(text) AS text_length,
  len(regexp_extract_all(text, '\S+')) AS word_count FROM documents""")
_expect("dates_parsed", """SELECT k AS key, date,
  CASE WHEN date LIKE '12/31/%' THEN make_date(CAST(right(date, 4) AS BIGINT), 12, 31) ELSE d END
  AS date_value FROM plain""")

# Joins
_expect("enrich_metadata", """SELECT k AS key, name AS utility, id AS utility_id,
  type AS utility_type, region FROM n JOIN reg USING (c)""")
_expect("registry_pages", """SELECT c * 4294967296 AS entry, id, entry AS page_id FROM reg
  LEFT JOIN (SELECT DISTINCT c, entry FROM n WHERE ch = 0) USING (c)""")
_expect("link_documents", """SELECT l.entry, l.link_no, l.text AS link_text, durl AS document_url,
  'Terms for ' || title AS opening, rfp_id
  FROM doclinks l JOIN docs USING (k) JOIN did USING (k) JOIN reg ON reg.c = l.c
  WHERE l.part = 0 AND link_no <= coalesce(mx, 5)""")
_expect("containment_dedup", """SELECT 'u' || c AS utility_id, k AS key, title FROM n a
  WHERE k % 4 = 0 OR NOT EXISTS (SELECT 1 FROM n b WHERE b.c = a.c AND b.k < a.k
    AND contains(lower(b.title), lower(a.title)))""")
_expect("merge_sources", """SELECT 'u' || c AS utility_id, title, source_rank, k AS key FROM (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY source_rank, k) AS rn FROM (
    SELECT c, k, title || ' Specification' AS title, CAST(0 AS BIGINT) AS source_rank FROM n
      WHERE k % 4 = 0
    UNION ALL SELECT c, k, title, 1 FROM n WHERE k % 4 <> 0)) a
  WHERE source_rank = 0 OR NOT EXISTS (SELECT 1 FROM (
      SELECT c, k, title || ' Specification' AS title, 0 AS source_rank FROM n
        WHERE k % 4 = 0
      UNION ALL SELECT c, k, title, 1 FROM n WHERE k % 4 <> 0) b
    WHERE b.c = a.c AND (b.source_rank < a.source_rank OR b.k < a.k)
      AND contains(lower(b.title), lower(a.title)))""")

_expect("fuzzy_titles", r"""WITH sets AS (
    SELECT c, words, min(k) AS k FROM (
      SELECT c, k, list_sort(list_distinct(regexp_extract_all(lower(title), '\w+'))) AS words FROM (
        SELECT n0.*, """ + _TITLE + r""" AS title FROM (SELECT o_custkey AS c, o_orderkey AS k,
          o_orderpriority AS pr FROM orders) n0)) GROUP BY c, words)
  SELECT 'u' || a.c AS utility_id, a.k AS first, b.k AS second, round(
    len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))), 6) AS similarity
  FROM sets a JOIN sets b ON a.c = b.c AND a.k < b.k
  WHERE len(list_intersect(a.words, b.words)) >= 0.6 * len(list_distinct(list_concat(a.words, b.words)))""")

# Choosing
_expect("dedup_titles", """SELECT utility_id, key, title FROM (
  SELECT 'u' || c AS utility_id, k AS key,
    CASE WHEN k % 2 = 0 THEN upper(title) ELSE ' ' || title END AS title,
    row_number() OVER (PARTITION BY c, lower(title) ORDER BY k) AS rn FROM n) WHERE rn = 1""")
_expect("document_links_topn", """SELECT utility_id, key FROM (
  SELECT 'u' || c AS utility_id, k AS key, coalesce(mx, 5) AS mx,
    row_number() OVER (PARTITION BY c ORDER BY k) AS rn FROM n JOIN reg USING (c)) WHERE rn <= mx""")
_expect("links_topn", """SELECT entry AS page_id, seq + 1 AS seq, text, url AS link_url FROM (
  SELECT *, row_number() OVER (PARTITION BY entry ORDER BY k, part) AS seq FROM anchors)
  WHERE c % 5 = 4 AND seq <= 10""")
_expect("fallback_cascade", """SELECT utility_id, key, tier FROM (
  SELECT *, min(tier) OVER (PARTITION BY utility_id) AS best FROM (
    SELECT 'u' || c AS utility_id, k AS key,
      CAST(CASE WHEN k % 13 = 0 THEN 1 WHEN k % 5 = 0 THEN 2 ELSE 3 END AS BIGINT) AS tier FROM n))
  WHERE tier = best""")

# Counts and reports
_expect("utility_counts", """SELECT utility, n, f.entry AS entry, f.seq AS seq FROM (
  SELECT utility, count(*) AS n, min({'entry': entry, 'seq': k}) AS f FROM opp GROUP BY utility)""")
_expect("utility_groups", """SELECT utility, n, idx, title FROM opp JOIN head USING (utility)""")
_expect("report_totals", """SELECT count(*) AS total, count(DISTINCT utility) AS utilities FROM opp""")
_expect("utility_header", "SELECT utility, n, region, utility_type, source_page FROM head")
_first3 = """SELECT k, string_agg(date, ', ' ORDER BY pos) AS dates FROM ctx WHERE pos < 3 GROUP BY k"""
_expect("numbered_listing", f"""SELECT utility, idx, title, coalesce(dates, '') AS dates
  FROM opp LEFT JOIN ({_first3}) f USING (k)""")
_expect("registry_rollup", """SELECT 'type' AS level, type AS name, count(*) AS n FROM reg GROUP BY type
  UNION ALL SELECT 'region', region, count(*) FROM reg GROUP BY region
  UNION ALL SELECT 'country', type, count(*) FROM reg GROUP BY type
  UNION ALL SELECT 'all', 'all', count(*) FROM reg""")


def _lines(*groups: tuple[int, str, str, list[str], str]) -> str:
    """UNION of line lists: (section, utility, idx, lines, FROM ...)."""
    selects = [
        f"SELECT CAST({section} AS BIGINT) AS section, {utility} AS utility, CAST({idx} AS BIGINT) AS idx, "
        f"CAST({no} AS BIGINT) AS line_no, {line} AS line {source}"
        for section, utility, idx, lines, source in groups for no, line in enumerate(lines)
    ]
    return f"SELECT * FROM ({' UNION ALL '.join(selects)}) WHERE line IS NOT NULL"


_totals = "FROM (SELECT count(*) AS total, count(DISTINCT utility) AS utilities FROM opp)"
_all_dates = "SELECT k, string_agg(date, ', ' ORDER BY pos) AS dates FROM ctx GROUP BY k"
_rule = "'" + "=" * 80 + "'"
_expect("report_summary", _lines(
    (0, "''", "0", ["NULL", _rule, "'RFP OPPORTUNITIES REPORT - 2026-01-02 03:04'", _rule, "''",
                    "'Total Opportunities Found: ' || total", "''",
                    "'Utilities Scraped: ' || utilities", "''", "'" + "-" * 80 + "'"], _totals),
    (1, "utility", "0", ["''", "utility || ' (' || region || ')'", "'  Type: ' || utility_type",
                         "'  Opportunities: ' || n", "''"], "FROM head"),
    (1, "utility", "idx", ["'  [' || idx || '] ' || left(title, 100)", "'      Dates: ' || dates",
                           "'      Link: ' || url", "''"],
     f"FROM opp LEFT JOIN ({_first3}) f USING (k)"),
    (2, "''", "0", [_rule], _totals)))
_expect("report_markdown", _lines(
    (0, "''", "0", ["'# RFP Opportunities Report'", "''", "NULL",
                    "'**Generated:** 2026-01-02 03:04'", "''",
                    "'**Total Opportunities:** ' || total", "''", "'---'", "''"], _totals),
    (1, "utility", "0", ["'## ' || utility", "''", "'**Region:** ' || region",
                         "'**Type:** ' || utility_type", "'**Source:** ' || source_page",
                         "'**Opportunities Found:** ' || n", "''"], "FROM head"),
    (1, "utility", "idx", ["'### ' || idx || '. ' || title", "''",
                           "'**Summary:** ' || left(description, 300) || '...'",
                           "CASE WHEN dates IS NOT NULL THEN '' END", "'**Key Dates:** ' || dates",
                           "''", "'**More Information:** [' || url || '](' || url || ')'", "''",
                           "'---'", "''"],
     f"FROM opp LEFT JOIN ({_all_dates}) f USING (k)")))
_record_lines = r"""list_concat(list_concat(list_concat(
    ['    {', '      "utility": "' || utility || '",', '      "title": "' || title || '",',
     '      "url": "' || url || '",', '      "source_page": "' || source_page || '",'],
    CASE WHEN ds IS NULL THEN ['      "dates": [],'] ELSE list_concat(list_concat(['      "dates": ['], ds),
      ['      ],']) END),
    ['      "contact": {',
     '        "email": ' || CASE WHEN k % 6 = 0 THEN '"u' || c || '@example.com"' ELSE 'null' END || ',',
     '        "phone": ' || CASE WHEN k % 6 = 1 THEN '"555-123-' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0')
        || '"' ELSE 'null' END, '      },']),
    ['      "additional_links": [', '        {', '          "text": "more",',
     '          "url": "' || url || '"', '        }', '      ],',
     '      "metadata": {', '        "source": "' || utility_id || '"', '      }',
     '    }' || CASE WHEN row_number() OVER (ORDER BY entry DESC, k DESC) = 1 THEN '' ELSE ',' END])"""
_expect("report_json", f"""SELECT CAST(section AS BIGINT) AS section, CAST(entry AS BIGINT) AS entry,
  CAST(seq AS BIGINT) AS seq, CAST(line_no AS BIGINT) AS line_no, line FROM (
  SELECT 0 AS section, 0 AS entry, 0 AS seq, 0 AS line_no, '{{' AS line
  UNION ALL SELECT 0, 0, 0, 1, '  "generated_at": "2026-01-02 03:04",'
  UNION ALL SELECT 0, 0, 0, 2, '  "total_opportunities": ' || count(*) || ',' FROM opp
  UNION ALL SELECT 0, 0, 0, 3, '  "opportunities": ['
  UNION ALL SELECT 1, entry, k, unnest(range(len(ls))), unnest(ls) FROM (
    SELECT entry, k, {_record_lines} AS ls FROM opp LEFT JOIN jdates USING (k))
  UNION ALL SELECT 2, 0, 0, 0, '  ]' UNION ALL SELECT 2, 0, 0, 1, '}}')""")

# Whole pipelines
_COLUMNS = """entry, utility, utility_id, utility_type, region, title, description, rfp_id, url,
  source_page, source_type, is_active, email, phone, dates, date_types, links, pdf_pages"""
_FB = """SELECT entry, title, description, CAST(rfp_id AS VARCHAR) AS rfp_id, url, source_page,
  CAST(source_type AS VARCHAR) AS source_type, is_active, CAST(email AS VARCHAR) AS email,
  CAST(phone AS VARCHAR) AS phone, dates, date_types, links, pdf_pages FROM fallback_rec"""
_BL_IN_ALL = """SELECT entry, title, description, rfp_id, url, source_page, source_type, is_active, email,
  phone, dates, date_types, links, pdf_pages FROM block_rec"""
_BL = _BL_IN_ALL.replace("source_type", "CAST(NULL AS VARCHAR) AS source_type")
_DOC = """SELECT entry, title, description, rfp_id, url, source_page, source_type, is_active,
  CAST(email AS VARCHAR) AS email, CAST(phone AS VARCHAR) AS phone, dates, date_types, links,
  CAST(NULL AS BIGINT) AS pdf_pages FROM document_rec WHERE link_no <= coalesce(mx, 5)"""
_STRICT = """SELECT r.entry, strict_title AS title, description, rfp_id, r.url, source_page, source_type,
  CAST(NULL AS BOOLEAN) AS is_active, CAST(email AS VARCHAR) AS email, CAST(phone AS VARCHAR) AS phone,
  dates, replace(date_types, 'extracted_from_pdf', 'extracted') AS date_types, links, npages AS pdf_pages
  FROM document_rec r JOIN strictlinks s ON s.k = r.k AND s.part = 0
  WHERE s.link_no <= coalesce(mx, 10)"""
# Links never leave out a listing page with none of its documents found: every
# page of layout 3 has blocks, so the fallback only serves layouts 0, 1 and 4.
_expect("opportunities", f"""SELECT {_COLUMNS} FROM (
  {_DOC} UNION ALL {_BL_IN_ALL} b WHERE NOT EXISTS (
    SELECT 1 FROM document_rec q WHERE q.link_no <= coalesce(q.mx, 5) AND q.entry = b.entry
      AND contains(lower(q.title), lower(b.title))) AND NOT EXISTS (
    SELECT 1 FROM block_rec q WHERE q.entry = b.entry AND q.k < b.k
      AND contains(lower(q.title), lower(b.title)))
  UNION ALL {_FB}) JOIN meta USING (entry)""")
_expect("enhanced_opportunities",
        f"SELECT {_COLUMNS} FROM ({_BL} UNION ALL {_FB}) JOIN meta USING (entry)")
_expect("base_opportunities", f"SELECT {_COLUMNS} FROM ({_FB}) JOIN meta USING (entry)")
_expect("document_opportunities", f"SELECT {_COLUMNS} FROM ({_STRICT}) JOIN meta USING (entry)")
_expect("all_opportunities", f"""SELECT {_COLUMNS} FROM (
  {_STRICT} UNION ALL SELECT * FROM ({_BL}) WHERE source_page IN (SELECT page FROM n WHERE c % 5 = 2)
  UNION ALL {_FB}) JOIN meta USING (entry)""")
_expect("extraction_metrics", """SELECT entry,
  CAST(count(*) FILTER (c % 5 IN (2, 3)) AS BIGINT) AS n_blocks,
  CAST(count(*) FILTER (c % 5 = 3) + count(*) FILTER (c % 5 = 3 AND k % 2 = 1) AS BIGINT) AS n_doc_links,
  CAST(CASE WHEN c % 5 IN (0, 1) THEN count(*) WHEN c % 5 = 4 THEN least(count(*), 10) ELSE 0 END
    AS BIGINT) AS n_fallback, FALSE AS failed
  FROM n JOIN reg USING (c) WHERE active GROUP BY entry, c""")

_portal = "c % 5 AS layout, CASE WHEN c % 3 = 0 THEN -1 ELSE c // 500 END AS portal"
_expect("shared_portal", f"""SELECT e.entry, e.name AS utility, title, url, source_page, dates FROM (
    SELECT DISTINCT entry, name, {_portal} FROM n JOIN reg USING (c)) e
  JOIN (SELECT min(c) * 4294967296 AS lead, {_portal} FROM n WHERE ch = 0 GROUP BY layout, portal) USING (layout, portal)
  JOIN (SELECT entry AS lead, title, url, source_page, dates FROM ({_BL} UNION ALL {_FB})) USING (lead)""")
_expect("latest_pages", """SELECT url, page_id // 2 AS page_id, length(html) AS n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id DESC) AS rn,
    max(page_id // 2) OVER (PARTITION BY url) AS last FROM pages WHERE html IS NOT NULL)
  WHERE page_id // 2 = last""")
_expect("latest_documents", "SELECT durl AS url, md5(dtext) AS text_md5 FROM docs")
_expect("run_metrics", """SELECT entry, CASE WHEN c % 11 = 0 THEN 'uncollected' WHEN c % 7 = 0 THEN 'failed'
    ELSE 'ok' END AS status,
  CASE WHEN c % 11 = 0 OR c % 7 = 0 THEN 0 ELSE n_blocks END AS n_blocks,
  CASE WHEN c % 11 = 0 OR c % 7 = 0 THEN 0 ELSE n_doc_links END AS n_doc_links,
  CASE WHEN c % 11 = 0 OR c % 7 = 0 THEN 0 ELSE n_fallback END AS n_fallback FROM (
  SELECT entry, c, CAST(count(*) FILTER (c % 5 IN (2, 3)) AS BIGINT) AS n_blocks,
    CAST(count(*) FILTER (c % 5 = 3) + count(*) FILTER (c % 5 = 3 AND k % 2 = 1) AS BIGINT) AS n_doc_links,
    CAST(CASE WHEN c % 5 IN (0, 1) THEN count(*) WHEN c % 5 = 4 THEN least(count(*), 10) ELSE 0 END
      AS BIGINT) AS n_fallback
  FROM n JOIN reg USING (c) WHERE active GROUP BY entry, c)""")

# Repeated runs
_expect("snapshot_diff", """SELECT * FROM (
  SELECT coalesce(a.utility_id, b.utility_id) AS utility_id,
    coalesce(a.norm_title, b.norm_title) AS norm_title,
    CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'gone'
         WHEN a.content <> b.content THEN 'changed' END AS change
  FROM (SELECT 'u' || c AS utility_id, lower(title) AS norm_title, min(k) AS k,
          arg_min(text || st, k) AS content FROM n WHERE k % 10 <> 3 GROUP BY ALL) a
  FULL JOIN (SELECT 'u' || c AS utility_id, lower(title) AS norm_title, min(k) AS k,
          arg_min(text || CASE WHEN k % 4 = 1 THEN ' amended' ELSE '' END || st, k) AS content
        FROM n WHERE k % 10 <> 7 GROUP BY ALL) b
  ON a.utility_id = b.utility_id AND a.norm_title = b.norm_title) WHERE change IS NOT NULL""")
_expect("notice_trend", """SELECT CAST(date_trunc('month', d) AS DATE) AS month, c % 5 AS layout,
  count(*) AS n, count(*) FILTER (st = 'O') AS n_active FROM n GROUP BY ALL""")
_expect("unseen_pages", "SELECT page_id, md5(url) AS url_key FROM pages WHERE page_id % 3 <> 0")
_expect("opportunities_incremental",
        f"SELECT {_COLUMNS} FROM ({_BL} UNION ALL {_FB}) JOIN meta USING (entry)")
_expect("notice_history", """SELECT DATE '2026-01-01' AS run_date, 'u' || c AS utility_id, count(*) AS n,
    count(*) FILTER (st = 'O') AS n_active FROM n WHERE k % 10 <> 3 GROUP BY c
  UNION ALL SELECT DATE '2026-01-02', 'u' || c, count(*), count(*) FILTER (st = 'O')
    FROM n WHERE k % 10 <> 7 GROUP BY c""")
_expect("open_notices", """SELECT k AS key, max(CASE WHEN date LIKE '12/31/%'
      THEN make_date(CAST(right(date, 4) AS BIGINT), 12, 31) ELSE p.d END) >= DATE '1996-06-01' AS is_open
  FROM n LEFT JOIN plain p USING (k) GROUP BY k""")
_snap = """SELECT 'u' || c AS utility_id, CASE WHEN k % 6 <> 0 THEN lower(title) END AS norm_title,
    min(k) AS k, arg_min('https://n.example.com/' || (k % 5){0}, k) AS content FROM n WHERE {1} GROUP BY ALL"""
_expect("snapshot_changes", f"""SELECT * FROM (
  SELECT coalesce(a.utility_id, b.utility_id) AS utility_id,
    coalesce(a.norm_title, b.norm_title) AS norm_title,
    CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'gone'
         WHEN a.content <> b.content THEN 'changed' END AS change
  FROM ({_snap.format("", "k % 10 <> 3")}) a
  FULL JOIN ({_snap.format(" || CASE WHEN k % 8 = 1 THEN '?moved' ELSE '' END", "k % 10 <> 7")}) b
  ON a.utility_id = b.utility_id AND coalesce(a.norm_title, '') = coalesce(b.norm_title, ''))
  WHERE change IS NOT NULL""")
EXPECTED["repeated_rows"] = EXPECTED["opportunities"]
_run = """SELECT 'u' || c AS utility_id, CASE WHEN k % 6 <> 0 THEN lower(title) END AS norm_title, r,
    arg_min('https://n.example.com/' || (k % 5) || CASE WHEN k % 4 = 1 AND r >= 3 THEN '?moved' ELSE '' END, k)
    AS content FROM n, (SELECT unnest([1, 2, 3, 4]) AS r) WHERE (k + r) % 10 <> 3 GROUP BY ALL"""
_expect("stream_changes", f"""SELECT utility_id, norm_title, DATE '2025-12-31' + CAST(r AS INTEGER) AS run_ts, change FROM (
  SELECT b.utility_id, b.norm_title, b.r,
    CASE WHEN a.r IS NULL THEN 'new' WHEN a.content <> b.content THEN 'changed' END AS change
  FROM ({_run}) b LEFT JOIN ({_run}) a ON a.r = b.r - 1 AND a.utility_id = b.utility_id
    AND coalesce(a.norm_title, '') = coalesce(b.norm_title, '')
  UNION ALL SELECT a.utility_id, a.norm_title, a.r + 1, 'gone'
  FROM ({_run}) a LEFT JOIN ({_run}) b ON a.r = b.r - 1 AND a.utility_id = b.utility_id
    AND coalesce(a.norm_title, '') = coalesce(b.norm_title, '')
  WHERE b.r IS NULL AND a.r < 4) WHERE change IS NOT NULL""")
_expect("documents_incremental", f"""SELECT {_COLUMNS}, n_missing FROM ({_STRICT}) JOIN meta USING (entry),
  (SELECT count(*) AS n_missing FROM strictlinks s JOIN reg ON reg.c = s.c
   WHERE reg.active AND s.part = 0 AND s.link_no <= coalesce(mx, 10) AND s.k % 5 = 0)""")

# Long documents without limits, whole words (which change nothing here) and whole dates.
_long_text = """dtext || chr(10) || CASE WHEN k % 2 = 1 THEN 'RFQ-' || k || ' ' ELSE '' END
    || repeat('long text ', 210) || 'RFP-' || k
    || array_to_string(list_transform(range(1, 15), lambda i: ' ' || i || '/' || (k % 28 + 1) || '/2020'), '')"""
_all_dates = r"""array_to_string(list_sort(list_distinct(list_concat(list_concat(
    regexp_extract_all(t, '\d{1,2}/\d{1,2}/\d{2,4}'), regexp_extract_all(t, '\d{4}-\d{2}-\d{2}')),
    regexp_extract_all(t, '(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}')))), '|')"""
_open = """CASE WHEN k % 11 = 0 THEN make_date(year(d), 12, 31) WHEN k % 4 < 3 THEN d END >= DATE '1996-06-01'"""
_expect("opportunities_words", f"""SELECT {_COLUMNS}, is_open FROM (
  SELECT entry, title, t AS description, 'RFP-' || k AS rfp_id, url, source_page, source_type, is_active,
    CAST(email AS VARCHAR) AS email, CAST(phone AS VARCHAR) AS phone, ds AS dates,
    regexp_replace(ds, '[^|]+', 'extracted_from_pdf', 'g') AS date_types, links,
    CAST(NULL AS BIGINT) AS pdf_pages, TRUE AS is_open FROM (
    SELECT *, {_all_dates} AS ds FROM (
      SELECT r.*, {_long_text} AS t FROM document_rec r JOIN docs USING (k) WHERE link_no <= coalesce(r.mx, 5)))
  UNION ALL SELECT entry, title, description, rfp_id, url, source_page, source_type, is_active, email, phone,
    coalesce(s.dates, ''), coalesce(s.types, ''), links, pdf_pages, {_open}
  FROM block_rec b JOIN (SELECT k, d FROM n) USING (k) LEFT JOIN (
    SELECT k, string_agg(date, '|' ORDER BY pno, i) AS dates, string_agg(CASE
        WHEN contains(lower(context), 'deadline') THEN 'deadline'
        WHEN contains(lower(context), 'due date') THEN 'due date'
        WHEN contains(lower(context), 'posted') THEN 'posted'
        WHEN contains(lower(context), 'until') THEN 'until' ELSE 'unknown' END, '|' ORDER BY pno, i) AS types
    FROM b3 WHERE NOT regexp_matches(date, '^[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}$') GROUP BY k) s USING (k)
  WHERE NOT EXISTS (SELECT 1 FROM document_rec q WHERE q.link_no <= coalesce(q.mx, 5) AND q.entry = b.entry
      AND contains(lower(q.title), lower(b.title))) AND NOT EXISTS (
    SELECT 1 FROM block_rec q WHERE q.entry = b.entry AND q.k < b.k AND contains(lower(q.title), lower(b.title)))
  UNION ALL SELECT entry, left(ptext, 200), ptext, CAST(NULL AS VARCHAR), url, page, CAST(NULL AS VARCHAR),
    CAST(NULL AS BOOLEAN), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR),
    CASE WHEN pd THEN coalesce(dates, '') ELSE '' END,
    CASE WHEN pd THEN coalesce(regexp_replace(dates, '[^|]+', 'unlabelled', 'g'), '') ELSE '' END,
    CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CASE WHEN pd THEN {_open} END FROM (
    SELECT entry, k, d, page, title || ' ' || phrase || ' view' AS ptext,
      host || '/notices/n/' || k || '.html' AS url, TRUE AS pd FROM n WHERE c % 5 = 0
    UNION ALL SELECT entry, k, d, page, title || 'more' || phrase, host || '/p/' || k, TRUE FROM n WHERE c % 5 = 1
    UNION ALL SELECT entry, k, d, page, title, host || '/notices/tender-' || k || '.html#' || k, FALSE
      FROM n WHERE c % 5 = 4) LEFT JOIN pdated USING (k)) JOIN meta USING (entry)""")

_listed = """SELECT DISTINCT 'u' || c AS utility_id, lower(title) AS norm_title, r
  FROM n, (SELECT unnest(range(1, 7)) AS r) WHERE (k + r) % 3 <> 0 OR k % 4 = 0"""
_expect("notice_periods", f"""SELECT utility_id, norm_title,
    row_number() OVER (PARTITION BY utility_id, norm_title ORDER BY a) AS period,
    DATE '2026-01-01' + CAST(7 * a AS INTEGER) AS first_seen, DATE '2026-01-01' + CAST(7 * b AS INTEGER) AS last_seen,
    CASE WHEN b < 6 THEN DATE '2026-01-01' + CAST(7 * (b + 1) AS INTEGER) END AS closed, n_runs FROM (
  SELECT utility_id, norm_title, min(r) AS a, max(r) AS b, count(*) AS n_runs FROM (
    SELECT *, r - row_number() OVER (PARTITION BY utility_id, norm_title ORDER BY r) AS island FROM ({_listed}))
  GROUP BY utility_id, norm_title, island)""")
_ranges = """SELECT k, c, 0 AS pos, d AS start, d + CAST(k % 40 - 3 AS INTEGER) AS "end", CASE k % 5
    WHEN 0 THEN strftime(d, '%-m/%-d/%Y') || ' to ' || strftime(d + CAST(k % 40 - 3 AS INTEGER), '%-m/%-d/%Y')
    WHEN 1 THEN strftime(d, '%Y-%m-%d') || ' - ' || strftime(d + CAST(k % 40 - 3 AS INTEGER), '%Y-%m-%d')
    WHEN 2 THEN strftime(d, '%b %-d, %Y') || ' and ' || strftime(d + CAST(k % 40 - 3 AS INTEGER), '%b %-d, %Y')
    ELSE strftime(d, '%B %-d, %Y') || ' through ' || strftime(d + CAST(k % 40 - 3 AS INTEGER), '%-m/%-d/%Y') END AS raw
  FROM n WHERE k % 5 <> 4 AND k % 40 >= 3"""
_expect("date_ranges", f"SELECT k AS key, pos, start, \"end\", raw FROM ({_ranges})")
_expect("open_by_day", f"""SELECT layout, day, CAST(sum(delta) OVER (PARTITION BY layout ORDER BY day) AS BIGINT) AS n_open
  FROM (SELECT layout, day, sum(delta) AS delta FROM (
    SELECT c % 5 AS layout, start AS day, 1 AS delta FROM ({_ranges})
    UNION ALL SELECT c % 5, "end" + 1, -1 FROM ({_ranges})) GROUP BY layout, day) QUALIFY delta <> 0""")
_typos = """(SELECT layout, lower(trim(x)) AS t, min(k) AS s FROM (
  SELECT k, c % 5 AS layout, CASE k % 4 WHEN 1 THEN left(w, k % 13) || 'x' || substr(w, k % 13 + 1)
    WHEN 2 THEN left(w, k % 11) || substr(w, k % 11 + 2)
    WHEN 3 THEN left(w, k % 17) || 'q' || substr(w, k % 17 + 2) ELSE w END AS x
  FROM (SELECT *, 'Renewal of lot ' || (k // 40) || ' ' || title AS w FROM n)) GROUP BY ALL)"""
_expect("misspelt_titles", f"""SELECT a.layout, a.s AS first, b.s AS second, levenshtein(a.t, b.t) AS distance
  FROM {_typos} a JOIN {_typos} b ON a.layout = b.layout AND a.s < b.s AND abs(length(a.t) - length(b.t)) <= 2
  WHERE levenshtein(a.t, b.t) <= 2""")

_terms = """SELECT DISTINCT lower(term) AS term FROM (
  SELECT right(c_name, 5) AS term FROM customer
  UNION ALL SELECT CASE WHEN k % 3 = 0 THEN 'lot' || k ELSE upper(title) END FROM n
  UNION ALL SELECT substr(text, CAST(doc_id % 17 AS INTEGER) + 1, CAST(doc_id % 9 AS INTEGER) + 3) FROM documents
  UNION ALL SELECT unnest(['q', 'ß', '', NULL, 'TION', 'ción'])) WHERE term <> ''"""
_expect("keyword_table", f"""SELECT doc_id, count(*) AS n_terms, min(term) AS first, max(term) AS last
  FROM documents JOIN ({_terms}) ON contains(lower(text), term) GROUP BY doc_id""")
_expect("seen_store", """SELECT k AS page_id, 'a' AS run FROM n WHERE k % 3 = 0
  UNION ALL SELECT k, 'b' FROM n WHERE k % 4 = 0 AND k % 3 <> 0
  UNION ALL SELECT k, 'c' FROM n WHERE k % 4 <> 0 AND k % 3 <> 0""")
_expect("observed_metrics", f"""SELECT CAST(sum((status <> 'uncollected')::INT) AS BIGINT) AS n_pages,
  CAST(sum((status = 'failed')::INT) AS BIGINT) AS n_failed, CAST(sum(n_blocks) AS BIGINT) AS n_block,
  CAST(sum(n_doc_links) AS BIGINT) AS n_any, CAST(sum(n_fallback) AS BIGINT) AS n_fallback
  FROM (SELECT * FROM ({EXPECTED["run_metrics"]}))""")
EXPECTED["large_page_blocks"] = EXPECTED["page_blocks"]
_lines = "SELECT '{0}' AS report, {2} AS line, count(*) AS n FROM ({1}) GROUP BY ALL"
EXPECTED["report_files"] = " UNION ALL ".join([
    _lines.format("json", EXPECTED["report_json"], "replace(line, '2026-01-02 03:04', '2026-01-02T03:04:00')"),
    _lines.format("markdown", EXPECTED["report_markdown"], "line"),
    _lines.format("summary", EXPECTED["report_summary"], "line")])
