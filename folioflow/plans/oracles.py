"""The registered queries as DuckDB SQL over the same tables.

`VIEWS` restates `sources/views.py`; `QUERIES` states every result on its own,
mostly row by row (recursive CTEs) where the Spark side folds or aggregates.
"""

from __future__ import annotations

import re

from folioflow import fixed_values as V
from folioflow.plans.queries import THROTTLE_GAP_MS

WS = r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
BREAK = r"[\n\x{0B}\f\r\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
SPACES = f"'{V.WHITESPACE}'"
NL = "chr(10)"


def _strip(text: str) -> str:
    return f"trim({text}, {SPACES})"


def _lines(text: str) -> str:
    """Kept lines of a text, joined by one space."""
    lines = f"list_transform(regexp_split_to_array({text}, '{BREAK}'), lambda l: {_strip('l')})"
    keep = (
        r"lambda l: l <> '' AND NOT regexp_matches(l, '^\p{Nd}+$')"
        rf" AND NOT regexp_matches(l, '(?i)({V.PAGE_MARK})[{WS}]*\p{{Nd}}+$')"
        rf" AND NOT regexp_matches(l, '^[-–—{WS}]*\p{{Nd}}+[-–—{WS}]*$')"
    )
    return f"array_to_string(list_filter({lines}, {keep}), ' ')"


def _closed(joined: str) -> str:
    text = f"regexp_replace({joined}, '  +', ' ', 'g')"
    return f"CASE WHEN {text} = '' OR right({text}, 1) IN ('.', '!', '?') THEN {text} ELSE {text} || '.' END"


def _clean(text: str) -> str:
    return _closed(_lines(text))


def _parts(source: str, key: str, text: str, name: str = "parts") -> str:
    """Recursive CTEs cutting one part per step off the rest of each text."""
    n = V.PART_CHARS
    cut = (
        f"coalesce(nullif(length(regexp_extract(left(rest, {n}), '(?s)^(.*[.!?][{WS}]+)', 1)), 0),"
        f" CASE WHEN contains(left(rest, {n}), ' ')"
        f" THEN length(regexp_extract(left(rest, {n}), '(?s)^(.*) ', 1)) END, {n})"
    )
    return f"""{name}_steps AS (
  SELECT {key}, 0 AS step, CAST(NULL AS VARCHAR) AS part, {text} AS rest FROM {source}
  UNION ALL
  SELECT {key}, step + 1,
         CASE WHEN length(rest) > {n} THEN {_strip('left(rest, k)')} ELSE rest END,
         CASE WHEN length(rest) > {n} THEN {_strip('substring(rest, k + 1)')} ELSE '' END
  FROM (SELECT *, {cut} AS k FROM {name}_steps WHERE rest <> '')),
{name} AS (SELECT {key}, CAST(step - 1 AS INTEGER) AS part_index, part FROM {name}_steps WHERE step > 0)"""


def _codes(column: str, labels: dict[str, str], otherwise: str) -> str:
    whens = " ".join(f"WHEN '{code}' THEN '{name}'" for code, name in labels.items())
    return f"CASE {column} {whens} ELSE {otherwise} END"


def _list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


CATALOG_COLUMNS = "id, title, author, cover_url, book_id, parts_count, voice, category, file_hash, added_by, created_at"

VIEWS = {
    "raw_docs": """SELECT doc_id, text || chr(10) || doc_id || chr(10) || 'Página ' || doc_id
        || chr(10) || '- 3 -' || chr(10) || 'body page 12' || chr(10) || 'tail  text' AS text
        FROM documents""",
    "cleaned": f"SELECT doc_id, {_clean('text')} AS cleaned FROM raw_docs",
    "uploads": """SELECT doc_id AS upload_id,
        CASE doc_id % 9 WHEN 0 THEN '_-_.pdf'
          WHEN 1 THEN 'notes ' || doc_id || '.txt'
          WHEN 2 THEN lang || '_vol-' || doc_id || '.PDF'
          WHEN 3 THEN 'x.' || source || '.pdf'
          ELSE source || '_doc-' || doc_id || '.pdf' END AS file_name,
        CASE WHEN doc_id % 50 = 7 THEN 0 ELSE n_chars * 2000 END AS size_bytes,
        CASE doc_id % 8 WHEN 3 THEN NULL WHEN 4 THEN '' ELSE 'Novela' END AS category,
        text, CASE doc_id % 3 WHEN 0 THEN 'cover/' || doc_id WHEN 1 THEN '' END AS cover_url,
        'u' || (doc_id % 7) AS added_by, sha256(text) AS file_hash,
        TIMESTAMP '2024-01-02' + to_seconds(doc_id) AS arrived_at
        FROM (SELECT * REPLACE (
          CASE WHEN doc_id % 40 = 13 THEN chr(10) || ' 12 ' || chr(10) || '- 3 -' ELSE text END AS text)
          FROM documents)""",
    "lines": f"""SELECT doc_id, unnest(string_split(text, {NL})) AS text,
        CAST(generate_subscripts(string_split(text, {NL}), 1) - 1 AS INTEGER) AS pos FROM documents""",
    "pieces": """SELECT doc_id, pos, unnest(regexp_extract_all(text, '(?s).{1,40}')) AS text,
        CAST(generate_subscripts(regexp_extract_all(text, '(?s).{1,40}'), 1) - 1 AS INTEGER) AS span FROM lines""",
    "spans": """SELECT doc_id, pos // 5 AS page, pos % 5 // 2 AS block, pos % 5 % 2 AS line, span,
        CASE WHEN pos % 13 = 12 THEN 1 ELSE 0 END AS block_type,
        (pos % 5) * 19e1 AS y0, (pos % 5) * 19e1 + 12 AS y1, 8e2 AS page_height,
        CASE WHEN pos % 7 = 0 THEN 8e0 WHEN span % 4 = 1 THEN 11.96e0 WHEN span % 4 = 2 THEN 11.4e0
          WHEN span % 4 = 3 THEN 11.3e0 ELSE 12e0 END AS size, text
        FROM pieces""",
    "page_texts": f"""SELECT doc_id, pos // 5 AS page, string_agg(text, {NL} ORDER BY pos) AS text
        FROM lines GROUP BY ALL""",
    "catalog": f"""SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, nullif(source, 'src0') AS author,
        CASE WHEN doc_id % 4 <> 1 THEN 'cover/' || doc_id END AS cover_url, 'b' || doc_id AS book_id,
        CASE WHEN doc_id % 10 <> 0 THEN CAST(ceil(n_chars / 1e3) AS INTEGER) END AS parts_count,
        CASE doc_id % 3 WHEN 1 THEN '{V.DEFAULT_VOICE}' WHEN 2 THEN 'es-ES-ElviraNeural' END AS voice,
        CASE WHEN lang = 'fr' THEN 'Novela' WHEN lang = 'de' THEN 'Historia' WHEN lang = 'es' THEN 'Sin mapa'
          WHEN doc_id % 2 = 1 THEN '' END AS category,
        sha256(text) AS file_hash, 'u' || (doc_id % 7) AS added_by,
        TIMESTAMP '2024-01-01' + to_seconds(doc_id) AS created_at, lang FROM documents""",
    "known_catalog": "SELECT * EXCLUDE (lang) FROM catalog WHERE lang <> 'en'",
    "parts_required": """SELECT id, book_id, CAST(unnest(range(parts_count)) AS INTEGER) AS part_index, 'v1' AS voice
        FROM catalog WHERE parts_count > 0""",
    "stored_text": "SELECT book_id, part_index FROM parts_required WHERE (id + part_index) % 7 <> 0",
    "stored_audio": "SELECT book_id, part_index, voice AS voice_slug FROM parts_required WHERE (id + part_index) % 3 = 0",
    "searchable": "SELECT c.* REPLACE (replace(d.text, chr(10), ' ') AS title) FROM catalog c JOIN documents d ON c.id = d.doc_id",
    "probes": "SELECT unnest([min(file_hash), max(file_hash), 'none']) AS file_hash FROM uploads",
    "picked": """SELECT *, (user_id * 31 + (event_id % 8) * 97) % (SELECT count(*) FROM documents) AS book,
        (user_id * 31 + (event_id % 10) * 97) % (SELECT count(*) FROM documents) AS wanted FROM events""",
    "listening": """SELECT e.user_id, d.doc_id AS global_book_id, e.ts, e.event_id,
        CASE event_type WHEN 'view' THEN 'tick' WHEN 'click' THEN 'ended' WHEN 'signup' THEN 'duration'
          WHEN 'error' THEN 'seek' WHEN 'purchase' THEN 'restart' END AS kind,
        CASE WHEN event_type = 'error' THEN CAST(CAST(floor(value) AS BIGINT) % 6 - 1 AS DOUBLE)
          WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 0e0 ELSE value END AS value,
        CAST(greatest(1, ceil(n_chars / 2e2)) AS INTEGER) AS parts
        FROM picked e JOIN documents d ON d.doc_id = e.book""",
    "user_books": """SELECT user_id, CASE WHEN event_id % 101 = 0 THEN -1 ELSE book END AS global_book_id,
        CASE WHEN min(event_id) % 4 <> 0 THEN CAST(min(event_id) // 7 % 3 AS INTEGER) END AS current_part_index,
        max(value) AS "current_time",
        CASE WHEN count(*) % 3 <> 0 THEN min(value) * 10 END AS total_time,
        CAST(CAST(floor(max(value)) AS BIGINT) % 3 * 50 AS INTEGER) AS progress, min(ts) AS added_at
        FROM picked GROUP BY 1, 2""",
    "requests": "SELECT user_id, wanted AS global_book_id, ts, event_id, value, event_type FROM picked",
    "library": """SELECT u.user_id, c.id, c.title, coalesce(c.author, '') AS author,
        coalesce(c.cover_url, '') AS cover_url, coalesce(u.progress, 0) AS progress, '' AS duration,
        coalesce(u."current_time", 0) AS "current_time", coalesce(u.total_time, 0) AS total_time, u.added_at,
        c.book_id, coalesce(c.parts_count, 1) AS parts_count,
        coalesce(u.current_part_index, 0) AS current_part_index, c.voice, c.category, c.file_hash
        FROM user_books u JOIN catalog c ON c.id = u.global_book_id""",
    "responses": """SELECT user_id AS session, CAST(event_id % 21 AS INTEGER) AS question,
        CAST(CAST(floor(value) AS BIGINT) % 4 AS INTEGER) AS value, ts, event_id FROM events""",
    "answers": """SELECT * FROM responses
        QUALIFY row_number() OVER (PARTITION BY session, question ORDER BY ts DESC, event_id DESC) = 1""",
    "patients": """SELECT c_custkey AS id, c_name AS name, nullif(c_mktsegment, 'MACHINERY') AS diagnosis,
        CASE WHEN c_acctbal < 0 THEN 'inactive' WHEN c_acctbal > 5000 THEN 'completed' ELSE 'active' END AS status
        FROM customer""",
    "appointments": """SELECT o_orderkey AS id, o_custkey AS patient_id,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'initial' WHEN '2-HIGH' THEN 'assessment'
          WHEN '3-MEDIUM' THEN 'followup' ELSE o_orderpriority END AS type,
        CASE o_orderstatus WHEN 'O' THEN 'scheduled' WHEN 'F' THEN 'completed' ELSE 'cancelled' END AS status
        FROM orders""",
    "feed": """SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text AS summary, source,
        upper(lang) AS category, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 5 = 0 END AS is_new FROM documents""",
    "tests": """SELECT p_partkey AS id, p_name AS name, p_brand AS short_name,
        ['cognitive', 'personality', 'mood', 'anxiety', 'trauma', 'other'][p_size % 6 + 1] AS category,
        ['high', 'moderate', 'experimental'][p_size % 3 + 1] AS validity,
        ['minimal', 'mild', 'moderate', 'severe', 'none'][p_size % 5 + 1] AS severity FROM part""",
    "messages": """SELECT conv_id, turn, role, CASE WHEN turn % 3 = 2 THEN 'evidence' ELSE 'reasoning' END AS type,
        CASE WHEN turn % 5 = 4 THEN ' ' || chr(9) || ' ' ELSE text END AS content FROM conversations""",
    "sources": """SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN []
          ELSE list_filter(string_split(text, chr(10)), lambda x: x <> '') END AS authors,
        CAST(doc_id % 35 + 1990 AS INTEGER) AS year FROM documents""",
    "accounts": """SELECT c_custkey AS id,
        CASE c_custkey % 3 WHEN 1 THEN '' WHEN 2 THEN c_name END AS full_name,
        lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment) || '.example' AS email FROM customer""",
}

GATE = f"""checked AS (
  SELECT *, {_clean('text')} AS cleaned,
    CASE WHEN coalesce(category, '') = '' THEN 'no_category'
      WHEN size_bytes > {V.MAX_UPLOAD_BYTES} THEN 'too_large' END AS before FROM uploads),
judged AS (
  SELECT *, CASE WHEN NOT ends_with(lower(file_name), '.pdf') THEN 'not_pdf'
      WHEN size_bytes = 0 THEN 'empty_file' WHEN cleaned = '' THEN 'no_text' END AS after FROM checked),
gate AS (
  SELECT *, coalesce(before,
    CASE WHEN file_hash IN (SELECT file_hash FROM known_catalog)
      OR EXISTS (SELECT 1 FROM judged w WHERE w.file_hash = j.file_hash AND w.upload_id < j.upload_id
                 AND w.before IS NULL AND w.after IS NULL) THEN 'duplicate' END,
    after) AS reject_reason FROM judged j),
accepted AS (SELECT * FROM gate WHERE reject_reason IS NULL),
{_parts('accepted', 'upload_id', 'cleaned')},
counts AS (SELECT upload_id, CAST(count(*) AS INTEGER) AS parts_count FROM parts GROUP BY 1),
candidates AS (
  SELECT a.upload_id AS id,
    coalesce(nullif({_strip("translate(regexp_replace(file_name, '(?s)[.][^.]*$', ''), '_-', '  ')")}, ''),
      '{V.DEFAULT_TITLE}') AS title,
    '{V.UPLOAD_AUTHOR}' AS author, coalesce(nullif(cover_url, ''), '{V.DEFAULT_COVER}') AS cover_url,
    file_hash AS book_id, c.parts_count, '{V.DEFAULT_VOICE}' AS voice, category, file_hash, added_by, arrived_at AS created_at,
    '~' || (c.parts_count * {V.MINUTES_PER_PART}) || 'min' AS duration, 0 AS total_time
  FROM accepted a JOIN counts c USING (upload_id))"""

FOLD = f"""ev AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, global_book_id ORDER BY ts, event_id) AS rn FROM {{source}}),
f AS (
  SELECT DISTINCT user_id, global_book_id, CAST(0 AS BIGINT) AS rn, 0 AS current_part_index,
    0e0 AS "current_time", 0e0 AS total_time, 0 AS progress FROM {{source}}
  UNION ALL
  SELECT f.user_id, f.global_book_id, ev.rn,
    CASE WHEN kind = 'restart' THEN 0
      WHEN kind = 'seek' AND value >= 0 AND value < parts THEN CAST(value AS INTEGER)
      WHEN kind = 'ended' AND current_part_index < parts - 1 THEN current_part_index + 1
      ELSE current_part_index END,
    CASE WHEN kind = 'restart' OR (kind = 'seek' AND value >= 0 AND value < parts)
        OR (kind = 'ended' AND current_part_index < parts - 1) THEN 0e0
      WHEN kind = 'tick' THEN value ELSE "current_time" END,
    CASE WHEN kind = 'duration' AND value <> 0 THEN round(value) ELSE total_time END,
    CASE WHEN kind = 'restart' THEN 0
      WHEN kind = 'tick' THEN CAST(round(CAST(current_part_index AS DOUBLE) / parts * 1e2
        + least(value / {V.PART_SECONDS}e0 * (1e2 / parts), 1e2 / parts)) AS INTEGER)
      ELSE progress END
  FROM f JOIN ev ON ev.user_id = f.user_id AND ev.global_book_id = f.global_book_id AND ev.rn = f.rn + 1)"""

THROTTLE = f"""tk AS (
  SELECT user_id, event_id AS tick_id, epoch_us(ts) // 1000 AS clock,
    row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS rn FROM {{source}}),
walk AS (
  SELECT user_id, tick_id, clock, rn, clock AS last, true AS saved FROM tk WHERE rn = 1
  UNION ALL
  SELECT t.user_id, t.tick_id, t.clock, t.rn,
    CASE WHEN t.clock - w.last > {THROTTLE_GAP_MS} THEN t.clock ELSE w.last END,
    t.clock - w.last > {THROTTLE_GAP_MS}
  FROM walk w JOIN tk t ON t.user_id = w.user_id AND t.rn = w.rn + 1)"""

LAST_STATE = """SELECT user_id, global_book_id, current_part_index, "current_time", total_time, progress FROM f
        QUALIFY row_number() OVER (PARTITION BY user_id, global_book_id ORDER BY rn DESC) = 1"""

MAIN_SIZE = """weights AS (
  SELECT doc_id, round(size, 1) AS size, sum(length(trim(text, {spaces}))) AS weight, min([page, block, line, span]) AS seen
  FROM spans WHERE block_type = 0 AND page < {sample} AND length(trim(text, {spaces})) > 2 GROUP BY 1, 2),
main_size AS (
  SELECT doc_id, size AS main FROM weights
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, seen) = 1),
body_lines AS (
  SELECT s.doc_id, page, block, line, trim(string_agg(text, '' ORDER BY span), {spaces}) AS text
  FROM spans s JOIN main_size m USING (doc_id)
  WHERE block_type = 0 AND page < {pages} AND NOT (y1 < page_height * {top}e0 OR y0 > page_height * {bottom}e0)
    AND round(size, 1) >= main - {tol}e0 GROUP BY ALL),
bodies AS (
  SELECT doc_id, string_agg(text, chr(10) ORDER BY page, block, line) AS text FROM body_lines WHERE text <> ''
  GROUP BY doc_id),
dropped AS (
  SELECT doc_id, CAST(count(DISTINCT page) FILTER (page >= {pages}) AS INTEGER) AS pages_dropped
  FROM spans WHERE block_type = 0 GROUP BY doc_id)""".format(
    spaces=SPACES,
    sample=V.SAMPLE_PAGES,
    pages=V.MAX_PAGES,
    top=V.TOP_MARGIN,
    bottom=V.BOTTOM_MARGIN,
    tol=V.SIZE_TOLERANCE,
)

SLUG = rf"""coalesce(nullif(left(regexp_replace({_strip("regexp_replace({0}, '[^\\p{{L}}\\p{{N}}_" + WS.replace('{', '{{').replace('}', '}}') + r"-]', '', 'g')")},
  '[{WS.replace('{', '{{').replace('}', '}}')}]+', '_', 'g'), {V.SLUG_CHARS}), ''), '{V.DEFAULT_SLUG}')""".replace("\\\\", "\\")

QUERIES = {
    "clean_text": "SELECT doc_id, cleaned FROM cleaned",
    "split_parts": f"WITH RECURSIVE {_parts('documents', 'doc_id', 'text')} SELECT doc_id, part_index, part FROM parts",
    "parts_manifest": f"""WITH RECURSIVE {_parts('cleaned', 'doc_id', 'cleaned')}
        SELECT doc_id, part_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS parts_count,
          doc_id || '/text/part_' || part_index || '.txt' AS path,
          CAST(length(part) AS INTEGER) AS part_chars, sha256(part) AS part_hash FROM parts""",
    "body_text": f"""WITH {MAIN_SIZE} SELECT doc_id, body, pages_dropped
        FROM (SELECT doc_id, {_clean('text')} AS body FROM bodies) JOIN dropped USING (doc_id) WHERE body <> ''""",
    "page_preview": f"""WITH totals AS (
          SELECT doc_id, CAST(max(page) + 1 AS INTEGER) AS total_pages,
            string_agg(text, {NL} ORDER BY page) FILTER (page < {V.PREVIEW_CLEAN_PAGES}) AS text
          FROM page_texts GROUP BY doc_id),
        samples AS (SELECT doc_id, total_pages, {_clean('text')} AS cleaned FROM totals)
        SELECT p.doc_id, CAST(p.page + 1 AS INTEGER) AS page, CAST(length(p.text) AS INTEGER) AS chars_raw,
          left(p.text, {V.PREVIEW_PAGE_CHARS}) AS preview, total_pages,
          CAST(length(cleaned) AS INTEGER) AS cleaned_text_length,
          left(cleaned, {V.PREVIEW_CLEAN_CHARS}) AS cleaned_text_preview,
          right(cleaned, {V.PREVIEW_CLEAN_CHARS}) AS cleaned_text_end
        FROM page_texts p JOIN samples USING (doc_id) WHERE p.page < {V.PREVIEW_PAGES}""",
    "derive_title": f"""SELECT upload_id,
          coalesce(nullif({_strip("translate(regexp_replace(file_name, '(?s)[.][^.]*$', ''), '_-', '  ')")}, ''),
            '{V.DEFAULT_TITLE}') AS title FROM uploads""",
    "slug_key": f"SELECT doc_id AS id, {SLUG.format('text')} AS title_slug, {SLUG.format(chr(39).join(['coalesce(source, ', '', ')']))} AS author_slug FROM documents",
    "file_hash": "SELECT doc_id, sha256(text) AS file_hash FROM documents",
    "intake_gate": f"WITH RECURSIVE {GATE} SELECT upload_id, file_name, reject_reason FROM gate",
    "new_documents": """SELECT file_hash, min(id) AS id FROM catalog
        WHERE file_hash NOT IN (SELECT file_hash FROM known_catalog) GROUP BY file_hash""",
    "catalog_candidates": f"WITH RECURSIVE {GATE} SELECT * FROM candidates",
    "catalog_apply": f"""WITH RECURSIVE {GATE} SELECT {CATALOG_COLUMNS} FROM known_catalog
        UNION ALL SELECT {CATALOG_COLUMNS} FROM candidates""",
    "catalog_view": """SELECT id, title, coalesce(author, '') AS author, coalesce(cover_url, '') AS cover_url,
          0 AS progress, '' AS duration, 0e0 AS "current_time", 0e0 AS total_time, created_at AS added_at, book_id,
          coalesce(parts_count, 1) AS parts_count, 0 AS current_part_index, voice, category, file_hash
        FROM catalog ORDER BY added_at DESC, id""",
    "user_library": "SELECT * FROM library ORDER BY user_id, added_at DESC, id",
    "library_page": """SELECT user_id, CAST(n - 3 AS INTEGER) AS place, id, title, progress, added_at FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY added_at DESC NULLS FIRST, id) AS n FROM library)
        WHERE n BETWEEN 4 AND 6""",
    "library_orphans": """SELECT global_book_id, count(*) AS rows FROM user_books
        WHERE global_book_id NOT IN (SELECT id FROM catalog) GROUP BY 1""",
    "continue_shelf": "SELECT user_id, id, title, progress FROM library WHERE progress > 0 AND progress < 100",
    "history": """SELECT user_id, id, title, progress, added_at FROM library WHERE progress > 0
        ORDER BY user_id, added_at DESC, id""",
    "catalog_by_category": f"""SELECT id, title, category FROM catalog
        WHERE coalesce(nullif(category, ''), '{V.NO_CATEGORY}') = '{V.NO_CATEGORY}'""",
    "catalog_search": """SELECT id, title, author, category FROM searchable
        WHERE contains(lower(title), 'ther th') OR contains(lower(author), 'ther th') OR contains(lower(category), 'ther th')""",
    "used_categories": f"""WITH listed AS (
          SELECT unnest({_list(V.CATEGORIES)}) AS category,
            CAST(generate_subscripts({_list(V.CATEGORIES)}, 1) - 1 AS INTEGER) AS ord)
        SELECT ord, category FROM listed WHERE category = '{V.ALL_CATEGORIES}'
          OR category IN (SELECT coalesce(nullif(category, ''), '{V.NO_CATEGORY}') FROM catalog) ORDER BY ord""",
    "resolve_play": """SELECT q.user_id, u.user_id IS NULL AS to_add, c.id, c.title,
          coalesce(c.author, '') AS author, coalesce(c.cover_url, '') AS cover_url,
          coalesce(u.progress, 0) AS progress, '' AS duration, coalesce(u."current_time", 0) AS "current_time",
          coalesce(u.total_time, 0) AS total_time,
          CASE WHEN u.user_id IS NULL THEN c.created_at ELSE u.added_at END AS added_at, c.book_id,
          coalesce(c.parts_count, 1) AS parts_count, coalesce(u.current_part_index, 0) AS current_part_index,
          c.voice, c.category, c.file_hash
        FROM (SELECT DISTINCT user_id, global_book_id FROM requests WHERE event_type = 'click') q
        JOIN catalog c ON c.id = q.global_book_id
        LEFT JOIN user_books u ON u.user_id = q.user_id AND u.global_book_id = q.global_book_id""",
    "category_override": f"""WITH offered AS (
          SELECT user_id, (user_id * 31 + (event_id % 5) * 97) % (SELECT count(*) FROM documents) AS id, ts, event_id,
            {_list(V.CATEGORIES)}[event_id % {len(V.CATEGORIES)} + 1] AS chosen
          FROM events),
        chosen AS (
          SELECT user_id, id, chosen FROM offered WHERE chosen <> '{V.ALL_CATEGORIES}'
          QUALIFY row_number() OVER (PARTITION BY user_id, id ORDER BY ts DESC, event_id DESC) = 1)
        SELECT user_id, id, title, coalesce(chosen, category) AS category FROM library LEFT JOIN chosen USING (user_id, id)""",
    "library_search": """SELECT user_id, id, title, category FROM library WHERE id IN (
          SELECT id FROM searchable WHERE contains(lower(title), 'an he')
            OR contains(lower(author), 'an he') OR contains(lower(category), 'an he'))""",
    "stored_catalog": "SELECT * FROM known_catalog",
    "hash_known": "SELECT file_hash, file_hash IN (SELECT file_hash FROM known_catalog) AS known FROM probes",
    "library_categories": f"""WITH listed AS (
          SELECT unnest({_list(V.CATEGORIES)}) AS category,
            CAST(generate_subscripts({_list(V.CATEGORIES)}, 1) - 1 AS INTEGER) AS ord)
        SELECT ord, category FROM listed WHERE category = '{V.ALL_CATEGORIES}'
          OR category IN (SELECT coalesce(nullif(category, ''), '{V.NO_CATEGORY}') FROM library) ORDER BY ord""",
    "one_library": "SELECT * FROM library WHERE user_id = 7 ORDER BY added_at DESC, id",
    "library_add": """SELECT * FROM user_books UNION ALL
        SELECT user_id, global_book_id, 0, 0e0, 0e0, 0, min(ts) FROM requests r
        WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM user_books u
          WHERE u.user_id = r.user_id AND u.global_book_id = r.global_book_id)
        GROUP BY user_id, global_book_id""",
    "library_remove": """SELECT * FROM user_books u WHERE NOT EXISTS (SELECT 1 FROM requests r
        WHERE event_type = 'error' AND u.user_id = r.user_id AND u.global_book_id = r.global_book_id)""",
    "library_patch": """WITH patches AS (
          SELECT *, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 9 AS INTEGER) END AS a,
            CASE WHEN event_id % 3 <> 0 THEN value END AS b,
            CASE WHEN event_id % 7 = 0 THEN value * 2 END AS c,
            CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 101 AS INTEGER) END AS d
          FROM requests WHERE event_type = 'view'),
        merged AS (
          SELECT user_id, global_book_id, last(a ORDER BY ts, event_id) FILTER (a IS NOT NULL) AS a,
            last(b ORDER BY ts, event_id) FILTER (b IS NOT NULL) AS b,
            last(c ORDER BY ts, event_id) FILTER (c IS NOT NULL) AS c,
            last(d ORDER BY ts, event_id) FILTER (d IS NOT NULL) AS d FROM patches GROUP BY 1, 2)
        SELECT user_id, global_book_id, coalesce(a, current_part_index) AS current_part_index,
          coalesce(b, "current_time") AS "current_time", coalesce(c, total_time) AS total_time,
          coalesce(d, progress) AS progress, added_at
        FROM user_books LEFT JOIN merged USING (user_id, global_book_id)""",
    "audio_plan": """SELECT r.book_id, r.part_index, r.voice,
          r.book_id || '/audio/part_' || r.part_index || '_' || r.voice || '.mp3' AS path,
          CASE WHEN a.book_id IS NOT NULL THEN 'hit' WHEN t.book_id IS NOT NULL THEN 'generate'
            ELSE 'missing_text' END AS state
        FROM parts_required r
        LEFT JOIN stored_audio a ON a.book_id = r.book_id AND a.part_index = r.part_index AND a.voice_slug = r.voice
        LEFT JOIN stored_text t ON t.book_id = r.book_id AND t.part_index = r.part_index""",
    "prefetch_plan": """WITH following AS (
          SELECT DISTINCT c.book_id, CAST(coalesce(current_part_index, 0) + 1 AS INTEGER) AS part_index, 'v1' AS voice
          FROM user_books u JOIN catalog c ON c.id = u.global_book_id
          WHERE coalesce(current_part_index, 0) < c.parts_count - 1)
        SELECT * FROM following n WHERE NOT EXISTS (SELECT 1 FROM stored_audio a
          WHERE a.book_id = n.book_id AND a.part_index = n.part_index AND a.voice_slug = n.voice)""",
    "parts_gap_report": """SELECT book_id, coalesce(parts_count, 0) AS declared,
          CAST(count(t.part_index) AS INTEGER) AS stored,
          CAST(coalesce(parts_count, 0) - count(t.part_index) AS INTEGER) AS missing
        FROM catalog LEFT JOIN stored_text t USING (book_id) GROUP BY book_id, parts_count""",
    "missing_parts": """SELECT book_id, part_index FROM parts_required
        EXCEPT SELECT book_id, part_index FROM stored_text""",
    "progress_pct": f"""SELECT event_id,
          CAST(round(CAST(event_id % parts AS DOUBLE) / parts * 1e2
            + least(value / {V.PART_SECONDS}e0 * (1e2 / parts), 1e2 / parts)) AS INTEGER) AS progress,
          value / {V.PART_SECONDS}e0 AS in_part FROM listening WHERE kind = 'tick'""",
    "format_time": """WITH t AS (SELECT event_id, value * 60 AS s FROM events),
        p AS (SELECT event_id, CAST(floor(s / 3600) AS BIGINT) AS h, CAST(floor((s % 3600) / 60) AS BIGINT) AS m,
          CAST(floor(s % 60) AS BIGINT) AS s FROM t)
        SELECT event_id, CASE WHEN h > 0 THEN h || ':' || lpad(CAST(m AS VARCHAR), 2, '0') ELSE CAST(m AS VARCHAR) END
          || ':' || lpad(CAST(s AS VARCHAR), 2, '0') AS label FROM p""",
    "seek_clamp": """SELECT event_id,
          least(value + 15, CASE WHEN event_id % 4 <> 0 THEN 3e1 ELSE 0e0 END) AS forward,
          greatest(value - 15, 0e0) AS backward FROM events""",
    "playback_fold": f"WITH RECURSIVE {FOLD.format(source='listening')} {LAST_STATE}",
    "playback_saved": f"""WITH RECURSIVE listened_ticks AS (SELECT * FROM listening WHERE kind = 'tick'),
        {THROTTLE.format(source='listened_ticks')},
        saved_events AS (SELECT * FROM listening
          WHERE kind <> 'tick' OR event_id IN (SELECT tick_id FROM walk WHERE saved)),
        {FOLD.format(source='saved_events')} {LAST_STATE}""",
    "tick_throttle": f"""WITH RECURSIVE given AS (
          SELECT CASE WHEN event_id % 97 <> 5 THEN user_id END AS user_id, CASE WHEN event_id % 89 <> 7 THEN ts END AS ts,
            event_id FROM events),
        judged AS (SELECT * FROM given WHERE user_id IS NOT NULL AND ts IS NOT NULL),
        {THROTTLE.format(source='judged')}
        SELECT user_id, tick_id, clock, NULL AS reason FROM walk WHERE saved
        UNION ALL SELECT user_id, event_id, NULL, CASE WHEN user_id IS NULL THEN 'no_user' ELSE 'no_time' END
        FROM given WHERE user_id IS NULL OR ts IS NULL""",
    "responses_latest": """SELECT session, question, value,
          CAST(row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS INTEGER) AS position,
          (question + 1) / 21e0 * 100 AS answer_progress FROM answers""",
    "saved_answers": """SELECT s.session, s.question, a.value FROM
          (SELECT session, CAST(unnest(range(21)) AS INTEGER) AS question FROM (SELECT DISTINCT session FROM responses)) s
        LEFT JOIN answers a USING (session, question)""",
    "domain_profile": """SELECT session, question % 4 AS domain,
          CAST(floor(sum(value) * 1e2 / (count(*) * 3)) AS INTEGER) AS value, 100 AS full_mark
        FROM answers GROUP BY 1, 2""",
    "clinic_kpis": """SELECT 'active_patients' AS kpi, count(*) AS n FROM patients WHERE status = 'active'
        UNION ALL SELECT 'patients', count(*) FROM patients
        UNION ALL SELECT 'scheduled_appointments', count(*) FROM appointments WHERE status = 'scheduled'""",
    "scheduled_appointments": "SELECT id, patient_id, type FROM appointments WHERE status = 'scheduled'",
    "patient_search": """SELECT * FROM patients WHERE status = 'active'
        AND (contains(lower(name), 'uild') OR contains(lower(diagnosis), 'uild'))""",
    "feed_search": """SELECT id, title, source, category FROM feed WHERE lower(category) = 'en'
        AND (contains(lower(title), 'the') OR contains(lower(summary), 'the') OR contains(lower(source), 'the'))""",
    "test_search": """SELECT id, name, short_name, category FROM tests WHERE category = 'mood'
        AND (contains(lower(name), 'brand#1') OR contains(lower(short_name), 'brand#1'))""",
    "feed_new_count": """SELECT coalesce(bool_or(coalesce(is_new, false)), false) AS any_new,
          count(*) FILTER (is_new) AS new_count FROM feed
        WHERE contains(lower(title), 'src1') OR contains(lower(summary), 'src1') OR contains(lower(source), 'src1')""",
    "overlap_band": """SELECT event_id, p AS percentage,
          CASE WHEN p >= 70 THEN 'destructive' WHEN p >= 50 THEN 'warning' ELSE 'muted' END AS band
        FROM (SELECT event_id, CAST(floor(value) AS BIGINT) % 101 AS p FROM events)""",
    "code_labels": f"""SELECT 'test' AS kind, id, {_codes('category', V.TEST_CATEGORY_LABELS, 'category')} AS label,
          CASE validity WHEN 'high' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END AS stars FROM tests
        UNION ALL SELECT 'severity', id, {_codes('severity', V.SEVERITY_LABELS, 'NULL')}, NULL FROM tests
        UNION ALL SELECT 'appointment', id, {_codes('type', V.APPOINTMENT_TYPE_LABELS, 'NULL')}, NULL FROM appointments
        UNION ALL SELECT 'patient', id, {_codes('status', V.PATIENT_STATUS_LABELS, 'NULL')}, NULL FROM patients
        UNION ALL SELECT 'voice', id, {_codes('voice', V.VOICES, 'voice')}, NULL FROM catalog""",
    "citation": """SELECT id, array_to_string(authors[1:2], ', ')
          || CASE WHEN len(authors) > 2 THEN ' et al.' ELSE '' END || ' · ' || year AS citation,
          CASE WHEN len(authors) > 0 THEN array_to_string(authors, ', ') END AS "references",
          CAST(len(authors) AS INTEGER) AS n_authors FROM sources""",
    "message_class": f"""SELECT conv_id, turn,
          CASE WHEN role = 'user' THEN 'message-user' WHEN type = 'evidence' THEN 'message-evidence'
            ELSE 'message-reasoning' END AS style,
          CASE WHEN role <> 'user' THEN CASE WHEN type = 'evidence' THEN '{V.EVIDENCE_LABEL}'
            ELSE '{V.REASONING_LABEL}' END END AS caption,
          {_strip('content')} AS content FROM messages WHERE {_strip('content')} <> ''""",
    "display_name": """SELECT id, CASE WHEN full_name <> '' THEN full_name
          ELSE split_part(email, '@', 1) END AS display_name FROM accounts""",
    "format_date": f"""SELECT event_id, day(ts) || ' de ' || {_list(V.MONTHS_ES)}[month(ts)] || ' de ' || year(ts)
          || ', ' || strftime(ts, '%H:%M') AS long_date, strftime(ts, '%H:%M') AS clock FROM events""",
}


def sql(name: str) -> str:
    """The query with the views it needs put in front."""
    text = QUERIES[name]
    needed: list[str] = []

    def need(part: str) -> None:
        for view, body in VIEWS.items():
            if view not in needed and re.search(rf"\b(FROM|JOIN)\s+{view}\b", part):
                need(body)
                needed.append(view)

    need(text)
    views = ",\n".join(f"{view} AS ({VIEWS[view]})" for view in needed)
    found = re.match(r"WITH (RECURSIVE )?", text)
    if found:
        rest = text[found.end() :]
        head = "WITH " + (found.group(1) or "")
        return f"{head}{views},\n{rest}" if views else text
    return f"WITH {views}\n{text}" if views else text


def all_sql() -> dict[str, str]:
    return {name: sql(name) for name in QUERIES}
