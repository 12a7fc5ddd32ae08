"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from newsgraph.llm import chat_format, decontaminate, line_dedup, url_filter
from newsgraph.llm.catalog import EXTRA_CONVERSATION, EXTRA_TEXT


def _url_filter() -> str:
    listed = [(t, 0, 1) for t in url_filter.STRICT_TERMS] + [(t, w, 0) for t, w in url_filter.SOFT_TERMS.items()]
    values = ", ".join(f"('{t}', {w}, {s})" for t, w, s in listed)
    rules = sorted(url_filter.RULES, key=lambda r: -len(r.name))
    fits = [
        (f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')", r) for r in rules
    ]
    name = " ".join(f"WHEN {fit} THEN '{r.name}'" for fit, r in fits)
    verdict = " ".join(f"WHEN {fit} THEN '{r.verdict}'" for fit, r in fits)
    return f"""
    WITH located AS (
      SELECT page_id, url,
        CASE WHEN contains(url, '://') THEN
          translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'),
                    '{url_filter.UPPER}', '{url_filter.LOWER}') ELSE '' END AS host,
        CASE WHEN contains(url, '://') THEN
          regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
        coalesce(translate(url, '{url_filter.UPPER}', '{url_filter.LOWER}'), '') AS u
      FROM pages),
    found AS (
      SELECT u, sum(strict)::bigint AS n_strict, sum(weight)::bigint AS soft_weight,
        string_agg(term, ' ' ORDER BY term) AS terms
      FROM (SELECT DISTINCT u FROM located) JOIN (VALUES {values}) v(term, weight, strict) ON contains(u, term)
      WHERE regexp_matches(u, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)') GROUP BY u),
    counted AS (
      SELECT l.*, coalesce(n_strict, 0) AS n_strict, coalesce(soft_weight, 0) AS soft_weight, coalesce(terms, '') AS terms
      FROM located l LEFT JOIN found f ON l.u = f.u)
    SELECT page_id, host, path, CASE {name} END AS rule,
      CASE {verdict} WHEN n_strict > 0 OR soft_weight >= {url_filter.SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
      n_strict, soft_weight, terms
    FROM counted"""


def _chat_format() -> str:
    control = r"([<\[])(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|/?SYS>|/?INST\])"
    escaped = lambda c: f"regexp_replace({c}, '{control}', '\\1\\\\\\2\\3', 'g')"
    head = len(chat_format.START) + len(chat_format.TEXT) + len(chat_format.END)
    return f"""
    WITH rows AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT {EXTRA_CONVERSATION}, 0, 'user', '{EXTRA_TEXT}'
      UNION ALL SELECT {EXTRA_CONVERSATION}, 1, 'assistant', '{EXTRA_TEXT}'),
    laid AS (
      SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM rows)
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      sum(CASE WHEN role = '{chat_format.TRAINED_ROLE}' THEN length(text) ELSE 0 END)::bigint AS loss_chars,
      sha256(string_agg(CASE WHEN role = '{chat_format.TRAINED_ROLE}' THEN text ELSE '' END, ''
                        ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
      sum(length({escaped("text")}) + CASE WHEN before IS NOT DISTINCT FROM role THEN {len(chat_format.AGAIN)}
          ELSE {head} + length({escaped("role")}) END)::bigint AS formatted_chars
    FROM laid GROUP BY conv_id"""


def _folded(column: str = "text") -> str:
    return f"translate({column}, '{url_filter.UPPER}', '{url_filter.LOWER}')"


def _decontamination() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = f"coalesce(regexp_extract_all({_folded()}, '{word}'), []::varchar[])"
    size = decontaminate.WINDOW
    return f"""
    WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {words} AS words FROM documents),
    items AS (SELECT DISTINCT coalesce(item_id::varchar, '') AS item_id, {words} AS words FROM benchmark),
    item_windows AS (
      SELECT DISTINCT item_id, least(len(words), {size}) AS size, array_to_string(words[i : i + {size - 1}], ' ') AS told
      FROM (SELECT *, unnest(range(1, greatest(len(words) - {size - 1}, 1) + 1)) AS i FROM items WHERE len(words) > 0)),
    places AS (
      SELECT row, size, i, array_to_string(words[i : i + size - 1], ' ') AS told
      FROM (SELECT row, words, size, unnest(range(1, len(words) - size + 2)) AS i
            FROM docs, (SELECT DISTINCT size FROM item_windows) WHERE len(words) >= size)),
    hits AS (SELECT row, size, i, told FROM places SEMI JOIN item_windows USING (size, told)),
    covered AS (
      SELECT row, count(DISTINCT place) AS n_hit
      FROM (SELECT row, unnest(range(i, i + size)) AS place FROM hits) GROUP BY row),
    held AS (
      SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS listed
      FROM (SELECT DISTINCT row, item_id FROM hits JOIN item_windows USING (size, told)) GROUP BY row)
    SELECT doc_id, len(words)::bigint AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM docs LEFT JOIN covered USING (row) LEFT JOIN held USING (row)"""


def _near_dup() -> str:
    word = r"[^\x20\x09-\x0D]+"
    words = f"coalesce(regexp_extract_all({_folded()}, '{word}'), []::varchar[])"
    return f"""
    WITH RECURSIVE docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {words} AS words FROM documents),
    shingles AS (
      SELECT DISTINCT row, array_to_string(words[i : i + 4], ' ') AS shingle
      FROM (SELECT row, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM docs WHERE len(words) > 0)),
    classed AS (
      SELECT row, count(*) AS n, sha256(string_agg(shingle, chr(10) ORDER BY shingle)) AS class FROM shingles GROUP BY row),
    classes AS (SELECT class, n, min(row) AS row FROM classed GROUP BY class, n),
    sets AS (SELECT class, n, shingle FROM classes JOIN shingles USING (row)),
    links AS (
      SELECT a.class AS x, b.class AS y FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.class <> b.class
      GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
    reached(x, y) AS (
      SELECT class, class FROM classes UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x),
    least_ids AS (SELECT class, min(doc_id) AS least FROM classed JOIN docs USING (row) GROUP BY class),
    components AS (SELECT x AS class, min(least) AS component_id FROM reached JOIN least_ids ON y = class GROUP BY x)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
      coalesce(component_id, doc_id) = doc_id AS kept
    FROM docs LEFT JOIN classed USING (row) LEFT JOIN components USING (class)"""


def _turn_repair() -> str:
    # crc32 of ASCII strings by bytes, with the table made from its polynomial.
    step = "(CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
    table = f"list_transform(range(256), lambda n: list_reduce([n] || [0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda a, b: {step}))"
    folded = "list_reduce([4294967295] || list_transform(string_split(key, ''), lambda c: ascii(c)::bigint), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]))"
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    line = "r.role || ':' || r.text"
    add = lambda s, cost, letter, told: (
        f"CASE WHEN {s} IS NOT NULL THEN {{'cost': {s}.cost + {cost}, 'audit': {s}.audit || '{letter}', 'told': list_append({s}.told, {told})}} END"
    )
    gone = lambda s: f"CASE WHEN {s} IS NOT NULL THEN {{'cost': {s}.cost + 4, 'audit': {s}.audit || 'D', 'told': {s}.told}} END"
    keep = lambda s, role: f"CASE WHEN stays AND initial = '{role}' THEN {add(s, 'more', 'K', line)} END"
    rerole = lambda s, role: f"CASE WHEN stays THEN {add(s, '3 + more', 'R', repr(role + ':') + ' || r.text')} END"
    insert = lambda s, role: add(s, 3, "I", repr(role + ":"))
    before_user = ("s0", "s1", "s3")
    to_user = ", ".join([gone("s2")] + [f"{keep(s, 'u')}, {rerole(s, 'user')}" for s in before_user])
    opened = ", ".join(insert(s, "user") for s in before_user)
    return f"""
    WITH RECURSIVE crcs AS (SELECT {table} AS crc),
    keyed AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS key FROM conversations),
    drawn AS (SELECT keyed.*, xor({folded}, 4294967295) % 20 AS draw FROM keyed, crcs),
    damaged AS (
      SELECT conv_id, turn, CASE draw WHEN 4 THEN 'user' ELSE role END AS role,
        CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
      FROM drawn JOIN (VALUES (0), (1)) c(copy) ON copy = 0 OR draw = 3 WHERE draw <> 0),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
        trim(text, {white}) AS bare, left(role, 1) AS initial FROM damaged),
    faulted AS (
      SELECT *, CASE WHEN bare = '' THEN 'blank'
          WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
          WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM placed),
    rows AS (
      SELECT conv_id, i, role, text, initial, fault NOT IN ('blank', 'duplicate') AS stays,
        CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS more FROM faulted),
    counted AS (
      SELECT conv_id, max(i) AS n,
        coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::bigint AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
      FROM faulted GROUP BY conv_id),
    raw AS (
      SELECT conv_id, 0::bigint AS i, {{'cost': 0::bigint, 'audit': '', 'told': []::varchar[]}} AS s0,
        NULL::struct(cost bigint, audit varchar, told varchar[]) AS s1,
        NULL::struct(cost bigint, audit varchar, told varchar[]) AS s2,
        NULL::struct(cost bigint, audit varchar, told varchar[]) AS s3 FROM counted
      UNION ALL
      SELECT r.conv_id, r.i, {gone("s0")} AS s0, list_min([{gone("s1")}, {keep("s0", "s")}]) AS s1,
        list_min([{to_user}]) AS s2,
        list_min([{gone("s3")}, {keep("t2", "a")}, {rerole("t2", "assistant")}]) AS s3
      FROM (SELECT conv_id, i, s0, s1, s2, list_min([s3, {insert("t2", "assistant")}]) AS s3, t2
            FROM (SELECT *, list_min([s2, {opened}]) AS t2 FROM raw)) s
      JOIN rows r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1),
    ended AS (
      SELECT conv_id, list_min([s0, s3, {insert("t2", "assistant")}]) AS best
      FROM (SELECT raw.*, list_min([s2, {opened}]) AS t2
            FROM raw JOIN counted c ON raw.conv_id IS NOT DISTINCT FROM c.conv_id AND raw.i = c.n))
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
      coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost,
      coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.told, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id"""


def _line_dedup() -> str:
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    lines = "string_split(coalesce(text, ''), chr(10))"
    return f"""
    WITH lines AS (
      SELECT doc_id, unnest({lines}) AS line, generate_subscripts({lines}, 1) AS place FROM documents),
    keyed AS (
      SELECT *, translate(trim(line, {white}), '{line_dedup.UPPER}', '{line_dedup.LOWER}') AS key FROM lines),
    owners AS (
      SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= {line_dedup.LEAST_CHARS} GROUP BY key),
    judged AS (SELECT k.*, coalesce(owner < doc_id, false) AS gone FROM keyed k LEFT JOIN owners USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
    FROM judged GROUP BY doc_id"""


ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": _url_filter(),
    "op3_chat_format": _chat_format(),
    "op4_decontamination": _decontamination(),
    "op5_near_dup": _near_dup(),
    "op11_turn_repair": _turn_repair(),
    "op12_line_dedup": _line_dedup(),
}
