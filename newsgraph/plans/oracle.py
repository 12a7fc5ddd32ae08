"""The registered queries in DuckDB SQL, written independently of the operators."""

from __future__ import annotations

from itertools import product

from newsgraph.constants import LEGAL_ENDINGS, SHARE_CLASS_LETTERS, SHARE_CLASS_WORDS, TONE_COLUMNS
from newsgraph.plans.catalog import RANGES
from newsgraph.plans.domain import EVENT_SHIFT_DAYS, ORDER_ORGS, PART_ENDINGS

EVENT_ARTICLES = """
articles AS (
  SELECT ts AS "DATE", CAST(ts AS DATE) AS day, 'site_' || k AS SourceCommonName,
         'https://news.example/' || event_id AS URL,
         event_type IN ('click', 'view') AS E,
         event_type IN ('view', 'signup') AS S,
         event_type IN ('purchase', 'view') AS G,
         'org ' || user_id AS Organization,
         value - 40 AS Tone, value AS PositiveTone, CAST(k AS DOUBLE) / 10 AS NegativeTone,
         value + CAST(k AS DOUBLE) / 10 AS Polarity, CAST(k AS DOUBLE) / 5 AS ActivityDensity,
         CAST(k AS DOUBLE) / 100 AS SelfDensity, CAST(k AS DOUBLE) AS WordCount
  FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)
)"""

ORDER_ARTICLES = """
articles AS (
  SELECT CAST(o_orderdate AS DATE) AS day, o_orderstatus || ' ' || o_orderpriority AS Organization,
         o_orderpriority IN ('1-URGENT', '2-HIGH') AS E,
         o_orderpriority IN ('2-HIGH', '3-MEDIUM') AS S,
         o_orderpriority = '5-LOW' AS G,
         o_totalprice / 1000 - 250 AS Tone, CAST(o_custkey AS DOUBLE) AS WordCount
  FROM orders
)"""

SCORES = """
segmented AS (
  SELECT 'T' AS segment, * FROM articles
  UNION ALL SELECT 'E', * FROM articles WHERE E
  UNION ALL SELECT 'S', * FROM articles WHERE S
  UNION ALL SELECT 'G', * FROM articles WHERE G
),
tones AS (
  SELECT segment, day AS date, Organization AS org, sum(Tone) / nullif(sum(WordCount), 0) AS tone
  FROM segmented GROUP BY ALL
),
industry AS (
  SELECT segment, day AS date, sum(Tone) / nullif(sum(WordCount), 0) AS industry_tone
  FROM segmented GROUP BY ALL
),
diffs AS (
  SELECT t.segment, t.date, t.org, t.tone - i.industry_tone AS diff
  FROM tones t JOIN industry i ON t.segment = i.segment AND t.date = i.date
),
averages AS (SELECT segment, org, avg(diff) AS score FROM diffs GROUP BY ALL)"""

EVENT_SCORES = f"WITH {EVENT_ARTICLES}, {SCORES}"
ORDER_SCORES = f"WITH {ORDER_ARTICLES}, {SCORES}"

FEED = """
lines AS (SELECT *, replace(text, chr(10), ' ') AS one_line FROM documents),
toned AS (
  SELECT *, concat_ws(',', n_chars % 21 - 10, n_chars % 7, n_chars % 5, n_chars % 13,
                      doc_id % 17, doc_id % 3, n_chars) AS numbers FROM lines
),
feed AS (
  SELECT doc_id, source AS SourceCommonName, 'https://news.example/' || doc_id AS URL,
         TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS moment,
         replace(replace(replace(replace(one_line, ' the ', ';WB_ENV_CLIMATE;'),
                 ' of ', ';UNGP_FORESTS;'), ' is ', ';ECON_STOCK;'), ' ', ';') AS themes,
         replace(one_line, ' ', ';') AS organizations,
         CASE doc_id % 11 WHEN 0 THEN '' WHEN 1 THEN '1,2' WHEN 2 THEN 'x,' || numbers
              ELSE numbers END AS tone
  FROM toned
),
decoded AS (
  SELECT *,
         list_filter(string_split(themes, ';'), lambda x: x <> '') AS theme_list,
         list_filter(string_split(organizations, ';'), lambda x: x <> '') AS org_list,
         string_split(tone, ',') AS tone_list
  FROM feed
)"""


def _flag(token: str) -> str:
    return (
        "len(list_filter(theme_list, lambda t: "
        f"list_contains(string_split(t, '_'), '{token}'))) > 0"
    )


FLAGS = f"{_flag('ENV')} AS E, {_flag('UNGP')} AS S, {_flag('ECON')} AS G"


def _strip(name: str) -> str:
    for word, letter in product(SHARE_CLASS_WORDS, SHARE_CLASS_LETTERS):
        name = f"trim(regexp_replace({name}, '{word} {letter}( |$)', '', 'g'))"
    return name


_endings = "[" + ", ".join(f"'{e}'" for e in PART_ENDINGS) + "]"
PART_HOLDINGS = f"""
holdings AS (
  SELECT p_name || ' ' || lower(p_type) || ' ' || {_endings}[p_partkey % {len(PART_ENDINGS)} + 1] AS full_name,
         p_brand AS Sector, p_partkey AS rank
  FROM part
)"""

WORD_HOLDINGS = """
words AS (
  SELECT item_id, unnest(parts) AS word, generate_subscripts(parts, 1) - 1 AS place
  FROM (SELECT item_id, string_split(replace(text, chr(10), ' '), ' ') AS parts FROM benchmark)
),
holdings AS (
  SELECT word || ' INC CLASS A' AS full_name, 'Words' AS Sector, item_id * 100000 + place AS rank
  FROM words WHERE word <> ''
)"""


def _universe(limit: str) -> str:
    return f"""
universe AS (
  SELECT Name, Sector, min(rank) AS rank
  FROM (SELECT {_strip('full_name')} AS Name, Sector, rank FROM holdings)
  GROUP BY Name, Sector {limit}
)"""


_ENDING = "( " + "| ".join(LEGAL_ENDINGS) + ")$"
_ends = f"regexp_matches(alias, '{_ENDING}')"
_last = "regexp_replace(alias, ' [^ ]*$', '')"


def _round_of(source: str, target: str) -> str:
    """One more legal ending dropped, for spellings and canonical names alike."""
    return f"""
{target} AS (
  SELECT rank, alias, canonical FROM {source}
  UNION SELECT rank, {_last}, false FROM {source} WHERE {_ends} AND NOT canonical
  UNION SELECT rank, {_last}, true FROM {source} WHERE {_ends} AND canonical
  UNION SELECT rank, {_last}, false FROM {source} WHERE {_ends} AND canonical
),
{target}c AS (
  SELECT a.* FROM {target} a
  WHERE NOT (a.canonical AND EXISTS (
    SELECT 1 FROM {source} b WHERE b.rank = a.rank AND b.canonical AND b.alias = a.alias AND
    regexp_matches(b.alias, '{_ENDING}')))
)"""


ALIASES = f"""
low AS (SELECT rank, lower(Name) AS n FROM universe),
site AS (
  SELECT rank, n, length(n) > 3 AND substr(n, length(n) - 3, 1) = '.' AS dotted,
         replace(regexp_replace(n, '\\.[^.]*$', ''), '.', ' ') AS stem
  FROM low
),
start AS (SELECT rank, n, dotted, CASE WHEN dotted THEN stem ELSE n END AS c FROM site),
lettered AS (
  SELECT rank, n, c AS c0,
         CASE WHEN regexp_matches(c, '(^|\\s)\\S$') THEN regexp_replace(c, ' [^ ]*$', '') ELSE c END AS c1
  FROM start
),
r0c AS (
  SELECT rank, n AS alias, false AS canonical FROM lettered
  UNION SELECT rank, c0, false FROM lettered
  UNION SELECT rank, c1, false FROM lettered
  UNION SELECT rank, c1, true FROM lettered
),
{_round_of('r0c', 'r1')},
{_round_of('r1c', 'r2')},
{_round_of('r2c', 'r3')},
dashed AS (
  SELECT rank, alias FROM r3c WHERE NOT canonical
  UNION SELECT rank, replace(alias, '-', '') FROM r3c WHERE NOT canonical
  UNION SELECT rank, replace(alias, '-', ' ') FROM r3c WHERE NOT canonical
),
spelled AS (
  SELECT rank, alias FROM dashed UNION SELECT rank, replace(alias, ' & ', ' and ') FROM dashed
),
named AS (SELECT rank, replace(alias, '-', ' ') AS company FROM r3c WHERE canonical),
companies AS (SELECT company, min(rank) AS priority, max(rank) AS last_rank FROM named GROUP BY company),
aliases AS (
  SELECT s.alias, arg_min(c.company, c.priority) AS company, min(c.priority) AS priority
  FROM companies c JOIN spelled s ON s.rank = c.last_rank GROUP BY s.alias
)"""

GRAPH = """
mentions AS (SELECT l_orderkey AS url, l_suppkey AS org, count(*) AS n FROM lineitem GROUP BY ALL),
edges AS (
  SELECT a.org AS src, b.org AS dst,
         CAST(sum(CASE WHEN a.org = b.org THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END) AS BIGINT) AS weight
  FROM mentions a JOIN mentions b ON a.url = b.url AND a.org <= b.org
  WHERE a.org < b.org OR a.n > 1
  GROUP BY ALL
)"""

COSINE = """
vectors AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pairs AS (
  SELECT a.id AS company, b.id AS neighbor, round(list_cosine_similarity(a.v, b.v), 9) AS confidence
  FROM vectors a JOIN vectors b ON a.id <> b.id
),
ranked AS (
  SELECT company, row_number() OVER (PARTITION BY company ORDER BY confidence DESC, neighbor) - 1 AS rank,
         neighbor, confidence
  FROM pairs
)"""

_PERIOD = "day BETWEEN DATE '2024-01-05' AND DATE '2024-01-24'"
_LABEL = "CASE {0} WHEN 'T' THEN 'Overall' WHEN 'E' THEN 'Environment' WHEN 'S' THEN 'Social' WHEN 'G' THEN 'Governance' END"


def _series(segments: str) -> str:
    return f"""
grid AS (
  SELECT date, segment FROM (SELECT DISTINCT date FROM diffs WHERE list_contains({segments}, segment))
  CROSS JOIN (SELECT unnest({segments}) AS segment)
),
company_series AS (
  SELECT g.date, g.segment, last_value(d.diff IGNORE NULLS) OVER (PARTITION BY g.segment ORDER BY g.date) AS score
  FROM grid g LEFT JOIN diffs d ON d.date = g.date AND d.segment = g.segment AND d.org = 'org 7'
),
industry_means AS (SELECT segment, date, avg(diff) AS score FROM diffs GROUP BY ALL),
industry_series AS (
  SELECT g.date, g.segment, last_value(m.score IGNORE NULLS) OVER (PARTITION BY g.segment ORDER BY g.date) AS score
  FROM grid g LEFT JOIN industry_means m ON m.date = g.date AND m.segment = g.segment
)"""



_wide = ", ".join(
    f"""max(CASE WHEN org = '{org}' THEN round(diff, 9) + 0 END) AS "{org.replace(' ', '_')}_diff" """
    for org in ORDER_ORGS
)
_wide_averages = ", ".join(
    f"""max(CASE WHEN org = '{org}' THEN round(score, 9) + 0 END) AS "{org}" """ for org in ORDER_ORGS
)
_wide_connections = ", ".join(
    f"max(CASE WHEN rank = {r} THEN neighbor END) AS n{r}_rec, "
    f"max(CASE WHEN rank = {r} THEN round(confidence, 9) + 0 END) AS n{r}_conf"
    for r in range(25)
)

ARTICLES = f"""
flagged AS (SELECT *, {FLAGS} FROM decoded),
named_rows AS (SELECT *, lower(unnest(org_list)) AS org FROM flagged),
exported AS (
  SELECT moment, SourceCommonName, URL, E, S, G, company AS Organization,
    {', '.join(f'TRY_CAST(tone_list[{i}] AS DOUBLE) AS {name}' for i, name in enumerate(TONE_COLUMNS, 1))}
  FROM named_rows JOIN aliases ON alias = org
)"""

# The landed events, of the first 300 customers.
def _products(limit: str = "") -> str:
    """Articles of the landed events of every customer, or of the first ones."""
    return f"""
WITH {EVENT_ARTICLES.replace("articles AS", "raw AS", 1)},
companies AS (SELECT 'org ' || c_custkey AS name FROM customer ORDER BY c_custkey {limit}),
stored AS (
  SELECT "DATE" - INTERVAL {EVENT_SHIFT_DAYS} DAY AS moved, CAST("DATE" - INTERVAL {EVENT_SHIFT_DAYS} DAY AS DATE) AS day,
         SourceCommonName, URL, E, S, G, replace(Organization, 'org ', 'company') AS Organization,
         Tone, PositiveTone, NegativeTone, Polarity, ActivityDensity, SelfDensity, WordCount
  FROM raw JOIN companies ON name = Organization
  WHERE CAST("DATE" - INTERVAL {EVENT_SHIFT_DAYS} DAY AS DATE) BETWEEN DATE '2020-12-01' AND DATE '2020-12-31'
)"""


PRODUCTS = _products()
PRODUCT_SCORES = f"{PRODUCTS}, articles AS (SELECT * FROM stored), {SCORES}"
WIDE_SCORES = f"{_products('LIMIT 300')}, articles AS (SELECT * FROM stored), {SCORES}"

# Places on the line of a vertex's edges, in the order of md5(to), and draws from md5.
WALKS = f"""
WITH RECURSIVE {GRAPH},
directed AS (
  SELECT src AS vertex, dst AS "to", weight FROM edges
  UNION ALL SELECT dst, src, weight FROM edges WHERE src <> dst
),
laid AS (
  SELECT vertex, "to", sum(weight) OVER (PARTITION BY vertex ORDER BY md5("to"::VARCHAR), "to") AS hi, weight,
         sum(weight) OVER (PARTITION BY vertex) AS total
  FROM directed
),
totals AS (SELECT DISTINCT vertex, total FROM laid),
walks AS (
  SELECT vertex AS start, w AS walk, 0 AS step, vertex FROM totals, range(20) AS r(w)
  UNION ALL
  SELECT k.start, k.walk, k.step + 1, l."to"
  FROM walks k JOIN totals t ON t.vertex = k.vertex JOIN laid l ON l.vertex = k.vertex
  WHERE k.step < 29
    AND ('0x' || substr(md5(concat_ws('|', k.start, k.walk, k.step + 1, 42)), 1, 15))::BIGINT % t.total >= l.hi - l.weight
    AND ('0x' || substr(md5(concat_ws('|', k.start, k.walk, k.step + 1, 42)), 1, 15))::BIGINT % t.total < l.hi
)"""

ORACLE_SQL: dict[str, str] = {
    "split_list": f"""
        WITH {FEED} SELECT URL AS url, CAST(len(org_list) AS BIGINT) AS items,
          array_to_string(org_list, '|') AS joined FROM decoded""",
    "tone_columns": """
        SELECT l_orderkey, l_linenumber, l_quantity AS Tone, l_extendedprice AS PositiveTone,
          l_discount AS NegativeTone, l_tax AS Polarity, CAST(l_linenumber AS DOUBLE) AS ActivityDensity,
          CAST(l_partkey AS DOUBLE) AS SelfDensity, CAST(l_suppkey AS DOUBLE) AS WordCount FROM lineitem""",
    "theme_flags": f"WITH {FEED} SELECT URL AS url, {FLAGS} FROM decoded",
    "parse_timestamp": """
        SELECT o_orderkey, strftime(o_orderdate + to_seconds(o_orderkey % 86400), '%Y-%m-%d %H:%M:%S') AS moment
        FROM orders""",
    "explode_organizations": f"""
        WITH {FEED}, o AS (SELECT unnest(org_list) AS Organization FROM decoded)
        SELECT Organization, count(*) AS mentions FROM o GROUP BY ALL""",
    "clean_organization": f"""
        WITH {FEED}, {WORD_HOLDINGS}, {_universe('')}, {ALIASES},
        o AS (SELECT lower(unnest(org_list)) AS org FROM decoded)
        SELECT coalesce(company, org) AS Organization, count(*) AS mentions
        FROM o LEFT JOIN aliases ON alias = org GROUP BY ALL""",
    "strip_share_class": f"WITH {PART_HOLDINGS} SELECT rank, {_strip('full_name')} AS name FROM holdings",
    "company_aliases": f"""
        WITH {PART_HOLDINGS}, {_universe('')}, {ALIASES} SELECT alias, company, priority FROM aliases""",
    "universe": f"""
        WITH {PART_HOLDINGS}, {_universe('ORDER BY min(rank) LIMIT 300')} SELECT * FROM universe""",
    "sector_universe": f"""
        WITH {PART_HOLDINGS}, {_universe('')}
        SELECT * FROM universe WHERE Sector = 'Brand#2' ORDER BY rank LIMIT 20""",
    "reformat_articles": f"""
        WITH {FEED}, {WORD_HOLDINGS}, {_universe('')}, {ALIASES}, {ARTICLES}
        SELECT strftime(moment, '%Y-%m-%d %H:%M:%S') AS "DATE", * EXCLUDE (moment) FROM exported""",
    "union_days": f"""
        WITH {EVENT_ARTICLES} SELECT day, count(*) AS articles, round(avg(Tone), 9) + 0 AS tone
        FROM articles GROUP BY day""",
    "missing_days": """
        SELECT CAST(d AS DATE) AS day FROM generate_series(TIMESTAMP '1994-12-01', TIMESTAMP '2002-01-31',
          INTERVAL 1 DAY) AS t(d)
        WHERE CAST(d AS DATE) = DATE '1999-03-14'
           OR CAST(d AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)""",
    "stringify_nested": """
        SELECT doc_id, CAST(to_json(string_split(text, ' ')) AS VARCHAR) AS words,
          CAST(to_json(MAP {lang: source}) AS VARCHAR) AS origin FROM documents""",
    "parse_locations": """
        SELECT c_custkey, CASE c_custkey % 7 WHEN 1 THEN 'COUNTRY' WHEN 2 THEN 'USSTATE' WHEN 3 THEN 'USCITY'
          WHEN 4 THEN 'WORLDCITY' WHEN 5 THEN 'WORLDSTATE' ELSE CAST(c_custkey % 7 AS VARCHAR) END AS loc_type,
          replace(c_name, '#', '-') AS name, c_mktsegment AS region FROM customer
        UNION ALL SELECT c_custkey, 'USCITY', 'city ' || c_custkey, NULL FROM customer""",
    "parse_gcam": """
        SELECT l_orderkey, 'word_count' AS kind, CAST(l_suppkey % 20 AS INTEGER) AS dictionary_id,
          l_linenumber AS dimension_id, l_quantity AS value FROM lineitem
        UNION ALL SELECT l_orderkey, 'scored_value', CAST(l_suppkey % 9 AS INTEGER), l_linenumber, l_discount
        FROM lineitem""",
    "daily_tone": f"{EVENT_SCORES} SELECT segment, date, org, round(tone, 9) + 0 AS tone FROM tones",
    "industry_tone": f"{EVENT_SCORES} SELECT segment, date, round(industry_tone, 9) + 0 AS industry_tone FROM industry",
    "daily_diff": f"{EVENT_SCORES} SELECT segment, date, org, round(diff, 9) + 0 AS diff FROM diffs",
    "average_scores": f"{EVENT_SCORES} SELECT segment, org, round(score, 9) + 0 AS score FROM averages",
    "column_averages": """
        SELECT round(avg(l_orderkey), 9) + 0 AS l_orderkey, round(avg(l_partkey), 9) + 0 AS l_partkey,
          round(avg(l_suppkey), 9) + 0 AS l_suppkey, round(avg(l_linenumber), 9) + 0 AS l_linenumber,
          round(avg(l_quantity), 9) + 0 AS l_quantity, round(avg(l_extendedprice), 9) + 0 AS l_extendedprice,
          round(avg(l_discount), 9) + 0 AS l_discount, round(avg(l_tax), 9) + 0 AS l_tax FROM lineitem""",
    "fill_full": f"""{EVENT_SCORES},
        days AS (SELECT CAST(d AS DATE) AS date FROM generate_series(TIMESTAMP '2023-12-28',
          TIMESTAMP '2024-02-03', INTERVAL 1 DAY) AS t(d)),
        grid AS (SELECT * FROM (SELECT DISTINCT segment, org FROM diffs) CROSS JOIN days)
        SELECT g.segment, g.org, g.date, round(last_value(d.diff IGNORE NULLS) OVER (
          PARTITION BY g.segment, g.org ORDER BY g.date), 9) + 0 AS diff
        FROM grid g LEFT JOIN diffs d ON d.segment = g.segment AND d.org = g.org AND d.date = g.date""",
    "fill_gaps": f"""{ORDER_SCORES},
        bounds AS (SELECT segment, min(date) AS a, max(date) AS b FROM diffs GROUP BY segment),
        days AS (SELECT segment, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP),
          INTERVAL 1 DAY)) AS DATE) AS date FROM bounds),
        seen AS (SELECT DISTINCT segment, date FROM diffs),
        sourced AS (SELECT d.segment, d.date, max(s.date) OVER (PARTITION BY d.segment ORDER BY d.date) AS source
          FROM days d LEFT JOIN seen s ON s.segment = d.segment AND s.date = d.date),
        orgs AS (SELECT DISTINCT segment, org FROM diffs)
        SELECT s.segment, s.date, o.org, round(d.diff, 9) + 0 AS diff
        FROM sourced s JOIN orgs o ON o.segment = s.segment
        LEFT JOIN diffs d ON d.segment = s.segment AND d.org = o.org AND d.date = s.source""",
    "fill_industry_gaps": f"""{ORDER_SCORES},
        bounds AS (SELECT segment, min(date) AS a, max(date) AS b FROM industry GROUP BY segment),
        days AS (SELECT segment, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP),
          INTERVAL 1 DAY)) AS DATE) AS date FROM bounds),
        sourced AS (SELECT d.segment, d.date, max(i.date) OVER (PARTITION BY d.segment ORDER BY d.date) AS source
          FROM days d LEFT JOIN industry i ON i.segment = d.segment AND i.date = d.date)
        SELECT s.segment, s.date, round(i.industry_tone, 9) + 0 AS industry_tone
        FROM sourced s JOIN industry i ON i.segment = s.segment AND i.date = s.source""",
    "scores_wide": f"""{ORDER_SCORES}
        SELECT i.segment, i.date, max(round(i.industry_tone, 9) + 0) AS industry_tone, {_wide}
        FROM industry i LEFT JOIN diffs d ON d.segment = i.segment AND d.date = i.date
        GROUP BY i.segment, i.date""",
    "scores_long": f"""{ORDER_SCORES},
        orgs AS (SELECT unnest([{', '.join(f"'{o}'" for o in ORDER_ORGS)}]) AS org)
        SELECT i.segment, i.date, o.org, round(d.diff, 9) + 0 AS diff
        FROM industry i CROSS JOIN orgs o
        LEFT JOIN diffs d ON d.segment = i.segment AND d.date = i.date AND d.org = o.org""",
    "averages_wide": f"""{ORDER_SCORES} SELECT segment AS Type, {_wide_averages} FROM averages GROUP BY segment""",
    "industry_average_series": f"""{EVENT_SCORES}
        SELECT segment, date, round(avg(diff), 9) + 0 AS score FROM diffs GROUP BY ALL""",
    "segment_series": f"""{EVENT_SCORES}, {_series("['E', 'S', 'G']")}
        SELECT date AS "DATE", segment AS "ESG", round(score, 9) + 0 AS "Score" FROM company_series""",
    "score_over_time": f"""{EVENT_SCORES}, {_series("['T', 'E', 'S', 'G']")},
        both_lines AS (SELECT 'Org 7' AS "WHO", * FROM company_series
          UNION ALL SELECT 'Industry Average', * FROM industry_series)
        SELECT "WHO", {_LABEL.format('segment')} AS "ESG", date AS "DATE", round(score, 9) + 0 AS "Score"
        FROM both_lines WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-24'""",
    "scale_numeric": f"{EVENT_SCORES} SELECT segment, org, round(score * 10000, 5) + 0 AS score FROM averages",
    "streamed_daily_tone": f"{EVENT_SCORES} SELECT segment, date, org, round(tone, 9) + 0 AS tone FROM tones",
    "any_flag": f"WITH {EVENT_ARTICLES} SELECT URL, E, S, G FROM articles WHERE E OR S OR G",
    "category_bag": f"""
        WITH {EVENT_ARTICLES}, bag AS (
          SELECT 'E' AS category, * FROM articles WHERE E
          UNION ALL SELECT 'S', * FROM articles WHERE S UNION ALL SELECT 'G', * FROM articles WHERE G)
        SELECT category, SourceCommonName, count(*) AS articles, round(avg(Tone), 9) + 0 AS tone
        FROM bag WHERE {_PERIOD} GROUP BY ALL""",
    "date_range": """
        SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders
        WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-02-01' AND DATE '1997-03-31'""",
    "publisher_articles": f"""
        WITH {EVENT_ARTICLES} SELECT SourceCommonName, count(*) AS articles FROM articles GROUP BY ALL""",
    "publisher_filter": f"""
        WITH {EVENT_ARTICLES} SELECT URL, SourceCommonName, Organization FROM articles
        WHERE SourceCommonName = 'site_42'""",
    "article_listing": f"""
        WITH {EVENT_ARTICLES}, bag AS (
          SELECT * FROM articles WHERE E UNION ALL SELECT * FROM articles WHERE S
          UNION ALL SELECT * FROM articles WHERE G)
        SELECT day AS "DATE", SourceCommonName, URL, round(Tone, 9) + 0 AS Tone, round(Polarity, 9) + 0 AS Polarity,
          round(ActivityDensity, 9) + 0 AS ActivityDensity, round(SelfDensity, 9) + 0 AS SelfDensity
        FROM bag WHERE Organization = 'org 7' AND {_PERIOD}""",
    "article_scatter": f"""
        WITH {EVENT_ARTICLES}
        SELECT round(NegativeTone, 9) + 0 AS NegativeTone, round(PositiveTone, 9) + 0 AS PositiveTone,
          round(WordCount, 9) + 0 AS WordCount, round(Polarity, 9) + 0 AS Polarity, day AS "DATE", SourceCommonName
        FROM articles WHERE Organization = 'org 7' AND (E OR G) AND {_PERIOD}""",
    "metric_over_time": f"""
        WITH {EVENT_ARTICLES}, bag AS (
          SELECT * FROM articles WHERE E UNION ALL SELECT * FROM articles WHERE S
          UNION ALL SELECT * FROM articles WHERE G)
        SELECT 'Org 7' AS "WHO", day AS "DATE", round(avg(Polarity), 9) + 0 AS value
        FROM bag WHERE Organization = 'org 7' AND {_PERIOD} GROUP BY day
        UNION ALL SELECT 'Industry Average', day, round(avg(Polarity), 9) + 0
        FROM articles WHERE {_PERIOD} GROUP BY day""",
    "radar_scores": f"""{EVENT_SCORES}
        SELECT {_LABEL.format('segment')} AS "Type", 'org 7' AS entity,
          round(max(CASE WHEN org = 'org 7' THEN score END), 9) + 0 AS score FROM averages GROUP BY segment
        UNION ALL SELECT {_LABEL.format('segment')}, 'Industry Average', round(avg(score), 9) + 0
        FROM averages GROUP BY segment""",
    "tone_density": f"""
        WITH {EVENT_ARTICLES}, s AS (
          SELECT count(*) AS n, min(Tone) AS lo, max(Tone) AS hi, 1.06 * least(stddev_samp(Tone),
            (quantile_cont(Tone, 0.75) - quantile_cont(Tone, 0.25)) / 1.34) * pow(count(*), -0.2) AS h
          FROM articles),
        g AS (SELECT CAST(i AS INTEGER) AS point, lo + i * (hi - lo) / 199 AS x, n, h FROM s, range(200) AS r(i))
        SELECT point, round(x, 10) + 0 AS Tone,
          round(sum(exp(-0.5 * pow((x - Tone) / h, 2))) / (max(n) * max(h) * sqrt(2 * pi())), 10) + 0 AS density
        FROM g, (SELECT Tone FROM articles) GROUP BY point, x""",
    "date_bounds": f"""
        WITH {EVENT_ARTICLES} SELECT min(day) AS first_date, max(day) AS last_date FROM articles
        WHERE Organization = 'org 7'""",
    "distinct_sorted": f"""
        WITH {EVENT_ARTICLES} SELECT DISTINCT Organization FROM articles ORDER BY 1""",
    "format_columns": """
        SELECT format('{:,}', o_orderkey) AS o_orderkey, format('{:,}', o_custkey) AS o_custkey, o_orderstatus,
          format('{:,.4f}', o_totalprice) AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
          o_orderpriority FROM orders""",
    "comention_edges": f"WITH {GRAPH} SELECT src, dst, weight FROM edges",
    "comention_edges_distinct": f"""
        WITH {GRAPH} SELECT a.org AS src, b.org AS dst, count(*) AS weight
        FROM mentions a JOIN mentions b ON a.url = b.url AND a.org < b.org GROUP BY ALL""",
    "graph_vertices": f"WITH {GRAPH} SELECT src AS id FROM edges UNION SELECT dst FROM edges",
    "ego_edges": f"WITH {GRAPH} SELECT src, dst, weight FROM edges WHERE src = 7 OR dst = 7",
    "connections_topk": f"""
        WITH {COSINE} SELECT company, CAST(rank AS INTEGER) AS rank, neighbor,
          round(confidence, 9) + 0 AS confidence FROM ranked WHERE rank < 25""",
    "connections_pruned": f"""
        WITH {COSINE} SELECT company, CAST(rank AS INTEGER) AS rank, neighbor,
          round(confidence, 9) + 0 AS confidence FROM ranked WHERE rank < 25""",
    "connections_wide": f"WITH {COSINE} SELECT company, {_wide_connections} FROM ranked WHERE rank < 25 GROUP BY company",
    "neighbor_confidence": f"""
        WITH {COSINE} SELECT neighbor AS "Neighbor", round(confidence, 9) + 0 AS "Confidence"
        FROM ranked WHERE company = 7 AND rank < 8""",
    "embedding_labels": f"""
        WITH {COSINE} SELECT id AS company, CASE WHEN id = 7 THEN 'Company: 7'
          WHEN id IN (SELECT neighbor FROM ranked WHERE company = 7 AND rank < 8) THEN 'Connected Company'
          ELSE 'Other Company' END AS "colorCode" FROM vectors""",
    "random_walk_check": f"""
        WITH {GRAPH} SELECT id AS start, CAST(20 AS BIGINT) AS walks, CAST(580 AS BIGINT) AS steps,
          CAST(0 AS BIGINT) AS off_graph
        FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges)""",
    "random_walks": f"""{WALKS}
        SELECT start, CAST(walk AS INTEGER) AS walk, string_agg(vertex::VARCHAR, ' ' ORDER BY step) AS path
        FROM walks GROUP BY start, walk""",
    "embedding_check": f"""
        WITH {GRAPH} SELECT CAST(id AS VARCHAR) AS id, true AS right_size, true AS finite, true AS moved
        FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges)""",
    "pair_information": f"""{WALKS},
        near AS (
          SELECT x.vertex AS a, y.vertex AS b FROM walks x JOIN walks y
          ON x.start = y.start AND x.walk = y.walk AND abs(x.step - y.step) BETWEEN 1 AND 10),
        counted AS (SELECT a, b, count(*) AS n FROM near GROUP BY ALL),
        valued AS (
          SELECT a, b, n, ln(n * (sum(n) OVER ())::DOUBLE / (
            (sum(n) OVER (PARTITION BY a))::DOUBLE * (sum(n) OVER (PARTITION BY b))::DOUBLE)) AS value FROM counted)
        SELECT a, b, n, round(value, 9) + 0 AS value FROM valued WHERE value > 0""",
    "distributed_embeddings": f"""
        WITH {GRAPH} SELECT id, true AS right_size, true AS finite, true AS moved
        FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges)""",
    "pca_check": """
        WITH cells AS (SELECT vec_id AS id, unnest(CAST(embedding AS DOUBLE[])) AS v,
            generate_subscripts(embedding, 1) AS k FROM embeddings),
          means AS (SELECT k, avg(v) AS m FROM cells GROUP BY k)
        SELECT id, round(sum(pow(v - m, 2)), 6) AS squared FROM cells JOIN means USING (k) GROUP BY id
        UNION ALL SELECT -1, 0.0""",
    "holdings_scan": """
        SELECT 'COMPANY' || c_custkey || ' INC, THE' AS Name, c_mktsegment AS Sector,
          row_number() OVER (ORDER BY c_custkey) AS rank FROM customer""",
    "ordered_scores": f"""{EVENT_SCORES}
        SELECT segment, date, org, round(diff, 9) + 0 AS diff,
          row_number() OVER (ORDER BY date, segment, org) - 1 AS position FROM diffs""",
    "scores_blocks": f"""{EVENT_SCORES},
        bounds AS (SELECT segment, min(date) AS a, max(date) AS b FROM diffs GROUP BY segment),
        days AS (SELECT segment, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP),
          INTERVAL 1 DAY)) AS DATE) AS date FROM bounds),
        seen AS (SELECT DISTINCT segment, date FROM diffs),
        sourced AS (SELECT d.segment, d.date, max(s.date) OVER (PARTITION BY d.segment ORDER BY d.date) AS source
          FROM days d LEFT JOIN seen s ON s.segment = d.segment AND s.date = d.date)
        SELECT s.segment, s.date, d.org, round(d.diff, 9) + 0 AS diff
        FROM sourced s JOIN diffs d ON d.segment = s.segment AND d.date = s.source WHERE d.diff IS NOT NULL""",
    "range_average": f"""{EVENT_SCORES},
        ranges AS (SELECT unnest([{", ".join(str(r[0]) for r in RANGES)}]) AS a, unnest([{", ".join(str(r[1]) for r in RANGES)}]) AS b),
        bounds AS (SELECT CAST(DATE '2024-01-01' + CAST(a AS INTEGER) AS DATE) AS first,
          CAST(DATE '2024-01-01' + CAST(b AS INTEGER) AS DATE) AS last FROM ranges)
        SELECT strftime(first, '%Y-%m-%d') AS first, strftime(last, '%Y-%m-%d') AS last, segment, org, round(avg(diff), 6) + 0 AS score
        FROM bounds JOIN diffs ON date BETWEEN first AND last WHERE diff IS NOT NULL GROUP BY ALL""",
    "make_products": f"""
        WITH raw AS (
          SELECT o_orderkey AS url, CAST(DATE '2020-12-01' + CAST(o_orderkey % 30 AS INTEGER) AS DATE) AS day,
            'company' || l_suppkey AS Organization,
            o_orderpriority IN ('1-URGENT', '2-HIGH') AS E, o_orderpriority IN ('2-HIGH', '3-MEDIUM') AS S,
            o_orderpriority = '5-LOW' AS G,
            o_totalprice / 1000 - 250 AS Tone, CAST(o_custkey AS DOUBLE) AS WordCount
          FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
        articles AS (SELECT * FROM raw),
        {SCORES},
        counts AS (SELECT url, Organization AS org, count(*) AS n FROM raw WHERE E OR S OR G GROUP BY ALL),
        pairs AS (
          SELECT a.org AS src, b.org AS dst, a.n * b.n AS w FROM counts a JOIN counts b ON a.url = b.url AND a.org < b.org
          UNION ALL SELECT org, org, n * (n - 1) // 2 FROM counts WHERE n > 1),
        linked AS (SELECT src, dst, sum(w) AS weight FROM pairs GROUP BY ALL),
        v AS (SELECT count(*) AS n FROM (SELECT src FROM linked UNION SELECT dst FROM linked)),
        made AS (
          SELECT 'articles' AS product, count(*) AS rows, sum(Tone) AS total FROM articles
          UNION ALL SELECT 'sums', count(*), sum(t) FROM (
            SELECT segment, day, Organization, sum(Tone) AS t FROM segmented GROUP BY ALL)
          UNION ALL SELECT 'diffs', count(*), 0 FROM diffs
          UNION ALL SELECT 'averages', count(*), 0 FROM averages
          UNION ALL SELECT 'edges', count(*), sum(weight) FROM linked
          UNION ALL SELECT 'vectors', n, 0 FROM v
          UNION ALL SELECT 'points', n, 0 FROM v
          UNION ALL SELECT 'connections', n * least(n - 1, 25), n * least(n - 1, 25) * (least(n - 1, 25) - 1) / 2 FROM v)
        SELECT product, CAST(rows AS BIGINT) AS rows, round(CAST(total AS DOUBLE), 4) + 0 AS total FROM made""",
    "range_edges": """
        WITH counts AS (
          SELECT l_orderkey AS url, l_suppkey AS org, count(*) AS n FROM lineitem
          WHERE year(l_shipdate) BETWEEN 1994 AND 1997 GROUP BY ALL),
        pairs AS (
          SELECT a.org AS src, b.org AS dst, a.n * b.n AS w FROM counts a JOIN counts b ON a.url = b.url AND a.org < b.org
          UNION ALL SELECT org, org, n * (n - 1) // 2 FROM counts WHERE n > 1)
        SELECT src, dst, CAST(sum(w) AS BIGINT) AS weight FROM pairs GROUP BY ALL""",
    "changed_days": f"""
        WITH moved AS (SELECT CAST(ts - INTERVAL {EVENT_SHIFT_DAYS} DAY AS DATE) AS day FROM events)
        SELECT DISTINCT day FROM moved
        WHERE day BETWEEN DATE '2020-12-01' AND DATE '2020-12-31' AND dayofmonth(day) % 7 = 0""",
    "quarantined_records": f"""
        SELECT CAST(ts - INTERVAL {EVENT_SHIFT_DAYS} DAY AS DATE) AS day,
          CASE event_id % 50 WHEN 0 THEN 'columns' WHEN 1 THEN 'date' ELSE 'stored' END AS reason, count(*) AS records
        FROM events WHERE CAST(ts - INTERVAL {EVENT_SHIFT_DAYS} DAY AS DATE) BETWEEN DATE '2020-12-01' AND DATE '2020-12-31'
        GROUP BY ALL""",
    "streamed_feed_tone": f"{PRODUCT_SCORES} SELECT segment, date, org, round(tone, 9) + 0 AS tone FROM tones",
    "range_articles": f"""{PRODUCTS}
        SELECT strftime(moved, '%Y-%m-%d %H:%M:%S') AS "DATE", * EXCLUDE (moved, day) FROM stored""",
    "period_articles": f"""{PRODUCTS}
        SELECT day, Organization, count(*) AS articles FROM stored
        WHERE day BETWEEN DATE '2020-12-01' AND DATE '2020-12-10' GROUP BY ALL""",
    "range_scores": f"{PRODUCT_SCORES} SELECT segment, date, org, round(diff, 9) + 0 AS diff FROM diffs",
    "bundle_scores": f"""{WIDE_SCORES},
        grid AS (SELECT * FROM (SELECT DISTINCT segment FROM diffs), (SELECT DISTINCT org FROM diffs))
        SELECT g.segment, g.org, round(a.score * 10000, 5) + 0 AS score
        FROM grid g LEFT JOIN averages a ON a.segment = g.segment AND a.org = g.org""",
    "bundle_daily": f"""{WIDE_SCORES},
        bounds AS (SELECT segment, min(date) AS a, max(date) AS b FROM industry GROUP BY segment),
        days AS (SELECT segment, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP),
          INTERVAL 1 DAY)) AS DATE) AS date FROM bounds),
        seen AS (SELECT DISTINCT segment, date FROM diffs),
        sourced AS (SELECT d.segment, d.date, max(s.date) OVER (PARTITION BY d.segment ORDER BY d.date) AS source
          FROM days d LEFT JOIN seen s ON s.segment = d.segment AND s.date = d.date),
        orgs AS (SELECT DISTINCT org FROM diffs)
        SELECT s.segment, s.date, o.org, round(d.diff * 10000, 5) + 0 AS diff
        FROM sourced s CROSS JOIN orgs o
        LEFT JOIN diffs d ON d.segment = s.segment AND d.org = o.org AND d.date = s.source""",
    "bundle_connections": f"""
        WITH {COSINE}
        SELECT CAST(company AS VARCHAR) AS company, CAST(rank AS INTEGER) AS rank, CAST(neighbor AS VARCHAR) AS neighbor,
          round(confidence, 9) + 0 AS confidence
        FROM (SELECT company, neighbor, confidence, row_number() OVER (
                PARTITION BY company ORDER BY confidence DESC, CAST(neighbor AS VARCHAR)) - 1 AS rank FROM pairs)
        WHERE rank < 25""",
}
