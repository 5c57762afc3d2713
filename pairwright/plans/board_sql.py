"""SQL counterparts of the board's queries."""

from __future__ import annotations

from pairwright.operators.board import STATUSES
from pairwright.operators.snapshot import CARRIED
from pairwright.plans.fixtures import SITES_SQL, TODAY

_ROLES = f"""r AS (SELECT 'role/' || o_orderkey || ' (x)' AS id, 'Title ' || (o_orderkey % 40) AS title, 'Org ' || (o_orderkey % 37) AS org, CASE WHEN o_orderkey % 3 = 0 THEN 'a' ELSE 'b' END AS specialty, o_orderkey * 31 % 101 AS score,
  CASE WHEN o_orderkey % 9 <> 0 THEN datediff('day', o_orderdate::DATE, DATE '{TODAY}') END AS age_days, CASE WHEN o_orderkey % 2 = 0 THEN 'radiology team' ELSE 'clinic' END AS description, CASE WHEN o_orderkey % 4 = 0 THEN 'remote' ELSE 'onsite' END AS work_model,
  CASE WHEN o_orderkey % 6 = 0 THEN 'QA' ELSE 'US' END AS country, CASE WHEN o_orderkey % 7 <> 0 THEN 'City ' || (o_orderkey % 11) END AS city, o_orderkey % 5 AS src, o_orderkey AS k FROM orders)"""
_RUNS = f"""{_ROLES}, prev AS (SELECT *, CASE WHEN k % 6 <> 3 THEN CASE WHEN k % 8 = 1 THEN DATE '2001-07-01' ELSE DATE '2001-07-25' END END AS seen, CASE WHEN k % 10 = 1 THEN CASE WHEN k % 20 = 1 THEN DATE '2001-07-10' ELSE DATE '2001-07-25' END ELSE DATE '{TODAY}' END AS since FROM r WHERE k % 4 <> 0),
fresh AS (SELECT * FROM r WHERE k % 4 <> 1), carried AS (SELECT * FROM prev WHERE src = 3 AND k NOT IN (SELECT k FROM fresh) AND datediff('day', since, DATE '{TODAY}') <= 14),
cur AS (SELECT id, k, specialty, score, org, city, country, work_model FROM fresh UNION ALL SELECT id, k, specialty, score, org, city, country, work_model FROM carried),
u AS (SELECT cur.*, p.k IS NULL AS is_new, coalesce(p.seen, CASE WHEN p.k IS NOT NULL THEN DATE '2001-07-25' END, DATE '{TODAY}') AS first_seen FROM cur LEFT JOIN prev p ON p.k = cur.k)"""
_FILTERED = "specialty = 'b' AND score >= 55 AND contains(lower(title || ' ' || org || ' somewhere ' || description), 'radiolog')"
_LIST = "[" + ", ".join(f"'{s}'" for s in (*STATUSES, "lost")) + "]"
_OK = "(" + ", ".join(f"'{s}'" for s in STATUSES) + ")"
_MARKS = f"""m0 AS (SELECT 'board-' || (user_id % 10) AS board_id, 'role/' || (user_id * 7 % 500) || ' (x)' AS role_id, event_id % 3 = 0 AS pinned, ({_LIST})[event_id % 6 + 1] AS status, CASE WHEN event_id % 5 <> 0 THEN event_type END AS note,
  CASE WHEN event_id % 11 = 0 THEN repeat('x', 81) ELSE 'me' END AS "by", ts, event_id AS seq FROM events),
m1 AS (SELECT *, CASE WHEN status NOT IN {_OK} THEN 'status' WHEN length("by") > 80 THEN 'by' END AS error FROM m0),
m2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY board_id, role_id ORDER BY ts DESC, seq DESC) AS n FROM m1 WHERE error IS NULL) WHERE n = 1)"""
_SQUARES = f"""{SITES_SQL}, k AS (SELECT *, floor(lat * 2)::BIGINT || '_' || floor(lon * 2)::BIGINT AS area_id FROM sites)"""


_COVERAGE = """WITH n AS (SELECT l_suppkey AS k, count(*) AS postings FROM lineitem GROUP BY 1)
SELECT s_name AS source_name, coalesce(postings, 0) AS postings, CASE WHEN s_suppkey % 5 = 0 THEN 'sweep-only' WHEN s_suppkey % 7 = 1 THEN 'needs-credentials' WHEN s_suppkey % 4 = 2 THEN 'failed' WHEN postings IS NULL THEN 'empty' ELSE 'ok' END AS status FROM supplier LEFT JOIN n ON k = s_suppkey"""
_KIND = "(['greenhouse', 'json', 'workday', 'rss', 'none', 'carrier-pigeon', 'jooble', 'usajobs', 'jsearch', 'adzuna'])[s_suppkey % 10 + 1]"
#: Kind, term, its place, and pages of every request.
_TERMS = ", ".join(
    [f"('{k}', NULL, 0, 1)" for k in ("greenhouse", "json", "rss")]
    + [f"('{k}', '{t}', {i}, {n})" for k, n in (("workday", 5), ("jooble", 3), ("usajobs", 3), ("jsearch", 1)) for i, t in enumerate(("radiologist", "vascular surgeon"))]
    + [f"('adzuna', '{t}', {i}, 3)" for i, t in enumerate(("vascular surgeon", "diagnostic radiologist"))]
)


def oracles() -> dict[str, str]:
    from pairwright.plans import core_sql, feed_queries

    return {
        "new_roles": f"WITH {_RUNS} SELECT id, score FROM u WHERE is_new",
        "first_seen": f"WITH {_RUNS} SELECT first_seen::VARCHAR AS first_seen, is_new, count(*) AS n FROM u GROUP BY ALL",
        "carry_forward": f"WITH {_RUNS} SELECT id, since::VARCHAR AS stale_since, 'c|{CARRIED}' AS concerns FROM carried",
        "board_filter": f"WITH {_ROLES} SELECT id, score, age_days::BIGINT AS age_days FROM r WHERE {_FILTERED} AND age_days <= 200",
        "undated_held": f"WITH {_ROLES} SELECT count_if(age_days IS NULL)::BIGINT AS undated FROM r WHERE {_FILTERED}",
        "sort_newest": f"WITH {_ROLES} SELECT row_number() OVER (ORDER BY age_days ASC NULLS LAST, score DESC, id) AS rank, id FROM r QUALIFY rank <= 50",
        "sort_oldest": f"WITH {_ROLES} SELECT row_number() OVER (ORDER BY age_days DESC NULLS LAST, score DESC, id) AS rank, id FROM r QUALIFY rank <= 50",
        "search_docs": "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'license')",
        "marks_latest": f"WITH {_MARKS} SELECT board_id, role_id, pinned, status, note, seq FROM m2",
        "marks_merged": f"WITH {_MARKS} SELECT board_id, role_id, pinned, status, note, seq FROM m2",
        "marks_invalid": f"WITH {_MARKS} SELECT error, count(*) AS n FROM m1 WHERE error IS NOT NULL GROUP BY 1",
        "role_marks": f"WITH {_ROLES}, {_MARKS} SELECT id, coalesce(pinned, false) AS pinned, coalesce(status, 'new') AS status, coalesce(note, '') AS note FROM r LEFT JOIN m2 ON role_id = id AND board_id = 'board-3'",
        "pinned": f"WITH {_ROLES}, {_MARKS} SELECT id, score FROM r WHERE id IN (SELECT role_id FROM m2 WHERE board_id = 'board-3' AND pinned)",
        "area_members_topk": f"WITH {_SQUARES} SELECT area_id, side, rank, id, greatest(n - 2, 0) AS more FROM (SELECT *, row_number() OVER w AS rank, count(*) OVER (PARTITION BY area_id, side) AS n FROM k WINDOW w AS (PARTITION BY area_id, side ORDER BY score DESC, ordinal)) WHERE rank <= 2",
        "areas_filtered": f"""WITH {_SQUARES}, g AS (SELECT area_id, count_if(side = 'a')::BIGINT AS a_count, count_if(side = 'b')::BIGINT AS b_count FROM k WHERE score >= 50 GROUP BY 1)
SELECT *, a_count > 0 AND b_count > 0 AS is_together, a_count > 0 AND b_count = 0 AS remote_unlocked, CASE WHEN a_count > 0 AND b_count > 0 THEN NULL WHEN a_count > 0 THEN 'b' ELSE 'a' END AS missing_side FROM g""",
        "unread_batches": f"WITH {_RUNS} SELECT first_seen::VARCHAR AS first_seen, count(*) AS n, array_to_string(list_slice(list(id ORDER BY score DESC, id), 1, 5), '|') AS best FROM u WHERE first_seen > DATE '2001-07-10' GROUP BY 1",
        "digest_entries": f"""WITH {_RUNS} SELECT specialty, row_number() OVER (PARTITION BY specialty ORDER BY score DESC, id) AS rank, id, org, CASE WHEN city IS NOT NULL THEN city || ', ' || CASE WHEN country = 'US' THEN 'OH' ELSE country END WHEN work_model = 'remote' THEN 'Remote' ELSE 'somewhere' END AS location, score,
'https://board.example/#role=role%2F' || k || '%20(x)' AS board_url FROM u WHERE is_new QUALIFY rank <= 12""",
        "digest_counts": f"WITH {_RUNS} SELECT count(*) AS total_roles, count_if(is_new)::BIGINT AS new_this_run, count_if(is_new AND specialty = 'a')::BIGINT AS new_a, count_if(is_new AND specialty = 'b')::BIGINT AS new_b FROM u",
        "source_coverage": _COVERAGE,
        "role_cards": f"""WITH {_ROLES}, c AS (SELECT *, CASE WHEN k % 4 <> 0 THEN city END AS town, CASE WHEN k % 5 = 4 THEN 'FR' ELSE country END AS land FROM r),
d AS (SELECT *, MAP {{'QA': 'Qatar'}}[land] AS abroad FROM c)
SELECT id, CASE WHEN town IS NOT NULL THEN town || CASE WHEN land = 'US' THEN ', OH' WHEN abroad IS NOT NULL THEN ', ' || abroad ELSE '' END WHEN k % 16 = 0 THEN 'Remote' WHEN k % 8 = 0 AND land = 'US' THEN 'OH (state-wide)' WHEN abroad IS NOT NULL THEN abroad || ' (country-wide)'
    WHEN k % 3 = 0 THEN 'somewhere' ELSE 'Location not stated' END AS place, CASE WHEN k % 5 = 0 THEN 'Private group' ELSE 'Academic' END AS setting, CASE WHEN k % 4 = 0 THEN 'Remote' ELSE 'On-site' END AS work_model,
  CASE WHEN k % 10 <> 3 THEN strftime(DATE '2001-08-01' + (k % 400)::INTEGER, '%-d %b %Y') ELSE 'unknown' END AS run_day, CASE WHEN k % 2 = 0 THEN 'radiology…' ELSE 'clinic' END AS lede FROM d""",
        "display_columns": f"""WITH {_ROLES} SELECT id, CASE WHEN city IS NOT NULL THEN city || ', ' || CASE WHEN country = 'US' THEN 'OH' ELSE country END WHEN work_model = 'remote' THEN 'Remote' ELSE 'somewhere' END AS location,
CASE WHEN age_days IS NULL THEN 'date not stated' WHEN age_days = 0 THEN 'posted today' WHEN age_days = 1 THEN 'posted yesterday' WHEN age_days < 30 THEN 'posted ' || age_days || ' days ago' ELSE 'posted ' || floor(age_days / 30.0 + 0.5)::BIGINT || CASE WHEN floor(age_days / 30.0 + 0.5) = 1 THEN ' month ago' ELSE ' months ago' END END AS posted FROM r""",
        "registry_valid": """WITH s AS (SELECT s_name AS name, s_suppkey AS k, CASE WHEN s_suppkey % 7 <> 0 THEN (['greenhouse', 'json', 'workday', 'rss', 'none', 'carrier-pigeon', 'jooble', 'usajobs', 'jsearch', 'adzuna'])[s_suppkey % 10 + 1] END AS kind, s_suppkey % 12 <> 0 OR s_suppkey % 10 = 2 AS has FROM supplier),
p AS (SELECT *, array_to_string(list_filter([CASE WHEN k % 13 = 0 THEN 'missing category' END, CASE WHEN kind = 'carrier-pigeon' THEN 'unknown kind carrier-pigeon' END, CASE WHEN kind <> 'none' AND NOT has THEN 'no endpoint for ' || kind END], lambda x: x IS NOT NULL), '; ') AS problems FROM s)
SELECT name, CASE WHEN problems = '' THEN coalesce(kind, 'none') ELSE kind END AS kind, problems = '' AND kind IS NOT NULL AND kind <> 'none' AND has AS active, problems FROM p""",
        "request_plan": f"""WITH s AS (SELECT s_suppkey AS k, {_KIND} AS kind FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 13 <> 0 AND (s_suppkey % 12 <> 0 OR s_suppkey % 10 = 2) AND s_suppkey % 10 NOT IN (4, 5)),
t AS (SELECT s.kind, seq, page, CASE WHEN s.kind IN ('workday', 'jooble') THEN 'POST' ELSE 'GET' END AS method, CASE s.kind WHEN 'workday' THEN '{{"limit": 20, "searchText": "' || term || '"}}' WHEN 'jooble' THEN '{{"keywords":"' || term || '","location":"United States","page":"' || page || '"}}' END AS body,
  'https://host.example/' || CASE s.kind WHEN 'workday' THEN 'jobs' ELSE 'feed' END || CASE s.kind WHEN 'usajobs' THEN '?Keyword=' || replace(term, ' ', '%20') || '&ResultsPerPage=100&Page=' || page WHEN 'jsearch' THEN '?query=' || replace(term, ' ', '%20') || '%20in%20USA&num_pages=1&country=us&date_posted=all'
    WHEN 'adzuna' THEN '/us/search/' || page || '?results_per_page=50&what_phrase=' || replace(term, ' ', '%20') || '&content-type=application/json' ELSE '' END AS url
  FROM s JOIN (SELECT kind, term, nth, page, (nth * pages + page - 1)::INT AS seq FROM (VALUES {_TERMS}) v(kind, term, nth, pages), range(1, 6) r(page) WHERE page <= pages) q ON q.kind = s.kind)
SELECT kind, seq, method, url, page::INT AS page, body, count(*) AS n FROM t GROUP BY ALL""",
        "detect_feed": """SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'workday' WHEN 1 THEN 'json' WHEN 2 THEN 'greenhouse' WHEN 3 THEN 'lever' WHEN 4 THEN 'json' WHEN 5 THEN 'successfactors' WHEN 6 THEN 'icims-rss' END AS kind,
CASE page_id % 8 WHEN 0 THEN 'https://acme.wd5.myworkdayjobs.com/wday/cxs/acme/Careers/jobs' WHEN 1 THEN 'https://abc.fa.us2.oraclecloud.com/hcmRestApi/resources/latest/recruitingCEJobRequisitions?onlyData=true&expand=requisitionList&finder=findReqs;siteNumber=CX_7,limit=200'
 WHEN 2 THEN 'https://boards-api.greenhouse.io/v1/boards/acme/jobs?content=true' WHEN 3 THEN 'https://api.lever.co/v0/postings/acme?mode=json' WHEN 4 THEN regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/api/jobs?keywords=radiologist&limit=50&page=1&sortBy=relevance'
 WHEN 5 THEN 'https://careers.acme.org/hosp/search/' WHEN 6 THEN 'https://acme.icims.com/jobs/search/rss?searchKeyword=radiologist' END AS endpoint FROM pages""",
        "payload_jobs": """WITH o AS (SELECT o_custkey % 50 AS b, o_orderkey AS k FROM orders)
SELECT 'G' || b AS source_name, count(*) AS n, min('Radiologist ' || k) AS first_title, max('https://g.example/' || k) AS last_url, 'Doha' AS place, 'Great & calm' AS description FROM o GROUP BY b
UNION ALL SELECT 'R' || b, count(*), min('Radiologist ' || k), max('https://g.example/' || k), '', '' FROM o GROUP BY b
UNION ALL SELECT 'J' || b, count(*), min('Surgeon ' || k), max('https://j.example/j/' || (k % 700)), 'Akron, OH', '' FROM (SELECT b, min(k) AS k FROM o GROUP BY b, k % 700) GROUP BY b""",
        "gazetteer_places": """WITH c AS (SELECT *, (['US', 'QA', 'FR', 'AE'])[p_partkey % 4 + 1] AS c, p_partkey * 37 % 5000 AS p, CASE WHEN p_partkey % 5 <> 0 THEN 'Town ' || p_partkey ELSE p_name END AS n FROM part)
SELECT n, CASE WHEN c = 'US' THEN (p_partkey % 10)::VARCHAR WHEN c = 'QA' THEN n_name ELSE '' END AS r, c, floor((p_partkey % 90 / 3.0::DOUBLE) * 1e4 + 0.5) / 1e4 AS lat, floor((p_partkey % 170 / 7.0::DOUBLE) * 1e4 + 0.5) / 1e4 AS lon, p, CASE WHEN c = 'US' THEN '' ELSE 'Alt ' || p_partkey END AS aliases
FROM c LEFT JOIN nation ON n_nationkey = p_partkey % 10 WHERE c <> 'FR' AND (c <> 'US' OR p >= 1000)""",
        "country_centroids": f"""WITH {SITES_SQL}, k AS (SELECT country AS key, lat, lon, population % 3 AS p FROM sites UNION ALL SELECT country || ':' || region, lat, lon, population % 3 FROM sites)
SELECT key, round(floor(sum(lat * p) / sum(p) * 1e4 + 0.5) / 1e4, 3) AS lat, round(floor(sum(lon * p) / sum(p) * 1e4 + 0.5) / 1e4, 3) AS lon FROM k WHERE p > 0 GROUP BY key""",
        "feed_items": feed_queries.oracle(),
        "board_runs": feed_queries.board_runs_sql(),
        "source_states": f"""WITH s AS (SELECT s_name AS source_name, s_suppkey AS k, CASE WHEN s_suppkey % 7 <> 0 THEN {_KIND} ELSE 'none' END AS kind, s_suppkey % 12 <> 0 OR s_suppkey % 10 = 2 AS has FROM supplier),
v AS (SELECT *, kind <> 'none' AND has AS is_active FROM s WHERE k % 13 <> 0 AND kind <> 'carrier-pigeon' AND (kind = 'none' OR has)),
w AS (SELECT *, CASE WHEN NOT is_active THEN 'no endpoint' WHEN k % 9 = 1 THEN 'needs KEY' END AS skipped FROM v)
SELECT source_name, is_active, skipped, CASE WHEN skipped IS NULL THEN CASE k % 4 WHEN 0 THEN 'no response' WHEN 3 THEN 'http 503' END END AS error FROM w""",
        "places_per_country": f"WITH {SITES_SQL} SELECT country AS c, count(*) AS places FROM sites GROUP BY 1",
        "tabs": f"""WITH {_SQUARES}, {_ROLES}, {_MARKS}, g AS (SELECT area_id, count_if(side = 'a') AS na, count_if(side = 'b') AS nb FROM k GROUP BY 1)
SELECT (SELECT count_if(na > 0)::BIGINT FROM g) AS together, (SELECT count_if(pinned)::BIGINT FROM m2 WHERE board_id = 'board-3') AS pinned, 0::BIGINT AS a_results, (SELECT count(*) FROM r WHERE {_FILTERED} AND age_days <= 200) AS b_results""",
        "pins_per_area": f"WITH {_SQUARES} SELECT area_id, count(*) AS pinned FROM k WHERE score % 7 = 0 GROUP BY 1",
        "separations": core_sql._pairs("SELECT id, CASE WHEN miles < 1 THEN '<1 mi' ELSE floor(miles + 0.5)::BIGINT || ' mi' END || CASE WHEN drive_minutes < 60 THEN ' · ~' || drive_minutes || ' min' ELSE ' · ~' || (drive_minutes // 60) || 'h' || CASE WHEN drive_minutes % 60 > 0 THEN ' ' || (drive_minutes % 60) || 'm' ELSE '' END END AS apart FROM onsite"),
        "together_news": f"""WITH {_SQUARES}, fresh AS (SELECT DISTINCT area_id FROM k WHERE score >= 60) SELECT area_id, score FROM ({core_sql.area_summary()}) WHERE is_together AND area_id IN (SELECT area_id FROM fresh) ORDER BY score DESC, area_id LIMIT 4""",
        "run_counts": f"""WITH {_RUNS}, a AS ({core_sql.area_summary()}), p AS ({core_sql._pairs("SELECT count(*) AS n FROM onsite")}), c AS ({_COVERAGE})
SELECT (SELECT count(*) FROM u) AS raw, (SELECT count(*) FROM u) AS roles, (SELECT count_if(specialty = 'a')::BIGINT FROM u) AS a_roles, (SELECT count_if(specialty = 'b')::BIGINT FROM u) AS b_roles, (SELECT count_if(is_new)::BIGINT FROM u) AS new_roles, (SELECT count(*) FROM carried) AS carried,
  (SELECT n FROM p) AS pairs, (SELECT count(*) FROM a) AS areas, (SELECT count_if(is_together)::BIGINT FROM a) AS together, (SELECT count(*) FROM c) AS sources, (SELECT count_if(status = 'failed')::BIGINT FROM c) AS sources_failed""",
        "role_lifecycle": """WITH RECURSIVE s AS (SELECT (event_id % greatest(1, (SELECT count(*) FROM events) // 5))::VARCHAR AS id, epoch_us(ts) AS us, event_type NOT IN ('view', 'signup') AS failed FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY us) AS k FROM s), d AS (SELECT 14 * 86400000000 AS life),
w(id, k, first_seen, stale_since, gone, told, us) AS (
  SELECT DISTINCT id, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::STRUCT(first_seen BIGINT, stale_since BIGINT), NULL::STRUCT(change VARCHAR, first_seen BIGINT, stale_since BIGINT), NULL::BIGINT FROM n
  UNION ALL
  SELECT id, k, CASE WHEN f IS NOT NULL THEN f WHEN NOT failed THEN us END, CASE WHEN f IS NULL OR NOT failed THEN NULL ELSE coalesce(z, us) END, CASE WHEN over THEN {first_seen: was, stale_since: since} END,
    CASE WHEN f IS NULL AND NOT failed THEN {change: 'first', first_seen: us, stale_since: NULL::BIGINT} WHEN f IS NOT NULL AND failed AND z IS NULL THEN {change: 'stale', first_seen: f, stale_since: us} WHEN NOT failed AND z IS NOT NULL THEN {change: 'alive', first_seen: f, stale_since: z} END, us
  FROM (SELECT n.id, n.k, n.us, n.failed, w.first_seen AS was, w.stale_since AS since, coalesce(n.us >= w.stale_since + life, false) AS over, CASE WHEN n.us >= w.stale_since + life THEN NULL ELSE w.first_seen END AS f, CASE WHEN n.us >= w.stale_since + life THEN NULL ELSE w.stale_since END AS z
        FROM w JOIN n ON n.id = w.id AND n.k = w.k + 1, d)
), c AS (
  SELECT id, told.change AS change, us, told.first_seen AS first_seen, told.stale_since AS stale_since FROM w WHERE told IS NOT NULL
  UNION ALL SELECT id, 'evicted', gone.stale_since + life, gone.first_seen, gone.stale_since FROM w, d WHERE gone IS NOT NULL
  UNION ALL SELECT id, 'evicted', stale_since + life, first_seen, stale_since FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1), d WHERE stale_since + life <= (SELECT max(us) FROM s)
) SELECT id, change, us AS "at", first_seen, stale_since FROM c""",
        "stream_dedup": "SELECT DISTINCT user_id, 1::BIGINT AS n FROM events",
        "stream_first_seen": "SELECT user_id, min(ts) AS first_seen, count(*) AS n FROM events GROUP BY 1",
    }
