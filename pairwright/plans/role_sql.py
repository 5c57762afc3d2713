"""SQL counterparts of the way from postings to roles: places, employers, scores, the merge and the funnel."""

from __future__ import annotations

from pairwright.functions import text as T
from pairwright.operators import geocode as G
from pairwright.operators import roles as R
from pairwright.operators import score as S
from pairwright.plans.core_sql import NORM, classified, hit, org_key, quoted, scores
from pairwright.plans.fixtures import POSTINGS_SQL, TODAY
from pairwright.plans.gazetteer import PLACES


def _map(values: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in values.items()) + "}"


def _place_key(x: str) -> str:
    out = f"regexp_replace(regexp_replace(lower({x}), '[.''`‘’]', '', 'g'), '[^a-z0-9]+', ' ', 'g')"
    for short, full in (("st", "saint"), ("mt", "mount"), ("ft", "fort")):
        out = f"regexp_replace({out}, '\\b{short}\\b', '{full}', 'g')"
    return f"trim({out})"


def _spellings(x: str) -> str:
    """A list of the keys of a place, best first; some may come twice or be null."""
    article = f"regexp_replace({{0}}, {quoted(T._ARTICLE)}, '')"
    of = lambda k: [k, f"regexp_replace({k}, '\\s+city$', '')", article.format(k), f"regexp_replace({article.format(k)}, '\\s+city$', '')"]
    return f"[{', '.join([*of(x), *of(f'{_map(T.CITY_ALIASES)}[{x}]')])}]"


def _gazetteer() -> str:
    rows = sorted(PLACES, key=lambda p: -p[5])
    values = ", ".join(f"({i}, {quoted(n)}, {quoted(r)}, {quoted(c)}, {p}, [{', '.join(map(quoted, a))}]::VARCHAR[])" for i, (n, r, c, _, _, p, a) in enumerate(rows))
    return f"""gaz(place, n, r, c, p, aliases) AS (VALUES {values}),
gaz_names AS (SELECT gaz.*, unnest({_spellings(_place_key("n"))}) AS key, {_place_key("r")} AS region_key FROM gaz),
gaz_all AS (SELECT place, c, key FROM gaz_names UNION SELECT place, c, unnest({_spellings(_place_key("alias"))}) FROM (SELECT place, c, unnest(aliases) AS alias FROM gaz)),
centres AS (SELECT c AS key FROM gaz UNION SELECT c || ':' || r FROM gaz)"""


def _ladder(raws: str) -> str:
    """geo: raw, city, region, country, population and precision of every row of `raws` (raw)."""
    codes = "[" + ", ".join(quoted(c) for c in sorted(set(G.US_STATES.values()))) + "]"
    code = "regexp_replace(upper({0}), '[^A-Z]', '', 'g')"
    state = lambda x: f"coalesce({_map(G.US_STATES)}[{_place_key(x)}], CASE WHEN list_contains({codes}, {code.format(x)}) THEN {code.format(x)} END)"
    country = lambda x: f"{_map(G.COUNTRIES)}[{_place_key(x)}]"
    clean = f"regexp_replace(regexp_replace(raw, {quoted(G.REMOTE)}, ' ', 'i'), {quoted(G.NOISE)}, ' ', 'i')"
    clean = f"trim(regexp_replace(regexp_replace({clean}, '[^\\p{{L}}\\p{{N}}\\s,;/&()\\-]', ' ', 'g'), '\\s+', ' ', 'g'))"
    return f"""g0 AS (SELECT raw, regexp_matches(raw, {quoted(G.REMOTE)}, 'i') AS is_remote, list_filter(list_transform(string_split(regexp_split_to_array({clean}, '(?i)[;/]|\\s+or\\s+')[1], ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM {raws}),
g1 AS (SELECT *, coalesce(parts[-1], '') AS last FROM g0),
g2 AS (SELECT *, CASE WHEN len(parts) = 1 THEN coalesce('US:' || {state("last")}, {country("last")}) END AS lone, CASE WHEN len(parts) > 1 THEN {country("last")} END AS country0 FROM g1),
g3 AS (SELECT *, CASE WHEN country0 IS NULL THEN parts ELSE parts[:-2] END AS tail0 FROM g2),
g4 AS (SELECT *, CASE WHEN len(tail0) > 1 THEN {state("coalesce(tail0[-1], '')")} END AS region0 FROM g3),
g5 AS (SELECT *, CASE WHEN region0 IS NULL THEN tail0 ELSE tail0[:-2] END AS tail, coalesce(country0, CASE WHEN region0 IS NOT NULL THEN 'US' END) AS country1 FROM g4),
g6 AS (SELECT *, {_place_key("array_to_string(tail, ' ')")} AS base FROM g5),
g7 AS (SELECT raw, region0, country1, unnest(k) AS key, generate_subscripts(k, 1) AS pos FROM (SELECT *, {_spellings("base")} AS k FROM g6)),
g8 AS (SELECT raw, pos, place FROM g7 JOIN gaz_names z ON z.key = g7.key AND z.region_key = {_place_key("region0")} WHERE g7.key <> ''
  UNION ALL SELECT raw, pos, place FROM g7 JOIN gaz_all z ON z.key = g7.key AND (country1 IS NULL OR z.c = country1) WHERE region0 IS NULL AND g7.key <> ''),
g9 AS (SELECT raw, first(place ORDER BY pos, place) AS place FROM g8 GROUP BY raw),
g10 AS (SELECT g6.*, g9.place, coalesce(lone, country1 || ':' || region0, country1) AS akey, coalesce(country1, split_part(lone, ':', 1)) AS ckey FROM g6 LEFT JOIN g9 ON g9.raw = g6.raw),
g11 AS (SELECT *, akey IN (SELECT key FROM centres) AS known, ckey IN (SELECT key FROM centres) AS cknown FROM g10),
g12 AS (SELECT *, lone IS NOT NULL AND coalesce(known, false) AS is_lone FROM g11),
g13 AS (SELECT *, NOT is_lone AND place IS NOT NULL AS is_city FROM g12),
g14 AS (SELECT *, NOT is_city AND coalesce(contains(akey, ':') AND known, false) AS has_region FROM g13),
g15 AS (SELECT *, NOT is_city AND NOT has_region AND coalesce(cknown, false) AND (is_lone OR country1 IS NOT NULL) AS has_country FROM g14),
geo AS (SELECT raw, CASE WHEN is_city THEN n END AS city, CASE WHEN is_city THEN nullif(r, '') WHEN has_region THEN split_part(akey, ':', 2) END AS region, CASE WHEN is_city THEN c WHEN has_region OR has_country THEN ckey END AS country,
  CASE WHEN is_city THEN p END AS population, CASE WHEN is_city THEN 'city' WHEN has_region THEN 'region' WHEN has_country THEN 'country' WHEN is_remote THEN 'remote' ELSE 'none' END AS "precision"
  FROM g15 LEFT JOIN gaz ON gaz.place = g15.place)"""


def _located() -> str:
    """located: postings with location_text, and geo over every string that may be one."""
    names = "|".join(w.title() for w in sorted(G.US_STATES, key=len, reverse=True))
    loose = rf"\b([A-Z][A-Za-z.'-]+(?: [A-Z][A-Za-z.'-]+){{0,2}},\s*(?:{G.STATE_CODES}|{names}))\b"
    bare = r"\b([A-Z][a-z]{3,}(?: [A-Z][a-z]{3,})?)\b"
    tail = lambda k: f"nullif(trim(regexp_extract(title, {quoted(T.TITLE_PLACE)}, {k})), '')"
    field = f"CASE WHEN location <> '' AND NOT regexp_matches(location, {quoted(G.PLACEHOLDER)}, 'i') THEN location END"
    return f"""{POSTINGS_SQL}, {_gazetteer()},
l0 AS (SELECT *, coalesce({field}, {tail(1)}, {tail(2)}, nullif(trim(regexp_extract(substr(description, 1, 4000), {quoted(G.BODY_PLACE)}, 1)), '')) AS explicit FROM postings),
l1 AS (SELECT DISTINCT w FROM (SELECT substr(title || chr(10) || substr(description, 1, 4000), 1, 3000) AS w FROM l0 WHERE explicit IS NULL)),
l2 AS (SELECT w, 0 AS stage, 1 AS pos, regexp_extract(w, {quoted(G.GULF_PLACE)}, 1) AS raw FROM l1
  UNION ALL SELECT w, 1, generate_subscripts(x, 1), unnest(x) FROM (SELECT w, regexp_extract_all(w, {quoted(loose)}, 1) AS x FROM l1)
  UNION ALL SELECT w, 2, generate_subscripts(x, 1), unnest(x) FROM (SELECT w, regexp_extract_all(w, {quoted(bare)}, 1) AS x FROM l1)),
raws AS (SELECT DISTINCT trim(raw) AS raw FROM (SELECT explicit AS raw FROM l0 WHERE explicit IS NOT NULL UNION ALL SELECT raw FROM l2 UNION ALL SELECT '')),
{_ladder("raws")},
l3 AS (SELECT w, first(l2.raw ORDER BY stage, pos) AS inferred FROM l2 JOIN geo ON geo.raw = l2.raw WHERE "precision" = 'city' AND (stage < 2 OR population >= {G.LEAST_BARE_POPULATION}) GROUP BY w),
located AS (SELECT l0.* EXCLUDE (explicit), coalesce(explicit, inferred, '') AS location_text FROM l0 LEFT JOIN l3 ON explicit IS NULL AND l3.w = substr(title || chr(10) || substr(description, 1, 4000), 1, 3000))"""


def _employer(source: str) -> str:
    """employed: source (title, org, source_name, category) with employer and clean_title."""
    generic = "[" + ", ".join(quoted(g) for g in sorted(R.GENERIC)) + "]"
    sign = r"^\s*(\([^)]*\))?\s*[:|–—]\s*"
    title = f"CASE WHEN board AND employer <> '' AND starts_with(title, employer) AND regexp_matches(substr(title, length(employer) + 1), {quoted(sign)}) THEN regexp_replace(substr(title, length(employer) + 1), {quoted(sign)}, '') ELSE title END"
    return f"""e0 AS (SELECT *, trim(org) = '' OR trim(org) = source_name AS board, trim(regexp_replace(regexp_extract(trim(title), '^([^:|–—]{{3,60}}?)\\s*[:|–—]\\s*(.+)$', 1), '\\s*\\([^)]*\\)\\s*$', '')) AS head FROM {source}),
e1 AS (SELECT *, CASE WHEN {hit("head", R.ORG_WORD)} AND NOT {hit("head", R.SPECIALTY_HEAD)} AND NOT {hit("head", R.HEADLINE)} AND NOT {hit("head", R.JOB_WORD)}
  AND (len(list_filter(regexp_split_to_array(head, '[\\s\\-–—]+'), lambda w: regexp_matches(w, '^[A-Z]') AND NOT list_contains({generic}, regexp_replace(lower(w), '[^a-z]', '', 'g')))) > 0 OR {hit("head", R.ENTITY)}) THEN head ELSE '' END AS inferred_org FROM e0),
e2 AS (SELECT *, CASE WHEN NOT board THEN trim(org) WHEN inferred_org <> '' THEN inferred_org WHEN category IN ('aggregator', 'society-board') THEN '' ELSE trim(org) END AS employer FROM e1),
employed AS (SELECT * EXCLUDE (board, head, inferred_org), trim(regexp_replace(regexp_replace(regexp_replace({title}, {quoted(T.TITLE_PLACE)}, '', 'g'), '\\s{{2,}}', ' ', 'g'), '[\\s–—-]+$', '')) AS clean_title FROM e2)"""


def _roles(text: str = "substr(description, 1, 1500)") -> str:
    """stated (every posting with its fate) and scored (every role before the merge). text: what scores go by; those who only count roles keep the beginning."""
    posting = "SELECT * EXCLUDE (org, location), CASE WHEN org <> '' THEN org ELSE source_name END AS org, location_text AS location, org AS own_org FROM located"
    owner = "CASE WHEN org <> '' THEN org ELSE 'url:' || url END"
    return f"""{_located()}, seen AS ({posting}), {classified("seen")},
stated AS (SELECT * EXCLUDE (org), own_org AS org, CASE WHEN NOT is_attending OR specialty IS NULL THEN 'irrelevant' WHEN datediff('day', date_posted::DATE, DATE '{TODAY}') > {R.MAX_AGE_DAYS} THEN 'expired' ELSE 'role' END AS fate FROM classified),
{_employer("(SELECT * FROM stated WHERE fate = 'role')")},
placed AS (SELECT employed.* EXCLUDE (title, org, employer, clean_title, setting, description), clean_title AS title, employer AS org, {text} AS description, city, region, country, CASE WHEN "precision" = 'none' AND work_model = 'remote' THEN 'remote' ELSE "precision" END AS prec,
  CASE WHEN setting IN ('hospital-employed', 'unknown') AND category IN ('specialty-group', 'teleradiology') THEN 'private' ELSE setting END AS setting FROM employed JOIN geo ON geo.raw = trim(location_text)),
{scores("placed")}, named AS (SELECT *, {org_key(owner, T.MERGE_ORG_WORDS)} || '::' || {NORM.format("title")} || '::' || {NORM.format("coalesce(city, '')")} AS id FROM scored)"""


def oracles() -> dict[str, str]:
    rank = "CASE category " + " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in R.SOURCE_RANKS.items()) + " ELSE 0 END"
    reasons = [f"CASE WHEN specialty = '{side}' AND {hit('x', p)} THEN {quoted(why)} END" for side in ("a", "b") for p, _, why in S.POSITIVE[side]]
    reasons += ["CASE WHEN is_leadership THEN 'leadership scope (chief / director / division head)' END"] + [f"CASE WHEN setting = {quoted(k)} THEN {quoted(why)} END" for k, (_, why) in S.SETTINGS.items()]
    reasons += ["CASE WHEN trauma THEN 'Level I trauma centre' END", "CASE WHEN work_model = 'remote' THEN 'remote / teleradiology' END", "CASE WHEN age_days <= 14 THEN 'posted within two weeks' END"]
    concerns = ["CASE WHEN specialty = 'b' AND is_interventional AND NOT dx THEN 'interventional-only — outside a diagnostic/general practice' END"] + [f"CASE WHEN {hit('x', p)} THEN {quoted(why)} END" for p, _, why in S.NEGATIVE]
    concerns += ["CASE WHEN entry THEN 'pitched at entry level' END", "CASE WHEN is_locum THEN 'locum / temporary, not a permanent post' END", "CASE WHEN prec <> 'city' THEN 'location is vague — resolved only to a state or country' END"]
    concerns += ["CASE country " + " ".join(f"WHEN {quoted(k)} THEN {quoted('Requires ' + v)}" for k, v in S.LICENCES.items()) + " END", "CASE WHEN age_days > 180 THEN 'posting is about ' || floor(age_days / 30.0 + 0.5)::BIGINT || ' months old — likely filled' END", "CASE WHEN length(description) < 300 THEN 'thin posting — little detail to evaluate' END"]
    plain = f"""{POSTINGS_SQL}, {classified("postings")}, placed AS (SELECT *, CASE WHEN contains(location, 'Qatar') THEN 'QA' WHEN location = '' THEN NULL ELSE 'US' END AS country, CASE WHEN contains(location, ',') THEN 'city' ELSE 'region' END AS prec FROM classified WHERE is_attending AND specialty IS NOT NULL), {scores("placed")}"""
    return {
        "geocoded": f'WITH {POSTINGS_SQL}, {_gazetteer()}, raws AS (SELECT DISTINCT trim(location) AS raw FROM postings), {_ladder("raws")} SELECT raw, city, region, country, "precision", count(*) AS n FROM postings JOIN geo ON raw = trim(location) GROUP BY ALL',
        "location_text": f"WITH {_located()} SELECT location_text, count(*) AS n FROM located GROUP BY 1",
        "employers": f"WITH {POSTINGS_SQL}, {_employer('postings')} SELECT posting_ordinal, employer, clean_title FROM employed",
        "score_reasons": f"""WITH {plain}, y AS (SELECT *, title || ' ' || description AS x FROM scored), z AS (SELECT specialty, 'reason' AS kind, unnest(list_distinct([{', '.join(reasons)}])) AS why FROM y UNION ALL SELECT specialty, 'concern', unnest(list_distinct([{', '.join(concerns)}])) FROM y)
SELECT specialty, kind, why, count(*) AS n FROM z WHERE why IS NOT NULL GROUP BY ALL""",
        "merged_roles": f"""WITH {_roles("description")}, m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {rank} DESC, score DESC, source_ordinal, posting_ordinal) AS nth, count(*) OVER (PARTITION BY id) AS copies FROM named),
o AS (SELECT id, list_sort(list(DISTINCT source_name)) AS sources FROM named GROUP BY id)
SELECT m.id, title, org, specialty, score, tier, setting, work_model, city, prec AS "precision", copies, source_name, array_to_string(list_filter(sources, lambda s: s <> source_name), '|') AS also_seen_on FROM m JOIN o ON o.id = m.id WHERE nth = 1""",
        "funnel_counts": f"""WITH {_roles()} SELECT (SELECT count(*) FROM stated) AS raw, (SELECT count(*) FROM stated WHERE fate = 'irrelevant') AS irrelevant, (SELECT count(*) FROM stated WHERE fate = 'expired') AS expired,
(SELECT count(*) FROM named WHERE prec = 'none') AS unlocated, (SELECT count(*) - count(DISTINCT id) FROM named) AS duplicates, (SELECT count(DISTINCT id) FROM named) AS roles""",
    }

