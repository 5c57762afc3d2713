"""SQL counterparts of the queries, over the same tables, for an engine without lookaround in its patterns.

Patterns are the operators' own fixed values; where they look ahead, the view's texts don't need it.
"""

from __future__ import annotations

import re

from pairwright.functions import text as T
from pairwright.operators import classify as C
from pairwright.operators import score as S
from pairwright.operators.rules import RuleSet, default
from pairwright.plans.fixtures import POSTINGS_SQL, SITES_SQL, TODAY
from pairwright.plans.other_rules import other_rules


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def hit(text: str, pattern: str | list[str]) -> str:
    pattern = "|".join(f"(?:{p})" for p in pattern) if isinstance(pattern, list) else pattern
    pattern = re.sub(r"\(\?!(?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)", "", pattern)
    return f"regexp_matches({text}, {quoted(pattern)}, 'i')"


_HAV = "2 * 3958.7613 * asin(least(1.0, sqrt(power(sin((radians({b}lat) - radians({a}lat)) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * power(sin((radians({b}lon) - radians({a}lon)) / 2), 2))))"
NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


def org_key(x: str, words: tuple) -> str:
    return f"trim(regexp_replace(regexp_replace({NORM.format(x)}, '\\b({'|'.join(words)})\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


_H = "CASE WHEN {0} > 0 AND {1} > 0 THEN 2.0::DOUBLE * {0} * {1} / ({0} + {1}) ELSE 0 END"
_PAIRS = f"""
WITH {SITES_SQL}, p AS (
  SELECT a.id || '~' || b.id AS id, a.id AS a_id, b.id AS b_id, {_HAV.format(a="a.", b="b.")} AS exact, a.score AS sa, b.score AS sb, {org_key("a.org", T.PAIR_ORG_WORDS)} AS ka, {org_key("b.org", T.PAIR_ORG_WORDS)} AS kb,
    a."precision" = 'city' AND b."precision" = 'city' AS pin, a.country = b.country AND a.country IN ('QA', 'BH', 'KW') AS small, b.work_model = 'remote' AS remote
  FROM sites a, sites b WHERE a.side = 'a' AND b.side = 'b'
), q AS (
  SELECT *, CASE WHEN pin THEN 'pinpoint' WHEN small THEN 'country-scale' ELSE 'approximate' END AS confidence, {_H.format("sa", "sb")} AS quality, ka = kb AND ka <> '' AS same_org FROM p
), onsite AS (
  SELECT id, a_id, b_id, floor(exact * 10 + 0.5) / 10 AS miles, floor(exact * 1.25 / 35 * 60 + 0.5)::BIGINT AS drive_minutes, same_org, false AS remote_partner, confidence,
    floor((quality * 0.62 + (CASE WHEN confidence = 'country-scale' AND exact > {{r}} THEN 0.5 WHEN exact >= {{r}} THEN 0 ELSE 1 - power(exact / {{r}}, 1.5) END) * 100 * 0.28 + (CASE WHEN same_org THEN 100 ELSE 0 END) * 0.1)
      * CASE confidence WHEN 'pinpoint' THEN 1.0 WHEN 'country-scale' THEN 0.85 ELSE 0.6 END + 0.5)::BIGINT AS score
  FROM q WHERE exact <= {{r}} OR confidence = 'country-scale'
), remote AS (
  SELECT id, a_id, b_id, floor(least(100.0, quality * 0.86 + 14) + 0.5)::BIGINT AS score FROM q WHERE remote
)
"""


def _pairs(select: str, radius: float = 45.0) -> str:
    return _PAIRS.format(r=f"{radius}::DOUBLE") + select


def classified(source: str, rules: RuleSet | None = None) -> str:
    """classified: a view of postings with what the rules say of them."""
    rules = rules or default()
    t, f = "titleish", "full_text"
    return f"""c0 AS (SELECT *, title || ' ' || department AS titleish, title || ' ' || department || ' ' || description AS full_text FROM {source}), c1 AS (
  SELECT *, NOT {hit(t, rules.not_attending)} AS is_attending, {hit(t, rules.other_specialty)} AS other, {hit(t, rules.ours_after_all)} AS ours, {hit(t, rules.side_a)} AS ta, {hit(t, rules.side_b)} AS tb, {hit(t, rules.interventional)} AS tir,
    {hit(f, rules.interventional)} AS fir, {hit(t, rules.physician)} AS md, {hit(f, rules.side_a)} AS fa, {hit(f, rules.side_b)} AS fb FROM c0
), c2 AS (
  SELECT *, CASE WHEN other AND NOT ours THEN NULL WHEN ta THEN 'a_title' WHEN tb THEN 'b_title' WHEN tir THEN 'ir_title' WHEN NOT (is_attending AND md AND NOT other) THEN NULL WHEN fa AND NOT fb THEN 'a_body' WHEN fb AND NOT fa THEN 'b_body' WHEN fa AND fb THEN 'both' END AS route FROM c1
), classified AS (
  SELECT *, CASE WHEN route IN ('a_title', 'a_body') THEN 'a' WHEN route IN ('b_title', 'ir_title', 'b_body') THEN 'b' END AS specialty, {hit(t, rules.locum)} AS is_locum,
    is_attending AND route IS NOT NULL AND route <> 'both' AND {hit(t, rules.leadership)} AS is_leadership, tir OR (coalesce(route, '') IN ('b_title', 'ir_title', 'b_body') AND fir) AS is_interventional,
    CASE WHEN {hit(f"org || ' ' || {f}", rules.government)} THEN 'government' WHEN {hit("org", rules.private)} THEN 'private' WHEN {hit(f"org || ' ' || {t}", rules.academic)} THEN 'academic' WHEN {hit(f, rules.private)} THEN 'private'
      WHEN {hit("description", rules.academic)} THEN 'academic' WHEN org <> '' THEN 'hospital-employed' ELSE 'unknown' END AS setting,
    CASE WHEN {hit(t, rules.remote_title)} THEN 'remote' WHEN {hit(t, rules.onsite_title)} THEN 'onsite' WHEN {hit(t, rules.hybrid_title)} THEN 'hybrid' WHEN {hit("location", rules.remote_place)} OR {hit(f, rules.remote_phrase)} THEN 'remote' WHEN {hit(f, rules.hybrid_phrase)} THEN 'hybrid' ELSE 'onsite' END AS work_model
  FROM c2
)"""


def scores(source: str, rules: RuleSet | None = None) -> str:
    """scored: a view (title, description, specialty, ..., country, prec) with score, tier and the scores' parts."""
    rules = rules or default()
    x = "title || ' ' || description"
    good = " ".join(f"+ CASE WHEN specialty = '{side}' AND {hit(x, p)} THEN {pts * 0.12!r}::DOUBLE ELSE 0 END" for side in ("a", "b") for p, pts, _ in rules.positive[side])
    bad = " ".join(f"+ CASE WHEN {hit(x, p)} THEN {pts * 0.12!r}::DOUBLE ELSE 0 END" for p, pts, _ in rules.negative)
    weights = {p: f"CASE WHEN specialty = 'a' THEN {rules.rubric['a'][k]} ELSE {rules.rubric['b'][k]} END" for k, p in enumerate(S.PARTS)}
    parts = ", ".join(f"p_{p} * ({weights[p]}) AS w_{p}" for p in S.PARTS)
    tiers = " ".join(f"WHEN score >= {n} THEN '{t}'" for n, t in rules.tiers)
    return f"""s0 AS (
  SELECT *, greatest(0, datediff('day', date_posted::DATE, DATE '{TODAY}')) AS age0, {hit(x, rules.diagnostic)} AS dx, {hit(x, rules.entry)} AS entry, {hit(x, rules.trauma)} AS trauma, {hit(x, rules.ranked)} AS ranked
  FROM {source}
), s1 AS (
  SELECT *, CASE WHEN date_posted IS NULL THEN NULL ELSE age0 END AS age_days,
    greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.55::DOUBLE {good} - CASE WHEN specialty = 'b' AND is_interventional AND NOT dx THEN 0.3::DOUBLE ELSE 0 END {bad})) AS p_specialty_fit,
    (CASE WHEN is_locum THEN 0.25 WHEN entry THEN 0.35 WHEN is_leadership THEN 0.95 ELSE 0.6 END)::DOUBLE AS p_seniority,
    least(1.0::DOUBLE, (CASE setting {" ".join(f"WHEN {quoted(k)} THEN {v}" for k, (v, _) in rules.settings.items())} ELSE 0.55 END)::DOUBLE + (CASE WHEN trauma THEN 0.1 ELSE 0 END)::DOUBLE + (CASE WHEN ranked THEN 0.05 ELSE 0 END)::DOUBLE) AS p_practice_quality,
    (CASE WHEN country IN ({', '.join(map(quoted, rules.preferred))}) THEN 0.7 ELSE 0.3 END)::DOUBLE + (CASE WHEN prec = 'city' THEN 0.15 ELSE 0 END)::DOUBLE AS p_location,
    greatest(0.15::DOUBLE, least(1.0::DOUBLE, length(description) / 1800.0::DOUBLE)) AS p_signal FROM s0
), s2 AS (
  SELECT *, (CASE WHEN age_days IS NULL THEN 0.5 WHEN age_days <= 14 THEN 1 WHEN age_days <= 45 THEN 0.75 WHEN age_days <= 90 THEN 0.45 WHEN age_days <= 180 THEN 0.25 ELSE 0.08 END)::DOUBLE AS p_recency FROM s1
), s3 AS (SELECT *, {parts} FROM s2
), s4 AS (SELECT *, floor(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 0.0::DOUBLE + {" + ".join(f"w_{p}" for p in S.PARTS)})) + 0.5)::BIGINT AS score FROM s3
), scored AS (SELECT * EXCLUDE (location), CASE {tiers} ELSE 'low' END AS tier, {", ".join(f"floor(w_{p} + 0.5)::BIGINT AS {p}" for p in S.PARTS)} FROM s4)"""


_NOT_ATTENDING = quoted(C.REASONS["not_attending"])
_WHY = "CASE route " + " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in C.REASONS.items() if k != "not_attending") + " END"


def _classified(rules: RuleSet | None = None) -> str:
    return f"{POSTINGS_SQL}, {classified('postings', rules)}"


def _scored(rules: RuleSet | None = None) -> str:
    """Scores of relevant postings whose places are told by a comma and a name alone."""
    placed = "SELECT *, CASE WHEN contains(location, 'Qatar') THEN 'QA' WHEN location = '' THEN NULL ELSE 'US' END AS country, CASE WHEN contains(location, ',') THEN 'city' ELSE 'region' END AS prec FROM classified WHERE is_attending AND specialty IS NOT NULL"
    return f"{_classified(rules)}, placed AS ({placed}), {scores('placed', rules)}"


def area_walk(radius: float = 45.0) -> str:
    """walk: id and area_id of one walk over all located roles, one row of the recursion for each, which carries the open areas."""
    role = "SELECT row_number() OVER (ORDER BY score DESC, ordinal) AS k, id, lat, lon, country, \"precision\" = 'city' AS pinned FROM sites"
    miles = _HAV.replace("{b}lat", "(a.y / a.n)").replace("{b}lon", "(a.x / a.n)").format(a="o.")
    far = f"[CASE WHEN NOT o.pinned AND a.home IS NOT NULL AND a.home <> o.country THEN NULL ELSE {miles} END FOR a IN w.areas]"
    joined = "[CASE WHEN a.id = far_areas[hit].id THEN {id: a.id, n: a.n + 1, y: a.y + lat, x: a.x + lon, home: a.home} ELSE a END FOR a IN far_areas]"
    return f"""o AS MATERIALIZED ({role}), w(k, id, area_id, areas) AS (
  SELECT 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, []::STRUCT(id VARCHAR, n BIGINT, y DOUBLE, x DOUBLE, home VARCHAR)[]
  UNION ALL
  SELECT k, id, CASE WHEN hit IS NULL THEN id ELSE far_areas[hit].id END, CASE WHEN hit IS NULL THEN list_append(far_areas, {{id: id, n: 1::BIGINT, y: lat, x: lon, home: country}}) ELSE {joined} END
  FROM (SELECT o.*, w.areas AS far_areas, {far} AS far, CASE WHEN list_min(far) <= {radius} THEN list_position(far, list_min(far)) END AS hit FROM w JOIN o ON o.k = w.k + 1)
), walk AS MATERIALIZED (SELECT id, area_id FROM w WHERE k > 0), centres AS (SELECT unnest(areas, recursive := true) FROM (SELECT areas FROM w ORDER BY k DESC LIMIT 1))"""


def area_assign(radius: float = 45.0) -> str:
    return f"WITH RECURSIVE {SITES_SQL}, {area_walk(radius)} SELECT walk.id, area_id, round(y / n, 6) AS area_lat, round(x / n, 6) AS area_lon FROM walk JOIN centres ON centres.id = area_id"


def area_bands() -> str:
    found = area_summary(f"RECURSIVE {SITES_SQL}, {area_walk()}, m AS (SELECT sites.*, area_id FROM sites JOIN walk USING (id))")
    return f"""SELECT area_id, key, label, CASE WHEN is_together THEN 'together' WHEN remote_unlocked THEN 'remote-unlocked' ELSE 'one-sided' END AS band, score, a_count, b_count, span_miles, missing_side FROM ({found})
QUALIFY is_together OR remote_unlocked OR row_number() OVER (PARTITION BY is_together OR remote_unlocked ORDER BY greatest(best_a, best_b) DESC, area_id) <= 12"""


def area_summary(members: str = f"{SITES_SQL}, m AS (SELECT *, floor(lat * 2)::BIGINT || '_' || floor(lon * 2)::BIGINT AS area_id FROM sites)") -> str:
    return f"""WITH {members}, k AS (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY score DESC, ordinal) AS rnk FROM m),
pool AS (SELECT count(*) AS pool, coalesce(max(score), 0) AS pool_best FROM sites WHERE side = 'b' AND work_model = 'remote'),
sp AS (SELECT a.area_id, max({_HAV.format(a="a.", b="b.")}) AS span FROM k a JOIN k b ON a.area_id = b.area_id AND a.side = 'a' AND b.side = 'b' GROUP BY 1),
so AS (SELECT DISTINCT a.area_id FROM k a JOIN k b ON a.area_id = b.area_id AND a.side = 'a' AND b.side = 'b' AND a.org = b.org),
g AS (SELECT area_id, count_if(side = 'a')::BIGINT AS a_count, count_if(side = 'b')::BIGINT AS b_count, coalesce(max(score) FILTER (side = 'a'), 0) AS best_a, coalesce(max(score) FILTER (side = 'b'), 0) AS best_b, bool_or("precision" <> 'city') AS approximate,
  coalesce(string_agg(id, ',' ORDER BY rnk) FILTER (side = 'a'), '') AS a_ids, first(city ORDER BY "precision" <> 'city', CASE WHEN "precision" = 'city' THEN -population ELSE 0 END, rnk) AS city,
  first(region ORDER BY "precision" <> 'city', CASE WHEN "precision" = 'city' THEN -population ELSE 0 END, rnk) AS region, first(country ORDER BY "precision" <> 'city', CASE WHEN "precision" = 'city' THEN -population ELSE 0 END, rnk) AS country FROM k GROUP BY 1),
h AS (SELECT g.*, coalesce(span, 0) AS span, so.area_id IS NOT NULL AS same_org, a_count > 0 AND b_count > 0 AS is_together, pool, pool_best, least(a_count, b_count) AS depth FROM g LEFT JOIN sp ON sp.area_id = g.area_id LEFT JOIN so ON so.area_id = g.area_id, pool),
i AS (SELECT *, floor(greatest(0.0, least(100.0, (CASE WHEN is_together THEN {_H.format("best_a", "best_b")} ELSE greatest(best_a, best_b) * 0.35::DOUBLE END) * 0.72::DOUBLE + (CASE WHEN span >= 45 THEN 0 ELSE 1 - power(span / 45.0::DOUBLE, 1.5) END) * 100 * 0.18::DOUBLE
  + (CASE WHEN depth > 1 THEN least(12, (depth - 1) * 5) ELSE 0 END) + (CASE WHEN same_org THEN 8 ELSE 0 END) - (CASE WHEN approximate THEN 6 ELSE 0 END))) + 0.5)::BIGINT AS base_score, NOT is_together AND a_count > 0 AND pool > 0 AS remote_unlocked FROM h)
SELECT area_id, city || CASE WHEN country = 'US' THEN ', ' || region ELSE CASE country WHEN 'QA' THEN ', Qatar' WHEN 'AE' THEN ', UAE' WHEN 'SA' THEN ', Saudi Arabia' WHEN 'KW' THEN ', Kuwait' WHEN 'BH' THEN ', Bahrain' ELSE '' END END AS label,
  country || ':' || lower(region) || ':' || regexp_replace(lower(city), '[^a-z0-9]+', '-', 'g') AS key, is_together, a_count, b_count, best_a, best_b, floor(span * 10 + 0.5) / 10 AS span_miles, same_org, approximate,
  CASE WHEN remote_unlocked THEN greatest(base_score, floor(least(100.0, ({_H.format("best_a", "pool_best")}) * 0.8::DOUBLE) + 0.5)::BIGINT) ELSE base_score END AS score, CASE WHEN is_together THEN NULL WHEN a_count > 0 THEN 'b' ELSE 'a' END AS missing_side, remote_unlocked, a_ids FROM i"""


def oracles() -> dict[str, str]:
    email, phone = quoted(T.EMAIL), quoted(T.PHONE)
    distinct = "list_filter({0}, lambda v, i: list_position({0}, v) = i)"

    def contact(noise: str | None) -> str:
        e = distinct.format("e")
        if noise:
            e = f"list_filter({e}, lambda v: NOT regexp_matches(v, {quoted(noise)}, 'i'))"
        p = "list_filter(p, lambda v: regexp_matches(v, '[()\\s.+-]'))"
        return f"""WITH a AS (SELECT doc_id, regexp_extract_all(text, {email}) AS e, list_transform(regexp_extract_all(text, {phone}), lambda v: trim(v)) AS p FROM documents),
b AS (SELECT doc_id, list_slice({e}, 1, 4) AS e, {p} AS p FROM a), c AS (SELECT doc_id, e, list_slice({distinct.format("p")}, 1, 3) AS p FROM b)
SELECT doc_id, array_to_string(e, '|') AS emails, array_to_string(p, '|') AS phones, array_to_string(list_transform(p, lambda v: regexp_replace(v, '[^\\d+]', '', 'g')), '|') AS dial FROM c WHERE len(e) > 0 OR len(p) > 0"""

    html = "html"
    for pattern, by, flags in [
        ("<script.*?</script>", "' '", "gis"), ("<style.*?</style>", "' '", "gis"), (r"<br\s*/?>", "chr(10)", "gi"), ("</(p|div|li|h[1-6]|tr)>", "chr(10)", "gi"), ("<[^>]+>", "' '", "g"), ("&nbsp;", "' '", "gi"), ("&amp;", "'&'", "gi"),
        ("&lt;", "'<'", "gi"), ("&gt;", "'>'", "gi"), ("&quot;", "'\"'", "gi"), (r"[ \t]+", "' '", "g"), (r"\n{3,}", "chr(10) || chr(10)", "g"), (r"^\s+|\s+$", "''", "g"),
    ]:
        html = f"regexp_replace({html}, {quoted(pattern)}, {by}, '{flags}')"
    org = "CASE WHEN org <> '' THEN org ELSE 'url:' || url END"
    found = {
        "pairs_onsite": _pairs("SELECT * FROM onsite"),
        "pairs_remote": _pairs("SELECT * FROM remote"),
        "pairs_all_counts": _pairs(
            "SELECT remote_partner, confidence, count(*) AS n, sum(score)::BIGINT AS total_score, count_if(same_org)::BIGINT AS n_same_org FROM (SELECT remote_partner, confidence, score, same_org FROM onsite UNION ALL SELECT true, 'remote-partner', score, false FROM remote) GROUP BY ALL"
        ),
        "pairs_country_scale": _pairs("SELECT id, miles, score FROM onsite WHERE confidence = 'country-scale'"),
        "pairs_best": _pairs("SELECT a_id, b_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) AS rank FROM onsite) WHERE rank <= 3", 60.0),
        "pairs_by_radius": " UNION ALL ".join(f"SELECT {r}.0::DOUBLE AS radius, * FROM ({_pairs('SELECT id, miles, confidence, score FROM onsite', float(r))})" for r in (15, 45, 60)),
        "area_summary": area_summary(),
        "area_assign": area_assign(),
        "area_bands": area_bands(),
        "html_to_text": f"SELECT page_id, {html} AS text FROM pages",
        "contacts": contact(None),
        "contacts_without_noise": contact(T.NOISE_EMAIL),
        "norm_keys": f"WITH {POSTINGS_SQL} SELECT DISTINCT org, title, {NORM.format('title')} AS title_key, {org_key('org', T.MERGE_ORG_WORDS)} AS merge_key, {org_key('org', T.PAIR_ORG_WORDS)} AS pair_key FROM postings",
        "fingerprints": f"WITH {POSTINGS_SQL} SELECT {org_key(org, T.MERGE_ORG_WORDS)} || '::' || {NORM.format('title')} || '::' || {NORM.format('location')} AS fp, count(*) AS copies, min(posting_ordinal) AS first_ordinal FROM postings GROUP BY 1",
        "classify_postings": f"WITH {_classified()} SELECT posting_ordinal, specialty, is_attending, is_interventional, is_locum, is_leadership, setting, work_model, array_to_string(list_filter([CASE WHEN NOT is_attending THEN {_NOT_ATTENDING} END, {_WHY}], lambda r: r IS NOT NULL), '; ') AS reasons FROM classified",
        "setting_counts": f"WITH {_classified()} SELECT setting, work_model, count(*) AS n FROM classified GROUP BY ALL",
        "relevant_counts": f"WITH {_classified()} SELECT specialty, source_name, count(*) AS n, count_if(is_interventional)::BIGINT AS n_ir FROM classified WHERE is_attending AND specialty IS NOT NULL GROUP BY ALL",
        "other_sides": f"WITH {_scored(other_rules())} SELECT posting_ordinal, specialty, setting, is_leadership, score, tier, {', '.join(S.PARTS)} FROM scored",
        "score_parts": f"WITH {_scored()} SELECT posting_ordinal, score, tier, coalesce(age_days, -1)::BIGINT AS age_days, {', '.join(S.PARTS)} FROM scored",
        "score_shares": f"WITH {_scored()} SELECT tier, {', '.join(f'sum(floor(greatest(0.0, least(100.0, {p} / {c}.0::DOUBLE * 100)) + 0.5))::BIGINT AS {p}' for p, c in S.CEILING.items())}, count(*) AS n FROM scored GROUP BY 1",
    }
    from pairwright.plans import board_sql, role_sql

    return found | role_sql.oracles() | board_sql.oracles()
