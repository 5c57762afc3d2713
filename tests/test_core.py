import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.functions import text as T
from pairwright.functions.geo import haversine_miles
from pairwright.operators import areas, board, classify, geocode, pairs, roles, snapshot
from pairwright.operators.graph import components
from pairwright.plans.gazetteer import places
from pairwright.sources import payloads, registry

SITE = "id string, side string, org string, score long, lat double, lon double, country string, region string, city string, population long, precision string, work_model string, ordinal long"


def miles(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 3958.7613 * math.asin(min(1, math.sqrt(h)))


def scatter(n, spread=3.0, lat=40.0, lon=-80.0):
    return [(f"r{i}", "a" if i % 3 else "b", f"Org {i % 5}", (i * 37) % 101, lat + (i * 7919 % 1000) / 1000 * spread, lon + (i * 104729 % 1000) / 1000 * spread, "US", "OH", f"City {i % 9}", i * 31 % 1000, "region" if i % 6 == 0 else "city", "remote" if i % 11 == 0 else "onsite", i) for i in range(n)]


@pytest.mark.parametrize(("lat", "lon"), [(40.0, -80.0), (69.5, 179.0), (-1.0, -1.0)])
def test_grid_finds_what_brute_force_finds(spark, lat, lon):
    rows = [(*r[:4], r[4], (r[5] + 180) % 360 - 180, *r[6:]) for r in scatter(150, 2.5, lat, lon)]
    got = {(r.a_id, r.b_id) for r in pairs.within_radius(spark.createDataFrame(rows, SITE), 45.0).collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[1] == "a" and b[1] == "b" and miles(a[4:6], b[4:6]) <= 45}


def test_distance_matches_formula_and_nulls(spark):
    df = spark.createDataFrame([(41.5, -81.7, 41.08, -81.52), (None, 1.0, 2.0, 3.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(haversine_miles(*map(F.col, "abcd"))).collect()]
    assert got[0] == pytest.approx(miles((41.5, -81.7), (41.08, -81.52))) and got[1] is None


def test_areas_match_one_walk_over_all_roles(spark):
    rows = scatter(220, 9.0)
    got = {r.id: r.area_id for r in areas.assign_areas(spark.createDataFrame(rows, SITE)).collect()}
    clusters, want = [], {}
    for r in sorted(rows, key=lambda r: (-r[3], r[12])):
        near = [(miles(r[4:6], c["at"]), k) for k, c in enumerate(clusters)]
        best = min(near, default=(1e9, -1))
        if best[0] <= 45:
            c = clusters[best[1]]
        else:
            c = {"id": r[0], "members": []}
            clusters.append(c)
        c["members"].append(r)
        c["at"] = tuple(sum(m[i] for m in c["members"]) / len(c["members"]) for i in (4, 5))
        want[r[0]] = c["id"]
    assert got == want


@pytest.mark.parametrize("width", [45.0, 90.0, 100000.0])
def test_tiles_of_any_width_give_the_same_areas(spark, width):
    """Across the date line and near a pole, with vague roles, ties of score and repeated places; narrow tiles need many rounds."""
    rows = [(*r[:3], r[3] // 10 * 10, lat + r[4] - 40, (r[5] + shift + 180) % 360 - 180, *r[6:]) for lat, shift in ((40, 0), (69, 262)) for r in scatter(120, 6.0)]
    rows = [(f"{i}-{r[0]}", *r[1:12], i, *r[13:]) for i, r in enumerate(rows + rows[:5])]
    df = spark.createDataFrame(rows, SITE)
    key = [c.split()[0] for c in SITE.split(",")]
    tile, want, centre = areas._Tile(45.0, 85.0), {}, {}
    for r in sorted((dict(zip(key, r)) for r in rows), key=lambda r: (-r["score"], r["ordinal"])):
        want[r["id"]] = tile.choose(r["lat"], r["lon"], r["precision"] == "city", r["country"]) or r["id"]
        centre[want[r["id"]]] = tile.join(want[r["id"]], r["lat"], r["lon"], r["country"])
    got = areas.assign_areas(df, 45.0, width).collect()
    assert {r.id: r.area_id for r in got} == want and all((r.area_lat, r.area_lon) == centre[r.area_id] for r in got)


def test_components(spark):
    got = {r.v: r.c for r in components(spark.createDataFrame([(i, i + 1) for i in range(10, 60)] + [(1, 2), (5, 5)], "a long, b long")).collect()}
    assert got == {**{i: 10 for i in range(10, 61)}, 1: 1, 2: 1}


@pytest.mark.parametrize(("title", "body", "specialty", "attending"), [
    ("Vascular Surgeon", "", "a", True), ("Diagnostic Radiologist", "", "b", True), ("Radiologist Assistant", "", "b", False), ("Clinical Assistant Professor, Vascular Surgery", "", "a", True),
    ("Cardiothoracic & Vascular Anesthesiologist", "endovascular", None, True), ("Consultant", "we need a radiologist", "b", True), ("Consultant", "radiologist and vascular surgeon", None, True), ("Medical Assistant II, Vascular Surgery", "", "a", False),
])
def test_specialty(spark, title, body, specialty, attending):
    row = classify.classify(spark.createDataFrame([(title, "", "", body, "")], "title string, department string, org string, description string, location string")).first()
    assert (row.specialty, row.is_attending) == (specialty, attending)


@pytest.mark.parametrize(("title", "body", "place", "want"), [
    ("Vascular Surgeon", "a hybrid OR available", "", "onsite"), ("Hybrid Role in Tyler, Radiologist", "", "", "hybrid"), ("Radiologist (Onsite or Remote)", "", "", "remote"), ("On-site Radiologist", "remote reading", "", "onsite"), ("Radiologist", "", " Remote ", "remote"), ("Radiologist", "a remote rural town", "", "onsite"),
])
def test_work_model(spark, title, body, place, want):
    assert classify.classify(spark.createDataFrame([(title, None, None, body, place)], "title string, department string, org string, description string, location string")).first().work_model == want


def test_geocode_ladder(spark):
    want = {"St. Louis, MO": ("St. Louis", "city"), "Danville, OH": (None, "region"), "Texas": (None, "region"), "Qatar": (None, "country"), "Al Khobar": ("Khobar", "city"), "Remote": (None, "remote"), "": (None, "none"), "Springfield": ("Springfield", "city"), "Remote - Cleveland, Ohio": ("Cleveland", "city")}
    got = geocode.geocode(spark.createDataFrame([(k,) for k in want] + [(None,)], "raw string"), places(spark))
    assert {r.raw: (r.city, r.precision) for r in got.collect()} == want


def test_employer_from_title(spark):
    titles = ["Select Radiology Solutions: Radiologist", "Diagnostic Radiology: Physician", "Build your health career: Surgeon", "Radiology - MSK or Body Imaging", "Irving Radiology (Dallas, TX) | Night Radiologist"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in titles], "t string").select(roles.infer_org(F.col("t"))).collect()]
    assert got == ["Select Radiology Solutions", "", "", "", "Irving Radiology"]


def test_dates(spark):
    values = ["2026-08-01", "2026-08-01T10:00:00Z", "Sat, 01 Aug 2026 10:00:00 GMT", "2026-08-01 garbage", "Posted 3 Days Ago", None]
    got = [str(r[0]) for r in spark.createDataFrame([(v,) for v in values], "t string").select(T.to_date(F.col("t"))).collect()]
    assert got == ["2026-08-01"] * 3 + ["None"] * 3


def test_html_to_text(spark):
    got = spark.createDataFrame([("<p>A&amp;B &#233;&#8212;x</p><script>no()</script>c<br/>d",), (None,)], "h string").select(T.html_to_text(F.col("h"))).collect()
    assert [r[0] for r in got] == ["A&B é—x\n c\nd", ""]


def test_snapshot_without_previous_run_has_nothing_new(spark):
    fresh = spark.createDataFrame([("x", 5, "S")], "id string, score int, source_name string").withColumn("concerns", F.array().cast("array<string>"))
    empty = snapshot.read_previous(spark, "/nowhere/at/all", "2026-01-02", snapshot.T.StructType([*fresh.schema, *[snapshot.T.StructField("first_seen", snapshot.T.DateType()), snapshot.T.StructField("stale", snapshot.T.BooleanType()), snapshot.T.StructField("stale_since", snapshot.T.DateType())]]))
    row = snapshot.update_snapshot(fresh, empty, spark.createDataFrame([], "source_name string"), F.lit("2026-01-02").cast("date")).first()
    assert (row.is_new, str(row.first_seen)) == (False, "2026-01-02")


def test_filter_holds_back_undated(spark):
    rows = spark.createDataFrame([("a", 60, 3), ("b", 60, None), ("c", 60, 90)], "id string, score int, age_days int")
    f = board.RoleFilter(posted_within=30)
    assert [r.id for r in board.filter_roles(rows, f).collect()] == ["a"] and board.undated_held_back(rows, f).first().undated == 1


def test_endpoints(spark):
    raw = ['POST https://x/jobs body: {"q": 1}', "https://x/y body {}", "https://x/z", ""]
    got = [tuple(r[0]) for r in spark.createDataFrame([(x,) for x in raw], "e string").select(registry.parse_endpoint(F.col("e"))).collect()]
    assert got == [("POST", "https://x/jobs", '{"q": 1}'), ("POST", "https://x/y", "{}"), ("GET", "https://x/z", None), ("GET", "", None)]


def test_rss_and_sitemap(spark):
    bodies = ["<rss><item><title><![CDATA[A &amp; B]]></title><link>https://x/1</link></item></rss>", "<urlset><loc>https://x/jobs/remote-night-reader/</loc><loc>https://x/about</loc></urlset>"]
    rows = spark.createDataFrame([(f"s{i}", "https://x", "rss", 0, True, 200, None, b) for i, b in enumerate(bodies)], payloads.SCHEMA)
    assert sorted((r.title, r.url, r.location) for r in payloads.to_postings(rows).collect()) == [("A & B", "https://x/1", ""), ("Remote Night Reader", "https://x/jobs/remote-night-reader/", "Remote")]


def test_job_array_is_found_and_unwrapped():
    assert payloads.job_array({"facets": [{"x": 1}], "items": [{"requisitionList": [{"data": {"title": "t"}}]}]}) == [{"title": "t"}]


def test_other_feeds(spark):
    bodies = {
        "jobvite": '{"requisitions": [{"title": "T", "city": "A", "state": "OH", "detailUrl": "https://x/1"}]}',
        "jooble": '{"jobs": [{"title": "T", "company": "C", "location": "A", "link": "https://x/1"}, {"title": "again", "link": "https://x/1"}]}',
        "usajobs": '{"SearchResult": {"SearchResultItems": [{"MatchedObjectDescriptor": {"PositionURI": "https://x/1", "PositionTitle": "T", "OrganizationName": "C", "PositionLocation": [{"LocationName": "A"}]}}]}}',
        "jsearch": '{"data": {"jobs": [{"job_title": "T", "employer_name": "C", "job_is_remote": true, "job_location": "A", "job_apply_link": "https://x/1"}]}}',
        "adzuna": '{"results": [{"title": "T", "company": {"display_name": "C"}, "location": {"display_name": "A"}, "redirect_url": "https://x/1"}]}',
        "successfactors": '<a class="x jobTitle-link" href="/job/1">T</a><div>City</div>\\n<div>Doha</div>\\n<div>Country</div>\\n<div>Qatar</div>',
        "workday": '{"jobPostings": [{"title": "T", "externalPath": "/job/1", "locationsText": "A"}]}',
    }
    rows = spark.createDataFrame([(k, "https://w.example/wday/cxs/t/site/jobs", k, 0, True, 200, None, b.replace("\\n", "\n")) for k, b in bodies.items()], payloads.SCHEMA)
    got = {r.source_name: (r.title, r.org, r.location, r.url) for r in payloads.to_postings(rows).collect()}
    assert got == {
        "jobvite": ("T", "jobvite", "A, OH", "https://x/1"), "jooble": ("T", "C", "A", "https://x/1"), "usajobs": ("T", "C", "A", "https://x/1"), "jsearch": ("T", "C", "Remote", "https://x/1"), "adzuna": ("T", "C", "A", "https://x/1"),
        "successfactors": ("T", "successfactors", "Doha, Qatar", "https://w.example/job/1"), "workday": ("T", "workday", "A", "https://w.example/site/job/1"),
    }


def test_rules_go_by_ascii_words(spark):
    import re

    texts = ["a RN, b", "éRN x", "RNé", "x_RN", "RN", "ÉRN RN", "no", None, "PA-C here", "A PA-C"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.has(T.ascii_words(F.col("t")), [r"\bRN\b", r"\bPA-C\b"])).collect()]
    assert got == [bool(re.search(r"\b(?:RN|PA-C)\b", t or "", re.A | re.I)) for t in texts]


def test_decimal_references_keep_sixteen_bits(spark):
    assert spark.createDataFrame([("&#233;&#65601;&amp;#65;",)], "h string").select(T.html_to_text(F.col("h"))).first()[0] == "éAA"


def test_numbers_follow_the_order(spark):
    from pairwright.sources.geonames import numbered

    rows = numbered(spark.range(200).select((F.col("id") * 37 % 200).alias("x")).repartition(5), [F.desc("x")], "n").collect()
    assert {r.x: r.n for r in rows} == {x: 199 - x for x in range(200)}


def test_requests_per_term(spark):
    entries = [("J", "jooble", "https://j/api"), ("U", "usajobs", "https://u/search"), ("S", "jsearch", "https://s/search"), ("A", "adzuna", "https://a/jobs")]
    rows = spark.createDataFrame([(n, "https://x", "aggregator", (k, e, True), None, "gb" if n == "A" else "", "both", ["US"]) for n, k, e in entries], registry.SCHEMA)
    plan = registry.request_plan(rows).collect()
    assert {n: sum(r.source_name == n for r in plan) for n, *_ in entries} == {"J": 6, "U": 6, "S": 2, "A": 6}
    assert sorted(r.seq for r in plan if r.source_name == "U") == list(range(6))
    first = {r.source_name: (r.method, r.url, r.body) for r in plan if r.seq == 0}
    assert first["J"] == ("POST", "https://j/api", '{"keywords":"radiologist","location":"United States","page":"1"}')
    assert first["A"][1] == "https://a/jobs/gb/search/1?results_per_page=50&what_phrase=vascular%20surgeon&content-type=application/json"


def harvest(spark, names, failed=()):
    """Sources, and payloads with a job of either side in Cleveland from each source that didn't fail."""
    body = '{{"jobs": [{{"title": "Vascular Surgeon", "location": {{"name": "Cleveland, OH"}}, "content": "x", "absolute_url": "https://x/{0}/1", "updated_at": "2026-01-01"}}, {{"title": "Diagnostic Radiologist", "location": {{"name": "Akron, OH"}}, "content": "x", "absolute_url": "https://x/{0}/2", "updated_at": "2026-01-01"}}, {{"title": "Nurse", "absolute_url": "https://x/{0}/3"}}]}}'
    sources = spark.createDataFrame([(n, "https://x", "health-system", ("greenhouse", "https://x/feed", True), None, "", "both", ["US"], i) for i, n in enumerate(names)], registry.SCHEMA + ", ordinal int")
    landed = [(n, "https://x", "greenhouse", 0, n not in failed, 200, "http 503" if n in failed else None, body.format(n)) for n in names]
    return sources, spark.createDataFrame(landed, payloads.SCHEMA)


def test_runs_follow_each_other(spark, tmp_path):
    from pairwright.operators import run

    path = str(tmp_path / "board")
    sources, landed = harvest(spark, ["S1", "S2"])
    first = run.next_board(spark, path, sources, landed, places(spark), "2026-01-10", site_url="https://b")
    roles_ = first.roles.collect()
    assert sorted((r.source_name, r.specialty, r.is_new) for r in roles_) == [(s, x, False) for s in ("S1", "S2") for x in "ab"]
    report = first.run.first()
    assert (report.raw, report.irrelevant, report.roles, report.areas, report.together, report.sources_failed) == (6, 2, 4, 1, 1, 0) and report.pairs == 4
    sources, landed = harvest(spark, ["S1", "S2", "S3"], failed=("S2",))
    second = run.next_board(spark, path, sources, landed, places(spark), "2026-01-17", site_url="https://b")
    got = {(r.source_name, r.specialty): (r.is_new, r.stale, str(r.first_seen)) for r in second.roles.collect()}
    assert got[("S1", "a")] == (False, False, "2026-01-10") and got[("S2", "b")] == (False, True, "2026-01-10") and got[("S3", "a")] == (True, False, "2026-01-17")
    assert second.digest.count() == 2 and {r.source_name: r.status for r in second.coverage.collect()} == {"S1": "ok", "S2": "failed", "S3": "ok"}
    for name in second.tables():
        days = spark.read.parquet(f"{path}/{name}").select("run_date").distinct().count()
        assert days == (1 if name == "digest" else 2), name
    late = run.run_board(*harvest(spark, ["S1", "S2"], failed=("S2",)), snapshot.read_previous(spark, f"{path}/roles", "2026-02-20", run.CARRIED), places(spark), "2026-02-20")
    assert {r.source_name for r in late.roles.collect()} == {"S1"}  # stale for more than 14 days


def test_new_files_are_harvested_once(spark, tmp_path):
    from pairwright.streaming import jobs

    _, landed = harvest(spark, ["S1"])
    seen = []
    for day in (1, 2):
        landed.withColumn("source_name", F.lit(f"S{day}")).write.mode("append").json(str(tmp_path / "landing"))
        jobs.incremental_harvest(spark, str(tmp_path / "landing"), payloads.SCHEMA, str(tmp_path / "ck"), lambda df, _: seen.append(sorted(r.source_name for r in df.collect()))).awaitTermination()
    assert [x for x in seen if x] == [["S1"], ["S2"]]


BOARDS = {
    "root": ('[{"title": "T", "Id": 5, "applyUrl": "https://x/1", "city": "A", "state": "OH"}]', [("T", "A", "https://x/1")]),
    "wrapped": ('{"total": 1, "items": [{"facets": [{"x": 1}], "requisitionList": [{"data": {"jobTitle": "T", "externalPath": "/j/1", "location": {"no": 1}, "Locations": [{"LocalizedName": "A"}, {"LocalizedName": "B"}]}}]}]}', [("T", "A; B", "https://w.example/j/1")]),
    "facets first": ('{"facets": [{"name": ""}], "jobs": [{"name": " T ", "url": "https://x/1", "primaryLocation": 7}]}', [("T", "7", "https://x/1")]),
    "other way": ('{"jobs": [], "results": {"deep": [{"title": "T", "url": "https://x/1"}]}}', [("T", "", "https://x/1")]),
    "second element": ('{"items": [{"none": 1}, {"jobs": [{"title": "T", "url": "https://x/1"}]}]}', [("T", "", "https://x/1")]),
    "one id twice": ('{"jobs": [{"id": 1, "title": "T", "url": "https://x/1"}, {"id": 1, "title": "U", "url": "https://x/2"}, {"title": true, "url": "https://x/3"}, "odd", {"Id": "q", "PostingTitle": "V", "link": "/k"}]}', [("T", "", "https://x/1"), ("V", "", "https://w.example/k")]),
    "broken": ('{"jobs": [', []),
    "nothing": ('{"a": {"b": [1, 2, {"c": "title"}]}}', []),
    "empty": ("", []),
    "numbers": ("[1, 2]", []),
}


@pytest.mark.parametrize("searched", [False, True])
def test_boards_of_unknown_json(spark, searched, monkeypatch):
    """Found on the first way down or by the search; both give the same jobs."""
    if searched:
        monkeypatch.setattr(payloads, "_first_way", lambda body: F.lit(None).cast("array<map<string,variant>>"))
    rows = [(k, "https://w.example/site", "json", 0, True, 200, None, b) for k, (b, _) in BOARDS.items()] + [("failed", "https://w.example", "json", 0, False, 503, "http 503", None)]
    got = {}
    for r in payloads.to_postings(spark.createDataFrame(rows, payloads.SCHEMA)).collect():
        got.setdefault(r.source_name, []).append((r.title, r.location, r.url))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, (_, v) in BOARDS.items() if v}


def test_ultipro_links_and_job_counts(spark):
    body = '{"opportunities": [{"Title": "T", "Id": "abc"}, {"Title": "U", "Id": "def"}]}'
    page = '{"jobs": [{"title": "T", "absolute_url": "https://x/1"}]}'
    rows = [("U", "https://recruiting.ultipro.com/ORG1/JobBoardView/LoadSearchResults", "json", 0, True, 200, None, body), ("G", "https://g", "greenhouse", 0, True, 200, None, page), ("E", "https://e", "lever", 0, False, 503, "http 503", None)]
    landed = spark.createDataFrame(rows, payloads.SCHEMA)
    assert "https://recruiting.ultipro.com/ORG1/OpportunityDetail?opportunityId=abc" in {r.url for r in payloads.to_postings(landed).collect()}
    assert {(r.source_name, r.kind, r.jobs) for r in payloads.job_counts(landed).collect()} == {("U", "json", 2), ("G", "greenhouse", 1), ("E", "lever", 0)}


def test_only_jobs_with_keys_are_shuffled(spark):
    """Kinds without keys keep all their jobs and need no exchange; the first job of a key counts, in whichever request it came."""
    lever = '[{"text": "T", "hostedUrl": "https://x/1"}, {"text": "T", "hostedUrl": "https://x/1"}]'
    jooble = ['{"jobs": [{"title": "A", "link": "https://x/1"}, {"title": "B", "link": "https://x/1"}, {"title": "N"}]}', '{"jobs": [{"title": "C", "link": "https://x/1"}, {"title": "D", "link": "https://x/2"}]}']
    rows = [("L", "https://l", "lever", 0, True, 200, None, lever), *(("J", "https://j", "jooble", k, True, 200, None, b) for k, b in ((1, jooble[1]), (0, jooble[0])))]
    landed = spark.createDataFrame(rows, payloads.SCHEMA)
    found = payloads.to_postings(landed)
    assert sorted((r.source_name, r.title, r.request_seq, r.posting_ordinal) for r in found.collect()) == [("J", "A", 0, 0), ("J", "D", 1, 1), ("L", "T", 0, 0), ("L", "T", 0, 1)]
    alone = payloads.to_postings(landed, {"lever": payloads.lever, "rss": payloads.rss})
    assert alone.count() == 2 and "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("plan", ["feed_queries", "board_queries"])
def test_pages_are_dealt_among_tasks(spark, plan):
    """However few bytes the pages are, their bodies are made and taken apart in many tasks."""
    from pairwright.plans import board_queries, feed_queries

    made = feed_queries.feeds if plan == "feed_queries" else board_queries.landed
    assert made(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_rules_are_a_parameter(spark):
    from pairwright.operators import rules, score
    from pairwright.plans.other_rules import other_rules

    row = [("Radiology Technologist", "", "State University", "hybrid suite, no call, solo coverage", "", "x")]
    df = spark.createDataFrame(row, "title string, department string, org string, description string, location string, source_name string")
    default, other = classify.classify(df).first(), classify.classify(df, other_rules()).first()
    assert (default.specialty, default.is_attending) == ("b", False) or not default.is_attending
    assert (other.specialty, other.is_attending, other.setting) == ("a", True, "academic")
    found = classify.classify(df, other_rules()).withColumns({"country": F.lit("QA"), "precision": F.lit("city"), "date_posted": F.lit("2026-01-01").cast("date")})
    got = score.score_roles(found, F.lit("2026-01-02").cast("date"), rules=other_rules()).first()
    assert got.score_reasons[:2] == ["hybrid rooms", "academic setting"] and got.concerns[:2] == ["alone", "on call"]
    assert rules.default() is rules.default() and rules.default().side_a == classify.SIDE_A


def test_rules_as_columns(spark):
    from pairwright.functions.text import has
    from pairwright.operators.rules import guarded

    some = [(r"\bno call\b", 1.0, "x"), (r"\bcall\b", 1.0, "y"), (r"^q", 1.0, "z")]
    df = spark.createDataFrame([("a call",), ("no call",), ("q",), ("",), ("nothing",)], "t string")
    for r in df.select(*(g.alias(f"g{k}") for k, g in enumerate(guarded(F.col("t"), some))), *(has(F.col("t"), p).alias(f"h{k}") for k, (p, *_) in enumerate(some))).collect():
        assert (r.g0, r.g1, r.g2) == (r.h0, r.h1, r.h2)


def test_spans_without_all_pairs_are_those_of_all_pairs(spark, monkeypatch):

    monkeypatch.setattr(areas, "PAIRS", 30)
    rng = random.Random(4)
    rows = []
    for area in range(40):
        lat, lon, wide = rng.uniform(-70, 70), rng.uniform(-170, 170), rng.choice([0, 0.01, 1, 20, 170])
        for i in range(rng.choice([1, 2, 40, 150])):
            rows.append((f"x{area}", "a" if i % 3 else "b", max(-89.0, min(89.0, lat + rng.uniform(-1, 1) * wide / 4)), (lon + rng.uniform(-1, 1) * wide + 180) % 360 - 180))
    rows += rows[:20]
    want = {}
    for area in {r[0] for r in rows}:
        a, b = ([r[2:] for r in rows if r[:2] == (area, s)] for s in "ab")
        if a and b:
            want[area] = max(miles(x, y) for x in a for y in b)
    got = {r.area_id: r.span for r in areas.area_spans(spark.createDataFrame(rows, "area_id string, side string, lat double, lon double")).collect()}
    assert got == pytest.approx(want)


def test_span_of_a_full_area(spark):
    """100,000 coordinates of one area: 2.5 thousand million pairs, of which few are left to measure."""
    n = 50_000
    side = spark.range(2 * n).select(F.lit("x").alias("area_id"), F.when(F.col("id") < n, "a").otherwise("b").alias("side"), F.radians((F.col("id") * 7919 % 36000) / 100.0).alias("t"), F.sqrt((F.col("id") * 104729 % 100003) / 100003.0).alias("r"))
    df = side.select("area_id", "side", (40 + F.col("r") * F.sin("t") * 0.6).alias("lat"), (-80 + F.col("r") * F.cos("t") * 0.8).alias("lon"))
    got = areas.area_spans(df).first().span
    import numpy as np

    x = df.toPandas()
    rim = x[(((x.lat - 40) / 0.6) ** 2 + ((x.lon + 80) / 0.8) ** 2) > 0.9]  # the farthest pair is on the rim
    a, b = (np.radians(rim[rim.side == s][["lat", "lon"]].to_numpy()) for s in "ab")
    most = 0.0
    for p in a:
        h = np.sin((b[:, 0] - p[0]) / 2) ** 2 + np.cos(p[0]) * np.cos(b[:, 0]) * np.sin((b[:, 1] - p[1]) / 2) ** 2
        most = max(most, float(h.max()))
    assert got == pytest.approx(2 * 3958.7613 * math.asin(math.sqrt(most)))


def test_radii_from_one_join_are_those_of_each(spark):
    df = spark.createDataFrame(scatter(150, 3.0), SITE)
    got = {(r.radius, r.id): (r.miles, r.confidence, r.score) for r in pairs.pairs_by_radius(df, [15, 90, 45]).collect()}
    want = {(float(k), r.id): (r.miles, r.confidence, r.score) for k in (15, 45, 90) for r in pairs.onsite_pairs(df, k).collect()}
    assert got == want and len(got) > 100


def test_pairs_are_counted_and_picked_without_all_of_them(spark):
    """Totals, numbers and best pairs are those of all pairs, also where many roles are alike."""
    rng = random.Random(12)
    rows = []
    for i in range(400):
        country, org, precision = rng.choice(["US", "QA", "KW", None]), rng.choice(["Org 1 Inc", "Org 1", "Org 2", "", None]), rng.choice(["city", "city", "region", None])
        place = (None, None) if i % 40 == 0 else (rng.choice([29.0, 29.3, 30.1]), rng.choice([47.0, 47.5, 48.9]))
        rows.append((f"r{i}", "ab"[i % 2], org, rng.choice([None, -1, 0, 40, 41, 90]), *place, country, precision, "remote" if i % 7 == 1 else "onsite"))
    df = spark.createDataFrame(rows, "id string, side string, org string, score long, lat double, lon double, country string, precision string, work_model string")
    for radius in (15.0, 60.0):
        every = pairs.build_pairs(df, radius).cache()
        want = every.groupBy("remote_partner", "confidence").agg(F.count("*").alias("n"), F.sum("score").alias("total_score"), F.count_if("same_org").alias("n_same_org"))
        assert sorted(pairs.pair_totals(df, radius).collect()) == sorted(want.collect()) and want.count() == 4
        onsite = every.filter("NOT remote_partner")
        assert pairs.count_onsite_pairs(df, radius).first().pairs == onsite.count() > 1000
        best = pairs.best_pairs(onsite, 3).select("a_id", "b_id", "score", "rank")
        assert sorted(pairs.best_onsite_pairs(df, 3, radius).collect()) == sorted(best.collect())
        every.unpersist()
    assert pairs.pair_totals(df.limit(0)).collect() == [] and pairs.count_onsite_pairs(df.limit(0)).first().pairs == 0


def test_parts_of_the_order_and_blocks_give_the_same_areas(spark, monkeypatch):
    """Parts of 300 roles, cut within a score too, and roles in blocks; few places, ties of score, missing countries."""
    rng = random.Random(5)
    spots = [(40 + rng.randrange(500) / 100, -80 + rng.randrange(600) / 100) for _ in range(60)]
    rows = [(f"r{i}", "ab"[i % 2], "o", rng.randrange(40), *spots[rng.randrange(60)], rng.choice(["US", "QA", None]), "R", "C", 1, "region" if i % 4 == 0 else "city", "onsite", i) for i in range(3000)]
    rows = [(*r[:3], 40 if r[3] > 25 else r[3], *r[4:]) for r in rows]
    tile, want, centre = areas._Tile(45.0, 85.0), {}, {}
    for id_, score, lat, lon, country, precision, _ in sorted((tuple(r[k] for k in (0, 3, 4, 5, 6, 10, 12)) for r in rows), key=lambda r: (-r[1], r[6])):
        want[id_] = tile.choose(lat, lon, precision == "city", country) or id_
        centre[want[id_]] = tile.join(want[id_], lat, lon, country)
    monkeypatch.setattr(areas, "ONE", 300)
    looked, choose = [], areas._Tile.choose
    alone = areas._Tile(45.0, 85.0)
    monkeypatch.setattr(areas._Tile, "choose", lambda *a: looked.append(1) or choose(*a))
    order = sorted(rows, key=lambda r: (-r[3], r[12]))
    lat, lon, pinned = (np.array([f(r) for r in order]) for f in (lambda r: r[4], lambda r: r[5], lambda r: r[10] == "city"))
    codes = {None: 0}
    country = np.array([codes.setdefault(r[6], len(codes)) for r in order])
    found, sums, _ = areas._stretch(alone, areas.LEAST_BLOCK, [r[0] for r in order], lat, lon, pinned, [r[6] for r in order], country, codes, [None] * len(order))
    assert found == [want[r[0]] for r in order] and len(looked) < len(order) / 2
    assert {a: (s[1] / s[0], s[2] / s[0]) for a, s in zip(found, sums.tolist())} == centre
    got = areas.assign_areas(spark.createDataFrame(rows, SITE), 45.0).collect()
    assert {r.id: r.area_id for r in got} == want and all((r.area_lat, r.area_lon) == centre[r.area_id] for r in got)
    assert sorted((r.area_id, r.rank) for r in got) == sorted((a, k) for a in centre for k in range(list(want.values()).count(a)))


def test_pairs_of_classes_are_all_pairs(spark):
    """Many like roles are few classes, whose members make every pair again."""
    rows = [(f"{s}{k}", s, f"Org {k % 3}", k % 2 * 50 if k % 5 else None, 40.0 + k % 4 / 10, -80.0, "QA" if k % 2 else "US", "city" if k % 3 else "region", "remote" if s == "b" and k % 7 == 0 else "onsite") for s in "ab" for k in range(240)]
    df = spark.createDataFrame(rows, "id string, side string, org string, score long, lat double, lon double, country string, precision string, work_model string")
    for k in (None, 3):
        classes, members = pairs.pair_classes(df, 45.0, k)
        want = pairs.remote_pairs(df, k).unionByName(pairs.onsite_pairs(df, 45.0)).cache()
        got = pairs.members_paired(classes, members).cache()
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
        assert pairs.count_members_paired(classes, members).first().pairs == want.count() > 5 * classes.count()


def test_remote_pairs_are_dealt_among_tasks(spark):
    """One file of roles makes all pairs, in more than one task."""
    rows = [(f"{s}{k}", s, "Org", k, 40.0, -80.0, "US", "city", "remote" if s == "b" and k % 2 else "onsite") for s in "ab" for k in range(60)]
    df = spark.createDataFrame(rows, "id string, side string, org string, score long, lat double, lon double, country string, precision string, work_model string").coalesce(1)
    got = pairs.remote_pairs(df)
    assert sorted((r.a_id, r.b_id) for r in got.collect()) == sorted((f"a{i}", f"b{j}") for i in range(60) for j in range(1, 60, 2))
    assert all(r.id == f"{r.a_id}~{r.b_id}" for r in got.collect())
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_rules_are_tried_once_for_each_different_text(spark):
    from pairwright.functions.scratch import for_each_different

    df = spark.createDataFrame([(k, "x" if k % 3 else None, "y") for k in range(30)], "k long, a string, b string")
    given = []

    def find(rows):
        given.append(rows.count())
        return rows.selectExpr("*", "concat(coalesce(a, '-'), b) AS ab")

    got = for_each_different(df, ["a", "b"], find)
    assert given == [2] and sorted((r.k, r.a, r.ab) for r in got.collect()) == [(k, "x" if k % 3 else None, "xy" if k % 3 else "-y") for k in range(30)]


def test_scores_go_by_the_whole_text(spark):
    """What stands at a long text's end counts, and its length does."""
    from pairwright.plans.core_queries import oracle_sql

    texts = ["calm " * 400 + "Limb salvage at a Level I trauma center; nationally ranked, solo coverage.", "calm " * 400 + "x" * 74]
    rows = [(f"Vascular Surgeon {k}", "Acme", f"https://x/{k}", text, "Doha, Qatar", "onsite", "Source", "health-system", 0, k, "role", "a", False, False, False, "private", None) for k, text in enumerate(texts)]
    names = "title string, org string, url string, description string, location_text string, work_model string, source_name string, category string, source_ordinal int, posting_ordinal long, fate string, specialty string, is_interventional boolean, is_leadership boolean, is_locum boolean, setting string, date_posted date"
    scored = {r.posting_ordinal: r for r in roles.score_stated(spark.createDataFrame(rows, names), places(spark), F.lit("2001-08-01").cast("date")).collect()}
    assert [scored[k].description for k in (0, 1)] == texts and {r.subscores.signal for r in scored.values()} == {8}
    assert {"limb salvage / PAD volume", "Level I trauma centre"} <= set(scored[0].score_reasons) and "solo coverage" in scored[0].concerns
    assert scored[0].subscores.practice_quality > scored[1].subscores.practice_quality and "1500" not in oracle_sql()["merged_roles"]


def test_best_pairs_of_like_roles_come_from_classes(spark, monkeypatch):
    """Few places and scores: what is paired doesn't grow with the roles at them; ties, common employers and unknown ones."""
    rng = random.Random(3)
    rows = [(f"{'ab'[i % 2]}{i}", "ab"[i % 2], rng.choice(["Org 1", "Org 2 Inc", "", None]), rng.choice([40, 41, 90]), *rng.choice([(29.0, 47.0), (29.3, 47.5), (35.0, 47.0)]), rng.choice(["US", "KW"]), rng.choice(["city", "region"]), "onsite") for i in range(1200)]
    df = spark.createDataFrame(rows, "id string, side string, org string, score long, lat double, lon double, country string, precision string, work_model string")
    every = pairs.onsite_pairs(df, 60.0).cache()
    want = sorted(pairs.best_pairs(every, 3).select("a_id", "b_id", "score", "rank").collect())
    made, found = [], pairs._found
    monkeypatch.setattr(pairs, "_found", lambda *args, **kwargs: made.append(found(*args, **kwargs)) or made[-1])
    assert sorted(pairs.best_onsite_pairs(df, 3, 60.0).collect()) == want and len(want) == 1800
    assert sum(m.count() for m in made) < every.count() / 20
    every.unpersist()


def test_roles_go_through_remote_pairs_together(spark, monkeypatch):
    """Rows of at most TOGETHER roles of one score are paired, not single ones; unknown scores, ids in order within a row."""
    rows = [(f"{s}{k}", s, "Org", [None, -1, 70][k % 3], 40.0 if k % 10 else None, -80.0, "US", "city", "remote" if s == "b" and k % 2 else "onsite") for s in "ab" for k in range(900)]
    df = spark.createDataFrame(rows, "id string, side string, org string, score long, lat double, lon double, country string, precision string, work_model string")
    given, each = [], pairs._each
    monkeypatch.setattr(pairs, "_each", lambda found, *facts: given.append(found) or each(found, *facts))
    monkeypatch.setattr(pairs, "TOGETHER", 20)
    got = sorted((r.id, r.a_id, r.b_id, r.score) for r in pairs.remote_pairs(df).collect())
    assert got == sorted((f"a{i}~b{j}", f"a{i}", f"b{j}", 74 if i % 3 == j % 3 == 2 else 14) for i in range(900) if i % 10 for j in range(1, 900, 2))
    met = given[0].collect()
    assert len(met) < len(got) / 100 and all(len(r[f"{s}_roles"]) <= 20 and [x[f"{s}_id"] for x in r[f"{s}_roles"]] == sorted(x[f"{s}_id"] for x in r[f"{s}_roles"]) for r in met for s in "ab")


def test_roles_at_a_place_go_through_onsite_pairs_together(spark, monkeypatch):
    """Pairs are those that single roles make; places meet once for many of them, and labels are worked out there."""
    rng = random.Random(8)
    spots = [(29.0, 47.0), (29.3, 47.5), (31.0, 47.0), (None, 47.0)]
    rows = [(f"{'ab'[i % 2]}{i}", "ab"[i % 2], rng.choice(["Org 1", "Org 1 Inc", "", None]), rng.choice([None, -1, 40, 90]), *rng.choice(spots), rng.choice(["US", "KW", None]), rng.choice(["city", "region", None]), "onsite") for i in range(1000)]
    df = spark.createDataFrame(rows, "id string, side string, org string, score long, lat double, lon double, country string, precision string, work_model string")
    single = lambda radius: pairs._onsite(pairs._found(*pairs._sides(df), radius), F.lit(radius)).select(*pairs._COLUMNS)
    given, each = [], pairs._each
    monkeypatch.setattr(pairs, "_each", lambda found, *facts: given.append(found) or each(found, *facts))
    monkeypatch.setattr(pairs, "TOGETHER", 16)
    want = single(45.0).withColumn("apart", board.separation_label(F.col("miles"), F.col("drive_minutes")))
    got = pairs.onsite_pairs(df, 45.0, apart=board.separation_label(F.col("miles"), F.col("drive_minutes")))
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == (wanted := sorted(map(repr, want.collect())))
    assert given[0].count() < len(wanted) / 20 and given[0].agg(F.max(F.size("a_roles")), F.max(F.size("b_roles"))).first() == (16, 16)
    both = pairs.pairs_by_radius(df, [60, 15])
    assert sorted(map(repr, both.collect())) == sorted(repr(r) for k in (15.0, 60.0) for r in single(k).select(F.lit(k).alias("radius"), "*").collect())
    assert given[1].count() < len(wanted) / 10
