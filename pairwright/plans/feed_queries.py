"""Orders as the feeds of every kind that has a shape of its own, and what the adapters make of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairwright.functions.scratch import materialize, scratch
from pairwright.operators.run import read_table
from pairwright.plans.fixtures import dealt, postings, table
from pairwright.plans.gazetteer import places
from pairwright.sources import payloads as P
from pairwright.streaming.jobs import harvest_runs

#: Items of one response.
PAGE = 100
KINDS = ("lever", "ashby", "smartrecruiters", "workday", "jobvite", "successfactors", "jooble", "usajobs", "jsearch", "adzuna", "sitemap", "atom")


def _s(**fields: Column | str) -> Column:
    return F.struct(*((F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()))


def _item(kind: str, r: Column) -> Column:
    """One order in the shape of a feed."""
    title, url, day = F.concat(F.lit("Radiologist "), r["k"]), F.concat(F.lit(f"https://{kind}.example/"), r["k"]), r["day"]
    return {
        "lever": lambda: _s(text=title, categories=_s(location="Akron, OH", team="Imaging"), descriptionPlain="calm", hostedUrl=url, createdAt=r["ms"]),
        "ashby": lambda: _s(title=title, location="Akron, OH", descriptionHtml="<p>calm</p>", jobUrl=url, publishedAt=day, team="Imaging"),
        "smartrecruiters": lambda: _s(id=r["k"], name=title, location=_s(city="Akron", region="OH", country="us"), jobAd=_s(sections=_s(jobDescription=_s(text="calm"))), company=_s(identifier="acme"), releasedDate=day, department=_s(label="Imaging")),
        "workday": lambda: _s(title=title, externalPath=F.concat(F.lit("/job/"), r["k"]), locationsText="Akron, OH", postedOn=day),
        "jobvite": lambda: _s(title=title, city="Akron", state="OH", jobDescription="calm", detailUrl=url, postedDate=day, category="Imaging"),
        "successfactors": lambda: F.concat(F.lit('<a class="jobTitle-link" href="/job/'), r["k"], F.lit('">'), title, F.lit("</a><div>City</div>\n<div>Doha</div>\n<div>Country</div>\n<div>Qatar</div>\n")),
        "jooble": lambda: _s(title=title, company="Acme", location="Akron, OH", snippet="calm", link=url, updated=day),
        "usajobs": lambda: _s(MatchedObjectDescriptor=_s(PositionURI=url, PositionTitle=title, OrganizationName="Acme", DepartmentName="Imaging", PositionLocationDisplay="Akron, OH", QualificationSummary="calm", PublicationStartDate=day)),
        "jsearch": lambda: _s(job_title=title, employer_name="Acme", job_is_remote=F.lit(False), job_city="Akron", job_state="OH", job_description="calm", job_apply_link=url, job_posted_at_datetime_utc=day),
        "adzuna": lambda: _s(title=title, company=_s(display_name="Acme"), location=_s(display_name="Akron, OH"), description="calm", redirect_url=url, created=day, category=_s(label="Imaging")),
        "sitemap": lambda: F.concat(F.lit("<url><loc>https://sitemap.example/jobs/radiologist-"), r["k"], F.lit("/</loc></url>")),
        "atom": lambda: F.concat(F.lit("<entry><title>"), title, F.lit('</title><link href="'), url, F.lit('"/><summary>calm</summary><updated>'), day, F.lit("</updated></entry>")),
    }[kind]()


def _body(kind: str) -> Column:
    items = F.transform("rows", lambda r: _item(kind, r))
    shape = {
        "lever": lambda: F.to_json(items), "ashby": lambda: F.to_json(_s(jobs=items)), "smartrecruiters": lambda: F.to_json(_s(content=items)), "workday": lambda: F.to_json(_s(jobPostings=items)), "jobvite": lambda: F.to_json(_s(requisitions=items)),
        "jooble": lambda: F.to_json(_s(jobs=items)), "usajobs": lambda: F.to_json(_s(SearchResult=_s(SearchResultItems=items))), "jsearch": lambda: F.to_json(_s(data=_s(jobs=items))), "adzuna": lambda: F.to_json(_s(results=items)),
        "successfactors": lambda: F.array_join(items, ""), "sitemap": lambda: F.concat(F.lit("<urlset>"), F.array_join(items, ""), F.lit("</urlset>")), "atom": lambda: F.concat(F.lit("<feed>"), F.array_join(items, ""), F.lit("</feed>")),
    }
    return shape[kind]()


def feeds(spark, sf_dir) -> DataFrame:
    """payloads: every order in one response of every kind, PAGE to a page, in buckets by customer."""
    orders = table(spark, sf_dir, "orders").withColumn("b", F.col("o_custkey") % 50)
    row = F.struct(F.col("o_orderkey").cast("string").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) * 1000).alias("ms"))
    paged = orders.withColumn("page", F.floor((F.row_number().over(W.partitionBy("b").orderBy("o_orderkey")) - 1) / PAGE).cast("int"))
    pages = dealt(paged.groupBy("b", "page").agg(F.collect_list(row).alias("rows")), "b", "page")
    each = pages.select("b", "page", "rows", F.explode(F.array(*map(F.lit, KINDS))).alias("name"))
    body = F.lit(None).cast("string")
    for k in reversed(KINDS):
        body = F.when(F.col("name") == k, _body(k)).otherwise(body)
    kind, url = F.when(F.col("name").isin("sitemap", "atom"), "rss").otherwise(F.col("name")), F.concat(F.lit("https://"), F.col("name"), F.lit(".example/wday/cxs/t/site/jobs"))
    return each.select(F.concat_ws(" ", "name", F.col("b").cast("string")).alias("source_name"), url.alias("source_url"), kind.alias("kind"), F.col("page").alias("request_seq"), F.lit(True).alias("ok"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("error"), body.alias("body"))


def feed_items(spark, sf_dir) -> DataFrame:
    found = P.to_postings(feeds(spark, sf_dir)).withColumn("feed", F.substring_index("source_name", " ", 1))
    own = F.when(F.col("org") == F.col("source_name"), "source").otherwise(F.col("org"))
    # sets of the few different values: with these Spark aggregates by hash, with texts' ends alone it would sort all rows
    return found.groupBy("feed").agg(
        F.count("*").alias("n"), F.min("title").alias("first_title"), F.max("title").alias("last_title"), F.min("url").alias("first_url"), F.max("url").alias("last_url"), F.array_min(F.collect_set(own)).alias("org"), F.array_min(F.collect_set("location")).alias("place"),
        F.max(F.substring("description", -4, 4)).alias("description"), F.min("date_posted").alias("first_date"), F.max("date_posted").alias("last_date"), F.max("department").alias("department"),
    )


#: The days of two harvests; the second one misses a fifth of the jobs and one source.
HARVESTS = ("2001-07-20", "2001-08-01")


def landed(spark, sf_dir, harvest: int) -> DataFrame:
    """payloads: the fixture's postings as an aggregator's pages, PAGE to a page, by source."""
    rows = postings(spark, sf_dir).filter(F.floor(F.col("posting_ordinal") / 5) % 5 != (4 if harvest else 0))
    job = _s(title=F.col("title"), company=F.col("org"), location=F.col("location"), snippet=F.col("description"), link=F.col("url"), updated=F.col("date_posted"), k=F.col("posting_ordinal"))
    paged = rows.select("source_name", job.alias("j"), F.floor((F.row_number().over(W.partitionBy("source_name").orderBy("posting_ordinal")) - 1) / PAGE).cast("int").alias("request_seq"))
    pages = paged.groupBy("source_name", "request_seq").agg(F.to_json(_s(jobs=F.sort_array(F.collect_list(F.struct(F.col("j.k").alias("k"), F.col("j").alias("j")))).getField("j"))).alias("body"))
    ok = F.lit(True) if not harvest else F.col("source_name") != "Source 3"
    return pages.select("source_name", F.lit("https://jobs.example/").alias("source_url"), F.lit("jooble").alias("kind"), "request_seq", ok.alias("ok"), F.when(ok, 200).otherwise(503).alias("status"), F.when(~ok, "http 503").alias("error"), F.when(ok, F.col("body")).alias("body"))


def board_runs(spark, sf_dir) -> DataFrame:
    """Two harvests landed one after the other, each run once by the stream; the counters of both runs."""
    names = postings(spark, sf_dir).groupBy("source_name").agg(F.first("category").alias("category"), F.first("source_ordinal").alias("ordinal"))
    place = F.struct(F.lit("jooble").alias("kind"), F.lit("https://jobs.example/").alias("endpoint"), F.lit(True).alias("confirmed"))
    none = F.array().cast("array<string>")
    sources = materialize(names.select(F.col("source_name").alias("name"), F.lit("https://jobs.example/").alias("url"), "category", place.alias("machine_readable"), none.alias("requires_env"), F.lit("").alias("query"), F.lit("both").alias("specialty"), F.array(F.lit("US")).alias("geos"), "ordinal"))
    landing, checkpoint, path = (scratch(spark) for _ in range(3))
    for k in range(len(HARVESTS)):
        landed(spark, sf_dir, k).write.mode("append").json(landing)
        harvest_runs(spark, landing, checkpoint, path, sources, places(spark), HARVESTS.__getitem__, remote_partners=3).awaitTermination()
    counters = ("raw", "irrelevant", "expired", "unlocated", "duplicates", "roles", "a_roles", "b_roles", "new_roles", "carried", "sources", "sources_failed")
    return read_table(spark, path, "run").select("batch", F.col("today").cast("string").alias("today"), *counters)


def board_runs_sql() -> str:
    """Every run's roles by themselves, then what the second one adds and carries."""
    from pairwright.operators.roles import SOURCE_RANKS
    from pairwright.plans.core_sql import quoted
    from pairwright.plans.fixtures import TODAY
    from pairwright.plans.role_sql import _roles

    rank = "CASE category " + " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in SOURCE_RANKS.items()) + " ELSE 0 END"

    def run(k: int) -> str:
        which = "o_orderkey // 5 % 5 <> 4 AND o_orderkey % 5 <> 3" if k else "o_orderkey // 5 % 5 <> 0"
        found = _roles().replace("FROM orders)", f"FROM orders WHERE {which})").replace(f"DATE '{TODAY}'", f"DATE '{HARVESTS[k]}'")
        return f"""r{k} AS MATERIALIZED (WITH {found}, m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {rank} DESC, score DESC, source_ordinal, posting_ordinal) AS nth FROM named)
  SELECT (SELECT count(*) FROM stated) AS raw, (SELECT count(*) FROM stated WHERE fate = 'irrelevant') AS irrelevant, (SELECT count(*) FROM stated WHERE fate = 'expired') AS expired, (SELECT count(*) FROM named WHERE prec = 'none') AS unlocated,
    (SELECT count(*) - count(DISTINCT id) FROM named) AS duplicates, list({{id: id, side: specialty, source: source_name}}) AS roles FROM m WHERE nth = 1),
i{k} AS MATERIALIZED (SELECT unnest(roles, recursive := true) FROM r{k})"""

    both = "old AS (SELECT * FROM i0 WHERE source = 'Source 3' AND id NOT IN (SELECT id FROM i1)), board AS (SELECT * FROM i1 UNION ALL SELECT * FROM old)"
    shown = "raw, irrelevant, expired, unlocated, duplicates"
    return f"""WITH {run(0)}, {run(1)}, {both}
SELECT 0::BIGINT AS batch, '{HARVESTS[0]}' AS today, {shown}, (SELECT count(*) FROM i0) AS roles, (SELECT count(*) FROM i0 WHERE side = 'a') AS a_roles, (SELECT count(*) FROM i0 WHERE side = 'b') AS b_roles, 0::BIGINT AS new_roles, 0::BIGINT AS carried,
  (SELECT count(DISTINCT o_orderkey % 5) FROM orders) AS sources, 0::BIGINT AS sources_failed FROM r0
UNION ALL SELECT 1, '{HARVESTS[1]}', {shown}, (SELECT count(*) FROM board), (SELECT count(*) FROM board WHERE side = 'a'), (SELECT count(*) FROM board WHERE side = 'b'), (SELECT count(*) FROM board WHERE id NOT IN (SELECT id FROM i0)), (SELECT count(*) FROM old),
  (SELECT count(DISTINCT o_orderkey % 5) FROM orders), (SELECT count(DISTINCT o_orderkey % 5) FROM orders WHERE o_orderkey % 5 = 3) FROM r1"""


def oracle() -> str:
    """What each kind gives: (feed, url before the key, org, place, description, dates as they are or in full, department)."""
    rows = [
        ("lever", "https://lever.example/", "source", "Akron, OH", "calm", "full", "Imaging"), ("ashby", "https://ashby.example/", "source", "Akron, OH", "calm", "day", "Imaging"),
        ("smartrecruiters", "https://jobs.smartrecruiters.com/acme/", "source", "Akron, OH, us", "calm", "day", "Imaging"), ("workday", "https://workday.example/site/job/", "source", "Akron, OH", "", "day", ""),
        ("jobvite", "https://jobvite.example/", "source", "Akron, OH", "calm", "day", "Imaging"), ("successfactors", "https://successfactors.example/job/", "source", "Doha, Qatar", "atar", "none", ""),
        ("jooble", "https://jooble.example/", "Acme", "Akron, OH", "calm", "day", ""), ("usajobs", "https://usajobs.example/", "Acme", "Akron, OH", "calm", "day", "Imaging"), ("jsearch", "https://jsearch.example/", "Acme", "Akron, OH", "calm", "day", ""),
        ("adzuna", "https://adzuna.example/", "Acme", "Akron, OH", "calm", "day", "Imaging"), ("sitemap", "https://sitemap.example/jobs/radiologist-", "source", "", "", "none", ""), ("atom", "https://atom.example/", "source", "", "calm", "day", ""),
    ]
    values = ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)
    date = "CASE dates WHEN 'day' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 'full' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END"
    tail = "CASE feed WHEN 'sitemap' THEN '/' ELSE '' END"
    return f"""WITH f(feed, base, org, place, description, dates, department) AS (VALUES {values})
SELECT feed, count(*) AS n, min('Radiologist ' || o_orderkey) AS first_title, max('Radiologist ' || o_orderkey) AS last_title, min(base || o_orderkey || {tail}) AS first_url, max(base || o_orderkey || {tail}) AS last_url,
  any_value(org) AS org, any_value(place) AS place, any_value(description) AS description, min({date}) AS first_date, max({date}) AS last_date, any_value(department) AS department FROM f, orders GROUP BY feed"""
