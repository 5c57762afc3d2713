"""Landed responses to postings, one shape per kind of feed, and what a source's responses amount to.

payloads: source_name, source_url, kind, request_seq, ok, status, error, body. Postings: title, org,
location, description, url, date_posted, department, source_name, request_seq, posting_ordinal.

A shape is an expression that makes an array of jobs out of a body; kinds whose jobs have keys are read in
one scan, the others in another. A board of unknown JSON is parsed once as a variant and followed down to its jobs; only where the first way
down doesn't lead to them does a search in Python go back and try others.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairwright.functions.ship import ship
from pairwright.functions.text import html_to_text

SCHEMA = "source_name string, source_url string, kind string, request_seq int, ok boolean, status int, error string, body string"
FIELDS = ("title", "org", "location", "description", "url", "date_posted", "department")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def contract(rows: DataFrame) -> DataFrame:
    """Postings with a title and a URL, with defaults for the rest."""
    blank = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FIELDS if c != "date_posted"}
    return rows.withColumns(blank).select(*FIELDS, "source_name", "request_seq", "posting_ordinal").filter("title <> '' AND url <> ''")


def _job(title: Column, org: Column, location: Column, description: Column | None, url: Column, date_posted: Column | None = None, department: Column | None = None, key: Column | None = None, plain: bool = False) -> Column:
    """One job as found; of several with one key in a source the first one counts. plain: title and description hold no markup."""
    given = {"title": title, "org": org, "location": location, "description": description, "url": url, "date_posted": date_posted, "department": department, "key": key}
    return F.struct(*((F.lit(None) if v is None else v).cast("string").alias(k) for k, v in given.items()), F.lit(plain).alias("plain"))


def _each(jobs: Column, job: Callable[[Column], Column]) -> Column:
    return F.transform(jobs, job)


def _parsed(schema: str, path: str | None = None) -> Column:
    found = F.from_json("body", schema)
    return found[path] if path else found


def _source() -> Column:
    return F.col("source_name")


def _some(*columns: Column) -> Column:
    """The first that isn't empty; each is computed once."""
    return F.get(F.filter(F.array(*columns), lambda c: c != ""), F.lit(0))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _listed(*columns: Column) -> Column:
    return F.concat_ws(", ", *(F.nullif(c, F.lit("")) for c in columns))


def greenhouse() -> Column:
    jobs = _parsed("jobs array<struct<title:string,location:struct<name:string>,content:string,absolute_url:string,updated_at:string,first_published:string,departments:array<struct<name:string>>>>", "jobs")
    return _each(jobs, lambda j: _job(j["title"], _source(), j["location"]["name"], j["content"], j["absolute_url"], F.coalesce(j["updated_at"], j["first_published"]), F.array_join(j["departments"]["name"], ", ")))


def lever() -> Column:
    jobs = _parsed("array<struct<text:string,categories:struct<location:string,team:string,department:string>,descriptionPlain:string,description:string,hostedUrl:string,applyUrl:string,createdAt:long>>")
    when = lambda j: F.date_format(F.timestamp_millis(F.nullif(j["createdAt"], F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return _each(jobs, lambda j: _job(j["text"], _source(), j["categories"]["location"], F.coalesce(j["descriptionPlain"], j["description"]), F.coalesce(j["hostedUrl"], j["applyUrl"]), when(j), F.coalesce(j["categories"]["team"], j["categories"]["department"])))


def ashby() -> Column:
    jobs = _parsed("jobs array<struct<title:string,location:string,descriptionHtml:string,descriptionPlain:string,jobUrl:string,applyUrl:string,publishedAt:string,department:string,team:string>>", "jobs")
    return _each(jobs, lambda j: _job(j["title"], _source(), j["location"], F.coalesce(j["descriptionHtml"], j["descriptionPlain"]), F.coalesce(j["jobUrl"], j["applyUrl"]), j["publishedAt"], F.coalesce(j["department"], j["team"])))


def smartrecruiters() -> Column:
    jobs = _parsed("content array<struct<id:string,name:string,location:struct<city:string,region:string,country:string>,jobAd:struct<sections:struct<jobDescription:struct<text:string>>>,applyUrl:string,company:struct<identifier:string>,releasedDate:string,department:struct<label:string>>>", "content")
    url = lambda j: F.coalesce(j["applyUrl"], F.concat(F.lit("https://jobs.smartrecruiters.com/"), F.coalesce(j["company"]["identifier"], F.lit("")), F.lit("/"), j["id"]))
    return _each(jobs, lambda j: _job(j["name"], _source(), _listed(*(j["location"][c] for c in ("city", "region", "country"))), j["jobAd"]["sections"]["jobDescription"]["text"], url(j), j["releasedDate"], j["department"]["label"]))


#: Names under which boards keep their lists and fields, in order of preference.
LISTS = ("jobs", "jobList", "requisitionList", "postings", "items", "results", "data", "content", "hits", "docs", "positions", "openings", "refineSearch")
TITLES = ("title", "name", "Title", "jobTitle", "PostingTitle")
ALIASES = {
    "title": TITLES,
    "org": ("companyName", "company", "organization"),
    "location": ("primaryLocation", "location", "locationsText", "full_location", "location_name", "city", "jobLocation", "PrimaryLocation"),
    "description": ("description", "jobDescription", "shortDescription", "summary", "externalDescriptionStr"),
    "url": ("applyUrl", "apply_url", "url", "jobUrl", "detailUrl", "canonicalUrl", "canonicalPositionUrl", "externalPath", "link"),
    "date_posted": ("postedDate", "posted_date", "postedOn", "PostedDate", "releasedDate", "createdDate", "create_date", "publishedDate"),
    "department": ("department", "category", "jobFamily", "businessUnit"),
}
DEEPEST = 6


def job_array(node, depth: int = 0) -> list | None:
    """The first list, named ones first, whose elements look like jobs; an element may be wrapped in `data`."""
    if depth > DEEPEST or not isinstance(node, (list, dict)):
        return None
    if isinstance(node, list):
        rows = [x["data"] if isinstance(x, dict) and isinstance(x.get("data"), dict) else x for x in node]
        if any(isinstance(x, dict) and any(x.get(t) for t in TITLES) for x in rows):
            return rows
        below = node
    else:
        below = [node[k] for k in LISTS if k in node] + list(node.values())
    for child in below:
        if (found := job_array(child, depth + 1)) is not None:
            return found
    return None


def _absolute(url: Column, base: Column) -> Column:
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    return F.when(url.startswith("http"), url).otherwise(F.concat(origin, url))


_VALUES = "map<string,variant>"


def _unwrapped(element: Column) -> Column:
    """The values of an array's element by name, those of its `data` if that has names; null for plain values."""
    return F.coalesce(F.try_variant_get(element, "$.data", _VALUES), F.try_variant_get(element, "$", _VALUES))


def _jobs_in(node: Column) -> Column:
    """The elements of an array that looks like jobs; null for anything else."""
    rows = F.transform(F.try_variant_get(node, "$", "array<variant>"), _unwrapped)
    named = lambda m: F.exists(F.array(*(F.try_element_at(m, F.lit(t)).cast("string") for t in TITLES)), lambda t: t.isNotNull() & ~t.isin("", "false", "0"))
    return _let(rows, lambda found: F.when(F.exists(found, lambda m: F.coalesce(named(m), F.lit(False))), found))


def _down(node: Column) -> Column:
    """A step on the first way down: the first element of an array, or the first list by name."""
    return F.coalesce(F.try_variant_get(node, "$[0]", "variant"), *(F.try_variant_get(node, f"$.{k}", "variant") for k in LISTS))


def _first_way(body: Column) -> Column:
    """The jobs of a JSON body at the end of the first way down, null if they aren't there. Every node is looked at once."""
    state = lambda node: F.struct(node.alias("node"), _jobs_in(node).alias("jobs"))
    step = lambda at, _: F.when(at["jobs"].isNotNull() | at["node"].isNull(), at).otherwise(F.element_at(F.transform(F.array(_down(at["node"])), state), 1))
    start = F.element_at(F.transform(F.array(F.try_parse_json(body)), state), 1)
    return F.aggregate(F.sequence(F.lit(1), F.lit(DEEPEST)), start, step, lambda at: at["jobs"])


def _texts(values: Column) -> Column:
    """Texts and numbers among a job's values, trimmed."""
    scalar = lambda v: F.when(F.schema_of_variant(v).rlike("^(STRING|BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.trim(v.cast("string")))
    return F.transform_values(F.map_filter(values, lambda k, v: k.isin(*_NAMES)), lambda _, v: scalar(v))


def _board_job(values: Column, t: Column) -> Column:
    """A job by the first that it has of every alias; t: its _texts."""
    first = lambda names: _some(*(F.try_element_at(t, F.lit(n)) for n in names))
    got = {c: first(n) for c, n in ALIASES.items()}
    several = F.array_join(F.array_compact(F.try_element_at(values, F.lit("Locations")).try_cast("array<struct<LocalizedName:string>>")["LocalizedName"]), "; ")
    place = F.coalesce(got["location"], _some(several), _some(F.concat_ws(", ", *(first(n) for n in (("city",), ("state", "region"), ("country",))))))
    number = _some(F.try_element_at(t, F.lit("Id")))
    detail = F.when(number.isNotNull() & F.col("source_url").contains("ultipro.com"), F.concat(F.regexp_replace("source_url", "/JobBoardView/.*$", ""), F.lit("/OpportunityDetail?opportunityId="), number))
    url = F.coalesce(got["url"], detail, F.lit(""))
    return _job(got["title"], F.coalesce(got["org"], _source()), place, got["description"], url, got["date_posted"], got["department"], F.coalesce(first(KEYS), url))


#: What tells a job of unknown JSON from another one, in order of preference; its URL where there is none of them.
KEYS = ("Id", "id", "requisitionId", "slug", "title", "Title")
_NAMES = sorted({n for names in ALIASES.values() for n in names} | {"state", "region", "country", *KEYS})


def _searched(bodies: pd.Series) -> pd.Series:
    """The jobs of JSON bodies, wherever they are, each as JSON."""

    def search(body: str | None) -> list[str] | None:
        try:
            rows = job_array(json.loads(body)) if body else None
        except (ValueError, RecursionError):
            return None
        return rows and [json.dumps(j) for j in rows]

    return bodies.map(search)


def with_board_jobs(payloads: DataFrame, kinds: list[str]) -> DataFrame:
    """payloads with `board`, the values of the jobs of each board in JSON; only bodies without jobs on the first way down are searched in Python."""
    ship(payloads.sparkSession)
    own = F.col("ok") & F.col("kind").isin(*kinds)
    rows = payloads.withColumn("board", F.when(own, _first_way(F.col("body"))))
    rows = rows.withColumn("searched", F.pandas_udf(_searched, "array<string>")(F.when(own & F.col("board").isNull(), F.col("body"))))
    found = F.transform("searched", lambda j: F.try_variant_get(F.try_parse_json(j), "$", _VALUES))
    return rows.withColumn("board", F.coalesce("board", found)).drop("searched")


def json_board() -> Column:
    """Any board in JSON (see with_board_jobs); a job that several requests return counts once."""
    both = F.transform("board", lambda m: F.struct(m.alias("values"), _texts(m).alias("texts")))
    return F.transform(both, lambda b: F.when(b["values"].isNotNull(), _board_job(b["values"], b["texts"])))


def workday() -> Column:
    jobs = _parsed("jobPostings array<struct<title:string,externalPath:string,locationsText:string,bulletFields:array<string>,postedOn:string>>", "jobPostings")
    site = F.regexp_replace("source_url", r"/wday/cxs/[^/]+/([^/]+)/jobs.*$", "/$1")
    url = lambda j: F.when(j["externalPath"].startswith("http"), j["externalPath"]).otherwise(F.concat(site, F.coalesce(j["externalPath"], F.lit(""))))
    return _each(jobs, lambda j: _job(j["title"], _source(), F.coalesce(j["locationsText"], F.get(j["bulletFields"], F.lit(0))), None, url(j), j["postedOn"], key=url(j)))


def _tag(chunk: Column, low: Column, tag: str) -> Column:
    """What a tag holds, without CDATA marks; only searched for where the chunk (low: in lower case) names it."""
    text = F.regexp_extract(chunk, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
    bare = lambda t: F.when(t.contains("<![CDATA[") | t.contains("]]>"), F.regexp_replace(F.regexp_replace(t, r"^\s*<!\[CDATA\[", ""), r"\]\]>\s*$", "")).otherwise(t)
    return F.when(low.contains(f"<{tag}"), F.trim(_let(text, bare))).otherwise("")


def rss() -> Column:
    """Items of RSS and entries of Atom feeds; of a sitemap, its job pages, titled by their slugs."""
    items = F.regexp_extract_all("body", F.lit(r"(?is)<(?:item|entry)\b.*?</(?:item|entry)>"), F.lit(0))

    def item(c: Column) -> Column:
        tag = lambda *tags: _some(*(_tag(c["text"], c["low"], t) for t in tags))
        href = F.regexp_extract(c["text"], r'(?i)<link[^>]*href="([^"]+)"', 1)
        return _job(tag("title"), _source(), tag("location", "job:location"), tag("description", "summary", "content"), F.coalesce(tag("link"), _some(href)), tag("pubDate", "published", "updated"), tag("category"))

    def page(u: Column) -> Column:
        slug = F.element_at(F.split(F.regexp_replace(u, "/$", ""), "/"), -1)
        title = F.array_join(F.transform(F.split(slug, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")
        return _job(title, _source(), F.when(F.lower(slug).contains("remote"), "Remote"), None, u, plain=True)

    pages = F.filter(F.transform(F.regexp_extract_all("body", F.lit("<loc>([^<]+)</loc>"), F.lit(1)), lambda u: F.trim(u)), lambda u: u.rlike("(?i)job"))
    each = lambda found: F.transform(F.transform(found, lambda c: F.struct(c.alias("text"), F.lower(c).alias("low"))), item)
    return _let(items, lambda found: F.when(F.size(found) > 0, each(found)).when(F.col("body").rlike(r"(?i)<urlset\b"), F.transform(pages, page)))


def jobvite() -> Column:
    element = "array<struct<title:string,location:string,city:string,state:string,jobDescription:string,applyUrl:string,detailUrl:string,postedDate:string,department:string,category:string>>"
    both = _parsed(f"requisitions {element}, jobs {element}")
    return _each(F.coalesce(both["requisitions"], both["jobs"]), lambda j: _job(j["title"], _source(), F.coalesce(j["location"], _listed(j["city"], j["state"])), j["jobDescription"], F.coalesce(j["applyUrl"], j["detailUrl"]), j["postedDate"], F.coalesce(j["department"], j["category"])))


def successfactors() -> Column:
    """Result pages in HTML: every hit begins with its title's link, followed by labelled fields."""
    hits = F.split("body", r'(?i)<a[^>]*class="[^"]*jobTitle-link')

    def hit(c: Column) -> Column:
        chunk, text = c["chunk"], c["text"]
        # only searched for where the text names the label; an ASCII word's edge before a letter
        field = lambda label: F.when(c["low"].contains(label.lower()), _some(F.trim(F.regexp_extract(text, rf"(?i)(?<![A-Za-z0-9_]){label}\s*\n+\s*([^\n]{{2,60}})", 1))))
        place = F.coalesce(_some(F.concat_ws(", ", field("City"), field("Country"))), field("Location"))
        job = lambda url: _job(c["title"], F.coalesce(field("Facility"), _source()), place, F.substring(text, 1, 800), url, key=url, plain=True)
        return _let(_let(_some(F.regexp_extract(chunk, 'href="([^"]+)"', 1)), lambda href: _absolute(href, F.col("source_url"))), job)

    text = lambda c: F.struct(c.alias("chunk"), html_to_text(F.substring(c, 1, 4000)).alias("text"), _let(F.regexp_extract(c, r"(?s)>(.{1,200}?)</a>", 1), html_to_text).alias("title"))
    with_low = lambda t: F.struct(t["chunk"].alias("chunk"), t["text"].alias("text"), t["title"].alias("title"), F.lower(t["text"]).alias("low"))
    # what comes before the first title is no hit, but keeps its place
    texts = F.transform(F.transform(hits, lambda c, i: F.when(i > 0, text(c))), lambda t: F.when(t.isNotNull(), with_low(t)))
    return F.transform(texts, lambda t: F.when(t.isNotNull(), hit(t)))


def jooble() -> Column:
    jobs = _parsed("jobs array<struct<title:string,company:string,location:string,snippet:string,link:string,updated:string>>", "jobs")
    return _each(jobs, lambda j: _job(j["title"], j["company"], j["location"], j["snippet"], j["link"], j["updated"], key=j["link"]))


def usajobs() -> Column:
    """The employer is the agency, not the site."""
    item = "struct<PositionURI:string,PositionTitle:string,OrganizationName:string,DepartmentName:string,PositionLocation:array<struct<LocationName:string>>,PositionLocationDisplay:string,UserArea:struct<Details:struct<JobSummary:string>>,QualificationSummary:string,PublicationStartDate:string>"
    found = _parsed(f"SearchResult struct<SearchResultItems:array<struct<MatchedObjectDescriptor:{item}>>>", "SearchResult")["SearchResultItems"]
    place = lambda j: F.coalesce(F.get(j["PositionLocation"], F.lit(0))["LocationName"], j["PositionLocationDisplay"])
    job = lambda j: _job(j["PositionTitle"], F.coalesce(j["OrganizationName"], j["DepartmentName"]), place(j), F.coalesce(j["UserArea"]["Details"]["JobSummary"], j["QualificationSummary"]), j["PositionURI"], j["PublicationStartDate"], j["DepartmentName"], j["PositionURI"])
    return _each(found, lambda i: job(i["MatchedObjectDescriptor"]))


def jsearch() -> Column:
    """The list is `data` or `data.jobs`; a remote flag outranks the location."""
    kind = "array<struct<job_title:string,employer_name:string,job_is_remote:boolean,job_location:string,job_city:string,job_state:string,job_description:string,job_apply_link:string,job_google_link:string,job_posted_at_datetime_utc:string>>"
    data = F.get_json_object("body", "$.data")
    jobs = F.when(data.startswith("["), F.from_json(data, kind)).otherwise(F.from_json(F.get_json_object("body", "$.data.jobs"), kind))
    place = lambda j: F.when(j["job_is_remote"], "Remote").otherwise(F.coalesce(j["job_location"], _listed(j["job_city"], j["job_state"])))
    url = lambda j: F.coalesce(j["job_apply_link"], j["job_google_link"])
    return _each(jobs, lambda j: _job(j["job_title"], j["employer_name"], place(j), j["job_description"], url(j), j["job_posted_at_datetime_utc"], key=url(j)))


def adzuna() -> Column:
    """Pages aren't deduplicated; what came before a failing page stays."""
    jobs = _parsed("results array<struct<title:string,company:struct<display_name:string>,location:struct<display_name:string>,description:string,redirect_url:string,created:string,category:struct<label:string>>>", "results")
    return _each(jobs, lambda j: _job(j["title"], j["company"]["display_name"], j["location"]["display_name"], j["description"], j["redirect_url"], j["created"], j["category"]["label"]))


Shape = Callable[[], Column]
SHAPES: dict[str, Shape] = {"greenhouse": greenhouse, "lever": lever, "ashby": ashby, "smartrecruiters": smartrecruiters, "json": json_board, "workday": workday, "jobvite": jobvite, "successfactors": successfactors, "jooble": jooble, "usajobs": usajobs, "jsearch": jsearch, "adzuna": adzuna, "rss": rss, "icims-rss": rss, "taleo-rss": rss}
#: Kinds whose titles are markup too.
_MARKED = ("rss", "icims-rss", "taleo-rss")


def _exploded(payloads: DataFrame, shapes: dict[str, Shape]) -> DataFrame:
    """One row `j` per job of every response that came."""
    jobs = None
    for shape in dict.fromkeys(shapes.values()):
        kinds = F.col("kind").isin(*[k for k, x in shapes.items() if x is shape])
        jobs = F.when(kinds, shape()) if jobs is None else jobs.when(kinds, shape())
    return payloads.filter("ok").select(_source(), "source_url", "kind", "request_seq", F.posexplode(jobs).alias("posting_ordinal", "j"))


#: Shapes that tell no keys, so that all of their jobs count.
_KEYLESS = (greenhouse, lever, ashby, smartrecruiters, jobvite, rss, adzuna)


def _first_of_each_key(rows: DataFrame) -> DataFrame:
    """The first row of each source and key, by request and place; without a key every row is its own. Rows are sorted by a hash before the texts."""
    key = F.coalesce("key", F.concat(F.lit("\0"), F.col("request_seq").cast("string"), F.lit(":"), F.col("posting_ordinal").cast("string")))
    w = W.partitionBy("_hash", "source_name", "_key").orderBy("request_seq", "posting_ordinal")
    rows = rows.withColumn("_key", key).withColumn("_hash", F.xxhash64("source_name", "_key"))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_key", "_hash")


def to_postings(payloads: DataFrame, shapes: dict[str, Shape] = SHAPES) -> DataFrame:
    """Postings of all payloads whose kind has a shape. Each body is taken apart once; only jobs that may have a key are shuffled."""
    boards = [k for k, x in shapes.items() if x is json_board]
    text = lambda c, marked: F.when(marked, html_to_text(F.col(c))).otherwise(F.col(c))
    found = None
    for keyed in (False, True):
        own = {k: x for k, x in shapes.items() if (x not in _KEYLESS) is keyed}
        if not own:
            continue
        mine = payloads.filter(F.col("kind").isin(*own))
        rows = _exploded(with_board_jobs(mine, boards) if keyed and boards else mine, own)
        rows = rows.filter("j IS NOT NULL").select(_source(), "source_url", "kind", "request_seq", "posting_ordinal", "j.*")
        if keyed:
            if boards:
                rows = rows.withColumn("url", F.when(F.col("kind").isin(*boards), _absolute(F.col("url"), F.col("source_url"))).otherwise(F.col("url")))
            rows = _first_of_each_key(rows)
        rows = contract(rows.withColumns({"description": text("description", ~F.col("plain")), "title": text("title", ~F.col("plain") & F.col("kind").isin(*_MARKED))}))
        found = rows if found is None else found.unionByName(rows)
    return found


def source_status(sources: DataFrame, payloads: DataFrame, provided: list[str], adapters: dict[str, Shape] = SHAPES) -> DataFrame:
    """source_name, skipped and error: a source with one good response is fine, one without credentials skipped."""
    from pairwright.sources.registry import is_active, missing_credentials

    got = payloads.groupBy("source_name").agg(F.bool_or("ok").alias("any_ok"), F.first("error", ignorenulls=True).alias("first_error"))
    df = sources.select(F.col("name").alias("source_name"), "*").join(got, "source_name", "left")
    skipped = F.when(~is_active(), "no endpoint").otherwise(missing_credentials(provided))
    unknown = F.when(~F.col("machine_readable.kind").isin(*adapters), F.concat(F.lit("unknown kind "), F.col("machine_readable.kind")))
    error = F.coalesce(unknown, F.when(~F.coalesce("any_ok", F.lit(False)), F.coalesce("first_error", F.lit("no response"))))
    return df.select("source_name", is_active().alias("is_active"), skipped.alias("skipped"), F.when(skipped.isNull(), error).alias("error"))


# ---- feeds behind crawled pages ---------------------------------------------------------------------------


def detect_feed(html: Column, url: Column) -> Column:
    """struct of kind and endpoint of the applicant system that a careers page links to; the first one wins."""
    get = lambda p, k: F.nullif(F.regexp_extract(html, p, k), F.lit(""))
    day = r"(?i)https?://([a-z0-9-]+)\.(wd\d+)\.myworkdayjobs\.com/([A-Za-z0-9_-]+)"
    sf = r"(?i)https?://(careers\.[a-z0-9.-]+)/([A-Za-z0-9_-]+)/(?:search|job)/"
    oracle = r"(?i)https?://([a-z0-9-]+\.fa\.[a-z0-9]+\.oraclecloud\.com)"
    origin = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    found = [
        ("workday", F.concat(F.lit("https://"), get(day, 1), F.lit("."), get(day, 2), F.lit(".myworkdayjobs.com/wday/cxs/"), get(day, 1), F.lit("/"), get(day, 3), F.lit("/jobs"))),
        ("json", F.concat(F.lit("https://"), get(oracle, 1), F.lit("/hcmRestApi/resources/latest/recruitingCEJobRequisitions?onlyData=true&expand=requisitionList&finder=findReqs;siteNumber="), F.coalesce(get(r"(CX_\d+)", 1), F.lit("CX_1")), F.lit(",limit=200"))),
        ("greenhouse", F.concat(F.lit("https://boards-api.greenhouse.io/v1/boards/"), get(r"(?i)(?:boards|job-boards)\.greenhouse\.io/(?:embed/job_board\?for=)?([a-z0-9_-]+)", 1), F.lit("/jobs?content=true"))),
        ("lever", F.concat(F.lit("https://api.lever.co/v0/postings/"), get(r"(?i)jobs\.lever\.co/([a-z0-9_-]+)", 1), F.lit("?mode=json"))),
        ("json", F.when(html.rlike(r"(?i)phenom|widget/jobs|/api/jobs"), F.concat(origin, F.lit("/api/jobs?keywords=radiologist&limit=50&page=1&sortBy=relevance")))),
        ("successfactors", F.concat(F.lit("https://"), get(sf, 1), F.lit("/"), get(sf, 2), F.lit("/search/"))),
        ("icims-rss", F.concat(F.lit("https://"), get(r"(?i)https?://([a-z0-9-]+)\.icims\.com", 1), F.lit(".icims.com/jobs/search/rss?searchKeyword=radiologist"))),
    ]
    return F.coalesce(*(F.when(e.isNotNull(), F.struct(F.lit(k).alias("kind"), e.alias("endpoint"))) for k, e in found))


def job_counts(payloads: DataFrame) -> DataFrame:
    """source_name, kind and jobs: how many postings each source's responses of any kind hold."""
    kinds = payloads.groupBy("source_name").agg(F.max("kind").alias("kind"))
    found = to_postings(payloads).groupBy("source_name").agg(F.count("*").alias("jobs"))
    return kinds.join(found, "source_name", "left").select("source_name", "kind", F.coalesce("jobs", F.lit(0)).alias("jobs"))
