"""The registry of sources: validation, which ones are active, and the requests that each one takes."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, url string, category string, machine_readable struct<kind:string,endpoint:string,confirmed:boolean>, requires_env array<string>, query string, specialty string, geos array<string>"
REQUIRED = ("name", "url", "category", "specialty", "geos")
KINDS = ("none", "greenhouse", "lever", "ashby", "smartrecruiters", "json", "workday", "jobvite", "successfactors", "jooble", "usajobs", "jsearch", "rss", "icims-rss", "taleo-rss", "adzuna")
#: What every keyword-driven feed is asked for, and pages per term where a kind has pages.
TERMS = ("radiologist", "vascular surgeon")
ADZUNA_TERMS = ("vascular surgeon", "diagnostic radiologist")
PAGES = {"workday": 5, "successfactors": 4, "jooble": 3, "usajobs": 3, "adzuna": 3}


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)


def problems() -> Column:
    """What is wrong with an entry; empty if nothing is."""
    mr = F.col("machine_readable")
    missing = [F.when(F.col(c).isNull() if c == "geos" else F.coalesce(c, F.lit("")) == "", f"missing {c}") for c in REQUIRED]
    unknown = F.when(mr.isNotNull() & ~F.coalesce(mr["kind"], F.lit("")).isin(*KINDS), F.concat(F.lit("unknown kind "), F.coalesce(mr["kind"], F.lit(""))))
    bare = F.when(mr.isNotNull() & (F.coalesce(mr["kind"], F.lit("")) != "none") & (F.coalesce(mr["endpoint"], F.lit("")) == ""), F.concat(F.lit("no endpoint for "), F.coalesce(mr["kind"], F.lit(""))))
    return F.array_compact(F.array(*missing, unknown, bare))


def validate(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid entries with their defaults, and the others with their problems."""
    checked = entries.withColumn("problems", problems())
    none = F.struct(F.lit("none").alias("kind"), F.lit("").alias("endpoint"), F.lit(False).alias("confirmed"))
    good = checked.filter(F.size("problems") == 0).drop("problems")
    good = good.withColumns({"requires_env": F.coalesce("requires_env", F.array().cast("array<string>")), "machine_readable": F.coalesce("machine_readable", none)})
    return good, checked.filter(F.size("problems") > 0)


def is_active() -> Column:
    mr = F.col("machine_readable")
    return (F.coalesce(mr["endpoint"], F.lit("")) != "") & (mr["kind"] != "none")


def active(sources: DataFrame, limit: int | None = None) -> DataFrame:
    """Machine-readable sources; with a limit, confirmed feeds first."""
    found = sources.filter(is_active())
    return found if limit is None else found.orderBy(F.desc("machine_readable.confirmed"), "name").limit(limit)


def missing_credentials(provided: list[str]) -> Column:
    """Why a source is skipped, or null."""
    lacking = F.array_except("requires_env", F.array(*map(F.lit, provided)).cast("array<string>"))
    return F.when(F.size(lacking) > 0, F.concat(F.lit("needs "), F.array_join(lacking, " + ")))


def parse_endpoint(raw: Column) -> Column:
    """struct of method, url and body: "POST url body {...}", a URL with a body, or a bare URL."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    full = r"(?is)^(GET|POST)\s+(\S+)\s*(?:body\s*:?\s*(.+))?$"
    bare = r"(?is)^(\S+)\s+body\s*:?\s*(.+)$"
    get = lambda p, k: F.nullif(F.trim(F.regexp_extract(text, p, k)), F.lit(""))
    has_verb, has_body = text.rlike(full), text.rlike(bare)
    return F.struct(
        F.when(has_verb, F.upper(get(full, 1))).when(has_body, "POST").otherwise("GET").alias("method"),
        F.when(has_verb, get(full, 2)).when(has_body, get(bare, 1)).otherwise(text).alias("url"),
        F.when(has_verb, get(full, 3)).when(has_body, get(bare, 2)).alias("body"),
    )


_FINDER = r"(?i)finder=findReqs;([^&]*)"


def _encoded(term: str) -> str:
    return quote(term, safe="")


def _keyword_requests(kind: Column, url: Column) -> Column:
    """Of the kinds that are asked per term, an array of (url, body) templates with {page}; null for others."""
    pair = lambda u, b=None: F.struct(u.alias("url"), (F.lit(b) if b else F.lit(None).cast("string")).alias("body"))
    country = F.when(F.coalesce("query", F.lit("")).contains("gb"), "gb").otherwise("us")
    joined = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    by_kind = {
        "jooble": [pair(url, f'{{"keywords":"{t}","location":"United States","page":"{{page}}"}}') for t in TERMS],
        "usajobs": [pair(joined(url, f"?Keyword={_encoded(t)}&ResultsPerPage=100&Page={{page}}")) for t in TERMS],
        "jsearch": [pair(joined(url, f"?query={_encoded(t + ' in USA')}&num_pages=1&country=us&date_posted=all")) for t in TERMS],
        "adzuna": [pair(joined(url, "/", country, f"/search/{{page}}?results_per_page=50&what_phrase={_encoded(t)}&content-type=application/json")) for t in ADZUNA_TERMS],
    }
    out = F.lit(None).cast("array<struct<url:string,body:string>>")
    for name, requests in by_kind.items():
        out = F.when(kind == name, F.array(*requests)).otherwise(out)
    return out


def request_plan(sources: DataFrame) -> DataFrame:
    """source_name, kind, seq (order within the source), method, url, body and page of every request of the active sources.

    Keyword fields of POST bodies, and finder URLs that aren't scoped yet, are swept over all terms, the
    finder also without one; kinds with pages get them for each body. Search services get a request for each
    term and page; their credentials are the fetcher's to add.
    """
    df = sources.filter(is_active()).select(F.col("name").alias("source_name"), "query", F.col("machine_readable.kind").alias("kind"), parse_endpoint(F.col("machine_readable.endpoint")).alias("e")).select("source_name", "query", "kind", "e.*")
    field = F.regexp_extract(F.coalesce("body", F.lit("")), r'"(keywords|searchText|q|query|keyword)"\s*:', 1)
    swept = F.transform(F.array(*map(F.lit, TERMS)), lambda t: F.regexp_replace("body", r'("(?:keywords|searchText|q|query|keyword)"\s*:\s*)"[^"]*"', F.concat(F.lit('$1"'), t, F.lit('"'))))
    bodies = F.when(field != "", swept).otherwise(F.array("body"))
    oracle = F.col("url").rlike(r"(?i)hcmRestApi/resources/.*recruitingCEJobRequisitions") & ~F.col("url").rlike(r"(?i)[;,]keyword=") & F.col("url").rlike(_FINDER)
    scoped = F.transform(F.array(*map(F.lit, TERMS)), lambda t: F.regexp_replace("url", _FINDER, F.concat(F.lit("finder=findReqs;$1,keyword="), F.replace(F.url_encode(t), F.lit("+"), F.lit("%20")))))
    urls = F.when(oracle, F.concat(F.array("url"), scoped)).otherwise(F.array("url"))
    plain = F.flatten(F.transform(urls, lambda u: F.transform(bodies, lambda b: F.struct(u.alias("url"), b.alias("body")))))
    requests = F.coalesce(_keyword_requests(F.col("kind"), F.col("url")), plain)
    pages = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in PAGES.items() for x in kv)), F.col("kind")), F.lit(1))
    method = F.when(F.col("kind") == "jooble", "POST").otherwise(F.col("method"))
    df = df.select("source_name", "kind", method.alias("method"), pages.alias("pages"), F.posexplode(requests).alias("at", "r")).withColumn("page", F.explode(F.sequence(F.lit(1), F.col("pages"))))
    paged = lambda c: F.replace(F.col(f"r.{c}"), F.lit("{page}"), F.col("page").cast("string"))
    return df.select("source_name", "kind", (F.col("at") * F.col("pages") + F.col("page") - 1).alias("seq"), "method", paged("url").alias("url"), paged("body").alias("body"), "page")
