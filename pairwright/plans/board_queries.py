"""Queries over snapshots, the board, marks, digests, sources and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pairwright.functions.scratch import materialize, scratch
from pairwright.operators import board, digest, pairs, snapshot
from pairwright.operators.pairs import located
from pairwright.plans.core_queries import _today, fixed_areas, query
from pairwright.plans.fixtures import dealt, sites, table
from pairwright.sources import payloads as P
from pairwright.sources import registry as R
from pairwright.streaming import jobs

#: Items of one response, as feeds page them.
PAGE = 100
SITE = "https://board.example/"
FILTER = board.RoleFilter(specialty="b", min_score=55, posted_within=200, search="radiolog")


def simple_roles(spark, sf_dir):
    """Orders as finished roles, for queries about what comes after scoring."""
    k = F.col("o_orderkey")
    age = F.when(k % 9 != 0, F.datediff(_today(), F.col("o_orderdate").cast("date")))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("role/"), k.cast("string"), F.lit(" (x)")).alias("id"), F.concat(F.lit("Title "), (k % 40).cast("string")).alias("title"), F.concat(F.lit("Org "), (k % 37).cast("string")).alias("org"),
        F.when(k % 3 == 0, "a").otherwise("b").alias("specialty"), (k * 31 % 101).alias("score"), age.alias("age_days"), F.when(k % 2 == 0, "radiology team").otherwise("clinic").alias("description"),
        F.when(k % 4 == 0, "remote").otherwise("onsite").alias("work_model"), F.when(k % 5 == 0, "private").otherwise("academic").alias("setting"), F.when(k % 6 == 0, "QA").otherwise("US").alias("country"), F.lit("OH").alias("region"),
        F.when(k % 7 != 0, F.concat(F.lit("City "), (k % 11).cast("string"))).alias("city"), F.lit("somewhere").alias("location_text"), F.concat(F.lit("https://jobs.example/"), k.cast("string")).alias("url"),
        F.concat(F.lit("Source "), (k % 5).cast("string")).alias("source_name"), F.array(F.lit("c")).alias("concerns"), k.alias("k"),
    )


def runs(spark, sf_dir):
    """Previous and current roles, and the failed source."""
    rows = simple_roles(spark, sf_dir)
    seen = F.when(F.col("k") % 8 == 1, F.lit("2001-07-01")).otherwise(F.lit("2001-07-25")).cast("date")
    stale = F.col("k") % 10 == 1
    previous = rows.filter("k % 4 <> 0").withColumns({"first_seen": F.when(F.col("k") % 6 != 3, seen), "run_date": F.lit("2001-07-25").cast("date"), "stale": stale, "stale_since": F.when(stale, F.when(F.col("k") % 20 == 1, F.lit("2001-07-10")).otherwise(F.lit("2001-07-25"))).cast("date")})
    failed = table(spark, sf_dir, "orders").select(F.concat(F.lit("Source "), (F.col("o_orderkey") % 5).cast("string")).alias("source_name")).distinct().filter("source_name = 'Source 3'")
    return previous, rows.filter("k % 4 <> 1"), failed


def updated(spark, sf_dir):
    previous, fresh, failed = runs(spark, sf_dir)
    return snapshot.update_snapshot(fresh, previous, failed, _today())


@query
def new_roles(spark, sf_dir):
    return updated(spark, sf_dir).filter("is_new").select("id", "score")


@query
def first_seen(spark, sf_dir):
    return updated(spark, sf_dir).groupBy(F.col("first_seen").cast("string").alias("first_seen"), "is_new").agg(F.count("*").alias("n"))


@query
def carry_forward(spark, sf_dir):
    previous, fresh, failed = runs(spark, sf_dir)
    return snapshot.carry_forward(fresh, previous, failed, _today()).select("id", F.col("stale_since").cast("string").alias("stale_since"), F.array_join("concerns", "|").alias("concerns"))


@query
def board_filter(spark, sf_dir):
    return board.filter_roles(simple_roles(spark, sf_dir), FILTER).select("id", "score", F.col("age_days").cast("long").alias("age_days"))


@query
def undated_held(spark, sf_dir):
    return board.undated_held_back(simple_roles(spark, sf_dir), FILTER)


@query
def sort_newest(spark, sf_dir):
    return board.ranked(simple_roles(spark, sf_dir), "newest", 50).select(F.col("rank").cast("long").alias("rank"), "id")


@query
def sort_oldest(spark, sf_dir):
    return board.ranked(simple_roles(spark, sf_dir), "oldest", 50).select(F.col("rank").cast("long").alias("rank"), "id")


@query
def search_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.lower("text").contains("license")).select("doc_id", "lang")


def marks_log(spark, sf_dir):
    """Events as a log of marks."""
    k = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, (*board.STATUSES, "lost"))), (k % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("board-"), (F.col("user_id") % 10).cast("string")).alias("board_id"), F.concat(F.lit("role/"), (F.col("user_id") * 7 % 500).cast("string"), F.lit(" (x)")).alias("role_id"), (k % 3 == 0).alias("pinned"),
        status.alias("status"), F.when(k % 5 != 0, F.col("event_type")).alias("note"), F.when(k % 11 == 0, F.repeat(F.lit("x"), 81)).otherwise("me").alias("by"), F.col("ts").alias("updated_at"), k.alias("seq"),
    )


@query
def marks_latest(spark, sf_dir):
    return board.latest_marks(marks_log(spark, sf_dir)).select("board_id", "role_id", "pinned", "status", "note", "seq")


@query
def marks_merged(spark, sf_dir):
    """The log in two parts, merged into the table one after the other, and the first one once more."""
    from pairwright.operators.marks import merge_marks, read_marks

    log, path = marks_log(spark, sf_dir), scratch(spark)
    for part in (F.col("seq") % 3 > 0, F.col("seq") % 3 == 0, F.col("seq") % 3 > 0):
        merge_marks(spark, path, log.filter(part))
    return read_marks(spark, path).select("board_id", "role_id", "pinned", "status", "note", "seq")


@query
def marks_invalid(spark, sf_dir):
    return marks_log(spark, sf_dir).withColumn("error", board.mark_error()).filter("error IS NOT NULL").groupBy("error").agg(F.count("*").alias("n"))


@query
def role_marks(spark, sf_dir):
    marks = board.board_marks(marks_log(spark, sf_dir), "board-3")
    return board.with_marks(simple_roles(spark, sf_dir), marks).select("id", "pinned", "status", "note")


@query
def pinned(spark, sf_dir):
    marks = board.board_marks(marks_log(spark, sf_dir), "board-3")
    return board.pinned_roles(simple_roles(spark, sf_dir), marks).select("id", "score")


def square_areas(spark, sf_dir):
    from pairwright.operators.areas import summarize_areas

    rows = sites(spark, sf_dir)
    return rows, summarize_areas(rows, fixed_areas(rows))


@query
def area_members_topk(spark, sf_dir):
    _, found = square_areas(spark, sf_dir)
    return board.top_members(found, 2).select("area_id", "side", F.col("rank").cast("long").alias("rank"), "id", F.col("more").cast("long").alias("more"))


@query
def areas_filtered(spark, sf_dir):
    rows, found = square_areas(spark, sf_dir)
    out = board.filtered_areas(found, located(rows).filter("score >= 50"), 1)
    return out.select("area_id", F.col("a_count").cast("long").alias("a_count"), F.col("b_count").cast("long").alias("b_count"), "is_together", "remote_unlocked", "missing_side")


@query
def unread_batches(spark, sf_dir):
    fresh = board.unread_since(updated(spark, sf_dir), "2001-07-10")
    return board.batches(fresh).select(F.col("first_seen").cast("string").alias("first_seen"), "n", F.array_join(F.slice("ids", 1, 5), "|").alias("best"))


@query
def digest_entries(spark, sf_dir):
    found = digest.digest_entries(updated(spark, sf_dir), SITE)
    return found.select("specialty", F.col("rank").cast("long").alias("rank"), "id", "org", "location", "score", "board_url")


@query
def digest_counts(spark, sf_dir):
    return digest.digest_counts(updated(spark, sf_dir))


REGISTRY_KINDS = ("greenhouse", "json", "workday", "rss", "none", "carrier-pigeon", "jooble", "usajobs", "jsearch", "adzuna")


def registry(spark, sf_dir):
    """Suppliers as entries of a registry, some of them broken."""
    k = F.col("s_suppkey")
    kind = F.element_at(F.array(*map(F.lit, REGISTRY_KINDS)), (k % 10 + 1).cast("int"))
    endpoint = F.when(k % 10 == 2, F.concat(F.lit("POST https://w"), k.cast("string"), F.lit('.example/jobs body: {"limit": 20, "searchText": "nurse"}'))).when(k % 12 != 0, F.concat(F.lit("https://e"), k.cast("string"), F.lit(".example/feed")))
    mr = F.when(k % 7 != 0, F.struct(kind.alias("kind"), endpoint.alias("endpoint"), (k % 2 == 0).alias("confirmed")))
    return table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.concat(F.lit("https://s"), k.cast("string")).alias("url"), F.when(k % 13 != 0, "aggregator").alias("category"), mr.alias("machine_readable"), F.lit(None).cast("array<string>").alias("requires_env"), F.lit("").alias("query"), F.lit("both").alias("specialty"), F.array(F.lit("US")).alias("geos"))


@query
def registry_valid(spark, sf_dir):
    good, bad = R.validate(registry(spark, sf_dir))
    a = good.select("name", F.col("machine_readable.kind").alias("kind"), R.is_active().alias("active"), F.lit("").alias("problems"))
    return a.unionByName(bad.select("name", F.col("machine_readable.kind").alias("kind"), F.lit(False).alias("active"), F.array_join("problems", "; ").alias("problems")))


@query
def request_plan(spark, sf_dir):
    good, _ = R.validate(registry(spark, sf_dir))
    shape = F.regexp_replace("url", "^https://[ew][0-9]+", "https://host")
    return R.request_plan(good).groupBy("kind", "seq", "method", shape.alias("url"), "page", "body").agg(F.count("*").alias("n"))


@query
def detect_feed(spark, sf_dir):
    k = F.col("page_id")
    links = [
        "https://acme.wd5.myworkdayjobs.com/Careers", "https://abc.fa.us2.oraclecloud.com/CX_7", "https://boards.greenhouse.io/acme", "https://jobs.lever.co/acme", "/api/jobs", "https://careers.acme.org/hosp/search/", "https://acme.icims.com", "none",
    ]
    link = F.element_at(F.array(*map(F.lit, links)), (k % 8 + 1).cast("int"))
    found = table(spark, sf_dir, "pages").withColumn("f", P.detect_feed(F.concat("html", link), F.col("url")))
    return found.select("page_id", "f.kind", "f.endpoint")


def landed(spark, sf_dir):
    """Orders as landed payloads, PAGE to a page: a greenhouse board per customer bucket, a nested board and a feed."""
    k = F.col("o_orderkey")
    job = F.struct(F.concat(F.lit("Radiologist "), k.cast("string")).alias("title"), F.struct(F.lit("Doha").alias("name")).alias("location"), F.lit("<p>Great &amp; calm</p>").alias("content"), F.concat(F.lit("https://g.example/"), k.cast("string")).alias("absolute_url"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"))
    flat = F.struct(F.concat(F.lit("Surgeon "), k.cast("string")).alias("jobTitle"), F.concat(F.lit("/j/"), (k % 700).cast("string")).alias("externalPath"), F.lit("Akron, OH").alias("city"))
    orders = table(spark, sf_dir, "orders").withColumn("b", (F.col("o_custkey") % 50))
    orders = orders.withColumn("page", F.floor((F.row_number().over(Window.partitionBy("b").orderBy("o_orderkey")) - 1) / PAGE).cast("int"))
    wide = dealt(orders.groupBy("b", "page").agg(F.sort_array(F.collect_list(F.struct(k, job.alias("j"), flat.alias("f")))).alias("rows")), "b", "page")
    base = [F.lit(True).alias("ok"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("error")]
    name = lambda s: F.concat(F.lit(s), F.col("b").cast("string"))
    green = wide.select(name("G").alias("source_name"), F.lit("https://g.example").alias("source_url"), F.lit("greenhouse").alias("kind"), F.col("page").alias("request_seq"), *base, F.to_json(F.struct(F.transform("rows", lambda r: r["j"]).alias("jobs"))).alias("body"))
    nested = wide.select(name("J").alias("source_name"), F.lit("https://j.example/x").alias("source_url"), F.lit("json").alias("kind"), F.col("page").alias("request_seq"), *base, F.to_json(F.struct(F.lit(3).alias("total"), F.array(F.struct(F.transform("rows", lambda r: F.struct(r["f"].alias("data"))).alias("requisitionList"))).alias("items"))).alias("body"))
    items = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("<item><title><![CDATA["), r["j"]["title"], F.lit("]]></title><link>"), r["j"]["absolute_url"], F.lit("</link><pubDate>Mon, 06 Aug 2001 10:00:00 GMT</pubDate></item>"))), "")
    feed = wide.select(name("R").alias("source_name"), F.lit("https://r.example").alias("source_url"), F.lit("rss").alias("kind"), F.col("page").alias("request_seq"), *base, F.concat(F.lit("<rss><channel>"), items, F.lit("</channel></rss>")).alias("body"))
    return green.unionByName(nested).unionByName(feed)


@query
def payload_jobs(spark, sf_dir):
    found = P.to_postings(landed(spark, sf_dir))
    return found.groupBy("source_name").agg(F.count("*").alias("n"), F.min("title").alias("first_title"), F.max("url").alias("last_url"), F.array_min(F.collect_set("location")).alias("place"), F.min("description").alias("description"))


@query
def source_coverage(spark, sf_dir):
    k = F.col("s_suppkey")
    sources = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("source_name"), (k % 5 != 0).alias("is_active"), F.when(k % 7 == 1, "needs KEY").alias("skipped"), F.when(k % 4 == 2, "503").alias("error"))
    found = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("source_name")), "l_suppkey")
    return snapshot.source_coverage(sources.select("source_name"), found, sources)


@query
def run_counts(spark, sf_dir):
    rows, found = square_areas(spark, sf_dir)
    roles_ = updated(spark, sf_dir)
    funnel = roles_.agg(F.count("*").alias("raw"))
    sources = source_coverage(spark, sf_dir)
    return snapshot.run_counts(roles_, funnel, pairs.count_onsite_pairs(rows), found, sources)


@query
def display_columns(spark, sf_dir):
    rows = simple_roles(spark, sf_dir)
    return rows.select("id", digest.location_label().alias("location"), board.posted_label(F.col("age_days")).alias("posted"))


@query
def role_cards(spark, sf_dir):
    """What a role's card shows; every fourth role has no city, and some of those no known country."""
    from pairwright.functions.text import excerpt

    rows = simple_roles(spark, sf_dir)
    k = F.col("k")
    city, country = F.when(k % 4 != 0, F.col("city")), F.when(k % 5 == 4, "FR").otherwise(F.col("country"))
    precision = F.when(city.isNotNull(), "city").when(k % 16 == 0, "remote").when(k % 8 == 0, "region").otherwise("country")
    region = F.when(precision != "country", F.col("region"))
    day = F.when(k % 10 != 3, F.date_add(_today(), (k % 400).cast("int")).cast("string")).otherwise("soon")
    return rows.select(
        "id", board.place_label(precision, city, region, country, F.when(k % 3 == 0, F.col("location_text"))).alias("place"), board.setting_label(F.col("setting")).alias("setting"), board.work_model_label(F.col("work_model")).alias("work_model"),
        board.run_label(day).alias("run_day"), excerpt(F.col("description"), 10).alias("lede"),
    )


def _events_stream(spark, sf_dir):
    name = "events.parquet"
    schema = table(spark, sf_dir, "events").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", name).option("recursiveFileLookup", "true").parquet(sf_dir)
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


@query
def stream_dedup(spark, sf_dir):
    found = jobs.first_arrivals(_events_stream(spark, sf_dir), "user_id", "ts", "3650 days")
    return jobs.run_to_table(found.select("user_id"), "dedup", scratch(spark)).groupBy("user_id").agg(F.count("*").alias("n"))


@query
def stream_first_seen(spark, sf_dir):
    found = jobs.first_seen(_events_stream(spark, sf_dir), "user_id", "ts")
    return jobs.run_to_table(found, "seen", scratch(spark), "complete")


@query
def role_lifecycle(spark, sf_dir):
    """Events as sightings of a fifth as many roles, three of five kinds as failures of their sources."""
    from pairwright.streaming import lifecycle

    roles_ = max(1, table(spark, sf_dir, "events").count() // 5)
    rows = _events_stream(spark, sf_dir).select((F.col("event_id") % roles_).cast("string").alias("id"), F.col("ts").alias("at"), (~F.col("event_type").isin("view", "signup")).alias("failed"))
    return lifecycle.run_changes(rows, scratch(spark)).select("id", "change", F.unix_micros("at").alias("at"), F.unix_micros("first_seen").alias("first_seen"), F.unix_micros("stale_since").alias("stale_since"))


@query
def gazetteer_places(spark, sf_dir):
    """Parts as lines of a gazetteer."""
    from pairwright.sources import geonames as G

    k = F.col("p_partkey")
    country = F.element_at(F.array(*map(F.lit, ("US", "QA", "FR", "AE"))), (k % 4 + 1).cast("int"))
    cities = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.when(k % 5 != 0, F.concat(F.lit("Town "), k.cast("string"))).alias("ascii"), F.concat_ws(",", F.lit("Alt é"), F.concat(F.lit("Alt "), k.cast("string")), F.lit("")).alias("alternates"), (k % 90 / 3.0).alias("lat"), (k % 170 / 7.0).alias("lon"), country.alias("country"), (k % 10).cast("string").alias("admin1"), (k * 37 % 5000).alias("population"))
    admin1 = table(spark, sf_dir, "nation").select(F.concat(F.lit("QA."), F.col("n_nationkey").cast("string")).alias("code"), F.col("n_name").alias("label"))
    found = G.build_places(cities, admin1)
    return found.select("n", "r", "c", "lat", "lon", "p", F.array_join("aliases", "|").alias("aliases"))


@query
def country_centroids(spark, sf_dir):
    from pairwright.operators.geocode import centroids

    rows = sites(spark, sf_dir).select(F.col("ordinal").cast("int").alias("place_ordinal"), F.col("city").alias("n"), F.col("region").alias("r"), F.col("country").alias("c"), "lat", "lon", (F.col("population") % 3).alias("p"))
    return centroids(rows).select("key", F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"))


@query
def feed_items(spark, sf_dir):
    from pairwright.plans import feed_queries

    return feed_queries.feed_items(spark, sf_dir)


@query
def board_runs(spark, sf_dir):
    from pairwright.plans import feed_queries

    return feed_queries.board_runs(spark, sf_dir)


@query
def source_states(spark, sf_dir):
    """Registered suppliers, of which some answered, some failed and some didn't."""
    good, _ = R.validate(registry(spark, sf_dir))
    k = F.col("s_suppkey")
    needs = good.join(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), (k % 9 == 1).alias("_needs")), "name")
    good = needs.withColumn("requires_env", F.when(F.col("_needs"), F.array(F.lit("KEY"))).otherwise(F.col("requires_env"))).drop("_needs")
    asked = table(spark, sf_dir, "supplier").filter("s_suppkey % 4 <> 0").select(F.col("s_name").alias("source_name"), F.explode(F.array(F.lit(0), F.lit(1))).alias("request_seq"), k.alias("k"))
    answers = asked.select("source_name", F.lit("").alias("source_url"), F.lit("json").alias("kind"), "request_seq", (F.col("k") % 4 + F.col("request_seq") < 3).alias("ok"), F.lit(503).alias("status"), F.when(F.col("k") % 4 + F.col("request_seq") >= 3, "http 503").alias("error"), F.lit("{}").alias("body"))
    return P.source_status(good, answers, [])


@query
def places_per_country(spark, sf_dir):
    from pairwright.sources.geonames import places_per_country as counts

    return counts(sites(spark, sf_dir).select(F.col("country").alias("c")))


@query
def tabs(spark, sf_dir):
    _, found = square_areas(spark, sf_dir)
    marks = board.board_marks(marks_log(spark, sf_dir), "board-3")
    return board.tab_counts(found, simple_roles(spark, sf_dir), marks, FILTER)


@query
def together_news(spark, sf_dir):
    rows, found = square_areas(spark, sf_dir)
    return board.new_together(found, rows.filter("score >= 60"), 4).select("area_id", "score")


@query
def pins_per_area(spark, sf_dir):
    rows, found = square_areas(spark, sf_dir)
    marks = rows.select(F.col("id").alias("role_id"), (F.col("score") % 7 == 0).alias("pinned"))
    return board.pinned_counts(found, marks)


@query
def separations(spark, sf_dir):
    return pairs.onsite_pairs(sites(spark, sf_dir), apart=board.separation_label(F.col("miles"), F.col("drive_minutes"))).select("id", "apart")
