"""The board: filters and orders of roles, marks that people set, unread roles, and members of areas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What a mark may hold.
STATUSES = ("new", "interested", "contacted", "applied", "passed")
EMPTY_MARK = {"pinned": False, "status": "new", "note": ""}


@dataclass(frozen=True)
class RoleFilter:
    specialty: str | None = None
    country: str | None = None
    setting: str | None = None
    work_model: str | None = None
    min_score: int = 0
    search: str = ""
    new_only: bool = False
    posted_within: int = 0

    def condition(self, undated: bool = False) -> Column:
        """undated: leaves the age out."""
        ok = F.col("score") >= self.min_score
        for name in ("specialty", "country", "setting", "work_model"):
            if (value := getattr(self, name)) is not None:
                ok = ok & F.coalesce(F.col(name) == value, F.lit(False))
        if self.new_only:
            ok = ok & F.col("is_new")
        if self.posted_within and not undated:  # what has no date can't be shown to be recent
            ok = ok & F.coalesce(F.col("age_days") <= self.posted_within, F.lit(False))
        if needle := self.search.strip().lower():
            hay = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("title", "org", "location_text", "description"))))
            ok = ok & hay.contains(needle)
        return ok


def filter_roles(roles: DataFrame, f: RoleFilter) -> DataFrame:
    return roles.filter(f.condition())


def undated_held_back(roles: DataFrame, f: RoleFilter) -> DataFrame:
    """One row: undated roles that only the age filter holds back."""
    held = F.count_if(F.col("age_days").isNull()) if f.posted_within else F.lit(0).cast("long")
    return roles.filter(f.condition(undated=True)).agg(held.alias("undated"))


def sort_roles(roles: DataFrame, key: str) -> DataFrame:
    """By fit, newest or oldest; undated roles last, fit breaks ties."""
    age = {"newest": F.asc_nulls_last("age_days"), "oldest": F.desc_nulls_last("age_days")}
    return roles.orderBy(*([age[key]] if key in age else []), F.desc("score"), "id")


def ranked(roles: DataFrame, key: str, k: int) -> DataFrame:
    """The first k roles in that order, with their rank."""
    age = {"newest": F.asc_nulls_last("age_days"), "oldest": F.desc_nulls_last("age_days")}
    order = [*([age[key]] if key in age else []), F.desc("score"), F.asc("id")]
    top = roles.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order)))  # of k rows


# ---- marks --------------------------------------------------------------------------------------------------


def mark_error() -> Column:
    """The first rule that a mark breaks, or null."""
    n = lambda c: F.length(F.coalesce(c, F.lit("")))
    return (
        F.when(~n("board_id").between(4, 64), "board_id").when(~n("role_id").between(1, 400), "role_id").when(~F.coalesce("status", F.lit("new")).isin(*STATUSES), "status")
        .when(n("note") > 2000, "note").when(n("by") > 80, "by")
    )


def latest_marks(log: DataFrame) -> DataFrame:
    """The last valid mark of every board and role; later rows of one instant win."""
    w = W.partitionBy("board_id", "role_id").orderBy(F.desc("updated_at"), F.desc("seq"))
    return log.filter(mark_error().isNull()).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def append_marks(marks: DataFrame, path: str, now: Column) -> None:
    """Adds valid marks to the log, stamped by the writer; seq keeps the order of what is added at one instant."""
    marks.filter(mark_error().isNull()).withColumns({"updated_at": now, "seq": F.monotonically_increasing_id()}).write.mode("append").parquet(path)


def board_marks(log: DataFrame, board_id: str) -> DataFrame:
    """One row per role of one board, with defaults for nulls."""
    found = latest_marks(log.filter(F.col("board_id") == board_id))
    return found.select("role_id", *(F.coalesce(k, F.lit(v)).alias(k) for k, v in EMPTY_MARK.items()), F.coalesce("by", F.lit("")).alias("by"), "updated_at")


def with_marks(roles: DataFrame, marks: DataFrame) -> DataFrame:
    """roles with their marks, the empty mark where there is none."""
    m = marks.select(F.col("role_id").alias("id"), *EMPTY_MARK)
    return roles.join(m, "id", "left").withColumns({k: F.coalesce(k, F.lit(v)) for k, v in EMPTY_MARK.items()})


def pinned_roles(roles: DataFrame, marks: DataFrame) -> DataFrame:
    return roles.join(marks.filter("pinned").select(F.col("role_id").alias("id")), "id", "left_semi")


# ---- areas --------------------------------------------------------------------------------------------------


def area_members(areas: DataFrame) -> DataFrame:
    """area_id, side, pos and id: the members of every area, best first."""
    one = lambda s: areas.select("area_id", F.lit(s).alias("side"), F.posexplode(f"{s}_ids").alias("pos", "id"))
    return one("a").unionByName(one("b"))


def top_members(areas: DataFrame, k: int) -> DataFrame:
    """The first k members of each side of each area, and how many more there are."""
    w = W.partitionBy("area_id", "side")
    rows = area_members(areas).withColumns({"n": F.count("*").over(w), "rank": F.row_number().over(w.orderBy("pos"))})
    return rows.filter(F.col("rank") <= k).select("area_id", "side", "rank", "id", F.greatest(F.col("n") - k, F.lit(0)).alias("more"))


def filtered_areas(areas: DataFrame, allowed: DataFrame, pool: int) -> DataFrame:
    """Areas with only allowed members; counts and flags follow, label, score and span stay, empty ones go."""
    kept = area_members(areas).join(allowed.select("id"), "id", "left_semi")
    ids = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("pos", "id")))), lambda x: x["id"])
    new = kept.groupBy("area_id").agg(ids("a").alias("a_ids"), ids("b").alias("b_ids"))
    df = areas.drop("a_ids", "b_ids", "a_count", "b_count", "is_together", "remote_unlocked", "missing_side").join(new, "area_id")
    df = df.withColumns({"a_count": F.size("a_ids"), "b_count": F.size("b_ids")})
    together = (F.col("a_count") > 0) & (F.col("b_count") > 0)
    return df.withColumns({"is_together": together, "remote_unlocked": ~together & (F.col("a_count") > 0) & F.lit(pool > 0), "missing_side": F.when(together, F.lit(None).cast("string")).when(F.col("a_count") > 0, "b").otherwise("a")})


def pinned_counts(areas: DataFrame, marks: DataFrame) -> DataFrame:
    """area_id and pinned members, of areas that have some."""
    return pinned_roles(area_members(areas), marks).groupBy("area_id").agg(F.count("*").alias("pinned"))


# ---- unread -------------------------------------------------------------------------------------------------


def unread(roles: DataFrame, readers: DataFrame) -> DataFrame:
    """reader with every role first seen after the reader's last visit; a first visit has none."""
    seen = readers.filter("last_seen IS NOT NULL")
    return roles.join(seen, F.col("first_seen") > F.col("last_seen"))


def unread_since(roles: DataFrame, last_seen: str | None) -> DataFrame:
    """Roles first seen after one reader's last visit."""
    return roles.filter(F.col("first_seen") > F.lit(last_seen).cast("date"))


def batches(unread_roles: DataFrame) -> DataFrame:
    """first_seen and ids of unread roles, best first in each batch."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id")))
    return unread_roles.groupBy("first_seen").agg(F.transform(ordered, lambda x: x["id"]).alias("ids"), F.count("*").alias("n"))


def new_together(areas: DataFrame, unread_roles: DataFrame, k: int = 4) -> DataFrame:
    """The k best areas with both sides that have an unread member."""
    hit = area_members(areas.filter("is_together")).join(unread_roles.select("id"), "id", "left_semi").select("area_id").distinct()
    return areas.join(hit, "area_id", "left_semi").orderBy(F.desc("score"), "area_id").limit(k)


def tab_counts(areas: DataFrame, roles: DataFrame, marks: DataFrame, f: RoleFilter) -> DataFrame:
    """One row: areas to live in, pinned roles, and results per side."""
    places = areas.agg(F.count_if(F.col("is_together") | F.col("remote_unlocked")).alias("together"))
    sides = filter_roles(roles, f).agg(F.count_if(F.col("specialty") == "a").alias("a_results"), F.count_if(F.col("specialty") == "b").alias("b_results"))
    return places.crossJoin(marks.agg(F.count_if("pinned").alias("pinned"))).crossJoin(sides)  # one row each


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """Roles, which must be there, and areas, which may not."""
    from pyspark.errors import AnalysisException

    roles = spark.read.parquet(f"{path}/roles")
    try:
        return roles, spark.read.parquet(f"{path}/areas")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return roles, None


def posted_label(age: Column) -> Column:
    """How long ago a role was posted, in words."""
    months = F.floor(age / 30 + 0.5).cast("long")
    return (
        F.when(age.isNull(), "date not stated").when(age == 0, "posted today").when(age == 1, "posted yesterday").when(age < 30, F.concat(F.lit("posted "), age.cast("string"), F.lit(" days ago")))
        .otherwise(F.concat(F.lit("posted "), months.cast("string"), F.when(months == 1, " month ago").otherwise(" months ago")))
    )


def separation_label(miles: Column, minutes: Column) -> Column:
    """Distance and estimated drive, in words."""
    far = F.when(miles < 1, "<1 mi").otherwise(F.concat(F.floor(miles + 0.5).cast("string"), F.lit(" mi")))
    hours, rest = F.floor(minutes / 60), minutes % 60
    long = F.concat(F.lit(" · ~"), hours.cast("string"), F.lit("h"), F.when(rest > 0, F.concat(F.lit(" "), rest.cast("string"), F.lit("m"))).otherwise(""))
    return F.concat(far, F.when(minutes.isNull(), "").when(minutes < 60, F.concat(F.lit(" · ~"), minutes.cast("string"), F.lit(" min"))).otherwise(long))


#: How countries, settings and work models are shown.
COUNTRY_NAMES = {"US": "United States", "QA": "Qatar", "AE": "UAE", "SA": "Saudi Arabia", "KW": "Kuwait", "BH": "Bahrain", "OM": "Oman"}
SETTING_LABELS = {"academic": "Academic", "private": "Private group", "hospital-employed": "Hospital-employed", "government": "Government / VA", "unknown": "Unspecified"}
WORK_MODEL_LABELS = {"remote": "Remote", "hybrid": "Hybrid", "onsite": "On-site"}


def _label(names: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), key)


def place_label(precision: Column, city: Column, region: Column, country: Column, raw: Column, fallback: str = "Location not stated") -> Column:
    """Where a role is, in words: state in the first country, country elsewhere, then what the posting said."""
    some = lambda c: F.nullif(c, F.lit(""))
    at_home = F.coalesce(country == "US", F.lit(False))
    abroad = F.when(~at_home, _label(COUNTRY_NAMES, country))
    tail = F.when(at_home, some(region)).otherwise(abroad)
    return (
        F.when(precision == "remote", "Remote").when(some(city).isNotNull(), F.concat_ws(", ", city, tail))
        .when(some(region).isNotNull() & at_home, F.concat(region, F.lit(" (state-wide)"))).when(abroad.isNotNull(), F.concat(abroad, F.lit(" (country-wide)")))
        .otherwise(F.coalesce(some(raw), F.lit(fallback)))
    )


def setting_label(setting: Column) -> Column:
    return _label(SETTING_LABELS, setting)


def work_model_label(work_model: Column) -> Column:
    return _label(WORK_MODEL_LABELS, work_model)


def run_label(day: Column) -> Column:
    """The day of a run, like 19 Aug 2026; what is no day is unknown."""
    return F.coalesce(F.date_format(day.try_cast("date"), "d MMM yyyy"), F.lit("unknown"))
