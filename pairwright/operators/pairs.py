"""Pairs of openings, one of either side, that two people could both take.

roles: id, side (a or b), org, score, lat, lon, country, region, city, population, precision, work_model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairwright.functions.geo import EARTH_MILES, drive_minutes, half_up, harmonic, proximity, to_tenth, with_cell, with_near_cells
from pairwright.functions.scratch import materialize
from pairwright.functions.text import pair_org_key

DEFAULT_RADIUS = 45.0
#: Countries so small that they are one labour market; weights of the confidence levels.
SMALL_COUNTRIES = ("QA", "BH", "KW")
#: Proximity of a pair in one small country beyond the radius.
FAR = 0.5
#: Parts into which the b roles of a grid cell, and the roles of a small country, are dealt.
CELL_PARTS, COUNTRY_PARTS = 8, 64
#: Roles that go through a join in one row, at most: a pair of rows makes at most its square of pairs at once.
TOGETHER = 64
CONFIDENCE = {"pinpoint": 1.0, "country-scale": 0.85, "approximate": 0.6}
NOTES = {
    "pinpoint": "Both locations resolved to a city",
    "country-scale": "Same small country — commutable by definition",
    "approximate": "One or both locations only resolved to a state or country",
    "remote-partner": "Radiology post is remote — the surgical job decides where you live",
}


def located(roles: DataFrame) -> DataFrame:
    return roles.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def is_pinpoint(precision: Column) -> Column:
    return precision == "city"


def _side(roles: DataFrame, side: str) -> DataFrame:
    """A side's columns, and what its pairs need of each role by itself: the employer's key, whether it is pinned, its small country, radians."""
    names = ["id", "org", "score", "lat", "lon", "country", "precision", "work_model"]
    own = {"key": pair_org_key(F.col("org")), "pinned": F.coalesce(is_pinpoint(F.col("precision")), F.lit(False)), "small": F.when(F.col("country").isin(*SMALL_COUNTRIES), F.col("country")), **_angles(F.col("lat"), F.col("lon"))}
    rows = roles.filter(F.col("side") == side)
    return rows.select(*(F.col(n).alias(f"{side}_{n}") for n in names), *(v.alias(f"{side}_{n}") for n, v in own.items()), F.col("lat"), F.col("lon"))


def _angles(lat: Column, lon: Column) -> dict[str, Column]:
    return {"y": F.radians(lat), "x": F.radians(lon), "cos": F.cos(F.radians(lat))}


def _together(side: DataFrame, s: str, *alike: str, parts: int = 1) -> DataFrame:
    """Roles of a side that are alike, at most TOGETHER in a row: `roles`, in order of their ids. id tells the rows apart, to deal them by."""
    rows = side.withColumns({"part": F.pmod(F.xxhash64(f"{s}_id"), F.lit(parts)), f"{s}_score": _score(s), f"{s}_begin": F.concat(f"{s}_id", F.lit("~"))})
    by = [*(f"{s}_{c}" for c in alike), "part"]
    rows = rows.withColumn("nth", F.floor((F.row_number().over(W.partitionBy(*by).orderBy(f"{s}_id")) - 1) / TOGETHER))
    told = F.struct(*(c for c in rows.columns if c in (f"{s}_id", "a_begin", f"{s}_score", f"{s}_key") and c not in by))
    return rows.groupBy(*by, "nth").agg(F.collect_list(told).alias(f"{s}_roles")).withColumn(f"{s}_id", F.xxhash64(*by, "nth")).drop("part", "nth")


def _at_spots_together(side: DataFrame, s: str) -> DataFrame:
    """Roles at one place together, in the shape that _found takes."""
    rows = _together(side, s, "lat", "lon", "pinned", "small").withColumns({"lat": F.col(f"{s}_lat"), "lon": F.col(f"{s}_lon")})
    return rows.withColumns({f"{s}_{n}": v for n, v in _angles(F.col("lat"), F.col("lon")).items()}).hint("merge")  # a side that Spark repeats whole meets a row at once, and all those pairs wait in memory


def _each(found: DataFrame, *facts: Column) -> DataFrame:
    """A row for each pair of the roles that rows hold together. facts are worked out once for each row, as what an array holds isn't put off."""
    rows = found.select(F.inline(F.array(F.struct(*facts))), "a_roles", "b_roles")
    return rows.select("*", F.inline("a_roles")).select("*", F.inline("b_roles"))


def _same_small_country() -> Column:
    return F.coalesce(F.col("a_small") == F.col("b_small"), F.lit(False))


def _both_pinpoint() -> Column:
    return F.col("a_pinned") & F.col("b_pinned")


def confidence() -> Column:
    return F.when(_both_pinpoint(), "pinpoint").when(_same_small_country(), "country-scale").otherwise("approximate")


def _miles() -> Column:
    """haversine_miles of radians."""
    s1, s2 = F.sin((F.col("b_y") - F.col("a_y")) / 2), F.sin((F.col("b_x") - F.col("a_x")) / 2)
    h = s1 * s1 + F.col("a_cos") * F.col("b_cos") * s2 * s2
    return F.lit(2 * EARTH_MILES) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by keys in many partitions, however few bytes they are, as a small table can have very many pairs."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def _every(parts: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))


def _near(a: DataFrame, b: DataFrame, radius: float, dealt: str = "b_id", by: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both sides at most `radius` miles apart: an equi-join on grid cells, then the distance. by: further columns that both sides share."""
    a = with_cell(a, radius).drop("lat", "lon").withColumn("part", _every(CELL_PARTS))
    b = with_near_cells(b, radius).drop("lat", "lon").withColumn("part", F.pmod(F.xxhash64(dealt), F.lit(CELL_PARTS)).cast("int"))
    at = ["band", "cell", "part", *by]
    return a.join(_spread(b, *at), at).drop("band", "cell", "part").withColumn("exact", _miles()).filter(F.col("exact") <= radius)


def _in_small_country(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both sides in one small country, unless both are pinpointed. The vague ones are repeated for every part of the others, as three countries are too few to share the work."""

    def joined(a: DataFrame, b: DataFrame, vague: str) -> DataFrame:
        part = lambda side: _every(COUNTRY_PARTS) if side == vague else F.pmod(F.xxhash64(f"{side}_id"), F.lit(COUNTRY_PARTS)).cast("int")
        keyed = lambda rows, side: rows.drop("lat", "lon").filter(F.col(f"{side}_small").isNotNull()).withColumns({"small": F.col(f"{side}_small"), "part": part(side)})
        return keyed(a, "a").join(_spread(keyed(b, "b"), "small", "part", *by), ["small", "part", *by]).drop("small", "part")

    return joined(a.filter("NOT a_pinned"), b, "a").unionByName(joined(a.filter("a_pinned"), b.filter("NOT b_pinned"), "b"))


def _found(a: DataFrame, b: DataFrame, radius: float, by: tuple[str, ...] = ()) -> DataFrame:
    beyond = _in_small_country(a, b, by).withColumn("exact", _miles()).filter(F.col("exact") > radius)
    return _near(a, b, radius, by=by).unionByName(beyond)


def _sides(roles: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _side(located(roles), "a"), _side(located(roles), "b")


def within_radius(roles: DataFrame, radius: float) -> DataFrame:
    """Located a and b roles at most `radius` miles apart."""
    return _near(*_sides(roles), radius)


_COLUMNS = ["id", "a_id", "b_id", "miles", "drive_minutes", "same_org", "remote_partner", "confidence", "confidence_note", "score"]


def _note(level: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in NOTES.items() for x in kv)), level)


def _weight(level: Column) -> Column:
    return F.when(level == "pinpoint", CONFIDENCE["pinpoint"]).when(level == "country-scale", CONFIDENCE["country-scale"]).otherwise(CONFIDENCE["approximate"])


def _total(near: Column, same: Column, weight: Column) -> Column:
    return half_up((harmonic(_score("a"), _score("b")) * 0.62 + near + F.when(same, 100).otherwise(0) * 0.1) * weight).cast("long")


def _points(near: Column, same: Column, level: Column) -> Column:
    """The score of an on-site pair."""
    return _total(near * 100 * 0.28, same, _weight(level))


def _same_org() -> Column:
    return (F.col("a_key") == F.col("b_key")) & (F.col("a_key") != "")


def _nearness(radius: Column) -> Column:
    """How near the two of a pair are, 0 to 1; `confidence` and exact miles are known."""
    far = (F.col("confidence") == "country-scale") & (F.col("exact") > radius)
    return F.when(far, FAR).otherwise(proximity(F.col("exact"), radius))


def _scored(found: DataFrame, radius: Column) -> DataFrame:
    """Pairs with their distance and radius, scored."""
    found = found.withColumns({"same_org": _same_org(), "confidence": confidence()})
    return found.withColumn("score", _points(_nearness(radius), F.col("same_org"), F.col("confidence")))


def _onsite(found: DataFrame, radius: Column) -> DataFrame:
    """Scored pairs with all that is told of them."""
    return _scored(found, radius).withColumns({"id": F.concat_ws("~", "a_id", "b_id"), "miles": to_tenth(F.col("exact")), "drive_minutes": drive_minutes(F.col("exact")), "remote_partner": F.lit(False), "confidence_note": _note(F.col("confidence"))})


def _pairs_of(found: DataFrame, radius: Column, more: dict[str, Column]) -> DataFrame:
    """Pairs of roles that rows hold together by place: what the places tell once for each two of them, scores for each pair."""
    found = found.withColumns({"confidence": confidence(), "miles": to_tenth(F.col("exact")), "drive_minutes": drive_minutes(F.col("exact"))})
    facts = {"near": _nearness(radius) * 100 * 0.28, "weight": _weight(F.col("confidence")), "confidence_note": _note(F.col("confidence")), **more}
    each = _each(found, "miles", "drive_minutes", "confidence", *(v.alias(k) for k, v in facts.items()))
    each = each.withColumns({"id": F.concat("a_begin", "b_id"), "same_org": _same_org(), "remote_partner": F.lit(False)})
    return each.withColumn("score", _total(F.col("near"), F.col("same_org"), F.col("weight"))).select(*_COLUMNS, *more)


def _sides_together(roles: DataFrame) -> tuple[DataFrame, DataFrame]:
    a, b = _sides(roles)
    return _at_spots_together(a, "a"), _at_spots_together(b, "b")


def onsite_pairs(roles: DataFrame, radius: float = DEFAULT_RADIUS, **more: Column) -> DataFrame:
    """Both on site: within the radius, or anywhere in one small country. more: further columns, of miles, drive_minutes and confidence."""
    return _pairs_of(_found(*_sides_together(roles), radius), F.lit(float(radius)), more)


def pairs_by_radius(roles: DataFrame, radii: list[float]) -> DataFrame:
    """onsite_pairs for each of several radii, with `radius`: the neighbours within the widest one are joined once, each radius filters them."""
    each = _found(*_sides_together(roles), max(radii)).withColumn("radius", F.explode(F.array(*(F.lit(float(r)) for r in sorted(set(radii))))))
    wanted = (F.col("exact") <= F.col("radius")) | _same_small_country() & ~_both_pinpoint()
    return _pairs_of(each.filter(wanted), F.col("radius"), {"radius": F.col("radius")}).select("radius", *_COLUMNS)


def _score(side: str) -> Column:
    return F.coalesce(F.col(f"{side}_score"), F.lit(0)).cast("double")


def _remote_points() -> Column:
    return half_up(F.least(F.lit(100.0), harmonic(_score("a"), _score("b")) * 0.86 + 14)).cast("long")


def remote_pairs(roles: DataFrame, top_k: int | None = None) -> DataFrame:
    """Every located a role with every remote b role, which is |a| x |remote b| rows by definition.

    With top_k, each a role only gets its best partners: the pair score grows with the partner's, so these
    are the same few b roles for all.
    """
    b = _remote_partners(roles, top_k)
    return _remote(_side(located(roles), "a"), F.broadcast(b) if top_k is not None else b)


def _remote_partners(roles: DataFrame, top_k: int | None) -> DataFrame:
    """Remote b roles, all or the best ones."""
    b = _side(roles.filter((F.col("side") == "b") & (F.col("work_model") == "remote")), "b")
    return b if top_k is None else b.orderBy(F.desc("b_score"), "b_id").limit(top_k)


def _remote(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs of both sides. Both are dealt by rows of roles with one score, as small tables with very many pairs come in few partitions, and Spark pairs their partitions: a small side that it repeats whole would meet a row of the other at once, and all those pairs wait in memory."""
    cores = a.sparkSession.sparkContext.defaultParallelism
    a, b = (_together(rows.select(f"{s}_id", f"{s}_score"), s, "score", parts=CELL_PARTS).repartition(n, f"{s}_id").drop(f"{s}_id") for rows, s, n in ((a, "a", cores), (b, "b", 4 * cores)))
    pairs = _each(a.hint("shuffle_replicate_nl").crossJoin(b), _remote_points().alias("score"))
    level = F.lit("remote-partner")
    return pairs.select(F.concat("a_begin", "b_id").alias("id"), "a_id", "b_id", F.lit(None).cast("double").alias("miles"), F.lit(None).cast("long").alias("drive_minutes"), F.lit(False).alias("same_org"), F.lit(True).alias("remote_partner"), level.alias("confidence"), _note(level).alias("confidence_note"), "score")


def build_pairs(roles: DataFrame, radius: float = DEFAULT_RADIUS) -> DataFrame:
    """Remote and on-site pairs, a bag: a remote b role with coordinates may come in both kinds."""
    return remote_pairs(roles).unionByName(onsite_pairs(roles, radius))


# ---- all pairs, held as pairs of classes --------------------------------------------------------------------

_MEMBER = ["remote_partner", "side", "class", "id"]


def _classed(side: DataFrame, s: str, remote: bool, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """A side with one row for each class of roles alike in `by`, named after it, and who belongs to which class."""
    rows = side.withColumn(f"{s}_score", _score(s))
    named = F.sha2(F.to_json(F.struct(F.lit(s).alias("side"), *(f"{s}_{c}" for c in by))), 256)
    rows = rows.withColumn("class", named)
    members = rows.select(F.lit(remote).alias("remote_partner"), F.lit(s).alias("side"), "class", F.col(f"{s}_id").alias("id"))
    return rows.select(F.col("class").alias(f"{s}_id"), *(f"{s}_{c}" for c in by)).distinct(), members


def pair_classes(roles: DataFrame, radius: float = DEFAULT_RADIUS, top_k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """build_pairs (with top_k: each role's best remote ones) as pairs of classes and their members, which grow with the roles.

    Roles of a class are alike in all that a pair's columns come from, so any of a class pairs with any of
    another one as the classes do; see members_paired. members: remote_partner, side, class, id.
    """
    spot = ["score", "lat", "lon", "key", "pinned", "small", "y", "x", "cos"]
    (a, of_a), (b, of_b) = (_classed(rows, s, False, spot) for rows, s in zip(_sides(roles), "ab", strict=True))
    a, b = (rows.withColumns({"lat": F.col(f"{s}_lat"), "lon": F.col(f"{s}_lon")}) for rows, s in ((a, "a"), (b, "b")))
    onsite = _onsite(_found(a, b, radius), F.lit(float(radius))).select(*_COLUMNS)
    remote_a, of_remote_a = _classed(_side(located(roles), "a"), "a", True, ["score"])
    remote_b, of_remote_b = _classed(_remote_partners(roles, top_k), "b", True, ["score"])
    members = of_a.unionByName(of_b).unionByName(of_remote_a).unionByName(of_remote_b)
    found = onsite.unionByName(_remote(remote_a, remote_b))
    return found.drop("id").withColumnsRenamed({"a_id": "a_class", "b_id": "b_class"}), members.select(*_MEMBER)


def _of_side(members: DataFrame, s: str) -> DataFrame:
    return members.filter(F.col("side") == s).withColumnRenamed("class", f"{s}_class").drop("side")


def members_paired(classes: DataFrame, members: DataFrame, *by: str) -> DataFrame:
    """Every pair of members of paired classes: build_pairs. by: further columns that both tables share."""
    both = classes
    for s in "ab":
        both = both.join(_of_side(members, s).withColumnRenamed("id", f"{s}_id"), [*by, "remote_partner", f"{s}_class"])
    return both.withColumn("id", F.concat_ws("~", "a_id", "b_id")).select(*by, *_COLUMNS)


def count_members_paired(classes: DataFrame, members: DataFrame) -> DataFrame:
    """One row, pairs: how many members_paired there are."""
    for s in "ab":
        classes = classes.join(_of_side(members, s).groupBy("remote_partner", f"{s}_class").agg(F.count("*").alias(f"{s}_n")), ["remote_partner", f"{s}_class"])
    return classes.agg(F.coalesce(F.sum(F.col("a_n") * F.col("b_n")), F.lit(0)).alias("pairs"))


def best_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """The k best pairs of each a role."""
    w = W.partitionBy("a_id").orderBy(F.desc("score"), "b_id", "remote_partner")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


_SPOT = ("lat", "lon", "pinned", "small", "y", "x", "cos")


def _by_place(side: DataFrame, s: str) -> DataFrame:
    """A side with `place`, the name of what its pairs need but for employer and score; an unknown employer's key is ''."""
    name = F.concat_ws("|", *(F.col(f"{s}_{c}").cast("string") for c in ("lat", "lon", "pinned", "small")))
    return side.withColumns({f"{s}_score": _score(s), f"{s}_key": F.coalesce(f"{s}_key", F.lit("")), f"{s}_place": name})


def _at_places(rows: DataFrame, s: str) -> DataFrame:
    """rows in the shape that _found takes, dealt by place and with `key` to join by."""
    return rows.withColumns({"lat": F.col(f"{s}_lat"), "lon": F.col(f"{s}_lon"), f"{s}_id": F.col(f"{s}_place"), "key": F.col(f"{s}_key")})


def _least(scores: DataFrame, k: int, *by: str) -> DataFrame:
    """The k-th best score by `by`, as least, where there are so many."""
    nth = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score")))
    return scores.select(*by, "score").withColumn("nth", nth).filter(F.col("nth") == k).select(*by, F.col("score").alias("least"))


def _best_of_classes(a: DataFrame, b: DataFrame, least: DataFrame, k: int, radius: float) -> DataFrame:
    """a_place, a_key, a_score, b_id, b_own, score: for each class of a roles its k best pairs with b roles of the same key, if they reach `least` (a_place, a_score).

    A place's best b role tells whether any there can be among the best; only those places' roles are paired.
    """
    spot = lambda s: [f"{s}_{c}" for c in ("place", "key", *_SPOT)]
    grade = ["a_place", "a_key", "a_score"]
    classes = a.select(*spot("a"), "a_score").distinct().join(least, ["a_place", "a_score"], "left").fillna(0, ["least"])
    best = b.groupBy(*spot("b")).agg(F.max("b_score").alias("b_score"))
    scored = lambda rows: _scored(rows, F.lit(float(radius)))
    reach = F.col("score") >= F.col("least") - 1  # a lower score of b, which rounds otherwise, may gain a point
    near = scored(_found(_at_places(classes, "a"), _at_places(best, "b"), radius, ("key",))).filter(reach)
    near = materialize(near.select(*grade, "b_place", "b_key", "exact", "a_pinned", "b_pinned", "a_small", "b_small", "least", "score"))
    higher = materialize(_least(near, k, *grade).withColumnRenamed("least", "higher"))
    near = near.join(higher, grade, "left").withColumn("least", F.greatest("least", "higher")).filter(reach)
    nth = F.row_number().over(W.partitionBy("b_place", "b_key", "b_score").orderBy("b_id"))
    few = b.select("b_place", "b_key", "b_score", "b_id", "b_own").withColumn("nth", nth).filter(F.col("nth") <= k).drop("nth")
    found = scored(near.drop("score", "higher").join(few, ["b_place", "b_key"])).filter(F.col("score") >= F.col("least"))
    w = W.partitionBy(*grade).orderBy(F.desc("score"), "b_id")
    return materialize(found.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k).select(*grade, "b_id", "b_own", "score"))


def best_onsite_pairs(roles: DataFrame, k: int, radius: float = DEFAULT_RADIUS) -> DataFrame:
    """a_id, b_id, score and rank: best_pairs of onsite_pairs, without all pairs.

    Roles alike in place and score have the same best pairs but for employers, and of like b roles only the k
    first can be among them. A common employer only adds to a score, so an a role's k best are among its class's
    k best whatever the employer, and the k best of its own employer. The best b roles of every grid cell tell
    a score that the former reach at least, and these one that the latter must reach.
    """
    a, b = (_by_place(rows, s).withColumn(f"{s}_own", F.col(f"{s}_key")) for rows, s in zip(_sides(roles), "ab", strict=True))
    of_any, with_any = a.withColumn("a_key", F.lit("")), b.withColumn("b_key", F.lit(""))
    top = W.partitionBy("band", "cell", "b_small", "b_pinned").orderBy(F.desc("b_score"), "b_id")
    strong = materialize(with_cell(with_any, radius).withColumn("nth", F.row_number().over(top)).filter(F.col("nth") <= 2 * k).drop("nth", "band", "cell"))
    classes = of_any.select("a_place", "a_score", "a_key", *(f"a_{c}" for c in _SPOT)).distinct()
    least = materialize(_least(_scored(_found(_at_places(classes, "a"), strong, radius), F.lit(float(radius))), k, "a_place", "a_score"))
    plain = _best_of_classes(of_any, with_any, least, k, radius)
    least = materialize(_least(plain, k, "a_place", "a_score"))
    same = _best_of_classes(a.filter("a_key <> ''"), b.filter("b_key <> ''"), least, k, radius)
    each = a.select("a_id", "a_place", "a_score", "a_key")
    found = each.join(plain.drop("a_key"), ["a_place", "a_score"]).filter("a_key = '' OR a_key <> b_own")
    found = found.select("a_id", "b_id", "score").unionByName(each.join(same.drop("b_own"), ["a_place", "a_key", "a_score"]).select("a_id", "b_id", "score"))
    return best_pairs(found.withColumn("remote_partner", F.lit(False)), k).drop("remote_partner")


# ---- numbers of pairs, without the pairs --------------------------------------------------------------------


def _classes(side: DataFrame, name: str, *by: str) -> DataFrame:
    """How many roles of a side are alike in `by`."""
    return side.withColumn(f"{name}_score", _score(name)).groupBy(*(f"{name}_{c}" for c in by)).agg(F.count("*").alias(f"{name}_n"))


def _near_spots(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Different places of a and of b roles at most `radius` miles apart, and their distance."""
    spot = lambda rows, s: rows.select(*(f"{s}_{c}" for c in ("lat", "lon", "y", "x", "cos")), "lat", "lon").distinct()
    return _near(spot(a, "a"), spot(b, "b"), radius, "b_lat").select("a_lat", "a_lon", "b_lat", "b_lon", "exact")


def _at_spots(spots: DataFrame, a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Classes of both sides at the spots, alike in keys."""
    return _spread(spots.join(a, ["a_lat", "a_lon"]), "b_lat", "b_lon", *keys).join(b, ["b_lat", "b_lon", *keys])


def count_onsite_pairs(roles: DataFrame, radius: float = DEFAULT_RADIUS) -> DataFrame:
    """One row, pairs: how many onsite_pairs there are."""
    a, b = _sides(roles)
    n, wide = F.coalesce(F.sum(F.col("a_n") * F.col("b_n")), F.lit(0)), _same_small_country() & ~_both_pinpoint()
    near = _at_spots(_near_spots(a, b, radius), *(_classes(rows, s, "lat", "lon", "pinned", "small") for rows, s in ((a, "a"), (b, "b"))))
    all_wide = _classes(a, "a", "pinned", "small").crossJoin(_classes(b, "b", "pinned", "small"))  # eight rows with eight rows
    near, all_wide = near.filter(~wide).agg(n.alias("near")), all_wide.filter(wide).agg(n.alias("wide"))
    return near.crossJoin(all_wide).select((F.col("near") + F.col("wide")).alias("pairs"))  # one row with one row


def pair_totals(roles: DataFrame, radius: float = DEFAULT_RADIUS) -> DataFrame:
    """remote_partner, confidence, and n, total_score and n_same_org of build_pairs, without making the pairs.

    Places are paired instead of roles, and roles alike in what their score comes from count at once. A pair's
    employers only matter where they are the same, so those pairs add what that changes. Pairs of one small
    country are counted as if all were beyond the radius, and those within it add what that changes.
    """
    a, b = _sides(roles)
    spots = materialize(_near_spots(a, b, radius))
    near, n = proximity(F.col("exact"), F.lit(float(radius))), F.col("a_n") * F.col("b_n")
    level = confidence()
    wide = level == "country-scale"
    plain = lambda near: _points(near, F.lit(False), level)
    more = lambda near: _points(near, F.lit(True), level) - plain(near)

    def tally(rows: DataFrame, points: Column, number: Column, same: Column) -> DataFrame:
        return rows.groupBy(F.lit(False).alias("remote_partner"), level.alias("confidence")).agg(F.sum(number).alias("n"), F.sum(points * n).alias("total_score"), F.sum(same).alias("n_same_org"))

    def classes(*by: str, rows_a: DataFrame = a, rows_b: DataFrame = b) -> tuple[DataFrame, DataFrame]:
        return _classes(rows_a, "a", *by), _classes(rows_b, "b", *by)

    zero, nowhere = F.lit(0).cast("long"), F.lit(None).cast("string")
    keyed = lambda two: (two[0].filter("a_key <> ''").withColumn("key", F.col("a_key")), two[1].filter("b_key <> ''").withColumn("key", F.col("b_key")))
    pinned = a.filter("a_pinned"), b.filter("b_pinned")
    vague = a.filter("NOT a_pinned"), b.filter("NOT b_pinned")
    place, grade = ("lat", "lon", "pinned", "small", "score"), ("pinned", "small", "score")
    exact = classes(*place, rows_a=pinned[0].withColumn("a_small", nowhere), rows_b=pinned[1].withColumn("b_small", nowhere))  # their country doesn't matter
    first = lambda points: points(near) - F.when(wide, points(F.lit(FAR))).otherwise(0)
    alone = F.when(wide, 0).otherwise(n)
    parts = [tally(_at_spots(spots, *two), first(plain), alone, zero) for two in (exact, classes(*place, rows_a=vague[0]), classes(*place, rows_a=pinned[0], rows_b=vague[1]))]
    parts.append(tally(_at_spots(spots, *keyed(classes(*place, "key")), "key"), first(more), zero, alone))
    in_one = lambda two, *keys: two[0].filter("a_small IS NOT NULL").withColumn("small", F.col("a_small")).join(two[1].withColumn("small", F.col("b_small")), ["small", *keys]).filter(wide)
    parts.append(tally(in_one(classes(*grade)), plain(F.lit(FAR)), n, zero))
    parts.append(tally(in_one(keyed(classes(*grade, "key")), "key"), more(F.lit(FAR)), zero, n))
    remote = _classes(_side(roles.filter(F.col("work_model") == "remote"), "b"), "b", "score")
    remote = _classes(a, "a", "score").crossJoin(remote)  # a row for each score
    parts.append(remote.groupBy(F.lit(True).alias("remote_partner"), F.lit("remote-partner").alias("confidence")).agg(F.sum(n).alias("n"), F.sum(_remote_points() * n).alias("total_score"), F.sum(zero).alias("n_same_org")))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.groupBy("remote_partner", "confidence").agg(*(F.sum(c).alias(c) for c in ("n", "total_score", "n_same_org"))).filter("n > 0")
