"""Permits: nearby and area joins, benchmarks, rollups, proportional samples."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.ranges import PARTS, UNIT, divided_seats, nearest_ranks, running_rank, unit_join
from tessella.operators.text_index import TextIndex, index_hits, passing_index
from tessella.sources.scratch import settled

#: Fixed value: radius of the earth in metres.
EARTH = 6_371_000


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def _bands(radius: float) -> tuple[float, int]:
    """The radius in degrees, a little more, and the number of bands of latitude at least as high."""
    degrees = math.degrees(radius / EARTH) * (1 + 1e-9)
    return degrees, max(1, math.floor(180 / degrees)) if degrees else 1 << 20


def _reach(latitude: Column, degrees: float) -> Column:
    """The most degrees of longitude by which a point within the radius can differ; 180 where a pole is within it."""
    wide = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(math.radians(degrees))) / F.cos(F.radians(latitude)))))
    return F.when(F.abs(latitude) + degrees >= 90, 180.0).otherwise(wide * (1 + 1e-9) + 1e-9)


def radius_join(left: DataFrame, right: DataFrame, radius: float, lat: str = "lat", lon: str = "lon", unit: int = UNIT) -> DataFrame:
    """Pairs within `radius` metres with distance_m; right's columns get the prefix r_. Anywhere: across longitude 180 and the poles too.

    An equi-join on cells. Bands of latitude are as high as the radius, and each is cut into as many cells as its own
    latitude allows, around the whole circle. right stays in its cell; left visits the cells of its and the neighbouring
    bands that its radius may touch, counted around the circle. Crowded cells are cut by the number of their rows
    (unit_join). Rows without coordinates, or with a latitude beyond 90 degrees, match nothing.
    """
    degrees, bands = _bands(radius)
    y = F.least(F.floor((F.col(lat) + 90) / 180 * bands), F.lit(bands - 1)).cast("int")

    def cells(band: Column) -> Column:
        edge = F.greatest(F.abs(band / bands * 180 - 90), F.abs((band + 1) / bands * 180 - 90))
        return F.greatest(F.lit(1), F.floor(360 / _reach(edge, degrees))).cast("bigint")

    at = lambda x, band: F.floor((x + 180) / 360 * cells(band)).cast("bigint")
    located = lambda df: df.filter(F.col(lat).between(-90, 90) & F.col(lon).isNotNull() & ~F.isnan(F.col(lon).cast("double")))
    visits = located(left).withColumn("_y", F.explode(F.filter(F.array(y - 1, y, y + 1), lambda b: (b >= 0) & (b < bands))))
    own = _reach(F.col(lat), degrees)
    visits = visits.withColumn("_n", cells(F.col("_y"))).withColumn("_from", at(F.col(lon) - own, F.col("_y"))).withColumn("_to", F.least(at(F.col(lon) + own, F.col("_y")), F.col("_from") + F.col("_n") - 1))
    visits = visits.withColumn("_x", F.explode(F.sequence("_from", "_to"))).withColumn("_x", F.pmod("_x", "_n")).drop("_n", "_from", "_to")
    homes = located(right).withColumn("_y", y).withColumn("_x", F.pmod(at(F.col(lon), F.col("_y")), cells(F.col("_y"))))
    homes = homes.select(*(F.col(c).alias(f"r_{c}") for c in right.columns), "_y", "_x")
    pairs = unit_join(visits, homes, ["_y", "_x"], unit).filter(F.abs(F.col(lat) - F.col(f"r_{lat}")) <= degrees + 1e-9)  # cheaper than the distance
    pairs = pairs.withColumn("distance_m", haversine(F.col(lat), F.col(lon), F.col(f"r_{lat}"), F.col(f"r_{lon}")))
    return pairs.filter(F.col("distance_m") <= radius).drop("_y", "_x")


def nearby_or_same_area(sites: DataFrame, permits: DataFrame, site_id: str, permit_id: str, area: str, radius: float, unit: int = UNIT, **grid: object) -> DataFrame:
    """site, permit, distance_m, distance_status: by distance where both have coordinates, else of the same area (unknown distance).

    Areas with very many rows are joined in units (unit_join).
    """
    lat, lon = grid.get("lat", "lat"), grid.get("lon", "lon")
    known = radius_join(sites, permits, radius, unit=unit, **grid).select(site_id, F.col(f"r_{permit_id}").alias(permit_id), "distance_m", F.lit("measured").alias("distance_status"))
    where = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    s, p = sites.select(site_id, F.col(area).alias("_area"), where.alias("_located")), permits.select(permit_id, F.col(area).alias("_area"), where.alias("_located"))
    # Blind sites meet all permits of their area, located ones the blind permits: no pair is made that both coordinates tell.
    blind = [(s.filter("NOT _located"), p), (s.filter("_located"), p.filter("NOT _located"))]
    for some, others in blind:
        unknown = unit_join(some.drop("_located"), others.drop("_located"), ["_area"], unit)
        known = known.unionByName(unknown.select(site_id, permit_id, F.lit(None).cast("double").alias("distance_m"), F.lit("unknown").alias("distance_status")))
    return known


def nearest_first(rows: DataFrame, key: str, distance: str, date: str, tie: str, limit: int) -> DataFrame:
    """The first `limit` rows per key: known distances first, nearest first, then newest."""
    w = Window.partitionBy(key).orderBy(F.col(distance).isNull(), distance, F.desc(date), tie)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def link_by_area(
    permits: DataFrame, segments: DataFrame, permit_id: str, area: str, sub_area: str, segment_id: str, text_col: str, date: str, issues: str, per_permit: int = 12,
    related: Column | None = None, admin_only: Column | None = None, index: TextIndex | None = None,
) -> DataFrame:
    """permit, segment, relation, score, rank: passages that name the permit's sub-area (1.0), area (0.86) or neither (0.62).

    Plus 0.02 for each issue, 0.08 at most; the best `per_permit` for each. Only passages that are `related` (subject and signal
    terms) count, and administrative ones (`admin_only`) don't. Passages that name a place are found by its tokens; of the
    others, which score below all of those, only the first 2 * per_permit of all can be among an area's best, so each
    distinct area meets those alone. Permits join the short lists.
    """
    rows = segments if related is None else segments.filter(related)
    rows = rows if admin_only is None else rows.filter(~F.coalesce(admin_only, F.lit(False)))
    bonus = F.least(F.lit(0.08), 0.02 * F.coalesce(F.col(issues), F.lit(0)))
    plain = rows.select(F.col(segment_id), F.col(date).alias("_date"), bonus.alias("_bonus"))
    areas = permits.select(F.col(area).alias("_a"), F.col(sub_area).alias("_s")).distinct()
    kinds = F.array(F.struct(F.col("_s").alias("_name"), F.lit("same_sub_area").alias("relation"), F.lit(1.0).alias("_base")), F.struct(F.col("_a").alias("_name"), F.lit("same_area").alias("relation"), F.lit(0.86).alias("_base")))
    wanted = areas.select("_a", "_s", F.explode(kinds).alias("k")).select("_a", "_s", "k.*").filter("_name <> ''")
    names = wanted.select(F.col("_name").alias("request_id"), F.col("_name").alias("term")).distinct()
    said = index_hits(index or passing_index(rows, segment_id, text_col), names, rows, segment_id, text_col).select(F.col("request_id").alias("_name"), segment_id)
    said = said.hint("merge").join(rows.select(segment_id, text_col, F.col(date).alias("_date"), bonus.alias("_bonus")), segment_id).filter(F.contains(text_col, "_name"))
    # Who is among an area's best is among its name's best: so many rows of a name and relation go on, however many passages say it.
    said = said.select("_name", segment_id, "_date", "_bonus", F.explode(F.array(F.lit(1.0), F.lit(0.86))).alias("_base"))
    first = F.row_number().over(Window.partitionBy("_name", "_base").orderBy(F.round(F.col("_base") + F.col("_bonus"), 4).desc(), "_date", segment_id))
    said = settled(said.withColumn("_n", first).filter(F.col("_n") <= per_permit).select("_name", "_base", segment_id), "area-names")
    local = wanted.hint("merge").join(said, ["_name", "_base"]).select("_a", "_s", segment_id, "relation", "_base")
    general = plain.orderBy(F.desc("_bonus"), "_date", segment_id).limit(2 * per_permit).select(segment_id, F.lit("general").alias("relation"), F.lit(0.62).alias("_base"))
    both = local.unionByName(areas.crossJoin(F.broadcast(general)))
    both = both.groupBy("_a", "_s", segment_id).agg(F.max_by("relation", "_base").alias("relation"), F.max("_base").alias("_base"))
    both = both.hint("merge").join(plain, segment_id).withColumn("score", F.round(F.col("_base") + F.col("_bonus"), 4))
    rank = F.row_number().over(Window.partitionBy("_a", "_s").orderBy(F.desc("score"), "_date", segment_id))
    best = both.withColumn("rank", rank).filter(F.col("rank") <= per_permit).select("_a", "_s", segment_id, "relation", "score", "rank")
    return permits.join(best, F.col(area).eqNullSafe(F.col("_a")) & F.col(sub_area).eqNullSafe(F.col("_s"))).select(permit_id, segment_id, "relation", "score", "rank")


def permit_summary(rows: DataFrame, key: str, capacity: Column, status: str, operating: Sequence[str], stopped: Sequence[str], origin: str) -> DataFrame:
    """Per key: permits, total capacity, operating number and rate, and one data origin or `mixed`.

    A status counts as operating if it holds one of `operating` and none of `stopped`.
    """
    has = lambda terms: F.coalesce(F.greatest(*(F.col(status).contains(t) for t in terms), F.lit(False)), F.lit(False))
    runs = has(operating) & ~has(stopped)
    rows = rows.groupBy(key).agg(
        F.count("*").alias("permits"), F.sum(capacity).alias("total_capacity"), F.count_if(runs).alias("operating"), F.min(origin).alias("_low"), F.max(origin).alias("_high")
    )
    return rows.withColumn("operating_rate", F.round(F.col("operating") / F.col("permits"), 4)).withColumn("data_origin", F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise("mixed")).drop("_low", "_high")


def percentiles_by_scope(rows: DataFrame, ratio: Column, scopes: Sequence[str], fractions: Mapping[str, float], low: float, high: float, least: int, parts: int = PARTS) -> DataFrame:
    """Exact nearest-rank percentiles of a clipped ratio for every value of each scope column and for all rows (scope `all`).

    scope, value, sample_size and a column for each fraction; scopes with fewer than `least` rows have none. The value at
    rank bround(f * (n - 1)) + 1 of each scope's rows. No task orders a whole scope (ranges.nearest_ranks).
    """
    kept = rows.withColumn("_ratio", ratio).filter(F.col("_ratio").between(low, high))
    each = F.array(*(F.struct(F.lit(s).alias("scope"), F.col(s).cast("string").alias("value")) for s in scopes), F.struct(F.lit("all").alias("scope"), F.lit("").alias("value")))
    scoped = kept.select("_ratio", F.explode(each).alias("s")).select("_ratio", "s.*").filter("value IS NOT NULL")
    values = scoped.groupBy("scope", "value", "_ratio").agg(F.count("*").alias("_n"))
    return nearest_ranks(values, ["scope", "value"], "_ratio", "_n", fractions, parts).filter(F.col("sample_size") >= least)


def benchmark_for(targets: DataFrame, percentiles: DataFrame, scopes: Sequence[str]) -> DataFrame:
    """targets with the percentiles of their narrowest scope that has any, else of all rows."""
    out, columns = targets, [c for c in percentiles.columns if c not in ("scope", "value")]
    for s in (*scopes, "all"):
        part = percentiles.filter(F.col("scope") == s).select(F.col("value").alias(f"_k_{s}"), F.struct(F.lit(s).alias("scope"), *columns).alias(f"_b_{s}"))
        key = F.lit("") if s == "all" else F.col(s).cast("string")
        out = out.join(F.broadcast(part) if s == "all" else part, key == F.col(f"_k_{s}"), "left").drop(f"_k_{s}")
    return out.withColumn("_b", F.coalesce(*(F.col(f"_b_{s}") for s in (*scopes, "all")))).select(*targets.columns, "_b.*")


def area_rollup(rows: DataFrame, area: str, sub_area: str, kind: str, kinds: Sequence[str], capacity: Column, date: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Counts by kind, capacity, latest date, centre and bounds for all rows, each area and each sub-area, known ones only."""
    rolled = rows.rollup(area, sub_area).agg(
        F.grouping_id().alias("_g"), F.count("*").alias("total"), *(F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds), F.sum(capacity).alias("capacity"), F.max(date).alias("latest"),
        F.avg(lat).alias("center_lat"), F.avg(lon).alias("center_lon"), F.min(lat).alias("south"), F.max(lat).alias("north"), F.min(lon).alias("west"), F.max(lon).alias("east"),
    )
    known = (F.col("_g") == 3) | ((F.col("_g") == 1) & F.col(area).isNotNull()) | ((F.col("_g") == 0) & F.col(area).isNotNull() & F.col(sub_area).isNotNull())
    level = F.when(F.col("_g") == 3, "total").when(F.col("_g") == 1, "area").otherwise("sub_area")
    return rolled.filter(known).withColumn("level", level).drop("_g")


def histogram_maps(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Per key the counts of a value as one string value=n, most frequent first; the map is in `counts`."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), F.col(value).alias("v"))))
    out = counted.groupBy(key).agg(ordered.alias("o"))
    return out.select(key, F.map_from_entries(F.transform("o", lambda x: F.struct(x["v"], -x["less"]))).alias("counts"), F.array_join(F.transform("o", lambda x: F.concat_ws("=", x["v"], (-x["less"]).cast("string"))), ",").alias("listed"))


def ranked_counts(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """keys, n, rank: the keys by falling number of rows, then name."""
    return running_rank(rows.groupBy(*keys).agg(F.count("*").alias("n")), [F.desc("n"), name], "rank").withColumn("rank", F.col("rank").cast("int"))


def latest_per(rows: DataFrame, keys: Sequence[str], newest: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order given."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))).filter("_n = 1").drop("_n")


def proportional_seats(groups: DataFrame, name: str, size: str, target: int) -> DataFrame:
    """Each group's seats in proportion to its size, one at least: see ranges.divided_seats."""
    return divided_seats(groups, name, size, target)


def evenly_selected(rows: DataFrame, group: str, order: Sequence[str | Column], seats: DataFrame, seats_col: str = "seats", spread: int = 6) -> DataFrame:
    """rows at evenly spread places of each group's order: of m = min(max(seats, spread), n) places, the first `seats`; all if seats >= n."""
    w = Window.partitionBy(group)
    ranked = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w)).join(seats.select(group, F.col(seats_col).alias("_seats")), group)
    m = F.least(F.greatest("_seats", F.lit(spread)), F.col("_n"))
    places = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), m.cast("long") - 1), lambda i: F.bround(i * (F.col("_n") - 1) / F.greatest(F.lit(1), m - 1)).cast("long"))))
    chosen = (F.col("_seats") >= F.col("_n")) | F.array_contains(F.slice(places, 1, F.greatest(F.col("_seats"), F.lit(1)).cast("int")), F.col("_i").cast("long"))
    return ranked.filter(chosen & (F.col("_seats") > 0)).drop("_i", "_n", "_seats")


def sample_pins(rows: DataFrame, keys: Sequence[str], pin: str, limit: int = 4) -> DataFrame:
    """Per key its first `limit` pins in order, and how many there are."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("_n", F.row_number().over(w.orderBy(pin))).withColumn("total", F.count("*").over(w)).filter(F.col("_n") <= limit)
    return ranked.groupBy(*keys, "total").agg(F.array_sort(F.collect_list(pin)).alias("pins"))


def permit_evidence(links: DataFrame, key: str, group: str, score: str, date: str, tie: str, considered: int = 40, shown: int = 3) -> DataFrame:
    """Of each permit's best `considered` links one for each meeting, and of those the first `shown`."""
    order = [F.desc(score), F.desc(date), F.col(tie)]
    first = links.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_n") <= considered).drop("_n")
    one = latest_per(first, [key, group], order)
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= shown)


def evidence_score(sub_area_hit: Column, area_hit: Column, issue_hits: Column, signal_hits: Column, admin_only: Column, related: Column) -> Column:
    """1 + 0.45 for the sub-area or 0.28 for the area + min(0.45, 0.12 issues) + min(0.35, 0.07 signals); null if unrelated."""
    fits = related & ((signal_hits > 0) | area_hit | sub_area_hit) & ~(admin_only & (issue_hits == 0) & ~area_hit & ~sub_area_hit)
    score = 1.0 + F.when(sub_area_hit, 0.45).when(area_hit, 0.28).otherwise(0.0) + F.least(F.lit(0.45), 0.12 * issue_hits) + F.least(F.lit(0.35), 0.07 * signal_hits)
    return F.when(fits, F.round(score, 4))


def pins(parts: Sequence[DataFrame]) -> DataFrame:
    """Tables of pins as one; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def with_counts(rows: DataFrame, links: DataFrame, key: str, name: str) -> DataFrame:
    """rows with the number of their links, 0 if none."""
    counted = links.groupBy(key).agg(F.count("*").alias("_n"))
    return rows.join(counted, key, "left").withColumn(name, F.coalesce("_n", F.lit(0))).drop("_n")


def json_value(c: str, path: str, default: str) -> Column:
    return F.coalesce(F.get_json_object(c, path), F.lit(default))
