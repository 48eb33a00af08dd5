"""Queries of the episode, case, permit and register operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import cases, episodes, pack, permits, places, process, registers
from tessella.plans.registry import Tables, document_index, query

# A signal is an event of a user (document), in order of its id; paragraph: its number in the user's events, stretched by the value.
SIGNALS = """numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
signals AS (SELECT user_id, event_id, ts, event_type, value, props, (n * 3 + event_id % 7)::BIGINT AS paragraph, event_id % 11 = 0 AS is_break FROM numbered),
seen AS (SELECT *, sum(is_break::INT) OVER (PARTITION BY user_id ORDER BY paragraph, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS breaks FROM signals),
lagged AS (SELECT *, paragraph - lag(paragraph) OVER w AS gap, lag(event_type) OVER w AS t0, lag(event_id % 3) OVER w AS e0, lag(event_id % 2) OVER w AS a0, lag(breaks) OVER w AS b0 FROM seen WINDOW w AS (PARTITION BY user_id ORDER BY paragraph, event_id)),
scored AS (SELECT *, CASE WHEN gap IS NULL THEN NULL WHEN gap > 5 OR breaks <> b0 THEN 0.0::DOUBLE ELSE round(0.25::DOUBLE + CASE WHEN event_id % 2 = a0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN event_type = t0 THEN 0.15::DOUBLE ELSE 0 END
 + CASE WHEN event_id % 3 = e0 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN gap <= 2 THEN 0.1::DOUBLE ELSE 0.05::DOUBLE END, 2) END AS link_score FROM lagged),
grouped AS (SELECT *, sum(CASE WHEN coalesce(link_score < 0.55, true) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY paragraph, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS episode FROM scored)"""


def signals(t: Tables) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = t.events.withColumn("paragraph", (n * 3 + F.col("event_id") % 7).cast("long")).withColumn("is_break", F.col("event_id") % 11 == 0)
    w = Window.partitionBy("user_id").orderBy("paragraph", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("breaks", F.sum(F.col("is_break").cast("int")).over(w))


def grouped(t: Tables) -> DataFrame:
    return episodes.episodes(
        signals(t), "user_id", ["paragraph", "event_id"], "paragraph", F.col("event_id") % 2, F.array("event_type"), F.array((F.col("event_id") % 3).cast("string")), breaks_upto=F.col("breaks")
    )


@query("w1_episodes", f"WITH {SIGNALS} SELECT user_id, event_id, paragraph, link_score, episode FROM grouped")
def _(t: Tables) -> DataFrame:
    return grouped(t).select("user_id", "event_id", "paragraph", "link_score", "episode")


@query("w2_hard_breaks", "SELECT user_id, event_id, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS breaks_upto FROM events")
def _(t: Tables) -> DataFrame:
    return episodes.break_counts(t.events, "user_id", "event_id", F.col("event_type") == "error").select("user_id", "event_id", "breaks_upto")


POLARITY = "CASE event_type WHEN 'error' THEN 'opposition' WHEN 'purchase' THEN 'support' ELSE 'neutral' END"


@query("w3_episode_summaries", f"""WITH {SIGNALS}, s AS (SELECT user_id, episode, min(paragraph) AS paragraph_start, max(paragraph) AS paragraph_end, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS issue_types, count(DISTINCT event_type) AS k,
 min(link_score) AS weakest_link, count(*) AS signals, bool_or(event_type = 'error') AS o, bool_or(event_type = 'purchase') AS p FROM grouped GROUP BY ALL)
SELECT user_id, episode, paragraph_start, paragraph_end, issue_types, weakest_link, signals, CASE WHEN o AND p THEN 'mixed' WHEN o THEN 'opposition' WHEN p THEN 'support' ELSE 'neutral' END AS stance,
 round(0.66::DOUBLE + 0.12::DOUBLE + CASE WHEN signals > 1 THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN k > 1 THEN 0.05::DOUBLE ELSE 0 END, 2) AS confidence FROM s""")
def _(t: Tables) -> DataFrame:
    rows = grouped(t).withColumn("polarity", F.expr(POLARITY)).withColumn("entity", (F.col("event_id") % 3).cast("string"))
    out = episodes.episode_summaries(rows, "user_id", "paragraph", "event_type", "polarity", "entity")
    return out.select("user_id", "episode", "paragraph_start", "paragraph_end", F.array_join("issue_types", ",").alias("issue_types"), "weakest_link", "signals", "stance", "confidence")


STAGES = [("sold", ("\"k\": 1", "\"k\": 2")), ("seen", ("\"k\": 3",)), ("known", ("\"k\": ",))]


@query("w3_stages_and_categories", f"""WITH {SIGNALS} SELECT user_id, episode, CASE WHEN bool_or(contains(props, '"k": 1') OR contains(props, '"k": 2')) THEN 'sold' WHEN bool_or(contains(props, '"k": 3')) THEN 'seen' WHEN bool_or(contains(props, '"k": ')) THEN 'known' END AS procedure_stage,
 concat_ws(',', CASE WHEN bool_or(event_type = 'error') THEN 'fault' END, CASE WHEN bool_or(event_type IN ('purchase', 'click')) THEN 'interest' END) AS categories FROM grouped GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    out = episodes.stages_and_categories(grouped(t), "user_id", "props", "event_type", {"error": "fault", "purchase": "interest", "click": "interest"}, STAGES)
    return out.select("user_id", "episode", "procedure_stage", F.array_join("categories", ",").alias("categories"))


@query("w4_fallback_signals", """WITH s AS (SELECT doc_id, source FROM documents WHERE contains(text, 'tion')), f AS (SELECT d.doc_id, string_split(coalesce(d.text, ''), chr(10))[1] AS line FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT doc_id FROM s))
SELECT doc_id, 'signal' AS origin FROM s UNION ALL SELECT doc_id, 'label' FROM f""")
def _(t: Tables) -> DataFrame:
    found = t.documents.filter(F.col("text").contains("tion")).select("doc_id", F.lit(0).alias("idx"))
    lines = t.documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("idx", "line")).drop("line")
    return episodes.with_fallback_signals(found, t.labels, lines, "doc_id", "idx").select("doc_id", "origin")


@query("j16_context_paragraphs", f"""WITH {SIGNALS}, r AS (SELECT user_id, episode, min(paragraph) AS lo, max(paragraph) AS hi FROM grouped GROUP BY ALL), p AS (SELECT DISTINCT user_id, paragraph FROM signals)
SELECT r.user_id, episode, p.paragraph, CASE WHEN p.paragraph BETWEEN lo AND hi THEN 'core' ELSE 'context' END AS role FROM r JOIN p ON r.user_id = p.user_id AND p.paragraph BETWEEN lo - 1 AND hi + 1""")
def _(t: Tables) -> DataFrame:
    g = grouped(t)
    ranges = g.groupBy("user_id", "episode").agg(F.min("paragraph").alias("lo"), F.max("paragraph").alias("hi"))
    return episodes.context_paragraphs(ranges, g.select("user_id", "paragraph").distinct(), "user_id", "paragraph", "lo", "hi").select("user_id", "episode", "paragraph", "role")


@query("a1_document_cases", "SELECT l_suppkey, l_partkey, count(DISTINCT l_orderkey) AS paragraph_count, count(DISTINCT l_linenumber) AS episode_count, min(l_orderkey) AS first_paragraph, max(l_orderkey) AS last_paragraph FROM lineitem GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return cases.document_cases(t.lineitem, "l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")


@query("a2_case_paragraphs", """WITH e AS (SELECT l_partkey, l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS roles, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS episodes FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey)::INT AS rank, count(*) OVER (PARTITION BY l_partkey) AS total FROM e) SELECT *, total > 10 AS truncated FROM r WHERE rank <= 10""")
def _(t: Tables) -> DataFrame:
    return cases.case_paragraphs(t.lineitem, "l_partkey", "l_orderkey", "l_returnflag", "l_linenumber", 10)


@query("a3_case_rollup", "SELECT o_custkey, min(o_orderdate) AS started_on, max(o_orderdate) AS ended_on, max(o_totalprice) AS confidence, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS issue_types, count(*) AS episodes FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return cases.case_rollup(t.orders, "o_custkey", "o_orderdate", "o_orderdate", "o_totalprice", "o_orderstatus").withColumn("issue_types", F.array_join("issue_types", ","))


@query("a4_case_counts", "SELECT o_custkey, count(DISTINCT l_orderkey) AS evidence, count(DISTINCT l_partkey) AS documents FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(t: Tables) -> DataFrame:
    rows = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    return cases.counts_per_case(rows, "o_custkey", {"evidence": "l_orderkey", "documents": "l_partkey"})


@query("a5_shared_paragraphs", "SELECT l_partkey, count(DISTINCT l_suppkey) AS cases FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def _(t: Tables) -> DataFrame:
    return cases.shared_paragraphs(t.lineitem, "l_partkey", "l_suppkey")


@query("j3_evidence_view", """SELECT l_orderkey, l_partkey, l_linenumber, o_custkey, c_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_partkey, l_linenumber)::INT AS position
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey""")
def _(t: Tables) -> DataFrame:
    e = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber", "l_returnflag")
    view = cases.evidence_view(e, t.orders.select("o_orderkey", "o_custkey"), t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_orderkey", "o_custkey", "l_returnflag", ["R", "A"])
    return view.select(F.col("o_orderkey").alias("l_orderkey"), "l_partkey", "l_linenumber", "o_custkey", "c_name", "position")


@query("j8_case_links", """WITH p AS (SELECT p_partkey AS id, p_brand || p_type AS b, p_brand, p_size, p_type, p_partkey % 10 AS k FROM part)
SELECT l.id AS "left", r.id AS "right", round(least(1.0::DOUBLE, CASE WHEN l.p_brand = r.p_brand THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN l.p_size = r.p_size THEN 0.45::DOUBLE ELSE 0 END + CASE WHEN l.k = r.k THEN 0.3::DOUBLE ELSE 0 END), 4) AS score
FROM p l JOIN p r ON l.b = r.b AND l.id < r.id WHERE round(least(1.0::DOUBLE, CASE WHEN l.p_brand = r.p_brand THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN l.p_size = r.p_size THEN 0.45::DOUBLE ELSE 0 END + CASE WHEN l.k = r.k THEN 0.3::DOUBLE ELSE 0 END), 4) BETWEEN 0.35 AND 0.7999""")
def _(t: Tables) -> DataFrame:
    rows = t.part.withColumn("block", F.concat("p_brand", "p_type"))
    return cases.weighted_pairs(rows, "p_partkey", "block", {"brand": (F.col("p_brand"), 0.20), "size": (F.col("p_size"), 0.45), "digit": (F.col("p_partkey") % 10, 0.30)}, 0.35, 0.80)


@query("w5_location_candidates", """WITH l AS (SELECT l_orderkey, l_suppkey, max(round(least(1.0::DOUBLE, CASE l_returnflag WHEN 'R' THEN 0.6::DOUBLE WHEN 'A' THEN 0.4::DOUBLE ELSE 0 END + CASE l_linestatus WHEN 'O' THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END + CASE WHEN l_suppkey % 2 = 0 THEN 0.08::DOUBLE ELSE 0 END), 4)) AS confidence FROM lineitem GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY confidence DESC, l_suppkey)::INT AS rank, row_number() OVER (PARTITION BY l_orderkey ORDER BY confidence DESC, l_suppkey) = 1 AS is_selected FROM l""")
def _(t: Tables) -> DataFrame:
    return cases.location_candidates(t.lineitem, "l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus", {"R": 0.6, "A": 0.4}, {"O": 0.3, "F": 0.1}, F.col("l_suppkey") % 2 == 0)


def reviews(t: Tables) -> DataFrame:
    k = F.col("o_custkey")
    rows = t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("subject"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("explicit"), F.count("*").alias("documents"))
    return cases.review_cases(
        rows.select(
            "o_custkey", "subject", (k % 7 == 0).cast("int").alias("precise"), (k % 2).alias("issues"), "explicit", (k % 5 == 1).cast("int").alias("harm"), (k % 3 == 0).cast("int").alias("support"),
            (k % 4 == 0).alias("opposed"), (k % 6 == 0).alias("known_place"), (k % 13 == 0).alias("suspicious"), (k % 8 == 0).alias("has_project"), (k % 9 == 0).alias("episode_key"), (k % 17 == 0).cast("int").alias("shared"), "documents",
        )
    )


REVIEWS = """r AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS subject, count(*) FILTER (o_orderpriority LIKE '1%') AS explicit, count(*) AS documents, o_custkey % 7 = 0 AS precise, o_custkey % 2 > 0 AS issues, o_custkey % 5 = 1 AS harm,
 o_custkey % 3 = 0 AS support, o_custkey % 4 = 0 AS opposed, o_custkey % 6 = 0 AS known, o_custkey % 13 = 0 AS suspicious, o_custkey % 8 = 0 AS project, o_custkey % 9 = 0 AS ek, o_custkey % 17 = 0 AS shared FROM orders GROUP BY o_custkey),
s AS (SELECT *, least(1.0::DOUBLE, CASE WHEN subject > 0 THEN 0.62::DOUBLE ELSE 0 END + CASE WHEN precise THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN issues THEN 0.08::DOUBLE ELSE 0 END) AS subject_score,
 least(1.0::DOUBLE, CASE WHEN explicit > 0 THEN 0.48::DOUBLE ELSE 0 END + CASE WHEN harm THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN opposed THEN 0.22::DOUBLE ELSE 0 END) AS dispute_score,
 CASE WHEN known THEN 0.92::DOUBLE WHEN project THEN 0.82::DOUBLE WHEN ek THEN 0.46::DOUBLE ELSE 0.35::DOUBLE END AS identity_score,
 CASE WHEN shared THEN 0.38::DOUBLE WHEN known OR project THEN 0.92::DOUBLE WHEN documents > 1 THEN 0.48::DOUBLE ELSE 0.68::DOUBLE END AS separation_score, explicit > 0 OR harm OR precise AS marked,
 support AND NOT (explicit > 0) AND NOT harm AND NOT precise AS policy, suspicious OR shared OR NOT (known OR project) AS doubts FROM r),
d AS (SELECT *, CASE WHEN subject_score = 0 OR policy THEN 'rejected' WHEN doubts THEN 'needs_review' WHEN marked THEN 'eligible' ELSE 'needs_review' END AS decision FROM s),
c AS (SELECT *, list_sort(list_filter([CASE WHEN suspicious THEN 'SUSPICIOUS_PLACE_TOKEN' END, CASE WHEN shared THEN 'SHARED_TRIGGER_PARAGRAPH' END, CASE WHEN NOT shared AND NOT (known OR project) AND documents > 1 THEN 'MULTI_DOCUMENT_WEAK_IDENTITY' END,
 CASE WHEN NOT shared AND NOT (known OR project) AND documents <= 1 THEN 'EPISODE_SCOPED_IDENTITY' END, CASE WHEN subject_score = 0 THEN 'NO_EXACT_SUBJECT_TRIGGER' END, CASE WHEN subject_score > 0 AND policy THEN 'POLICY_OR_SUPPORT_RECORD' END,
 CASE WHEN NOT marked AND decision <> 'rejected' THEN 'NO_EXPLICIT_DISPUTE_MARKER' END], lambda x: x IS NOT NULL)) AS codes FROM d)"""


@query("g8_case_reviews", f"WITH {REVIEWS} SELECT o_custkey, decision, round(0.38::DOUBLE * subject_score + 0.34::DOUBLE * dispute_score + 0.16::DOUBLE * identity_score + 0.12::DOUBLE * separation_score, 4) AS quality_score, array_to_string(codes, ',') AS reason_codes FROM c")
def _(t: Tables) -> DataFrame:
    return reviews(t).select("o_custkey", "decision", "quality_score", F.array_join("reason_codes", ",").alias("reason_codes"))


@query("g9_review_tasks", f"WITH {REVIEWS}, x AS (SELECT o_custkey, unnest(codes) AS reason_code FROM c) SELECT *, CASE WHEN reason_code = 'SHARED_TRIGGER_PARAGRAPH' THEN 'high' ELSE 'normal' END AS priority FROM x")
def _(t: Tables) -> DataFrame:
    return cases.review_tasks(reviews(t), "o_custkey", ["SHARED_TRIGGER_PARAGRAPH"])


@query("w13_timeline", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END ASC NULLS FIRST, o_orderkey)::INT AS position FROM orders")
def _(t: Tables) -> DataFrame:
    return process.timeline(t.orders.withColumn("day", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderdate"))), "o_custkey", "day", "o_orderkey").select("o_custkey", "o_orderkey", "position")


@query("a24_last_events", "SELECT user_id, count(*) AS events, arg_max(event_type, (ts, event_id)) AS last_outcome, count(*) FILTER (event_type IN ('error', 'view')) AS unresolved FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return process.last_events(t.events, "user_id", "ts", "event_id", "event_type", ["error", "view"])


@query("j2_place_links", "SELECT l.doc_id, d.source, d.lang, l.quality FROM labels l JOIN documents d USING (doc_id) WHERE CASE WHEN l.toxic = 1 THEN 'rejected' ELSE 'pending' END <> 'rejected'")
def _(t: Tables) -> DataFrame:
    links = t.labels.withColumn("review_status", F.when(F.col("toxic") == 1, "rejected").otherwise("pending"))
    return places.links_with_places(links, t.documents, "doc_id").select("doc_id", "source", "lang", "quality")


@query("p5_rejected_excluded", "SELECT doc_id, quality FROM labels WHERE toxic <> 1")
def _(t: Tables) -> DataFrame:
    links = t.labels.withColumn("review_status", F.when(F.col("toxic") == 1, "rejected").otherwise("pending"))
    return places.links_with_places(links, t.documents.select("doc_id"), "doc_id").select("doc_id", "quality")


@query("j5_admin_levels", """WITH c AS (SELECT c_custkey, n_nationkey AS nation, n_regionkey AS region FROM customer JOIN nation ON n_nationkey = c_nationkey), s AS (SELECT s_suppkey, n_nationkey AS nation, n_regionkey AS region FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT c_custkey, s_suppkey, CASE WHEN c.nation = s.nation THEN 'same_ri' ELSE 'same_admin_area' END AS "group", CASE WHEN c.nation = s.nation THEN 3 ELSE 2 END AS rank FROM c JOIN s ON c.region = s.region""")
def _(t: Tables) -> DataFrame:
    nation = t.nation.select("n_nationkey", "n_regionkey")
    c = t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    s = t.supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    return places.match_by_level(c, s, "c_custkey", "s_suppkey", [("nation", "same_ri", 3), ("region", "same_admin_area", 2)], ["region"])


@query("j11_region_fallback", "SELECT c_custkey, coalesce(a.n_name, b.n_name) AS region_name FROM customer LEFT JOIN nation a ON a.n_nationkey = CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END LEFT JOIN nation b ON b.n_nationkey = c_custkey % 30")
def _(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).cast("long").alias("assembly"), (F.col("c_custkey") % 30).alias("city"))
    return places.resolve_region(rows, t.nation.select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("value")), ["assembly", "city"], "region_name").select("c_custkey", "region_name")


@query("s7_region_aliases", """WITH h AS (SELECT p_partkey, p_name, r_regionkey, row_number() OVER (PARTITION BY p_partkey, p_name ORDER BY length(r_name) DESC, r_regionkey) AS k FROM part LEFT JOIN region ON contains(p_name, lower(substr(r_name, 1, 1)))) SELECT p_partkey, p_name, r_regionkey AS region_code FROM h WHERE k = 1""")
def _(t: Tables) -> DataFrame:
    aliases = t.region.select(F.lower(F.substring("r_name", 1, 1)).alias("alias"), F.length("r_name").alias("specificity"), F.col("r_regionkey").alias("region_code"))
    return places.regions_by_alias(t.part.select("p_partkey", "p_name"), "p_name", aliases)


COORDS = "33 + ({k} * 7919 % 60000) / 10000.0::DOUBLE AS lat, 125 + ({k} * 104729 % 60000) / 10000.0::DOUBLE AS lon"
HAVERSINE = "2 * 6371000 * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


def located(df: DataFrame, key: str) -> DataFrame:
    k = F.col(key)
    return df.withColumn("lat", 33 + (k * 7919 % 60000) / 10000.0).withColumn("lon", 125 + (k * 104729 % 60000) / 10000.0)


@query("j4_radius_join", f"""WITH c AS (SELECT c_custkey, {COORDS.format(k='c_custkey')} FROM customer), s AS (SELECT s_suppkey, {COORDS.format(k='s_suppkey')} FROM supplier)
SELECT c_custkey, s_suppkey, round({HAVERSINE}, 3) AS distance_m FROM c a, s b WHERE {HAVERSINE} <= 20000""")
def _(t: Tables) -> DataFrame:
    pairs = permits.radius_join(located(t.customer, "c_custkey"), located(t.supplier, "s_suppkey"), 20_000)
    return pairs.select("c_custkey", F.col("r_s_suppkey").alias("s_suppkey"), F.round("distance_m", 3).alias("distance_m"))


@query("j6_nearby_permits", f"""WITH c AS (SELECT c_custkey, c_nationkey AS area, CASE WHEN c_custkey % 3 > 0 THEN lat END AS lat, CASE WHEN c_custkey % 3 > 0 THEN lon END AS lon FROM (SELECT *, {COORDS.format(k='c_custkey')} FROM customer)),
s AS (SELECT s_suppkey, s_nationkey AS area, {COORDS.format(k='s_suppkey')} FROM supplier)
SELECT c_custkey, s_suppkey, round({HAVERSINE}, 3) AS distance_m, 'measured' AS distance_status FROM c a, s b WHERE {HAVERSINE} <= 15000
UNION ALL SELECT c_custkey, s_suppkey, NULL, 'unknown' FROM c a JOIN s b ON a.area = b.area WHERE a.lat IS NULL""")
def _(t: Tables) -> DataFrame:
    known = F.col("c_custkey") % 3 > 0
    sites = located(t.customer, "c_custkey").select("c_custkey", F.col("c_nationkey").alias("area"), F.when(known, F.col("lat")).alias("lat"), F.when(known, F.col("lon")).alias("lon"))
    near = permits.nearby_or_same_area(sites, located(t.supplier, "s_suppkey").withColumnRenamed("s_nationkey", "area"), "c_custkey", "s_suppkey", "area", 15_000)
    return near.withColumn("distance_m", F.round("distance_m", 3))


@query("j7_area_links", """WITH p AS (SELECT c_custkey, lower(n_name[1:3]) AS area, lower(c_mktsegment[1:3]) AS sub FROM customer JOIN nation ON n_nationkey = c_nationkey), a AS (SELECT DISTINCT area, sub FROM p),
s AS (SELECT doc_id, text, doc_id % 7 AS issues, doc_id % 90 AS day FROM documents WHERE (contains(text, 'en') OR contains(text, 'th')) AND contains(text, 'e') AND NOT coalesce(starts_with(text, 'Copyright'), false)),
x AS (SELECT area, sub, doc_id, day, CASE WHEN contains(text, sub) THEN 'same_sub_area' WHEN contains(text, area) THEN 'same_area' ELSE 'general' END AS relation, issues FROM a, s),
y AS (SELECT *, round(CASE relation WHEN 'same_sub_area' THEN 1.0::DOUBLE WHEN 'same_area' THEN 0.86::DOUBLE ELSE 0.62::DOUBLE END + least(0.08::DOUBLE, 0.02::DOUBLE * issues), 4) AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY area, sub ORDER BY score DESC, day, doc_id)::INT AS rank FROM y) SELECT c_custkey, doc_id, relation, score, rank FROM p JOIN z USING (area, sub) WHERE rank <= 12""")
def _(t: Tables) -> DataFrame:
    three = lambda c: F.lower(F.substring(c, 1, 3))
    p = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", three("n_name").alias("area"), three("c_mktsegment").alias("sub"))
    s = t.documents.withColumn("issues", F.col("doc_id") % 7).withColumn("day", F.col("doc_id") % 90)
    text = F.col("text")
    related = (text.contains("en") | text.contains("th")) & text.contains("e")
    return permits.link_by_area(p, s, "c_custkey", "area", "sub", "doc_id", "text", "day", "issues", related=related, admin_only=text.startswith("Copyright"), index=document_index(t))


@query("a6_permit_summary", """SELECT o_custkey, count(*) AS permits, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total_capacity, count(*) FILTER (contains(o_orderpriority, 'M') AND NOT contains(o_orderpriority, 'LOW')) AS operating,
 round(count(*) FILTER (contains(o_orderpriority, 'M') AND NOT contains(o_orderpriority, 'LOW')) / count(*), 4) AS operating_rate, CASE WHEN min(o_orderstatus) = max(o_orderstatus) THEN min(o_orderstatus) ELSE 'mixed' END AS data_origin FROM orders GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    out = permits.permit_summary(t.orders, "o_custkey", F.col("o_totalprice").cast("decimal(18,2)"), "o_orderpriority", ["M"], ["LOW"], "o_orderstatus")
    return out.withColumn("total_capacity", F.col("total_capacity").cast("double"))


@query("a7_percentiles", """WITH r AS (SELECT p_brand, p_type, p_retailprice / p_size AS ratio FROM part WHERE p_retailprice / p_size BETWEEN 2 AND 600), s AS (SELECT 'p_brand' AS scope, p_brand AS value, ratio FROM r UNION ALL SELECT 'p_type', p_type, ratio FROM r UNION ALL SELECT 'all', '', ratio FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY scope, value ORDER BY ratio) AS k, count(*) OVER (PARTITION BY scope, value) AS sample_size FROM s)
SELECT scope, value, sample_size, min(ratio) FILTER (k = round_even(0.1::DOUBLE * (sample_size - 1), 0) + 1) AS p10, min(ratio) FILTER (k = round_even(0.5::DOUBLE * (sample_size - 1), 0) + 1) AS median, min(ratio) FILTER (k = round_even(0.9::DOUBLE * (sample_size - 1), 0) + 1) AS p90 FROM n WHERE sample_size >= 30 GROUP BY 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    return permits.percentiles_by_scope(t.part, F.col("p_retailprice") / F.col("p_size"), ["p_brand", "p_type"], {"p10": 0.1, "median": 0.5, "p90": 0.9}, 2, 600, 30)


@query("a7_benchmark_for", """WITH r AS (SELECT p_brand, p_type, p_retailprice / p_size AS ratio FROM part WHERE p_retailprice / p_size BETWEEN 2 AND 600), s AS (SELECT 'p_type' AS scope, p_type AS value, ratio FROM r UNION ALL SELECT 'p_brand', p_brand, ratio FROM r UNION ALL SELECT 'all', '', ratio FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY scope, value ORDER BY ratio) AS k, count(*) OVER (PARTITION BY scope, value) AS sample_size FROM s),
b AS (SELECT scope, value, sample_size, min(ratio) FILTER (k = round_even(0.5::DOUBLE * (sample_size - 1), 0) + 1) AS median FROM n WHERE sample_size >= 50 GROUP BY 1, 2, 3)
SELECT p_partkey, coalesce(x.scope, y.scope, z.scope) AS scope, coalesce(x.sample_size, y.sample_size, z.sample_size) AS sample_size, coalesce(x.median, y.median, z.median) AS median
FROM part LEFT JOIN b x ON x.scope = 'p_type' AND x.value = p_type LEFT JOIN b y ON y.scope = 'p_brand' AND y.value = p_brand LEFT JOIN b z ON z.scope = 'all'""")
def _(t: Tables) -> DataFrame:
    found = permits.percentiles_by_scope(t.part, F.col("p_retailprice") / F.col("p_size"), ["p_type", "p_brand"], {"median": 0.5}, 2, 600, 50)
    return permits.benchmark_for(t.part, found, ["p_type", "p_brand"]).select("p_partkey", "scope", "sample_size", "median")


@query("a8_area_rollup", """SELECT CASE grouping(c_mktsegment) + 2 * grouping(c_nationkey) WHEN 3 THEN 'total' WHEN 1 THEN 'area' ELSE 'sub_area' END AS level, c_nationkey, c_mktsegment, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS "n_O", count(*) FILTER (o_orderstatus = 'F') AS "n_F",
 sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS capacity, max(o_orderdate) AS latest FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ROLLUP (c_nationkey, c_mktsegment)""")
def _(t: Tables) -> DataFrame:
    rows = located(t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")), "c_custkey")
    out = permits.area_rollup(rows, "c_nationkey", "c_mktsegment", "o_orderstatus", ["O", "F"], F.col("o_totalprice").cast("decimal(18,2)"), "o_orderdate")
    return out.select("level", "c_nationkey", "c_mktsegment", "total", "n_O", "n_F", F.col("capacity").cast("double").alias("capacity"), "latest")


@query("a9_histograms", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY n DESC, event_type) AS listed FROM c GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return permits.histogram_maps(t.events, "user_id", "event_type").select("user_id", "listed")


@query("w6_ranked_counts", "SELECT c_nationkey, c_mktsegment, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c_nationkey || c_mktsegment)::INT AS rank FROM customer GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    rows = t.customer.withColumn("name", F.concat(F.col("c_nationkey").cast("string"), "c_mktsegment"))
    return permits.ranked_counts(rows, ["c_nationkey", "c_mktsegment", "name"], "name").drop("name")


@query("w7_latest_per_address", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) SELECT o_custkey, o_orderpriority, o_orderkey, o_orderdate FROM r WHERE k = 1")
def _(t: Tables) -> DataFrame:
    return permits.latest_per(t.orders, ["o_custkey", "o_orderpriority"], [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderdate")


SEATS = """g AS (SELECT n_name AS name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1), q AS (SELECT name, n, unnest(range(2, least(n, 180) + 1)) AS k FROM g),
b AS (SELECT name, row_number() OVER (ORDER BY n / k DESC, n - k + 1 DESC, name DESC) AS r FROM q), w AS (SELECT name, count(*) AS won FROM b WHERE r <= (SELECT least(180, sum(n)) - count(*) FROM g) GROUP BY 1),
seats AS (SELECT name, n, 1 + coalesce(won, 0) AS seats FROM g LEFT JOIN w USING (name))"""


def seat_groups(t: Tables) -> DataFrame:
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumnRenamed("n_name", "name")


@query("w8_proportional_seats", f"WITH {SEATS} SELECT name, n, seats FROM seats")
def _(t: Tables) -> DataFrame:
    return permits.proportional_seats(seat_groups(t).groupBy("name").agg(F.count("*").alias("n")), "name", "n", 180)


@query("w9_even_sample", f"""WITH {SEATS}, r AS (SELECT name, c_custkey, row_number() OVER (PARTITION BY name ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY name) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN (SELECT name AS n_name, name FROM g) USING (n_name)),
m AS (SELECT name, n, seats, least(greatest(seats, 6), n) AS m FROM seats), p AS (SELECT name, seats, list_sort(list_distinct(list_transform(range(0, m), lambda j: round_even(j * (n - 1) / greatest(1, m - 1), 0)::BIGINT)))[1:seats] AS places FROM m)
SELECT r.name, c_custkey FROM r JOIN p USING (name) WHERE p.seats >= r.n OR list_contains(places, i)""")
def _(t: Tables) -> DataFrame:
    rows = seat_groups(t)
    seats = permits.proportional_seats(rows.groupBy("name").agg(F.count("*").alias("n")), "name", "n", 180)
    return permits.evenly_selected(rows, "name", ["c_custkey"], seats).select("name", "c_custkey")


@query("w16_sample_pins", "WITH r AS (SELECT c_nationkey, c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS k, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS total FROM customer) SELECT c_nationkey, c_mktsegment, total, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS pins FROM r WHERE k <= 4 GROUP BY 1, 2, 3")
def _(t: Tables) -> DataFrame:
    out = permits.sample_pins(t.customer, ["c_nationkey", "c_mktsegment"], "c_custkey")
    return out.withColumn("pins", F.array_join(F.transform("pins", lambda x: x.cast("string")), ","))


@query("o2_nearest_first", "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 100 END IS NULL, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 100 END, o_orderdate DESC, o_orderkey)::INT AS rank FROM orders) SELECT * FROM r WHERE rank <= 30")
def _(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("distance", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 100))
    return permits.nearest_first(rows, "o_custkey", "distance", "o_orderdate", "o_orderkey", 30).select("o_custkey", "o_orderkey", "rank")


@query("o3_permit_evidence", """WITH a AS (SELECT l_suppkey, l_returnflag, l_shipdate, l_orderkey * 10 + l_linenumber AS k, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_shipdate DESC, l_orderkey * 10 + l_linenumber) AS n FROM lineitem),
b AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY n) AS m FROM a WHERE n <= 40), c AS (SELECT l_suppkey, l_returnflag, k, row_number() OVER (PARTITION BY l_suppkey ORDER BY n)::INT AS rank FROM b WHERE m = 1) SELECT * FROM c WHERE rank <= 3""")
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return permits.permit_evidence(rows, "l_suppkey", "l_returnflag", "l_quantity", "l_shipdate", "k").select("l_suppkey", "l_returnflag", "k", "rank")


@query("r3_evidence_score", """SELECT doc_id, round(1.0::DOUBLE + CASE WHEN contains(text, 'tion') THEN 0.45::DOUBLE WHEN contains(text, 'keit') THEN 0.28::DOUBLE ELSE 0 END + least(0.45::DOUBLE, 0.12::DOUBLE * (doc_id % 5)) + least(0.35::DOUBLE, 0.07::DOUBLE * (doc_id % 9)), 4) AS score FROM documents
WHERE contains(text, 'the') AND (doc_id % 9 > 0 OR contains(text, 'tion') OR contains(text, 'keit'))""")
def _(t: Tables) -> DataFrame:
    k, c = F.col("doc_id"), F.col("text")
    return t.documents.select("doc_id", permits.evidence_score(c.contains("tion"), c.contains("keit"), k % 5, k % 9, F.lit(False), c.contains("the")).alias("score")).filter("score IS NOT NULL")


@query("o6_pins", "SELECT c_custkey AS id, c_name AS name, NULL::DOUBLE AS capacity, 'complaint' AS kind FROM customer UNION ALL SELECT o_orderkey, NULL, o_totalprice, 'permit' FROM orders")
def _(t: Tables) -> DataFrame:
    return permits.pins([t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("complaint").alias("kind")), t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("capacity"), F.lit("permit").alias("kind"))])


@query("j14_link_counts", "SELECT c_custkey, count(o_orderkey) AS meetings FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return permits.with_counts(t.customer.select("c_custkey"), t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "meetings")


@query("p9_json_values", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '0') AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS m FROM events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", permits.json_value("props", "$.k", "0").alias("k"), permits.json_value("props", "$.missing", "none").alias("m"))


@query("a10_limits", "SELECT count(DISTINCT p_brand) AS groups, count(p_retailprice) AS known, count(*) FILTER (p_retailprice > 1500) AS over_cap, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) FILTER (p_retailprice > 1500) AS over_cap_groups FROM part")
def _(t: Tables) -> DataFrame:
    return registers.limits_comparison(t.part, "p_brand", "p_retailprice", 1500).withColumn("over_cap_groups", F.when(F.col("over_cap_groups") != "", F.col("over_cap_groups")))


@query("a11_area_signal", "SELECT n_nationkey, count(c_custkey) AS n, CASE WHEN count(c_custkey) >= 65 THEN 'high' WHEN count(c_custkey) >= 55 THEN 'medium' ELSE 'low' END AS signal FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return registers.signal_by_area(t.nation.select("n_nationkey"), t.customer.withColumnRenamed("c_nationkey", "n_nationkey"), "n_nationkey", {"low": 0, "medium": 55, "high": 65})


@query("a14_register_quality", "SELECT count(*) AS total, count(*) FILTER (o_custkey % 3 > 0) AS coord_valid, count(*) FILTER (o_orderdate IS NULL) AS missing_dates, count(*) FILTER (o_totalprice > 0 AND o_totalprice <= 200000) AS ok, count(*) FILTER (o_totalprice > 200000) AS outlier, min(o_orderdate) AS first_snapshot, max(o_orderdate) AS last_snapshot, count(DISTINCT o_orderdate) AS snapshots FROM orders")
def _(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("flag", registers.value_flag(F.col("o_totalprice").cast("string"), 200000))
    return registers.quality_summary(rows, "flag", "o_orderdate", F.col("o_custkey") % 3 > 0, "o_orderdate")


CANDIDATES = "cand AS (SELECT p_brand, p_size, string_agg(DISTINCT p_type, '; ' ORDER BY p_type) AS candidates, count(DISTINCT p_type) AS candidate_count FROM part GROUP BY 1, 2)"


@query("a15_candidates", f"WITH {CANDIDATES} SELECT * FROM cand")
def _(t: Tables) -> DataFrame:
    return registers.candidates_by_area(t.part, ["p_brand", "p_size"], "p_type")


@query("j12_register_candidates", f"WITH {CANDIDATES} SELECT p_partkey, candidates, coalesce(candidate_count, 0) AS candidate_count FROM part LEFT JOIN cand USING (p_brand, p_size)")
def _(t: Tables) -> DataFrame:
    cand = registers.candidates_by_area(t.part, ["p_brand", "p_size"], "p_type")
    return registers.with_candidates(t.part, cand, ["p_brand", "p_size"]).select("p_partkey", "candidates", "candidate_count")


@query("v9_mapping_status", f"WITH {CANDIDATES} SELECT p_partkey, CASE coalesce(candidate_count, 0) WHEN 0 THEN 'none' WHEN 1 THEN 'single' ELSE 'multiple' END AS mapping_status FROM part LEFT JOIN cand USING (p_brand, p_size)")
def _(t: Tables) -> DataFrame:
    cand = registers.candidates_by_area(t.part, ["p_brand", "p_size"], "p_type")
    return registers.with_candidates(t.part, cand, ["p_brand", "p_size"]).select("p_partkey", "mapping_status")


@query("a16_capacity_verdict", """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, CASE WHEN l_partkey % 7 > 0 THEN l_extendedprice / 1000 END AS b, l_tax * 100 AS c FROM lineitem), m AS (SELECT *, CASE WHEN b IS NOT NULL THEN least(a, b, c) END AS bottleneck FROM r)
SELECT l_orderkey, l_linenumber, bottleneck, b IS NOT NULL AS complete, CASE WHEN b IS NULL THEN 'unknown' WHEN bottleneck <= 0 THEN 'blocked' WHEN bottleneck < 5 THEN 'tight' ELSE 'available' END AS verdict FROM m""")
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), F.when(F.col("l_partkey") % 7 > 0, F.col("l_extendedprice") / 1000).alias("b"), (F.col("l_tax") * 100).alias("c"))
    return rows.select("l_orderkey", "l_linenumber", *(v.alias(k) for k, v in registers.capacity_verdict(["a", "b", "c"], 5).items()))


@query("a17_duplicate_metrics", "WITH r AS (SELECT l_orderkey % 1000 AS k, l_returnflag AS f FROM lineitem) SELECT count(*) AS total, count(DISTINCT k) AS distinct_keys, count(*) - count(DISTINCT k) AS duplicate_keys, count(*) - count(DISTINCT (k, f)) AS duplicate_rows FROM r")
def _(t: Tables) -> DataFrame:
    out = registers.duplicate_metrics(t.lineitem.select((F.col("l_orderkey") % 1000).alias("k"), F.col("l_returnflag").alias("f")), ["k"])
    return out.select("total", "distinct_keys", F.col("duplicate_keys"), "duplicate_rows")


@query("a18_first_per_key", "SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus, arg_min(CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END, o_orderkey) FILTER (o_orderkey % 3 > 0) AS p, count(*) AS rows, count(DISTINCT o_orderstatus) > 1 OR count(DISTINCT CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END) > 1 AS conflict FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("p", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")))
    return registers.first_per_key(rows, ["o_custkey"], ["o_orderstatus", "p"], "o_orderkey")


@query("a19_ambiguous_names", "SELECT p_type, count(DISTINCT p_brand) AS keys, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def _(t: Tables) -> DataFrame:
    return registers.ambiguous_names(t.part, "p_type", "p_brand", "p_retailprice")


@query("a20_area_summary", "SELECT count(*) AS total, sum(p_retailprice::DECIMAL(18,2))::DOUBLE AS capacity, count(*) FILTER (p_partkey % 3 > 0) AS coord_valid, string_agg(DISTINCT p_type, '; ' ORDER BY p_type) AS candidates FROM part")
def _(t: Tables) -> DataFrame:
    out = registers.area_summary(t.part, F.col("p_retailprice").cast("decimal(18,2)"), F.col("p_partkey") % 3 > 0, "p_type")
    return out.withColumn("capacity", F.col("capacity").cast("double"))


@query("v5_value_flags", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'parse_error' WHEN o_totalprice <= 0 THEN 'non_positive' WHEN o_totalprice > 200000 THEN 'outlier' ELSE 'ok' END AS flag FROM orders")
def _(t: Tables) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 9 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    return t.orders.select("o_orderkey", registers.value_flag(raw, 200000).alias("flag"))


@query("v6_region_parse", "WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN 'oldland city' || (c_custkey % 9) || ' x' ELSE '' END AS address, 'newland town' AS f FROM customer) SELECT c_custkey, 'newland' AS province, CASE WHEN address <> '' THEN string_split(address, ' ')[2] ELSE 'town' END AS city, CASE WHEN address <> '' THEN 'address' ELSE 'fallback' END AS origin FROM a")
def _(t: Tables) -> DataFrame:
    address = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("oldland city"), (F.col("c_custkey") % 9).cast("string"), F.lit(" x"))).otherwise("")
    return t.customer.select("c_custkey", registers.region_of(address, F.lit("newland town"), {"oldland": "newland"}).alias("r")).select("c_custkey", "r.*")


@query("o8_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def _(t: Tables) -> DataFrame:
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()


@query("r7_location_context", """WITH a AS (SELECT c_nationkey AS area, c_mktsegment AS name, count(*) AS score FROM customer GROUP BY 1, 2), t AS (SELECT s_suppkey, s_nationkey AS mine FROM supplier),
own AS (SELECT s_suppkey, area, name, score, true AS is_own FROM t JOIN a ON area = mine),
rest AS (SELECT s_suppkey, area, name, score, false AS is_own FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, name, area) AS n FROM t JOIN a ON area <> mine) WHERE n <= 3),
k AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY is_own DESC, score DESC, name, area)::INT AS rank FROM (SELECT * FROM own UNION ALL SELECT * FROM rest)) SELECT * FROM k WHERE rank <= 8""")
def _(t: Tables) -> DataFrame:
    rows = t.customer.groupBy(F.col("c_nationkey").alias("area"), F.col("c_mktsegment").alias("name")).agg(F.count("*").alias("score"))
    return pack.location_context(rows, t.supplier.select("s_suppkey", F.col("s_nationkey").alias("area")), "s_suppkey", "area", "score", "name")
