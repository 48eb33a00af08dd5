"""Queries of the rule, intake, search, pack, audit, source, table and streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import audit, intake, pack, rules, search
from tessella.operators.ranges import dealt_join
from tessella.plans.registry import Tables, document_index, query
from tessella.sources import readers, tables
from tessella.sources.scratch import scratch_folder
from tessella.streaming import jobs

RULES = [
    ("r1", 1, "size", "gte", 10.0, "threshold", "2020-01-01", None, True), ("r2", None, "price", "lte", 1500.0, "threshold", None, None, True), ("r3", 2, "size", "gt", 25.0, "threshold", None, "2021-01-01", True),
    ("r4", None, "size", "", 30.0, "cap", "2030-01-01", None, True), ("r5", 3, "price", "", None, "prohibited", "2030-01-01", None, True), ("r6", None, "price", "exists", None, "threshold", None, None, False), ("r7", 0, "weight", "eq", 1.0, "threshold", None, None, True),
]
RULE_ROWS = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() for v in r) + ")" for r in RULES)
APPLIED = f"""rules(rule_id, region_code, reference_object, operator, threshold_value, rule_kind, valid_from, valid_to, active) AS (VALUES {RULE_ROWS}),
req AS (SELECT p_partkey, p_partkey % 5 AS region, CASE WHEN p_partkey % 7 > 0 THEN p_size END AS size, p_retailprice AS price FROM part),
applied AS (SELECT q.*, r.*, r.region_code IS NOT NULL AS is_local, r.valid_from IS NULL OR r.valid_from::DATE <= DATE '2024-06-01' AS effective, CASE reference_object WHEN 'size' THEN size::DOUBLE WHEN 'price' THEN price END AS observed
 FROM req q JOIN rules r ON (r.region_code IS NULL OR r.region_code = q.region) AND r.active AND (r.valid_to IS NULL OR r.valid_to::DATE >= DATE '2024-06-01')),
checks AS (SELECT *, CASE WHEN rule_kind = 'cap' THEN CASE WHEN observed >= threshold_value THEN 'pass' ELSE 'check_required' END WHEN rule_kind = 'prohibited' THEN CASE WHEN effective THEN 'pass' ELSE 'check_required' END
 WHEN operator = 'exists' THEN CASE WHEN observed IS NOT NULL THEN 'pass' ELSE 'fail' END WHEN observed IS NULL OR threshold_value IS NULL THEN 'check_required'
 WHEN CASE operator WHEN 'gte' THEN observed >= threshold_value WHEN 'gt' THEN observed > threshold_value WHEN 'lte' THEN observed <= threshold_value WHEN 'lt' THEN observed < threshold_value ELSE observed = threshold_value END THEN 'pass' ELSE 'fail' END AS status FROM applied)"""


def requests(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t.part.select("p_partkey", (k % 5).alias("region"), F.when(k % 7 > 0, F.col("p_size")).alias("size"), F.col("p_retailprice").alias("price"), F.to_date(F.lit("2024-06-01")).alias("as_of"))


def applied(t: Tables) -> DataFrame:
    schema = "rule_id string, region_code long, reference_object string, operator string, threshold_value double, rule_kind string, valid_from string, valid_to string, active boolean"
    r = t.spark.createDataFrame(RULES, schema).withColumns({"valid_from": F.to_date("valid_from"), "valid_to": F.to_date("valid_to")})
    return rules.applicable_rules(requests(t), r, "region", "as_of")


def checks(t: Tables) -> DataFrame:
    return rules.evaluate(applied(t), {"size": "size", "price": "price"})


@query("g1_applicable_rules", f"WITH {APPLIED} SELECT p_partkey, rule_id, is_local, effective FROM applied")
def _(t: Tables) -> DataFrame:
    return applied(t).select("p_partkey", "rule_id", "is_local", "effective")


@query("g2_rule_checks", f"WITH {APPLIED} SELECT p_partkey, rule_id, observed AS observed_value, status FROM checks WHERE rule_kind = 'threshold'")
def _(t: Tables) -> DataFrame:
    return checks(t).filter("rule_kind = 'threshold'").select("p_partkey", "rule_id", "observed_value", "status")


@query("g3_caps_and_prohibitions", f"WITH {APPLIED} SELECT p_partkey, rule_id, status, effective FROM checks WHERE rule_kind <> 'threshold'")
def _(t: Tables) -> DataFrame:
    return checks(t).filter("rule_kind <> 'threshold'").select("p_partkey", "rule_id", "status", "effective")


@query("g4_ratio_checks", """WITH r AS (SELECT p_partkey, p_retailprice / p_size AS ratio, 20.0::DOUBLE + p_partkey % 3 AS p10, 200.0::DOUBLE AS p90 FROM part)
SELECT p_partkey, round(ratio, 4) AS observed_value, 'plausible_range' AS "check", CASE WHEN ratio BETWEEN 10 AND 300 THEN 'pass' ELSE 'fail' END AS status FROM r UNION ALL SELECT p_partkey, round(ratio, 4), 'benchmark', CASE WHEN ratio >= p10 AND ratio <= p90 THEN 'pass' ELSE 'fail' END FROM r""")
def _(t: Tables) -> DataFrame:
    rows = t.part.withColumn("p10", 20.0 + F.col("p_partkey") % 3).withColumn("p90", F.lit(200.0))
    return rules.ratio_checks(rows, "p_partkey", F.col("p_retailprice") / F.col("p_size"), 10, 300, "p10", "p90")


@query("g4_area_checks", """WITH r AS (SELECT l_orderkey * 8 + l_linenumber AS line_id, CASE WHEN l_partkey % 9 > 0 THEN l_quantity::DOUBLE END AS site, CASE WHEN l_suppkey % 4 > 0 THEN l_extendedprice::DOUBLE / 1500 END AS installed FROM lineitem)
SELECT line_id, 'area_relation' AS "check", installed AS observed_value, CASE WHEN installed <= site THEN 'pass' ELSE 'fail' END AS status FROM r WHERE site IS NOT NULL AND installed IS NOT NULL
UNION ALL SELECT line_id, 'site_area_required', NULL, 'check_required' FROM r WHERE site IS NULL UNION ALL SELECT line_id, 'site_coverage', round(installed / site, 3), CASE WHEN installed / site <= 1 THEN 'pass' ELSE 'fail' END FROM r WHERE site <> 0 AND installed <> 0""")
def _(t: Tables) -> DataFrame:
    site, installed = F.when(F.col("l_partkey") % 9 > 0, F.col("l_quantity").cast("double")), F.when(F.col("l_suppkey") % 4 > 0, F.col("l_extendedprice").cast("double") / 1500)
    rows = t.lineitem.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_id"), site.alias("site"), installed.alias("installed"))
    return rules.area_checks(rows, "line_id", "site", "installed")


@query("g5_layer_checks", """WITH n AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag || l_linestatus, ',') AS names FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey, names FROM orders LEFT JOIN n ON l_orderkey = o_orderkey)
SELECT o_orderkey, c AS "check", CASE WHEN names IS NULL THEN 'check_required' WHEN c = 'farmland' AND regexp_matches(names, '(^|,)R') THEN 'fail' WHEN c = 'forest' AND regexp_matches(names, '(AF|NO)') THEN 'fail' ELSE 'pass' END AS status FROM o, (VALUES ('farmland'), ('forest')) v(c)""")
def _(t: Tables) -> DataFrame:
    names = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("names"))
    return rules.layer_checks(t.orders.select("o_orderkey").join(names, "o_orderkey", "left"), "o_orderkey", "names", {"farmland": ["^R"], "forest": ["AF", "NO"]})


@query("g6_missing_checks", f"WITH {APPLIED}, m AS (SELECT p_partkey, 'local_rule' AS missing FROM req WHERE p_partkey NOT IN (SELECT p_partkey FROM applied WHERE is_local) UNION ALL SELECT p_partkey, 'site_size' FROM req WHERE size IS NULL) SELECT p_partkey, missing, 'check_required' AS status FROM m")
def _(t: Tables) -> DataFrame:
    return rules.missing_checks(requests(t), applied(t), "p_partkey", {"size": "site_size", "price": "site_price"})


@query("g6_status_counts", f"WITH {APPLIED} SELECT p_partkey, count(*) FILTER (status = 'fail') AS failed, count(*) FILTER (status = 'check_required') AS unknown, count(*) AS checks FROM checks GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return rules.status_counts(checks(t), "p_partkey")


@query("g7_rules_from_snapshot", """SELECT l_orderkey, l_linenumber, 'l_tax' AS reference_object, l_tax AS threshold_value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem""")
def _(t: Tables) -> DataFrame:
    return rules.rules_from_wide(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_tax", "l_discount"])


RAW = "raw AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '1,500 kW' WHEN 1 THEN '2 MW' WHEN 2 THEN 'many' ELSE '' END AS capacity, CASE o_orderkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN '아니오' WHEN 2 THEN 'maybe' END AS consent, strftime(o_orderdate, '%Y.%m.%d') AS applied, o_orderpriority AS note FROM orders)"


def raw(t: Tables) -> DataFrame:
    return t.orders.selectExpr(
        "o_orderkey", "CASE o_orderkey % 4 WHEN 0 THEN '1,500 kW' WHEN 1 THEN '2 MW' WHEN 2 THEN 'many' ELSE '' END AS capacity", "CASE o_orderkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN '아니오' WHEN 2 THEN 'maybe' END AS consent",
        "date_format(o_orderdate, 'yyyy.MM.dd') AS applied", "o_orderpriority AS note",
    )


KINDS = {"capacity": "number", "consent": "boolean", "applied": "date", "note": "text"}
TYPED = "typed AS (SELECT o_orderkey, CASE capacity WHEN '1,500 kW' THEN 1500.0::DOUBLE WHEN '2 MW' THEN 2000.0::DOUBLE END AS capacity, CASE consent WHEN 'yes' THEN true WHEN '아니오' THEN false END AS consent, strptime(applied, '%Y.%m.%d')::DATE AS applied, note, concat_ws(',', CASE WHEN capacity = 'many' THEN 'capacity:INVALID_NUMBER' END, CASE WHEN consent = 'maybe' THEN 'consent:INVALID_BOOLEAN' END) AS errors FROM raw)"


@query("i1_typed_intake", f"WITH {RAW}, {TYPED} SELECT * FROM typed")
def _(t: Tables) -> DataFrame:
    return intake.normalise(raw(t), "o_orderkey", KINDS).withColumn("errors", F.array_join("errors", ","))


def shipments(t: Tables) -> DataFrame:
    x = t.lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))
    return t.orders.join(x, F.col("o_orderkey") == F.col("l_orderkey"), "left")


SHIP = "ship AS (SELECT o.*, first_ship, last_ship FROM orders o LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"


@query("i2_validation", f"WITH {SHIP} SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice < 50000 THEN 'TOO_SMALL' END, CASE WHEN first_ship IS NULL THEN 'NO_SHIPMENT' END) AS errors, concat_ws(',', CASE WHEN o_orderdate > first_ship THEN 'O_ORDERDATE_AFTER_FIRST_SHIP' END, CASE WHEN first_ship > last_ship THEN 'FIRST_SHIP_AFTER_LAST_SHIP' END) AS warnings FROM ship")
def _(t: Tables) -> DataFrame:
    out = intake.validate(shipments(t), {"TOO_SMALL": F.col("o_totalprice") < 50000, "NO_SHIPMENT": F.col("first_ship").isNull()}, intake.in_order(["o_orderdate", "first_ship", "last_ship"]))
    return out.select("o_orderkey", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


@query("i2_capacity_mismatch", "SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_quantity::DOUBLE * (1 + l_tax::DOUBLE) - l_quantity::DOUBLE) > greatest(0.01::DOUBLE, l_quantity::DOUBLE * 0.03) THEN 'CAPACITY_MISMATCH' ELSE '' END AS errors FROM lineitem")
def _(t: Tables) -> DataFrame:
    given = F.col("l_quantity").cast("double")
    out = intake.validate(t.lineitem, {"CAPACITY_MISMATCH": intake.differs(given, given * (1 + F.col("l_tax").cast("double")))})
    return out.select("l_orderkey", "l_linenumber", F.array_join("errors", ",").alias("errors"))


@query("i3_fact_values", f"""WITH {RAW}, {TYPED} SELECT o_orderkey, 'capacity' AS field_name, capacity::VARCHAR AS value FROM typed WHERE capacity IS NOT NULL UNION ALL SELECT o_orderkey, 'consent', consent::VARCHAR FROM typed WHERE consent IS NOT NULL
 UNION ALL SELECT o_orderkey, 'applied', applied::VARCHAR FROM typed WHERE applied IS NOT NULL UNION ALL SELECT o_orderkey, 'note', note FROM typed WHERE note IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    return intake.facts(intake.normalise(raw(t), "o_orderkey", KINDS), "o_orderkey", KINDS).select("o_orderkey", "field_name", intake.fact_value().alias("value"))


@query("i3_facts", f"""WITH {RAW}, {TYPED}, f AS (SELECT o_orderkey, 'capacity' AS field_name, 'number' AS value_type, capacity AS value_numeric, NULL AS value_text, NULL::DATE AS value_date, NULL::BOOLEAN AS value_boolean FROM typed WHERE capacity IS NOT NULL
 UNION ALL SELECT o_orderkey, 'consent', 'boolean', NULL, NULL, NULL, consent FROM typed WHERE consent IS NOT NULL UNION ALL SELECT o_orderkey, 'applied', 'date', NULL, NULL, applied, NULL FROM typed WHERE applied IS NOT NULL UNION ALL SELECT o_orderkey, 'note', 'text', NULL, note, NULL, NULL FROM typed WHERE note IS NOT NULL) SELECT * FROM f""")
def _(t: Tables) -> DataFrame:
    return intake.facts(intake.normalise(raw(t), "o_orderkey", KINDS), "o_orderkey", KINDS)


@query("i4_stages", f"WITH {SHIP} SELECT o_orderkey, n AS stage_order, c AS stage_code, CASE n WHEN 1 THEN 'completed' WHEN 2 THEN CASE WHEN last_ship < TIMESTAMP '1998-01-01' THEN 'completed' WHEN first_ship IS NOT NULL THEN 'in_progress' ELSE 'unknown' END ELSE CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'in_progress' ELSE 'unknown' END END AS status FROM ship, (VALUES (1, 'application'), (2, 'construction'), (3, 'operation')) v(n, c)")
def _(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    states = [("application", F.col("o_orderdate").isNotNull(), F.lit(True)), ("construction", F.col("last_ship") < F.lit("1998-01-01").cast("timestamp"), F.col("first_ship").isNotNull()), ("operation", s == "F", s == "P")]
    return intake.stages(shipments(t), "o_orderkey", states)


@query("i5_milestones", f"WITH {SHIP} SELECT o_orderkey, 'ordered' AS event_code, o_orderdate AS event_date FROM ship WHERE o_orderdate IS NOT NULL UNION ALL SELECT o_orderkey, 'first_ship', first_ship FROM ship WHERE first_ship IS NOT NULL UNION ALL SELECT o_orderkey, 'last_ship', last_ship FROM ship WHERE last_ship IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return intake.milestones(shipments(t), "o_orderkey", {"ordered": "o_orderdate", "first_ship": "first_ship", "last_ship": "last_ship"})


@query("i6_section_statuses", f"WITH {SHIP} SELECT o_orderkey, CASE WHEN o_orderdate > first_ship THEN 'inconsistent' WHEN last_ship IS NOT NULL AND o_orderkey % 2 = 0 THEN 'completed' WHEN first_ship IS NOT NULL THEN 'in_progress' WHEN o_orderdate IS NOT NULL THEN 'planned' ELSE 'unknown' END AS schedule, CASE WHEN first_ship IS NOT NULL THEN 'completed' ELSE 'in_progress' END AS checklist FROM ship")
def _(t: Tables) -> DataFrame:
    status = intake.schedule_status(F.coalesce(F.col("o_orderdate") > F.col("first_ship"), F.lit(False)), F.when(F.col("o_orderkey") % 2 == 0, F.col("last_ship")), F.col("first_ship"), F.col("o_orderdate"))
    return shipments(t).select("o_orderkey", status.alias("schedule"), intake.checklist_status(["o_orderdate", "first_ship", "last_ship"]).alias("checklist"))


@query("i6_risk_and_connection", f"WITH {SHIP} SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'reported' WHEN 'O' THEN 'none_reported' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'under_consultation' ELSE 'unknown' END END AS risk, CASE WHEN last_ship IS NOT NULL THEN 'connected' WHEN o_orderpriority <> '1-URGENT' THEN 'planned' ELSE 'unknown' END AS connection FROM ship")
def _(t: Tables) -> DataFrame:
    complaint = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    point = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority"))
    return shipments(t).select("o_orderkey", intake.risk_status(complaint, F.col("o_orderkey") % 2 == 0).alias("risk"), intake.connection_status(F.col("last_ship"), point).alias("connection"))


@query("i7_nested_facts", "SELECT l_orderkey, 'shipment' AS document_type, 'quantity' AS field_name, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, 'shipment', 'tax', l_tax FROM lineitem")
def _(t: Tables) -> DataFrame:
    fact = lambda n, c: F.struct(F.lit(n).alias("field_name"), F.col(c).alias("value"))
    a = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.lit("shipment").alias("document_type"), F.array(fact("quantity", "l_quantity"), fact("tax", "l_tax")).alias("extracted_facts"))).alias("attachments"))
    return intake.nested_facts(a, "l_orderkey", "attachments").drop("attachment")


@query("i8_precheck", """WITH h AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS held, count(*) FILTER (l_linestatus = 'O') AS pending FROM lineitem GROUP BY 1)
SELECT o_orderkey, array_to_string(list_sort(list_filter(CASE WHEN o_orderstatus = 'P' THEN ['A', 'N', 'R'] ELSE ['A', 'N'] END, lambda x: NOT list_contains(coalesce(held, []), x))), ',') AS missing, coalesce(pending, 0) AS pending FROM orders LEFT JOIN h ON l_orderkey = o_orderkey""")
def _(t: Tables) -> DataFrame:
    attachments = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    out = intake.precheck(t.orders, attachments, "o_orderkey", "l_returnflag", ["A", "N"], {"R": F.col("o_orderstatus") == "P"}, F.col("l_linestatus") == "O")
    return out.withColumn("missing", F.array_join("missing", ","))


@query("i8_risk_flags", """SELECT o_orderkey, 'historical_complaint_reported' AS code, 'high' AS severity FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'resident_consent_unconfirmed', 'high' FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW'
 UNION ALL SELECT o_orderkey, 'environmental_review_required', 'medium' FROM orders WHERE o_totalprice > 150000""")
def _(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    flags = [("historical_complaint_reported", "high", s == "F"), ("resident_consent_unconfirmed", "high", (s == "O") & (F.col("o_orderpriority") != "5-LOW")), ("environmental_review_required", "medium", F.col("o_totalprice") > 150000)]
    return intake.risk_flags(t.orders, "o_orderkey", flags)


@query("i9_fingerprints", """SELECT o_orderkey, o_custkey, sha1('project|' || o_orderkey || '|' || o_custkey) AS project_id, sha256('{"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}') AS fingerprint FROM orders""")
def _(t: Tables) -> DataFrame:
    return intake.fingerprints(t.orders, ["o_orderkey", "o_custkey"], ["o_orderstatus", "o_orderpriority"])


@query("i10_project_places", """WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '경기도 고양시' END AS site, '전라남도 영암군 삼호읍' AS lot, 30 + c_custkey % 12 AS lat, 127.0 AS lon FROM customer), r AS (SELECT c_custkey, 'site' AS role, site AS raw_address, lat, lon FROM a WHERE site IS NOT NULL UNION ALL SELECT c_custkey, 'lot', lot, NULL, NULL FROM a)
SELECT c_custkey, role, raw_address, CASE role WHEN 'site' THEN '고양시' ELSE '영암군' END AS city_county, CASE WHEN lat BETWEEN 32 AND 39 THEN lat::DOUBLE END AS latitude, CASE WHEN lat BETWEEN 32 AND 39 THEN 'resolved_by_user' ELSE 'parsed' END AS resolution_status, sha1('place|' || c_custkey || '|' || role || '|' || raw_address) AS place_id FROM r""")
def _(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lit("경기도 고양시")).alias("site"), F.lit("전라남도 영암군 삼호읍").alias("lot"), (30 + F.col("c_custkey") % 12).cast("double").alias("lat"), F.lit(127.0).alias("lon"))
    out = intake.project_places(rows, "c_custkey", {"site": "site", "lot": "lot"}, {"경기": "경기도", "전남": "전라남도"}, "lat", "lon")
    return out.select("c_custkey", "role", "raw_address", "city_county", "latitude", "resolution_status", "place_id")


@query("w14_revisions", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS revision, CASE WHEN lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) IS NULL THEN 'current' ELSE 'superseded' END AS status FROM orders")
def _(t: Tables) -> DataFrame:
    return intake.revisions(t.orders, "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "revision", "status")


@query("j9_historical_matches", """WITH p AS (SELECT s_suppkey, s_nationkey AS city, s_suppkey % 5 AS ri FROM supplier), c AS (SELECT c_custkey, c_nationkey AS municipality, (c_nationkey + 1) % 25 AS place_city, c_custkey % 5 AS case_ri, c_mktsegment FROM customer),
b AS (SELECT DISTINCT p.*, c.* FROM p JOIN c ON city = municipality OR city = place_city) SELECT s_suppkey, c_custkey, round(CASE WHEN ri = case_ri THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN city = municipality THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN c_mktsegment = 'BUILDING' THEN 0.08::DOUBLE ELSE 0 END, 4) AS score,
 CASE WHEN ri = case_ri THEN 'place:same_ri' WHEN city = municipality THEN 'city' ELSE 'none' END AS match_type FROM b WHERE round(CASE WHEN ri = case_ri THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN city = municipality THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN c_mktsegment = 'BUILDING' THEN 0.08::DOUBLE ELSE 0 END, 4) >= 0.35""")
def _(t: Tables) -> DataFrame:
    p = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("city"), (F.col("s_suppkey") % 5).alias("ri"))
    c = t.customer.select("c_custkey", F.col("c_nationkey").alias("municipality"), ((F.col("c_nationkey") + 1) % 25).alias("place_city"), (F.col("c_custkey") % 5).alias("case_ri"), "c_mktsegment")
    features = {"place:same_ri": (F.col("ri") == F.col("case_ri"), 0.35), "city": (F.col("city") == F.col("municipality"), 0.20), "kind": (F.col("c_mktsegment") == "BUILDING", 0.08)}
    return intake.historical_matches(p, c, "s_suppkey", "c_custkey", "city", features, match=["place:same_ri", "city"], equal={"place:same_ri": ("ri", "case_ri")})


@query("p1_base_segments", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE (quality = 1 OR trim(coalesce(text, '')) <> '') AND (CASE WHEN doc_id % 3 > 0 THEN doc_id END IS NULL OR doc_id >= 100)")
def _(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left").withColumn("day", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")))
    return search.base_segments(rows, "text", F.coalesce(F.col("quality") == 1, F.lit(False)), "day", F.lit(100)).select("doc_id")


TERMS = "SELECT item_id AS request_id, lower(unnest(list_distinct(regexp_extract_all(text, '[a-z]{9,}')))) AS term FROM benchmark UNION ALL SELECT item_id, 'src' || item_id % 30 FROM benchmark"


def batch_terms(t: Tables) -> DataFrame:
    words = t.benchmark.select(F.col("item_id").alias("request_id"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]{9,}"), F.lit(0)))).alias("term"))
    return words.unionByName(t.benchmark.select(F.col("item_id").alias("request_id"), F.concat(F.lit("src"), (F.col("item_id") % 30).cast("string")).alias("term")))


@query("p2_shortlist", f"WITH q AS ({TERMS}) SELECT DISTINCT request_id, doc_id FROM documents JOIN q ON contains(lower(text), term) OR contains(lower(source), term)")
def _(t: Tables) -> DataFrame:
    return search.shortlist(t.documents, batch_terms(t), "doc_id", "text", "source", index=document_index(t))


@query("p2_index_frequencies", r"WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS token FROM documents) SELECT token, count(*) AS texts FROM w GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """In how many documents the stored index has each token."""
    return document_index(t).frequencies()


@query("o5_candidate_union", "SELECT doc_id FROM labels WHERE quality = 0 UNION SELECT doc_id FROM documents WHERE lang = 'de'")
def _(t: Tables) -> DataFrame:
    return t.labels.filter("quality = 0").select("doc_id").union(t.documents.filter("lang = 'de'").select("doc_id")).distinct()


@query("p3_issue_matches", "SELECT doc_id FROM documents WHERE lang IN ('de', 'fr') AND (contains(text, 'keit') OR contains(text, 'ment'))")
def _(t: Tables) -> DataFrame:
    ok = search.issue_matches(F.array(F.lit("de"), F.lit("fr")), F.array("lang"), F.col("text"), F.array(F.lit("keit"), F.lit("ment")))
    return t.documents.filter(ok).select("doc_id")


@query("p4_review_mode", """WITH l AS (SELECT doc_id, bool_or(quality = 1) AS e, bool_or(quality = 0 AND toxic = 0) AS n FROM labels GROUP BY 1)
SELECT 'all' AS mode, doc_id FROM documents LEFT JOIN l USING (doc_id) WHERE l.doc_id IS NULL OR e OR n UNION ALL SELECT 'eligible', doc_id FROM l JOIN documents USING (doc_id) WHERE e UNION ALL SELECT 'needs_review', doc_id FROM l JOIN documents USING (doc_id) WHERE n""")
def _(t: Tables) -> DataFrame:
    links = t.labels.withColumn("decision", F.when(F.col("quality") == 1, "eligible").when(F.col("toxic") == 0, "needs_review").otherwise("rejected"))
    modes = [search.by_review_mode(t.documents, links, "doc_id", "decision", m).select(F.lit(m).alias("mode"), "doc_id") for m in ("all", "eligible", "needs_review")]
    return modes[0].unionByName(modes[1]).unionByName(modes[2])


@query("p6_coordinate_bounds", "SELECT c_custkey, CASE WHEN 30 + c_custkey % 15 BETWEEN 32 AND 39 THEN (30 + c_custkey % 15)::DOUBLE END AS lat FROM customer")
def _(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", X.within_bounds((30 + F.col("c_custkey") % 15).cast("string"), 32, 39).alias("lat"))


@query("p7_scope", "SELECT doc_id, source FROM documents WHERE lang = 'en'")
def _(t: Tables) -> DataFrame:
    return t.documents.filter(F.col("lang") == "en").select("doc_id", "source")


@query("p8_read_views", "SELECT doc_id, source AS title, lang AS region, length(coalesce(text, '')) AS n_chars FROM documents")
def _(t: Tables) -> DataFrame:
    t.documents.selectExpr("doc_id", "source AS title", "lang AS region", "length(coalesce(text, '')) AS n_chars").createOrReplaceTempView("document_view")
    return t.spark.sql("SELECT doc_id, title, region, cast(n_chars AS bigint) AS n_chars FROM document_view")


@query("j1_segments_with_meetings", "SELECT l_orderkey, l_linenumber, o_orderdate, c_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def _(t: Tables) -> DataFrame:
    speaker = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(speaker, "o_custkey", "left")
    return joined.select("l_orderkey", "l_linenumber", "o_orderdate", "c_name")


SCORED = """q AS (SELECT item_id AS request_id, list_distinct(regexp_extract_all(text, '[a-z]{6,}')) AS terms, 'src' || item_id % 30 AS region, CASE item_id % 3 WHEN 0 THEN ['de', 'fr'] ELSE []::VARCHAR[] END AS codes FROM benchmark),
l AS (SELECT doc_id, bool_or(quality = 1) AS e, bool_or(quality = 0 AND toxic = 0) AS n FROM labels GROUP BY 1),
s AS (SELECT d.doc_id, coalesce(text, '') AS text, lower(coalesce(text, '')) AS low, source, lang, DATE '2020-01-01' + (doc_id % 2000)::INT AS day FROM documents d LEFT JOIN l USING (doc_id) WHERE l.doc_id IS NULL OR e OR n),
h AS (SELECT q.*, s.* EXCLUDE (low), len(list_filter(terms, lambda x: contains(low, x))) AS hits FROM s, q WHERE len(codes) = 0 OR (list_contains(codes, lang) AND (contains(text, 'keit') OR contains(text, 'ment')))),
r AS (SELECT *, round(0.38::DOUBLE * least(1.0::DOUBLE, hits / greatest(1, least(3, len(terms)))) + 0.32::DOUBLE * CASE WHEN source = region THEN 1.0::DOUBLE WHEN source[1:4] = region[1:4] THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END
 + 0.20::DOUBLE * greatest(0.1::DOUBLE, 1.0::DOUBLE - least(greatest(0, DATE '2026-01-01' - day), 3650) / 3650) + 0.10::DOUBLE * CASE lang WHEN 'en' THEN 1.0::DOUBLE WHEN 'de' THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END, 6) AS score FROM h WHERE hits > 0)"""


def request_batch(t: Tables) -> DataFrame:
    k = F.col("item_id")
    terms = F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]{6,}"), F.lit(0)))
    codes = F.when(k % 3 == 0, F.array(F.lit("de"), F.lit("fr"))).otherwise(F.array().cast("array<string>"))
    return t.benchmark.select(k.alias("request_id"), terms.alias("terms"), F.concat(F.lit("src"), (k % 30).cast("string")).alias("region"), codes.alias("codes"))


def search_inputs(t: Tables) -> dict:
    """Requests, reviewed passages, and the place, source and issue parts of the search."""
    links = t.labels.withColumn("decision", F.when(F.col("quality") == 1, "eligible").when(F.col("toxic") == 0, "needs_review").otherwise("rejected"))
    s = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source", "lang", F.expr("date_add(DATE '2020-01-01', cast(doc_id % 2000 AS int))").alias("day"))
    place = F.when(F.col("source") == F.col("region"), 1.0).when(F.substring("source", 1, 4) == F.substring("region", 1, 4), 0.25).otherwise(0.0)
    return {
        "requests": request_batch(t), "segments": search.by_review_mode(s, links, "doc_id", "decision", "all"), "key": "doc_id", "text_col": "text", "date": "day", "as_of": F.to_date(F.lit("2026-01-01")),
        "spatial": place, "source": F.when(F.col("lang") == "en", 1.0).when(F.col("lang") == "de", 0.8).otherwise(0.6),
        "eligible": search.issue_matches(F.col("codes"), F.array("lang"), F.col("text"), F.array(F.lit("keit"), F.lit("ment"))), "index": document_index(t),
    }


@query("r1_hybrid_scores", f"WITH {SCORED} SELECT request_id, doc_id, hits, score FROM r")
def _(t: Tables) -> DataFrame:
    return search.scored_passages(**search_inputs(t)).select("request_id", "doc_id", "hits", "score")


DIVERSE = SCORED + """, k AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS key FROM r), u AS (SELECT *, row_number() OVER (PARTITION BY request_id, key ORDER BY score DESC, doc_id) AS n FROM k),
m AS (SELECT *, row_number() OVER (PARTITION BY request_id, source ORDER BY score DESC, doc_id) AS m FROM u WHERE n = 1 OR key = ''), z AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, doc_id)::INT AS rank FROM m WHERE m = 1)"""


@query("r2_search", f"WITH {DIVERSE} SELECT request_id, doc_id, hits, score, rank FROM z WHERE rank <= 10")
def _(t: Tables) -> DataFrame:
    return search.search(**search_inputs(t), meeting=["source"], limit=10)


@query("w10_diversified", f"WITH {DIVERSE} SELECT request_id, doc_id, rank FROM z")
def _(t: Tables) -> DataFrame:
    rows = search.scored_passages(**search_inputs(t))
    return search.diversified(rows, "request_id", "text_key", ["source"], [F.desc("score"), F.col("doc_id")], 1 << 30).select("request_id", "doc_id", "rank")


@query("o1_ranked_results", "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus DESC, o_totalprice DESC, o_orderdate DESC, o_orderkey)::INT AS rank FROM orders) SELECT * FROM r WHERE rank <= 100")
def _(t: Tables) -> DataFrame:
    return search.ranked(t.orders, "o_custkey", [F.desc("o_orderstatus"), F.desc("o_totalprice"), F.desc("o_orderdate"), F.col("o_orderkey")], 100).select("o_custkey", "o_orderkey", "rank")


@query("a23_case_groups", "SELECT l_suppkey, l_returnflag, count(DISTINCT l_orderkey) AS episodes, count(DISTINCT l_partkey) AS evidence FROM lineitem GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return search.case_groups(t.lineitem, "l_suppkey", "l_returnflag", "l_orderkey", "l_partkey")


@query("r4_evidence_packs", "SELECT o_custkey, string_agg(DISTINCT o_orderkey::VARCHAR, ',' ORDER BY o_orderkey::VARCHAR) AS evidence_ids, count(*)::INT AS evidence FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    out = pack.evidence_structs(t.orders, "o_custkey", ["o_orderkey", "o_orderstatus"], "o_orderdate")
    return out.select("o_custkey", F.array_join("evidence_ids", ",").alias("evidence_ids"), F.size("evidence").alias("evidence"))


@query("a22_issue_counts", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY ALL UNION ALL SELECT DISTINCT user_id, 'view', 1 FROM events) SELECT user_id, event_type, max(n) AS n FROM c GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    detected = t.events.select("user_id").distinct().withColumn("event_type", F.lit("view"))
    return pack.issue_counts(t.events.filter("event_type <> 'view'"), detected, "user_id", "event_type")


@query("o4_card_order", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, event_type, n, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 99 END, n DESC, event_type)::INT AS rank FROM c")
def _(t: Tables) -> DataFrame:
    return pack.issue_order(t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n")), "user_id", "event_type", {"error": 0, "purchase": 1})


@query("r5_reason_cards", f"""WITH {APPLIED}, i AS (SELECT l_partkey AS p_partkey, l_returnflag AS code, count(*) AS n FROM lineitem GROUP BY ALL), e AS (SELECT l_partkey AS p_partkey, max(l_linestatus) AS last_outcome, count(*) FILTER (l_linestatus = 'O') AS unresolved FROM lineitem GROUP BY 1), s AS (SELECT l_partkey AS p_partkey, count(DISTINCT l_suppkey) AS permits FROM lineitem GROUP BY 1)
SELECT p_partkey, 'rule' AS category, rule_id AS title, CASE status WHEN 'fail' THEN 'fact' ELSE 'unknown' END AS assertion, rule_kind AS severity FROM checks WHERE status <> 'pass' UNION ALL SELECT p_partkey, 'issue', code, CASE WHEN n >= 2 THEN 'repeated' ELSE 'single' END, CASE WHEN n >= 2 THEN 'warning' ELSE 'info' END FROM i
UNION ALL SELECT p_partkey, 'process', last_outcome, 'fact', 'warning' FROM e WHERE unresolved > 0 UNION ALL SELECT p_partkey, 'permit', 'permits_nearby', 'fact', 'info' FROM s WHERE permits >= 3""")
def _(t: Tables) -> DataFrame:
    l = t.lineitem.withColumnRenamed("l_partkey", "p_partkey")
    issues = l.groupBy("p_partkey", F.col("l_returnflag").alias("code")).agg(F.count("*").alias("n"))
    events = l.groupBy("p_partkey").agg(F.max("l_linestatus").alias("last_outcome"), F.count_if(F.col("l_linestatus") == "O").alias("unresolved"))
    nearby = l.groupBy("p_partkey").agg(F.count_distinct("l_suppkey").alias("permits"))
    return pack.reason_cards(checks(t).select("p_partkey", F.col("rule_id").alias("name"), "status", F.col("rule_kind").alias("severity")), issues, events, nearby, "p_partkey")


@query("r6_conclusions", f"""WITH {APPLIED}, c AS (SELECT p_partkey, count(*) FILTER (status = 'fail') AS f, count(*) FILTER (status = 'check_required') AS u FROM checks GROUP BY 1)
SELECT p_partkey, CASE WHEN f > 0 THEN 'review_required' WHEN p_partkey % 11 = 0 OR p_partkey % 7 = 1 THEN 'conditional_review' WHEN u > 0 OR p_partkey % 5 = 0 THEN 'insufficient_evidence' ELSE 'no_material_risk_found' END AS conclusion FROM c""")
def _(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    verdict = pack.conclusion(F.col("failed"), k % 11 == 0, (k % 7 == 1).cast("int"), F.col("unknown"), k % 5)
    return rules.status_counts(checks(t), "p_partkey").select("p_partkey", verdict.alias("conclusion"))


@query("r8_grounding_audit", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X9' ELSE '' END AS unknown_citations, CASE WHEN o_orderkey % 4 = 0 THEN '777' ELSE '' END AS unverified_numbers, o_orderkey % 5 = 0 AS digits_in_observations, o_orderkey % 3 > 0 AND o_orderkey % 4 > 0 AND o_orderkey % 5 > 0 AS grounded FROM orders""")
def _(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    rows = t.orders.select(
        "o_orderkey", F.concat(F.lit("about "), F.format_number(F.lit(1234.5), 1), F.when(k % 4 == 0, " or 777").otherwise("")).alias("prose"), F.array(F.lit("E1"), F.when(k % 3 == 0, "X9").otherwise("E1")).alias("cited"),
        F.array(F.lit("E1"), F.lit("E2")).alias("allowed"), F.array(F.lit("1234.5"), F.lit("record-777-a")).alias("facts"), F.array(F.when(k % 5 == 0, "3 roads").otherwise("no roads")).alias("seen"),
    )
    out = pack.audit_answers(rows, "o_orderkey", "prose", "cited", "allowed", "facts", "seen")
    return out.withColumn("unknown_citations", F.array_join("unknown_citations", ",")).withColumn("unverified_numbers", F.array_join("unverified_numbers", ","))


@query("r9_compacted", "WITH r AS (SELECT conv_id, turn, substr(text, 1, 220) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS rank FROM conversations) SELECT * FROM r WHERE rank <= 5")
def _(t: Tables) -> DataFrame:
    return pack.compacted(t.conversations, "conv_id", [F.col("turn")], "text", 5, 220).select("conv_id", "turn", "text", "rank")


@query("r9_prompt_pack", """WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, strftime(o_orderdate, '%Y-%m-%d'), o_orderkey) AS d FROM orders),
q AS (SELECT o_custkey, o_orderkey, repeat(l_returnflag || l_linestatus || ' ', 99)[1:220] AS text, row_number() OVER (PARTITION BY o_custkey, o_orderkey ORDER BY l_linenumber, l_returnflag || l_linestatus) AS k FROM o JOIN lineitem ON l_orderkey = o_orderkey WHERE n <= 5)
SELECT o_custkey, 'reason' AS part, o_orderkey AS reason, n::INT AS rank, o_orderpriority AS text FROM o WHERE n <= 5 UNION ALL SELECT o_custkey, 'quote', o_orderkey, 1, text FROM q WHERE k = 1
UNION ALL SELECT o_custkey, 'timeline', NULL, d::INT, strftime(o_orderdate, '%Y-%m-%d') FROM o WHERE d <= 6 UNION ALL SELECT o_custkey, 'permit', NULL, n::INT, o_orderkey::VARCHAR FROM o WHERE n <= 3""")
def _(t: Tables) -> DataFrame:
    o = t.orders.withColumnRenamed("o_orderkey", "reason")
    reasons = o.select("o_custkey", "reason", F.col("reason").alias("place"), F.col("o_orderpriority").alias("text"))
    lines = dealt_join(t.lineitem.select(F.col("l_orderkey").alias("reason"), "l_linenumber", "l_returnflag", "l_linestatus"), o.select("reason", "o_custkey"), ["reason"])
    quotes = lines.select("o_custkey", "reason", F.col("l_linenumber").alias("place"), F.expr("repeat(l_returnflag || l_linestatus || ' ', 99)").alias("text"))
    timeline = o.select("o_custkey", F.col("o_orderdate").alias("place"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("text"))
    permits = o.select("o_custkey", F.col("reason").alias("place"), F.col("reason").cast("string").alias("text"))
    return pack.prompt_pack(reasons, quotes, timeline, permits, "o_custkey", "reason")


@query("r10_evidence_links", "WITH o AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem) SELECT l_orderkey, l_partkey AS evidence_id, min(n)::INT AS rank FROM o GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    packs = t.lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("e"))
    return pack.evidence_links(packs, "l_orderkey", "e")


@query("a26_conversations", "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, count(*) AS n FROM conversations GROUP BY 1")
def _(t: Tables) -> DataFrame:
    out = pack.conversations(t.conversations, "conv_id", "turn", ["role", "text"])
    return out.select("conv_id", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), "n")


@query("w12_last_turns", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role IN ('user', 'assistant')) SELECT conv_id, string_agg(turn || ':' || role || ':' || coalesce(substr(text, 1, 500), ''), '|' ORDER BY turn) AS turns FROM r WHERE k <= 6 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    out = pack.last_turns(t.conversations, "conv_id", "turn", "role", "text")
    return out.select("conv_id", F.array_join(F.transform("turns", lambda x: F.concat(x["turn"].cast("string"), F.lit(":"), x["role"], F.lit(":"), F.coalesce(x["text"], F.lit("")))), "|").alias("turns"))


@query("v1_structural_checks", """SELECT 'lineitem_without_order' AS check_name, count(*) AS violations FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'order_without_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'customer_without_order', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'label_without_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def _(t: Tables) -> DataFrame:
    return audit.report({
        "lineitem_without_order": audit.orphans(t.lineitem, t.orders, "l_orderkey", "o_orderkey"), "order_without_customer": audit.orphans(t.orders, t.customer, "o_custkey", "c_custkey"),
        "customer_without_order": audit.childless(t.customer, t.orders, "c_custkey", "o_custkey"), "label_without_document": audit.orphans(t.labels, t.documents, "doc_id", "doc_id"),
    })


@query("j13_missing_parents", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(t: Tables) -> DataFrame:
    return audit.childless(t.customer, t.orders, "c_custkey", "o_custkey").select("c_custkey")


LINEAGE = "a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey - o_orderkey % 50 END AS parent, o_custkey % 2 AS grp FROM orders), bad AS (SELECT a.id, a.parent, CASE WHEN p.id IS NULL THEN 'broken' WHEN p.grp IS DISTINCT FROM a.grp THEN 'crossed' END AS problem FROM a LEFT JOIN a p ON a.parent = p.id WHERE a.parent IS NOT NULL)"


def lineage(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return audit.lineage_problems(t.orders.select(k.alias("id"), F.when(k % 3 > 0, k - k % 50).alias("parent"), (F.col("o_custkey") % 2).alias("grp")), "id", "parent", "grp")


@query("j15_lineage", f"WITH {LINEAGE} SELECT * FROM bad WHERE problem IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return lineage(t)


@query("v2_lineage_checks", f"WITH {LINEAGE} SELECT problem, count(*) AS n FROM bad WHERE problem IS NOT NULL GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return lineage(t).groupBy("problem").agg(F.count("*").alias("n"))


COVER = "cover AS (SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS documents, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS cases FROM nation)"


@query("v3_region_rows", f"WITH {COVER} SELECT * FROM cover")
def _(t: Tables) -> DataFrame:
    return audit.coverage_counts(t.nation.select("n_nationkey"), {"documents": t.customer.withColumnRenamed("c_nationkey", "n_nationkey"), "cases": t.supplier.withColumnRenamed("s_nationkey", "n_nationkey")}, "n_nationkey")


@query("a12_coverage_counts", "SELECT lang, count(DISTINCT doc_id) AS documents, count(DISTINCT source) AS sources FROM documents GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.count_distinct("doc_id").alias("documents"), F.count_distinct("source").alias("sources"))


@query("v4_coverage_status", f"WITH {COVER} SELECT n_nationkey, documents, CASE WHEN documents >= 60 THEN 'complete' WHEN cases * 20 > documents THEN 'candidates_left' WHEN documents > 0 THEN 'exhausted' ELSE 'missing' END AS status, greatest(0, 60 - documents) AS shortfall FROM cover")
def _(t: Tables) -> DataFrame:
    c = audit.coverage_counts(t.nation.select("n_nationkey"), {"documents": t.customer.withColumnRenamed("c_nationkey", "n_nationkey"), "cases": t.supplier.withColumnRenamed("s_nationkey", "n_nationkey")}, "n_nationkey")
    return c.select("n_nationkey", "documents", audit.coverage_status(F.col("documents"), 60, F.col("cases") * 20).alias("status"), F.greatest(F.lit(0).cast("long"), 60 - F.col("documents")).alias("shortfall"))


@query("a27_collection_outcome", "WITH o AS (SELECT n_nationkey, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS existing, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS listed FROM nation) SELECT *, greatest(0, 5 - existing) AS shortfall, CASE WHEN existing >= 5 THEN 'complete' WHEN listed > existing THEN 'candidates_left' WHEN existing > 0 THEN 'exhausted' ELSE 'missing' END AS status FROM o")
def _(t: Tables) -> DataFrame:
    out = audit.collection_outcome(t.nation.select("n_nationkey"), t.supplier.withColumnRenamed("s_nationkey", "n_nationkey"), t.customer.withColumnRenamed("c_nationkey", "n_nationkey"), "n_nationkey", 5)
    return out.withColumn("shortfall", F.col("shortfall").cast("long"))


@query("v7_constraints", "SELECT 'quantity_positive' AS check_name, count(*) FILTER (NOT l_quantity > 0) AS violations FROM lineitem UNION ALL SELECT 'discount_range', count(*) FILTER (NOT l_discount BETWEEN 0 AND 0.05) FROM lineitem UNION ALL SELECT 'flag_enum', count(*) FILTER (l_returnflag NOT IN ('A', 'R')) FROM lineitem")
def _(t: Tables) -> DataFrame:
    return audit.constraint_report(t.lineitem, {"quantity_positive": F.col("l_quantity") > 0, "discount_range": F.col("l_discount").between(0, 0.05), "flag_enum": F.col("l_returnflag").isin("A", "R")})


@query("v8_unique_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t: Tables) -> DataFrame:
    return audit.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("a13_group_counts", """SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2""")
def _(t: Tables) -> DataFrame:
    return audit.grouped_counts(t.orders, ["o_orderstatus", "o_orderpriority"])


@query("a21_acceptance_scores", "SELECT o_custkey, 1000 * max((o_orderstatus = 'F')::INT) + 30 * count(*) FILTER (o_orderstatus = 'P') + 20 * count(*) FILTER (o_orderpriority LIKE '1%') + 5 * count(*) FILTER (o_totalprice < 50000) + sum(o_orderkey % 3)::BIGINT + 2 * max((o_orderkey % 2)::INT) AS score FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return audit.acceptance_score(t.orders, "o_custkey", F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "P", F.col("o_orderpriority").startswith("1"), F.col("o_totalprice") < 50000, k % 3, k % 2 == 1)


@query("w11_fill_shortfall", "WITH h AS (SELECT s_nationkey AS c_nationkey, greatest(0, 10 - count(*)) AS need FROM supplier GROUP BY 1), r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)::INT AS rank FROM customer) SELECT c_nationkey, c_custkey, rank FROM r LEFT JOIN h USING (c_nationkey) WHERE rank <= coalesce(need, 10)")
def _(t: Tables) -> DataFrame:
    have = t.supplier.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count("*").alias("have"))
    return audit.fill_shortfall(t.customer, have, "c_nationkey", [F.desc("c_acctbal"), F.col("c_custkey")], 10).select("c_nationkey", "c_custkey", "rank")


@query("a25_candidate_export", "SELECT o_orderstatus, o_custkey, count(DISTINCT o_orderkey) AS episodes, max(o_totalprice) AS confidence FROM orders GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return audit.candidate_export(t.orders, "o_orderstatus", "o_custkey", "o_orderkey", "o_totalprice")


@query("o7_id_sets", "SELECT doc_id, 'both' AS side FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'left' FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)")
def _(t: Tables) -> DataFrame:
    both, left = audit.id_sets(t.documents, t.labels, "doc_id")
    return both.withColumn("side", F.lit("both")).unionByName(left.withColumn("side", F.lit("left")))


def scratch(t: Tables) -> str:
    return scratch_folder(t.spark)


@query("s1_minutes_files", "SELECT CASE WHEN doc_id % 7 > 0 THEN doc_id::VARCHAR ELSE '' END AS docid, lang AS region_code, CASE WHEN doc_id % 7 = 0 THEN 'missing_docid' WHEN trim(coalesce(text, '')) = '' OR doc_id % 5 = 0 THEN 'missing_html' END AS reject_reason FROM documents")
def _(t: Tables) -> DataFrame:
    path = scratch(t)
    body = t.documents.select(F.when(F.col("doc_id") % 7 > 0, F.col("doc_id").cast("string")).otherwise("").alias("DOCID"), F.when(F.col("doc_id") % 5 > 0, F.col("text")).alias("MINTS_HTML"), F.col("lang").alias("region"))
    body.write.partitionBy("region").json(path)
    found = readers.read_minutes_lines(t.spark, path, region=r"region=([^/]+)/")
    return found.select(F.col("DOCID").alias("docid"), "region_code", "reject_reason")


@query("s2_first_new_ids", "WITH r AS (SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)) SELECT l_partkey, l_orderkey, l_linenumber FROM r WHERE k = 1")
def _(t: Tables) -> DataFrame:
    known = t.part.filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return readers.first_new(t.lineitem, "l_partkey", [F.col("l_orderkey"), F.col("l_linenumber")], known).select("l_partkey", "l_orderkey", "l_linenumber")


@query("s3_permit_csv", "SELECT p_name AS facility_name, '영암군 ' || p_type AS jibun_address, (p_size * 1000)::DOUBLE AS capacity_kw FROM part WHERE p_partkey % 2 = 0")
def _(t: Tables) -> DataFrame:
    path = scratch(t)
    where = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("영암군 "), "p_type")).otherwise(F.concat(F.lit("나주시 "), "p_type"))
    rows = t.part.select(F.col("p_name").alias("시설명"), where.alias("대표소재지지번주소"), F.lit("가동").alias("가동상태명"), F.concat("p_size", F.lit(",000")).alias("용량"), F.lit("2020").alias("설치연도"), F.lit("2024-01-31").alias("데이터기준일자"))
    tables.write_csv(rows, path)
    return readers.read_permit_csv(t.spark, path, "영암군").select("facility_name", "jibun_address", "capacity_kw")


@query("s4_register_load", "SELECT count(*) AS read, count(*) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY')) AS loaded, count(*) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey % 3 > 0) AS with_coordinates, count(*) - count(*) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY')) AS skipped FROM customer")
def _(t: Tables) -> DataFrame:
    rows = t.customer.withColumn("lat", F.lit(35.0)).withColumn("lon", F.lit(127.0))
    return readers.load_register(rows, "c_mktsegment", ["BUILDING", "MACHINERY"], F.col("c_custkey") % 3 > 0, "lat", "lon")[1]


@query("s5_pages", "WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS idx FROM documents) SELECT doc_id, (idx // 5)::BIGINT AS page, string_agg(line, chr(10) || chr(10) ORDER BY idx) AS page_text, count(*) AS paragraphs FROM l GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("idx", "line")).withColumn("page", F.floor(F.col("idx") / 5))
    return readers.pages_from_paragraphs(lines, "doc_id", "page", "idx", "line")


@query("s6_snapshot_table", "SELECT p_partkey, p_name, p_size FROM part WHERE p_size < 25")
def _(t: Tables) -> DataFrame:
    path = scratch(t)
    tables.write_csv(t.part.select("p_partkey", "p_name", "p_size"), path)
    return readers.read_table(t.spark, path, "p_partkey long, p_name string, p_size int", F.col("p_size") < 25)


@query("s8_first_seen", "WITH s AS (SELECT l_suppkey, l_partkey, arg_min(l_returnflag, l_orderkey * 10 + l_linenumber) AS first_query, min(l_orderkey * 10 + l_linenumber) AS first_order FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY first_order, l_partkey)::INT AS rank FROM s) SELECT * FROM r WHERE rank <= 20")
def _(t: Tables) -> DataFrame:
    return readers.first_seen_queries(t.lineitem.withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "l_suppkey", "l_partkey", "l_returnflag", "k", 20)


@query("s9_typed_dump", "SELECT o_orderkey, o_totalprice::DECIMAL(18,2)::DOUBLE AS price, o_orderdate::DATE AS day FROM orders")
def _(t: Tables) -> DataFrame:
    raw_rows = t.orders.select("o_orderkey", F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2).alias("price"), F.date_format("o_orderdate", "yyyyMMdd").alias("day"))
    return readers.typed_dump(raw_rows, ["price"], {"day": "yyyyMMdd"})


@query("s10_manifests", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, m.o_orderpriority, 'none') AS title FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY 1) m ON o_custkey = c_custkey")
def _(t: Tables) -> DataFrame:
    merged = readers.merged_manifests(t.orders, "o_custkey", "o_orderkey", ["o_orderpriority"]).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("title"))
    base = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("title"))
    return readers.by_precedence(base, [merged, t.customer.select("c_custkey", F.lit("none").alias("title"))], "c_custkey", ["title"])


@query("k1_upsert", "WITH i AS (SELECT o_custkey AS k, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey NOT IN (SELECT k FROM i) UNION ALL SELECT k, v FROM i WHERE n = 1")
def _(t: Tables) -> DataFrame:
    existing = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit(None).cast("timestamp").alias("d"), F.lit(0).cast("long").alias("id"))
    incoming = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderdate").alias("d"), F.col("o_orderkey").alias("id"))
    return tables.upsert(existing, incoming, ["k"], [F.desc("d"), F.col("id")]).select("k", "v")


@query("k2_replace_derived", "SELECT l_orderkey, l_linenumber, 'old' AS origin FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, 0, 'new' FROM orders WHERE o_orderstatus = 'P'")
def _(t: Tables) -> DataFrame:
    docs = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return tables.replace_derived(t.lineitem.select("l_orderkey", "l_linenumber", F.lit("old").alias("origin")), docs.withColumn("l_linenumber", F.lit(0)).withColumn("origin", F.lit("new")), docs, "l_orderkey")


@query("k3_rederive", "SELECT doc_id, 'reviewed' AS status FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'pending' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(t: Tables) -> DataFrame:
    existing = t.labels.select("doc_id", F.when(F.col("quality") == 1, "reviewed").otherwise("pending").alias("status"))
    return tables.rederive(existing, t.documents.select("doc_id", F.lit("pending").alias("status")), ["doc_id"], "status")


@query("k4_relabel_run", "SELECT count(*) AS seen, count(*) FILTER ((CASE WHEN contains(text, 'keit') THEN 'de' ELSE 'en' END) IS DISTINCT FROM lang) AS changed, 'run1' AS run_id FROM documents")
def _(t: Tables) -> DataFrame:
    return tables.relabelled(t.documents, F.when(F.col("text").contains("keit"), "de").otherwise("en"), "lang", "run1")[1]


@query("k5_backfill", "SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem EXCEPT SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'N'")
def _(t: Tables) -> DataFrame:
    return tables.missing_pairs(t.lineitem, t.lineitem.filter("l_returnflag = 'N'"), ["l_orderkey", "l_suppkey"])


@query("k6_best_provenance", "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) SELECT o_custkey, o_orderkey FROM r WHERE k = 1")
def _(t: Tables) -> DataFrame:
    existing = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    priority = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return tables.best_provenance(t.orders, "o_custkey", priority, "o_orderkey", existing).select("o_custkey", "o_orderkey")


@query("k7_rewrite_paths", "SELECT count(*) FILTER (replace(replace(url, 'http://', 'https://'), 'example', 'archive') IS DISTINCT FROM url) AS changed_url FROM pages")
def _(t: Tables) -> DataFrame:
    return tables.rewritten(t.pages, ["url"], [("http://", "https://"), ("example", "archive")])[1]


@query("k8_table_counts", "SELECT 'orders' AS table_name, count(*) AS rows FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'documents', count(*) FROM documents")
def _(t: Tables) -> DataFrame:
    return tables.table_counts({"orders": t.orders, "lineitem": t.lineitem, "documents": t.documents})


@query("k9_json_report", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    path = scratch(t)
    tables.write_report(t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")), path)
    return t.spark.read.schema("status string, n bigint").json(path)


@query("k10_csv_tables", "SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders")
def _(t: Tables) -> DataFrame:
    path = scratch(t)
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_orderdate")
    tables.write_csv(rows, path)
    return t.spark.read.schema(rows.schema).option("header", True).csv(path)


@query("k11_pruned_cases", "SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 OR c_custkey IN (SELECT o_custkey FROM orders)")
def _(t: Tables) -> DataFrame:
    evidence = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    return tables.pruned_cases(t.customer, evidence, "c_custkey", F.col("c_custkey") % 3 != 0).select("c_custkey")


@query("k12_operational_log", """SELECT sha1('search|{"conv_id":' || conv_id || ',"turn":' || turn || '}') AS log_id, 'search' AS kind, '{"conv_id":' || conv_id || ',"turn":' || turn || '}' AS payload FROM conversations""")
def _(t: Tables) -> DataFrame:
    return tables.log_entries(t.conversations, "search", ["conv_id", "turn"], F.lit("2024-01-01").cast("timestamp")).drop("logged_at")


@query("k13_archive", """WITH a AS (SELECT c_nationkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}' AS payload FROM customer) SELECT c_nationkey, payload, sha256(payload) AS sha256, strlen(payload)::INT AS size_bytes FROM a""")
def _(t: Tables) -> DataFrame:
    path = scratch(t)
    tables.write_archive(tables.archived(t.customer, "c_nationkey", ["c_name", "c_custkey"]), path, "c_nationkey")
    return t.spark.read.schema("payload string, sha256 string, size_bytes int, c_nationkey int").json(path).select("c_nationkey", "payload", "sha256", "size_bytes")


@query("k14_artifact_lineage", """WITH a AS (SELECT page_id, 'original' AS role, url AS uri, NULL AS parent_id FROM pages WHERE url IS NOT NULL UNION ALL SELECT page_id, 'text', html, CASE WHEN url IS NOT NULL THEN sha1('artifact|' || page_id || '|original') END FROM pages WHERE html IS NOT NULL) SELECT sha1('artifact|' || page_id || '|' || role) AS artifact_id, page_id, role, parent_id FROM a""")
def _(t: Tables) -> DataFrame:
    return tables.artifact_lineage(t.pages, "page_id", [("original", "url"), ("text", "html")]).drop("uri")


@query("j10_address_cache", "WITH c AS (SELECT DISTINCT c_mktsegment AS a FROM customer WHERE c_mktsegment < 'H') SELECT CASE WHEN a IS NULL THEN 'pending' ELSE 'resolved' END AS geocode_status, count(*) AS n FROM customer LEFT JOIN c ON a = c_mktsegment GROUP BY 1")
def _(t: Tables) -> DataFrame:
    cache = t.customer.filter("c_mktsegment < 'H'").select("c_mktsegment").distinct().withColumn("geocode_status", F.lit("resolved"))
    return tables.address_cache(t.customer, cache, "c_mktsegment")[2]


@query("x1_incremental_ingest", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS k FROM events) SELECT user_id, event_type, event_id FROM r WHERE k = 1")
def _(t: Tables) -> DataFrame:
    path = scratch(t)
    t.events.repartition(4, "event_id").write.parquet(f"{path}/in")
    stream = jobs.record_stream(t.spark, f"{path}/in", t.events.schema, files=2)
    jobs.ingest(stream, f"{path}/table", f"{path}/state", ["user_id", "event_type"], [F.desc("ts"), F.col("event_id")]).awaitTermination()
    return jobs.current(t.spark, f"{path}/table").select("user_id", "event_type", "event_id")


@query("x2_message_intake", "SELECT DISTINCT conv_id, turn, role FROM conversations")
def _(t: Tables) -> DataFrame:
    path = scratch(t)
    rows = t.conversations.withColumn("at", F.expr("timestamp_seconds(1700000000 + conv_id * 60 + turn)"))
    rows.unionByName(rows.filter("turn % 2 = 0")).write.parquet(f"{path}/in")
    stream = jobs.record_stream(t.spark, f"{path}/in", rows.schema)
    jobs.intake(stream, f"{path}/log", f"{path}/state", ["conv_id", "turn"], "at", "3650 days").awaitTermination()
    return t.spark.read.schema(rows.schema).parquet(f"{path}/log").select("conv_id", "turn", "role")


@query("x2_refreshed_context", """WITH r AS (SELECT conv_id, turn, role, substr(text, 1, 500) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, string_agg(turn || ':' || role || ':' || coalesce(text, ''), '|' ORDER BY turn) AS turns FROM r WHERE n <= 6 GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    out = jobs.refreshed_context(t.conversations, "conv_id", "turn", "role", "text")
    said = F.transform("turns", lambda x: F.concat_ws(":", x["turn"].cast("string"), x["role"], F.coalesce(x["text"], F.lit(""))))
    return out.select("conv_id", F.array_join(said, "|").alias("turns"))


@query("x2_contexts_by_batch", """WITH r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, string_agg(turn || ':' || role || ':' || coalesce(text, ''), '|' ORDER BY turn) AS turns FROM r WHERE n <= 6 GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    """Messages in two runs, the even turns and repeats of some odd ones last: the state goes on where the first run stopped."""
    path, rows = scratch(t), t.conversations
    for part in (rows.filter("turn % 2 = 1"), rows.filter("turn % 2 = 0 OR conv_id % 3 = 0")):
        part.write.mode("append").parquet(f"{path}/in")
        stream = jobs.record_stream(t.spark, f"{path}/in", rows.schema)
        jobs.refresh_contexts(stream, f"{path}/contexts", f"{path}/state", "conv_id", "turn", "role", "text", buckets=8).awaitTermination()
    said = F.transform("turns", lambda x: F.concat_ws(":", x["turn"].cast("string"), x["role"], F.coalesce(x["text"], F.lit(""))))
    return jobs.current(t.spark, f"{path}/contexts").select("conv_id", F.array_join(said, "|").alias("turns"))
