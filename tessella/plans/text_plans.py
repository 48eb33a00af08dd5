"""Queries of the text, place and process operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import cases, places, process, text_jobs
from tessella.plans.registry import Tables, query

LINES = "lines AS (SELECT doc_id, lang, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS idx FROM documents)"
TERMS, BEFORE, AFTER = ("the", "wh er", "ing", "der", "les"), "no|un", ("ly", "er")
TOPICS, CONTEXTS, ACTIVATORS = ("tion",), ("ent",), ("est", "and")
RULES = (
    {"code": "land", "category": "siting", "high": ("tion of", "ierung"), "context": ("the", "der", "les"), "single_context": True, "single_context_terms": ("der",)},
    {"code": "noise", "category": "impact", "high": ("wher",), "context": ("ing", "ung", "ent"), "single_context": False},
    {"code": "glare", "category": "impact", "high": ("reth", "schein"), "context": (), "standalone": True, "excluded": ("xx",)},
    {"code": "safety", "category": "impact", "high": ("ately",), "context": ("est",), "harm": ("anon", "keit")},
)
NEGATIVE, POSITIVE = ("er", "ich"), ("st", "au")


def lines(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("idx", "line"))


def _hit(term: str, text: str = "text") -> str:
    tight = "".join(term.split())
    return f"(contains({text}, '{term}') OR contains(regexp_replace({text}, '\\s+', '', 'g'), '{tight}'))"


def _active(term: str, text: str = "text") -> str:
    tight = "".join(term.split())
    return f"({_hit(term, text)} AND NOT regexp_matches(regexp_replace({text}, '\\s+', '', 'g'), '(?:{BEFORE}){tight}|{tight}(?:{'|'.join(AFTER)})'))"


def _list(terms: tuple[str, ...], test=_active, text: str = "text") -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {test(x, text)} THEN '{x}' END" for x in terms) + "]::VARCHAR[], lambda x: x IS NOT NULL)"


@query("t1_html_segments")
def _(t: Tables) -> DataFrame:
    return text_jobs.html_segments(t.pages, "page_id", "html", element="article")


@query("t2_clean_text", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(coalesce(text, ''),
 '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&middot;', '·'), '&amp;', '&'),
 '[ \t\r\f\v]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') || ' café – A© <' || doc_id || '>' AS cleaned FROM documents""")
def _(t: Tables) -> DataFrame:
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" x caf&eacute; &#8211; &#x41;&copy; &lt;"), F.col("doc_id").cast("string"), F.lit("&gt; "))
    return t.documents.select("doc_id", F.regexp_replace(X.clean_text(X.unescaped(said)), r" ?x (caf\S+ . \S+ <\d+>)$", " $1").alias("cleaned"))


@query("t3_paragraphs")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(X.paragraphs(F.col("text"), longest=400)).alias("ordinal", "paragraph"))


@query("t4_sentences", r"""
WITH marked AS (
  SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?다요])(\s|$)', '\1' || chr(30) || '\2', 'g'), '(\n+)', '\1' || chr(30), 'g'), chr(30)) AS p FROM documents),
pieces AS (SELECT doc_id, unnest(p) AS raw, generate_subscripts(p, 1) AS i FROM marked),
placed AS (SELECT *, coalesce(sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM pieces),
cut AS (SELECT *, length(raw) - length(regexp_replace(raw, '^\s+', '')) AS l, length(regexp_replace(raw, '\s+$', '')) AS r FROM placed)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i)::INT AS sentence_order, regexp_replace(substr(raw, l + 1, r - l), '[ \t\r\f\v]+', ' ', 'g') AS text,
       (start + l)::INT AS char_start, (start + r)::INT AS char_end
FROM cut WHERE r > l""")
def _(t: Tables) -> DataFrame:
    return text_jobs.sentences(t.documents, ["doc_id"], "text")


@query("t5_speakers", rf"""WITH {LINES}, led AS (SELECT *, regexp_replace(line, '^[*\s]+', '') AS v FROM lines),
parts AS (SELECT doc_id, idx, nullif(regexp_extract(v, '^(?:(The|Der|Les|And)\s*)?([A-Za-z]{{3,9}})', 1), '') AS role, nullif(regexp_extract(v, '^(?:(The|Der|Les|And)\s*)?([A-Za-z]{{3,9}})', 2), '') AS name FROM led)
SELECT doc_id, idx::INT AS idx, CASE WHEN name IS NOT NULL AND name NOT IN ('Released', 'Copyright') THEN role END AS role, CASE WHEN name NOT IN ('Released', 'Copyright') THEN name END AS name FROM parts""")
def _(t: Tables) -> DataFrame:
    who = X.speaker(F.col("line"), ["The", "Der", "Les", "And"], ["Released", "Copyright"], name="[A-Za-z]{3,9}", lead=r"^[*\s]+")
    return lines(t).select("doc_id", "idx", who.alias("s")).select("doc_id", "idx", "s.role", "s.name")


@query("t6_redact", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''),
 '[\p{L}\p{M}\p{Nd}\p{Pc}.+-]+@[\p{L}\p{M}\p{Nd}\p{Pc}.-]+\.[A-Za-z]{2,}', '[이메일]', 'g'),
 '(^|[^0-9])01[016789][- .]?[0-9]{3,4}[- .]?[0-9]{4}($|[^0-9])', '\1[전화번호]\2', 'g'), '(^|[^0-9])[0-9]{6}[- ]?[0-9]{7}($|[^0-9])', '\1[주민등록번호]\2', 'g') AS redacted FROM documents""")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.redact(F.col("text")).alias("redacted"))


@query("t7_mentions", rf"""WITH {LINES},
chars AS (SELECT doc_id, idx, line, list_filter(range(1, length(line) + 1), lambda i: NOT regexp_matches(substr(line, i, 1), '\s')) AS pos, regexp_replace(line, '\s+', '', 'g') AS tight FROM lines),
terms(term, kind) AS (VALUES ('of the', 'phrase'), ('ation', 'suffix'), ('keit', 'suffix'), ('ment', 'suffix')),
hits AS (SELECT doc_id, idx, pos, term, kind, string_split(tight, replace(term, ' ', '')) AS g, length(replace(term, ' ', '')) AS n FROM chars, terms WHERE contains(tight, replace(term, ' ', ''))),
starts AS (SELECT doc_id, idx, pos, term, kind, n, unnest(list_transform(range(1, len(g)), lambda k: list_sum(list_transform(g[1:k], lambda x: length(x))) + (k - 1) * n))::INT AS s FROM hits)
SELECT doc_id, idx::INT AS idx, term, kind, (pos[s + 1] - 1)::INT AS start_offset, pos[s + n]::INT AS end_offset FROM starts""")
def _(t: Tables) -> DataFrame:
    terms = t.spark.createDataFrame([("of the", "phrase"), ("ation", "suffix"), ("keit", "suffix"), ("ment", "suffix")], "term string, kind string")
    return text_jobs.mentions(lines(t), ["doc_id", "idx"], "line", terms)


@query("t8_term_hits", f"SELECT doc_id, array_to_string({_list(TERMS, _hit)}, ',') AS hits FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(X.term_hits(F.col("text"), TERMS), ",").alias("hits"))


@query("t9_active_hits", f"WITH {LINES} SELECT doc_id, idx::INT AS idx, array_to_string({_list(TERMS, _active, 'line')}, ',') AS hits FROM lines")
def _(t: Tables) -> DataFrame:
    return lines(t).select("doc_id", "idx", F.array_join(X.active_hits(F.col("line"), TERMS, BEFORE, AFTER), ",").alias("hits"))


@query("t10_anchor_tiers", f"""WITH {LINES}, tiers AS (SELECT doc_id, idx, {_list(('the', 'wh er'), _active, 'line')} AS a, {_list(TOPICS, _active, 'line')} AS b, {_list(CONTEXTS, _active, 'line')} AS c, {_list(ACTIVATORS, _active, 'line')} AS d FROM lines)
SELECT doc_id, idx::INT AS idx, array_to_string(CASE WHEN len(a) > 0 THEN a WHEN len(b) > 0 THEN b WHEN len(d) > 0 THEN c ELSE [] END, ',') AS anchors FROM tiers""")
def _(t: Tables) -> DataFrame:
    hits = X.anchor_hits(F.col("line"), ("the", "wh er"), TOPICS, CONTEXTS, ACTIVATORS, before=BEFORE, after=AFTER)
    return lines(t).select("doc_id", "idx", F.array_join(hits, ",").alias("anchors"))


def _rule_sql(rule: dict) -> str:
    high, context = _list(rule.get("high", ()), _active, "line"), _list(rule.get("context", ()), _active, "line")
    single = rule.get("single_context_terms", rule.get("context", ())) if rule.get("single_context") else ()
    allowed = "[" + ", ".join(f"'{x}'" for x in single) + "]::VARCHAR[]"
    alone = "len(h) > 0" + "".join(f" AND NOT contains(line, '{x}')" for x in rule.get("excluded", ())) if rule.get("standalone") else "false"
    if rule.get("harm"):
        harm = _list(rule["harm"], _active, "line")
        reason = "CASE WHEN related AND (len(h) > 0 OR len(k) > 0) THEN 'subject_and_harm' END"
        matched = "CASE WHEN len(h) > 0 THEN h ELSE k END"
    else:
        harm = "[]::VARCHAR[]"
        reason = f"CASE WHEN related AND len(h) > 0 THEN 'subject_and_high_term' WHEN related AND len(list_intersect(c, {allowed})) > 0 THEN 'subject_and_term' WHEN related AND len(c) >= 2 THEN 'subject_and_terms' END"
        matched = "CASE WHEN len(h) > 0 THEN h ELSE c END"
    return f"""SELECT doc_id, idx, line, '{rule['code']}' AS issue_code, '{rule['category']}' AS category, polarity, CASE WHEN {alone} THEN 'standalone' ELSE {reason} END AS reason, {matched} AS matched
 FROM (SELECT *, {high} AS h, {context} AS c, {harm} AS k FROM based)"""


ISSUES = f"""{LINES}, based AS (SELECT *, contains(line, 'a') AS related,
 CASE WHEN len({_list(NEGATIVE, _active, 'line')}) > 0 AND len({_list(POSITIVE, _active, 'line')}) > 0 THEN 'mixed' WHEN len({_list(NEGATIVE, _active, 'line')}) > 0 THEN 'opposition'
      WHEN len({_list(POSITIVE, _active, 'line')}) > 0 THEN 'support' ELSE 'neutral' END AS polarity FROM lines),
every AS ({' UNION ALL '.join(_rule_sql(r) for r in RULES)}),
issues AS (SELECT *, CASE WHEN reason = 'subject_and_term' THEN 0.79::DOUBLE ELSE least(0.98::DOUBLE, 0.82::DOUBLE + 0.03::DOUBLE * least(len(list_distinct(matched)), 4)) END AS confidence FROM every WHERE reason IS NOT NULL)"""


def issues(t: Tables) -> DataFrame:
    return text_jobs.issue_labels(lines(t), "line", F.col("line").contains("a"), RULES, NEGATIVE, POSITIVE, before=BEFORE, after=AFTER)


@query("t11_issue_labels", f"WITH {ISSUES} SELECT doc_id, idx::INT AS idx, issue_code, category, polarity, confidence, reason, array_to_string(matched, ',') AS matched FROM issues")
def _(t: Tables) -> DataFrame:
    return issues(t).select("doc_id", "idx", "issue_code", "category", "polarity", "confidence", "reason", F.array_join("matched", ",").alias("matched"))


@query("t12_paragraph_labels", f"""WITH {ISSUES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, issue_code ORDER BY confidence DESC, idx) AS n, count(*) OVER (PARTITION BY doc_id, issue_code) AS evidence FROM issues)
SELECT doc_id, issue_code, polarity, confidence, line AS evidence_text, evidence::INT AS evidence FROM ranked WHERE n = 1""")
def _(t: Tables) -> DataFrame:
    best = text_jobs.paragraph_labels(issues(t), ["doc_id"], "idx", "line")
    return best.select("doc_id", "issue_code", "polarity", "confidence", F.col("evidence").alias("evidence_text"), F.size("evidence_sentences").alias("evidence"))


ADDRESS = "concat(CASE c_custkey % 3 WHEN 0 THEN '전남 ' WHEN 1 THEN '경기도 ' ELSE '' END, CASE c_custkey % 4 WHEN 0 THEN '영암군 ' WHEN 1 THEN '고양시 ' ELSE '' END, CASE c_custkey % 5 WHEN 0 THEN '삼호읍 ' WHEN 1 THEN '덕진면 ' ELSE '' END, CASE c_custkey % 2 WHEN 0 THEN '용앙리 ' ELSE '' END, CASE c_custkey % 7 WHEN 0 THEN '중앙로 12' ELSE '' END)"


@query("t13_addresses", f"""WITH a AS (SELECT c_custkey, regexp_replace(trim({ADDRESS}), '(^| )전남( |$)', '\\1전라남도\\2') AS normalized FROM customer),
p AS (SELECT *, nullif(regexp_extract(normalized, '(전라남도|경기도)', 1), '') AS province FROM a),
q AS (SELECT *, CASE WHEN province IS NOT NULL THEN ltrim(substr(normalized, length(province) + 1)) ELSE normalized END AS rest FROM p),
r AS (SELECT * EXCLUDE (province), coalesce(province, CASE nullif(regexp_extract(rest, '([가-힣]+(?:시|군|구))(?:\\s|$)', 1), '') WHEN '영암군' THEN '전라남도' WHEN '고양시' THEN '경기도' END) AS province, nullif(regexp_extract(rest, '([가-힣]+(?:시|군|구))(?:\\s|$)', 1), '') AS city_county, nullif(regexp_extract(normalized, '([가-힣0-9]+(?:읍|면|동))(?:\\s|$)', 1), '') AS eup_myeon, nullif(regexp_extract(normalized, '([가-힣0-9]+리)(?:\\s|$)', 1), '') AS ri FROM q)
SELECT c_custkey, normalized, province, city_county, eup_myeon, ri, CASE WHEN regexp_matches(normalized, '[0-9]') AND regexp_matches(normalized, '로|길') THEN 'road_address' WHEN ri IS NOT NULL THEN 'ri' WHEN eup_myeon IS NOT NULL THEN 'eup_myeon'
 WHEN city_county IS NOT NULL THEN 'city_county' WHEN province IS NOT NULL THEN 'province' ELSE 'unknown' END AS precision FROM r""")
def _(t: Tables) -> DataFrame:
    parts = X.address_parts(F.expr(ADDRESS), {"전남": "전라남도", "경기": "경기도"}, {"영암군": "전라남도", "고양시": "경기도"})
    return t.customer.select("c_custkey", parts.alias("a")).select("c_custkey", "a.*")


HEADS = r"SELECT DISTINCT regexp_extract(text, '^[A-Z][a-z]{3,}', 0) AS name, 'head' AS place_type, lang AS municipality FROM documents WHERE regexp_matches(text, '^[A-Z][a-z]{3,}')"
MENTIONS = rf"""heads AS ({HEADS}), found AS (SELECT DISTINCT doc_id, lang AS home, unnest(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]{{3,}}')) AS surface FROM documents),
known AS (SELECT f.*, h.place_type, h.municipality, row_number() OVER (PARTITION BY doc_id, surface ORDER BY (municipality IS NOT DISTINCT FROM home) DESC, municipality, place_type) AS pick, count(*) OVER (PARTITION BY doc_id, surface) AS ways
 FROM found f JOIN heads h ON f.surface = h.name),
mentions AS (SELECT doc_id, surface, place_type, municipality, CASE WHEN municipality IS NOT DISTINCT FROM home THEN 'mentioned' ELSE 'comparative' END AS relation,
 CASE WHEN municipality IS NOT DISTINCT FROM home THEN 0.9::DOUBLE WHEN ways > 1 THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM known WHERE pick = 1)"""


def mentioned(t: Tables) -> DataFrame:
    heads = t.documents.select(F.regexp_extract("text", "^[A-Z][a-z]{3,}", 0).alias("name"), F.lit("head").alias("place_type"), F.col("lang").alias("municipality")).filter("name <> ''").distinct()
    return places.place_mentions(t.documents, ["doc_id"], "text", "[A-Z][a-z]{3,}", heads, F.col("lang"))


@query("t14_place_mentions", f"WITH {MENTIONS} SELECT * FROM mentions")
def _(t: Tables) -> DataFrame:
    return mentioned(t)


@query("t15_place_rows", f"""WITH {MENTIONS}, ids AS (SELECT *, sha1('place|' || municipality || '|' || place_type || '|' || surface) AS place_id FROM mentions)
SELECT sha1('mention|' || doc_id || '|' || place_id) AS mention_id, place_id, doc_id, surface, relation AS relation_type, confidence FROM ids""")
def _(t: Tables) -> DataFrame:
    _, found, links = places.place_rows(mentioned(t), ["doc_id"])
    return found.join(links, ["doc_id", "place_id"])


@query("t16_identity_keys", """SELECT doc_id, CASE WHEN contains(text, 'keit') THEN 'quality' WHEN contains(text, 'ment') THEN 'institution' WHEN contains(text, 'tion') THEN 'action' ELSE 'general' END AS facility_type,
 nullif(regexp_extract(text, '([A-Z][a-z]{2,12}) (?:of|der|de)\\b', 1), '') AS project_name FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""")
def _(t: Tables) -> DataFrame:
    kind = X.first_match(F.col("text"), [("keit", "quality"), ("ment", "institution"), ("tion", "action")], "general")
    return t.documents.select("doc_id", kind.alias("facility_type"), X.group_or_null(F.col("text"), r"([A-Z][a-z]{2,12}) (?:of|der|de)\b").alias("project_name"))


ENTITY_PARTS = r"""parts AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Z][a-z]{5,}') AS places, CASE WHEN contains(text, 'keit') THEN 'quality' WHEN contains(text, 'ment') THEN 'institution' ELSE 'general' END AS facility,
 nullif(regexp_extract(text, '([A-Z][a-z]{2,12}) (?:of|der|de)\b', 1), '') AS project FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))"""


def entity_parts(t: Tables) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    facility = X.first_match(F.col("text"), [("keit", "quality"), ("ment", "institution")], "general")
    return t.documents.select("doc_id", F.regexp_extract_all(text, F.lit("[A-Z][a-z]{5,}"), F.lit(0)).alias("places"), facility.alias("facility"), X.group_or_null(F.col("text"), r"([A-Z][a-z]{2,12}) (?:of|der|de)\b").alias("project"))


@query("t16_entity_keys", f"""WITH {ENTITY_PARTS} SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(list_transform(places, lambda p: 'place:' || p), CASE WHEN facility <> 'general' THEN ['facility:' || facility] ELSE [] END,
 CASE WHEN project IS NOT NULL THEN ['project:' || project] ELSE [] END))), ',') AS keys FROM parts""")
def _(t: Tables) -> DataFrame:
    keys = X.entity_keys(F.col("places"), F.col("facility"), "general", F.col("project"))
    return entity_parts(t).select("doc_id", F.array_join(keys, ",").alias("keys"))


@query("a3_cases_by_identity", f"""WITH {ENTITY_PARTS}, k AS (SELECT doc_id, facility, coalesce(nullif(concat_ws('|', 'place:' || places[1], 'project:' || project), ''), 'episode:' || doc_id) AS case_key FROM parts)
SELECT case_key, min(doc_id) AS started_on, max(doc_id) AS ended_on, array_to_string(list_sort(list(DISTINCT facility)), ',') AS issue_types, count(*) AS episodes FROM k GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    rows = entity_parts(t).withColumn("case_key", cases.case_key(F.get("places", F.lit(0)), F.col("project"), F.col("doc_id")))
    out = cases.case_rollup(rows, "case_key", "doc_id", "doc_id", "doc_id", "facility")
    return out.select("case_key", "started_on", "ended_on", F.array_join("issue_types", ",").alias("issue_types"), "episodes")


@query("t17_snippets")
def _(t: Tables) -> DataFrame:
    return text_jobs.snippets(t.documents, ["doc_id"], "text", ["tion", "keit", "ment", "the"], generic=["the"])


@query("t18_numbers_with_units", r"""WITH said AS (SELECT p_partkey, p_name || ' of ' || p_size || ',000' || CASE p_partkey % 3 WHEN 0 THEN ' MW' WHEN 1 THEN ' kW' ELSE '' END || ' in all' AS said FROM part)
SELECT p_partkey, replace(regexp_extract(said, 'of ([0-9][0-9,]*)\s*(MW|kW)?', 1), ',', '')::DOUBLE * CASE regexp_extract(said, 'of ([0-9][0-9,]*)\s*(MW|kW)?', 2) WHEN 'MW' THEN 1000.0 ELSE 1.0 END AS capacity_kw FROM said""")
def _(t: Tables) -> DataFrame:
    said = F.expr("p_name || ' of ' || p_size || ',000' || CASE p_partkey % 3 WHEN 0 THEN ' MW' WHEN 1 THEN ' kW' ELSE '' END || ' in all'")
    return t.part.select("p_partkey", X.number_with_unit(said, r"of ([0-9][0-9,]*)\s*(MW|kW)?", {"mw": 1000.0, "kw": 1.0}).alias("capacity_kw"))


@query("t19_case_type", """WITH n AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), c AS (SELECT doc_id,
 (length(text) - length(replace(text, 'tion', ''))) // 4 + (length(text) - length(replace(text, 'keit', ''))) // 4 AS a, (length(text) - length(replace(text, 'ment', ''))) // 4 + (length(text) - length(replace(text, 'ung', ''))) // 3 AS b, (length(text) - length(replace(text, 'ing', ''))) // 3 AS d FROM n)
SELECT doc_id, CASE WHEN greatest(a, b, d) = 0 THEN NULL WHEN a >= b AND a >= d THEN 'noun' WHEN b >= d THEN 'deed' ELSE 'verb' END AS case_type FROM c""")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.class_by_counts(F.col("text"), {"noun": ["tion", "keit"], "deed": ["ment", "ung"], "verb": ["ing"]}).alias("case_type"))


@query("t20_query_terms", """WITH s(trigger, priority, term, code) AS (VALUES ('the', 1, 'thing', 'x1'), ('and', 2, 'ander', 'x2'), ('tion', 3, 'thing', 'x3'), ('er', 4, 'erheit', 'x2')),
hit AS (SELECT item_id, priority, term, code FROM benchmark JOIN s ON contains(text, trigger)),
a AS (SELECT item_id, term, min(priority) AS p FROM hit GROUP BY ALL), b AS (SELECT item_id, code, min(priority) AS p FROM hit GROUP BY ALL)
SELECT x.item_id, x.terms, y.codes FROM (SELECT item_id, string_agg(term, ',' ORDER BY p) AS terms FROM a GROUP BY 1) x JOIN (SELECT item_id, string_agg(code, ',' ORDER BY p) AS codes FROM b GROUP BY 1) y USING (item_id)""")
def _(t: Tables) -> DataFrame:
    synonyms = t.spark.createDataFrame([("the", 1, "thing", "x1"), ("and", 2, "ander", "x2"), ("tion", 3, "thing", "x3"), ("er", 4, "erheit", "x2")], "trigger string, priority int, term string, code string")
    out = text_jobs.expand_terms(t.benchmark, ["item_id"], "text", synonyms)
    return out.select("item_id", F.array_join("terms", ",").alias("terms"), F.array_join("codes", ",").alias("codes"))


@query("t21_flattened_elements", """SELECT o_custkey, format('{:05d}.{:05d}', dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) - 1) AS path,
 l_returnflag AS text, l_linenumber AS page FROM orders JOIN lineitem ON l_orderkey = o_orderkey
UNION ALL SELECT o_custkey, format('{:05d}', row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1), o_orderstatus, 0 FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def _(t: Tables) -> DataFrame:
    kids = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))).alias("k"))
    kids = kids.select("l_orderkey", F.transform("k", lambda x: F.struct(x["l_returnflag"].alias("text"), x["l_linenumber"].alias("page"))).alias("kids"))
    tree = t.orders.join(kids, F.col("o_orderkey") == F.col("l_orderkey"))
    tree = tree.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_orderstatus").alias("text"), F.lit(0).alias("page"), "kids"))).alias("kids"))
    return text_jobs.flatten_elements(tree, ["o_custkey"], "kids")


@query("t21_parser_trees", """WITH l AS (SELECT l_orderkey, l_returnflag, l_linestatus, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) - 1 AS i FROM lineitem),
e AS (SELECT o_orderkey, o_orderkey % 3 + 1 AS page, '0' || format('{:08d}', 0) AS path, 'Order  of' || chr(10) || o_orderstatus AS text FROM orders WHERE o_orderkey % 4 > 0
 UNION ALL SELECT l_orderkey, l_linenumber, '000000000.0' || format('{:08d}', i), l_returnflag FROM l WHERE l_returnflag <> 'N' UNION ALL SELECT l_orderkey, 1, '000000000.0' || format('{:08d}', i) || '.100000000', l_linestatus FROM l)
SELECT o_orderkey, page::INT AS page, string_agg(regexp_replace(text, '\\s+', ' ', 'g'), chr(10) ORDER BY path) AS text FROM e GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    """A file for each order: the order (a fourth of them without content), in it its lines, in each of these a list item without a page."""
    item = lambda x: F.array(F.struct(x["l_linestatus"].alias("content")))
    node = lambda x: F.struct(F.when(x["l_returnflag"] != "N", x["l_returnflag"]).alias("content"), x["l_linenumber"].alias("page number"), item(x).alias("list items"))
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus"))).alias("x"))
    lines = lines.select("l_orderkey", F.transform("x", node).alias("kids"))
    order = F.struct(F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit("Order  of\n"), "o_orderstatus")).alias("content"), (F.col("o_orderkey") % 3 + 1).alias("page number"), "kids")
    files = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.to_json(F.struct(F.array(order).alias("kids"))).alias("file"))
    return text_jobs.tree_pages(text_jobs.tree_elements(files, ["o_orderkey"], "file"), ["o_orderkey"])


@query("w15_running_offsets", f"""WITH {LINES}, placed AS (SELECT doc_id, idx, length(line) AS n, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM lines)
SELECT doc_id, idx::INT AS idx, char_start, char_start + n AS char_end FROM placed""")
def _(t: Tables) -> DataFrame:
    return text_jobs.running_offsets(lines(t), ["doc_id"], ["idx"], "line").select("doc_id", "idx", "char_start", "char_end")


PATTERNS = [("received", 1, "thon|the "), ("received", 2, "der "), ("reviewed", 1, "ing\\b"), ("decided", 1, "ent"), ("recurred", 1, "les|est")]
STAGES = (("ate", "rejected", "confirmed", ()), ("ion", "approved", "confirmed", ("decided",)), ("er", "planned", "inferred", ()), ("", "reported", "confirmed", ("received",)), ("", "observed", "confirmed", ()))
EVENTS = f"""{LINES}, src AS (SELECT DISTINCT doc_id, line FROM lines), pats(event_type, priority, pattern) AS (VALUES {', '.join(f"('{a}', {b}, '{c}')" for a, b, c in PATTERNS)}),
hit AS (SELECT doc_id, line, event_type, arg_min(pattern, priority) AS pattern FROM src JOIN pats ON regexp_matches(line, pattern) GROUP BY ALL),
process AS (SELECT doc_id, event_type, pattern, try_cast(CASE WHEN regexp_extract(line, '(20[0-9]{{2}})-([0-9]{{1,2}})-([0-9]{{1,2}})', 0) <> '' THEN regexp_extract(line, '(20[0-9]{{2}})-([0-9]{{1,2}})-([0-9]{{1,2}})', 0) END AS DATE) AS event_date,
 CASE WHEN contains(line, 'sch') THEN 'office' WHEN contains(line, 'ou') THEN 'resident' END AS actor,
 CASE WHEN contains(line, 'ate') THEN 'rejected' WHEN contains(line, 'ion') AND event_type = 'decided' THEN 'approved' WHEN contains(line, 'er') THEN 'planned' WHEN event_type = 'received' THEN 'reported' ELSE 'observed' END AS outcome, line AS evidence_text FROM hit)"""


def process_events(t: Tables) -> DataFrame:
    patterns = t.spark.createDataFrame(PATTERNS, "event_type string, priority int, pattern string")
    return process.process_events(lines(t), ["doc_id"], "line", patterns, F.lit(None).cast("date"), [("office", "sch"), ("resident", "ou")], outcomes=STAGES, date_pattern=r"(20\d{2})-(\d{1,2})-(\d{1,2})")


@query("e1_process_events", f"WITH {EVENTS} SELECT doc_id, event_type, pattern, evidence_text FROM process")
def _(t: Tables) -> DataFrame:
    return process_events(t).select("doc_id", "event_type", "pattern", "evidence_text")


@query("e2_event_dates", r"""SELECT event_id, coalesce(try_strptime(regexp_extract(props || ' 2024-' || (event_id % 15) || '-' || (event_id % 33), '20[0-9]{2}-[0-9]{1,2}-[0-9]{1,2}', 0), '%Y-%m-%d')::DATE, ts::DATE) AS event_date FROM events""")
def _(t: Tables) -> DataFrame:
    said = F.expr("props || ' 2024-' || (event_id % 15) || '-' || (event_id % 33)")
    return t.events.select("event_id", process.event_date(said, F.to_date("ts"), r"(20\d{2})-(\d{1,2})-(\d{1,2})").alias("event_date"))


@query("e3_actors", f"WITH {EVENTS} SELECT doc_id, event_type, actor, evidence_text FROM process")
def _(t: Tables) -> DataFrame:
    return process_events(t).select("doc_id", "event_type", "actor", "evidence_text")


@query("e4_outcomes", f"WITH {EVENTS} SELECT doc_id, event_type, evidence_text, outcome, CASE outcome WHEN 'planned' THEN 'inferred' ELSE 'confirmed' END AS certainty, CASE outcome WHEN 'planned' THEN 0.72::DOUBLE ELSE 0.86::DOUBLE END AS confidence FROM process")
def _(t: Tables) -> DataFrame:
    return process_events(t).select("doc_id", "event_type", "evidence_text", "outcome", "certainty", "confidence")


@query("e5_case_events", f"WITH {EVENTS} SELECT d.source AS case_id, p.doc_id, event_type, outcome, CASE WHEN l.toxic = 1 THEN 'synthetic' ELSE 'meeting_record' END AS data_origin, evidence_text FROM process p JOIN documents d USING (doc_id) LEFT JOIN labels l USING (doc_id)")
def _(t: Tables) -> DataFrame:
    evidence = t.documents.select(F.col("source").alias("case_id"), "doc_id").join(t.labels.select("doc_id", "toxic"), "doc_id", "left")
    return process.attach_to_cases(process_events(t), evidence, "doc_id", F.col("toxic") == 1).select("case_id", "doc_id", "event_type", "outcome", "data_origin", "evidence_text")
