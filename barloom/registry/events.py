"""Verified queries on filings, headlines, repeats and near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.functions import event_rules as er
from barloom.functions import text_events as te
from barloom.functions.literals import folded
from barloom.operators import dedup, events, linking, screen
from barloom.registry.core import query
from barloom.registry.market import rounded
from barloom.registry.companies import REACTION
from barloom.session import spread
from barloom.sources import feeds
from barloom.sources.bindings import OUTLETS, bars_daily, document_items, filings, headline_sql, table

NOW = "2001-08-02 00:00:00"

# ---- SQL building blocks ------------------------------------------------------------------------------


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def hit_sql(text: str, pattern: str) -> str:
    """RE2 has no look-ahead: what must not follow is cut out first."""
    if pattern.endswith(r"(?![^.]{0,20}\bcredit)"):
        core = pattern[: -len(r"(?![^.]{0,20}\bcredit)")]
        return f"regexp_matches(regexp_replace({text}, {q('(?i)' + core + chr(92) + 's?[^.]{0,20}' + chr(92) + 'bcredit')}, '', 'g'), {q('(?i)' + core)})"
    if "(?!" in pattern:
        core, banned = pattern.split("(?!", 1)
        return f"regexp_matches(regexp_replace({text}, {q('(?i)' + core + banned[:-1])}, '', 'g'), {q('(?i)' + core)})"
    return f"regexp_matches({text}, {q('(?i)' + pattern)})"


def rule_sql(text: str) -> str:
    whens = " ".join(f"WHEN {' OR '.join(hit_sql(text, p) for p in rule[4])} THEN {i}" for i, rule in enumerate(er.RULES))
    return f"CASE {whens} ELSE -1 END"


def matched_sql(text: str, number: str) -> str:
    def first(p: str) -> str:
        return f"nullif(regexp_extract({text}, {q('(?i)' + p.split('(?!')[0])}), '')"

    whens = " ".join(f"WHEN {i} THEN coalesce({', '.join(first(p) for p in rule[4])})" for i, rule in enumerate(er.RULES))
    return f"CASE {number} {whens} ELSE '' END"


def pick_sql(number: str, position: int) -> str:
    values = ", ".join(q(x[position]) if isinstance(x[position], str) else f"{x[position]}" for x in [*er.RULES, er.OTHER])
    return f"[{values}][CASE WHEN {number} < 0 THEN {len(er.RULES) + 1} ELSE {number} + 1 END]"


def count_sql(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {q('(?i)' + pattern)}))"


def tone_sql(text: str) -> str:
    positive = er.POSITIVE.replace("(?! warning)", "")
    return f"sign({count_sql(text, positive)} - {count_sql(text, chr(92) + 'bprofit warning')} - {count_sql(text, er.NEGATIVE)})"


AMOUNT_RE2 = f"(?i)({er.AMOUNT_CURRENCY})?\\s*({er.AMOUNT_NUMBER})\\s*({er.AMOUNT_UNIT})?({er.AMOUNT_NOT_MONEY})?"


def amounts_sql(text: str, bare: str) -> str:
    part = lambda i: f"regexp_extract_all({text}, {q(AMOUNT_RE2)}, {i})"
    one = f"""CASE WHEN h.u <> '' AND h.x = '' THEN round(CAST(replace(h.n, ',', '') AS DOUBLE) * CASE WHEN h.u IN ('lakh crore', 'lakh cr') THEN 1e5 WHEN h.u = 'thousand crore' THEN 1e3
      WHEN h.u LIKE 'cr%' THEN 1 WHEN h.u LIKE 'lakh%' OR h.u LIKE 'lac%' THEN 0.01::DOUBLE WHEN h.u IN ('billion', 'bn') THEN 100 ELSE 0.1::DOUBLE END
      * CASE WHEN h.c IN ('usd', 'us$', '$') THEN 88.0::DOUBLE WHEN h.c IN ('eur', '€') THEN 95.04::DOUBLE ELSE 1 END, 2)
     WHEN h.c <> '' AND {bare} AND CAST(replace(h.n, ',', '') AS DOUBLE) >= 1000 THEN round(CAST(replace(h.n, ',', '') AS DOUBLE) / 1e7 * CASE WHEN h.c IN ('usd', 'us$', '$') THEN 88.0::DOUBLE WHEN h.c IN ('eur', '€') THEN 95.04::DOUBLE ELSE 1 END, 6) END"""
    return f"""list_transform(list_transform(list_zip({part(1)}, {part(2)}, {part(3)}, {part(4)}), lambda z: {{'c': lower(coalesce(z[1], '')), 'n': z[2], 'u': lower(coalesce(z[3], '')), 'x': coalesce(z[4], '')}}), lambda h: {one})"""


ITEMS = f"""items AS (SELECT o_orderkey AS item_id, 'Brand#' || (1 + o_custkey % 25) AS company_id, o_orderdate + INTERVAL (o_orderkey % 1440) MINUTE AS ts,
  head || CASE WHEN o_custkey % 8 <> 0 AND o_custkey % 3 = 0 THEN ' - ' || src ELSE '' END AS title, head,
  CASE WHEN o_custkey % 8 = 0 THEN 'Reference ' || o_orderpriority ELSE '' END AS text, CASE WHEN o_orderkey % 5 = 0 THEN 'Press Release' ELSE 'General' END AS category,
  src AS source, CASE WHEN o_custkey % 8 = 0 THEN 'exchange' ELSE 'media' END AS source_type,
  CASE WHEN o_custkey % 25 % 4 <> 0 THEN 20000.0::DOUBLE + 1000 * (o_custkey % 25) END AS revenue, CASE WHEN o_custkey % 25 % 3 <> 0 THEN 500000.0::DOUBLE + 10000 * (o_custkey % 25) END AS mcap
  FROM (SELECT *, {headline_sql()} AS head, {OUTLETS}[o_custkey % 8 + 1] AS src FROM orders)),
cls0 AS (SELECT *, head || '. ' || text AS body FROM items),
cls1 AS (SELECT *, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS flat FROM cls0),
cls2 AS (SELECT *, {rule_sql('flat')} AS rule FROM cls1),
cls AS (SELECT *, CASE WHEN rule < 0 AND contains(lower(category), 'press release') THEN 'company_update' ELSE {pick_sql('rule', 0)} END AS event_type,
  CASE WHEN rule < 0 AND contains(lower(category), 'press release') THEN 'Company update' ELSE {pick_sql('rule', 1)} END AS event_label,
  {pick_sql('rule', 2)} AS rule_direction, CAST(CASE WHEN rule < 0 AND contains(lower(category), 'press release') THEN 0.25 ELSE {pick_sql('rule', 3)} END AS DOUBLE) AS base,
  {matched_sql('flat', 'rule')} AS matched FROM cls2)"""

ORDERS = ", ".join(q(x) for x in er.ORDER_TYPES)
SIZES = ", ".join(q(x) for x in er.SIZE_TYPES)
TONES = ", ".join(q(x) for x in er.TONE_TYPES)

MEASURE = f"""{ITEMS},
am0 AS (SELECT *, {amounts_sql('body', "event_type = 'regulatory_action'")} AS hits, regexp_split_to_array(body, {q(AMOUNT_RE2)}) AS gaps, regexp_extract_all(body, {q(AMOUNT_RE2)}) AS wholes FROM cls),
am1 AS (SELECT *, list_filter(hits, lambda v: v IS NOT NULL) AS amounts,
  list_transform(range(1, len(hits) + 1), lambda i: {{'v': hits[i], 'run': regexp_matches(right(array_to_string(list_transform(range(1, i + 1), lambda j: gaps[j] || CASE WHEN j < i THEN wholes[j] ELSE '' END), ''), 45), {q('(?i)' + er.RUNNING_TOTAL)})}}) AS steps,
  CAST(nullif(regexp_extract(body, {q('(?i)' + er.PERIOD)}, 1), '') AS DOUBLE) AS pn, lower(regexp_extract(body, {q('(?i)' + er.PERIOD)}, 2)) AS pu,
  coalesce(nullif(regexp_extract(body, {q('(?i)' + er.BY_YEAR)}, 1), ''), nullif(regexp_extract(body, {q('(?i)' + er.BY_YEAR)}, 2), '')) AS fy,
  list_filter(list_transform(regexp_extract_all(body, {q(er.CLIENT_CASE_SENSITIVE)}, 1), lambda c: trim(c, ' .,-')), lambda c: len(c) >= 3 AND len(list_filter(regexp_split_to_array(c, '\\s+'), lambda w: w NOT IN ('of', 'and', 'for', ''))) > 0
    AND list_filter(regexp_split_to_array(c, '\\s+'), lambda w: w NOT IN ('of', 'and', 'for', ''))[1] NOT IN ({', '.join(q(x) for x in er.CLIENT_STOP)})) AS names FROM am0),
am2 AS (SELECT *, CASE WHEN pu LIKE 'y%' THEN pn * 12 WHEN pu LIKE 'd%' THEN pn / 30 WHEN pu LIKE 'w%' THEN pn / 4.3::DOUBLE ELSE pn END AS months0,
  (CAST(fy AS INT) + CASE WHEN len(fy) = 2 THEN 2000 ELSE 0 END - year(ts + INTERVAL 330 MINUTE)) * 12 + 3 - month(ts + INTERVAL 330 MINUTE) AS fy_months FROM am1),
am3 AS (SELECT *, CASE WHEN event_type IN ({ORDERS}) THEN coalesce(list_filter(steps, lambda s: s.v IS NOT NULL AND NOT s.run)[1].v, list_filter(steps, lambda s: s.v IS NOT NULL)[1].v) END AS order_value_cr,
  CASE WHEN event_type IN ({ORDERS}) THEN CASE WHEN months0 BETWEEN 0.5 AND 180 THEN round(months0, 1) WHEN fy_months BETWEEN 1 AND 180 THEN fy_months END END AS execution_months,
  CASE WHEN event_type IN ({ORDERS}) THEN regexp_replace(names[1], '(\\s+(of|and|for))+$', '') END AS client,
  CASE WHEN event_type NOT IN ({ORDERS}) THEN list_max(amounts) END AS amount_cr FROM am2),
am4 AS (SELECT *, CASE WHEN order_value_cr <> 0 AND revenue > 0 THEN round(100 * order_value_cr / revenue, 2) END AS order_pct_revenue,
  CASE WHEN order_value_cr <> 0 AND revenue > 0 AND execution_months IS NOT NULL THEN CASE WHEN execution_months >= 12 THEN round(100 * (order_value_cr / greatest(execution_months / 12, 1.0::DOUBLE / 12)) / revenue, 2) ELSE round(100 * order_value_cr / revenue, 2) END END AS annualised_pct_revenue,
  100 * nullif(amount_cr, 0) / mcap AS share, regexp_matches(body, {q('(?i)' + er.SENIOR_EXIT)}) AS senior, regexp_matches(body, {q('(?i)' + er.AUDITOR_EXIT)}) AS auditor,
  regexp_matches(body, {q('(?i)' + er.SEVERE)}) AS severe, regexp_matches(title, {q('(?i)' + er.RUMOUR)}) AS rumour, lower(source) AS src FROM am3),
am5 AS (SELECT *, CAST(CASE WHEN event_type IN ({TONES}) THEN {tone_sql('body')} WHEN event_type = 'fund_raising' THEN CASE WHEN regexp_matches(body, {q('(?i)' + er.DILUTIVE)}) THEN -1 ELSE 0 END
    WHEN event_type = 'management_change' THEN CASE WHEN senior THEN -1 ELSE 0 END ELSE rule_direction END AS INT) AS direction,
  CAST(CASE WHEN event_type = 'regulatory_action' THEN CASE WHEN severe THEN 0.85 WHEN coalesce(amount_cr, 0) = 0 THEN 0.45 WHEN amount_cr < 5 OR coalesce(share < 0.1::DOUBLE, false) THEN 0.15 ELSE base END
    WHEN event_type = 'management_change' THEN CASE WHEN auditor THEN 0.8 WHEN senior THEN 0.6 ELSE 0.15 END
    WHEN event_type IN ({ORDERS}) THEN CASE WHEN coalesce(annualised_pct_revenue, order_pct_revenue) IS NOT NULL THEN 0.2::DOUBLE + 0.8::DOUBLE * least(coalesce(nullif(annualised_pct_revenue, 0), order_pct_revenue) / 30, 1)
      WHEN coalesce(order_value_cr, 0) <> 0 THEN base ELSE 0.30 END
    WHEN event_type = 'fund_raising' AND share IS NOT NULL THEN 0.2::DOUBLE + 0.8::DOUBLE * least(share / 15, 1)
    WHEN event_type IN ({SIZES}) AND share IS NOT NULL THEN greatest(base, 0.2::DOUBLE + 0.8::DOUBLE * least(share / 5, 1)) ELSE base END AS DOUBLE) AS m,
  CASE WHEN event_type IN ({SIZES}, 'fund_raising') THEN round(share, 2) END AS pct_of_mcap,
  CAST(CASE WHEN source_type = 'exchange' THEN 1.0 ELSE least(CASE WHEN rumour THEN 0.30 ELSE 1 END, CASE WHEN src IN ({', '.join(q(x) for x in er.WIRES)}) OR contains(src, lower(company_id)) OR contains(lower(title), 'press release') THEN 0.85
    WHEN src IN ({', '.join(q(x) for x in er.TIER_ONE)}) THEN 0.70 ELSE 0.50 END) END AS DOUBLE) AS reliability FROM am4),
measured AS (SELECT *, round(least(m, 1), 2) AS materiality, CASE WHEN m >= 0.6::DOUBLE THEN 'high' WHEN m >= 0.35::DOUBLE THEN 'medium' ELSE 'low' END AS materiality_label,
  CASE WHEN source_type = 'exchange' THEN 'Exchange filing' WHEN rumour THEN 'Unverified report' WHEN reliability = 0.85::DOUBLE THEN 'Company statement' WHEN reliability = 0.70::DOUBLE THEN 'Reputable media' ELSE 'Media' END AS reliability_label FROM am5)"""

STOP = "[" + ", ".join(q(x) for x in er.NOVELTY_STOP) + "]"


def novelty_sql(source: str, amount: str) -> str:
    return f"""nv AS MATERIALIZED (SELECT item_id, company_id, event_type, ts, {amount} AS amt, list_filter(list_distinct(regexp_extract_all(lower(title || ' ' || text), '[a-z0-9]+')), lambda w: NOT list_contains({STOP}, w)) AS tk
  FROM {source} WHERE event_type NOT IN ('routine', 'price_commentary')),
pr AS (SELECT a.item_id, b.item_id AS other, b.ts AS other_ts, a.amt AS va, b.amt AS vb, a.ts - b.ts AS gap, a.event_type AS kind, a.tk AS ta, b.tk AS tb
  FROM nv a JOIN nv b ON a.company_id = b.company_id AND a.event_type = b.event_type AND b.ts >= a.ts - INTERVAL 10 DAY AND (b.ts < a.ts OR (b.ts = a.ts AND b.item_id < a.item_id))),
ok AS (SELECT item_id, other, other_ts FROM pr WHERE coalesce(abs(va - vb) <= 0.03::DOUBLE * vb, false)
  OR (kind <> 'other' AND NOT coalesce(abs(va - vb) > 0.03::DOUBLE * vb, false) AND gap <= CASE WHEN kind = 'earnings' THEN INTERVAL 3 DAY ELSE INTERVAL 2 DAY END)
  OR (len(ta) > 0 AND len(tb) > 0 AND len(list_intersect(ta, tb)) / (len(ta) + len(tb) - len(list_intersect(ta, tb))) >= 0.45::DOUBLE)),
par AS MATERIALIZED (SELECT item_id, arg_min(other, (other_ts, other)) AS parent FROM ok GROUP BY item_id),
chain AS (SELECT item_id, parent AS root FROM par UNION ALL SELECT c.item_id, p.parent FROM chain c JOIN par p ON p.item_id = c.root),
roots AS MATERIALIZED (SELECT c.item_id, c.root FROM chain c WHERE c.root NOT IN (SELECT item_id FROM par))"""


AMT = "coalesce(nullif(order_value_cr, 0), nullif(amount_cr, 0))"
NOVEL = f"""{MEASURE}, {novelty_sql('measured', AMT)},
novel AS MATERIALIZED (SELECT m.*, r.root AS repeat_of, CAST(CASE WHEN r.root IS NULL THEN 1.0 WHEN epoch(m.ts) - epoch(z.ts) < 172800 THEN 0.15 ELSE 0.10 END AS DOUBLE) AS novelty
  FROM measured m LEFT JOIN roots r USING (item_id) LEFT JOIN items z ON z.item_id = r.root)"""
SHARED = f"""{NOVEL}, st AS (SELECT *, coalesce(repeat_of, item_id) AS story, {AMT} IS NOT NULL AS sized FROM novel),
ref AS (SELECT story, first(struct_pack(ov := order_value_cr, am := amount_cr, op := order_pct_revenue, ap := annualised_pct_revenue, em := execution_months, cl := client, pm := pct_of_mcap, ma := materiality, ml := materiality_label)
  ORDER BY reliability DESC, ts, item_id) AS f FROM st WHERE sized GROUP BY story),
shared AS (SELECT st.* EXCLUDE (order_value_cr, amount_cr, materiality, materiality_label, order_pct_revenue),
  CASE WHEN sized OR f IS NULL THEN order_value_cr ELSE coalesce(f.ov, order_value_cr) END AS order_value_cr, CASE WHEN sized OR f IS NULL THEN amount_cr ELSE coalesce(f.am, amount_cr) END AS amount_cr,
  CASE WHEN sized OR f IS NULL THEN order_pct_revenue ELSE coalesce(f.op, order_pct_revenue) END AS order_pct_revenue,
  CASE WHEN sized OR f IS NULL THEN materiality ELSE f.ma END AS materiality, CASE WHEN sized OR f IS NULL THEN materiality_label ELSE f.ml END AS materiality_label,
  NOT sized AND f IS NOT NULL AS took FROM st LEFT JOIN ref USING (story))"""
IMPACT = f"""{SHARED}, {REACTION}, ev_moved AS (SELECT s.*, round(x.pre_move, 4) AS pre_move, round(x.pre_move_z, 2) AS z FROM shared s LEFT JOIN reaction x ON x.k = s.item_id),
priced AS (SELECT *, CASE WHEN direction <> 0 AND coalesce(sign(z) = direction AND abs(z) > 1, false) THEN least((abs(z) - 1) / 2, 1) ELSE 0 END AS p FROM ev_moved),
scored_events AS MATERIALIZED (SELECT *, round(p, 2) AS priced_in, round(direction * materiality * novelty * reliability * (1 - 0.6::DOUBLE * p), 3) + CAST(0 AS DOUBLE) AS impact FROM priced)"""


# ---- shared frames ----------------------------------------------------------------------------------------

def measured_items(spark, sf_dir) -> DataFrame:
    return events.measure(events.classify(filings(spark, sf_dir)).drop("matched"))


def analysed(spark, sf_dir) -> DataFrame:
    return events.analyse(filings(spark, sf_dir), bars_daily(spark, sf_dir))


# ---- reading one text ---------------------------------------------------------------------------------------

@query("evt01_classify", f"WITH {ITEMS} SELECT item_id, event_type, event_label, CAST(rule_direction AS BIGINT) AS direction, base, matched FROM cls")
def classify(spark, sf_dir):
    return events.classify(filings(spark, sf_dir)).select(
        "item_id", "event_type", "event_label", F.col("rule_direction").cast("long").alias("direction"),
        F.col("base_materiality").alias("base"), "matched")


PLAIN = "regexp_replace(text, '[À-ÖØ-öø-ÿŒœŸß]', 'z', 'g')"


@query("evt01_classify_documents", f"""WITH d AS (SELECT doc_id, trim(regexp_replace({PLAIN}, '\\s+', ' ', 'g')) AS flat FROM documents), c AS (SELECT doc_id, {rule_sql('flat')} AS rule FROM d)
SELECT doc_id, {pick_sql('rule', 0)} AS event_type FROM c""")
def classify_documents(spark, sf_dir):
    """Whole documents, up to their last word."""
    flat = spread(table(spark, sf_dir, "documents")).select("doc_id", te.squeeze(F.col("text")).alias("flat"))
    flat = flat.withColumn("fold", folded(F.col("flat")))
    return flat.select("doc_id", te.of_rule(te.rule_number(F.col("flat"), F.col("fold")), 0).alias("event_type"))


@query("evt02_strip_publisher", f"WITH {ITEMS} SELECT item_id, head AS title FROM items")
def strip_publisher(spark, sf_dir):
    f = filings(spark, sf_dir)
    return f.select("item_id", F.when(F.col("source_type") == "exchange", F.col("title")).otherwise(
        te.strip_publisher(F.col("title"), F.col("source"))).alias("title"))


PAGE_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query("evt02_headline_titles", f"""SELECT page_id, trim(CASE WHEN t LIKE '% - ' || lang THEN left(t, len(t) - len(lang) - 3) ELSE regexp_replace(t, '\\s*[-|–—]\\s*[^-|–—]+$', '') END) AS title FROM (
  SELECT page_id, lang, replace(replace(replace(CASE WHEN page_id % 2 = 0 THEN title || ' - ' || lang WHEN page_id % 3 = 0 THEN title || ' | News Desk' ELSE title END, '&amp;', '&'), '&quot;', '"'), '&#39;', '''') AS t
  FROM (SELECT page_id, {PAGE_TITLE} AS title, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang FROM pages))""")
def headline_titles(spark, sf_dir):
    return page_headlines(spark, sf_dir).select("page_id", te.headline_title(F.col("title"), F.col("source")).alias("title"))


def page_headlines(spark, sf_dir) -> DataFrame:
    """Page titles as headlines of outlets named by language; half carry the outlet, a third of the rest a desk."""
    p = table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("t"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("source"))
    return p.select(
        "page_id", "source", F.when(F.col("page_id") % 2 == 0, F.concat_ws(" - ", "t", "source"))
        .when(F.col("page_id") % 3 == 0, F.concat("t", F.lit(" | News Desk"))).otherwise(F.col("t")).alias("title"))


@query("evt03_tone", f"""WITH {ITEMS} SELECT 'filing' AS kind, item_id AS id, CAST({tone_sql('body')} AS BIGINT) AS tone FROM cls0 UNION ALL
SELECT 'document', doc_id, CAST({tone_sql(PLAIN)} AS BIGINT) FROM documents""")
def tone(spark, sf_dir):
    """Filings and whole documents."""
    f = events.classify(filings(spark, sf_dir)).select(F.lit("filing").alias("kind"), F.col("item_id").alias("id"), te.tone(F.col("body")).cast("long").alias("tone"))
    d = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), te.tone(F.col("text")).cast("long").alias("tone"))
    return f.unionByName(d)


@query("evt04_amounts", f"""WITH {ITEMS} SELECT item_id, array_to_string(list_transform(list_filter({amounts_sql('body', 'false')}, lambda v: v IS NOT NULL), lambda v: printf('%.2f', v)), ' ') AS amounts FROM cls0""")
def amounts(spark, sf_dir):
    return events.classify(filings(spark, sf_dir)).select("item_id", F.concat_ws(" ", F.transform(
        te.amounts_in_crore(F.col("body")), lambda v: F.format_string("%.2f", v))).alias("amounts"))


@query("evt05_06_07_08_order_facts", f"""WITH {MEASURE} SELECT item_id, order_value_cr, CAST(execution_months AS DOUBLE) AS execution_months, client, order_pct_revenue, annualised_pct_revenue
FROM measured WHERE event_type IN ({ORDERS})""")
def order_facts(spark, sf_dir):
    m = measured_items(spark, sf_dir).filter(F.col("event_type").isin(*er.ORDER_TYPES))
    return m.select("item_id", "order_value_cr", "execution_months", "client", "order_pct_revenue", "annualised_pct_revenue")


@query("evt10_11_materiality", f"""WITH {MEASURE} SELECT item_id, CAST(direction AS BIGINT) AS direction, amount_cr, pct_of_mcap, materiality, materiality_label FROM measured""")
def materiality(spark, sf_dir):
    return measured_items(spark, sf_dir).select("item_id", F.col("direction").cast("long").alias("direction"), "amount_cr", "pct_of_mcap", "materiality", "materiality_label")


@query("evt12_reliability", f"WITH {MEASURE} SELECT item_id, reliability, reliability_label FROM measured")
def reliability(spark, sf_dir):
    score, label = te.reliability(F.col("source_type"), F.col("source"), F.col("title"), F.col("company"))
    return filings(spark, sf_dir).select("item_id", score.cast("double").alias("reliability"), label.alias("reliability_label"))


# ---- repeats, sizes, impact --------------------------------------------------------------------------------------

@query("evt09_jon10_novelty", f"WITH RECURSIVE {NOVEL} SELECT item_id, CAST(repeat_of AS DOUBLE) AS repeat_of, novelty FROM novel")
def novelty(spark, sf_dir):
    return events.mark_novelty(measured_items(spark, sf_dir)).select("item_id", F.col("repeat_of").cast("double").alias("repeat_of"), "novelty")


@query("evt09_document_repeats", f"""WITH RECURSIVE m AS (SELECT doc_id AS item_id, 'Brand#' || (1 + doc_id % 25) AS company_id, 'other' AS event_type,
  TIMESTAMP '2001-01-01' + INTERVAL (doc_id * 10) MINUTE AS ts, regexp_extract(text, '^[^.\\n]*') AS title, text FROM documents),
{novelty_sql('m', 'CAST(NULL AS DOUBLE)')} SELECT item_id, root AS repeat_of FROM roots""")
def document_repeats(spark, sf_dir):
    """Word overlap of whole documents: all are untyped news, so only shared words make a repeat."""
    words = te.long_text_words(F.concat_ws(" ", "title", "text"), er.NOVELTY_STOP)
    d = document_items(spark, sf_dir).select(
        "item_id", "company_id", F.lit("other").alias("event_type"), "ts", F.lit(None).cast("double").alias("amount"), words.alias("tokens"))
    return events.novelty_links(d).select("item_id", F.col("root.id").alias("repeat_of"))


@query("jon12_shared_sizes", f"WITH RECURSIVE {SHARED} SELECT item_id, order_value_cr, amount_cr, order_pct_revenue, materiality, materiality_label, took FROM shared")
def shared_sizes(spark, sf_dir):
    s = events.share_sizes(events.mark_novelty(measured_items(spark, sf_dir)))
    took = F.exists("reasons", lambda x: x.startswith("size taken from linked report"))
    return s.select("item_id", "order_value_cr", "amount_cr", "order_pct_revenue", "materiality", "materiality_label", took.alias("took"))


@query("evt13_14_event_impact", f"WITH RECURSIVE {IMPACT} SELECT item_id, event_type, CAST(direction AS BIGINT) AS direction, novelty, reliability, materiality, priced_in > 0 AS ran_up, impact FROM scored_events")
def event_impact(spark, sf_dir):
    return analysed(spark, sf_dir).select("item_id", "event_type", F.col("direction").cast("long").alias("direction"), "novelty", "reliability",
                                          "materiality", (F.col("priced_in") > 0).alias("ran_up"), *rounded("impact", digits=3))


@query("evt14_item_times", f"""WITH {ITEMS}, o AS (SELECT item_id, ts, item_id % 5 AS k FROM items)
SELECT item_id, strftime(CASE k WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN TIMESTAMP '{NOW}' - INTERVAL 36 HOUR
  ELSE TIMESTAMP '{NOW}' - INTERVAL 24 HOUR END, '%Y-%m-%d %H:%M:%S') AS ts FROM o""")
def item_times(spark, sf_dir):
    """A feed whose times are text with and without a zone, hours, an unreadable text or nothing, read before items are typed and measured."""
    f = filings(spark, sf_dir)
    k = F.col("item_id") % 5
    local = F.from_utc_timestamp("ts", "Asia/Kolkata")
    told = f.withColumns({
        "time": F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).when(k == 1, F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss")).when(k == 3, F.lit("soon")),
        "hours_ago": F.when(k == 2, 36.0).when(k == 4, 0.0)}).drop("ts")
    out = events.measure(events.classify(events.parse_times(told, F.lit(NOW).cast("timestamp"))))
    return out.select("item_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


SUMMARY = f"""{IMPACT}, net AS (SELECT company_id, tanh(sum(impact * pow(0.5, greatest((epoch(TIMESTAMP '{NOW}') - epoch(ts)) / 86400, 0) / 10))) AS net FROM scored_events GROUP BY 1),
cnt AS (SELECT company_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts FROM (SELECT company_id, event_type, count(*) AS n FROM scored_events WHERE event_type <> 'routine' GROUP BY ALL) GROUP BY 1),
top5 AS (SELECT company_id, string_agg(title, ' / ' ORDER BY rn) AS top_titles FROM (SELECT company_id, title, row_number() OVER (PARTITION BY company_id ORDER BY abs(impact) DESC, ts DESC, item_id) AS rn
  FROM scored_events WHERE abs(impact) >= 0.1::DOUBLE AND novelty > 0.5) WHERE rn <= 5 GROUP BY 1)"""


@query("agg07_event_summary", f"WITH RECURSIVE {SUMMARY} SELECT company_id, round(net, 3) + CAST(0 AS DOUBLE) AS net_score, counts, top_titles FROM net LEFT JOIN cnt USING (company_id) LEFT JOIN top5 USING (company_id)")
def event_summary(spark, sf_dir):
    s = events.summarise(analysed(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    counts = F.concat_ws(",", F.transform(F.array_sort(F.map_entries("event_counts")), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return s.select("company_id", *rounded("net_score", digits=3), counts.alias("counts"),
                    F.concat_ws(" / ", F.transform("top_events", lambda e: e["title"])).alias("top_titles"))


@query("flt09_headline_view", f"""WITH RECURSIVE {IMPACT}, h AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY ts DESC, item_id) AS rn FROM scored_events WHERE novelty >= 0.5 AND event_type NOT IN ('price_commentary', 'other', 'routine'))
SELECT item_id, materiality_label <> 'low' AND event_type <> 'routine' AS material FROM h WHERE rn <= 8""")
def headline_view(spark, sf_dir):
    """New, typed events, the eight newest per company; the limit is the view."""
    shown = screen.top_per_group(analysed(spark, sf_dir).filter(screen.is_headline()), ["company_id"], [F.desc("ts"), F.asc("item_id")], 8, salt_on="item_id")
    return shown.select("item_id", screen.is_material().alias("material"))


# ---- headlines from feeds --------------------------------------------------------------------------------------------

@query("src17_rss_headlines", """SELECT l_orderkey AS item, l_linenumber AS line, l_returnflag || ' moves' AS title, CASE WHEN l_linenumber % 2 = 0 THEN 'Desk ' || l_linestatus ELSE 'Google News' END AS source,
  count(*) AS n, count(*) FILTER (l_suppkey % 4 <> 0) AS known, round(sum(CASE WHEN l_suppkey % 4 = 0 THEN 24 ELSE (epoch(TIMESTAMP '2002-01-01') - epoch(l_shipdate)) / 3600 - 5.5 END), 4) AS hours FROM lineitem WHERE l_linenumber <= 5 GROUP BY ALL""")
def rss_headlines(spark, sf_dir):
    """Line items as feed items with mail-style dates; five per feed; a quarter has no readable date."""
    at = F.timestamp_seconds(F.unix_timestamp("l_shipdate") + 19800 * 2)
    stamp = F.concat(F.date_format(at, "EEE"), F.lit(", "), F.date_format(at, "dd MMM yyyy HH:mm:ss"), F.lit(" +0530"))
    raw = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("feed"), F.col("l_linenumber").alias("item_no"), F.concat(F.lit(" "), "l_returnflag", F.lit(" moves ")).alias("title"),
        F.lit(None).cast("string").alias("link"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("Desk "), "l_linestatus")).alias("source"),
        F.when(F.col("l_suppkey") % 4 == 0, "yesterday").otherwise(stamp).alias("pubDate"))
    rows = feeds.rss_headlines(raw, F.lit("Google News"), F.lit("2002-01-01 00:00:00").cast("timestamp"), limit=5)
    return rows.groupBy(F.col("feed").alias("item"), F.col("item_no").alias("line"), "title", "source").agg(
        F.count("*").alias("n"), F.count_if("time_known").alias("known"), F.round(F.sum("hours_ago"), 4).alias("hours"))


@query("src18_provider_news", """SELECT event_id, 'user ' || user_id AS title, CASE event_id % 4 WHEN 0 THEN 'c/' || event_id WHEN 1 THEN 'k/' || event_id ELSE 'l/' || event_id END AS link,
  CASE WHEN event_id % 4 < 2 THEN event_type ELSE CASE WHEN event_id % 4 = 2 THEN 'pub' ELSE 'Yahoo Finance' END END AS source,
  round(CASE WHEN event_id % 5 = 4 THEN 24 ELSE (epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) / 3600 END, 5) AS hours, event_id % 5 <> 4 AS time_known FROM events""")
def provider_news(spark, sf_dir):
    """Events as provider JSON: nested or flat, time as epoch, ISO or mail-style text."""
    e = F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    epoch = F.when(e % 5 == 0, F.unix_timestamp(ts).cast("double"))
    text = (F.when(e % 5 == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(e % 5 == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
            .when(e % 5 == 3, F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).when(e % 5 == 4, "soon"))
    link = lambda p: F.concat(F.lit(p), e)
    inner = F.struct(
        F.concat(F.lit("user "), "user_id").alias("title"), F.when(e % 4 == 0, F.struct(link("c/").alias("url"))).alias("canonicalUrl"),
        F.when(e % 4 == 1, F.struct(link("k/").alias("url"))).alias("clickThroughUrl"), F.when(e % 4 > 1, link("l/")).alias("link"),
        F.when(e % 4 < 2, F.struct(F.col("event_type").alias("displayName"))).alias("provider"), F.when(e % 4 == 2, "pub").alias("publisher"),
        text.alias("pubDate"), epoch.alias("providerPublishTime"))
    # the envelope keeps the epoch at the top level in both shapes
    body = F.when(e % 2 == 0, F.to_json(F.struct(inner.alias("content"), F.when(e % 4 == 2, "pub").alias("publisher"), epoch.alias("providerPublishTime")))) \
        .otherwise(F.to_json(inner))
    raw = table(spark, sf_dir, "events").select(e.alias("item_no"), body.alias("body"))
    return feeds.provider_headlines(raw, F.lit("2024-02-01 00:00:00").cast("timestamp")).select(
        F.col("item_no").alias("event_id"), "title", "link", "source", F.round("hours_ago", 5).alias("hours"), "time_known")


@query("set01_set02_srt06_titles", f"""WITH {ITEMS}, u AS (SELECT item_id * 2 AS id, title, source, ts FROM items UNION ALL SELECT page_id * 2 + 1, {PAGE_TITLE}, 'web', TIMESTAMP '2001-08-01' FROM pages),
h AS (SELECT *, (epoch(TIMESTAMP '2001-07-15') - epoch(ts)) / 3600 AS h FROM u), f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY lower(trim(title)) ORDER BY id) = 1)
SELECT id, title, round(greatest(h, 0), 5) + CAST(0 AS DOUBLE) AS hours_ago, CASE WHEN h <= 24 THEN 'Last 24 Hours' WHEN h <= 168 THEN 'Past 7 Days' ELSE 'Past 30 Days' END AS category FROM f WHERE h <= 720""")
def titles(spark, sf_dir):
    """Two feeds united, exact titles once, at most 30 days old, in three age buckets."""
    a = filings(spark, sf_dir).select((F.col("item_id") * 2).alias("id"), "title", "source", "ts")
    p = table(spark, sf_dir, "pages").select((F.col("page_id") * 2 + 1).alias("id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
                                             F.lit("web").alias("source"), F.lit("2001-08-01 00:00:00").cast("timestamp").alias("ts"))
    now = F.lit("2001-07-15 00:00:00").cast("timestamp")
    rows = screen.union_all(a, p).withColumn("hours_ago", feeds.hours_between(F.col("ts"), now))
    return screen.recency_buckets(screen.distinct_titles(rows, ["id"])).select("id", "title", *rounded("hours_ago", digits=5), "category")


# ---- near-duplicates ------------------------------------------------------------------------------------------------------

ART = f"""{ITEMS}, art AS (SELECT item_id, source, (epoch(TIMESTAMP '{NOW}') - epoch(ts)) / 3600 AS hours_ago, trim(CASE WHEN title LIKE '% - ' || source THEN left(title, len(title) - len(source) - 3) ELSE regexp_replace(title, '\\s*[-|–—]\\s*[^-|–—]+$', '') END) AS key FROM items)"""


def articles(spark, sf_dir) -> DataFrame:
    now = F.lit(NOW).cast("timestamp")
    return filings(spark, sf_dir).select("item_id", "title", "source", feeds.hours_between(F.col("ts"), now).alias("hours_ago"))


def brand_aliases(spark, sf_dir) -> DataFrame:
    """Aliases: the brands' names, and the common index and regulator names."""
    brands = table(spark, sf_dir, "part").select(F.lower("p_brand").alias("alias"), F.col("p_brand").alias("symbol")).distinct()
    common = brands.sparkSession.createDataFrame(list(er.COMMON_ALIASES.items()), "alias string, symbol string")
    return brands.unionByName(common)


NUMS = "list_transform(regexp_extract_all(key, '\\d[\\d,]*\\.?\\d*'), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE))"
WORDS = f"list_filter(list_distinct(regexp_extract_all(lower(key), '[a-z0-9]+')), lambda w: NOT list_contains([{', '.join(q(x) for x in er.TITLE_STOP)}], w))"
LETTERS = "regexp_extract_all(lower(key), '[a-z]+')"
FACTS = f"""tf AS MATERIALIZED (SELECT key, {NUMS} AS nums, {WORDS} AS words, list_has_any({LETTERS}, [{', '.join(q(x) for x in er.UP_WORDS)}]) AS up,
  list_has_any({LETTERS}, [{', '.join(q(x) for x in er.DOWN_WORDS)}]) AS down, regexp_extract(lower(key), '\\bbrand#\\d+\\b') AS ent FROM (SELECT DISTINCT key FROM art))"""


@query("dup01_02_04_title_facts", f"""WITH {ART}, {FACTS} SELECT key, array_to_string(list_transform(nums, lambda x: printf('%.2f', x)), ' ') AS numbers, array_to_string(list_sort(words), ' ') AS words, up, down FROM tf""")
def title_facts(spark, sf_dir):
    t = articles(spark, sf_dir).select(te.headline_title(F.col("title"), F.col("source")).alias("key")).distinct()
    up, down = te.direction_flags(F.col("key"))
    return t.select("key", F.concat_ws(" ", F.transform(te.numbers_in(F.col("key")), lambda x: F.format_string("%.2f", x))).alias("numbers"),
                    F.concat_ws(" ", F.array_sort(te.token_set(F.col("key"), er.TITLE_STOP))).alias("words"), up.alias("up"), down.alias("down"))


@query("dup03_entities", f"WITH {ART}, {FACTS} SELECT key, 'B' || substr(ent, 2) AS entity FROM tf WHERE ent <> ''")
def entities(spark, sf_dir):
    t = articles(spark, sf_dir).select(te.headline_title(F.col("title"), F.col("source")).alias("key")).distinct()
    return dedup.entities(t, brand_aliases(spark, sf_dir)).select("key", F.explode("entities").alias("entity"))


def stop_list() -> list[str]:
    """A short stop list for the checks, so that the SQL can carry it too."""
    return er.TITLE_STOP


TFIDF = f"""keys AS (SELECT key, count(*) AS n FROM art GROUP BY key), wl AS (SELECT key, n, list_filter(regexp_extract_all(lower(key), '\\b\\w\\w+\\b'), lambda w: NOT list_contains([{', '.join(q(x) for x in er.TITLE_STOP)}], w)) AS ws FROM keys),
tm AS (SELECT key, n, unnest(list_concat(ws, CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE [] END)) AS term FROM wl),
tfq AS (SELECT key, n, term, count(*) AS tf FROM tm GROUP BY ALL), dfq AS (SELECT term, sum(n) AS df FROM tfq GROUP BY term),
wq AS (SELECT key, term, tf * (ln((1 + (SELECT count(*) FROM art)) / (1 + df)) + 1) AS w FROM tfq JOIN dfq USING (term)),
vec AS MATERIALIZED (SELECT key, term, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS w FROM wq)"""


@query("dup05_tfidf_vectors", f"WITH {ART}, {TFIDF} SELECT key, count(*) AS terms, round(sum(w), 6) AS total, round(max(w), 6) AS top FROM vec GROUP BY key")
def tfidf_vectors(spark, sf_dir):
    keys = articles(spark, sf_dir).groupBy(te.headline_title(F.col("title"), F.col("source")).alias("key")).agg(F.count("*").alias("n"))
    return dedup.tfidf(keys, stop_list()).groupBy("key").agg(
        F.count("*").alias("terms"), F.round(F.sum("weight"), 6).alias("total"), F.round(F.max("weight"), 6).alias("top"))


STORY = f"""{ART}, {FACTS}, {TFIDF}, near AS MATERIALIZED (SELECT DISTINCT a.key AS p, b.key AS c FROM art a JOIN art b ON a.key < b.key AND abs(a.hours_ago - b.hours_ago) <= 24),
sims AS (SELECT p, c, sum(x.w * y.w) AS sim FROM near JOIN vec x ON x.key = p JOIN vec y ON y.key = c AND y.term = x.term GROUP BY p, c),
same AS (SELECT p, c FROM sims JOIN tf x ON x.key = p JOIN tf y ON y.key = c WHERE NOT (x.ent <> '' AND y.ent <> '' AND x.ent <> y.ent)
  AND NOT ((x.up AND NOT x.down AND y.down AND NOT y.up) OR (x.down AND NOT x.up AND y.up AND NOT y.down))
  AND (sim >= 0.85::DOUBLE OR ((len(x.nums) = 0 OR len(y.nums) = 0 OR len(list_filter(x.nums, lambda u: len(list_filter(y.nums, lambda v: abs(u - v) <= 0.03::DOUBLE * greatest(abs(u), abs(v), 1))) > 0)) > 0)
    AND (sim >= 0.74::DOUBLE OR (sim >= 0.55::DOUBLE AND len(x.words) > 0 AND len(y.words) > 0 AND len(list_intersect(x.words, y.words)) / (len(x.words) + len(y.words) - len(list_intersect(x.words, y.words))) >= 0.4::DOUBLE))))),
links AS MATERIALIZED (SELECT a.item_id AS u, b.item_id AS v FROM art a JOIN art b ON a.key = b.key AND a.item_id <> b.item_id AND abs(a.hours_ago - b.hours_ago) <= 24
  UNION ALL SELECT a.item_id, b.item_id FROM same JOIN art a ON a.key = p JOIN art b ON b.key = c AND abs(a.hours_ago - b.hours_ago) <= 24
  UNION ALL SELECT b.item_id, a.item_id FROM same JOIN art a ON a.key = p JOIN art b ON b.key = c AND abs(a.hours_ago - b.hours_ago) <= 24),
reach AS (SELECT item_id AS n, item_id AS s FROM art UNION SELECT l.v, r.s FROM reach r JOIN links l ON l.u = r.n AND r.s < l.v),
story AS MATERIALIZED (SELECT n AS item_id, min(s) AS story FROM reach GROUP BY n)"""


@query("dup06_07_story_clusters", f"WITH RECURSIVE {STORY} SELECT item_id, story FROM story")
def story_clusters(spark, sf_dir):
    return dedup.story_links(articles(spark, sf_dir), brand_aliases(spark, sf_dir), stop=stop_list()).select("item_id", "story")


TIERS = "MAP {" + ", ".join(f"{q(k)}: {v}" for k, v in er.SOURCE_TIERS.items()) + "}"
REPS = f"""{STORY}, best AS (SELECT story, count(*) AS copies, first(item_id ORDER BY -coalesce({TIERS}[lower(source)], 1), hours_ago, item_id) AS item_id, list_sort(list_distinct(list(source))) AS srcs FROM story JOIN art USING (item_id) GROUP BY story)"""


@query("agg11_representatives", f"WITH RECURSIVE {REPS} SELECT story, b.item_id, copies, array_to_string(list_filter(srcs, lambda s: s <> a.source), ', ') AS related FROM best b JOIN art a USING (item_id)")
def representatives(spark, sf_dir):
    reps = dedup.dedupe_articles(articles(spark, sf_dir), brand_aliases(spark, sf_dir), stop=stop_list())
    return reps.select("story", "item_id", "copies", F.concat_ws(", ", "related_sources").alias("related"))


@query("dup05_embedding_pairs", """SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS sim
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND abs(a.vec_id % 97 - b.vec_id % 97) <= 24 WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.35::DOUBLE""")
def embedding_pairs(spark, sf_dir):
    """Supplied vectors: all pairs with cosine 0.35 or more that lie within a day, spread over four days."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), (F.col("vec_id") % 97).cast("double").alias("hours"),
                                                  linking.unit(F.col("embedding")).alias("vec"))
    return linking.close_vectors(e, 0.35, 24.0, block_rows=256).select("a", "b", F.round("sim", 5).alias("sim"))
