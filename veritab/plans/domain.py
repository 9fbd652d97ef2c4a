"""Rules, links, transitions and read models of projects over the driver's tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veritab.functions import cables, citations, privacy, spans, text
from veritab.operators import checks, decisions, links, rules, summaries, windows
from veritab.plans.logic import condition, explained
from veritab.plans.registry import add, literal, query
from veritab.sources import grids
from veritab.sources.tables import table

# paragraphs: each order is one, its text the case o_orderkey % 7

TEXTS = (
    "Luminária da marca Alfa modelo B2",
    "Quadro da marca Beta ou equivalente",
    "segundo a secção das RTIEBT",
    "Portaria n.º 949-A/2006 e EN 60 529",
    "potência de 34 kVA",
    "cumprir Decreto-Lei n.º 96/2017",
    "conforme referência indicada",
)
CORPUS = [("DL96", r"decreto-lei n.º 96/2017"), ("EN60529", r"en 60 529"), ("RTIEBT", r"rtiebt")]
PARAGRAPHS = """SELECT o_custkey AS project, 'P' || o_custkey AS piece, CASE o_orderkey % 3 WHEN 0 THEN 'CTE' WHEN 1 THEN 'MDJ' ELSE 'MQT' END AS piece_kind,
CASE WHEN o_orderkey % 5 = 0 THEN 'iluminacao_comando' WHEN o_orderkey % 5 = 1 THEN 'ele_iluminacao' ELSE 'quadros' END AS section_key, CASE WHEN o_orderkey % 11 = 0 THEN 'cover' ELSE 'block' END AS section_kind,
o_orderkey AS idx, o_orderkey % 2 = 0 AS generated, o_orderkey % 7 AS c FROM orders"""


def _paragraphs(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders_of_paragraphs")
    p = spark.sql(PARAGRAPHS.replace("FROM orders", "FROM orders_of_paragraphs"))
    texts = F.array(*[F.lit(t) for t in TEXTS])
    return p.withColumns({"text": F.get(texts, F.col("c").cast("int")), "source_text": F.lit(None).cast("string")}).drop("c")


def _projects(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("project"), (F.col("c_custkey") % 2 == 0).alias("public"))


def _regulations(spark):
    return spark.createDataFrame([("DL96", "confirmed", False), ("EN60529", "revoked", False), ("RTIEBT", "confirmed", True)], "code string, status string, citable boolean")


_WRITTEN = "piece_kind IN ('CTE', 'MDJ')"
_KEY = "piece || '|' || section_key || '|' || idx"


@query(f"WITH p AS ({PARAGRAPHS}) SELECT 'CCP-01' AS rule_id, 'warning' AS severity, {_KEY} AS key FROM p WHERE {_WRITTEN} AND section_kind = 'block' AND project % 2 = 0 AND project IN (SELECT c_custkey FROM customer) AND c IN (0, 6)")
def rule_ccp_01(spark, d):
    return rules.brand_without_equivalent(_paragraphs(spark, d), _projects(spark, d))


@query(f"WITH p AS ({PARAGRAPHS}) SELECT 'NUM-01' AS rule_id, 'critical' AS severity, {_KEY} || '|0' AS key FROM p WHERE {_WRITTEN} AND generated AND c = 4")
def rule_num_01(spark, d):
    return rules.numbers_without_source(_paragraphs(spark, d))


@query(f"WITH p AS ({PARAGRAPHS}) SELECT 'REF-01' AS rule_id, 'warning' AS severity, 'text|' || {_KEY} || '|portaria n.º 949-a/2006' AS key FROM p WHERE {_WRITTEN} AND c = 3")
def rule_ref_01_texts(spark, d):
    return rules.unknown_citations(_paragraphs(spark, d), CORPUS)


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_suppkey % 3 WHEN 0 THEN 'archive' WHEN 1 THEN 'regulation' ELSE 'ficha' END AS kind, CASE l_suppkey % 3 WHEN 0 THEN 'a' || (l_partkey % 100) ELSE 'r' || (l_partkey % 9) END AS target, l_linenumber % 2 AS v FROM lineitem)
SELECT 'REF-01' AS rule_id, 'critical' AS severity, l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || target AS key FROM c
WHERE v = 1 AND ((kind = 'archive' AND CAST(substr(target, 2) AS INTEGER) >= 90) OR (kind = 'regulation' AND CAST(substr(target, 2) AS INTEGER) >= 7))""")
def rule_ref_01_sources(spark, d):
    kind = F.when(F.col("l_suppkey") % 3 == 0, "archive").when(F.col("l_suppkey") % 3 == 1, "regulation").otherwise("ficha")
    target = F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("a"), F.col("l_partkey") % 100)).otherwise(F.concat(F.lit("r"), F.col("l_partkey") % 9))
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("piece"), F.col("l_linenumber").alias("section"), F.col("l_partkey").alias("anchor"), kind.alias("kind"), target.alias("target"), (F.col("l_linenumber") % 2).alias("version"), F.lit(1).alias("current_version"))
    archive, regulations = spark.range(90).select(F.concat(F.lit("a"), "id").alias("ref")), spark.range(7).select(F.concat(F.lit("r"), "id").alias("code"))
    return rules.unknown_sources(c, archive, regulations)


@query(f"""WITH p AS ({PARAGRAPHS}) SELECT 'REF-02' AS rule_id, 'critical' AS severity, 'revoked|' || {_KEY} || '|EN60529' AS key FROM p WHERE {_WRITTEN} AND c = 3
UNION ALL SELECT DISTINCT 'REF-02', 'info', 'pending|' || piece FROM p WHERE {_WRITTEN} AND c = 5""")
def rule_ref_02(spark, d):
    return rules.revoked_or_pending(_paragraphs(spark, d), CORPUS, _regulations(spark))


@query(f"WITH p AS ({PARAGRAPHS}) SELECT 'REF-03' AS rule_id, 'warning' AS severity, {_KEY} || '|0' AS key FROM p WHERE {_WRITTEN} AND c = 2")
def rule_ref_03(spark, d):
    return rules.incomplete_references(_paragraphs(spark, d))


CABLES = (("H07V-U", "H07V", "false", "fio"), ("H07V-K", "H07V", "true", "fio"), ("XZ1(frt,zh)", "XZ1", "NULL", "cabo"), ("RZ1-K (AS)", "RZ1", "true", "cabo"), ("RV-K", "RV", "true", "cabo"), ("H07V-R", "H07V", "false", "fio"))
_CABLE_ROWS = ", ".join(f"({i}, '{f}', '{b}', {x}, '{k}')" for i, (f, b, x, k) in enumerate(CABLES))


@query(f"""WITH cab(i, family, base, flex, kind) AS (VALUES {_CABLE_ROWS}), eq(low, high, status) AS (VALUES ('RZ1-K (AS)', 'XZ1(frt,zh)', 'approved'), ('RV-K', 'XZ1(frt,zh)', 'proposed')),
f AS (SELECT l_orderkey AS project, l_linenumber % 4 AS k, l_suppkey % 10 = 0 AS earth, cab.* FROM lineitem JOIN cab ON i = l_partkey % 6),
r AS (SELECT DISTINCT project, family, base, flex, kind FROM f WHERE k = 0),
g AS (SELECT DISTINCT project, CASE WHEN k IN (1, 2) THEN 'escritas' ELSE 'quantidades' END AS grp, family, base, flex, kind FROM f WHERE k > 0 AND NOT earth),
j AS (SELECT g.*, r.family AS rf, r.base AS rb, r.flex AS rx, r.kind AS rk, eq.status FROM g JOIN r USING (project) LEFT JOIN eq ON low = least(g.family, r.family) AND high = greatest(g.family, r.family) WHERE NOT EXISTS (SELECT 1 FROM r z WHERE z.project = g.project AND z.family = g.family)),
a AS (SELECT project, grp, family, coalesce(bool_or(status = 'approved'), false) AS ok, min(rf) FILTER (base = rb AND flex <> rx) AS opp, min(rf) FILTER (status = 'proposed') AS prop, min(rf) FILTER (kind = rk) AS alike FROM j GROUP BY ALL)
SELECT 'COE-06' AS rule_id, CASE WHEN opp IS NOT NULL THEN 'critical' ELSE 'warning' END AS severity, project || '|' || grp || '|' || family || '|' || coalesce(opp, prop, alike) AS key FROM a WHERE NOT ok AND (opp IS NOT NULL OR alike IS NOT NULL)""")
def rule_coe_06(spark, d):
    families = F.array(*[F.lit(c[0]) for c in CABLES])
    kind = F.get(F.array(*[F.lit(k) for k in ("CALC", "MDJ", "CTE", "MQT")]), F.col("l_linenumber") % 4)
    facts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("project"), kind.alias("piece_kind"), F.get(families, (F.col("l_partkey") % 6).cast("int")).alias("family"), (F.col("l_suppkey") % 10 == 0).alias("earth"))
    edges = spark.createDataFrame([("RV-K", "XZ1(frt,zh)", "proposed"), ("XZ1(frt,zh)", "RZ1-K (AS)", "proposed")], "a string, b string, status string")
    aliases = spark.createDataFrame([("XZ1(frt,zh)", "rz1-k (as)")], "name string, alias string")
    return rules.cable_differences(facts, rules.equivalences(edges, aliases))


@query("""WITH e AS (SELECT n_nationkey AS x, (n_nationkey * 7 + 1) % 25 AS y, CASE n_nationkey % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'proposed' ELSE 'rejected' END AS status FROM nation WHERE n_nationkey <> (n_nationkey * 7 + 1) % 25),
u AS (SELECT least(x, y) AS low, greatest(x, y) AS high, max(status) AS status FROM e GROUP BY ALL)
SELECT c_custkey, coalesce(status, 'none') AS status FROM customer LEFT JOIN u ON low = least(c_nationkey, c_custkey % 25) AND high = greatest(c_nationkey, c_custkey % 25)""")
def equivalence_status(spark, d):
    """The status of an unordered pair, whichever way round it is asked."""
    n = F.col("n_nationkey")
    status = F.when(n % 3 == 0, "approved").when(n % 3 == 1, "proposed").otherwise("rejected")
    e = table(spark, d, "nation").select(n.alias("x"), ((n * 7 + 1) % 25).alias("y"), status.alias("status")).filter("x <> y")
    u = e.select(*rules.pair(F.col("x"), F.col("y")), "status").groupBy("low", "high").agg(F.max("status").alias("status"))
    c = table(spark, d, "customer").select("c_custkey", *rules.pair(F.col("c_nationkey").cast("long"), F.col("c_custkey") % 25))
    return c.join(u, ["low", "high"], "left").select("c_custkey", F.coalesce("status", F.lit("none")).alias("status"))


_SCORE = "CASE WHEN {0} = {1} THEN 2 WHEN starts_with({0}, {1}) OR starts_with({1}, {0}) THEN 1 ELSE 0 END"


@query(f"""WITH l AS (SELECT s_suppkey, s_nationkey AS scope, CAST(s_suppkey % 40 AS VARCHAR) AS o, CAST(s_suppkey % 30 AS VARCHAR) AS t FROM supplier), r AS (SELECT c_custkey, c_nationkey AS scope, CAST(c_custkey % 40 AS VARCHAR) AS o, CAST(c_custkey % 30 AS VARCHAR) AS t FROM customer),
m AS (SELECT s_suppkey, c_custkey, {_SCORE.format('l.o', 'r.o')} AS f, {_SCORE.format('l.t', 'r.t')} AS s FROM l JOIN r USING (scope)),
b AS (SELECT *, f + s AS score, max(f + s) OVER (PARTITION BY s_suppkey) AS top FROM m WHERE f > 0 AND s > 0)
SELECT s_suppkey, c_custkey, score, count(*) OVER (PARTITION BY s_suppkey) = 1 AS is_unique FROM b WHERE score = top""")
def circuits_of_sheets(spark, d):
    """Sheets and circuits that fit at both ends, with the best sum; one best match is unique."""
    of = lambda k, prefix, n: text.core(F.concat(F.lit(prefix), (F.col(k) % n).cast("string")))
    sheets = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("scope"), of("s_suppkey", "Q.P.", 40).alias("origin"), of("s_suppkey", "Quadro Q", 30).alias("destination"))
    circuits = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("scope"), of("c_custkey", "QP", 40).alias("origin"), of("c_custkey", "Q.", 30).alias("destination"))
    return links.best_by_both_ends(sheets, circuits, "scope", "s_suppkey", "c_custkey")


@query("""WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_brand END AS code, p_type AS designation FROM part), o AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_brand END AS code, p_type AS designation, min(p_partkey) AS link FROM part WHERE p_size % 6 = 0 GROUP BY 1, 2)
SELECT p_partkey, link, CASE WHEN link IS NULL THEN 'unlinked' ELSE 'manual' END AS link_status FROM n LEFT JOIN o ON n.code IS NOT DISTINCT FROM o.code AND n.designation IS NOT DISTINCT FROM o.designation""")
def links_that_survive(spark, d):
    """Links of people found again in a new reading by code and designation, null codes included."""
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 != 0, F.col("p_brand")).alias("code"), F.col("p_type").alias("designation"), "p_size")
    old = p.select("code", "designation", F.when(F.col("p_size") % 6 == 0, F.col("p_partkey")).alias("link"))
    return links.kept_links(p.drop("p_size"), old, ["code", "designation"], "link").select("p_partkey", "link", "link_status")


@query("""SELECT i.event_id, coalesce(max(o.event_id) FILTER (o.event_id < i.event_id), min(o.event_id) FILTER (o.event_id > i.event_id)) AS owner_at
FROM events i LEFT JOIN events o ON o.user_id = i.user_id AND o.event_type = 'purchase' WHERE i.event_type <> 'purchase' GROUP BY i.event_id""")
def nearest_owners(spark, d):
    """The purchase before each other event of its user, else the first one after it."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return links.nearest_owner(e, "user_id", "event_id", F.col("event_type") == "purchase").filter("event_type <> 'purchase'").select("event_id", "owner_at")


_ISSUES = "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'critical' WHEN o_totalprice > 100000 THEN 'warning' ELSE 'info' END AS severity, 'R' || (o_custkey % 5) AS rule, o_orderstatus AS status FROM orders"


@query(f"""WITH i AS ({_ISSUES}) SELECT 'all' AS asked, count(*) AS n FROM i UNION ALL SELECT 'severity', count(*) FROM i WHERE severity IN ('critical', 'warning')
UNION ALL SELECT 'severity, rule', count(*) FROM i WHERE severity = 'critical' AND rule IN ('R1', 'R2') UNION ALL SELECT 'rule, status', count(*) FROM i WHERE rule = 'R3' AND status = 'O' UNION ALL SELECT 'none fits', count(*) FROM i WHERE status = 'X'""")
def issue_filters(spark, d):
    """Optional filters in several settings; what is not asked for keeps everything."""
    o = table(spark, d, "orders")
    sev = F.when(F.col("o_totalprice") > 200000, "critical").when(F.col("o_totalprice") > 100000, "warning").otherwise("info")
    i = o.select("o_orderkey", sev.alias("severity"), F.concat(F.lit("R"), F.col("o_custkey") % 5).alias("rule"), F.col("o_orderstatus").alias("status"))
    asked = {"all": {}, "severity": {"severity": ["critical", "warning"], "rule": []}, "severity, rule": {"severity": ["critical"], "rule": ["R1", "R2"], "status": None}, "rule, status": {"rule": ["R3"], "status": ["O"]}, "none fits": {"status": ["X"]}}
    out = None
    for name, wanted in asked.items():
        one = links.filtered(i, **wanted).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("asked"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH f AS (SELECT l_orderkey, CASE l_linenumber % 3 WHEN 0 THEN 'ele.potencia' WHEN 1 THEN 'ele.quadros' ELSE 'tec.nome' END AS key, CASE l_returnflag WHEN 'A' THEN 'MDJ' WHEN 'N' THEN 'CTE' ELSE 'LPU' END AS piece_kind, l_quantity > 10 AS comparable FROM lineitem)
SELECT l_orderkey, count(*) FILTER (key = 'ele.potencia' AND comparable) AS by_key, count(*) FILTER (starts_with(key, 'ele.')) AS by_prefix, count(*) FILTER (piece_kind IN ('MDJ', 'CTE') AND NOT comparable) AS by_kind FROM f GROUP BY l_orderkey HAVING count(*) FILTER (key = 'ele.potencia' AND comparable) + count(*) FILTER (starts_with(key, 'ele.')) + count(*) FILTER (piece_kind IN ('MDJ', 'CTE') AND NOT comparable) > 0""")
def fact_filters(spark, d):
    """Facts by key and comparability, by prefix, and by kind of piece."""
    key = F.when(F.col("l_linenumber") % 3 == 0, "ele.potencia").when(F.col("l_linenumber") % 3 == 1, "ele.quadros").otherwise("tec.nome")
    kind = F.when(F.col("l_returnflag") == "A", "MDJ").when(F.col("l_returnflag") == "N", "CTE").otherwise("LPU")
    f = table(spark, d, "lineitem").select("l_orderkey", key.alias("key"), kind.alias("piece_kind"), (F.col("l_quantity") > 10).alias("comparable"))
    picks = {"by_key": links.facts_of(f, keys=["ele.potencia"], comparable=True), "by_prefix": links.facts_of(f, prefix="ele."), "by_kind": links.facts_of(f, kinds=["MDJ", "CTE"], comparable=False)}
    every = None
    for name, p in picks.items():
        one = p.select("l_orderkey", F.lit(name).alias("pick"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("l_orderkey").pivot("pick", list(picks)).count().na.fill(0)


@query(f"WITH p AS ({PARAGRAPHS}) SELECT idx FROM p WHERE section_kind = 'block' AND section_key = 'ele_iluminacao'")
def paragraphs_about(spark, d):
    """Paragraphs of sections about a subject, without those about another."""
    return links.about(_paragraphs(spark, d), ["iluminacao"], ["comando"]).select("idx")


@query("SELECT c_custkey, abs(c_acctbal) / 250 AS lat, -(c_custkey % 35) AS lon, (abs(c_acctbal) / 250 BETWEEN 36.8 AND 42.3 AND c_custkey % 35 BETWEEN 6 AND 9.7) OR (abs(c_acctbal) / 250 BETWEEN 36.8 AND 39.8 AND c_custkey % 35 BETWEEN 24.8 AND 31.5) OR (abs(c_acctbal) / 250 BETWEEN 32.3 AND 33.2 AND c_custkey % 35 BETWEEN 16.2 AND 17.4) OR (abs(c_acctbal) / 250 BETWEEN 29.9 AND 30.3 AND c_custkey % 35 BETWEEN 15.8 AND 16.1) AS inside FROM customer")
def coordinates_inside(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (F.abs("c_acctbal") / 250).alias("lat"), (-(F.col("c_custkey") % 35)).alias("lon"))
    return c.withColumn("inside", privacy.in_portugal(F.col("lat"), F.col("lon")))


@query("""WITH h AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+')) AS v FROM documents), k AS (SELECT lower(v) AS v, min(doc_id) AS first FROM h GROUP BY 1),
n AS (SELECT v, row_number() OVER (ORDER BY first, v) AS n FROM k)
SELECT doc_id, list_sort(list_distinct(list('pessoa' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INTEGER), '0') || '@example.com'))) AS said, 0 AS residue FROM h JOIN n ON lower(h.v) = n.v GROUP BY doc_id""".replace("\\\\", "\\"))
def anonymised_mail(spark, d):
    """Two passes: addresses are harvested and numbered by first appearance, then replaced; a second look finds no real one."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    hits = docs.select("doc_id", "text", F.regexp_extract_all("text", F.lit(privacy.PATTERNS["email"]), F.lit(0)).alias("hits")).filter(F.size("hits") > 0)
    each = hits.select("doc_id", F.explode("hits").alias("real"))
    numbered = windows.numbered(each.groupBy(F.lower("real").alias("v")).agg(F.min("doc_id").alias("first")), "n", "first", "v").withColumn("n", F.col("n").cast("string"))
    pairs = each.withColumn("v", F.lower("real")).join(numbered, "v").select("doc_id", "real", F.concat(F.lit("pessoa"), F.lpad("n", F.greatest(F.lit(3), F.length("n")), F.lit("0")), F.lit("@example.com")).alias("said"))
    maps = pairs.groupBy("doc_id").agg(F.map_from_entries(F.collect_set(F.struct("real", "said"))).alias("m"))
    out = hits.join(maps, "doc_id").withColumn("new", spans.replaced(F.col("text"), privacy.PATTERNS["email"], lambda hit: F.try_element_at(F.col("m"), hit)))
    left = F.filter(F.regexp_extract_all("new", F.lit(privacy.PATTERNS["email"]), F.lit(0)), lambda e: ~e.rlike(r"^pessoa\d{3,}@example\.com$"))
    return out.select("doc_id", F.array_sort(F.array_distinct(F.map_values("m"))).alias("said"), F.size(left).alias("residue"))


# transitions: the last line of an order asks, the order is the state

_ASKED = "SELECT l_orderkey AS k, arg_max(l_returnflag, o) AS d_choice, arg_max(l_quantity, o) AS d_size, arg_max(l_suppkey, o) AS d_by FROM (SELECT *, ((CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey) * 100000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS o FROM lineitem) GROUP BY l_orderkey"


def transition(name: str, guards: list[tuple[str, str]], to: str, doc: str) -> None:
    """Register a guarded change of an order's status. Guards and the new status are SQL over o_ and d_ columns, read alike by both engines."""

    def run(spark, d):
        state = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", (F.col("o_totalprice") / 1000).cast("int").alias("o_worth"))
        li = table(spark, d, "lineitem")
        order = ((F.col("l_linenumber").cast("long") * 1000000 + F.col("l_partkey")) * 100000 + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("long")
        asked = li.select(F.col("l_orderkey").alias("o_orderkey"), order.alias("ord"), F.col("l_returnflag").alias("choice"), F.col("l_quantity").alias("size"), F.col("l_suppkey").alias("by"))
        new, log = decisions.decide(state, asked, "o_orderkey", "ord", [(why, F.expr(ok)) for why, ok in guards], {"o_orderstatus": F.expr(to)})
        log = log.select(F.col("o_orderkey").alias("_k"), "refused", F.lit(True).alias("asked"))
        j = new.join(log, F.col("o_orderkey") == F.col("_k"), "left")
        return j.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.coalesce("asked", F.lit(False)).alias("asked"), "refused")

    run.__name__, run.__doc__ = name, doc
    why = "CASE WHEN k IS NULL THEN NULL " + " ".join(f"WHEN NOT coalesce({ok}, false) THEN {literal(w)}" for w, ok in guards) + " END"
    add(run, f"WITH a AS ({_ASKED}), j AS (SELECT *, CAST(trunc(o_totalprice / 1000) AS INTEGER) AS o_worth FROM orders LEFT JOIN a ON k = o_orderkey), w AS (SELECT *, {why} AS refused FROM j) SELECT o_orderkey, CASE WHEN k IS NOT NULL AND refused IS NULL THEN {to} ELSE o_orderstatus END AS status, k IS NOT NULL AS asked, refused FROM w")


transition("resolve_conflict", [("not a draft", "o_orderstatus <> 'F'"), ("not exactly one choice", "d_choice IN ('A', 'N')"), ("note too short", "d_size >= 3")], "'resolved'", "A conflict of a draft is resolved by exactly one choice and a note of three characters.")
transition("add_manual_value", [("group takes no values", "substr(o_orderpriority, 1, 1) IN ('1', '2', '3')"), ("given by a source", "d_choice <> 'R'")], "'manual'", "A value is added by hand where the key's group takes one and no source gives it.")
transition("confirm_revision", [("no values", "o_worth > 0"), ("open conflicts", "d_size < 45"), ("not a draft", "o_orderstatus IN ('O', 'P')")], "'confirmed'", "A draft with values and without open conflicts is confirmed.")
transition("link_sheet", [("not a draft", "o_orderstatus = 'O'"), ("no such target", "d_by <= 8"), ("key not allowed", "d_choice <> 'N'")], "'linked'", "A sheet of a draft is linked to a target that exists, under a key that may be linked.")
transition("reopen_issue", [("not ignored", "o_orderstatus = 'F'"), ("reason too short", "d_size >= 10")], "'open'", "An ignored issue is opened again with a reason of ten characters.")
transition("request_review", [("no finished run", "o_worth >= 20"), ("a run is going on", "o_orderstatus <> 'P'"), ("open critical issues", "NOT (substr(o_orderpriority, 1, 1) = '1' AND d_choice = 'R')")], "'review'", "Review is asked for after a finished run, with none going on and nothing critical open.")
transition("accept_proposal", [("not the current version", "d_size > 5"), ("already decided", "o_orderstatus = 'O'")], "CASE WHEN d_choice = 'R' THEN 'rejected' ELSE 'accepted' END", "A proposal to the current version is accepted or rejected once.")
transition("edit_section", [("locked nodes changed", "d_choice <> 'R'"), ("changed values not confirmed", "d_size <= 40 OR o_worth % 2 = 0")], "CASE WHEN d_size > 40 THEN 'flagged' ELSE 'edited' END", "An edit leaves locked nodes alone; changed values have to be confirmed and are flagged.")
transition("curate_block", [("not proposed", "o_orderstatus IN ('O', 'P')"), ("rule cannot be read", "d_size <> 13")], "CASE WHEN d_choice = 'R' THEN 'rejected' ELSE 'approved' END", "A curator decides on what is proposed; the rule has to be readable.")
transition("choose_equipment", [("other category", "o_custkey % 2 = d_by % 2"), ("no reason for leaving the default", "d_choice = 'A' OR d_size >= 10")], "'chosen'", "Equipment of the same category is chosen, with a reason where it is not the default.")
transition("review_parameter", [("no value", "d_size BETWEEN 1 AND 49"), ("already reviewed", "o_orderstatus <> 'F'")], "CASE WHEN d_choice = 'R' THEN 'edited' ELSE 'reviewed' END", "A parameter with a readable value is reviewed once.")


# read models


@query("""SELECT o_orderkey, count(*) FILTER (l_linestatus = 'F' AND l_returnflag <> 'R') AS approved, count(*) FILTER (l_linestatus <> 'F' AND l_returnflag <> 'R') AS not_approved, count(*) FILTER (l_returnflag = 'R') AS inactive, max(l_linenumber) AS current_version, coalesce(bool_or(l_discount > 0.08), false) AS has_adaptive, count(DISTINCT l_suppkey) AS proposals
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def document_view(spark, d):
    """Sections of a document by status, inactive ones apart, with its version and proposals."""
    active = F.col("l_returnflag") != "R"
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(active & (F.col("l_linestatus") == "F")).alias("approved"), F.count_if(active & (F.col("l_linestatus") != "F")).alias("not_approved"), F.count_if(~active).alias("inactive"),
        F.max("l_linenumber").alias("current_version"), F.bool_or(F.col("l_discount") > 0.08).alias("has_adaptive"), F.count_distinct("l_suppkey").alias("proposals"))
    j = table(spark, d, "orders").select("o_orderkey").join(s, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
    return j.na.fill(0, ["approved", "not_approved", "inactive", "proposals"]).na.fill(False, ["has_adaptive"])


@query("""SELECT p_partkey, p_brand, coalesce(string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)), '') AS evidence FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_returnflag = 'A' WHERE p_type LIKE 'STANDARD%' GROUP BY p_partkey, p_brand""")
def block_list(spark, d):
    """Blocks of a type with their evidence."""
    e = table(spark, d, "lineitem").filter("l_returnflag = 'A'").groupBy("l_partkey").agg(F.array_join(F.sort_array(F.collect_set(F.col("l_suppkey").cast("string"))), ",").alias("evidence"))
    p = table(spark, d, "part").filter(F.col("p_type").startswith("STANDARD")).select("p_partkey", "p_brand")
    return p.join(e, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", "p_brand", F.coalesce("evidence", F.lit("")).alias("evidence"))


@query("""SELECT r_name, string_agg(n_name, ', ' ORDER BY n_name) AS terms, count(n_name) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name""")
def typology_terms(spark, d):
    """Typologies with their terms nested, in order."""
    t = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("t"))
    j = table(spark, d, "region").join(t, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return j.select("r_name", F.array_join("t", ", ").alias("terms"), F.coalesce(F.size("t"), F.lit(0)).cast("long").alias("n"))


@query("""SELECT p_partkey, count(l_orderkey) FILTER (l_linestatus = 'F') AS reviewed, count(l_orderkey) FILTER (l_linestatus = 'O') AS to_review, CASE WHEN count(l_orderkey) = 0 THEN 'no_requirement' WHEN bool_or(l_returnflag = 'R' AND l_quantity < 5) THEN 'fails' WHEN bool_or(l_returnflag = 'N') THEN 'to_confirm' ELSE 'meets' END AS verdict
FROM part LEFT JOIN lineitem ON l_partkey = p_partkey WHERE p_size > 25 GROUP BY p_partkey""")
def equipment_list(spark, d):
    """Equipment of a category: parameters reviewed and to review, and the verdict of its checks."""
    s = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_if(F.col("l_linestatus") == "F").alias("reviewed"), F.count_if(F.col("l_linestatus") == "O").alias("to_review"), F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_quantity") < 5)).alias("f"), F.bool_or(F.col("l_returnflag") == "N").alias("u"))
    j = table(spark, d, "part").filter("p_size > 25").select("p_partkey").join(s, F.col("p_partkey") == F.col("l_partkey"), "left")
    verdict = F.when(F.col("f").isNull(), "no_requirement").when(F.col("f"), "fails").when(F.col("u"), "to_confirm").otherwise("meets")
    return j.select("p_partkey", F.coalesce("reviewed", F.lit(0)).alias("reviewed"), F.coalesce("to_review", F.lit(0)).alias("to_review"), verdict.alias("verdict"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, sum(CAST(l_quantity AS BIGINT)) AS quantity FROM lineitem GROUP BY ALL), alt AS (SELECT p_brand, count(*) AS n FROM part WHERE p_size > 40 GROUP BY p_brand)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(quantity AS BIGINT) AS quantity, p_brand, coalesce(alt.n, 0) - CASE WHEN p_size > 40 THEN 1 ELSE 0 END AS alternatives FROM s JOIN part ON p_partkey = l_partkey LEFT JOIN alt USING (p_brand)""")
def project_slots(spark, d):
    """Slots of a document with quantity, and how many other items of the category would do."""
    s = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    alt = p.filter("p_size > 40").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    j = s.join(p, F.col("l_partkey") == F.col("p_partkey")).join(alt, "p_brand", "left")
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "quantity", "p_brand", (F.coalesce("n", F.lit(0)) - (F.col("p_size") > 40).cast("long")).alias("alternatives"))


@query("""WITH f AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_run FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey), c AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS current_run FROM orders GROUP BY o_custkey)
SELECT c.o_custkey, current_run, last_run, count(l_orderkey) FILTER (l_discount >= 0.09) AS critical, count(l_orderkey) AS issues FROM c LEFT JOIN f USING (o_custkey) LEFT JOIN lineitem ON l_orderkey = last_run GROUP BY ALL""")
def validation_view(spark, d):
    """The current run, the last finished one, and the issues of that."""
    o = table(spark, d, "orders")
    when = F.struct("o_orderdate", "o_orderkey")
    r = o.groupBy("o_custkey").agg(F.max_by("o_orderkey", when).alias("current_run"), F.max_by(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")), F.when(F.col("o_orderstatus") == "F", when)).alias("last_run"))
    i = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_discount") >= 0.09).alias("critical"), F.count(F.lit(1)).alias("issues"))
    j = r.join(i, F.col("last_run") == F.col("l_orderkey"), "left")
    return j.select("o_custkey", "current_run", "last_run", F.coalesce("critical", F.lit(0)).alias("critical"), F.coalesce("issues", F.lit(0)).alias("issues"))


@query("""SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS last_done, count(*) AS exports FROM events WHERE value > 20 GROUP BY ALL""")
def last_exports(spark, d):
    """The last finished export of each kind."""
    e = table(spark, d, "events").filter("value > 20")
    return e.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last_done"), F.count(F.lit(1)).alias("exports"))


@query(f"""WITH t AS (SELECT doc_id, text, regexp_replace(text, '{spans.either(list(privacy.PATTERNS.values()))}', '•••', 'g') AS m FROM documents)
SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS expected, len(regexp_extract_all(m, '[0-9]+')) AS found FROM t WHERE len(regexp_extract_all(text, '[0-9]+')) <> len(regexp_extract_all(m, '[0-9]+'))""")
def object_counts(spark, d):
    """Numbers that a document holds against those that its masked copy holds, where they differ."""
    of = lambda c: F.size(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)))
    t = table(spark, d, "documents").withColumn("copy", privacy.masked(F.col("text"), privacy.PATTERNS))
    return t.select("doc_id", of(F.col("text")).alias("expected"), of(F.col("copy")).alias("found")).filter("expected <> found")


@query("SELECT p_partkey, p_type AS block, p_name AS label, row_number() OVER (PARTITION BY p_type ORDER BY p_name, p_partkey) AS place FROM part WHERE p_size >= 10")
def requirement_list(spark, d):
    """Requirements that pass a filter, in order inside their block."""
    p = table(spark, d, "part").filter("p_size >= 10")
    return p.select("p_partkey", F.col("p_type").alias("block"), F.col("p_name").alias("label"), F.row_number().over(Window.partitionBy("p_type").orderBy("p_name", "p_partkey")).alias("place"))


@query("""SELECT l_orderkey, count(DISTINCT l_suppkey) AS boards FROM lineitem GROUP BY l_orderkey""")
def board_counts(spark, d):
    """Boards of a project by their cores: names written in two ways count once."""
    name = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("Q.P.ÁTRIO "), F.col("l_suppkey"))).otherwise(F.concat(F.lit("átrio-"), F.col("l_suppkey")))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_distinct(text.core(name)).alias("boards"))


RULE = ("any", ("all", (">", "o_totalprice", 150000), ("=", "o_orderpriority", "1-urgênt")), ("all", ("in", "o_orderpriority", ["2-HIGH", "5-low"]), ("not", ("=", "o_orderstatus", "P")), ("has", "o_custkey")))


@query("""SELECT o_orderkey, o_totalprice > 150000 AND o_orderpriority = '1-URGENT' OR o_orderpriority IN ('2-HIGH', '5-LOW') AND o_orderstatus <> 'P' AS active,
CASE WHEN o_totalprice > 150000 AND o_orderpriority = '1-URGENT' OR o_orderpriority IN ('2-HIGH', '5-LOW') AND o_orderstatus <> 'P' THEN '' ELSE concat_ws('; ', CASE WHEN o_totalprice <= 150000 THEN 'o_totalprice > 150000' END, CASE WHEN o_orderpriority <> '1-URGENT' THEN 'o_orderpriority = 1-urgênt' END,
CASE WHEN o_orderpriority NOT IN ('2-HIGH', '5-LOW') THEN 'o_orderpriority in 2-HIGH, 5-low' END, CASE WHEN o_orderstatus = 'P' THEN 'not o_orderstatus = P' END) END AS why FROM orders""")
def explained_rules(spark, d):
    """Whether a rule holds, and which of its clauses make it false."""
    return table(spark, d, "orders").select("o_orderkey", condition(RULE).alias("active"), F.array_join(explained(RULE), "; ").alias("why"))


@query("""WITH f AS (SELECT *, last_value(CASE WHEN l_linenumber % 3 = 1 THEN l_partkey END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chapter FROM lineitem)
SELECT l_orderkey, coalesce(bool_or(l_quantity > 49 AND chapter IS NOT NULL), false) AS some_large, string_agg(DISTINCT CAST(chapter AS VARCHAR), ',' ORDER BY CAST(chapter AS VARCHAR)) AS chapters FROM f GROUP BY l_orderkey""")
def rule_context(spark, d):
    """What rules see of a revision: articles with their chapter filled forward, as one row per project."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    f = table(spark, d, "lineitem").withColumn("chapter", F.last(F.when(F.col("l_linenumber") % 3 == 1, F.col("l_partkey")), ignorenulls=True).over(w))
    g = f.groupBy("l_orderkey").agg(F.bool_or((F.col("l_quantity") > 49) & F.col("chapter").isNotNull()).alias("some_large"), F.array_join(F.sort_array(F.collect_set(F.col("chapter").cast("string"))), ",").alias("c"))
    return g.select("l_orderkey", F.coalesce("some_large", F.lit(False)).alias("some_large"), F.nullif("c", F.lit("")).alias("chapters"))


@query("""WITH c AS (SELECT l_suppkey, 'H07V-' || CASE l_linenumber % 3 WHEN 0 THEN 'U' WHEN 1 THEN 'K' ELSE 'R' END AS family, count(*) AS n, min(l_orderkey) AS first FROM lineitem GROUP BY ALL)
SELECT family, count(*) AS places, CAST(sum(n) AS BIGINT) AS occurrences, min(first) AS first FROM c GROUP BY family""")
def cable_dictionary(spark, d):
    """Mining of designations: families found in texts, with their occurrences."""
    letter = F.when(F.col("l_linenumber") % 3 == 0, "U").when(F.col("l_linenumber") % 3 == 1, "K").otherwise("R")
    t = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", F.explode(cables.designations(F.concat(F.lit("condutor h07v-"), F.lower(letter), F.lit(" 3x2,5")))).alias("x"))
    c = t.groupBy(F.col("x.family").alias("family"), "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("first"))
    return c.groupBy("family").agg(F.count(F.lit(1)).alias("places"), F.sum("n").alias("occurrences"), F.min("first").alias("first"))


@query(f"""WITH p AS ({PARAGRAPHS}) SELECT idx, CASE WHEN idx % 3 = 0 THEN 'b' ELSE '' END AS kept, CASE WHEN idx % 3 = 0 THEN 1 ELSE 2 END AS removed, CASE WHEN c IN (4) THEN 1 ELSE 0 END AS numbers FROM p""")
def draft_postprocess(spark, d):
    """Sources outside the given set go, and numbers without a source are counted."""
    p = _paragraphs(spark, d).withColumn("sources", F.when(F.col("idx") % 3 == 0, F.array(F.lit("b"), F.lit("x"))).otherwise(F.array(F.lit("x"), F.lit("y"))))
    allowed = F.array(F.lit("a"), F.lit("b"))
    kept = F.filter("sources", lambda s: F.array_contains(allowed, s))
    return p.select("idx", F.array_join(kept, ",").alias("kept"), (F.size("sources") - F.size(kept)).alias("removed"), F.size(citations.stray_numbers(F.col("text"))).alias("numbers"))


@query("""SELECT o_custkey, '## ' || o_custkey || chr(10) || string_agg('- ' || o_orderkey || ': ' || o_orderstatus, chr(10) ORDER BY o_orderkey) AS report FROM orders GROUP BY o_custkey""")
def project_reports(spark, d):
    """A report in Markdown for each project, as one text."""
    line = F.concat(F.lit("- "), F.col("o_orderkey").cast("string"), F.lit(": "), F.col("o_orderstatus"))
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("l")))).alias("x"))
    return g.select("o_custkey", F.concat(F.lit("## "), F.col("o_custkey").cast("string"), F.lit("\n"), F.array_join(F.transform("x", lambda x: x["l"]), "\n")).alias("report"))


# workbooks: each order is one, of the kind of its status; columns, header row and sheet follow from its key


def _cells(spark, d):
    """Cells of a workbook per order: a calculation table of its lines (F), a list with a title of its priority (O), a form (P).

    Every workbook has another sheet with texts in the same places.
    """
    o = table(spark, d, "orders").withColumn("s", (1 + F.col("o_orderkey") % 2).cast("int")).withColumn("h", (1 + F.col("o_orderkey") % 4).cast("int"))
    li = table(spark, d, "lineitem").withColumn("i", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    li = li.join(o.filter("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"))
    at = lambda j: (1 + (F.lit(j) + F.col("o_orderkey")) % 8).cast("int")
    cell = lambda row, col, value: F.struct(F.col("s").alias("sheet_no"), row.cast("int").alias("row"), col.alias("col"), value.cast("string").alias("value"))
    heads = ["ORIGEM", "Destino", "Total instalado (kVA)", "Tipo de proteção", "Nº de fases", "Cabo", "Norma [kVA]", "Observações"]
    calc = [cell(F.col("h"), at(j), F.lit(x)) for j, x in enumerate(heads)] + [cell(F.col("h") + 1, at(0), F.lower("o_orderpriority"))]
    lines = [F.concat(F.lit("Q.P.ÁTRIO "), F.col("l_suppkey")), F.concat(F.lit("Pavilhão "), F.col("l_partkey")), F.translate(F.format_string("%.1f", "l_quantity"), ".", ","), F.element_at(F.create_map(F.lit("A"), F.lit("Disjuntor"), F.lit("N"), F.lit("FUSÍVEL"), F.lit("R"), F.lit("-")), F.col("l_returnflag")), F.when(F.col("l_linestatus") == "O", "Trifásico").otherwise("1"), F.concat(F.lit("XV 5G"), F.col("l_linenumber") * 4)]
    rows = [cell(F.col("h") + 1 + F.col("i"), at(j), v) for j, v in enumerate(lines)]
    title = F.when(F.col("o_orderpriority").startswith("1"), "Lista de Preços").otherwise("Mapa")
    items = [cell(F.lit(1), F.lit(1), title), cell(F.col("h") + 1, F.lit(2), F.lit("DESIGNAÇÃO dos trabalhos")), cell(F.col("h") + 1, F.lit(3), F.lit("Quant."))]
    form = [cell(F.lit(45), F.lit(18), F.concat(F.lit("FE_v"), F.date_format("o_orderdate", "yyyyMMdd"))), cell(F.lit(2), F.lit(2), F.lit("Origem"))]
    noise = [F.struct((3 - F.col("s")).alias("sheet_no"), F.col("h").alias("row"), at(0).alias("col"), F.lit("Origem dos dados").alias("value")), F.struct((3 - F.col("s")).alias("sheet_no"), (F.col("h") + 3).alias("row"), at(1).alias("col"), F.lit("7,5").alias("value"))]
    told = F.concat(F.array(*noise), F.when(F.col("o_orderstatus") == "F", F.array(*calc)).when(F.col("o_orderstatus") == "O", F.array(*items)).otherwise(F.array(*form)))
    heads = o.select(F.col("o_orderkey").alias("path"), F.explode(told).alias("x"))
    return heads.unionByName(li.select(F.col("o_orderkey").alias("path"), F.explode(F.array(*rows)).alias("x"))).select("path", "x.*")


@query("""SELECT o_orderkey AS path, CASE o_orderstatus WHEN 'F' THEN 'calc_summary' WHEN 'O' THEN CASE WHEN o_orderpriority LIKE '1%' THEN 'lpu' ELSE 'mqt' END ELSE 'ficha_eletrotecnica' END AS kind,
CASE WHEN o_orderstatus = 'P' THEN strftime(o_orderdate, 'FE_v%Y%m%d') END AS version FROM orders""")
def detected_kinds(spark, d):
    """What a workbook is, by its first sheet that tells."""
    return grids.detect(_cells(spark, d))


@query("""SELECT o_orderkey AS path, CAST(1 + o_orderkey % 2 AS INTEGER) AS sheet_no, CAST(2 + o_orderkey % 4 + row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS INTEGER) AS "row",
lower(o_orderpriority) AS section, 'Q.P.ÁTRIO ' || l_suppkey AS origin, 'ATRIO' || l_suppkey AS board, 'Pavilhão ' || l_partkey AS destination, CAST(l_quantity AS DOUBLE) AS kva,
CASE l_returnflag WHEN 'A' THEN 'D' WHEN 'N' THEN 'F' END AS protection_type, CASE WHEN l_linestatus = 'O' THEN 3 ELSE 1 END AS phases, CAST(l_linenumber * 4 AS DOUBLE) AS section_mm2
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'""")
def calculation_rows(spark, d):
    """Rows of calculation tables: sheet and header by words, columns by patterns, typed fields, sections filled forward."""
    r = grids.calc_rows(_cells(spark, d))
    return r.select("path", "sheet_no", "row", "section", "origin", text.core(F.col("origin")).alias("board"), "destination", "kva", "protection_type", "phases", "section_mm2")


@query("SELECT o_orderkey AS path, 'Coluna não reconhecida: «Observações».' AS warning FROM orders WHERE o_orderstatus = 'F'")
def calculation_warnings(spark, d):
    """Columns of calculation tables that no pattern knows."""
    return grids.calc_warnings(_cells(spark, d))


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F')
SELECT o_orderkey AS path, 'ele.potencia_alimentar_kva' AS key, CAST(CAST(l_quantity AS DOUBLE) AS VARCHAR) AS value FROM l WHERE i = 1
UNION ALL SELECT o_orderkey, 'ele.entrada', CASE WHEN l_linestatus = 'O' THEN 'Trif' ELSE 'Mono' END FROM l WHERE i = 1
UNION ALL SELECT o_orderkey, 'ele.quadros', string_agg('Q.P.ÁTRIO ' || l_suppkey, '; ' ORDER BY i) FROM (SELECT o_orderkey, l_suppkey, min(i) AS i FROM l GROUP BY ALL) GROUP BY o_orderkey
UNION ALL SELECT o_orderkey, 'ele.cabos', string_agg('XV 5G' || (n * 4), '; ' ORDER BY i) FROM (SELECT o_orderkey, l_linenumber AS n, min(i) AS i FROM l GROUP BY ALL) GROUP BY o_orderkey""")
def calculation_values(spark, d):
    """What projects take from their calculation tables."""
    return grids.calc_values(grids.calc_rows(_cells(spark, d)))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS DOUBLE) * CASE WHEN l_returnflag = 'A' THEN 100 ELSE 1 END AS number FROM lineitem")
def scaled_readings(spark, d):
    """Readings times the scale of their key, where the map has one."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("key"), F.col("l_quantity").cast("string").alias("value"))
    return grids.scaled(li, spark.createDataFrame([("A", 100.0)], "key string, scale double")).drop("key", "value")


@query("""WITH i AS (SELECT l_orderkey AS project, CAST(regexp_replace('EL' || lpad(CAST(l_partkey % 7 AS VARCHAR), 3, '0'), '[^0-9]', '', 'g') AS VARCHAR) AS k FROM lineitem WHERE l_linenumber <= 3),
p AS (SELECT l_orderkey AS project, lpad(CAST(l_suppkey % 7 AS VARCHAR), 3, '0') AS k, l_suppkey % 7 = 0 AS is_index FROM lineitem),
a AS (SELECT DISTINCT project, k FROM i), b AS (SELECT project, k, bool_or(is_index) AS is_index FROM p GROUP BY ALL)
SELECT coalesce(a.project, b.project) AS project, count(*) FILTER (b.k IS NULL) AS missing, count(*) FILTER (a.k IS NULL AND NOT b.is_index) AS unlisted FROM a FULL JOIN b ON a.project = b.project AND a.k = b.k GROUP BY 1""")
def index_and_pages(spark, d):
    """Listed sheets against drawn ones by the digits of their codes; the index sheet need not be listed."""
    li = table(spark, d, "lineitem")
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    listed = li.filter("l_linenumber <= 3").select(F.col("l_orderkey").alias("p1"), digits(F.concat(F.lit("EL"), F.lpad((F.col("l_partkey") % 7).cast("string"), 3, "0"))).alias("k1")).distinct()
    drawn = li.groupBy(F.col("l_orderkey").alias("p2"), digits(F.lpad((F.col("l_suppkey") % 7).cast("string"), 3, "0")).alias("k2")).agg(F.bool_or(F.col("l_suppkey") % 7 == 0).alias("is_index"))
    j = listed.join(drawn, (F.col("p1") == F.col("p2")) & (F.col("k1") == F.col("k2")), "full_outer")
    return j.groupBy(F.coalesce("p1", "p2").alias("project")).agg(F.count_if(F.col("k2").isNull()).alias("missing"), F.count_if(F.col("k1").isNull() & ~F.col("is_index")).alias("unlisted"))


@query("""WITH a AS (SELECT l_orderkey, 'L' || (l_partkey % 6) || CASE WHEN l_suppkey % 2 = 0 THEN '.1' ELSE '' END || ' luminaria' AS designation, CASE WHEN l_returnflag = 'A' THEN 'm' ELSE 'un' END AS unit, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
SELECT l_orderkey, CASE WHEN count(DISTINCT unit) <= 1 THEN CAST(sum(q) AS BIGINT) END AS quantity, count(*) AS articles FROM a WHERE starts_with(designation, 'L3 ') OR starts_with(designation, 'L5 ') GROUP BY l_orderkey""")
def slot_quantities(spark, d):
    """Quantity of a luminaire by its codes: L3 is not L3.1 and not L31; the sum stands if there is one unit."""
    code = F.concat(F.lit("L"), F.col("l_partkey") % 6, F.when(F.col("l_suppkey") % 2 == 0, ".1").otherwise(""), F.lit(" luminaria"))
    a = table(spark, d, "lineitem").select("l_orderkey", code.alias("designation"), F.when(F.col("l_returnflag") == "A", "m").otherwise("un").alias("unit"), F.col("l_quantity").cast("long").alias("q"))
    pattern = r"(?i)^\s*(?:" + "|".join(rf"\Q{c}\E" for c in "L3/L5".split("/")) + r")(?![\d.])"
    return a.filter(F.col("designation").rlike(pattern)).groupBy("l_orderkey").agg(summaries.guarded_sum(F.col("q"), F.col("unit")).alias("quantity"), F.count(F.lit(1)).alias("articles"))


@query("""SELECT o_orderkey, o_totalprice IS NOT NULL AND o_orderpriority LIKE '%URGENT%' AS a, NOT (o_orderstatus = 'F') AS b, o_custkey % 3 = 0 AS has_key, false AS texts_have_no_order, true AS constant FROM orders""")
def rule_nodes(spark, d):
    """Every node of the rule language: presence with links, containment, constants, and texts without an order."""
    o = table(spark, d, "orders").withColumns({"key": F.when(F.col("o_custkey") % 6 == 0, "x").when(F.col("o_custkey") % 6 == 3, "[]"), "links": F.when(F.col("o_custkey") % 6 == 3, F.array(F.lit("key")))})
    return o.select("o_orderkey", condition(("all", ("has", "o_totalprice"), ("~", "o_orderpriority", "urgent"))).alias("a"), condition(("not", ("=", "o_orderstatus", "f"))).alias("b"), condition(("has", "key"), F.col("links")).alias("has_key"), condition((">", "o_orderpriority", "a")).alias("texts_have_no_order"), condition(("const", True)).alias("constant"))


@query("""WITH m AS (SELECT p_partkey, p_brand AS maker, p_size AS reference, p_type AS model FROM part WHERE p_partkey % 3 = 0), l AS (SELECT p_brand AS maker, p_size AS reference, min(p_partkey) AS item FROM part WHERE p_partkey % 3 = 1 GROUP BY ALL), n AS (SELECT p_brand AS maker, p_type AS model, min(p_partkey) AS item FROM part WHERE p_partkey % 3 = 1 GROUP BY ALL)
SELECT p_partkey, coalesce(l.item, n.item) AS item, CASE WHEN l.item IS NOT NULL THEN 'reference' WHEN n.item IS NOT NULL THEN 'model' ELSE 'unmatched' END AS rule FROM m LEFT JOIN l USING (maker, reference) LEFT JOIN n ON n.maker = m.maker AND n.model = m.model""")
def manifest_matches(spark, d):
    """Sheets of a manifest against the library: by maker and reference, else by maker and model; the unmatched are told."""
    p = table(spark, d, "part")
    lib = p.filter("p_partkey % 3 = 1")
    by_reference = lib.groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("r"))
    by_model = lib.groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("m"))
    j = p.filter("p_partkey % 3 = 0").select("p_partkey", "p_brand", "p_size", "p_type").join(by_reference, ["p_brand", "p_size"], "left").join(by_model, ["p_brand", "p_type"], "left")
    return j.select("p_partkey", F.coalesce("r", "m").alias("item"), F.when(F.col("r").isNotNull(), "reference").when(F.col("m").isNotNull(), "model").otherwise("unmatched").alias("rule"))


@query("""SELECT o_orderkey, sha256('v2|' || o_orderkey)[1:32] AS new_id, count(l_orderkey) AS children, coalesce(bool_and(sha256('v2|' || l_orderkey)[1:32] = sha256('v2|' || o_orderkey)[1:32]), true) AS same_parent FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def revision_clones(spark, d):
    """A copy of a revision with its children under new ids."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("id"))
    parents, children = checks.remapped(o, table(spark, d, "lineitem").select("l_orderkey"), "id", "l_orderkey", "v2")
    n = children.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    j = parents.join(n, F.col("id") == F.col("l_orderkey"), "left")
    return j.select("o_orderkey", F.col("id").alias("new_id"), F.coalesce("n", F.lit(0)).alias("children"), F.coalesce(F.col("id") == F.col("l_orderkey"), F.lit(True)).alias("same_parent"))


@query("""SELECT value, count(DISTINCT piece) AS pieces, string_agg(DISTINCT piece, ',' ORDER BY piece) AS "where" FROM (SELECT p_brand AS value, l_returnflag || l_linestatus AS piece FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY value HAVING count(DISTINCT piece) > 1""")
def values_of_several_pieces(spark, d):
    """Each value with the set of pieces that have it, where there are several."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("value")), F.col("l_partkey") == F.col("p_partkey"))
    g = li.groupBy("value").agg(F.sort_array(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("s")).filter(F.size("s") > 1)
    return g.select("value", F.size("s").cast("long").alias("pieces"), F.array_join("s", ",").alias("where"))


@query("""WITH n AS (SELECT DISTINCT n_name AS name FROM nation UNION SELECT DISTINCT 'Cliente ' || (c_custkey % 50) FROM customer), k AS (SELECT DISTINCT n_name AS name FROM nation WHERE n_regionkey = 1) SELECT lower(name) AS name FROM n WHERE name NOT IN (SELECT name FROM k)""")
def new_blocked_terms(spark, d):
    """Names harvested from several sources that are not yet blocked, compared folded."""
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"))
    c = table(spark, d, "customer").select(F.concat(F.lit("Cliente "), F.col("c_custkey") % 50).alias("name"))
    known = table(spark, d, "nation").filter("n_regionkey = 1").select(text.fold(F.col("n_name")).alias("name")).distinct()
    return n.unionByName(c).distinct().select(text.fold(F.col("name")).alias("name")).distinct().join(known, "name", "left_anti")


@query("""SELECT o_custkey AS project, kind, severity, count(*) AS n FROM (SELECT o_custkey, unnest(CASE o_orderkey % 3 WHEN 0 THEN ['email', 'nif'] WHEN 1 THEN ['phone'] ELSE [] END) AS kind, unnest(CASE o_orderkey % 3 WHEN 0 THEN ['error', 'error'] WHEN 1 THEN ['warning'] ELSE [] END) AS severity FROM orders) GROUP BY ALL""")
def personal_summary(spark, d):
    """Hits of personal data by project, kind and severity: what has a check digit or a form of its own is an error, the rest a warning."""
    texts = F.get(F.array(F.lit("mail ana@x.pt nif 123456789"), F.lit("tel. 912 345 678"), F.lit("nada")), (F.col("o_orderkey") % 3).cast("int"))
    hits = table(spark, d, "orders").select(F.col("o_custkey").alias("project"), F.explode(privacy.personal(texts)).alias("h"))
    severity = F.when(F.col("h.kind").isin("email", "nif", "cc"), "error").otherwise("warning")
    return hits.groupBy("project", F.col("h.kind").alias("kind"), severity.alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH f AS (SELECT l_orderkey, CASE l_linenumber WHEN 3 THEN 'obra.local' WHEN 1 THEN 'req.nome' WHEN 2 THEN 'ele.potencia' ELSE 'outro.' || l_linenumber END AS key, min(l_partkey) AS v, count(DISTINCT l_suppkey) > 1 AS open FROM lineitem GROUP BY ALL),
k(key, rank) AS (VALUES ('req.nome', 0), ('obra.local', 1), ('ele.potencia', 2)), s AS (SELECT l_orderkey, f.key, CASE WHEN f.key = 'req.nome' THEN '•••' ELSE CAST(v AS VARCHAR) END AS shown, open, coalesce(rank, 3) AS rank FROM f LEFT JOIN k USING (key))
SELECT l_orderkey, string_agg(key || '=' || shown, '; ' ORDER BY rank, key) AS said, count(*) FILTER (open) AS open_conflicts, count(*) FILTER (open) = 0 AS can_confirm, 3 - count(*) FILTER (rank < 3) AS missing FROM s GROUP BY l_orderkey""")
def record_view(spark, d):
    """A record's values nested in the order of the catalogue, unknown keys last, masked, with conflicts and missing keys."""
    catalogue = ["req.nome", "obra.local", "ele.potencia"]
    n = F.col("l_linenumber")
    key = F.when(n == 3, "obra.local").when(n == 1, "req.nome").when(n == 2, "ele.potencia").otherwise(F.concat(F.lit("outro."), n))
    f = table(spark, d, "lineitem").groupBy("l_orderkey", key.alias("key")).agg(F.min("l_partkey").cast("string").alias("v"), (F.count_distinct("l_suppkey") > 1).alias("open"))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k) for k in catalogue]), F.col("key")), F.lit(0)), F.lit(len(catalogue) + 1).cast("long"))
    shown = F.when(F.col("key") == "req.nome", privacy.MARK).otherwise(F.col("v"))
    g = f.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(rank.alias("r"), "key", shown.alias("s")))).alias("x"), F.count_if("open").alias("open_conflicts"), F.count_if(rank <= len(catalogue)).alias("n"))
    said = F.array_join(F.transform("x", lambda x: F.concat_ws("=", x["key"], x["s"])), "; ")
    return g.select("l_orderkey", said.alias("said"), "open_conflicts", (F.col("open_conflicts") == 0).alias("can_confirm"), (len(catalogue) - F.col("n")).alias("missing"))


@query("""WITH i AS (SELECT p_partkey, p_size AS slot, [p_partkey % 7, p_partkey % 11] AS units FROM part), s AS (SELECT DISTINCT c_custkey AS project, c_custkey % 50 + 1 AS slot FROM customer)
SELECT project, slot, arg_min(p_partkey, (NOT list_contains(units, project % 11), p_partkey)) AS item, bool_or(list_contains(units, project % 11)) AS own FROM s JOIN i USING (slot) GROUP BY ALL""")
def slot_items(spark, d):
    """The item of each slot: one of the project's own if there is any, else the first of the slot."""
    i = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("slot"), F.explode(F.array(F.col("p_partkey") % 7, F.col("p_partkey") % 11)).alias("unit"))
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("project"), (F.col("c_custkey") % 50 + 1).alias("slot"), (F.col("c_custkey") % 11).alias("unit"))
    first = i.groupBy("slot").agg(F.min("p_partkey").alias("first"))
    own = i.groupBy("slot", "unit").agg(F.min("p_partkey").alias("mine"))
    j = s.join(first, "slot").join(own, ["slot", "unit"], "left")
    return j.select("project", "slot", F.coalesce("mine", "first").alias("item"), F.col("mine").isNotNull().alias("own"))
