"""Named queries over the driver's tables, each with the same question in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veritab.functions import dates, numbers, params, privacy, text, words
from veritab.operators import checks, decisions, lifecycle, merge, sinks, summaries, windows
from veritab.plans.logic import condition
from veritab.plans.registry import QUERIES, SQL, query
from veritab.sources.tables import facts, table

# scans, projections, predicates


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus IN ('F', 'O') AND l_quantity >= 49 AND l_shipdate IS NOT NULL")
def filter_equal_in(spark, d):
    li = table(spark, d, "lineitem").filter((F.col("l_returnflag") == "R") & F.col("l_linestatus").isin("F", "O") & (F.col("l_quantity") >= 49) & F.col("l_shipdate").isNotNull())
    return li.select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') = '7'")
def filter_json_field(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").filter(k == "7").select("event_id", k.cast("long").alias("k"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name ELSE '•••' END AS shown, substr(c_name, 1, 3) AS head FROM customer")
def mask_personal_values(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name")).otherwise(privacy.MARK).alias("shown"), F.substring("c_name", 1, 3).alias("head"))


@query("SELECT o_orderkey, CASE WHEN starts_with(o_orderpriority, '1') THEN 'D' WHEN starts_with(o_orderpriority, '2') THEN 'F' WHEN regexp_matches(o_orderpriority, '^[3-4]') THEN 'MON' ELSE 'NA' END AS code FROM orders")
def decode_enum(spark, d):
    p = F.col("o_orderpriority")
    code = F.when(p.startswith("1"), "D").when(p.startswith("2"), "F").when(p.rlike("^[3-4]"), "MON").otherwise("NA")
    return table(spark, d, "orders").select("o_orderkey", code.alias("code"))


@query("""SELECT p_partkey, CASE WHEN p_type LIKE '%BRASS%' THEN 'brass' WHEN p_size > 40 THEN 'large' WHEN regexp_matches(p_brand, '#[1-2]') THEN 'low' END AS key,
 CASE WHEN p_type LIKE '%BRASS%' THEN 'by_type' WHEN p_size > 40 THEN 'by_size' WHEN regexp_matches(p_brand, '#[1-2]') THEN 'by_brand' END AS rule FROM part""")
def classify_first_match(spark, d):
    """Ordered rules; the first that fits gives the key, and its name is kept."""
    rules = [("brass", "by_type", F.col("p_type").contains("BRASS")), ("large", "by_size", F.col("p_size") > 40), ("low", "by_brand", F.col("p_brand").rlike("#[1-2]"))]
    hit = F.coalesce(*[F.when(c, F.struct(F.lit(k).alias("key"), F.lit(r).alias("rule"))) for k, r, c in rules])
    return table(spark, d, "part").withColumn("h", hit).select("p_partkey", "h.key", "h.rule")


@query(r"""WITH c AS (SELECT s_suppkey, n_regionkey || '.' || n_nationkey || '.' || s_suppkey AS code FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT code, len(string_split(code, '.')) AS level, regexp_extract(code, '^(.*)\.[^.]+$', 1) AS parent FROM c""")
def code_hierarchy(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    code = F.concat_ws(".", "n_regionkey", "n_nationkey", "s_suppkey")
    return s.select(code.alias("code"), F.size(F.split(code, r"\.")).alias("level"), F.regexp_extract(code, r"^(.*)\.[^.]+$", 1).alias("parent"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def missing_keys(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity = 50)")
def exists_any(spark, d):
    li = table(spark, d, "lineitem").filter("l_quantity = 50")
    return table(spark, d, "supplier").join(li, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey")


# joins


@query("SELECT o_custkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'A' GROUP BY o_custkey")
def open_conflict_count(spark, d):
    li = table(spark, d, "lineitem").filter("l_returnflag = 'A'").select("l_orderkey")
    return table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT DISTINCT n_name, p_brand FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
WHERE n_nationkey <> 3 AND p_size = 5""")
def names_of_others(spark, d):
    n, p = table(spark, d, "nation").filter("n_nationkey <> 3"), table(spark, d, "part").filter("p_size = 5")
    j = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "p_brand").distinct()


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN (SELECT l_orderkey AS k, max(l_linenumber) AS m FROM lineitem GROUP BY 1) ON l_orderkey = k AND l_linenumber = m")
def current_version(spark, d):
    """Rows of the current version: one pass by a window, in place of a join with the maximum."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return li.withColumn("m", F.max("l_linenumber").over(Window.partitionBy("l_orderkey"))).filter("l_linenumber = m").drop("m")


@query("SELECT event_id, coalesce(c_name, 'Sistema') AS actor FROM events LEFT JOIN customer ON user_id = c_custkey AND c_acctbal > 5000")
def actor_names(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal > 5000").select("c_custkey", "c_name")
    return table(spark, d, "events").join(c, F.col("user_id") == F.col("c_custkey"), "left").select("event_id", F.coalesce("c_name", F.lit("Sistema")).alias("actor"))


@query("""WITH c AS (SELECT c_custkey, c_nationkey AS scope, 'Q' || (c_custkey % 120) AS cc FROM customer), s AS (SELECT s_suppkey, s_nationkey AS scope, 'Q' || (s_suppkey % 120) AS sc FROM supplier),
m AS (SELECT c_custkey, s_suppkey, CASE WHEN cc = sc THEN 2 WHEN starts_with(cc, sc) OR starts_with(sc, cc) THEN 1 ELSE 0 END AS score FROM (SELECT c_custkey, scope, cc[2:] AS cc FROM c) JOIN (SELECT s_suppkey, scope, sc[2:] AS sc FROM s) USING (scope)),
b AS (SELECT *, max(score) OVER (PARTITION BY c_custkey) AS top FROM m WHERE score > 0)
SELECT c_custkey, s_suppkey, score, count(*) OVER (PARTITION BY c_custkey) = 1 AS is_unique FROM b WHERE score = top""")
def best_name_matches(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("scope"), text.core(F.concat(F.lit("Q"), F.col("c_custkey") % 120)).alias("cc"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("scope"), text.core(F.concat(F.lit("Q"), F.col("s_suppkey") % 120)).alias("sc"))
    return merge.best_matches(c, s, "scope", "c_custkey", "s_suppkey", "cc", "sc")


@query("""WITH a AS (SELECT o_orderkey, o_orderstatus AS st, o_orderpriority AS pr FROM orders), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS st, CASE WHEN o_orderkey % 15 = 0 THEN '9' ELSE o_orderpriority END AS pr FROM orders WHERE o_orderkey % 2 = 0)
SELECT o_orderkey, field, a, b FROM (SELECT o_orderkey, 'st' AS field, a.st AS a, b.st AS b FROM a JOIN b USING (o_orderkey) UNION ALL SELECT o_orderkey, 'pr', a.pr, b.pr FROM a JOIN b USING (o_orderkey)) WHERE a <> b""")
def changed_fields(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("st"), F.col("o_orderpriority").alias("pr"))
    b = o.filter("o_orderkey % 2 = 0").withColumns({"st": F.when(F.col("o_orderkey") % 10 == 0, "X").otherwise(F.col("st")), "pr": F.when(F.col("o_orderkey") % 15 == 0, "9").otherwise(F.col("pr"))})
    return merge.changed_cells(o, b, "o_orderkey", ["st", "pr"])


@query("""WITH u AS (SELECT l_orderkey AS project, p_size AS geometry, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey),
p AS (SELECT DISTINCT least(x.b, y.b) AS a, greatest(x.b, y.b) AS b, x.project FROM u x JOIN u y ON x.project = y.project AND x.geometry = y.geometry AND x.b <> y.b)
SELECT a, b, count(*) AS projects FROM p GROUP BY a, b""")
def equivalence_mining(spark, d):
    """Unordered pairs of brands that share a project and a size; the brands of one meet as a small set."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "part").select("p_partkey", "p_size", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    sets = li.groupBy("l_orderkey", "p_size").agg(F.sort_array(F.collect_set("p_brand")).alias("s")).filter(F.size("s") > 1)
    pair = sets.select("l_orderkey", "s", F.posexplode("s").alias("i", "a")).select("l_orderkey", "a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
    return pair.distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("projects"))


@query("""WITH r AS (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_regionkey END AS owner FROM nation)
SELECT r_regionkey, count(n_nationkey) AS n FROM region LEFT JOIN r ON owner IS NULL OR owner = r_regionkey GROUP BY r_regionkey""")
def owner_or_anyone(spark, d):
    """A null owner fits everyone: the general requirements are counted once, the owned ones meet by an equi-join."""
    r = table(spark, d, "nation").withColumn("owner", F.when(F.col("n_nationkey") % 3 == 0, None).otherwise(F.col("n_regionkey")))
    own = r.filter("owner is not null").groupBy("owner").agg(F.count(F.lit(1)).alias("own"))
    general = r.filter("owner is null").agg(F.count(F.lit(1)).alias("general"))
    j = table(spark, d, "region").join(own, F.col("r_regionkey") == F.col("owner"), "left").join(F.broadcast(general))  # one row
    return j.select("r_regionkey", (F.coalesce("own", F.lit(0)) + F.col("general")).alias("n"))


@query("""WITH a AS (SELECT p_partkey, p_brand, p_retailprice, p_size % 3 AS v FROM part WHERE p_size <= 10)
SELECT x.p_partkey, arg_min(y.p_partkey, (y.v, y.p_retailprice, y.p_partkey)) AS alternative, count(*) AS n FROM a x JOIN a y ON x.p_brand = y.p_brand AND x.p_partkey <> y.p_partkey WHERE y.v < 2 GROUP BY x.p_partkey""")
def ranked_alternatives(spark, d):
    """The best other item of the category: the two best of each category answer for all its items."""
    a = table(spark, d, "part").filter("p_size <= 10").withColumn("v", F.col("p_size") % 3).select("p_partkey", "p_brand", "p_retailprice", "v")
    ok = a.filter("v < 2").withColumn("r", F.row_number().over(Window.partitionBy("p_brand").orderBy("v", "p_retailprice", "p_partkey")))
    best = ok.groupBy("p_brand").agg(F.count(F.lit(1)).alias("all"), F.max(F.when(F.col("r") == 1, F.col("p_partkey"))).alias("one"), F.max(F.when(F.col("r") == 2, F.col("p_partkey"))).alias("two"))
    out = a.join(best, "p_brand").withColumn("alternative", F.when(F.col("p_partkey") == F.col("one"), F.col("two")).otherwise(F.col("one")))
    return out.select("p_partkey", "alternative", (F.col("all") - (F.col("v") < 2).cast("long")).alias("n")).filter("n > 0")


@query("""WITH e AS (SELECT DISTINCT p_brand AS b FROM part WHERE p_size < 25), f AS (SELECT DISTINCT p_brand AS b FROM part WHERE p_type LIKE 'STANDARD%' AND p_size > 30)
SELECT coalesce(e.b, f.b) AS brand, CASE WHEN f.b IS NULL THEN 'missing' WHEN e.b IS NULL THEN 'extra' ELSE 'present' END AS state FROM e FULL JOIN f ON e.b = f.b""")
def expected_and_present(spark, d):
    p = table(spark, d, "part")
    e, f = p.filter("p_size < 25").select(F.col("p_brand").alias("e")).distinct(), p.filter(F.col("p_type").startswith("STANDARD") & (F.col("p_size") > 30)).select(F.col("p_brand").alias("f")).distinct()
    state = F.when(F.col("f").isNull(), "missing").when(F.col("e").isNull(), "extra").otherwise("present")
    return e.join(f, F.col("e") == F.col("f"), "full_outer").select(F.coalesce("e", "f").alias("brand"), state.alias("state"))


@query("""WITH f AS (SELECT year(o_orderdate) AS y, sha256('R1|' || o_custkey || '|' || o_orderpriority) AS fp, bool_or(o_orderstatus = 'P') AS ign FROM orders GROUP BY ALL),
e AS (SELECT min(y) AS first, max(y) AS last FROM f), b AS (SELECT y, fp, ign FROM f, e WHERE y < last), n AS (SELECT y - 1 AS y, fp FROM f, e WHERE y > first)
SELECT coalesce(b.y, n.y) + 1 AS run, coalesce(b.fp, n.fp) AS fingerprint, CASE WHEN n.fp IS NULL THEN 'fixed' WHEN b.fp IS NULL THEN 'new' WHEN ign THEN 'ignored' ELSE 'open' END AS state FROM b FULL JOIN n ON b.y = n.y AND b.fp = n.fp""")
def issue_lifecycle(spark, d):
    """What becomes of each issue from one yearly run to the next, over all years."""
    o = table(spark, d, "orders").withColumn("run", F.year("o_orderdate"))
    o = o.withColumn("fingerprint", text.fingerprint(F.lit("R1"), F.col("o_custkey").cast("string"), F.col("o_orderpriority")))
    return lifecycle.persist_runs(o.groupBy("run", "fingerprint").agg(F.max(F.when(F.col("o_orderstatus") == "P", "ignored").otherwise("")).alias("status")))


@query("SELECT o_orderkey, max(ts) AS last_ts FROM orders LEFT JOIN events ON user_id = o_custkey AND ts <= o_orderdate + INTERVAL 30 YEAR GROUP BY o_orderkey")
def last_run_before(spark, d):
    """As-of join: the last event of the user at or before a date."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), (F.col("o_orderdate") + F.expr("interval 30 years")).alias("at"))
    e = table(spark, d, "events").select("user_id", "ts", F.col("ts").alias("last_ts"))
    return windows.as_of(o, e, "user_id", "at", "ts", ["last_ts"]).select("o_orderkey", "last_ts")


@query("""SELECT r_regionkey, count(DISTINCT l_partkey) AS found FROM region JOIN lineitem ON l_shipdate <= TIMESTAMP '1993-01-01' + to_years(CAST(r_regionkey AS INTEGER)) GROUP BY r_regionkey""")
def found_so_far(spark, d):
    """Distinct issues up to each approval: only the first appearance of an issue matters, then a range join of two small sides."""
    first = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.min("l_shipdate").alias("first"))
    per = first.groupBy(F.greatest(F.lit(0), F.ceil(F.months_between(F.col("first").cast("timestamp"), F.lit("1993-01-01").cast("timestamp")) / 12)).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    r = table(spark, d, "region").select("r_regionkey")
    return r.join(per, F.col("y") <= F.col("r_regionkey")).groupBy("r_regionkey").agg(F.sum("n").alias("found"))


# aggregations


@query("""WITH f AS (SELECT DISTINCT l_partkey, l_suppkey, CAST(l_discount * 100 AS INTEGER) // 6 AS form FROM lineitem),
g AS (SELECT l_partkey, count(DISTINCT form) AS n_forms, count(DISTINCT l_suppkey) AS n_sources, min(form) AS v FROM f GROUP BY l_partkey)
SELECT l_partkey, CASE WHEN n_forms = 1 THEN CAST(v AS VARCHAR) END AS value, CASE WHEN n_forms > 1 THEN 'conflict' WHEN n_sources > 1 THEN 'agreed' ELSE 'pending' END AS status, n_sources, n_forms FROM g""")
def consolidate_sources(spark, d):
    li = table(spark, d, "lineitem").withColumn("form", F.floor(F.round(F.col("l_discount") * 100) / 6).cast("int"))
    li = li.withColumn("ord", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return merge.consolidate(li, ["l_partkey"], "l_suppkey", "ord", F.col("form"), F.col("form").cast("string")).select("l_partkey", "value", "status", "n_sources", "n_forms")


@query("""SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O' AND o_orderpriority LIKE '1%') AS critical FROM orders GROUP BY o_custkey""")
def run_totals(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if((F.col("o_orderstatus") == "O") & F.col("o_orderpriority").startswith("1")).alias("critical"))


@query("""SELECT user_id, event_type AS step, strftime(ts, '%Y-%m-%d') AS day, CAST(sum(least(greatest(CAST(round(value) AS BIGINT), 0), 60)) AS BIGINT) AS seconds, count(*) AS beats FROM events GROUP BY ALL""")
def seconds_by_step(spark, d):
    from veritab.streaming.seconds import step_seconds

    return step_seconds(table(spark, d, "events")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("SELECT event_type, arg_max(event_id, (ts, event_id)) AS latest, count(DISTINCT user_id) AS users, max(event_id) + 1 AS next_number FROM events GROUP BY event_type")
def latest_by_kind(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"), F.count_distinct("user_id").alias("users"), (F.max("event_id") + 1).alias("next_number"))


@query("""WITH f AS (SELECT l_orderkey, p_brand, min(l_linenumber) AS o FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) SELECT l_orderkey, string_agg(p_brand, ',' ORDER BY o, p_brand) AS brands FROM f GROUP BY l_orderkey""")
def first_seen_lists(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    f = li.groupBy("l_orderkey", "p_brand").agg(F.min("l_linenumber").alias("o"))
    ordered = F.array_sort(F.collect_list(F.struct("o", "p_brand")))
    return f.groupBy("l_orderkey").agg(F.array_join(F.transform(ordered, lambda x: x["p_brand"]), ",").alias("brands"))


@query("""SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) <= 1 THEN CAST(sum(CAST(l_quantity AS BIGINT)) AS VARCHAR) END AS total,
CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (p_type LIKE '%STEEL%' AND p_type NOT LIKE '%PLATED%'), 0) AS BIGINT) AS steel FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""")
def guarded_sums(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    q = F.col("l_quantity").cast("long")
    steel = F.when(F.col("p_type").rlike("STEEL") & ~F.col("p_type").rlike("PLATED"), q).otherwise(0)
    return li.groupBy("l_orderkey").agg(summaries.guarded_sum(q, F.col("l_returnflag")).cast("string").alias("total"), F.sum(steel).alias("steel"))


@query("""WITH u AS (SELECT l_orderkey AS piece FROM lineitem WHERE l_quantity = 1 UNION ALL SELECT l_orderkey FROM lineitem WHERE l_discount = 0.1) SELECT piece, count(*) AS fields FROM u GROUP BY piece HAVING count(*) >= 2""")
def reused_pieces(spark, d):
    li = table(spark, d, "lineitem")
    u = li.filter("l_quantity = 1").select(F.col("l_orderkey").alias("piece")).unionAll(li.filter("l_discount = 0.1D").select(F.col("l_orderkey").alias("piece")))
    return u.groupBy("piece").agg(F.count(F.lit(1)).alias("fields")).filter("fields >= 2")


@query("""WITH p AS (SELECT DISTINCT p_brand, p_size FROM part), g AS (SELECT p_brand, p_size, p_size - row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS isl FROM p),
r AS (SELECT p_brand, min(p_size) AS a, max(p_size) AS b FROM g GROUP BY p_brand, isl)
SELECT p_brand, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS pages FROM r GROUP BY p_brand""")
def pages_per_value(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(summaries.compressed(F.collect_set("p_size")).alias("pages"))


@query("""WITH s AS (SELECT user_id, event_type, sum(least(greatest(CAST(round(value) AS BIGINT), 0), 60)) AS sec FROM events GROUP BY ALL), e(event_type, lo, hi) AS (VALUES ('click', 2, 4), ('view', 1, 3), ('purchase', 4, 8))
SELECT user_id, round(1 - sum(sec) / (sum((lo + hi) / 2.0) * 60), 6) AS reduction FROM s JOIN e USING (event_type) GROUP BY user_id""")
def weighted_reduction(spark, d):
    """1 - spent / midpoint of the estimate, over the steps that have one."""
    from veritab.streaming.seconds import step_seconds

    e = spark.createDataFrame([("click", 2, 4), ("view", 1, 3), ("purchase", 4, 8)], "step string, lo int, hi int")
    s = step_seconds(table(spark, d, "events")).groupBy("user_id", "step").agg(F.sum("seconds").alias("sec")).join(F.broadcast(e), "step")
    return s.groupBy("user_id").agg(F.round(1 - F.try_divide(F.sum("sec"), F.sum((F.col("lo") + F.col("hi")) / 2.0) * 60), 6).alias("reduction"))


@query("""WITH c AS (SELECT l_orderkey, string_agg(DISTINCT p_brand, ' / ' ORDER BY p_brand) FILTER (l_returnflag = 'A') AS "A", string_agg(DISTINCT p_brand, ' / ' ORDER BY p_brand) FILTER (l_returnflag = 'N') AS "N", string_agg(DISTINCT p_brand, ' / ' ORDER BY p_brand) FILTER (l_returnflag = 'R') AS "R" FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)
SELECT *, len(list_distinct(list_filter(["A", "N", "R"], lambda x: x IS NOT NULL))) > 1 AS differs FROM c""")
def coherence_matrix(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    out = summaries.coherence_matrix(li, "l_orderkey", "l_returnflag", "p_brand", ["A", "N", "R"])
    return out.select("l_orderkey", *[F.nullif(F.col(c), F.lit("")).alias(c) for c in "ANR"], "differs")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY o) = 1 AS f FROM (SELECT l_suppkey, l_returnflag, l_orderkey * 10 + l_linenumber AS o FROM lineitem)),
p AS (SELECT l_suppkey, o, row_number() OVER (PARTITION BY l_suppkey ORDER BY f DESC, o) AS place FROM r) SELECT * FROM p WHERE place <= 8""")
def sampled_evidence(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    return summaries.evidence(li, "l_suppkey", ["l_returnflag"], "o", 8).select("l_suppkey", "o", "place")


@query(
    "WITH w AS (SELECT doc_id, string_split_regex(lower(text), '[^a-z]+') AS w FROM documents), h AS (SELECT doc_id, "
    + ", ".join(f"len(list_filter(w, lambda x: list_contains([{', '.join(repr(x) for x in v)}], x))) AS h_{k}" for k, v in text.STOP_WORDS.items())
    + " FROM w) SELECT doc_id, CASE WHEN greatest(h_en, h_de, h_fr, h_es) < 3 THEN NULL WHEN h_en = greatest(h_en, h_de, h_fr, h_es) THEN 'en' WHEN h_de = greatest(h_en, h_de, h_fr, h_es) THEN 'de' WHEN h_fr = greatest(h_en, h_de, h_fr, h_es) THEN 'fr' ELSE 'es' END AS language FROM h"
)
def language_by_stop_words(spark, d):
    return table(spark, d, "documents").select("doc_id", text.language(F.col("text")).alias("language"))


# windows, order, sets


@query("""SELECT l_orderkey, l_linenumber, last_value(CASE WHEN l_linenumber % 3 = 1 THEN CAST(l_partkey AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM lineitem""")
def section_fill(spark, d):
    fill = windows.fill_forward(F.col("l_partkey").cast("string"), F.col("l_linenumber") % 3 == 1, ["l_orderkey"], F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fill.alias("section"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
m AS (SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM l)
SELECT doc_id, i FROM m WHERE NOT regexp_matches(line, '[.!?]$') AND regexp_matches(nxt, '^[A-Za-z]')""")
def broken_lines(spark, d):
    """A line without closing mark before one that starts with a letter."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).withColumn("i", F.col("p") + 1)
    m = lines.withColumn("nxt", F.lead("line").over(Window.partitionBy("doc_id").orderBy("i")))
    return m.filter(~F.col("line").rlike(r"[.!?]$") & F.col("nxt").rlike("^[A-Za-z]")).select("doc_id", "i")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
n AS (SELECT doc_id, i, lower(trim(line, ' ')) AS s FROM l WHERE length(trim(line, ' ')) > 15 AND len(string_split(trim(line, ' '), ' ')) >= 3)
SELECT doc_id, i, s FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY i) AS r FROM n) WHERE r > 1""")
def repeated_items(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    n = lines.select("doc_id", (F.col("p") + 1).alias("i"), F.lower(F.trim("line")).alias("s")).filter((F.length("s") > 15) & (F.size(F.split("s", " ")) >= 3))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "s").orderBy("i"))).filter("r > 1").drop("r")


@query("""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
n AS (SELECT doc_id, i, line, array_to_string(string_split(line, ' ')[1:3], ' ') AS o FROM l WHERE len(string_split(line, ' ')) >= 3)
SELECT doc_id, i FROM (SELECT *, first_value(line) OVER w AS f, row_number() OVER w AS r FROM n WINDOW w AS (PARTITION BY doc_id, o ORDER BY i)) WHERE r > 1 AND f <> line""")
def near_equal_items(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "l")).select("doc_id", (F.col("p") + 1).alias("i"), F.trim("l").alias("line"))
    n = lines.filter(F.size(F.split("line", " ")) >= 3).withColumn("o", F.array_join(F.slice(F.split("line", " "), 1, 3), " "))
    w = Window.partitionBy("doc_id", "o").orderBy("i")
    return n.withColumns({"f": F.first("line").over(w), "r": F.row_number().over(w)}).filter("r > 1 and f <> line").select("doc_id", "i")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN 'na' WHEN l_tax * 1000 <= l_quantity AND l_quantity <= l_extendedprice / 1000 THEN 'ok' ELSE 'fail' END AS result FROM lineitem""")
def chain_check(spark, d):
    li = table(spark, d, "lineitem")
    low = F.when(F.col("l_tax") != 0, F.col("l_tax") * 1000)
    return li.select("l_orderkey", "l_linenumber", numbers.three_valued(low, F.col("l_quantity"), F.col("l_extendedprice") / 1000).alias("result"))


@query("""WITH RECURSIVE v AS (SELECT DISTINCT user_id, value FROM events), g AS (SELECT user_id, min(value) AS first FROM v GROUP BY user_id
UNION ALL SELECT g.user_id, n.first FROM g JOIN LATERAL (SELECT min(value) AS first FROM v WHERE v.user_id = g.user_id AND v.value - g.first > 3.5) n ON n.first IS NOT NULL)
SELECT e.user_id, first, count(*) AS n FROM (SELECT e.user_id, e.value, (SELECT max(first) FROM g WHERE g.user_id = e.user_id AND g.first <= e.value) AS first FROM events e) e GROUP BY ALL""")
def anchored_clusters(spark, d):
    """Values of a user cut where they leave the reach of the first value of their group."""
    return windows.anchored_groups(table(spark, d, "events"), "user_id", "value", 3.5)


@query("SELECT n_nationkey, CASE WHEN n < 26 THEN chr(65 + n) ELSE chr(64 + n // 26) || chr(65 + n % 26) END AS label FROM (SELECT n_nationkey, n_nationkey * 7 AS n FROM nation)")
def base26_labels(spark, d):
    return table(spark, d, "nation").select("n_nationkey", text.letters(F.col("n_nationkey") * 7).alias("label"))


@query("SELECT c_mktsegment AS kind, c_nationkey AS real, dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY first, c_nationkey) AS number FROM (SELECT c_mktsegment, c_nationkey, min(c_custkey) AS first FROM customer GROUP BY ALL)")
def pseudonym_numbers(spark, d):
    """The n-th distinct real value of its kind, in order of appearance."""
    f = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("kind"), F.col("c_nationkey").alias("real")).agg(F.min("c_custkey").alias("first"))
    return f.select("kind", "real", F.dense_rank().over(Window.partitionBy("kind").orderBy("first", "real")).alias("number"))


@query("SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def latest_activity(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "ts", "user_id")


@query("""WITH c AS (SELECT DISTINCT p_brand, p_size FROM part) SELECT p_brand, p_size, row_number() OVER (ORDER BY substr(p_brand, 1, 6), CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER), p_size) AS place FROM c""")
def natural_order(spark, d):
    c = table(spark, d, "part").select("p_brand", "p_size").distinct()
    letters, number = F.substring("p_brand", 1, 6), F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    return windows.numbered(c.withColumns({"_l": letters, "_n": number}), "place", "_l", "_n", "p_size").drop("_l", "_n")


@query("""WITH s AS (SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey) FILTER (l_returnflag = 'R'))) AS a, list_sort(list_distinct(list(l_suppkey) FILTER (l_returnflag <> 'R'))) AS b FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, len(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))) AS missing, len(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))) AS extra FROM s""")
def set_differences(spark, d):
    r = F.col("l_returnflag") == "R"
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(r, F.col("l_suppkey"))).alias("a"), F.collect_set(F.when(~r, F.col("l_suppkey"))).alias("b"))
    return s.select("l_orderkey", F.size(F.array_except("a", "b")).alias("missing"), F.size(F.array_except("b", "a")).alias("extra"))


# scalar functions


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN l_orderkey || '.' || lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') WHEN 1 THEN (l_orderkey % 900 + 1) || '.' || lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') || ',5' WHEN 2 THEN l_orderkey || ',25' ELSE 'n/a' END AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, t,
 TRY_CAST(CASE WHEN contains(t, ',') THEN replace(replace(t, '.', ''), ',', '.') ELSE t END AS DOUBLE) AS ingest,
 TRY_CAST(CASE WHEN regexp_matches(t, '^[+-]?[0-9]{1,3}([. ][0-9]{3})+(,[0-9]+)?$') THEN replace(replace(replace(t, '.', ''), ' ', ''), ',', '.') ELSE replace(t, ',', '.') END AS DOUBLE) AS checked,
 TRY_CAST(replace(t, ',', '.') AS DOUBLE) AS rule FROM v""")
def number_grammars(spark, d):
    low = F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0")
    o, k = F.col("l_orderkey").cast("string"), F.col("l_linenumber") % 4
    t = F.when(k == 0, F.concat_ws(".", o, low)).when(k == 1, F.concat(F.concat_ws(".", (F.col("l_orderkey") % 900 + 1).cast("string"), low), F.lit(",5"))).when(k == 2, F.concat(o, F.lit(",25"))).otherwise("n/a")
    v = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", t.alias("t"))
    return v.select("l_orderkey", "l_linenumber", "t", numbers.ingest_number(F.col("t")).alias("ingest"), numbers.checked_number(F.col("t")).alias("checked"), numbers.rule_number(F.col("t")).alias("rule"))


@query("SELECT l_orderkey, l_linenumber, round(CAST(printf('%.2f', l_discount * 7) AS DECIMAL(30,10)), 1) = round(CAST(printf('%.1f', l_discount * 7) AS DECIMAL(30,10)), 1) AS same FROM lineitem")
def same_readings(spark, d):
    a, b = F.format_string("%.2f", F.col("l_discount") * 7), F.format_string("%.1f", F.col("l_discount") * 7)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numbers.same_reading(a, b).alias("same"))


@query(r"SELECT doc_id, sha256(replace(strip_accents(lower(l)), 'ß', 'ss')) AS h FROM (SELECT doc_id, trim(regexp_replace(string_split(text, chr(10))[1], '\s+', ' ', 'g')) AS l FROM documents)")
def folded_titles(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.fold(F.split("text", "\n")[0]), 256).alias("h"))


@query("""WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%m/%Y') AS t, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders)
SELECT o_orderkey, strptime(t, '%m/%Y') IS NOT NULL AS known, substr(t, 4) || '-' || substr(t, 1, 2) AS month, substr(iso, 9) || '/' || substr(iso, 6, 2) || '/' || substr(iso, 1, 4) AS shown, substr(iso, 1, 7) > '1995-06-15' AS later FROM o""")
def month_text(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "MM/yyyy").alias("t"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"))
    m = dates.month_year(F.col("t"))
    return o.select("o_orderkey", m.isNotNull().alias("known"), m.alias("month"), dates.shown_date(F.col("iso")).alias("shown"), (m > "1995-06-15").alias("later"))


@query("""SELECT c_custkey, CASE WHEN length(n) <> 9 THEN false ELSE CASE WHEN s % 11 < 2 THEN 0 ELSE 11 - s % 11 END = CAST(n[9] AS INTEGER) END AS ok
FROM (SELECT c_custkey, n, list_sum(list_transform(range(1, 9), lambda i: (10 - i) * CAST(n[i] AS INTEGER))) AS s FROM (SELECT c_custkey, lpad(CAST(c_custkey * 7919 AS VARCHAR), 9, '2') AS n FROM customer))""")
def tax_numbers(spark, d):
    n = F.lpad((F.col("c_custkey") * 7919).cast("string"), 9, "2")
    return table(spark, d, "customer").select("c_custkey", numbers.tax_number_ok(n).alias("ok"))


@query("""WITH p AS (SELECT p_partkey, p_brand, p_size, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size + p_partkey % 9 - 4 END AS offered FROM part),
c AS (SELECT p_brand, CASE WHEN offered IS NULL THEN 'na' WHEN offered >= p_size THEN 'ok' ELSE 'fail' END AS r FROM p)
SELECT p_brand, CASE WHEN count(*) FILTER (r = 'fail') > 0 THEN 'fails' WHEN count(*) FILTER (r = 'na') > 0 THEN 'to_confirm' ELSE 'meets' END AS verdict, count(*) FILTER (r = 'na') AS unknown FROM c GROUP BY p_brand""")
def requirement_verdicts(spark, d):
    p = table(spark, d, "part").withColumn("offered", F.when(F.col("p_size") % 7 != 0, F.col("p_size") + F.col("p_partkey") % 9 - 4))
    ok = params.satisfies(F.lit(">="), F.col("p_size").cast("string"), F.col("offered").cast("string"))
    c = p.withColumn("r", F.when(ok.isNull(), "na").when(ok, "ok").otherwise("fail"))
    return c.groupBy("p_brand").agg(params.verdict(F.col("r")).alias("verdict"), F.count_if(F.col("r") == "na").alias("unknown"))


# rules and findings


@query("SELECT o_orderkey, ((o_totalprice > 150000 AND o_orderstatus <> 'F') OR (o_orderpriority IN ('1-URGENT', '2-HIGH') AND NOT o_orderstatus = 'P')) AS active FROM orders")
def activation_rules(spark, d):
    rule = ("any", ("all", (">", "o_totalprice", 150000), ("<>", "o_orderstatus", "F")), ("all", ("in", "o_orderpriority", ["1-URGENT", "2-HIGH"]), ("not", ("=", "o_orderstatus", "P"))))
    return table(spark, d, "orders").select("o_orderkey", condition(rule).alias("active"))


@query("""WITH q AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount = 0.1 AND l_quantity > 48), m AS (SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)), p AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_tax = 0 GROUP BY l_orderkey HAVING count(*) > 1)
SELECT 'CAL-1' AS rule_id, 'warning' AS severity, CAST(l_orderkey AS VARCHAR) AS key, sha256('CAL-1|' || l_orderkey) AS fingerprint, min('line ' || l_linenumber) AS message FROM q GROUP BY l_orderkey
UNION ALL SELECT 'CNT-1', 'critical', CAST(o_orderkey AS VARCHAR), sha256('CNT-1|' || o_orderkey), 'no lines' FROM m
UNION ALL SELECT 'TAX-1', 'info', CAST(l_orderkey AS VARCHAR), sha256('TAX-1|' || l_orderkey), 'lines without tax: ' || n FROM p""")
def rule_findings(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    key = F.col("l_orderkey").cast("string")
    a = lifecycle.findings(li.filter("l_discount = 0.1D and l_quantity > 48"), "CAL-1", "warning", key, F.concat(F.lit("line "), F.col("l_linenumber").cast("string")))
    b = lifecycle.findings(o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti"), "CNT-1", "critical", F.col("o_orderkey").cast("string"), F.lit("no lines"))
    n = li.filter("l_tax = 0").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    c = lifecycle.findings(n, "TAX-1", "info", key, F.concat(F.lit("lines without tax: "), F.col("n").cast("string")))
    return lifecycle.merged(a, b, c)


@query("""WITH e AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'approved' ELSE 'proposed' END AS status, p_name AS label FROM part WHERE p_partkey % 2 = 0), p AS (SELECT p_partkey AS k, p_brand AS label FROM part WHERE p_partkey % 5 <> 0)
SELECT coalesce(e.k, p.k) AS k, coalesce(e.status, 'proposed') AS status, CASE WHEN e.status = 'approved' THEN e.label ELSE p.label END AS label FROM e FULL JOIN p ON e.k = p.k WHERE e.status = 'approved' OR p.k IS NOT NULL""")
def seeded_terms(spark, d):
    p = table(spark, d, "part").withColumn("k", F.col("p_partkey"))
    e = p.filter("k % 2 = 0").select("k", F.when(F.col("k") % 3 == 0, "approved").otherwise("proposed").alias("status"), F.col("p_name").alias("label"))
    return merge.seed(e, p.filter("k % 5 <> 0").select("k", F.col("p_brand").alias("label")), "k", ["label"])


@query("""SELECT o_custkey AS project, o_orderkey AS piece, o_orderkey AS ord, 'status' AS key, o_orderstatus AS value_text FROM orders UNION ALL SELECT o_custkey, o_orderkey, o_orderkey, 'priority', o_orderpriority FROM orders""")
def long_facts(spark, d):
    return facts(table(spark, d, "orders"), "o_custkey", "o_orderkey", {"status": "o_orderstatus", "priority": "o_orderpriority"}, "o_orderkey")


# personal data


_KINDS = {k: f"regexp_extract_all(text, '{p}')" for k, p in privacy.PATTERNS.items()}


@query("SELECT doc_id, " + ", ".join(f"len({v}) AS n_{k}" for k, v in _KINDS.items()) + " FROM documents")
def personal_counts(spark, d):
    """Hits of each kind, by built-in functions alone."""
    t = table(spark, d, "documents")
    return t.select("doc_id", *[F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias(f"n_{k}") for k, p in privacy.PATTERNS.items()])


_NESTED = "text"
for _p in privacy.PATTERNS.values():
    _NESTED = f"regexp_replace({_NESTED}, '{_p}', '•••', 'g')"


@query(f"SELECT doc_id, sha256({_NESTED}) AS masked FROM documents")
def masked_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(privacy.masked(F.col("text"), privacy.PATTERNS), 256).alias("masked"))


@query(f"""WITH h AS (SELECT doc_id, unnest({_KINDS['email']}) AS v FROM documents), f AS (SELECT v, min(doc_id) AS first, count(*) AS n FROM h GROUP BY v)
SELECT v AS real, 'user' || row_number() OVER (ORDER BY first, v) || '@example.invalid' AS pseudonym, n FROM f""")
def email_pseudonyms(spark, d):
    """One pseudonym for each real address, numbered by first appearance; two passes: harvest, then number."""
    hits = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(privacy.PATTERNS["email"]), F.lit(0))).alias("real"))
    f = hits.groupBy("real").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    f = windows.numbered(f, "number", "first", "real")
    return f.select("real", F.concat(F.lit("user"), F.col("number").cast("string"), F.lit("@example.invalid")).alias("pseudonym"), "n")


# further checks


@query("""WITH f AS (SELECT l_orderkey AS project, l_returnflag AS piece, p_brand AS v, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem JOIN part ON l_partkey = p_partkey),
o AS (SELECT * FROM f WHERE r = 1), ref AS (SELECT project, arg_min(v, CASE piece WHEN 'N' THEN 1 ELSE 2 END) AS rv, arg_min(piece, CASE piece WHEN 'N' THEN 1 ELSE 2 END) AS rp FROM o WHERE piece IN ('N', 'A') GROUP BY project)
SELECT project, 'brand' AS key, piece, v AS value, rv AS reference, rp AS reference_piece FROM o JOIN ref USING (project) WHERE piece <> rp AND v <> rv""")
def differs_from_reference(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    f = li.select(F.col("l_orderkey").alias("project"), F.col("l_returnflag").alias("piece"), F.lit("brand").alias("key"), F.col("p_brand").alias("value_text"), order.alias("ord"))
    return checks.against_reference(f, "piece", ["N", "A"])


@query("""WITH v AS (SELECT l_orderkey, l_linestatus AS val, count(DISTINCT l_suppkey) AS n, max(strftime(l_shipdate, '%Y-%m-%d')) AS dt, min(l_suppkey) AS p FROM lineitem GROUP BY ALL),
g AS (SELECT l_orderkey, count(*) AS "values", list_sort(list((n, dt, p))) AS s FROM v GROUP BY l_orderkey HAVING count(*) > 1)
SELECT l_orderkey, "values", CASE WHEN NOT ("values" = 2 AND s[1][1] = 1 AND s[2][1] > 1) THEN 'several' WHEN s[1][2] > s[2][2] THEN 'others_outdated' ELSE 'piece_wrong' END AS reading FROM g""")
def likely_readings(spark, d):
    li = table(spark, d, "lineitem").withColumn("day", F.date_format("l_shipdate", "yyyy-MM-dd"))
    return checks.likely_reading(li, ["l_orderkey"], "l_suppkey", "l_linestatus", "day").drop("piece")


TERMS = ("pathetic", "the and attion", "de la", "all rights", "und die")


@query(f"""WITH p AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS w FROM documents), t AS (SELECT unnest({list(TERMS)!r}) AS term)
SELECT doc_id, term FROM p JOIN t ON contains(w, ' ' || term || ' ')""")
def incompatible_terms(spark, d):
    t = spark.createDataFrame([(x,) for x in TERMS], "term string")
    p = table(spark, d, "documents").select("doc_id", F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")).alias("w"))
    return checks.terms_in(p, F.col("w"), t).select("doc_id", "term")


@query(r"""WITH n AS (SELECT c_custkey, 'Maria ' || c_mktsegment || ' ' || n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey),
v AS (SELECT DISTINCT c_custkey, unnest([name, 'Maria ' || regexp_extract(name, '(\S+)$', 1), 'M. ' || regexp_extract(name, '(\S+)$', 1)]) AS variant FROM n)
SELECT variant, min(c_custkey) AS c_custkey FROM v GROUP BY variant HAVING count(DISTINCT c_custkey) = 1""")
def unshared_name_variants(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    v = c.select("c_custkey", F.explode(words.name_variants(F.concat_ws(" ", F.lit("Maria"), "c_mktsegment", "n_name"))).alias("variant"))
    return checks.unique_owner(v, "variant", "c_custkey")


@query("""SELECT c_custkey, 'Customer ' || c_name || ' of ' || coalesce(n_name, '[n_name]') || ': ' || c_mktsegment AS text, CASE WHEN n_name IS NULL THEN 'n_name' ELSE '' END AS missing
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3""")
def assembled_texts(spark, d):
    n = table(spark, d, "nation").filter("n_regionkey < 3")
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    done, missing = words.fill_template("Customer {c_name} of {n_name}: {c_mktsegment}", ["c_name", "n_name", "c_mktsegment"])
    return c.select("c_custkey", done.alias("text"), missing.alias("missing"))


@query("""WITH l AS (SELECT o_custkey AS k, o_orderdate + INTERVAL 30 YEAR AS ts, max(o_orderstatus) AS label FROM orders GROUP BY ALL)
SELECT e.event_id, arg_max(l.label, l.ts) AS label FROM events e LEFT JOIN l ON l.k = e.user_id AND l.ts <= e.ts GROUP BY e.event_id""")
def values_between_labels(spark, d):
    at = (F.col("o_orderdate") + F.expr("interval 30 years")).alias("ts")
    labels = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), at).agg(F.max("o_orderstatus").alias("label"))
    values = table(spark, d, "events").select(F.col("user_id").alias("k"), "ts", F.col("event_id").alias("value"))
    return checks.between_labels(labels, values, "k", "ts").select(F.col("value").alias("event_id"), "label")


@query("""SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS "A", count(*) FILTER (l_returnflag = 'N') AS "N", count(*) FILTER (l_returnflag = 'R') AS "R" FROM lineitem GROUP BY l_orderkey""")
def difference_counts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").pivot("l_returnflag", ["A", "N", "R"]).count().na.fill(0)


@query("""SELECT o_orderkey, o_orderdate + INTERVAL 2 YEAR < TIMESTAMP '1997-06-01' AS old FROM orders""")
def outdated_sheets(spark, d):
    return table(spark, d, "orders").select("o_orderkey", dates.is_old(F.col("o_orderdate").cast("date"), 2, F.lit("1997-06-01").cast("date")).alias("old"))


@query("""SELECT user_id, event_type, CAST(sum(v) AS BIGINT) AS seconds FROM (SELECT user_id, event_type, CAST(floor(value) AS BIGINT) AS v FROM events) GROUP BY ALL""")
def upserted_seconds(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.floor("value").cast("long").alias("seconds"), "event_id")
    old, new = e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1")
    stored = old.groupBy("user_id", "event_type").agg(F.sum("seconds").alias("seconds"))
    return sinks.upsert_add(stored, new, ["user_id", "event_type"], "seconds")


@query("""SELECT o_orderkey FROM orders WHERE (o_orderkey, o_orderstatus) NOT IN (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END FROM orders WHERE o_orderkey % 3 <> 0)""")
def pieces_to_read_again(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("hash"))
    cache = o.filter("o_orderkey % 3 <> 0").withColumn("hash", F.when(F.col("o_orderkey") % 4 == 0, "X").otherwise(F.col("hash")))
    return sinks.unread(o, cache, ["o_orderkey", "hash"]).select("o_orderkey")


# read models and decisions


@query("""SELECT c_custkey, coalesce(o.n, 0) AS files, coalesce(o.open, 0) AS open_conflicts, o.latest AS status, coalesce(e.n, 0) AS activity
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS open, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey
LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) e ON user_id = c_custkey""")
def project_list(spark, d):
    """One row per project from grouped tables, each read once."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"))
    e = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("activity"))
    j = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").join(e, F.col("c_custkey") == F.col("user_id"), "left")
    return j.select("c_custkey", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("open", F.lit(0)).alias("open_conflicts"), "status", F.coalesce("activity", F.lit(0)).alias("activity"))


@query("""SELECT o_orderkey, count(l_orderkey) > 0 AND coalesce(bool_and(l_quantity > 1), true) AND o_orderstatus <> 'P' AS ready,
concat_ws(', ', CASE WHEN count(l_orderkey) = 0 THEN 'no sections' END, CASE WHEN NOT coalesce(bool_and(l_quantity > 1), true) THEN 'not approved' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END) AS why
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderstatus""")
def approval_conditions(spark, d):
    """Conditions per document as flags, with the reasons of those that fail."""
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_quantity") > 1).alias("ok"))
    j = table(spark, d, "orders").join(s, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    flags = {"no sections": F.col("ok").isNotNull(), "not approved": F.coalesce("ok", F.lit(True)), "pending": F.col("o_orderstatus") != "P"}
    why = F.concat_ws(", ", *[F.when(~c, F.lit(k)) for k, c in flags.items()])
    return j.select("o_orderkey", (why == "").alias("ready"), why.alias("why"))


@query("""WITH dec AS (SELECT user_id * 11 AS k, arg_max(event_type, event_id) AS choice, arg_max(value, event_id) AS v FROM events GROUP BY 1),
j AS (SELECT coalesce(o_orderkey, k) AS o_orderkey, o_orderstatus, choice, CASE WHEN o_orderkey IS NULL THEN 'unknown' WHEN NOT o_orderstatus IN ('O', 'P') THEN 'not open' WHEN v <= 5 THEN 'no reason' END AS refused FROM dec LEFT JOIN orders ON o_orderkey = k)
SELECT o_orderkey, refused FROM j""")
def decision_log(spark, d):
    """Which decisions are taken and which are refused."""
    return _decided(spark, d)[1]


@query("""WITH dec AS (SELECT user_id * 11 AS k, arg_max(event_type, event_id) AS choice, arg_max(value, event_id) AS v FROM events GROUP BY 1)
SELECT o_orderkey, CASE WHEN k IS NOT NULL AND o_orderstatus IN ('O', 'P') AND v > 5 THEN choice ELSE o_orderstatus END AS status FROM orders LEFT JOIN dec ON o_orderkey = k""")
def decided_state(spark, d):
    return _decided(spark, d)[0]


def _decided(spark, d):
    state = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    asked = table(spark, d, "events").select((F.col("user_id") * 11).alias("o_orderkey"), "event_id", F.col("event_type").alias("choice"), "value")
    guards = [("not open", F.col("status").isin("O", "P")), ("no reason", F.col("d_value") > 5)]
    return decisions.decide(state, asked, "o_orderkey", "event_id", guards, {"status": F.col("d_choice")})


@query("""WITH r AS (SELECT o_custkey, count(*) AS n_runs, max(o_orderdate) AS last FROM orders GROUP BY o_custkey), s AS (SELECT user_id, sum(CAST(floor(value) AS BIGINT)) AS sec FROM events GROUP BY user_id)
SELECT coalesce(o_custkey, user_id) AS project, coalesce(n_runs, 0) AS runs, CAST(coalesce(sec, 0) AS BIGINT) AS seconds FROM r FULL JOIN s ON o_custkey = user_id""")
def project_metrics(spark, d):
    """Metrics of every project that either side knows."""
    r = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("p")).agg(F.count(F.lit(1)).alias("runs"))
    s = table(spark, d, "events").groupBy(F.col("user_id").alias("q")).agg(F.sum(F.floor("value").cast("long")).alias("seconds"))
    return r.join(s, F.col("p") == F.col("q"), "full_outer").select(F.coalesce("p", "q").alias("project"), F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("seconds", F.lit(0)).alias("seconds"))


@query("""SELECT l_orderkey, bool_or(l_quantity > 49) AS large, NOT bool_or(l_returnflag = 'R') AS none_returned FROM lineitem GROUP BY l_orderkey""")
def rules_over_collections(spark, d):
    """Rules over the rows of a collection: some row fits, no row fits."""
    some = lambda rule: F.bool_or(condition(rule))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(some((">", "l_quantity", 49)).alias("large"), (~some(("=", "l_returnflag", "R"))).alias("none_returned"))


@query("""WITH t AS (SELECT o_orderkey, o_orderstatus || ' ' || o_orderpriority AS was, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END || ' ' || o_orderpriority AS now FROM orders)
SELECT o_orderkey, was, now, was <> now AS changed FROM t""")
def revision_diff(spark, d):
    o = table(spark, d, "orders")
    was = o.select("o_orderkey", F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("was"))
    now = o.select(F.col("o_orderkey").alias("k"), F.concat_ws(" ", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")), "o_orderpriority").alias("now"))
    return was.join(now, F.col("o_orderkey") == F.col("k"), "left").select("o_orderkey", "was", "now", (F.col("was") != F.col("now")).alias("changed"))


@query("""SELECT l_suppkey, list_sort(list((l_orderkey, l_linenumber, l_partkey)))[1][1] AS first_order, count(*) AS n, array_to_string(list_sort(list(CAST(l_orderkey AS BIGINT) * 100 + l_linenumber))[1:3], ',') AS head FROM lineitem GROUP BY l_suppkey""")
def nested_occurrences(spark, d):
    """A read model with nested rows: occurrences of a designation in order, and its first ones."""
    li = table(spark, d, "lineitem")
    n = li.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    first = li.withColumn("r", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey"))).filter("r <= 3")
    o = first.groupBy("l_suppkey").agg(F.sort_array(F.collect_list(F.struct("r", "l_orderkey", "l_linenumber"))).alias("o"))  # three rows at most
    head = F.array_join(F.transform("o", lambda x: (x["l_orderkey"] * 100 + x["l_linenumber"]).cast("string")), ",")
    return n.join(o, "l_suppkey").select("l_suppkey", F.col("o")[0]["l_orderkey"].alias("first_order"), "n", head.alias("head"))


__all__ = ["QUERIES", "SQL"]
