"""Queries over histories: an order of many lists, readings merged into drafts, batches that count once."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veritab.operators import draft, order, sequences
from veritab.plans.registry import add, query
from veritab.sources.stage import saved, shared_dir
from veritab.sources.tables import table
from veritab.streaming import draft as stream
from veritab.streaming import seconds


@query("""WITH RECURSIVE first AS (SELECT l_orderkey AS l, p_brand AS k, min(l_linenumber) AS p FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
keys AS (SELECT k, min(l * 10 + p) AS r FROM first GROUP BY k),
pairs AS (SELECT k AS a, lead(k) OVER (PARTITION BY l ORDER BY p, k) AS b FROM first),
c AS (SELECT a, b, count(*) AS n FROM pairs WHERE b IS NOT NULL GROUP BY ALL),
net AS (SELECT list({'a': c.a, 'b': c.b, 'w': c.n - coalesce(o.n, 0)}) AS e FROM c LEFT JOIN c o ON o.a = c.b AND o.b = c.a WHERE c.n > coalesce(o.n, 0)),
rounds AS (
  SELECT -1 AS level, (SELECT list({'k': k, 'r': r}) FROM keys) AS l, CAST([] AS STRUCT(w BIGINT, r BIGINT, k VARCHAR)[]) AS gone
  UNION ALL
  SELECT level + 1, list_filter(l, lambda x: NOT list_contains(list_transform(out, lambda o: o.k), x.k)), out
  FROM (SELECT level, l, list_filter(scored, lambda s: s.w = 0 OR (list_min(scored).w > 0 AND s.k = list_min(scored).k)) AS out
    FROM (SELECT level, l, list_transform(l, lambda x: {'w': CAST(coalesce(list_sum(list_transform(list_filter(e, lambda y: y.b = x.k AND list_contains(list_transform(l, lambda z: z.k), y.a)), lambda y: y.w)), 0) AS BIGINT), 'r': CAST(x.r AS BIGINT), 'k': x.k}) AS scored
      FROM rounds, net WHERE len(l) > 0))),
placed AS (SELECT level, unnest(gone) AS g FROM rounds)
SELECT g.k AS key, level, row_number() OVER (ORDER BY level, g.r, g.k) - 1 AS place FROM placed""")
def merged_brand_order(spark, d):
    """One order of the brands from the order of lines in all orders."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return order.merged_keys(lines.select(F.col("l_orderkey").alias("list"), F.col("l_linenumber").alias("pos"), F.col("p_brand").alias("key")))


#: Event types as sources, in the order of their readings; two of them are decisions.
TYPES = ["view", "purchase", "click", "signup", "error"]
STEPS_SQL = """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, (event_id // 2000) * 10 + list_position(['view', 'purchase', 'click', 'signup', 'error'], event_type) - 1 AS seq,
    CASE event_type WHEN 'signup' THEN 'choose' WHEN 'error' THEN 'manual' ELSE 'read' END AS kind, CASE WHEN event_type <> 'signup' THEN event_type END AS source,
    CASE WHEN event_type <> 'signup' THEN CAST(CAST(floor(value / 60) AS BIGINT) AS VARCHAR) END AS form, CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS value FROM events),
one AS (SELECT key, seq, kind, source, form, max(value) AS value FROM e GROUP BY ALL),
r AS (SELECT key, seq, kind, source, list({'source': source, 'form': form, 'value': value} ORDER BY form) FILTER (form IS NOT NULL) AS found, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM one GROUP BY key, seq, kind, source),
d AS (
  SELECT key, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS seq, '' AS action, CAST(NULL AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS form, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS source, CAST([] AS STRUCT(source VARCHAR, form VARCHAR, value VARCHAR)[]) AS cands
  FROM (SELECT DISTINCT key FROM r)
  UNION ALL
  SELECT key, n, seq, action,
    CASE WHEN action = 'closed' THEN pick.value WHEN action IN ('new', 'replace') THEN found[1].value WHEN action = 'conflict' THEN NULL ELSE value END,
    CASE WHEN action = 'closed' THEN pick.form WHEN action IN ('new', 'replace') THEN found[1].form WHEN action = 'conflict' THEN NULL ELSE form END,
    CASE WHEN action IN ('closed', 'new') THEN 'pending' WHEN action = 'conflict' THEN 'conflict' ELSE status END,
    CASE WHEN action = 'closed' THEN pick.source WHEN status IS NULL AND action IN ('new', 'conflict') THEN reader ELSE source END,
    CASE WHEN action = 'closed' THEN [] WHEN action = 'joined' THEN list_concat(list_filter(cands, lambda c: c.source <> reader), found)
      WHEN action = 'conflict' THEN CASE WHEN status IS NULL OR source = reader THEN found ELSE list_concat([{'source': source, 'form': form, 'value': value}], found) END ELSE cands END
  FROM (SELECT *, CASE WHEN kind <> 'read' THEN CASE WHEN pick IS NULL THEN 'refused' ELSE 'closed' END
      WHEN status IS NULL THEN CASE WHEN len(found) > 1 THEN 'conflict' ELSE 'new' END
      WHEN len(cands) > 0 THEN 'joined'
      WHEN len(found) = 1 AND source = reader THEN 'replace'
      WHEN len(found) = 1 AND form = found[1].form THEN 'agree'
      ELSE 'conflict' END AS action
    FROM (SELECT d.key, r.n, r.seq, d.value, d.form, d.status, d.source, d.cands, r.kind, r.source AS reader, r.found,
        CASE r.kind WHEN 'choose' THEN CASE WHEN len(d.cands) > 0 THEN d.cands[1] END WHEN 'manual' THEN {'source': 'manual', 'form': r.found[-1].form, 'value': r.found[-1].value} END AS pick
      FROM d JOIN r ON r.key = d.key AND r.n = d.n + 1)))
SELECT key, seq, action, value, status, source, CASE WHEN len(cands) > 0 THEN array_to_string(list_transform(cands, lambda c: c.source || '=' || c.value), ' / ') END AS candidates FROM d WHERE n > 0"""


def _readings(spark, d):
    """Readings of users by event types: a stretch of 2,000 events is one reading of each type."""
    t, told = F.col("event_type"), F.col("event_type") != "signup"
    at = F.array_position(F.array(*[F.lit(x) for x in TYPES]), t) - 1
    e = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("key"),
        (F.floor(F.col("event_id") / 2000) * 10 + at).cast("long").alias("seq"),
        F.when(t == "signup", "choose").when(t == "error", "manual").otherwise("read").alias("kind"),
        F.when(told, t).alias("source"),
        F.when(told, F.floor(F.col("value") / 60).cast("string")).alias("form"),
        F.round(F.col("value") * 100).cast("long").cast("string").alias("value"),
    )
    return draft.readings(e)


@query(STEPS_SQL)
def draft_steps(spark, d):
    """Readings and decisions merged into each user's draft, in order."""
    return draft.merged_in_order(_readings(spark, d))


def streamed_draft(spark, d):
    """The same through a stream that is restarted between three stretches of the readings, the draft as its state."""
    rows = saved(_readings(spark, d), "readings")
    top = rows.agg(F.max("seq")).first()[0] or 0
    where = f"{shared_dir(spark)}/draft-{uuid.uuid4().hex}"
    cuts = [-1, top // 3, 2 * top // 3, top]
    for a, b in zip(cuts, cuts[1:], strict=False):
        rows.filter((F.col("seq") > a) & (F.col("seq") <= b)).write.mode("append").parquet(f"{where}/in")
        stream.drain(spark, f"{where}/in", f"{where}/steps", f"{where}/state")
    return stream.steps_of(spark, f"{where}/steps")


add(streamed_draft, STEPS_SQL)


@query("""SELECT user_id, event_type AS step, CAST(ts AS DATE) AS day, CAST(sum(least(greatest(CAST(round(value) AS BIGINT), 0), 60)) AS BIGINT) AS seconds, count(*) AS beats
FROM events GROUP BY ALL""")
def ledger_seconds(spark, d):
    """Seconds per step through a stream of batches that count once; half of them are folded, and one is tried again."""
    where = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    events = table(spark, d, "events")
    half = F.col("event_id") % 2 == 0
    events.filter(half).write.parquet(f"{where}/in")
    ledger = seconds.run_once(spark, f"{where}/in", f"{where}/out", f"{where}/state")
    ledger.fold()
    events.filter(~half).write.mode("append").parquet(f"{where}/in")
    ledger = seconds.run_once(spark, f"{where}/in", f"{where}/out", f"{where}/state")
    ledger.add(seconds.step_seconds(events), 0)
    return ledger.totals()


# decisions in their order: a user's events are decisions on one thing each

ACTIONS = {
    "issue": ["ignore", "reopen", "fix", "ignore", "reopen"],
    "revision": ["read", "confirm", "resolve", "read", "confirm"],
    "document": ["approve_section", "approve_section", "approve", "edit", "approve_section"],
    "block": ["require", "review", "approved", "require", "rejected"],
}
ARGS = {
    "issue": ("CASE WHEN value > 30 THEN concat('note ', event_id) END", "CASE WHEN value > 30 THEN 'note ' || event_id END"),
    "revision": ("CASE WHEN value > 60 THEN 'conflict' END", "CASE WHEN value > 60 THEN 'conflict' END"),
    "document": ("concat('p', event_id % 3)", "'p' || (event_id % 3)"),
    "block": ("CASE WHEN value > 40 THEN 'approved' ELSE 'rejected' END", "CASE WHEN value > 40 THEN 'approved' ELSE 'rejected' END"),
}


def _decisions(spark, d, name):
    kind = F.array_position(F.array(*[F.lit(x) for x in TYPES]), F.col("event_type")).cast("int")
    return table(spark, d, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("seq"), F.element_at(F.array(*[F.lit(a) for a in ACTIONS[name]]), kind).alias("action"),
        F.expr(ARGS[name][0]).alias("arg"), (F.floor(F.col("event_id") / 3) % sequences.SECTIONS).cast("int").alias("section"),
    )


def _walked(name: str, start: str, columns: str, why: str, step: str, status: str, detail: str) -> str:
    """SQL that walks a user's events one by one: ``columns`` of the state ``s``, the refusal, the next state, what is shown."""
    return f"""WITH RECURSIVE e AS (SELECT 'u' || user_id AS key, event_id AS seq, {ACTIONS[name]!r}[list_position({TYPES!r}, event_type)] AS action, {ARGS[name][1]} AS arg, CAST((event_id // 3) % {sequences.SECTIONS} AS INTEGER) + 1 AS section,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
w AS (SELECT key, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS refused, {start} FROM (SELECT DISTINCT key FROM e)
  UNION ALL
  SELECT key, n, seq, refused, {step} FROM (SELECT *, {why} AS refused FROM (SELECT w.key, e.n, e.seq, {", ".join("w." + c for c in columns.split(", "))}, e.action, e.arg, e.section FROM w JOIN e ON e.key = w.key AND e.n = w.n + 1)))
SELECT key, seq, refused, {status} AS status, {detail} AS detail FROM w WHERE n > 0"""


def _history(name: str, machine, sql: str) -> None:
    def run(spark, d):
        return sequences.decided_in_order(_decisions(spark, d, name), machine)

    run.__name__, run.__doc__ = f"{name}_history", f"Every decision on a user's {name}, in order: taken or refused, and the state after it."
    add(run, sql)


_history("issue", sequences.issue, _walked(
    "issue", "'open' AS s, CAST(NULL AS VARCHAR) AS note", "s, note",
    "CASE action WHEN 'ignore' THEN CASE WHEN s <> 'open' THEN 'not open' WHEN arg IS NULL THEN 'no note' END WHEN 'fix' THEN CASE WHEN s <> 'open' THEN 'not open' END ELSE CASE WHEN s = 'open' THEN 'open' END END",
    "CASE WHEN refused IS NOT NULL THEN s WHEN action = 'ignore' THEN 'ignored' WHEN action = 'fix' THEN 'fixed' ELSE 'open' END, CASE WHEN refused IS NOT NULL THEN note WHEN action = 'ignore' THEN arg END", "s", "note"))
_history("revision", sequences.revision, _walked(
    "revision", "'none' AS s, 0 AS r, 0 AS o, 0 AS c, 0 AS p", "s, r, o, c, p",
    "CASE action WHEN 'resolve' THEN CASE WHEN s <> 'draft' OR o = 0 THEN 'no conflict' END WHEN 'confirm' THEN CASE WHEN s <> 'draft' THEN 'no draft' WHEN o > 0 THEN 'open conflicts' END END",
    "CASE WHEN action = 'read' THEN 'draft' WHEN action = 'confirm' AND refused IS NULL THEN 'confirmed' ELSE s END, CASE WHEN action = 'read' AND s <> 'draft' THEN r + 1 ELSE r END, "
    "CASE WHEN action = 'read' THEN CASE WHEN s = 'draft' THEN o ELSE 0 END + CASE WHEN arg = 'conflict' THEN 1 ELSE 0 END WHEN action = 'resolve' AND refused IS NULL THEN o - 1 ELSE o END, "
    "CASE WHEN action = 'confirm' AND refused IS NULL THEN r ELSE c END, CASE WHEN action = 'confirm' AND refused IS NULL THEN c ELSE p END", "s", "r || '/' || c || '/' || p || '/' || o"))  # fmt: skip
_history("document", sequences.document, _walked(
    "document", "'draft' AS s, 1 AS r, CAST([NULL, NULL, NULL] AS VARCHAR[]) AS b, [false, false, false] AS d", "s, r, b, d",
    "CASE action WHEN 'approve_section' THEN CASE WHEN b[section] = arg THEN 'own edit' WHEN d[section] THEN 'approved' END WHEN 'approve' THEN CASE WHEN s = 'approved' THEN 'approved' WHEN list_contains(d, false) THEN 'sections open' END END",
    "CASE WHEN action = 'edit' THEN 'draft' WHEN action = 'approve' AND refused IS NULL THEN 'approved' ELSE s END, CASE WHEN action = 'edit' AND s = 'approved' THEN r + 1 ELSE r END, "
    "CASE WHEN action = 'edit' THEN list_transform([1, 2, 3], lambda i: CASE WHEN i = section THEN arg ELSE b[i] END) ELSE b END, "
    "CASE WHEN action = 'edit' OR (action = 'approve_section' AND refused IS NULL) THEN list_transform([1, 2, 3], lambda i: CASE WHEN i = section THEN action <> 'edit' ELSE d[i] END) ELSE d END", "s", "r || '/' || len(list_filter(d, lambda x: x))"))  # fmt: skip
_history("block", sequences.block, _walked(
    "block", "'proposed' AS s, 0 AS o, 0 AS a, 0 AS r", "s, o, a, r",
    "CASE action WHEN 'review' THEN CASE WHEN o = 0 THEN 'nothing open' END WHEN 'require' THEN NULL ELSE CASE WHEN s = action THEN action END END",
    "CASE WHEN refused IS NULL AND action IN ('approved', 'rejected') THEN action ELSE s END, CASE WHEN refused IS NOT NULL THEN o WHEN action = 'require' THEN CASE WHEN s = 'proposed' THEN o + 1 ELSE o END WHEN action = 'review' THEN o - 1 ELSE 0 END, "
    "a + CASE WHEN refused IS NOT NULL THEN 0 WHEN action = 'approved' THEN o WHEN (action = 'require' AND s = 'approved') OR (action = 'review' AND arg = 'approved') THEN 1 ELSE 0 END, "
    "r + CASE WHEN refused IS NOT NULL THEN 0 WHEN action = 'rejected' THEN o WHEN (action = 'require' AND s = 'rejected') OR (action = 'review' AND arg = 'rejected') THEN 1 ELSE 0 END", "s", "o || '/' || a || '/' || r"))  # fmt: skip
