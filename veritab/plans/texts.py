"""Queries over whole texts: versions against each other, known values, order of keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from veritab.functions import privacy, text
from veritab.operators import blocks, known, pseudonyms
from veritab.plans.registry import query
from veritab.sources.stage import dropped, saved, shared_dir
from veritab.sources.tables import table


@query()
def aligned_turns(spark, d):
    """Words of two neighbouring turns of a conversation: equal, split, different, lone. No SQL: the rounds of gaps are
    tested against a recursion that compares all pairs."""
    c = table(spark, d, "conversations").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id")
    c = c.withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))).filter("next is not null")
    words = lambda t: F.coalesce(F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " "), F.array().cast("array<string>"))
    c = c.select(F.concat_ws(":", "conv_id", "turn", "role").alias("pair"), words("text").alias("xt"), words("next").alias("yt"))
    return blocks.aligned(c.withColumns({"xf": text.fold_each(F.col("xt")), "yf": text.fold_each(F.col("yt"))}))


def _openings(spark, d):
    """Known values: how documents and turns begin (two words)."""
    opening = F.regexp_extract("text", r"^([^\s]+ [^\s]+)", 1)
    docs = table(spark, d, "documents").select(F.lit("document").alias("kind"), opening.alias("value"))
    return docs.unionByName(table(spark, d, "conversations").select(F.lit("turn").alias("kind"), opening.alias("value")))


@query(r"""WITH RECURSIVE ch AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, unnest(range(length(text))) AS i FROM documents WHERE text <> ''),
plain AS (SELECT doc_id, i, CASE WHEN regexp_matches(ch, '[\s_]') THEN ' ' ELSE replace(lower(strip_accents(ch)), 'ß', 'ss') END AS f FROM ch),
once AS (SELECT doc_id, i, CASE WHEN f = ' ' AND lag(f) OVER (PARTITION BY doc_id ORDER BY i) = ' ' THEN '' ELSE f END AS f FROM plain),
low AS (SELECT doc_id, string_agg(f, '' ORDER BY i) AS low FROM once GROUP BY doc_id),
places AS (SELECT doc_id, i, c, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS j, lag(c) OVER (PARTITION BY doc_id ORDER BY i, k) AS before
    FROM (SELECT doc_id, i, unnest(string_split(f, '')) AS c, unnest(range(length(f))) AS k FROM once WHERE f <> '')),
said AS (SELECT 'document' AS kind, regexp_extract(text, '^([^\s]+ [^\s]+)', 1) AS v FROM documents UNION ALL SELECT 'turn', regexp_extract(text, '^([^\s]+ [^\s]+)', 1) FROM conversations),
known AS (SELECT value, min(kind) AS kind FROM (SELECT kind, trim(regexp_replace(replace(lower(strip_accents(v)), 'ß', 'ss'), '[\s_]+', ' ', 'g')) AS value FROM said WHERE v IS NOT NULL) WHERE length(value) >= 4 GROUP BY value),
hits AS (SELECT s.doc_id, s.i AS start, s.j, l.n, k.kind FROM places s JOIN low t USING (doc_id), (SELECT DISTINCT length(value) AS n FROM known) l, known k
    WHERE NOT regexp_matches(coalesce(s.before, ' '), '[0-9a-z]') AND length(k.value) = l.n AND k.value = substring(t.low, s.j, l.n) AND NOT regexp_matches(substring(t.low, s.j + l.n, 1), '^[0-9a-z]')),
longest AS (SELECT h.doc_id, h.start, e.i + 1 AS stop, h.kind FROM (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, j ORDER BY n DESC) = 1) h JOIN places e ON e.doc_id = h.doc_id AND e.j = h.j + h.n - 1),
next AS (SELECT a.doc_id, a.start, a.stop, a.kind, min(b.start) AS after FROM longest a LEFT JOIN longest b ON a.doc_id = b.doc_id AND a.stop <= b.start GROUP BY ALL),
chosen AS (SELECT doc_id, min(start) AS start FROM longest GROUP BY doc_id UNION ALL SELECT c.doc_id, n.after FROM chosen c JOIN next n ON n.doc_id = c.doc_id AND n.start = c.start WHERE n.after IS NOT NULL)
SELECT n.doc_id, n.start::INTEGER AS start, n.stop::INTEGER AS stop, n.kind, substring(d.text, n.start + 1, n.stop - n.start) AS said
FROM chosen c JOIN next n ON n.doc_id = c.doc_id AND n.start = c.start JOIN documents d ON d.doc_id = n.doc_id""")
def known_value_places(spark, d):
    """Every place of every opening in every document, whatever accents, case and blanks."""
    out = known.personal_spans(table(spark, d, "documents"), "doc_id", "text", _openings(spark, d), {})
    return out.select("doc_id", "start", "stop", "kind", "said")


@query()
def personal_places(spark, d):
    """Openings, then the driver's kinds of personal data where no opening stands. No SQL: tested against a search for
    all values at all places."""
    return known.personal_spans(table(spark, d, "documents"), "doc_id", "text", _openings(spark, d), privacy.PATTERNS)


def _two_runs(spark, d):
    """A map after a run over the English documents and a run over all; the second one's texts; what is left in them."""
    none = spark.createDataFrame([], "kind string, value string")
    people = pseudonyms.PseudonymMap(spark, f"{shared_dir(spark)}/pseudonyms-{uuid.uuid4().hex}")
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    shown = lambda kind, number: F.concat(F.lit("["), kind, F.lit(" "), number.cast("string"), F.lit("]"))
    for part in (docs.filter("lang = 'en'"), docs):
        found = saved(known.personal_spans(part, "doc_id", "text", none, privacy.PATTERNS).select("doc_id", "start", "stop", "kind", F.lower("said").alias("key")), "found")
        name, numbers = people.extended(found)
        texts = saved(pseudonyms.replaced(part, "doc_id", "text", found, numbers, shown), "replaced")
        left = people.swap(name, known.personal_spans(texts, "doc_id", "text", none, privacy.PATTERNS))
        dropped(found)
    return people, texts, left


@query("WITH f AS (" + " UNION ALL ".join(f"SELECT lang, '{k}' AS kind, lower(unnest(regexp_extract_all(text, '{p}'))) AS key FROM documents" for k, p in privacy.PATTERNS.items()) + """),
k AS (SELECT kind, key, CASE WHEN bool_or(coalesce(lang, '') = 'en') THEN 1 ELSE 2 END AS run FROM f GROUP BY kind, key)
SELECT kind, key, row_number() OVER (PARTITION BY kind ORDER BY run, key) AS number, run FROM k""")
def lasting_pseudonyms(spark, d):
    """Numbers of personal data after two runs over a growing table: the first run's numbers stay."""
    return _two_runs(spark, d)[0].current()


@query()
def pseudonymised_documents(spark, d):
    """Texts of all documents with numbers in place of personal data; tested against a replacement one by one."""
    return _two_runs(spark, d)[1]
