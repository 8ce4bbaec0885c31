"""Log lines derived from the given tables, as SQL expressions that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTENT = """CASE event_type
  WHEN 'click'    THEN concat('Click by user ', user_id, ' on widget:', event_id % 7, ' ok')
  WHEN 'purchase' THEN concat('Order /shop/', event_id, '/item total=', cast(round(value*100) AS bigint), ' cents')
  WHEN 'error'    THEN concat('Error code ', event_id % 5, ': retry in ', user_id, ' s')
  WHEN 'signup'   THEN 'New account created'
  ELSE concat('View page ', event_id % 11, ' by user ', user_id, ' now') END"""
TEMPLATE = """CASE event_type
  WHEN 'click'    THEN 'Click by user <*> on widget:<*> ok'
  WHEN 'purchase' THEN 'Order <*> total=<*> cents'
  WHEN 'error'    THEN 'Error code <*>: retry in <*> s'
  WHEN 'signup'   THEN 'New account created'
  ELSE 'View page <*> by user <*> now' END"""
PREDICTED = """CASE WHEN event_id % 20 = 0 THEN NULL
  WHEN event_type = 'view' AND user_id % 2 = 0 THEN 'View page <*> by user <*> now'
  WHEN event_type = 'view' THEN 'View page <*> by <*> <*> now'
  WHEN event_type = 'purchase' THEN 'Order <*>  total=<*> cents'
  WHEN event_type = 'click' THEN 'Click by user <*> on widget:<*> ok'
  WHEN event_type = 'error' THEN 'Error code <*>: retry in <*> s' ELSE 'New account created' END"""
#: The leaf that a line of the event log is taken to be in, by number: view lines are dealt to the first three.
OWN = "CASE substring(Content, 1, 4) WHEN 'View' THEN 1 + row_nr % 3 WHEN 'Clic' THEN 4 ELSE 5 END"
#: Lines of one leaf, with ids that begin with ``a`` or, in a tenth of the lines, ``b``.
JOB = "concat('Job', CASE WHEN event_id % 10 = 0 THEN ' b-' ELSE ' a-' END, event_id, ' ends at step ', user_id)"
#: Lines of one leaf in two chunks, by whether the id is odd: two kinds of event in each, whose ids begin with ``a`` or, in the second chunk, ``z``.
JOB_CHUNKS = "concat(CASE WHEN event_id % 4 < 2 THEN 'Job' ELSE 'Run' END, CASE WHEN event_id % 2 = 0 THEN ' a-' ELSE ' z-' END, event_id, ' ends at step ', user_id)"
#: A second dataset without null predictions.
PREDICTED_FULL = "coalesce(" + PREDICTED + ", 'lost')"
CUSTOMER = "CASE WHEN c_custkey < 120 THEN concat('cust ', c_custkey, ' ', n_name, ' ', replace(r_name,' ','_')) ELSE concat('acct ', c_custkey, ' ', n_nationkey, ' ', n_name) END"


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").cast("long").alias("row_nr"), F.col("event_id").cast("long").alias("LineId"), F.expr(CONTENT).alias("Content"), F.expr(TEMPLATE).alias("EventTemplate")
    )


def jobs(spark: SparkSession, sf_dir: str, chunks: bool) -> DataFrame:
    """Lines by JOB, or by JOB_CHUNKS with their chunk."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    own = [(F.col("event_id") % 2).cast("long").alias("chunk_id")] if chunks else []
    return e.select(F.col("event_id").cast("long").alias("row_nr"), F.col("event_id").cast("long").alias("LineId"), F.expr(JOB_CHUNKS if chunks else JOB).alias("Content"), *own)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = logs(spark, sf_dir).drop("row_nr")
    return one.withColumn("dataset", F.lit("nulls")).unionByName(one.withColumn("dataset", F.lit("full")))


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = [e.select(F.lit(d).alias("dataset"), F.col("event_id").cast("long").alias("LineId"), F.expr(x).alias("EventTemplate")) for d, x in (("nulls", PREDICTED), ("full", PREDICTED_FULL))]
    return out[0].unionByName(out[1])


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-token lines with one constant token: they reach the third partition step."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.select(F.col("c_custkey").cast("long").alias("row_nr"), F.expr(CUSTOMER).alias("Content"), F.when(F.col("c_custkey") < 120, 0).otherwise(1).cast("long").alias("chunk_id"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document: long, messy text in several languages."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "Content"))


# ---- the same for DuckDB
SQL_LOGS = f"logs AS (SELECT cast(event_id AS bigint) AS row_nr, cast(event_id AS bigint) AS LineId, {CONTENT} AS Content, {TEMPLATE} AS EventTemplate FROM events)"
SQL_CUST = f"""cust AS (SELECT cast(c_custkey AS bigint) AS row_nr, {CUSTOMER} AS Content, cast(CASE WHEN c_custkey < 120 THEN 0 ELSE 1 END AS bigint) AS chunk_id
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
SQL_TOK = r"tok AS (SELECT *, regexp_extract_all(Content, '[^\s=:,]+') AS words, len(regexp_extract_all(Content, '[^\s=:,]+')) AS token_len FROM cust)"
SQL_PARTS = """cards AS (SELECT chunk_id, token_len, pos, count(DISTINCT token) AS nu FROM
    (SELECT chunk_id, token_len, unnest(words) AS token, generate_subscripts(words, 1) - 1 AS pos FROM tok) GROUP BY ALL),
  split AS (SELECT chunk_id, token_len, min(nu) AS min_nu, arg_min(pos, nu * 1000 + pos) AS s2_pos FROM cards GROUP BY ALL),
  parts AS (SELECT t.*, s2_pos, CASE WHEN min_nu > 1 THEN words[s2_pos + 1] END AS s2_value FROM tok t JOIN split USING (chunk_id, token_len)),
  cards2 AS (SELECT chunk_id, token_len, s2_pos, s2_value, pos, count(DISTINCT token) AS nu FROM
    (SELECT chunk_id, token_len, s2_pos, s2_value, unnest(words) AS token, generate_subscripts(words, 1) - 1 AS pos FROM parts) GROUP BY ALL),
  good AS (SELECT chunk_id, token_len, s2_pos, s2_value, avg(CASE WHEN nu = 1 THEN 1 ELSE 0 END) AS goodness FROM cards2 GROUP BY ALL),
  hist AS (SELECT chunk_id, token_len, s2_pos, s2_value, nu, count(*) AS m, min(pos) AS p1, list_sort(list(pos))[2] AS p2 FROM cards2 WHERE nu <> 1 GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, token_len, s2_pos, s2_value ORDER BY m DESC, p1) AS r,
    row_number() OVER (PARTITION BY chunk_id, token_len, s2_pos, s2_value ORDER BY nu) AS q FROM hist),
  choice AS (SELECT chunk_id, token_len, s2_pos, s2_value,
    max(CASE WHEN r = 1 THEN m END) AS m1, max(CASE WHEN r = 2 THEN m END) AS m2,
    max(CASE WHEN r = 1 THEN p1 END) AS t1, max(CASE WHEN r = 1 THEN p2 END) AS t2,
    max(CASE WHEN q = 1 THEN p1 END) AS a1, max(CASE WHEN q = 1 THEN p2 END) AS a2, max(CASE WHEN q = 2 THEN p1 END) AS b1 FROM ranked GROUP BY ALL),
  pp AS (SELECT g.*, CASE WHEN g.token_len = 2 THEN 0 WHEN g.token_len < 2 THEN NULL WHEN m1 = m2 THEN a1 WHEN t2 IS NOT NULL THEN t1 END AS p1,
    CASE WHEN g.token_len = 2 THEN 1 WHEN g.token_len < 2 THEN NULL WHEN m1 = m2 THEN coalesce(a2, b1) ELSE t2 END AS p2
    FROM good g LEFT JOIN choice c ON g.chunk_id = c.chunk_id AND g.token_len = c.token_len AND g.s2_pos IS NOT DISTINCT FROM c.s2_pos AND g.s2_value IS NOT DISTINCT FROM c.s2_value),
  vp AS (SELECT t.row_nr, t.chunk_id, t.token_len, t.s2_pos, t.s2_value, words[p1 + 1] AS v1, words[p2 + 1] AS v2 FROM parts t JOIN pp ON t.chunk_id = pp.chunk_id AND t.token_len = pp.token_len
    AND t.s2_pos IS NOT DISTINCT FROM pp.s2_pos AND t.s2_value IS NOT DISTINCT FROM pp.s2_value WHERE goodness <= 0.3 AND p1 IS NOT NULL),
  pt AS (SELECT chunk_id, token_len, s2_pos, s2_value, v1, v2, count(*) AS n, min(row_nr) AS "first" FROM vp GROUP BY ALL),
  rel0 AS (SELECT *, count(*) OVER (PARTITION BY chunk_id, token_len, s2_pos, s2_value, v1) AS c1, count(*) OVER (PARTITION BY chunk_id, token_len, s2_pos, s2_value, v2) AS c2 FROM pt),
  rel AS (SELECT *, CASE WHEN c1 > 1 AND c2 > 1 THEN NULL WHEN c1 > 1 THEN CASE WHEN 1.0 / n < 0.25 THEN 'v2' ELSE 'v1' END
    WHEN c2 > 1 THEN CASE WHEN 1.0 / n < 0.25 THEN 'v1' ELSE 'v2' END ELSE 'v1' END AS s3_side FROM rel0)"""


def sql_leaf(name: str, rel: str) -> str:
    """The leaf of every line by the sides in ``rel``."""
    return f"""{name} AS (SELECT parts.row_nr, parts.chunk_id, parts.token_len, parts.s2_pos, parts.s2_value, s3_side, CASE s3_side WHEN 'v1' THEN {rel}.v1 WHEN 'v2' THEN {rel}.v2 END AS s3_value
    FROM parts LEFT JOIN vp USING (row_nr) LEFT JOIN {rel} ON vp.chunk_id = {rel}.chunk_id AND vp.token_len = {rel}.token_len
    AND vp.s2_pos IS NOT DISTINCT FROM {rel}.s2_pos AND vp.s2_value IS NOT DISTINCT FROM {rel}.s2_value AND vp.v1 = {rel}.v1 AND vp.v2 = {rel}.v2)"""


#: Pairs visited one after another: g1 and g2 hold the tokens of the pairs removed so far.  Needs WITH RECURSIVE.
SQL_SEQUENCE = """nth AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, token_len, s2_pos, s2_value ORDER BY "first") AS k,
    count(*) OVER (PARTITION BY chunk_id, token_len, s2_pos, s2_value, v1) AS d1, count(*) OVER (PARTITION BY chunk_id, token_len, s2_pos, s2_value, v2) AS d2 FROM pt),
  walk AS (SELECT DISTINCT chunk_id, token_len, s2_pos, s2_value, cast(0 AS bigint) AS k, cast([] AS varchar[]) AS g1, cast([] AS varchar[]) AS g2,
      cast(NULL AS varchar) AS v1, cast(NULL AS varchar) AS v2, cast(NULL AS varchar) AS s3_side FROM pt
    UNION ALL
    SELECT chunk_id, token_len, s2_pos, s2_value, k, CASE WHEN c1 = 1 OR c2 = 1 THEN list_append(g1, v1) ELSE g1 END, CASE WHEN c1 = 1 OR c2 = 1 THEN list_append(g2, v2) ELSE g2 END, v1, v2,
      CASE WHEN c1 > 1 AND c2 > 1 THEN NULL WHEN c1 = c2 THEN 'v1' WHEN c1 > 1 THEN CASE WHEN 1.0 / n < 0.25 THEN 'v2' ELSE 'v1' END ELSE CASE WHEN 1.0 / n < 0.25 THEN 'v1' ELSE 'v2' END END
    FROM (SELECT nth.*, g1, g2, d1 - len(list_filter(g1, lambda x: x = nth.v1)) AS c1, d2 - len(list_filter(g2, lambda x: x = nth.v2)) AS c2 FROM walk w JOIN nth
      ON nth.chunk_id = w.chunk_id AND nth.token_len = w.token_len AND nth.s2_pos IS NOT DISTINCT FROM w.s2_pos AND nth.s2_value IS NOT DISTINCT FROM w.s2_value AND nth.k = w.k + 1))"""
#: Leaves of pruned partitions: with shares below 0.004 of the chunk or 0.06 of the parent.
SQL_PRUNED = """t0 AS (SELECT chunk_id, count(*) AS total FROM cust GROUP BY ALL),
  t1 AS (SELECT chunk_id, token_len, count(*) AS n1 FROM tok GROUP BY ALL),
  w AS (SELECT parts.*, total, n1, n1 / total < 0.004 AS out1 FROM parts JOIN t0 USING (chunk_id) JOIN t1 USING (chunk_id, token_len)),
  w2 AS (SELECT * REPLACE (CASE WHEN out1 THEN NULL ELSE s2_value END AS s2_value), count(*) OVER (PARTITION BY chunk_id, token_len, CASE WHEN out1 THEN NULL ELSE s2_value END) AS n2 FROM w),
  w3 AS (SELECT *, NOT out1 AND s2_value IS NOT NULL AND (n2 / total < 0.004 OR n2 / n1 < 0.06) AS out2 FROM w2),
  w4 AS (SELECT w3.row_nr, w3.chunk_id, w3.token_len, w3.s2_value, total, n2, out1, out2, CASE WHEN NOT out1 AND NOT out2 THEN leaf.s3_side END AS s3_side, CASE WHEN NOT out1 AND NOT out2 THEN leaf.s3_value END AS s3_value FROM w3 JOIN leaf USING (row_nr)),
  pruned AS (SELECT chunk_id, token_len, s2_value, s3_side, s3_value, count(*) AS n, min(row_nr) AS f,
    CASE WHEN any_value(out1) THEN 'S1' WHEN any_value(out2) THEN 'S2' WHEN s3_side IS NOT NULL AND (count(*) / any_value(total) < 0.004 OR count(*) / any_value(n2) < 0.06) THEN 'S3' END AS outlier
    FROM w4 GROUP BY chunk_id, token_len, s2_value, s3_side, s3_value)"""
#: The same with their events: outliers are numbered last, by step.
SQL_EVENTS = """o1 AS (SELECT *, min(f) OVER (PARTITION BY chunk_id, token_len) AS a, min(f) OVER (PARTITION BY chunk_id, token_len, s2_value) AS b FROM pruned),
  events_ AS (SELECT *, concat(CASE WHEN outlier IS NULL THEN 'e' ELSE 'outlier_e' END, row_number() OVER (PARTITION BY chunk_id, outlier IS NULL
    ORDER BY outlier, a, b, CASE WHEN s3_side IS NULL THEN 0 WHEN s3_side = 'v1' THEN 1 ELSE 2 END, f)) AS event FROM o1)"""
#: Slots of the event log's templates and of two looser ones, from 50 lines each; after ``logs``.
SQL_SLOTS = r"""u AS (SELECT EventTemplate AS t, Content, row_number() OVER (PARTITION BY EventTemplate ORDER BY row_nr) AS r FROM logs),
  w AS (SELECT t AS template, Content FROM u WHERE r <= 50 UNION ALL
    SELECT regexp_replace(t, '^(View|Click).*', '\1 <*> user <*>'), Content FROM u WHERE r <= 50 AND (t LIKE 'View%' OR t LIKE 'Click%')),
  p AS (SELECT template, Content, len(string_split(template, '<*>')) - 1 AS n, concat('^', array_to_string(list_transform(string_split(template, '<*>'), lambda p: regexp_escape(p)), '(.+?)'), '$') AS pat FROM w),
  g AS (SELECT template, n, CASE WHEN n > 0 THEN [regexp_extract(Content, pat, 1), regexp_extract(Content, pat, 2)] ELSE [''] END AS g FROM p),
  c AS (SELECT template, n, generate_subscripts(g, 1) AS i, unnest(g) AS v FROM g),
  s AS (SELECT template, n, i, i = n AND template LIKE '%<*>' AS tail, bool_or(regexp_matches(trim(v), '\s')) AS blanks, bool_and(regexp_full_match(trim(v), '[0-9]+')) AS digits,
    bool_and(regexp_full_match(trim(v), '[0-9a-fA-F]+')) AS hex FROM c GROUP BY ALL),
  slots AS (SELECT template, CASE WHEN any_value(n) > 0 THEN concat('[''', string_agg(CASE WHEN (i = 2 AND tail) OR blanks THEN CASE WHEN tail THEN '.+' ELSE '.+?' END
    WHEN digits THEN '\d+' WHEN hex THEN '[0-9a-fA-F]+' ELSE '\S+' END, ''', ''' ORDER BY i), ''']') END AS slot_regexes FROM s GROUP BY template)"""
SQL_ORDER = """u0 AS (SELECT chunk_id, token_len, s2_pos, s2_value, s3_side, s3_value, count(*) AS n, min(row_nr) AS f FROM leaf GROUP BY ALL),
  u1 AS (SELECT *, min(f) OVER (PARTITION BY chunk_id, token_len) AS a, min(f) OVER (PARTITION BY chunk_id, token_len, s2_pos, s2_value) AS b FROM u0),
  ordered AS (SELECT *, row_number() OVER (ORDER BY chunk_id, a, b, CASE WHEN s3_side IS NULL THEN 0 WHEN s3_side = 'v1' THEN 1 ELSE 2 END, f) - 1 AS leaf_ord,
    concat('S1 ', CASE WHEN s2_value IS NOT NULL THEN 'S2 ' ELSE '' END, CASE WHEN s3_side IS NOT NULL THEN 'S3 ' ELSE '' END) AS trace FROM u1)"""
SQL_CUST_PARTS = f"{SQL_CUST}, {SQL_TOK}, {SQL_PARTS}, {sql_leaf('leaf', 'rel')}"
SQL_PAIRS = f"""gp AS (SELECT d AS dataset, {TEMPLATE} AS gt, CASE d WHEN 'nulls' THEN {PREDICTED} ELSE {PREDICTED_FULL} END AS pred FROM events, (VALUES ('nulls'), ('full')) v(d)),
  pairs AS (SELECT dataset, gt, pred, count(*) AS n, coalesce(trim(regexp_replace(gt, '\\s+', ' ', 'g')) = trim(regexp_replace(pred, '\\s+', ' ', 'g')), false) AS ok FROM gp GROUP BY ALL)"""
