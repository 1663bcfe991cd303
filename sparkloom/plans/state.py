"""Queries: memory, state transitions, time series, sampling, text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import lifecycle, memory as mem, sampling, timeseries
from .registry import query, table
from .views import MEMORY_SQL, memory

M = f"WITH {MEMORY_SQL}"
GATED = f"""{M}, g AS (SELECT *, list_filter([CASE WHEN scope = 'project' AND project_id IS NULL THEN 'scope' END, CASE WHEN valid_day <= 10 THEN 'validity' END, CASE WHEN confidence < 0.2 THEN 'trust' END,
  CASE WHEN sensitivity = 'secret' THEN 'sensitivity' END, CASE WHEN relevance < 0.3 THEN 'relevance' END], lambda x: x IS NOT NULL) AS reasons FROM memory)"""


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mem.gate(memory(spark, sf_dir), 10, 0.2, 0.3)


@query("stm1_memory_gate", GATED + " SELECT id, reasons, reasons[1] AS blocked_by FROM g")
def stm1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir).select("id", "reasons", "blocked_by")


@query("stm2_gate_audit", GATED + " SELECT reasons[1] AS blocked_by, count(*) AS n, min(id) AS first_id FROM g WHERE len(reasons) > 0 GROUP BY 1")
def stm2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir).where("blocked_by is not null").groupBy("blocked_by").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("win7_scope_caps", GATED + """ SELECT id, user_id, scope, r FROM (SELECT *, row_number() OVER (PARTITION BY user_id, scope ORDER BY relevance DESC, id) AS r FROM g WHERE len(reasons) = 0)
WHERE r <= CASE scope WHEN 'user' THEN 5 WHEN 'project' THEN 5 WHEN 'document' THEN 4 WHEN 'thread' THEN 4 WHEN 'summary' THEN 3 ELSE 0 END""")
def win7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mem.capped(gated(spark, sf_dir), ["user_id"]).select("id", "user_id", "scope", "r")


@query("stm3_promotion_versions", """
WITH e AS (SELECT conv_id AS key, conv_id * 100 + turn AS id, CASE WHEN turn > 0 AND (conv_id + turn) % 5 = 0 THEN 'delete' ELSE 'create' END AS action, CASE WHEN turn > 0 AND (conv_id + turn) % 7 = 0 THEN ' ' ELSE role END AS content, turn AS day FROM conversations),
a AS (SELECT * FROM e WHERE action = 'delete' OR trim(content) <> ''),
v AS (SELECT *, lead(day) OVER w AS valid_to, lag(action) OVER w AS before, max(CASE WHEN action <> 'delete' THEN id END) OVER (PARTITION BY key ORDER BY day, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open_id FROM a WINDOW w AS (PARTITION BY key ORDER BY day, id))
SELECT id, key, content, day AS valid_from, valid_to, CASE WHEN before = 'delete' THEN NULL ELSE open_id END AS supersedes FROM v WHERE action <> 'delete'""")
def stm3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of a conversation's note: later turns supersede it or delete it."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.when((F.col("turn") > 0) & ((F.col("conv_id") + F.col("turn")) % 5 == 0), "delete").otherwise("create").alias("action"), F.when((F.col("turn") > 0) & ((F.col("conv_id") + F.col("turn")) % 7 == 0), " ").otherwise(F.col("role")).alias("content"), F.col("turn").alias("at"))
    return mem.promoted(rows.where("at = 0").select("key", "id", "content", "at"), rows.where("at > 0"))


@query("stm4_auto_accept", M + " SELECT id, confidence FROM memory WHERE status = 'active' AND confidence >= 0.8 ORDER BY thread_id, turn, id LIMIT 200")
def stm4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending items of confidence 0.8 or more, the oldest 200."""
    return memory(spark, sf_dir).where("status = 'active' and confidence >= 0.8").orderBy("thread_id", "turn", "id").limit(200).select("id", "confidence")


@query("stm5_scope_downgrade", M + " SELECT id, CASE WHEN scope = 'project' AND project_id IS NULL THEN 'user' ELSE scope END AS scope FROM memory")
def stm5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory(spark, sf_dir).select("id", F.when((F.col("scope") == "project") & F.col("project_id").isNull(), "user").otherwise(F.col("scope")).alias("scope"))


@query("stm6_fingerprint_upsert", r"""
WITH f AS (SELECT conv_id * 100 + turn AS id, sha256(concat_ws('|', role, 'user', '', trim(regexp_replace(lower(text), '\s+', ' ', 'g')))) AS fingerprint, turn FROM conversations)
SELECT fingerprint, max(id) AS id, count(*) AS n FROM f GROUP BY 1""")
def stm6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last item of every fingerprint."""
    fp = mem.fingerprint(F.col("role"), F.lit("user"), F.lit(None).cast("string"), F.col("text"))
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), fp.alias("fingerprint")).groupBy("fingerprint").agg(F.max("id").alias("id"), F.count("*").alias("n"))


@query("stm7_retention_purge", """
WITH kept AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-10') SELECT u.user_id, k.n IS NULL AS orphan, coalesce(k.n, 0) AS kept FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id, count(*) AS n FROM kept GROUP BY 1) k USING (user_id)""")
def stm7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events past their retention go; items left without an event are orphans."""
    rows = table(spark, sf_dir, "events")
    kept = rows.where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp")).groupBy("user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id").distinct().join(kept, "user_id", "left").select("user_id", F.col("n").isNull().alias("orphan"), F.coalesce("n", F.lit(0)).alias("kept"))


@query("stm8_erasure", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE user_id = 7) AS erased FROM events GROUP BY 1")
def stm8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("user_id") == 7).alias("erased"))


JOBS = """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'running' WHEN 'O' THEN 'queued' ELSE 'done' END AS status, cast(o_orderkey % 4 AS INTEGER) AS attempt, 3 AS max_attempts,
  CASE WHEN o_orderstatus = 'F' THEN concat('w', o_custkey % 5) END AS token, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 10 MINUTE END AS lease_expires_at, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS next_attempt_at, o_orderdate AS created_at FROM orders"""
NOW = "1998-06-01 00:00:00"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, t = table(spark, sf_dir, "orders"), F.col("o_orderdate").cast("timestamp")
    running = F.col("o_orderstatus") == "F"
    return o.select(
        F.col("o_orderkey").alias("id"), F.when(running, "running").when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("status"), (F.col("o_orderkey") % 4).cast("int").alias("attempt"), F.lit(3).alias("max_attempts"), F.when(running, F.concat(F.lit("w"), F.col("o_custkey") % 5)).alias("token"), F.when(running, t + F.expr("interval 10 minutes")).alias("lease_expires_at"), F.when(F.col("o_orderkey") % 3 == 0, t).alias("next_attempt_at"), t.alias("created_at")
    )


@query("stm9_lease_claim", f"""
WITH j AS ({JOBS}), c AS (SELECT id FROM j WHERE (status = 'queued' AND (next_attempt_at IS NULL OR next_attempt_at <= TIMESTAMP '{NOW}') OR status = 'running' AND lease_expires_at <= TIMESTAMP '{NOW}') AND attempt < max_attempts ORDER BY next_attempt_at ASC NULLS FIRST, created_at, id LIMIT 500)
SELECT j.id, CASE WHEN c.id IS NOT NULL THEN 'running' ELSE status END AS status, attempt + CASE WHEN c.id IS NOT NULL THEN 1 ELSE 0 END AS attempt, CASE WHEN c.id IS NOT NULL THEN 'me' ELSE token END AS token FROM j LEFT JOIN c ON c.id = j.id""")
def stm9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.claimed(jobs(spark, sf_dir), F.lit(NOW).cast("timestamp"), "me", 60, 500).select("id", "status", "attempt", "token")


@query("stm9_lease_results", f"""
WITH j AS ({JOBS}), r AS (SELECT o_orderkey AS id, concat('w', o_custkey % 3) AS r_token, o_orderkey % 2 = 0 AS ok FROM orders), x AS (SELECT j.*, ok, status = 'running' AND token = r_token AS hit FROM j LEFT JOIN r USING (id))
SELECT id, CASE WHEN NOT coalesce(hit, false) THEN status WHEN ok THEN 'done' WHEN attempt < max_attempts THEN 'queued' ELSE 'failed' END AS status,
  CASE WHEN NOT coalesce(hit, false) THEN token END AS token, epoch(CASE WHEN coalesce(hit, false) AND NOT ok AND attempt < max_attempts THEN TIMESTAMP '{NOW}' + to_microseconds(cast(least(30.0 * 2.0 ** (attempt - 1), 600.0) * 1e6 AS BIGINT)) ELSE next_attempt_at END) AS next_epoch FROM x""")
def stm9_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("w"), F.col("o_custkey") % 3).alias("token"), (F.col("o_orderkey") % 2 == 0).alias("ok"))
    out = lifecycle.finished(jobs(spark, sf_dir), results, F.lit(NOW).cast("timestamp"), 30, 600)
    return out.select("id", "status", "token", (F.unix_micros("next_attempt_at") / 1e6).alias("next_epoch"))


@query("stm10_last_approved", """
WITH e AS (SELECT doc_id AS id, lang, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS folder, CASE WHEN doc_id % 3 = 0 THEN 'approved' ELSE 'candidate' END AS status FROM documents)
SELECT id, CASE WHEN status = 'approved' AND row_number() OVER (PARTITION BY lang, folder, status ORDER BY id DESC) > 1 THEN 'revoked' ELSE status END AS status FROM e""")
def stm10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("folder"), F.when(F.col("doc_id") % 3 == 0, "approved").otherwise("candidate").alias("status"))
    return lifecycle.approved(rows, ["lang", "folder"], ["id"]).select("id", "status")


@query("stm11_changed_versions", "SELECT doc_id, old, new FROM (SELECT doc_id, lang AS old, CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE lang END AS new FROM documents) WHERE old IS DISTINCT FROM new")
def stm11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("old"), F.when(F.col("doc_id") % 3 == 0, "en").otherwise(F.col("lang")).alias("new"))
    return rows.where(~F.col("old").eqNullSafe(F.col("new")))


@query("stm13_unsummarised_turns", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE r > conv_id % 4 AND r <= n - 2")
def stm13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns after the summary's cursor and before the two that stay verbatim."""
    w = Window.partitionBy("conv_id")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(w.orderBy("turn")).alias("r"), F.count("*").over(w).alias("n"))
    return rows.where("r > conv_id % 4 and r <= n - 2").select("conv_id", "turn")


@query("snk1_replace_by_document", "SELECT doc_id, source, lang FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 97 = 0) UNION ALL SELECT doc_id, source, 'new' FROM documents WHERE doc_id % 97 = 0")
def snk1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that come anew replace all stored rows of their source."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    fresh = rows.where("doc_id % 97 = 0").withColumn("lang", F.lit("new"))
    return rows.join(fresh.select("source").distinct(), "source", "left_anti").select("doc_id", "source", "lang").unionByName(fresh)


@query("snk2_upsert", "SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, coalesce(b.quality, a.quality) AS quality FROM (SELECT doc_id, quality FROM labels) a FULL JOIN (SELECT doc_id, 9 AS quality FROM documents WHERE doc_id % 5 = 0) b ON a.doc_id = b.doc_id")
def snk2(spark: SparkSession, sf_dir: str) -> DataFrame:
    incoming = table(spark, sf_dir, "documents").where("doc_id % 5 = 0").select("doc_id", F.lit(9).alias("quality"))
    return mem.upserted(table(spark, sf_dir, "labels").select("doc_id", "quality"), incoming, ["doc_id"], ["quality"])


@query("snk3_insert_if_absent", "SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, 0 FROM documents WHERE doc_id % 5 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def snk3(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return stored.unionByName(table(spark, sf_dir, "documents").where("doc_id % 5 = 0").select("doc_id", F.lit(0).alias("quality")).join(stored, "doc_id", "left_anti"))


@query("snk6_formula_guard", "SELECT doc_id, CASE WHEN regexp_matches(c, '^[=+@-]') THEN '''' || c ELSE c END AS cell FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '=' ELSE '' END || lang AS c FROM documents)")
def snk6(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.concat(F.when(F.col("doc_id") % 4 == 0, "=").otherwise(""), "lang")
    return table(spark, sf_dir, "documents").select("doc_id", tx.formula_guard(cell).alias("cell"))


@query("snk9_orphan_objects", "SELECT DISTINCT 'p/' || doc_id AS prefix FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def snk9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object prefixes whose id isn't live."""
    objects = table(spark, sf_dir, "documents").select(F.concat(F.lit("p/"), F.col("doc_id")).alias("prefix"))
    live = table(spark, sf_dir, "labels").select("doc_id")
    return objects.withColumn("doc_id", F.regexp_extract("prefix", r"^p/(\d+)", 1).cast("long")).join(live, "doc_id", "left_anti").select("prefix").distinct()


@query("tsr1_event_rate", "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(count(*) / 21600, 9) AS rate FROM events GROUP BY 1, 2")
def tsr1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timeseries.rate(table(spark, sf_dir, "events"), "ts", "event_type", 21600)
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("tsr1_counter_rate", """
WITH s AS (SELECT user_id, ts, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS step FROM events WHERE event_type = 'click'),
g AS (SELECT user_id, round(coalesce(sum(CASE WHEN step < 0 THEN value ELSE step END), 0), 6) AS increase, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM s GROUP BY 1)
SELECT user_id, increase, round(increase / nullif(seconds, 0), 9) AS rate FROM g""")
def tsr1_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.counter_rate(table(spark, sf_dir, "events").where("event_type = 'click'"), ["user_id"], "ts", "value")


BUCKETS = "b AS (SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS n FROM events, (SELECT unnest([1, 5, 15, 60, 300, 900, 1800, 3600, 'inf'::DOUBLE]) AS le) GROUP BY 1, 2)"


@query("tsr5_cumulative_histogram", f"WITH {BUCKETS} SELECT event_type, CASE WHEN isinf(le) THEN -1 ELSE le END AS le, n FROM b")
def tsr5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = timeseries.histogram(table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.withColumn("le", F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le")))


@query("tsr2_histogram_quantile", f"""WITH {BUCKETS}, w AS (SELECT *, lag(le, 1, 0) OVER v AS low, lag(n, 1, 0) OVER v AS below, max(n) OVER (PARTITION BY event_type) AS total FROM b WINDOW v AS (PARTITION BY event_type ORDER BY le))
SELECT event_type, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (0.95 * total - below) / (n - below) END, 6) AS quantile FROM w WHERE n >= 0.95 * total AND below < 0.95 * total""")
def tsr2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.histogram_quantile(0.95, timeseries.histogram(table(spark, sf_dir, "events"), ["event_type"], "value"), ["event_type"])


@query("tsr3_error_budget", "SELECT user_id, round(count(*) FILTER (WHERE event_type = 'error') / greatest(count(*) FILTER (WHERE event_type IN ('click', 'error'))::DOUBLE, 0.001), 6) AS ratio FROM events GROUP BY 1")
def tsr3(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    ratio = timeseries.clamped_ratio(F.count_if(t == "error"), F.count_if(t.isin("click", "error")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(ratio, 6).alias("ratio"))


@query("tsr4_sustained_alert", """
WITH w AS (SELECT event_type, date_trunc('day', ts) AS t, count(*) AS n FROM events GROUP BY 1, 2), h AS (SELECT event_type, t, epoch(t) - row_number() OVER (PARTITION BY event_type ORDER BY t) * 86400 AS island FROM w WHERE n > 60)
SELECT event_type, min(t) AS since, max(t) AS until, count(*) AS n FROM h GROUP BY event_type, island HAVING count(*) >= 3""")
def tsr4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three days or more with over 60 events a day."""
    days = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("t")).agg(F.count("*").alias("c"))
    out = timeseries.sustained(days, "event_type", "t", F.col("c") > 60, 86400, 3)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("since", "until")})


@query("tsr6_staleness", "SELECT user_id, greatest(epoch(TIMESTAMP '2024-01-31')::BIGINT - floor(epoch(max(ts)))::BIGINT, 0) AS age FROM events GROUP BY 1")
def tsr6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(timeseries.staleness(F.max("ts"), F.lit("2024-01-31").cast("timestamp")).cast("long").alias("age"))


@query("tsr7_queue_depth", "SELECT event_type, count(*) AS depth, min(ts) AS oldest FROM events WHERE value < 5 GROUP BY 1")
def tsr7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("value < 5").groupBy("event_type").agg(F.count("*").alias("depth"), F.min("ts").alias("oldest"))


@query("tsr8_slo_report", "SELECT event_type, count(*) AS n, round(avg(CASE WHEN value <= 200 THEN 1.0 ELSE 0.0 END), 6) AS within, round(avg(CASE WHEN value <= 200 THEN 1.0 ELSE 0.0 END), 6) >= 0.95 AS met FROM events GROUP BY 1")
def tsr8(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.round(F.avg(F.when(F.col("value") <= 200, 1.0).otherwise(0.0)), 6)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), share.alias("within"), (share >= 0.95).alias("met"))


@query("smp1_stable_sample", "SELECT doc_id, sha256('s1:' || doc_id) AS key FROM documents ORDER BY key LIMIT 100")
def smp1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", sampling.stable_rank("s1", F.col("doc_id")).alias("key")).orderBy("key").limit(100)


@query("smp2_round_robin", "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('s2:' || doc_id), doc_id) AS turn, sha256('s2:' || source) AS group_rank FROM documents")
def smp2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.round_robin(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", "s2")


TOKENS = "list_filter(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}]+'), lambda x: length(x) >= 3)), lambda x: NOT list_contains(['the', 'and', 'that'], x))"


@query("smp3_gap_pairs", f"""
WITH t AS (SELECT conv_id, turn, {TOKENS} AS w FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM t)
SELECT a.conv_id, a.turn AS a, b.turn AS b, b.r - a.r AS gap, round(coalesce(len(list_intersect(a.w, b.w)) / nullif(sqrt(len(a.w)::DOUBLE * len(b.w)), 0), 0) + 0.1 / (b.r - a.r), 6) AS score FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.r - a.r BETWEEN 1 AND 3""")
def smp3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", sampling.token_set(F.col("text"), ["the", "and", "that"]).alias("w"))
    return sampling.gap_pairs(rows, "conv_id", "turn", "w")


@query("smp6_stratified_plan", "SELECT lang, doc_id, position FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('s6:' || doc_id), doc_id) AS position FROM documents) WHERE position <= 20")
def smp6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id", 20, "s6")


@query("smp9_language_match", "SELECT doc_id, len(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda x: x <> '')) >= 3 AND NOT regexp_matches(text, '[\\x{0400}-\\x{04FF}\\x{4E00}-\\x{9FFF}]') AS latin FROM documents")
def smp9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.latin_only(F.col("text")).alias("latin"))


@query("smp10_corpus_fingerprint", "SELECT source, sha256(string_agg(doc_id || ':' || md5(text), chr(10) ORDER BY doc_id)) AS fingerprint FROM documents GROUP BY 1")
def smp10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest over the ordered rows of each source: rows are digested first, so a source's list holds short strings."""
    line = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.md5("text"))
    listed = table(spark, sf_dir, "documents").groupBy("source").agg(F.sort_array(F.collect_list(F.struct("doc_id", line.alias("l")))).alias("all"))
    return listed.select("source", F.sha2(F.array_join(F.transform("all", lambda s: s["l"]), "\n"), 256).alias("fingerprint"))


@query("smp13_asset_uniqueness", "SELECT md5(text) AS asset, count(DISTINCT source) AS n_groups FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def smp13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that occur in several sources."""
    return table(spark, sf_dir, "documents").select(F.md5("text").alias("asset"), "source").distinct().groupBy("asset").agg(F.count("*").alias("n_groups")).where("n_groups > 1")


@query("str_functions", r"""
SELECT doc_id, sha256(text) AS sha, regexp_replace(lower(text), '[^0-9a-z]', '', 'g') AS key, len(regexp_extract_all(text, '\[[0-9]{1,3}\]')) AS citations, substr(trim(text), 1, 60) AS title,
  CASE WHEN regexp_matches(text, '[\x{4E00}-\x{9FFF}]') THEN 'zh' WHEN regexp_matches(text, '[\x{0400}-\x{04FF}]') THEN 'ru' ELSE 'en' END AS claim_lang, regexp_matches(lower(text), '^(table|figure|fig\.) [0-9]') AS caption FROM documents""")
def str_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(t, 256).alias("sha"), tx.norm_key(t).alias("key"), tx.citation_count(t, 3).cast("long").alias("citations"), tx.session_title(t, 60).alias("title"), tx.claim_language(t).alias("claim_lang"), tx.is_caption(t).alias("caption")
    )


@query("num2_normalized_numbers", r"""
WITH n AS (SELECT o_orderkey, concat(CASE WHEN o_orderkey % 3 = 0 THEN '+' WHEN o_orderkey % 3 = 1 THEN '-' ELSE '' END, '00', o_custkey, '.', o_orderkey % 100 * 10) AS raw FROM orders)
SELECT o_orderkey, CASE WHEN d = '-0' THEN '0' ELSE d END AS number FROM (SELECT o_orderkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '^\+', ''), '^(-?)0+([0-9])', '\1\2'), '(\.[0-9]*?)0+$', '\1'), '\.$', '') AS d FROM n)""")
def num2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in canonical form: no plus, no needless zeros, no minus zero."""
    k = F.col("o_orderkey")
    raw = F.concat(F.when(k % 3 == 0, "+").when(k % 3 == 1, "-").otherwise(""), F.lit("00"), F.col("o_custkey"), F.lit("."), k % 100 * 10)
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.normalized_number(raw).alias("number"))


@query("dat3_backoff", "SELECT event_id, least(2.0 * 2.0 ** (event_id % 12 - 1), 300.0)::DOUBLE AS seconds FROM events")
def dat3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", lifecycle.backoff(2, F.col("event_id") % 12, 300).alias("seconds"))


@query("chk12_evidence_anchors", """
WITH w AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '') AS w FROM benchmark),
s AS (SELECT item_id, w, unnest(list_distinct(list_append(range(1, greatest(len(w) - 7, 1), 4), greatest(len(w) - 7, 1)))) AS i FROM w WHERE len(w) > 0)
SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 7), ' ') AS anchor FROM s""")
def chk12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of eight words every four words, the last one included, of every benchmark item."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.explode(tx.anchors(F.col("text"), 8, 4)).alias("anchor"))
    return rows.distinct()


@query("chk5_table_islands", """
WITH t AS (SELECT doc_id, source, lang, doc_id % 10 >= 6 AS is_table FROM documents), f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM t),
g AS (SELECT *, CASE WHEN lag(lang) OVER w = lang AND lag(is_table) OVER w THEN 0 ELSE 1 END AS new FROM f WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY doc_id) AS island FROM g)
SELECT source, min(doc_id) AS first_id, max(doc_id) AS last_id, count(*) AS n, max(lang) AS lang FROM s WHERE is_table GROUP BY source, island""")
def chk5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent table rows of the same group, merged."""
    w = Window.partitionBy("source").orderBy("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", (F.col("doc_id") % 10 >= 6).alias("is_table"))
    same = (F.lag("lang").over(w) == F.col("lang")) & F.lag("is_table").over(w)
    island = rows.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("island", F.sum("new").over(w)).where("is_table")
    return island.groupBy("source", "island").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n"), F.max("lang").alias("lang")).drop("island")
