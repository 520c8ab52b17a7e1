"""Registered queries: one per operator of the inventory, each over whole driver tables,
with the DuckDB SQL that states the same result independently (the oracle).

``QUERIES[key] = (fn(spark, sf_dir) -> DataFrame, oracle_sql or None)``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexframe.operators import usage
from lexframe.plans import bindings as B

QUERIES: dict = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = (fn, sql)
        return fn
    return deco


def _as_of(spark, d):
    return B.orders_as_of(spark, d).first()["as_of"]


# SQL fragments of the bindings (same mapping as bindings.py).
DOCS_SQL = "(SELECT p_partkey AS document_id, p_name || '-' || CAST(p_partkey AS VARCHAR) AS filename FROM part)"
LINKS_SQL = "(SELECT DISTINCT l_orderkey AS interaction_id, l_partkey AS document_id FROM lineitem)"
INTER_SQL = ("(SELECT o_orderkey AS interaction_id, o_custkey AS thread_id, o_totalprice AS response_time, "
             "o_orderdate AS timestamp FROM orders)")
FEEDBACK_SQL = "(SELECT doc_id AS feedback_id, doc_id AS interaction_id, quality = 1 AS is_positive FROM labels)"


# ---------------------------------------------------------------- usage analytics
@register("document_usage", f"""
SELECT d.filename, count(i.interaction_id) AS query_count
FROM {DOCS_SQL} d JOIN {LINKS_SQL} x ON x.document_id = d.document_id
JOIN {INTER_SQL} i ON i.interaction_id = x.interaction_id
GROUP BY d.filename""")
def q_document_usage(spark, d):
    return usage.document_usage(B.documents(spark, d), B.links(spark, d), B.interactions(spark, d))


@register("weekly_document_usage", f"""
SELECT d.filename, count(i.interaction_id) AS weekly_query_count
FROM {DOCS_SQL} d JOIN {LINKS_SQL} x ON x.document_id = d.document_id
JOIN {INTER_SQL} i ON i.interaction_id = x.interaction_id
WHERE i.timestamp >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 7 DAY
GROUP BY d.filename""")
def q_weekly_document_usage(spark, d):
    return usage.document_usage(B.documents(spark, d), B.links(spark, d), B.interactions(spark, d),
                                as_of=_as_of(spark, d), days=7, count_name="weekly_query_count")


@register("link_join", f"""
SELECT x.document_id, d.filename, i.interaction_id, i.thread_id, i.response_time, i.timestamp
FROM {DOCS_SQL} d JOIN {LINKS_SQL} x ON x.document_id = d.document_id
JOIN {INTER_SQL} i ON i.interaction_id = x.interaction_id""")
def q_link_join(spark, d):
    return usage.link_join(B.documents(spark, d), B.links(spark, d), B.interactions(spark, d)).select(
        "document_id", "filename", "interaction_id", "thread_id", "response_time", "timestamp")


@register("response_summary", f"""
SELECT CASE WHEN coalesce(avg(response_time), 0) = 0 THEN 0.0 ELSE round_even(avg(response_time), 3) END
         AS average_response_time_seconds,
       count(interaction_id) AS total_interactions
FROM {INTER_SQL}""")
def q_response_summary(spark, d):
    return usage.response_summary(B.interactions(spark, d))


@register("feedback_summary", f"""
SELECT count(feedback_id) AS total_feedback_count,
       count(feedback_id) FILTER (WHERE is_positive) AS positive_feedback_count,
       count(feedback_id) - count(feedback_id) FILTER (WHERE is_positive) AS negative_feedback_count,
       CASE WHEN count(feedback_id) > 0
            THEN round_even(count(feedback_id) FILTER (WHERE is_positive) / count(feedback_id) * 100.0, 2)
            ELSE 0.0 END AS positive_feedback_percentage
FROM {FEEDBACK_SQL}""")
def q_feedback_summary(spark, d):
    return usage.feedback_summary(B.feedback(spark, d))


@register("trailing_window", f"""
SELECT * FROM {INTER_SQL} WHERE timestamp >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 7 DAY""")
def q_trailing_window(spark, d):
    from lexframe.operators.predicates import trailing_window
    return trailing_window(B.interactions(spark, d), "timestamp", _as_of(spark, d), 7)


@register("owner_filter", """
SELECT event_id AS id, user_id, event_type AS title, ts AS created_at, ts AS updated_at FROM events
WHERE user_id = (SELECT arg_max(user_id, event_id) FROM events)""")
def q_owner_filter(spark, d):
    from lexframe.operators.predicates import owner_filter
    ev = B.table(spark, d, "events")
    owner = ev.agg(F.max_by("user_id", "event_id").alias("u")).first()["u"]
    return owner_filter(B.conversation_list(spark, d), owner)


REQUEST_LOG_SQL = """(SELECT CAST(event_id AS VARCHAR) AS request_id, ts, 'GET' AS method,
  CASE WHEN event_id % 10 = 0 THEN '/health' ELSE '/' || event_type END AS http_path,
  CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, value AS duration_ms FROM events)"""


@register("tail_sample", f"""
SELECT * FROM {REQUEST_LOG_SQL} WHERE http_path <> '/health' AND (status_code >= 400 OR duration_ms > 1000.0
   OR CAST(('0x' || substr(md5(request_id), 1, 8)) AS BIGINT) % 1000000 < 100000)""")
def q_tail_sample(spark, d):
    from lexframe.operators.predicates import tail_sample
    return tail_sample(B.request_log(spark, d), threshold_ms=1000.0, rate=0.1)


UPLOADS_SQL = """(SELECT doc_id AS ord, source || '-' || CAST(doc_id // 3 AS VARCHAR) || '.pdf' AS filename,
  CASE WHEN lang = 'de' THEN 'text/plain' WHEN doc_id % 10 <> 3 THEN 'application/pdf' END AS content_type,
  doc_id % 7 <> 0 AS process_ok, 'page ' || CAST(doc_id % 5 AS VARCHAR) AS process_error FROM documents)"""


def _uploads(spark, d):
    return B.table(spark, d, "documents").select(
        F.col("doc_id").alias("ord"),
        F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 3).cast("string"), F.lit(".pdf")).alias("filename"),
        F.when(F.col("lang") == "de", "text/plain").when(F.pmod("doc_id", F.lit(10)) != 3, "application/pdf").alias("content_type"),
        (F.pmod("doc_id", F.lit(7)) != 0).alias("process_ok"),
        F.concat(F.lit("page "), F.pmod("doc_id", F.lit(5)).cast("string")).alias("process_error"))


@register("accept_media", f"""
SELECT *, CASE WHEN content_type = 'application/pdf' THEN NULL ELSE 'Only PDF files are allowed.' END AS error
FROM {UPLOADS_SQL}""")
def q_accept_media(spark, d):
    from lexframe.operators.predicates import accept_media
    return accept_media(_uploads(spark, d))


@register("is_empty", "SELECT count(*) = 0 AS empty FROM (SELECT 1 FROM documents LIMIT 1)")
def q_is_empty(spark, d):
    from lexframe.operators.predicates import is_empty
    return is_empty(B.table(spark, d, "documents"))


@register("left_feedback_join", f"""
SELECT i.interaction_id, i.thread_id, i.timestamp, f.is_positive
FROM {INTER_SQL} i LEFT JOIN {FEEDBACK_SQL} f ON f.interaction_id = i.interaction_id""")
def q_left_feedback_join(spark, d):
    return usage.left_feedback_join(B.interactions(spark, d), B.feedback(spark, d)).select(
        "interaction_id", "thread_id", "timestamp", "is_positive")


@register("unused_documents", """
SELECT doc_id AS document_id, source, lang FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def q_unused_documents(spark, d):
    docs = B.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "source", "lang")
    used = B.table(spark, d, "labels").select(F.col("doc_id").alias("interaction_id"),
                                              F.col("doc_id").alias("document_id"))
    return usage.unused_documents(docs, used)


@register("cited_documents", f"""
SELECT DISTINCT l.l_orderkey AS interaction_id, d.document_id, d.filename
FROM lineitem l JOIN {DOCS_SQL} d ON d.document_id = l.l_partkey""")
def q_cited_documents(spark, d):
    docs = B.documents(spark, d)
    answers = (B.table(spark, d, "lineitem").join(docs, F.col("l_partkey") == F.col("document_id"))
               .select(F.col("l_orderkey").alias("interaction_id"),
                       F.array("filename", "filename",
                               F.concat(F.lit("no-such-"), F.col("l_suppkey").cast("string"))).alias("used_documents")))
    return usage.cited_documents(answers, docs)


KNOWN_FILES_SQL = """(SELECT DISTINCT d.source || '-' || CAST(d.doc_id // 3 AS VARCHAR) || '.pdf' AS filename FROM documents d
  JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 1)"""


@register("intake_documents", f"""
WITH b AS {UPLOADS_SQL},
firsts AS (SELECT filename, min(ord) AS first_pdf FROM b WHERE content_type = 'application/pdf' GROUP BY filename),
e AS (SELECT b.ord, b.filename,
        CASE WHEN b.content_type IS DISTINCT FROM 'application/pdf' THEN 'Only PDF files are allowed.'
             WHEN b.filename IN (SELECT filename FROM {KNOWN_FILES_SQL}) OR b.ord <> f.first_pdf
               THEN 'Document with this filename already exists.'
             WHEN NOT b.process_ok THEN 'Failed to process PDF: ' || b.process_error END AS error
      FROM b LEFT JOIN firsts f ON f.filename = b.filename)
SELECT ord, filename, CASE WHEN error IS NULL THEN 'accepted' ELSE 'failed' END AS status, error FROM e""")
def q_intake_documents(spark, d):
    docs = B.table(spark, d, "documents")
    known = (docs.join(B.table(spark, d, "labels").where(F.col("toxic") == 1), "doc_id", "left_semi")
             .select(F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 3).cast("string"), F.lit(".pdf")).alias("filename")))
    return usage.intake_documents(_uploads(spark, d), known, process_ok_col="process_ok")


VOTES_SQL = "(SELECT doc_id AS feedback_id, doc_id * 20 AS interaction_id, quality = 1 AS is_positive FROM labels)"


@register("feedback_reference_check", f"""
SELECT v.*, CASE WHEN EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = v.interaction_id)
                 THEN 'accepted' ELSE 'rejected' END AS status
FROM {VOTES_SQL} v""")
def q_feedback_reference_check(spark, d):
    votes = B.table(spark, d, "labels").select(
        F.col("doc_id").alias("feedback_id"), (F.col("doc_id") * 20).alias("interaction_id"),
        (F.col("quality") == 1).alias("is_positive"))
    ok, bad = usage.feedback_reference_check(votes, B.interactions(spark, d))
    return ok.withColumn("status", F.lit("accepted")).unionByName(bad.withColumn("status", F.lit("rejected")))


@register("load_metrics", f"""
SELECT scrape_date, count(*) AS rows, count(DISTINCT id_norma) AS unique_ids
FROM ({B.NORM_ROWS_SQL}) GROUP BY scrape_date""")
def q_load_metrics(spark, d):
    return usage.load_metrics(B.norm_rows(spark, d), "scrape_date", "id_norma")


@register("load_observed", f"""
SELECT count(*) AS rows, count(*) FILTER (id_norma IS NULL) AS without_key, min(scrape_date) AS first, max(scrape_date) AS last
FROM ({B.NORM_ROWS_SQL})""")
def q_load_observed(spark, d):
    """Metrics of a load, collected while the master is written."""
    from lexframe.sources.norms import write_version
    rows, metrics = usage.observed(B.norm_rows(spark, d))
    write_version(rows, scratch_path(spark, "master"), "1")
    return spark.createDataFrame([metrics.get], "rows long, without_key long, first date, last date")


@register("top5_with_remainder", f"""
SELECT thread_id, interaction_id, response_time, rank, greatest(n - 5, 0) AS remainder FROM (
  SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY response_time DESC, interaction_id) AS rank,
         count(*) OVER (PARTITION BY thread_id) AS n
  FROM {INTER_SQL}) WHERE rank <= 5""")
def q_top5_with_remainder(spark, d):
    i = B.interactions(spark, d).select("thread_id", "interaction_id", "response_time")
    return usage.top_with_remainder(i, [F.desc("response_time"), F.asc("interaction_id")], 5, ["thread_id"])


@register("usage_dashboard", f"""
WITH u AS (SELECT d.filename, count(*) AS c FROM {DOCS_SQL} d JOIN {LINKS_SQL} x ON x.document_id = d.document_id
           JOIN {INTER_SQL} i ON i.interaction_id = x.interaction_id GROUP BY d.filename),
w AS (SELECT d.filename, count(*) AS c FROM {DOCS_SQL} d JOIN {LINKS_SQL} x ON x.document_id = d.document_id
      JOIN {INTER_SQL} i ON i.interaction_id = x.interaction_id
      WHERE i.timestamp >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 7 DAY GROUP BY d.filename),
ur AS (SELECT *, row_number() OVER (ORDER BY c DESC, filename) AS rank FROM u),
wr AS (SELECT *, row_number() OVER (ORDER BY c DESC, filename) AS rank FROM w)
SELECT 'query_count' AS section, CAST(rank AS BIGINT) AS rank, filename AS name, CAST(c AS DOUBLE) AS value FROM ur
UNION ALL SELECT 'weekly_query_count', CAST(rank AS BIGINT), filename, CAST(c AS DOUBLE) FROM wr
UNION ALL SELECT 'summary', NULL, 'average_response_time_seconds',
  CASE WHEN coalesce(avg(o_totalprice), 0) = 0 THEN 0.0 ELSE round_even(avg(o_totalprice), 3) END FROM orders
UNION ALL SELECT 'summary', NULL, 'total_interactions', CAST(count(*) AS DOUBLE) FROM orders
UNION ALL SELECT 'summary', NULL, 'total_feedback_count', CAST(count(*) AS DOUBLE) FROM labels
UNION ALL SELECT 'summary', NULL, 'positive_feedback_count', CAST(count(*) FILTER (WHERE quality = 1) AS DOUBLE) FROM labels
UNION ALL SELECT 'summary', NULL, 'negative_feedback_count', CAST(count(*) FILTER (WHERE quality <> 1) AS DOUBLE) FROM labels
UNION ALL SELECT 'summary', NULL, 'positive_feedback_percentage',
  CASE WHEN count(*) > 0 THEN round_even(count(*) FILTER (WHERE quality = 1) / count(*) * 100.0, 2) ELSE 0.0 END
  FROM labels""")
def q_usage_dashboard(spark, d):
    """Both rankings whole, and the summaries."""
    return usage.usage_dashboard(B.documents(spark, d), B.links(spark, d), B.interactions(spark, d),
                                 B.feedback(spark, d), _as_of(spark, d))


@register("usage_dashboard_top5", f"""
WITH u AS (SELECT d.filename, count(*) AS c FROM {DOCS_SQL} d JOIN {LINKS_SQL} x ON x.document_id = d.document_id
           JOIN {INTER_SQL} i ON i.interaction_id = x.interaction_id GROUP BY d.filename),
r AS (SELECT *, row_number() OVER (ORDER BY c DESC, filename) AS rank FROM u)
SELECT CAST(rank AS BIGINT) AS rank, filename AS name, CAST(c AS DOUBLE) AS value FROM r WHERE rank <= 5
UNION ALL SELECT NULL, 'more', CAST(greatest(count(*) - 5, 0) AS DOUBLE) FROM u""")
def q_usage_dashboard_top5(spark, d):
    """The all-time ranking as the page shows it: five lines and the number of the others."""
    out = usage.usage_dashboard(B.documents(spark, d), B.links(spark, d), B.interactions(spark, d),
                                B.feedback(spark, d), _as_of(spark, d), n=5)
    return out.where(F.col("section") == "query_count").drop("section")


# ---------------------------------------------------------------- conversations
def _messages_with_blocks(spark, d):
    """conversations as chat history; assistant answers arrive as structured
    output: empty text and a JSON block list whose tool call carries the answer."""
    m = B.messages(spark, d)
    blocks = F.to_json(F.array(
        F.struct(F.lit("text").alias("type"), F.struct(F.lit(None).cast("string").alias("answer")).alias("args")),
        F.struct(F.lit("tool_call").alias("type"), F.struct(F.col("text").alias("answer")).alias("args"))))
    is_a = F.col("role") == "assistant"
    return m.select("thread_id", "turn", "role",
                    F.when(is_a, F.lit("")).otherwise(F.col("text")).alias("text"),
                    F.when(is_a, blocks).alias("blocks"))


@register("message_content", """
SELECT conv_id AS thread_id, turn, role, nullif(text, '') AS content FROM conversations""")
def q_message_content(spark, d):
    from lexframe.operators.conversations import message_content
    return message_content(_messages_with_blocks(spark, d)).select("thread_id", "turn", "role", "content")


@register("align_interactions", """
WITH m AS (SELECT conv_id AS thread_id, turn, role, nullif(text, '') AS content FROM conversations),
a AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY turn) AS n FROM m
      WHERE role = 'assistant' AND content IS NOT NULL),
i AS (SELECT e.event_id AS interaction_id, e.user_id AS thread_id, l.quality = 1 AS feedback,
             row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS n
      FROM events e LEFT JOIN labels l ON l.doc_id = e.event_id)
SELECT thread_id, turn, role, content, CAST(NULL AS BIGINT) AS interaction_id, CAST(NULL AS BOOLEAN) AS feedback
FROM m WHERE role = 'user'
UNION ALL
SELECT a.thread_id, a.turn, a.role, a.content, i.interaction_id, i.feedback
FROM a LEFT JOIN i ON i.thread_id = a.thread_id AND i.n = a.n""")
def q_align_interactions(spark, d):
    from lexframe.operators.conversations import align_interactions, message_content
    msgs = message_content(_messages_with_blocks(spark, d))
    fb = B.table(spark, d, "labels").select(F.col("doc_id").alias("interaction_id"),
                                           (F.col("quality") == 1).alias("is_positive"))
    return align_interactions(msgs, B.thread_interactions(spark, d), fb)


@register("recency_buckets", """
WITH c AS (SELECT event_id AS id, user_id, event_type AS title, ts AS updated_at FROM events),
a AS (SELECT CAST(max(ts) AS DATE) AS day FROM events),
r AS (SELECT c.*, CASE WHEN updated_at >= a.day THEN 0
                       WHEN updated_at >= a.day - INTERVAL 1 DAY THEN 1
                       WHEN updated_at >= a.day - INTERVAL 7 DAY THEN 2
                       WHEN updated_at >= a.day - INTERVAL 30 DAY THEN 3 ELSE 4 END AS period_rank
      FROM c, a)
SELECT id, user_id, title, updated_at, period_rank,
       row_number() OVER (PARTITION BY period_rank ORDER BY updated_at DESC, id) AS pos,
       ['Today', 'Yesterday', 'Last 7 days', 'Last month', 'Older'][period_rank + 1] AS period FROM r""")
def q_recency_buckets(spark, d):
    from lexframe.operators.conversations import recency_buckets
    as_of = B.table(spark, d, "events").agg(F.max("ts").alias("m")).first()["m"]
    convs = B.conversation_list(spark, d).select("id", "user_id", "title", "updated_at")
    return recency_buckets(convs, as_of)


CONV_START_SQL = "TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id * 10)"


def _conversation_changes(spark, d):
    """conversations → a conversation table (one row per thread, default title) and its
    change log: each turn is a message; a thread's first user turn renames it to the
    auto title; a system turn deletes the thread."""
    from lexframe.operators.conversations import auto_title
    c = B.table(spark, d, "conversations")
    start = F.timestamp_add("MINUTE", F.col("conv_id") * 10, F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")))
    convs = c.select("conv_id").distinct().select(
        F.col("conv_id").alias("id"), F.lit(None).cast("string").alias("user_id"),
        F.lit("New Conversation").alias("title"), start.alias("created_at"), start.alias("updated_at"))
    kind = (F.when(F.col("role") == "system", "delete")
            .when((F.col("role") == "user") & (F.col("turn") == 0), "rename").otherwise("message"))
    changes = c.select(F.col("conv_id").alias("id"),
                       F.timestamp_add("MINUTE", F.col("turn") + 1, start).alias("ts"),
                       kind.alias("kind"),
                       F.when(kind == "rename", auto_title("text")).alias("title"),
                       F.lit(None).cast("string").alias("user_id"))
    return convs, changes


@register("touch_conversations", f"""
WITH ch AS (SELECT conv_id AS id, {CONV_START_SQL} + to_minutes(turn + 1) AS ts,
                   CASE WHEN role = 'system' THEN 'delete' WHEN role = 'user' AND turn = 0 THEN 'rename'
                        ELSE 'message' END AS kind,
                   CASE WHEN role = 'user' AND turn = 0 AND role <> 'system'
                        THEN nullif(trim(substring(text, 1, 50)), '') END AS title
            FROM conversations),
latest AS (SELECT id, max(ts) AS ts, arg_max(title, ts) FILTER (WHERE kind = 'rename' AND title IS NOT NULL) AS title
           FROM ch WHERE kind IN ('message', 'rename') AND (kind <> 'rename' OR title IS NOT NULL) GROUP BY id),
convs AS (SELECT DISTINCT conv_id AS id, {CONV_START_SQL} AS created_at FROM conversations)
SELECT c.id, CAST(NULL AS VARCHAR) AS user_id, coalesce(l.title, 'New Conversation') AS title, c.created_at,
       greatest(c.created_at, l.ts) AS updated_at
FROM convs c LEFT JOIN latest l ON l.id = c.id
WHERE c.id NOT IN (SELECT id FROM ch WHERE kind = 'delete')
UNION ALL SELECT id + 1000000000, 'u', 'New Conversation', created_at, created_at FROM convs""")
def q_touch_conversations(spark, d):
    from lexframe.operators.conversations import touch_conversations
    convs, changes = _conversation_changes(spark, d)
    # Changes of unknown conversations have no effect; a create inserts one.
    unknown = changes.where("kind <> 'delete'").withColumn("id", -1 - F.col("id"))
    made = convs.select((F.col("id") + 1000000000).alias("id"), F.col("created_at").alias("ts"), F.lit("create").alias("kind"),
                        F.lit(None).cast("string").alias("title"), F.lit("u").alias("user_id"))
    return touch_conversations(convs, changes.unionByName(unknown).unionByName(made))


# ---------------------------------------------------------------- dedup and upsert
@register("dedup_keep_last", """
SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def q_dedup_keep_last(spark, d):
    from lexframe.operators.upsert import dedup_keep_last
    return dedup_keep_last(B.table(spark, d, "events"), "user_id", ["ts", "event_id"])


@register("merge_embeddings", f"""
WITH norm_rows AS ({B.NORM_ROWS_SQL}),
src AS (SELECT id_norma, texto_resumido AS content, titulo_resumido AS title FROM ({B.REVISED_NORMS_SQL}))
SELECT id_norma, texto_resumido AS content, titulo_resumido AS title FROM norm_rows
WHERE id_norma NOT IN (SELECT id_norma FROM src)
UNION ALL SELECT * FROM src""")
def q_merge_embeddings(spark, d):
    from lexframe.operators.retrieval import embedding_input
    from lexframe.operators.upsert import merge_embeddings
    target = embedding_input(B.norm_rows(spark, d))
    source = embedding_input(B.revised_norms(spark, d))
    merged, _ = merge_embeddings(target, source, "id_norma")
    return merged


VOTE_LOG_SQL = """(SELECT event_id AS vote_id, user_id AS interaction_id,
  event_type IN ('purchase', 'click') AS is_positive, ts FROM events)"""


@register("upsert_feedback", f"""
WITH v AS (SELECT * FROM {VOTE_LOG_SQL}
           QUALIFY row_number() OVER (PARTITION BY interaction_id ORDER BY ts DESC, vote_id DESC) = 1),
c AS (SELECT doc_id AS interaction_id, quality = 1 AS is_positive, TIMESTAMP '2024-01-15 00:00:00' AS ts FROM labels)
SELECT coalesce(c.interaction_id, v.interaction_id) AS interaction_id,
       CASE WHEN v.ts IS NOT NULL AND (c.ts IS NULL OR v.ts >= c.ts) THEN v.is_positive ELSE c.is_positive END
         AS is_positive,
       CASE WHEN v.ts IS NOT NULL AND (c.ts IS NULL OR v.ts >= c.ts) THEN v.ts ELSE c.ts END AS ts,
       CASE WHEN c.interaction_id IS NULL THEN 'created'
            WHEN v.ts IS NOT NULL AND (c.ts IS NULL OR v.ts >= c.ts) THEN 'updated' ELSE 'unchanged' END AS action
FROM c FULL OUTER JOIN v ON v.interaction_id = c.interaction_id""")
def q_upsert_feedback(spark, d):
    from lexframe.operators.upsert import upsert_feedback
    ev = B.table(spark, d, "events")
    votes = ev.select(F.col("event_id").alias("vote_id"), F.col("user_id").alias("interaction_id"),
                      F.col("event_type").isin("purchase", "click").alias("is_positive"), "ts")
    current = B.table(spark, d, "labels").select(
        F.lit(None).cast("long").alias("vote_id"), F.col("doc_id").alias("interaction_id"), (F.col("quality") == 1).alias("is_positive"),
        F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00")).alias("ts"))
    return upsert_feedback(current, votes)


# ---------------------------------------------------------------- retrieval
TOKENS_SQL = r"list_filter(regexp_split_to_array(lower({t}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _hashed_sql(src: str, id_col: str, text_col: str, dim: int) -> str:
    """Sparse hashed embedding (id, bucket, weight) in DuckDB SQL."""
    toks = TOKENS_SQL.format(t=text_col)
    return f"""(SELECT id, bucket, CAST(c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS FLOAT) AS weight FROM (
      SELECT id, bucket, sum(s) AS c FROM (
        SELECT id, CAST(CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % {dim} AS INTEGER) AS bucket,
               CASE WHEN CAST(('0x' || substr(md5(tok), 9, 1)) AS INTEGER) < 8 THEN 1 ELSE -1 END AS s
        FROM (SELECT {id_col} AS id, unnest({toks}) AS tok FROM {src}))
      GROUP BY id, bucket HAVING sum(s) <> 0))"""


@register("embedding_input", f"""
SELECT id_norma, texto_resumido AS content, titulo_resumido AS title FROM ({B.NORM_ROWS_SQL})""")
def q_embedding_input(spark, d):
    from lexframe.operators.retrieval import embedding_input
    return embedding_input(B.norm_rows(spark, d))


@register("embed", f"""
SELECT id AS id_norma, CAST(bucket AS INTEGER) AS dim_ix, CAST(weight AS DOUBLE) AS weight
FROM {_hashed_sql('documents', 'doc_id', 'text', 768)}""")
def q_embed(spark, d):
    from lexframe.operators.retrieval import embed
    docs = B.table(spark, d, "documents").select(F.col("doc_id").alias("id_norma"), F.col("text").alias("content"))
    e = embed(docs, "id_norma", "content", None, dim=768)
    return (e.select("id_norma", F.posexplode("ml_generate_embedding_result").alias("dim_ix", "weight"))
            .where(F.col("weight") != 0)
            .select("id_norma", F.col("dim_ix").cast("int").alias("dim_ix"), F.col("weight").cast("double").alias("weight")))


@register("valid_embeddings", """
SELECT doc_id AS id_norma FROM documents
WHERE len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) > 0""")
def q_valid_embeddings(spark, d):
    from lexframe.operators.predicates import valid_embeddings
    from lexframe.operators.retrieval import embed
    docs = B.table(spark, d, "documents").select(F.col("doc_id").alias("id_norma"), F.col("text").alias("content"))
    return valid_embeddings(embed(docs, "id_norma", "content", None, dim=64)).select("id_norma")


CHUNKS_SQL = """(SELECT doc_id, CAST(s // 1800 AS INTEGER) AS chunk_ix, CAST(s AS BIGINT) AS start_index, source,
  substring(text, s + 1, 2000) AS text
  FROM (SELECT doc_id, source, text, unnest(range(0, greatest(length(text) - 200 - 1, 0) + 1, 1800)) AS s
        FROM documents WHERE length(text) > 0))"""


@register("chunk_documents", f"SELECT * FROM {CHUNKS_SQL}")
def q_chunk_documents(spark, d):
    from lexframe.operators.retrieval import chunk_documents
    return chunk_documents(B.table(spark, d, "documents"))


KNN_SQL = """
WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS id,
             sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1),
                  lambda i: (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE))
                     * (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE))))) AS distance
           FROM embeddings a, embeddings b)
SELECT query_id, id, CAST(rank AS BIGINT) AS rank, round(distance, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM p) WHERE rank <= 4"""


@register("knn", KNN_SQL)
def q_knn(spark, d):
    from lexframe.operators.retrieval import knn
    e = B.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    hits = knn(e.withColumnRenamed("id", "query_id"), e, k=4)
    return hits.withColumn("distance", F.round("distance", 6))


@register("knn_cells", KNN_SQL)
def q_knn_cells(spark, d):
    """The same search on the cell plan, which large query tables take."""
    from lexframe.operators.retrieval import knn
    e = B.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    hits = knn(e.withColumnRenamed("id", "query_id"), e, k=4, strategy="cells")
    return hits.withColumn("distance", F.round("distance", 6))


KNN_IP_SQL = """
WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS id,
             -list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE))) AS distance
           FROM embeddings a, embeddings b)
SELECT query_id, id, CAST(rank AS BIGINT) AS rank, round(distance, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM p) WHERE rank <= 4"""


@register("knn_ip_cells", KNN_IP_SQL)
def q_knn_ip_cells(spark, d):
    """Inner product on the cell plan: cells and bound in the space where all rows have one length."""
    from lexframe.operators.retrieval import knn
    e = B.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    hits = knn(e.withColumnRenamed("id", "query_id"), e, k=4, metric="ip", strategy="cells")
    return hits.withColumn("distance", F.round("distance", 6))


@register("vector_index", KNN_SQL.replace("SELECT query_id, id, CAST", "SELECT query_id, id, label, CAST").replace("b.vec_id AS id,", "b.vec_id AS id, b.label AS label,"))
def q_vector_index(spark, d):
    """A stored index made of one label's vectors, to which the others are appended, searched with every vector."""
    from lexframe.operators import vector_index
    path = scratch_path(spark, "vector-index")
    e = B.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    first = e.agg(F.min("label")).first()[0]
    vector_index.create(e.where(F.col("label") == first), path)
    vector_index.append(e.where(F.coalesce(F.col("label") != first, F.lit(True))), path)
    hits = vector_index.search(e.withColumnRenamed("id", "query_id"), path, k=4, columns=["label"])
    return hits.withColumn("distance", F.round("distance", 6))


@register("knn_approx_recall", "SELECT vec_id AS query_id, true AS self_found, true AS at_most_k, true AS recall_reached FROM embeddings")
def q_knn_approx_recall(spark, d):
    """What approximate search promises for each query of a self search: at most k hits, the query's own
    vector among them (its cell is always probed), and all queries together find 0.9 of the exact hits."""
    hits = q_knn_approx(spark, d)
    # The exact hits and the count per query are read more than once: each search runs once.
    exact = cut_lineage(q_knn(spark, d).select("query_id", "id", F.lit(1).alias("exact")))
    found = cut_lineage(hits.join(exact, ["query_id", "id"], "left").groupBy("query_id").agg(
        F.max(F.col("distance") == 0).alias("self_found"), (F.count(F.lit(1)) <= 4).alias("at_most_k"), F.count("exact").alias("n")))
    total = exact.agg(F.count(F.lit(1)).alias("all"))
    recall = found.agg(F.sum("n").alias("n")).join(total).select((F.col("n") >= 0.9 * F.col("all")).alias("recall_reached"))  # one row each
    return found.select("query_id", "self_found", "at_most_k").join(recall)


@register("embed_model", """
SELECT doc_id AS id_norma, CASE WHEN lang = 'de' THEN 'error: ValueError' ELSE '' END AS status,
       CASE WHEN lang = 'de' THEN NULL ELSE CAST(length(lang || ' ' || coalesce(text, '')) AS DOUBLE) END AS chars FROM documents""")
def q_embed_model(spark, d):
    """A model that each worker loads once; it refuses some texts, which are reported one by one."""
    from lexframe.operators.retrieval import embed

    def load():
        def embedder(texts):
            if any(t.startswith("de ") for t in texts):
                raise ValueError("a text that the model refuses")
            return [[float(len(t)), 1.0] for t in texts]
        return embedder

    docs = B.table(spark, d, "documents").select(F.col("doc_id").alias("id_norma"), F.concat("lang", F.lit(" "), F.coalesce("text", F.lit(""))).alias("content"))
    out = embed(docs, "id_norma", "content", None, dim=2, model=load)
    return out.select("id_norma", F.col("ml_generate_embedding_status").alias("status"), F.get("ml_generate_embedding_result", 0).cast("double").alias("chars"))


@register("embed_failures", """
SELECT doc_id AS id_norma, CASE WHEN lang = 'de' THEN 'error: ValueError' WHEN doc_id % 7 = 0 THEN 'dimension 3' ELSE '' END AS status,
       CASE WHEN lang = 'de' OR doc_id % 7 = 0 THEN 0 ELSE 2 END AS dims FROM documents""")
def q_embed_failures(spark, d):
    """An embedder that fails on some texts and gives wrong lengths for others: each such row is
    reported, the others keep their vectors."""
    from lexframe.operators.retrieval import embed

    def embedder(texts):
        if any(t.startswith("de ") for t in texts):
            raise ValueError("a text that the model refuses")
        return [[1.0, float(len(t))] + [0.0] * (t.split()[1] == "0") for t in texts]

    docs = B.table(spark, d, "documents").select(
        F.col("doc_id").alias("id_norma"),
        F.concat("lang", F.lit(" "), F.pmod("doc_id", F.lit(7)).cast("string"), F.lit(" "), "text").alias("content"))
    out = embed(docs, "id_norma", "content", None, dim=2, embedder=embedder)
    return out.select("id_norma", F.col("ml_generate_embedding_status").alias("status"), F.size("ml_generate_embedding_result").alias("dims"))


@register("knn_approx")
def q_knn_approx(spark, d):
    from lexframe.operators.retrieval import knn_approx
    e = B.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return knn_approx(e.withColumnRenamed("id", "query_id"), e, k=4) \
        .withColumn("distance", F.round("distance", 6))


@register("source_name", """
SELECT page_id, string_split(coalesce(url, 'unknown'), '/')[-1] AS source_name FROM pages""")
def q_source_name(spark, d):
    from lexframe.functions.text import source_name
    return B.table(spark, d, "pages").select("page_id", source_name("url").alias("source_name"))


@register("build_context", f"""
SELECT doc_id AS query_id,
       string_agg('Source: ' || string_split(coalesce(source, 'unknown'), '/')[-1] || chr(10) || 'Content: ' || text,
                  chr(10) || chr(10) ORDER BY chunk_ix) AS context
FROM {CHUNKS_SQL} GROUP BY doc_id""")
def q_build_context(spark, d):
    from lexframe.operators.retrieval import build_context, chunk_documents
    ch = chunk_documents(B.table(spark, d, "documents")).withColumn(
        "id", F.col("doc_id") * 100000 + F.col("chunk_ix"))
    hits = ch.select(F.col("doc_id").alias("query_id"), "id", (F.col("chunk_ix") + 1).alias("rank"))
    return build_context(hits, ch.select("id", "text", "source"))


# ---------------------------------------------------------------- scans, sources, sinks
from lexframe.schemas import NORM_COLUMNS  # noqa: E402
from lexframe.session import cut_lineage, scratch_path  # noqa: E402

NORM_ROWS_CTE = f"WITH norm_rows AS ({B.NORM_ROWS_SQL})"


@register("scan_norms", f"{NORM_ROWS_CTE} SELECT * FROM norm_rows")
def q_scan_norms(spark, d):
    from lexframe.sources.norms import scan_norms, write_norms_csv
    path = scratch_path(spark, "daily-csv")
    write_norms_csv(B.norm_rows(spark, d), path)
    return scan_norms(spark, path, scratch_path(spark, "rejects")).select(*NORM_COLUMNS, "scrape_date")


@register("write_norms_csv", f"""{NORM_ROWS_CTE}
SELECT CAST(id_norma AS VARCHAR) AS id_norma, tipo_norma, numero_norma, clase_norma, organismo_origen,
       CAST(fecha_sancion AS VARCHAR) AS fecha_sancion, numero_boletin, CAST(fecha_boletin AS VARCHAR) AS fecha_boletin,
       CAST(pagina_boletin AS VARCHAR) AS pagina_boletin, nullif(titulo_resumido, '') AS titulo_resumido,
       titulo_sumario, nullif(texto_resumido, '') AS texto_resumido, observaciones, texto_original,
       texto_actualizado, CAST(modificada_por AS VARCHAR) AS modificada_por, CAST(modifica_a AS VARCHAR) AS modifica_a,
       CAST(scrape_date AS VARCHAR) AS scrape_date
FROM norm_rows""")
def q_write_norms_csv(spark, d):
    from lexframe.schemas import NORM_RAW_SCHEMA
    from lexframe.sources.norms import CSV_OPTIONS, write_norms_csv
    from pyspark.sql import types as T
    path = scratch_path(spark, "daily-csv")
    write_norms_csv(B.norm_rows(spark, d), path)
    schema = T.StructType(NORM_RAW_SCHEMA.fields + [T.StructField("scrape_date", T.StringType())])
    return spark.read.options(**CSV_OPTIONS).schema(schema).csv(path)


@register("scan_pages", "SELECT page_id, url, html FROM pages")
def q_scan_pages(spark, d):
    from lexframe.sources.norms import scan_pages
    return scan_pages(spark, f"{d}/pages.parquet")


@register("workday_partitions", """
SELECT CAST(x AS DATE) AS scrape_date
FROM (SELECT unnest(generate_series(CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE), INTERVAL 1 DAY)) AS x
      FROM orders)
WHERE isodow(x) <= 5""")
def q_workday_partitions(spark, d):
    from lexframe.sources.norms import workdays_of
    return workdays_of(B.table(spark, d, "orders"), "o_orderdate").select("scrape_date")


@register("workday_rows", """
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1)
SELECT CAST(x AS DATE) AS scrape_date, coalesce(n, 0) AS rows
FROM (SELECT unnest(generate_series((SELECT min(d) FROM d), (SELECT max(d) FROM d), INTERVAL 1 DAY)) AS x) LEFT JOIN d ON d.d = x
WHERE isodow(x) <= 5""")
def q_workday_rows(spark, d):
    from lexframe.sources.norms import workdays_of
    return workdays_of(B.table(spark, d, "orders"), "o_orderdate")


@register("append_staging", f"{NORM_ROWS_CTE} SELECT scrape_date, count(*) AS rows FROM norm_rows GROUP BY 1")
def q_append_staging(spark, d):
    from lexframe.sources.norms import append_staging
    path = scratch_path(spark, "staging")
    rows = B.norm_rows(spark, d)
    append_staging(rows, path)
    return append_staging(rows, path)  # a re-run of the same days changes nothing


@register("append_master", f"""{NORM_ROWS_CTE}
SELECT id_norma, scrape_date, texto_resumido FROM norm_rows
UNION ALL SELECT id_norma, scrape_date, texto_resumido FROM ({B.REVISED_NORMS_SQL})""")
def q_append_master(spark, d):
    from lexframe.sources.norms import append_master
    return append_master(B.norm_rows(spark, d), B.revised_norms(spark, d)).select(
        "id_norma", "scrape_date", "texto_resumido")


@register("load_master", f"""{NORM_ROWS_CTE},
a AS (SELECT * FROM norm_rows UNION ALL SELECT * FROM ({B.REVISED_NORMS_SQL}))
SELECT id_norma, scrape_date, texto_resumido FROM a
QUALIFY row_number() OVER (PARTITION BY id_norma ORDER BY scrape_date DESC) = 1""")
def q_load_master(spark, d):
    from lexframe.sources.norms import append_master, load_master, scan_norms_raw, write_norms_csv
    # Both batches land as daily files, so load order comes from the scan.
    path = scratch_path(spark, "daily-csv")
    write_norms_csv(append_master(B.norm_rows(spark, d), B.revised_norms(spark, d)), path)
    from lexframe.sources.norms import quarantine
    good, _ = quarantine(scan_norms_raw(spark, path))
    master = load_master(good, scratch_path(spark, "master"), "1")
    return master.select("id_norma", "scrape_date", "texto_resumido")


@register("load_order", f"""{NORM_ROWS_CTE}
SELECT id_norma, CASE WHEN id_norma % 3 = 0 THEN 'second file' ELSE texto_resumido END AS texto_resumido FROM norm_rows""")
def q_load_order(spark, d):
    """Two files a day, the second far smaller: its rows come last, though Spark reads large files first."""
    from lexframe.sources.norms import load_master, quarantine, scan_norms_raw, write_norms_csv
    path = scratch_path(spark, "daily-csv")
    rows = B.norm_rows(spark, d)
    write_norms_csv(rows, path)
    write_norms_csv(rows.where("id_norma % 3 = 0").withColumn("texto_resumido", F.lit("second file")), path, mode="append")
    good, _ = quarantine(scan_norms_raw(spark, path))
    return load_master(good, scratch_path(spark, "master"), "1").select("id_norma", "texto_resumido")


@register("create_embeddings_table", f"""{NORM_ROWS_CTE}
SELECT id_norma, CASE WHEN n > 0 THEN '' ELSE 'empty content' END AS ml_generate_embedding_status,
       CASE WHEN n > 0 THEN 768 ELSE 0 END AS dims, texto_resumido AS content, titulo_resumido AS title
FROM (SELECT *, len({TOKENS_SQL.format(t='texto_resumido')}) AS n FROM norm_rows) WHERE n > 0""")
def q_create_embeddings_table(spark, d):
    from lexframe.sources.norms import create_embeddings_table
    t = create_embeddings_table(B.norm_rows(spark, d), scratch_path(spark, "master-embeddings"), dim=768)
    return t.select("id_norma", "ml_generate_embedding_status",
                    F.size("ml_generate_embedding_result").alias("dims"), "content", "title")


@register("archive_snapshot", f"""{NORM_ROWS_CTE}
SELECT id_norma, scrape_date, DATE '2025-12-31' AS snapshot_date FROM norm_rows""")
def q_archive_snapshot(spark, d):
    from lexframe.sources.norms import archive_snapshot
    root = scratch_path(spark, "archive")
    archive_snapshot(B.norm_rows(spark, d).select("id_norma", "scrape_date"), root, "2025-12-31")
    return spark.read.parquet(root).select("id_norma", "scrape_date", "snapshot_date")


@register("truncate_staging", f"{NORM_ROWS_CTE} SELECT id_norma, scrape_date FROM norm_rows WHERE false")
def q_truncate_staging(spark, d):
    from lexframe.sources.norms import append_staging, truncate_staging
    path = scratch_path(spark, "staging")
    append_staging(B.norm_rows(spark, d), path)
    truncate_staging(spark, path)
    return spark.read.parquet(path).select("id_norma", "scrape_date")


@register("consume_staging", f"{NORM_ROWS_CTE} SELECT scrape_date, count(*) AS rows, CAST(0 AS BIGINT) AS left_in_staging FROM norm_rows GROUP BY 1")
def q_consume_staging(spark, d):
    """Staged days merged and emptied: the consumed dates stay on record."""
    from lexframe.sources.norms import append_staging, consume_staging
    path = scratch_path(spark, "staging")
    append_staging(B.norm_rows(spark, d), path)
    done = consume_staging(spark, path, scratch_path(spark, "consumed"), "1").drop("load")
    return done.crossJoin(spark.read.parquet(path).agg(F.count(F.lit(1)).alias("left_in_staging")))  # one row


@register("write_chunks", f"""SELECT *, CASE WHEN len({TOKENS_SQL.format(t='text')}) > 0 THEN 64 ELSE 0 END AS dims FROM {CHUNKS_SQL}""")
def q_write_chunks(spark, d):
    """The chunk store, each chunk with its vector."""
    from lexframe.operators.retrieval import chunk_documents
    from lexframe.sources.norms import write_chunks
    path = scratch_path(spark, "chunks")
    write_chunks(chunk_documents(B.table(spark, d, "documents")), path, dim=64)
    return spark.read.parquet(path).withColumn("dims", F.size("embedding")).drop("embedding")


@register("clear_chunks", f"SELECT count(*) AS deleted, CAST(0 AS BIGINT) AS remaining FROM {CHUNKS_SQL}")
def q_clear_chunks(spark, d):
    from lexframe.operators.retrieval import chunk_documents
    from lexframe.sources.norms import clear_chunks, write_chunks
    path = scratch_path(spark, "chunks")
    write_chunks(chunk_documents(B.table(spark, d, "documents")), path)
    deleted = clear_chunks(spark, path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("remaining")).withColumn("deleted", F.lit(deleted).cast("long"))


@register("chunk_documents_recursive")
def q_chunk_documents_recursive(spark, d):
    """The upload path's separator splitter over every text (tests/test_invariants.py holds it
    against its rules; SQL has no form of it)."""
    from lexframe.operators.retrieval import chunk_documents
    return chunk_documents(B.table(spark, d, "documents"), mode="recursive")


QUARANTINE_RAW_SQL = f"""{NORM_ROWS_CTE},
raw AS (SELECT id_norma, CASE WHEN tipo_norma = 'fr' THEN 'sin fecha' ELSE CAST(fecha_sancion AS VARCHAR) END
               AS fecha_sancion, CAST(pagina_boletin AS VARCHAR) AS pagina_boletin FROM norm_rows)"""


@register("quarantine", f"""{QUARANTINE_RAW_SQL}
SELECT id_norma, CASE WHEN tipo_norma_ok THEN 'ok' ELSE 'rejected' END AS status,
       CASE WHEN tipo_norma_ok THEN NULL ELSE 'fecha_sancion' END AS reason
FROM (SELECT id_norma, fecha_sancion <> 'sin fecha' AS tipo_norma_ok FROM raw)""")
def q_quarantine(spark, d):
    from lexframe.sources.norms import quarantine, scan_norms_raw, write_norms_csv
    rows = B.norm_rows(spark, d)
    raw = rows.withColumn("fecha_sancion", F.when(F.col("tipo_norma") == "fr", F.lit("sin fecha"))
                          .otherwise(F.col("fecha_sancion").cast("string")))
    path = scratch_path(spark, "daily-csv")
    write_norms_csv(raw, path)
    good, bad = quarantine(scan_norms_raw(spark, path))
    return (good.select("id_norma", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("reason"))
            .unionByName(bad.select(F.col("id_norma").cast("long").alias("id_norma"), F.lit("rejected").alias("status"),
                                    "reason")))


# ---------------------------------------------------------------- page fields
from lexframe.plans import html_sql as HS  # noqa: E402

PAGE_BASE = "http://bulletin.example/base/"


def _pages(spark, d):
    return B.table(spark, d, "pages").select("page_id", "url", "html")


def _listings_and_pages(spark, d):
    """The rendered listings (ids below zero) and the driver's pages."""
    rendered = B.listing_pages(spark, d).withColumn("page_id", -1 - F.col("page_id")).select("page_id", "url", "html")
    return _pages(spark, d).unionByName(rendered)


LISTING_IDS_SQL = f"""(SELECT CAST(doc_id // {B.DAILY_CAP * B.LISTING_BULLETINS} * 3 AS BIGINT) AS page_id,
  CAST(row_number() OVER (PARTITION BY doc_id // {B.DAILY_CAP * B.LISTING_BULLETINS} ORDER BY doc_id DESC) - 1
       AS BIGINT) AS pos, doc_id AS norm_id FROM documents)"""
LISTING_STATUS_SQL = f"""(SELECT page_id, status, CAST(n_ids AS BIGINT) AS n_ids FROM (
  SELECT g * 3 AS page_id, 'found' AS status, count(*) AS n_ids FROM
    (SELECT doc_id // {B.DAILY_CAP * B.LISTING_BULLETINS} AS g FROM documents) GROUP BY g
  UNION ALL SELECT DISTINCT doc_id // {B.DAILY_CAP * B.LISTING_BULLETINS} * 3 + 1, 'empty', 0 FROM documents
  UNION ALL SELECT DISTINCT doc_id // {B.DAILY_CAP * B.LISTING_BULLETINS} * 3 + 2, 'suspect', 0 FROM documents))"""
LINKS_OF_PAGES_SQL = f"""(SELECT page_id, CAST(pos - 1 AS BIGINT) AS pos, norm_id FROM (
  SELECT page_id, unnest(ids) AS norm_id, unnest(generate_series(1, len(ids))) AS pos
  FROM (SELECT page_id, {HS.LISTING_IDS} AS ids FROM pages))
  UNION ALL SELECT -1 - page_id, pos, norm_id FROM {LISTING_IDS_SQL})"""


@register("extract_links", f"SELECT * FROM {LINKS_OF_PAGES_SQL}")
def q_extract_links(spark, d):
    from lexframe.operators.extract import extract_links
    return extract_links(_listings_and_pages(spark, d))


@register("classify_listing", f"""
SELECT page_id, CASE WHEN n > 0 THEN 'found'
                     WHEN contains(lower(html), 'no se encontraron') OR contains(lower(html), 'sin resultados')
                     THEN 'empty' ELSE 'suspect' END AS status, CAST(n AS BIGINT) AS n_ids
FROM (SELECT page_id, html, len({HS.LISTING_IDS}) AS n FROM pages)
UNION ALL SELECT -1 - page_id, status, n_ids FROM {LISTING_STATUS_SQL}""")
def q_classify_listing(spark, d):
    from lexframe.operators.extract import classify_listing
    return classify_listing(_listings_and_pages(spark, d))


@register("daily_cap", f"SELECT *, pos < 200 AS kept FROM {LINKS_OF_PAGES_SQL}")
def q_daily_cap(spark, d):
    """Every id, with whether a cap of 200 a listing keeps it."""
    from lexframe.operators.extract import cap_flags, extract_links
    return cap_flags(extract_links(_listings_and_pages(spark, d)), 200)


# What the rendered norm pages must give, stated from the records they are rendered from.
_TRIMMED = r"""regexp_replace({x}, '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g')"""
_SUMMARY = _TRIMMED.format(x="texto_resumido")
EXTRACTED_SQL = f"""(SELECT id_norma AS page_id, CAST(id_norma AS VARCHAR) AS id_norma,
  CASE WHEN id_norma % 17 = 0 THEN '' ELSE
    CASE tipo_norma WHEN 'en' THEN 'Ley' WHEN 'es' THEN 'Decreto' WHEN 'fr' THEN 'Resolución Conjunta' ELSE 'Disposición' END END AS tipo_norma,
  CASE WHEN id_norma % 17 = 0 THEN 'S/N' ELSE numero_norma END AS numero_norma, '' AS clase_norma,
  CASE WHEN id_norma % 17 = 0 THEN CASE WHEN regexp_matches(organismo_origen, '[0-9]$') THEN 'NACIONAL' ELSE '' END
       ELSE upper(organismo_origen) || ' NACIONAL' END AS organismo_origen,
  CAST(fecha_sancion AS VARCHAR) AS fecha_sancion,
  CASE WHEN id_norma % 11 = 0 THEN '' ELSE numero_boletin END AS numero_boletin,
  CASE WHEN id_norma % 11 = 0 THEN '' ELSE CAST(fecha_boletin AS VARCHAR) END AS fecha_boletin,
  CASE WHEN id_norma % 11 = 0 THEN '' ELSE CAST(pagina_boletin AS VARCHAR) END AS pagina_boletin,
  CASE WHEN id_norma % 11 = 0 THEN '' ELSE {_TRIMMED.format(x="titulo_resumido")} END AS titulo_resumido,
  CASE WHEN id_norma % 11 = 0 THEN '' ELSE organismo_origen END AS titulo_sumario,
  CASE WHEN id_norma % 19 <> 0 AND length({_SUMMARY}) > 10 THEN {_SUMMARY} ELSE '' END AS texto_resumido,
  CASE WHEN id_norma % 5 = 2 THEN '' ELSE 'nº ' || CAST(id_norma % 7 AS VARCHAR) END AS observaciones,
  '{PAGE_BASE}anexos/' || CAST(id_norma AS VARCHAR) || '/norma.htm' AS texto_original,
  CASE id_norma % 4 WHEN 1 THEN 'http://bulletin.example/upd/' || CAST(id_norma AS VARCHAR)
                    WHEN 2 THEN '{PAGE_BASE}upd/' || CAST(id_norma AS VARCHAR) ELSE '' END AS texto_actualizado,
  CASE WHEN id_norma % 3 = 0 THEN '0' ELSE CAST(id_norma % 29 AS VARCHAR) END AS modificada_por,
  CAST(id_norma % 23 AS VARCHAR) AS modifica_a FROM norm_rows)"""


def _field_query(key, fn_name, *columns):
    sql = f"{NORM_ROWS_CTE} SELECT page_id, {', '.join(columns)} FROM {EXTRACTED_SQL}"

    def run(spark, d):
        from lexframe.operators import extract as X
        fn = getattr(X, fn_name)
        pages = B.norm_pages(spark, d)
        return fn(pages, PAGE_BASE) if fn_name == "extract_text_links" else fn(pages)
    run.__name__ = f"q_{key}"
    register(key, sql)(run)


_field_query("extract_tipo", "extract_tipo", "tipo_norma")
_field_query("extract_numero", "extract_numero", "numero_norma")
_field_query("extract_organismo", "extract_organismo", "organismo_origen")
_field_query("extract_clase", "extract_clase", "clase_norma")
_field_query("extract_fecha_sancion", "extract_fecha_sancion", "fecha_sancion")
_field_query("extract_titles", "extract_titles", "titulo_resumido", "titulo_sumario")
_field_query("extract_boletin", "extract_boletin", "fecha_boletin", "numero_boletin", "pagina_boletin")
_field_query("extract_resumen", "extract_resumen", "texto_resumido")
_field_query("extract_text_links", "extract_text_links", "texto_original", "texto_actualizado")
_field_query("extract_modifications", "extract_modifications", "modifica_a", "modificada_por")
_field_query("extract_observaciones", "extract_observaciones", "observaciones")


@register("resolve_url", f"""
SELECT page_id, CAST(pos - 1 AS BIGINT) AS pos,
       CASE WHEN starts_with(href, 'http') THEN href ELSE '{PAGE_BASE}' || href END AS url
FROM (SELECT page_id, unnest(hrefs) AS href, unnest(generate_series(1, len(hrefs))) AS pos
      FROM (SELECT page_id, {HS.HREFS} AS hrefs FROM pages))""")
def q_resolve_url(spark, d):
    """Every link of every page made absolute."""
    from lexframe.functions.html import with_elements
    from lexframe.functions.text import resolve_url
    found = with_elements(_pages(spark, d)).select(F.col("_id").alias("page_id"), F.array_compact("hrefs").alias("hrefs"))
    return (found.select("page_id", F.posexplode("hrefs").alias("pos", "href"))
            .select("page_id", F.col("pos").cast("long").alias("pos"), resolve_url("href", PAGE_BASE).alias("url")))


@register("normalize_date", f"""
SELECT event_id, {HS.date_text("strftime(ts, '%d/%m/%Y')")} AS slash_date,
       {HS.date_text("strftime(ts, '%d-') || ['ENE','FEB','MAR','ABR','MAY','JUN','JUL','AGO','SEP','OCT','NOV','DIC'][month(ts)] || strftime(ts, '-%Y')")}
         AS dashed_date
FROM events""")
def q_normalize_date(spark, d):
    """Dates of every event, rendered in the bulletin's two formats and parsed back."""
    from lexframe.functions.text import SPANISH_MONTHS
    from lexframe.operators.extract import date_text
    ev = B.table(spark, d, "events")
    months = F.array(*[F.lit(m) for m in SPANISH_MONTHS])
    dashed = F.concat(F.date_format("ts", "dd-"), F.element_at(months, F.month("ts")), F.date_format("ts", "-yyyy"))
    return ev.select("event_id", date_text(F.date_format("ts", "dd/MM/yyyy")).alias("slash_date"),
                     date_text(dashed).alias("dashed_date"))


@register("extract_norms", f"{NORM_ROWS_CTE} SELECT * EXCLUDE (page_id) FROM {EXTRACTED_SQL}")
def q_extract_norms(spark, d):
    """Every field of bulletin-style pages rendered from the documents: the rules must
    give back the record each page was rendered from."""
    from lexframe.operators.extract import extract_norms
    return extract_norms(B.norm_pages(spark, d), PAGE_BASE)


# ---------------------------------------------------------------- streaming
@register("stream_merge_norms", f"""{NORM_ROWS_CTE},
src AS (SELECT * FROM ({B.REVISED_NORMS_SQL})),
m AS (SELECT id_norma, texto_resumido AS content, titulo_resumido AS title FROM norm_rows
      WHERE id_norma NOT IN (SELECT id_norma FROM src)
      UNION ALL SELECT id_norma, texto_resumido, titulo_resumido FROM src)
SELECT id_norma, content, title FROM m
WHERE len({TOKENS_SQL.format(t='content')}) > 0""")
def q_stream_merge_norms(spark, d):
    """Two arrivals of daily files (the original days, then a revised day) through the
    streaming merge; the result is the current embeddings table."""
    from lexframe.sources.norms import read_keyed, write_norms_csv
    from lexframe.streaming.streams import stream_merge_norms
    in_dir, table_dir, ckpt = (scratch_path(spark, x) for x in ("inbox", "emb-table", "emb-ckpt"))
    for batch in (B.norm_rows(spark, d), B.revised_norms(spark, d)):
        write_norms_csv(batch, in_dir, mode="append", compression="gzip")
        stream_merge_norms(spark, in_dir, table_dir, ckpt, dim=64).awaitTermination()
    return read_keyed(spark, table_dir).select("id_norma", "content", "title")


@register("stream_merge_backfill", f"""{NORM_ROWS_CTE},
src AS (SELECT id_norma, texto_resumido, titulo_resumido FROM ({B.REVISED_NORMS_SQL})),
m AS (SELECT id_norma, texto_resumido AS content, titulo_resumido AS title FROM norm_rows
      WHERE id_norma NOT IN (SELECT id_norma FROM src)
      UNION ALL SELECT * FROM src)
SELECT id_norma, content, title FROM m WHERE len({TOKENS_SQL.format(t='content')}) > 0""")
def q_stream_merge_backfill(spark, d):
    """A created embeddings table, then two streams with checkpoints of their own: the revised days,
    and the original days arriving late (an older row never replaces a newer one)."""
    from lexframe.sources.norms import create_embeddings_table, read_keyed, write_norms_csv
    from lexframe.streaming.streams import stream_merge_norms
    table_dir = scratch_path(spark, "emb-table")
    create_embeddings_table(B.norm_rows(spark, d), table_dir, dim=64)
    for batch in (B.revised_norms(spark, d), B.norm_rows(spark, d)):
        in_dir, ckpt = scratch_path(spark, "inbox"), scratch_path(spark, "emb-ckpt")
        write_norms_csv(batch, in_dir, compression="gzip")
        for _ in range(2):  # a restart of the stream finds nothing new
            stream_merge_norms(spark, in_dir, table_dir, ckpt, dim=64).awaitTermination()
    return read_keyed(spark, table_dir).select("id_norma", "content", "title")


@register("stream_merge_corrections", f"""{NORM_ROWS_CTE}
SELECT id_norma, CASE WHEN tipo_norma IN ('en', 'fr') THEN 'corrected ' || texto_resumido ELSE texto_resumido END AS content, titulo_resumido AS title
FROM norm_rows WHERE len({TOKENS_SQL.format(t='texto_resumido')}) > 0 OR tipo_norma IN ('en', 'fr')""")
def q_stream_merge_corrections(spark, d):
    """Every day arrives twice: as published, then with corrected rows of the same day in another order; the first
    arrival is replayed at the end, as after a failure, and changes nothing."""
    from lexframe.sources.norms import read_keyed, write_norms_csv
    from lexframe.streaming.streams import stream_merge_norms
    in_dir, table_dir, ckpt = (scratch_path(spark, x) for x in ("inbox", "emb-table", "emb-ckpt"))
    rows = B.norm_rows(spark, d)
    corrected = rows.where(F.col("tipo_norma").isin("en", "fr")).withColumn("texto_resumido", F.concat(F.lit("corrected "), "texto_resumido"))
    for batch in (rows, corrected.orderBy(F.desc("id_norma"))):
        write_norms_csv(batch, in_dir, mode="append", compression="gzip")
        stream_merge_norms(spark, in_dir, table_dir, ckpt, dim=64).awaitTermination()
    stream_merge_norms(spark, in_dir, table_dir, scratch_path(spark, "emb-ckpt"), dim=64).awaitTermination()
    return read_keyed(spark, table_dir).select("id_norma", "content", "title")


@register("stream_feedback", """
WITH v AS (SELECT event_id AS vote_id, user_id AS interaction_id, event_type IN ('purchase', 'click') AS is_positive, ts
           FROM events WHERE user_id IN (SELECT doc_id FROM documents)
           QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
c AS (SELECT doc_id AS interaction_id, quality = 1 AS is_positive, TIMESTAMP '2024-01-15 00:00:00' AS ts FROM labels)
SELECT coalesce(c.interaction_id, v.interaction_id) AS interaction_id,
       CASE WHEN v.ts IS NOT NULL AND (c.ts IS NULL OR v.ts >= c.ts) THEN v.is_positive ELSE c.is_positive END
         AS is_positive,
       CASE WHEN v.ts IS NOT NULL AND (c.ts IS NULL OR v.ts >= c.ts) THEN v.ts ELSE c.ts END AS ts
FROM c FULL OUTER JOIN v ON v.interaction_id = c.interaction_id""")
def q_stream_feedback(spark, d):
    """Votes arriving as two file drops (before and after mid-month) upserted by the
    feedback stream over the stored votes."""
    from lexframe.sources.norms import write_keyed
    from lexframe.streaming.streams import accepted_votes, stream_feedback
    ev = B.table(spark, d, "events")
    votes = ev.select(F.col("event_id").alias("vote_id"), F.col("user_id").alias("interaction_id"),
                      F.col("event_type").isin("purchase", "click").alias("is_positive"), "ts")
    current = B.table(spark, d, "labels").select(
        F.lit(None).cast("long").alias("vote_id"), F.col("doc_id").alias("interaction_id"), (F.col("quality") == 1).alias("is_positive"),
        F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00")).alias("ts"))
    known = B.table(spark, d, "documents").select(F.col("doc_id").alias("interaction_id"))
    in_dir, table_dir, ckpt = (scratch_path(spark, x) for x in ("votes", "feedback", "feedback-ckpt"))
    write_keyed(current, table_dir, "interaction_id")
    cut = F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00"))
    for part in (votes.where(F.col("ts") < cut), votes.where(F.col("ts") >= cut)):
        part.write.mode("append").parquet(in_dir)
        stream = spark.readStream.schema(votes.schema).parquet(in_dir)
        stream_feedback(stream, table_dir, ckpt).awaitTermination()
    return accepted_votes(spark, table_dir, known)[0].select("interaction_id", "is_positive", "ts")


@register("stream_tail_sample", f"""
SELECT * FROM {REQUEST_LOG_SQL} WHERE http_path <> '/health' AND (status_code >= 400 OR duration_ms > 1000.0
   OR CAST(('0x' || substr(md5(request_id), 1, 8)) AS BIGINT) % 1000000 < 100000)""")
def q_stream_tail_sample(spark, d):
    """The request log replayed as a file stream, with every file delivered twice:
    duplicates are dropped within the watermark before sampling."""
    from lexframe.streaming.streams import stream_tail_sample
    log = B.request_log(spark, d)
    in_dir, out_dir, ckpt = (scratch_path(spark, x) for x in ("requests", "kept", "kept-ckpt"))
    log.write.mode("append").parquet(in_dir)
    log.write.mode("append").parquet(in_dir)
    kept = stream_tail_sample(spark.readStream.schema(log.schema).parquet(in_dir), 1000.0, 0.1, "1 hour")
    (kept.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", ckpt)
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(log.schema).parquet(out_dir)


# ---------------------------------------------------------------- user surface
@register("register_functions", f"""{NORM_ROWS_CTE}
SELECT id_norma, fecha_sancion AS parsed, organismo_origen AS source,
       CASE WHEN starts_with(texto_original, 'http') THEN texto_original ELSE '' END AS link,
       scrape_date AS workday
FROM norm_rows""")
def q_register_functions(spark, d):
    """The SQL functions applied in SQL over every norm record."""
    from lexframe.functions.register import register_functions
    register_functions(spark)
    B.norm_rows(spark, d).createOrReplaceTempView("lexframe_norm_rows")
    return spark.sql("""
        SELECT id_norma, norm_date(date_format(fecha_sancion, 'dd/MM/yyyy')) AS parsed,
               source_name(concat('corpus/', tipo_norma, '/', organismo_origen)) AS source,
               resolve_url(texto_original, '') AS link,
               workday_add(DATE '2025-10-01', floor(id_norma / 200)) AS workday
        FROM lexframe_norm_rows""")


def _search_sql(dim: int) -> str:
    emb_q = _hashed_sql("(SELECT item_id, text FROM benchmark)", "item_id", "text", dim)
    emb_c = _hashed_sql(f"(SELECT doc_id * 100000 + chunk_ix AS cid, text FROM {CHUNKS_SQL})", "cid", "text", dim)
    return f"""
WITH ch AS (SELECT doc_id * 100000 + chunk_ix AS id, source, text FROM {CHUNKS_SQL}),
qv AS (SELECT id, list(weight ORDER BY bucket) AS w, list(bucket ORDER BY bucket) AS b FROM {emb_q} GROUP BY id),
cv AS (SELECT id, list(weight ORDER BY bucket) AS w, list(bucket ORDER BY bucket) AS b FROM {emb_c} GROUP BY id),
qd AS (SELECT id, list_transform(range({dim}), lambda i: coalesce(w[list_position(b, i)], CAST(0 AS FLOAT))) AS v FROM qv),
cd AS (SELECT c.id, coalesce(v.v, list_transform(range({dim}), lambda i: CAST(0 AS FLOAT))) AS v
       FROM ch c LEFT JOIN (SELECT id, list_transform(range({dim}), lambda i: coalesce(w[list_position(b, i)],
                                   CAST(0 AS FLOAT))) AS v FROM cv) v ON v.id = c.id
       WHERE len({TOKENS_SQL.format(t='c.text')}) > 0),
p AS (SELECT q.id AS query_id, c.id,
             sqrt(list_sum(list_transform(range(1, {dim} + 1), lambda i: (CAST(q.v[i] AS DOUBLE) - CAST(c.v[i] AS DOUBLE))
                  * (CAST(q.v[i] AS DOUBLE) - CAST(c.v[i] AS DOUBLE))))) AS distance
      FROM qd q, cd c),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM p)
        WHERE rank <= 4)
SELECT b.item_id AS query_id,
       coalesce(string_agg('Source: ' || string_split(coalesce(ch.source, 'unknown'), '/')[-1] || chr(10)
                           || 'Content: ' || ch.text, chr(10) || chr(10) ORDER BY t.rank),
                '') AS context
FROM benchmark b LEFT JOIN top t ON t.query_id = b.item_id LEFT JOIN ch ON ch.id = t.id
GROUP BY b.item_id"""


@register("search", _search_sql(256))
def q_search(spark, d):
    """Every benchmark question answered against the chunk store: its stored vectors, exact
    top-4, context string."""
    from lexframe.operators.retrieval import chunk_documents, search
    from lexframe.sources.norms import write_chunks
    path = scratch_path(spark, "chunks")
    write_chunks(chunk_documents(B.table(spark, d, "documents")).select(
        (F.col("doc_id") * 100000 + F.col("chunk_ix")).alias("id"), "source", "text"), path, dim=256)
    qs = B.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search(qs, spark.read.parquet(path), k=4, dim=256, record_vector="embedding")


# ---------------------------------------------------------------- rendered listing pages
@register("listing_links", f"SELECT * FROM {LISTING_IDS_SQL}")
def q_listing_links(spark, d):
    """Norm ids of every rendered listing page, distinct, in page order."""
    from lexframe.operators.extract import extract_links
    return extract_links(B.listing_pages(spark, d))


@register("listing_status", f"SELECT * FROM {LISTING_STATUS_SQL}")
def q_listing_status(spark, d):
    """found / empty / suspect for every rendered listing page."""
    from lexframe.operators.extract import classify_listing
    return classify_listing(B.listing_pages(spark, d))


@register("listing_daily_cap", f"SELECT * FROM {LISTING_IDS_SQL} WHERE pos < {B.DAILY_CAP}")
def q_listing_daily_cap(spark, d):
    """The first 200 ids of every rendered listing page in page order."""
    from lexframe.operators.extract import daily_cap, extract_links
    return daily_cap(extract_links(B.listing_pages(spark, d)), B.DAILY_CAP)


@register("scrape_metrics", f"""
SELECT page_id, count(*) AS ids_found, count(*) AS rows_scraped, CAST(0 AS BIGINT) AS missing
FROM {LISTING_IDS_SQL} GROUP BY page_id""")
def q_scrape_metrics(spark, d):
    """Ids found on every rendered listing vs norm records extracted from the rendered
    norm pages."""
    from lexframe.operators.extract import extract_links, extract_norms
    found = extract_links(B.listing_pages(spark, d))
    scraped = extract_norms(B.norm_pages(spark, d), PAGE_BASE)
    return usage.scrape_metrics(found, scraped)
