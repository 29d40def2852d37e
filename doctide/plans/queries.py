"""The library's own queries, one an operator, and their statements for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doctide.operators import jobs, lint, pages, papers
from doctide.operators.backends import quote
from doctide.operators.rules import REGISTRY
from doctide.plans.corpus import injected, injected_sql, telemetry, telemetry_sql
from doctide.plans.lint_sql import statement
from doctide.sources import event_log
from doctide.sources.documents import spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _lint(rule: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lint.issues(injected(spark, sf_dir), [rule]).select("doc_id", "line", "start", "old_text", "new_text", "detail")

    return run


for _rule in [*REGISTRY, "long_line"]:
    query(f"lint_{_rule}", statement(_rule))(_lint(_rule))

DOCS = f"WITH d AS ({injected_sql()})"
T = r"regexp_replace(regexp_replace({}, '\s+$', ''), '^\s+', '')"


@query("lint_repeated_line_plain", statement("repeated_line").replace(injected_sql(), "SELECT doc_id, coalesce(text, '') AS body FROM documents"))
def lint_repeated_line_plain(spark, sf_dir):
    """The rule on documents as they are."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return lint.issues(docs, ["repeated_line"]).select("doc_id", "line", "start", "old_text", "new_text", "detail")


def _report_sql() -> str:
    """Counts of the rules that have a statement, from those statements."""
    from doctide.operators.rules import BY_NAME, FIX, WARN

    parts = " UNION ALL ".join(
        f"SELECT doc_id, {quote(n)} AS rule, {quote(BY_NAME[n].severity)} AS severity, new_text FROM ({statement(n)}) q_{n}" for n in SQL_RULES)
    return f"""WITH i AS ({parts}) SELECT d.doc_id, count(rule) AS total_issues,
 count(CASE WHEN severity = {quote(FIX)} THEN 1 END) AS auto_fixable, count(CASE WHEN severity = {quote(WARN)} THEN 1 END) AS warnings,
 CAST(0 AS BIGINT) AS errors, coalesce(string_agg(DISTINCT CASE WHEN severity = {quote(FIX)} THEN rule END, ',' ORDER BY
 CASE WHEN severity = {quote(FIX)} THEN rule END), '') AS fixed_rules
 FROM documents d LEFT JOIN i ON d.doc_id = i.doc_id GROUP BY d.doc_id"""


SQL_RULES = [n for n in REGISTRY if statement(n) is not None]


@query("lint_report", _report_sql())
def lint_report(spark, sf_dir):
    return lint.report(injected(spark, sf_dir), SQL_RULES)


@query("lint_report_all")
def lint_report_all(spark, sf_dir):
    return lint.report(injected(spark, sf_dir))


@query("lint_apply_fixes")
def lint_apply_fixes(spark, sf_dir):
    return lint.apply_fixes(injected(spark, sf_dir)).select("doc_id", "fixed_text", "fixed_rules", "changed")


@query("lint_fix_trailing_blanks", DOCS + r""" SELECT doc_id, array_to_string(list_transform(string_split(body, chr(10)),
 lambda s: regexp_replace(s, '\s+$', '')), chr(10)) AS fixed_text FROM d""")
def lint_fix_trailing_blanks(spark, sf_dir):
    return lint.apply_fixes(injected(spark, sf_dir), ["trailing_whitespace"]).select("doc_id", "fixed_text")


@query("lint_available_rules", "SELECT * FROM (VALUES " + ", ".join(
    f"({k}, {quote(n)}, {quote(s)})" for k, (n, s) in enumerate(lint.available_rules().items())) + ") r(ord, rule, summary)")
def lint_available_rules(spark, sf_dir):
    return spark.createDataFrame([(k, n, s) for k, (n, s) in enumerate(lint.available_rules().items())], "ord int, rule string, summary string")


# -- pages ---------------------------------------------------------------------------


def _as_pages(spark, sf_dir):
    return injected(spark, sf_dir).select("doc_id", F.lit(1).alias("page_number"), F.col("text").alias("content"))


MERGED_SQL = "'(?i)<!--\\s*Content merged with page \\d+\\s*-->'"
ODD_SQL = r"length(regexp_replace(body, '[\x20-\x7E\n\t]', '', 'g'))"


@query("verify_pages")
def verify_pages(spark, sf_dir):
    return pages.verify(_as_pages(spark, sf_dir)).drop("content")


@query("verify_pages_merge_garbled", f"""{DOCS} SELECT doc_id, t IS NULL AS is_valid, t AS error_type,
 CASE WHEN t = 'page_merge_failure' THEN regexp_extract(body, {MERGED_SQL}) END AS matched_pattern FROM (SELECT *,
 CASE WHEN regexp_matches(body, {MERGED_SQL}) THEN 'page_merge_failure' WHEN length(body) > 100 AND 2 * {ODD_SQL} > length(body) THEN 'garbled_text' END AS t FROM d) v""")
def verify_pages_merge_garbled(spark, sf_dir):
    return pages.verify(_as_pages(spark, sf_dir), checks=("merge", "garbled")).select("doc_id", "is_valid", "error_type", "matched_pattern")


@query("fallback_decision")
def fallback_decision(spark, sf_dir):
    rows = _as_pages(spark, sf_dir).withColumn("fallback_text", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("12\n"), "content")))
    return pages.recover(rows).select("doc_id", "is_valid", "error_type", "used_fallback", F.md5("content").alias("content_md5"))


SPLIT_SQL = f"""{DOCS}, l AS (SELECT doc_id, body, i, la[i] AS s, regexp_matches(la[i], '^\\s*---\\s*$') AS dash FROM
 (SELECT doc_id, body, string_split(body, chr(10)) la FROM d) q, unnest(range(1, len(la) + 1)) u(i)),
 r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, dash ORDER BY i) AS run FROM l),
 k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, dash, run ORDER BY i) AS n, min(i) OVER (PARTITION BY doc_id, dash, run) AS head FROM r),
 b AS (SELECT *, dash AND CASE WHEN head = 1 THEN n % 2 = 0 ELSE n % 2 = 1 END AS ends FROM k),
 p AS (SELECT *, 1 + coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS page FROM b),
 c AS (SELECT doc_id, page, bool_or(ends) AS closed, string_agg(CASE WHEN NOT ends THEN s END, chr(10) ORDER BY i) AS t FROM p GROUP BY doc_id, page)
 SELECT doc_id, CAST(page AS INTEGER) AS page_number, {T.format('t')} AS content FROM c WHERE t IS NOT NULL AND (closed OR page <= 3)"""


@query("split_pages", SPLIT_SQL)
def split_pages(spark, sf_dir):
    return pages.split_pages(injected(spark, sf_dir), 3)


@query("assemble_pages", f"""WITH s AS ({SPLIT_SQL}) SELECT doc_id, string_agg('<!-- Page ' || page_number || ' -->' || chr(10) || chr(10) || content,
 chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page_number) AS content FROM s GROUP BY doc_id""")
def assemble_pages(spark, sf_dir):
    return pages.assemble(pages.split_pages(injected(spark, sf_dir), 3))


@query("remap_pages", f"""WITH s AS ({SPLIT_SQL}), w AS (SELECT doc_id, r, 10 + 2 * r AS page_number FROM documents, unnest(range(1, 4)) u(r))
 SELECT w.doc_id, CAST(w.page_number AS INTEGER) AS page_number, coalesce(s.content, '<!-- Content merged with page 12 -->') AS content
 FROM w LEFT JOIN s ON s.doc_id = w.doc_id AND s.page_number = w.r""")
def remap_pages(spark, sf_dir):
    docs = injected(spark, sf_dir)
    wanted = docs.select("doc_id", F.explode(F.array(*[F.lit(10 + 2 * r) for r in (1, 2, 3)])).alias("page_number"))
    return pages.remap(pages.split_pages(docs, 3), wanted)


@query("diagram_placeholders", DOCS + r""" SELECT doc_id, regexp_replace(body, '(!\[[^\n]*?\]\([^)]+\))', chr(10) || chr(10) || '[DIAGRAM - Page 7]' || chr(10) ||
 '<!-- TODO: Add TikZ source code for diagram -->' || chr(10) || '<!-- Original image reference: \1 -->' || chr(10) || chr(10), 'g') AS content
 FROM d WHERE contains(body, '![')""")
def diagram_placeholders(spark, sf_dir):
    docs = injected(spark, sf_dir).filter(F.contains("text", F.lit("![")))
    return docs.select("doc_id", pages.diagram_placeholders(F.col("text"), F.lit(7)).alias("content"))


@query("oversized_pages", """SELECT p_partkey AS doc_id, p_size AS page_number FROM part WHERE greatest(floor(p_size * 40 * 150 / 72.0), floor(p_retailprice * 150 / 72.0)) > 2000""")
def oversized_pages(spark, sf_dir):
    dims = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_partkey").alias("doc_id"), F.col("p_size").alias("page_number"), (F.col("p_size") * 40).alias("width"),
        F.col("p_retailprice").alias("height"), F.lit(150).alias("dpi"))
    return pages.oversized(dims).select("doc_id", "page_number")


# -- jobs ----------------------------------------------------------------------------

TELEMETRY_SQL = telemetry_sql()


#: Apart from the operators: the last row of each kind by position, counts after it by comparing places.
LAST_SQL = f"""e AS ({TELEMETRY_SQL}), s AS (SELECT DISTINCT ON (job_id) * FROM e WHERE event_type = 'job_started' ORDER BY job_id, seq DESC),
 h AS (SELECT DISTINCT ON (job_id) * FROM e WHERE event_type = 'heartbeat' ORDER BY job_id, seq DESC),
 d AS (SELECT DISTINCT ON (job_id) * FROM e WHERE event_type = 'job_completed' ORDER BY job_id, seq DESC),
 p AS (SELECT job_id, list(ts_us ORDER BY ts_us DESC) FILTER (WHERE ts_us IS NOT NULL AND page_number IS NOT NULL) AS t, count(*) AS n
  FROM e WHERE event_type = 'page_completed' GROUP BY job_id)"""
JOBS_SQL = f"""WITH {LAST_SQL} SELECT j.job_id, s.total_pages, s.quality, epoch_us(s.ts) AS started_us, coalesce(p.n, 0) AS pages_completed,
 CASE WHEN h.job_id IS NULL THEN coalesce((SELECT greatest(max(x.page_number), 0) FROM e x WHERE x.job_id = j.job_id AND x.event_type = 'page_completed'), 0)
  ELSE (SELECT greatest(max(x.page_number), h.current_page) FROM e x WHERE x.job_id = j.job_id AND (x.seq = h.seq OR x.event_type = 'page_completed' AND x.seq > h.seq)) END AS current_page,
 epoch_us(h.ts) AS heartbeat_us, coalesce(h.cpu_percent, 0) AS cpu_percent, coalesce(h.memory_mb, 0) AS memory_mb, epoch_us(d.ts) AS completed_us,
 coalesce(d.error_count, 0) + (SELECT count(*) FROM e x WHERE x.job_id = j.job_id AND x.severity = 'error' AND x.seq > coalesce(d.seq, -1)) AS error_count,
 coalesce(d.warning_count, 0) + (SELECT count(*) FROM e x WHERE x.job_id = j.job_id AND x.severity <> 'error' AND x.seq > coalesce(d.seq, -1)) AS warning_count,
 d.job_id IS NULL AS is_active FROM (SELECT DISTINCT job_id FROM e) j LEFT JOIN s ON s.job_id = j.job_id LEFT JOIN h ON h.job_id = j.job_id
 LEFT JOIN d ON d.job_id = j.job_id LEFT JOIN p ON p.job_id = j.job_id"""
VELOCITY_SQL = f"""WITH {LAST_SQL} SELECT job_id, CASE WHEN len(w) < 5 THEN 0 ELSE len(w) END AS window_size,
 CASE WHEN len(w) < 5 OR w[1] <= w[-1] THEN 0 ELSE CAST(len(w) AS DOUBLE) / ((w[1] - w[-1]) / 1000000.0 / 3600) END AS velocity
 FROM (SELECT job_id, t[1:50] AS w FROM p WHERE t IS NOT NULL) x"""
METRICS_SQL = f"""WITH {LAST_SQL} SELECT s.job_id, coalesce(h.current_page, 0) AS current_page, s.total_pages, CAST(len(p.t) AS BIGINT) AS pages_completed,
 CASE WHEN s.total_pages > 0 THEN round(CAST(coalesce(h.current_page, 0) AS DOUBLE) / s.total_pages * 100, 1) ELSE 0 END AS progress_percent,
 round(v.velocity, 1) AS velocity, v.window_size, CASE WHEN v.velocity > 0 AND s.total_pages > coalesce(h.current_page, 0)
  THEN (s.total_pages - coalesce(h.current_page, 0)) / v.velocity END AS eta_hours, coalesce(h.cpu_percent, 0) AS cpu_percent,
 coalesce(h.memory_mb, 0) AS memory_mb, s.ts_us AS started_us
 FROM s JOIN p ON p.job_id = s.job_id JOIN ({VELOCITY_SQL}) v ON v.job_id = s.job_id LEFT JOIN h ON h.job_id = s.job_id"""


@query("events_typed", f"SELECT job_id, seq, event_type, page_number, current_page, severity, total_pages FROM ({TELEMETRY_SQL}) t")
def events_typed(spark, sf_dir):
    """Telemetry written as JSON lines and decoded."""
    rows = telemetry(spark, sf_dir)
    known = {"timestamp": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), "pdf_path": F.lit("a.pdf"), "output_dir": F.lit("/out"),
             "mode": F.lit("streaming"), "duration_ms": F.lit(1), "error_type": F.lit("t"), "error_message": F.lit("m"),
             "pages_completed": F.lit(1), "pages_failed": F.lit(0)}
    rows = rows.withColumn("total_pages", F.when(F.col("event_type") == "job_started", F.col("total_pages")).when(
        F.col("event_type").isin("heartbeat", "job_completed"), -1))
    line = F.to_json(F.struct(*[c.alias(n) for n, c in known.items()], "event_type", "job_id", "page_number", "current_page", "severity", "total_pages", "quality"))
    lines = rows.select("seq", line.alias("value"))
    return event_log.decode(lines).select("job_id", "seq", "event_type", "page_number", "current_page", "severity", F.nullif("total_pages", F.lit(-1)).alias("total_pages"))


@query("job_discover", JOBS_SQL)
def job_discover(spark, sf_dir):
    out = jobs.discover(telemetry(spark, sf_dir))
    return out.select("job_id", "total_pages", "quality", F.unix_micros("started_at").alias("started_us"), "pages_completed", "current_page",
                      F.unix_micros("last_heartbeat").alias("heartbeat_us"), "cpu_percent", "memory_mb", F.unix_micros("completed_at").alias("completed_us"),
                      "error_count", "warning_count", "is_active")


@query("job_velocity", VELOCITY_SQL)
def job_velocity(spark, sf_dir):
    return jobs.velocity(telemetry(spark, sf_dir))


@query("job_metrics", METRICS_SQL)
def job_metrics(spark, sf_dir):
    return jobs.metrics(telemetry(spark, sf_dir))


@query("job_stalled", f"""SELECT job_id, is_active, is_active AND
 coalesce((SELECT max(epoch_us(ts)) FROM events) - heartbeat_us > 120000000, false) AS is_stalled FROM ({JOBS_SQL}) j""")
def job_stalled(spark, sf_dir):
    rows = telemetry(spark, sf_dir)
    as_of = rows.agg(F.max("ts")).first()[0]
    return jobs.stalled(jobs.discover(rows), F.lit(as_of)).select("job_id", "is_active", "is_stalled")


@query("job_ranked", f"""SELECT job_id, CAST(row_number() OVER (ORDER BY is_active DESC,
 CASE WHEN is_active THEN -current_page END, completed_us DESC, job_id) AS INTEGER) AS place FROM ({JOBS_SQL}) j""")
def job_ranked(spark, sf_dir):
    """Jobs are few beside their events: one row each is numbered."""
    from pyspark.sql import Window

    found = jobs.discover(telemetry(spark, sf_dir))
    order = Window.orderBy(F.desc("is_active"), F.when(F.col("is_active"), -F.col("current_page")).asc_nulls_last(),
                           F.desc_nulls_last("completed_at"), "job_id")
    return found.select("job_id", F.row_number().over(order).alias("place"))


STATE_SQL = f"""SELECT job_id, min_by(total_pages, seq) FILTER (WHERE event_type = 'job_started') AS total_pages,
 list(page_number ORDER BY page_number) FILTER (WHERE event_type = 'page_completed' AND page_number IS NOT NULL) AS done,
 count(*) FILTER (WHERE event_type = 'job_started') AS starts FROM ({TELEMETRY_SQL}) t GROUP BY job_id"""


@query("job_resume_state", f"""WITH s AS ({STATE_SQL}), f AS (SELECT job_id, string_agg(CAST(page_number AS VARCHAR), ',' ORDER BY seq) AS failed FROM (
 SELECT job_id, page_number, min(seq) AS seq FROM ({TELEMETRY_SQL}) t WHERE event_type = 'error' AND severity = 'error' AND page_number <> 0 GROUP BY job_id, page_number) x GROUP BY job_id)
 SELECT s.job_id, total_pages, coalesce(array_to_string(done, ','), '') AS completed_pages, coalesce(failed, '') AS failed_pages FROM s LEFT JOIN f ON s.job_id = f.job_id WHERE starts > 0""")
def job_resume_state(spark, sf_dir):
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return jobs.resume_state(telemetry(spark, sf_dir)).select("job_id", "total_pages", text("completed_pages"), text("failed_pages"))


@query("job_last_completed", f"SELECT job_id, coalesce(max(CASE WHEN event_type = 'page_completed' THEN page_number END), 0) AS last_page FROM ({TELEMETRY_SQL}) t GROUP BY job_id")
def job_last_completed(spark, sf_dir):
    return jobs.last_completed(telemetry(spark, sf_dir))


@query("job_pending_pages", f"""WITH s AS ({STATE_SQL}) SELECT job_id, CAST(p AS INTEGER) AS page_number FROM s, unnest(range(1, total_pages + 1)) u(p)
 WHERE starts > 0 AND NOT list_contains(coalesce(done, []), CAST(p AS INTEGER))""")
def job_pending_pages(spark, sf_dir):
    return jobs.pending_pages(jobs.resume_state(telemetry(spark, sf_dir)))


@query("job_next_chunk", f"""WITH s AS ({STATE_SQL}) SELECT job_id, array_to_string(list_filter(range(1, total_pages + 1),
 lambda p: NOT list_contains(coalesce(done, []), CAST(p AS INTEGER)))[1:5], ',') AS pages FROM s WHERE starts > 0""")
def job_next_chunk(spark, sf_dir):
    chunk = jobs.next_chunk(jobs.resume_state(telemetry(spark, sf_dir)), 5)
    return chunk.select("job_id", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"))


@query("job_progress_summary", f"""WITH s AS ({STATE_SQL}), f AS (SELECT job_id, count(DISTINCT page_number) AS failed FROM ({TELEMETRY_SQL}) t
 WHERE event_type = 'error' AND severity = 'error' AND page_number <> 0 GROUP BY job_id)
 SELECT s.job_id, total_pages, CAST(coalesce(len(done), 0) AS BIGINT) AS completed, coalesce(failed, 0) AS failed,
 CAST(len(list_filter(range(1, total_pages + 1), lambda p: NOT list_contains(coalesce(done, []), CAST(p AS INTEGER)))) AS BIGINT) AS pending,
 coalesce(len(done), 0) / CAST(total_pages AS DOUBLE) * 100 AS completion_percentage FROM s LEFT JOIN f ON s.job_id = f.job_id WHERE starts > 0""")
def job_progress_summary(spark, sf_dir):
    return jobs.progress_summary(jobs.resume_state(telemetry(spark, sf_dir)))


@query("job_recent_events", f"""SELECT job_id, seq, event_type, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS rank
 FROM ({TELEMETRY_SQL}) t) r WHERE rank <= 10""")
def job_recent_events(spark, sf_dir):
    return jobs.recent(telemetry(spark, sf_dir)).select("job_id", "seq", "event_type", "rank")


@query("job_last_errors", f"""SELECT job_id, seq, severity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS rank
 FROM ({TELEMETRY_SQL}) t WHERE event_type = 'error') r WHERE rank <= 5""")
def job_last_errors(spark, sf_dir):
    return jobs.recent(telemetry(spark, sf_dir), 5, ("error",)).select("job_id", "seq", "severity", "rank")


@query("job_pages_since_heartbeat", f"""SELECT job_id, seq, current_page - lag(current_page, 1, 0) OVER (PARTITION BY job_id ORDER BY seq) AS pages_since
 FROM ({TELEMETRY_SQL}) t WHERE event_type = 'heartbeat'""")
def job_pages_since_heartbeat(spark, sf_dir):
    return jobs.pages_since_heartbeat(telemetry(spark, sf_dir)).select("job_id", "seq", "pages_since")


@query("job_display_texts", f"""SELECT job_id, seq, CASE WHEN s // 3600 > 0 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' ELSE (s // 60) || 'm' END AS elapsed,
 CASE WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS ago,
 repeat('━', CAST(floor(least(seq % 101, 100) * 30 / 100.0) AS BIGINT)) || repeat('─', CAST(30 - floor(least(seq % 101, 100) * 30 / 100.0) AS BIGINT)) AS bar
 FROM (SELECT *, (seq * 37) % 300000 AS s FROM ({TELEMETRY_SQL}) t) x""")
def job_display_texts(spark, sf_dir):
    s = (F.col("seq") * 37) % 300000
    return telemetry(spark, sf_dir).select("job_id", "seq", jobs.elapsed_text(s).alias("elapsed"), jobs.ago_text(s).alias("ago"),
                                           jobs.progress_bar(F.col("seq") % 101).alias("bar"))


FILE_NAME = "CASE o_orderpriority WHEN '1-URGENT' THEN 'x.md' WHEN '2-HIGH' THEN 'x.original.md' ELSE 'events.jsonl' END"
OUTPUTS_SQL = f"SELECT '/out/' || CAST(o_custkey AS VARCHAR) AS output_dir, {FILE_NAME} AS file_name FROM orders"


@query("cleanup_decisions", f"""WITH l AS (SELECT job_id, bool_or(event_type = 'job_completed') AS completed,
 (min_by(struct_pack(o := output_dir), seq) FILTER (WHERE event_type = 'job_started')).o AS output_dir FROM ({TELEMETRY_SQL}) t GROUP BY job_id),
 f AS (SELECT DISTINCT output_dir FROM ({OUTPUTS_SQL}) o WHERE file_name LIKE '%.md' AND file_name NOT LIKE '%.original.md')
 SELECT job_id, completed, CASE WHEN NOT completed THEN 'keep: not completed' WHEN l.output_dir IS NULL THEN 'keep: no output directory'
 WHEN f.output_dir IS NULL THEN 'keep: no final file' ELSE 'delete' END AS decision FROM l LEFT JOIN f ON l.output_dir = f.output_dir""")
def cleanup_decisions(spark, sf_dir):
    files = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.concat(F.lit("/out/"), F.col("o_custkey").cast("string")).alias("output_dir"), F.expr(FILE_NAME).alias("file_name"))
    return jobs.cleanup(telemetry(spark, sf_dir), files)


@query("cleanup_totals", f"SELECT count(*) AS found, count(*) FILTER (WHERE decision = 'delete') AS deleted, count(*) FILTER (WHERE decision <> 'delete') AS kept FROM ({ORACLES['cleanup_decisions']}) c")
def cleanup_totals(spark, sf_dir):
    return jobs.cleanup_totals(cleanup_decisions(spark, sf_dir))


# -- papers --------------------------------------------------------------------------

KEBAB_SQL = (r"regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(strip_accents({}), '[^\x00-\x7F]', '', 'g'),"
             r" '([A-Z]+)([A-Z][a-z])', '\1-\2', 'g'), '([a-z0-9])([A-Z])', '\1-\2', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')")
SURNAME_SQL = r"lower(CASE WHEN contains({0}, ',') THEN split_part({0}, ',', 1) ELSE regexp_extract({0}, '(\S+)$', 1) END)"


@query("slug_generate", f"""WITH p AS (SELECT doc_id, text AS title, CASE doc_id % 3 WHEN 0 THEN [source] WHEN 1 THEN ['Anna ' || lang, 'Élan, ' || source]
 ELSE ['J. ' || source, 'B', 'C'] END AS a FROM documents),
 s AS (SELECT doc_id, title, {KEBAB_SQL.format("CASE len(a) WHEN 1 THEN " + SURNAME_SQL.format('a[1]') + " WHEN 2 THEN " + SURNAME_SQL.format('a[1]') + " || '-' || " + SURNAME_SQL.format('a[2]') + " ELSE " + SURNAME_SQL.format('a[1]') + " || '-et-al' END")} AS author,
 list_filter(string_split({KEBAB_SQL.format('title')}, '-'), lambda w: w <> '' AND NOT list_contains([{", ".join(map(quote, papers.STOP_WORDS))}], w))[1:3] AS words FROM p)
 SELECT doc_id, author || '-' || CASE WHEN len(words) > 0 THEN array_to_string(words, '-') ELSE 'untitled' END AS slug FROM s""")
def slug_generate(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    authors = F.expr("CASE doc_id % 3 WHEN 0 THEN array(source) WHEN 1 THEN array('Anna ' || lang, 'Élan, ' || source) ELSE array('J. ' || source, 'B', 'C') END")
    return docs.select("doc_id", papers.base_slug(F.col("text"), authors).alias("slug"))


@query("slug_alias_lookup", """WITH k AS (SELECT lower(n_name) AS key, n_name AS slug, n_nationkey AS ord, 0 AS k FROM nation UNION ALL
 SELECT lower('REG-' || n_regionkey), n_name, n_nationkey, 1 FROM nation),
 f AS (SELECT key, slug FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord, k) AS r FROM k) x WHERE r = 1),
 n AS (SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN 'reg-' || (c_custkey % 7) WHEN 1 THEN c_mktsegment ELSE upper(n.n_name) END AS name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey)
 SELECT name, slug FROM n LEFT JOIN f ON lower(n.name) = f.key""")
def slug_alias_lookup(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    registry = nation.select(F.col("n_name").alias("slug"), F.col("n_nationkey").alias("ord"),
                             F.array(F.concat(F.lit("REG-"), F.col("n_regionkey").cast("string"))).alias("aliases"))
    names = (spark.read.parquet(f"{sf_dir}/customer.parquet").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
             .select(F.expr("CASE c_custkey % 3 WHEN 0 THEN 'reg-' || (c_custkey % 7) WHEN 1 THEN c_mktsegment ELSE upper(n_name) END").alias("name")).distinct())
    return papers.find_aliases(names, registry)


@query("job_id_normalize", r"""SELECT p_partkey, regexp_replace(regexp_replace(translate(regexp_replace(lower(n), '[()\[\]{}"'']', '', 'g'), ' _', '--'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g') AS cleanup_name,
 translate(lower(n), ' .', '--') AS service_name FROM (SELECT p_partkey, ' [' || p_name || '] - ' || p_brand || '__(v1.2) ' AS n FROM part) p""")
def job_id_normalize(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.concat(F.lit(" ["), "p_name", F.lit("] - "), "p_brand", F.lit("__(v1.2) "))
    return part.select("p_partkey", papers.job_name_cleanup(name).alias("cleanup_name"), papers.job_name_service(name).alias("service_name"))


@query("frontmatter_parse", """SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN source END AS title, CAST(CASE WHEN doc_id % 3 < 2 THEN n_chars END AS BIGINT) AS year,
 CASE WHEN doc_id % 3 = 2 THEN '---' || chr(10) || 'no end' || chr(10) || text ELSE text END AS body FROM documents""")
def frontmatter_parse(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    head = F.concat(F.lit("---\ntitle: "), "source", F.lit("\nyear: "), F.col("n_chars").cast("string"), F.lit("\nkeywords:\n- a\n- b\n---\n"))
    text = F.when(F.col("doc_id") % 3 < 2, F.concat(head, "text")).otherwise(F.concat(F.lit("---\nno end\n"), "text"))
    out = papers.parse_frontmatter(docs.select("doc_id", text.alias("text")))
    return out.select("doc_id", F.get_json_object("fields", "$.title").alias("title"), F.get_json_object("fields", "$.year").cast("long").alias("year"), "body")


@query("keyword_add_remove", """SELECT doc_id, array_to_string(list_concat(kw, list_filter(['p', lang, 'z', 'z'], lambda k: NOT list_contains(kw, k))), ',') AS added,
 array_to_string(list_filter(kw, lambda k: NOT list_contains(['p', lang, 'z', 'z'], k)), ',') AS removed FROM (SELECT doc_id, lang, [lang, source, 'x'] AS kw FROM documents) d""")
def keyword_add_remove(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kw, new = F.array("lang", "source", F.lit("x")), F.array(F.lit("p"), "lang", F.lit("z"), F.lit("z"))
    return docs.select("doc_id", F.array_join(papers.add_keywords(kw, new), ",").alias("added"), F.array_join(papers.remove_keywords(kw, new), ",").alias("removed"))
