"""Documents with artifacts, so that every rule fires: each document gets one by its id.

The same expression exists as a Spark column and as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doctide.operators.backends import quote
from doctide.sources.documents import spread

ARTIFACTS = (
    "a\n\n\n\n\nb\n\n\n\n\n\n\nc",
    "trail  \nnext\t\nend",
    "  lead\n```\n  code\n```\n\tx",
    "p\n\n\n# Head line\ntext\n\n\n\n## Other",
    "| a | | | |\n| a | b | c | d |\n|  |  |  |  | z |",
    "- \n* \n3.\n- item\n12. ",
    "the view from the top, and not best way to\n\nexplore the forests\nand more words\nthen stop.",
    "---\n\n---\n\n---\n\nafter\n---\n---\nno",
    "x\n42\ny\n 7 \n0\n1000\n12345\n999",
    "<!-- Page 25 -->\n<!--Content merged with page 3 -->\n<!-- End of page 9-->\n<!-- start of PAGE 2 -->",
    "def:Tilt\nTHM:main_1\nfoo:bar\nlemma:x-2",
    "¿ß!!@@##øø\nå#%&/()=?\nnormal line here\n∈ æ !!@@##",
    "theo-\nrem is well-\nknown and co-\nHomology",
    "Running Head One\nx\nRunning  Head One\ny\nRunning Head One\nz",
    "<!--  Content merged with page 26  -->\nnext <!-- content merged with page 7 -->",
    '<span id="page-51-0"></span>t &amp;lt; a &lt; b <sup>&</sup>lt; <span> </span> x</div> <p>k</p>',
    "O<sup>X</sup> K<sup>∗</sup> f <sup>-1</sup> x<sup>2</sup> <sup>-</sup><sup>1</sup> >= <sup>0</sup> |x| <sup>n</sup> (a+b) <sup>2</sup> lim<sub>n</sub> (−)<sup>∗</sup>",
    "$x^{p}$<sup>∞</sup> \\times$<sup>S</sup> ⊗<sup>R</sup> t <sup>∞</sup> <sup>K</sup>◦◦ <sup>K</sup>◦ <sup>A</sup><sup>b</sup> <sup>A</sup>b x",
    "<sup>K</sup>♭ <sup>⊂</sup> <sup>A</sup>Zar <sup>p</sup><sup>∞</sup> $R^{≥}$<sup>0</sup> i∈<sup>I</sup> $a \\times$<sup>S</sup> $y$<sup>q</sup>",
    "$K$<sub>v</sub> and $L$ <sub>w</sub> <sub>K</sub>$[x]$",
    "text ^{^{28}}$$ and\n^{^{3}}$$ end",
    "<sup>90</sup>Some text <sup>12</sup>The <sup>3</sup> ok",
    "K ∈ R and f: X → Y with $A$ ∈ $B$ the ∞ x ∞ ) α",
    "K∗ and |K| then |x| and |K∗|",
    "K◦ and K∗",
    "over G over G over G over G over G over G no no no no no no no no no no no no end",
    "|$K^*$| and $R^{≥}$ 0 |$|x|$|",
    "|$|x|$| and $|$y$|$ and $a ||z|| b$",
    "$x$ + $y$ and $a$, $b$ = $c$ \\cdot $d$\n$$ $p$ + $q$ $$",
    "K ◦ and R ^ x _ in $K ◦$",
    "t\n\n$$x$$\n\ny\n\n\n  $$\nz$$ \n\nw",
    "** Z ** and **C** then **B** and $**Q**$",
    "S = **C**[ϵ]/(ϵ 2 ) and T = α + x 3",
    "see ![fig](a/b.png) and ![](x.jpg) end\n---\nsecond page",
    "\\times^{S} and \\otimes^R x \\prod^{I} \\Times^{Q}",
)


def injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = F.array(*[F.lit(a) for a in ARTIFACTS])
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return docs.select("doc_id", F.concat(
        F.coalesce("text", F.lit("")), F.lit("\n"),
        F.get(pieces, (F.col("doc_id") % len(ARTIFACTS)).cast("int"))).alias("text"))


def injected_sql() -> str:
    pieces = ", ".join(map(quote, ARTIFACTS))
    return (f"SELECT doc_id, coalesce(text, '') || chr(10) || ([{pieces}])[CAST(doc_id % {len(ARTIFACTS)} AS INTEGER) + 1] AS body "
            "FROM documents")


#: Events of the driver's table as job telemetry: k is the number in props.
KINDS = {"signup": "job_started", "view": "page_completed", "click": "heartbeat", "error": "error", "purchase": "job_completed"}
TELEMETRY = """
SELECT job_id, seq, ts, ts_us, event_type,
  CASE WHEN event_type = 'job_started' THEN 40 + k % 50 END AS total_pages,
  CASE WHEN event_type = 'job_started' THEN 'balanced' END AS quality,
  CASE WHEN event_type = 'job_started' THEN CASE WHEN k % 5 = 0 THEN NULL ELSE '/out/' || job_id END END AS output_dir,
  CASE WHEN event_type IN ('page_completed', 'error') THEN k END AS page_number,
  CASE WHEN event_type = 'heartbeat' THEN k END AS current_page,
  CASE WHEN event_type = 'heartbeat' THEN CAST(k AS DOUBLE) END AS cpu_percent,
  CASE WHEN event_type = 'heartbeat' THEN k * 2 END AS memory_mb,
  CASE WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN 'error' ELSE 'warning' END END AS severity,
  CASE WHEN event_type = 'job_completed' THEN k % 7 END AS error_count,
  CASE WHEN event_type = 'job_completed' THEN k % 3 END AS warning_count
FROM (
  SELECT CAST(user_id AS {text}) AS job_id, event_id AS seq, ts, {micros}(ts) AS ts_us,
    CASE event_type WHEN 'signup' THEN 'job_started' WHEN 'view' THEN 'page_completed' WHEN 'click' THEN 'heartbeat'
      WHEN 'error' THEN 'error' ELSE 'job_completed' END AS event_type,
    CAST({number} AS INTEGER) AS k
  FROM {table}) e
"""


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    if events.schema["ts"].dataType.typeName() == "timestamp_ntz":  # read as UTC, whatever the session's zone
        events = events.withColumn("ts", F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts))"))
    return spark.sql(TELEMETRY.replace("{text}", "STRING").replace("{micros}", "unix_micros")
                     .replace("{number}", "get_json_object(props, '$.k')").replace("{table}", "{events}"), events=events)


def telemetry_sql() -> str:
    return (TELEMETRY.replace("{text}", "VARCHAR").replace("{micros}", "epoch_us")
            .replace("{number}", "json_extract_string(props, '$.k')").replace("{table}", "events"))
