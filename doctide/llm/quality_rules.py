"""Quality rules with thresholds that adapt to each language and source.

Two fixed base rules (too few words; too much repetition) are kept as they are.
Every other cutoff comes from mergeable quantile sketches of a document's own language
and source (``percentile_approx`` keeps Greenwald-Khanna summaries, built per task and
merged per group).  A signal's fence is ``tail + SPREAD * (tail - median)`` of its group:
``tail`` is the quantile beyond which ordinary documents are no more than a named share
of a group, so a group in which few documents carry a symbol rejects those that do, and
one whose documents carry many keeps them.  No constant stands in for a value of a
signal.  A share is a count over a length, so it must exceed its fence by ``NOISE``
standard errors of that count: one symbol in a text proves nothing.  Groups of fewer than
``min_group`` documents use the fences of their language, languages of fewer those of the
whole corpus.

Everything is DataFrame expressions: no Python runs on the executors.

Cases: a null text counts as empty; an empty text has no words and fails the base
rules; a null language or source is a group of its own; repeated rows are judged
one by one, alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctide.llm.work import Work, carried

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
#: Signal; quantiles of a group's lower and upper tail (None: that side is open); count and length that make it a share.
SIGNALS = (
    ("symbol_share", None, 0.90, ("n_symbols", "word_chars")),
    ("capital_share", None, 0.99, ("_capitals", "word_chars")),
    ("dup_line_share", None, 0.99, ("n_dup_lines", "_lines")),
    ("word_length", 0.10, 0.90, None),
)
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
ACCURACY = 10_000
MIN_GROUP = 50
SPREAD, NOISE = 1.5, 2.0
#: Groups up to this number are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 20_000


def _repeat_words() -> Column:
    """Words in windows of eight that stand in the text twice or more.

    ``_p`` holds one hash a window.  Equal neighbours after sorting (hash, place)
    are the repeated windows; the union of their eight-word spans is summed.
    """
    places = F.expr(
        "array_sort(transform(filter(_s, (x, k) -> x.h <=> get(_s, k - 1).h OR x.h <=> get(_s, k + 1).h), x -> x.i))"
    )
    cover = F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(
            (i + WINDOW).cast("long").alias("end"),
            (a["n"] + i + WINDOW - F.greatest(i.cast("long"), a["end"])).alias("n"),
        ),
        lambda a: a["n"],
    )
    return F.when(F.size("_s") > 0, cover).otherwise(F.lit(0).cast("long"))


def base_signals(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The counts that the rules use, beside the columns named in keep."""
    out = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    out = out.withColumn("_w", F.array_remove(F.split("_t", SPACE), ""))
    out = out.withColumn(
        "_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    out = out.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_t", "[^A-Z]+", "")).cast("long").alias("_capitals"),
        F.size("_l").cast("long").alias("_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_w") > WINDOW, F.transform("_w", lambda x: F.xxhash64(x)))
        .otherwise(F.array().cast("array<bigint>")).alias("_p"),
    )
    # Hashes of windows of 2, 4 and 8 words, each from two of half its length.
    for half in (1, 2, 4):
        n = F.size("_p") - half
        out = out.withColumn(
            "_p",
            F.when(
                n > 0,
                F.zip_with(
                    F.slice("_p", F.lit(1), n), F.slice("_p", F.lit(half + 1), n),
                    lambda a, b: F.xxhash64(a, b),
                ),
            ).otherwise(F.array().cast("array<bigint>")),
        )
    sortable = F.array_sort(F.transform("_p", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    out = out.withColumn(
        "_s", F.when(F.size(F.array_distinct("_p")) < F.size("_p"), sortable).otherwise(none)
    ).drop("_p")
    return out.withColumn("n_repeat_words", _repeat_words()).drop("_s")


def with_shares(df: DataFrame) -> DataFrame:
    """The signals with adaptive fences, and base_failed."""
    chars, words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    return df.select(
        "*",
        (F.col("n_symbols") / chars).alias("symbol_share"),
        (F.col("_capitals") / chars).alias("capital_share"),
        (F.col("n_dup_lines") / F.greatest("_lines", F.lit(1))).alias("dup_line_share"),
        (F.col("word_chars") / words).alias("word_length"),
        ((F.col("n_words") < MIN_WORDS)
         | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
    )


def fences(signals: DataFrame, lang: str, source: str) -> DataFrame:
    """One row of fences for each (lang, source), each lang and the whole: level 0, 1, 2.

    Documents that fail a base rule take no part.  The sketches are partial
    aggregates, so a group with a third of all rows is summed in every task.
    """
    asked = {name: [0.5, *[p for p in (low, high) if p is not None]] for name, low, high, _ in SIGNALS}
    quantiles = [F.percentile_approx(name, asked[name], ACCURACY).alias(f"_q_{name}") for name in asked]
    rows = signals.filter(~F.col("base_failed")).groupingSets(
        [[F.col(lang), F.col(source)], [F.col(lang)], []], F.col(lang), F.col(source)
    ).agg(F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("_n"), *quantiles)
    edges = []
    for name, low, high, _ in SIGNALS:
        middle = F.col(f"_q_{name}")[0]
        for side, p in (("low", low), ("high", high)):
            if p is not None:
                tail = F.col(f"_q_{name}")[asked[name].index(p)]
                edges.append((tail + F.lit(SPREAD) * (tail - middle)).alias(f"_{side}_{name}"))
    return rows.select(
        F.col(lang).alias("_lang"), F.col(source).alias("_source"),
        F.when(F.col("_gid") == 0, 0).when(F.col("_gid") == 1, 1).otherwise(2).alias("_level"),
        "_n", F.struct(*edges).alias("_edges"),
    )


def judge(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
          keep: tuple[str, ...] = ("doc_id",), min_group: int = MIN_GROUP) -> DataFrame:
    """keep's columns, the signals, base_failed and the verdict kept (boolean).

    The signals are computed once and written; sketches and verdicts read them back.
    """
    spark = df.sparkSession
    work = Work(spark, "quality-rules")
    source_rows = df.select(carried(keep), F.col(lang).cast("string").alias("_lang"),
                            F.col(source).cast("string").alias("_source"), F.col(text).alias("_text"))
    signals = work.put(
        with_shares(base_signals(source_rows, "_text", ("_keep", "_lang", "_source"))), "signals")
    made = work.put(fences(signals, "_lang", "_source"), "fences")
    sized = made.filter((F.col("_n") >= min_group) | (F.col("_level") == 2))
    few = made.count() <= BROADCAST_GROUPS
    out = signals
    for level, keys in enumerate((("_lang", "_source"), ("_lang",))):
        side = sized.filter(F.col("_level") == level).select(
            *[F.col(k).alias(f"{k}_{level}") for k in keys], F.col("_edges").alias(f"_e{level}"))
        side = F.broadcast(side) if few else side
        on = [F.col(k).eqNullSafe(F.col(f"{k}_{level}")) for k in keys]
        out = out.join(side, on, "left").drop(*[f"{k}_{level}" for k in keys])
    whole = sized.filter(F.col("_level") == 2).select("_edges").first()
    kind = made.schema["_edges"].dataType.simpleString()
    values = whole["_edges"].asDict() if whole and whole["_edges"] else {}
    out = out.withColumn("_e2", F.struct(
        *[F.lit(values.get(f.name)).cast("double").alias(f.name) for f in made.schema["_edges"].dataType]
    ).cast(kind))
    edge = F.coalesce("_e0", "_e1", "_e2")
    beyond = F.lit(False)
    for name, low, high, made_of in SIGNALS:
        if low is not None:
            beyond = beyond | F.coalesce(F.col(name) < edge[f"_low_{name}"], F.lit(False))
        if high is not None:
            over = F.col(name) > edge[f"_high_{name}"]
            if made_of:
                count, length = F.col(made_of[0]).cast("double"), F.col(made_of[1]).cast("double")
                over = count - edge[f"_high_{name}"] * length > F.lit(NOISE) * F.sqrt(count)
            beyond = beyond | F.coalesce(over, F.lit(False))
    out = out.withColumn("kept", ~F.col("base_failed") & ~beyond).drop(
        "_lang", "_source", "_e0", "_e1", "_e2", "_capitals", "_lines")
    return out.select("_keep.*", *[c for c in out.columns if c != "_keep"])
