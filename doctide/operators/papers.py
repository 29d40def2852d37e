"""Papers: slugs, registry look-ups, job names, frontmatter, keywords."""

from __future__ import annotations

import json
import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that no slug takes from a title.
STOP_WORDS = ("a", "an", "the", "of", "on", "in", "to", "for", "and", "or", "with", "by", "from", "as", "is", "are", "was", "were",
              "introduction", "notes", "lecture", "lectures", "course", "some", "new", "old", "more", "further")
#: Named fields of the frontmatter in their order, and what they are if nothing is said.
FIELDS = {
    "paper_slug": None, "title": "", "authors": [], "year": None, "journal": None, "arxiv_id": None, "doi": None,
    "source_file": "", "transcribed_at": "", "transcriber_version": "1.0.0", "format": "markdown", "quality": "balanced",
    "total_pages": 0, "transcribed_pages": 0, "keywords": [], "sections": [],
}


def _fold(text: str | None) -> str | None:
    return None if text is None else unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii")


def fold_ascii(text: Column) -> Column:
    """NFKD without what is not ASCII; only such texts leave the JVM."""
    plain = ~text.rlike(r"[^\x00-\x7F]")
    return F.when(plain, text).otherwise(F.udf(_fold, "string", useArrow=True)(F.when(~plain, text)))


def kebab(text: Column) -> Column:
    """ASCII kebab case, split at changes of case."""
    out = F.regexp_replace(fold_ascii(text), "([A-Z]+)([A-Z][a-z])", "$1-$2")
    out = F.lower(F.regexp_replace(out, "([a-z0-9])([A-Z])", "$1-$2"))
    return F.regexp_replace(F.regexp_replace(out, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def key_words(title: Column, most: int = 3) -> Column:
    words = F.filter(F.split(kebab(title), "-"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    return F.slice(words, 1, most)


def last_name(author: Column) -> Column:
    a = F.regexp_replace(author, r"(?U)^\s+|\s+$", "")
    return F.lower(F.when(F.contains(a, F.lit(",")), F.substring_index(a, ",", 1)).otherwise(F.element_at(F.split(a, r"(?U)\s+"), -1)))


def base_slug(title: Column, authors: Column) -> Column:
    first, second = last_name(F.get(authors, F.lit(0))), last_name(F.get(authors, F.lit(1)))
    n = F.coalesce(F.size(authors), F.lit(0))
    part = F.when(n <= 0, "unknown").when(n == 1, first).when(n == 2, F.concat(first, F.lit("-"), second)).otherwise(F.concat(first, F.lit("-et-al")))
    words = key_words(title)
    return F.concat(kebab(part), F.lit("-"), F.when(F.size(words) > 0, F.array_join(words, "-")).otherwise("untitled"))


def generate_slugs(papers: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """papers (paper_id, title, authors, year) with slug: the first of base, base-year, base-2 .. base-99 that is free.

    Null where all are taken.  Candidates of taken bases only are spread out and compared.
    """
    out = papers.withColumn("base", base_slug(F.col("title"), F.col("authors")))
    if existing is None:
        return out.withColumn("slug", F.col("base"))
    taken = existing.select(F.col("slug").alias("base")).distinct()
    clash = out.join(taken, "base", "left_semi")
    others = F.transform(F.sequence(F.lit(2), F.lit(99)), lambda i: F.concat(F.col("base"), F.lit("-"), i.cast("string")))
    with_year = F.when(F.col("year").isNotNull() & (F.col("year") != 0), F.array(F.concat("base", F.lit("-"), F.col("year").cast("string")))).otherwise(
        F.array().cast("array<string>"))
    free = (clash.select("paper_id", F.posexplode(F.concat(with_year, others)).alias("k", "slug"))
            .join(existing.select("slug").distinct(), "slug", "left_anti")
            .groupBy("paper_id").agg(F.min_by("slug", "k").alias("_slug")))
    return (out.join(taken.withColumn("_taken", F.lit(True)), "base", "left").join(free, "paper_id", "left")
            .withColumn("slug", F.when(F.col("_taken"), F.col("_slug")).otherwise(F.col("base"))).drop("_taken", "_slug"))


def find_aliases(names: DataFrame, registry: DataFrame, name: str = "name") -> DataFrame:
    """names with the slug they stand for: equal to it or to an alias, in any case; the first entry (ord) wins, its slug before its aliases."""
    keys = registry.select("slug", "ord", F.lower("slug").alias("_key"), F.lit(0).alias("_k")).union(
        registry.select("slug", "ord", F.explode("aliases").alias("_key"), F.lit(1).alias("_k")).withColumn("_key", F.lower("_key")))
    first = keys.groupBy("_key").agg(F.min_by("slug", F.struct("ord", "_k")).alias("slug"))
    return names.withColumn("_key", F.lower(name)).join(first, "_key", "left").drop("_key")


def register(registry: DataFrame, entries: DataFrame) -> DataFrame:
    """Registry with entries added or put in the place of those of the same slug."""
    return registry.join(entries.select("slug"), "slug", "left_anti").unionByName(entries, allowMissingColumns=True)


# -- the three ways of naming a job ---------------------------------------------


def job_name_cleanup(name: Column) -> Column:
    out = F.regexp_replace(F.lower(name), r"[()\[\]{}\"']", "")
    return F.regexp_replace(F.regexp_replace(F.translate(out, " _", "--"), "-{2,}", "-"), "^-+|-+$", "")


def job_name_service(stem: Column) -> Column:
    return F.translate(F.lower(stem), " .", "--")


def job_name_command(stem: Column) -> Column:
    return stem


# -- frontmatter -------------------------------------------------------------------

BLOCK = re.compile(r"^---\s*\n(.*?)\n---\s*\n(.*)$", re.DOTALL)


def _flat_yaml(text: str):
    """Scalars and lists of scalars by key, for machines without a YAML library."""
    out: dict = {}
    key = None
    for line in text.split("\n"):
        if item := re.match(r"\s*-\s+(.*)$", line):
            if key is None:
                return None
            if not isinstance(out.get(key), list):
                out[key] = []
            out[key].append(_scalar(item[1]))
        elif pair := re.match(r"([A-Za-z_][\w-]*):\s*(.*)$", line):
            key = pair[1]
            out[key] = [] if pair[2] == "[]" else _scalar(pair[2]) if pair[2] else None
        elif line.strip():
            return None
    return out


def _scalar(text: str):
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    return {"true": True, "false": False, "null": None, "~": None}.get(text, text)


def _load(text: str):
    try:
        import yaml
    except ImportError:
        return _flat_yaml(text)
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError:
        return None


def _dump(data: dict) -> str:
    try:
        import yaml

        return yaml.dump(data, default_flow_style=False, sort_keys=False, allow_unicode=True, width=80)
    except ImportError:
        rows = []
        for k, v in data.items():
            rows += [f"{k}: []"] if v == [] else [f"{k}:", *(f"- {x}" for x in v)] if isinstance(v, list) else [f"{k}: {v}"]
        return "\n".join(rows) + "\n"


def split_frontmatter(text: str | None) -> tuple[dict | None, str]:
    """(fields, body); no fields where there is no block or it is no mapping."""
    match = BLOCK.match(text or "")
    data = _load(match[1]) if match else None
    return (data, match[2]) if isinstance(data, dict) else (None, text or "")


def write_frontmatter(fields: dict, body: str) -> str:
    """Named fields with their defaults, without nulls and empty texts; then the others, which win."""
    known = {k: fields.get(k, value) for k, value in FIELDS.items()}
    kept = {k: v for k, v in known.items() if v is not None and v != ""}
    return f"---\n{_dump(kept | {k: v for k, v in fields.items() if k not in FIELDS})}---\n\n{body}"


def parse_frontmatter(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, fields (JSON, null without a block), body."""
    def parse(t):
        fields, body = split_frontmatter(t)
        return (None if fields is None else json.dumps(fields, ensure_ascii=False, default=str), body)

    run = F.udf(parse, "struct<fields:string,body:string>", useArrow=True)
    plain = F.struct(F.lit(None).cast("string").alias("fields"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    has = F.col(text).startswith("---")
    return df.select(id_col, F.when(F.coalesce(has, F.lit(False)), run(F.when(has, F.col(text)))).otherwise(plain).alias("_p")).select(id_col, "_p.fields", "_p.body")


def update_frontmatter(df: DataFrame, updates: dict, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    def update(t):
        fields, body = split_frontmatter(t)
        return write_frontmatter((fields or {"title": "Unknown"}) | updates, body)

    return df.select(id_col, F.udf(update, "string", useArrow=True)(F.col(text)).alias("text"))


def add_keywords(existing: Column, new: Column) -> Column:
    """New ones that were not there are appended; repeats among the new stay."""
    return F.concat(existing, F.filter(new, lambda k: ~F.array_contains(existing, k)))


def remove_keywords(existing: Column, gone: Column) -> Column:
    return F.filter(existing, lambda k: ~F.array_contains(gone, k))


def initial_metadata(**known) -> dict:
    """Fields of a new document; names that are no field are kept after them."""
    return {k: known[k] for k in FIELDS if k in known} | {k: v for k, v in known.items() if k not in FIELDS}
