"""op3's query against a DuckDB statement that counts every window of 200 bytes by its MD5."""

import random
from collections import Counter

import brute
import duckdb

from doctide.llm import suffix_dedup
from doctide.llm.queries import QUERIES

# texts as hexadecimal pieces of 500 windows, as substr takes characters and walks from the start
STATEMENT = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, n, o, substr(h, (2 * o + 1)::BIGINT, 1398) AS piece
      FROM (SELECT r, h, length(h) // 2 AS n, unnest(range(0, length(h) // 2, 500)) AS o FROM d)),
w AS (SELECT r, o + i AS s, md5_number(substr(piece, (2 * i + 1)::BIGINT, 400)) AS k
      FROM (SELECT *, unnest(range(0, 500)) AS i FROM p) WHERE o + i + 200 <= n),
hit AS (SELECT r, s FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
mark AS (SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + 200 THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s ROWS UNBOUNDED PRECEDING) AS g FROM mark),
span AS (SELECT r, min(s) AS a, max(s) + 200 AS b FROM run GROUP BY r, g),
gap AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS f, a AS t FROM span
        UNION ALL SELECT d.r, coalesce(max(b), 0), any_value(length(h) // 2) FROM d LEFT JOIN span ON d.r = span.r GROUP BY d.r),
kept AS (SELECT d.r, string_agg(substr(h, (2 * f + 1)::BIGINT, (2 * (t - f))::BIGINT), '' ORDER BY f) AS k
         FROM d JOIN gap ON d.r = gap.r GROUP BY d.r),
spans AS (SELECT r, count(*) AS n FROM span GROUP BY r)
SELECT doc_id, length(h) // 2, (length(h) - length(k)) // 2, coalesce(n, 0), sha256(unhex(k))
FROM d JOIN kept USING (r) LEFT JOIN spans USING (r)
"""


def _odd():
    """Windows across the ends of a scan, periods, Thue-Morse words, lengths around the least, repeated and null ids."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklmnoé日😀") for _ in range(rnd.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, thue = prose(60), "".join("ab"[k.bit_count() & 1] for k in range(2048))
    texts = brute.texts()[:20] + [thue, thue.translate(str.maketrans("ab", "ba")), thue[:900] + prose(9)]
    for shift in (-250, -199, 0):
        texts.append(prose(42000).encode()[:suffix_dedup.CHUNK + shift].decode("utf-8", "ignore") + passage + prose(60))
    for period in (1, 40, 161, 200, 201):
        texts += [(prose(99)[:period] * 400)[:900] + prose(9), prose(5) + (prose(99)[:period] * 400)[:420]]
    for n in (199, 200, 201, 208, 361):
        shared = "".join(rnd.choice("xyz") for _ in range(n))
        texts += [prose(8) + "<" + shared + ">" + prose(8), prose(8) + "[" + shared + "]" + prose(8)]
    for _ in range(20):
        at = rnd.randrange(len(passage))
        texts.append(prose(3) + passage[:at] + "#" + passage[at + 1:])
    rows = [(None if k % 11 == 5 else 7 if k % 13 == 6 else k, t) for k, t in enumerate(texts)]
    return rows + [rows[3], rows[16], (None, rows[17][1])]


def test_suffix_query_against_sql(spark, tmp_path):
    spark.createDataFrame(_odd(), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = Counter(con.execute(STATEMENT).fetchall())
    got = Counter(tuple(r) for r in QUERIES["op3_suffix_dedup"](spark, str(tmp_path)).collect())
    assert sum(x[3] > 0 for x in want) > 30 and sum(x[1] > suffix_dedup.CHUNK for x in want) >= 3
    assert (want - got, got - want) == (Counter(), Counter())
