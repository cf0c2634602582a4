"""op8 against alignments by shared runs of words in SQL, and its sums against loops."""

import random

import pytest
from pyspark.sql import functions as F

duckdb = pytest.importorskip("duckdb")
pytest.importorskip("barline.llm.decontamination")
from barline.llm import decontamination as dc  # noqa: E402
from barline.llm import queries as q  # noqa: E402

#: Of 13 words with two substitutions some four in a row agree, and items here have 13 words at least: shared runs of four words give
#: every alignment, each of which is then compared word by word.
SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM benchmark),
dr AS (SELECT doc_id, i, array_to_string(ws[i:i + 3], ' ') AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 2)) AS i FROM d)),
br AS (SELECT item_id, i, array_to_string(ws[i:i + 3], ' ') AS run FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 2)) AS i FROM b)),
al AS (SELECT DISTINCT doc_id, item_id, dr.i - br.i AS shift FROM dr JOIN br USING (run)),
eq AS (SELECT doc_id, item_id, len(b.ws) AS n, [(CASE WHEN k + shift BETWEEN 1 AND len(d.ws) AND d.ws[k + shift] = b.ws[k] THEN 1 ELSE 0 END) for k in range(1, len(b.ws) + 1)] AS same FROM al JOIN d USING (doc_id) JOIN b USING (item_id)),
mx AS (SELECT doc_id, item_id, list_max([list_sum(same[k:k + 12]) for k in range(1, n - 11)])::BIGINT AS words FROM eq),
v AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS item_ids, max(words) AS most_words FROM mx WHERE words >= 11 GROUP BY doc_id)
SELECT doc_id, item_ids, coalesce(most_words, 0) AS most_words FROM d LEFT JOIN v USING (doc_id)"""


def test_query_equals_sql(spark, small):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    assert min(r[0] for r in con.execute(r"SELECT len(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}]+'), lambda w: w <> '')) FROM benchmark").fetchall()) >= 13
    want = sorted((i, tuple(x or ()), n) for i, x, n in con.execute(SQL).fetchall())
    got = q.op8_spaced_seed_decontamination(spark, small).collect()
    assert sorted((r.doc_id, tuple(r.item_ids), r.most_words) for r in got) == want
    assert all(r.contaminated == (len(r.item_ids) > 0) and r.kept != r.contaminated and r.n_items == len(r.item_ids) for r in got)
    assert any(r.contaminated for r in got)


def test_sliding_sums(spark):
    rng = random.Random(4)
    rows = [([rng.randint(0, 1) for _ in range(n)],) for n in (1, 2, 5, 12, 13, 14, 300, 20_000)]
    d = spark.createDataFrame(rows, "same array<int>")
    for width in (1, 5, 13):
        got = [r[0] for r in d.select(dc._most_within("same", F.least(F.lit(width), F.size("same")))).collect()]
        want = []
        for (x,) in rows:
            k = min(width, len(x))
            want.append(max(sum(x[i:i + k]) for i in range(len(x) - k + 1)))
        assert got == want
