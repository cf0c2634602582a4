"""Association rules count every labelled page."""

import pytest

pytest.importorskip("barline.llm")
from pyspark.sql import functions as F  # noqa: E402

from barline.llm import queries, url_rules  # noqa: E402


def test_op5_mines_all_labelled_pages(spark, tmp_path, monkeypatch):
    n = 101_000
    ids = spark.range(n)
    ids.select(F.col("id").alias("page_id"), F.format_string("https://h%d.example.org/a", F.col("id") % 5).alias("url")).write.parquet(f"{tmp_path}/pages.parquet")
    ids.select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 == 0, 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    mined, seen = url_rules.mine_rules, []
    monkeypatch.setattr(url_rules, "mine_rules", lambda rows: seen.append(rows.count()) or mined(rows))
    out = queries.op5_url_association(spark, str(tmp_path))
    assert seen == [n]
    assert {(r.host, r.verdict) for r in out.select("host", "verdict").distinct().collect()} == {(f"h{k}.example.org", "allow" if k else "block") for k in range(5)}
