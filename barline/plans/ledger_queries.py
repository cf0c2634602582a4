"""Queries of the ledger's views over relations derived from the driver's tables.

Trials are orders, campaigns their customers' nations, gates line items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.plans import ledger as lg
from barline.registry import Registry
from barline.sources import market as m

R = Registry()
BASE = """WITH trials AS (SELECT o_orderkey AS trial_id, c_nationkey AS campaign_id, floor(o_totalprice) AS score, o_orderpriority AS cell, o_orderdate AS made FROM orders JOIN customer ON o_custkey = c_custkey),
gates AS (SELECT l_orderkey AS trial_id, l_linestatus AS gate, l_linenumber AS run, max(l_quantity) >= 28 AS passed FROM lineitem GROUP BY ALL),
clusters AS (SELECT o_orderkey AS trial_id, year(o_orderdate) AS run, o_custkey % 40 AS cluster FROM orders)"""


def trials(spark: SparkSession, sf: str) -> DataFrame:
    c = m.read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("campaign_id"))
    o = m.read(spark, sf, "orders")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderkey").alias("trial_id"), "campaign_id", F.floor("o_totalprice").cast("double").alias("score"), F.col("o_orderpriority").alias("cell"), F.col("o_orderdate").alias("made"))


def gates(spark: SparkSession, sf: str) -> DataFrame:
    return m.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("trial_id"), F.col("l_linestatus").alias("gate"), F.col("l_linenumber").alias("run")).agg((F.max("l_quantity") >= 28).alias("passed"))


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    return m.read(spark, sf, "orders").select(F.col("o_orderkey").alias("trial_id"), F.year("o_orderdate").alias("run"), (F.col("o_custkey") % 40).alias("cluster"))


@R.query(BASE + ", l AS (SELECT * FROM clusters WHERE run = (SELECT max(run) FROM clusters)) SELECT campaign_id, count(*) AS n_raw, count(DISTINCT cluster) + sum((cluster IS NULL)::BIGINT)::BIGINT AS n_eff, avg(score * score) - avg(score) * avg(score) AS var_score FROM trials LEFT JOIN l USING (trial_id) GROUP BY campaign_id")
def ledger_trial_stats(spark: SparkSession, sf: str) -> DataFrame:
    return lg.trial_stats(trials(spark, sf), clusters(spark, sf))


@R.query(BASE + " SELECT trial_id, gate, run, passed FROM gates QUALIFY row_number() OVER (PARTITION BY trial_id, gate ORDER BY run DESC) = 1")
def ledger_latest_gates(spark: SparkSession, sf: str) -> DataFrame:
    return lg.latest_gates(gates(spark, sf))


@R.query(BASE + " SELECT cell, count(*) AS n, sum((NOT passed)::BIGINT)::BIGINT AS n_failed FROM trials JOIN gates USING (trial_id) GROUP BY cell HAVING 2 * sum((NOT passed)::BIGINT) > count(*)")
def ledger_starved_cells(spark: SparkSession, sf: str) -> DataFrame:
    return lg.starved_cells(trials(spark, sf), gates(spark, sf))


@R.query(BASE + " SELECT trial_id, campaign_id, EXISTS (SELECT 1 FROM gates g WHERE g.trial_id = t.trial_id AND g.gate = 'O' AND g.passed) AS passed_o, NOT EXISTS (SELECT 1 FROM gates g WHERE g.trial_id = t.trial_id) AS unmeasured FROM trials t")
def ledger_gate_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Semi and anti joins as flags: passed a gate, never measured."""
    g = gates(spark, sf).groupBy("trial_id").agg(F.coalesce(F.bool_or((F.col("gate") == "O") & F.col("passed")), F.lit(False)).alias("passed_o"))
    return trials(spark, sf).join(g, "trial_id", "left").select("trial_id", "campaign_id", F.coalesce("passed_o", F.lit(False)).alias("passed_o"), F.col("passed_o").isNull().alias("unmeasured"))


@R.query(BASE + ", e AS (SELECT campaign_id, made AS ts, 'trial' AS name, trial_id AS id FROM trials UNION ALL SELECT campaign_id, made, 'gate', trial_id FROM trials SEMI JOIN gates USING (trial_id)), n AS (SELECT *, row_number() OVER (ORDER BY ts DESC, name, id) AS place, count(*) OVER () AS total FROM e) SELECT campaign_id, ts, name, id, total FROM n WHERE place BETWEEN 101 AND 150")
def ledger_events_page(spark: SparkSession, sf: str) -> DataFrame:
    """The third page of fifty events, newest first, with the total (a page is the feature)."""
    t = trials(spark, sf)
    e = t.select("campaign_id", F.col("made").alias("ts"), F.lit("trial").alias("name"), F.col("trial_id").alias("id")).unionByName(t.join(gates(spark, sf), "trial_id", "left_semi").select("campaign_id", F.col("made").alias("ts"), F.lit("gate").alias("name"), F.col("trial_id").alias("id")))
    total = e.agg(F.count("*").alias("total"))
    return e.orderBy(F.desc("ts"), "name", "id").offset(100).limit(50).crossJoin(F.broadcast(total))


@R.query(BASE + ", b AS (SELECT campaign_id, cell, arg_max(trial_id, (score, -trial_id)) AS holder, max(score) AS best, count(*) AS n FROM trials GROUP BY ALL) SELECT campaign_id, count(*) AS n_cells, max(best) AS best, sum(n)::BIGINT AS n_trials, arg_max(holder, (best, -holder)) AS record_holder FROM b GROUP BY campaign_id")
def ledger_archive(spark: SparkSession, sf: str) -> DataFrame:
    """Best trial of each cell and of each campaign, ties to the older trial."""
    b = trials(spark, sf).groupBy("campaign_id", "cell").agg(F.max_by("trial_id", F.struct(F.col("score"), -F.col("trial_id"))).alias("holder"), F.max("score").alias("best"), F.count("*").alias("n"))
    return b.groupBy("campaign_id").agg(F.count("*").alias("n_cells"), F.max("best").alias("best"), F.sum("n").alias("n_trials"), F.max_by("holder", F.struct(F.col("best"), -F.col("holder"))).alias("record_holder"))


@R.query("""WITH c AS (SELECT c_nationkey AS campaign_id, o_orderkey AS claim_id, year(o_orderdate) * 12 + month(o_orderdate) AS first_month, year(o_orderdate) * 12 + month(o_orderdate) + 1 + o_orderkey % 3 AS end_month FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P')
SELECT a.campaign_id, a.claim_id AS a, b.claim_id AS b, least(a.end_month, b.end_month) - greatest(a.first_month, b.first_month) AS n_months FROM c a JOIN c b ON a.campaign_id = b.campaign_id AND a.claim_id < b.claim_id AND a.first_month < b.end_month AND b.first_month < a.end_month""")
def ledger_claim_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping holdout claims of a campaign.

    An order is a claim while it is in progress (status P: begun and not done), as
    the SQL beside it says; open ones (O) hold no months yet, finished ones (F) hold
    none any more.
    """
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    c = m.read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("campaign_id"))
    o = m.read(spark, sf, "orders").where("o_orderstatus = 'P'").join(c, "o_custkey").select("campaign_id", F.col("o_orderkey").alias("claim_id"), month.cast("bigint").alias("first_month"), (month + 1 + F.col("o_orderkey") % 3).cast("bigint").alias("end_month"))
    return lg.overlapping(o)


@R.query(BASE + ", s AS (SELECT campaign_id, count(*) AS n, sum((score > 150000)::BIGINT)::BIGINT AS n_high, min(made) AS first_made, max(made) AS last_made FROM trials GROUP BY campaign_id) SELECT n_name AS name, coalesce(n, 0) AS n_trials, coalesce(n_high, 0) AS n_high, first_made, last_made, n IS NULL AS idle FROM nation LEFT JOIN s ON n_nationkey = campaign_id")
def ledger_overview(spark: SparkSession, sf: str) -> DataFrame:
    s = trials(spark, sf).groupBy("campaign_id").agg(F.count("*").alias("n"), F.sum((F.col("score") > 150000).cast("bigint")).alias("n_high"), F.min("made").alias("first_made"), F.max("made").alias("last_made"))
    n = m.read(spark, sf, "nation")
    return n.join(s, n["n_nationkey"] == s["campaign_id"], "left").select(F.col("n_name").alias("name"), F.coalesce("n", F.lit(0)).alias("n_trials"), F.coalesce("n_high", F.lit(0)).alias("n_high"), "first_made", "last_made", F.col("n").isNull().alias("idle"))


@R.query(BASE + ", y AS (SELECT campaign_id, made, score, row_number() OVER (PARTITION BY campaign_id ORDER BY made, trial_id) - 1 AS ix, count(*) OVER (PARTITION BY campaign_id) AS n, max(score) OVER (PARTITION BY campaign_id ORDER BY made, trial_id ROWS UNBOUNDED PRECEDING) AS record FROM trials) SELECT campaign_id, ix, made, record FROM y WHERE ix % greatest(1, CAST(ceil(n / 100.0) AS BIGINT)) = 0")
def ledger_record_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Running record of each campaign, thinned by a stride to about a hundred points (the report's feature)."""
    w = Window.partitionBy("campaign_id").orderBy("made", "trial_id")
    y = trials(spark, sf).select("campaign_id", "made", (F.row_number().over(w) - 1).cast("bigint").alias("ix"), F.count("*").over(Window.partitionBy("campaign_id")).alias("n"), F.max("score").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("record"))
    return y.where(F.col("ix") % F.greatest(F.lit(1), F.ceil(F.col("n") / 100.0).cast("bigint")) == 0).select("campaign_id", "ix", "made", "record")


STEPS = BASE + ", steps AS (SELECT campaign_id, CASE WHEN cell LIKE '1%' AND score > 480000 THEN 'frozen' WHEN cell LIKE '2%' AND score > 490000 THEN 'burned' WHEN cell LIKE '5%' AND score > 495000 THEN 'abandoned' ELSE 'data:is_end:' || strftime(made, '%Y-%m-%d') END AS name FROM trials)"


def steps(spark: SparkSession, sf: str) -> DataFrame:
    """Events of campaigns, named by the cell and score of their trials."""
    name = F.when(F.col("cell").startswith("1") & (F.col("score") > 480000), "frozen").when(F.col("cell").startswith("2") & (F.col("score") > 490000), "burned").when(F.col("cell").startswith("5") & (F.col("score") > 495000), "abandoned")
    return trials(spark, sf).select("campaign_id", F.coalesce(name, F.concat(F.lit("data:is_end:"), F.date_format("made", "yyyy-MM-dd"))).alias("name"))


@R.query(STEPS + ", f AS (SELECT campaign_id, bool_or(name = 'frozen') AS frozen, bool_or(name = 'burned') AS burned, bool_or(name = 'abandoned') AS abandoned FROM steps GROUP BY campaign_id) SELECT n_nationkey::BIGINT AS campaign_id, CASE WHEN burned THEN 'BURNED' WHEN abandoned THEN 'ABANDONED' WHEN frozen THEN 'FROZEN' ELSE 'OPEN' END AS status FROM nation LEFT JOIN f ON campaign_id = n_nationkey")
def ledger_campaign_status(spark: SparkSession, sf: str) -> DataFrame:
    """The state that each campaign's events add up to."""
    campaigns = m.read(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("campaign_id"))
    return lg.status(campaigns, steps(spark, sf))


@R.query(STEPS + " SELECT campaign_id::BIGINT AS campaign_id, max(substr(name, -10)) AS is_end FROM steps WHERE regexp_matches(name, '^data:is_end:\\d{4}-\\d{2}-\\d{2}$') GROUP BY campaign_id")
def ledger_latest_end(spark: SparkSession, sf: str) -> DataFrame:
    return lg.latest_in_sample_end(steps(spark, sf)).select(F.col("campaign_id").cast("bigint").alias("campaign_id"), "is_end")


@R.query(BASE + " SELECT (SELECT count(*) FROM trials) AS n_trials, (SELECT count(*) FROM gates) AS n_gates, (SELECT count(*) FROM gates WHERE passed) AS n_passed, (SELECT count(DISTINCT run) FROM clusters) AS n_runs, (SELECT count(*) FROM nation) AS n_campaigns")
def ledger_snapshot_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of the ledger's relations in one row."""
    one = trials(spark, sf).agg(F.count("*").alias("n_trials"))
    g = gates(spark, sf).agg(F.count("*").alias("n_gates"), F.count_if("passed").alias("n_passed"))
    c = clusters(spark, sf).agg(F.count_distinct("run").alias("n_runs"))
    return one.crossJoin(g).crossJoin(c).crossJoin(m.read(spark, sf, "nation").agg(F.count("*").alias("n_campaigns")))  # one row each


@R.query(BASE + ", a AS (SELECT trial_id, cell || '#' || campaign_id AS name FROM trials) SELECT split_part(name, '#', 1) AS calibration, count(*) AS n_attempts, min(trial_id) AS first_trial, max(trial_id) AS last_trial FROM a WHERE starts_with(name, '1-') OR starts_with(name, '5-') GROUP BY split_part(name, '#', 1)")
def ledger_calibration_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts of calibration runs, told by the prefix of their names."""
    a = trials(spark, sf).select("trial_id", F.concat_ws("#", "cell", F.col("campaign_id").cast("string")).alias("name"))
    mine = a.where(F.col("name").startswith("1-") | F.col("name").startswith("5-"))
    return mine.groupBy(F.split_part("name", F.lit("#"), F.lit(1)).alias("calibration")).agg(F.count("*").alias("n_attempts"), F.min("trial_id").alias("first_trial"), F.max("trial_id").alias("last_trial"))


@R.query(BASE + ", p AS (SELECT trial_id, bool_or(passed) AS ok FROM gates GROUP BY trial_id), t AS (SELECT t.*, coalesce(p.ok, false) AS ok FROM trials t LEFT JOIN p USING (trial_id)) SELECT campaign_id, count(*) AS n_trials, count(*) FILTER (ok) AS n_passed, count(*) FILTER (ok) / count(*) AS efficiency, count(DISTINCT cell) FILTER (ok) AS n_cells FROM t GROUP BY campaign_id")
def ledger_engine_report(spark: SparkSession, sf: str) -> DataFrame:
    return lg.engine_report(trials(spark, sf), gates(spark, sf))


@R.query(BASE + " SELECT campaign_id, count(*) AS n, 40::BIGINT AS budget FROM trials GROUP BY campaign_id HAVING count(*) > 40")
def ledger_over_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Campaigns with more trials than their budget."""
    t = trials(spark, sf)
    return lg.over_budget(t, t.select("campaign_id").distinct().withColumn("budget", F.lit(40).cast("bigint")))


@R.query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS parent, event_type, count(*) AS n_children, min(event_id) AS first_event FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY ALL")
def ledger_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """What a migration fills in from the details of events."""
    e = m.read(spark, sf, "events").withColumn("parent", F.get_json_object("props", "$.k").cast("bigint")).where("parent IS NOT NULL")
    return e.groupBy("parent", "event_type").agg(F.count("*").alias("n_children"), F.min("event_id").alias("first_event"))
