import random

from barline.plans import ledger as lg
from barline.plans import ledger_queries as lq


def test_overlaps_against_brute_force(spark):
    rnd = random.Random(3)
    claims = [(c, i + 100 * c, f, f + rnd.randrange(0, 7)) for c in range(3) for i in range(40) for f in [rnd.randrange(24)]]
    got = lg.overlapping(spark.createDataFrame(claims, "campaign_id int, claim_id long, first_month long, end_month long")).collect()
    wanted = sorted((c, a, b, min(ae, be) - max(af, bf)) for c, a, af, ae in claims for d, b, bf, be in claims if c == d and a < b and min(ae, be) > max(af, bf))
    assert sorted(map(tuple, got)) == wanted and len(wanted) > 100


def test_pairs_of_claims_are_not_shuffled(spark, small):
    """Pairs grow with the square of a month's claims: they were made once a shared month and aggregated."""
    plan = lq.ledger_claim_overlaps(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
