"""Queries that stand for a whole job take in every row that the job has."""

from pyspark.sql import functions as F

from tidemark.plans import registry
from tidemark.sources import adapters as A


def test_all_trades_get_a_pool(spark, sf_dir):
    got = registry.ALL["c17_historical_wallet_trades"][0](spark, sf_dir)
    assert got.count() == A.trades(spark, sf_dir).count()


def test_pools_with_purchases_have_flow(spark, sf_dir):
    bought = A.price_observations(spark, sf_dir).where("event_type = 'purchase'").select("pool").distinct()
    seeds = registry.ALL["h10_decision_seed"][0](spark, sf_dir).join(bought, "pool")
    assert seeds.count() and not seeds.where(F.col("missing").contains("flow")).count()
