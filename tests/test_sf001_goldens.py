"""Golden values at sf0.01 from FIXTURES.md (computed independently)."""

from synthlens.operators import fidelity
from synthlens.plans import fixtures as fx
from synthlens.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_flows_jsd(spark):
    got = {r["feature"]: r["jsd"] for r in QUERIES["jsd"](spark, SF).collect()}
    assert got == {"l_quantity": 0.00021, "l_extendedprice": 0.00022, "l_discount": 0.00002, "l_tax": 0.00005}


def test_events_jsd_purchase_vs_view(spark):
    ev = fx.table(spark, SF, "events")
    pair = fidelity.pair_by_group(ev, "event_type", "purchase", "view", ["value"])
    assert fidelity.pair_jsd(pair, ["value"]).collect()[0]["jsd"] == 0.00385


def test_vote_and_score_on_preds(spark):
    r = QUERIES["confusion_counts"](spark, SF).collect()[0]
    assert (r["tp"], r["fp"], r["fn"]) == (1084, 2269, 3849)
