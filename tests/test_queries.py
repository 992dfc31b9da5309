"""Every query of the library outside llm, against DuckDB where SQL expresses it."""

import pytest
from tests.conftest import SF
from tests.oracle import assert_same
from tidemark import plans

ORACLE = plans.oracle_sql()


#: What must hold of each query without SQL; its values are tested on small cases in test_operators.
CHECKS = {
    "b13_tobit": lambda r: sorted(x.flag for x in r) == ["left", "none", "right"] and all(x.squared == 0 for x in r if x.flag != "none"),
    "g3_lsh_recall": lambda r: len({x.query_id for x in r}) * 16 == len(r) and all(x.query_id % 50 == 0 and x.query_id != x.memory_id for x in r),
    "g3_cell_index": lambda r: len({x.query_id for x in r}) * 16 == len(r) and all(x.query_id % 50 == 0 and x.query_id != x.memory_id for x in r),
    "j2_whitening": lambda r: all(len(x.whitened) == 8 for x in r),
    "j3_ridge": lambda r: [x.name for x in r] == ["intercept", "gate", "loss_base"] and abs(r[2].value - 1) < 0.2,
    "j4_forest": lambda r: all(0 < x.forest_pred < 1.5 for x in r),
    "j10_backbones_with_forest": lambda r: {(x.method, x.role, x.near_forest) for x in r} == {("rival", "A", True), ("constant", "rejected", False)},
    "k20_refitted_ablations": lambda r: {x.method for x in r} == {"whole", "without_gate", "without_loss_base"} and len({x.loss for x in r}) > 1 and len({x.n for x in r}) == 1,
    "j5_logistic_gate": lambda r: {x.name for x in r} == {"gate", "loss_base", "intercept"} and next(x.value for x in r if x.name == "gate") > 0,
    "j11_mandatory_baselines": lambda r: sum(x.method == "mean" for x in r) == sum(x.method == "forest" for x in r) > 0,
    "k7_bootstrap_ci": lambda r: len(r) == 5 and all(x.low < x["mean"] < x.high for x in r),
    "k7_bootstrap_median": lambda r: len(r) == 5 and all(x.low <= x["median"] <= x.high for x in r),
    "j9_coefficient_report": lambda r: {x.name for x in r} == {"gate", "loss_base", "intercept"} and all(x.low < x.value < x.high for x in r) and not next(x.flipped for x in r if x.name == "gate"),
    "k8_auroc_diff": lambda r: r[0].low < r[0].difference < r[0].high and r[0].replicates == 1000,
    "k12_h1_verdict": lambda r: len(r) == 3 and None not in {x.passed for x in r},
    "k14_h2_verdict": lambda r: len(r) == 4 and None not in {x.passed for x in r},
    "k15_h3_verdict": lambda r: len(r) == 3 and None not in {x.passed for x in r},
    "l5_fixed_sequence": lambda r: len(r) == 1 and (r[0].lam is None) == (r[0].passed == 0),
    "l10_safe_coverage": lambda r: 0 <= r[0].safe_coverage <= 1,
    "l12_entity_safe_coverage": lambda r: len(r) == 5 and all(0 <= x.safe_coverage <= 1 for x in r),
}


def test_every_query_without_sql_has_a_check():
    assert set(CHECKS) == set(plans.queries()) - set(ORACLE)


@pytest.mark.parametrize("name", sorted(set(plans.queries())))
def test_query(spark, name):
    df = plans.queries()[name](spark, SF)
    if name in ORACLE:
        assert_same(df, ORACLE[name], SF)
    else:
        assert CHECKS[name](df.collect())


def test_similar_pairs_against_all_pairs(spark):
    from tidemark.operators.families import similar_pairs
    from tidemark.plans.leakage import sets

    rows = {r.node: frozenset(r["items"]) for r in sets(spark, SF).collect()}
    got = {(r.a, r.b) for r in similar_pairs(sets(spark, SF), 0.7, seen=2).collect()}
    least = {}
    for k, s in sorted(rows.items()):
        least.setdefault(s, k)
    want = {(least[s], k) for k, s in rows.items() if s and least[s] != k}
    reps = sorted((k, s) for s, k in least.items() if s)
    want |= {(a, b) for a, x in reps for b, y in reps if a < b and len(x & y) >= 0.7 * len(x | y)}
    assert got == want
