"""Cutoffs chosen from lenient to strict stop before the first that rejects too many good rows."""

import math

import pytest

from murmura.llm import quality_rules as rules


def plain_tail(k, n, p):
    return math.fsum(math.comb(n, j) * p ** j * (1 - p) ** (n - j) for j in range(k + 1))


def plain_cutoffs(values, cuts, alpha, delta, tests):
    chosen = None
    for cut in cuts:
        if plain_tail(sum(v > cut for v in values), len(values), alpha) > delta / tests:
            break
        chosen = cut
    return chosen


@pytest.mark.parametrize("share", [0.0, 0.001, 0.02])
def test_the_strictest_cutoff_before_the_first_failure(spark, share):
    cuts = {"rate": [1.0, 0.5, 0.2, 0.1]}
    high = int(2000 * share)
    values = [0.3] * high + [0.05 + 0.1 * (i % 10 == 0) for i in range(2000 - high)]
    rows = [(lang, 1, v) for lang in ("en", None) for v in values] + [("en", 0, 0.9)] * 500
    labelled = spark.createDataFrame(rows, "lang string, quality int, rate double")
    got = {(r.stratum, r.rule): r.cutoff
           for r in rules.choose_cutoffs(labelled, 0.01, 0.05, cuts).collect()}
    want = plain_cutoffs(values, cuts["rate"], 0.01, 0.05, 2)
    assert want == (0.5 if share == 0.02 else 0.2)
    assert got == {("en", "rate"): want, ("", "rate"): want}


def test_no_labels_and_few_labels_choose_nothing(spark):
    cuts = {"rate": [1.0, 0.5]}
    schema = "lang string, quality int, rate double"
    for rows in ([], [("en", 1, 0.0)] * 20, [("en", 0, 2.0)] * 5000):
        assert rules.choose_cutoffs(spark.createDataFrame(rows, schema), 0.01, 0.05, cuts).isEmpty()


def test_values_at_a_cutoff_are_kept(spark):
    rows = spark.createDataFrame([("en", 0.5, False), ("en", 0.51, False), (None, 0.9, False),
                                  ("en", 0.1, True)], "lang string, rate double, base_failed boolean")
    cutoffs = spark.createDataFrame([("en", "rate", 0.5)], "stratum string, rule string, cutoff double")
    got = {(r.lang, r.rate): (r.kept, r.failed_rules)
           for r in rules.apply_rules(rows, cutoffs, ["rate"]).collect()}
    assert got == {("en", 0.5): (True, []), ("en", 0.51): (False, ["rate"]), (None, 0.9): (True, []),
                   ("en", 0.1): (False, [])}
