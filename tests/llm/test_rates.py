"""The estimate of the quality rules: against a plain version, on skewed corpora, and what it decides on documents."""

import math
import os

import pytest
from pyspark.sql import Row

from presetlake.llm import quality

#: Most frequent vote patterns of the documents at sf0.1.
COUNTS = {
    "111111111": 6920, "-11111111": 643, "11111-111": 269, "1-0011111": 240, "110011110": 176, "01111-111": 176, "011111111": 159, "11111--11": 156, "-1111-111": 141, "11110-011": 136,
    "111010000": 102, "1-1010000": 71, "1111-1011": 69, "1-00-1111": 63, "11101-000": 57, "1-101-000": 49, "111110011": 47, "110011-10": 45, "1100-1110": 40, "-100-1110": 28,
    "111011000": 28, "111111-11": 25, "-1110-011": 17, "--00-1111": 16, "01111-1-1": 16, "1-1011000": 15, "11001--10": 15, "-11110011": 15, "-1111-011": 14, "111110-11": 13,
}


def plain_estimate(patterns):
    """EM document by document, with the same start and the same hold on each rule's sense."""
    docs = [p for p, n in patterns.items() for _ in range(n)]
    start = {(g, v): quality.START[g]["01-".index(v)] for g in (0, 1) for v in "01-"}
    rates = {(g, r, v): start[g, v] for g in (0, 1) for r in range(9) for v in "01-"}
    prior = 0.9
    for _ in range(500):
        posts = [plain_posterior(prior, rates, d) for d in docs]
        each = {1: math.fsum(posts), 0: math.fsum(1 - p for p in posts)}
        fresh = {}
        for r in range(9):
            for g in (0, 1):
                for v in "01-":
                    mass = math.fsum((p if g else 1 - p) for p, d in zip(posts, docs) if d[r] == v)
                    held = 0.01 * each[g] + 1
                    fresh[g, r, v] = (mass + held * start[g, v]) / (each[g] + held)
            for v, wrong in (("0", fresh[0, r, "0"] < fresh[1, r, "0"]), ("1", fresh[0, r, "1"] > fresh[1, r, "1"])):
                if wrong:
                    fresh[0, r, v] = fresh[1, r, v] = (each[0] * fresh[0, r, v] + each[1] * fresh[1, r, v]) / len(docs)
            for g in (0, 1):
                fresh[g, r, "-"] = max(1 - fresh[g, r, "0"] - fresh[g, r, "1"], 1e-9)
        moved = max(abs(fresh[k] - rates[k]) for k in rates)
        rates, prior = fresh, (each[1] + 0.9) / (len(docs) + 1)
        if moved < 1e-12:
            break
    return prior, rates


def plain_posterior(prior, rates, pattern):
    odds = prior / (1 - prior)
    for r, v in enumerate(pattern):
        odds *= rates[1, r, v] / rates[0, r, v]
    return odds / (1 + odds)


@pytest.mark.parametrize("patterns", [{p: n // 40 + 1 for p, n in COUNTS.items()}, {"111111111": 40, "011111111": 20, "0-0------": 7}, {"0" * 9: 5}, {"---------": 3}])
def test_estimate_and_posterior_are_those_of_a_plain_version(spark, patterns):
    prior, rates = plain_estimate(patterns)
    model = quality.estimate(patterns)
    assert abs(model.prior - prior) < 1e-9
    for p in patterns:
        want = plain_posterior(prior, rates, p)
        assert abs(1 / (1 + math.exp(-model.odds(p))) - want) < 1e-9


def shaped(pattern):
    """Measures of 100 words, or other numbers where the length says so, that give the pattern."""
    n = {"1": 200, "-": 80, "0": 40}[pattern[0]]
    pick = lambda r, bad, good, silent: {"0": bad, "1": good, "-": silent}[pattern[r]]
    return Row(
        n_words=n, word_chars=int(n * pick(1, 16, 5, 8)), n_symbols=int(n * pick(2, 0.5, 0, 0.05)), n_plain=int(n * pick(3, 0.2, 1, 0.8)), n_lines=10, n_ended=pick(4, 1, 10, 6),
        n_dup_lines=pick(5, 5, 0, 1), n_repeat_words=int(n * pick(6, 0.3, 0, 0.1)), n_upper=int(5 * n * pick(7, 0.5, 0, 0.2)), n_letters=5 * n, n_marks=int(n * pick(8, 0.5, 0, 0.05)),
    )


def judged(spark, model, patterns):
    rows = spark.createDataFrame([Row(m=shaped(p)) for p in patterns]).select(quality.votes("m").alias("v"), quality.posterior(model).alias("p")).collect()
    assert {r.v for r in rows} == set(patterns)
    return {r.v: r.p for r in rows}


def test_posteriors_of_columns_are_the_models(spark):
    patterns = ["111111111", "-1-1-1-1-", "0--------", "010101010", *list(COUNTS)[:12]]
    model = quality.estimate(COUNTS)
    for p, got in judged(spark, model, patterns).items():
        assert abs(got - 1 / (1 + math.exp(-model.odds(p)))) < 1e-9


@pytest.mark.parametrize("share", [0.1, 0.3])
@pytest.mark.parametrize("rule", range(9))
def test_one_bad_vote_of_many_clean_documents_does_not_reject(rule, share):
    clean = "1" * 9
    trips = clean[:rule] + "0" + clean[rule + 1 :]
    moved = int(COUNTS[clean] * share)
    model = quality.estimate(COUNTS | {clean: COUNTS[clean] - moved, trips: COUNTS.get(trips, 0) + moved})
    assert model.odds(clean) > 0 and model.odds(trips) > 0
    assert all(model.odds(p) < 0 for p in ("110011110", "111010000"))  # three bad votes and more


def test_votes_and_not_rules_passed_decide():
    """One vote for bad, or two, may be outvoted; a document that no rule calls bad may go."""
    model = quality.estimate(COUNTS)
    assert model.odds("1111-1011") > 0 and model.odds("111110011") > 0 and model.odds("11110-011") > 0
    silent = quality.estimate({"1" * 9: 800, "1-------1": 100, "1-0-----1": 60, "1--0----1": 60})
    assert silent.odds("1-------1") < 0 < silent.odds("110111111")


def test_rules_keep_their_sense():
    for patterns in (COUNTS, {"1" * 9: 500, "111111011": 500}, {"0" * 9: 10, "1" * 9: 1}):
        rates = quality.estimate(patterns).rates
        assert (rates[0, :, 0] >= rates[1, :, 0] - 1e-9).all() and (rates[0, :, 1] <= rates[1, :, 1] + 1e-9).all()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_kept_documents_with_bad_votes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = [r for r in quality.judge(docs.select("doc_id", quality.measures(docs).alias("m"))).collect() if not r.base_failed]
    kept = [r.votes.count("0") for r in rows if r.kept]
    assert sum(n == 1 for n in kept) > 10 and sum(n == 2 for n in kept) > 1
    assert all(r.kept == (r.posterior >= 0.5) for r in rows) and any(not r.kept for r in rows)
