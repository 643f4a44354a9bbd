import math

import pytest
from pyspark.sql import functions as F

from promptforge.operators import scores, select
from tests import models

SCHEMA = "prompt_id long, iter int, cand_pos int, revised_prompt string, tifa double, vqa double"


def _run(spark, rows, prompts=None):
    df = scores.candidate_scores(spark.createDataFrame(rows, SCHEMA))
    ib = select.iteration_best(df)
    pr = spark.createDataFrame([(p,) for p in (prompts or [])], "prompt_id long") if prompts else None
    return ib, select.best_paraphrase(ib, pr)


def test_first_candidate_wins_inside_iteration_last_iteration_wins_across(spark):
    rows = [(1, 0, 0, "a", 0.5, 0.5), (1, 0, 1, "b", 0.5, 0.5),   # tie inside iteration 0 -> a
            (1, 1, 0, "c", 0.25, 0.75), (1, 1, 1, "d", 1.0, 0.0)]  # tie with iteration 0 -> iteration 1, c
    ib, best = _run(spark, rows)
    got = {(r.iter): r.best_paraphrase for r in ib.collect()}
    assert got == {0: "a", 1: "c"}
    b = best.collect()[0]
    assert (b.best_iter, b.best_paraphrase) == (1, "c")
    assert models.best_over_iterations([[("a", 1.0), ("b", 1.0)], [("c", 1.0), ("d", 1.0)]]) == (1, "c")


def test_maxima_are_independent_per_metric(spark):
    rows = [(1, 0, 0, "a", 1.0, 0.0), (1, 0, 1, "b", 0.0, 0.9)]
    ib, _ = _run(spark, rows)
    r = ib.collect()[0]
    assert (r.best_tifa, r.best_vqa, r.best_sum, r.best_paraphrase) == (1.0, 0.9, 1.0, "a")


def test_nan_iteration_never_wins_and_zero_candidates_default(spark):
    rows = [(1, 0, 0, "a", 0.2, 0.2), (1, 1, 0, "b", float("nan"), 0.9), (1, 1, 1, "c", 0.9, 0.9)]
    ib, best = _run(spark, rows, prompts=[1, 2])
    it1 = [r for r in ib.collect() if r.iter == 1][0]
    assert math.isnan(it1.best_sum) and it1.best_paraphrase == "b"  # numpy argmax picks the first NaN
    got = {r.prompt_id: (r.best_iter, r.best_paraphrase) for r in best.collect()}
    assert got == {1: (0, "a"), 2: (-1, "")}
    assert models.best_over_iterations([[("a", 0.4)], [("b", float("nan")), ("c", 1.8)]]) == (0, "a")


def test_iteration_lists_and_running_best(spark):
    rows = [(1, 2, 0, "z", 0.1, 0.1), (1, 0, 0, "x", 0.5, 0.5), (1, 1, 0, "y", 0.5, 0.5)]
    df = scores.candidate_scores(spark.createDataFrame(rows, SCHEMA))
    ib = select.iteration_best(df)
    lists = select.iteration_lists(ib).collect()[0]
    assert lists.best_paraphrase_at_each_iter == ["x", "y", "z"]
    assert lists.best_sum_at_each_iter == [1.0, 1.0, 0.2]
    rb = {r.iter: (r.running_best_iter, r.running_best_paraphrase) for r in select.running_best(ib).collect()}
    assert rb == {0: (0, "x"), 1: (1, "y"), 2: (1, "y")}


def test_run_averages_skip_nan_and_round_half_even(spark):
    df = spark.createDataFrame([(0.00125,), (0.00125,), (float("nan"),)], "tifa_score double")
    out = {r.metric: r.value for r in select.run_averages_scoring(df, ["tifa_score"]).collect()}
    assert out == {"tifa_score": 0.12}  # pandas: (0.00125*100).round(2) == 0.12


def test_select_metrics():
    assert select.select_metrics("VQA,tifa") == ["tifa", "vqa"]
    with pytest.raises(ValueError):
        select.select_metrics("dcs")


def test_tifa_and_vqa_scores(spark):
    ans = spark.createDataFrame([(1, 0, " A ", "a"), (1, 1, "b", "c"), (2, None, None, None)],
                                "cand long, q_pos long, picked string, answer string")
    t = {r.cand: (r.n_questions, r.tifa, r.answers) for r in scores.tifa_scores(ans, ["cand"]).collect()}
    assert t == {1: (2, 0.5, [" A ", "b"]), 2: (0, 0.0, [])}
    rep = spark.createDataFrame([(1, "Yes"), (1, "no "), (2, "maybe"), (2, "yes")], "cand long, reply string")
    v = {r.cand: (r.n_yes, r.n_open, r.vqa) for r in scores.vqa_hard_scores(rep, ["cand"]).collect()}
    assert v == {1: (1, 0, 0.5), 2: (1, 1, None)}


def test_yes_probability_array_and_rows_agree(spark):
    data = [(1, [(" no", -0.1), ("Yes", -0.5), ("yes", -0.01)]), (2, [("no", -0.2)]), (3, [])]
    df = spark.createDataFrame(data, "k long, lp array<struct<token: string, logprob: double>>")
    arr = {r.k: r.p for r in df.select("k", scores.yes_probability("lp").alias("p")).collect()}
    long = df.select("k", F.posexplode("lp").alias("rank", "x")).select("k", "rank", "x.token", "x.logprob")
    rows = {r.k: r.yes_prob for r in scores.yes_probability_rows(long, ["k"], "rank").collect()}
    assert arr[1] == pytest.approx(math.exp(-0.5)) and arr[2] == 0.0 and arr[3] == 0.0
    assert rows[1] == pytest.approx(arr[1]) and rows[2] == 0.0


def test_effective_reply(spark):
    df = spark.createDataFrame([("filtered", "x"), ("ok", "y")], "s string, t string")
    assert [r[0] for r in df.select(scores.effective_reply("s", "t")).collect()] == ["", "y"]


@pytest.mark.parametrize("soft", [False, True])
def test_one_pass_scores_match_two_pass(spark, soft):
    import random
    rnd = random.Random(3)
    t_rows = [(c, q, rnd.choice([" a", "B", "c "]), rnd.choice(["a", "b", None])) for c in range(40) for q in range(rnd.randint(0, 4))]
    t_rows += [(99, None, None, None)]  # candidate without questions
    v_rows = [(c, k, rnd.choice(["yes", " No", "maybe", None]), rnd.random()) for c in range(40) for k in range(rnd.randint(1, 4))]
    t = spark.createDataFrame(t_rows, "cand long, q_pos long, picked string, answer string")
    v = spark.createDataFrame(v_rows, "cand long, chunk_pos long, reply string, yes_prob double")
    one = {r.cand: r for r in scores.score_candidates(t, v, ["cand"], soft=soft).collect()}
    ts = {r.cand: r for r in scores.tifa_scores(t, ["cand"]).collect()}
    vs = {r.cand: r for r in (scores.vqa_soft_scores(v, ["cand"]) if soft else scores.vqa_hard_scores(v, ["cand"])).collect()}
    for c, r in one.items():
        if c not in ts:  # only chunk rows: no questions scores 0.0, as in the reference
            assert (r.tifa, r.n_questions, r.answers) == (0.0, 0, [])
        else:
            assert (r.tifa, r.n_questions, r.answers) == (ts[c].tifa, ts[c].n_questions, ts[c].answers)
        if c in vs:
            assert r.vqa == pytest.approx(vs[c].vqa) if vs[c].vqa is not None else r.vqa is None


def test_best_from_lists_matches_best_paraphrase(spark):
    import random
    rnd = random.Random(5)
    rows = [(p, i, c, f"c{p}-{i}-{c}", rnd.choice([0.0, 0.25, 0.5, float("nan")]), rnd.choice([0.0, 0.5]))
            for p in range(30) for i in range(3) for c in range(3)]
    sc = scores.candidate_scores(spark.createDataFrame(rows, SCHEMA))
    ib = select.iteration_best(sc)
    a = {r.prompt_id: (r.best_iter, r.best_paraphrase) for r in select.best_paraphrase(ib).collect()}
    b = {r.prompt_id: (r.best_iter, r.best_paraphrase) for r in
         select.best_from_lists(select.iteration_lists(ib)).collect() if r.best_iter >= 0}
    assert a == b
