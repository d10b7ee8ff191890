"""Identities of the tests, the gate, models and a search with a planted signal."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from pitpanel.operators import inference as I
from pitpanel.operators import metrics as M
from pitpanel.operators import splits
from pitpanel.plans import model, search
from pitpanel.plans import proposers as P
from pitpanel.plans.spec import col, node


def test_student_tail():
    assert I.student_tail(0, 5) == pytest.approx(0.5)
    assert I.student_tail(2.015048, 5) == pytest.approx(0.05, abs=1e-6)
    assert I.student_tail(-1.644854, 1e7) == pytest.approx(0.95, abs=1e-5)


def panel(seed=0, n=600, groups=40, days=60):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"event_group": [f"g{k % groups:02d}" for k in range(n)], "t0": 86_400 * (19_000 + np.arange(n) % days) + 3600, "d": rng.normal(0.05, 1, n)})


def test_dm_equals_t_test_on_block_sums(spark):
    """One event a block and no lag: the one-sample t statistic."""
    rng = np.random.default_rng(1)
    df = pd.DataFrame({"event_group": [f"g{k}" for k in range(50)], "t0": 86_400 * np.arange(50), "d": rng.normal(0.2, 1, 50)})
    got = I.dm_test(spark.createDataFrame(df), lag=0, cluster_groups=False)
    t = df["d"].mean() / (df["d"].std(ddof=1) / math.sqrt(50))
    assert got["dm_stat"] == pytest.approx(t) and got["df"] == pytest.approx(49)


def test_dm_by_hand(spark):
    df = panel()
    got = I.dm_test(spark.createDataFrame(df), lag=3)
    u = df["d"] - df["d"].mean()
    day = df["t0"] // 86_400
    ut = u.groupby(day).sum().to_numpy()
    ug = u.groupby(df["event_group"]).sum().to_numpy()
    weigh = lambda x, k: 2 * (1 - k / 4) * (x[k:] * x[:-k]).sum()
    vt = (ut**2).sum() + sum(weigh(ut, k) for k in (1, 2, 3))
    cells = u.groupby([df["event_group"], day]).sum().unstack(fill_value=0.0).reindex(columns=range(19_000, 19_060), fill_value=0.0).to_numpy()
    vgt = (cells**2).sum() + sum(weigh(row, k) for row in cells for k in (1, 2, 3))
    v = max((ug**2).sum() + vt - vgt, (ug**2).sum(), vt)
    assert got["dm_stat"] == pytest.approx(df["d"].sum() / math.sqrt(v) * I.hln(60, 3))


def test_too_little_data_is_never_significant(spark):
    assert I.dm_test(spark.createDataFrame(panel(days=10)))["status"] == "too_few_blocks"
    assert I.dm_test(spark.createDataFrame(panel(groups=5)))["status"] == "too_few_groups"
    flat = panel()
    flat["d"] = 0.0
    found = I.dm_test(spark.createDataFrame(flat))
    assert found["status"] == "degenerate_variance" and found["dm_p"] == 1.0
    assert I.sign_flip(spark.createDataFrame(flat))["signflip_p"] == 1.0


def test_thresholds_and_q_values():
    assert I.placebo_threshold(list(range(18))) == math.inf
    assert I.placebo_threshold([float(k) for k in range(19)]) == 18.0
    assert I.placebo_p(5, [1, 5, 9]) == 0.75
    assert I.q_values([0.01, 0.04, 0.03, 0.5]) == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5])
    assert [I.hac_lag(t) for t in (1, 30, 800)] == [0, 7, 14]


def test_placebo_never_looks_ahead(spark):
    rng = np.random.default_rng(2)
    rows = [(f"m{m}", int(t), float(t)) for m in range(5) for t in sorted(rng.choice(1000, m * 3 + 1, replace=False))]
    placed = I.positions(spark.createDataFrame(pd.DataFrame(rows, columns=["market_ticker", "t0", "value"])))
    out = I.placebo_shift(placed, I.draw_offsets(placed, 2, 2)).toPandas()
    assert len(out) == len(rows)
    there = out.dropna()
    assert len(there) and (there["value"] < there["t0"]).all()


def probabilities(spark, seed=0):
    rng = np.random.default_rng(seed)
    df = panel(seed)
    df["label"] = rng.choice(["DOWN", "FLAT", "UP"], len(df), p=[0.2, 0.6, 0.2])
    for name, sharp in (("r", 0.0), ("p", 1.0)):
        raw = rng.dirichlet([2, 4, 2], len(df)) + sharp * (np.array(["DOWN", "FLAT", "UP"])[None] == df["label"].to_numpy()[:, None])
        raw /= raw.sum(1, keepdims=True)
        for k, x in enumerate(("DOWN", "FLAT", "UP")):
            df[f"{name}_{x}"] = raw[:, k]
    return spark.createDataFrame(df.drop(columns="d"))


def test_gate(spark):
    rows = probabilities(spark)
    M.check_probabilities(rows)
    assert I.decide(rows, draws=200).accept
    assert I.decide(rows, draws=200, placebo_gains=[9.0] * 19).reason == "below_placebo"
    assert I.decide(rows, draws=200, placebo_gains=[0.0] * 5).reason == "too_few_placebos"
    assert I.decide(rows, draws=200, require_placebo=True).reason == "placebo_missing"
    equal = rows.withColumns({f"p_{x}": rows[f"r_{x}"] for x in ("DOWN", "FLAT", "UP")})
    assert not I.decide(equal, draws=200).accept
    with pytest.raises(ValueError):
        M.check_probabilities(rows.withColumn("p_UP", rows["p_UP"] + 1))


def planted(seed=0):
    """Only the rolling mean of one column says something about the label."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(24):
        for m in range(2):
            start = 1_700_006_400 + int(2.5 * g) * 86_400
            times = start + 14_400 * np.flatnonzero(rng.random(72) < 0.75)
            x = rng.normal(size=len(times))
            rolled = pd.Series(x).shift(1).rolling(3, min_periods=1).mean().fillna(0).to_numpy()
            z = rolled / 0.6 + 0.3 * rng.normal(size=len(times))
            label = np.where(z > 1, "UP", np.where(z < -1, "DOWN", "FLAT"))
            for k, t in enumerate(times.tolist()):
                rows.append((f"g{g:02d}-{m}", f"g{g:02d}", f"S{g % 3}", t, t + 14_400, label[k], x[k], rng.normal()))
    return pd.DataFrame(rows, columns=["market_ticker", "event_group", "series", "t0", "t_end", "label", "mid", "spread"])


class Fixed:
    name = "fixed"

    def __init__(self, specs):
        self.specs, self.seen = iter(specs), []

    def propose(self, history, accepted):
        return next(self.specs)

    def observe(self, outcome):
        self.seen.append(outcome.status)


def test_search_accepts_the_planted_feature(spark, tmp_path):
    events = spark.createDataFrame(planted())
    cfg = P.SearchConfig(budget=5, seeds=(0,), placebos=0, columns=("mid", "spread"), draws=200, classifier={"n_estimators": 12, "max_depth": 3})
    good = node("roll", col("mid"), stat="mean", w=3).to_json()
    arm = Fixed([{"op": "nope"}, node("abs", col("spread")).to_json(), good, good, node("gate_pos", node("sub", col("mid"), col("mid")), col("mid")).to_json()])
    run = search.run_search(arm, events, splits.walk_forward(events, 3), cfg, str(tmp_path / "run"))
    assert arm.seen == ["failed", "rejected", "accepted", "duplicate", "failed"]
    assert run["status"] == "complete" and run["accepted"] == ["roll(mid, stat=mean, w=3)"]
    assert run["final"]["macro_f1"] > run["initial"]["macro_f1"] + 0.1
    with pytest.raises(FileExistsError):
        search.run_search(arm, events, splits.walk_forward(events, 3), cfg, str(tmp_path / "run"))


def test_dry_run_reads_and_writes_nothing(tmp_path):
    cfg = P.SearchConfig(budget=3)
    out = search.run_search(P.ModelArm(lambda _: {}, cfg), None, None, cfg, str(tmp_path / "run"), dry=True)
    assert out["status"] == "dry" and out["plan"]["fits_min"] == 100 and "Propose" in out["request"]["message"] and not (tmp_path / "run").exists()


def test_uniform_and_estimating_arms():
    cfg = P.SearchConfig(budget=30, columns=("mid", "spread"))
    a, b = P.RandomArm(3, cfg), P.RandomArm(3, cfg)
    first = [str(a.propose([], [])) for _ in range(30)]
    assert first == [str(b.propose([], [])) for _ in range(30)] and len(set(first)) == 30
    with pytest.raises(ValueError):
        P.SearchConfig(placebos=5)

    def run(arm, n):
        out = []
        for k in range(n):
            out.append(arm.propose([], []))
            arm.observe(P.Outcome(k, out[-1], "rejected", "", gain=1.0 if out[-1]["op"] == "roll" else 0.0))
        return out

    rolls = [sum(s["op"] == "roll" for s in run(P.TpeArm(seed, P.SearchConfig(budget=60)), 60)[20:]) for seed in range(5)]
    assert sum(rolls) > 2 * 5 * 40 / 28  # more than twice what uniform draws give
    arm = P.TpeArm(1, cfg)
    assert len({str(s) for s in run(arm, 30)}) == 30 and len(arm.finished) == 30
    arm.propose([], [])
    arm.observe(P.Outcome(30, None, "failed", "no"))
    arm.propose([], [])
    arm.observe(P.Outcome(31, None, "duplicate", "no", gain=2.0))
    assert len(arm.finished) == 30 and len(arm.pruned) >= 2
    again = P.TpeArm(1, cfg, restart=True)
    again.propose([], [])
    again.observe(P.Outcome(0, None, "accepted", "", gain=1.0))
    assert not again.finished and not again.pruned


def test_estimator_falls_back_to_unseen_draws():
    """A space of few specs: once all of one kind are proposed, others come."""
    cfg = P.SearchConfig(budget=40, columns=("mid",), max_depth=1)
    arm = P.TpeArm(2, cfg, startup=5, redraws=2)
    for k in range(35):
        spec = arm.propose([], [])
        arm.observe(P.Outcome(k, spec, "rejected", "", gain=1.0 if spec["op"] == "abs" else 0.0))
    assert len(arm.seen) == 35


SPECS = [node("abs", col("mid")), node("roll", col("mid"), stat="mean", w=3), node("mul", col("mid"), col("spread"))]
HISTORY = [
    P.Outcome(0, SPECS[0].to_json(), "accepted", "all checks passed", SPECS[0].formula(), 0.0417, 0.0213),
    P.Outcome(1, SPECS[1].to_json(), "rejected", "p above alpha on 2024-05-01", SPECS[1].formula(), 0.0311, 0.6842),
    P.Outcome(2, '{"op": "frobnicate"}', "failed", "invalid", None),
    P.Outcome(3, SPECS[1].to_json(), "duplicate", "duplicate of trial 1", SPECS[1].formula(), 0.0311, 0.6842),
]
CFG = P.SearchConfig(budget=9, columns=("mid", "spread"))


def model_arm(mode="full", answers=(), cfg=CFG, **more):
    left = iter(answers)
    made = P.ModelArm(lambda _: {"text": next(left), "usage": {"output_tokens": 3}}, cfg, mode, **more)
    made.rationales = {0: "magnitude matters", 1: "momentum persists"}
    return made


def test_full_mode_tells_all():
    text = model_arm().message(HISTORY, [SPECS[0]])
    for part in ("accepted", "rejected", "failed 1", "duplicate", "0.0417", "0.6842", SPECS[1].formula(), "frobnicate", "momentum persists", "roll 2", "Trial 5 of 9", "p above alpha"):
        assert part in text
    assert "2024" not in text and "none" in model_arm().message([], [])


def test_blind_mode_tells_own_proposals_and_no_outcome():
    arm = model_arm("blind")
    text = arm.message(HISTORY, [SPECS[0]])
    assert SPECS[0].formula() in text and SPECS[1].formula() in text and "frobnicate" in text and "momentum persists" in text
    for part in ("accepted", "rejected", "failed", "duplicate", "gain", "0.04", "0.03", "0.68", "alpha"):
        assert part not in text
    flipped = [replace(o, status="accepted", gain=0.5, p_value=0.001, reason="r") for o in HISTORY]
    assert arm.message(flipped, SPECS) == text and arm.system() == model_arm("full").system()
    assert "proposals" not in arm.message([], [])


def test_no_history_mode_tells_accepted_features_alone():
    arm = model_arm("no_history")
    text = arm.message(HISTORY, [SPECS[0]])
    assert SPECS[0].formula() in text and SPECS[1].formula() not in text and "frobnicate" not in text and "rejected" not in text
    assert arm.message(HISTORY[:1] * 4, [SPECS[0]]) == text


def test_long_histories_are_cut():
    many = [P.Outcome(k, SPECS[k % 3].to_json(), "accepted" if k == 0 else "rejected", "r", SPECS[k % 3].formula(), 0.1, 0.2) for k in range(10)]
    full, blind = (model_arm(mode, shown=3).message(many, []) for mode in ("full", "blind"))
    assert "7 of 10 left out" in full and "\n1 | accepted" in full and "7 of 10 left out" in blind and "\n1 |" not in blind
    assert blind == model_arm("blind", shown=3).message([replace(o, status="rejected") for o in many], [])


def test_system_text_states_the_rule_of_the_search():
    strict = P.SearchConfig(alpha=0.01, placebos=39, placebo_min_shift=3, min_valid=250, require_f1=True)
    text = model_arm(cfg=strict).system()
    assert all(x in text for x in ("0.01", "39 placebo", "moved by 3 events", "250 values", "Macro F1")) and "sign-flip" not in text
    assert "placebo" not in model_arm(cfg=P.SearchConfig(placebos=0)).system()


def test_repairs_transcripts_and_replay(tmp_path):
    good = '{"rationale": "it is simple", "spec": {"op": "abs", "args": [{"col": "mid"}]}}'
    arm = model_arm(answers=["nonsense", '{"op": "nope"}', good, '{"op": "abs", "args": [{"col": "spread"}]}'])
    assert arm.propose([], []) == SPECS[0].to_json() and len(arm.calls) == 3 and arm.tokens["output_tokens"] == 9 and arm.rationales[0] == "it is simple"
    assert "no operator 'nope'" in arm.calls[2]["request"]["messages"][0]["content"]
    arm.propose(HISTORY[:1], [SPECS[0]])
    path = str(tmp_path / "t.jsonl")
    P.write_transcript(path, arm.calls)
    assert P.read_transcript(path) == arm.calls
    again = P.ModelArm(P.replay(P.read_transcript(path)), CFG)
    assert again.propose([], []) == SPECS[0].to_json() and again.calls == arm.calls[:3]
    with pytest.raises(P.ReplayMismatch, match="differs from the recorded one at /messages/0/content"):
        P.ModelArm(P.replay(arm.calls), CFG).propose(HISTORY, [])
    with pytest.raises(P.ReplayMismatch, match="only 1 calls"):
        P.ModelArm(P.replay(arm.calls[:1]), CFG).propose([], [])
    never = model_arm(answers=["no"] * 3)
    assert never.propose([], []) == "" and never.rationales[0] == ""
    with pytest.raises(ValueError):
        model_arm("half")


def test_trees_learn_and_explain():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    x[rng.random(x.shape) < 0.1] = np.nan
    y = np.where(np.nan_to_num(x[:, 1]) > 0.5, 2, np.where(np.nan_to_num(x[:, 1]) < -0.5, 0, 1))
    made = model.SoftmaxTrees(0, n_estimators=20).fit(x, y)
    p = made.predict_proba(x)
    assert (p.argmax(1) == y).mean() > 0.9 and np.allclose(p.sum(1), 1)
    parts = np.abs(made.contributions(x)).mean(axis=(0, 1))
    assert parts.argmax() == 1


def test_report(spark):
    df = planted(3)
    df["prev_label"] = np.nan
    events = spark.createDataFrame(df)
    out = model.report(events, splits.walk_forward(events, 3), ["mid", "spread"], [0], draws=100, n_estimators=5)
    assert set(out["pooled_macro_f1"]) == {"model", "majority", "no_change", "momentum", "random"} and out["keep_rule"]["verdict"] in ("KEPT", "NEUTRAL", "REGRESSED")


def test_lexicon_counts_all_words():
    assert model.lexicon(["word " * 600 + "gain"]) == [(0.5, 0.0, 0.5)]
