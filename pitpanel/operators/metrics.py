"""Scores of predictions: confusion, macro F1, losses, baselines, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.operators.labels import LABELS

CLIP = 1e-6
P = [f"p_{label}" for label in LABELS]


def prior(events: DataFrame) -> DataFrame:
    """``label, share``: the share of every label, absent ones 0."""
    counts = events.groupBy("label").agg(F.count("*").alias("n"))
    domain = events.sparkSession.createDataFrame([(x,) for x in LABELS], "label string")
    total = F.sum("n").over(Window.partitionBy())
    return domain.join(counts, "label", "left").select("label", (F.coalesce("n", F.lit(0)) / total).alias("share"))


def most_frequent(column: str) -> Column:
    """An aggregate: the most frequent value, the least of a tie."""
    return F.expr(f"mode() WITHIN GROUP (ORDER BY `{column}`)")


def confusion(scored: DataFrame, by: list[str]) -> DataFrame:
    return scored.groupBy(*by, "label", "pred").agg(F.count("*").alias("n"))


def macro_f1(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Macro F1 over all three labels from ``label, pred, n``; a label without rows counts 0."""
    by = by or []
    sums = [F.sum(F.when(on, F.col("n")).otherwise(0)).alias(f"{kind}_{x}") for x in LABELS for kind, on in (
        ("tp", (F.col("label") == x) & (F.col("pred") == x)), ("true", F.col("label") == x), ("said", F.col("pred") == x))]
    wide = counts.groupBy(*by).agg(*sums) if by else counts.agg(*sums)
    one = [F.coalesce(F.try_divide(2 * F.col(f"tp_{x}"), F.col(f"true_{x}") + F.col(f"said_{x}")), F.lit(0.0)) for x in LABELS]
    return wide.select(*by, (sum(one[1:], one[0]) / len(LABELS)).alias("macro_f1"))


def p_true(prefix: str = "p_") -> Column:
    out = F.lit(None).cast("double")
    for x in LABELS:
        out = F.when(F.col("label") == x, F.col(f"{prefix}{x}")).otherwise(out)
    return out


def argmax_label(prefix: str = "p_") -> Column:
    """The most probable label; of a tie the first."""
    best = F.greatest(*(F.col(f"{prefix}{x}") for x in LABELS))
    out = F.lit(LABELS[-1])
    for x in LABELS[-2::-1]:
        out = F.when(F.col(f"{prefix}{x}") == best, x).otherwise(out)
    return out


def balanced_weights(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``scored`` with ``weight`` = n / (labels present * n of the label), within ``by``.

    Counts of labels are summed first; their small table is joined back.
    """
    by = by or []
    counts = scored.groupBy(*by, "label").agg(F.count("*").alias("n_label"))
    over = Window.partitionBy(*by)
    weights = counts.select(*by, "label", (F.sum("n_label").over(over) / (F.count("*").over(over) * F.col("n_label"))).alias("weight"))
    return scored.join(weights, [*by, "label"])


def balanced_loss(weighted: DataFrame, prefix: str = "p_", name: str = "loss") -> DataFrame:
    p = p_true(prefix)
    return weighted.withColumn(name, -F.col("weight") * F.ln(F.least(F.greatest(p, F.lit(CLIP)), F.lit(1.0))))


def log_loss(scored: DataFrame, prefix: str = "p_") -> DataFrame:
    return scored.agg(F.avg(-F.ln(F.greatest(p_true(prefix), F.lit(1e-15)))).alias("log_loss"))


def loss_differences(scored: DataFrame, ref: str = "r_", cand: str = "p_", by: list[str] | None = None) -> DataFrame:
    """``scored`` with ``d`` = balanced loss of the reference minus the candidate's."""
    rows = balanced_weights(scored, by)
    rows = balanced_loss(balanced_loss(rows, ref, "loss_ref"), cand, "loss_cand")
    return rows.withColumn("d", F.col("loss_ref") - F.col("loss_cand"))


def validation(scored: DataFrame, prefix: str = "p_") -> DataFrame:
    """One row: how many rows break each rule of a table of probabilities."""
    ps = [F.col(f"{prefix}{x}") for x in LABELS]
    some_null = ps[0].isNull() | ps[1].isNull() | ps[2].isNull()
    outside = (F.least(*ps) < 0) | (F.greatest(*ps) > 1)
    off = F.abs(ps[0] + ps[1] + ps[2] - 1) > 1e-4
    return scored.agg(
        F.count("*").alias("n"), F.count_if(~F.col("label").isin(LABELS) | F.col("label").isNull()).alias("bad_label"),
        F.count_if(some_null).alias("missing"), F.count_if(outside).alias("outside"), F.count_if(off).alias("bad_sum"),
        F.count_if(F.col("event_group").isNull() | F.col("t0").isNull()).alias("missing_key"),
    )


def check_probabilities(scored: DataFrame, prefix: str = "p_") -> None:
    found = validation(scored, prefix).first().asDict()
    if not found.pop("n"):
        raise ValueError("no scored events")
    wrong = {k: v for k, v in found.items() if v}
    if wrong:
        raise ValueError(f"not a table of probabilities: {wrong}")


def baselines(events: DataFrame, folds: DataFrame) -> DataFrame:
    """``market_ticker, t0, fold, label, majority, no_change, momentum`` of validation rows;
    what is fitted is fitted on each fold's training rows."""
    rows = events.join(folds, ["market_ticker", "t0"])
    fitted = rows.filter("role = 'train'").groupBy("fold").agg(most_frequent("label").alias("majority"))
    momentum = F.when(F.col("prev_label") == -1, "DOWN").when(F.col("prev_label") == 0, "FLAT").when(F.col("prev_label") == 1, "UP")
    return rows.filter("role = 'val'").join(F.broadcast(fitted), "fold").select(
        "market_ticker", "t0", "event_group", "fold", "label", "majority", F.lit("FLAT").alias("no_change"), F.coalesce(momentum, "majority").alias("momentum")
    )


def random_baseline(events: DataFrame, folds: DataFrame, seed: int = 42) -> DataFrame:
    """``market_ticker, t0, fold, random``: drawn by the training shares of labels, the draw
    being a hash of the row and the seed, so that it doesn't depend on partitions."""
    rows = events.join(folds, ["market_ticker", "t0"])
    shares = rows.filter("role = 'train'").groupBy("fold").agg(*(F.avg((F.col("label") == x).cast("double")).alias(f"s_{x}") for x in LABELS))
    digits = F.md5(F.concat_ws("|", F.lit(seed), "market_ticker", "t0", "fold")).substr(1, 8)
    u = F.conv(digits, 16, 10).cast("bigint") / F.lit(2.0**32)
    pick = F.when(u < F.col("s_DOWN"), "DOWN").when(u < F.col("s_DOWN") + F.col("s_FLAT"), "FLAT").otherwise("UP")
    return rows.filter("role = 'val'").join(F.broadcast(shares), "fold").select("market_ticker", "t0", "fold", "label", pick.alias("random"))


def keep_rule(folds: DataFrame, threshold: float = 0.005) -> DataFrame:
    """Verdict on fold scores ``cand, base``: kept if better by the threshold on average and in 4 of 5 folds."""
    sums = folds.agg((F.avg("cand") - F.avg("base")).alias("delta"), F.count_if(F.col("cand") > F.col("base")).alias("folds_won"), F.count("*").alias("n_folds"))
    need = F.ceil(F.lit(0.8) * F.col("n_folds")).cast("bigint")
    verdict = F.when((F.col("delta") > threshold) & (F.col("folds_won") >= need), "KEPT").when(F.col("delta") < -threshold, "REGRESSED").otherwise("NEUTRAL")
    return sums.select(verdict.alias("verdict"), "delta", "folds_won", need.alias("required"), "n_folds")
