"""Classifiers, cross-validation and text scoring.

``boosted`` grows gradient-boosted softmax trees on binned features, one task for each
fold and seed: for event tables that fit in a task. ``forest`` trains Spark's random
forest on all executors, for tables that don't. Predictions of neither equal those of any
other library's trees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.operators.labels import LABELS
from pitpanel.operators.metrics import P, argmax_label, balanced_loss, balanced_weights, baselines, confusion, keep_rule, log_loss, macro_f1, random_baseline
from pitpanel.sources.storage import materialised

# Default parameters of the trees.
PARAMS = {"n_estimators": 200, "max_depth": 4, "learning_rate": 0.05, "subsample": 0.7, "colsample_bytree": 0.6, "min_child_weight": 3.0}
BINS = 64
#: Rows of one fold that ``boosted`` takes; more go to ``forest``.
TASK_ROWS = 2_000_000


class SoftmaxTrees:
    """Boosted trees on histograms, a tree a class and round; missing values take the better side."""

    def __init__(self, seed: int = 0, **params):
        self.p = PARAMS | params
        self.rng = np.random.default_rng(seed)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bin numbers, the last one for missing values."""
        out = np.full(x.shape, BINS, np.int64)
        for f, cuts in enumerate(self.cuts):
            there = ~np.isnan(x[:, f])
            out[there, f] = np.searchsorted(cuts, x[there, f], side="right")
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> SoftmaxTrees:
        levels = np.linspace(0, 1, BINS + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(c[~np.isnan(c)], levels)) if (~np.isnan(c)).any() else np.zeros(0) for c in x.T]
        b, k = self.bins(x), len(LABELS)
        count = np.bincount(y, minlength=k)
        weight = (len(y) / (max((count > 0).sum(), 1) * np.maximum(count, 1)))[y]
        score, target = np.zeros((len(y), k)), np.eye(k)[y]
        self.trees: list[list] = []
        n_features = max(1, round(self.p["colsample_bytree"] * x.shape[1]))
        for _ in range(self.p["n_estimators"]):
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            used = self.rng.random(len(y)) < self.p["subsample"]
            features = np.sort(self.rng.choice(x.shape[1], n_features, replace=False))
            grown = []
            for c in range(k):
                g, h = weight * (p[:, c] - target[:, c]), 2 * weight * p[:, c] * (1 - p[:, c])
                tree = self.grow(b[used], g[used], h[used], features)
                score[:, c] += self.walk(tree, b)
                grown.append(tree)
            self.trees.append(grown)
        return self

    def grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, features: np.ndarray) -> dict:
        """Nodes by number (children 2i + 1 and 2i + 2): a split or a leaf's value."""
        tree: dict[int, tuple] = {}
        at = np.zeros(len(g), np.int64)
        live = [0]
        for depth in range(self.p["max_depth"] + 1):
            grown = []
            for i in live:
                mine = np.flatnonzero(at == i)
                sg, sh = g[mine].sum(), h[mine].sum()
                best = self.split(b[mine], g[mine], h[mine], sg, sh, features) if depth < self.p["max_depth"] else None
                if best is None:
                    tree[i] = (None, -self.p["learning_rate"] * sg / (sh + 1.0))
                    continue
                f, cut, missing_left = best
                tree[i] = (f, cut, missing_left)
                v = b[mine, f]
                left = np.where(v == BINS, missing_left, v <= cut)
                at[mine] = np.where(left, 2 * i + 1, 2 * i + 2)
                grown += [2 * i + 1, 2 * i + 2]
            live = grown
        return tree

    def split(self, b, g, h, sg, sh, features) -> tuple | None:
        best, out = 1e-6, None
        whole = sg * sg / (sh + 1.0)
        for f in features:
            hg = np.bincount(b[:, f], g, BINS + 1)
            hh = np.bincount(b[:, f], h, BINS + 1)
            for missing_left in (True, False):
                lg = np.cumsum(hg[:BINS]) + (hg[BINS] if missing_left else 0)
                lh = np.cumsum(hh[:BINS]) + (hh[BINS] if missing_left else 0)
                rg, rh = sg - lg, sh - lh
                gain = lg * lg / (lh + 1.0) + rg * rg / (rh + 1.0) - whole
                gain[(lh < self.p["min_child_weight"]) | (rh < self.p["min_child_weight"])] = 0
                k = int(gain.argmax())
                if gain[k] > best:
                    best, out = gain[k], (int(f), k, missing_left)
        return out

    @staticmethod
    def walk(tree: dict, b: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(b)), np.zeros(len(b), np.int64)
        for i in sorted(tree):
            mine = np.flatnonzero(at == i)
            if tree[i][0] is None:
                out[mine] = tree[i][1]
            else:
                f, cut, missing_left = tree[i]
                v = b[mine, f]
                at[mine] = np.where(np.where(v == BINS, missing_left, v <= cut), 2 * i + 1, 2 * i + 2)
        return out

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        score = np.stack([sum((self.walk(t[c], b) for t in self.trees), np.zeros(len(x))) for c in range(len(LABELS))], 1)
        p = np.exp(score - score.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """(row, class, feature): what each feature's splits add to the class scores.

        Along a row's path, the change of the mean leaf value at each split is the split
        feature's; with the trees' base values they add up to the scores.
        """
        b = self.bins(x)
        out = np.zeros((len(x), len(LABELS), x.shape[1]))
        for grown in self.trees:
            for c, tree in enumerate(grown):
                mean: dict[int, float] = {}
                for i in sorted(tree, reverse=True):
                    mean[i] = tree[i][1] if tree[i][0] is None else (mean[2 * i + 1] + mean[2 * i + 2]) / 2
                at = np.zeros(len(x), np.int64)
                for i in sorted(tree):
                    if tree[i][0] is None:
                        continue
                    f, cut, missing_left = tree[i]
                    mine = np.flatnonzero(at == i)
                    v = b[mine, f]
                    at[mine] = np.where(np.where(v == BINS, missing_left, v <= cut), 2 * i + 1, 2 * i + 2)
                    out[mine, c, f] += np.array([mean[j] for j in at[mine].tolist()]) - mean[i]
        return out


def boosted(rows: DataFrame, features: list[str], seeds: list[int], **params) -> DataFrame:
    """``market_ticker, t0, fold, p_*`` of validation rows, averaged over seeds.

    ``rows`` has ``market_ticker, t0, fold, role, label`` and the features.
    """
    most = rows.groupBy("fold").count().agg(F.max("count")).first()[0] or 0
    if most > TASK_ROWS:
        raise ValueError(f"a fold of {most} rows is too large for one task; use forest")
    kept = rows.select("market_ticker", "t0", "fold", "role", "label", *(F.col(f).cast("double").alias(f"x{k}") for k, f in enumerate(features)))
    each = kept.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    xs = [f"x{k}" for k in range(len(features))]

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["t0", "market_ticker"])  # the same rows in the same order, however they came
        train, val = part[part["role"] == "train"], part[part["role"] == "val"]
        y = train["label"].map({x: k for k, x in enumerate(LABELS)}).to_numpy()
        p = SoftmaxTrees(int(part["seed"].iloc[0]), **params).fit(train[xs].to_numpy(float), y).predict_proba(val[xs].to_numpy(float))
        return pd.DataFrame({"market_ticker": val["market_ticker"], "t0": val["t0"], "fold": val["fold"], **{c: p[:, k] for k, c in enumerate(P)}})

    schema = f"market_ticker string, t0 bigint, fold bigint, {', '.join(f'{c} double' for c in P)}"
    made = each.withColumn("fold", F.col("fold").cast("bigint")).groupBy("fold", "seed").applyInPandas(one, schema)
    return averaged(made)


def averaged(made: DataFrame) -> DataFrame:
    """Probabilities averaged over seeds and scaled to sum to 1."""
    mean = made.groupBy("market_ticker", "t0", "fold").agg(*(F.avg(c).alias(c) for c in P))
    total = sum((F.col(c) for c in P[1:]), F.col(P[0]))
    return mean.select("market_ticker", "t0", "fold", *((F.col(c) / total).alias(c) for c in P))


def forest(rows: DataFrame, features: list[str], seeds: list[int], trees: int = 60, depth: int = 8) -> DataFrame:
    """The same by Spark's distributed random forest; missing values are 0 beside an indicator.

    Rows without folds have no predictions.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    folds = [r[0] for r in rows.select("fold").distinct().orderBy("fold").collect()]  # a handful
    if not folds:
        return averaged(rows.select("market_ticker", "t0", "fold", *(F.lit(None).cast("double").alias(c) for c in P)))
    y = F.lit(None).cast("double")
    for k, x in enumerate(LABELS):
        y = F.when(F.col("label") == x, float(k)).otherwise(y)
    names = [f"x{k}" for k in range(len(features))] + [f"m{k}" for k in range(len(features))]
    cols = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"x{k}") for k, f in enumerate(features)]
    cols += [F.col(f).isNull().cast("double").alias(f"m{k}") for k, f in enumerate(features)]
    ready = rows.select("market_ticker", "t0", "fold", "role", "label", y.alias("y"), *cols)
    ready = VectorAssembler(inputCols=names, outputCol="x").transform(ready).drop(*names)
    ready = materialised(ready)
    out = None
    for k in folds:
        part = ready.filter(F.col("fold") == k)
        train = balanced_weights(part.filter("role = 'train'"))
        for seed in seeds:
            fitted = RandomForestClassifier(featuresCol="x", labelCol="y", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed).fit(train)
            p = vector_to_array("probability")
            got = fitted.transform(part.filter("role = 'val'")).withColumn("_p", p)
            got = got.select("market_ticker", "t0", "fold", *(F.coalesce(F.get("_p", F.lit(j)), F.lit(0.0)).alias(c) for j, c in enumerate(P)))
            out = got if out is None else out.unionByName(got)
    return averaged(out)


def cross_validate(events: DataFrame, folds: DataFrame, features: list[str], seeds: list[int], classifier: Callable = boosted, **params) -> DataFrame:
    """``market_ticker, t0, event_group, fold, label, pred, p_*``: out-of-fold predictions."""
    rows = events.join(folds, ["market_ticker", "t0"])
    made = classifier(rows, features, seeds, **params)
    return made.join(events.select("market_ticker", "t0", "event_group", "label"), ["market_ticker", "t0"]).withColumn("pred", argmax_label())


def report(events: DataFrame, folds: DataFrame, features: list[str], seeds: list[int], classifier: Callable = boosted, draws: int = 2000, threshold: float = 0.005, **params) -> dict:
    """Pooled and fold scores of the model and the baselines, intervals against each, the keep rule."""
    from pitpanel.operators.inference import paired_bootstrap

    scored = cross_validate(events, folds, features, seeds, classifier, **params)
    base = baselines(events, folds).drop("label", "event_group").join(random_baseline(events, folds).drop("label"), ["market_ticker", "t0", "fold"])
    rows = scored.join(base, ["market_ticker", "t0", "fold"]).withColumnRenamed("pred", "model")
    rows = materialised(rows)
    names = ["model", "majority", "no_change", "momentum", "random"]
    pooled = {n: macro_f1(confusion(rows.withColumn("pred", F.col(n)), [])).first()[0] for n in names}
    by_fold = {n: {r[0]: r[1] for r in macro_f1(confusion(rows.withColumn("pred", F.col(n)), ["fold"]), ["fold"]).collect()} for n in names}
    pairs = [(by_fold["model"][k], by_fold["momentum"][k]) for k in sorted(by_fold["model"])]
    verdict = keep_rule(rows.sparkSession.createDataFrame(pairs, "cand double, base double"), threshold).first().asDict()
    return {
        "features": features, "n_events_scored": rows.count(), "pooled_macro_f1": pooled, "fold_macro_f1": by_fold,
        "log_loss": log_loss(rows).first()[0], "balanced_loss": balanced_loss(balanced_weights(rows)).agg(F.avg("loss")).first()[0],
        "comparisons": {n: paired_bootstrap(rows, "model", n, draws) for n in names[1:]}, "keep_rule": verdict,
        "labels": {r[0]: r[1] for r in rows.groupBy("label").count().collect()},
    }


# -- text scoring --

# The built-in scorer's words.
GOOD = "gain gains rise rises win wins growth strong record up success agree positive beat surge".split()
BAD = "loss losses fall falls lose weak crisis down fail fails deny negative miss drop fear war".split()
SCORES = "label string, positive double, negative double, neutral double, confidence double"


def lexicon(texts: list[str]) -> list[tuple[float, float, float]]:
    """(positive, negative, neutral) by counts of words: a stand-in for a language model."""
    out = []
    for text in texts:
        words = text.lower().split()
        up, down = sum(w in GOOD for w in words), sum(w in BAD for w in words)
        total = up + down + 1.0
        out.append((up / total, down / total, 1.0 / total))
    return out


def score_texts(rows: DataFrame, key: str = "url", text: str = "text", scorer: Callable[[list[str]], list[tuple]] = lexicon, batch: int = 64) -> DataFrame:
    """``key, label, positive, negative, neutral, confidence``: the scorer over Arrow batches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part["text"].fillna("").tolist()
            found = [s for k in range(0, len(texts), batch) for s in scorer(texts[k : k + batch])]
            p = pd.DataFrame(found, columns=["positive", "negative", "neutral"], dtype=float)
            best = p.to_numpy().argmax(1) if len(p) else []
            yield pd.DataFrame({key: part["key"].to_numpy(), "label": [p.columns[k] for k in best], **{c: p[c] for c in p}, "confidence": p.max(axis=1)})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"{key} {kind}, {SCORES}")
