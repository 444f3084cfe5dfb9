"""Classifiers on preprocessed features, and the evaluations that leave out families, days or columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.scalars import finite_or_null, q
from flowquarry.operators.features import Preprocessor, fit_preprocessor, fit_preprocessors_without
from flowquarry.operators.forest import Forest, ForestModel

LABEL = "__y"
SPECS = ("majority_class", "logistic_regression", "decision_tree", "random_forest", "gradient_boosting")


def estimator(name: str, seed: int = 42, trees: int = 100, depth: int = 12):
    """An MLlib estimator, or a Forest; majority_class has none. Trees split on binned values."""
    common = {"featuresCol": "__x", "labelCol": LABEL}
    if name == "logistic_regression":
        return LogisticRegression(maxIter=200, regParam=1e-4, **common)
    if name == "decision_tree":
        return DecisionTreeClassifier(maxDepth=depth, maxBins=128, seed=seed, **common)
    if name == "random_forest":
        return Forest(LABEL, trees, depth, bins=64, seed=seed)
    if name == "gradient_boosting":
        return GBTClassifier(maxIter=20, maxDepth=5, maxBins=64, seed=seed, **common)
    raise ValueError(name)


class Scorer:
    """A preprocessor with a fitted classifier; scores are probabilities of an attack."""

    def __init__(self, prep: Preprocessor, model: Model | ForestModel | float):
        self.prep, self.model = prep, model

    def columns(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """keep plus the preprocessed features as __f0, __f1, ..."""
        self.prep.check(df)
        return df.select(*[F.col(f"`{c}`") for c in keep], *[self.prep.expression(c).alias(f"__f{i}") for i, c in enumerate(self.prep.kept)])  # keep may name features

    def vectors(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        return VectorAssembler(inputCols=[f"__f{i}" for i in range(len(self.prep.kept))], outputCol="__x").transform(self.columns(df, keep))

    def score(self, df: DataFrame, keep: Sequence[str], name: str = "p") -> DataFrame:
        """keep plus the probability."""
        if isinstance(self.model, float):
            return df.select(*[F.col(f"`{c}`") for c in keep], F.lit(self.model).alias(name))
        if isinstance(self.model, ForestModel):
            flat = self.columns(df, keep)
            return flat.select(*[F.col(f"`{c}`") for c in keep], self.model.probability(flat, [f"__f{i}" for i in range(len(self.prep.kept))]).alias(name))
        out = self.model.transform(self.vectors(df, keep))
        return out.select(*[F.col(f"`{c}`") for c in keep], vector_to_array(F.col("probability"))[1].alias(name))


def fit(train: DataFrame, columns: Sequence[str], y: Column, spec: str = "random_forest", *, exclude: Sequence[str] = ("Destination Port",), seed: int = 42, trees: int = 100, depth: int = 12, prep: Preprocessor | None = None) -> Scorer:
    """Preprocessing and classifier learned from train only; prep is what the preprocessing learned, if that is known."""
    if prep is None:
        prep = fit_preprocessor(train, columns, scale=spec == "logistic_regression", exclude=exclude)
    data = train.withColumn(LABEL, y.cast("double"))
    if spec == "majority_class":
        share = data.agg(F.avg(LABEL)).first()[0] or 0.0
        return Scorer(prep, 1.0 if share > 0.5 else 0.0)
    s = Scorer(prep, 0.0)
    chosen = estimator(spec, seed, trees, depth)
    if isinstance(chosen, Forest):
        s.model = chosen.fit(s.columns(data, [LABEL]))
        return s
    vectors = s.vectors(data, [LABEL]).persist()
    try:
        s.model = chosen.fit(vectors)
    finally:
        vectors.unpersist()
    return s


def leave_one_out(train: DataFrame, test: DataFrame, group: str, columns: Sequence[str], y: Column, benign: str, keep: Sequence[str], preps: dict[str, Preprocessor] | None = None, **how: object) -> DataFrame:
    """Per attack group: a scorer trained without it, applied to test; long table (held, keep..., p).

    preps has what the preprocessing learns without each group, if that is known.
    """
    groups = [r[0] for r in train.where(F.col(group) != benign).select(group).distinct().orderBy(group).collect()]  # one name per family
    if preps is None:
        preps = {}
        if len(groups) > 1 and how.get("spec") != "logistic_regression":  # others have no moments to learn
            preps = fit_preprocessors_without(train, columns, group, groups, **{k: v for k, v in how.items() if k == "exclude"})
    scorers = {}
    if groups and all(g in preps for g in groups) and how.get("spec", "random_forest") == "random_forest":
        chosen = estimator("random_forest", **{k: v for k, v in how.items() if k in ("seed", "trees", "depth")})
        if isinstance(chosen, Forest):
            used = [c for c in columns if any(c in preps[g].kept for g in groups)]
            data = train.where(F.col(group).isNotNull()).select(F.col(group).cast("string").alias("__group"), *[finite_or_null(q(c).cast("double")).alias(c) for c in used], y.cast("double").alias(LABEL))
            fitted = chosen.fit_without(data, "__group", used, {g: {c: preps[g].medians[c] for c in preps[g].kept} for g in groups})
            scorers = {g: Scorer(preps[g], m) for g, m in fitted.items()}
    out = None
    for g in groups:
        s = scorers[g] if g in scorers else fit(train.where(F.col(group) != g), columns, y, **how, prep=preps.get(g))
        part = s.score(test, keep).withColumn("held", F.lit(g))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no group to leave out")
    return out


def held_out_prefix(df: DataFrame, file: str, prefix: str, columns: Sequence[str], y: Column, keep: Sequence[str], **how: object) -> DataFrame:
    """Trained on all files without the prefix, whatever their split; scores of the files with it."""
    held = F.col(file).startswith(prefix)
    return fit(df.where(~held), columns, y, **how).score(df.where(held), keep)
