"""Additive feature attribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import digest, hex_draw, bits_of, permutation_rows
from .linear import LinearModel
from .reshape import _stack, top_k_features



def linear_attributions(model: LinearModel) -> dict[str, Column]:
    """Exact attribution of a linear model: slope times distance from the training mean.

    The encoded training mean is the encoded imputation value, so no pass is needed.
    """
    out = {}
    for i, f in enumerate(model.features):
        if model.span[i] == 0:
            out[f] = F.lit(0.0)
        else:
            mean = (model.impute[i] - model.low[i]) / model.span[i]
            out[f] = F.lit(model.coef[i]) * (model.encoded(f) - F.lit(mean))
    return out


def shap_wide(df: DataFrame, model: LinearModel) -> DataFrame:
    """Adds ``shap_<feature>`` columns; a map-only projection."""
    return df.withColumns({f"shap_{f}": e for f, e in linear_attributions(model).items()})


def shap_long(df: DataFrame, model: LinearModel, ids: Sequence[str]) -> DataFrame:
    """(ids, feature, value, shap), value as the learner sees it; expanded in place, no join."""
    parts = [
        F.struct(F.lit(f).alias("feature"), model.encoded(f).alias("value"), e.alias("shap"))
        for f, e in linear_attributions(model).items()
    ]
    return df.select(*ids, F.inline(F.array(*parts)))


def global_importance(wide: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean absolute attribution per feature."""
    return _stack(wide, [F.struct(F.lit(f).alias("feature"), F.avg(F.abs(F.col(f"shap_{f}"))).alias("mean_abs_shap")) for f in features])


def dispersion(wide: DataFrame, features: Sequence[str]) -> DataFrame:
    """Population standard deviation of the attributions: what drives differences between rows."""
    return _stack(wide, [F.struct(F.lit(f).alias("feature"), F.stddev_pop(f"shap_{f}").alias("shap_std")) for f in features])


def dependence_table(long: DataFrame, importance: DataFrame, k: int) -> DataFrame:
    """Feature values with attributions for the k most important features."""
    top = top_k_features(importance, "mean_abs_shap", k).select("feature")
    return long.join(F.broadcast(top), "feature", "left_semi")


def shap_sampled(
    df: DataFrame,
    model,
    features: Sequence[str],
    key: Sequence[str],
    background: DataFrame,
    permutations: int = 8,
    background_rows: int = 100,
    tag: str = "shap",
    prediction: str = "prediction",
) -> DataFrame:
    """Permutation-sampled Shapley values of any fitted stage, one model evaluation pass.

    A row is expanded to permutations x (features + 1) steps; in step j the first j
    features of the permutation hold the row's values and the rest those of a hashed
    background row. A step's prediction counts for the feature just added and
    against the next one, so the values come from one aggregate per row, without
    ordering the steps. They sum to the prediction minus the mean background
    prediction. The background is a hash sample of
    `background_rows` rows, carried as one array.
    """
    features = list(features)
    p = len(features)
    sampled = (
        background.select(digest(tag, key[0]).alias("h"), *key, *features)
        .orderBy("h", *key)
        .limit(background_rows)
        .agg(F.array_sort(F.collect_list(F.struct("h", *key, *features))).alias("b"))
    )
    orders = permutation_rows(features, permutations, tag)
    steps = F.array(
        *[
            F.struct(F.lit(r).alias("rep"), F.lit(j).alias("step"), F.lit(order[j - 1] if j else None).alias("added"),
                     F.lit(order[j] if j < p else None).alias("next"), F.array(*[F.lit(order.index(f) < j) for f in features]).alias("own"))
            for r, order in enumerate(orders)
            for j in range(p + 1)
        ]
    )
    reference = sampled.scalar()
    rows = df.select(*key, *features, F.explode(steps).alias("s"))
    pick = F.pmod(bits_of(hex_draw(digest(F.concat(F.lit(f"{tag}:"), F.col("s.rep").cast("string")), key[0]), 0)), F.size(reference))
    rows = rows.withColumn("__b", F.get(reference, pick.cast("int"))).select(
        *key,
        F.col("s.step").alias("__step"),
        F.col("s.added").alias("__added"),
        F.col("s.next").alias("__next"),
        *[F.when(F.col("s.own")[i], F.col(f)).otherwise(F.col("__b")[f]).alias(f) for i, f in enumerate(features)],
    )
    if isinstance(model, LinearModel):
        scored = rows.withColumn(prediction, model.predict())
    else:
        scored = model.transform(rows)
    y = F.col(prediction)
    zero = F.lit(0.0)
    share = [
        (
            F.sum(F.when(F.col("__added") == f, y).otherwise(zero) - F.when(F.col("__next") == f, y).otherwise(zero))
            / permutations
        ).alias(f"shap_{f}")
        for f in features
    ]
    return scored.groupBy(*key).agg(
        (F.sum(F.when(F.col("__step") == 0, y)) / permutations).alias("base"),
        (F.sum(F.when(F.col("__step") == p, y)) / permutations).alias("prediction"),
        *share,
    )
