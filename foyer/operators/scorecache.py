"""Scores that are kept under the model that made them, so that only what changed is scored again."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foyer.operators import learning


def _told(names) -> Column:
    """The values of a row's columns as one text, nulls included."""
    return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})


def _compared(weights: dict[str, float]) -> list[str]:
    active = [c for c in learning.CRITERIA if weights.get(c, 0) > 0]
    return [n for n in learning.needed(active)]


def digest(likes: DataFrame, dislikes: DataFrame, weights: dict[str, float]) -> str:
    """What a model is: its training rows as they are compared, of each kind, and its weights.

    The training rows are bounded by training_rows(); more than that are an error.
    """
    used = _compared(weights)
    both = [df.select(F.lit(kind).alias("kind"), F.col("id"), _told(used).alias("told")) for kind, df in (("like", likes), ("dislike", dislikes))]
    rows = both[0].unionByName(both[1]).limit(2 * learning.TRAINING_ROWS + 1).collect()
    if len(rows) > 2 * learning.TRAINING_ROWS:
        raise ValueError(f"a model holds at most {learning.TRAINING_ROWS} training rows of a kind")
    import hashlib

    text = json.dumps([sorted((r.kind, r.id, r.told) for r in rows), sorted((c, float(w)) for c, w in weights.items() if w > 0)])
    return hashlib.sha256(text.encode()).hexdigest()


def refreshed(properties: DataFrame, likes: DataFrame, dislikes: DataFrame, weights: dict[str, float], cache: DataFrame | None = None) -> DataFrame:
    """id, model, state, score, rescored: the scores of all properties, of which those in cache are taken from it.

    cache: an earlier result (without rescored).  A score holds for its model (see
    digest()) and for the state of its property, the hash of what is compared.  Where both are
    as they were the score is kept; a property that changed or is new is scored, and a
    reaction that changes the training rows makes another model, for which no score is
    kept.  Properties that went leave the result.
    """
    model = digest(likes, dislikes, weights)
    own = properties.withColumn("state", F.sha2(_told(_compared(weights)), 256))
    if cache is None:
        stale, kept_ = own, None
    else:
        known = cache.filter(F.col("model") == model).select(F.col("id").alias("_id"), F.col("state").alias("_state"), "score")
        same = (F.col("id") == F.col("_id")) & (F.col("state") == F.col("_state"))
        stale = own.join(known, same, "left_anti")
        kept_ = own.select("id", "state").join(known, same).select("id", F.lit(model).alias("model"), "state", "score", F.lit(False).alias("rescored"))
    new = learning.score(stale, likes, dislikes, weights).select("id", F.lit(model).alias("model"), "state", "score", F.lit(True).alias("rescored"))
    return new if kept_ is None else new.unionByName(kept_)
