"""Type scores as probabilities."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tocsin.operators.calibration import TypeModels, calibration_error, rising_fit, train_type_models
from tocsin.operators.event_types import label_event_types

TYPES = ["FLOOD", "FIRE", "NEVER"]


def least_squares(positives, rows):
    """The rising fit by its definition: the largest least mean over blocks that end and begin around each place."""
    at = np.flatnonzero(rows)
    p, n = positives[at], rows[at]
    mean = lambda a, b: p[a : b + 1].sum() / n[a : b + 1].sum()
    return [max(min(mean(a, b) for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))]


@pytest.mark.parametrize("seed", range(20))
def test_rising_fit(seed):
    rng = np.random.default_rng(seed)
    rows = rng.integers(0, 6, 30)
    positives = np.minimum(rows, rng.integers(0, 6, 30))
    found = rising_fit(positives, rows)
    assert np.allclose(found[rows > 0], least_squares(positives, rows))
    assert (np.diff(found) >= -1e-12).all()


def test_rising_fit_of_nothing():
    assert np.isnan(rising_fit(np.zeros(4), np.zeros(4))).all()


def messages(spark, rows, seed):
    """Of texts with the word for a type, four in five are of the type; of the others one in twenty."""
    rng = np.random.default_rng(seed)
    words, made = [f"w{i}" for i in range(40)], []
    for i in range(rows):
        text, gold = list(rng.choice(words, 6)), []
        for word, kind in (("water", "FLOOD"), ("smoke", "FIRE")):
            marked = rng.random() < 0.3
            text += [word] * int(marked)
            gold += [kind] * int(rng.random() < (0.8 if marked else 0.05))
        made.append((i, " ".join(text), gold))
    return spark.createDataFrame(made, "message_id long, cleaned_text string, event_types array<string>")


def test_scores_are_shares(spark, tmp_path):
    rows = messages(spark, 3000, 1).unionByName(
        spark.createDataFrame([(-1, None, None), (-2, "", ["FIRE"])], "message_id long, cleaned_text string, event_types array<string>")
    )
    models = train_type_models(rows, labels=TYPES, features=1 << 10)
    fresh = messages(spark, 2000, 2)
    scored = models.scores(fresh, name="calibrated").cache()
    errors = {r.label: r for r in calibration_error(scored, "calibrated", "event_types", TYPES).collect()}
    assert [errors[t].rows for t in TYPES] == [2000] * 3 and all(errors[t].error < 0.05 for t in TYPES)
    by_word = scored.groupBy(F.col("cleaned_text").contains("water").alias("w")).agg(F.avg(F.get("calibrated", F.lit(0))).alias("s"))
    shares = {r.w: r.s for r in by_word.collect()}
    assert shares[True] == pytest.approx(0.8, abs=0.07) and shares[False] == pytest.approx(0.05, abs=0.04)

    # The threshold of 0.40 keeps the types that are likelier than that.
    labelled = label_event_types(scored.drop("event_types"), scores_col="calibrated", labels=TYPES).select("cleaned_text", "event_types", "top_label")
    row = labelled.where("cleaned_text like '%water%smoke%'").first()
    assert sorted(row.event_types) == ["FIRE", "FLOOD"]

    models.save(str(tmp_path / "types"))
    again = TypeModels.load(str(tmp_path / "types")).scores(fresh, name="calibrated")
    assert again.exceptAll(scored.select(again.columns)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, "")], "message_id long, cleaned_text string")
    assert len({tuple(r.type_scores_raw) for r in models.scores(odd).collect()}) == 1
    assert models.scores(fresh.limit(0)).count() == 0
