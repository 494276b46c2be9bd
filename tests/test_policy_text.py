"""Hand rows for scoring, policy and cleaning (FIXTURES §5: F2-F5)."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from chatmod import schema as S
from chatmod.functions.policy import apply_policy, top_label
from chatmod.functions.scoring import (HashingLinearModel, LexiconScorer, ModelScorer, lexicon_model_loader,
                                       round_score, sigmoid)
from chatmod.functions.text import clean_messages


def test_thresholds_f3(spark):
    scores = [0.499, 0.5, 0.699, 0.7, 0.701, 0.899, 0.9, None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "id int, toxic_score double")
    rows = apply_policy(df).orderBy("id").collect()
    assert [r.recommended_action for r in rows] == ["Safe", "Pending", "Pending", "Hide", "Hide", "Hide", "Ban", "Safe"]
    assert [r.toxic_label for r in rows] == ["Not Toxic"] * 3 + ["Toxic"] * 4 + ["Not Toxic"]


def test_top_label_ties_f4(spark):
    rows = [
        (0, 0.9, 0.1, 0.1, 0.9, 0.2),                # toxic = insult = max → first in list order
        (1, 0.1, 0.5, 0.5000001, 0.2, 0.2),          # within 1e-6 → first in list order
        (2, None, None, None, None, None),           # all null
        (3, None, 0.3, None, 0.8, None),             # nulls skipped
    ]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{l} double" for l in S.LABELS))
    df = df.select("id", F.struct(*S.LABELS).alias("predictions"))
    out = {r.id: r for r in apply_policy(top_label(df)).collect()}
    assert out[0].toxic_category == "toxic" and out[0].toxic_score == 0.9
    assert out[1].toxic_category == "severe_toxic"
    assert out[2].toxic_category is None and out[2].toxic_score is None
    assert out[2].toxic_label == "Not Toxic" and out[2].recommended_action == "Safe"
    assert out[3].toxic_category == "insult" and out[3].recommended_action == "Hide"


def test_clean_messages_f2(spark):
    msgs = ["Hi https://A.b/c  x", "a@b c d", "(www.foo.com) ok", "http://x", None, "  Tab\there\n\nnew  "]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(msgs)], "id int, message string")
    out = {r.id: r.message_clean for r in clean_messages(df).collect()}
    assert out == {0: "hi x", 1: "c d", 2: "( ok", 3: "", 5: "tab here new"}


def test_nfc_f5(spark):
    decomposed = "é"
    df = spark.createDataFrame([(1, decomposed)], "id int, message string")
    out = clean_messages(df).collect()[0].message_clean
    assert out == "\u00e9" and unicodedata.is_normalized("NFC", out)


def test_lexicon_scores(spark):
    texts = ["you idiot", "idiot clown", "trash scum trash scum", "nothing here", "idiotic words", "STUPID"]
    df = clean_messages(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, message string"))
    out = {r.id: r for r in apply_policy(top_label(LexiconScorer().score(df))).collect()}
    assert out[0].predictions.severe_toxic == 0.5 and out[0].recommended_action == "Pending"
    assert out[1].predictions.severe_toxic == 0.75 and out[1].recommended_action == "Hide"
    assert out[2].predictions.toxic == 0.938 and out[2].recommended_action == "Ban"
    assert out[3].toxic_score == 0.0 and out[3].toxic_category == "toxic"   # category set even when safe
    assert out[4].predictions.severe_toxic == 0.0                            # whole words only
    assert out[5].predictions.identity_hate == 0.5                           # lower-cased first


def test_model_scorer_matches_numpy(spark):
    model = HashingLinearModel.from_lexicon()
    texts = ["you idiot", "trash scum trash", "fine", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, message_clean string")
    got = {r.id: r.predictions for r in ModelScorer(lexicon_model_loader).score(df).collect()}
    import numpy as np
    want = np.round(1 / (1 + np.exp(-model.predict(texts))), 3)
    for i in range(len(texts)):
        assert [getattr(got[i], l) for l in S.LABELS] == pytest.approx(list(want[i]))


def test_sigmoid_logits(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (-2.0,)], "x double")
    out = [r.s for r in df.select(round_score(sigmoid(F.col("x"))).alias("s")).collect()]
    assert out == [0.5, 0.881, 0.119]


def test_fast_paths_equal_plain_forms(spark):
    """The ASCII / no-'@' / no-link shortcuts give the same result as the plain chain."""
    from hypothesis import given, settings, strategies as st
    from chatmod.functions.text import nfc, strip_garbage
    from chatmod.schema import GARBAGE_PATTERN

    alphabet = st.sampled_from(list("ab @.:/") + ["\t", "\n", "http://", "https://x.y", "www.", "WWW.",
                                                 "HTTP://Q", "\u00e9", "e\u0301", "\u00df", "A\u030a", "\u000b",
                                                 "\uff71"])
    texts = st.lists(st.lists(alphabet, max_size=12).map("".join), min_size=1, max_size=40)

    @settings(max_examples=5, deadline=None)
    @given(texts)
    def check(batch):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "id int, t string")
        got = df.select("id", strip_garbage(F.lower("t")).alias("g"), nfc(F.col("t")).alias("n"),
                        F.regexp_replace(F.lower("t"), GARBAGE_PATTERN, "").alias("g0")).collect()
        for r in got:
            assert r.g == r.g0
            assert r.n == unicodedata.normalize("NFC", batch[r.id])

    check()


def test_single_pass_lexicon_equals_per_label(spark):
    texts = ["trash-scum trash_scum trashscum", "idiot,idiot;idiot idiots xidiot", "clowné clown éclown",
             "worthless moron worthlessmoron", "pathetic loser loser loser", "", "stupid disgusting stupid"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, message_clean string")
    one = LexiconScorer()
    assert one.single_pass
    many = LexiconScorer({**one.lexicon, "threat": ["worth less", "moron"]})  # a space: per-label passes
    assert not many.single_pass
    a = {r.id: r.predictions for r in one.score(df).collect()}
    b = {r.id: r.p for r in df.select("id", one.predictions(F.col("message_clean")).alias("p")).collect()}
    assert a == b
    assert many.score(df).count() == len(texts)


def test_model_scorer_fused_nfc(spark):
    """``normalize=True`` applies NFC inside the model's own Python hop: decomposed
    text scores as its composed form; a null text scores as the empty text."""
    import unicodedata

    composed = ["café idiot", "naïve trash", None]
    decomposed = [unicodedata.normalize("NFD", t) if t else t for t in composed]
    assert decomposed[0] != composed[0]
    schema = "id int, message_clean string"
    fused = ModelScorer(lexicon_model_loader, normalize=True).score(
        spark.createDataFrame(list(enumerate(decomposed)), schema))
    plain = ModelScorer(lexicon_model_loader).score(
        spark.createDataFrame([(i, t if t is not None else "") for i, t in enumerate(composed)], schema))
    got = {r.id: tuple(r.predictions) for r in fused.collect()}
    want = {r.id: tuple(r.predictions) for r in plain.collect()}
    assert got == want


def test_whole_texts_are_scored(spark):
    """A lexicon word after 20,000 words still counts; the model scorer sees past the
    128 tokens the original truncated to (truncation only on request)."""
    from chatmod.functions.text import clean_messages

    long_text = "fine " * 20000 + "idiot"
    df = spark.createDataFrame([(0, long_text)], "id int, message string")
    lex = LexiconScorer().score(clean_messages(df)).collect()[0]
    assert lex.predictions.severe_toxic == 0.5
    cleaned = clean_messages(df)
    whole = ModelScorer(lexicon_model_loader).score(cleaned).collect()[0].predictions
    cut = ModelScorer(lexicon_model_loader, max_tokens=S.MODEL_MAX_TOKENS).score(cleaned).collect()[0].predictions
    assert whole.severe_toxic > cut.severe_toxic


def test_many_short_lived_models_on_one_worker(spark):
    """Each scorer gets its own model, however many loaders came and went before."""
    import gc

    import numpy as np
    from chatmod.functions import scoring

    class Constant:
        def __init__(self, bias):
            self.bias = bias

        def predict(self, texts):
            return np.full((len(texts), 5), float(self.bias))

    df = spark.createDataFrame([("x",)], "message_clean string").coalesce(1)
    for bias in range(-4, 5):
        got = scoring.ModelScorer(lambda b=bias: Constant(b)).score(df).select("predictions.*").first()[0]
        assert abs(got - 1 / (1 + np.exp(-bias))) < 1e-3
        gc.collect()
    scoring._MODELS.clear()
    for i in range(20):
        scoring._model_for(str(i), lambda: object())
    assert len(scoring._MODELS) == scoring.MODELS_KEPT


def test_long_token_beside_an_address_is_linear(spark):
    import time

    from chatmod.functions.text import clean_messages
    long = "a" * 1_000_000
    df = spark.createDataFrame([(f"{long} b@c.example {long}",)], "message string")
    started = time.time()
    assert clean_messages(df, normalize=False).first().message_clean == f"{long} {long}"
    assert time.time() - started < 20
