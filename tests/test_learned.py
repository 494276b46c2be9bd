"""The learned scorer: separates what it was shown, the same weights from any partitioning, scores equal plain Python."""

import random

import numpy as np
from pyspark.sql import functions as F

from chatmod import schema as S
from chatmod.functions import learned as L


def examples():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    rows = []
    for i in range(600):
        text = [rng.choice(words) for _ in range(rng.randint(3, 40))]
        toxic, threat = int(i % 3 == 0), int(i % 5 == 0)
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["zorkbad", "Zorkbadly", "quixevil"]))
        if threat:
            text.insert(rng.randrange(len(text)), "watchout")
        rows.append((i, " ".join(text), toxic, threat if i % 2 else None, 1))
    return rows + [(600, None, 0, 0, 1), (601, "", 0, None, 1)]


def ngrams(text):
    """The n-grams of one text, by hand."""
    out, words, word = set(), [], ""
    for b in (text or "").lower().encode() + b" ":
        if b >= 0x80 or chr(b).isalnum():
            word += chr(b)
        elif word:
            words, word = [*words, word], ""
    for w in words:
        w = "\0" + w + "\0"
        out |= {w[i:i + n] for n in L.NGRAMS for i in range(len(w) - n + 1)}
    return {g for g in out if g.strip("\0")}


def test_features_are_the_ngrams_of_words():
    texts = ["one two", "é ab", None, "", "a", "One  two!", "x" * 50]
    bucket, size = L.features(texts)
    assert [len(ngrams(t)) for t in texts] == size.tolist()
    parts = np.split(bucket, np.cumsum(size)[:-1])
    assert parts[0].tolist() == parts[5].tolist()


def test_learned_scores(spark):
    rows = examples()
    frame = spark.createDataFrame(rows, "i long, text string, toxic int, threat int, insult int")
    labels = ["toxic", "threat", "insult"]
    model = L.fit(frame.repartition(2), labels, held=F.col("i") % 4 == 0)
    again = L.fit(frame.repartition(7, "text"), labels, held=F.col("i") % 4 == 0)
    assert model.labels == ["toxic", "threat"] and (model.weights == again.weights).all() and (model.rarity == again.rarity).all()
    assert (model.scale == again.scale).all() and (model.shift == again.shift).all()
    out = model.scorer().score(frame, "text").select("i", "predictions.*").collect()
    logits = model.predict([r[1] or "" for r in rows])
    for r in out:
        want = np.round(1 / (1 + np.exp(-logits[r.i])), 3)
        assert [r[x] for x in S.LABELS] == want.tolist()
        assert r.insult == 0.0 and r.identity_hate == 0.0
    score = {r.i: r for r in out}
    held = [r for r in rows if r[0] % 4 == 0 and r[0] < 600]
    right = [(score[r[0]].toxic >= 0.5) == bool(r[2]) for r in held] + [(score[r[0]].threat >= 0.5) == (r[0] % 5 == 0) for r in held]
    assert np.mean(right) > 0.9
    nothing = L.fit(frame.limit(0), labels)
    assert nothing.labels == [] and (nothing.predict(["a"]) == L.NEVER).all()
