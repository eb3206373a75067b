"""Language identification with more labels than LABELS."""

import random

from quadloom.llm import language_id


def test_every_label_is_learned(spark):
    rng = random.Random(5)
    n = language_id.LABELS + 6
    docs = []
    for k in range(n):
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)]
        for _ in range(6 if k < language_id.LABELS else 4):  # the last ones are the rarest
            docs.append((len(docs), " ".join(rng.choice(own) for _ in range(40)), f"l{k:02}"))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language_id.learn(df)
    assert model.labels == [f"l{k:02}" for k in range(n)]
    assert all(r.lang_pred == r.lang for r in language_id.identify(df, model).collect())
