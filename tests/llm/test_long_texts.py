"""Quality and toxicity where all labelled texts are longer than what the fit takes of one."""

import random

from quadloom.llm import toxicity, zstd_quality


def test_long_texts_are_learned_from(spark):
    rng = random.Random(8)
    clean = [f"word{i}" for i in range(300)]
    docs, marks = [], []
    for k in range(120):
        bad = k % 3 == 0
        words = [rng.choice(clean) for _ in range(1400)]
        if bad:
            for i in range(0, len(words), 20):
                words[i] = rng.choice(["vileness", "hatefully"])
        lines = [" ".join(words[i : i + 14]) for i in range(0, len(words), 14)]
        docs.append((k, "\n".join(lines)))
        marks.append((k, int(bad), int(not bad)))
    assert all(len(t) > toxicity.FIT_CHARS for _, t in docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, quality int")
    want = {k: bad for k, bad, _ in marks}
    tagger = toxicity.learn(df, labels)
    assert {r.doc_id: r.predicted for r in toxicity.score(df, tagger).collect()} == want
    drawn, _ = toxicity.labelled(df, labels, "toxic")
    assert len(drawn) == 120 and all(len(t) == toxicity.FIT_CHARS for *_, t in drawn)
    assert zstd_quality.learn(df, labels) is not None
