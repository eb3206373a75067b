"""The pipeline's stages, each on its own input, against brute force."""

import random

import corpus_pipeline
from quadloom.llm import decontam
from test_dedup import brute_contamination, brute_lines, fingerprint, groups


def build(spark, tmp_path):
    rng = random.Random(21)
    vocabulary = [f"{a}{b}{c}" for a in ("ka", "lo", "mi") for b in ("ra", "te", "su", "no") for c in ("x", "ba", "di")]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(14))) for i in range(6)]
    rows = []
    for i in range(50):
        lines = [" ".join(say(rng.randrange(1, 9))) for _ in range(rng.randrange(2, 9))]
        if i % 7 == 3:
            lines.insert(1, " ".join(say(3)) + " " + items[i % 6][1] + " end")
        rows.append((i, "\n".join(lines)))
    for i in (2, 11, 30):  # near copies in one line, exact copies, shared lines, and texts to reject
        rows.append((50 + i, rows[i][1].replace("\n", " ", 40)))
        rows.append((100 + i, rows[i][1]))
        rows.append((150 + i, rows[i][1].split("\n")[0] + " and ka lo mi\n" + rows[i + 1][1]))
    rows += [(300, "..."), (301, ""), (302, "12 34\n56"), (303, items[2][1])]
    docs = spark.createDataFrame([(i, t, "aa" if i % 9 else None, "src", len(t)) for i, t in rows] + [(304, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return items


def test_against_brute_force(spark, tmp_path):
    items = build(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    tables = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        tables.append(docs.collect())
    texts = [{r.doc_id: r.text for r in t} for t in tables[:4]]
    first = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()}
    assert texts[0] == {i: t for i, t in first.items() if t and any(c.isalpha() for c in t)}
    gone, want = brute_lines(list(texts[0].items()), 5), {}
    for i, t in texts[0].items():
        lines = t.split("\n")
        full = [k for k, x in enumerate(lines) if x.split()]
        if len(gone[i]) < len(full):
            want[i] = "\n".join(x for k, x in enumerate(lines) if k not in {full[g] for g in gone[i]})
    assert texts[1] == want and len(want) < len(texts[0])
    prints = {i: fingerprint(t) for i, t in texts[1].items()}
    roots = groups(list(prints), [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    assert texts[2] == {i: t for i, t in texts[1].items() if roots[i] == i} and len(texts[2]) < len(texts[1])
    for i, t in texts[2].items():
        n, hit, _ = brute_contamination(t, items)
        if hit > decontam.MAX_COVERAGE * n:
            assert i not in texts[3]
        elif not hit:
            assert texts[3][i] == t
        else:
            assert len(decontam.item_words(texts[3][i])) == n - hit
    assert sum(texts[3].get(i) != t for i, t in texts[2].items()) >= 6
    assert all(r.n_chars == len(r.text) for t in tables[1:4] for r in t)
    packed = tables[4]
    assert {r.doc_id for r in packed} == set(texts[3]) and len({(r.sequence_id, r.offset) for r in packed}) == len(packed)
    again = {(r.doc_id, r.start, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert again == {(r.doc_id, r.start, r.ids_crc32) for r in packed}
