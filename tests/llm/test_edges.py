"""Odd rows for every operator: nulls, empty and very long texts, repeats, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

from quadloom.llm import decontam, language_id, line_dedup, merkle, packing, quality_rules, simhash, substring, toxicity, zstd_quality

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000)) + "\n" + "line " * 50
ROWS = [
    (1, "The first plain text has some words in it and goes on for a while.\nSecond line of it here today."),
    (1, "The first plain text has some words in it and goes on for a while.\nSecond line of it here today."),
    (2, None), (3, ""), (4, " \n\t \n"), (5, "..."), (6, "é"), (None, "a text without an id that is long enough to count as one"), (None, None),
    (7, LONG), (8, LONG), (9, "x" * 200_000), (10, "\n".join(["same line again and again"] * 400)),
]
SCHEMA = "doc_id long, text string, score string, n_words string, Fingerprint string, component_id string, kept string, extra int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "s", "w", "f", "c", "k", 7) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "has some words in it and goes on for a while"), (2, None), (3, ""), (3, "é"), (None, "odd item")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 1), (1, 0, None), (None, 1, 1), (7, 0, 0), (8, None, 1), (10, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")


def texts(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "") for r in df.collect()))


def runs(docs, bench, labels):
    model = language_id.learn(docs.withColumn("lang", F.when(F.col("doc_id") < 4, "aa").otherwise("bb")))
    return {
        "decontam": decontam.mark_contamination(docs, bench),
        "clean": decontam.decontaminate(docs, bench),
        "empty benchmark": decontam.mark_contamination(docs, bench.limit(0)),
        "rules": quality_rules.rate(docs),
        "lines": line_dedup.dedup_lines(docs),
        "lang": language_id.identify(docs, model),
        "no lang": language_id.identify(docs, None),
        "tox": toxicity.score(docs, toxicity.learn(docs, labels)),
        "no tox": toxicity.score(docs, toxicity.learn(docs, labels.limit(0))),
        "zstd": zstd_quality.score(docs, zstd_quality.learn(docs, labels)),
        "no zstd": zstd_quality.score(docs, None),
        "simhash": simhash.near_duplicates(docs),
        "keep one": simhash.keep_one(docs),
        "sub": substring.dedup_substrings(docs),
        "pack": packing.pack_documents(docs),
        "records": merkle.records(docs, "doc_id", "extra", "text"),
    }


def test_odd_rows(docs, bench, labels):
    got = {k: v.collect() for k, v in runs(docs, bench, labels).items()}
    for k in ("decontam", "empty benchmark", "rules", "lines", "lang", "no lang", "tox", "no tox", "zstd", "no zstd", "simhash", "sub", "records"):
        assert len(got[k]) == len(ROWS), k
    lines = {r.doc_id: r for r in got["lines"]}
    assert lines[2].kept_text is None and lines[3].kept_text == "" and lines[8].n_deleted == lines[8].n_lines
    assert lines[10].n_lines == 400 and lines[10].n_deleted == 399
    # Rows alike in id and text are one document.
    assert [r.n_deleted for r in got["lines"] if r.doc_id == 1] == [0, 0]
    prints = {r.doc_id: r for r in got["simhash"]}
    assert prints[3].fingerprint == "0" * 16 and prints[4].component_id == 2 and prints[8].component_id == 7
    assert {r.doc_id for r in got["lang"] if r.lang_pred == "und"} == {2, 3, 4, 5, None}
    sub = {r.doc_id: r for r in got["sub"]}
    assert sub[8].class_id == 7 and sub[8].n_dup_words == sub[8].n_words and sub[2].n_dup_words == 0 and sub[3].class_id == 3
    marks = {r.doc_id: r for r in got["decontam"]}
    assert marks[1].item_ids == ["1"] and marks[6].item_ids == ["3"] and marks[2].n_words == 0 and marks[2].clean_text is None
    rules = {r.doc_id: r for r in got["rules"]}
    assert rules[3].base_failed and rules[10].n_dup_lines == 399 and rules[9].n_words == 1 and rules[9].word_chars == 200_000


def test_empty_tables(none, bench, labels):
    for k, v in runs(none, bench, labels).items():
        assert v.count() == 0, k


def test_columns_that_clash_are_replaced(docs, bench):
    out = quality_rules.rate(docs)
    assert [c.lower() for c in out.columns].count("n_words") == 1 and dict(out.dtypes)["n_words"] == "bigint" and dict(out.dtypes)["extra"] == "int"
    assert decontam.decontaminate(docs, bench).columns == docs.columns
    assert simhash.keep_one(docs).columns == docs.columns and line_dedup.without_copies(docs).columns == docs.columns


@pytest.mark.parametrize("names", [("_id", "_gone", "_hit", "_items", "_tag"), ("gone_id", "gone_mark", "mark", "hit_bits", "hit_items"), ("own_tag", "copy_id", "copy_tag", "gone_lines", "n_hit"), ("n_lines", "kept_text", "rejected", "lang_pred", "clean_text")])
def test_working_columns_that_clash(spark, bench, names):
    """Columns called like those that operators work with come through as they were."""
    rows = [(i, t, *range(5)) for i, t in ROWS[:7]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    model = language_id.learn(docs.withColumn("lang", F.lit("aa")))
    for out in (decontam.decontaminate(docs, bench), line_dedup.without_copies(docs), simhash.keep_one(docs), language_id.keep_known(docs, model, least=0)):
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        got = out.collect()
        assert got and all(r[2:] == (0, 1, 2, 3, 4) for r in got)


def test_one_document_of_each_group(spark):
    """Of rows that share an id and differ in text, and of rows without an id, one of each group stays."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = b + " "
    rows = [(3, b), (5, a), (5, b), (None, c), (None, c + "\n"), (None, b), (7, near), (None, a)]
    got = [tuple(r) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(x for x in got if x[0]) == [(3, b), (5, a)] and len(got) == 3 and got[[x[0] for x in got].index(None)][1].strip() == c


def test_audit_of_empty_archives(docs, none):
    side = merkle.records(none, "doc_id", "extra", "text")
    assert merkle.audit(side, side).count() == 0
    full = merkle.records(docs, "doc_id", "extra", "text")
    assert {r.fault for r in merkle.audit(full, side).collect()} == {"missing"}
    assert merkle.audit(full, full).count() == 0
