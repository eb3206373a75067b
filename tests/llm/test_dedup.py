"""Line, SimHash and substring dedup, components and decontamination against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quadloom.llm import components, decontam, line_dedup, simhash, substring


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def brute_lines(docs, least):
    """Deleted line numbers: all windows of lines with enough words that begin earlier too."""
    listed = [(i, [x for x in t.split("\n") if x.split()]) for i, t in sorted(docs)]
    seen, gone = set(), {i: set() for i, _ in listed}
    for i, lines in listed:
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[a:b]) >= least:
                    key = tuple(lines[a:b])
                    if key in seen:
                        gone[i].update(range(a, b))
                    seen.add(key)
    return gone


@pytest.mark.parametrize("seed", range(3))
def test_lines(spark, seed):
    rng = random.Random(seed)
    pool = ["a", "b c", "d e f", "g", "h i j k l m", "", "n o"]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12)))) for i in range(60)]
    want = brute_lines(docs, 5)
    got = line_dedup.dedup_lines(frame(spark, docs)).collect()
    for r in got:
        lines = dict(docs)[r.doc_id].split("\n")
        full = [k for k, x in enumerate(lines) if x.split()]
        out = {full[k] for k in want[r.doc_id]}
        assert r.n_deleted == len(out) and r.kept_text == "\n".join(x for k, x in enumerate(lines) if k not in out)


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, linked):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    return root


def test_simhash(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))] for _ in range(40)]
    docs = []
    for words in base:
        for _ in range(4):
            copy = list(words)
            for _ in range(rng.randrange(0, 3)):
                if copy:
                    copy[rng.randrange(len(copy))] = rng.choice(vocabulary).upper()
            docs.append((len(docs), rng.choice([" ", "  ", "\n"]).join(copy)))
    prints = {i: fingerprint(t) for i, t in docs}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    want = groups(list(prints), links)
    got = simhash.near_duplicates(frame(spark, docs)).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == {i: (prints[i], want[i]) for i in prints}
    kept = simhash.keep_one(frame(spark, docs)).collect()
    assert {r.doc_id for r in kept} == set(want.values())


def test_cells_lose_no_pair():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    y = x.copy()
    for k in range(4):
        y ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    assert [simhash.groups_for(n) for n in (0, 10**6, 10**8, 10**9, 10**10)] == [6, 6, 7, 8, 9]
    for groups in (6, 8, 9):
        assert np.any([(simhash.embed(x) & np.uint64(m)) == (simhash.embed(y) & np.uint64(m)) for m in simhash.cell_masks(groups)], axis=0).all()
    masks = simhash.cell_masks()
    a, b = simhash.embed(x), simhash.embed(y)
    assert np.any([(a & np.uint64(m)) == (b & np.uint64(m)) for m in masks], axis=0).all()
    assert (np.bitwise_count(a ^ b) <= np.bitwise_count(x ^ y)).all() and simhash.near(x, y).all()


@pytest.mark.parametrize("hot", [1 << 16, 100])
def test_crowded_cells(spark, hot):
    """Fingerprints that all share cells come out in one component, by blocks, gathered first or not."""
    rng = random.Random(9)
    prints = {0}
    while len(prints) < 250:
        p = rng.choice(sorted(prints))
        prints.add(p ^ (1 << rng.randrange(16)))
    far = (1 << 62) | (1 << 50) | (1 << 45) | (1 << 40) | (1 << 35) | (1 << 33)
    df = spark.createDataFrame([(p,) for p in prints] + [(far,)], "fingerprint long")
    links = simhash.link_fingerprints(df, groups=7, cell=40, hot=hot, counted=64).collect()
    cells, blocks = simhash.hot_cells(df, simhash.cell_masks(), 40, hot, 64)
    assert (len(cells) > 0) == (hot == 100) and (blocks >= 3).all()
    assert len(groups([*prints, far], links)) == 251 and len(set(groups([*prints, far], links).values())) == 2


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, i) for i in range(5001, 5200)]
    want = groups({x for p in links for x in p}, links)
    df = spark.createDataFrame(links, "u long, v long")
    got = {r.node: r.root for r in components.components(df).collect()}
    assert got == {r.node: r.root for r in components.components(df, one_task=0).collect()}
    assert got == {n: r for n, r in want.items() if n in got} and {n for n in want if sum(x == want[n] for x in want.values()) > 1} == set(got)


def brute_contamination(text, items):
    words = decontam.item_words(text)
    hit, found = set(), set()
    for item, body in items:
        w = decontam.item_words(body)
        n = min(len(w), 10)
        for a in range(len(w) - n + 1 if w else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[a : a + n]:
                    hit.update(range(i, i + n))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block", [200_000, 12])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontam.item_blocks, "__defaults__", (block,))
    rng = random.Random(6)
    pool = ["The", "cat", "é", "sat", "on", "7", "mat", "a"]
    say = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choice(pool) for _ in range(n))
    items = [(i, say(rng.choice([0, 1, 2, 5, 9, 10, 11, 25]))) for i in range(14)] + [(3, "cat sat on")]
    docs = [(i, say(rng.randrange(0, 60)) + (" " + rng.choice(items)[1] if i % 2 else "") + say(3)) for i in range(60)]
    got = decontam.mark_contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    for r in got:
        want = brute_contamination(r.text, items)
        assert (r.n_words, r.n_hit, r.item_ids) == want
        if not r.n_hit:
            assert r.clean_text == r.text
        assert sum(len(decontam.item_words(r.text.encode()[s.start : s.end].decode())) for s in r.hit_spans) == r.n_hit


def test_substrings(spark):
    """Planted passages, exact and edited, link their texts; others stand alone."""
    rng = random.Random(11)
    vocabulary = [f"t{i}" for i in range(3000)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs, want = [], []
    for k in range(30):
        passage = say(60 + k * 3)
        edited = list(passage)
        if k % 3 == 1:  # one word in the middle: five of the shingles differ
            edited[len(edited) // 2] = "changed"
        one, two = say(rng.randrange(0, 150)) + passage + say(rng.randrange(0, 150)), say(rng.randrange(0, 90)) + edited + say(rng.randrange(0, 90))
        docs += [(2 * k, " ".join(one)), (2 * k + 1, "\n".join(two))]
        want.append(len(passage))
    docs += [(100 + i, " ".join(say(120))) for i in range(30)] + [(200, docs[0][1]), (201, "short text"), (202, "short text")]
    got = {r.doc_id: r for r in substring.dedup_substrings(frame(spark, docs)).collect()}
    for k in range(30):
        assert got[2 * k].class_id == got[2 * k + 1].class_id == 2 * k, k
        assert abs(got[2 * k + 1].n_dup_words - want[k]) <= 4
    assert all(got[i].class_id == i and got[i].n_dup_words == 0 for i in [*range(100, 130), 201, 202])
    assert got[200].class_id == 0 and got[200].n_dup_words == got[200].n_words


def test_passages_around_common_words(spark):
    """Two texts that share a passage are linked, though every text has most of its words."""
    rng = random.Random(3)
    say = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    for common in (say(20), say(35), say(45)):
        docs = []
        for k in range(100):
            passage = say((55 - len(common)) // 2) + common + say((56 - len(common)) // 2)
            docs += [(2 * k + i, " ".join(say(60) + passage + say(60))) for i in range(2)]
        got = {r.doc_id: r.class_id for r in substring.dedup_substrings(frame(spark, docs).repartition(4)).collect()}
        assert got == {i: i - i % 2 for i in range(200)}


def test_equal_passages_share_a_run():
    """Whatever is around them, equal passages have a token of the last function in common."""
    rng = np.random.default_rng(4)
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    for _ in range(50):
        passage, seen = draw(46), []
        for _ in range(2):
            hashes = np.concatenate([draw(int(rng.integers(0, 90))), passage, draw(int(rng.integers(0, 90)))])
            found = substring.all_windows(hashes, np.array([0, len(hashes) + 4]), np.array([len(hashes) + 4]), 46)
            assert len(found) == substring.HASHES + 1
            seen.append(set(found[-1][0].tolist()))
        assert seen[0] & seen[1]
    short = draw(45)
    assert substring.all_windows(short, np.array([0, 49]), np.array([49]), 46) == []


def test_compact_windows():
    """Each window's shingle is the least of all of it, and of nothing wider; all long passages are in one."""
    rng = np.random.default_rng(8)
    hashes = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    first, count = np.array([0, 250, 404]), np.array([250, 154])
    for f, (value, row, c, left, right) in enumerate(substring.compact_windows(hashes, first, count, 20)):
        own = substring.mix(hashes ^ substring._seed(f)) >> np.uint64(32)
        end = first[:-1] + count - 4
        wins = [(int(first[r] + x - a), int(first[r] + x), int(first[r] + x + b)) for r, x, a, b in zip(row, c, left, right)]
        for (lo, at, hi), r in zip(wins, row):
            assert own[lo : hi + 1].min() == own[at]
            assert lo == first[r] or at - lo == 63 or own[lo - 1] < own[at]
            assert hi == end[r] - 1 or hi - at == 63 or own[hi + 1] < own[at]
        for r in range(2):
            for s in range(first[r], end[r] - 20 + 1):
                at = s + int(own[s : s + 20].argmin())
                assert any(w[0] <= s and w[1] == at and s + 19 <= w[2] for w in wins)


def brute_classes(docs, least=46, similar=0.8):
    """All pairs of texts, compared whole, and their groups."""
    hashes = {}
    for i, t in docs:
        data, off = substring.text_bytes(pa.array([t]))
        h, _, count = substring.shingles(data, off)
        hashes[i] = h
    links = [(a, b) for a in hashes for b in hashes if a < b and len(hashes[a]) >= least <= len(hashes[b]) and substring.passages(hashes[a], hashes[b], least, similar)]
    return groups(list(hashes), links)


@pytest.mark.parametrize("block", [substring.BLOCK, 6])
def test_classes_against_all_pairs(spark, monkeypatch, block):
    """Common passages just too short to link, and near copies in groups, however they are dealt."""
    monkeypatch.setattr(substring, "BLOCK", block)
    rng = random.Random(block)
    say = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    common, longer, docs = say(34), say(44), []
    for k in range(24):  # pairs around a passage that all have
        passage = say(10) + (common if k % 2 else longer) + say(9)
        docs += [" ".join(say(rng.randrange(20, 50)) + passage + say(20)) for _ in range(2)]
    for k in range(4):  # copies with edits, some too many
        base = say(160)
        for c in range(8):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(0, 2)] = say(1)
            docs.append(" ".join(copy[: rng.randrange(60, 160)]))
    docs += [" ".join(say(40) + common + say(10)) for _ in range(10)] + [" ".join(common + say(30)) for _ in range(10)]
    docs = list(enumerate(docs))
    want = brute_classes(docs)
    for parts in (1, 4):
        got = {r.doc_id: r.class_id for r in substring.dedup_substrings(frame(spark, docs).repartition(parts)).collect()}
        assert got == want
    assert 30 < len(set(want.values())) < 70


def test_recall_of_edited_passages(spark):
    """Of pairs that share one passage of a similarity from 0.8 to 0.9, nearly all are found."""
    rng = random.Random(12)
    say = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    docs = []
    for _ in range(150):
        passage = say(60)
        other = list(passage)
        other[rng.randrange(8, 52)] = "edited"  # 5 of 56 shingles differ: 51 / 61
        docs += [" ".join(say(60) + passage + say(60)), " ".join(say(60) + other + say(60))]
    docs = list(enumerate(docs))
    got = {r.doc_id: r.class_id for r in substring.dedup_substrings(frame(spark, docs)).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(150)) >= 0.97 * 150


def test_all_texts_of_crowded_groups(spark):
    """Many near copies are one class, however the texts fall into tasks, and few of their pairs are compared."""
    rng = random.Random(6)
    say = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    base, docs = say(120), []
    for k in range(40):
        copy = list(base)
        copy[30 + k] = f"own{k}"
        docs.append((k, " ".join(copy)))
    for parts in (1, 5):
        df = frame(spark, docs).repartition(parts)
        got = substring.dedup_substrings(df).collect()
        assert {r.doc_id: r.class_id for r in got} == {k: 0 for k in range(40)} and all(r.n_dup_words >= 100 for r in got)
        links = substring.link_passages(df.withColumn("tag", F.xxhash64("text")))
        assert links.select("a", "b").distinct().count() < 40 * 10


def test_every_window_is_sent():
    """Of a hash that several texts of a task have, each text's window goes on, and other tasks hear of it."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**7)}" for _ in range(80)]
    texts = [" ".join([*base, f"own{k}"]) for k in range(30)]
    made = []
    for tags in (range(29), [29]):
        tags = list(tags)
        batch = pa.RecordBatch.from_arrays([pa.array(tags, pa.int64()), pa.array([texts[k] for k in tags])], ["tag", "text"])
        made += substring._sketch(iter([batch]), 46, 4)
    out = []
    for bucket in range(4):
        out += substring._shared((b.filter(pa.compute.equal(b.column("bucket"), bucket)) for b in made), 4)
    rows = substring._read(iter(out), 3)
    data, off = substring.text_bytes(pa.array(texts))
    every = [(v, r) for value, row, *_ in substring.all_windows(*substring.shingles(data, off), 46) for v, r in zip(value.tolist(), row.tolist(), strict=True)]
    count = {}
    for v, r in set(every):
        count[v] = count.get(v, 0) + 1
    assert {(v, r) for v, r in rows[:, :2].tolist()} == {x for x in every if count[x[0]] > 1}


def test_common_hashes():
    rng = np.random.default_rng(3)
    near = [np.unique(rng.integers(0, 300, 60).astype(np.int32)) for _ in range(20)]
    left, right = np.arange(12), np.arange(12, 20)
    want = [[len(np.intersect1d(near[i], near[j])) for j in right] for i in left]
    assert (substring._common(near, left, right) == want).all() and (substring._common(near, left, left).diagonal() >= 0).all()


def test_repeated_words():
    """Runs of one word are passages too, wherever they change to the next word."""
    a = np.array([1] * 90 + [2, 3, 4, 5] + [6] * 70, np.uint32)
    b = np.array([9] * 20 + [1] * 30 + [2, 3, 4, 5] + [6] * 30, np.uint32)
    found = substring.passages(a, b, 46)
    assert any(x <= 80 and y >= 100 and p <= 40 and q >= 60 for x, y, p, q, _ in found)
    c = np.array([1] * 60 + [2, 3, 4, 5] + [6] * 25, np.uint32)
    assert any(y - x >= 49 for x, y, *_ in substring.passages(c, b, 46))
    same = np.zeros(60, np.uint32)
    assert substring.passages(same, same[:50], 46) and not substring.passages(same, same[:40], 46)


def test_classes_meet_in_their_cell():
    """A cell hands on the pairs that connect its classes, not all that have much in common."""
    rng = np.random.default_rng(7)
    draw = lambda n: rng.integers(0, 1 << 32, n, dtype=np.uint32)
    block = draw(42)  # too short to link
    near = [np.concatenate([draw(40), block, draw(40)]).tobytes() for _ in range(60)]
    base = draw(120)
    for k in range(40):
        copy = base.copy()
        copy[k + 40] = draw(1)[0]
        near.append(copy.tobytes())
    tag = rng.permutation(100).astype(np.uint64)
    rows = np.arange(100)
    found = list(substring._connect(tag, tag, near, rows, rows, 46, 0.8))
    assert len(found) == 39 and groups(range(100), [(x, y) for x, y, _ in found]) == {k: min(k, 60) for k in range(100)}
    assert list(substring._connect(tag, np.zeros(100, np.uint64), near, rows, rows, 46, 0.8)) == []
    half = substring._connect(tag, tag, near, rows[:80], rows[80:], 46, 0.8)
    assert len({x for i, j, _ in half for x in (i, j)}) == 40


def test_passage_wherever_it_ends():
    """A similar stretch is found though cutting a chain at its widest step hides it."""
    rng = np.random.default_rng(9)
    for _ in range(200):
        a = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        b = a.copy()
        for at in rng.integers(0, 100, 5):
            b[at : at + 5] = rng.integers(0, 1 << 63, len(b[at : at + 5]), dtype=np.uint64)
        met = np.concatenate([[0], np.cumsum(a == b)])
        some = any(a[x] == b[x] and a[y] == b[y] and (m := met[y + 1] - met[x]) / (2 * (y - x + 1) - m) >= 0.8 for x in range(55) for y in range(x + 45, 100))
        assert bool(substring.passages(a, b, 46)) == some
