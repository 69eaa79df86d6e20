"""Each stage of the pipeline against a plain version of its decision."""

import hashlib
import random

import pytest

import corpus_pipeline
from joinlab.llm import common, mixing, near_jaccard, rule_ensemble, simhash


@pytest.fixture(scope="module")
def steps(spark):
    folder = "/root/testdata/sf0.001"
    out = [common.table(spark, folder, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(common.store(stage(spark, out[-1], folder), name.replace(" ", "-")))
    return out


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_columns(steps):
    assert all(x.columns == steps[0].columns for x in steps[:-1]) and steps[-1].columns[0] == "doc_id"


def test_quality(spark, steps):
    scores = rule_ensemble.score_documents(steps[0], common.table(spark, "/root/testdata/sf0.001", "labels"))
    good = {r.doc_id for r in scores.collect() if r.predicted}
    assert rows(steps[1]) == [r for r in rows(steps[0]) if r[0] in good] and 0 < len(good) < steps[0].count()


def test_exact(steps):
    last = {}
    for r in rows(steps[1]):
        last[hashlib.sha256((r[1] or "").encode()).digest()] = r
    assert rows(steps[2]) == sorted(last.values())


def test_near(steps):
    fps = [(r[0], simhash.fingerprint((r[1] or "").encode())) for r in rows(steps[2])]
    group = {i: i for i, _ in fps}
    for _ in fps:
        old = dict(group)
        for i, f in fps:
            group[i] = min(group[j] for j, g in fps if (f ^ g).bit_count() <= 4)
        if old == group:
            break
    assert rows(steps[3]) == [r for r in rows(steps[2]) if group[r[0]] == r[0]]


def test_mix_and_pack(steps):
    want = []
    texts = {r[0]: r for r in rows(steps[3])}
    for r in mixing.mix(steps[3]).collect():
        want += [texts[r.doc_id]] * sum(2 * t.words >= r.size for t in r.takes)
    assert rows(steps[4]) == sorted(want)
    totals = {}
    for r in steps[5].collect():
        totals[r.doc_id] = totals.get(r.doc_id, 0) + r.length / r.doc_tokens
    counts = {}
    for r in want:
        counts[r[0]] = counts.get(r[0], 0) + 1
    assert {i: round(n) for i, n in totals.items()} == counts


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def jaccard_survivors(sets):
    """Ids that are the smallest of their component of pairs with Jaccard 0.8 or more, by brute force."""
    group, pairs = {i: i for i in sets}, [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    return {i for i in sets if group[i] == i}


def test_near_finds_all_of_jaccard(steps):
    kept = jaccard_survivors({r[0]: shingles(r[1]) for r in rows(steps[2])})
    assert rows(steps[3]) == [r for r in rows(steps[2]) if r[0] in kept]


def test_near_groups(spark):
    rng = random.Random(5)
    words = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(n)]
    base, line, texts = words(150), words(9), [None, " ", "Two words", "two  WORDS", "x"]
    for k in range(60):
        copy = base[:]
        for _ in range(rng.randint(1, 5)):
            copy[rng.randrange(150)] = f"new{rng.randrange(50)}"
        texts += [" ".join(copy), " ".join(words(40) + line), " ".join(words(3) + line * 3)]
    chain = words(120)
    for k in range(12):
        chain = chain[8:] + words(8)
        texts.append(" ".join(chain))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = jaccard_survivors({i: shingles(t) for i, t in enumerate(texts)})
    assert 20 < len(want) < len(texts) - 40
    for options in ({}, {"most": 0, "rounds": 3}, {"rounds": 0}):
        got = near_jaccard.near_duplicates(docs, **options).collect()
        assert len(got) == len(texts) and {r.doc_id for r in got if r.doc_id == r.component_id} == want
    assert near_jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_near_leaves_few_pairs_to_the_last_join(spark, monkeypatch):
    rng = random.Random(6)
    base, texts = [f"w{rng.randrange(3000)}" for _ in range(150)], []
    for k in range(24):
        copy = base[:]
        copy[rng.randrange(150)] = f"new{k}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = common.store(near_jaccard.shingle_sets(docs).drop("id", "fp"), "sets")
    counts, verified = [], near_jaccard.verified
    monkeypatch.setattr(near_jaccard, "verified", lambda pairs, sets: counts.append(pairs.count()) or verified(pairs, sets))
    roots = near_jaccard.connected_components(near_jaccard.union(near_jaccard.links(sets))).collect()
    assert len(roots) == 24 and len({r.root for r in roots}) == 1
    assert len(counts) > 1 and counts[-1] == 0  # all 276 pairs met in the last join


def test_mix_takes_rows_that_share_an_id_by_themselves(spark):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(5 + k % 7))
    table = [(k if k < 20 else None if k < 40 else 7, text(k), "en", "ab"[k % 2], k) for k in range(60)] + [(5, text(3), "en", "a", 1)] * 3
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    taken = mixing.mix(docs).collect()
    out = rows(corpus_pipeline.mix(spark, docs, "").fillna(-1, ["doc_id"]))
    assert len(out) == sum(2 * t.words >= r.size for r in taken for t in r.takes)
    counts = {r: out.count(r) for r in out}
    inputs = [tuple(-1 if v is None else v for v in r) for r in table]
    assert set(counts) <= set(inputs) and all(n <= 2 * inputs.count(r) for r, n in counts.items())
