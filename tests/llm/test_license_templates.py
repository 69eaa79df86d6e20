"""Template labels, scores and spans against all runs of words, for templates of any length."""

import math
import random

from joinlab.llm import license_scan
from joinlab.llm.license_scan import SHORT, SPREAD, THRESHOLD, TemplateIndex, words_of


def best_of(words, text):
    """The largest containment over all runs, and whether it meets the template."""
    want = words_of(text.encode())
    reach, kinds = math.ceil(len(want) * SPREAD), set(want)
    need = len(kinds) if len(want) < SHORT else math.ceil(THRESHOLD * len(kinds) - 1e-9)
    most = max((len(kinds & set(words[i : i + reach])) for i in range(len(words))), default=0)
    return most / len(kinds), most >= need


def test_random_templates():
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(900)]
    templates = [(f"t{k}", " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate((5, 12, 40, 150, 400, 700, 1000, 2000))]
    found = 0
    for case in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 600))]
        _, text = rng.choice(templates)
        own = text.split()
        keep = rng.choice((1.0, 0.9, 0.8, 0.6))
        words += [w for w in own if rng.random() < keep] + [rng.choice(vocabulary) for _ in range(rng.randint(0, 300))]
        frequency = {w.encode(): rng.randint(0, 50) for w in vocabulary}
        raw = [w.encode() for w in words]
        _, spans = TemplateIndex({}, templates, frequency).scan(raw)
        got = {}
        for a, b, k, c in spans:
            assert c == len(set(raw[a:b]) & set(templates[k][1].encode().split())) / len(set(templates[k][1].split()))
            got[k] = max(got.get(k, 0), c)
        want = {k: score for k, (_, t) in enumerate(templates) for score, meets in [best_of(raw, t)] if meets}
        assert got == want
        found += len(want)
    assert found > 20


def test_filters_prune():
    index = TemplateIndex({}, [("a", " ".join(f"x{i}" for i in range(30))), ("b", " ".join(f"y{i}" for i in range(30)))], {})
    rare = sorted((f"x{i}".encode() for i in range(30)), key=index.rank)
    assert not index.passes(rare[:10], 0)  # length
    tokens = sorted([*rare[-20:], *(f"y{i}".encode() for i in range(30))], key=index.rank)
    assert len(tokens) >= 24 and not index.passes(tokens, 0)  # position: the first shared word comes too late


def test_whole_notices(spark):
    texts = {label: text for label, text in license_scan.TEMPLATES if len(text) > 300}
    rows = [(k, f"Some words before. {t.upper()} Some after.") for k, t in enumerate(texts.values())] + [(9, "licensed under CC BY 4.0"), (10, "Released under the Apache License")]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, label in enumerate(texts):
        assert label in got[k].labels.split(",") and got[k].score == 1.0 and any(s.label == label and s.containment == 1.0 and s.start == 3 for s in got[k].spans)
    assert got[9].labels == "cc-by" and got[10].labels == ""
