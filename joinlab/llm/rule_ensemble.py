"""Quality classifier: a sparse rule ensemble over text statistics, compiled into Spark columns.

1. ``text_stats`` computes the statistics of every whole text in one pass over its bytes.
2. Small regression trees are fitted one after another to the residuals of the ones before (numpy); each
   path from a root to any node is a conjunctive rule.
3. Logistic weights with a lasso penalty are fitted on the rules; most become zero.
4. The rules that keep a weight are compiled into one Spark column expression.

Training reads at most ``max_rows`` labelled rows, the ones with the smallest hash of their id, so the
driver's share is bounded; scoring covers every row. Labels, language, source and ids are no inputs.

Defined results: a null text counts as empty and has zero for every statistic; without usable labels, with
one class only, or where no rule can be drawn (few labels, constant statistics), every score is the share of
label 1 (1.0 without labels); repeated rows are scored each, and an id trains once (ties between its rows go
to the least statistics); several labels of one id count by their mean, rounded; a null id is scored, never
held out and never trains; very long texts are read whole; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinlab.llm.common import drop_stored, small_batches, store, table

STATS = (
    "n_bytes", "n_words", "mean_word", "distinct_words", "top_word", "repeat_next", "distinct_lines", "words_a_line",
    "upper", "digits", "symbols", "stops", "pipes", "bangs", "non_ascii", "short_words", "long_words", "entropy", "max_word", "controls",
)

_CLASS = np.zeros(256, np.uint8)
for _name, _chars in ((1, range(65, 91)), (2, range(97, 123)), (3, range(48, 58)), (4, b"#$%&*+/<=>@[\\]^_`{}~"), (5, b".,;:?'\"()-"), (6, b"|"), (7, b"!"), (8, range(128, 256)), (9, [*range(9), *range(14, 32), 127])):
    for _c in _chars:
        _CLASS[_c] = _name


def stats_of(raw: bytes) -> tuple[float, ...]:
    if not raw:
        return (0.0,) * len(STATS)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=10)
    n = len(raw)
    words = raw.split()
    m = max(len(words), 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen = Counter(words)
    sizes = list(map(len, words)) or [0]
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    p = counts[counts > 0] / n
    letters = max(kinds[1] + kinds[2], 1)
    return (
        float(n), float(len(words)), sum(sizes) / m, len(seen) / m, max(seen.values(), default=0) / m, repeats / m, len(set(lines)) / max(len(lines), 1), len(words) / max(len(lines), 1),
        kinds[1] / letters, kinds[3] / n, kinds[4] / n, kinds[5] / n, kinds[6] / n, kinds[7] / n, kinds[8] / n, sum(s <= 3 for s in sizes) / m, sum(s >= 12 for s in sizes) / m, float(-(p * np.log2(p)).sum()), float(max(sizes)), kinds[9] / n,
    )


def text_stats(docs: DataFrame, key: str = "doc_id", text: str = "text", **carried) -> DataFrame:
    """One row per document: the key, STATS as doubles, and ``carried`` columns (name and expression) as they are."""
    kind, more = docs.schema[key].dataType.simpleString(), list(carried)
    carried_text = f"d{docs.columns.index(text)}" in more  # then it need not travel twice
    at = 1 + (docs.columns.index(text) if carried_text else 0)

    def run(batches):
        for b in batches:
            rows = np.array([stats_of((v.as_py() or "").encode()) for v in b.column(at)], np.float64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(rows[:, i]) for i in range(len(STATS))), *b.columns[len(b.columns) - len(more) :]], names=["key", *STATS, *more])

    texts = [] if carried_text else [F.col(text).alias("t")]
    rows_ = docs.select(F.col(key).alias("key"), *texts, *(c.alias(n) for n, c in carried.items()))
    schema = ", ".join([f"key {kind}", *(f"{s} double" for s in STATS), *(f"{n} {rows_.schema[n].dataType.simpleString()}" for n in carried)])
    return rows_.mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is at most, bound), with its weight."""

    tests: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self):
        tests = " AND ".join(f"{name} {'<=' if at_most else '>'} {bound!r}D" for name, at_most, bound in self.tests)
        return F.expr(f"if({tests or 'true'}, {self.weight!r}D, 0D)")

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, at_most, bound in self.tests:
            v = x[:, STATS.index(name)]
            out &= (v <= bound) if at_most else (v > bound)
        return out


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: list[Rule] = field(default_factory=list)

    def column(self):
        """The score between 0 and 1 as a Spark expression over STATS; the sum is a balanced tree, so plans stay flat."""
        parts = [F.lit(float(self.intercept)), *(rule.column() for rule in self.rules)]
        while len(parts) > 1:
            parts = [sum(parts[i + 1 : i + 2], parts[i]) for i in range(0, len(parts), 2)]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-parts[0]))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule in self.rules:
            total += rule.weight * rule.holds(x)
        return 1 / (1 + np.exp(-total))


def _grow(x: np.ndarray, r: np.ndarray, rows: np.ndarray, depth: int, path: tuple, out: dict, pred: np.ndarray, bins: int = 32) -> None:
    """Splits on the largest drop in squared error; every node's path becomes a rule."""
    pred[rows] = r[rows].mean()
    if path:
        out.setdefault(path)
    if depth == 0 or len(rows) < 20:
        return
    best, total, n = (1e-9, 0, 0.0), r[rows].sum(), len(rows)
    for j in range(x.shape[1]):
        v = x[rows, j]
        cuts = np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
        at = np.searchsorted(cuts, v)  # 0: at most the first cut
        count = np.cumsum(np.bincount(at, minlength=len(cuts) + 1))[:-1]
        total_left = np.cumsum(np.bincount(at, weights=r[rows], minlength=len(cuts) + 1))[:-1]
        ok = (count >= 5) & (n - count >= 5)
        if not ok.any():
            continue
        gain = np.where(ok, total_left**2 / np.maximum(count, 1) + (total - total_left) ** 2 / np.maximum(n - count, 1) - total**2 / n, 0)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], j, cuts[k])
    if best[0] <= 1e-9:
        return
    _, j, cut = best
    left = x[rows, j] <= cut
    for side, at_most in ((rows[left], True), (rows[~left], False)):
        _grow(x, r, side, depth - 1, (*path, (STATS[j], at_most, float(cut))), out, pred, bins)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 5e-4, steps: int = 600, seed: int = 7) -> RuleModel:
    """Trees on residuals, then lasso logistic weights by accelerated proximal steps."""
    if len(y) == 0:
        return RuleModel(40.0)
    share = y.mean()
    if share in (0.0, 1.0):
        return RuleModel(40.0 if share else -40.0)
    rng, found, margin = np.random.default_rng(seed), {}, np.full(len(y), np.log(share / (1 - share)))
    for _ in range(trees):
        rows, pred = rng.permutation(len(y))[: max(200, len(y) // 2)], np.zeros(len(y))
        residual = y - 1 / (1 + np.exp(-margin))
        made: dict = {}
        _grow(x, residual, rows, depth, (), made, pred)
        found |= made
        full = np.zeros(len(y))
        for path in sorted(made, key=len):  # a deeper node's mean replaces its parent's
            inside = Rule(path).holds(x)
            full[inside] = residual[inside].mean() if inside.any() else 0
        margin += 2.0 * full
    prior = float(np.log(share / (1 - share)))
    if not found:
        return RuleModel(prior)  # too few rows, or statistics that do not vary: the share of label 1
    rules = [Rule(p) for p in found]
    a = np.empty((len(y), len(rules)), np.float32)  # the one copy of the rule matrix; it is centred and scaled on the fly
    for k, rule in enumerate(rules):
        a[:, k] = rule.holds(x)
    centre = a.mean(0, dtype=np.float64)
    scale = np.maximum(np.sqrt(centre * (1 - centre)), 0.05)
    gram = (a.T @ a / len(y) - np.outer(centre, centre)) / np.outer(scale, scale)
    times = lambda v: a @ (v / scale).astype(np.float32) - (centre / scale) @ v
    w, b, v, vb, t = np.zeros(len(rules)), prior, np.zeros(len(rules)), prior, 1.0
    step = 4.0 / (float(np.linalg.eigvalsh(gram)[-1]) + 1)
    for _ in range(steps):
        e = 1 / (1 + np.exp(-(times(v) + vb))) - y
        g, gb = (e.astype(np.float32) @ a - centre * e.sum()) / scale / len(y), e.mean()
        nw = v - step * g
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = vb - step * gb
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    kept = [Rule(r.tests, float(c)) for r, c in zip(rules, w / scale, strict=True) if c != 0]
    return RuleModel(float(b - (w / scale * centre).sum()), kept)


#: Labelled rows that training reads at most; the driver holds 21 doubles of each.
TRAIN_ROWS = 20_000
CUTOFF = 0.3


def is_held_out(key: str = "key"):
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def train(stats: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> RuleModel:
    """``stats``: key and STATS; ``labels``: doc_id and quality. Rows held out by their id are never read."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("label"))
    known = known.withColumnRenamed("doc_id", "key").where(~is_held_out())
    # The chosen ids are few, so the statistics meet a short list.
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(max_rows)
    # One row an id, however often it is repeated, so max_rows bounds the rows as well.
    rows = stats.join(chosen, "key").groupBy("key").agg(F.min(F.struct("label", *STATS)).alias("x")).select("x.*").toArrow()
    data = np.stack([c.to_numpy() for c in rows.columns], 1).astype(np.float64).reshape(-1, len(STATS) + 1)
    data = data[np.lexsort(data.T)]  # the model must not depend on the order in which rows arrive
    return fit(data[:, 1:], data[:, 0])


def _scored(stats: DataFrame, labels: DataFrame, *kept: str) -> DataFrame:
    """stats: key, STATS and ``kept``. key, held_out, score and ``kept``."""
    return stats.select("key", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), train(stats, labels).column().alias("score"), *kept)


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    stats = store(text_stats(docs, key, text), "stats")
    # Stored, so that the rules are compiled and run once and never copied into what is asked of the scores.
    scores = store(_scored(stats, labels), "scores")
    drop_stored(stats)
    return scores.select(F.col("key").alias(key), "held_out", "score", F.when(F.col("score") >= CUTOFF, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that are predicted 1, with their columns. The verdict travels in the row, whatever its id."""
    small_batches(docs.sparkSession)
    names = [f"d{i}" for i in range(len(docs.columns))]
    stats = store(text_stats(docs, key, text, **{n: F.col(f"`{c}`") for n, c in zip(names, docs.columns, strict=True)}), "stats")
    scores = _scored(stats, labels, *names).where(F.col("score") >= CUTOFF)
    return scores.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
