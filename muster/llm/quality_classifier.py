"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics (``FEATURES``) of every whole text are computed in one Arrow pass and written once.  The trees
are fitted on at most ``sample`` labelled rows, the ones of least hash of their doc_id (so the bound and
the sample don't depend on the order of rows): features are cut into at most 64 bins at quantiles, each
tree is grown level by level from gradient and hessian histograms, and leaves are Newton steps of the
logistic loss.  The fitted trees are flattened into arrays (feature, cut, left child, value) in one
numbering, and scoring walks all rows through a tree at once: node = left[node] + (x > cut).

Defined results: a null text has the statistics of an empty one; both are scored; the score is 0.5 if no
label can be learned from; rows that repeat a doc_id are scored alike, repeated labels count each; labels
without a document, or null, are skipped; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .quality_rules import _lines, _repeats, _sums
from .tables import crc_mod, kept, table

FEATURES = (
    "log_words", "log_chars", "mean_word", "letter_share", "upper_share", "digit_share", "symbol_rate", "mark_rate", "end_rate",
    "words_a_line", "dup_line_share", "repeat_share", "distinct_share", "stutter_share", "top_word_share", "blank_share", "wide_share", "bars_rate",
)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


_UPPER, _LOWERED, _DIGIT = (_class(bytes(range(a, b))) for a, b in ((65, 91), (97, 123), (48, 58)))
_SYMBOL, _MARK, _END, _BAR = _class(b"#*$%&|<>"), _class(b"!?"), _class(b".,;:"), _class(b"|")


def statistics(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """[documents, FEATURES] of a block."""
    n = len(offs) - 1
    start, end, doc = T.words(buf, offs)
    h = T.span_hash(p := T.prefix(buf), start, end)
    per = T.per_doc(doc, n)
    words = np.diff(per)
    size = np.diff(offs)
    count = lambda flags: _sums(flags, offs[:-1], offs[1:])
    over = lambda a, b: a / np.maximum(b, 1)
    wide = buf >= 0x80
    lead = (buf & 0xC0) != 0x80
    chars, upper, lower = count(lead), count(_UPPER[buf]), count(_LOWERED[buf])
    ls, le, ldoc = _lines(buf, offs)
    full = np.searchsorted(start, le) > np.searchsorted(start, ls)
    lines = np.bincount(ldoc[full], minlength=n)
    unique_lines = np.bincount(T.distinct(ldoc[full], T.span_hash(p, ls[full], le[full]))[0], minlength=n)
    order = np.lexsort((h, doc))
    d, s = doc[order], h[order]
    new = np.append(True, (d[1:] != d[:-1]) | (s[1:] != s[:-1])) if len(s) else np.zeros(0, bool)
    runs = np.diff(np.append(np.flatnonzero(new), len(s)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, d[new], runs)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    letters = upper + lower + count(wide & lead)
    return np.stack([
        np.log1p(words), np.log1p(chars), over(chars - count(T.BLANK[buf]), words), over(letters, chars), over(upper, upper + lower), over(count(_DIGIT[buf]), chars),
        over(count(_SYMBOL[buf]), words), over(count(_MARK[buf]), words), over(count(_END[buf]), words), over(words, lines), over(lines - unique_lines, lines),
        over(_repeats(h, doc, n), words), over(np.bincount(d[new], minlength=n), words), over(np.bincount(doc[again], minlength=n), words), over(top, words),
        over(count(T.BLANK[buf]), size), over(count(wide), size), over(count(_BAR[buf]), words),
    ], 1).astype(np.float64)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, buf, offs, _ in T.blocks(batch):
            x = statistics(buf, offs)
            yield pa.record_batch([batch.column("doc_id").slice(i, j - i), *(pa.array(x[:, k]) for k in range(x.shape[1]))], ["doc_id", *FEATURES])


class Trees:
    """Gradient-boosted trees as flat arrays; ``root[t]`` is the first node of tree t."""

    def __init__(self, base: float):
        self.base, self.root = base, []
        self.feature, self.cut, self.left, self.value = (np.zeros(0, t) for t in (np.int32, np.float64, np.int32, np.float64))

    def add(self, feature: list[int], cut: list[float], left: list[int], value: list[float]) -> None:
        at = len(self.feature)
        self.root.append(at)
        self.feature = np.append(self.feature, np.array(feature, np.int32))
        self.cut = np.append(self.cut, cut)
        self.left = np.append(self.left, np.array(left, np.int32) + at)
        self.value = np.append(self.value, value)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.root:
            node = np.full(len(x), root)
            while True:  # a leaf is its own left child with an infinite cut
                down = self.left[node] + (x[rows, self.feature[node]] > self.cut[node])
                if (down == node).all():
                    break
                node = down
            out += self.value[node]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 5.0, least: int = 10) -> Trees:
    """Boosted trees for labels y in {0, 1}."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    out = Trees(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return out
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1)  # bin b: cuts[b - 1] < x <= cuts[b]
    raw = np.full(len(y), out.base)
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-raw))
        grad, hess = prob - y, prob * (1 - prob)
        feature, cut, left, value = [0], [np.inf], [0], [0.0]
        node, level = np.zeros(len(y), np.int64), [0]
        for deep in range(depth + 1):
            number = {v: i for i, v in enumerate(level)}
            at = np.array([number.get(v, -1) for v in range(len(feature))])[node]
            live = np.flatnonzero(at >= 0)
            g, h, c = (np.bincount(at[live], w, minlength=len(level)) for w in (grad[live], hess[live], np.ones(len(live))))
            for v, i in number.items():
                value[v] = -rate * g[i] / (h[i] + ridge)
            if deep == depth:
                break
            best = [(1e-6, -1, -1)] * len(level)
            for k, own in enumerate(cuts):
                cell = at[live] * (len(own) + 1) + binned[live, k]
                gl, hl, cl = (np.cumsum(np.bincount(cell, w, minlength=len(level) * (len(own) + 1)).reshape(len(level), -1), 1)[:, :-1] for w in (grad[live], hess[live], np.ones(len(live))))
                gr, hr, cr = g[:, None] - gl, h[:, None] - hl, c[:, None] - cl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (g**2 / (h + ridge))[:, None]
                gain[(cl < least) | (cr < least)] = -1
                if gain.shape[1]:
                    for i, b in enumerate(gain.argmax(1)):
                        if gain[i, b] > best[i][0]:
                            best[i] = (float(gain[i, b]), k, int(b))
            nxt = []
            for v, i in number.items():
                if best[i][1] < 0:
                    continue
                _, k, b = best[i]
                feature[v], cut[v], left[v] = k, float(cuts[k][b]), len(feature)
                for child in (len(feature), len(feature) + 1):
                    feature.append(0)
                    cut.append(np.inf)
                    left.append(child)
                    value.append(0.0)
                    nxt.append(child)
                rows = live[at[live] == i]
                node[rows] = left[v] + (binned[rows, k] > b)
            level = nxt
            if not level:
                break
        out.add(feature, cut, left, value)
        raw += out.value[out.root[-1] + node]
    return out


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy() for c in FEATURES], 1)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(1 / (1 + np.exp(-shared.value.raw(x))))})

    return run


def labelled_sample(labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, y: at most ``most`` labelled rows, those of least hash of doc_id. A fixed bound: it may be broadcast."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    return known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 40_000, **options) -> DataFrame:
    """doc_id and score of every document. docs: doc_id, text; labels: doc_id and a 0/1 label."""
    spark = docs.sparkSession
    schema = "doc_id long, " + ", ".join(f"{c} double" for c in FEATURES)
    stats = kept(docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_measure, schema))
    rows = stats.join(F.broadcast(labelled_sample(labels, label, sample)), "doc_id").orderBy("doc_id", "y").toArrow()
    x = np.stack([rows.column(c).to_numpy() for c in FEATURES], 1)
    trees = fit(x, rows.column("y").to_numpy().astype(np.float64), **options)
    return stats.mapInArrow(_score(spark.sparkContext.broadcast(trees)), "doc_id long, score double")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 3) != 1)
    scores = quality_scores(table(spark, sf_dir, "documents"), labels)
    return scores.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
