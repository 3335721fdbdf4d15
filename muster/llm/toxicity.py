"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

Restoration.  A character trigram model is counted over all documents.  A word that shows leetspeak
(``1d10t``), filler between letters (``i.d-i.o_t``), letters three times or more, or a row of single letters
(``i d i o t``) is a noisy reading of a word: at each character the channel offers the letter itself, the
letters that a leet sign stands for, or silence (filler, a repeated letter), each at a cost, and the Viterbi
path of least cost under channel and language model is its restored reading.  A blank of a row of single letters
is silence or the end of a word, so a row can hold several words.  All other words are their own reading, also
those without a letter (numbers).

Score.  Terms are maximal runs of letters (ASCII case folded) of words, and restored readings.  From at most
``sample`` labelled documents (those of least hash) each term gets a log-odds weight if its count differs
between the labels beyond chance (a likelihood ratio over ``least_ratio``); a document has the sums of its
distinct terms' positive and of its negative weights, and a logistic function, fitted on the same sample, of
the two and of their logarithms.

Plan.  Three Arrow passes without a shuffle of texts: trigram counts (28 cubed numbers a task, summed in
Spark), the labelled sample, and the scores.  Readings are remembered by word in each worker (at most
``CACHE``).  Model sizes are bounded by the sample, and no text, word or row of letters is cut: the path is linear in
their length, and the branches of a path share what they have in common.

Defined results: a null or empty text has no terms and gets the score of having none; without labels of both
kinds the score is the share of label 1 (0.5 without labels); rows that repeat a doc_id are scored alike;
labels without a document, or null, are skipped; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .quality_classifier import labelled_sample
from .tables import crc_mod, kept, table

# What a sign can stand for in leetspeak.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
FILLER = ".-_*~'`^,:;/\\ ​‌‍­·"

CACHE = 200_000
#: Costs in nats of the channel: a leet sign, filler, the second and a later letter of a repetition left out,
#: a sign left out.
COST = {"leet": 1.0, "filler": 0.2, "second": 2.5, "later": 0.3, "drop": 9.0}
SIZE = 28  # blank, a to z, any other letter

_CODE = np.zeros(256, np.int64)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_CODE[128:] = 27
_ALPHA = _CODE > 0
_SIGN = np.zeros(256, bool)
_SIGN[np.frombuffer(b"0123456789@$!|+(<", np.uint8)] = True
_FILL = np.zeros(256, bool)
_FILL[np.frombuffer(b".-_*~'`^,:;/\\", np.uint8)] = True


def _wide(buf: np.ndarray, signs: str) -> tuple[np.ndarray, np.ndarray]:
    """Whether each byte belongs to one of the signs of several bytes, and whether it is the first of it."""
    every, lead = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    for sign in signs:
        code = sign.encode()
        if len(code) > 1 and len(buf) >= len(code):
            at = np.flatnonzero(buf[: len(buf) - len(code) + 1] == code[0])
            for k in range(1, len(code)):
                at = at[buf[at + k] == code[k]]
            lead[at] = True
            for k in range(len(code)):
                every[at + k] = True
    return every, lead


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SIZE**3, np.int64)
    for batch in batches:
        for _, _, buf, _, _ in T.blocks(batch):
            code = np.concatenate([[0, 0], _CODE[buf], [0, 0]])
            gram = (code[:-2] * SIZE + code[1:-1]) * SIZE + code[2:]
            total += np.bincount(gram[(code[1:-1] > 0) | (code[2:] > 0)], minlength=SIZE**3)
    at = np.flatnonzero(total)
    yield pa.record_batch({"gram": pa.array(at, pa.int32()), "n": pa.array(total[at])})


def character_model(docs: DataFrame) -> np.ndarray:
    """Cost in nats of each character after two others, [28, 28, 28], counted over all documents."""
    got = docs.select("text").where("text is not null").mapInArrow(_count_trigrams, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(SIZE**3)
    n[got.column("gram").to_numpy()] = got.column("n").to_numpy()
    tri = n.reshape(SIZE, SIZE, SIZE)
    uni = (tri.sum((0, 1)) + 1) / (tri.sum() + SIZE)
    two = (tri.sum(0) + 5 * uni) / (tri.sum((0, 2))[:, None] + 5)
    return -np.log((tri + 5 * two[None]) / (tri.sum(2)[:, :, None] + 5))


def restore(word: str, cost: np.ndarray | list) -> str:
    """The reading of least cost of a noisy word (lower case), or of a row with its blanks: a Viterbi path over
    its character lattice. A state is the last two characters read; a path is a linked list, the last character first."""
    table = cost if isinstance(cost, list) else cost.tolist()
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    last, times = "", 0
    for k, c in enumerate(word):
        if c == " ":
            new = {state: (spent + COST["filler"], path) for state, (spent, path) in best.items()}
            for (a, b), (spent, path) in best.items():
                total = spent + table[a][b][0]
                if b and ((b, 0) not in new or total < new[b, 0][0]):
                    new[b, 0] = (total, (" ", path))
            best = new
            continue
        times = times + 1 if c == last else 1
        long = times > 2 or times == 2 and word[k + 1 : k + 3].strip()[:1] == c  # a doubled letter is spelling
        ways = []
        if "a" <= c <= "z":
            ways.append((0.0, c))
            if long:
                ways.append((COST["second" if times == 2 else "later"], ""))
        elif c in FILLER:
            ways.append((COST["filler"], ""))
        elif c.isalpha():
            ways.append((0.0, c))
        else:
            ways.append((COST["drop"], ""))
        ways += [(COST["leet"], x) for x in LEET.get(c, "")]
        last = c
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (spent, path) in best.items():
            for extra, x in ways:
                if x:
                    code = ord(x) - 96 if x <= "z" else 27
                    state, total = (b, code), spent + extra + table[a][b][code]
                else:
                    state, total = (a, b), spent + extra
                if state not in new or total < new[state][0]:
                    new[state] = (total, (x, path) if x else path)
        best = new
    path = min(((spent + table[a][b][0], n, path) for n, ((a, b), (spent, path)) in enumerate(best.items())), key=lambda x: x[:2])[2]
    read = []
    while path:
        read.append(path[0])
        path = path[1]
    return "".join(reversed(read))


def _suspects(buf: np.ndarray, offs: np.ndarray) -> list[tuple[int, str]]:
    """(document, noisy word) of a block."""
    start, end, doc = T.words(buf, offs)
    if not len(start):
        return []
    sign, sign_lead = _wide(buf, "".join(LEET))
    fill, _ = _wide(buf, FILLER)
    alpha = _ALPHA[buf] & ~sign & ~fill
    sign |= _SIGN[buf]
    odd = np.zeros(len(buf), bool)
    # a sign or filler after a letter and within the word, or a sign before a letter
    inner = sign | fill | _FILL[buf]
    near = np.zeros(len(buf), bool)
    near[1:] |= alpha[:-1]
    after = np.zeros(len(buf), bool)
    after[:-1] |= alpha[1:] | inner[1:]
    odd |= inner & near & after
    odd |= sign & np.append(alpha[1:], False)
    # or a single one after a letter
    lone = sign & (buf < 128)
    lone[1:] &= buf[1:] != buf[:-1]
    lone[:-1] &= buf[:-1] != buf[1:]
    odd |= (lone | sign_lead) & near & (buf != 33) & (buf != 124)
    odd[2:] |= alpha[2:] & (buf[2:] == buf[1:-1]) & (buf[1:-1] == buf[:-2]) & (buf[2:] < 128)
    seen, letters, signs = (np.append(0, np.cumsum(x)) for x in (odd, alpha, sign_lead | _SIGN[buf]))
    many = letters[end] - letters[start]
    noisy = (seen[end] > seen[start]) & ((many >= 2) | (many == 1) & (signs[end] - signs[start] >= 2))
    data = buf.tobytes()
    out = []
    for k in np.flatnonzero(noisy):
        out.append((int(doc[k]), data[start[k] : end[k]].decode().lower()))
    # rows of three or more single letters or signs
    width = np.where(buf[start] < 128, 1, np.where(buf[start] < 224, 2, 3))
    single = (end - start == width) & (alpha[start] & (buf[start] < 128) | _SIGN[buf[start]] | sign_lead[start])
    joins = np.append(False, single[1:] & single[:-1] & (doc[1:] == doc[:-1]))
    first = np.flatnonzero(single & ~joins)
    last = np.flatnonzero(single & ~np.append(joins[1:], False))
    for a, b in zip(first[last - first >= 2], last[last - first >= 2], strict=True):
        out.append((int(doc[a]), " ".join(data[start[k] : end[k]].decode().lower() for k in range(a, b + 1))))
    return out


class _Reader:
    """Distinct (document, term fingerprint) of blocks, with the readings of noisy words."""

    def __init__(self, cost: np.ndarray):
        self.cost, self.known = cost.tolist(), {}

    def read(self, word: str) -> str:
        got = self.known.get(word)
        if got is None:
            got = restore(word, self.cost)
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[word] = got
        return got

    def terms(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.where(_ALPHA[buf], T.LOWER[buf], np.uint8(32))
        start, end, doc = T.words(low, offs)
        h = T.span_hash(T.prefix(low), start, end)
        read = [(d, x) for d, word in _suspects(buf, offs) for x in self.read(word).split(" ") if x]
        if read:
            extra = np.frombuffer("".join(x for _, x in read).encode(), np.uint8)
            stop = np.cumsum([len(x.encode()) for _, x in read])
            h = np.append(h, T.span_hash(T.prefix(extra), np.append(0, stop[:-1]), stop))
            doc = np.append(doc, [d for d, _ in read])
        return T.distinct(doc, h)


def _sample_terms(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(shared.value)
        for batch in batches:
            ids, y = batch.column("doc_id").to_numpy(), batch.column("y").to_numpy()
            for i, j, buf, offs, _ in T.blocks(batch):
                doc, h = reader.terms(buf, offs)
                bounds = T.per_doc(doc, j - i)
                yield pa.record_batch({"doc_id": pa.array(ids[i:j]), "y": pa.array(y[i:j]), "terms": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(h.view(np.int64)))})

    return run


class Model:
    """Term weights (by fingerprint, sorted) and the logistic function of their sums."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray):
        order = np.argsort(terms)
        self.terms, self.weights, self.beta = terms[order], weights[order], None
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.terms >> np.uint64(44)).astype(np.int64)] = True

    def sums(self, doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
        near = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
        if not len(self.terms) or not len(near):
            return np.zeros((n, 4))
        at = np.minimum(np.searchsorted(self.terms, h[near]), len(self.terms) - 1)
        w = np.where(self.terms[at] == h[near], self.weights[at], 0.0)
        up, down = np.bincount(doc[near], np.maximum(w, 0), minlength=n), np.bincount(doc[near], np.maximum(-w, 0), minlength=n)
        return np.stack([up, down, np.log1p(up), np.log1p(down)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.beta[0] + x @ self.beta[1:], -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> None:
        """Newton's method on the penalised logistic loss."""
        one = np.column_stack([np.ones(len(x)), x])
        self.beta = np.zeros(one.shape[1])
        if not len(y) or y.min() == y.max():
            share = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
            self.beta[0] = np.log(share / (1 - share))
            return
        for _ in range(50):
            p = self.score(x)
            step = np.linalg.solve((one * (p * (1 - p))[:, None]).T @ one + ridge * np.eye(len(self.beta)), one.T @ (y - p) - ridge * self.beta)
            self.beta += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-6:
                break


def _sample_sums(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            doc = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            x = shared.value.sums(doc, lists.flatten().to_numpy().view(np.uint64), batch.num_rows)
            yield pa.record_batch([batch.column("doc_id"), batch.column("y"), *(pa.array(x[:, k]) for k in range(4))], ["doc_id", "y", "up", "down", "log_up", "log_down"])

    return run


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, model = shared.value
        reader = _Reader(cost)
        for batch in batches:
            for i, j, buf, offs, _ in T.blocks(batch):
                score = model.score(model.sums(*reader.terms(buf, offs), j - i))
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(i, j - i), "score": pa.array(score)})

    return run


def _entropy_sum(*counts):
    return sum(F.when(c > 0, c * F.log(c)).otherwise(0.0) for c in counts)


def train(docs: DataFrame, labels: DataFrame, cost: np.ndarray, label: str = "toxic", sample: int = 20_000, least_ratio: float = 15.0) -> Model:
    """Weights from at most ``sample`` labelled documents. Terms with a weight are at most as many as the
    sample's terms; in practice a few hundred come to the driver."""
    spark = docs.sparkSession
    chosen = F.broadcast(labelled_sample(labels, label, sample))
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text").join(chosen, "doc_id")
    terms = kept(rows.mapInArrow(_sample_terms(spark.sparkContext.broadcast(cost)), "doc_id long, y int, terms array<long>"))
    n1, n0 = (float(v or 0) for v in terms.agg(F.sum("y"), F.sum(1 - F.col("y"))).first())
    if not n1 or not n0:
        model = Model(np.zeros(0, np.uint64), np.zeros(0))
        model.fit(np.zeros((int(n1 + n0), 4)), np.append(np.ones(int(n1)), np.zeros(int(n0))))
        return model
    counted = terms.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("y").cast("double").alias("a"), F.sum(1 - F.col("y")).cast("double").alias("b"))
    a, b = F.col("a"), F.col("b")
    c, d = F.lit(n1) - a, F.lit(n0) - b
    ratio = 2 * (_entropy_sum(a, b, c, d) + _entropy_sum(F.lit(n1 + n0)) - _entropy_sum(a + b, c + d, F.lit(n1), F.lit(n0)))
    weight = F.log((a + 0.5) / (n1 + 1)) - F.log((b + 0.5) / (n0 + 1))
    got = counted.where(ratio >= least_ratio).select("term", weight.alias("weight")).toArrow()
    model = Model(got.column("term").to_numpy().view(np.uint64), got.column("weight").to_numpy())
    sums = terms.mapInArrow(_sample_sums(spark.sparkContext.broadcast(model)), "doc_id long, y int, up double, down double, log_up double, log_down double")
    rows = sums.orderBy("doc_id", "y").toArrow()
    model.fit(np.stack([rows.column(k).to_numpy() for k in range(2, 6)], 1), rows.column("y").to_numpy().astype(np.float64))
    return model


def toxicity_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id and score of every document. docs: doc_id, text; labels: doc_id and a 0/1 label."""
    cost = character_model(docs)
    model = train(docs, labels, cost, **options)
    shared = docs.sparkSession.sparkContext.broadcast((cost, model))
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_score(shared), "doc_id long, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    scores = toxicity_scores(table(spark, sf_dir, "documents"), labels)
    return scores.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
