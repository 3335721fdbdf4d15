"""Language identification with segmentation-marginalised unigrams.

A fixed public byte-level vocabulary gives the pieces (it is read, never trained).  A language is a
distribution over the pieces, and the probability of a word is the sum over all of its segmentations into
pieces, by the forward algorithm; a text is the product of its words (a blank and the word's bytes).  All
256 single bytes are pieces, so every text has a segmentation.  Pieces with a blank after the first byte fit no word.

Training.  Expectation maximisation over the distinct words of each language, which Spark counts first: expected
piece counts over all segmentations (forward-backward), first under equal probabilities, then under the language's
own, summed per (language, piece) in Spark and smoothed, until the likelihood gains less than ``settled`` of itself
or for ``rounds`` rounds.

Absolute fit.  The languages share a text's probability with ``none of them``, or the best of them would be
sure whatever the text.  That background gives each word the mean of two models without a language, all pieces
equal and bytes by frequency, and is raised by half of what texts of the best language gain over it a byte (the
mean over all words of its training documents, from their counts), so a text that gains less than half of
that is in none.  It starts with odds of ``DOUBT``, so a text of a few letters isn't judged by them.  A word's
gain is that of the mean of all languages (a text in two of them is in some), in lower case if it has two
capitals.  Words without a letter or with a digit (numbers, keys, dates) are in no language and don't count.

Scoring.  One Arrow pass.  The distinct words of a block are scored once for all languages together and
remembered by fingerprint (at most ``CACHE`` words a worker); documents are sums over their words.

Bounds: none on words or pieces.  Words whose probability may underflow are summed in logarithms, and those of many
bytes in windows of ``WINDOW`` ends, so memory is about 40 bytes a byte of the longest word and time is linear in it.
The model is pieces x languages, however large the corpus; more than ``most`` languages are an error, not a cut.

Defined results: lang_pred is the best of the learned languages, and score its share, under 0.5 for a text in
none of them; ``und`` with score 0 for a null text, one without a letter, and if nothing was learned;
ties go to the language that is first by code point; extra columns are ignored; repeated rows are scored
alike; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .tables import BLANKS, crc_mod, scratch, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE, WINDOW = 400_000, 4096
SLOTS = 19
DOUBT = 1e-6

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class Pieces:
    """The vocabulary as a hash table of fingerprints: open addressing, linear probing."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as f:
            pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
        pieces = [p for p in dict.fromkeys(pieces) if p and not any(b in b"\t\n\x0b\x0c\r " for b in p[1:])]
        pieces += [bytes([b]) for b in range(256) if bytes([b]) not in set(pieces)]
        self.n = len(pieces)
        self.buf, self.size = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces])
        self.longest = int(self.size.max())
        buf = self.buf
        end = np.cumsum([len(p) for p in pieces])
        h = T.span_hash(T.prefix(buf), np.append(0, end[:-1]), end)
        self.keys, self.index = np.zeros(1 << SLOTS, np.uint64), np.full(1 << SLOTS, -1, np.int32)
        for k, (x, slot) in enumerate(zip(h, (h >> np.uint64(64 - SLOTS)).tolist(), strict=True)):
            while self.index[slot] >= 0:
                slot = (slot + 1) % (1 << SLOTS)
            self.keys[slot], self.index[slot] = x, k

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each fingerprint, n where there is none."""
        slot = (h >> np.uint64(64 - SLOTS)).astype(np.int64)
        out = np.where(self.keys[slot] == h, self.index[slot], -1)
        open_ = np.flatnonzero((out < 0) & (self.index[slot] >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % (1 << SLOTS)
            out[open_] = np.where(self.keys[slot[open_]] == h[open_], self.index[slot[open_]], -1)
            open_ = open_[(out[open_] < 0) & (self.index[slot[open_]] >= 0)]
        return np.where(out < 0, self.n, out)


class _Lattice:
    """Words of similar length (``own``: their indexes), each with a blank before it."""

    def __init__(self, pieces: Pieces, buf: np.ndarray, start: np.ndarray, size: np.ndarray, own: np.ndarray):
        self.pieces, self.own, self.size, self.longest = pieces, own, size, int(size.max())
        at = start[own] + np.arange(self.longest - 1)[:, None]
        text = np.full((self.longest, len(own)), 32, np.uint64)
        text[1:] = buf[np.minimum(at, len(buf) - 1)]
        self.p = np.zeros((self.longest + 1, len(own)), np.uint64)
        np.cumsum((text + np.uint64(1)) * T.powers(T.BASE, self.longest)[:, None], axis=0, out=self.p[1:])
        self.back = T.powers(T.INVERSE, self.longest + 1)

    def spans(self, lo: int, hi: int) -> np.ndarray:
        """[end - lo - 1, length - 1, word]: the piece of each span that ends after lo and at most at hi, n where none is."""
        most = min(self.pieces.longest, hi)
        found = np.full((hi - lo, most, len(self.own)), self.pieces.n, np.int32)
        for n in range(1, most + 1):
            e = max(lo + 1, n)
            if e <= hi:
                h = T.mix((self.p[e : hi + 1] - self.p[e - n : hi + 1 - n]) * self.back[e - n : hi + 1 - n, None])
                found[e - lo - 1 :, n - 1] = self.pieces.find(h.ravel()).reshape(h.shape)
        return found

    def windows(self) -> list[tuple[int, int]]:
        return [(lo, min(lo + WINDOW, self.longest)) for lo in range(0, self.longest, WINDOW)]


def _lattices(pieces: Pieces, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[_Lattice]:
    size = end - start + 1
    order = np.argsort(size, kind="stable")
    i = 0
    while i < len(order):
        least = size[order[i]]
        j = int(np.searchsorted(size[order], least + least // 4, "right"))
        j = min(j, i + max(1, (1 << 16) // int(size[order[j - 1]])))
        yield _Lattice(pieces, buf, start, size[order[i:j]], order[i:j])
        i = j


def _used(found: np.ndarray, none: int) -> list[int]:
    """The lengths (less 1) of which there is a piece at all."""
    return np.flatnonzero((found != none).any((0, 2))).tolist()


def _safe(prob: np.ndarray) -> float:
    """How many bytes a word may have without its probability underflowing."""
    return 280 / max(-np.log10(prob[:-1].min()), 1e-9)


def _log_sums(lat: _Lattice, log: np.ndarray) -> np.ndarray:
    """[bytes, word, ...]: logarithm of the sum over all segmentations of each word's first bytes."""
    out = np.full((lat.longest + 1, len(lat.own), *log.shape[1:]), -np.inf)
    out[0] = 0
    for lo, hi in lat.windows():
        found = lat.spans(lo, hi)
        used = _used(found, lat.pieces.n)
        for e in range(lo + 1, hi + 1):
            terms = np.stack([out[e - n - 1] + log[found[e - lo - 1, n]] for n in used if n < e])
            top = terms.max(0)
            out[e] = top + np.log(np.exp(terms - top).sum(0))
    return out


def _log(prob: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.maximum(np.log(prob), -1e9)


def score_words(pieces: Pieces, prob: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Log probability of each word under each language. prob: [pieces + 1, languages], the last row 0."""
    out, log, safe = np.zeros((len(start), prob.shape[1])), None, _safe(prob)
    for lat in _lattices(pieces, buf, start, end):
        last = lat.size, np.arange(len(lat.own))
        if lat.longest > safe:
            log = _log(prob) if log is None else log
            out[lat.own] = _log_sums(lat, log)[last]
            continue
        found = lat.spans(0, lat.longest)
        used = _used(found, pieces.n)
        alpha = np.zeros((lat.longest + 1, len(lat.own), prob.shape[1]))
        alpha[0] = 1
        for e in range(1, lat.longest + 1):
            for n in used:
                if n < e:
                    alpha[e] += alpha[e - n - 1] * prob[found[e - 1, n]]
        out[lat.own] = np.log(alpha[last])
    return out


def _summed(seen: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """The sums of weights by index, which are taken out of the list."""
    if not seen:
        return np.zeros(n)
    index, weight = (np.concatenate(x) for x in zip(*seen, strict=True))
    seen.clear()
    return np.bincount(index, weight, minlength=n)


def expected_counts(pieces: Pieces, prob: np.ndarray, count: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, float]:
    """Expected counts of the pieces over all segmentations of words that occur ``count`` times, and the words' log
    probability. prob: [pieces + 1], the last 0."""
    total, log, safe, whole, seen, waiting = np.zeros(pieces.n + 1), _log(prob), _safe(prob), 0.0, [], 0
    for lat in _lattices(pieces, buf, start, end):
        every, n_of = np.arange(len(lat.own)), count[lat.own]
        if lat.longest <= safe:
            found = lat.spans(0, lat.longest)
            used = _used(found, pieces.n)
            alpha, beta = np.zeros((2, lat.longest + 1, len(lat.own)))
            alpha[0], beta[lat.size, every] = 1, 1
            for e in range(1, lat.longest + 1):
                for n in used:
                    if n < e:
                        alpha[e] += alpha[e - n - 1] * prob[found[e - 1, n]]
            for e in range(lat.longest, 0, -1):
                for n in used:
                    if n < e:
                        beta[e - n - 1] += beta[e] * prob[found[e - 1, n]]
            full = alpha[lat.size, every]
            whole += float((np.log(full) * n_of).sum())
            for n in used:
                share = alpha[: -n - 1] * beta[n + 1 :] * prob[found[n:, n]] * (n_of / full)
                seen.append((found[n:, n].ravel(), share.ravel()))
                waiting += share.size
            if waiting > 1 << 21:
                total += _summed(seen, pieces.n + 1)
                waiting = 0
            continue
        alpha = _log_sums(lat, log)
        full = alpha[lat.size, every]
        whole += float((full * n_of).sum())
        beta = np.full(alpha.shape, -np.inf)
        beta[lat.size, every] = 0
        for lo, hi in reversed(lat.windows()):
            found = lat.spans(lo, hi)
            used = _used(found, pieces.n)
            for e in range(hi, lo, -1):
                for n in used:
                    if n < e:
                        step = beta[e] + log[found[e - lo - 1, n]]
                        beta[e - n - 1] = np.logaddexp(beta[e - n - 1], step)
                        total += np.bincount(found[e - lo - 1, n], np.exp(alpha[e - n - 1] + step - full) * n_of, minlength=pieces.n + 1) if n_of.any() else 0
    return (total + _summed(seen, pieces.n + 1))[:-1], whole


def _expect(shared, langs: int):
    """Expected counts of a task's words (lang, word, n): a row a (piece, language); piece -1 is the log probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, prob = shared.value
        total, whole = np.zeros((pieces.n, langs)), np.zeros(langs)
        for batch in batches:
            for k in np.unique(lang := batch.column("lang").to_numpy()).tolist():
                words = batch.filter(pa.array(lang == k))
                for i, j, buf, offs, _ in T.blocks(words, "word"):
                    counts, log = expected_counts(pieces, prob[:, k], words.column("n").to_numpy()[i:j].astype(np.float64), buf, offs[:-1], offs[1:])
                    total[:, k] += counts
                    whole[k] += log
        piece, k = np.nonzero(total)
        yield pa.record_batch({
            "piece": pa.array(np.append(piece, np.full(langs, -1)), pa.int32()), "lang": pa.array(np.append(k, np.arange(langs)), pa.int32()),
            "count": pa.array(np.append(total[piece, k], whole)),
        })

    return run


def _has_letter(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    seen = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_LETTER[buf], out=seen[1:])
    out = seen[offs[1:]] > seen[offs[:-1]]
    for d in np.flatnonzero(~out):
        out[d] = any(c.isalpha() for c in buf[offs[d] : offs[d + 1]].tobytes().decode())
    return out


class _Predictor:
    """Scores the texts of batches; remembers the words that it has scored."""

    def __init__(self, pieces: Pieces, prob: np.ndarray, byte: np.ndarray, gain: np.ndarray, langs: list[str]):
        self.pieces, self.prob, self.byte, self.gain, self.langs = pieces, prob, byte, gain, langs
        self.known, self.scores = np.zeros(0, np.uint64), np.zeros((0, prob.shape[1]))

    def _words(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the distinct words, and which of them each word is."""
        h, first, back = np.unique(T.span_hash(T.prefix(buf), start, end), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, h), max(len(self.known) - 1, 0))
        new = self.known[at] != h if len(self.known) else np.ones(len(h), bool)
        own = np.empty((len(h), self.prob.shape[1]))
        if len(self.known):
            own[~new] = self.scores[at[~new]]
        own[new] = score_words(self.pieces, self.prob, buf, start[first[new]], end[first[new]])
        if len(self.known) + new.sum() > CACHE:
            self.known, self.scores = h, own
        else:
            merged = np.concatenate([self.known, h[new]])
            order = np.argsort(merged, kind="stable")
            self.known, self.scores = merged[order], np.concatenate([self.scores, own[new]])[order]
        return own, back

    def fit(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each document of a block: log probability under each language; of its words that count for the
        fit, the gain over the background, and the bytes."""
        n = len(offs) - 1
        start, end, doc = T.words(buf, offs)
        own, back = self._words(buf, start, end)
        own = own[back]
        total = np.stack([np.bincount(doc, own[:, k], minlength=n) for k in range(len(self.langs))], 1)

        def within(which: np.ndarray) -> np.ndarray:
            seen = np.append(0, np.cumsum(which))
            return seen[end] - seen[start]

        there = (within(_LETTER[buf] | (buf >= 128)) > 0) & (within((buf >= 48) & (buf <= 57)) == 0)
        shout = np.flatnonzero(there & (within((buf >= 65) & (buf <= 90)) > 1))
        if len(shout):
            edge = np.zeros(len(buf) + 1, np.int64)
            np.add.at(edge, start[shout], 1)
            np.add.at(edge, end[shout], -1)
            buf = np.where(np.cumsum(edge)[:-1] > 0, T.LOWER[buf], buf)
            low, back = self._words(buf, start[shout], end[shout])
            own[shout] = low[back]
        cost = np.append(0.0, np.cumsum(self.byte[buf]))
        background = np.logaddexp(self.byte[32] + cost[end] - cost[start], own[:, -1]) - np.log(2)
        gain = np.logaddexp.reduce(own[:, :-1], 1) - np.log(len(self.langs)) - background
        return total, np.bincount(doc[there], gain[there], minlength=n), np.bincount(doc[there], (end - start + 1)[there], minlength=n)

    def __call__(self, batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
        langs, scores = [], [np.zeros(0)]
        for i, j, buf, offs, _ in T.blocks(batch):
            total, gain, size = self.fit(buf, offs)
            best = total.argmax(1)
            none = np.log(DOUBT) + self.gain[best] / 2 * size - gain
            share = 1 / (np.exp(np.maximum(total - total.max(1, keepdims=True), -700)).sum(1) + np.exp(np.clip(none, -700, 700)))
            ok = _has_letter(buf, offs)
            langs += [self.langs[b] if o else "und" for b, o in zip(best, ok, strict=True)]
            scores.append(np.where(ok, share, 0.0))
        return langs, np.concatenate(scores)


def _gain(shared, langs: list[str]):
    """What a task's words (lang, word, n) gain over the background, and their bytes; a word counts n times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _Predictor(*shared.value, langs)
        total = np.zeros((2, len(langs)))
        for batch in batches:
            lang, times = batch.column("lang").to_numpy(), batch.column("n").to_numpy()
            for i, j, buf, offs, _ in T.blocks(batch, "word"):
                _, gain, size = predict.fit(buf, offs)
                total[0] += np.bincount(lang[i:j], gain * times[i:j], minlength=len(langs))
                total[1] += np.bincount(lang[i:j], size * times[i:j], minlength=len(langs))
        yield pa.record_batch({"lang": pa.array(np.arange(len(langs)), pa.int32()), "gain": pa.array(total[0]), "size": pa.array(total[1])})

    return run


def _predict(shared, langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _Predictor(*shared.value, langs)
        for batch in batches:
            lang, score = predict(batch)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score)})

    return run


def _keep(shared, langs: list[str], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _Predictor(*shared.value, langs)
        for batch in batches:
            lang, score = predict(batch)
            yield batch.filter(pa.array((np.array(lang, object) != "und") & (score >= least), pa.bool_()))

    return run


class LanguageModel:
    """Piece probabilities of each learned language, and what its texts gain a byte over the background."""

    def __init__(self, spark: SparkSession, pieces: Pieces, langs: list[str], prob: np.ndarray, byte: np.ndarray, gain: np.ndarray):
        self.langs, self._shared = langs, spark.sparkContext.broadcast((pieces, prob, byte, gain)) if langs else None

    def predict(self, docs: DataFrame) -> DataFrame:
        """doc_id, lang_pred, score of every document. docs: doc_id, text."""
        rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
        if not self.langs:
            return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
        return rows.mapInArrow(_predict(self._shared, self.langs), "doc_id long, lang_pred string, score double")

    def keep(self, docs: DataFrame, least: float = 0.5) -> DataFrame:
        """The documents in a learned language, scored ``least`` or more, with all their columns; no shuffle."""
        return docs.mapInArrow(_keep(self._shared, self.langs, least), docs.schema) if self.langs else docs.limit(0)


def _fitted(words: DataFrame, pieces: Pieces, langs: int, smoothing: float, rounds: int, settled: float) -> np.ndarray:
    """Smoothed expected counts [pieces, languages] of words: lang (its number), word, n."""
    spark = words.sparkSession
    prob, logs = np.append(np.full((pieces.n, langs), 1e-2), np.zeros((1, langs)), 0), []  # equal; need not sum to 1
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, prob))
        got = words.mapInArrow(_expect(shared, langs), "piece int, lang int, count double").groupBy("piece", "lang").agg(F.sum("count").alias("count")).toArrow()
        piece, lang, value = (got.column(c).to_numpy() for c in ("piece", "lang", "count"))
        count = np.full((pieces.n, langs), smoothing)
        count[piece[piece >= 0], lang[piece >= 0]] += value[piece >= 0]
        prob[:-1] = count / count.sum(0)
        logs.append(value[piece < 0].sum())
        if len(logs) > 2 and logs[-1] - logs[-2] <= settled * abs(logs[-2]):  # the first is under no distribution
            break
    return count


def train(docs: DataFrame, vocabulary: str = VOCABULARY, smoothing: float = 0.1, rounds: int = 4, settled: float = 1e-3, most: int = 1000) -> LanguageModel:
    """The model of all documents with a lang. docs: text, lang.

    Only the languages' names and one count a (piece, language) come to the driver.
    """
    spark = docs.sparkSession
    pieces = Pieces(vocabulary)
    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    found = rows.select("lang").distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} languages")
    langs = sorted(r[0] for r in found)
    if not langs:
        return LanguageModel(spark, pieces, langs, np.zeros((0, 0)), np.zeros(256), np.zeros(0))
    number = F.create_map(*[F.lit(x) for k, lang in enumerate(langs) for x in (lang, k)])
    with scratch(spark) as keep:
        split = rows.select(number[F.col("lang")].alias("lang"), F.explode(F.split("text", BLANKS)).alias("word")).where("word <> ''")
        words = keep(split.groupBy("lang", "word").agg(F.count("*").alias("n")))
        count = _fitted(words, pieces, len(langs), smoothing, rounds, settled)
        # the last column is the background of equal pieces, the last row that of no piece
        prob = np.vstack([np.column_stack([count / count.sum(0), np.full(pieces.n, 1 / pieces.n)]), np.zeros((1, len(langs) + 1))])
        seen = np.bincount(pieces.buf, np.repeat(count.sum(1), pieces.size), minlength=256)
        byte = np.log(seen / seen.sum() / 2 + 1 / 512)
        shared = spark.sparkContext.broadcast((pieces, prob, byte, np.zeros(len(langs))))
        fit = words.mapInArrow(_gain(shared, langs), "lang int, gain double, size double").groupBy("lang").agg(F.sum("gain").alias("gain"), F.sum("size").alias("size")).collect()
    gain = np.zeros(len(langs))
    for r in fit:
        gain[r["lang"]] = max(0.0, r["gain"] / max(r["size"], 1.0))
    return LanguageModel(spark, pieces, langs, prob, byte, gain)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(crc_mod("doc_id", 4) != 2))
    return model.predict(docs).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
