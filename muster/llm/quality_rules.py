"""Line-first quality rules: bad lines are removed, then documents that lose too much text.

Words are ``[^\\x20\\x09-\\x0D]+``; lines are split at ``\\n``.  A line with a word fails if one rule holds:

* punctuation: fewer than ``min_line_words`` words and no sentence end at the end of the line; or more than
  ``max_symbols`` symbols ``[#*$%&|<>]`` a word; or more than half of its words end in two marks ``!!``/``??``;
* navigation: two or more separators (``|``, ``»``, ``›``) that make up a tenth of the words or more;
* stutter: more than half of its words repeat the word before them;
* boilerplate: one of ``BOILERPLATE`` occurs in it (ASCII case folded).

The last line with a sentence end is no condition for the others: each line is judged alone.  A document
is rejected if the base rules fail (few words, or repeated 8-word windows over 30 % of the words), or if the
lines that stay hold less than ``min_kept`` of its words.

All counts are over the whole text.  The work is one Arrow pass without a shuffle; a task holds one batch.
Defined results: a null or empty text has no words and fails the base rules; cleaned text is null for a null
text; ties and repeated rows are independent; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textops as T
from .tables import table

# Phrases of notices and page furniture in English, German, French and Spanish (ASCII capitals folded).
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use of cookies",
    "enable javascript", "subscribe to our newsletter", "click here", "sign up for", "licensed under", "released under the",
    "powered by", "lorem ipsum", "share this", "skip to content",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "cookie-richtlinie", "newsletter abonnieren", "hier klicken", "zum inhalt springen",
    "tous droits réservés", "mentions légales", "politique de confidentialité", "cliquez ici", "abonnez-vous à", "aller au contenu",
    "todos los derechos reservados", "aviso legal", "política de privacidad", "política de cookies", "haga clic aquí", "suscríbase a", "saltar al contenido",
)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
#: Last bytes of the marks . ! ? : ; … 。 ！ ？ and of closing quotes and brackets after them.
_ENDS = np.zeros(256, bool)
_ENDS[np.frombuffer(b".!?:;\"')]", np.uint8)] = True
_WIDE_ENDS = tuple(x.encode() for x in "…。！？»”’")


def _sums(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[end] - total[start]


def _lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of all lines; an empty document has one empty line."""
    breaks = np.flatnonzero(buf == 10)
    start = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([offs[1:], breaks]), kind="stable")
    doc = np.repeat(np.arange(len(offs) - 1), 1 + np.searchsorted(breaks, offs[1:]) - np.searchsorted(breaks, offs[:-1]))
    return start, end, doc


def _found(data: bytes, phrase: bytes) -> list[int]:
    at, out = data.find(phrase), []
    while at >= 0:
        out.append(at)
        at = data.find(phrase, at + 1)
    return out


def measure(buf: np.ndarray, offs: np.ndarray, options: dict) -> dict[str, np.ndarray]:
    """The counts of each document of a block, and each line's verdict."""
    n = len(offs) - 1
    start, end, doc = T.words(buf, offs)
    p = T.prefix(buf)
    ws, we, _ = _bounds(doc, n)
    n_words = we - ws
    solid = (buf & 0xC0) != 0x80
    solid &= ~T.BLANK[buf]
    symbols = _SYMBOL[buf]

    h = T.span_hash(p, start, end)
    ls, le, ldoc = _lines(buf, offs)
    first, last = np.searchsorted(start, ls), np.searchsorted(start, le)
    lwords = last - first
    full = np.flatnonzero(lwords > 0)
    ldup = np.bincount(ldoc[full], minlength=n) - np.bincount(T.distinct(ldoc[full], T.span_hash(p, ls[full], le[full]))[0], minlength=n)

    return {
        "n_words": n_words, "word_chars": _sums(solid, offs[:-1], offs[1:]), "n_symbols": _sums(symbols, offs[:-1], offs[1:]),
        "n_dup_lines": ldup, "n_repeat_words": _repeats(h, doc, n),
        "lines": (ls, le, ldoc, lwords), "bad": _bad_lines(buf, start, end, h, symbols, ls, le, lwords, first, last, options),
    }


def _bounds(doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, None]:
    b = T.per_doc(doc, n)
    return b[:-1], b[1:], None


def _repeats(h: np.ndarray, doc: np.ndarray, n: int, width: int = 8) -> np.ndarray:
    """Words of each document in windows of ``width`` words that occur twice or more in it."""
    gram, at = T.ngrams(h, doc, width)
    if not len(gram):
        return np.zeros(n, np.int64)
    own = gram + doc[at].astype(np.uint64) * np.uint64(T.BASE)
    order = np.argsort(own, kind="stable")
    s = own[order]
    twin = np.zeros(len(s), bool)
    same = s[1:] == s[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    hit = at[order[twin]]
    step = np.zeros(len(h) + 1, np.int64)
    np.add.at(step, hit, 1)
    np.add.at(step, hit + width, -1)
    return np.bincount(doc[np.cumsum(step[:-1]) > 0], minlength=n)


def _bad_lines(buf, start, end, h, symbols, ls, le, lwords, first, last, options) -> np.ndarray:
    full = lwords > 0
    tail = np.zeros(len(ls), bool)
    at = end[np.maximum(last - 1, 0)] - 1 if len(end) else np.zeros(len(ls), np.int64)
    if len(buf):
        tail = _ENDS[buf[at]]
        for mark in _WIDE_ENDS:
            k = len(mark)
            ok = at >= k - 1
            tail |= ok & np.all([buf[np.maximum(at - k + 1 + i, 0)] == mark[i] for i in range(k)], 0)
    n_symbols = _sums(symbols, ls, le)
    loud = np.zeros(len(start), bool)
    if len(start):
        long = end - start >= 2
        a, b = buf[end - 1], buf[np.maximum(end - 2, 0)]
        loud = long & ((a == 33) | (a == 63)) & ((b == 33) | (b == 63))
    data = T.LOWER[buf].tobytes()
    bars = buf == ord("|")
    for mark in ("»", "›"):
        if spots := _found(data, T.LOWER[np.frombuffer(mark.encode(), np.uint8)].tobytes()):
            bars[spots] = True
    n_bars = _sums(bars, ls, le)
    bad = (lwords < options["min_line_words"]) & ~tail
    bad |= n_symbols > options["max_symbols"] * lwords
    bad |= 2 * _sums(loud, first, last) > lwords
    again = np.zeros(len(start), bool)
    again[1:] = h[1:] == h[:-1]
    again[first[full]] = False  # the word before is another line's
    bad |= 2 * _sums(again, first, last) > lwords
    bad |= (n_bars >= 2) & (10 * n_bars >= lwords)
    for phrase in BOILERPLATE:
        if spots := _found(data, phrase.encode()):
            line = np.searchsorted(ls, spots, "right") - 1
            bad[line[np.asarray(spots) + len(phrase) <= le[line]]] = True
    return bad & full


def _judge(options: dict, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for i, j, buf, offs, nulls in T.blocks(batch):
                m = measure(buf, offs, options)
                ls, le, ldoc, lwords = m["lines"]
                stay = np.bincount(ldoc[~m["bad"]], lwords[~m["bad"]], minlength=j - i).astype(np.int64)
                base = (m["n_words"] < options["min_words"]) | (100 * m["n_repeat_words"] > options["max_repeat_percent"] * m["n_words"])
                kept = ~base & (stay >= options["min_kept"] * m["n_words"])
                out = {"doc_id": ids.slice(i, j - i), **{k: pa.array(m[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}}
                out |= {"base_failed": pa.array(base), "kept": pa.array(kept), "n_kept_words": pa.array(stay, pa.int64()), "n_bad_lines": pa.array(np.bincount(ldoc[m["bad"]], minlength=j - i), pa.int64())}
                if with_text:
                    data, good, bounds = buf.tobytes(), ~m["bad"], T.per_doc(ldoc, j - i)
                    texts = [None if nulls[d] else b"\n".join(data[ls[x] : le[x]] for x in range(bounds[d], bounds[d + 1]) if good[x]).decode() for d in range(j - i)]
                    out["clean_text"] = pa.array(texts, pa.string())
                yield pa.record_batch(out)

    return run


COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_kept_words long, n_bad_lines long"


def quality_rules(docs: DataFrame, min_words: int = 20, max_repeat_percent: int = 30, min_line_words: int = 4, max_symbols: float = 0.3, min_kept: float = 0.5, with_text: bool = True) -> DataFrame:
    """Counts, verdicts and (with_text) the cleaned text of every document. docs: doc_id, text."""
    options = {"min_words": min_words, "max_repeat_percent": max_repeat_percent, "min_line_words": min_line_words, "max_symbols": max_symbols, "min_kept": min_kept}
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_judge(options, with_text), COLUMNS + ", clean_text string" * with_text)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), with_text=False)
