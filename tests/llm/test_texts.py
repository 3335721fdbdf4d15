"""Operators on single texts and on mixes, against brute force or held-out accuracy."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from muster.llm import language_id, mixing, pii, quality_classifier, quality_rules, toxicity
from muster.llm import textops as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# quality rules


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    repeated = {k + j for k in range(len(words) - 7) if seen[tuple(words[k : k + 8])] > 1 for j in range(8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated), failed


def test_quality_rules(docs, corpus):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs.withColumn("kept", F.lit(1))).collect()}
    for i, text, *_ in corpus:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(text)
        assert not (r.base_failed and r.kept)
        assert (r.clean_text is None) == (text is None)


def test_quality_rules_verdicts(spark, empty):
    prose = "The quick brown fox jumps over the lazy dog near the old river bank today.\n" + " ".join(f"word{k}" for k in range(20)) + "."
    menu = "Home | About | News | Contact | Login | Shop | Help | Terms | Jobs | Press | Blog | More\n" * 1 + "Next | Last | Top | All | One | Two | Three | Four | Five | Six | Seven | Eight"
    shout = " ".join(f"BUY{k}!!" for k in range(30))
    rows = [(1, prose), (2, menu), (3, shout), (4, prose + "\nAll rights reserved."), (5, None), (6, "")]
    out = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[k].kept for k in range(1, 7)] == [True, False, False, True, False, False]
    assert out[4].clean_text == prose and out[6].clean_text == ""
    assert quality_rules.quality_rules(empty).count() == 0


# language


def vocabulary():
    with open(language_id.VOCABULARY, "rb") as f:
        names = [base64.b64decode(x.split()[0]) for x in f]
    return [p for p in dict.fromkeys(names) if p and not any(b in b"\t\n\x0b\x0c\r " for b in p[1:])]


def packed(words):
    buf, end = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    return buf, np.append(0, end[:-1]), end


@pytest.mark.parametrize("least", [1.0, 1e-11])
def test_language_forward_sums_all_segmentations(least, monkeypatch):
    """Against a sum in logarithms over every start of a last piece; also of probabilities that underflow."""
    monkeypatch.setattr(language_id, "WINDOW", 100)
    pieces = language_id.Pieces()
    rnd = np.random.default_rng(1)
    prob = np.vstack([rnd.random((pieces.n, 2)) / pieces.n * least, np.zeros((1, 2))])
    table = {p: k for k, p in enumerate(vocabulary())}
    longest = max(map(len, table))
    assert longest > 100

    def total(word, lang):
        alpha = [0.0] + [-math.inf] * len(word)
        for e in range(1, len(word) + 1):
            terms = [alpha[s] + math.log(prob[table[word[s:e]], lang]) for s in range(max(0, e - longest), e) if word[s:e] in table]
            alpha[e] = max(terms) + math.log(sum(math.exp(t - max(terms)) for t in terms))
        return alpha[-1]

    words = [b"a", b"hello", "größer".encode(), b"internationalisation", b"x" * 90, b"-" * 400, bytes(rnd.integers(97, 123, 1500).astype(np.uint8))]
    got = language_id.score_words(pieces, prob, *packed(words))
    for k, w in enumerate(words):
        assert got[k] == pytest.approx([total(b" " + w, 0), total(b" " + w, 1)], rel=1e-9)
    sizes = pieces.size
    counts, log = language_id.expected_counts(pieces, prob[:, 0], np.ones(len(words)), *packed(words))
    assert float((counts * sizes).sum()) == pytest.approx(sum(len(w) + 1 for w in words))
    assert log == pytest.approx(got[:, 0].sum())


def test_language_expected_counts_enumerate_segmentations():
    pieces, table = language_id.Pieces(), {p: k for k, p in enumerate(vocabulary())}
    prob = np.append(np.random.default_rng(2).random(pieces.n), 0)

    def ways(word):
        return [[table[word[:k]], *rest] for k in range(1, len(word) + 1) if word[:k] in table for rest in (ways(word[k:]) if k < len(word) else [[]])]

    for word in (b"the", b"house", "ügen".encode()):
        expected, weights = np.zeros(pieces.n), [math.prod(prob[k] for k in way) for way in ways(b" " + word)]
        for way, w in zip(ways(b" " + word), weights, strict=True):
            np.add.at(expected, way, w / sum(weights))
        for scale in (1.0, 1e-60):  # the second is summed in logarithms
            got, _ = language_id.expected_counts(pieces, prob * scale, np.array([3.0]), *packed([word]))
            if scale == 1.0:
                assert got == pytest.approx(3 * expected)
            else:
                assert float((got * pieces.size).sum()) == pytest.approx(3 * (len(word) + 1))


def test_language_training_gains_likelihood(spark):
    """Rounds of expectation maximisation, against the same in plain numpy."""
    texts = ["the house of the river", "the river and the house", "a house", None]
    frame = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string")
    pieces = language_id.Pieces()
    words = Counter(w.encode() for t in texts if t for w in t.split())
    args, n = packed(list(words)), np.array(list(words.values()), float)
    prob, logs = np.append(np.full(pieces.n, 1e-2), 0), []
    for rounds in range(1, 4):
        counts, log = language_id.expected_counts(pieces, prob, n, *args)
        prob = np.append((counts + 0.1) / (counts + 0.1).sum(), 0)
        logs.append(log)
        model = language_id.train(frame, rounds=rounds, settled=-1.0)
        assert model._shared.value[1][:, 0] == pytest.approx(prob)
    assert logs[2] > logs[1]


def test_language_predictions(spark, empty):
    rnd = random.Random(2)
    stems = {"en": "the and of to in that with for was house river", "de": "der die und das nicht ein mit haus fluss über", "fr": "le la les des une dans avec pour maison rivière"}
    rows = [(k, " ".join(rnd.choice(stems[lang].split()) for _ in range(30)), lang) for k, lang in enumerate(list(stems) * 20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(frame.where("doc_id % 4 <> 2"))
    odd = spark.createDataFrame([(900, None, "en"), (901, "12 34 !!", "en"), (902, "", None), (903, "ж" * 700, None)], frame.schema)
    got = {r.doc_id: r for r in model.predict(frame.union(odd).withColumn("score", F.lit("x"))).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang in rows)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [(got[k].lang_pred, got[k].score) for k in (900, 901, 902)] == [("und", 0.0)] * 3 and got[903].lang_pred in stems
    assert {r.doc_id for r in model.keep(frame.union(odd)).collect()} == {k for k, *_ in rows} | ({903} if got[903].score >= 0.5 else set())
    assert model.predict(empty).count() == 0
    none = language_id.train(empty)
    assert {r.lang_pred for r in none.predict(frame).collect()} == {"und"} and none.keep(frame).count() == 0


def test_language_rejects_what_no_language_fits(spark):
    rnd = random.Random(7)
    stems = {"en": "the and of to in that with for was house river", "de": "der die und das nicht ein mit haus fluss über"}
    say = lambda lang, n: " ".join(rnd.choice(stems[lang].split()) for _ in range(n))
    rows = [(k, say(lang, 30), lang) for k, lang in enumerate(["en", "de"] * 100)]
    soup = " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 9))) for _ in range(20))
    odd = ["Talon takana kasvaa vanha koivu, jonka oksilla linnut laulavat joka aamu", "Старая женщина каждое утро кормила птиц", "河边的小房子里住着一位老妇人", soup, "ж" * 700]
    fine = [say("en", 30).upper(), say("en", 15) + " " + say("de", 15), say("de", 4) + ' token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" 4734663219866878', "the"]
    frame = spark.createDataFrame(rows + [(1000 + k, t, None) for k, t in enumerate(odd)] + [(2000 + k, t, None) for k, t in enumerate(fine)], "doc_id long, text string, lang string")
    model = language_id.train(frame)
    assert {r.doc_id for r in model.keep(frame).collect()} == {k for k, *_ in rows} | {2000 + k for k in range(len(fine))}
    assert all(r.score < 0.5 for r in model.predict(frame.where("doc_id between 1000 and 1999")).collect())


# personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits[::-1])) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def spans(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if valid(kind, m.group())]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


ODD = [
    "mail a.b@c.d_e@f.gh and x@y and q@@r.st", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.0255", "4111 1111 1111 1111, 4111111111111112 5500-0000-0000-0004",
    "+1 (743) 555-3824 +12 +84 900 000 001.", "é@b.co ü+44 20 7946 0958", "9" * 5000, "a" * 20000, "1.1.1.1@2.2.2.2", "", None, "+" * 300, "x@y.z" * 50, "\U0001f600 a@b.cd \U0001f600 +1 202 555 0101",
]


def test_base_spans(spark, docs, corpus, empty):
    rows = [(1000 + k, t) for k, t in enumerate(ODD)] + [(None, "null key 1.2.3.4 and a.b@c.de"), (1000, "another text of this key, x@y.zw"), (1001, ODD[1]), (1001, ODD[1])]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {}
    for r in pii._by_text(frame).join(pii.base_spans(pii.entity_texts(frame)), pii.TEXT).where("kind <> 'secret'").select("doc_id", "text", "start", "kind", "end").distinct().collect():
        got.setdefault((r.doc_id, r.text), []).append((r.start, pii.KINDS.index(r.kind), r.kind, r.end))
    for i, t in [(r[0], r[1]) for r in corpus] + rows:
        assert ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(got.get((i, t), []))) == spans(t), t
    assert pii.all_spans(empty).count() == 0


WORDS = re.compile(r"[^\W_]+")
SECRET = re.compile(r"[A-Za-z0-9_-]{24,}")


def at_least(hits, n, z):
    p = min(hits / n, 1)
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def terms_expected(texts, disclosure=0.5, reach=160, z=1.64, rare=2, bin=16):
    """Term spans of each text by counting everything, row by row."""
    texts = [t or "" for t in texts]
    n_t, n_et, gaps, places = Counter(), Counter(), {}, []
    for row, text in enumerate(texts):
        n_t.update(w.lower() for w in WORDS.findall(text))
        found = [(m.start(), m.end(), k, m.group()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m.group())]
        found += [(m.start(), m.end(), "secret", m.group()) for m in SECRET.finditer(text) if sum(c.isdigit() for c in m.group()) >= 4 and sum(c.isalpha() for c in m.group()) >= 4]
        names = {}
        for a, b, kind, value in found:
            digits = re.sub("[^0-9]", "", value)
            group = {"email": value.split("@")[-1], "ip": ".".join(value.split(".")[:2]), "card": digits[:6], "phone": digits[:4]}.get(kind)
            names[a, b, kind] = [(kind, value), *([(kind, "group", group)] if group else [])]
        for w in WORDS.finditer(text):
            if any(w.start() < b and w.end() > a for a, b, *_ in found):
                continue
            near = {}
            for a, b, k in names:
                if w.start() < b + reach and w.end() > a - reach:
                    for x in names[a, b, k]:
                        near[x] = min(near.get(x, reach), w.start() - b if w.start() >= b else w.end() - a - 1, key=lambda g: (abs(g), g))
            for x, gap in near.items():
                key = x, w.group().lower()
                n_et[key] += 1
                gaps[key] = min(gaps.get(key, reach), gap, key=lambda g: (abs(g), g))
                places.append((row, w.start(), w.end(), key))
    usual = sum(n for n in n_t.values() if n <= rare) / max(sum(n_t.values()), 1)
    near, few = Counter(), Counter()
    for (x, w), n in n_et.items():
        if len(x) == 2:
            near[gaps[x, w] // bin] += n
            few[gaps[x, w] // bin] += n * (n_t[w] <= rare)
    telling = {k for k in near if few[k] and 1 - usual / at_least(few[k], near[k], z) >= disclosure}
    out = {}
    for row, a, b, (x, w) in places:
        n, total = n_et[x, w], n_t[w]
        if at_least(n, total, z) >= disclosure or (total <= rare and n >= total and len(x) == 2 and gaps[x, w] // bin in telling):
            out.setdefault(row, set()).add((a, b))
    return out


def test_planted_names_are_found_and_rare_words_left(spark):
    """Names that occur once, right before an address or number, in texts full of other words that occur once."""
    rnd = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda n=6: "".join(rnd.choice(letters) for _ in range(n))
    common = [word(4) for _ in range(60)]
    talk = lambda n: " ".join(word(8) if rnd.random() < 0.05 else rnd.choice(common) for _ in range(n))
    names = [word(9).capitalize() for _ in range(80)]
    texts = [f"{talk(60)} {name} at {word(5)}@{word(5)}.example {talk(60)}" for name in names] + [talk(150) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [(r.doc_id, s.value) for r in pii._by_text(frame).join(pii.all_spans(frame), pii.TEXT).collect() for s in r.spans if s.kind == "term"]
    right = sum(names[d].lower() == v for d, v in found)
    assert right == len(names) and right >= 0.7 * len(found)
    blind = [f"{talk(60)} {word(5)}@{word(5)}.example {talk(60)}" for _ in range(80)]
    assert sum(s.kind == "term" for r in pii.all_spans(spark.createDataFrame(list(enumerate(blind)), "doc_id long, text string")).collect() for s in r.spans) == 0


def test_terms_that_reveal(spark, empty):
    filler = "the of and to in was for on that with as by at from this".split()
    rnd = random.Random(3)
    talk = lambda n: " ".join(rnd.choice(filler) for _ in range(n))
    texts = [f"{talk(30)} Zephyrine {talk(3)} zeph@mail.example {talk(30 + k)}" for k in range(4)]
    texts += [talk(80) for _ in range(200)] + [None, ""]
    texts += [f"{talk(40)} Quorlix rang +1 743 555 3824 twice {talk(40)}"] * 3 + [f"Contact of Vornak: ip 10.1.2.{k} {talk(60)} unnear" for k in range(3)]
    texts += [f"{talk(20)} key abcd0123456789abcdef99aa {talk(20)}", "Vornak elsewhere " + talk(9)]
    rows = [(None if k % 3 == 0 else k // 2, t) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("old"))
    out = pii.sanitize(frame).collect()
    expected = terms_expected(texts)
    want, got = Counter(), Counter()
    for k, t in enumerate(texts):
        want[t, tuple(sorted(expected.get(k, ())))] += 1
    found = pii._by_text(frame.drop("spans")).join(pii.all_spans(frame), pii.TEXT, "left").collect()
    for r in found:
        got[r.text, tuple(sorted((s.start, s.end) for s in r.spans or [] if s.kind == "term"))] += 1
    assert got == want and sum(len(x) for _, x in want) > 8
    clean = [r.text for r in out if r.text and "[" in r.text]
    assert len(clean) == 11 and not any(w in x for x in clean for w in ("Zephyrine", "zeph@", "Quorlix", "555", "10.1.2", "abcd0123"))
    assert sum("[EMAIL]" in x for x in clean) == 4 and sum("[SECRET]" in x for x in clean) == 1
    assert Counter(r.text for r in out if not (r.text and "[" in r.text)) == Counter(t for k, t in enumerate(texts) if not (4 + 200 + 2 <= k < 213 or k < 4))
    assert pii.sanitize(empty).count() == 0


# mixing


def test_gain_is_that_of_all_training_documents(spark):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("abdeinorst") for _ in range(rnd.randint(2, 9))) + rnd.choice([" Und", " THE", " x1", ""]) for _ in range(5000)]
    model = language_id.train(spark.createDataFrame([(t, "en") for t in texts], "text string, lang string"), rounds=1)
    pieces, prob, byte, gain = model._shared.value
    joined = " ".join(texts).encode()
    _, won, size = language_id._Predictor(pieces, prob, byte, np.zeros(1), ["en"]).fit(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]))
    assert gain[0] == pytest.approx(won[0] / size[0], rel=1e-9) and gain[0] > 0


def targets(sizes, weights=(1, 2, 3), most=3):
    """Targets by the repeated resharing that the contract words."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, cut = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in cut)
        share = sum(weight[s] for s in names if s not in cut)
        out = {s: most * sizes[s] if s in cut else left * weight[s] / share for s in names}
        over = {s for s in names if s not in cut and out[s] > most * sizes[s]}
        if not over:
            return out
        cut |= over


def test_mixing(spark, docs, corpus, empty):
    sizes = Counter()
    for _, text, _, source, _ in corpus:
        sizes[source] += len(WORD.findall(text or ""))
    got = {r.doc_id: r for r in mixing.plan(docs.withColumn("target", F.lit("x"))).collect()}
    want = targets(sizes)
    for i, text, _, source, _ in corpus:
        r, rate = got[i], want[source] / sizes[source]
        assert r.size == len(WORD.findall(text or "")) and r.source_size == sizes[source] and r.target == pytest.approx(want[source])
        assert r.copies in (math.floor(rate + 1e-9), math.floor(rate + 1e-9) + 1) and r.copies <= 3
    assert mixing.mix(docs).count() == sum(r.copies for r in got.values())
    assert mixing.plan(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, 0), (None, "a b", None, "s", 0)], docs.schema)
    assert {(r.doc_id, r.size) for r in mixing.plan(blank).collect()} == {(1, 0), (None, 2)}


def test_mixing_keeps_columns_of_any_name(spark, docs):
    odd = docs.withColumns({c: F.lit("mine") for c in ("_source", "size", "source_size", "target", "copies", "_range", "weight")})
    out = mixing.mix(odd)
    assert out.columns == [*odd.columns, "copy"] and {(r["size"], r._source, r.copies) for r in out.collect()} == {("mine", "mine", "mine")}
    twice = mixing.mix(docs.union(docs).withColumn("copy", F.lit("x"))).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("copy")).collect()
    assert all(r.n == 2 * r.copy for r in twice if r.doc_id is not None)


def test_mixing_comes_near_its_targets(spark):
    """Words taken of each of many sources, within four standard deviations of the draws; and the targets."""
    rnd = random.Random(12)
    rows = [(k, "w " * rnd.randint(1, 60), f"host{int(rnd.paretovariate(0.7)) % 40}") for k in range(4000)]
    sizes, squares = Counter(), Counter()
    for _, text, source in rows:
        sizes[source] += len(text) // 2
        squares[source] += (len(text) // 2) ** 2
    out = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5))
    got = {r.source: r for r in out.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()}
    want = targets(sizes)
    for s, r in got.items():
        assert r.target == pytest.approx(want[s]) and abs(r.taken - r.target) <= 2 * math.sqrt(squares[s])
    assert sum(r.taken for r in got.values()) == pytest.approx(sum(sizes.values()), rel=0.02)


def test_mixing_cuts_small_sources(spark):
    rows = [(k, "w " * 10, "big" if k else "tiny") for k in range(100)]
    got = {r.source: r.target for r in mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == pytest.approx(targets({"big": 990, "tiny": 10}))


# classifiers


def labelled(spark, make, n=400, seed=4):
    rnd = random.Random(seed)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omicron sigma river stone window garden".split()
    rows, labels = [], []
    for k in range(n):
        y = int(rnd.random() < 0.3)
        rows.append((k, make(rnd, [rnd.choice(words) for _ in range(40)], y)))
        labels.append((k, y))
    return rows, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, y int"), dict(labels)


def accuracy(scores, truth, held):
    picked = [r for r in scores if held(r.doc_id)]
    return sum((r.score >= 0.5) == bool(truth[r.doc_id]) for r in picked) / len(picked)


def test_toxicity(spark, empty):
    def make(rnd, words, y):
        if y:
            bad = rnd.choice(["gromble", "vexnark"])
            words[rnd.randrange(40)] = rnd.choice([bad, bad.replace("e", "3"), bad.replace("o", "0").replace("a", "4"), ".".join(bad), " ".join(bad), bad[0] * 5 + bad[1:]])
        return " ".join(words) + "."

    rows, docs, labels, truth = labelled(spark, make)
    got = toxicity.toxicity_scores(docs, labels.where("doc_id % 5 <> 0"), label="y").collect()
    assert accuracy(got, truth, lambda k: k % 5 == 0) >= 0.9
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1002, "!!! 1234 " * 2000), (1003, "a " * 5000)], docs.schema)
    got = toxicity.toxicity_scores(docs.union(odd).withColumn("y", F.lit(3)), labels, label="y").collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity_scores(empty, labels, label="y").count() == 0
    assert {r.score for r in toxicity.toxicity_scores(docs, labels.limit(0), label="y").collect()} == {0.5}


def test_restoration():
    rnd = np.random.default_rng(0)
    text = "the idiot and the clown saw a moron with trash " * 50
    code = np.array([0, 0, *(ord(c) - 96 if c != " " else 0 for c in text), 0])
    counts = np.zeros((28, 28, 28))
    np.add.at(counts, (code[:-2], code[1:-1], code[2:]), 1)
    cost = -np.log((counts + 1e-3) / (counts.sum(2, keepdims=True) + 28e-3))
    assert rnd is not None
    for noisy, plain in {"1d10t": "idiot", "cl0wn": "clown", "m.o.r.o.n": "moron", "tra5h": "trash", "cloooown": "clown", "idiot": "idiot"}.items():
        assert toxicity.restore(noisy, cost) == plain


def test_restoration_is_the_least_of_all_readings():
    """The Viterbi path against every reading of a lattice, and of a word that is far too long to enumerate."""
    rnd = np.random.default_rng(8)
    cost = rnd.random((28, 28, 28)) * 3

    def ways(word, k):
        c, times = word[k], 1
        while k - times >= 0 and word[k - times] == c:
            times += 1
        if c == " ":
            return [(toxicity.COST["filler"], "", False), (0.0, "", True)]
        out = [(toxicity.COST["leet"], x, False) for x in toxicity.LEET.get(c, "")]
        if c.isalpha():
            out.append((0.0, c, False))
            if times > 2 or times == 2 and word[k + 1 : k + 3].strip()[:1] == c:
                out.append((toxicity.COST["second" if times == 2 else "later"], "", False))
        else:
            out.append((toxicity.COST["filler" if c in toxicity.FILLER else "drop"], "", False))
        return out

    def least(word, k=0, a=0, b=0):
        if k == len(word):
            return cost[a, b, 0], ""
        out = []
        for extra, x, ends in ways(word, k):
            if ends and not b:
                continue
            code = 0 if ends else ord(x) - 96 if x else None
            rest = least(word, k + 1, *((b, code) if code is not None else (a, b)))
            out.append((extra + rest[0] + (cost[a, b, code] if code is not None else 0), (" " if ends else x) + rest[1]))
        return min(out)

    for word in ("1d10t", "a.b-c", "cloooown", "i d 1 0 t", "4$$h0le", "x1!1+", "aaab8", "q"):
        assert toxicity.restore(word, cost) == least(word)[1]
    text = "the idiot " * 50
    code = np.array([0, 0, *(ord(c) - 96 if c != " " else 0 for c in text), 0])
    counts = np.zeros((28, 28, 28))
    np.add.at(counts, (code[:-2], code[1:-1], code[2:]), 1)
    plain = -np.log((counts + 1e-3) / (counts.sum(2, keepdims=True) + 28e-3))
    assert toxicity.restore(" ".join("theidiot" * 3000), plain) == " ".join(["the idiot"] * 3000)
    assert len(toxicity.restore("5a" * 50_000, plain)) > 50_000


def test_readings_of_the_whole_channel():
    text = "the idiot and a clown saw a moron with an asshole " * 50
    code = np.array([0, 0, *(ord(c) - 96 if c != " " else 0 for c in text), 0])
    counts = np.zeros((28, 28, 28))
    np.add.at(counts, (code[:-2], code[1:-1], code[2:]), 1)
    reader = toxicity._Reader(-np.log((counts + 1e-3) / (counts.sum(2, keepdims=True) + 28e-3)))

    def readings(text):
        buf = np.frombuffer(text.encode(), np.uint8)
        return [x for _, word in toxicity._suspects(buf, np.array([0, len(buf)])) for x in reader.read(word).split(" ")]

    for sign in toxicity.FILLER.replace(" ", ""):
        assert "idiot" in readings("the " + sign.join("idiot") + " saw"), hex(ord(sign))
    for sign, plain in toxicity.LEET.items():
        for word in ("idiot", "clown", "asshole"):
            for x in plain:
                if x in word:
                    assert word in readings(word.replace(x, sign, 1)), (sign, word)
    assert "idiot" in readings("1d107") and "asshole" in readings("455hole")
    assert readings("a m o r o n") == ["a", "moron"]
    long = readings(" ".join("theidiotandaclownsawamoron" * 4))
    assert {"idiot", "clown", "moron"} <= set(long) and len(long) > 20
    assert readings("1234 12 000 the clown 5") == []


def test_quality_classifier(spark, empty):
    def make(rnd, words, y):
        return " ".join(words) + "." if y else " ".join(w + rnd.choice(["***", "%%", "!!"]) for w in words)

    rows, docs, labels, truth = labelled(spark, make)
    got = quality_classifier.quality_scores(docs, labels.where("doc_id % 3 <> 1"), label="y").collect()
    assert accuracy(got, truth, lambda k: k % 3 == 1) >= 0.97
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1002, "x" * 100_000)], docs.schema)
    got = quality_classifier.quality_scores(docs.union(odd).withColumn("y", F.lit(1)).withColumn("top_word_share", F.lit("x")), labels, label="y").collect()
    assert len(got) == 403 and {r.score for r in got if r.doc_id == 1000} == {r.score for r in got if r.doc_id == 1001}
    assert quality_classifier.quality_scores(empty, labels, label="y").count() == 0
    assert {r.score for r in quality_classifier.quality_scores(docs, labels.limit(0), label="y").collect()} == {0.5}


def plain_statistics(text):
    """The features of a text from their names, in plain Python."""
    text = text or ""
    words, runs, over = WORD.findall(text), Counter(WORD.findall(text)), lambda a, b: a / max(b, 1)
    blanks = sum(c in " \t\n\x0b\x0c\r" for c in text)
    upper, lower = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text)
    wide, lines = sum(ord(c) > 127 for c in text), [x for x in text.split("\n") if WORD.search(x)]
    n, size, bytes_ = len(words), len(text), len(text.encode())
    count = lambda signs: sum(c in signs for c in text)
    return [
        math.log1p(n), math.log1p(size), over(size - blanks, n), over(upper + lower + wide, size), over(upper, upper + lower), over(count("0123456789"), size),
        over(count("#*$%&|<>"), n), over(count("!?"), n), over(count(".,;:"), n), over(n, len(lines)), over(len(lines) - len(set(lines)), len(lines)), over(base_counts(text)[4], n),
        over(len(runs), n), over(sum(a == b for a, b in zip(words, words[1:], strict=False)), n), over(max(runs.values(), default=0), n), over(blanks, bytes_),
        over(len(text.encode()) - sum(ord(c) < 128 for c in text), bytes_), over(count("|"), n),
    ]


def test_statistics(corpus):
    texts = [(t or "").encode() for _, t, *_ in corpus] + ["A a a! B?? é|| 12\n\nA a a! B?? é|| 12".encode()]
    buf, end = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = quality_classifier.statistics(buf, end)
    for t, row in zip(texts, got, strict=True):
        assert row == pytest.approx(plain_statistics(t.decode())), t[:80]


def test_texts_of_several_blocks(spark, corpus):
    """Texts over the size of a block, repeated rows, ties and null keys give each document what it gets alone."""
    long = " ".join(corpus[k][1] for k in range(50)) + " " + " ".join(f"w{k % 3001}" for k in range(450_000))
    assert len(long) > T.CHUNK
    rows = [(1, long), (2, corpus[3][1]), (2, corpus[3][1]), (None, corpus[4][1]), (None, None), (3, long + " x"), (4, corpus[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    rules = {(r.doc_id, r.n_words): r for r in quality_rules.quality_rules(docs, with_text=False).collect()}
    for i, t in rows:
        r = rules[i, len(WORD.findall(t or ""))]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(t)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (4, None), (9, 1)], "doc_id long, y int")
    lang = language_id.train(docs.withColumn("lang", F.lit("en"))).predict(docs).collect()
    tox = toxicity.toxicity_scores(docs, labels, label="y").collect()
    qual = quality_classifier.quality_scores(docs, labels, label="y").collect()
    for out in (lang, tox, qual):
        assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out) and len({r.score for r in out if r.doc_id in (2, 4)}) == 1


def test_flat_trees_match_a_walk():
    rnd = np.random.default_rng(6)
    x = rnd.random((500, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = quality_classifier.fit(x, y, trees=30)
    assert (((trees.raw(x) > 0) == (y > 0)).mean()) > 0.97
    for row in x[:20]:
        total = trees.base
        for root in trees.root:
            node = root
            while np.isfinite(trees.cut[node]):
                node = trees.left[node] + int(row[trees.feature[node]] > trees.cut[node])
            total += trees.value[node]
        assert total == pytest.approx(float(trees.raw(row[None])[0]))


def test_digest_columns(spark, tmp_path, docs, corpus):
    """The thin queries carry the contract's columns."""
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(k, k % 2, k % 3 % 2) for k in range(90)], "doc_id long, quality int, toxic int")
    labels.coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    where = str(tmp_path)
    six = {r.doc_id: r for r in pii.op6_pii(spark, where).collect()}
    assert all(r.base_sha256 == hashlib.sha256(spans(corpus[i][1]).encode()).hexdigest() for i, r in six.items())
    assert language_id.op5_language_id(spark, where).columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    assert mixing.op8_mix_sources(spark, where).columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    assert toxicity.op9_toxicity(spark, where).columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert quality_classifier.op10_quality_classifier(spark, where).columns[:4] == ["doc_id", "held_out", "score", "predicted"]
