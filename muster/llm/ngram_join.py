"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles (a text of one to four words is one shingle); two documents are
linked if their Jaccard similarity is ``threshold`` or more.  The result has a row a document: its class
(the smallest doc_id of its connected component) and its number of links (other documents at or above the
threshold, copies included).

Method.
1. One Arrow pass gives each document a fingerprint of its shingle set and ``5 * bands`` MinHash values.
   Equal sets collapse to their smallest doc_id with a map-side combined minimum: copies cost no pairs.
2. Bands of 5 values are exploded to keys; keys with one member are dropped.
3. Within a bucket, pairs are pruned the Bayesian way (Chakrabarti et al.): MinHash values are compared
   ``STEP`` at a time, and a pair is dropped once the posterior probability that its similarity reaches the
   threshold, under a uniform prior, falls below ``tolerance``.  What survives links the bucket's members
   into groups, and a task emits one link for each document that it has linked, never the pairs.
4. Components of those links are the near-duplicate clusters.  Their members' texts are brought together.  What
   each member lacks of the first one's shingles and has besides bounds the similarity of two members from both
   sides, which decides nearly all pairs of a large cluster by a few sums; the others are pruned again in the same
   way and the rest verified exactly on their shingle sets.  A row goes out for each document (its links counted,
   its group's first), not for each pair.

Buckets over ``bucket_block`` members and clusters over ``cluster_block`` members or ``cluster_shingles`` shingles are
split by hash into blocks, and each pair of blocks is a group of its own, so a task holds two blocks at most, however
large the bucket; no pair is lost.  A text goes out once a block of its cluster: with texts of 200 words once for
each 2,048 members.  Comparisons in a cluster of m different texts are m^2 / 2, as its links are, but of numbers.
Hot bands, copies and centres of clusters are joined by a broadcast of those keys (``join_groups``).

What may be missed: a pair at similarity s shares no band with probability (1 - s**5) ** bands, 1.3e-7 at
0.8 with 40 bands; pruning adds ``tolerance`` a step.  Nothing that is reported is approximate, as every
link is verified on the sets of 64-bit shingle fingerprints.

Defined results: a null text or one without a word has no shingles, no links and its own id as class; rows
that repeat a doc_id with the same text count as copies (doc_id is a key: it mustn't repeat with another
text); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .components import components
from .tables import join_groups, kept, merged, scratch, table

ROWS = 5
STEP = 40
PAIRS = 1 << 18


def _shingle_sets(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, shingle): n-word windows, or all words of a text that has fewer."""
    start, end, doc = T.words(buf, offs)
    h = T.span_hash(T.prefix(buf), start, end)
    gram, at = T.ngrams(h, doc, n)
    docs, grams = [doc[at]], [gram]
    count = np.bincount(doc, minlength=len(offs) - 1)
    for k in range(1, n):
        gram, at = T.ngrams(h, doc, k)
        own = count[doc[at]] == k
        docs.append(doc[at[own]])
        grams.append(gram[own])
    return T.distinct(np.concatenate(docs), np.concatenate(grams))


def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, k, dtype=np.uint32)


def _sign(n: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _permutations(bands * ROWS)
        for batch in batches:
            ids = batch.column("doc_id")
            for i, j, buf, offs, _ in T.blocks(batch):
                doc, h = _shingle_sets(buf, offs, n)
                full, at = np.unique(doc, return_index=True)
                size = np.diff(np.append(at, len(doc)))
                low = h.astype(np.uint32)
                sig = np.empty((bands * ROWS, len(full)), np.uint32)
                if len(full):
                    for k in range(bands * ROWS):
                        sig[k] = np.minimum.reduceat(low * a[k] + b[k], at)
                key = np.repeat(np.arange(bands, dtype=np.uint64)[:, None], len(full), 1)
                for k in range(ROWS):
                    key = T.mix(key * np.uint64(T.WORD_BASE) + sig[k::ROWS])
                sums = [np.add.reduceat(x, at) if len(full) else x for x in (h, T.mix(h + np.uint64(1)))]
                short = np.ascontiguousarray((sig >> np.uint32(16)).astype(np.uint16).T)
                yield pa.record_batch({
                    "doc_id": ids.slice(i, j - i).take(pa.array(full)), "n": pa.array(size, pa.int32()),
                    "f1": pa.array(sums[0].view(np.int64)), "f2": pa.array(sums[1].view(np.int64)),
                    "sig": pa.array([x.tobytes() for x in short], pa.binary()),
                    "bands": pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1) * bands, pa.int32()), pa.array(key.T.ravel().view(np.int64))),
                })

    return run


def least_matches(threshold: float, tolerance: float, most: int) -> np.ndarray:
    """For each number n of compared values, the fewest matches that keep a pair.

    With a uniform prior, P(J >= t | m of n match) is P(Binomial(n + 1, t) <= m).
    """
    out = np.zeros(most + 1, np.int64)
    for n in range(1, most + 1):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold)) if threshold < 1 else float(m >= n)
        out[n] = m
    return out


def prune(sig: np.ndarray, u: np.ndarray, v: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Indexes of the pairs (u, v) that stay after incremental comparison."""
    left, hits = np.arange(len(u)), np.zeros(len(u), np.int64)
    for k in range(0, sig.shape[1], STEP):
        hits += (sig[u[left], k : k + STEP] == sig[v[left], k : k + STEP]).sum(1)
        stay = hits >= least[min(k + STEP, sig.shape[1])]
        left, hits = left[stay], hits[stay]
    return left


def _pairs(start: np.ndarray, side: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same group, about PAIRS at a time: all of them, or, in a group that brings two
    blocks together, those with one row from each. start: first row of each group; side: 0 or 1."""
    size = np.diff(np.append(start, n))
    group = np.repeat(np.arange(len(start)), size)
    two = np.bincount(group, side, minlength=len(start)) > 0
    last = np.repeat(np.append(start[1:], n), size)
    split = np.repeat(start + size - np.bincount(group, side, minlength=len(start)).astype(np.int64), size)
    rows = np.arange(n)
    first = np.where(two[group], np.where(side == 0, split, last), rows + 1)
    count = last - first
    total = np.cumsum(count)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS, "right")))
        c = count[i:j]
        u = np.repeat(rows[i:j], c)
        yield u, np.repeat(first[i:j], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        i = j


def _leads(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest row that each row is connected to by the links (u, v)."""
    lead = np.arange(n)
    while True:
        low = np.minimum(lead[u], lead[v])
        new = lead.copy()
        np.minimum.at(new, lead[u], low)
        np.minimum.at(new, lead[v], low)
        new = new[new]
        if (new == lead).all():
            return lead
        lead = new


def _by_group(batches: Iterator[pa.RecordBatch], limit: int = 16 << 20) -> Iterator[pa.Table]:
    """Whole groups (equal ``group``, rows sorted by it) gathered to about ``limit`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(x.nbytes for x in held) >= limit:
            whole = pa.Table.from_batches(held).combine_chunks()
            g = whole.column("group").to_numpy()
            cut = int(np.flatnonzero(g != g[-1])[-1]) + 1 if g[0] != g[-1] else 0
            if cut:
                yield whole.slice(0, cut)
            held = whole.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _starts(g: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, g[1:] != g[:-1]))


def _signed(whole: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(whole.column("sig").to_pylist()), np.uint16).reshape(whole.num_rows, -1)


def _forest(edges: np.ndarray) -> np.ndarray:
    """Links [node, first of its component] that connect what ``edges`` connects, one a node."""
    nodes, at = np.unique(edges, return_inverse=True)
    at = at.reshape(edges.shape)
    lead = _leads(len(nodes), at[:, 0], at[:, 1])
    moved = lead != np.arange(len(nodes))
    return np.stack([nodes[moved], nodes[lead[moved]]], 1)


def _link_buckets(least: np.ndarray, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = np.zeros((0, 2), np.int64)
        for whole in _by_group(batches):
            sig, ids, size = _signed(whole), whole.column("doc_id").to_numpy(), whole.column("n").to_numpy()
            us, vs = [], []
            for u, v in _pairs(_starts(whole.column("group").to_numpy()), whole.column("side").to_numpy(), len(ids)):
                fit = np.minimum(size[u], size[v]) >= threshold * np.maximum(size[u], size[v]) - 1e-9
                u, v = u[fit], v[fit]
                stay = prune(sig, u, v, least)
                us.append(u[stay])
                vs.append(v[stay])
            lead = _leads(len(ids), np.concatenate(us), np.concatenate(vs))
            moved = np.flatnonzero(lead != np.arange(len(ids)))
            forest = np.concatenate([forest, np.stack([ids[moved], ids[lead[moved]]], 1)])
            if len(forest) > PAIRS:
                forest = _forest(forest)
            if len(forest) > PAIRS:
                yield pa.record_batch({"a": pa.array(forest[:, 0]), "b": pa.array(forest[:, 1])})
                forest = forest[:0]
        forest = _forest(forest)
        yield pa.record_batch({"a": pa.array(forest[:, 0]), "b": pa.array(forest[:, 1])})

    return run


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted sets share."""
    near = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[near] == x).sum())


def _verify_clusters(least: np.ndarray, threshold: float, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _by_group(batches):
            ids, group = whole.column("doc_id").to_numpy(), whole.column("group").to_numpy()
            once = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (group[1:] != group[:-1])))  # rows that repeat a doc_id
            whole = whole.take(pa.array(once)).combine_chunks()
            ids, copies = ids[once], whole.column("copies").to_numpy()
            doc, h = [], []
            for i, _, buf, offs, _ in T.blocks(whole.to_batches()[0]):
                d, x = _shingle_sets(buf, offs, n)
                doc.append(d + i)
                h.append(x)
            h, at = np.concatenate(h), T.per_doc(np.concatenate(doc), len(ids))
            sets = [h[at[k] : at[k + 1]] for k in range(len(ids))]
            sig, size, links = _signed(whole), np.array([len(x) for x in sets], np.int64), np.zeros(len(ids), np.int64)
            start = _starts(whole.column("group").to_numpy())
            first = np.repeat(start, np.diff(np.append(start, len(ids))))
            both = np.array([_shared(sets[c], x) for c, x in zip(first.tolist(), sets, strict=True)], np.int64)
            lacks, us, vs = size[first] - both, [], []
            for u, v in _pairs(start, whole.column("side").to_numpy(), len(ids)):
                total = size[u] + size[v]
                least_shared = size[first[u]] - lacks[u] - lacks[v]
                most_shared = np.minimum(size[first[u]] - np.maximum(lacks[u], lacks[v]) + np.minimum(size[u] - both[u], size[v] - both[v]), np.minimum(size[u], size[v]))
                sure = least_shared >= threshold * (total - least_shared) - 1e-9
                links += np.bincount(u[sure], copies[v[sure]], len(ids)).astype(np.int64) + np.bincount(v[sure], copies[u[sure]], len(ids)).astype(np.int64)
                near = np.unique(np.concatenate([u[sure], v[sure]]))  # these are as similar to the first at least
                us += near.tolist()
                vs += first[near].tolist()
                open_ = ~sure & (most_shared >= threshold * (total - most_shared) - 1e-9)
                u, v = u[open_], v[open_]
                stay = prune(sig, u, v, least)
                for a, b in zip(u[stay].tolist(), v[stay].tolist(), strict=True):
                    shared = _shared(sets[a], sets[b])
                    if shared >= threshold * (size[a] + size[b] - shared) - 1e-9:
                        us.append(a)
                        vs.append(b)
                        links[a] += copies[b]
                        links[b] += copies[a]
            lead = _leads(len(ids), np.array(us, np.int64), np.array(vs, np.int64))
            hit = np.flatnonzero(links)
            yield pa.record_batch({"doc_id": pa.array(ids[hit]), "links": pa.array(links[hit]), "lead": pa.array(ids[lead[hit]])})

    return run


def _blocked(members: DataFrame, by: str, blocks: Column) -> DataFrame:
    """Rows of members for each pair of the blocks that their group is split into: ``group`` names the pair, ``side``
    is 1 for the second of two blocks."""
    spread = members.withColumn("blocks", F.ceil(blocks).cast("int")).withColumn("own", F.expr("cast(pmod(xxhash64(doc_id), blocks) as int)"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.xxhash64(by, F.least("own", "other"), F.greatest("own", "other"))
    return spread.withColumn("group", group).withColumn("side", (F.col("own") > F.col("other")).cast("int")).drop("own", "other", "blocks", "size")


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition("group").sortWithinPartitions("group", "side", "doc_id")


def ngram_join(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, bands: int = 40, tolerance: float = 1e-6, bucket_block: int = 4096, cluster_block: int = 2048, cluster_shingles: int = 1 << 19
) -> DataFrame:
    """doc_id, class_id, n_links for every document. docs: doc_id, text."""
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    least = least_matches(threshold, tolerance, bands * ROWS)
    with scratch(docs.sparkSession) as keep:
        signed = keep(texts.mapInArrow(_sign(n, bands), "doc_id long, n int, f1 long, f2 long, sig binary, bands array<long>"))
        sets = keep(signed.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
        firsts = sets.select(F.col("rep").alias("doc_id"), "copies")

        keys = keep(signed.join(merged(firsts), "doc_id", "left_semi").select("doc_id", F.explode("bands").alias("key")))
        shared = keep(keys.groupBy("key").agg(F.count("*").alias("size"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("lo", "hi"))
        members = join_groups(keys, shared, ["key"], keys.count())
        sigs = signed.select("doc_id", "n", "sig")
        buckets = _grouped(_blocked(members, "key", F.col("size") / bucket_block).drop("key").join(merged(sigs), "doc_id"))
        near = buckets.select("group", "side", "doc_id", "n", "sig").mapInArrow(_link_buckets(least, threshold), "a long, b long")
        clusters = keep(components(near).withColumnRenamed("node", "doc_id").join(signed.select("doc_id", "n").distinct(), "doc_id"))

        sizes = keep(clusters.groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("all")))
        blocks = F.greatest(F.col("size") / cluster_block, F.col("all") / cluster_shingles)
        placed = _blocked(join_groups(clusters.drop("n"), sizes, ["component"], clusters.count()), "component", blocks).drop("component", "all")
        whole = placed.join(merged(firsts), "doc_id").join(merged(sigs.select("doc_id", "sig")), "doc_id").join(merged(texts), "doc_id")
        found = keep(_grouped(whole.select("group", "side", "doc_id", "copies", "sig", "text")).mapInArrow(_verify_clusters(least, threshold, n), "doc_id long, links long, lead long"))

        classes = components(found.select("doc_id", "lead")).select(F.col("node").alias("rep"), F.col("component").alias("class"))
        links = found.groupBy(F.col("doc_id").alias("rep")).agg(F.sum("links").alias("links"))
        joined = sets.join(merged(links), "rep", "left").join(merged(classes), "rep", "left")
        per_set = keep(joined.select("f1", "f2", "n", F.col("copies").alias("size"), F.coalesce("class", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
        rows = kept(join_groups(signed.select("doc_id", "f1", "f2", "n"), per_set, ["f1", "f2", "n"], signed.count()).select("doc_id", "class_id", "n_links"))
    empty = texts.where(F.coalesce(F.length(F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", "")), F.lit(0)) == 0)
    return rows.unionByName(empty.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs without the documents of a class but its first, with all their columns."""
    gone = ngram_join(docs, **options).where("doc_id <> class_id").select("doc_id")
    return docs.join(merged(gone), "doc_id", "left_anti")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))
