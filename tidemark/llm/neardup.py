"""Near-duplicates by improved consistent weighted sampling (ICWS).

A text is a weighted set: its shingles of five words, each weighted by its number
times the mean inverse document frequency of its words.  ICWS draws from it
samples that two texts share with the probability of their weighted Jaccard
similarity.  Bands of samples propose pairs; a pair counts if its exact weighted
Jaccard similarity reaches the threshold.  Classes are the connected components.

Nodes of the graph are distinct texts, so that exact copies cost one node.
Texts that share the key of a band are a bucket:

- of a bucket of up to `small` texts and `block_bytes` every pair is verified in one task;
  buckets of the same texts are verified once;
- a larger one has leaders: its members with the most partners in all their buckets.
  Members are verified against the first leader, those it doesn't accept against the
  next ones, in blocks of bounded size.  Then every pair of a large bucket that the links
  found so far don't join, accepted members included, is verified in pairs of blocks.
  Blocks have up to `block` texts and `block_bytes`, so that a text is dealt out once for
  each block of the bucket and not once for each partner.

So each pair that shares a bucket is verified or joined by verified links: only the
banding loses links, and neither `small` nor the blocks nor the leaders change the classes.

Document frequencies are counted exactly, in a table partitioned by the words' hashes.
The inverse document frequency runs from 1 (a word of every document) to 2 (a word of
one document in 1000, or fewer).  So only words above that share must be known to the
tasks, and of those there can't be more than 1000 times the distinct words of a mean
document: a bound that doesn't grow with the corpus.  The damping keeps an edit's rare
words from outweighing all that two copies share.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, slices, text_or_empty, written
from tidemark.llm.components import connected_components
from tidemark.llm.ngram_lm import mixed

find_words = re.compile(r"\w+").findall
SHINGLE = 5
#: Words of a smaller share of the documents all weigh the same.
RARE = 1e-3
#: Distinct words that a task counts before it passes them on.
MOST_COUNTED = 1 << 20
BANDS, ROWS = 9, 4
LINKS = "a binary, b binary"
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: -ln((i + 1/2) / 65536): draws of sixteen bits.
LOGS = -np.log((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)


class WordHashes(dict):
    """Word to 64-bit hash, kept up to a bound."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= 200_000:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


def word_hashes(text: str | None, known: WordHashes) -> np.ndarray:
    found = find_words((text or "").lower())
    return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


@dataclass(frozen=True)
class WordWeights:
    """The inverse document frequencies of the words that aren't rare; all others have 2."""

    #: Their hashes, in order.
    words: np.ndarray
    weights: np.ndarray

    def of(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(words), 2.0, np.float32)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.weights[at], np.float32(2.0))


def word_frequencies(docs: DataFrame) -> DataFrame:
    """(word, n): the hash of every word, and how many documents have it.

    Tasks add up what they can hold; the table is partitioned by the hash.
    """

    def summed(parts: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        words, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        return words, np.bincount(inverse, np.concatenate(numbers), len(words)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        words, numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in slices(batches, 0):
            found = [np.unique(word_hashes(t, known)) for t in batch.column(0).to_pylist()]
            new, n = np.unique(np.concatenate(found), return_counts=True)
            words, numbers = summed([words, new], [numbers, n])
            if len(words) > MOST_COUNTED:
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(numbers)], ["word", "n"])
                words, numbers = words[:0], numbers[:0]
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(numbers)], ["word", "n"])

    return docs.select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def word_weights(docs: DataFrame) -> WordWeights:
    """The weights of the words of more than RARE of the documents, from exact counts.

    The driver gets those words alone: at most 1 / RARE times the distinct words of a mean document.
    """
    documents = max(1, docs.count())
    common = word_frequencies(docs).where(F.col("n") > RARE * documents).toArrow()
    words = common.column("word").to_numpy().view(np.uint64)
    share = np.minimum(1.0, common.column("n").to_numpy() / documents)
    order = np.argsort(words)
    return WordWeights(words[order], (1 + np.log(1 / share[order]) / -math.log(RARE)).astype(np.float32))


def weighted_shingles(words: np.ndarray, idf: WordWeights) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text's words, in order, and their weights.  A text of fewer than five words is one shingle."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.float32)
    width = min(SHINGLE, len(words))
    w = idf.of(words).astype(np.float64)
    n = len(words) - width + 1
    h, weight = np.zeros(n, np.uint64), np.zeros(n)
    for i in range(width):
        h = h * K1 + words[i : i + n]
        weight += w[i : i + n]
    h = mixed(h + np.uint64(width))
    keys, first, number = np.unique(h, return_index=True, return_counts=True)
    return keys, (number * weight[first] / width).astype(np.float32)


def samples(keys: np.ndarray, weights: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """The k-th ICWS sample of each set; starts: where the sets begin in keys and weights."""
    with np.errstate(over="ignore"):
        x = (keys ^ (np.uint64(k + 1) * K2)) * K1
        x ^= x >> np.uint64(29)
        x *= K2
        x ^= x >> np.uint64(32)
        draws = x.view(np.uint16).reshape(-1, 4)
        beta = ((x * K1) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        r = LOGS[draws[:, 0]] + LOGS[draws[:, 1]]
        c = LOGS[draws[:, 2]] + LOGS[draws[:, 3]]
        t = np.floor(np.log(weights) / r + beta)
        score = np.log(c) - r * (t - beta) - r
        # Floats as numbers that sort alike, above the sample's own bits: one minimum gives both.
        bits = score.view(np.int32).astype(np.int64)
        rank = np.where(bits < 0, -(bits & 0x7FFFFFFF) - 1, bits) + (1 << 31)
        ident = ((keys ^ (t.astype(np.int64).astype(np.uint64) * K2)) * K1) >> np.uint64(32)
        return np.minimum.reduceat((rank.astype(np.uint64) << np.uint64(32)) | ident, starts) & np.uint64(0xFFFFFFFF)


def band_keys(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A matrix (sets, BANDS) of 64-bit keys; no set is empty."""
    keys, weights = np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets])
    starts = np.cumsum([0, *(len(s[0]) for s in sets[:-1])])
    out = np.zeros((len(sets), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            key = np.full(len(sets), band + 1, np.uint64)
            for row in range(ROWS):
                key = mixed(key * K1 + samples(keys, weights, starts, band * ROWS + row))
            out[:, band] = key
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The weighted Jaccard similarity of two sets."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    x, y = a[1][i].astype(np.float64), b[1][j].astype(np.float64)
    low = float(np.minimum(x, y).sum())
    high = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - low
    return low / high if high > 0 else 0.0


def node_of(text: str | Column = "text") -> Column:
    """What tells distinct texts apart, a hash of 128 bits; null counts as the empty text."""
    return F.unhex(F.md5(text_or_empty(text).cast("binary")))


def digest(*columns: str | Column) -> Column:
    """A key of 128 bits for groups of rows."""
    return F.struct(F.xxhash64(*columns).alias("one"), F.xxhash64(F.lit(1), *columns).alias("two"))


def signatures(docs: DataFrame, idf: Broadcast) -> DataFrame:
    """(doc_id, node, load, bands) of each row: node is a hash of the text, bands its keys (none for texts without words).

    load is what a task that compares the text must hold: its bytes, or eight for each shingle.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches, 3, 1 << 20):
            bands: list[np.ndarray | None] = [None] * batch.num_rows
            sets = [weighted_shingles(word_hashes(t, known), idf.value) for t in batch.column(3).to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s[0])]
            if full:
                for i, keys in zip(full, band_keys([sets[i] for i in full]), strict=True):
                    bands[i] = keys.view(np.int64)
            keyed = pa.array([[] if b is None else b for b in bands], pa.list_(pa.int64()))
            load = np.maximum(batch.column(2).to_numpy(), [8 * len(s[0]) for s in sets])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(load, pa.int64()), keyed], ["doc_id", "node", "load", "bands"])

    # Texts without words are told apart by their hash alone: equal ones are copies.
    size = F.octet_length(text_or_empty("text")).cast("long").alias("load")
    rows = docs.select("doc_id", node_of().alias("node"), size, "text")
    return rows.mapInArrow(sign, f"doc_id {kind}, node binary, load bigint, bands array<bigint>")


def _texts(docs: DataFrame, nodes: DataFrame, broadcast_nodes: int) -> DataFrame:
    """(node, text), one row for each of nodes.  Few nodes are broadcast, and only their texts shuffled."""
    wanted = nodes.select("node").distinct()
    if wanted.count() <= broadcast_nodes:
        wanted = F.broadcast(wanted)
    rows = docs.select(node_of().alias("node"), "text").join(wanted, "node", "left_semi")
    return rows.groupBy("node").agg(F.first("text").alias("text"))


def _root(top: list[int], i: int) -> int:
    while top[i] != i:
        top[i] = top[top[i]]
        i = top[i]
    return i


def _verify_all(rows: pa.Table, idf: WordWeights, threshold: float) -> pa.Table:
    """Verified links of all pairs among the rows (node, text), but for those that links of the group join already."""
    known = WordHashes()
    nodes = rows.column("node").to_pylist()
    sets = [weighted_shingles(word_hashes(t, known), idf) for t in rows.column("text").to_pylist()]
    top = list(range(len(nodes)))
    a, b = [], []
    for i in range(len(nodes)):
        for j in range(i + 1, len(nodes)):
            if _root(top, i) != _root(top, j) and similarity(sets[i], sets[j]) >= threshold:
                top[_root(top, j)] = _root(top, i)
                a.append(nodes[i])
                b.append(nodes[j])
    return pa.Table.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _verify_apart(rows: pa.Table, idf: WordWeights, threshold: float) -> pa.Table:
    """Verified links among the rows (node, band, component, side, cross, text, bands) of different components, and of different sides if cross.

    Left out are pairs that links of the group join already, and those that met in an earlier band.
    """
    known = WordHashes()
    nodes, sides = rows.column("node").to_pylist(), rows.column("side").to_numpy()
    cross, band = rows.column("cross")[0].as_py(), rows.column("band")[0].as_py()
    earlier = np.array([x[:band] for x in rows.column("bands").to_pylist()], np.int64).reshape(len(nodes), band)
    sets = [weighted_shingles(word_hashes(t, known), idf) for t in rows.column("text").to_pylist()]
    starts = np.cumsum([0, *(len(s[0]) for s in sets[:-1])])
    weights = np.concatenate([s[1] for s in sets]).astype(np.float64)
    distinct, place = np.unique(np.concatenate([s[0] for s in sets]), return_inverse=True)
    ends = [*starts[1:].tolist(), len(place)]
    totals = np.add.reduceat(weights, starts)
    mine = np.zeros(len(distinct))
    label = np.unique(rows.column("component").to_numpy(), return_inverse=True)[1]
    a, b = [], []
    for i in range(len(nodes) - 1):
        apart = label[i + 1 :] != label[i]
        if cross:
            apart &= sides[i + 1 :] != sides[i]
        if band and apart.any():
            apart &= ~(earlier[i + 1 :] == earlier[i]).any(axis=1)
        if not apart.any():
            continue
        at = slice(starts[i], ends[i])
        mine[place[at]] = weights[at]
        begin = starts[i + 1]
        low = np.add.reduceat(np.minimum(mine[place[begin:]], weights[begin:]), starts[i + 1 :] - begin)
        mine[place[at]] = 0
        for j in (np.flatnonzero(apart & (low / (totals[i] + totals[i + 1 :] - low) >= threshold)) + i + 1).tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                a.append(nodes[i])
                b.append(nodes[j])
    return pa.Table.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _verify_block(rows: pa.Table, idf: WordWeights, threshold: float) -> pa.Table:
    """Verified links of the members (role 0) of a block with its leader (role 1)."""
    known = WordHashes()
    nodes, roles, texts = (rows.column(c).to_pylist() for c in ("node", "role", "text"))
    lead = roles.index(1)
    leader = weighted_shingles(word_hashes(texts[lead], known), idf)
    linked = [n for n, role, t in zip(nodes, roles, texts, strict=True) if not role and similarity(leader, weighted_shingles(word_hashes(t, known), idf)) >= threshold]
    return pa.Table.from_arrays([pa.array(linked, pa.binary()), pa.array([nodes[lead]] * len(linked), pa.binary())], ["a", "b"])


def _links_with(pairs: DataFrame, texts: DataFrame, idf: Broadcast, threshold: float) -> DataFrame:
    """Verified links among pairs (node, leader, parts), in blocks of members of one leader.

    parts: blocks of a bucket that both are in; the largest says among how many a member is dealt.
    """
    dealt = pairs.groupBy("node", "leader").agg(F.max("parts").alias("parts")).withColumn("block", F.pmod(F.xxhash64("node"), "parts"))
    members = dealt.select("leader", "block", "node", F.lit(0).alias("role"))
    leaders = dealt.select("leader", "block").distinct().select("leader", "block", F.col("leader").alias("node"), F.lit(1).alias("role"))
    rows = members.union(leaders).join(texts, "node")
    return rows.groupBy("leader", "block").applyInArrow(lambda t: _verify_block(t, idf.value, threshold), LINKS)


def _links_within(shared: DataFrame, texts: DataFrame, idf: Broadcast, threshold: float) -> DataFrame:
    """Verified links of all pairs in the buckets of shared (node, band, key).  Buckets of the same texts are one group for all."""
    members = shared.groupBy("band", "key").agg(F.sort_array(F.collect_list("node")).alias("members")).select("members").distinct()
    whole = members.select(digest("members").alias("group"), F.explode("members").alias("node"))
    return whole.join(texts, "node").groupBy("group").applyInArrow(lambda t: _verify_all(t, idf.value, threshold), LINKS)


def _links_between(large: DataFrame, joined: DataFrame, banded: DataFrame, texts: DataFrame, idf: Broadcast, threshold: float, limits: Limits) -> DataFrame:
    """Verified links of all pairs in the buckets of large (node, load, band, key) that joined (node, component) leaves apart.

    A component that fills half a block of a bucket is dealt into blocks of its own, the rest
    of the bucket into common ones.  Each two blocks, unless they are of one
    component, are one task's work.  Buckets of a single component have none.
    """
    bucket = ["band", "key"]
    component = F.coalesce("component", "node").alias("component")
    held = large.select("node", "load", *bucket).join(joined, "node", "left").select("node", "load", *bucket, component)
    sums = [F.count(F.lit(1)).alias("n"), F.sum("load").alias("load")]
    sizes = written(held.groupBy(*bucket, "component").agg(*sums), "parts")

    # The component's own blocks, or (owner null) the bucket's common ones.
    owner = F.when(limits.blocks("n", "load", 2) > 1, F.col("component")).alias("owner")
    apart = sizes.groupBy(*bucket).agg(F.count(F.lit(1)).alias("components")).where("components > 1").select(*bucket)
    owned = sizes.join(apart, bucket).select(*bucket, "component", owner, "n", "load")
    sets = owned.groupBy(*bucket, "owner").agg(F.sum("n").alias("n"), F.sum("load").alias("load"))
    sets = written(sets.select(*bucket, "owner", limits.blocks("n", "load", 2).alias("parts")), "block-sets")
    numbered = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1), lambda i: F.struct(F.col("owner").alias("owner"), i.alias("number")))
    blocks = sets.groupBy(*bucket).agg(F.flatten(F.collect_list(numbered)).alias("blocks"))

    dealt = owned.select(*bucket, "component", "owner").join(sets.withColumnRenamed("owner", "set_owner"), bucket).where(F.col("owner").eqNullSafe(F.col("set_owner")))
    mine = F.struct("owner", F.pmod(F.xxhash64("node"), F.col("parts")).alias("number")).alias("mine")
    placed = held.join(dealt, [*bucket, "component"]).select("node", *bucket, "component", mine)
    met = F.filter("blocks", lambda x: x["owner"].isNull() | ~x["owner"].eqNullSafe(F.col("mine.owner")))
    pairs = placed.join(blocks, bucket).select("node", *bucket, "component", "mine", F.explode(met).alias("other"))
    one, two = F.to_json("mine"), F.to_json("other")
    group = digest(*bucket, F.least(one, two), F.greatest(one, two)).alias("group")
    rows = pairs.select(group, "node", "band", "component", F.xxhash64(one).alias("side"), (one != two).alias("cross"))
    # `bands` tell whether two texts met in an earlier band: there they are verified.
    rows = rows.join(texts, "node").join(banded.select("node", "bands"), "node")
    return rows.groupBy("group").applyInArrow(lambda t: _verify_apart(t, idf.value, threshold), LINKS)


@dataclass(frozen=True)
class Limits:
    """What one task verifies at once.  None of it changes the classes."""

    #: A bucket of more texts, or of more bytes than a block, has leaders.
    small: int = 64
    #: Texts of a block, and their load: the larger of a text's bytes and eight times its shingles.
    block: int = 1024
    block_bytes: int = 8 << 20
    leaders: int = 4
    #: As many texts' hashes are broadcast.
    broadcast_nodes: int = 500_000

    def is_large(self) -> Column:
        return (F.col("n") > self.small) | (F.col("bucket_bytes") > self.block_bytes)

    def blocks(self, n: str, load: str, share: int = 1) -> Column:
        """Into how many blocks, of 1/share of the full size, so many texts of such a load go."""
        by_rows, by_bytes = F.ceil(F.col(n) * share / self.block), F.ceil(F.col(load) * share / self.block_bytes)
        return F.greatest(by_rows, by_bytes, F.lit(1)).cast("long")


def near_duplicate_classes(docs: DataFrame, *, threshold: float = 0.8, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, class_id) of every row of docs; class_id is the smallest doc_id of the class.

    Equal texts are in one class, and so are texts that links of the threshold or
    more join.  Null texts count as empty; texts without words are copies only of
    equal ones; texts of one to four words are one shingle.  Null ids belong to their
    text's class; a class of null ids alone has a null class_id.  Repeated rows are
    returned each.
    """
    ids = _classed(docs, threshold, limits)
    # Written, so that the join has shuffles of its own, of which Spark can split a large class.
    classes = written(ids.groupBy("class").agg(F.min("doc_id").alias("class_id")), "classes")
    return ids.join(classes, "class").select("doc_id", "class_id")


def _classed(docs: DataFrame, threshold: float, limits: Limits) -> DataFrame:
    """(doc_id, node, class) of every row of docs."""
    docs = docs.select("doc_id", "text")
    idf = docs.sparkSession.sparkContext.broadcast(word_weights(docs))
    signed = written(signatures(docs, idf), "signatures")
    banded = signed.groupBy("node").agg(F.first("bands").alias("bands"), F.first("load").alias("load"))
    keyed = banded.select("node", "load", F.posexplode("bands").alias("band", "key"))
    per = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("load").alias("bucket_bytes")).where("n > 1")
    shared = written(keyed.join(per, ["band", "key"]), "shared-bands")
    texts = written(_texts(docs, shared, limits.broadcast_nodes), "shared-texts")
    links = written(_links_within(shared.where(~limits.is_large()), texts, idf, threshold), "verified")
    large = shared.where(limits.is_large())
    joined = connected_components(links) if large.isEmpty() else _join_large(large, shared, links, banded, texts, idf, threshold, limits)
    named = F.coalesce("component", "node").alias("class")
    return signed.select("doc_id", "node").join(joined, "node", "left").select("doc_id", "node", named)


def _join_large(large: DataFrame, shared: DataFrame, links: DataFrame, banded: DataFrame, texts: DataFrame, idf: Broadcast, threshold: float, limits: Limits) -> DataFrame:
    """(node, component) by links and the links of large buckets."""
    verified, open_ = [links], large
    ranked = written(_ranked_leaders(large, shared, limits.leaders), "leaders")
    for places in (F.col("place") == 1, F.col("place") > 1):
        led = open_.join(ranked.where(places), ["band", "key"]).where("node <> leader")
        # Members are compared with one text only: small blocks spread a hot bucket at no cost.
        pairs = led.select("node", "leader", limits.blocks("n", "bucket_bytes", 8).alias("parts"))
        found = written(_links_with(pairs, texts, idf, threshold), "verified")
        verified.append(found)
        done = found.select(F.col("a").alias("node")).union(found.select(F.col("b").alias("node"))).distinct()
        open_ = written(open_.join(done, "node", "left_anti"), "open")
        if open_.isEmpty():
            break
    joined = connected_components(reduce(DataFrame.union, verified))
    more = written(_links_between(large, joined, banded, texts, idf, threshold, limits), "verified")
    if more.isEmpty():
        return joined
    return connected_components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))


def _ranked_leaders(large: DataFrame, shared: DataFrame, places: int) -> DataFrame:
    """(band, key, leader, place) of large buckets: the members with the most partners in all their buckets, by place from 1."""
    partners = shared.groupBy("node").agg(F.sum(F.col("n") - 1).alias("partners"))
    held = large.select("node", "band", "key").join(partners, "node")
    ranked = Window.partitionBy("band", "key").orderBy(F.desc("partners"), "node")
    # row_number under a limit: Spark keeps the first rows of each task's groups before it shuffles.
    return held.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= places).select("band", "key", F.col("node").alias("leader"), "place")


def keep_one_of_each(docs: DataFrame, *, threshold: float = 0.8, limits: Limits = Limits(), broadcast_ids: int = 500_000) -> DataFrame:
    """One row of each class of near-duplicates: the first by doc_id (nulls last), then by the text's hash.

    Of repeated rows (same id and text) one stays, the first by the other columns, which must have an order.
    An id that comes with several texts is judged by each of them.
    """
    ids = written(_classed(docs, threshold, limits), "classed")
    rows = ids.groupBy("class", "doc_id", "node").agg(F.count(F.lit(1)).alias("times"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")).alias("first")
    chosen = written(ids.groupBy("class").agg(first), "chosen")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("node") == F.col("first.node"))
    its_id, its_node = free_name(docs, "its_id"), free_name(docs, "its_node")
    judged = rows.join(chosen, "class").select(F.col("doc_id").alias(its_id), F.col("node").alias(its_node), stays.alias("stays"), "times")
    # Only what isn't kept as it is: others' copies, and kept ones that are repeated.
    touched = written(judged.where(~F.col("stays") | (F.col("times") > 1)).drop("times"), "duplicates")
    few = touched.count() <= broadcast_ids
    node = node_of(docs["text"])

    def among(marks: DataFrame, how: str) -> DataFrame:
        marks = F.broadcast(marks) if few else marks
        return docs.join(marks, docs["doc_id"].eqNullSafe(marks[its_id]) & (node == marks[its_node]), how)

    whole = among(touched.select(its_id, its_node), "left_anti")
    repeated = among(touched.where("stays").select(its_id, its_node), "inner").groupBy(its_id, its_node).agg(F.min(F.struct(*(docs[c] for c in docs.columns))).alias("row"))
    return whole.unionByName(repeated.select("row.*"))
