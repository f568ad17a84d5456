"""The numbered operators on small inputs: against brute force, and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import common, components, decontam, fingerprint, mixing, neardup, ngram_lm, sharding, tokens, toxicity, url_reputation, warc
from tidemark.llm.queries import URL_RULES

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
VOCABULARY = [f"{a}{b}" for a in ("ba", "ce", "di", "fo", "gu", "ha", "je", "ki") for b in ("lo", "mer", "nit", "pas", "ros", "tun", "vel", "wix")]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(i, ".\n".join(sentence(rng, rng.randint(4, 15)) for _ in range(rng.randint(1, 8))), "en", f"s{rng.randint(0, 4)}", 0) for i in range(n)]
    rows += [(n, None, "en", "s0", 0), (n + 1, "", None, None, 0), (None, "no id here at all", "en", "s1", 0), (None, None, None, None, None), (3, rows[3][1], "en", rows[3][3], 0)]
    rows += [(n + 2, "word " * 30000, "en", "s1", 0), (n + 3, " \t\n", "en", "é", 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((v is not None, v) for v in row)


# 1


def test_token_counts_are_the_librarys(spark, docs):
    extra = spark.createDataFrame([(100, "a <|endoftext|> b", "", "", 0), (101, "x\x1cy\u0085z  \n\n 'll ٣½漢", "", "", 0), (102, "😀" * 50, "", "", 0)], SCHEMA)
    t = tokens.load_tokenizer(TOKENIZER)
    for table in (4, 32768):
        got = tokens.token_counts(docs.union(extra), TOKENIZER, table_entries=table, cache_entries=8).collect()
        assert len(got) == docs.count() + 3
        texts = sorted(((r.doc_id, r.text or "") for r in docs.union(extra).collect()), key=key)
        want = [(i, len(x.encode()), len(t.encode(x, add_special_tokens=False).ids)) for i, x in texts]
        assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=key) == sorted(want, key=key)
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)


def test_frequent_words_come_from_all_texts(spark):
    rows = [(f"w{i % 50} " * (1 + i % 7) + f"rare{i}",) for i in range(400)]
    docs = spark.createDataFrame([*rows, (None,), ("",)], "t string").repartition(4)
    want = Counter(w for (t,) in rows for w in t.split())
    got = tokens.frequent_words(docs, "t", 50)
    # Tasks pass on their most frequent words: a rare word's number can come out lower.
    assert len(got) == 50 and all(w.startswith("w") and 0.9 * want[w] <= n <= want[w] for w, n in got.items())
    assert tokens.frequent_words(docs, "t", 450) == dict(want)


def test_token_counts_replace_clashing_columns_and_take_empty_tables(spark, empty):
    assert tokens.token_counts(empty, TOKENIZER).count() == 0
    odd = spark.createDataFrame([(1, "one two", 9, "x")], "doc_id bigint, text string, N_Tokens int, text_to_count string")
    row = tokens.token_counts(odd, TOKENIZER).first()
    assert (row.n_tokens, row.text_to_count) == (2, "x")


# 2


def toxic_corpus(n: int = 1500):
    rng = random.Random(7)
    bad = ["vexgrol", "snarkum", "blutzig"]
    rows, labels = [], []
    for i in range(n):
        words, toxic = sentence(rng, rng.randint(20, 60)).split(), rng.random() < 0.15
        for _ in range(rng.randint(1, 4) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), "en", "s", 0))
        if rng.random() < 0.6:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    model = toxicity.train_toxicity(docs, spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int"))
    truth = dict((i, x) for i, _, x in labels)
    scored = {r.doc_id: r for r in toxicity.toxicity_scores(docs, model).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum(scored[i].predicted == truth[i] for i in held)
    assert len(held) > 100 and right / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored.values())
    kept = {r.doc_id for r in toxicity.keep_clean(docs, model).collect()}
    assert kept == {i for i, r in scored.items() if not r.predicted}


def test_toxicity_never_reads_held_out_labels(spark):
    rows, labels = toxic_corpus(600)
    docs = spark.createDataFrame(rows, SCHEMA)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = (toxicity.train_toxicity(docs, spark.createDataFrame(x, "doc_id bigint, quality int, toxic int")) for x in (labels, turned))
    assert a == b


def test_toxicity_without_labels_and_on_awkward_rows(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = toxicity.train_toxicity(docs, none)
    assert {r.predicted for r in toxicity.toxicity_scores(docs, model).collect()} == {0}
    assert toxicity.toxicity_scores(empty, model).count() == 0 and toxicity.train_toxicity(empty, none).weights == {}


def test_the_risk_stays_non_negative():
    # Each text has a word of its own, so that all are distinct.
    flagged, other = (lambda n: ([2, 4, 100 + 2 * n], [1, 1, 1])), (lambda n: ([4, 100 + 2 * n], [1, 1]))
    model = toxicity.fit_nnpu([flagged(n) for n in range(100)], [flagged(n) for n in range(100, 140)] + [other(n) for n in range(140, 500)], 0.1)
    z = lambda f: model.bias + sum(model.weights.get(k, 0.0) for k in f[0])
    assert z(flagged(999)) > 0 > z(other(999))


def test_copies_of_a_text_make_no_feature():
    copied, other = ([2, 4], [1, 1]), (lambda n: ([4, 100 + 2 * n], [1, 1]))
    model = toxicity.fit_nnpu([copied] * 100 + [other(n) for n in range(50)], [other(n) for n in range(50, 450)], 0.1)
    assert 2 not in model.weights


def test_toxic_words_that_are_rare_each(spark):
    rng = random.Random(6)
    bad = [f"zz{a}{b}" for a in "abcdefghij" for b in "klmnopqrstuvwxyz"]
    rows, labels = [], []
    for i in range(5000):
        words, toxic = sentence(rng, 30).split() + [f"name{rng.randint(0, 4000)}" for _ in range(5)], i % 6 == 0
        words[10:10] = [rng.choice(bad) for _ in range(3 * toxic)]
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    model = toxicity.train_toxicity(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    found = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(docs, model).collect()}
    held = [i for i in range(5000) if zlib.crc32(str(i).encode()) % 5 == 0]
    # Each word is in about 2 % of the toxic texts.
    assert np.mean([found[i] for i in held if i % 6 == 0]) > 0.95 and np.mean([found[i] for i in held if i % 6]) < 0.02


def test_toxicity_of_very_long_and_repeated_texts(spark):
    rows, labels = toxic_corpus(800)
    long = "calm words " * 60000
    rows += [(5000, long, "en", "s", 0), (5001, long + "vexgrol snarkum blutzig", "en", "s", 0), (5001, long + "vexgrol snarkum blutzig", "en", "s", 0), (None, None, None, None, None), (5002, "", None, None, 0)]
    docs = spark.createDataFrame([(*r, 0.5, 1) for r in rows], SCHEMA + ", score double, predicted int").repartition(4)
    model = toxicity.train_toxicity(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    got = [(r.doc_id, r.predicted) for r in toxicity.toxicity_scores(docs, model).where("doc_id >= 5000 or doc_id is null").collect()]
    assert sorted(got, key=key) == [(None, 0), (5000, 0), (5001, 1), (5001, 1), (5002, 0)]
    assert sorted(r.doc_id for r in toxicity.keep_clean(docs, model).where("doc_id >= 5000").collect()) == [5000, 5002]


# 3


def test_targets_by_hand():
    assert mixing.targets({"a": 100, "b": 100, None: 100}) == pytest.approx({"a": 200.0, "b": 250 * 2 / 3, None: 250 / 3})
    assert mixing.targets({"a": 0, "b": 10}) == {"a": 0.0, "b": 15.0}
    assert mixing.targets({}) == {}


def test_the_tree_deals_exact_quotas():
    dealt = mixing.deal_blocks([5, 1000, 0, 77], 7, 1)
    assert dealt.sum(axis=0).tolist() == [5, 1000, 0, 77]
    assert set(dealt.sum(axis=1)) <= {154, 155} and (dealt >= 0).all()


def test_mix_takes_the_quotas(docs):
    first, again = (sorted(map(tuple, mixing.mix(docs, shards=5).select("doc_id", "taken", "target", "source").collect()), key=key) for _ in range(2))
    assert first == again
    rows = mixing.mix(docs, shards=5).collect()
    assert len(rows) == docs.count()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r.source] += size(r.text)
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * size(r.text)
        assert sum(p.n_words for p in r.pieces) == r.taken
    assert target == pytest.approx(mixing.targets(dict(sizes)))
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)


@pytest.mark.parametrize("block", [1, 40, 10**6])
def test_shards_get_what_the_tree_deals(docs, block):
    shards, seed = 5, 23
    rows = mixing.mix(docs, shards=shards, seed=seed, block_words=block).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes: Counter = Counter()
    for r in rows:
        sizes[r.source] += size(r.text)
    goal = mixing.targets(dict(sizes))
    blocks = [-(-round(t) // block) for t in goal.values()]
    dealt = mixing.deal_blocks(blocks, shards, seed)
    owner, words = {}, Counter()
    for r in rows:
        assert len({p["pass"] for p in r.pieces}) == len(r.pieces) <= 2
        for p in r.pieces:
            assert owner.setdefault((r.source, p.block), p.shard) == p.shard, "a block has one shard"
            words[r.source, p.block] += p.n_words
    longest = max(size(r.text) for r in rows)
    assert all(n < block + longest for n in words.values())
    for i, s in enumerate(goal):
        mine = Counter(k for (source, _), k in owner.items() if source == s)
        assert all(b < blocks[i] for source, b in owner if source == s) and all(mine[k] <= dealt[k, i] for k in range(shards))
        if block == 40 and blocks[i] > 60:  # drawn from all over the line
            first = sorted(b for (source, b), k in owner.items() if source == s and k == 0)
            assert first != list(range(first[0], first[0] + len(first)))
    if block == 1:
        order = [i for _, i in sorted((p.local_order, r.doc_id) for r in rows for p in r.pieces if p.shard == 0 and r.doc_id is not None)]
        assert order != sorted(order)


def test_blocks_are_permuted():
    for q in mixing.quotas({"a": 1000, "b": 77, "c": 0}, {"a": 1000.0, "b": 77.0, "c": 0.0}, 4, 3, block_words=7):
        assert sorted((q.factor * b + q.shift) % q.blocks for b in range(q.blocks)) == list(range(q.blocks)) and q.ends[-1] == -(-q.words // 7)


def test_the_mix_does_not_depend_on_the_cut_of_its_input(spark):
    same = spark.range(6000).select(F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("copy "), (F.col("id") % 2).cast("string")).alias("text"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"))
    rest = spark.range(3000).select("id", F.concat(F.lit("text "), F.col("id").cast("string")), F.lit("s1"))
    docs, took, places = same.union(rest), [], []
    for cut in (3, 7):
        rows = docs.repartition(cut)
        took.append(sorted(((r.doc_id, r.source, r.taken, len(r.pieces)) for r in mixing.mix(rows, block_words=50).collect()), key=key))
        places.append(sorted(((r.doc_id, r.text, r.shard, r.slot) for r in sharding.shard_rows(rows, 7).collect()), key=key))
    assert took[0] == took[1] and places[0] == places[1]


def test_mixed_documents_are_whole(docs, empty):
    mixed = mixing.mix(docs, shards=5, whole=True, block_words=20)
    rows, out = mixed.collect(), mixing.mixed_documents(mixed).collect()
    assert {r.text for r in out} <= {r.text for r in docs.collect()} and set(docs.columns) <= set(mixing.mixed_documents(mixed).columns)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    taken, longest, target = Counter(), Counter(), {}
    for r in rows:
        assert not size(r.text) or r.taken % size(r.text) == 0 and r.taken <= 2 * size(r.text)
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], size(r.text))
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1 for s in target)
    assert sum(size(r.text) for r in out) == sum(taken.values())
    assert {r.shard for r in out} == set(range(5))
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(mixing.mix(empty, whole=True)).count() == 0


def test_many_sources_are_mixed_alike(spark, docs, monkeypatch):
    rng = random.Random(13)
    more = [(1000 + i, sentence(rng, rng.randint(0, 20)), "en", f"m{rng.randint(0, 40)}", 0) for i in range(300)]
    docs = docs.union(spark.createDataFrame(more, SCHEMA))
    takes = lambda rows: sorted(((r.doc_id, r.text, r.source, r.source_size, round(r.target, 6), r.taken) for r in rows), key=key)
    few = {w: mixing.mix(docs, shards=5, whole=w).collect() for w in (False, True)}
    monkeypatch.setattr(mixing, "MOST_SOURCES", 3)
    monkeypatch.setattr(mixing, "GROUPS", 4)
    for whole in (False, True):
        many = mixing.mix(docs, shards=5, whole=whole, block_words=9).collect()
        assert takes(many) == takes(few[whole])
        assert {p.shard for r in many for p in r.pieces} == set(range(5))
        assert all(sum(p.n_words for p in r.pieces) == r.taken for r in many)


def test_mix_keeps_clashing_names_apart(spark):
    odd = spark.createDataFrame([(i, "a b c", "s", 9, "x", 1, 2) for i in range(20)], "doc_id bigint, text string, source string, Target int, bucket string, s int, ends int")
    rows = mixing.mix(odd).collect()
    assert {(r.target, r.bucket, r.s, r.taken <= 6) for r in rows} == {(90.0, "x", 1, True)}


# Rows that are equal in all columns


def test_equal_rows_are_spread(spark):
    same = spark.range(6000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("copy of a text").alias("text"), F.lit("s").alias("source"))
    rest = spark.range(3000).select("id", F.concat(F.lit("text "), "id"), F.lit("s"))
    docs = same.union(rest).repartition(5).cache()
    rows, counts = common.scattered(docs, [F.col("doc_id"), F.col("text")], common.root_buckets(9000), 1, "b", "o")
    got = dict(map(tuple, counts.collect()))
    assert sum(got.values()) == 9000 and max(got.values()) < 300
    assert got == {r.b: r["count"] for r in rows.groupBy("b").count().collect()}
    rows, merged = common.merged_copies(docs)
    assert merged and rows.count() == 3001 and rows.agg(F.max("times")).first()[0] == 6000
    again = common.repeated(rows, at_once=500)
    assert again.columns == ["doc_id", "text"] and again.count() == 9000 and again.where("doc_id is null").count() == 6000
    scores = ngram_lm.backoff_scores(docs).groupBy("doc_id", "log_score").count().where("doc_id is null").collect()
    assert [(r["count"], round(r.log_score, 5)) for r in scores] == [(6000, backoff_by_hand([(r.doc_id, r.text) for r in docs.collect()], 3)[0][2])]
    shards = sharding.shard_rows(docs, 7).collect()
    assert sorted((r.shard, r.slot) for r in shards) == [(k, i) for k in range(7) for i in range(9000 // 7 + (k < 9000 % 7))]
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == 9000 and sum(r.taken for r in mixed) == round(1.5 * (6000 * 4 + 3000 * 2)) and max(r.taken for r in mixed) <= 8


# 4


def test_warc_round_trip(spark):
    big = "<html>ü" + "x" * 2000
    rows = [(1, "http://a/%41 b\r\n", "small"), (2, None, None), (3, "http://b", big), (9, "http://c", big), (5, "", big), (None, "http://d", big), (7, "http://e", "small"), (9, "http://c", big), (8, "http://f", "é\x00" * 5000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, payload_digest string").repartition(3)
    got = warc.archive_round_trip(pages).collect()
    want = [(i, u, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if h == big and i != 9 else "response", 9 if h == big and i != 9 else None) for i, u, h in rows]
    assert sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)


def test_warc_index_selects_records(spark, tmp_path):
    pages = spark.range(50).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.col("id").cast("string"), 600).alias("html"))
    index = warc.write_archives(warc.with_revisits(pages), str(tmp_path / "warc"), archive_bytes=900)
    assert index.select("file").distinct().count() > 2
    picked = warc.read_records(index.where("page_id % 7 = 3")).collect()
    total = index.agg(F.sum("length")).first()[0]
    assert warc.read_records(index, task_bytes=total // 6 + 1).rdd.getNumPartitions() == 6
    assert sorted((r.page_id, r.payload.decode()) for r in picked) == [(i, str(i) * 600) for i in range(3, 50, 7)]
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_ranges_join_neighbours():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 100, 5), ("b", 0, 5)]
    assert list(warc.ranges(rows, 20, 1000)) == [("a", 0, 15, [0, 1]), ("a", 100, 5, [2]), ("b", 0, 5, [3])]
    assert [r[3] for r in warc.ranges(rows, 1000, 12)] == [[0], [1], [2], [3]]


# 5


def edit_distance_to_run(item: list[str], words: list[str]) -> int:
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(words, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    many = [f"w{i}" for i in range(400)]
    say = lambda n: [rng.choice(many) for _ in range(n)]
    items = [(i, " ".join(say(rng.randint(8, 40)))) for i in range(25)] + [(90, "never said"), (91, None), (92, "")]
    rows = []
    for d in range(160):
        words = say(rng.randint(0, 120))
        if d % 2 == 0:
            leak = rng.choice(items[:25])[1].split()
            for _ in range(rng.randint(0, len(leak) // 5) if d % 4 else 0):
                at = rng.randrange(len(leak))
                match rng.randint(0, 2):
                    case 0:
                        leak[at] = rng.choice(many)
                    case 1:
                        leak.insert(at, rng.choice(many))
                    case _:
                        del leak[at]
            at = rng.randint(0, len(words))
            words[at:at] = leak
        rows.append((d, " ".join(words).upper() if d % 3 == 0 else ", ".join(words), "en", "s", 0))
    rows += [(None, items[0][1], "", "", 0), (200, None, "", "", 0), (201, items[1][1], "", "", 0), (201, items[1][1], "", "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = set()
    for d, text, *_ in rows:
        words = re.findall(r"\w+", (text or "").lower())
        for i, t in items[:25]:
            item = t.split()
            if words and edit_distance_to_run(item, words) <= int(0.2 * len(item) + 1e-9):
                want.add((d, i))
    for block in (400, 16 << 20):
        got = [(r.doc_id, r.item_id, r.distance) for r in decontam.benchmark_leaks(docs, bench, block_bytes=block).collect()]
        pairs = {(d, i) for d, i, _ in got}
        assert pairs <= want and len(pairs) >= 0.95 * len(want)
        assert {d for d, _ in pairs} >= {d for d in range(0, 160, 4)}
        assert Counter(got)[201, 1, 0] == 2
    kept = {r.doc_id for r in decontam.drop_leaks(docs, bench).collect()}
    assert not kept & {d for d, _ in pairs} and 200 in kept
    assert decontam.benchmark_leaks(docs.limit(0), bench).count() == decontam.benchmark_leaks(docs, bench.limit(0)).count() == 0


def test_short_items_leak_by_the_same_words(spark):
    bench = [(1, "Alpha beta gamma delta"), (2, "solo"), (3, "beta gamma"), (4, " ?! "), (5, "one two three four five")]
    texts = ["x alpha, BETA gamma delta y solo", "alpha beta gamma", "alpha beta x gamma delta", "soloist", "gamma beta", "say one two four five", "one two six four seven"]
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {(r.doc_id, r.item_id, r.distance, r.first_word, r.n_words) for r in decontam.benchmark_leaks(docs, spark.createDataFrame(bench, "item_id bigint, text string")).collect()}
    assert got == {(0, 1, 0, 1, 4), (0, 2, 0, 6, 1), (0, 3, 0, 2, 2), (1, 3, 0, 1, 2), (5, 5, 1, 1, 4)}


@pytest.mark.parametrize("length", [60, 150, 320])
def test_long_items_without_their_head_or_tail(length):
    rng = random.Random(length)
    say = lambda n: [f"v{rng.randint(0, 2000)}" for _ in range(n)]
    items = [say(length) for _ in range(30)]
    bench = decontam.prepare([(i, " ".join(w)) for i, w in enumerate(items)])
    assert all(c.recall >= 0.95 for c in bench.classes)
    cut = length // 5
    kinds = (lambda w: w[cut:], lambda w: w[:-cut], lambda w: say(cut) + w[cut:], lambda w: w[:-cut] + say(cut))
    for kind in kinds:
        texts = [" ".join(say(50) + kind(w) + say(30)) for w in items]
        found = {(n, i) for n, i, *_ in decontam.leaks_in(texts, bench)}
        assert len(found & {(i, i) for i in range(30)}) >= 29


@pytest.mark.parametrize("known", [False, True])
@pytest.mark.parametrize("lengths", [(5, 5), (6, 14), (15, 59), (45, 45), (90, 90), (120, 120), (170, 170)])
def test_recall_of_edited_copies(lengths, known):
    """Each copy has as many edits as are allowed, spread, by words of the benchmark or others; none of them was seen by the tables' making."""
    rng, gen = random.Random(lengths[1]), np.random.default_rng(lengths[0])
    say = lambda n: [f"v{rng.randint(0, 2000)}" for _ in range(n)]
    bench = decontam.prepare([(i, " ".join(say(rng.randint(*lengths)))) for i in range(30)])
    names = {v: k for k, v in bench.words.items()}
    texts = []
    for i in list(range(30)) * 10:
        item = bench.items[i].astype(np.int64)
        ids = decontam.edited_spread(item, decontam.edits_allowed(len(item), 0.2), gen, len(names) if known else 0)
        texts.append((i, " ".join([*say(20), *(names.get(x, f"z{rng.randrange(10**9)}") for x in ids.tolist()), *say(20)])))
    found = {(n, i) for n, i, *_ in decontam.leaks_in([t for _, t in texts], bench)}
    assert sum((n, i) in found for n, (i, _) in enumerate(texts)) >= 0.95 * len(texts)


def test_the_benchmark_comes_in_blocks(spark):
    rng = random.Random(6)
    items = [(i, sentence(rng, 20)) for i in range(12)]
    docs = spark.createDataFrame([(i, f"{sentence(rng, 9)} {t} {sentence(rng, 9)}", "", "", 0) for i, t in items] + [(90, sentence(rng, 30), "", "", 0), (91, None, "", "", 0), (None, items[0][1], "", "", 0)], SCHEMA)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    blocks = decontam.blocks_of(bench, 300)
    assert next(blocks) and len(list(blocks)) > 2
    assert {(r.doc_id, r.item_id) for r in decontam.benchmark_leaks(docs, bench, block_bytes=300).collect()} == {*((i, i) for i in range(12)), (None, 0)}
    assert {r.doc_id for r in decontam.drop_leaks(docs, bench, block_bytes=300).collect()} == {90, 91}


def test_searching_by_triples_loses_nothing(monkeypatch):
    monkeypatch.setattr(decontam, "MOST_REPEATS", 1)
    rng = random.Random(8)
    say = lambda n: [f"v{rng.randint(0, 60)}" for _ in range(n)]
    items = [say(rng.choice((5, 20, 24, 30))) for _ in range(40)]
    bench = decontam.prepare([(i, " ".join(w)) for i, w in enumerate(items)])
    assert any(c.triples is not None for c in bench.classes)
    texts, gen = [], np.random.default_rng(3)
    for _ in range(60):
        ids = decontam.edited_spread(bench.items[rng.randrange(40)].astype(np.int64), 5, gen)
        names = {v: k for k, v in bench.words.items()} | {0: "new"}
        texts.append(say(rng.randint(0, 30)) + [names[i] for i in ids.tolist()] + say(rng.randint(0, 30)))
    lossless = {i for c in bench.classes if c.triples is not None for i in c.items}
    want = {(n, i) for n, w in enumerate(texts) for i in lossless if edit_distance_to_run(items[i], w) <= len(items[i]) // 5}
    assert want <= {(n, i) for n, i, *_ in decontam.leaks_in([" ".join(w) for w in texts], bench)}
    assert want


def test_leaks_in_awkward_texts(spark):
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(1, "y " * 40000 + item + " y" * 40000, "", "", 0), (2, item + " " + item, "", "", 0), (None, item, "", "", 0), (3, item, "", "", 0), (3, item, "", "", 0)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], SCHEMA + ", item_id int")
    got = sorted(((r.doc_id, r.item_id, r.distance, r.first_word) for r in decontam.benchmark_leaks(docs, spark.createDataFrame([(7, item), (7, item)], "item_id bigint, text string")).collect()), key=key)
    each = [(None, 7, 0, 0), (1, 7, 0, 40000), (2, 7, 0, 0), (3, 7, 0, 0), (3, 7, 0, 0)]
    assert got == sorted(each * 2, key=key)
    assert decontam.drop_leaks(docs, spark.createDataFrame([(7, item)], "item_id bigint, text string")).count() == 0


def test_best_run_finds_the_place():
    item = np.array([1, 2, 3, 4, 5])
    assert decontam.best_run(item, np.array([0, 0, 1, 2, 9, 3, 4, 5, 0])) == (1, 2, 8)


# 6


def test_shards_are_a_permutation(docs, empty):
    rows = sharding.shard_rows(docs, 4).collect()
    assert len(rows) == docs.count()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shard_rows(docs.repartition(7), 4).collect()
    place = lambda rs: sorted(((r.doc_id, r.text, r.shard, r.slot) for r in rs), key=key)
    assert place(rows) == place(again)
    assert sharding.shard_rows(empty, 4).count() == 0


def test_shards_are_shuffled_and_written(spark, tmp_path):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.lit(7).alias("shard"), F.lit("x").alias("offset"))
    out = sharding.shard_rows(docs, 3)
    order = [r.doc_id for r in out.orderBy("shard", "slot").collect()]
    assert abs(np.corrcoef(order, range(2000))[0, 1]) < 0.1 and order != sorted(order)
    sharding.write_shards(out, str(tmp_path / "out"))
    read = spark.read.parquet(str(tmp_path / "out"))
    assert read.count() == 2000 and {r.shard for r in read.select("shard").distinct().collect()} == {0, 1, 2} and "offset" in read.columns
    # Each file holds a stretch of its shard, in slot order.
    for file in (tmp_path / "out").glob("shard=*/*.parquet"):
        slots = spark.read.parquet(str(file)).toPandas().slot.tolist()
        assert slots == sorted(slots)
    back = sharding.written_shards(out)
    assert sorted(map(tuple, back.select("doc_id", "shard", "slot").collect())) == sorted(map(tuple, out.select("doc_id", "shard", "slot").collect()))


def test_permutations_are_never_broadcast(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    plan = sharding.shard_rows(docs, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


# 7


def backoff_by_hand(rows: list[tuple], order: int, min_count: int = 2, alpha: float = 0.4) -> list[tuple]:
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())) for d, t, *_ in rows]
    counts: Counter = Counter(tuple(w[i : i + o]) for _, w in words for o in range(1, order + 1) for i in range(len(w) - o + 1))
    total = sum(len(w) for _, w in words)
    out = []
    for d, w in words:
        score = 0.0
        for i in range(len(w)):
            backoffs = 0
            for o in range(min(order, i + 1), 0, -1):
                gram = tuple(w[i - o + 1 : i + 1])
                if counts[gram] >= (min_count if o > 1 else 1):
                    score += math.log(counts[gram] / (counts[gram[:-1]] if o > 1 else total)) + backoffs * math.log(alpha)
                    break
                backoffs += 1
        out.append((d, len(w), round(score, 5)))
    return sorted(out, key=key)


@pytest.mark.parametrize("packed_up_to", [1 << 40, 0])
@pytest.mark.parametrize("order", [1, 3])
def test_backoff_scores_against_brute_force(docs, order, packed_up_to):
    rows = [tuple(r) for r in docs.collect()]
    got = ngram_lm.backoff_scores(docs, order=order, chunk_bytes=4000, part_keys=500, packed_up_to=packed_up_to).collect()
    assert sorted(((r.doc_id, r.n_words, round(r.log_score, 5)) for r in got), key=key) == backoff_by_hand(rows, order)
    assert all((r.mean_log is None) == (r.n_words == 0) for r in got)


def test_backoff_scores_of_nothing(empty):
    assert ngram_lm.backoff_scores(empty).count() == 0
    assert ngram_lm.backoff_scores(empty, packed_up_to=-1).count() == 0


def test_plain_backoff_scores_of_nulls_copies_and_a_long_text(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (None, "a b a b"), (None, "a b a b"), (4, "a"), (4, "A B c"), (5, "a b c d " * 50_000), (6, "é\xa0b a b")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id bigint, text string, gram bigint")
    got = ngram_lm.backoff_scores(docs, chunk_bytes=1000, packed_up_to=0).collect()
    # Sums of many logarithms differ in their last digits with the order of the terms.
    told = lambda found: sorted(((d, n, round(s, 3)) for d, n, s in found), key=key)
    assert told((r.doc_id, r.n_words, r.log_score) for r in got) == told(backoff_by_hand(rows, 3))


def test_packed_numbers():
    for values in ([], [0], [1, 255, 256, 1 << 50], [7] * 10):
        x = np.array(values, np.uint64)
        assert ngram_lm.unpack(ngram_lm.pack(x), len(x)).tolist() == values


# 8


def fingerprint_by_hand(text: str) -> list[int]:
    parts = [p for p in re.split(r"(?<=[\n.!?|])", text) if p]
    words = [len(parts)]
    for seed in fingerprint.SEEDS:
        begin = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)
        hashes = [xxhash.xxh64_intdigest(p.encode(), begin) for p in parts]
        words.append(sum(hashes) % (1 << 62))
        for k in range(fingerprint.PER_HASH):
            words.append(sum(sum((h >> k + at & 1) << at for at in (0, 21, 42)) for h in hashes) % (1 << 62))
    return words


def likeness_by_hand(a: str, b: str) -> float:
    def signs(text: str) -> list[int]:
        n, *words = fingerprint_by_hand(text)
        kept = [w for i, w in enumerate(words) if i % (1 + fingerprint.PER_HASH)]
        return [2 * (w >> at & (1 << 21) - 1) - n for w in kept for at in (0, 21, 42)]

    x, y = signs(a), signs(b)
    if x == y:
        return 1.0
    square = sum(v * v for v in x) * sum(v * v for v in y)
    return max(0.0, min(1.0, sum(map(math.prod, zip(x, y, strict=True))) / math.sqrt(square))) if square else 0.0


def spark_hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def test_fingerprints_against_brute_force(docs, empty):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    # Null ids last; rows of one id by the hash of their text.
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), -spark_hash(r[1])))
    want = []
    for (i, text), (_, following) in zip(rows, [*rows[1:], rows[0]], strict=True):
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third] if third else text
        of = lambda t: "".join(f"{w:016X}" for w in fingerprint_by_hand(t))
        near = [round(likeness_by_hand(text, other), 9) for other in (edited, following)]
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), of(text), of(edited), *near))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in fingerprint.document_fingerprints(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert fingerprint.document_fingerprints(empty).count() == 0


def test_the_row_after_the_last_is_the_first(spark):
    ids = [5, 900, 17, 33, 2, 10**12, -4]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id bigint, text string")
    got = {r.doc_id: r.next_text for r in fingerprint.with_next(docs, ["text"]).collect()}
    order = sorted(ids, reverse=True)
    assert got == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}


def test_the_next_row_in_spite_of_hot_ids(spark):
    rng = random.Random(2)
    # Clustered ids, one id and no id of hundreds of texts each, and many repeated rows.
    rows = [(rng.choice((1, 10**9, 10**15)) * 1000 + rng.randint(0, 400), f"t{i}") for i in range(900)] + [(5000, f"h{i}") for i in range(700)] + [(None, f"n{i}") for i in range(600)]
    rows += [(5000, "same")] * 1500 + [(None, "")] * 1300 + [(4999, "below"), (5001, "above")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -spark_hash(r[1])))
    want = Counter((i, t, u) for (i, t), (_, u) in zip(order, [*order[1:], order[0]], strict=True))
    got = Counter((r.doc_id, r.text, r.next_text) for r in fingerprint.with_next(docs, ["text"]).collect())
    assert got == want
    n = len(rows)
    cell, edges, hot = fingerprint.id_ranges(docs, n)
    assert {r.hot_id for r in hot.collect()} == {5000, None}
    out = fingerprint.document_fingerprints(docs)
    shas = Counter((r.doc_id, r.edited_sha256) for r in out.collect())
    edited = lambda t, u: t[: len(t) - len(t) // 3] + u[: len(t) // 3]
    wanted: Counter = Counter()
    for (i, t, u), m in want.items():
        wanted[i, hashlib.sha256(edited(t, u).encode()).hexdigest()] += m
    assert shas == wanted


def test_fingerprints_are_homomorphic(spark):
    text = F.lit("one.\ntwo! three\nfour|five")
    parts = fingerprint.parts(text)
    a, b = F.slice(parts, 1, 2), F.slice(parts, 3, 10)
    fp = fingerprint.fingerprint_of_parts
    row = spark.range(1).select(
        (fp(parts) == fingerprint.add(fp(a), fp(b))).alias("sum"), (fp(F.reverse(parts)) == fp(parts)).alias("order"), (fingerprint.subtract(fp(parts), fp(b)) == fp(a)).alias("less"),
        (F.array_join(parts, "") == text).alias("whole"), (fp(a) == fp(b)).alias("other"), F.size(fp(a)).alias("n"),
    ).first()
    assert row.sum and row.order and row.less and row.whole and not row.other and row.n == fingerprint.WORDS


# 9


def test_urls_and_rules(spark):
    urls = {
        None: ("", "", None), "no scheme": ("", "", None), "http://A.B.Net/x?y": ("a.b.net", "/x", "net/"), "ftp://net": ("net", "", None), "http://example.net/en/1": ("example.net", "/en/1", "example.net/en/"),
        "http://q.example.net/EN/1": ("q.example.net", "/EN/1", "net/"), "http://badexample.com/de/": ("badexample.com", "/de/", None), "https://X.example.com/de/a#f": ("x.example.com", "/de/a", "example.com/de/"),
        "a://b.org/fr/?q://z": ("b.org", "/fr/", "org/fr/"), "a://É.org?x": ("É.org", "", None), "a://b\nc.net/\n1": ("b\nc.net", "/\n1", "net/"),
    }
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = {r.page_id: r for r in url_reputation.judge_urls(pages, none, URL_RULES).collect()}
    for i, (host, path, rule) in enumerate(urls.values()):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), (i, got[i])
        assert got[i].verdict == {"net/": "block", "example.com/de/": "block"}.get(rule, "allow")
    assert url_reputation.judge_urls(pages.limit(0), none, URL_RULES).count() == 0


def test_registered_domains(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "b.co.uk": ("b.co.uk", "co.uk"), "x.y.com": ("y.com", "com"), "y.com": ("y.com", "com"), "com": ("com", "com"), "": ("", "")}
    rows = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", url_reputation.registered_domain(F.col("host")), url_reputation.suffix(F.col("host"))).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == hosts
    own = spark.range(1).select(url_reputation.registered_domain(F.lit("a.b.pages.dev"), ("pages.dev",))).first()[0]
    assert own == "b.pages.dev"


def test_reputation_shrinks_to_the_parents(spark):
    pages = [(i, f"http://h{i % 20}.{'bad' if i % 20 < 6 else 'good'}.com/") for i in range(800)] + [(900, "http://new.bad.com/"), (901, "http://new.good.com/"), (901, "http://new.good.com/"), (None, "http://new.bad.com/")]
    labels = [(i, 1, int(i % 20 < 6 and i % 3 > 0)) for i in range(800)] + [(None, 0, 1), (5, None, None)]
    got = url_reputation.judge_urls(spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), []).collect()
    assert len(got) == len(pages)
    verdict = {(r.host): r.verdict for r in got}
    assert all(v == ("block" if ".bad." in h else "allow") for h, v in verdict.items())


# 10


def classes_by_hand(rows: list[tuple], idf) -> list[tuple]:
    known = neardup.WordHashes()
    sets = [neardup.weighted_shingles(neardup.word_hashes(t, known), idf) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or len(sets[i][0]) and neardup.similarity(sets[i], sets[j]) >= 0.8:
                top[root(i)] = root(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[root(i)].append(d)
    return sorted(((d, min((x for x in g if x is not None), default=None)) for g in groups.values() for d in g), key=key)


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(11)
    rows = [(i, sentence(rng, rng.randint(30, 90))) for i in range(60)]
    n = 100
    for base in range(8):
        for _ in range(rng.randint(1, 5)):
            words = rows[base][1].split()
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = "edited" + str(rng.randint(0, 99))
            rows.append((n, " ".join(words)))
            n += 1
    hub = sentence(rng, 80).split()
    for _ in range(40):
        words = list(hub)
        words[rng.randrange(80)] = "odd" + str(n)
        rows.append((n, " ".join(words)))
        n += 1
    return [*rows, (n, " ".join(hub)), (500, None), (501, ""), (None, rows[0][1]), (None, "alone without id"), (502, "few words"), (503, "few words"), (504, "...")]


def test_near_duplicates_against_brute_force(spark, copies):
    docs = spark.createDataFrame(copies, "doc_id bigint, text string").repartition(3)
    want = classes_by_hand(copies, neardup.word_weights(docs))
    for small in (64, 6):
        got = sorted(((r.doc_id, r.class_id) for r in neardup.near_duplicate_classes(docs, limits=neardup.Limits(small=small, block=16)).collect()), key=key)
        assert got == want


def test_word_weights_are_exact(spark, copies):
    docs = spark.createDataFrame(copies, "doc_id bigint, text string").repartition(3)
    n = Counter(w for _, t in copies for w in set(re.findall(r"\w+", (t or "").lower())))
    known, weights = neardup.WordHashes(), neardup.word_weights(docs)
    got = weights.of(np.array([known[w] for w in n], np.uint64))
    assert got == pytest.approx([1 + math.log(len(copies) / x) / math.log(1000) for x in n.values()], abs=1e-5)
    assert weights.of(np.array([known["never seen"]], np.uint64)).tolist() == [2.0]
    few = neardup.WordWeights(np.zeros(0, np.uint64), np.zeros(0, np.float32))
    assert few.of(np.array([7], np.uint64)).tolist() == [2.0]


def test_classes_are_the_same_for_all_limits(spark, copies):
    docs = spark.createDataFrame(copies, "doc_id bigint, text string").repartition(3)
    want = sorted(((r.doc_id, r.class_id) for r in neardup.near_duplicate_classes(docs).collect()), key=key)
    for limits in (neardup.Limits(small=4, block=6, leaders=1), neardup.Limits(block_bytes=600), neardup.Limits(small=10, block=8, broadcast_nodes=0)):
        assert sorted(((r.doc_id, r.class_id) for r in neardup.near_duplicate_classes(docs, limits=limits).collect()), key=key) == want

    kept = [r.doc_id for r in neardup.keep_one_of_each(docs).collect()]
    assert sorted(x for x in kept if x is not None) == sorted({c for d, c in want if d is not None})


def test_large_buckets_lose_no_link(spark):
    rng = random.Random(4)
    # Copies that drift from texts that aren't there: most links lead through others than leaders.
    rows = []
    for _ in range(2):
        hub = sentence(rng, 400).split()
        for _ in range(130):
            words = list(hub)
            for at in rng.sample(range(400), rng.randint(3, 9)):
                words[at] = f"odd{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    idf = neardup.word_weights(docs)
    sets = [neardup.weighted_shingles(neardup.word_hashes(t, neardup.WordHashes()), idf) for _, t in rows]
    keys = neardup.band_keys(sets)
    assert max(Counter(map(tuple, zip(np.tile(range(neardup.BANDS), len(rows)), keys.ravel(), strict=True))).values()) > 64
    top = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (keys[i] == keys[j]).any() and neardup.similarity(sets[i], sets[j]) >= 0.8:
                top = [top[j] if x == top[i] else x for x in top]
    want = {i: min(j for j in range(len(rows)) if top[j] == top[i]) for i in range(len(rows))}
    for sizes in ({}, {"small": 10, "block": 16, "leaders": 2}, {"small": 1000}, {"block_bytes": 20_000}):
        assert {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(docs, limits=neardup.Limits(**sizes)).collect()} == want


def test_one_row_of_each_class_stays(spark):
    rng = random.Random(9)
    a, b, c, d, e = (sentence(rng, 40) for _ in range(5))
    # Repeated rows, null ids of one text, copies of a text with an id, and an id with two texts, one of them a copy.
    rows = [(1, a, "x"), (1, a, "w"), (2, b, "x"), (2, a, "x"), (None, c, "x"), (None, c, "x"), (None, c, "y"), (None, b + " more", "x"), (3, d, "x"), (None, e, "x"), (4, None, "x"), (5, "", "x"), (4, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    docs = docs.withColumns({c: F.lit(7) for c in ("its_id", "Its_Node", "stays", "row", "class")})
    out = neardup.keep_one_of_each(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text or "", r.lang) for r in out.collect()), key=key)
    assert got == sorted([(1, a, "w"), (2, b, "x"), (None, c, "x"), (3, d, "x"), (None, e, "x"), (4, "", "x")], key=key)


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicate_classes(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_samples_agree_as_the_sets_do():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    w = rng.uniform(1, 2, 400).astype(np.float32)
    a, b = (keys[:300], w[:300]), (keys[50:], w[50:])
    both = (np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]))
    agree = np.mean([len(set(neardup.samples(*both, np.array([0, 300]), k).tolist())) == 1 for k in range(600)])
    assert abs(agree - neardup.similarity(a, b)) < 0.07


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (300, 200), (5, 5)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 200: 100, 300: 100}
