"""The registered queries of the numbered operators over the smallest tables: columns, types, laws and SQL twins."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.test_entry import told
from tidemark.llm import mixing, queries, tokens

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")

TYPES = {
    "op1_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op2_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op4_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op5_benchmark_leaks": "doc_id bigint, item_id bigint, distance int",
    "op6_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op7_backoff_scores": "doc_id bigint, n_words bigint, log_score double, mean_log double",
    "op8_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op9_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op10_near_duplicates": "doc_id bigint, class_id bigint",
    "op11_vector_codes": "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string",
    "op12_chat_format": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op13_filter_audit": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("select doc_id, coalesce(text, '') from documents").fetchall())


@pytest.fixture(scope="module")
def rows(spark):
    found: dict[str, list] = {}

    def of(name: str) -> list:
        if name not in found:
            found[name] = entry.queries()[name](spark, SF).collect()
        return found[name]

    return of


def size(text: str) -> int:
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def test_all_are_registered():
    assert list(queries.QUERIES) == list(TYPES) and {*TYPES, "pipeline"} <= set(entry.queries()) and set(queries.ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(TYPES))
def test_columns_and_types(spark, name):
    kinds = dict(entry.queries()[name](spark, SF).dtypes)
    wanted = dict(c.split() for c in TYPES[name].split(", "))
    assert {c: kinds.get(c) for c in wanted} == wanted


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and told(got) == told(want)


def test_op1(rows, texts):
    t = tokens.load_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: (len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 512) for i, x in texts.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows("op1_token_counts")} == want


def test_op2(rows, texts):
    got = rows("op2_toxicity")
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_op3(rows, texts, con):
    source = dict(con.execute("select doc_id, source from documents").fetchall())
    sizes, taken = Counter(), Counter()
    for i, t in texts.items():
        sizes[source[i]] += size(t)
    goal = mixing.targets(dict(sizes))
    for r in rows("op3_mixing"):
        assert r["size"] == size(texts[r.doc_id]) and r.taken <= 2 * r["size"] and r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(goal[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 0.5 for s in goal)


def test_op5_finds_whole_items(rows, texts, con):
    words = lambda t: f" {' '.join(re.findall(r'\w+', t.lower()))} "
    said = {i: words(t) for i, t in texts.items()}
    whole = {(d, i) for i, t in con.execute("select item_id, text from benchmark").fetchall() for d, w in said.items() if words(t) in w}
    found = {(r.doc_id, r.item_id): r.distance for r in rows("op5_benchmark_leaks")}
    assert {k for k, d in found.items() if d == 0} == whole and all(d <= r.item_words * 0.2 for r in rows("op5_benchmark_leaks") for d in (r.distance,))


def test_op6(rows, texts):
    slots = defaultdict(list)
    for r in rows("op6_sharding"):
        data = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and sum(map(len, slots.values())) == len(texts)


def test_op8(rows, texts):
    ids = sorted(texts, reverse=True)
    following = dict(zip(ids, [*ids[1:], ids[0]], strict=True))
    by_text = defaultdict(set)
    for r in rows("op8_fingerprints"):
        t, u = texts[r.doc_id], texts[following[r.doc_id]]
        k = len(t) // 3
        edited = t[: len(t) - k] + u[:k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text[t].add(r.fingerprint)
        by_text[edited].add(r.edited_fingerprint)
    assert all(len(f) == 1 for f in by_text.values()) and len({next(iter(f)) for f in by_text.values()}) == len(by_text)


def test_op10(rows, texts):
    of = {r.doc_id: r.class_id for r in rows("op10_near_duplicates")}
    assert set(of) == set(texts)
    members = defaultdict(list)
    for d, c in of.items():
        members[c].append(d)
    assert all(min(m) == c for c, m in members.items())
    by_text = defaultdict(set)
    for d, t in texts.items():
        by_text[t].add(of[d])
    assert all(len(c) == 1 for c in by_text.values())


def test_op12(rows):
    at = next(r for r in rows("op12_chat_format") if r.conv_id == -7)
    said = "</s>[INST] ok [/INST]"
    whole = f"user\n{said}\nassistant\n{said}\n"
    assert (at.n_turns, at.turns_sha256, at.loss_chars, at.loss_sha256) == (2, hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())


def test_the_pipeline(rows, texts):
    got = rows("pipeline")
    # Each text comes as often as the mix takes it: once, twice or not at all.
    assert all(texts[r.doc_id] == r.text for r in got) and max(Counter(r.doc_id for r in got).values()) <= 2
    classes = {r.doc_id: r.class_id for r in rows("op10_near_duplicates")}
    toxic = {r.doc_id for r in rows("op2_toxicity") if r.predicted}
    leaking = {r.doc_id for r in rows("op5_benchmark_leaks")}
    kept = {r.doc_id for r in got}
    assert not kept & toxic and not kept & leaking and len({classes[d] for d in kept}) == len(kept)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-duplicates", "benchmark-leaks", "mixing", "sharding"]
