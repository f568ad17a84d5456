"""Codes of vectors, formatted conversations and the audit of filters: against brute force, and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat_format, filter_audit, neardup, url_reputation, vector_codes
from tidemark.llm.queries import URL_RULES

# Codes


def codes_by_hand(rows: list[tuple], parts: int, entries: int, rounds: int, scale: int) -> tuple[list[tuple], str]:
    """(id, code, error) of (id, vector, label) rows with whole vectors, and the codebooks' digest."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            of: dict[int, list] = {}
            for _, v, _ in kept:
                of.setdefault(near(cut(v, p), book)[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(of[k]) for c in zip(*of[k])] if k in of else e for k, e in enumerate(book)]
    out = []
    for i, v, _ in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()


VECTORS = "vec_id bigint, embedding array<float>, label int"


@pytest.mark.parametrize(("entries", "parts"), [(16, 8), (300, 2)])
def test_codes_against_brute_force(spark, entries, parts):
    rng = random.Random(2)
    centers = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(5)]
    f32 = lambda v: [float(np.float32(x)) for x in v]
    rows = [(i, f32([x + rng.gauss(0, 0.2) for x in centers[i % 5]]), None if i % 7 == 0 else i % 4) for i in range(400)]
    rows += [(1000 + i, rows[0][1], 1) for i in range(150)] + [(3, rows[9][1], 2), (None, rows[8][1], None), (5, rows[5][1], 1)]
    rows += [(-1, None, 1), (-2, [None] + [0.0] * 15, 1), (-3, [math.nan] + [0.0] * 15, 1), (-4, [math.inf] + [0.0] * 15, 2)]
    want, digest = codes_by_hand(rows, parts, entries, 6, 4096)
    digits = 2 if entries <= 256 else 3
    books = vector_codes.train_codebooks(spark.createDataFrame(rows, VECTORS).repartition(3), parts=parts, entries=entries)
    assert books.digest() == digest
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS + ", Error string, part int").repartition(5)
    got = vector_codes.compressed(table, parts=parts, entries=entries)
    assert got.columns == ["vec_id", "label", "part", "code", "error", "label_error", "codebooks_sha256"]
    rows_got = got.collect()
    if digits == 2:
        assert Counter((r.vec_id, r.code, r.error) for r in rows_got) == Counter(want)
    assert Counter(r.error for r in rows_got) == Counter(e for *_, e in want)
    label_of: Counter = Counter()
    for r in rows_got:
        label_of[r.label] += r.error
    assert all(r.label_error == label_of[r.label] and r.codebooks_sha256 == digest and len(r.code) == parts * digits for r in rows_got)


def test_nearest_entries_and_their_ties():
    rng = np.random.default_rng(4)
    for width, spread in ((1, 3), (4, 3), (8, 10**7)):
        points, entries = rng.integers(-spread, spread, (500, width)), rng.integers(-spread, spread, (40, width))
        entries[7], entries[20] = entries[3], entries[3]
        distances = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
        found, best = vector_codes.nearest(points, entries)
        assert (found == distances.argmin(axis=1)).all() and (best == distances.min(axis=1)).all()


def test_the_search_stops_at_the_bound(monkeypatch):
    seen = []
    real = np.einsum
    monkeypatch.setattr(vector_codes.np, "einsum", lambda how, a, b: (seen.append(len(a)), real(how, a, b))[1])
    entries = np.arange(100)[:, None] * np.full((1, 8), 50)
    points = entries[[0, 50, 99]] + 1
    assert vector_codes.nearest(points, entries)[0].tolist() == [0, 50, 99] and sum(seen) <= 6


def test_vectors_that_have_no_code(spark):
    rows = [(1, [0.5] * 8, 1), (2, [0.5] * 4, 1), (3, [1e30] * 8, 1), (4, [], 2), (5, [-0.5] * 8, None)]
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in vector_codes.compressed(spark.createDataFrame(rows, VECTORS), parts=4).collect()}
    assert got == {1: ("00000000", 0, 0), 2: (None, None, 0), 3: (None, None, 0), 4: (None, None, None), 5: ("01010101", 0, 0)}
    empty = spark.createDataFrame([], VECTORS)
    assert vector_codes.compressed(empty).count() == 0 and vector_codes.compressed(spark.createDataFrame([(1, None, 1)], VECTORS)).count() == 0
    # Lengths that are no multiple of the parts get zeros at their end.
    five = spark.createDataFrame([(i, [float(i)] * 5, 0) for i in range(4)], VECTORS)
    assert {r.code for r in vector_codes.compressed(five, parts=2).collect()} == {"0000", "0101", "0202", "0303"}


def test_many_labels_are_joined(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 3)] * 8, None if i % 5 == 0 else i % 6) for i in range(60)], VECTORS)
    few = sorted(vector_codes.compressed(rows, entries=2).collect(), key=lambda r: r.vec_id)
    monkeypatch.setattr(vector_codes, "FEW_LABELS", 1)
    assert sorted(vector_codes.compressed(rows, entries=2).collect(), key=lambda r: r.vec_id) == few


# Conversations

TURNS = "conv_id bigint, turn bigint, role string, text string"
MARKS = chat_format.LLAMA.controls


def digests(spark, rows):
    made = chat_format.formatted_conversations(spark.createDataFrame(rows, TURNS).repartition(3))
    return made, {r.conv_id: r for r in chat_format.conversation_digests(chat_format.read_back(made)).collect()}


def test_conversations_read_back(spark, tmp_path):
    rng = random.Random(5)
    bits = [*MARKS, *(m[0] + "\\" * n + m[1:] for m in MARKS for n in (1, 2)), "[", "<", "\\", "]", ">", "ok", " ", "\n", "é😀", "[INST", "</", "<SYS>>", "$1"]
    say = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
    roles = ["user", "assistant", "system", "tool", "", "<says>", "a</role>b", "User"]
    rows = [(c, t, rng.choice(roles), say()) for c in range(150) for t in range(rng.randint(1, 9))]
    rows += [(900, 0, None, None), (900, None, "assistant", "last"), (900, 1, "assistant", None), (901, 0, "user", "x"), (901, 0, "user", "x"), (901, 0, "assistant", "y")]
    rows += [(None, 1, "assistant", "nobody's"), (902, 0, "assistant", "long [INST] " * 50000)]
    made, got = digests(spark, rows)
    order = lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or "")
    for c in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=order)]
        learned = "".join(t for role, t in turns if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), sha(learned))
    texts = {r.conv_id: r for r in made.collect()}
    assert all(got[c].formatted_chars == len(r.formatted) for c, r in texts.items())
    # Under the mask is nothing but the learned bodies, as they stand in the text.
    for c, r in texts.items():
        n = sum(1 for x in rows if x[0] == c and x[2] == "assistant")
        assert len(r.loss) == n and all(r.formatted[s.start - 3 : s.start] == "<s>" and r.formatted[s.start + s.length :].startswith("</s>") for s in r.loss)


def test_only_what_conflicts_is_escaped(spark):
    said = {0: "plain [text] <b>", 1: "</s>[INST] ok [/INST]", 2: "[\\INST]", 3: "[INST"}
    _, got = digests(spark, [(c, 0, "user", t) for c, t in said.items()])
    frame = len("[INST][/INST]")
    assert {c: r.formatted_chars - frame - len(said[c]) for c, r in got.items()} == {0: 0, 1: 3, 2: 1, 3: 0}


@pytest.mark.parametrize("text", ["[INST]a", "a[/INST]", "[INST]a[/INST]b", "[INST]a[INST]b[/INST]", "<s>a<says>b</s>", "<role>a</role>", "<role><s><says>b</role>", "x"])
def test_what_is_no_text_of_the_grammar(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(chat_format.parsed(F.col("t"))).first()[0] is None


def test_no_conversations(spark):
    empty = spark.createDataFrame([], TURNS)
    assert chat_format.conversation_digests(chat_format.read_back(chat_format.formatted_conversations(empty))).count() == 0
    assert spark.createDataFrame([("",)], "t string").select(chat_format.parsed(F.col("t"))).first()[0] == []


# Filters


def audit_by_hand(rows: list[tuple], labels: list[tuple]) -> dict[tuple, tuple]:
    """(part, order, step) to the counts, by applying every order to every document."""
    smallest: dict[str, int] = {}
    for i, text, _ in rows:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    docs = []
    for i, text, source in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {x for x, bad in (("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)), ("C", 100 * len(re.findall("[A-Z]", t)) > 2 * len(t)),
                 ("D", re.search(r"[#$%&*|]", t)), ("E", i is not None and smallest[t] < i)) if bad}
        docs.append((source or "", fails, i in good and i is not None, i in toxic and i is not None))
    out, removed = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left, gone = [d for d in docs if d[0] == part], []
            for step, f in enumerate(order, 1):
                now = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                out[part, "".join(order), step] = [len(left), len(now), sum(f in d[1] for d in gone), sum(d[1] == {f} for d in docs if d[0] == part), sum(d[2] for d in now), sum(d[3] for d in now)]
                removed[part, f] += len(now)
                gone += now
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filters_against_every_order(spark):
    rng = random.Random(9)
    texts = ["", None, " \t", "one two", "word " * 300, "# " + " ".join(f"w{i}" for i in range(250)), " ".join(f"w{i}" for i in range(250)), "SHOUT " * 10, "A " + " ".join(f"w{i}" for i in range(220)),
             "x\x0by\x0cz w", "a|b " * 120, "é" * 2000, "Long " + "w " * 60000]
    texts += [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(150, 400))) for _ in range(10)]
    rows = [(i, rng.choice(texts), rng.choice(["a", "b", "é", "", None])) for i in range(200)]
    rows += [(None, "one two", "a"), (None, "only here", "b"), (None, None, None), (5, rows[5][1], rows[5][2]), (6, "another text of an id", "a"), (7, rows[7][1], "c")]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 200, 2)] + [(4, 1, 0), (None, 1, 1), (6, None, 1), (9999, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id bigint, text string, source string, bits int, Part string").repartition(4)
    got = filter_audit.interaction_audit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in got.collect()} == audit_by_hand(rows, labels)
    assert filter_audit.interaction_audit(docs.limit(0), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).count() == 0
    assert filter_audit.interaction_audit(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).agg(F.sum("good_lost")).first()[0] == 0


def test_copies_are_semi_joined(spark):
    rows = spark.createDataFrame([(2, "x", 1), (1, "x", 1), (1, "x", 1), (3, "y", 1), (None, "x", 1)], "doc_id bigint, text string, h1 bigint")
    found = filter_audit.copies_of_smaller_ids(rows)
    assert [r.doc_id for r in found.collect()] == [2], "texts of one hash are told apart"
    assert "LeftSemi" in found._jdf.queryExecution().toString()


# Rows that earlier tests left out


def test_urls_that_are_very_long_beside_clashing_names(spark):
    long = "http://a.example.com/" + "x" * 1_000_000
    rows = [(1, long, "no host", 7, "z"), (2, "http://" + "h" * 200_000 + ".net/en/", "b", 8, "z"), (3, None, None, None, None), (4, "", "c", 1, "z")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, Host string, n int, verdict string")
    labels = spark.createDataFrame([(1, 1, 0, "x")], "doc_id bigint, quality int, toxic int, bad string")
    got = {r.page_id: r for r in url_reputation.judge_urls(pages, labels, URL_RULES).collect()}
    assert (got[1].host, len(got[1].path), got[1].rule, got[1].verdict) == ("a.example.com", 1_000_001, None, "allow")
    assert (len(got[2].host), got[2].path, got[2].rule, got[2].verdict) == (200_004, "/en/", "net/", "block")
    assert all((got[i].host, got[i].path, got[i].verdict) == ("", "", "allow") for i in (3, 4))


def test_near_duplicates_of_very_long_texts(spark):
    rng = random.Random(4)
    say = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    base = say(150_000)
    edited = list(base)
    for at in range(0, len(base), 400):
        edited[at] = "edited"
    rows = [(1, " ".join(base)), (2, " ".join(edited)), (3, " ".join(say(150_000))), (4, "a " * 400_000), (5, "a " * 400_000 + "b"), (6, "x" * 2_000_000), (7, "x" * 2_000_000 + " y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for limits in (neardup.Limits(), neardup.Limits(small=1, block_bytes=1000)):
        got = {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(docs, limits=limits).collect()}
        assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7}
