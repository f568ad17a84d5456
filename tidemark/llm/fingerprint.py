"""Fingerprints of documents by a homomorphic multiset hash, in DataFrame operations alone.

A text is cut after each line break and each mark that ends a sentence or cell, so
that a paragraph without line breaks still has several parts.  A part's vector comes
from two hashes of it: each hash enters whole into a sum modulo 2^62, and each of
its low 63 bits into a counter modulo 2^21 or 2^20, three counters being packed into
a word.  The fingerprint is the sum of the vectors of all parts, each word modulo 2^62.
It doesn't depend on the order of the parts; parts can be added or taken away without
the rest of the text.  In a text of over 2^20 parts a counter carries into the next one:
equality and the sums stay exact, the likeness becomes rougher.

Counted bits are random signs, so that the product of two fingerprints' centred
counters estimates how many parts the texts share; `likeness` is its cosine.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import merged_copies, repeated, root_buckets, text_or_empty, written

#: Parts end after any of these.
PART_ENDS = r"(?<=[\n.!?|])"
SEEDS = (101, 202)
PER_HASH = 21
SPREAD = (1 << 42) | (1 << 21) | 1
MASK = (1 << 62) - 1
#: Words of a fingerprint: the number of parts, then for each hash its sum and its packed counters.
WORDS = 1 + len(SEEDS) * (1 + PER_HASH)


def parts(text: Column) -> Column:
    """The parts of a text; joined they give the text."""
    return F.filter(F.split(text, PART_ENDS), lambda p: p != "")


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text as an array of WORDS longs; that of the empty text is all 0."""
    return fingerprint_of_parts(parts(text))


def fingerprint_of_parts(found: Column) -> Column:
    """The fingerprint of an array of parts, in any order."""
    # Bound once: an expression used inside a lambda is computed for each element.
    return bound(found, _of_bound_parts)


def _of_bound_parts(found: Column) -> Column:
    each_seed = [bound(_hashes(found, seed), _sums) for seed in SEEDS]
    return F.concat(F.array(F.size(found).cast("long")), *each_seed)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often `use` needs it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hashes(found: Column, seed: int) -> Column:
    return F.transform(found, lambda p: F.xxhash64(F.lit(seed), p))


def _sums(hashes: Column) -> Column:
    """The sum of the hashes modulo 2^62, and for k from 0 to 20 that of their bits k, k + 21 and k + 42."""
    masked = lambda x: x.bitwiseAND(F.lit(MASK))

    def total(of: Callable[[Column], Column]) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda s, h: masked(s + of(h)))

    counted = (total(lambda h, k=k: F.shiftright(h, k).bitwiseAND(F.lit(SPREAD))) for k in range(PER_HASH))
    return F.array(total(masked), *counted)


def add(a: Column, b: Column) -> Column:
    """The fingerprint of both texts' parts together."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(MASK)))


def subtract(a: Column, b: Column) -> Column:
    """The fingerprint of a's parts without b's, which must be among them."""
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(F.lit(MASK)))


def as_text(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.lpad(F.hex(w), 16, "0")), "")


def centred(words: Column) -> Column:
    """The 126 counters as sums of signs: twice the count of ones, less the number of parts."""
    n = F.element_at(words, 1)
    low = (1 << 21) - 1
    packed = F.concat(*(F.slice(words, 3 + i * (1 + PER_HASH), PER_HASH) for i in range(len(SEEDS))))
    return F.flatten(F.transform(packed, lambda w: F.array(*(
        (2 * F.shiftright(w, by).bitwiseAND(F.lit(low)) - n).cast("double") for by in (0, 21, 42)
    ))))


def likeness(a: Column, b: Column) -> Column:
    """How alike the parts of two texts are, 0 to 1, from their fingerprints' `centred` counters.

    Equal ones give 1, an empty text and another 0.
    """
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    square = dot(a, a) * dot(b, b)
    return F.when(a == b, F.lit(1.0)).when(square <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / F.sqrt(square))))


def id_ranges(docs: DataFrame, n: int) -> tuple[Column, DataFrame, DataFrame]:
    """How n rows are cut into about sqrt(n) ranges of doc_id with about as many rows each.

    A column that numbers coarse cells of ids (quantiles of all ids; 0 below the first), a
    table (cell, edges) of the quantiles in each cell, and a table (hot_id, pieces) of ids that have
    far more rows than a range should.  The edges set those ids apart from their neighbours.
    All of these are small: about sqrt(n) numbers together.
    """
    k = math.isqrt(root_buckets(n) - 1) + 1
    shares = [i / k for i in range(k + 1)]
    ids = docs.select(F.col("doc_id").cast("long").alias("id")).where("id is not null")
    outer = ids.agg(F.percentile_approx("id", shares, 10_000).alias("q")).first().q if n else None
    coarse = F.array(*(F.lit(x).cast("long") for x in sorted(set(outer or [0]))))
    cell_of = lambda c: F.size(F.filter(coarse, lambda e: e <= c))

    fair = max(1, n // (k * k))
    counts = docs.groupBy(F.col("doc_id").cast("long").alias("hot_id")).agg(F.count(F.lit(1)).alias("n"))
    hot = written(counts.where(F.col("n") > 8 * fair).select("hot_id", F.ceil(F.col("n") / fair).alias("pieces")), "hot-ids")
    inner = ids.groupBy(cell_of(F.col("id")).alias("cell")).agg(F.percentile_approx("id", shares, 10_000).alias("q"))
    alone = hot.where("hot_id is not null").groupBy(cell_of(F.col("hot_id")).alias("cell")).agg(F.flatten(F.collect_list(F.array("hot_id", F.col("hot_id") + 1))).alias("h"))
    edges = F.array_sort(F.array_distinct(F.concat("q", F.coalesce("h", F.array().cast("array<bigint>"))))).alias("edges")
    return cell_of(F.col("doc_id").cast("long")), written(inner.join(alone, "cell", "left").select("cell", edges), "id-edges"), hot


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """docs with next_<c> for each carried column c: its value in the next row by descending doc_id.

    The row after the last is the first.  Null ids come last; rows of one id are
    ordered by a hash of their text.  A window over all rows would be one task.  Rows are
    therefore cut into ranges of ids, sized by their counts, and rows of a hot id (or of
    none) further by the hash.  The first row of each range is also sent, as its end, to the
    range before; so each range is ordered by itself and texts are shuffled once.
    """
    n = docs.count()
    cell, edges, hot = id_ranges(docs, n)
    i = F.col("doc_id").cast("long")
    mark = F.xxhash64("text")
    marked = docs.select("*", i.alias("_tidemark_id"), mark.alias("_tidemark_mark"), F.when(i.isNotNull(), cell).otherwise(-1).alias("_tidemark_cell"))
    edges = F.broadcast(edges.select(F.col("cell").alias("_tidemark_cell"), F.col("edges").alias("_tidemark_edges")))
    hot = F.broadcast(hot)
    ranged = marked.join(edges, "_tidemark_cell", "left").join(hot, F.col("_tidemark_id").eqNullSafe(F.col("hot_id")), "left")
    # Spans in order: large ids first, null ids last; of a hot id large hashes first.
    within = F.coalesce(F.size(F.filter("_tidemark_edges", lambda e: e <= F.col("_tidemark_id"))), F.lit(0))
    piece = F.coalesce(F.col("pieces") - 1 - F.floor((F.col("_tidemark_mark") / F.lit(2.0**64) + 0.5) * F.col("pieces")), F.lit(0)).cast("int")
    span = F.struct((-F.col("_tidemark_cell")).alias("cell"), (-within).alias("range"), piece.alias("piece"))
    at = ranged.select(*docs.columns, "_tidemark_mark", F.coalesce("_tidemark_id", F.lit(-(1 << 63))).alias("_tidemark_id"), span.alias("_tidemark_span"))

    first = at.groupBy("_tidemark_span").agg(F.max(F.struct(F.col("_tidemark_id").alias("id"), F.col("_tidemark_mark").alias("mark"))).alias("f"))
    # One row for each span: about sqrt(n) of them.
    everything, last = Window.orderBy("_tidemark_span"), Window.partitionBy(F.lit(0))
    before = F.coalesce(F.lag("_tidemark_span").over(everything), F.max("_tidemark_span").over(last))
    ends = first.select(F.col("f.id").alias("first_id"), F.col("f.mark").alias("first_mark"), F.col("_tidemark_span").alias("first_span"), before.alias("end_of"))
    if n <= 1 << 40:  # at most a few million rows of 40 bytes
        ends = F.broadcast(ends)
    same = (F.col("_tidemark_span") == F.col("first_span")) & (F.col("_tidemark_mark") == F.col("first_mark")) & (F.col("_tidemark_id") == F.col("first_id"))
    own = F.struct(F.col("_tidemark_span").alias("span"), F.lit(False).alias("end"))
    sent = F.when(F.col("end_of").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("end_of").alias("span"), F.lit(True).alias("end"))))
    spread = at.join(ends, same, "left").select(*docs.columns, "_tidemark_mark", F.explode(sent).alias("_tidemark_sent"))
    dealt = spread.select("*", F.col("_tidemark_sent.span").alias("_tidemark_at"), F.col("_tidemark_sent.end").alias("_tidemark_is_end"))
    order = Window.partitionBy("_tidemark_at").orderBy("_tidemark_is_end", F.desc_nulls_last("doc_id"), F.desc("_tidemark_mark"))
    led = dealt.select(*docs.columns, "_tidemark_is_end", *(F.lead(c).over(order).alias(f"next_{c}") for c in carried))
    return led.where(~F.col("_tidemark_is_end")).drop("_tidemark_is_end")


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts, of their edited forms, and how alike they are.

    The edited text has its last third replaced by the beginning of the next
    document's.  Null texts count as empty.  Rows of equal text have equal
    fingerprints; an empty text's is that of no parts.  Ids are whole numbers or null.
    Repeated rows are returned each; other columns of docs are left out.  Empty tables give
    empty results.
    """
    text = text_or_empty("text")
    rows, merged = merged_copies(docs.select("doc_id", text.alias("text")))
    base = rows.select("doc_id", "text", "times", F.char_length("text").alias("n_chars"), fingerprint(F.col("text")).alias("fp"))
    near = with_next(base, ["text", "fp"])
    if merged:
        # The row after a copy is another one, but after the last.
        turns = F.when(F.col("times") > 1, F.array(F.struct(F.lit(False).alias("copy"), F.lit(1).cast("long").alias("n")), F.struct(F.lit(True).alias("copy"), (F.col("times") - 1).alias("n"))))
        turns = turns.otherwise(F.array(F.struct(F.lit(False).alias("copy"), F.lit(1).cast("long").alias("n"))))
        near = near.withColumn("turn", F.explode(turns)).withColumns({
            "times": F.col("turn.n"), "next_text": F.when(F.col("turn.copy"), F.col("text")).otherwise(F.col("next_text")), "next_fp": F.when(F.col("turn.copy"), F.col("fp")).otherwise(F.col("next_fp")),
        })
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - third), F.substring(F.col("next_text"), F.lit(1), third))
    changed = near.select("doc_id", "times", "n_chars", "fp", "next_fp", F.when(third > 0, edited).otherwise(F.col("text")).alias("edited"))
    sha = F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    hashed = changed.select("doc_id", "times", "n_chars", sha, "fp", "next_fp", fingerprint(F.col("edited")).alias("edited_fp"))
    counted = hashed.select("*", centred(F.col("fp")).alias("c"), centred(F.col("edited_fp")).alias("e"), centred(F.col("next_fp")).alias("x"))
    out = counted.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("c"), F.col("e")).alias("near_edited"), likeness(F.col("c"), F.col("x")).alias("near_next"), "times",
    )
    return repeated(out) if merged else out.drop("times")
