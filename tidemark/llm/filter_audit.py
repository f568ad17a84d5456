"""How filters on documents act together: what each removes in every order of them.

Each document's failures are bits of a number.  Filters that look at the document alone are
expressions.  The one that asks for an identical text at a smaller id is an existential
self-join: documents semi-joined, on hash and exact text, with the smallest id of
each text.  (That each text has one row on the other side, and its rows are merged in
the tasks before they are shuffled, is what makes a text with very many copies cost no more than others.)
The ids that it marks and the failures by expression are one union, summed for each document; then only
combinations of bits are counted, 2^filters at most for each part of the corpus, and all
orders are worked out from these numbers.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty

#: The white space that parts words.
SPACES = r"[\x20\x09-\x0D]+"


def own_failures(text: Column, words: Column) -> dict[str, Column]:
    """The filters that look at the text and its words alone, by letter: true where it fails."""
    n = F.size(words)
    return {
        "A": n < 200, "B": F.size(F.array_distinct(words)) * 100 < n * 50, "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 2,
        "D": F.regexp_like(text, F.lit("[#$%&*|]")),
    }


def copies_of_smaller_ids(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text some smaller doc_id has too: a left-semi join on hash (h1), exact text and smaller id.

    Null ids aren't smaller than any, and none is smaller than they.
    """
    rows = docs.where("doc_id is not null")
    firsts = rows.groupBy(F.col("h1").alias("first_h1"), F.col("text").alias("first_text")).agg(F.min("doc_id").alias("first_id"))
    same = (F.col("h1") == F.col("first_h1")) & (F.col("text") == F.col("first_text")) & (F.col("first_id") < F.col("doc_id"))
    return rows.join(firsts, same, "left_semi")


def failure_bits(docs: DataFrame) -> DataFrame:
    """(doc_id, part, h1, h2, bits, n): how many rows of an id, source and text there are, and what they fail (A is bit 0, E bit 4).

    From here on h1 and h2, hashes of 64 bits each, stand together for the text; E compares the texts themselves.
    """
    text = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text_or_empty("text").alias("text")).select("*", F.xxhash64("text").alias("h1"))
    own = ("doc_id", "part", "h1", F.xxhash64(F.lit(1), F.col("text")).alias("h2"))
    split = text.select("*", F.array_remove(F.split("text", SPACES), "").alias("words"))
    alone = sum((f.cast("int") * (1 << i) for i, f in enumerate(own_failures(F.col("text"), F.col("words")).values())), F.lit(0))
    failed = split.select(*own, alone.alias("bits"), F.lit(1).cast("long").alias("n"))
    marked = copies_of_smaller_ids(text).select(*own, F.lit(1 << 4).alias("bits"), F.lit(0).cast("long").alias("n"))
    return failed.unionByName(marked).groupBy("doc_id", "part", "h1", "h2").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))


def combinations(failures: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits, n, good, toxic): rows of each combination of failures, and how many are labelled good and toxic.

    Labels of null ids are none; of several labels of an id, one that says so is enough.
    """
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # Null ids, which may be very many, have no label and need not meet in a join.
    known = failures.where("doc_id is not null").join(said, "doc_id", "left").select("part", "bits", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    rest = failures.where("doc_id is null").select("part", "bits", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return known.unionByName(rest).groupBy("part", "bits").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def orders_report(counted: DataFrame, letters: Sequence[str] = ("A", "B", "C", "D", "E")) -> DataFrame:
    """One row for each part, order of the filters and step; see `interaction_audit`."""
    orders = math.factorial(len(letters))
    bit = {x: 1 << i for i, x in enumerate(letters)}
    # As many as the filters give: 600 for five.
    steps = [{"filter_order": "".join(o), "step": k + 1, "bit": bit[x], "earlier": sum(bit[y] for y in o[:k])} for o in permutations(letters) for k, x in enumerate(o)]
    listed = F.inline(F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, bit: int, earlier: int>>"))
    by_part = counted.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("c"))  # at most 2^filters of each part

    def total(of: str | None, where) -> Column:
        return F.aggregate(F.filter("c", where), F.lit(0).cast("long"), lambda s, x: s + x[of])

    b, earlier = F.col("bit"), F.col("earlier")
    fails = lambda x: x["bits"].bitwiseAND(b) != 0
    before = lambda x: x["bits"].bitwiseAND(earlier) != 0
    # A failing document is removed by the filter in as many orders as have it before the document's other failures.
    share = F.aggregate(F.filter("c", fails), F.lit(0).cast("long"), lambda s, x: s + x["n"] * (F.lit(orders) / F.bit_count(x["bits"])).cast("long"))
    return by_part.select("*", listed).select(
        "part", "filter_order", "step",
        total("n", lambda x: ~fails(x) & ~before(x)).alias("kept"), total("n", lambda x: fails(x) & ~before(x)).alias("removed"), total("n", lambda x: fails(x) & before(x)).alias("redundant"),
        total("n", lambda x: x["bits"] == b).alias("unique_fails"), total("good", lambda x: fails(x) & ~before(x)).alias("good_lost"), total("toxic", lambda x: fails(x) & ~before(x)).alias("toxic_lost"),
        share.alias("shapley"),
    )


def interaction_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part (source; null: empty), order of the five filters and step, what its filter removes there.

    kept: rows left after the step; removed: by it; redundant: failing its filter, removed before;
    unique_fails: failing this filter alone; good_lost and toxic_lost: labelled ones among the removed; shapley: what
    the filter removes, summed over all orders.  Null texts are empty.  Repeated rows count each.  Null
    ids mark no copies and are none.  Other columns aren't read.  Empty tables give empty results.
    """
    return orders_report(combinations(failure_bits(docs), labels))
