"""Conversations as training texts, checked by a grammar round trip, in DataFrame functions alone.

A template gives each role an opening and a closing mark.  The grammar is deterministic:

    text = turn*        turn = opening body closing        (a role without marks of its own: <role> name <says> body </role>)

and no body or name holds a mark.  The parser reads turns from left to right, each up to the first closing mark
of its opening, turns the escapes in bodies back, and knows no turn where a body holds a
bare mark or anything stands between turns.

Texts are rendered as they are first.  What the parser doesn't give back as it was (a text with
a mark, or with what reads as an escaped one) is escaped and parsed again: a backslash goes behind
the first character of each mark, and one more into each mark that has some already.  That is
reversible for every text, so the second parse is identical; were it ever not, the
job fails rather than write a text that reads otherwise.  The whole conversation is
parsed once more when its turns are put together.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "struct<role:string,text:string>"


@dataclass(frozen=True)
class Template:
    """Marks begin with < or [, hold neither of these two again but right at the second place, and end with > or ]."""

    marks: tuple[tuple[str, str, str], ...] = (("system", "<<SYS>>", "<</SYS>>"), ("user", "[INST]", "[/INST]"), ("assistant", "<s>", "</s>"))
    other: tuple[str, str, str] = ("<role>", "<says>", "</role>")
    #: The roles whose texts are learned.
    learned: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> list[str]:
        return [m for _, *both in self.marks for m in both] + list(self.other)

    @property
    def mark_pattern(self) -> str:
        """A mark's first character, the backslashes behind it, and its rest, as three groups."""
        rests = "|".join(re.escape(m[1:]) for m in self.controls)
        return rf"([<\[])(\\*)({rests})"

    @property
    def escaped_pattern(self) -> str:
        rests = "|".join(re.escape(m[1:]) for m in self.controls)
        return rf"([<\[])\\(\\*)({rests})"

    @property
    def bare_pattern(self) -> str:
        return "|".join(re.escape(m) for m in self.controls)

    @property
    def turn_pattern(self) -> str:
        """One turn: whatever its opening is, up to the first closing of that opening."""
        begin, says, end = map(re.escape, self.other)
        return "(?s)" + "|".join([*(f"{re.escape(a)}.*?{re.escape(b)}" for _, a, b in self.marks), f"{begin}.*?{says}.*?{end}"])


LLAMA = Template()


def escaped(text: Column, template: Template = LLAMA) -> Column:
    return F.regexp_replace(text, F.lit(template.mark_pattern), F.lit(r"$1\\$2$3"))


def unescaped(text: Column, template: Template = LLAMA) -> Column:
    return F.regexp_replace(text, F.lit(template.escaped_pattern), F.lit("$1$2$3"))


def frame(role: Column, template: Template = LLAMA) -> tuple[Column, Column]:
    """What stands before and behind the body of a turn."""
    name = F.concat(F.lit(template.other[0]), escaped(role, template), F.lit(template.other[1]))
    before, behind = name, F.lit(template.other[2])
    for known, a, b in template.marks:
        before, behind = F.when(role == known, F.lit(a)).otherwise(before), F.when(role == known, F.lit(b)).otherwise(behind)
    return before, behind


def pieces(formatted: Column, template: Template = LLAMA) -> Column:
    """The stretches of a text that read as turns, in order."""
    return F.regexp_extract_all(formatted, F.lit(template.turn_pattern), F.lit(0))


def read_turn(piece: Column, template: Template = LLAMA) -> Column:
    """The turn (role, text) that a stretch holds; null if its name or body holds a bare mark."""
    bare = F.lit(template.bare_pattern)

    def within(a: str, b: str) -> Column:
        return F.substring(piece, F.lit(len(a) + 1), F.length(piece) - len(a) - len(b))

    def turn(role: Column, body: Column) -> Column:
        return F.when(~F.regexp_like(body, bare), F.struct(role.alias("role"), unescaped(body, template).alias("text")))

    begin, says, end = template.other
    inner = within(begin, end)
    name = F.substring_index(inner, says, 1)
    body = F.substring(inner, F.length(name) + len(says) + 1, F.length(inner))
    read = F.when(~F.regexp_like(name, bare), turn(unescaped(name, template), body))
    for role, a, b in template.marks:
        read = F.when(F.startswith(piece, F.lit(a)), turn(F.lit(role), within(a, b))).otherwise(read)
    return read


def parsed(formatted: Column, template: Template = LLAMA) -> Column:
    """The turns of a text as an array of (role, text); null where the text isn't one of the grammar."""
    found = pieces(formatted, template)
    turns = F.transform(found, lambda p: read_turn(p, template))
    return F.when((F.array_join(found, "") == formatted) & F.forall(turns, lambda t: t.isNotNull()), turns)


def rendered_turns(rows: DataFrame, template: Template = LLAMA, *, role: str = "role", text: str = "text") -> DataFrame:
    """rows with the columns before, body and behind: body is the text where it reads back as it was, else the escaped text."""
    said = F.struct(F.col("_role").alias("role"), F.col("_text").alias("text"))
    before, behind = frame(F.col("_role"), template)
    held = rows.select("*", F.coalesce(role, F.lit("")).alias("_role"), F.coalesce(text, F.lit("")).alias("_text"))
    framed = held.select("*", before.alias("before"), behind.alias("behind"), said.alias("_said"))
    whole = lambda body: F.concat("before", body, "behind")
    same = lambda body: F.coalesce(parsed(whole(body), template) == F.array("_said"), F.lit(False))
    plain = framed.select("*", same(F.col("_text")).alias("_plain"))
    body = F.when(F.col("_plain"), F.col("_text")).otherwise(escaped(F.col("_text"), template))
    tried = plain.select("*", body.alias("body"))
    again = F.col("_plain") | same(F.col("body"))
    return tried.withColumn("body", F.when(again, F.col("body")).otherwise(F.raise_error(F.lit("a turn doesn't read back as it was"))))


def formatted_conversations(turns: DataFrame, template: Template = LLAMA) -> DataFrame:
    """(conv_id, formatted, loss): each conversation as one text, and where its learned texts are in it.

    turns: conv_id, turn, role, text, one row for each turn.  Turns come by number (null last),
    those of one number by role and text; repeated rows are turns of their own.  Null
    texts and roles are empty ones.  Null conversations are one.  loss is an array of
    (start, length) in code points, from 0, of the escaped bodies of learned turns, in order.
    Other columns aren't read.  A conversation is a value of one row, so it must fit into a
    task's memory; of its turns nothing else is gathered.
    """
    rows = rendered_turns(turns.select("conv_id", "turn", "role", "text"), template)
    learned = F.col("_role").isin(*template.learned)
    # Sorted by this: number (null last), role, text.
    part = F.struct(F.col("turn").isNull().alias("none"), "turn", "_role", "_text", "before", "body", "behind", learned.alias("learned"))
    gathered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["before"], p["body"], p["behind"])), "")
    said = F.transform("parts", lambda p: F.struct(p["_role"].alias("role"), p["_text"].alias("text")))
    made = gathered.select("conv_id", "parts", text.alias("formatted"), said.alias("said"))
    checked = F.when(F.coalesce(parsed(F.col("formatted"), template) == F.col("said"), F.lit(False)), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation doesn't read back as it was")))
    sizes = F.transform("parts", lambda p: F.struct(F.length(p["before"]).alias("a"), F.length(p["body"]).alias("n"), F.length(p["behind"]).alias("b"), p["learned"].alias("learned")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        span = F.struct((state["at"] + p["a"]).alias("start"), p["n"].alias("length"))
        spans = F.when(p["learned"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((state["at"] + p["a"] + p["n"] + p["b"]).alias("at"), spans.alias("spans"))

    return made.select("conv_id", checked.alias("formatted"), F.aggregate(sizes, zero, step)["spans"].alias("loss"))


def read_back(formatted: DataFrame, template: Template = LLAMA) -> DataFrame:
    """(conv_id, turns, learned, formatted_chars) of written conversations: the turns that the parser gives, and the unescaped texts under the loss mask."""
    under = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"]), template))
    return formatted.select("conv_id", parsed(F.col("formatted"), template).alias("turns"), under.alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))


def conversation_digests(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256 (of role, line break, text, line break for each turn), loss_chars, loss_sha256 and formatted_chars of `read_back`."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    held = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), turns.alias("said"), F.array_join("learned", "").alias("learned"), "formatted_chars")
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return held.select("conv_id", "n_turns", digest("said").alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), digest("learned").alias("loss_sha256"), "formatted_chars")
