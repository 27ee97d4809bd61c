"""Chat formatting by quotation linking: quoted passages lead to the message they come from, then go.

The lines of a message have a level, their marks of quotation. Consecutive lines of a level are a passage. Of a message's own
text (level 0) and of what it quotes (any deeper level) the same units are hashed: single lines, passages with their line
breaks folded, so that a quotation that was wrapped anew is found, and all lines of a level together. A quoted unit leads to
the first message of the conversation that has it as its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, let, stored

#: Marks of quotation before a line, each level one.
QUOTED = r"^(?:[ \t]*>)+"
#: Who is quoted, on the line before a quotation.
ATTRIBUTION = r"^(?:on|am|le|el) .*(?:wrote|schrieb.*|a écrit|escribió) ?:$|^[^:]* (?:wrote|writes|schrieb|a écrit|escribió) ?:$"
#: The same wrapped over two lines: the first begins so, has a date or a comma and doesn't end a sentence, the second ends so.
WRAPPED = r"^(?:on|am|le|el) [^\n]*[0-9,](?:[^\n]*[^.!?:;\n])?\n(?:[^\n]* )?(?:wrote|schrieb[^\n]*|a écrit|escribió) ?:$"
#: Characters of a line or passage that leads somewhere; all of a text does, however short.
LEAST = 12


def normal(line: Column) -> Column:
    """A line without marks, A-Z lowered, runs of white space one blank."""
    bare = F.regexp_replace(line, QUOTED, "")
    bare = F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.regexp_replace(bare, r"[\x20\x09-\x0D]+", " "), r"^ | $", "")


def _level(line: Column) -> Column:
    return F.regexp_count(F.regexp_extract(line, QUOTED, 0), F.lit(">"))


def parsed(text: Column) -> Column:
    """The lines of a text: ``raw``, ``level``, ``line`` (normal) and ``own``, false for an attribution, of one line or two."""
    cut = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("raw"), _level(x).alias("level"), normal(x).alias("line")))

    def told(lines: Column) -> Column:
        def wrapped(a: Column, b: Column) -> Column:
            return F.coalesce((a["level"] == b["level"]) & F.concat(a["line"], F.lit("\n"), b["line"]).rlike(WRAPPED), F.lit(False))

        def quoted_after(x: Column, i: Column, n: int) -> Column:
            return F.coalesce(F.get(lines, i + n)["level"] > x["level"], F.lit(False))

        def one(x: Column, i: Column) -> Column:
            second = quoted_after(x, i, 1) & (x["line"].rlike(ATTRIBUTION) | wrapped(F.get(lines, i - 1), x))
            first = quoted_after(x, i, 2) & wrapped(x, F.get(lines, i + 1))
            return F.struct(x["raw"].alias("raw"), x["level"].alias("level"), x["line"].alias("line"), (~(first | second)).alias("own"))

        return F.transform(lines, one)

    return let(cut, told)


def units(lines: Column) -> Column:
    """Different (level, text) of the lines, passages and whole levels of parsed() lines."""

    def counts(x: Column) -> Column:
        return x["own"] & (x["line"] != "")

    def unit(level: Column, text: Column) -> Column:
        return F.struct(level.alias("level"), text.alias("text"))

    def of(x: Column) -> Column:
        def begins(y: Column, i: Column) -> Column:
            before = F.get(x, i - 1)
            return counts(y) & ~F.coalesce(counts(before) & (before["level"] == y["level"]), F.lit(False))

        starts = F.filter(F.transform(x, lambda y, i: F.when(begins(y, i), i)), lambda i: i.isNotNull())

        def run(s: Column, k: Column, all_: Column) -> Column:
            piece = F.slice(x, s + 1, F.coalesce(F.get(all_, k + 1), F.size(x)) - s)
            return unit(F.get(x, s)["level"], F.array_join(F.transform(F.filter(piece, counts), lambda y: y["line"]), " "))

        runs = let(starts, lambda all_: F.transform(all_, lambda s, k: run(s, k, all_)))
        single = F.transform(F.filter(x, counts), lambda y: unit(y["level"], y["line"]))
        whole = F.transform(
            F.array(F.lit(0), F.lit(1)),
            lambda n: unit(n, F.array_join(F.transform(F.filter(x, lambda y: counts(y) & (y["level"] == n)), lambda y: y["line"]), " ")),
        )
        long = F.filter(F.concat(single, runs), lambda u: F.length(u["text"]) >= LEAST)
        return F.array_distinct(F.concat(long, F.filter(whole, lambda u: u["text"] != "")))

    return let(lines, of)


def linked(messages: DataFrame) -> DataFrame:
    """``conv, turn, text`` -> ``conv, turn, parent``: for messages that quote an earlier one. Where several earlier messages say
    the same, the first of them is who said it.

    Of the levels that lead to an earlier message the shallowest counts: deeper ones are what the parent itself quotes. The
    parent is the message with the most characters in units of that level, of several the latest.
    """
    found = messages.select("conv", "turn", F.explode(units(parsed(F.col("text")))).alias("u"))
    # two hashes of 64 bits stand for a unit
    key = [F.xxhash64("u.text").alias("h1"), F.xxhash64(F.lit("second"), "u.text").alias("h2")]
    keyed = found.select("conv", "turn", F.col("u.level").alias("level"), F.length("u.text").alias("chars"), *key)
    quoted = keyed.where("level > 0").distinct()
    first = keyed.where("level = 0").groupBy("conv", "h1", "h2").agg(F.min("turn").alias("parent"))
    there = quoted.join(first, ["conv", "h1", "h2"]).where("parent < turn")
    by = there.groupBy("conv", "turn", "level", "parent").agg(F.sum("chars").alias("chars"))
    return by.groupBy("conv", "turn").agg(F.max_by("parent", F.struct(-F.col("level"), "chars", "parent")).alias("parent"))


def threads(links: DataFrame) -> DataFrame:
    """``conv, turn, parent`` -> ``conv, turn, root, depth``: links followed twice as far each round."""
    now = stored(links.select("conv", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        on = now.select("conv", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        step = now.join(on, ["conv", "root"], "left")
        moved = step.where("next is not null").limit(1).count()
        if not moved:
            return now
        further = stored(
            step.select("conv", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "threads"
        )
        dropped(now)
        now = further


def conversations(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """A row for each row of ``messages``: conv, turn, role, parent, root, depth, n_quoted, body, formatted. Reply order is that
    of conv, root (the first message of the thread) and turn: a message follows what it answers; see in_reply_order().

    ``body`` is the text without quoted lines and attributions, outer white space cut; a null text has an empty one. A
    message that quotes nothing earlier has no parent and begins a thread (root: its own turn, depth 0). Messages without
    conversation or turn are kept, and linked to nothing. Of rows that repeat each is kept, as one message in links. Other
    columns are not read; an empty table gives no row.
    """
    rows = messages.select(
        messages[conv_col].alias("conv"), messages[turn_col].alias("turn"), messages[role_col].alias("role"),
        F.coalesce(messages[text_col], F.lit("")).alias("text"),
    )
    links = stored(linked(rows.where("conv is not null and turn is not null")), "quotes")
    deep = threads(links)
    lines = parsed(F.col("text"))
    cut = let(
        lines,
        lambda x: F.struct(
            F.array_join(F.transform(F.filter(x, lambda y: y["own"] & (y["level"] == 0)), lambda y: y["raw"]), "\n").alias("body"),
            F.size(F.filter(x, lambda y: y["level"] > 0)).cast("long").alias("n_quoted"),
        ),
    )
    bare = rows.select("conv", "turn", "role", cut.alias("cut"))
    body = F.regexp_replace("cut.body", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    out = bare.select("conv", "turn", "role", body.alias("body"), "cut.n_quoted").join(links, ["conv", "turn"], "left").join(deep, ["conv", "turn"], "left")
    return out.select(
        "conv", "turn", "role", "parent", F.coalesce("root", "turn").alias("root"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        "n_quoted", "body", F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), "body", F.lit("\n")).alias("formatted"),
    )


def in_reply_order(formatted: DataFrame) -> DataFrame:
    """The rows of conversations() in reply order, to be written: ranges of them are sorted apart, so that a conversation of any
    size is spread over as many tasks as it needs."""
    return formatted.repartitionByRange("conv", "root", "turn").sortWithinPartitions("conv", "root", "turn", "role", "body")
