"""Text helpers: contains-search, genre lines, extended text, model replies."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains(column: Column, fragment: str, case_sensitive: bool = False) -> Column:
    """LIKE ``%fragment%``: the caller's ``%`` and ``_`` stay wildcards; ASCII case is ignored by default."""
    pattern = "%" + fragment.replace("\\", "\\\\") + "%"
    if case_sensitive:
        return column.like(pattern)
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    folded = pattern.translate(str.maketrans(upper, lower))
    return F.translate(column, upper, lower).like(folded)


def genre_of(program_info: Column) -> Column:
    """The genre line of a recorder's program text, null when there is none."""
    # Fixed value: the label that opens the genre line.
    found = F.regexp_extract(program_info, r"(?U)ジャンル\s*:\s*([^\n\r]+)", 1)
    return F.nullif(found, F.lit(""))


def headings(ext_text: Column) -> Column:
    """Extended text as ``array<struct<ordinal, heading, body>>``.

    A section opens with ``- `` at the start of a line; text before the first
    one has the empty heading. Ordinals keep sections with equal headings apart.
    """
    clean = F.replace(ext_text, F.lit("\r"), F.lit(""))
    pieces = F.split(clean, r"(?dm)^- ")

    def section(piece: Column, position: Column) -> Column:
        lead = position == 0
        head = F.when(lead, F.lit("")).otherwise(F.substring_index(piece, "\n", 1))
        body = F.when(lead, piece).otherwise(
            F.regexp_replace(piece, r"(?s)\A[^\n]*\n?", ""))
        return F.struct(
            position.cast("int").alias("ordinal"), head.alias("heading"), body.alias("body"))

    sections = F.transform(pieces, section)
    return F.filter(sections, lambda s: ~((s["ordinal"] == 0) & (s["body"] == "")))


def heading_map(ext_text: Column) -> Column:
    """The same sections as a map; a repeated heading gets a tab per earlier occurrence."""
    empty = F.array().cast("array<struct<key:string,value:string>>")

    def add(done: Column, item: Column) -> Column:
        candidates = F.transform(
            F.sequence(F.lit(0), F.size(done)),
            lambda n: F.concat(item["heading"], F.repeat(F.lit("\t"), n)))
        free = F.filter(candidates, lambda c: ~F.exists(done, lambda d: d["key"] == c))
        return F.concat(done, F.array(F.struct(
            F.element_at(free, 1).alias("key"), item["body"].alias("value"))))

    return F.map_from_entries(F.aggregate(headings(ext_text), empty, add))


def title_from_reply(reply: Column) -> Column:
    """Series title out of a stored model reply: code fences off, first ``{…}``, its ``title``.

    A reply that starts with ``{`` must end with ``}``: what follows the object makes it invalid.
    """
    blanks = F.lit(" \t\r\n")
    # Fixed pattern: the fences of a reply.
    bare = F.trim(F.regexp_replace(F.trim(reply, blanks), r"(?m)^```(?:json)?\n?|```$", ""), blanks)
    body = F.when(bare.startswith("{"), F.when(bare.endswith("}"), bare)).otherwise(F.regexp_extract(bare, r"(?s)\{.*\}", 0))
    return F.nullif(F.get_json_object(body, "$.title"), F.lit(""))


def first_title(*choices: Column) -> Column:
    """First choice that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices])
