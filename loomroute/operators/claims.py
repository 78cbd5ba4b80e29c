"""Checks of prose against numbers: clauses, quoted values, completeness, templates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: where a text is cut into clauses. Ends of sentences, contrasts, colons and dashes.
CLAUSE = r"(?<=[.;!?])\s+|\bwhile\b|\bwhereas\b|,\s+but\b|\bbut\b(?=\s+c\d)|:\s+|\s+[—–]\s+|\s+--\s+"


def clauses(text: Column) -> Column:
    """Clauses that are not blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), CLAUSE, -1), lambda c: c.rlike(r"\S"))


def sentence_count(text: Column) -> Column:
    """Sentences end at a mark that white space follows, so a decimal point ends none."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+", -1), lambda s: s.rlike(r"\S"))).cast("long")


def unsupported(claims: DataFrame, facts: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """Claims (key, value) without a fact of the same key within the tolerance.

    A band join as an equi-join: values are cut into cells of twice the tolerance, and each fact is also filed
    under its neighbours.
    """
    width = 2 * tolerance
    cell = F.floor(F.col(value) / width)
    near = facts.select(key, F.col(value).alias("_fact"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"))
    c = claims.withColumn("_cell", F.floor(F.col(value) / width))
    return c.join(near, (c[key] == near[key]) & (c["_cell"] == near["_cell"]) & (F.abs(c[value] - near["_fact"]) <= tolerance), "left_anti").drop("_cell")


def placeholders(template: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", template)


def template_pattern(template: str) -> str:
    """An anchored pattern with a group for each placeholder; a repeated one must match the same text."""
    out, seen = "", []
    for i, part in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2 == 0:
            out += re.escape(part)
        elif part in seen:
            out += f"\\{seen.index(part) + 1}"
        else:
            seen.append(part)
            out += "(.*?)"
    return f"(?s)^{out}$"


def fill(template: str, columns: dict[str, Column]) -> Column:
    """The template with columns in place of its placeholders."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else columns[p].cast("string") for i, p in enumerate(parts)])


def read_template(text: Column, template: str) -> Column:
    """The inverse: a struct of the placeholders' texts, null where the text does not fit."""
    pattern = template_pattern(template)
    names = list(dict.fromkeys(placeholders(template)))
    return F.when(text.rlike(pattern), F.struct(*[F.regexp_extract(text, pattern, i + 1).alias(n) for i, n in enumerate(names)]))


def keyed_lines(body: Column, keys: list[str]) -> Column:
    """``key: value`` lines: the first of each key wins; other keys are left out."""
    return F.struct(*[F.nullif(F.regexp_extract(body, rf"(?m)^{re.escape(k)}:[ \t]*(.*)$", 1), F.lit("")).alias(k) for k in keys])


def completion_parts(text: Column) -> Column:
    """Reasoning, payload and kind of a completion, by its markers."""
    think = F.regexp_extract(text, r"(?s)<think>(.*?)</think>", 1)
    act = F.regexp_extract(text, r"(?s)<act>(.*?)</act>", 1)
    kind = F.when(act != "", "act").when(text.contains("<think>") & ~text.contains("</think>"), "cut").when(think != "", "think").otherwise("plain")
    return F.struct(F.trim(think).alias("think"), F.trim(act).alias("payload"), kind.alias("kind"))
