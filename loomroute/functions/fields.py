"""Fields of drafts and board text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that half of all class names share, spellings of a missing value, and patterns.
CLASS_STOP = ("substitution", "synthesis", "reaction", "coupling", "aryl", "alcohol", "amine", "acid", "general", "with", "from", "type")
DASHES = ("", "-", "–", "—", "none", "n/a")
CHOICE = r"^\S+·c\d+$"
SIGNAL = r"([a-z]+)(\.\d+|\d+|—)"
NUMBER = r"[-+]?\d*\.\d+|[-+]?\d+"


def choices(text: Column) -> Column:
    """``qm·c0 vg·c9`` as a map; null if a token is no such pair, a molecule comes twice, or there is none."""
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+", -1), lambda t: t != "")
    mids = F.transform(tokens, lambda t: F.substring_index(t, "·", 1))
    ok = (F.size(tokens) > 0) & F.forall(tokens, lambda t: t.rlike(CHOICE)) & (F.size(F.array_distinct(mids)) == F.size(mids))
    cands = F.transform(tokens, lambda t: F.regexp_extract(t, r"·c(\d+)$", 1).try_cast("int"))
    return F.when(ok, F.map_from_arrays(mids, cands))


def signals(text: Column) -> Column:
    """``q.374 rt1 p—`` as a map of numbers; a dash is no value, the last of a name counts."""
    found = lambda i: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SIGNAL), F.lit(i))
    pairs = F.filter(F.arrays_zip(found(1).alias("k"), found(2).alias("v")), lambda p: p["v"] != "—")
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    number = lambda v: F.when(v.startswith("."), F.concat(F.lit("0"), v)).otherwise(v).cast("double")
    return F.map_from_arrays(names, F.transform(names, lambda n: number(F.element_at(F.filter(pairs, lambda p: p["k"] == n), -1)["v"])))


def values(text: Column) -> Column:
    """A comma list of numbers; a dash is a null in its place, and a part without a number makes the whole unreadable (null)."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ",", -1), lambda x: F.trim(x))
    dashed = lambda x: F.lower(x).isin(*DASHES)
    number = lambda x: F.when(dashed(x), F.lit(None)).otherwise(F.regexp_extract(x, f"({NUMBER})", 1)).try_cast("double")
    return F.when(F.forall(parts, lambda x: dashed(x) | x.rlike(NUMBER)), F.transform(parts, number))


def content_words(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z]{4,}"), F.lit(0))
    return F.array_except(found, F.array(*[F.lit(w) for w in CLASS_STOP]))


def class_agrees(said: Column, names: Column) -> Column:
    """Whether the text shares a content word with one of the class names."""
    return F.arrays_overlap(content_words(said), content_words(F.array_join(names, " ")))


def names_bond(said: Column, bonds: Column) -> Column:
    """Whether the text names one of the bonds, hyphens and dashes aside; without bonds any word will do."""
    bare = F.regexp_replace(F.upper(F.coalesce(said, F.lit(""))), "[-–—]", "")
    return F.when(F.size(bonds) == 0, F.coalesce(said, F.lit("")).rlike("[a-z]{4,}")).otherwise(F.exists(bonds, lambda b: bare.contains(F.replace(F.upper(b), F.lit("-"), F.lit("")))))


def loose(text: Column) -> Column:
    """Lower case, single blanks, no full stop at the end."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"[. ]+$", ""), r"\s+", " "))


def argument(clause: Column) -> Column:
    """A clause's reason with ids and counts taken out; how much of a step is closed stays."""
    t = F.lower(F.when(clause.contains("|"), F.regexp_replace(clause, r"^[^|]*\|", "")).otherwise(clause))
    for pattern, put in (
        (r"\b([0-9]+) of ([0-9]+) closed\b", " led$1_$2 "),
        (r"\b[rc][0-9]+\b", " "),
        (r"\b(?:both|all|the)?\s*(?:one|two|three|four|five|six|seven|eight)\b", " "),
        (r"\b[a-z]{1,2}[0-9]+\b", " "),
        (r"[^a-z0-9_ ]+", " "),
        (r"\s+", " "),
    ):
        t = F.regexp_replace(t, pattern, put)
    return F.trim(t)


def family(tier: Column, names: Column, measured: Column, formed: Column, broken: Column) -> Column:
    """What makes two steps of one kind: earned names, else the bonds made and broken, else unmeasured."""
    shown = lambda p: F.coalesce(F.nullif(F.array_join(F.array_sort(p), ", "), F.lit("")), F.lit("—"))
    named = (tier == "applies+makes") & (F.size(names) > 0)
    return F.when(named, F.array_join(F.array_sort(names), ", ")).when(measured, F.concat(F.lit("unnamed: "), shown(formed), F.lit(" formed / "), shown(broken), F.lit(" broken"))).otherwise("no mapping")


def split_shape(scaffold: Column, heavy: Column, rings: Column, pieces: Column) -> Column:
    """What a cut does: pieces are structs (scaffold, heavy, rings). Null without any piece."""
    sizes = F.transform(pieces, lambda p: F.coalesce(p["heavy"], F.lit(0)))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    ratio = F.when(F.size(sizes) > 1, F.floor(F.array_min(sizes) / F.greatest(F.array_max(sizes), F.lit(1)) * 100 + 0.5) / 100).otherwise(0.0)
    kept = scaffold.isNotNull() & F.exists(pieces, lambda p: p["scaffold"].eqNullSafe(scaffold))
    out = F.struct(
        kept.alias("scaffold_kept"), rings.alias("rings_product"), total(F.transform(pieces, lambda p: F.coalesce(p["rings"], F.lit(0)))).alias("rings_precursors"),
        (heavy - total(sizes)).alias("heavy_balance"), F.sort_array(sizes, False).alias("fragments"), ratio.alias("size_ratio"),
    )
    return F.when(F.size(pieces) > 0, out)


def objectives(spec: str, known: dict[str, list[tuple[str, str]]]) -> list[tuple[str, str]]:
    """``col:max,col:min`` or the name of a known set, as (column, way)."""
    if spec in known:
        return known[spec]
    out = []
    for part in spec.split(","):
        name, _, way = part.strip().partition(":")
        if not name or way not in ("max", "min"):
            raise ValueError(f"{part!r} is not column:max or column:min")
        out.append((name, way))
    return out
