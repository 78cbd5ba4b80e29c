"""Structure strings without a chemistry library: a regular-expression reading of SMILES.

Counts of explicit atoms are exact for valid strings (implicit hydrogen is not counted); canonical forms and
keys need a chemistry library and are taken from it where one is installed (``canonical`` falls back to the
trimmed string otherwise, and says so in ``has_library``).
"""

from __future__ import annotations

import importlib.util

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

has_library = importlib.util.find_spec("rdkit") is not None

#: One token of a SMILES string: a bracket atom, a two-letter or one-letter atom, a bond, branch, ring or dot.
TOKEN = r"\[[^\]]+\]|Br|Cl|[BCNOPSFI]|[bcnops]|%\d{2}|[0-9]|[()=#\-+\\/:~.@*$>?]"
_ATOM = r"\[[^\]]+\]|Br|Cl|[BCNOPSFI]|[bcnops]"


def tokens(smiles: Column) -> Column:
    return F.regexp_extract_all(smiles, F.lit(TOKEN), F.lit(0))


def element(atom: Column) -> Column:
    """Element symbol of an atom token, its first letter upper-cased."""
    inner = F.when(atom.startswith("["), F.regexp_extract(atom, r"^\[\d*([A-Z][a-z]?|[a-z]{1,2})", 1)).otherwise(atom)
    # A lower-case aromatic symbol of one letter, or two as in se and as.
    return F.concat(F.upper(F.substring(inner, 1, 1)), F.substring(inner, 2, 1))


def atoms(smiles: Column) -> Column:
    return F.transform(F.regexp_extract_all(smiles, F.lit(_ATOM), F.lit(0)), element)


def heavy_atoms(smiles: Column) -> Column:
    """Explicit atoms other than hydrogen; null for null or a string without atoms."""
    n = F.size(F.filter(atoms(smiles), lambda a: a != "H"))
    return F.when(n > 0, n)


def formula(smiles: Column) -> Column:
    """Element -> count."""
    a = F.filter(atoms(smiles), lambda x: x != "H")
    kinds = F.array_sort(F.array_distinct(a))
    return F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, F.size(F.filter(a, lambda x: x == k)))))


def conserves(product: Column, reactants: Column) -> Column:
    """No element of the product outnumbers that of all reactants together; null if the product has no atom."""
    have = F.flatten(F.transform(reactants, atoms))
    want = F.filter(atoms(product), lambda x: x != "H")
    enough = F.forall(F.array_distinct(want), lambda k: F.size(F.filter(want, lambda x: x == k)) <= F.size(F.filter(have, lambda x: x == k)))
    return F.when(F.size(want) > 0, enough)


def retro_mass_ok(product: Column, reactants: Column, slack: int = 10) -> Column:
    """Heavy atoms of the product exceed those of the reactants by at most ``slack``; unreadable or empty is false."""
    total = F.aggregate(F.transform(reactants, heavy_atoms), F.lit(0), lambda a, x: a + x)
    return F.coalesce(heavy_atoms(product) - total <= slack, F.lit(False)) & (F.size(reactants) > 0)


def strip_maps(smiles: Column) -> Column:
    """Atom-map numbers removed; a bracket atom left with a plain symbol loses its brackets."""
    bare = F.regexp_replace(smiles, r":\d+\]", "]")
    return F.regexp_replace(bare, r"\[(B|C|N|O|P|S|F|Cl|Br|I|b|c|n|o|p|s)\]", "$1")


def components(smiles: Column) -> Column:
    return F.filter(F.split(smiles, r"\."), lambda x: x != "")


def major_component(smiles: Column) -> Column:
    """The component with most heavy atoms, the first on ties."""
    c = components(smiles)
    sized = F.transform(c, lambda x, i: F.struct(F.coalesce(heavy_atoms(x), F.lit(0)).alias("n"), (-i).alias("at"), x.alias("smiles")))
    return F.array_max(sized)["smiles"]


@F.pandas_udf(T.StringType())
def canonical(smiles: pd.Series) -> pd.Series:
    """Canonical form or null; without a library the trimmed string stands for it."""
    if not has_library:
        return smiles.str.strip().replace("", None)
    from rdkit import Chem

    def one(s):
        m = Chem.MolFromSmiles(s) if s else None
        return Chem.MolToSmiles(m) if m else None

    return smiles.map(one)


def fingerprint(smiles: Column, width: int = 3) -> Column:
    """64-bit hashed fingerprint of token n-grams: a stand-in for a circular one."""
    t = tokens(smiles)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - width + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, width), ""))
    one = F.lit(1).cast("long")
    return F.aggregate(grams, F.lit(0).cast("long"), lambda a, g: a.bitwiseOR(F.call_function("shiftleft", one, F.pmod(F.xxhash64(g), F.lit(64)).cast("int"))))
