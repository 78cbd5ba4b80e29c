"""Identity of steps and routes, set distances, small numeric terms. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def step_key(product, reactants, distinct: bool = True) -> Column:
    """``product>>a.b`` over sorted reactants; with ``distinct`` each reactant once (the spelling that is stored)."""
    r = F.array_distinct(_col(reactants)) if distinct else _col(reactants)
    return F.concat(_col(product).cast("string"), F.lit(">>"), F.array_join(F.array_sort(F.transform(r, lambda x: x.cast("string"))), "."))


def given_key(product, reactants) -> Column:
    """The spelling in the order given."""
    return F.concat(_col(product).cast("string"), F.lit(">>"), F.array_join(F.transform(_col(reactants), lambda x: x.cast("string")), "."))


def normal_steps(steps) -> Column:
    """Steps with sorted reactants."""
    return F.transform(_col(steps), lambda s: F.struct(s["product"].alias("product"), F.array_sort(s["reactants"]).alias("reactants")))


def leaves(steps) -> Column:
    """Consumed but never produced, each once, sorted."""
    s = _col(steps)
    return F.array_sort(F.array_except(F.array_distinct(F.flatten(F.transform(s, lambda x: x["reactants"]))), F.transform(s, lambda x: x["product"])))


def internal(steps) -> Column:
    """Produced molecules, each once, sorted."""
    return F.array_sort(F.array_distinct(F.transform(_col(steps), lambda x: x["product"])))


def set_key(step_keys) -> Column:
    """Order-blind identity of a route from its step keys."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(_col(step_keys))), "|"), 256)


def seq_key(step_keys) -> Column:
    """Order-sensitive identity."""
    return F.sha2(F.array_join(_col(step_keys), "|"), 256)


def jaccard_distance(a, b) -> Column:
    """1 - shared / all; null if both are empty."""
    a, b = _col(a), _col(b)
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, 1.0 - F.size(F.array_intersect(a, b)).cast("double") / both)


def tanimoto(a, b) -> Column:
    """Shared over all set bits of two 64-bit words; null if neither has any."""
    a, b = _col(a), _col(b)
    every = F.bit_count(a.bitwiseOR(b))
    return F.when(every > 0, F.bit_count(a.bitwiseAND(b)).cast("double") / every)


def ramp(x, low: float, high: float) -> Column:
    """0 below low, 1 above high, linear between."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (_col(x) - low) / (high - low)))


def log_utility(cost, cap: float) -> Column:
    """1 - ln(1 + cost) / ln(1 + cap) with the cost clipped to [0, cap]; unknown cost gives 0."""
    c = F.least(F.greatest(_col(cost), F.lit(0.0)), F.lit(float(cap)))
    return F.coalesce(1.0 - F.log1p(c) / F.log1p(F.lit(float(cap))), F.lit(0.0))


def plausibility_term(p, floor: float = 0.05) -> Column:
    return F.greatest(F.coalesce(_col(p), F.lit(floor)), F.lit(floor))


def rank_term(rank, floor: float = 0.05) -> Column:
    """Ranks 1 to 5 give 1, 0.8, 0.6, 0.4, 0.2; any other the floor."""
    r = _col(rank)
    return F.when(r.between(1, 5), (6 - r) / F.lit(5.0)).otherwise(F.lit(floor))


def price_term(total, low: float = 30.0, high: float = 100_000.0, floor: float = 0.05) -> Column:
    """Log-scaled cheapness between two prices, clipped to [floor, 1]; unknown gives the floor."""
    t = (F.log(F.lit(high)) - F.log(_col(total))) / (F.log(F.lit(high)) - F.log(F.lit(low)))
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(floor), t)), F.lit(floor))


#: Natural logarithm of a price from which only its bound is shown (fixed value).
PRICE_SATURATE = 15.0
#: Start and width of the logarithmic window that maps a cost to 0..1 (fixed values).
COST_LOW, COST_SPAN = 2.5, 9.0


def fixed(v, decimals: int) -> Column:
    """The number with so many decimals as C and Python print it: its exact value is rounded, ties to even.

    ``format_string`` rounds the shortest decimal that reads as the number, ties up: 1.45, which is a bit less, gives 1.5.
    """
    return F.call_function("format_number", _col(v), F.lit("0." + "0" * decimals if decimals else "0"))


def dollars_string(dollars) -> Column:
    """A price of whole dollars below 1000, thousands with one decimal below 10,000 and without above."""
    d = _col(dollars)
    k = F.concat(F.lit("$"), F.when(d >= 10_000, fixed(d / 1000, 0)).otherwise(fixed(d / 1000, 1)), F.lit("k"))
    return F.when(d >= 1000, k).otherwise(F.concat(F.lit("$"), fixed(d, 0)))


def price_string(ln_price) -> Column:
    """The price whose natural logarithm is given: two decimals below 1, one below 10, none below 1000, then k and M."""
    v = _col(ln_price)
    d = F.exp(v)
    return (
        F.when(v.isNull(), F.lit(""))
        .when(v >= PRICE_SATURATE, F.lit("$3.3M+"))
        .when(d >= 1_000_000, F.format_string("$%.1fM", d / 1_000_000))
        .when(d >= 10_000, F.format_string("$%.0fk", d / 1000))
        .when(d >= 1000, F.format_string("$%.1fk", d / 1000))
        .when(d >= 10, F.format_string("$%.0f", d))
        .when(d >= 1, F.format_string("$%.1f", d))
        .otherwise(F.format_string("$%.2f", d))
    )


def cost_string(ln_price) -> Column:
    """The same price on the scale of the other axes: $.187, lower is cheaper."""
    return F.regexp_replace(F.format_string("$%.3f", ramp(_col(ln_price), COST_LOW, COST_LOW + COST_SPAN)), r"^\$0\.", r"\$.")


def short_number(v, decimals: int = 3) -> Column:
    """A decimal without its leading zero: .374; a dash for null."""
    return F.coalesce(F.regexp_replace(fixed(v, decimals), r"^(-?)0\.", "$1."), F.lit("--"))


def recovered(rank, present) -> Column:
    """Three spellings: the rank, not recovered, never asked."""
    return F.when(~_col(present), F.lit("rt?")).when(_col(rank).isNull(), F.lit("rt-")).otherwise(F.concat(F.lit("rt"), _col(rank).cast("string")))
