"""Rules that hold a draft against the facts of its turn. Each gives rows (turn key, code, detail); no row, no violation.

A rule that lacks the facts it needs stays silent. Clauses come from ``claims.clauses``; a clause speaks of the
candidates it names as ``cN``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .claims import clauses


def clause_rows(drafts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, clause, cands): lower-cased clauses with the candidate numbers they name, distinct and sorted."""
    c = drafts.select(key, F.posexplode(clauses(F.col(text))).alias("pos", "clause")).withColumn("clause", F.lower("clause"))
    named = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("clause", F.lit(r"\bc(\d+)\b"), F.lit(1)), lambda x: x.cast("long"))))
    return c.withColumn("cands", named)


def cutoff(drafts: DataFrame, menu: DataFrame, key: str, text: str, cut: float = 0.05) -> DataFrame:
    """A clause says that a candidate is below or above the cut, and its value is on the other side. menu: (key, cand, p)."""
    c = clause_rows(drafts, key, text)
    says = F.when(F.col("clause").rlike(r"\b(below|under)\b.*\bcut"), "below").when(F.col("clause").rlike(r"\b(above|clears|over)\b.*\bcut"), "above")
    said = c.withColumn("says", says).where("says IS NOT NULL").select(key, "says", F.explode("cands").alias("cand")).distinct()
    j = said.join(menu.select(key, "cand", "p"), [key, "cand"])
    wrong = ((F.col("says") == "below") & (F.col("p") >= cut)) | ((F.col("says") == "above") & (F.col("p") < cut))
    return j.where(wrong).select(key, F.concat(F.lit("cutoff/"), "says").alias("code"), F.concat(F.lit("c"), F.col("cand").cast("string")).alias("detail"))


def recovery(drafts: DataFrame, menu: DataFrame, key: str, text: str) -> DataFrame:
    """A clause says that a candidate reads forward, or does not, against its recorded rank. menu: (key, cand, rt, asked)."""
    c = clause_rows(drafts, key, text)
    says = F.when(F.col("clause").rlike(r"(not recovered|does not read forward)"), "no").when(F.col("clause").rlike(r"(recovered|reads forward)"), "yes")
    said = c.withColumn("says", says).where("says IS NOT NULL").select(key, "says", F.explode("cands").alias("cand")).distinct()
    j = said.join(menu.select(key, "cand", "rt", "asked"), [key, "cand"]).where("asked")
    wrong = ((F.col("says") == "no") & F.col("rt").isNotNull()) | ((F.col("says") == "yes") & F.col("rt").isNull())
    return j.where(wrong).select(key, F.concat(F.lit("rt/"), "says").alias("code"), F.concat(F.lit("c"), F.col("cand").cast("string")).alias("detail"))


def quantifier(drafts: DataFrame, menu: DataFrame, key: str, text: str) -> DataFrame:
    """``only one reads forward`` with more than one of rank 1, or ``all N read forward`` with fewer."""
    first = menu.groupBy(key).agg(F.count_if(F.col("rt") == 1).alias("n_first"))
    d = drafts.select(key, F.lower(text).alias("t")).join(first, key)
    n = F.regexp_extract("t", r"\ball (\d+) read forward", 1).try_cast("int")
    only = F.col("t").rlike(r"\bonly one reads forward") & (F.col("n_first") > 1)
    code = F.when(only, "quantifier/only_one").when(n > F.col("n_first"), "quantifier/all")
    return d.withColumn("code", code).where("code IS NOT NULL").select(key, "code", F.col("n_first").cast("string").alias("detail"))


def argues_from_best(drafts: DataFrame, menu: DataFrame, taken: DataFrame, key: str, text: str) -> DataFrame:
    """The text argues from the highest q, and the taken candidate is not the menu's argmax. taken: (key, cand)."""
    best = menu.groupBy(key).agg(F.max("q").alias("best"))
    own = taken.join(menu.select(key, "cand", "q"), [key, "cand"]).join(best, key)
    d = drafts.where(F.lower(text).rlike(r"\b(highest|best|top) q\b")).select(key)
    return own.join(d, key).where("q < best").select(key, F.lit("q_argmax").alias("code"), F.concat(F.lit("c"), F.col("cand").cast("string")).alias("detail"))


def quoted_values(drafts: DataFrame, menu: DataFrame, key: str, text: str, tolerance: float = 5e-4) -> DataFrame:
    """Values quoted as ``q.374`` that are not within the tolerance of a menu value."""
    from .claims import unsupported

    said = drafts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\bq\s?0?(\.\d+)"), F.lit(1)))).alias("detail"))
    said = said.withColumn("v", F.concat(F.lit("0"), "detail").cast("double"))
    return unsupported(said, menu.select(key, F.col("q").alias("v")), key, "v", tolerance).select(key, F.lit("quoted_q").alias("code"), "detail")


def completeness(drafts: DataFrame, state: DataFrame, key: str, text: str) -> DataFrame:
    """Claims of completeness while something is open, or that nothing beats the routes while under half of the budget is spent."""
    d = drafts.select(key, F.lower(text).alias("t")).join(state, key)
    early = F.col("t").rlike(r"\b(everything|all) is closed") & (F.col("n_open") > 0)
    beat = F.col("t").rlike(r"\bnothing (can )?beat") & (F.col("spent") * 2 < F.col("budget"))
    code = F.when(early, "complete/open_left").when(beat, "complete/budget_left")
    return d.withColumn("code", code).where("code IS NOT NULL").select(key, "code", F.col("n_open").cast("string").alias("detail"))


def last_endorsed(drafts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cand): the candidate of the last clause that endorses exactly one."""
    c = clause_rows(drafts, key, text).where(F.col("clause").rlike(r"\b(take|choose|commit|prefer)\b") & (F.size("cands") == 1))
    return c.groupBy(key).agg(F.max_by(F.element_at("cands", 1), "pos").alias("cand"))


def action_match(drafts: DataFrame, taken: DataFrame, key: str, text: str) -> DataFrame:
    """The last endorsement is of another candidate than the one taken."""
    e = last_endorsed(drafts, key, text).withColumnRenamed("cand", "said")
    return e.join(taken, key).where("said <> cand").select(key, F.lit("action/other_candidate").alias("code"), F.concat(F.lit("c"), F.col("said").cast("string")).alias("detail"))


def check(parts: list[DataFrame], key: str) -> DataFrame:
    """All violations, each (code, detail) once for a turn, numbered in order."""
    every = reduce(DataFrame.unionByName, parts).distinct()
    return every.withColumn("no", F.row_number().over(Window.partitionBy(key).orderBy("code", "detail")).cast("long"))


def describe(violations: DataFrame, key: str, most: int = 6) -> DataFrame:
    """A correction text of the first ``most`` violations: the report's own limit."""
    line = F.concat_ws(": ", "code", "detail")
    g = violations.where(F.col("no") <= most).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("no", line.alias("line")))).alias("a"))
    return g.select(key, F.array_join(F.transform("a", lambda x: x["line"]), "; ").alias("text"))
