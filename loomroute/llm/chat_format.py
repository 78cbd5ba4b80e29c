"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns up to it as context, and only its text trainable.
A turn is written ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line feed. Control strings inside roles and
texts are escaped: a backslash becomes two, and the first character of each control string is followed by one
backslash. No control string is left in an escaped text, and unescaping gives back every text exactly. The
strings of a second common template are escaped too, so the output may be wrapped in it.

Turns after the last assistant turn, or of a conversation without one, are kept in a last example with no
trainable span, so the examples hold the whole conversation.

Defined cases: null text or role counts as empty; turns are ordered by (turn, role, text), null turn numbers
first, and repeated rows stay; rows with a null conv_id form one conversation; an empty table gives no
examples; other columns are ignored. A conversation's own turns are gathered in one row, since an example holds
its whole prefix.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of the template and of a bracketed one (fixed values).
CONTROL = (START, SEP, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TRAINABLE = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for first in sorted({c[0] for c in CONTROL}):
        rest = "|".join(re.escape(c[1:]) for c in CONTROL if c[0] == first)
        out = F.regexp_replace(out, f"{re.escape(first)}(?={rest})", first + r"\\")  # one backslash in a replacement
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, roles and texts escaped."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    return own.select("conv_id", F.transform("turns", lambda t: F.struct((t["role"] == TRAINABLE).alias("train"), escape(t["role"]).alias("role"), escape(t["text"]).alias("text"))).alias("turns"))


def expand(turns: DataFrame) -> DataFrame:
    """(conv_id, example, n_turns, formatted, loss_start, loss_end): offsets in code points, null where nothing is trainable.

    The example that holds the whole conversation comes last.
    """
    written = F.transform("turns", lambda t: F.concat(F.lit(START), t["role"], F.lit(SEP), t["text"], F.lit(END + "\n")))
    convs = conversations(turns).withColumn("written", written)
    n = F.size("turns")
    at = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("turns", i)["train"] | (i == n))
    each = convs.select("conv_id", "turns", "written", F.posexplode(at).alias("example", "n_turns"))
    each = each.withColumn("formatted", F.array_join(F.slice("written", F.lit(1), F.col("n_turns")), "")).withColumn("turn", F.element_at("turns", F.col("n_turns")))
    stop = F.length("formatted") - len(END) - 1
    return each.select(
        "conv_id",
        "example",
        "n_turns",
        "formatted",
        F.when(F.col("turn.train"), stop - F.length("turn.text")).alias("loss_start"),
        F.when(F.col("turn.train"), stop).alias("loss_end"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Digest of each conversation, from the formatted strings and their spans alone."""
    masked = F.when(F.col("loss_start").isNotNull(), F.expr("substr(formatted, loss_start + 1, loss_end - loss_start)"))
    grouped = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_sort(F.collect_list(F.struct("example", unescape(masked).alias("loss")))).alias("losses"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    parts = F.split("whole", re.escape(END + "\n"), -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)  # after the last end mark nothing follows
    turns = F.transform(parts, lambda p: F.split(F.substring(p, F.lit(len(START) + 1), F.length(p)), re.escape(SEP), 2))
    text = F.array_join(F.transform(turns, lambda t: F.concat(unescape(t[0]), F.lit("\n"), unescape(t[1]), F.lit("\n"))), "")
    loss = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return grouped.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(expand(turns.unionByName(extra)))


def _sql_escape(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


ORACLE = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
w AS (
  SELECT *, row_number() OVER c AS k, count(*) OVER (PARTITION BY conv_id) AS n,
         sum(length({_sql_escape('role')}) + length({_sql_escape('text')}) + {len(START + SEP + END) + 1}) OVER c AS upto
  FROM t WINDOW c AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id
"""
