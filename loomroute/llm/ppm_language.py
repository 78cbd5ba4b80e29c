"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to ``order`` bytes is learned and frozen. The code length of a
byte is that of PPM with escapes (method C): in the longest context known to the language's tree, a byte seen
n times among t occurrences with d distinct bytes costs -log2(n / (t + d)); any other byte costs the escape
-log2(d / (t + d)) and is coded in the next shorter context without the bytes already excluded, down to a
uniform code over the bytes left of 256. So the probabilities after any context sum to one exactly. A text's
code length under a language is the sum over all of its bytes, and the shortest wins; ties go to the language
that sorts first. The score is the winner's share when languages are weighted by 2^-bits.

With frozen statistics the code length is a function of (context, byte), so the trees of all languages are
compiled into one table with a row for each context that any tree knows and a column for each byte class (one
class for all bytes that no tree has seen). Scoring a text is two gathers and a sum for each byte.

Training uses a bounded sample of labelled texts: of the ``most_languages`` languages with the most labelled rows
the ``per_language`` texts each with the smallest hash of doc_id and text, whole texts of at most ``longest``
characters. A language whose texts are all longer is learned from their first ``longest`` characters. These bounds
do not depend on the table, and the sample is all that reaches the driver. Every context of the sample is kept.
What is broadcast is the compiled table, 4 bytes for each context, byte class and language: 22 MB for 13,380
contexts, 103 classes and four languages (sf0.1).

Defined cases: null text, or text without a letter, is ``und`` with score 0; texts of any length are read whole
in pieces; null lang and empty strings teach nothing; without any labelled text every prediction is ``und``;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomroute.plans.workspace import save

from .slices import sliced

ORDER = 3
PER_LANGUAGE = 400
LONGEST = 20_000
MOST_LANGUAGES = 64
UNKNOWN = "und"
#: Bytes scored together.
PIECE = 1 << 18
#: Steps of a hash's upper 20 bits.
_GRAIN = 1 << 20
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    languages: list[str]
    classes: np.ndarray  # byte -> class
    states: np.ndarray  # packed classes of the last ORDER bytes -> row of bits
    bits: np.ndarray  # (row * classes + class, language) -> code length
    order: int

    @property
    def width(self) -> int:
        return int(self.classes.max()) + 1


def _counts(codes: list[np.ndarray], k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed (context of k classes, class) with their counts."""
    packed = []
    for c in codes:
        if len(c) <= k:
            continue
        key = np.zeros(len(c) - k, dtype=np.int64)
        for i in range(k + 1):
            key = key * width + c[i : len(c) - k + i]
        packed.append(key)
    return np.unique(np.concatenate(packed), return_counts=True) if packed else (np.empty(0, np.int64), np.empty(0, np.int64))


def train(samples: dict[str, list[bytes]], order: int = ORDER) -> Model:
    languages = sorted(samples)
    seen = np.zeros(256, dtype=bool)
    for texts in samples.values():
        for t in texts:
            seen[np.frombuffer(t, dtype=np.uint8)] = True
    known = np.flatnonzero(seen)
    rare = len(known)  # the class of bytes that were never seen
    width = rare + 1
    classes = np.full(256, rare, dtype=np.int64)
    classes[known] = np.arange(rare)
    grams = {lang: [_counts([classes[np.frombuffer(t, dtype=np.uint8)] for t in samples[lang]], k, width) for k in range(order + 1)] for lang in languages}
    # A context of any language; its shorter suffixes are contexts too.
    kept = [np.array([0], dtype=np.int64)]
    for k in range(1, order + 1):
        own = np.unique(np.concatenate([g[k][0] // width for g in grams.values()]))
        kept.append(own[np.isin(own % width ** (k - 1), kept[k - 1])])
    first = np.cumsum([0, *map(len, kept)])
    rows = int(first[-1])
    bits = np.empty((rows, width, len(languages)), dtype=np.float32)
    unseen = 256 - rare
    for at, lang in enumerate(languages):
        table = []
        for k in range(order + 1):
            key, n = grams[lang][k]
            row = np.searchsorted(kept[k], key // width)
            row[row == len(kept[k])] = 0
            ok = kept[k][row] == key // width if len(kept[k]) else np.zeros(len(key), bool)
            dense = np.zeros((len(kept[k]), width), dtype=np.float32)
            dense[row[ok], (key % width)[ok]] = n[ok]
            table.append(dense)
        for k in range(order + 1):
            cost = np.zeros((len(kept[k]), width))
            open_ = np.ones((len(kept[k]), width), dtype=bool)
            paid = np.zeros((len(kept[k]), 1))
            for j in range(k, -1, -1):
                row = np.searchsorted(kept[j], kept[k] % width**j)
                n = np.where(open_, table[j][row], 0.0)
                total, distinct = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
                here = n > 0
                with np.errstate(divide="ignore", invalid="ignore"):
                    cost = np.where(here, paid - np.log2(n / (total + distinct)), cost)
                    paid = np.where(total > 0, paid - np.log2(distinct / (total + distinct)), paid)
                open_ &= ~here
            # Uniform over what is left of the 256 bytes; the last class stands for all unseen ones.
            left = open_[:, :rare].sum(1, keepdims=True) + unseen
            with np.errstate(divide="ignore"):
                cost = np.where(open_, paid + np.log2(np.maximum(left, 1)), cost)
            bits[first[k] : first[k + 1], :, at] = cost
    # The longest known suffix of every possible context. Texts begin as if after unseen bytes.
    states = np.zeros(width**order, dtype=np.int32)
    every = np.arange(width**order, dtype=np.int64)
    for k in range(1, order + 1):
        if len(kept[k]):
            suffix = every % width**k
            row = np.searchsorted(kept[k], suffix)
            row[row == len(kept[k])] = 0
            states = np.where(kept[k][row] == suffix, first[k] + row, states).astype(np.int32)
    return Model(languages, classes.astype(np.int64), states, bits.reshape(rows * width, len(languages)), order)


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of each text under each language."""
    out = np.zeros((len(texts), len(model.languages)))
    width, order = model.width, model.order
    at = 0
    while at < len(texts):
        # Whole texts up to a piece's size, or one longer text alone, in pieces that overlap by the order.
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) <= PIECE):
            size += len(texts[upto])
            upto += 1
        if size <= PIECE:
            _add(model, texts[at:upto], out[at:upto])
        else:
            whole = texts[at]
            lead = np.full(order, width - 1, dtype=np.int64)
            for i in range(0, len(whole), PIECE):
                codes = model.classes[np.frombuffer(whole[i : i + PIECE], dtype=np.uint8)]
                _sum(model, np.concatenate([lead, codes]), [len(codes)], out[at : at + 1])
                lead = np.concatenate([lead, codes])[-order:] if order else lead
        at = upto
    return out


def _add(model: Model, texts: list[bytes], out: np.ndarray) -> None:
    # Between texts stand ``order`` bytes of the unseen class, so no context reaches into the text before.
    gap = model.order
    lengths = [len(t) for t in texts]
    codes = np.full(sum(lengths) + gap * len(texts), model.width - 1, dtype=np.int64)
    flat = model.classes[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    starts = np.repeat(np.arange(1, len(texts) + 1) * gap, lengths)
    codes[np.arange(len(flat)) + starts] = flat
    _sum(model, codes, lengths, out)


def _sum(model: Model, codes: np.ndarray, lengths: list[int], out: np.ndarray) -> None:
    order, width = model.order, model.width
    n = len(codes) - order
    if n <= 0:
        return
    context = np.zeros(n, dtype=np.int64)
    for i in range(order):
        context *= width
        context += codes[i : n + i]
    cost = model.bits[model.states[context].astype(np.int64) * width + codes[order:]]
    edges, at = [], 0
    for length in lengths:
        edges += [at, at + length]
        at += length + order
    sums = np.add.reduceat(np.concatenate([cost, np.zeros((1, cost.shape[1]), cost.dtype)]).astype(np.float64), np.array(edges), axis=0)[::2]
    sums[np.array(lengths) == 0] = 0
    out += sums


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, longest: int = LONGEST, most_languages: int = MOST_LANGUAGES) -> dict[str, list[bytes]]:
    """The training sample of (doc_id, text, lang), the same at every run.

    Hashes are uniform, so rows of a language whose hash lies within twice the wanted share of its usable rows hold
    the smallest ones; only these are ranked, over hashes alone, and texts are fetched for the chosen ones.
    """
    labelled = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text", (F.length("text") <= longest).alias("whole"), F.xxhash64("doc_id", "text").alias("h"))
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("whole").cast("long")).alias("n_whole"))
    n = F.when(F.col("n_whole") > 0, F.col("n_whole")).otherwise(F.col("n"))
    share = counts.orderBy(F.desc("n"), "lang").limit(most_languages).select("lang", (F.col("n_whole") > 0).alias("whole"), F.ceil(F.lit(2.0 * per_language * _GRAIN) / n).alias("share"))
    share = F.broadcast(save(share, "languages"))  # most_languages rows at most
    near = labelled.join(share, ["lang", "whole"]).where(F.shiftrightunsigned("h", 44) < F.col("share")).select("lang", "h")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 1)))
    chosen = near.withColumn("k", rank).where(F.col("k") <= per_language).groupBy("lang", "h").agg(F.min("k").alias("k"))
    chosen = F.broadcast(save(chosen, "chosen"))  # per_language rows a language at most
    rows = labelled.join(chosen, ["lang", "h"]).select("lang", "h", "k", F.substring("text", 1, longest).alias("text")).dropDuplicates(["lang", "h"])
    out: dict[str, list[bytes]] = {}
    for row in rows.select("lang", "text", "k").orderBy("lang", "k").collect():
        out.setdefault(row["lang"], []).append(row["text"].encode())
    return out


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def annotate(docs: DataFrame, model: Model | None, guess: str = "lang_pred", score: str = "score") -> DataFrame:
    """The rows with their predicted language and its score, from the text alone."""
    if model is None:
        return docs.withColumn(guess, F.lit(UNKNOWN)).withColumn(score, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = np.array([*model.languages, UNKNOWN], dtype=object)
    columns = docs.columns

    def run(batches):
        own = shared.value
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            letters = np.fromiter((bool(t) and _LETTER.search(t) is not None for t in texts), dtype=bool, count=len(texts))
            bits = code_lengths(own, [t.encode() if ok else b"" for t, ok in zip(texts, letters)])
            best = bits.argmin(axis=1) if len(texts) else np.empty(0, int)
            more = bits - bits.min(axis=1, keepdims=True)
            share = 1 / np.exp2(-np.minimum(more, 1000)).sum(axis=1)
            found = [pa.array(names[np.where(letters, best, len(names) - 1)], pa.string()), pa.array(np.where(letters, share, 0.0))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*columns, guess, score])

    schema = T.StructType([*docs.schema.fields, T.StructField(guess, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of each row."""
    return annotate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).drop("text")


def fit(docs: DataFrame, **bounds) -> Model | None:
    """Model from the labelled rows that are not held out."""
    samples = sample(docs.where(~F.coalesce(is_held_out(F.col("doc_id")), F.lit(False))), **bounds)
    return train(samples) if samples else None


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs, fit(docs))
    return found.select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
