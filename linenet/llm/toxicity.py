"""Toxicity by non-negative positive-unlabelled learning.

A linear numpy classifier is fitted from confirmed toxic texts (P) and unlabelled ones (U) with the class-prior
corrected, non-negative risk  prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))  under the sigmoid loss. Features are the
presence of character n-grams of words (with word edges), chosen by how much more of P than of U has them. The sample
is bounded (`most_positive`, `most_unlabelled` of `fit`, least hash first); every whole text is scored, by one scan of
the text for the chosen n-grams.

Cases: null and empty texts get the score of a text without any n-gram; very long texts are scanned whole; a doc_id that
is null is never sampled; repeated rows (and ties, which are equal texts) score alike; without any confirmed toxic row
all scores are 0; an empty table gives an empty table; other columns are carried, whatever their names (`score`, `row`);
labels of held-out rows are never read; labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linenet.llm.common import lean, materialize, quoted, sliced, unpack

MOST_POSITIVE, MOST_UNLABELLED = 2_000, 4_000
FOLDS = 5
BITS, FEATURES, LENGTHS = 20, 1_024, (4, 5, 6)
STEPS, RATE, DECAY = 250, 0.05, 1e-4
WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> str:
    """Lower-case words, a blank around each."""
    return " " + " ".join(WORDS.findall((text or "").lower())) + " "


def grams_of(words: str) -> set[str]:
    """The n-grams of a text's distinct words, blanks at word edges included."""
    out: set[str] = set()
    for w in set(words.split()):
        w = f" {w} "
        for n in LENGTHS:
            out.update(w[i : i + n] for i in range(len(w) - n + 1))
    return out


def bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) & ((1 << BITS) - 1)


def held_out(ident: Column) -> Column:
    """Whether a row's label is withheld: crc32 of the identifier as text, by folds (a null identifier: withheld)."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


@dataclass
class Model:
    """n-grams with the column (their bucket's) of each, and the columns' weights. A column counts once for a text, however
    many n-grams of its bucket the text has, as in fitting."""

    grams: list[str] = field(default_factory=list)
    columns: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -np.inf

    def scorer(self):
        """text -> score, by one pass of an automaton over the text."""
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for c, g in zip(self.columns.tolist(), self.grams, strict=True):
            automaton.add_word(g, c)
        if self.grams:
            automaton.make_automaton()
        weights, bias = self.weights, self.bias

        def score(text: str | None) -> float:
            found = sorted({i for _, i in automaton.iter(words_of(text))}) if self.grams and text else []
            z = bias + float(weights[found].sum())
            return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

        return score


def fit_nnpu(x_p: np.ndarray, x_u: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE, decay: float = DECAY, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk (Adam, full batch). Where the corrected negative part falls
    below 0, its gradient is taken with the opposite sign, so that the model doesn't fit P as negatives of U."""
    d = x_p.shape[1]
    theta = np.zeros(d + 1)
    if start is not None:
        theta[:d] = start
    theta[d] = -1.0
    m, v = np.zeros(d + 1), np.zeros(d + 1)

    def slope(x, z, sign):
        """Gradient of the mean sigmoid loss 1 / (1 + exp(sign * z))."""
        loss = 1 / (1 + np.exp(np.clip(sign * z, -60, 60)))
        g = -sign * loss * (1 - loss) / len(z)
        return loss.mean(), np.append(g.astype(x.dtype) @ x, g.sum())

    for t in range(1, steps + 1):
        w = theta[:d].astype(x_p.dtype)
        z_p, z_u = x_p @ w + theta[d], x_u @ w + theta[d]
        _, g_pp = slope(x_p, z_p, 1.0)
        r_pn, g_pn = slope(x_p, z_p, -1.0)
        r_un, g_un = slope(x_u, z_u, -1.0)
        negative = g_un - prior * g_pn
        grad = prior * g_pp + negative if r_un - prior * r_pn >= 0 else -negative
        grad[:d] += decay * theta[:d]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:d], float(theta[d])


def _sample(docs: DataFrame, labels: DataFrame, text: str, ident: str, prior: float | None, most_positive: int, most_unlabelled: int) -> tuple[DataFrame | None, float]:
    """The texts to learn from (text, in_p, in_u: whether a confirmed toxic or an unlabelled row has it) and the prior."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if prior is None:
        prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    order = F.xxhash64(F.lit(7), "doc_id")
    ids = quoted(ident).cast("long").alias("doc_id")
    positive = [r.doc_id for r in known.where("toxic = 1").orderBy(order, "doc_id").limit(most_positive).collect()]
    if not positive or not prior:
        return None, 0.0
    unlabelled = [r.doc_id for r in docs.select(ids).where(~held_out(F.col("doc_id"))).orderBy(order, "doc_id").limit(most_unlabelled).collect()]
    roles = {i: 2 for i in unlabelled}
    for i in positive:
        roles[i] = roles.get(i, 0) | 1
    sample = F.broadcast(spark.createDataFrame(sorted(roles.items()), "doc_id long, role int"))  # bounded above
    rows = docs.select(ids, quoted(text).cast("string").alias("text")).join(sample, "doc_id")
    once = rows.groupBy(F.xxhash64("text").alias("mark")).agg(F.first("text").alias("text"), F.bit_or("role").alias("role"))  # copies of a text count once
    return materialize(once.select("text", ((F.col("role") % 2) == 1).alias("in_p"), (F.col("role") >= 2).alias("in_u")), "toxic-sample"), prior


def _columns(rows: DataFrame) -> tuple[list[int], np.ndarray]:
    """The buckets with the most information on P against U, FEATURES at most, and the logarithm of their ratio."""

    def buckets(batches):
        import pyarrow as pa

        for batch in sliced(batches, 50):
            sets = [sorted({bucket(g) for g in grams_of(words_of(t))}) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("in_p"), batch.column("in_u"), pa.array(sets, pa.list_(pa.int32()))], names=["in_p", "in_u", "buckets"])

    n_p, n_u = rows.agg(F.count_if("in_p"), F.count_if("in_u")).first()
    found = rows.mapInArrow(lean(buckets), "in_p boolean, in_u boolean, buckets array<int>").select("in_p", "in_u", F.explode("buckets").alias("bucket"))
    seen = found.groupBy("bucket").agg(F.count_if("in_p").alias("p"), F.count_if("in_u").alias("u"))
    rate = F.col("p") / max(1, n_p)
    ratio = F.log(rate / ((F.col("u") + 0.5) / (n_u + 1)))
    best = seen.where(F.col("p") >= max(2, 0.002 * n_p)).withColumn("ratio", ratio).withColumn("gain", rate * F.col("ratio"))
    best = best.where(F.col("ratio") > float(np.log(2))).orderBy(F.col("gain").desc(), "bucket").limit(FEATURES).collect()
    return [r.bucket for r in best], np.array([r.ratio for r in best])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id", prior: float | None = None, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Model:
    """Learns from labels of rows that aren't held out, and from a sample of at most `most_positive` confirmed toxic and
    `most_unlabelled` other rows. prior: by default the share of toxic rows among the labelled ones. The driver gets the
    sample's rows as FEATURES bits each, and no texts."""
    rows, prior = _sample(docs, labels, text, ident, prior, most_positive, most_unlabelled)
    if rows is None or rows.where("in_p").isEmpty():
        return Model()
    best, ratio = _columns(rows)
    column = {b: i for i, b in enumerate(best)}

    def bits(batches):
        import pyarrow as pa

        for batch in sliced(batches, 50):
            out, named = [], set()
            for t in batch.column("text").to_pylist():
                own = np.zeros(FEATURES, bool)
                for g in grams_of(words_of(t)):
                    if (c := column.get(bucket(g))) is not None:
                        own[c] = True
                        named.add((c, g))
                out.append(np.packbits(own).tobytes())
            grams = [sorted(named) if i == 0 else [] for i in range(len(out))]
            kind = pa.list_(pa.struct([("column", pa.int32()), ("gram", pa.string())]))
            grams = [[{"column": c, "gram": g} for c, g in x] for x in grams]
            yield pa.RecordBatch.from_arrays([batch.column("in_p"), batch.column("in_u"), pa.array(out, pa.binary()), pa.array(grams, kind)], names=["in_p", "in_u", "bits", "grams"])

    seen = materialize(rows.mapInArrow(lean(bits), "in_p boolean, in_u boolean, bits binary, grams array<struct<column:int,gram:string>>"), "toxic-bits")

    def matrix(role):
        got = sorted(bytes(r.bits) for r in seen.where(role).select("bits").collect())  # sorted: sums in one order, so reruns agree
        return np.unpackbits(np.frombuffer(b"".join(got), np.uint8)).reshape(-1, FEATURES)[:, : len(best)].astype(np.float32)

    weights, bias = fit_nnpu(matrix("in_p"), matrix("in_u"), prior, start=ratio * 0.05)
    named = sorted((r.gram, r["column"]) for r in seen.select(F.explode("grams").alias("g")).select("g.gram", "g.column").distinct().collect())
    return Model([g for g, _ in named], np.array([c for _, c in named], np.int64), weights, bias)


def scores(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, below: float = np.inf) -> DataFrame:
    """The columns `keep` of docs (all by default) in a struct `row`, with `score`, for rows that score less than `below`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES buckets' n-grams
    keep = docs.columns if keep is None else keep
    named = F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(keep)]).alias("row")
    inside = keep.index(text) if text in keep and docs.schema[text].dataType.simpleString() == "string" else None  # the row's own text, sent once
    rows = docs.select(named) if inside is not None else docs.select(named, quoted(text).cast("string").alias("text"))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        score = shared.value.scorer()
        for batch in sliced(batches, 200):
            row = batch.column("row")
            texts = row.field(f"c{inside}") if inside is not None else batch.column("text")
            found = pa.array([score(t.as_py()) for t in texts], pa.float64())
            out = pa.RecordBatch.from_arrays([row, found], names=["row", "score"])
            yield out if below == np.inf else out.filter(pc.less(found, below))

    found = rows.mapInArrow(lean(run), rows.select("row", F.lit(0.0).alias("score")).schema)
    return found.select(F.struct(*[F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(keep)]).alias("row"), "score")


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    narrow = docs.select(quoted(ident).alias("doc_id"), quoted(text).alias("text"))
    found = scores(narrow, fit(docs, labels, text, ident), keep=["doc_id"])
    ids = F.col("row").getField("doc_id")
    return found.select(ids.alias("doc_id"), held_out(ids).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """The rows of docs whose score is under 0.5."""
    return unpack(scores(docs, fit(docs, labels, text, ident), text, below=0.5), docs.columns)
