"""Mixing documents to target domain weights by soft membership (operator 5).

1. The labelled documents give each text a domain: ``toxic``, else ``low`` (quality 0), else ``good``. A multinomial logistic
   regression on the presence of telling words and a few ratios of the text is fitted on about ``FIT_ROWS`` labelled rows of
   each domain at most (chosen by a hash of ``doc_id``; the only bounded sample here) and gives every document its domain
   posteriors. Telling are, for each domain, the ``WORDS`` words of the sample with the largest chi-squared statistic.
2. Rates ``0 <= r <= MOST_RATE`` (how often to take each document) start at 1 and are fitted so that the expected token totals of
   the domains, ``A_k = sum r * tokens * p_k``, meet the targets ``T``: least squares in ``A - T``, all domains by the same measure
   (tokens), by projected gradient. Every step is one aggregation over all documents to a vector of ``K`` numbers; the rates
   follow from these vectors in plain column expressions. The step length of a document is 1 over ``sum_k p_k S_k``, with ``S_k``
   the token share of domain k: the row sums of the Hessian in units of its tokens, so each step lowers the sum of squares, and
   documents of rare domains move as fast as those of common ones.
3. ``copies`` is the rate rounded up or down by a hash of ``doc_id``, so that totals hold in expectation.

Targets that cannot be met (a domain that is too rare for its share at the highest rate, or hardly told from another) are
approached as far as the bound allows, and the rest of the corpus is kept as it is; :func:`mixture_report` states the gap.

Null or empty text: no tokens, rate 0 and no copies. Null or repeated labels: nulls count as 0 for ``toxic`` and 1 for ``quality``;
of repeated ones the worst counts. With labels of one domain only, every document belongs to it; without any, to ``good``.
Repeated documents are rated alike, one by one. Extra columns pass through. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from runlake.llm.common import byte_words, columns_of, cut, documents, free_name, range_hashes, raw_text, slices, stored

DOMAINS = ("good", "low", "toxic")
#: Production targets: shares of the token total, which stays as it is.
SHARES = {"good": 0.95, "low": 0.05, "toxic": 0.0}
FIT_ROWS, WORDS, FIT_STEPS = 4000, 300, 40
#: No document is taken more often than this.
MOST_RATE = 4.0
#: Steps at most, and the change of the shares from one step to the next at which they end.
MOST_STEPS, TOLERANCE = 20, 2e-4
RATIOS = 5
#: Bytes of text that a task looks at together: words and their hashes need some 45 times as much memory.
SLICE = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>!")] = True
#: Words of the classifier: runs of letters, digits and bytes beyond ASCII.
_BETWEEN = np.array([not (chr(i).isalnum() or i >= 128) for i in range(256)])


def domain_labels(labels: DataFrame) -> DataFrame:
    worst = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"), F.min(F.coalesce("quality", F.lit(1))).alias("quality")
    )
    return worst.select(F.col("doc_id").cast("long").alias("label_id"), F.when(F.col("toxic") > 0, 2).when(F.col("quality") < 1, 1).otherwise(0).cast("double").alias("label"))


def present_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of each text, in lower case and as hashes: text numbers and hashes."""
    low = _LOWER[raw]
    starts, ends, first = byte_words(low, offsets, _BETWEEN)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    hashes = range_hashes(low, starts, ends)
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.append(True, (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1]))
    return text[new], hashes[new]


def features(texts: pa.Array, telling: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text, and its ratios and which of the (sorted) telling words it has."""
    raw, offsets = raw_text(texts)
    sizes = np.diff(offsets)
    tokens = np.diff(byte_words(raw, offsets)[2])
    out = np.zeros((len(sizes), RATIOS + len(telling)), np.float32)

    def counted(which: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(which))[offsets]) / np.maximum(sizes, 1)

    text, hashes = present_words(raw, offsets)
    out[:, 0], out[:, 1], out[:, 2] = counted(_SYMBOLS[raw]), counted((raw >= 65) & (raw <= 90)), counted(raw == 10)
    out[:, 3] = np.bincount(text, minlength=len(sizes)) / np.maximum(tokens, 1)
    out[:, 4] = sizes / np.maximum(tokens, 1) / 10
    if len(telling) and len(hashes):
        place = np.minimum(np.searchsorted(telling, hashes), len(telling) - 1)
        hit = telling[place] == hashes
        out[text[hit], RATIOS + place[hit]] = 1
    return tokens, out


def telling_words(sample: DataFrame, counts: dict[int, int]) -> np.ndarray:
    """For each domain the ``WORDS`` words of (text, label) whose presence says most about it, as sorted hashes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            text, hashes = present_words(*raw_text(batch.column(0)))
            labels = batch.column(1).to_numpy()[text].astype(np.int64)
            order = np.lexsort((labels, hashes))
            hashes, labels = hashes[order], labels[order]
            new = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (labels[1:] != labels[:-1]))) if len(hashes) else np.zeros(0, np.int64)
            n = np.diff(np.append(new, len(hashes)))
            yield pa.RecordBatch.from_arrays([pa.array(hashes[new].view(np.int64)), pa.array(labels[new]), pa.array(n)], ["word", "label", "n"])

    found = sample.select("text", "label").mapInArrow(count, "word long, label long, n long")
    per_word = found.groupBy("word").agg(F.sum("n").alias("docs"), *[F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(f"in_{k}") for k in counts])
    per_word = cut(per_word.filter("docs >= 3"))
    n = sum(counts.values())
    chosen: set[int] = set()
    for k, n_k in counts.items():
        inside, outside = F.col(f"in_{k}"), F.col("docs") - F.col(f"in_{k}")
        gap = inside / n_k - outside / (n - n_k)
        score = gap * gap / (F.col("docs") / n * (1.0001 - F.col("docs") / n))
        chosen |= {r["word"] for r in per_word.orderBy(score.desc(), "word").limit(WORDS).select("word").collect()}
    return np.sort(np.array(sorted(chosen), np.int64).view(np.uint64))


def posteriors(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` (row, doc_id, text) as (row, n_tokens, p): ``p`` are the posteriors in the order of ``DOMAINS``."""
    ids = rows.select(F.col("doc_id").alias("label_id")).distinct()
    known = cut(domain_labels(labels).join(ids, "label_id"))
    counts = {int(r["label"]): r["count"] for r in known.groupBy("label").count().collect()}
    telling, weights, bias = np.zeros(0, np.uint64), np.zeros((len(DOMAINS), RATIOS)), np.full(len(DOMAINS), -1e9)
    bias[list(counts) or [0]] = 0.0
    if len(counts) > 1:
        position = F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) / 1e6
        wanted = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (float(k), FIT_ROWS / n)])
        chosen = known.filter(position < F.element_at(wanted, F.col("label")))
        # at most about FIT_ROWS labels of each domain: a bounded table
        sample = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("text", "label")
        sample = stored(sample.repartition(12), "sample")
        taken = {int(r["label"]): r["count"] for r in sample.groupBy("label").count().collect()}
        if len(taken) > 1:
            telling = telling_words(sample, taken)
            weights, bias = fitted(sample, telling)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            tokens, x = features(batch.column(1), telling)
            logits = x.astype(np.float64) @ weights.T + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), lists], ["row", "n_tokens", "p"])

    schema = StructType([rows.schema["row"], StructField("n_tokens", LongType()), StructField("p", ArrayType(DoubleType()))])
    return rows.select("row", "text").mapInArrow(score, schema)


def fitted(sample: DataFrame, telling: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of the domains by multinomial logistic regression on (text, label)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            x = features(batch.column(0), telling)[1].astype(np.float64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([lists, batch.column(1)], ["x", "label"])

    vectors = sample.select("text", "label").mapInArrow(measure, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label")
    model = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=FIT_STEPS).fit(vectors)
    weights, bias = np.zeros((len(DOMAINS), RATIOS + len(telling))), np.full(len(DOMAINS), -1e9)
    weights[: model.numClasses], bias[: model.numClasses] = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    return weights, bias


def rate_of(steps: list[np.ndarray], p: list[Column], shares: np.ndarray, most: float = MOST_RATE) -> Column:
    """The rate after the given steps from 1, in a corpus with these token shares of the domains."""
    if not steps:
        return F.lit(1.0)
    # one expression over a table of steps: nested ones would make the plan longer with every step
    table = F.array(*[F.array(*[F.lit(float(x)) for x in step]) for step in steps])
    length = F.greatest(sum(float(s) * q for s, q in zip(shares, p, strict=True)), F.lit(1e-12))

    def moved(rate: Column, step: Column) -> Column:
        slope = sum(step[i] * q for i, q in enumerate(p))
        return F.greatest(F.lit(0.0), F.least(F.lit(float(most)), rate - slope / length))

    return F.aggregate(table, F.lit(1.0), moved)


def fitted_steps(rows: DataFrame, targets: list[float], most: float = MOST_RATE) -> tuple[list[np.ndarray], np.ndarray]:
    """The steps of the rates for (n_tokens, p) towards the target totals, each one aggregation to K numbers, and the token shares."""
    k = range(len(targets))
    p, n = [F.col("p")[i] for i in k], F.col("n_tokens").cast("double")
    tokens = np.array(rows.agg(*[F.coalesce(F.sum(n * p[i]), F.lit(0.0)) for i in k]).first(), float)
    total = float(tokens.sum())
    if not total:
        return [], np.zeros(len(targets))
    shares, steps = tokens / total, []
    miss = shares - np.array(targets) / total
    while len(steps) < MOST_STEPS:
        steps.append(miss)
        rate = rate_of(steps, p, shares, most)
        last, miss = miss, np.array(rows.agg(*[F.sum(rate * n * p[i]) for i in k]).first(), float) / total - np.array(targets) / total
        # met, or as near as the bounds allow
        if np.abs(miss).max() < TOLERANCE or np.abs(miss - last).max() < TOLERANCE:
            break
    return steps, shares


def mixed_to(docs: DataFrame, labels: DataFrame, shares: dict[str, float] | None = None, most: float = MOST_RATE) -> DataFrame:
    """``docs`` with a struct ``mix`` (``mix_`` if there is such a column): n_tokens, p (by domain), rate, copies. ``shares`` are target shares of the token total."""
    shares = SHARES if shares is None else shares
    rows = docs.select(F.struct(*columns_of(docs)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = stored(posteriors(rows, labels).withColumn("key", F.col("row.doc_id")), "posteriors")
    total = scored.agg(F.sum("n_tokens")).first()[0] or 0
    steps, have = fitted_steps(scored.select("n_tokens", "p"), [shares.get(d, 0.0) * total for d in DOMAINS], most)
    rate = F.when(F.col("n_tokens") == 0, 0.0).otherwise(F.round(rate_of(steps, [F.col("p")[i] for i in range(len(DOMAINS))], have, most), 6))
    part = F.pmod(F.xxhash64(F.lit(5), "key"), F.lit(1_000_000)) / 1e6
    p = F.struct(*[F.round(F.col("p")[i], 6).alias(d) for i, d in enumerate(DOMAINS)]).alias("p")
    # the rate first: in one select its ``p`` would be taken for the new struct
    rows = scored.withColumn("rate", rate).select("row", "n_tokens", p, "rate", part.alias("part"))
    copies = (F.floor("rate") + (F.col("part") < F.col("rate") - F.floor("rate")).cast("long")).cast("long")
    return rows.select("row.*", F.struct("n_tokens", "p", "rate", copies.alias("copies")).alias(free_name(docs, "mix")))


def mixture_report(mixed: DataFrame, shares: dict[str, float] | None = None, name: str = "mix") -> DataFrame:
    """Per domain, of the rows of :func:`mixed_to`: tokens, target and expected tokens, and the gap that is left as a share of all tokens."""
    shares = SHARES if shares is None else shares
    mix = F.col(name)
    sums = [F.struct(F.lit(d).alias("domain"), F.sum(mix["n_tokens"] * mix["p"][d]).alias("tokens"), (F.lit(float(shares.get(d, 0.0))) * F.sum(mix["n_tokens"])).alias("target"),
                     F.sum(mix["rate"] * mix["n_tokens"] * mix["p"][d]).alias("expected"), F.sum(mix["n_tokens"]).alias("all")) for d in DOMAINS]
    found = mixed.agg(F.array(*sums).alias("rows")).select(F.inline("rows"))
    return found.select("domain", "tokens", "target", "expected", ((F.col("expected") - F.col("target")) / F.col("all")).alias("gap"))


def taken(docs: DataFrame, labels: DataFrame, shares: dict[str, float] | None = None, most: float = MOST_RATE) -> DataFrame:
    """``docs`` mixed: every row as often as its ``copies`` says; same columns."""
    copies = F.col(f"{free_name(docs, 'mix')}.copies")
    rows = mixed_to(docs, labels, shares, most).filter(copies > 0)
    row = F.struct(*columns_of(docs)).alias("row")
    return rows.select(row, F.explode(F.sequence(F.lit(1).cast("long"), copies))).select("row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed_to(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rows.select("doc_id", "mix.n_tokens", *[F.col(f"mix.p.{d}").alias(f"p_{d}") for d in DOMAINS], "mix.rate", "mix.copies")
