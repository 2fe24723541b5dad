"""Document fingerprints as homomorphic multiset hashes, in built-in functions only (operator 6).

A text is a multiset of pieces: it is cut at line feeds and after ``. ! ?`` followed by a blank (the blank stays with its
piece, so nothing of the text is lost). Every piece is hashed to ``LANES`` = 128 bits (MD5), taken as a vector of 128 zeros
and ones; the fingerprint is the number of pieces and the sum of their vectors, each lane in 32 bits (written out modulo 2^16). Hence

* equal texts, and texts with the same pieces in another order, have equal fingerprints;
* the fingerprint of ``a + "\\n" + b`` is the lane-wise sum of both (:func:`combined`), and a piece is taken out again by
  subtraction, without the rest of the text;
* the likeness of two texts is estimated from their fingerprints alone: with lanes centred (``2 * sum - pieces``) every
  piece is a random ±1 vector, so the cosine of two sums estimates the share of common pieces (error about 1/sqrt(128)).

Null text counts as empty: one empty piece. Repeated rows each get their row; the next document after a repeated ``doc_id``
follows the order (doc_id descending, then text ascending); a null ``doc_id`` comes last. A single document is its own next
one. No lane of a text overflows, as a text has less than 2^31 pieces; sums of several fingerprints are exact below 2^31 pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlake.llm.common import documents, ids_and_texts

LANES, WIDTH = 128, 1 << 32
#: Rows for which one range of ids is meant, and the most ranges.
RANGE_ROWS, MOST_RANGES = 2000, 2048


def pieces(text: Column) -> Column:
    """The pieces of a text, as an array of strings."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "([.!?]) ", "$1 \n"), "\n", -1)


def _word(piece: Column, half: int) -> Column:
    """Half of the piece's MD5 as a 64-bit integer."""
    digits = [F.conv(F.substring(F.md5(piece), start, 8), 16, 10).cast("long") for start in (16 * half + 1, 16 * half + 9)]
    return F.shiftleft(digits[0], 32).bitwiseOR(digits[1])


def fingerprint(text: Column) -> Column:
    """Struct of the piece count ``n`` and 64 ``sums`` of two packed 32-bit lanes each, made in one pass over the pieces.

    Sum ``32 * h + j`` has bits ``j + 32`` and ``j`` of word ``h`` of each piece.
    """
    every_32nd = F.lit(0x0000000100000001)
    words = F.transform(pieces(text), lambda p: F.struct(_word(p, 0).alias("hi"), _word(p, 1).alias("lo")))

    def counted(w: Column) -> Column:
        return F.array(F.lit(1).cast("long"), *[F.shiftrightunsigned(w[h], j).bitwiseAND(every_32nd) for h in ("hi", "lo") for j in range(32)])

    return F.aggregate(
        words,
        F.array_repeat(F.lit(0).cast("long"), 65),
        lambda total, w: F.zip_with(total, counted(w), lambda x, y: x + y),
        lambda total: F.struct(total[0].alias("n"), F.slice(total, 2, 64).alias("sums")),
    )


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of both multisets together, or of ``a`` without ``b`` (``sign=-1``)."""
    return F.struct((a["n"] + sign * b["n"]).alias("n"), F.zip_with(a["sums"], b["sums"], lambda x, y: x + sign * y).alias("sums"))


def as_hex(print_: Column) -> Column:
    """The piece count (8 hex digits) and the lanes modulo 2^16 (4 digits each; bits 48 + j, 32 + j, 16 + j and j of a word follow each other)."""
    count = F.lpad(F.lower(F.hex(print_["n"])), 8, "0")
    sums, low = print_["sums"], F.lit(0x0000FFFF0000FFFF)
    # sums j and j + 16 of a word: the upper one moves into the gaps of the lower one
    pairs = F.zip_with(F.concat(F.slice(sums, 17, 16), F.slice(sums, 49, 16)), F.concat(F.slice(sums, 1, 16), F.slice(sums, 33, 16)), lambda u, v: F.shiftleft(u.bitwiseAND(low), 16).bitwiseOR(v.bitwiseAND(low)))
    return F.concat(count, F.array_join(F.transform(pairs, lambda s: F.lpad(F.lower(F.hex(s)), 16, "0")), ""))


def lanes(print_: Column) -> Column:
    """The centred lanes of a fingerprint."""
    return F.flatten(
        F.transform(
            print_["sums"],
            lambda s: F.array(*[2 * F.shiftrightunsigned(s, 32 * i).bitwiseAND(F.lit(WIDTH - 1)) - print_["n"] for i in (1, 0)]),
        )
    )


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine of two arrays of centred lanes, from 0 to 1."""
    cosine = _dot(a, b).cast("double") / F.sqrt(norm_a.cast("double") * norm_b.cast("double"))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cosine, F.lit(0.0)))), 6)


def by_ranges(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` with the number of its id range as ``range_no``, and the highest id of each range that has rows.

    The ranges hold about ``RANGE_ROWS`` rows each (more if there would be over ``MOST_RANGES``).
    """
    ids = docs.select("doc_id")
    wanted = max(1, min(MOST_RANGES, ids.count() // RANGE_ROWS))
    shares = [i / wanted for i in range(1, wanted)]
    bounds = sorted(set(ids.agg(F.percentile_approx("doc_id", shares, 20 * MOST_RANGES)).first()[0] or [])) if shares else []
    edges = F.array(*[F.lit(int(b)).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    number = F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(edges, lambda b: b <= F.col("doc_id"))))
    tops = ids.withColumn("range_no", number).groupBy("range_no").agg(F.max("doc_id").alias("top_id"))
    return docs.withColumn("range_no", number), tops


def with_next(docs: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``docs`` (doc_id, text) with columns computed per document, and those of the next one as ``next_<name>``.

    Next is the following row by descending ``doc_id``; after the last comes the first. Each range of ids is one window; the
    first row of every range is also sent, as a guest, to the range before it. So each text moves once.
    """
    ranged, tops = by_ranges(docs)
    # one row per range: at most MOST_RANGES + 1, whatever the input
    follows = Window.orderBy(F.col("range_no").desc())
    goes_to = tops.select(
        "range_no", "top_id", F.coalesce(F.lag("range_no").over(follows), F.min("range_no").over(Window.partitionBy())).alias("host_no")
    )
    own = ranged.withColumn("guest", F.lit(0))
    guest = ranged.join(F.broadcast(goes_to.withColumnRenamed("range_no", "of_range")), F.expr("range_no = of_range AND doc_id <=> top_id"))
    rows = own.unionByName(guest.select("doc_id", "text", F.col("host_no").alias("range_no"), F.lit(1).alias("guest")))
    ready = rows.repartition("range_no").select("range_no", "guest", "doc_id", "text", *[c.alias(k) for k, c in columns.items()])
    order = Window.partitionBy("range_no").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    return ready.select("*", *[F.lead(k).over(order).alias(f"next_{k}") for k in columns]).filter("guest = 0").drop("guest", "range_no")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ids_and_texts(documents(spark, sf_dir)).withColumn("text", F.coalesce("text", F.lit("")))
    rows = with_next(docs, {"body": F.col("text"), "print": fingerprint(F.col("text"))})
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third), F.substring(F.col("next_body"), F.lit(1), third))
    rows = rows.withColumn("edited", edited).withColumn("edited_print", fingerprint(F.col("edited")))
    rows = rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_hex(F.col("print")).alias("fingerprint"),
        as_hex(F.col("edited_print")).alias("edited_fingerprint"),
        lanes(F.col("print")).alias("own"),
        lanes(F.col("edited_print")).alias("edit"),
        lanes(F.col("next_print")).alias("next"),
    )
    rows = rows.select("*", *[_dot(F.col(c), F.col(c)).alias(f"{c}_norm") for c in ("own", "edit", "next")])
    near = {"near_edited": "edit", "near_next": "next"}
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        *[likeness(F.col("own"), F.col(c), F.col("own_norm"), F.col(f"{c}_norm")).alias(k) for k, c in near.items()],
    )


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST, text) AS r, count(*) OVER () AS all_rows, doc_id, text
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
f AS (
  SELECT a.r, a.doc_id, a.text, length(a.text) AS n_chars, b.r AS next_r,
    substr(a.text, 1, length(a.text) - length(a.text) // 3) || substr(b.text, 1, length(a.text) // 3) AS edited
  FROM d a JOIN d b ON b.r = CASE WHEN a.r = a.all_rows THEN 1 ELSE a.r + 1 END),
p AS (SELECT r, 0 AS kind, text FROM f UNION ALL SELECT r, 1, edited FROM f),
q AS (
  SELECT r, kind, md5(unnest(string_split(regexp_replace(text, '([.!?]) ', '\1 ' || chr(10), 'g'), chr(10)))) AS h FROM p),
ws AS (
  SELECT r, kind, list(list_transform([1, 9, 17, 25], lambda s: ('0x' || substr(h, s, 8))::BIGINT)) AS ws, count(*) AS n
  FROM q GROUP BY r, kind),
sums AS (
  SELECT r, kind, n, list_transform(range(0, 128), lambda x: list_sum(list_transform(ws, lambda w:
      (w[2 * (x // 64) + CASE WHEN x % 4 < 2 THEN 1 ELSE 2 END] >> ((x % 64) // 4 + 16 * ((3 - x % 4) % 2))) & 1))::BIGINT) AS sums
  FROM ws),
fp AS (
  SELECT r, kind, format('{:08x}', n) || array_to_string(list_transform(sums, lambda x: format('{:04x}', x % 65536)), '') AS print,
    list_transform(sums, lambda x: 2 * x - n) AS v
  FROM sums),
three AS (
  SELECT f.doc_id, f.n_chars, sha256(f.edited) AS edited_sha256, a.print AS fingerprint, e.print AS edited_fingerprint,
    a.v AS v, e.v AS ve, b.v AS vb
  FROM f JOIN fp a ON a.r = f.r AND a.kind = 0 JOIN fp e ON e.r = f.r AND e.kind = 1 JOIN fp b ON b.r = f.next_r AND b.kind = 0)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
  round(greatest(0.0, least(1.0, list_dot_product(v, ve) / sqrt(list_dot_product(v, v)::DOUBLE * list_dot_product(ve, ve)::DOUBLE))), 6)::DOUBLE AS near_edited,
  round(greatest(0.0, least(1.0, list_dot_product(v, vb) / sqrt(list_dot_product(v, v)::DOUBLE * list_dot_product(vb, vb)::DOUBLE))), 6)::DOUBLE AS near_next
FROM (SELECT * REPLACE (v::DOUBLE[] AS v, ve::DOUBLE[] AS ve, vb::DOUBLE[] AS vb) FROM three)
"""
