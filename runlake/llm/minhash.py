"""MinHash near-dedup with sequential Bayesian verification (operator 13).

Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a document's set holds its distinct ``size``-word shingles (64-bit hashes), or the
whole sequence if it has fewer words, or nothing. Two sets are linked if 100 * intersection >= percent * union.

1. *Equal sets* are one node (128-bit digest and size), however many documents share them.
2. *Signatures* of ``BANDS * ROWS`` minima. Nodes that agree in all rows of a band, and whose sizes allow a link, are candidates.
   At the threshold of 0.8 a pair is in no common band with a probability of 3e-6, at 0.85 of 7e-9. Bands take all 32 bits of the
   minima; for the comparison 16 of them are kept.
3. *Sequential verification*. The signatures of a candidate pair are compared in batches. After n minima with m equal ones the
   similarity has the posterior Beta(1 + m, 1 + n - m); a pair whose posterior probability of reaching the threshold is
   below ``MISS`` goes no further. The least m that goes on is computed once per batch (:func:`least_matches`).
4. *Survivors are verified exactly*, on their full sets, which are cut out of the texts once more for these nodes only.
5. *No pairs within a group.* Each round compares the nodes of a bucket with two hubs of the bucket, the first and the last in a
   random order of all nodes (so that buckets of one group share their hubs), and joins what is linked. Buckets whose nodes are all
   connected are done. After ``HUB_ROUNDS`` rounds the nodes of what is left open meet each other, but for pairs of one component and
   those whose sizes or sketches (:mod:`runlake.llm.sketches`) allow no link: this misses no link, and leaves out most pairs of a group
   whose members are alike, but not enough for a link. So every link between candidates is either tested, or connected already:
   components are those of all candidate pairs.

The miss probability concerns candidates that are wrongly dropped; a link is never wrong. Null or empty text: empty set, linked
with nothing. Rows that repeat a ``doc_id`` are one row each with their own set; the component carries the smallest ``doc_id`` of
its rows (nulls: a null only if it has no other), and ``kept`` is true for the rows with that id. Extra columns pass through
:func:`first_of_groups`, which keeps exactly one row of each component. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlake.llm.common import MIX_A, MIX_B, byte_words, columns_of, cut, documents, free_name, ids_and_texts, mixed, range_hashes, raw_text, slices, stored
from runlake.llm.components import components
from runlake.llm.sketches import open_pairs, sketch, sketch_lists

#: A pair at the threshold of 0.8 agrees in 33 % of the bands, and in none with (1 - 0.8^5)^32 = 3e-6.
BANDS, ROWS = 32, 5
#: Minima compared at a time, and the posterior probability below which a pair is dropped.
BATCH, MISS = 32, 1e-6
#: Rounds of comparing each bucket with two hubs before its remaining pairs are compared.
HUB_ROUNDS = 1
#: Sizes within this ratio are one class when the remaining pairs meet.
SIZE_STEP = 1.05

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_N = BANDS * ROWS
_FACTORS = mixed(np.arange(1, _N + 1, dtype=np.uint64) * MIX_A) | np.uint64(1)
_SHIFTS = mixed(np.arange(1, _N + 1, dtype=np.uint64) * MIX_B)


def shingle_sets(array: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes."""
    raw, offsets = raw_text(array)
    raw = _LOWER[raw]
    starts, ends, first = byte_words(raw, offsets)
    words = range_hashes(raw, starts, ends) if len(raw) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        windows = np.zeros(max(0, len(words) - size + 1), np.uint64)
        for k in range(size):
            windows = mixed(windows * MIX_B + words[k : k + len(windows)] + np.uint64(k + 1))
        for a, b in zip(first, first[1:], strict=False):
            if b - a >= size:
                yield np.unique(windows[a : b - size + 1])
            else:
                whole = np.full(1, b - a, np.uint64)
                for w in words[a:b]:
                    whole = mixed(whole * MIX_A + w)
                yield whole[: min(b - a, 1)]


def digest(shingles: np.ndarray) -> bytes:
    """128 bits that are equal for equal sets."""
    with np.errstate(over="ignore"):
        sums = [mixed(shingles + MIX_A).sum(dtype=np.uint64), mixed(shingles ^ MIX_B).sum(dtype=np.uint64)]
        return mixed(np.array([sums[0], sums[1] + np.uint64(len(shingles))])).tobytes()


def signature(shingles: np.ndarray) -> np.ndarray:
    """The 32-bit minima of a set under ``BANDS * ROWS`` hash functions (multiply and add, upper bits of an odd multiple)."""
    out = np.full(_N, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 2048):
            part = shingles[at : at + 2048]
            for k in range(0, _N, 32):
                hashed = (part[None, :] * _FACTORS[k : k + 32, None] + _SHIFTS[k : k + 32, None]) >> np.uint64(32)
                np.minimum(out[k : k + 32], hashed.min(axis=1).astype(np.uint32), out=out[k : k + 32])
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of each signature, with the number of the band in it."""
    rows = minima.reshape(-1, BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * MIX_B, rows.shape[:2])
        for k in range(ROWS):
            keys = mixed(keys * MIX_A + rows[:, :, k])
    return keys.view(np.int64)


@functools.cache
def least_matches(percent: int) -> np.ndarray:
    """For 0, BATCH, 2 * BATCH, ... compared minima: the least number of equal ones that goes on.

    P(similarity >= t) for Beta(1 + m, 1 + n - m) is the probability of at most m successes in n + 1 trials of probability t.
    """
    t = percent / 100
    out = [0]
    for n in range(BATCH, _N + 1, BATCH):
        term = [math.exp(math.lgamma(n + 2) - math.lgamma(j + 1) - math.lgamma(n + 2 - j) + j * math.log(t) + (n + 1 - j) * math.log1p(-t)) for j in range(n + 1)]
        out.append(int(np.searchsorted(np.cumsum(term), MISS)))
    return np.array(out)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text): the key tells apart texts of one repeated or missing ``doc_id``."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def set_rows(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_key, n, node, minima, bands, sketch) of every document; the last three once for each node of a task, else null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        for batch in slices(batches, 1 << 20):
            sizes, nodes, minima, sketches = [], [], [], []
            for found in shingle_sets(batch.column("text"), size):
                node = digest(found)
                new = len(found) > 0 and node not in known
                if new and len(known) < 1_000_000:  # beyond that a node may come twice, which changes nothing
                    known.add(node)
                sizes.append(len(found))
                nodes.append(node)
                minima.append(signature(found) if new else None)
                sketches.append(sketch(found) if new else None)
            there = [m is not None for m in minima]
            keys = band_keys(np.array([m for m in minima if m is not None], np.uint32))
            ends = np.cumsum([0, *there]) * BANDS
            bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel()), mask=pa.array([not t for t in there]))
            values = [pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array([None if m is None else m.astype(np.uint16).tobytes() for m in minima], pa.binary()), bands, sketch_lists(sketches)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *values], ["doc_id", "text_key", "n", "node", "minima", "bands", "sketch"])

    return keyed(docs).mapInArrow(work, "doc_id long, text_key long, n long, node binary, minima binary, bands array<long>, sketch array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(nr, shingles) of the wanted nodes (nr, node, doc_id, text_key)."""
    of = wanted.select("nr", "node", F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_key"))
    same = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_key") == F.col("of_key"))
    rows = keyed(docs).join(of, same).select("nr", "node", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            found = zip(batch.column("nr").to_pylist(), batch.column("node").to_pylist(), shingle_sets(batch.column("text"), size), strict=True)
            kept = [(nr, s) for nr, node, s in found if digest(s) == node]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array([nr for nr, _ in kept], pa.int64()), shingle_lists([s for _, s in kept])], ["nr", "shingles"])

    # rows repeated in full bring a set more than once
    return rows.mapInArrow(work, "nr long, shingles array<long>").groupBy("nr").agg(F.first("shingles").alias("shingles"))


def shingle_lists(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))


def promising(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, na, sa, b, nb, sb) that no batch of their signatures rules out, as (a, na, b, nb)."""
    least = least_matches(percent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = np.frombuffer(b"".join(batch.column("sa").to_pylist()), np.uint16).reshape(-1, _N)
            right = np.frombuffer(b"".join(batch.column("sb").to_pylist()), np.uint16).reshape(-1, _N)
            going, equal = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for k, at in enumerate(range(0, _N, BATCH), 1):
                equal = equal + (left[going, at : at + BATCH] == right[going, at : at + BATCH]).sum(axis=1)
                keep = equal >= least[k]
                going, equal = going[keep], equal[keep]
            yield batch.select(["a", "na", "b", "nb"]).take(pa.array(going))

    return pairs.select("a", "na", "sa", "b", "nb", "sb").mapInArrow(work, "a long, na long, b long, nb long")


def needed(percent: int):
    """The least intersection that links sets of sizes ``na`` and ``nb``."""
    return F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent))


def linked(pairs: DataFrame, signed: DataFrame, cut_sets, percent: int) -> DataFrame:
    """The linked ones of the pairs (a, na, b, nb) of node numbers, kept in the shared folder."""
    pairs = pairs.filter((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.col("a") < F.col("b"))).distinct()
    pairs = pairs.join(signed.select(F.col("nr").alias("a"), F.col("minima").alias("sa")), "a")
    pairs = pairs.join(signed.select(F.col("nr").alias("b"), F.col("minima").alias("sb")), "b")
    going = cut(promising(pairs, percent))
    sets = cut_sets(going.select(F.explode(F.array("a", "b")).alias("nr")).distinct())
    both = going.join(sets.select(F.col("nr").alias("a"), F.col("shingles").alias("xa")), "a")
    both = both.join(sets.select(F.col("nr").alias("b"), F.col("shingles").alias("xb")), "b")
    return cut(both.filter(F.size(F.array_intersect("xa", "xb")) >= needed(percent)).select("a", "b"))


def prefix_pairs(open_: DataFrame, cut_sets, percent: int) -> DataFrame:
    """The pairs (a, na, b, nb) of nodes of (band, nr, n, root) that may be linked and have other roots.

    In one order of all shingles, linked sets with an intersection of ``k`` or more share a shingle among the first ``na - k + 1`` of one
    and the first ``nb - k + 1`` of the other. Rare shingles come first, so members of a group that differ by more than a link allows
    meet only if they share some of what sets them apart from the group. Sets meet by size class, which tells ``k`` closely.
    """
    nodes = cut(open_.select("nr", "n", "root").distinct())
    each = nodes.join(cut_sets(nodes.select("nr")), "nr").select("nr", "n", "root", F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    shared = each.join(often, "shingle").groupBy("nr", "n", "root").agg(F.array_sort(F.collect_list(F.struct("times", "shingle"))).alias("shared"))
    # shingles of one node alone come before all others
    alone = (F.col("n") - F.size("shared")).cast("int")
    longest = (F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1).cast("int")
    heads = shared.select("nr", "n", "root", alone.alias("alone"), F.posexplode(F.slice("shared", F.lit(1), F.greatest(longest - alone, F.lit(0)))))
    heads = heads.select("nr", "n", "root", (F.col("alone") + F.col("pos") + 1).alias("rank"), F.col("col.shingle").alias("shingle"))
    heads = heads.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / math.log(SIZE_STEP)).cast("int"))

    n, steps = F.col("n").cast("double"), range(int(math.log(100 / percent) / math.log(SIZE_STEP)) + 2)

    def meeting(sign: int) -> DataFrame:
        """The heads once for each number of classes between smaller and larger set, as the smaller (1) or the larger (-1) one."""
        ways = []
        for d in steps:
            # the least size of a partner, with room for rounding
            least = F.pow(F.lit(SIZE_STEP), F.col("class") + sign * d) - 1e-6
            partner = F.greatest(n, least) if sign > 0 else F.greatest(n * percent / 100, least)
            room = n - F.ceil(F.lit(percent) * (n + partner) / (100 + percent) - 1e-6) + 1
            ways.append(F.when(F.col("rank") <= room, F.struct((F.col("class") + min(0, sign * d)).alias("low"), F.lit(d).alias("d"))))
        return heads.select("*", F.explode(F.filter(F.array(*ways), lambda w: w.isNotNull())).alias("way")).select("shingle", "way.*", "nr", "n", "root", "rank")

    small = meeting(1).select("shingle", "low", "d", F.col("nr").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), F.col("rank").alias("ka"))
    large = meeting(-1).select("shingle", "low", "d", F.col("nr").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), F.col("rank").alias("kb"))
    pairs = small.join(large, ["shingle", "low", "d"]).filter(
        ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))) & (F.col("ra") != F.col("rb"))
        & (F.col("ka") <= F.col("na") - needed(percent) + 1) & (F.col("kb") <= F.col("nb") - needed(percent) + 1)
    )
    first = F.col("a") < F.col("b")
    return pairs.select(
        F.least("a", "b").alias("a"), F.when(first, F.col("na")).otherwise(F.col("nb")).alias("na"),
        F.greatest("a", "b").alias("b"), F.when(first, F.col("nb")).otherwise(F.col("na")).alias("nb"),
    )


def joined(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """For (doc_id, text): doc_id, n_shingles, component_id, kept."""
    sets = stored(set_rows(docs, size), "sets")
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    firsts = F.min(one).alias("at"), *[F.first(c, ignorenulls=True).alias(c) for c in ("minima", "bands", "sketch")]
    # numbers of nodes: smaller to move than digests, and fixed once they are stored
    signed = sets.filter("n > 0").groupBy("n", "node").agg(*firsts).withColumn("nr", F.monotonically_increasing_id())
    signed = stored(signed.select("nr", "n", "node", "at.doc_id", "at.text_key", "minima", "bands", "sketch"), "nodes")
    nodes = signed.select("nr", "n", "node", "doc_id", "text_key")

    def cut_sets(wanted: DataFrame) -> DataFrame:
        return stored(sets_of(docs, cut(nodes.join(wanted, "nr", "left_semi")), size), "shingles")

    buckets = signed.select(F.explode("bands").alias("band"), "nr", "n")
    several = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    open_ = stored(buckets.join(several.select("band"), "band", "left_semi"), "buckets")
    links = None
    for round_ in range(HUB_ROUNDS):
        shuffled = F.struct(F.xxhash64("nr", F.lit(round_)).alias("at"), F.col("nr").alias("hub"), F.col("n").alias("hub_n"))
        hubs = open_.groupBy("band").agg(F.min(shuffled).alias("h1"), F.max(shuffled).alias("h2"))
        hubs = hubs.select("band", F.explode(F.array_distinct(F.array("h1", "h2"))).alias("h")).select("band", "h.hub", "h.hub_n")
        stars = open_.join(hubs, "band").filter("nr <> hub").select(
            F.least("nr", "hub").alias("a"), F.when(F.col("nr") < F.col("hub"), F.col("n")).otherwise(F.col("hub_n")).alias("na"),
            F.greatest("nr", "hub").alias("b"), F.when(F.col("nr") < F.col("hub"), F.col("hub_n")).otherwise(F.col("n")).alias("nb"),
        )
        found = linked(stars, signed, cut_sets, percent)
        links = found if links is None else links.unionByName(found)
        roots = components(links)
        placed = open_.select("band", "nr", "n").join(roots.withColumnRenamed("node", "nr"), "nr", "left").withColumn("root", F.coalesce("root", "nr"))
        # a hub has met its whole bucket: it need not be met again
        placed = placed.join(hubs.select("band", F.col("hub").alias("nr")), ["band", "nr"], "left_anti")
        spread = placed.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most")
        open_ = cut(placed.join(spread.select("band"), "band", "left_semi"))
        if open_.isEmpty():
            break
    else:
        # two nodes that share a bucket which is not open are connected, or one was its hub
        left = open_.join(signed.select("nr", "sketch", F.col("bands").alias("keys")), "nr").withColumn("rank", F.lit(1)).withColumnRenamed("nr", "node")
        links = links.unionByName(linked(open_pairs(left, "band", percent), signed, cut_sets, percent))
    roots = components(links)
    named = nodes.join(roots.withColumnRenamed("node", "nr"), "nr", "left").withColumn("root", F.coalesce("root", "nr"))
    firsts = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(firsts, "root").select("n", "node", "component_id")
    rows = sets.join(named, ["n", "node"], "left")
    # an empty set is its own component
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def first_of_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with exactly one row of each component: of the rows with its smallest ``doc_id`` the first by text; the columns of ``docs``."""
    names = {k: free_name(docs, k) for k in ("row", "key")}
    keyed = docs.select(*columns_of(docs), F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")).alias(names["key"]))
    keyed = stored(keyed.withColumn(names["row"], F.monotonically_increasing_id()), "keyed")
    # rows as ids, so that equal ids with other texts stay apart
    found = joined(keyed.select(F.col(names["row"]).alias("doc_id"), F.col("text").cast("string").alias("text")), size, percent)
    placed = keyed.select(F.col(names["row"]).alias("nr"), F.col(names["key"]).alias("key")).join(found.withColumnRenamed("doc_id", "nr"), "nr")
    # nulls last, and a group of copies is reduced in each task before its rows meet
    order = F.struct(F.col("key.doc_id").isNull().alias("none"), F.col("key.doc_id").alias("id"), F.coalesce("key.sha", F.lit("")).alias("sha"), F.col("nr").alias("nr"))
    kept = placed.groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.nr").alias(names["row"]))
    return keyed.join(kept, names["row"], "left_semi").select(*columns_of(docs))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(ids_and_texts(documents(spark, sf_dir)), 2, 80)


OP13_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
ids AS (SELECT g, dense_rank() OVER (ORDER BY g) AS t FROM (SELECT g FROM s GROUP BY g HAVING count(*) > 1)),
shared AS MATERIALIZED (SELECT doc_id, t, n FROM s JOIN ids USING (g) JOIN n USING (doc_id)),
o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS x, b.n AS y, count(*) AS k FROM shared a
  JOIN shared b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o WHERE 100 * k >= 80 * (x + y - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
