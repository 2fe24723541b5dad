"""N-gram Jaccard join with vertical partitioning (operator 2).

Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a document's set holds its distinct ``size``-word shingles (64-bit hashes), or the
whole sequence if it has fewer words, or nothing. Two sets are linked if 100 * intersection >= percent * union.

1. *Global order.* Shingles are ordered by a frequency class, then by hash. The class comes from counters of ``2^CELL_BITS``
   hash cells, summed over all documents: a table of fixed size, whatever the corpus. Any such order gives the same result;
   this one puts frequent lines last, so that they hardly ever make two documents candidates.
2. *Equal sets* are one node (128-bit digest and size), however many documents share them.
3. *Candidates.* Linked sets share shingles among the first ``n - ceil(percent% n) + 1`` of their order. Prefix shingles of only one
   node, or of no other node of a size that may be linked, are dropped. A pair goes on if the shared ones and all that may follow them can still make up the needed overlap: what
   the set whose prefix ends first has in common beyond that end lies in its rest.
4. *Vertical partitioning.* The order is cut into fragments, and the sets of the nodes in such pairs are cut alike; the overlap of a
   pair is counted fragment by fragment and summed per pair.
5. *No pairs within a group.* First every node is compared with two hubs of each of its prefix shingles (the least
   node and a random one), which joins most groups
   with a number of pairs linear in the nodes. Then the nodes of each prefix shingle whose nodes are still in several components
   meet once more. Links inside a component are not needed; a pair whose sizes, places of the shingle or sketches
   (:mod:`runlake.llm.sketches`) allow no link goes no further than the join. So every link that can still join anything is
   tested, and members of a group that differ by more than a link allows are no pairs.

Null or empty text: empty set, linked with nothing. Rows that repeat a ``doc_id`` are one row each with their own set; the
component carries the smallest ``doc_id`` of its rows. Extra columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlake.llm.common import MIX_A, MIX_B, byte_words, columns_of, cut, documents, free_name, ids_and_texts, mixed, range_hashes, raw_text, slices, stored
from runlake.llm.components import components
from runlake.llm.sketches import WIDE, folded, may_link, open_pairs, sketch, sketch_lists

CELL_BITS, CLASS_SHIFT, FRAGMENT_SHIFT = 20, 57, 54
LIGHT_FRAGMENTS = 1 << (CLASS_SHIFT - FRAGMENT_SHIFT)
#: Bytes of text that a task shingles together: it needs some 45 times as much memory for them.
SLICE = 1 << 19
#: Up to so many node ids, or candidate pairs, are broadcast to their documents or fragments; more are joined.
BROADCAST_NODES = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(array: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes."""
    raw, offsets = raw_text(array)
    raw = _LOWER[raw]
    starts, ends, first = byte_words(raw, offsets)
    words = range_hashes(raw, starts, ends) if len(raw) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
        for k in range(size):
            rolled = mixed(rolled * MIX_A + words[k : k + len(rolled)] + np.uint64(k + 1))
        for a, b in zip(first, first[1:], strict=False):
            if b - a >= size:
                yield np.unique(rolled[a : b - size + 1])
            elif b > a:
                short = np.uint64(b - a)
                for w in words[a:b]:
                    short = mixed(np.array([short * MIX_B + w]))[0]
                yield np.array([short])
            else:
                yield np.zeros(0, np.uint64)


def frequency_classes(docs: DataFrame, size: int) -> np.ndarray:
    """The class of each hash cell: 0 for usual cells, else the rounded base-2 logarithm of its count over that of a usual cell."""
    cells = 1 << CELL_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, np.int64)
        for batch in slices(batches, SLICE):
            found = list(shingle_sets(batch.column(0), size))
            np.add.at(counts, (np.concatenate(found) >> np.uint64(64 - CELL_BITS)).astype(np.int64), 1)
        total = int(counts.sum())
        # a cell that is frequent in the corpus is frequent in most tasks; usual ones are only summed up
        often = np.flatnonzero(counts >= max(8, 8 * total // cells))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *often.tolist()], pa.int32()), pa.array([total, *counts[often].tolist()], pa.int64())], ["cell", "n"])

    rows = docs.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).filter("cell = -1 OR n >= 64")
    classes = np.zeros(cells, np.uint8)
    found = rows.toPandas()  # at most one row per cell
    usual = max(1.0, float(found.n[found.cell == -1].sum()) / cells)
    heavy = found[found.cell >= 0]
    classes[heavy.cell.to_numpy()] = np.clip(np.log2(heavy.n.to_numpy() / usual), 0, 60).astype(np.uint8)
    return classes


def ordered(shingles: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Shingles as keys of the global order, sorted."""
    rank = classes[(shingles >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.uint64)
    # hash bits below the cell number as well, so that order within a class is random
    return np.sort((rank << np.uint64(CLASS_SHIFT)) | (mixed(shingles) >> np.uint64(64 - CLASS_SHIFT))).view(np.int64)


def digest(shingles: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        n = np.uint64(len(shingles))
        a = mixed(np.array([mixed(shingles).sum(dtype=np.uint64) + n * MIX_A]))
        b = mixed(np.array([mixed(shingles ^ MIX_B).sum(dtype=np.uint64) ^ n]))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def set_rows(docs: DataFrame, size: int, percent: int, classes) -> DataFrame:
    """(doc_id, text_key, n, node, check, last, prefix, sketch) of every document; text_key is a hash of its text, node and check are the
    digest of its set, last ends its prefix."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            n, node, check, last, prefix, sketches = [], [], [], [], [], []
            for found in shingle_sets(batch.column(1), size):
                a, b = digest(found)
                n.append(len(found))
                node.append(a)
                check.append(b)
                prefix.append(ordered(found, classes.value)[: len(found) - (percent * len(found) + 99) // 100 + 1 if len(found) else 0])
                last.append(int(prefix[-1][-1]) if len(found) else 0)
                sketches.append(sketch(found, WIDE) if len(found) else None)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefix)]), pa.int32()), pa.array(np.concatenate(prefix)))
            columns = [batch.column(0), batch.column(2), *[pa.array(x, pa.int64()) for x in (n, node, check, last)], lists, sketch_lists(sketches, WIDE)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n", "node", "check", "last", "prefix", "sketch"])

    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    return keyed.mapInArrow(work, "doc_id long, text_key long, n long, node long, check long, last long, prefix array<bigint>, sketch array<bigint>")


def fragments(docs: DataFrame, wanted: DataFrame, size: int, classes) -> DataFrame:
    """The sets of the wanted nodes, cut along the global order: (node, fragment, shingles). ``wanted``: doc_id, node."""
    if wanted.count() <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    rows = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("of_doc"))).select("node", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            nodes, numbers, parts = [], [], []
            for node, found in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), size), strict=True):
                if digest(found)[0] != node:
                    continue  # another text under a repeated doc_id
                keys = ordered(found, classes.value)
                number = np.minimum(keys >> FRAGMENT_SHIFT, LIGHT_FRAGMENTS)
                for part in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(number)) + 1):
                    nodes.append(node)
                    numbers.append(int(number[part[0]]))
                    parts.append(keys[part])
            if nodes:
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(numbers, pa.int32()), lists], ["node", "fragment", "shingles"])

    return rows.mapInArrow(work, "node long, fragment int, shingles array<bigint>")


def of_like_sizes(kept: DataFrame, percent: int) -> DataFrame:
    """The rows (shingle, node, n, ...) whose shingle another node has too, of a size that may allow a link.

    Such sizes are in the same class or in neighbouring ones; a class is a little wider than the ratio that a link allows.
    """
    step = math.log(100 / percent) + 1e-6
    kept = kept.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / step))
    near = kept.select("shingle", "node", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class"))
    near = near.groupBy("shingle", "class").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most")
    return kept.join(near.select("shingle", "class"), ["shingle", "class"], "left_semi").drop("class")


def needed(percent: int):
    """The least overlap that links sets of sizes ``na`` and ``nb``: ceil(percent * (na + nb) / (100 + percent))."""
    return F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent))


def linked(pairs: DataFrame, shared: DataFrame, cut_sets, percent: int) -> DataFrame:
    """The pairs (a, na, b, nb) that are linked, kept in the shared folder. ``shared``: (node, last, prefix, sketch) with the shared
    prefix shingles of each node; ``cut_sets`` gives the fragments of given nodes."""
    pairs = pairs.filter((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.col("a") != F.col("b"))).distinct()
    heads = pairs.join(shared.select(F.col("node").alias("a"), F.col("last").alias("la"), F.col("prefix").alias("pa"), F.col("sketch").alias("ha")), "a")
    heads = heads.join(shared.select(F.col("node").alias("b"), F.col("last").alias("lb"), F.col("prefix").alias("pb"), F.col("sketch").alias("hb")), "b")
    heads = heads.filter(may_link(percent, F.col("na"), F.col("ha"), F.col("nb"), F.col("hb"), WIDE))
    rest = F.ceil(F.lit(percent) * F.when(F.col("la") <= F.col("lb"), F.col("na")).otherwise(F.col("nb")) / 100) - 1
    rest = F.when(F.col("la") == F.col("lb"), F.ceil(F.lit(percent) * F.least("na", "nb") / 100) - 1).otherwise(rest)
    heads = cut(heads.filter(F.size(F.array_intersect("pa", "pb")) + rest >= needed(percent)).select("a", "na", "b", "nb"))
    parts = cut_sets(heads.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    few = heads.count() <= BROADCAST_NODES
    left = (F.broadcast(heads) if few else heads).join(parts.select(F.col("node").alias("a"), "fragment", F.col("shingles").alias("sa")), "a")
    partial = left.join(parts.select(F.col("node").alias("b"), "fragment", F.col("shingles").alias("sb")), ["b", "fragment"])
    partial = partial.select("a", "b", "na", "nb", "fragment", F.size(F.array_intersect("sa", "sb")).cast("long").alias("overlap"))
    # one count per fragment, also where a repeated row brought its fragments twice
    partial = partial.groupBy("a", "b", "na", "nb", "fragment").agg(F.max("overlap").alias("overlap"))
    return cut(partial.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap")).filter(F.col("overlap") >= needed(percent)))


def joined(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """For (doc_id, text): doc_id, n_shingles, component_id, links_found (of the tested pairs those that link its set)."""
    return grouped(docs, size, percent).select("doc_id", "n_shingles", "component_id", "links_found")


def grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The columns of :func:`joined` with text_key and root, which is equal for the rows of a component (null: empty set)."""
    spark = docs.sparkSession
    classes = spark.sparkContext.broadcast(frequency_classes(docs, size))
    sets = stored(set_rows(docs, size, percent, classes), "sets")

    exploded = sets.filter("n > 0").select("node", "n", F.posexplode("prefix").alias("place", "shingle"))
    several = exploded.groupBy("shingle").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most")
    kept = exploded.join(several.select("shingle"), "shingle", "left_semi")
    kept = stored(kept.groupBy("shingle", "node").agg(F.min("n").alias("n"), F.min("place").alias("place")), "kept")
    kept = cut(of_like_sizes(kept, percent))
    ends = sets.filter("n > 0").groupBy("node").agg(F.min("last").alias("last"), F.first("sketch").alias("sketch"))
    shared = kept.groupBy("node").agg(F.min("n").alias("n"), F.collect_list("shingle").alias("prefix"))
    shared = stored(shared.join(ends, "node"), "shared")

    def cut_sets(nodes: DataFrame) -> DataFrame:
        of_node = sets.select("node", "doc_id").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("of_doc"))
        return stored(fragments(docs, cut(of_node), size, classes), "fragments")

    # the first node, and one that is another for each shingle, so that members of a group meet many of the others
    mixing = F.xxhash64("shingle", "node")
    hubs = kept.groupBy("shingle").agg(F.min("node").alias("least"), F.min(mixing).alias("m"))
    hubs = kept.join(hubs, "shingle").filter((F.col("node") == F.col("least")) | (mixing == F.col("m")))
    hubs = hubs.select("shingle", F.col("node").alias("hub"), F.col("n").alias("hub_n"))
    stars = kept.join(hubs, "shingle").filter((F.col("node") != F.col("hub")) & (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")))
    first = F.col("node") < F.col("hub")
    stars = stars.select(F.least("hub", "node").alias("a"), F.when(first, F.col("n")).otherwise(F.col("hub_n")).alias("na"),
                         F.greatest("hub", "node").alias("b"), F.when(first, F.col("hub_n")).otherwise(F.col("n")).alias("nb"))
    links = linked(stars, shared, cut_sets, percent)

    placed = kept.join(components(links), "node", "left").select("shingle", "node", "n", F.coalesce("root", "node").alias("root"), (F.col("place") + 1).alias("rank"))
    spread = placed.groupBy("shingle").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most")
    open_ = placed.join(spread.select("shingle"), "shingle", "left_semi").join(shared.select("node", folded(F.col("sketch")).alias("sketch")), "node")
    open_ = stored(open_, "open")
    cross = open_pairs(open_, "shingle", percent)
    links = links.unionByName(linked(cross, shared, cut_sets, percent))

    roots = components(links)
    counts = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    rows = sets.select("doc_id", "text_key", "n", "node", "check")
    classes_of = rows.filter("n > 0").groupBy("n", "node", "check").agg(F.min("doc_id").alias("first_doc"))
    named = classes_of.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = named.join(firsts, "root").join(counts, "node", "left")
    named = named.select("n", "node", "check", "root", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    return rows.join(named, ["n", "node", "check"], "left").select(
        "doc_id", "text_key", "root", F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links_found"),
    )


def first_of_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of linked ones; same columns.

    That row has the smallest ``doc_id`` (null: largest; of equal ones the text with the smallest hash). Rows equal in id and text are
    copies of each other like any others: one of them stays, the first by all its columns written as JSON. Rows without words
    are in no group and stay. What goes is sent to the documents, as it is usually the smaller part.
    """
    rows = grouped(ids_and_texts(docs), size, percent).filter("root IS NOT NULL")
    keys = rows.groupBy("doc_id", "text_key").agg(F.min("root").alias("root"), F.count("*").alias("copies"))
    top = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key")).alias("top")
    tops = keys.groupBy("root").agg(top, F.sum("copies").alias("members")).filter("members > 1")
    is_top = F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("text_key") == F.col("top.text_key"))
    doc, key = free_name(docs, "of_doc"), free_name(docs, "of_text")
    found = keys.join(tops, "root").withColumn("is_top", is_top).filter("copies > 1 OR NOT is_top")
    found = cut(found.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key), F.col("is_top").alias("again")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(key))

    once = docs.join(found.select(doc, key), same, "left_anti").select(*columns_of(docs))
    row = F.struct(*columns_of(docs))
    repeated = docs.join(found.filter("again").select(doc, key), same).groupBy(doc, key).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return once.unionByName(repeated.select("row.*"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(ids_and_texts(documents(spark, sf_dir)), 4, 85).select("doc_id", "n_shingles", "component_id")


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
ids AS (SELECT g, dense_rank() OVER (ORDER BY g) AS t FROM (SELECT g FROM s GROUP BY g HAVING count(*) > 1)),
shared AS MATERIALIZED (SELECT doc_id, t FROM s JOIN ids USING (g)),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shared a JOIN shared b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
