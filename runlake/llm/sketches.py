"""Sketches of sets of hashes that rule out links exactly, without the sets (shared by operators 2 and 13).

A sketch holds, for each of ``CELLS`` cells, whether the number of a set's hashes that fall into it is odd. Hashes that two sets share
change both sketches alike, so two sketches differ in no more cells than the two sets have hashes that the other one lacks. A pair
whose sketches differ in more cells than a link allows is none. Sets of up to about twice ``CELLS`` hashes that are not alike nearly
always are; of larger ones the sketch rules out less, never too much.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 512
#: Cells of a wide sketch, for a closer look at fewer pairs; :func:`folded` makes a sketch of it.
WIDE = 1024


def sketch(shingles: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """The sketch of a set of 64-bit hashes, as 64-bit integers."""
    odd = np.bincount((shingles & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(wide: Column) -> Column:
    """The sketch of the set that has this wide sketch."""
    n = CELLS // 64
    return F.array(*[wide[i].bitwiseXOR(wide[i + n]) for i in range(n)])


def sketch_lists(sketches: list[np.ndarray | None], cells: int = CELLS) -> pa.Array:
    """Sketches as lists; None as null."""
    there = [s is not None for s in sketches]
    ends = np.cumsum([0, *there]) * (cells // 64)
    values = np.concatenate([np.zeros(0, np.int64), *[s for s in sketches if s is not None]])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values), mask=pa.array([not t for t in there]))


def may_link(percent: int, na: Column, sa: Column, nb: Column, sb: Column, cells: int = CELLS) -> Column:
    """Whether sets of these sizes and sketches may have 100 * intersection >= percent * union."""
    least = F.ceil(F.lit(percent) * (na + nb) / F.lit(100 + percent))
    differ = sum((F.bit_count(sa[i].bitwiseXOR(sb[i])) for i in range(1, cells // 64)), F.bit_count(sa[0].bitwiseXOR(sb[0])))
    return differ <= na + nb - 2 * least


def open_pairs(open_: DataFrame, key: str, percent: int) -> DataFrame:
    """The pairs (a, na, b, nb) of (key, node, n, root, rank, sketch) with an equal key and other roots that may be linked.

    ``rank`` is the place of the key in an order of all keys of the node if linked sets always share a key among the first
    ``n - k + 1`` of both, ``k`` being the intersection that links them; else 1. With a column ``keys`` (all keys of the node) a pair
    is made once, by the first key that it shares. A shared key that is not in ``open_`` must then be one by which the pair was settled.
    """
    names = [c for c in ("node", "n", "root", "rank", "sketch", "keys") if c in open_.columns]
    a = open_.select(key, *[F.col(c).alias(f"{c}_a") for c in names])
    b = open_.select(key, *[F.col(c).alias(f"{c}_b") for c in names])
    na, nb = F.col("n_a"), F.col("n_b")
    least = F.ceil(F.lit(percent) * (na + nb) / F.lit(100 + percent))
    once = (F.array_intersect("keys_a", "keys_b")[0] == F.col(key)) if "keys" in names else F.lit(True)
    met = a.join(b, key).filter(
        (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & (100 * F.least(na, nb) >= percent * F.greatest(na, nb))
        & (F.col("rank_a") <= na - least + 1) & (F.col("rank_b") <= nb - least + 1) & may_link(percent, na, F.col("sketch_a"), nb, F.col("sketch_b"))
        & once
    )
    return met.select(F.col("node_a").alias("a"), na.alias("na"), F.col("node_b").alias("b"), nb.alias("nb"))
