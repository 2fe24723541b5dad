"""Bringing equal windows of all documents together, without comparing documents (shared by operators 3 and 4).

A text is a row of units (words or bytes); a window is ``size`` consecutive units. The *anchor* of a window is the gram (``gram``
units) with the smallest hash in it, so equal windows have equal anchors wherever they stand. Steps:

1. Every document sends its anchors, packed, to hash buckets. An anchor that only one document has is dropped: no window with
   it can repeat. The others get an *owner*, the smallest ``doc_id`` that has them.
2. The anchors go back to their documents, in the same packed form. A *region* is a longest run of windows whose anchors have
   the same owner; it is cut out with all units of its windows. Equal windows lie in regions of the same owner, so one shard
   (owners by hash) sees all of them. Long copies are one region, not one piece per anchor.
3. Equal regions are sent once per task and kept once per shard; where they occur goes another way, as rows.
4. An index of the shard finds for each window of its regions the smallest ``doc_id`` that has it. A shard of more than ``most``
   units (frequent anchors of one owner) is first dealt out again, each window by its anchor; pieces then stand for regions.
5. The answers join the occurrences: a window is *repeated* in a document if the smallest ``doc_id`` is below its own.

An anchor that more than ``hot`` documents have does not go to its owner's shard. Its windows are spread by their second
anchor (smallest under another hash) over shards of their own, numbered below 0, so that the contexts of a frequent line do not meet in
one task. Where such a shard has more than ``most`` units, its windows are dealt by a hash of the whole window.

Anchors travel as 32 bits beside their bucket. Two that are equal there count as one anchor in every step: more windows meet, none is
missed.

A null ``doc_id`` counts as larger than all others. Rows that repeat a ``doc_id`` do not repeat each other (neither id is smaller).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlake.llm.common import MIX_A, MIX_B, POLYNOMIAL, POLYNOMIAL_INVERSE, cut, give_back, mixed, powers, sliced, slices, stored

NO_ID = (1 << 63) - 1
HOT_DOCUMENTS = 20_000
#: Up to so many spans are sent to the documents by broadcast; more are joined.
BROADCAST_SPANS = 1_000_000
_PLACE_BITS = np.uint64(24)
_PLACE = np.uint64((1 << 24) - 1)


class Units:
    """How a text is read: :meth:`of` gives the units of all texts end to end and where each text starts, :meth:`grams` the hashes
    of the grams that start at each unit.

    ``size`` and ``gram`` are the units of a window and of a gram; ``shards`` is the number of shards for each shuffle partition, ``deals``
    that of the buckets that anchors and documents are dealt to, ``batch`` the bytes of text that are looked at together. Every bucket of
    anchors sends to every bucket of documents, so ``deals`` is kept small. ``most`` bounds the units that one index is made for (0: no bound).
    """

    size: int
    gram: int
    kind: np.dtype
    shards: int = 1
    deals: int = 2
    batch: int = 3 << 20
    most: int = 0

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def grams(self, units: np.ndarray) -> np.ndarray:
        raise NotImplementedError


def smallest(grams: np.ndarray, width: int) -> np.ndarray:
    """For each place, where the smallest of the ``width`` gram hashes from there on stands (the first of equal ones)."""
    keys = (grams & ~_PLACE) | (np.arange(len(grams), dtype=np.uint64) & _PLACE)
    step = 1
    while step * 2 <= width:
        keys = np.minimum(keys[:-step], keys[step:])
        step *= 2
    if width > step:
        keys = np.minimum(keys[: len(keys) - (width - step)], keys[width - step :])
    base = np.arange(len(keys), dtype=np.int64)
    return base + (((keys & _PLACE).astype(np.int64) - base) & int(_PLACE))


def anchored(units: np.ndarray, bounds: np.ndarray, how: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows within texts: where they start, their text's number, and their anchor hash."""
    if len(units) < how.size:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    grams = how.grams(units)
    at = smallest(grams, how.size - how.gram + 1)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(at)]
    starts = np.arange(len(at))
    inside = starts + how.size <= bounds[text + 1]
    starts = starts[inside]
    return starts, text[inside], grams[at[inside]]


def second_anchors(units: np.ndarray, starts: np.ndarray, how: Units) -> np.ndarray:
    other = mixed(how.grams(units) ^ MIX_B)
    return other[smallest(other, how.size - how.gram + 1)[starts]]


def first_of_runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def packed_by(number: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row per number with each column's values as bytes."""
    order = np.argsort(number, kind="stable")
    number = number[order]
    edges = first_of_runs(number)
    stops = [*edges[1:].tolist(), len(number)]
    out = [pa.array(number[edges].astype(np.int32))]
    for values in columns.values():
        values = values[order]
        out.append(pa.array([values[a:b].tobytes() for a, b in zip(edges.tolist(), stops, strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(out, ["bucket", *columns])


def together(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def lean(work: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """``work`` on a group, after which the worker gives back what it has freed."""

    def run(*tables: pa.Table) -> pa.Table:
        out = work(*tables)
        give_back()
        return out

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) as (row, doc, text): ``row`` identifies id and text together, ``doc`` is the id to compare."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(doc, text).alias("row"), doc.alias("doc"), text.alias("text"))


def short(anchors: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each anchor, and the 32 bits that it is known by there."""
    above, bucket = np.divmod(anchors, np.uint64(buckets))
    return bucket, above.astype(np.uint32)


def shared_anchors(rows: DataFrame, how: Units, buckets: int, hot: int) -> DataFrame:
    """Anchors of two or more documents, packed by bucket of their rows: row, anchor (its bucket above its 32 bits), owner (the hash of
    the owner, 0 if hot)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, how.batch):
            ids, docs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            units, bounds = how.of(batch.column(2))
            _, text, anchors = anchored(units, bounds, how)
            runs = first_of_runs(text, anchors)
            text, anchors = text[runs], anchors[runs]
            if len(runs):
                bucket, anchors = short(anchors, buckets)
                yield packed_by(bucket.astype(np.int64), {"rows": ids[text], "docs": docs[text], "anchors": anchors})

    def own(table: pa.Table) -> pa.Table:
        rows_, docs_ = together(table["rows"], np.int64), together(table["docs"], np.int64)
        anchors = together(table["anchors"], np.uint32)
        order = np.argsort(anchors, kind="stable")
        rows_, docs_, anchors = rows_[order], docs_[order], anchors[order]
        edges = first_of_runs(anchors)
        counts = np.diff([*edges, len(anchors)])
        low, high = np.minimum.reduceat(docs_, edges), np.maximum.reduceat(docs_, edges)
        owner = np.where(counts > hot, np.uint64(0), mixed(low.view(np.uint64) + MIX_A) | np.uint64(1))
        keep = np.repeat(low != high, counts)
        owner = np.repeat(owner, counts)[keep]
        rows_, anchors = rows_[keep], anchors[keep]
        if not len(rows_):
            return pa.table({k: pa.array([], t) for k, t in (("bucket", pa.int32()), ("rows", pa.binary()), ("anchors", pa.binary()), ("owners", pa.binary()))})
        by_row = np.argsort(rows_, kind="stable")  # equal rows and owners side by side pack well
        anchors = np.uint64(table["bucket"][0].as_py() << 32) | anchors
        number = rows_ % buckets  # as Spark's pmod
        return pa.Table.from_batches([packed_by(number[by_row], {"rows": rows_[by_row], "anchors": anchors[by_row], "owners": owner[by_row]})])

    sent = rows.mapInArrow(send, "bucket int, rows binary, docs binary, anchors binary")
    return sent.groupBy("bucket").applyInArrow(lambda table: lean(own)(table), "bucket int, rows binary, anchors binary, owners binary")


PIECES = "shard int, region long, row long, doc long, start long, n_units long, units binary"


def regions(rows: DataFrame, shared: DataFrame, how: Units, buckets: int, shards: int) -> DataFrame:
    """Regions of all rows (see the module): one row per occurrence (``units`` null), and one with ``units`` (``row`` null) per
    distinct region of a task, with the smallest ``doc`` that has it there."""
    dealt = rows.withColumn("bucket", F.expr(f"cast(pmod(row, {buckets}) as int)"))

    def cut_out(docs: pa.Table, anchors: pa.Table) -> pa.Table:
        from_rows, from_anchors = together(anchors["rows"], np.int64), together(anchors["anchors"], np.uint64)
        owners = together(anchors["owners"], np.uint64)
        seen: list[np.ndarray] = []
        firsts: list[np.ndarray] = []
        contents: list[bytes] = []
        if len(from_rows) and docs.num_rows:
            order = np.lexsort((from_anchors, from_rows))
            from_rows, from_anchors, owners = from_rows[order], from_anchors[order], owners[order]
            known = docs.filter(pc.is_in(docs["row"], value_set=pa.array(np.unique(from_rows)))).combine_chunks()
            for batch in chain.from_iterable(sliced(b, how.batch) for b in known.to_batches()):
                ids, doc = batch.column(batch.schema.get_field_index("row")).to_numpy(), batch.column(batch.schema.get_field_index("doc")).to_numpy()
                units, bounds = how.of(batch.column(batch.schema.get_field_index("text")))
                starts, text, a = anchored(units, bounds, how)
                heads = first_of_runs(text, a)  # windows side by side that have the same anchor
                bucket, bits = short(a[heads], buckets)
                key = bucket << np.uint64(32) | bits
                owner = np.zeros(len(heads), np.uint64)
                hot = np.zeros(len(heads), bool)
                lo, hi = np.searchsorted(from_rows, ids), np.searchsorted(from_rows, ids, side="right")
                first = np.searchsorted(text[heads], np.arange(len(ids) + 1))
                for i in range(len(ids)):
                    s = slice(first[i], first[i + 1])
                    have, belongs = from_anchors[lo[i] : hi[i]], owners[lo[i] : hi[i]]
                    if len(have) and s.stop > s.start:
                        place = np.minimum(np.searchsorted(have, key[s]), len(have) - 1)
                        hit = have[place] == key[s]
                        owner[s] = np.where(hit, belongs[place], 0)
                        hot[s] = hit & (belongs[place] == 0)
                windows = np.diff(np.append(heads, len(a)))
                owner, hot = np.repeat(owner, windows), np.repeat(hot, windows)
                if hot.any():
                    owner[hot] = mixed(a[hot] + second_anchors(units, starts, how)[hot] * MIX_A) | np.uint64(1)
                runs = first_of_runs(text, owner, hot)
                last = np.append(runs[1:], len(owner)) - 1
                runs, last = runs[owner[runs] != 0], last[owner[runs] != 0]
                if not len(runs):
                    continue
                begin, end, i = starts[runs], starts[last] + how.size, text[runs]
                name, shard = unit_range_hashes(units, begin, end).view(np.int64), ((owner[runs] >> np.uint64(1)) % np.uint64(shards)).astype(np.int64)
                shard = np.where(hot[runs], -1 - shard, shard)
                seen.append(np.stack([shard, name, ids[i], doc[i], begin - bounds[i], end - begin]))
                order = np.lexsort((doc[i], name, shard))
                once = order[first_of_runs(shard[order], name[order])]
                contents += [units[u:v].tobytes() for u, v in zip(begin[once].tolist(), end[once].tolist(), strict=True)]
                firsts.append(np.stack([shard[once], name[once], doc[i][once], (end - begin)[once]]))
        none = np.zeros((6, 0), np.int64)
        shard, name, row, doc, start, size = np.concatenate([none, *seen], axis=1)
        occurrences = [shard.astype(np.int32), name, row, doc, start, size]
        shard, name, doc, size = np.concatenate([none[:4], *firsts], axis=1)
        order = np.lexsort((doc, name, shard))
        once = order[first_of_runs(shard[order], name[order])]
        texts = [contents[k] for k in once.tolist()]
        kinds = [pa.int32(), *[pa.int64()] * 5, pa.binary()]
        names = [x.split()[0] for x in PIECES.split(", ")]
        first = [pa.array(c, k) for c, k in zip(occurrences, kinds, strict=False)] + [pa.nulls(len(row), pa.binary())]
        empty = pa.nulls(len(once), pa.int64())
        second = [pa.array(shard[once].astype(np.int32)), pa.array(name[once]), empty, pa.array(doc[once]), empty, pa.array(size[once]), pa.array(texts, pa.binary())]
        return pa.concat_tables([pa.table(first, names=names), pa.table(second, names=names)])

    return dealt.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(lambda docs, anchors: lean(cut_out)(docs, anchors), PIECES)


def unit_range_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of units, equal for equal contents."""
    n = len(units)
    with np.errstate(over="ignore"):
        terms = mixed(units.astype(np.uint64) + MIX_B) * powers(POLYNOMIAL, n)[:n]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
        return mixed((sums[ends] - sums[starts]) * powers(POLYNOMIAL_INVERSE, n)[starts] + (ends - starts).astype(np.uint64) * MIX_B)


#: A shard that is dealt out again makes about so many times the units, as neighbours come to several parts.
_OVERLAP = 3


def parted(contents: DataFrame, how: Units, heavy: dict[int, int]) -> tuple[DataFrame, DataFrame]:
    """The regions of the shards in ``heavy`` (by shard: units) dealt out so that a part has about ``how.most`` units.

    First the pieces of regions, the longest runs of windows of one part, as ``contents`` has regions: each once per task. Then where
    each piece starts in a region: piece, region, at.
    """
    of_shard = np.array(sorted(heavy), np.int64)
    parts = np.array([-(-_OVERLAP * heavy[k] // how.most) for k in of_shard.tolist()], np.uint64)

    def pieces(batches: Iterator[pa.RecordBatch], which: bool) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, how.batch >> 2, "units"):
            shard, region, doc = (batch.column(k).to_numpy() for k in (0, 2, 3))
            texts = batch.column(4).to_pylist()
            units = np.frombuffer(b"".join(texts), how.kind)
            bounds = np.cumsum([0, *map(len, texts)]) // how.kind.itemsize
            starts, text, key = anchored(units, bounds, how)
            hot = shard[text] < 0
            if hot.any():
                key[hot] = unit_range_hashes(units, starts[hot], starts[hot] + how.size)
            part = mixed(key + MIX_A) % parts[np.searchsorted(of_shard, shard)][text]
            runs = first_of_runs(text, part)
            begin, end, i = starts[runs], starts[np.append(runs[1:], len(text)) - 1] + how.size, text[runs]
            name = unit_range_hashes(units, begin, end).view(np.int64)
            if which:
                order = np.lexsort((doc[i], name))
                once = order[first_of_runs(name[order])]
                cut_out = [units[u:v].tobytes() for u, v in zip(begin[once].tolist(), end[once].tolist(), strict=True)]
                columns = [shard[i][once], part[runs][once].astype(np.int64), name[once], doc[i][once], pa.array(cut_out, pa.binary())]
            else:
                columns = [name, region[i], begin - bounds[i]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], batch.schema.names if which else ["piece", "region", "at"])

    dealt = contents.mapInArrow(lambda batches: pieces(batches, True), contents.schema)
    placed = contents.mapInArrow(lambda batches: pieces(batches, False), "piece long, region long, at long")
    return dealt, placed.dropDuplicates(["piece", "region", "at"])


def repeated_spans(rows: DataFrame, how: Units, least_docs: Callable, hot: int = HOT_DOCUMENTS) -> DataFrame:
    """For keyed rows: (row, spans), the units [start, stop) that lie in a window which a smaller ``doc_id`` also has.

    ``least_docs(contents, docs)`` is the index of a shard: for each region the smallest doc of each of its windows.
    """
    spark = rows.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = how.deals * partitions
    pieces = stored(regions(rows, shared_anchors(rows, how, buckets, hot), how, buckets, how.shards * partitions), "regions")

    def answer(table: pa.Table) -> pa.Table:
        names, docs = table["region"].to_numpy(), table["doc"].to_numpy()
        order = np.lexsort((docs, names))
        keep = order[first_of_runs(names[order])]  # equal regions of several tasks: the smallest doc
        contents = [np.frombuffer(table["units"][int(i)].as_py(), how.kind) for i in keep]
        edges, found = [0], []
        for least in least_docs(contents, docs[keep]):
            runs = first_of_runs(least)
            edges.append(edges[-1] + len(runs))
            found.append((runs, np.append(runs[1:], len(least)) - 1 + how.size, least[runs]))
        lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(c))) for c in zip(*found, strict=True)]
        return pa.table([pa.array(names[keep]), *lists], names=["region", "starts", "stops", "docs"])

    def answered(contents: DataFrame) -> DataFrame:
        return contents.groupBy("shard", "part").applyInArrow(lambda table: lean(answer)(table), "region long, starts array<bigint>, stops array<bigint>, docs array<bigint>")

    contents = pieces.filter("units IS NOT NULL").select("shard", F.lit(0).cast("long").alias("part"), "region", "doc", "units", "n_units")
    heavy: dict[int, int] = {}
    if how.most:
        loads = contents.groupBy("shard").agg(F.sum("n_units").alias("load")).filter(F.col("load") > how.most)
        heavy = {k: n for k, n in loads.collect()}
    contents = contents.drop("n_units")
    if heavy:
        apart = F.col("shard").isin(list(heavy))
        dealt, placed = parted(contents.filter(apart), how, heavy)
        of_pieces = answered(dealt).withColumnRenamed("region", "piece").join(placed, "piece")
        moved = [F.transform(c, lambda x: x + F.col("at")).alias(c) for c in ("starts", "stops")]
        answers = answered(contents.filter(~apart)).unionByName(of_pieces.select("region", *moved, "docs"))
    else:
        answers = answered(contents)
    found = pieces.filter("units IS NULL").select("region", "row", "doc", "start").join(answers, "region")
    spans = F.arrays_zip("starts", "stops", "docs")
    spans = F.filter(spans, lambda s: s["docs"] < F.col("doc"))
    spans = F.transform(spans, lambda s: F.struct((s["starts"] + F.col("start")).alias("start"), (s["stops"] + F.col("start")).alias("stop")))
    found = found.select("row", spans.alias("spans")).filter(F.size("spans") > 0)
    return found.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``rows`` with their ``spans`` (null: none)."""
    spans = cut(spans)
    few = (spans.agg(F.sum(F.size("spans"))).first()[0] or 0) <= BROADCAST_SPANS
    return rows.join(F.broadcast(spans) if few else spans, "row", "left")


def covered(n: int, spans: list | None) -> np.ndarray:
    """Which of ``n`` units lie in a span."""
    change = np.zeros(n + 1, np.int32)
    for s in spans or ():
        change[s["start"]] += 1
        change[s["stop"]] -= 1
    return np.cumsum(change[:-1]) > 0

