"""Token files: concatenated ids with Elias-Fano document boundaries (operator 8).

Documents are ordered by ``doc_id`` in range partitions; every task writes blocks of about ``BLOCK_IDS`` ids (one document is
never cut) as rows of a Parquet data set, so that Spark commits them, they survive a lost executor, and any file system
that Spark knows can hold them. A block has:

* ``part``, ``seq``: its place in the order of the corpus; ``n_docs``; ``n_ids``; ``part_start``, the ids of its part before it;
* ``n_null``, ``first_doc``, ``last_doc``, ``doc_low_bits``, ``doc_low``, ``doc_high``: how many documents have no ``doc_id`` (they stand
  first), the least and greatest ``doc_id``, and what each lies above the least, in Elias-Fano form;
* ``id_bytes`` 2 or 4 and ``ids``: all ids end to end, little-endian, in the least width that holds the vocabulary;
* ``low_bits``, ``low``, ``high``: the ends of the documents (running totals within the block) in Elias-Fano form. Of each
  end the ``low_bits`` lowest bits lie packed in ``low``; the rest is written in unary in ``high`` (bit ``(end >> low_bits) + i``
  is set for document ``i``). That takes about ``2 + log2(ids / docs)`` bits a document, where a table of offsets takes 64.

:class:`Ascending` selects one value, or those of a range of documents, from a sampled rank over ``high`` and unpacks nothing else.
:func:`read_tokens` and :func:`read_documents` (the documents with given ids) read both through it.

A string of a special token within a text gets the special token's id, as the library does without ``add_special_tokens``.

Null text counts as empty: its document holds the end id alone. A null ``doc_id`` comes first; repeated ones follow each other
by text. An empty table gives no block. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlake.llm.common import documents, fresh_path, ids_and_texts, slices

END_ID = 2
BLOCK_IDS = 1 << 20
#: Documents of a block that are read together.
READ_DOCS = 1000
#: The ids of a block's documents lie less than this apart.
DOC_RANGE = 1 << 62
#: Pieces whose ids a worker remembers.
MEMO_PIECES = 1_000_000

BLOCK = (
    "part int, seq int, n_docs int, n_ids long, part_start long, n_null int, first_doc long, last_doc long, "
    "doc_low_bits int, doc_low binary, doc_high binary, id_bytes int, ids binary, low_bits int, low binary, high binary"
)

#: A byte-level pre-tokeniser always cuts before a single blank between two other characters, between a Latin letter, full stop or
#: comma and what cannot continue it, and between a line feed and a letter if no white space stands before the line feed (of a run
#: of white space the last one is apart before a letter, but not at the end of a piece). So the pieces can be encoded one by one.
_OTHER_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BEFORE_BLANK = re.compile(r"(?<=\S)(?= \S)")
_CUT = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ɏ])(?=[\n.,])|(?<=[.,])(?=\n)|(?<=\S\n)(?=[A-Za-zÀ-ÖØ-öø-ɏ])")
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+")


def blanks_stand_alone(text: str) -> bool:
    """True if every blank has other characters than white space on both sides."""
    return not ("  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or _OTHER_SPACE.search(text))


class PieceEncoder:
    """Ids of texts by the tokenizers library; pieces that return are encoded once.

    ``after_blank`` remembers what stands behind a blank, up to the next one; ``inner`` all other pieces.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = [x.content for x in self.model.get_added_tokens_decoder().values()]
        self.id_bytes = 2 if self.model.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.id_bytes == 2 else "I"
        self.end = array(self.code, [END_ID]).tobytes()
        self.after_blank: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of each text, with the end id."""
        return [b"".join([*self.pieces_of(x), self.end]) if x else self.end for x in texts]

    def pieces_of(self, text: str) -> list[bytes]:
        if any(x in text for x in self.special):  # it also cuts the text around it
            return [array(self.code, self.model.encode(text, add_special_tokens=False).ids).tobytes()]
        if not blanks_stand_alone(text):
            return self.known([p for q in _BEFORE_BLANK.split(text) for p in _CUT.split(q)])
        first, *rest = text.split(" ")
        found = list(map(self.after_blank.get, rest))
        if None in found:
            new = self.learned({p for p, ids in zip(rest, found, strict=True) if ids is None})
            found = [new[p] if ids is None else ids for p, ids in zip(rest, found, strict=True)]
        return [*self.known(_CUT.split(first)), *found]

    def learned(self, missing: set[str]) -> dict[str, bytes]:
        """The ids of pieces behind a blank that are not remembered yet."""
        if len(self.after_blank) > MEMO_PIECES:
            self.after_blank.clear()
        parts = {p: _CUT.split(p) for p in missing}
        words = list({x[0] for x in parts.values() if x[0] not in self.after_blank and _LETTERS.fullmatch(x[0])})
        for start in range(0, len(words), 500):
            some = words[start : start + 500]
            found = self.model.encode(" " + " ".join(some), add_special_tokens=False)
            edges = np.searchsorted(found.word_ids, np.arange(len(some) + 1)).tolist()
            ids = array(self.code, found.ids)
            self.after_blank.update({p: ids[a:b].tobytes() for p, a, b in zip(some, edges, edges[1:], strict=False)})
        out = {}
        for piece, (head, *tail) in parts.items():
            begin = self.after_blank.get(head) if _LETTERS.fullmatch(head) else self.known([" " + head])[0]
            out[piece] = b"".join([begin, *self.known(tail)]) if tail else begin
        self.after_blank.update(out)
        return out

    def known(self, pieces: list[str]) -> list[bytes]:
        """The packed ids of each piece."""
        new = list({p for p in pieces if p not in self.inner})
        if new:
            if len(self.inner) > MEMO_PIECES:
                self.inner.clear()
                new = list(set(pieces))
            for piece, found in zip(new, self.model.encode_batch(new, add_special_tokens=False), strict=True):
                self.inner[piece] = array(self.code, found.ids).tobytes()
        return [self.inner[p] for p in pieces]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def elias_fano(ends: np.ndarray) -> tuple[int, bytes, bytes]:
    """Low bits a value, packed low parts, unary high parts of ascending values."""
    n, top = len(ends), int(ends[-1]) if len(ends) else 0
    low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
    low = (ends[:, None] >> np.arange(low_bits)) & 1
    high = np.zeros(n + (top >> low_bits) + 1, np.uint8)
    high[(ends >> low_bits) + np.arange(n)] = 1
    return low_bits, np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()


class Ascending:
    """Random access to ``n`` ascending values: the rank of every 64th byte of ``high`` is sampled in 32 bits."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes) -> None:
        self.n, self.low_bits, self.low, self.high = n, low_bits, np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        counts = np.bitwise_count(self.high)
        sums = np.add.reduceat(counts, np.arange(0, len(counts), 64), dtype=np.uint32) if len(counts) else np.zeros(0, np.uint32)
        self.ranks = np.concatenate([np.zeros(1, np.uint32), sums.cumsum(dtype=np.uint32)])

    def select_range(self, a: int, b: int) -> np.ndarray:
        """Values ``a`` to ``b - 1``, from the bytes between the sampled ranks round them."""
        if not 0 <= a <= b <= self.n:
            raise IndexError((a, b))
        if a == b:
            return np.zeros(0, np.int64)
        begin, end = (int(np.searchsorted(self.ranks, i, side="right")) - 1 for i in (a, b - 1))
        bits = np.unpackbits(self.high[64 * begin : 64 * (end + 1)], bitorder="little")
        ones = 512 * begin + np.flatnonzero(bits)[a - int(self.ranks[begin]) : b - int(self.ranks[begin])]
        start, stop = a * self.low_bits, b * self.low_bits
        low = np.unpackbits(self.low[start >> 3 : (stop + 7) >> 3], bitorder="little")[start & 7 :][: stop - start]
        low = low.reshape(b - a, self.low_bits).astype(np.int64)
        return ((ones - np.arange(a, b)) << self.low_bits) + low @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def select(self, i: int) -> int:
        return int(self.select_range(i, i + 1)[0])

    def spans(self, a: int, b: int) -> np.ndarray:
        """The edges of documents ``a`` to ``b - 1``: where ``a`` starts, and the end of each."""
        return self.select_range(a - 1, b) if a else np.concatenate([np.zeros(1, np.int64), self.select_range(0, b)])

    def first_not_below(self, value: int) -> int:
        """How many values are below ``value``, by binary search over selects."""
        lo, hi = 0, self.n
        while lo < hi:
            middle = (lo + hi) // 2
            lo, hi = (middle + 1, hi) if self.select(middle) < value else (lo, middle)
        return lo


def write_tokens(docs: DataFrame, path: str, tokenizer: str, block_ids: int = BLOCK_IDS) -> None:
    """Encode (doc_id, text) and write the blocks to ``path``."""
    ordered = ids_and_texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part, seq, written = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        ids: list[int] = []
        held: list[bytes] = []
        size = nulls = 0
        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        fields = [(name, kinds[kind]) for name, kind in map(str.split, BLOCK.split(", "))]

        def block() -> pa.RecordBatch:
            ends = np.cumsum([len(x) // model.id_bytes for x in held], dtype=np.int64)
            first, last = (ids[0], ids[-1]) if ids else (None, None)
            above = elias_fano(np.array([i - first for i in ids], np.int64))
            row = [part, seq, len(held), int(ends[-1]), written, nulls, first, last, *above, model.id_bytes, b"".join(held), *elias_fano(ends)]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, (_, k) in zip(row, fields, strict=True)], [name for name, _ in fields])

        for batch in slices(batches):
            for doc_id, packed in zip(batch.column(0).to_pylist(), model.encode(batch.column(1).to_pylist()), strict=True):
                if size >= block_ids or (ids and doc_id - ids[0] >= DOC_RANGE):
                    yield block()
                    seq, written = seq + 1, written + size
                    ids, held, size, nulls = [], [], 0, 0
                if doc_id is None:
                    nulls += 1
                else:
                    ids.append(doc_id)
                held.append(packed)
                size += len(packed) // model.id_bytes
        if held:
            yield block()

    ordered.mapInArrow(work, BLOCK).write.parquet(path)


class Block:
    """One block as its row gives it."""

    def __init__(self, row: dict) -> None:
        self.row, self.nulls = row, row["n_null"]
        self.ids = np.frombuffer(row["ids"], f"<u{row['id_bytes']}")
        self.ends = Ascending(row["n_docs"], row["low_bits"], row["low"], row["high"])
        self.above = Ascending(row["n_docs"] - self.nulls, row["doc_low_bits"], row["doc_low"], row["doc_high"])

    def documents(self, a: int, b: int) -> pa.RecordBatch:
        """Documents ``a`` to ``b - 1`` as rows of ``IN_PART``."""
        edges = self.ends.spans(a, b)
        packed = [self.ids[u:v].astype("<u4").tobytes() for u, v in zip(edges, edges[1:], strict=False)]
        known = self.above.select_range(max(0, a - self.nulls), max(0, b - self.nulls)) + (self.row["first_doc"] or 0)
        doc_ids = pa.concat_arrays([pa.nulls(b - a - len(known), pa.int64()), pa.array(known, pa.int64())])
        columns = [
            pa.array([self.row["part"]] * len(packed), pa.int32()), doc_ids, pa.array(edges[:-1] + self.row["part_start"]),
            pa.array(np.diff(edges)), pa.array(packed, pa.binary()), pa.array([zlib.crc32(x) for x in packed], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in IN_PART.split(", ")])


IN_PART = "part int, doc_id long, start_in_part long, n_tokens long, ids binary, ids_crc32 long"


def with_starts(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """``IN_PART`` rows with their start in the corpus; the totals of the parts, one row each, are added up for it."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids_of_part"))
    starts = totals.select("part", F.coalesce(F.sum("ids_of_part").over(before), F.lit(0)).alias("before_part"))
    rows = rows.join(F.broadcast(starts), "part")
    return rows.select("doc_id", (F.col("start_in_part") + F.col("before_part")).alias("start"), "n_tokens", "ids", "ids_crc32")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files at ``path``: doc_id, start (ids of all documents before it), n_tokens, ids (packed as
    32-bit integers), ids_crc32."""
    blocks = spark.read.schema(BLOCK).parquet(path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch.slice(i, 1).to_pylist()[0])
                for at in range(0, block.ends.n, READ_DOCS):
                    yield block.documents(at, min(at + READ_DOCS, block.ends.n))

    return with_starts(blocks.mapInArrow(work, IN_PART), blocks)


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of :func:`read_tokens` with these ids. Blocks without any of them are left out by the scan where Parquet's bounds
    tell; in the others a document is found by binary search and two selects."""
    blocks = spark.read.schema(BLOCK).parquet(path)
    asked = sorted(set(doc_ids))
    if not asked:
        return read_tokens(spark, path).limit(0)
    near = blocks.filter(F.col("first_doc").between(-(1 << 63), asked[-1]) & (F.col("last_doc") >= asked[0]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch.slice(i, 1).to_pylist()[0])
                first, last = block.row["first_doc"], block.row["last_doc"]
                for doc_id in asked[bisect_left(asked, first) : bisect_right(asked, last)]:
                    a, b = (block.nulls + block.above.first_not_below(doc_id - first + k) for k in (0, 1))
                    for at in range(a, b, READ_DOCS):
                        yield block.documents(at, min(at + READ_DOCS, b))

    return with_starts(near.mapInArrow(work, IN_PART), blocks)


def op8_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = fresh_path(spark, "token-files")
    write_tokens(documents(spark, sf_dir), path, tokenizer)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
