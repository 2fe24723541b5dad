"""SentencePiece encoding and decoding with a max-plus scan over giant documents (operator 7).

The model is a SentencePiece BPE model with byte fallback; only its pieces and scores are used, the merging is done here. Its
pieces never hold a word boundary (a blank after another character) inside, so a text falls into words. The new words of a
batch are merged together, one merge of each word a round, and a task remembers up to ``MEMO_WORDS`` of them.

Documents of more than ``CHUNK`` characters are cut into chunks anywhere, also within words, and encoded in parallel:

1. The *states* of a cut are the pieces that may cover its left side, with their ends. A row of pieces is the BPE encoding of
   its text exactly if every two neighbours are the encoding of their joined text. So encoding is a path problem: a step has
   weight 0 if both pieces are compatible and minus infinity if not. Every chunk yields the *transfer matrix* of the best weights
   from the states of its left cut to those of its right cut.
2. The matrices of a document are combined by max-plus products, which are associative, in a tree; on the way back down the tree
   the state at every cut is found (:func:`states_along`).
3. Knowing its two states, each chunk traces its own pieces back. The ids of the chunks are put together in order.

Only the chunks are stored: they carry the text, and the first one the other columns, so a giant text is written once.

Decoding joins the pieces (bytes by their pieces) and gives the text back: always the same text, but for a literal ``▁``, which the
model cannot tell from a blank. Null or empty text: no ids, decoded as the empty text. Repeated rows: one row each.
Extra columns pass through. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from runlake.llm.common import columns_of, cut, documents, fresh_path, free_name, give_back, slices

CHUNK = 8192
#: Words whose ids a task remembers, and the bytes of text that it looks at together.
MEMO_WORDS, BATCH = 150_000, 1 << 20
#: Longer words are traced, not merged.
LONG_WORD = 64
#: The states of up to so many chunks are broadcast to them; more are joined.
BROADCAST_CHUNKS = 1_000_000
BLANK = "▁"
_WORDS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
_BEGIN = re.compile(f"(?<=[^{BLANK}]){BLANK}")
NEVER = -np.inf


class PieceModel:
    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.vocab_size())]
        self.unknown = model.unk_id()
        self.byte_of = {i: int(names[i][3:5], 16) for i in range(len(names)) if model.is_byte(i)}
        self.of_byte = [0] * 256
        for i, b in self.byte_of.items():
            self.of_byte[b] = i
        usual = [i for i in range(len(names)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {names[i]: i for i in usual}
        self.names = names
        self.scores = {names[i]: model.get_score(i) for i in usual}
        self.longest = max(map(len, self.ids))
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("a piece holds a word boundary")
        self.words: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        # symbols are the pieces and the characters in them; a merge is looked up by both symbols
        symbols = {p: k for k, p in enumerate([*self.ids, *sorted(set("".join(self.ids)) - self.ids.keys())])}
        self.symbol_ids = np.array([self.ids.get(p, -1) for p in symbols], np.int64)
        self.symbol_points = np.array([ord(p) if len(p) == 1 else 0 for p in symbols], np.int64)
        self.characters = np.full(0x110000, -1, np.int32)
        for p, k in symbols.items():
            if len(p) == 1:
                self.characters[ord(p)] = k
        merges = sorted(
            (symbols[p[:i]] << 32 | symbols[p[i:]], k, self.scores[p])
            for p, k in symbols.items() if len(p) > 1 for i in range(1, len(p)) if p[:i] in symbols and p[i:] in symbols
        )
        # one more that no pair equals
        self.merge_keys = np.array([m[0] for m in merges] + [1 << 62], np.int64)
        self.merge_symbols = np.array([m[1] for m in merges] + [-1], np.int32)
        self.merge_scores = np.array([m[2] for m in merges] + [NEVER])

    def merged(self, text: str) -> list[str]:
        """The BPE encoding as pieces; characters without a piece stay alone. The best-scored, leftmost pair merges first."""
        parts, score = list(text), self.scores.get
        pairs = [score(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            best = max(pairs)
            if best == NEVER:
                break
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = score(parts[at - 1] + parts[at], NEVER)
            if at < len(pairs):
                pairs[at] = score(parts[at] + parts[at + 1], NEVER)
        return parts

    def compatible(self, left: str | None, right: str) -> bool:
        key = (left or "", right)
        known = self.pairs.get(key)
        if known is None:
            known = self.merged(key[0] + right) == ([left, right] if left else [right])
            if len(self.pairs) > MEMO_WORDS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def pack(self, parts: list[str]) -> bytes:
        out = array("I")
        for p in parts:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            else:
                out.extend(self.of_byte[b] for b in p.encode())
        return out.tobytes()

    def joins(self, symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The scores of the symbols at ``at`` merged with the next ones, and the symbols that they make."""
        left, right = symbols[at].astype(np.int64), symbols[at + 1].astype(np.int64)
        keys = left << 32 | right
        place = np.searchsorted(self.merge_keys, keys)
        place[(left < 0) | (right < 0)] = len(self.merge_keys) - 1
        place = np.where(self.merge_keys[place] == keys, place, len(self.merge_keys) - 1)
        return self.merge_scores[place], self.merge_symbols[place]

    def merged_together(self, words: list[str]) -> list[bytes]:
        """As :meth:`merged` and :meth:`pack` for each word; each round merges the best pair of every word."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        # characters without a symbol are negative
        symbols = self.characters[points]
        symbols = np.where(symbols < 0, -1 - points, symbols).astype(np.int32)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        last = np.append(word[1:] != word[:-1], True)
        scores, makes = np.full(len(word), NEVER), np.full(len(word), -1, np.int32)
        inner = np.flatnonzero(~last)
        scores[inner], makes[inner] = self.joins(symbols, inner)
        done = []
        while len(word):
            starts = np.flatnonzero(np.append(True, last[:-1]))
            sizes = np.diff(np.append(starts, len(word)))
            best = np.maximum.reduceat(scores, starts)
            if (ended := best == NEVER).any():
                over = np.repeat(ended, sizes)
                done.append((word[over], symbols[over]))
                word, symbols, last, scores, makes = (x[~over] for x in (word, symbols, last, scores, makes))
                best, sizes = best[~ended], sizes[~ended]
                if not len(word):
                    break
            # the leftmost of equal scores
            at = np.flatnonzero(scores == np.repeat(best, sizes))
            at = at[np.append(True, word[at[1:]] != word[at[:-1]])]
            symbols[at] = makes[at]
            last[at] = last[at + 1]
            keep = np.ones(len(word), bool)
            keep[at + 1] = False
            word, symbols, last, scores, makes = (x[keep] for x in (word, symbols, last, scores, makes))
            at -= np.arange(len(at))
            scores[at] = NEVER
            before = at[at > 0] - 1
            changed = np.concatenate([at, before])
            changed = changed[~last[changed]]
            scores[changed], makes[changed] = self.joins(symbols, changed)
        word, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        word, symbols = word[order], symbols[order]
        ids = np.where(symbols < 0, -1, self.symbol_ids[np.maximum(symbols, 0)])
        # characters without a piece are bytes
        alone = np.flatnonzero(ids < 0)
        points = np.where(symbols[alone] < 0, -1 - symbols[alone], self.symbol_points[np.maximum(symbols[alone], 0)])
        kinds, which = np.unique(points, return_inverse=True)
        as_bytes = [[self.of_byte[b] for b in chr(k).encode()] for k in kinds.tolist()]
        sizes = np.ones(len(ids), np.int64)
        sizes[alone] = np.array([len(b) for b in as_bytes], np.int64)[which]
        at = np.cumsum(sizes) - sizes
        ids, word = np.repeat(ids, sizes), np.repeat(word, sizes)
        for k in range(max(map(len, as_bytes), default=0)):
            has = sizes[alone] > k
            ids[at[alone[has]] + k] = np.array([b[k] if len(b) > k else 0 for b in as_bytes])[which[has]]
        edges = (4 * np.searchsorted(word, np.arange(len(words) + 1))).tolist()
        packed = ids.astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def learn(self, words: Iterable[str]) -> None:
        """Encodes those of the words that are not remembered."""
        new = set(words).difference(self.words)
        if len(self.words) + len(new) > MEMO_WORDS:
            new |= {w for w in words if w in self.words}
            self.words.clear()
        if usual := [w for w in new if len(w) <= LONG_WORD]:
            self.words.update(zip(usual, self.merged_together(usual), strict=True))
        self.words.update((w, self.pack(self.traced(w, None, 0, len(w), None))) for w in new if len(w) > LONG_WORD)

    def forget(self) -> None:
        """Drops what is remembered, at the end of a task: the next one knows most of it after its first batches."""
        self.words, self.pairs = {}, {}
        give_back()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, packed in 32 bits."""
        found = [_WORDS.findall(normal(x)) if x else [] for x in texts]
        self.learn({*chain.from_iterable(found)})
        return [b"".join(map(self.words.__getitem__, words)) for words in found]

    # --- the lattice of a stretch of text

    def candidates(self, text: str, at: int) -> Iterator[str]:
        """The pieces that may start at a place."""
        found = False
        for stop in range(min(len(text), at + self.longest), at, -1):
            if text[at:stop] in self.ids and self.compatible(None, text[at:stop]):
                found |= stop == at + 1
                yield text[at:stop]
        if not found:
            yield text[at]

    def states(self, text: str, cut: int) -> list[tuple[str, int]]:
        """Pieces that start before ``cut`` and end there or later, with their ends (relative to the cut)."""
        return sorted((p, s + len(p) - cut) for s in range(max(0, cut - self.longest), cut) for p in self.candidates(text, s) if s + len(p) >= cut)

    def forward(self, text: str, entry: str | None, at: int, stop: int) -> dict[int, dict[str, tuple[int, str | None] | None]]:
        """Which pieces can end where, from ``entry`` ending at ``at`` on, with the way back. Nothing starts at ``stop`` or after."""
        nodes: dict[int, dict] = {at: {entry: None}}
        for place in range(at, stop):
            if place not in nodes:
                continue
            if place > at and text[place] == BLANK and text[place - 1] != BLANK:
                # a word begins: all ways that lead here go on alike
                piece = next(iter(nodes[place]))
                nodes[place] = {piece: nodes[place][piece]}
            for piece in self.candidates(text, place):
                for left in nodes[place]:
                    border = left is None or (text[place] == BLANK and place > 0 and text[place - 1] != BLANK)
                    if border or self.compatible(left, piece):
                        nodes.setdefault(place + len(piece), {}).setdefault(piece, (place, left))
        return nodes

    def traced(self, text: str, entry: str | None, at: int, stop: int, leave: tuple[str, int] | None) -> list[str]:
        """The pieces from the end ``at`` of ``entry`` to the state ``leave`` (None: to the end of the text)."""
        nodes = self.forward(text, entry, at, stop)
        place = stop if leave is None else leave[1] + stop
        piece = next(iter(nodes[place])) if leave is None else leave[0]
        parts: list[str] = []
        while place != at:
            parts.append(piece)
            place, piece = nodes[place][piece]
        return parts[::-1]


def normal(text: str) -> str:
    """What the model's normaliser makes of a text: a blank in front, blanks as pieces write them."""
    return BLANK + text.replace(" ", BLANK)


_MODELS: dict[str, PieceModel] = {}


def model_of(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


# --- max-plus algebra


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product: the best weight from each state of the left cut of ``a`` to each of the right cut of ``b``."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def states_along(matrices: list[np.ndarray], enter: int = 0, leave: int = 0) -> list[int]:
    """The state at each inner cut on the best way from ``enter`` to ``leave``: products up a tree, choices down again."""
    if len(matrices) == 1:
        return []
    half = len(matrices) // 2
    left, right = matrices[:half], matrices[half:]
    a, b = combined(left), combined(right)
    middle = int(np.argmax(a[enter] + b[:, leave]))
    if a[enter, middle] + b[middle, leave] == NEVER:
        raise ValueError("no way through the text")
    return [*states_along(left, enter, middle), middle, *states_along(right, middle, leave)]


def combined(matrices: list[np.ndarray]) -> np.ndarray:
    while len(matrices) > 1:
        pairs = [product(a, b) for a, b in zip(matrices[::2], matrices[1::2], strict=False)]
        matrices = pairs + matrices[len(matrices) - len(matrices) % 2 :]
    return matrices[0]


# --- chunks

def chunks_schema(rest: StructType) -> StructType:
    kinds = {"row": LongType(), "chunk": IntegerType(), "opens": BooleanType(), "last": BooleanType(), "text": StringType(), "cut": IntegerType(), "stop": IntegerType(), "rest": rest}
    return StructType([StructField(name, kind) for name, kind in kinds.items()])


def chunks(batches: Iterator[pa.RecordBatch], longest: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """Chunks of texts with a margin of one piece on both sides. ``cut`` and ``stop`` are the chunk's ends in its normal text;
    ``opens``: it begins where the text does. The first chunk of a text has its other columns, ``rest``."""
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.int32(), pa.int32()]
    for batch in slices(batches):
        out, of = [], []
        for i, (row, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            size = len(text) + 1  # the normal text has a blank in front
            for number, start in enumerate(range(0, size, chunk)):
                begin, end = max(0, start - longest - 1), min(size, start + chunk)
                out.append((row, number, begin == 0, end == size, text[max(0, begin - 1) : end + longest - 1], start - begin, end - begin))
                of.append(None if number else i)
        columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([*columns, batch.column(2).take(pa.array(of, pa.int64()))], ["row", "chunk", "opens", "last", "text", "cut", "stop", "rest"])


def chunk_rows(batch: pa.RecordBatch) -> list[dict]:
    """The chunks of a batch with their normal text."""
    rows = batch.select(["row", "chunk", "opens", "last", "text", "cut", "stop", *[c for c in ("enter", "leave") if c in batch.schema.names]]).to_pylist()
    return [r | {"text": normal(r["text"]) if r["opens"] else r["text"].replace(" ", BLANK)} for r in rows]


def ends_of_chunk(model: PieceModel, row: dict) -> tuple[list, list]:
    """The states of both cuts; outside of the text there is one each."""
    enter = [(None, 0)] if row["chunk"] == 0 else model.states(row["text"], row["cut"])
    leave = [None] if row["last"] else model.states(row["text"], row["stop"])
    return enter, leave


def whole_words(row: dict, enter: list) -> tuple[int, int] | None:
    """The first and the last place in a chunk where a word begins after all entering pieces; between them words stand alone."""
    text, after = row["text"], row["cut"] + max(end for _, end in enter)
    first = _BEGIN.search(text, after, row["stop"])
    if not first:
        return None
    last = text.rfind(BLANK, 0, row["stop"])
    while last > first.start() and text[last - 1] == BLANK:
        last -= 1
    return first.start(), max(first.start(), last)


def transfer(model: PieceModel, row: dict) -> np.ndarray:
    """The transfer matrix of a chunk. What lies between whole words is the same for all states and has weight 0."""
    enter, leave = ends_of_chunk(model, row)
    text, stop = row["text"], row["stop"]
    between = whole_words(row, enter)
    out = np.full((len(enter), len(leave)), NEVER)

    def weights(nodes: dict) -> list[float]:
        return [0.0 if (nodes.get(stop) if s is None else s[0] in nodes.get(stop + s[1], ())) else NEVER for s in leave]

    rest = weights(model.forward(text, None, between[1], stop)) if between else None
    for i, (piece, end) in enumerate(enter):
        at = row["cut"] + end
        if at >= stop and not row["last"]:
            # the piece reaches over the whole chunk
            out[i] = [0.0 if state == (piece, at - stop) else NEVER for state in leave]
        elif between is None:
            out[i] = weights(model.forward(text, piece, at, stop))
        elif model.forward(text, piece, at, between[0]).get(between[0]):
            out[i] = rest
    return out


def inner_words(model: PieceModel, row: dict) -> list[str]:
    """The words of a chunk that stand alone."""
    between = whole_words(row, ends_of_chunk(model, row)[0])
    return _WORDS.findall(row["text"][between[0] : between[1]]) if between else []


def traced_ids(model: PieceModel, row: dict, words: list[str]) -> bytes:
    """The packed ids of a chunk between its two known states. ``words``: its :func:`inner_words`, learned."""
    enter, leave = ends_of_chunk(model, row)
    piece, end = enter[row["enter"]]
    text, stop, at, to = row["text"], row["stop"], row["cut"] + end, leave[row["leave"]]
    if at >= stop and not row["last"]:
        return b""
    between = whole_words(row, enter)
    if between is None:
        return model.pack(model.traced(text, piece, at, stop, to))
    inner = b"".join(map(model.words.__getitem__, words))
    return model.pack(model.traced(text, piece, at, between[0], None)) + inner + model.pack(model.traced(text, None, between[1], stop, to))


def giant_ids(rows: DataFrame, path: str, chunk: int) -> DataFrame:
    """For (row, text, rest): text, rest, ids (packed in 32 bits)."""
    spark, schema = rows.sparkSession, chunks_schema(rows.schema["rest"].dataType)
    place = fresh_path(spark, "chunks")
    rows.mapInArrow(lambda b: chunks(b, model_of(path).longest, chunk), schema).write.option("compression", "zstd").parquet(place)
    cuts = spark.read.schema(schema).parquet(place)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in slices(batches):
            found = [transfer(model, r) for r in chunk_rows(batch)]
            columns = [batch.column(0), batch.column(1), pa.array([len(m) for m in found], pa.int32()), pa.array([m.tobytes() for m in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "chunk", "height", "matrix"])
        model.forget()

    def scan(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        found = [np.frombuffer(m.as_py()).reshape(h.as_py(), -1) for m, h in zip(table["matrix"], table["height"], strict=True)]
        states = [0, *states_along(found), 0]
        return pa.table([table["row"], table["chunk"], pa.array(states[:-1], pa.int32()), pa.array(states[1:], pa.int32())], names=["row", "chunk", "enter", "leave"])

    ways = cuts.drop("rest").mapInArrow(matrices, "row long, chunk int, height int, matrix binary").groupBy("row").applyInArrow(scan, "row long, chunk int, enter int, leave int")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        narrow = np.dtype("<u2" if len(model.names) <= 1 << 16 else "<u4")
        for batch in slices(batches, BATCH):
            parts = chunk_rows(batch)
            words = [inner_words(model, r) for r in parts]
            model.learn({*chain.from_iterable(words)})
            ids = [np.frombuffer(traced_ids(model, r, w), "<u4").astype(narrow).tobytes() for r, w in zip(parts, words, strict=True)]
            # what is the chunk's own, without margins and without the blank in front
            texts = [t[max(0, r["cut"] - r["opens"]) : r["stop"] - r["opens"]] for t, r in zip(batch.column("text").to_pylist(), parts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("chunk"), pa.array(texts, pa.string()), batch.column("rest"), pa.array(ids, pa.binary())], names)
        model.forget()

    def whole(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk") if table.num_rows > 1 else table
        narrow = np.dtype("<u2" if len(model_of(path).names) <= 1 << 16 else "<u4")
        ids = np.frombuffer(b"".join(table["ids"].to_pylist()), narrow).astype("<u4").tobytes()
        first = table.slice(0, 1)
        return pa.table([pa.array(["".join(table["text"].to_pylist())], pa.string()), first["rest"], pa.array([ids], pa.binary())], names=["text", "rest", "ids"])

    ways = cut(ways)
    few = ways.count() <= BROADCAST_CHUNKS
    parts = cuts.join(F.broadcast(ways) if few else ways, ["row", "chunk"])
    traced = StructType([schema["row"], schema["chunk"], schema["text"], schema["rest"], StructField("ids", BinaryType())])
    names = traced.names
    return parts.mapInArrow(trace, traced).groupBy("row").applyInArrow(whole, StructType([schema["text"], schema["rest"], StructField("ids", BinaryType())]))


def encoded(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with a binary column ``piece_ids`` (``piece_ids_`` if there is one): the ids as little-endian 32-bit integers."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*columns_of(docs)).alias("kept"), text.alias("text"))
    name = free_name(docs, "piece_ids")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in slices(batches, BATCH):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.encode(batch.column(1).to_pylist()), pa.binary())], ["kept", "ids"])
        model.forget()

    usual = rows.filter(F.length("text") < chunk).mapInArrow(whole, StructType([rows.schema["kept"], StructField("ids", BinaryType())]))
    # a struct must have a field, and row numbers do not go into it
    rest = F.struct(F.lit(True).alias(free_name(docs, "there")), *[c for c, n in zip(columns_of(docs), docs.columns, strict=True) if n != "text"])
    long = docs.filter(F.length(text) >= chunk).select(F.monotonically_increasing_id().alias("row"), text.alias("text"), rest.alias("rest"))
    long = giant_ids(long, path, chunk)
    columns = [
        F.col("text").cast(docs.schema["text"].dataType).alias("text") if n == "text" else F.col(f"rest.`{n.replace('`', '``')}`").alias(n) for n in docs.columns
    ]
    return usual.select("kept.*", F.col("ids").alias(name)).union(long.select(*columns, F.col("ids").alias(name)))


def decoded(rows: DataFrame, path: str, ids: str = "piece_ids") -> DataFrame:
    """``rows`` with a string column ``decoded`` (``decoded_`` if there is one), from the ids alone."""
    name, at = free_name(rows, "decoded"), rows.columns.index(ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, byte_of = model_of(path).names, model_of(path).byte_of
        as_bytes = [bytes([byte_of[i]]) if i in byte_of else n.replace(BLANK, " ").encode() for i, n in enumerate(names)]
        for batch in slices(batches, BATCH, column=ids):
            texts = [b"".join(map(as_bytes.__getitem__, array("I", x or b"")))[1:].decode(errors="replace") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])

    return rows.mapInArrow(work, StructType([*rows.schema.fields, StructField(name, StringType())]))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded_and_checked(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) encoded and decoded again: doc_id, n_pieces, ids_crc32, decoded_sha256, same_text."""
    path = path or default_model()
    rows = decoded(encoded(docs.select("doc_id", "text"), path), path)
    return rows.select(
        "doc_id",
        (F.octet_length("piece_ids") / 4).cast("long").alias("n_pieces"),
        F.crc32("piece_ids").alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(BLANK), F.lit(" "))).alias("same_text"),
    )


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_and_checked(documents(spark, sf_dir))
