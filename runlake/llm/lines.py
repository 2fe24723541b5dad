"""Near-duplicate lines by deletion neighbourhoods (operator 9).

Two lines are near if their edit distance in code points is at most ``MAX_EDITS`` = 1. A line (text between line feeds, with
its white space) of ``MIN_CHARS`` or more code points is removed if a near or equal line of ``MIN_CHARS`` or more stands earlier in the corpus, that is at
a smaller (doc_id, line number). Lines are judged on the input, not on what is left; shorter lines stay in :func:`dedup_lines` and
the query, as its SQL says. With ``short`` (:func:`without_repeats`, so the pipeline), a shorter line goes too if an equal one stands
earlier; near matches keep the floor. Blank lines (nothing but white space) of less than ``MIN_CHARS`` stay: they part paragraphs. With
``by_words`` (again the pipeline), lines of ``MIN_CHARS`` code points and ``MIN_WORDS`` words or more are also near if one word put in, left
out or changed makes one of the other, however long the word; words are what stands between single blanks.

1. Equal lines are one entry with their earliest place (partial aggregation, so a line in a third of all documents is one row).
2. Two near lines share their first or their last ``m // 2`` code points, ``m`` being the shorter length. Entries that share no
   such half with another entry have no near line and go no further. Halves are counted, never paired.
3. Every other entry emits the hashes of its variants: itself, and the line without its code point ``p`` for each ``p``. Entries
   with an equal variant are near if both lost the same ``p``, or if one is the variant itself. So each (variant, p) needs
   only its earliest entry, not its pairs: the join is linear in the variants.
   The same steps over words instead of code points find the lines that differ in one word.
4. The edit distance of each line and its earlier candidates is verified on the texts; the earliest that holds decides.

Null text counts as one empty line. Rows that repeat a ``doc_id`` share its places, so a line of one is
earlier than a line of the other only if its number is smaller; each text loses only lines of its own. A null ``doc_id`` comes first. Extra columns pass through. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlake.llm.common import POLYNOMIAL, POLYNOMIAL_INVERSE, columns_of, cut, documents, free_name, mixed, powers, slices, stored, with_text

MAX_EDITS = 1
MIN_CHARS = 20
MIN_WORDS = 8
#: Blocks of a line in the second filter.
BLOCKS = 16
#: Up to so many lines (about 100 bytes each) are sent to the documents by broadcast; more are joined.
BROADCAST_LINES = 1_000_000
#: Bytes of lines that a task looks at together: their blocks and variants need some hundred times as much memory.
SLICE = 1 << 17
_LINE_SPAN = 1 << 31
CHAR_KEYS, WORD_KEYS = [f"k{i}" for i in range(4)], [f"w{i}" for i in range(4)]


def lines_of(docs: DataFrame, short: bool = False) -> DataFrame:
    """The lines that take part (with ``short`` those under the floor too, but blank ones): key, text_key, line_no, line, and
    their hashes ``h``, ``g`` (128 bits together). The text key tells apart the texts of a repeated ``key``."""
    lines = docs.select("key", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    long = F.char_length("line") >= MIN_CHARS
    lines = lines.filter(long | F.col("line").rlike(r"(?U)\S") if short else long)
    return lines.select("key", "text_key", "line_no", "line", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"))


def place(key: Column, line_no: Column) -> Column:
    """Where a line stands, as one number, so that the earliest is found by hash aggregation."""
    return (key.cast("decimal(20,0)") * F.lit(_LINE_SPAN).cast("decimal(11,0)") + line_no).cast("decimal(38,0)")


def half_keys(line: Column) -> list[Column]:
    """Hashes of the first and last half, for a partner of the same length and for one that is shorter by one."""
    n = F.char_length(line)
    keys = []
    for shorter in (0, 1):
        m = n - shorter
        half = F.floor(m / 2).cast("int")
        keys += [F.xxhash64(F.lit(0), m, F.substring(line, F.lit(1), half)), F.xxhash64(F.lit(1), m, F.substring(line, n - (m - half) + 1, m))]
    return keys


def word_half_keys(words: Column) -> list[Column]:
    """As :func:`half_keys`, over the words of a line."""
    n = F.size(words)
    keys = []
    for shorter in (0, 1):
        m = n - shorter
        half = F.floor(m / 2).cast("int")
        keys += [F.xxhash64(F.lit(2), m, F.slice(words, F.lit(1), half)), F.xxhash64(F.lit(3), m, F.slice(words, n - (m - half) + 1, m - half))]
    return keys


def entries(lines: DataFrame, by_words: bool = False) -> DataFrame:
    """One row per distinct line: h, g, its half keys (null under the floor; with ``by_words`` those over words too), its earliest place and its number of places."""
    halves = F.when(F.char_length("line") >= MIN_CHARS, F.array(*half_keys(F.col("line"))))
    keyed = lines.withColumn("halves", halves)
    names = CHAR_KEYS + (WORD_KEYS if by_words else [])
    if by_words:
        keyed = keyed.withColumn("words", F.split("line", " ", -1))
        enough = (F.char_length("line") >= MIN_CHARS) & (F.size("words") >= MIN_WORDS)
        keyed = keyed.withColumn("word_halves", F.when(enough, F.array(*word_half_keys(F.col("words")))))
    keys = [F.col("halves" if k in CHAR_KEYS else "word_halves")[int(k[1])].alias(k) for k in names]
    keyed = keyed.select("h", "g", *keys, place(F.col("key"), F.col("line_no")).alias("at"))
    return keyed.groupBy("h", "g", *names).agg(F.min("at").alias("first"), F.count("*").alias("places"))


def shares(keyed: DataFrame, key: str) -> DataFrame:
    """The rows (key, h, ...) whose key also belongs to another line."""
    shared = keyed.groupBy(key).agg(F.min("h").alias("least"), F.max("h").alias("most")).filter("least < most").select(key)
    return keyed.join(shared, key, "left_semi")


def _sums(line: str, by_words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash over the code points or words, and the inverse powers that align its ranges."""
    if by_words:
        words = [hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in line.split(" ")]
        points = np.frombuffer(b"".join(words), "<u8")
    else:
        points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        terms = mixed(points + np.uint64(1)) * powers(POLYNOMIAL, len(points))[: len(points)]
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)]), powers(POLYNOMIAL_INVERSE, len(points) + 1)


def block_keys(batches: Iterator[pa.RecordBatch], by_words: bool = False) -> Iterator[pa.RecordBatch]:
    """For each line, partner length and block: the hash of all that lies outside the block."""
    for batch in slices(batches, SLICE, "line"):
        rows, keys, shorters, blocks = [], [], [], []
        for i, line in enumerate(batch.column(batch.schema.get_field_index("line")).to_pylist()):
            sums, back = _sums(line, by_words)
            n = len(sums) - 1
            for shorter in (0, 1):
                m = n - shorter
                edges = m * np.arange(BLOCKS + 1) // BLOCKS
                left, right = edges[:-1], n - (m - edges[1:])
                with np.errstate(over="ignore"):
                    outside = mixed(sums[left] + np.uint64(m)) ^ mixed((sums[n] - sums[right]) * back[right] + np.uint64(3))
                    keys.append(mixed(outside + np.arange(BLOCKS, dtype=np.uint64)))
            rows += [i] * 2 * BLOCKS
            shorters += [0] * BLOCKS + [1] * BLOCKS
            blocks += [*range(BLOCKS)] * 2
        found = batch.select(["h", "g"]).take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*found.columns, pa.array(np.concatenate(keys).view(np.int64)), pa.array(shorters, pa.int32()), pa.array(blocks, pa.int32())],
            ["h", "g", "block_key", "shorter", "block"],
        )


def variants(batches: Iterator[pa.RecordBatch], by_words: bool = False) -> Iterator[pa.RecordBatch]:
    """For each line and the blocks in which a near line may differ: hashes of the line itself (``p`` -1) and of the line without
    its code point (or word) ``p``."""
    for batch in slices(batches, SLICE, "line"):
        for i, row in enumerate(batch.select(["line", "spots"]).to_pylist()):
            sums, back = _sums(row["line"], by_words)
            n = len(sums) - 1
            where = np.zeros(n, bool)
            for spot in row["spots"]:
                m = n - spot["shorter"]
                start, stop = m * spot["block"] // BLOCKS, m * (spot["block"] + 1) // BLOCKS
                where[start : stop + spot["shorter"]] = True
            p = np.flatnonzero(where)
            with np.errstate(over="ignore"):
                without = mixed(sums[p] + (sums[n] - sums[p + 1]) * np.uint64(POLYNOMIAL_INVERSE) + np.uint64(n - 1))
                whole = mixed(sums[n:] + np.uint64(n))
            ids = batch.select(["h", "g", "first"]).take(pa.array(np.full(len(p) + 1, i)))
            hashes = np.concatenate([whole, without]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(hashes), pa.array(np.concatenate([[-1], p]), pa.int32())], ["h", "g", "first", "variant", "p"])


def one_word_apart(a: str, b: str) -> bool:
    """True if at most one word put in, left out or changed makes one line of the other."""
    x, y = sorted((a.split(" "), b.split(" ")), key=len)
    if len(y) - len(x) > 1:
        return False
    at = next((i for i, (v, w) in enumerate(zip(x, y, strict=False)) if v != w), len(x))
    return x[at + (len(x) == len(y)) :] == y[at + 1 :]


def apart_by_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose ``line`` and ``other_line`` are one word apart."""
    for batch in batches:
        both = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("line", "other_line")]
        yield batch.select(["h", "g", "other"]).filter(pa.array([one_word_apart(a, b) for a, b in zip(*both, strict=True)], pa.bool_()))


def near_places(found: DataFrame, docs: DataFrame, by_words: bool = False) -> DataFrame:
    """For lines (h, g) with a near line (over words: one word apart) at an earlier place: that place, ``near_first``."""
    keys = WORD_KEYS if by_words else CHAR_KEYS
    found = found.filter(F.col(keys[0]).isNotNull())
    halves = found.select("h", F.explode(F.array(*keys)).alias("half"))
    candidates = found.join(shares(halves, "half").select("h").distinct(), "h", "left_semi").select("h", "g", "first")
    spans = F.lit(_LINE_SPAN).cast("decimal(11,0)")
    wanted = candidates.select("h", "g", "first", F.floor(F.col("first") / spans).cast("long").alias("key"))
    wanted = wanted.withColumn("line_no", (F.col("first") - F.col("key").cast("decimal(20,0)") * spans).cast("int"))
    by_doc = cut(wanted.groupBy("key").agg(F.collect_list(F.struct("line_no", "h", "g", "first")).alias("lines")))
    few = (by_doc.agg(F.sum(F.size("lines"))).first()[0] or 0) <= BROADCAST_LINES
    texts = docs.join(F.broadcast(by_doc) if few else by_doc, "key").select(F.split("text", "\n", -1).alias("all"), F.explode("lines").alias("l"))
    texts = texts.select("l.h", "l.g", "l.first", F.col("all")[F.col("l.line_no")].alias("line"))
    # of rows with a repeated doc_id, those with another text do not have the line
    texts = texts.filter(F.xxhash64("line") == F.col("h")).dropDuplicates(["h", "g"])
    texts = cut(texts)

    spots = texts.select("h", "g", "line").mapInArrow(lambda batches: block_keys(batches, by_words), "h long, g long, block_key long, shorter int, block int")
    spots = shares(spots, "block_key").groupBy("h", "g").agg(F.collect_set(F.struct("shorter", "block")).alias("spots"))
    emitted = texts.join(spots, ["h", "g"]).select("h", "g", "first", "line", "spots")
    emitted = cut(emitted.mapInArrow(lambda batches: variants(batches, by_words), "h long, g long, first decimal(38,0), variant long, p int"))
    # lines that lost the same code point p, lines that are the variant of another one, and the other way round
    same = emitted.filter("p >= 0").groupBy("variant", "p").agg(F.min("first").alias("other"))
    whole = emitted.filter("p < 0").groupBy("variant").agg(F.min("first").alias("other"))
    longer = emitted.filter("p >= 0").groupBy("variant").agg(F.min("first").alias("other"))
    pairs = (
        emitted.join(same, ["variant", "p"]).select("h", "g", "first", "other")
        .unionByName(emitted.filter("p >= 0").join(whole, "variant").select("h", "g", "first", "other"))
        .unionByName(emitted.filter("p < 0").join(longer, "variant").select("h", "g", "first", "other"))
        .filter("other < first").distinct()
    )
    other = texts.select(F.col("first").alias("other"), F.col("line").alias("other_line"))
    checked = pairs.join(texts.select("h", "g", "line"), ["h", "g"]).join(other, "other")
    if by_words:
        checked = checked.select("h", "g", "other", "line", "other_line").mapInArrow(apart_by_words, "h long, g long, other decimal(38,0)")
    else:
        checked = checked.filter(F.levenshtein("line", "other_line", MAX_EDITS) >= 0)
    return checked.groupBy("h", "g").agg(F.min("other").alias("near_first"))


def removals(docs: DataFrame, short: bool = False, by_words: bool = False) -> DataFrame:
    """For (key, text): the numbers of the lines that go, as ``gone``, for each key and text that loses any."""
    lines = lines_of(docs, short)
    found = stored(entries(lines, by_words), "lines")
    near = near_places(found, docs)
    if by_words:
        near = near.unionByName(near_places(found, docs, True)).groupBy("h", "g").agg(F.min("near_first").alias("near_first"))
    decided = found.join(near, ["h", "g"], "left").select("h", "g", F.least("first", "near_first").alias("earliest"), "places", "near_first")
    decided = decided.filter("places > 1 OR near_first IS NOT NULL").select("h", "g", "earliest")
    at = place(F.col("key"), F.col("line_no"))
    gone = lines.select("key", "text_key", "line_no", "h", "g").join(decided, ["h", "g"]).filter(at > F.col("earliest"))
    return gone.groupBy("key", "text_key").agg(F.collect_set("line_no").alias("gone"))


def dedup_lines(docs: DataFrame, short: bool = False, by_words: bool = False) -> DataFrame:
    """``docs`` with a struct ``lines`` (``lines_`` if there is such a column): n_lines, n_removed, kept_text.

    ``short``: equal lines under ``MIN_CHARS`` go too. ``by_words``: lines that differ from an earlier one in one word go too.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63) + 1))
    texts = docs.select(key.alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text_key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key")
    rows = docs.select(key.alias("key"), text_key, F.struct(*columns_of(docs)).alias("row"))
    rows = rows.join(removals(texts, short, by_words), ["key", "text_key"], "left")
    rows = rows.withColumn("all", F.split(F.coalesce(F.col("row.text").cast("string"), F.lit("")), "\n", -1))
    left = F.filter("all", lambda x, i: ~F.array_contains(F.col("gone"), i))
    rows = rows.withColumn("left", F.when(F.col("gone").isNull(), F.col("all")).otherwise(left))
    result = F.struct(
        F.size("all").cast("long").alias("n_lines"),
        (F.size("all") - F.size("left")).cast("long").alias("n_removed"),
        F.array_join("left", "\n").alias("kept_text"),
    )
    return rows.select("row.*", result.alias(free_name(docs, "lines")))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that go, short repeats and lines with one other word among them; same columns."""
    return with_text(dedup_lines(docs, short=True, by_words=True), docs, F.col(f"{free_name(docs, 'lines')}.kept_text"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "lines.n_lines", "lines.n_removed", F.sha2("lines.kept_text", 256).alias("kept_sha256"))


OP9_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents),
e AS (
  SELECT line, length(line) AS n, min(doc_id::HUGEINT * 2147483648 + line_no) AS first FROM lines WHERE length(line) >= 20 GROUP BY line),
halves AS (
  SELECT line, n, first, m, side, CASE side WHEN 0 THEN left(line, (m // 2)::INTEGER) ELSE right(line, (m - m // 2)::INTEGER) END AS half
  FROM e, (VALUES (0), (1)) s(side), LATERAL (SELECT unnest([n, n - 1]) AS m)),
near AS (
  SELECT DISTINCT a.line, a.first, b.line AS other, b.first AS earlier
  FROM halves a JOIN halves b ON a.m = b.m AND a.side = b.side AND a.half = b.half AND b.first < a.first
    AND (a.m = a.n OR a.m = b.n)),
tested AS (
  SELECT line, earlier FROM near WHERE CASE
    WHEN length(line) = length(other) THEN
      len(list_filter(range(1, length(line) + 1), lambda i: substr(line, i, 1) <> substr(other, i, 1))) <= 1
    WHEN length(line) = length(other) + 1 THEN
      len(list_filter(range(0, length(line)), lambda i: left(line, i) || substr(line, i + 2) = other)) > 0
    WHEN length(line) + 1 = length(other) THEN
      len(list_filter(range(0, length(other)), lambda i: left(other, i) || substr(other, i + 2) = line)) > 0
    ELSE false END),
decided AS (
  SELECT e.line, least(e.first, min(t.earlier)) AS earliest FROM e LEFT JOIN tested t USING (line) GROUP BY e.line, e.first),
marked AS (
  SELECT l.*, coalesce(l.doc_id::HUGEINT * 2147483648 + l.line_no > d.earliest, false) AS gone FROM lines l LEFT JOIN decided d USING (line))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
