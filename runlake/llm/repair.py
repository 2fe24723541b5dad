"""Conversation structure repair by weighted CYK interval parsing (operator 11).

A sound conversation reads ``(s?(ua)+)?`` in the initials of its roles: an optional system turn, then pairs of user and
assistant. The cheapest edits that make it so are found by parsing the rows, in order, with a repair grammar:

* *Grammar*, in Chomsky normal form. A phase says what came last: 0 nothing, 1 ``s``, 2 ``u``, 3 ``a``. The nonterminal
  ``p>q`` derives rows whose repaired initials lead from phase p to phase q; its binary rules are ``p>q -> p>r r>q``. The
  whole is ``0>0`` (nothing is left) or ``0>3``.
* *Cells* hold the least (cost, audit) of each nonterminal over a span of rows. Audits of one cell and cost are never
  prefixes of each other (both edit every row once, and a longer one would cost its inserts more), so the least
  concatenation is the concatenation of the least.
* *Insertion closure*: a cell of one row is ``I* edit I*``, with ``I*`` the cheapest inserts between two phases.
* *Bottom-up by span length*: as nonterminals are phase pairs, every split of a span gives the same cell (the tests compare
  with the chart of all splits). So spans double in length, and one split each is enough. A task parses what it has of a
  conversation; spans of a conversation that range partitions cut apart are joined eight by eight in rounds of a Spark
  aggregation. A conversation of any length is thus spread over tasks.

Only digests, role initials and faults take part in the parse. Texts move once, to apply the audit as a sorted stream that
holds one batch of rows.

Nulls in role or text are one space; so is a null turn or conv_id in the text that decides on the damage. A null turn comes
first; rows without a conv_id are one conversation of that (null) id. Rows of equal turn come in the order of role, then of the
SHA-256 of the text; equal rows are repeats of each other. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlake.llm.common import stored

#: Costs of the edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Phase, initial, phase: what a sound conversation may say next.
STEPS = ((0, "s", 1), (0, "u", 2), (1, "u", 2), (2, "a", 3), (3, "u", 2))
ENDS = (0, 3)
NONTERMINALS = tuple((p, q) for p in range(4) for q in range(p if p < 2 else 2, 4))
PLACE = {pq: i for i, pq in enumerate(NONTERMINALS)}
#: For each nonterminal the places of the two parts of its rules.
RULES = tuple(
    tuple((PLACE[p, r], PLACE[r, q]) for r in range(4) if (p, r) in PLACE and (r, q) in PLACE) for p, q in NONTERMINALS
)
NEVER = (1 << 60, "")
#: Symbols that a task parses before it joins them to the spans before, and spans joined at a time.
SPAN, FAN = 256, 8
BLANK = " \t\n\x0b\x0c\r"

Cells = tuple[tuple[int, str], ...]


def joined(left: Cells, right: Cells) -> Cells:
    """The cells of a span from those of its two parts."""
    out = []
    for parts in RULES:
        best = NEVER
        for i, j in parts:
            cost = left[i][0] + right[j][0]
            if cost <= best[0]:
                best = min(best, (cost, left[i][1] + right[j][1]))
        out.append(best)
    return tuple(out)


def inserts() -> Cells:
    """The insertion closure: the cheapest inserts alone between two phases."""
    one = {(p, q): (INSERT, "I") for p, role, q in STEPS if role != "s"}
    best = {pq: (0, "") if pq[0] == pq[1] else one.get(pq, NEVER) for pq in NONTERMINALS}
    closure = tuple(best.values())
    return joined(joined(closure, closure), closure)


CLOSURE = inserts()


@functools.cache
def leaf(symbol: str) -> Cells:
    """Cells of one row. ``d``: it must go; else its role initial (``x``: another), in upper case if it is truncated."""
    cells = {pq: (DELETE, "D") if pq[0] == pq[1] else NEVER for pq in NONTERMINALS}
    if symbol != "d":
        more = TRUNCATED if symbol.isupper() else 0
        for p, role, q in STEPS:
            if role == symbol.lower():
                cells[p, q] = min(cells[p, q], (KEEP + more, "K"))
            elif role != "s":
                cells[p, q] = min(cells[p, q], (REROLE + more, "R"))
    return joined(joined(CLOSURE, tuple(cells.values())), CLOSURE)


@functools.lru_cache(maxsize=20_000)
def parsed(symbols: str) -> Cells:
    """Cells of a short run of rows, bottom-up by span length."""
    cells = [leaf(s) for s in symbols]
    while len(cells) > 1:
        cells = [joined(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


class Spans:
    """Cells of a run of rows of any length: neighbouring spans of equal length are joined as they come."""

    def __init__(self) -> None:
        self.waiting: list[str] = []
        self.spans: list[tuple[int, Cells]] = []
        self.size = 0

    def add(self, symbols: str) -> None:
        self.waiting.append(symbols)
        self.size += len(symbols)
        if self.size >= SPAN:
            self.flush()

    def flush(self) -> None:
        symbols = "".join(self.waiting)
        for i in range(0, len(symbols), SPAN):
            piece = symbols[i : i + SPAN]
            self.spans.append((1, parsed(piece) if len(piece) < 32 else parsed.__wrapped__(piece)))
            while len(self.spans) > 1 and self.spans[-1][0] == self.spans[-2][0]:
                (n, right), (_, left) = self.spans.pop(), self.spans.pop()
                self.spans.append((2 * n, joined(left, right)))
        self.waiting, self.size = [], 0

    def cells(self) -> Cells:
        self.flush()
        out = self.spans[-1][1]
        for _, left in reversed(self.spans[:-1]):
            out = joined(left, out)
        return out


def legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the rows with their damage; a dropped row has no copies, a repeated one two."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    name = F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    case = F.crc32(name.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        conv.alias("conv_id"),
        turn.alias("turn"),
        F.when(case == 4, "user").otherwise(role).alias("role"),
        F.when(case == 1, "").when(case == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(case == 0, 0).when(case == 3, 2).otherwise(1).alias("copies"),
    )


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


SPAN_ROW = (
    "conv_id long, turn long, role string, digest binary, head string, tail string, n_rows long, blank long, duplicate long, "
    "truncated long, illegal long, costs array<long>, audits array<string>"
)
_COUNTS = ("n_rows", "blank", "duplicate", "truncated", "illegal")


def spans_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One span for what a task has of each conversation. Rows come in order, equal ones as one row with their number."""
    schema = pa.schema(
        [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()), ("head", pa.string()), ("tail", pa.string())]
        + [(c, pa.int64()) for c in _COUNTS]
        + [("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
    )
    done: list[tuple] = []
    size = 0
    now, spans, key, head, tail, counts = None, None, None, "", "", None

    def close() -> int:
        cells = spans.cells()
        done.append((*key, head, tail, *counts, [c for c, _ in cells], [a for _, a in cells]))
        return sum(len(a) for _, a in cells) + 100

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    for rows in batches:
        for row in zip(*[c.to_pylist() for c in rows.columns], strict=True):
            conv, turn, role, sha, n, blank, cut_off, first = row
            if spans is None or conv != now:
                if spans is not None:
                    size += close()
                    if size > 1 << 21:
                        yield batch()
                        done, size = [], 0
                now, spans, key, tail, counts = conv, Spans(), (conv, turn, role, sha), None, [0] * 5
                head = role[:1]
            initial = role[:1]
            spared = 0 if blank or not first else 1
            if spared:
                symbol = initial if initial in ("s", "u", "a") else "x"
                spans.add(symbol.upper() if cut_off else symbol)
            for at in range(spared, n, 1 << 20):
                spans.add("d" * min(1 << 20, n - at))
            counts[0] += n
            counts[1] += n if blank else 0
            counts[2] += 0 if blank else n - spared
            counts[3] += spared if cut_off else 0
            counts[4] += (tail is not None and not legal(tail, initial)) + n - 1
            tail = initial
    if spans is not None:
        close()
    if done:
        yield batch()


def joined_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One span from up to :data:`FAN` neighbouring ones of a conversation, given as a list."""
    for batch in batches:
        for spans in batch.column(0).to_pylist():
            first, last = spans[0], spans[-1]
            counts = {c: sum(s[c] for s in spans) for c in _COUNTS}
            counts["illegal"] += sum(not legal(a["tail"], b["head"]) for a, b in zip(spans, spans[1:]))
            cells = functools.reduce(joined, [tuple(zip(s["costs"], s["audits"], strict=True)) for s in spans])
            row = {**first, **counts, "tail": last["tail"], "costs": [c for c, _ in cells], "audits": [a for _, a in cells]}
            row.pop("nr")
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([f for f in batch.schema.field(0).type.value_type if f.name != "nr"]))


def parses(rows: DataFrame) -> DataFrame:
    """For (conv_id, turn, role, text, copies): per conversation with rows its counts of faults, ``cost`` and ``audit``."""
    trimmed = F.rtrim(F.col("text"), F.lit(BLANK))
    light = rows.filter("copies > 0").select(
        "conv_id", "turn", "role", digest(F.col("text")).alias("digest"), "copies",
        (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut_off"),
    )
    key = ["conv_id", "turn", "role", "digest"]
    light = light.groupBy(*key).agg(F.sum("copies").alias("n"), F.max("blank").alias("blank"), F.max("cut_off").alias("cut_off"))
    seen = Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    light = light.withColumn("first", F.row_number().over(seen) == 1)
    spans = stored(light.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(spans_of, SPAN_ROW), "spans")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "digest")
    # what lies whole in one partition is done; only conversations across partition edges go on
    counted = spans.withColumn("_spans", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    whole, parts = counted.filter("_spans = 1").drop("_spans"), counted.filter("_spans > 1").drop("_spans")
    most = parts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    while most > 1:
        groups = parts.withColumn("nr", F.row_number().over(order)).withColumn("group", F.expr(f"(nr - 1) div {FAN}"))
        listed = groups.groupBy("conv_id", "group").agg(F.sort_array(F.collect_list(F.struct("nr", *parts.columns))).alias("spans"))
        parts = stored(listed.select("spans").mapInArrow(joined_spans, SPAN_ROW), "spans")
        most = -(-most // FAN)
    cells = F.arrays_zip("costs", "audits")
    ends = F.array(*[F.element_at(cells, PLACE[0, end] + 1) for end in ENDS])
    best = F.array_min(ends)
    return whole.unionByName(parts).select("conv_id", *_COUNTS, best["costs"].alias("cost"), best["audits"].alias("audit"))


def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that the audits leave, in order: an audit comes before the rows of its conversation."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    audit, at, place, pairs = "", 0, 0, 0
    for batch in batches:
        out: list[tuple] = []

        def put(edit: str, role: str | None, text: str) -> None:
            nonlocal place, pairs
            if role is None:
                role = ("user", "assistant")[pairs % 2]
            pairs += 0 if edit == "K" and role[:1] == "s" else 1
            out.append((conv, place, edit, role, text))
            place += 1

        def insert() -> None:
            nonlocal at
            while audit[at : at + 1] == "I":
                put("I", None, "")
                at += 1

        for conv, given, _, role, text, copies in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if given is not None:
                audit, at, place, pairs = given, 0, 0, 0
                insert()
                continue
            for _ in range(copies):
                edit = audit[at]
                at += 1
                if edit != "D":
                    put(edit, role if edit == "K" else None, text)
                insert()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the rows of the repaired conversations, each conversation in order within one
    partition. ``found`` comes from :func:`parses` over the same rows."""
    audits = found.select("conv_id", "audit", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("copies"))
    texts = rows.filter("copies > 0").select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "copies")
    both = audits.unionByName(texts).repartition("conv_id")
    sorted_ = both.sortWithinPartitions("conv_id", F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "role", digest(F.col("text")))
    return sorted_.select("conv_id", "audit", "turn", "role", "text", "copies").mapInArrow(
        applied, "conv_id long, place long, edit string, role string, text string"
    )


def digests(repaired_rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) over ``role:text`` joined by line feeds, read as a stream."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            ids, shas = [], []
            for conv, place, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if place == 0:
                    if state is not None:
                        ids.append(now)
                        shas.append(state.hexdigest())
                    now, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shas, pa.string())], ["conv_id", "sha"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()])], ["conv_id", "sha"])

    return repaired_rows.select("conv_id", "place", "role", "text").mapInArrow(work, "conv_id long, sha string")


def repair_report(rows: DataFrame) -> DataFrame:
    """For (conv_id, turn, role, text, copies): one row per conversation, also of those without a copy of any row."""
    turns = F.when(F.col("copies") > 0, F.col("turn"))
    gaps = F.coalesce(F.max("kept") - F.min("kept") + 1 - F.count_distinct("kept"), F.lit(0).cast("long"))
    every = rows.select("conv_id", turns.alias("kept")).groupBy("conv_id").agg(gaps.alias("gaps"))
    found = stored(parses(rows), "parses")
    shas = digests(repaired(rows, found))
    out = every.join(found.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    out = out.join(shas.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "gaps", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", empty).alias("repaired_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP11_SQL = r"""
WITH RECURSIVE crc_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
drawn AS MATERIALIZED (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS x FROM keyed, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN x = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN x = 1 THEN '' WHEN x = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN x = 3 THEN 2 ELSE 1 END)) AS copy FROM drawn WHERE x <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS nr FROM damaged),
judged AS MATERIALIZED (
  SELECT *, substr(role, 1, 1) AS i, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS is_blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY nr) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut_off,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY nr) AS before FROM placed),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank,
    count(*) FILTER (again AND NOT is_blank) AS duplicate, count(*) FILTER (cut_off AND NOT again AND NOT is_blank) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n_rows
  FROM judged GROUP BY conv_id),
steps(p, l, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
closure(p, q, cost, audit) AS (VALUES (0, 0, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 1, 0, ''), (1, 2, 3, 'I'), (1, 3, 6, 'II'),
  (2, 2, 0, ''), (2, 3, 3, 'I'), (3, 3, 0, ''), (3, 2, 3, 'I')),
moves AS MATERIALIZED (
  SELECT conv_id, nr, p, p AS q, 4 AS cost, 'D' AS audit FROM judged, (VALUES (0), (1), (2), (3)) AS t(p)
  UNION ALL SELECT conv_id, nr, p, q, CASE WHEN i = l THEN 0 ELSE 3 END + CASE WHEN cut_off THEN 3 ELSE 0 END,
    CASE WHEN i = l THEN 'K' ELSE 'R' END FROM judged, steps WHERE NOT is_blank AND NOT again AND (i = l OR l <> 's')),
walk AS (
  SELECT conv_id, 0::BIGINT AS nr, q, {'c': cost, 'a': audit} AS best FROM counted, closure WHERE p = 0
  UNION ALL
  SELECT w.conv_id, w.nr + 1, c.q, min({'c': w.best.c + m.cost + c.cost, 'a': w.best.a || m.audit || c.audit})
  FROM walk w JOIN moves m ON m.conv_id = w.conv_id AND m.nr = w.nr + 1 AND m.p = w.q JOIN closure c ON c.p = m.q
  GROUP BY w.conv_id, w.nr, c.q),
parsed AS MATERIALIZED (
  SELECT conv_id, min(best).c AS cost, min(best).a AS audit FROM walk JOIN counted USING (conv_id) WHERE nr = n_rows AND q IN (0, 3)
  GROUP BY conv_id),
letters AS (
  SELECT conv_id, k, substr(audit, k, 1) AS e, k - length(replace(substr(audit, 1, k), 'I', '')) AS n_inserted,
    k - length(replace(substr(audit, 1, k), 'D', '')) AS n_deleted
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM parsed)),
left_over AS (
  SELECT l.conv_id, k, e, k - n_deleted AS place, CASE WHEN e <> 'I' THEN j.role END AS role, CASE WHEN e = 'I' THEN '' ELSE j.text END AS text
  FROM letters l LEFT JOIN judged j ON j.conv_id = l.conv_id AND j.nr = k - n_inserted WHERE e <> 'D'),
opened AS (SELECT conv_id, max(CASE WHEN place = 1 AND e = 'K' AND role[1] = 's' THEN 1 ELSE 0 END) AS s FROM left_over GROUP BY conv_id),
hashed AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (place - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY place)) AS h
  FROM left_over JOIN opened USING (conv_id) GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted USING (conv_id) LEFT JOIN parsed USING (conv_id) LEFT JOIN hashed USING (conv_id)
"""
