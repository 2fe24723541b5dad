"""Line-first quality rules: clean each line, then judge the document by what is left (operator 10).

Every line (cut at line feeds) with at least one word ``[^\\x20\\x09-\\x0D]+`` is tested:

* boilerplate: it contains a phrase of :data:`PHRASES`, in any ASCII case;
* navigation: it has two or more of the separators ``| > » • ·``, at least one for every three words;
* punctuation: it does not end in ``. ! ? … : ;`` (closing quotes and brackets may follow), or it has three or more of the
  symbols ``# * $ % & | < >``, at least one for every five words.

Lines that fail are taken out of the text. A document is rejected if a base rule fails (under ``MIN_WORDS`` words, or more
than ``MAX_REPEATED`` percent of its words lie in repeated three-word windows), or if the failing lines hold more than
``MAX_LOST`` percent of its word characters. Lines without words are kept as they are.

Null or empty text: no words, so the base rule rejects it. Repeated rows are judged one by one. Extra columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from runlake.llm.common import columns_of, documents, free_name, slices, with_text

#: Phrases of site furniture, lower case.
PHRASES = (
    "all rights reserved", "cookie policy", "enable javascript", "licensed under", "log in to", "lorem ipsum", "privacy policy",
    "share this", "sign up for", "subscribe to our", "terms of service", "terms of use", "this work is licensed",
)
MIN_WORDS, MAX_REPEATED, MAX_LOST = 50, 50, 50

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_BOILERPLATE = re.compile("|".join(map(re.escape, PHRASES)), re.IGNORECASE | re.ASCII)
_SEPARATOR = re.compile("[|>»•·]")
_ENDS = re.compile(r"""[.!?…:;]["'”’»)\]]*[\x20\x09-\x0D]*\Z""")

METRICS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, "
    "n_failed_lines long, lost_chars long, base_failed boolean, kept boolean, clean_text string"
)


def repeated_words(words: list[str]) -> int:
    """Words that lie in a three-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, covered = 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            total += i + 3 - max(covered, i)
            covered = i + 3
    return total


def line_fails(line: str, n_words: int) -> bool:
    separators = len(_SEPARATOR.findall(line))
    symbols = len(_SYMBOL.findall(line))
    navigation = separators >= 2 and 3 * separators >= n_words
    punctuation = not _ENDS.search(line) or (symbols >= 3 and 5 * symbols >= n_words)
    return navigation or punctuation or bool(_BOILERPLATE.search(line))


def judge(text: str | None) -> tuple:
    """The values of :data:`METRICS` for one text."""
    text = text or ""
    all_words, kept_lines, seen = [], [], set()
    repeats = lines = failed = lost = chars = 0
    for line in text.split("\n"):
        words = _WORD.findall(line)
        if words:
            lines += 1
            size = sum(map(len, words))
            chars += size
            repeats += line in seen
            seen.add(line)
            all_words += words
            if line_fails(line, len(words)):
                failed += 1
                lost += size
                continue
        kept_lines.append(line)
    n, again = len(all_words), repeated_words(all_words)
    base = n < MIN_WORDS or 100 * again > MAX_REPEATED * n
    kept = not base and 100 * lost <= MAX_LOST * chars
    return n, chars, len(_SYMBOL.findall(text)), repeats, again, lines, failed, lost, base, kept, "\n".join(kept_lines)


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of :data:`METRICS` added, in a struct ``quality`` (``quality_`` if there is such a column)."""
    names = [x.split()[0] for x in METRICS.split(", ")]
    name = free_name(docs, "quality")
    out = StructType([*docs.schema.fields, StructField(name, StructType.fromDDL(METRICS))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column=text):
            rows = [judge(x) for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            kinds = {"base_failed": pa.bool_(), "kept": pa.bool_(), "clean_text": pa.string()}
            fields = [pa.field(x, kinds.get(x, pa.int64())) for x in names]
            columns = [pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(columns, fields=fields)], [*batch.schema.names, name])

    return docs.select(*columns_of(docs)).mapInArrow(work, out)


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with failing lines gone from ``text`` and ``n_chars`` counted anew; same columns."""
    name = free_name(docs, "quality")
    return with_text(judged(docs).filter(F.col(f"{name}.kept")), docs, F.col(f"{name}.clean_text"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", *[f"quality.{x.split()[0]}" for x in METRICS.split(", ")[:-1]])


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM d),
l AS (
  SELECT r, line, line_no, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws,
    length(regexp_replace(line, '[^|>»•·]', '', 'g')) AS seps, length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS syms FROM lines),
tested AS (
  SELECT r, line, line_no, ws, len(ws) AS n, list_sum(list_transform(ws, lambda w: length(w)))::BIGINT AS size,
    row_number() OVER (PARTITION BY r, line ORDER BY line_no) > 1 AS again,
    regexp_matches(line, '(?i)all rights reserved|cookie policy|enable javascript|licensed under|log in to|lorem ipsum|privacy policy|share this|sign up for|subscribe to our|terms of service|terms of use|this work is licensed')
      OR (seps >= 2 AND 3 * seps >= len(ws)) OR (syms >= 3 AND 5 * syms >= len(ws))
      OR NOT regexp_matches(line, '[.!?…:;]["''”’»)\]]*[\x20\x09-\x0D]*$') AS fails
  FROM l WHERE len(ws) > 0),
by_doc AS (
  SELECT r, sum(n)::BIGINT AS n_words, sum(size)::BIGINT AS word_chars, count(*) FILTER (again) AS n_dup_lines, count(*) AS n_lines,
    count(*) FILTER (fails) AS n_failed_lines, coalesce(sum(size) FILTER (fails), 0)::BIGINT AS lost_chars
  FROM tested GROUP BY r),
words AS (SELECT r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w,
    generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
three AS (
  SELECT r, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
counted AS (
  SELECT r, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w2, w3) > 1 AS twice FROM three),
covered AS (
  SELECT r, twice OR coalesce(lag(twice, 1) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS inside
  FROM counted WINDOW o AS (PARTITION BY r ORDER BY i)),
repeats AS (SELECT r, count(*) FILTER (inside) AS n_repeat_words FROM covered GROUP BY r),
joined AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_failed_lines, 0) AS n_failed_lines,
    coalesce(lost_chars, 0) AS lost_chars
  FROM d LEFT JOIN by_doc USING (r) LEFT JOIN repeats USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= 50 * word_chars AS kept
FROM joined
"""
