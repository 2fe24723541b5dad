"""The training-data operators: against SQL on small tables, against brute force, and on odd rows."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from runlake.llm import (  # noqa: E402
    components, fingerprints, fm_index, jaccard, lines, mixing, pieces, quality, sharding, sketches, suffix_arrays, token_files, windows,
)
from runlake.llm.catalogue import LLM_ORACLES, LLM_QUERIES  # noqa: E402
from runlake.llm.common import shared_folder, slices  # noqa: E402

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row` string, `lines` int, shard int, mix int, quality int, piece_ids int, `a b` int"
PASSAGE = " ".join(f"word{i}" for i in range(70))


def table(spark, rows):
    full = [(i, t, "en", "s", len(t or ""), "x", 1, 2, 3, 4, 5, 6) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empties, repeats, ties, a long text."""
    rng = random.Random(3)
    long = " ".join("".join(rng.choices("abcdefg", k=5)) for _ in range(6000))
    prose = "\n".join(" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(30)) + "." for _ in range(4))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, prose), (4, prose), (5, prose), (None, prose), (None, None), (6, prose[:-20] + "x."), (7, "é ñ 日本 🙂.\n"), (8, long), (9, PASSAGE + " end"), (10, "start " + PASSAGE), (4, "another text")]
    return table(spark, rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_equals_sql(spark, duck, name):
    found = LLM_QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    want = sorted(duck.sql(LLM_ORACLES[name]).select(*columns).fetchall(), key=str)
    assert sorted(map(tuple, found.select(columns).collect()), key=str) == want


# --- 1


def test_shards_fit_and_hold_all(spark, odd):
    rows = sharding.sharded(odd, limit=2000).select("doc_id", "shard_.*", F.coalesce(F.octet_length("text"), F.lit(0)).alias("b")).collect()
    assert len(rows) == odd.count()
    sizes = Counter()
    for r in rows:
        sizes[r.depth, r.prefix, r.page] += r.b
    assert all(v <= 2000 or sum(r.oversized for r in rows if (r.depth, r.prefix, r.page) == k) == 1 for k, v in sizes.items())


def test_equal_keys_overflow_into_pages(spark):
    rows = sharding.sharded(table(spark, [(7, "x" * 90)] * 50), limit=200).select("shard_.*").collect()
    pages = Counter(r.page for r in rows)
    assert len(rows) == 50 and len(pages) > 20 and max(pages.values()) <= 2 and {r.depth for r in rows} == {sharding.BITS}


def test_shards_are_written(spark, odd, tmp_path):
    sharding.write_shards(odd.select("doc_id", "text"), f"{tmp_path}/shards", 2000)
    assert spark.read.parquet(f"{tmp_path}/shards").count() == odd.count()


# --- 2


def shingles(text, size):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()


def brute_components(rows, size, percent):
    sets = [(i, shingles(t, size)) for i, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min(least.get(r, i), i)
    return sorted((i, len(s), least[r]) for (i, s), r in zip(sets, root))


def edited_group(seed, n):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(8)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(50)}"
        rows.append((1000 - i, " ".join(words)))
    return rows + [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 60)))) for i in range(30)]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_equal_brute_force(spark, seed):
    rows = edited_group(seed, 60) + [(2000, ""), (2001, None), (2002, "a b"), (2003, "A b"), (2004, "a b c d"), (2005, "a")]
    found = jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == brute_components(rows, 4, 85)


def test_one_of_a_group_stays(spark, odd):
    kept = jaccard.first_of_groups(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {1, 2, 3, 4, 7, 8, 9} <= set(ids) and not {5, 6, 10} & set(ids)


def test_one_row_of_repeated_ids_and_texts_stays(spark):
    text = " ".join(f"w{i}" for i in range(30))
    other = " ".join(f"v{i}" for i in range(30))
    rows = [(1, text, "b"), (1, text, "a"), (None, text, "c"), (None, text, "d"), (1, other, "e"), (4, other, "f"), (None, "lone words", "g"), (None, "lone words", "g")]
    rows += [(5, "", "h"), (5, "", "h"), (5, None, "i"), (0, text + " more", "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id string").withColumns({"of_doc": F.lit(1), "root": F.create_map(F.lit("a"), F.lit(2))})
    kept = jaccard.first_of_groups(docs)
    assert kept.columns == docs.columns
    found = sorted((r.kept_id, r.doc_id) for r in kept.collect())
    assert found == [("e", 1), ("g", None), ("h", 5), ("h", 5), ("i", 5), ("j", 0)]
    assert [r.kept_id for r in jaccard.first_of_groups(docs.filter("text = '" + text + "'")).collect()] == ["a"]
    assert jaccard.first_of_groups(docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99)], "a long, b long")
    assert {(r.node, r.root) for r in components.components(links).collect()} == {(i, 0) for i in range(41)} | {(99, 99), (100, 99)}
    assert components.components(links.limit(0)).count() == 0


# --- 3 and 4


def brute_removed(rows, size, units):
    first = {}
    for i, text in rows:
        u = units(text)
        for k in range(len(u) - size + 1):
            key = tuple(u[k : k + size])
            first[key] = min(first.get(key, windows.NO_ID), windows.NO_ID if i is None else i)
    out = []
    for i, text in rows:
        u = units(text)
        gone = [False] * len(u)
        for k in range(len(u) - size + 1):
            if first[tuple(u[k : k + size])] < (windows.NO_ID if i is None else i):
                gone[k : k + size] = [True] * size
        out.append((i if i is not None else windows.NO_ID, len(u), sum(gone), [x for x, g in zip(u, gone) if not g]))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [windows.HOT_DOCUMENTS, 1])
def test_repeated_words_equal_brute_force(spark, odd, hot):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(20 + i, f"a{i} {PASSAGE} b{i}") for i in range(6)] + [(40, PASSAGE + " " + PASSAGE)]
    found = fm_index.dedup_words(spark.createDataFrame(rows, "doc_id long, text string"), hot).collect()
    want = brute_removed(rows, 50, lambda t: WORD.findall(t or ""))
    assert sorted(((r.doc, r.n_words, r.n_removed, WORD.findall(r.kept_text)) for r in found), key=str) == want


@pytest.mark.parametrize("hot", [windows.HOT_DOCUMENTS, 1])
def test_repeated_bytes_equal_brute_force(spark, odd, hot):
    rows = [(r.doc_id, r.text[:4000] if r.text else r.text) for r in odd.collect()] + [(20 + i, f"{i}{PASSAGE}{i}é") for i in range(6)] + [(50, "ab" * 200), (51, "ba" * 100)]
    found = suffix_arrays.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string"), hot).collect()
    want = brute_removed(rows, 50, lambda t: list((t or "").encode()))
    assert sorted(((r.doc, r.n_bytes, r.n_removed, list(r.kept)) for r in found), key=str) == want


def test_shards_of_frequent_anchors_are_indexed_in_parts(spark):
    rng = random.Random(8)
    some = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    long, line = some(3000), some(75)
    rows = [(0, long)] + [(1 + i, some(60) + long[9 * i : 9 * i + 70] + some(60)) for i in range(300)]
    rows += [(400 + i, some(60) + line + some(40)) for i in range(600)] + [(None, line + line), (2000, "ab" * 300), (2001, "ba" * 200)]
    how = suffix_arrays.Bytes()
    how.most = 4000

    def bounded(contents, docs):
        assert sum(map(len, contents)) <= 4 * 4000
        return suffix_arrays.least_docs(contents, docs)

    keyed = windows.keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    found = keyed.join(windows.repeated_spans(keyed, how, bounded, hot=50), "row", "left").collect()
    removed = sorted((r.doc, len(r.text), int(windows.covered(len(r.text), r.spans).sum())) for r in found)
    assert removed == sorted(x[:3] for x in brute_removed(rows, 50, lambda t: list(t.encode())))


def test_suffix_arrays_by_induced_sorting():
    rng = random.Random(5)
    for _ in range(200):
        sigma = rng.choice([2, 3, 600])
        text = np.array([rng.randrange(sigma) for _ in range(rng.randint(1, 80))])
        assert suffix_arrays.suffix_array(text, sigma).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def test_suffix_arrays_of_many_names_by_doubling(monkeypatch):
    rng = random.Random(6)
    words = [bytes(rng.choices(b"abcdefgh", k=rng.randint(2, 9))) for _ in range(300)]
    texts = [b" ".join(rng.choices(words, k=3000)), (b"some words again and " * 200)[:-3], b" ".join(words) * 4]
    sorted_, doubled = [], suffix_arrays.doubled
    monkeypatch.setattr(suffix_arrays, "doubled", lambda names, sigma: sorted_.append(len(names)) or doubled(names, sigma))
    for text in texts:
        found = suffix_arrays.suffix_array(np.frombuffer(text, np.uint8).astype(np.int64) + 1, 257)
        assert found.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    assert max(sorted_) > suffix_arrays.SMALL_ALPHABET
    for names in ([0], [3, 3, 3, 3], [600, 1, 600, 1, 600], [rng.randrange(4) for _ in range(500)]):
        assert doubled(np.array(names), 601).tolist() == sorted(range(len(names)), key=lambda i: names[i:])


def test_permuted_common_prefixes():
    text = np.frombuffer(b"abracadabra" * 12, np.uint8).astype(np.int64)
    order = suffix_arrays.suffix_array(text, 257)
    found = suffix_arrays.permuted_common_prefixes(text, order, np.arange(len(text), 0, -1), 50)
    t = bytes(text.astype(np.uint8))
    for a, b in zip(order, order[1:]):
        common = next((k for k in range(50) if t[a + k : a + k + 1] != t[b + k : b + k + 1] or not t[b + k : b + k + 1]), 50)
        assert found[b] == common


def test_matching_statistics_of_streams_outside_the_index():
    rng = random.Random(6)
    text = [rng.randrange(1, 4) for _ in range(200)]
    index = fm_index.FMIndex(np.array(text), 8)
    stream = [rng.randrange(1, 4) for _ in range(60)]
    for at, size, low, high in index.matching_statistics(np.array([stream]), np.array([60])):
        fits = [k for k in range(9) if at + k <= 60 and any(text[i : i + k] == stream[at : at + k] for i in range(200))]
        assert size[0] == max(fits)
        k = int(size[0])
        assert sorted(index.order[low[0] : high[0]]) == [i for i in range(201) if (text + [0])[i : i + k] == stream[at : at + k]]


# --- 5


def test_mixing_meets_targets_and_knows_domains(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    rows = mixing.mixed_to(docs, labels).select("doc_id", "mix.*").toPandas()
    p = np.array([[d[k] for k in mixing.DOMAINS] for d in rows.p])
    total = rows.n_tokens.sum()
    shares = (p * (rows.rate * rows.n_tokens).to_numpy()[:, None]).sum(axis=0) / total
    assert np.abs(shares - [0.95, 0.05, 0]).max() < 0.02 and (rows.rate >= 0).all()
    known = dict(mixing.domain_labels(labels).rdd.map(tuple).collect())
    right = [np.argmax(q) == known[i] for i, q in zip(rows.doc_id, p) if i in known]
    assert np.mean(right) > 0.9


def least_squares(p, n, targets, most):
    """Rates from 0 to ``most`` by exact minimization along one document at a time."""
    rate = np.ones(len(n))
    have = (rate * n) @ p
    for _ in range(3000):
        for d in range(len(n)):
            a = n[d] * p[d]
            new = min(most, max(0.0, rate[d] - a @ (have - targets) / (a @ a)))
            have, rate[d] = have + (new - rate[d]) * a, new
    return have


@pytest.mark.parametrize(("alpha", "shares"), [((0.5, 0.5, 0.5), (0.5, 0.3, 0.2)), ((3.0, 0.02, 0.3), (0.7, 0.3, 0.0)), ((0.3, 0.3, 0.01), (0.2, 0.1, 0.7))])
def test_rates_equal_brute_force_least_squares(spark, alpha, shares):
    rng = np.random.default_rng(4)
    p, n = rng.dirichlet(alpha, 60), rng.integers(1, 90, 60)
    rows = spark.createDataFrame([(int(k), q.tolist()) for k, q in zip(n, p)], "n_tokens long, p array<double>")
    targets = np.array(shares) * n.sum()
    steps, have = mixing.fitted_steps(rows, targets.tolist(), 3.0)
    found = np.array([r[0] for r in rows.select(mixing.rate_of(steps, [F.col("p")[i] for i in range(3)], have, 3.0)).collect()])
    assert found.min() >= 0 and found.max() <= 3.0 and len(steps) <= mixing.MOST_STEPS

    def gap(totals):
        return np.abs(totals - targets).max() / n.sum()

    assert gap((found * n) @ p) < gap(least_squares(p, n, targets, 3.0)) + 0.01


def test_a_corpus_without_a_domain_is_kept(spark):
    """As the pipeline sees it: hardly a ``low`` document is left, though a share of 5 % is wanted."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    low = mixing.domain_labels(labels).filter("label = 1").select("label_id")
    rest = quality.clean(docs).join(low, F.col("doc_id") == F.col("label_id"), "left_anti")
    mixed = mixing.mixed_to(rest, labels)
    rows = mixed.select("mix.*").collect()
    good = [r for r in rows if r.p.good > 0.9 and r.n_tokens]
    assert len(good) > 50 and all(0.8 < r.rate <= 1.5 for r in good) and max(r.rate for r in rows) <= mixing.MOST_RATE
    report = {r.domain: r for r in mixing.mixture_report(mixed).collect()}
    assert abs(report["good"].gap) < 0.02 and abs(report["toxic"].gap) < 0.05 and -0.05 <= report["low"].gap < 0.001


def test_domains_of_held_out_documents(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    rows = mixing.mixed_to(docs, labels.filter(~held)).select("doc_id", "mix.p").join(mixing.domain_labels(labels.filter(held)), F.col("doc_id") == F.col("label_id")).collect()
    right = [mixing.DOMAINS[int(r.label)] == max(mixing.DOMAINS, key=lambda d: r.p[d]) for r in rows]
    assert len(right) > 50 and np.mean(right) > 0.9


@pytest.mark.parametrize("labels", [[], [(4, 1, 0), (None, None, None)], [(4, 0, 0), (5, 1, None), (5, 1, 1), (8, None, 0)]])
def test_mixing_of_odd_rows(spark, odd, labels):
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = mixing.mixed_to(odd, known).select("text", "mix_.*").collect()
    assert len(rows) == odd.count() and all(r.rate == 0 and r.copies == 0 for r in rows if not (r.text or "").split())
    assert mixing.taken(odd, known).columns == odd.columns


# --- 6


def test_fingerprints_add_up_and_ignore_order(spark):
    rows = spark.createDataFrame([("a one.\nb two", "c"), ("", ""), ("x. y\n", "z. z")], "a string, b string")
    a, b = fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))
    both = fingerprints.fingerprint(F.concat("a", F.lit("\n"), "b"))
    swapped = fingerprints.fingerprint(F.concat("b", F.lit("\n"), "a"))
    found = rows.select(a.alias("a"), b.alias("b"), both.alias("both"), swapped.alias("swapped"))
    found = found.select("a", "both", "swapped", fingerprints.combined(F.col("a"), F.col("b")).alias("sum"), fingerprints.combined(F.col("both"), F.col("b"), -1).alias("rest"))
    for r in found.collect():
        assert r["both"] == r["sum"] == r["swapped"] and r["rest"] == r["a"]


def test_next_document_with_ties_and_nulls(spark, odd):
    docs = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = fingerprints.with_next(docs, {"body": F.col("text")}).select("doc_id", "text", "next_body").collect()
    order = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = [(*x, y[1]) for x, y in zip(order, order[1:] + order[:1])]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_fingerprints_of_very_many_pieces_equal_sql(spark, tmp_path):
    """More than 65,535 equal pieces, and 200,000 different ones."""
    rng = random.Random(12)
    many = "\n".join(f"{rng.randrange(10**9)}" for _ in range(200_000))
    rows = [(1, "\n" * 70_000), (2, many), (3, "one line\n" * 150_000), (4, many[: len(many) // 2] + "x. y"), (5, "a short text. of two pieces")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = fingerprints.op6_fingerprints(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(con.sql(fingerprints.OP6_SQL).select(*found.columns).fetchall())


def test_next_document_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 7)
    docs = spark.createDataFrame([(i * i, f"t{i}") for i in range(100)], "doc_id long, text string")
    found = {r.text: r.next_body for r in fingerprints.with_next(docs, {"body": F.col("text")}).collect()}
    assert found == {f"t{i}": f"t{(i - 1) % 100}" for i in range(100)}


def test_anchor_buckets_send_at_most_their_square(spark):
    """Every bucket of anchors sends one row to every bucket of documents: not to every shard."""
    rng = random.Random(31)
    texts = ["".join(rng.choices("abcdefghij ", k=600)) for _ in range(120)]
    rows = windows.keyed(spark.createDataFrame([(i, texts[i // 2]) for i in range(240)], "doc_id long, text string"))
    how = suffix_arrays.Bytes()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert windows.shared_anchors(rows, how, how.deals * partitions, windows.HOT_DOCUMENTS).count() <= partitions**2
    assert how.shards > how.deals


def test_jaccard_of_a_group_that_is_alike_but_not_linked_tests_few_pairs(spark, monkeypatch):
    core = [f"core{i}" for i in range(170)]
    rows = [(k, " ".join([*core, *(f"own{k}x{i}" for i in range(34))])) for k in range(60)]
    rows += [(100 + k, rows[k][1] + " the end") for k in range(0, 60, 6)]
    tested, linked = [], jaccard.linked
    monkeypatch.setattr(jaccard, "linked", lambda pairs, *more: tested.append(pairs.distinct().count()) or linked(pairs, *more))
    found = jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: i % 100 if i >= 100 else i for i, _ in rows}
    assert len(tested) == 2 and tested[1] < 3 * len(rows)


def test_jaccard_reads_no_sets_of_nodes_that_only_share_a_passage(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(k, passage + "".join(f" own{k}x{i}" for i in range(60))) for k in range(50)]
    wanted, fragments = [], jaccard.fragments
    monkeypatch.setattr(jaccard, "fragments", lambda docs, nodes, *more: wanted.append(nodes.count()) or fragments(docs, nodes, *more))
    found = jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: i for i, _ in rows}
    assert sum(wanted[1:]) == 0


def test_jaccard_shingles_little_text_at_a_time(monkeypatch):
    """A task's memory follows the text that it looks at together."""
    texts = pa.RecordBatch.from_arrays([pa.array([f"w{i} " * 4000 for i in range(200)])], ["text"])
    seen, range_hashes = [], jaccard.range_hashes
    monkeypatch.setattr(jaccard, "range_hashes", lambda raw, *more: seen.append(len(raw)) or range_hashes(raw, *more))

    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, work, schema):
            assert [r for b in work(iter([texts])) for r in b.column("cell").to_pylist()][0] == -1
            raise InterruptedError

    with pytest.raises(InterruptedError):
        jaccard.frequency_classes(Docs(), 5)
    assert sum(seen) == sum(map(len, texts.column(0).to_pylist())) > 3 << 20 and max(seen) < 1 << 20


def test_sketches_rule_out_no_link(spark):
    rng = np.random.default_rng(5)
    rows, fits, far = [], [], set()
    for k in range(400):
        n, own = int(rng.integers(1, 900)), int(rng.integers(0, 200))
        both, left, right = (rng.integers(0, 2**63, m).astype(np.uint64) for m in (n, own, int(rng.integers(0, own + 1))))
        a, b = np.unique(np.concatenate([both, left])), np.unique(np.concatenate([both, right]))
        fits.append(100 * n >= 80 * len(np.union1d(a, b)))
        far |= {k} if 2 * n < len(np.union1d(a, b)) else set()
        rows.append((k, len(a), sketches.sketch(a).tolist(), len(b), sketches.sketch(b).tolist()))
    pairs = spark.createDataFrame(rows, "k long, na long, sa array<long>, nb long, sb array<long>")
    may = {r.k for r in pairs.filter(sketches.may_link(80, F.col("na"), F.col("sa"), F.col("nb"), F.col("sb"))).collect()}
    assert {k for k, fit in enumerate(fits) if fit} <= may and len(far) > 20 and not may & far


# --- 7


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


@pytest.mark.parametrize("chunk", [3, 50, pieces.CHUNK])
def test_pieces_equal_the_library(spark, odd, library, chunk):
    rows = [(r.doc_id, (r.text or "")[:3000] or r.text) for r in odd.collect()] + [(60, "x" * 300), (61, "  a    b "), (62, "abcdefgh" * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pieces.decoded(pieces.encoded(docs, pieces.default_model(), chunk), pieces.default_model()).collect()
    assert len(found) == len(rows)
    for r in found:
        assert np.frombuffer(r.piece_ids, "<u4").tolist() == library.encode(r.text or "") and r.decoded == (r.text or "")


def test_words_merged_together_equal_the_library(library):
    rng = random.Random(21)
    texts = ["".join(rng.choices("aehinorst.,é日🙂\n", k=rng.randint(1, 40))) for _ in range(300)] + ["  aa  aaa ", "x" * 100, None, ""]
    model = pieces.PieceModel(pieces.default_model())
    words = sorted({w for t in texts if t for w in pieces._WORDS.findall(pieces.normal(t))})
    assert model.merged_together(words) == [model.pack(model.merged(w)) for w in words]
    for text, ids in zip(texts, model.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text or "")


def test_a_worker_remembers_a_bounded_number_of_words(monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_WORDS", 50)
    model = pieces.PieceModel(pieces.default_model())
    first = model.encode([" ".join(f"a{i}" for i in range(k, k + 40)) for k in range(0, 200, 10)])
    assert first == [x for k in range(0, 200, 10) for x in model.encode([" ".join(f"a{i}" for i in range(k, k + 40))])]
    assert len(model.words) <= 50


def test_a_task_leaves_no_words_in_its_worker(spark, odd):
    """Workers wait for later tasks with what they remember, several to an executor."""
    assert pieces.encoded(odd, pieces.default_model()).count() == odd.count()

    def remembered(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(m.words) + len(m.pairs) for m in pieces._MODELS.values())])], ["n"])

    assert sum(r.n for r in spark.range(0, 32, 1, 16).mapInArrow(remembered, "n long").collect()) == 0


def test_a_slice_does_not_keep_its_batch():
    before = pa.total_allocated_bytes()

    def batches():
        for _ in range(4):
            yield pa.RecordBatch.from_arrays([pa.array(["x" * 100_000] * 100), pa.array([{"a": [k, None]} for k in range(100)])], ["text", "row"])

    kept, n = None, 0
    for kept in slices(batches(), 1 << 20):
        n += kept.num_rows
    assert n == 400 and kept.column(1)[-1].as_py() == {"a": [99, None]}
    assert pa.total_allocated_bytes() - before < 2 << 20


def test_lines_are_looked_at_a_few_at_a_time():
    """The blocks of 10,000 short lines are many more bytes than the lines."""
    names, n = ["h", "g", "line"], 10_000
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array([f"a line with the number {k:06d} and more" for k in range(n)])], names)
    found = list(lines.block_keys(iter([batch])))
    assert sum(b.num_rows for b in found) == 2 * lines.BLOCKS * n and max(b.num_rows for b in found) < lines.BLOCKS * n


def test_giant_texts_are_stored_once(spark, odd, monkeypatch):
    """Without the chunks' margins, which are short, no more text is stored than there is."""
    paths = []
    monkeypatch.setattr(pieces, "fresh_path", lambda s, name: paths.append(f"{shared_folder(s)}/{name}-{len(paths)}-{random.random()}") or paths[-1])
    docs = odd.filter("doc_id = 8")
    text = docs.first().text
    found = pieces.encoded(docs, pieces.default_model(), 5000).collect()
    assert [r.text for r in found] == [text] and [c for c in found[0].asDict()] == [*docs.columns, "piece_ids_"]
    (path,) = paths
    stored = spark.read.parquet(path).selectExpr("sum(length(text)) AS n", "count(rest) AS rests").first()
    assert len(text) <= stored.n <= 1.05 * len(text) and stored.rests == 1


def test_max_plus_tree_equals_search():
    rng = np.random.default_rng(8)
    matrices = [rng.integers(0, 9, s).astype(float) for s in ((1, 3), (3, 4), (4, 2), (2, 3), (3, 1))]
    path = [0, *pieces.states_along(matrices), 0]
    assert sum(m[a, b] for m, a, b in zip(matrices, path, path[1:])) == pieces.combined(matrices)[0, 0]


def test_pieces_pass_columns_through(spark, odd):
    rows = pieces.encoded(odd, pieces.default_model())
    assert rows.columns == [*odd.columns, "piece_ids_"] and rows.count() == odd.count()


# --- 8


def test_token_files_hold_what_the_library_gives(spark, odd, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    extra = [(70, " a  b\n\n c. d,e\t f "), (71, "It's 5'll  ok!! ..\n x<|endoftext|>"), (72, "a.b,c\nd .\n,")]
    extra += [(73, "x <|endoftext|> y"), (74, "<|endoftext|>"), (75, "a  <|endoftext|><|endoftext|>. b"), (-(1 << 62), "far"), ((1 << 62) + 9, "away")]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    token_files.write_tokens(docs, f"{tmp_path}/tokens", path, block_ids=100)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    start, want = 0, []
    for i, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = np.array([*model.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    found = token_files.read_tokens(spark, f"{tmp_path}/tokens").select("doc_id", "start", "n_tokens", "ids_crc32")
    # null and empty texts of one id are equal rows
    assert sorted(map(tuple, found.collect()), key=lambda r: r[1]) == want
    some = [i for i in {w[0] for w in want} if i is not None][::2]
    few = token_files.read_documents(spark, f"{tmp_path}/tokens", [*some, 10**9]).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, few.collect()), key=lambda r: r[1]) == [w for w in want if w[0] in some]
    assert token_files.read_documents(spark, f"{tmp_path}/tokens", []).count() == 0


def test_pieces_of_white_space_and_letters_are_those_of_whole_texts():
    import public_tokenizers

    model = token_files.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(10)
    texts = ["foo.\n\nBar", "foo\n\n\n\nBar", " a\n\nb", "\n\nB", "\n\n\n\nB", "\r\nB", "\t\nB", "a b\n\nc d\ne"]
    texts += ["".join(rng.choices("aBé \n\n\t\r.,\x85", k=rng.randint(1, 12))) for _ in range(5000)]
    for text, packed in zip(texts, model.encode(texts), strict=True):
        assert np.frombuffer(packed, f"<u{model.id_bytes}").tolist() == [*model.model.encode(text, add_special_tokens=False).ids, token_files.END_ID], text


def test_token_file_query_equals_the_library(spark):
    import pandas as pd
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = pd.read_parquet(f"{DATA}/documents.parquet").sort_values("doc_id")
    start, want = 0, []
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_files.op8_token_files(spark, DATA).collect())) == want


def test_elias_fano_boundaries():
    rng = np.random.default_rng(2)
    for n, top in ((1, 1), (5, 3), (700, 40), (1000, 100_000)):
        ends = np.cumsum(rng.integers(0, top, n))
        packed = token_files.elias_fano(ends)
        access = token_files.Ascending(n, *packed)
        assert access.select_range(0, n).tolist() == ends.tolist() and access.spans(0, 1).tolist() == [0, ends[0]]
        assert [access.select(i) for i in range(n)] == ends.tolist()
        assert all(access.first_not_below(v) == np.searchsorted(ends, v) for v in (0, 1, *ends[::50].tolist(), int(ends[-1]) + 1))
        assert n < 100 or 8 * (len(packed[1]) + len(packed[2])) < n * (3 + np.log2(max(2, ends[-1] / n)))


# --- 9


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i, *row[1:]] if False else _next_row(row, i, x, b)
    return row[-1]


def _next_row(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(9)
    base = ["".join(rng.choices("abcé", k=rng.randint(17, 26))) for _ in range(12)]
    rows = []
    for i in range(40):
        some = []
        for _ in range(rng.randint(1, 5)):
            line = rng.choice(base)
            k = rng.randrange(len(line))
            some.append(rng.choice([line, line[:k] + line[k + 1 :], line[:k] + "z" + line[k:], line[:k] + "y" + line[k + 1 :]]))
        rows.append((rng.choice([i, i + 1000]), "\n".join(some)))
    rows += [(5000, None), (5001, ""), (5002, "\n\n")]
    places = [(i, k, line) for i, t in rows for k, line in enumerate((t or "").split("\n")) if len(line) >= lines.MIN_CHARS]
    want = {}
    for i, t in rows:
        all_ = (t or "").split("\n")
        left = [x for k, x in enumerate(all_) if not any((j, m) < (i, k) and abs(len(x) - len(y)) < 2 and distance(x, y) <= 1 for j, m, y in places if len(x) >= lines.MIN_CHARS)]
        want[i] = (len(all_), len(all_) - len(left), "\n".join(left))
    found = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "lines.*").collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == want and len(found) == len(rows)


def test_short_lines_go_if_equal(spark):
    rows = [(1, "Share\n\nRead more\n \u3000\nShare"), (2, "Shore\n\nRead more\n \u3000\nRead  more"), (3, "Share"), (None, "x\nShore")]
    found = lines.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {1: "Share\n\nRead more\n \u3000", 2: "\n \u3000\nRead  more", 3: "", None: "x\nShore"}
    assert {r.doc_id: r.text for r in found} == want


def test_lines_with_one_other_word_equal_brute_force(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcé", k=rng.randint(1, 40)))
    base = [[word() for _ in range(rng.choice([7, 8, 9, 30, 60]))] for _ in range(14)]
    rows = []
    for i in range(60):
        some = []
        for _ in range(rng.randint(1, 4)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 1, 1, 2])):
                k = rng.randrange(len(line))
                line[k : k + rng.randrange(2)] = [word()] * rng.randrange(2)
            some.append(" ".join(line))
        rows.append((i, "\n".join(some)))
    places = [(i, k, x) for i, t in rows for k, x in enumerate(t.split("\n"))]

    def near(x, y):
        v, w = x.split(" "), y.split(" ")
        if x == y or min(len(x), len(y)) < lines.MIN_CHARS:
            return x == y
        if abs(len(x) - len(y)) < 2 and distance(x, y) <= 1:
            return True
        return min(len(v), len(w)) >= lines.MIN_WORDS and abs(len(v) - len(w)) < 2 and distance(v, w) <= 1

    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if not any((j, m) < (i, k) and near(x, y) for j, m, y in places)) for i, t in rows}
    found = lines.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in found} == want


def test_unique_lines_of_repeated_ids_stay(spark):
    first, again, only, other = (f"a line that is long enough, number {i}." for i in ("one", "two", "three", "four"))
    rows = [(1, f"{first}\n{again}"), (2, f"{other}\n{again}"), (2, f"{first}\n{only}"), (2, f"{first}\n{only}"), (None, first)]
    found = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "lines.kept_text").collect()
    assert sorted((r.doc_id or 0, r.kept_text) for r in found if r.doc_id) == [(1, again), (2, other), (2, only), (2, only)]


def test_lines_of_odd_rows(spark, odd):
    out = lines.without_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()


# --- 10


def test_quality_of_odd_rows(spark, odd):
    rows = quality.judged(odd)
    assert rows.columns == [*odd.columns, "quality_"] and rows.count() == odd.count()
    assert not any(r.kept or r.n_words for r in rows.filter("text is null or trim(text) = ''").select("quality_.*").collect())
    assert quality.clean(odd).columns == odd.columns


def test_lines_that_fail_go_and_clean_text_stays():
    prose = "This is a plain line of prose that says something.\n" * 1 + " ".join(f"w{i}" for i in range(60)) + "."
    menu = "Home | News | Sport | About"
    verdict = quality.judge(f"{prose}\n{menu}\nAll rights reserved to us here.")
    assert verdict[9] and verdict[10] == prose and verdict[6] == 2
    assert not quality.judge("\n".join([menu + f" {i}" for i in range(40)] + [prose]))[9]
    assert quality.repeated_words("a b c a b c x".split()) == 6


# --- all


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    plain = none.select("doc_id", "text")
    for found in (
        sharding.sharded(none), jaccard.joined(plain), fm_index.dedup_words(plain), suffix_arrays.dedup_bytes(plain), mixing.mixed_to(none, labels),
        fingerprints.with_next(plain, {"body": F.col("text")}), pieces.encoded(none, pieces.default_model()), lines.dedup_lines(none), quality.judged(none),
    ):
        assert found.count() == 0


def test_token_files_of_nothing(spark, odd, tmp_path):
    import public_tokenizers

    token_files.write_tokens(odd.limit(0), f"{tmp_path}/none", public_tokenizers.path("byte_bpe_50k.json"))
    assert token_files.read_tokens(spark, f"{tmp_path}/none").count() == 0


def test_pipeline_stages(spark, odd, library):
    """Each stage on what the one before kept, held against its own brute force."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    first = {r.doc_id: r.text for r in corpus_pipeline.quality_stage(spark, docs, DATA).collect()}
    assert first == {i: v[10] for i, v in ((i, quality.judge(t)) for i, t in rows.items()) if v[9]}
    third = corpus_pipeline.near_duplicates_stage(spark, spark.createDataFrame(list(first.items()), "doc_id long, text string"), DATA)
    least = {i: c for i, _, c in brute_components(list(first.items()), 5, 80)}
    assert {r.doc_id for r in third.collect()} == {i for i, c in least.items() if i == c}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "lines", "near_duplicates", "mixture", "pieces"]
    none = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, DATA).columns == odd.columns and stage(spark, none, DATA).count() == 0


def test_pipeline_runs(spark):
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert rows and all(r.same_text and len(r.decoded_sha256) == len(hashlib.sha256().hexdigest()) for r in rows)
