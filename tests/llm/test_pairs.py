"""What near-duplicate search makes on the way: sketches, pairs that meet, and the memory of a slice of text."""

import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from runlake.llm import jaccard, mixing, sketches  # noqa: E402
from runlake.llm.common import mixed, slices  # noqa: E402


def hashes(values):
    return mixed(np.array(values, np.uint64))


def test_wide_sketch_folds_into_sketch(spark):
    a = hashes(range(1, 700))
    wide, narrow = (sketches.sketch(a, n).tolist() for n in (sketches.WIDE, sketches.CELLS))
    found = spark.createDataFrame([(wide,)], "wide array<long>").select(sketches.folded(sketches.F.col("wide")).alias("s")).first().s
    assert found == narrow


def test_wide_sketch_never_rules_out_a_link(spark):
    rows = []
    for common, own in ((200, 10), (200, 18), (200, 40), (17, 1), (1, 0), (3000, 250)):
        a, b = hashes(range(1, common + own + 1)), hashes([*range(1, common + 1), *range(10_000, 10_000 + own)])
        rows.append((len(a), sketches.sketch(a, sketches.WIDE).tolist(), len(b), sketches.sketch(b, sketches.WIDE).tolist(), 100 * common >= 85 * (common + 2 * own)))
    df = spark.createDataFrame(rows, "na long, sa array<long>, nb long, sb array<long>, link boolean")
    c = sketches.F.col
    found = df.select("link", sketches.may_link(85, c("na"), c("sa"), c("nb"), c("sb"), sketches.WIDE).alias("may")).collect()
    assert all(r.may for r in found if r.link)
    assert not found[2].may


def test_pair_meets_once_by_its_first_shared_key(spark):
    one = sketches.sketch(hashes(range(1, 50))).tolist()
    keys = {1: [30, 10, 20], 2: [20, 30, 10], 3: [10, 40]}
    rows = [(key, node, 49, node, 1, one, ks) for node, ks in keys.items() for key in ks]
    open_ = spark.createDataFrame(rows, "band long, node long, n long, root long, rank int, sketch array<long>, keys array<long>")
    found = [(r.a, r.b) for r in sketches.open_pairs(open_, "band", 80).collect()]
    assert sorted(found) == [(1, 2), (1, 3), (2, 3)]


def test_shingles_of_nodes_of_like_sizes_stay(spark):
    rows = [(1, 10, 100), (1, 11, 85), (2, 10, 100), (2, 12, 40), (3, 13, 7), (3, 14, 7), (4, 10, 100), (5, 15, 17), (5, 16, 20), (5, 17, 400)]
    kept = spark.createDataFrame([(*r, 0) for r in rows], "shingle long, node long, n long, place int")
    found = jaccard.of_like_sizes(kept, 85)
    assert found.columns == kept.columns or sorted(found.columns) == sorted(kept.columns)
    assert sorted((r.shingle, r.node) for r in found.collect()) == [(1, 10), (1, 11), (3, 13), (3, 14), (5, 15), (5, 16)]


def test_like_sizes_hold_every_pair_that_may_link(spark):
    pairs = [(n, m) for n in range(1, 400) for m in range(n, 400) if 100 * n >= 85 * m and (100 * (n - 1) < 85 * m or n == m)]
    rows = [(i, 2 * i + k, size, 0) for i, pair in enumerate(pairs) for k, size in enumerate(pair)]
    kept = spark.createDataFrame(rows, "shingle long, node long, n long, place int")
    assert jaccard.of_like_sizes(kept, 85).count() == len(rows)


def test_first_hubs_do_not_leave_a_group_in_pieces(spark):
    """Members that are near to their neighbours alone: a component, whatever its hubs."""
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(words[2 * i : 2 * i + 120])) for i in range(60)] + [(100, "other words that nobody has"), (101, None)]
    found = {r.doc_id: r.component_id for r in jaccard.joined(spark.createDataFrame(docs, "doc_id long, text string"), 4, 85).collect()}
    assert found == {**dict.fromkeys(range(60), 0), 100: 100, 101: 101}


def test_features_take_little_memory_at_a_time():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 9999, 600)) for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    telling = np.sort(hashes(range(300)))
    tracemalloc.start()
    for part in slices(iter([batch]), mixing.SLICE):
        mixing.features(part.column(0), telling)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.start()
    tracemalloc.clear_traces()
    for part in slices(iter([batch])):
        mixing.features(part.column(0), telling)
    assert 3 * peak < tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
