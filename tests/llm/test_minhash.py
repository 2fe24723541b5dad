"""MinHash near-dedup: against brute force over all pairs, and on odd rows."""

import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from runlake.llm import minhash  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)] if words else [])


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root = [root[b] if r == root[a] else r for r in root]
    out = []
    for (i, _), s, r in zip(rows, sets, root):
        ids = [j for (j, _), q, t in zip(rows, root, sets) if q == r and t and j is not None]
        least = i if not s else min(ids, default=None)
        out.append((i, len(s), least, i == least))
    return sorted(out, key=str)


def groups(seed):
    """Near copies of all degrees round the threshold, texts that share a long passage only, and odd rows."""
    rng = random.Random(seed)
    rows = []
    for g in range(4):
        base = [f"g{g}w{rng.randrange(300)}" for _ in range(90)]
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randrange(0, 9)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(60)}"
            rows.append((rng.randrange(10**6), " ".join(words)))
    passage = [f"p{i}" for i in range(60)]
    rows += [(2_000_000 + i, " ".join(passage + [f"q{rng.randrange(10**6)}" for _ in range(16)])) for i in range(30)]
    prose = " ".join(f"x{i}" for i in range(40))
    rows += [(None, prose), (None, prose), (7, prose.upper()), (7, "another text here"), (None, "only null"), (None, None), (8, ""), (9, " \n"), (10, "Word"), (11, "word"), (12, "a b")]
    return rows + [(13, " ".join(f"l{rng.randrange(9000)}" for _ in range(30_000)))]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = groups(seed)
    found = minhash.joined(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, 2, 80)


def test_pairs_left_open_by_the_hubs_are_compared(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HUB_ROUNDS", 1)
    rows = groups(3)
    found = minhash.joined(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, 2, 80)


def test_one_row_of_a_component_stays(spark):
    schema = "doc_id long, text string, `row` string, `key` int, n int, `a b` int"
    rows = [(*r, "x", 1, 2, 3) for r in groups(4)]
    kept = minhash.first_of_groups(spark.createDataFrame(rows, schema), 2, 80)
    assert kept.columns == ["doc_id", "text", "row", "key", "n", "a b"]
    # with row numbers as ids every row is its own, and each component leaves one
    numbered = [(i, r[1]) for i, r in enumerate(rows)]
    want = sum(k for *_, k in brute(numbered, 2, 80))
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == want and ids.count(None) == 2 and 7 in ids


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.joined(empty).collect() == [] and minhash.first_of_groups(empty).collect() == []


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(1)
    both, left, right = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    a, b = minhash.signature(np.concatenate([both, left])), minhash.signature(np.concatenate([both, right]))
    assert abs((a == b).mean() - 0.8) < 0.1


def test_posterior_bound_equals_numeric_integration():
    grid = np.linspace(0, 1, 200_001)[1:-1]
    for k, least in enumerate(minhash.least_matches(80)):
        n = k * minhash.BATCH
        for m in {int(least) - 1, int(least)} - {-1}:
            density = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(density - density.max())
            assert (density[grid >= 0.8].sum() / density.sum() >= minhash.MISS * 0.99) == (m >= least)


def test_a_group_that_is_alike_but_not_linked_makes_few_pairs(spark, monkeypatch):
    """80 texts with a common core of 170 words and 30 of their own (similarity 0.74), of some a near copy."""
    rng = random.Random(17)
    core = [f"core{i}" for i in range(170)]
    rows = []
    for k in range(80):
        words = core + [f"own{k}x{i}" for i in range(30 + k % 3)]
        rows.append((k, " ".join(words)))
        if k % 4 == 0:
            rows.append((100 + k, " ".join(words[: 170 + rng.randint(0, 30)])))
            rows.append((200 + k, " ".join([*words, "end", "of", "it"])))
    sets = {i: {tuple(w) for w in zip(t.split(), t.split()[1:])} for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        return i if root[i] == i else top(root[i])

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[max(top(a), top(b))] = min(top(a), top(b))
    nodes = spark.createDataFrame([(7, i, len(s), i) for i, s in sets.items()], "band long, nr long, n long, root long")
    names = {g: k for k, g in enumerate(sorted(set().union(*sets.values())))}
    lists = spark.createDataFrame([(i, [names[g] for g in s]) for i, s in sets.items()], "nr long, shingles array<long>")
    pairs = {(r.a, r.b): (r.na, r.nb) for r in minhash.prefix_pairs(nodes, lambda wanted: lists.join(wanted, "nr", "left_semi"), 80).collect()}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert links <= pairs.keys() and all(s == (len(sets[a]), len(sets[b])) for (a, b), s in pairs.items())
    assert len(pairs) < 10 * len(sets) < len(sets) * (len(sets) - 1) / 4
    monkeypatch.setattr(minhash, "HUB_ROUNDS", 1)
    found = minhash.joined(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: top(i) for i in sets}


def test_open_buckets_meet_after_one_round_without_whole_sets(spark, monkeypatch):
    """What is left open after the hubs is compared at once, and only pairs that may be linked have their sets read."""
    core = [f"core{i}" for i in range(170)]
    rows = [(k, " ".join(core + [f"own{k}x{i}" for i in range(30 + k % 3)])) for k in range(60)]
    rows += [(100 + k, rows[k][1] + " the end") for k in range(0, 60, 4)]
    read, calls, sets_of, linked = [], [], minhash.sets_of, minhash.linked
    monkeypatch.setattr(minhash, "sets_of", lambda docs, wanted, size: read.append(wanted.count()) or sets_of(docs, wanted, size))
    monkeypatch.setattr(minhash, "linked", lambda pairs, *more: calls.append(pairs.distinct().count()) or linked(pairs, *more))
    found = minhash.joined(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: i % 100 for i, _ in rows}
    assert len(calls) == len(read) == 2 and calls[1] < len(rows)
