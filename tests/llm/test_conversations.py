"""Conversation repair and the prefix trie: against SQL, against brute force, and on odd rows."""

import functools
import hashlib
import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest


sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from runlake.llm import prefix_trie, repair  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string, copies string, `nr` int, `a b` int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def odd_rows():
    rng = random.Random(5)
    rows = [(1, None, None, None), (1, None, None, None), (2, 0, "", ""), (None, 1, "user", "a."), (None, 2, "assistant", "b"), (None, None, "user", "a.")]
    rows += [(3, 0, "system", "s."), (3, 1, "assistant", "hi!"), (3, 1, "assistant", "hi!"), (3, 9, "tool", "x"), (4, 5, "sys", "é🙂."), (4, 5, "bot", "?"), (-7, -3, "user", "u." * 40_000)]
    for conv in range(100, 160):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn * rng.choice((1, 1, 2)), rng.choice(("user", "assistant", "assistant", "system", "user")), rng.choice(("a.", "b", "", " \n", "c!", "d? "))))
    rows += [(500, t, ("user", "assistant")[t % 2], f"turn {t // 3}" + "."[: t % 5]) for t in range(700)]
    return rows


# --- 11


def brute_audit(rows):
    """(cost, audit) over (initial, must go, truncated) by trying every edit at every row."""

    def after(phase, initial):
        return {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((phase, initial))

    @functools.cache
    def best(i, phase, inserted):
        found = []
        if i == len(rows) and phase in (0, 3):
            found.append((0, ""))
        if inserted < 3:
            for role in "ua":
                if after(phase, role) is not None:
                    cost, audit = best(i, after(phase, role), inserted + 1)
                    found.append((cost + 3, "I" + audit))
        if i < len(rows):
            initial, gone, cut_off = rows[i]
            cost, audit = best(i + 1, phase, 0)
            found.append((cost + 4, "D" + audit))
            for role in "sua":
                if not gone and after(phase, role) is not None and (role == initial or role != "s"):
                    cost, audit = best(i + 1, after(phase, role), 0)
                    found.append((cost + (0 if role == initial else 3) + 3 * cut_off, ("K" if role == initial else "R") + audit))
        return min(found, default=(10**9, ""))

    return best(0, 0, 0)


def all_splits(symbols):
    """The whole chart: every span, every split."""
    n = len(symbols)
    chart = {(i, i + 1): repair.leaf(s) for i, s in enumerate(symbols)}
    for width in range(2, n + 1):
        for i in range(n - width + 1):
            splits = [repair.joined(chart[i, k], chart[k, i + width]) for k in range(i + 1, i + width)]
            chart[i, i + width] = tuple(min(cells) for cells in zip(*splits))
    return chart[0, n]


def test_one_split_a_span_gives_the_whole_chart():
    rng = random.Random(2)
    for _ in range(60):
        symbols = "".join(rng.choices("suaxdSUAX", k=rng.randrange(1, 12)))
        spans = repair.Spans()
        for part in (symbols[:3], symbols[3:4], symbols[4:]):
            spans.add(part)
        assert all_splits(symbols) == repair.parsed(symbols) == spans.cells()
        rows = tuple((s.lower() if s != "d" else "u", s == "d", s.isupper()) for s in symbols)
        assert min(repair.parsed(symbols)[repair.PLACE[0, end]] for end in repair.ENDS) == brute_audit(rows)


def brute_repair(rows):
    out, convs = [], defaultdict(list)
    for conv, turn, role, text in rows:
        kept = convs[conv]
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: "".join(c for c in text if c not in ".!?")}.get(case, text)
        kept += [(turn, "user" if case == 4 else role, text)] * {0: 0, 3: 2}.get(case, 1)
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, symbols, counts = set(), [], [0, 0, 0, 0]
        for _, role, text in kept:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else 3
            counts[fault] += 1
            seen.add((role, text))
            symbols.append((role[:1], fault < 2, fault == 2))
        initials = [s[0] for s in symbols]
        counts[3] = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = brute_audit(tuple(symbols))
        left, rest = [], iter(kept)
        for edit in audit:
            _, role, text = next(rest) if edit != "I" else (0, "", "")
            if edit != "D":
                n = len(left) - (left[0][0][:1] == "s" if left else 0)
                left.append((role if edit == "K" else ("user", "assistant")[n % 2], text))
        turns = {t for t, _, _ in kept if t is not None}
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, cost, audit, sha))
    return sorted(out, key=str)


def test_repair_equals_brute_force(spark):
    sys.setrecursionlimit(20_000)
    found = repair.repair_report(repair.damaged(table(spark, odd_rows())))
    assert sorted(map(tuple, found.collect()), key=str) == brute_repair(odd_rows())


def test_repaired_rows_are_sound(spark):
    rows = repair.damaged(table(spark, odd_rows()))
    left = defaultdict(list)
    for r in repair.repaired(rows, repair.parses(rows)).collect():
        left[r.conv_id].append((r.place, r.role[:1]))
    for turns in left.values():
        initials = "".join(role for _, role in sorted(turns))
        body = initials.removeprefix("s")
        assert [p for p, _ in sorted(turns)] == list(range(len(turns))) and body and body == "ua" * (len(body) // 2)


def test_repair_of_an_empty_table(spark):
    assert repair.repair_report(repair.damaged(table(spark, []))).collect() == []


# --- 12


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        block = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        seq = tuple(own.get(block, [])[:h] + turns[h:])
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(set)
    for seq in members:
        if seq:
            children[seq[:-1]].add(seq)

    @functools.cache
    def below(seq):
        parts = [below(c) for c in children[seq]]
        mine = (len(members[seq]) - 1) * len(seq[-1][1]) if seq else 0
        return sum(p[0] for p in parts) or (0 if parts else 1), mine + sum(p[1] for p in parts)

    return sorted(
        (
            (min(m), len(seq), min(members[seq[:-1]]) if seq else None, len(m), len(children[seq]), *below(seq),
             hashlib.sha256(",".join(map(str, sorted(ends[seq]))).encode()).hexdigest())
            for seq, m in members.items()
        ),
        key=str,
    )


def shared_starts(seed):
    rng = random.Random(seed)
    rows = odd_rows()
    for conv in range(1000, 1400):
        for turn in range(rng.choice((1, 2, 3, 3, 4, 70))):
            rows.append((conv, turn, "user", f"t{rng.choice((0, 0, 0, 1)) if turn < 66 else rng.randrange(9)}"))
    rows += [(conv, t, "user", "same") for conv in range(2000, 2300) for t in range(3)]
    return rows


@pytest.mark.parametrize("shard", [400_000, 60])
def test_trie_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", shard)
    sys.setrecursionlimit(20_000)
    rows = shared_starts(1)
    found = prefix_trie.trie(prefix_trie.rebuilt(table(spark, rows)))
    assert sorted(map(tuple, found.collect()), key=str) == brute_trie(rows)


def test_sorted_matrix_equals_sorted_lists():
    rng = np.random.default_rng(3)
    lists = [rng.integers(1, 3, rng.choice((0, 1, 2, 40, 70))).tolist() for _ in range(200)] + [[1] * k for k in range(31, 100)] * 2
    conv = rng.permutation(len(lists))
    offsets = np.cumsum([0, *map(len, lists)])
    order, shared = prefix_trie.lexsorted(conv, np.concatenate(lists).astype(np.int64), offsets)
    want = sorted(range(len(lists)), key=lambda i: (lists[i], conv[i]))
    assert order.tolist() == want
    for k in range(1, len(want)):
        a, b = lists[want[k - 1]], lists[want[k]]
        assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_trie_of_few_conversations(spark):
    assert prefix_trie.trie(prefix_trie.rebuilt(table(spark, []))).collect() == []
    turnless = table(spark, [(-5, None, None, None), (None, 1, "user", "left out")])
    found = prefix_trie.trie(prefix_trie.rebuilt(turnless)).collect()
    assert sorted(map(tuple, found), key=str) == brute_trie([(-5, None, None, None)])
