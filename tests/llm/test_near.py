import random
from collections import Counter
from itertools import combinations

import numpy as np

from page_fixtures import hard, pages, with_clashes  # noqa: F401
from leafscribe.llm import near
from leafscribe.llm.components import components
from leafscribe.llm.near import near_copies


def sets(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def expected(rows):
    found = [sets(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(found[i] & found[j])
            if found[i] and found[j] and 100 * both >= 75 * len(found[i] | found[j]):
                up[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        least = (min(ids) if ids else None) if found[i] else doc_id
        out.append((doc_id, len(found[i]), least, doc_id == least))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def edited(text, n, rnd):
    w = text.split()
    for _ in range(n):
        w[rnd.randrange(len(w))] = f"ny{rnd.randrange(10**6)}"
    return " ".join(w)


def many():
    rnd = random.Random(4)
    texts = []
    for _ in range(25):
        base = " ".join(f"ord{rnd.randrange(3000)}" for _ in range(rnd.randint(60, 200)))
        texts += [edited(base, rnd.randint(0, 6), rnd) for _ in range(rnd.randint(1, 9))]
    base = " ".join(f"sida{i}" for i in range(150))
    texts += [edited(base, rnd.randint(0, 5), rnd) for _ in range(40)]
    return texts


def test_groups(pages):
    texts = many()
    rows = list(enumerate(texts, 1))
    assert result(near_copies(pages(texts).repartition(5))) == expected(rows)
    # Nodes of more than a few classes branch, and are compared in blocks at last.
    assert result(near_copies(pages(texts), small=4, depth=2)) == expected(rows)


def test_candidates_in_parts(pages, monkeypatch):
    rnd = np.random.default_rng(2)
    i, j = np.triu_indices(40, 1)
    keep = rnd.random(len(i)) < 0.5
    i, j = i[keep], j[keep]
    monkeypatch.setattr(near, "HELD", 8)
    monkeypatch.setattr(near, "PAIRS", 16)
    parts = list(near._held(-3, 40, i, j))
    assert len({n for n, _, _ in parts}) == len(parts) > 10
    assert all(len(np.union1d(x, y)) <= 8 for _, x, y in parts)
    assert sorted((a, b) for _, x, y in parts for a, b in zip(x, y)) == list(zip(i, j))
    tokens = rnd.integers(0, 2, (30, near.TOKENS)).astype(np.uint32)
    marks, sides = np.zeros((30, near.TREES), np.int64), np.zeros(30, int)
    some = near._close(tokens, np.arange(30), marks, sides, 130)
    monkeypatch.setattr(near, "PAIRS", 10**6)
    every = near._close(tokens, np.arange(30), marks, sides, 130)
    assert [x.tolist() for x in some] == [x.tolist() for x in every]


def test_each_pair_at_its_first_node():
    rnd = np.random.default_rng(3)
    tokens = np.repeat(rnd.integers(0, 2**32, (1, near.TOKENS), np.uint32), 12, 0)
    tokens[rnd.random(tokens.shape) < 0.2] = 7
    marks = rnd.integers(0, 16, (12, near.TREES))
    marks[:] = marks[0]
    # Every compared node and its members, by walking all trees.
    found = {}
    for m in range(12):
        todo = [(t, 1, near._starts(tokens[m : m + 1])[0, t]) for t in range(near.TREES)]
        while todo:
            t, h, node = todo.pop()
            if not marks[m, t] >> h & 1:
                found.setdefault((t * 64 + h, node), []).append(m)
                continue
            for slot, token in enumerate(near._chosen(np.array([node]))[0]):
                value = tokens[m, [int(token)]]
                todo.append((t, 2 * h + slot, near._child(np.array([node]), np.array([token]), value)[0]))
    times, met = Counter(), set()
    for (place, _), members in found.items():
        pairs = list(combinations(members, 2))
        met |= set(pairs)
        if pairs:
            i, j = np.array(pairs).T
            times.update(p for p, f in zip(pairs, near._earliest(tokens, marks, i, j, place)) if f)
    assert len(met) > 40 and dict(times) == dict.fromkeys(met, 1)


def test_hard_rows(pages, hard, with_clashes):
    ids = [None, 5, 5, *range(7, 7 + len(hard) - 3)]
    df = with_clashes(pages(hard, ids), "set_id", "tokens", "component")
    assert result(near_copies(df)) == expected(list(zip(ids, hard)))
    assert near_copies(pages([])).collect() == []


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 900), (900, 700), (3, 3)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 700: 500, 900: 500}


def test_components_in_blocks(spark):
    rnd = random.Random(8)
    rows = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(-5, 300), (2**62, -5), (400, 400)]
    links = spark.createDataFrame(rows, "a long, b long").repartition(6)
    want = {r.id: r.component for r in components(links).collect()}
    assert want[2**62] == want[300] == -5 and 400 not in want
    assert all(want[a] == want[b] for a, b in rows if a != b)
    assert {r.id: r.component for r in components(links, block=40).collect()} == want


def test_joint_miss_at_the_least_similarity():
    from math import comb

    def met(equal):
        both = equal * (equal - 1) / (near.TOKENS * (near.TOKENS - 1))
        other = near.TOKENS - equal
        none = other * (other - 1) / (near.TOKENS * (near.TOKENS - 1))
        lives = 1.0
        for _ in range(near.DEPTH):
            lives = 1 - (none + (1 - both - none) * (1 - lives) + both * (1 - lives) ** 2)
        return lives * comb(equal, near.START) / comb(near.TOKENS, near.START)

    miss = 0.0
    for equal in range(near.TOKENS + 1):
        share = comb(near.TOKENS, equal) * 0.75**equal * 0.25 ** (near.TOKENS - equal)
        miss += share * (1 if equal < near.LEAST_EQUAL else (1 - met(equal)) ** near.TREES)
    assert miss < 2e-5


def test_later_trees_leave_out_what_earlier_ones_linked(pages, monkeypatch):
    rnd = random.Random(9)
    base = " ".join(f"rad{i}" for i in range(150))
    texts = [edited(base, rnd.randint(0, 3), rnd) for _ in range(300)]
    met, mixed = [], near._mixed

    def counted(rows, labels):
        found = mixed(rows, labels)
        met.append(found.count())
        return found

    monkeypatch.setattr(near, "_mixed", counted)
    assert {row["component_id"] for row in near_copies(pages(texts)).collect()} == {1}
    # All trees at once met nearly every page in most of the 56 trees.
    assert sum(met) < 20 * len(texts)
