"""Large groups of near copies against brute force over the shingle sets."""

import random

import numpy as np
import pytest

from kinweave.llm import families, neardup
from kinweave.llm.simhash import shingle_set


def brute_components(texts, least=0.8):
    sets = [shingle_set(t, 5) for t in texts]
    n = len(sets)
    element, place, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = seen[place] > 1
    column, of = np.unique(place[shared], return_inverse=True)[1], of[shared]
    both = np.zeros((n, n), np.float32)
    for at in range(0, column.max() + 1, 2000):
        mine = (column >= at) & (column < at + 2000)
        block = np.zeros((n, 2000), np.float32)
        block[of[mine], column[mine] - at] = 1
        both += block @ block.T
    sizes = np.array([len(s) for s in sets], np.float32)
    close = both >= least * (sizes[:, None] + sizes[None, :] - both) - 1e-4
    label = np.arange(n)
    for i in range(n):
        if label[i] == i:
            todo = [i]
            while todo:
                k = todo.pop()
                for j in np.flatnonzero(close[k] & (label > i)):
                    label[j] = i
                    todo.append(j)
    return label, close


def edit(ws, k, r, word):
    out = list(ws)
    for at in r.sample(range(len(ws)), k):
        out[at] = word()
    return out


def made_family(n, seed, branches=0):
    r = random.Random(seed)
    word = lambda: f"w{r.random():.9f}"
    base = [word() for _ in range(110)]
    kinds = [base] + [edit(base, 3, r, word) for _ in range(branches)]
    out = []
    for _ in range(n):
        kind = r.choice(kinds)
        ws = edit(kind, r.choice([1, 2, 3, 4, 5, 6, 7, 9]), r, word)
        out.append(" ".join(ws))
        if r.random() < 0.2:
            out.append(" ".join(edit(ws, r.choice([1, 1, 2]), r, word)))  # a twin
    return out[:n]


def components(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    return np.array([find(i) for i in range(n)])


@pytest.mark.parametrize("n,branches,rows,depth", [(5000, 0, 300, 5), (1500, 6, 40, 5), (900, 6, 30, 0)])
def test_family_of_near_copies_brute_force(spark, n, branches, rows, depth):
    texts = made_family(n, n, branches)
    want, close = brute_components(texts)
    table = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(8)
    members = table.selectExpr("7L as family", "row as id")
    links = [(r["center"], r["id"]) for r in families.family_links(members, table, 5, 0.8, group_rows=rows, depth=depth).collect()]
    assert all(close[a, b] for a, b in links)
    assert (components(n, links) == want).all()
    assert len(links) < 4 * n


def test_groups_keep_every_link_of_a_large_family(spark):
    texts = made_family(1200, 5, 2)
    want, _ = brute_components(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    kept = {r["doc_id"] for r in neardup.keep_one_of_each(df, part_rows=100).collect()}
    lost = {int(x) for x in kept} - set(want.tolist())
    assert set(want.tolist()) <= kept and len(lost) <= 0.002 * len(texts)  # bands may miss a pair once in 1,500


def test_texts_that_differ_just_too_much_stay_apart(spark):
    """Pages that share 90 % of a template, each with a twin: only the twins are joined."""
    r = random.Random(3)
    word = lambda: f"w{r.random():.9f}"
    base, texts = [word() for _ in range(200)], []
    for _ in range(400):
        own = base[:180] + [word() for _ in range(20)]
        texts += [" ".join(own), " ".join(own[:-2] + [word(), word()])]
    want, _ = brute_components(texts)
    table = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    links = [(x["center"], x["id"]) for x in families.family_links(table.selectExpr("1L as family", "row as id"), table, 5, 0.8, group_rows=50).collect()]
    assert (components(len(texts), links) == want).all()


def test_likely_pairs_are_not_all_verified_one_by_one(spark, monkeypatch):
    """Pages at similarity 0.73 and a few twins: as many rows as members in buckets, and no link is lost."""
    r = random.Random(11)
    word = lambda: f"w{r.random():.9f}"
    base = [word() for _ in range(170)]
    texts = [" ".join(base + [word() for _ in range(30)]) for _ in range(250)]
    texts += [" ".join(t.split()[:-2] + [word(), word()]) for t in texts[::25]]
    want, _ = brute_components(texts)
    compared, verified = [], neardup._verified

    def counting(edges, *a):
        compared.append(edges.count())
        return verified(edges, *a)

    monkeypatch.setattr(neardup, "_verified", counting)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    assert {x["doc_id"] for x in neardup.keep_one_of_each(df).collect()} == set(want.tolist())
    assert len(set(want.tolist())) == 250 and sum(compared) < neardup.BANDS * len(texts)


def test_overlaps_in_pieces():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 1 << 20, 90_000).astype(np.uint64)) for _ in range(9)]
    got = families.overlaps(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(9) for j in range(9) if i != j)
