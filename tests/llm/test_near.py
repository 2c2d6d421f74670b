"""Near-duplicates and components against brute force."""

import random

import numpy as np
import pyarrow as pa
from cases import EDGES, bag, documents
from cases import words as plain_words

from rentroll.llm import components as component_steps
from rentroll.llm import near_dedup, words
from rentroll.llm.components import components


def plain_classes(rows, least=0.8):
    """Smallest position of each row's class, by comparing all pairs."""
    bags = [bag(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(bags):
        for j in range(i):
            common = sum((a & bags[j]).values())
            if a and common >= least * (sum(a.values()) + sum(bags[j].values()) - common):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(rows))]


def edited(rng, text, edits):
    out = text.split()
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def corpus(rng):
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    bases = [" ".join(rng.choices(vocabulary, k=rng.choice([3, 8, 60, 200]))) for _ in range(12)]
    bases.append("chorus line again " * 60)  # shingles that occur many times
    for base in bases:
        rows += [edited(rng, base, rng.choice([0, 0, 1, 2, 5])) for _ in range(6)]
    hub = " ".join(rng.choices(vocabulary, k=150))
    rows += [edited(rng, hub, rng.randint(0, 5)) for _ in range(150)]  # a large group around the threshold
    rows += ["chorus line again " * n for n in (40, 50, 58, 70)]
    rng.shuffle(rows)
    return list(enumerate(rows, 100))


def test_classes_like_all_pairs(spark):
    rows = EDGES[:4] + EDGES[8:] + corpus(random.Random(4))
    got = {r.doc_id: r for r in near_dedup.classes(documents(spark, rows, extra=True)).collect()}
    want = plain_classes(rows)
    sizes = np.bincount(want)
    for n, (i, _) in enumerate(rows):
        assert (got[i].class_id, got[i].class_size, got[i].kept) == (rows[want[n]][0], sizes[want[n]], want[n] == n), i


def test_edge_rows(spark):
    got = near_dedup.classes(documents(spark, EDGES)).collect()
    assert len(got) == len(EDGES)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert all(by[i][0].kept and by[i][0].class_size == 1 for i in (0, 1, 2, 3, None, 6, 7))  # no words: like no other
    assert sorted(r.kept for r in by[4] + by[5]) == [False, False, True] and by[5][0].class_id == 4
    assert near_dedup.classes(documents(spark, EDGES).limit(0)).count() == 0
    kept = near_dedup.one_per_class(documents(spark, EDGES, extra=True))
    assert kept.columns == documents(spark, EDGES, extra=True).columns
    assert kept.count() == sum(r.kept for r in got) and {r.node for r in kept.collect()} == {"theirs"}


def test_registers_agree_as_often_as_the_bags():
    rng, errors = random.Random(5), []
    for _ in range(20):
        a = rng.choices(["a", "b", "c"], k=400)  # counts up to dozens
        b = a[: rng.randint(150, 400)] + rng.choices(["a", "b", "z"], k=rng.randint(1, 80))
        texts = pa.array([" ".join(a), " ".join(b)])
        hashes, owner, count = near_dedup.weighted(*near_dedup.shingles(words.Words(*words.buffer_of(texts))))
        assert count.max() > 2
        r = near_dedup.signatures(hashes, owner, count, 2, 1000)
        x, y = bag(" ".join(a)), bag(" ".join(b))
        exact = sum((x & y).values()) / sum((x | y).values())
        assert abs(near_dedup.similarities(texts[:1], texts[1:])[0] - exact) < 1e-12
        errors.append((r[0] == r[1]).mean() - exact)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.03


def test_weights_in_blocks():
    """A point counts exactly when its place, found by halving, is below the weight."""
    seed = words.mix(np.arange(1, 200_001, dtype=np.uint64))
    n = len(seed)
    hit = near_dedup.below(seed, np.full(n, 11), np.full(n, 8), np.full(n, 16))
    assert abs(hit.mean() - 3 / 8) < 0.01


def test_components_of_chain_star_and_loop(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3), (500, 499), (499, 500)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r.node: r.label for r in components(df).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {499: 499, 500: 499}
    assert components(df.limit(0)).count() == 0


def saved_by(monkeypatch, *modules):
    """Names of the tables that these modules store from now on."""
    names = []
    for m in modules:
        monkeypatch.setattr(m, "save", lambda df, name, f=m.save: names.append(name) or f(df, name))
    return names


def test_steps_end_when_nothing_is_apart(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(3000)], k=80)) for _ in range(6)]
    names = saved_by(monkeypatch, near_dedup, component_steps)
    rows = list(enumerate([*texts, texts[0] + " end", texts[1] + " end"], 1))
    got = {r.doc_id: r.class_id for r in near_dedup.classes(documents(spark, rows)).collect()}
    assert got == {i: i for i in range(1, 7)} | {7: 1, 8: 2}
    assert names.count("links") == 1 and "stars" not in names  # two links that are stars already
    assert not [x for x in names if x.startswith(("hubs", "rest", "left-over"))]


def test_labels_after_rounds_like_all_pairs(spark, monkeypatch):
    names = saved_by(monkeypatch, near_dedup)
    rows = corpus(random.Random(11))
    got = {r.doc_id: r.class_id for r in near_dedup.classes(documents(spark, rows)).collect()}
    assert [got[i] for i, _ in rows] == [rows[w][0] for w in plain_classes(rows)]
    assert "hubs-0" in names  # a large group around the threshold is left to the rounds


def test_words_of_a_batch():
    rng = random.Random(6)
    texts = ["".join(rng.choices(" aZ9.é漢\n", k=rng.randint(0, 30))) for _ in range(200)] + [None, ""]
    for most in (1, 50, 1 << 20):
        got = []
        for row, to, w in words.slices(pa.array(texts), most):
            got += near_dedup.joined(w)
            assert to - row == len(w.first) - 1
        assert got == [" ".join(plain_words(t)) for t in texts]
