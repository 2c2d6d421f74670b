"""Collocations, pieces and periodic runs against plain readings."""

import hashlib
import inspect
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from cases import EDGES, documents
from pyspark.sql import functions as F

from rentroll.llm import collocations, periodic_runs, piece_codec
from rentroll.llm.words import buffer_of, parts_of

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Collocations


def plain_collocations(rows, least, best, redundant):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            total[lang] += len(w)
            for k in range(1, 5):
                counts.update((lang, w[i : i + k]) for i in range(len(w) - k + 1))
    chosen = {p: n for p, n in counts.items() if n >= least and len(p[1]) > 1}
    longest_in = Counter()
    for (lang, w), n in chosen.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longest_in[lang, w[i : i + k]] = max(longest_in[lang, w[i : i + k]], n)
    found = {}
    for (lang, w), a in chosen.items():
        if 100 * longest_in[lang, w] >= redundant * a and longest_in[lang, w]:
            continue
        cuts = [(2000000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        row = (-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]])
        found.setdefault(lang, []).append(row)
    out = []
    for lang, listed in found.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(listed)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def test_windows_of_a_task_stay_small():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(5000)]
    texts = [" ".join(rng.choices(vocabulary, k=700)) for _ in range(1000)]  # 4 MB
    batch = pa.record_batch({"text": pa.array(texts), "lang": pa.array(["en"] * 1000)})
    given = inspect.signature(collocations.counts).parameters
    tracemalloc.start()
    for some in parts_of(batch, "text", given["rows"].default, given["size"].default):
        collocations.windows_of(some.column("text"), some.column("lang"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20, peak


@pytest.mark.parametrize("least,best,redundant", [(2, 2000, 80), (3, 25, 100), (4, 7, 60)])
def test_collocations_over_many_cuts(spark, least, best, redundant):
    rng = random.Random(least)
    vocabulary = ["a", "B", "the", "thé", "\x00", "\x01x", "\x08", "new", "york", "z\x85", "漢字", "b"]
    ends = [" ", "  ", "\t", ". ", ",", "\n", " : "]
    rows = []
    for i in range(300):
        words = rng.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=rng.randint(0, 30))
        text = "".join(w + rng.choice(ends[:3] if rng.random() < 0.9 else ends) for w in words)
        rows.append((rng.choice(["en", "en", "de", None, "und", "", "e\x00", "e\x01", "e\x01\x02"]), text))
    rows += [("en", None), ("en", ""), ("fr", " . , "), ("en", "new york " * 50), ("en", "the " * 3000)]
    frame = spark.createDataFrame(rows, "lang string, text string").withColumn("n", F.lit("theirs")).withColumn("phrase", F.lit(1))
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold"]
    before = {name: spark.conf.get(name) for name in names}
    for name, value in zip(names, ["23", "false", "-1"]):
        spark.conf.set(name, value)
    try:
        df = collocations.mine(frame.repartition(3), least, best, redundant)
        assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, df.collect())) == plain_collocations(rows, least, best, redundant)
        assert collocations.mine(frame.limit(0), least).count() == 0
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_scores_beyond_64_bits(spark):
    """A phrase counted 10**13 times: its product with 2000000 has 65 bits."""
    a, l, r = 10**13, 10**13 + 7, 10**13 + 9
    row = spark.range(1).select(F.lit(a).alias("n"), F.lit(l).alias("l"), F.lit(r).alias("r"))
    assert row.select(F.expr("cast(n as decimal(20,0)) * 2000000 div (l + r)")).first()[0] == a * 2000000 // (l + r)


# Pieces


def test_pieces_and_spans_are_those_of_the_library():
    rng = random.Random(7)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    coder = piece_codec.Coder(MODEL, entries=500)
    alphabet = list("ab é'sll   \n\t\r.,!19　\xa0ñ漢😀\x1c\x85\x00▁▁") + ["<s>", "</s>", "<unk>", "<0x0A>", " the", " don't", "x" * 150]
    for _ in range(60):
        texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(30)] + ["", None, " ", "▁"]
        ids, at, begins, ends = coder.encode(*buffer_of(pa.array(texts)))
        for i, text in enumerate(texts):
            here = slice(at[i], at[i + 1])
            assert ids[here].tolist() == library.encode(text or "", add_eos=True)
            size = len((text or "").encode())
            spans = library.encode(text or "", return_type="offset_mapping", return_bytes=True)["offsets"]
            assert list(zip(begins[here].tolist(), ends[here].tolist())) == [*map(tuple, spans), (size, size)]
    assert len(coder.store) <= 500 and coder.held == sum(len(c) + len(v) for c, v in coder.store.items())


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("prefix,trim,escape", [(0, 0, 0), (1, 0, 1), (0, 1, 1), (1, 1, 0), (1, 1, 1)])
def test_compiled_maps_normalise_with_offsets(rule, prefix, trim, escape):
    flags = dict(add_dummy_prefix=bool(prefix), remove_extra_whitespaces=bool(trim), escape_whitespaces=bool(escape))
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, **flags)
    model = library.serialized_model_proto()
    mine = piece_codec.Normalizer(dict(piece_codec.message(b"".join(v for k, v in piece_codec.message(model) if k == 3))))
    rng = random.Random(rule)
    alphabet = list("  Ｈｅ　①ｶﾞﾊﾟﬁx́é가ᄀ…​\t\n\x00\x7fﷺ½㌀ ab") + ["é", "ｶ゙", "각"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 15))) for _ in range(300)] + ["", " ", "  ", "\x7f"]
    out, bounds, source, ends = mine(*buffer_of(pa.array(texts)))
    for i, text in enumerate(texts):
        said, offsets = library.Normalize(text, with_offsets=True)
        got = out[bounds[i] : bounds[i + 1]].tobytes().decode()
        assert got == said
        places = np.cumsum([0] + [len(c.encode()) for c in text])
        first = np.cumsum([0] + [len(c.encode()) for c in got])
        here = np.append(source[bounds[i] : bounds[i + 1]], ends[i])
        if text:
            assert here[first].tolist() == places[list(offsets)].tolist()


def test_piece_digests_of_edge_rows(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    df = documents(spark, EDGES, extra=True)
    got = sorted(map(tuple, piece_codec.digests(piece_codec.encode(df, MODEL, decoded=True)).collect()), key=repr)
    again = sorted(map(tuple, piece_codec.digests(piece_codec.decode(piece_codec.encode(df, MODEL, rows=3), MODEL)).collect()), key=repr)
    want = []
    for doc_id, text in EDGES:
        ids = library.encode(text or "", add_eos=True)
        want.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert got == again == sorted(want, key=repr)
    assert piece_codec.encode(df.limit(0), MODEL).count() == 0


# Periodic runs


def plain_runs(w, shortest=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(shortest, 2 * q):
                found.setdefault((start, i - start + q), q)
            i += i == start or w[i : i + 1] != w[i + q : i + q + 1]
    return sorted((s, n, q) for (s, n), q in found.items())


def strange(rng):
    """Word lists with many runs: few letters, long periods, runs in runs, runs that meet, Fibonacci words."""
    kind = rng.randrange(6)
    if kind == 0:
        return [rng.randrange(2) for _ in range(rng.randrange(400))]
    if kind == 1:
        return ([rng.randrange(3) for _ in range(rng.randrange(1, 200))] * 9)[: rng.randrange(1, 900)]
    if kind == 2:
        return [9] * rng.randrange(3) + ([0, 1] * rng.randrange(10, 90) + [0]) * rng.randrange(2, 5) + [5]
    if kind == 3:
        out = []
        while len(out) < 700:
            out += ([rng.randrange(4) for _ in range(rng.randrange(1, 4))] * rng.randrange(1, 120)) * rng.randrange(1, 3)
        return out
    if kind == 4:
        f, g = [0], [0, 1]
        while len(g) < 600:
            f, g = g, g + f
        return g[rng.randrange(50) :]
    a, b = [rng.randrange(50) for _ in range(80)], [rng.randrange(50) for _ in range(30)]
    return (a + b + a + [99] + a + b + a + [99] + a) * rng.randrange(1, 3)


@pytest.mark.parametrize("shortest", [2, 12, 40])
def test_all_runs_are_found(shortest):
    rng = random.Random(shortest)
    for _ in range(8):
        texts = [strange(rng) for _ in range(rng.randrange(1, 9))] + [[]]
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        got = periodic_runs.runs_of(np.array(sum(texts, []), np.int64), bounds, shortest)
        for i, text in enumerate(texts):
            assert sorted((s, e - s, q) for t, s, e, q in got.tolist() if t == i) == plain_runs(text, shortest)


def test_run_digests_of_edge_rows(spark):
    rows = EDGES + [(20, " ".join(map(str, strange(random.Random(i)))) + "\x0b x\x85y") for i in range(12)]
    rows += [(i, f"w{i} v " + " ".join(f"u{j}" for j in range(i * 7))) for i in range(100, 140)]
    df = documents(spark, rows, extra=True)
    found = periodic_runs.find(df, rewritten=periodic_runs.repeated_tails, rows=7)
    got = sorted(map(tuple, periodic_runs.summary(found).collect()), key=repr)
    want, repeated = [], 0
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if w and h % 10 == 0:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            repeated += 1
        if len(set(w)) == 3 and len(w) == 60_000:  # plain reading takes too long
            runs = [(0, 60_000, 3)]
        else:
            runs = plain_runs(w)
        kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        want.append((doc_id, len(runs), s, n, q, sha(lines), sha(" ".join(kept)), None if n is None else 1000 * n // q))
    assert repeated and got == sorted(want, key=repr)
    whole = periodic_runs.find(documents(spark, [(1, "p " + "a b c " * 5 + "q"), (2, None)])).collect()
    assert [(r.n_words, r.collapsed) for r in whole] == [(17, "p a b c q"), (0, "")]
    assert periodic_runs.find(df.limit(0)).count() == 0
