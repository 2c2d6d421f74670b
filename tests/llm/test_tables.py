"""Url rules, exact copies, license spans and benchmark items against brute force, with edge rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from cases import EDGES, bag, documents, words
from pyspark.sql import functions as F

from check import duck
from rentroll.llm import decontaminate, exact_dedup, fuse, license_scan, queries, url_filters

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("allow", "example.org", "/es/ok"), ("block", "a.example.org", "/e"),
         ("allow", "dup.net", "/x"), ("block", "dup.net", "/x"), ("block", None, "/")]


def plain_verdict(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].lower(), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("per_slice", [3, 1_000_000])
def test_urls_like_a_plain_rule_loop(spark, per_slice):
    random.seed(1)
    urls = [None, "", "no scheme", "http://", "http://ORG/", "http://a..org/x", "http://dup.net/x?y", "http://b.example.org:80/es/1"]
    hosts, paths = ["example.org", "A.example.org", "x.y.org", "a.example.org", "org", "other.com"], ["/es/", "/es/ok/1", "/e", "/en/1", "", "/é"]
    urls += [f"http://{random.choice(hosts)}{random.choice(paths)}{i % 7 or ''}#f" for i in range(200)] * 2
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("rule", F.lit("theirs"))
    got = url_filters.judge(pages, url_filters.rule_table(spark, RULES), rows_per_slice=per_slice).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(urls[r.page_id]), urls[r.page_id]


def test_urls_without_rows_or_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id bigint, url string")
    assert url_filters.judge(pages.limit(0), url_filters.rule_table(spark, RULES)).count() == 0
    assert url_filters.judge(pages, url_filters.rule_table(spark, [])).first().verdict == "allow"


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000, 30_000])
def test_fuse_filter_holds_its_keys(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
    blob = fuse.build(np.concatenate([keys, keys]))
    assert fuse.contains(blob, keys).all()
    others = np.random.default_rng(99).integers(0, 1 << 63, 20_000).astype(np.uint64)
    assert fuse.contains(blob, others).mean() < 0.01
    if n >= 1000:
        assert len(blob) * 8 / n < 12


def test_exact_copies_like_a_dict(spark):
    random.seed(2)
    texts = ["a b", "a  b", "a\tb", "a\n\n b ", "", None, " ", "c", "é", "a b"]
    rows = [(i, random.choice(texts)) for i in range(300)] + [(5, "a b"), (5, "a b"), (None, "only null"), (None, "a b")]
    groups = {}
    for i, t in rows:
        digest = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
        groups.setdefault(digest, []).append(i)
    want = sorted(
        (str(i), str(keep), len(ids), i == keep, d)
        for d, ids in groups.items()
        for keep in [min((x for x in ids if x is not None), default=None)]
        for i in ids
    )
    got = exact_dedup.deduplicate(documents(spark, rows, extra=True), per_bucket=2).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == want
    assert exact_dedup.deduplicate(documents(spark, rows).limit(0)).count() == 0


def test_license_words_and_spans(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    full = dict(license_scan.TEMPLATES)["mit"]
    rows = EDGES + [
        (20, "x MIT-License y mit, license Apache LICENSE general public license"),
        (21, "Released under the (MIT) License."),
        (22, full.replace("without restriction", "in any way without restriction")),
        (23, "a mit b license"),
        (24, mit),
        (25, "w " * 50_000 + "Licensed under CC BY-NC 4.0"),
    ]
    got = {}
    for r in license_scan.label(documents(spark, rows, extra=True)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    phrases = [p.split() for p, _ in license_scan.PHRASES]
    for i, t in rows:
        w = words(t)
        at = sorted(j for p in phrases for j in range(len(w) - len(p) + 1) if w[j : j + len(p)] == p)
        for r in got[i]:
            assert (r.n_words, r.n_base) == (len(w), len(at))
            assert (r.first_word, r.last_word) == ((at[0], at[-1]) if at else (None, None))
    assert got[20][0].base_labels == "apache,gpl,mit" and got[20][0].score == 1
    assert [got[i][0].labels for i in (21, 22, 23, 24, 25)] == ["mit", "mit", "", "", "cc-by-nc"]
    assert license_scan.label(documents(spark, rows).limit(0)).count() == 0


def plain_items(rows, items, least=0.8):
    best = Counter()
    for item, text in items:
        w = words(text)
        k = min(5, len(w))
        q = set(bag(text, k)) if w else set()
        for i, t in rows:
            n = len(q & set(bag(t, k))) if w and len(words(t)) >= k else 0
            if q and n >= least * len(q):
                best[i, item, len(q)] = max(n, best[i, item, len(q)])
    return {(*pair, n) for pair, n in best.items()}


def test_benchmark_items_like_a_plain_search(spark):
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(random.choices(vocabulary, k=random.choice([6, 12, 30, 80])))) for i in range(25)]
    items += [(30, None), (31, "?!"), (32, "solo"), (33, "two words"), (34, "a b c d"), (35, items[0][1]), (36, "x " * 30)]
    rows = list(EDGES) + [(90, "the solo act"), (91, "Two, WORDS"), (92, "z a b c d"), (93, "x x x x x x")]
    for n in range(100, 160):
        item = words(random.choice(items[:25])[1])
        for _ in range(random.choice([0, 1, 2, 4])):
            item[random.randrange(len(item))] = "edit"
        before, after = random.choices(vocabulary, k=random.randint(0, 300)), random.choices(vocabulary, k=40)
        rows.append((n, ", ".join(before + item + after).upper()))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.find(documents(spark, rows, extra=True), benchmark).collect()
    assert {(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in got} == plain_items(rows, items)
    assert len(got) == len(set(got)) > 30
    held = {r.doc_id for r in got}
    kept = decontaminate.clean(documents(spark, rows, extra=True), benchmark)
    assert "held_id" in kept.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i not in held)
    assert decontaminate.find(documents(spark, rows).limit(0), benchmark).count() == 0
    assert decontaminate.find(documents(spark, rows), benchmark.limit(0)).count() == 0


def test_rows_are_cleaned_one_by_one(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    halves = "alpha beta gamma delta epsilon zeta eta and more", "then epsilon zeta eta theta iota kappa"  # whole only together
    rows = [(i, t) for i in (None, 7) for t in (f"x {item} y", "a clean text of the same id", *halves, None)] + [(8, item.upper())]
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    found = decontaminate.find(documents(spark, rows, extra=True), benchmark).collect()
    assert {(r.doc_id, r.n_shingles, r.n_found) for r in found} == {(i, 6, 6) for i in (None, 7, 8)} and len(found) == 3
    assert decontaminate.find(documents(spark, [(None, halves[0]), (None, halves[1])]), benchmark).count() == 0
    kept = decontaminate.clean(documents(spark, rows, extra=True), benchmark)
    want = [(i, t) for i, t in rows if item not in (t or "").lower()]
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(map(str, want))
    assert kept.columns == documents(spark, rows, extra=True).columns and {r.row for r in kept.collect()} == {"theirs"}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES[name](spark, sf)
    want = duck(sf).sql(queries.ORACLES[name])
    names = sorted(got.columns)
    at = [want.columns.index(c) for c in names]
    assert sorted(str(tuple(r[c] for c in names)) for r in got.collect()) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())
