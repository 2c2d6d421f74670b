"""Near-duplicates by BagMinHash signatures, banded, verified on the real multisets.

Documents are multisets of shingles (five consecutive words; shorter documents are one shingle). Two are linked when
their weighted Jaccard similarity (sum of smaller over sum of larger counts) is at least ``least``; a class is a
connected component of links.

1. Documents with the same word sequence are one node.
2. BagMinHash: the weight axis is cut into [0,1), [1,2), [2,4), [4,8) ... Each shingle runs one Poisson process per block
   below its weight, at a rate in proportion to the block; a point has a time, a register and a place in the block, found
   by halving it until it lies wholly below or above the weight, and counts if it is below. A register keeps its earliest
   point, so two documents agree in a register with a probability equal to their weighted Jaccard similarity. Points are made in order of time up to a
   horizon that fills nearly all registers; a document with an empty one goes on to twice the horizon.
3. Registers are banded. In each band bucket every node is a candidate of the bucket's first node only (a star, not all
   pairs). Candidates are verified on the words; components of the links are found by alternating stars.
4. Nodes of buckets that still hold several components are compared further, without all pairs. The shingles of every
   node are put in one order, the rarest first. Two multisets of that similarity share one of the (1 - least) part of each
   that comes first, and behind the first one they share both have enough left to reach the similarity (the prefix and
   positional filters of set joins; neither loses a link). Only nodes of different components that meet so are candidates.
   A few rounds compare each group that shares a shingle with one node that has few shingles of its own, which joins
   nearly all of a group; the last step takes every pair that is left. Edited copies have rare shingles of their own, so
   a large group of them leaves few pairs. Rounds only save pairs, so when the groups that hold several components have
   few pairs from the start, the last step follows at once; when no group does, nothing is left to compare.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from rentroll.llm import words
from rentroll.llm.components import components
from rentroll.llm.shared import save

SHINGLE = 5
BANDS, ROWS = 25, 5
FEW = 4  # pairs a row that are compared at once rather than thinned out by rounds
SKETCHED = [
    StructField("doc_id", LongType()),
    StructField("node", BinaryType()),
    StructField("bands", ArrayType(LongType())),
    StructField("words", StringType()),
]


def uniform(x):
    """Numbers in (0, 1] from hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def step(x):
    """The next hash of a stream."""
    return words.mix(x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03))


def shingles(w):
    """(shingle hash, text number) of every shingle of a run of texts."""
    k = SHINGLE
    inside = w.within(k)
    long, owner = w.grams(k)[inside], w.of()[: len(inside)][inside]
    sizes = np.diff(w.first)
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    extra = []
    for t in short.tolist():  # fewer words than a shingle: all of them are one
        value = int(sizes[t])
        for h in w.hash[w.first[t] : w.first[t + 1]].tolist():
            value = (value * words.BASE + h) % (1 << 64)
        extra.append(value)
    return np.concatenate([long, np.array(extra, np.uint64)]), np.concatenate([owner, short])


def weighted(hashes, owner):
    """Distinct (owner, shingle) with its count."""
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return hashes[at], owner[at], np.diff(np.append(at, len(hashes)))


def below(seed, weight, low, high):
    """Whether a point of the block [low, high) lies below the weight: halve its interval until that is certain."""
    low, high = low.astype(np.float64), high.astype(np.float64)
    open_ = (low < weight) & (high > weight)
    result = high <= weight
    while open_.any():
        i = np.flatnonzero(open_)
        seed[i] = step(seed[i])
        middle = (low[i] + high[i]) / 2
        upper = (seed[i] & np.uint64(1 << 40)) != 0
        low[i] = np.where(upper, middle, low[i])
        high[i] = np.where(upper, high[i], middle)
        result[i] = high[i] <= weight[i]
        open_[i] = (low[i] < weight[i]) & (high[i] > weight[i])
    return result


def blocks(hashes, owner, weight):
    """One process per shingle and block that begins below its weight: (seed, owner, weight, low, high)."""
    parts, low, high = [], 0, 1
    keep = np.arange(len(hashes))
    while keep.size:
        seed = words.mix(hashes[keep] ^ np.uint64(high * 0xA24BAED4963EE407 & (1 << 64) - 1))
        parts.append((seed, owner[keep], weight[keep], np.full(keep.size, low), np.full(keep.size, high)))
        low, high = high, high * 2
        keep = keep[weight[keep] > low]
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 5


def points(seed, rate, horizon):
    """Points of Poisson processes up to their horizon: (process, time, hash), in order of time within a process."""
    process, times, hashes = [], [], []
    at, clock, count = np.arange(len(seed)), np.zeros(len(seed)), np.zeros(len(seed), np.uint64)
    while at.size:
        expected = (horizon[at] - clock[at]) * rate[at]
        width = np.ceil(np.log2(expected + 2)).astype(np.int64)
        for size in np.unique(width):  # processes with about as many points to come go together
            some = at[width == size]
            n = (1 << int(size)) + 2
            number = count[some][:, None] + np.arange(1, n + 1, dtype=np.uint64)
            drawn = words.mix(seed[some][:, None] + number * np.uint64(0x9E3779B97F4A7C15))
            time = clock[some][:, None] + np.cumsum(-np.log(uniform(drawn)), axis=1) / rate[some][:, None]
            early = time <= horizon[some][:, None]
            process.append(np.repeat(some, early.sum(axis=1)))
            times.append(time[early])
            hashes.append(step(drawn[early]))
            clock[some], count[some] = time[:, -1], count[some] + np.uint64(n)
        at = at[clock[at] <= horizon[at]]
    return tuple(np.concatenate(x) for x in (process, times, hashes))


def signatures(hashes, owner, weight, n, m):
    """(n, m) registers: the hash of the earliest point of each; rows without shingles stay zero."""
    register = np.zeros((n, m), np.uint64)
    total = np.bincount(owner, weights=weight, minlength=n)
    todo = np.flatnonzero(total > 0)
    factor = np.log(m) + 5.0
    while todo.size:
        pick = np.isin(owner, todo)
        seed, whose, limit, low, high = blocks(hashes[pick], owner[pick], weight[pick])
        process, time, spot = points(seed, (high - low) * float(m), factor / total[whose])
        hit = below(spot.copy(), limit[process], low[process], high[process])
        process, time, spot = process[hit], time[hit], spot[hit]
        cell = whose[process] * m + (spot >> np.uint64(44)).astype(np.int64) % m
        order = np.lexsort((spot, time))[::-1]  # the earliest is written last
        flat, filled = np.zeros(n * m, np.uint64), np.zeros(n * m, bool)
        flat[cell[order]], filled[cell[order]] = spot[order], True
        done = todo[filled.reshape(n, m)[todo].all(axis=1)]
        register[done] = flat.reshape(n, m)[done]
        todo = np.setdiff1d(todo, done)
        factor *= 2
    return register


def band_hashes(register, bands, rows):
    """(n, bands) hashes of the registers of each band."""
    cut = register[:, : bands * rows].reshape(len(register), bands, rows)
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(register), 1))
    for j in range(rows):
        out = words.mix(out * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, j])
    return out.astype(np.int64)


def joined(w):
    """The words of each text, joined by a space."""
    if not len(w.start):
        return [""] * (len(w.first) - 1)
    mask = np.zeros(len(w.form) + 1, np.int8)
    mask[w.start] += 1
    np.subtract.at(mask, w.end, 1)
    inside = np.cumsum(mask[:-1], dtype=np.int8).astype(bool)
    ends = np.cumsum(w.end - w.start + 1)
    out = np.full(ends[-1], 32, np.uint8)
    place = np.ones(len(out), bool)
    place[ends - 1] = False
    out[place] = w.form[inside]
    raw, cut = out.tobytes(), np.concatenate([[0], ends])[w.first]
    return [raw[a : max(a, b - 1)].decode() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


def sketched(documents, bands, rows, keep=()):
    """doc_id, node (digest of the words), bands (empty without words) and the words joined by a space.

    ``as_is`` holds the columns ``keep`` of the row.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for row, to, w in words.slices(batch.column("text"), 1 << 20):
                found = band_hashes(signatures(*weighted(*shingles(w)), to - row, bands * rows), bands, rows)
                filled = np.diff(w.first) > 0
                at = np.concatenate([[0], np.cumsum(filled * bands)])
                texts = joined(w)
                nodes = [hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts]
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found[filled].ravel(), pa.int64()))
                columns = [ids.slice(row, to - row), pa.array(nodes, pa.binary()), lists, pa.array(texts, pa.string())]
                names = ["doc_id", "node", "bands", "words"]
                if keep:
                    columns.append(batch.column("as_is").slice(row, to - row))
                    names.append("as_is")
                yield pa.RecordBatch.from_arrays(columns, names)

    plain = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), *as_is(documents, keep))
    made = StructType([*SKETCHED, *[f for f in plain.schema.fields if f.name == "as_is"]])
    return plain.mapInArrow(run, made)


def as_is(documents, keep):
    return [F.struct(*[documents[c] for c in keep]).alias("as_is")] if keep else []


def similarities(a_texts, b_texts):
    """Weighted Jaccard similarity of each pair of texts."""
    sides = [weighted(*shingles(words.Words(*words.buffer_of(t)))) for t in (a_texts, b_texts)]
    n = len(a_texts)
    total = sum(np.bincount(o, weights=c, minlength=n) for _, o, c in sides)
    h, o, c = (np.concatenate(x) for x in zip(*sides))
    order = np.lexsort((h, o))
    h, o, c = h[order], o[order], c[order]
    same = np.flatnonzero((h[1:] == h[:-1]) & (o[1:] == o[:-1]))
    common = np.bincount(o[same], weights=np.minimum(c[same], c[same + 1]), minlength=n)
    return common / np.maximum(1, total - common)


def verified(pairs, texts):
    """Exact similarity of (a, b) pairs of nodes: a, b, sim."""
    first = pairs.join(texts.select(F.col("node").alias("a"), F.col("words").alias("a_words")), "a")
    both = first.join(texts.select(F.col("node").alias("b"), F.col("words").alias("b_words")), "b")

    def run(batches):
        for batch in batches:
            for row in range(0, batch.num_rows, 32):
                some = batch.slice(row, 32)
                sims = similarities(some.column("a_words"), some.column("b_words"))
                yield pa.RecordBatch.from_arrays([some.column("a"), some.column("b"), pa.array(sims)], ["a", "b", "sim"])

    return both.select("a", "b", "a_words", "b_words").mapInArrow(run, "a binary, b binary, sim double")


def stars(buckets):
    """(a, b): the first node of each bucket with every other one, once."""
    hubs = buckets.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a != z").drop("z")
    return buckets.join(hubs, "bucket").filter("node != a").select("a", F.col("node").alias("b")).distinct()


def texts_of(sketches, nodes):
    """One copy of the words of each of ``nodes``."""
    first = sketches.groupBy("node").agg(F.min("row").alias("row")).join(nodes, "node").select("row")
    return sketches.select("row", "node", "words").join(first, "row", "left_semi").select("node", "words")


def nodes_of(sketches):
    """One row per word sequence with its bands; documents without words have none."""
    return sketches.filter(F.size("bands") > 0).groupBy("node").agg(F.first("bands").alias("bands"))


def rare_shingles(texts, least):
    """(node, token, weight, place, own): the rarest shingles of each node that others share, by their place in the
    common order; own: how many of the rarest no other node has.

    A shingle that occurs c times is c tokens, so that a shared part of the multiset is a shared set of tokens.
    """

    def run(batches):
        for batch in batches:
            for row in range(0, batch.num_rows, 64):
                some = batch.slice(row, 64)
                hashes, owner, count = weighted(*shingles(words.Words(*words.buffer_of(some.column("words")))))
                which = np.repeat(np.arange(len(hashes)), count)
                nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                tokens = words.mix(hashes[which] + nth.astype(np.uint64) * np.uint64(words.BASE)).astype(np.int64)
                weight = np.bincount(owner, weights=count, minlength=some.num_rows).astype(np.int64)[owner[which]]
                nodes = some.column("node").take(pa.array(owner[which]))
                yield pa.RecordBatch.from_arrays([nodes, pa.array(tokens), pa.array(weight)], ["node", "token", "weight"])

    tokens = save(texts.select("node", "words").mapInArrow(run, "node binary, token bigint, weight bigint"), "tokens")
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("node").orderBy("df", "token")
    prefix = F.floor(F.col("weight") * (1 - least) + 1e-9) + 1
    ranked = tokens.join(common, "token").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= prefix)
    own = F.sum(F.when(F.col("df") == 1, 1).otherwise(0)).over(Window.partitionBy("node"))
    return ranked.withColumn("own", own).filter("df > 1").select("node", "token", "weight", "place", "own")


def may_link(a, b, least):
    """Whether two nodes that meet at a token can be similar enough if it is the first one they share."""
    (a_weight, a_place), (b_weight, b_place) = a, b
    most = 1 + F.least(a_weight - a_place, b_weight - b_place)
    return most >= (a_weight + b_weight) * (least / (1 + least)) - 1e-9


def relabelled(labels, links):
    """Labels after further links between nodes."""
    ends = [labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")) for c in ("a", "b")]
    between = links.join(ends[0], "a").join(ends[1], "b")
    joined_ = components(between.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")))
    return renamed(labels, joined_.select(F.col("node").alias("label"), F.col("label").alias("new")))


def renamed(labels, new):
    """Labels with the new ones of (label, new) put in."""
    return save(labels.join(new, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "labels")


def further_labels(sketches, buckets, labels, compared, least, rounds):
    """Labels after the links between components that the first stars left apart."""
    sides = buckets.join(labels, "node")
    open_ = sides.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("n"))
    nodes = sides.join(open_.filter("x != y and n > 2").select("bucket"), "bucket", "left_semi").select("node").distinct()
    nodes = save(nodes, "open-nodes")
    if not nodes.count():
        return labels
    texts = save(texts_of(sketches, nodes), "open-texts")
    rare = save(rare_shingles(texts, least), "rare")
    tried, linked = compared.select("a", "b"), False
    inner = labels.join(nodes, "node", "left_semi")

    def check(pairs, name):
        nonlocal tried, linked, inner
        ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        sims = save(verified(ordered.join(tried, ["a", "b"], "left_anti"), texts), name)
        tried = tried.unionByName(sims.select("a", "b"))
        links = sims.filter(F.col("sim") >= least).select("a", "b")
        if links.count():
            linked, inner = True, relabelled(inner, links)

    def every_pair(groups):
        columns = ("node", "label", "weight", "place")
        left = save(groups.select("token", *[F.col(c).alias(f"a_{c}") for c in columns]), "left-over")
        right = left.select("token", *[F.col(f"a_{c}").alias(f"b_{c}") for c in columns])
        apart = (F.col("a_node") < F.col("b_node")) & (F.col("a_label") != F.col("b_label"))
        meet = may_link(*[(F.col(f"{x}_weight"), F.col(f"{x}_place")) for x in "ab"], least)
        pairs = left.join(right, "token").filter(apart & meet)
        check(pairs.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")), "rest")

    for turn in range(rounds + 1):
        groups = rare.join(inner, "node")
        # First the node with the fewest shingles of its own, then others like it: each token picks another one.
        near = F.floor(F.col("own") * 16 / F.col("weight")) + F.pmod(F.xxhash64("node", "token", F.lit(turn)), F.lit(2)) * min(turn, 1)
        order = F.col("own") if turn == 0 else F.xxhash64("token", "node", F.lit(turn))
        rank = F.struct(near.alias("near"), order.alias("order"), "node", "label", "weight", "place")
        hubs = groups.groupBy("token").agg(
            F.min(rank).alias("hub"), F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).cast("double").alias("n")
        )
        hubs = save(hubs.filter("x != y").select("token", "hub", "n"), f"apart-{turn}")
        size = hubs.agg(F.sum("n").alias("rows"), F.sum(F.expr("n * (n - 1) / 2")).alias("pairs")).first()
        if size.rows is None:
            break
        if turn == rounds or size.pairs <= FEW * size.rows:
            every_pair(groups.join(hubs.select("token"), "token", "left_semi"))
            break
        apart = F.col("label") != F.col("hub.label")
        meet = may_link((F.col("weight"), F.col("place")), (F.col("hub.weight"), F.col("hub.place")), least)
        star = groups.join(hubs.select("token", "hub"), "token").filter(apart & meet)
        check(star.select(F.col("hub.node").alias("a"), F.col("node").alias("b")), f"hubs-{turn}")
    if not linked:
        return labels
    # Every link found joins open nodes, so these tell what has become of each label.
    moved = labels.join(inner.select("node", F.col("label").alias("new")), "node").filter("label != new").select("label", "new")
    return renamed(labels, moved.distinct())


def classes(documents, least=0.8, bands=BANDS, rows=ROWS, rounds=4):
    """One row per row of ``documents`` (doc_id, text): doc_id, row, class_id, class_size, kept.

    class_id is the smallest doc_id of the class; of each class one row is kept, that with the smallest doc_id (nulls
    last, then the first row). Null text counts as empty. A document without any word is like no other, so it is a class
    of its own and kept. Repeated rows are copies of each other: one is kept. ``row`` identifies rows that repeat a
    doc_id. An empty table gives an empty result; further columns are ignored.
    """
    return members_of(sketches_of(documents, bands, rows), least, rounds)


def sketches_of(documents, bands=BANDS, rows=ROWS, keep=()):
    """Sketches of all rows, stored, with the columns ``keep`` beside them."""
    made = sketched(documents, bands, rows, keep).withColumn("row", F.monotonically_increasing_id())
    return save(made, "sketches")


def one_per_class(documents, **options):
    """The rows of ``documents`` that are kept, with their columns as they are."""
    sketches = sketches_of(documents, keep=documents.columns)
    kept = members_of(sketches, **options).filter("kept").select("row")
    return sketches.join(kept, "row", "left_semi").select(*[F.col(f"as_is.{c}") for c in documents.columns])


def members_of(sketches, least=0.8, rounds=4):
    """Class of every sketched row."""
    nodes = save(nodes_of(sketches), "nodes")
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    pairs = save(stars(buckets), "pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sims = save(verified(pairs, save(texts_of(sketches, ends), "texts")), "similarities")
    links = sims.filter(F.col("sim") >= least).select("a", "b")
    first = components(links)
    labels = save(nodes.select("node").join(first, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
    labels = further_labels(sketches, buckets, labels, sims, least, rounds)

    alone = F.concat(F.lit("row "), F.col("row").cast("string")).cast("binary")
    members = sketches.select("doc_id", "row", "node", (F.size("bands") > 0).alias("worded")).join(labels, "node", "left")
    members = members.select("doc_id", "row", F.when(F.col("worded"), F.col("label")).otherwise(alone).alias("label"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    heads = members.groupBy("label").agg(F.min(rank).alias("head"), F.count(F.lit(1)).alias("class_size"))
    return members.join(heads, "label").select(
        "doc_id", "row", F.col("head.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("head.row")).alias("kept")
    )
