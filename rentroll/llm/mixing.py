"""Mixing sources to target weights by iterative proportional fitting (raking).

Every document lies in a cell (source, language, topic) and weighs its tokens. Raking finds one factor per source, per
language and per topic, so that tokens times factors have the target shares of all three margins. Languages and topics
are few, so their factors and the language x topic totals are numbers of the driver; sources may be many, so each is a
row that holds its own cells, and its factor is computed in place: one pass over the sources per iteration. The weights
are that raking. Probabilities rake the expected tokens of the budget again, where no cell gives more than it has: full
cells stay at 1 and the others take up what those lack. A document is kept when a hash of it falls below its cell's
probability, so a rerun keeps the same ones. Only column functions run.

Topics come from a list of patterns (the first that matches; ``prose`` else), as the corpus has no topic column; give
``topic``, a column expression of the documents, to use another. Null topics are ``unknown``, as null sources and languages.
"""

import math
import warnings

from pyspark.sql import functions as F

from rentroll.llm.shared import save, whole

# Topic and the pattern that marks it, in order of precedence.
TOPICS = [
    ("legal", r"(?i)\b(?:licen[cs]ed?|copyright|warranty)\b"),
    ("contact", r"[\w.]@[\w-]+\.|\+\d{1,3} ?\("),
    ("table", r"\S \| \S"),
    ("noise", r"[%&$#*!]{2}"),
]
OTHER = "prose"
UNKNOWN = "unknown"
FEATURES = ["mix_source", "mix_lang", "mix_topic", "mix_tokens", "mix_draw"]


def topic_of(text, topics=TOPICS):
    marks = F.lit(OTHER)
    for name, pattern in reversed(topics):
        marks = F.when(text.rlike(pattern), F.lit(name)).otherwise(marks)
    return marks


def featured(documents, topic=None, seed=7):
    """The row's source, language, topic (null: unknown), token count and a uniform draw in [0, 1)."""
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11) * F.lit(2.0**-53)
    return documents.withColumns({
        "mix_source": F.coalesce(F.col("source"), F.lit(UNKNOWN)),
        "mix_lang": F.coalesce(F.col("lang"), F.lit(UNKNOWN)),
        "mix_topic": topic_of(whole("text")) if topic is None else F.coalesce(topic, F.lit(UNKNOWN)),
        "mix_tokens": F.regexp_count(whole("text"), F.lit(r"\S+")).cast("bigint"),
        "mix_draw": draw,
    })


def tempered(totals, power):
    """Target shares in proportion to a power of the present ones; none for what holds no tokens."""
    raised = {k: v**power for k, v in totals.items() if v}
    return {k: v / sum(raised.values()) for k, v in raised.items()}


def numbers(values, column):
    """A small dict as a lookup of a column; 0 for others."""
    if not values:
        return F.lit(0.0)
    pairs = [F.lit(x) for k, v in values.items() for x in (k, float(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), column), F.lit(0.0))


def rake(cells, source_power=0.5, lang_targets=None, topic_targets=None, power=0.7, tolerance=1e-6, most=60):
    """Factor per cell: (source, lang, topic, tokens, factor) from cells (source, lang, topic, tokens).

    Source targets are in proportion to present tokens to ``source_power``; the other targets are given as shares or
    tempered by ``power``. Ends when a pass changes no language or topic factor by more than ``tolerance``, or after
    ``most`` passes, with a warning. Margins that no cells can meet (a target for what has no tokens) are left out.
    """
    def totals(column):
        return {r[0]: r[1] for r in cells.groupBy(column).agg(F.sum("tokens").cast("double")).collect()}

    langs, topics = totals("lang"), totals("topic")
    langs_to = {k: v for k, v in (lang_targets or tempered(langs, power)).items() if langs.get(k)}
    topics_to = {k: v for k, v in (topic_targets or tempered(topics, power)).items() if topics.get(k)}
    for shares in (langs_to, topics_to):
        shares.update({k: v / sum(shares.values()) for k, v in dict(shares).items()})

    sources = save(
        cells.filter("tokens > 0").groupBy("source").agg(
            F.sum("tokens").cast("double").alias("n"), F.collect_list(F.struct("lang", "topic", "tokens")).alias("cells")
        ),
        "sources",
    )
    wanted = F.pow("n", F.lit(source_power))
    total = sources.agg(F.sum(wanted)).first()[0] or 1.0
    v, w = dict.fromkeys(langs_to, 1.0), dict.fromkeys(topics_to, 1.0)

    def with_factor():
        held = F.aggregate(
            "cells", F.lit(0.0), lambda s, c: s + c["tokens"] * numbers(v, c["lang"]) * numbers(w, c["topic"])
        )
        return sources.withColumn("u", F.when(held > 0, wanted / total / held).otherwise(0.0))

    for _ in range(most):
        each = with_factor().select("u", F.inline("cells"))
        table = {
            (r.lang, r.topic): r.m
            for r in each.groupBy("lang", "topic").agg(F.sum(F.col("u") * F.col("tokens")).alias("m")).collect()
        }
        before = {**{("l", k): x for k, x in v.items()}, **{("t", k): x for k, x in w.items()}}
        for _ in range(20):  # both small margins in turn, on the totals of this pass
            for k in v:
                held = sum(m * w.get(t, 0.0) for (l, t), m in table.items() if l == k)
                v[k] = langs_to[k] / held if held else 0.0
            for k in w:
                held = sum(m * v.get(l, 0.0) for (l, t), m in table.items() if t == k)
                w[k] = topics_to[k] / held if held else 0.0
        after = {**{("l", k): x for k, x in v.items()}, **{("t", k): x for k, x in w.items()}}
        if all(math.isclose(before[k], x, rel_tol=tolerance) for k, x in after.items()):
            break
    else:
        moved = max((abs(x / (before[k] or 1.0) - 1) for k, x in after.items()), default=0.0)
        warnings.warn(f"raking stopped after {most} passes, the last moved a factor by {moved:.2g} of itself", stacklevel=2)
    return with_factor().select("source", "u", F.inline("cells")).select(
        "source", "lang", "topic", "tokens", (F.col("u") * numbers(v, F.col("lang")) * numbers(w, F.col("topic"))).alias("factor")
    )


def cut(wanted, there, amount):
    """Shares of an amount; what a key hasn't got goes to the others in proportion."""
    out, free = {}, dict(wanted)
    while free:
        scale = max(0.0, amount - sum(out.values())) / sum(free.values())
        full = {k: float(there[k]) for k, x in free.items() if x * scale >= there[k]}
        if not full:
            return out | {k: x * scale for k, x in free.items()}
        out |= full
        free = {k: x for k, x in free.items() if k not in full}
    return out


def probabilities(cells, budget, source_power=0.5, lang_targets=None, topic_targets=None, power=0.7, tolerance=1e-4, most=40):
    """(source, lang, topic, probability) of the cells with tokens: raking of the expected tokens with cells taken whole.

    The expected tokens are the share ``budget`` of all. A source, language or topic that has fewer than its target is
    taken whole and the others share the rest of the budget by their targets. A pass finds each source's factor with its
    full cells at 1, then moves the languages' and topics' factors by what their other cells lack. It ends when both margins
    are within ``tolerance`` of what was to be reached, or after ``most`` passes, with a warning; then the sources still hold.
    """
    def totals(column):
        return {r[0]: r[1] for r in cells.groupBy(column).agg(F.sum("tokens").cast("double")).collect()}

    amount = sum(totals("lang").values()) * budget
    langs = {k: x for k, x in (lang_targets or tempered(totals("lang"), power)).items() if x}
    topics = {k: x for k, x in (topic_targets or tempered(totals("topic"), power)).items() if x}
    cells = cells.filter(F.col("tokens") > 0).filter(F.col("lang").isin(list(langs)) & F.col("topic").isin(list(topics)))
    in_lang, in_topic = totals("lang"), totals("topic")
    langs = cut({k: x for k, x in langs.items() if k in in_lang}, in_lang, amount)
    topics = cut({k: x for k, x in topics.items() if k in in_topic}, in_topic, amount)
    sources = save(
        cells.groupBy("source").agg(
            F.sum("tokens").cast("double").alias("n"), F.collect_list(F.struct("lang", "topic", "tokens")).alias("cells")
        ),
        "bounded-sources",
    )
    share = F.pow("n", F.lit(source_power))
    ends = sources.agg(F.min(F.col("n") / share), F.max(F.col("n") / share)).first()
    if ends[0] is None:
        return cells.select("source", "lang", "topic", F.lit(1.0).alias("probability"))
    low, high = math.log(ends[0]) - 30, math.log(ends[1])  # from next to nothing to every source whole
    for _ in range(6):
        grid = [low + (high - low) * i / 32 for i in range(33)]
        reached = sources.agg(*[F.sum(F.least("n", share * math.exp(x))) for x in grid]).first()
        at = next((i for i, e in enumerate(reached) if e >= amount), 32)
        low, high = grid[max(0, at - 1)], grid[at]
    sources = sources.withColumn("wanted", F.least("n", share * math.exp(high)))
    v, w = dict.fromkeys(langs, 1.0), dict.fromkeys(topics, 1.0)

    def by_cell():
        g = F.transform("cells", lambda c: F.struct(
            c["lang"].alias("lang"), c["topic"].alias("topic"), c["tokens"].cast("double").alias("tokens"),
            (numbers(v, c["lang"]) * numbers(w, c["topic"])).alias("g"),
        ))

        def next_u(u, _):
            full = F.aggregate("g", F.lit(0.0), lambda s, c: s + F.when(u * c["g"] >= 1, c["tokens"]).otherwise(0.0))
            free = F.aggregate("g", F.lit(0.0), lambda s, c: s + F.when(u * c["g"] < 1, c["tokens"] * c["g"]).otherwise(0.0))
            return F.when(free > 0, F.greatest(u, (F.col("wanted") - full) / free)).otherwise(u)

        # a step makes at least one more cell full or ends
        steps = F.sequence(F.lit(0), F.size("cells"))
        found = sources.withColumn("g", g).withColumn("u", F.aggregate(steps, F.lit(0.0), next_u))
        return found.select("source", "u", F.inline("g")).withColumn("p", F.least(F.lit(1.0), F.col("u") * F.col("g")))

    for _ in range(most):
        held = by_cell().groupBy("lang", "topic").agg(
            F.sum(F.when(F.col("p") >= 1, F.col("tokens")).otherwise(0.0)).alias("full"),
            F.sum(F.when(F.col("p") < 1, F.col("tokens") * F.col("p")).otherwise(0.0)).alias("free"),
        ).collect()
        off = [abs(sum(r.full + r.free for r in held if r[i] == k) / x - 1) for i, to in ((0, langs), (1, topics)) for k, x in to.items()]
        if max(off) <= tolerance:
            break
        by = dict.fromkeys(v, 1.0), dict.fromkeys(w, 1.0)
        for _ in range(20):  # both small margins in turn, on the totals of this pass
            for i, to in ((0, langs), (1, topics)):
                for k, x in to.items():
                    lacks = x - sum(r.full for r in held if r[i] == k)
                    free = sum(r.free * by[1 - i][r[1 - i]] for r in held if r[i] == k)
                    by[i][k] = min(5.0, max(0.2, lacks / free)) if free else 1.0 if lacks >= -tolerance * x else 0.5
        v, w = {k: min(1e12, x * by[0][k]) for k, x in v.items()}, {k: min(1e12, x * by[1][k]) for k, x in w.items()}
    else:
        warnings.warn(f"probabilities stopped after {most} passes, a margin was off by {max(off):.2g} of itself", stacklevel=2)
    return by_cell().select("source", "lang", "topic", F.col("p").alias("probability"))


def margins(weights):
    """(margin, value, target, reached): target share of each source, language and topic, and its expected share when kept."""
    sums = [F.sum(F.col("tokens") * F.col(c)) for c in ("weight", "probability")]
    weight, kept = weights.agg(*sums).first()
    of = [
        weights.groupBy(F.lit(c).alias("margin"), F.col(c).alias("value")).agg(
            (sums[0] / F.lit(weight or 1.0)).alias("target"), (sums[1] / F.lit(kept or 1.0)).alias("reached")
        )
        for c in ("source", "lang", "topic")
    ]
    return of[0].union(of[1]).union(of[2])


def weigh(features, budget, **targets):
    """(source, lang, topic, tokens, weight, probability) for every cell of the featured documents.

    ``weight`` is a cell's target share of tokens over its present share. Cells without tokens get probability 1: there is
    nothing to weigh, and nothing clean is lost.
    """
    cells = features.groupBy(F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic")).agg(
        F.sum("mix_tokens").alias("tokens")
    )
    cells = save(cells, "cells")
    all_tokens = cells.agg(F.sum("tokens")).scalar()
    chances = save(probabilities(cells, budget, **targets), "probabilities")
    known = rake(cells, **targets).join(chances, ["source", "lang", "topic"], "left").select(
        "source", "lang", "topic", "tokens", (F.col("factor") * all_tokens).alias("weight"),
        F.coalesce("probability", F.lit(0.0)).alias("probability"),
    )
    empty = cells.filter("tokens = 0").select("source", "lang", "topic", "tokens", F.lit(0.0).alias("weight"), F.lit(1.0).alias("probability"))
    return save(known.unionByName(empty), "weights")


def with_weights(features, weights):
    names = {"source": "mix_source", "lang": "mix_lang", "topic": "mix_topic"}
    per_cell = weights.select(*[F.col(k).alias(v) for k, v in names.items()], "weight", "probability")
    return features.join(per_cell, list(names.values())).withColumn("kept", F.col("mix_draw") < F.col("probability"))


def selected(documents, topic, *more):
    """The featured rows of documents whose other columns may have any names."""
    given = [] if topic is None else [topic.alias("topic")]
    return featured(documents.select("doc_id", "text", "lang", "source", *given, *more), topic if topic is None else F.col("topic"))


def mix(documents, budget=0.5, topic=None, **targets):
    """One row per row of ``documents`` (doc_id, text, lang, source): its cell, weight, probability and ``kept``.

    ``topic`` is a column expression of the documents' columns (default: ``topic_of`` the text). Null source, lang, topic or
    text count as unknown and empty. Repeated rows share their draw, so all or none are kept. An
    empty table gives an empty result.
    """
    features = save(selected(documents, topic).select("doc_id", *FEATURES), "features")
    found = with_weights(features, weigh(features, budget, **targets))
    return found.select(
        "doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"),
        F.col("mix_tokens").alias("n_tokens"), "weight", "probability", "kept",
    )


def sample(documents, budget=0.5, topic=None, **targets):
    """The rows of ``documents`` that the mix keeps, with their columns as they are."""
    row = F.struct(*[documents[c] for c in documents.columns]).alias("row")  # its columns may have names used here
    features = selected(documents, topic, row).select("row", *FEATURES)
    found = with_weights(features, weigh(features, budget, **targets))
    return found.filter("kept").select(*[F.col(f"row.{c}") for c in documents.columns])
