"""Benchmark decontamination: short test items inside long documents.

Items and documents are sets of shingles (five consecutive words, of their own length for shorter items). An item is
found in a document when the document holds at least ``least`` of its shingles, wherever they stand.

Items are partitioned by size. The MinHash sketch of an item is its k shingles with the smallest hashes, k by partition:
one more than the largest number of shingles that an item of that partition may lack. So a document that holds enough of
an item holds a shingle of its sketch, whatever the document's length: the search loses nothing. Spark joins the hashed
shingles of all documents to the sketches; documents with a hit are candidates for the item, and only their texts are
read again and compared on the shingles themselves. Each pass reads the documents once, for shingles of all widths in use.

Sketches are stored before they are joined, so Spark knows their size: it broadcasts them while they are below
``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise. Only column functions run.
"""

from pyspark.sql import functions as F

from rentroll.llm.shared import save, whole

SHINGLE = 5
SIZES = (8, 16, 32, 64, 128, 256, 512, 1024)  # upper bounds of the partitions, in shingles


def words_of(column):
    """Words of a text: runs of ASCII letters and digits and of non-ASCII characters, lower-cased."""
    return F.filter(F.split(F.lower(whole(column)), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), lambda w: w != "")


def starts(size):
    """Places where a shingle of ``size`` words begins in ``words``; none in shorter texts."""
    n = F.size("words")
    return F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))


def hashed(size):
    """Hash of each shingle of ``words``."""
    return F.transform(starts(size), lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(size)]))


def spelled(size):
    """Each shingle of ``words`` as text."""
    return F.transform(starts(size), lambda i: F.concat_ws(" ", *[F.get("words", i + j) for j in range(size)]))


def item_shingles(benchmark):
    """(item, width, shingle, hash) once per distinct shingle; items without a word have none."""
    worded = benchmark.select("item_id", words_of("text").alias("words")).filter(F.size("words") > 0)
    item = F.xxhash64("words").alias("item")  # items that repeat a text are one
    width = F.least(F.size("words"), F.lit(SHINGLE))
    spelled_out = F.coalesce(*[F.when(width == k, spelled(k)) for k in range(1, SHINGLE + 1)])
    hashes = F.coalesce(*[F.when(width == k, hashed(k)) for k in range(1, SHINGLE + 1)])
    both = worded.select("item_id", item, width.alias("width"), F.arrays_zip(spelled_out.alias("shingle"), hashes.alias("hash")).alias("s"))
    return both.select("item_id", "item", "width", F.inline("s"))


def sketches(shingles, least):
    """(hash, item, width): the smallest hashes of every item, as many as its size partition asks for."""
    items = shingles.groupBy("item", "width").agg(F.sort_array(F.collect_set("hash")).alias("hashes"))
    n = F.size("hashes")
    upper = F.coalesce(*[F.when(n <= b, F.lit(b)) for b in SIZES], n)
    k = F.floor(upper * (1 - least) + 1e-9).cast("int") + 1
    return items.select("item", "width", F.explode(F.slice("hashes", F.lit(1), k)).alias("hash"))


def find(documents, benchmark, least=0.8):
    """Pairs (doc_id, item_id, n_shingles, n_found, containment) with a containment of at least ``least``.

    ``documents`` has doc_id and text, ``benchmark`` item_id and text; further columns are ignored. Null and wordless
    texts hold nothing and are found nowhere. Items that repeat a text are all reported. Every row of ``documents`` is judged
    by its own text; of rows that share a doc_id, or have none, the one that holds most of an item is reported for it.
    Empty tables give an empty result.
    """
    shingles = save(item_shingles(benchmark), "item-shingles")
    widths = [r.width for r in shingles.select("width").distinct().collect()]  # at most five numbers
    index = save(sketches(shingles, least), "item-sketches")
    inside = shingles.select("item", "shingle").distinct()
    sizes = inside.groupBy("item").agg(F.count(F.lit(1)).alias("n_shingles"))

    if not widths:
        return no_pairs(documents.sparkSession)
    # A row is known by its doc_id and two hashes of its text: rows that agree in them hold the same.
    digests = F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")
    texts = documents.select("doc_id", "text", *digests)
    grams = F.concat(*[hashed(w) for w in widths])
    worded = texts.select("doc_id", "a", "b", words_of("text").alias("words"))
    hits = worded.select("doc_id", "a", "b", F.explode(grams).alias("hash")).join(index.select("hash").distinct(), "hash")
    candidates = save(hits.select(F.col("doc_id").alias("c"), "a", "b").distinct(), "candidate-documents")

    same = [texts.a == candidates.a, texts.b == candidates.b, texts.doc_id.eqNullSafe(candidates.c)]
    again = texts.join(candidates, same, "left_semi").select("doc_id", "a", "b", words_of("text").alias("words"))
    spelt = F.concat(*[spelled(w) for w in widths])  # its spaces tell the width of a shingle
    found = again.select("doc_id", "a", "b", F.explode(F.array_distinct(spelt)).alias("shingle")).join(inside, "shingle")
    held = found.select("doc_id", "a", "b", "item", "shingle").distinct()
    held = held.groupBy("doc_id", "a", "b", "item").agg(F.count(F.lit(1)).alias("n_found"))
    best = held.groupBy("doc_id", "item").agg(F.max("n_found").alias("n_found")).join(sizes, "item")
    kept = best.filter(F.col("n_found") >= F.col("n_shingles") * least - 1e-9)
    names = shingles.select("item", "item_id").distinct()
    return kept.join(names, "item").select(
        "doc_id", "item_id", "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment")
    )


def no_pairs(spark):
    kinds = "doc_id bigint, item_id bigint, n_shingles bigint, n_found bigint, containment double"
    return spark.createDataFrame([], kinds)


def clean(documents, benchmark, least=0.8):
    """The rows of ``documents`` that hold no benchmark item, each row judged by its own text, whatever its doc_id."""
    row = F.struct(*[documents[c] for c in documents.columns]).alias("row")  # its columns may have names used here
    rows = save(documents.select(F.monotonically_increasing_id().alias("n"), row), "rows")
    texts = rows.select(F.col("n").alias("doc_id"), F.col("row.text").alias("text"))
    held = find(texts, benchmark, least).select(F.col("doc_id").alias("n")).distinct()
    return rows.join(held, "n", "left_anti").select(*[F.col(f"row.{c}") for c in documents.columns])
