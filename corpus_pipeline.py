"""Documents to token files: reject, deduplicate, decontaminate, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read back as the next one's
``docs``. All but the last return the columns of ``documents``.
"""

import public_tokenizers

from rentroll.llm import decontaminate, mixing, near_dedup, shared, token_files, toxicity


def toxic_out(spark, docs, sf_dir):
    """Documents that the lexicon predicts to be toxic go."""
    shared.reachable(spark)
    return toxicity.without_toxic(docs, shared.table(spark, sf_dir, "labels"))


def one_of_each(spark, docs, sf_dir):
    """Of each class of near-duplicates the document with the smallest doc_id stays."""
    shared.reachable(spark)
    return near_dedup.one_per_class(docs)


def benchmark_out(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, shared.table(spark, sf_dir, "benchmark"))


def mixed(spark, docs, sf_dir):
    """A sample that meets the target weights of sources, languages and topics."""
    return mixing.sample(docs)


def encoded(spark, docs, sf_dir):
    """Token files of what is left, read back: doc_id, start, n_tokens, ids_crc32."""
    shared.reachable(spark)
    return token_files.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


STAGES = [
    ("toxicity", toxic_out),
    ("near_dedup", one_of_each),
    ("decontamination", benchmark_out),
    ("mixing", mixed),
    ("token_files", encoded),
]

#: No SQL: the first two stages learn a model and sketch texts. tests/llm/test_texts.py holds run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages on ``documents``; each result is stored in the shared folder before the next stage reads it."""
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.save(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
