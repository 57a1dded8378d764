"""The corpus pipeline: toxicity, exact and near duplicates, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but
the last return the columns of documents.
"""

import public_tokenizers

from itemscope.llm import decontamination, exact_dedup, packing, simhash, toxicity
from itemscope.llm.common import table
from itemscope.session import ship_package, written


def reject_toxic(spark, docs, sf_dir):
    """Documents that the toxicity model, learned from the labels of `docs`, does not reject."""
    ship_package(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark, docs, sf_dir):
    """One document of each group of texts that are equal up to white space."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark, docs, sf_dir):
    """One document of each group of texts that SimHash links."""
    ship_package(spark)
    return simhash.without_near_copies(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Documents without a passage of the benchmark."""
    ship_package(spark)
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark, docs, sf_dir):
    """Pieces of the documents in sequences of 1024 tokens."""
    ship_package(spark)
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), length=1024)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
#: Learned scores, SimHash and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents, each written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
