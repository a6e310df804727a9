"""A corpus pipeline: toxicity, exact dedup, near-dedup, decontamination, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents. Rows without an
identifier or text pass through each stage as its operator defines.
"""

from netloom.llm import op01_simhash, op02_decontaminate, op03_exact_dedup, op05_packing, op08_toxicity
from netloom.llm.common import Stages, table


def toxicity(spark, docs, sf_dir):
    """Documents that the classifier rejects go."""
    return op08_toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark, docs, sf_dir):
    """Of equal texts the document with the smallest identifier stays."""
    return op03_exact_dedup.keep_first(docs)


def simhash(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays."""
    return op01_simhash.keep_one(docs)


def decontaminate(spark, docs, sf_dir):
    """Documents that hold a benchmark item, within its error budget, go."""
    return op02_decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark, docs, sf_dir):
    """Pieces of what is left, packed into sequences of at most 2048 tokens."""
    return op05_packing.pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("simhash", simhash), ("decontaminate", decontaminate), ("packing", packing)]

#: SQL can express neither the classifier nor the edit matching nor the packing.
ORACLE_SQL = None


def run(spark, sf_dir):
    """STAGES applied to the documents of sf_dir."""
    stages, docs = Stages(spark, "pipeline"), table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stages.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
