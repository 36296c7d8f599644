"""The corpus pipeline: raw documents to packed training sequences.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and reread as the next
one's ``docs``.  All but the last return the columns of ``documents``.

1. documents whose language is rejected go;
2. of equal texts the row with the largest doc_id stays;
3. of each SimHash component (3-word shingles, 3 bits) the row with the
   smallest doc_id stays;
4. documents are repeated or left out by Poisson draws, so that all sources
   have equal byte shares, and shuffled;
5. what remains is packed into sequences of 1024 tokens.

An empty table passes through every stage as an empty table; nulls, repeated
rows and extra columns are treated as each operator's module states.
"""

from __future__ import annotations

import public_tokenizers

from cohortlens.llm.common import read, staged
from cohortlens.llm.exact import drop_exact_duplicates
from cohortlens.llm.langid import drop_rejected
from cohortlens.llm.mixing import mix_documents
from cohortlens.llm.packing import best_fit_packing
from cohortlens.llm.simhash import drop_near_duplicates
from cohortlens.session import ensure_checkpoint_dir

TOKENIZER = "byte_bpe_50k.json"


def language_id(spark, docs, sf_dir):
    """Documents of an accepted language."""
    ensure_checkpoint_dir(spark)
    return drop_rejected(docs)


def exact_dedup(spark, docs, sf_dir):
    """One row of each text."""
    ensure_checkpoint_dir(spark)
    return drop_exact_duplicates(docs)


def simhash_near_dedup(spark, docs, sf_dir):
    """One row of each group of near duplicates."""
    ensure_checkpoint_dir(spark)
    return drop_near_duplicates(docs, words=3, max_bits=3)


def poisson_mixing(spark, docs, sf_dir):
    """Documents as often as their source's rate has them drawn."""
    ensure_checkpoint_dir(spark)
    return mix_documents(docs)


def packing(spark, docs, sf_dir):
    """Pieces of all documents and their places in sequences."""
    ensure_checkpoint_dir(spark)
    return best_fit_packing(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("poisson_mixing", poisson_mixing),
    ("best_fit_packing", packing),
]

#: language models and tokens are beyond SQL; tests/llm/test_pipeline.py holds the result against a plain version
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
