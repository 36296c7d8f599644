"""Token counts equal the tokenizer's, for any number of hot pre-tokens."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortlens.llm.queries import QUERIES
from cohortlens.llm.tokencount import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def plain(rows):
    tok = Tokenizer.from_file(PATH)
    return sorted(
        (str(i), len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in rows
    )


def result(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in df.collect())


@pytest.mark.parametrize("hot", [0, 3, 1 << 16])
def test_small_texts(spark, hot):
    rows = [(1, None), (2, ""), (3, "one two  three\n\n don't"), (3, "one two  three\n\n don't"), (None, "x<|endoftext|>y \0 12"),
            (5, "ab " * 9000), (6, "z" * 3000), (7, "été 中文 😀")] + [(i, "the same words here") for i in range(100, 160)]
    docs = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id bigint, text string, pretoken string, n int")
    assert result(token_counts(docs, PATH, hot=hot)) == plain(rows)


def test_query_over_all_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert result(QUERIES["op8_token_counts"](spark, SF)) == plain(rows)


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0
