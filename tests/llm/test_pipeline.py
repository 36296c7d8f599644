"""The pipeline against a plain version of its stages, and on degenerate tables."""

from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from cohortlens.llm.langid import identify_languages
from cohortlens.llm.mixing import source_rates
from tests.llm.test_mixing import plain_count
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def staged_run(spark, docs, path):
    out = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.mode("overwrite").parquet(f"{path}/{i}")
        docs = spark.read.parquet(f"{path}/{i}")
        out.append(docs)
    return out


def test_against_plain_stages(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    stages = staged_run(spark, table, tmp_path)
    assert all(s.columns == table.columns for s in stages[:-1])
    docs = {r.doc_id: r for r in table.collect()}
    refused = {r.doc_id for r in identify_languages(table).collect() if r.rejected}
    docs = {i: r for i, r in docs.items() if i not in refused}
    assert {r.doc_id for r in stages[0].collect()} == set(docs)
    last = {r.text: i for i, r in sorted(docs.items())}
    docs = {i: r for i, r in docs.items() if last[r.text] == i}
    assert sorted(r.doc_id for r in stages[1].collect()) == sorted(docs)
    fp = {i: plain_fingerprint(r.text) for i, r in docs.items()}
    root, least = plain_components(fp.values()), {}
    for i in sorted(docs):
        least.setdefault(root[fp[i]], i)
    docs = {i: docs[i] for i in least.values()}
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(docs)
    rate = {r.source: r.rate for r in source_rates(stages[2]).collect()}
    copies = Counter({i: plain_count(i, rate[r.source]) for i, r in docs.items() if r.source in rate})
    assert Counter(r.doc_id for r in stages[3].collect()) == +copies
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, n in copies.items():
        want[i] = n * (len(tok.encode(docs[i].text, add_special_tokens=False).ids) + 1)
    got, used = Counter(), Counter()
    for r in stages[4].collect():
        got[r.doc_id] += r.length
        used[r.sequence_id] += r.length
    assert got == +want and max(used.values()) <= 1024


def test_degenerate_rows_pass(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    odd = [(9001, None, None, None, None), (9002, "", "en", "src0", 0), (None, "the and of the", "en", None, 3), (9003, "Is the of and the thing", "en", "src1", 1),
           (9003, "Is the of and the thing", "en", "src1", 1), (9004, "of the thing " * 30_000, None, "src2", 5)]
    both = table.union(spark.createDataFrame(odd, table.schema)).selectExpr("*", "1 AS fp", "'x' AS offset", "true AS kept")
    stages = staged_run(spark, both, tmp_path)
    assert all(s.columns == both.columns for s in stages[:-1]) and stages[4].count() > 0
    kept = Counter(r.doc_id for r in stages[1].collect())
    assert not kept[9001] and not kept[9002] and kept[9003] == 1


def test_empty_table(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert [s.count() for s in staged_run(spark, table, tmp_path)] == [0] * 5


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
