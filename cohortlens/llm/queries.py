"""Registered queries of the numbered operators: ``opN_<name>`` and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.hashing import sql_h52, sql_uniform
from cohortlens.llm.chat import chat_digests, format_chats, turn_rows
from cohortlens.llm.common import read
from cohortlens.llm.exact import exact_duplicates
from cohortlens.llm.hostrules import judge
from cohortlens.llm.langid import identify_languages
from cohortlens.llm.mixing import SEED, poisson_mixture
from cohortlens.llm.packing import best_fit_packing
from cohortlens.llm.sharding import histogram_shards
from cohortlens.llm.simhash import near_duplicates
from cohortlens.llm.template import main_texts
from cohortlens.llm.tokencount import token_counts
from cohortlens.llm.toxicity import toxicity
from cohortlens.llm.trie import prefix_trie, turn_sequences, with_borrowed_heads
from cohortlens.llm.whitening import whitened_components
from cohortlens.session import ensure_checkpoint_dir

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_checkpoint_dir(spark)
            return fn(spark, sf_dir)

        wrapped.__name__, wrapped.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = wrapped
        if sql:
            ORACLE[name] = sql
        return wrapped

    return deco


@query(
    "op3_exact_dedup",
    """
    WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
)
def op3_exact_dedup(spark, d):
    """Exact duplicates of all documents through a new digest index, in batches of falling doc_id."""
    return exact_duplicates(read(spark, d, "documents"))


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark, d):
    """Pieces of all documents packed into sequences of 1024 tokens."""
    return best_fit_packing(read(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op8_token_counts")
def op8_token_counts(spark, d):
    """Tokens of every document by the 50k byte-level vocabulary."""
    return token_counts(read(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op2_simhash_near_dedup")
def op2_simhash_near_dedup(spark, d):
    """SimHash components of all documents: 3-word shingles, 3 bits."""
    return near_duplicates(read(spark, d, "documents"), words=3, max_bits=3)


@query(
    "op7_poisson_mixing",
    f"""
    WITH RECURSIVE sizes AS (
        SELECT source, sum(coalesce(strlen(text), 0)) AS bytes FROM documents GROUP BY source HAVING sum(coalesce(strlen(text), 0)) > 0),
    rates AS (
        SELECT source, 1.0::DOUBLE / (SELECT count(*)::DOUBLE FROM sizes) * (SELECT sum(bytes)::DOUBLE FROM sizes) / bytes AS rate
        FROM sizes),
    part AS (SELECT source, rate, greatest(1, ceil(rate / 32.0))::INT AS parts, rate / greatest(1, ceil(rate / 32.0)) AS r FROM rates),
    cdf AS (
        SELECT source, r, 0 AS k, exp(-r) AS p, exp(-r) AS c FROM part
        UNION ALL
        SELECT source, r, k + 1, p * r / (k + 1), c + p * r / (k + 1) FROM cdf WHERE c <= 1 - 1e-13),
    drawn AS (
        SELECT d.doc_id, d.source, coalesce(strlen(text), 0) AS n_bytes, rate, parts,
               {sql_uniform(SEED, "d.doc_id", "j.j")} AS u
        FROM documents d JOIN part ON d.source IS NOT DISTINCT FROM part.source, unnest(range(1, parts + 1)) AS j(j)),
    counted AS (
        SELECT w.doc_id, w.source, n_bytes, rate,
               count(c.k) AS copies
        FROM drawn w LEFT JOIN cdf c ON w.source IS NOT DISTINCT FROM c.source AND c.c <= least(w.u, 1 - 1e-13)
        GROUP BY ALL)
    SELECT doc_id, source, n_bytes, round(rate, 6) AS rate, copies, copy,
           {sql_h52(SEED, "'order'", "doc_id", "copy")} AS shuffle_key
    FROM counted, unnest(range(1, copies + 1)) AS x(copy)
    """,
)
def op7_poisson_mixing(spark, d):
    """All documents replicated to equal byte shares of the sources, and shuffled."""
    return poisson_mixture(read(spark, d, "documents"))


@query("op5_histogram_sharding")
def op5_histogram_sharding(spark, d):
    """All documents in 40 shards of near equal bytes."""
    return histogram_shards(read(spark, d, "documents"), shards=40)


@query(
    "op6_host_rules",
    """
    WITH w AS (
        SELECT rowid_ AS r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM (
            SELECT row_number() OVER () AS rowid_, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents)),
    d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
    g AS (
        SELECT r, i, CASE WHEN lead(word, 4) OVER o IS NOT NULL THEN
            concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) END AS gram
        FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
    twice AS (SELECT r, i, gram IS NOT NULL AND count(*) OVER (PARTITION BY r, gram) > 1 AS dup FROM g),
    covered AS (SELECT r, max(dup::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM twice),
    rep AS (SELECT r, sum(c) AS n_repeat_words FROM covered GROUP BY r),
    words AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY r),
    lines AS (
        SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
        FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
    f AS (
        SELECT d.doc_id, d.source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
               length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
               coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
        FROM d LEFT JOIN words USING (r) LEFT JOIN rep USING (r) LEFT JOIN lines USING (r)),
    t AS (
        SELECT *, n_words < 10 AS f1, 100 * n_repeat_words > 20 * n_words AS f2, 10 * n_symbols > word_chars AS f3,
               100 * n_dup_lines > 30 * n_lines AS f4 FROM f),
    h AS (
        SELECT source, count(*)::DOUBLE AS n, [sum(f1::INT), sum(f2::INT), sum(f3::INT), sum(f4::INT)]::DOUBLE[] AS ks
        FROM t GROUP BY source),
    k AS (SELECT source, n, unnest(ks) AS k, unnest([1, 2, 3, 4]) AS rule FROM h),
    mv AS (SELECT rule, avg(k / n) AS m, var_pop(k / n) AS v FROM k GROUP BY rule),
    s AS (SELECT rule, m, CASE WHEN v <= 1e-12 THEN 1e6 ELSE least(1e6, greatest(0, m * (1 - m) / v - 1)) END AS s FROM mv),
    post AS (SELECT source, n + s AS weight, m, (k + m * s) / (n + s) AS rate FROM k JOIN s USING (rule)),
    host AS (
        SELECT source, max(rate) AS host_rate,
               bool_or(rate - 3 * sqrt(rate * (1 - rate) / (weight + 1)) > least(0.5::DOUBLE, greatest(0.2::DOUBLE, 3 * m))) AS host_bad
        FROM post GROUP BY source)
    SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
           f1 OR f2 AS base_failed, NOT (f1 OR f2) AND NOT host_bad AS kept, round(host_rate, 6) AS host_rate, host_bad
    FROM t JOIN host ON t.source IS NOT DISTINCT FROM host.source
    """,
)
def op6_host_rules(spark, d):
    """Rules on all documents, failure rates per host, and host verdicts."""
    return judge(read(spark, d, "documents"))


@query("op1_language_id")
def op1_language_id(spark, d):
    """Language of every whole text by character models learned from two thirds of the documents."""
    return identify_languages(read(spark, d, "documents"))


@query("op9_toxicity_chain")
def op9_toxicity_chain(spark, d):
    """Toxicity of every document by a classifier chain fitted on labelled rows."""
    return toxicity(read(spark, d, "documents"), read(spark, d, "labels"))


@query("op10_template_extraction")
def op10_template_extraction(spark, d):
    """Main text of all pages through their hosts' templates."""
    return main_texts(read(spark, d, "pages"))


#: conversation -7 of the contract: both of its turns say this
CONTROL_TEXT = "\\### Assistant: </turn> ok"


@query(
    "op13_chat_formatting",
    r"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, 'messages' AS layout FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', 'prompt_response'
        UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', 'prompt_response'),
    e AS (
        SELECT *, CASE WHEN role IN ('user', 'assistant', 'system') THEN role ELSE '=' || url_encode(role) END AS label,
               replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>') AS escaped FROM t)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
           sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
           sum(length('### ' || label || ': ' || escaped || chr(10) || '</turn>' || chr(10)))::BIGINT AS formatted_chars,
           any_value(layout) AS layout
    FROM e GROUP BY conv_id
    """,
)
def op13_chat_formatting(spark, d):
    """All conversations, and one full of control strings, formatted and read back."""
    rows = turn_rows(read(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    control = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(CONTROL_TEXT).alias("prompt"), F.lit(CONTROL_TEXT).alias("response"))
    records = rows.unionByName(control, allowMissingColumns=True)
    return chat_digests(format_chats(records), "conv_id")


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark, d):
    """All usable embeddings on the four leading components of the distinct vectors, at unit variance."""
    return whitened_components(read(spark, d, "embeddings"), "vec_id", "embedding", components=4)


@query(
    "op11_conversation_trie",
    """
    WITH own AS (
        SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
        FROM conversations WHERE conv_id IS NOT NULL),
    crc AS (
        SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''),
                   lambda x: list_prepend(ascii(x)::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
                   lambda a, o: CASE WHEN o >= 0 THEN xor(a, o) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 6 AS h
        FROM (SELECT DISTINCT c FROM own)),
    taken AS (SELECT crc.c, h, count(hub.pos) AS k FROM crc LEFT JOIN own hub ON hub.c = crc.c - crc.c % 100 AND hub.pos <= h GROUP BY ALL),
    turns AS (
        SELECT taken.c, hub.pos AS d, role, text FROM taken JOIN own hub ON hub.c = taken.c - taken.c % 100 AND hub.pos <= h
        UNION ALL
        SELECT c, pos - h + k, role, text FROM taken JOIN own USING (c) WHERE pos > h),
    paths AS (
        SELECT c, d, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY d)) AS key, length(text) AS len
        FROM turns
        UNION ALL SELECT c, 0, '', 0 FROM taken),
    long_ AS (SELECT c, max(d) AS n FROM paths GROUP BY c),
    ends AS (SELECT key, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS h FROM paths JOIN long_ USING (c) WHERE d = n GROUP BY key),
    nodes AS (SELECT key, d AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(len) AS len FROM paths GROUP BY key, d),
    up AS (
        SELECT n.*, q.key AS parent, pn.conv_id AS parent_conv_id
        FROM nodes n LEFT JOIN paths q ON q.c = n.conv_id AND q.d = n.depth - 1 LEFT JOIN nodes pn ON pn.key = q.key),
    kids AS (SELECT parent AS key, count(*) AS n_children FROM up WHERE parent IS NOT NULL GROUP BY parent),
    sums AS (
        SELECT a.key, sum((k.key IS NULL)::INT) AS n_leaves, sum((m.n_convs - 1) * m.len) AS saved_tokens
        FROM nodes m JOIN paths a ON a.c = m.conv_id AND a.d <= m.depth LEFT JOIN kids k ON k.key = m.key GROUP BY a.key)
    SELECT conv_id, depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves::BIGINT AS n_leaves,
           saved_tokens::BIGINT AS saved_tokens, coalesce(ends.h, sha256('')) AS ends_sha256
    FROM up JOIN sums USING (key) LEFT JOIN kids USING (key) LEFT JOIN ends USING (key)
    """,
)
def op11_conversation_trie(spark, d):
    """Trie of all conversations, each begun with turns of the hundred's first."""
    turns = turn_sequences(read(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return prefix_trie(*with_borrowed_heads(turns))
