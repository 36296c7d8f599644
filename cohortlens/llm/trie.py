"""11 Conversation prefix trie: burst tries over turn ids.

A turn id is a 128-bit digest of role and text.  Copies of a whole conversation
become one weighted sequence first.  All sequences start in one container below
the root.  An *oversized* container (more than ``CONTAINER_ROWS`` turns of
several sequences) bursts: the turns that all its sequences share become the
nodes of its trie head, and each next turn id after them takes its suffixes into
a container of its own.  So a shared passage of any length costs one round, and
the rounds are the branchings on the way to containers that fit.  The rest is
settled: a container of one sequence is a chain, whose nodes are its rows; a
container of several is sorted and swept into nodes in one task's memory, which
``CONTAINER_ROWS`` bounds.  Totals of subtrees then climb the heads, one
grouping per round.

No task holds a conversation or a group whole: positions come from ranks in
range partitions plus offsets, joins by conversation go by (conversation, slice
of positions), joins by container are salted.  The digest of the ids that end at
a node is one hash over an ordered list, so each list streams through one task
as sorted runs made by many.

Defined results: turns are ordered by turn, null first, equal turns by the
digest of role and text; repeated rows all count; null role and text are empty.
Rows of a null conversation id belong to no conversation.  An empty table has no
nodes, not even a root.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import numbered, staged, text_or_empty

#: turns of a container of several sequences that one task sorts and sweeps
CONTAINER_ROWS = 4096
#: positions of one conversation that a join meets in one task
SLICE = 4096
#: tasks over which the sequences of one container are dealt in joins
SALTS = 8
#: conversation ids in one run of a list to be digested
RUN_IDS = 256

END = "X''"
CHAIN, SWEPT, BURST = 1, 2, 3


def _end(col: str = "tid") -> Column:
    return F.length(col) == 0


# ---------------------------------------------------------------- turns and sequences
def turn_sequences(df: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, pos, tid, len, cum): turns of each conversation from 1, their ids, code points and running code points."""
    said = F.concat(F.char_length(text_or_empty(role)).cast("string"), F.lit(":"), text_or_empty(role), text_or_empty(text))
    turns = df.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
        F.unhex(F.substring(F.sha2(said.cast("binary"), 256), 1, 32)).alias("tid"),
        F.char_length(text_or_empty(text)).cast("long").alias("len"))
    turns = staged(numbered(turns), "turns")
    order = ["turn", "tid", "__cl_row"]
    ranged = staged(turns.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns-ranged")
    here = Window.partitionBy("part", "conv_id").orderBy(*order)
    local = ranged.select("part", "conv_id", "tid", "len", F.row_number().over(here).cast("long").alias("at"),
                          F.sum("len").over(here.rowsBetween(Window.unboundedPreceding, 0)).alias("chars"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part", "conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("c")).select(
        "part", "conv_id", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c0"))
    out = local.join(offsets, ["part", "conv_id"]).select(
        "conv_id", (F.col("at") + F.col("n0")).alias("pos"), "tid", "len", (F.col("chars") + F.col("c0")).alias("cum"))
    return staged(out, "turn-sequences")


def sliced_join(rows: DataFrame, table: DataFrame, key: str, last: str) -> DataFrame:
    """Rows with ``pos`` joined to the table's row of their key; a long key's rows are spread by slices up to ``last``."""
    a = rows.withColumn("__cl_slice", F.floor(F.col("pos") / SLICE))
    b = table.withColumn("__cl_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col(last) / SLICE))))
    return a.join(b, [key, "__cl_slice"]).drop("__cl_slice")


def salted_join(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows with ``seq`` joined to the table's row of their key; rows of one key are dealt over ``SALTS`` tasks."""
    a = rows.withColumn("__cl_salt", F.pmod(F.xxhash64("seq"), F.lit(SALTS)).cast("int"))
    b = table.withColumn("__cl_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return a.join(b, [key, "__cl_salt"]).drop("__cl_salt")


def with_borrowed_heads(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Every conversation c begins with the first h turns of conversation c - c % every; h = crc32(c) % most.

    Returns its turns as ``turn_sequences`` does, and (conv_id, n): all conversations, also those left without turns.
    """
    head = F.when(F.col("pos") < most, F.struct("pos", "tid", "len", "cum"))
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("own"), F.sort_array(F.collect_list(head)).alias("head"))  # at most five turns each
    convs = convs.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % most)).withColumn("hub", F.col("conv_id") - F.col("conv_id") % every)
    hubs = convs.select(F.col("conv_id").alias("hub"), F.col("head").alias("hub_head"))

    def first(col):
        return F.filter(F.coalesce(F.col(col), F.array().cast("array<struct<pos:bigint,tid:binary,len:bigint,cum:bigint>>")), lambda t: t["pos"] <= F.col("h"))

    def chars(col):
        return F.coalesce(F.array_max(F.transform(col, lambda t: t["cum"])), F.lit(0))

    plan = convs.join(hubs, "hub", "left").withColumn("borrowed", first("hub_head")).withColumn("cut", first("head"))
    plan = staged(plan.select("conv_id", "own", "borrowed", (F.size("borrowed") - F.col("h")).alias("shift"),
                              (chars("borrowed") - chars("cut")).alias("more"),
                              (F.size("borrowed") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "rebuilt")
    rest = turns.where(F.col("pos") > F.crc32(F.col("conv_id").cast("string")) % most)
    rest = sliced_join(rest, plan.select("conv_id", "own", "shift", "more"), "conv_id", "own").select(
        "conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "tid", "len", (F.col("cum") + F.col("more")).alias("cum"))
    rebuilt = plan.select("conv_id", F.inline("borrowed")).unionByName(rest)
    return staged(rebuilt, "rebuilt-turns"), plan.select("conv_id", "n")


def distinct_sequences(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Digest of each conversation (d1, d2, n), and per digest its smallest member ``seq`` and its number ``w``."""
    prints = turns.groupBy("conv_id").agg(
        F.bit_xor(F.xxhash64(F.lit(1), "pos", "tid")).alias("d1"), F.bit_xor(F.xxhash64(F.lit(2), "tid", "pos")).alias("d2"),
        F.count(F.lit(1)).alias("n"), F.max("cum").alias("total"))
    members = convs.select("conv_id").join(prints, "conv_id", "left").fillna(0, subset=["d1", "d2", "n", "total"])
    members = staged(members, "members")
    seqs = members.groupBy("d1", "d2", "n").agg(F.min("conv_id").alias("seq"), F.count(F.lit(1)).alias("w"), F.max("total").alias("total"))
    return members, staged(seqs, "sequences")


def end_digests(members: DataFrame) -> DataFrame:
    """(d1, d2, n, ends_sha256): the ids of each group in numerical order, comma-joined, digested."""
    key = ["d1", "d2", "n"]

    def runs(batches: Iterator[pa.RecordBatch]):
        group, ids, out = None, [], []
        for b in batches:
            for *g, c in zip(*[b.column(i).to_pylist() for i in range(4)]):
                if g != group or len(ids) == RUN_IDS:
                    if ids:
                        out.append((*group, ids[0], ",".join(map(str, ids))))
                    group, ids = g, []
                ids.append(c)
            if len(out) >= 1024:
                yield _batch(out, run_schema)
                out = []
        if ids:
            out.append((*group, ids[0], ",".join(map(str, ids))))
        yield _batch(out, run_schema)

    def digest(batches: Iterator[pa.RecordBatch]):
        group, sha, out = None, None, []
        for b in batches:
            for *g, _, ids in zip(*[b.column(i).to_pylist() for i in range(5)]):
                if g != group:
                    if group:
                        out.append((*group, sha.hexdigest()))
                    group, sha = g, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield _batch(out, digest_schema)
            out = []
        if group:
            yield _batch([(*group, sha.hexdigest())], digest_schema)

    longs = [(c, pa.int64()) for c in key]
    run_schema = pa.schema([*longs, ("first", pa.int64()), ("ids", pa.string())])
    digest_schema = pa.schema([*longs, ("ends_sha256", pa.string())])
    ordered = members.select(*key, "conv_id").repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
    made = ordered.mapInArrow(runs, "d1 long, d2 long, n long, first long, ids string")
    return made.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(digest, "d1 long, d2 long, n long, ends_sha256 string")


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


# ---------------------------------------------------------------- burst trie
def _suffix_rows(turns: DataFrame, seqs: DataFrame) -> DataFrame:
    """Turns of each sequence, with the root before them (position 0) and an end mark after them (empty id)."""
    info = seqs.select(F.col("seq").alias("conv_id"), "w", "n", "total")
    real = sliced_join(turns, info, "conv_id", "n").withColumnRenamed("conv_id", "seq")
    cols = ["seq", "w", "n", "total", "pos", "tid", "len", "cum"]
    root = seqs.select("seq", "w", "n", "total", F.lit(0).cast("long").alias("pos"), F.encode(F.lit("root"), "UTF-8").alias("tid"),
                       F.lit(0).cast("long").alias("len"), F.lit(0).cast("long").alias("cum"))
    end = seqs.select("seq", "w", "n", "total", (F.col("n") + 1).alias("pos"), F.expr(END).alias("tid"),
                      F.lit(0).cast("long").alias("len"), F.col("total").alias("cum"))
    return real.select(*cols).unionByName(root).unionByName(end)


def _kind(rows: Column, seqs: Column, limit: int) -> Column:
    return F.when(seqs == 1, CHAIN).when(rows <= limit, SWEPT).otherwise(BURST)


def _burst(active: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One round: (heads, their chain rows, child containers, rows of the children).

    ``active``: rows of oversized containers: cid, parent, first (position of the container's first turn),
    base (code points before it), and the columns of ``_suffix_rows``.
    """
    levels = active.groupBy("cid", "pos").agg(F.min("tid").alias("low"), F.max("tid").alias("high"))
    branch = levels.where(F.col("low") != F.col("high")).groupBy("cid").agg(F.min("pos").alias("branch"))
    info = active.where(_end()).groupBy("cid").agg(F.sum("w").alias("n_convs"), F.min("seq").alias("conv_id"))
    heads = staged(branch.join(info, "cid"), "trie-heads")
    rows = staged(salted_join(active, heads, "cid"), "trie-burst")
    chains = rows.where((F.col("pos") < F.col("branch")) & (F.col("seq") == F.col("conv_id")))
    at = rows.where(F.col("pos") == F.col("branch")).select(
        "seq", F.col("cid").alias("head"), F.col("conv_id").alias("parent"), F.unhex(F.md5(F.concat("cid", "tid"))).alias("cid"), "w", "n", "total",
        F.col("pos").alias("first"), (F.col("cum") - F.col("len")).alias("base"), _end().alias("ends"), (F.col("n") + 2 - F.col("pos")).alias("left"))
    children = staged(at.groupBy("cid", "head").agg(
        F.sum("left").alias("rows"), F.count(F.lit(1)).alias("seqs"), F.min("seq").alias("conv_id"), F.sum("w").alias("n_convs"),
        F.first("ends").alias("ends"), F.first("base").alias("base"), F.max("total").alias("total")).withColumn("kind", _kind(F.col("rows"), F.col("seqs"), limit)),
        "trie-children")
    taken = salted_join(at.select("seq", "cid", "parent", "first", "base", "n"), children.select("cid", "kind"), "cid").withColumn("last", F.col("n") + 1)
    below = rows.where(F.col("pos") >= F.col("branch")).select("seq", "w", "n", "total", "pos", "tid", "len", "cum")
    return heads, chains, children, staged(sliced_join(below, taken.drop("n"), "seq", "last").drop("last"), "trie-rows")


def _chain_nodes(rows: DataFrame) -> DataFrame:
    """Nodes of containers that hold one sequence: its rows."""
    real, last = rows.where(~_end()), F.col("pos") == F.col("n")
    return real.select(
        F.col("seq").alias("conv_id"), F.col("pos").alias("depth"), F.when(F.col("pos") > F.col("first"), F.col("seq")).otherwise(F.col("parent")).alias("parent_conv_id"),
        F.col("w").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("w") - 1) * (F.col("total") - F.col("cum") + F.col("len"))).alias("saved_tokens"), F.when(last, F.col("seq")).alias("end_seq"))


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_seq"]


def sweep_container(members: list) -> list:
    """Nodes of one container, its top first.

    ``members``: (turn ids, code points, seq, w, first depth) per sequence; the last id is the end mark.  In sorted
    order a sequence shares its longest prefix with the one before it, so one stack of open nodes is enough.
    Nodes are [seq, depth, parent's place, n_convs, n_children, n_leaves, saved, end seq].
    """
    nodes, path, before = [], [], ()
    for ids, lens, seq, w, first in sorted(members, key=lambda m: m[0]):
        shared = 0
        while shared < len(path) and ids[shared] == before[shared]:
            shared += 1
        del path[shared:]
        for i in range(shared, len(ids) - 1):
            parent = path[-1] if path else None
            if parent is not None:
                nodes[parent][4] += 1
            nodes.append([seq, first + i, parent, 0, 0, 0, lens[i], None])
            path.append(len(nodes) - 1)
        for at in path:
            nodes[at][0] = min(nodes[at][0], seq)
            nodes[at][3] += w
        nodes[path[-1]][7] = seq
        before = ids
    for node in reversed(nodes):  # parents come before their children
        node[5] += node[4] == 0
        node[6] *= node[3] - 1
    for node in reversed(nodes):
        if node[2] is not None:
            nodes[node[2]][5] += node[5]
            nodes[node[2]][6] += node[6]
    return nodes


def _swept_nodes(rows: DataFrame) -> DataFrame:
    """Nodes of containers of several sequences that fit one task; ``cid`` is set on a container's top."""
    schema = pa.schema([*[(c, pa.int64()) for c in NODE], ("cid", pa.binary())])

    def emit(cid, parent, members):
        nodes = sweep_container(members)
        return [(n[0], n[1], parent if n[2] is None else nodes[n[2]][0], *n[3:8], cid if n[2] is None else None) for n in nodes]

    def sweep(batches: Iterator[pa.RecordBatch]):
        cid, parent, members, out = None, None, [], []
        for b in batches:
            for c, seq, pos, tid, length, w, up in zip(*[b.column(i).to_pylist() for i in range(7)]):
                if c != cid:
                    if members:
                        out += emit(cid, parent, members)
                    cid, parent, members = c, up, []
                if not members or members[-1][2] != seq:
                    members.append(([], [], seq, w, pos))
                members[-1][0].append(tid)
                members[-1][1].append(length)
            if out:
                yield _batch(out, schema)
                out = []
        if members:
            yield _batch(emit(cid, parent, members), schema)

    ordered = rows.select("cid", "seq", "pos", "tid", "len", "w", "parent").repartition("cid").sortWithinPartitions("cid", "seq", "pos")
    return ordered.mapInArrow(sweep, ", ".join(f"{c} long" for c in NODE) + ", cid binary")


def _head_nodes(heads: DataFrame, chains: DataFrame, children: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of one round's heads, and the totals of their containers, from the totals (cid, leaves, saved) of the children."""
    below = children.join(totals, "cid", "left").groupBy("head").agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count_if(~F.col("ends")).alias("kids"),
        F.max(F.when(F.col("ends"), F.col("conv_id"))).alias("end_seq"), F.max("base").alias("upto"))
    full = staged(heads.join(below.withColumnRenamed("head", "cid"), "cid"), "trie-totals")
    nodes = sliced_join(chains.drop("branch", "conv_id", "n_convs"), full, "cid", "branch")
    last = F.col("pos") == F.col("branch") - 1
    saved = F.col("saved") + (F.col("n_convs") - 1) * (F.col("upto") - F.col("cum") + F.col("len"))
    out = nodes.select(
        "conv_id", F.col("pos").alias("depth"), F.when(F.col("pos") > F.col("first"), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"),
        "n_convs", F.when(last, F.col("kids")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"),
        F.when(last, F.col("end_seq")).alias("end_seq"), F.when(F.col("pos") == F.col("first"), F.col("cid")).alias("cid"))
    out = staged(out, "trie-head-nodes")
    return out.select(*NODE), out.where(F.col("cid").isNotNull()).select("cid", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))


def prefix_trie(turns: DataFrame, convs: DataFrame, container_rows: int = CONTAINER_ROWS) -> DataFrame:
    """Nodes of the trie of all conversations: NODE columns but ``end_seq``, and ``ends_sha256``.

    ``turns``: as of ``turn_sequences``; ``convs``: conv_id of all conversations, with or without turns.
    """
    members, seqs = distinct_sequences(turns, convs)
    size = seqs.agg(F.count(F.lit(1)).alias("seqs"), F.sum(F.col("n") + 2).alias("rows")).first()
    start = _suffix_rows(turns, seqs).select(
        "*", _kind(F.lit(size["rows"]), F.lit(size["seqs"]), container_rows).alias("kind"), F.expr("X'00'").alias("cid"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("base"))
    rows, settled, rounds = staged(start, "trie-rows"), [], []
    while True:
        settled.append(rows)
        active = rows.where(F.col("kind") == BURST).drop("kind")
        if active.isEmpty():
            break
        *made, rows = _burst(active, container_rows)
        rounds.append(made)
    # settled containers of every round
    every = settled[0]
    for r in settled[1:]:
        every = every.unionByName(r)
    swept = staged(_swept_nodes(every.where(F.col("kind") == SWEPT)), "trie-swept")
    nodes = _chain_nodes(every.where(F.col("kind") == CHAIN)).unionByName(swept.select(*NODE))
    # totals climb from the deepest round
    tops = swept.where(F.col("cid").isNotNull()).select("cid", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    upper = None
    for heads, chains, children in reversed(rounds):
        single = children.where(F.col("kind") == CHAIN).select(
            "cid", F.when(F.col("ends"), 0).otherwise(1).cast("long").alias("leaves"),
            ((F.col("n_convs") - 1) * (F.col("total") - F.col("base"))).alias("saved"))
        totals = single.unionByName(tops)
        if upper is not None:
            totals = totals.unionByName(upper)
        made, upper = _head_nodes(heads, chains, children, totals)
        nodes = nodes.unionByName(made)
    ends = end_digests(members).join(seqs.select("d1", "d2", "n", F.col("seq").alias("end_seq")), ["d1", "d2", "n"]).select("end_seq", "ends_sha256")
    nothing = hashlib.sha256(b"").hexdigest()
    out = nodes.join(ends, "end_seq", "left")
    return out.select(*NODE[:-1], F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def conversation_trie(df: DataFrame, key: str, turn: str, role: str, text: str, container_rows: int = CONTAINER_ROWS) -> DataFrame:
    """The trie of the conversations as they are."""
    turns = turn_sequences(df, key, turn, role, text)
    return prefix_trie(turns, turns.select("conv_id").distinct(), container_rows)
