"""13 Chat formatting: schema fingerprints, declarative layouts, reversible template (DataFrame functions only).

A record may hold a dialogue in one of many layouts (prompt and completion,
instruction with input, lists of messages under several names).  Its
*fingerprint* is the MD5 of the sorted nested field paths that it fills, among
the paths that any layout knows.  A ``Layout`` states declaratively which paths
make which turns; a record takes the layout whose own paths have the same
fingerprint.  All layouts end as ``turns``: array<struct<role, text>>.

Template, one piece per turn::

    ### User: text
    </turn>

Inside texts ``\\``, ``### `` and ``</turn>`` get a backslash in front, so an
unescaped ``</turn>`` ends a turn and nothing else does.  The end mark follows
a line break, never a backslash.  Roles other than user, assistant and system
are written ``=`` and URL-encoded.  The loss mask is run lengths in UTF-8
bytes, one entry per turn: ``skip`` bytes without loss, ``take`` bytes with
loss (the escaped assistant text), ``rest`` bytes without.

Defined results: a null text or role is empty.  A record that fills no known
set of paths (all null, an empty list, an unknown mixture) has a null layout,
no turns and an empty text; it is kept.  Columns that no layout knows are kept
and ignored; names beginning ``__cl_`` are reserved.  Equal turn numbers are
ordered by role and text, repeated rows all count, null turns come first.
Rows of a null conv_id are one conversation.  One conversation is one text, so
it is limited by the 2 GB of a Spark string.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

MARK, END = "### ", "</turn>"
#: roles written by name
LABELS = {"user": "User", "assistant": "Assistant", "system": "System"}


@dataclass(frozen=True)
class Layout:
    """Which paths of a record make its turns.

    ``parts``: (role, path or paths) in turn order, several paths are joined by
    a line break.  Or ``items``: the path of a list, with the fields that hold
    role and text of each item, and other names of roles.
    """

    name: str
    parts: tuple = ()
    items: str = ""
    role: str = ""
    text: str = ""
    names: tuple = ()

    def paths(self) -> list[str]:
        if self.items:
            return sorted([f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"])
        return sorted(p for _, ps in self.parts for p in ((ps,) if isinstance(ps, str) else ps))

    def fingerprint(self) -> str:
        return hashlib.md5("\n".join(self.paths()).encode()).hexdigest()

    def turns(self) -> Column:
        if self.items:
            def item(m):
                role = F.coalesce(m[self.role], F.lit(""))
                for name, canonical in self.names:
                    role = F.when(m[self.role] == name, F.lit(canonical)).otherwise(role)
                return F.struct(role.alias("role"), F.coalesce(m[self.text], F.lit("")).alias("text"))

            return F.transform(F.col(self.items), item)
        made = []
        for role, ps in self.parts:
            text = F.concat_ws("\n", *[F.col(p) for p in ((ps,) if isinstance(ps, str) else ps)])
            made.append(F.struct(F.lit(role).alias("role"), text.alias("text")))
        return F.array(*made)


LAYOUTS = (
    Layout("messages", items="messages", role="role", text="content"),
    Layout("message_texts", items="messages", role="role", text="text"),
    Layout("shared_dialogue", items="conversations", role="from", text="value", names=(("human", "user"), ("gpt", "assistant"))),
    Layout("prompt_completion", parts=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", parts=(("user", "prompt"), ("assistant", "response"))),
    Layout("system_prompt_response", parts=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", parts=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", parts=(("user", ("instruction", "input")), ("assistant", "output"))),
    Layout("question_answer", parts=(("user", "data.question"), ("assistant", "data.answer"))),
)


def field_paths(schema: DataType, prefix: str = "") -> list[str]:
    """Nested paths of all leaves; a list of structs adds ``[]``."""
    if isinstance(schema, StructType):
        dot = f"{prefix}." if prefix else ""
        return [p for f in schema.fields for p in field_paths(f.dataType, dot + f.name)]
    if isinstance(schema, ArrayType) and isinstance(schema.elementType, StructType):
        return field_paths(schema.elementType, prefix + "[]")
    return [prefix]


def _filled(path: str) -> Column:
    if "[]." in path:
        items, field = path.split("[].")
        return F.exists(F.col(items), lambda m: m[field].isNotNull())
    return F.col(path).isNotNull()


def fingerprint(schema: StructType, layouts=LAYOUTS) -> Column:
    """MD5 of the sorted known paths that a row fills."""
    known = {p for lay in layouts for p in lay.paths()}
    paths = sorted(p for p in field_paths(schema) if p in known)
    return F.md5(F.concat_ws("\n", *[F.when(_filled(p), F.lit(p)) for p in paths]))


def canonical_turns(records: DataFrame, layouts=LAYOUTS) -> DataFrame:
    """Records with ``layout`` and ``turns``; the columns that layouts know are replaced by them."""
    there = set(field_paths(records.schema))
    usable = [lay for lay in layouts if set(lay.paths()) <= there]
    tops = {p.split(".")[0].split("[")[0] for lay in layouts for p in lay.paths()}
    keep = [c for c in records.columns if c not in tops and c not in ("layout", "turns")]
    out = records.withColumn("__cl_print", fingerprint(records.schema, layouts))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for lay in usable:
        hit = F.col("__cl_print") == lay.fingerprint()
        layout, turns = F.when(hit, F.lit(lay.name)).otherwise(layout), F.when(hit, lay.turns()).otherwise(turns)
    none = F.array().cast("array<struct<role:string,text:string>>")
    return out.select(*keep, layout.alias("layout"), F.coalesce(turns, none).alias("turns"))


def record_schema(layouts=LAYOUTS) -> StructType:
    """One schema that can hold any layout (to read JSON records with)."""
    tree: dict = {}
    for lay in layouts:
        for p in lay.paths():
            node, parts = tree, p.split(".")
            for step in parts[:-1]:
                node = node.setdefault(step, {})
            node[parts[-1]] = None

    def build(node):
        s = StructType()
        for name, sub in node.items():
            if sub is None:
                s.add(name, StringType())
            else:
                s.add(name.removesuffix("[]"), ArrayType(build(sub)) if name.endswith("[]") else build(sub))
        return s

    return build(tree)


def json_records(df: DataFrame, column: str, layouts=LAYOUTS) -> DataFrame:
    """A column of JSON texts of mixed layouts as typed columns beside the other columns."""
    tops = record_schema(layouts).fieldNames()
    keep = [c for c in df.columns if c not in tops and c != column]
    return df.select(*keep, F.from_json(F.col(column), record_schema(layouts)).alias("__cl_rec")).select(*keep, "__cl_rec.*")


def turn_rows(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows of one turn each as records of the ``messages`` layout, one per ``key``."""
    item = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                    F.coalesce(F.col(text), F.lit("")).alias("content"))
    listed = rows.groupBy(F.col(key)).agg(F.sort_array(F.collect_list(item)).alias("__cl_items"))
    return listed.select(key, F.transform("__cl_items", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def _escape(text: Column) -> Column:
    for s in ("\\", MARK, END):
        text = F.replace(text, F.lit(s), F.lit("\\" + s))
    return text


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\#<])", "$1")


def _label(role: Column) -> Column:
    out = F.concat(F.lit("="), F.url_encode(role))
    for name, label in LABELS.items():
        out = F.when(role == name, F.lit(label)).otherwise(out)
    return out


def _role(label: Column) -> Column:
    out = F.url_decode(F.substr(label, F.lit(2)))
    for name, text in LABELS.items():
        out = F.when(label == text, F.lit(name)).otherwise(out)
    return out


def format_chats(records: DataFrame, layouts=LAYOUTS, loss_role: str = "assistant") -> DataFrame:
    """All records with ``layout``, ``formatted`` text and ``loss_runs``: array<struct<skip, take, rest>> in bytes."""
    df = canonical_turns(records, layouts)
    kept = [c for c in df.columns if c not in ("turns", "formatted", "loss_runs")]

    def piece(t):
        head = F.concat(F.lit(MARK), _label(t["role"]), F.lit(": "))
        return F.struct(head.alias("head"), _escape(t["text"]).alias("body"), (t["role"] == loss_role).alias("loss"))

    tail = "\n" + END + "\n"

    def run(p):
        body = F.octet_length(p["body"])
        return F.struct(F.octet_length(p["head"]).alias("skip"), F.when(p["loss"], body).otherwise(0).alias("take"),
                        (F.when(p["loss"], 0).otherwise(body) + len(tail)).alias("rest"))

    text = F.array_join(F.transform("__cl_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "")
    return df.withColumn("__cl_pieces", F.transform("turns", piece)).select(
        *kept, text.alias("formatted"), F.transform("__cl_pieces", run).alias("loss_runs"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss texts out of ``formatted`` and ``loss_runs`` alone: ``turns`` and ``loss_texts`` (one per turn, unescaped)."""
    kept = [c for c in formatted.columns if c not in ("turns", "loss_texts", "__cl_parts")]
    parts = F.split("formatted", r"(?<!\\)" + END + "\n", -1)
    df = formatted.select(*kept, F.slice(parts, F.lit(1), F.size(parts) - 1).alias("__cl_parts"))

    def turn(p):
        colon = F.instr(p, ":")
        label = F.substring(p, F.lit(len(MARK) + 1), colon - (len(MARK) + 1))
        body = F.substring(p, colon + 2, F.char_length(p) - colon - 2)
        return F.struct(_role(label).alias("role"), _unescape(body).alias("text"))

    def under(p, r):
        return _unescape(F.substring(p.cast("binary"), r["skip"] + 1, r["take"]).cast("string"))

    return df.select(*kept, F.transform("__cl_parts", turn).alias("turns"),
                     F.zip_with("__cl_parts", "loss_runs", under).alias("loss_texts"))


def chat_digests(formatted: DataFrame, key: str) -> DataFrame:
    """Per record what its output says: turns, their digest, the text under the loss mask."""
    back = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        F.col(key), F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "layout")
