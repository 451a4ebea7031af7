"""Operator 12: chat records of any layout to canonical turns, and turns to one template, in DataFrame functions alone.

A record is a JSON text (with a ``body`` column beside it where a layout keeps the text outside).
Its schema is written as the nested paths of its fields, whose hash is the record's fingerprint.
Every distinct fingerprint is held once against the declared layouts: the first whose paths are all
there is its mapping, and the records get it by their fingerprint. Further fields are no hindrance.
The mappings are data: a path to a list of turns and the names of its parts, or fields with a role
each. The template wraps each turn in control strings; such strings inside texts and roles take a
backslash behind their first character, one more than they have, so that reading back is exact.
The loss mask counts, turn by turn, the code points before the learned text and those of it.

Null and missing texts are empty, null roles too; roles without a marker of their own are spelled
out. A record that is no JSON, is longer than Spark's parser takes (16 MB), or fits no layout stays
with null layout and null turns. Rows by turn become records of 32 turns,
and where these hold more than ``LONG`` characters, single turns with the text in ``body``, so that
their texts may be of any length. Turns of a conversation are ordered by turn, role and text;
repeated rows count each. Null ids are one conversation. Other columns travel in a struct, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuegrid.llm.common import keyed, written

#: Turns of a record that is made of rows by turn, and its characters from which each turn is one.
PIECE_BITS, LONG = 5, 1 << 20
#: Distinct fingerprints that are broadcast at most.
MOST_LAYOUTS = 200_000
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """How records with these paths hold their turns: in a list, or in fields with a role each."""

    name: str
    needs: tuple[str, ...]
    listed: str | None = None
    role: str = "role"
    text: str = "content"
    roles: dict[str, str] = field(default_factory=dict)
    #: (role, fields joined by a blank line, whether a turn without any text is left out).
    fields: tuple[tuple[str, tuple[str, ...], bool], ...] = ()
    #: One turn: the field of its role; its text is in ``text``, or in the column ``body``.
    single: str | None = None


LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), listed="messages"),
    Layout("message_parts", ("messages[].content[].text", "messages[].role"), listed="messages", text="content[].text"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), listed="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
    Layout("instruction", ("instruction", "output"), fields=(("system", ("system",), True), ("user", ("instruction", "input"), False), ("assistant", ("output",), False))),
    Layout("prompt_response", ("prompt", "response"), fields=(("system", ("system",), True), ("user", ("prompt",), False), ("assistant", ("response",), False))),
    Layout("prompt_completion", ("completion", "prompt"), fields=(("user", ("prompt",), False), ("assistant", ("completion",), False))),
    Layout("question_answer", ("answer", "question"), fields=(("user", ("question",), False), ("assistant", ("answer",), False))),
    Layout("turn", ("role", "text"), single="role", text="text"),
    Layout("turn_body", ("body", "role"), single="role", text=""),
)

#: Names, openings, ends and plain fields of a structure, and the fold of these tokens to paths.
_TOKENS = r"(`(?:[^`]|``)*`: |[A-Za-z_0-9]+: |OBJECT<|ARRAY<|>|_)"
_PATHS = """
aggregate(tokens, named_struct('stack', array(''), 'at', '', 'out', cast(array() AS array<string>)),
  (a, t) -> CASE
    WHEN t = 'OBJECT<' THEN named_struct('stack', array_append(a.stack, CASE WHEN a.at = '' THEN '' ELSE concat(a.at, '.') END), 'at', a.at, 'out', a.out)
    WHEN t = 'ARRAY<' THEN named_struct('stack', array_append(a.stack, ''), 'at', concat(a.at, '[]'), 'out', a.out)
    WHEN t = '>' THEN named_struct('stack', slice(a.stack, 1, size(a.stack) - 1), 'at', a.at, 'out', a.out)
    WHEN endswith(t, ': ') THEN named_struct('stack', a.stack, 'at', concat(element_at(a.stack, -1), substring(t, 1, length(t) - 2)), 'out', a.out)
    ELSE named_struct('stack', a.stack, 'at', a.at, 'out', array_append(a.out, a.at)) END,
  a -> array_sort(array_distinct(a.out)))
"""


def structure(record: Column) -> Column:
    """The nested fields of a JSON text without their types, in the order of their names; null if it is no JSON."""
    return F.regexp_replace(F.schema_of_variant(F.try_parse_json(record)), r"\b(?!OBJECT<|ARRAY<)[A-Z_]+(?:\([0-9,]+\))?(?=[,>]|$)", "_")


def known_layouts(marked: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """fingerprint, n, paths (sorted, ``[]`` behind what is a list) and layout (null if none fits) of the distinct structures."""
    found = marked.groupBy("fingerprint").agg(F.min("structure").alias("structure"), F.count("*").alias("n"))
    tokens = found.select("fingerprint", "n", F.regexp_extract_all("structure", F.lit(_TOKENS), F.lit(1)).alias("tokens"))
    listed = tokens.select("fingerprint", "n", F.expr(_PATHS).alias("paths"))
    fits = [F.when(F.size(F.array_except(F.array(*map(F.lit, m.needs)), "paths")) == 0, m.name) for m in layouts]
    return listed.withColumn("layout", F.coalesce(*fits))


def _read(record: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.try_parse_json(record), f"$.{path}", kind)


def _renamed(role: Column, roles: dict[str, str]) -> Column:
    role = F.coalesce(role, F.lit(""))
    out = role
    for here, there in roles.items():
        out = F.when(role == here, there).otherwise(out)
    return out


def turns_of(layout: Layout, record: Column, body: Column) -> Column:
    """The turns that a mapping finds in a record."""
    if layout.listed:
        name, _, part = layout.text.partition("[].")
        kind = f"array<struct<`{part}`:string>>" if part else "string"
        rows = _read(record, layout.listed, f"array<struct<`{layout.role}`:string,`{name}`:{kind}>>")
        text = (lambda t: F.array_join(F.transform(t[name], lambda p: p[part]), "", "")) if part else (lambda t: t[name])
        return F.transform(rows, lambda t: F.struct(_renamed(t[layout.role], layout.roles).alias("role"), F.coalesce(text(t), F.lit("")).alias("text")))
    if layout.single:
        text = _read(record, layout.text) if layout.text else body
        return F.array(F.struct(_renamed(_read(record, layout.single), layout.roles).alias("role"), F.coalesce(text, F.lit("")).alias("text")))
    made = []
    for role, names, optional in layout.fields:
        # All but the first of the fields count only where they say something.
        first, *more = [_read(record, n) for n in names]
        text = F.concat(F.coalesce(first, F.lit("")), *[F.when(F.coalesce(m, F.lit("")) != "", F.concat(F.lit("\n\n"), m)).otherwise("") for m in more])
        turn = F.struct(F.lit(role).alias("role"), text.alias("text"))
        made.append(F.when(first.isNotNull(), turn) if optional else turn)
    return F.filter(F.array(*made), lambda t: t.isNotNull())


def canonical(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """row (the other columns), fingerprint, layout and turns of records (record, and body if there is one)."""
    body = F.col("body") if "body" in records.columns else F.lit(None)
    rest = F.struct(*[F.col(f"`{c}`") for c in records.columns if c not in ("record", "body")]).alias("row")
    marked = records.select(rest, "record", body.cast("string").alias("body"), structure(F.col("record")).alias("structure"))
    marked = written(marked.withColumn("fingerprint", F.xxhash64("structure")), "records")
    known = written(known_layouts(marked, layouts).select("fingerprint", "layout"), "layouts")
    mapped = keyed(marked.drop("structure"), known, ["fingerprint"], F.xxhash64("record", "body"), MOST_LAYOUTS)
    turns = F.lit(None).cast(TURNS)
    for m in reversed(layouts):
        turns = F.when(F.col("layout") == m.name, turns_of(m, F.col("record"), F.col("body")).cast(TURNS)).otherwise(turns)
    return mapped.select("row", "fingerprint", "layout", turns.alias("turns"))


# ---- the template

#: Role: the control strings before and behind its text. Other roles are spelled out.
MARKERS = {"system": ("<<SYS>> ", " <</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("", "")}
OPEN, CLOSE = "<s>", "</s>\n"
ROLE_OPEN, ROLE_CLOSE = "[ROLE]", "[/ROLE] "
#: First characters, and the rest of the control strings.
_CONTROL = (r"([<\[])", r"(s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\]|ROLE\]|/ROLE\])")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"{_CONTROL[0]}(\\*){_CONTROL[1]}", r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"{_CONTROL[0]}(\\*)\\{_CONTROL[1]}", "$1$2$3")


def _opening(role: Column) -> Column:
    out = F.concat(F.lit(OPEN + ROLE_OPEN), escape(role), F.lit(ROLE_CLOSE))
    for name, (before, _) in MARKERS.items():
        out = F.when(role == name, OPEN + before).otherwise(out)
    return out


def _closing(role: Column) -> Column:
    out = F.lit(CLOSE)
    for name, (_, behind) in MARKERS.items():
        out = F.when(role == name, behind + CLOSE).otherwise(out)
    return out


def formatted(turns: Column, learned: str = "assistant") -> Column:
    """A struct: the text of the turns in the template, and the loss mask: for each turn the code
    points to pass over and those to learn."""
    parts = F.transform(turns, lambda t: F.struct(_opening(t["role"]).alias("a"), escape(t["text"]).alias("b"), _closing(t["role"]).alias("c"), (t["role"] == learned).alias("on")))
    mask = lambda p: F.struct(F.char_length(p["a"]).alias("skip"), F.when(p["on"], F.char_length(p["b"])).otherwise(0).alias("take"))
    return F.struct(F.array_join(F.transform(parts, lambda p: F.concat(p["a"], p["b"], p["c"])), "").alias("text"), F.transform(parts, mask).alias("mask"))


def read_back(text: Column, mask: Column) -> Column:
    """A struct: the turns that a formatted text holds, and the learned text under the mask."""
    pieces = F.filter(F.split(text, CLOSE), lambda p: p != "")

    def turn(p):
        inner = F.substring(p, F.lit(len(OPEN) + 1), F.char_length(p))
        cut = F.locate(ROLE_CLOSE, inner)
        role, said = F.lit("assistant"), inner
        spelled = inner.startswith(ROLE_OPEN)
        role = F.when(spelled, unescape(F.substring(inner, F.lit(len(ROLE_OPEN) + 1), cut - 1 - len(ROLE_OPEN)))).otherwise(role)
        said = F.when(spelled, F.substring(inner, cut + len(ROLE_CLOSE), F.char_length(inner))).otherwise(said)
        for name, (before, behind) in MARKERS.items():
            if before:
                here = inner.startswith(before)
                role = F.when(here, name).otherwise(role)
                said = F.when(here, F.substring(inner, F.lit(len(before) + 1), F.char_length(inner) - len(before) - len(behind))).otherwise(said)
        return F.struct(role.alias("role"), unescape(said).alias("text"))

    learned = F.zip_with(pieces, mask, lambda p, m: unescape(F.substring(p, m["skip"] + 1, m["take"])))
    return F.struct(F.transform(pieces, turn).alias("turns"), F.array_join(learned, "").alias("learned"))


# ---- rows by turn

_KNOWN_ROLES = ("system", "user", "assistant")


def records_of_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, part, at, record, body: rows by turn (conv_id, turn, role, text) as records of several layouts.

    A part holds the turns of one number without its last five bits. A question and its answer are a
    prompt and a response, with a system text an instruction; other parts of known roles are
    conversations or messages by their hash; other roles are messages; long parts are single turns.
    """
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parts = conversations.groupBy("conv_id", F.shiftright("turn", PIECE_BITS).alias("part")).agg(F.array_sort(F.collect_list(said)).alias("turns"), F.sum(F.char_length("text")).alias("_n"))
    t = F.col("turns")
    text = lambda k: t[k]["text"]
    roles = F.transform(t, lambda x: x["role"])
    where = [F.col("conv_id").alias("id"), F.col("part").alias("part")]
    names = F.create_map(*map(F.lit, ("system", "system", "user", "human", "assistant", "gpt")))
    made = {
        "prompt": F.to_json(F.struct(*where, text(0).alias("prompt"), text(1).alias("response"))),
        "instruction": F.to_json(F.struct(*where, text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output"))),
        "conversations": F.to_json(F.struct(*where, F.transform(t, lambda x: F.struct(names[x["role"]].alias("from"), x["text"].alias("value"))).alias("conversations"))),
        "messages": F.to_json(F.struct(*where, F.transform(t, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))),
    }
    is_ = lambda *r: roles == F.array(*map(F.lit, r))
    known = F.forall(roles, lambda r: r.isin(*_KNOWN_ROLES))
    kind = F.when(is_("user", "assistant"), "prompt").when(is_("system", "user", "assistant"), "instruction").when(known & (F.pmod(F.xxhash64("conv_id", "part"), F.lit(2)) == 0), "conversations").otherwise("messages")
    short = parts.filter(F.coalesce("_n", F.lit(0)) <= LONG).withColumn("_kind", kind)
    record = F.coalesce(*[F.when(F.col("_kind") == k, j) for k, j in made.items()])
    single = parts.filter(F.col("_n") > LONG).select("conv_id", "part", F.posexplode("turns").alias("at", "t"))
    record_of_one = F.to_json(F.struct(*where, F.col("t.role").alias("role"), F.lit(True).alias("body")))
    return short.select("conv_id", "part", F.lit(0).alias("at"), record.alias("record"), F.lit(None).cast("string").alias("body")).unionByName(
        single.select("conv_id", "part", "at", record_of_one.alias("record"), F.col("t.text").alias("body"))
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, part, at, layout, text and mask: the formatted pieces of rows by turn; a conversation is
    its pieces in the order of part and at."""
    found = canonical(records_of_turns(conversations))
    return found.select("row.*", "layout", formatted(F.col("turns")).alias("f")).select("conv_id", "part", "at", "layout", "f.text", "f.mask")


def digests(pieces: DataFrame) -> DataFrame:
    """What is read back from formatted pieces, for each conversation: the turns, the learned text and the length.

    A digest needs its whole text in one place, so the pieces of one conversation meet in one row.
    """
    back = pieces.select("conv_id", "part", "at", F.char_length("text").cast("long").alias("n"), read_back(F.col("text"), F.col("mask")).alias("b"))
    spelled = F.array_join(F.transform("b.turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    flat = back.select("conv_id", F.struct("part", "at", spelled.alias("said"), F.col("b.learned").alias("learned")).alias("p"), F.size("b.turns").cast("long").alias("turns"), "n", F.char_length("b.learned").cast("long").alias("m"))
    whole = flat.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("ps"), F.sum("turns").alias("n_turns"), F.sum("m").alias("loss_chars"), F.sum("n").alias("formatted_chars"))
    joined = lambda k: F.sha2(F.array_join(F.transform("ps", lambda p: p[k]), ""), 256)
    return whole.select("conv_id", "n_turns", joined("said").alias("turns_sha256"), "loss_chars", joined("learned").alias("loss_sha256"), "formatted_chars")
