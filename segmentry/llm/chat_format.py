"""Chat formatting: records of any known layout to canonical turns, then to marked text.

Records come in the layouts of many sources: prompt and completion, instruction, input and
output, lists of messages. Read together they are one nested schema of which a record fills
some fields, as ``spark.read.json`` gives it. The paths of the fields that a record fills,
nested ones through structs and lists (``messages[].role``), are sorted and hashed: that is
the record's fingerprint. A layout states its paths and how they become turns; fingerprints
of all its forms, with and without optional paths, select it. Paths that no layout names
take no part, so other fields do no harm. A record of no known layout is kept, with null
turns, and its paths say what a layout for it would have to name.

A template marks each turn with its role and end. Control strings, the template's own and
those of other common templates, are escaped inside roles and texts with a backslash after
their first character, and backslashes are doubled, so texts read back are equal to those
written. The loss mask is a list of spans of the formatted text: the texts of the trained
roles without their marks. Everything is a DataFrame expression over one record, so there
is no shuffle, and no record meets another.

Defined cases: a null text or role is empty; a record without any turn, or with a null in
the place of its list, has no known layout; roles may be any string, and may repeat; texts
of any length are kept whole; an empty table gives an empty result; all columns of the
input stay, the new ones take free names in their order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from .common import quoted

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Turn:
    """One turn from fields of the record: its parts, those present, joined by a blank line."""

    role: str
    parts: tuple[str, ...]


@dataclass(frozen=True)
class Turns:
    """A turn for each element of a list; ``names`` gives canonical roles for others."""

    each: str
    role: str
    text: str
    names: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Layout:
    name: str
    steps: tuple[Turn | Turns, ...]
    optional: frozenset[str] = frozenset()

    @property
    def paths(self) -> set[str]:
        found: set[str] = set()
        for s in self.steps:
            found |= set(s.parts) if isinstance(s, Turn) else {f"{s.each}[].{s.role}", f"{s.each}[].{s.text}"}
        return found

    def forms(self) -> Iterator[frozenset[str]]:
        """The sets of paths that a record of this layout may fill."""
        extra = sorted(self.optional)
        for some in chain.from_iterable(combinations(extra, n) for n in range(len(extra) + 1)):
            yield frozenset(self.paths - self.optional | set(some))


#: Layouts that public instruction and chat data use.
LAYOUTS = (
    Layout("messages", (Turn("system", ("system",)), Turns("messages", "role", "content")), frozenset({"system"})),
    Layout(
        "conversations",
        (
            Turn("system", ("system",)),
            Turns("conversations", "from", "value", (("human", "user"), ("gpt", "assistant"))),
        ),
        frozenset({"system"}),
    ),
    Layout(
        "instruction",
        (Turn("system", ("system",)), Turn("user", ("instruction", "input")), Turn("assistant", ("output",))),
        frozenset({"system", "input"}),
    ),
    Layout("prompt", (Turn("user", ("prompt",)), Turn("assistant", ("completion",)))),
    Layout(
        "exchange",
        (Turn("system", ("data.system",)), Turn("user", ("data.question",)), Turn("assistant", ("data.answer",))),
        frozenset({"data.system"}),
    ),
)


@dataclass(frozen=True)
class Template:
    """Marks around a turn, and what may not stand in its text."""

    begin: str = "<|im_start|>"
    middle: str = "\n"
    end: str = "<|im_end|>\n"
    controls: tuple[str, ...] = (
        "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    )
    trained: tuple[str, ...] = ("assistant",)
    #: The end mark without white space, which splits a formatted text into turns.
    stop: str = field(default="", init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "stop", self.end.strip())
        if self.begin not in self.controls or self.stop not in self.controls:
            raise ValueError("the marks of a turn must be control strings")
        if any(len(c) < 2 or "\\" in c or "\n" in c or any(c.endswith(c[:i]) for i in range(1, len(c))) for c in self.controls):
            raise ValueError("a control string has two characters or more, does not overlap itself, and holds no backslash or line break")
        if self.middle != "\n":
            raise ValueError("the role ends with its line")


def field_paths(schema: StructType, prefix: str = "") -> Iterator[str]:
    """Paths of all leaves of a nested schema; ``[]`` steps into a list."""
    for f in schema.fields:
        yield from _leaves(f.dataType, prefix + f.name)


def _leaves(kind: DataType, path: str) -> Iterator[str]:
    if isinstance(kind, StructType):
        yield from field_paths(kind, path + ".")
    elif isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType | ArrayType):
        yield from _leaves(kind.elementType, path + "[]")
    else:
        yield path


def _filled(record: Column, path: str) -> Column:
    """Whether a record has a value at a path, in any element where the path passes lists."""
    head, listed, rest = path.partition("[]")
    value = record
    for name in head.strip(".").split("."):
        value = value.getField(name) if name else value
    if not listed:
        return value.isNotNull()
    return F.coalesce(F.exists(value, lambda e: _filled(e, rest)), F.lit(False))


def known_paths(layouts: Sequence[Layout]) -> list[str]:
    return sorted({p for layout in layouts for p in layout.paths})


def _fingerprint(paths: Column) -> Column:
    return F.sha2(F.array_join(paths, "\n"), 256)


def fingerprint(record: Column, schema: StructType, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """Hash of the sorted paths that a record fills, of those that layouts name."""
    there = set(field_paths(schema))
    named = [F.when(_filled(record, p), F.lit(p)) for p in known_paths(layouts) if p in there]
    return _fingerprint(F.array_compact(F.array(*named)) if named else F.array().cast("array<string>"))


def _step(record: Column, schema: StructType, step: Turn | Turns) -> Column:
    there = set(field_paths(schema))

    def value(path: str) -> Column:
        found = record
        for name in path.split("."):
            found = found.getField(name)
        return found.cast("string")

    if isinstance(step, Turn):
        parts = F.array_compact(F.array(*(value(p) for p in step.parts if p in there)).cast("array<string>"))
        text = F.array_join(parts, "\n\n")
        one = F.array(F.struct(F.lit(step.role).alias("role"), text.alias("text")))
        return F.when(F.size(parts) > 0, one).otherwise(F.array().cast(TURNS))

    def turn(e: Column) -> Column:
        role = F.coalesce(e.getField(step.role).cast("string"), F.lit(""))
        for other, name in step.names:
            role = F.when(e.getField(step.role) == other, F.lit(name)).otherwise(role)
        text = F.coalesce(e.getField(step.text).cast("string"), F.lit(""))
        return F.struct(role.alias("role"), text.alias("text"))

    listed = record
    for name in step.each.split("."):
        listed = listed.getField(name)
    return F.transform(listed, turn)


def canonical_turns(
    records: DataFrame, record_col: str = "record", layouts: Sequence[Layout] = LAYOUTS
) -> DataFrame:
    """``records`` with ``fingerprint``, ``layout`` and ``turns`` of the struct column."""
    schema = records.schema[record_col].dataType
    record = quoted(record_col)
    there = set(field_paths(schema))
    usable = [x for x in layouts if x.paths - x.optional <= there]
    marked = records.withColumn("fingerprint", fingerprint(record, schema, layouts))
    # Which layout: one comparison of hashes for each form that the schema can hold.
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in usable:
        prints = [_fingerprint(F.array(*map(F.lit, sorted(f)))) for f in layout.forms() if f <= there]
        fits = F.col("fingerprint").isin(*prints)
        name = F.when(fits, F.lit(layout.name)).otherwise(name)
        steps = [_step(record, schema, s) for s in layout.steps]
        turns = F.when(F.col("layout") == layout.name, F.flatten(F.array(*steps))).otherwise(turns)
    return marked.withColumn("layout", name).withColumn("turns", turns)


def escaped(text: Column, controls: Sequence[str]) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in controls:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def format_chats(turns: DataFrame, template: Template = Template(), turns_col: str = "turns") -> DataFrame:
    """``turns`` with ``formatted`` and ``loss_spans``, places and lengths in characters from 0."""

    def pieces(t: Column) -> Column:
        role = F.replace(escaped(t["role"], template.controls), F.lit("\n"), F.lit("\\\n"))
        head = F.concat(F.lit(template.begin), role, F.lit(template.middle))
        return F.struct(
            head.alias("head"), escaped(t["text"], template.controls).alias("body"),
            t["role"].isin(*template.trained).alias("trained"),
        )

    def placed(state: Column, p: Column) -> Column:
        at = state["at"] + F.length(p["head"])
        span = F.struct(at.cast("long").alias("start"), F.length(p["body"]).cast("long").alias("length"))
        after = at + F.length(p["body"]) + len(template.end)
        spans = F.when(p["trained"], F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct(after.cast("long").alias("at"), spans.alias("spans"))

    start = F.struct(
        F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")
    )
    marked = turns.withColumn("pieces", F.transform(quoted(turns_col), pieces))
    whole = F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(template.end)))
    return marked.withColumns(
        {
            "formatted": F.array_join(whole, ""),
            "loss_spans": F.aggregate("pieces", start, placed, lambda s: s["spans"]),
        }
    ).drop("pieces")


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """Turns of a formatted text, as they were before it was marked and escaped."""
    chunks = F.split(formatted, f"\\Q{template.end}\\E")
    real = F.slice(chunks, 1, F.greatest(F.size(chunks) - 1, F.lit(0)))

    def turn(chunk: Column) -> Column:
        rest = F.substr(chunk, F.lit(len(template.begin) + 1))
        role = F.regexp_extract(rest, r"^[^\\\n]*+(?:\\[\s\S][^\\\n]*+)*+", 0)
        text = F.substr(rest, F.length(role) + len(template.middle) + 1)
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(real, turn)


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(
        F.transform(loss_spans, lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))),
        "",
    )


def by_conversation(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``id, turns`` from one row a turn, in order; ties go by role and text, a null place last.

    A conversation is one record, whole in one row as a document is.
    """
    role, text = (F.coalesce(quoted(c), F.lit("")) for c in (role_col, text_col))
    held = F.struct(
        quoted(turn_col).isNull().alias("unplaced"), quoted(turn_col).alias("turn"), role.alias("role"), text.alias("text")
    )
    ordered = F.array_sort(F.collect_list("held"))
    return (
        rows.select(quoted(id_col).alias("id"), held.alias("held"))
        .groupBy("id")
        .agg(F.transform(ordered, lambda t: F.struct(t["role"], t["text"])).alias("turns"))
    )


def in_layouts(chats: DataFrame) -> DataFrame:
    """``id, record``: each conversation in one of the layouts that can hold it, by its id.

    For tables that have one layout only: what many sources would bring, as one schema.
    """
    turns, kind = F.col("turns"), F.pmod(F.xxhash64("id"), F.lit(3))
    roles = F.transform(turns, lambda t: t["role"])
    asked = F.array_join(roles, ",")
    plain = F.forall(roles, lambda r: r.isin("system", "user", "assistant"))
    pair, three = asked == "user,assistant", asked == "system,user,assistant"
    text = [F.try_element_at(turns, F.lit(i)).getField("text") for i in (1, 2, 3)]
    last, before = (F.try_element_at(turns, F.lit(-i)).getField("text") for i in (1, 2))
    layout = (
        F.when(pair, F.element_at(F.array(*map(F.lit, ("prompt", "instruction", "exchange"))), kind.cast("int") + 1))
        .when(three, F.element_at(F.array(*map(F.lit, ("instruction", "exchange", "messages"))), kind.cast("int") + 1))
        .when(plain & (kind > 0), F.lit("conversations"))
        .otherwise(F.lit("messages"))
    )
    led = (F.element_at(roles, 1) == "system") & (F.size(turns) > 1) & (kind < 2)

    def of(name: str, value: Column) -> Column:
        return F.when(F.col("kind") == name, value)

    outside = F.when(F.col("led"), F.slice(turns, 2, F.size(turns))).otherwise(turns)
    names = {"user": "human", "assistant": "gpt"}

    def from_value(t: Column) -> Column:
        role = t["role"]
        for name, other in names.items():
            role = F.when(t["role"] == name, F.lit(other)).otherwise(role)
        return F.struct(role.alias("from"), t["text"].alias("value"))

    system = F.when(F.col("kind").isin("messages", "conversations"), F.when(F.col("led"), text[0])).otherwise(
        of("instruction", F.when(F.size(turns) == 3, text[0]))
    )
    answer = F.struct(
        F.when(F.size(turns) == 3, text[0]).alias("system"), before.alias("question"), last.alias("answer")
    )
    record = F.struct(
        of("prompt", text[0]).alias("prompt"), of("prompt", text[1]).alias("completion"),
        of("instruction", before).alias("instruction"), F.lit(None).cast("string").alias("input"),
        of("instruction", last).alias("output"), system.alias("system"),
        of("messages", F.transform(outside, lambda t: F.struct(t["role"], t["text"].alias("content")))).alias("messages"),
        of("conversations", F.transform(outside, from_value)).alias("conversations"),
        of("exchange", answer).alias("data"),
    )
    return chats.withColumn("kind", layout).withColumn("led", led).select("id", record.alias("record"))
