"""Chat records of many layouts to canonical turns and one training template, in column expressions only.

A record arrives as JSON text. Its nested field paths (names and nesting, no types) are hashed; the hash selects a declared mapping that
turns the record into canonical turns (role, text). The template marks every turn, and control strings inside texts are escaped
so that they can be read back exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"
#: marks of the known roles; any other role is written as X: and the hex of its UTF-8 bytes
MARKS: Mapping[str, str] = {"user": "INST", "assistant": "OUT", "system": "SYS"}
BEGIN, END = "<s>", "</s>"
#: the engine's JSON readers take strings of up to 20,000,000 characters; longer texts travel beside the record
JSON_TEXT = 19_000_000
#: a variant holds up to 128 MB; conversations beyond about half of that, names of the fields included, travel beside the record
JSON_BYTES = 60_000_000
#: what a turn takes in a variant besides its texts, at most
FIELD_BYTES = 32
_NAMES = r"(?:INST|OUT|SYS|X:[0-9A-F]*)"
_TAIL = rf"(/?(?:{_NAMES}\]|s>))"
ESCAPE = (r"([\[<])(\\*)" + _TAIL, r"$1$2\\$3")
UNESCAPE = (r"([\[<])(\\*)\\" + _TAIL, r"$1$2$3")
TURN = rf"(?s)\[({_NAMES})\] (.*?) \[/\1\]"


def _turn(role: Column | str, text: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "string")


def _list(v: Column, name: str, role: str, text: str, names: Mapping[str, str]) -> Column:
    rows = F.try_variant_get(v, f"$.{name}", f"array<struct<{role}:string,{text}:string>>")

    def one(x: Column) -> Column:
        known = F.coalesce(x[role], F.lit(""))
        for old, new in names.items():
            known = F.when(x[role] == old, F.lit(new)).otherwise(known)
        return _turn(known, x[text])

    return F.transform(rows, one)


def _pair(prompt: str, answer: str, system: str | None = None) -> Callable[[Column], Column]:
    def make(v: Column) -> Column:
        turns = [_turn("user", _field(v, prompt)), _turn("assistant", _field(v, answer))]
        return F.array(*([_turn("system", _field(v, system))] if system else []), *turns)

    return make


def _instruction(v: Column) -> Column:
    extra = F.coalesce(_field(v, "input"), F.lit(""))
    asked = F.concat(F.coalesce(_field(v, "instruction"), F.lit("")), F.when(extra != "", F.concat(F.lit("\n\n"), extra)).otherwise(F.lit("")))
    return F.array(_turn("user", asked), _turn("assistant", _field(v, "output")))


@dataclass(frozen=True)
class Layout:
    """A declared mapping: field paths of the records it takes, and their canonical turns."""

    name: str
    paths: str
    turns: Callable[[Column], Column]


LAYOUTS = (
    Layout("messages", "OBJECT<messages: ARRAY<OBJECT<content, role>>>", lambda v: _list(v, "messages", "role", "content", {})),
    Layout("shared", "OBJECT<conversations: ARRAY<OBJECT<from, value>>>", lambda v: _list(v, "conversations", "from", "value", {"human": "user", "gpt": "assistant"})),
    Layout("instruction", "OBJECT<input, instruction, output>", _instruction),
    Layout("instruction_only", "OBJECT<instruction, output>", _pair("instruction", "output")),
    Layout("prompt", "OBJECT<prompt, response>", _pair("prompt", "response")),
    Layout("completion", "OBJECT<completion, prompt>", _pair("prompt", "completion")),
    Layout("prompt_system", "OBJECT<prompt, response, system>", _pair("prompt", "response", "system")),
)


def paths_of(record: Column) -> Column:
    """Nested field names of a variant, sorted by name inside each object, without the types of the leaves."""
    return F.regexp_replace(F.schema_of_variant(record), r": (?!OBJECT<|ARRAY<)[A-Z]+(?:\([0-9, ]*\))?", "")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(paths_of(record))


def to_turns(records: DataFrame, json: str, out: str = "turns", layout: str = "layout") -> DataFrame:
    """Add the canonical turns and the name of the layout. Records of no declared layout, broken JSON and null get null for both:
    they are reported by that, not dropped; so are records with a string of more than 20,000,000 characters or beyond 128 MB. Null texts are empty, null roles the empty role."""
    parsed = records.withColumn("__v", F.try_parse_json(F.col(json))).withColumn("__f", fingerprint(F.col("__v")))
    turns, name = F.lit(None).cast(TURNS), F.lit(None).cast("string")
    for known in reversed(LAYOUTS):
        same = F.col("__f") == F.xxhash64(F.lit(known.paths))
        turns, name = F.when(same, known.turns(F.col("__v")).cast(TURNS)).otherwise(turns), F.when(same, F.lit(known.name)).otherwise(name)
    return parsed.withColumn(out, turns).withColumn(layout, name).drop("__v", "__f")


def escape(text: Column) -> Column:
    """Put one more backslash into everything that looks like a control string, also into what is escaped already."""
    return F.regexp_replace(text, *ESCAPE)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, *UNESCAPE)


def _mark(role: Column) -> Column:
    mark = F.concat(F.lit("X:"), F.hex(F.encode(F.coalesce(role, F.lit("")), "UTF-8")))
    for known, name in MARKS.items():
        mark = F.when(role == known, F.lit(name)).otherwise(mark)
    return mark


def with_format(df: DataFrame, turns: str = "turns", out: str = "formatted", mask: str = "mask") -> DataFrame:
    """Add the formatted text and its loss mask: consecutive stretches (chars in code points, loss) that cover the text; loss is
    true on the escaped texts of assistant turns only. Null turns give null; no turns give the two end marks."""
    marked = F.transform(F.col(turns), lambda t: F.struct(_mark(t["role"]).alias("mark"), escape(F.coalesce(t["text"], F.lit(""))).alias("body"), F.coalesce(t["role"] == "assistant", F.lit(False)).alias("loss")))
    piece = lambda t: F.concat(F.lit("["), t["mark"], F.lit("] "), t["body"], F.lit(" [/"), t["mark"], F.lit("]"))
    part = lambda n, loss: F.struct(n.cast("int").alias("chars"), loss.alias("loss"))
    no = F.lit(False)
    runs = F.flatten(F.transform(F.col("__marked"), lambda t: F.array(part(F.length(t["mark"]) + 3, no), part(F.length(t["body"]), t["loss"]), part(F.length(t["mark"]) + 4, no))))
    ends = lambda s: F.array(part(F.lit(len(s)), no))
    return (
        df.withColumn("__marked", marked)
        .withColumn(out, F.concat(F.lit(BEGIN), F.array_join(F.transform(F.col("__marked"), piece), ""), F.lit(END)))
        .withColumn(mask, F.concat(ends(BEGIN), runs, ends(END)))
        .drop("__marked")
    )


def read_turns(formatted: Column) -> Column:
    """Turns read back from a formatted text."""
    rows = F.arrays_zip(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1)).alias("mark"), F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2)).alias("body"))

    def one(x: Column) -> Column:
        role = F.decode(F.unhex(F.substring(x["mark"], 3, 1 << 30)), "UTF-8")
        for known, name in MARKS.items():
            role = F.when(x["mark"] == name, F.lit(known)).otherwise(role)
        return F.struct(role.alias("role"), unescape(x["body"]).alias("text"))

    return F.transform(rows, one)


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the mask, each stretch unescaped by itself."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("text"))

    def step(acc: Column, run: Column) -> Column:
        more = F.when(run["loss"], unescape(F.substr(formatted, acc["at"], run["chars"]))).otherwise(F.lit(""))
        return F.struct((acc["at"] + run["chars"]).alias("at"), F.concat(acc["text"], more).alias("text"))

    return F.aggregate(mask, start, step, lambda acc: acc["text"])


def records_of(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One JSON record for each conversation of a table of turns, in the layout that fits its roles.

    Turns are ordered by (turn, role, text), null first; repeated rows stay. A conversation is one record, so it must fit into one row.
    One with a text too long for JSON, or with more bytes than a variant surely holds, has a null record and its canonical turns in the
    column `given`. No rows, no conversations.
    """
    said = rows.select(F.col(key).alias("key"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    told = said.groupBy("key").agg(F.sort_array(F.collect_list("t")).alias("t"))
    roles = F.array_join(F.col("t.role"), ",")
    at = lambda i: F.col("t")[i]["text"]
    messages = F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))
    speaker = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    shared = F.to_json(F.struct(F.transform("t", lambda x: F.struct(speaker(x["role"]).alias("from"), x["text"].alias("value"))).alias("conversations")))
    plain = F.forall("t", lambda x: ~x["role"].isin("human", "gpt"))
    record = (
        F.when(roles == "user,assistant", F.to_json(F.struct(at(0).alias("prompt"), at(1).alias("response"))))
        .when(roles == "system,user,assistant", F.to_json(F.struct(at(0).alias("system"), at(1).alias("prompt"), at(2).alias("response"))))
        .when(plain & (F.pmod(F.hash("key"), F.lit(2)) == 0), shared)
        .otherwise(messages)
    )
    total = F.aggregate("t", F.lit(0).cast("long"), lambda acc, x: acc + F.octet_length(x["role"]) + F.octet_length(x["text"]) + FIELD_BYTES)
    long = F.exists("t", lambda x: F.greatest(F.length(x["role"]), F.length(x["text"])) > JSON_TEXT) | (total > JSON_BYTES)
    given = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).cast(TURNS)
    return told.select(F.col("key").alias(key), F.when(~long, record).alias("record"), F.when(long, given).alias("given"))


def format_records(records: DataFrame, json: str = "record", given: str | None = None) -> DataFrame:
    """Add layout, turns, formatted and mask to a table of JSON records; a row without a known record takes the turns of the column
    `given`. No shuffle, no Python. An empty table gives an empty one."""
    found = to_turns(records, json)
    return with_format(found if given is None else found.withColumn("turns", F.coalesce("turns", F.col(given))))
