"""Chat formatting: records of many layouts into one training format.

Data sets keep conversations as prompt and response, as an instruction with its input and output, or as lists of
messages under different names. A record's fingerprint is a hash of the nested field paths that it has, of those that any known layout
names; the fingerprint selects a declarative mapping to canonical turns (role, text). Turns are then
marked by a template, texts escaped so that nothing in them reads as a mark, and the spans that a model learns from (what the
assistant says) are given with the formatted text. All of it is DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spare_names

TURNS = "array<struct<role:string,text:string>>"
SPANS = "array<struct<start:int,length:int>>"
#: Marks of the template, and the pattern of the places where a text needs a backslash: before its own backslashes, and inside a mark.
TURN, TEXT, END = "<turn>", "<text>", "</turn>"
ESCAPED = r"\\|(?<=<)(?=/?turn>|text>)"
#: The role that a model learns to speak.
LEARNED = "assistant"
#: Turn numbers of a table of turns that make one record.
PART = 16
#: A conversation whose texts look like the template's marks; it goes along with every table of turns.
PLANTED = r"\### Assistant: </turn> ok"
PLANTED_ID = -7


@dataclass(frozen=True)
class Field:
    """A path that holds one turn's text; several paths are joined by an empty line. Optional ones may be missing."""

    role: str
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()

    def needed(self) -> set[str]:
        return set(self.paths) - set(self.optional)

    def known(self) -> set[str]:
        return set(self.paths)

    def turns(self, record: Column) -> Column:
        texts = F.filter(F.array(*[F.try_variant_get(record, F.lit(f"$.{p}"), "string") for p in self.paths]), lambda t: t.isNotNull())
        turn = F.array(F.struct(F.lit(self.role).alias("role"), F.array_join(texts, "\n\n").alias("text")))
        present = reduce(lambda a, b: a | b, [F.try_variant_get(record, F.lit(f"$.{p}"), "variant").isNotNull() for p in self.paths])
        return F.when(present, turn).otherwise(F.array().cast(TURNS)).cast(TURNS) if not self.needed() else turn.cast(TURNS)


@dataclass(frozen=True)
class Messages:
    """A list of objects, one for each turn. ``parts``: the text is a list of objects that hold pieces of it."""

    path: str
    role: str
    text: str
    roles: dict[str, str] = field(default_factory=dict, hash=False)
    parts: str | None = None

    def needed(self) -> set[str]:
        return {f"{self.path}[].{self.role}"} | ({f"{self.path}[].{self.text}[].{self.parts}"} if self.parts else set())

    def known(self) -> set[str]:
        return self.needed() | ({f"{self.path}[].{self.text}"} if not self.parts else set())

    def turns(self, record: Column) -> Column:
        def turn(m: Column) -> Column:
            role = F.coalesce(F.try_variant_get(m, F.lit(f"$.{self.role}"), "string"), F.lit(""))
            for theirs, ours in self.roles.items():
                role = F.when(role == theirs, F.lit(ours)).otherwise(role)
            if self.parts:
                pieces = F.try_variant_get(m, F.lit(f"$.{self.text}"), "array<variant>")
                text = F.array_join(F.transform(pieces, lambda p: F.try_variant_get(p, F.lit(f"$.{self.parts}"), "string")), "")
            else:
                text = F.try_variant_get(m, F.lit(f"$.{self.text}"), "string")
            return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))

        return F.coalesce(F.transform(F.try_variant_get(record, F.lit(f"$.{self.path}"), "array<variant>"), turn), F.array().cast(TURNS)).cast(TURNS)


@dataclass(frozen=True)
class Layout:
    """How records of one layout become turns: its sources in the order of their turns."""

    name: str
    sources: tuple[Field | Messages, ...]

    def path_sets(self) -> list[frozenset[str]]:
        """The sets of paths that records of this layout may have."""
        needed = frozenset().union(*[s.needed() for s in self.sources])
        optional = sorted(frozenset().union(*[s.known() for s in self.sources]) - needed)
        return [needed | set(c) for n in range(len(optional) + 1) for c in combinations(optional, n)]

    def turns(self, record: Column) -> Column:
        return F.concat(*[s.turns(record) for s in self.sources])


def one(role: str, path: str) -> Field:
    return Field(role, (path,))


def maybe(role: str, path: str) -> Field:
    return Field(role, (path,), (path,))


LAYOUTS = (
    Layout("prompt and completion", (maybe("system", "system"), one("user", "prompt"), one("assistant", "completion"))),
    Layout("prompt and response", (maybe("system", "system"), one("user", "prompt"), one("assistant", "response"))),
    Layout("question and answer", (maybe("system", "system"), one("user", "question"), one("assistant", "answer"))),
    Layout("instruction", (maybe("system", "system"), Field("user", ("instruction", "input"), ("input",)), one("assistant", "output"))),
    Layout("messages", (Messages("messages", "role", "content"),)),
    Layout("messages in parts", (Messages("messages", "role", "content", parts="text"),)),
    Layout("from and value", (maybe("system", "system"), Messages("conversations", "from", "value", {"human": "user", "gpt": "assistant"}))),
)


def paths_of(record: Column) -> Column:
    """The nested field paths of a variant, ``a.b`` for a field and ``a[].b`` for one of a list's elements, each once and in order.

    A list whose elements differ in kind ends in ``?``. What isn't an object or a list has the path ''.
    """
    tokens = F.regexp_extract_all(F.schema_of_variant(record), F.lit(r"((?:`(?:[^`]|``)*`|\w+): |OBJECT<|ARRAY<|>|[A-Z_]+)"), 1)
    start = F.struct(F.array(F.lit("")).alias("open"), F.lit("").alias("at"), F.array().cast("array<string>").alias("paths"))

    def step(s: Column, token: Column) -> Column:
        above = F.element_at(s["open"], -1)
        name = F.regexp_replace(F.regexp_replace(token, "^`|`?: $", ""), "``", "`")
        opens, closes, named = token.endswith("<"), token == ">", token.endswith(": ")
        at = (F.when(named, F.concat(above, F.when(above != "", F.lit(".")).otherwise(F.lit("")), name))
              .when(token == "ARRAY<", F.concat(s["at"], F.lit("[]"))).when(token == "VARIANT", F.concat(s["at"], F.lit("?"))).otherwise(s["at"]))
        stack = F.when(opens, F.array_append(s["open"], at)).when(closes, F.slice(s["open"], 1, F.size(s["open"]) - 1)).otherwise(s["open"])
        found = F.when(opens | closes | named, s["paths"]).otherwise(F.array_append(s["paths"], at))
        return F.struct(stack.alias("open"), at.alias("at"), found.alias("paths"))

    return F.array_sort(F.array_distinct(F.aggregate(tokens, start, step)["paths"]))


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def canonical(records: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records`` with fingerprint (long), layout (string) and turns (array of role and text).

    ``record`` names a column of JSON text, a variant, or a struct. Paths that no layout names don't matter. A null or broken record
    has no fingerprint; that and an unknown fingerprint give a null layout and null turns. A null text is an empty one, a null role ''.
    New columns whose name is taken get a longer one.
    """
    names = spare_names(records, "fingerprint", "layout", "turns", "v")
    kind = records.schema[record].dataType.typeName()
    value = F.col(f"`{record}`")
    value = F.try_parse_json(value) if kind == "string" else value if kind == "variant" else F.to_variant_object(value)
    out = records.withColumn(names[3], value)
    v, f = F.col(names[3]), F.col(names[0])
    known = sorted(set().union(*[s for layout in layouts for s in layout.path_sets()]))
    # A list that differs in kind, and an empty list, keep their path as it is.
    vocabulary = F.array(*[F.lit(p + end) for p in known for end in ("", "?")], *[F.lit(p + "[]") for p in sorted({p.partition("[]")[0] for p in known if "[]" in p})])
    out = out.withColumn(names[0], F.when(v.isNotNull(), fingerprint(F.array_intersect(paths_of(v), vocabulary))))
    prints = {}
    for layout in layouts:
        for s in layout.path_sets():
            if prints.setdefault(s, layout) is not layout:
                raise ValueError(f"{layout.name} and {prints[s].name} both describe {sorted(s)}")
    is_of = {layout: f.isin(*[fingerprint(F.array(*[F.lit(p) for p in sorted(s)])) for s, of in prints.items() if of is layout]) for layout in layouts}

    def select(value) -> Column:
        return reduce(lambda c, layout: c.when(is_of[layout], value(layout)), layouts[1:], F.when(is_of[layouts[0]], value(layouts[0])))

    return out.withColumn(names[1], select(lambda x: F.lit(x.name))).withColumn(names[2], select(lambda x: x.turns(v))).drop(names[3])


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: Column) -> Column:
    """Struct of the formatted text and the spans (start from 0 and length, in code points of that text) that are learned."""
    pieces = F.transform(turns, lambda t: F.struct(
        F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)).alias("head"), escape(t["text"]).alias("body"), (t["role"] == LEARNED).alias("learned")))
    whole = F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")

    def step(s: Column, p: Column) -> Column:
        start, size = s["at"] + F.length(p["head"]), F.length(p["body"])
        spans = F.when(p["learned"], F.array_append(s["spans"], F.struct(start.alias("start"), size.alias("length")))).otherwise(s["spans"])
        return F.struct((start + size + len(END)).alias("at"), spans.alias("spans"))

    spans = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans")), step)["spans"]
    return F.struct(whole.alias("formatted"), spans.alias("loss_spans"))


def format_records(records: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``canonical`` records with formatted (string) and loss_spans; both null where the layout is unknown, '' and empty without turns."""
    out = canonical(records, record, layouts)
    turns = out.columns[-1]
    text, spans, both = spare_names(out, "formatted", "loss_spans", "f")
    out = out.withColumn(both, F.when(F.col(f"`{turns}`").isNotNull(), formatted(F.col(f"`{turns}`"))))
    return out.withColumn(text, F.col(f"`{both}`.formatted")).withColumn(spans, F.col(f"`{both}`.loss_spans")).drop(both)


def read_turns(text: Column) -> Column:
    """The turns of a formatted text."""
    marked = F.split(text, END, -1)
    return F.transform(F.slice(marked, 1, F.size(marked) - 1), lambda m: F.struct(
        unescape(F.substr(F.element_at(F.split(m, TEXT, -1), 1), F.lit(len(TURN) + 1))).alias("role"),
        unescape(F.element_at(F.split(m, TEXT, -1), 2)).alias("text")))


def read_loss(text: Column, spans: Column) -> Column:
    """What the spans of a formatted text cover, as it was before it was escaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(text, s["start"] + 1, s["length"]))), "")


def gather(turns: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, part, turns) of rows (conv_id, turn, role, text): a conversation's turns by turn number, ``part`` numbers a row.

    Rows of one number are ordered by role and text, and rows that repeat are turns of their own; a null number comes first. Null roles and
    texts are empty. Rows without a conv_id make one conversation. Parts keep a conversation of very many turns out of one record.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    parts = rows.groupBy("conv_id", F.floor(F.col("turn") / part).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return parts.select("conv_id", "part", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def as_published(parts: DataFrame) -> DataFrame:
    """``parts`` with a variant ``record`` in the layouts in which such conversations are published: one exchange as prompt and
    response or question and answer, with a system text where there is one, longer ones as messages or as from and value."""
    t = F.col("turns")
    roles = F.array_join(F.transform(t, lambda x: x["role"]), "\n")
    even = F.pmod(F.xxhash64("conv_id"), F.lit(2)) == 0

    def text(i: int) -> Column:
        return F.element_at(t, i)["text"]

    def variant(**fields: Column) -> Column:
        return F.to_variant_object(F.struct(*[c.alias(name) for name, c in fields.items()]))

    messages = F.transform(t, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    theirs = F.transform(t, lambda x: F.struct(F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"]).alias("from"),
                                               x["text"].alias("value")))
    plain = F.forall(t, lambda x: x["role"].isin("system", "user", "assistant"))
    record = (F.when((roles == "user\nassistant") & even, variant(prompt=text(1), completion=text(2)))
              .when(roles == "user\nassistant", variant(question=text(1), answer=text(2)))
              .when((roles == "system\nuser\nassistant") & even, variant(system=text(1), instruction=text(2), output=text(3)))
              .when(roles == "system\nuser\nassistant", variant(system=text(1), prompt=text(2), response=text(3)))
              .when(plain & even, variant(conversations=theirs)).otherwise(variant(messages=messages)))
    return parts.select("conv_id", "part", record.alias("record"))


def planted(spark: SparkSession) -> DataFrame:
    return spark.range(2).select(F.lit(PLANTED_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))


def op13_chat_format(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Every conversation as formatted and read back, as its contract names the columns.

    See ``gather`` for nulls, ties and repeated rows; an empty table gives the planted conversation alone; other columns are
    not read. The digests are of whole conversations, so a conversation's formatted parts meet in one row.
    """
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(planted(spark))
    out = format_records(as_published(gather(rows)), "record").select("conv_id", F.struct("part", "formatted", "loss_spans").alias("p"))
    # Read back from the formatted parts alone.
    whole = out.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    turns = F.flatten(F.transform("p", lambda p: read_turns(p["formatted"])))
    loss = F.array_join(F.transform("p", lambda p: read_loss(p["formatted"], p["loss_spans"])), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.withColumn("turns", turns).withColumn("loss", loss).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.aggregate("p", F.lit(0).cast("long"), lambda n, p: n + F.length(p["formatted"])).alias("formatted_chars"))


def _escaped_length(c: str) -> str:
    marks = " + ".join(f"(length({c}) - length(replace({c}, '{m}', ''))) / {len(m)}" for m in (TURN, TEXT, END))
    return f"(length({c}) + length({c}) - length(replace({c}, '\\', '')) + {marks})"


ORACLE = f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    VALUES ({PLANTED_ID}, 0, 'user', '{PLANTED}'), ({PLANTED_ID}, 1, 'assistant', '{PLANTED}'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = '{LEARNED}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = '{LEARNED}'), '')) AS loss_sha256,
       sum({len(TURN) + len(TEXT) + len(END)} + {_escaped_length("role")} + {_escaped_length("text")})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
