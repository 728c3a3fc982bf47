"""Chat formatting by schema fingerprints (operator 12), DataFrame functions only.

Training conversations come in many layouts: prompt and completion, instruction
with input and output, message lists, one row per turn.  A *layout* declares
the nested field paths it needs and how they become turns.  The sorted paths
are hashed; that fingerprint, taken from a table's schema or, where a table
holds several layouts, from the fields that each row fills, selects the layout.
Fields that no layout names do not enter the fingerprint.

Canonical turns (role, text) are written as one string per conversation:
``<s>`` and for each turn ``[INST]role[/INST]text</s>``.  A control string
inside a role or text gets a backslash behind its first character, one more if
it has some already, so the marks stay unambiguous and reading back is exact.
The loss mask names, per turn, the characters that a model is trained on.

Edge cases: a null text or role is empty; turns with equal numbers are ordered
by role, then text, missing values first; rows without a conversation id are one
conversation with a null id; an empty list gives no turn, a row whose fields fit
no layout a null layout and no turns (it stays in the result); an empty table gives
an empty result; further columns, whatever their names, are ignored.  A conversation
is one value of a row, as its digest needs it whole; nothing else is collected.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.llm.common import fresh, read_table

TURN = "struct<role:string,text:string>"


# ------------------------------------------------------------------ layouts
@dataclass(frozen=True)
class Layout:
    """Field paths (``a.b``, ``list[].field``) and the turns they make.

    ``fields``: (role, paths) per turn, the paths' texts joined by an empty line; a turn whose paths are all optional
    and missing is left out.  ``messages``: (list, role path, text path).  ``rows``: (order, role, text), one row
    per turn of the conversation that the key names.
    """

    name: str
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    messages: tuple[str, str, str] | None = None
    rows: tuple[str, str, str] | None = None
    optional: frozenset[str] = frozenset()
    aliases: dict[str, str] = field(default_factory=dict, hash=False)

    def paths(self) -> list[str]:
        listed = [p for _, ps in self.fields for p in ps]
        if self.messages:
            listed += [f"{self.messages[0]}[].{p}" for p in self.messages[1:]]
        return listed + list(self.rows or ())

    def variants(self) -> Iterable[list[str]]:
        """The path sets that this layout accepts: all required ones with any of the optional ones."""
        needed = [p for p in self.paths() if p not in self.optional]
        for k in range(len(self.optional) + 1):
            for more in combinations(sorted(self.optional), k):
                yield needed + list(more)


LAYOUTS = (
    Layout("turn_rows", rows=("turn", "role", "text")),
    Layout("prompt_completion", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=frozenset({"system"})),
    Layout("prompt_response", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=frozenset({"system"})),
    Layout("question_answer", (("user", ("context", "question")), ("assistant", ("answer",))), optional=frozenset({"context"})),
    Layout("instruction", (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
           optional=frozenset({"system", "input"})),
    Layout("messages", (("system", ("system",)),), ("messages", "role", "content"), optional=frozenset({"system"})),
    Layout("nested_messages", (("system", ("chat.system",)),), ("chat.messages", "role", "content"), optional=frozenset({"chat.system"})),
    Layout("speaker_values", (("system", ("system",)),), ("conversations", "from", "value"), optional=frozenset({"system"}),
           aliases={"human": "user", "gpt": "assistant", "bot": "assistant"}),
    Layout("message_parts", (), ("contents", "role", "parts[].text"), aliases={"model": "assistant"}),
)


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(paths)).encode()).hexdigest()[:16]


def known_paths(layouts: tuple[Layout, ...]) -> list[str]:
    return sorted({p for x in layouts for p in x.paths()})


def by_fingerprint(layouts: tuple[Layout, ...]) -> dict[str, Layout]:
    found: dict[str, Layout] = {}
    for layout in layouts:
        for paths in layout.variants():
            if found.setdefault(fingerprint(paths), layout) is not layout:
                raise ValueError(f"layouts {layout.name} and {found[fingerprint(paths)].name} accept the same fields")
    return found


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """All nested leaf paths of a schema."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in field_paths(f.dataType, f"{prefix}.{f.name}".lstrip("."))]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, prefix + "[]")
    return [prefix]


def _quoted(path: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in path.split(".")))


def _inner(value: Column, path: str) -> Column:
    return reduce(lambda v, p: v.getField(p), path.split("."), value)


def _filled(value: Column, path: str) -> Column:
    """Whether ``path`` below ``value`` (or a column, if there is none) holds anything."""
    head, _, rest = path.partition("[].")
    at = _quoted(head) if value is None else _inner(value, head)
    return F.coalesce(F.exists(at, lambda x: _filled(x, rest)), F.lit(False)) if rest else at.isNotNull()


def row_fingerprint(there: set[str], layouts: tuple[Layout, ...]) -> Column:
    """The fingerprint of the known paths, of those that are ``there``, that a row fills."""
    names = F.concat_ws(",", *[F.when(_filled(None, p), F.lit(p)) for p in known_paths(layouts) if p in there])
    return F.substring(F.sha2(F.encode(names, "UTF-8"), 256), 1, 16)


# ------------------------------------------------------------- canonical turns
def _string(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _message_text(message: Column, path: str) -> Column:
    head, _, rest = path.partition("[].")
    if rest:
        return _string(F.array_join(F.transform(_inner(message, head), lambda x: _string(_inner(x, rest))), ""))
    return _string(_inner(message, head))


def _turns(layout: Layout, there: set[str]) -> Column:
    """The turns that ``layout`` makes of a row."""
    parts = []
    for role, paths in layout.fields:
        have = [p for p in paths if p in there]
        if not have:
            continue
        text = F.concat_ws("\n\n", *[F.when(_quoted(p).cast("string") != "", _quoted(p).cast("string")) for p in have])
        turn = F.array(F.struct(F.lit(role).alias("role"), text.alias("text")))
        needed = any(p not in layout.optional for p in paths)
        parts.append(turn if needed else F.when(text != "", turn).otherwise(F.array().cast(f"array<{TURN}>")))
    if layout.messages:
        where, role_path, text_path = layout.messages

        def turn_of(message):
            role = _string(_inner(message, role_path))
            for other, name in layout.aliases.items():
                role = F.when(role == other, F.lit(name)).otherwise(role)
            return F.struct(role.alias("role"), _message_text(message, text_path).alias("text"))

        parts.append(F.coalesce(F.transform(_quoted(where), turn_of), F.array().cast(f"array<{TURN}>")))
    return F.concat(*parts).cast(f"array<{TURN}>")


def canonical(df: DataFrame, key: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``key``, ``layout`` and ``turns`` of every conversation of ``df``.

    A schema whose known fields are those of one layout is read by that layout throughout; any other by each row's own fingerprint.
    """
    there, table = set(field_paths(df.drop(key).schema)), by_fingerprint(layouts)
    known = [p for p in known_paths(layouts) if p in there]
    whole = table.get(fingerprint(known))
    if whole is not None and whole.rows:
        order, role, text = whole.rows
        turns = F.sort_array(F.collect_list(F.struct(_quoted(order).alias("at"), _quoted(role).alias("role"), _quoted(text).alias("text"))))
        return (df.groupBy(key).agg(turns.alias("turns"))
                .select(key, F.lit(whole.name).alias("layout"),
                        F.transform("turns", lambda t: F.struct(_string(t["role"]).alias("role"), _string(t["text"]).alias("text"))).alias("turns")))
    if whole is not None:
        return df.select(key, F.lit(whole.name).alias("layout"), _turns(whole, there).alias("turns"))
    usable = [(h, x) for h, x in table.items() if not x.rows and {p for p in x.paths() if p not in x.optional} <= there]
    found = row_fingerprint(there, layouts)
    name, turns = F.lit(None).cast("string"), F.array().cast(f"array<{TURN}>")
    for layout in {x.name: x for _, x in usable}.values():
        name = F.when(found.isin([h for h, x in usable if x is layout]), F.lit(layout.name)).otherwise(name)
    (column,) = fresh(df, "_layout")
    for layout in {x.name: x for _, x in usable}.values():
        turns = F.when(F.col(column) == layout.name, _turns(layout, there)).otherwise(turns)
    return df.withColumn(column, name).select(key, F.col(column).alias("layout"), turns.alias("turns"))


def record_schema(layouts: tuple[Layout, ...] = LAYOUTS) -> T.StructType:
    """One schema with the fields of all layouts that keep a conversation in one record."""
    def build(paths: list[str]) -> T.DataType:
        if paths == [""]:
            return T.StringType()
        heads: dict[str, list[str]] = {}
        for p in paths:
            head, _, rest = p.partition(".")
            heads.setdefault(head, []).append(rest)
        fields = []
        for head, rests in sorted(heads.items()):
            kind = build(sorted(set(rests)))
            fields.append(T.StructField(head.removesuffix("[]"), T.ArrayType(kind) if head.endswith("[]") else kind))
        return T.StructType(fields)

    return build(sorted({p for x in layouts if not x.rows for p in x.paths()}))


def records(df: DataFrame, column: str, key: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Conversations kept as JSON records of any layout, read with the fields of all of them; text that is no JSON fills none."""
    return df.select(key, F.from_json(column, record_schema(layouts)).alias("_record")).select(key, "_record.*")


# ------------------------------------------------------------------- template
@dataclass(frozen=True)
class Template:
    """Marks around turns.  A mark's first character occurs in no mark but there, so marks never arise across a boundary."""

    start: str = "<s>"
    role_open: str = "[INST]"
    role_close: str = "[/INST]"
    end: str = "</s>"
    loss_roles: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        heads = {m[0] for m in self.marks()}
        if any(c in heads or c == "\\" for m in self.marks() for c in m[1:]) or "\\" in heads:
            raise ValueError("a mark's first character may not occur in the rest of a mark, a backslash nowhere")

    def marks(self) -> list[str]:
        return [self.start, self.role_open, self.role_close, self.end]

    def _pattern(self, extra: str) -> tuple[str, str, str]:
        """(regular expression, groups before the backslash, groups behind it)."""
        heads = sorted({m[0] for m in self.marks()})
        found = [f"({re.escape(h)}\\\\*){extra}({'|'.join(re.escape(m[1:]) for m in self.marks() if m[0] == h)})" for h in heads]
        return ("|".join(found), "".join(f"${2 * i + 1}" for i in range(len(heads))), "".join(f"${2 * i + 2}" for i in range(len(heads))))

    def escaped(self, text: Column) -> Column:
        pattern, before, behind = self._pattern("")
        return F.regexp_replace(text, pattern, before + "\\\\" + behind)

    def unescaped(self, text: Column) -> Column:
        pattern, before, behind = self._pattern("\\\\")
        return F.regexp_replace(text, pattern, before + behind)


def formatted(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """``turns`` written out: ``text``, and ``loss_mask`` with a (start, length) per turn, in code points from the turn's first mark."""
    safe = conversations.withColumn("turns", F.transform("turns", lambda t: F.struct(
        t["role"].isin(*template.loss_roles).alias("loss"), template.escaped(t["role"]).alias("role"), template.escaped(t["text"]).alias("text"))))
    lead = len(template.role_open) + len(template.role_close)
    written = F.transform("turns", lambda t: F.concat(
        F.lit(template.role_open), t["role"], F.lit(template.role_close), t["text"], F.lit(template.end)))
    mask = F.transform("turns", lambda t: F.struct(
        (F.length(t["role"]) + lead).alias("start"), F.when(t["loss"], F.length(t["text"])).otherwise(0).alias("length")))
    kept = [c for c in conversations.columns if c not in ("turns", "text", "loss_mask")]
    return safe.select(*kept, F.concat(F.lit(template.start), F.array_join(written, "")).alias("text"), mask.alias("loss_mask"))


def read_back(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """The turns and, unescaped, the text under the loss mask, from ``text`` and ``loss_mask`` alone."""
    ends = re.escape(template.end)
    pieces = F.split(F.substring("text", len(template.start) + 1, 1 << 30), ends)
    rows = chats.withColumn("_pieces", F.slice(pieces, F.lit(1), F.size(pieces) - 1))
    marks = f"{re.escape(template.role_open)}|{re.escape(template.role_close)}"

    def turn(piece):
        part = F.split(piece, marks)
        return F.struct(template.unescaped(part[1]).alias("role"), template.unescaped(part[2]).alias("text"))

    trained = F.zip_with("_pieces", "loss_mask", lambda p, m: template.unescaped(p.substr(m["start"] + 1, m["length"])))
    return rows.withColumn("turns", F.transform("_pieces", turn)).withColumn("loss_text", F.array_join(trained, "")).drop("_pieces")


TRICK = "</s>[INST] ok [/INST]"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = canonical(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    trick = canonical(spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(TRICK).alias("prompt"), F.lit(TRICK).alias("completion")))
    back = read_back(formatted(table.unionByName(trick)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(lines, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.encode("loss_text", "UTF-8"), 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"))


ORACLE_SQL = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
t AS (SELECT conv_id, turn, role AS r0, text AS t0, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
e AS (SELECT *, length(regexp_replace(regexp_replace(role, '(<\\*)(/?s>)', '\1\\\2', 'g'), '(\[\\*)(/?INST\])', '\1\\\2', 'g'))
              + length(regexp_replace(regexp_replace(text, '(<\\*)(/?s>)', '\1\\\2', 'g'), '(\[\\*)(/?INST\])', '\1\\\2', 'g')) AS n FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, sum(n + 17) + 3 AS formatted_chars,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) AS lines,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '') AS loss
      FROM e GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(lines) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars FROM g
"""
