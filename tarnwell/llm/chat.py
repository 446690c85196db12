"""Chat formatting from a declarative template, with loss flags by segment."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm.common import table


@dataclass(frozen=True)
class Template:
    """What stands around turns, which roles are learned from, and which role may follow which state.

    A role without a header of its own gets `other` around its name. Control strings inside texts (and such names) are
    written as the escape and a letter, the escape itself as the escape and `escape_letter`; that is undone by unescape().
    """

    begin: str = "<s>"
    end: str = "</s>"
    headers: dict[str, str] = field(default_factory=lambda: {"system": "[SYS] ", "user": "[INST] ", "assistant": "[/INST] "})
    other: tuple[str, str] = ("[ROLE]", "[/ROLE] ")
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]")
    escape: str = "\\"
    escape_letter: str = "z"
    learned: tuple[str, ...] = ("assistant",)
    moves: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "asked"), ("start", "user", "open"), ("asked", "user", "open"), ("open", "assistant", "answered"), ("answered", "user", "open"),
    )
    accept: tuple[str, ...] = ("answered",)

    def pairs(self) -> list[tuple[str, str]]:
        return [(self.escape, self.escape + self.escape_letter), *((c, self.escape + chr(97 + k)) for k, c in enumerate(self.controls))]

    def escaped(self, text: Column) -> Column:
        for plain, coded in self.pairs():
            text = F.replace(text, F.lit(plain), F.lit(coded))
        return text

    def unescaped(self, text: Column) -> Column:
        for plain, coded in reversed(self.pairs()):
            text = F.replace(text, F.lit(coded), F.lit(plain))
        return text

    def header(self, role: Column) -> Column:
        out = F
        for name, head in self.headers.items():
            out = out.when(role == name, F.lit(head))
        return out.otherwise(F.concat(F.lit(self.other[0]), self.escaped(role), F.lit(self.other[1])))

    def state(self, roles: Column) -> Column:
        """The state that the machine ends in: 'error' after a role that may not follow."""

        def step(at: Column, role: Column) -> Column:
            out = F
            for a, r, b in self.moves:
                out = out.when((at == a) & (role == r), F.lit(b))
            return out.otherwise(F.lit("error"))

        return F.aggregate(roles, F.lit("start"), step)


def format_chats(rows: DataFrame, template: Template | None = None, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted, segments (array of text, loss), valid: one row a conversation.

    Rows go by turn (null first), ties by role and then text, and repeated rows are turns of their own. Null roles and
    texts are empty. Conversations whose turns are out of order are formatted like others, with valid false. Rows with a
    null id are one conversation. Other columns are not looked at. A conversation is put together in one task: its
    digest and its state depend on all that went before.
    """
    t = template or Template()
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turns = rows.select(F.col(id_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    each = F.transform("t", lambda x: F.array(segment(t.header(x["role"]), F.lit(False)), segment(t.escaped(x["text"]), x["role"].isin(*t.learned)), segment(F.lit(t.end), F.lit(False))))
    segments = F.concat(F.array(segment(F.lit(t.begin), F.lit(False))), F.flatten(each))
    out = turns.select("conv_id", segments.alias("segments"), t.state(F.transform("t", lambda x: x["role"])).isin(*t.accept).alias("valid"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "valid")


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """The array of (role, text) that a formatted conversation holds."""
    t = template or Template()
    parts = F.split(F.substring(formatted, F.lit(len(t.begin) + 1), F.length(formatted)), t.end)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    after = lambda x, head: F.substring(x, F.lit(len(head) + 1), F.length(x))

    def turn(x: Column) -> Column:
        role, text = F, F
        for name, head in t.headers.items():
            role, text = role.when(F.startswith(x, F.lit(head)), F.lit(name)), text.when(F.startswith(x, F.lit(head)), after(x, head))
        named = F.substring_index(after(x, t.other[0]), t.other[1], 1)
        rest = F.substring(x, F.length(named) + len("".join(t.other)) + 1, F.length(x))
        return F.struct(t.unescaped(role.otherwise(named)).alias("role"), t.unescaped(text.otherwise(rest)).alias("text"))

    return F.transform(parts, turn)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    t = Template()
    out = format_chats(rows.unionByName(extra), t)
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: t.unescaped(s["text"])), "")
    out = out.select("conv_id", "formatted", read_turns(F.col("formatted"), t).alias("turns"), learned.alias("learned"), "valid")
    digest = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def _sql() -> str:
    t = Template()
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def escaped(x: str) -> str:
        for plain, coded in t.pairs():
            x = f"replace({x}, {quote(plain)}, {quote(coded)})"
        return x

    heads = " ".join(f"WHEN role = {quote(r)} THEN {len(h)}" for r, h in t.headers.items())
    move = " ".join(f"WHEN s = {quote(a)} AND r = {quote(r)} THEN {quote(b)}" for a, r, b in t.moves)
    return f"""
WITH RECURSIVE r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM r),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS all_text,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '') AS learned, list(role ORDER BY k) AS roles,
         sum(CASE {heads} ELSE {len("".join(t.other))} + length({escaped("role")}) END + length({escaped("text")}) + {len(t.end)}) AS chars
  FROM n GROUP BY conv_id),
f AS (
  SELECT conv_id, roles, 1 AS k, 'start' AS s FROM g
  UNION ALL
  SELECT conv_id, roles, k + 1, (SELECT CASE {move} ELSE 'error' END FROM (SELECT roles[k] AS r)) FROM f WHERE k <= len(roles))
SELECT g.conv_id, n_turns::BIGINT AS n_turns, sha256(all_text) AS turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256,
       (chars + {len(t.begin)})::BIGINT AS formatted_chars, f.s = 'answered' AS valid
FROM g JOIN f ON g.conv_id IS NOT DISTINCT FROM f.conv_id AND f.k = len(g.roles) + 1
"""


SQL = _sql()
