"""Operator 4, chat formatting: a finite-state machine over the roles.

A declarative ``Template`` names, per role, the marker before a turn and
whether its text counts for the loss, and the marker after every turn; its
transition table says which role may follow which. Turns come sorted within
their conversation and stream through the machine row by row, so neither a
long conversation nor a hot one is ever held as a whole. The result is one row
per turn with three segments (opening marker, escaped text, closing marker),
of which at most the text carries the loss flag; the formatted conversation is
these segments in order. A conversation that the machine rejects is formatted
like any other, with ``valid`` false from the first wrong turn on.

Escaping: a backslash becomes two, and each other escaped character (the
first characters of the markers) gets a backslash after it. No marker survives
inside a text and the text comes back exactly.

Defined results: null texts are empty texts; a null role is the empty role;
roles that the template doesn't name get the general marker, never count for
the loss and end validity. Rows of equal conversation and turn follow each
other by role and text. An empty table gives no segment. Other columns are
ignored, whatever their names. Rows without a conversation id form one
conversation of their own (id null).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import read, scratch_path

PLANTED = "\\### Assistant: </turn> ok"


@dataclass(frozen=True)
class Template:
    """``after`` maps a state (the last role, ``""`` at the start) to the roles
    that may follow; ``last`` are the states a conversation may end in."""

    names: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: frozenset = frozenset({"assistant"})
    opening: str = "### {}: "
    other: str = "role {}"
    close: str = "</turn>\n"
    after: dict = field(default_factory=lambda: {
        "": frozenset({"system", "user"}), "system": frozenset({"user"}),
        "user": frozenset({"assistant"}), "assistant": frozenset({"user"})})
    last: frozenset = frozenset({"assistant"})

    @property
    def special(self) -> str:
        """The characters that texts may not hold plainly: the markers' first ones."""
        return "".join(sorted({self.opening[0], self.close[0]}))

    def escape(self, text: str, more: str = "") -> str:
        text = text.replace("\\", "\\\\")
        for c in self.special + more:
            text = text.replace(c, c + "\\")
        return text

    def unescape(self, text: str, more: str = "") -> str:
        if "\\" not in text:
            return text
        return re.sub(rf"\\\\|([{re.escape(self.special + more)}])\\", lambda m: m[1] or "\\", text)

    def head(self, role: str) -> str:
        """The opening marker of a role."""
        name = self.names.get(role)
        return self.opening.format(name if name is not None else self.other.format(self.escape(role, ":")))

    def role(self, head: str) -> str:
        """The role that an opening marker stands for."""
        start, end = self.opening.split("{}")
        name = head[len(start): len(head) - len(end)]
        for role, n in self.names.items():
            if n == name:
                return role
        return self.unescape(name[len(self.other.format("")):], ":")


class TurnMachine:
    """States over one conversation at a time; ``feed`` gives a turn's segments."""

    def __init__(self, template: Template):
        self.t, self.key, self.state, self.seq, self.valid = template, (), "", 0, True

    def feed(self, conv, role: str | None, text: str | None) -> tuple:
        if self.key != (conv,):
            self.key, self.state, self.seq, self.valid = (conv,), "", 0, True
        role = role or ""
        self.valid = self.valid and role in self.t.after.get(self.state, ())
        self.state, self.seq = role, self.seq + 1
        return (conv, self.seq, self.t.head(role), self.t.escape(text or ""), self.t.close, role in self.t.loss,
                self.valid, self.valid and role in self.t.last)


SEGMENTS = ("conv_id long, seq long, opening string, body string, closing string, loss boolean, "
            "valid boolean, may_end boolean")


def format_conversations(df: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments of every conversation of ``df`` (conv_id, turn, role, text)."""
    import pyarrow as pa

    t = template or Template()
    ordered = (df.select("conv_id", "turn", "role", "text").repartition("conv_id")
               .sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text"))

    def run(batches: Iterator):
        machine = TurnMachine(t)
        for b in batches:
            rows = [machine.feed(*r) for r in zip(*(c.to_pylist() for c in b.columns))]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=[x.split()[0] for x in SEGMENTS.split(", ")])

    return ordered.mapInArrow(run, SEGMENTS)


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation, from the formatted segments alone: number of turns,
    digest of the turns, length and digest of the texts under the loss mask,
    length of the formatted text, and whether the machine accepted it."""
    import pyarrow as pa

    t = template or Template()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "accepted"]
    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "seq")

    def run(batches: Iterator):
        key, turns, loss = None, None, None
        n = loss_chars = chars = 0
        ok = False

        def done():
            return key[0], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, ok

        for b in batches:
            rows = []
            for conv, _seq, opening, body, closing, flag, _valid, may_end in zip(*(c.to_pylist() for c in b.columns)):
                if key != (conv,):
                    if key is not None:
                        rows.append(done())
                    key, turns, loss, n, loss_chars, chars = (conv,), hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                text = t.unescape(body)
                turns.update(f"{t.role(opening)}\n{text}\n".encode())
                n, chars, ok = n + 1, chars + len(opening) + len(body) + len(closing), may_end
                if flag:
                    loss.update(text.encode())
                    loss_chars += len(text)
            yield as_batch(rows)
        if key is not None:
            yield as_batch([done()])

    def as_batch(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        cols = list(zip(*rows)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                   "loss_sha256 string, formatted_chars long, accepted boolean")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the planted one formatted, written, and read back."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    where = scratch_path(spark, "formatted-chats")
    format_conversations(rows.unionByName(planted)).write.parquet(where)
    return read_back(spark.read.schema(SEGMENTS).parquet(where))


SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
o AS (SELECT *, row_number() OVER w AS seq, coalesce(lag(role) OVER w, '') AS prev
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
r AS (SELECT *, (prev || '>' || role) IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user') AS fine,
        length(text) + len(regexp_extract_all(text, '[\\\\#<]'))
        + CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15
            ELSE 11 + length(role) + len(regexp_extract_all(role, '[\\\\#<:]')) END + 8 AS chars
      FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY seq) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  bool_and(fine) AND arg_max(role, seq) = 'assistant' AS accepted
FROM r GROUP BY conv_id"""
