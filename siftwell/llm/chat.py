"""Conversations to training text with turn marks and a loss mask, through a compiled template.

Control strings inside roles and texts are broken up reversibly: a backslash doubles, and a control
string gets a backslash after its first character. So a control string in the output is always a mark,
and the output alone tells the turns again (:class:`Reader`).

Turns are ordered by turn, then role and text (ties, repeated rows; null turns first); null roles and
texts are empty; rows with a null conv_id make one conversation. A conversation is streamed turn by turn
from its sorted partition, so its length does not bound memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.template import compile_template

OPEN, BODY, SHUT, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROLS = (OPEN, BODY, SHUT, END)
TEMPLATE = (
    "{% for m in messages %}<s>{{ m.role | escape }}[INST]"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% else %}{{ m.text | escape }}[/INST]{% endif %}{% endfor %}"
)
_GUARD = re.compile("|".join(map(re.escape, ("\\", *CONTROLS))))
_PLAIN = re.compile(r"\\(\\?)")
_MARK = re.compile("|".join(map(re.escape, CONTROLS)))
_LONGEST = max(map(len, CONTROLS))


def escape(text: object) -> str:
    return _GUARD.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", "" if text is None else str(text))


def unescape(text: str) -> str:
    return _PLAIN.sub(r"\1", text)


def renderer(template: str = TEMPLATE):
    return compile_template(template, {"escape": escape})


class Reader:
    """Reads turns and masked text back from formatted output, piece by piece; holds one turn at most."""

    def __init__(self) -> None:
        self.turns = self.chars = self.loss_chars = 0
        self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()
        self.held: list[str] = []
        self.tail = ""
        self.masked: list[str] = []

    def feed(self, text: str, masked: bool) -> None:
        if masked:
            self.masked.append(text)
        elif self.masked:
            self._mask_ends()
        self.chars += len(text)
        self.held.append(text)
        seen = self.tail + text
        self.tail = seen[-_LONGEST:]
        if SHUT in seen or END in seen:
            self._take_turns()

    def _mask_ends(self) -> None:
        plain = unescape("".join(self.masked))
        self.masked = []
        self.loss_chars += len(plain)
        self.loss_hash.update(plain.encode("utf-8", "surrogatepass"))

    def _take_turns(self) -> None:
        text, at = "".join(self.held), 0
        marks: list[tuple[str, int, int]] = []
        for m in _MARK.finditer(text):
            marks.append((m[0], m.start(), m.end()))
            if m[0] in (SHUT, END):
                (a, _, role_at), (b, role_end, text_at), (_, text_end, done) = marks
                if a != OPEN or b != BODY:
                    raise ValueError("the output does not follow the turn marks")
                turn = f"{unescape(text[role_at:role_end])}\n{unescape(text[text_at:text_end])}\n"
                self.turn_hash.update(turn.encode("utf-8", "surrogatepass"))
                self.turns += 1
                marks, at = [], done
        self.held, self.tail = [text[at:]], ""

    def close(self) -> tuple[int, str, int, str, int]:
        if self.masked:
            self._mask_ends()
        if "".join(self.held):
            raise ValueError("the output ends inside a turn")
        return self.turns, self.turn_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars


def _sorted(conversations: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    slim = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), text("role"), text("text"))
    return slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    rows = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()))
    for conv_id, group in groupby(rows, key=lambda r: r[0]):
        yield conv_id, ({"role": role, "text": text} for _, role, text in group)


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, formatted, spans): the output of each conversation and its masked spans [start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = renderer(template)
        for conv_id, messages in _conversations(batches):
            parts: list[str] = []
            spans: list[list[int]] = []
            at = 0

            def emit(text: str, masked: bool) -> None:
                nonlocal at
                parts.append(text)
                if masked and text:
                    if spans and spans[-1][1] == at:
                        spans[-1][1] = at + len(text)
                    else:
                        spans.append([at, at + len(text)])
                at += len(text)

            render({"messages": messages}, emit)
            yield pa.RecordBatch.from_arrays([pa.array([conv_id], pa.int64()), pa.array(["".join(parts)], pa.string()), pa.array([spans], pa.list_(pa.list_(pa.int64())))], names=["conv_id", "formatted", "spans"])

    return _sorted(conversations).mapInArrow(run, "conv_id bigint, formatted string, spans array<array<bigint>>")


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def digest_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """What the formatted output of each conversation says when read back, without keeping it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = renderer(template)
        names = [c.split()[0] for c in DIGEST.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

        for conv_id, messages in _conversations(batches):
            reader = Reader()
            render({"messages": messages}, reader.feed)
            held.append((conv_id, *reader.close()))
            if len(held) >= 4096:
                yield batch()
                held = []
        if held:
            yield batch()

    return _sorted(conversations).mapInArrow(run, DIGEST)


CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *,
    len(replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '</s>', '<\/s>'))
    + len(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '</s>', '<\/s>'))
    + CASE WHEN role = 'assistant' THEN 13 ELSE 16 END AS out_chars
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(out_chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
