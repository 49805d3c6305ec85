"""Chat formatting by incremental black-box rendering.

A template is any function from turns (and the number of the first of them) to
a string.  Its turns' places are not asked from the template: the successive
prefixes of a conversation are rendered, and what each output adds to the one
before is the span of the new turn.  An output that does not start with the
one before shows a template that rewrites history; such a conversation is
marked, and its spans start where the two outputs part.

A conversation is rendered in windows of ``WINDOW`` turns: after that many the
window starts again at the last turn, whose own rendering must be what the
longer output ended with (else the template depends on more than the turns of
the window, which counts as rewriting).  So a conversation of n turns costs
n * WINDOW renderings of a turn.  A template that changes a turn from before the
window is found by rendering the whole conversation at 2, 4, 8, ... windows and
after its last turn, and comparing the digest with what has been given out: at
most three renderings of each turn more.  For that ``format_conversations``
holds the turns of one conversation; with ``recheck=False``, for templates that
are known to add turns only, a task holds one window.  The digests are made
with it, too: that a template adds turns only is found, never taken for granted.

Rows are dealt by conversation and read in order (turn, then role and text)
as a stream; a conversation with a third of all rows is one long stream in one
task, as its running digests need, but is never held whole there.

Cases: a null text or role is empty; repeated rows and equal turn numbers are
turns of their own, in the stated order; rows without conversation id form one
conversation; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import col

WINDOW = 64
Turn = tuple[str, str]
Template = Callable[[list[Turn], int], str]

_ESCAPES = {"\\": "\\\\", "<": "\\l", '"': "\\q", "\n": "\\n"}
_PLAIN = {v[1]: k for k, v in _ESCAPES.items()}
_TURN = re.compile(r'<turn role="([^"]*)">\n(.*)\n</turn>\n', re.S)


def escape(text: str) -> str:
    """No ``<`` is left, so a text can hold no mark of the template."""
    return text.replace("\\", "\\\\").replace("<", "\\l")


def escape_role(role: str) -> str:
    return escape(role).replace('"', "\\q").replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _PLAIN[m[1]], text) if "\\" in text else text


def marked_template(turns: list[Turn], first: int = 0) -> str:
    """The library's own template: every turn between marks, texts escaped."""
    return "".join([f'<turn role="{escape_role(r)}">\n{escape(t)}\n</turn>\n' for r, t in turns])


def read_turn(chunk: str) -> tuple[str, str, tuple[int, int]]:
    """Role, text and the place of the escaped text in one turn's output."""
    m = _TURN.fullmatch(chunk)
    if not m:
        raise ValueError("not one turn of the marked template")
    return unescape(m[1]), unescape(m[2]), m.span(2)


class Renderer:
    """Feeds turns one by one; gives the output that each has added."""

    def __init__(self, template: Template = marked_template, window: int = WINDOW, recheck: bool = True):
        self.template, self.window, self.recheck = template, max(2, window), recheck
        self.turns: list[Turn] = []
        self.whole: list[Turn] = []  # with recheck only
        self.next_check = 2 * self.window
        self.first, self.before, self.size, self.rewrites = 0, template([], 0), 0, False
        self.size = len(self.before)
        self.given = hashlib.sha256(self.before.encode("utf-8", "replace"))

    def check(self) -> None:
        """Compares the whole conversation, rendered at once, with the output given out."""
        if self.recheck and not self.rewrites and self.first:  # else one window has seen all
            self.rewrites = hashlib.sha256(self.template(self.whole, 0).encode("utf-8", "replace")).digest() != self.given.digest()

    def feed(self, role: str | None, text: str | None) -> tuple[int, str]:
        """(place in the whole output, added output) of the next turn."""
        if len(self.turns) >= self.window:
            self.first += len(self.turns) - 1
            self.turns = self.turns[-1:]
            alone = self.template(self.turns, self.first)
            self.rewrites |= not self.before.endswith(alone)
            self.before = alone
        self.turns.append((role or "", text or ""))
        now, old = self.template(self.turns, self.first), self.before
        if not now.startswith(old):
            self.rewrites = True
            shared = next((k for k, (a, b) in enumerate(zip(now, old)) if a != b), min(len(now), len(old)))
            self.size -= len(old) - shared
            old = old[:shared]
        place, added = self.size, now[len(old):]
        self.before, self.size = now, self.size + len(added)
        if self.recheck:
            self.whole.append(self.turns[-1])
            self.given.update(added.encode("utf-8", "replace"))
            if len(self.whole) == self.next_check:
                self.check()
                self.next_check *= 2
        return place, added


def _conversations(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    rows = df.select(col(conv).alias("conv_id"), col(turn).alias("turn"), col(role).cast("string").alias("role"),
                     col(text).cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _turns(batches) -> Iterator[tuple[object, str | None, str | None]]:
    for batch in batches:
        ids, roles, texts = batch.column(0), batch.column(2), batch.column(3)
        for k in range(batch.num_rows):
            yield ids[k].as_py(), roles[k].as_py(), texts[k].as_py()


def format_conversations(df: DataFrame, template: Template = marked_template, conv: str = "conv_id",
                         turn: str = "turn", role: str = "role", text: str = "text",
                         window: int = WINDOW, recheck: bool = True) -> DataFrame:
    """One row a turn: conv_id, turn_no (from 0), role, span_start and span_end
    in the whole output, the added output, and rewrites_history (whether the
    template is seen to have changed earlier output up to this turn; the last
    turn's says it for the whole conversation).  The rows' outputs, joined by
    turn_no, are the formatted conversation where nothing was rewritten."""
    source = _conversations(df, conv, turn, role, text)
    kind = source.schema["conv_id"].dataType.simpleString()

    def run(batches):
        now, renderer, no, out = None, None, 0, []
        for key, r, t in _turns(batches):
            if renderer is None or key != now:
                if renderer is not None:
                    end(renderer, out)
                    if len(out) >= 256:
                        yield _batch(out, names, types)
                        out = []
                now, renderer, no = key, Renderer(template, window, recheck), 0
            place, added = renderer.feed(r, t)
            out.append((key, no, r or "", place, place + len(added), added, renderer.rewrites))
            no += 1
            if len(out) >= 256:
                yield _batch(out[:-1], names, types)
                out = out[-1:]  # the last row waits for the end of its conversation
        if out:
            end(renderer, out)
            yield _batch(out, names, types)

    def end(renderer: Renderer, out: list[tuple]) -> None:
        renderer.check()
        out[-1] = (*out[-1][:-1], renderer.rewrites)

    names = ["conv_id", "turn_no", "role", "span_start", "span_end", "output", "rewrites_history"]
    types = [to_arrow_type(source.schema["conv_id"].dataType), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    return source.mapInArrow(run, f"conv_id {kind}, turn_no bigint, role string, span_start bigint, span_end bigint, "
                                  "output string, rewrites_history boolean")


def conversation_digests(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", loss_role: str = "assistant", window: int = WINDOW,
                         template: Template = marked_template) -> DataFrame:
    """One row a conversation, read back from the output of the template (of the
    marks of ``marked_template``):
    n_turns, turns_sha256 (role, newline, text, newline of each turn),
    loss_chars and loss_sha256 (the unescaped text under the loss mask, which
    covers the texts of ``loss_role``), formatted_chars, rewrites_history (also of
    turns before the window)."""
    source = _conversations(df, conv, turn, role, text)
    kind = source.schema["conv_id"].dataType.simpleString()

    def run(batches):
        now, renderer, out = None, None, []

        def done(renderer):
            renderer.check()
            return now, n, turns.hexdigest(), loss, masked.hexdigest(), renderer.size, renderer.rewrites

        for key, r, t in _turns(batches):
            if renderer is None or key != now:
                if renderer is not None:
                    out.append(done(renderer))
                    if len(out) >= 1024:
                        yield _batch(out, names, types)
                        out = []
                now, renderer = key, Renderer(template, window)
                n = loss = 0
                turns, masked = hashlib.sha256(), hashlib.sha256()
            _, added = renderer.feed(r, t)
            said, plain, (a, b) = read_turn(added)
            n += 1
            turns.update(f"{said}\n{plain}\n".encode("utf-8", "replace"))
            if said == loss_role:
                under = unescape(added[a:b])
                loss += len(under)
                masked.update(under.encode("utf-8", "replace"))
        if renderer is not None:
            out.append(done(renderer))
        if out:
            yield _batch(out, names, types)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"]
    types = [to_arrow_type(source.schema["conv_id"].dataType), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    return source.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                  "loss_sha256 string, formatted_chars bigint, rewrites_history boolean")


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def with_probe(df: DataFrame) -> DataFrame:
    """``df`` and conversation -7, whose texts hold another template's marks."""
    text = F.lit("\\### Assistant: </turn> ok")
    probe = (df.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text")))
    return df.select("conv_id", "turn", "role", "text").unionByName(probe)


# The same digests, from the rows themselves and the lengths of the marks.
ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<turn role="">') + 1 + length('</turn>') + 2
    + length(replace(replace(replace(replace(role, '\', '\\'), '<', '\l'), '"', '\q'), chr(10), '\n'))
    + length(replace(replace(text, '\', '\\'), '<', '\l'))) AS BIGINT) AS formatted_chars,
  false AS rewrites_history
FROM rows GROUP BY conv_id
"""
