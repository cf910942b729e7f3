"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to one string.
Successive turn prefixes are rendered; where each output extends the one
before, the new part is that turn's span. A template that changes what it
wrote earlier (trimming old turns, say) breaks this and is reported. A text's
place inside its span is found by rendering the turn once more with a probe
character in its stead.

Rows are streamed in (conversation, turn) order. Any template is given the
whole conversation's prefixes, however long it is, so that a rewrite is found
wherever it reaches. Only a template that declares each turn independent of
the others is rendered fragment by fragment, so that memory holds one fragment
and the work stays linear; the declaration is tested at each border.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]
PROBE = "\ue000"


@dataclass(frozen=True)
class Template:
    """render() writes turns, parse() reads them back, escape() is what render() does to a text.

    independent: the rendering of turns is that of each alone, joined.
    """

    render: Callable[[Turns], str]
    parse: Callable[[str], Turns]
    escape: Callable[[str], str]
    unescape: Callable[[str], str]
    independent: bool = False


def escape(text: str) -> str:
    r"""No "<" is left, so that no control string can stand in a text: \ becomes \\ and < becomes \l."""
    return text.replace("\\", "\\\\").replace("<", "\\l")


def _escape_role(role: str) -> str:
    return escape(role).replace(">", "\\g").replace("\n", "\\n")


_BACK = {"\\": "\\", "l": "<", "g": ">", "n": "\n"}


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text)


def render_tagged(turns: Turns) -> str:
    return "".join([f"<turn {_escape_role(role)}>\n{escape(text)}\n</turn>\n" for role, text in turns])


def parse_tagged(out: str) -> Turns:
    return [(unescape(role), unescape(text)) for role, text in re.findall(r"<turn ([^<>\n]*)>\n([^<]*)\n</turn>\n", out)]


TAGGED = Template(render_tagged, parse_tagged, escape, unescape, independent=True)


@dataclass
class Located:
    text: str
    spans: list[tuple[int, int]]  # of turns
    bodies: list[tuple[int, int]]  # of their escaped texts
    rewrites: bool


def locate(turns: Turns, template: Template) -> Located:
    """Render prefix after prefix and find each turn and each text in the last output."""
    out, spans, bodies, rewrites = "", [], [], False
    for k, (role, text) in enumerate(turns):
        longer = template.render(turns[: k + 1])
        if not longer.startswith(out):
            rewrites = True
            common = next((i for i, (a, b) in enumerate(zip(out, longer)) if a != b), min(len(out), len(longer)))
            spans.append((common, len(longer)))
        else:
            spans.append((len(out), len(longer)))
        probe = template.render([*turns[:k], (role, PROBE)])
        at = probe.rfind(PROBE)
        bodies.append((at, at + len(template.escape(text))) if at >= 0 else (len(longer), len(longer)))
        out = longer
    return Located(out, spans, bodies, rewrites)


class _Conversation:
    def __init__(self, key: int | None, template: Template, loss_role: str, keep_text: bool):
        self.key, self.template, self.loss_role, self.keep_text = key, template, loss_role, keep_text
        self.turns: Turns = []
        self.last: Turns = []
        self.n = self.loss_chars = self.chars = 0
        self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()
        self.rewrites = False
        self.parts: list[str] = []
        self.spans: list[dict] = []

    def flush(self) -> None:
        if not self.turns:
            return
        found = locate(self.turns, self.template)
        self.rewrites |= found.rewrites
        if self.last:  # the declared independence, at the border of two fragments
            border = [*self.last, self.turns[0]]
            self.rewrites |= self.template.render(border) != "".join([self.template.render([t]) for t in border])
        self.last = self.turns[-1:]
        read = self.template.parse(found.text)
        for role, text in read:
            self.turn_hash.update(f"{role}\n{text}\n".encode())
        for (role, _), (start, stop), (a, b) in zip(read, found.spans, found.bodies):
            loss = role == self.loss_role
            if loss:
                text = self.template.unescape(found.text[a:b])
                self.loss_chars += len(text)
                self.loss_hash.update(text.encode())
            if self.keep_text:
                self.spans.append({"start": self.chars + start, "end": self.chars + stop, "text_start": self.chars + a, "text_end": self.chars + b, "loss": loss})
        self.n += len(read)
        self.chars += len(found.text)
        if self.keep_text:
            self.parts.append(found.text)
        self.turns = []

    def row(self) -> dict:
        self.flush()
        out = {"conv_id": self.key, "n_turns": self.n, "turns_sha256": self.turn_hash.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss_hash.hexdigest(), "formatted_chars": self.chars, "rewrites_history": self.rewrites}
        return out | ({"formatted": "".join(self.parts), "spans": self.spans} if self.keep_text else {})


_DIGEST = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites_history", pa.bool_())]
_TEXT = [("formatted", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("loss", pa.bool_())])))]
_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean"
_TEXT_DDL = ", formatted string, spans array<struct<start:long,end:long,text_start:long,text_end:long,loss:boolean>>"


def format_conversations(rows: DataFrame, template: Template = TAGGED, loss_role: str = "assistant", keep_text: bool = True, fragment: int = 256) -> DataFrame:
    """Format every conversation of (conv_id, turn, role, text) rows.

    Returns per conversation the formatted string, its turns' spans with the
    loss mask (both only with keep_text), and digests read back from the
    output. Null text or role: empty. Null conv_id: a conversation of its own.
    Rows of one turn number keep the order (role, text); repeated rows are
    repeated turns. An empty table gives an empty one. Other columns are
    ignored. One shuffle, by conv_id; a conversation is digested in order, so
    it is one task's, as a stream. A template that is not independent is given
    each conversation whole: its memory and, as prefixes are rendered again, the
    square of its turns are that task's.
    """
    schema = pa.schema(_DIGEST + (_TEXT if keep_text else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: _Conversation | None = None
        done: list[dict] = []
        for batch in batches:
            for key, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if at is None or at.key != key:
                    if at is not None:
                        done.append(at.row())
                    at = _Conversation(key, template, loss_role, keep_text)
                at.turns.append((role, text))
                if template.independent and len(at.turns) >= fragment:
                    at.flush()
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if at is not None:
            yield pa.RecordBatch.from_pylist([at.row()], schema)

    plain = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, _DDL + _TEXT_DDL * keep_text)
