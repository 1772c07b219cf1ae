"""Chat formatting with templates taken as black boxes.

A template is anything that renders a list of turns to one string. ``format_conversations`` renders each prefix of a
conversation, one turn more each time, and compares it with the one before: what was added is the turn's span, and a
prefix that isn't kept as it was shows that the template rewrites history. Where a text lies within its span follows
from one more rendering with a probe in its place, so loss masks need no knowledge of the template either.

Rendering all prefixes costs the square of a conversation's length. A template whose own class says ``stateless = True``
renders a turn alike wherever it stands, so with it longer conversations are rendered in segments of ``max_turns`` turns,
each a row of its own; a task holds one segment. Any other template gets the whole history, whatever its length. Rows are
dealt by conversation and sorted by turn.

Edge cases: a null text or role is an empty one; rows without a conversation id are one conversation; rows of one turn
are ordered by role and text; an empty table gives an empty result; other columns are ignored. A conversation whose
template rewrites history, or alters a text, has no loss spans and says at which turn (``rewritten_at``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.llm.common import partitions

Turn = tuple[str, str]
#: Strings that mark structure in this or another template and never stay as they are inside a text.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>")
MAX_TURNS = 512
PROBE = "\ue000"

_BEGIN = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<s>((?:[^\\\n]|\\.)*)\n((?:[^\\]|\\.)*?)</s>", re.DOTALL)


@lru_cache(2048)
def escape(text: str) -> str:
    """``text`` with a backslash before each backslash and after the first character of each control string."""
    return _BEGIN.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


class MarkedTurns:
    """The default template: ``<s>role``, a new line, the text, ``</s>``."""

    stateless = True

    def render(self, turns: list[Turn]) -> str:
        return "".join([f"<s>{_role(r)}\n{escape(t)}</s>" for r, t in turns])

    def parse(self, formatted: str) -> list[Turn]:
        found, at = [], 0
        for m in _TURN.finditer(formatted):
            if m.start() != at:
                break
            found.append((unescape(m[1]), unescape(m[2])))
            at = m.end()
        if at != len(formatted):
            raise ValueError(f"not made by this template at character {at}")
        return found


@lru_cache(256)
def _role(role: str) -> str:
    return escape(role).replace("\n", "\\\n")


def locate(render: Callable[[list[Turn]], str], turns: list[Turn], learn: Callable[[str], bool], read: Callable[[str], str] = unescape):
    """Renders growing prefixes: the last rendering, each turn's span, the text spans of turns whose role ``learn`` takes,
    and the first turn at which the template rewrote what it had said or a text can't be read back (else None)."""
    before, spans, loss, rewritten = "", [], [], None
    for k, (role, text) in enumerate(turns):
        now = render(turns[: k + 1])
        if not now.startswith(before):
            rewritten = k if rewritten is None else rewritten
        spans.append((min(len(before), len(now)), len(now)))
        if learn(role) and rewritten is None:
            probed = render([*turns[:k], (role, PROBE)])
            at = probed.find(PROBE, len(before))
            end = len(now) - (len(probed) - at - 1)
            if at < 0 or now[:at] != probed[:at] or now[end:] != probed[at + 1 :] or end < at or read(now[at:end]) != text:
                rewritten = k
            else:
                loss.append((at, end))
        before = now
    return before, spans, [] if rewritten is not None else loss, rewritten


FORMATTED = "conv_id bigint, segment int, n_turns int, formatted string, starts array<int>, ends array<int>, loss_starts array<int>, loss_ends array<int>, rewritten_at int"


def format_conversations(df: DataFrame, template=None, loss_role: str = "assistant", max_turns: int = MAX_TURNS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each segment of a conversation (the whole one, unless the template is stateless), FORMATTED; spans count code points of ``formatted``, end exclusive.

    A conversation's segments follow each other in one partition. ``rewritten_at`` counts turns of the conversation."""
    made = template or MarkedTurns()
    parted = vars(type(made)).get("stateless", False)  # a subclass may render otherwise, so it has to say so itself
    rows = df.select(
        F.col(conv_col).cast("bigint").alias("c"),
        F.col(turn_col).cast("bigint").alias("n"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("r"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"),
    )
    dealt = rows.repartition(partitions(df.sparkSession), "c").sortWithinPartitions("c", "n", "r", "t")

    def segment(conv: int | None, number: int, turns: list[Turn]) -> tuple:
        text, spans, loss, bad = locate(made.render, turns, lambda role: role == loss_role)
        bad = None if bad is None else number * max_turns + bad
        return conv, number, len(turns), text, [a for a, _ in spans], [b for _, b in spans], [a for a, _ in loss], [b for _, b in loss], bad

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, number, turns, out, size = None, 0, [], [], 0
        for batch in batches:
            for c, r, t in zip(*(batch.column(x).to_pylist() for x in ("c", "r", "t")), strict=True):
                if turns and (c != conv or parted and len(turns) == max_turns):
                    out.append(segment(conv, number, turns))
                    size, number, turns = size + len(out[-1][3]), number + 1 if c == conv else 0, []
                elif c != conv:
                    number = 0
                conv = c
                turns.append((r, t))
                if size > 4 << 20:
                    yield _batch(out)
                    out, size = [], 0
        if turns:
            out.append(segment(conv, number, turns))
        if out:
            yield _batch(out)

    return dealt.select("c", "r", "t").mapInArrow(run, FORMATTED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ints = pa.list_(pa.int32())
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), ints, ints, ints, ints, pa.int32()]
    names = [x.split()[0] for x in FORMATTED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, rewritten_at int"


def read_back(formatted: DataFrame, template=None) -> DataFrame:
    """A row for each conversation, DIGESTS, from the formatted texts and their loss spans alone.

    Reads ``format_conversations``'s rows in the order in which that makes them, so there is no shuffle in between."""
    made = template or MarkedTurns()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out = None, []

        def close() -> None:
            conv, n, all_, chars, loss, total, bad = state
            out.append((conv, n, all_.hexdigest(), chars, loss.hexdigest(), total, bad))

        for batch in batches:
            names = ("conv_id", "segment", "formatted", "loss_starts", "loss_ends", "rewritten_at")
            for conv, number, text, starts, ends, bad in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
                if number == 0:
                    if state:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, None]
                turns = made.parse(text)
                state[1] += len(turns)
                state[2].update("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                learnt = [unescape(text[a:b]) for a, b in zip(starts, ends, strict=True)]
                state[3] += sum(map(len, learnt))
                state[4].update("".join(learnt).encode())
                state[5] += len(text)
                state[6] = bad if state[6] is None else state[6]
            if len(out) > 10_000:
                yield _digests(out)
                out.clear()
        if state:
            close()
        if out:
            yield _digests(out)

    return formatted.mapInArrow(run, DIGESTS)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32()]
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
