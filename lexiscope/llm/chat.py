"""Chat formatting with a grammar round trip.

Grammar of the rendered text of one turn (a conversation is its turns one
after the other, nothing between)::

    turn  = "[TURN]" role "[SAYS]" text "[DONE]"
    role, text = any text without a mark

A mark inside a role or text would change what the deterministic parser reads,
so conflicting content is escaped: a level of escaping puts the escape
character ``\\`` before every mark of the template and of common chat formats
and doubles escape characters that stand before one.  Rendering starts with
no escape, parses what it has rendered, compares role and text with the
source, and escapes until they are identical; the level is part of the
opening mark, so reading back needs nothing else.

Every turn is rendered and read back by itself, in any order and any task.
Only the chained digests of a conversation need its turns in order: rows are
dealt and sorted by ``(conv_id, turn)`` and streamed, so a task holds one turn
at a time however long the conversation.

Defined results: a null text or role is empty; a null conv_id is a
conversation of its own; rows of the same turn follow one another by role and
rendered form (escaped turns first), repeated rows stay; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.llm.common import small_batches, table

OPEN, SAYS, DONE, ESCAPE = "[TURN{}]", "[SAYS]", "[DONE]", "\\"
#: fixed values: control strings of common chat formats, never left bare in a rendered turn
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
           "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>"]
_MARKS = r"\[TURN[0-9]*\]|\[SAYS\]|\[DONE\]|" + "|".join(re.escape(c) for c in CONTROL)
_MARK = re.compile(_MARKS)
_PARSE = re.compile(r"(?<!\\)(?:\\\\)*(\[TURN[0-9]*\]|\[SAYS\]|\[DONE\])")


def _escapes(text: str, change: Callable[[int], int]) -> str:
    """``text`` with ``change(n)`` escapes before each mark that has n before it (marks first, so in linear time)."""
    out, at = [], 0
    for m in _MARK.finditer(text):
        before = text[at:m.start()]
        bare = before.rstrip(ESCAPE)
        out += [bare, ESCAPE * change(len(before) - len(bare)), m[0]]
        at = m.end()
    return "".join([*out, text[at:]])


def escape(text: str) -> str:
    """Doubles the escapes before each mark and adds one: no mark is left bare."""
    return _escapes(text, lambda n: 2 * n + 1)


def unescape(text: str) -> str:
    return _escapes(text, lambda n: n // 2)


def render(role: str, text: str, level: int) -> str:
    """One turn; at level 1 role and text are escaped and closed against a trailing escape."""
    if level:
        role, text = escape(role + "|"), escape(text + "|")
    return OPEN.format(level or "") + role + SAYS + text + DONE


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, stop) of every turn; start and stop bound the text as rendered.

    Raises ValueError where the grammar is not followed.
    """
    turns, at = [], 0
    while at < len(rendered):
        opened = re.compile(r"\[TURN([0-9]*)\]").match(rendered, at)
        if not opened:
            raise ValueError(f"a turn is expected at {at}")
        says = _PARSE.search(rendered, opened.end())
        done = _PARSE.search(rendered, says.end()) if says else None
        if not done or says[1] != SAYS or done[1] != DONE:
            raise ValueError(f"the turn at {at} is not closed")
        role, text = rendered[opened.end():says.start(1)], rendered[says.end():done.start(1)]
        if not opened[1] and (_MARK.search(role) or _MARK.search(text)):
            raise ValueError(f"the turn at {at} has bare control strings")
        if opened[1]:
            role, text = unescape(role)[:-1], unescape(text)[:-1]
        turns.append((role, text, says.end(), done.start(1)))
        at = done.end()
    return turns


def round_trip(role: str, text: str) -> str:
    """The rendered turn that reads back as exactly ``role`` and ``text``."""
    for level in range(2):  # the parser decides whether it must be escaped
        out = render(role, text, level)
        try:
            if [t[:2] for t in parse(out)] == [(role, text)]:
                return out
        except ValueError:
            pass
    raise AssertionError("escaping must make every turn read back")


FORMATTED = "struct<rendered:string,role:string,loss_start:long,loss_stop:long>"
_FORMATTED = pa.struct([("rendered", pa.string()), ("role", pa.string()), ("loss_start", pa.int64()),
                        ("loss_stop", pa.int64())])


def formatted_turn(role: Column, text: Column, loss_role: str = "assistant") -> Column:
    """Struct: the rendered turn and the span (code points) of its text under the loss mask, or nulls."""
    def run(roles: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for r, t in zip(roles.to_pylist(), texts.to_pylist()):
            rendered = round_trip(r or "", t or "")
            _, _, start, stop = parse(rendered)[0]
            masked = (r or "") == loss_role
            out.append({"rendered": rendered, "role": r or "", "loss_start": start if masked else None,
                        "loss_stop": stop if masked else None})
        return pa.array(out, _FORMATTED)

    run.__annotations__ = {"roles": pa.Array, "texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, FORMATTED)(role.cast("string"), text.cast("string"))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """``(conv_id, turn, role, rendered, loss_start, loss_stop)``: the rendered turn of every row.

    A conversation's training text is its rows' ``rendered`` in the order of ``(turn, role, rendered)``.
    """
    out = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                       formatted_turn(F.col(role_col), F.col(text_col)).alias("f"))
    return out.select("conv_id", "turn", "f.role", "f.rendered", "f.loss_start", "f.loss_stop")


READ_BACK = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
             "formatted_chars long")


def read_back(formatted: DataFrame, partitions: int | None = None) -> DataFrame:
    """Per conversation what the parser reads from its rendered turns (digests and counts)."""
    ordered = formatted.select("conv_id", "turn", "role", "rendered", "loss_start", "loss_stop")
    ordered = (ordered.repartition(partitions, "conv_id") if partitions else ordered.repartition("conv_id"))
    ordered = ordered.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "rendered")

    def run(batches):
        now, started, rows = None, False, []

        def close():
            rows.append((now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

        def flush():
            columns = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()),
                 pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.string()), pa.array(columns[5], pa.int64())],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            conv, rendered, start, stop = (batch.column(c).to_pylist()
                                           for c in ("conv_id", "rendered", "loss_start", "loss_stop"))
            for c, out, a, z in zip(conv, rendered, start, stop):
                if not started or c != now:
                    if started:
                        close()
                    now, started = c, True
                    n, chars, loss_chars, turns, loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, text, s, e in parse(out):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
                    if a is not None and a <= s and e <= z:
                        loss_chars += len(text)
                        loss.update(text.encode())
                chars += len(out)
            if len(rows) >= 10_000:
                yield flush()
        if started:
            close()
        if rows:
            yield flush()

    return ordered.mapInArrow(run, READ_BACK)


@small_batches
def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")],
                                  "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(given.unionByName(added)))
