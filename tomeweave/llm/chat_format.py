"""Chat formatting with any template as a black box.

A template is a function from a list of ``(role, text)`` to one string.  Each turn's span is found
by rendering successive prefixes and comparing neighbouring outputs: the new output must start
with the former, and the rest is the turn.  Where its text stands is found by rendering the same
prefix with a mark in place of the text.  A template whose new output does not start with the
former rewrites history: its conversations are flagged, and no loss mask is given for them.

Conversations are cut into blocks of ``BLOCK`` turns, so a long conversation is spread over tasks.
Each block is rendered behind all turns before it.  Only for a template that is declared stateless
(a turn's text never depends on the others) a block stands behind the ``CONTEXT`` turns before it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomeweave.llm._store import Scratch
from tomeweave.operators.skew import numbered

BLOCK, CONTEXT = 64, 2
Template = Callable[[list[tuple[str, str]]], str]

_ESCAPED_TEXT = re.compile(r"\\|###|</turn>")
_ESCAPED_ROLE = re.compile(r"\\|###|</turn>|:|\n")
_PLAIN = re.compile(r"\\(\\|###|</turn>|:|\n)")
_TURN = re.compile(r"### ((?:[^\\:\n]++|\\(?:\\|###|</turn>|:|\n))*+): ((?:[^\\<]++|\\(?:\\|###|</turn>)|<(?!/turn>))*+)</turn>\n")


def marked_turns(turns: list[tuple[str, str]]) -> str:
    """The default template: ``### role: text</turn>`` a line; control strings inside are escaped by a backslash."""
    return "".join(f"### {_ESCAPED_ROLE.sub(lambda m: chr(92) + m[0], role)}: {_ESCAPED_TEXT.sub(lambda m: chr(92) + m[0], text)}</turn>\n"
                   for role, text in turns)


marked_turns.stateless = True


def plain(value: str) -> str:
    """Undo the escapes of ``marked_turns``."""
    return _PLAIN.sub(lambda m: m[1], value)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a text that ``marked_turns`` made."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at character {at}")
        turns.append((plain(found[1]), plain(found[2])))
        at = found.end()
    return turns


def _unused(texts: list[str]) -> str:
    """A short mark that no text holds."""
    used = set("".join(texts))
    return next(chr(c) for c in range(0xE000, 0x110000) if chr(c) not in used)


def locate_turns(template: Template, turns: list[tuple[str, str]], known: int = 0) -> tuple[str, list[tuple[int, int, int, int]] | None]:
    """The text of the turns after the first ``known``, and (start, text start, text end, end) of each in it.

    The spans are None if the template rewrites history or a turn's text cannot be told apart.
    """
    before = template(turns[:known]) if known else ""
    base, spans = len(before), []
    mark = _unused([t for turn in turns for t in turn])
    for i in range(known, len(turns)):
        after = template(turns[:i + 1])
        probe = template([*turns[:i], (turns[i][0], mark)])
        if not (after.startswith(before) and probe.startswith(before)) or probe.count(mark, len(before)) != 1:
            return template(turns)[base:], None
        place = probe.index(mark, len(before))
        tail = len(probe) - place - 1
        if len(after) - tail < place or not (after.startswith(probe[:place]) and after.endswith(probe[place + 1:])):
            return template(turns)[base:], None
        spans.append((len(before) - base, place - base, len(after) - tail - base, len(after) - base))
        before = after
    return before[base:], spans


SPAN = "array<struct<role: string, start: bigint, text_start: bigint, text_end: bigint, end: bigint>>"


def _render(template: Template, loss_roles: tuple[str, ...]):
    span = pa.list_(pa.struct([("role", pa.string()), *[(c, pa.int64()) for c in ("start", "text_start", "text_end", "end")]]))
    mask = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def body(table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        turns = list(zip(table.column("role").to_pylist(), table.column("text").to_pylist()))
        known = sum(table.column("context").to_pylist())
        text, spans = locate_turns(template, turns, known)
        named = [] if spans is None else [
            {"role": role, "start": a, "text_start": b, "text_end": c, "end": d} for (role, _), (a, b, c, d) in zip(turns[known:], spans)]
        loss = [{"start": s["text_start"], "end": s["text_end"]} for s in named if s["role"] in loss_roles]
        return pa.table({"conversation": table.column("conversation").slice(0, 1), "block": table.column("block").slice(0, 1), "formatted": [text],
                         "turns": pa.array([named], span), "loss": pa.array([loss], mask), "rewrites": pa.array([spans is None])})
    return body


def _render_whole(template: Template):
    """The whole text of a conversation whose history the template rewrites, as one block without spans."""
    def body(table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        text = template(list(zip(table.column("role").to_pylist(), table.column("text").to_pylist())))
        return pa.table({"conversation": table.column("conversation").slice(0, 1), "block": pa.array([0], pa.int64()), "formatted": [text]})
    return body


def format_conversations(conversations: DataFrame, template: Template = marked_turns, loss_roles: tuple[str, ...] = ("assistant",),
                         conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                         stateless: bool | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Formatted blocks of conversations: ``conv_id``, ``block``, ``formatted``, ``turns``, ``loss`` and ``rewrites``.

    ``stateless`` says that a turn's text never depends on the others; a template may declare it by
    an attribute of that name.  A conversation is flagged as a whole if any block rewrites history;
    it is then one block, without places and loss ranges.

    The blocks of a conversation, in order, make its formatted text.  ``turns`` has the places of
    each turn and its text in the block, ``loss`` the ranges to be learnt, in code points.

    * Null and empty texts and roles are empty; such a turn is still a turn.
    * A null turn number comes first; turns of one number go by role and text, and repeated rows
      are turns of their own.
    * A null conversation id is a conversation of its own.
    * Other columns are left out, so their names cannot clash.
    * An empty table gives an empty table.
    """
    kind = conversations.schema[conv_id].dataType.simpleString()
    rows = conversations.select(F.col(conv_id).alias("conversation"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                                F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = numbered(rows, ["conversation"], F.col("turn") / BLOCK, ["turn", "role", "text"], "n", start=0)
    block = F.floor(F.col("n") / BLOCK).cast("bigint")
    late = F.col("n") % BLOCK >= BLOCK - CONTEXT
    if stateless is None:
        stateless = getattr(template, "stateless", False)
    # a block that would hold context alone does not exist
    last = placed.groupBy("conversation").agg(F.floor(F.max("n") / BLOCK).cast("bigint").alias("last"))
    known = placed.join(last.withColumnRenamed("conversation", "c"), F.col("conversation").eqNullSafe(F.col("c"))).drop("c")
    blocks = F.when(late & (block < F.col("last")), F.array(block, block + 1)).otherwise(F.array(block)) if stateless else F.sequence(block, F.col("last"))
    spread = known.withColumn("to", F.explode(blocks))
    spread = spread.select("conversation", F.col("to").alias("block"), "n", "role", "text", (F.col("to") != block).alias("context"))
    out = spread.groupBy("conversation", "block").applyInArrow(
        _render(template, tuple(loss_roles)), f"conversation {kind}, block bigint, formatted string, turns {SPAN}, "
                                              "loss array<struct<start: bigint, end: bigint>>, rewrites boolean")
    scratch = scratch or Scratch(conversations.sparkSession, "chat-format")
    out = scratch.table(out, "blocks")
    flagged = scratch.table(out.where("rewrites").select(F.col("conversation").alias("c")).distinct(), "flagged")
    if not flagged.isEmpty():
        same = F.col("conversation").eqNullSafe(F.col("c"))
        whole = placed.join(flagged, same, "left_semi").groupBy("conversation").applyInArrow(
            _render_whole(template), f"conversation {kind}, block bigint, formatted string")
        none = {c: F.array().cast(out.schema[c].dataType) for c in ("turns", "loss")}
        out = out.join(flagged, same, "left_anti").unionByName(whole.withColumns({**none, "rewrites": F.lit(True)}))
    return out.withColumnRenamed("conversation", conv_id)


def _read_back(batches):
    for batch in batches:
        turns, loss, chars = [], [], []
        for formatted, mask in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()):
            turns.append([f"{role}\n{text}\n" for role, text in read_turns(formatted)])
            loss.append("".join(plain(formatted[m["start"]:m["end"]]) for m in mask))
            chars.append(len(formatted))
        yield pa.record_batch([batch.column("conversation"), batch.column("block"), pa.array([len(t) for t in turns], pa.int64()),
                               pa.array(["".join(t) for t in turns], pa.string()), pa.array(loss, pa.string()), pa.array(chars, pa.int64())],
                              ["conversation", "block", "n_turns", "turns", "loss", "chars"])


def digests(formatted: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """What the default template's output says when read back, per conversation."""
    kind = formatted.schema[conv_id].dataType.simpleString()
    read = formatted.select(F.col(conv_id).alias("conversation"), "block", "formatted", "loss").mapInArrow(
        _read_back, f"conversation {kind}, block bigint, n_turns bigint, turns string, loss string, chars bigint")

    def whole(name: str):
        parts = F.array_sort(F.collect_list(F.struct("block", name)))
        return F.array_join(F.transform(parts, lambda p: p[name]), "")

    joined = read.groupBy("conversation").agg(F.sum("n_turns").alias("n_turns"), whole("turns").alias("t"), whole("loss").alias("l"),
                                              F.sum("chars").alias("formatted_chars"))
    return joined.select(F.col("conversation").alias(conv_id), "n_turns", F.sha2(F.col("t").cast("binary"), 256).alias("turns_sha256"),
                         F.length("l").cast("bigint").alias("loss_chars"), F.sha2(F.col("l").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
