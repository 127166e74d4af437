"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own.

A conversation is rendered turn by turn. The example of a reply is all that was rendered before it, as context, and the reply,
of which only the text is trainable. ``expand_turns`` makes the whole strings, one after the other, from the rendered turns of a
conversation: that is what ``expand`` writes and what ``digest`` reads back. Only the rendered turns are shuffled, and no more
than a conversation and one example of it are held, though all examples of a very long conversation have the size of its square.
``examples`` gives them as spans of the rendered turns, whose size is that of the turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mailquill.session import materialize

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that mean something to this template or to a tokenizer behind it.
CONTROL = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
REPLY = "assistant"
#: What is added up along a conversation.
SUMS = ("turns", "chars", "replies")
_TAILS = "|".join(re.escape(word[1:]) for word in CONTROL)
#: A control string, or one that was escaped any number of times: its first character, backslashes and the rest.
_MARKED = rf"([<\[])(\\*)({_TAILS})"
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_TAILS})")
_TURN = re.compile(rf"{re.escape(START)}([^\n]*)\n(.*?){re.escape(END)}\n", re.DOTALL)


def escape(text: Column) -> Column:
    """One backslash more behind the first character of everything that is, or was, a control string."""
    return F.regexp_replace(text, _MARKED, r"$1\\$2$3")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _plain_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda found: "\n" if found[1] == "n" else found[1], unescape(role))


def read_turns(rendered: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a rendered text."""
    return [(_plain_role(role), unescape(text)) for role, text in _TURN.findall(rendered)]


def render_turns(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``turns``: ``conv_id``, ``turn_no`` from 1, the rendered ``text``, and where it ``start``s.

    Offsets are characters from the beginning of the conversation. For a reply, ``example`` is its number from 1,
    and ``target_start`` and ``target_end`` bound its text; both are NULL elsewhere, where ``example`` counts the replies
    so far.

    Turns go by their number (NULL last), then role and text; repeated rows are turns of their own. A NULL role or text is
    empty, a NULL id is one conversation more. Other columns are ignored, and an empty table gives no rows.

    Rows are range-partitioned by id and turn, so a conversation with very many turns lies in many tasks. Each task adds
    up along its own rows; only the conversation with which a partition begins needs what the partitions before hold of it.
    """
    role, text = (F.coalesce(F.col(column).cast("string"), F.lit("")) for column in (role_col, text_col))
    own = turns.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("said"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_last(), F.col("role"), F.col("said"), F.col("row")]
    head = F.concat(F.lit(START), _role(F.col("role")), F.lit("\n"))
    body = escape(F.col("said"))
    rendered = own.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", F.spark_partition_id().cast("bigint").alias("part"), F.concat(head, body, F.lit(END + "\n")).alias("text"),
        F.when(F.col("role") == REPLY, F.length(head)).cast("bigint").alias("head"), F.length(body).cast("bigint").alias("body"),
    )
    sums = [T.StructField(name, T.LongType()) for name in SUMS]
    schema = T.StructType([*rendered.schema.fields, *sums])
    # Written once, since the sums and the rows must come from the same ranges, also when an executor is lost.
    arrow = to_arrow_schema(schema)
    placed = materialize(rendered.mapInArrow(lambda batches: _running(batches, arrow), schema), "rendered-turns")

    parts = placed.groupBy("conv_id", "part").agg(*[F.max(name).alias(name) for name in SUMS])
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(
        F.col("conv_id").alias("own_id"), F.col("part").alias("own_part"), *[F.sum(name).over(earlier).alias(f"{name}_before") for name in SUMS]
    ).where("turns_before IS NOT NULL")
    same = F.col("conv_id").eqNullSafe(F.col("own_id")) & (F.col("part") == F.col("own_part"))
    # One row for each range partition at most: the bound that makes this broadcast safe.
    counted = placed.join(F.broadcast(before), same, "left")
    turn_no, end, replies = (F.coalesce(f"{name}_before", F.lit(0)) + F.col(name) for name in SUMS)
    start = end - F.length("text")
    return counted.select(
        "conv_id", turn_no.alias("turn_no"), "text", start.alias("start"), replies.alias("example"),
        (start + F.col("head")).alias("target_start"),
        F.when(F.col("head").isNotNull(), start + F.col("head") + F.col("body")).alias("target_end"),
    )


def _running(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Adds up turns, characters and replies along the conversations of sorted rows."""
    last, totals = None, (0, 0, 0)
    for batch in batches:
        ids, sizes, heads = batch.column(0).to_pylist(), pc.utf8_length(batch.column(2)).to_pylist(), batch.column(3).to_pylist()
        sums = []
        for own_id, size, head in zip(ids, sizes, heads):
            turns, chars, replies = totals if last == (own_id,) else (0, 0, 0)
            last, totals = (own_id,), (turns + 1, chars + size, replies + (head is not None))
            sums.append(totals)
        if sums:
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(column, pa.int64()) for column in zip(*sums))], schema=schema)


def examples(rendered: DataFrame) -> DataFrame:
    """One row per assistant turn of ``render_turns``: the context is the conversation up to ``context_end``.

    ``conv_id``, ``example``, ``context_turns``, ``context_end`` (the mark of the reply's role included), ``target_start`` and
    ``target_end`` (the trainable characters) and ``end`` of the whole example, all in characters of the conversation.
    """
    return rendered.where("target_start IS NOT NULL").select(
        "conv_id", "example", (F.col("turn_no") - 1).alias("context_turns"), F.col("target_start").alias("context_end"),
        "target_start", "target_end", (F.col("start") + F.length("text")).alias("end"),
    )


def expand_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Sorted rows of ``_by_conversation`` -> ``conv_id, example, text, target_start, target_end``, one for each reply.

    The text is the whole context with the reply. A conversation that does not end in a reply is given once more at its end, with
    NULLs for the example and its target.
    """
    last, whole, ended = None, "", True
    for batch in batches:
        for own_id, text, example, target_start, target_end in zip(*[batch.column(k).to_pylist() for k in range(batch.num_columns)]):
            if last != (own_id,):
                if not ended:
                    yield *last, None, whole, None, None
                last, whole = (own_id,), ""
            whole += text
            ended = target_start is not None
            if ended:
                yield own_id, example, whole, target_start, target_end
    if not ended:
        yield *last, None, whole, None, None


#: So many characters of whole strings are handed on at once, or a single longer one.
BATCH_CHARS = 4_000_000


def _batches(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Rows in batches of ``BATCH_CHARS`` by their ``size``."""
    done, held = [], 0
    for row in rows:
        done.append(row)
        held += size(row)
        if held >= BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*done), schema)], schema=schema)
            done, held = [], 0
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*done), schema)], schema=schema)


def _by_conversation(rendered: DataFrame) -> DataFrame:
    ordered = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no")
    return ordered.select("conv_id", "text", "example", "target_start", "target_end")


def expand(rendered: DataFrame, tails: bool = False) -> DataFrame:
    """One row per assistant turn with its whole string: ``conv_id``, ``example``, ``text``, ``target_start``, ``target_end``.

    The result has by its nature the size of all contexts. With ``tails`` a conversation with turns after its last reply, or without
    any, is one row more, whose ``example`` and target are NULL.
    """
    result = T.StructType([rendered.schema["conv_id"], *T.StructType.fromDDL("example bigint, text string, target_start bigint, target_end bigint")])
    arrow = to_arrow_schema(result)

    def expanded(batches):
        rows = (row for row in expand_turns(batches) if tails or row[1] is not None)
        return _batches(rows, arrow, lambda row: len(row[2]))

    return _by_conversation(rendered).mapInArrow(expanded, result)


def _read_back(examples: Iterator[tuple]) -> Iterator[tuple]:
    """The examples of ``expand_turns`` -> one row for each conversation. Only one example and the running hash are held.

    The last example of a conversation, or what is given of it after that, holds all its turns.
    """
    last, whole, chars, loss_chars, loss = None, "", 0, 0, hashlib.sha256()

    def row():
        turns, said = 0, hashlib.sha256()
        for found in _TURN.finditer(whole):
            turns += 1
            said.update(f"{_plain_role(found[1])}\n{unescape(found[2])}\n".encode("utf-8", "surrogatepass"))
        return *last, turns, said.hexdigest(), loss_chars, loss.hexdigest(), chars

    for own_id, _, text, target_start, target_end in examples:
        if last != (own_id,):
            if last is not None:
                yield row()
            last, chars, loss_chars, loss = (own_id,), 0, 0, hashlib.sha256()
        whole = text
        chars += len(text)
        if target_start is not None:
            reply = unescape(text[target_start:target_end])
            loss.update(reply.encode("utf-8", "surrogatepass"))
            loss_chars += len(reply)
    if last is not None:
        yield row()


def digest(rendered: DataFrame) -> DataFrame:
    """One row per conversation, read back from the expanded examples, which are made whole, one by one, where they are read.

    ``n_turns``, ``turns_sha256`` of role, newline, text, newline of each turn, ``loss_chars`` and ``loss_sha256`` of the text
    under the loss mask, and ``formatted_chars`` of all examples, and of the whole once more if it does not end in a reply.
    A SHA-256 goes over its text from the beginning to the end, so a conversation is read by one task, example by example.
    """
    result = T.StructType([rendered.schema["conv_id"], *T.StructType.fromDDL(
        "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")])
    arrow = to_arrow_schema(result)
    return _by_conversation(rendered).mapInArrow(lambda batches: _batches(_read_back(expand_turns(batches)), arrow, lambda row: 200), result)
