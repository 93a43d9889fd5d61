"""Conversations as training windows of at most a budget of tokens: prefix sums of turn tokens choose spans of whole turns.

Turns are sorted over the cluster by conversation and turn, and counted in the tokenizer's ids as they are formatted.  Prefix sums
run within the sorted partitions; the few conversations that cross into a next partition get what came before added, one
row for each partition at most.  Prefix sums deal the turns into segments of SEGMENT budgets; a segment is cut into windows in
one task, whatever the length of its conversation.

A window is the conversation's first turn if that is its system turn, then the last turns before the span (at most
`history_turns`, of at most `history` tokens together, fewer where the span's first turn needs the room), then the span: as many
turns as fit.  A turn that doesn't fit by itself is a span of its own, marked `over`.  Each turn is in the span of one window;
where it is repeated, as system turn or history, the loss mask leaves it out.  The mask covers the texts of the assistant's turns.

The template puts `<|im_start|>role\\ntext<|im_end|>\\n` for each turn.  In roles and texts one more `\\` is set into every
`<`, `\\`..., `|`, so no control string occurs there; taking one out again gives the text back.  In roles `%` and line ends
become `%25` and `%0A`.

Defined cases: null and empty texts and roles count as empty; a null conversation is one of its own; turns with the same (or
no) number go by role, then text; repeated rows are turns each; very long turns are kept whole; other columns are ignored; an
empty table gives no windows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.llm.common import small, written
from lodegraph.llm.tokens import encoder

START, END = "<|im_start|>", "<|im_end|>\n"

#: Budgets of tokens in a segment.
SEGMENT = 16

_COUNTED = "part int, conv_id long, role string, body string, head int, tokens long, near_start long, near_pos long"
WINDOWS = (
    "conv_id long, segment long, window int, first long, repeated int, turns int, tokens long, over boolean, text string, "
    "mask array<struct<start:int,stop:int>>"
)


def escape(text):
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text):
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role):
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role):
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _measured(path: str):
    """Tokens of each turn, and sums and positions within a sorted partition."""

    def run(batches):
        coder, last, start, pos = encoder(path), object(), 0, 0
        for batch in small(batches):
            tokens, starts, places = [], [], []
            for conv, body in zip(batch.column("conv_id").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if conv != last:
                    last, start, pos = conv, 0, 0
                n = len(coder.ids(body)) // 4
                tokens.append(n)
                starts.append(start)
                places.append(pos)
                start, pos = start + n, pos + 1
            more = [pa.array(x, pa.int64()) for x in (tokens, starts, places)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "tokens", "near_start", "near_pos"])

    return run


def placed_turns(spark: SparkSession, convs: DataFrame, path: str) -> DataFrame:
    """(conv_id, role, body, head, tokens, start, pos): formatted turns with the tokens and turns of the conversation before them."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = convs.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id", "turn", "role", F.substring("text", 1, 32))
    dealt = dealt.sortWithinPartitions("conv_id", "turn", "role", "text")
    opened = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    turns = dealt.select(
        F.spark_partition_id().alias("part"), "conv_id", "role", F.concat(opened, escape(F.col("text")), F.lit(END)).alias("body"), F.length(opened).cast("int").alias("head")
    )
    turns = written(turns.mapInArrow(_measured(path), _COUNTED), "chat-turns")
    sums = turns.groupBy("part", "conv_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("part").alias("at"), F.col("conv_id").alias("of"), F.sum("t").over(before).alias("t"), F.sum("c").over(before).alias("c"))
    # Only the first conversation of a partition can have begun before it.
    met = turns.join(F.broadcast(sums.filter("c > 0")), (F.col("part") == F.col("at")) & F.col("conv_id").eqNullSafe(F.col("of")), "left")
    start, pos = (F.col(x) + F.coalesce(y, F.lit(0)) for x, y in (("near_start", "t"), ("near_pos", "c")))
    return met.select("conv_id", "role", "body", "head", "tokens", start.alias("start"), pos.alias("pos"))


def _cut(budget: int, history: int, history_turns: int):
    """The windows of one segment: its own turns, history from the segment before, and the system turn."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["pos"])
        conv, segment = rows[0]["conv_id"], rows[0]["segment"]
        system = [r for r in rows if r["pos"] == 0 and r["role"] == "system"]
        rest = [r for r in rows if r not in system] if system else rows
        at = next((i for i, r in enumerate(rest) if r["own"]), len(rest))
        fixed, out = sum(r["tokens"] for r in system), []
        opening = bool(system and system[0]["own"])
        while at < len(rest) or opening:
            back, size = at, 0
            own = rest[at]["tokens"] if at < len(rest) else 0
            while back > 0 and at - back < history_turns and size + rest[back - 1]["tokens"] <= min(history, budget - fixed - own) and rest[back - 1]["pos"] == rest[back]["pos"] - 1:
                back -= 1
                size += rest[back]["tokens"]
            size, stop = size + fixed, at
            while stop < len(rest) and (size + rest[stop]["tokens"] <= budget or stop == at and not opening):
                size += rest[stop]["tokens"]
                stop += 1
            shown = [*system, *rest[back:stop]]
            repeated = (len(system) if not opening else 0) + at - back
            mask, chars = [], 0
            for k, r in enumerate(shown):
                if k >= repeated and r["role"] == "assistant":
                    mask.append({"start": chars + r["head"], "stop": chars + len(r["body"]) - len(END)})
                chars += len(r["body"])
            out.append(
                {"conv_id": conv, "segment": segment, "window": len(out), "first": shown[repeated]["pos"], "repeated": repeated, "turns": len(shown), "tokens": size, "over": size > budget, "text": "".join(r["body"] for r in shown), "mask": mask}
            )
            at, opening = stop, False
        return pa.Table.from_pylist(out, _ARROW)

    return run


_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("segment", pa.int64()), ("window", pa.int32()), ("first", pa.int64()), ("repeated", pa.int32()), ("turns", pa.int32()), ("tokens", pa.int64()), ("over", pa.bool_()), ("text", pa.string()), ("mask", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))]
)


def windows(spark: SparkSession, convs: DataFrame, path: str, budget: int = 2048, history: int = 256, history_turns: int = 4) -> DataFrame:
    """WINDOWS: the formatted windows, and as `mask` the places (code points) of the texts to learn."""
    span = SEGMENT * budget
    turns = placed_turns(spark, convs, path).withColumn("own_segment", F.floor(F.col("start") / span))
    is_system = (F.col("pos") == 0) & (F.col("role") == "system")
    next_ = F.col("own_segment") + 1
    repeats = ~is_system & (F.col("tokens") <= history) & (F.col("start") + F.col("tokens") > next_ * span - history)
    here = F.when(repeats, F.array("own_segment", next_)).otherwise(F.array("own_segment"))
    last = turns.groupBy(F.col("conv_id").alias("of")).agg(F.max("own_segment").alias("last"))
    heads = turns.filter(is_system).join(last, F.col("conv_id").eqNullSafe(F.col("of"))).withColumn("segment", F.explode(F.sequence("own_segment", "last")))
    keep = ["conv_id", "segment", "own_segment", "role", "body", "head", "tokens", "pos"]
    rows = turns.filter(~is_system).withColumn("segment", F.explode(here)).select(keep).union(heads.select(keep))
    rows = rows.withColumn("own", F.col("segment") == F.col("own_segment")).drop("own_segment")
    return rows.groupBy("conv_id", "segment").applyInArrow(_cut(budget, history, history_turns), WINDOWS)


def read_back(made: DataFrame) -> DataFrame:
    """(conv_id, segment, window, turns, said, learned, chars): of each window the new turns, as role, line end, text, line end each,
    and what the mask covers, unescaped; from its text, its mask and the count of repeated turns alone."""
    bodies = F.split("text", r"<\|im_end\|>\n", -1)
    fresh = F.slice(bodies, F.col("repeated") + 1, F.size(bodies) - F.col("repeated") - 1)

    def said(body):
        line = F.instr(body, "\n")
        return F.concat(unescape_role(F.substring(body, F.lit(len(START) + 1), line - len(START) - 1)), F.lit("\n"), unescape(F.substring(body, line + 1, F.length(body))), F.lit("\n"))

    learned = F.transform("mask", lambda m: unescape(F.substring("text", m["start"] + 1, m["stop"] - m["start"])))
    return made.select("conv_id", "segment", "window", F.size(fresh).alias("turns"), F.array_join(F.transform(fresh, said), "").alias("said"), F.array_join(learned, "").alias("learned"), F.length("text").alias("chars"))


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def _digests(batches):
    """Of sorted windows a row for each conversation; a text is hashed as it comes, so none is held whole."""
    last, state, out = object(), None, []

    def row():
        return (last, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5])

    def batch_of(rows):
        names = [c.split()[0] for c in _DIGESTS.split(", ")]
        kinds = [pa.string() if "sha256" in c else pa.int64() for c in names]
        return pa.record_batch([pa.array(v, k) for v, k in zip(list(zip(*rows)) or [[]] * len(names), kinds, strict=True)], names)

    for batch in small(batches):
        for r in batch.to_pylist():
            if r["conv_id"] != last:
                if state:
                    out.append(row())
                last, state = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            state[1].update(r["said"].encode())
            state[3].update(r["learned"].encode())
            for i, n in ((0, r["turns"]), (2, len(r["learned"])), (4, r["chars"]), (5, 1)):
                state[i] += n
        yield batch_of(out)
        out = []
    if state:
        yield batch_of([row()])


def digests(spark: SparkSession, made: DataFrame) -> DataFrame:
    """_DIGESTS of the conversations in a written table of windows.  A digest of a whole conversation takes its turns in order, so
    the windows of one pass through one task, in a stream."""
    back = read_back(made).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id").sortWithinPartitions("conv_id", "segment", "window")
    return back.mapInArrow(_digests, _DIGESTS)


def round_trip(spark: SparkSession, convs: DataFrame, path: str, budget: int = 2048, history: int = 256, history_turns: int = 4) -> DataFrame:
    return digests(spark, written(windows(spark, convs, path, budget, history, history_turns), "chat-windows"))
