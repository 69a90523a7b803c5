"""Repair of conversations: the cheapest edits after which roles alternate and no turn is empty or told twice.

Edits: Keep (0), Rerole to user or assistant (2), Delete (3), Insert an empty turn of user or
assistant (2). Blank and repeated turns must go; a turn that breaks off costs 1 unless it goes. The
roles that stay must read ``(s?(ua)+)?`` by their initials. Among cheapest edits those count whose
initials come first in ASCII order.

Turns that must go cost the same everywhere and change no grammar state (and D comes before I), so a
conversation's **signature** is the string of its other turns: one character each for the role's
initial, a capital where the turn breaks off. What a conversation costs from a turn on, and which
edits are best there, depends on the rest of its signature only. So the distinct signatures of all
conversations are merged from their ends into an automaton that shares suffixes: a node is a
distinct suffix, and its four costs (one for each grammar state) and best moves are worked out once.
Sorted by their reversed form, signatures with common suffixes follow each other, so a task holds
the nodes of one path only. A move points to the node behind it: audit suffixes are shared too.

Nothing holds a whole conversation but its own audit: turns are sorted by (conversation, turn) into
ranges, a long conversation lies in several, and its turns are cut into blocks. What a block costs
from state to state is a small table (the same automaton with another end), tables are composed from
the last block to the first, and every block is then solved against the costs behind it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.session import cut_lineage

#: Turns of a conversation in one block.
BLOCK = 1024
#: White space between which a turn counts as blank, and ends of whole turns. Fixed values.
SPACE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")

KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 2, 3, 2, 1
NEVER = 1 << 40
#: Grammar states: nothing yet, after s, after u, after a. What may be kept, and what an edit makes.
START, SYSTEM, USER, ASSISTANT = range(4)
ALLOWED = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
MADE = [USER, USER, ASSISTANT, USER]
#: Costs at the end of a conversation, and the turns inserted there (capital: user, small: assistant).
END = (0, 2 * INSERT, INSERT, 0)
TAIL = ("", "Ii", "i", "")


class Node(NamedTuple):
    """A suffix: costs by state, best moves by state (edits and the state behind them), the rest."""

    cost: tuple[int, ...]
    move: tuple[tuple[str, int], ...]
    rest: "Node | None"


def leaf(cost: tuple[int, ...]) -> Node:
    return Node(cost, (("", -1),) * 4, None)


def extended(sign: str, rest: Node) -> Node:
    """The suffix that begins with ``sign`` and goes on with ``rest``.

    In moves R and I are of a user, r and i of an assistant: the state leaves one choice.
    """
    initial, broken = sign.lower(), BROKEN if sign.isupper() else 0
    taken = []
    for q in range(4):
        made = MADE[q]
        options = [(DELETE + rest.cost[q], "D", q), (REROLE + broken + rest.cost[made], "R" if made == USER else "r", made)]
        if initial in ALLOWED[q]:
            options.append((KEEP + broken + rest.cost[ALLOWED[q][initial]], "K", ALLOWED[q][initial]))
        taken.append(options)
    direct = [min(o[0] for o in options) for options in taken]
    # Two insertions before one turn lead back to the state after the turn before.
    cost = tuple(min(direct[q], INSERT + direct[MADE[q]]) for q in (USER, ASSISTANT))
    cost = tuple(min(direct[q], INSERT + cost[0]) for q in (START, SYSTEM)) + cost
    return Node(cost, tuple(_best(q, cost, taken) for q in range(4)), rest)


def _best(q: int, cost: tuple[int, ...], taken: list[list[tuple[int, str, int]]]) -> tuple[str, int]:
    """Edits up to and with the next turn: at each step the first initial (D, I, K, R) that is cheapest."""
    edits = ""
    while True:
        fits = {edit: after for c, edit, after in taken[q] if c == cost[q]}
        if "D" in fits:
            return edits + "D", fits["D"]
        if INSERT + cost[MADE[q]] == cost[q]:
            edits += "I" if MADE[q] == USER else "i"
            q = MADE[q]
            continue
        edit = min(fits)  # K, R, r
        return edits + edit, fits[edit]


def walk(node: Node, q: int) -> tuple[str, int]:
    """Best edits from state ``q`` on, by turn and comma-separated, and the state at the end."""
    edits = []
    while node.rest is not None:
        edit, q = node.move[q]
        edits.append(edit)
        node = node.rest
    return ",".join(edits), q


def solve(signatures: DataFrame) -> DataFrame:
    """(signature, ending, cost, edits, state) for distinct (signature, ending).

    ``ending`` is the comma-separated costs behind the signature; the others are arrays by the state
    before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: list[Node] = []
        before, ending = "", None
        for batch in batches:
            found = []
            for end, back in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if end != ending:
                    ending, before, path = end, "", [leaf(tuple(map(int, end.split(","))))]
                shared = 0
                while shared < min(len(back), len(before)) and back[shared] == before[shared]:
                    shared += 1
                del path[shared + 1 :]
                for sign in back[shared:]:
                    path.append(extended(sign, path[-1]))
                before = back
                walks = [walk(path[-1], q) for q in range(4)]
                found.append((back[::-1], end, path[-1].cost, [w for w, _ in walks], [q for _, q in walks]))
            names = ["signature", "ending", "cost", "edits", "state"]
            kinds = [pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32())]
            columns = zip(*found) if found else [[]] * 5
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    backwards = signatures.select("ending", F.reverse("signature").alias("back")).distinct()
    return (
        backwards.repartitionByRange("ending", "back")
        .sortWithinPartitions("ending", "back")
        .mapInArrow(run, "signature string, ending string, cost array<long>, edits array<string>, state array<int>")
    )


def judged(turns: DataFrame) -> DataFrame:
    """Equal turns of a conversation as one row: (conv, turn, role, text, copies, sign, blank).

    ``sign`` is the character in the signature, null where every copy must go. Repeats of a turn
    are found by a digest of role and text.
    """
    once = turns.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    trimmed = F.rtrim("text", F.lit(SPACE))
    once = once.withColumn("blank", trimmed == "").withColumn("broken", ~F.right(trimmed, F.lit(1)).isin(*ENDS))
    told = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    once = once.withColumn("told", F.unhex(F.sha2(told, 256))).withColumn("at", F.struct(F.col("turn").isNotNull(), "turn"))
    again = (
        once.where(~F.col("blank"))
        .groupBy(F.col("conv").alias("conv_"), F.col("told").alias("told_"))
        .agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("times"))
        .where("times > 1")
    )
    initial = F.substring("role", 1, 1)
    sign = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    late = F.coalesce(F.col("at") != F.col("first"), F.lit(False))
    return (
        once.join(again, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("told") == F.col("told_")), "left")
        .withColumn("sign", F.when(~F.col("blank") & ~late, F.when(F.col("broken"), F.upper(sign)).otherwise(sign)))
        .select("conv", "turn", "role", "text", "copies", "sign", "blank")
    )


def _cut(convs: list, signs: list, part: list, last: list) -> tuple[list[int], list[int]]:
    """Block and number among the block's signed turns, row by row; ``last`` is carried on."""
    blocks, places = [], []
    conv, block, rows, signed = last
    for c, sign, p in zip(convs, signs, part):
        if block is None or c != conv or rows == BLOCK:
            conv, block, rows, signed = c, (p << 32 if block is None else block + 1), 0, 0
        blocks.append(block)
        places.append(signed)
        rows += 1
        signed += sign is not None
    last[:] = [conv, block, rows, signed]
    return blocks, places


def numbered(ordered: DataFrame) -> DataFrame:
    """Turns with their block and place in it; rows lie in ranges, in order."""
    fields = [f for f in ordered.schema.fields]
    schema = T.StructType([*fields, T.StructField("block", T.LongType()), T.StructField("place", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [None, None, 0, 0]
        for batch in batches:
            at = batch.schema.get_field_index
            given = [batch.column(at(c)).to_pylist() for c in ("conv", "sign", "part")]
            blocks, places = _cut(*given, last)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(blocks, pa.int64()), pa.array(places, pa.int64())],
                [*batch.schema.names, "block", "place"],
            )

    return ordered.mapInArrow(run, schema)


_COUNTS = ["blank", "duplicate", "truncated", "illegal", "distinct"]
_BLOCK = "signature string, dead array<long>, blank long, duplicate long, truncated long, illegal long, distinct long, initial string, initial_last string, low long, high long, turn long, turn_last long"


class Block:
    """What is kept of the turns of a block: signature, dead turns before each sign, counts, edges."""

    def __init__(self):
        self.signature, self.dead = [], [0]
        self.count = dict.fromkeys(_COUNTS, 0)
        self.initial, self.initial_last = None, None
        self.low = self.high = self.turn = self.turn_last = None

    def add(self, turn, initial, copies, sign, blank):
        if sign is None:
            self.dead[-1] += copies
        else:
            self.signature.append(sign)
            self.dead.append(copies - 1)
            self.count["truncated"] += sign.isupper()
        self.count["blank" if blank else "duplicate"] += copies - (sign is not None)
        if self.initial is None:
            self.initial, self.turn = initial, turn
        else:
            self.count["illegal"] += self.initial_last + initial not in ("su", "ua", "au")
        self.count["illegal"] += copies - 1
        if turn is not None:
            self.count["distinct"] += turn != self.turn_last
            self.low, self.high = turn if self.low is None else self.low, turn
        self.initial_last, self.turn_last = initial, turn

    def row(self) -> tuple:
        edges = (self.initial, self.initial_last, self.low, self.high, self.turn, self.turn_last)
        return "".join(self.signature), self.dead, *self.count.values(), *edges


def blocks(rows: DataFrame) -> DataFrame:
    """One row for each block of ``numbered`` turns."""
    kind = rows.schema["conv"].dataType
    schema = T.StructType([T.StructField("conv", kind), T.StructField("block", T.LongType()), *T._parse_datatype_string(_BLOCK).fields])
    plain = rows.select("conv", "block", "turn", F.substring("role", 1, 1).alias("initial"), "copies", "sign", "blank")
    arrow = pa.schema(
        [("block", pa.int64()), ("signature", pa.string()), ("dead", pa.list_(pa.int64())), *((c, pa.int64()) for c in _COUNTS)]
        + [("initial", pa.string()), ("initial_last", pa.string())]
        + [(c, pa.int64()) for c in ("low", "high", "turn", "turn_last")]
    )

    def batch_of(done: list, conv_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*done)) if done else [[]] * (len(arrow) + 1)
        arrays = [pa.array(list(c), t) for c, t in zip(columns, [conv_type, *arrow.types])]
        return pa.RecordBatch.from_arrays(arrays, ["conv", *arrow.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, number, block, conv_type = None, None, None, None
        for batch in batches:
            done, conv_type = [], batch.column(0).type
            for c, n, *turn in zip(*(x.to_pylist() for x in batch.columns)):
                if n != number:
                    if block:
                        done.append((conv, number, *block.row()))
                    conv, number, block = c, n, Block()
                block.add(*turn)
            yield batch_of(done, conv_type)
        if block:
            yield batch_of([(conv, number, *block.row())], conv_type)

    return plain.mapInArrow(run, schema)


def _text(cost) -> str:
    """An ending: costs above the least of them, so that few different ones occur."""
    least = min(cost)
    return ",".join(str(min(c - least, NEVER)) for c in cost)


def endings(cut: DataFrame) -> DataFrame:
    """(conv, block, ending): the costs behind each block of conversations that have several."""
    several = cut.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv").alias("conv_"))
    long = cut.join(several, F.col("conv").eqNullSafe(F.col("conv_")), "left_semi").select("conv", "block", "signature")
    exits = F.explode(F.array(*(F.lit(",".join("0" if r == q else str(NEVER) for q in range(4))) for r in range(4))))
    tables = solve(long.select("signature").distinct().withColumn("ending", exits))
    tables = tables.groupBy("signature").agg(F.sort_array(F.collect_list(F.struct("ending", "cost"))).alias("table"))
    # Sorted by text, the ending with 0 for the first state comes first, and so on.
    schema = T.StructType([cut.schema["conv"], T.StructField("block", T.LongType()), T.StructField("ending", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, fresh, cost = None, True, END
        for batch in batches:
            out = []
            for c, table in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if fresh or c != conv:
                    conv, fresh, cost = c, False, END
                out.append(_text(cost))
                to = [t["cost"] for t in table]
                cost = tuple(min(to[r][q] + cost[r] for r in range(4)) for q in range(4))
                cost = tuple(c - min(cost) for c in cost)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["conv", "block", "ending"])

    return (
        long.join(tables, "signature")
        .select("conv", "block", "table")
        .repartition("conv")
        .sortWithinPartitions("conv", F.desc("block"))
        .mapInArrow(run, schema)
    )


_REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def solved(cut: DataFrame) -> DataFrame:
    """(conv, block, edits) of each block, and for each conversation a row with null block and its report.

    The report's ``edits`` are the turns inserted at the end. Blocks of a conversation come in order
    through one task, which holds one of them and the audit.
    """
    behind = endings(cut).toDF("conv_", "block_", "ending")
    same = F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("block") == F.col("block_"))
    cut = cut.join(behind, same, "left").withColumn("ending", F.coalesce("ending", F.lit(_text(END)))).drop("conv_", "block_")
    joined = cut.join(solve(cut.select("signature", "ending")), ["signature", "ending"])
    conv_field = cut.schema["conv"]
    fields = [conv_field, T.StructField("block", T.LongType()), T.StructField("edits", T.StringType())]
    schema = T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in _REPORT), T.StructField("audit", T.StringType())])

    class Report:
        def __init__(self, conv):
            self.conv, self.state, self.cost, self.audit = conv, START, 0, []
            self.count = dict.fromkeys(_COUNTS, 0)
            self.low = self.high = self.before = None

        def add(self, b: dict) -> str:
            for c in _COUNTS:
                self.count[c] += b[c]
            if self.before:
                self.count["illegal"] += self.before[0] + b["initial"] not in ("su", "ua", "au")
                self.count["distinct"] -= b["turn"] is not None and b["turn"] == self.before[1]
            self.before = b["initial_last"], b["turn_last"]
            if b["low"] is not None:
                self.low, self.high = b["low"] if self.low is None else self.low, b["high"]
            edits, q = b["edits"][self.state], b["state"][self.state]
            self.cost += b["cost"][self.state] - int(b["ending"].split(",")[q])
            self.state = q
            self.audit.append("D" * b["dead"][0])
            for edit, dead in zip(edits.split(","), b["dead"][1:]):
                self.audit.append(edit.upper() + "D" * dead)
            return edits

        def row(self) -> tuple:
            n = self.count
            gaps = 0 if self.low is None else self.high - self.low + 1 - n["distinct"]
            cost = self.cost + END[self.state] + DELETE * (n["blank"] + n["duplicate"])
            tail = TAIL[self.state]
            kept = (gaps, n["blank"], n["duplicate"], n["truncated"], n["illegal"], cost)
            return (self.conv, None, tail, *kept, "".join(self.audit) + tail.upper())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report, conv_type = None, None

        def batch_of(out: list) -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * 10
            kinds = [conv_type, pa.int64(), pa.string(), *[pa.int64()] * 6, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], schema.names)

        for batch in batches:
            out, conv_type = [], batch.column(batch.schema.get_field_index("conv")).type
            for b in batch.to_pylist():
                if report is None or b["conv"] != report.conv:
                    if report:
                        out.append(report.row())
                    report = Report(b["conv"])
                out.append((b["conv"], b["block"], report.add(b), *[None] * 7))
            yield batch_of(out)
        if report:
            yield batch_of([report.row()])

    return joined.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(run, schema)


class Repair(NamedTuple):
    """``report``: one row for each conversation; ``turns``: what they consist of afterwards, in order of (conv, block, place, part)."""

    report: DataFrame
    turns: DataFrame


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """Reports and repaired turns of all conversations.

    Turns are taken in order of ``turn`` (nulls first), then role and text. A null role or text
    counts as one space; null conversations are one conversation; equal rows are repeats of one
    turn; further columns do not matter; an empty table gives empty results. Conversation ids may be
    of any type that Spark sorts. The report has gaps, blank, duplicate, truncated, illegal, cost and
    audit; ``turns`` has conv, block, place, part, role and text.
    """
    given = turns.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))),
    )
    order = ["conv", "turn", "role", "text"]
    ordered = cut_lineage(judged(given).repartitionByRange(*order).sortWithinPartitions(*order))
    rows = numbered(ordered.withColumn("part", F.spark_partition_id().cast("long")))
    found = cut_lineage(solved(blocks(rows)))
    report = found.where("block is null").select("conv", *_REPORT, "audit")

    edits = F.posexplode(F.split("edits", ",")).alias("place_", "edits")
    moves = found.where("block is not null").select(F.col("conv").alias("conv_"), F.col("block").alias("block_"), edits)
    live = rows.where("sign is not null").select("conv", "block", "place", "role", "text")
    on = F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("block") == F.col("block_")) & (F.col("place") == F.col("place_"))
    parts = live.join(moves, on).select("conv", "block", "place", "role", "text", "edits")
    last = found.where("block is null and edits <> ''").select(
        "conv", F.lit((1 << 63) - 1).alias("block"), F.lit(0).cast("long").alias("place"), F.lit("").alias("role"), F.lit("").alias("text"), "edits"
    )
    single = parts.unionByName(last).select("*", F.posexplode(F.split("edits", "")).alias("part", "edit")).where("edit not in ('D', '')")
    new_role = F.when(F.col("edit").isin("I", "R"), "user").when(F.col("edit").isin("i", "r"), "assistant").otherwise(F.col("role"))
    new_text = F.when(F.col("edit").isin("I", "i"), "").otherwise(F.col("text"))
    return Repair(report, single.select("conv", "block", "place", "part", new_role.alias("role"), new_text.alias("text")))


def digests(turns: DataFrame) -> DataFrame:
    """(conv, sha256) of each conversation's repaired ``role:text`` lines.

    A digest reads its lines one after the other, so a conversation's turns stream through one task,
    which holds the state of the digest only.
    """
    schema = T.StructType([turns.schema["conv"], T.StructField("sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, conv_type = None, None, None
        for batch in batches:
            done, conv_type = [], batch.column(0).type
            for c, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest is None or c != conv:
                    if digest:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = c, hashlib.sha256(line)
                else:
                    digest.update(b"\n" + line)
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], conv_type), pa.array([d for _, d in done], pa.string())], schema.names)
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([conv], conv_type), pa.array([digest.hexdigest()])], schema.names)

    line = F.concat("role", F.lit(":"), "text").cast("binary").alias("line")
    return (
        turns.repartition("conv")
        .sortWithinPartitions("conv", "block", "place", "part")
        .select("conv", line)
        .mapInArrow(run, schema)
    )
