"""The cheapest repair of conversations: which turns to keep, to give another role, to delete, and what to insert.

Depth-first branch and bound with an explicit stack finds the edits of a block of turns, for every state that the block
may be entered and left in; blocks are put together by the same order of (cost, audit). So a conversation of any length
is worked in pieces by many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagewatch.session import durable

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
SPACE = " \t\n\x0b\f\r"
#: Turns that one search decides at once, and rows and bytes of a piece of the sorted table.
BLOCK_TURNS = 64
PIECE_ROWS, PIECE_BYTES = 20_000, 32 << 20

#: States by the last role: none yet, system, user, assistant. Assistant and none are good ends.
NONE, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NONE, ASSISTANT)
#: Roles of turns: system, user, assistant, anything else.
ROLES = {"s": 0, "u": 1, "a": 2}
OTHER = 3


def allowed(state: int, role: int) -> int | None:
    """The state after a turn of ``role``, where one may stand."""
    if role == 0:
        return SYSTEM if state == NONE else None
    if role == 1:
        return USER if state != USER else None
    return ASSISTANT if role == 2 and state == USER else None


def suffix_bounds(turns: bytes, leave: tuple[int, ...]) -> list[tuple[int, int]]:
    """What turns i, i + 1, ... cost at least, where a user's turn is due and where an assistant's is.

    It is the cost of a looser problem: a system turn may stand anywhere, and no state but these two counts."""
    after_user, due = USER in leave, any(x != USER for x in leave)
    ends = (0 if due else INSERT, 0 if after_user else INSERT)
    bounds = [ends]
    for turn in reversed(turns):
        role, extra = divmod(turn, 2)
        extra *= TRUNCATED
        user, assistant = bounds[-1]
        for_user = min(DELETE + user, extra + (assistant if role == 1 else user if role == 0 else REROLE + assistant), extra + REROLE + assistant)
        for_assistant = min(DELETE + assistant, extra + (user if role == 2 else assistant if role == 0 else REROLE + user), extra + REROLE + user)
        bounds.append((min(for_user, INSERT + for_assistant), min(for_assistant, INSERT + for_user)))
    return bounds[::-1]


@lru_cache(100_000)
def cheapest(turns: bytes, enter: int, leave: tuple[int, ...]) -> tuple[int, str] | None:
    """The least (cost, audit) that leads over ``turns`` from a state to one of ``leave``; None if nothing does.

    A turn is twice its role, plus 1 if it is truncated. The stack holds (next turn, state, cost, audit); a node is not
    followed if its cost and the suffix bound exceed the incumbent, or equal it with a larger audit, or if another path
    has reached the same turn and state by a smaller (cost, audit). Of two paths to one node with one cost neither
    audit begins the other, so the smaller one stays smaller whatever follows.
    """
    bounds, total = suffix_bounds(turns, leave), len(turns)
    only_start = not any(x in (USER, ASSISTANT) for x in leave)
    best: tuple[int, str] | None = None
    seen: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, enter, 0, "")]
    while stack:
        place, state, cost, audit = stack.pop()
        if best is not None:
            least = cost + bounds[place][state == USER]
            if least > best[0] or least == best[0] and audit > best[1][: len(audit)]:
                continue
        known = seen.get((place, state))
        if known is not None and known <= (cost, audit):
            continue
        seen[place, state] = (cost, audit)
        if place == total and state in leave and (best is None or (cost, audit) < best):
            best = (cost, audit)
        following = []
        if place < total:
            role, extra = divmod(turns[place], 2)
            extra *= TRUNCATED
            following.append((place + 1, state, cost + DELETE, audit + "D"))
            to = allowed(state, role)
            if to is not None:
                following.append((place + 1, to, cost + KEEP + extra, audit + "K"))
            wanted = ASSISTANT if state == USER else USER
            if to != wanted:
                following.append((place + 1, wanted, cost + REROLE + extra, audit + "R"))
        following.append((place, ASSISTANT if state == USER else USER, cost + INSERT, audit + "I"))
        if only_start:
            following = [x for x in following if x[1] in (NONE, SYSTEM)]
        following.sort(key=lambda x: (x[2] + bounds[x[0]][x[1] == USER], x[3]), reverse=True)
        stack.extend(following)
    return best


def woven(audit: str, dead: list[int]) -> str:
    """The audit with the deletions of rows that must go: ``dead[k]`` stand before the k-th turn, the last ones at the end.

    Deletions sort before insertions, so what is inserted next to them comes after them."""
    if not any(dead):
        return audit
    out, start, turn = [], 0, 0
    for at, edit in enumerate(audit):
        if edit != "I":
            out.append("D" * dead[turn] + audit[start : at + 1])
            start, turn = at + 1, turn + 1
    out.append("D" * dead[turn] + audit[start:])
    return "".join(out)


#: Ways through a piece: for (state entered in, state left in) the least (cost, audit).
Ways = dict[tuple[int, int], tuple[int, str]]


def followed(ways: Ways, more: Ways) -> Ways:
    """Ways through two pieces, one after the other."""
    out: Ways = {}
    for (enter, middle), (cost, audit) in ways.items():
        for (start, leave), (further, rest) in more.items():
            if start == middle:
                key, value = (enter, leave), (cost + further, audit + rest)
                if key not in out or value < out[key]:
                    out[key] = value
    return out


def ways_through(turns: bytes, dead: list[int], enters: Iterable[int]) -> Ways:
    """Ways from each of ``enters`` through any number of turns, block by block."""
    ways: Ways = {(x, x): (0, "") for x in enters}
    for start in range(0, max(1, len(turns)), BLOCK_TURNS):
        block = turns[start : start + BLOCK_TURNS]
        gone = [*dead[start : start + len(block)], dead[-1] if start + BLOCK_TURNS >= len(turns) else 0]
        step: Ways = {}
        for enter in {middle for _, middle in ways}:
            for leave in range(4):
                if (found := cheapest(block, enter, (leave,)) if reachable(enter, leave) else None) is not None:
                    step[enter, leave] = found[0] + DELETE * sum(gone), woven(found[1], gone)
        ways = followed(ways, step)
    return ways


def reachable(enter: int, leave: int) -> bool:
    return leave in (USER, ASSISTANT) or enter == leave or (enter, leave) == (NONE, SYSTEM)


class Segment:
    """Rows of one conversation that follow each other: what they count, and what a repair needs of them."""

    def __init__(self) -> None:
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first_role = self.last_role = self.first_turn = self.last_turn = None
        self.turns, self.dead = bytearray(), [0]

    def add(self, turn: int | None, role: str, text: str, copies: int, seen: bool) -> bool:
        """Take ``copies`` equal rows, which ``seen`` tells to have come before; True if the first of them may stay."""
        initial, shown = role[:1], text.rstrip(SPACE)
        legal = lambda a, b: a + b in ("su", "ua", "au")
        if self.rows:
            self.illegal += not legal(self.last_role, initial)
        else:
            self.first_role = initial
        self.illegal += (copies - 1) * (not legal(initial, initial))
        self.last_role = initial
        self.rows += copies
        if turn is not None:
            self.distinct += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        live = bool(shown) and not seen
        if not shown:
            self.blank += copies
        else:
            self.duplicate += copies - live
        if live:
            cut = shown[-1] not in ".!?"
            self.truncated += cut
            self.turns.append(2 * ROLES.get(initial, OTHER) + cut)
            self.dead.append(copies - 1)
        else:
            self.dead[-1] += copies
        return live

    def join(self, other: dict) -> None:
        """Count the following segment, given by ``summary``, as well."""
        if not other["rows"]:
            return
        if self.rows and self.last_role + other["first_role"] not in ("su", "ua", "au"):
            self.illegal += 1
        for name in ("rows", "blank", "duplicate", "truncated", "illegal", "distinct"):
            setattr(self, name, getattr(self, name) + other[name])
        if other["first_turn"] is not None:
            self.distinct -= other["first_turn"] == self.last_turn
            self.first_turn = other["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = other["last_turn"]
        self.last_role = other["last_role"]

    def summary(self) -> dict:
        return {name: getattr(self, name) for name in ("rows", "blank", "duplicate", "truncated", "illegal", "distinct", "first_role", "last_role", "first_turn", "last_turn")}

    def gaps(self) -> int:
        return 0 if self.first_turn is None else min(self.last_turn - self.first_turn + 1 - self.distinct, (1 << 63) - 1)

    def counts(self) -> dict:
        return {"gaps": self.gaps(), "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}


class Lines:
    """The repaired conversation, line by line, as edits are carried out, and its checksum."""

    def __init__(self) -> None:
        self.hash, self.last, self.any = hashlib.sha256(), "", False

    def due(self) -> str:
        return "assistant" if self.last == "u" else "user"

    def add(self, role: str, text: str) -> None:
        self.hash.update((f"\n{role}:{text}" if self.any else f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.any, self.last = True, role[:1]

    def inserted(self, audit: str, at: int) -> int:
        while at < len(audit) and audit[at] == "I":
            self.add(self.due(), "")
            at += 1
        return at

    def edited(self, audit: str, at: int, role: str, text: str, copies: int, live: bool) -> int:
        """Carry out the edits of ``copies`` equal rows, of which the first may be alive."""
        for k in range(copies):
            if not (k == 0 and live) and audit.startswith("D" * (copies - k), at):
                return at + copies - k
            at = self.inserted(audit, at)
            if audit[at] != "D":
                self.add(self.due() if audit[at] == "R" else role, text)
            at += 1
        return at


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
SUMMARY = "struct<rows: long, blank: long, duplicate: long, truncated: long, illegal: long, distinct: long, first_role: string, last_role: string, first_turn: long, last_turn: long>"
#: A row of the first pass is a repaired conversation (kind 0), a segment's summary (1), or a row that awaits its edits (2).
WALKED = f"kind int, piece int, at long, conv {{key}}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string, segment {SUMMARY}, ways array<struct<enter: int, leave: int, cost: long, audit: string>>, role string, text string, copies long, live boolean"


def walked(sorted_rows: DataFrame, key: str) -> DataFrame:
    """Conversations that lie within a partition, repaired; of the first and the last one of a partition, which may go
    on in other partitions, the summary of what is here and the rows themselves."""
    schema = WALKED.format(key=key)
    names = [x.split()[0] for x in "kind piece at conv gaps blank duplicate truncated illegal cost audit repaired_sha256 segment ways role text copies live".split()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, out = None, []
        current, segment, held, edge, piece = None, None, [], True, 0

        def flush() -> pa.RecordBatch:
            nonlocal out
            batch = pa.RecordBatch.from_pylist(out, schema=kinds)
            out = []
            return batch

        def wait(row: tuple, at: int) -> None:
            out.append({"kind": 2, "piece": piece, "at": at, "conv": current[0], "role": row[0], "text": row[1], "copies": row[2], "live": row[3]})

        def ended(last: bool) -> None:
            """The rows of ``current`` are over, here at least."""
            turns = bytes(segment.turns)
            if edge or last:
                for at, row in enumerate(held):
                    wait(row, segment.waiting + at)
                ways = [{"enter": e, "leave": x, "cost": c, "audit": a} for (e, x), (c, a) in ways_through(turns, segment.dead, range(4)).items()]
                out.append({"kind": 1, "piece": piece, "at": 0, "conv": current[0], "segment": segment.summary(), "ways": ways})
                return
            if len(turns) <= BLOCK_TURNS:
                cost, audit = cheapest(turns, NONE, ENDS)
                cost, audit = cost + DELETE * sum(segment.dead), woven(audit, segment.dead)
            else:
                ways = ways_through(turns, segment.dead, [NONE])
                cost, audit = min(ways[NONE, x] for x in ENDS if (NONE, x) in ways)
            lines, at = Lines(), 0
            for row in held:
                at = lines.edited(audit, at, *row)
            lines.inserted(audit, at)
            out.append({"kind": 0, "conv": current[0], **segment.counts(), "cost": cost, "audit": audit, "repaired_sha256": lines.hash.hexdigest()})

        for batch in batches:
            if kinds is None:
                long, text = pa.int64(), pa.string()
                fields = [(n, pa.int64()) for n in ("rows", "blank", "duplicate", "truncated", "illegal", "distinct")] + [("first_role", text), ("last_role", text), ("first_turn", long), ("last_turn", long)]
                way = pa.struct([("enter", pa.int32()), ("leave", pa.int32()), ("cost", long), ("audit", text)])
                types = [pa.int32(), pa.int32(), long, batch.schema.field("conv").type, *[long] * 6, text, text, pa.struct(fields), pa.list_(way), text, text, long, pa.bool_()]
                kinds = pa.schema(list(zip(names, types)))
            columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "copies", "seen", "piece")]
            for conv, turn, role, text, copies, seen, piece in zip(*columns):
                if current is None or current[0] != conv:
                    if current is not None:
                        ended(False)
                        edge = False
                    current, segment, held = (conv,), Segment(), []
                    segment.waiting = 0
                if copies:
                    held.append((role, text, copies, segment.add(turn, role, text, copies, seen)))
                    if edge:  # the first conversation may have begun earlier, so its rows are handed on as they come
                        wait(held.pop(), segment.waiting)
                        segment.waiting += 1
                if len(out) >= 256:
                    yield flush()
        if current is not None:
            ended(True)
            yield flush()

    return sorted_rows.mapInArrow(run, schema)


def mended(parts: DataFrame, key: str) -> DataFrame:
    """Conversations that lie in several pieces: their pieces' ways put together, in order, and the decided audit of each
    piece (kind 3) with the counts of the whole (kind 4)."""
    schema = f"kind int, piece int, at long, conv {key}, {', '.join(f'{c} long' for c in COUNTS)}, audit string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, whole, states, kinds = None, None, None, None

        def ended() -> pa.RecordBatch:
            cost, audit, trail = min((states[x] for x in ENDS if x in states), key=lambda x: x[:2])
            rows = [{"kind": 4, "piece": -1, "at": -2, "conv": current[0], **whole.counts(), "cost": cost, "audit": audit}]
            while trail is not None:
                trail, piece, own = trail
                rows.append({"kind": 3, "piece": piece, "at": -1, "conv": current[0], "audit": own})
            return pa.RecordBatch.from_pylist(rows, schema=kinds)

        for batch in batches:
            if kinds is None:
                kinds = pa.schema([("kind", pa.int32()), ("piece", pa.int32()), ("at", pa.int64()), ("conv", batch.schema.field("conv").type), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string())])
            for row in batch.select(["conv", "piece", "segment", "ways"]).to_pylist():
                if current is None or current[0] != row["conv"]:
                    if current is not None:
                        yield ended()
                    current, whole, states = (row["conv"],), Segment(), {NONE: (0, "", None)}
                whole.join(row["segment"])
                after: dict[int, tuple] = {}
                for way in row["ways"]:
                    if way["enter"] in states:
                        cost, audit, trail = states[way["enter"]]
                        value = cost + way["cost"], audit + way["audit"], (trail, row["piece"], way["audit"])
                        if way["leave"] not in after or value[:2] < after[way["leave"]][:2]:
                            after[way["leave"]] = value
                states = after
        if current is not None:
            yield ended()

    return parts.mapInArrow(run, schema)


def checked(stream: DataFrame, key: str) -> DataFrame:
    """Result rows of conversations in several pieces, from their rows and decided audits in order.

    A checksum is one pass over the text, so one task reads a conversation from end to end here, but holds no more of it
    than a batch and the audit."""
    schema = f"conv {key}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, lines, audit, at, kinds = None, None, "", 0, None

        def ended() -> pa.RecordBatch:
            lines.inserted(audit, at)
            return pa.RecordBatch.from_pylist([{**row, "repaired_sha256": lines.hash.hexdigest()}], schema=kinds)

        for batch in batches:
            if kinds is None:
                kinds = pa.schema([("conv", batch.schema.field("conv").type), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            for x in batch.to_pylist():
                if x["kind"] == 4:
                    if row is not None:
                        yield ended()
                    row, lines, audit, at = {c: x[c] for c in ("conv", *COUNTS, "audit")}, Lines(), "", 0
                elif x["kind"] == 3:
                    lines.inserted(audit, at)
                    audit, at = x["audit"], 0
                else:
                    at = lines.edited(audit, at, x["role"], x["text"], x["copies"], x["live"])
        if row is not None:
            yield ended()

    return stream.mapInArrow(run, schema)


def repaired(df: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text", copies_column: str | None = None, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for every conversation of ``df``.

    A row stands for ``copies_column`` equal rows, 1 by default; a conversation whose rows all stand for none has zeros,
    an empty audit and the checksum of nothing. Rows are taken by turn, nulls first, and rows of one turn by role and
    text (by their first 64 characters, then by hash). A null role or text is one space. Rows without an id are one conversation. Equal rows are combined before any
    shuffle: all but the first of them are duplicates, or all are blank. Other columns are not read.

    The table is sorted into pieces of about ``piece_rows`` rows and ``piece_bytes`` of text wherever conversations
    begin or end, so a conversation with most of the rows is searched by many tasks, and only the checksum of its
    repaired text is one task's pass. The audit of a conversation, a letter per edit, is held in memory whole, as in the
    result.
    """
    key = dict(df.select(F.col(conv_column).alias("conv")).dtypes)["conv"]
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    copies = F.lit(1).cast("long") if copies_column is None else F.coalesce(F.col(copies_column).cast("long"), F.lit(0))
    rows = df.select(F.col(conv_column).alias("conv"), F.col(turn_column).cast("long").alias("turn"), plain(role_column).alias("role"), plain(text_column).alias("text"), copies.alias("copies"))
    size = rows.agg(F.count("*"), F.sum(F.octet_length("text") + F.octet_length("role"))).first()
    pieces = max(df.sparkSession.sparkContext.defaultParallelism, -(-size[0] // piece_rows), -(-(size[1] or 0) // piece_bytes))

    gone = F.col("copies") <= 0
    bare = lambda c, kind: F.when(gone, F.lit(None).cast(kind)).otherwise(F.col(c)).alias(c)
    rows = rows.select("conv", bare("turn", "long"), bare("role", "string"), bare("text", "string"), F.greatest("copies", F.lit(0)).alias("copies"))
    rows = rows.withColumns({"content": F.xxhash64("role", "text"), "other": F.xxhash64("text", "role", F.lit(1))})
    # What a conversation holds at several turns; a null turn comes before all others.
    turn = F.struct(F.col("turn").isNotNull().alias("timed"), "turn")
    first = rows.where("copies > 0").groupBy("conv", "content", "other").agg(F.min(turn).alias("earliest"), F.max(turn).alias("latest")).where("earliest < latest")
    first = durable(first.select(*[F.col(c).alias(f"own_{c}") for c in ("conv", "content", "other")], "earliest"))
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"), F.first("content").alias("content"), F.first("other").alias("other"))
    conv, content, other = (F.col(c).eqNullSafe(F.col(f"own_{c}")) for c in ("conv", "content", "other"))
    rows = rows.join(first, conv & content & other, "left").withColumn("seen", F.coalesce(turn > F.col("earliest"), F.lit(False)))

    # Range bounds go through the driver, so long roles and texts count by their beginnings and then by hash.
    order = ["conv", "turn", F.substring("role", 1, 64), F.substring("text", 1, 64), "content", "other"]
    rows = rows.repartitionByRange(pieces, *order).sortWithinPartitions(*order)
    rows = rows.select("conv", "turn", "role", "text", "copies", "seen", F.spark_partition_id().alias("piece"))
    done = durable(walked(rows, key))
    parts = done.where("kind = 1").select("conv", "piece", "segment", "ways")
    decided = durable(mended(parts.repartition("conv").sortWithinPartitions("conv", "piece"), key))
    lines = done.where("kind = 2").select("kind", "piece", "at", "conv", *[F.lit(None).cast("long").alias(c) for c in COUNTS], F.lit(None).cast("string").alias("audit"), "role", "text", "copies", "live")
    added = decided.select("kind", "piece", "at", "conv", *COUNTS, "audit", *[F.lit(None).cast(t).alias(c) for c, t in (("role", "string"), ("text", "string"), ("copies", "long"), ("live", "boolean"))])
    split = checked(lines.union(added).repartition("conv").sortWithinPartitions("conv", "piece", "at"), key)
    result = ["conv", *COUNTS, "audit", "repaired_sha256"]
    return done.where("kind = 0").select(result).union(split.select(result)).withColumnRenamed("conv", conv_column)


def damaged(df: DataFrame) -> DataFrame:
    """``df`` (conv_id, turn, role, text) with faults by crc32 of ``conv_id:turn``, and how often each row stands there (copies)."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(plain("text"), "[.!?]", "")).otherwise(plain("text"))
    return df.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(plain("role")).alias("role"), text.alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))
