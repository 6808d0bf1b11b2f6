"""Conversation structure repair (operator 13): the cheapest edits that make roles alternate, by scalar big-integer weights.

What is left of a conversation after its edits must have role initials `(s?(ua)+)?`. That is a walk over four states (nothing yet, a
system row, a user row, an assistant row last), a layer of edges for each row and one for an insertion before it. An edge has a cost
and at most one letter of the audit (D, I, K or R). A path's weight is one integer: the high digits are its cost, the low ones its
letters as three-bit digits, the first letter in the highest place and zeros behind the last. The smaller integer is the cheaper path
and, at equal cost, the one of the ASCII-least audit, so an ordinary shortest path by integer minimum decides everything.

Two paths of one cost to one node are never a prefix of each other (the rest would be insertions, which cost), so what follows can't
turn their order round, and a node needs its smallest weight only. A second insertion in a gap is never on a cheapest path: from each
state two insertions lead to one that "nothing yet" or the state itself is as good as.

A conversation is cut into blocks of consecutive rows. A block's task finds the cheapest way between each two states (16 weights at
most), and the blocks of a conversation are the edges of the same kind of walk: no task holds the rows of a whole conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellscape.llm.common import arrow_groups, arrow_map, shuffle_partitions, staged
from cellscape.operators.ranking import row_numbers

BLOCK_ROWS = 1_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
"""Costs of the edits, and what an undeleted truncated row adds."""
START, SYSTEM, USER, ASSISTANT, END = range(5)
LETTERS = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTER_AT = {v: k for k, v in LETTERS.items()}
BITS = 3
TO_USER, TO_ASSISTANT = [(s, USER) for s in (START, SYSTEM, ASSISTANT)], [(USER, ASSISTANT)]
STAY = [(s, s) for s in range(4)]
KEPT = {"s": [(START, SYSTEM)], "u": TO_USER, "a": TO_ASSISTANT}
ROLE_AFTER = {START: "user", SYSTEM: "user", ASSISTANT: "user", USER: "assistant"}

Edge = tuple[int, int, int, int, int]
"""From and to state, cost, letters as an integer of three-bit digits, number of letters."""


def _edges(moves: list[tuple[int, int]], cost: int, letter: str) -> list[Edge]:
    return [(a, b, cost, LETTERS[letter], 1) for a, b in moves]


GAP: list[Edge] = [(a, b, 0, 0, 0) for a, b in STAY] + _edges(TO_USER + TO_ASSISTANT, INSERT, "I")

LAST: list[Edge] = [(START, END, 0, 0, 0), (ASSISTANT, END, 0, 0, 0)]


def row_edges(initial: str, fault: str) -> list[Edge]:
    """The edges of a row: it goes, stays or gets another role; a blank or duplicate row has to go."""
    gone = _edges(STAY, DELETE, "D")
    if fault in ("blank", "duplicate"):
        return gone
    more = TRUNCATED if fault == "truncated" else 0
    return gone + _edges(KEPT.get(initial, []), KEEP + more, "K") + _edges(TO_USER + TO_ASSISTANT, REROLE + more, "R")


def cheapest(layers: list[list[Edge]], start: int, longest: int) -> dict[int, tuple[int, int, int, list[Edge]]]:
    """(cost, letters, number of letters, edges taken) of the smallest weight from `start` to each state; longest: letters that a path can have."""
    high = BITS * longest
    best: dict[int, tuple] = {start: (0, 0, None)}
    for layer in layers:
        now: dict[int, tuple] = {}
        for edge in layer:
            a, b, cost, letters, n = edge
            if a in best:
                weight, at, trail = best[a]
                weight += (cost << high) + (letters << (high - BITS * (at + n)))
                if b not in now or weight < now[b][0]:
                    now[b] = (weight, at + n, (trail, edge))
        best = now
    return {b: (w >> high, (w & ((1 << high) - 1)) >> (high - BITS * n), n, _taken(trail)) for b, (w, n, trail) in best.items()}


def _taken(trail) -> list[Edge]:
    out = []
    while trail:
        trail, edge = trail
        out.append(edge)
    return out[::-1]


def letters_of(value: int, n: int) -> str:
    """The audit of n letters that an integer of three-bit digits holds."""
    return "".join(LETTER_AT[int(d)] for d in oct(value)[2:].rjust(n, "0")) if n else ""


def value_of(audit: str) -> int:
    return int("".join(str(LETTERS[c]) for c in audit) or "0", 8)


def legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of conversations after the damage that a checksum of `conv_id:turn` deals out: conv_id, turn, role, text.

    A null role or text is one space, and so is a null in the checksum's text. Of twenty remainders 0 drops the row, 1 empties its
    text, 2 takes . ! ? out of it, 3 repeats it, 4 makes it a user's.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    told = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return told.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def faults(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with _at, their place in the conversation from 1, and fault: blank, duplicate, truncated or ''.

    The order is by turn (nulls first), then role and text; equal rows are copies of each other. A duplicate is a row whose role and
    text an earlier one has: where those meet, the first place of each is found by an aggregate, so a text that is repeated without
    end is no group in one task.
    """
    spaces = F.lit(" \t\n\x0b\x0c\r")
    last = F.substring(F.rtrim("text", spaces), -1, 1)
    placed = staged(row_numbers(rows, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "_at", by=["conv_id"]), "conversation-rows")
    keyed = placed.withColumn("_key", F.sha2(F.concat_ws("\x00", F.length("role").cast("string"), "role", "text"), 256))
    first = keyed.groupBy(F.col("conv_id").alias("_conv"), F.col("_key").alias("_same")).agg(F.min("_at").alias("_first"))
    met = keyed.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_key") == F.col("_same")))
    fault = F.when(last == "", "blank").when(F.col("_at") > F.col("_first"), "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    return met.select("conv_id", "turn", "role", "text", "_at", fault.alias("fault"))


def _ways(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The cheapest ways through a block from each state to each: one row a way, with the block's first and last initials and illegal pairs."""
    table = table.sort_by("_at")
    initials = [r[:1] for r in table.column("role").to_pylist()]
    layers = []
    for initial, fault in zip(initials, table.column("fault").to_pylist(), strict=True):
        layers += [GAP, row_edges(initial, fault)]
    conv, block = key[0].as_py(), key[1].as_py()
    illegal = sum(not legal(a, b) for a, b in zip(initials, initials[1:], strict=False))
    out = []
    for start in (START,) if block == 0 else range(4):
        for end, (cost, letters, n, _) in cheapest(layers, start, len(layers)).items():
            out.append((conv, block, start, end, cost, letters_of(letters, n), initials[0], initials[-1], illegal))
    return pa.table([pa.array(c) for c in zip(*out, strict=True)], names=WAYS.names).cast(WAYS)


WAYS = pa.schema([("conv_id", pa.int64()), ("_block", pa.int64()), ("_start", pa.int32()), ("_end", pa.int32()), ("_cost", pa.int64()), ("_letters", pa.string()), ("_first", pa.string()), ("_last", pa.string()), ("_illegal", pa.int64())])
_WAYS_DDL = "conv_id long, _block long, _start int, _end int, _cost long, _letters string, _first string, _last string, _illegal long"
_PATHS_DDL = "conv_id long, _block long, _piece string, cost long, illegal long"


def _paths(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The blocks of one conversation put together: every block's piece of the audit; block 0 has the cost and the illegal pairs."""
    blocks: dict[int, list[dict]] = {}
    for way in sorted(table.to_pylist(), key=lambda w: w["_block"]):
        blocks.setdefault(way["_block"], []).append(way)
    layers = [[(w["_start"], w["_end"], w["_cost"], value_of(w["_letters"]), len(w["_letters"])) for w in ways] for ways in blocks.values()]
    longest = sum(max(e[4] for e in layer) for layer in layers) + 1
    cost, _, _, taken = cheapest([*layers, GAP, LAST], START, longest)[END]
    pieces = [letters_of(e[3], e[4]) for e in taken]
    pieces = [*pieces[: len(blocks) - 1], "".join(pieces[len(blocks) - 1 :])]
    ends = [ways[0] for ways in blocks.values()]
    illegal = sum(w["_illegal"] for w in ends) + sum(not legal(a["_last"], b["_first"]) for a, b in zip(ends, ends[1:], strict=False))
    n = len(blocks)
    return pa.table({"conv_id": pa.array([key[0].as_py()] * n, pa.int64()), "_block": pa.array(list(blocks), pa.int64()), "_piece": pieces, "cost": pa.array([cost] + [None] * (n - 1), pa.int64()), "illegal": pa.array([illegal] + [None] * (n - 1), pa.int64())})


def repaired(rows: Iterator[tuple[str, str, str | None]]) -> Iterator[str]:
    """The lines `role:text` of rows (role, text, piece of the audit that begins here) of one conversation, edited as the audit says."""
    state, letters = START, iter("")
    for role, text, piece in rows:
        letters = iter(piece) if piece is not None else letters
        for letter in letters:
            if letter == "I":
                state, line = _added(state, "")
                yield line
                continue
            if letter == "K":
                state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
                yield f"{role}:{text}"
            elif letter == "R":
                state, line = _added(state, text)
                yield line
            break
    for _ in letters:
        state, line = _added(state, "")
        yield line


def _added(state: int, text: str) -> tuple[int, str]:
    role = ROLE_AFTER[state]
    return (ASSISTANT if role == "assistant" else USER), f"{role}:{text}"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its rows in order: they stream through the hash, so a long conversation is not held."""
    rows = (r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns], strict=True))
    for (conv,), own in groupby(rows, key=lambda r: r[:1]):
        digest, audit, first, told = hashlib.sha256(), [], True, []

        def noted(own=own, audit=audit, told=told):
            for _, role, text, piece, cost, illegal in own:
                if piece is not None:
                    audit.append(piece)
                if cost is not None:
                    told[:] = [cost, illegal]
                yield role, text, piece

        for line in repaired(noted()):
            digest.update(line.encode() if first else b"\n" + line.encode())
            first = False
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([told[0]], pa.int64()), pa.array([told[1]], pa.int64()), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], names=["conv_id", "cost", "illegal", "audit", "repaired_sha256"])


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The cheapest repair of every conversation of rows (conv_id long, turn, role, text; other columns are left aside), which may be
    damaged ones: conv_id, blank, duplicate, truncated (rows by their first fault), illegal (neighbours whose initials aren't su, ua or
    au), cost, audit and repaired_sha256.

    A null conv_id is a conversation like others, a null turn comes first, a null role or text is one space. Rows of one turn are in
    the order of role and text; a row that is there twice is a duplicate of itself. No rows give no conversations.
    """
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    told = staged(faults(own).withColumn("_block", F.floor((F.col("_at") - 1) / block_rows).cast("long")), "conversation-faults")
    ways = arrow_groups(told.select("conv_id", "_block", "_at", "role", "fault"), ["conv_id", "_block"], _ways, _WAYS_DDL)
    paths = staged(arrow_groups(ways, ["conv_id"], _paths, _PATHS_DDL).withColumnsRenamed({"conv_id": "_conv", "_block": "_b"}), "conversation-paths")
    met = told.join(paths, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_block") == F.col("_b")))
    begins = F.col("_at") % block_rows == 1 if block_rows > 1 else F.lit(True)
    ordered = met.select("conv_id", "_at", "role", "text", *[F.when(begins, F.col(c)).alias(c) for c in ("_piece", "cost", "illegal")]).repartition(shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "_at").drop("_at")
    made = arrow_map(ordered, _digests, "conv_id long, cost long, illegal long, audit string, repaired_sha256 string")
    counts = told.groupBy(F.col("conv_id").alias("_conv")).agg(*[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    return made.join(counts, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def gaps(rows: DataFrame) -> DataFrame:
    """conv_id and the turns missing between its first and last one (nulls don't count; 0 if all are null)."""
    span = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    return rows.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"))


def damaged_and_repaired(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every conv_id of rows with the gaps, faults and repair of what the damage left of it; zeros, an empty audit and the hash of an
    empty text where nothing is left."""
    left = staged(damaged(rows), "conversations-damaged")
    ids = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = ids
    for part in (gaps(left), repair(left, block_rows)):
        named = part.withColumnRenamed("conv_id", "_conv")
        out = out.join(named, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.withColumns(zero | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))})
