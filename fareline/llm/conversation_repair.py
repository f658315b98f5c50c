"""Repair of conversation structure by Hirschberg's divide and conquer.

A conversation should be an optional system turn, then user and assistant turns in alternation. The
cheapest edits that lead there are found: rows are kept, given another role or deleted, and empty
turns are inserted. Four states say what came last (nothing, system, user, assistant), so the cost of
a stretch of rows is a vector with one entry for each state.

A stretch is cut in the middle. A forward vector from its entry and a backward vector from its end
meet there, the state with the least sum is where the cheapest edits cross, and both halves are
solved on their own. No table of back pointers is held. Of several cheapest audits the least in
ASCII order is wanted. All audits of the rows before the cut end with the letter of its last row, so
none is the beginning of another, and their order decides whatever follows. The forward vector
carries this order of its four states' best audits as ranks, and the crossing of least rank is taken.

Rows are put in order once by a range partitioning of (conversation, turn), written, so a
conversation of any length lies in as many parts as it needs. Within a part all stretches of all
conversations take each step together as arrays. A conversation beyond ``BLOCK`` rows or one part is
a chain of blocks, each summed up as the costs and ranks from each state to each other. The chain's
states are settled first, then each block is solved as above.

Repeated rows are known by the smallest position of each (conversation, digest), joined back by
position, so repeats never meet in one task. Only the last step, the digest of a whole repaired
conversation, passes the rows of one conversation through one task in order; it holds one batch of
rows and the audit.

Defined results: a null text or role counts as one space; null ids are one conversation; null turns
come first; rows of one turn are taken by role, then digest of role and text; an empty role has no
initial and is never kept; an empty table has no conversations; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareline.session import written

#: Rows of a conversation that are solved as one stretch.
BLOCK = 512
#: Costs of the edits.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = "sua"
#: What can be done with a row, in ASCII order of the letters.
EDITS = ("D", "IK", "IR", "K", "R")
#: The state after an inserted turn, and after a row that got the role that fits.
AFTER_INSERT = (USER, USER, ASSISTANT, USER)
#: The cost of ending in each state: none, two, one or no more turns to insert.
END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
NEVER = 1 << 40
#: Positions in one part; ids of Spark's rows hold the part in the bits above.
PART_BITS = 33
SPACE = "\x20\t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")


def kept_state(state: int, initial: int) -> int | None:
    """The state after a kept row of the initial (index in ``INITIALS``, 3 for others)."""
    if initial == 0:
        return SYSTEM if state == START else None
    if initial == 1:
        return USER if state != USER else None
    return ASSISTANT if initial == 2 and state == USER else None


def row_costs() -> tuple[np.ndarray, np.ndarray]:
    """For each kind of row, and each state before and after: the least cost, and its edit.

    The kind is the initial, plus 4 if truncated, plus 8 if the row must be deleted.
    """
    cost = np.full((16, 4, 4), NEVER, np.int64)
    edit = np.zeros((16, 4, 4), np.int64)
    for kind in range(16):
        initial, more = kind % 4, TRUNCATED * (kind // 4 % 2)
        for state in range(4):
            options = [(DELETE, 0, state)]
            if kind < 8:
                inserted = AFTER_INSERT[state]
                options += [
                    (INSERT + more, 1, kept_state(inserted, initial)),
                    (INSERT + REROLE + more, 2, AFTER_INSERT[inserted]),
                    (more, 3, kept_state(state, initial)),
                    (REROLE + more, 4, AFTER_INSERT[state]),
                ]
            # The dearest first, so that the cheapest, then least in ASCII order, is left.
            for price, letter, after in sorted(options, key=lambda o: o[:2], reverse=True):
                if after is not None:
                    cost[kind, state, after], edit[kind, state, after] = price, letter
    return cost, edit


COST, EDIT = row_costs()


def forward(
    kinds: np.ndarray, starts: np.ndarray, ends: np.ndarray, entry: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Cost of each state after the rows of each stretch, and the order of their least audits."""
    cost = np.full((len(starts), 4), NEVER, np.int64)
    cost[np.arange(len(starts)), entry] = 0
    rank = np.tile(np.arange(4), (len(starts), 1))
    order = np.argsort(starts - ends, kind="stable")
    sizes = (ends - starts)[order]
    for step in range(int(sizes[0]) if len(sizes) else 0):
        own = order[: np.searchsorted(-sizes, -step)]
        kind = kinds[starts[own] + step]
        total = np.minimum(cost[own][:, :, None] + COST[kind], NEVER)
        best = (total * 4 + rank[own][:, :, None]).argmin(axis=1)
        line, after = np.arange(len(own))[:, None], np.arange(4)[None, :]
        letters = rank[own][line, best] * len(EDITS) + EDIT[kind][line, best, after]
        cost[own] = total[line, best, after]
        rank[own] = letters.argsort(axis=1).argsort(axis=1)
    return cost, rank


def backward(
    kinds: np.ndarray, starts: np.ndarray, ends: np.ndarray, target: np.ndarray
) -> np.ndarray:
    """Cost from each state before the rows of each stretch to its end."""
    cost = target.copy()
    order = np.argsort(starts - ends, kind="stable")
    sizes = (ends - starts)[order]
    for step in range(int(sizes[0]) if len(sizes) else 0):
        own = order[: np.searchsorted(-sizes, -step)]
        total = COST[kinds[ends[own] - 1 - step]] + cost[own][:, None, :]
        cost[own] = np.minimum(total.min(axis=2), NEVER)
    return cost


def only(states: np.ndarray) -> np.ndarray:
    """Targets that allow one state each."""
    target = np.full((len(states), 4), NEVER, np.int64)
    target[np.arange(len(states)), states] = 0
    return target


def solved(
    kinds: np.ndarray, starts: np.ndarray, ends: np.ndarray, entry: np.ndarray, target: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edit of each row, and the states before and after it.

    Each stretch is entered in a state and leaves in one of least cost with ``target`` added.
    """
    edit, before, after = (np.zeros(len(kinds), np.int64) for _ in range(3))
    while len(starts):
        one = ends - starts == 1
        at, p = starts[one], entry[one]
        price = COST[kinds[at], p] + target[one]
        state = (price * len(EDITS) + EDIT[kinds[at], p]).argmin(axis=1)
        edit[at], before[at], after[at] = EDIT[kinds[at], p, state], p, state
        more = ends - starts > 1
        starts, ends, entry, target = starts[more], ends[more], entry[more], target[more]
        middle = (starts + ends) // 2
        cost, rank = forward(kinds, starts, middle, entry)
        meet = cost + backward(kinds, middle, ends, target)
        crossing = (np.minimum(meet, NEVER) * 4 + rank).argmin(axis=1)
        starts, ends = np.concatenate([starts, middle]), np.concatenate([middle, ends])
        entry = np.concatenate([entry, crossing])
        target = np.concatenate([only(crossing), target])
    return edit, before, after


def stretches(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Of a part's rows in order: kinds, starts and ends of stretches, and whether a stretch's
    conversation has others, here or perhaps in another part."""
    same = table.column("conv").combine_chunks().dictionary_encode(null_encoding="encode")
    conv = same.indices.to_numpy(zero_copy_only=False)
    n = len(conv)
    first = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
    sizes = np.diff(np.append(first, n))
    blocks = -(-sizes // BLOCK)
    nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = np.repeat(first, blocks) + nth * BLOCK
    ends = np.minimum(starts + BLOCK, np.repeat(first + sizes, blocks))
    chained = np.repeat(blocks > 1, blocks)
    chained |= np.repeat(first, blocks) == 0
    chained |= ends == n
    chained |= np.repeat(first + sizes, blocks) == n
    kinds = table.column("kind").to_numpy().astype(np.int64)
    return kinds, starts, ends, chained


def summaries(key: tuple, table: pa.Table) -> pa.Table:
    """For each chained stretch the costs and ranks from each state to each state."""
    table = table.sort_by("seq")
    kinds, starts, ends, chained = stretches(table)
    starts, ends = starts[chained], ends[chained]
    entry = np.tile(np.arange(4), len(starts))
    cost, rank = forward(kinds, np.repeat(starts, 4), np.repeat(ends, 4), entry)
    seq = table.column("seq").to_numpy()[starts]
    return pa.table(
        {
            "conv": table.column("conv").take(pa.array(starts)),
            "seq": seq,
            "cost": [c.tobytes() for c in cost.reshape(-1, 16)],
            "rank": [r.tobytes() for r in rank.reshape(-1, 16)],
        }
    )


def chain(key: tuple, table: pa.Table) -> pa.Table:
    """The states between the stretches of one conversation, in order, and what ends it."""
    table = table.sort_by("seq")
    cost = [np.frombuffer(x, np.int64).reshape(4, 4) for x in table.column("cost").to_pylist()]
    rank = [np.frombuffer(x, np.int64).reshape(4, 4) for x in table.column("rank").to_pylist()]
    later = [END]
    for c in reversed(cost):
        later.append(np.minimum((c + later[-1]).min(axis=1), NEVER))
    later.reverse()
    state, entry, leave = START, [], []
    for k, c in enumerate(cost):
        entry.append(state)
        state = int(((c[state] + later[k + 1]) * 4 + rank[k][state]).argmin())
        leave.append(state)
    last = [False] * (len(cost) - 1) + [True]
    columns = {"seq": table.column("seq"), "entry": entry, "leave": leave, "last": last}
    return pa.table(columns)


def decided(key: tuple, table: pa.Table, known: pa.Table) -> pa.Table:
    """The edits of a part's rows; ``known`` holds the states of its chained stretches."""
    table, known = table.sort_by("seq"), known.sort_by("seq")
    kinds, starts, ends, chained = stretches(table)
    entry = np.zeros(len(starts), np.int64)
    target = np.tile(END, (len(starts), 1))
    last = np.ones(len(starts), bool)
    entry[chained] = known.column("entry").to_numpy()
    target[chained] = only(known.column("leave").to_numpy().astype(np.int64))
    last[chained] = known.column("last").to_numpy(zero_copy_only=False)
    edit, before, after = solved(kinds, starts, ends, entry, target)
    ending = np.zeros(len(kinds), bool)
    ending[ends[last] - 1] = True
    inserted = np.array(AFTER_INSERT)
    with_insert = (edit == 1) | (edit == 2)
    turned = np.where(edit == 2, inserted[inserted[before]], inserted[before])
    more = np.where(ending, END[after] // INSERT, 0)
    letters = [EDITS[e] + "I" * m for e, m in zip(edit.tolist(), more.tolist(), strict=True)]
    role = np.array([None, None, ROLES[USER], ROLES[ASSISTANT]], object)
    follow = [[ROLES[USER], ROLES[ASSISTANT]][2 - m :] for m in more.tolist()]
    return pa.table(
        {
            "conv": table.column("conv"),
            "seq": table.column("seq"),
            "edit": pa.array(letters, pa.string()),
            "before": pa.array(np.where(with_insert, role[inserted[before]], None), pa.string()),
            "stays": pa.array(edit != 0),
            "becomes": pa.array(
                np.where((edit == 2) | (edit == 4), role[turned], None), pa.string()
            ),
            "follow": pa.array(follow, pa.list_(pa.string())),
        }
    )


def spaced(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def placed(
    rows: DataFrame, id_column: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Rows with ``seq``, their position in the order of conversations and turns, and what is known
    of each row by itself. Written once, as positions must not change."""
    found = rows.select(
        F.col(id_column).alias("conv"),
        F.col(turn).alias("turn"),
        spaced(role).alias("role"),
        spaced(text).alias("text"),
    )
    last = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    found = found.select(
        "*",
        F.substring("role", 1, 1).alias("initial"),
        (last == "").alias("blank"),
        (~last.isin(".", "!", "?")).alias("truncated"),
        F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("digest"),
        # Spreads equal rows over parts.
        F.monotonically_increasing_id().alias("tie"),
    )
    order = ["conv", "turn", "role", "digest", "tie"]
    found = found.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    return written(found.withColumn("seq", F.monotonically_increasing_id()), "placed")


def edits(rows: DataFrame) -> DataFrame:
    """For each row of ``placed``: its fault and edits. ``edit`` holds the letters, with those of
    turns inserted before it and, at the end of a conversation, after it; ``before`` and ``follow``
    the roles of those turns; ``becomes`` a new role."""
    narrow = rows.select("conv", "seq", "initial", "blank", "truncated", "digest")
    firsts = narrow.where("not blank").groupBy("conv", "digest").agg(F.min("seq").alias("seq"))
    firsts = firsts.select("seq", F.lit(True).alias("first"))
    flagged = narrow.drop("digest").join(firsts, "seq", "left")
    repeated = ~F.col("blank") & F.col("first").isNull()
    fault = F.when(F.col("blank"), "blank").when(repeated, "duplicate")
    fault = fault.when(F.col("truncated"), "truncated")
    initial = F.lit(3)
    for k, letter in enumerate(INITIALS):
        initial = F.when(F.col("initial") == letter, k).otherwise(initial)
    kind = initial + F.when(fault == "truncated", 4).otherwise(0)
    kind += F.when(fault.isin("blank", "duplicate"), 8).otherwise(0)
    part = F.shiftright("seq", PART_BITS).alias("part")
    flagged = written(
        flagged.select("conv", "seq", part, F.coalesce(kind, initial).alias("kind"), fault.alias("fault")),
        "faults",
    )
    conv = rows.schema["conv"].dataType.simpleString()
    sums = flagged.groupBy("part").applyInArrow(
        summaries, f"conv {conv}, seq long, cost binary, rank binary"
    )
    states = sums.groupBy("conv").applyInArrow(
        chain, "seq long, entry long, leave long, last boolean"
    )
    states = states.withColumn("part", F.shiftright("seq", PART_BITS))
    found = flagged.groupBy("part").cogroup(states.groupBy("part")).applyInArrow(
        decided,
        f"conv {conv}, seq long, edit string, before string, stays boolean, becomes string, "
        "follow array<string>",
    )
    return found.join(flagged.select("seq", "fault"), "seq")


def repaired(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """The repaired conversations: id, ``seq`` and ``nth`` for the order, role and text."""
    empty = lambda name: F.struct(name.alias("role"), F.lit("").alias("text"))
    own = F.struct(F.coalesce("becomes", "role").alias("role"), F.col("text").alias("text"))
    turns = F.concat(
        F.when(F.col("before").isNotNull(), F.array(empty(F.col("before")))).otherwise(F.array()),
        F.when(F.col("stays"), F.array(own)).otherwise(F.array()),
        F.transform("follow", empty),
    )
    joined = rows.join(decisions.drop("conv"), "seq")
    return joined.select("conv", "seq", F.posexplode(turns).alias("nth", "turn")).select(
        "conv", "seq", "nth", "turn.role", "turn.text"
    )


class Conversation:
    """What is summed up of a conversation while its rows pass by."""

    def __init__(self, conv):
        self.conv = conv
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.letters: list[str] = []
        self.cost = self.distinct = 0
        self.initial = self.low = self.high = None
        self.sha, self.begun = hashlib.sha256(), False

    def line(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.begun else ''}{role}:{text}".encode())
        self.begun = True

    def add(self, decision: dict, row: dict) -> None:
        if self.initial is not None and self.initial + row["initial"] not in LEGAL:
            self.counts["illegal"] += 1
        self.initial = row["initial"]
        if row["turn"] is not None and row["turn"] != self.high:
            self.low = row["turn"] if self.low is None else self.low
            self.high = row["turn"]
            self.distinct += 1
        fault, letters = decision["fault"], decision["edit"]
        if fault:
            self.counts[fault] += 1
        self.letters.append(letters)
        self.cost += DELETE * letters.count("D") + INSERT * letters.count("I")
        self.cost += REROLE * letters.count("R")
        if decision["before"] is not None:
            self.line(decision["before"], "")
        if decision["stays"]:
            self.cost += TRUNCATED * (fault == "truncated")
            self.line(decision["becomes"] or row["role"], row["text"])
        for role in decision["follow"]:
            self.line(role, "")

    def result(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return {
            "conv": self.conv,
            "gaps": gaps,
            **self.counts,
            "cost": self.cost,
            "audit": "".join(self.letters),
            "repaired_sha256": self.sha.hexdigest(),
        }


def audits(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per conversation: gaps between turns, counts of faults and of illegal neighbours, cost and
    letters of the edits, and the digest of the repaired rows as lines of role and text."""
    conv = rows.schema["conv"].dataType.simpleString()
    schema = (
        f"conv {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, "
        "cost long, audit string, repaired_sha256 string"
    )
    decision = ["edit", "before", "stays", "becomes", "follow", "fault"]
    own = ["turn", "role", "text", "initial"]
    # A decision comes just before its row.
    both = decisions.select("conv", "seq", F.lit(0).alias("step"), *decision).unionByName(
        rows.select("conv", "seq", F.lit(1).alias("step"), *own), allowMissingColumns=True
    )
    both = both.repartition("conv").sortWithinPartitions("conv", "seq", "step")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        current: Conversation | None = None
        held: dict = {}
        for batch in batches:
            done = []
            kinds = batch.schema.field("conv").type
            for row in batch.to_pylist():
                if row["step"] == 0:
                    held = row
                    continue
                if current is None or current.conv != row["conv"]:
                    if current is not None:
                        done.append(current.result())
                    current = Conversation(row["conv"])
                current.add(held, row)
            yield results(done, kinds)
        if current is not None:
            yield results([current.result()], kinds)

    def results(found: list[dict], kind: pa.DataType) -> pa.RecordBatch:
        fields = [pa.field("conv", kind)]
        for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"):
            fields.append(pa.field(name, pa.int64()))
        fields += [pa.field("audit", pa.string()), pa.field("repaired_sha256", pa.string())]
        return pa.RecordBatch.from_pylist(found, schema=pa.schema(fields))

    return both.mapInArrow(fold, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows that lost their shape, by the CRC of id and turn: 0 is dropped, 1 emptied, 2 without
    the ends of its sentences, 3 there twice, 4 a user's; what is left of 20 stays as it is."""
    key = F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))
    fault = F.crc32(key.cast("binary")) % 20
    rows = conversations.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(spaced("role")).alias("role"),
        F.when(fault == 1, "")
        .when(fault == 2, F.regexp_replace(spaced("text"), "[.!?]", ""))
        .otherwise(spaced("text"))
        .alias("text"),
        fault.alias("fault"),
    )
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.where("fault != 0").withColumn("copy", F.explode(copies))
    return rows.drop("fault", "copy")
