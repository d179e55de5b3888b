"""Repair of conversations: turns are aligned to an alternating grammar at the least cost, with an audit of the edits.

The grammar is ``(s?(ua)+)?`` over the initials of the roles, so there is one target string per length. All of them
without ``s`` end alike, hence one Wagner-Fischer table over (turns left, symbols left) aligns the turns to each feasible
length at once; a system turn in front is tried at every place. A simple repair gives the incumbent cost, and Ukkonen's
band leaves out cells from which insertions and deletions alone would cost more. The lengths of the least cost are
backtraced, and of their audits the least stays.

A conversation is cut into fragments, so that tables stay small however many turns it has. Going back over the
fragments gives the least cost of the rest for each phase of the grammar at a cut; going forward again, each
fragment is aligned from its phase on. Insertions at a cut belong to the fragment after it. No audit of a
fragment is the beginning of another one then, so the first fragment in which two audits differ decides between them.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.shared import stratum

KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
#: An incomplete turn that stays costs so much besides.
TRUNCATED_COST = 5
FRAGMENT = 256
#: Phases of the grammar: a user turn or an assistant turn is next; a system turn came and nothing else; nothing came.
USER, ASSISTANT, AFTER_SYSTEM, BEGINNING = range(4)
ROLES = ("user", "assistant")
_SAID = re.compile(r"[^\x20\x09-\x0D]")
_LAST = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)")

#: A turn in short: initial of its role, must it go, is it incomplete.
Turn = tuple[str, bool, bool]
Table = list[dict[int, int]]


# ---- alignment -----------------------------------------------------------------------


def simple_repair(turns: list[Turn], phase: int) -> tuple[int, int, bool]:
    """Cost, last phase, and whether a turn stays, when flawed turns go and all others take the role that is next."""
    cost, stays = 0, False
    for initial, gone, cut in turns:
        if gone or cut:
            cost += COST[DELETE]
        else:
            cost += COST[KEEP] if initial == "ua"[phase] else COST[REROLE]
            phase, stays = 1 - phase, True
    return cost, phase, stays


def incumbent(turns: list[Turn], phase: int, end: int) -> int:
    """The cost of some alignment from ``phase`` to ``end``."""
    cost, last, stays = simple_repair(turns, phase)
    if last == end:
        return cost
    # One turn more goes, or all go and one is put in.
    return cost + COST[DELETE] if stays else COST[DELETE] * len(turns) + COST[INSERT]


def table(turns: list[Turn], end: int, limit: int, open_end: bool) -> Table:
    """``table[i][r]``: least cost of the turns from ``i`` on with ``r`` symbols left, ending in phase ``end``; only cells within ``limit``.

    With ``open_end`` symbols may be put in after the last turn.
    """
    n = len(turns)
    last = {0: 0}
    if open_end:
        last |= {r: COST[INSERT] * r for r in range(1, limit // COST[INSERT] + 1)}
    rows: Table = [last]
    for i in range(n - 1, -1, -1):
        initial, gone, cut = turns[i]
        left = n - i
        below, row = rows[-1], {}
        for r in range(max(0, left - limit // COST[DELETE]), left + limit // COST[INSERT] + 1):
            cost = below.get(r, math.inf) + COST[DELETE]
            if r:
                cost = min(cost, row.get(r - 1, math.inf) + COST[INSERT])
                if not gone:
                    step = COST[KEEP] if initial == "ua"[(end - r) % 2] else COST[REROLE]
                    cost = min(cost, below.get(r - 1, math.inf) + step + (TRUNCATED_COST if cut else 0))
            if cost <= limit:
                row[r] = cost
        rows.append(row)
    rows.reverse()
    return rows


def backtrace(turns: list[Turn], cells: Table, end: int, i: int, r: int) -> str:
    """The least audit from a cell of the table."""
    audit = []
    while i < len(turns) or r:
        cost = cells[i][r]
        if i < len(turns) and cells[i + 1].get(r, math.inf) + COST[DELETE] == cost:
            audit.append(DELETE)
            i += 1
        elif r and cells[i].get(r - 1, math.inf) + COST[INSERT] == cost:
            audit.append(INSERT)
            r -= 1
        else:
            audit.append(KEEP if turns[i][0] == "ua"[(end - r) % 2] else REROLE)
            i, r = i + 1, r - 1
    return "".join(audit)


class Fragment:
    """Some turns in a row, aligned to every length from every phase."""

    def __init__(self, turns: list[Turn], rest: list[float], last: bool):
        self.turns, self.rest = turns, rest  # rest: the least cost after this fragment, by phase
        self.tables = [
            table(turns, end, max((incumbent(turns, phase, end) for phase in (USER, ASSISTANT)), default=0), last) for end in (USER, ASSISTANT)
        ]

    def ways(self, phase: int, i: int = 0) -> Iterator[tuple[float, int, str | None, tuple]]:
        """Cost with the rest, phase after it, beginning of the audit, and the cell where a table takes over (or none)."""
        gone = COST[DELETE] * (len(self.turns) - i)
        if phase in (AFTER_SYSTEM, BEGINNING):
            yield gone + self.rest[phase], phase, DELETE * (len(self.turns) - i), ()
        for end, cells in enumerate(self.tables):
            for r, cost in cells[i].items():
                # After a system turn something has to come; a phase of its own says that it still has not.
                if (r or phase in (USER, ASSISTANT)) and (end - r) % 2 == (phase == ASSISTANT):
                    yield cost + self.rest[end], end, "", (i, r)
        if phase == BEGINNING:
            for k, (initial, lost, cut) in enumerate(self.turns):
                if initial == "s" and not lost:
                    before = COST[DELETE] * k + (TRUNCATED_COST if cut else 0)
                    for cost, end, audit, cell in self.ways(AFTER_SYSTEM, k + 1):
                        yield before + cost, end, DELETE * k + KEEP + audit, cell

    def least(self, phase: int) -> float:
        return min((w[0] for w in self.ways(phase)), default=math.inf)

    def audit(self, phase: int) -> tuple[str, int]:
        """The least audit among the ways of the least cost, and the phase after it."""
        best = self.least(phase)
        return min((start + (backtrace(self.turns, self.tables[end], end, *cell) if cell else ""), end) for cost, end, start, cell in self.ways(phase) if cost == best)


def repair(turns: list[Turn], size: int = FRAGMENT) -> tuple[int, str]:
    """The least cost of edits that make the roles fit the grammar, and the least audit of that cost."""
    parts = [turns[at : at + size] for at in range(0, len(turns), size)] or [[]]
    rests: list[list[float]] = [[0, math.inf, math.inf, 0]]
    for k, part in enumerate(reversed(parts)):
        own = Fragment(part, rests[-1], k == 0)
        rests.append([own.least(phase) for phase in range(4)])
    rests.reverse()
    audit, phase = [], BEGINNING
    for k, part in enumerate(parts):
        text, phase = Fragment(part, rests[k + 1], k == len(parts) - 1).audit(phase)
        audit.append(text)
    return int(rests[0][BEGINNING]), "".join(audit)


def repaired(turns: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """``role, text`` of the repaired conversation; insertions follow the grammar, so a turn's place gives its role."""
    phase = USER
    for edit in audit:
        if edit == INSERT:
            yield ROLES[phase], ""
        else:
            role, text = next(turns)
            if edit == DELETE:
                continue
            yield (ROLES[phase] if edit == REROLE else role), text
            if role[:1] == "s" and edit == KEEP:
                continue
        phase = 1 - phase


# ---- Spark ---------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copy, lost``: the rows with the test damage; a dropped row stays as ``lost``, for its conversation.

    Null roles and texts become one blank, in the key of the damage also null ids and turns.
    """
    plain = rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).alias("key"),
    ).withColumn("kind", F.crc32("key") % 20)
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    lost = F.col("kind") == 0
    text = F.when(lost | (F.col("kind") == 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    # The order of rows of one turn is that before the damage.
    return plain.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"), lost.alias("lost"), F.col("role").alias("_role"), F.xxhash64("text").alias("_text"))


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, "turn", "_role", "_text", "text", "copy")


def _digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _rows(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= 5_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)


def audits(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of each conversation.

    Rows come by turn (null first; ties by role and text) and stream through; a few bytes of each are held, never the texts.
    Faults are looked for in this order, and the first counts: no character but blanks; role and text seen before;
    last character that is no blank none of ``.!?``. An empty role has no initial and can't be kept.
    """

    def judge(batches: Iterator[pa.RecordBatch]):
        source = _rows(batches, ("conv_id", "turn", "role", "text", "lost"))
        row = next(source, None)
        while row is not None:
            conv = row[0]
            turns: list[Turn] = []
            seen: set[bytes] = set()
            faults, illegal, first, last, distinct = [0, 0, 0], 0, None, None, 0
            while row is not None and row[0] == conv:
                _, turn, role, text, lost = row
                row = next(source, None)
                if lost:
                    continue
                if turn is not None:
                    first = turn if first is None else first
                    distinct += turn != last
                    last = turn
                own = _digest(role, text)
                end = _LAST.search(text) if _SAID.search(text) else None
                fault = 0 if end is None else 1 if own in seen else 2 if end.group() not in ".!?" else None
                seen.add(own)
                if fault is not None:
                    faults[fault] += 1
                illegal += bool(turns) and (turns[-1][0] + role[:1]) not in ("su", "ua", "au")
                turns.append((role[:1], fault in (0, 1), fault == 2))
            cost, audit = repair(turns)
            yield conv, 0 if first is None else last - first + 1 - distinct, *faults, illegal, cost, audit

    def run(batches):
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
        yield from _batches(judge(batches), names, [pa.int64()] * 7 + [pa.string()])

    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    return _in_order(rows).mapInArrow(run, schema)


def repaired_conversations(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``conv_id, place, role, text``: the turns after the edits that ``found`` (from ``audits``) names, in order; place -1 stands for each conversation.

    A conversation's audit comes before its rows, so rows stream through here too.
    """

    def follow(batches: Iterator[pa.RecordBatch]):
        source = _rows(batches, ("conv_id", "role", "text", "lost", "audit"))
        row = next(source, None)
        while row is not None:
            conv, audit = row[0], row[4]
            yield conv, -1, "", ""
            row = next(source, None)

            def own(conv=conv):
                nonlocal row
                while row is not None and row[0] == conv and row[4] is None:
                    now, row = row, next(source, None)
                    if not now[3]:
                        yield now[1], now[2]

            turns = own()
            for place, (role, text) in enumerate(repaired(turns, audit)):
                yield conv, place, role, text
            for _ in turns:
                pass

    def run(batches):
        yield from _batches(follow(batches), ["conv_id", "place", "role", "text"], [pa.int64(), pa.int64(), pa.string(), pa.string()])

    both = rows.withColumn("audit", F.lit(None).cast("string")).unionByName(found.select("conv_id", "audit"), allowMissingColumns=True)
    ordered = _in_order(both.withColumn("later", F.col("audit").isNull()), "later")
    return ordered.select("conv_id", "role", "text", "lost", "audit").mapInArrow(run, "conv_id long, place long, role string, text string")


def _text_digests(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` from the turns of ``repaired_conversations``, whose order is kept."""

    def add(batches: Iterator[pa.RecordBatch]):
        digest, conv, begun = None, None, False
        for name, place, role, text in _rows(batches, ("conv_id", "place", "role", "text")):
            if place < 0:
                if digest:
                    yield conv, digest.hexdigest()
                digest, conv = hashlib.sha256(), name
                continue
            digest.update(f"{'' if place == 0 else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        if digest:
            yield conv, digest.hexdigest()

    def run(batches):
        yield from _batches(add(batches), ["conv_id", "repaired_sha256"], [pa.int64(), pa.string()])

    return turns.mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair_report(rows: DataFrame, damage: bool = True) -> DataFrame:
    """A row per conversation: its faults, the cost and audit of the cheapest edits, and a digest of what they give.

    Rows without an id are one conversation. Repeated rows are repeated turns. Without rows there are no results.
    """
    found_in = damaged(rows) if damage else rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        F.lit(0).alias("copy"), F.lit(False).alias("lost"), F.coalesce("role", F.lit(" ")).alias("_role"), F.xxhash64(F.coalesce("text", F.lit(" "))).alias("_text"),
    )
    found = audits(found_in)
    digests = _text_digests(repaired_conversations(found_in, found)).select(stratum("conv_id").alias("_conv"), "repaired_sha256")
    return found.withColumn("_conv", stratum("conv_id")).join(digests, "_conv").drop("_conv")
