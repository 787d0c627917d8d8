"""Repair of conversations: the cheapest edits after which the role initials
read ``(s?(ua)+)?``, found by a Viterbi search with coalescing survivors.

Edits of a row: K keeps it (0), R gives it the role user or assistant (3), D
deletes it (4); I inserts an empty row of user or assistant (3).  Blank and
duplicate rows must go; a truncated row that stays costs 3 more.  Of equally
cheap audits (the initials of the edits in order) the ASCII-least is taken.

**Search.**  Four states say what came last (nothing, s, u, a), and an edit
leads from a state to one other.  Each state's survivor is a leaf of a tree of
back pointers whose nodes count their references: a survivor that dies takes
its unshared branch along, and when all survivors descend from one child of
the root, that edit is certain, is emitted and forgotten.  So memory holds only
the rows on which survivors still differ (of one piece, see below).  Survivors of equal cost are compared
on their whole unresolved suffixes: back to where they part.  Two rules keep
this exact.  Rows that must go are no choice and never enter the search.  An
insertion stands directly before a row that stays, or at the end (D comes
before I), so the edits of a row form a word that no other word begins with.

**Long conversations.**  Rows are sorted over all tasks, numbered, and cut into
pieces of ``PIECE_ROWS``; a task searches whole pieces.  Of a conversation that
crosses pieces each segment first gives its cost from every state to every
state; folded from the end, these are the costs that still follow a segment.
With them each segment finds where it ends from each state, then, chained from
the start, which state it really starts from, and last its edits.  The chains
hold one small row a segment.  Only the digest of a repaired conversation, a
SHA-256, must read it in order: it streams sorted rows and holds none.

* Rows of a conversation are ordered by turn (nulls first), then role and a
  hash of the text; equal rows may take each other's place.
* Null roles and texts are one space.  Null ids form one conversation, null
  turns are the earliest.  Long texts are compared by SHA-256.
* Inner columns are renamed, so others of the input may have any name; an empty
  table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import Scratch, checked_broadcast
from vigil.llm.sharding import number_rows

SPACES = " \t\n\x0b\x0c\r"
#: Rows of a piece of the sorted table; a task holds none of them longer than survivors differ.
PIECE_ROWS = 100_000

#: States: nothing yet, after s, after u, after a.  Costs of the edits.
START, S, U, A = range(4)
RETAIN, RENAME, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: The state after an inserted or renamed row, and that row's role.
NEXT = {START: U, S: U, U: A, A: U}
ROLE = {U: "user", A: "assistant"}
#: What follows the last row, by state: cost and edits.
END = [(0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, "")]
END_COSTS = [c for c, _ in END]
INF = 1 << 60
#: FROM[q][p]: what any ending costs more from state q than from p, at most (edits that take its place:
#: an insertion, or deleting the s that only the start can keep).  A survivor that is dearer by more than
#: that can neither win nor tie, so it dies: else "nothing yet" would hold the tree to its root for ever.
FROM = [[0, 0, 3, 0], [6, 0, 3, 6], [7, 3, 0, 3], [4, 0, 3, 0]]
#: Piece and row of what is inserted at the end of a conversation.
LAST = 1 << 62


@cache
def moves(initial: str, truncated: bool) -> list[list[tuple[int, int, str]]]:
    """Of each state: (next state, cost, edits) for a row, the best per next state."""
    out = []
    for state in range(4):
        best = {state: (DELETE, "D")}
        at, cost, word = state, TRUNCATED * truncated, ""
        for _ in range(3):  # up to two insertions, then the row
            found = [(NEXT[at], cost + RENAME, word + "R")]
            kept = {"s": S if at == START else None, "u": U if at != U else None, "a": A if at == U else None}.get(initial)
            if kept is not None:
                found.append((kept, cost + RETAIN, word + "K"))
            for q, c, w in found:
                best[q] = min(best.get(q, (INF, "")), (c, w))
            at, cost, word = NEXT[at], cost + INSERT, word + "I"
        out.append([(q, c, w) for q, (c, w) in sorted(best.items())])
    return out


class Node:
    """An edit word of one row; ``kids`` and ``leaf`` are the references to it."""

    __slots__ = ("parent", "row", "word", "state", "kids", "leaf")

    def __init__(self, parent, row: int, word: str, state: int):
        self.parent, self.row, self.word, self.state = parent, row, word, state
        self.kids: set[Node] = set()
        self.leaf = False


def earlier(a: Node, b: Node) -> bool:
    """Whether the audit of ``a`` is less than that of ``b``: their unresolved
    suffixes, back to where they part, whole.  Both have a node for each row,
    so the first rows that differ decide."""
    x = y = ""
    while a is not b:
        if a.word != b.word:
            x, y = a.word, b.word
        a, b = a.parent, b.parent
    return x < y


class Survivors:
    """The search over one run of rows; ``step`` and ``finish`` give back what
    is certain: (row, state before it, edits).

    ``alive`` holds each state's cost, leaf and rank.  Ranks order the
    survivors' whole unresolved suffixes as ``earlier`` does: longer suffixes
    keep the order in which shorter ones differ, so a row only orders them
    anew by (rank, word) and never walks back."""

    def __init__(self, state: int = START):
        self.root = Node(None, -1, "", state)
        self.root.leaf = True
        self.alive: dict[int, tuple[int, Node, int]] = {state: (0, self.root, 0)}

    def step(self, row: int, initial: str, truncated: bool) -> Iterator[tuple[int, int, str]]:
        best: dict[int, tuple[int, int, str, Node]] = {}
        table = moves(initial, truncated)
        for p, (cost, node, rank) in self.alive.items():
            for q, more, word in table[p]:
                had, new = best.get(q), (cost + more, rank, word, node)
                if had is None or new[:3] < had[:3]:
                    best[q] = new
        best = {p: x for p, x in best.items() if not any(y[0] + FROM[q][p] < x[0] for q, y in best.items() if q != p)}
        old = [node for _, node, _ in self.alive.values()]
        self.alive = {}
        for rank, q in enumerate(sorted(best, key=lambda q: best[q][1:3])):
            total, _, word, parent = best[q]
            leaf = Node(parent, row, word, q)
            leaf.leaf = True
            parent.kids.add(leaf)
            self.alive[q] = total, leaf, rank
        for node in old:
            self.release(node)
        return self.certain()

    def release(self, node: Node) -> None:
        node.leaf = False
        while node is not self.root and not node.kids and not node.leaf:
            parent = node.parent
            parent.kids.discard(node)
            node = parent

    def certain(self) -> Iterator[tuple[int, int, str]]:
        out = []
        while len(self.root.kids) == 1 and not self.root.leaf:
            (kid,) = self.root.kids
            out.append((kid.row, self.root.state, kid.word))
            kid.parent = None
            self.root = kid
        return iter(out)

    def best(self, after: list[int]) -> int:
        """The end state of the cheapest, then least path, with the costs that follow each state."""
        return min(self.alive, key=lambda q: (self.alive[q][0] + after[q], self.alive[q][2]))

    def finish(self, after: list[int]) -> tuple[int, int, Iterator[tuple[int, int, str]]]:
        """(cost of this run, end state, the edits that were still open)."""
        end = self.best(after)
        for q in [q for q in self.alive if q != end]:
            self.release(self.alive.pop(q)[1])
        cost, leaf, _ = self.alive[end]
        leaf.leaf = False
        return cost, end, self.certain()


def costs(rows: Iterator[tuple[str, bool]]) -> list[int]:
    """Least cost of a run from each state (four) to each state (four)."""
    now = [[0 if p == q else INF for q in range(4)] for p in range(4)]
    for initial, truncated in rows:
        table = moves(initial, truncated)
        for p in range(4):
            new = [INF] * 4
            for at, cost in enumerate(now[p]):
                if cost < INF:
                    for q, more, _ in table[at]:
                        new[q] = min(new[q], cost + more)
            now[p] = new
    return [c for line in now for c in line]


def lines(state: int, word: str) -> tuple[str, str | None]:
    """What a word adds before its row (lines of inserted rows), and the row's new role."""
    lead, role = "", None
    for c in word:
        if c in "IR":
            state = NEXT[state]
            if c == "I":
                lead += f"{ROLE[state]}:\n"
            else:
                role = ROLE[state]
    return lead, role


# -- over Spark ----------------------------------------------------------------------------

def initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def ordered(conversations: DataFrame, scratch: Scratch, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(``_c``, ``_turn``, ``_role``, ``_text``, ``_row``): rows numbered in order.
    ``_c`` is the conversation as text, never null."""
    conv = F.col(conv_col)
    base = conversations.select(
        F.when(conv.isNull(), "null").otherwise(F.concat(F.lit("="), conv.cast("string"))).alias("_c"),
        F.col(turn_col).alias("_turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("_role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("_text"))
    base = base.withColumn("_h", F.xxhash64("_text")).withColumn("_o", F.monotonically_increasing_id())
    rows, _ = number_rows(base, ["_c", "_turn", "_role", "_h", "_o"], scratch)
    return rows.drop("_h", "_o")


def faults(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(``_c``, ``_row``, ``_turn``, ``_i``, ``_fault``): each row's first fault,
    ``blank``, ``duplicate``, ``truncated`` or none (empty)."""
    trimmed = F.rtrim(F.col("_text"), F.lit(SPACES))
    flat = scratch.cut(rows.select(
        "_c", "_row", "_turn", initial(F.col("_role")).alias("_i"),
        F.sha2(F.concat("_role", F.lit("\0"), "_text"), 256).alias("_key"),
        (trimmed == "").alias("_blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("_cut")), "flat")
    # The first row of each text that a conversation repeats: one row per text, written, so that a hot one can be split.
    first = scratch.cut(flat.where("not _blank").groupBy("_c", "_key").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
                        .where("_n > 1").select("_c", "_key", "_first"), "first")
    seen = flat.join(checked_broadcast(first), ["_c", "_key"], "left")
    fault = (F.when(F.col("_blank"), "blank").when(F.col("_first") < F.col("_row"), "duplicate")
             .when(F.col("_cut"), "truncated").otherwise(""))
    return scratch.cut(seen.select("_c", "_row", "_turn", "_i", fault.alias("_fault")), "faults")


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns])


def _runs(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Consecutive rows whose first ``key`` values are equal, as a stream."""
    from itertools import groupby

    return groupby(_batches(batches), key=lambda r: r[:key])


def _frame(rows: Iterator[tuple], schema: pa.Schema, size: int = 5_000) -> Iterator[pa.RecordBatch]:
    part = []
    for r in rows:
        part.append(r)
        if len(part) == size:
            yield _batch(part, schema)
            part = []
    if part:
        yield _batch(part, schema)


def _batch(part: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def _segments(rows: DataFrame) -> DataFrame:
    """Rows dealt by piece, in order."""
    return rows.repartition("_piece").sortWithinPartitions("_piece", "_row")


def _starts(choice: DataFrame, scratch: Scratch) -> DataFrame:
    """(``_c``, ``_piece``, ``_state``, ``_after``, ``_last``) of each segment of
    a conversation that crosses pieces."""
    spans = choice.groupBy("_c").agg(F.min("_piece").alias("_from"), F.max("_piece").alias("_to")).where("_from < _to")
    crossing, layout = scratch.cut(spans, "crossing"), "_c string, _piece long, _after array<long>, _last boolean"
    if crossing.isEmpty():
        return choice.sparkSession.createDataFrame([], layout + ", _state long")
    rows = scratch.cut(choice.join(checked_broadcast(crossing.select("_c")), "_c", "left_semi"), "segments")

    def cost_rows(batches):
        def run():
            for (c, piece), found in _runs(batches, 2):
                yield c, piece, costs((r[3], r[4]) for r in found)
        yield from _frame(run(), pa.schema([("_c", pa.string()), ("_piece", pa.int64()), ("_costs", pa.list_(pa.int64()))]))

    def follow(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_piece")
        after, out = END_COSTS, []
        for m in reversed(list(part["_costs"])):
            out.append(after)
            after = [min(int(m[4 * p + q]) + after[q] for q in range(4)) for p in range(4)]
        out.reverse()
        last = [False] * (len(part) - 1) + [True]
        return pd.DataFrame({"_c": part["_c"].tolist(), "_piece": part["_piece"].tolist(), "_after": out, "_last": last})

    made = _segments(rows).mapInArrow(cost_rows, "_c string, _piece long, _costs array<long>")
    after = scratch.cut(made.groupBy("_c").applyInPandas(follow, layout), "after")

    def end_rows(batches):
        def run():
            for (c, piece), found in _runs(batches, 2):
                searches, after, last = [Survivors(p) for p in range(4)], None, None
                for _, _, row, first, cut, after, last in found:
                    for s in searches:
                        s.step(row, first, cut)
                yield c, piece, after, last, [s.best(after) for s in searches]
        yield from _frame(run(), pa.schema([("_c", pa.string()), ("_piece", pa.int64()), ("_after", pa.list_(pa.int64())),
                                            ("_last", pa.bool_()), ("_ends", pa.list_(pa.int64()))]))

    def chain(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_piece")
        state, out = START, []
        for ends in part["_ends"]:
            out.append(state)
            state = int(ends[state])
        return pd.DataFrame({"_c": part["_c"].tolist(), "_piece": part["_piece"].tolist(),
                             "_after": [list(map(int, a)) for a in part["_after"]], "_last": part["_last"].tolist(), "_state": out})

    timed = rows.join(checked_broadcast(after), ["_c", "_piece"]).select("_c", "_piece", "_row", "_i", "_cut", "_after", "_last")
    ends = _segments(timed).mapInArrow(end_rows, layout + ", _ends array<long>")
    return scratch.cut(ends.groupBy("_c").applyInPandas(chain, layout + ", _state long"), "starts")


EDIT = "_c string, _piece long, _row long, _word string, _lead string, _as string, _cost long"


def edits(flagged: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per row of ``faults``, and one more (``_tail``) for a conversation
    with insertions at its end: ``_word`` (edits), ``_lead`` (lines of inserted
    rows before it), ``_as`` (new role, null if kept), ``_cost``."""
    piece = F.floor(F.col("_row") / PIECE_ROWS).alias("_piece")
    forced = flagged.where("_fault in ('blank', 'duplicate')").select(
        "_c", piece, "_row", F.lit("D").alias("_word"), F.lit("").alias("_lead"), F.lit(None).cast("string").alias("_as"),
        F.lit(DELETE).cast("long").alias("_cost"))
    choice = scratch.cut(flagged.where("_fault in ('', 'truncated')").select(
        "_c", piece, "_row", "_i", (F.col("_fault") == "truncated").alias("_cut")), "choice")
    starts = _starts(choice, scratch)
    known = choice.join(checked_broadcast(starts), ["_c", "_piece"], "left").select(
        "_c", "_piece", "_row", "_i", "_cut", F.coalesce("_state", F.lit(START)).cast("long").alias("_state"),
        F.coalesce("_after", F.array(*[F.lit(c).cast("long") for c in END_COSTS])).alias("_after"),
        F.coalesce("_last", F.lit(True)).alias("_last"))

    def search(batches):
        def run():
            for (c, piece), found in _runs(batches, 2):
                s = None
                for _, _, row, first, cut, state, after, last in found:
                    s = s or Survivors(state)
                    for at, before, word in s.step(row, first, cut):
                        yield c, piece, at, word, *lines(before, word), None
                cost, end, rest = s.finish(after)
                for at, before, word in rest:
                    yield c, piece, at, word, *lines(before, word), None
                # The run's cost stands on one row more, with the insertions at the end of the conversation, behind all its rows.
                more, word = END[end] if last else (0, "")
                yield c, LAST if word else piece, LAST if word else row, word, lines(end, word)[0], "", cost + more
        yield from _frame(run(), pa.schema([
            ("_c", pa.string()), ("_piece", pa.int64()), ("_row", pa.int64()), ("_word", pa.string()),
            ("_lead", pa.string()), ("_as", pa.string()), ("_cost", pa.int64())]))

    found = _segments(known).mapInArrow(search, EDIT)
    return scratch.cut(found.withColumn("_tail", F.col("_cost").isNotNull()).unionByName(
        forced.withColumn("_tail", F.lit(False))), "edits")


def repaired_rows(rows: DataFrame, edited: DataFrame) -> DataFrame:
    """(``_c``, ``_row``, ``_tail``, ``_lines``): the lines ``role:text`` that a
    row of the input became, with those inserted before it (or at the end)."""
    stay = edited.where("not _tail and _word <> 'D'").join(rows.select("_row", "_role", "_text"), "_row")
    own = F.concat("_lead", F.coalesce("_as", "_role"), F.lit(":"), F.col("_text"))
    tails = edited.where("_tail and _word <> ''").select("_c", "_row", "_tail", F.expr("substr(_lead, 1, length(_lead) - 1)").alias("_lines"))
    return stay.select("_c", "_row", "_tail", own.alias("_lines")).unionByName(tails)


def digests(repaired: DataFrame) -> DataFrame:
    """(``_c``, ``_sha``) of each conversation's lines, joined by line ends: the
    rows stream through in order, none is kept."""
    def run(batches):
        def each():
            for (c,), found in _runs(batches, 1):
                h = hashlib.sha256()
                for k, (_, text) in enumerate(found):
                    h.update(b"\n" * (k > 0) + text.encode("utf-8", "surrogatepass"))
                yield c, h.hexdigest()
        yield from _frame(each(), pa.schema([("_c", pa.string()), ("_sha", pa.string())]))

    dealt = repaired.repartition("_c").sortWithinPartitions("_c", "_row", "_tail").select("_c", "_lines")
    return dealt.mapInArrow(run, "_c string, _sha string")


def audits(edited: DataFrame) -> DataFrame:
    """(``_c``, ``_cost``, ``_audit``): first one string a piece, then those in order."""
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_row", "_tail", "_word"))), lambda x: x["_word"]), "")
    parts = edited.groupBy("_c", "_piece").agg(words.alias("_part"), F.sum("_cost").alias("_cost"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_piece", "_part"))), lambda x: x["_part"]), "")
    return parts.groupBy("_c").agg(F.sum("_cost").alias("_cost"), joined.alias("_audit"))


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """The repaired rows: (conversation, ``position`` from 0, ``role``, ``text``)."""
    scratch = Scratch(conversations.sparkSession, "repair")
    rows = ordered(conversations, scratch, conv_col, turn_col, role_col, text_col)
    edited = edits(faults(rows, scratch), scratch)
    stay = edited.where("_word <> ''").join(rows.select("_row", "_role", "_text"), "_row", "left")
    lead = F.filter(F.split("_lead", ":\n"), lambda x: x != "")
    added = F.transform(lead, lambda x: F.struct(x.alias("role"), F.lit("").alias("text")))
    own = F.when(F.col("_tail") | (F.col("_word") == "D"), F.expr("cast(array() as array<struct<role:string,text:string>>)")).otherwise(
        F.array(F.struct(F.coalesce("_as", "_role").alias("role"), F.col("_text").alias("text"))))
    out = stay.select("_c", "_row", "_tail", F.posexplode(F.concat(added, own)).alias("_k", "_r"))
    placed, _ = number_rows(out, ["_c", "_row", "_tail", "_k"], scratch)
    first = placed.groupBy("_c").agg(F.min("_row").alias("_first"))
    kind = conversations.schema[conv_col].dataType
    return placed.join(first, "_c").select(
        F.when(F.col("_c") != "null", F.expr("substr(_c, 2)")).cast(kind).alias(conv_col),
        (F.col("_row") - F.col("_first")).alias("position"), F.col("_r.role").alias("role"), F.col("_r.text").alias("text"))


def audit(conversations: DataFrame, keep: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
          role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation of ``keep``: gaps, faults, cost, audit and the
    digest of the repaired lines; zeros and empty where it has no row left."""
    scratch = Scratch(conversations.sparkSession, "repair")
    rows = ordered(conversations, scratch, conv_col, turn_col, role_col, text_col)
    flagged = faults(rows, scratch)
    edited = edits(flagged, scratch)
    # The row before has the number before: no window over a conversation is needed.
    before = flagged.select((F.col("_row") + 1).alias("_row"), F.col("_c").alias("_pc"), F.col("_i").alias("_pi"))
    wrong = (F.col("_pc") == F.col("_c")) & ~F.concat("_pi", "_i").isin("su", "ua", "au")
    counts = flagged.join(before, "_row", "left").groupBy("_c").agg(
        *[F.count_if(F.col("_fault") == f).alias(f"_{f}") for f in ("blank", "duplicate", "truncated")],
        F.count_if(wrong).alias("_illegal"), F.min("_turn").alias("_lo"), F.max("_turn").alias("_hi"))
    turns = flagged.groupBy("_c", "_turn").agg(F.lit(1).alias("_one")).groupBy("_c").agg(F.count("_turn").alias("_turns"))
    found = (counts.join(turns, "_c").join(audits(edited), "_c")
             .join(digests(repaired_rows(rows, edited)), "_c", "left"))
    conv = F.col(conv_col)
    every = keep.select(conv).distinct().withColumn(
        "_c", F.when(conv.isNull(), "null").otherwise(F.concat(F.lit("="), conv.cast("string"))))
    zero = F.lit(0).cast("long")
    return every.join(found, "_c", "left").select(
        conv, F.coalesce(F.col("_hi") - F.col("_lo") + 1 - F.col("_turns"), zero).cast("long").alias("gaps"),
        *[F.coalesce(f"_{f}", zero).alias(f) for f in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("_audit", F.lit("")).alias("audit"),
        F.coalesce("_sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """Known damage for tests and figures, by the checksum of ``conv:turn``
    modulo 20: 0 drops a row, 1 empties its text, 2 removes its ends of
    sentences, 3 repeats it, 4 makes it the user's.  Nulls count as one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv_col).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), space))
    text, kind = F.coalesce(F.col(text_col), space), F.crc32(key.cast("binary")) % 20
    return conversations.where(kind != 0).select(
        conv_col, turn_col, F.when(kind == 4, "user").otherwise(F.coalesce(F.col(role_col), space)).alias(role_col),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias(text_col),
        F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("_k")).drop("_k")
