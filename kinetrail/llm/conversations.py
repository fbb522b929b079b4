"""Repair of conversations: error-correcting Earley parsing over a weighted role grammar.

The grammar is left-linear, and its weights are those of the error productions: a row may be deleted, given another role,
or a row may be inserted before it. Every Earley item of such a grammar begins at the conversation's start, so a chart set
holds one completed item for a nonterminal, with its least (cost, audit). Audits aren't copied: a set keeps their order as
ranks, and letters are traced back at the end. Two audits that have consumed equally many rows and end in a row's letter
are never prefixes of each other, so the order of prefixes decides that of all continuations. Chart sets that differ only
by a cost added to all items have the same successors, which are made once and remembered.

Rows are range-partitioned by (conversation, turn). A conversation within one partition is parsed where it lies. One that
crosses partitions is a chain of blocks: each block is parsed from every possible chart item (a table of fixed size: least
cost and order for each pair of entering and leaving items), the tables of a chain are joined, and each block traces its
own letters. No task holds such a conversation; only its digest, which is sequential by nature, streams through one.

Defined results: null roles and texts count as one space; null turns come first and count for no gap; a null conv_id is a
conversation of its own. Rows of equal turn are ordered by role and text. A role other than system, user or assistant is
known by its first letter. Rows that agree in role and text with an earlier one are duplicates, so repeated rows are
deleted. An empty or very long text is one row like any other. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, bound_batches, forget, partitions_for, settle, tidy

#: Role grammar: (nonterminal, nonterminal before it, terminal). A conversation is `nothing` or ends in `answered`.
NOTHING, SYSTEM, ASKED, ANSWERED = range(4)
PRODUCTIONS = [(SYSTEM, NOTHING, "system"), (ASKED, NOTHING, "user"), (ASKED, SYSTEM, "user"), (ASKED, ANSWERED, "user"), (ANSWERED, ASKED, "assistant")]
GOALS = (NOTHING, ANSWERED)
#: Terminals that a row may be given, or that may be inserted.
FREE = ("user", "assistant")
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: An item this much dearer than the cheapest of its set can't win: two inserts and a deletion lead from any item to one
#: that accepts all that any other accepts.
BEYOND = 2 * INSERT + DELETE
#: Letters of a row's class: initial of its role, then whether it must be deleted (2) or is truncated (1).
INITIALS = {"s": 0, "u": 1, "a": 2}
TERMINAL_INITIAL = {"system": 0, "user": 1, "assistant": 2}
SPACES = " \t\n\x0b\x0c\r"
#: Rows or characters of a conversation that a task holds while it waits for its end; beyond, it becomes a chain of blocks.
HOLD_ROWS, HOLD_CHARS = 1 << 16, 1 << 24

Items = tuple[tuple[int, int] | None, ...]
#: What a chart set's items come from: (item of the set before, letters).
Back = tuple[tuple[int, str] | None, ...]


def start(at: int = NOTHING) -> Items:
    return tuple((0, 0) if k == at else None for k in range(4))


def closed(items: Items) -> list[tuple[int, int, str, int] | None]:
    """The set with all inserted rows: for each nonterminal least (cost, order, letters) and the item that it began at."""
    out: list[tuple[int, int, str, int] | None] = [None] * 4
    agenda = [(x[0], x[1], "", k, k) for k, x in enumerate(items) if x is not None]
    heapq.heapify(agenda)
    while agenda:
        cost, rank, letters, at, origin = heapq.heappop(agenda)
        if out[at] is not None:
            continue
        out[at] = (cost, rank, letters, origin)
        for to, before, terminal in PRODUCTIONS:
            if before == at and terminal in FREE and out[to] is None:
                heapq.heappush(agenda, (cost + INSERT, rank, letters + "I", to, origin))
    return out


def scanned(items: Items, kind: int) -> tuple[int, Items, Back]:
    """The set after one more row of class `kind`: the cost taken off all items, the items, and where they came from."""
    initial, flaw = divmod(kind, 3)
    best: dict[int, tuple[int, int, str, int]] = {}

    def offer(to: int, cost: int, rank: int, letters: str, origin: int) -> None:
        if to not in best or (cost, rank, letters) < best[to][:3]:
            best[to] = (cost, rank, letters, origin)

    for at, item in enumerate(closed(items)):
        if item is None:
            continue
        cost, rank, letters, origin = item
        offer(at, cost + DELETE, rank, letters + "D", origin)
        if flaw == 2:
            continue
        extra = TRUNCATED if flaw == 1 else 0
        for to, before, terminal in PRODUCTIONS:
            if before != at:
                continue
            if TERMINAL_INITIAL[terminal] == initial:
                offer(to, cost + extra, rank, letters + "K", origin)
            if terminal in FREE:
                offer(to, cost + REROLE + extra, rank, letters + "R", origin)
    low = min(x[0] for x in best.values())
    best = {k: x for k, x in best.items() if x[0] <= low + BEYOND}
    order = {k: n for n, k in enumerate(sorted(best, key=lambda k: best[k][1:3]))}
    after = tuple((best[k][0] - low, order[k]) if k in best else None for k in range(4))
    return low, after, tuple((best[k][3], best[k][2]) if k in best else None for k in range(4))


class Chart:
    """Chart sets met so far and their successors; few, whatever the conversations."""

    def __init__(self) -> None:
        self.known: dict[tuple[Items, int], tuple[int, Items, Back]] = {}

    def run(self, kinds: list[int], items: Items) -> tuple[int, Items, list[Back]]:
        """All rows from the given set: the cost common to all items, the last set, and the way back."""
        total, backs, known = 0, [], self.known
        for kind in kinds:
            step = known.get((items, kind))
            if step is None:
                step = known[items, kind] = scanned(items, kind)
            total += step[0]
            items = step[1]
            backs.append(step[2])
        return total, items, backs


def finish(items: Items) -> tuple[int, int, str]:
    """The cheapest complete parse: its cost, the item it ends in and the letters inserted behind it."""
    done = closed(items)
    cost, _, letters, origin = min(done[k] for k in GOALS if done[k] is not None)
    return cost, origin, letters


def traced(backs: list[Back], at: int) -> tuple[list[str], int]:
    """Each row's letters on the way to item `at`, and the item at the start."""
    out = []
    for back in reversed(backs):
        at, letters = back[at]
        out.append(letters)
    return out[::-1], at


def outputs(letters: str, at: int, role: str | None, text: str | None) -> tuple[int, list[tuple[str, str, str]]]:
    """The rows (role, text, edit) that a row's letters make after item `at`, and the item after them."""
    out = []
    for x in letters:
        if x == "D":
            continue
        if x == "K" and role[:1] == "s":
            at = SYSTEM
            out.append((role, text, x))
            continue
        to, name = (ANSWERED, "assistant") if at == ASKED else (ASKED, "user")
        out.append((name, "", x) if x == "I" else (role if x == "K" else name, text, x))
        at = to
    return at, out


def kind_of(role: str, text: str, repeated: bool) -> int:
    kept = text.rstrip(SPACES)
    flaw = 2 if repeated or not kept else 0 if kept[-1] in ".!?" else 1
    return INITIALS.get(role[:1], 3) * 3 + flaw


class Tally:
    """Counts of a run of rows in order; two of them add up to that of both runs."""

    FIELDS = ("live", "low", "high", "first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal", "head", "tail")

    def __init__(self) -> None:
        self.live = self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = self.first_turn = self.last_turn = self.head = self.tail = None

    def add(self, turn: int | None, role: str, text: str, repeated: bool, kind: int) -> None:
        self.live += 1
        if turn is not None:
            self.turns += turn != self.last_turn
            if self.low is None:
                self.low = self.first_turn = turn
            self.high = self.last_turn = turn
        if kind % 3:
            empty = not text.strip(SPACES)
            self.blank += empty
            self.duplicate += repeated and not empty
            self.truncated += kind % 3 == 1
        self.meet(role[:1])
        self.tail = role[:1]

    def meet(self, initial: str) -> None:
        if self.tail is None:
            self.head = initial
        else:
            self.illegal += self.tail + initial not in ("su", "ua", "au")

    def extend(self, other: "Tally") -> None:
        if not other.live:
            return
        self.turns += other.turns - (other.turns > 0 and self.last_turn is not None and self.last_turn == other.first_turn)
        if other.low is not None:
            self.low = self.first_turn = other.low if self.low is None else self.low
            self.high = self.last_turn = other.high
        for name in ("live", "blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        self.meet(other.head)
        self.tail = other.tail

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_RESULT = [(x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in RESULT.split(", ")]
#: Finished conversations, rows of those that cross partitions (part >= 0), and in row mode the repaired rows.
FIRST = f"absent boolean, conv_id long, {RESULT}, part int, pos long, live boolean, turn long, role string, text string, digest binary, edit string"
_FIRST = [("absent", pa.bool_()), ("conv_id", pa.int64()), *_RESULT, ("part", pa.int32()), ("pos", pa.int64()), ("live", pa.bool_()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("digest", pa.binary()), ("edit", pa.string())]


class Writer:
    """Rows as dictionaries, out in Arrow batches of bounded size."""

    def __init__(self, fields: list[tuple[str, pa.DataType]]) -> None:
        self.schema, self.rows, self.chars = pa.schema(fields), [], 0

    def put(self, **row) -> bool:
        """Whether a batch is due."""
        self.rows.append(row)
        self.chars += len(row.get("text") or "") + len(row.get("audit") or "") + 100
        return self.chars > 1 << 21

    def out(self) -> pa.RecordBatch:
        rows, self.rows, self.chars = self.rows, [], 0
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in self.schema], schema=self.schema)


def digest_of(role: str, text: str) -> bytes:
    a = role.encode()
    return hashlib.sha256(len(a).to_bytes(8, "big") + a + text.encode()).digest()[:16]


def parsed(rows: list[tuple[int | None, str, str]], chart: Chart) -> tuple[dict, list[tuple[str, str, str]]]:
    """A whole conversation's results but for its digest, and its repaired rows."""
    tally, seen, kinds = Tally(), set(), []
    for turn, role, text in rows:
        repeated = (role, text) in seen
        seen.add((role, text))
        kind = kind_of(role, text, repeated)
        kinds.append(kind)
        tally.add(turn, role, text, repeated, kind)
    total, items, backs = chart.run(kinds, start())
    cost, at, behind = finish(items)
    letters, at = traced(backs, at)
    made = []
    for x, (_, role, text) in zip(letters, rows):
        at, out = outputs(x, at, role, text)
        made += out
    made += outputs(behind, at, None, None)[1]
    return {"gaps": tally.gaps(), "blank": tally.blank, "duplicate": tally.duplicate, "truncated": tally.truncated, "illegal": tally.illegal, "cost": total + cost, "audit": "".join(letters) + behind}, made


def first_pass(rows_too: bool) -> Callable[[Batches], Batches]:
    """Sorted rows of a partition: conversations that lie within it are parsed, rows of the others are handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, chart, out = TaskContext.get().partitionId(), Chart(), Writer(_FIRST)
        key, held, chars, opened, pos, seen = None, [], 0, True, 0, False

        def hand_on(rows):
            nonlocal pos
            for turn, role, text, copies in rows:
                for _ in range(max(copies, 1)):
                    if out.put(absent=key[0], conv_id=key[1], part=part, pos=pos, live=copies > 0, turn=turn, role=role if copies else None, text=text if copies else None, digest=digest_of(role, text) if copies else None):
                        yield out.out()
                    pos += 1

        def close():
            found, made = parsed([x[:3] for x in held for _ in range(x[3])], chart)
            absent, conv_id = key
            whole = hashlib.sha256()
            for n, (role, text, edit) in enumerate(made):
                whole.update(f"{chr(10) if n else ''}{role}:{text}".encode())
                if rows_too and out.put(absent=absent, conv_id=conv_id, pos=n, role=role, text=text, edit=edit):
                    yield out.out()
            if out.put(absent=absent, conv_id=conv_id, repaired_sha256=whole.hexdigest(), **found):
                yield out.out()

        for batch in batches:
            for absent, conv, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns)):
                if (absent, conv) != key:
                    if key is not None:
                        yield from hand_on(held) if opened else close()
                    opened, key, held, chars, pos = not seen, (absent, conv), [], 0, 0
                    seen = True
                held.append((turn, role, text, copies))
                chars += len(text)
                opened |= len(held) > HOLD_ROWS or chars > HOLD_CHARS
                if opened:
                    yield from hand_on(held)
                    held, chars = [], 0
        if key is not None:
            yield from hand_on(held)  # the last one may go on in the next partition
        if out.rows:
            yield out.out()

    return run


CELLS = [f"c{i}{j}" for i in range(4) for j in range(4)]
RANKS = [f"r{i}{j}" for i in range(4) for j in range(4)]
_BLOCK = [("absent", pa.bool_()), ("conv_id", pa.int64()), ("part", pa.int32()), *((x, pa.string() if x in ("head", "tail") else pa.int64()) for x in Tally.FIELDS), *((x, pa.int64()) for x in CELLS + RANKS)]


def ddl(fields: list[tuple[str, pa.DataType]]) -> str:
    names = {pa.bool_(): "boolean", pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{n} {names[t]}" for n, t in fields)


def groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows that agree in the first `width` columns, of sorted batches."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:width] != key:
                if key is not None:
                    yield key, rows
                key, rows = row[:width], []
            rows.append(row[width:])
    if key is not None:
        yield key, rows


def block_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (absent, conv_id, part, pos, live, turn, kind, initial, empty, again) of blocks, as a table a block."""
    chart, out = Chart(), Writer(_BLOCK)
    for (absent, conv, part), rows in groups(batches, 3):
        tally, kinds = Tally(), []
        for _, live, turn, kind, initial, empty, again in rows:
            if live:
                kind = kind // 3 * 3 + 2 if again else kind
                kinds.append(kind)
                tally.add(turn, initial, "" if empty else "x", again, kind)
        cells: dict[str, int] = {}
        for i in range(4):
            total, items, _ = chart.run(kinds, start(i))
            for j, x in enumerate(items):
                if x is not None:
                    cells[f"c{i}{j}"], cells[f"r{i}{j}"] = total + x[0], x[1]
        out.put(absent=absent, conv_id=conv, part=part, **{x: getattr(tally, x) for x in Tally.FIELDS}, **cells)
        if len(out.rows) >= 1000:
            yield out.out()
    if out.rows:
        yield out.out()


_PATH = [("absent", pa.bool_()), ("conv_id", pa.int64()), ("part", pa.int32()), ("enters", pa.int32()), ("leaves", pa.int32()), ("behind", pa.string()), *_RESULT[:6]]


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's block tables in order: the items at which its cheapest parse enters and leaves each block.

    The last block's row has the counts, the cost and the letters inserted behind all rows."""
    out = Writer(_PATH)
    names = [x for x, _ in _BLOCK[3:]]
    for (absent, conv), rows in groups(batches, 2):
        items: dict[int, tuple[int, int]] = {NOTHING: (0, 0)}
        tally, backs = Tally(), []
        for part, *values in rows:
            v = dict(zip(names, values))
            other = Tally()
            for x in Tally.FIELDS:
                setattr(other, x, v[x])
            tally.extend(other)
            best: dict[int, tuple[int, int, int, int]] = {}
            for i, (cost, rank) in items.items():
                for j in range(4):
                    if v[f"c{i}{j}"] is not None:
                        offer = (cost + v[f"c{i}{j}"], rank, v[f"r{i}{j}"], i)
                        best[j] = min(best.get(j, offer), offer)
            order = {k: n for n, k in enumerate(sorted(best, key=lambda k: best[k][1:3]))}
            items = {k: (x[0], order[k]) for k, x in best.items()}
            backs.append((part, {k: x[3] for k, x in best.items()}))
        cost, at, behind = finish(tuple(items.get(k) for k in range(4)))
        last = {"behind": behind, "gaps": tally.gaps(), "blank": tally.blank, "duplicate": tally.duplicate, "truncated": tally.truncated, "illegal": tally.illegal, "cost": cost}
        for part, back in reversed(backs):
            out.put(absent=absent, conv_id=conv, part=part, enters=back[at], leaves=at, **last)
            at, last = back[at], {}
        if len(out.rows) >= 1000:
            yield out.out()
    if out.rows:
        yield out.out()


_MADE = [("absent", pa.bool_()), ("conv_id", pa.int64()), ("part", pa.int32()), ("pos", pa.int64()), ("letters", pa.string()), ("at", pa.int32())]


def block_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's letters, and the item before it; rows as for block_tables, with the block's enters and leaves."""
    chart, out = Chart(), Writer(_MADE)
    for (absent, conv, part), rows in groups(batches, 3):
        live = [r for r in rows if r[1]]
        if not live:
            continue
        enters, leaves = live[0][7], live[0][8]
        _, _, backs = chart.run([r[3] // 3 * 3 + 2 if r[6] else r[3] for r in live], start(enters))
        letters, at = traced(backs, leaves)
        for x, r in zip(letters, live):
            if out.put(absent=absent, conv_id=conv, part=part, pos=r[0], letters=x, at=at):
                yield out.out()
            for step in x:
                if step != "D":
                    at = SYSTEM if step == "K" and r[4] == "s" else ANSWERED if at == ASKED else ASKED
    if out.rows:
        yield out.out()


_LONG = [("absent", pa.bool_()), ("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("pos", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]


def streamed(rows_too: bool) -> Callable[[Batches], Batches]:
    """Rows (absent, conv_id, part, pos, letters, at, role, text) in order: the audit and digest of each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, whole, audit, n = Writer(_LONG), None, None, [], 0

        def close():
            return out.put(absent=key[0], conv_id=key[1], audit="".join(audit), repaired_sha256=whole.hexdigest())

        for batch in batches:
            for absent, conv, _, _, letters, at, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (absent, conv) != key:
                    if key is not None and close():
                        yield out.out()
                    key, whole, audit, n = (absent, conv), hashlib.sha256(), [], 0
                audit.append(letters)
                for r, t, edit in outputs(letters, at, role, text)[1]:
                    whole.update(f"{chr(10) if n else ''}{r}:{t}".encode())
                    if rows_too and out.put(absent=absent, conv_id=conv, pos=n, role=r, text=t, edit=edit):
                        yield out.out()
                    n += 1
        if key is not None:
            close()
        if out.rows:
            yield out.out()

    return run


def conversation_rows(df: DataFrame) -> DataFrame:
    """The columns that repair reads; `copies` says how often a row stands (0: it is gone, its conversation stays)."""
    bound_batches(df.sparkSession)
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit(" ")).alias(x) for x in ("role", "text"))
    conv = F.col("conv_id").cast("long")
    return df.select(conv.isNull().alias("absent"), F.coalesce(conv, F.lit(0)).alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text, F.lit(1).alias("copies"))


def damaged(df: DataFrame) -> DataFrame:
    """conversation_rows with faults by crc32 of `conv_id:turn` modulo 20: dropped, emptied, cut off, repeated, all users."""
    conv = F.when(F.col("absent"), F.lit(" ")).otherwise(F.col("conv_id").cast("string"))
    fault = F.crc32(F.concat(conv, F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(fault == 4, F.lit("user")).otherwise(F.col("role"))
    return conversation_rows(df).withColumns({"text": text, "role": role, "copies": F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)})


def repair(rows: DataFrame, rows_too: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(conv_id, counts of faults, cost, audit, digest) for every conversation of conversation_rows or damaged, and
    with rows_too the repaired rows (conv_id, pos, role, text, edit), pos from 0."""
    by = ["absent", "conv_id", F.col("turn").asc_nulls_first(), "role", "hash"]
    spread = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange(partitions_for(rows), *by).sortWithinPartitions(*by, "text")
    first = settle(spread.select("absent", "conv_id", "turn", "role", "text", "copies").mapInArrow(tidy(first_pass(rows_too)), FIRST), "conversations")
    open_rows = first.filter("part >= 0")
    id_col = F.when(F.col("absent"), F.lit(None)).otherwise(F.col("conv_id")).alias("conv_id")

    # Where a row's role and text stand first; then its class, without texts.
    at = ["absent", "conv_id", "part", "pos"]
    firsts = open_rows.filter("live").groupBy("absent", "conv_id", "digest").agg(F.min(F.struct("part", "pos")).alias("s")).select("absent", "conv_id", F.col("s.part").alias("part"), F.col("s.pos").alias("pos"), F.lit(True).alias("is_first"))
    kept = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    initial = F.substring("role", 1, 1)
    flaw = F.when(kept == "", 2).when(kept.isin(".", "!", "?"), 0).otherwise(1)
    kind = F.when(initial == "s", 0).when(initial == "u", 3).when(initial == "a", 6).otherwise(9) + flaw
    marked = open_rows.join(firsts, at, "left").select(*at, "live", "turn", kind.cast("int").alias("kind"), initial.alias("initial"), (kept == "").alias("empty"), F.col("is_first").isNull().alias("again"))
    marked = settle(marked, "conversation-blocks")
    block = ["absent", "conv_id", "part"]
    in_blocks = marked.repartition(*block).sortWithinPartitions(*at)
    tables = in_blocks.mapInArrow(tidy(block_tables), ddl(_BLOCK))
    paths = settle(tables.repartition("absent", "conv_id").sortWithinPartitions(*block).mapInArrow(tidy(chained), ddl(_PATH)), "conversation-paths")
    routed = marked.join(paths.select(*block, "enters", "leaves"), block).repartition(*block).sortWithinPartitions(*at)
    letters = routed.mapInArrow(tidy(block_letters), ddl(_MADE))
    ends = paths.filter("cost is not null").select("absent", "conv_id", (F.col("part") + 1).alias("part"), F.lit(0).cast("long").alias("pos"), F.col("behind").alias("letters"), F.col("leaves").alias("at"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    pieces = letters.join(open_rows.select(*at, "role", "text"), at).select(*at, "letters", "at", "role", "text").unionByName(ends)
    long = settle(pieces.repartition("absent", "conv_id").sortWithinPartitions(*at).mapInArrow(tidy(streamed(rows_too)), ddl(_LONG)), "conversations-long")
    counts = paths.filter("cost is not null").join(long.filter("audit is not null").select("absent", "conv_id", "audit", "repaired_sha256"), ["absent", "conv_id"])
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = first.filter("cost is not null").select(id_col, *columns).unionByName(counts.select(id_col, *columns))
    forget(marked)
    repaired = None
    if rows_too:
        shown = [id_col, "pos", "role", "text", "edit"]
        repaired = first.filter("edit is not null").select(*shown).unionByName(long.filter("edit is not null").select(*shown))
    return found, repaired
