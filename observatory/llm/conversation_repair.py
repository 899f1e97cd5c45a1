"""Repair of conversations whose turns were dropped, blanked, cut, repeated or given to the wrong speaker.

A repaired conversation is an optional system message and then user and
assistant in turn, an assistant last; nothing at all is one too. The cheapest
edits are found from the end: what the rest of a conversation costs is a vector
over four states (nothing yet, after system, after user, after assistant).
Differences within it are bounded, so only some thirty vectors occur, up to a
number added to all. The step of a row is then a table from vector to vector,
and that of every block of four rows is precomputed too (the Four-Russians way):
a conversation is read block by block, backward, each a lookup.

Ties are settled forward: going from the front, the least letter that still
leads to the least cost is the right one, whatever follows. A block keeps only
the vector behind it; its rows' vectors are put back, backward, when its letters
are written, once per block, vector and state that occur.

Blocks compose, so a conversation of any length is cut into segments: each task
sums its segments up as one table (30 vectors, 4 states), the tables of a
conversation's tasks are chained, at most one per task, and every segment is
told the vector behind it and the state before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from observatory.operators.segmented import attach
from observatory.session import materialise

# What edits cost.
DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3
FAR = 1 << 20
SPACES = " \t\n\x0b\x0c\r"
ROLES = "sua"
NAMES = {"u": "user", "a": "assistant"}
START, SYSTEM, USER, ASSISTANT = range(4)
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
INSERTS = (USER, USER, ASSISTANT, USER)
# Symbols: twice the place of the role's initial (3: any other), one more if the text is cut off; and a row that has to go.
GONE, SYMBOLS = 8, 9
BLOCK = 4
SEGMENT_ROWS, SEGMENT_CHARS = 1 << 12, 1 << 22


def closed(cost: list[int]) -> list[int]:
    """Least costs when messages may be inserted first."""
    for _ in range(3):
        cost = [min(c, INSERT + cost[INSERTS[s]]) for s, c in enumerate(cost)]
    return cost


def takes(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """How a row can be taken in a state: letter, cost, state after it."""
    if symbol == GONE:
        return [("D", DELETE, state)]
    role, cut = (*ROLES, "?")[symbol // 2], CUT * (symbol % 2)
    out = [("D", DELETE, state)]
    if (state, role) in KEEPS:
        out.append(("K", cut, KEEPS[state, role]))
    new = next(after for (at, r), after in KEEPS.items() if at == state and r in NAMES)
    return [*out, ("R", REROLE + cut, new)]


def before(symbol: int, cost: list[int]) -> list[int]:
    """Costs before a row from those behind it."""
    return closed([min(c + cost[after] for _, c, after in takes(symbol, s)) for s in range(4)])


class Tables:
    """Vectors by number (0: the end of a conversation), and what symbols and blocks of symbols make of them."""

    def __init__(self) -> None:
        self.vectors = [tuple(closed([0, FAR, FAR, 0]))]
        number, steps = {self.vectors[0]: 0}, []
        for v in self.vectors:  # grows until nothing new comes up
            row = []
            for x in range(SYMBOLS):
                cost = before(x, list(v))
                least = min(cost)
                shape = tuple(c - least for c in cost)
                if shape not in number:
                    number[shape] = len(self.vectors)
                    self.vectors.append(shape)
                row.append((number[shape], least))
            steps.append(row)
        n = len(self.vectors)
        self.n = n
        #: By block length less one: block x vector -> vector, cost; block x vector x state -> state behind.
        self.to = [np.array([[steps[v][x][0] for v in range(n)] for x in range(SYMBOLS)], np.int16)]
        self.cost = [np.array([[steps[v][x][1] for v in range(n)] for x in range(SYMBOLS)], np.int16)]
        self.letters = {(x, v, s): self._trace(x, v, s) for x in range(SYMBOLS) for v in range(n) for s in range(4)}
        self.out = [np.array([[[self.letters[x, v, s][1] for s in range(4)] for v in range(n)] for x in range(SYMBOLS)], np.int8)]
        for _ in range(BLOCK - 1):  # one more symbol in front
            to, cost, out = self.to[-1], self.cost[-1], self.out[-1]
            self.to.append(self.to[0][:, to].reshape(-1, n))
            self.cost.append((self.cost[0][:, to] + cost).reshape(-1, n))
            x, b, v = np.ogrid[:SYMBOLS, :len(to), :n]
            entered = self.out[0][x, to[b, v]]  # state behind the new first symbol
            self.out.append(out[b[..., None], v[..., None], entered].reshape(-1, n, 4))

    def _trace(self, symbol: int, v: int, state: int) -> tuple[str, int]:
        """The ASCII-least cheapest letters up to and with a row, and the state behind it."""
        behind = list(self.vectors[v])
        cost, letters = before(symbol, behind), ""
        while True:
            options = [(letter, c + behind[after], after, True) for letter, c, after in takes(symbol, state)]
            options.append(("I", INSERT + cost[INSERTS[state]], INSERTS[state], False))
            letter, _, state, done = min((o for o in options if o[1] == cost[state]), key=lambda o: o[0])
            letters += letter
            if done:
                return letters, state


@cache
def tables() -> Tables:
    return Tables()


def blocks(symbols: bytes) -> list[tuple[int, int]]:
    """(length, number) of the blocks of a row of symbols; the first is the short one."""
    first = len(symbols) % BLOCK
    cuts = [0, *range(first, len(symbols) + 1, BLOCK)] if first else range(0, len(symbols) + 1, BLOCK)
    out = []
    for start, stop in zip(cuts, list(cuts)[1:], strict=False):
        number = 0
        for x in symbols[start:stop]:
            number = number * SYMBOLS + x
        out.append((stop - start, number))
    return out


@lru_cache(1 << 17)
def expanded(length: int, number: int, v: int, state: int) -> tuple[str, int]:
    """Letters of a block with vector ``v`` behind it, entered in ``state``, and the state behind it."""
    t, symbols = tables(), []
    for _ in range(length):
        number, x = divmod(number, SYMBOLS)
        symbols.append((x, v))  # from the last row to the first
        v = int(t.to[0][x, v])
    letters = ""
    for x, behind in reversed(symbols):
        more, state = t.letters[x, behind, state]
        letters += more
    return letters, state


def solve(symbols: bytes, v: int = 0, state: int = START) -> tuple[int, int, str, int]:
    """Of rows with vector ``v`` behind them, entered in ``state``: vector before them, cost taken off, letters, state behind."""
    t, cut, cost = tables(), blocks(symbols), 0
    behind = []
    for length, number in reversed(cut):
        behind.append(v)
        cost += int(t.cost[length - 1][number, v])
        v = int(t.to[length - 1][number, v])
    letters = []
    for (length, number), b in zip(cut, reversed(behind), strict=True):
        more, state = expanded(length, number, b, state)
        letters.append(more)
    return v, cost, "".join(letters), state


def table_of(symbols: bytes) -> np.ndarray:
    """What rows make of every vector behind them: rows of vector before, cost taken off, and for each state before the state behind."""
    t, cut = tables(), blocks(symbols)
    v, cost, behind = np.arange(t.n), np.zeros(t.n, np.int64), []
    for length, number in reversed(cut):
        behind.append(v)
        cost = cost + t.cost[length - 1][number, v]
        v = t.to[length - 1][number, v]
    states = np.tile(np.arange(4), (t.n, 1))
    for (length, number), b in zip(cut, reversed(behind), strict=True):
        states = t.out[length - 1][number, b[:, None], states]
    return np.column_stack([v, cost, states]).astype(np.int64)


def chained(steps: list[np.ndarray]) -> np.ndarray:
    """The table of several in a row, the first one first."""
    now = table_of(b"")
    for step in reversed(steps):
        v = now[:, 0]
        now = np.column_stack([step[v, 0], step[v, 1] + now[:, 1], now[np.arange(len(now))[:, None], 2 + step[v, 2:]]])
    return now


def told(steps: list[np.ndarray], v: int, state: int) -> tuple[list[tuple[int, int]], int]:
    """(vector behind, state before) of each table in a row with ``v`` behind and ``state`` before them all, and their cost."""
    behind, cost = [], 0
    for step in reversed(steps):
        behind.append(v)
        cost += int(step[v, 1])
        v = int(step[v, 0])
    out = []
    for step, b in zip(steps, reversed(behind), strict=True):
        out.append((b, state))
        state = int(step[b, 2 + state])
    return out, cost + tables().vectors[v][START]


def closing(state: int) -> str:
    """Inserts after the last row."""
    return "I" * (tables().vectors[0][state] // INSERT)


def rewritten(letters: str, state: int, copies: list[int], roles: list[str], texts: list[str]) -> tuple[str, list[str], list[str]]:
    """Audit, roles and texts of rows edited by ``letters``; further copies of a row are deleted behind it."""
    audit, out_roles, out_texts, i = [], [], [], 0
    for letter in letters:
        audit.append(letter)
        if letter == "I":
            state = INSERTS[state]
            out_roles.append("user" if state == USER else "assistant")
            out_texts.append("")
            continue
        if letter != "D":
            if letter == "R":
                state = next(after for (at, r), after in KEEPS.items() if at == state and r in NAMES)
                out_roles.append("user" if state == USER else "assistant")
            else:
                state = KEEPS[state, roles[i][0]]
                out_roles.append(roles[i])
            out_texts.append(texts[i])
        audit.append("D" * (copies[i] - 1))
        i += 1
    return "".join(audit), out_roles, out_texts


_COUNTS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint"
_ENDS = "first_turn bigint, last_turn bigint, first_initial string, last_initial string"
SEGMENT = (
    f"conv_id bigint, task int, segment int, alone boolean, cost bigint, {_COUNTS}, {_ENDS}, audit string, roles array<string>, texts array<string>, "
    "copies array<bigint>, symbols binary, step binary"
)
_TEXTS = pa.list_(pa.string())
_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("task", pa.int32()), ("segment", pa.int32()), ("alone", pa.bool_()), ("cost", pa.int64()),
    ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("turns", pa.int64()),
    ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("first_initial", pa.string()), ("last_initial", pa.string()),
    ("audit", pa.string()), ("roles", _TEXTS), ("texts", _TEXTS), ("copies", pa.list_(pa.int64())), ("symbols", pa.binary()), ("step", pa.binary()),
])


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


class Segment:
    """Rows of one conversation in order, on their way into one row of the table of segments."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.symbols, self.chars = conv_id, bytearray(), 0
        self.copies, self.roles, self.texts = [], [], []
        self.seen = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0}
        self.first_turn = self.last_turn = self.first_initial = self.last_initial = None

    def add(self, turn: int | None, role: str, text: str, copies: int, blank: bool, duplicate: bool, cut: bool) -> None:
        seen, initial = self.seen, role[:1]
        if turn is not None and turn != self.last_turn:
            seen["turns"] += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if self.last_initial is None:
            self.first_initial = initial
        elif not legal(self.last_initial, initial):
            seen["illegal"] += 1
        self.last_initial = initial
        seen["illegal"] += copies - 1
        seen["blank"] += copies if blank else 0
        seen["duplicate"] += 0 if blank else copies if duplicate else copies - 1
        seen["truncated"] += not blank and not duplicate and cut
        self.symbols.append(GONE if blank or duplicate else 2 * (ROLES.find(initial) if initial in ROLES and initial else 3) + cut)
        self.copies.append(copies)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)

    def full(self, rows: int) -> bool:
        return len(self.symbols) >= rows or self.chars >= SEGMENT_CHARS

    def row(self, task: int, number: int, alone: bool) -> dict:
        more = sum(self.copies) - len(self.copies)
        out = {
            "conv_id": self.conv_id, "task": task, "segment": number, "alone": alone, **self.seen, "first_turn": self.first_turn, "last_turn": self.last_turn,
            "first_initial": self.first_initial, "last_initial": self.last_initial, "cost": DELETE * more,
        }
        if not alone:
            step = table_of(bytes(self.symbols)).astype("<i8").tobytes()
            return out | {"roles": self.roles, "texts": self.texts, "copies": self.copies, "symbols": bytes(self.symbols), "step": step}
        v, cost, letters, state = solve(bytes(self.symbols))
        audit, roles, texts = rewritten(letters + closing(state), START, self.copies, self.roles, self.texts)
        return out | {"cost": out["cost"] + cost + tables().vectors[v][START], "audit": audit, "roles": roles, "texts": texts}


def _segments(segment_rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of sorted rows. A conversation in the midst of a task is whole; the first and the last may go on in others."""
    task, number, waiting, size = TaskContext.get().partitionId(), 0, [], 0
    now: Segment | None = None
    part_of_more = True

    def close(alone: bool) -> None:
        nonlocal number, size
        waiting.append(now.row(task, number, alone))
        number, size = number + 1, size + now.chars

    for batch in batches:
        columns = [batch[name].to_pylist() for name in ("conv_id", "turn", "role", "text", "copies", "blank", "duplicate", "cut")]
        for conv_id, *message in zip(*columns, strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    close(not part_of_more)
                    part_of_more = False
                now = Segment(conv_id)
            elif now.full(segment_rows):
                part_of_more = True
                close(False)
                now = Segment(conv_id)
            if message[3]:
                now.add(*message)
        if size >= SEGMENT_CHARS:
            yield pa.RecordBatch.from_pylist(waiting, schema=_ARROW)
            waiting, size = [], 0
    if now is not None:
        close(False)
    if waiting:
        yield pa.RecordBatch.from_pylist(waiting, schema=_ARROW)


def marked(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, copies_col: str | None) -> DataFrame:
    """Different rows of a conversation with their number of copies and their faults, written."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    copies = F.lit(1) if copies_col is None else F.coalesce(F.col(copies_col), F.lit(1))
    rows = df.select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
        F.when(copies > 0, space(role_col)).otherwise("").alias("role"), F.when(copies > 0, space(text_col)).otherwise("").alias("text"), copies.cast("bigint").alias("copies"),
    )
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    body = F.rtrim("text", F.lit(SPACES))
    rows = rows.select("*", (body == "").alias("blank"), (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("cut"), F.sha2("text", 256).alias("digest"))
    rows = materialise(rows, "messages")
    # nulls first, so a turn that is null comes before all others
    spot = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = rows.filter("copies > 0 and not blank").groupBy("conv_id", "role", "digest").agg(F.min(spot).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = materialise(again, "repeated")  # its size tells whether the texts have to move
    rows = attach(rows, again, ["conv_id", "role", "digest"], ["first"])
    later = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(spot)
    return rows.withColumn("duplicate", later & ~F.col("blank"))


def repair(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Repaired conversations as segments: conv_id, task and segment (their order), alone, audit, roles and texts of the repaired messages, and counts; written.

    Messages go by turn, null first, those of one turn by role and digest of the
    text. A null role or text is one space, a null conversation is one too;
    conversation and turn are cast to bigint. Rows that repeat are copies of the
    first, which ``copies_col`` can tell as a number too; with 0 it only says that
    there is such a conversation. Other columns are not read.

    The letters of ``audit``: Keep, Rerole (to user or assistant), Delete, Insert
    (an empty user or assistant message). Of the cheapest the ASCII-least.
    """
    rows = marked(df, conv_col, turn_col, role_col, text_col, copies_col)
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    columns = ("conv_id", "turn", "role", "text", "copies", "blank", "duplicate", "cut")
    found = materialise(rows.select(*columns).mapInArrow(partial(_segments, segment_rows), SEGMENT), "segments")
    whole = found.filter("alone").drop("copies", "symbols", "step")
    return whole.unionByName(_joined(found.filter("not alone")))


def _joined(parts: DataFrame) -> DataFrame:
    """Segments of conversations that are cut, each edited by what it is told of the others."""

    def read(cells: pd.Series) -> list[np.ndarray]:
        return [np.frombuffer(c, "<i8").reshape(-1, 6) for c in cells]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("segment")
        return pdf.head(1).assign(step=[chained(read(pdf["step"])).astype("<i8").tobytes()])[["conv_id", "task", "step"]]

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("task")
        marks, cost = told(read(pdf["step"]), 0, START)
        pdf = pdf.assign(behind=[b for b, _ in marks], entered=[s for _, s in marks], total=0, last=False)
        pdf.iloc[0, pdf.columns.get_loc("total")] = cost
        pdf.iloc[-1, pdf.columns.get_loc("last")] = True
        return pdf[["task", "conv_id", "behind", "entered", "total", "last"]]

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("segment").reset_index(drop=True)
        marks, _ = told(read(pdf["step"]), int(pdf["behind"][0]), int(pdf["entered"][0]))
        pdf = pdf.assign(behind=[b for b, _ in marks], entered=[s for _, s in marks])
        pdf.loc[1:, "total"] = 0
        pdf["last"] = pdf["last"] & (pdf.index == len(pdf) - 1)
        return pdf[["task", "segment", "behind", "entered", "total", "last"]]

    steps = parts.select("conv_id", "task", "segment", "step")
    per_task = steps.groupBy("conv_id", "task").applyInPandas(one, "conv_id bigint, task int, step binary")
    marks = per_task.groupBy("conv_id").applyInPandas(across, "task int, conv_id bigint, behind int, entered int, total bigint, last boolean")
    marks = attach(steps, marks, ["task", "conv_id"], ["behind", "entered", "total", "last"])
    mark = marks.groupBy("conv_id", "task").applyInPandas(within, "task int, segment int, behind int, entered int, total bigint, last boolean")
    wanted = [f.name for f in _ARROW if f.name not in ("copies", "symbols", "step")]
    schema = pa.schema([_ARROW.field(n) for n in wanted])

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                _, _, letters, state = solve(row["symbols"], row["behind"], row["entered"])
                letters += closing(state) if row["last"] else ""
                row["audit"], row["roles"], row["texts"] = rewritten(letters, row["entered"], row["copies"], row["roles"], row["texts"])
                row["cost"] += row["total"]
                out.append({n: row[n] for n in wanted})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    full = parts.join(mark, ["task", "segment"])
    ddl = SEGMENT.split(", copies")[0]
    return materialise(full.mapInArrow(edit, ddl), "joined-segments")


def messages(segments: DataFrame) -> DataFrame:
    """conv_id, task, segment, place, role, text of every repaired message; the middle three are its order."""
    m = F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "m")
    return segments.select("conv_id", "task", "segment", m).select("conv_id", "task", "segment", "place", F.col("m.roles").alias("role"), F.col("m.texts").alias("text"))


def reports(segments: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 (of the ``role:text`` lines).

    The hash of a text can only be taken from front to back, so the lines of a
    conversation that is cut into segments pass through one task, a batch at a
    time; no other conversation does.
    """
    lines = F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda m: F.concat_ws(":", m["roles"], m["texts"])), "\n")
    counts = ["blank", "duplicate", "truncated", "illegal"]
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0).cast("bigint"))
    whole = segments.filter("alone").select("conv_id", gaps.alias("gaps"), *counts, "cost", "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    order = [F.asc_nulls_first("conv_id"), F.asc("task"), F.asc("segment")]
    fields = [pa.field(n, pa.int64()) for n in ("conv_id", "gaps", *counts, "cost")]
    schema = pa.schema([*fields, ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def told_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None

        def finished() -> pa.RecordBatch:
            turns, first, last = now["turns"], now["first_turn"], now["last_turn"]
            row = {n: now[n] for n in ("conv_id", *counts, "cost")}
            row |= {"gaps": 0 if first is None else last - first + 1 - turns, "audit": "".join(now["audits"]), "repaired_sha256": now["hash"].hexdigest()}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or now["conv_id"] != row["conv_id"]:
                    if now is not None:
                        yield finished()
                    now = {"conv_id": row["conv_id"], "cost": 0, "turns": 0, "first_turn": None, "last_turn": None, "initial": None, "audits": [], "hash": hashlib.sha256(), "any": False}
                    now |= dict.fromkeys(counts, 0)
                for n in (*counts, "cost"):
                    now[n] += row[n]
                if row["first_turn"] is not None:
                    now["turns"] += row["turns"] - (now["last_turn"] == row["first_turn"])
                    now["first_turn"] = row["first_turn"] if now["first_turn"] is None else now["first_turn"]
                    now["last_turn"] = row["last_turn"]
                if row["first_initial"] is not None:
                    now["illegal"] += now["initial"] is not None and not legal(now["initial"], row["first_initial"])
                    now["initial"] = row["last_initial"]
                now["audits"].append(row["audit"])
                for role, text in zip(row["roles"], row["texts"], strict=True):
                    now["hash"].update(f"{chr(10) * now['any']}{role}:{text}".encode())
                    now["any"] = True
        if now is not None:
            yield finished()

    cut = segments.filter("not alone").repartition("conv_id").sortWithinPartitions(*order)
    ddl = f"conv_id bigint, gaps bigint, {', '.join(f'{n} bigint' for n in counts)}, cost bigint, audit string, repaired_sha256 string"
    return whole.unionByName(cut.mapInArrow(told_one, ddl))
