"""Repair of conversations by least-cost edits, with Four-Russians block tables.

A row is one of ten symbols: system, user, assistant or other role, each whole or truncated; one that must go; and
nothing, which fills the last block. A plan of edits leads through four states: nothing kept yet, after a system row,
after a user row, after an assistant row. The cost vector at a place has for each state the least cost of all that
follows. Less its minimum it takes few forms, which are numbered. For every block of BLOCK symbols and every form behind
it, tables say the form before it, what to add to the cost, and to which state each state leads. Blocks are looked up
from the last to the first; then each block is expanded backward into its places' forms, and edits are read forward,
the ASCII-least of those that keep to the least cost: that gives the least of all cheapest plans.

Rows are numbered over the whole table without one task that sees all, and a conversation's symbols lie in chunks of
CHUNK rows. A chunk is a map of forms to forms and of states to states, so a long conversation's chunks are worked on
apart and only their maps meet. Texts move once, to be hashed in a stream, which holds a plan but no texts.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import prefix, store
from .skew import split_join

#: Costs of edits, and of keeping a truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLOCK, CHUNK = 3, 4096
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a row of the role that is due leads to, and that role.
NEXT = (USER, USER, ASSISTANT, USER)
DUE = ("user", "user", "assistant", "user")
#: Symbols: 2 * role + truncated, roles in this order, then other ones; a row that must go; no row.
ROLES, GONE, NOTHING, SYMBOLS = "sua", 8, 9, 10
#: Inserts behind the last row, by state.
_LAST = ("", "II", "I", "")
_SPACE = " \t\n\v\f\r"

Vector = tuple[int, int, int, int]


def _filled(v: list[int]) -> list[int]:
    """Least costs if rows may be inserted first."""
    for _ in range(3):
        v = [min(v[q], INSERT + v[NEXT[q]]) for q in range(4)]
    return v


def _moves(symbol: int, q: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of a row."""
    out = [("D", DELETE, q)]
    if symbol != GONE:
        role, extra = symbol >> 1, TRUNCATED * (symbol & 1)
        if role == 0 and q == START:
            out.append(("K", extra, SYSTEM))
        if role in (1, 2) and NEXT[q] == (USER, ASSISTANT)[role - 1]:
            out.append(("K", extra, NEXT[q]))
        out.append(("R", REROLE + extra, NEXT[q]))
    return out


def _before(symbol: int, after: Vector) -> list[int]:
    if symbol == NOTHING:
        return list(after)
    return _filled([min(c + after[to] for _, c, to in _moves(symbol, q)) for q in range(4)])


def _read(symbol: int, after: Vector, q: int) -> tuple[str, int]:
    """The letters up to and with a row's own, and the state they lead to."""
    if symbol == NOTHING:
        return "", q
    before, letters = _before(symbol, after), ""
    while True:
        edits = _moves(symbol, q)
        good = [(x, to, True) for x, c, to in edits if c + after[to] == before[q]]
        if INSERT + before[NEXT[q]] == before[q]:
            good.append(("I", NEXT[q], False))
        letter, q, done = min(good)
        letters += letter
        if done:
            return letters, q


class Tables:
    """Forms of cost vectors, and what symbols and blocks do with them."""

    def __init__(self):
        end = tuple(_filled([0, 10 * INSERT, 10 * INSERT, 0]))
        forms: list[Vector] = [end]
        known = {end: 0}
        place, added = [], []
        for form in forms:  # grows as forms are found
            place.append([])
            added.append([])
            for symbol in range(SYMBOLS):
                v = _before(symbol, form)
                least = min(v)
                reached = tuple(x - least for x in v)
                if reached not in known:
                    known[reached] = len(forms)
                    forms.append(reached)
                place[-1].append(known[reached])
                added[-1].append(least)
        self.forms = forms
        #: By symbol and form behind it: the form before it, what to add; by state too: letters, and the state reached.
        self.place, self.added = np.array(place).T, np.array(added).T
        read = [[[_read(symbol, form, q) for q in range(4)] for form in forms] for symbol in range(SYMBOLS)]
        self.letters = [[[x[0] for x in row] for row in rows] for rows in read]
        self.state = np.array([[[x[1] for x in row] for row in rows] for rows in read])
        self.block_place, self.block_added, self.block_state = self._blocks()

    def _blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        many = SYMBOLS**BLOCK
        place = np.tile(np.arange(len(self.forms)), (many, 1))
        added = np.zeros_like(place)
        behind = []
        digits = [(np.arange(many) // SYMBOLS ** (BLOCK - 1 - k)) % SYMBOLS for k in range(BLOCK)]
        for k in reversed(range(BLOCK)):
            behind.insert(0, place)
            added = added + self.added[digits[k][:, None], place]
            place = self.place[digits[k][:, None], place]
        state = np.tile(np.arange(4), (many, len(self.forms), 1))
        for k in range(BLOCK):
            state = self.state[digits[k][:, None, None], behind[k][:, :, None], state]
        return place, added, state

    def blocks(self, symbols: np.ndarray) -> np.ndarray:
        filled = np.full(-(-len(symbols) // BLOCK) * BLOCK, NOTHING)
        filled[: len(symbols)] = symbols
        return filled.reshape(-1, BLOCK) @ (SYMBOLS ** np.arange(BLOCK)[::-1])

    def maps(self, symbols: np.ndarray) -> tuple[list[int], list[int], list[int]]:
        """A chunk as maps: by the form behind it the form before it and what to add, and by form and state the state reached."""
        blocks = self.blocks(symbols)
        form, added, behind = np.arange(len(self.forms)), np.zeros(len(self.forms), np.int64), []
        for b in blocks[::-1]:
            behind.append(form)
            added = added + self.block_added[b, form]
            form = self.block_place[b, form]
        state = np.tile(np.arange(4), (len(self.forms), 1))
        for b, forms in zip(blocks, behind[::-1]):
            state = self.block_state[b, forms[:, None], state]
        return form.tolist(), added.tolist(), state.ravel().tolist()

    def plan(self, symbols: np.ndarray, form: int = 0, state: int = START) -> tuple[str, int, int]:
        """The letters of a chunk's edits with `form` behind it, from `state` on; the state reached; the cost but for what is behind."""
        blocks = self.blocks(symbols).tolist()
        behind, cost = [], 0
        for b in reversed(blocks):
            behind.append(form)
            cost += int(self.block_added[b, form])
            form = int(self.block_place[b, form])
        cost += self.forms[form][state]
        letters = []
        for b, after in zip(blocks, reversed(behind)):
            own = [b // SYMBOLS ** (BLOCK - 1 - k) % SYMBOLS for k in range(BLOCK)]
            forms = [after]
            for symbol in own[:0:-1]:
                forms.append(int(self.place[symbol, forms[-1]]))
            for symbol, f in zip(own, reversed(forms)):
                letters.append(self.letters[symbol][f][state])
                state = int(self.state[symbol, f, state])
        return "".join(letters), state, cost


@cache
def tables() -> Tables:
    return Tables()


def damage(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, copy): the rows of df, damaged by a checksum of conversation and turn. Nulls count as one space
    there, in roles and in texts."""
    told = F.concat(*(F.coalesce(x, F.lit(" ")) for x in (F.col(conv_col).cast("string"), F.lit(":"), F.col(turn_col).cast("string"))))
    held = df.select(F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"), (F.crc32(told.cast("binary")) % 20).alias("kind"))
    kind = F.col("kind")
    held = held.where(kind != 0).select("conv", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"), F.sequence(F.lit(0), F.when(kind == 3, 1).otherwise(0)).alias("copies"))
    return held.select("conv", "turn", "role", "text", F.explode("copies").alias("copy"))


def _row_key() -> Column:
    return F.xxhash64("conv", "role", "text")


def symbols(rows: DataFrame) -> DataFrame:
    """(conv, turn, key, copy, at, symbol, fault), stored, for rows (conv, turn, role, text, copy): rows by conversation, turn
    (nulls first), key and copy are numbered by `at`. fault: 1 blank, 2 duplicate, 3 truncated, else 0.

    key is a 64-bit hash of conversation, role and text; rows with one key are the same but for their turn."""
    body = F.expr(f"trim(TRAILING '{_SPACE}' FROM text)")
    mark = F.when(body == "", 1).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    initial = F.left("role", F.lit(1))
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    narrow = store.keep(rows.select("conv", "turn", _row_key().alias("key"), "copy", role.alias("role"), mark.alias("mark"), F.lit(1).alias("one")), "repair-narrow")
    numbered = prefix.running_sum(narrow, ["conv", "turn", "key", "copy"], "one", "at", "repair-numbered").drop("one")
    again = numbered.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.min("at").alias("first")).where("count > 1")
    again = store.keep(again, "repair-again")
    told = split_join(numbered, again.select("key", "first"), "key", ["at"], "left", counts=again.select("key", "count"))
    fault = F.when(F.col("mark") == 1, 1).when(F.col("at") > F.col("first"), 2).otherwise(F.col("mark"))
    told = told.select("conv", "turn", "key", "copy", "at", "role", fault.alias("fault"))
    symbol = F.when(F.col("fault").isin(1, 2), GONE).otherwise(2 * F.col("role") + (F.col("fault") == 3).cast("int"))
    return told.select("conv", "at", symbol.cast("tinyint").alias("symbol"), "fault")


def _own(x: bytes | list) -> np.ndarray:
    return np.array(x, np.int64)


def _plans(batches):
    """A plan for each chunk with what lies behind it and where it starts."""
    t = tables()
    for batch in batches:
        rows = batch.to_pylist()
        found = [t.plan(_own(r["symbols"]), r["form"], r["state"]) for r in rows]
        letters = [x[0] + (_LAST[x[1]] if r["last"] else "") for x, r in zip(found, rows)]
        costs = [x[2] + r["rest"] if r["opens"] else 0 for x, r in zip(found, rows)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "chunk", "blank", "duplicate", "truncated")), pa.array(letters, pa.string()), pa.array(costs, pa.int64())], names=["conv", "chunk", "blank", "duplicate", "truncated", "audit", "cost"])


_PLANS = "conv bigint, chunk bigint, blank bigint, duplicate bigint, truncated bigint, audit string, cost bigint"


def _chunk_maps(batches):
    t = tables()
    for batch in batches:
        found = [t.maps(_own(x)) for x in batch.column("symbols").to_pylist()]
        forms, added, states = (pa.array([x[k] for x in found], pa.list_(pa.int64())) for k in range(3))
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("chunk"), forms, added, states], names=["conv", "chunk", "forms", "added", "states"])


def _meet(table: pa.Table) -> pa.Table:
    """What lies behind each of a conversation's chunks, where it starts, and what it costs with all that follows; from their maps."""
    rows = table.sort_by("chunk").to_pylist()
    behind, form, cost = [], 0, 0
    for r in reversed(rows):
        behind.append((form, cost))
        form, cost = r["forms"][form], cost + r["added"][form]
    behind.reverse()
    starts, state = [], START
    for r, (form, _) in zip(rows, behind):
        starts.append(state)
        state = r["states"][4 * form + state]
    last = len(rows) - 1
    return pa.table({"conv": table.sort_by("chunk").column("conv"), "chunk": pa.array([r["chunk"] for r in rows], pa.int64()), "form": pa.array([b[0] for b in behind], pa.int32()), "state": pa.array(starts, pa.int32()), "rest": pa.array([b[1] for b in behind], pa.int64()), "opens": pa.array([k == 0 for k in range(len(rows))]), "last": pa.array([k == last for k in range(len(rows))])})


def plans(told: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """(conv, chunk, blank, duplicate, truncated, audit, cost) of rows (conv, at, symbol, fault): faults and letters of each
    chunk, the whole cost at a conversation's first one."""
    size = chunk_rows or CHUNK
    own = F.transform(F.array_sort(F.collect_list(F.struct("at", "symbol"))), lambda x: x["symbol"])
    faults = [F.count(F.when(F.col("fault") == k, 1)).alias(name) for k, name in ((1, "blank"), (2, "duplicate"), (3, "truncated"))]
    chunks = store.keep(told.withColumn("chunk", F.floor(F.col("at") / size)).groupBy("conv", "chunk").agg(own.alias("symbols"), *faults), "repair-chunks")
    long = store.keep(chunks.groupBy("conv").count().where("count > 1").select(F.col("conv").alias("long_")), "repair-long")
    same = F.col("conv").eqNullSafe(F.col("long_"))
    single = chunks.join(long, same, "left_anti").select("*", F.lit(0).alias("form"), F.lit(START).alias("state"), F.lit(0).cast("bigint").alias("rest"), F.lit(True).alias("opens"), F.lit(True).alias("last"))
    several = chunks.join(long, same, "left_semi")
    met = several.mapInArrow(_chunk_maps, "conv bigint, chunk bigint, forms array<bigint>, added array<bigint>, states array<bigint>")
    met = met.groupBy("conv").applyInArrow(_meet, "conv bigint, chunk bigint, form int, state int, rest bigint, opens boolean, last boolean")
    met = met.select(F.col("conv").alias("conv_"), F.col("chunk").alias("chunk_"), "form", "state", "rest", "opens", "last")
    several = several.join(met, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("chunk") == F.col("chunk_"))).select(*single.columns)
    ready = store.keep(single.unionByName(several), "repair-ready")
    return ready.mapInArrow(_plans, _PLANS)


class _Open:
    """A conversation whose rows are coming in."""

    def __init__(self, conv: int | None):
        self.conv, self.audit, self.sums = conv, [], [0, 0, 0, 0]
        self.letters, self.at, self.state = "", 0, START
        self.hash, self.begun = hashlib.sha256(), False
        self.turns, self.first, self.last, self.initial, self.illegal = 0, None, None, None, 0

    def put(self, role: str, text: str) -> None:
        self.hash.update(("\n" if self.begun else "").encode() + f"{role}:{text}".encode())
        self.begun = True

    def insert(self) -> None:
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self.put(DUE[self.state], "")
            self.state = NEXT[self.state]
            self.at += 1

    def row(self, turn: int | None, role: str, text: str) -> None:
        if self.audit:
            self.letters, self.audit = "".join(self.audit), []
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        self.insert()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "R":
            self.put(DUE[self.state], text)
            self.state = NEXT[self.state]
        elif letter == "K":
            self.put(role, text)
            self.state = SYSTEM if self.state == START and role[:1] == "s" else NEXT[self.state]

    def close(self) -> tuple:
        self.insert()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        blank, duplicate, truncated, cost = self.sums
        return self.conv, gaps, blank, duplicate, truncated, self.illegal, cost, self.letters, self.hash.hexdigest()


_REPORT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _report(batches):
    """Reports of conversations from their chunks' plans and then their rows, in order."""
    names = [x.split()[0] for x in _REPORT.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in _REPORT.split(", ")]
    now: _Open | None = None

    def out(done: list[tuple]):
        columns = list(zip(*done)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if now is None or r["conv"] != now.conv:
                if now is not None:
                    done.append(now.close())
                now = _Open(r["conv"])
            if r["kind"] == 1:
                now.audit.append(r["text"])
                now.sums = [a + b for a, b in zip(now.sums, r["sums"])]
            elif r["kind"] == 2:
                now.row(r["turn"], r["role"], r["text"])
        yield out(done)
    if now is not None:
        yield out([now.close()])


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of df after
    damage().

    Rows come by turn, nulls first; rows of one turn by a hash of role and text, so copies stay together. A row's first
    fault counts: blank (nothing but spaces), duplicate (role and text seen before), truncated (its last character isn't
    `.`, `!` or `?`). illegal counts neighbours whose roles' initials aren't su, ua or au; gaps are the turns missing
    between the first and the last. audit has the cheapest plan's letters Delete, Insert, Keep, Rerole, the ASCII-least of
    several; it leads to initials `(s?(ua)+)?`. repaired_sha256: of the repaired rows `role:text`, joined by newlines.

    A null in role or text is one space, in conversation or turn it is one space in the checksum; a null conversation
    is one of its own. A conversation without rows after damage has zeros, an empty audit and the hash of nothing. Rows
    that repeat are rows of their own. Conversations and turns are whole numbers. An empty table gives an empty
    result. Other columns are not read. A conversation's texts are hashed by one task, as a hash must be, in a stream.
    """
    spark = df.sparkSession
    store.bound_batches(spark)
    with store.scratch():
        rows = damage(df, conv_col, turn_col, role_col, text_col)
        found = store.keep(plans(symbols(rows)), "repair-plans")
        none = F.lit(None)
        parts = [
            df.select(F.col(conv_col).cast("bigint").alias("conv")).distinct().select("conv", F.lit(0).alias("kind"), none.cast("bigint").alias("turn"), F.lit(0).cast("bigint").alias("key"), F.lit(0).alias("copy"), none.cast("string").alias("role"), none.cast("string").alias("text"), none.cast("array<bigint>").alias("sums")),
            found.select("conv", F.lit(1).alias("kind"), none.cast("bigint").alias("turn"), F.col("chunk").alias("key"), F.lit(0).alias("copy"), none.cast("string").alias("role"), F.col("audit").alias("text"), F.array("blank", "duplicate", "truncated", "cost").alias("sums")),
            rows.select("conv", F.lit(2).alias("kind"), "turn", _row_key().alias("key"), "copy", "role", "text", none.cast("array<bigint>").alias("sums")),
        ]
        told = parts[0].unionByName(parts[1]).unionByName(parts[2]).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "key", "copy")
        return store.keep(told.mapInArrow(_report, _REPORT), "repair-report", outer=True)
