"""Conversation structure repair: the cheapest edits that make a conversation an optional system turn and then pairs of user
and assistant turns.

The rows of a conversation come to their task in the order of turns and are read as symbols: the role's initial, and
whether the row must go (blank, or a repetition) or is truncated. Iterative-deepening A* finds the edits: a depth-first
search that tries Delete, Insert, Keep and Rerole in this order, the order of their letters, under a bound of cost that
grows to the least bound that was exceeded; a table remembers with how much left a state has failed, so that it is not
entered again with no more. As bounds begin at a lower bound of the cost and grow by what is needed, the first path that is
accepted is of the least cost, and of these the least in ASCII.

A lower bound of what is left counts rows that must go, truncated rows (2 each), rows whose role fits nowhere and every
second row of neighbours of one role (1 each).

Conversations of any length are read as a stream: of more than ``piece`` rows, pieces are searched one after the other
from each state that the pieces before reach to each state after, and the cheapest way to each state is carried on with the
hash of its repaired text. No path of a piece is the beginning of another of the same cost, so the least whole is made of
least pieces. A worker holds one piece of rows, of at most
4 million characters or one row, and of the conversation only the letters of its edits. Repetitions in
conversations of up to ``piece`` rows are found in the task, by hash; those of longer ones before, by the first turn of each role
and text, joined by hash. The repaired text's hash is a chain over the whole conversation, which is why its rows meet in one
task at all.

Defined results: a null role or text is one space, so such a text is blank and such a role fits nowhere; an empty role has
no initial and fits nowhere. Rows without a conversation are one conversation. Null turns come first; rows of one turn stand
in the order of role and text. Repeated rows are duplicates. A conversation that has lost all its rows has zeros, no edits
and the hash of nothing. An empty table gives none. Columns other than the four are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: What edits cost, and what a truncated row costs that is not deleted.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 2, 5, 0, 1, 5
#: Of each state (nothing yet, after s, after u, after ua) the initials that may follow and the states that they lead to.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
PIECE = 512
NONE = 1 << 60
WHITE = "\t\n\v\f\r "
PIECE_CHARS = 4 << 20


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32 of `conv_id:turn`, and how many times the row is there (0, 1, 2)."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind, role, text = F.crc32(F.encode(key, "utf-8")) % 20, F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), kind.cast("int").alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", "role", text.alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


# --- the search ------------------------------------------------------------------------------------------------------


def lower_bounds(symbols: str) -> tuple[list[int], list[int]]:
    """What the rows from each place on cost at least: while nothing is written yet, and later."""
    out = []
    for fresh in (True, False):
        h, held = [0] * (len(symbols) + 1), ""
        for i in range(len(symbols) - 1, -1, -1):
            c = symbols[i]
            if c == "-" or c.isupper() or c == "!":
                more = DELETE  # a truncated row that stays costs more, even than one edit beside it
            elif c in "ua":
                more, held = (1, "") if c == held else (0, c)
            else:
                more, held = (0 if c == "s" and fresh else REROLE), ""
            h[i] = h[i + 1] + more
        out.append(h)
    return out[0], out[1]


@lru_cache(maxsize=50_000)
def cheapest(symbols: str, start: int = 0, goals: tuple[int, ...] = ACCEPTS, trailing: bool = True) -> tuple[int, str] | None:
    """Cost and letters of the edits that lead from start to one of the goals, cheapest and then least in ASCII.

    Symbols: the initial of a role that fits, or `x`; in capitals (`!` for x) if the row is truncated; `-` if it must go.
    Without trailing, nothing is inserted after the last row. None if no edits lead there.
    """
    n = len(symbols)
    first, later = lower_bounds(symbols)
    bound = (later if start else first)[0]
    worst = bound + (DELETE + INSERT) * n + 3 * INSERT
    failed: dict[int, int] = {}
    while bound <= worst:
        above = NONE
        # one frame for each letter of the path: place, state, cost so far, what is still to be tried
        stack, letters = [(0, start, 0, None)], []
        while stack:
            i, q, cost, tries = stack.pop()
            if tries is None:
                if i == n and q in goals:
                    return cost, "".join(letters)
                left = bound - cost
                if failed.get(i << 2 | q, -1) >= left:
                    if letters:
                        letters.pop()
                    continue
                failed[i << 2 | q] = left
                tries = iter(_edits(symbols[i] if i < n else "", q, i < n or trailing))
            for letter, price, step, to in tries:
                f = cost + price + (later if to else first)[i + step]
                if f > bound:
                    above = min(above, f)
                    continue
                stack.append((i, q, cost, tries))
                stack.append((i + step, to, cost + price, None))
                letters.append(letter)
                break
            else:
                if letters:
                    letters.pop()
        if above == NONE:
            return None
        bound = above
    return None


@lru_cache(maxsize=1024)
def _edits(symbol: str, q: int, insert: bool) -> tuple[tuple[str, int, int, int], ...]:
    """Letter, cost, rows used and state after it, of the edits that a state allows, in ASCII order."""
    out = []
    if symbol:
        out.append(("D", DELETE, 1, q))
    if insert:
        out += [("I", INSERT, 0, to) for c, to in NEXT[q].items() if c in ROLES]
    if symbol and symbol != "-":
        more = TRUNCATED if symbol.isupper() or symbol == "!" else 0
        out += [("K", KEEP + more, 1, to) for c, to in NEXT[q].items() if c == symbol.lower()]
        out += [("R", REROLE + more, 1, to) for c, to in NEXT[q].items() if c in ROLES]
    return tuple(out)


class Walk:
    """One conversation, read row by row; of each state that is reached the cheapest way there."""

    def __init__(self, piece: int):
        self.piece, self.ways = piece, {0: (0, "", hashlib.sha256(), False)}
        self.rows, self.symbols, self.seen = [], [], set()
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.low = self.high = self.last = None
        self.turns = self.chars = 0

    def add(self, turn: int | None, role: str, text: str, repeats: bool | None) -> None:
        """repeats: whether role and text stood in an earlier turn; None if that is not known yet."""
        initial = role[:1]
        if turn is not None:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.turns += self.last is None or turn != self.last[0]
        same = self.last == (turn, role, text)
        if repeats is None:
            key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
            repeats = key in self.seen
            self.seen.add(key)
        if self.last:
            self.count["illegal"] += self.last[1][:1] + initial not in ("su", "ua", "au")
        self.last = turn, role, text
        if not (written := text.rstrip(WHITE)):
            self.count["blank"] += 1
            symbol = "-"
        elif repeats or same:
            self.count["duplicate"] += 1
            symbol = "-"
        else:
            symbol = initial if initial in ("s", "u", "a") else "x"
            if written[-1] not in ".!?":
                self.count["truncated"] += 1
                symbol = "!" if symbol == "x" else symbol.upper()
        if len(self.rows) >= self.piece or self.chars + len(text) > PIECE_CHARS:
            self.search(False)
        self.chars += len(text)
        self.rows.append((role, text))
        self.symbols.append(symbol)

    def search(self, last: bool) -> None:
        """Carry the ways on through the rows held."""
        symbols, found = "".join(self.symbols), {}
        for q, (cost, letters, _, _) in self.ways.items():
            for goals in (ACCEPTS,) if last else ((g,) for g in range(len(NEXT))):
                way = cheapest(symbols, q, goals, last)
                if way and (goals not in found or (cost + way[0], letters + way[1]) < found[goals][:2]):
                    found[goals] = (cost + way[0], letters + way[1], q, way[1])
        ways = {}
        for goals, (cost, letters, q, edits) in found.items():
            _, _, digest, written = self.ways[q]
            digest = digest.copy()
            for role, text, _ in repaired(self.rows, edits, q):
                digest.update((("\n" if written else "") + f"{role}:{text}").encode())
                written = True
            ways[goals[0]] = (cost, letters, digest, written)
        self.ways, self.rows, self.symbols, self.chars = ways, [], [], 0

    def end(self) -> dict:
        self.search(True)
        cost, letters, digest, _ = min(self.ways.values(), key=lambda w: w[:2])
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return {"gaps": gaps, **self.count, "cost": cost, "audit": letters, "repaired_sha256": digest.hexdigest()}


def repaired(rows: list[tuple[str, str]], edits: str, q: int = 0) -> Iterator[tuple[str, str, str]]:
    """(role, text, letter) of the rows that edits leave or insert, from state q on."""
    at = 0
    for letter in edits:
        role, text = rows[at] if letter != "I" else ("", "")
        at += letter != "I"
        if letter == "D":
            continue
        if letter == "K":
            q = NEXT[q][role[:1]]
        else:
            c = "a" if q == 2 else "u"
            role, q = ROLES[c], NEXT[q][c]
        yield role, text, letter


# --- conversations as tables -----------------------------------------------------------------------------------------


def _in_order(rows: DataFrame, scratch: Scratch, piece: int, copies: str | None) -> DataFrame:
    """The rows of a conversation together and in order, with `repeats` for those of conversations over piece rows."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"), (F.col(copies) if copies else F.lit(1)).cast("int").alias("copies"))
    long = scratch.keep(rows.groupBy("conv_id").agg(F.sum("copies").alias("n")).where(F.col("n") > piece).select(F.col("conv_id").alias("long_id")), "long")
    return _marked(rows, long).repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def _marked(rows: DataFrame, long: DataFrame) -> DataFrame:
    if long.isEmpty():
        return rows.withColumn("repeats", F.lit(None).cast("boolean"))
    here = F.col("conv_id").eqNullSafe(F.col("long_id"))
    turn = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    hashes = [F.xxhash64(F.lit(seed), "role", "text") for seed in (1, 2)]
    rows = rows.withColumns({"h1": hashes[0], "h2": hashes[1]})
    of_long = rows.join(long, here, "left_semi").where("copies > 0")
    first = of_long.groupBy(F.col("conv_id").alias("long_id"), F.col("h1").alias("f1"), F.col("h2").alias("f2")).agg(F.min(turn).alias("first"))
    marked = rows.join(long, here, "left_semi").join(first, here & (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")), "left")
    marked = marked.withColumn("repeats", F.coalesce(turn > F.col("first"), F.lit(False))).select("conv_id", "turn", "role", "text", "copies", "repeats")
    return rows.join(long, here, "left_anti").select("conv_id", "turn", "role", "text", "copies", F.lit(None).cast("boolean").alias("repeats")).unionByName(marked)


def _conversations(batches: Iterator[pa.RecordBatch], piece: int) -> Iterator[tuple[object, Walk]]:
    """Each conversation with its walk, once all its rows are added."""
    held, walk = None, None
    for b in batches:
        for conv, turn, role, text, copies, repeats in zip(*(c.to_pylist() for c in b.columns)):
            if walk is None or conv != held:
                if walk is not None:
                    yield held, walk
                held, walk = conv, Walk(piece)
            for _ in range(copies):
                walk.add(turn, role, text, repeats)
    if walk is not None:
        yield held, walk


def audit(rows: DataFrame, scratch: Scratch, piece: int = PIECE, copies: str | None = "copies") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    rows: conv_id, turn, role, text, and how many times each row is there, if a column tells it.
    """
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    ordered = _in_order(rows, scratch, piece, copies)
    kind = ordered.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for conv, walk in _conversations(batches, piece):
            held.append({"conv_id": conv, **walk.end()})
            if len(held) >= 1000:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("conv_id", to_arrow_type(ordered.schema["conv_id"].dataType)), *((c, pa.int64()) for c in names), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    return ordered.mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in names) + ", audit string, repaired_sha256 string")


def repaired_rows(rows: DataFrame, scratch: Scratch, piece: int = PIECE, copies: str | None = None) -> DataFrame:
    """The repaired conversations themselves: (conv_id, position, role, text, edit) of each row that stays or is inserted.

    The edits of audit() meet the ordered rows again, so a conversation of any length is written as it is read.
    """
    ordered = _in_order(rows, scratch, piece, copies)
    edits = scratch.keep(audit(rows, scratch, piece, copies).select("conv_id", "audit"), "edits")
    kind = ordered.schema["conv_id"].dataType.simpleString()
    # the letters of a conversation come before its rows
    first = edits.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(1).alias("copies"))
    both = first.unionByName(ordered.select("conv_id", F.lit(1).alias("part"), "turn", "role", "text", "copies"))
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", F.asc_nulls_first("turn"), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, q, position, out = iter(""), 0, 0, []

        def insertions(conv) -> Iterator[str]:
            nonlocal q, position
            for letter in letters:
                if letter != "I":
                    yield letter
                    return
                (role, text, _), = repaired([], "I", q)
                q = NEXT[q][role[0]]
                out.append((conv, position, role, text, "Insert"))
                position += 1

        held = None
        for b in batches:
            for conv, part, _, role, text, copies in zip(*(c.to_pylist() for c in b.columns)):
                if part == 0:
                    if held is not None:
                        list(insertions(held[0]))
                    letters, q, position, held = iter(text), 0, 0, (conv,)
                    continue
                for _ in range(copies):
                    letter = next(insertions(conv))
                    for new, same, _ in repaired([(role, text)], letter, q):
                        q = NEXT[q][new[0]]
                        out.append((conv, position, new, same, "Keep" if letter == "K" else "Rerole"))
                        position += 1
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)
                out.clear()
        if held is not None:
            list(insertions(held[0]))
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)

    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("conv_id", to_arrow_type(ordered.schema["conv_id"].dataType)), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
    return both.mapInArrow(run, f"conv_id {kind}, position long, role string, text string, edit string")
