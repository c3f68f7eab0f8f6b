"""Conversation structure repair by one automaton over the endings of all conversations.

A row's symbol says what matters for the repair: its role's initial and its fault. A conversation's signature is the
word of its rows' symbols. Many conversations end alike, so their signatures are read from the end into one automaton in
which equal suffixes share their node: signatures are sorted by their reversal over the cluster, and a task walks its
range with a stack, so that a node is made once and left for good when the order has passed it (a task's first signature
makes its own nodes again). Nodes whose states cost the same relative to each other behave alike from there on and share
one table of best edits. Each node gets, for every state of the grammar of roles, the cost to go and the first edit of
the best audit; a signature's audit is read along its nodes. Conversations meet their audits by signature.

The grammar is `(s?(ua)+)?`. Edits and costs: Keep 0, Rerole to user or assistant 3, Delete 4, Insert an empty user or
assistant row 3; a truncated row that is not deleted costs 3 more; blank and duplicate rows must go. The four edits of
one state have different initials and the state decides which role they give, so of equally cheap audits the least by
ASCII is found edit by edit, and the audit says all about the repair.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from clickweir.llm.packs import give_back
from clickweir.session import scratch

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
EMPTY_HASH = hashlib.sha256(b"").hexdigest()

# States of the grammar: nothing yet, after a system row, after a user row, after an assistant row.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_AFTER = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
_WANTED = {_START: "u", _SYSTEM: "u", _USER: "a", _ASSISTANT: "u"}  # the role of an inserted or changed row
_ROLES = {"u": "user", "a": "assistant"}
_GONE = "x"  # symbol of a row that must be deleted; other symbols are s, u, a or o, in capitals if truncated

Choices = tuple[tuple[str, int], ...]  # by state: the first edit and the state after it


def _with_inserts(base: list[tuple[int, str, int]]) -> tuple[list[int], Choices]:
    """Costs to go and choices of all states, given those of a first edit that takes the row. Two inserts at most help."""
    best = list(base)
    for _ in range(2):
        for state in range(4):
            after = _AFTER[state, _WANTED[state]]
            best[state] = min(best[state], (best[after][0] + INSERT, "I", after))
    return [b[0] for b in best], tuple((b[1], b[2]) for b in best)


_NEVER = 1 << 60
END_COSTS, END_CHOICES = _with_inserts([(0, "", _START), (_NEVER, "", _SYSTEM), (_NEVER, "", _USER), (0, "", _ASSISTANT)])


def _step(symbol: str, costs: tuple[int, ...]) -> tuple[list[int], Choices]:
    """Costs and choices before a row with this symbol, from the costs behind it."""
    role, late = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    base = []
    for state in range(4):
        ways = [(DELETE + costs[state], "D", state)]
        if symbol != _GONE:
            if (state, role) in _AFTER:
                ways.append((KEEP + late + costs[_AFTER[state, role]], "K", _AFTER[state, role]))
            after = _AFTER[state, _WANTED[state]]
            ways.append((REROLE + late + costs[after], "R", after))
        base.append(min(ways))
    return _with_inserts(base)


class Automaton:
    """The nodes of the suffix that is being read, the end first: cost from the start state, and the table of the node's
    class, that is of all nodes with this symbol whose next node has these relative costs. 24 bytes a node."""

    def __init__(self) -> None:
        self.word, self.made = "", 0
        self.costs = array("q", [END_COSTS[_START]])
        self.tables: list[tuple[tuple[int, ...], Choices]] = [(self._relative(END_COSTS), END_CHOICES)]
        self._classes: dict = {}

    @staticmethod
    def _relative(costs: list[int]) -> tuple[int, ...]:
        return tuple(c - costs[_START] for c in costs)

    def read(self, reversed_signature: str) -> tuple[int, str]:
        """Cost and audit of a signature; nodes are shared with the signature read before."""
        shared = _common(self.word, reversed_signature)
        del self.costs[shared + 1:]
        del self.tables[shared + 1:]
        for symbol in reversed_signature[shared:]:
            behind = self.tables[-1][0]
            if (symbol, behind) not in self._classes:
                costs, choices = _step(symbol, behind)
                self._classes[symbol, behind] = costs[_START], (self._relative(costs), choices)
            rise, table = self._classes[symbol, behind]
            self.costs.append(self.costs[-1] + rise)
            self.tables.append(table)
        self.made += len(reversed_signature) - shared
        self.word = reversed_signature
        audit, state, node = [], _START, len(self.tables) - 1
        while node > 0 or self.tables[0][1][state][0]:
            edit, state = self.tables[node][1][state]
            audit.append(edit)
            node -= edit != "I"
        return self.costs[-1], "".join(audit)


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, alive) after damage by crc32(`conv_id:turn`) % 20, nulls read as a space: 0 drops
    a row (alive is false), 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it,
    4 makes its role user. Other columns are left out."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    hit = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    return hit.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") != 0).alias("alive"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _coded(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, again, fault, initial, symbol) of each row, without its text. A row that is not
    alive has a null symbol. Repeats are numbered by `again` over (conv_id, role, digest), which splits long conversations."""
    kept = F.rtrim(F.col("text"), F.lit(SPACE))
    plain = rows.select("conv_id", "turn", "role", "alive", F.md5(F.col("text").cast("binary")).alias("digest"), F.substring("role", 1, 1).alias("initial"),
                        (F.length(kept) == 0).alias("blank"), (~F.right(kept, F.lit(1)).isin(".", "!", "?")).alias("late"))
    first = Window.partitionBy("conv_id", "role", "digest", "alive").orderBy(F.asc_nulls_first("turn"))
    fault = F.when(F.col("blank"), "b").when(F.col("again") > 1, "d").when(F.col("late"), "t").otherwise("")
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(F.col("fault").isin("b", "d"), _GONE).when(F.col("fault") == "t", F.upper(letter)).otherwise(letter)
    return (plain.withColumn("again", F.row_number().over(first)).withColumn("fault", fault)
            .select("conv_id", "turn", "role", "digest", "again", "fault", "initial", F.when(F.col("alive"), symbol).alias("symbol")))


# Nulls first. Rows of a turn lie in order of role and text checksum, so equal rows are next to each other.
_ORDER = ["turn", "role", "digest"]
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


def _key_type(rows: DataFrame) -> str:
    return rows.schema["conv_id"].dataType.simpleString()


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            yield from zip(*[column.to_pylist() for column in batch.slice(lo, 4096).columns])


def _emit(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows, whose last field is a text, as batches of bounded length and size."""
    held, held_size = [], 0
    for row in rows:
        held.append(row)
        held_size += len(row[-1] or "")
        if len(held) >= most or held_size >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, held_size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
    give_back()


def _schema(first: pa.DataType, **rest: pa.DataType) -> pa.Schema:
    return pa.schema([("conv_id", first), *rest.items()])


class _Reading:
    """What is known of a conversation while its rows come in order."""

    def __init__(self) -> None:
        self.word, self.faults, self.illegal, self.initial = bytearray(), {"b": 0, "d": 0, "t": 0}, 0, None
        self.first = self.last = None
        self.turns = 0

    def take(self, turn, fault: str, initial: str, symbol: str) -> None:
        self.word.append(ord(symbol))
        if fault:
            self.faults[fault] += 1
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1

    def counts(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return gaps, *self.faults.values(), self.illegal, self.word.decode()


def _signatures(batches: Iterator[pa.RecordBatch], key: pa.DataType) -> Iterator[pa.RecordBatch]:
    """One row per conversation from rows in order: the counts and the signature, a byte per row."""
    def found() -> Iterator[tuple]:
        conv, reading = None, None
        for conv_id, turn, fault, initial, symbol in _rows_of(batches):
            if reading is None or conv_id != conv:
                if reading is not None:
                    yield conv, *reading.counts()
                conv, reading = conv_id, _Reading()
            if symbol is not None:
                reading.take(turn, fault, initial, symbol)
        if reading is not None:
            yield conv, *reading.counts()

    yield from _emit(found(), _schema(key, **{c: pa.int64() for c in _COUNTS}, signature=pa.string()))


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Automaton()
    rows = ((word[::-1], *automaton.read(word)) for (word,) in _rows_of(batches))
    yield from _emit(rows, pa.schema([("signature", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]), size=1 << 20)


def reports(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, signature, cost, audit) for each conv_id of `rows`
    (conv_id, turn, role, text, alive), null among them. Written once below the shared folder.

    Rows stand in order of turn, nulls first; rows of one turn by role and text. Roles and texts must not be null (see
    damaged()). A row that is not alive only names its conversation; one without living rows has zeros and an empty audit.
    A row is blank without a character that is no white space, else a duplicate if its role and text came before, else
    truncated if its last such character does not end a sentence. `illegal` counts neighbours whose initials are not su,
    ua or au; `gaps` are the turns missing between the first and the last. Only the signature, a byte per row, is held
    of a conversation.
    """
    key_type, key = _key_type(rows), rows.select("conv_id").limit(0).toArrow().schema[0].type
    in_order = _coded(rows).repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER, "again")
    path = scratch(spark, "signatures")
    (in_order.select("conv_id", "turn", "fault", "initial", "symbol")
     .mapInArrow(lambda batches: _signatures(batches, key), f"conv_id {key_type}, {', '.join(f'{c} long' for c in _COUNTS)}, signature string")
     .write.parquet(path))
    known = spark.read.parquet(path)
    words = known.select(F.reverse("signature").alias("word")).distinct().repartitionByRange("word").sortWithinPartitions("word")
    audits = words.mapInArrow(_audits, "signature string, cost long, audit string")
    out = scratch(spark, "audits")
    known.join(audits, "signature").select("conv_id", *_COUNTS, "signature", "cost", "audit").write.parquet(out)
    return spark.read.parquet(out)


def _repairs(batches: Iterator[pa.RecordBatch], key: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The edited rows of conversations in order, each of which is led by a row that bears its audit."""
    def edited() -> Iterator[tuple]:
        conv, audit, at, state, seq = None, "", 0, _START, 0

        def inserts() -> Iterator[tuple]:
            nonlocal at, state, seq
            while at < len(audit) and audit[at] == "I":
                role = _WANTED[state]
                at, state, seq = at + 1, _AFTER[state, role], seq + 1
                yield conv, seq, "I", _ROLES[role], ""

        for conv_id, is_row, role, text in _rows_of(batches):
            if not is_row:
                yield from inserts()
                conv, audit, at, state, seq = conv_id, text, 0, _START, 0
                continue
            yield from inserts()
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            if edit == "R":
                role = _ROLES[_WANTED[state]]
            state, seq = _AFTER[state, role[0]], seq + 1
            yield conv, seq, edit, role, text
        yield from inserts()

    yield from _emit(edited(), _schema(key, seq=pa.int64(), edit=pa.string(), role=pa.string(), text=pa.string()))


def repaired(rows: DataFrame, reported: DataFrame) -> DataFrame:
    """(conv_id, seq, edit, role, text): the rows of all conversations after their cheapest edits, `seq` from 1. `rows`
    as for reports(), `reported` is its result. A task holds whole conversations, in order, of which it keeps only the
    audit at a time. Conversations that keep nothing give no rows."""
    key_type, key = _key_type(rows), rows.select("conv_id").limit(0).toArrow().schema[0].type
    body = rows.where("alive").select("conv_id", F.lit(True).alias("is_row"), "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), "text")
    nothing = F.lit("")
    leads = reported.select("conv_id", F.lit(False), F.lit(None).cast("long"), nothing, nothing, F.col("audit"))
    # One exchange takes rows and audits to the same tasks; a join could be split by key, which would part conversations.
    together = body.unionAll(leads).repartition("conv_id").sortWithinPartitions("conv_id", "is_row", *_ORDER)
    return together.select("conv_id", "is_row", "role", "text").mapInArrow(
        lambda batches: _repairs(batches, key), f"conv_id {key_type}, seq long, edit string, role string, text string")


def _hashes(batches: Iterator[pa.RecordBatch], key: pa.DataType) -> Iterator[pa.RecordBatch]:
    def found() -> Iterator[tuple]:
        conv, digest = None, None
        for conv_id, seq, role, text in _rows_of(batches):
            if seq == 1:
                if digest is not None:
                    yield conv, digest.hexdigest()
                conv, digest = conv_id, hashlib.sha256()
            digest.update(f"{'' if seq == 1 else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        if digest is not None:
            yield conv, digest.hexdigest()

    yield from _emit(found(), _schema(key, repaired_sha256=pa.string()))


def digests(repaired_rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the newline-joined `role:text` of repaired() rows, straight from its result: the
    rows of a conversation must lie together and in order. Long conversations are hashed as they come."""
    key_type, key = _key_type(repaired_rows), repaired_rows.select("conv_id").limit(0).toArrow().schema[0].type
    return (repaired_rows.select("conv_id", "seq", "role", "text")
            .mapInArrow(lambda batches: _hashes(batches, key), f"conv_id {key_type}, repaired_sha256 string"))


def repair(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """reports() of `rows` with the hash of each repaired conversation."""
    reported = reports(spark, rows)
    hashed = digests(repaired(rows, reported)).withColumnRenamed("conv_id", "hashed_id")
    joined = reported.join(hashed, F.col("conv_id").eqNullSafe(F.col("hashed_id")), "left")
    return joined.select("conv_id", *_COUNTS, "cost", "audit", F.coalesce("repaired_sha256", F.lit(EMPTY_HASH)).alias("repaired_sha256"))
