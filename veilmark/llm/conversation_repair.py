"""Conversation structure repair with the cheapest audited edits.

The roles' initials of a repaired conversation are ``(s?(ua)+)?``. Rows are kept (``K``, 0), re-roled to user or assistant
(``R``, 2) or deleted (``D``, 3; blank and duplicate rows must be), and empty rows of either role inserted (``I``, 2); a truncated
row that isn't deleted adds 1. Of the cheapest edits those with the ASCII-least initials are taken.

1. Rows are sorted by conversation and turn into ranges, identical rows folded. A task streams its range; a conversation that
   lies inside it is repaired there and then.
2. The repair is a dynamic program over the four states of the pattern. An audit is a node that shares its prefix with others:
   it has a letter, its parent, a rolling hash and its 2^j-th ancestors. Equal costs are told apart by a search for the longest
   common prefix along the ancestors; what hashes call equal is verified letter by letter up to the node that both share.
   After the same rows, audits of equal cost are never prefixes of each other, so the lesser stays the lesser.
3. Conversations that a range begins or ends with, and those of more than ``LONG`` rows, go on to a second sort: each range
   gives the cheapest audits from each state to each, and these are joined in order. Their repaired texts are hashed in a
   stream of the rows, as a digest is made in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.llm.worker import claim
from veilmark.operators.skew import join_counted
from veilmark.scratch import cut

#: Rows of a conversation that are held at once, and bytes of their texts.
LONG, LONG_BYTES = 20_000, 32 << 20
_BLANKS = " \t\n\x0b\x0c\r"
_BASE, _PRIME = 1_000_003, (1 << 61) - 1
#: States: nothing yet, after the system row, after a user row, after an assistant row. Where a user or assistant row leads.
_NEXT = (2, 2, 3, 2)
_ROLE = ("user", "user", "assistant", "user")
_STATES = range(4)
#: What a row may be: its initial where it fits the pattern, whether it must go, whether it is truncated.
Row = tuple[str, bool, bool]


class Audits:
    """Strings of edits as nodes of a tree; node 0 is the empty one."""

    def __init__(self):
        self.parent, self.letter, self.depth, self.hash, self.up = [0], [""], [0], [0], [[0]]

    def add(self, parent: int, letter: str) -> int:
        node, depth = len(self.parent), self.depth[parent] + 1
        self.parent.append(parent)
        self.letter.append(letter)
        self.depth.append(depth)
        self.hash.append((self.hash[parent] * _BASE + ord(letter)) % _PRIME)
        if depth >> len(self.up):
            self.up.append([0] * node)
        at = parent
        for row in self.up:
            row.append(at)
            at = row[at]
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.parent[node]
        return "".join(reversed(out))

    def _lift(self, node: int, steps: int) -> int:
        j = 0
        while steps:
            if steps & 1:
                node = self.up[j][node]
            steps >>= 1
            j += 1
        return node

    def _same(self, x: int, y: int) -> bool:
        """Letter by letter, up to the node that both come from."""
        while x != y:
            if self.letter[x] != self.letter[y]:
                return False
            x, y = self.parent[x], self.parent[y]
        return True

    def less(self, a: int, b: int) -> bool:
        shorter = min(self.depth[a], self.depth[b])
        x, y = self._lift(a, self.depth[a] - shorter), self._lift(b, self.depth[b] - shorter)
        if self.hash[x] == self.hash[y]:
            return self.depth[a] < self.depth[b] if self._same(x, y) else self.text(a) < self.text(b)
        for row in reversed(self.up):
            if self.hash[row[x]] != self.hash[row[y]]:
                x, y = row[x], row[y]
        if not self._same(self.parent[x], self.parent[y]):  # the hashes met by chance
            return self.text(a) < self.text(b)
        return self.letter[x] < self.letter[y]


def _best(audits: Audits, options: list[tuple[int, int, str]]) -> tuple[int, int] | None:
    """Of (cost, audit before, letter) the cheapest, then least."""
    if not options:
        return None
    cost = min(o[0] for o in options)
    nodes = [o[1] if not o[2] else audits.add(o[1], o[2]) for o in options if o[0] == cost]
    node = nodes[0]
    for other in nodes[1:]:
        if audits.less(other, node):
            node = other
    return cost, node


def _inserted(audits: Audits, at: list) -> list:
    """States after rows put in, too."""
    at = list(at)
    for to, sources in ((2, (0, 1, 3)), (3, (2,))):
        options = [(at[s][0] + 2, at[s][1], "I") for s in sources if at[s]]
        at[to] = _best(audits, options + ([(*at[to], "")] if at[to] else []))
    return at


def _stepped(audits: Audits, at: list, row: Row) -> list:
    """States after one more row, from those before it and what is put in."""
    initial, must_go, truncated = row
    at = _inserted(audits, at)
    options: list[list] = [[(at[s][0] + 3, at[s][1], "D")] if at[s] else [] for s in _STATES]
    if not must_go:
        for s in _STATES:
            if at[s]:
                cost, node = at[s]
                options[_NEXT[s]].append((cost + 2 + truncated, node, "R"))
                if initial == _ROLE[s][0]:
                    options[_NEXT[s]].append((cost + truncated, node, "K"))
                elif initial == "s" and s == 0:
                    options[1].append((cost + truncated, node, "K"))
    return [_best(audits, o) for o in options]


def transitions(rows: list[Row], starts: range | tuple[int, ...] = _STATES) -> list[list]:
    """For each start state the cheapest (cost, audit) to each state, or None; nothing is put in after the last row."""
    out = []
    for start in starts:
        audits, at = Audits(), [(0, 0) if s == start else None for s in _STATES]
        for row in rows:
            at = _stepped(audits, at, row)
        out.append([x and (x[0], audits.text(x[1])) for x in at])
    return out


def ended(at: list) -> tuple[int, str]:
    """The cheapest (cost, audit) with rows put in at the end, from each state's (cost, audit)."""
    at = list(at)
    for to, sources in ((2, (0, 1, 3)), (3, (2,))):
        at[to] = min([(at[s][0] + 2, at[s][1] + "I") for s in sources if at[s]] + ([at[to]] if at[to] else []), default=None)
    return min(at[s] for s in (0, 3) if at[s])


class Repaired:
    """The digest of ``role:text`` of a repaired conversation, from its audit and its rows in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.sha, self.some = audit, 0, 0, hashlib.sha256(), False

    def _put(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.some else "") + role + ":" + text).encode())
        self.some = True

    def _insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._put(_ROLE[self.state], "")
            self.state = _NEXT[self.state]
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return
        self._put(_ROLE[self.state] if edit == "R" else role, text)
        self.state = 1 if edit == "K" and role[:1] == "s" else _NEXT[self.state]

    def hexdigest(self) -> str:
        self._insert()
        return self.sha.hexdigest()


class Facts:
    """What is counted of consecutive rows of a conversation, and their classes for the repair."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = self.newest = None
        self.rows: list[Row] = []

    def add(self, turn: int | None, role: str, text: str, first: bool) -> None:
        shown = text.rstrip(_BLANKS)
        cut_off = False
        if not shown:
            self.blank += 1
        elif not first:
            self.duplicate += 1
        elif shown[-1] not in ".!?":
            self.truncated += 1
            cut_off = True
        initial = role[:1]
        self.illegal += self.last is not None and self.last + initial not in ("su", "ua", "au")
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None:
            self.turns += turn != self.newest
            self.low, self.high, self.newest = turn if self.low is None else self.low, turn, turn
        self.rows.append((initial, not shown or not first, cut_off))

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


_DONE = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = [c.split()[0] for c in _DONE.split(", ")]
_LINE = "turn long, role string, text string, times long"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in b.schema.names))


def _rows_out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _whole(schema: pa.Schema):
    """Results of conversations inside a range; rows (done false) of those at its ends and of long ones."""
    nothing = (None,) * len(_NAMES)

    def one(conv, lines: list[tuple]) -> tuple:
        facts, seen = Facts(), set()
        for turn, role, text, times in lines:
            for _ in range(times):
                facts.add(turn, role, text, (role, text) not in seen)
                seen.add((role, text))
        cost, audit = ended(transitions(facts.rows, (0,))[0])
        repaired = Repaired(audit)
        for _, role, text, times in lines:
            for _ in range(times):
                repaired.row(role, text)
        return conv, True, facts.gaps(), facts.blank, facts.duplicate, facts.truncated, facts.illegal, cost, audit, repaired.hexdigest(), None, None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("conversations")
        out: list[tuple] = []
        held: list[tuple] = []
        conv, size, times_held, at_end, later = None, 0, 0, True, False
        rest = lambda: [(conv, False, *nothing, *line) for line in held]
        some = False
        for c, *line in _lines(batches):
            if some and c != conv:
                out += rest() if at_end or later else [one(conv, held)]
                held, size, times_held, at_end, later = [], 0, 0, False, False
            some, conv = True, c
            held.append(tuple(line))
            size, times_held = size + len(line[2]), times_held + line[3]
            if times_held > LONG or size > LONG_BYTES:
                later = True
                out += rest()
                held, size, times_held = [], 0, 0
            if len(out) > 2000:
                yield _rows_out(out, schema)
                out = []
        out += rest()
        yield _rows_out(out, schema)

    return run


_SEGMENT = "part long, rows long, first string, last string, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, costs array<long>, audits array<string>"


def _segments(schema: pa.Schema):
    """For each conversation of a range what a repair needs to know of its rows there, ``LONG`` rows at a time."""
    from pyspark import TaskContext

    def row(conv, part: int, f: Facts) -> tuple:
        flat = [x for line in transitions(f.rows) for x in line]
        return conv, part, len(f.rows), f.first, f.last, f.low, f.high, f.turns, f.blank, f.duplicate, f.truncated, f.illegal, [x and x[0] for x in flat], [x and x[1] for x in flat]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("conversations")
        part, conv, facts = TaskContext.get().partitionId() << 32, None, None
        for c, turn, role, text, times, least in _lines(batches):
            if facts is None or c != conv:
                if facts is not None:
                    yield _rows_out([row(conv, part, facts)], schema)
                conv, facts, part = c, Facts(), part + 1
            first = least is None or least["none"] == 0 and turn is None or least["none"] == 1 and turn == least["turn"]
            for k in range(times):
                facts.add(turn, role, text, first and not k)
                if len(facts.rows) >= LONG:
                    yield _rows_out([row(conv, part, facts)], schema)
                    facts, part = Facts(), part + 1
        if facts is not None:
            yield _rows_out([row(conv, part, facts)], schema)

    return run


def _joined(table: pa.Table) -> pa.Table:
    """One conversation's counts, cost and audit, from its segments."""
    rows = sorted((r for r in table.to_pylist()), key=lambda r: r["part"])
    at: list = [(0, "")] + [None] * 3
    counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    low = high = last = None
    turns = 0
    for r in (r for r in rows if r["rows"]):
        for c in counts:
            counts[c] += r[c]
        counts["illegal"] += last is not None and last + r["first"] not in ("su", "ua", "au")
        last = r["last"]
        if r["low"] is not None:
            turns += r["turns"] - (high == r["low"])
            low, high = r["low"] if low is None else low, r["high"]
        m = [list(zip(r["costs"], r["audits"]))[4 * s : 4 * s + 4] for s in _STATES]
        at = [min(((at[s][0] + m[s][t][0], at[s][1] + m[s][t][1]) for s in _STATES if at[s] and m[s][t][0] is not None), default=None) for t in _STATES]
    cost, audit = ended(at)
    gaps = 0 if low is None else high - low + 1 - turns
    return pa.table({"conv": pa.array([rows[0]["conv"]], table.schema.field("conv").type), "gaps": [gaps], **{c: [v] for c, v in counts.items()}, "cost": [cost], "audit": [audit]})


def _digests(schema: pa.Schema):
    """The digest of each conversation's repaired rows; its audit comes before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("conversations")
        conv, repaired = None, None
        for c, audit, _, role, text, times in _lines(batches):
            if audit is not None:
                if repaired is not None:
                    yield _rows_out([(conv, repaired.hexdigest())], schema)
                conv, repaired = c, Repaired(audit)
                continue
            for _ in range(times):
                repaired.row(role, text)
        if repaired is not None:
            yield _rows_out([(conv, repaired.hexdigest())], schema)

    return run


def _schema(spark, ddl: str) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return ddl, to_arrow_schema(spark.createDataFrame([], ddl).schema)


def repair(rows: DataFrame, times: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    Rows of a conversation go by turn, nulls first; those of one turn by role and text. ``times`` is how often a row is there;
    a conversation with none (0) has zeros, an empty audit and the digest of the empty string. Null roles and texts are one
    space; rows without a conversation's id are one conversation. A role fits by its first character, so an empty one never
    does. The first fault of a row counts: blank, duplicate (role and text seen earlier), truncated (its last character other
    than blanks is none of ``.!?``). Identical rows are folded before they are shuffled into ranges; a conversation of any
    length is repaired range by range, and only its audit and digest, each one value, are made in one task. Other columns are
    left out. An empty table gives no rows."""
    spark = rows.sparkSession
    keys = ["conv", "turn", "role", "text"]
    space = F.lit(" ")
    typed = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, space).alias("role"), F.coalesce(text_col, space).alias("text"), F.coalesce(F.lit(1) if times is None else times, F.lit(1)).cast("long").alias("times"))
    conv = f"conv {typed.schema['conv'].dataType.simpleString()}"
    # identical rows of one map task are sent once
    lines = typed.groupBy(*keys).agg(F.sum("times").alias("times")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ddl, schema = _schema(spark, f"{conv}, done boolean, {_DONE}, {_LINE}")
    first = cut(lines.mapInArrow(_whole(schema), ddl))
    whole = first.where("done").select("conv", *_NAMES)
    rest = first.where("not done").select(*keys, "times")
    # of a role and text that a conversation has at several turns, the first turn counts; nulls come first
    row_key = F.struct("conv", F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256).alias("said"))
    turn = F.struct(F.col("turn").isNotNull().cast("int").alias("none"), "turn")
    keyed = rest.withColumn("_key", row_key)
    repeated = cut(keyed.where("times > 0").groupBy("_key").agg(F.min(turn).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    n = rest.count()
    keyed = join_counted(keyed, repeated, ["_key"], n, "n", "turn").select(*keys, "times", "least")
    ranged = keyed.repartitionByRange(max(1, -(-n // LONG)), *keys).sortWithinPartitions(*keys)
    ddl, schema = _schema(spark, f"{conv}, {_SEGMENT}")
    segments = cut(ranged.mapInArrow(_segments(schema), ddl))
    joined = cut(segments.groupBy("conv").applyInArrow(_joined, f"{conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"))
    # audits before their rows, then one stream
    none = lambda kind: F.lit(None).cast(kind)
    told = joined.select("conv", "audit", none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), none("long").alias("times"))
    said = rest.select("conv", none("string").alias("audit"), *keys[1:], "times")
    stream = told.unionByName(said).repartition("conv").sortWithinPartitions("conv", F.col("audit").asc_nulls_last(), "turn", "role", "text")
    ddl, schema = _schema(spark, f"{conv}, repaired_sha256 string")
    digests = stream.mapInArrow(_digests(schema), ddl)
    late = joined.join(digests.withColumnRenamed("conv", "_conv").hint("merge"), F.col("conv").eqNullSafe(F.col("_conv"))).select("conv", *_NAMES)
    return whole.unionByName(late).withColumnRenamed("conv", conv_col)
