"""Conversation structure repair by grammar-compressed dynamic programming.

Every row of a conversation is one symbol of nine: ``D`` (blank or repeated, must go), or its
role's initial s, u, a, x (any other), in capitals where the text is truncated. Edits (keep,
rerole, delete, insert) walk an automaton that accepts ``(s?(ua)+)?``; a symbol is a min-plus
transfer matrix between its four states whose entries are a cost and an audit, the string of
edit initials. Of equal costs the ASCII-least audit is taken. Equal costs over the same rows
never leave one audit a proper prefix of the other, so the least of a product is the product
of the least, and products may be bracketed in any way.

Re-Pair gives one grammar for all conversations: the distinct symbol strings and their counts
are a table, each round counts adjacent pairs in the tasks, and the most frequent pairs that
share no symbol become rules. A rule's matrix is the product of its two sides, with ropes for
audits, evaluated once, bottom-up; only rules (RULES at most) reach the driver. A string is
parsed by the rules and is the product of what is left, so the number of rules changes the
work alone and never a result.

Scale: rows are sorted by ranges of (conversation, turn, role, text), so a conversation with a
large share of all rows lies over many tasks; each cuts its rows in blocks of BLOCK rows or
TEXT characters. Blocks of a conversation are then folded in order by a stream that holds four
costs and the audits' shared tails, and its repaired text is hashed by a stream of blocks. A
digest and an audit of one conversation are sequential by nature; memory is that of its audit.
Repeated rows are counted before any shuffle, and their texts, which no repair keeps, dropped.

Order and odd values: rows go by turn (nulls first), equal turns by role and text. A null text
or role, and in the damage's key a null id or turn, reads as one space. Null ids are one
conversation. Empty texts are blank; very long texts are read whole, a block of their own. An
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrella.llm.common import discard, saved, table

BLOCK, TEXT = 256, 1_000_000
#: Bounds of the grammar: rules, rounds, and the share of all symbols below which a pair is left.
RULES, ROUNDS, RARE = 1024, 24, 1 / 4096
SPACES = " \t\n\x0b\x0c\r"
BLOCKS = "conv_id long, block long, symbols string, initials string, blank long, duplicate long, truncated long, turns array<long>, roles array<string>, texts array<string>"

# ---------------------------------------------------------------- automaton and matrices

#: After nothing, s, u, a; a conversation may end in the first or the last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What may follow: the state after an initial.
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
INSERT, REROLE, DELETE, CUT = 2, 2, 3, 1


class Rope:
    """An audit as a tree of parts, compared without writing it out where parts are shared."""

    __slots__ = ("left", "right", "size")

    def __init__(self, left, right):
        self.left, self.right, self.size = left, right, len(left) + len(right)

    def __len__(self) -> int:
        return self.size

    def parts(self) -> Iterator[str]:
        stack = [self]
        while stack:
            now = stack.pop()
            if isinstance(now, Rope):
                stack += (now.right, now.left)
            elif now:
                yield now

    def __str__(self) -> str:
        return "".join(self.parts())


def joined(a, b):
    """The concatenation; short ones are written out."""
    if not len(a) or not len(b):
        return a if len(a) else b
    return str(a) + str(b) if len(a) + len(b) < 32 else Rope(a, b)


def less(a, b) -> bool:
    """Whether audit a comes before b in ASCII order."""
    while isinstance(a, Rope) and isinstance(b, Rope):  # shared heads and tails are skipped
        if a.left is b.left:
            a, b = a.right, b.right
        elif a.right is b.right and len(a) == len(b):
            a, b = a.left, b.left
        else:
            break
    return a is not b and str(a) < str(b)


def better(x, y) -> bool:
    """Whether entry x = (cost, audit) is to be taken before y (None: no way)."""
    if x is None or y is None:
        return x is not None
    return x[0] < y[0] or x[0] == y[0] and less(x[1], y[1])


Matrix = list  # of four rows of four entries


def product(a: Matrix, b: Matrix) -> Matrix:
    out = [[None] * 4 for _ in range(4)]
    for i in range(4):
        for k in range(4):
            if a[i][k] is None:
                continue
            cost, audit = a[i][k]
            for j in range(4):
                if b[k][j] is not None and (out[i][j] is None or cost + b[k][j][0] <= out[i][j][0]):
                    entry = (cost + b[k][j][0], joined(audit, b[k][j][1]))
                    if better(entry, out[i][j]):
                        out[i][j] = entry
    return out


def inserted() -> Matrix:
    """Any number of inserted rows."""
    out: Matrix = [[(0, "") if i == j else None for j in range(4)] for i in range(4)]
    for i in range(4):
        state, cost, audit = i, 0, ""
        for _ in range(3):
            state = STEPS[state, "a" if state == USER else "u"]
            cost, audit = cost + INSERT, audit + "I"
            if better((cost, audit), out[i][state]):
                out[i][state] = (cost, audit)
    return out


def terminal(symbol: str) -> Matrix:
    """Insertions before a row, and one edit of it."""
    edits: Matrix = [[(DELETE, "D") if i == j else None for j in range(4)] for i in range(4)]
    if symbol != "D":
        cut = CUT if symbol.isupper() else 0
        for state in range(4):
            for role, cost, edit in ((symbol.lower(), cut, "K"), ("u", cut + REROLE, "R"), ("a", cut + REROLE, "R")):
                after = STEPS.get((state, role))
                if after is not None and better((cost, edit), edits[state][after]):
                    edits[state][after] = (cost, edit)
    return product(inserted(), edits)


TERMINALS = "DsuaxSUAX"


def parse(symbols: str, rules: list[tuple[int, int]]) -> list[int]:
    """What is left of a string when the rules have been applied in their order."""
    out = [TERMINALS.index(s) for s in symbols]
    present = set(out)
    for k, (a, b) in enumerate(rules, len(TERMINALS)):
        if a in present and b in present and len(out) > 1:
            done, i = [], 0
            while i < len(out):
                if out[i] == a and i + 1 < len(out) and out[i + 1] == b:
                    done.append(k)
                    i += 2
                else:
                    done.append(out[i])
                    i += 1
            if len(done) < len(out):
                out, present = done, set(done)
    return out


class Grammar:
    """Rules in the order in which they were made; rule k is symbol len(TERMINALS) + k. The
    matrix of a rule is the product of its sides' and is evaluated once."""

    def __init__(self, rules: list[tuple[int, int]] = ()):
        self.rules: list[tuple[int, int]] = []
        self.matrices = [terminal(s) for s in TERMINALS]
        for r in rules:
            self.add(r)
        self.known: dict[str, Matrix] = {}

    def add(self, rule: tuple[int, int]) -> None:
        self.rules.append(rule)
        self.matrices.append(product(self.matrices[rule[0]], self.matrices[rule[1]]))

    def matrix(self, symbols: str) -> Matrix:
        """The matrix of a block; those met before come from a bounded table."""
        if symbols not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            rest = [self.matrices[s] for s in parse(symbols, self.rules)]
            while len(rest) > 1:  # in pairs, so that ropes stay shallow
                rest = [product(*rest[i : i + 2]) if i + 1 < len(rest) else rest[i] for i in range(0, len(rest), 2)]
            self.known[symbols] = rest[0] if rest else [[(0, "") if i == j else None for j in range(4)] for i in range(4)]
        return self.known[symbols]


def repair_grammar(strings: DataFrame, rules: int = RULES, rounds: int = ROUNDS, rare: float = RARE) -> Grammar:
    """The Re-Pair grammar of a table (symbols, n) of distinct strings and their counts."""
    grammar = Grammar()
    for _ in range(rounds):
        made = list(grammar.rules)

        def pairs(batches: Iterator[pa.RecordBatch], made=made) -> Iterator[pa.RecordBatch]:
            counts: dict[tuple[int, int], int] = {}
            for batch in batches:
                for symbols, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    left, last = parse(symbols, made), None
                    for pair in zip(left, left[1:]):
                        if pair == last and pair[0] == pair[1]:  # of a run every other pair
                            last = None
                            continue
                        counts[pair] = counts.get(pair, 0) + n
                        last = pair
            # As many rows as there are pairs of symbols at most.
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in counts], pa.int32()), "b": pa.array([b for _, b in counts], pa.int32()), "n": pa.array(list(counts.values()), pa.int64())})

        counted = strings.select("symbols", "n").mapInArrow(pairs, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
        best = counted.orderBy(F.desc("n"), "a", "b").limit(4 * (len(TERMINALS) + len(made))).collect()
        if not best:
            break
        if not grammar.rules:
            least = max(2, sum(r.n for r in best) * rare)
        used: set[int] = set()
        for r in best:
            if r.n >= least and not {r.a, r.b} & used and len(grammar.rules) < rules:
                used |= {r.a, r.b}
                grammar.add((r.a, r.b))
        if not used:
            break
    return grammar


# ---------------------------------------------------------------- rows, faults and blocks


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: each row by the remainder of its key. A dropped row leaves
    a row without role and text and n = 0, which keeps its conversation known."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.when(fault != 0, F.col("turn").cast("long")).alias("turn"),
        F.when(fault == 4, "user").when(fault != 0, blank("role")).alias("role"), F.when(fault != 0, text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def checked(rows: DataFrame) -> DataFrame:
    """One row for each different row, with n, its first fault and the role's initial. Of rows of
    one role and text the first by turn stands and ``again`` counts those after it."""
    every = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    every = every.withColumn("digest", F.when(F.col("role").isNotNull(), F.sha2(F.concat_ws("\x00", F.length("role"), "role", "text"), 256)))
    # Of texts that occur at more than one turn, which: narrow rows, summed in the map tasks.
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = every.where("role IS NOT NULL").groupBy("conv_id", "digest").agg(F.min(turn).alias("first"), F.count("*").alias("m")).where("m > 1").select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first")
    body = F.rtrim(F.col("text"), F.lit(SPACES))
    both = every.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    later = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(turn)
    blank = body == ""
    cut = ~F.substring(body, -1, 1).isin(".", "!", "?")
    fault = F.when(F.col("n") == 0, "none").when(blank, "blank").when(later, "duplicate").when(cut, "truncated").otherwise("")
    return both.select("conv_id", "turn", "role", "n", fault.alias("fault"), F.when(~blank & ~later, F.col("text")).alias("text"), F.substring("text", 1, 64).alias("head"), F.col("text").alias("whole"))


def _initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else "x"


def cut_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as blocks: symbols, initials, counts, and what a repair may keep."""
    part, made, now = TaskContext.get().partitionId(), 0, None
    kind = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("symbols", pa.string()), ("initials", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])

    def closed() -> pa.RecordBatch:
        nonlocal made, now
        row = now | {"block": part << 33 | made, "symbols": "".join(now["symbols"]), "initials": "".join(now["initials"])}
        row.pop("chars")
        made, now = made + 1, None
        return pa.RecordBatch.from_pylist([row], schema=kind)

    for batch in batches:
        for conv, turn, role, n, fault, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "n", "fault", "text")), strict=True):
            if now is not None and now["conv_id"] != conv:
                yield closed()
            for k in range(max(n, 1)):
                if now is not None and (len(now["symbols"]) >= BLOCK or now["chars"] >= TEXT):
                    yield closed()
                if now is None:
                    now = {"conv_id": conv, "symbols": [], "initials": [], "blank": 0, "duplicate": 0, "truncated": 0, "turns": [], "roles": [], "texts": [], "chars": 0}
                if not n:
                    continue
                what = "duplicate" if k and fault != "blank" else fault
                if what:
                    now[what] += 1
                first = _initial(role)
                gone = what in ("blank", "duplicate")
                now["symbols"].append("D" if gone else first.upper() if what else first)
                now["initials"].append(first)
                if turn is not None and (not now["turns"] or now["turns"][-1] != turn):
                    now["turns"].append(turn)
                now["roles"].append(None if gone else role)
                now["texts"].append(None if gone else text)
                now["chars"] += 0 if gone else len(text) + len(role)
    if now is not None:
        yield closed()


def blocks(rows: DataFrame) -> DataFrame:
    """All rows in order, in blocks numbered in that order, written to the shared folder."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first()]
    ranged = checked(rows).repartitionByRange(n, *order, F.col("head").asc_nulls_first()).sortWithinPartitions(*order, F.col("whole").asc_nulls_first())
    return saved(ranged.select("conv_id", "turn", "role", "n", "fault", "text").mapInArrow(cut_in_blocks, BLOCKS), "conversation-blocks")


# ---------------------------------------------------------------- fold and repair


class Fold:
    """One conversation's blocks in order: counts, and the least ways from the start to each
    state as chains of (audit of the block, way before it), which share their heads."""

    def __init__(self):
        self.ways: list = [(0, None), None, None, None]
        self.blocks: list[int] = []
        self.sums = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.last = self.low = self.high = self.turn = None
        self.turns = 0

    def add(self, block: int, symbols: str, initials: str, turns: list[int], matrix: Matrix, **counts: int) -> None:
        for k, v in counts.items():
            self.sums[k] += v
        row = (self.last or "") + initials
        self.sums["illegal"] += sum(row[i : i + 2] not in ("su", "ua", "au") for i in range(len(row) - 1))
        self.last = row[-1:] or None
        if turns:
            self.turns += len(turns) - (turns[0] == self.turn)
            self.turn = self.high = turns[-1]
            self.low = turns[0] if self.low is None else self.low
        self.blocks.append(block)
        self.ways = self.moved(matrix)

    def moved(self, matrix: Matrix) -> list:
        out: list = [None] * 4
        for i, way in enumerate(self.ways):
            for j in range(4):
                if way is not None and matrix[i][j] is not None:
                    cost, chain = way[0] + matrix[i][j][0], (matrix[i][j][1], i, way[1])
                    if out[j] is None or cost < out[j][0] or cost == out[j][0] and self.before(chain, out[j][1]):
                        out[j] = (cost, chain)
        return out

    @staticmethod
    def before(x, y) -> bool:
        """Compare two chains of equally many blocks: only what follows their shared head."""
        a, b = [], []
        while x is not y:
            a.append(str(x[0]))
            b.append(str(y[0]))
            x, y = x[2], y[2]
        return "".join(reversed(a)) < "".join(reversed(b))

    def ended(self) -> tuple[int, list[tuple[int, str, int]], dict]:
        """The least cost, for each block its audit and the state before it, and the counts."""
        self.ways = self.moved(inserted())
        cost, chain = min((w for w in (self.ways[START], self.ways[ASSISTANT]) if w is not None), key=lambda w: w[0])
        if self.ways[START] is not None and self.ways[ASSISTANT] is not None and self.ways[START][0] == self.ways[ASSISTANT][0]:
            first, second = self.ways[START][1], self.ways[ASSISTANT][1]
            chain = first if self.before(first, second) else second
        audits = []
        while chain is not None:
            audits.append((str(chain[0]), chain[1]))
            chain = chain[2]
        audits.reverse()
        tail = audits.pop()  # insertions after the last block, which are part of it
        path = [(b, a, s) for b, (a, s) in zip(self.blocks, audits, strict=True)]
        path[-1] = (path[-1][0], path[-1][1] + tail[0], path[-1][2])
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return cost, path, self.sums | {"gaps": gaps}


FOLDED = "conv_id long, block long, audit string, state int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def folder(rules: list[tuple[int, int]]):
    """A stream of narrow blocks, sorted by conversation and block, as the edits of each block;
    the first block of a conversation carries its counts and cost."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, now, key = Grammar(rules), None, None
        names = [x.split()[0] for x in FOLDED.split(", ")]
        kinds = pa.schema([(n, pa.string() if n == "audit" else pa.int32() if n == "state" else pa.int64()) for n in names])

        def rows() -> list[dict]:
            cost, path, sums = now.ended()
            return [{"conv_id": key, "block": b, "audit": a, "state": s} | (sums | {"cost": cost} if i == 0 else {}) for i, (b, a, s) in enumerate(path)]

        out: list[dict] = []
        for batch in batches:
            for conv, block, symbols, initials, turns, blank, duplicate, truncated in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "symbols", "initials", "turns", "blank", "duplicate", "truncated")), strict=True):
                if now is None or conv != key:
                    out += rows() if now is not None else []
                    now, key = Fold(), conv
                now.add(block, symbols, initials, turns, grammar.matrix(symbols), blank=blank, duplicate=duplicate, truncated=truncated)
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist(out, schema=kinds)
                    out = []
        out += rows() if now is not None else []
        yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return fold


def edited(audit: str, state: int, roles: list, texts: list) -> Iterator[tuple[str, str]]:
    """The repaired rows of a block."""
    at = 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        if edit == "K":
            role, text = roles[at], texts[at]
        else:
            role, text = ("assistant" if state == USER else "user"), ("" if edit == "I" else texts[at])
        at += edit != "I"
        state = STEPS[state, role[:1]]
        yield role, text


REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A stream sorted by conversation, block and kind (edits before texts) as one row each."""
    names = [x.split()[0] for x in REPAIRED.split(", ")]
    kinds = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names])
    now, digest, audits, edits, some, out = None, hashlib.sha256(), [], None, False, []

    def closed() -> dict:
        return {n: now[n] for n in names[:7]} | {"audit": "".join(audits), "repaired_sha256": digest.hexdigest()}

    for batch in batches:
        for row in batch.to_pylist():
            if row["audit"] is not None:
                if row["cost"] is not None:
                    if now is not None:
                        out.append(closed())
                    now, digest, audits, some = row, hashlib.sha256(), [], False
                audits.append(row["audit"])
                edits = row
                continue
            for role, text in edited(edits["audit"], edits["state"], row["roles"], row["texts"]):
                digest.update(("\n" if some else "").encode() + f"{role}:{text}".encode())
                some = True
        if len(out) >= 1024:
            yield pa.RecordBatch.from_pylist(out, schema=kinds)
            out = []
    if now is not None:
        out.append(closed())
    yield pa.RecordBatch.from_pylist(out, schema=kinds)


def _edits(cut: DataFrame) -> DataFrame:
    strings = saved(cut.groupBy("symbols").agg(F.count("*").alias("n")), "conversation-strings")
    grammar = repair_grammar(strings)
    discard(strings)
    narrow = cut.select("conv_id", "block", "symbols", "initials", "turns", "blank", "duplicate", "truncated")
    return narrow.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(folder(grammar.rules), FOLDED)


def repair(rows: DataFrame) -> DataFrame:
    """Faults, the cheapest repair and its digest for every conversation of (conv_id, turn,
    role, text, n), where n = 0 marks a conversation without rows."""
    cut = blocks(rows)
    edits = _edits(cut)
    lists = "CAST(NULL AS array<string>)"
    both = edits.selectExpr("*", f"{lists} AS roles", f"{lists} AS texts", "0 AS kind").unionByName(cut.selectExpr("conv_id", "block", "roles", "texts", "1 AS kind"), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "block", "kind").drop("kind").mapInArrow(_digests, REPAIRED)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """conv_id, place, role, text of every repaired conversation, for use downstream."""
    cut = blocks(rows)
    both = cut.select("block", "roles", "texts").join(_edits(cut).select("conv_id", "block", "audit", "state"), "block")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                got = list(edited(r["audit"], r["state"], r["roles"], r["texts"]))
                yield pa.RecordBatch.from_pydict({"conv_id": pa.array([r["conv_id"]] * len(got), pa.int64()), "block": pa.array([r["block"]] * len(got), pa.int64()), "place": pa.array(range(len(got)), pa.int64()), "role": pa.array([x for x, _ in got], pa.string()), "text": pa.array([x for _, x in got], pa.string())})

    return both.mapInArrow(each, "conv_id long, block long, place long, role string, text string")


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


#: The same by recursion over the rows, which holds the least (cost, audit) of each state. A step
#: is any insertions and an edit of the row; insertions follow the last row. crc32 goes bit by bit.
OP11_SQL = r"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS r0, coalesce(text, ' ') AS t0, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
keyed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(k, ''), lambda ch: list_transform(range(8), lambda b: (ascii(ch) >> b) & 1::BIGINT)))),
    lambda c, b: xor(c >> 1, 3988292384::BIGINT * (xor(c, b) & 1))), 4294967295::BIGINT) % 20 AS f FROM src),
rows_ AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE r0 END AS role, CASE WHEN f = 1 THEN '' WHEN f = 2 THEN translate(t0, '.!?', '') ELSE t0 END AS text, copy
  FROM keyed JOIN (VALUES (1), (2)) AS c(copy) ON copy = 1 OR f = 3 WHERE f <> 0),
body AS (
  SELECT *, rtrim(text, E' \t\n\x0b\x0c\r') AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, left(role, 1) AS initial FROM rows_),
faults AS (
  SELECT *, CASE WHEN b = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(b, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM body),
moves(a, r, z) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserts(a, z, cost, audit) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 2, 2, 'I'), (1, 3, 4, 'II'), (2, 3, 2, 'I'), (3, 2, 2, 'I')),
edges AS (
  SELECT f.conv_id, f.i, n.a, m.z, n.cost + (CASE WHEN m.r = f.initial THEN 0 ELSE 2 END) + (f.fault = 'truncated')::INT AS cost, n.audit || (CASE WHEN m.r = f.initial THEN 'K' ELSE 'R' END) AS audit
  FROM faults f JOIN inserts n ON true JOIN moves m ON m.a = n.z AND (m.r = f.initial OR m.r <> 's') WHERE f.fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT f.conv_id, f.i, n.a, n.z, n.cost + 3, n.audit || 'D' FROM faults f JOIN inserts n ON true),
lengths AS (SELECT k.conv_id, count(f.i) AS n FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY k.conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, {'cost': 0::BIGINT, 'audit': ''} AS way FROM lengths
  UNION ALL
  SELECT w.conv_id, w.i + 1, e.z, min({'cost': (w.way.cost + e.cost)::BIGINT, 'audit': w.way.audit || e.audit}) FROM walk w JOIN edges e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.a = w.state GROUP BY w.conv_id, w.i, e.z),
best AS (
  SELECT w.conv_id, min({'cost': w.way.cost + n.cost, 'audit': w.way.audit || n.audit}) AS way
  FROM walk w JOIN lengths l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.n = w.i JOIN inserts n ON n.a = w.state AND n.z IN (0, 3) GROUP BY w.conv_id),
steps AS (
  SELECT conv_id, p, substr(way.audit, p, 1) AS edit, length(translate(left(way.audit, p), 'I', '')) AS i, length(translate(left(way.audit, p), 'D', '')) AS place, length(translate(way.audit, 'D', '')) AS size
  FROM best, unnest(range(1, length(way.audit) + 1)) AS u(p)),
repaired AS (
  SELECT s.conv_id, string_agg((CASE WHEN s.edit = 'K' THEN f.role WHEN (s.size - s.place) % 2 = 0 THEN 'assistant' ELSE 'user' END) || ':' || (CASE WHEN s.edit = 'I' THEN '' ELSE f.text END), chr(10) ORDER BY s.p) AS body
  FROM steps s LEFT JOIN faults f ON s.edit <> 'I' AND f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i WHERE s.edit <> 'D' GROUP BY s.conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT l.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
  b.way.cost AS cost, b.way.audit AS audit, sha256(coalesce(r.body, '')) AS repaired_sha256
FROM lengths l JOIN best b ON b.conv_id IS NOT DISTINCT FROM l.conv_id LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM l.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM l.conv_id
"""
