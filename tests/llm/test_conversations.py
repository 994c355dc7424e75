"""Conversation repair against its SQL, exhaustive search and defined edge cases."""

import hashlib
import itertools
import random

import duckdb
import pytest

from sentrella.llm import conversations as C

TABLE = "conv_id long, turn long, role string, text string, audit string, block int"


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR, audit VARCHAR, block INT)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?, ?, ?)", [list(r) for r in rows])
    return {r[0]: r[1:] for r in con.sql(f"SELECT conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 FROM ({C.OP11_SQL})").fetchall()}


def odd_rows():
    rng = random.Random(5)
    text = lambda: rng.choice(["Yes.", "No", "Why not?", "ok \t", "", "\x0b \n", "same text!", "ünï 漢.", "line\nline.", None]) if rng.random() < 0.6 else f"t{rng.randrange(10**6)}."
    role = lambda: rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
    rows = [(c, rng.choice([t, t, t, t + 3, None]), role(), text(), "x", 1) for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(1000, t, ("user", "assistant")[t % 2], f"turn {t}.", "x", 1) for t in range(900)]  # over many blocks
    rows += [(1001, t, role(), text(), "x", 1) for t in range(700)]
    rows += [(None, 1, "user", "no id.", "x", 1), (None, None, None, None, None, None), (1002, 5, "user", "same.", "x", 1), (1002, 5, "user", "same.", "x", 1)]
    rows += [(1003, 1, "user", "long. " * 300_000, "x", 1), (1003, 2, "assistant", "end", "x", 1), (-4, -9, "assistant", "only.", "x", 1)]
    return rows


def test_repair_equals_the_sql_on_odd_rows(spark):
    rows = odd_rows()
    want = by_sql(rows)
    got = C.repair(C.damaged(spark.createDataFrame(rows, TABLE).repartition(5))).collect()
    assert len(got) == len(want) == len({r[0] for r in rows})
    for r in got:
        assert tuple(r[1:]) == (want[r.conv_id][0], *want[r.conv_id][1:5], want[r.conv_id][5], *want[r.conv_id][6:]), r.conv_id
    assert got[0].__fields__ == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert C.repair(C.damaged(spark.createDataFrame([], TABLE))).count() == 0


def test_conversation_of_one_repeated_row_and_one_without_rows(spark):
    dropped = next(c for c in range(1000) if __import__("zlib").crc32(f"{c}:0".encode()) % 20 == 0)
    plain = next(c for c in range(1000) if __import__("zlib").crc32(f"{c}:0".encode()) % 20 > 4)
    rows = [(plain, 0, "user", "Hi.", "x", 1)] * 1000 + [(dropped, 0, "user", "Hi.", "x", 1)]
    got = {r.conv_id: r for r in C.repair(C.damaged(spark.createDataFrame(rows, TABLE))).collect()}
    assert got[plain].duplicate == 999 and got[plain].audit == "K" + "D" * 999 + "I" and got[plain].cost == 999 * 3 + 2
    assert got[dropped].audit == "" and got[dropped].cost == got[dropped].gaps == 0 and got[dropped].repaired_sha256 == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("symbols", ["".join(s) for n in (1, 2, 3) for s in itertools.product("DsuaxSA", repeat=n)][::3] + ["usaau", "DDaDu", "xUsAu"])
def test_least_cost_and_audit_by_exhaustion(symbols):
    """All audits of up to two insertions in a row, whatever their cost."""
    best = None

    def walk(at, state, cost, audit, inserts):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if at == len(symbols) and state in (C.START, C.ASSISTANT):
            best = min(best or (cost, audit), (cost, audit))
        if inserts < 2:
            walk(at, C.STEPS[state, "a" if state == C.USER else "u"], cost + 2, audit + "I", inserts + 1)
        if at < len(symbols):
            s = symbols[at]
            walk(at + 1, state, cost + 3, audit + "D", 0)
            if s != "D":
                if (state, s.lower()) in C.STEPS:
                    walk(at + 1, C.STEPS[state, s.lower()], cost + s.isupper(), audit + "K", 0)
                walk(at + 1, C.STEPS[state, "a" if state == C.USER else "u"], cost + 2 + s.isupper(), audit + "R", 0)

    walk(0, C.START, 0, "", 0)
    plain, ruled = C.Grammar(), C.Grammar([(1, 2), (2, 3), (10, 10), (0, 0), (3, 2)])
    for grammar in (plain, ruled):
        m = C.product(grammar.matrix(symbols), C.inserted())[C.START]
        cost, audit = min((c, str(a)) for c, a in (x for x in (m[C.START], m[C.ASSISTANT]) if x is not None))
        assert (cost, audit) == best


def test_grammar_shortens_strings_and_keeps_what_they_mean(spark):
    rng = random.Random(2)
    strings = ["".join(rng.choice(["ua", "ua", "uaua", "s", "D", "A", "U"]) for _ in range(rng.randrange(1, 60))) for _ in range(200)]
    grammar = C.repair_grammar(spark.createDataFrame([(s, 1 + len(s) % 3) for s in set(strings)], "symbols string, n long"))
    assert 10 < len(grammar.rules) <= C.RULES

    def spelt(symbol):
        return C.TERMINALS[symbol] if symbol < len(C.TERMINALS) else "".join(map(spelt, grammar.rules[symbol - len(C.TERMINALS)]))

    parsed = {s: C.parse(s, grammar.rules) for s in strings}
    assert all("".join(map(spelt, p)) == s for s, p in parsed.items())
    assert sum(map(len, parsed.values())) < 0.6 * sum(map(len, parsed))


def test_repaired_rows_follow_the_pattern(spark, sf):
    out = C.repaired_rows(C.damaged(spark.read.parquet(f"{sf}/conversations.parquet"))).toPandas().sort_values(["conv_id", "block", "place"])
    digests = {r.conv_id: r.repaired_sha256 for r in C.op11_conversation_repair(spark, sf).collect()}
    for conv, rows in out.groupby("conv_id"):
        initials = "".join(r[:1] for r in rows.role)
        assert __import__("re").fullmatch("s?(ua)+", initials)
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in zip(rows.role, rows.text)).encode()).hexdigest() == digests[conv]
