import hashlib
import random
import zlib
from itertools import product

import duckdb

from paddock.llm import repair

WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    """Rows after damage, each conversation's in order."""
    convs = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate:
            text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
            convs[conv] += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    return convs


def legal(roles):
    rest = roles[1:] if roles[:1] == "s" else roles
    return roles == "" or (rest != "" and rest == "ua" * (len(rest) // 2))


def kinds(rows):
    seen, out, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        bare = text.strip(WHITE)
        fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
        out.append("d" if fault in (0, 1) else kind.upper() if fault == 2 else kind)
    return out, counts


def sweep(rows):
    """Left to right, one row after the other: the least (cost, audit, lines) per state of the pattern."""
    step = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    name = {"u": "user", "a": "assistant"}

    def put(to, q, new):
        if q not in to or new < to[q]:
            to[q] = new

    def fill(at):
        for _ in range(3):
            for p, (c, a, lines) in list(at.items()):
                for role in "ua":
                    if p in step[role]:
                        put(at, step[role][p], (c + 5, a + "I", [*lines, name[role] + ":"]))
        return at

    now = fill({0: (0, "", [])})
    for kind, (_, role, text) in zip(kinds(rows)[0], rows):
        new = {}
        for p, (c, a, lines) in now.items():
            put(new, p, (c + 2, a + "D", lines))
            if kind == "d":
                continue
            late = 5 if kind.isupper() else 0
            if kind.lower() in step and p in step[kind.lower()]:
                put(new, step[kind.lower()][p], (c + late, a + "K", [*lines, f"{role}:{text}"]))
            for r in "ua":
                if p in step[r]:
                    put(new, step[r][p], (c + late + 1, a + "R", [*lines, f"{name[r]}:{text}"]))
        now = fill(new)
    return min(now[q] for q in (0, 3) if q in now)


def brute(rows):
    out = []
    for conv, own in damaged(rows).items():
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        _, counts = kinds(own)
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(own, own[1:]))
        cost, audit, lines = sweep(own)
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, convs=250):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Hello there!", "", " \n", "a. b", "Ends well?  \n", None, "é日\U0001f600.", ".", "same", "x" * 3000 + "."]
    rows = []
    for c in range(convs):
        role = rng.choice(["user", "system", "assistant"])
        for t in range(rng.randrange(12)):
            role = {"user": "assistant"}.get(role, "user") if rng.random() < 0.8 else rng.choice(["tool", "", None, "system", "Sam", "ufo", "user"])
            rows.append((c, t + rng.choice([0, 0, 0, 5]), role, rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.randrange(10**6)}."))
    rows += [(c, None, "user", "No turn."), (900, None, None, None), (None, 1, "user", "Nobody."), (None, None, "assistant", "Nobody?")]
    rows += [(901, k, "user" if k % 2 else "assistant", f"Line {k}.") for k in range(300)]
    return rows + [(902, 3, "user", "Copies.")] * 40 + [(903, 3, "user", " ")] * 5


def write(spark, rows, path):
    spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, at int, digest string") \
        .repartition(3).write.parquet(f"{path}/conversations.parquet")


def test_brute_force_and_twin(spark, tmp_path):
    rows = corpus(1)
    write(spark, rows, tmp_path)
    want = brute(rows)
    got = sorted((tuple(r) for r in repair.op11_conversation_repair(spark, str(tmp_path)).collect()), key=repr)
    assert got == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert sorted(con.execute(repair.OP11_SQL).fetchall(), key=repr) == want


def test_segments_meet(spark):
    """The result does not depend on where a conversation is cut."""
    rows = corpus(2, 40)
    df = repair.damage(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    want = [b[:8] for b in brute(rows)]
    for segment in (1, 3, 64):
        reports, repaired = repair.repair(df.repartition(5), segment=segment)
        got = {r["conv_id"]: tuple(r) for r in reports.collect()}
        assert [got.get(b[0], b) for b in want] == want
        hashes = {r["conv_id"]: r["repaired_sha256"] for r in repair.digests(repaired).collect()}
        empty = hashlib.sha256(b"").hexdigest()
        assert [hashes.get(b[0], empty) for b in brute(rows)] == [b[8] for b in brute(rows)]


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hi."), (1, 2, "user", " "), (1, 3, "user", "Why?"), (1, 4, "assistant", "Because.")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    reports, repaired = repair.repair(df)
    assert [(r["role"], r["text"], r["edit"]) for r in repaired.orderBy("position").collect()] == [
        ("user", "Be kind.", "R"), ("assistant", "Hi.", "K"), ("user", "Why?", "K"), ("assistant", "Because.", "K")]
    assert reports.first()["audit"] == "RKDKK"
    empty = spark.createDataFrame([], df.schema)
    assert [x.collect() for x in repair.repair(empty)] == [[], []]


def test_cells_are_those_of_a_full_chart():
    """One split per span gives what all splits give, and enumeration of all edits finds nothing cheaper."""
    rng = random.Random(4)
    for _ in range(60):
        row = [rng.choice("suaxSUAXd") for _ in range(rng.randrange(1, 8))]
        cells = {(k, k + 1): repair.leaf(c) for k, c in enumerate(row)}
        for width in range(2, len(row) + 1):
            for k in range(len(row) - width + 1):
                ways = [repair.combine(cells[k, m], cells[m, k + width]) for m in range(k + 1, k + width)]
                assert all(w == ways[0] for w in ways)
                cells[k, k + width] = ways[0]
        assert repair.parse("".join(row)) == cells[0, len(row)]


def enumerate_edits(row, most=2):
    """All audits with at most ``most`` insertions in a gap."""
    found = []
    gaps = [["".join(g) for n in range(most + 1) for g in product("ua", repeat=n)] for _ in range(len(row) + 1)]
    edits = [[("D", "", 2)] + ([] if k == "d" else [("R", r, 1 + 5 * k.isupper()) for r in "ua"] + ([("K", k.lower(), 5 * k.isupper())] if k.lower() != "x" else []))
             for k in row]
    for some in product(*edits):
        for ins in product(*gaps):
            roles, audit, cost = ins[0], "I" * len(ins[0]), 5 * len(ins[0])
            for (letter, role, c), i in zip(some, ins[1:]):
                roles, audit, cost = roles + role + i, audit + letter + "I" * len(i), cost + c + 5 * len(i)
            if legal(roles):
                found.append((cost, audit))
    return min(found)


def test_enumeration():
    for row in product("suaxUd", repeat=2):
        assert repair.best(repair.parse("".join(row))) == enumerate_edits(row)
    rng = random.Random(6)
    for _ in range(25):
        row = [rng.choice("suaxSUAXd") for _ in range(3)]
        assert repair.best(repair.parse("".join(row))) == enumerate_edits(row)


def test_a_long_conversation():
    kinds = "su" + "aau" * 30000
    cost, audit = repair.best(repair.parse(kinds))
    assert len(audit.replace("I", "")) == len(kinds) and cost == sum({"R": 1, "D": 2, "I": 5, "K": 0}[c] for c in audit)
