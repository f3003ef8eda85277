"""Conversation structure repair by weighted interval parsing.

A conversation is well formed if its role initials match ``(s?(ua)+)?``. A row is kept (0), given
the role user or assistant (1) or deleted (2, required for blank and duplicate rows); rows without text
are inserted anywhere (5); a truncated row that stays adds 5. Wanted are the cheapest edits, and
among those the ones whose initials (K, R, D, I) come first in ASCII order.

The grammar is in Chomsky normal form: a nonterminal [p q] derives the role initials that lead from
state p to q of that pattern (nothing yet, after s, after u, after a), [p q] -> [p r] [r q] are its rules,
and the edits of a row are its terminals. The chart has a cell per span of rows, with the least (cost,
audit) of each nonterminal. The insertion closure, cheapest insertions that lead from p to q without a row,
is applied on both sides of a single row, which covers every gap. Cells are combined bottom-up by
span length. As a nonterminal names the states at both ends of its span, each way of splitting a span gives the
same cell, so one split per span is enough: the chart holds spans of 1, 2, 4, ... rows, and its size
grows with the rows, not with their square. Keeping the least audit only is right, since two audits of the
same span and cost are never prefixes of one another (a prefix would lack insertions, and so cost).

Spark sorts short rows (a digest in place of the text) by conversation and turn into ranges, so a
conversation of any size is spread over tasks. Each task parses runs of at most ``SEGMENT`` different rows;
the cells of these segments meet per conversation, the audit is dealt back to them, and the
texts join the edits. What meets in one task per conversation are cells, which hold a letter per row
and nonterminal, as the audit itself does. Identical rows are one row with a count before anything is sorted.

Defined results: rows are ordered by turn (nulls first), role, and digest of the text; a null role or text
counts as one space; a null conversation id is a conversation of its own; rows that repeat exactly
are duplicates of the first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.llm.common import bounded_batches, cut, table

SEGMENT = 4096
# What edits cost, white space, and what may end a text.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
WHITE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
LEGAL = {"su", "ua", "au"}

# ------------------------------------------------------------------ the grammar

#: The states of the pattern, and what a role initial does to them.
NONE, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
FINAL = (NONE, ASSISTANT)


def _nonterminals() -> list[tuple[int, int]]:
    reach = {p: {p} for p in range(4)}
    for _ in range(4):
        for p in reach:
            reach[p] |= {step[q] for q in reach[p] for step in STEPS.values() if q in step}
    return [(p, q) for p in sorted(reach) for q in sorted(reach[p])]


SYMBOLS = _nonterminals()
_AT = {s: k for k, s in enumerate(SYMBOLS)}
#: Per symbol [p q], the pairs [p r] [r q].
RULES = [[(_AT[p, r], _AT[r, q]) for r in range(4) if (p, r) in _AT and (r, q) in _AT] for p, q in SYMBOLS]

Cell = tuple  # per symbol: (cost, audit), or None


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two spans side by side."""
    out = []
    for pairs in RULES:
        best = None
        for i, j in pairs:
            x, y = left[i], right[j]
            if x is None or y is None:
                continue
            cost = x[0] + y[0]
            if best is None or cost < best[0]:
                best = (cost, x[1] + y[1])
            elif cost == best[0]:
                best = min(best, (cost, x[1] + y[1]))
        out.append(best)
    return tuple(out)


def _closure() -> Cell:
    """The cheapest insertions of user and assistant rows into an empty span."""
    cell = [((0, "") if p == q else None) for p, q in SYMBOLS]
    for role in "ua":
        for p, q in STEPS[role].items():
            cell[_AT[p, q]] = (INSERT, "I")
    known, cell = None, tuple(cell)
    while cell != known:
        known, cell = cell, combine(cell, cell)
    return cell


GAP = _closure()


@lru_cache(maxsize=None)  # nine kinds of rows
def leaf(kind: str) -> Cell:
    """The cell of one row: ``d`` must go, otherwise its role's initial (x: none of s, u, a), in capitals if truncated."""
    cell: list = [((DELETE, "D") if p == q else None) for p, q in SYMBOLS]
    if kind != "d":
        extra = TRUNCATED if kind.isupper() else 0
        edits = [("R", RENAME, "u"), ("R", RENAME, "a")] + ([("K", 0, kind.lower())] if kind.lower() in STEPS else [])
        for letter, cost, role in edits:
            for p, q in STEPS[role].items():
                new, k = (cost + extra, letter), _AT[p, q]
                cell[k] = new if cell[k] is None else min(cell[k], new)
    return combine(combine(GAP, tuple(cell)), GAP)


def chart(cells: list[Cell]) -> Cell:
    """The cell of all spans side by side, combined bottom-up by span length."""
    while len(cells) > 1:
        cells = [combine(*cells[k:k + 2]) if k + 1 < len(cells) else cells[k] for k in range(0, len(cells), 2)]
    return cells[0] if cells else GAP


@lru_cache(maxsize=20_000)
def _short(kinds: str) -> Cell:
    return chart([leaf(k) for k in kinds])


def parse(kinds: str) -> Cell:
    """The cell of consecutive rows; short spans, which recur, are remembered."""
    return chart([_short(kinds[k:k + 16]) for k in range(0, len(kinds), 16)])


def best(cell: Cell) -> tuple[int, str]:
    """The cheapest edits that leave a well-formed conversation."""
    return min(c for c in (cell[_AT[NONE, q]] for q in FINAL) if c is not None)


def outcome(audit: str, classes: Iterator[str], state: int) -> Iterator[tuple[str, str | None, int]]:
    """Per letter of an audit: (letter, new role or None for the row's own, state after it)."""
    for letter in audit:
        kind = next(classes) if letter != "I" else ""
        role = kind if letter == "K" else "a" if state == USER else "u"
        if letter != "D":
            state = STEPS[role][state]
        yield letter, None if letter in "KD" else {"u": "user", "a": "assistant"}[role], state


# ------------------------------------------------------------------ rows to segments

_ORDER = ["at", "role", "digest"]


def _short_rows(rows: DataFrame) -> DataFrame:
    """Different rows (conv, at, role, digest) with copies, blank, truncated and whether an earlier row says the same."""
    trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
    d = rows.select("conv", "at", "role", F.unhex(F.sha2("text", 256)).alias("digest"), (trimmed == "").alias("blank"),
                    (~F.right(trimmed, F.lit(1)).isin(*ENDS)).alias("truncated"))
    d = d.groupBy("conv", *_ORDER).agg(F.count("*").alias("copies"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))
    first = d.groupBy("conv", "role", "digest").agg(F.min("at").alias("first"))
    return d.join(first, ["conv", "role", "digest"]).withColumn("again", F.col("at") > F.col("first"))


def _segments(rows: DataFrame, conv_type: str, turn_type: str, segment: int) -> DataFrame:
    """Runs of at most ``segment`` different rows of a conversation, in the order of their first rows: counts,
    the chart cell and the rows behind it."""
    out = T.StructType.fromDDL(
        f"conv struct<id:{conv_type}>, first struct<at:struct<turn:{turn_type}>,role:string,digest:binary>, head string, tail string, "
        "blank bigint, duplicate bigint, truncated bigint, illegal bigint, cell array<struct<cost:bigint,audit:string>>, "
        f"rows array<struct<at:struct<turn:{turn_type}>,role:string,digest:binary,copies:bigint,kind:string>>")

    from pyspark.sql.pandas.types import to_arrow_schema
    target = to_arrow_schema(out)

    def close(conv, rows):
        kinds, counts = [], dict.fromkeys("bdt", 0)
        illegal, before = 0, ""
        for r in rows:
            c, role = r["copies"], r["role"][:1]
            fault = "b" if r["blank"] else "d" if r["again"] else "t" if r["truncated"] else ""
            counts["b" if fault == "b" else "d"] += c - (fault in ("", "t"))  # of equal rows, all but the first repeat
            counts["t"] += fault == "t"
            illegal += (c - 1) + (bool(kinds) and before + role not in LEGAL)
            before = role
            kind = role if role in STEPS else "x"
            r["kind"] = "d" if fault in ("b", "d") else kind.upper() if fault else kind
            kinds.append(r["kind"] + "d" * (c - 1))
        cell = [None if x is None else {"cost": x[0], "audit": x[1]} for x in parse("".join(kinds))]
        keep = [{k: r[k] for k in ("at", "role", "digest", "copies", "kind")} for r in rows]
        first = {k: rows[0][k] for k in _ORDER}
        return (conv, first, rows[0]["role"][:1], before, counts["b"], counts["d"], counts["t"], illegal, cell, keep)

    def run(batches):
        now, held, done = None, [], []
        for batch in batches:
            for r in batch.to_pylist():
                conv = r.pop("conv")
                if held and (conv != now or len(held) >= segment):
                    done.append(close(now, held))
                    held = []
                now = conv
                held.append(r)
                if len(done) >= 2000 or sum(len(d[-1]) for d in done[-2:]) >= segment:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*done), target)], schema=target)
                    done = []
        if held:
            done.append(close(now, held))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*done), target)], schema=target)

    short = _short_rows(rows).select("conv", *_ORDER, "copies", "blank", "truncated", "again")
    return short.orderBy("conv", *_ORDER).mapInArrow(run, out)


def _plans(segments: DataFrame, conv_type: str, turn_type: str) -> DataFrame:
    """Per conversation: the counts, the least (cost, audit), and per segment its part of the audit and where it starts."""
    first = f"struct<at:struct<turn:{turn_type}>,role:string,digest:binary>"
    out = T.StructType.fromDDL(f"conv struct<id:{conv_type}>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
                               f"cost bigint, audit string, parts array<struct<first:{first},audit:string,state:int,position:bigint>>")

    from pyspark.sql.pandas.types import to_arrow_schema
    target = to_arrow_schema(out)
    part = F.struct("first", "head", "tail", "blank", "duplicate", "truncated", "illegal", "cell",
                    F.transform("rows", lambda r: r["kind"]).alias("kinds"),
                    F.transform("rows", lambda r: r["copies"]).alias("copies"))

    def solve(conv, parts):
        cell = chart([tuple(None if x is None else (x["cost"], x["audit"]) for x in p["cell"]) for p in parts])
        cost, audit = best(cell)
        illegal = sum(p["illegal"] for p in parts) + sum(x["tail"] + y["head"] not in LEGAL for x, y in zip(parts, parts[1:]))
        at, state, position, dealt = 0, NONE, 0, []
        for k, p in enumerate(parts):
            kinds = "".join(kind + "d" * (c - 1) for kind, c in zip(p["kinds"], p["copies"], strict=True))
            need, end = len(kinds), at
            while need or (end < len(audit) and (k + 1 == len(parts)) and audit[end] == "I"):
                need -= audit[end] != "I"
                end += 1
            own = audit[at:end]
            dealt.append({"first": p["first"], "audit": own, "state": state, "position": position})
            for _, _, state in outcome(own, iter(kinds.lower()), state):
                pass
            position += len(own) - own.count("D")
            at = end
        return (conv, *(sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated")), illegal, cost, audit, dealt)

    def run(batches):
        for batch in batches:
            rows = [solve(r["conv"], r["parts"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), target)] if rows
                                             else [pa.array([], f.type) for f in target], schema=target)

    return segments.groupBy("conv").agg(F.sort_array(F.collect_list(part)).alias("parts")).mapInArrow(run, out)


def _edits(plans: DataFrame, segments: DataFrame, conv_type: str, turn_type: str) -> DataFrame:
    """The rows of the repaired conversations without texts: (conv, position, edit, new_role, and the row's key)."""
    out = T.StructType.fromDDL(f"conv struct<id:{conv_type}>, position bigint, edit string, new_role string, "
                               f"at struct<turn:{turn_type}>, role string, digest binary")

    from pyspark.sql.pandas.types import to_arrow_schema
    target = to_arrow_schema(out)
    dealt = plans.select("conv", F.inline("parts"))

    def run(batches):
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                kinds = "".join(x["kind"] + "d" * (x["copies"] - 1) for x in r["rows"])
                source = (x if c == 0 else None for x in r["rows"] for c in range(x["copies"]))
                position = r["position"]
                for letter, role, _ in outcome(r["audit"], iter(kinds.lower()), r["state"]):
                    row = next(source) if letter != "I" else None
                    if letter == "D":
                        continue
                    key = (row["at"], row["role"], row["digest"]) if row else (None, None, None)
                    done.append((r["conv"], position, letter, role, *key))
                    position += 1
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], f.type) for k, f in enumerate(target)], schema=target)

    return dealt.join(segments.select("conv", "first", "rows"), ["conv", "first"]).drop("first").mapInArrow(run, out)


# ------------------------------------------------------------------ the operator

def repair(rows: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """Two tables of the conversations in ``rows`` (conv_id, turn, role, text).

    Reports, one row per conversation: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit).
    Repaired conversations, one row per message: (conv_id, position, role, text, edit)."""
    bounded_batches(rows.sparkSession)
    types = dict(rows.dtypes)
    kinds = types["conv_id"], types["turn"]
    # in structs nulls are values: they are equal, and come first
    rows = rows.select(F.struct(F.col("conv_id").alias("id")).alias("conv"), F.struct("turn").alias("at"),
                       F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    segments = cut(_segments(rows, *kinds, segment), "segments")
    plans = cut(_plans(segments, *kinds), "plans")
    edits = _edits(plans, segments, *kinds)
    texts = (rows.groupBy("conv", "at", "role", F.unhex(F.sha2("text", 256)).alias("digest")).agg(F.first("text").alias("text")))
    repaired = edits.join(texts, ["conv", *_ORDER], "left").select(
        F.col("conv.id").alias("conv_id"), "position", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit")
    turn = F.col("at.turn")
    gaps = segments.select("conv", F.explode("rows.at").alias("at")).groupBy("conv").agg(F.coalesce(
        F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).cast("long").alias("gaps"))
    reports = gaps.join(plans.drop("parts"), "conv").select(
        F.col("conv.id").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return reports, repaired


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the lines ``role:text`` of a conversation, hashed as they stream by."""
    kind = dict(repaired.dtypes)["conv_id"]
    out = T.StructType.fromDDL(f"conv struct<id:{kind}>, repaired_sha256 string")

    from pyspark.sql.pandas.types import to_arrow_schema
    target = to_arrow_schema(out)
    lines = (repaired.select(F.struct(F.col("conv_id").alias("id")).alias("conv"), "position", F.concat("role", F.lit(":"), "text").alias("line"))
             .repartition("conv").sortWithinPartitions("conv", "position").select("conv", "line"))

    def run(batches):
        now, h = None, None
        for batch in batches:
            done = []
            for conv, line in zip(batch.column(0).field(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if h is not None and conv == now:
                    h.update(b"\n")
                else:
                    if h is not None:
                        done.append(({"id": now}, h.hexdigest()))
                    now, h = conv, hashlib.sha256()
                h.update(line.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], f.type) for k, f in enumerate(target)], schema=target)
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([{"id": now}], target[0].type), pa.array([h.hexdigest()])], schema=target)

    return lines.mapInArrow(run, out).select(F.col("conv.id").alias("conv_id"), "repaired_sha256")


def damage(rows: DataFrame) -> DataFrame:
    """Rows with faults, dealt by CRC-32 of ``conv_id:turn`` modulo 20: 0 goes, 1 loses its text, 2 its
    sentence ends, 3 comes twice, 4 says user. Nulls become one space."""
    def word(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(word("text"), ENDS, "")).otherwise(word("text"))
    return rows.where(fate != 0).select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(word("role")).alias("role"), text.alias("text"),
        F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("col")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "conversations")
    reports, repaired = repair(damage(source))
    name = F.struct("conv_id").alias("conv")  # equal for nulls
    out = (source.select(name).distinct()
           .join(reports.select(name, *reports.columns[1:]), "conv", "left")
           .join(digests(repaired).select(name, "repaired_sha256"), "conv", "left"))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv.conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _sql_add(z: str, cost: str, letters: str) -> str:
    """A candidate, the cost in nine digits and the audit, with more of both; null stays null."""
    return f"lpad(CAST(CAST({z}[1:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || {z}[10:] || '{letters}'"


def _sql_row() -> str:
    """Candidates of the four states (z0 none, z1 system, z2 user, z3 assistant) after a row's edit."""
    stays = {q: [] for q in range(4)}
    for role, step in STEPS.items():
        for p, q in step.items():
            stays[q].append(f"CASE WHEN NOT must AND head = '{role}' THEN {_sql_add(f'z{p}', 'late', 'K')} END")
            if role != "s":
                stays[q].append(f"CASE WHEN NOT must THEN {_sql_add(f'z{p}', f'late + {RENAME}', 'R')} END")
    return ", ".join(f"least({', '.join([_sql_add(f'z{q}', str(DELETE), 'D'), *stays[q]])}) AS t{q}" for q in range(4))


def _sql_closure(t: str) -> str:
    one, two = (lambda p: _sql_add(f"{t}{p}", str(INSERT), "I")), (lambda p: _sql_add(f"{t}{p}", str(2 * INSERT), "II"))
    return (f"{t}0 AS z0, {t}1 AS z1, least({t}2, {one(0)}, {one(1)}, {one(3)}) AS z2, "
            f"least({t}3, {one(2)}, {two(0)}, {two(1)}) AS z3")


OP11_SQL = f"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, flatten(list_transform(
      string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
      lambda ch: [CAST(ord(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384)), 4294967295) % 20 AS fate FROM conversations),
dam AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE fate WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM src WHERE fate <> 0),
num AS (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM dam),
fault AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))[-1] NOT IN ('.', '!', '?') AS cut,
    role[1] AS head, coalesce(lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] NOT IN ('su', 'ua', 'au'), false) AS odd FROM num),
r AS (SELECT *, blank OR again AS must, CASE WHEN cut THEN {TRUNCATED} ELSE 0 END AS late FROM fault),
p AS (
  SELECT conv, CAST(0 AS BIGINT) AS i, {_sql_closure('t')} FROM (SELECT DISTINCT conv, '000000000' AS t0, CAST(NULL AS VARCHAR) AS t1,
    CAST(NULL AS VARCHAR) AS t2, CAST(NULL AS VARCHAR) AS t3 FROM r)
  UNION ALL
  SELECT conv, i, {_sql_closure('t')} FROM (SELECT r.conv, r.i, {_sql_row()} FROM p JOIN r ON r.conv = p.conv AND r.i = p.i + 1)),
z AS (SELECT conv, arg_max(least(z0, z3), i) AS z FROM p GROUP BY conv),
e AS (SELECT conv, unnest(string_split(z[10:], '')) AS letter, unnest(range(1, len(z) - 8)) AS j FROM z WHERE len(z) > 9),
f AS (SELECT *, sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN letter <> 'D' THEN 1 ELSE 0 END) OVER w AS q
  FROM e WINDOW w AS (PARTITION BY conv ORDER BY j)),
g AS (SELECT f.conv, f.q, f.letter, r.role, r.text, bool_or(f.letter = 'K' AND f.q = 1 AND r.head = 's') OVER (PARTITION BY f.conv) AS sys
  FROM f LEFT JOIN r ON r.conv = f.conv AND r.i = f.i AND f.letter <> 'I' WHERE f.letter <> 'D'),
h AS (SELECT conv, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (q - CASE WHEN sys THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || coalesce(text, ''), chr(10) ORDER BY q)) AS sha FROM g GROUP BY conv),
s AS (SELECT conv, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (NOT blank AND again) AS duplicate, count(*) FILTER (NOT must AND cut) AS truncated, count(*) FILTER (odd) AS illegal FROM r GROUP BY conv)
SELECT c.conv_id, {', '.join(f'CAST(coalesce(s.{x}, 0) AS BIGINT) AS {x}' for x in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal'))},
  CAST(coalesce(CAST(z.z[1:9] AS BIGINT), 0) AS BIGINT) AS cost, coalesce(z.z[10:], '') AS audit, coalesce(h.sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN z ON z.conv = s.conv LEFT JOIN h ON h.conv = s.conv"""
