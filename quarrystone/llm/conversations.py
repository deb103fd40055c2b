"""Conversation structure repair: the cheapest edits that give ``(system? (user assistant)+)?``.

Each turn becomes a 4x4 matrix over (cost, audit) elements: entry (p, q) is the
cheapest way from state p to state q of the wanted pattern by insertions and
what is done with the turn. Products take the least sum of costs, with ties the
ASCII-least audit, so they are associative: two audits of equal cost over the
same turns are never prefixes of one another, as any letters more would cost
more. Conversations are cut into segments, whose matrices meet in a tree; a
conversation of any length is never one task's work, but for the digest of its
text, which is streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.shared import partitions, saved
from quarrystone.sources.tables import table

#: ASCII white space, as [\x20\x09-\x0D].
SPACE = " \t\n\x0b\f\r"

#: States: nothing yet, after the system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a turn of each role's initial leads from each state.
MOVES = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ENDS = (START, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

Element = tuple[int, str] | None
Matrix = tuple[tuple[Element, ...], ...]


def better(x: Element, y: Element) -> Element:
    """The lesser cost, then the lesser audit."""
    return y if x is None else x if y is None else min(x, y)


def product(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product: first what ``a`` stands for, then what ``b`` does."""
    rows = []
    for row in a:
        out: list[Element] = [None] * 4
        for k, x in enumerate(row):
            if x is not None:
                for j, y in enumerate(b[k]):
                    if y is not None and (out[j] is None or x[0] + y[0] <= out[j][0]):
                        out[j] = better(out[j], (x[0] + y[0], x[1] + y[1]))
        rows.append(tuple(out))
    return tuple(rows)


def matrix(entries: dict[tuple[int, int], tuple[int, str]]) -> Matrix:
    return tuple(tuple(entries.get((p, q)) for q in range(4)) for p in range(4))


#: Nothing, or insertions: a second round trip to a state is never cheaper.
CLOSURE = matrix({(p, p): (0, "") for p in range(4)} | {(p, USER): (INSERT, "I") for p in (START, SYSTEM, ASSISTANT)} | {(p, ASSISTANT): (2 * INSERT, "II") for p in (START, SYSTEM)} | {(USER, ASSISTANT): (INSERT, "I")})


def turn(code: str) -> Matrix:
    """A turn after insertions. Codes: D must go, s, u, a and x are roles (x: any other), in upper case if truncated."""
    entries: dict[tuple[int, int], tuple[int, str]] = {(p, p): (DELETE, "D") for p in range(4)}
    if code != "D":
        extra = TRUNCATED if code.isupper() else 0
        for role, moves in MOVES.items():
            for p, q in moves.items():
                if role == code.lower():
                    entries[p, q] = (extra, "K")
                elif role != "s":
                    entries[p, q] = (extra + REROLE, "R")
    return product(CLOSURE, matrix(entries))


@lru_cache(maxsize=1 << 15)
def short_run(codes: str) -> Matrix:
    return turn(codes) if len(codes) == 1 else product(short_run(codes[: len(codes) // 2]), short_run(codes[len(codes) // 2 :]))


def run_of(codes: str) -> Matrix:
    """The product over a run of turns, halved again and again; short runs are remembered."""
    if len(codes) <= 8:
        return short_run(codes)
    cut = (len(codes) // 16) * 8 or 8
    return product(run_of(codes[:cut]), run_of(codes[cut:]))


def solution(m: Matrix) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of what ``m`` stands for."""
    last = product(m, CLOSURE)[START]
    return min(last[q] for q in ENDS if last[q] is not None)


# ---------------------------------------------------------------- damage and faults


def damaged(rows: DataFrame) -> DataFrame:
    """The rows (conv, turn, role, text) after their damage; ``copy`` numbers the copies of a row that is repeated."""
    key = F.concat(F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return (
        rows.withColumn("kind", kind)
        .where("kind <> 0")
        .select(
            "conv",
            "turn",
            F.when(F.col("kind") == 4, "user").otherwise(role).alias("role"),
            F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
            F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
    )


def initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def coded(rows: DataFrame) -> DataFrame:
    """With a hash of role and text, the role's initial, and the code of the turn were it no duplicate (D: blank)."""
    cut = F.rtrim(F.col("text"), F.lit(SPACE))
    first = initial(F.col("role"))
    role = F.when(first.isin("s", "u", "a"), first).otherwise("x")
    code = F.when(F.btrim(F.col("text"), F.lit(SPACE)) == "", "D").when(F.right(cut, F.lit(1)).isin(".", "!", "?"), role).otherwise(F.upper(role))
    both = [F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2")]
    return rows.select("*", first.alias("initial"), code.alias("code"), *both)


# ---------------------------------------------------------------- segments

#: What is known of a run of turns, besides its matrix.
SUMMARY = "blank long, duplicate long, truncated long, illegal long, distinct long, first_turn long, last_turn long, first_initial string, last_initial string"
NAMES = [x.split()[0] for x in SUMMARY.split(", ")]
LEGAL = ("su", "ua", "au")


def joined(a: tuple, b: tuple) -> tuple:
    """The summary of two runs, one after the other."""
    illegal = a[3] + b[3] + (a[8] + b[7] not in LEGAL)
    if a[5] is None or b[5] is None:
        turns = (a[4] + b[4], a[5] if b[5] is None else b[5], a[6] if b[6] is None else b[6])
    else:
        turns = (a[4] + b[4] - (a[6] == b[5]), a[5], b[6])
    return (a[0] + b[0], a[1] + b[1], a[2] + b[2], illegal, *turns, a[7], b[8])


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def segments(rows: DataFrame, size: int, most: int) -> DataFrame:
    """Runs of at most ``size`` turns of one conversation (or ``most`` characters and a turn), in order of (part, seg).

    Turns are dealt out by ranges of (conversation, turn), so that a long
    conversation has segments in several partitions; ``part`` is the partition,
    ``seg`` counts a conversation's segments within it.
    """
    order = ["conv", "turn", "role", "h1", "h2", "copy", "id"]
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    dealt = dealt.select("conv", "turn", "role", "text", "initial", "code", "h1", "h2")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        open_rows: list[tuple] = []
        chars, seg, schema = 0, 0, None
        done: list[tuple] = []

        def closed() -> tuple:
            conv, turns, roles, texts, initials, codes, h1, h2 = zip(*open_rows, strict=True)
            known = [t for t in turns if t is not None]
            return (conv[0], part, seg, "".join(codes), list(initials), len(set(known)), known[0] if known else None, known[-1] if known else None, list(h1), list(h2), list(roles), list(texts))

        for batch in batches:
            if schema is None:
                kinds = [("conv", batch.schema.field(0).type), ("part", pa.int64()), ("seg", pa.int64()), ("codes", pa.string()), ("initials", pa.list_(pa.string())), ("distinct", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("h1", pa.list_(pa.int64())), ("h2", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
                schema = pa.schema(kinds)
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                other = open_rows and open_rows[0][0] != row[0]
                if open_rows and (other or len(open_rows) >= size or chars >= most):
                    done.append(closed())
                    seg, open_rows, chars = 0 if other else seg + 1, [], 0
                open_rows.append(row)
                chars += len(row[3])
            if done:
                yield batch_of(done, schema)
                done = []
        if open_rows:
            yield batch_of([closed()], schema)

    kind = dict(rows.dtypes)["conv"]
    return dealt.mapInArrow(cut, f"conv {kind}, part long, seg long, codes string, initials array<string>, distinct long, first_turn long, last_turn long, h1 array<long>, h2 array<long>, roles array<string>, texts array<string>")


def duplicates(cut: DataFrame) -> DataFrame:
    """conv, part, seg and the places of turns whose role and text were seen earlier in the conversation."""
    each = cut.select("conv", "part", "seg", "codes", F.posexplode(F.arrays_zip("h1", "h2")).alias("at", "h"))
    each = each.where(F.substring("codes", F.col("at") + 1, F.lit(1)) != "D").select("conv", "part", "seg", "at", "h.h1", "h.h2")
    first = each.groupBy("conv", "h1", "h2").agg(F.min(F.struct("part", "seg", "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
    # Written, so that adaptive execution can split a text that is said again and again.
    first = saved(first.select(F.col("conv").alias("of"), "h1", "h2", "first"), "repeated-turns")
    again = each.join(first, F.col("conv").eqNullSafe(F.col("of")) & (each.h1 == first.h1) & (each.h2 == first.h2)).where(F.struct("part", "seg", "at") != F.col("first"))
    return again.groupBy("conv", "part", "seg").agg(F.collect_list("at").alias("repeated"))


ELEMENTS = "costs array<long>, audits array<string>"


def leaves(cut: DataFrame) -> DataFrame:
    """conv, part, seg, the matrix and the summary of each segment, duplicates marked."""
    again = saved(duplicates(cut), "repeated-places").select(F.col("conv").alias("of"), F.col("part").alias("p"), F.col("seg").alias("s"), "repeated")
    slim = cut.select("conv", "part", "seg", "codes", "initials", "distinct", "first_turn", "last_turn")
    both = slim.join(again, F.col("conv").eqNullSafe(F.col("of")) & (F.col("part") == F.col("p")) & (F.col("seg") == F.col("s")), "left").drop("of", "p", "s")

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, part, seg, codes, initials, distinct, first, last, repeated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = list(codes)
                for i in repeated or ():
                    now[i] = "D"
                illegal = sum(x + y not in LEGAL for x, y in zip(initials, initials[1:], strict=False))
                counts = (codes.count("D"), len(repeated or ()), sum(c != "D" and c.isupper() for c in now), illegal, distinct, first, last, initials[0], initials[-1])
                rows.append((conv, part, seg, *flat(run_of("".join(now))), *counts))
            yield batch_of(rows, reduced_schema(batch.schema.field(0).type))

    return both.mapInArrow(reduced, f"conv {dict(cut.dtypes)['conv']}, part long, seg long, {ELEMENTS}, {SUMMARY}")


def flat(m: Matrix) -> tuple[list[int | None], list[str | None]]:
    cells = [x for row in m for x in row]
    return [x and x[0] for x in cells], [x and x[1] for x in cells]


def square(costs: list[int | None], audits: list[str | None]) -> Matrix:
    cells = [None if c is None else (c, a) for c, a in zip(costs, audits, strict=True)]
    return tuple(tuple(cells[4 * p : 4 * p + 4]) for p in range(4))


def reduced_schema(conv: pa.DataType) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    summary = [(name, kinds[kind]) for name, kind in (x.split() for x in SUMMARY.split(", "))]
    return pa.schema([("conv", conv), ("part", pa.int64()), ("seg", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), *summary])


def level(runs: DataFrame, fan: int, over: str) -> DataFrame:
    """One level of the tree: ``fan`` neighbours by ``over`` become one run."""
    group = (F.col(over) / fan).cast("long")
    keyed = runs.withColumn("up_part", F.col("part") if over == "seg" else group).withColumn("up_seg", group if over == "seg" else F.lit(0).cast("long"))
    dealt = keyed.repartition(partitions(runs.sparkSession), "conv", "up_part", "up_seg").sortWithinPartitions("conv", "part", "seg")

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        state: list[Any] = []
        done: list[tuple] = []
        schema = None
        for batch in batches:
            schema = reduced_schema(batch.schema.field(0).type)
            for conv, _, _, costs, audits, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                *summary, part, seg = rest
                if key == (conv, part, seg):
                    state = [product(state[0], square(costs, audits)), joined(state[1], tuple(summary))]
                    continue
                if key is not None:
                    done.append((*key, *flat(state[0]), *state[1]))
                key, state = (conv, part, seg), [square(costs, audits), tuple(summary)]
            if done:
                yield batch_of(done, schema)
                done = []
        if key is not None:
            yield batch_of([(*key, *flat(state[0]), *state[1])], schema)

    return dealt.mapInArrow(reduced, runs.schema)


def repair_conversations(conversations: DataFrame, size: int = 256, fan: int = 64, most: int = 1 << 20, damage: bool = False, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: its faults, the cost and the audit of its cheapest repair, and the digest of the repaired text.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit
    and repaired_sha256. A turn is blank without other than ASCII white space,
    else duplicate if its role and text were there before, else truncated if it
    does not end with ``.``, ``!`` or ``?``. Keep (K) costs 0, rerole to user or
    assistant (R) 3, delete (D) 4, which blank and duplicate turns must be,
    insert an empty turn of the two (I) 3; a truncated turn that stays costs 3
    more. With ``damage`` rows are damaged first, by a checksum of their keys.

    Null roles and texts are one space (a blank turn); null turns come first;
    rows of equal turn are ordered by role and a hash of text. Rows with a null
    conversation are one conversation. A conversation none of whose rows is left
    has zeros, an empty audit and the digest of nothing, as one all of whose
    turns go. Other columns are not read. An empty table gives no rows.
    ``size``, ``most`` and ``fan`` bound a segment and a node of the tree, and
    change no result.
    """
    spark = conversations.sparkSession
    rows = conversations.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.col(f"`{role_col}`").alias("role"), F.col(f"`{text_col}`").alias("text"))
    kind = dict(rows.dtypes)["conv"]
    blank = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    worn = damaged(rows) if damage else rows.select("conv", "turn", *blank, F.lit(0).alias("copy"))
    # Equal rows are told apart, so that many of them still spread over partitions.
    cut = saved(segments(coded(worn).withColumn("id", F.monotonically_increasing_id()), size, most), "segments")

    runs = saved(leaves(cut), "leaves")
    most_seg, most_part = runs.agg(F.max("seg"), F.max("part")).first()
    while most_seg:
        runs, most_seg = saved(level(runs, fan, "seg"), "runs"), most_seg // fan
    while most_part:
        runs, most_part = saved(level(runs, fan, "part"), "runs"), most_part // fan

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, _, _, costs, audits, blank, duplicate, truncated, illegal, distinct, first, last, *_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cost, audit = solution(square(costs, audits))
                rows.append((conv, 0 if first is None else last - first + 1 - distinct, blank, duplicate, truncated, illegal, cost, audit))
            schema = pa.schema([("conv", batch.schema.field(0).type), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])
            yield batch_of(rows, schema)

    found = saved(runs.mapInArrow(solved, f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"), "repairs")
    texts = cut.select("conv", "part", "seg", F.lit(None).cast("string").alias("audit"), "roles", "texts")
    audits = found.select("conv", F.lit(-1).cast("long").alias("part"), F.lit(-1).cast("long").alias("seg"), "audit", F.array().cast("array<string>").alias("roles"), F.array().cast("array<string>").alias("texts"))
    dealt = audits.unionByName(texts).repartition(partitions(spark), "conv").sortWithinPartitions("conv", "part", "seg")

    digests = dealt.mapInArrow(streamed, f"conv {kind}, repaired_sha256 string").select(F.col("conv").alias("of"), "repaired_sha256")
    ids = rows.select(F.col("conv").alias("id")).distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    whole = ids.join(found, F.col("id").eqNullSafe(F.col("conv")), "left").join(digests, F.col("id").eqNullSafe(F.col("of")), "left")
    return whole.select(
        F.col("id").alias(conv_col),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def repaired(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The roles and texts that the audit's edits leave of the turns."""
    last = ""
    for edit in audit:
        wanted = "assistant" if last == "u" else "user"
        role, text = ("", "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        role = role if edit == "K" else wanted
        yield role, text
        last = role[:1]


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each repaired conversation: its audit comes first, then its segments, one by one."""
    kind = None

    def all_rows() -> Iterator[tuple]:
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field(0).type
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    rows = all_rows()
    row = next(rows, None)
    done: list[tuple] = []
    while row is not None:
        conv, audit, row = row[0], row[3], next(rows, None)

        def turns() -> Iterator[tuple[str, str]]:
            nonlocal row
            while row is not None and row[0] == conv and row[1] >= 0:  # noqa: B023
                yield from zip(row[4], row[5], strict=True)
                row = next(rows, None)

        left, digest, between = turns(), hashlib.sha256(), b""
        for role, text in repaired(audit, left):
            digest.update(between + f"{role}:{text}".encode())
            between = b"\n"
        for _ in left:  # the row after the conversation's last comes next
            pass
        done.append((conv, digest.hexdigest()))
        if len(done) == 4096:
            yield batch_of(done, pa.schema([("conv", kind), ("repaired_sha256", pa.string())]))
            done = []
    if done:
        yield batch_of(done, pa.schema([("conv", kind), ("repaired_sha256", pa.string())]))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after the dealt damage."""
    return repair_conversations(table(spark, sf_dir, "conversations"), damage=True)


ORACLE = r"""
WITH RECURSIVE bits AS (
  SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS t(i)),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (SELECT keyed.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))),
                                          lambda c, b: xor(t[CAST(xor(c & 255, b) + 1 AS BIGINT)], c >> 8)), 4294967295) % 20 AS kind FROM keyed, crc),
rows AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy,
                CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
         FROM kinds WHERE kind <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM rows),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, substr(role, 1, 1) AS ini,
                NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS is_blank, regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS closed FROM numbered),
faults AS (SELECT *, CASE WHEN is_blank THEN 'b' WHEN nth > 1 THEN 'd' WHEN NOT closed THEN 't' ELSE '' END AS fault,
                  coalesce(lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini NOT IN ('su', 'ua', 'au'), false) AS odd FROM seen),
states(conv_id, i, p, cost, audit) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), p, CASE p WHEN 0 THEN 0 WHEN 2 THEN 3 ELSE 6 END, CASE p WHEN 0 THEN '' WHEN 2 THEN 'I' ELSE 'II' END FROM numbered, (VALUES (0), (2), (3)) AS t(p)
  UNION ALL
  SELECT conv_id, i, q, best.c, best.a FROM (
    SELECT s.conv_id, f.i, m.q, min({'c': s.cost + e.cost + m.more, 'a': s.audit || e.edit || m.ins}) AS best
    FROM states AS s JOIN faults AS f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1,
    LATERAL (SELECT 'D' AS edit, s.p AS q, 4 AS cost
             UNION ALL SELECT 'K', CASE f.ini WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, CASE f.fault WHEN 't' THEN 3 ELSE 0 END
               WHERE f.fault NOT IN ('b', 'd') AND (f.ini = 's' AND s.p = 0 OR f.ini = 'u' AND s.p IN (0, 1, 3) OR f.ini = 'a' AND s.p = 2)
             UNION ALL SELECT 'R', CASE s.p WHEN 2 THEN 3 ELSE 2 END, CASE f.fault WHEN 't' THEN 6 ELSE 3 END WHERE f.fault NOT IN ('b', 'd')) AS e,
    LATERAL (SELECT e.q AS q, 0 AS more, '' AS ins
             UNION ALL SELECT CASE e.q WHEN 2 THEN 3 ELSE 2 END, 3, 'I'
             UNION ALL SELECT 3, 6, 'II' WHERE e.q IN (0, 1)) AS m
    GROUP BY ALL)),
ends AS (SELECT conv_id, max(i) AS n FROM numbered GROUP BY conv_id),
solved AS (SELECT s.conv_id, min({'c': s.cost, 'a': s.audit}) AS best FROM states AS s JOIN ends AS e ON e.conv_id IS NOT DISTINCT FROM s.conv_id AND e.n = s.i WHERE s.p IN (0, 3) GROUP BY s.conv_id),
edits AS (SELECT conv_id, j, edit, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER w AS o
          FROM (SELECT conv_id, unnest(string_split(best.a, '')) AS edit, generate_subscripts(string_split(best.a, ''), 1) AS j FROM solved WHERE best.a <> '')
          WINDOW w AS (PARTITION BY conv_id ORDER BY j ROWS UNBOUNDED PRECEDING)),
kept AS (SELECT e.*, f.role, f.text, max(CASE WHEN e.o = 1 AND e.edit = 'K' AND f.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS sys
         FROM edits AS e LEFT JOIN faults AS f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i AND e.edit <> 'I' WHERE e.edit <> 'D'),
texts AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS whole FROM kept GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
                  count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE odd) AS illegal FROM faults GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN solved ON solved.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM o.conv_id
"""
