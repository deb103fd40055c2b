import hashlib
import itertools
import random
import re
import zlib

from quarrystone.llm.conversations import product, repair_conversations, run_of, solution, turn

SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if t is None else t}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(turns):
    """By a search over states, turn by turn: (role initial, fault) to cost and audit."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}

    def closed(best):
        for _ in range(2):
            for p, (c, a) in list(best.items()):
                q = "a" if p == "u" else "u"
                best[q] = min(best.get(q, (9**9, "")), (c + 3, a + "I"))
        return best

    best = closed({"": (0, "")})
    for ini, fault in turns:
        new = {}
        for p, (c, a) in best.items():
            ways = [(p, 4, "D")]
            if fault not in ("b", "d"):
                more = 3 if fault == "t" else 0
                ways += [(ini, more, "K")] if ini and ini in after[p] else []
                ways += [(r, 3 + more, "R") for r in after[p] if r != "s"]
            for q, cost, edit in ways:
                new[q] = min(new.get(q, (9**9, "")), (c + cost, a + edit))
        best = closed(new)
    return min(best[q] for q in ("", "a") if q in best)


def brute(rows, original):
    out = {}
    for conv in {r[0] for r in original}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        seen, faults = set(), []
        for _, _, role, text in mine:
            body = text.strip(SPACE)
            faults.append("b" if not body else "d" if (role, text) in seen else "" if body[-1] in ".!?" else "t")
            seen.add((role, text))
        cost, audit = cheapest([(r[2][:1], f) for r, f in zip(mine, faults, strict=True)])
        known = [r[1] for r in mine if r[1] is not None]
        left, out_rows = iter(mine), []
        for e in audit:
            role, text = ("", "") if e == "I" else next(left)[2:]
            if e != "D":
                wanted = "assistant" if out_rows and out_rows[-1][0][:1] == "u" else "user"
                out_rows.append((role if e == "K" else wanted, text))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out_rows).encode()).hexdigest()
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest)
    return out


def found(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def made(seed, convs, most):
    dice = random.Random(seed)
    rows = []
    for conv in [*range(convs), None]:
        for t in dice.sample(range(3 * most), dice.randint(0, most)) + ([None] if dice.random() < 0.3 else []):
            text = dice.choice(["Yes.", "No", "é? \n", "", " \t", None, "a much longer turn without an end", "x!"])
            rows.append((conv, t, dice.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None, "unknown"]), text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_equal_to_brute_force_for_all_cuts(spark):
    rows = made(1, 40, 12)
    for size, fan, most in ((3, 2, 1 << 20), (256, 64, 20)):
        df = spark.createDataFrame(rows, SCHEMA)
        assert found(repair_conversations(df, size, fan, most, damage=True)) == brute(damage(rows), rows)
    plain = [(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows]
    assert found(repair_conversations(spark.createDataFrame(rows, SCHEMA))) == brute(plain, rows)


def test_one_long_conversation_in_many_partitions(spark):
    dice = random.Random(7)
    rows = [(5, t, dice.choice(["user", "assistant", "system"]), dice.choice([f"Turn {t}.", "again", "Same."])) for t in range(3000)]
    rows += [(6, 0, "system", "Hi."), (6, 1, "user", "Who?"), (6, 2, "assistant", "Me.")]
    out = found(repair_conversations(spark.createDataFrame(rows, SCHEMA).repartition(7), 16, 4))
    assert out == brute(rows, rows)
    assert out[6][:7] == (0, 0, 0, 0, 0, 0, "KKK")


def test_products_are_associative():
    dice = random.Random(3)
    for _ in range(50):
        codes = "".join(dice.choice("DsSuUaAxX") for _ in range(12))
        m = turn(codes[0])
        for c in codes[1:]:
            m = product(m, turn(c))
        assert m == run_of(codes)
        faults = ["b" if c == "D" else "t" if c.isupper() else "" for c in codes]
        assert solution(m) == cheapest([(c.lower() if c in "sSuUaA" else "x", f) for c, f in zip(codes, faults, strict=True)])


def test_odd_tables(spark):
    assert repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None, "user", "Hi."), (1, None, "user", "Hi."), (None, 3, None, None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", part long, code string")
    plain = [(c, t, r or " ", x or " ") for c, t, r, x in rows]
    assert found(repair_conversations(df)) == brute(plain, rows)


def test_query_and_oracle(spark, sf_dir):
    import duckdb

    from quarrystone.llm.conversations import ORACLE, op11_conversation_repair

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = found(op11_conversation_repair(spark, sf_dir))
    assert out == brute(damage(rows), rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    table = con.sql(ORACLE).to_arrow_table().to_pylist()
    assert {r["conv_id"]: tuple(r[n] for n in names) for r in table} == out
