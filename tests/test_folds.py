import random
import re

import pytest

from quarrystone.streaming import folds as F


def run(spark, rows, schema, fold, by=("seq",)):
    out = F.fold_table(spark.createDataFrame(rows, schema), "key", by, fold).collect()
    return sorted((r.asDict() for r in out), key=lambda r: (str(r["key"]), r["seq"], r.get("part", 0)))


S = 1_000_000
PIECES = "key string, seq long, piece string, done boolean"


def pieces(text, key="a", seed=0):
    rng, rows, at = random.Random(seed), [], 0
    while at < len(text):
        n = rng.randint(1, 5)
        rows.append((key, len(rows), text[at : at + n], at + n >= len(text)))
        at += n
    return rows


def test_rate_limit(spark):
    rows = [(1, i, t * S) for i, t in enumerate([0, 1, 2, 61, 62, 121])] + [(2, 0, 0)]
    out = run(spark, rows, "key long, seq long, at long", F.rate_limit(2, 60))
    assert [r["admitted"] for r in out] == [True, True, False, True, True, False, True]


def test_throttle_and_breaker(spark):
    rows = [(1, i, i * S, False) for i in range(7)] + [(1, 7, 1000 * S, True)]
    out = run(spark, rows, "key long, seq long, at long, ok boolean", F.login_throttle())
    assert [r["outcome"] for r in out] == ["failed"] * 5 + ["locked"] * 2 + ["passed"]
    out = run(spark, rows, "key long, seq long, at long, ok boolean", F.circuit_breaker(3, 60))
    assert [r["open"] for r in out] == [False] * 3 + [True] * 4 + [False]


def test_quota(spark):
    schema = "key string, seq long, op string, reservation string, counters array<struct<name:string,limit:long>>, amount long"
    day = [("day", 2), ("school", None)]
    rows = [("m", 0, "reserve", "a", day, 1), ("m", 1, "reserve", "b", day, 1), ("m", 2, "reserve", "c", day, 1), ("m", 3, "release", "a", None, 0), ("m", 4, "release", "a", None, 0), ("m", 5, "reserve", "c", day, 1), ("m", 6, "reserve", "c", day, 1)]
    out = run(spark, rows, schema, F.quota())
    assert [(r["allowed"], r["denied_by"], r["used"]) for r in out] == [(True, None, 1), (True, None, 2), (False, "day", 2), (True, None, 1), (True, None, 1), (True, None, 2), (True, None, 2)]
    tokens = [("t", 100)]
    rows = [("m", 0, "reserve", "a", tokens, 80), ("m", 1, "reconcile", "a", None, 30), ("m", 2, "reconcile", "a", None, 99), ("m", 3, "release", "a", None, 0), ("m", 4, "reserve", "b", tokens, 70), ("m", 5, "reserve", "d", tokens, 1)]
    out = run(spark, rows, schema, F.quota())
    assert [r["used"] for r in out] == [80, 30, 30, 30, 100, 100] and out[-1]["denied_by"] == "t"


def test_replay_and_cache(spark):
    rows = [("r", 0, 0, "x"), ("r", 1, 900 * S, "x"), ("r", 2, 900 * S, "y"), ("r", 3, 901 * S, "y")]
    assert [r["outcome"] for r in run(spark, rows, "key string, seq long, at long, hash string", F.replay())] == ["first", "replay", "conflict", "first"]
    assert [r["hit"] for r in run(spark, rows, "key string, seq long, at long, hash string", F.ttl_cache(900))] == [False, True, True, False]


def test_segments_keep_the_text(spark):
    text = "One? Two! " + "x" * 300 + "; end\nrest"
    for seed in range(3):
        out = run(spark, pieces(text, seed=seed), PIECES, F.segments())
        assert "".join(r["segment"] for r in out) == text
        assert [r["part"] for r in out] == list(range(len(out)))
        assert all(len(r["segment"]) <= 101 for r in out)


def test_hidden_spans_however_cut(spark):
    text = "a<think>secret</think>b < think c<think>more"
    for seed in range(5):
        out = run(spark, pieces(text, seed=seed), PIECES, F.hidden_spans())
        assert "".join(r["shown"] for r in out) == "ab < think c"


def test_deltas_and_guard(spark):
    rows = [("a", 0, "He"), ("a", 1, "Hello"), ("a", 2, "Hello"), ("a", 3, "Hello you")]
    assert [r["delta"] for r in run(spark, rows, "key string, seq long, piece string", F.deltas())] == ["He", "llo", " you"]
    rows = [("a", 0, "Think first. "), ("a", 1, "The answer is"), ("a", 2, " 42."), ("a", 3, "more")]
    out = run(spark, rows, "key string, seq long, segment string", F.guarded(r"answer is \d+", "Try it yourself."))
    assert [r["shown"] for r in out] == ["Think first. ", "The answer is", "\n\nTry it yourself."]


PATTERNS = [r"answer is \d+", r"ab{2,3}c", r"a.*z", r"\bcat\b", r"(?<=x)y", r"^b+c", r"a(?=b)", r"\Bca\B", r"a\s*b\s*c$", r"(?i)ab|bca|cccc"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_guard_equals_the_full_search_at_every_split(pattern):
    """The fold's step against a search of the whole text so far, over all cuts in two and random cuts in many."""
    rng = random.Random(pattern)
    fold = F.guarded(pattern, "R", margin=8)
    texts = ["answer is 42.", "the cat sat", "xy", "abbbc"] + ["".join(rng.choice("abcxyz  .") for _ in range(rng.randint(0, 60))) for _ in range(150)]
    for text in texts:
        cuts = [[i] for i in range(len(text) + 1)] + [sorted(rng.sample(range(len(text) + 1), min(6, len(text) + 1))) for _ in range(5)]
        for cut in cuts:
            pieces = [text[a:b] for a, b in zip([0, *cut], [*cut, len(text)], strict=True)]
            state, got, want, so_far = fold.fresh(), [], [], ""
            for i, piece in enumerate(pieces):
                got += [r["shown"] for r in fold.step(state, {"key": "k", "seq": i, "segment": piece})]
            for piece in pieces:
                if re.search(pattern, so_far + piece):
                    want.append(("" if not so_far or so_far[-1] in F.SEGMENT_ENDS + "." else "\n\n") + "R")
                    break
                so_far += piece
                want.append(piece)
            assert got == want, (text, pieces)


def test_guard_keeps_a_bounded_state():
    fold = F.guarded(r"answer is \d{1,9}\b.", "R")
    state = fold.fresh()
    for i in range(2000):
        fold.step(state, {"key": "k", "seq": i, "segment": "the answer is near, "})
        assert len(state["tail"]) <= 2 * 64 + 20
    assert fold.step(state, {"key": "k", "seq": 2000, "segment": "answer is 7."})[0]["shown"].endswith("R")


def test_stream_equals_table(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(k, i, t * S) for k in (1, 2) for i, t in enumerate([0, 1, 2, 61, 62, 121])]
    schema = "key long, seq long, at long"
    fold = F.rate_limit(2, 60)
    for i in (0, 1):
        spark.createDataFrame([r for r in rows if (r[1] >= 3) == bool(i)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = F.fold_stream(stream, "key", ["seq"], fold).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    got = sorted((r.key, r.seq, r.admitted) for r in spark.table("limited").collect())
    assert got == [(r["key"], r["seq"], r["admitted"]) for r in run(spark, rows, schema, fold)]
