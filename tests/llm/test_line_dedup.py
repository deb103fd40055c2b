import hashlib

from quarrystone.llm.line_dedup import line_dedup

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(docs, min_docs=3, min_chars=20):
    of = {}
    for d, text in docs:
        for line in (text or "").split("\n"):
            if d is not None and len(key(line)) >= min_chars:
                of.setdefault(key(line), set()).add(d)
    out = []
    for d, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if d is None or len(of.get(key(x), ())) < min_docs or d == max(of[key(x)])]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


L = "this line is long enough to be counted"
DOCS = [
    (1, f"{L}\nown text of one\n{L.upper()} \t"),
    (2, f"  {L}\r\nx"),
    (3, f"{L}\n\n{L}\nété É {L}"),
    (3, f"{L}\n\n{L}\nété É {L}"),
    (3, f"other text, same id\n{L}"),
    (4, None),
    (5, ""),
    (None, f"{L}\nnull id"),
    (6, f"été É {L}\nshort line\n"),
    (7, f"été é {L}\nété É {L}\nshort line\n"),
    (8, ("short line\n" * 5000) + L),
]


def test_equal_to_brute_force(spark):
    rows = [(d, t, "mine", 9) for d, t in DOCS]
    out = line_dedup(spark.createDataFrame(rows, "doc_id long, text string, h1 string, n_lines int"))
    assert out.columns == ["doc_id", "text", "h1", "n_lines", "n_dropped"]
    found = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()), key=str)
    assert found == sorted(brute(DOCS), key=str)


def test_empty_table(spark):
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, sf_dir):
    from quarrystone.llm.line_dedup import op10_line_dedup

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in op10_line_dedup(spark, sf_dir).collect()}
    assert found == {d: (n, x, hashlib.sha256(t.encode()).hexdigest()) for d, t, n, x in brute(docs)}
