"""Document operators: chunking, running headers, contents pages, question slices, tag and title matching."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import boilerplate_key, structure_key
from quarrystone.operators.sequence import as_of

# ---------------------------------------------------------------- chunks

#: Spans that are never cut: code, display and inline formulas; an opener after a backslash is none.
PROTECTED = re.compile(r"(?<!\\)(?:\\\\)*(```.*?```|\$\$.*?\$\$|\\\[.*?\\\]|\\\(.*?\\\)|\$[^$\n]+?\$)", re.DOTALL)
UNIT = re.compile(r"(?<=[。！？；;.!?])\s+|\n+")
BOUNDARY = "。！？；;.!?,，\n "


def windows(unit: str, size: int, overlap: int) -> Iterator[str]:
    """A long unit in overlapping windows that end after a boundary sign of their second half, if there is one."""
    at = 0
    while len(unit) - at > size:
        stop = next((i + 1 for i in range(at + size - 1, at + size // 2, -1) if unit[i] in BOUNDARY), at + size)
        yield unit[at:stop]
        at = max(stop - overlap, at + 1)
    yield unit[at:]


def packed(parts: Iterator[tuple[str, str]], size: int) -> Iterator[str]:
    """Greedy packing: parts (mark before it, text) join while the whole is no longer than ``size``."""
    whole = ""
    for mark, part in parts:
        if not part.strip():
            continue
        if whole and len(whole) + len(mark) + len(part) > size:
            yield whole
            whole = part
        else:
            whole = whole + mark + part if whole else part
    if whole:
        yield whole


def chunks(text: str, size: int = 512, overlap: int = 64) -> list[str]:
    """A text in chunks of at most ``size`` characters, but for longer protected spans, which stay whole."""
    overlap = min(overlap, size // 3)
    pieces: list[tuple[str, str]] = []
    for i, part in enumerate(PROTECTED.split(text.replace("\r\n", "\n").replace("\r", "\n").strip())):
        if i % 2:
            inline = not part.startswith(("```", "$$", "\\["))
            pieces.append((" " if inline else "\n", part))
        else:
            cut = (("\n", w) for u in UNIT.split(part) if u.strip() for w in windows(u.strip(), size, overlap))
            after = i > 0 and pieces and pieces[-1][0] == " "
            pieces += [(" " if after and n == 0 else "\n", c) for n, c in enumerate(packed(cut, size))]
    return list(packed(iter(pieces), size))


def chunked(docs: DataFrame, size: int = 512, overlap: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id, chunk_index, content: each document alone, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, index, content = [], [], []
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made = chunks(text or "", size, overlap)
                ids += [own] * len(made)
                index += range(len(made))
                content += made
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(index, pa.int32()), pa.array(content, pa.string())], names=[id_col, "chunk_index", "content"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, f"{id_col} long, chunk_index int, content string")


# ---------------------------------------------------------------- running headers, contents


def needed_pages(pages: Column) -> Column:
    """On how many pages a line must stand to be a running one."""
    return F.when(pages <= 3, F.greatest(F.lit(2), pages)).otherwise(F.greatest(F.lit(3), F.floor((pages + 1) / 2)))


def without_running_lines(lines: DataFrame, document: str, page: str, line: str, candidate: Column, protected: Column) -> DataFrame:
    """Lines but for those whose key stands, as a candidate, on enough pages of their document."""
    keyed = lines.withColumns({"__key": boilerplate_key(F.col(line)), "__may": candidate & ~protected, "__safe": protected})
    pages = lines.groupBy(document).agg(F.countDistinct(page).alias("__pages"))
    running = (
        keyed.where(F.col("__may") & (F.col("__key") != ""))
        .groupBy(document, "__key")
        .agg(F.countDistinct(page).alias("__on"))
        .join(pages, document)
        .where(F.col("__on") >= needed_pages(F.col("__pages")))
        .select(document, "__key", F.lit(True).alias("__running"))
    )
    kept = keyed.join(running, [document, "__key"], "left").where(F.col("__running").isNull() | F.col("__safe"))
    return kept.select(*lines.columns)


def page_offset(entries: DataFrame, headings: DataFrame) -> DataFrame:
    """Per document the commonest difference of the pages where headings stand and those their entries print (ties to the first page)."""
    joined = entries.withColumn("key", structure_key(F.col("title"))).join(headings.withColumn("key", structure_key(F.col("title"))).select("doc_id", "key", "page"), ["doc_id", "key"])
    counts = joined.groupBy("doc_id", (F.col("page") - F.col("printed")).alias("offset")).agg(F.count("*").alias("n"), F.min("page").alias("first"))
    return counts.groupBy("doc_id").agg(F.max_by("offset", F.struct("n", -F.col("first"))).alias("offset"))


def page_context(pages: DataFrame, entries: DataFrame, offsets: DataFrame) -> DataFrame:
    """doc_id and page with the chapter and section in force: the latest entry at or before each page; a chapter clears the section.

    ``entries``: doc_id, title, printed, kind (chapter or section).
    """
    placed = entries.join(offsets, "doc_id").withColumn("page", F.col("printed") + F.col("offset"))
    order = Window.partitionBy("doc_id").orderBy("page", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chapter = F.when(F.col("kind") == "chapter", F.col("title"))
    running = placed.withColumns({"chapter": F.last(chapter, True).over(order), "no": F.count(chapter).over(order)})
    inner = Window.partitionBy("doc_id", "no").orderBy("page", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = running.withColumn("section", F.last(F.when(F.col("kind") == "section", F.col("title")), True).over(inner))
    latest = Window.partitionBy("doc_id", "page").orderBy(F.desc("kind"), F.desc("title"))
    state = running.withColumn("r", F.row_number().over(latest)).where("r = 1").select("doc_id", "page", F.struct("chapter", "section").alias("context"))
    found = as_of(pages, state, "doc_id", "page", "context", "page")
    return found.select("doc_id", "page", "latest_context.chapter", "latest_context.section")


# ---------------------------------------------------------------- questions

#: How questions and headings begin.
QUESTION_START = r"^\s*(?:第\s*(\d{1,3})\s*题[.、:：]?|(\d{1,3})\s*[.、．](?!\d)|[(（](\d{1,3})[)）])\s*"
ANSWER_HEADING = r"(?i)^\s*(?:参考答案|答案|answers?|answer key)(?:与解析)?\s*[:：]?\s*$"
EXPLANATION_HEADING = r"(?i)^\s*(?:解析|试题解析|explanations?)\s*[:：]?\s*$"
CATEGORY_HEADING = r"(?i)^\s*(?:[一二三四五六七八九十]+\s*[、.]\s*\S{0,12}题.*|part\s+\w+.*)$"
HEADINGS = [(kind, re.compile(p, re.ASCII)) for kind, p in (("answer", ANSWER_HEADING), ("explanation", EXPLANATION_HEADING), ("question", CATEGORY_HEADING))]
NUMBERED = re.compile(QUESTION_START, re.ASCII)


def slices_of(text: str) -> list[tuple]:
    """The questions of one text: group, number, question, answer, explanation, suffix."""
    mode, grp = "question", 0
    greatest: dict[tuple, int] = {}
    blocks: dict[tuple, list] = {}
    for line in re.split("\r?\n", text):
        if not line.strip(" "):
            continue
        heading = next((kind for kind, pattern in HEADINGS if pattern.search(line)), None)
        if heading:
            grp += heading == "question" and mode != "question"
            mode = heading
            continue
        own = blocks.setdefault((grp, mode), [])
        begin = NUMBERED.match(line)
        number = int(next(g for g in begin.groups() if g)) if begin else 0
        if number > greatest.get((grp, mode), 0):
            own.append((number, [line[begin.end() :].strip(" ")]))
            greatest[grp, mode] = number
        elif own:
            own[-1][1].append(line.strip(" "))
    near: dict[tuple, str] = {}
    bank: dict[tuple, str] = {}
    for (group, kind), own in sorted(blocks.items()):
        for number, said in own:
            near[kind, group, number] = bank[kind, number] = "\n".join(said)
    asked = [(group, number) for kind, group, number in near if kind == "question"]
    of, seen = Counter(number for _, number in asked), Counter()
    out = []
    for group, number in asked:
        seen[number] += 1
        told = (near.get((kind, group, number), bank.get((kind, number))) for kind in ("answer", "explanation"))
        out.append((group, number, near["question", group, number], *told, f"v:{seen[number]}" if of[number] > 1 else ""))
    return out


def question_slices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per question: doc id, group, number, question, answer, explanation, suffix.

    Lines fall into groups (a category heading after answers begins a new one)
    and into modes (question, answer, explanation) by the last heading before
    them; a numbered line begins a block unless its number is no greater than
    the last question's. Answers and explanations join by number within their
    group, else within the document's last group. A document is sliced where it
    is read: nothing is shuffled, and no more than its own lines are held.
    """
    fields = [("group_no", pa.int32()), ("number", pa.int32()), *((c, pa.string()) for c in ("question", "answer", "explanation", "suffix"))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                found = [(i, *s) for i, text in enumerate(part.column(1).to_pylist()) if text is not None for s in slices_of(text)]
                at, *columns = zip(*found, strict=True) if found else [()] * (len(fields) + 1)
                arrays = [part.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, *(c for c, _ in fields)])

    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, group_no int, number int, question string, answer string, explanation string, suffix string"
    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def slice_audit(slices: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: questions, answers, explanations, repeated numbers, and a class."""
    per = slices.groupBy(id_col).agg(
        F.count("*").alias("questions"),
        F.count("answer").alias("answers"),
        F.count("explanation").alias("explanations"),
        F.count_if(F.col("suffix") != "").alias("repeated"),
    )
    kind = (
        F.when((F.col("answers") == F.col("questions")) & (F.col("explanations") == F.col("questions")), "complete")
        .when((F.col("answers") < F.col("questions")) & (F.col("explanations") == F.col("questions")), "answers_missing")
        .when(F.col("answers") + F.col("explanations") == 0, "source_missing")
        .when(F.col("repeated") > 0, "repeated_numbers")
        .otherwise("partial")
    )
    return per.withColumn("class", kind)


# ---------------------------------------------------------------- tags and titles


#: Bits that tell which strings may be tags; with more tags they tell less, and change no result.
TAG_BITS = 1 << 24
#: Shares of the titles that meet each tag, so that a tag of very many titles is no single task's.
TAG_SHARES = 16


def run_hashes(codes: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """For n = 1, 2 ... the number of a bit of each run of n characters."""
    h = np.zeros(len(codes) + 1, dtype=np.uint64)
    for n in range(1, min(longest, len(codes)) + 1):
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
        x = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        yield n, (x >> np.uint64(40)) & np.uint64(TAG_BITS - 1)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


def tag_bits(vocabulary: DataFrame) -> np.ndarray:
    """A bit of each key is set."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([int(found[0]) for key in batch.column(0).to_pylist() for n, found in run_hashes(code_points(key), len(key)) if n == len(key)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bits)], names=["bit"])

    marks = vocabulary.select("key").mapInArrow(mark, "bit long").groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("bits")).toArrow()
    words = np.zeros(TAG_BITS // 64, dtype=np.uint64)
    words[marks.column("word").to_numpy()] = marks.column("bits").to_numpy().view(np.uint64)
    return words


def contained_tags(titles: DataFrame, tags: DataFrame) -> DataFrame:
    """Tags that stand anywhere in titles, longest first, without those inside another that was taken: title_id, tags.

    Runs of white space in a title count as one space. Of each title only the
    substrings of just the lengths that tags have go on, and of these those
    that a bounded number of bits does not rule out; they meet the tags by
    equality. No title is paired with tags that it does not have.
    """
    vocabulary = tags.select(F.lower(F.trim("tag")).alias("key")).where("key <> ''").distinct()
    lengths = {r.n for r in vocabulary.select(F.char_length("key").alias("n")).distinct().collect()}
    told = titles.sparkSession.sparkContext.broadcast((lengths, tag_bits(vocabulary)))
    whole = titles.select("title_id", F.regexp_replace(F.lower(F.trim("title")), r"\s+", " ").alias("whole")).where("whole <> ''")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, words = told.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            one = "".join(texts)
            ends = np.cumsum([len(t) for t in texts])
            row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            left = ends[row] - np.arange(len(one))
            at, keys = [], []
            for n, bit in run_hashes(code_points(one), max(wanted, default=0)):
                if n in wanted:
                    may = (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
                    hits = np.flatnonzero(may & (left[: len(bit)] >= n))
                    at.append(row[hits])
                    keys += [one[i : i + n] for i in hits.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int64))), pa.array(keys, pa.string())], names=["title_id", "key"])

    kind = dict(titles.dtypes)["title_id"]
    grams = whole.mapInArrow(found, f"title_id {kind}, key string").withColumn("share", F.pmod(F.xxhash64("title_id"), F.lit(TAG_SHARES)).cast("int"))
    hits = grams.join(vocabulary.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(TAG_SHARES - 1)))), ["key", "share"])
    listed = hits.groupBy("title_id").agg(F.array_sort(F.collect_set(F.struct((-F.char_length("key")).alias("n"), "key"))).alias("hits"))
    none = F.array().cast("array<string>")
    taken = F.aggregate("hits.key", none, lambda kept, t: F.when(F.exists(kept, lambda k: F.contains(k, t)), kept).otherwise(F.concat(kept, F.array(t))))
    return listed.select("title_id", taken.alias("tags"))


def similar_titles(titles: DataFrame, labels: DataFrame, least: float = 0.82) -> DataFrame:
    """The best label for each title: equal keys, containment, same letters, or a similar run of letters.

    title_id, label_id, score. Keys of one or two characters score only where
    they are equal or the label's stands in the title's. Pairs that can score
    meet by equality, on one of: three successive letters; a label's whole
    short key; all letters, sorted; one or two successive letters where the
    lengths allow a ratio of ``least`` without longer ones in common.
    """

    def without(n: int) -> float:
        """Letters that two keys of a ratio of ``least`` have together at most, if no ``n`` successive ones are common."""
        # The common runs are n - 1 long at most, and between any two of them a letter is not common.
        rest = least / (2 * (n - 1)) - (1 - least)
        return 1 / rest + 1e-6 if rest > 0 else float("inf")

    # Unlike keys miss a letter at least, so that short ones cannot have the ratio.
    bounds = {n: without(n + 1) for n in (1, 2) if without(n + 1) * (1 - least) > 1 - 1e-4}
    sorted_letters = lambda c: F.array_sort(F.split(c, ""))
    a_long, b_long = F.char_length("a") > 2, F.char_length("b") > 2

    def keyed(df: DataFrame, own: str, text: str, name: str) -> DataFrame:
        keys = df.select(own, structure_key(F.col(text)).alias(name)).where(F.col(name) != "")
        n, none = F.char_length(name), F.array().cast("array<string>")
        runs = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substr(name, i, F.lit(k)))).otherwise(none)
        short = F.when(n <= 2, F.array(F.col(name))).otherwise(none) if name == "b" else F.concat(runs(1), runs(2))
        routes = {"3": runs(3), "b": short, "s": F.when(n > 2, F.array(F.array_join(sorted_letters(F.col(name)), ""))).otherwise(none)}
        routes |= {str(k): F.when((n > 2) & (n <= bound * (1 - least / 2)), runs(k)).otherwise(none) for k, bound in bounds.items()}
        via = lambda r: lambda x: F.struct(F.lit(r).alias("route"), x.alias("part"))
        parts = F.concat(*[F.transform(F.array_distinct(p), via(r)) for r, p in routes.items()])
        return keys.select(own, name, F.explode(parts).alias("p")).select(own, name, "p.route", "p.part")

    both, fewer = F.char_length("a") + F.char_length("b"), F.least(F.char_length("a"), F.char_length("b"))
    apt = F.col("route").isin("3", "b", "s")
    for k, bound in bounds.items():
        apt = apt | ((F.col("route") == str(k)) & (both <= bound) & (2 * fewer >= least * both - 1e-6))
    pairs = keyed(titles, "title_id", "title", "a").join(keyed(labels, "label_id", "label", "b"), ["route", "part"]).where(apt).select("title_id", "label_id", "a", "b").distinct()

    def ratio(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matched = [SequenceMatcher(None, a, b, autojunk=False) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
            # The first two are upper bounds of the last.
            value = [m.ratio() if min(m.real_quick_ratio(), m.quick_ratio()) >= least else 0.0 for m in matched]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value, pa.float64())], names=[*batch.schema.names, "ratio"])

    scored = pairs.mapInArrow(ratio, "title_id long, label_id long, a string, b string, ratio double").withColumn(
        "score",
        F.when(F.col("a") == F.col("b"), 300)
        .when(F.contains("a", "b"), 220)
        .when(a_long & b_long & (sorted_letters("a") == sorted_letters("b")), 200)
        .when(a_long & F.contains("b", "a"), 180)
        .when(a_long & b_long & (F.col("ratio") >= least), (170 + 40 * F.col("ratio")).cast("int")),
    )
    best = Window.partitionBy("title_id").orderBy(F.desc("score"), F.desc(F.char_length("b")), "label_id")
    return scored.where("score IS NOT NULL").withColumn("r", F.row_number().over(best)).where("r = 1").select("title_id", "label_id", "score")
