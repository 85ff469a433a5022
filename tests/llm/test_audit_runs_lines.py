"""Filter audit, runs of words and line dedup against SQL and plain versions."""

import hashlib
import os
import random
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from daybook.llm import filter_audit, line_dedup, runs
from daybook.llm.common import ready

from ..test_queries import table as rows_of
from .helpers import DOCS, crowded, empty, hard_rows, put, table

QUERIES = {"audit": (filter_audit.op11, filter_audit.SQL), "runs": (runs.op12, runs.SQL), "lines": (line_dedup.op13, line_dedup.SQL)}
SHARED = "This passage of forty characters and more is in several documents."


def labels(spark, tmp_path):
    rows = [(k, k % 2, k % 3 % 2) for k in range(12)] + [(None, 1, 1), (5, 1, None), (6, None, 1), (900, 1, 1), (6, 0, 0)]
    put(spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int"), tmp_path, "labels")


def made_rows():
    """Ties, copies, repeats, shared lines, other languages."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(rng.choice(words[: rng.choice([2, 40, 300])]) for _ in range(rng.choice([0, 1, 7, 90, 100, 101, 400]))), rng.choice(["en", "fr", None]), "a", 1) for k in range(120)]
    rows += [(200 + k, rows[k % 4][1], "en", "b", 1) for k in range(40)]
    rows += [(300 + k, f"own {k}\n  {SHARED.upper()}\t\n{SHARED}\nshort\n\n" + "#" * (k % 3), "de", "b", 1) for k in range(30)]
    rows += [(400 + k, "\n".join([SHARED + "é"] * (k + 1)), "de", "c", 1) for k in range(4)]  # in four documents: stays
    rows += [(500, "A long line of text that only copies of one id have, again and again", "en", "c", 1)] * 50
    rows += [(None, f"{SHARED}\nno id", None, None, None)] * 3
    return rows + hard_rows()


@pytest.mark.parametrize("name", QUERIES)
@pytest.mark.parametrize("case", ["made", "hard", "data", "empty"])
def test_queries_match_sql(spark, tmp_path, name, case):
    sf = "/root/testdata/sf0.001"
    if case != "data":
        sf = put({"made": lambda: crowded(spark, made_rows()), "hard": lambda: crowded(spark), "empty": lambda: empty(spark)}[case](), tmp_path)
        labels(spark, tmp_path)
    elif not os.path.isdir(sf):
        pytest.skip("no test data")
    query, sql = QUERIES[name]
    got = query(spark, sf)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        at = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}{'/*.parquet' if os.path.isdir(at) else ''}'")
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, got.collect()) == rows_of(columns, want.fetchall())


# --- 11


def test_audit_is_the_plain_replay(spark, tmp_path):
    labels(spark, tmp_path)
    rows = made_rows()
    good = {k for k in range(12) if k % 2} | {5}
    toxic = {k for k in range(12) if k % 3 % 2} | {6}
    first = {}
    for doc, text, *_ in rows:
        if doc is not None:
            first[text or ""] = min(first.get(text or "", doc), doc)
    flags = []
    for doc, text, lang, *_ in rows:
        text = text or ""
        words = text.encode().split()
        fails = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words)) + "C" * (100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text))
        fails += "D" * any(c in "#$%&*|" for c in text) + "E" * (doc is not None and doc > first[text])
        flags.append((lang or "", fails, doc in good, doc in toxic))
    want, over = {}, {}
    for order in permutations("ABCDE"):
        for part, fails, g, t in flags:
            at = next((k for k, c in enumerate(order, 1) if c in fails), 6)
            for k, c in enumerate(order, 1):
                n = want.setdefault((part, "".join(order), k), [0] * 6)
                for i, x in enumerate((at > k, at == k, at < k and c in fails, fails == c, at == k and g, at == k and t)):
                    n[i] += x
                over[part, c] = over.get((part, c), 0) + (at == k)
    got = {(r.part, r.filter_order, r.step): ([r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost], r.shapley) for r in filter_audit.op11(spark, put(crowded(spark, rows), tmp_path)).collect()}
    assert got == {k: (n, over[k[0], k[1][k[2] - 1]]) for k, n in want.items()}


@pytest.mark.parametrize("hot", [1, 3, 10_000])
def test_copies_are_found_whether_their_text_is_hot_or_not(spark, monkeypatch, hot):
    monkeypatch.setattr(filter_audit, "HOT", hot)
    rows = made_rows()
    made = filter_audit.with_copies(filter_audit.failures(table(spark, rows)).cache())
    first = {}
    for doc, text, *_ in rows:
        if doc is not None:
            first[text or ""] = min(first.get(text or "", doc), doc)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fails & filter_audit.COPY > 0) for r in made.collect())
    assert got == sorted((d is None, d or 0, d is not None and d > first[t or ""]) for d, t, *_ in rows)


# --- 12


def plain_runs(words, exponent, least):
    n, found = len(words), {}
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i > start and i - start + p >= max(least, exponent * p):
                found.setdefault((start, i - start + p), p)
            i += i == start
    return sorted((s, p, length) for (s, length), p in found.items())


def test_runs_are_the_plain_ones():
    rng = random.Random(3)
    for _ in range(600):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n, letters = rng.choice([0, 1, 2, rng.randint(0, 60), rng.randint(0, 200)]), rng.randint(1, 4)
            text = [rng.randrange(letters) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // rng.randint(2, 9)))
                text = [text[i if i < a else a + (i - a) % p] for i in range(n)] + [rng.randrange(letters) for _ in range(rng.choice([0, 20]))]
            texts.append(text)
        exponent, least = rng.choice([2, 3, 4, 4]), rng.choice([1, 6])
        made = runs.runs_of(np.array([x for t in texts for x in t], np.int64), [len(t) for t in texts], exponent, least)
        got = [(k, s, p, length) for k, s, length, p in zip(*(x.tolist() for x in made), strict=True)]
        assert got == [(k, *r) for k, t in enumerate(texts) for r in plain_runs(t, exponent, least)]


@pytest.mark.parametrize(("word", "want"), [("aaaaaa", [(0, 6, 1)]), ("aaaaa", []), ("abababab", [(0, 8, 2)]), ("xabababay", []), ("abcabcabcabcab", [(0, 14, 3)]), ("aabaabaabaabaaaaaa", [(12, 6, 1), (0, 14, 3)])])
def test_fixed_runs(word, want):
    _, start, length, period = runs.runs_of(np.array([ord(c) - 97 for c in word]), [len(word)])
    assert sorted(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == sorted(want)


def test_runs_of_other_exponents_are_refused():
    with pytest.raises(ValueError):
        runs.runs_of(np.zeros(3, np.int64), [3], exponent=1)


def test_a_partition_moves_each_word_few_times(monkeypatch):
    """The smaller-half strategy: moved positions stay within n log n, here far below n times the levels."""
    moved = []
    real = runs.Partition._to_the_tail
    monkeypatch.setattr(runs.Partition, "_to_the_tail", lambda self, at, *rest: (moved.append(len(at)), real(self, at, *rest))[1])
    n = 4000
    runs.runs_of(np.arange(n) % 500, [n])
    assert sum(moved) <= n * 12


def test_run_operator_keeps_columns_and_collapses(spark):
    ready(spark)
    text = "begin " + "all work no play " * 5 + "end"
    df = spark.createDataFrame([(1, text, "x", "y"), (2, None, None, "z"), (None, "a a a a a a", "k", None)], "doc_id bigint, text string, runs string, lang string")
    got = sorted(runs.find_runs(df, keep=["lang", "runs"]).collect(), key=lambda r: r.doc_id or 9)
    assert [(r.doc_id, r.lang, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got] == [(1, "y", 22, [(1, 20, 4)], "begin all work no play end"), (2, "z", 0, [], ""), (None, None, 6, [(0, 6, 1)], "a")]


def test_planted_repeats_are_the_plain_ones(spark):
    rows = [(k, " ".join(f"w{k}.{i}" for i in range(k % 37)), "en", "a", 1) for k in range(300)] + hard_rows()
    got = {(r.doc_id, r.text): r.t for r in table(spark, rows).withColumn("t", runs.repeating(F.col("doc_id"), F.coalesce("text", F.lit("")))).collect()}
    for doc, text, *_ in rows:
        words = (text or "").encode().split()
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        want = words
        if h % 10 == 0 and words:
            n = len(words)
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            want = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        assert got[doc, text].encode().split() == want


# --- 13


def key(line):
    return line.encode().strip().lower().decode()


def lines_plain(rows):
    held = {}
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= 40:
                held.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(held.get(key(x), ())) < 5 or len(key(x)) < 40 or doc == max(held[key(x)])]
        out.append((doc is not None, doc or 0, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def crowd():
    """One line in most documents, several in four to six, over many range partitions."""
    rng = random.Random(8)
    rows = []
    for k in range(700):
        lines = [f"line {k} {i} " + "x" * rng.choice([5, 40]) for i in range(rng.randint(0, 5))] + [f"{SHARED} {i}" for i in rng.sample(range(150), 3)]
        if k % 3:
            lines.insert(0, SHARED)
        rng.shuffle(lines)
        rows.append((k // 2 * 2 if k > 600 else k, "\n".join(lines), "en", "a", 1))
    return rows


@pytest.mark.parametrize("partitions", [1, 16, 64])
def test_lines_over_many_partitions(spark, tmp_path, partitions):
    rows = crowd() + hard_rows()
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for k, v in zip(old, (str(partitions), "false", "7"), strict=True):
            spark.conf.set(k, v)
        got = line_dedup.op13(spark, put(crowded(spark, rows), tmp_path)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == lines_plain(rows)


def test_streams_cut_anywhere_agree():
    """Partitions and batches cut at random: what streams decide and pass on is what a plain look at all rows gives."""
    rng = random.Random(2)
    name = lambda k: bytes([k] * 16)
    for _ in range(300):
        rows = sorted({(rng.choice([1, 2, 3, 3, 3]), -rng.randrange(9), rng.randrange(3)) for _ in range(rng.randint(1, 60))})
        docs = {}
        for k, doc, _ in rows:
            docs.setdefault(k, set()).add(-doc)
        want = {(k, -doc, m) for k, doc, m in rows if len(docs[k]) >= 5 and -doc < max(docs[k])}
        cut = sorted(rng.sample(range(len(rows) + 1), rng.randint(0, min(4, len(rows)))))
        goes, open_, seen = set(), set(), {}
        for a, b in zip([0, *cut], [*cut, len(rows)], strict=True):
            stream, given, i = line_dedup.Stream(5), [], a
            while i < b:
                j = min(b, i + rng.randint(1, 9))
                h, doc, mark = zip(*rows[i:j], strict=True)
                # n_lines tells the key in this test
                given.append(stream.feed(pa.table([pa.array([name(k) for k in h], pa.binary()), pa.array([-d for d in doc], pa.int64()), pa.array(mark, pa.int64()), pa.array(h, pa.int32()), pa.array([b""] * len(h), pa.binary())], ["h", "doc_id", "mark", "n_lines", "at"])))
                i = j
            given.append(stream.end())
            for t in given:
                for r in t.to_pylist() if t is not None else []:
                    if r["h"] is None:
                        goes.add((r["n_lines"], r["doc_id"], r["mark"]))
                        continue
                    seen.setdefault(r["h"], set()).add(r["doc_id"])
                    if r["at"] is not None:
                        open_.add((r["h"], r["n_lines"], r["doc_id"], r["mark"]))
        assert len(seen) <= 2 * (len(cut) + 1)
        goes |= {(k, d, m) for h, k, d, m in open_ if len(seen[h]) >= 5 and d < max(seen[h])}
        assert goes == want


def test_bitmaps_and_kept_columns(spark):
    ready(spark)
    rows = [(k, f"{SHARED}\nown line {k}", "en", "a", 1) for k in range(6)] + [(50, None, None, None, None)]
    maps = {r.doc_id: r for r in line_dedup.keep_bitmaps(crowded(spark, rows)).collect()}
    assert sorted(maps) == [0, 1, 2, 3, 4] and all((m.n_lines, m.n_dropped) == (2, 1) for m in maps.values())
    assert zlib.decompress(maps[0].keep) == b"\x40" and line_dedup.kept_lines("a\nb", maps[0].keep) == "b"
    out = line_dedup.without_repeats(crowded(spark, rows))
    assert out.columns == [*crowded(spark, rows).columns, "n_lines", "n_dropped", "kept"]
    assert {r.doc_id: r.kept for r in out.collect()} == {k: f"own line {k}" for k in range(5)} | {5: rows[5][1], 50: ""}


def test_a_task_sends_equal_rows_once(spark):
    ready(spark)
    df = spark.createDataFrame([(1, SHARED, "en", "a", 1)] * 5000, DOCS).coalesce(1)
    assert line_dedup.keyed(df).count() == 1


@pytest.mark.parametrize("query", [filter_audit.op11, runs.op12, line_dedup.op13])
def test_empty(spark, tmp_path, query):
    labels(spark, tmp_path)
    assert query(spark, put(empty(spark), tmp_path)).collect() == []
