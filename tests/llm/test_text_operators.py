"""Line dedup, Jaccard join, mixing and repeated substrings against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from logweir.llm import chunks, jaccard_join, line_dedup, mixing, suffix_dedup
from logweir.llm.common import Scratch, least_hashes
from logweir.llm.components import components
from logweir.storage import shared_dir

BLANKS = "\t\n\x0b\x0c\r "
FOLD = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(frame, *names):
    return Counter(tuple(r[n] for n in names) for r in frame.collect())


def test_line_dedup(documents, pairs, folder):
    holders = defaultdict(set)
    key = lambda line: line.strip(BLANKS).translate(FOLD)
    for i, t in pairs:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    rank = lambda i: -1 if i is None else i
    want = Counter()
    for i, t in pairs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or rank(i) == max(map(rank, holders[key(x)]))]
        want[i, len(lines), len(lines) - len(kept), sha("\n".join(kept))] += 1
    got = line_dedup.op1(documents.sparkSession, folder)
    assert rows_of(got, "doc_id", "n_lines", "n_dropped", "kept_sha256") == want
    assert sum(k[2] for k in want) > 5
    out = line_dedup.drop_repeated_lines(documents)
    assert out.columns == [*documents.columns, "__n_lines", "__n_dropped"] and out.count() == len(pairs)
    assert line_dedup.drop_repeated_lines(documents.limit(0)).count() == 0


def shingles(text):
    words = (text or "").encode().lower().split()
    k = min(5, len(words))
    return frozenset(b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def brute_components(pairs):
    """By text and by id, as rows that repeat an id are one node."""
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    named = [(i, shingles(t)) for i, t in pairs if i is not None]
    for n, (i, s) in enumerate(named):
        for j, t in named[:n]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: find(i) for i, _ in named}


def test_jaccard_join(documents, pairs, folder):
    component = brute_components(pairs)
    want = Counter((i, len(shingles(t)), component.get(i)) for i, t in pairs)
    got = jaccard_join.op2(documents.sparkSession, folder)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == want
    assert any(c != i for i, c in component.items())


def test_jaccard_keeps_one(documents, pairs):
    component = brute_components(pairs)
    out = jaccard_join.keep_one(documents)
    assert out.columns == documents.columns
    got = Counter(r["doc_id"] for r in out.collect())
    assert got == Counter({i: 1 for i, c in component.items() if i == c}) + Counter({None: 2})


def test_jaccard_empty(documents):
    assert jaccard_join.near_duplicates(documents.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_region_join_is_exact(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(12):
        base = rng.choice(5000, 60, replace=False)
        for _ in range(14):
            own = base.copy()
            own[rng.choice(60, rng.integers(0, 14), replace=False)] = rng.integers(5000, 10**6)
            sets.append(np.unique(own).astype(np.uint64))
    links = jaccard_join.join_region([len(s) for s in sets], sets, [], 75)

    def classes(pairs):
        up = list(range(len(sets)))

        def find(i):
            while up[i] != i:
                i = up[i]
            return i

        for i, j in pairs:
            a, b = sorted((find(i), find(j)))
            up[b] = a
        return [find(i) for i in range(len(sets))]

    every = []
    for i in range(len(sets)):
        for j in range(i):
            inter = len(np.intersect1d(sets[i], sets[j]))
            if 100 * inter >= 75 * (len(sets[i]) + len(sets[j]) - inter):
                every.append((i, j))
    assert classes(links) == classes(every) and set(map(frozenset, links)) <= set(map(frozenset, every))


def test_strips_split_large_regions(documents, spark):
    """A group of near copies larger than a strip: the same components."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(90):
        words = list(base)
        for k in rng.sample(range(80), 1 + i % 5):
            words[k] = f"x{i}{k}"
        texts.append((i, " ".join(words)))
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    scratch = Scratch(spark, "strips")
    parts = chunks.Chunks(frame, scratch)
    parts.count_keys(1, lambda d: np.concatenate(jaccard_join.shingle_sets(d.texts, 5)))
    sets = scratch.write(parts.each(lambda d: jaccard_join._sets(d, 5, 75), jaccard_join._SETS))
    found = components(jaccard_join.find_links(sets, scratch, strip=8), scratch)
    got = {r["node"]: r["component"] for r in found.collect()}
    assert {i: got.get(i, i) for i, _ in texts} == brute_components(texts)


def test_texts_of_one_id_keep_their_links(spark):
    """Two texts of doc_id 5 meet in the region of pivot 1; each is near one other document."""
    sets = {(1, 0): range(300, 339), (5, 1): range(100, 139), (5, 2): range(200, 239), (7, 3): [*range(100, 138), 900], (8, 4): [*range(200, 238), 901]}
    rows = [(h, h, i, 40, 1, np.array([1, *own], np.uint64).tobytes()) for (i, h), own in sets.items()]
    scratch = Scratch(spark, "one-id")
    frame = scratch.write(spark.createDataFrame([(a, b, i, n, p, bytearray(s)) for a, b, i, n, p, s in rows], jaccard_join._SETS))
    got = components(jaccard_join.find_links(frame, scratch), scratch)
    assert {r["node"]: r["component"] for r in got.collect()} == {7: 5, 8: 5}


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101), (103, 200)]
    random.Random(2).shuffle(chain)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark, "cc")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 103: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "cc")).count() == 0


def test_repeated_substrings(documents, pairs, folder):
    raw = [(i, (t or "").encode()) for i, t in pairs]
    seen = Counter(b[k : k + 200] for _, b in raw for k in range(len(b) - 199))
    want = Counter()
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    got = suffix_dedup.op4(documents.sparkSession, folder)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert suffix_dedup.repeated_spans(documents.limit(0)).count() == 0


def test_spans_survive_segments(spark, monkeypatch):
    """Texts longer than a hashing batch are parsed in overlapping segments."""
    monkeypatch.setattr(suffix_dedup, "BATCH", 700)
    rng = random.Random(3)
    shared = bytes(rng.choices(range(97, 123), k=900))
    texts = [bytes(rng.choices(range(97, 123), k=1500)) + shared + bytes(rng.choices(range(97, 123), k=1100)) for _ in range(2)]
    windows = {(b.text[n], s) for b in suffix_dedup.phrases(texts) for n in range(len(b.first)) for s in range(b.first[n], b.last[n] + 1)}
    assert windows == {(i, s) for i, t in enumerate(texts) for s in range(len(t) - 199)}


def words(text):
    import re

    return re.findall("[^\\x20\\x09-\\x0d]+", text or "")


def test_mixing(documents, pairs, folder):
    spark = documents.sparkSession
    got = mixing.op3(spark, folder).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(words(t))) for i, t in pairs)
    source = {}
    for r in documents.collect():
        source.setdefault(r["source"], []).append(len(words(r["text"])))
    order = sorted((s for s in source if s is not None), key=lambda s: s.encode()) + [None]
    size = [sum(source[s]) for s in order]
    weight = [(5, 2, 1)[k % 3] for k in range(len(order))]
    target, free = [0.0] * len(order), set(range(len(order)))
    while True:
        rest = sum(size) - sum(3 * size[k] for k in range(len(order)) if k not in free)
        over = {k for k in free if rest * weight[k] / sum(weight[j] for j in free) > 3 * size[k]}
        for k in free:
            target[k] = rest * weight[k] / sum(weight[j] for j in free)
        if not over:
            break
        for k in over:
            target[k] = 3.0 * size[k]
        free -= over
    by = {s: round(t, 6) for s, t in zip(size, target, strict=True)}
    assert {r["source_size"]: round(r["target"], 6) for r in got} == by
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source_size"]] += r["taken"]
    assert all(abs(taken[s] - t) <= 1 for s, t in by.items() if s)
    again = mixing.op3(spark, folder)
    assert rows_of(again, "doc_id", "size", "taken") == Counter((r["doc_id"], r["size"], r["taken"]) for r in got)


def test_curriculum_takes_what_the_mix_says(documents):
    mixed = Counter()
    for r in mixing.mixed(documents).collect():
        mixed[r["doc_id"]] += r["__taken"]
    out = mixing.curriculum(documents)
    assert out.columns == documents.columns
    placed = Counter()
    for r in out.collect():
        placed[r["doc_id"]] += len(words(r["text"]))
    assert +placed == +mixed
    assert mixing.curriculum(documents.limit(0)).count() == 0


def test_schedules_decide_the_order(documents):
    """Positions invert the cumulative demand, and with other schedules they move, not the amounts."""
    rows = mixing.mixed(documents).collect()
    kinds = {s: k % 3 for k, s in enumerate(sorted({r["source"] for r in rows if r["source"] is not None}, key=lambda s: s.encode()) + [None])}
    for r in rows:
        start, end = mixing.SCHEDULES[kinds[r["source"]]]
        for n, c in enumerate(r["__copies"]):
            assert 0 <= c["at"] < 1 and c["epoch"] == n and 0 < c["words"] <= r["__size"]
            # The demand up to the position is a whole number of words, those before the copy.
            steps = np.linspace(0, c["at"], 2001)
            met = np.trapezoid(start + (end - start) * steps, steps) * r["__target"]
            assert abs(met - round(met)) < 1e-3
    flat = {(r["doc_id"], r["text"]): r["__taken"] for r in mixing.mixed(documents, schedules=((1.0, 1.0),)).collect()}
    assert flat == {(r["doc_id"], r["text"]): r["__taken"] for r in rows}
    # A source that fades comes earlier on the whole than one that grows.
    early = [c["at"] for r in rows if kinds[r["source"]] == 0 for c in r["__copies"]]
    late = [c["at"] for r in rows if kinds[r["source"]] == 2 for c in r["__copies"]]
    assert np.mean(early) < np.mean(late)


def test_sql_on_documents(folder):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet' where doc_id < 200")
    assert con.execute(line_dedup.OP1_SQL).fetchall() and con.execute(mixing.OP3_SQL).fetchall()


def test_samples_and_scratch(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("h"), "id")
    want = sorted(tuple(r) for r in rows.collect())[:40]
    assert sorted(tuple(r) for r in least_hashes(rows, "h", 40).collect()) == want
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir", shared_dir(spark)).rstrip("/")
