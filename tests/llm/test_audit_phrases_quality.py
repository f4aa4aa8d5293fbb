"""Filter audit, phrase mining and quality rules against brute force, with awkward rows."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SCHEMA

from logweir.llm import filter_audit, phrases, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _empty(spark):
    return spark.createDataFrame([], SCHEMA)


# Filter audit.


def _fails(text):
    words = WORD.findall(text)
    return [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text))]


def _audit(rows, labels):
    """rows: (doc_id, lang, text); labels: doc_id to (good, toxic)."""
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    parts = defaultdict(list)
    for i, lang, t in rows:
        failed = {f for f, b in zip("ABCD", _fails(t or ""), strict=True) if b}
        if i is not None and i > first[t or ""]:
            failed.add("E")
        parts[lang or ""].append((failed, *labels.get(i, (0, 0))))
    out = {}
    for part, docs in parts.items():
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in d[0] for d in docs) - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def _rows_of(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 0, 1), (11, 1, None), (11, 0, 1), (300, None, 1), (None, 1, 1), (400, 1, 1), (13, 1, 0), (205, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("held", [filter_audit.CHAIN_BYTES, 500])
def test_audit(documents, labels, monkeypatch, held):
    """Also where chains are sent on early, and over many partitions."""
    monkeypatch.setattr(filter_audit, "CHAIN_BYTES", held)
    rows = [(r["doc_id"], r["lang"], r["text"]) for r in documents.collect()]
    want = {1: (1, 0), 2: (0, 1), 11: (1, 1), 300: (0, 1), 400: (1, 1), 13: (1, 0), 205: (1, 1)}
    assert _rows_of(filter_audit.audit(documents, labels)) == _audit(rows, want)


def test_audit_keeps_colliding_texts_apart(spark, labels, monkeypatch):
    rows = [(i, "en" if i % 2 else None, f"text {i % 3}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    links = filter_audit.Chains()
    found = [links.add(7, f"t{i % 3}".encode(), 9 - i, {("", 0): 1}) for i in range(6)]
    assert [f and f[0] for f in found] == [None, None, None, 9, 8, 7]
    assert sorted(x[2] for x in links.drain()) == [4, 5, 6]
    assert _rows_of(filter_audit.audit(docs, labels.limit(0))) == _audit(rows, {})


def test_audit_empty(spark, labels):
    assert filter_audit.audit(_empty(spark), labels).count() == 0


# Phrases.


def _phrases(rows, least=10, top=2000):
    counts = defaultdict(Counter)
    totals = Counter()
    for lang, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for n in (1, 2, 3):
                counts[lang or "und"].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = set()
    for lang, f in counts.items():
        every = []
        for p, a in f.items():
            if len(p) == 1 or a < least:
                continue
            if len(p) == 2 and any(len(q) == 3 and b >= least and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in f.items()):
                continue
            cut = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            every.append((-cut[0], -a, " ".join(p).encode(), f[p[: cut[1]]], f[p[cut[1] :]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(every)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return out


@pytest.fixture(scope="module")
def texts(spark):
    from random import Random

    rng = Random(3)
    words = ["a", "b", "ä", "New", "york", "the", "x\x00y", "ß", "😀", "ab"]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "\x0b", " \r"]) for _ in range(rng.randint(0, 60)))) for _ in range(150)]
    rows += [("en", None), ("en", ""), (None, " "), ("fr", "the the the the. " * 6), ("fr", "the the " * 5), ("en", "only once"), ("es", "a b c! " * 12)]
    return spark.createDataFrame([(i // 2 if i % 9 else None, lang, t, "x") for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, word string").repartition(3), rows


@pytest.mark.parametrize("small", [False, True])
def test_phrases(texts, monkeypatch, small):
    """Also with many chunks, hot pivots and small buffers."""
    docs, rows = texts
    if small:
        monkeypatch.setattr(phrases, "CHUNK_BYTES", 1000)
        monkeypatch.setattr(phrases, "LOAD", 40)
        monkeypatch.setattr(phrases, "BUFFER", 100)
    got = {tuple(r) for r in phrases.collocations(docs).collect()}
    assert got == _phrases(rows)
    assert {tuple(r) for r in phrases.collocations(docs, least=3, top=7).collect()} == _phrases(rows, 3, 7)


def test_phrases_of_awkward_documents(documents, spark):
    rows = [(r["lang"], r["text"]) for r in documents.collect()]
    assert {tuple(r) for r in phrases.collocations(documents).collect()} == _phrases(rows)
    assert phrases.collocations(_empty(spark)).count() == 0


def test_each_phrase_belongs_to_one_fragment():
    rng = np.random.default_rng(1)
    for size in (0, 1, 2, 3, 400):
        t = rng.integers(0, 6, size)
        got = Counter()
        (p, *around), n = phrases.fragments(t)
        words, counts = phrases.phrases_of(p, *around, n)
        for *w, c in zip(*words, counts, strict=True):
            got[tuple(int(x) for x in w if x)] += int(c)
        want = Counter(tuple(int(x) for x in t[i : i + k]) for k in (2, 3) for i in range(size - k + 1) if t[i : i + k].all())
        assert got == want


def test_large_scores_are_exact(spark):
    rows = [(10**12 - 1, 10**12 + 7, 10**12 - 1), (3, 7, 11), (10**12, 10**12, 10**12)]
    df = spark.createDataFrame(rows, "a long, l long, r long").withColumn("s", phrases._score("a", "l", "r"))
    assert [r["s"] for r in df.collect()] == [1000000 * a * a // (left * r) for a, left, r in rows]


# Quality rules.


def _base(text):
    text = text or ""
    words = WORD.findall(text)
    runs = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + k for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, copies = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            copies += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), copies, len(again), failed


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_counts(documents, spark):
    rng = np.random.default_rng(2)
    odd = ["a b c a b c", "x\n x\nx\n\n\nx", "a\x0bb\x0cc\rd\te", "#*$%&|<> [x]", "ä ö ü " * 30, "line one two\n" * 40, "y" * 300_000 + " z", "\n".join("".join(rng.choice(list("ab \n#"), 50)) for _ in range(40))]
    docs = documents.unionByName(spark.createDataFrame([(9000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"), allowMissingColumns=True)
    got = quality_rules.judged(docs, None)
    assert got.columns[: len(docs.columns)] == docs.columns
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r[c] for c in BASE) == _base(r["text"]), r["doc_id"]
        assert r["kept"] == (not r["base_failed"])


def test_viterbi_against_every_labelling():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 8):
        field = quality_rules.Field(rng.normal(size=4), rng.normal(), rng.normal(size=(2, 2)))
        x = rng.integers(0, 2, (n, 4))

        def score(labels, field=field, x=x):
            total = labels[0] * field.start + sum(b * float(x[i] @ field.weights) for i, b in enumerate(labels))
            return total + sum(field.steps[a, b] for a, b in itertools.pairwise(labels))

        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert tuple(field.decode(x)) == best


def test_likelihood_against_every_labelling():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 2, (n, 3)) for n in (1, 3, 4)]
    labels = [rng.integers(0, 2, len(t)) for t in texts]
    theta = rng.normal(size=8)

    def value(v):
        w, start, steps = v[:3], v[3], v[4:].reshape(2, 2)
        total = 0.0
        for x, y in zip(texts, labels, strict=True):
            def score(s, x=x):
                return s[0] * start + sum(b * float(x[i] @ w) for i, b in enumerate(s)) + sum(steps[a, b] for a, b in itertools.pairwise(s))
            total += np.log(sum(np.exp(score(s)) for s in itertools.product((0, 1), repeat=len(x)))) - score([int(b) for b in y])
        return total / 8 + 0.01 * v @ v / 2

    sizes = np.array([1, 3, 4])
    step = np.arange(4)[:, None]
    there = step < sizes
    at = np.where(there, (np.cumsum(sizes) - sizes) + step, 0)
    got, gradient = quality_rules._likelihood(theta, np.concatenate(texts).astype(float), np.concatenate(labels), at, there, 0.01)
    assert np.isclose(got, value(theta))
    for k in range(8):
        up, down = theta.copy(), theta.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        assert np.isclose(gradient[k], (value(up) - value(down)) / 2e-5, atol=1e-6)


def _prose(rng):
    return "\n".join(" ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(rng.randint(8, 20))).capitalize() + "." for _ in range(8))


def _junk(rng):
    return "\n".join(" | ".join("".join(rng.choices("ABCDEFGH", k=6)) for _ in range(12)) + " ###" for _ in range(8))


def test_the_field_learns_and_decides(spark, documents):
    from random import Random

    rng = Random(8)
    kinds = [i % 3 == 0 for i in range(240)]
    texts = [_junk(rng) if bad else _prose(rng) for bad in kinds]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(None, texts[0], None), (5, None, None), (7, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(not bad)) for i, bad in enumerate(kinds) if i < 180] + [(None, 1), (181, None)], "doc_id long, quality int")
    field = quality_rules.fit(docs, labels)
    again = quality_rules.fit(docs, labels)
    assert np.array_equal(field.weights, again.weights) and np.array_equal(field.steps, again.steps)
    for r in quality_rules.judged(docs, field).collect():
        (one,) = quality_rules.measured([r["text"]])
        share = quality_rules.content_share(field.decode(one.features), one.words)
        assert r["content_share"] == share
        assert r["kept"] == (not r["base_failed"] and share >= quality_rules.SHARE)
        if r["doc_id"] is not None and r["text"]:
            assert r["kept"] == (not kinds[r["doc_id"]])
    assert quality_rules.fit(docs, labels.where("quality = 1")) is None
    assert quality_rules.fit(docs, labels.limit(0)) is None
    assert quality_rules.judged(_empty(spark), field).count() == 0
    assert quality_rules.fit(_empty(spark), labels) is None


def test_held_out_texts(spark):
    """On labelled texts that were not learnt from, at most few of either kind are misjudged."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_rules.judged(docs, quality_rules.fit(docs, labels)).join(labels, "doc_id").where(quality_rules.held_out(labels["doc_id"])).where("not base_failed").collect()
    good, bad = ([r["kept"] for r in out if r["quality"] == q] for q in (1, 0))
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.2 * len(bad)
