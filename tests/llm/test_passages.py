"""op6 against an exact search for repeated runs of words, and its recall on edited passages around a common phrase."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import words as word_list
from wellstream.llm import passages
from wellstream.llm.common import ALNUM_BYTES, shingles_of, words_of


def test_every_repeated_run_of_fifty_words_is_linked(documents, monkeypatch):
    monkeypatch.setattr(passages, "SLICE_BYTES", 20_000)
    holders = defaultdict(set)
    for row in documents.select("doc_id", "text").collect():
        words = word_list(row.text)
        for i in range(len(words) - 49):
            holders[tuple(words[i:i + 50])].add(row.doc_id)
    shared = [ids for ids in holders.values() if len(ids) > 1]
    assert shared
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    classes = {}
    for row in passages.repeated_passages(documents).collect():
        parent[root(row.doc_id)] = root(row.other_id)
        classes[row.doc_id] = classes[row.other_id] = row.class_id
    assert all(len({root(x) for x in ids}) == 1 for ids in shared)
    assert all(len({classes[x] for x in ids}) == 1 for ids in shared)


@pytest.mark.parametrize("side, edits, least", [(20, 0, 1.0), (20, 1, 0.95), (60, 2, 0.98)])
def test_edited_passages_around_a_phrase_of_all_documents(spark, monkeypatch, side, edits, least):
    monkeypatch.setattr(passages, "SLICE_BYTES", 60_000)
    rng = random.Random(5)
    new = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    phrase, documents, wanted = new(40), [], set()
    for i in range(100):
        body = new(side // 2) + phrase + new(side // 2)
        other = list(body)
        for _ in range(edits):
            other[rng.randrange(len(other))] = f"edit{rng.randrange(10**6)}"
        both = [new(80) + w + new(80) for w in (body, other)]
        documents += [(2 * i + j, " ".join(w)) for j, w in enumerate(both)]
        a, b = (np.array([hash(tuple(w[k:k + 5])) for k in range(len(w) - 4)]) for w in both)
        if passages.alike(a, b, np.array([[80, 80]])):  # with the place given, nothing has to be found
            wanted.add(i)
    frame = spark.createDataFrame(documents, "doc_id long, text string").repartition(4)
    pairs = passages.repeated_passages(frame).select("doc_id", "other_id").distinct().collect()
    assert all(r.doc_id // 2 == r.other_id // 2 for r in pairs)
    assert len(wanted) >= 95 and len({r.doc_id // 2 for r in pairs} & wanted) >= least * len(wanted)


def test_no_passage_with_an_edit_around_a_phrase_of_all_documents_is_missed(spark, monkeypatch):
    monkeypatch.setattr(passages, "SLICE_BYTES", 100_000)
    rng = random.Random(7)
    new = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    phrase, documents, wanted = new(44), [], set()
    for i in range(200):
        body = new(7) + phrase + new(7)
        other = list(body)
        other[rng.randrange(len(other))] = "edit"
        both = [new(80) + w + new(80) for w in (body, other)]
        documents += [(2 * i + j, " ".join(w)) for j, w in enumerate(both)]
        a, b = (np.array([hash(tuple(w[k:k + 5])) for k in range(len(w) - 4)]) for w in both)
        if passages.alike(a, b, np.array([[80, 80]])):
            wanted.add(i)
    frame = spark.createDataFrame(documents, "doc_id long, text string").repartition(4)
    pairs = passages.repeated_passages(frame).select("doc_id", "other_id").distinct().collect()
    assert len(wanted) >= 190 and {r.doc_id // 2 for r in pairs if r.doc_id // 2 == r.other_id // 2} >= wanted


def split_all(documents):
    bitmap = np.full(passages.SPLIT_WORDS, 2**64 - 1, dtype=np.uint64)
    return passages.split_pairs(documents, bitmap, passages.PERCENT, passages.PASSAGE_WORDS).collect()


def test_few_documents_that_share_a_phrase_only_are_paired(spark, monkeypatch):
    monkeypatch.setattr(passages, "SLICE_BYTES", 2_400)
    rng = random.Random(9)
    new = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    phrase = new(35)
    rows = [(i, " ".join(new(80) + phrase + new(80))) for i in range(60)]
    found = split_all(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert len({(r.doc_id, r.other_id) for r in found}) < 30


def test_a_pair_that_shares_many_runs_has_one_place(spark, monkeypatch):
    monkeypatch.setattr(passages, "SLICE_BYTES", 20_000)
    text = " ".join(f"z{i}" for i in range(5000))
    (found,) = split_all(spark.createDataFrame([(1, text), (2, "ahead " + text)], "doc_id long, text string").coalesce(1))
    assert {found.doc_id: found.start_word, found.other_id: found.other_start} == {1: found.other_start, 2: found.start_word}
    assert found.doc_id == 2 and found.start_word == found.other_start + 1 and found.end_word is None


@pytest.mark.parametrize("percent, words", [(80, 50), (50, 50), (90, 30)])
def test_alike_passages_share_a_run(percent, words):
    rng, run = np.random.default_rng(3), passages.shared_run(percent, words)
    for _ in range(300):
        a = rng.integers(0, 1 << 60, 3 * words)
        b = a.copy()
        b[rng.integers(0, len(b), rng.integers(1, 6))] = 0
        x, y = (np.array([hash(tuple(w[k:k + 5].tolist())) for k in range(len(w) - 4)]) for w in (a, b))
        for start, end, _, _ in passages.alike(x, y, np.array([[0, 0]]), percent, words):
            equal = (x == y)[start:end - 4]
            assert max(map(len, "".join(".x"[int(e)] for e in equal).split("."))) >= run


def test_a_word_said_over_and_over_does_not_hide_a_passage():
    text = np.concatenate((np.full(43, 7), np.arange(100, 130)))  # shingles
    centres = np.array([[0, 0], [60, 60], *([0, d] for d in range(1, 23))])
    assert passages.alike(text, text, centres) == [(0, 77, 0, 77)]


def test_nulls_empty_and_repeated_rows(spark):
    text = " ".join(f"x{i}" for i in range(60))
    rows = [(1, text, 5), (1, text, 6), (2, text, 7), (None, text, 8), (3, None, 9), (4, "", 9), (5, "few words", 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, key long")
    found = passages.repeated_passages(frame).collect()
    assert {(frozenset((r.doc_id, r.other_id)), r.start_word, r.end_word, r.class_id) for r in found} == {(frozenset((1, 2)), 0, 60, 1)}
    assert passages.repeated_passages(frame.limit(0)).count() == 0


def test_runs_are_equal_where_words_are(spark):
    a, b = " ".join(f"y{i}" for i in range(70)), "ahead " + " ".join(f"y{i}" for i in range(70))
    words, first = words_of(pa.array([a, b]), ALNUM_BYTES)
    shingles, before = shingles_of(words, first, 5)
    runs = passages.runs_of(shingles, 46)
    assert runs[0] == runs[before[1] + 1] and runs[0] != runs[before[1]]


@pytest.mark.parametrize("slice_bytes", [5_000, 200_000])
def test_edited_passages_of_texts_that_many_documents_share_in_part(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(passages, "SLICE_BYTES", slice_bytes)
    rng = random.Random(11)
    new = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    phrase, before, after = new(25), [new(6) for _ in range(12)], [new(19) for _ in range(12)]
    documents = []
    for a in range(12):
        for b in range(12):
            # the phrase and what stands before it, or the phrase and what comes after, is too little; only all three are a passage
            documents += [(2 * (12 * a + b) + i, " ".join(new(60) + before[a] + phrase + new(1) + after[b] + new(60))) for i in range(2)]
    ends = {i: ((i // 2) // 12, (i // 2) % 12) for i, _ in documents}
    rng.shuffle(documents)
    frame = spark.createDataFrame(documents, "doc_id long, text string").repartition(4)
    pairs = passages.repeated_passages(frame).select("doc_id", "other_id").distinct().collect()
    assert all(ends[r.doc_id] == ends[r.other_id] for r in pairs)
    assert {r.doc_id // 2 for r in pairs} == set(range(144))


def test_rows_of_a_minimum_are_all_compared_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rng = random.Random(12)
        new = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
        phrase, before, after = new(25), [new(6) for _ in range(5)], [new(19) for _ in range(5)]
        documents = [(2 * (5 * a + b) + i, " ".join(new(30) + before[a] + phrase + new(1) + after[b] + new(30))) for a in range(5) for b in range(5) for i in range(2)]
        pairs = passages.repeated_passages(spark.createDataFrame(documents, "doc_id long, text string").repartition(3)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(min(r.doc_id, r.other_id), max(r.doc_id, r.other_id)) for r in pairs} == {(2 * i, 2 * i + 1) for i in range(25)}
