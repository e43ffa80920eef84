"""Rank-order profiles against a literal version, and held-out accuracy."""

import zlib
from collections import Counter

import pytest

from wellstream.llm import language

SCHEMA = "doc_id long, text string, lang string"


def grams(text):
    found, words = Counter(), "".join(c if c.isalpha() else " " for c in text.lower()).split()
    for w in words:
        padded = f"\x01{w}\x01"
        found.update(g for n in (1, 2, 3) for i in range(len(padded) - n + 1) if (g := padded[i : i + n]).strip("\x01"))
    return found


def ranked(counts, most):
    return sorted(counts, key=lambda g: (-counts[g], [0] * (3 - len(g)) + [ord(c) for c in g]))[:most]


def model(rows):
    counts = {}
    for i, text, lang in rows:
        if i is not None and lang is not None and text is not None and zlib.crc32(str(i).encode()) % 3 != 1 and grams(text):
            counts.setdefault(lang, Counter()).update(grams(text))
    return {lang: {g: i for i, g in enumerate(ranked(c, language.PROFILE))} for lang, c in counts.items()}


def predicted(lists, text):
    own = ranked(grams(text or ""), language.DOCUMENT_PROFILE)
    if not own or not lists:
        return "und", 0.0
    far = language.PROFILE
    distances = {lang: sum(min(abs(places[g] - i), far) if g in places else far for i, g in enumerate(own)) for lang, places in lists.items()}
    best = min(sorted(distances), key=distances.get)
    return best, 1 - distances[best] / (far * len(own))


def check(spark, rows, **more):
    frame = spark.createDataFrame([(*r, *more.values()) for r in rows], ", ".join([SCHEMA, *(f"{c} int" for c in more)]))
    result = language.summary(frame)
    assert result.columns == ["doc_id", "held_out", "lang_pred", "score"]
    lists = model(rows)
    wanted = [(i, i is not None and zlib.crc32(str(i).encode()) % 3 == 1, *predicted(lists, t)) for i, t, _ in rows]
    assert sorted(((r.doc_id, r.held_out, r.lang_pred, pytest.approx(r.score)) for r in result.collect()), key=str) == sorted(wanted, key=str) or \
        sorted(((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in result.collect()), key=str) == sorted(((*w[:3], round(w[3], 9)) for w in wanted), key=str)
    return result


def test_documents(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()]
    result = check(spark, rows)
    langs = {i: lang for i, _, lang in rows}
    held = [r for r in result.collect() if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) > 0.98 * len(held)


def test_chunks_count_what_whole_texts_do(monkeypatch):
    text = "Ab çD, x yz--éa1b " * 11
    whole = [x.tolist() for x in language.counted(text)]
    assert sum(whole[1]) == sum(grams(text).values())
    for size in (1, 2, 5, 18):
        monkeypatch.setattr(language, "CHUNK", size)
        assert [x.tolist() for x in language.counted(text)] == whole


def test_odd_rows(spark):
    prose = "the cat sat on the mat and the dog"
    rows = [(None, prose, "en"), (None, None, None), (1, None, "en"), (2, "", "xx"), (3, "123 !?", "yy"), (4, prose, "en"), (4, prose, "en"), (5, "der Hund und die Katze", "de"),
            (6, "der Hund", None), (7, "x", ""), (8, "İß😀ΑΣ tok " * 50_000, "zz"), (9, "die Katze", "de"), (10, "the dog", "en"), (11, "q", None)]
    check(spark, rows, lang_pred=1, score=2, held_out=3, gram=4, n=5, place=6, number=7)
    assert language.summary(spark.createDataFrame([], SCHEMA)).collect() == []


def test_without_a_language_all_is_undetermined(spark):
    found = language.summary(spark.createDataFrame([(1, "some words", None), (2, "more", None)], SCHEMA)).collect()
    assert {(r.lang_pred, r.score) for r in found} == {("und", 0.0)}


def test_most_languages_are_a_parameter(spark):
    rows = [(i, f"{'ab' * (1 + i)} word", f"l{i}") for i in range(5)]
    learnt = language.profiles(spark.createDataFrame(rows, SCHEMA), languages=2)
    assert learnt.names == ["l3", "l4"]
