"""The manifest against plain Python."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from tests.llm.conftest import SMALL
from wellstream.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(level):
    """The root of a list of digests, and for each of them the digests before and after its way, level by level."""
    beside, place = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, p in enumerate(place):
            first = p - p % 3
            beside[i].append(("".join(level[first:p]), "".join(level[p + 1 : first + 3])))
            place[i] = p // 3
        level = [digest(*level[a : a + 3]) for a in range(0, len(level), 3)]
    return level[0], beside


def expected(rows):
    groups = defaultdict(list)
    for row in rows:
        doc_id, text = row[0], row[4]
        odd = doc_id is None or text is None or zlib.crc32(str(doc_id).encode()) % 2
        groups[row[1]].append((doc_id is not None, doc_id or 0, leaf_of(row), leaf_of(row if odd else (*row[:4], text.replace("\n", "")))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([leaf for _, _, leaf, _ in sorted(groups[s])]) for s in names]
    root, over = tree([subroot for subroot, _ in trees]) if names else ("", [])
    out = []
    for name, (subroot, beside), upper in zip(names, trees, over, strict=True):
        for (known, doc_id, leaf, tampered), own in zip(sorted(groups[name]), beside, strict=True):
            found = tampered
            for before, after in own + upper:
                found = digest(before, found, after)
            out.append((doc_id if known else None, leaf, subroot, root, digest(*(b + a for b, a in own + upper)), found, found == root))
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_documents(spark):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [tuple(r) for r in documents.select(*manifest.FIELDS).collect()]
    result = manifest.summary(documents)
    assert result.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert found(result) == expected(rows)


def test_several_tiers_and_partitions(spark, monkeypatch):
    monkeypatch.setattr(manifest, "DIGITS", 1)
    monkeypatch.setattr(manifest, "BLOCK", 3)
    monkeypatch.setattr(manifest, "PART_ROWS", 7)
    rows = [(i, f"s{i % 3 if i % 7 else 0}", "en", i, f"text\n{i}") for i in range(40)] + [(i, f"x{i}", None, None, "one") for i in range(100, 112)] + [(i, None, "de", 1, None) for i in range(200, 204)]
    assert found(_unfolding_one_step(monkeypatch, spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def _unfolding_one_step(monkeypatch, frame):
    whole = manifest._unfolded
    monkeypatch.setattr(manifest, "_unfolded", lambda tree, above, steps=1: whole(tree, above, steps))
    return manifest.summary(frame)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 730])
def test_sizes_around_a_block(spark, n):
    rows = [(i, "hot", None, i, "a\nb") for i in range(n)]
    assert found(manifest.summary(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "é", "", 0, ""), (5, "é", "en", 3, "a\nb"), (5, "é", "en", 3, "a\nb"), (5, "é", "en", 3, "other"), (-3, "", "en", 1, "😀\n" * 9),
            (7, "e", "en", 2, "tok " * 300_000), (None, "é", "", 0, "")]
    names = ["hash", "item", "idx", "n", "at", "part", "proof", "tree", "node", "block", "spread", "tampered", "leaf", "root", "run", "digit0", "of_source"]
    frame = spark.createDataFrame([(*r, *range(len(names))) for r in rows], f"{SCHEMA}, {', '.join(f'{c} int' for c in names)}").repartition(3)
    result = found(manifest.summary(frame))
    wanted = expected(rows)
    # equal rows: either may have either place
    assert result == wanted
    assert found(manifest.summary(spark.createDataFrame([], SCHEMA))) == []


def test_a_change_anywhere_is_found(spark):
    rows = [(i, f"s{i % 2}", "en", 4, "text") for i in range(20)]
    proven = manifest.proven(spark.createDataFrame(rows, SCHEMA))
    (root,) = {r.root for r in proven.collect()}
    for changed in ((20, "s0", "en", 4, "text"), (3, "s1", "en", 4, "texts"), (3, "s0", "en", 4, "text")):
        other = manifest.proven(spark.createDataFrame([changed if r[0] == changed[0] else r for r in rows] + ([changed] if changed[0] == 20 else []), SCHEMA))
        assert {r.root for r in other.collect()} != {root}
