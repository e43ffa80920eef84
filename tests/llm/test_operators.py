"""Every operator against a brute-force version, and on odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import FOLD, NONBLANK, SMALL, words
from wellstream.llm import calibrate, decontaminate, mixture, near_dup, order_minhash, passages, quality, quotes, secrets, shards, toxicity


def table(frame, key="doc_id"):
    return {r[key]: r for r in frame.collect()}


def hits(text, windows):
    w, items = words(text), set()
    hit = [0] * len(w)
    for n in {len(k) for k in windows}:
        for p in range(len(w) - n + 1):
            if found := windows.get(tuple(w[p : p + n])):
                items |= found
                hit[p : p + n] = [1] * n
    return len(w), sum(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), sum(hit) > 0


@pytest.mark.parametrize("block_bytes", [8 << 20, 2000])
def test_decontamination(spark, documents, block_bytes):
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet").unionByName(spark.createDataFrame([(900, "and the"), (901, None), (902, "!")], "item_id long, text string"))
    windows = defaultdict(set)
    for r in benchmark.collect():
        w = words(r.text)
        for j in range(max(0, len(w) - min(10, len(w)) + 1) if w else 0):
            windows[tuple(w[j : j + min(10, len(w))])].add(r.item_id)
    found = table(decontaminate.summary(documents, benchmark, block_bytes=block_bytes))
    for r in documents.collect():
        assert tuple(found[r.doc_id])[1:6] == hits(r.text, windows)
    kept = decontaminate.decontaminated(documents, benchmark)
    assert kept.columns == documents.columns and {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if not r.contaminated}


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "a b c d e x"), (2, "q b c d e f g")], "doc_id long, text string")
    found = decontaminate.longest_matches(docs, spark.createDataFrame([(7, "A b c d e f")], "item_id long, text string"))
    assert {(r.start, r.words, r.places, r.doc_id, r["at"]) for r in found.collect()} == {(0, 5, 1, "1", 0), (1, 5, 1, "2", 1), (2, 4, 1, "2", 2), (3, 3, 1, "2", 3), (4, 2, 1, "2", 4), (5, 1, 1, "2", 5)}


def classes(docs, percent):
    sets, parent, inverted = {}, {}, defaultdict(list)
    for i, t in docs:
        w = words(t, NONBLANK)
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        shared = Counter()
        for g in sets[i]:
            shared.update(inverted[g])
            inverted[g].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def test_near_duplicates(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(400)}" for _ in range(120)] for _ in range(12)]
    docs = []
    for i in range(160):
        w = list(base[i % 12])
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(1000)}"
        docs.append((i, " ".join(w)))
    docs += [(200, None), (201, ""), (202, "a b"), (203, "A  b")]
    found = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 85)
    assert {r.doc_id: tuple(r)[1:4] for r in found.collect()} == classes(docs, 85)


def test_representatives_without_or_with_shared_keys(spark):
    text = lambda tag, last="": " ".join(f"{tag}{i}" for i in range(60)) + last
    rows = [(None, text("a"), 1), (None, text("a"), 2), (None, text("a", " more"), 3), (7, text("b"), 1), (7, text("b"), 1), (7, text("c"), 1), (7, text("d"), 1), (7, text("d", " more"), 1),
            (None, text("c"), 4), (8, text("c"), 1), (None, None, 5), (9, "", 1)]
    kept = near_dup.representatives(spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)).collect()
    groups = sorted((r.text.split()[0], r.doc_id) for r in kept if r.text)
    assert [(g, i) for g, i in groups if g != "a0"] == [("b0", 7), ("c0", 7), ("d0", 7)]
    assert [g for g, _ in groups].count("a0") == 1
    assert {(r.doc_id, r.text) for r in kept if not r.text} == {(None, None), (9, "")}


def test_odd_sketches_estimate_high_similarities():
    rng = np.random.default_rng(3)
    for similarity in (0.8, 0.9, 0.97):
        n = 4000
        union = rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
        only = round(n * (1 - similarity) / 2)
        sets = [np.unique(union[: n - only]), np.unique(union[only:])]
        values = near_dup.signatures(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
        a, b = near_dup.odd_sketches(values)
        assert abs(near_dup.estimated_similarity(np.bitwise_count(a ^ b).sum()) - similarity) < 0.09


def test_parities_bound_the_symmetric_difference():
    rng = np.random.default_rng(4)
    for n, only in ((100, 10), (100, 0), (1000, 90), (20, 20), (9000, 4000)):
        union = np.unique(rng.integers(0, 2**63, n + only, dtype=np.int64).astype(np.uint64))
        sets = [union[:n], union[only:], union[:0]]
        parities = near_dup.set_parities(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
        differing = int(np.bitwise_count(parities[0] ^ parities[1]).sum())
        assert differing <= 2 * only and differing % 2 == 0
        assert not parities[2].any()
        if n == 100:
            assert differing >= 2 * only - 6


def test_fingerprints(documents):
    found = table(order_minhash.with_next(documents))
    docs = sorted((r.doc_id, r.text) for r in documents.collect())
    for (i, text), (j, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        n = len(text)
        edited = text[: n - n // 4] + after[: n // 4]
        own, other, following = map(order_minhash.fingerprint, (text, edited, after))
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (order_minhash.as_text(own), order_minhash.as_text(other))
        assert (r.near_edited, r.near_next) == (order_minhash.likeness(own, other), order_minhash.likeness(own, following))
    assert np.mean([r.near_edited for r in found.values()]) > 0.25 > 0.05 > np.mean([r.near_next for r in found.values()])


def test_fingerprints_tell_order():
    a = " ".join(f"alpha{i}" for i in range(200))
    b = " ".join(f"alpha{i}" for i in reversed(range(200)))
    assert order_minhash.likeness(*map(order_minhash.fingerprint, (a, a + "!"))) > 0.9
    assert order_minhash.likeness(*map(order_minhash.fingerprint, (a, b))) < 0.7


def held_out_accuracy(frame, labels, column):
    rows = [r for r in frame.join(labels, "doc_id").collect() if r.held_out]
    return np.mean([r.predicted == r[column] for r in rows]), rows


def test_toxicity_and_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    for summary, column, parts, part in ((toxicity.summary, "toxic", 4, 2), (quality.summary, "quality", 5, 0)):
        accuracy, rows = held_out_accuracy(summary(docs, labels), labels, column)
        assert accuracy > 0.9
        assert all(zlib.crc32(str(r.doc_id).encode()) % parts == part and 0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("labelled", [[], [(i, 0) for i in range(12)], [(i, 1) for i in range(12)], [(1000 + i, i % 2) for i in range(40)], [(i, 0) for i in range(12)] + [(1000 + i, 1) for i in range(40)], [(i, 1) for i in range(12)] + [(1000 + i, 0) for i in range(40)]])
def test_without_a_model_nothing_is_toxic(spark, labelled):
    docs = spark.createDataFrame([(i, f"some plain words {i}") for i in range(20)] + [(None, None)], "doc_id long, text string")
    labels = spark.createDataFrame(labelled, "doc_id long, toxic int")
    assert toxicity.without_toxic(docs, labels).count() == 21
    assert {(r.score, r.predicted) for r in toxicity.summary(docs, labels).collect()} == {(0.0, 0)}


def test_stage_removes_what_the_operator_calls_toxic(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.held_out_of("doc_id", 4, 2)
    kept = {r.doc_id for r in toxicity.without_toxic(docs, labels, ~out).select("doc_id").collect()}
    toxic = {r.doc_id for r in labels.where(out & (toxicity.F.col("toxic") == 1)).collect()}
    assert len(toxic - kept) >= 0.75 * len(toxic)
    called = {r.doc_id for r in toxicity.summary(docs, labels).where("predicted = 1").collect()}
    assert called == {r.doc_id for r in docs.select("doc_id").collect()} - kept


def kneser_ney(counts, gram, discount=toxicity.DISCOUNT):
    """Probability of the last byte of a gram by the recursion as published; counts: of grams of full order."""
    n = len(gram)
    if n == 0:
        return 1 / 256
    level = counts if n == toxicity.ORDER else Counter(g for g in {h[-n - 1 :] for h in counts} for g in [g[-n:]])
    context = {g: c for g, c in level.items() if g[:-1] == gram[:-1]}
    total = sum(context.values())
    return (max(context.get(gram, 0) - discount, 0) + discount * len(context) * kneser_ney(counts, gram[1:])) / total


def test_shared_model_is_kneser_ney(spark):
    texts = spark.createDataFrame([("abra cadabra",), ("bra bar abba",)], "text string")
    counts = Counter()
    for (text,) in texts.collect():
        for w in words(text):
            padded = b" " * 5 + w.encode() + b" "
            counts.update(padded[i : i + 6] for i in range(len(padded) - 5))
    found = {r.gram.to_bytes(6, "big"): r.p for r in toxicity.shared_model(toxicity.gram_counts(texts)).collect()}
    assert set(found) == set(counts)
    for gram, p in found.items():
        assert p == pytest.approx(kneser_ney(counts, gram))


def test_repeated_passages(spark):
    rng = random.Random(2)
    new = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    exact, edited = new(55), new(90)
    docs = []
    for i in range(60):
        w = new(rng.randrange(60, 200))
        if i % 6 == 0:
            w[20:20] = exact
        if i % 10 == 3:
            e = list(edited)
            e[rng.randrange(90)] = "changed"
            w[5:5] = e
        docs.append((i, " ".join(w)))
    docs += [(100, " ".join(new(10))), (101, None), (102, " ".join(exact[:40]))]
    found = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    own = defaultdict(set)
    for r in found:
        own[r.class_id] |= {r.doc_id, r.other_id}
        assert min(r.end_word - r.start_word, r.other_end - r.other_start) >= 50
    assert set(map(frozenset, own.values())) == {frozenset(range(0, 60, 6)), frozenset(range(3, 60, 10))}


@pytest.mark.parametrize("slice_bytes", [12 << 20, 8000])
def test_passages_around_a_common_phrase(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(passages, "SLICE_BYTES", slice_bytes)
    rng = random.Random(7)
    new = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    phrase = new(40)
    docs = {i: new(30) + phrase + new(30) for i in range(300)}
    for i in range(0, 40, 2):  # twenty passages of 60 words, 40 of them the phrase, in two documents each
        passage = new(10) + phrase + new(10)
        for j in (i, 299 - i):
            docs[j] = new(25) + passage + new(25)
    found = passages.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string").repartition(3)).collect()
    assert {frozenset((r.doc_id, r.other_id)) for r in found} == {frozenset((i, 299 - i)) for i in range(0, 40, 2)}
    assert {(r.start_word, r.end_word, r.other_start, r.other_end) for r in found} == {(25, 85, 25, 85)}


def test_compact_windows_are_nodes_of_the_cartesian_tree():
    rng = np.random.default_rng(1)
    for _ in range(20):
        before = np.concatenate(([0], np.cumsum(rng.integers(1, 60, 5))))
        values = passages.mix(rng.integers(0, 40, before[-1]).astype(np.uint64))
        text, start, end = passages.segments(before, 7)
        if not len(start):
            continue
        low = int((end - start).sum()).bit_length()
        expected = set()
        for s, (a, b) in enumerate(zip(start, end, strict=True)):
            v = [(int(x) >> low, i) for i, x in enumerate(values[a:b])]
            for c in range(b - a):
                first = next((i + 1 for i in range(c - 1, -1, -1) if v[i] < v[c]), 0)
                last = next((i for i in range(c + 1, b - a) if v[i] < v[c]), b - a)
                if last - first >= 7:
                    expected.add((s, a + first, a + c, a + last))
        assert set(zip(*(x.tolist() for x in passages.compact_windows(values, start, end, 7)), strict=True)) == expected


SECRETS = [(re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12), (re.compile("AKIA[A-Z0-9]+"), 0, 18), (re.compile("[0-9a-f]+"), 0, 16)]


def secret_row(text):
    found = [(m.start(), k, m.end()) for k, (p, g, n) in enumerate(SECRETS) for m in p.finditer(text or "") if len(m.group(g)) >= n]
    listed = ",".join(f"{secrets.RULES[k].kind}:{a}:{b}" for a, k, b in sorted(found))
    return (*(sum(f[1] == k for f in found) for k in range(3)), hashlib.sha256(listed.encode()).hexdigest(), listed)


def test_secrets(spark, documents):
    rows = [(None, None), (1, ""), (1, "token=password=abcdefghijklmnop"), (2, "token=secret:abcdefghijklmn"), (3, "é😀 API_KEY = \"abcdefghijkl\" x"), (4, "AKIA" + "B" * 13 + " AKIA" + "C" * 14),
            (5, "deadbeef" * 2 + "é" + "deadbeef" * 3), (6, "ab" * 8 + " token:" + "q" * 12 + "x=1 " * 700 + "passwd: " + "z" * 20), (7, " ".join(f"token={i:016d}" for i in range(600)))]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    found = sorted(map(repr, (tuple(r) for r in secrets.summary(docs).collect())))
    assert found == sorted(repr((r.doc_id, *secret_row(r.text))) for r in docs.collect())


def test_trigram_queries():
    has = lambda *t: ("and", *(("has", x) for x in t))
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == has("aki", "kia")
    assert secrets.trigram_query("(token|abc)x+") == ("or", has("abc"[0:3], "bcx"), has("tok", "oke", "ken", "enx")) or secrets.trigram_query("(token|abc)x+")[0] == "or"
    for scan_all in ("[0-9a-f]{16,}", "ab", "(token)?x", "a|token"):
        assert secrets.trigram_query(scan_all) == secrets.ALL


def jump(key, n):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_shards(documents):
    found = shards.summary(documents).collect()
    texts = {r.doc_id: r.text.encode() for r in documents.collect()}
    slots = defaultdict(list)
    for r in found:
        assert (r.shard, r.grown_shard) == (jump(r.doc_id, 40), jump(r.doc_id, 41))
        assert (r.text_crc32, r.size) == (zlib.crc32(texts[r.doc_id]), len(texts[r.doc_id]) + 16)
        slots[r.shard].append((r.doc_id, r.slot))
    assert all([s for _, s in sorted(v)] == list(range(len(v))) for v in slots.values())


def test_mixture(documents):
    rows = mixture.mixed(documents).collect()
    sizes, taken, targets = Counter(), Counter(), {}
    for r in rows:
        assert r.size == len(words(r.text, NONBLANK)) and r.taken in (0, r.size, 2 * r.size)
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        targets[r.source] = r.target
    weights = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(sorted(sizes))}
    clamped, total = set(), 1.5 * sum(sizes.values())
    while True:
        level = (total - sum(2 * sizes[s] for s in clamped)) / sum(w for s, w in weights.items() if s not in clamped)
        over = {s for s in sizes if s not in clamped and weights[s] * level > 2 * sizes[s]}
        if not over:
            break
        clamped |= over
    for s in sizes:
        assert targets[s] == pytest.approx(2 * sizes[s] if s in clamped else weights[s] * level)
        assert abs(taken[s] - targets[s]) <= max(r.size for r in rows if r.source == s) / 2 + 1e-6
    again = {r.doc_id: r.taken for r in mixture.summary(documents.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


@pytest.mark.parametrize("key", [None, 5])
@pytest.mark.parametrize("alike", [False, True])
def test_mixture_meets_targets_with_shared_keys(spark, key, alike):
    rows = [(key if i % 2 else 100 + i, "one two three" + ("" if alike and i % 2 else f" word{i}"), "ab"[i % 3 == 0], i) for i in range(600)]
    found = mixture.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(5)).collect()
    assert sorted(r.n for r in found) == list(range(600))
    for s in "ab":
        assert abs(sum(r.taken for r in found if r.source == s) - next(r.target for r in found if r.source == s)) <= 2 + 1e-6


def test_quotes(spark):
    rows = [(1, 0, "user", "Hello there my friend.\nHow do you do today?"), (1, 1, "assistant", "I am fine thank you.\nWhat about the weather over there?"),
            (1, 2, "user", "On Monday, A wrote:\n> What about  the WEATHER over there\nRainy."), (1, 3, "assistant", "> Rainy.\n>> What about the weather over there?\nA pity."),
            (2, 0, None, None), (None, 1, "user", "> x"), (2, None, "user", "hm"), (2, 5, "user", "> never said before\nok")]
    found = {(r.conv_id, r.turn): r for r in quotes.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(found) == len(rows)
    third, fourth = found[1, 2], found[1, 3]
    assert (third.body, third.parent_turn, third.root_turn, third.depth) == ("Rainy.", 1, 1, 1)
    assert (fourth.body, fourth.quote_depth, fourth.parent_turn, fourth.root_turn, fourth.depth) == ("A pity.", 2, 2, 1, 2)
    assert (found[2, 5].body, found[2, 5].parent_turn, found[2, 0].body) == ("ok", None, None)


def test_nested_quotes_link_without_the_message_between(spark):
    texts = ["The original line was this.\nAgreed", "Something else here.", ">> The original line was this.\nOnly nested.", "> A wrote:\n>> the ORIGINAL line was this\nAnnounced.",
             "> This reply was removed.\n>> The original line was this.\nMissing middle.", "> Something else here.\n>> The original line was this.\nBoth.", "> agreed\nOne word."]
    rows = [(1, i, "user", text) for i, text in enumerate(texts)]
    found = {r.turn: r for r in quotes.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [found[i].parent_turn for i in range(7)] == [None, None, 0, 0, 0, 1, 0]


@pytest.mark.parametrize("empty", [False, True])
def test_odd_input(spark, odd, empty):
    docs = odd.limit(0) if empty else odd
    n = docs.count()
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 1), (4, None, None), (None, 1, 1), (2, 1, 1), (6, 0, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "one two"), (None, "one two"), (2, None), (3, "")], "item_id long, text string")
    for frame in (decontaminate.summary(docs, benchmark), near_dup.near_duplicates(docs), order_minhash.with_next(docs), toxicity.summary(docs, labels), quality.summary(docs, labels), secrets.summary(docs), shards.summary(docs), mixture.summary(docs)):
        assert frame.count() == n
    pairs = passages.repeated_passages(docs).collect()
    assert {(min(p.doc_id, p.other_id), max(p.doc_id, p.other_id)) for p in pairs} == (set() if empty else {(2, 3)})
    for kept in (decontaminate.decontaminated(docs, benchmark), toxicity.without_toxic(docs, labels), near_dup.representatives(docs), mixture.repeated(docs)):
        assert len(kept.columns) == len(docs.columns) and kept.count() <= 2 * n
    near = {r.doc_id: r for r in near_dup.near_duplicates(docs).where("doc_id is not null").collect()}
    assert empty or ([near[i].component_id for i in (1, 2, 3, 4)], near[1].n_shingles) == ([1, 2, 2, 4], 0)


NAMES = ["row", "size", "source_size", "target", "repetitions", "taken", "whole", "left", "end_bin", "last_hash", "part_hash", "part_rows", "bound", "clamped", "head", "hash", "bin", "words", "start", "before", "some", "n",
         "__hash", "__bin", "__size", "__target", "__source", "__part", "__at", "__task", "__own", "__text", "__rules", "__a", "__b", "__key_a", "__key_b", "key_a", "key_b", "rule", "for_source", "taken_source", "own", "part", "to", "state",
         "shard", "slot", "law", "text_crc32", "grown_shard", "secret_spans", "toxicity", "key of the run", "a.b"]


def test_columns_of_any_name_are_kept(spark):
    """Each input column that isn't a result keeps its value, and the results are those without it."""
    texts = {1: "password = abcdefghijklmnop one two", 2: "three four five six", 3: None, 4: "a b c d e f g", 5: "a b c d e f g"}
    rows = [(i, t, f"s{i % 2}") for i, t in texts.items()]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    wide = spark.createDataFrame([(*r, *(f"{n} of {r[0]}" for n in NAMES)) for r in rows], ", ".join(["doc_id long, text string, source string", *(f"`{n}` string" for n in NAMES)]))
    kept = lambda r, results: all(r[n] == f"{n} of {r.doc_id}" for n in NAMES if n not in results)
    for apply, results in ((mixture.mixed, mixture.RESULTS), (shards.sharded, shards.RESULTS), (secrets.scan, ["secret_spans"])):
        own = {r.doc_id: [r[c] for c in results] for r in apply(plain).collect()}
        found = apply(wide).collect()
        assert all(kept(r, results) for r in found) and {r.doc_id: [r[c] for c in results] for r in found} == own
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "three four")], "item_id long, text string")
    for apply in (mixture.repeated, near_dup.representatives, lambda d: toxicity.without_toxic(d, labels), lambda d: decontaminate.decontaminated(d, benchmark)):
        found = apply(wide)
        assert found.columns == wide.columns
        rows_found = found.collect()
        assert rows_found and all(kept(r, []) for r in rows_found)
        assert sorted(r.doc_id for r in rows_found) == sorted(r.doc_id for r in apply(plain).collect())


def test_a_hot_key_teaches_one_text(spark):
    """A labelled doc_id on a third of the rows: one of its texts is sampled, and the scores are those without its copies."""
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    hot = labels.where("toxic = 0 and quality = 1").orderBy("doc_id").first().doc_id
    copies = documents.where(f"doc_id = {hot}").crossJoin(spark.range(100)).drop("id")
    many = documents.where(f"doc_id <> {hot}").unionByName(copies)
    sample, _ = calibrate.labelled_sample(labels, None, "toxic", 4000)
    assert calibrate.sampled_texts(many, sample).groupBy("doc_id").count().where("count > 1").isEmpty()
    own, found = ({r.doc_id: r.quality_score for r in quality.scored(d, labels).collect()} for d in (documents, many))
    assert found == own


def test_quality_without_a_model(spark):
    documents = spark.createDataFrame([(1, "a b"), (2, "c d"), (3, None)], "doc_id long, text string")
    for rows, score in (([], 0.0), ([(1, 1), (2, 1)], 1.0), ([(1, 0), (8, 1)], 0.5)):
        found = quality.scored(documents, spark.createDataFrame(rows, "doc_id long, quality int")).collect()
        assert {r.quality_score for r in found} == {score}
