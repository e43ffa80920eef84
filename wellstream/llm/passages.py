"""Substring dedup with compact windows.

Words, A-Z folded, become five-word shingles. Under a hash, the Cartesian tree of a text's hashes has one node per
shingle: the subsequences whose minimum it is are those that contain it and stay between the next smaller ones, which is
one compact window (first, centre, last). Only nodes whose window holds a passage of the least length are kept: about
2 / (length + 1) of all. Windows with equal minima meet, and a pair of them claims that some passages around both
centres are alike.

Passages that are alike enough share a run of `shared_run` equal shingles, so the windows of the first hash hold only as
many: every such run, and with it every pair of alike passages, has a minimum in common. More hashes are computed only
if `least_hashes` asks for them.

Equal minima are never expanded into all pairs. Within a slice of documents they are linked to the first of them and
confirmed at once; the first ones of all slices are sorted by minimum, and each is paired with the first and with the one
before. A pair goes on if enough of eight shingles at fixed distances from the centres agree (a byte of each
travels with the window), as they do within every shared run. Overlapping windows of a pair of documents are joined over
all minima, and every joined passage that at least `least_hashes` of them claim is confirmed on the shingles: runs of equal
shingles are chained while the passages keep the asked similarity.

Two partners don't settle a minimum whose windows differ, such as one in a phrase that many documents have. Each window
also tells its context: all runs of the least length that have this minimum. If all contexts of a
minimum are equal, or its windows are so few that all pairs are compared, nothing can be missed. For every other minimum
the texts are read again. Windows with equal surroundings are linked to the first of them, which is split into its runs of the
least length; equal runs are linked to the first of them. What is alike without such a run goes on beyond an edit near the centre,
so a window is also split by the minimum and each shingle that is the least of some NEAR_RUN on end, as far from it as the next
stretch can begin after the last minimum of the one before: those that share both are paired with the first, and if they differ in
between, with the one before; of more than FEW only those that differ are paired. That settles a minimum and a shingle if all
documents that have them are then of one class, or have them in one stretch. For all others the texts of these classes are read a third
time: each run of `shared_run` shingles that a stretch can end (or begin) with, and a shingle after (before) it, is a row, and rows of
different classes that are equal but differ in what follows are all paired and confirmed. What can be missed are passages
that continue beyond the edit with fewer than NEAR_RUN shingles.

Documents of fewer words than a passage, null and empty texts have no passages. A row without doc_id is left out; rows
that share a doc_id are one document and aren't compared with each other, nor are passages within one document. Extra
columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellstream.llm.common import ALNUM_BYTES, BATCH_BYTES, map_batches, mix, shingles_of, ship, words_of, written
from wellstream.llm.components import components

SHINGLE_WORDS = 5
PASSAGE_WORDS = 50
HASHES = 4  # seeds; as many are used as least_hashes asks for
PERCENT = 80
#: Words that may lie between two runs of equal shingles of one passage.
GAP = 15
#: A longer text is cut into segments that overlap by a passage.
SEGMENT = 1 << 17
#: Distances from a centre at which shingles are compared, and how many must agree.
PROBES = (-24, -16, -8, -4, 4, 8, 16, 24)
MATCHES = 2
#: Text of the slices in which windows are linked at once.
SLICE_BYTES = 12 << 20
#: Of the shingles around a common minimum, every stretch so long gives one to tell alike surroundings by.
NEAR_RUN = 8
#: After a shared stretch ends, the next one begins within GAP words and a shingle, and its first NEAR_RUN shingles hold one to tell it by.
BEYOND = GAP + SHINGLE_WORDS + NEAR_RUN
#: Rows of a minimum and a shingle near it that are paired even if nothing differs in between.
FEW = 8
#: Windows whose surroundings are looked through at a time.
NEAR_WINDOWS = 1 << 12
#: Pairs of rows that are made at a time.
PAIRED_ROWS = 1 << 18
BROADCAST_NODES = 1_000_000
#: Words of 64 bits of the bitmap of minima that are split; minima that share a bit with one are split too.
SPLIT_WORDS = 1 << 20
_SEEDS = mix(np.arange(11, 11 + HASHES, dtype=np.uint64))
_FIELDS = ["doc_id", "other_id", "start_word", "end_word", "other_start", "other_end"]
PAIRS = ", ".join(f"{f} long" for f in _FIELDS)


def segments(before: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end of the stretches of shingles in which windows are looked for."""
    text, start, end = [], [], []
    for t, (a, b) in enumerate(zip(before[:-1].tolist(), before[1:].tolist(), strict=True)):
        at = a
        while b - at >= least:
            text.append(t)
            start.append(at)
            end.append(min(b, at + SEGMENT))
            if end[-1] == b:
                break
            at = end[-1] - least + 1
    return np.array(text, dtype=np.int64), np.array(start, dtype=np.int64), np.array(end, dtype=np.int64)


def compact_windows(hashes: np.ndarray, start: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first, centre, last) of the nodes of each segment's Cartesian tree that hold `least` shingles; ties go to the left."""
    sizes = end - start
    total = int(sizes.sum())
    low = np.uint64(max(1, total).bit_length())
    local = np.concatenate(([0], np.cumsum(sizes)))
    place = np.arange(total)
    values = hashes[place + np.repeat(start - local[:-1], sizes)]
    values = (values >> low << low) | place.astype(np.uint64)
    # the minima of all stretches of the least length are the centres wanted
    part, width = values, 1
    while 2 * width <= least:
        part = np.minimum(part[:-width], part[width:])
        width *= 2
    if width < least:
        part = np.minimum(part[: len(part) - (least - width)], part[least - width :])
    begin = np.zeros(total + 1, dtype=np.int64)
    np.add.at(begin, local[:-1], 1)
    np.add.at(begin, local[1:] - least + 1, -1)
    inside = np.cumsum(begin[:-1]) > 0
    centre = (part[inside[: len(part)]] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    centre = centre[np.concatenate(([True], centre[1:] != centre[:-1]))] if len(centre) else centre
    segment = np.searchsorted(local, centre, side="right") - 1
    first, last = centre.copy(), centre + 1
    floor, ceiling, own = local[segment], local[segment + 1], values[centre]
    tables = [values]
    while 2 ** len(tables) <= int(sizes.max(initial=1)):
        below, half = tables[-1], 2 ** (len(tables) - 1)
        tables.append(np.minimum(below[:-half], below[half:]) if len(below) > half else below[:0])
    for k in range(len(tables) - 1, -1, -1):
        table, step = tables[k], 2**k
        if not len(table):
            continue
        ok = last + step <= ceiling
        ok &= table[np.where(ok, last, 0)] > own
        last = np.where(ok, last + step, last)
        ok = first - step >= floor
        ok &= table[np.where(ok, first - step, 0)] > own
        first = np.where(ok, first - step, first)
    shift = start[segment] - local[segment]
    return segment, first + shift, centre + shift, last + shift


def runs_of(shingles: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of so many shingles, across texts too."""
    if len(shingles) < length:
        return shingles[:0]
    part, width = mix(shingles ^ np.uint64(0x6A09E667F3BCC909)), 1
    while 2 * width <= length:
        part = mix(mix(part[:-width]) + part[width:])
        width *= 2
    if width < length:
        part = mix(mix(part[: len(part) - (length - width)]) + part[length - width :])
    return part


def shared_run(percent: int, passage_words: int, k: int = SHINGLE_WORDS) -> int:
    """Equal shingles on end that two passages have at least, if they are as alike as `percent` asks.

    Between two of their runs they lose 2k - 1 shingles at least, one word put in; so many runs that lose more would be too unlike.
    """
    least = passage_words - k + 1
    if percent >= 100:
        return least
    found = [least]
    for runs in range(2, least + 2):
        shared = max(percent * (2 * k - 1) * (runs - 1) / (100 - percent), 2 * percent * least / (100 + percent))
        found.append(int(np.ceil(np.ceil(shared - 1e-9) / runs)))
    return max(1, min(found))


def windows_of(shingles: np.ndarray, before: np.ndarray, least: int, run: int, hashes: int = 1) -> dict[str, np.ndarray]:
    """All compact windows: key (hash function and minimum), text, and first, centre, last (end exclusive) as shingles of the text.

    Those of the first hash hold `run` shingles, so any two equal stretches of this length have one in common; those of the others hold `least`.
    """
    text, start, end = segments(before, least)
    found: dict[str, list] = {n: [np.empty(0, dtype=np.int64)] for n in ("text", "first", "centre", "last", "hash")}
    keys = [np.empty(0, dtype=np.uint64)]
    at = 0
    done = np.cumsum(end - start)
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + 2 * SEGMENT, side="right")))
        for h in range(hashes):
            a, b = int(start[at]), int(end[to - 1])
            hashed = mix(shingles[a:b] ^ _SEEDS[h])
            segment, first, centre, last = compact_windows(hashed, start[at:to] - a, end[at:to] - a, least if h else run)
            own = text[at:to][segment]
            shift = before[own] - a
            keys.append(mix(hashed[centre] + np.uint64(h)))
            for name, values in (("text", own), ("first", first - shift), ("centre", centre - shift), ("last", last - shift), ("hash", np.full(len(own), h))):
                found[name].append(values)
        at = to
    out = {"key": np.concatenate(keys), **{n: np.concatenate(v) for n, v in found.items()}}
    begin, end = before[:-1][out["text"]], before[1:][out["text"]]
    out["probes"] = np.zeros((len(begin), len(PROBES)), dtype=np.uint8)
    for i, distance in enumerate(PROBES):
        at = begin + out["centre"] + distance
        ok = (at >= begin) & (at < end)
        out["probes"][ok, i] = shingles[at[ok]].astype(np.uint8)
    return out


def probes_within(run: int) -> int:
    """Probes, MATCHES at most, that lie in every run of so many shingles around a centre."""
    return min(MATCHES, *(sum(-before <= p < run - before for p in PROBES) for before in range(run)))


def agree(probes: np.ndarray, a: np.ndarray, b: np.ndarray, matches: int) -> np.ndarray:
    """Whether enough probes of rows a and b are equal."""
    return np.count_nonzero(probes[a] == probes[b], axis=1) >= matches


def claims(windows: np.ndarray, least_hashes: int) -> list[tuple[int, int]]:
    """(centre, other centre) from claims on one pair of documents, rows of (key, first, centre, last, the same of the other).

    Claims whose windows overlap in both documents are joined; joins with enough different minima give their centres.
    """
    windows = windows[np.argsort(windows[:, 1], kind="stable")]
    out: list[tuple[int, int]] = []
    joined: list[tuple[int, int, set, list]] = []
    for key, first, centre, last, other_first, other, other_last in windows.tolist():
        live = [j for j in joined if first < j[0] and other_first < j[1]]
        out += [c for j in joined if j not in live and len(j[2]) >= least_hashes for c in j[3]]
        keys, centres = {key}, [(centre, other)]
        for j in live:
            last, other_last, keys, centres = max(last, j[0]), max(other_last, j[1]), keys | j[2], centres + j[3]
        joined = [(last, other_last, keys, centres)]
    out += [c for j in joined if len(j[2]) >= least_hashes for c in j[3]]
    return out


def alike(a: np.ndarray, b: np.ndarray, centres: np.ndarray, percent: int = PERCENT, passage_words: int = PASSAGE_WORDS, k: int = SHINGLE_WORDS, order: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
    """Passages (start, end, other start, other end in words) of two texts given as shingles, around places they share; order sorts b stably."""
    order = np.argsort(b, kind="stable") if order is None else order
    at = np.minimum(np.searchsorted(b[order], a), len(b) - 1)
    match = np.where(b[order[at]] == a, order[at], -1)
    shared = []
    for d in np.unique(centres[:, 1] - centres[:, 0]).tolist():
        x = np.arange(max(0, -d), max(0, -d, min(len(a), len(b) - d)))
        shared.append((d, x[b[x + d] == a[x]]))
    # a word said over and over matches at many distances; what matches most goes last and stays
    for d, x in sorted(shared, key=lambda s: len(s[1])):
        match[x] = x + d
    hit = np.flatnonzero(match >= 0)
    if not len(hit):
        return []
    new = np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (match[hit[1:]] != match[hit[:-1]] + 1)))
    begin = np.flatnonzero(new)
    sizes = np.diff(np.append(begin, len(hit)))
    runs = [(int(hit[i]), int(match[hit[i]]), int(n)) for i, n in zip(begin, sizes, strict=True) if n > 1]
    least = passage_words - k + 1
    out = []
    i = 0
    while i < len(runs):
        x0, y0, shared = runs[i]
        x1, y1, best, then = x0 + shared, y0 + shared, None, i + 1
        if shared >= least:
            best = (x1, y1, i + 1)
        for j in range(i + 1, len(runs)):
            p, q, n = runs[j]
            if p - x1 > GAP + k:
                break
            if not 0 <= q - y1 <= GAP + k:
                continue
            both = shared + n
            if 100 * both < percent * ((p + n - x0) + (q + n - y0) - both):
                continue
            x1, y1, shared = p + n, q + n, both
            if min(x1 - x0, y1 - y0) >= least:
                best = (x1, y1, j + 1)
        if best:
            out.append((x0, best[0] + k - 1, y0, best[1] + k - 1))
            then = best[2]
        i = then
    return out


def _pack(first: np.ndarray, centre: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Centre in 32 bits, the reach to both sides in 16 each (a longer reach is cut; confirmation follows a match to its ends)."""
    return (centre << 32) | (np.minimum(centre - first, 65535) << 16) | np.minimum(last - centre, 65535)


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    centre = at >> 32
    return centre - ((at >> 16) & 65535), centre, centre + (at & 65535)


def _grouped(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal rows together, and where each group begins."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def _starts(w: dict[str, np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the runs of the least length within each window that hold its centre; none if the last comes first."""
    return np.maximum(w["first"], w["centre"] - least + 1), np.minimum(w["centre"], w["last"] - least)


def _contexts_of(w: dict[str, np.ndarray], shingles: np.ndarray, before: np.ndarray, least: int) -> np.ndarray:
    """Hash of all runs of the least length that hold a window's centre: those within the window, or if it has none, within the text."""
    if not len(w["key"]):
        return w["key"]
    low, high = _starts(w, least)
    begin, size = before[:-1][w["text"]], np.diff(before)[w["text"]]
    none = low > high
    low = np.where(none, np.maximum(w["centre"] - least + 1, 0), low)
    high = np.where(none, np.minimum(w["centre"], size - least), high)
    runs = runs_of(shingles, least)
    return mix(runs[begin + low] + mix(runs[begin + high] + mix(((w["centre"] - low) << 33 | (high - low) << 1 | none).astype(np.uint64))))


class _Slice:
    """Windows of a slice of documents: links inside it, confirmed, and one window per minimum for the rest.

    context: of that window, under the first hash; differ: 0 if all windows of the minimum have it, 2 if not all pairs of them are compared, or 1.
    """

    def __init__(self, part: pa.RecordBatch, percent: int, passage_words: int, least_hashes: int) -> None:
        ids = part.column(0).to_numpy()
        words, first = words_of(part.column(1), ALNUM_BYTES)
        shingles, before = shingles_of(words, first, SHINGLE_WORDS)
        least = passage_words - SHINGLE_WORDS + 1
        run = shared_run(percent, passage_words)
        w = windows_of(shingles, before, least, run, min(max(least_hashes, 1), HASHES))
        doc = ids[w["text"]]
        order = np.lexsort((w["centre"], doc, w["key"]))
        w = {n: v[order] for n, v in w.items()}
        doc = doc[order]
        context = _contexts_of(w, shingles, before, least)
        new = np.concatenate(([True], w["key"][1:] != w["key"][:-1])) if len(doc) else np.zeros(0, dtype=bool)
        head = np.flatnonzero(new)
        self.key, self.doc = w["key"][head].view(np.int64), doc[head]
        self.first_hash = w["hash"][head] == 0
        self.context = context[head].view(np.int64)
        unlike = np.bincount(np.cumsum(new) - 1, weights=context != context[head[np.cumsum(new) - 1]], minlength=len(head)) > 0 if len(doc) else new
        self.differ = np.where(unlike, np.where(np.diff(np.append(head, len(doc))) > 3, 2, 1), 0)
        self.at = _pack(w["first"][head], w["centre"][head], w["last"][head])
        self.probes = np.ascontiguousarray(w["probes"][head]).view(np.int64).reshape(-1)
        to = head[np.cumsum(new) - 1] if len(doc) else head
        previous = np.maximum(np.arange(len(doc)) - 1, 0)
        self.links: list[tuple[int, ...]] = []
        later = ~new & ~((w["hash"] == 0) & (self.differ == 2)[np.cumsum(new) - 1]) if len(doc) else new  # else split_pairs links them
        star = np.flatnonzero(later & (doc != doc[to]))
        chain = np.flatnonzero(later & (previous != to) & (doc != doc[previous]))
        mine, other = np.concatenate((star, chain)), np.concatenate((to[star], previous[chain]))
        same = agree(w["probes"], mine, other, probes_within(run))
        mine, other = mine[same], other[same]
        if not len(mine):
            return
        order, begin = _grouped(w["text"][other], w["text"][mine])
        mine, other = mine[order], other[order]
        for a, b in zip(begin, np.append(begin[1:], len(mine)), strict=True):
            m, o = mine[a:b], other[a:b]
            rows = np.column_stack((w["key"][m].view(np.int64), w["first"][m], w["centre"][m], w["last"][m], w["first"][o], w["centre"][o], w["last"][o]))
            if not (centres := claims(rows, least_hashes)):
                continue
            t, u = w["text"][m[0]], w["text"][o[0]]
            for spans in alike(shingles[before[t] : before[t + 1]], shingles[before[u] : before[u + 1]], np.array(centres), percent, passage_words):
                self.links.append((int(ids[t]), int(ids[u]), *spans))


def candidate_pairs(documents: DataFrame, percent: int, passage_words: int, least_hashes: int) -> DataFrame:
    """Confirmed links within slices (end_word not null), claims between slices (key, doc_id, at, other_id, other_at), and of minima that may have to be split (doc_id null): slices, differ, least and greatest context."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        s = _Slice(part, percent, passage_words, least_hashes)
        n, m = len(s.key), len(s.links)
        links = np.array(s.links, dtype=np.int64).reshape(m, 6)
        empty = pa.nulls(n, pa.int64())
        fields = [pa.concat_arrays([pa.array(s.key), pa.array(mix(np.arange(m, dtype=np.uint64) + links[:, 0].view(np.uint64)).view(np.int64))]), pa.concat_arrays([pa.array(s.doc, pa.int64()), pa.array(links[:, 0])]), pa.concat_arrays([pa.array(s.at, pa.int64()), pa.array(links[:, 2])])]
        fields += [pa.concat_arrays([empty, pa.array(links[:, i])]) for i in (1, 3, 4, 5)]
        fields += [pa.concat_arrays([pa.array(x, pa.int64(), mask=hidden), pa.nulls(m, pa.int64())]) for x, hidden in ((s.probes, None), (s.context, ~s.first_hash), (s.differ, ~s.first_hash))]
        return pa.RecordBatch.from_arrays(fields, ["key", "doc_id", "at", "other_id", "end_word", "other_start", "other_end", "probes", "context", "differ"])

    rows = map_batches(documents, run, "key long, doc_id long, at long, other_id long, end_word long, other_start long, other_end long, probes long, context long, differ long", limit=SLICE_BYTES)
    rows = rows.repartition("key").sortWithinPartitions("key", "doc_id", "at")

    def paired(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = last = None  # (key, doc_id, at, probes) of the first and of the last window of the minimum at hand
        for batch in source:
            links = batch.filter(batch.column(3).is_valid())
            if links.num_rows:
                yield pa.RecordBatch.from_arrays([links.column(0), links.column(1), links.column(3), links.column(2), links.column(4), links.column(5), links.column(6)], names)
            claimed = batch.filter(batch.column(3).is_null())
            if (told := _contexts(claimed.filter(claimed.column(8).is_valid()), names)).num_rows:
                yield told
            key, doc, at, probes = (claimed.column(i).to_numpy() for i in (0, 1, 2, 7))
            if head is not None:
                key, doc, at, probes = (np.concatenate(([h, p], c)) for h, p, c in zip(head, last, (key, doc, at, probes), strict=True))
            if not len(key):
                continue
            new = np.concatenate(([True], key[1:] != key[:-1]))
            begin = np.flatnonzero(new)
            to = begin[np.cumsum(new) - 1]
            previous = np.maximum(np.arange(len(key)) - 1, 0)
            fresh = np.arange(len(key)) >= (2 if head is not None else 0)
            star = np.flatnonzero(fresh & ~new & (doc != doc[to]))
            chain = np.flatnonzero(fresh & ~new & (previous != to) & (doc != doc[previous]))
            a, b = np.concatenate((star, chain)), np.concatenate((to[star], previous[chain]))
            same = agree(np.ascontiguousarray(probes).view(np.uint8).reshape(-1, len(PROBES)), a, b, matches)
            a, b = a[same], b[same]
            head = tuple(c[to[-1]] for c in (key, doc, at, probes))
            last = tuple(c[-1] for c in (key, doc, at, probes))
            if len(a):
                none = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(key[a]), pa.array(doc[a]), pa.array(doc[b]), pa.array(at[a]), none, pa.array(at[b]), none], names)

    names = ["key", "doc_id", "other_id", "start_word", "end_word", "other_start", "other_end"]
    matches = probes_within(shared_run(percent, passage_words))
    ship(documents.sparkSession)
    return rows.mapInArrow(paired, "key long, " + PAIRS)


def _contexts(rows: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    """Slices, differ, least and greatest context of the minima of sorted rows that may have to be split; those at either end may go on in another batch."""
    key, context, differ = (rows.column(i).to_numpy() for i in (0, 8, 9))
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, dtype=np.int64)
    if len(begin):
        slices = np.diff(np.append(begin, len(key)))
        low, high, most = np.minimum.reduceat(context, begin), np.maximum.reduceat(context, begin), np.maximum.reduceat(differ, begin)
        open_ = (most == 2) | ((slices > 1) & (most > 0)) | ((slices > 3) & (low != high))
        open_[[0, -1]] = True
        found = [x[open_] for x in (key[begin], slices, most, low, high)]
    else:
        found = [begin] * 5
    none = pa.nulls(len(found[0]), pa.int64())
    columns = [pa.array(x, pa.int64()) for x in found]
    return pa.RecordBatch.from_arrays([columns[0], none, columns[1], columns[2], none, columns[3], columns[4]], names)


def _to_split(found: DataFrame) -> np.ndarray | None:
    """Bitmap of the minima whose windows differ and are not all compared with each other; None if there is none."""
    told = found.where("doc_id is null").groupBy("key").agg(F.sum("other_id").alias("slices"), F.max("start_word").alias("differ"), F.min("other_start").alias("low"), F.max("other_end").alias("high"))
    keys = told.where("differ = 2 or (slices > 1 and differ > 0) or (slices > 3 and low <> high)")
    return _bitmap(keys)


def _bitmap(keys: DataFrame) -> np.ndarray | None:
    """Bitmap of keys; None if there is none."""
    word = F.shiftrightunsigned("key", 6).bitwiseAND(F.lit(SPLIT_WORDS - 1))
    bit = F.expr("shiftleft(1L, cast(key & 63 as int))")
    table = keys.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most SPLIT_WORDS rows
    if not table.num_rows:
        return None
    bitmap = np.zeros(SPLIT_WORDS, dtype=np.uint64)
    bitmap[table.column(0).to_numpy()] = table.column(1).to_numpy().view(np.uint64)
    return bitmap


def _surroundings(w: dict[str, np.ndarray], shingles: np.ndarray, before: np.ndarray, least: int, around: int) -> np.ndarray:
    """Hash of each window's minimum and all shingles so far around it, with its place in them."""
    begin, size = before[:-1][w["text"]], np.diff(before)[w["text"]]
    low, high = np.maximum(w["centre"] - around, 0), np.minimum(w["centre"] + around + 1, size)
    runs = runs_of(shingles, least)
    out = mix(w["key"] + ((w["centre"] - low) << 32 | (high - low)).astype(np.uint64))
    for step in range(-(-(2 * around + 1) // least)):
        out = mix(out + runs[begin + np.minimum(low + step * least, high - least)]) if len(out) else out
    return out


def _picked(shingles: np.ndarray) -> np.ndarray:
    """Places of the shingles that are the least of some NEAR_RUN on end, under a hash of its own; every shared stretch so long has one in common."""
    if len(shingles) < NEAR_RUN:
        return np.arange(len(shingles))
    hashed = mix(shingles ^ np.uint64(0x3C6EF372FE94F82B))
    lowest = np.zeros(len(shingles), dtype=bool)
    least = np.lib.stride_tricks.sliding_window_view(hashed, NEAR_RUN).argmin(axis=1)
    lowest[np.arange(len(least)) + least] = True
    return np.flatnonzero(lowest)


def _expanded(low: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of so many places from low on: the row and the place of each."""
    row = np.repeat(np.arange(len(low)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes - low, sizes)


def _near(w: dict[str, np.ndarray], run: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (first, last exclusive) of the shingles by which a window is told from others with its minimum.

    The stretches of `run` that a window holds with its centre begin and end within a certain range. A shared stretch has the centre of
    its last `run` shingles in common, so from there it goes on to such an end, and what follows it begins within BEYOND; the same holds before it.
    """
    return np.maximum(w["first"], w["centre"] - run + 1) - BEYOND, np.minimum(w["last"], w["centre"] + run) + BEYOND


def _partners(key: np.ndarray, doc: np.ndarray, start: np.ndarray, to: np.ndarray, fresh: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rows from `fresh` on and the first row of their key; of odd keys, whose rows may be unlike, the row before too.

    Many rows of an odd key are paired only if they differ between the centre and the shingle near it: else they have both in one stretch,
    as all texts with a common phrase have, and what follows their stretch is told by a later shingle. Pairs that are left out here
    come from unsettled_pairs, unless links join them anyway.
    """
    place = np.arange(len(key))
    previous = np.maximum(place - 1, 0)
    odd, stretch = key & key.dtype.type(1) == 1, start >> 32
    alone = odd & (stretch == stretch[to]) & (np.bincount(to, minlength=len(key))[to] > FEW)
    star = np.flatnonzero((place >= fresh) & (doc != doc[to]) & ~alone)
    chain = np.flatnonzero((place >= fresh) & odd & (previous > to) & (doc != doc[previous]) & (stretch != stretch[previous]))
    return np.concatenate((star, chain)), np.concatenate((to[star], previous[chain]))


def _in_bitmap(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    return (bitmap[(key >> np.uint64(6)) & np.uint64(SPLIT_WORDS - 1)] >> (key & np.uint64(63))) & np.uint64(1) > 0


def not_split(claimed: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """Claims of minima that split_pairs leaves alone."""
    sent = claimed.sparkSession.sparkContext.broadcast(bitmap)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            yield batch.filter(pa.array(~_in_bitmap(sent.value, batch.column(0).to_numpy().view(np.uint64))))

    return claimed.mapInArrow(run, claimed.schema)


def split_pairs(documents: DataFrame, bitmap: np.ndarray, percent: int, passage_words: int) -> DataFrame:
    """Equal runs of the minima in the bitmap: confirmed links within slices (end_word not null), and between slices the place of one run for each pair of documents and distance."""
    return split_rows(documents, bitmap, percent, passage_words).where("doc_id is not null").select(*_FIELDS)


def split_rows(documents: DataFrame, bitmap: np.ndarray, percent: int, passage_words: int) -> DataFrame:
    """The rows of split_pairs, and those by which _unsettled finds what they leave open (doc_id null, see _told)."""
    least = passage_words - SHINGLE_WORDS + 1
    run_least = shared_run(percent, passage_words)
    around = max(least, run_least + BEYOND) - 1  # all that a window is split by lies so near its centre
    sent = documents.sparkSession.sparkContext.broadcast(bitmap)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        ids = part.column(0).to_numpy()
        words, first = words_of(part.column(1), ALNUM_BYTES)
        shingles, before = shingles_of(words, first, SHINGLE_WORDS)
        w = windows_of(shingles, before, least, run_least)
        order = np.flatnonzero(_in_bitmap(sent.value, w["key"]))
        order = order[np.lexsort((w["centre"][order], ids[w["text"][order]]))]
        w = {n: v[order] for n, v in w.items()}
        key, text, start = _surroundings(w, shingles, before, least, around) << np.uint64(2), w["text"], w["centre"]
        w = {n: v[np.sort(np.unique(key, return_index=True)[1])] for n, v in w.items()}  # one window of each surroundings is split
        low, high = _starts(w, least)
        window, first = _expanded(low, np.maximum(high - low + 1, 0))
        runs = runs_of(shingles, least)[before[:-1][w["text"][window]] + first] << np.uint64(2) | np.uint64(2)
        picked = _picked(shingles)
        begin, size = before[:-1][w["text"]], np.diff(before)[w["text"]]
        low, high = (np.searchsorted(picked, begin + np.clip(x, 0, size)) for x in _near(w, run_least))
        near, at = _expanded(low, high - low)
        met = mix(shingles[picked[at]] + w["key"][near]) | np.uint64(1)
        sums = np.cumsum(mix(shingles))
        centre = w["centre"][near]
        stretch = mix(sums[picked[at]] - sums[begin[near] + centre] + (picked[at] - begin[near] - centre).astype(np.uint64)) >> np.uint64(40)
        key, text, start = (np.concatenate(x) for x in ((key, runs, met), (text, w["text"][window], w["text"][near]), (start, first, stretch.astype(np.int64) << 32 | centre)))
        del window, near, at, met, runs, first, centre, stretch
        order = np.argsort(key, kind="stable")  # by document and place within a key
        key, text, start = key[order], text[order], start[order]
        doc = ids[text]
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        head = np.flatnonzero(new)
        to = head[np.cumsum(new) - 1] if len(key) else head
        mine, other = _partners(key, doc, start, to)
        links: list[tuple[int, ...]] = []
        order, begin = _grouped(text[other], text[mine])
        mine, other = mine[order], other[order]
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(mine)][: len(begin)], strict=True):
            t, u = text[mine[a]], text[other[a]]
            centres = np.column_stack((start[mine[a:b]], start[other[a:b]])) & 0xFFFFFFFF
            for x, end, y, other_end in alike(shingles[before[t] : before[t + 1]], shingles[before[u] : before[u + 1]], centres, percent, passage_words):
                links.append((int(ids[t]), int(ids[u]), x, end, y, other_end))
        m = len(links)
        rows = np.array(links, dtype=np.int64).reshape(m, 6)
        head, varied = _heads(key, _linked(rows[:, :2], doc), start, head, to)
        key, doc, head_start = key[head], doc[head], start[head]
        spread = mix(np.arange(m, dtype=np.uint64) + rows[:, 0].view(np.uint64))
        columns = [np.concatenate(x) for x in ((key.view(np.int64), spread.view(np.int64)), (doc, rows[:, 0]), (head_start, rows[:, 2]), (varied, rows[:, 4]))]
        none = pa.nulls(len(head), pa.int64())
        key, doc, start, other_start = (pa.array(x, pa.int64()) for x in columns)
        other, end, other_end = (pa.concat_arrays([none, pa.array(rows[:, i])]) for i in (1, 3, 5))
        fields = [key, doc, start, other, end, other_start, other_end]
        return pa.RecordBatch.from_arrays(fields, ["key", "doc_id", "start_word", "other_id", "end_word", "other_start", "other_end"])

    rows = map_batches(documents, run, "key long, doc_id long, start_word long, other_id long, end_word long, other_start long, other_end long", limit=SLICE_BYTES // 2)
    rows = rows.repartition("key").sortWithinPartitions("key", "doc_id", "start_word")

    def paired(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = last = None  # (key, doc_id, start) of the first and of the last row of the key at hand
        for batch in source:
            links = batch.filter(batch.column(3).is_valid())
            if links.num_rows:
                links = links.select(_FIELDS)
                yield pa.RecordBatch.from_arrays([pa.nulls(links.num_rows, pa.int64()), *links.columns], ["key", *_FIELDS])
            heads = batch.filter(batch.column(3).is_null())
            if (told := _told(heads)).num_rows:
                yield told
            key, doc, start = (heads.column(i).to_numpy() for i in range(3))
            fresh = 2 if head is not None else 0
            if head is not None:
                key, doc, start = (np.concatenate(([h, p], c)) for h, p, c in zip(head, last, (key, doc, start), strict=True))
            if not len(key):
                continue
            begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            to = np.repeat(begin, np.diff(np.append(begin, len(key))))
            head, last = tuple(c[to[-1]] for c in (key, doc, start)), tuple(c[-1] for c in (key, doc, start))
            a, b = _partners(key, doc, start, to, fresh)
            at = start & 0xFFFFFFFF
            if not len(a):
                continue
            mine, other, distance, places = _places(doc[a], doc[b], at[b] - at[a], at[a])
            none = pa.nulls(len(mine), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(mine), pa.array(other), pa.array(places), none, pa.array(places + distance), none], ["key", *_FIELDS])

    return _least_places(rows.mapInArrow(paired, "key long, " + PAIRS))


def _least_places(found: DataFrame) -> DataFrame:
    """Confirmation follows a distance through both texts, so one place of each is enough; links and other rows stay."""
    distance, link_start = F.col("other_start") - F.col("start_word"), F.when(F.col("end_word").isNotNull(), F.col("start_word"))
    least = found.groupBy("key", "doc_id", "other_id", distance.alias("distance"), "end_word", "other_end", link_start.alias("link_start")).agg(F.min("start_word").alias("start_word"))
    return least.withColumn("other_start", F.col("start_word") + F.col("distance")).select("key", *_FIELDS)


def _linked(links: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each row of a slice the least document that links lead to from its own."""
    root: dict[int, int] = {}

    def of(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    for a, b in np.unique(links, axis=0).tolist():
        a, b = of(a), of(b)
        root[max(a, b)] = min(a, b)
    known = np.array(sorted(root), dtype=np.int64)
    if not len(known):
        return doc
    at = np.minimum(np.searchsorted(known, doc), len(known) - 1)
    return np.where(known[at] == doc, np.array([of(x) for x in known.tolist()], dtype=np.int64)[at], doc)


def _heads(key: np.ndarray, linked: np.ndarray, start: np.ndarray, head: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that a slice shows to others, and whether they stand for several stretches: the first of a key, of odd keys the first of all that links join."""
    many = np.bincount(to[(linked != linked[to]) & (key & np.uint64(1) > 0)], minlength=len(key)) > 0
    rows = np.flatnonzero(many[to])
    rows = rows[np.lexsort((linked[rows], key[rows]))]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (key[rows[1:]] != key[rows[:-1]]) | (linked[rows[1:]] != linked[rows[:-1]])
    first = to.copy()
    if len(rows):
        first[rows] = rows[np.flatnonzero(new)][np.cumsum(new) - 1]
    varied = np.bincount(first[start >> 32 != start[first] >> 32], minlength=len(key)) > 0
    head = np.union1d(head, rows[new])
    head = head[key[head] & np.uint64(3) > 0]  # equal surroundings in other slices meet by what they are split into
    return head, varied[head].astype(np.int64)


def _told(rows: pa.RecordBatch) -> pa.RecordBatch:
    """key, document (as other_id), whether it stands for several stretches (as end_word) and stretch (as other_start) of the odd keys of sorted rows that may have several; those at either end may go on in another batch."""
    key, start, varied = (rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 5))
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, dtype=np.int64)
    sizes = np.diff(np.append(begin, len(key)))
    stretch = start >> 32
    if len(begin):
        differ = (np.minimum.reduceat(stretch, begin) != np.maximum.reduceat(stretch, begin)) | (np.maximum.reduceat(varied, begin) > 0) & (sizes > 1)
        differ[[0, -1]] = True
        found = np.repeat(differ, sizes) & (key & 1 > 0)
    else:
        found = np.zeros(0, dtype=bool)
    rows = rows.filter(pa.array(found))
    none, zero = pa.nulls(rows.num_rows, pa.int64()), pa.array(np.zeros(rows.num_rows, dtype=np.int64))
    return pa.RecordBatch.from_arrays([rows.column(0), none, rows.column(1), zero, pa.array(varied[found], pa.int64()), pa.array(stretch[found], pa.int64()), none], ["key", *_FIELDS])


def _unsettled(told: DataFrame, labels: DataFrame) -> tuple[np.ndarray, DataFrame] | None:
    """Bitmap of the odd keys that documents of several classes have with several stretches, and (node, component) of all documents of these classes; None if there is none."""
    named = labels.select(F.col("node").alias("other_id"), "component")
    if labels.count() <= BROADCAST_NODES:
        named = F.broadcast(named)
    told = told.join(named, "other_id", "left").select("key", F.coalesce("component", "other_id").alias("component"), F.col("other_start").alias("stretch"), F.col("end_word").alias("varied"))
    sides = [f(c).alias(f"{n}_{c}") for c in ("component", "stretch") for n, f in (("low", F.min), ("high", F.max))]
    keys = told.groupBy("key").agg(*sides, F.max("varied").alias("varied")).where("low_component <> high_component and (low_stretch <> high_stretch or varied > 0)").select("key")
    keys = written(keys)
    if (bitmap := _bitmap(keys)) is None:
        return None
    classes = written(told.join(keys, "key", "left_semi").select("component").distinct())
    alone = classes.join(labels.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), "component")
    return bitmap, written(labels.join(classes, "component", "left_semi").select("node", "component").unionByName(alone))


def _unlike_rows(key: np.ndarray, component: np.ndarray, doc: np.ndarray, place: np.ndarray, follows: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """All rows of a key that differ in what follows and belong to different classes: document, other document, distance and place."""
    order, begin = _grouped(key, follows)
    key, component, doc, place = (c[order] for c in (key, component, doc, place))
    sizes = np.diff(np.append(begin, len(key)))
    end = np.repeat(begin + sizes, sizes)
    met = np.searchsorted(key, key, side="right") - end  # those that come later in the key and differ
    done = np.cumsum(met)
    since = 0
    while since < len(key):
        to = max(since + 1, int(np.searchsorted(done, (done[since - 1] if since else 0) + PAIRED_ROWS, side="right")))
        a, b = _expanded(end[since:to], met[since:to])
        a += since
        since = to
        a, b = np.where(doc[a] > doc[b], a, b), np.where(doc[a] > doc[b], b, a)
        unlike = component[a] != component[b]
        a, b = a[unlike], b[unlike]
        if len(a):
            yield _places(doc[a], doc[b], place[b] - place[a], place[a])


def unsettled_pairs(documents: DataFrame, split: np.ndarray, bitmap: np.ndarray, percent: int, passage_words: int) -> DataFrame:
    """Places of all pairs of documents (doc_id, component, text) of different classes that share a minimum and a shingle near it, in the bitmap, and may go on there beyond an edit.

    A shared stretch has its last run in common, what follows it differs, and the next stretch has a shingle by which it is told; the same holds
    before it. Rows are those runs with each such shingle: equal ones of different classes that differ in what follows are all paired.
    """
    least = passage_words - SHINGLE_WORDS + 1
    run_least = shared_run(percent, passage_words)
    # a passage without what it doesn't need to be long enough: less than that, a gap and a run, and no longer on either side
    around = -(-100 * least // percent) + GAP + SHINGLE_WORDS + least
    sent = documents.sparkSession.sparkContext.broadcast((split, bitmap))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        split, bitmap = sent.value
        ids, component = part.column(0).to_numpy(), part.column(1).to_numpy()
        words, first = words_of(part.column(2), ALNUM_BYTES)
        shingles, before = shingles_of(words, first, SHINGLE_WORDS)
        w = windows_of(shingles, before, least, run_least)
        order = np.flatnonzero(_in_bitmap(split, w["key"]))
        w = {n: v[order] for n, v in w.items()}
        around_key = mix(_surroundings(w, shingles, before, least, around) + mix(component.view(np.uint64)[w["text"]]))
        w = {n: v[np.sort(np.unique(around_key, return_index=True)[1])] for n, v in w.items()}  # one window of each surroundings and class
        picked = _picked(shingles)
        begin, size = before[:-1][w["text"]], np.diff(before)[w["text"]]
        # stretches that have this minimum in their last or first run end, or begin, at one of these places of the window
        ends = np.maximum(w["first"] + run_least, w["centre"] + 1), np.minimum(w["last"], w["centre"] + run_least)
        begins = np.maximum(w["first"], w["centre"] - run_least + 1), np.minimum(w["centre"], w["last"] - run_least)
        runs = runs_of(shingles, run_least)
        found = [(np.empty(0, dtype=np.uint64), *[np.empty(0, dtype=np.int64)] * 2, np.empty(0, dtype=np.uint64))]
        for since in range(0, len(begin), NEAR_WINDOWS):
            some = slice(since, since + NEAR_WINDOWS)
            for side, (low, high) in enumerate((ends, begins)):
                a, b = (low, high + BEYOND) if side == 0 else (low - BEYOND, high)
                a, b = (np.searchsorted(picked, begin[some] + np.clip(x[some], 0, size[some])) for x in (a, b))
                near, at = _expanded(a, np.maximum(b - a, 0))
                near, at = near + since, picked[at]
                ok = _in_bitmap(bitmap, mix(shingles[at] + w["key"][near]) | np.uint64(1))
                near, at = near[ok], at[ok]
                place = at - begin[near]
                a, b = (np.maximum(low[near], place - BEYOND + 1), np.minimum(high[near], place)) if side == 0 else (np.maximum(low[near], place + 1), np.minimum(high[near], place + BEYOND))
                row, edge = _expanded(a, np.maximum(b - a + 1, 0))
                near, at = near[row], at[row]
                edge += begin[near]
                key = mix(runs[edge - (run_least if side == 0 else 0)] + mix(shingles[at] + np.uint64(side)))
                once = np.unique(mix(key + mix(edge.astype(np.uint64))), return_index=True)[1]  # a word said over and over is near many times
                key, near, edge = key[once], near[once], edge[once]
                found.append((key, w["text"][near], edge - begin[near], shingles[edge - side]))
        key, text, place, follows = (np.concatenate(x) for x in zip(*found, strict=True))
        columns = [key.view(np.int64), component[text], ids[text], place, follows.view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["key", "component", "doc_id", "place", "follows"])

    rows = map_batches(documents, run, "key long, component long, doc_id long, place long, follows long", limit=BATCH_BYTES // 4)
    rows = rows.repartition("key").sortWithinPartitions("key")

    def paired(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the key at hand
        for batch in source:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            end = int(np.searchsorted(key, key[-1]))
            if end or (held and held[-1].column(0)[-1].as_py() != key[0]):
                yield from claimed([*held, batch.slice(0, end)])
                held = []
            held.append(batch.slice(end))
        if held:
            yield from claimed(held)

    def claimed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mine, other, distance, places in _unlike_rows(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(5))):
            none = pa.nulls(len(mine), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(mine), pa.array(other), pa.array(places), none, pa.array(places + distance), none], ["key", *_FIELDS])

    return _least_places(rows.mapInArrow(paired, "key long, " + PAIRS)).select(*_FIELDS)


def _places(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The least place of each document, other document and distance; a pair has many keys, but one distance or few."""
    order = np.lexsort(columns[::-1])
    doc, other, distance, at = (c[order] for c in columns)
    new = np.ones(len(order), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (other[1:] != other[:-1]) | (distance[1:] != distance[:-1])
    return doc[new], other[new], distance[new], at[new]


def _confirmed(documents: DataFrame, claimed: DataFrame, percent: int, passage_words: int, least_hashes: int) -> DataFrame:
    pairs = claimed.groupBy("doc_id", "other_id").agg(F.collect_list(F.struct("key", "start_word", "other_start")).alias("claims"))
    pairs = written(pairs)
    nodes = pairs.select(F.explode(F.array("doc_id", "other_id")).alias("node")).distinct()
    if nodes.count() <= BROADCAST_NODES:
        nodes = F.broadcast(nodes)
    texts = documents.select(F.col("doc_id").alias("node"), "text").join(nodes, "node", "left_semi")
    rows = pairs.join(texts.select(F.col("node").alias("doc_id"), "text"), "doc_id").join(texts.select(F.col("node").alias("other_id"), F.col("text").alias("other_text")), "other_id")
    rows = rows.select("doc_id", "other_id", "claims", "text", "other_text")

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple[int, ...]] = []
        sides = []
        for i in (3, 4):
            texts = part.column(i).dictionary_encode()  # the first document of many is a partner of all of them
            words, first = words_of(texts.dictionary, ALNUM_BYTES)
            shingles, before = shingles_of(words, first, SHINGLE_WORDS)
            sides.append((texts.indices.to_pylist(), shingles, before))
        (a_text, a, a_at), (b_text, b, b_at) = sides
        orders: dict[int, np.ndarray] = {}
        lists = part.column(2)
        offsets = lists.offsets.to_numpy()
        key, mine, other = (lists.values.field(n).to_numpy() for n in range(3))
        first, centre, last = _unpack(mine)
        other_first, other_centre, other_last = _unpack(other)
        all_claims = np.column_stack((key, first, centre, last, other_first, other_centre, other_last))
        for row, (doc, other_doc) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
            if centres := claims(all_claims[offsets[row] : offsets[row + 1]], least_hashes):
                t, u = a_text[row], b_text[row]
                other = b[b_at[u] : b_at[u + 1]]
                if u not in orders:
                    orders[u] = np.argsort(other, kind="stable")
                for spans in alike(a[a_at[t] : a_at[t + 1]], other, np.array(centres), percent, passage_words, order=orders[u]):
                    out.append((doc, other_doc, *spans))
        table = np.array(out, dtype=np.int64).reshape(len(out), 6)
        return pa.RecordBatch.from_arrays([pa.array(table[:, i]) for i in range(6)], _FIELDS)

    return map_batches(rows, run, PAIRS)


def repeated_passages(documents: DataFrame, percent: int = PERCENT, passage_words: int = PASSAGE_WORDS, least_hashes: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per confirmed pair of passages in different documents: doc_id, other_id, start_word, end_word, other_start, other_end, class_id.

    The pairs link all documents that share passages, copies through one of them; class_id is the smallest doc_id reachable.
    """
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    found = written(candidate_pairs(rows, percent, passage_words, least_hashes))
    claimed = found.where("doc_id is not null and end_word is null").select("key", *_FIELDS)
    confirmed = found.where("end_word is not null").select(*_FIELDS)
    at = lambda start: F.shiftleft(start, 32) + F.lit(passage_words - SHINGLE_WORDS + 1)
    none = F.lit(None).cast("long")
    # equal runs have equal minima under all hashes
    claims_at = lambda places: places.select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(least_hashes).cast("long"))).alias("key"), "doc_id", "other_id", at(F.col("start_word")).alias("start_word"), none.alias("end_word"), at(F.col("other_start")).alias("other_start"), none.alias("other_end"))
    bitmap = _to_split(found)
    if bitmap is not None:
        runs = written(split_rows(rows, bitmap, percent, passage_words))
        claimed = not_split(claimed, bitmap)
        confirmed = confirmed.unionByName(runs.where("doc_id is not null and end_word is not null").select(*_FIELDS))
        claimed = claimed.unionByName(claims_at(runs.where("doc_id is not null and end_word is null")))
    pairs = confirmed.unionByName(_confirmed(rows, claimed, percent, passage_words, least_hashes))
    pairs = written(pairs.distinct())
    labels = components(pairs.select("doc_id", "other_id").distinct(), "doc_id", "other_id")
    if bitmap is not None and (unsettled := _unsettled(runs.where("doc_id is null"), labels)) is not None:
        keys, nodes = unsettled
        named = F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes
        places = unsettled_pairs(rows.join(named, rows["doc_id"] == nodes["node"]).select("doc_id", "component", "text"), bitmap, keys, percent, passage_words)
        more = _confirmed(rows, claims_at(places), percent, passage_words, least_hashes)
        more = written(more.distinct())
        if more.limit(1).count():
            pairs = pairs.unionByName(more).distinct()
            labels = components(pairs.select("doc_id", "other_id").distinct(), "doc_id", "other_id")
    return pairs.join(labels.select(F.col("node").alias("doc_id"), F.col("component").alias("class_id")), "doc_id")


def spans_of_documents(pairs: DataFrame) -> DataFrame:
    """doc_id, spans (start, end of repeated stretches of words), repeated_words of every document in the pairs."""
    sides = pairs.select("doc_id", F.col("start_word").alias("start"), F.col("end_word").alias("end")).unionByName(pairs.select(F.col("other_id").alias("doc_id"), F.col("other_start").alias("start"), F.col("other_end").alias("end")))
    starts = sides.groupBy("doc_id", "start").agg(F.max("end").alias("end"))  # as many as words at most
    listed = starts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("all"))
    merged = F.expr("""aggregate(all, cast(array() as array<struct<start:bigint,end:bigint>>), (done, s) ->
        case when size(done) > 0 and s.start <= element_at(done, -1).end
             then concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start, 'end', greatest(element_at(done, -1).end, s.end))))
             else concat(done, array(s)) end)""")
    return listed.select("doc_id", merged.alias("spans")).withColumn("repeated_words", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]))


def summary(documents: DataFrame) -> DataFrame:
    """All confirmed pairs of passages of 50 words or more."""
    return repeated_passages(documents)
