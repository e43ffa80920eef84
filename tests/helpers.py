"""Small inputs and plain-Python models of the operators."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from wellstream.schemas import READING_SCHEMA

A = "11111111-1111-4111-8111-111111111111"
B = "22222222-2222-4222-8222-222222222222"
T0 = datetime(2024, 6, 15, 8, 0, 0)


def reading(device="D1", session=A, sequence=1, arrival=1, at=0.0, gamma=50.0, operation="DrillingAhead", rate=18.0,
            depth=1000.0, mode="RealTime", acquired=None):
    received = T0 + timedelta(seconds=at)
    return (device, session, sequence, "W", "Well", "WB", "Bore", depth, operation, rate, 8000.0, 100.0, gamma,
            acquired or received, mode, received, arrival)


def frame(spark, rows):
    return spark.createDataFrame(rows, READING_SCHEMA)


def random_trace(seed: int, rows: int, devices: int = 3, sessions: int = 3, hot: float = 0.5):
    """Arrivals with late readings, copies and conflicts; one stream holds a large share."""
    rng = random.Random(seed)
    names = [A, B, "33333333-3333-4333-8333-333333333333", "44444444-4444-4444-8444-444444444444"][:sessions]
    out, at = [], 0.0
    for n in range(1, rows + 1):
        at += rng.choice([1, 3, 7, 20, 31, 45])
        if rng.random() < hot:
            device, session = "D0", A
        else:
            device, session = f"D{rng.randrange(devices)}", rng.choice(names)
        out.append(reading(device, session, rng.randrange(1, 2 + n // 3), n, at, rng.choice([50.0, 50.0, 51.0])))
    return out


def model(trace):
    """arrival_no -> (store status, previous, sequence status, gap, outcome)."""
    first, last, out = {}, {}, {}
    for row in sorted(trace, key=lambda r: r[16]):
        key, stream, seq = row[:3], row[:2], row[2]
        content = row[:15]
        if key in first:
            status = "Duplicate" if first[key] == content else "Conflict"
            out[row[16]] = (status, None, None, None, status)
            continue
        first[key] = content
        prev = last.get(stream)
        if prev is None:
            name, gap = "Baseline", None
        elif seq > prev:
            name, gap = ("InOrder", None) if seq == prev + 1 else ("Gap", seq - prev - 1)
        else:
            name, gap = "OutOfOrder", None
        last[stream] = seq if prev is None else max(prev, seq)
        out[row[16]] = ("Stored", prev, name, gap, "LateArrival" if name == "OutOfOrder" else "Published")
    return out


def model_conflicts(stored, window: float):
    """(device, existing, observed, arrival_no) by keeping every active session of every device."""
    active, silenced, out = {}, {}, set()
    for row in sorted(stored, key=lambda r: (r[15], r[16])):
        device, session, t = row[0], row[1], row[15]
        seen, quiet = active.setdefault(device, {}), silenced.setdefault(device, set())
        for idle in [s for s, x in seen.items() if (t - x[0]).total_seconds() > window]:
            seen.pop(idle)
            for pair in [p for p in quiet if idle in p]:
                quiet.discard(pair)
        rest = {s: x for s, x in seen.items() if s != session}
        seen[session] = (t, row[16])
        if rest:
            other = max(rest, key=rest.get)
            if frozenset((other, session)) not in quiet:
                quiet.add(frozenset((other, session)))
                out.add((device, other, session, row[16]))
    return out
