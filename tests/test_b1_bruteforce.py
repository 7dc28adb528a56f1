"""B1 against a sequential brute-force model on random small inputs.

The model walks sources in order and lines in arrival order, keeping the
last in-window timestamp per source, then ranks all matched lines by
(rank time, NULL lowest, arrival) and keeps the newest K.
"""

import random
from datetime import datetime, timezone

import pytest

from obsspark.operators import rank
from obsspark.params import ServiceLogParams, TimeWindow
from obsspark.plans import service_logs
from obsspark.plans.service_logs import collect_service_logs

BASE = 1_704_067_200_000  # 2024-01-01T00:00:00Z


def _iso(ms):
    return datetime.fromtimestamp(ms / 1000, tz=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def _random_case(seed, long=1):
    rnd = random.Random(seed)
    sources = []
    for s in range(rnd.randint(1, 4)):
        for f in range(rnd.randint(0, 2)):
            sources.append((f"svc{s}", f"/log/{s}-{f}", False, None))
        if rnd.random() < 0.7:
            sources.append((f"svc{s}", f"unit{s}", True, rnd.choice(["system", "user"])))
    words = ["alpha", "beta", "error", "gamma"]
    lines, seq = [], 0
    for (svc, name, is_j, _scope) in sources:
        for _ in range(rnd.randint(0, 12 * long)):
            kind = rnd.random()
            w = rnd.choice(words)
            if kind < 0.45:
                raw = f"{_iso(BASE + rnd.randint(0, 48) * 3_600_000)} {w} {rnd.randint(0, 9)}"
            elif kind < 0.65:
                raw = f"{w} untimestamped {rnd.randint(0, 9)}"
            elif kind < 0.72:
                raw = ""
            elif kind < 0.80:
                raw = "   "
            elif kind < 0.85:
                raw = "-- No entries --"
            elif kind < 0.90:
                raw = f"2024-02-30T00:00:00Z {w}"
            else:
                raw = f"{_iso(BASE + rnd.randint(0, 48) * 3_600_000)}"
            lines.append((svc, name, is_j, seq, raw))
            seq += 1
    window = None
    if rnd.random() < 0.6:
        a = rnd.randint(0, 30)
        window = TimeWindow(start=_iso(BASE + a * 3_600_000), end=_iso(BASE + (a + rnd.randint(0, 18)) * 3_600_000),
                            max_seconds=10 * 86_400)
    inc = tuple(rnd.sample(words, rnd.randint(0, 2)))
    exc = tuple(rnd.sample(["beta", "9", "untimestamped"], rnd.randint(0, 1)))
    params = ServiceLogParams(now_ms=BASE + 49 * 3_600_000, tail_lines=rnd.randint(0, 8), include=inc, exclude=exc,
                              window=window, max_total_log_lines=rnd.randint(1, 15))
    return sources, lines, params


def _ms(tok):
    try:
        if len(tok) == 20 and tok.endswith("Z"):
            return int(datetime.strptime(tok, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc).timestamp() * 1000)
    except ValueError:
        return None
    return None


def _model(sources, lines, params):
    start, end = params.window_ms()
    by_src = {}
    for row in lines:
        by_src.setdefault((row[0], row[1]), []).append(row)
    cands, counts = [], {}
    for (svc, name, is_j, scope) in sorted(sources, key=lambda s: (s[0], s[2], s[1])):
        rows = sorted(by_src.get((svc, name), []), key=lambda r: r[3])
        if not is_j or params.window is None:
            rows = rows[-params.tail_lines:] if params.tail_lines > 0 else []
            if not is_j and rows and not any(r[4].strip() for r in rows):
                rows = []
        if is_j:
            rows = [r for r in rows if r[4].strip() and r[4].strip() != "-- No entries --"]
        rows = [r for r in rows if r[4]]
        last, raw_n, matched_n = None, 0, 0
        for r in rows:
            raw = r[4]
            raw_n += 1
            sp = raw.find(" ")
            ms = _ms(raw[:sp]) if sp > 0 else None
            windowed = is_j and params.window is not None
            in_win = (not windowed) or ms is None or start <= ms <= end
            if ms is not None and in_win:
                last = ms
            ok = in_win and (not params.include or any(p in raw for p in params.include)) \
                and not any(p in raw for p in params.exclude)
            if ok:
                matched_n += 1
                line = raw[sp + 1:] if ms is not None else raw
                cands.append(((ms if ms is not None else last), (svc, is_j, name, r[3]), line, svc, name))
        counts[(svc, name)] = [raw_n, matched_n, 0]
    cands.sort(key=lambda c: ((c[0] is not None), c[0] if c[0] is not None else 0, c[1]))
    top = cands[-params.max_total_log_lines:]
    for c in top:
        counts[(c[3], c[4])][2] += 1
    return [(c[3], c[4], c[1][3], c[2], c[0]) for c in top], counts


@pytest.mark.parametrize("seed, long, kept", [*[(s, 1, False) for s in range(12)], *[(s, 30, True) for s in range(100, 106)]])
def test_b1_matches_sequential_model(spark, monkeypatch, seed, long, kept):
    """Short and long sources, as a plan and with what the pass leaves stored, also with a tree of several levels."""
    if long > 1:
        monkeypatch.setattr(service_logs, "merge_levels", lambda spark: 1)
        monkeypatch.setattr(rank, "merge_levels", lambda spark, fan_in: 3)
    sources, lines, params = _random_case(seed, long)
    want_sel, want_counts = _model(sources, lines, params)
    src = spark.createDataFrame(sources, "service string, file string, is_journal boolean, journal_scope string")
    ln = spark.createDataFrame(lines, "service string, file string, is_journal boolean, seq long, raw string")
    res = collect_service_logs(ln.repartition(5), src, None, params, materialize=kept, chunk_rows=3 * long)
    got_sel = sorted((r.service, r.file, r.seq, r.line, r.rank_ms) for r in res.selected.collect())
    assert got_sel == sorted(want_sel, key=lambda t: (t[0], t[1], t[2]))
    got_counts = {(r.service, r.file): [r.raw_log_records, r.matched_log_records, r.returned_log_records]
                  for r in res.summary.collect()}
    assert got_counts == want_counts
    t = res.totals.collect()
    matched = sum(v[1] for v in want_counts.values())
    if sources:
        assert (t[0].matched_log_records, t[0].returned_log_records, t[0].line_limited) == (
            matched, len(want_sel), matched > len(want_sel))
