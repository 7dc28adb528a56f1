"""P1/P2/P3/P4/P10 column functions, literal cases."""

from pyspark.sql import functions as F

from obsspark.functions import exclude_any, include_any, is_journal_noise, line_time_ms, parse_line_columns


def _parse(spark, raw, timestamps=True):
    df = spark.createDataFrame([(raw,)], "raw string")
    ts, line, ms = parse_line_columns(F.col("raw"), timestamps)
    r = df.select(ts.alias("ts"), line.alias("line"), ms.alias("ms")).first()
    return r["ts"], r["line"], r["ms"]


def test_leading_space_is_not_a_token(spark):
    assert _parse(spark, " 2001-09-09T01:46:40Z x") == (None, " 2001-09-09T01:46:40Z x", None)


def test_line_time_variants(spark):
    cases = {
        "2024-01-01T00:00:00Z": 1704067200000,
        "2024-01-01T00:00:00.123456Z": 1704067200123,
        "2024-01-01T00:00:00,5Z": 1704067200500,
        "2024-01-01T00:00:00.123456789012Z": 1704067200123,
        "2024-02-29T00:00:00Z": 1709164800000,
        "2023-02-29T00:00:00Z": None,
        "2024-01-01T24:00:00Z": None,
        "2024-01-01T23:60:00Z": None,
        "2024-13-01T00:00:00Z": None,
        "2024-01-01T12:00:00+0000": 1704110400000,
        "2024-01-01T12:00:00-0330": 1704123000000,
        "2024-01-01T12:00:00+05:30": 1704090600000,
        "2024-01-01T12:00:00": 1704110400000,
        "2024-01-01 12:00:00": None,
        "1700000000": None,
        "": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "tok string")
    got = {r["tok"]: r["ms"] for r in df.select("tok", line_time_ms(F.col("tok")).alias("ms")).collect()}
    assert got == cases


def test_include_exclude_on_raw_line(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z a error",), ("INFO ok",), ("2024-01-01T00:00:00Z",)],
                               "raw string")
    inc = [r.raw for r in df.filter(include_any(F.col("raw"), ["error", "2024-01-01T00:00:00Z"])).collect()]
    assert sorted(inc) == ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z a error"]
    assert df.filter(include_any(F.col("raw"), [])).count() == 3
    exc = [r.raw for r in df.filter(~exclude_any(F.col("raw"), ["ok", "error"])).collect()]
    assert exc == ["2024-01-01T00:00:00Z"]


def test_journal_noise(spark):
    rows = ["", "   ", "\t", "-- No entries --", "--No entries--", "  --  No entries  --  ", "-- entries --", "x"]
    df = spark.createDataFrame([(r,) for r in rows], "raw string")
    kept = [r.raw for r in df.filter(~is_journal_noise(F.col("raw"))).collect()]
    assert kept == ["-- entries --", "x"]


def _model_ms(tok):
    """Plain-Python model of the line timestamp rule."""
    import calendar
    import re
    m = re.fullmatch(r"(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})(?:[.,](\d+))?(Z|[+-]\d{2}:?\d{2})?", tok)
    if not m:
        return None
    y, mo, d, h, mi, s = (int(x) for x in m.groups()[:6])
    if not 1 <= mo <= 12 or not 1 <= d <= calendar.monthrange(y, mo)[1] or h > 23 or mi > 59 or s > 59:
        return None
    ms = int(((m.group(7) or "") + "000")[:3])
    off = 0
    if m.group(8) and m.group(8) != "Z":
        z = m.group(8).replace(":", "")
        off = (1 if z[0] == "+" else -1) * (int(z[1:3]) * 60 + int(z[3:5]))
        if int(z[1:3]) > 18 or int(z[3:5]) > 59:
            return None
    return (calendar.timegm((y, mo, d, h, mi, s)) - off * 60) * 1000 + ms


def test_line_time_matches_model_on_random_tokens(spark):
    import random
    rnd = random.Random(11)
    toks = []
    for _ in range(600):
        y = rnd.choice([1900, 2000, 2023, 2024, 2100, rnd.randint(1970, 2099)])
        mo, d = rnd.randint(0, 13), rnd.randint(0, 32)
        h, mi, s = rnd.randint(0, 25), rnd.randint(0, 61), rnd.randint(0, 61)
        frac = rnd.choice(["", ".5", ",25", ".123", ".1234567", ".000001"])
        tz = rnd.choice(["", "Z", "+00:00", "-03:30", "+0530", "+1400", "-0800"])
        toks.append(f"{y:04d}-{mo:02d}-{d:02d}T{h:02d}:{mi:02d}:{s:02d}{frac}{tz}")
    toks += ["2024-02-29T23:59:59Z", "2100-02-29T00:00:00Z", "2000-02-29T00:00:00Z", "2024-4-01T00:00:00Z"]
    df = spark.createDataFrame([(t,) for t in toks], "tok string")
    got = {r.tok: r.ms for r in df.select("tok", line_time_ms(F.col("tok")).alias("ms")).collect()}
    bad = [(t, got[t], _model_ms(t)) for t in toks if got[t] != _model_ms(t)]
    assert not bad, bad[:5]


def test_iso_from_ms(spark):
    from obsspark.functions import iso_from_ms
    df = spark.createDataFrame([(1704067200123,), (0,)], "ms long")
    assert [r.iso for r in df.select(iso_from_ms(F.col("ms")).alias("iso")).collect()] == [
        "2024-01-01T00:00:00.123Z", "1970-01-01T00:00:00.000Z"]
