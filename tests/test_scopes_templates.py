"""The gram index against matching every pattern with every name; message templates against a plain tree."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from obsspark.operators import access as A
from obsspark.operators.templates import line_templates


def _glob(pattern):
    return re.compile("".join(".*" if c == "*" else re.escape(c) for c in pattern), re.S)


@pytest.mark.parametrize("share", [A.SHARE, 7])
def test_patterns_match_as_globs(spark, share):
    r = random.Random(5)
    names = {"".join(r.choice("ab-x%_!\\é") for _ in range(r.randrange(7))) for _ in range(400)} | {"svc-" + str(i) for i in range(300)}
    patterns = {"", "a", "*a", "a*", "*a*", "svc-*", "svc-1*9", "**ab**", "no-such-*", "*é*", "svc-299", "*%*", "a_*", "*\\*", "-*-"}
    patterns |= {"".join(r.choice("ab-x*") for _ in range(r.randrange(1, 6))) for _ in range(60)}
    patterns = {p for p in patterns if not re.fullmatch(r"\*+", p)}
    got = A.pattern_matches(spark.createDataFrame([(p,) for p in patterns], "pattern string"),
                            spark.createDataFrame([(n,) for n in names], "_name string"), share=share)
    want = {(p, n) for p in patterns for n in names if _glob(p).fullmatch(n)}
    rows = [tuple(x) for x in got.select("pattern", "_name").collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_a_gram_that_all_names_have_is_split(spark):
    """Thousands of patterns that open alike: their keys are the rarest grams, and no key holds more names than a share."""
    names = spark.range(20_000).select(F.format_string("svc-%05d", "id").alias("_name"))
    patterns = spark.range(2000).select(F.format_string("svc-*%03d", "id").alias("pattern")).union(spark.createDataFrame([("svc-*",), ("*svc*",)], "pattern string"))
    wanted = A.pattern_grams(patterns)
    postings = A.name_grams(names, wanted)
    chosen = A.rarest_grams(wanted, postings, 500).collect()
    counts = {r.gram: r["count"] for r in postings.groupBy("gram").count().collect()}
    assert all(r.parts == -(-counts[r.gram] // 500) for r in chosen)
    assert max(counts[r.gram] for r in chosen if r.pattern not in ("svc-*", "*svc*")) <= 2000
    assert {r.pattern: r.parts for r in chosen}["svc-*"] == 40
    got = A.pattern_matches(patterns, names, 500).groupBy("pattern").count().collect()
    by = {r.pattern: r["count"] for r in got}
    assert by["svc-*"] == by["*svc*"] == 20_000 and by["svc-*007"] == 20 and by["svc-*1999"] == 2


@pytest.mark.parametrize("share", [A.SHARE, 7])
def test_patterns_too_large_to_send_match_the_same(spark, share):
    r = random.Random(7)
    names = ["".join(r.choice("ab-x") for _ in range(r.randrange(9))) for _ in range(400)] + ["", "\x02", "a\x03a", "abcabcabcabcabc"]
    patterns = {"".join(r.choice("ab-x*") for _ in range(r.randrange(8))) for _ in range(150)} | {"", "*abcabcabcabca*", "*a*a*a*", "a\x03*"}
    patterns = {p for p in patterns if not re.fullmatch(r"\*+", p)}
    want = sorted((p, n) for p in patterns for n in set(names) if _glob(p).fullmatch(n))
    p, n = spark.createDataFrame([(p,) for p in patterns], "pattern string"), spark.createDataFrame([(n,) for n in set(names)] + [(None,)], "_name string")
    for size in (0, A.BROADCAST_BYTES):
        assert sorted(tuple(x) for x in A.pattern_matches(p, n, share, size).collect()) == want


def test_patterns_that_share_short_groups_meet_only_their_names(spark):
    """Names tried do not grow as patterns times names where the patterns' ends, beginnings or long middles tell them apart."""
    names = spark.range(20_000).select(F.format_string("svc-%05d-%05d", "id", (F.col("id") * 7919) % 20_000).alias("_name"))
    ids = spark.range(0, 20_000, 20)
    patterns = (ids.select(F.format_string("svc-*-%05d", (F.col("id") * 7919) % 20_000).alias("pattern"))
                .union(ids.select(F.format_string("svc-%05d-*", "id"))).union(ids.select(F.format_string("*-%05d-*", "id"))))
    wanted = A.pattern_grams(patterns)
    postings = A.name_grams(names, wanted)
    counts = postings.groupBy("gram").count()
    tried = A.rarest_grams(wanted, postings).join(counts, "gram").agg(F.count(F.lit(1)), F.sum("count")).first()
    assert tuple(tried) == (3000, 3000)
    assert A.pattern_matches(patterns, names).count() == 3000


def _plain_templates(lines, depth, fan_out):
    stats = {}
    for line, t in lines:
        tokens = tuple("<*>" if re.search("[0-9]", x) else x for x in (line or "").split())
        if tokens:
            n, lo, hi = stats.get(tokens, (0, None, None))
            times = [x for x in (t, lo, hi) if x is not None]
            stats[tokens] = (n + 1, min(times, default=None), max(times, default=None))
    node = {k: (len(k),) for k in stats}
    for level in range(depth):
        children = defaultdict(set)
        for k, v in node.items():
            children[v].add(k[level] if level < len(k) else "")
        node = {k: (*v, "<*>" if len(children[v]) > fan_out else k[level] if level < len(k) else "") for k, v in node.items()}
    leaves = defaultdict(list)
    for k, v in node.items():
        leaves[v].append(k)
    out = []
    for v, members in leaves.items():
        rest = [x[0] if len(set(x)) == 1 else "<*>" for x in zip(*[m[depth:] for m in members], strict=True)]
        n = [stats[m] for m in members]
        out.append((" ".join([x for x in v[1:] if x] + rest), sum(x[0] for x in n), len(members),
                    min((x[1] for x in n if x[1] is not None), default=None), max((x[2] for x in n if x[2] is not None), default=None)))
    return Counter(out)


@pytest.mark.parametrize("depth, fan_out", [(3, 4), (0, 1), (2, 1), (6, 3)])
def test_templates_against_a_plain_tree(spark, depth, fan_out):
    r = random.Random(2)
    kinds = ["open {p} failed", "user {w} id={n} left", "error {n}", "disk {p} {w} at {n} %", "{w} {w} done", "a b", "retry   {w}\tof job {i}"]
    words = "alpha beta gamma delta eps zeta eta theta".split()
    lines = []
    for _ in range(600):
        text = r.choice(kinds).format(p="/srv/" + r.choice(words), w=r.choice(words), n=r.randrange(1000), i="j" + str(r.randrange(50)))
        lines.append((text, r.choice([None, r.randrange(10_000)])))
    lines += [(None, 1), ("", 2), ("  ", 3)]
    df = spark.createDataFrame([(*x, 7) for x in lines], "line string, rank_ms long, n long").repartition(4)
    got = Counter(tuple(x) for x in line_templates(df, depth=depth, fan_out=fan_out).select("template", "n", "n_distinct", "first_ms", "last_ms").collect())
    assert got == _plain_templates(lines, depth, fan_out)
    assert sum(k[1] * v for k, v in got.items()) == 600


def test_no_lines_have_no_templates(spark):
    assert line_templates(spark.createDataFrame([], "line string, rank_ms long")).count() == 0
