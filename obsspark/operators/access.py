"""Row-level access control (C1-C5) with '*' globs.

Scope checks are joins by an index of grams, a name's beginnings, ends and
groups of letters.  Admins and principals with a bare ``*`` are a flag outside
the join.  Of the other patterns each distinct one is joined once, by that gram
of its fixed parts which the fewest names have: the whole text before the first
star or behind the last, so that patterns that share their short groups of
letters do not meet each other's names.  The full glob is the residual
predicate, and principals are attached to the matching (pattern, name) pairs last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsspark.functions.text import glob_like, ws_trim
from obsspark.operators.checks import assert_empty
from obsspark.session import keep

# Capability needed by each bundle record type.
RECORD_CAPABILITY = [("log", "logs"), ("log_error", "logs"), ("log_summary", "logs"),
                     ("event", "events"), ("metrics_text", "metrics")]


def _clean(arr: Column) -> Column:
    return F.filter(F.transform(F.coalesce(arr, F.array().cast("array<string>")), lambda x: ws_trim(x)),
                    lambda x: x.isNotNull() & (x != ""))


def normalize_principals(claims: DataFrame) -> DataFrame:
    """Claims (sub, admin, allowed_namespaces, allowed_services,
    capabilities) -> principals.  No scope claim at all means admin;
    otherwise admin only when exactly true; arrays keep trimmed
    non-empty strings."""
    has_claims = (F.col("admin").isNotNull() | F.col("allowed_namespaces").isNotNull()
                  | F.col("allowed_services").isNotNull() | F.col("capabilities").isNotNull())
    empty = F.array().cast("array<string>")
    return claims.select(
        "sub",
        F.when(has_claims, F.coalesce(F.col("admin") == F.lit(True), F.lit(False))).otherwise(F.lit(True))
        .alias("admin"),
        F.when(has_claims, _clean(F.col("allowed_namespaces"))).otherwise(empty).alias("allowed_namespaces"),
        F.when(has_claims, _clean(F.col("allowed_services"))).otherwise(empty).alias("allowed_services"),
        F.when(has_claims, _clean(F.col("capabilities"))).otherwise(empty).alias("capabilities"),
    )


def fold_patterns(rows: DataFrame, pattern_col: str, out_col: str) -> DataFrame:
    """One row per (sub, pattern) -> one row per principal with an array."""
    return rows.groupBy("sub").agg(
        F.first("admin").alias("admin"),
        F.sort_array(F.collect_set(F.col(pattern_col))).alias(out_col))


#: letters of a gram at a name's beginning or end at most, and sizes of those within; names with one gram that are joined under one key
EDGE, WITHIN, SHARE = 64, (1, 2, 3, 6, 12), 10_000
#: bytes of patterns and their grams that are sent to all executors; more are shuffled with the names
BROADCAST_BYTES = 48 << 20
# Kinds of grams, their first letter: a whole name, its beginning, its end, or anywhere in it.
_WHOLE, _HEAD, _TAIL, _INSIDE = "=", "<", ">", "~"
#: parts that a table is dealt into where a principal may see all of it
EVERYONE_PARTS = 32


def universal(patterns_col: str) -> Column:
    """Whether a principal holds a pattern that matches every name (not admin, which is a flag by itself)."""
    return F.coalesce(F.exists(F.col(patterns_col), lambda p: p.rlike(r"^\*+$")), F.lit(False))


def _is_admin() -> Column:
    return F.coalesce(F.col("admin"), F.lit(False))


def _tagged(kind: str, text: Column) -> Column:
    return F.concat(F.lit(kind), text)


def _within(part: Column) -> Column:
    """Grams of a part that may be anywhere, of the largest size it has."""
    size = F.lit(WITHIN[0])
    for k in WITHIN[1:]:
        size = F.when(F.length(part) >= k, k).otherwise(size)
    return F.transform(F.sequence(F.lit(1), F.length(part) - size + 1), lambda i: _tagged(_INSIDE, F.substring(part, i, size)))


def pattern_grams(patterns: DataFrame) -> DataFrame:
    """(pattern, gram): what a matching name must hold.

    Its beginning and its end up to EDGE letters, groups of letters of the parts between stars,
    and the whole name where the pattern has no star."""
    parts = F.split(F.col("pattern"), r"\*+")
    cut = patterns.select("pattern", parts.alias("parts"))
    first, last, n = F.col("parts")[0], F.element_at("parts", -1), F.size("parts")
    inner = F.filter(F.slice("parts", 2, F.greatest(n - 2, F.lit(0))), lambda x: x != "")
    edges = F.array(F.when(n == 1, _tagged(_WHOLE, F.col("pattern"))),
                    F.when((n > 1) & (first != ""), _tagged(_HEAD, F.left(first, F.lit(EDGE)))),
                    F.when((n > 1) & (last != ""), _tagged(_TAIL, F.right(last, F.lit(EDGE)))))
    grams = F.concat(edges, F.flatten(F.transform(inner, _within)))
    return cut.select("pattern", F.explode(F.array_distinct(grams)).alias("gram")).filter("gram is not null")


def _keys(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_name, gram) of the names, each once, of the kinds and sizes that ``wanted`` has."""
    # one row per kind and size, of which there are few
    shapes = sorted(tuple(r) for r in wanted.select(F.left("gram", F.lit(1)), F.length("gram") - 1).distinct().collect())
    name, at, length = F.col("_name"), F.col("_at"), F.length("_name")
    make = {_WHOLE: lambda k: name, _HEAD: lambda k: F.left(name, F.lit(k)), _TAIL: lambda k: F.right(name, F.lit(k))}
    none = F.lit(None).cast("string")
    whole = F.lit(_WHOLE in {kind for kind, _ in shapes})
    edges = [F.when(length >= k, _tagged(kind, make[kind](k))) for kind, k in shapes if kind in (_HEAD, _TAIL)]
    inner = [F.when(at + k - 1 <= length, F.substring(name, at, F.lit(k))) for kind, k in shapes if kind == _INSIDE]
    # of equal groups of letters the first counts
    inner = [F.when(F.position(x, name) == at, _tagged(_INSIDE, x)) for x in inner]
    placed = names.select("_name", F.explode(F.sequence(F.lit(0), length if inner else F.lit(0))).alias("_at"))
    grams = F.when(at == 0, F.array(F.when(whole, _tagged(_WHOLE, name)), *edges)).otherwise(F.array(none, *inner))
    return placed.select("_name", F.explode(grams).alias("gram")).filter("gram is not null")


def name_grams(names: DataFrame, wanted: DataFrame, small: bool = False) -> DataFrame:
    """(_name, gram) of the names, for the grams that ``pattern_grams`` has; ``small``: they fit each executor."""
    asked = wanted.select("gram").distinct()
    return _keys(names, wanted).join(F.broadcast(asked) if small else asked, "gram", "left_semi")


def rarest_grams(wanted: DataFrame, postings: DataFrame, share: int = SHARE) -> DataFrame:
    """(pattern, gram, parts): each pattern's gram with the fewest names, and into how many parts its names are dealt.

    A pattern with a gram that no name has matches none and is left out."""
    counts = postings.groupBy(F.col("gram").alias("_gram")).agg(F.count(F.lit(1)).alias("_names"))
    met = wanted.join(counts, F.col("gram") == F.col("_gram"), "left")
    least = F.min(F.struct(F.coalesce("_names", F.lit(0)).alias("names"), F.col("gram"))).alias("least")
    return (met.groupBy("pattern").agg(least).filter("least.names > 0")
            .select("pattern", "least.gram", F.ceil(F.col("least.names") / share).cast("int").alias("parts")))


def pattern_matches(patterns: DataFrame, names: DataFrame, share: int = SHARE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(pattern, _name) that match, by an index of grams.

    A pattern meets the names with its rarest gram.  Patterns of up to
    ``broadcast_bytes`` are sent to the names.  Of more, a gram with more than
    ``share`` names is split: its names are dealt into parts, its patterns are
    repeated for each, so that no key holds more than a share of names.
    """
    wanted = keep(pattern_grams(patterns))
    size = wanted.agg(F.sum(F.octet_length("pattern") + F.octet_length("gram") + 64)).first()[0] or 0
    small = size <= broadcast_bytes
    chosen = keep(rarest_grams(wanted, name_grams(names, wanted, small), share))
    matches = glob_like(F.col("_name"), F.col("pattern"))
    if small:
        return _keys(names, chosen).join(F.broadcast(chosen.select("pattern", "gram")), "gram").filter(matches).select("pattern", "_name")
    split = chosen.groupBy("gram").agg(F.max("parts").alias("_parts"))
    part = F.pmod(F.xxhash64("_name"), F.col("_parts")).cast("int")
    dealt = _keys(names, chosen).join(split, "gram").select("_name", "gram", part.alias("_part"))
    asked = chosen.select("pattern", "gram", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_part"))
    return dealt.join(asked, ["gram", "_part"]).filter(matches).select("pattern", "_name")


def scoped_pairs(principals: DataFrame, patterns_col: str, names: DataFrame, name_col: str) -> DataFrame:
    """J8 without admins and bare ``*``: distinct (sub, name) where some pattern of ``sub`` matches."""
    held = (principals.filter(~_is_admin() & ~universal(patterns_col))
            .select("sub", F.explode(patterns_col).alias("pattern")).distinct())
    n = names.select(F.col(name_col).alias("_name")).filter(F.col("_name").isNotNull()).distinct()
    met = pattern_matches(held.select("pattern").distinct(), n)
    return held.join(met, "pattern").select("sub", F.col("_name").alias(name_col)).distinct()


def everyone_pairs(principals: DataFrame, patterns_col: str, names: DataFrame, name_col: str) -> DataFrame:
    """(sub, name) of the principals that may see every name: the listing itself is that large.

    Names are dealt into EVERYONE_PARTS parts and those principals are repeated
    for each, so no key holds the whole table of names.
    """
    every = (principals.filter(_is_admin() | universal(patterns_col))
             .select("sub", F.explode(F.sequence(F.lit(0), F.lit(EVERYONE_PARTS - 1))).alias("_part")))
    n = names.select(name_col).filter(F.col(name_col).isNotNull()).distinct()
    n = n.withColumn("_part", F.pmod(F.xxhash64(name_col), F.lit(EVERYONE_PARTS)).cast("int"))
    return n.join(every, "_part").select("sub", name_col)


def allowed_pairs(principals: DataFrame, patterns_col: str, names: DataFrame, name_col: str) -> DataFrame:
    """Distinct (sub, name) where some pattern of ``sub`` matches, admins matching every name."""
    return scoped_pairs(principals, patterns_col, names, name_col).unionByName(
        everyone_pairs(principals, patterns_col, names, name_col))


def visible_services(principals: DataFrame, services: DataFrame) -> DataFrame:
    """C2 + C5: the registry rows each principal may see; admins get the
    full definition, others the name only."""
    pairs = allowed_pairs(principals, "allowed_services", services, "name")
    adm = principals.select("sub", "admin")
    j = pairs.join(adm, "sub").join(services, "name")
    return j.select("sub", "name", "service_idx",
                    F.when(F.col("admin"), F.col("journal")).alias("journal"),
                    F.when(F.col("admin"), F.col("journal_scope")).alias("journal_scope"),
                    F.when(F.col("admin"), F.col("metrics")).alias("metrics"))


def authorize_targets(principals: DataFrame, patterns_col: str, targets: DataFrame, name_col: str) -> DataFrame:
    """All-or-nothing decision per principal over a target list.

    Returns (sub, n_targets, n_allowed, authorized).  A namespace target
    ``*`` must itself be matched ('prod-*' does not cover it).  Admins and
    bare ``*`` need no pairs: the target count, a scalar sub-query, is theirs.
    """
    t = targets.select(F.col(name_col).alias("_t")).filter(F.col("_t").isNotNull()).distinct()
    n_targets = t.agg(F.count(F.lit(1))).scalar()
    got = scoped_pairs(principals, patterns_col, t, "_t").groupBy("sub").agg(
        F.count(F.lit(1)).alias("n_allowed"))
    everyone = (_is_admin() | universal(patterns_col)).alias("_every")
    return (principals.select("sub", everyone).join(got, "sub", "left")
            .select("sub", n_targets.alias("n_targets"),
                    F.when(F.col("_every"), n_targets).otherwise(F.coalesce(F.col("n_allowed"), F.lit(0))).alias("n_allowed"))
            .withColumn("authorized", F.col("n_allowed") == F.col("n_targets")))


def assert_authorized(principal_sub: str, decisions: DataFrame) -> None:
    """Raises ``forbidden`` when the principal is not authorized."""
    assert_empty(decisions.filter((F.col("sub") == principal_sub) & ~F.col("authorized")), "forbidden")


def capability_check(principals: DataFrame, capabilities: DataFrame, needed: list[str]) -> DataFrame:
    """C4: (sub, capable) — admin, or every needed capability granted."""
    need = F.array(*[F.lit(c) for c in needed])
    granted = capabilities.groupBy("sub").agg(F.collect_set("capability").alias("_caps"))
    j = principals.select("sub", "admin").join(granted, "sub", "left")
    ok = F.col("admin") | F.coalesce(F.size(F.array_except(need, F.coalesce(F.col("_caps"),
                                                                            F.array().cast("array<string>")))) == 0,
                                     F.lit(False))
    return j.select("sub", ok.alias("capable"))


def record_visibility(principals: DataFrame, capabilities: DataFrame, records: DataFrame,
                      scope_col: str = "namespace", patterns_col: str = "allowed_namespaces") -> DataFrame:
    """C4 on a bundle table: per (sub, type) the number of records the
    principal may read — admin, or the record family's capability plus
    an allowed scope.  Records are pre-aggregated per (type, scope)
    before any join, so the work after the scan is proportional to the
    number of distinct scopes, not records."""
    spark = records.sparkSession
    # a fixed five-row constant: a proven size bound, so broadcast it
    cap_map = F.broadcast(spark.createDataFrame(RECORD_CAPABILITY, "type string, capability string"))
    per_scope = records.groupBy("type", scope_col).agg(F.count(F.lit(1)).alias("_n")).join(cap_map, "type")
    granted = capabilities.select("sub", "capability").distinct()
    scoped = (scoped_pairs(principals, patterns_col, per_scope.select(scope_col), scope_col)
              .join(per_scope, scope_col).join(granted, ["sub", "capability"]).select("sub", "type", "_n"))
    # admins and bare '*': one total per record type, whatever the scopes
    totals = per_scope.groupBy("type").agg(F.sum("_n").alias("_all"), F.sum(F.when(F.col(scope_col).isNotNull(), F.col("_n"))).alias("_named"))
    types = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(c).alias("capability")) for t, c in RECORD_CAPABILITY])
    every = (principals.filter(_is_admin() | universal(patterns_col))
             .select("sub", _is_admin().alias("admin"), F.explode(types).alias("x")).select("sub", "admin", "x.type", "x.capability"))
    every = every.join(granted.withColumn("_g", F.lit(True)), ["sub", "capability"], "left").filter(F.col("admin") | F.col("_g"))
    every = every.join(totals, "type").select("sub", "type", F.when(F.col("admin"), F.col("_all")).otherwise(F.col("_named")).alias("_n"))
    return (scoped.unionByName(every.filter(F.col("_n").isNotNull())).groupBy("sub", "type")
            .agg(F.sum("_n").alias("n_records")))
