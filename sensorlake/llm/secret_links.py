"""Secrets: base patterns, and weak candidates reported only where complementary parts co-occur.

DataFrame functions only. Spans come from regular expressions anchored at the end of the previous match
(``\\G``): each match is taken with the gap before it, so running lengths give its place,
in code points. A text without a match is passed over by one test.

Weak candidates are no finding by themselves: temporary key identifiers, bare
high-entropy strings and endpoints. An interval join links them to their complements
within a scope, ``REACH`` code points around them in the same text: a bare secret needs an
identifier, an identifier needs a secret, an endpoint needs both. The join is on
(text, stretch of ``REACH``): of every stretch only the first and last place of each
part are kept, which decides the join exactly, so no pairs are made within a group.

The work in a text grows with its length and little faster than its matches, so very long texts need no rule of their own.

Defined results: null and empty texts have no spans; rows equal in id and text get equal results;
other columns are not read; a span is the whole match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorlake.llm.common import apart, same, written

REACH = 200
#: Matches of a text gone over with one running array.
STRETCH = 32

# fixed values: the base patterns (groups: 1 keyword, 2 value) and their least lengths
_KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = ("(" + "|".join(map(_either_case, _KEYWORDS)) + r''')["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)''')
ACCESS = r"AKIA[A-Z0-9]{12,}"          # the same spans as AKIA[A-Z0-9]+ of 16 and more: runs are maximal
HEX = r"[0-9a-f]{32,}"
KEY_ID = r"(?:ASIA|AROA|AIDA)[A-Z0-9]{12,}"
BARE = r"[A-Za-z0-9+/]{24,}"
ENDPOINT = r"https?://[A-Za-z0-9._:/-]+"
#: Kinds in the order of listing: (kind, pattern, part it plays).
BASE = [("assign", ASSIGN, "secret"), ("access", ACCESS, "id"), ("hex", HEX, "secret")]
WEAK = [("key_id", KEY_ID, "id"), ("bare", BARE, "secret"), ("endpoint", ENDPOINT, "endpoint")]
PARTS = {kind: part for kind, _, part in [*BASE, *WEAK]}
#: Parts that each kind of weak candidate needs nearby.
NEEDS = {"key_id": ["secret"], "bare": ["id"], "endpoint": ["id", "secret"]}
_RANK = {kind: k for k, (kind, _, _) in enumerate([*BASE, *WEAK])}

_SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string>"


def _spans(text: Column, kind: str, pattern: str, keep=None) -> Column:
    """All spans of a pattern: array of (start, rank, end, kind).

    Matches are gone over in stretches of ``STRETCH``, whose places come from a running sum of plain numbers: the state of
    an aggregation is copied at every step, so one running array of spans would cost the square of a text's matches."""
    anchored = F.lit(r"(?s)\G(.*?)(" + pattern + ")")
    parts = [F.regexp_extract_all(text, anchored, F.lit(g)) for g in (1, 2)]
    none = F.array().cast(f"array<{_SPAN}>")
    zero = F.lit(0).cast("bigint")

    def length(row: Column) -> Column:
        return (F.length(row["gap"]) + F.length(row["match"])).cast("bigint")

    def add(state: Column, row: Column) -> Column:
        a = state["at"] + F.length(row["gap"])
        b = state["at"] + length(row)
        span = F.struct(a.cast("bigint").alias("start"), F.lit(_RANK[kind]).alias("rank"),
                        b.cast("bigint").alias("end"), F.lit(kind).alias("kind"))
        more = F.array(span).cast(f"array<{_SPAN}>")
        if keep is not None:
            more = F.when(keep(row["match"]), more).otherwise(none)
        return F.struct(b.cast("bigint").alias("at"), F.concat(state["spans"], more).alias("spans"))

    def once(value: Column, body) -> Column:
        """``body(value)``, with the value computed once."""
        return F.element_at(F.transform(F.array(value), body), 1)

    def whole(rows: Column) -> Column:
        stretches = F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / STRETCH).cast("int"))

        def places(k: Column) -> Column:
            return F.sequence(k * STRETCH, F.least(F.size(rows), (k + 1) * STRETCH) - 1)

        sizes = F.transform(stretches, lambda k: F.aggregate(places(k), zero, lambda n, i: n + length(rows[i])))
        begins = F.aggregate(sizes, F.array(zero), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)))
        return once(begins, lambda at: F.flatten(F.transform(stretches, lambda k: F.aggregate(
            places(k), F.struct(at[k].alias("at"), none.alias("spans")), lambda s, i: add(s, rows[i]), lambda s: s["spans"]))))

    rows = F.arrays_zip(parts[0].alias("gap"), parts[1].alias("match"))
    return F.when(text.rlike(pattern), once(rows, whole)).otherwise(none)


def _long_value(match: Column) -> Column:
    """The value of an assignment has 8 characters or more."""
    return F.length(F.regexp_extract(match, "^" + ASSIGN, 2)) >= 8


def _mixed(match: Column) -> Column:
    return match.rlike("[A-Z]") & match.rlike("[a-z]") & match.rlike("[0-9]")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per document: doc_id, base and linked (arrays of start, rank, end, kind)."""
    text = F.coalesce(F.col("t"), F.lit(""))
    own = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).select("d", text.alias("t"))
    keep = {"assign": _long_value, "bare": _mixed}
    found = own.select("d", F.xxhash64("t").alias("th"), *[
        _spans(F.col("t"), kind, pattern, keep.get(kind)).alias(kind) for kind, pattern, _ in [*BASE, *WEAK]])
    found = written(found.select("d", "th", F.concat(*[F.col(k) for k, _, _ in BASE]).alias("base"),
                                 F.concat(*[F.col(k) for k, _, _ in WEAK]).alias("weak")), "spans")

    candidates = found.where(F.size("weak") > 0)
    # one row a span, once for each text; a bare string that overlaps a base span is none: the running ends of base spans
    # that begin up to it, and the next base span's start, tell
    spans = candidates.dropDuplicates(["d", "th"]).select("d", "th", F.explode(F.concat("base", "weak")).alias("s")).select(
        "d", "th", "s", F.col("s.start").alias("start"), F.when(F.col("s.kind").isin([k for k, _, _ in BASE]), F.col("s.end")).alias("base_end"))
    up, down = (Window.partitionBy("d", "th").orderBy(by).rangeBetween(Window.unboundedPreceding, 0)
                for by in (F.col("start"), F.col("start").desc()))
    reached = F.max("base_end").over(up)
    following = F.min(F.when(F.col("base_end").isNotNull(), F.col("start"))).over(down)
    spans = spans.withColumns({"reached": reached, "following": following})
    covered = (F.col("s.kind") == "bare") & (F.coalesce(F.col("reached") > F.col("start"), F.lit(False))
                                             | F.coalesce(F.col("following") < F.col("s.end"), F.lit(False)))
    spans = written(spans.where(~covered).select("d", "th", "s"), "candidates")
    part = F.create_map(*[F.lit(x) for kv in PARTS.items() for x in kv])
    ends = written(spans.groupBy("d", "th", F.floor(F.col("s.start") / reach).alias("stretch"), part[F.col("s.kind")].alias("part")).agg(
        F.min("s.start").alias("first"), F.max("s.start").alias("last")), "stretches")
    need = F.create_map(*[x for k, v in NEEDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    weak = spans.where(F.col("s.kind").isin(list(NEEDS))).withColumn("need", F.explode(need[F.col("s.kind")]))
    looked = weak.withColumn("stretch_of", F.explode(F.sequence(
        F.floor(F.col("s.start") / reach) - 1, F.floor(F.col("s.start") / reach) + 1)))
    ends = ends.select(F.col("d").alias("ed"), F.col("th").alias("eth"), "stretch", "part", "first", "last")
    at = F.col("s.start")
    met = (looked.join(ends, same("d", "ed") & (F.col("th") == F.col("eth")) & (F.col("stretch_of") == F.col("stretch"))
                       & (F.col("need") == F.col("part"))
                       # within the candidate's own stretch every place is near enough
                       & ((F.floor(at / reach) == F.col("stretch"))
                          | ((F.col("stretch") * reach < at) & (F.col("last") >= at - reach))
                          | ((F.col("stretch") * reach > at) & (F.col("first") <= at + reach))))
           .groupBy("d", "th", "s").agg(F.count_distinct("need").alias("n")))
    linked = (met.where(F.col("n") == F.size(need[F.col("s.kind")])).groupBy(F.col("d").alias("ld"), F.col("th").alias("lth"))
              .agg(F.collect_list("s").alias("linked")))
    none = F.array().cast(f"array<{_SPAN}>")
    joined = candidates.join(apart(linked), same("d", "ld") & (F.col("th") == F.col("lth")), "left").select(
        F.col("d").alias("doc_id"), "base", F.coalesce("linked", none).alias("linked"))
    plain = found.where(F.size("weak") == 0).select(F.col("d").alias("doc_id"), "base", none.alias("linked"))
    return plain.unionByName(joined)


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of ``find_secrets``."""
    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    count = [number(kind) for kind, _, _ in BASE]
    return found.select("doc_id", *count, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
                        _listed(F.concat("base", "linked")).alias("spans"),
                        F.size("linked").cast("long").alias("n_linked"))
