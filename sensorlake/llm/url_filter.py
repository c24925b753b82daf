"""URL filter: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

Rules (a short configuration) decide first; the longest rule that fits wins. URLs without a rule are
blocked if their canonical form is on the list. The list's filter is blocked: a URL's hash
picks one block of four 64-bit words and sets one bit in each, so one probe reads one row.
Rows that the filter passes are joined with the list on the canonical form itself, which
removes false positives; all other rows pass without a shuffle.

Canonical form: scheme, fragment, `www.`, default ports and tracking parameters dropped, host
in lower case, other parameters sorted, one trailing slash of the path dropped.

Defined results: a null URL or one without `://` has empty host and path, fits no rule and is on no list:
allowed. Repeated rows get equal results; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.llm.common import hidden, written

#: Blocks of four words at most: about 10 MB as a broadcast table.
MAX_BLOCKS = 1 << 18
URLS_PER_BLOCK = 16
WORDS = 4
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """From the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The canonical form; null without `://`."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"/$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(F.instr(url, "://") > 0, F.concat(
        host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def _fits(host: Column, path: Column, rule: str) -> Column:
    own, tail = rule.split("/", 1)
    return ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{tail}")


def _block_bits(h: Column) -> list[Column]:
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
            for k in range(WORDS)]


def blocked_filter(keys: DataFrame, key: str, max_blocks: int = MAX_BLOCKS) -> tuple[DataFrame, int]:
    """(block, w0 .. w3) of the keys, and the number of blocks."""
    n, blocks = keys.count(), 64
    while blocks < min(max_blocks, n // URLS_PER_BLOCK):
        blocks *= 2
    rows = keys.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"),
                       *[b.alias(f"w{k}") for k, b in enumerate(_block_bits(F.xxhash64(F.lit("bits"), F.col(key))))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)]), blocks


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], listed: DataFrame, url_col: str = "url",
                listed_col: str = "url", max_blocks: int = MAX_BLOCKS, out: str = "url_filter") -> DataFrame:
    """``pages`` with a struct column: host, path, rule, verdict (allow or block) and listed.

    ``rules``: (host/path, verdict); the longest wins, of equally long ones that with the
    longer host, then block. ``listed``: a table of URLs, of any size.
    """
    names = {x: hidden(pages, f"url_{x}") for x in ("host", "path", "key", "may", "block", "listed", "on_list", "word")}
    own = written(listed.select(canonical(F.col(listed_col)).alias("key")).where("key IS NOT NULL").distinct(), "listed-urls")
    table, blocks = blocked_filter(own, "key", max_blocks)
    table = written(table, "url-blocks")
    url = F.col(url_col)
    df = pages.withColumns({names["host"]: host_of(url), names["path"]: path_of(url), names["key"]: canonical(url)})
    # at most ``max_blocks`` rows, so the broadcast has a fixed bound
    probe = F.broadcast(table.select(F.col("block").alias(names["block"]),
                                     *[F.col(f"w{k}").alias(f"{names['word']}{k}") for k in range(WORDS)]))
    bits = _block_bits(F.xxhash64(F.lit("bits"), F.col(names["key"])))
    met = F.lit(True)
    for k in range(WORDS):
        met = met & (F.col(f"{names['word']}{k}").bitwiseAND(bits[k]) != 0)
    cols = [*pages.columns, names["host"], names["path"], names["key"]]
    df = (df.join(probe, F.pmod(F.xxhash64(names["key"]), F.lit(blocks)) == F.col(names["block"]), "left")
          .withColumn(names["may"], F.coalesce(met & F.col(names["key"]).isNotNull(), F.lit(False))))
    # only possible hits are shuffled
    hit = df.where(names["may"]).select(cols).join(
        own.select(F.col("key").alias(names["on_list"])), F.col(names["key"]) == F.col(names["on_list"]), "left")
    both = hit.withColumn(names["listed"], F.col(names["on_list"]).isNotNull()).select(*cols, names["listed"]).unionByName(
        df.where(~F.col(names["may"])).select(cols).withColumn(names["listed"], F.lit(False)))

    rule, verdict = F, F
    for text, ruling in sorted(rules, key=lambda r: (-len(r[0]), -len(r[0].split("/")[0]), r[1] != "block")):
        fits = _fits(F.col(names["host"]), F.col(names["path"]), text)
        rule, verdict = rule.when(fits, text), verdict.when(fits, ruling)
    by_list = F.when(F.col(names["listed"]), "block").otherwise("allow")
    return both.withColumn(out, F.struct(
        F.col(names["host"]).alias("host"), F.col(names["path"]).alias("path"),
        (rule if rules else F.lit(None).cast("string")).alias("rule"),
        (verdict.otherwise(by_list) if rules else by_list).alias("verdict"),
        F.col(names["listed"]).alias("listed"))).select(*pages.columns, out)


def drop_blocked(pages: DataFrame, rules: Sequence[tuple[str, str]], listed: DataFrame, **how) -> DataFrame:
    """``pages`` whose URL is allowed, columns as they were."""
    name = hidden(pages, "url_filter")
    return filter_urls(pages, rules, listed, out=name, **how).where(F.col(f"{name}.verdict") == "allow").drop(name)
