"""Line dedup by a tree of log templates of fixed depth, built by Spark aggregation.

A line's tokens are its words; a token with a digit is a field `<*>`. The tree has fixed
depth: first the number of tokens, then the first three tokens; a path to its end is a leaf.
Inside a leaf a token is constant if at least ``min_docs`` lines of documents have it at
that place, else it is generalised to `<*>`. A line's template is its leaf with its
constant tokens; it needs a share of ``min_constant`` constant tokens. Templates met in at
least ``min_docs`` distinct documents are recurring, and their lines are dropped.

Two kinds of documents are left whole. Those without a word of their own, all of whose lines recur; and copies
that differ a little, whose lines recur only because the copies hold them: where recurring lines take more than
``max_share`` of the words, the document is compared with all others of that kind (operator 6, ``near_percent``), and
left whole if it has a near-duplicate. Such documents are for the duplicate operators, which see them unharmed. Any
other document loses its recurring lines, whatever their share.

Only lines in leaves that enough lines reach are looked at further; a Bloom filter of
bounded size finds them, exact counts follow. Hot leaves, lines and templates are
counted by partial aggregation; joins on them are (many, one) joins that Spark can split.

Defined results: null text stays null and has no lines; empty lines and lines of fewer than
``min_tokens`` tokens are never dropped; rows equal in id and text count as one document and
get equal results; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.llm.bloom import cells_for, filter_of, probe
from sensorlake.llm.common import apart, hidden, same, written
from sensorlake.llm.near_dedup import near_copies

MIN_DOCS = 10
MIN_CONSTANT = 0.7
MAX_SHARE = 0.5
NEAR_PERCENT = 80
MIN_TOKENS = 3
DEPTH = 3
FIELD = "<*>"
_BLANKS = r"[ \t\x0B\f\r]+"


def _tokens(line: Column) -> Column:
    """Words of a line; words with a digit are fields."""
    return F.transform(F.filter(F.split(line, _BLANKS), lambda t: t != ""),
                       lambda t: F.when(t.rlike("[0-9]"), F.lit(FIELD)).otherwise(t))


def _masked(text: Column) -> Column:
    """Every line of a text with its fields masked, words one blank apart. Only lines with a digit or other blanks are
    taken apart."""
    return F.transform(F.split(text, "\n"), lambda line: F.when(
        line.rlike(r"[0-9\t\x0B\f\r]") | line.contains("  "), F.array_join(_tokens(line), " ")).otherwise(F.trim(line)))


def _n_words(masked: Column) -> Column:
    """Words of a masked line, by its blanks (one for an empty line)."""
    return F.length(masked) - F.length(F.replace(masked, F.lit(" "), F.lit(""))) + 1


def _leaf(masked: str) -> Column:
    return F.xxhash64(_n_words(F.col(masked)), F.substring_index(masked, " ", DEPTH))


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
                    min_constant: float = MIN_CONSTANT) -> DataFrame:
    """Lines whose template recurs: (d, th, recurring), one row per document that has any; ``th`` is the
    text's hash, ``recurring`` the hashes of its masked lines."""
    own = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("d"), F.col(text_col).alias("t"))
    lines = (own.select("d", F.xxhash64("t").alias("th"), F.explode(F.array_distinct(_masked(F.col("t")))).alias("m"))
             .where(_n_words(F.col("m")) >= MIN_TOKENS).withColumn("leaf", _leaf("m")))
    leaves = written(lines.groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf"), "leaves")
    cells = cells_for(leaves.count())
    words = written(filter_of(leaves, "leaf", cells), "leaf-filter")
    near = written(probe(lines, "leaf", words, cells, "may").where("may").select(
        "d", "th", "leaf", F.xxhash64("m").alias("mh"), "m"), "lines")

    distinct = near.groupBy("leaf", "mh").agg(F.first("m").alias("m"), F.count_distinct(F.struct("d", "th")).alias("n"))
    distinct = written(distinct, "distinct-lines")
    tokens = distinct.select("leaf", "mh", "n", F.posexplode(F.split("m", " ")).alias("pos", "token"))
    constant = (tokens.groupBy(F.col("leaf").alias("l"), F.col("pos").alias("p"), F.col("token").alias("c"))
                .agg(F.sum("n").alias("met")).where(F.col("met") >= min_docs).drop("met"))
    template = (tokens.join(apart(constant), (F.col("leaf") == F.col("l")) & (F.col("pos") == F.col("p"))
                            & (F.col("token") == F.col("c")), "left")
                .groupBy("leaf", "mh")
                .agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("c", F.lit(FIELD)).alias("c")))).alias("w"),
                     F.avg(F.when(F.coalesce("c", F.lit(FIELD)) != FIELD, 1.0).otherwise(0.0)).alias("share"))
                .where(F.col("share") >= min_constant)
                .select(F.col("mh").alias("line"), F.col("leaf").alias("of_leaf"),
                        F.sha2(F.concat_ws(" ", "w.c"), 256).alias("template")))
    template = written(template, "templates")
    held = near.select("d", "th", "mh", "leaf").join(
        template, (F.col("mh") == F.col("line")) & (F.col("leaf") == F.col("of_leaf"))).select("d", "th", "mh", "template")
    often = (held.select("d", "th", "template").distinct().groupBy(F.col("template").alias("often")).count()
             .where(F.col("count") >= min_docs).select("often"))
    return held.join(apart(often), F.col("template") == F.col("often")).groupBy("d", "th").agg(
        F.collect_set("mh").alias("recurring"))


def flag_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_share: float = MAX_SHARE,
               near_percent: int = NEAR_PERCENT, out: str = "lines", **how) -> DataFrame:
    """``docs`` with a struct column: n_lines, n_recurring (lines of recurring templates), n_dropped and clean (the
    text without dropped lines; null where none is dropped)."""
    flags = written(recurring_lines(docs, id_col, text_col, **how), "recurring")
    key, th, may = (hidden(docs, x) for x in ("line_key", "line_text", "line_may"))
    cells = cells_for(flags.count())
    words = written(filter_of(flags.select(F.xxhash64("d", "th").alias("h")), "h", cells), "document-filter")
    df = docs.withColumn(key, F.col(id_col)).withColumn(th, F.xxhash64(text_col))
    probed = hidden(df, "line_probe")
    df = probe(df.withColumn(probed, F.xxhash64(key, th)), probed, words, cells, may).drop(probed)
    # only documents that may hold a recurring line are shuffled
    fd, ft, fr = (hidden(df, x) for x in ("flag_d", "flag_th", "flag_r"))
    named = flags.select(F.col("d").alias(fd), F.col("th").alias(ft), F.col("recurring").alias(fr))
    hit = df.where(may).join(named, same(key, fd) & (F.col(th) == F.col(ft)), "left")
    hit = hit.withColumn(fr, F.coalesce(fr, F.array().cast("array<long>")))

    text = F.col(text_col)
    lines, masked = hidden(hit, "own_lines"), hidden(hit, "own_masked")
    hit = hit.withColumn(lines, F.split(text, "\n")).withColumn(masked, _masked(text))
    pairs = F.arrays_zip(F.col(lines).alias("line"), F.col(masked).alias("m"))
    kept = F.filter(pairs, lambda x: ~F.array_contains(fr, F.xxhash64(x["m"])))
    left = hidden(hit, "own_left")
    hit = hit.withColumn(left, kept)
    gone = F.size(lines) - F.size(left)
    n_words, n_left = _words(F.col(masked)), _words(F.col(f"{left}.m"))
    share = hidden(hit, "own_share")
    hit = hit.select(*docs.columns, key, F.struct(
        F.size(lines).cast("long").alias("n_lines"), gone.cast("long").alias("n_recurring"),
        F.when((gone > 0) & (n_left > 0), gone).otherwise(0).cast("long").alias("n_dropped"),
        F.when((gone > 0) & (n_left > 0), F.array_join(f"{left}.line", "\n")).alias("clean")).alias(out),
        ((gone > 0) & (n_words - n_left > max_share * n_words)).alias(share))
    hit = _copies_whole(written(hit, "flagged"), key, text_col, share, out, near_percent)
    clear = df.where(~F.col(may)).withColumn(out, F.struct(
        F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.lit(0).cast("long").alias("n_recurring"), F.lit(0).cast("long").alias("n_dropped"),
        F.lit(None).cast("string").alias("clean")))
    cols = [*docs.columns, out]
    return clear.select(cols).unionByName(hit.select(cols))


def _copies_whole(hit: DataFrame, key: str, text_col: str, over: str, out: str, percent: int) -> DataFrame:
    """Rows of which recurring lines are the larger part (``over``) keep them if they have a near-duplicate among those."""
    large = hit.where(over)
    if large.isEmpty():
        return hit
    cd, ct, cw = (hidden(hit, x) for x in ("copy_d", "copy_th", "copy_whole"))
    copies = near_copies(large, key, text_col, percent).select(
        F.col("d").alias(cd), F.col("th").alias(ct), F.lit(True).alias(cw))
    large = large.join(copies, same(key, cd) & (F.unhex(F.md5(text_col)) == F.col(ct)), "left")
    whole = F.struct(F.col(f"{out}.n_lines").alias("n_lines"), F.col(f"{out}.n_recurring").alias("n_recurring"),
                     F.lit(0).cast("long").alias("n_dropped"), F.lit(None).cast("string").alias("clean"))
    large = large.withColumn(out, F.when(F.col(cw), whole).otherwise(F.col(out)))
    return hit.where(~F.col(over)).unionByName(large.select(*hit.columns))


def _words(masked: Column) -> Column:
    return F.aggregate(masked, F.lit(0).cast("long"), lambda n, m: n + F.when(m == "", 0).otherwise(_n_words(m)))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the lines of recurring templates; columns as they were, ``n_chars`` follows the text."""
    name = hidden(docs, "lines")
    df = flag_lines(docs, id_col, text_col, out=name, **how)
    changed = {text_col: F.coalesce(f"{name}.clean", F.col(text_col))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(f"{name}.clean").isNotNull(), F.length(f"{name}.clean").cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return df.withColumns(changed).select(*docs.columns)
