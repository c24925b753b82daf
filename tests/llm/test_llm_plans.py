"""What the operators shuffle and join, read from their plans."""

from __future__ import annotations

import os
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from sensorlake.llm import components, near_dedup
from sensorlake.llm.common import CLEANUP, written
from sensorlake.llm.decontaminate import decontaminate
from sensorlake.llm.line_templates import _masked
from sensorlake.llm.packing import pack


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_last_links_join_bands_once(spark):
    """Members of a band meet its sizes in one join and their sets in another, not once for each kind of block."""
    body, bands, sketch = (np.arange(n, dtype=np.uint64).tobytes() for n in (8, 4, 32))
    left = spark.createDataFrame([(0, b"a", b"a"), (0, b"b", b"b")], "key long, sid binary, label binary")
    sets = spark.createDataFrame([(x, bands, sketch) for x in (b"a", b"b")], "sid binary, bands binary, sketch binary")
    bodies = spark.createDataFrame([(x, body) for x in (b"a", b"b")], "sid binary, body binary")
    links = near_dedup._last_links(left, sets, bodies, 80)
    assert len(re.findall(r"Join Inner, \(key#\d+L? = k#", _plan(links))) == 1
    assert [(bytes(r.a), bytes(r.b)) for r in links.collect()] == [(b"b", b"a")]


def test_masked_lines(spark):
    rng = random.Random(3)
    parts = [" ", " ", "  ", "\t", "\n", "\r", "\x0b", "\f", "a", "b", "1", "9z", "$", "\\", "<*>", "é", "😀", " ", "١", " \n "]
    texts = ["", *("".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(2000))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", _masked(F.col("t")).alias("m"))
    for t, m in df.collect():
        words = ([w for w in re.split(r"[ \t\x0B\f\r]+", line) if w] for line in t.split("\n"))
        assert m == [" ".join("<*>" if re.search("[0-9]", w) else w for w in line) for line in words], repr(t)


def test_drop_near_shuffles_marked_texts_only(spark):
    """Only rows that may be near copies go through the joins that carry texts."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 9) for _ in range(60)) for _ in range(40)]
    texts += [f"{t} more" for t in texts[:3]]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    out = near_dedup.drop_near(df)
    plan = _plan(out)
    assert "Union" in plan and plan.index("Union") < plan.index("LeftAnti")
    assert sorted(r.doc_id for r in out.collect()) == list(range(40))


def test_decontaminate_scans_texts_once(spark):
    """The filter on the scan's result stands above it: below it would scan again, in a second Python worker of each task."""
    text = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"before {text} after it come eight more words here"), (2, text), (3, "none"), (4, None)],
                                 "doc_id long, text string")
    items = spark.createDataFrame([("a", text)], "item_id string, text string")
    for chars in (1_000_000, 40):
        out = decontaminate(docs, items.unionByName(spark.createDataFrame([("b", "x " * 10)], items.schema)), item_chars=chars)
        assert len(re.findall(r"(?m)^[\s:+-]*(?:\*\(\d+\) )?ArrowEvalPython", out._jdf.queryExecution().sparkPlan().toString())) == 1
        assert sorted((r.doc_id, r.text) for r in out.collect()) == [
            (1, "before  after it come eight more words here"), (3, "none"), (4, None)]


def test_packing_starts_no_workers_for_small_tables(spark):
    """Strategies and counts are local relations; rows of Python objects would be read by Python workers of another kind."""
    docs = spark.createDataFrame([(k, "word " * (k * 37 % 1500)) for k in range(60)], "doc_id long, text string")
    plan = pack(docs)._jdf.queryExecution().sparkPlan().toString()
    assert "ExistingRDD" not in plan and plan.count("LocalTableScan") >= 2


def _tables(monkeypatch, docs, run) -> list[tuple[str, int]]:
    """The tables that near-duplicates write, with the exchanges of each one's plan."""
    seen = []

    def spied(df, name, write=components.written):
        seen.append((name, len(re.findall(r"Exchange ", df._jdf.queryExecution().executedPlan().toString()))))
        return write(df, name)

    monkeypatch.setattr(near_dedup, "written", spied)
    monkeypatch.setattr(components, "written", spied)
    run(docs)
    return seen


def test_near_copies_in_small_plans(spark, monkeypatch):
    """The driver keeps a plan's metrics for each of its exchanges: links are pairs of labels without joins back to the
    components, and a round's halves are two tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rng = random.Random(6)
        texts = []
        for _ in range(12):
            words = [f"{rng.choice('abcdefgh')}{rng.randrange(99)}" for _ in range(120)]
            texts.append(" ".join(words))
            for _ in range(4):                                  # each differs in one more word from the one before
                words[rng.randrange(120)] = "changed"
                texts.append(" ".join(words))
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        seen = _tables(monkeypatch, docs, lambda d: near_dedup.near_duplicates(d, percent=80).collect())
        assert "ends" not in {name for name, _ in seen}
        assert max(n for _, n in seen) <= 8, seen
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_joined_up_without_links(spark, monkeypatch):
    """No new link: the components stay as they are, and no round is run."""
    found = components.connected(spark.createDataFrame([(1, 2), (2, 3)], "a int, b int"))
    none = spark.createDataFrame([], "a int, b int")
    seen = _tables(monkeypatch, none, lambda d: components.joined_up(found, d, of_roots=True).collect())
    assert [name for name, _ in seen] == ["links"]
    links = spark.createDataFrame([(1, 9), (9, 7)], "a int, b int")
    got = components.joined_up(found, links, of_roots=True).collect()
    assert sorted(tuple(r) for r in got) == [(x, 1) for x in (1, 2, 3, 7, 9)]


def test_written_leaves_no_shuffle_files(spark):
    """Shuffle files of a written table are gone with the write; the session's setting stays as it was."""
    tops = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def files() -> set[str]:
        return {f for top in tops for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}

    was, before = spark.conf.get(CLEANUP, None), files()
    table = written(spark.range(1000).groupBy((F.col("id") % 7).alias("g")).agg(F.count("*").alias("n")), "groups")
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(CLEANUP, None) == was
    assert sorted(r.n for r in table.collect()) == [142, 143, 143, 143, 143, 143, 143]
