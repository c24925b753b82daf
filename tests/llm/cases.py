"""Documents with the hard cases: nulls, empty, blank, long, repeated, non-ASCII, clashing column names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = ("found", "lines", "language", "d", "t", "sid", "key", "h", "may", "kept", "rank", "bin", "th", "word", "bits",
            "component_id", "near_key", "line_key", "count", "start", "text_sha256", "url_host", "own_lines", "flag_r")
WORDS = ("alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo "
         "sierra tango uniform victor whiskey xray yankee zulu été ñandú größe 漢字 😀smile").split()


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (".\n" if rng.random() < 0.05 else "") for _ in range(n))


def rows() -> list[tuple]:
    base = prose(300, 1)
    w = base.split(" ")
    near = " ".join([*w[:100], "changed", *w[101:]])
    texts = [None, "", " \n\t ", "x", "four words are here", base, base, near, " ".join([*w[:150], "other", *w[151:]]),
             prose(60_000, 2), prose(300, 3), "12345 67890 !!!", "A-B_C d.e", "Licensed under MIT 4.0\n" + prose(50, 4)]
    out = [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    out += [out[5], out[5], (None, base, None, None, 5), (None, prose(40, 9), "en", "s", 1), (None, None, None, None, None),
            (40, "boiler plate line number 7\n" + prose(50, 5), "fr", "s", 1)]
    return out


def docs(spark, more=()):
    return spark.createDataFrame([*rows(), *more], SCHEMA)


def with_clashes(df):
    from pyspark.sql import functions as F
    return df.withColumns({c: F.lit("clash") for c in CLASHING if c not in df.columns})


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
