"""Conversation tries, manifests and SentencePiece ids against plain versions and the library."""

import random

import brute
import numpy as np
import pytest
from cases import docs, nothing, prose, rows, with_clashes
from pyspark.sql import functions as F

from sensorlake.llm import merkle, pieces, prefix_trie
from sensorlake.llm.queries import LOWER, UPPER

TURNS = "conv_id long, turn long, role string, text string"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


# --------------------------------------------------------------------------- tries
def nodes(df) -> list:
    return sorted((tuple(r[c] for c in NODE) for r in prefix_trie.prefix_trie(
        *prefix_trie.branched(prefix_trie.turns(df))).collect()), key=str)


def conversations() -> list[tuple]:
    rng = random.Random(5)
    out = []
    for c in [*range(60), 1000, 1001, 1004, 77, 2**40, 2**40 + 3, -5, -7, 16384 * 5, 16384 * 5 + 1]:
        for t in range(rng.choice([1, 1, 2, 3, 8, 9, 12])):
            out.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b é", "", None])))
    out += [(3, None, "user", "first"), (3, None, "user", "first"), (4, 2, "user", "tie"), (4, 2, "assistant", "tie"), (4, 2, "user", "tie")]
    out += [(None, 1, "user", "x"), (None, None, None, None), (8, 1, "a", "b"), (9, 1, "ab", "")]
    return out


def test_trie_brute(spark):
    table = conversations()
    got = nodes(with_clashes(spark.createDataFrame(table, TURNS)).withColumnsRenamed({"found": "name", "d": "pos", "key": "Key"}))
    assert got == sorted(brute.trie(brute.rebuilt(table)), key=str)


@pytest.mark.parametrize("sizes", [[64, 63, 65, 128, 1], [700, 700, 300, 129, 127, 64]])
def test_trie_long(spark, sizes):
    """Sequences of many segments that share beginnings and part at, before and after a cut."""
    table = []
    for c, n in enumerate(sizes):
        cut = [n, n // 2, 64, 63, 65, 0][c % 6]
        table += [(5 * c, t, "user", f"{t}" if t < cut or c < 2 else f"{t} of {c}") for t in range(n)]
    table += [(5 * len(sizes), t, "user", f"{t}") for t in range(sizes[0])]
    assert nodes(spark.createDataFrame(table, TURNS)) == sorted(brute.trie(brute.rebuilt(table)), key=str)


def test_trie_nothing(spark):
    assert nodes(spark.createDataFrame([], TURNS)) == []
    assert nodes(spark.createDataFrame([(None, 1, "user", "x")], TURNS)) == []


def test_trie_lists(spark):
    """Lists of ids in several parts are hashed in numeric order."""
    ids = [*range(0, 70_000, 3), -1, -70_000, 2**50]
    ends = spark.createDataFrame([(0, 1, c) for c in ids] + [(0, 2, 9), (1, 1, 10), (1, 1, 9)], "first long, depth long, conv long")
    got = {(r.first, r.depth): r.ends_sha256 for r in prefix_trie.list_digests(ends).collect()}
    assert got == {(0, 1): brute.sha(",".join(map(str, sorted(ids)))), (0, 2): brute.sha("9"), (1, 1): brute.sha("9,10")}


def test_trie_hot_prefix_is_split(spark):
    """Rows of a node with very many members do not wait for one task: they meet the node's row behind an exchange of their own."""
    plan = prefix_trie.prefix_trie(*prefix_trie.branched(prefix_trie.turns(spark.createDataFrame(conversations(), TURNS))))
    assert "SinglePartition" not in plan._jdf.queryExecution().executedPlan().toString()


# --------------------------------------------------------------------------- manifests
def tampered(df, **how):
    found = merkle.manifest(df, claims={"text": F.translate("text", UPPER, LOWER)},
                            claimed=F.crc32(F.col("doc_id").cast("string")) % 5 == 0, **how)
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in found.collect()), key=str)


def fields(table) -> list:
    return [(d, s, lang, n, t) for d, t, lang, s, n in table]


def test_manifest_cases(spark):
    table = [*rows(), *[(100 + k, f"Text {k}", "en", ["a", "b", None, "é", "", "a\x00"][k % 6], None) for k in range(100)]]
    got = tampered(with_clashes(docs(spark, table[len(rows()):])).withColumn("tree", F.lit(1)).withColumn("pos", F.lit(2)))
    assert got == brute.merkle(fields(table))
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 17, 257])
def test_manifest_tiers(spark, monkeypatch, n):
    """Superblocks of one level: as many tiers as levels, for leaves and for sources."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK_BITS", 4)
    monkeypatch.setattr(merkle, "BUCKET_ROWS", 20)
    table = [(k, f"Row {k}", "en", "one", k) for k in range(n)] + [(k, f"Row {k}", "en", f"s{k % (n // 2 + 1)}", 0) for k in range(n // 2)]
    assert tampered(docs(spark, table).where(F.col("source").rlike("one|s[0-9]+"))) == brute.merkle(fields(table))


def test_manifest_large_source(spark):
    table = [(k, f"Row {k}", "en", "one" if k % 3 else "two", k) for k in range(9000)]
    assert tampered(spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")) \
        == brute.merkle(fields(table))


def test_manifest_nothing(spark):
    assert tampered(nothing(spark)) == []


def test_manifest_proofs(spark):
    """The proof itself folds to the root, and no other leaf does with it."""
    table = [(k, f"Row {k}", "en", f"s{k % 3}", k) for k in range(200)]
    found = merkle.manifest(docs(spark, table), proofs=True).collect()
    assert all(r.verified and merkle.folded(r.leaf, r.proof) == r.root and brute.sha("".join(r.proof)) == r.proof_sha256 for r in found)
    assert all(merkle.folded(brute.sha("other"), r.proof) != r.root for r in found)


# --------------------------------------------------------------------------- SentencePiece
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=pieces.vocabulary_path())


def odd_texts() -> list[str]:
    rng = random.Random(3)
    letters = [*"abcdefghij ABC  \n\t.,!?0123", *"éèüß漢字한국어😀▁\x00ﬁЖд", "the", "ing", " th", "aaaa", "    "]
    out = ["", " ", "  ", "a", "\x00", "▁", "▁▁ x", " " * 300, "a" * 500, "\n" * 90, "😀🏽", " " * 200 + "x", "<s>", "</s> <unk><0x0A>", "﻿x",
           "=" * 777, prose(20_000, 1), "Ab9+/" * 3000, "漢字" * 2000]
    out += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    out += ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 400))) for _ in range(100)]
    return out + ["".join(rng.choice("= -_*#~\n ") for _ in range(rng.randint(0, 400))) for _ in range(100)]


@pytest.mark.parametrize("work", [pieces.MAX_WORK, 0])
def test_pieces_like_library(monkeypatch, work):
    """Merge rounds, and merges one at a time, give the library's ids; so does decoding."""
    monkeypatch.setattr(pieces, "MAX_WORK", work)
    sp, codec = library(), pieces.Codec(pieces.read_vocabulary(pieces.vocabulary_path()))
    texts = odd_texts()
    ids, at = codec.encode(texts)
    want = [sp.encode(t, add_bos=True, add_eos=True) for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
    assert codec.decode(ids, at) == [sp.decode(w) for w in want]


def test_pieces_decode_any_ids():
    rng = random.Random(4)
    sp, codec = library(), pieces.Codec(pieces.read_vocabulary(pieces.vocabulary_path()))
    lists = [[rng.choice([rng.randint(0, 31_999), rng.randint(0, 258)]) for _ in range(rng.randint(0, 12))] for _ in range(2000)]
    at = np.cumsum([0, *map(len, lists)])
    assert codec.decode(np.array([x for w in lists for x in w], np.int32), at) == [sp.decode(w) for w in lists]


def test_pieces_table(spark):
    sp = library()
    df = with_clashes(docs(spark)).withColumn("ids", F.lit("replaced"))
    for packed in (False, True):
        both = pieces.decode(pieces.encode(df, packed=packed), out="back").collect()
        assert len(both) == df.count() and both[0].found == "clash"
        for r in both:
            want = sp.encode(r.text or "", add_bos=True, add_eos=True)
            assert (np.frombuffer(r.ids, "<u4").tolist() if packed else r.ids) == want and r.back == sp.decode(want)
    bare = pieces.encode(docs(spark), ends=False).select("text", "ids").collect()
    assert all(r.ids == sp.encode(r.text or "") for r in bare)
    assert pieces.decode(pieces.encode(nothing(spark)), out="back").count() == 0


def test_pieces_null_ids(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [1, None, 264, 2]), (4, None), (5, [9829, 9829])], "k int, ids array<int>")
    got = {r.k: r.back for r in pieces.decode(df, out="back").collect()}
    assert got == {1: None, 2: "", 3: "a", 4: None, 5: library().decode([9829, 9829])}


def test_pieces_query(spark, sf001):
    from sensorlake.llm.queries import QUERIES
    sp, text = library(), {r.doc_id: r.text for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()}
    got = QUERIES["op13_sentencepiece"](spark, sf001).collect()
    assert len(got) == len(text)
    for r in got:
        ids = sp.encode(text[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(sp.decode(ids)))
