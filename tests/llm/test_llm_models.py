"""Language ID, the personal-data tagger, packing, WARC and URL filter: held-out accuracy and exact round trips."""

import zlib
from collections import defaultdict

import brute
import cases
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sensorlake.llm import language, packing, personal_data, tagger, url_filter, warc


# --------------------------------------------------------------------------- language
@pytest.fixture(scope="module")
def documents(spark, sf001):
    return spark.read.parquet(f"{sf001}/documents.parquet")


@pytest.fixture(scope="module")
def trees(documents):
    return language.learn(documents)


def test_language_held_out(documents, trees):
    out = language.identify(documents, trees).where(language.held_out())
    right, n = out.agg(F.sum((F.col("language.lang") == F.col("lang")).cast("int")), F.count("*")).first()
    assert n > 100 and right / n >= 0.97
    assert out.where("language.score < 0 OR language.score > 1").count() == 0


def plain_cost(lang, symbols, counts, text):
    """Code length of one text by the definition, one byte at a time."""
    s = [0, 0, 0, *(int(symbols[b]) for b in text)]
    total = 0.0
    for k in range(3, len(s)):
        for order in (3, 2, 1, 0):
            seen = counts[lang][order].get(tuple(s[k - order:k]), {})
            n, u = sum(seen.values()), len(seen)
            if s[k] in seen:
                total -= np.log2(seen[s[k]] / (n + u))
                break
            if n:
                total -= np.log2(u / (n + u))
        else:
            total += 6.0
        total += np.log2((symbols == 1).sum()) * (s[k] == 1)
    return total


def test_language_code_lengths():
    texts = {"a": [b"abab abab", b"abba"], "b": [b"xyz xyz", b"xxyyzz"]}
    symbols = language._symbol_map([ord(c) for c in "abxyz"])
    counts = {x: [defaultdict(dict) for _ in range(4)] for x in texts}
    grams = {}
    for lang, rows in texts.items():
        every = []
        for t in rows:
            s = [0, 0, 0, *(int(symbols[b]) for b in t)]
            every.append(language._quadruples(np.frombuffer(t, np.uint8), symbols, np.zeros(3, np.uint8)))
            for k in range(3, len(s)):
                for order in range(4):
                    c = counts[lang][order][tuple(s[k - order:k])]
                    c[s[k]] = c.get(s[k], 0) + 1
        g, n = np.unique(np.concatenate(every), return_counts=True)
        grams[lang] = (g.astype(np.int64), n)
    trees = language.Trees(["a", "b"], symbols, grams)
    tests = [b"abab", b"", b"zzz abq", b"xyzab yx", b"\xc3\xa9ab"]
    bits = trees.code_lengths(tests, trees.place())
    for t, row in zip(tests, bits):
        assert np.allclose(row, [plain_cost(x, symbols, counts, t) for x in ("a", "b")], atol=1e-3)


def test_language_long_text_in_pieces(trees, monkeypatch):
    place, text = trees.place(), cases.prose(3000, 8).encode()
    whole = trees.code_lengths([b"x", text, b"yz"], place)
    monkeypatch.setattr(language, "PIECE", 1000)
    assert np.allclose(whole, trees.code_lengths([b"x", text, b"yz"], place), rtol=1e-5)


def test_language_edge_cases(spark, trees):
    docs = cases.with_clashes(cases.docs(spark))
    out = language.identify(docs, trees, out="result").collect()
    assert len(out) == docs.count()
    for r in out:
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r.result.lang == "und") == (not lettered) and 0 <= r.result.score <= 1
    docs = docs.unionByName(spark.createDataFrame([(77, "слова другого языка " * 20)], "doc_id long, text string"),
                            allowMissingColumns=True)
    kept = language.drop_unknown(docs, trees)
    assert kept.where("doc_id IN (0, 1, 2, 11, 77)").count() == 0 and kept.where("doc_id IN (3, 4)").count() == 2
    assert kept.columns == docs.columns
    own = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert language.drop_unknown(own, trees).count() == own.count()
    empty = language.learn(cases.nothing(spark))
    assert empty.langs == []
    assert {r.language.lang for r in language.identify(docs, empty).collect()} == {"und"}


_SYLLABLES = {"ja": "これはにほんごのぶんしょうですきょうのてんきいいね日本語文章天気東京都大学生物", "th": "กขคงจฉชซญฎฏฐณดตถทธนบปผพฟภมยรลวศสหอ"}


def scripted(lang, n, seed):
    """A text of made-up words in a script that no other language has."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list(_SYLLABLES[lang]), 2)) for _ in range(60)] if seed == 0 else scripted(lang, 0, 0)
    return words if seed == 0 else "".join(words[int(x) ** 2 % 60] for x in rng.integers(0, 60, n))


@pytest.mark.parametrize("lang", ["ja", "th"])
def test_language_minority_script(spark, documents, lang):
    """Ten rows in another script among four large languages: texts of that script are told and stay, those of
    scripts never learned still go."""
    few = [(10_000_019 * k, scripted(lang, 60, k + 1), lang) for k in range(1, 40)]
    few = spark.createDataFrame(few, "doc_id long, text string, lang string").where(~language.held_out()).limit(10)
    assert few.count() == 10
    trees = language.learn(documents.select("doc_id", "text", "lang").unionByName(few))
    fresh = spark.createDataFrame([(k, scripted(lang, 40, 1000 + k)) for k in range(20)]
                                  + [(99, "слова другого языка " * 20)], "doc_id long, text string")
    out = {r.doc_id: r.language for r in language.identify(fresh, trees).collect()}
    assert all(out[k].lang == lang and out[k].bits_per_byte < 6 for k in range(20))
    assert {r.doc_id for r in language.drop_unknown(fresh, trees).collect()} == set(range(20))
    assert out[99].bits_per_byte > trees.limits.get(out[99].lang, 0)


def test_language_rare_bytes_by_definition():
    """Which rare byte it is: the tables give the code length of the definition, one byte at a time."""
    texts = {"a": "данные и данные".encode(), "b": "漢字かな漢字".encode()}
    symbols = language._symbol_map([0xD0, 0xE6])
    spaces = np.full(3, 32, np.uint8)
    rare, counts = {}, {x: [defaultdict(dict) for _ in range(4)] for x in texts}
    for x, t in texts.items():
        at, q = language._rare_quadruples(np.frombuffer(t, np.uint8), symbols, spaces)
        rare[x] = np.unique(q.astype(np.int64), return_counts=True)
        for k in at:
            for order in range(4):
                c = counts[x][order][(b"   " + t)[k + 3 - order:k + 3]]
                c[t[k]] = c.get(t[k], 0) + 1
    grams = {x: (np.array([0]), np.array([1])) for x in texts}
    trees, plain = (language.Trees(["a", "b"], symbols, grams, r) for r in (rare, None))
    for t in ["данно漢かз\n字".encode(), b"\xff\xfe", b"", b"\xb0 \xb0"]:
        got = trees.code_lengths([t], trees.place())[0] - plain.code_lengths([t], plain.place())[0]
        for x, value in zip(("a", "b"), got):
            want = 0.0
            for k, b in enumerate(t):
                if symbols[b] == language.RARE:
                    full = (b"   " + t).replace(b"\n", b" ")
                    for order in (3, 2, 1, 0):
                        seen = counts[x][order].get(full[k + 3 - order:k + 3], {})
                        n, u = sum(seen.values()), len(seen)
                        if b in seen:
                            want -= np.log2(seen[b] / (n + u)) + np.log2((symbols == 1).sum())
                            break
                        want -= np.log2(u / (n + u)) if n else 0
            assert abs(value - want) < 1e-3


# --------------------------------------------------------------------------- tagger
def test_tagger_slopes():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in tagger.start_weights(7, 5).items()}
    x, y = rng.integers(0, 7, (3, 9)), rng.integers(0, 5, (3, 9))
    _, slopes = tagger.loss_and_slopes(w, x, y)
    for name, v in w.items():
        at = tuple(rng.integers(0, s) for s in v.shape)
        own = v[at]
        v[at] = own + 1e-3
        up = tagger.loss_and_slopes(w, x, y)[0]
        v[at] = own - 1e-3
        down = tagger.loss_and_slopes(w, x, y)[0]
        v[at] = own
        assert abs((up - down) / 2e-3 - slopes[name][at]) < 1e-3, name


def test_tagger_held_out(spark):
    """Trained on half of the documents, it finds the base spans of the other half."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text rlike '[0-9@]'")
    weights = personal_data.learn(docs.where("doc_id % 2 = 0"))
    texts = [r.text for r in docs.where("doc_id % 2 = 1").select("text").collect()]
    base = [personal_data.base_spans(t) for t in texts]
    found = personal_data.decoded_spans(weights, texts, [[] for _ in texts])
    hit = sum(len(set(a) & set(b)) for a, b in zip(found, base))
    assert hit / sum(map(len, base)) >= 0.9 and hit / sum(map(len, found)) >= 0.9


def test_personal_keeps_base_and_reconciles(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text rlike '[0-9@]'")
    weights = personal_data.learn(docs, train_docs=300, steps=80)
    for r in personal_data.find_personal(docs.limit(200), weights, out="p").select("text", "p.*").collect():
        assert set(r.base) <= set(r.spans)
        places = sorted(tuple(map(int, s.split(":")[1:])) for s in set(r.spans) - set(r.base))
        assert all(a[1] <= b[0] for a, b in zip(places, places[1:]))


@pytest.mark.parametrize("text, ok", [
    ("017 555-7713 22", True), ("0044 20 7946 0958", True), ("+49 (0) 30 123456", True), ("(030) 1234/5678", True),
    ("030 1234", False), ("017 555-7713 22 x", False), ("1234567890123456", False), ("12.10.2020 10:30", False), ("", False)])
def test_personal_national_numbers(monkeypatch, text, ok):
    """A number in national form is reported where the tagger says so."""
    def decode(weights, classes, forbidden):
        tags = np.full(classes.shape, 8, np.int8) * (classes != 0)
        tags[:, 0] = 7
        return tags.astype(np.int8)

    monkeypatch.setattr(personal_data, "decode", decode)
    want = [(0, 3, len(text))] if ok else []
    assert personal_data.decoded_spans({}, [text, "1 "], [[], []])[0] == want


@pytest.mark.parametrize("size", [12, 31, 40, 64, 80, 300])
def test_personal_spans_across_windows(monkeypatch, size):
    """Spans longer than half a window come out whole wherever they start, and next to others."""
    def decode(weights, classes, forbidden):
        """Every window right as far as it sees: runs without blanks are addresses."""
        inside = (classes != 0) & (classes != personal_data.classes_of(" ")[0])
        before = np.concatenate([np.ones((len(classes), 1), bool), inside[:, :-1]], axis=1)
        return np.where(inside, np.where(before, 2, 1), 0).astype(np.int8)

    monkeypatch.setattr(personal_data, "decode", decode)
    for at in ("@uni.tld", "ä@" + "ß" * (size - 7) + ".tld"):
        span = ("näme." * size)[:size - len(at)] + at
        for off in range(2 * personal_data.STRIDE):
            text = " " * off + span + " " * 3 + "n@b.de" + " " * off
            want = [(off, 0, off + len(span)), (off + len(span) + 3, 0, off + len(span) + 9)]
            assert personal_data.decoded_spans({}, [text, "none", text], [[], [], [want[1]]]) == [want, [], want[:1]]


# --------------------------------------------------------------------------- packing
def token_ids(text):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def check_pieces(docs, pieces, window=2048):
    """Every id in one piece, checksums right, sequences gapless; returns the share of padding."""
    left = defaultdict(list)
    for r in docs:
        left[r.doc_id].append(token_ids(r.text))
    covered = defaultdict(lambda: defaultdict(int))
    sequences = defaultdict(list)
    for r in pieces:
        bodies = [b for b in left[r.doc_id] if len(b) == r.doc_tokens
                  and zlib.crc32(b[r.start:r.start + r.length].tobytes()) == r.ids_crc32]
        assert bodies, r
        covered[r.doc_id, r.doc_tokens][r.start] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    want, got = defaultdict(int), defaultdict(int)
    for d, bodies in left.items():
        for b in bodies:
            want[d, len(b)] += len(b)
    for k, starts in covered.items():
        got[k] += sum(starts.values())
    assert want == got
    padding = total = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
        total += window if at & (at - 1) else at
        padding += window - at if at & (at - 1) else 0
    return padding / max(total, 1)


def test_packing_round_trip(spark):
    special = [(900, "a<|endoftext|>b", "en", "s", 0), (901, " " * 5000, "en", "s", 0)]
    docs = cases.with_clashes(cases.docs(spark, special))
    pieces = packing.pack(docs).collect()
    check_pieces(docs.collect(), pieces)
    assert packing.pack(cases.nothing(spark)).count() == 0


def test_packing_documents(documents):
    rows = documents.where("doc_id < 400")
    assert check_pieces(rows.collect(), packing.pack(rows).collect()) < 0.03


def test_packing_lengths_that_do_not_combine(spark):
    """All pieces of about 0.7 windows: nothing fills a window without cuts."""
    docs = spark.createDataFrame([(k, " a" * 1400 + f" {k}", None, None, None) for k in range(150)], cases.SCHEMA)
    assert check_pieces(docs.collect(), packing.pack(docs).collect()) < 0.05


def test_packing_plan():
    rng = np.random.default_rng(1)
    histogram = {b: int(n) for b, n in zip(range(1, 33), rng.integers(0, 400, 32)) if n}
    used = defaultdict(int)
    for strategy, times in packing.plan(histogram, 32):
        assert sum(strategy) == 32 and len(strategy) <= 3 and times > 0
        for b in strategy:
            used[b] += times
    assert all(used[b] <= histogram[b] for b in used) and sum(used.values()) > 0.8 * sum(histogram.values())


def test_least_squares_meets_conditions():
    rng = np.random.default_rng(3)
    for _ in range(5):
        a, y = rng.random((8, 20)), rng.random(8) - 0.2
        x = packing.least_squares(a, y)
        slope = a.T @ (y - a @ x)
        assert (x >= 0).all() and (slope <= 1e-6).all() and np.abs(slope[x > 0]).max(initial=0) < 1e-6


def test_crc_of_tail():
    rng = np.random.default_rng(5)
    for n, m in ((0, 4), (256, 4), (512, 8192), (4, 0)):
        a, b = rng.bytes(n), rng.bytes(m)
        assert packing.crc_of_tail(zlib.crc32(a + b), zlib.crc32(a), m) == zlib.crc32(b)


def test_tokenizer_fallback():
    encode = packing._encoder("byte_bpe_50k")
    for text in ("", "a<|endoftext|>b c", " " * 1_000_000, "é 漢字 🙂\r\n\t  x"):
        assert encode(text).tolist() == token_ids(text).tolist()[:-1]


# --------------------------------------------------------------------------- WARC
PAGES = "page_id long, url string, html string, kept string"


def pages(spark):
    big = "<p>" + cases.prose(30_000, 4) + "é" * 4000
    rows = [(1, "http://a.b/1", "x" * 200, "c"), (2, "http://a.b/2\r\nX-Page-ID: 77", "x" * 200, None), (0, None, "x" * 200, "c"),
            (3, "http://c/%0A", "", ""), (4, "http://c/", None, ""), (5, "u", big, ""), (6, "u", big, ""), (7, "u", "short", ""),
            (8, "u", "short", ""), (9, "u", "é" * 50, ""), (10, "u", "é" * 50, ""), (11, "u", "WARC/1.1\r\n\r\n" * 40 + "0\r\n\r\n", ""),
            (12, "u", "y" * 150, ""), (12, "u", "y" * 150, ""), (12, "v", "y" * 150, ""), (None, "u", "z" * 150, ""),
            (None, "u", "x" * 200, ""), (13, "u", "a" * 64, "")]
    return spark.createDataFrame(rows, PAGES)


@pytest.mark.parametrize("segment", [1 << 16, 700])
def test_warc_round_trip(spark, tmp_path, segment):
    df = pages(spark)
    warc.write_archives(df, str(tmp_path / "w"), segment_bytes=segment)
    back = warc.read_archives(spark, str(tmp_path / "w"))
    rows = df.collect()
    want = sorted((str(r.page_id), r.url or "", (r.html or "")) for r in rows)
    found = back.collect()
    assert all(r.complete for r in found) and len(found) == len(rows)
    assert sorted((str(r.page), r.url or "", r.payload.decode()) for r in found if r.record_type == "response") == [
        w for w in want if ("response", None) == expected(rows, w)]
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                  for r in warc.round_trip(df, path=str(tmp_path / "r")).collect()), key=str)
    full = []
    for r in rows:
        kind, target = expected(rows, (str(r.page_id), r.url or "", r.html or ""))
        body = (r.html or "").encode()
        full.append((r.page_id, len(body), brute.sha(body), kind, target))
    assert got == sorted(full, key=str)


def expected(rows, row):
    body = row[2]
    ids = [r.page_id for r in rows if (r.html or "") == body and r.page_id is not None]
    if len(body.encode()) < 100 or not ids or row[0] == str(min(ids)):
        return "response", None
    return "revisit", min(ids)


def archive(spark, tmp_path, where):
    """Bytes of an archive of pages with segments of 4,000 bytes, cut into records."""
    warc.write_archives(pages(spark).where(where).coalesce(1), str(tmp_path / "w"), segment_bytes=4000)
    content = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").iterdir()) if p.name.startswith("part"))
    return content.split(b"\r\n\r\nWARC/1.1")


def reread(spark, tmp_path, name, content):
    (tmp_path / name).mkdir()
    (tmp_path / name / "part.warc").write_bytes(content)
    return warc.read_archives(spark, str(tmp_path / name)).collect()


def test_warc_lost_segment(spark, tmp_path):
    """A missing continuation is noticed, and a missing first segment."""
    records, glue = archive(spark, tmp_path, "page_id = 5"), b"\r\n\r\nWARC/1.1"
    assert len(records) > 3
    for k in (0, 1, 2, len(records) - 1):
        left = [r for x, r in enumerate(records) if x != k]
        content = glue.join(left) if k else b"WARC/1.1" + glue.join(left)
        r = reread(spark, tmp_path, f"cut{k}", content)
        assert [(x.page, x.record_type, x.complete, x.payload) for x in r] == [("5", "response", False, None)]


def test_warc_cut_files(spark, tmp_path):
    """Archives cut short or with strange bytes in between: whole records come back, and nothing is lost in silence."""
    records, glue = archive(spark, tmp_path, "page_id IN (0, 1, 2, 5)"), b"\r\n\r\nWARC/1.1"
    whole = glue.join(records)
    want = {x.page: x.payload for x in reread(spark, tmp_path, "whole", whole)}
    assert set(want) == {"0", "1", "2", "5"}
    hole = whole.index(b"WARC-Segment-Number: 1") + 1500
    for name, content in (("short", whole[:-200]), ("head", whole + b"WARC/1.1\r\nWARC-Type: resp"), ("noise", b"noise" + whole),
                          ("hole", whole[:hole] + whole[hole + 100:]), ("empty", b""), ("no length", b"WARC/1.1\r\nWARC-Type: response\r\n\r\n")):
        r = reread(spark, tmp_path, name, content)
        assert all(x.payload == want[x.page] for x in r if x.complete)
        assert (len([x for x in r if not x.complete]) > 0) == (name != "empty")
        if name in ("short", "hole"):
            assert {x.page for x in r if x.complete} == {"0", "1", "2"} and "5" in {x.page for x in r}


def test_chunked():
    for body in (b"", b"a", b"\r\n0\r\n\r\n" * 9, bytes(range(256)) * 100):
        assert warc.unchunked(warc.chunked(body, 100)) == body
    assert warc.unchunked(b"5\r\nabc") is None and warc.unchunked(b"zz\r\n") is None


def test_warc_empty(spark, tmp_path):
    assert warc.round_trip(spark.createDataFrame([], PAGES), path=str(tmp_path / "e")).count() == 0


# --------------------------------------------------------------------------- URLs
URLS = [None, "", "no scheme", "http://", "http://a.com", "HTTP://WWW.Example.COM/en/x?y#z", "http://x.example.com/en/1",
        "https://www.example.com:443/en/", "http://notexample.com/en/1", "http://a.net/es/", "http://a.net/esx", "x://y.org/fr?q=1://b",
        "http://listed.org/a/?b=2&a=1&utm_source=q#f", "http://www.listed.org/a?a=1&b=2", "http://listed.org/b", "http://É.net/fr/é"]
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def plain_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = brute.lower_ascii(rest[:cut]), rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(h + "/" + p, v) for r, v in RULES for h, p in [r.split("/", 1)]
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return host, path, max(fits, key=lambda f: len(f[0]), default=(None, None))


@pytest.mark.parametrize("max_blocks", [64, 1 << 18])
def test_url_filter(spark, max_blocks):
    df = cases.with_clashes(spark.createDataFrame([(k, u) for k, u in enumerate([*URLS, *URLS])], "page_id long, url string"))
    listed = spark.createDataFrame([("https://listed.org/a?a=1&b=2",), (None,), ("junk",)] + [(f"http://many{k}.org/",) for k in range(3000)],
                                   "url string")
    out = url_filter.filter_urls(df, RULES, listed, max_blocks=max_blocks, out="f").select("page_id", "url", "f.*").collect()
    assert len(out) == 2 * len(URLS)
    for r in out:
        host, path, (rule, verdict) = plain_url(r.url)
        on_list = r.page_id % len(URLS) in (12, 13)
        assert (r.host, r.path, r.rule, r.listed) == (host, path, rule, on_list), r
        assert r.verdict == (verdict or ("block" if on_list else "allow"))
    kept = url_filter.drop_blocked(df, RULES, listed)
    assert kept.columns == df.columns
    assert url_filter.filter_urls(df.limit(0), RULES, listed.limit(0)).count() == 0


def test_language_null_ids(spark):
    """Rows without ids are drawn by their texts: languages are learned, and no document goes for want of an id."""
    import random
    rng = random.Random(1)
    words = {"aa": "alpha bravo charlie delta echo".split(), "bb": "uno dos tres cuatro cinco".split()}
    rows = [(None, " ".join(rng.choice(words[x]) for _ in range(12)), x) for x in words for _ in range(10_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = language.learn(df)
    assert trees.langs == ["aa", "bb"]
    assert language.drop_unknown(df, trees).count() == len(rows)
    one = spark.createDataFrame([(None, "the very same words", "aa")] * 5000, "doc_id long, text string, lang string")
    assert language.learn(one).langs == ["aa"] and language.drop_unknown(one, language.learn(one)).count() == 5000
    unlabelled = one.withColumn("lang", F.lit(None).cast("string"))
    assert language.drop_unknown(unlabelled, language.learn(unlabelled)).count() == 5000


def test_personal_null_ids(spark):
    df = spark.createDataFrame([(None, "call +49 30 123456 78 or write to me@example.org")] * 5000, "doc_id long, text string")
    assert personal_data.learn(df, steps=2) is not None


def test_packing_equal_rows(spark):
    """Rows equal in everything are dealt over buckets by a stored row number."""
    df = spark.createDataFrame([(None, "")] * 5000 + [(1, "x")], "doc_id long, text string")
    rows = packing.pack(df).collect()
    assert len(rows) == 5001 and len({(r.sequence_id, r.offset) for r in rows}) == 5001
