import base64
import hashlib
import math
import random
import re
import uuid
import zlib

from tests.llm.brute import ws_words

from cohortica.llm import _store, queries, runs, search, warc


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            s = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                found.setdefault((s, i - s + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_collapsed(w):
    gone = {i for s, n, q in brute_runs(w) for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_texts(seed):
    r = random.Random(seed)
    out = []
    for _ in range(200):
        w = [r.choice("abcdé") for _ in range(r.randrange(60))]
        for _ in range(r.randrange(3)):
            p = [r.choice("abc") for _ in range(r.randrange(1, 8))]
            at = r.randrange(len(w) + 1)
            w[at:at] = (p * 9)[: r.randrange(6, 60)]
        out.append(r.choice([" ", "\n", "\t\x0b "]).join(w))
    return out + [None, "", " \n", "a", "x x x x x x", "x x x x x", "\x1cx \x1cx \x1cx \x1cx \x1cx \x1cx", "a a " * 6]


def test_runs_of_against_brute_force():
    r = random.Random(3)
    for _ in range(400):
        k = r.choice([1, 2, 2, 3])
        s = ([r.randrange(1, k + 1) for _ in range(r.randrange(1, 7))] * 40)[: r.randrange(60)]
        for _ in range(r.randrange(4) if s else 0):
            s[r.randrange(len(s))] = r.randrange(1, k + 1)
        assert [tuple(x) for x in runs.runs_of(s, k + 1).tolist()] == brute_runs(s)


def test_periodic_runs(spark):
    texts = periodic_texts(1)
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(5, texts[5], "y", 0), (None, texts[6], None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, N_WORDS bigint")
    got = [(r[0], r[1], [tuple(x) for x in r[2]], r[3]) for r in runs.periodic_runs(docs).collect()]
    want = [(d, len(ws_words(t)), brute_runs(ws_words(t)), brute_collapsed(ws_words(t))) for d, t, *_ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(len(x[2]) for x in got) > 150
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    named = runs.periodic_runs(spark.createDataFrame([("k", "a b " * 5)], "doc_id string, text string")).first()
    assert (named[0], [tuple(x) for x in named[2]], named[3]) == ("k", [(0, 10, 2)], "a b")


def test_runs_of_a_very_long_text(spark):
    r = random.Random(9)
    period = [f"w{r.randrange(5000)}" for _ in range(20_000)]
    words = [f"v{r.randrange(300)}" for _ in range(100_000)] + period * 5 + ["z"] * 50_000
    got = runs.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id int, text string")).first()
    assert got["n_words"] == 250_000
    assert {(100_000, 100_000, 20_000), (200_000, 50_000, 1)} <= {tuple(x) for x in got["runs"]}


def test_tails(spark):
    texts = [(i, t) for i, t in enumerate(periodic_texts(2) * 2)] + [(None, "a b")]
    want = []
    for d, t in texts:
        w = ws_words(t)
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
        want.append((d, w))
    got = [(r[0], ws_words(r[1])) for r in runs.with_tails(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_periodic_query(spark):
    d = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, d).collect()}
    seen = 0
    for doc, text in runs.with_tails(spark.read.parquet(f"{d}/documents.parquet")).collect():
        found = brute_runs(ws_words(text))
        best = min(((-n, s, q) for s, n, q in found), default=None)
        r = rows[doc]
        assert r["n_runs"] == len(found) and r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(brute_collapsed(ws_words(text)).encode()).hexdigest()
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4)
        seen += bool(found)
    assert seen >= 5


# -- archives ---------------------------------------------------------------


def folder(spark):
    return f"{_store.shared_dir(spark)}/test-{uuid.uuid4().hex}"


PAGES = [(i, f"http://h/{i}", f"<p>{i % 7}</p>" if i % 3 else f"<b>{i}é</b>" * 50) for i in range(60)] + [(60, None, None), (61, "http://h/a b\r\nX: y", ""), (None, "http://h/none", "<p>1</p>"), (62, "u", "<p>1</p>"), (62, "u", "<p>1</p>"), (63, "u", "a\r\n\r\nWARC/1.0\r\n\r\n")]


def brute_pages(pages, least):
    out = []
    for p, _, h in pages:
        data = (h or "").encode()
        last = max([q for q, _, x in pages if (x or "") == (h or "") and q is not None], default=None)
        again = len(data) >= least and last is not None and p != last
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", last if again else None))
    return sorted(out, key=str)


def test_archived(spark):
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id bigint, url string, html string, payload string, SALT int").repartition(3)
    for least in (0, 20):
        assert sorted((tuple(r)[:5] for r in warc.archived(pages, least).collect()), key=str) == brute_pages(PAGES, least)
    assert warc.archived(pages.limit(0)).count() == 0
    text = spark.createDataFrame([("a:b c", "u", "x"), ("z", "u", "x")], "page_id string, url string, html string")
    assert sorted(tuple(r)[0::4] for r in warc.archived(text).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == [("a:b c", "z"), ("z", None)]


def test_salted_lookup(spark, monkeypatch):
    monkeypatch.setattr(warc, "small", lambda df: df)
    pages = spark.createDataFrame([p for p in PAGES], "page_id bigint, url string, html string")
    got = warc.revisits(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == brute_pages(PAGES, 0)


def members(n, seed=0, size=400):
    r = random.Random(seed)
    return [warc.record(i, f"http://h/{i}", bytes(r.randrange(256) for _ in range(r.randrange(size))), 0, "X", None, "2000-01-01T00:00:00Z") for i in range(n)]


def kept(data):
    """Ids of the records, and gaps, that the reader finds."""
    found = list(warc.salvage(data))
    return [int(re.search(r"page:(\d+)", h["warc-record-id"] + "page:99")[1]) for _, _, h, _, e in found if h], [(a, b) for a, b, h, _, _ in found if not h]


def test_files_are_archives_that_gzip_reads(spark):
    import gzip

    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").coalesce(1)
    for compress in (True, False):
        path = folder(spark)
        warc.write(warc.revisits(pages), path, compress)
        files = [bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).collect()]
        text = b"".join(gzip.decompress(f) if compress else f for f in files)
        assert text.count(b"WARC/1.1\r\n") == len(PAGES)
        rows = warc.read(spark, path).collect()
        assert len(rows) == len(PAGES) and not any(r["failed"] for r in rows)
        assert all(hashlib.sha1(r["payload"]).digest() == base64.b32decode(r["payload_digest"]) for r in rows if r["payload"] is not None)


def test_salvage_against_every_damage():
    """Whatever is damaged, the other records come back, and records and gaps tile the archive."""
    r = random.Random(5)
    for compress in (True, False):
        parts = [warc._member(m) if compress else m for m in members(12, 3)]
        ends = [sum(map(len, parts[: i + 1])) for i in range(12)]
        whole = b"".join(parts)
        assert kept(whole) == (list(range(12)), [])
        for _ in range(300):
            data, how = bytearray(whole), r.randrange(4)
            at = r.randrange(len(data))
            hit = next(i for i, e in enumerate(ends) if at < e)
            if how == 0:
                data[at] ^= 1 << r.randrange(8)
            elif how == 1:
                del data[at : ends[hit]]
            elif how == 2:
                data[at:at] = b"\x1f\x8b\x08junk WARC/1.1\r\n"
            else:
                data = data[:at]
            ids, gaps = kept(bytes(data))
            want = [i for i in range(12) if i != hit and not (how == 3 and i > hit)]
            assert set(ids) >= set(want) and (len(set(ids)) == len(ids) or not compress)  # a plain header has no sum
            tiles = sorted({(a, b) for a, b, *_ in warc.salvage(bytes(data))})
            assert all(x[1] == y[0] for x, y in zip(tiles, tiles[1:])) and (not data or (tiles[0][0], tiles[-1][1]) == (0, len(data)))
            if compress and hit not in ids and at not in (ends[hit - 1] if hit else 0, 0):
                assert len(gaps) == 1
    assert kept(b"") == ([], []) and kept(b"\0" * 100) == ([], [(0, 100)])


def test_members_of_several_records_and_records_of_several_members():
    m = members(6, 1)
    one = warc._member(m[0] + m[1][:-9] + m[2]) + warc._member(m[3])
    ids, gaps = kept(one)
    assert ids == [0, 2, 3] and len(gaps) == 1
    cut = len(m[4]) // 2
    several = warc._member(m[4][:cut]) + warc._member(m[4][cut:])
    assert kept(several + warc._member(m[5])) == ([4, 5], [])
    assert kept(warc._member(m[4][:cut]) + warc._member(m[5])) == ([5], [(0, len(warc._member(m[4][:cut])))])


def test_a_record_longer_than_a_member(spark):
    pages = spark.createDataFrame([(1, "u", "ab" * 6_000_000), (2, "u", "c")], "page_id bigint, url string, html string").coalesce(1)
    got = warc.archived(pages).collect()
    assert sorted((r["page_id"], r["payload_bytes"]) for r in got) == [(1, 12_000_000), (2, 1)]


# -- search -----------------------------------------------------------------


def brute_search(docs, items, k):
    terms = lambda t: ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, w) for d, w in held if w]
    n, total = len(held), sum(len(w) for _, w in held)
    out = []
    for i, t in set(items):
        score = []
        for d, w in held:
            s, m = 0, 50 + 50 * len(w) * n // total
            for x in set(terms(t)):
                df, tf = sum(x in v for _, v in held), w.count(x)
                s += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (10**9 * tf // (1000 * tf + 20 * m)) if tf else 0
            score.append((-s, d is None, d if d is not None else 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(x for x in score if x[0] < 0)[:k], 1)]
    return sorted(out, key=str)


def test_search(spark):
    r = random.Random(8)
    pool = [f"w{i}" for i in range(40)] + ["Der", "É", "é", "x9_y"]
    text = lambda n: " ".join(r.choice(pool) for _ in range(r.randrange(n)))
    docs = [(i, text(40)) for i in range(300)]
    docs += [(i, docs[3][1]) for i in range(300, 340)] + [(7, docs[7][1])] * 2 + [(None, docs[3][1]), (900, None), (901, ""), (902, " .! ")]
    items = [(i, text(12)) for i in range(12)] + [(3, "w1 w2"), (50, None), (51, "?"), (52, "nowhere"), (53, docs[3][1]), (53, docs[3][1])]
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id bigint, text string, score int, Item string").repartition(3)
    bench = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id int, text string, rank int")
    want = brute_search(docs, items, 10)
    for block, turns in ((1 << 20, 1000), (400, 5)):
        got = search.search(frame, bench, 10, turns, block).collect()
        assert sorted(map(tuple, got), key=str) == want
    named = search.search(frame.selectExpr("'d' || doc_id AS doc_id", "text"), bench.where("item_id = 53"), 5).collect()
    assert [x["doc_id"] for x in sorted(named, key=lambda x: x["rank"])] == ["d3", "d300", "d301", "d302", "d303"]
    assert search.search(frame.limit(0), bench).count() == 0 and search.search(frame, bench.limit(0)).count() == 0


def test_search_of_very_long_texts(spark):
    docs = spark.createDataFrame([(1, "a b c " * 200_000), (2, "a z"), (3, "q")], "doc_id bigint, text string")
    got = search.search(docs, spark.createDataFrame([(1, "a " * 100_000 + "z")], "item_id int, text string"))
    assert [tuple(r)[:3] for r in got.orderBy("rank").collect()] == [(1, 1, 2), (1, 2, 1)]
