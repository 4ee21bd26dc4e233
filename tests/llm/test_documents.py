import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tests.llm import brute
from tests.llm.test_repeats import frame, texts

from cohortica.llm import _components, _text, chat, decontaminate, jaccard, langid, lines, packing, quality, tokens


def near_texts(seed=1):
    """Groups of near copies by chains of edits, among unrelated texts."""
    r = random.Random(seed)
    pool = [f"w{i}" for i in range(300)]
    docs = []
    for g in range(12):
        base = [r.choice(pool) for _ in range(r.choice([4, 12, 60, 200]))]
        for _ in range(r.choice([1, 2, 8, 30])):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
                w[r.randrange(len(w))] = r.choice(pool + [f"n{r.random()}"])
            if r.random() < 0.3:
                base = w
            docs.append((len(docs), " ".join(w)))
    n = len(docs)
    return docs + [(n, None), (n + 1, ""), (n + 2, "one"), (n + 3, "ONE"), (n + 4, "one two"), (n + 5, " \n"), (n + 6, docs[5][1].upper()), (n + 6, docs[5][1])]


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_near_copies(spark, k, percent):
    docs = near_texts(k)
    got = jaccard.near_copies(frame(spark, docs), k, percent, part=0.3).collect()
    assert sorted(map(tuple, got)) == sorted(brute.near(docs, k, percent))


def test_contamination(spark):
    docs = texts(7)
    items = [(1, " ".join(docs[4][1].split()[:40])), (2, "x x x"), (10, "ab cd " * 12), (11, None), (12, " - "), (2, "x x x"), (13, (docs[71][1] or "")[300:800]), (14, "é" * 20)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contamination(frame(spark, docs), bench).collect()
    assert sorted(map(tuple, got)) == sorted(brute.contaminated(docs, items))
    assert decontaminate.contamination(frame(spark, docs[:3]), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(frame(spark, []), bench).count() == 0


def test_quality(spark):
    docs = texts(9) + [(200, "a b\nc d\na b\n\n\n x|y #\r\n"), (201, "a\x0bb  é")]
    got = quality.quality(frame(spark, docs)).collect()
    assert sorted(tuple(r)[:7] for r in got) == sorted(brute.base_counts(docs))
    assert all(not (r["kept"] and r["base_failed"]) for r in got)
    orders = [list(quality.RULES), list(reversed(quality.RULES))]
    a, b = ({(r["doc_id"], r["kept"]) for r in quality.quality(frame(spark, docs), o).collect()} for o in orders)
    assert a == b
    plan = quality.plan_rules(frame(spark, docs))
    assert quality.expected_cost(plan) <= quality.expected_cost(plan[::-1]) + 1e-12
    assert quality.quality(frame(spark, [])).count() == 0


def test_language(spark):
    r = random.Random(2)
    langs = {"aa": ["the", "of", "and", "thing"], "bb": ["der", "und", "nicht", "schön"]}
    rows = [(i, " ".join(r.choice(langs[g]) for _ in range(30)), g) for i in range(400) for g in [r.choice("ab") * 2]]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !", "bb"), (1005, "½ ² ①", "aa"), (1003, "the " * 9000, None), (None, "the of and", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = langid.identify(docs, langid.fit(docs)).collect()
    assert len(got) == len(rows)
    truth = {d: g for d, _, g in rows}
    held = [x for x in got if x["held_out"] and x["doc_id"] < 1000]
    assert held and sum(x["lang_pred"] == truth[x["doc_id"]] for x in held) >= 0.98 * len(held)
    assert {x["lang_pred"] for x in got if x["doc_id"] in (1000, 1001, 1002, 1005)} == {"und"}
    assert all(0 <= x["score"] <= 1 for x in got)
    assert not any(x["rejected"] for x in got if x["doc_id"] and x["doc_id"] < 1000)
    strange = spark.createDataFrame([(i, " ".join(r.choice(["zzqx", "wkvj", "qqpf"]) for _ in range(30))) for i in range(20)], "doc_id bigint, text string")
    assert langid.identify(strange, langid.fit(docs)).where("rejected").count() >= 10  # of no language that was learnt
    none = langid.fit(docs.limit(0))
    assert langid.identify(docs, none).where("lang_pred <> 'und'").count() == 0


def test_packing(spark):
    r = random.Random(4)
    rows = [(i, " ".join(["w%d" % r.randrange(9)] * r.choice([0, 1, 5, 30, 99, 100, 101, 250])), r.choice(["a", "a", "b", None])) for i in range(300)]
    rows += [(300, None, "a"), (301, "same text here", "c"), (302, "same text here", "d"), (302, "same text here", "d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    bins = packing.pack(docs, capacity=100, block_rows=64).collect()
    pieces = sorted((d, s, n) for b in bins for d, s, n in zip(b["doc_ids"], b["starts"], b["lengths"]))
    want = []
    for d, t, _ in rows:
        n = len((t or "").split())
        want += [(d, a, 100) for a in range(0, n - 99, 100)] + ([(d, n - n % 100, n % 100)] if n % 100 or not n else [])
    assert pieces == sorted(want)
    source = {d: s for d, _, s in rows}
    for b in bins:
        assert b["used"] == sum(b["lengths"]) <= 100
        own = [source[d] for d in b["doc_ids"] if source[d] is not None]
        assert len(own) == len(set(own))
        assert len({301, 302} & set(b["doc_ids"])) < 2
    assert len({b["bin_id"] for b in bins}) == len(bins)
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_is_of_the_documents_not_of_the_files(spark):
    # source by source, in order: blocks of neighbouring rows hold one source each
    rows = [(i, f"t{i} " + "w " * 39, f"s{i // 200}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    ways = [docs.repartition(1).sortWithinPartitions("doc_id"), docs.repartition(40, "doc_id")]
    got = [sorted(sorted(b["doc_ids"]) for b in packing.pack(d, capacity=100, block_rows=100).collect()) for d in ways]
    assert got[0] == got[1]
    assert sorted(x for b in got[0] for x in b) == list(range(800))
    assert len(got[0]) < 480  # 400 at best, 800 when each source stays alone


def test_packing_keeps_near_copies_apart(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:-1], f"last{i}"]), f"s{i}") for i in range(4)] + [(9, None, "s0"), (10, "other words", "s9")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for bins in (packing.pack(jaccard.with_clusters(docs, k=3, percent=90), cluster="cluster").collect(), packing.pack(docs, clusters=jaccard.memberships(docs, k=3, percent=90)).collect()):
        assert sorted(d for b in bins for d in b["doc_ids"]) == [0, 1, 2, 3, 9, 10]
        assert all(len({0, 1, 2, 3} & set(b["doc_ids"])) < 2 for b in bins)


def test_best_fit_by_brute_force(spark):
    r = random.Random(9)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(r.choice([3, 20, 35, 50, 65, 97]))), f"s{r.randrange(6)}") for i in range(60)]
    source, size = {i: s for i, _, s in rows}, {i: len(t.split()) for i, t, _ in rows}
    bins = [set(b["doc_ids"]) for b in packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), capacity=100).collect()]
    # every item in turn, longest first, goes to the fullest bin that takes it: all bins are looked at
    best, free = [], lambda b: 100 - sum(size[x] for x in b)
    order = [b for b in packing.pack_block([(size[i], 1 << int(source[i][1:]), 1 << (9 + i), i) for i in size], 100)]
    for i in sorted(size, key=lambda i: (-size[i], i)):
        fits = [b for b in best if free(b) >= size[i] and source[i] not in {source[x] for x in b}]
        if fits:
            min(fits, key=lambda b: (free(b), best.index(b))).add(i)
        else:
            best.append({i})
    assert sorted(map(sorted, order)) == sorted(map(sorted, best))
    assert len(bins) == len(best) and sorted(x for b in bins for x in b) == sorted(size)  # one block: as few as all bins looked at


def test_best_fit_takes_the_tightest_compatible_bin():
    # lengths 7 and 6 open bins with 3 and 4 left; 3 of the first's source goes to the second
    bins = packing.pack_block([(7, 1, 0, 0), (6, 2, 0, 1), (3, 1, 0, 2)], 10)
    assert bins == [[0], [1, 2]]


def test_feistel_is_a_permutation():
    import numpy as np

    for n in (1, 2, 3, 64, 1000):
        assert sorted(tokens.feistel(np.arange(n), n, 5)) == list(range(n))


def test_training_order(spark, tmp_path):
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    docs = texts(11)[:75] + [(90, "a  b"), (91, " x "), (92, "a \n\n b\n c  \n")]
    made = tokens.shards(tokens.training_order(tokens.sequences(frame(spark, docs), path, 32)), 32, 16)
    made.where("shard % 3 = 1").write.parquet(str(tmp_path / "s"))  # as left by a run that was broken off
    tokens.write_shards(made, str(tmp_path / "s"))
    rows = spark.read.parquet(str(tmp_path / "s")).orderBy("shard").collect()
    assert [r["first_slot"] for r in rows] == [16 * i for i in range(len(rows))]
    total = sum(r["n_slots"] for r in rows)
    assert all(len(r["payload"]) == r["n_slots"] * r["stride"] for r in rows)
    import numpy as np

    bpe = tokens.encoder(path).bpe
    seen = {}
    for r in tokens.read_slots(spark, str(tmp_path / "s"), 0, total, 16).collect():
        seen.setdefault(r["doc_id"], {}).setdefault(r["chunk"], []).append(np.frombuffer(r["tokens"], "<u2")[: r["n_tokens"]])
    for d, t in docs:
        if d != 70:
            ids = np.concatenate([seen[d][c][0] for c in sorted(seen[d])])
            assert ids.tolist() == bpe.encode_ordinary(t or "") + [tokens.END]
    part = tokens.read_slots(spark, str(tmp_path / "s"), 5, 20, 16).collect()
    assert [r["slot"] for r in part] == list(range(5, 25))


def test_lines(spark):
    long = " ".join(f"word{i}" for i in range(120))
    docs = [(1, f"{long}\nunique one here\n\nshared line"), (2, f"Shared   LINE!\n{long.replace('word60', 'word6O')}\nmine alone"), (3, None), (4, ""), (5, "\n\n--"), (6, "shared line"), (6, "shared line"), (7, "twice\ntwice\nonce")]
    got = {(r["doc_id"], tuple(r["removed"]), r["n_lines"]) for r in lines.line_report(frame(spark, docs)).collect()}
    assert {(1, (), 4), (3, (), 0), (4, (), 0), (5, (), 3), (6, (0,), 1), (7, (1,), 3)} <= got
    two = next(x for x in got if x[0] == 2)
    assert 0 in two[1] and 2 not in two[1]
    out = {r["doc_id"]: r["text"] for r in lines.dedup_lines(frame(spark, docs)).collect()}
    assert out[7] == "twice\nonce" and 6 not in out and out[3] is None and out[5] == "\n\n--"
    assert lines.dedup_lines(frame(spark, [])).count() == 0


def line_groups(texts, percent=90):
    """Smallest number of each line's group by edit distance alone, and the pairs that are linked."""

    def linked(a, b):
        most = max(len(a), len(b)) * (100 - percent) // 100
        if abs(len(a) - len(b)) > most:
            return False
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
            if min(row) > most:
                return False
        return row[-1] <= most

    root = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j in range(i):
            if root[i] != root[j] and linked(a, texts[j]):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if x == hi else x for x in root]
    return root


def edited_lines(seed, lengths):
    """For each number of words a line and copies of it with up to a tenth of the characters changed, by words."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 8)))
    rows = []
    for n in lengths:
        base = [word() for _ in range(n)]
        rows.append(" ".join(base))
        for _ in range(6):
            w, room = list(base), len(" ".join(base)) // 10
            while room >= 8:
                w[r.randrange(n)] = word()
                room -= 8
                if r.random() < 0.3:
                    break
            rows.append(" ".join(w))
    return rows


@pytest.mark.parametrize("rare", [64, 2])
def test_lines_against_edit_distance_alone(spark, monkeypatch, rare):
    monkeypatch.setattr(lines, "RARE", rare)
    monkeypatch.setattr(lines, "PIVOTS", rare)
    for lengths, least in (([20] * 12, 0.9), ([60] * 4 + [150] * 2, 0.95)):
        texts = edited_lines(5, lengths)
        root = line_groups(texts)
        want = {i for i in range(len(texts)) if root[i] != i}
        got = {x["doc_id"] for x in lines.line_report(frame(spark, list(enumerate(texts)))).where("n_removed > 0").collect()}
        assert got <= want  # what goes has a near copy that stays
        assert len(got) >= least * len(want)


@pytest.mark.parametrize("rare, percent", [(64, 90), (2, 90), (64, 80)])
def test_short_lines_lose_no_link(spark, monkeypatch, rare, percent):
    monkeypatch.setattr(lines, "RARE", rare)
    monkeypatch.setattr(lines, "PIVOTS", rare)
    monkeypatch.setattr(_components, "FEW_ROWS", 0)
    r = random.Random(9)
    texts = ["a" * n for n in (8, 9, 10, 11, 12, 40, 44)] + ["b" * 59, "b" * 30 + "xxxxx" + "b" * 29]
    for n in range(1, lines.SHORT, 2):
        base = "".join(r.choice("abcd ") for _ in range(n))
        texts.append(base)
        for _ in range(5):  # edits all over the line, one after the other
            t = base
            for _ in range(r.randint(0, max(1, n * (100 - percent) // 100))):
                i = r.randrange(len(t) + 1)
                t = r.choice([t[:i] + "x" + t[i:], t[:i] + t[i + 1 :], t[:i] + "y" + t[i + 1 :]])
            texts.append(t)
    texts = [t for t in (" ".join(t.split()) for t in texts) if t and (len(t) < (lines.SHORT if percent == 90 else 40) or "bbbb" in t)]
    root = line_groups(texts, percent)
    got = {x["doc_id"] for x in lines.line_report(frame(spark, list(enumerate(texts))), percent).where("n_removed > 0").collect()}
    assert got == {i for i in range(len(texts)) if root[i] != i}


def test_what_lies_between_like_words(spark):
    r = random.Random(6)
    some = lambda: " ".join(r.choice(["a", "b", "ab", "é"]) for _ in range(r.randint(1, 5)))
    both = spark.createDataFrame([(i, some(), some()) for i in range(300)] + [(300, "a", "a"), (301, "a b", "a b c"), (302, "a b b c", "a b c")], "i int, x string, y string")
    got = lines.unlike(both).selectExpr("i", "levenshtein(x, y) d").join(both, "i")
    assert got.where("d <> levenshtein(x, y)").count() == 0 and got.count() == 303


def test_lines_of_odd_shapes(spark):
    word = "w" * 50_000
    texts = [word, word[:-9], "a " * 3000, "a " * 2990, "\x0b", "é", "É!", None, "b" * 11, "b" * 12]
    got = {x["doc_id"] for x in lines.line_report(frame(spark, list(enumerate(texts)))).where("n_removed > 0").collect()}
    assert {6} <= got <= {1, 3, 6, 9}
    clash = spark.createDataFrame([(1, "one line here\none line here", "x", "y", "z")], "doc_id bigint, text string, K string, gone string, rest string")
    assert [tuple(r) for r in lines.dedup_lines(clash).collect()] == [(1, "one line here", "x", "y", "z")]


def test_near_copies_of_frequent_tokens(spark, monkeypatch):
    monkeypatch.setattr(_components, "RARE", 2)
    monkeypatch.setattr(_components, "PIVOTS", 2)
    monkeypatch.setattr(_components, "BLOCK", 8)
    docs = near_texts(4)[:70]
    got = jaccard.near_copies(frame(spark, docs), 3, 90, part=0.3).collect()
    assert sorted(map(tuple, got)) == sorted(brute.near(docs, 3, 90))


def test_preferences(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "a"), (0, 2, "user", "x"), (1, 0, "user", "hi"), (1, 1, "assistant", "b"), (2, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, None, None), (5, 0, "assistant", "é"), (6, 0, "user", "alone"), (None, 0, "user", "z"), (0, 0, "user", "hi"), (7, None, "user", "q")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = {r["pair_id"]: r for r in chat.preferences(chat.neighbours(turns), turns).collect()}
    assert set(out) == {0, 1, 2}
    a = out[0]
    assert a["n_prompt_turns"] == 1 and a["prompt"] == "<|im_start|>user\nhi<|im_end|>\n"
    assert a["rejected"] == "<|im_start|>assistant\nb<|im_end|>\n"
    assert [a["chosen"][s:e] for s, e in a["chosen_mask"]] == ["a<|im_end|>"]
    assert out[1]["n_prompt_turns"] == 1 and out[1]["chosen"] == out[1]["rejected"] == ""
    assert out[2]["prompt"] == "" and out[2]["chosen"].startswith("<|im_start|>unknown\n")
    assert [out[2]["rejected"][s:e] for s, e in out[2]["rejected_mask"]] == ["é<|im_end|>"]
    assert chat.preferences(chat.neighbours(turns.limit(0)), turns.limit(0)).count() == 0


def test_rivals(spark):
    r = random.Random(6)
    rows = []
    for c in range(40):
        roles = ["user", "assistant"] * r.randrange(1, 4) + ["user"] * r.randrange(2)
        rows += [(c, i, role, f"{role} {c} {i}" if r.random() < 0.8 else "same", "x") for i, role in enumerate(roles)]
    rows += [(50, 0, "user", "alone", "x"), (51, 0, "assistant", None, "x"), (52, 0, None, "?", "x"), (None, 0, "assistant", "a", "x"), (53, None, "assistant", "a", "x"), (3, 0, *rows[[x[0] for x in rows].index(3)][2:4], "x")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, Place string")
    got = {x["pair_id"]: x for x in chat.rivals(turns).collect()}
    talks = {}
    for c, i, role, text, _ in sorted(set(rows), key=str):
        if c is not None and i is not None:
            talks.setdefault(c, []).append((i, role or "unknown", text or ""))
    talks = {c: [t[1:] for t in sorted(v)] for c, v in talks.items()}
    last = {c: max((i for i, t in enumerate(v) if t[0] == "assistant"), default=None) for c, v in talks.items()}
    order = sorted((hashlib.md5(str(c).encode()).hexdigest(), c) for c in talks if last[c] is not None)
    assert len(got) == len(order)
    for j, (_, c) in enumerate(order):
        other = order[(j + 1) % len(order)][1]
        a, b = talks[c], talks[c][: last[c]] + [talks[other][last[other]]]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        show = lambda ts: "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for role, text in ts)
        x = got[c]
        assert (x["chosen_id"], x["rejected_id"], x["n_prompt_turns"], x["prompt"], x["chosen"], x["rejected"]) == (c, other, n, show(a[:n]), show(a[n:]), show(b[n:]))
        assert n >= last[c] and [x["rejected"][s:e] for s, e in x["rejected_mask"]] == [t + "<|im_end|>" for role, t in b[n:]]
    assert sum(x["n_prompt_turns"] > 0 for x in got.values()) >= 38
    assert chat.rivals(turns.limit(0)).count() == 0
    assert chat.rivals(turns.where("conv_id = 51")).first()["rejected_id"] == 51


def walked(x, n, key, rounds=6):
    """A plain walk of the keyed permutation, one number at a time."""

    def mixed(h):
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> shift)) * by % 2**64
        return h ^ (h >> 31)

    half = max(1, ((max(2, n) - 1).bit_length() + 1) // 2)
    while True:
        a, b = x >> half, x & ((1 << half) - 1)
        for r in range(rounds):
            a, b = b, a ^ (mixed((b + key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % 2**64) & ((1 << half) - 1))
        x = (a << half) | b
        if x < n:
            return x


def test_training_order_is_of_the_documents_not_of_the_files(spark):
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    docs = [d for d in texts(11)[:75] if d[0] is not None] + [(5, "x y"), (5, "x y"), (5, None), (5, "")]
    seen = []
    for parts in (1, 40):
        made = tokens.training_order(tokens.sequences(frame(spark, docs).repartition(parts), path, 32), 77).collect()
        n = len(made)
        assert sorted(r["slot"] for r in made) == sorted(r["seq"] for r in made) == list(range(n))
        assert all(r["slot"] == walked(r["seq"], n, 77) for r in made)
        seen.append(sorted((r["slot"], r["doc_id"], r["chunk"], bytes(r["tokens"])) for r in made))
    assert seen[0] == seen[1]
    assert tokens.shards(tokens.training_order(tokens.sequences(frame(spark, []), path, 32))).count() == 0


@pytest.mark.parametrize("stars", [2, 3])
def test_pairs_of_a_large_group_meet_once(spark, monkeypatch, stars):
    kind, made = type(spark.range(1)), []
    distinct = kind.distinct

    def counted(df):
        if df.columns == ["p", "x"]:
            made.append((df.count(), distinct(df).count()))
        return distinct(df)

    monkeypatch.setattr(kind, "distinct", counted)
    rows = spark.range(300).selectExpr("1L as b", "id", "id % 7 as r")
    label = _components.connect(rows, lambda a, b: a("r") >= 0, lambda pairs: pairs.where("p % 7 = x % 7 and p % 7 < 5"), rare=8, pivots=8, stars=stars)
    root = {r["node"]: r["root"] for r in label.collect()}
    for i in range(5):
        assert len({root[x] for x in range(i, 300, 7)}) == 1
    assert len(set(root.values())) == 5 and all(x % 7 < 5 for x in root)
    assert len(made) == stars + 1 and made[-1][1] > 0 and all(n == m for n, m in made)


def test_words_are_counted_with_the_sets(spark):
    docs = frame(spark, [(0, "A b  c d"), (1, None), (2, " \n"), (3, "one"), (4, "a B c d"), (4, "a B c d")])
    of = {(r["doc_id"], r["words"]) for r in jaccard.memberships(docs, k=3, percent=90).join(jaccard.named(docs), "k").collect()}
    assert of == {(0, 4), (3, 1), (4, 4)}
    sized = packing.sizes(docs, None, jaccard.memberships(docs, k=3, percent=90))
    assert "MapInArrow" not in sized._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["doc_id"], r["n"]) for r in sized.collect()) == [(0, 4), (1, 0), (2, 0), (3, 1), (4, 4), (4, 4)]


def test_hashes_of_runs_are_those_of_their_bytes():
    r = random.Random(1)
    words = [bytes(r.choice(b"ab\x00") for _ in range(n)) for n in list(range(1, 140)) * 6]
    at = np.cumsum([0] + [len(w) + 1 for w in words])
    c = _text.Chunk(np.frombuffer(b" ".join(words) + b" ", np.uint8), np.array([0, at[-1]]), np.array([0]))
    got: dict = {}
    for w, h in zip(words, c.hashed(at[:-1], at[1:] - 1).tolist(), strict=True):
        assert got.setdefault(w, h) == h
    assert len(set(got.values())) == len(got)
    rows = [x for x in _text.chunks(pa.array(["", "a b", None, " ", "c", "", "dd e  "]))]
    assert [x.tolist() for x in rows[0].words] == [[0, 2, 4, 5, 8], [1, 3, 5, 7, 9], [1, 1, 4, 6, 6]]
