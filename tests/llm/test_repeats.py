import random

import numpy as np
import pytest
from tests.llm import brute

from cohortica.llm import recompress, suffixes

SCHEMA = "doc_id bigint, text string, source string, k bigint, s string"


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "x", 1, "y") for d, t in docs], SCHEMA)


def texts(seed=3, vocabulary=400):
    """Texts with shared passages, self-repeats, periodic stretches, copies, nulls, blanks and a long one."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    pool = [word() for _ in range(vocabulary)]
    run = lambda n: [r.choice(pool) for _ in range(n)]
    shared = [run(n) for n in (34, 35, 36, 60, 120)]
    docs = []
    for i in range(60):
        w = run(r.randint(0, 150))
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(w))
            p = r.choice(shared)
            w[at:at] = p
        docs.append((i, r.choice([" ", "\n", "\t"]).join(w)))
    w = run(80)
    docs += [(60, " ".join(w + w)), (61, " ".join(["x"] * 90)), (62, " ".join(["x"] * 50 + ["y"])), (63, "ab cd " * 60), (64, "cd ab " * 60)]
    docs += [(65, None), (66, ""), (67, " \n "), (68, "z"), (69, docs[3][1]), (70, docs[3][1]), (70, docs[3][1]), (71, " ".join(run(6000)))]
    docs += [(72, "$" * 900), (73, "q" + "$" * 450), (74, "é" * 399), (75, "ab" * 260 + "c")]
    return docs


def test_words(spark):
    docs = texts()
    got = recompress.dedup_words(frame(spark, docs)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(brute.words_removed(docs))


def test_bytes(spark):
    docs = texts(5)
    got = suffixes.dedup_bytes(frame(spark, docs)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(brute.bytes_removed(docs))


@pytest.mark.parametrize("seed", range(4))
def test_equal_windows_have_equal_anchors(seed):
    r = np.random.default_rng(seed)
    h = r.integers(0, 3 + 5 * seed, 3000).astype(np.uint64)
    row = np.repeat([0, 1, 2], 1000)
    at, name, place = recompress.anchors(h, row, 12)
    first = {}
    for a, n in zip(at, name):
        key = tuple(h[a : a + 12])
        assert first.setdefault(key, n) == n


def test_empty(spark):
    none = frame(spark, [])
    assert recompress.dedup_words(none).count() == 0
    assert suffixes.dedup_bytes(none).count() == 0


def test_width_that_does_not_fit(spark):
    for f in (recompress.dedup_words, suffixes.dedup_bytes):
        with pytest.raises(ValueError):
            f(frame(spark, [(1, "a")]), width=1024)
