import random

from tests.llm import brute
from tests.llm.test_documents import near_texts

import corpus_pipeline
from cohortica.llm import decontaminate, jaccard, langid


def documents(spark):
    r = random.Random(8)
    rows = [(d, t if t is None else t + " " + " ".join(f"u{d}x{r.randrange(9)}" for _ in range(30)), r.choice(["en", "de"]), "src%d" % r.randrange(4), 0) for d, t in near_texts(6)[:-1]]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), rows


def test_stages_keep_the_columns(spark, tmp_path):
    docs, rows = documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    item = " ".join(rows[9][1].split()[-14:])
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, str(tmp_path))
        assert after.schema.names == docs.schema.names
        assert {r[0] for r in after.select("doc_id").collect()} <= {r[0] for r in now.select("doc_id").collect()}
        now = after
    ids = {r[0] for r in now.select("doc_id").collect()}
    assert ids and 9 not in ids
    bins = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({d for b in bins for d in b["doc_ids"]}) == sorted(ids)


def test_stages_against_brute_force(spark):
    docs, rows = documents(spark)
    texts = [(r[0], r[1]) for r in rows]
    near = {}
    for (d, t), (_, n, c) in zip(texts, brute.near(texts, 5, 80)):
        near.setdefault(c if n else (d, t), []).append((d, t))
    got = sorted(r[0] for r in jaccard.distinct_documents(docs).select("doc_id").collect())
    assert got == sorted(min(d for d, _ in g) for g in near.values())
    items = [(1, " ".join(rows[9][1].split()[-14:]))]
    hit = {d for d, _, _, _, _, bad in brute.contaminated(texts, items) if bad}
    kept = decontaminate.clean(docs, spark.createDataFrame(items, "item_id bigint, text string"))
    assert {r[0] for r in kept.select("doc_id").collect()} == {d for d, _ in texts} - hit
    model = langid.fit(docs)
    said = langid.identify(docs, model).where("not rejected").count()
    assert langid.identified(docs, model).count() == said


def test_stages_on_empty_tables_nulls_and_clashing_columns(spark, tmp_path):
    spark.createDataFrame([(1, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    more = "k string, _k string, S string, gone string, rest string, id bigint, b string, cluster string"
    schema = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {more}"
    own = ("1", "2", "3", "4", "5", 6, "7", "8")
    words = lambda i: " ".join(f"{w}{j}" for j, w in enumerate(["alpha", "beta", "gamma", "delta"] * 8 if i % 2 else ["eins", "zwei", "drei"] * 9))
    rows = [(i, words(i) + f" end {i}", "en" if i % 2 else "de", None, None, *own) for i in range(40)]
    rows += [(None, "alpha beta gamma delta alpha", None, "s", 3, *own), (None, None, None, None, None, *own), (41, "", "en", "s", 0, *own), (42, " ", None, None, None, *own), (1, rows[1][1], "en", None, None, *own), rows[0]]
    for data in (rows, []):
        now = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = corpus_pipeline.save(stage(spark, now, str(tmp_path)), name)
            assert now.schema.names == [f.split()[0] for f in schema.split(", ")]
            assert {tuple(r)[5:] for r in now.collect()} <= {own}
        bins = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
        assert sorted(str(d) for b in bins.collect() for d in b["doc_ids"]) == sorted(str(r["doc_id"]) for r in now.collect())
