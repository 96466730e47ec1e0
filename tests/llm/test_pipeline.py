import corpus_pipeline
from axonlake.llm import decontaminate, langid, simhash

from . import data
from .test_dedup import brute_components, plain_fingerprint


def test_stages_against_brute_force(spark, tmp_path):
    leak = data.prose("en", 30, 777)
    twice = data.prose("en", 40, 55)
    extra = [(700, data.prose("de", 50, 1) + " " + leak, "de"), (701, data.prose("de", 50, 2), "de"), (701, data.prose("de", 50, 3) + " " + leak, "de"), (None, leak, "en"), (None, twice, "en"), (None, twice, "en"), (702, twice, "en"), (702, twice + " x", "en")]
    docs = data.documents(spark, extra)  # ids that repeat with other texts, null ids, repeated rows
    key = lambda i: (i is None, i or 0)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in now.select("doc_id", "text").collect()]
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        now, last = spark.read.parquet(f"{tmp_path}/{name}"), now
        after = [(r.doc_id, r["text"] if "text" in now.columns else None) for r in now.collect()]
        if name != "bpe":
            assert now.columns == last.columns
        if name == "language_id":
            model = langid.train_language_model(spark.read.parquet(f"{tmp_path}/documents.parquet").filter(langid.learning_rows()))
            assert sorted(after, key=str) == sorted(((i, t) for i, t in before if not model.judge(t)[2]), key=str)
            kept = {t for _, t in after}
            assert not any(t is None or not any(c.isalpha() for c in t) for t in kept)
            assert all(t in kept for i, t in before if t and any(c.isalpha() for c in t) and i not in (104, 121)), "plain text goes"
        elif name == "exact_dedup":
            best = {}
            for i, t in before:
                best[t] = max([best.get(t, -1), -1 if i is None else i])
            assert sorted(after, key=str) == sorted(((None if i < 0 else i, t) for t, i in best.items()), key=str)
        elif name == "simhash_neardup":
            label = brute_components({plain_fingerprint(t) for _, t in before})
            groups = {}
            for i, t in before:
                groups.setdefault(label[plain_fingerprint(t)], []).append((i, t))
            assert len(after) == len(groups)
            for i, t in after:
                group = groups.pop(label[plain_fingerprint(t)])
                assert (i, t) in group and key(i) == min(key(j) for j, _ in group)
        elif name == "decontaminate":
            wanted = decontaminate.shingle_set(decontaminate.words_of(leak), 5)
            share = lambda t: len(wanted & decontaminate.shingle_set(decontaminate.words_of(t), 5)) / len(wanted)
            assert sorted(after, key=str) == sorted(((i, t) for i, t in before if share(t) < 0.8), key=str) and 700 not in dict(after) and 701 in dict(after)
        else:
            assert len(after) == len(before)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(after)
    assert simhash.BLOCKS == 8


def test_repeated_rows_in_every_stage(spark, tmp_path):
    """Each stage is given rows that repeat id and text, which an earlier stage would have removed."""
    text = data.prose("en", 50, 5)
    docs = data.documents(spark, [(900, text, "en")] * 3 + [(None, text + " y", "en")] * 2)
    spark.createDataFrame([(1, data.prose("en", 30, 777))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.near_copies(spark, docs, str(tmp_path))
    assert [r.doc_id for r in out.filter(out.text.startswith(text)).collect()] == [900]
    assert corpus_pipeline.benchmark_leaks(spark, docs, str(tmp_path)).filter("doc_id = 900").count() == 3


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    data.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
