"""The five stages on a small corpus, each against a plain version on the same rows."""

import random

import corpus_pipeline
from test_decontam import plain_infix

from quernel.llm import decontam, packing, quality, simhash, toxicity


def make(tmp_path, spark):
    rnd = random.Random(12)
    vocabulary = [a + b for a in ("lo", "re", "mi", "psu", "do", "la", "sit", "am") for b in ("ra", "mon", "tel", "dus", "net", "fi")]
    say = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(20))) for i in range(5)]
    rows, labels = [], []
    for i in range(600):
        words = say(rnd.randint(40, 120))
        toxic, poor = i % 6 == 0, i % 7 == 0
        if i % 13 == 0:
            words[5:5] = items[i % 5][1].split()
        if i % 11 == 0 and i:
            words = rows[i - 5][1].split()
            if i % 2 and len(words) > 60:
                words[30] = "edited"
        if toxic:
            for _ in range(4):
                words.insert(rnd.randrange(len(words)), "schurke")
        rows.append((i, " ".join(w.upper() + "!!" if poor else w for w in words), "en", f"s{i % 3 % 2}", 400))
        if i % 5:
            labels.append((i, int(not poor), int("schurke" in rows[-1][1].lower())))
    rows += [(700, None, None, None, None), (701, "", "en", "s0", 0), (702, "", "en", "s0", 0), (None, "no id here", "en", "s1", 10)]
    d = str(tmp_path)
    clashes = {"quality_score": "0.1", "p_text": "'x'", "__toxicity": "1", "kept_id": "7", "SAME": "'y'", "id": "1", "fp": "2", "component_id": "3", "key": "'k'", "label": "0", "toxic": "1"}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.selectExpr("*", *[f"{v} AS `{c}`" for c, v in clashes.items()]).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, tmp_path):
    d = make(tmp_path, spark)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels, bench = spark.read.parquet(f"{d}/labels.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    columns = docs.columns
    ids = lambda df: sorted(r.doc_id if r.doc_id is not None else -1 for r in df.select("doc_id").collect())
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id if r.doc_id is not None else -1: r for r in docs.collect()}
        out = step(spark, docs, d)
        if name != "packing":
            assert out.columns == columns
            out.write.parquet(f"{d}/{k}")
            out = spark.read.parquet(f"{d}/{k}")
            kept = ids(out)
        if name == "toxicity":
            model = toxicity.fit_model(docs, labels)
            assert kept == sorted(i for i, r in before.items() if model.head.probability([model.features(r.text)])[0] < 0.5)
            assert not any("schurke" in (r.text or "").lower() for r in out.collect())
        elif name == "quality":
            model = quality.fit_model(docs, labels)
            import numpy as np

            p = lambda r: model.probabilities(np.array([quality.text_view(r.text)]), np.array([quality.page_view(r.text, r.n_chars, r.lang, r.source)]))[2][0]
            assert kept == sorted(i for i, r in before.items() if p(r) >= 0.5)
            assert not any("!!" in (r.text or "") for r in out.collect())
        elif name == "simhash":
            group = {i: i for i in before}
            for a in sorted(before):
                for b in sorted(before):
                    if a < b and simhash.shingle_jaccard(before[a].text, before[b].text, 5) >= 0.8:
                        x, y = group[a], group[b]
                        group = {k: min(x, y) if v in (x, y) else v for k, v in group.items()}
            assert kept == sorted(set(group.values()))
        elif name == "decontamination":
            items = [decontam.words_of(r.text) for r in bench.collect()]
            holds = lambda w: any(plain_infix(item, w) <= int(0.2 * len(item) + 1e-9) for item in items)
            assert kept == sorted(i for i, r in before.items() if not holds(decontam.words_of(r.text)))
            assert len(kept) < len(before)
        else:
            got = out.collect()
            size = {i: len((r.text or "").split()) for i, r in before.items()}
            packed = {}
            for r in got:
                packed[r.doc_id if r.doc_id is not None else -1] = packed.get(r.doc_id if r.doc_id is not None else -1, 0) + r.size
            assert packed == size
            assert len({(r.group, r.bin, r.source) for r in got if r.source is not None}) == sum(r.source is not None for r in got)
        docs = out
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


def test_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
