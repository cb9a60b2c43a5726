import random
from collections import Counter

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def corpus():
    rng = random.Random(5)
    common = [f"w{i}" for i in range(700)]
    text = lambda k: " ".join(rng.choices(common, k=k))
    items = [(i, " ".join(f"rare{rng.randint(0, 400)}" for _ in range(25))) for i in range(10)]
    docs, labels = [], []
    for i in range(500):
        t, toxic = text(rng.randint(20, 120)), i % 5 == 0
        if toxic:
            t += " you Idiot, moron and lout; " + text(5)
        docs.append((i, t, "en", f"src{i % 4}" if i % 9 else None, len(t), {"a": i}))
        if i < 400:
            labels.append((i, 1, int(toxic)))
    leaks = [(600 + i, f"{text(15)} {t} {text(15)}") for i, t in items]
    copies = [(700 + i, docs[i * 5 + 1][1]) for i in range(20)]
    mails = [(800 + i, f"{text(30)} write to joe{i}@mail.example.com now") for i in range(20)]
    odd = [(900, None), (901, ""), (902, " "), (None, text(30)), (903, "x"), (903, "y z"), (903, "y z")]
    docs += [(i, t, "en", "src1", None if t is None else len(t), None) for i, t in leaks + copies + mails + odd]
    return docs, labels, items


def test_run(spark, tmp_path):
    docs, labels, items = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, size map<string,int>").repartition(3)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        assert k == len(pipeline.STAGES) - 1 or out.schema == now.schema
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept[name] = Counter(r["doc_id"] for r in now.collect())
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "mixing"]
    everything = Counter(r[0] for r in docs)
    toxic = set(range(0, 500, 5))
    assert len(toxic & set(kept["toxicity"])) <= 5 and len(everything - kept["toxicity"] - Counter(toxic)) <= 8
    gone = kept["toxicity"] - kept["near_duplicates"]
    assert set(gone) == {700 + i for i in range(20)} | {901, 902, 903} and kept["near_duplicates"][903] == 2
    gone = kept["near_duplicates"] - kept["decontamination"]
    assert set(gone) == {600 + i for i in range(10)}
    assert kept["personal_data"] == kept["decontamination"] == kept["mixing"]
    rows = now.collect()
    assert not any("@" in (r["text"] or "") for r in rows) and sum("[EMAIL]" in (r["text"] or "") for r in rows) == 20
    assert all(r["taken"] <= 3 * r["size"] and r["size"] == len((r["text"] or "").split()) for r in rows)
    assert 0 < sum(r["taken"] for r in rows) <= sum(r["size"] for r in rows)


def test_no_documents(spark, tmp_path):
    docs, labels, items = corpus()
    df = spark.createDataFrame(docs[:1], "doc_id long, text string, lang string, source string, n_chars long, size map<string,int>").drop("size").limit(0)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).collect() == []
