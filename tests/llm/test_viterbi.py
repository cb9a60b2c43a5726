import random

from tokenizers import Tokenizer, models, pre_tokenizers

from strandloom.llm.viterbi import Counter, load_pieces, token_counts


def oracle(pieces, byte_fallback=True):
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace()])
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    odd = [(9001, None, "x"), (9002, "", "x"), (9003, " \t\n  ", "x"), (9004, "日本語 ☃☃☃x naïve", "x"), (9005, "ab " * 20000 + "c" * 3000, "x"), (9006, "a\x1cb\x85c", "x"), (None, "hello", "x"), (9007, "hello", "x"), (9007, "hello", "x")]
    df = docs.selectExpr("doc_id", "text", "'x' AS n_tokens").union(spark.createDataFrame(odd, "doc_id long, text string, n_tokens string"))
    want = oracle(load_pieces())
    rows = df.collect()
    got = token_counts(df).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got) == sorted((r["doc_id"] or -1, want(r["text"] or "")) for r in rows)
    assert token_counts(df.limit(0)).collect() == []


def test_ties():
    rng = random.Random(5)
    for trial in range(150):
        pieces = {"".join(rng.choices("ab▁é", k=rng.randint(1, 4))): float(-rng.randint(1, 4)) for _ in range(rng.randint(1, 14))}
        listed = [("<unk>", 0.0), *pieces.items()]
        mine, want = Counter(listed), oracle(listed, False)
        for _ in range(20):
            text = "".join(rng.choices("abé", k=rng.randint(1, 12)))
            assert mine.count(text)[0] == want(text), (listed, text)
