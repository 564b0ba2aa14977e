import public_tokenizers
from tokenizers import Tokenizer

from terrasample.llm.token_counts import Counter, count_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "  x  \n\n y's I'LL \x1c\x85 ½ ²x १२ z", "日本語 text 🙂🙂 नमस्ते", "\x00\x01", "a b", "ſ's 'S", "1234567890" * 5, "x" * 3000, "\x1d\x1e a", "é" * 50, None]


def test_counts_as_the_library(spark):
    library = Tokenizer.from_file(PATH)
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)] + [(0, "", 9)], "doc_id long, text string, n_tokens int")
    rows = count_tokens(df, PATH).collect()
    assert [r.n_tokens for r in rows[:-1]] == [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert [r.n_bytes for r in rows[:-1]] == [len((t or "").encode()) for t in texts]
    assert all(r.over_limit == (r.n_tokens > 512) for r in rows) and len(rows) == len(texts) + 1
    assert count_tokens(df.limit(0), PATH).count() == 0


def test_proof_and_memory(monkeypatch):
    from terrasample.llm import token_counts

    text = open(PATH, encoding="utf-8").read()
    counter = Counter(text)
    proven = counter.prove()
    assert len(proven) > 45_000 and " the" in proven and all(counter.merged(counter.spelled(p)) == 1 for p in list(proven)[:200])
    monkeypatch.setattr(token_counts, "MEMORY", 3)
    small = Counter(text, proven)
    want = Tokenizer.from_file(PATH)
    for t in ("qzxv wvutq zzzzq hjkl asdfq qwrty", "qzxv wvutq"):
        assert small(t) == len(want.encode(t).ids)
