"""The pipeline's stages on a small table, against what each must keep."""

import zlib
from collections import Counter

import corpus_pipeline
from pagemill.llm import tokens

WORDS = {"en": "the river and that house with this weather was here ", "fr": "la maison dans le jardin avec des fleurs pour une femme ", "de": "das haus und der garten sind nicht so gross wie die strasse "}


def test_stages(spark, tmp_path):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    rows = [(i, " ".join(f"{w}{i}" if k % 4 == 0 else w for k, w in enumerate((WORDS[("en", "fr", "de")[i % 3]] * 4).split())), ("en", "fr", "de")[i % 3], f"s{i % 2}", 1) for i in range(60)]
    rows += [(100, rows[3][1], "en", "s0", 1), (101, rows[4][1] + " more", "fr", "s1", 1), (102, item, "en", "s0", 1), (103, None, "en", "s0", 1), (104, "", None, None, None), (105, "1 2 3", "en", "s0", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        kept[name] = Counter(r.doc_id for r in docs.collect())
    everyone = dict.fromkeys(range(60), 1)
    assert kept["language ID"] == everyone | {100: 1, 101: 1, 102: 1} and kept["n-gram Jaccard join"] == everyone | {102: 1} and kept["benchmark decontamination"] == everyone
    assert set(kept["mixing"]) <= set(everyone) and all(n <= 2 for n in kept["mixing"].values())
    encoder = tokens.Encoder(tokens.default_tokenizer())
    text, start = {r[0]: r[1] for r in rows}, 0
    for r in docs.orderBy("start").collect():
        data = encoder.encode([text[r.doc_id]])[0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(data) // 4, zlib.crc32(data))
        start += r.n_tokens
    once = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert once == sorted(tuple(r) for r in docs.collect())
