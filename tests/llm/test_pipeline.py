import public_tokenizers
import sentencepiece

import corpus_pipeline
from cuewright.llm import decontaminate, secrets, toxicity
from tests_llm_brute import near_kept


def test_stages_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    bench = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    model = toxicity.train(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if scores[r.doc_id] < 0.3}
    texts = {d: texts[d] for d in near_kept(texts, 80)}
    items = next(decontaminate.item_blocks(spark.read.parquet(f"{small}/benchmark.parquet")))
    assert len(items.ids) == len(bench)
    bad = {r.doc_id for r in decontaminate.contaminated(docs, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert bad >= {r.doc_id for r in docs.collect() if any(b in r.text for b in bench)}
    net = secrets.trained()
    texts = {d: secrets.redact(t, secrets.all_spans(t, net)) for d, t in texts.items() if d not in bad}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = {d: len(library.encode(t)) for d, t in texts.items()}
    rows = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == expected and len(rows) == len(expected) and all(r.round_trip for r in rows)


def test_stages_keep_the_columns(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for part in (docs, docs.limit(0)):
            out = stage(spark, part, "/root/testdata/sf0.001")
            assert i == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
            assert out.count() <= part.count()


def test_masks_leave_clean_texts_alone(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    out = corpus_pipeline.mask_secrets(spark, docs, "/root/testdata/sf0.001")
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
