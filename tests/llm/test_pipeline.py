import numpy as np

import corpus_pipeline
from tidemark.llm.common import table

from .fixtures import TEXTS, documents, dump
from .test_near_dup import brute
from .test_text_models import quality_brute
from .test_tokens import check_packing
from .test_toxicity import rows


def test_stages_and_run(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    labelled = rows(400)
    r = np.random.default_rng(8)
    base = " ".join(x[1] for x in labelled[1:4])
    extra = [*TEXTS, base, base, base + " and more", "spam " * 80, " ".join(r.choice([f"w{k}" for k in range(900)], 60))]
    data = [x[:5] for x in labelled] + [(5000 + k, t, "en", "s", 1) for k, t in enumerate(extra)] + [(None, base + " no id", None, None, None)]
    at = dump(spark, tmp_path, spark.createDataFrame(data, documents(spark).schema))
    spark.createDataFrame([(x[0], 1, x[5]) for x in labelled], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")

    docs = table(spark, at, "documents")
    schema, kept = docs.schema, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, at)
        assert out.schema == schema
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        kept.append({x.doc_id: x.text for x in docs.collect()})
    toxic = {x[0] for x in labelled if x[5]}
    assert len(toxic & set(kept[0])) <= 0.03 * len(toxic) and len(set(kept[0])) >= 0.99 * (len(data) - len(toxic))
    assert set(kept[1]) == {i for i, t in kept[0].items() if quality_brute(t)[-1]}
    _, root = brute({i: t for i, t in kept[1].items() if i is not None}, 5, 80)
    assert set(kept[2]) - {None} == set(root.values()) and (None in kept[2]) == (None in kept[1])

    packed = corpus_pipeline.run(spark, at).collect()
    check_packing(packed)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept[2].items()}
    got = {}
    for x in packed:
        got[x.doc_id] = got.get(x.doc_id, 0) + x.length
    assert got == want


def test_empty_table(spark, tmp_path):
    at = dump(spark, tmp_path, documents(spark, []))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    assert corpus_pipeline.run(spark, at).collect() == []


def test_toxic_stage_drops_forms_it_has_not_seen(spark, tmp_path):
    """Texts whose toxic words are new forms of a stem, beside few labels."""
    plain = [f"{a}{b}{c}" for a in "vwxz" for b in "aeiou" for c in "lmnrst"]
    ends = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    data = [(i, " ".join([*(plain[(i * 7 + k * (i % 11 + 1)) % 120] for k in range(20)), *([f"grolf{ends[i % 60]}", f"grolf{ends[(i + 1) % 60]}"] if i % 8 == 0 else [])]), "de", "s", 0) for i in range(160)]
    new = [(1000 + i, f"val grolf{e}x wen grolf{e}y", "de", "s", 0) for i, e in enumerate(ends[:20])]
    at = dump(spark, tmp_path, spark.createDataFrame(data + new, documents(spark).schema))
    spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i, *_ in data], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{at}/documents.parquet"), at).collect()}
    assert kept == {i for i, *_ in data if i % 8}
