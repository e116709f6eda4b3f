"""The corpus pipeline, stage by stage, against brute force and the tokenizers library."""

import collections
import hashlib
import itertools

import numpy as np

import corpus_pipeline
from linktrove.llm import cube_mix, toxicity
from linktrove.llm.vocab import vocabulary_path

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").lower().split()
    return collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def test_every_stage_against_brute_force(spark):
    from tokenizers import Tokenizer

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "source_mix", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}

    clean = stages["toxicity"](spark, docs, SF).cache()
    scores = toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
    kept = sorted(r.doc_id for r in scores if r.score < 0.7)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.select("doc_id").collect()) == kept

    alone = stages["near_dedup"](spark, clean, SF).cache()
    sets = {d: shingles(rows[d].text) for d in kept}
    group = {d: d for d in kept}
    for a, b in itertools.combinations(kept, 2):
        both = sum((sets[a] & sets[b]).values())
        total = sum(sets[a].values()) + sum(sets[b].values()) - both
        if (both / total if total else 1.0) >= 0.8 and group[a] != group[b]:
            low, high = sorted((group[a], group[b]))
            group = {d: low if g == high else g for d, g in group.items()}
    single = sorted(set(group.values()))
    assert alone.columns == docs.columns and sorted(r.doc_id for r in alone.select("doc_id").collect()) == single
    assert len(single) < len(kept)

    mixed = stages["source_mix"](spark, alone, SF).cache()
    copies = {r.doc_id: r.copies for r in cube_mix.mix(alone).collect()}
    held = collections.Counter(r.doc_id for r in mixed.select("doc_id").collect())
    assert mixed.columns == docs.columns and held == collections.Counter({d: n for d, n in copies.items() if n})

    library = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    want = collections.Counter()
    for d, n in held.items():
        ids = library.encode(rows[d].text or "", add_special_tokens=False).ids
        want[(d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
              hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += n
    got = stages["bpe"](spark, mixed, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert collections.Counter(tuple(r) for r in got) == want


def test_stages_take_odd_and_empty_tables(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "size")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() <= 2 * docs.count()
        assert stage(spark, docs.limit(0), SF).count() == 0
