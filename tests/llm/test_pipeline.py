import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece

import corpus_pipeline
from tests.llm.helpers import SCHEMA, components, documents
from tidegraph.functions.workers import stored
from tidegraph.llm import langid, quality
from tidegraph.llm.queries import oracle_sql, queries


def test_stages_keep_their_columns(spark, tmp_path):
    docs = spark.createDataFrame(documents(n=60), SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, str(tmp_path)))
        assert out.columns == docs.columns
        assert 0 < out.count() <= 2 * docs.count()
        docs = out
    assert docs.filter("text is null or text = ''").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert last.count() == docs.count()


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def plain_mix(rows):
    """doc_id -> how often the mix takes it, row by row in the order of the hash."""
    size = lambda r: len((r[1] or "").encode().split())
    total = Counter()
    for r in rows:
        total[r[3]] += size(r)
    order = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None] * (None in total)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, target = set(), {}
    while True:  # share what is left by weight until no target is above twice its source
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        target = {s: 2.0 * total[s] if s in capped else left * weight[s] / sum(weight[x] for x in open_) for s in order}
        over = {s for s in open_ if target[s] > 2 * total[s]}
        if not over:
            break
        capped |= over
    out = Counter()
    for s in order:
        passes, before = int(target[s] // total[s]) if total[s] else 0, 0
        mine = sorted((int(hashlib.md5(f"mix:{r[0]}:{r[1] or ''}".encode()).hexdigest()[:15], 16), r) for r in rows if r[3] == s)
        for _, r in mine:
            out[r[0]] += (passes + (before + size(r) / 2 <= target[s] - passes * total[s])) if total[s] else 0
            before += size(r)
    return +out


def test_stages_against_brute_force(spark, tmp_path):
    base = [r for r in documents(seed=3, n=150) if r[0] is not None and r[0] != 127]
    rows = list({r[0]: r for r in base}.values())
    rows += [(500 + i, r[1] + " more", *r[2:]) for i, r in enumerate(rows[:20]) if r[1]]  # near copies, if long enough
    labels = [(r[0], int(r[0] % 3 > 0), 0) for r in rows if r[0] % 2 == 0]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    plain, outputs = [tuple(r) for r in docs.collect()], []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        outputs.append(stored(stage(spark, docs, str(tmp_path))))
        docs = outputs[-1]
    told = [[tuple(r) for r in o.collect()] for o in outputs]
    # language: each text by itself
    model = langid.train(spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text", "lang"))
    kept = set()
    for r in plain:
        name, _, held = model.predict([r[1]])
        if name[0] != "und" and held[0] >= corpus_pipeline.LEAST_HELD:
            kept.add(r[0])
    assert {r[0] for r in told[0]} == kept
    # quality: each document by itself, with both views' weights
    model = quality.train(outputs[0], spark.read.parquet(f"{tmp_path}/labels.parquet"))
    kept = set()
    for r in told[0]:
        t = model.text.logit(quality.unpacked(quality.packed(quality.text_features([r[1]]))))
        m = model.meta.logit(quality.unpacked(quality.packed(quality.meta_features(r[3], r[2], r[4])[None])))
        logit = float(model.both.logit(np.array([[np.clip(t[0], -30, 30), np.clip(m[0], -30, 30)]]))[0])
        if logit >= 0:
            kept.add(r[0])
    assert {r[0] for r in told[1]} == kept
    # near copies: all pairs
    sets = {r[0]: shingles(r[1]) for r in told[1]}
    root = components(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert {r[0] for r in told[2]} == {i for i in sets if root[i] == i}
    assert len(told[2]) < len(told[1])
    # the mix, and its encoding by the library
    assert Counter(r[0] for r in told[3]) == plain_mix(told[2])
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for r in told[3]:
        ids = library.encode(r[1])
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()) == sorted(want)


def test_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pictures_are_read_back_from_a_stored_table(spark, tmp_path):
    spark.createDataFrame(documents(n=10), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    files = queries()["op9_media"](spark, str(tmp_path)).inputFiles()
    assert files
    assert not any("documents.parquet" in f for f in files)


def test_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))
    assert set(oracle_sql()) <= set(queries())
