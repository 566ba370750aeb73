import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, components, documents
from tidegraph.llm import embeddings, langid, language_model, media, mixing, pieces, quality, simhash, urls, warc
from tidegraph.llm.common import connected_components

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def count(text):
    return len((text or "").encode().split())


# mixing


def test_mix_against_brute_force(spark, docs):
    rows = documents()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += count(r[1])
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(sizes.values())
    while left > 1e-9 and open_:  # as the contract words it: share, stop, share the excess again
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = sum(max(0.0, target[s] - 2 * sizes[s]) for s in open_)
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    longest = {s: max(count(r[1]) for r in rows if r[3] == s) for s in order}
    for s in order:
        assert abs(taken[s] - target[s]) <= longest[s]
    again = mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["taken"])
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert key


def test_mixed_documents_repeat_rows(docs, none):
    planned = Counter()
    for r in mixing.mix(docs).collect():
        planned[r["doc_id"]] += r["copies"]
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = Counter(r["doc_id"] for r in out.collect())
    assert got == +planned
    assert mixing.mix(none).count() == 0
    assert mixing.mixed_documents(none).count() == 0


def test_rows_alike_are_taken_one_by_one(spark):
    rows = [(None, "one two three four", "en", "a", 1, 1, 1.0, 1, "", 1)] * 400 + [(1, "five six", "en", "b", 1, 1, 1.0, 1, "", 1), (2, "seven", "en", None, 1, 1, 1.0, 1, "", 1)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = mixing.mix(table).collect()
    mine = [r for r in got if r["source"] == "a"]
    assert len(mine) == 400
    assert 1600 <= mine[0]["target"] < 3200
    assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 2
    assert {r["copies"] for r in mine} == {1, 2}
    assert mixing.mixed_documents(table).filter("source = 'a'").count() == sum(r["copies"] for r in mine)


def test_mix_without_words(spark):
    rows = [(1, None, None, "a", 0, 0, 0.0, 0, "", 0), (2, " ", None, None, 0, 0, 0.0, 0, "", 0)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["doc_id"], r["size"], r["target"], r["taken"]) for r in got} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}


# sentencepiece


def test_pieces_equal_the_library():
    rng = random.Random(1)
    alphabet = ["a", "b", "ab", "the", " ", "  ", "\n", "\t", "\r", "▁", "é", "日本", "𝒳", "\x00", "ing", ";\r", "aaaa", "1234", "abab", "ana", "----", "    "]
    cases = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    cases += ["".join(rng.choice("aeinst") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    cases += ["a" * n for n in range(60)] + [" " * n for n in range(60)] + ["-" * n for n in range(80)]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    coder = pieces.Coder(MODEL)
    for text, (ids, decoded) in zip(cases, coder.encode(cases), strict=True):
        want = library.encode(text)
        assert ids == ",".join(map(str, want)), text
        assert decoded.decode() == library.decode(want), text
        assert coder.model.decode(want) == library.decode(want)


def test_piece_cache_may_start_anew(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 5)
    coder = pieces.Coder(MODEL)
    texts = [f"word{i} and word{i + 1}" for i in range(20)]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = [x for t in texts for x in coder.encode([t])]
    assert [g[0] for g in got] == [",".join(map(str, library.encode(t))) for t in texts]


@pytest.mark.parametrize("few", [5, 1 << 40])
def test_long_cuts_equal_the_library(monkeypatch, few):
    monkeypatch.setattr(pieces, "FEW", few)
    rng = random.Random(2)
    words = "the information theory of language models in and to is that was for on with as his they".split()
    library, coder = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.Coder(MODEL)
    texts = ["a" * 3000, "ab" * 900 + "c" * 77, "\u65e5\u672c\u8a9e" * 400, "".join(rng.choice(words) for _ in range(4000))]
    for _ in range(250):
        letters = rng.choice(["a", "ab", "aab", "etaoinshrdlu", "0123456789", "ACGT", "<>/=\"div", "\u7684\u4e00\u662f\u4e0d", "\u00e9\u00e0\u00fc"])
        unit = "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
        texts += ["".join(rng.choice(letters) for _ in range(rng.choice([65, 100, 400]))), unit * (300 // len(unit)), "".join(rng.choice(words) for _ in range(60)) + unit]
    for text, (ids, decoded) in zip(texts, coder.encode(texts), strict=True):
        assert ids == ",".join(map(str, library.encode(text)))
        assert decoded.decode() == text


def test_pieces_column(docs, none):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pieces.encode_digest(docs, MODEL).collect() if r["doc_id"] is not None)
    want = []
    for r in documents():
        if r[0] is not None:
            ids = library.encode(r[1] or "")
            want.append((False, r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
    full = {r["doc_id"]: r for r in pieces.encode_column(docs, MODEL).collect()}
    assert full[3]["ids"] == library.encode(documents()[3][1])
    assert pieces.encode_digest(none, MODEL).count() == 0


# language


def test_languages_are_told_apart(docs, none):
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    rows = {r[0]: r for r in documents()}
    judged = [(got[i]["lang_pred"], rows[i][2]) for i in range(120) if got[i]["held_out"] and count(rows[i][1]) >= 8]
    assert len(judged) > 10
    assert sum(a == b for a, b in judged) >= 0.95 * len(judged)
    for r in got.values():
        assert 0 <= r["score"] <= 1
        text = rows[r["doc_id"]][1]
        assert (r["lang_pred"] == "und") == (text is None or not any(c.isalpha() for c in text))
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert langid.identify(none).count() == 0


def plain_grams(text):
    """Single letters and runs of three characters of a text in lower case, all else than letters one space."""
    flat = re.sub(r" +", " ", "".join(c if c.isalpha() else " " for c in " " + (text or "").lower() + " "))
    return Counter(c for c in flat if c != " "), Counter(flat[i : i + 3] for i in range(len(flat) - 2))


def test_language_counts_against_sets(docs):
    rows = [r for r in documents() if r[1] is not None and len(r[1]) < 10_000]
    model = langid.train(docs, per_language=10**6)
    seen = {lang: sum((sum(plain_grams(t), Counter()) for _, t, x, *_ in set(documents()) if x == lang and t is not None), Counter()) for lang in model.languages}
    total = {lang: sum(c.values()) for lang, c in seen.items()}
    rare = {lang: min(3, total[lang] // langid.PLENTY + 1) for lang in seen}
    top = Counter()
    for lang, c in seen.items():
        kept = {g: n for g, n in c.items() if n >= rare[lang]}
        whole = sum(kept.values())
        seen[lang] = {g: n / whole for g, n in kept.items()}
        for g, x in seen[lang].items():
            top[g] = max(top[g], x)
    held = {lang: {g for g, x in c.items() if x >= 0.5 * top[g]} for lang, c in seen.items()}
    hits, sizes = model.counts([r[1] for r in rows])
    plain = np.array([[sum(n for c in plain_grams(r[1]) for g, n in c.items() if g in held[lang]) for lang in model.languages] for r in rows])
    assert sizes.tolist() == [sum(sum(c.values()) for c in plain_grams(r[1])) for r in rows]
    assert (hits >= plain).all()
    assert (hits - plain).sum() <= 0.001 * plain.sum() + 5  # what the filter passes by chance
    for r, p, lang in zip(rows, plain, model.predict([r[1] for r in rows])[0], strict=True):
        first, second = sorted(p.tolist())[-1:-3:-1]
        if first > 1.02 * second + 5:
            assert lang == model.languages[int(p.argmax())]


def test_language_filter_of_many_languages_and_seams(monkeypatch):
    import pandas as pd

    texts = {f"l{i:03d}": f"x{chr(0x4E00 + 3 * i)}{chr(0x4E01 + 3 * i)}y" * 30 for i in range(70)}
    rows = []
    for lang, t in texts.items():
        points, _ = langid.clean([t])
        h, n = np.unique(langid.grams(points, 3), return_counts=True)
        rows += [(lang, int(a), int(b)) for a, b in zip(h.view(np.int64), n, strict=True)]
    model = langid.Model.fit(pd.DataFrame(rows, columns=["lang", "gram", "n"]), (3,))
    assert model.predict(list(texts.values()))[0] == list(texts)
    whole = model.counts([texts["l007"]])
    monkeypatch.setattr(langid, "CHARS", 17)
    parts = model.counts([texts["l007"]])
    assert parts[0].argmax() == whole[0].argmax() == 7


def test_nothing_to_learn(docs):
    got = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}


# embeddings


def vectors():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(150):
        v = rng.standard_normal(16)
        rows.append([i, v, int(i % 3)])
    for i in range(150, 260):  # a chain and copies
        base = rows[rng.integers(0, 150)]
        near = base[1] + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.12])
        rows.append([i, near * rng.choice([1.0, 3.5]), base[2]])
    out = [(i, [float(np.float32(x)) for x in v], k) for i, v, k in rows]
    out += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [None] * 16, 1), (304, out[0][1], None), (305, [float("inf")] + [1.0] * 15, 1), (306, [1.0, 2.0], 1), (307, [2.0, 4.0], 1), (308, [], 1), (309, [1e300, 1e300], 2), (310, [1e-300, 1e-300], 2)]
    return out


def test_embeddings_against_brute_force(spark):
    rows = vectors()
    good = {i: (np.array(v, float), k) for i, v, k in rows if v and k is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    unit = {i: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for i, (v, _) in good.items()}

    def linked(a, b):
        return a in good and b in good and good[a][1] == good[b][1] and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= 0.93

    want = components([i for i, _, _ in rows], linked)
    table = spark.createDataFrame([(*r, "v", 1.0) for r in rows], "vec_id long, embedding array<double>, label int, v string, n double").repartition(4)
    got = {r["vec_id"]: r for r in embeddings.embedding_dedup(table).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_links"] for i, r in got.items()} == {i: sum(linked(i, j) for j in want if j != i) for i in want}
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert len(set(want.values())) < len(want) - 50


def test_embedding_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 7)
    monkeypatch.setattr(embeddings, "FINE", 4)
    monkeypatch.setattr(embeddings, "BYTES", 8 * 8 * 9)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.ones(8) + rng.standard_normal(8) * 0.02], 1) for i in range(60)] + [(5, [1.0] * 8, 1), (5, [1.0] * 8, 1)]
    got = embeddings.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(61, 0)}
    assert len(got) == 62
    assert embeddings.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_vectors_of_many_lengths(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(1 + i % 90).tolist(), 1) for i in range(270)]
    rows += [(300 + i, [2 * x for x in v], 1) for i, v, _ in rows if len(v) > 4]
    table = spark.createDataFrame([(*r, i, str(i)) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, label int, k long, v string").repartition(4)
    got = {r["vec_id"]: r["component_id"] for r in embeddings.embedding_dedup(table).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    assert got == components(unit, lambda a, b: len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= 0.93)
    assert embeddings.embedding_dedup(table.limit(0)).count() == 0


def test_vectors_travel_a_fixed_number_of_times(spark):
    """Copies sent of each vector of one label don't grow with the label."""
    sent = []
    for n in (8000, 32000):
        table = spark.range(n).select(F.col("id").alias("k"), F.lit("x").alias("label"), F.lit(8).alias("dim"), F.lit(b"").alias("v"), F.lit(1).cast("long").alias("n"))
        rows = embeddings._links(table, {}, 0.93, only_sent=True)
        sent.append(rows.count() / n)
    assert sent[1] <= 5
    assert sent[0] <= 5


# warc


def pages(spark):
    rng = random.Random(5)
    html = ["<p>" + "é" * rng.randint(0, 9000) + str(i % 40) + "</p>" for i in range(60)]
    rows = [(i, f"http://x/{i}", html[i % 45], "extra", 1) for i in range(60)]
    rows += [(70, None, None, None, None), (71, "a\r\nb: c", "", None, None), (72, "", None, None, None), (73, "u", "z" * 200_000, None, None), rows[3], (None, "n", "only here", None, None)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, kind string, n int").repartition(3)


def test_archives_round_trip(spark):
    rows, table = pages(spark)
    got = sorted(map(tuple, warc.archive_pages(table, segment=500).collect()), key=str)
    head = {}
    for i, _, html, *_ in rows:
        raw = (html or "").encode()
        head[raw] = max([x for x in (head.get(raw), i) if x is not None], default=None)
    want = []
    for i, _, html, *_ in rows:
        raw = (html or "").encode()
        first = head[raw] == i
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else head[raw]))
    assert got == sorted(want, key=str)
    assert warc.archive_pages(table.limit(0)).count() == 0


def test_harmed_segments_are_told(spark):
    _, table = pages(spark)
    archives = warc.write_pages(table.filter("page_id = 73"), segment=20_000)
    data = b"".join(r["data"] for r in archives.collect())
    records = list(warc.parse(data))
    assert len(records) > 5
    make = lambda keep: b"".join(warc.record([(k, v) for k, v in f.items() if k != "content-length"], b) for f, b, _ in keep)
    cases = {"none": records, "lost": records[:2] + records[3:], "last": records[:-1], "cut": records[:-1] + [(records[-1][0], records[-1][1][:-3], None)], "mixed": records[::-1]}
    for name, kept in cases.items():
        got = warc.read_records(spark.createDataFrame([("a", bytearray(make(kept)))], "archive string, data binary")).collect()
        assert len(got) == 1
        assert (got[0]["error"] is None) == (name in ("none", "mixed")), name
        assert (got[0]["payload"] is not None) == (name in ("none", "mixed"))


def test_archive_files(spark, tmp_path):
    import gzip

    _, table = pages(spark)
    for i, r in enumerate(warc.write_pages(table, segment=700).collect()):
        (tmp_path / (f"{i}.warc.gz" if i % 2 else f"{i}.warc")).write_bytes(gzip.compress(r["data"]) if i % 2 else r["data"])
    told = warc.page_digests(warc.read_records(warc.read_files(spark, str(tmp_path))))
    assert sorted(map(str, told.collect())) == sorted(map(str, warc.archive_pages(table).collect()))


def test_harmed_archives_keep_their_other_records(spark):
    def one(i, kind="response", extra=()):
        return warc.record([("WARC-Type", kind), ("WARC-Record-ID", f"<{i}>"), ("X-Page-Id", i), *extra], b"HTTP/1.1 200 OK\r\n\r\nbody %d" % i if kind == "response" else b"block")

    cases = [
        one(1) + one(2), one(1)[:-9] + one(2), b"rubbish" + one(2), one(1).replace(b"Content-Length: ", b"Content-Length: x") + one(2),
        one(1) + one(2, extra=[("WARC-Segment-Number", "one")]), one(1).replace(b"X-Page-Id: 1", b"X-Page-Id: ?") + one(2), one(1, "resource") + one(2, "warcinfo") + one(3, "conversion"), b"", None,
    ]
    got = [
        sorted((str(r["record_id"]), r["kind"], bytes(r["payload"]).decode() if r["payload"] is not None else None, r["error"] is not None) for r in warc.read_records(spark.createDataFrame([("a", c)], "archive string, data binary")).collect())
        for c in cases
    ]
    good = [("<1>", "response", "body 1", False), ("<2>", "response", "body 2", False)]
    assert got[0] == good
    for i in (1, 2, 3, 5):
        assert good[1] in got[i], i
        assert any(x[3] for x in got[i]), i
        assert good[0] not in got[i], i
    assert good[0] in got[4]
    assert [x[3] for x in got[4]] == [False, True]
    assert got[6] == [("<1>", "resource", "block", False), ("<3>", "conversion", "block", False)]
    assert got[7:] == [[], []]


def test_files_are_cut_between_records():
    import gzip

    made = [warc.record([("WARC-Type", "resource"), ("WARC-Record-ID", f"<{i}>")], bytes([i % 256]) * (i * 37 % 5000)) for i in range(200)]
    data = b"".join(made)
    for file in (data, gzip.compress(data), b"".join(map(gzip.compress, made))):
        parts = list(warc.whole_records(warc.unpacked(file, 1000), 20_000))
        assert b"".join(parts) == data
        assert max(map(len, parts)) < 40_000
        assert all(e is None for p in parts for _, _, e in warc.parse(p))
    assert b"".join(warc.unpacked(gzip.compress(data)[:-500])) == data[: len(b"".join(warc.unpacked(gzip.compress(data)[:-500])))]


def test_chunked_framing():
    for n in (0, 1, 4095, 4096, 4097, 9000):
        data = bytes(i % 251 for i in range(n))
        assert warc.unchunked(warc.chunked(data)) == data
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"", b"zz\r\nabc", b"5\r\nabc\r\n", b"3\r\nabcd\r\n0\r\n\r\n"):
        with pytest.raises(warc.BadRecord):
            warc.unchunked(bad)


# quality


def test_quality_held_out(spark, none):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        good = i % 3 != 0
        words = [rng.choice("abcdefgh") * rng.randint(1, 3) + rng.choice("xyz") for _ in range(40)]
        text = " ".join(words) if good else " ".join(["SPAM!!"] * 20 + words[:3])
        rows.append((i, text, "en", "good" if good and rng.random() < 0.8 else "bad", len(text), 1, 0.5, 7, "x", 3))
        if i % 2:
            labels += [(i, int(good), 0)] * (1 + i % 5 // 4)
    rows += [(1000, None, None, None, None, None, None, None, None, None), (1001, "", None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    told = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(docs, told).collect()}
    held = [i for i in range(600) if got[i]["held_out"]]
    assert len(held) > 50
    assert sum(got[i]["quality_pred"] == int(i % 3 != 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["score"] for r in quality.classify(docs, told.limit(0)).collect()} == {0.5}
    assert {r["quality_pred"] for r in quality.classify(docs, told.filter("quality = 1")).collect()} == {1}
    assert quality.classify(none, told).count() == 0


def test_views_hand_labels_to_each_other():
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 2000).astype(float)
    text = np.stack([y * 4 + rng.standard_normal(2000), rng.standard_normal(2000)], axis=1)
    meta = np.stack([y * 4 + rng.standard_normal(2000), rng.standard_normal(2000)], axis=1)
    free = {"text": set(range(200, 1000)), "meta": set(range(200, 1000))}

    def most_sure(models, quotas, least):
        out = {}
        for (view, label), quota in quotas.items():
            logit = models[view].logit(text if view == "text" else meta) * (1 if label else -1)
            rows = sorted((i for i in free[view] if logit[i] >= least[view, label]), key=lambda i: -logit[i])[:quota]
            free[view] -= set(rows)
            out[view, label] = (text[rows], meta[rows])
        return out

    model = quality.CoTrained.fit(text[:200], meta[:200], y[:200], np.arange(200) % 5 == 0, most_sure)
    assert model.handed > 100
    p, _, _ = model.predict(text[1000:], meta[1000:])
    assert ((p >= 0.5) == y[1000:]).mean() > 0.97


def test_confidence_must_hold_on_other_documents():
    logit, y = np.array([9.0, 8, 7, 6, 5, 4, 3, 2, 1, 0, -1, -2, -9, -9, -9]), np.array([1] * 12 + [0] * 3)
    assert quality.sure_from(logit, y, 1) == pytest.approx(np.log(0.97 / 0.03))
    assert quality.sure_from(logit, y, 0) is None  # too few
    y[3] = 0
    assert quality.sure_from(logit, y, 1) is None  # one of ten is wrong


def test_text_features_against_brute_force(monkeypatch):
    texts = [r[1] for r in documents(n=30)] + ["a\nb\n\na", "x" * 50, "one one one two"]
    kinds = quality.kinds()
    for chars in (1_000_000, 40):
        monkeypatch.setattr(langid, "CHARS", chars)
        got = quality.text_features(texts)
        for t, x in zip(texts, got, strict=True):
            t = t or ""
            pairs = Counter((kinds[ord(a)], kinds[ord(b)]) for a, b in zip(t, t[1:], strict=False))
            want = np.zeros((16, 16))
            for (a, b), n in pairs.items():
                want[a, b] = n
            assert x[:256] == pytest.approx(np.sqrt(want / max(1, want.sum())).ravel())
            words = t.encode().lower().split()
            seen = Counter(words)
            basic = x[512:]
            if words:
                assert x[256:512] @ x[256:512] == pytest.approx(1)
                assert basic[2:5] == pytest.approx([len(seen) / len(words), sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words), max(seen.values()) / len(words)])
            lines = [y for y in t.split("\n") if y.strip()]
            assert basic[6] == pytest.approx(len(set(lines)) / len(lines) if lines else 0)
            assert basic[8] == (not words)


def test_most_sure_documents_against_brute_force(spark):
    rng = np.random.default_rng(11)
    t, m = rng.integers(0, 256, (500, 6)).astype(np.uint8), rng.integers(0, 256, (500, 3)).astype(np.uint8)
    t[100:300] = t[0]  # many of the same confidence
    ids = rng.integers(-(1 << 62), 1 << 62, 500)
    free = spark.createDataFrame([(int(i), bytes(a), bytes(b)) for i, a, b in zip(ids, t, m, strict=True)], "id long, t binary, m binary").repartition(4)
    models = {"text": quality.Logistic(np.full(6, 0.5), np.ones(6), np.array([9.0, -8, 7, 3, 1, 2]), 0.1), "meta": quality.Logistic(np.full(3, 0.5), np.ones(3), np.array([9.0, 5, -7]), 0.0)}
    ask, quotas = quality._most_sure(free), {("text", 1): 30, ("text", 0): 10, ("meta", 1): 5, ("meta", 0): 400}
    before = {k: set() for k in quotas}
    for _ in range(3):
        got = ask(models, quotas, dict.fromkeys(quotas, float(np.log(0.97 / 0.03))))
        for (view, label), quota in quotas.items():
            logit = models[view].logit(quality.unpacked(t if view == "text" else m)) * (1 if label else -1)
            left = [i for i in range(500) if logit[i] >= np.log(0.97 / 0.03) + quality.LOGIT_STEP and i not in before[view, label]]
            rows = got[view, label][0]
            assert min(quota, len(left)) <= max(len(rows), 1) + 2
            assert len(rows) <= quota
            mine = [next(i for i in range(500) if (quality.unpacked(t[i]) == a).all() and (quality.unpacked(m[i]) == b).all()) for a, b in zip(*got[view, label], strict=True)] if len(rows) else []
            if mine and len(left) > quota:  # none that is left is surer by more than a step
                assert min(logit[mine]) >= sorted(logit[left])[-quota] - 2 * quality.LOGIT_STEP
            before[view, label] |= set(mine)


# simhash


def plain_fingerprint(text, n=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(docs, none):
    rows = [r for r in documents() if r[0] is not None]
    fp = {r[0]: plain_fingerprint(r[1]) for r in rows}
    want = components(list(fp), lambda a, b: bin(fp[a] ^ fp[b]).count("1") <= 4)
    got = simhash.simhash_dedup(docs.filter("doc_id is not null")).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fp[i]:016x}", want[i]) for i in fp}
    assert simhash.simhash_dedup(docs).count() == len(documents())
    assert simhash.simhash_dedup(none).count() == 0


@pytest.mark.parametrize(("radius", "parts", "kept"), [(4, 3, 2), (5, 4, 2), (2, 1, 1)])
def test_no_link_is_lost(spark, radius, parts, kept):
    rng = random.Random(8)
    prints = set()
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(12):
            prints.add(x)
            for b in rng.sample(range(64), rng.randint(1, radius)):
                x ^= 1 << b
    x = rng.getrandbits(64)
    prints |= {x ^ (1 << i) for i in range(64)}  # a bucket of many
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    want = components(list(map(signed, prints)), lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= radius)
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long").repartition(3)
    got = {r["node"]: r["component"] for r in connected_components(simhash.fingerprint_links(df, radius, parts, kept)).collect()}
    assert {x: got.get(x, x) for x in want} == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (2000, 1999), (1999, 2000)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}, 1999: 1999, 2000: 1999}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# language model


def test_base_scores_against_brute_force(docs, none, monkeypatch):
    rows = documents()
    training = Counter()
    for r in rows:
        if r[0] is None or zlib.crc32(str(r[0]).encode()) % 10:
            training.update((r[1] or "").encode().lower().split() + [b""])
    n, v = sum(training.values()), len(training)
    monkeypatch.setattr(language_model, "HEAD", 30)
    for df in (docs,):
        got = language_model.score_documents(df, updates=20).collect()
        assert len(got) == len(rows)
        by = {r["doc_id"]: r for r in got}
        for r in rows:
            words = (r[1] or "").encode().lower().split() + [b""]
            g = by[r[0]]
            assert g["base_score"] == pytest.approx(sum(math.log10((training[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words))
            assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(words), sum(training[w] > 0 for w in words), n)
            assert g["score"] < 0
    assert language_model.score_documents(none).count() == 0


def small_model(rng=None):
    net = language_model.Recurrent.new(np.full(20, 3.0), np.ones(language_model.GROUPS))
    for name in ("e", "w", "u", "v", "cw", "ow") if rng is not None else ():
        setattr(net, name, rng.standard_normal(getattr(net, name).shape).astype(np.float32))
    head, zero = [f"w{i}".encode() for i in range(19)] + [b""], np.zeros(language_model.GROUPS)
    return language_model.LanguageModel(head, np.full(20, 3.0), 20, 60, 20, zero, zero, net)


def symbols(model, text):
    return model.read([text])[0]


def plain_score(net, sym, start):
    """Word by word: the recurrence and both softmaxes written out."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    n, total, h, before = language_model.HIDDEN, 0.0, np.zeros(language_model.HIDDEN), start
    w, u, v, e, cw, ow = (np.asarray(getattr(net, k), float) for k in ("w", "u", "v", "e", "cw", "ow"))
    for y in sym:
        x = e[before] @ w + net.b
        z, r = sig(x[:n] + h @ u[:, :n]), sig(x[n : 2 * n] + h @ u[:, n:])
        h = z * h + (1 - z) * np.tanh(x[2 * n :] + (r * h) @ v)
        logits, c = h @ cw + net.cb, int(net.class_of[y])
        total += logits[c] - np.log(np.exp(logits).sum())
        if c < len(net.starts) - 1:
            a, b = net.starts[c], net.starts[c + 1]
            logits = ow[a:b] @ h + net.ob[a:b]
            total += logits[y - a] - np.log(np.exp(logits).sum())
        before = y
    return total / np.log(10)


def test_scores_step_by_step():
    model = small_model(np.random.default_rng(9))
    rng = np.random.default_rng(10)
    docs = [symbols(model, " ".join(f"w{x}" if x < 19 else f"rare{x}" for x in rng.integers(0, 25, n))) for n in (0, 1, 40, 7)]
    got = model.likelihood(docs)
    assert got == pytest.approx([plain_score(model.net, d.tolist(), 19) for d in docs], rel=1e-4)


def test_gradients_against_differences():
    rng = np.random.default_rng(12)
    net = small_model(rng).net
    for name in language_model.LEARNED:
        setattr(net, name, (getattr(net, name) * 0.3).astype(np.float32))
    y = rng.integers(0, 20 + language_model.GROUPS, (6, 5)).astype(np.int32)
    x = np.concatenate([np.full((1, 5), 19, np.int32), y[:-1]])
    fresh = rng.random(y.shape) < 0.2

    def loss():
        total = 0.0
        for s in range(5):
            cuts = [0, *[t for t in range(1, 6) if fresh[t, s]], 6]
            for a, b in zip(cuts, cuts[1:], strict=False):
                total -= plain_score(net, y[a:b, s].tolist(), int(x[a, s])) * np.log(10)
        return total

    want = {}
    for name in language_model.LEARNED:
        value = getattr(net, name)
        at = tuple(rng.integers(0, n) for n in value.shape) if name != "e" else (int(x[2, 1]), 3)
        if name == "ow":
            at = (int(y[y < 20][0]), 2)
        sides = []
        for step in (1e-2, -1e-2):
            moved = value.copy()
            moved[at] += step
            setattr(net, name, moved)
            sides.append(loss())
        setattr(net, name, value)
        want[name] = (at, (sides[0] - sides[1]) / 2e-2)
    adam = {}
    net.update(x, y, fresh, np.zeros((5, language_model.HIDDEN), np.float32), adam, 0.0)
    for name, (at, slope) in want.items():
        assert adam[name][0][at] * 10 * 5 == pytest.approx(slope, rel=0.05, abs=0.02), name


def test_learning():
    counts = np.array([50.0] * 6 + [5.0] * 6)
    net = language_model.Recurrent.new(counts, np.ones(language_model.GROUPS))
    rng = np.random.default_rng(1)
    pattern = np.array([0, 3, 1, 7, 2, 9] * 40)
    y = np.stack([np.roll(pattern, s) for s in rng.integers(0, 6, 8)], axis=1).astype(np.int32)
    fresh = np.zeros(y.shape, bool)
    h, adam = np.zeros((8, language_model.HIDDEN), np.float32), {}
    for i in range(150):
        at = i % 12 * 16 + 1
        h = net.update(y[at - 1 : at + 15], y[at : at + 16], fresh[at : at + 16], h, adam, 0.02)
    got = [plain_score(net, y[20:60, s].tolist(), int(y[19, s])) * np.log(10) / 40 for s in range(8)]
    assert np.mean(got) > -0.4  # the pattern is learned; by counts alone it would be about -2


def test_probabilities_sum_to_one():
    net = language_model.Recurrent.new(np.array([9.0, 5.0, 3.0, 1.0]), np.ones(language_model.GROUPS))
    net.ow += np.random.default_rng(2).standard_normal(net.ow.shape).astype(np.float32)
    net.cw += np.random.default_rng(3).standard_normal(net.cw.shape).astype(np.float32)
    h = np.random.default_rng(4).standard_normal((3, language_model.HIDDEN)).astype(np.float32)
    every = 4 + language_model.GROUPS
    total = sum(np.exp(net.output(h, np.full(3, s))) for s in range(every))
    assert total == pytest.approx(np.ones(3), abs=1e-4)


def test_streams_give_each_document_its_own_state(monkeypatch):
    rng = np.random.default_rng(5)
    model = small_model(rng)
    docs = [symbols(model, " ".join(f"w{x}" for x in rng.integers(0, 19, n))) for n in (0, 3, 90, 17, 1, 64)]
    alone = np.concatenate([model.likelihood([d]) for d in docs])
    monkeypatch.setattr(language_model, "WIDTH", 2)
    assert model.likelihood(docs) == pytest.approx(alone, rel=1e-4)


def test_a_long_document_takes_no_more_room_than_its_tokens():
    rng = np.random.default_rng(7)
    docs = [rng.integers(0, 20, n).astype(np.int32) for n in (300_000, *[50] * 255)]
    streams = language_model.Streams(docs, language_model.WIDTH)
    assert sum(getattr(streams, k).nbytes for k in ("y", "whose", "fresh")) <= 9 * sum(map(len, docs))
    assert streams.window(100_000, 16)[0].shape == (16, 1)
    seen = Counter()
    for at in range(0, streams.steps, 16):
        y, _, whose, _, live = streams.window(at, 16)
        seen.update(whose[live].tolist())
    assert seen == Counter({i: len(d) for i, d in enumerate(docs)})


@pytest.mark.parametrize("longest", [400, 50_000])
def test_training_reads_every_word(monkeypatch, longest):
    model = small_model()
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 19, n)) for n in (longest, 0, 1, *[40] * 200)]
    pairs = Counter()
    for t in texts:
        sym = symbols(model, t).tolist()
        pairs.update(zip([19, *sym[:-1]], sym, strict=True))
    read = Counter()

    def update(self, x, y, fresh, h, adam, rate, live=None):
        live = np.ones(x.shape, bool) if live is None else live
        read.update(zip(x[live].tolist(), y[live].tolist(), strict=True))
        return h

    monkeypatch.setattr(language_model.Recurrent, "update", update)
    assert model.train(texts, 1)[1] == sum(pairs.values())
    assert read == pairs


def test_all_documents_are_learned_from(spark, monkeypatch):
    rows = [(i, "a b c d e f " * 30 if i % 7 else "f e d c b a " * 30) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = language_model.count_words(docs)
    with monkeypatch.context() as m:
        m.setattr(language_model, "train_everywhere", lambda training, model: None)
        untaught = language_model.fit(docs, counts, sample=0)
    taught = language_model.fit(docs, counts, sample=0)  # no document in the sample: the rest must teach it
    sym = symbols(taught, "a b c d e f " * 30)
    assert not untaught.net.cw.any()
    assert taught.net.cw.any()
    assert taught.likelihood([sym])[0] > untaught.likelihood([sym])[0]


# media


@pytest.mark.parametrize("colour", [0, 2, 4, 6])
@pytest.mark.parametrize("row_filter", [0, 1, 2, 3, 4])
def test_pictures_round_trip(colour, row_filter):
    step = media.CHANNELS[colour]
    for width, height in ((1, 1), (5, 3), (64, 9)):
        data = np.random.default_rng(width).integers(0, 256, width * step * height, dtype=np.uint8).tobytes()
        rows, channels = media.decode_png(media.encode_png(data, width, colour, row_filter, most=50))
        assert (rows.tobytes(), channels) == (data, step)


def test_mixed_row_filters():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 256, (40, 12), dtype=np.uint8)
    kinds = rng.integers(0, 5, 40).astype(np.uint8)
    lines = np.stack([media.filtered(rows[: i + 1], int(k), 3)[i] for i, k in enumerate(kinds)])
    assert (media.unfiltered(kinds, lines, 3) == rows).all()


def test_harmed_pictures_are_told():
    whole = media.encode_png(bytes(range(256)) * 4)
    assert media.decode_png(whole)[0].tobytes() == bytes(range(256)) * 4
    for bad in (b"", whole[:20], whole[:-4], whole[:60] + b"\0" + whole[61:], b"x" + whole[1:], whole.replace(b"IDAT", b"IDAX")):
        with pytest.raises(media.BadPicture):
            media.decode_png(bad)


def test_a_small_picture_cannot_fill_memory():
    head = media.struct.pack(">IIBBBBB", 64, 10, 8, 0, 0, 0, 0)
    bomb = media.SIGNATURE + media.chunk(b"IHDR", head) + media.chunk(b"IDAT", zlib.compress(bytes(50_000_000))) + media.chunk(b"IEND", b"")
    with pytest.raises(media.BadPicture, match="amount"):
        media.decode_png(bomb)
    vast = media.SIGNATURE + media.chunk(b"IHDR", media.struct.pack(">IIBBBBB", 1 << 20, 1 << 20, 8, 0, 0, 0, 0)) + media.chunk(b"IEND", b"")
    with pytest.raises(media.BadPicture, match="large"):
        media.decode_png(vast)


def test_features_against_direct_sums():
    rng = np.random.default_rng(2)
    for h, w in ((1, 64), (5, 64), (40, 64), (9, 7)):
        rows = rng.integers(0, 256, (h, w)).astype(np.uint8)
        low = [sum(float(rows[i, j]) * math.cos(math.pi / h * p * (i + 0.5)) * math.cos(math.pi / w * q * (j + 0.5)) for i in range(h) for j in range(w)) for p in range(8) for q in range(8)]
        middle = float(np.median(low))
        got = np.unpackbits(np.frombuffer(bytes.fromhex(media.dct_hash(rows)), np.uint8))
        for bit, x in zip(got.tolist(), low, strict=True):
            assert bit == (x > middle) or abs(x - middle) < 0.05


def test_media_columns(spark, docs, none):
    got = [r for r in media.media_features(media.to_media(docs)).collect() if r["doc_id"] is not None]
    by = {r["doc_id"]: r for r in got}
    for r in documents():
        if r[0] is None:
            continue
        raw = (r[1] or "").encode()
        full = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        g = by[r[0]]
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert len(g["feature"]) == 16
        assert g["error"] is None
    assert by[0]["feature"] == by[124]["feature"]
    assert media.media_features(media.to_media(none)).count() == 0
    odd = spark.createDataFrame([(1, 0, None), (2, 0, bytearray(b"no"))], "doc_id long, n_bytes long, media binary")
    assert {r["doc_id"]: (r["error"] is not None, r["feature"]) for r in media.media_features(odd).collect()} == {1: (True, None), 2: (True, None)}


# urls

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, "allow")


@pytest.mark.parametrize("many", [0, 3000, 120_000])
def test_urls_against_brute_force(spark, many):
    rules = RULES + ([(f"h{i}.org", f"/p{i % 7}/", "block") for i in range(many)])
    urls_ = [None, "", "no scheme", "http://", "http://example.com", "http://example.com/en", "http://EXAMPLE.com/en/x?y#z", "https://www.example.com/en/1", "http://a.www.example.com/en/", "http://badexample.com/en/", "ftp://x.net/fr/", "http://net/es/", "http://x.net?/fr/", "http://x.net#/fr/", "http://x.net/FR/", "a://b://c.net/fr/", "http://é.net/es/ü", "http://example.com./en/", "http://.com/", "http://h5.org/p5/x", "http://sub.h5.org/p4/", "http://x\n.net/fr/\nb"]
    rows = [(i, u, "h", "r") for i, u in enumerate(urls_ + urls_[5:9])] + [(5, urls_[5], "h", "r")]
    table = spark.createDataFrame(rows, "page_id long, url string, host string, rule string").repartition(3)
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")  # the largest list is joined by a shuffle
    got = sorted(map(str, urls.judge_urls(table, listed if many else rules).collect()))
    from pyspark.sql import Row

    assert got == sorted(str(Row(page_id=i, host=v[0], path=v[1], rule=v[2], verdict=v[3])) for i, u, *_ in rows for v in [plain_verdict(u, rules)])
    assert urls.judge_urls(table.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urls.judge_urls(table, spark.createDataFrame([], "host string, path string, verdict string")).collect()} == {"allow"}


def test_filter_never_misses(spark):
    keys = [f"host{i}.org/p{i}" for i in range(5000)]
    listed = spark.createDataFrame([(k,) for k in keys], "k string")
    data = urls.bloom(listed.withColumnRenamed("k", "listed"), len(keys))
    assert listed.filter(urls.might_hold(data, F.col("k"))).count() == len(keys)
    other = listed.select(F.concat("k", F.lit("x")).alias("k"))
    assert other.filter(urls.might_hold(data, F.col("k"))).count() < 0.05 * len(keys)
