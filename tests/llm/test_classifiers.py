import math
import zlib
from collections import Counter

import numpy as np
import zstandard

from siftstone.llm import langid, quality


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.identify(docs).collect()
    assert len(got) == len(known)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {d for d in known if zlib.crc32(str(d).encode()) % 4 == 2}
    assert all(0 <= r.score <= 1 for r in got)
    right = np.mean([r.lang_pred == known[r.doc_id] for r in held])
    assert right >= 0.97, right


def test_language_edge_cases(spark):
    english, german = "the house and the river and the king of the north ", "der hund und die katze sind nicht in dem haus "
    rows = [(i, (english if i % 2 else german) * 3, "en" if i % 2 else "de", 1) for i in range(40)]
    rows += [(100, None, "en", 1), (101, "", None, 1), (102, "123 -- !!", "en", 1), (103, english, None, 1), (None, german, "xx", 1), (104, "é", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102, 103, None)] == ["und", "und", "und", "en", "de"]
    assert got[None].held_out and got[101].score == 0
    assert got[104].lang_pred in ("en", "de")
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*range(40), 103, None, 104], key=str)
    assert langid.identify(docs.limit(0)).collect() == []
    assert {r.lang_pred for r in langid.identify(docs.where("lang is null")).collect()} == {"und"}


def test_texts_stay_whatever_was_learned(spark):
    english, german = "the house and the river and the king of the north ", "der hund und die katze sind nicht in dem haus "
    rows = [(i, (english if i % 2 else german) * 3, None) for i in range(20)] + [(20, "123", None)]
    unlabelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {tuple(r) for r in langid.accepted(unlabelled).collect()} == set(rows[:20])
    learned = [(100 + i, (english if i % 2 else german) * 3, "en" if i % 2 else "de") for i in range(40)]
    wrong = [(200, german * 3, "en")]
    both = langid.accepted(spark.createDataFrame(rows + learned + wrong, "doc_id long, text string, lang string"))
    assert {r.doc_id: r.lang for r in both.collect()} == {i: "en" if i % 2 else "de" for i in [*range(20), *range(100, 140)]} | {200: "en"}
    one = langid.accepted(spark.createDataFrame(rows + learned[1::2], "doc_id long, text string, lang string"))
    assert {r.lang for r in one.where("doc_id < 20").collect()} == {None}


def test_codewords_differ_in_half_of_their_bits():
    for count in (2, 4, 7, 12, 40):
        code = langid.codewords(count)
        far = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
        assert min(far) * 2 >= code.shape[1] * 0.9


def decoded(model, text):
    """Language and score of one text: n-grams counted one by one, the loss of each codeword added up bit by bit."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    seen = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    seen = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in seen)
    spots = Counter()
    for length, factor in ((2, 0x9E3779B97F4A7C15), (3, 0xC2B2AE3D27D4EB4F)):
        for gram, n in Counter(seen[i : i + length] for i in range(len(seen) - length + 1)).items():
            if gram.strip(b" "):
                spots[int.from_bytes(gram, "big") * factor % (1 << 64) >> 54] += n
    total = sum(spots.values())
    losses = []
    for word in model.code:
        loss = 0.0
        for bit, sign in enumerate(word):
            margin = model.weights[-1, bit] + sum(math.sqrt(n / total) * model.weights[at, bit] for at, n in spots.items())
            loss += model.trust[bit] * math.exp(-min(4, max(-4, margin * sign)))
        losses.append(loss / model.trust.sum())
    shares = [math.exp(-model.sharpness * (x - min(losses))) for x in losses]
    best = losses.index(min(losses))
    return model.languages[best], shares[best] / sum(shares)


def test_language_against_decoding_text_by_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    extra = [(-1, None, "en"), (-2, "", "en"), (-3, "é", None), (-4, "x", None), (-5, "12 !", "de"), (-6, "der hund und the dog " * 20_000, None)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    model = langid.train(docs)
    want = {r.doc_id: decoded(model, r.text) for r in docs.collect()}
    got = langid.identify(docs).collect()
    assert len(got) == len(want)
    for r in got:
        lang, score = want[r.doc_id]
        assert abs(r.score - score) < 1e-4, r.doc_id
        assert r.lang_pred == lang or abs(r.score - 1 / len(model.languages)) < 1e-3, r.doc_id


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    positive = label == 1
    return (rank[positive].mean() - (positive.sum() - 1) / 2) / (~positive).sum()


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    known = {r.doc_id: r.quality for r in labels.collect()}
    got = quality.classify(docs, labels).collect()
    held = [r for r in got if r.held_out and r.doc_id in known]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    label = np.array([known[r.doc_id] for r in held])
    assert auc(np.array([r.score for r in held]), label) > 0.9
    assert np.mean([r.predicted for r in held] == label) > 0.9


def test_quality_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (4, "long " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (9, 1), (4, 7)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert len(quality.classify(docs, labels.limit(0)).collect()) == 6
    assert quality.classify(docs.limit(0), labels).collect() == []


def test_quality_against_compressing_text_by_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    extra = [(-1, None), (-2, ""), (-3, "é"), (-4, "click here now " * 100_000)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    assert model.good and model.bad and model.slope

    def size(text, content):
        table = zstandard.ZstdCompressionDict(content)
        table.precompute_compress(level=quality.LEVEL)
        return len(zstandard.ZstdCompressor(dict_data=table, write_content_size=False, write_dict_id=False).compress(text))

    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(texts)
    for r in got:
        good, bad = size(texts[r.doc_id], model.good), size(texts[r.doc_id], model.bad)
        score = 1 / (1 + math.exp(-(model.slope * (bad - good) / (bad + good) + model.offset)))
        assert abs(r.score - score) < 1e-9 and r.predicted == (r.score >= 0.5), r.doc_id
