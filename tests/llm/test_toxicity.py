"""Held-out accuracy of the toxicity scores."""

import pickle
import random
import zlib

import zstandard

from cohortlake.llm import toxicity
from tests.llm.helpers import odd_texts, prose, table

BAD = ["wretched", "vermin", "dimwit", "loathsome", "numbskull"]


def corpus(n=500):
    texts, labels = [], []
    for i in range(n):
        words = prose(i, 60, 2000).split()
        toxic = i % 4 == 0
        if toxic:
            rng = random.Random(i)
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    return texts, labels


def test_held_out_documents(spark):
    texts, labels = corpus()
    texts += odd_texts()
    marks = spark.createDataFrame([*labels, (0, 0), (3, None), (5, 9), (10**6, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(table(spark, texts), marks).collect()}
    assert len(got) == len(texts)
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i, _ in labels)
    right = sum(got[i]["predicted"] == labels[i][1] for i in held) / len(held)
    assert right >= 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def phrases(start, n):
    """Every fourth text holds one of two phrases of words that are as frequent in the others."""
    rng, out = random.Random(start), []
    said = [f"w{k} w{k + 7} w{k + 3} w{k + 9} w{k + 1} w{k + 5} w{k + 8} w{k + 2} w{k + 6} w{k + 4}" for k in (100, 200)]
    for i in range(start, start + n):
        words = prose(i, 60, 400).split()
        own = rng.choice(said).split()
        if i % 4:
            rng.shuffle(own)
        at = rng.randrange(len(words))
        out.append(" ".join([*words[:at], *own, *words[at:]]))
    return out


def test_toxic_phrases_of_ordinary_words(spark):
    train, held = phrases(0, 600), phrases(600, 200)
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.learn(table(spark, train), marks)
    found = [model.score(t) >= 0.5 for t in held]
    assert sum(f == (i % 4 == 0) for i, f in enumerate(found)) / len(found) >= 0.85


def test_savings_are_differences_of_compressed_lengths():
    own = toxicity.Dictionaries([b" some toxic words of a text "] * 9, [b" ordinary words of another one "] * 9, [b"toxic"])
    text = "ordinary words and some toxic words of a text that goes on for more than one window"
    plain, telling, toxic = (
        zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, min_match=toxicity.MIN_MATCH, write_content_size=False, write_dict_id=False))
        for d in (own.ordinary, own.telling + own.ordinary, own.toxic + own.ordinary)
    )
    words = text.encode().split()
    cut = [b" " + b" ".join(words[i : i + 8]) + b" " for i in range(0, len(words), 8)]
    expected = [[len(plain.compress(w)) - len(c.compress(w)) for w in cut] for c in (telling, toxic)]
    assert own.savings(text).tolist() == expected and max(expected[1]) > 3
    assert pickle.loads(pickle.dumps(own)).savings(text).tolist() == expected


def test_long_labelled_texts_teach(spark):
    texts, labels = corpus(400)
    texts = [t + " " + prose(10**6 + i, 9000, 2000) if labels[i][1] else t for i, t in enumerate(texts)]  # toxic ones are over 50,000 characters
    model = toxicity.learn(table(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert all(w.encode() in model.dictionaries.telling for w in BAD)


def test_missing_labels_and_rows(spark):
    docs = table(spark, ["a b", None])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.toxicity(docs, none).collect()] == [0.0, 0.0]
    assert toxicity.toxicity(table(spark, []), none).count() == 0
    assert toxicity.without_toxic(docs, none).count() == 2
