"""BPE against the tokenizer itself; language ID by held-out accuracy and its defined edge cases."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm.bpe import Encoder, bpe
from lodestone.llm.language_id import language_id

ODD = [
    None, "", " ", "a", "don't stop 'll", " x y", "é Éx", "Straße ΣΟΦΟΣ İstanbul", "<|endoftext|> a<|startoftext|>b", "\x1c\x1d a\x85b", "日本語テキスト" * 300, "👩‍👩‍👧 ok",
    "x" * 40_000, "12 345,678.90 --- ...", "tab\tnew\nline\x0bvt\x0cff\rcr",
]


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_chunks_join_to_what_the_tokenizer_gives(spark, tokenizer):
    rng = random.Random(1)
    letters = "ab cdé,.'\n 1中ß"
    texts = ODD + ["".join(rng.choices(letters, k=rng.randint(1, 6000))) for _ in range(20)]
    texts += [texts[20] + texts[21], texts[20]]
    df = spark.createDataFrame([(i, t, "ids") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    for average in (16, 1024):
        rows = {r.doc_id: r for r in bpe(df, average=average).collect()}
        assert len(rows) == len(texts)
        for i, t in enumerate(texts):
            ids = tokenizer.encode(t or "", add_special_tokens=False).ids
            decoded = tokenizer.decode(ids, skip_special_tokens=False)
            assert rows[i].ids == " ".join(map(str, ids)) and rows[i].decoded == decoded
            assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), sha(rows[i].ids), sha(decoded))


def test_equal_passages_are_cut_alike_and_encoded_once(tokenizer):
    import public_tokenizers

    rng = random.Random(2)
    passage = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)).encode()
    encoder = Encoder(public_tokenizers.path("word_bpe_49k.json"), average=256)
    for lead in (b"", b"some other words first ", b"x" * 777 + b" "):
        (got,) = encoder.texts([lead + passage])
        assert got.tolist() == tokenizer.encode((lead + passage).decode(), add_special_tokens=False).ids
    assert encoder.reused > encoder.encoded and not encoder.widened


def test_words_of_all_shapes_and_stores_that_forget(tokenizer):
    """Marks, bars, special tokens, cases and punctuation in one text, with stores so small that they start anew."""
    import public_tokenizers

    rng = random.Random(3)
    pieces = ["|", "a|b", "||", "Word,", "(word)", "WORD!", "<|endoftext|>", "<|ENDOFTEXT|>", "word<|startoftext|>,", "don't", "rock'n'roll's", "e\u0301", "\u0301x", "x\u00a0y", "...", "a.b", "\u037e", "3rd", "\u00bd", "ÑandÚ,", "¿Qué?", "naïve-Über", "ÿ×÷", "Straße."]
    texts = [" ".join(rng.choices(pieces, k=400)) for _ in range(12)]
    encoder = Encoder(public_tokenizers.path("word_bpe_49k.json"), average=64, words=3, chunk_bytes=1000)
    assert encoder.direct
    for t in texts:
        (got,) = encoder.texts([t.encode()])
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert got.tolist() == ids
        assert encoder.decode(got) == tokenizer.decode(ids, skip_special_tokens=False)


def test_language_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    docs = spark.read.parquet(path)
    rows = docs.select("doc_id", "lang").join(language_id(docs).select("doc_id", "lang_pred", "score", "held_out"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95


def test_language_edge_cases(spark):
    rows = [(i, "the cat sat on the mat and then it ran " * (i % 4 + 1), "en") for i in range(40)] + [(100 + i, "der hund ist nicht auf dem tisch und schläft " * (i % 3 + 1), "de") for i in range(40)]
    rows += [(200, None, "en"), (201, "", None), (202, "12 34 --", "de"), (None, "der hund und der tisch", None), (0, "the cat sat", "en")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in language_id(df).collect()}
    assert language_id(df).count() == len(rows)
    assert [got[i].lang_pred for i in (200, 201, 202)] == ["und"] * 3 and got[200].score == 0
    assert got[None].lang_pred == "de" and got[None].held_out is False
    assert got[3].lang_pred == "en" and got[103].lang_pred == "de"
    empty = df.limit(0)
    assert language_id(empty).count() == 0
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id(unlabelled).collect()} == {"und"}


def test_every_language_is_learned(spark):
    """More languages than 64, each of other words; the rarest ones are told apart too."""
    rng = random.Random(6)
    rows = []
    for k in range(70):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(12)]
        rows += [(len(rows) + i, " ".join(rng.choices(words, k=40)), f"l{k:02}") for i in range(12 if k < 60 else 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for fitting in ({}, {"rows_in_all": 140, "landmarks_in_all": 140}):
        got = language_id(df, **fitting).collect()
        assert sum(r.lang == r.lang_pred for r in got) > 0.95 * len(got)
        assert {r.lang_pred for r in got} == {r[2] for r in rows}


def test_only_letters_count_as_letters(spark):
    texts = ["½ ² ① 12", "Ⅷ 5", "٣٤", "a1", "ª", "中", "_"]
    rows = [(i, "the cat sat on the mat", "en") for i in range(9)] + [(100 + i, t, None) for i, t in enumerate(texts)]
    got = {r.doc_id: r.lang_pred for r in language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[100 + i] != "und" for i in range(len(texts))] == [any(c.isalpha() for c in t) for t in texts]


def test_agrees_with_dense_kernel_ridge_regression(spark):
    """All rows as landmarks: the Nyström model is then the plain one, solved here in its dual form over sets of n-grams."""
    import numpy as np

    from lodestone.llm.language_id import fit, presence

    rng = random.Random(8)
    words = {"a": "lorem ipsum dolor sit amet magna".split(), "b": "the cat sat upon mats dolor".split(), "c": "der hund sitzt magna unter cat".split()}
    rows = [(i, " ".join(rng.choices(words[k], k=rng.randint(3, 12))), k) for i in range(60) for k in [rng.choice("abc")]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = [r for r in df.select("doc_id", "text", "lang", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("out")).collect() if not r.out]
    asked = ["the cat", "der hund unter dem tisch", "magna dolor ipsum", "zz"] + [t for _, t, _ in rows]
    grams = lambda t: {t.encode()[i : i + n] for n in (1, 2, 3) for i in range(len(t.encode()) - n + 1)}
    kernel = lambda one, other: np.array([[len(a & b) / (len(a) * len(b)) ** 0.5 for b in other] for a in one])
    own = [grams(r.text) for r in learned]
    lang = [r.lang for r in learned]
    target = np.array([[1.0 if x == k else -1.0 for k in "abc"] for x in lang])
    weight = np.array([len(lang) / (3 * lang.count(x)) for x in lang])
    alpha = np.linalg.solve(kernel(own, own) + 1 + 1e-2 * np.diag(1 / weight), target)
    want = (kernel([grams(t) for t in asked], own) + 1) @ alpha
    model = fit(df, landmarks=100, ridge=1e-2)
    best, score = model.decide(presence([t.encode() for t in asked], 3))
    assert len(model.landmarks.T) == len(learned)
    sure = np.sort(want, axis=1)[:, -1] - np.sort(want, axis=1)[:, -2] > 0.1
    assert sure.sum() > 50 and (best[sure] == want.argmax(1)[sure]).all()
    assert np.abs(score - np.clip((want.max(1) + 1) / 2, 0, 1)).max() < 0.03


def test_clashing_names_and_long_texts(spark):
    rows = [(i, "the cat sat on the mat " * (20_000 if i == 3 else 2), "en", "x", True) for i in range(12)] + [(50, "der hund " * 30_000, "de", "y", None), (51, "der hund ist da", "de", "y", None), (53, "der hund ist da", "de", "y", None)]
    got = {r.doc_id: r for r in language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, held_out boolean")).collect()}
    assert len(got) == len(rows) and got[3].lang_pred == "en" and got[50].lang_pred == "de" and got[50].held_out is not None
