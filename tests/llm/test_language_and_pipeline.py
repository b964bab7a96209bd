from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import langid, mixing, neardup, pieces, secrets
from tests.llm.helpers import docs_of
from tests.llm.test_neardup import brute


def test_block_marginals_equal_plain_recursion():
    rng = np.random.default_rng(0)
    t = rng.random((4, 4)) + 0.05
    sequences = [rng.random((n, 4)) + 0.01 for n in (1, 2, 31, 32, 33, 64, 65, 700, 5)]

    def plain(e):
        a, alphas = np.full(4, 0.25), []
        for x in e:
            a = (a @ t) * x
            a /= a.sum()
            alphas.append(a)
        b, total = np.ones(4), 0
        for x, a in zip(e[::-1], alphas[::-1]):
            m = a * b
            total = total + m / m.sum()
            b = t @ (x * b)
            b /= b.sum()
        return total

    assert np.allclose(langid.block_marginals(sequences, t), [plain(e) for e in sequences])


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == rows[r["doc_id"]]["lang"] for r in held) > 0.95 * len(held)


def test_labels_of_held_out_rows_have_no_part(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    other = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1 THEN 'zz' ELSE lang END AS lang", "'x' AS source")
    a = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs).collect()}
    assert a == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(other).collect()}


def test_code_switched_text_is_labelled_by_word(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars > 400").collect()
    by = {lang: [langid.words_of(r["text"])[:40] for r in docs if r["lang"] == lang] for lang in ("en", "de")}
    model = langid.train([(r["text"], r["lang"]) for r in docs])
    scorer = langid.Scorer(model)
    en, de = model.languages.index("en"), model.languages.index("de")
    mixed = [a + b for a, b in zip(by["en"], by["de"])]
    means = scorer.marginals(mixed)
    assert np.abs(means[:, en] - 0.5).mean() < 0.1 and np.abs(means[:, de] - 0.5).mean() < 0.1


def test_new_words_are_scored_together(monkeypatch):
    rng = np.random.default_rng(1)
    words = ["a", "zu", "été", "ß", "漢", "漢字", "x\U00020000y", "ⅷa", "p", "sp"]
    words += ["".join(rng.choice(list("abcdef"), int(n))) for n in rng.integers(1, 30, 3000)]
    words = list(dict.fromkeys(words))
    model = langid.Model(["de", "en"], rng.standard_normal((langid.SLOTS, 2)).astype(np.float32), np.zeros((2, 2)), {"a": (0, 1), "zu": (0,)})
    want = [langid.features(w, model.lexicon) for w in words]
    slots, begins = langid.Scorer(model).slots(words)
    assert [s.tolist() for s in np.split(slots, begins[1:])] == want
    hashed = []
    crc32 = zlib.crc32
    monkeypatch.setattr(langid.zlib, "crc32", lambda data: hashed.append(data) or crc32(data))
    scorer = langid.Scorer(model)
    scorer.by_word([words[:50], ["²", *words], ["a"]])
    # An n-gram is hashed once, whatever the number of words that hold it.
    assert 3 * len(hashed) < sum(len(w) for w in words)
    assert scorer["²"] == -1 and scorer.rows == len(words) and not scorer.new
    for word, row in zip(words, want):
        score = model.weights[row].sum(axis=0)
        assert np.allclose(scorer.table[scorer[word]], np.exp(score - score.max()), rtol=1e-5)
    alone = langid.Scorer(model)
    alone.by_word([[words[-1]]])
    assert (alone.table[0] == scorer.table[scorer[words[-1]]]).all()


def test_language_of_odd_texts(spark):
    rows = [(i, "the cat and the dog went out", "en", "s", 1) for i in range(9)] + [(i, "der Hund und die Katze", "de", "s", 1) for i in range(9, 18)]
    rows += [(20, None, "en", "s", 1), (21, "", None, "s", 1), (22, "123 ½ ²!", "de", "s", 1), (23, "the dog " * 30000, None, "s", 1), (None, "und die", None, None, None), (24, "the", "en", "s", 1), (24, "the", "en", "s", 1)]
    docs = docs_of(spark, rows).selectExpr("*", "1 AS score", "2 AS held_out", "3 AS rank", "4 AS draw")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert [got[i]["lang_pred"] for i in (20, 21, 22)] == ["und"] * 3 and got[20]["score"] == 0
    assert got[23]["lang_pred"] == "en" and got[None]["lang_pred"] == "de" and got[None]["held_out"] is False
    none = langid.identify(docs.selectExpr("doc_id", "text", "cast(null AS string) AS lang"))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_stages_against_plain_forms(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    one = corpus_pipeline.identify_language(spark, docs, sf_dir)
    assert one.columns == columns
    model = langid.fit(docs, F.lit(True))
    found = langid.predict(docs, model).where("lang_pred <> 'und' AND score >= 0.5")
    assert {(r["doc_id"], r["lang"]) for r in one.collect()} == {(r["doc_id"], r["lang_pred"]) for r in found.collect()}
    two = corpus_pipeline.drop_near_duplicates(spark, one, sf_dir)
    groups = brute([(r["doc_id"], r["text"]) for r in one.collect()])
    assert two.columns == columns and {r["doc_id"] for r in two.collect()} == {i for i, c in groups.items() if i == c}
    three = corpus_pipeline.mask_secrets(spark, two, sf_dir)
    assert three.columns == columns and three.count() == two.count()
    assert not [r for r in secrets.findings(three, secrets.scan_unseen(three)).collect() if any(s["kind"] in ("hex", "access") for s in r["spans"])]
    four = corpus_pipeline.mix_sources(spark, three, sf_dir)
    taken = {r["doc_id"]: r["taken"] // max(r["size"], 1) for r in mixing.mix(three).collect() if r["size"]}
    times = {r["doc_id"]: r["count"] for r in four.groupBy("doc_id").count().collect()}
    assert four.columns == columns and all(times.get(i, 0) == n for i, n in taken.items())
    five = corpus_pipeline.encode_pieces(spark, four, sf_dir)
    texts = {r["doc_id"]: r["text"] for r in four.collect()}
    assert five.count() == four.count()
    assert all(r["decoded"] == texts[r["doc_id"]].replace(pieces.MARK, " ") for r in five.collect())


def test_pipeline_runs_on_odd_documents(spark, tmp_path):
    rows = [(i, f"the cat {i} and the dog went out of house number {i} today", "en", "a", 1) for i in range(12)]
    rows += [(i, f"der Hund {i} und die Katze gehen heute aus dem Haus", "de", None, 1) for i in range(12, 20)]
    rows += [(30, None, None, None, None), (31, "", "en", "a", 0), (None, "the the dog and cat", "en", "b", 1), (0, rows[0][1], "en", "a", 1), (32, "the dog " * 25000, "en", "b", 1)]
    docs = docs_of(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(r["decoded"] is not None for r in out)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0
    assert neardup.keep_one(docs).count() < len(rows)


def test_runs_of_code_switched_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars > 400").collect()
    model = langid.train([(r["text"], r["lang"]) for r in docs])
    by = {lang: [" ".join(langid.words_of(r["text"])[:40]) for r in docs if r["lang"] == lang] for lang in ("en", "de")}
    texts = [f"{a}. {b}" for a, b in zip(by["en"], by["de"])]
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, "12 !?")]
    runs = {r["doc_id"]: r["runs"] for r in langid.label_words(docs_of(spark, rows), model).collect()}
    assert runs[900] == runs[901] == runs[902] == []
    right = words = 0
    for i, (a, b) in enumerate(zip(by["en"], by["de"])):
        assert [r["end"] <= s["start"] for r, s in zip(runs[i], runs[i][1:])] == [True] * (len(runs[i]) - 1)
        for m in langid._WORD.finditer(texts[i]):
            run = next(r for r in runs[i] if r["start"] <= m.start() and m.end() <= r["end"])
            words += 1
            right += run["lang"] == ("en" if m.start() < len(a) else "de")
    assert right > 0.95 * words
    # An even mix keeps its document: its words are certain, although no language leads.
    found = langid.predict(docs_of(spark, rows[: len(texts)]), model).collect()
    assert np.mean([r["certainty"] for r in found]) > 0.9 and np.mean([r["score"] for r in found]) < 0.65
