import base64
import random

import numpy as np

from tempestry.llm import langid

SYLLABLES = {"aa": ["the", "ing", "and", "ou", "sh"], "bb": ["ción", "que", "ar", "os", "ñe"], "cc": ["sch", "ung", "ei", "ü", "ten"]}


def make(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        rows.append((i, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 60))), lang))
    return rows


def test_held_out_accuracy(spark):
    rows = make(1, 600)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(docs.where(~langid.held_out()), sample=80)
    assert set(model.languages) == set(SYLLABLES) and len(model.languages) > len(SYLLABLES)
    found = langid.identify(docs.select("doc_id", "text"), model).collect()
    truth = {i: lang for i, _, lang in rows}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in found]) > 0.95
    assert all(0 <= r.score <= 1 for r in found)
    assert sum(r.rejected for r in found) == 0
    again = langid.fit(docs.where(~langid.held_out()).repartition(5), sample=80)
    assert np.allclose(again.centroids, model.centroids, atol=1e-5)


def test_odd_texts(spark):
    docs = spark.createDataFrame(make(2, 200), "doc_id long, text string, lang string")
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, None, "aa", 1), (2, "", "x", 1), (3, "123 %% \n", None, 1), (4, "qqxz" * 4000, "aa", 1), (None, "the and thing", "aa", 1), (6, "é", "aa", 1)], "doc_id long, text string, lang string, score int")
    found = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and found[6].lang_pred != "und" and found[None].lang_pred == "aa"
    assert found[4].rejected and not found[None].rejected
    assert sorted(str(r.doc_id) for r in langid.accepted(odd, model).collect()) in (["6", "None"], ["None"])
    assert langid.accepted(odd, model).columns == odd.columns
    assert langid.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}
    assert langid.identify(odd.limit(0), model).count() == 0


def test_unlearned_texts_are_rejected(spark):
    folder = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(folder)
    model = langid.fit(docs.where(~langid.held_out()))
    rng = random.Random(1)
    odd = [
        "Tänään on kaunis päivä ja lapset leikkivät pihalla koiran kanssa, kun aurinko paistaa kirkkaasti taivaalta.",
        "Bugün hava çok güzel ve çocuklar bahçede köpekle oynuyorlar, güneş parlak bir şekilde gökyüzünde parlıyor.",
        "Dzisiaj jest piękny dzień i dzieci bawią się w ogrodzie z psem, gdy słońce świeci jasno na niebie.",
        " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(30)),
        base64.b64encode(bytes(rng.randrange(256) for _ in range(1500))).decode(),
    ]
    rows = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    assert all(r.rejected for r in langid.identify(rows, model).collect())
    clean = docs.where(langid.held_out())
    first = clean.selectExpr("doc_id", "substring_index(text, ' ', 12) AS text")  # a short text of each
    for texts in (clean, first):
        found = langid.identify(texts, model).where("lang_pred != 'und'").collect()
        assert len(found) > 200 and sum(r.rejected for r in found) <= 0.01 * len(found), sum(r.rejected for r in found)
