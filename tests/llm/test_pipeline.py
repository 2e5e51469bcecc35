"""The pipeline's stages, each on what its predecessor kept, against brute-force versions."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import corpus
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_line_dedup import key
from tests.llm.test_ngram_join import brute as groups

SYLLABLES = {"en": ["the", "ing", "and", "ou", "sh"], "es": ["ción", "que", "ar", "os", "ñe"]}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    say = lambda lang, n: " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    items = [(i, say("en", 30)) for i in range(4)]
    rows = []
    for i in range(120):
        lang = rng.choice(["en", "es"])
        lines = [say(lang, rng.randint(5, 60)) for _ in range(rng.randint(1, 4))]
        if i % 9 == 0:
            lines.insert(1, " All Rights reserved ")
        if i % 10 == 1:
            lines[-1] += " " + items[i % 4][1] + " " + say(lang, 5)
        rows.append((i, "\n".join(lines), lang, f"src{i % 3}", i))
    rows += [(200 + i, rows[i][1] + " extra", "en", "src0", 1) for i in (2, 3, 4)] + [(300 + i, rows[i][1], None, None, None) for i in (2, 5)]
    rows += [(400, None, "en", "src1", 0), (401, "", "en", "src1", 0), (402, "123 %%%", "en", "src1", 7), (403, "漢字かな交じり文" * 40, None, "src1", 9), (None, say("en", 40), "en", "src2", 3), (2, rows[2][1], rows[2][2], rows[2][3], rows[2][4])]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), rows, items


def ids(rows):
    return sorted((-1 if r[0] is None else r[0]) for r in rows)


def test_stages(spark, folder):
    path, rows, items = folder
    docs, columns = spark.read.parquet(f"{path}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == columns
        kept[name] = [tuple(r) for r in docs.collect()]
        docs = spark.createDataFrame(kept[name], docs.schema)
    assert ids(kept["language_id"]) == ids(r for r in rows if r[0] not in (400, 401, 402, 403))

    seen = {}
    for d, text, *_ in {(r[0], r[1]) for r in kept["language_id"]}:
        for k in {key(x) for x in text.split("\n")} - {""}:
            seen.setdefault(k, set()).add((d, text))
    clean = lambda text: "\n".join(x for x in text.split("\n") if len(seen.get(key(x), ())) < 10)
    assert sorted(map(str, kept["line_dedup"])) == sorted(str((r[0], clean(r[1]), *r[2:])) for r in kept["language_id"])
    assert any("All Rights" in r[1] for r in rows if r[1]) and not any("All Rights" in r[1] for r in kept["line_dedup"])

    named = [r for r in kept["line_dedup"] if r[0] is not None]
    first = {}
    for i, _, root in sorted(groups([r[1] for r in named])):
        first[root] = min(first.get(root, 10**9), named[i][0])
    stay = {named[i][0] for i, _, root in groups([r[1] for r in named]) if named[i][0] == first[root]}
    assert ids(kept["near_duplicates"]) == ids(r for r in kept["line_dedup"] if r[0] is None or r[0] in stay)

    gone = {d for d, _ in leaks([r[:2] for r in kept["near_duplicates"]], items)}
    assert gone and ids(kept["decontamination"]) == ids(r for r in kept["near_duplicates"] if r[0] not in gone)

    pieces = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in pieces} == {r[0] for r in kept["decontamination"]}
    filled = {}
    for r in pieces:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert max(filled.values()) <= 1024


def test_clashing_columns(spark, folder):
    """Every name that the operators use inside, as an extra column of documents."""
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(40)
    names = (
        "n_lines n_dropped gone_id key row row_id row_text drops kept h1 h2 position word bits node component shingle "
        "component_id n_shingles text_hash item_id start windows w lang_pred score rejected ids length sequence_id"
    ).split()
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(i))
    docs = docs.withColumn("a.b", F.lit("dot"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        (row,) = out.select(*(F.min(f"`{n}`").alias(n) for n in names)).collect()
        assert list(row) == list(range(len(names)))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, path).count() >= 40


def test_empty_table(spark, folder, tmp_path):
    path, _, items = folder
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
