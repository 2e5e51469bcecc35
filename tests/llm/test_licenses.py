"""License scans against plain loops over all words, blocks and templates, and against their SQL."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tempestry.llm import licenses
from tempestry.llm.licenses import BLOCK, TEMPLATES, Template

COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, templates=TEMPLATES, threshold=0.9):
    longest = max(len(t.words()) for t in templates)
    out = []
    for d, text in rows:
        w = words_of(text)
        base, labels, score = [], set(), 0.0
        for t in templates:
            tw = words_of(t.text)
            if t.phrase:
                at = [i for i in range(len(w)) if w[i : i + len(tw)] == tw]
                base += [(i, t.label) for i in at]
                score = max(score, 1.0 if at else 0.0)
            else:
                for start in range(0, len(w), BLOCK):
                    share = len(set(tw) & set(w[start : start + BLOCK + longest - 1])) / len(set(tw))
                    if share >= threshold - 1e-9:
                        labels.add(t.label)
                        score = max(score, share)
        names = {x for _, x in base}
        places = [i for i, _ in base]
        out.append((d, len(w), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(names)), ",".join(sorted(labels | names)), score))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(12)
    filler = ["the", "of", "license", "public", "by", "cc", "all", "rights", "general", "version", "été", "x1", "under", "software", "a", "2", "0"]
    rows = [(1, None), (2, ""), (3, "CC-BY cc\nby CC BY by"), (4, "all rights reserved" * 3), (5, "general public licenses"), (6, "Kc by ÀLL rights reserved"), (None, "All Rights Reserved."), (None, "ccby cc  by")]
    for i in range(120):
        text = rng.choices(filler, k=rng.randint(0, 150))
        for _ in range(rng.randint(0, 2)):
            t = rng.choice(TEMPLATES).text.split()
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                t[rng.randrange(len(t))] = rng.choice(filler)
            if rng.random() < 0.2:
                rng.shuffle(t)
            at = rng.randint(0, len(text))
            text[at:at] = t
        rows.append((10 + i, rng.choice([" ", "\n", "-", ", "]).join(text)))
    return rows + rows[20:40] + [(500, "word " * 300_000 + "Released under the MIT License " + "x" * 3_000_000 + " cc by")]


def frame(spark, rows):
    extra = {c: F.lit(7) for c in ("row", "start", "token", "label", "blocks", "n_words", "score", "at")}
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(extra).repartition(3)


def found(spark, rows, **options):
    df = licenses.digest(*licenses.scan(frame(spark, rows), **options))
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_brute_force(spark):
    rows = corpus()
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("threshold", [0.5, 0.75, 1.0])
def test_other_templates_and_thresholds(spark, threshold):
    """Prefixes of several words, a template longer than a block, equal templates and ones without a match."""
    rng = random.Random(3)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    templates = [Template("long", " ".join(rng.choices(letters, k=80))), Template("mid", " ".join(letters[:12])), Template("mid2", " ".join(letters[:12])), Template("none", "zz yy"), Template("ab", "a b", True), Template("aa", "a a", True)]
    rows = [(i, " ".join(rng.choices(letters[: rng.choice([4, 13, 26])], k=rng.randint(0, 200)))) for i in range(60)] + [(100, templates[0].text), (101, "a a a b a a")]
    assert found(spark, rows, templates=templates, threshold=threshold) == brute(rows, templates, threshold)


def test_sql_is_the_same(spark):
    rows = [r for r in {r[0]: r for r in corpus()}.values() if r[0] is not None]
    con = duckdb.connect()
    con.register("documents", frame(spark, rows).select("doc_id", "text").toPandas())
    cur = con.execute(licenses.oracle_sql())
    assert [c[0] for c in cur.description] == COLUMNS
    assert sorted(cur.fetchall(), key=str) == found(spark, rows)


def test_planted_lines_and_clean_texts(spark):
    lines = {"Licensed under the Apache License, Version 2.0.": "apache-2.0", "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0", "nothing of the kind under the sun": ""}
    got = found(spark, [(i, f"some text\n{line}\nmore text") for i, line in enumerate(lines)])
    assert [r[6] for r in got] == list(lines.values())


def test_a_very_common_word_makes_no_pair(spark):
    """Pairs are joined on words of prefixes only: a text full of a template's common words gives no row."""
    rows = [(i, "the of a to for this under license public") for i in range(50)] + [(99, "reserved mit cc gnu")]
    counts = licenses.word_counts(frame(spark, rows), ["the", "mit", "absent"])
    assert counts == {"the": 50, "mit": 1, "absent": 0}
    table, met = licenses.scan(frame(spark, rows), licenses.PHRASES)
    assert met.count() == 0 and table.where("doc_id < 50 and size(blocks) > 0").count() == 0


def test_empty_table_and_wordless_template(spark):
    assert found(spark, [])  == []
    with pytest.raises(ValueError):
        licenses.scan(frame(spark, []), [Template("none", "...")])
