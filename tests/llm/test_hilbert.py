import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from tempestry.llm import hilbert
from tests.llm import corpus


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 4), (3, 3)])
def test_curve_visits_neighbours(dimensions, bits):
    cells = np.array([*product(range(1 << bits), repeat=dimensions)])
    place = hilbert.curve_index(cells, bits)
    assert sorted(place) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_shards(spark):
    texts = corpus.texts()
    rows = [(i, t, ["en", "fr", None][i % 3], f"src{i % 5}", "x") for i, t in enumerate(texts)] + [(3, texts[3], "en", "src3", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard string").repartition(3)
    found = hilbert.digest(hilbert.shards(docs, 24)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    counts = Counter(r.shard for r in found)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in found if r.shard == s) == list(range(n))
    order = [r.text_crc32 for r in sorted(found, key=lambda r: (r.shard, r.slot))]
    runs = sum(a != b for a, b in zip(order, order[1:], strict=False)) + 1
    assert runs == len(set(order))  # equal texts stand side by side
    few = hilbert.shards(docs.limit(3), 24).collect()
    assert len({r.shard for r in few}) == 3 and hilbert.shards(docs.limit(0), 24).count() == 0


def test_files_can_be_pruned(spark, tmp_path):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat(id, repeat(' ab', cast(id % 97 as int))) as text", "concat('l', id % 4) as lang", "concat('s', pmod(hash(id), 16)) as source")
    sharded = hilbert.shards(docs, 16).cache()
    hilbert.write_shards(docs, sharded, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 4000
    for column, values in (("lang", 4), ("source", 16)):
        per = back.selectExpr("shard", column).distinct().count() / 16
        assert per < 0.75 * values
