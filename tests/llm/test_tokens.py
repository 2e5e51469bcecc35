"""Operators 1, 4 and 9 against the tokenizers library itself."""

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tempestry.llm import common, id_files, lengths, packing
from tempestry.llm.tokens import WordCachedEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "The cat  sat.\nOn a mat ", "", None, " lead", "a\n \nb c", "x \ty z", "éàü ñ 12 345.67 don't we'll", "end\n\n next", "tab\tx y z w",
    "word " * 5000 + "end", "same text", "same text", "a" * 9000, "<|endoftext|> here", "　 wide", "x  y",
]


@pytest.fixture(scope="module")
def truth():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in TEXTS]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start int").repartition(3)


def test_cached_encoder_equals_library(truth):
    encode = WordCachedEncoder(PATH, limit=7)
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() + [0] for b in encode(TEXTS)] == truth


def test_cached_encoder_on_mixed_characters():
    rng = random.Random(3)
    signs = [
        "a", "Bc", "é", "日", "'s", "'", "\n", "\n", " ", " ", " ", ".", ",", "!!", "1", "²", "\t", "\xa0", "x_y", "'ll", "Ⅷ", "🙂", "\u0301", "\n'",
    ]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(5000)]
    tokenizer = Tokenizer.from_file(PATH)
    encode = WordCachedEncoder(PATH, limit=2000)
    for at in range(0, len(texts), 64):
        for text, ids in zip(texts[at : at + 64], encode(texts[at : at + 64]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("window", [16, 1024])
def test_packing_covers_each_id_once(docs, truth, window):
    rows = packing.pack(docs, PATH, window=window).collect()
    got, sequences = {}, {}
    for r in rows:
        assert r.length == len(r.ids) // 4
        got.setdefault(r.doc_id, []).append((r.start, r.ids))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, ids in enumerate(truth):
        pieces = sorted(got[i])
        assert b"".join(p for _, p in pieces) == np.array(ids, "<u4").tobytes()
        assert [s for s, _ in pieces] == np.cumsum([0, *(len(p) // 4 for _, p in pieces)])[:-1].tolist()
    assert None in got
    filled = []
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= window
        filled.append(at)
    assert sum(x < window for x in filled) <= 4  # one a task
    assert {r.ids_crc32 for r in packing.packed_digest(packing.pack(docs, PATH, window=window)).collect()} == {zlib.crc32(r.ids) for r in rows}


def test_sum_of_squares_choice():
    w = packing.Windows(10)
    for size in (6, 6, 4, 3):
        w.place((0, 0, bytes(4 * size), size))
    # the 4 closes a window of level 6, which there were two of; the 3 opens a window, as levels 9 and 3 are as empty and a new one keeps level 6 at one
    assert len(w.closed) == 1
    assert w.levels[6] + w.levels[9] + w.levels[3] in (1, 2)
    assert w.levels.tolist() == [sum(1 for _ in x) for x in w.open]


def test_files_round_trip(spark, docs, truth):
    path = common.new_path(spark, "ids")
    manifest = id_files.write_files(docs, PATH, path)
    rows = sorted(id_files.read_files(spark, path, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, *range(len(TEXTS))]
    assert [r.ids for r in rows[1:]] == [np.array(x, "<u4").tobytes() for x in truth]
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()


def read(content: bytes) -> list[tuple[int, bytes]]:
    out = []
    for names, lengths, ids in id_files.read_file(io.BytesIO(content), len(content)):
        edges = np.cumsum([0, *lengths])
        out += [(n, ids[a:b].tobytes()) for n, a, b in zip(names.tolist(), edges, edges[1:], strict=False)]
    return out


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 4097, id_files.BLOCK + 3])
def test_block_code(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 70_000).astype("<u4")
    documents = [(7, ids[: n // 2].tobytes()), (None, ids[n // 2 :].tobytes()), (9, b"")]
    out = io.BytesIO()
    writer = id_files.FileWriter(out)
    for name, x in documents:
        x = np.frombuffer(x, "<u4")
        writer.add(np.array([id_files.NULL_ID if name is None else name]), np.array([len(x)]), x)
    writer.finish()
    assert read(out.getvalue()) == [(id_files.NULL_ID if name is None else name, x) for name, x in documents]
    wide = np.arange(70_000, dtype="<u4")
    assert (id_files.decode_block(id_files.encode_block(wide)) == wide).all()


def test_damaged_files_are_an_error(spark, docs):
    for content in (b"", b"x" * 100):
        with pytest.raises(ValueError):
            read(content)
    path = common.new_path(spark, "ids")
    manifest = id_files.write_files(docs, PATH, path)
    name = f"{path.removeprefix('file://')}/{manifest.first()['name']}"
    with open(name, "rb+") as f:
        f.truncate(60)
    with pytest.raises(Exception, match="cut short"):
        id_files.read_files(spark, path, manifest).count()


def test_small_files(spark, docs, truth):
    path = common.new_path(spark, "ids")
    manifest = id_files.write_files(docs.repartition(1), PATH, path, file_ids=20)
    assert manifest.count() >= 4
    rows = sorted(id_files.read_files(spark, path, manifest).collect(), key=lambda r: r.start)
    assert [r.ids for r in rows[1:]] == [np.array(x, "<u4").tobytes() for x in truth]
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()


def test_histogram(spark, docs, truth):
    table = lengths.length_table(lengths.length_counts(docs.where("doc_id is not null"), PATH))
    sizes = np.array([len(x) for x in truth])
    for r in table.collect():
        assert r.n_docs == (sizes == r.length).sum() and r.docs_at_least == (sizes >= r.length).sum()
        assert r.tokens_at_least == sizes[sizes >= r.length].sum() and r.truncated_total == np.minimum(sizes, r.length).sum()
        assert r.quantile == (sizes <= r.length).mean()
    assert {r.limit: (r.n_longer, r.truncated_total) for r in lengths.totals_for(table, [1, 5, 77, 10**6]).collect()} == {x: ((sizes > x).sum(), np.minimum(sizes, x).sum()) for x in (1, 5, 77, 10**6)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    path = common.new_path(spark, "ids")
    assert packing.pack(none, PATH).count() == 0
    assert id_files.read_files(spark, path, id_files.write_files(none, PATH, path)).count() == 0
    assert lengths.length_table(lengths.length_counts(none, PATH)).count() == 0
