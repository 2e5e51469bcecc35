"""Encoding of whole texts inside tasks, with the tokenizers library and a bounded cache of words."""

from __future__ import annotations

import json
import os
import string
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: How a byte-level vocabulary writes a space at the start of a token.
SPACE = "Ġ"
#: Characters that are neither letters nor digits nor white space; a run of them after letters is a unit.
PUNCTUATION = string.punctuation
#: Bytes of text that are cut into words together.
CHUNK = 1 << 22
#: White space next to white space, or at an end of a text. All characters that \\s matches in the pre-tokenizer.
WHITE = "[\\t\\n\\v\\f\\r\\x{1c}-\\x{1f} \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
UNEVEN = rf"{WHITE}{WHITE}|\A{WHITE}|{WHITE}\z"


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) if b in prints else chr(256 + others.index(b)) for b in range(256)}


def strings(words: pa.Array | pa.ChunkedArray) -> list[str]:
    """As Python's strings; by numpy, since to_pylist() makes a scalar of each first."""
    return words.to_numpy(zero_copy_only=False).tolist() if isinstance(words, pa.Array) else words.to_numpy().tolist()


class WordTable:
    """Ids of words: a number for each word, and the ids of all of them in one array. Words used longest ago go first."""

    def __init__(self, limit: int):
        self.limit, self.turn = limit, 0
        self.number: dict[str, int] = {}
        self.start, self.length, self.used = (np.zeros(1024, dtype=np.int64) for _ in range(3))
        self.ids, self.filled = np.zeros(4096, dtype="<u4"), 0

    def add(self, words: Sequence[str], lengths: np.ndarray, ids: np.ndarray) -> None:
        n, more = len(self.number), len(words)
        if n + more > len(self.start):
            room = max(n + more, 2 * len(self.start))
            self.start, self.length, self.used = (np.resize(x, room) for x in (self.start, self.length, self.used))
        if self.filled + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, max(self.filled + len(ids), 2 * len(self.ids)))
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.length[n : n + more] = lengths
        self.start[n : n + more] = self.filled + np.cumsum(lengths) - lengths
        self.used[n : n + more] = self.turn
        self.filled += len(ids)
        self.number.update(zip(words, range(n, n + more), strict=True))

    def gathered(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of these words, one after the other."""
        lengths = self.length[numbers]
        places = np.repeat(self.start[numbers] - (np.cumsum(lengths) - lengths), lengths)
        places += np.arange(len(places))
        return self.ids[places]

    def shrink(self) -> None:
        """Keeps half the limit, once it's passed."""
        self.turn += 1
        n = len(self.number)
        if n <= self.limit:
            return
        kept = np.sort(np.argsort(-self.used[:n], kind="stable")[: self.limit // 2])
        words, all_words = [], list(self.number)
        words.extend(map(all_words.__getitem__, kept.tolist()))
        lengths, ids, used = self.length[kept], self.gathered(kept), self.used[kept]
        self.number, self.filled = {}, 0
        self.add(words, lengths, ids)
        self.used[: len(kept)] = used


class WordCachedEncoder:
    """Ids of whole texts by a tokenizers file whose pre-tokenizer is byte-level.

    That pre-tokenizer always starts a new token at a space between two characters that aren't white space, and makes
    a line feed between two such characters a token of its own, so a text is cut before each of them. The words of many
    texts are numbered together, each one that isn't in the table is encoded, and the words' ids are joined. Letters
    alone, with the space before them or without, are one unit to the pre-tokenizer and go to the model itself; a run
    of ASCII punctuation after nothing but letters is the next unit, so such words share the ids of their letters.
    Other words are encoded together, as one text; each of them starts at the only token with a space in front. A text
    with white space next to white space or at an end is encoded as one. Null is an empty text. Strings of special
    tokens within a text are ordinary text.

    In the table a word stands for itself after a space; with a line feed as its first character for itself after
    that, and with a carriage return for itself at the start of a text.
    """

    def __init__(self, path: str, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.byte_letters = {b: c for b, c in byte_letters().items() if b != 32}
        described = json.loads(self.tokenizer.to_str())
        plain = described | {"pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}
        self.letters = Tokenizer.from_str(json.dumps(plain))
        self.model = self.letters.model
        vocabulary = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.starts[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True
        self.line_feed = self.whole("\n").tolist()
        self.table = WordTable(limit)

    def whole(self, text: str) -> np.ndarray:
        (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found.ids, dtype="<u4")

    def in_letters(self, text: str) -> str:
        """The text's bytes, each as the vocabulary writes it; spaces stay."""
        return text if text.isascii() else text.encode().decode("latin-1").translate(self.byte_letters)

    def learn(self, fresh: pa.Array) -> None:
        """Puts distinct words that aren't in the table there."""
        number = self.table.number
        base = pc.utf8_rtrim(fresh, characters=PUNCTUATION)
        cut = pc.and_(pc.not_equal(base, fresh), pc.utf8_is_alpha(pc.utf8_ltrim(base, characters="\r\n")))
        bare, marked = base.filter(cut), strings(fresh.filter(cut))
        bases = pa.chunked_array([fresh.filter(pc.invert(cut)), bare]).unique()
        unknown = np.fromiter((w not in number for w in strings(bases)), bool, len(bases))
        bases = bases.filter(pa.array(unknown))
        leads = pc.match_substring_regex(bases, r"\A[\r\n]")
        alpha = pc.utf8_is_alpha(bases)
        spaced = strings(bases.filter(alpha))
        rest = strings(bases.filter(pc.invert(pc.or_(alpha, leads))))
        others = strings(bases.filter(leads))
        if spaced:
            self.keep(spaced, self.letters, self.in_letters(f" {' '.join(spaced)}").replace(" ", f" {SPACE}"))
        if rest:
            self.keep(rest, self.tokenizer, f" {' '.join(rest)}")
        if others:
            tokenize = self.model.tokenize
            found = []
            for w in others:
                if w[1:].isalpha():
                    found.append([t.id for t in tokenize(self.in_letters(w[1:]))])
                    if w[0] == "\n":
                        found[-1] = self.line_feed + found[-1]
                else:
                    found.append(self.whole(w.removeprefix("\r")).tolist())
            self.table.add(others, np.array([len(x) for x in found]), np.array([i for x in found for i in x], dtype="<u4"))
        if marked:
            bare = strings(bare)
            tails = [f"\r\r{w[len(base) :]}" for w, base in zip(marked, bare, strict=True)]
            for tail in {*tails}.difference(number):  # punctuation after a letter
                ids = self.whole(f"a{tail[2:]}")[len(self.whole("a")) :]
                self.table.add([tail], np.array([len(ids)]), ids)
            both = np.array([*map(number.__getitem__, bare), *map(number.__getitem__, tails)]).reshape(2, -1)
            self.table.add(marked, self.table.length[both].sum(axis=0), self.table.gathered(both.T.ravel()))

    def keep(self, words: list[str], tokenizer: object, text: str) -> None:
        """Puts the words into the table with their ids from those of their joined text."""
        (found,) = tokenizer.encode_batch_fast([text], add_special_tokens=False)
        ids = np.array(found.ids, dtype="<u4")
        edges = np.flatnonzero(self.starts[ids])
        if len(edges) != len(words):
            raise ValueError("the tokenizer doesn't start a token at each space; a byte-level one is needed")
        self.table.add(words, np.diff(edges, append=len(ids)), ids)

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Numbers in the table, after learning what isn't there."""
        coded = words.dictionary_encode()
        distinct, number = strings(coded.dictionary), self.table.number
        of_distinct = np.fromiter(map(number.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(of_distinct < 0)
        if len(missing):
            self.learn(coded.dictionary.take(pa.array(missing)))
            fresh = map(distinct.__getitem__, missing.tolist())
            of_distinct[missing] = np.fromiter(map(number.__getitem__, fresh), np.int64, len(missing))
        self.table.used[of_distinct] = self.table.turn
        return of_distinct[coded.indices.to_numpy()]

    def encode(self, texts: pa.Array, end: Sequence[int] = (), ids: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
        """(lengths, ids of all of them, without ``ids`` none) of runs of texts, each with the ids of ``end`` after it.

        A run is as many texts as have CHUNK bytes together, or one longer text.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        before = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())])
        at = 0
        while at < len(texts):
            until = max(at + 1, int(np.searchsorted(before, before[at] + CHUNK, side="right")) - 1)
            yield self.run(texts.slice(at, until - at), np.array(end, dtype="<u4"), ids)
            at = until

    def run(self, texts: pa.Array, end: np.ndarray, wanted: bool) -> tuple[np.ndarray, np.ndarray]:
        self.table.shrink()
        empty = pc.equal(pc.binary_length(texts), 0)
        odd = pc.or_(empty, pc.match_substring_regex(texts, UNEVEN)).to_numpy(zero_copy_only=False)
        even = texts.filter(pa.array(~odd))
        lengths = np.zeros(len(texts), dtype=np.int64)
        wholes = [self.whole(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        lengths[odd] = [len(x) for x in wholes]
        cut = pc.split_pattern(pc.replace_substring(even, "\n", " \n"), " ")
        words, edges = cut.flatten(), cut.offsets.to_numpy()
        first = edges[:-1] - edges[0]
        numbers = self.numbers(words)
        if len(even):
            opening = [f"\r{w}" for w in words.take(pa.array(first)).to_pylist()]
            numbers[first] = self.numbers(pa.array(opening, pa.large_string()))
            lengths[~odd] = np.add.reduceat(self.table.length[numbers], first)
        lengths += len(end)
        if not wanted:
            return lengths, np.array([], dtype="<u4")
        joined = self.table.gathered(numbers)
        if not len(end) and not wholes:
            return lengths, joined
        out = np.empty(int(lengths.sum()), dtype="<u4")
        after = np.cumsum(lengths)
        body = np.ones(len(out), dtype=bool)
        for k, i in enumerate(end.tolist()):
            body[after - len(end) + k] = False
            out[after - len(end) + k] = i
        for i, x in zip(np.flatnonzero(odd).tolist(), wholes, strict=True):
            place = slice(int(after[i] - lengths[i]), int(after[i] - lengths[i]) + len(x))
            out[place], body[place] = x, False
        out[body] = joined
        return lengths, out

    def __call__(self, texts: Sequence[str | None]) -> list[bytes]:
        """One bytes object for each text: ids as little-endian uint32."""
        out = []
        for lengths, ids in self.encode(pa.array(texts, pa.string())):
            edges = [0, *np.cumsum(4 * lengths).tolist()]
            joined = ids.tobytes()
            out += [joined[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> WordCachedEncoder:
    """This process's encoder: Spark's Python workers serve many tasks, which needn't load the vocabulary and learn the
    same words again. What it returns doesn't depend on what it has learnt."""
    return WordCachedEncoder(path)
