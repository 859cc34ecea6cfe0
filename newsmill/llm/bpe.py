"""Byte-pair encoding over a segment tree of adjacent pair ranks, and decoding.

The leaves of a word's tree are the ranks of its adjacent pairs, each with its
place; the root is the leftmost pair of lowest rank.  A merge changes three
leaves, and each change goes up a logarithmic path.  Words of like length share
one array of trees, so numpy does a step of thousands of words at once.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from newsmill.llm.common import id_and_text, ship, table

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
#: Pieces of text, and pre-tokens, that a worker remembers in each of two generations.
CACHE_PIECES = 300_000
#: Characters of text that are split into pieces at a time.
CHUNK_CHARS = 4_000_000
#: Symbols of the words that are merged together; their trees should fit a core's cache.
_CELLS = 1 << 15
_NONE = np.iinfo(np.int64).max
#: The pattern that byte-level pre-tokenizing stands for in tokenizer files.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [spare.get(b, chr(b)) for b in range(256)]


class Memory:
    """What ``make`` works out of distinct keys, for those met lately.

    When the young generation is full it becomes the old one; what is asked for again
    moves from the old to the young, the rest goes with the next change.
    """

    def __init__(self, make: Callable[[list[str]], list], most: int = CACHE_PIECES):
        self.make, self.most = make, most
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def of(self, keys: list[str]) -> list:
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = [k for k in keys if k not in young]
        new = [k for k in missing if k not in old]
        young.update((k, old[k]) for k in missing if k in old)
        if new:
            young.update(zip(new, self.make(new)))
        return list(map(young.__getitem__, keys))


def coded(lists: list[list[str]]) -> tuple[list[str], pa.Array, np.ndarray]:
    """The distinct strings of all lists, each string's place among them in order, and where each list begins and ends."""
    flat = pa.array(list(chain.from_iterable(lists)), pa.string()).dictionary_encode()
    return flat.dictionary.to_pylist(), flat.indices, np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64)))


def joined(values: list[bytes], places: pa.Array, ends: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The values at ``places``, end to end, and where those of each list begin and end."""
    taken = pa.array(values, pa.large_binary()).take(places)
    offsets = np.frombuffer(taken.buffers()[1], dtype=np.int64)[: len(taken) + 1] if len(taken) else np.zeros(1, dtype=np.int64)
    return memoryview(taken.buffers()[2] or b""), offsets[ends]


class Encoder:
    """A byte-level BPE tokenizer read from a tokenizers JSON file; text that spells a special token is one."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"]["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        letters = byte_letters()
        self.byte_ids = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last_ids = np.array([vocab[c + suffix] for c in letters], dtype=np.int64)
        pairs = [(vocab[a] << 20 | vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)]
        table_ = np.array(pairs, dtype=np.int64)
        # of a pair listed twice the last rank counts, as in a map filled in order
        _, last = np.unique(table_[::-1, 0], return_index=True)
        table_ = table_[::-1][last]
        self.pair_keys, self.pair_ranks, self.pair_ids = (np.ascontiguousarray(c) for c in table_.T)
        kinds = {n["type"] for n in (spec["normalizer"] or {"normalizers": []})["normalizers"]}
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        pattern = next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), _BYTE_LEVEL)
        self.splitter = _splitter(pattern)
        self.blank_free = r"\s+" not in pattern and " " not in pattern
        self.special_splitter = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        self.known_words = Memory(lambda words: [i.astype("<u4").tobytes() for i in self.encode_words(words)])

    def pieces(self, text: str) -> list[str]:
        """Parts of the normalised text that are encoded apart: the pre-tokens, or what lies between
        white space if no pre-token has any; special tokens as they are."""
        if self.special_splitter and any(s in text for s in self.specials):
            found = []
            for k, part in enumerate(self.special_splitter.split(text)):
                found += [part] if k % 2 else self.pieces(part)
            return found
        if self.nfc:
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.replace("Σ", "σ").lower()  # no final sigma: letters are mapped one by one
        if self.blank_free and not _odd_characters().search(text):
            return text.split()
        return self.splitter(text)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of the distinct ``pieces``, as little-endian 32-bit bytes; their pre-tokens are remembered."""
        words = [[p] if p in self.specials else self.splitter(p) for p in pieces]
        distinct = list(set().union(*words))
        ids = dict(zip(distinct, self.known_words.of(distinct)))
        return [ids[w[0]] if len(w) == 1 else b"".join([ids[x] for x in w]) for w in words]

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each pre-token."""
        out: list[np.ndarray | None] = [None] * len(words)
        by_size: dict[int, list[int]] = {}
        raw = [w.encode() for w in words]
        for i, w in enumerate(words):
            if w in self.specials:
                out[i] = np.array([self.specials[w]], dtype=np.int64)
            else:
                by_size.setdefault(max(1, (len(raw[i]) - 1).bit_length()), []).append(i)
        for bits, members in by_size.items():
            step = max(1, _CELLS >> bits)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                for i, ids in zip(part, self._merge([raw[i] for i in part], 1 << bits)):
                    out[i] = ids
        return out

    def _pair(self, a: np.ndarray, b: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and merged ids of the pairs (a, b); no rank where not ``ok`` or not mergeable."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        ok = ok & (self.pair_keys[at] == key)
        return np.where(ok, self.pair_ranks[at], _NONE), self.pair_ids[at]

    def _merge(self, raw: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of words of at most ``width`` bytes (a power of two)."""
        n, sizes = len(raw), np.array([len(w) for w in raw])
        cells = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in raw), dtype=np.uint8).reshape(n, width)
        ids = self.byte_ids[cells]
        rows = np.arange(n)
        ids[rows, sizes - 1] = self.last_ids[cells[rows, sizes - 1]]
        place = np.arange(width)
        following = np.broadcast_to(place + 1, (n, width)).copy()  # of each symbol the next one's place
        preceding = np.broadcast_to(place - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), _NONE, dtype=np.int64)
        pair_ok = place[:-1] + 1 < sizes[:, None]
        ranks, _ = self._pair(ids[:, :-1], ids[:, 1:], pair_ok)
        leaf = np.full((n, width), _NONE, dtype=np.int64)
        leaf[:, :-1] = np.where(ranks < _NONE, ranks << 32 | place[:-1], _NONE)
        tree[:, width:] = leaf
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        gone = np.arange(width) >= sizes[:, None]

        def put(w: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node = at + width
            tree[w, node] = value
            while (node := node >> 1)[0]:
                tree[w, node] = np.minimum(tree[w, 2 * node], tree[w, 2 * node + 1])

        active = rows
        while len(active := active[tree[active, 1] < _NONE]):
            at = tree[active, 1] & 0xFFFFFFFF
            right = following[active, at]
            ids[active, at] = self._pair(ids[active, at], ids[active, right], np.True_)[1]
            after, before = following[active, right], preceding[active, at]
            gone[active, right] = True
            following[active, at] = after
            put(active, right, np.full(len(active), _NONE))
            more = after < sizes[active]
            w, a, b = active[more], at[more], after[more]
            preceding[w, b] = a
            later = np.full(len(active), _NONE)
            later[more] = self._ranked(ids[w, a], ids[w, b], a)
            put(active, at, later)
            prior = before >= 0
            if prior.any():
                w, a, b = active[prior], before[prior], at[prior]
                put(w, a, self._ranked(ids[w, a], ids[w, b], a))
        keep = ~gone
        return np.split(ids[keep], np.cumsum(keep.sum(axis=1))[:-1])

    def _ranked(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        ranks, _ = self._pair(a, b, np.True_)
        return np.where(ranks < _NONE, ranks << 32 | at, _NONE)

    def decode(self, ids: np.ndarray) -> str:
        """The tokens joined by spaces, as files without a decoder have it; special tokens stay."""
        return " ".join(self.tokens[i] for i in ids.tolist())


def _splitter(pattern: str) -> Callable[[str], list[str]]:
    r"""findall of a pattern with \p{L} and \p{N}.

    The standard library's engine is the faster one; its [^\W\d_] is \p{L} and its
    \d is \p{N} unless a text has numerals that are no decimal digits, or the
    separators 1C-1F that only it takes for white space.
    """
    exact = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    quick = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"[\p{L}]", r"[^\W\d_]").replace(r"[\p{N}]", r"\d")
    quick = re.compile(quick.replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d"))
    odd, astral = _odd_characters(), re.compile("[\U00010000-\U0010ffff]")
    return lambda text: (exact if odd.search(text) or not text.isascii() and astral.search(text) else quick).findall(text)


@lru_cache(maxsize=1)
def _odd_characters() -> re.Pattern:
    """Characters below 10000 (hexadecimal) that the two engines class differently; those above go to the exact one."""
    odd = [c for c in map(chr, range(0x10000)) if (c.isalnum() and unicodedata.category(c)[0] != "L" and not c.isdecimal()) or "\x1c" <= c <= "\x1f"]
    return re.compile("[" + "".join(map(re.escape, odd)) + "]")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def text_chunks(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch of about CHUNK_CHARS characters, with their texts; null is empty."""
    start, size, texts = 0, 0, []
    for i, text in enumerate(batch.column("text")):
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= CHUNK_CHARS:
            yield batch.slice(start, i + 1 - start), texts
            start, size, texts = i + 1, 0, []
    if texts:
        yield batch.slice(start), texts


@lru_cache(maxsize=8)
def memory(path: str, use: str) -> Memory:
    """A worker's memory of pieces, which outlives tasks: their ids as bytes, their number of ids, or (number, decimal ids, tokens) with a space behind each."""
    enc = encoder(path)

    def digests(pieces: list[str]) -> list[tuple[int, bytes, bytes]]:
        out = []
        for raw in enc.encode_pieces(pieces):
            ids = np.frombuffer(raw, dtype="<u4").tolist()
            out.append((len(ids), "".join([f"{i} " for i in ids]).encode(), "".join([enc.tokens[i] + " " for i in ids]).encode()))
        return out

    make = {"ids": enc.encode_pieces, "lengths": lambda pieces: [len(raw) // 4 for raw in enc.encode_pieces(pieces)], "digests": digests}[use]
    return Memory(make)


def sums(values: list[int], places: pa.Array, ends: np.ndarray) -> np.ndarray:
    """The sum of the values at ``places`` in each list."""
    total = np.concatenate(([0], np.cumsum(np.array(values, dtype=np.int64)[places.to_numpy()])))
    return total[ends[1:]] - total[ends[:-1]]


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row's text.

    A null text is an empty one: no tokens, and both hashes are those of nothing.
    Ids may be null or repeat; other columns are not read, so their names may be
    any; whole texts are encoded, however long; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, known = encoder(path), memory(path, "digests")
        for batch in batches:
            for part, texts in text_chunks(batch):
                distinct, places, ends = coded([enc.pieces(t) for t in texts])
                sizes, *values = zip(*known.of(distinct)) if distinct else ((), (), ())
                n, digests = sums(sizes, places, ends), []
                for value in values:
                    data, at = joined(value, places, ends)
                    digests.append([hashlib.sha256(data[a : max(a, b - 1)]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())])
                ids, decoded = digests
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    ship(docs.sparkSession)
    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of each row's text, with the rules of encode_digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, known = encoder(path), memory(path, "ids")
        for batch in batches:
            for part, texts in text_chunks(batch):
                distinct, places, ends = coded([enc.pieces(t) for t in texts])
                data, at = joined(known.of(distinct), places, ends)
                ids = [np.frombuffer(data[a:b], dtype="<u4") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array(map(enc.decode, ids), pa.string())],
                    ["doc_id", "ids", "decoded"],
                )

    ship(docs.sparkSession)
    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
