"""BPE encoding and decoding with a public vocabulary file (read, never trained or copied).

Each word is a doubly linked list of symbols; candidate merges wait in a priority queue of (rank, position), entries
whose symbols have changed meanwhile are skipped as stale. Decoding joins the vocabulary strings of the ids.

Texts are cut at single spaces and line ends, which no token crosses; the tokens of such a piece are kept in a cache of
bounded size in each worker (two generations, the older one dropped when the younger is full), so a piece costs a
dictionary look-up as a rule. One pass over the documents, no shuffle, memory bounded by a batch and the cache.

Defined cases: null and empty texts have no tokens (empty id list, empty decoded text); special-token strings in a text
become their ids; every row gives one result row, repeated rows too; other columns are never read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from wattroute.llm.cache import Cache
from wattroute.llm.common import slices, table, texts

TOKENIZER = "word_bpe_49k.json"
CACHED = 100_000  # pieces, and words, in each of two generations
LATIN = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch  # letters that every version of Unicode takes alike, and composed already
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one vocabulary file; the patterns are those the file states."""

    def __init__(self, path: str, cached: int = CACHED):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left, self.right = [self.vocab[a] for a, _ in pairs], [self.vocab[b] for _, b in pairs]
        self.joined = [self.vocab[a + b] for a, b in pairs]
        none: dict[int, int] = {}
        self.ranks = [none] * (max(self.vocab.values()) + 1)  # of the pairs that a symbol begins, by the symbol after it
        for rank, (a, b) in enumerate(zip(self.left, self.right, strict=True)):
            if self.ranks[a] is none:
                self.ranks[a] = {}
            self.ranks[a][b] = rank
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.special).items()}
        self.inner = [self.vocab[c] for c in byte_letters()]
        self.last = [self.vocab[c + self.suffix] for c in byte_letters()]
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.word = regex.compile(split["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.pieces, self.words = Cache(cached), Cache(cached)
        self.path, self.lib, self.byte = path, None, {c: b for b, c in enumerate(byte_letters())}

    def split(self, piece: str) -> list[bytes]:
        """The words of a piece in UTF-8. ASCII ones and those of Latin letters by the file's pattern; for others the library's
        own normaliser and splitter are asked, so that all follow one version of Unicode."""
        if piece.isascii() or LATIN(piece):
            if piece.isalpha():
                return [piece.lower().encode()]
            return [w.encode() for w in self.word.findall(piece.lower())]
        if self.lib is None:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(self.path)
            self.lib = whole.normalizer, whole.pre_tokenizer  # the vocabulary is not held twice
        normalizer, splitter = self.lib
        words = splitter.pre_tokenize_str(normalizer.normalize_str(piece))
        return [bytes(map(self.byte.__getitem__, w)) for w, _ in words]

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one word by merges in order of rank, leftmost first.

        Queue entries are rank << bits | position; an entry is stale if the symbols there are no longer its pair.
        """
        symbols = [*map(self.inner.__getitem__, raw)]
        symbols[-1] = self.last[raw[-1]]
        n = len(symbols)
        if n == 1:
            return symbols
        ranks, left, right, joined = self.ranks, self.left, self.right, self.joined
        bits = n.bit_length()
        place = (1 << bits) - 1
        queue = [rank << bits | i for i in range(n - 1) if (rank := ranks[symbols[i]].get(symbols[i + 1])) is not None]
        heapify(queue)
        before, after = [*range(-1, n - 1)], [*range(1, n), -1]
        while queue:
            entry = heappop(queue)
            rank, i = entry >> bits, entry & place
            j = after[i]
            if symbols[i] != left[rank] or j < 0 or symbols[j] != right[rank]:
                continue  # stale
            symbols[i] = new = joined[rank]
            symbols[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (rank := ranks[new].get(symbols[k])) is not None:
                    heappush(queue, rank << bits | i)
            if (k := before[i]) >= 0 and (rank := ranks[symbols[k]].get(new)) is not None:
                heappush(queue, rank << bits | k)
        return [s for s in symbols if s >= 0]

    def told(self, word: bytes) -> tuple[bytes, str]:
        """(ids in decimal, decoded text) of one word."""
        ids = self.merge(word)
        return self.words.put(word, (" ".join(map(str, ids)).encode(), self.decode(ids)))

    def piece(self, piece: str) -> tuple[bytes, str]:
        """(ids in decimal, decoded text) of a piece between single spaces; both empty if it holds no token."""
        get = self.words.get
        words = [get(word) or self.told(word) for word in self.split(piece)]
        if len(words) == 1:
            return self.pieces.put(piece, words[0])
        return self.pieces.put(piece, (b" ".join([ids for ids, _ in words]), " ".join([text for _, text in words])))

    def spans(self, text: str) -> list[tuple[bytes, str]]:
        """What each piece of a text gives, in order, pieces without tokens left out."""
        if "<|" in text and (parts := self.cut.split(text))[1:]:
            out = []
            for k, part in enumerate(parts):
                out += [(b"%d" % self.special[part], part)] if k % 2 else self.spans(part)
            return out
        pieces = text.replace("\n", " ").split(" ")
        out = list(map(self.pieces.young.get, pieces))
        if None in out:
            get, piece = self.pieces.get, self.piece
            for k, got in enumerate(out):
                if got is None:
                    out[k] = get(pieces[k]) or piece(pieces[k])
        return [x for x in out if x[0]]

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.spans(text) for i in ids.split(b" ")]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: vocabulary strings, joined by a space."""
        return " ".join([self.strings[i] for i in ids])


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string for every row: the operator's plain output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        for batch in slices(batches):
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return texts(docs).mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, number of tokens and digests of ids and decoded text, without moving the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path)
        for batch in slices(batches):
            counts, hashes, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                spans = bpe.spans(text)
                ids = b" ".join([s[0] for s in spans])
                counts.append(ids.count(b" ") + (ids != b""))
                hashes.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(" ".join([s[1] for s in spans]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, SCHEMA)


def vocabulary(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary())
