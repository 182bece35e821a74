"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

A text is cut at added tokens and into words by the byte-level pattern. The words
of a chunk of texts that aren't known yet make a trie of bytes, held as its sorted
leaves. A depth-first walk gives every trie node the last token of the encoding of
its prefix: the one token that ends there and may follow the last token of the
prefix before it. So a prefix that many words share is worked out once, and a
word's encoding is read back from its node, last token by last token. A word of
``LONG_WORD`` characters or more shares nothing worth its path and is walked alone.

Token ``b`` may follow ``a`` if no merge crosses their boundary: going from the two
whole tokens back through the merges that made them, latest first, no pair of
pieces at the boundary has a merge that comes before the next merge of its sides.

Defined cases: null and empty texts have no tokens and decode to the empty text;
texts and words are encoded whole at any length (a long word takes a few bytes of
memory for each of its own); repeated rows are encoded alike; bytes that
aren't UTF-8 decode to U+FFFD. Truncation and padding of the file aren't used.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

_SPACE = r"\t-\r \x85\xa0  -     　"
#: Fixed value: the word pattern of byte-level BPE, with Unicode white space written out.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Bounds of what a Python worker remembers, some 100 MB at most beside the vocabulary's 64: distinct words, once as lately
#: met and once as older ones, and pairs of tokens.
REMEMBERED_WORDS, REMEMBERED_PAIRS = 150_000, 600_000
#: Bytes from which a word is walked by itself and not remembered.
LONG_WORD = 1024


def byte_letters() -> dict[str, int]:
    """Printable letter of each byte in the vocabulary file: itself where printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(shifted)}


#: The tokens' trie has nested dictionaries by byte; under this key a node has the token that ends there.
HERE = -1


class Encoder:
    """Encoding of words and decoding of ids under one vocabulary file's content."""

    def __init__(self, content: str) -> None:
        file = json.loads(content)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.ids = {raw(t): i for t, i in file["model"]["vocab"].items()}
        self.added = {a["content"]: a["id"] for a in file["added_tokens"]}
        self.size = {i: len(b) for b, i in self.ids.items()}
        texts = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.bytes_of = [texts.get(i, b"") for i in range(max(texts) + 1)]
        #: rank: place of the merge that makes a token (-1: a byte); parts: the two tokens it merges; pair: rank by parts.
        self.rank = dict.fromkeys(self.ids.values(), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[int, int], int] = {}
        for place, merge in enumerate(file["model"]["merges"]):
            left, right = map(raw, merge if isinstance(merge, list) else merge.split(" "))
            a, b, whole = self.ids[left], self.ids[right], self.ids[left + right]
            self.pair[a, b] = place
            if whole not in self.parts:
                self.rank[whole], self.parts[whole] = place, (a, b)
        self.tokens: dict = {}
        for token, i in self.ids.items():
            node = self.tokens
            for byte in token:
                node = node.setdefault(byte, {})
            node[HERE] = i
        self.follows: dict[int, bool] = {}
        #: Encodings (32-bit ids) of words met lately, and those remembered before them.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words = regex.compile(WORDS)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def may_follow(self, a: int, b: int) -> bool:
        """Remembered under one integer for both tokens."""
        if len(self.follows) > REMEMBERED_PAIRS:
            self.follows.clear()
        found = self.follows[a << 20 | b] = not self._crossed(a, b)
        return found

    def _crossed(self, left: int, right: int) -> bool:
        """Whether some merge across the boundary of two tokens comes before the merges that made their sides."""
        rank, next_left, next_right = self.rank, 1 << 60, 1 << 60
        while True:
            across = self.pair.get((left, right))
            # At equal ranks the leftmost pair goes first: the left side's own merge, then this one, then the right's.
            if across is not None and across < next_left and across <= next_right:
                return True
            if rank[left] < 0 and rank[right] < 0:
                return False
            if rank[left] > rank[right]:
                next_left, left = rank[left], self.parts[left][1]
            else:
                next_right, right = rank[right], self.parts[right][0]

    def _walk(self, key: bytes, depth: int, lasts, growing: list, reach: list | None = None) -> None:
        """Steps down a trie from ``depth`` to the end of ``key``; adds to ``lasts``, and to ``reach`` what may still grow.

        ``growing`` has the tokens that may grow at ``depth``, longest first: where each began, and its place in the tokens'
        trie. The last token of a prefix is the longest that ends there and may follow the last token before it."""
        follows, root = self.follows, self.tokens
        for at in range(depth, len(key)):
            byte = key[at]
            grown, last = [], None
            for state in growing:
                place = state[1].get(byte)
                if place is not None:
                    begin = state[0]
                    grown.append((begin, place))
                    if last is None and HERE in place:
                        token = place[HERE]
                        if begin:
                            follow = follows.get(lasts[begin - 1] << 20 | token)
                            if follow is None:
                                follow = self.may_follow(lasts[begin - 1], token)
                            if not follow:
                                continue
                        last = token
            place = root[byte]
            grown.append((at, place))
            lasts.append(place[HERE] if last is None else last)
            growing = grown
            if reach is not None:
                reach.append(grown)

    def _ids(self, lasts) -> bytes:
        """The encoding of the prefix that ``lasts`` ends with, read back from its last token."""
        ids, at, size = array("i"), len(lasts), self.size
        while at:
            token = lasts[at - 1]
            ids.append(token)
            at -= size[token]
        ids.reverse()
        return ids.tobytes()

    def learn(self, words: Iterable[str]) -> None:
        """Encode distinct words by a depth-first walk of their trie.

        Sorted by bytes, the words are the trie's leaves in order: what a word shares with the one before it is the path
        that stays, so each distinct prefix is visited once and no node need be stored. On the path, ``reach[d]`` has the
        tokens that may still grow at depth d, ``lasts[d - 1]`` the last token of the prefix of d bytes."""
        known = self.known
        lasts: list[int] = []
        reach: list[list] = [[]]
        before = b""
        for key, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            depth = 0
            for a, b in zip(before, key):
                if a != b:
                    break
                depth += 1
            del lasts[depth:], reach[depth + 1 :]
            self._walk(key, depth, lasts, reach[depth], reach)
            known[word] = self._ids(lasts)
            before = key

    def encode_long(self, word: str) -> bytes:
        """The same walk for one long word: four bytes are kept for each of its bytes."""
        lasts = array("i")
        self._walk(word.encode("utf-8", "surrogatepass"), 0, lasts, [])
        return self._ids(lasts)

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text, 32 bits each. Distinct new words of all texts share one trie."""
        cut = []
        for text in texts:
            parts = [text or ""]
            if self.cut and any(a in parts[0] for a in self.added):
                parts = self.cut.split(parts[0])
            cut.append([[p] if p in self.added else self.words.findall(p) for p in parts])
        if len(self.known) > REMEMBERED_WORDS:
            self.older, self.known = self.known, {}
        new = set(chain.from_iterable(chain.from_iterable(cut))) - self.known.keys() - self.added.keys()
        again = new & self.older.keys()
        self.known.update((w, self.older[w]) for w in again)
        new -= again
        long = {w for w in new if len(w) >= LONG_WORD}
        self.learn(new - long)
        self.known.update((w, self.encode_long(w)) for w in long)
        self.known.update((a, array("i", [i]).tobytes()) for a, i in self.added.items())
        for parts in cut:
            yield b"".join(map(self.known.__getitem__, chain.from_iterable(parts)))
        for word in long:
            del self.known[word]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    content = shared.value
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(content)
    return _ENCODERS[key]


def _share(spark: SparkSession, path: str):
    """The vocabulary file's content as a broadcast: one file of a few MB, whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _batches(shared, columns: int, chars: int, batches: Iterator[pa.RecordBatch]):
    """(encoder, slice, encodings of its texts) for slices of about ``chars`` characters; texts are the last column."""
    encoder = _encoder(shared)
    for batch in batches:
        texts = batch.column(columns)
        sizes = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < len(batch):
            base = sizes[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, base + chars, "right")))
            yield encoder, batch.slice(begin, end - begin), list(encoder.encode(texts.slice(begin, end - begin).to_pylist()))
            begin = end


def _lists(found: list[bytes]) -> pa.ListArray:
    offsets = np.cumsum([0, *(len(x) // 4 for x in found)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))


def encode(docs: DataFrame, path: str, chars: int = 500_000) -> DataFrame:
    """``docs`` with ``ids`` (array<int>), the tokens of its whole ``text``; a column ``ids`` is replaced."""
    shared = _share(docs.sparkSession, path)
    own = [c for c in docs.columns if c != "ids"]
    fields = [docs.schema[c] for c in own]
    place = own.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, found in _batches(shared, place, chars, batches):
            yield pa.RecordBatch.from_arrays([*part.columns, _lists(found)], names=[*own, "ids"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "ids array<int>"])
    return docs.select(*own).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, decoded): the text of each row's ``ids``; null ids give the empty text."""
    shared = _share(encoded.sparkSession, path)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            texts = pa.array([encoder.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=[id_col, "decoded"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, decoded string")


def round_trip(docs: DataFrame, path: str, with_ids: bool = True, chars: int = 500_000) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every document, without ``ids`` on request.

    ids_sha256 is of the ids as little-endian unsigned 32-bit integers, decoded_sha256 of the text that they decode to.
    One Python worker encodes and decodes, so a vocabulary is held once for each task."""
    shared = _share(docs.sparkSession, path)
    names = ["doc_id", "n_tokens", *(["ids"] if with_ids else []), "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for encoder, part, found in _batches(shared, 1, chars, batches):
            n, digests, back = [], [], []
            for ids in found:
                own = np.frombuffer(ids, np.int32)
                n.append(len(own))
                digests.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                back.append(hashlib.sha256(encoder.decode(own.tolist()).encode()).hexdigest())
            cols = [part.column(0), pa.array(n, pa.int64()), *([_lists(found)] if with_ids else []), pa.array(digests, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, " + "ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """``round_trip`` without the ids."""
    return round_trip(docs, path, with_ids=False)
