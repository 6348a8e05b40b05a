"""Byte-level BPE encoding and decoding over a trie of distinct words.

The distinct words of a chunk that are not in the worker's cache go into a trie
of bytes in sorted order, which is a depth-first walk.  Each node holds the last
token of the encoding of its prefix: the longest token ``t`` ending there such
that the node ``len(t)`` bytes higher has a last token that may stand before
``t``.  Two tokens may be neighbours if no merge across their border comes up
before theirs are done.  The encoding of a word is read off by following last
tokens to the root, so whatever words have in common at their start is worked
out once.  Cache, trie and table of neighbours are bounded and start anew.

Token ids travel as packed little-endian unsigned 32-bit integers.

Defined results: a null text counts as empty and has no tokens; a special token
written out in a text becomes its id, as the tokenizer file says; repeated rows
get equal results.  Nothing is shuffled.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import resident

#: Splits text before merging; a fixed value of byte-level tokenizers of this kind.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_WORDS = 100_000
TRIE_NODES, FITS = 100_000, 100_000
CACHE_WORD_BYTES = 64
#: Longer words share no prefix with others; so many of their bytes are kept open.
LONG_WORD, OPEN_BYTES, SETTLE_BYTES = 4096, 1 << 16, 4096


_PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.bytes = {i: b for b, i in self.ids.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(self.ids[raw(x)], self.ids[raw(y)]): (n, self.ids[raw(x) + raw(y)]) for n, (x, y) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        self.parts = {made: (n, pair) for pair, (n, made) in self.rank.items()}
        if len(self.parts) < len(self.rank):
            raise ValueError("two merges make the same token")
        self.size = {i: len(b) for i, b in self.bytes.items()}
        self.longest = max(map(len, self.ids))
        self.heads = {b[:k] for b in self.ids for k in range(len(b) + 1)}
        self.tails, self.states, self.steps, self.ending = [b""], {b"": 0}, {}, [[]]
        self.words = regex.compile(WORDS)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.fits: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self._empty_trie()

    def merged(self, text: bytes) -> list[int]:
        """Merges by rank until none applies; for a pair of tokens only."""
        parts = [self.ids[text[i : i + 1]] for i in range(len(text))]
        while len(parts) > 1:
            best = min((self.rank[p] + (i,) for i, p in enumerate(zip(parts, parts[1:])) if p in self.rank), default=None)
            if best is None:
                break
            pair, i, joined = (parts[best[2]], parts[best[2] + 1]), 0, []
            while i < len(parts):
                if tuple(parts[i : i + 2]) == pair:
                    joined.append(best[1])
                    i += 2
                else:
                    joined.append(parts[i])
                    i += 1
            parts = joined
        return parts

    def _edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """What stands at an end of ``token`` while it is merged: each token there, the
        rank of the merge that makes it (-1: a byte) and of the one that ends it."""
        chain, end = [], len(self.rank)
        while token in self.parts:
            rank, pair = self.parts[token]
            chain.append((token, rank, end))
            token, end = pair[side], rank
        chain.append((token, -1, end))
        return chain

    def neighbours(self, left: int, right: int) -> bool:
        """May ``right`` follow ``left`` in an encoding? A left of -1: the start.

        It may unless a merge across the border comes up while both of its parts
        stand there.  Of equal merges the one further left comes first."""
        if left < 0:
            return self.merged(self.bytes[right]) == [right]
        rank = self.rank
        for x, made_x, end_x in self._edge(left, 1):
            for y, made_y, end_y in self._edge(right, 0):
                if (x, y) in rank:
                    at = rank[x, y][0]
                    if made_x < at < end_x and made_y < at <= end_y:
                        return False
        return True

    def _state(self, state: int, byte: int) -> int:
        """The state after ``byte``: the longest end of the prefix that begins a token."""
        tail = self.tails[state] + bytes([byte])
        while tail not in self.heads:
            tail = tail[1:]
        if (new := self.states.get(tail)) is None:
            new = self.states[tail] = len(self.tails)
            self.tails.append(tail)
            self.ending.append([(self.ids[tail[k:]], len(tail) - k) for k in range(len(tail)) if tail[k:] in self.ids])
        self.steps[state << 8 | byte] = new
        return new

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Packed encodings of distinct words through the worker's trie.

        Words in sorted order visit the trie depth first, and the path to what two
        neighbours share stays.  A node gets its state and last token when it is
        made, so a prefix is worked out once, however many words begin with it."""
        if len(self.node_last) > TRIE_NODES:
            self._empty_trie()
        trie, node_last, node_state, steps, ending, size, fits = self.trie, self.node_last, self.node_state, self.steps, self.ending, self.size, self.fits
        out: dict[str, bytes] = {}
        pack = _PACK
        path, last, before = [0], [-1], b""
        for word in sorted(words):  # UTF-8 sorts alike
            raw, at = word.encode("utf-8", "surrogatepass"), 0
            if len(raw) > LONG_WORD:
                out[word] = self._long_word(raw)
                continue
            for x, y in zip(raw, before):
                if x != y:
                    break
                at += 1
            del path[at + 1 :], last[at + 1 :]
            before, node = raw, path[at]
            for depth in range(at, len(raw)):
                key = node << 8 | raw[depth]
                child = trie.get(key)
                if child is None:
                    step = node_state[node] << 8 | raw[depth]
                    state = steps.get(step)
                    if state is None:
                        state = self._state(node_state[node], raw[depth])
                    for token, n in ending[state]:
                        pair = (last[depth + 1 - n] + 1) << 20 | token
                        ok = fits.get(pair)
                        if ok is None:
                            ok = fits[pair] = self.neighbours(last[depth + 1 - n], token)
                        if ok:
                            break
                    else:
                        raise ValueError("the vocabulary lacks a byte")
                    child = trie[key] = len(node_last)
                    node_last.append(token)
                    node_state.append(state)
                node = child
                path.append(node)
                last.append(node_last[node])
            tokens, at = [], len(raw)
            while at:
                token = last[at]
                tokens.append(token)
                at -= size[token]
            tokens.reverse()
            out[word] = pack[len(tokens)](*tokens) if len(tokens) < len(pack) else struct.pack(f"<{len(tokens)}I", *tokens)
        return out

    def _last(self, state: int, byte: int, last: list[int], at: int) -> tuple[int, int]:
        """The state after ``byte`` and the last token there; ``last[at]`` is the byte's own place."""
        step = state << 8 | byte
        state = self.steps[step] if step in self.steps else self._state(state, byte)
        for token, n in self.ending[state]:
            pair = (last[at + 1 - n] + 1) << 20 | token
            ok = self.fits.get(pair)
            if ok is None:
                ok = self.fits[pair] = self.neighbours(last[at + 1 - n], token)
            if ok:
                return state, token
        raise ValueError("the vocabulary lacks a byte")

    def _back(self, last: list[int], at: int, low: int) -> list[int]:
        """The borders of the tokens of the first ``at`` bytes, from the end down to ``low``."""
        borders = [at]
        while at > low:
            at -= self.size[last[at]]
            borders.append(at)
        return borders

    def _long_word(self, raw: bytes) -> bytes:
        """The packed encoding of a long word.

        Any later token begins at one of the last ``longest`` places, so a border that
        the encodings up to all of these share is one for good."""
        done, last, state, limit = [], [-1], 0, OPEN_BYTES

        def give(at: int) -> None:
            ids = [last[b] for b in self._back(last, at, 0)[:-1]]
            done.append(np.array(ids[::-1], "<u4").tobytes())

        for byte in raw:
            state, token = self._last(state, byte, last, len(last) - 1)
            last.append(token)
            if len(last) > limit:
                end, low = len(last) - 1, len(last) - SETTLE_BYTES
                shared = set(self._back(last, end, low))
                for at in range(end - self.longest, end):
                    shared.intersection_update(self._back(last, at, low))
                settled = max((b for b in shared if low < b <= end - self.longest), default=0)
                limit = OPEN_BYTES if settled else 2 * len(last)
                if settled:
                    give(settled)
                    last = last[settled:]
        give(len(last) - 1)
        return b"".join(done)

    def _empty_trie(self) -> None:
        """Node 0 is the root; a node's key is its parent and byte."""
        self.trie: dict[int, int] = {}
        self.node_last, self.node_state = [-1], [0]
        if len(self.fits) > FITS:
            self.fits.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; new words of all texts go through the trie at once."""
        cut, found, new, cache = [], self.words.findall, set(), self.cache
        for text in texts:
            if self.cut and any(s in text for s in self.special):
                words = [w for p in self.cut.split(text) if p for w in ([p] if p in self.special else found(p))]
            else:
                words = found(text)
            cut.append(words)
            new |= set(words).difference(cache)
        fresh = self.encode_words(new - self.special.keys())
        fresh |= {s: struct.pack("<I", i) for s, i in self.special.items()}
        if len(cache) + len(fresh) > CACHE_WORDS:  # words of this chunk stay
            needed = set().union(*cut)
            self.cache = cache = {w: cache[w] for w in needed if w in cache}
        cache.update(fresh)
        get = cache.__getitem__
        out = [b"".join(map(get, words)) for words in cut]
        if len(cache) > CACHE_WORDS:
            cache.clear()
        else:
            for w in [w for w in fresh if len(w) > CACHE_WORD_BYTES]:
                del cache[w]
        return out

    def decode(self, ids: np.ndarray) -> str:
        get = self.bytes.__getitem__
        return b"".join(map(get, ids.tolist())).decode("utf-8", "replace")


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at ``path``, read once a worker."""
    return resident(("vocabulary", path), lambda: Vocabulary(path))


#: Characters whose new words go through the trie together.
CHUNK = 1 << 18


def _packed(vocab: Vocabulary, texts: pa.Array) -> Iterator[list[bytes]]:
    """Packed ids of the texts of one chunk after another."""
    chunk, size = [], 0
    for text in texts:
        text = text.as_py()
        if size and size + len(text) > CHUNK:
            yield vocab.encode(chunk)
            chunk, size = [], 0
        chunk.append(text)
        size += len(text)
    yield vocab.encode(chunk)


def _texts(vocab: Vocabulary, packed: list[bytes | None]) -> pa.Array:
    return pa.array([None if b is None else vocab.decode(np.frombuffer(b, "<u4")) for b in packed], pa.string())


def encoded(text: Column, path: str) -> Column:
    """The ids of a text column as packed little-endian unsigned 32-bit integers.

    ``path`` is the tokenizer file; every worker must be able to open it."""

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array(packed, pa.binary()) for packed in _packed(vocabulary(path), texts)])

    return encode(F.coalesce(text, F.lit("")))


def decoded(ids: Column, path: str) -> Column:
    """The text of packed ids; special tokens are written out."""

    @F.arrow_udf("string")
    def decode(packed: pa.Array) -> pa.Array:
        return _texts(vocabulary(path), packed.to_pylist())

    return decode(ids)


def round_trip(text: Column, path: str) -> Column:
    """A struct of the packed ``ids`` of a text column and the ``text`` decoded from them.

    ``decoded(encoded(...))`` beside ``encoded(...)`` would make Spark encode twice:
    it inlines the inner call in both.  Here one call gives both."""

    @F.arrow_udf("struct<ids: binary, text: string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = vocabulary(path)
        for texts in batches:
            for packed in _packed(vocab, texts):  # a chunk at a time, so that results stay small
                yield pa.StructArray.from_arrays([pa.array(packed, pa.binary()), _texts(vocab, packed)], ["ids", "text"])
            del texts  # before the next batch is read

    return both(F.coalesce(text, F.lit("")))
