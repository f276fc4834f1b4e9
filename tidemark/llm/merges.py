"""Byte-pair encoding of many words at once, on whole arrays.

Every round merges in each word its pair of lowest rank, the leftmost of equal ones, until no word has a pair left: what the merges prescribe, one merge a word and round. Ranks of pairs come from a sorted
table. ``Speller`` encodes batches of texts with it: the distinct pieces between white space of a batch are looked up, and the words of new ones are encoded together.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.bpe import LONGEST_KEPT, Automaton, _latin

_NONE = np.int64(1) << 40
_PIECES, _WORDS = 400_000, 300_000  # entries that a worker keeps


class Merges:
    """The merges of a tokenizers JSON file. ``first``: token of each symbol; symbols are bytes, and from 256 on bytes that end a word where the vocabulary has a suffix for them."""

    def __init__(self, model: dict):
        ids, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = dict(zip(plain, map(chr, plain), strict=True)) | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}
        self.first = np.array([ids.get(byte[s & 255] + suffix * (s > 255), 0) for s in range(512)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = np.array([[ids[a], ids[b]] for a, b in pairs], np.int64).reshape(-1, 2).T
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(order, _NONE)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Token ids (int32) of words of one byte or more."""
        sizes = np.array([len(w) for w in words])
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        symbols[np.cumsum(sizes) - 1] += 256
        tokens, of = self.first[symbols], np.repeat(np.arange(len(words)), sizes)
        out: list[bytes] = [b""] * len(words)
        ranks = np.full(len(tokens), _NONE)  # of each token with the next of its word
        inner = np.flatnonzero(of[1:] == of[:-1])
        ranks[inner] = self._rank(tokens[inner], tokens[inner + 1])
        while len(tokens):
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            low = np.minimum.reduceat(ranks, starts)
            lengths = np.diff(np.append(starts, len(tokens)))
            done = low == _NONE
            if done.any():
                data = tokens.astype("<i4").tobytes()
                for k, at, n in zip(of[starts[done]].tolist(), starts[done].tolist(), lengths[done].tolist(), strict=True):
                    out[k] = data[4 * at : 4 * (at + n)]
                keep = np.repeat(~done, lengths)
                tokens, of, ranks = tokens[keep], of[keep], ranks[keep]
                low, lengths = low[~done], lengths[~done]
                if not len(tokens):
                    break
                starts = np.cumsum(lengths) - lengths
            # the leftmost pair of the lowest rank in each word
            hits = np.flatnonzero(ranks == np.repeat(low, lengths))
            hits = hits[np.concatenate([[True], of[hits[1:]] != of[hits[:-1]]])]
            tokens[hits] = self.made[ranks[hits]]
            keep = np.ones(len(tokens), bool)
            keep[hits + 1] = False
            # the merged token takes the place before the one that goes; ranks around it are read anew
            moved = hits - np.arange(len(hits))
            tokens, of = tokens[keep], of[keep]
            ranks = ranks[keep]
            for at in (moved, moved - 1):
                at = at[at >= 0]
                ok = at + 1 < len(tokens)
                ranks[at[~ok]] = _NONE
                at = at[ok]
                same = of[at] == of[at + 1]
                ranks[at[~same]] = _NONE
                at = at[same]
                ranks[at] = self._rank(tokens[at], tokens[at + 1])
        return out


class Speller:
    """Ids of batches of texts, equal to those of ``automaton``, which reads the pieces with special tokens and long words itself."""

    def __init__(self, automaton: Automaton, spec: str):
        self.automaton, self.merges = automaton, Merges(json.loads(spec)["model"])
        self.pieces: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}

    def _split(self, piece: str) -> list[str]:
        """The words of a piece, as the vocabulary's normalizer and pattern make them."""
        a = self.automaton
        if piece.isascii():
            return a.ascii_splits.findall(piece.lower())
        if not _latin(piece) and any(unicodedata.category(c) == "Cn" for c in piece):
            return a._by_library(piece)
        piece = unicodedata.normalize("NFC", piece)
        return a.splits.findall(piece.lower() if "Σ" not in piece else "".join(map(str.lower, piece)))

    def _read(self, new: list[str]) -> None:
        """Adds pieces that were not met before."""
        a, words = self.automaton, self.words
        odd = [bool(a.special_pattern and "<" in p and a.special_pattern.search(p)) for p in new]
        cut = [[] if o else self._split(p) for p, o in zip(new, odd, strict=True)]
        unknown = list({w for ws in cut for w in ws} - words.keys())
        short = [w for w in unknown if len(w) <= LONGEST_KEPT]
        for at in range(0, len(short), 4096):
            some = short[at : at + 4096]
            words.update(zip(some, self.merges.encode([w.encode() for w in some]), strict=True))
        long = [w for w in unknown if len(w) > LONGEST_KEPT]
        words.update((w, a.encode_word(w)) for w in long)
        for p, o, ws in zip(new, odd, cut, strict=True):
            self.pieces[p] = a.spell(p) if o else words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws])
        for w in long:
            del words[w]

    def spell(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts`` (strings without null), and where each text's end. Texts are cut at ASCII white space, which no word goes over; each distinct piece is looked up once."""
        if len(self.pieces) > _PIECES:
            self.pieces = {"": b""}
        if len(self.words) > _WORDS:
            self.words = {}
        parts = pc.ascii_split_whitespace(texts)
        coded = parts.flatten().dictionary_encode()
        codes, said = np.asarray(coded.indices), coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist
        new = [p for p, ids in zip(said, map(self.pieces.get, said), strict=True) if ids is None]
        self._read(new)
        found = [self.pieces[p] for p in said]
        for p in new:
            if len(p) > LONGEST_KEPT:
                del self.pieces[p]
        sizes = np.array([len(x) // 4 for x in found], np.int64)
        data, starts = np.frombuffer(b"".join(found), "<i4"), np.cumsum(sizes) - sizes
        n = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = data[np.repeat(starts[codes] - ends[:-1], n) + np.arange(ends[-1])]
        return ids, ends[np.cumsum(np.asarray(parts.value_lengths()))]
