"""Byte-pair encoding and decoding by a tokenization automaton compiled from the merges.

*Over tokens.* The automaton reads tokens and accepts exactly the sequences that the merges produce (Berglund, Martens and van der Merwe, 2024). It starts
with one state that loops on every base symbol. Each merge (u, v) -> w, in order of rank, adds a gadget: the state q that u
leads to is replaced, for u, by a copy without the arc v, and w becomes an arc wherever u is, to where v led from q. Since all arcs
of one token lead to one state at any time, the automaton is kept as ``goes[token]``, the state its arcs lead to, and for each state the arcs its
gadgets removed, with the rank at which each went. An arc w is present in a state unless it, or one of its left components before it was built, has
been removed there. It is compiled once, on the driver, into flat arrays that are broadcast: a few MB whatever the data.

*Over symbols.* Encoding is table-driven: ``moves[state, symbol]`` gives the next state, the token that ends there and its length. A state of this table stands for the arcs
under way, that is the trie nodes of the tokens that have begun, each with what the automaton's state in which it began has removed of the arcs below that node, and for
the automaton's state at the end of the last token. Of all tokens
that end at a position exactly one is an arc of the state where it begins, so reading a word once forward and following the lengths back gives its ids, in time and memory
linear in the word. The table is filled in as words need it and begun anew when it is full, so its size is bounded whatever the words.

Decoding emits the labels of the arcs.

Text is prepared as the vocabulary file says: special tokens are cut out of the raw text, the rest is split at white space (which the file's pattern drops), brought to NFC, put in
lower case one character at a time, split by the file's pattern and written in byte symbols, the last one of a word
with the end-of-word suffix. Only the settings that word vocabularies of this kind have are supported; others raise ValueError. Pieces with code points that Python's
Unicode tables don't know are brought to NFC, lower case and words by the tokenizers library. Pieces repeat, so tasks keep tables of those met last, bounded in bytes; long pieces aren't kept.

Defined cases: null and empty texts have no tokens; rows repeat as given; an empty table gives an empty result; a word may be of any length; extra columns are kept only when named in ``keep``.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import small_batches

#: Bytes of the pieces of text and of the words that a task keeps, twice, and the moves of its table.
PIECES, WORDS, MOVES = 24 << 20, 4 << 20, 300_000
LONGEST_KEPT = 64
_FEW = 64
_ENTRY = 200


def byte_symbols() -> list[str]:
    """One printable character for each byte: itself where printable Latin-1, else the next from U+0100 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class _Kept(dict):
    """Values of the keys met last. Keys not met while ``most`` bytes came in are forgotten."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        self.make, self.most, self.bytes, self.old = make, most, 0, {}

    def __missing__(self, key: str) -> bytes:
        if len(key) > LONGEST_KEPT:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if self.bytes > self.most:
            self.old = dict(self)
            self.clear()
            self.bytes = 0
        self[key] = value
        self.bytes += _ENTRY + 2 * len(key) + len(value)
        return value


class Automaton:
    """Vocabulary and merges of a tokenizers JSON file as arcs and states. Symbols are bytes, and from 256 on bytes with the end-of-word suffix."""

    def __init__(self, spec: dict):
        model = spec["model"]
        wanted = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
        if any(model.get(k) != v for k, v in wanted.items()) or spec.get("decoder") is not None:
            raise ValueError("only plain BPE models without a decoder are supported")
        norms = spec["normalizer"]["normalizers"]
        if [n["type"] for n in norms] != ["NFC", "Replace", "Lowercase"] or norms[1]["pattern"] != {"Regex": "\\s+"} or norms[1]["content"] != " ":
            raise ValueError("normalizer must be NFC, white space to one space, lower case")
        split, bytes_ = spec["pre_tokenizer"]["pretokenizers"]
        if split["type"] != "Split" or not split["invert"] or split["behavior"] != "Removed" or bytes_["type"] != "ByteLevel" or bytes_["use_regex"] or bytes_["add_prefix_space"]:
            raise ValueError("pre-tokenizer must be a split by pattern, then bytes")
        self.pattern: str = split["pattern"]["Regex"]
        if regex.search(self.pattern, " \t\n\x85 "):
            raise ValueError("the pattern must drop white space")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must match raw text exactly")
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        if not suffix:
            raise ValueError("an end-of-word suffix is needed")
        if max(ids.values()) >= 1 << 17 or max(map(len, ids)) > 255:
            raise ValueError("131072 tokens of up to 255 symbols are supported")
        self.labels = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in [*ids.items(), *self.special.items()]:
            self.labels[i] = token
        self._compile(ids, suffix, model["merges"])
        self._start()

    def _compile(self, ids: dict[str, int], suffix: str, merges: list) -> None:
        symbols = byte_symbols()
        base = [*symbols, *(s + suffix for s in symbols)]
        goes = {ids[s]: 0 for s in base if s in ids}
        removed: list[dict[int, int]] = [{}]  # of each state: token and the rank of the merge that removed its arc
        users = [len(goes)]  # how many tokens lead to each state
        self.left = array("i", [-1]) * len(self.labels)  # of each merged token: its left part
        self.rank = array("i", [-1]) * len(self.labels)
        for rank, merge in enumerate(merges):
            u, v = merge if isinstance(merge, list) else merge.split(" ")
            u, v, w = ids[u], ids[v], ids[u + v]
            q = goes.get(u)
            if q is None or v not in goes or not self._arc(removed[q], v):
                continue  # no path reads u then v: the gadget adds nothing
            then = goes[v]
            if u != v and users[q] == 1:
                removed[q][v] = rank  # the copy would leave no one in q
            else:
                removed.append(removed[q] | {v: rank})
                users[q] -= 1
                users.append(1)
                goes[u] = len(removed) - 1
            goes[w] = then
            users[then] += 1
            self.left[w], self.rank[w] = u, rank
        used = set(goes.values())
        self.goes = array("i", [-1]) * len(self.labels)
        for token, state in goes.items():
            self.goes[token] = state
        # the removed arcs of a state: tokens in order, and the ranks beside them
        self.bounds, self.gone, self.at = array("i", [0]), array("i"), array("i")
        for state, arcs in enumerate(removed):
            for token in sorted(arcs) if state in used else ():
                self.gone.append(token)
                self.at.append(arcs[token])
            self.bounds.append(len(self.gone))
        # the trie of all tokens that are arcs
        symbol_of = {s: i for i, s in enumerate(symbols)}
        self.child: dict[int, int] = {}
        self.ends, self.sizes, node_of = array("i", [-1]), bytearray(len(self.labels)), array("i", [0]) * len(self.labels)
        parent = array("i", [-1])
        for token in goes:
            label = self.labels[token]
            last = label.endswith(suffix)
            label = label[: -len(suffix)] if last else label
            self.sizes[token] = len(label)
            node = 0
            for i, char in enumerate(label):
                key = node << 9 | symbol_of[char] + 256 * (last and i == len(label) - 1)
                if key not in self.child:
                    self.child[key] = len(self.ends)
                    self.ends.append(-1)
                    parent.append(node)
                node = self.child[key]
            self.ends[node] = token
            node_of[token] = node
        self._in_order(parent, node_of)

    def _in_order(self, parent: array, node_of: array) -> None:
        """Places of the trie's nodes and of the last node below each, parents first, and the tokens in that order. Children are numbered after their parents."""
        n = len(parent)
        below = [1] * n
        for node in range(n - 1, 0, -1):
            below[parent[node]] += below[node]
        first, free = [0] * n, [1] * n
        for node in range(1, n):
            first[node] = free[parent[node]]
            free[parent[node]] += below[node]
            free[node] = first[node] + 1
        self.first = array("i", first)
        self.last = array("i", [first[i] + below[i] - 1 for i in range(n)])
        self.last_at = array("i", [0]) * n
        for node in range(n):
            self.last_at[first[node]] = self.last[node]
        self.place = array("i", [first[node] for node in node_of])
        token_at = [-1] * n
        for node in range(n):
            token_at[first[node]] = self.ends[node]
        self.in_order = array("i", [t for t in token_at if t >= 0])
        self.ends_before = array("i", [0, *np.cumsum([t >= 0 for t in token_at]).tolist()])

    def _arc(self, removed: dict[int, int], token: int) -> bool:
        before = 1 << 30
        while token >= 0:
            if removed.get(token, before + 1) <= before:
                return False
            before, token = self.rank[token], self.left[token]
        return True

    def _blocked(self, removed: tuple, token: int) -> bool:
        """Whether ``removed``, pairs of a token and the rank at which its arc went, leave no arc for ``token``: it was removed, or its left part was before the token was built."""
        before = 1 << 30
        while token >= 0:
            for gone, rank in removed:
                if gone == token and rank <= before:
                    return True
            before, token = self.rank[token], self.left[token]
        return False

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("moves", "states", "numbers", "firsts", "pieces", "words", "splits", "ascii_splits", "library", "arrow_labels", "special_pattern")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    def _start(self) -> None:
        self.words, self.pieces = _Kept(self.encode_word, WORDS), _Kept(self._piece, PIECES)
        self.splits = regex.compile(self.pattern.replace("\\s", _WHITE))
        # the standard library's patterns are faster; letters and numbers of lower-case ASCII are plain ranges where they stand in classes
        narrow = self.pattern.replace("\\s", "\\t-\\r ").replace("\\p{L}", "a-z").replace("\\p{N}", "0-9")
        self.ascii_splits = self.splits if "\\p" in re.sub(r"\[[^\]]*\]", "", self.pattern) or "\\p" in narrow else re.compile(narrow)
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.arrow_labels = pa.array(self.labels, pa.string())
        self.library = None
        self._begin()

    def _begin(self) -> None:
        """An empty table with the state before a word."""
        self.moves: dict[int, int] = {}
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.firsts: dict[int, tuple | None] = {}
        self._number(((), 0))

    def _number(self, state: tuple) -> int:
        found = self.numbers.get(state)
        if found is None:
            found = self.numbers[state] = len(self.states)
            self.states.append(state)
        return found

    def _first(self, state: int, symbol: int) -> tuple[int, tuple] | None:
        """The node that ``symbol`` begins, and what ``state`` has removed of the arcs from there."""
        key = state << 9 | symbol
        if key not in self.firsts:
            node = self.child.get(symbol)
            part = ()
            if node is not None:
                first, last = self.first[node], self.last[node]
                lo, hi = self.bounds[state], self.bounds[state + 1]
                part = tuple((t, r) for t, r in zip(self.gone[lo:hi], self.at[lo:hi]) if first <= self.place[t] <= last)
            self.firsts[key] = None if node is None else (node, part)
        return self.firsts[key]

    def _below(self, removed: tuple, node: int) -> tuple | None:
        """The part of ``removed`` that arcs below ``node`` depend on, tokens there and on the way there; None where no arc is left."""
        first, last = self.first[node], self.last[node]
        part = tuple([x for x in removed if first <= (at := self.place[x[0]]) <= last or at <= first <= self.last_at[at]])
        if part and last - first < _FEW and all(self._blocked(part, t) for t in self.in_order[self.ends_before[first] : self.ends_before[last + 1]]):
            return None
        return part

    def _move(self, state: int, symbol: int) -> int:
        """Fill in the table's move from ``state`` by ``symbol``: next state, token and its length in one number."""
        begun, last = self.states[state]
        if len(self.moves) >= MOVES:
            self._begin()
            state = self._number((begun, last))
        on, token = [], -1
        reached = [(node, removed and self._below(removed, node)) for before, removed in begun if (node := self.child.get(before << 9 | symbol)) is not None]
        for node, removed in (*reached, self._first(last, symbol)) if self._first(last, symbol) else reached:
            if removed is None:
                continue
            end = self.ends[node]
            if end >= 0 and token < 0 and not (removed and self._blocked(removed, end)):
                token = end
            if self.last[node] > self.first[node]:
                on.append((node, removed))
        if token < 0:
            raise ValueError(f"the vocabulary has no token that ends in byte {symbol & 255}")
        move = self._number((tuple(on), self.goes[token])) << 25 | token << 8 | self.sizes[token]
        self.moves[state << 9 | symbol] = move
        return move

    def encode_word(self, word: str) -> bytes:
        """Token ids (int32) of one pre-split word."""
        moves, state, path = self.moves, 0, []
        symbols = word.encode()
        last = symbols[-1] | 256
        for symbol in symbols[:-1]:
            move = moves.get(state << 9 | symbol)
            if move is None:
                move = self._move(state, symbol)
                moves = self.moves
            path.append(move)
            state = move >> 25
        path.append(moves.get(state << 9 | last) or self._move(state, last))
        at, out = len(path), []
        while at:
            move = path[at - 1]
            out.append(move >> 8 & 0x1FFFF)
            at -= move & 255
        out.reverse()
        return array("i", out).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece of text without white space and special tokens."""
        if piece.isascii():
            found = self.ascii_splits.findall(piece.lower())
        elif not _latin(piece) and any(unicodedata.category(c) == "Cn" for c in piece):
            found = self._by_library(piece)
        else:
            piece = unicodedata.normalize("NFC", piece)
            # one character at a time: in a whole string a final sigma would depend on its place
            found = self.splits.findall(piece.lower() if "Σ" not in piece else "".join(map(str.lower, piece)))
        words = self.words
        return self.encode_word(found[0]) if len(found) == 1 else b"".join([words[w] for w in found])

    def _by_library(self, piece: str) -> list[str]:
        if self.library is None:
            from tokenizers import Regex, normalizers, pre_tokenizers

            self.library = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]), pre_tokenizers.Split(Regex(self.pattern), "removed", invert=True)
        lower, split = self.library
        return [w for w, _ in split.pre_tokenize_str(lower.normalize_str(piece))]

    def spell(self, text: str) -> bytes:
        """Ids (int32) of a whole text."""
        if not self.special_pattern or "<" not in text or not self.special_pattern.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += [self._plain(text[at : m.start()]), array("i", [self.special[m.group()]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        pieces = self.pieces
        # str.split() also takes these four for white space
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return b"".join([pieces[p] for p in _SPACES.split(text) if p])
        return b"".join([pieces[p] for p in text.split()])

    def encode(self, text: str) -> list[int]:
        """Token ids of a whole text."""
        return np.frombuffer(self.spell(text), "<i4").tolist()

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Arc labels of each list of ids, joined by spaces as no decoder is set; null for null."""
        said = self.arrow_labels.take(ids.flatten())
        sizes = np.array(pc.fill_null(pc.list_value_length(ids), 0))
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), said), " ")


#: Characters with the Unicode property White_Space, as a part of a character class.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPACES = regex.compile(f"[{_WHITE}]+")


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def load(path: str) -> str:
    """The vocabulary file's text, read on the driver: a few MB whatever the data."""
    with open(path, encoding="utf-8") as f:
        return f.read()


_compiled: dict[str, Automaton] = {}


def _automaton(spec: str) -> Automaton:
    """The automaton of a vocabulary, compiled once on the driver."""
    if spec not in _compiled:
        _compiled.clear()
        _compiled[spec] = Automaton(json.loads(spec))
    return _compiled[spec]


def encode(docs: DataFrame, spec: str, keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """``keep``, the token ids of every row's text and, with ``decoded``, the text that these ids decode to."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(_automaton(spec))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [automaton.spell(text or "") for text in part.column("text").to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                more = {"decoded": automaton.decode(lists)} if decoded else {}
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in keep} | {"ids": lists} | more)

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*keep, F.col("text")).mapInArrow(run, ", ".join([*fields, "ids array<int>", *(["decoded string"] if decoded else [])]))


def decode(rows: DataFrame, spec: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the text that the ids of every row decode to; null ids decode to the empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(_automaton(spec))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], automaton.decode(part.column("ids"))], [*keep, "text"])

    fields = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return rows.select(*keep, "ids").mapInArrow(run, ", ".join([*fields, "text string"]))
