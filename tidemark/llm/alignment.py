"""Alignment of the tokens of two tokenizers, with the counts of linked tokens over all documents.

``align`` reads every text with both tokenizers. Tokens are taken as the bytes they stand for; places where tokens of both sides end cut a text into groups, and the two tokens that end at such
a place are linked. A text is read in parts that begin at a space between two other characters: no token of either side goes over such a place (the files are checked for it; else the text is
one part), and both sides have an end there, so tokens, groups and links of a part don't depend on what stands around it, and parts that recur are kept.

``count_links`` counts every pair of linked tokens by external spill counting. Records (pair, document, times) of a block of documents are sorted by pair, the second tokenizer's id first,
and dealt by a radix of that id into zstd runs, written to the shared folder beside their documents. For each radix the runs' keys, one entry a pair and block, meet in a k-way merge
by a heap of run heads, at most ``fan`` runs at a time, in as many rounds as needed. In this side-major order all pairs of one id follow each other, so that its largest count is known when the next id begins. The
counts then stream back: the records of each radix and of a few blocks meet the counts of the radix, and every block adds up what its documents get.

A frequent id or pair is one entry a block in the merge, however many documents hold it, and its records stay split by blocks; nothing of it is gathered in one task.

Defined cases: texts that are null or empty, or whose tokens don't give a space and the text back (a text with U+2581), have no tokens: zero counts and empty groups; rows that repeat a doc_id, or have
none, are documents of their own and count each; texts of any length are read whole; the other columns come back as the struct ``row``, so no name can clash; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm.merges import Merges
from tidemark.llm.scratch import save, small_batches

RADIX = 64  # runs a block
_AT_BITS = 20  # for the number of a document in its block
_FRAME = 8192  # entries of a run that are read at once
_KEPT = 120_000  # parts of texts that a worker remembers
_LONG = 64  # characters; longer parts are not remembered
#: A space between two characters that aren't white space.
_BETWEEN = re.compile(r" (?<=\S )(?=\S)")
_OTHER = re.compile(r"[^\S \n]")


#: Fixed value: how the byte-level vocabulary cuts words, white space and letters in ASCII ranges; parts in other letters than Latin-1 are left to the library.
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_LATIN_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\t-\r \x85\xa0\p{L}\p{N}]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+")


class ByteSide:
    """A byte-level BPE of a tokenizers JSON file, read with a space before the text; strings of special tokens are plain text."""

    def __init__(self, spec: str):
        self.spec, self.library = spec, None
        said = json.loads(spec)
        model = said["model"]
        # the bytes that stand for themselves in a byte-level vocabulary; the others are written as the code points from 256 on, in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        self.bytes = [b""] * (max(model["vocab"].values()) + 1)
        for token, k in model["vocab"].items():
            self.bytes[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        before = said.get("pre_tokenizer") or {}
        self.splits = said.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
        usual = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
        self.merges = Merges(model) if self.splits and all(model.get(k) == v for k, v in usual.items()) else None

    def _by_library(self, parts: list[str]) -> list[bytes]:
        if self.library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.spec)
            self.library.encode_special_tokens = True
        return [np.array(e.ids, "<i4").tobytes() for e in self.library.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]

    def encode(self, parts: list[str]) -> list[bytes]:
        """Ids (int32) of each part with a space before it."""
        words: dict[str, int] = {}
        cut: list[list[int] | None] = []
        for p in parts:
            if self.merges is None or not (ascii_ := p.isascii()) and not bpe._latin(p) or len(p) > _LONG:
                cut.append(None)
            elif p.isalpha():
                cut.append([words.setdefault(" " + p, len(words))])
            else:
                cut.append([words.setdefault(w, len(words)) for w in (_ASCII_WORDS if ascii_ else _LATIN_WORDS).findall(" " + p)])
        ids: list[bytes] = []
        told = [w.encode() for w in words]
        for at in range(0, len(told), 4096):
            ids += self.merges.encode(told[at : at + 4096])
        left = iter(self._by_library([p for p, c in zip(parts, cut, strict=True) if c is None]) if None in cut else ())
        return [next(left) if c is None else ids[c[0]] if len(c) == 1 else b"".join([ids[w] for w in c]) for c in cut]


class PieceSide:
    """A SentencePiece model, which adds the space before the text itself."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.splits = not any(re.search("[^▁]▁", p) for p in pieces)

    def encode(self, parts: list[str]) -> list[list[int]]:
        return self.model.encode(parts, num_threads=1)


def _parts(text: str) -> list[str]:
    """A text cut at the spaces between two characters that aren't white space."""
    if "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or _OTHER.search(text):
        return _BETWEEN.split(text)
    return text.split(" ")


class Aligner:
    """Tokens, groups and links of texts. A link is a number: the second side's id, dealt by radix, above the first side's id."""

    def __init__(self, a: ByteSide, b: PieceSide):
        self.a, self.b = a, b
        self.splits = a.splits and b.splits
        self.a_bits = len(a.bytes).bit_length()
        self.share = -(-len(b.bytes) // RADIX)  # ids of the second side a radix
        if (self.share * RADIX).bit_length() + self.a_bits + _AT_BITS > 64:
            raise ValueError("vocabularies too large for 64-bit records")
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side.bytes]) for side in (a, b))
        # how a token is written inside a group, at its end, and (second side) at the end of a part
        self.said = [f"{k}{end}" for side, ends in ((a, ",|"), (b, (",", ";", ""))) for end in ends for k in range(len(side.bytes))]
        self.known: dict[str, tuple | None] = {}

    def _read(self, parts: list[str]) -> dict[str, tuple | None]:
        """(tokens of both sides, groups, links) of parts, looked at together."""
        whole = [b" " + p.encode() for p in parts]
        a_ids, b_ids = self.a.encode(parts), self.b.encode(parts)
        a, b = np.frombuffer(b"".join(a_ids), "<i4"), np.array([t for x in b_ids for t in x], np.int32)
        expected = b"".join(whole)
        if b"".join([self.a.bytes[t] for t in a.tolist()]) != expected or b"".join([self.b.bytes[t] for t in b.tolist()]) != expected:
            same = lambda side, ids, text: b"".join([side.bytes[t] for t in ids]) == text
            good = [same(self.a, np.frombuffer(x, "<i4").tolist(), w) and same(self.b, y, w) for x, y, w in zip(a_ids, b_ids, whole, strict=True)]
            return dict.fromkeys(parts) | (self._read(some) if (some := [p for p, g in zip(parts, good, strict=True) if g]) else {})
        ends = np.cumsum([len(w) for w in whole])
        a_end, b_end = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        shared = np.intersect1d(a_end, b_end, assume_unique=True)
        a_last, b_last = np.searchsorted(a_end, shared), np.searchsorted(b_end, shared)
        id_b = b[b_last].astype(np.uint64)
        links = (id_b % RADIX * self.share + id_b // RADIX) << np.uint64(self.a_bits) | a[a_last].astype(np.uint64)
        a_code, b_code = a.astype(np.int64), b.astype(np.int64) + 2 * len(self.a_sizes)
        a_code[a_last] += len(self.a_sizes)
        b_code[b_last] += len(self.b_sizes)
        b_code[np.searchsorted(b_end, ends)] += len(self.b_sizes)
        # the first side of a group, then the second
        order = np.argsort(np.concatenate([2 * np.searchsorted(shared, a_end), 2 * np.searchsorted(shared, b_end) + 1]), kind="stable")
        said = self.said
        written = [said[c] for c in np.concatenate([a_code, b_code])[order].tolist()]
        n_a, n_b = [len(x) // 4 for x in a_ids], [len(x) for x in b_ids]
        to = np.cumsum(np.add(n_a, n_b)).tolist()
        link_to = (8 * np.searchsorted(shared, ends, "right")).tolist()
        data, out, at, link_at = links.astype("<u8").tobytes(), {}, 0, 0
        for p, i, j, end, link_end in zip(parts, n_a, n_b, to, link_to, strict=True):
            out[p] = (i, j, "".join(written[at:end]), data[link_at:link_end])
            at, link_at = end, link_end
        return out

    def read(self, texts: list[str]) -> Iterator[tuple[int, int, str, bytes]]:
        """Of each text the number of tokens of both sides, the groups and the links."""
        split = [(_parts(t) if self.splits else [t]) if t else [] for t in texts]
        if len(self.known) > _KEPT:
            self.known.clear()
        here = self.known
        new = list({p for parts in split for p in parts if p not in here})
        for at in range(0, len(new), 8192):
            here.update(self._read(new[at : at + 8192]))
        for parts in split:
            found = [here[p] for p in parts]
            if not found or None in found:
                yield 0, 0, "", b""
            else:
                n_a, n_b, groups, links = zip(*found, strict=True)
                yield sum(n_a), sum(n_b), ";".join(groups), b"".join(links)
        for p in new:
            if len(p) > _LONG:
                del here[p]


def _squeeze(x: np.ndarray) -> bytes:
    """zstd of an array's bytes, first bytes first: small numbers leave long stretches of zeros."""
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def _unsqueeze(data: bytes, kind: str) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(wide, -1).T).reshape(-1).view(kind)


def _join(parts: list[bytes]) -> bytes:
    return b"".join(struct.pack("<I", len(p)) + p for p in parts)


def _split(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        (n,) = struct.unpack_from("<I", data, at)
        yield data[at + 4 : at + 4 + n]
        at += 4 + n


def _run(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A run of ascending keys and their counts, in frames."""
    frames = []
    for at in range(0, len(keys), _FRAME):
        k = keys[at : at + _FRAME]
        frames += [_squeeze(np.concatenate([k[:1], np.diff(k)])), _squeeze(counts[at : at + _FRAME].astype("<u8"))]
    return _join(frames)


def _frames(run: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    parts = _split(run)
    for keys in parts:
        yield np.cumsum(_unsqueeze(keys, "<u8"), dtype=np.uint64), _unsqueeze(next(parts), "<u8")


def _merged(runs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys in order with the sums of their counts: a heap has the last key read of every run, and all up to the smallest of these is complete."""
    readers = [_frames(r) for r in runs]
    heads: list[tuple[np.ndarray, np.ndarray]] = [next(r, None) for r in readers]
    heap = [(int(h[0][-1]), k) for k, h in enumerate(heads) if h is not None]
    heapq.heapify(heap)
    while heap:
        bound = np.uint64(heap[0][0])
        keys, counts = [], []
        for _, k in heap:
            head_keys, head_counts = heads[k]
            to = int(np.searchsorted(head_keys, bound, "right"))
            keys.append(head_keys[:to])
            counts.append(head_counts[:to])
            heads[k] = head_keys[to:], head_counts[to:]
        while heap and heap[0][0] <= bound:
            _, k = heapq.heappop(heap)
            heads[k] = next(readers[k], None)
            if heads[k] is not None:
                heapq.heappush(heap, (int(heads[k][0][-1]), k))
        all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(all_keys, kind="stable")
        all_keys, all_counts = all_keys[order], all_counts[order]
        first = np.flatnonzero(np.concatenate([[True], all_keys[1:] != all_keys[:-1]]))
        yield all_keys[first], np.add.reduceat(all_counts, first)


def _together(streams: Iterator[tuple[np.ndarray, np.ndarray]]) -> bytes:
    both = list(streams)  # pairs of ids of one radix: bounded by the vocabularies
    return _run(np.concatenate([k for k, _ in both]), np.concatenate([c for _, c in both]))


def align(docs: DataFrame, byte_spec: str, piece_model: bytes, most_links: int = 1 << 19) -> DataFrame:
    """A row a document: ``row`` (its other columns), ``n_a``, ``n_b``, ``n_groups``, ``groups`` (``a1,a2|b1;a3|b2``) and, for ``count_links``, ``block``, ``at`` and ``runs``.

    ``byte_spec``, ``piece_model``: what the two vocabulary files hold; they are broadcast, some MB whatever the data. ``most_links``: links a block, about.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((byte_spec, piece_model))
    row = F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row")
    run_type = pa.list_(pa.struct([("radix", pa.int32()), ("keys", pa.binary()), ("records", pa.binary())]))

    def spilled(aligner: Aligner, links: list[bytes]) -> list[dict]:
        """The runs of a block: keys with their counts, and the documents and times of each."""
        sizes = [len(x) // 8 for x in links]
        records = np.frombuffer(b"".join(links), "<u8") << np.uint64(_AT_BITS) | np.repeat(np.arange(len(links), dtype=np.uint64), sizes)
        records.sort()
        first = np.flatnonzero(np.concatenate([[True], records[1:] != records[:-1]])) if len(records) else np.zeros(0, int)
        times = np.diff(np.append(first, len(records))).astype("<u4")
        pairs, at = records[first] >> np.uint64(_AT_BITS), (records[first] & np.uint64((1 << _AT_BITS) - 1)).astype("<u4")
        edges = np.searchsorted(pairs, np.array([(r * aligner.share) << aligner.a_bits for r in range(RADIX + 1)], np.uint64))
        out = []
        for r in range(RADIX):
            low, high = edges[r], edges[r + 1]
            if low == high:
                continue
            own = pairs[low:high]
            start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            documents = np.diff(np.append(start, len(own))).astype("<u4")
            counts = np.add.reduceat(times[low:high].astype("<u8"), start)
            out.append({"radix": r, "keys": _run(own[start], counts), "records": _join([_squeeze(documents), _squeeze(at[low:high]), _squeeze(times[low:high])])})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(ByteSide(shared.value[0]), PieceSide(shared.value[1]))
        block = TaskContext.get().partitionId() << 33
        rows, found, n_links = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal rows, found, n_links, block
            n_a, n_b, groups, links = zip(*found, strict=True)
            spills = pa.array([spilled(aligner, links) or None, *[None] * (len(found) - 1)], run_type)
            arrays = [pa.concat_arrays(rows), *[pa.array(x, pa.int64()) for x in (n_a, n_b, [len(x) // 8 for x in links])], pa.array(groups), pa.array([block] * len(found), pa.int64()), pa.array(range(len(found)), pa.int32()), spills]
            rows, found, n_links, block = [], [], 0, block + 1
            return pa.RecordBatch.from_arrays(arrays, ["row", "n_a", "n_b", "n_groups", "groups", "block", "at", "runs"])

        for batch in batches:
            for low in range(0, batch.num_rows, 128):
                part = batch.slice(low, 128)
                for i, one in enumerate(aligner.read(part.column("text").to_pylist())):
                    rows.append(part.column("row").take(pa.array([i])))
                    found.append(one)
                    n_links += len(one[3]) // 8
                    if n_links >= most_links or len(found) >> _AT_BITS:
                        yield flush()
        if found:
            yield flush()

    kind = docs.select(row).schema["row"].dataType.simpleString()
    fields = "n_a long, n_b long, n_groups long, groups string, block long, at int, runs array<struct<radix:int,keys:binary,records:binary>>"
    return docs.select(row, F.col("text").cast("string").alias("text")).mapInArrow(run, f"row {kind}, {fields}")


def _merge(group: pa.Table) -> pa.Table:
    """The runs of a radix as one."""
    return pa.table({"radix": group.column("radix").slice(0, 1), "block": group.column("block").slice(0, 1), "keys": pa.array([_together(_merged(group.column("keys").to_pylist()))], pa.binary())})


def _counted(a_bits: int):
    """The whole counts of a radix: its keys, their counts, and whether a count is the largest of its second-side id."""

    def count(group: pa.Table) -> pa.Table:
        out, open_keys, open_counts = [], np.zeros(0, np.uint64), np.zeros(0, np.uint64)

        def close(keys: np.ndarray, counts: np.ndarray) -> None:
            if len(keys):
                ids = keys >> np.uint64(a_bits)
                first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
                most = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(ids))))
                out.append((keys, counts, counts == most))

        for keys, counts in _merged(group.column("keys").to_pylist()):
            keys, counts = np.concatenate([open_keys, keys]), np.concatenate([open_counts, counts])
            # the last id may go on
            to = int(np.searchsorted(keys >> np.uint64(a_bits), keys[-1] >> np.uint64(a_bits)))
            close(keys[:to], counts[:to])
            open_keys, open_counts = keys[to:], counts[to:]
        close(open_keys, open_counts)
        keys, counts, best = (np.concatenate(x) for x in zip(*out, strict=True))
        totals = _join([_squeeze(np.concatenate([keys[:1], np.diff(keys)])), _squeeze(counts), _squeeze(best.astype(np.uint8))])
        return pa.table({"radix": group.column("radix").slice(0, 1), "totals": pa.array([totals], pa.binary()), "pairs": pa.array([len(keys)], pa.int64())})

    return count


def _contributed(cells: pa.Table, totals: pa.Table) -> pa.Table:
    """Of each block's run what its documents get from this radix."""
    blocks, given = [], []
    if cells.num_rows:
        keys, counts, best = (_unsqueeze(x, kind) for x, kind in zip(_split(totals.column("totals")[0].as_py()), ("<u8", "<u8", "u1"), strict=True))
        keys = np.cumsum(keys, dtype=np.uint64)
        for block, run, records in zip(cells.column("block").to_pylist(), cells.column("keys").to_pylist(), cells.column("records").to_pylist(), strict=True):
            own = np.concatenate([k for k, _ in _frames(run)])
            documents, at, times = (_unsqueeze(x, "<u4") for x in _split(records))
            place = np.repeat(np.searchsorted(keys, own), documents)
            most = int(at.max()) + 1
            sums, bests = np.zeros(most, np.int64), np.zeros(most, np.int64)
            np.add.at(sums, at, counts[place].astype(np.int64) * times)
            np.add.at(bests, at, times.astype(np.int64) * best[place])
            blocks.append(block)
            given.append(_join([_squeeze(sums), _squeeze(bests)]))
    return pa.table({"block": pa.array(blocks, pa.int64()), "given": pa.array(given, pa.binary())})


def _added(group: pa.Table) -> pa.Table:
    """What the documents of a block get from all radices."""
    both = [[_unsqueeze(x, "<i8") for x in _split(g)] for g in group.column("given").to_pylist()]
    sums = np.zeros((2, max(len(b[0]) for b in both)), np.int64)
    for b in both:
        for k in range(2):
            sums[k, : len(b[k])] += b[k]
    n = sums.shape[1]
    return pa.table({"block": pa.array([group.column("block")[0].as_py()] * n, pa.int64()), "at": pa.array(range(n), pa.int32()), "count_sum": pa.array(sums[0]), "n_best": pa.array(sums[1])})


def count_links(aligned: DataFrame, byte_spec: str, fan: int = 64) -> DataFrame:
    """``aligned`` (of ``align``; other columns may stand in place of ``groups``) without ``block``, ``at`` and ``runs``, and of each document ``n_links``, ``n_best`` (links whose pair is as frequent as any of its second-side id) and ``count_sum``
    (the sum over its links of how many links of all documents join the same ids)."""
    a_bits = (max(json.loads(byte_spec)["model"]["vocab"].values()) + 1).bit_length()
    kept = save(aligned, "aligned")
    cells = kept.where("runs is not null").select("block", F.explode("runs").alias("run")).select("block", "run.*")
    keys, n = cells.select("radix", "block", "keys"), kept.where("runs is not null").count()
    groups = -(-n // fan)
    slot = F.pmod(F.xxhash64("block"), F.lit(max(groups, 1)))
    while n > fan:
        n = -(-n // fan)
        keys = save(keys.groupBy("radix", F.pmod(F.xxhash64("block"), F.lit(n)).alias("slot")).applyInArrow(_merge, "radix int, block long, keys binary"), "runs")
    totals = save(keys.groupBy("radix").applyInArrow(_counted(a_bits), "radix int, totals binary, pairs long"), "totals")
    # a radix' counts once for each group of blocks
    dealt = totals.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(max(groups, 1) - 1)).cast("array<long>")))
    both = cells.withColumn("slot", slot).groupBy("radix", "slot").cogroup(dealt.groupBy("radix", "slot"))
    given = both.applyInArrow(_contributed, "block long, given binary").groupBy("block").applyInArrow(_added, "block long, at int, count_sum long, n_best long")
    found = kept.drop("runs").join(given, ["block", "at"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.select(*[c for c in aligned.columns if c not in ("block", "at", "runs")], F.col("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"))
