"""Packing, periodic runs and alignment of tokenizers against brute force and odd input."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pytest
from tidemark.llm import alignment, bpe, packing, periodic, queries
from tidemark.llm.merges import Speller

DOCS = "doc_id bigint, text string, row string, length int, ids int"


def docs(spark, texts, parts=3):
    rows = [(i if i % 11 else None if i else 0, t, f"r{i}", 7, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(parts) if texts else spark.createDataFrame([], DOCS)


def prose(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# packing


@pytest.fixture(scope="module")
def spec():
    return bpe.load(queries.tokenizer_path())


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_speller_equals_the_library(spec):
    rng = random.Random(6)
    texts = [t or "" for t in odd_texts(rng)] + ["Straße ÀÉ Σας ΣΑΣ don't WE'LL", "a<|endoftext|>b", "x" * 300, "aaa aaaa aaaaa", "é É"]
    speller = Speller(bpe._automaton(spec), spec)
    for _ in range(2):
        ids, ends = speller.spell(pa.array(texts))
        assert [[*ids[a:b].tolist(), 1] for a, b in zip([0, *ends[:-1]], ends, strict=True)] == library_ids(texts)


def check_packed(rows, ids_of, size):
    """Each id in one piece, sequences gapless, and padding only where a sequence is no power of two."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and r.doc_tokens == len(ids_of[r.row.ids])
        by_doc[r.row.ids].append((r.start, ids))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert {k: sum((ids for _, ids in sorted(v)), []) for k, v in by_doc.items()} == ids_of
    for v in by_doc.values():
        assert [s for s, _ in sorted(v)] == list(accumulate([len(i) for _, i in sorted(v)][:-1], initial=0))
    padding = 0
    for v in by_sequence.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert 0 < at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


@pytest.mark.parametrize("most_open", [4096, 5])
def test_packing_holds_every_id_once(spark, spec, most_open):
    rng = random.Random(3)
    texts = [prose(rng, rng.choice([0, 1, 3, 20, 60, 500])) for _ in range(200)] + [None, "", " \n", "x" * 3000, prose(rng, 9000), "same", "same", "same"]
    packed = packing.pack(docs(spark, texts), spec, size=256, most_open=most_open)
    rows = packed.collect()
    assert check_packed(rows, dict(enumerate(library_ids(texts))), 256) == 0
    assert {r.row.row for r in rows} == {f"r{i}" for i in range(len(texts))} and {r.row.length for r in rows} == {7}


def test_packing_takes_the_level_of_least_squares():
    rng = random.Random(4)
    packer, levels, size = packing.Packer(100, 10**6), Counter(), 100
    for _ in range(3000):
        n = rng.choice([3, 10, 31, 37, 60, 99, rng.randrange(1, 100)])

        def squares(h, levels=levels, n=n):
            after = Counter(levels)
            after[h] -= h > 0
            after[h + n] += h + n < size
            return sum(v * v for v in after.values())

        best = min([0, *(h for h, v in levels.items() if v and h + n <= size)], key=lambda h: (squares(h), -h))
        assert packer.level(n) == best
        for window in packer.add(None, np.zeros(n, "<u4")):
            assert sum(len(p[2]) for p in window) == size
        levels[best] -= best > 0
        levels[best + n] += best + n < size
        assert {h: v for h, v in levels.items() if v} == {h: int(v) for h, v in enumerate(packer.count) if v}


def test_packing_of_one_length_and_of_nothing(spark, spec):
    """Documents of which no two fit in a window, and an empty table."""
    texts = [prose(random.Random(1), 40) for _ in range(30)]
    rows = packing.pack(docs(spark, texts, 1), spec, size=256).collect()
    assert check_packed(rows, dict(enumerate(library_ids(texts))), 256) == 0
    assert packing.pack(docs(spark, []), spec).collect() == []


# periodic runs


def runs_by_definition(w, least=6, times=4):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(least, times * q):
                found.setdefault((i, n), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed_by_definition(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_texts(rng):
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "A a A a A a a a a a a a", "a a a b a a a b a a a b a a a b a"]
    for vocabulary in (1, 2, 3, 300):
        texts += [prose(rng, rng.randrange(1, 200), vocabulary) for _ in range(15)]
    for q in [*range(1, 40), 63, 64, 65, 127, 128, 129, 200, 513]:
        block = prose(rng, q, rng.choice([2, 5, 1000])).split()
        n = rng.choice([4 * q - 1, 4 * q, 4 * q + q // 2, 7 * q])
        texts.append(" ".join(prose(rng, rng.randrange(0, 30)).split() + [block[i % q] for i in range(n)] + prose(rng, rng.randrange(0, 30)).split()))
    inner = prose(rng, 20).split() * 5
    texts.append(" ".join((inner + prose(rng, 30).split()) * 4))  # runs inside the periods of a run
    thue = [0]
    while len(thue) < 2000:
        thue += [1 - x for x in thue]
    texts.append(" ".join(map(str, thue)))
    fibonacci = ["a", "a b"]
    while len(fibonacci[-1]) < 3000:
        fibonacci.append(fibonacci[-1] + " " + fibonacci[-2])
    texts += [fibonacci[-1], "é x\x1f y " * 9, "same same same same same same", "same same same same same same"]
    return texts


def test_runs_equal_the_definition(spark):
    rng = random.Random(8)
    texts = periodic_texts(rng)
    found = {r.row.ids: r for r in periodic.find(docs(spark, texts)).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        w = [x.decode() for x in (t or "").encode().split()]
        expected = runs_by_definition(w)
        assert [tuple(x) for x in found[i].runs] == expected, i
        assert found[i].n_words == len(w) and found[i].collapsed == collapsed_by_definition(w, expected)
    assert sum(len(f.runs) for f in found.values()) > 60


def test_runs_of_long_texts_and_of_nothing(spark):
    rng = random.Random(9)
    block = prose(rng, 3000, 10**6)
    text = " ".join([prose(rng, 20000, 10**6), *[block] * 5, prose(rng, 100, 10**6)])
    (row,) = periodic.find(docs(spark, [text])).collect()
    assert [tuple(r) for r in row.runs] == [(20000, 15000, 3000)]
    assert periodic.find(docs(spark, [])).collect() == []


def test_query_of_periodic_runs(spark, data):
    """The whole query on the smallest tables, with the planted runs, against the definition."""
    texts = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in queries.op12_periodic(spark, data).collect()}
    assert len(found) == len(texts)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in texts:
        w = [x.decode() for x in (r.text or "").encode().split()]
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if len(w) > 1500:
            continue
        runs = runs_by_definition(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        got = found[r.doc_id]
        assert (got.n_runs, got.start, got.length, got.period) == (len(runs), *best)
        assert got.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert got.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)) and got.collapsed_sha256 == sha(collapsed_by_definition(w, runs))


# alignment


@pytest.fixture(scope="module")
def vocabularies():
    with open(queries._vocabulary("", "piece_bpe_32k.model"), "rb") as f:
        return bpe.load(queries._vocabulary("", "byte_bpe_50k.json")), f.read()


def aligned_by_definition(texts, byte_spec, piece_model):
    """Whole texts through both libraries, groups and links by their byte offsets, counts in one table."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_str(byte_spec)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
    a_bytes = alignment.ByteSide(byte_spec).bytes
    out = []
    for t in texts:
        whole = (" " + (t or "")).encode()
        a, b = a_side.encode(" " + (t or ""), add_special_tokens=False).ids, b_side.encode(t or "")
        told_b = [b"".join([bytes([int(p[3:5], 16)])]) if b_side.is_byte(k) else p.replace("▁", " ").encode() for k in b for p in [b_side.id_to_piece(k)]]
        if not t or b"".join(a_bytes[x] for x in a) != whole or b"".join(told_b) != whole:
            out.append(([], [], [], []))
            continue
        ends_a, ends_b = list(accumulate(len(a_bytes[x]) for x in a)), list(accumulate(map(len, told_b)))
        links = [(x, y) for x, e in zip(a, ends_a, strict=True) for y in [dict(zip(ends_b, b, strict=True)).get(e)] if y is not None] if len(b) < 3000 else None
        if links is None:
            by_end = dict(zip(ends_b, b, strict=True))
            links = [(x, by_end[e]) for x, e in zip(a, ends_a, strict=True) if e in by_end]
        both, groups, low = sorted(set(ends_a) & set(ends_b)), [], 0
        for end in both:
            inside = lambda ids, ends, low=low, end=end: ",".join(str(x) for x, e in zip(ids, ends, strict=True) if low < e <= end)
            if len(both) < 3000:
                groups.append(f"{inside(a, ends_a)}|{inside(b, ends_b)}")
            low = end
        out.append((a, b, groups if len(both) < 3000 else [None] * len(both), links))
    count = Counter(x for d in out for x in d[3])
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return [(len(a), len(b), len(g), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), None if None in g else ";".join(g)) for a, b, g, links in out]


def odd_texts(rng):
    chars = ["a", "b", "é", "ß", " ", " ", " ", "\n", "\t", "  ", " ", "　", "\x1c", "\x85", "日本", "😀", "é", "'s", "'ll", "123", "...", "▁", "<0x0A>", "<|endoftext|>", "<s>", "\r\n", "\x00", "Ω", "​"]
    texts = [None, "", " ", "  ", "\n", " a", "a ", " a b", "a  b", "a   b", "a \n b", "▁", "a▁b", "<|endoftext|> <s>", "x" * 500, "日本語" * 200, "word " * 400]
    texts += ["".join(rng.choice(chars) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    return texts + ["the same words in every text of this group"] * 40 + [prose(rng, rng.randrange(1, 200)) for _ in range(60)] + [prose(rng, 4000)]


@pytest.mark.parametrize("block, fan", [(1 << 20, 64), (50, 3)])
def test_alignment_equals_whole_texts(spark, vocabularies, block, fan):
    rng = random.Random(12)
    texts = odd_texts(rng)
    expected = aligned_by_definition(texts, *vocabularies)
    aligned = alignment.align(docs(spark, texts), *vocabularies, most_links=block)
    found = {r.row.ids: r for r in alignment.count_links(aligned, vocabularies[0], fan=fan).collect()}
    assert len(found) == len(texts)
    for i, (n_a, n_b, n_groups, n_links, n_best, count_sum, groups) in enumerate(expected):
        r = found[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == (n_a, n_b, n_groups, n_links, n_best, count_sum), (i, texts[i])
        assert groups is None or r.groups == groups


def test_merge_by_heap_equals_one_table():
    rng = np.random.default_rng(2)
    runs = []
    total = Counter()
    for _ in range(9):
        keys = np.unique(rng.integers(0, 5000, rng.integers(1, 3000)).astype("<u8") << 30)
        counts = rng.integers(1, 9, len(keys)).astype("<u8")
        total.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
        frames = []
        for at in range(0, len(keys), 100):
            k = keys[at : at + 100]
            frames += [alignment._squeeze(np.concatenate([k[:1], np.diff(k)])), alignment._squeeze(counts[at : at + 100])]
        runs.append(alignment._join(frames))
    merged = [(k, c) for keys, counts in alignment._merged(runs) for k, c in zip(keys.tolist(), counts.tolist(), strict=True)]
    assert merged == sorted(total.items())


def test_alignment_of_nothing(spark, vocabularies):
    for texts in ([], [None, ""]):
        rows = alignment.count_links(alignment.align(docs(spark, texts), *vocabularies), vocabularies[0]).collect()
        assert [(r.n_a, r.n_links, r.count_sum, r.groups) for r in rows] == [(0, 0, 0, "")] * len(texts)
