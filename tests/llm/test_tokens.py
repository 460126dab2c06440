"""Token ids, packing and Huffman files: exact round trips against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import huffman, packing, tokens

tokenizers = pytest.importorskip("tokenizers")
FILES = [tokens.public_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")]
ODD = ["", None, "  a", "a\x1cb", "don't STOP  it's", "é ́x", "\r\n\tfoo  \n bar", "hi <|endoftext|> there", "ΣΑΣ ΌΣ", "a　 　b ", "İ K ÀÉ ª²", "x" * 3000, "\x00 \x85", "<|startoftext|><|endoftext|>"]


@pytest.mark.parametrize("path", FILES)
def test_ids_are_the_librarys(path):
    t, e, r = tokenizers.Tokenizer.from_file(path), tokens.encoder(path), random.Random(3)
    cases = [x or "" for x in ODD]
    for letters in ("ab \n\t'sS1é  \x1c\x85!Σ́ Éßÿ×_-09'd", "ab \n\t'sS1é!ÉÿZ_-09'd  \r\x0b"):
        cases += ["".join(r.choice(letters) for _ in range(r.randrange(30))) for _ in range(1500)]
    for x in cases:
        assert np.frombuffer(e.ids(x.encode()), e.dtype).tolist() == t.encode(x, add_special_tokens=False).ids, x


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_packing(spark, docs_of):
    texts = ODD + ["some words here, and more. " * k for k in (1, 40, 700)]
    t = tokenizers.Tokenizer.from_file(FILES[1])
    df = docs_of(texts).unionByName(docs_of(["twice"], start=1))
    rows = packing.packed(spark, df, FILES[1], with_ids=True).collect()
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, x in enumerate(texts):
        if i == 1:  # two rows share this id
            continue
        want, at = t.encode(x or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            piece = want[at : at + r.length]
            assert (r.start, r.doc_tokens, r.ids_crc32, np.frombuffer(r.ids, "<u4").tolist()) == (at, len(want), crc(piece), piece)
            at += r.length
        assert at == len(want)
    total = sum(r.length for r in rows)
    for s, parts in by_seq.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 2048 or s == max(by_seq)
    assert len(by_seq) == -(-total // 2048)
    assert packing.packed(spark, docs_of([]), FILES[1]).isEmpty()


def test_ids_on_disk(spark, docs_of):
    texts = ODD + ["more words " * k for k in (1, 9, 5000)]
    df = docs_of(texts[::-1], start=-3).repartition(3).unionByName(docs_of([None]).selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars", "size"))
    t, at, want = tokenizers.Tokenizer.from_file(FILES[0]), 0, []
    for i, x in [(None, "")] + [(k - 3, x or "") for k, x in enumerate(texts[::-1])]:
        ids = t.encode(x, add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    manifest = huffman.write_ids(spark, df, FILES[0])
    got = [tuple(r) for r in huffman.read_ids(spark, manifest).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert huffman.read_ids(spark, huffman.write_ids(spark, docs_of([]), FILES[0])).isEmpty()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=700), st.integers(6, 18))
def test_codec_round_trip(ids, limit):
    ids = np.asarray(ids)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=41), limit)
    assert lengths.max() <= limit and (lengths[ids] > 0).all() and sum(2.0 ** -int(x) for x in lengths if x) <= 1
    bits, points = huffman.encode_block(ids, huffman.code_table(lengths))
    assert (huffman.decode_block(bits, points, len(ids), *huffman.decode_table(lengths)) == ids).all()


def huffman_cost(counts):
    import heapq

    heap, cost = sorted(c for c in counts if c), 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


@given(st.lists(st.integers(0, 1000), min_size=2, max_size=60))
def test_code_lengths_are_best_where_the_limit_is_wide(counts):
    c = np.asarray(counts)
    if (c > 0).sum() > 1:
        assert int((c * huffman.code_lengths(c, 24)).sum()) == huffman_cost(counts)
