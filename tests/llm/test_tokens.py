"""Operators 3, 8 and 9 against the libraries they must agree with."""

import hashlib
import io
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import byte_bpe, packing, token_store, words
from tessella.llm.common import string_buffers, tokenizer_path

TEXTS = [
    None, "", " ", "a", "it's 'twas I'll we've 're'd ' 's  x's's don''t", "  foo  \n\n bar\t baz  ", "x\n y\n\n", "1a2'ses '", "é'ré d'avec ''s   z \x1c\x1dq",
    "日本語 テスト123½ ②³ _-_", "'", "'l", "a'l l", "<|endoftext|> hi", "\U0001f600\U0001f468‍ ok", "the the the the", "a" * 5000, "word " * 3000, "   x",
]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "a"), (None, "no id")]


@pytest.fixture(scope="module")
def library():
    import tiktoken
    from public_tokenizers import PATTERN

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(tokenizer_path("byte_bpe_50k.tiktoken")), special_tokens={})


@pytest.fixture(scope="module")
def docs(spark):
    # columns whose names clash with what the operators add
    return spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id long, text string, id string, n_tokens int")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_is_the_librarys(library):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    ids, offsets = words.library_encoder(tokenizer_path("byte_bpe_50k.json"))(*string_buffers(pa.array(TEXTS)))
    for k, text in enumerate(TEXTS):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids == library.encode_ordinary(text or "")


def test_small_cache_gives_the_same(library):
    small = words.Encoder(words.library_encoder(tokenizer_path("byte_bpe_50k.json")).encode_words, most_words=3)
    for text in TEXTS:
        ids, _ = small(*string_buffers(pa.array([text])))
        assert ids.tolist() == library.encode_ordinary(text or "")


def test_merge_replay(spark, docs, library):
    ranks = tokenizer_path("byte_bpe_50k.tiktoken")
    got = sorted(((r.id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in byte_bpe.decode(byte_bpe.encode(docs, ranks), ranks).collect()), key=str)
    want = sorted(((i, len(x := library.encode_ordinary(t or "")), np.array(x, "<u4").tobytes(), (t or "").encode()) for i, t in ROWS), key=str)
    assert got == want
    assert byte_bpe.encode(docs.limit(0), ranks).count() == 0


def test_lower_rank_comes_up_within_a_merge():
    # "bc" (rank 256+2) makes room for "abc" (256): the lower rank goes first in the same word
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"cb": 257, b"bc": 258, b"abcbc": 259}
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    replay = byte_bpe.MergeReplay(ranks)
    for word in ("abcbc", "abcabc", "bcbc", "abccbbc", "aaabcbcbc"):
        assert replay.replay([word.encode()])[0].tolist() == library.encode_ordinary(word)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_plane_file_round_trip(kind):
    rng, out = np.random.default_rng(1), io.BytesIO()
    lists = [rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32) for n in (0, 5, token_store.BLOCK * 5 + 3, 1, 70_000)]
    writer = token_store.PlaneWriter(out, kind)
    for k, x in enumerate(lists):
        writer.add([k if k else None], x, [len(x)])
    writer.close()
    file = pa.BufferReader(out.getvalue())
    reader = token_store.PlaneReader(file)
    got = list(reader.documents())
    assert [d for d, _ in got] == [None, 1, 2, 3, 4]
    assert all((a == b).all() and len(a) == len(b) for (_, a), b in zip(got, lists, strict=True))
    flat = np.concatenate(lists)
    assert (reader.ids(65_530, 200_001) == flat[65_530:200_001]).all()
    with pytest.raises(ValueError):
        token_store.PlaneReader(pa.BufferReader(out.getvalue()[:-20] + b"x" * 20))


def test_plane_files(spark, docs, library):
    manifest = token_store.write_files(docs, tokenizer_path("byte_bpe_50k.json"))
    got = sorted(((r.start, r.id, r.n_tokens, bytes(r.ids)) for r in token_store.read_files(manifest).collect()), key=lambda r: r[0])
    assert [r[1] for r in got] == sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x))
    start = 0
    left = sorted(str((i, [*library.encode_ordinary(t or ""), 2])) for i, t in ROWS)
    for at, _, n, ids in got:
        assert at == start and n == len(ids) // 4
        start += n
    assert sorted(str((i, np.frombuffer(x, "<u4").tolist())) for _, i, _, x in got) == left
    assert token_store.read_files(token_store.write_files(docs.limit(0), tokenizer_path("byte_bpe_50k.json"))).count() == 0


def test_packing(spark, docs, library):
    cut = packing.pieces(docs, tokenizer_path("byte_bpe_50k.json"), capacity=64)
    rows = packing.place(cut, capacity=64, bucket=8).collect()
    assert len(rows) == cut.count()
    whole, bins = {}, {}
    for r in rows:
        assert len(r.ids) == 4 * r.length <= 256
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        whole.setdefault(r.id, []).append((r.start, r.piece, r.length, bytes(r.ids)))
    for spans in bins.values():
        end = 0
        for a, n in sorted(spans):
            assert a == end
            end += n
        assert end <= 64
    for i, t in ROWS:
        if i != 3:
            parts = sorted(whole[i])
            assert b"".join(x[3] for x in parts) == np.array([*library.encode_ordinary(t or ""), 0], "<u4").tobytes()
            assert [x[1] for x in parts] == list(range(len(parts))) and all(x[2] == 64 for x in parts[1:])
    assert packing.place(packing.pieces(docs.limit(0), tokenizer_path("byte_bpe_50k.json"))).count() == 0


def test_sequences_hold_the_ids(spark, docs, library):
    placed = packing.place(packing.pieces(docs, tokenizer_path("byte_bpe_50k.json"), capacity=64), capacity=64, bucket=8)
    rows = packing.sequences(placed).collect()
    found = {}
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.n_tokens <= 64 and r.offsets[0] == 0
        for i, piece, a, b in zip(r.docs, r.piece_numbers, r.offsets, [*r.offsets[1:], r.n_tokens], strict=True):
            found.setdefault(i, []).append((piece, ids[a:b]))
    for i, t in ROWS:
        if i != 3:
            assert sum((x for _, x in sorted(found[i])), []) == [*library.encode_ordinary(t or ""), 0]
    assert packing.sequences(placed.limit(0)).count() == 0


def test_equal_and_null_ids_are_spread_over_buckets(spark):
    for doc_id in (None, 7):
        big = (1 << 60) + 1  # exact beside nulls too
        rows = spark.createDataFrame([(doc_id, 0, 5)] * 400 + [(big, 0, 5)], "id long, piece int, length long")
        got = packing.place(rows, capacity=10, bucket=50).collect()
        assert sorted(str(r.id) for r in got) == sorted([str(doc_id)] * 400 + [str(big)])
        sizes = np.unique([r.sequence_id >> 32 for r in got], return_counts=True)[1]
        assert len(sizes) > 5 and sizes.max() < 120


def squares_by_hand(lengths, capacity):
    gaps, made = [], []
    for size in lengths:
        fit = sorted({g for g in gaps if g >= size}) or [None]
        best = None
        for g in fit:
            after = list(gaps)
            if g is not None:
                after.remove(g)
            after.append((capacity if g is None else g) - size)
            total = sum(after.count(x) ** 2 for x in set(after) if x)
            if best is None or total < best[0]:
                best = (total, after)
        gaps = best[1]
        made.append(sorted(gaps))
    return made[-1] if made else []


def test_sum_of_squares_by_definition():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = rng.integers(1, 20, rng.integers(0, 40))
        sequence, _ = packing.sum_of_squares(lengths, 20)
        used = np.bincount(sequence, lengths) if len(lengths) else np.zeros(0)
        assert sorted(20 - used.astype(int)) == squares_by_hand(lengths.tolist(), 20)
