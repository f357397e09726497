import os
import random
import sys
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet
import pytest
from siltstone.llm import packing, rangecoder, token_files
from siltstone.llm.tokens import WordEncoder, encoder
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"
TEXTS = [
    "The quick brown fox.", None, "", "  \n", "don't I'll we've 'tis a'b's", "Straße ΣΑΣ ΟΔΟΣ. İstanbul É", "a\x1cb\x1fc d e f ̈x", "<|endoftext|> a<|startoftext|>b <|x|>",
    "x\x00y \x7f`~{|}<>", "१२३ 42 4.2e10 ½ ⅷ", "東京 日本語 한국어 😀👍🏽", "word " * 3000, "Zz!?" * 700, "The quick brown fox.",
]


def plain(text, end):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_words_encode_like_the_whole_text():
    words = WordEncoder(PATH)
    for _ in range(2):  # the second time from the cache
        for text in TEXTS:
            assert np.frombuffer(words.encode((text or "").encode()), "<u4").tolist() == plain(text, 0)[:-1]


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr("siltstone.llm.tokens.CACHE_WORDS", 3)
    words = WordEncoder(PATH)
    assert np.frombuffer(words.encode(b"one two three four five one two, six"), "<u4").tolist() == plain("one two three four five one two, six", 0)[:-1]


def test_random_latin_1_texts_encode_like_the_library():
    """10,000 texts over U+0000 to U+00FF: words that take the short way and words that don't."""
    rng, words, whole = random.Random(7), WordEncoder(PATH), Tokenizer.from_file(PATH)
    often = "abcdefgh ABCéèüÉß0123456789.,:;-_!?'\"\n\t"
    texts = ["".join(chr(rng.randrange(256)) if rng.random() < 0.3 else rng.choice(often) for _ in range(rng.randint(1, 40))) for _ in range(10_000)]
    for text, want in zip(texts, whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(words.encode(text.encode()), "<u4").tolist() == want.ids, text


@pytest.mark.parametrize("n", [0, 1, 2, 255, 1024, 1025, 5000])
@pytest.mark.parametrize("kind", ["random", "skewed", "constant", "edge", "wide", "phrases"])
def test_range_coder_round_trip(n, kind):
    rng = np.random.default_rng(n)
    phrase = rng.integers(0, 300, 40)
    ids = {
        "random": rng.integers(0, 1 << 16, n), "skewed": rng.zipf(1.3, n) % (1 << 16), "constant": np.full(n, 7), "edge": rng.choice([0, 65535], n),
        "wide": rng.integers(0, 1 << 32, n), "phrases": np.concatenate([phrase[: rng.integers(2, 40)] for _ in range(n + 1)])[:n],
    }[kind]
    alphabet, blocks = rangecoder.encode(ids.astype(np.uint32), block=1024)
    assert rangecoder.decode(alphabet, blocks, n, block=1024).tolist() == ids.tolist()
    for k, data in enumerate(blocks):  # a block needs no other one
        assert rangecoder.decode(alphabet, [data], len(ids[k * 1024 : (k + 1) * 1024]), block=1024).tolist() == ids[k * 1024 : (k + 1) * 1024].tolist()
    if kind == "constant" and n >= 1024:
        assert sum(map(len, blocks)) < n / 2


def test_long_blocks_and_full_counts(monkeypatch):
    """Several lanes, of which the last is shorter; counts that reach their limit."""
    rng = np.random.default_rng(1)
    for n in (70_000, 70_001, 131_072):
        ids = np.where(rng.random(n) < 0.9, 5, rng.integers(0, 900, n)).astype(np.uint32)
        alphabet, blocks = rangecoder.encode(ids)
        assert (rangecoder.decode(alphabet, blocks, n) == ids).all()


def test_files_are_smaller_than_deflate_and_than_order_0():
    rows = pyarrow.parquet.read_table(DOCUMENTS, columns=["text"]) if os.path.exists(DOCUMENTS) else pytest.skip("no test tables here")
    words = WordEncoder(PATH)
    ids = np.frombuffer(b"".join(words.encode((x or "").encode()) for x in rows["text"].to_pylist()), "<u4")
    payload = token_files.dump([1], [len(ids)], ids)
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    entropy = -(share * np.log2(share)).sum() * len(ids) / 8
    assert len(payload) < 0.95 * entropy
    assert len(payload) < 0.9 * len(zlib.compress(ids.astype("<u2").tobytes(), 9))
    assert (token_files.load(payload)[2] == ids).all()


def test_an_alphabet_that_is_too_large_is_refused(monkeypatch):
    monkeypatch.setattr(rangecoder, "ALPHABET_LIMIT", 3)
    with pytest.raises(ValueError):
        rangecoder.encode(np.arange(4, dtype=np.uint32))


def test_damage_is_found():
    payload = token_files.dump([1, None], [2, 3], np.arange(5, dtype=np.uint32))
    assert [x.tolist() if hasattr(x, "tolist") else x for x in token_files.load(payload)] == [[1, None], [2, 3], [0, 1, 2, 3, 4]]
    for at in (0, 10, len(payload) // 2, len(payload) - 1):
        with pytest.raises(token_files.DamagedFile):
            token_files.load(payload[:at] + bytes([payload[at] ^ 1]) + payload[at + 1 :])
    with pytest.raises(token_files.DamagedFile):
        token_files.load(payload[:20])


def test_files_against_the_library(spark, documents, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "PAYLOAD_IDS", 1000)
    path = str(tmp_path / "ids")
    token_files.write(documents(TEXTS), path, PATH, end_id=1)
    start, want = 0, []
    for k, text in enumerate(TEXTS):
        ids = plain(text, 1)
        want.append((k, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(tuple(r) for r in token_files.read_checksums(spark, path).collect()) == want
    assert {r["doc_id"]: r["ids"] for r in token_files.read(spark, path).collect()} == {k: plain(t, 1) for k, t in enumerate(TEXTS)}


def test_empty_files(spark, documents, tmp_path):
    path = str(tmp_path / "none")
    token_files.write(documents([]), path, PATH, end_id=1)
    assert token_files.read_checksums(spark, path).count() == 0


ODD = "doc_id long, text string, id string, h long, start string, piece int"
ODD_ROWS = [(None, "one two"), (None, None), (3, "b a"), (3, "a b"), (3, "a b"), (-2, "z" * 300), (9, "")]


def test_null_and_repeated_ids_in_files(spark, tmp_path):
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in ODD_ROWS], ODD).repartition(3)
    path = str(tmp_path / "odd")
    token_files.write(docs, path, PATH, end_id=1)
    rows = token_files.read(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, None, -2, 3, 3, 3, 9]
    assert sorted(map(str, ((r["doc_id"], list(r["ids"])) for r in rows))) == sorted(map(str, ((i, plain(t, 1)) for i, t in ODD_ROWS)))
    assert [r["start"] for r in rows] == [sum(r["n_tokens"] for r in rows[:k]) for k in range(len(rows))]


def test_null_and_repeated_ids_in_packing(spark):
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in ODD_ROWS], ODD).repartition(3)
    rows = packing.pack_documents(docs, PATH, end_id=0, capacity=16).collect()
    want = [(i, a, crc(plain(t, 0)[a : a + 16])) for i, t in ODD_ROWS for a in range(0, len(plain(t, 0)), 16)]
    assert sorted(map(str, ((r["doc_id"], r["start"], r["ids_crc32"]) for r in rows))) == sorted(map(str, want))
    check_packed(rows, 16)


def check_packed(rows, capacity):
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing_against_the_library(documents):
    rows = packing.pack_documents(documents(TEXTS), PATH, end_id=0, capacity=64).collect()
    want = []
    for k, text in enumerate(TEXTS):
        ids = plain(text, 0)
        want += [(k, a // 64, a, len(ids[a : a + 64]), crc(ids[a : a + 64])) for a in range(0, len(ids), 64)]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert check_packed(rows, 64) == -(-sum(w[3] for w in want) // 64)
    assert packing.pack_documents(documents([]), PATH, end_id=0, capacity=64).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_plan_fills_every_slot_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 2048])
    histogram = {rng.randint(1, capacity): rng.randint(1, 500) for _ in range(rng.randint(1, 60))}
    used, ranks = defaultdict(int), defaultdict(set)
    for r in packing.plan(histogram, capacity):
        for i in range(r.sequences * r.each):
            used[r.sequence + i // r.each] += r.length
            assert r.first + i not in ranks[r.length]
            ranks[r.length].add(r.first + i)
    assert {k: len(v) for k, v in ranks.items()} == histogram
    assert max(used.values()) <= capacity
    bins = []
    for length in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):  # best fit, item by item
        fit = [k for k, b in enumerate(bins) if b >= length]
        if fit:
            bins[min(fit, key=lambda k: bins[k])] -= length
        else:
            bins.append(capacity - length)
    assert len(used) == len(bins)


def test_plan_refuses_what_does_not_fit():
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


def test_ids_that_are_not_whole_numbers_are_refused(spark, tmp_path):
    docs = spark.createDataFrame([("a", "text")], "doc_id string, text string")
    with pytest.raises(TypeError, match="whole number"):
        token_files.write(docs, str(tmp_path / "x"), PATH, end_id=1)


def test_texts_of_megabytes(spark, tmp_path):
    """Files and packing of a text of millions of letters beside short ones: all ids, in order, in whole pieces."""
    rng = random.Random(12)
    long = " ".join("".join(rng.choices("abcdefghij", k=rng.randint(1, 12))) for _ in range(250_000))
    docs = spark.createDataFrame([(1, long), (2, "short"), (3, None)], "doc_id long, text string")
    want = {1: plain(long, 1), 2: plain("short", 1), 3: plain("", 1)}
    token_files.write(docs, str(tmp_path / "files"), PATH, end_id=1)
    assert {r["doc_id"]: r["ids"] for r in token_files.read(spark, str(tmp_path / "files")).collect()} == want
    pieces = packing.pack_documents(docs, PATH, end_id=1, capacity=2048).where("doc_id = 1").orderBy("piece").collect()
    ends = [p["start"] + p["length"] for p in pieces]
    assert [p["start"] for p in pieces] == [0, *ends[:-1]] and ends[-1] == len(want[1]) and all(p["length"] == 2048 for p in pieces[:-1])
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert [p["ids_crc32"] for p in pieces] == [crc(want[1][p["start"] : p["start"] + p["length"]]) for p in pieces]


def test_slices_cut_at_white_space_change_nothing(monkeypatch):
    """Texts of many scripts, cut into slices of some bytes and encoded together: the library's ids, and how many each text has."""
    rng, whole = random.Random(3), Tokenizer.from_file(PATH)
    often = "abcXYZ ÀÖ×÷ßÿ019.,-'\n\t\x0b\x1c\x85\xa0 Σσéπ東ё̈<|>"
    texts = ["".join(rng.choices(often, k=rng.randint(0, 60))) for _ in range(2_000)] + TEXTS
    want = [e.ids for e in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for size in (1, 7, 500, 1 << 22):
        monkeypatch.setattr("siltstone.llm.tokens.SLICE_BYTES", size)
        ids, counts = WordEncoder(PATH).encode_all([(t or "").encode() for t in texts], 9)
        assert np.split(ids, np.cumsum(counts))[-1].size == 0
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts))[:-1]] == [[*w, 9] for w in want]
    with pytest.raises(UnicodeDecodeError):
        WordEncoder(PATH).encode(b"ab \xc3x")


def test_calls_go_by_distinct_parts_and_not_by_words():
    """20,000 different words of 17 parts: the library sees each part once, and no word has calls of its own."""
    words, calls = WordEncoder(PATH), []
    text = " ".join(f"Word{k} word,{k}." for k in range(10_000)) + " WORD:"
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    try:
        got = words.encode(text.encode())
    finally:
        sys.setprofile(None)
    assert np.frombuffer(got, "<u4").tolist() == plain(text, 0)[:-1]
    assert len(calls) < 2_000


def test_blocks_side_by_side_are_the_blocks_alone():
    """Whatever is coded beside it, a block has the bytes that it had when blocks were coded one by one."""
    ids = (np.arange(9_000, dtype=np.uint64) * 2654435761 % 4093 % 97 * (np.arange(9_000) % 7 + 1)).astype(np.uint32)
    _, blocks = rangecoder.encode(ids, block=2000)
    assert [zlib.crc32(b) for b in blocks] == [635325852, 2635097271, 408920670, 1783552881, 2952747277]
    for block, n in ((2000, 9000), (2048, 8192), (2048, 9000), (2048, 8193), (1024, 9000), (256, 1791)):
        own = []
        for group in (1, 2, 3, 4, 5):
            with pytest.MonkeyPatch.context() as patch:
                patch.setattr(rangecoder, "GROUP", group)
                found, blocks = rangecoder.encode(ids[:n], block=block)
                assert (rangecoder.decode(found, blocks, n, block=block) == ids[:n]).all()
                own = own or blocks
                assert blocks == own
                parts = [rangecoder.decode(found, [b], min(block, n - k * block), block=block) for k, b in enumerate(blocks)]
                assert (np.concatenate(parts) == ids[:n]).all()


def test_blocks_side_by_side_share_their_calls():
    """Four blocks make the numpy calls of about one, when they are written and when they are read."""
    ids = np.random.default_rng(5).integers(0, 300, 4096).astype(np.uint32)

    def calls(f):
        seen = []
        sys.setprofile(lambda frame, event, arg: seen.append(event) if event in ("call", "c_call") else None)
        try:
            f()
        finally:
            sys.setprofile(None)
        return len(seen)

    (one, data), (four, more) = rangecoder.encode(ids[:1024], block=1024), rangecoder.encode(ids, block=1024)
    assert calls(lambda: rangecoder.encode(ids, block=1024)) < 2 * calls(lambda: rangecoder.encode(ids[:1024], block=1024))
    assert calls(lambda: rangecoder.decode(four, more, 4096, block=1024)) < 2 * calls(lambda: rangecoder.decode(one, data, 1024, block=1024))


def test_the_next_task_finds_the_parts_of_the_one_before(monkeypatch):
    """Token files keep a worker's cache: the library doesn't see known parts again. Without ``keep`` it is released."""
    texts = [(t or "").encode() for t in TEXTS]
    with encoder(PATH, keep=True) as words:
        ids, counts = words.encode_all(texts, 1)
    with encoder(PATH) as words:
        monkeypatch.setattr(words, "model", None)
        monkeypatch.setattr(words, "tokenizer", None)
        again, own = words.encode_all(texts, 1)
        assert again.tolist() == ids.tolist() == [i for t in TEXTS for i in plain(t, 1)] and own.tolist() == counts.tolist()
    with encoder(PATH) as words, pytest.raises(AttributeError):
        words.encode(b"quick")


@pytest.mark.parametrize("slices", [1, 2, 3])
def test_parts_looked_up_for_several_slices_at_once(monkeypatch, slices):
    """Rounds of few small slices, a cache that is always full, and texts that a round ends within."""
    monkeypatch.setattr("siltstone.llm.tokens.SLICES", slices)
    monkeypatch.setattr("siltstone.llm.tokens.SLICE_BYTES", 16)
    monkeypatch.setattr("siltstone.llm.tokens.CACHE_WORDS", 3)
    ids, counts = WordEncoder(PATH).encode_all([(t or "").encode() for t in TEXTS], 1)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts))[:-1]] == [plain(t, 1) for t in TEXTS]


def test_quotients_by_doubles_are_whole():
    """Up to the bounds that the coder has: also just below and at multiples."""
    rng = np.random.default_rng(8)
    b = np.concatenate([rng.integers(1, 1 << 26, 100_000), rng.integers(1, 1 << 9, 1000), [(1 << 26) - 1, (1 << 24) - 1, 1 << 24, 1]])
    most = np.minimum((1 << 48) // b, 1 << 25) - 1
    for q in (most, (most * rng.random(len(b))).astype(np.int64), np.ones_like(b)):
        for a in (q * b, np.maximum(q * b - 1, 0), q * b + b - 1, q * b + rng.integers(0, b)):
            assert (rangecoder._quotient(a, b) == a // b).all()


def test_a_block_of_a_thousand_lanes_keeps_its_bytes():
    """The bytes that the coder made before its arrays lay by steps."""
    k = np.arange(1 << 18, dtype=np.uint64)
    ids = (k * np.uint64(2654435761) % np.uint64(4093) % np.uint64(97) * (k % np.uint64(7) + np.uint64(1))).astype(np.uint32)
    alphabet, blocks = rangecoder.encode(ids)
    assert [zlib.crc32(b) for b in blocks] == [4098008627]
    assert (rangecoder.decode(alphabet, blocks, len(ids)) == ids).all()
