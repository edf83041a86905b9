import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from fieldbook.llm import bpe, packing, token_counts, wordpieces  # noqa: E402

WORD, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
BYTES, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(3)
    bits = ["a", "B", "é", "É", "ß", "İ", "ſ", "Σ", "ς", "'s", "'LL", ".", ",", "!?", "$$", "<|endoftext|>", "<|ENDOFTEXT|>", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "é", "漢字", "1", "½", "ª", "µ", "×", "🙂", "​", "\x00", '"', "\\"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 25))) for _ in range(4000)]


def test_stretches_give_the_library_ids(library, texts):
    ids, counts = wordpieces.packed_ids(WORD), wordpieces.counts(WORD)
    assert wordpieces.drops_blanks(WORD) and not wordpieces.drops_blanks(BYTES) and not wordpieces.drops_blanks(PIECES)
    for text in [*odd_texts(), *(t for _, t in texts if t)]:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids(text.encode()), "<u4").tolist() == want
        assert counts(text.encode()) == len(want)


def test_other_tokenizers_get_whole_texts(spark, docs, texts, tmp_path):
    import sentencepiece
    from tokenizers import Tokenizer

    said = [(i, t) for i, t in texts if t is None or len(t) < 2000] + [(1000, "a  b"), (1001, "a b"), (1002, " a b\n")]
    df = spark.createDataFrame(said, "doc_id bigint, text string")
    library, model = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for path, encode in ((BYTES, lambda t: library.encode(t, add_special_tokens=False).ids), (PIECES, model.encode)):
        want = {i: len(encode(t or "")) for i, t in said}
        store = str(tmp_path / "both")  # one store for both tokenizers: versions keep them apart
        assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df, path, store).collect()} == want
    packed = packing.pack_documents(df, BYTES).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in packed} == {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in said}


def test_pieces_with_clashing_columns(spark):
    from fieldbook.session import settled

    df = settled(spark.createDataFrame([(1, 5, "x", 7, "g")] * 300, "offset int, length bigint, sequence_id string, piece int, _group string"))
    got = packing.pack_pieces(df, capacity=10, group_rows=100)
    assert got.columns == ["length", "piece", "_group", "sequence_id", "offset"]
    rows = got.collect()
    assert len(rows) == 300 and len({r["sequence_id"] for r in rows}) <= 152 and {r["offset"] for r in rows} == {0, 5}
    with pytest.raises(Exception, match="between 1 and"):
        packing.pack_pieces(df, capacity=4).collect()


def test_token_counts(spark, docs, texts, none, library, tmp_path):
    store = str(tmp_path / "counts")
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in texts}
    for _ in range(2):  # the second run takes all counts from the store
        got = token_counts.token_counts(docs, WORD, store).collect()
        assert {r["doc_id"]: r["n_tokens"] for r in got} == want
        assert all(r["n_bytes"] == len((dict(texts)[r["doc_id"]] or "").encode()) and r["over_limit"] == (r["n_tokens"] > 2048) for r in got)
        rows = spark.read.parquet(store).count()
    assert rows < len(texts) and rows == spark.read.parquet(store).select("digest").distinct().count()
    assert token_counts.token_counts(none, WORD).collect() == []


def test_packing(docs, texts, none, library):
    for capacity, groups in ((4096, 20_000), (64, 40)):
        rows = packing.pack_documents(docs, WORD, capacity=capacity, group_rows=groups).collect()
        by_doc, by_sequence = defaultdict(list), defaultdict(list)
        for r in rows:
            by_doc[r["doc_id"]].append(r)
            by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        for i, t in texts:
            ids, at = [*library.encode(t or "", add_special_tokens=False).ids, 1], 0
            for r in sorted(by_doc[i], key=lambda r: r["piece"]):
                own = np.array(ids[at : at + capacity], "<u4")
                assert (r["start"], r["length"], r["ids_crc32"]) == (at, len(own), zlib.crc32(own.tobytes()))
                at += len(own)
            assert at == len(ids)
        for own in by_sequence.values():
            end = 0
            for offset, length in sorted(own):
                assert offset == end
                end += length
            assert end <= capacity
    assert packing.pack_documents(none, WORD).collect() == []


def test_best_two_fit_is_tight():
    sequence, _ = packing.best_two_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert sequence.max() + 1 == 2
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 2000, 3000)
    sequence, offset = packing.best_two_fit(lengths, 4096)
    assert sequence.max() + 1 <= -(-lengths.sum() // 4096) + 1
    assert np.bincount(sequence, lengths).max() <= 4096


def test_replacement_by_two():
    # Greedy takes 6 and then 3, which leaves 1; 3 gives way to 2 + 2, which fill the gap.
    sequence, _ = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert sequence[0] == sequence[2] == sequence[3] != sequence[1]


def test_bpe_merges_equal_the_library(tik, texts):
    ranks, own = bpe.Ranks(RANKS), bpe.encoder(RANKS, P.PATTERN)
    rng = random.Random(1)
    long = ["".join(rng.choice("abc!é") for _ in range(n)) for n in (65, 200, 3000)] + ["!" * 500, "a" * 1000]
    for text in [*odd_texts(), *long, *(t for _, t in texts if t)]:
        ids, bounds = own.encode([text])
        assert ids.tolist() == tik.encode_ordinary(text)
        assert bpe.decoder(RANKS).decode(ids, bounds) == [text.encode()]
    for piece in (b"hello", b"abcabcabc", "überé".encode()):
        assert np.frombuffer(bpe.merge_many([piece], ranks)[0], "<u4").tolist() == bpe.merge_one(piece, ranks)


def test_bpe_columns(docs, texts, none, tik):
    rows = bpe.bpe_digests(docs, RANKS, P.PATTERN).collect()
    by = dict(texts)
    assert len(rows) == len(texts)
    for r in rows:
        ids = tik.encode_ordinary(by[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((by[r["doc_id"]] or "").encode()).hexdigest()
    split = bpe.bpe_decode(bpe.bpe_encode(docs.select("doc_id", "text"), RANKS, P.PATTERN), RANKS).collect()
    assert {r["doc_id"]: bytes(r["decoded"]) for r in split} == {i: (t or "").encode() for i, t in texts}
    assert bpe.bpe_digests(none, RANKS, P.PATTERN).collect() == []
