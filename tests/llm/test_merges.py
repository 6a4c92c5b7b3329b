import hashlib
import random

import cases
import public_tokenizers
import tiktoken

from issueloom.llm import merges

FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = merges.read_ranks(FILE)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def odd_texts():
    rng = random.Random(3)
    letters = "abcdest  \n\t\x1c\x85\xa0é1'stl.,日😀"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(600)]


def test_blocks_equal_the_library():
    given = [t or "" for t in cases.texts()] + odd_texts() + ["a" * 3000, "ab" * 999, "<|endoftext|>"]
    encoder = merges.Encoder(RANKS, public_tokenizers.PATTERN)
    got = encoder.block(given)
    assert got == [LIBRARY.encode_ordinary(t) for t in given]
    assert [encoder.decode(ids) for ids in got] == [t.encode() for t in given]
    assert encoder.block(given[:50]) == got[:50]  # from what was kept


def test_merge_that_opens_a_lower_rank_waits():
    # "ab" (rank 258) beside "c" opens "abc" (257), which must go before the second "ab".
    ranks = {bytes([i]): i for i in range(256)} | {b"bc": 256, b"abc": 257, b"ab": 258, b"abcab": 259, b"aa": 260}
    vocabulary = merges.Vocabulary(ranks)
    words = [b"abcab", b"abab", b"aaaaa", b"cabca", b"", b"abcabc", b"bcabcaaab"]
    library = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    want = [library.encode_ordinary(w.decode()) for w in words]
    assert merges.replay(words, vocabulary) == want
    assert [vocabulary.one(w) for w in words] == want


def test_documents(spark):
    got = merges.encode_documents(cases.docs(spark), FILE, public_tokenizers.PATTERN, with_ids=True)
    rows = got.collect()
    text = {r[0]: r[1] or "" for r in cases.rows() if r[0] is not None}
    assert len(rows) == len(cases.rows())
    for r in rows:
        if r.doc_id is None:
            continue
        ids = LIBRARY.encode_ordinary(text[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    decoded = merges.decode_documents(got, FILE).filter("doc_id IS NOT NULL").collect()
    assert all(bytes(r.decoded) == text[r.doc_id].encode() for r in decoded)
    assert merges.encode_documents(cases.empty(spark), FILE, public_tokenizers.PATTERN).collect() == []
