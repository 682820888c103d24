import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from scrollmill.llm import byte_bpe as bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def texts():
    rng = random.Random(2)
    some = ["", None, "a", "<|endoftext|>", "it's  they're\n\n", " " * 3000, "a" * 20_000, "ab" * 5000, "\x00\u0085　x", "é漢🙂" * 50, "x" * 30 + " " * 7]
    return some + ["".join(rng.choice("aaabbb  \n\t'sthering漢é🙂01<>=-_") * rng.choice([1, 1, 1, 2, 9]) for _ in range(rng.randint(1, 300))) for _ in range(150)]


def test_ids_and_bytes(spark, plain):
    rows = [(i, t, 7) for i, t in enumerate(texts())] + [(None, "null id", 7), (2, "a", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    coded = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    got = bpe.decode(coded, PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        assert bpe.unpacked(r.ids) == plain.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert all(r.decoded == (r.text or "") for r in bpe.decode_text(coded, PATH).collect())
    assert bpe.decode(bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN), PATH).count() == 0


def test_small_tables_are_filled_again(plain):
    """A transducer that forgets its steps every so often writes the same tokens, and never lags far behind."""
    own, lag = bpe.Transducer(bpe.read_ranks(PATH), most_steps=40), 0
    for word in ("internationalisation", " unbelievably", "aaaaaaaaaaaaaaaaaaaaaaaaa" * 9, "  \n \n\n", "=" * 77, "übergrößenträger"):
        out: list[int] = []
        own.word(word.encode(), out.extend)
        assert out == plain._encode_single_piece(word) and own.made <= 40
        lag = max([lag, *[len(behind) for s in own.states for _, _, behind in s]])
    assert lag <= 8


@pytest.mark.parametrize("merges", [["ab", "abc", "bc", "bcd"], ["bc", "ab", "abc", "cd", "abcd"], ["aa", "aaa", "aaaa", "ba", "aab"], ["zz", "zzq"]])
def test_other_vocabularies(merges):
    """Against merging pair by pair, with tokens that no merges make, too."""
    ranks = {bytes((i,)): i for i in range(256)} | {m.encode(): 256 + i for i, m in enumerate(merges)}
    own, plain, rng = bpe.Transducer(ranks), tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={}), random.Random(1)
    for _ in range(400):
        word, out = "".join(rng.choice("abcdzq"[: rng.choice([2, 4, 6])]) for _ in range(rng.randint(1, 12))), []
        own.word(word.encode(), out.extend)
        assert out == plain.encode_ordinary(word)


def test_decoding_streams_whole_code_points(monkeypatch):
    spelled = {i: bytes((i,)) for i in range(256)}
    data = "aé漢🙂ࠀ퟿".encode() * 3 + b"\xe2\x28\xf0\x9f\xe0\x80\xed\xa0\xc0\xf5\x80\x80\x80\x80\x80z\xf0\x9f\x99"
    for flush in (1, 2, 3, 5, 4096):
        monkeypatch.setattr(bpe, "FLUSH", flush)
        parts = list(bpe.chunks(list(data), spelled))
        assert b"".join(parts) == data and "".join(bpe.text_of(list(data), spelled)) == data.decode("utf-8", "replace")
        good = list(bpe.chunks(list("aé漢🙂".encode() * 9), spelled))
        assert all(p.decode() is not None for p in good)


def test_digests_of_the_query(spark, sf_dir, plain):
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = plain.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in bpe.op12_byte_bpe(spark, sf_dir).collect()} == want


def test_words_are_remembered_across_tasks(plain):
    """What a worker coded once it does not code again in its next task; words that recur stay when the table is full."""
    first, second = (bpe._encoder(PATH, public_tokenizers.PATTERN) for _ in range(2))
    text = "alphabetagamma deltaepsilon zzqzz"
    want = np.array(plain.encode_ordinary(text), "<u4").tobytes()
    assert first([text, None]) == [[want, b""]]
    calls, own = [], bpe.transducer(PATH)
    own.word, word = lambda w, put: (calls.append(w), word(w, put)), own.word
    try:
        assert second([text]) == [[want]] and calls == []
    finally:
        del own.word
    made: list[str] = []
    known = bpe.Known(lambda w: made.append(w) or w.encode(), most=3)
    for w in "abacadaeafaga":
        assert known[w] == w.encode()
        assert len(known) <= 3 and len(known.older) <= 3
    assert made == list("abcdefg")
    known["x" * (bpe.LONG_WORD + 1)]
    assert "x" * (bpe.LONG_WORD + 1) not in known
