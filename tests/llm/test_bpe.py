import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from remitta.llm import bpe  # noqa: E402


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})


TEXTS = ["", " ", "a", "don't  stop\n\n", "日本語 text", "😀😀", "a" * 5000, "ab" * 3000 + "é", " " * 3000 + "x", "<|endoftext|>", "\x00\x01", "1234567 %%% ***"]


def test_as_the_library(reference):
    coder = bpe.installed("byte_bpe_50k.tiktoken")
    rng = random.Random(3)
    parts = ["a", "the", " ", "\n", "é", "日本", "'s", "12", "%%", "ing", "aaaa", "A", "\t"]
    for text in TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(2000)]:
        ids = coder.encode(text)
        assert ids.tolist() == reference.encode_ordinary(text), text[:50]
        assert coder.decode(ids) == text.encode()


def test_tree_and_queue_agree():
    """Joining halves gives what merging the whole by rank gives, on long runs too."""
    coder = bpe.installed("byte_bpe_50k.tiktoken")
    rng = random.Random(4)
    for n in (2, 15, 16, 17, 33, 200, 2000):
        data = bytes(rng.choice(b"abcdeth") for _ in range(n))
        assert coder.encode_piece(data) == coder.merged(data)


def test_small_memories(monkeypatch, reference):
    monkeypatch.setattr(bpe, "MEMORY", 5)
    monkeypatch.setattr(bpe, "SHORT_MEMORY", 5)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        coder = bpe.TreeBPE(bpe.read_ranks(f.read()), public_tokenizers.PATTERN)
    text = "many different words, again and again: words differently said " * 20
    assert coder.encode(text).tolist() == reference.encode_ordinary(text)


def test_rows(spark, reference):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(90, None), (90, None), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("z"))
    got = bpe.bpe(spark, df, with_ids=True).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    for r, (i, t) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), rows):
        ids = reference.encode_ordinary(t or "")
        assert (r.doc_id, r.n_tokens, r["ids"]) == (i, len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decoded(bpe.bpe(spark, df.filter("doc_id < 20"), with_ids=True)).collect()}
    assert back == dict(rows[: len(TEXTS)])
    assert bpe.bpe(spark, df.limit(0)).count() == 0


def test_long_pieces_grow_little_faster_than_their_length():
    """Pieces without a break, of one letter and of many."""
    import random
    import time

    from remitta.llm.bpe import installed

    coder, rng = installed("byte_bpe_50k.tiktoken"), random.Random(4)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(80_000))
    for text in ("a" * 80_000, letters):
        took = []
        for n in (40_000, 80_000):
            began = time.perf_counter()
            ids = coder.encode(text[:n])
            took.append(time.perf_counter() - began)
            assert coder.decode(ids) == text[:n].encode()
        assert took[1] < 4 * took[0] + 0.2
