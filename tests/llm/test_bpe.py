"""13: ids and bytes against the tiktoken library, the perfect hash and the heap against plain code."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
from tessera.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return bpe.coder(PATH)


@pytest.fixture(scope="module")
def library(own):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    assert bpe.SPLITTER == P.PATTERN and own.ranks == ranks
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash(own):
    """Each key has a slot of its own and no slot is empty, also for a handful of keys."""
    for keys in (list(own.ranks), [b"a"], [b"a", b"b", b"c"], [b"%d" % i for i in range(1000)]):
        assert sorted(bpe.PerfectHash(keys).slots(keys).tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError):
        bpe.PerfectHash([b"a", b"a"])


def test_random_texts(own, library):
    rng = random.Random(3)
    parts = [*"ab  \n\t'sdé١٢߀½ \x0b\x1c\x85\xa0　漢字😀՘Ᲊʼ", "<|endoftext|>", "\U00011de0", "\U0003eba4", "'ll", "'re", "\r\n", "ing", " the"]
    rows = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)]
    assert own.encode(rows) == [library.encode_ordinary(r) for r in rows]
    assert [own.decode(x) for x in own.encode(rows)] == [r.encode() for r in rows]


def test_long_texts(own, library):
    """Pieces of a long text are cut as the whole; a pre-token of any length ends."""
    rng = random.Random(4)
    rows = ["".join(rng.choices(["xyz", "  ", "\n", " word", "é", "12", " \n "], k=200_000)), "ab" * 60_000, " " * 300_000, "漢" * 50_000]
    assert own.encode(rows) == [library.encode_ordinary(r) for r in rows]


def test_every_class(own, library):
    """Each character beside a letter, a digit and a symbol: cut as the library does it."""
    rows = ["".join(f"a{chr(c)}1{chr(c)}!" for c in range(s, s + 512) if not 0xD800 <= c < 0xE000) for s in range(0, 0x32000, 512)]
    assert own.encode(rows) == [library.encode_ordinary(r) for r in rows]


def test_merges_against_plain(own):
    """The heap's answer is that of looking for the best pair again and again."""
    rng = random.Random(5)
    for _ in range(300):
        piece = bytes(rng.choices(b"aeinrst \xc3\xa9\xff", k=rng.randint(1, 25)))
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            found = [(own.ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in own.ranks]  # noqa: B905
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert bpe.merge([b"xx", piece, b"y"], own.ranks, own._pairs())[1] == tuple(own.ranks[p] for p in parts)


def test_operator(spark, docs, empty, rows, library, own):
    out = {r["doc_id"]: r for r in bpe.digests(bpe.round_trip(docs, PATH)).collect()}
    assert len(out) == len(rows)
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert (out[i]["n_tokens"], out[i]["ids_sha256"], out[i]["decoded_sha256"]) == want, i
    back = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    assert back == {i: (t or "").encode() for i, t, *_ in rows}
    assert bpe.digests(bpe.round_trip(empty, PATH)).count() == 0 and bpe.encode(empty, PATH).count() == 0
    odd = spark.createDataFrame([(None, "a"), (None, "a"), ("x", None)], "doc_id string, text string")
    assert sorted((r["doc_id"] or "", len(r["ids"])) for r in bpe.encode(odd, PATH).collect()) == [("", 1), ("", 1), ("x", 0)]
    with pytest.raises(ValueError):
        own.decode([-1])
    with pytest.raises(IndexError):
        own.decode([10**6])
