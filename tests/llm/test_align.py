"""11: groups and link counts against plain code over the libraries' tokens of whole texts."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
from tessera.llm import align

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """Tokens of a whole text as (id, bytes) by each library."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}

    def cut(text):
        of_a = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(f" {text}", add_special_tokens=False).ids]
        of_b = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
        return of_a, of_b

    return cut


def grouped(text, cut):
    """Groups as lists of ids and links, or None."""
    if not text:
        return None
    sides = cut(text)
    if any(b"".join(x for _, x in s) != f" {text}".encode() for s in sides):
        return None
    ends = []
    for s in sides:
        at, own = 0, {}
        for n, (_, x) in enumerate(s):
            at += len(x)
            own[at] = n
        ends.append(own)
    groups, links, low = [], [], (0, 0)
    for at in sorted(set(ends[0]) & set(ends[1])):
        to = (ends[0][at] + 1, ends[1][at] + 1)
        groups.append(tuple([i for i, _ in s[p:q]] for s, p, q in zip(sides, low, to, strict=True)))
        links.append((sides[0][to[0] - 1][0], sides[1][to[1] - 1][0]))
        low = to
    return groups, links


def line(groups):
    return ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups)


def test_aligned(plain, base):
    rng = random.Random(8)
    parts = ["a", " ", "  ", "\n", " \n ", "\t", "é", "漢字", "😀", "word", " Word", "ing", ".", "12", "<s>", "<|endoftext|>", "\x00", "\xa0", "▁", "<0x41>", "\x1c", "'s"]
    rows = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(1500)] + [t for _, t, *_ in base if t][:60] + ["", " ", "   ", "a "]
    own = align.Aligner(A, B)
    assert own.cuts
    for row, got in zip(rows, own.aligned(rows), strict=True):
        want = grouped(row, plain)
        assert (got is None) == (want is None), repr(row)
        if want:
            pairs, times = list(got[4]), list(got[5])
            assert got[2:4] == (len(want[0]), line(want[0])), repr(row)
            assert Counter({(p >> 32, p & 0xFFFFFFFF): n for p, n in zip(map(int, pairs), times, strict=True)}) == Counter(want[1])
            assert (got[0], got[1]) == tuple(sum(len(g[i]) for g in want[0]) for i in (0, 1))
    whole = align.Aligner(A, B)
    whole.cuts = False
    for x, y in zip(own.aligned(rows), whole.aligned(rows), strict=True):
        assert (x is None and y is None) or (x[:4] == y[:4] and (x[4] == y[4]).all() and (x[5] == y[5]).all())


def test_labels(plain):
    own = align.Aligner(A, B)
    text = "unbelievable naïve 漢字"
    a, b = plain(text)
    label = own.labels([[i for i, _ in a]], [[i for i, _ in b]])
    assert re.fullmatch(rb"[0-3]*3", label) and len(label) == len(f" {text}".encode())
    assert label.count(b"1") + label.count(b"3") == len(a) and label.count(b"2") + label.count(b"3") == len(b)


@pytest.mark.parametrize("hot", [align.HOT_PAIRS, 50, 0])
def test_figures(spark, docs, rows, plain, hot):
    """Any share of the pairs may be hot; the result is the same."""
    per = {i: grouped(t, plain) for i, t, *_ in rows}
    count = Counter(x for g in per.values() if g for x in g[1])
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = {r["doc_id"]: r.asDict() for r in align.link_figures(docs, A, B, hot).collect()}
    assert len(out) == len(rows)
    for i, g in per.items():
        want = {"doc_id": i, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "n_best": 0, "count_sum": 0, "groups_sha256": ""}
        if g:
            want |= {"n_a": sum(len(x) for x, _ in g[0]), "n_b": sum(len(x) for _, x in g[0]), "n_groups": len(g[0]), "n_links": len(g[1])}
            want |= {"n_best": sum(count[x] == best[x[1]] for x in g[1]), "count_sum": sum(count[x] for x in g[1]), "groups_sha256": hashlib.sha256(line(g[0]).encode()).hexdigest()}
        assert out[i] == want, i


def test_odd_tables(spark, empty):
    assert align.link_figures(empty, A, B).count() == 0
    odd = spark.createDataFrame([(None, "a b", 1), (None, "a b", 1), ("x", None, 2), ("y", "", 3)], "doc_id string, text string, pairs int")
    out = sorted((r["doc_id"] or "", r["n_groups"], r["count_sum"], r["groups_sha256"] == "") for r in align.link_figures(odd, A, B).collect())
    assert out == [("", 2, 4, False), ("", 2, 4, False), ("x", 0, 0, True), ("y", 0, 0, True)]
    with pytest.raises(ValueError):
        align.SideA(P.path("word_bpe_49k.json"))
