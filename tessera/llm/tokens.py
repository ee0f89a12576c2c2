"""3. Token counts by a map-side two-tier lookup.

The byte-level splitter of the tokenizer cuts a text at every single space that
has no white space on both sides.  A pre-token here is a run from one space to the
next; the tokens of the runs add up to those of the text.  Texts with white space on
both sides of a space, texts that hold one of the model's added tokens, and all texts of
tokenizers of another kind (another splitter, a normalizer, sentencepiece) go through the library whole.

First tier: a broadcast hash table of the lengths of frequent pre-tokens, found
in a bounded sample (it only saves time; counts don't depend on it).  Second tier:
each worker keeps the lengths of pre-tokens that it had to encode, up to a fixed
number.  No row and no pre-token is shuffled.

Null text: empty, 0 tokens.  Special strings inside texts count as the library has it by default.
Repeated rows are counted each, null ids and ids of any type are kept; there are no ties to break.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import steps, texts

#: Entries of the broadcast table, documents and characters of the sample that it is made from.
FREQUENT, SAMPLE_DOCS, SAMPLE_CHARS = 50_000, 2_000, 12_000_000
#: Pre-tokens that a worker remembers, and the longest that it remembers.
REMEMBERED, LONGEST = 400_000, 64

#: Fixed value: the pattern of the byte-level splitter.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_glued = re.compile(r"\s \s")
_worker: dict[str, tuple] = {}


def _cuts(model: dict) -> bool:
    """Whether texts may be cut at single spaces: the byte-level splitter alone, without a normalizer or added spaces."""
    split = model["pre_tokenizer"] or {}
    return not model["normalizer"] and split.get("type") == "ByteLevel" and not split.get("add_prefix_space", True) and split.get("use_regex", True)


def _quick(path: str):
    """The same merges in the quicker library, or None if texts can't be cut or ids don't follow the order of merges.

    The vocabulary writes a byte as a printable character: itself where printable, else 256 and up in order.
    """
    model = json.load(open(path, encoding="utf-8"))
    vocab, merges = model["model"]["vocab"], model["model"]["merges"]
    if not _cuts(model) or model["model"].get("ignore_merges"):
        return None
    joined = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
    if joined != sorted(joined):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {x["content"] for x in model["added_tokens"]}
    import tiktoken

    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("quick", pat_str=SPLITTER, mergeable_ranks=ranks, special_tokens={})._core_bpe


class _Whole:
    """A library's encoder by the lengths it gives; `added`: an expression for its added tokens, or None; `cuts`: whether runs may be encoded alone."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda parts: [len(x) for x in pieces.encode(parts)]
            self.quick, self.added, self.cuts = None, None, False
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_file(path)
        encoder.no_truncation()
        encoder.no_padding()
        self.lengths = lambda parts: [len(x) for x in encoder.encode_batch(parts, add_special_tokens=False)]
        model = json.load(open(path, encoding="utf-8"))
        names = [x["content"] for x in model["added_tokens"] if x["content"]]
        self.added = re.compile("|".join(map(re.escape, names))) if names else None
        self.cuts, self.quick = _cuts(model), _quick(path)


def _encoder(path: str) -> tuple[_Whole, dict[str, int]]:
    """The library's encoder, and the lengths that this worker remembers."""
    if path not in _worker:
        _worker[path] = (_Whole(path), {})
    return _worker[path]


def run_lengths(path: str, runs: list[str]) -> list[int]:
    """Tokens of runs that each follow a space and hold no added token."""
    encoder, _ = _encoder(path)
    if not encoder.quick:
        return encoder.lengths([f" {p}" for p in runs]) if runs else []
    return [len(encoder.quick.encode_ordinary(f" {p}")) for p in runs]


def counted(rows: list[str], path: str, frequent: dict[str, int]) -> list[int]:
    """Tokens of each text."""
    encoder, known = _encoder(path)
    out = []
    for text in rows:
        if not known or len(known) > REMEMBERED:
            known.clear()
            known.update(frequent)
        if not text:
            out.append(0)
        elif not encoder.cuts or _glued.search(text) or (encoder.added and encoder.added.search(text)):
            out += encoder.lengths([text])
        else:
            head, *runs = text.split(" ")
            got = list(map(known.get, runs))
            if None in got:
                missing = list(dict.fromkeys(p for p, n in zip(runs, got, strict=True) if n is None))
                found = dict(zip(missing, run_lengths(path, missing), strict=True))
                got = [found[p] if n is None else n for p, n in zip(runs, got, strict=True)]
                known.update((p, n) for p, n in found.items() if len(p) <= LONGEST)
            out.append(sum(got) + (encoder.lengths([head])[0] if head else 0))
    return out


def frequent_lengths(docs: DataFrame, path: str) -> dict[str, int]:
    """The first tier; none for tokenizers that take texts whole."""
    encoder, _ = _encoder(path)
    if not encoder.cuts:
        return {}
    rows = docs.count()
    seen: Counter[str] = Counter()
    chars = 0
    sample = texts(docs).select("text").where(F.length("text") <= 200_000).sample(min(1.0, SAMPLE_DOCS / max(1, rows)), 17).limit(2 * SAMPLE_DOCS)
    for row in sample.toLocalIterator():
        seen.update(p for p in row["text"].split(" ")[1:] if len(p) <= LONGEST)
        chars += len(row["text"])
        if chars > SAMPLE_CHARS:
            break
    common = [p for p, n in seen.most_common(FREQUENT) if n > 1 and not (encoder.added and encoder.added.search(p))]
    return dict(zip(common, run_lengths(path, common), strict=True))


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            n = counted(b.column("text").to_pylist(), path, table.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = texts(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
