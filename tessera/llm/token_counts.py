"""Token counts of byte-level BPE with a shortcut for whole-token words.

Before any text is read, whole_tokens() proves which vocabulary strings are
encoded alone as one token: each entry is decoded to its bytes and encoded by
the library itself.  Texts are cut by the tokenizer's own pattern; a piece among
the proven strings counts as one token, and only the other pieces, each different
one once in a while, are given to the library for merging.  Pieces are
independent of each other, as merges never cross them.

Strings of special tokens inside a text are tokens to the library, which looks
for them before it cuts; the stretches between them are counted piece by piece.

Null texts count as empty: 0 tokens.  Very long texts are cut and counted as any
other.  Repeated rows are counted alike; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents
from .textbatch import slices

#: Pieces whose counts a worker remembers at most; then it starts afresh.
REMEMBERED = 400_000
#: Longer pieces are never remembered.
LONGEST = 64
#: Characters of texts whose pieces are counted in portions.
LONG_TEXT = 1 << 20
#: Characters of the texts counted together.
TOGETHER = 1 << 20


def _load(file: bytes | str):
    """The library's tokenizer, from a file's bytes or its path."""
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(file) if isinstance(file, str) else Tokenizer.from_buffer(file)
    out.no_padding()
    out.no_truncation()
    return out


def special_strings(file: bytes | str) -> list[str]:
    """Strings that the library takes for one token before it cuts a text."""
    return sorted((t.content for t in _load(file).get_added_tokens_decoder().values()), key=len, reverse=True)


def whole_tokens(file: bytes | str) -> frozenset[str]:
    """The vocabulary's strings that the library encodes alone as exactly one token."""
    tok = _load(file)
    strings = [tok.decode([i], skip_special_tokens=False) for i in range(tok.get_vocab_size())]
    strings = [s for s in strings if s and "�" not in s]
    return frozenset(s for s, e in zip(strings, tok.encode_batch(strings, add_special_tokens=False)) if len(e.ids) == 1)


class Counter:
    """Counts tokens of texts with one tokenizer file."""

    def __init__(self, file: bytes | str, pattern: str, whole: frozenset[str], special: list[str]):
        import regex

        self.whole, self.special = whole, special
        tok = _load(file)
        encode = getattr(tok, "encode_batch_fast", tok.encode_batch)  # without the pieces' places, where the library offers it
        self.merged = lambda pieces: [len(e.ids) for e in encode(pieces, add_special_tokens=False)]
        pattern_ = regex.compile(pattern)
        self.cut, self.cut_long = pattern_.findall, pattern_.finditer
        self.split = regex.compile("|".join(map(regex.escape, special))).split if special else None
        self.known = dict.fromkeys(whole, 1)

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        out = [0] * len(texts)
        pieces: list[list[str]] = [[] for _ in texts]
        for i, text in enumerate(texts):
            parts = [text]
            if self.split and any(s in text for s in self.special):
                parts = self.split(text)
                out[i] = len(parts) - 1
            for part in parts:
                if len(part) <= LONG_TEXT:
                    pieces[i] += self.cut(part)
                else:
                    found = (m.group() for m in self.cut_long(part))
                    while some := list(islice(found, 100_000)):
                        out[i] += self._sums([some])[0]
        return [a + b for a, b in zip(out, self._sums(pieces))]

    def _sums(self, pieces: list[list[str]]) -> list[int]:
        known = self.known
        rest = list(set().union(*pieces).difference(known))
        long = {}
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            for p, n in zip(some, self.merged(some)):
                (known if len(p) <= LONGEST else long)[p] = n
        get = known.get if not long else lambda p: known.get(p) or long.get(p)
        out = [sum(map(get, x)) for x in pieces]
        if len(known) > len(self.whole) + REMEMBERED:
            self.known = dict.fromkeys(self.whole, 1)
        return out


_COUNTERS: dict[tuple[str, str], Counter] = {}


def _counter(name: str, file: bytes, pattern: str, whole: frozenset[str], special: list[str]) -> Counter:
    """The worker's counter: it outlives a task, and so do the pieces that it remembers."""
    if (name, pattern) not in _COUNTERS:
        _COUNTERS[name, pattern] = Counter(file, pattern, whole, special)
    return _COUNTERS[name, pattern]


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 1024, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, n_bytes, n_tokens, over_limit."""
    with open(path, "rb") as f:  # the driver's file: executors get its bytes
        file = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((file, pattern, whole_tokens(file), special_strings(file)))  # no more than the vocabulary
    name = hashlib.sha256(file).hexdigest()

    def run(batches):
        counter = _counter(name, *shared.value)
        for batch in batches:
            for part, _, _ in slices(batch, most=TOGETHER):
                n = np.array(counter.counts([t or "" for t in part.column("text").to_pylist()]), np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    own = docs.select(F.col(ident).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


__all__ = ["Counter", "op8_token_counts", "special_strings", "token_counts", "whole_tokens"]
