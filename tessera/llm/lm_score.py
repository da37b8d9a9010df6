"""Language-model scoring with a log-frequency Bloom filter.

The filter holds the quantised counts of the corpus' tokens and of all its token
pairs: an n-gram whose count lies in the q-th step of a geometric scale is
inserted q times, each time with its level.  As all levels up to an n-gram's own
are present, a count is read back by probing levels 1, 2, 4, … until one is
absent and halving the gap.  The smoothed probability of a token w after v is

    (c(v w) + prior * P(w)) / (c(v) + prior),   P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))

which sums to one over the vocabulary and the unknown token up to quantisation.
A text's end is a token and serves as the context of its first word.

The corpus is counted in parts by ranges of the hash.  Workers go through all
texts in portions of about `PORTION` bytes and send each part the portion's
different keys in it, with their counts in training texts (0: the key is only
asked for).  One pass over a part sums the counts, sets the part's bits
(`bits_per_key` for each insertion, so the filter grows with the corpus), probes
them for every key and answers each portion with the levels of its keys, in their
order, and the exact counts of its tokens.  The texts then meet the answers of
their portion.  So the n-grams are shuffled once, each once a portion; the filter
is never gathered in one place, and no frequent n-gram makes a part large.

The `heavy` most frequent tokens at most, and as many pairs of these, are
broadcast with their exact counts.  The unigram base is exact.

Tokens and pairs are known by 63 bits of hash.

Null and empty texts consist of the end token alone.  A null identifier is in
the training part.  Repeated rows give repeated results.  An empty training part
has N = V = 0 and every token is unknown.  Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import numbered, parts_for, record, remainder, saved
from .textbatch import U64, Tokens, buffers, mix, signed, slices, tokenize

PROBES = 6
END = U64(0x5E5E5E5E5E5E5E5D)  # odd, as all tokens
#: Bytes of text in a portion.
PORTION = 8 << 20
#: Parts at most.
WIDE = 1 << 13
#: Kinds of n-grams and the base of each one's scale of counts.
TOKEN, PAIR = 0, 1
BASES = {TOKEN: 1.25, PAIR: 1.5}
#: Kinds of rows of a counted corpus: tokens and frequent pairs with their counts, and the parts' answers to portions.
TOKENS, PAIRS, ANSWERS = 0, 1, 2
#: The least count of a pair that may be broadcast.
FREQUENT = 64

COUNTED = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("portion", pa.int64()), ("levels", pa.binary()), ("counts", pa.binary())])
ASKED = pa.schema([("part", pa.int32()), ("portion", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
TEXTS = "portion long, doc_id {}, held_out boolean, text string"


@dataclass(frozen=True)
class Settings:
    prior: float = 16.0
    bits_per_key: int = 10
    broadcast_bytes: int = 128 << 20  # no longer looked at: the filter is not broadcast at any size
    heavy: int = 1 << 19
    part_bytes: int = 1 << 20


def sequence(tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens (odd numbers) with each text's end, the token before each, and the first position of each text."""
    h, off = tokens.hashes, tokens.offsets
    h = h | U64(1)
    return np.insert(h, off[1:], END), np.insert(h, off[:-1], END), off + np.arange(len(off))


def pair_key(ctx: np.ndarray, cur: np.ndarray) -> np.ndarray:
    """An even number that stands for two tokens in order."""
    return mix(ctx * U64(0xC2B2AE3D27D4EB4F) + cur) & ~U64(1)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key; it grows with the key."""
    return ((keys >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)


def planes(numbers: np.ndarray) -> bytes:
    """Numbers of 64 bits by their first bytes, then their second bytes and so on, which compresses well where they are small."""
    return numbers.astype(U64).view(np.uint8).reshape(-1, 8).T.tobytes()


def unplaned(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(U64).ravel()


def portions(batches, number):
    """The slices of a task's rows as (portion, rows, bytes, bounds); a portion ends with the slice that fills it."""
    held = 0
    for batch in batches:
        for part, data, bounds in slices(batch):
            yield number, part, data, bounds
            held += len(data) + part.num_rows
            if held >= PORTION:
                number, held = number + 1, 0


def asked(parts: int):
    """For mapInArrow: a portion's different keys in each part, in order, and how often training texts hold them."""

    def flush(portion, cur, ctx, train):
        cur, ctx, train = (np.concatenate(x) for x in (cur, ctx, train))
        keys, back = grouped(np.concatenate([cur, pair_key(ctx, cur)]))
        n = np.bincount(back[np.concatenate([train, train])], minlength=len(keys))
        part = part_of(keys, parts)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        ends = np.append(first[1:], len(keys))
        for i in range(0, len(first), 256):
            some = [slice(x, y) for x, y in zip(first[i : i + 256], ends[i : i + 256])]
            yield record(ASKED, part[first[i : i + 256]], np.full(len(some), portion), [planes(np.diff(keys[x], prepend=U64(0))) for x in some], [planes(n[x]) for x in some])

    def run(batches, number):
        now, held = None, ([], [], [])
        for portion, part, data, bounds in portions(batches, number):
            if portion != now and held[0]:
                yield from flush(now, *held)
                held = ([], [], [])
            now = portion
            cur, ctx, off = sequence(tokenize(data, bounds))
            train = ~part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            for x, y in zip(held, (cur, ctx, np.repeat(train, np.diff(off)))):
                x.append(y)
        if held[0]:
            yield from flush(now, *held)

    return run


def placed(batches, number):
    """For mapInArrow: rows with their portion."""
    for portion, part, _, _ in portions(batches, number):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, portion)), *part.columns], names=["portion", *part.schema.names])


def levels(kind: int, count: np.ndarray) -> np.ndarray:
    """The step of the kind's scale in which a count lies, from 1."""
    return (np.floor(np.log(count) / math.log(BASES[kind]) + 1e-9) + 1).astype(np.int32)


def typical(kind: int) -> np.ndarray:
    """The count that stands for each level; 0 for level 0."""
    steps = BASES[kind] ** np.arange(0, 250)
    low, high = np.ceil(steps[:-1] - 1e-9), np.maximum(np.ceil(steps[1:] - 1e-9) - 1, np.ceil(steps[:-1] - 1e-9))
    return np.concatenate([[0.0], np.sqrt(low * high)])


def _hashed(keys: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys + np.asarray(level, U64) * U64(0x9E3779B97F4A7C15))
    return h & U64(0xFFFFFFFF), (h >> U64(32)) | U64(1)


def _bit(low: np.ndarray, high: np.ndarray, probe: int, size: np.ndarray | int) -> np.ndarray:
    """The bit, inside its part, that a probe of an entry's level looks at."""
    return (((low + U64(probe) * high) & U64(0xFFFFFFFF)) * np.asarray(size, U64) >> U64(32)).astype(np.int64)


def insert(bits: np.ndarray, keys: np.ndarray, level: np.ndarray) -> None:
    """Sets an entry's bits for its levels 1 to `level` in one part, a boolean for each bit."""
    for j in range(1, int(level.max(initial=0)) + 1):
        keys = keys[level >= j]
        level = level[level >= j]
        low, high = _hashed(keys, j)
        for p in range(PROBES):
            bits[_bit(low, high, p, len(bits))] = True


class Filter:
    """The bits of the parts in `found` (part, bits), one after another, and an empty byte for parts that have none."""

    def __init__(self, found: pa.Table, parts: int):
        self.parts = parts
        bits = found.column("bits").combine_chunks().cast(pa.large_binary())
        _, offsets, data = bits.buffers()
        offsets = np.frombuffer(offsets, np.int64)[bits.offset : bits.offset + len(bits) + 1] if len(bits) else np.zeros(1, np.int64)
        own = np.frombuffer(data, np.uint8)[: offsets[-1]] if len(bits) else np.zeros(0, np.uint8)
        self.words = np.append(own, np.uint8(0))
        self.sizes, self.starts = np.full(parts, 8, U64), np.full(parts, offsets[-1], np.int64)
        at = found.column("part").to_numpy()
        self.sizes[at], self.starts[at] = (8 * np.diff(offsets)).astype(U64), offsets[:-1]

    def has(self, keys: np.ndarray, level: np.ndarray | int, size: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which keys have the level, as indexes."""
        at = np.arange(len(keys))
        low, high = _hashed(keys, level)
        for p in range(PROBES):
            bit = _bit(low, high, p, size)
            hit = (self.words[start + (bit >> 3)] >> (bit & 7).astype(np.uint8)) & 1 > 0
            at, low, high, size, start = at[hit], low[hit], high[hit], size[hit], start[hit]
        return at

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key: levels 1, 2, 4, … are probed until one is absent, then the levels between."""
        part = part_of(keys, self.parts)
        size, start = self.sizes[part], self.starts[part]
        low = np.zeros(len(keys), np.int64)  # present
        high = np.ones(len(keys), np.int64)  # absent, once found
        at, step = np.arange(len(keys)), 1
        while len(at):
            hit = self.has(keys[at], step, size[at], start[at])
            high[at] = step
            at = at[hit]
            low[at] = step
            step *= 2
        while len(at := np.flatnonzero(high - low > 1)):
            mid = (low[at] + high[at]) // 2
            hit = np.zeros(len(at), bool)
            hit[self.has(keys[at], mid, size[at], start[at])] = True
            low[at[hit]], high[at[~hit]] = mid[hit], mid[~hit]
        return low


def count_parts(docs: DataFrame, parts: int, settings: Settings) -> DataFrame:
    """(kind, part, key, n, portion, levels, counts) of the corpus, written: exact counts of tokens, those of frequent pairs, and the answers to portions."""

    def gathered(batches):
        held: dict[int, list[tuple[int, bytes, bytes]]] = {}
        for batch in batches:
            for part, *row in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(part, []).append(row)
        for part in sorted(held):
            some = held.pop(part)
            portion = [p for p, _, _ in some]
            own = [np.cumsum(unplaned(k), dtype=U64) for _, k, _ in some]
            uniq, back = grouped(np.concatenate(own))
            n = np.bincount(back, np.concatenate([unplaned(c) for _, _, c in some]), len(uniq)).astype(np.int64)
            ends = np.cumsum([len(k) for k in own])
            del some, own
            there = n > 0
            keys, times = uniq[there], n[there]
            odd = keys & U64(1) > 0
            level = np.where(odd, levels(TOKEN, times), levels(PAIR, times))
            bits = np.zeros(max(8, -(-int(level.sum()) * settings.bits_per_key // 8) * 8), bool)
            insert(bits, keys, level)
            for kind, pick in ((TOKENS, odd), (PAIRS, ~odd & (times >= FREQUENT))):
                for i in range(0, int(pick.sum()), 100_000):
                    k, c = keys[pick][i : i + 100_000], times[pick][i : i + 100_000]
                    none = pa.nulls(len(k), pa.binary())
                    yield record(COUNTED, np.full(len(k), kind, np.int32), np.full(len(k), part, np.int32), signed(k), c, pa.nulls(len(k), pa.int64()), none, none)
            found = Filter(pa.table({"part": pa.array([0], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())}), 1).probe(uniq).astype(np.uint8)
            token = uniq & U64(1) > 0
            spans = [back[x:y] for x, y in zip(np.append(0, ends), ends)]
            for i in range(0, len(spans), 256):
                here, none = spans[i : i + 256], pa.nulls(len(spans[i : i + 256]), pa.int64())
                yield record(COUNTED, np.full(len(here), ANSWERS, np.int32), np.full(len(here), part, np.int32), none, none, portion[i : i + 256], [found[x].tobytes() for x in here], [planes(n[x[token[x]]]) for x in here])

    raw = docs.mapInArrow(numbered(asked(parts)), "part int, portion long, keys binary, counts binary")
    dealt = raw.repartition(max(1, parts // 4), "part")
    return saved(dealt.mapInArrow(gathered, "kind int, part int, key long, n long, portion long, levels binary, counts binary"), "ngrams")


def most_frequent(counts: DataFrame, settings: Settings, least: int | None = None) -> tuple[np.ndarray, np.ndarray, int | None]:
    """(keys in order, counts, step) of whole steps of a scale from the top, as long as they have `heavy` rows at most and reach `least`."""
    step = F.floor(F.log2("n") * 8).cast("int")
    kept, last = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("v")).collect(), reverse=True):  # some hundred rows
        if (kept := kept + r.v) > settings.heavy or (least is not None and r.step < least):
            break
        last = r.step
    if last is None:
        return np.zeros(0, U64), np.zeros(0), None
    found = counts.where(step >= last).select("key", "n").toArrow()
    keys = found.column("key").to_numpy().view(U64)
    order = np.argsort(keys)
    return keys[order], found.column("n").to_numpy()[order].astype(np.float64), last


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value of each wanted key (0 where there is none), and whether there is one."""
    if not len(keys):
        return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return np.where(hit, values[at], 0.0), hit


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and for each key its place among them."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ranked[new], inverse


class Model:
    """A model fitted to the texts (doc_id, held_out, text) that are not held out: exact token counts, N, V, and what the filter says of each portion."""

    def __init__(self, docs: DataFrame, settings: Settings):
        if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():  # a shuffle may give other portions when it runs again
            docs = saved(docs, "texts")
        self.docs, self.settings = docs, settings
        counted = count_parts(docs, min(parts_for(docs, settings.part_bytes), WIDE), settings)
        self.tokens = counted.where(F.col("kind") == TOKENS).select("key", "n")
        total = self.tokens.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
        self.v, self.n = total.v, total.n
        *heavy, step = most_frequent(self.tokens, settings)
        # a pair's tokens are at least as frequent as the pair, so those of a heavy pair are heavy
        pairs = most_frequent(counted.where(F.col("kind") == PAIRS), settings, step)[:2] if step is not None else (np.zeros(0, U64), np.zeros(0))
        self.heavy = (*heavy, *pairs)
        self.answers = counted.where(F.col("kind") == ANSWERS).select("portion", "part", "levels", "counts")

    @property
    def floor(self) -> float:
        return self.n + 0.5 * (self.v + 1)

    def scores(self) -> DataFrame:
        """The documents (doc_id, held_out) with n_tokens, n_known, train_tokens, base_score, score."""
        shared = self.docs.sparkSession.sparkContext.broadcast(self.heavy)
        n, floor, prior = self.n, self.floor, self.settings.prior
        token_levels, pair_levels = typical(TOKEN), typical(PAIR)
        ident = self.docs.schema["doc_id"].dataType
        rows = pa.schema([("doc_id", to_arrow_type(ident)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

        def scored(answers: pa.Table, texts: pa.Table) -> pa.Table:
            tokens, times, pairs, pair_times = shared.value
            order = np.argsort(answers.column("part").to_numpy())
            lists = [answers.column(c).to_pylist() for c in ("levels", "counts")]
            level = np.frombuffer(b"".join(lists[0][i] for i in order), np.uint8)
            exact = np.concatenate([unplaned(lists[1][i]) for i in order] or [np.zeros(0, U64)]).astype(np.float64)
            data, bounds = buffers(texts.column("text"))
            cur, ctx, off = sequence(tokenize(data, bounds))
            size, places = texts.num_rows, len(cur)
            owner = np.repeat(np.arange(size), np.diff(off))
            keys, back = grouped(np.concatenate([cur, pair_key(ctx, cur)]))
            odd = keys & U64(1) > 0
            if len(keys) != len(level) or int(odd.sum()) != len(exact):
                raise ValueError("the texts came in other portions than those that were counted")
            count = np.zeros(len(keys))
            count[odd] = exact
            logs = np.log10((count + 0.5) / floor)
            base = np.bincount(owner, logs[back[:places]], size)
            known = np.bincount(owner[count[back[:places]] > 0], minlength=size)
            seen = np.where(odd, token_levels[level], pair_levels[level])
            for kind, *heavy in ((odd, tokens, times), (~odd, pairs, pair_times)):
                value, hit = look_up(*heavy, keys[kind])
                seen[kind] = np.where(hit, value, seen[kind])
            # the token before: that of the place before, or the end
            c_cur, c_ctx = seen[back[:places]], np.empty(places)
            c_ctx[1:] = c_cur[:-1]
            c_ctx[off[:-1]] = seen[np.searchsorted(keys, END)]
            score = np.bincount(owner, log_prob(prior, seen[back[places:]], c_ctx, c_cur, floor), size)
            out = [texts.column("doc_id").combine_chunks(), texts.column("held_out").combine_chunks(), pa.array(np.diff(off)), pa.array(known), pa.array(np.full(size, n, np.int64)), pa.array(base), pa.array(score)]
            return pa.Table.from_arrays(out, schema=rows)

        texts = self.docs.mapInArrow(numbered(placed), TEXTS.format(ident.simpleString()))
        ddl = f"doc_id {ident.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        return self.answers.groupBy("portion").cogroup(texts.groupBy("portion")).applyInArrow(scored, ddl)


def log_prob(prior: float, c_pair: np.ndarray, c_ctx: np.ndarray, c_cur: np.ndarray, floor: float) -> np.ndarray:
    return np.log10((np.minimum(c_pair, c_ctx) + prior * ((c_cur + 0.5) / floor)) / (c_ctx + prior))


def lm_score(docs: DataFrame, settings: Settings = Settings(), ident: str = "doc_id", text: str = "text", part: int = 1) -> DataFrame:
    """Scores all documents with a model of those whose remainder is not `part`.

    Returns a row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    own = docs.select(F.col(ident).alias("doc_id"), F.coalesce(remainder(F.col(ident)) == part, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    return Model(own, settings).scores()


def op1_lm_score(spark, sf_dir):
    from .common import documents

    return lm_score(documents(spark, sf_dir))


__all__ = ["Filter", "Model", "Settings", "lm_score", "op1_lm_score"]
