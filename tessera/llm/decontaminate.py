"""Benchmark decontamination by template canonicalisation.

Texts are cut at ASCII white space and punctuation is stripped from the ends of
each token.  A token with a digit becomes a number placeholder, a unit of
measurement a unit placeholder, a capitalised token a name placeholder; all
others stay as lower-cased literals.  Windows of `window` canonical tokens with
at least `literals` different literals are joined by hash between documents and
benchmark items.  Matches of one item on one diagonal (document position minus
item position) or on diagonals at most `shift` apart, as words put in or left out
make them, are an aligned copy.  The copy counts if it covers `cover` of the
item's tokens and its slots are consistent: equal values of the item stand for
equal values in the document, different ones for different ones.  So a question
with other numbers or names is found, a text that merely has the same shape is
not.

Beside these named windows there are folded ones, for which case tells nothing:
capitalised tokens are literals like others, and a window without enough literals
is hashed by its values.  So a text in capitals or title case, an item written so,
and one of few literals are found too.  What is copied word for word, without
case, counts without a look at other slots.

Benchmark windows up to `broadcast_windows` are broadcast, as hashes only, and thin
the documents' windows in the scan; a larger benchmark is joined by shuffle
alone, with the same result.  Items with fewer tokens than a window are one
window; of these, items of fewer than `literals` different tokens can't be told
from others and match nothing.  Null and empty texts match nothing; null item ids are an item like
others.  An empty benchmark marks nothing.  Repeated rows are judged alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, numbered, saved, without
from .near_dedup import node_of
from .textbatch import PUNCT, SPACE, U64, combine, hash_spans, signed, slices, tokenize

#: Units of measurement, without case.
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles metre metres meter meters kilometre kilometres kilometer kilometers "
    "mg g kg t gram grams kilogram kilograms ton tons tonne tonnes oz ounce ounces lb lbs pound pounds "
    "ml cl dl l liter liters litre litres gallon gallons pint pints "
    "ms s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "km/h mph kph hz khz mhz ghz w kw mw v a ohm j kj cal kcal n pa bar psi k c f degree degrees "
    "b kb mb gb tb usd eur gbp dollar dollars euro euros cent cents percent pct"
).split()
NUMBER, UNIT, NAME = 1, 2, 3
#: Added to the hashes of folded windows and of windows of values.
FOLDED, VALUES = U64(0x2545F4914F6CDD1D), U64(0x5851F42D4C957F2D)
#: Matches that a worker turns into Python objects together, about; a group is taken whole.
MATCHES = 1 << 10


@dataclass(frozen=True)
class Settings:
    window: int = 6
    literals: int = 3
    cover: float = 0.5
    shift: int = 12
    broadcast_windows: int = 1 << 20
    broadcast_items: int = 1 << 16


def _hash_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return tokenize(data, np.array([0, len(data)])).hashes


_UNITS = np.sort(_hash_words(UNITS))


class Canonical:
    """Canonical tokens of texts: value hashes, kinds (0: literal), and each text's offset."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        tokens = tokenize(data, bounds, SPACE)
        inner = np.flatnonzero(~PUNCT[data])
        low, high = np.searchsorted(inner, tokens.starts), np.searchsorted(inner, tokens.ends)
        full = high > low
        first, last = inner[low[full]] if len(inner) else low[:0], inner[high[full] - 1] + 1 if len(inner) else high[:0]
        self.values = hash_spans(data, first, last, lower=True)
        self.offsets = np.concatenate([[0], np.cumsum(full)])[tokens.offsets]
        digits = np.concatenate([[0], np.cumsum((data >= 0x30) & (data <= 0x39))])
        lead, follow = data[first], data[np.minimum(first + 1, max(len(data) - 1, 0))]
        capital = ((lead >= 0x41) & (lead <= 0x5A)) | ((lead == 0xC3) & (follow >= 0x80) & (follow <= 0x9E)) | ((lead == 0xCE) & (follow >= 0x91) & (follow <= 0xA9)) | ((lead == 0xD0) & (follow >= 0x90) & (follow <= 0xAF))
        self.kinds = np.where(capital, NAME, 0).astype(np.int8)
        at = np.minimum(np.searchsorted(_UNITS, self.values), len(_UNITS) - 1)
        self.kinds[_UNITS[at] == self.values] = UNIT
        self.kinds[digits[last] > digits[first]] = NUMBER

    def windows(self, n: int, literals: int, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text's index, first token, tokens, folded) of the windows; a text of fewer tokens is a window if `short`."""
        named, folded = (self._windows(n, literals, short, f) for f in (False, True))
        out = [np.concatenate(c) for c in zip(named, folded)]
        return (*out, np.repeat([False, True], [len(named[0]), len(folded[0])]))

    def _windows(self, n: int, literals: int, short: bool, folded: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        kinds = np.where(self.kinds == NAME, 0, self.kinds) if folded else self.kinds
        template = np.where(kinds == 0, self.values, kinds.astype(U64))
        count = np.diff(self.offsets)
        owner = np.repeat(np.arange(len(count)), count)
        h, at = np.zeros(0, U64), np.zeros(0, np.int64)
        if len(owner) >= n:
            at = np.flatnonzero(np.arange(len(owner)) + n <= np.repeat(self.offsets[1:], count))
            enough = self._literals(n, kinds, template) >= literals
            h = combine(template, n)
            if folded:
                h = np.where(enough, h + FOLDED, combine(self.values, n) + VALUES)
            else:
                at = at[enough[at]]
            h = h[at]
        size = np.full(len(at), n)
        if short:
            for i in np.flatnonzero((count > 0) & (count < n)):
                a, b = self.offsets[i], self.offsets[i + 1]
                enough = len(np.unique(template[a:b][kinds[a:b] == 0])) >= literals
                if not enough and not (folded and len(np.unique(self.values[a:b])) >= literals):
                    continue
                own = combine((template if enough else self.values)[a:b], b - a)
                if folded:
                    own = own + (FOLDED if enough else VALUES)
                h, at, size = np.append(h, own), np.append(at, a), np.append(size, b - a)
        return h, owner[at], at, size

    def _literals(self, n: int, kinds: np.ndarray, template: np.ndarray) -> np.ndarray:
        """Different literals in each run of n tokens."""
        total = np.zeros(len(template) - n + 1, np.int8)
        for k in range(n):
            new = kinds[k : k + len(total)] == 0
            for j in range(k):
                new &= template[k : k + len(total)] != template[j : j + len(total)]
            total += new
        return total


def item_windows(benchmark: DataFrame, settings: Settings, ident: str, text: str) -> DataFrame:
    """(hash, item_row, item_id, at, total, folded, vals, slots): each usable window of the items, with its tokens' values and kinds."""
    kind = dict((f.name, f.dataType.simpleString()) for f in benchmark.schema)[ident]

    def run(batches, number):
        for batch in batches:
            for part, data, bounds in slices(batch):
                c = Canonical(data, bounds)
                h, owner, at, size, folded = c.windows(settings.window, settings.literals, short=True)
                total = np.diff(c.offsets)[owner]
                yield pa.RecordBatch.from_pydict({
                    "hash": pa.array(signed(h)), "item_row": pa.array(number + owner), "item_id": part.column("id").take(pa.array(owner)),
                    "at": pa.array(at - c.offsets[owner], pa.int32()), "total": pa.array(total, pa.int32()), "folded": pa.array(folded),
                    "vals": pa.array([signed(c.values[a : a + n]) for a, n in zip(at, size)], pa.list_(pa.int64())), "slots": pa.array([c.kinds[a : a + n].astype(np.int32) for a, n in zip(at, size)], pa.list_(pa.int32())),
                })
                number += part.num_rows

    own = benchmark.select(F.col(ident).alias("id"), F.col(text).alias("text"))
    return own.mapInArrow(numbered(run), f"hash long, item_row long, item_id {kind}, at int, total int, folded boolean, vals array<long>, slots array<int>")


def document_windows(docs: DataFrame, known: np.ndarray | None, sizes: list[int], settings: Settings) -> DataFrame:
    """A row with null hash for each document, and rows (row, doc_id, hash, at, vals) for its windows that `known` has, or all."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches, number):
        keys = shared.value
        for batch in batches:
            for part, data, bounds in slices(batch):
                c = Canonical(data, bounds)
                n = part.num_rows
                yield rows(part, np.zeros(0, U64), np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), c, number, True)
                for size in sizes:
                    h, owner, at, length, _ = c.windows(size, settings.literals, short=False)
                    if keys is not None:
                        hit = np.zeros(len(h), bool)
                        if len(keys):
                            hit = keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h
                        h, owner, at, length = h[hit], owner[hit], at[hit], length[hit]
                    for i in range(0, len(h), 50_000):
                        s = slice(i, i + 50_000)
                        yield rows(part, h[s], owner[s], at[s], length[s], c, number, False)
                number += n

    def rows(part, h, owner, at, length, c, number, plain):
        m = len(owner)
        return pa.RecordBatch.from_pydict({
            "row": pa.array(number + owner), "doc_id": part.column("doc_id").take(pa.array(owner)), "hash": pa.nulls(m, pa.int64()) if plain else pa.array(signed(h)),
            "at": pa.array(at - c.offsets[owner] if not plain else at, pa.int32()), "vals": pa.nulls(m, pa.list_(pa.int64())) if plain else pa.array([signed(c.values[a : a + n]) for a, n in zip(at, length)], pa.list_(pa.int64())),
        })

    return docs.select("doc_id", "text").mapInArrow(numbered(run), f"row long, doc_id {kind}, hash long, at int, vals array<long>")


def _covered(matches: list[dict]) -> tuple[set[int], bool]:
    """The item's tokens in the matches, and whether the slots are consistent; names are slots in named windows only."""
    seen, there, back, fits = set(), {}, {}, True
    for m in matches:
        for i, (slot, ours, theirs) in enumerate(zip(m["slots"], m["vals"], m["d_vals"])):
            seen.add(m["at"] + i)
            if slot and not (m["folded"] and slot == NAME):
                fits = fits and there.setdefault((slot, ours), theirs) == theirs and back.setdefault((slot, theirs), ours) == ours
    return seen, fits


def _portions(batch: pa.RecordBatch, most: int):
    """The batch's groups in portions of about `most` matches."""
    ends = np.cumsum(pc.list_value_length(batch.column("matches")).fill_null(0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def _aligned(settings: Settings):
    """For mapInArrow: which groups of matches cover enough of their item with consistent slots."""

    def run(batches):
        for batch in (portion for whole in batches for portion in _portions(whole, MATCHES)):
            cover, ok = [], []
            for total, matches in zip(batch.column("total").to_pylist(), batch.column("matches").to_pylist()):
                found = [0]
                own = [[m for m in matches if m["diagonal"] == d] for d in {m["diagonal"] for m in matches}]
                for some in [matches, *own] if len(own) > 1 else own:
                    same = [m for m in some if m["vals"] == m["d_vals"]]
                    found += [len(seen) for seen, fits in map(_covered, ([m for m in some if not m["folded"]], some)) if fits]
                    found.append(len({m["at"] + i for m in same for i in range(len(m["vals"]))}))
                cover.append(max(found) / total)
                ok.append(max(found) >= settings.cover * total)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "item_id")), pa.array(cover, pa.float64()), pa.array(ok, pa.bool_())], names=["row", "item_id", "cover", "ok"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), ident: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row per document: row, doc_id, contaminated, items (their ids, sorted), cover (the largest share of an item)."""
    items = saved(item_windows(benchmark, settings, item, item_text), "items")
    sizes = [r[0] for r in items.select(F.size("vals")).distinct().collect()]  # at most `window` numbers
    n = items.count()
    known = np.unique(items.select("hash").distinct().toArrow().column(0).to_numpy().view(U64)) if n <= settings.broadcast_windows else None
    own = docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"))
    found = saved(document_windows(own, known, sizes, settings), "windows")
    # few items are joined where the documents' windows are, so that no shape that many texts have meets in one task
    theirs = F.broadcast(items) if n <= settings.broadcast_items else items
    hits = found.where("hash is not null").select("row", "hash", F.col("at").alias("d_at"), F.col("vals").alias("d_vals")).join(theirs, "hash").where(F.size("vals") == F.size("d_vals"))
    # diagonals at most `shift` apart share a band of twice that width; each lies in two bands
    hits = hits.withColumn("diagonal", F.col("d_at") - F.col("at")).withColumn("band", F.explode(F.array(*(F.floor(F.col("diagonal") / settings.shift) - k for k in (0, 1)))))
    groups = hits.groupBy("row", "item_row", "band").agg(F.first("item_id").alias("item_id"), F.first("total").alias("total"), F.collect_list(F.struct("at", "diagonal", "folded", "vals", "slots", "d_vals")).alias("matches"))
    kind = items.schema["item_id"].dataType.simpleString()
    judged = groups.select("row", "item_id", "total", "matches").mapInArrow(_aligned(settings), f"row long, item_id {kind}, cover double, ok boolean").where("ok")
    marked = judged.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("cover").alias("cover"))
    out = found.where("hash is null").select("row", "doc_id").join(marked, "row", "left")
    return out.select("row", "doc_id", F.col("cover").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast(f"array<{kind}>")).alias("items"), F.coalesce("cover", F.lit(0.0)).alias("cover"))


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), ident: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark item."""
    keyed = docs.withColumn("__node", node_of(F.col(text)))
    # equal texts get equal verdicts, so the text's hash names the rows that go
    own = keyed.select(F.col("__node").alias("doc_id"), F.col(text).alias("text"))
    marked = saved(decontaminate(own, benchmark, settings, item=item, item_text=item_text).where("contaminated").select(F.col("doc_id").alias("__node")).distinct(), "marked")
    return without(keyed, marked).drop("__node")


def op7_decontaminate(spark, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(documents(spark, sf_dir), benchmark)
    return found.select("doc_id", "contaminated", F.size("items").cast("long").alias("n_items"), "items", "cover")


__all__ = ["Settings", "decontaminate", "clean", "op7_decontaminate"]
