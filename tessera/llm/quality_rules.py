"""Quality rules whose cutoffs follow the data.

Fixed cutoffs reject whole languages or sources that merely differ.  Here each
(language, source) gets a mergeable quantile sketch of every feature: counts of
geometric buckets, whose borders differ by the factor `growth`, so a quantile is
known up to that factor, and merging is adding.  Equal rows give equal sketches in
any order and on any number of machines.  The sketches are merged to languages
and to the whole corpus for groups too small to speak for themselves.  A
feature's upper cutoff is its group's median plus `spread` times the distance
from the median to the upper quartile, and at least `margin` above the median, so
that features which hardly vary don't reject ordinary documents.  The cutoffs are
joined to the documents by language and source.  A document is kept if it passes
the fixed base and no feature is beyond its cutoff.

Null texts count as empty and fail the base, as every text under 50 words does;
null languages and sources form groups of their own.  Repeated rows are judged
alike.  An empty table gives an empty result.  Columns other than the ones named
are ignored or, where asked for, passed on.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, saved
from .textbatch import NEWLINE, SPACE, combine, slices, tokenize

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Least distance of a cutoff from the median, for each feature.
MARGINS = {"mean_word": 4.0, "symbol_share": 0.04, "upper_share": 0.25, "mark_share": 0.1, "dup_line_share": 0.5, "repeat_share": 0.5}


@dataclass(frozen=True)
class Settings:
    min_words: int = 50
    max_repeat_percent: int = 50
    spread: float = 6.0
    margins: dict = field(default_factory=lambda: dict(MARGINS))
    min_group: int = 100
    growth: float = 1.02
    least: float = 1e-5
    broadcast_groups: int = 100_000
    salts: int = 32


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SYMBOLS = _table(b"#*$%&|<>")
MARKS = _table(b"!?;:=~^_\\/@+{}[]\"")
UPPER = _table(bytes(range(0x41, 0x5B)))


def _inside(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How often the mask is true within each text."""
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[bounds])


def _repeats(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item, whether its text holds an equal one, and whether an earlier one is equal."""
    order = np.lexsort((hashes, owner))
    same = (hashes[order[1:]] == hashes[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    again, any_ = np.zeros(len(order), bool), np.zeros(len(order), bool)
    again[order[1:]] = same
    any_[order[1:]] |= same
    any_[order[:-1]] |= same
    return any_, again


def measure(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Counts and shares of each text data[bounds[i]:bounds[i + 1]]."""
    n = len(bounds) - 1
    words = tokenize(data, bounds, SPACE, lower=False)
    lines = tokenize(data, bounds, NEWLINE, lower=False)
    inked = ~SPACE[data]
    ink = np.concatenate([[0], np.cumsum(inked)])
    full = np.flatnonzero(ink[lines.ends] > ink[lines.starts])
    line_owner = lines.owners()[full]
    line_again = _repeats(line_owner, lines.hashes[full])[1]
    owner = words.owners()
    cover = np.zeros(len(owner) + 1, np.int64)
    if len(owner) >= 3:
        at = np.flatnonzero(np.arange(len(owner)) + 3 <= np.repeat(words.offsets[1:], words.counts))
        twice = at[_repeats(owner[at], combine(words.hashes, 3)[at])[0]]
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + 3, -1)
    out = {
        "n_words": words.counts,
        "word_chars": _inside(inked & ((data & 0xC0) != 0x80), bounds),
        "n_symbols": _inside(SYMBOLS[data], bounds),
        "n_dup_lines": np.bincount(line_owner[line_again], minlength=n),
        "n_repeat_words": np.bincount(owner[np.cumsum(cover[:-1]) > 0], minlength=n),
    }
    out = {k: v.astype(np.int64) for k, v in out.items()}
    some = np.maximum(out["word_chars"], 1)
    out |= {
        "mean_word": out["word_chars"] / np.maximum(out["n_words"], 1),
        "symbol_share": out["n_symbols"] / some,
        "upper_share": _inside(UPPER[data], bounds) / some,
        "mark_share": _inside(MARKS[data], bounds) / some,
        "dup_line_share": out["n_dup_lines"] / np.maximum(np.bincount(line_owner, minlength=n), 1),
        "repeat_share": out["n_repeat_words"] / np.maximum(out["n_words"], 1),
    }
    return out


def features(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """The columns in `carry` and, as struct `f`, what measure() gives."""
    shares = list(MARGINS)
    kind = pa.struct([pa.field(c, pa.int64()) for c in COUNTS] + [pa.field(c, pa.float64()) for c in shares])

    def run(batches):
        for batch in batches:
            for part, data, bounds in slices(batch, "__text"):
                got = measure(data, bounds)
                cols = [pa.array(got[f.name], f.type) for f in kind]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.StructArray.from_arrays(cols, fields=list(kind))], names=[*carry, "__f"])

    own = docs.select(*(F.col(c) for c in carry), F.col(text).alias("__text"))
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema[:-1]), "__f struct<" + ", ".join([*(f"{c}: bigint" for c in COUNTS), *(f"{c}: double" for c in shares)]) + ">"])
    return own.mapInArrow(run, ddl)


def bucket(value: Column, settings: Settings) -> Column:
    """The geometric bucket of a value; 0 for all up to `least`."""
    return F.when(value <= settings.least, 0).otherwise(F.ceil(F.log(value / settings.least) / F.log(F.lit(settings.growth)))).cast("int")


def middle(place: Column, settings: Settings) -> Column:
    """The value that stands for a bucket, within half of the growth of all in it."""
    return F.when(place == 0, 0.0).otherwise(F.lit(2 * settings.least / (settings.growth + 1)) * F.pow(F.lit(settings.growth), place))


def sketches(measured: DataFrame, settings: Settings, lang: str, source: str) -> DataFrame:
    """(__lang, __source, feature, bucket, n): the documents with words, counted by bucket; a few thousand rows a group at most."""
    pairs = F.array(*(F.struct(F.lit(i).alias("feature"), bucket(F.col(f"__f.{c}"), settings).alias("bucket")) for i, c in enumerate(settings.margins)))
    own = measured.where(F.col("__f.n_words") > 0).select(F.col(lang).alias("__lang"), F.col(source).alias("__source"), F.explode(pairs).alias("__p"))
    return own.groupBy("__lang", "__source", "__p.feature", "__p.bucket").agg(F.count("*").alias("n"))


def _cuts(counts: DataFrame, by: list[str], settings: Settings) -> DataFrame:
    """(by, n, cuts): for each group of sketches its documents and its cutoffs by feature."""
    merged = counts.groupBy(*by, "feature", "bucket").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*by, "feature")
    ranked = merged.withColumns({"upto": F.sum("n").over(whole.orderBy("bucket")), "total": F.sum("n").over(whole)})
    quantile = lambda q: middle(F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bucket"))), settings)
    per = ranked.groupBy(*by, "feature").agg(F.max("total").alias("n"), quantile(0.5).alias("mid"), quantile(0.75).alias("high"))
    margin = F.element_at(F.array(*(F.lit(float(m)) for m in settings.margins.values())), F.col("feature") + 1)
    cut = F.col("mid") + F.greatest(settings.spread * (F.col("high") - F.col("mid")), margin)
    features_ = [F.max(F.when(F.col("feature") == i, cut)).alias(c) for i, c in enumerate(settings.margins)]
    return per.groupBy(*by).agg(F.max("n").alias("n"), *features_).select(*by, "n", F.struct(*settings.margins).alias("cuts"))


def thresholds(measured: DataFrame, settings: Settings = Settings(), lang: str = "lang", source: str = "source") -> DataFrame:
    """(__lang, __source, __cut) from sketches of each group, merged upwards where a group has too few documents; written."""
    counts = saved(sketches(measured, settings, lang, source), "sketches")
    group = _cuts(counts, ["__lang", "__source"], settings)
    langs = _cuts(counts, ["__lang"], settings).toDF("__l", "lang_n", "lang_cuts")
    whole = _cuts(counts.withColumn("__all", F.lit(True)), ["__all"], settings).select("__all", F.col("cuts").alias("all_cuts"))  # one row
    wide = group.withColumn("__all", F.lit(True)).join(langs, F.col("__lang").eqNullSafe(F.col("__l"))).join(F.broadcast(whole), "__all")
    cut = F.when(F.col("n") >= settings.min_group, F.col("cuts")).when(F.col("lang_n") >= settings.min_group, F.col("lang_cuts")).otherwise(F.col("all_cuts"))
    return saved(wide.select("__lang", "__source", cut.alias("__cut")), "cutoffs")


def judge(measured: DataFrame, cutoffs: DataFrame, settings: Settings = Settings(), lang: str = "lang", source: str = "source") -> DataFrame:
    """`measured` with __base_failed and __kept.  Up to `broadcast_groups` cutoffs are broadcast; more are joined by salted shuffle."""
    f = F.col("__f")
    base = (f["n_words"] < settings.min_words) | (100 * f["n_repeat_words"] > settings.max_repeat_percent * f["n_words"])
    beyond = F.lit(False)
    for c in settings.margins:
        beyond = beyond | F.coalesce(f[c] > F.col("__cut")[c], F.lit(False))
    same = F.col(lang).eqNullSafe(F.col("__lang")) & F.col(source).eqNullSafe(F.col("__source"))
    if cutoffs.count() <= settings.broadcast_groups:
        joined = measured.join(F.broadcast(cutoffs), same, "left")
    else:
        salted = cutoffs.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(settings.salts - 1))))
        own = measured.withColumn("__own", F.pmod(F.xxhash64("__f"), F.lit(settings.salts)).cast("int"))
        joined = own.join(salted, same & (F.col("__own") == F.col("__salt")), "left").drop("__own", "__salt")
    return joined.withColumns({"__base_failed": base, "__kept": ~base & ~beyond}).drop("__lang", "__source", "__cut")


def quality_rules(docs: DataFrame, carry: list[str], settings: Settings = Settings(), lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """The columns in `carry` (language and source among them), the features as __f, __base_failed and __kept."""
    measured = saved(features(docs, carry, text), "features")
    return judge(measured, thresholds(measured, settings, lang, source), settings, lang, source)


def op10_quality_rules(spark, sf_dir):
    out = quality_rules(documents(spark, sf_dir), ["doc_id", "lang", "source"])
    return out.select("doc_id", *(F.col(f"__f.{c}").alias(c) for c in COUNTS), F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


__all__ = ["Settings", "features", "judge", "op10_quality_rules", "quality_rules", "sketches", "thresholds"]
