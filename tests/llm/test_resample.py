"""Importance resampling against brute force, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tessera.llm import resample

SCHEMA = "doc_id long, text string, word string, at int, bucket long, gain long, chunk int, rank string, __row long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, 2, 3, 4, "r", 5) for i, t in rows], SCHEMA)


def target(spark, texts):
    return spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "item_id long, text string, bucket int")


def prose(seed, n):
    r = random.Random(seed)
    return "".join(r.choice(["Ka", "lo", "mi", "tér", "un9", "sha"]) + r.choice([" ", " ", "", ", ", "\n"]) for _ in range(n))


def brute(rows, texts, s):
    def runs(text):
        words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return [" ".join(words[i : i + k]) for k in range(1, s.order + 1) for i in range(len(words) - k + 1)], len(words)

    bucket = lambda run: zlib.crc32(run.encode()) % s.buckets
    own, other = (Counter(bucket(r) for t in x for r in runs(t)[0]) for x in ([t for _, t in rows], texts))
    all_s, all_t = sum(own.values()), sum(other.values())
    gain = lambda b: math.floor(1000 * math.log((other[b] + 1) * (all_s + s.buckets) / ((own[b] + 1) * (all_t + s.buckets))))
    out = []
    for i, t in rows:
        found, n = runs(t)
        h = int(hashlib.sha256(f"{s.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(r)) for r in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    eligible = sorted((r for r in out if r[5] >= s.least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(eligible[: s.percent * len(eligible) // 100]):
        r[4] = place + 1
    return sorted(map(tuple, out), key=str)


ODD = [(None, None), (None, prose(1, 60)), (None, prose(2, 60)), (3, ""), (4, " ,.\n"), (5, prose(3, 9000)), (6, prose(4, 50)), (6, prose(4, 50)), (7, "x" * 5000), (8, "one two"), (9, "b")]


@pytest.mark.parametrize("settings", [resample.Settings(), resample.Settings(order=2, percent=40), resample.Settings(order=3, buckets=50, chunk=7, percent=70, least=2), resample.Settings(order=4, chunk=2, buckets=7, percent=100, least=1)])
def test_resampling_against_brute_force(spark, settings):
    rows = [(i, prose(i % 50, 30 + i % 40)) for i in range(20, 150)] + ODD
    texts = [prose(i, 25) for i in range(20)] + [None, ""]
    got = resample.resample(docs(spark, rows), target(spark, texts), settings)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    found = sorted(map(tuple, got.collect()), key=str)
    want = brute(rows, texts, settings)
    assert [r[:4] for r in found] == [r[:4] for r in want] and Counter(r[4] for r in found) == Counter(r[4] for r in want)
    unique = lambda x: [r for r in x if r[0] is not None and r[0] != 6]
    assert unique(found) == unique(want)


def test_resampling_of_empty_tables(spark):
    assert resample.resample(docs(spark, []), target(spark, ["a b"])).collect() == []
    rows = [(i, prose(i, 40)) for i in range(30)]
    assert sorted(map(tuple, resample.resample(docs(spark, rows), target(spark, [])).collect()), key=str) == brute(rows, [], resample.Settings())
