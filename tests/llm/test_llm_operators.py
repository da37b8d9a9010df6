"""Each operator against brute force, and on odd tables: nulls, empty and long texts, repeated rows, no rows, clashing columns."""

import math
import os
import random
import re
import tracemalloc
import zlib
from collections import Counter
from dataclasses import replace
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import contract, decontaminate, license_scan, line_dedup, lm_score, mix_sources, near_dedup, quality_rules, shard, textbatch, token_counts, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, node long, size int, bucket long, n long, hash long, source_size string, comp string, slot int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ka", "lo", "mi", "ter", "un", "sha", "é"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def odd(spark, rows=None):
    base = prose(1, 120)
    if rows is None:
        rows = [
            (1, None, "en", "a"), (2, "", None, "a"), (3, "word", "en", None), (None, prose(2, 80), "fr", "b"), (5, prose(3, 30_000), "en", "a"),
            (6, base, "en", "a"), (7, base, "en", "b"), (8, base + " more", "en", "b"), (9, " \n\t ", "en", "a"), (10, prose(4, 70) + "\nAll rights reserved.\nx <|endoftext|> y", "de", "c"),
            (10, prose(4, 70) + "\nAll rights reserved.\nx <|endoftext|> y", "de", "c"), (11, "tie", "en", "a"), (12, "tie", "en", "a"), (13, "x" * 5000, "en", "a"),
        ]
    return spark.createDataFrame([(i, t, a, b, len(t or ""), 1, "k", 2, 3, 4, 5, 6, "s", "c", 7) for i, t, a, b in rows], SCHEMA)


BENCH = [(1, "John bought 12 apples and gave 5 of the apples to his sister Mary, how many apples does John have left now?"), (None, "another question about nothing at all in particular here"), (3, None), (4, "")]


def bench(spark):
    return spark.createDataFrame(BENCH, "item_id long, text string")


def labels(spark, rows=((5, 1), (6, 0), (7, None), (8, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, toxic int")


OPERATORS = {
    "lm_score": lambda s, d: lm_score.lm_score(d),
    "shard": lambda s, d: shard.shard(d, shard.Settings(limit=2000)),
    "toxicity": lambda s, d: toxicity.toxicity(d, toxicity.fit(d.select("doc_id", "text"), labels(s))),
    "line_dedup": lambda s, d: line_dedup.line_dedup(d),
    "mix_sources": lambda s, d: mix_sources.mix_sources(d),
    "license_scan": lambda s, d: license_scan.license_scan(d),
    "decontaminate": lambda s, d: decontaminate.decontaminate(d, bench(s)),
    "token_counts": lambda s, d: _tokens(d),
    "near_dedup": lambda s, d: near_dedup.near_dedup(d),
    "quality_rules": lambda s, d: quality_rules.quality_rules(d, d.columns),
}


def _tokens(d):
    import public_tokenizers as p

    return token_counts.token_counts(d, p.path("byte_bpe_50k.json"), p.PATTERN)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_tables(spark, name):
    assert len(OPERATORS[name](spark, odd(spark)).collect()) == 14
    assert OPERATORS[name](spark, odd(spark, [])).collect() == []


@pytest.mark.parametrize("name", ["near", "clean", "mixed"])
def test_odd_tables_in_filters(spark, name):
    run = {"near": near_dedup.kept, "clean": lambda d: decontaminate.clean(d, bench(spark)), "mixed": mix_sources.mixed}[name]
    found = run(odd(spark))
    assert found.columns == odd(spark).columns
    ids = Counter(r.doc_id for r in found.collect())
    if name == "near":
        assert ids == Counter([1, 2, 3, None, 5, 6, 9, 10, 11, 13])
    if name == "clean":
        assert sum(ids.values()) == 14
    assert run(odd(spark, [])).collect() == []


def test_hashes_do_not_depend_on_batching():
    texts = ["The cat sat", "", "a the\x0bThe é x", "tail " * 3]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.cumsum([0, *(len(t.encode()) for t in texts)])
    whole = textbatch.tokenize(data, bounds)
    assert whole.counts.tolist() == [3, 0, 5, 3]
    small, textbatch.CHUNK = textbatch.CHUNK, 4
    try:
        assert textbatch.tokenize(data, bounds).hashes.tolist() == whole.hashes.tolist()
    finally:
        textbatch.CHUNK = small


def test_lm_base_is_exact_and_both_paths_agree(spark):
    rows = [(i, prose(i % 7, 60) + " Word end", "en", "a") for i in range(40)]
    docs = odd(spark, rows)
    got = {r.doc_id: r for r in lm_score.lm_score(docs).collect()}
    few = {r.doc_id: r for r in lm_score.lm_score(docs, lm_score.Settings(heavy=5)).collect()}
    other = {r.doc_id: r for r in lm_score.lm_score(docs, lm_score.Settings(broadcast_bytes=0, heavy=5)).collect()}
    count = Counter()
    tokens = lambda t: [*WORD.findall(lower(t)), None]
    for i, t, _, _ in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            count.update(tokens(t))
    n, v = sum(count.values()), len(count)
    for i, t, _, _ in rows:
        words = tokens(t)
        assert got[i].train_tokens == n and got[i].n_tokens == len(words) and got[i].n_known == sum(count[w] > 0 for w in words)
        assert got[i].base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words))
        assert other[i].base_score == pytest.approx(got[i].base_score) and other[i].score == pytest.approx(few[i].score)
        assert got[i].score > got[i].base_score


@pytest.mark.parametrize("wide", [4, 1 << 13])
def test_lm_score_against_brute_force(spark, monkeypatch, wide):
    monkeypatch.setattr(lm_score, "WIDE", wide)
    r = random.Random(21)
    words = [prose(i, 1) for i in range(30)]
    rows = [(i, " ".join(r.choice(words[: r.randint(2, 30)]) for _ in range(r.randint(0, 40))), "en", "a") for i in range(120)]
    single, pair = Counter(), Counter()
    tokens = lambda t: [None, *WORD.findall(lower(t)), None]
    for i, t, _, _ in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            single.update(tokens(t)[1:])
            pair.update(zip(tokens(t), tokens(t)[1:]))
    n, v, scales = sum(single.values()), len(single), [lm_score.typical(k) for k in (lm_score.TOKEN, lm_score.PAIR)]
    level = lambda k, c: scales[k][lm_score.levels(k, np.array([c]))[0]] if c else 0.0
    full = lm_score.Settings(bits_per_key=30)  # hardly any false positives
    for settings in (full, replace(full, heavy=0), replace(full, heavy=0, broadcast_bytes=0), replace(full, broadcast_bytes=0)):
        exact = settings.heavy > 0
        got = {x.doc_id: x.score for x in lm_score.lm_score(odd(spark, rows), settings).collect()}
        near = 0
        for i, t, _, _ in rows:
            want = 0.0
            for a, b in zip(tokens(t), tokens(t)[1:]):
                c_ctx, c_cur = (single[x] if exact else level(0, single[x]) for x in (a, b))
                c_pair = pair[a, b] if exact and pair[a, b] >= lm_score.FREQUENT else level(1, pair[a, b])
                want += math.log10((min(c_pair, c_ctx) + settings.prior * (c_cur + 0.5) / (n + 0.5 * (v + 1))) / (c_ctx + settings.prior))
            near += got[i] == pytest.approx(want)
        assert near >= 0.9 * len(rows)


def test_lm_score_writes_less_than_its_texts_and_any_portions_agree(spark, monkeypatch):
    """beyond the broadcast limit several times the input was written."""
    from tessera.shared import shared_dir

    docs = odd(spark, [(i, prose(i % 50, 900), "en", "a") for i in range(200)]).repartition(4)
    before = set(Path(shared_dir(spark)).iterdir())
    whole = {r.doc_id: r for r in lm_score.lm_score(docs, lm_score.Settings(broadcast_bytes=0, heavy=5)).collect()}
    wrote = [p for p in Path(shared_dir(spark)).iterdir() if p not in before and not p.name.startswith("texts-")]
    assert 0 < sum(f.stat().st_size for p in wrote for f in p.rglob("*.parquet")) < sum(len(prose(i % 50, 900)) for i in range(200))
    monkeypatch.setattr(lm_score, "PORTION", 1)
    for r in lm_score.lm_score(docs, lm_score.Settings(heavy=5)).collect():
        assert r.score == pytest.approx(whole[r.doc_id].score) and r.base_score == pytest.approx(whole[r.doc_id].base_score) and r.n_known == whole[r.doc_id].n_known


def test_filter_reads_back_levels():
    import pyarrow as pa

    keys = textbatch.mix(np.arange(20_000, dtype=np.uint64))
    level = (np.arange(20_000) % 9).astype(np.int32)
    part = lm_score.part_of(keys, 3)
    found = []
    for i in (0, 2):
        bits = np.zeros(1 << 20, bool)
        lm_score.insert(bits, keys[part == i], level[part == i])
        found.append(np.packbits(bits, bitorder="little").tobytes())
    got = lm_score.Filter(pa.table({"part": pa.array([0, 2], pa.int32()), "bits": pa.array(found, pa.binary())}), 3).probe(keys)
    there = part != 1
    assert (got[there] >= level[there]).all() and (got[there] == level[there]).mean() > 0.95 and not got[~there].any()


def test_shards_fit_and_only_full_ones_are_split(spark):
    docs = odd(spark, [(i % 50, prose(i, 20), "en", "a") for i in range(300)])
    got = shard.shard(docs, shard.Settings(limit=3000)).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.n_bytes
    assert len(got) == 300 and all(r.shard_bytes == sizes[r.shard] and (r.shard_bytes <= 3000 or r.shard_rows == 1) for r in got)
    for prefix in sizes:  # the parent was too large
        assert not prefix or sum(n for p, n in sizes.items() if p.startswith(prefix[:-1])) > 3000


def test_shards_are_written_with_their_texts(spark, tmp_path):
    docs = odd(spark, [(i % 50, prose(i, 20), "en", "a") for i in range(300)] + [(7, None, None, None)])
    found = shard.write_shards(docs, str(tmp_path / "out"), shard.Settings(limit=3000)).collect()
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((x.doc_id, x.text or "") for x in back.collect()) == sorted((x.doc_id, x.text or "") for x in docs.collect())
    sizes = Counter()
    for x in back.collect():
        sizes[x.shard[1:]] += len((x.text or "").encode())
    assert {x.shard: x.shard_bytes for x in found} == dict(sizes) and len(found) > 1
    assert shard.write_shards(odd(spark, []), str(tmp_path / "none")).collect() == []


def test_mix_buckets_are_even(spark):
    rows = [(i, prose(i, 3) + " #$%" * (i % 9), "en", "a") for i in range(4000)]
    bucket = mix_sources.bucketed(odd(spark, rows), mix_sources.Settings(buckets=8)).groupBy("source", "bucket").count()
    n = sorted(x["count"] for x in bucket.collect())
    assert n[-1] <= 0.05 * 4000


def test_maximal_segments():
    def brute(s, low, high):
        best, at = 0, None
        for i in range(low, high):
            for j in range(i, high):
                if (total := sum(s[i : j + 1])) > best + 1e-12:
                    best, at = total, (i, j)
        return [] if at is None else [*brute(s, low, at[0]), (*at, round(best, 6)), *brute(s, at[1] + 1, high)]

    r = random.Random(3)
    for _ in range(400):
        n = r.randint(1, 14)
        places = sorted(r.sample(range(n), r.randint(0, n)))
        scores = [r.choice([1.37, 2.11, 0.73]) + r.random() * 0.01 for _ in places]
        full = [-0.5001] * n
        for a, b in zip(places, scores):
            full[a] = b
        assert [(a, b, round(x, 6)) for a, b, x in toxicity.maximal_segments(places, scores, 0.5001)] == brute(full, 0, n)


def test_toxic_documents_of_the_held_out_part(spark):
    r = random.Random(5)
    rows = [(i, prose(i, 80) + (" vile filth scum" * 2 if i % 6 == 0 else "") + " " + prose(r.random(), 20), "en", "a") for i in range(600)]
    docs = odd(spark, rows)
    model = toxicity.fit(docs.select("doc_id", "text"), labels(spark, [(i, int(i % 6 == 0)) for i in range(600)]))
    got = [(r.doc_id, r.predicted) for r in toxicity.toxicity(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(p == (i % 6 == 0) for i, p in got) >= 0.97 * len(got)


@pytest.mark.parametrize("crowd", [3, 256])
def test_line_dedup_against_brute_force(spark, crowd):
    r = random.Random(7)
    lines = [prose(i, r.randint(1, 30)) for i in range(60)]
    rows = []
    for i in range(80):
        own = []
        for _ in range(r.randint(0, 5)):
            words = r.choice(lines).split()
            if r.random() < 0.6:
                words[r.randrange(len(words))] = r.choice(["new", "other", "third"])
            own.append(" ".join(words))
        rows.append((i, "\n".join(own), "en", "a"))
    got = {x.doc_id: x for x in line_dedup.line_dedup(odd(spark, rows), line_dedup.Settings(crowd=crowd)).collect()}
    before = []
    for i, t, _, _ in rows:
        removed = 0
        for line in t.split("\n"):
            s = set(WORD.findall(lower(line)))
            if s:
                removed += any(len(s & o) >= 0.8 * len(s | o) - 1e-9 for o in before)
                before.append(s)
        assert got[i].n_removed == removed


@pytest.mark.parametrize("threshold, crowd, hot", [(0.5, 256, 1 << 16), (0.5, 2, 1 << 16), (0.7, 3, 4), (0.8, 256, 3), (1.0, 2, 2)])
def test_line_dedup_at_any_threshold(spark, monkeypatch, threshold, crowd, hot):
    monkeypatch.setattr(line_dedup, "CROWD_BLOCK", 2 * crowd + 4)  # words of both kinds
    r = random.Random(17)
    words = [f"w{i}" for i in range(9)]
    rows = [(i, "\n".join(" ".join(r.sample(words, r.randint(1, 5))) for _ in range(2)), "en", "a") for i in range(60)] + [(90, "a b c d", "en", "a"), (91, "a b c", "en", "a")]
    settings = line_dedup.Settings(threshold=threshold, crowd=crowd, hot=hot)
    got = {x.doc_id: (x.n_removed, x.n_links) for x in line_dedup.line_dedup(odd(spark, rows), settings).collect()}
    sets = {i: [frozenset(line.split()) for line in t.split("\n")] for i, t, _, _ in rows}
    distinct = {s for x in sets.values() for s in x}
    near = lambda a, b: len(a & b) >= threshold * len(a | b) - 1e-9
    before = []
    for i, own in sets.items():
        removed = 0
        for s in own:
            removed += any(near(s, o) for o in before)
            before.append(s)
        assert got[i] == (removed, sum(near(s, o) for s in own for o in distinct if o != s))


@pytest.mark.parametrize("crowd, nodes", [(3, 16), (256, 1024)])
def test_line_dedup_counts_all_links(spark, monkeypatch, crowd, nodes):
    monkeypatch.setattr(line_dedup, "BLOCK_NODES", nodes, raising=False)
    monkeypatch.setattr(line_dedup, "COLUMNS", 7, raising=False)
    r = random.Random(9)
    bases = [[f"b{k}w{i}" for i in range(20)] for k in range(4)]
    rows = []
    for i in range(120):
        words = list(bases[i % 4])
        for _ in range(r.choice([0, 1, 2, 2])):
            words[r.randrange(20)] = f"x{r.randrange(12)}"
        rows.append((i, " ".join(words), "en", "a"))
    got = {x.doc_id: x.n_links for x in line_dedup.line_dedup(odd(spark, rows), line_dedup.Settings(crowd=crowd)).collect()}
    sets = {i: frozenset(WORD.findall(t)) for i, t, _, _ in rows}
    distinct = set(sets.values())
    want = {i: sum(o != s and len(s & o) >= 0.8 * len(s | o) - 1e-9 for o in distinct) for i, s in sets.items()}
    assert got == want and max(want.values()) > 10


def test_decontamination_checks_slots(spark):
    rows = [
        (1, "x y z. Anna bought 37 apples and gave 9 of the apples to his sister Ruth, how many apples does Anna have left now? more", "en", "a"),
        (2, "Anna bought 37 apples and gave 9 of the apples to his sister Ruth, how many apples does Bob have left now?", "en", "a"),
        (3, prose(1, 60), "en", "a"),
        (4, BENCH[0][1].upper().lower(), "en", "a"),
    ]
    few = BENCH[0][1].split()
    rows += [(5 + k, " ".join(w for j, x in enumerate(few) for w in ([x, "really"] if j in places else [x])), "en", "a") for k, places in enumerate([(10,), (7, 14), (9, 18)])]
    rows.append((8, " ".join(few[:4] + few[5:]), "en", "a"))
    got = {r.doc_id: (r.contaminated, list(r["items"])) for r in decontaminate.decontaminate(odd(spark, rows), bench(spark)).collect()}
    by_shuffle = {r.doc_id: (r.contaminated, list(r["items"])) for r in decontaminate.decontaminate(odd(spark, rows), bench(spark), decontaminate.Settings(broadcast_windows=0, broadcast_items=0)).collect()}
    assert got[4] == (True, [1]) and all(got[i] == (True, [1]) for i in (5, 6, 7, 8))  # in lower case; with words put in or left out
    assert got[1] == (True, [1]) and got[2] == (False, []) and got[3] == (False, [])
    assert by_shuffle == got
    kept = decontaminate.clean(odd(spark, rows), bench(spark))
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(1, 9) if not got[i][0]]


def test_decontamination_finds_copies_in_any_case(spark):
    items = [(1, BENCH[0][1]), (2, BENCH[1][1]), (3, "WHICH OF THE RIVERS OF FRANCE IS THE LONGEST AND WHERE DOES IT END"), (4, "10 20 30 40 50 60 70 80 90 100"), (5, "WHO WROTE HAMLET")]
    rows = []
    for i, t in items:
        rows += [(10 * i + k, f"{prose(i, 20)} {form} {prose(-i, 20)}", "en", "a") for k, form in enumerate([t, t.upper(), t.lower(), t.title()])]
    rows += [(90, items[0][1].upper().replace("12", "37").replace("5", "9"), "en", "a"), (91, prose(3, 80).upper(), "en", "a"), (92, "11 22 33 44 55 66 77 88 99 111", "en", "a")]
    found = []
    for settings in (decontaminate.Settings(), decontaminate.Settings(broadcast_windows=0)):
        marked = decontaminate.decontaminate(odd(spark, rows), spark.createDataFrame(items, "item_id long, text string"), settings)
        found.append({r.doc_id: list(r["items"]) for r in marked.collect()})
    assert found[0] == found[1] == {**{10 * i + k: [i] for i, _ in items for k in range(4)}, 90: [1], 91: [], 92: []}


def test_mix_meets_targets(spark):
    rows = [(i, prose(i, 5 + i % 40), "en", f"s{i % 5}" if i % 50 else None) for i in range(400)]
    got = mix_sources.mix_sources(odd(spark, rows)).collect()
    goal = Counter()
    for r in got:
        goal[r.source_size, r.target] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    assert all(abs(taken - target) <= 1 for (_, target), taken in goal.items())
    assert sum(t for _, t in goal) == pytest.approx(sum(r.size for r in got))
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix_sources.mix_sources(odd(spark, rows)).collect()), key=str)


def test_license_places(spark):
    rows = [(1, "cc by nc cc by nc", "en", "a"), (2, "Under the MIT-license; x under THE mit License", "en", "a"), (3, "é under the mit license é", "en", "a"), (4, prose(1, 200) + " Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files " + prose(2, 100), "en", "a")]
    got = {r.doc_id: tuple(r)[1:] for r in license_scan.license_scan(odd(spark, rows)).collect()}
    assert got[1] == (6, 2, 0, 3, "cc-by-nc", "cc-by-nc", 1.0)
    assert got[2] == (9, 2, 0, 5, "mit", "mit", 1.0)
    assert got[3] == (6, 1, 1, 1, "mit", "mit", 1.0)
    assert got[4][1] == 0 and got[4][5] == "mit" and 0.8 <= got[4][6] < 1


def test_licenses_are_told_apart(spark):
    texts = [
        "released under the Apache license", "licensed under CC BY 4.0", "He was released under bail; the driver held a valid license", "the mit press was " + prose(5, 30) + " released under a license",
        "x Released under the MIT License.", "y Licensed under the Apache License, Version 2.0 z", "see: all rights reserved", "Licensed under CC-BY-NC 4.0", prose(9, 100) + " This work is licensed under the GNU General Public License, version 3 " + prose(8, 40),
    ]
    got = {r.doc_id: r.labels for r in license_scan.license_scan(odd(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(9)] == ["", "", "", "", "mit", "apache-2", "all-rights-reserved", "cc-by-nc", "gpl"]


def test_words_of_another_license_count_against_a_match(spark):
    wanted = {
        "licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc", "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License": "lgpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License": "agpl", "You can redistribute it and/or modify it under the terms of the GNU General Public License; this program is free software": "gpl",
    }
    rows = [(i, f"{prose(i, 50)} {t} {prose(-i, 50)}", "en", "a") for i, t in enumerate(wanted)]
    assert [r.labels for r in license_scan.license_scan(odd(spark, rows)).orderBy("doc_id").collect()] == list(wanted.values())


def test_license_scan_against_brute_force(spark):
    r = random.Random(31)
    words = sorted({w for t, *_ in license_scan.TEMPLATES for w in t.split()})
    rows = []
    for i in range(60):
        own = []
        for _ in range(r.randint(0, 6)):
            t = r.choice(license_scan.TEMPLATES)[0].split()
            own += [w for w in t if r.random() < 0.9] + [r.choice(words + ["filler"]) for _ in range(r.randint(0, 40))]
        rows.append((i, " ".join(own), "en", "a"))
    got = {x.doc_id: (x.labels, x.base_labels) for x in license_scan.license_scan(odd(spark, rows)).collect()}
    for i, t, _, _ in rows:
        w = t.split()
        labels = set(filter(None, got[i][1].split(",")))
        for text, label, marks, nots in license_scan.TEMPLATES:
            n, span = set(text.split()), min(2 * len(text.split()), 32)
            for b in range(0, len(w), 32):
                raw = w[b : b + 64]
                for k in range(max(len(raw) - span, 0) + 1):
                    run = set(raw[k : k + span])
                    if set(marks.split()) <= run and not run & set(nots.split()) and len(run & n) >= 0.8 * len(n) - 1e-9:
                        labels.add(label)
        assert got[i][0] == ",".join(sorted(labels))


def test_token_counts_equal_the_library(spark):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    path = p.path("byte_bpe_50k.json")
    r = random.Random(1)
    texts = ["", "a  b\n\n c", "<|endoftext|>x <|endoftext|> y<|endoftext|>", "it's  we'll 'S", "   x", "x" * 3000, *("".join(r.choice(" \n\t'aAéß日😀!?<|>endoftx019 ́") for _ in range(r.randint(1, 60))) for _ in range(500))]
    counter = token_counts.Counter(path, p.PATTERN, token_counts.whole_tokens(path), token_counts.special_strings(path))
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert counter.counts(texts) == want
    short, token_counts.LONG_TEXT = token_counts.LONG_TEXT, 10
    try:
        assert counter.counts(texts) == want
    finally:
        token_counts.LONG_TEXT = short


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(11)
    bases = [prose(i, 150).split() for i in range(12)]
    rows = []
    for i in range(150):
        words = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 6])):
            words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
        rows.append((i, " ".join(words), "en", "a"))
    docs = odd(spark, rows)
    settings = near_dedup.Settings(common=1.0)  # all weights are counts
    got = {x.doc_id: x.class_id for x in near_dedup.near_dedup(docs, settings).collect()}
    sets = {i: {tuple(w[k : k + 5]) for w in [lower(t).split()] for k in range(len(w) - 4)} for i, t, _, _ in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert sum(got[i] != find(i) for i in sets) <= 3


def test_near_duplicates_do_not_depend_on_crowd(spark):
    r = random.Random(13)
    base = prose(5, 150).split()
    rows = []
    for i in range(200):
        words = list(base)
        for _ in range(r.choice([1, 2, 2, 3, 3])):
            words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
        rows.append((i, " ".join(words), "en", "a"))
    docs = odd(spark, rows)
    found = []
    for crowd in (1 << 20, 8):
        settings = near_dedup.Settings(common=1.0, crowd=crowd, rows=6, bands=4, extra=40)  # few common bands
        found.append({x.doc_id: x.class_id for x in near_dedup.near_dedup(docs, settings).collect()})
    assert found[0] == found[1]


def test_samples_agree_as_the_weighted_similarity():
    h = textbatch.mix(np.arange(300, dtype=np.uint64))
    w = np.ones(300, np.float32)
    a = near_dedup.sample(np.zeros(200, np.int64), h[:200], w[:200], 1, 600)
    b = near_dedup.sample(np.zeros(200, np.int64), h[100:], w[:200] * 2, 1, 600)
    assert abs((a == b).mean() - 100 / 500) < 0.06


def test_quality_counts_and_verdicts(spark):
    rows = [(i, prose(i, 100), "en", "a") for i in range(200)] + [(900, " ".join(w + "!!%%" for w in prose(5, 100).split()), "en", "a"), (901, "few words", "en", "a"), (902, "same line here\n" * 30, "en", "a")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(odd(spark, rows), ["doc_id", "lang", "source"]).collect()}
    for i, t, _, _ in rows:
        words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        three = Counter(zip(words, words[1:], words[2:]))
        cover = {k + j for k in range(len(words) - 2) if three[tuple(words[k : k + 3])] > 1 for j in range(3)}
        f = got[i]["__f"]
        assert (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
    assert all(got[i]["__kept"] for i in range(200)) and not any(got[i]["__kept"] for i in (900, 901, 902))
    assert not got[900]["__base_failed"] and got[901]["__base_failed"] and got[902]["__base_failed"]


def test_contract_registers_all():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in contract.QUERIES) == list(range(1, 14))


def test_components_against_brute_force(spark):
    r = random.Random(41)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1100)] + [(2000 + (i * 37) % 64, 2000 + ((i + 1) * 37) % 64) for i in range(63)]
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {x.node: x.comp for x in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for pair in links if pair[0] != pair[1] for x in pair}
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_similarities_by_matrices_equal_the_pairwise_ones(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(near_dedup, "COLUMNS", 50)
    r = random.Random(43)
    texts = [prose(i % 5, 40) + " " + " ".join(["again and again we say so"] * (i % 4)) + " " + prose(i, r.randint(0, 30)) for i in range(30)] + ["", "one two"]
    settings = near_dedup.Settings()
    counts = np.zeros((2, near_dedup.SLOTS))
    counts[:, ::3] = 25
    freq = near_dedup.Frequencies(counts, 32, settings)
    x, y = np.arange(0, 32), np.arange(5, 32)
    got = near_dedup.similarities(pa.array(texts), x, y, settings, freq)
    for i in x:
        want = near_dedup.similarity(pa.array([texts[i]] * len(y)), pa.array([texts[j] for j in y]), settings, freq)
        assert got[i][y != i] == pytest.approx(want[y != i], abs=1e-6)  # a text is never compared with itself


def test_document_frequencies_act_and_count_copies_once(spark):
    rare = [prose(1000 + i, 60) for i in range(200)]
    rows = [(i, f"{text} this passage stands in very many of the texts here", "en", "a") for i, text in enumerate(rare)] + [(900 + i, rare[0], "en", "a") for i in range(300)]
    docs = odd(spark, rows)
    keyed = docs.select("text", near_dedup.node_of(docs.text).alias("node"))
    texts = sorted(r.text for r in near_dedup.different(keyed).collect())
    assert texts == sorted({t for _, t, _, _ in rows})
    freq = near_dedup.frequencies(near_dedup.different(keyed), near_dedup.Settings())
    weigh = lambda text: freq.weights(*near_dedup.shingles(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), 5)[1:])
    common, single = weigh("passage stands in very many of the texts"), weigh(rare[0])
    assert common.max() < 0.55 < 0.6 < np.median(single)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_near_duplicates_of_the_tables_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    settings = near_dedup.Settings()
    freq = near_dedup.frequencies(near_dedup.different(docs.select("text", near_dedup.node_of(docs.text).alias("node"))), settings)
    got = {x.doc_id: x.class_id for x in near_dedup.near_dedup(docs, settings).collect()}
    rows = docs.where(r"text RLIKE '[^\\x20\\x09-\\x0D]'").toArrow()
    ids, every = rows.column("doc_id").to_pylist(), np.arange(rows.num_rows)
    near = near_dedup.similarities(rows.column("text").combine_chunks(), every, every, settings, freq) >= settings.threshold - 1e-9
    links = [(ids[a], ids[b]) for a, b in np.argwhere(np.triu(near, 1))]
    assert len(links) > 50 and sum(got[a] == got[b] for a, b in links) >= 0.98 * len(links)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert all(find(i) == find(got[i]) for i in ids)  # no class holds what no links connect


def test_quality_verdicts_against_brute_force(spark):
    r = random.Random(47)
    rows = [(i, prose(i, r.randint(40, 120)) + " !?#$"[: r.randint(0, 5)] * r.randint(0, 12), r.choice(["en", "de", None]), r.choice(["a", "a", "a", "b", None])) for i in range(500)]
    settings = quality_rules.Settings(min_group=60)
    runs = []
    for n in (1, 5):
        found = quality_rules.quality_rules(odd(spark, rows).repartition(n), ["doc_id", "lang", "source"], settings).collect()
        runs.append({x.doc_id: (x["__f"], x["__kept"]) for x in found})
    assert runs[0] == runs[1]
    group = {i: (a, b) for i, _, a, b in rows}
    step = lambda v: 0 if v <= settings.least else math.ceil(math.log(v / settings.least) / math.log(settings.growth))
    value = lambda k: 0.0 if k == 0 else 2 * settings.least / (settings.growth + 1) * settings.growth**k

    def cutoff(feature, members):
        places = sorted(step(runs[0][i][0][feature]) for i in members)
        mid, high = (value(places[math.ceil(q * len(places)) - 1]) for q in (0.5, 0.75))
        return mid + max(settings.spread * (high - mid), settings.margins[feature])

    def members(i):
        own = [j for j in group if group[j] == group[i]]
        lang = [j for j in group if group[j][0] == group[i][0]]
        return own if len(own) >= settings.min_group else lang if len(lang) >= settings.min_group else list(group)

    cuts = {}
    for i, (f, kept) in runs[0].items():
        if group[i] not in cuts:
            cuts[group[i]] = {c: cutoff(c, members(i)) for c in settings.margins}
        base = f.n_words < 50 or 100 * f.n_repeat_words > 50 * f.n_words
        assert kept == (not base and all(f[c] <= cuts[group[i]][c] for c in settings.margins)), i


def _plain_matches(item, doc, settings):
    """Matches of windows (item place, document place, size, folded) of two lists of (value, kind), by comparing all of them."""

    def key(tokens, folded):
        kinds = [0 if folded and k == decontaminate.NAME else k for _, k in tokens]
        template = tuple(v if k == 0 else k for (v, _), k in zip(tokens, kinds))
        enough = len({t for t, k in zip(template, kinds) if k == 0}) >= settings.literals
        if enough:
            return ("folded" if folded else "named", template)
        return ("values", tuple(v for v, _ in tokens)) if folded else None

    size = min(settings.window, len(item))
    out = []
    for folded in (False, True):
        if size < settings.window and key(item, folded) and key(item, folded)[0] == "values" and len({v for v, _ in item}) < settings.literals:
            continue
        for i in range(len(item) - size + 1):
            for j in range(len(doc) - size + 1):
                a, b = key(item[i : i + size], folded), key(doc[j : j + size], folded)
                if a is not None and a == b:
                    out.append((i, j, size, folded))
    return out


def _plain_cover(item, doc, matches):
    """The item's tokens in the matches, if its slots stand for the same values throughout."""
    seen, there, back = set(), {}, {}
    for i, j, n, folded in matches:
        for k in range(n):
            (ours, slot), (theirs, _) = item[i + k], doc[j + k]
            seen.add(i + k)
            if slot and not (folded and slot == decontaminate.NAME) and (there.setdefault((slot, ours), theirs) != theirs or back.setdefault((slot, theirs), ours) != ours):
                return 0
    return len(seen)


def test_decontamination_against_brute_force(spark):
    def canonical(text):
        out = []
        for t in (w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for w in text.split()):
            if t:
                kind = decontaminate.NUMBER if re.search("[0-9]", t) else decontaminate.UNIT if lower(t) in decontaminate.UNITS else decontaminate.NAME if "A" <= t[0] <= "Z" else 0
                out.append((lower(t), kind))
        return out

    r = random.Random(53)
    words = ["rate", "of", "the", "apples", "how", "many", "left", "after", "gives", "takes"]
    token = lambda: r.choice([r.choice(words), r.choice(words), r.choice(words), str(r.randrange(4)), r.choice(["Ann", "Bob"]), r.choice(["km", "h"])])
    items = [(i, " ".join(token() for _ in range(r.choice([3, 5, 8, 14, 20])))) for i in range(25)]
    rows = []
    for i in range(120):
        own = r.choice(items)[1].split()
        swap = {str(k): str(r.randrange(5, 9)) for k in range(4)} | {"Ann": r.choice(["Ann", "Eve"])}
        if r.random() < 0.5:
            own = [swap.get(t, t) for t in own]
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            at = r.randrange(len(own) + 1)
            own[at : at + r.randint(0, 1)] = [token() for _ in range(r.randint(0, 2))]
        rows.append((i, " ".join([*(token() for _ in range(r.randint(0, 12))), *own, *(token() for _ in range(r.randint(0, 12)))]), "en", "a"))
    settings = decontaminate.Settings()
    found = decontaminate.decontaminate(odd(spark, rows), spark.createDataFrame(items, "item_id long, text string"), settings).collect()
    got = {x.doc_id: (set(x["items"]), round(x.cover, 9)) for x in found}
    marked = 0
    for i, text, _, _ in rows:
        doc, want, best = canonical(text), set(), 0.0
        for number, t in items:
            item = canonical(t)
            matches = _plain_matches(item, doc, settings)
            bands = {(j - a) // settings.shift - k for a, j, _, _ in matches for k in (0, 1)}
            cover = 0
            for band in bands:
                inside = [m for m in matches if (m[1] - m[0]) // settings.shift - band in (0, 1)]
                for some in [inside, *([m for m in inside if m[1] - m[0] == d] for d in {m[1] - m[0] for m in inside})]:
                    same = [m for m in some if all(item[m[0] + k][0] == doc[m[1] + k][0] for k in range(m[2]))]
                    cover = max(cover, _plain_cover(item, doc, [m for m in some if not m[3]]), _plain_cover(item, doc, some), len({m[0] + k for m in same for k in range(m[2])}))
            if cover and cover >= settings.cover * len(item):
                want.add(number)
                best = max(best, cover / len(item))
        assert got[i] == (want, round(best, 9)), (i, text)
        marked += bool(want)
    assert 20 < marked < 120


def test_groups_of_matches_are_judged_in_portions():
    match = {"at": 0, "diagonal": 5, "folded": False, "vals": list(range(6)), "slots": [0] * 6, "d_vals": list(range(6))}
    groups = [[match | {"at": k % 20} for k in range(64)] for _ in range(600)] + [[match]]
    total = [25] * 600 + [60]
    batch = pa.RecordBatch.from_pydict({"row": pa.array(range(601)), "item_id": pa.array(range(601)), "total": pa.array(total, pa.int32()), "matches": pa.array(groups)})
    del groups
    tracemalloc.start()
    out = pa.Table.from_batches(decontaminate._aligned(decontaminate.Settings())([batch.slice(100), batch.slice(0, 100)])).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(r["row"] for r in out) == list(range(601))
    assert all(r["ok"] == (r["row"] < 600) for r in out) and {r["cover"] for r in out} == {1.0, 0.1}
    assert peak < 4 << 20


def test_near_copies_that_share_a_word_are_dealt_as_crowds():
    """op4: a word of up to `crowd` near copies gave a row for each two of them."""
    r = random.Random(4)
    near = [(1, 100 + k, 20, 0, 5, 0) for k in range(60)]
    far = [(2, 300 + k, 20, 0, r.getrandbits(63), r.getrandbits(31)) for k in range(60)]
    few = [(3, 500 + k, 20, 0, 5, 0) for k in range(20)]
    found = np.array([*near, *far, *few], line_dedup.POSTING)
    assert line_dedup.dense(found, 0.8).tolist() == [1, 3]
    settings = line_dedup.Settings()
    rows = pa.RecordBatch.from_pydict({"part": pa.array([0, 0]), "data": pa.array([found[:90].tobytes(), found[90:].tobytes()], pa.binary())})
    out = pa.Table.from_batches(line_dedup.matched(settings)([rows]))
    pairs = [(x["a"], x["b"]) for x in out.to_pylist() if x["a"] is not None]
    crowd = [(x["token"], x["node"]) for x in out.to_pylist() if x["a"] is None]
    want = {(a, b) for a, b in line_dedup_pairs(far) | line_dedup_pairs(few)}
    assert sorted(crowd) == [(1, 100 + k) for k in range(60)]
    assert set(pairs) == want and len(pairs) == len(want) and len(want) >= 190


@pytest.mark.parametrize("block", [1024, 48])
def test_links_of_near_copies_are_counted_where_they_are_found(spark, monkeypatch, block):
    """op4: near copies that the earliest line doesn't match gave a row for each two of them, joined four times."""
    monkeypatch.setattr(line_dedup, "CROWD_BLOCK", block)
    made, saved = {}, line_dedup.saved

    def counted(df, name):
        out = saved(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(line_dedup, "saved", counted)
    base = [f"b{i}" for i in range(20)]
    rows = [(0, " ".join([*base[3:], "the", "first", "line"]), "en", "a")]
    rows += [(i, " ".join(w if k != i % 20 else f"x{i}" for k, w in enumerate(base)), "en", "a") for i in range(1, 151)]
    rows += [(i, " ".join(f"y{i * 7 % 50 + k}" for k in range(12)), "en", "a") for i in range(151, 200)]
    got = {x.doc_id: (x.n_links, x.n_removed, x.class_id) for x in line_dedup.line_dedup(odd(spark, rows)).collect()}
    sets = {i: frozenset(t.split()) for i, t, _, _ in rows}
    links = {i: [j for j, o in sets.items() if j != i and len(s & o) >= 0.8 * len(s | o) - 1e-9] for i, s in sets.items()}
    assert {i: x[:2] for i, x in got.items()} == {i: (len(x), int(any(j < i for j in x))) for i, x in links.items()}
    assert {x[2] for i, x in got.items() if 0 < i < 151} == {1} and len(links[1]) >= 140
    assert max(made.values()) <= 10 * len(rows)


def line_dedup_pairs(postings):
    odd = lambda x, y: (x[4] ^ y[4]).bit_count() + (x[5] ^ y[5]).bit_count()
    return {(x[1], y[1]) for x in postings for y in postings if x[1] < y[1] and odd(x, y) <= 40 - 2 * 18}
