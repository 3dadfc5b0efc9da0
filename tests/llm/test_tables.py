"""Operators over the whole table, against plain versions: SimHash, substrings, sharding, mixing, quality, the pipeline."""

import hashlib
import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from barflow.llm import mixing, near, quality, sharding, simhash, substrings
from barflow.llm.graph import components
from tests.check import compare, duck
from tests.llm.tables import ROWS, edge, given, plain


def _joined(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def _all_links(prints):
    """prints: {id: fingerprint}; component by comparing all."""
    ids = sorted(prints)
    pairs = [(a, b) for a, b in itertools.combinations(ids, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    return _joined(pairs, ids)


def test_simhash_query(spark, sf):
    got = {r.doc_id: r for r in entry.queries()["op4_simhash"](spark, sf).collect()}
    want = _all_links({k: int(simhash.simhash(t)[0]) for k, t, _, _ in given(sf)})
    assert {k: r.component_id for k, r in got.items()} == want
    assert all(int(r.fingerprint, 16) == int(simhash.simhash(t)[0]) for (k, t, _, _) in given(sf) for r in [got[k]])


def test_chains_find_every_pair_within_four_bits(spark):
    g = random.Random(7)
    prints, n = {}, 0
    for _ in range(60):
        base = g.getrandbits(64)
        for bits in (0, 1, 2, 3, 4, 5):
            prints[n] = base ^ sum(1 << b for b in g.sample(range(64), bits))
            n += 1
    rows = [(v - (1 << 64) if v >= 1 << 63 else v, k) for k, v in prints.items()]
    distinct = spark.createDataFrame(rows, "fp0 long, id long").groupBy("fp0").agg({"id": "min"}).withColumnRenamed("min(id)", "id")
    links = {tuple(sorted(r)) for r in simhash.links(distinct).collect()}
    firsts = {r.fp0 % (1 << 64): r.id for r in distinct.collect()}
    assert _joined(links, firsts.values()) == _all_links({k: v for v, k in firsts.items()})
    assert all((prints[a] ^ prints[b]).bit_count() <= 4 for a, b in links)


def test_simhash_edges(spark):
    got = simhash.near_duplicates(edge(spark, clashing=True)).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[0].component_id == by[1].component_id == by[2].component_id == 0 and by[4].component_id == 3
    assert sorted(r.component_id is None for r in got if r.doc_id is None) == [False, True]  # the NULL text joins the empty ones
    assert simhash.near_duplicates(edge(spark, [])).collect() == []


def test_wide_fingerprints_catch_near_copies_only(spark, sf):
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(edge(spark), 5, 4).collect() if r.doc_id is not None}
    assert got[8] == got[9] == got[10] == 8 and got[3] == got[4] and got[12] == got[13]
    assert got[11] == 11 and got[15] == 15 and got[17] == 17


def _shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def _alike(texts):
    """texts: {id: text}; component by the likeness of all pairs, 0.8 or more."""
    sets = {k: _shingles(t) for k, t in texts.items()}
    by, common = {}, Counter()
    for k in sorted(sets):
        for s in sets[k]:
            by.setdefault(s, []).append(k)
    for ids in by.values():
        common.update(itertools.combinations(ids, 2))
    return _joined([p for p, n in common.items() if 5 * n >= 4 * (len(sets[p[0]]) + len(sets[p[1]]) - n)], sets)


@pytest.mark.parametrize("block", [None, 300])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, block):
    """Pairs from a likeness of 0.7 to 0.9, chains and short texts; in whole clusters and in blocks."""
    if block:
        monkeypatch.setattr(near, "BLOCK", block)
    g, texts = random.Random(3), {}
    for i in range(70):
        words = [f"w{g.randrange(4000)}" for _ in range(g.choice([3, 6, 9, 24, 60, 200]))]
        for _ in range(3):
            texts[len(texts)] = " ".join(words)
            at = g.randrange(len(words))
            cut = round(len(words) * g.uniform(0.04, 0.13))
            words = words[: len(words) - cut] + [f"n{g.randrange(9999)}" for _ in range(cut)] if g.random() < 0.5 else [*words[:at], "x", *words[at + 1 :]]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(edge(spark, [(k, t, "en", "a") for k, t in texts.items()]), 5, 4).collect()}
    want = _alike(texts)
    assert got == want and 70 < len(set(want.values())) < 190


def test_near_candidates_hold_all_of_simhash(spark):
    """Every pair that op4's own rule links (here over five words) is compared, also those of one fingerprint."""
    g, prints = random.Random(7), []
    for _ in range(40):
        base = g.getrandbits(64)
        prints += [base, base, base ^ (1 << g.randrange(64)), base ^ sum(1 << b for b in g.sample(range(64), 4))]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    rows = [(i, signed[i], [i] * 4, [1000 + i]) for i in range(len(prints))]
    d = spark.createDataFrame([(i, p, *fp, k) for i, p, fp, k in rows], "id long, simhash long, fp0 long, fp1 long, fp2 long, fp3 long, keys array<long>")
    found = [(r.a, r.b) for r in near.candidates(d, 4).collect()]
    assert _joined(found, range(len(prints))) == _all_links(dict(enumerate(prints)))


def test_near_texts_are_not_shuffled_beside_few_marks(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        out = corpus_pipeline.keep_one_of_near(spark, edge(spark), "")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "LeftAnti" in plan and not re.search("SortMergeJoin.*LeftAnti", plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_near_duplicates_equal_all_pairs_of_given_texts(spark):
    texts = {k: t for k, t, _, _ in given("/root/testdata/sf0.01")}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, 5, 4).collect()} == _alike(texts)


def test_components_of_paths_stars_and_loops(spark):
    g = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(200, 260)] + [(5, 5)] + [(g.randrange(1000, 1100), g.randrange(1000, 1100)) for _ in range(90)]
    g.shuffle(pairs)
    nodes = {x for p in pairs for x in p}
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {n: got.get(n, n) for n in nodes} == _joined(pairs, nodes)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def _left(docs):
    """docs: (doc_id, text) in order; plain removal of repeated 20-word windows."""
    seen, out = set(), {}
    for doc_id, text in docs:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out[doc_id] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_substrings_query(spark, sf):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in entry.queries()["op9_substrings"](spark, sf).collect()}
    assert got == _left([(k, t) for k, t, _, _ in given(sf)])


@pytest.mark.parametrize("letters", [2, 5, 400])
def test_substrings_with_many_branches(spark, letters):
    g = random.Random(letters)
    passages = [" ".join(f"w{g.randrange(letters)}" for _ in range(g.randint(15, 70))) for _ in range(12)]
    docs = [(i, " ".join(g.choice(passages) if g.random() < 0.6 else f"u{g.randrange(9999)}" for _ in range(g.randint(1, 12)))) for i in range(80)]
    got = substrings.remove_repeats(edge(spark, [(*d, "en", "a") for d in docs])).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got} == _left(docs)


def test_substrings_edges(spark):
    got = substrings.remove_repeats(edge(spark, clashing=True)).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[3].n_removed == 80 - 40 and by[4].n_removed == by[4].n_words and by[13].kept == "" and by[12].n_removed == 0
    assert [r.kept for r in got if r.doc_id == 5] == ["word", "word"] and by[15].n_removed > 0
    same = [(1, "a b " * 30, "en", "a")] * 3
    assert {r.n_removed for r in substrings.remove_repeats(edge(spark, same)).collect()} == {58}
    assert substrings.remove_repeats(edge(spark, [])).collect() == []


def test_substrings_of_rows_that_share_an_id(spark):
    """Thousands of rows without an id, others that share one: documents of their own, in order of id and hash of the text."""
    g = random.Random(8)
    opening = " ".join(f"o{i}" for i in range(30))
    passages = [" ".join(f"p{g.randrange(50)}" for _ in range(25)) for _ in range(40)]
    rows = [(None if i < 4060 else i % 7, f"{opening} t{i} {g.choice(passages)} " + " ".join(f"u{g.randrange(10**6)}" for _ in range(g.randint(0, 120)))) for i in range(4200)]
    docs = edge(spark, [(*r, "en", "a") for r in rows])
    got = {r.kept: r for r in substrings.remove_repeats(docs).collect()}
    order = [r.text for r in docs.select("text", "doc_id", F.xxhash64("text").alias("mark")).orderBy(F.col("doc_id").asc_nulls_last(), "mark").collect()]
    left = _left(list(enumerate(order)))
    assert Counter((r.n_words, r.n_removed, hashlib.sha256(k.encode()).hexdigest()) for k, r in got.items()) == Counter(left.values())
    assert sum(k.startswith(opening) for k in got) == 1


def _plain_ring(spark, sizes, shards, vnodes, places, slack):
    """Bounded loads round by round on a list of (place, bytes)."""
    prefs = {r.place: r.prefs for r in sharding.ring(spark, shards, vnodes, places).collect()}
    bound = -(-sum(b for _, b in sizes) * (1 + slack) // shards)
    load, shard = [0] * shards, {}
    for r in range(shards):
        ahead = list(load)
        for place, size in sorted(sizes):
            if place not in shard:
                want = prefs[place][r]
                if ahead[want] < bound:
                    shard[place] = want
                    load[want] += size
                ahead[want] += size
    return shard


def test_ring_lists_every_shard_clockwise(spark):
    rows = sharding.ring(spark, 4, 3, 64).collect()
    assert len(rows) == 64 and all(sorted(r.prefs) == [0, 1, 2, 3] for r in rows)
    nodes = {(r.at, r.shard) for r in spark.sql("SELECT pmod(xxhash64('node', id % 4, id div 4), 64) AS at, id % 4 AS shard FROM range(12)").collect()}
    for r in rows:
        ahead = [min((at - r.place) % 64 for at, s in nodes if s == shard) for shard in r.prefs]
        assert ahead == sorted(ahead)


def test_sharding_query(spark, sf):
    got = entry.queries()["op5_sharding"](spark, sf).collect()
    texts = {k: (t or "").encode() for k, t, _, _ in given(sf)}
    import zlib

    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {k: (len(t) + 1, zlib.crc32(t)) for k, t in texts.items()}
    bytes_of, slots = Counter(), {}
    for r in got:
        bytes_of[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(8))
    assert max(bytes_of.values()) <= sum(bytes_of.values()) / 8 * 1.001 + max(len(t) + 1 for t in texts.values()) + 1
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    places = {r.doc_id: r.p for r in spark.createDataFrame([(k,) for k in texts], "doc_id long").selectExpr("doc_id", f"pmod(xxhash64('key', string(doc_id)), {sharding.PLACES}) AS p").collect()}
    sizes = Counter()
    for k, t in texts.items():
        sizes[places[k]] += len(t) + 1
    want = _plain_ring(spark, list(sizes.items()), 8, sharding.VNODES, sharding.PLACES, sharding.SLACK)
    assert {r.doc_id: r.shard for r in got} == {k: want[places[k]] for k in texts}


def test_one_more_shard_moves_little(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    eight, nine = ({r.doc_id: r.shard for r in sharding.shard(docs, n, slack=0.05).collect()} for n in (8, 9))
    moved = sum(eight[k] != nine[k] for k in eight) / len(eight)
    assert moved < 0.5  # rehashing modulo the count would move eight ninths


def test_rows_without_ids_spread_over_the_shards(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("doc_id", F.expr("CASE WHEN doc_id % 4 = 0 THEN doc_id END"))
    got = sharding.shard(docs, 4).collect()
    held, copies = Counter(), Counter()
    for r in got:
        held[r.shard] += r["size"]
        copies[(r["size"], r.text_crc32)] += r["size"]
    assert len(got) == docs.count() and set(held) == set(range(4))
    for s in held:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    # Beyond its bound a shard holds less than one place: rows that share a text, and the few others there.
    assert max(held.values()) <= sum(held.values()) / 4 * 1.001 + 2 * max(copies.values())


def test_sharding_edges(spark):
    got = sharding.shard(edge(spark, clashing=True)).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1) for r in ROWS)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard(edge(spark, [])).collect() == []


def test_mixing_query_equals_sql(spark, sf):
    assert compare(entry.queries()["op8_mixing"](spark, sf), duck(sf), entry.oracle_sql()["op8_mixing"]) == ""


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1000, 1], [5, 0, 900, 3, 3], [0, 0], [7]])
def test_targets_are_reshared_until_none_is_above(spark, sizes):
    rows = [(f"s{i}", n) for i, n in enumerate(sizes)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    total, weight = sum(sizes), {s: i % 3 + 1 for i, (s, _) in enumerate(rows)}
    target, open_ = {}, dict(rows)
    while open_:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * open_[s]]
        target |= {s: 3 * open_.pop(s) for s in over} if over else {s: share[s] for s in open_}
        if not over:
            break
    assert got == pytest.approx(target)


@pytest.mark.parametrize("ids", ["doc_id", "CASE WHEN doc_id % 2 = 0 THEN doc_id END"])
def test_mixing_comes_within_a_document_of_every_target(spark, sf, ids):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("doc_id", F.expr(ids))
    rows = mixing.sized(docs)
    size = {r.source: (r.longest, r.total) for r in rows.groupBy("source").agg(F.max("size").alias("longest"), F.sum("size").alias("total")).collect()}
    target = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    got = mixing.mix(docs).groupBy("source").agg(F.sum(F.size(F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"))).alias("taken")).collect()
    taken = {r.source: r.taken for r in got}
    assert set(target) == set(size) and sum(total for _, total in size.values()) > 0
    assert all(abs(taken.get(s, 0) - target[s]) <= longest for s, (longest, _) in size.items())


@pytest.mark.parametrize("size,want", [(0, 0), (1, 1), (255, 255), (256, 256), (257, 256), (511, 510), (70_001, 69_632), ((1 << 40) + 1, 1 << 40)])
def test_mixing_grades(spark, size, want):
    assert spark.createDataFrame([(size,)], "size long").select(mixing.grade("size")).first()[0] == want


def test_mixing_edges(spark):
    docs = edge(spark, clashing=True)
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    counts = Counter((r.doc_id, r.text) for r in got.collect())
    assert all(n <= 3 * sum((r[0], r[1]) == k for r in ROWS) for k, n in counts.items())
    assert plain(mixing.mix(docs)) == plain(got)
    assert mixing.mix(edge(spark, [])).collect() == []


def test_mixed_rows_equal_the_query_on_every_document(spark, sf):
    rows = Counter(r.doc_id for r in mixing.mix(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id").collect())
    got = entry.queries()["op8_mixing"](spark, sf).collect()
    assert {r.doc_id: rows[r.doc_id] * r["size"] for r in got} == {r.doc_id: r.taken for r in got}
    assert set(rows) <= {r.doc_id for r in got}


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    got = entry.queries()["op6_quality"](spark, sf).collect()
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert len(got) == len({r.doc_id for r in got}) == duckdb.sql(f"SELECT count(*) FROM '{sf}/documents.parquet'").fetchall()[0][0]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_rules_as_columns_equal_rules_as_numbers(spark):
    g = np.random.default_rng(4)
    x = g.normal(size=(900, 3))
    y = ((x[:, 0] > 0.2) & (x[:, 1] <= 0.5) | (x[:, 2] > 1)).astype(float)
    model = quality.fit_rules(x, y, ["a", "b", "c"])
    assert 0 < len(model.rules) < 200
    from pyspark.sql import functions as F

    got = spark.createDataFrame(x.tolist(), "a double, b double, c double").select("a", "b", "c", model.column({n: F.col(n) for n in "abc"}).alias("s")).collect()
    for r in got[:50]:
        total = model.intercept + sum(w for w, tests in model.rules if all((r[n] > v) if above else (r[n] <= v) for n, above, v in tests))
        assert r.s == pytest.approx(1 / (1 + np.exp(-total)))
    truth = {tuple(v): t for v, t in zip(x.tolist(), y)}
    assert np.mean([(r.s >= 0.5) == truth[(r.a, r.b, r.c)] for r in got]) > 0.95


def test_quality_edges(spark):
    docs = edge(spark, clashing=True)
    labels = spark.createDataFrame([(3, 1), (3, 0), (17, 0), (8, 1), (None, 1), (12, None), (11, 5)], "doc_id long, quality int")
    scored = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(scored) == len(ROWS) and all(0 <= r.score <= 1 for r in scored)
    untrained = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert plain(quality.keep_good(docs, untrained)) == plain(docs)
    assert quality.score(edge(spark, []), untrained).collect() == []


def test_pipeline_on_given_tables(spark, sf):
    """Stage by stage: what goes and what stays, by plain versions of each decision."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    frames = [docs]
    for name, step in corpus_pipeline.STAGES:
        frames.append(corpus_pipeline.stage(step(spark, frames[-1], sf)))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mixture", "tokens"]
    assert all(f.columns == docs.columns for f in frames[:-1])
    rows = [f.collect() for f in frames]
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    assert {r.doc_id for r in rows[1]} == {k for k, s in scores.items() if s >= 0.7}
    wide = {r.doc_id: r.component_id for r in simhash.near_duplicates(frames[1], 5, 4).collect()}
    assert sorted(r.doc_id for r in rows[2]) == sorted({c for c in wide.values()})
    assert len({r.text for r in rows[2]}) == len(rows[2])
    before = {r.doc_id: r.text for r in rows[2]}
    from barflow.llm import secrets
    import re

    allow = tuple(map(re.compile, secrets.ALLOW))
    assert {r.doc_id: r.text for r in rows[3]} == {k: secrets.redact(t, secrets.scan(t, allow)[1]) for k, t in before.items()}
    assert set(r.doc_id for r in rows[4]) <= set(before)
    assert Counter(r.doc_id for r in rows[4]) == Counter(r.doc_id for r in rows[5])
    assert all(r.n_tokens == len(r.ids) for r in rows[5])


def test_near_stage_decides_by_text_not_by_id(spark, sf):
    one, two, three = (" ".join(f"{c}{i}" for i in range(50)) for c in "abc")
    rows = [(1, one), (1, two), (1, two), (2, two + " tail"), (3, one + " tail"), (None, two), (None, three), (None, three + " tail"), (None, three), (4, "z " + three[:40])]
    got = corpus_pipeline.keep_one_of_near(spark, edge(spark, [(*r, "en", "a") for r in rows]), sf).collect()
    kept = Counter((r.doc_id, r.text) for r in got)
    last = [k for k in kept if k[0] is None]
    assert len(last) == 1 and last[0][1].startswith(three)
    assert kept == Counter([(1, one), (1, two), (4, "z " + three[:40]), last[0]])


def test_pipeline_with_edges(spark, tmp_path):
    docs, labels = edge(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (docs, edge(spark, [])):
        frame = rows
        for _, step in corpus_pipeline.STAGES:
            frame = corpus_pipeline.stage(step(spark, frame, str(tmp_path)))
        frame.collect()
