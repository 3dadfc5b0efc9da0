"""Operators that look at one text at a time, against plain versions: BPE, secrets, rules, language, fingerprints."""

import hashlib
import random
import re
import struct
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
import xxhash

import __spark_entry__ as entry
from barflow.llm import bpe, fingerprints, language, rules, secrets
from tests.llm.tables import ROWS, edge, given

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def reference():
    ranks = bpe.ranks_of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_token_encodes_to_itself(reference):
    encoder = bpe.Encoder(reference[0])
    assert all(encoder.encode(token) == (rank,) for token, rank in reference[0].items())


@pytest.mark.parametrize("letters", ["abcdeéñßü 012 \n\t\x1c\x1f\x85 'st!#漢字😀ſK ", "".join(map(chr, range(128))) + "    'sdmlt", "ab", "=-"])
def test_tree_gives_the_same_tokens(reference, letters):
    texts, g = bpe.Texts(reference[0], public_tokenizers.PATTERN), random.Random(5)
    for n in [*range(60)] * 20 + [3000]:
        text = "".join(g.choice(letters) for _ in range(n))
        joined, data = texts.encode(text)
        assert joined == ",".join(map(str, reference[1].encode_ordinary(text)))
        assert data == text.encode()


def test_bpe_query(spark, sf, reference):
    got = {r.doc_id: r for r in entry.queries()["op3_bpe"](spark, sf).collect()}
    for doc_id, text, _, _ in given(sf):
        ids = reference[1].encode_ordinary(text or "")
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_edges(spark, reference):
    got = bpe.encode(edge(spark, clashing=True)).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((r[0], tuple(reference[1].encode_ordinary(r[1] or ""))) for r in ROWS)
    assert bpe.encode(edge(spark, [])).collect() == []


def _plain_base(text):
    spans = [(m.start(), "assign", m.end()) for m in secrets.ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    spans += [(m.start(), "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    spans += [(m.start(), "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(spans, key=lambda s: (s[0], ["assign", "access", "hex"].index(s[1])))


def test_secrets_query(spark, sf):
    got = {r.doc_id: r for r in entry.queries()["op2_secrets"](spark, sf).collect()}
    for doc_id, text, _, _ in given(sf):
        base = _plain_base(text or "")
        joined = ",".join(f"{k}:{a}:{b}" for a, k, b in base)
        assert got[doc_id].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[doc_id].n_assign, got[doc_id].n_access, got[doc_id].n_hex] == [sum(s[1] == k for s in base) for k in ("assign", "access", "hex")]
        assert set(joined.split(",")) - {""} <= set(got[doc_id].spans.split(","))


def test_allowed_strings_cover_at_any_distance():
    """An address or an example may begin far before the span; what only stands near does not cover."""
    allow, token = tuple(map(re.compile, secrets.ALLOW)), "Zx8Kq2LmP9vTn4Rw7Yb3hG5d"
    for gap in (1, 57, 67, 500, 9000):
        path = "a/.b" * gap
        assert not secrets.scan(f"https://host.org/{path}?{token}", allow)[1]
        assert secrets.scan(f"https://host.org/{path} {token}", allow)[1]
        assert not secrets.scan(f"x_example_{'-' * gap}{token}", allow)[1]
    assert not secrets.scan(f"sha256:{token} SHA-512={token} 123e4567-e89b-12d3-a456-426614174000", allow)[1]
    assert secrets.scan(f"sha256: {token}", allow)[1]


def test_long_runs_take_linear_time():
    g, letters = random.Random(2), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    allow, run = tuple(map(re.compile, secrets.ALLOW)), "".join(g.choices(letters, k=1 << 20))
    before = time.process_time()
    assert secrets.scan("data:" + run, allow)[1] and not secrets.scan("https://x?" + run, allow)[1]
    many = " ".join(f"https://a.b/{run[i : i + 40]} {run[i : i + 40]}" for i in range(0, 200_000, 40))
    assert len(secrets.scan(many, allow)[1]) > 4000
    assert time.process_time() - before < 60


def test_entropy_windows_equal_counting_anew():
    g = random.Random(3)
    for _ in range(200):
        run = "".join(g.choice("abcdef0123456789ABCXYZ+/-_") for _ in range(g.randint(20, 60)))
        covered = set()
        for name, members in secrets.CLASSES.items():
            for i in range(len(run) - 19):
                w = run[i : i + 20]
                h = -sum(c / 20 * np.log2(c / 20) for c in Counter(w).values())
                kinds = any(map(str.isdigit, w)) + any(map(str.islower, w)) + any(map(str.isupper, w))
                if set(w) <= members and h >= secrets.THRESHOLDS[name] - 1e-9 and kinds >= 2 and sum(map(str.isdigit, w)) >= 2:
                    covered.update(range(i, i + 20))
        spans = secrets.entropy_windows(run)
        assert {x for a, b in spans for x in range(a, b)} == covered
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_secrets_added_suppressed_and_redacted(spark):
    token = "Zx8Kq2LmP9vTn4Rw7Yb3Hd6J"
    texts = [f"see {token} here", f"https://host/{token} page", "id 3f2504e0-4f89-41d3-9a0c-0305e82c3301 end", f"sha256:{token}", "Donaudampfschifffahrtsgesellschaft",
             'password: "hunter2hunter2"', None, ""]
    docs = edge(spark, [(i, t, "en", "a") for i, t in enumerate(texts)], clashing=True)
    got = {r.doc_id: r for r in secrets.find_secrets(docs, redacted=True).collect()}
    assert [got[i].n_entropy for i in range(5)] == [1, 0, 0, 0, 0]
    assert got[0].redacted == "see <entropy> here"
    assert got[5].redacted == '<assign>"' and got[6].redacted is None and got[7].redacted == ""
    rows = {r.doc_id: r for r in secrets.redact_rows(docs).collect()}
    assert rows[0].text == "see <entropy> here" and rows[0].n_chars == 18 and rows[0].size == "x" and rows[6].n_chars is None
    assert secrets.find_secrets(edge(spark, [])).collect() == []


def test_secrets_edges(spark):
    got = secrets.find_secrets(edge(spark, clashing=True)).collect()
    assert len(got) == len(ROWS)
    assert next(r for r in got if r.doc_id == 6).base == "assign:0:31,access:33:53,hex:56:76"


def _counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + j for i, w in enumerate(windows) if w in twice for j in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def _xx(*values):
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(data, seed=seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def _hashes(text):
    hashes = [_xx(w) for w in WORD.findall(text or "")]
    return hashes + [_xx(a, b) for a, b in zip(hashes, hashes[1:])]


def _grams(text):
    hashes = [_xx(w) for w in WORD.findall(text or "")]
    return [h & (rules.BUCKETS - 1) for h in hashes + [_xx(a, b) for a, b in zip(hashes, hashes[1:])]]


def test_rules_query_against_plain_counts_and_ratios(spark, sf):
    import duckdb

    docs = given(sf)
    good = {r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{sf}/labels.parquet' WHERE quality = 1").fetchall()}
    raw, target = Counter(), Counter()
    for doc_id, text, _, _ in docs:
        grams = _grams(text)
        raw.update(grams)
        if doc_id in good:
            target.update(grams)
    n_raw, n_target = sum(raw.values()) + rules.BUCKETS, sum(target.values()) + rules.BUCKETS
    got = {r.doc_id: r for r in entry.queries()["op7_rules"](spark, sf).collect()}
    assert len(got) == len(docs)
    for doc_id, text, _, _ in docs:
        r, grams = got[doc_id], _grams(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == _counts(text)
        score = sum(np.log((target[g] + 1) / n_target) - np.log((raw[g] + 1) / n_raw) for g in grams) / max(1, len(grams))
        assert r.score == pytest.approx(score, abs=1e-9)
        assert r.kept == (not r.base_failed and r.score >= rules.LEAST)


def test_rules_edges(spark):
    docs = edge(spark, clashing=True)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = rules.judge(docs, rules.ratios(docs, none)).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter((r[0], *_counts(r[1])) for r in ROWS)
    assert {r.score for r in got} == {0.0}
    empty = edge(spark, [])
    assert rules.judge(empty, rules.ratios(empty, none)).collect() == []


def test_rules_buckets_follow_the_distinct_grams(spark, monkeypatch):
    monkeypatch.setattr(rules, "BUCKETS", 4)
    docs, labels = edge(spark), spark.createDataFrame([(3, 1), (8, 1)], "doc_id long, quality int")
    model = rules.ratios(docs, labels)
    grams = [[h & (model.buckets - 1) for h in _hashes(r[1])] for r in ROWS]
    distinct = len({h for r in ROWS for h in _hashes(r[1])})
    assert model.buckets / 2 < 1.05 * distinct / rules.LOAD and 0.95 * distinct / rules.LOAD < model.buckets
    raw, target = Counter(g for r in grams for g in r), Counter(g for r, row in zip(grams, ROWS) if row[0] in (3, 8) for g in r)
    n_raw, n_target = sum(raw.values()) + model.buckets, sum(target.values()) + model.buckets
    want = sorted(sum(np.log((target[g] + 1) / n_target) - np.log((raw[g] + 1) / n_raw) for g in r) / max(1, len(r)) for r in grams)
    assert sorted(r.score for r in rules.judge(docs, model).collect()) == pytest.approx(want, abs=1e-9)
    monkeypatch.setattr(rules, "HEAVY", 3)  # most buckets have an entry of their own
    assert sorted(r.score for r in rules.judge(docs, model).collect()) == pytest.approx(want, abs=1e-9)
    monkeypatch.setattr(rules, "HELD", 1)  # the ratios by a shuffle
    assert {(r.wide, r.good[0], r.raw[0]) for r in rules.bucket_counts(docs, labels, model.buckets, 1, ids=0).collect()} == {(b, target[b], n) for b, n in raw.items()}
    assert sorted(r.score for r in rules.judge(docs, model).collect()) == pytest.approx(want, abs=1e-9)


def test_language_query_on_held_out_rows(spark, sf):
    langs = {r[0]: r[2] for r in given(sf)}
    got = entry.queries()["op10_language"](spark, sf).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(langs) and len(held) > 30
    assert np.mean([langs[r.doc_id] == r.lang_pred for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_bit_sliced_filter_has_no_false_negatives(spark):
    docs = edge(spark, [(i, t, x, "a") for i, (t, x) in enumerate([("the thin thing", "en"), ("der das die und", "de"), ("le la les", "fr")])])
    langs, bits = language.learn(docs, share=0.0)
    assert langs == ["de", "en", "fr"]
    for text, lang in (("the thin thing", "en"), ("der das die und", "de"), ("le la les", "fr")):
        at = language.places(language.trigrams(text), len(bits))
        found = np.bitwise_and.reduce(bits[at, 0], axis=0)
        assert np.all(found >> np.uint64(langs.index(lang)) & np.uint64(1))
        assert language.decide(text, langs, bits, np.zeros(3))[0] == lang


def test_filter_grows_with_the_trigrams(spark):
    g = np.random.default_rng(2)
    text = "".join(map(chr, g.integers(0x4E00, 0x9F00, 3000)))
    docs = edge(spark, [(1, text, "zh", "a"), (2, "the thin thing", "en", "a")])
    langs, bits = language.learn(docs, slots=1 << 10)
    fill = np.count_nonzero(bits[:, 0] & np.uint64(1 << langs.index("zh"))) / len(bits)
    assert fill**language.HASHES <= 1.1 * language.RATE and len(bits) == 1 << 15


def test_language_edges(spark):
    docs = edge(spark, clashing=True)
    model = language.learn(docs)
    got = language.identify(docs, *model).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r.lang_pred for r in got if r.doc_id is not None}
    assert by[0] == by[1] == by[2] == by[16] == "und" and by[14] == "en"
    none = language.learn(edge(spark, [(1, "abc", None, "a")]))
    assert none[0] == [] and language.identify(docs, *none).filter("lang_pred <> 'und'").count() == 0
    assert language.identify(edge(spark, []), *model).collect() == []


def _shingles(text):
    words = WORD.findall(text or "")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_fingerprint_likeness_follows_the_shingles(spark, sf):
    docs = given(sf)
    got = {r.doc_id: r for r in entry.queries()["op1_fingerprints"](spark, sf).collect()}
    assert len(got) == len(docs)
    errors = []
    for i, (doc_id, text, _, _) in enumerate(docs):
        r, text, after = got[doc_id], text or "", docs[(i + 1) % len(docs)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = map(_shingles, (text, edited, after))
        errors += [r.near_edited - len(a & b) / max(1, len(a | b)), r.near_next - len(a & c) / max(1, len(a | c))]
    assert max(map(abs, errors)) < 0.13 and abs(np.mean(errors)) < 0.01


def test_fingerprint_edges(spark):
    docs = edge(spark, clashing=True)
    got = fingerprints.compare_next(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in got) == sorted((r[0] is None, r[0] or 0, len(r[1] or "")) for r in ROWS)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[3].fingerprint == by[4].fingerprint and by[3].near_next == 1.0
    assert by[0].fingerprint == "" and by[0].near_next == 1.0 and by[2].near_next == 0.0
    assert by[13].edited_sha256 == hashlib.sha256((ROWS[16][1][: len(ROWS[16][1]) - len(ROWS[16][1]) // 2] + "x" * (len(ROWS[16][1]) // 2)).encode()).hexdigest()
    one = fingerprints.compare_next(edge(spark, [(1, "only one text of more than five words", "en", "a")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints.compare_next(edge(spark, [])).collect() == []
    assert len(fingerprints.fingerprint(docs).collect()) == len(ROWS)


def test_single_shingles_do_not_agree_by_chance():
    a, b = fingerprints.sketches(pa.array(["one short text", "another short text"]))
    assert fingerprints.likeness(a, b) < 0.15 and fingerprints.likeness(a, a) == 1.0


def test_rules_counts_do_not_depend_on_the_first_guess(spark, monkeypatch):
    """Too many buckets are folded, too few are counted again: the same counts, in plain and in wide rows."""
    monkeypatch.setattr(rules, "BUCKETS", 4)
    texts = [(i, " ".join(f"w{(i * 37 + j * j) % 701}" for j in range(60)), "en", "a") for i in range(30)]
    docs, labels = edge(spark, texts), spark.createDataFrame([(3, 1), (8, 1)], "doc_id long, quality int")
    distinct = len({h for r in texts for h in _hashes(r[1])})

    def found(guess):
        monkeypatch.setattr(rules, "GUESS", guess)
        model = rules.ratios(docs, labels)
        return model.buckets, {(r.bucket, r.good, r.raw) for r in model.rows.collect()}

    want = found(64)
    buckets = want[0]
    assert buckets / 2 < 1.1 * distinct / rules.LOAD and 0.9 * distinct / rules.LOAD < buckets
    raw = Counter(h & (buckets - 1) for r in texts for h in _hashes(r[1]))
    good = Counter(h & (buckets - 1) for r in texts if r[0] in (3, 8) for h in _hashes(r[1]))
    assert want[1] == {(b, good[b], n) for b, n in raw.items()}
    assert found(1) == want  # folded
    assert found(1 << 20) == want  # four buckets at first
    monkeypatch.setattr(rules, "HELD", 2 * buckets)
    assert found(0.25) == want  # from plain rows to wide ones


def test_language_with_a_filter_too_large_to_broadcast(spark, sf, monkeypatch):
    """The table of places gives every row the same language and score as the array, NULL and repeated rows included."""
    texts = [(i, t, lang, s) for i, t, lang, s in given(sf)[:150]] + list(ROWS) + list(ROWS)
    docs = edge(spark, texts, clashing=True)
    small = language.learn(docs, slots=1 << 12)
    want = Counter((r.doc_id, r.lang_pred, r.score) for r in language.identify(docs, *small).collect())
    monkeypatch.setattr(language, "HELD", 0)
    large = language.learn(docs, slots=1 << 12)
    assert isinstance(large[1], language.Stored) and large[0] == small[0] and large[1].slots == len(small[1])
    assert Counter((r.doc_id, r.lang_pred, r.score) for r in language.identify(docs, *large).collect()) == want
    assert sum(want.values()) == len(texts) and len({k[1] for k in want}) > 2
    assert language.identify(edge(spark, []), *large).collect() == []
