"""Records, the manifest and phrases against plain versions; ties, missing ids, damage, small blocks."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from tokenizers import Tokenizer

import __spark_entry__ as entry
from barflow.llm import manifest, phrases, records
from tests.llm.tables import ROWS, edge, given


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def test_records_query(spark, sf, library):
    got = {r.doc_id: r for r in entry.queries()["op13_records"](spark, sf).collect()}
    start = 0
    for doc_id, text, _, _ in given(sf):
        ids = library(text)
        assert tuple(got.pop(doc_id)) == (doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert not got


def test_pieces_give_the_same_ids(library):
    encoder = records.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    letters, g = "ab éÿ×÷ĀɐZ 09 \n\n\t\r\x85\xa0 \x1c'.,;:!?-_<|endoftext|>漢😀", np.random.default_rng(3)
    texts = ["".join(g.choice(list(letters), n)) for n in range(400)] + ["don't stop. I'll go,\nthen\n\nEnd  of", " a", "a ", "", " ", "x.\n.y", "<|endoftext|>"]
    for _ in range(2):  # new, then known
        assert [list(struct.unpack(f"<{len(b) // 2}H", b)) for b in encoder.encode(texts)] == [library(t)[:-1] for t in texts]


def test_records_edges(spark, library):
    docs = edge(spark, clashing=True)
    made = records.write(docs, file_bytes=5_000)
    assert made.count() > 3
    got = records.read(made).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((r[0], tuple(library(r[1]))) for r in ROWS)
    in_order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in in_order] == sorted((r[0] for r in ROWS), key=lambda x: (x is None, x or 0))
    assert [r.start for r in in_order] == np.cumsum([0, *[r.n_tokens for r in in_order]])[:-1].tolist()
    turned = records.read_shuffled(made, 7).collect()
    assert [r.turn for r in turned] == sorted(r.turn for r in turned) and [r.start for r in turned] != [r.start for r in in_order]
    assert Counter((r.start, r.doc_id, tuple(r.ids)) for r in turned) == Counter((r.start, r.doc_id, tuple(r.ids)) for r in got)
    assert records.read(records.write(edge(spark, []))).collect() == []


@pytest.mark.parametrize("at", [2, 13, 22, 40, -2])
def test_damaged_files_are_found(spark, tmp_path, at):
    made = records.write(edge(spark, ROWS[:7]).coalesce(1), folder=str(tmp_path))
    path = max(made.collect(), key=lambda r: r.n_bytes).path
    with open(path, "r+b") as f:
        f.seek(at, 0 if at > 0 else 2)
        byte = f.read(1)
        f.seek(-1, 1)
        f.write(bytes([byte[0] ^ 1]))
    with pytest.raises(PythonException, match="broken|no file of records"):
        records.read(made).collect()


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(doc_id, source, lang, n_chars, text):
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def _climb(hashes):
    """The root, and for each node its path of (sibling or None, whether it stands left)."""
    ways, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for way, i in zip(ways, at):
            other = i ^ 1
            way.append((hashes[other] if other < len(hashes) else None, other < i))
        hashes, at = [_h(*hashes[i : i + 2]) for i in range(0, len(hashes), 2)], [i // 2 for i in at]
    return hashes[0], ways


def _manifest(rows):
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        changed = _leaf(doc_id, source, lang, None if n_chars is None else n_chars + 1, text) if hit else None
        groups[lang].append((doc_id is None, doc_id or 0, _leaf(doc_id, source, lang, n_chars, text), changed or "", doc_id))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: _climb([x[2] for x in sorted(groups[lang])]) for lang in langs}
    root, tops = _climb([trees[lang][0] for lang in langs])
    out = []
    for lang, top in zip(langs, tops):
        for (_, _, leaf, changed, doc_id), way in zip(sorted(groups[lang]), trees[lang][1]):
            h = changed or leaf
            for other, left in [*way, *top]:
                h = _h(h) if other is None else _h(other, h) if left else _h(h, other)
            out.append((doc_id, leaf, trees[lang][0], root, _h(*[o for o, _ in [*way, *top] if o]), h, h == root))
    return Counter(out)


def _rows(df):
    made = df.withColumn("folded_root", manifest.folded(manifest.F.coalesce("changed", "leaf"), manifest.F.col("path")))
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.folded_root, r.folded_root == r.root)
                   for r in made.withColumn("proof", manifest.proof(manifest.F.col("path"))).collect())


@pytest.mark.parametrize("levels", [1, 3, 8])
def test_manifest_edges(spark, levels):
    """Several tiers, a last node alone, NULLs, repeated rows, one lang, none."""
    lang = [None, "", "de", "en", "é", "zz"]
    rows = [*ROWS, *[(100 + i, f"t{i % 50}", lang[i * i % 6 if i % 3 else 3], "s") for i in range(75)]]
    full = [(*r, None if r[1] is None else len(r[1])) for r in rows]
    assert _rows(manifest.proofs(edge(spark, rows, clashing=True), levels)) == _manifest(full)
    if levels == 3:
        for few in (ROWS[:1], ROWS[:2], ROWS[8:9] * 3):
            assert _rows(manifest.proofs(edge(spark, few), levels)) == _manifest([(*r, None if r[1] is None else len(r[1])) for r in few])
        assert manifest.proofs(edge(spark, []), levels).collect() == []


def test_manifest_tampering_is_found(spark, sf):
    got = entry.queries()["op12_manifest"](spark, sf).collect()
    for r in got:
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0)


def _collocations(rows, least, longest, most):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(w)
            f[lang].update(w[i : i + k] for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        inside = {(p[i : i + k], a) for p, a in often.items() for k in range(2, len(p)) for i in range(len(p) - k + 1)}
        best = []
        for p, a in often.items():
            if not any((p, b) in inside for b in [a]):
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(best)[:most], 1)]
    return Counter(out)


def test_phrases_equal_plain_counting(spark):
    """Small tries burst and spill all the time; a full filter, stops, ties, NULLs and repeated rows."""
    g = random.Random(4)
    words = ["Ring", "the", "of", "É", "é", "Zö", "a\x0bb", "x y", "z\x1cq", "...", "of,", "the\n", "end.", "\t"]
    texts = [(g.choice([None, "und", "en", "de", ""]), " ".join(g.choices(words, [9, 9, 9, 3, 3, 1, 1, 1, 1, 1, 2, 1, 2, 1], k=g.randint(0, 60)))) for _ in range(300)]
    texts += [("en", "one two three four five six seven " * 30), ("en", None), (None, ""), ("de", ". , !")] + [("fr", "much the same. Much the same")] * 40
    docs = spark.createDataFrame([(i if i % 3 else None, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string").repartition(4)
    docs = docs.withColumn("phrase", docs["lang"]).withColumn("f", docs["lang"]).withColumn("rank", docs["lang"])
    for least, most, held, burst in ((20, 2000, 40, 4), (7, 9, 10**6, 4096)):
        got = phrases.collocations(docs, least, 5, most, held, burst).collect()
        assert Counter(map(tuple, got)) == _collocations(texts, least, 5, most)
    assert phrases.collocations(docs.limit(0)).collect() == []
    few = docs.filter("lang = 'fr'")
    assert Counter(map(tuple, phrases.collocations(few, 41).collect())) == _collocations([x for x in texts if x[0] == "fr"], 41, 5, 2000)


def test_trie_bursts_and_spills_whole_subtrees():
    counter = phrases._Counter(60, 8)
    rows = np.array([[a, b, c] for a in range(5) for b in range(6) for c in range(3)] * 2)
    counter.numbered(pa.array([f"w{i}" for i in range(6)]))
    counter.add("en", list(rows.T))
    trie = counter.tries["en"]
    assert type(trie) is phrases.Trie and trie.size == 90 and len(trie.children) == 5
    runs = [(p, c) for batch in counter.spill() for ps, cs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()) for p, c in zip(ps, cs)]
    assert trie.size <= 30 and len(runs) + trie.size == 90 and {c for _, c in runs} == {2}
    heads = Counter(p.split()[0] for p, _ in runs)
    assert set(heads.values()) == {18}
    rest = [x for batch in counter.spill(True) for x in batch.column(2).to_pylist()]
    assert sum(map(len, rest)) == 90 - len(runs) and all(x == sorted(x) for x in rest)


def test_products_beyond_64_bits(spark):
    score = spark.sql(f"SELECT {phrases.SCORE} AS s FROM VALUES (7000000000000L, 9000000000000000L, 70000000000000L, 80000000000001L) AS t(a, n, l, r)").first().s
    assert score == 1000 * 7000000000000 * 9000000000000000 // (70000000000000 * 80000000000001)
