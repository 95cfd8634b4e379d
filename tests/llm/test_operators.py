"""Each operator against brute force on a small table with the awkward cases in it."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from barloom.llm import (
    adaptive_scan,
    language_id,
    license_scan,
    packing,
    quality_fm,
    quality_rules,
    simhash,
    token_store,
    tokens,
    toxicity_crf,
    trie_bpe,
)

SF = "/root/testdata/sf0.001"
ODD = [
    None,
    "",
    " \n\t ",
    "one",
    "a b c d e a b c d e f.\nLicensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.",
    "DON'T 's ÄÖß İΣς 日本 語12 <|endoftext|> á ́b x\x1cy ª²",
    "word " * 6000,
    "x" * 9000,
    "Released under the MIT Licence.",
    "nav | bar | nav | bar | one | two | three | four | five | six",
]


@pytest.fixture(scope="module")
def docs(spark):
    """Real documents and odd ones, repeated rows, a NULL id, and columns whose names the operators use inside."""
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = [(100_000 + i, t, None, None, None) for i, t in enumerate([*ODD, ODD[4]])] + [(None, "null id here", "en", "s", 3)]
    odd = spark.createDataFrame(rows, real.schema)
    out = real.limit(60).unionByName(odd)
    for name in ("words", "score", "fp", "bucket", "digest", "rank", "ids", "size", "lines"):
        out = out.withColumn(name, F.lit("clash"))
    return out.cache()


@pytest.fixture(scope="module")
def plain(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


def ids_of(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4")


def duck(docs, sql):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    return sorted(con.sql(sql).fetchall(), key=str)


def same_as_sql(df, docs, sql):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    rel = con.sql(sql)
    got = sorted((tuple(r[c] for c in rel.columns) for r in df.collect()), key=str)
    assert got == sorted(rel.fetchall(), key=str)


def test_quality_rules_match_sql(docs):
    same_as_sql(quality_rules.judge(docs).drop("clean_text"), docs, quality_rules.sql())


def test_repeated_windows_count_each_word_once(spark):
    row = quality_rules.judge(spark.createDataFrame([(1, "a b c d e f a b c d e f x y")], "doc_id long, text string")).first()
    assert (row["n_words"], row["n_repeat_words"], row["base_failed"], row["kept"]) == (14, 12, True, False)


def test_license_scan_matches_sql(docs):
    same_as_sql(license_scan.scan(docs), docs, license_scan.sql())


def test_license_spelling_and_copyright_lines(spark):
    mit = next(t for n, t in license_scan.LICENSES if n == "MIT" and "Permission" in t)
    text = "Copyright (c) 2020 Somebody\n" + mit.upper().replace("SUBLICENSE", "SUB-LICENSE").replace(" ", "  ")
    rows = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r["line"], r["license"]) for r in rows if r["line"] == 0] == [(0, "MIT")]


def test_license_scan_finds_every_spelling_of_the_canonical_form(spark):
    notice = "This work is dedicated to the public{}domain under CC0 1.0."
    texts = [notice.format(gap) for gap in ("-", "  ", "\n", "\t", " - ")] + [f"First.\n{notice.format('-')}\nLast.", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    same_as_sql(license_scan.scan(docs), docs, license_scan.sql())
    rows = license_scan.scan(docs).where("license = 'CC0-1.0'").select("doc_id", "line").collect()
    assert sorted(map(tuple, rows)) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (3, 0), (3, 1), (4, 0), (4, 1), (5, 2)]


def test_license_scan_finds_a_known_text_of_the_caller(spark):
    own = (("Beerware", "As long as you retain this notice you can buy me a beer."),)
    docs = spark.createDataFrame([(1, "Hello.\nAS LONG AS YOU RETAIN THIS NOTICE, you can buy me a beer!")], "doc_id long, text string")
    found = license_scan.scan(docs, license_scan.known_table(spark, own))
    same_as_sql(found, docs, license_scan.sql(licenses=own))
    assert [tuple(r) for r in found.select("line", "license").collect()] == [(2, "Beerware")]


def test_packing_is_gapless_and_whole(docs, plain, tokenizer):
    rows = packing.pack_documents(docs).collect()
    held, seen = defaultdict(list), Counter()
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
        seen[r["doc_id"], r["start"], r["length"], r["ids_crc32"]] += 1
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    want = Counter()
    for doc_id, text in plain:
        ids = np.append(ids_of(tokenizer, text), np.uint32(1)).astype("<u4")
        for k in range(0, len(ids), packing.CAPACITY):
            part = ids[k : k + packing.CAPACITY]
            want[doc_id, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert seen == want
    total = sum(r["length"] for r in rows)
    assert len(held) <= -(-total // packing.CAPACITY) + 1


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece(seed):
    rng = np.random.default_rng(seed)
    counts = Counter(rng.integers(1, 101, 400).tolist()) if seed % 2 else Counter({51: 7, 34: 9, 3: 2, 100: 4, 1: 1})
    used = Counter()
    for pattern, n in packing.plan(dict(counts), 100):
        assert sum(pattern) <= 100 and n > 0
        for x in pattern:
            used[x] += n
    assert used == counts


def slow_fingerprint(text):
    words = simhash.WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(prints, radius=3):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_matches_brute_force(docs, plain):
    kept = sorted((p for p in plain if p[0] is not None), key=lambda p: p[0])
    prints = [slow_fingerprint(t) for _, t in kept]
    want = {kept[i][0]: (f"{prints[i]:016x}", kept[r][0]) for i, r in enumerate(roots_of(prints))}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert {k: v for k, v in got.items() if k is not None} == want
    assert simhash.keep_one(docs).columns == docs.columns


def test_simhash_takes_rows_of_one_id_as_one_document(spark):
    texts = ["first text of its own", "quite another set of words", "nothing like the other two", "a fourth one far away"]
    prints = [slow_fingerprint(t) for t in texts]
    assert all((a ^ b).bit_count() > 3 for k, a in enumerate(prints) for b in prints[:k])
    rows = [(1, texts[0]), (5, texts[0]), (5, texts[1]), (7, texts[1].upper()), (9, texts[2]), (None, texts[2]), (None, texts[3]), (None, texts[3])]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    least = {texts[0]: 1, texts[1]: 1, texts[2]: 9, texts[3]: None}
    want = [(i, f"{slow_fingerprint(t):016x}", least[t.lower()]) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_every_pair_within_the_radius_shares_a_bucket():
    rng = np.random.default_rng(1)
    masks = [m & (2**64 - 1) for m in simhash.covering_masks()]
    for _ in range(2000):
        flips = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(m & flips == 0 for m in masks)
    child = simhash._children(simhash.covering_masks()[4], 3)
    assert all(any((c & (2**64 - 1)) & (1 << b) == 0 for c in child) for b in range(64) if not simhash.covering_masks()[4] >> b & 1)


def test_buckets_beyond_the_block_are_split_without_loss(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40).tolist()
    prints = sorted({b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 60, (12, 2))})
    links = simhash.near_links(spark.createDataFrame([(p,) for p in prints], "fp long"), block=3).collect()
    joined = {p: p for p in prints}

    def find(x):
        while joined[x] != x:
            x = joined[x]
        return x

    for r in links:
        assert (r["a"] ^ r["b"]).bit_count() <= 3
        a, b = find(r["a"]), find(r["b"])
        joined[max(a, b)] = min(a, b)
    assert [find(p) for p in prints] == [prints[k] for k in roots_of(prints)]


def test_buckets_stay_whole_when_their_join_becomes_a_broadcast(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63 - 1, 3_000).tolist()
    prints = sorted({b ^ (1 << int(i)) for b in base for i in rng.integers(0, 60, 2)} | set(base))
    names = ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n, None) for n in names]
    try:
        for name, value in zip(names, ("16", "-1", "10MB"), strict=True):  # a sorted join by plan, a broadcast once sizes are known
            spark.conf.set(name, value)
        distinct = spark.createDataFrame([(p,) for p in prints], "fp long").repartition(7)
        links = {frozenset((r["a"], r["b"])) for r in simhash.near_links(distinct).collect()}
    finally:
        for name, value in zip(names, before, strict=True):
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    joined = {p: p for p in prints}

    def find(x):
        while joined[x] != x:
            x = joined[x]
        return x

    for a, b in map(tuple, links):
        a, b = find(a), find(b)
        joined[max(a, b)] = min(a, b)
    want = {find(b) for b in base}
    assert len(want) == len(base) and all(find(p) in want for p in prints)


def test_token_store_round_trip(spark, docs, plain, tokenizer, tmp_path):
    manifest = token_store.write_store(docs, str(tmp_path / "store"), tokens.vocabulary_path())
    rows = sorted(token_store.read_store(spark, manifest).collect(), key=lambda r: r["start"])
    order = [r["doc_id"] for r in rows]
    assert order == sorted(order, key=lambda d: (d is not None, d))
    want = sorted((d or -1, (np.append(ids_of(tokenizer, t), np.uint32(1)).astype("<u4")).tobytes()) for d, t in plain)
    assert sorted((r["doc_id"] or -1, bytes(r["ids"])) for r in rows) == want
    starts = np.cumsum([0] + [len(r["ids"]) // 4 for r in rows])[:-1].tolist()
    assert [r["start"] for r in rows] == starts
    some = token_store.read_store(spark, manifest, wanted={100_005}).collect()
    assert [r["doc_id"] for r in some] == [100_005]


def test_store_files_are_plain_zstandard_and_damage_is_seen(spark, docs, tmp_path):
    import zstandard

    manifest = token_store.write_store(docs, str(tmp_path / "store"), tokens.vocabulary_path())
    path = manifest[0][1]
    raw = bytearray(open(path, "rb").read())
    assert struct.unpack("<I", raw[-4:])[0] == token_store.SEEKABLE_MAGIC
    one = token_store.SeekableFile(path)
    whole = zstandard.ZstdDecompressor().stream_reader(bytes(raw), read_across_frames=True).read()
    assert whole == b"".join(one.read(i) for i in range(len(one.doc_ids)))
    raw[len(one.read(0)) and 10] ^= 0xFF
    open(path, "wb").write(raw)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_store.SeekableFile(path).read(0)


def test_trie_encoding_and_decoding(docs, plain, tokenizer):
    rows = sorted(trie_bpe.digests(docs).collect(), key=lambda r: (r["doc_id"] or -1, r["ids_sha256"]))
    want = []
    for doc_id, text in plain:
        ids = ids_of(tokenizer, text)
        decoded = tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert [tuple(r) for r in rows] == sorted(want, key=lambda r: (r[0] or -1, r[2]))


def test_chain_equals_plain_forward_backward():
    chain = toxicity_crf.Chain({"bad": 9.0, "ba*": 1.0}, -4.0, (0.3, -0.2, 0.1, 0.9))
    weights = [0, 0, 10.0, 0, 0, 0, 1.0, 3.0, 0]
    at = [i for i, w in enumerate(weights) if w]
    got = chain.marginals(at, [weights[i] for i in at], len(weights))
    moves = np.array(chain.moves).reshape(2, 2)
    total, marked = 0.0, np.zeros(len(weights))
    for code in range(1 << len(weights)):
        path = [code >> t & 1 for t in range(len(weights))]
        s = sum(weights[t] - 4.0 for t, x in enumerate(path) if x) + sum(moves[a, b] for a, b in zip(path, path[1:]))
        total += np.exp(s)
        marked += np.exp(s) * np.array(path)
    assert np.allclose(got, (marked / total)[at])


def held_out(df, labels, column):
    rows = df.where("held_out").join(labels.where(F.col(column).isNotNull()), "doc_id").select("predicted", column).collect()
    return np.array([(r[0], r[1]) for r in rows])


def test_quality_classifier_on_held_out_labels(spark):
    got = held_out(quality_fm.classify(spark, "/root/testdata/sf0.01"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "quality")
    assert (got[:, 0] == got[:, 1]).mean() >= 0.93


def test_toxicity_on_held_out_labels(spark):
    got = held_out(toxicity_crf.classify(spark, "/root/testdata/sf0.01"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "toxic")
    assert (got[:, 0] == got[:, 1]).mean() >= 0.93
    assert got[got[:, 1] == 0][:, 0].mean() <= 0.02


def test_linear_time_identity():
    rng = np.random.default_rng(3)
    m = quality_fm.Machine(0.1, rng.normal(size=9), rng.normal(size=(9, 4)))
    index, value = np.array([0, 3, 4, 8]), rng.normal(size=4)
    slow = 0.1 + m.linear[index] @ value
    for i in range(4):
        for j in range(i + 1, 4):
            slow += m.factors[index[i]] @ m.factors[index[j]] * value[i] * value[j]
    assert np.isclose(m.margin(index, value), slow)


def test_language_on_held_out_documents(spark):
    rows = language_id.identify_all(spark, "/root/testdata/sf0.01").where("held_out")
    langs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = [(r["lang_pred"], r["lang"]) for r in rows.join(langs, "doc_id").collect()]
    assert np.mean([a == b for a, b in got]) >= 0.98


def test_models_on_odd_rows_and_empty_tables(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for rows in (docs, docs.limit(0)):
        n = rows.count()
        for part in (labels, labels.limit(0)):
            machine, chain = quality_fm.learn(rows, part), toxicity_crf.learn(rows, part)
            assert quality_fm.score(rows, machine).count() == n
            assert toxicity_crf.score(rows, chain).count() == n
            assert quality_fm.keep(rows, machine).columns == rows.columns
            assert toxicity_crf.keep(rows, chain).columns == rows.columns
        found = language_id.identify(rows, language_id.learn(rows)).collect()
        assert len(found) == n
        assert all(r["lang_pred"] == "und" for r in found if r["doc_id"] in (100_000, 100_001, 100_002))


def test_learning_takes_one_row_of_an_id(spark, docs):
    """An id on many rows sends one of them to the driver."""
    many = docs.limit(0).select("doc_id", "text").unionByName(
        spark.range(2000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    )
    labels = spark.createDataFrame([(7, 1, 1), (8, 0, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    taken = toxicity_crf._labelled(many, labels, 5).collect()
    assert [r["doc_id"] for r in taken] == [7] and taken[0]["toxic"] == 1
    again = toxicity_crf._labelled(many.repartition(5), labels, 5).collect()
    assert [r["text"] for r in again] == [r["text"] for r in taken]


def test_spans_are_places_in_the_text_as_given():
    chain = toxicity_crf.Chain({"bad": 30.0}, -4.0, (0.0, 0.0, 0.0, 0.0))
    for text, want in (("İİ bad", [(3, 6)]), ("BAD İ bad!", [(0, 3), (6, 9)]), ("a bad", [(2, 5)]), ("", [])):
        _, places, p = chain.score(text)
        assert chain.spans(text, places, p) == want
        assert [text[a:b].lower() for a, b in chain.spans(text, places, p)] == ["bad"] * len(want)


def plain_trigrams(text):
    """Byte trigrams hashed one after another with plain integers."""
    raw = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in f" {text.lower()} ".encode())
    out = [0] * language_id.DIMENSION
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        h = a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D
        out[((h & 0xFFFFFFFF) * 0x27D4EB2F & 0xFFFFFFFF) >> 20] += 1
    return out


def test_language_equals_a_plain_computation(spark, monkeypatch):
    texts = ["the dog and the cat", "der Hund und die Katze", "de hond en de kat", "le chien et le chat", "el perro y el gato", "Ünï x 1!", "..", "", None]
    langs = ["en", "de", "nl", "fr", "es", None, None, None, None]
    rows = [(i, t, lang) for i, (t, lang) in enumerate(zip(texts * 4, langs * 4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    assert set(model.families) == {"germanic", "romance"}
    for row in language_id.identify(docs, model).collect():
        text = rows[row["doc_id"]][1]
        if not text or not any(c.isalpha() for c in text):
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
            continue
        counts = plain_trigrams(text)
        x = [(c / sum(counts)) ** 0.5 for c in counts] + [1.0]
        dot = lambda w: sum(a * b for a, b in zip(x, w))
        margins = {f: dot(w) for f, w in model.family.items()}
        family = max(sorted(margins), key=margins.get)
        sure = 1 / sum(np.exp(3 * (m - margins[family])) for m in margins.values())
        votes = dict.fromkeys(model.families[family], 0.0)
        for (a, b), w in model.pairs.items():
            if a in votes and b in votes:
                votes[a] += 1 / (1 + np.exp(-3 * dot(w)))
                votes[b] += 1 / (1 + np.exp(3 * dot(w)))
        best = max(votes, key=lambda name: (votes[name], name))
        assert row["lang_pred"] == best
        assert np.isclose(row["score"], sure * votes[best] / (len(votes) - 1), rtol=1e-6)
    monkeypatch.setattr(language_id, "CHUNK", 5)
    assert language_id.trigrams("über the hill").tolist() == plain_trigrams("über the hill")


def test_empty_tables(spark, docs, tmp_path):
    none = docs.limit(0)
    assert quality_rules.judge(none).count() == 0
    assert license_scan.scan(none).count() == 0
    assert packing.pack_documents(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert token_store.read_store(spark, token_store.write_store(none, str(tmp_path / "s"), tokens.vocabulary_path())).count() == 0
    assert trie_bpe.digests(none).count() == 0
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert adaptive_scan.nearest(empty).count() == 0


def test_neighbours_reach_the_recall_and_keep_odd_vectors_out(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    nan, inf = float("nan"), float("inf")
    odd = [[0.0] * 64, None, [None] + [1.0] * 63, [nan] * 64, [inf] + [1.0] * 63, [1.0, 2.0]]
    extra = spark.createDataFrame([(1_000_000 + 20 * i, v, 0) for i, v in enumerate(odd)], rows.schema)
    all_rows = rows.unionByName(extra).withColumn("list", F.lit("clash"))
    got = defaultdict(list)
    for r in adaptive_scan.nearest(all_rows).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    table = rows.toArrow()
    ids, x = table["vec_id"].to_numpy(), np.array(table["embedding"].to_pylist(), float)
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        hits += len({v for v, _ in found} & set(ids[best].tolist()))
        assert len(found) == 20
        assert np.allclose([v for _, v in found], [s[ids == i][0] for i, _ in found], rtol=1e-12)
    assert hits >= 0.9 * 20 * len(got)


def test_few_candidates_are_all_returned(spark):
    rows = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(5)] + [(0, [1.0, 1.0])], "vec_id long, embedding array<float>")
    found = [(r["rank"], r["vec_id"]) for r in adaptive_scan.nearest(rows).where("query_id = 0").orderBy("rank").collect()]
    assert {v for _, v in found} == {1, 2, 3, 4}


def test_neighbours_of_mixed_lengths(spark):
    """Queries whose usual length is not the candidates' are left out; the others find their neighbours."""
    rows = [(i, [1.0 + i, 2.0]) for i in range(1, 20)] + [(20 * i, [1.0, 2.0, 3.0]) for i in range(1, 4)] + [(400, [2.0, 1.0])]
    found = adaptive_scan.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"])] == [
        (400, 1, 19, 42.0), (400, 2, 18, 40.0), (400, 3, 17, 38.0),
    ]


def test_scan_loses_no_point_of_its_list(monkeypatch):
    """Queries compared together find what brute force finds, and no point beyond their reach is handed on."""
    monkeypatch.setattr(adaptive_scan, "GROUP", 7)
    monkeypatch.setattr(adaptive_scan, "STEP", 50)
    rng = np.random.default_rng(3)
    for scale in (1.0, 1e30, 1e-30):
        x = rng.normal(size=(400, 40)) * scale
        x[11] = x[10]
        ids = np.arange(400) * 3
        ids[21] = ids[20]
        index = adaptive_scan.Index(ids, x, float(np.sqrt((x * x).sum(axis=1).max())), len(x), 5)
        asked, lists = ids[:20], [np.arange(len(index.centroids))] * 20
        scores = x[:20] @ x.T
        scores[asked[:, None] == ids[None]] = -np.inf
        want = [ids[np.lexsort((ids, -s))[:5]].tolist() for s in scores]
        reach = index.reach(asked, x[:20], lists, 5)
        for r in (reach, np.full(20, np.inf)):
            q, v, s = adaptive_scan.scan(index, ids, x, asked, x[:20], r, 5)
            for k in range(20):
                assert [i for i, a in zip(v.tolist(), q.tolist(), strict=True) if a == asked[k]] == want[k]
        worst = np.argsort(scores, axis=1)[:, :100]
        far = np.concatenate([worst[:1].ravel(), [0]])
        q, v, s = adaptive_scan.scan(index, ids[far], x[far], asked[:1], x[:1], reach[:1], 5)
        assert len(q) == 0


def test_neighbours_of_all_lists_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(adaptive_scan.Index, "_calibrate", lambda self, *rest: len(self.centroids))
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    table = rows.toArrow()
    ids, x = table["vec_id"].to_numpy(), np.array(table["embedding"].to_pylist(), float)
    got = defaultdict(list)
    for r in adaptive_scan.nearest(rows).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        assert got[q] == ids[np.lexsort((ids, -s))[:20]].tolist()
