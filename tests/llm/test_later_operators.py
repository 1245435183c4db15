"""Compression classifier, divergence audit and Merkle manifest against brute force, on odd rows and on the tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from branchlight.llm import compression, divergence, merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Word other " * 30_000
ODD = [
    (1, "One two Two ÉTÉ été", "en", "a", 5),
    (1, "One two Two ÉTÉ été", "en", "a", 5),
    (2, "", "en", "b", 0),
    (3, None, None, None, None),
    (None, "two two one", "en", "b", 3),
    (4, "one\x00two été", "en", "c", 1),
    (5, LONG, "fr", "a", len(LONG)),
    (6, "solo", "fr", "a", 4),
    (9, "ABC:1-", "", "", -4),
    (12, "one two", "en", "a", None),
]


def docs(spark, rows=ODD):
    df = spark.createDataFrame(rows, DOCS)
    clash = ("leaf", "group", "carry", "at", "term", "n", "p", "quality_score", "bucket", "proof")
    return df.select("*", *[F.lit("x").alias(c) for c in clash])


def same_as_sql(spark, sf_dir, name, module):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    found = con.execute(module.ORACLE)
    names = [d[0] for d in found.description]
    got = getattr(module, name)(spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r[c] for c in names)) for r in got.collect())


# Merkle manifest


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def coded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climbed(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def manifest_by_hand(rows):
    groups = defaultdict(list)
    for r in rows:
        leaf = H(coded(r[0]) + coded(r[3]) + coded(r[2]) + coded(r[4]) + coded(r[1]))
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf, r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climbed([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top = climbed([trees[g][-1][0] for g in order])
    found = []
    for g in order:
        for i, (*_, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            steps = []
            for levels, at in ((trees[g], i), (top, order.index(g))):
                for level in levels[:-1]:
                    low = at // 8 * 8
                    steps.append(("".join(level[low:at]), "".join(level[at + 1 : low + 8])))
                    at //= 8
            text, touched = r[1], r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            if touched and text is not None:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            at = H(coded(r[0]) + coded(r[3]) + coded(r[2]) + coded(r[4]) + coded(text))
            for left, right in steps:
                at = H(left + at + right)
            found.append((r[0], leaf, trees[g][-1][0], top[-1][0], H("".join(a + b for a, b in steps)), at, at == top[-1][0]))
    return sorted(map(str, found))


def manifest_rows(spark, df, tmp_path):
    path = str(tmp_path / "documents.parquet")
    df.write.parquet(path)
    return sorted(str(tuple(r)) for r in merkle.op13_merkle_manifest(spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def test_manifest_of_odd_rows(spark, tmp_path):
    assert manifest_rows(spark, docs(spark), tmp_path) == manifest_by_hand(ODD)


def test_manifest_of_nothing_and_of_one(spark, tmp_path):
    assert manifest_rows(spark, docs(spark, []), tmp_path / "a") == []
    assert manifest_rows(spark, docs(spark, ODD[:1]), tmp_path / "b") == manifest_by_hand(ODD[:1])


def test_manifest_is_the_same_by_any_blocks(spark):
    rows = [(i * 7 % 640, f"text {i}", ("de", "en", "en", None)[i % 4] if i < 600 else f"rare{i}", "s", i) for i in range(640)]
    keys = ["group", "key", "leaf", "at", "proof", "subroot", "root"]
    tell = lambda **how: sorted(map(str, merkle.manifest(docs(spark, rows).repartition(5), **how).select(*keys).collect()))
    plain = tell()
    assert tell(heights=(1,)) == plain and tell(heights=(2,), top_nodes=1) == plain
    assert len(plain) == 640


def test_manifest_as_in_sql(spark, sf_dir):
    same_as_sql(spark, sf_dir, "op13_merkle_manifest", merkle)


# Divergence audit


def audit_by_hand(rows, least=3, top=200):
    occ, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        occ[lang, source].update(terms)
        df[lang].update(set(terms))
    found = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        sources = sorted(s for g, s in groups if g == lang)
        count = {s: {t: occ[lang, s][t] for t in kept} for s in sources}
        count[None] = {t: sum(count[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in count.items()}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(-f(p[s][t], p[None][t]), t) for t in kept if count[s][t] and p[s][t] > p[None][t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (v, item) in enumerate(sorted(items, key=lambda x: (x[0], x[1].encode()))[:most], 1):
                    found.append((lang, s, part, item, -v, rank))
    return sorted(map(str, found))


def audit_rows(df, **how):
    return sorted(str(tuple(r)) for r in divergence.audit(df, **how).select("lang", "source", "part", "item", "value", "rank").collect())


def test_divergence_of_odd_rows(spark):
    assert audit_rows(docs(spark)) == audit_by_hand(ODD)
    assert audit_rows(docs(spark), least=1, top=1) == audit_by_hand(ODD, 1, 1)
    assert audit_rows(docs(spark, [])) == []


def test_divergence_without_broadcasts_or_held_counts(spark, monkeypatch):
    want = audit_by_hand(ODD, 1)
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(divergence, "HELD_BYTES", 1)
    assert audit_rows(docs(spark), least=1) == want


def test_divergence_weighs_batches_of_terms(spark, monkeypatch):
    """Pairs are weighed by batch, not term by term in higher-order functions; the same however few terms are taken at once, and exact up to 64 bits."""
    df = spark.createDataFrame([(f"{'a' * (i % 7 + 1)} b {chr(99 + i % 9)} {chr(99 + i % 4)}", f"l{i % 2}", f"s{i % 5}") for i in range(90)], "text string, lang string, source string")
    wide, groups = divergence.wide_terms(df)
    pairs = divergence.pair_divergence(wide, groups)
    assert "lambda" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    want = sorted(map(tuple, pairs.collect()))
    monkeypatch.setattr(divergence, "CELLS", 1)
    assert sorted(map(tuple, divergence.pair_divergence(wide, groups).collect())) == want and len(want) == 40
    rows = spark.createDataFrame([("x", [1, 0], [1_000_000_001, 1])] * 9, "lang string, n array<bigint>, p array<bigint>").coalesce(1)
    got = divergence._weights(rows).groupBy("i", "j").agg({"f": "sum", "terms": "sum"}).collect()
    assert sorted((r["i"], r["j"], r["sum(f)"], r["sum(terms)"]) for r in got) == [(0, 1, 9 * 10**18, 9), (1, 0, 9 * (10**18 // (10**9 + 1)), 9)]


def test_divergence_as_in_sql(spark, sf_dir):
    same_as_sql(spark, sf_dir, "op12_source_divergence", divergence)


# Compression classifier


def test_quality_of_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = compression.op11_compression_quality(spark, sf_dir)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == 1000
    assert {r["doc_id"] for r in got.filter("held_out").collect()} == {i for (i,) in duckdb.sql(f"SELECT doc_id FROM '{sf_dir}/documents.parquet'").fetchall() if zlib.crc32(str(i).encode()) % 3 == 1}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    seen = got.filter("held_out").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in seen) / len(seen) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in seen)


def labelled(spark):
    good, bad = "The river ran past the old mill and the miller sang. ", "BUY!!! $$$ ### NOW!!! %%% "
    texts = [(i, (good if i % 2 else bad) * (1 + i % 7), "en", "s", 1) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    return docs(spark, [*texts, *texts[:9], (None, None, None, None, None)]), labels, good, bad


def test_whole_texts_decide_and_rows_are_judged_alone(spark):
    df, labels, good, bad = labelled(spark)
    model = compression.fit(df, labels)
    clean, junk, mixed, _, none = model.scores([t.encode() if t else None for t in (good * 400, bad * 400, good * 40 + bad * 4000, "", None)])
    assert clean > 0.5 > junk and mixed < clean and 0 <= none <= 1
    assert model.scores([b"", None])[0] == model.scores([b"", None])[1]
    again = compression.fit(df.repartition(3), labels)
    assert again.dictionaries == model.dictionaries and again.scores([good.encode()]) == pytest.approx(model.scores([good.encode()]))
    scored = compression.score_quality(df, model).select("doc_id", "text", "quality_score.score", "leaf").collect()
    assert len(scored) == df.count() and len({r["score"] for r in scored if r["doc_id"] == 3}) == 1
    assert all(r["score"] == pytest.approx(model.scores([r["text"].encode() if r["text"] else None])[0]) for r in scored[:20])


def test_compressed_sizes_by_hand():
    import zstandard

    blocks = [b"alpha beta gamma delta " * 8] * 40
    kept = compression.dictionary(blocks[:2])
    assert kept == (b"".join(blocks[:2]), False)
    other = (b"zzz", False)
    text = b"alpha beta gamma delta " * 100
    sizes = []
    for content, _ in (other, kept):
        c = zstandard.ZstdCompressor(level=compression.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append(sum(len(c.compress(text[i : i + compression.BLOCK])) for i in range(0, len(text), compression.BLOCK)))
    assert compression.measures(text, [other, kept])[0] == pytest.approx((sizes[0] - sizes[1]) / sum(sizes)) and sizes[1] < sizes[0]


def test_without_labels_or_documents(spark):
    df, labels, good, _ = labelled(spark)
    assert compression.fit(df, labels.limit(0)).scores([b"a", None]).tolist() == [0.5, 0.5]
    assert compression.fit(df, labels.filter("quality = 1")).scores([b"a"])[0] > 0.9
    assert compression.score_quality(docs(spark, []), compression.fit(docs(spark, []), labels)).count() == 0


def test_words_of_a_shard_rank_as_its_strings():
    import numpy as np
    from branchlight.llm import suffixdedup

    rng = np.random.default_rng(2)
    for n in (400, 411):
        shard = rng.integers(0, 3, n).astype(np.uint8) * 127
        want = [(bytes(shard) * 2)[i : i + 8] for i in range(n)]
        order = np.argsort(suffixdedup.words_of(shard), kind="stable").tolist()
        assert [want[i] for i in order] == sorted(want)
