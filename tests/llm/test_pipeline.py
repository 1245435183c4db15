"""The pipeline's stages on the smallest tables."""

import re
from collections import Counter

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from branchlight.llm import langid, licenses, mixing, simhash
from branchlight.llm import queries as llm

from .test_operators import components_brute, leak_brute, phrases_brute, secrets_brute, simhash_brute, similar_brute, texts

#: Columns of documents with names that stages use for themselves.
CLASHING = ("language", "near", "component", "leak", "hash", "id", "same", "spans", "mix", "bits", "u", "found", "parts")


def test_stages(spark, sf_dir, tmp_path):
    docs = first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == first.columns
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] / 2
    ids = [r[0] for r in docs.select("doc_id").collect()]
    assert len(ids) == len(set(ids))


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names} >= {f"op{i}" for i in range(1, 11)}


@pytest.mark.parametrize("name", ["op1_quality_rules", "op3_license_scan", "op7_mixing", "op8_language_id", "op10_decontaminate"])
def test_whole_table(spark, sf_dir, name):
    got = __spark_entry__.queries()[name](spark, sf_dir)
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = db.execute(llm.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    got = __spark_entry__.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(found.fetchall(), key=repr)


@pytest.fixture(scope="module")
def odd(spark, sf_dir):
    """Nulls, empty and long texts, ties, repeated rows and clashing columns among documents of known languages."""
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(None if i is None else i + 10_000, t, "en" if i else None, None, len(t or "")) for i, t in texts()]
    mixed = real.select("doc_id", "text", "lang", "source", "n_chars").limit(60).unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    return mixed.withColumns({c: F.lit(c) for c in CLASHING})


def brute_kept(docs, kept):
    """Rows that a stage should leave, as (doc_id, text)."""
    return Counter((r["doc_id"], r["text"]) for r in docs if kept(r))


def test_stages_on_odd_rows(spark, sf_dir, odd, tmp_path):
    docs = odd
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        got = stage(spark, docs, sf_dir)
        if k < 4:
            assert got.columns == odd.columns
        got.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        assert rows and all(r[c] == c for r in rows for c in CLASHING)
        have = Counter((r["doc_id"], r["text"]) for r in rows)
        if name == "language ID":
            assert have == brute_kept(before, lambda r: langid.has_letter(langid.folded(r["text"])))
        elif name == "SimHash near-dedup":
            prints = {r["text"]: simhash_brute(r["text"]) for r in before}
            find = components_brute(list(prints.values()), similar_brute([(r["doc_id"], r["text"]) for r in before]))
            least = {}
            for r in before:
                c = find(prints[r["text"]])
                least[c] = min((x for x in (least.get(c), r["doc_id"]) if x is not None), default=None)
            want = {(prints[r["text"]], r["doc_id"]) for r in before if least[find(prints[r["text"]])] == r["doc_id"]}
            assert {(prints[t], i) for i, t in have} == want and max(have.values()) == 1
        elif name == "benchmark decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
            cut = {r["text"] for r in before}
            found = {t: leak_fast(t, items) for t in cut}
            assert have == brute_kept(before, lambda r: not found[r["text"]])
        elif name == "secret scans":
            assert len(rows) == len(before) and Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in before)
            assert not any(secrets_brute(r["text"]) for r in rows) and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
            clean = {r["text"] for r in before if not secrets_brute(r["text"])}
            assert sum(r["text"] in clean for r in rows) >= 0.9 * sum(r["text"] in clean for r in before)
        else:
            assert all(r["n_copies"] > 0 and r["rate"] >= 0 and abs(r["p_high"] + r["p_low"] + r["p_toxic"] - 1) < 1e-9 for r in rows)


def leak_fast(text, items, window=10):
    """Whether a window of an item stands in the text, words joined by blanks."""
    n, hit, _ = leak_brute(text, [], window)
    cut = lambda t: leak_words(t)
    said = " " + " ".join(cut(text)) + " "
    for _, item in items:
        w = cut(item)
        m = min(window, len(w))
        if m and any(f" {' '.join(w[i : i + m])} " in said for i in range(len(w) - m + 1)):
            return True
    return False


def leak_words(t):
    import re

    return [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())]


def test_stages_on_empty_tables(spark, sf_dir, odd):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), sf_dir).count() == 0


def test_mixing_stage_draws_by_rate(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rates = {r["doc_id"]: r["mix"]["rate"] for r in mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "mix").collect()}
    got = {r["doc_id"]: (r["rate"], r["n_copies"]) for r in corpus_pipeline.source_mixing(spark, docs, sf_dir).collect()}
    assert all(rate == rates[i] and int(rate) <= n <= int(rate) + 1 for i, (rate, n) in got.items())
    assert all(rates[i] < 1 for i in rates if i not in got)


def test_near_duplicates_of_the_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    prints = {i: simhash_brute(t) for i, t in rows}
    find = components_brute(list(prints.values()))
    least = {}
    for i, p in prints.items():
        least[find(p)] = min(i, least.get(find(p), i))
    got = simhash.op4_simhash_near_dedup(spark, sf_dir).collect()
    assert {tuple(r) for r in got} == {(i, f"{p:016x}", least[find(p)]) for i, p in prints.items()} and len(got) == len(rows)


def test_languages_of_the_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    refs = langid.reference_texts(docs)
    got = {r["doc_id"]: r for r in langid.op8_language_id(spark, sf_dir).collect()}
    assert len(got) == docs.count() and {r["lang_pred"] for r in got.values()} <= {*refs, langid.UNDETERMINED}
    wrong = 0
    for r in docs.filter("length(text) < 700").collect():
        data = langid.folded(r["text"])
        counts = {k: phrases_brute(data, refs[k], langid.BLOCK) for k in sorted(refs)}
        best = min(counts, key=counts.get)
        assert got[r["doc_id"]]["lang_pred"] == (best if langid.has_letter(data) else langid.UNDETERMINED)
        wrong += r["lang"] is not None and got[r["doc_id"]]["held_out"] and best != r["lang"]
    assert wrong <= 1


SHIPPED = {
    "MIT": "Copyright (c) 2020 Someone\n\n{0}\n\nTHE SOFTWARE IS PROVIDED AS IS.",
    "Apache-2.0": "/*\n * {0}\n */\nint main() {{ return 0; }}",
    "BSD-3-Clause": "Copyright 2019.\n\n{0}\n\nAll of it.",
    "GPL-3.0-or-later": "{0}\nimport os",
    "MPL-2.0": "// {0}",
}


@pytest.mark.parametrize("name", sorted(SHIPPED))
@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_licenses_as_shipped(name, mark):
    import textwrap

    notice = licenses.NOTICES[name][-1]
    # Paragraphs apart, lines wrapped, each behind a comment mark.
    parts = notice.replace(": 1.", ":\n\n1.").replace(" 2. Redist", "\n\n2. Redist").replace(" 3. Neither", "\n\n3. Neither").replace("conditions: The", "conditions:\n\nThe").split("\n\n")
    body = "\n\n".join(textwrap.fill(x, 60) for x in parts)
    text = SHIPPED[name].format("\n".join((mark + line).rstrip() for line in body.split("\n")))
    assert [x[0] for x in licenses.Scanner().scan(text)] == [name]


@pytest.mark.parametrize("text", ["Permission to land was granted, free of charge, to any person.", "The license of the redistribution is a permission in free software circles.", "Apache trees, Version 2.0, are licensed by nobody; GNU is a General Public animal."])
def test_license_near_misses(text):
    assert licenses.Scanner().scan(text) == []


def test_licenses_of_the_table_by_plain_search(spark, sf_dir):
    """The registered query names what a search for the notices' words, one after the other, finds in whole texts of any length."""
    wanted = {name: [" ".join(licenses.words_of(f)) for f in forms] for name, forms in licenses.NOTICES.items()}

    def plain(text):
        have = f" {' '.join(re.findall(r'[a-z0-9]+(?:[.-][a-z0-9]+)*', (text or '').lower()))} "
        return sorted(n for n, forms in wanted.items() if any(f" {f} " in have for f in forms))

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: [x for x in r["licenses"].split(",") if x] for r in licenses.op3_license_scan(spark, sf_dir).collect()}
    assert got == {k: plain(t) for k, t in texts.items()} and any(got.values())


GPL3 = licenses.NOTICES["GPL-3.0-or-later"][0]
BSD2 = licenses.NOTICES["BSD-2-Clause"][0]


@pytest.mark.parametrize(
    ("text", "names"),
    [
        (GPL3.replace("General Public", "Affero General Public"), ["AGPL-3.0-or-later"]),
        (licenses.NOTICES["LGPL-2.1-or-later"][0], ["LGPL-2.1-or-later"]),
        (licenses.NOTICES["GPL-2.0-or-later"][0].replace("General", "Library General"), []),
        ("Licensed under the Apache License, Version 1.1.", []),
        ("Licensed under the Eclipse Public License, Version 2.0.", []),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0-only"]),
        ("This work is licensed under the GNU General Public License, version 2 or any later version.", []),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", []),
        ("Licensed under CC BY 3.0.", ["CC-BY-3.0"]),
        ("Licensed under CC BY-ND 4.0.", ["CC-BY-ND-4.0"]),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", ["CC-BY-NC-SA-4.0"]),
        ("Licensed under CC BY-NC 2.5.", []),
        ("Released under the BSD License.", []),
        (licenses.NOTICES["MPL-2.0"][0].replace("2.0", "1.1"), []),
        ("This is not Released under the MIT License.", []),
        ("Do not. Released under the MIT License.", ["MIT"]),
        ("This library is released under the MIT License, by Ann.", ["MIT"]),
        (BSD2 + " 3. Neither the name of Foo nor any of its employees may ever be named in advertising.", []),
        (BSD2 + " THIS SOFTWARE IS PROVIDED AS IS.", ["BSD-2-Clause"]),
    ],
)
def test_relatives_are_told_apart(text, names):
    assert [x[0] for x in licenses.Scanner().scan(text)] == names


def test_size_reductions_rank_the_notices(monkeypatch):
    s = licenses.Scanner()
    words = licenses.words_of(GPL3)
    names = {s.templates[i][0] for i, *_ in s.winners(words)}
    assert {"GPL-3.0-or-later"} <= names and names <= {"GPL-3.0-or-later", "AGPL-3.0-or-later", "LGPL-3.0-or-later", "GPL-2.0-or-later", "LGPL-2.1-or-later", "GPL-2.0-only"}
    monkeypatch.setattr(s, "gain", lambda window, template: 0.0)
    assert s.scan(GPL3) == []


def test_near_dedup_sends_a_text_to_one_python_worker_for_its_sketch(spark, monkeypatch):
    """Fingerprint and bands of a text come from one function: no task has a text in two workers in a row."""
    from branchlight.llm import simhash

    seen = []
    monkeypatch.setattr(simhash, "similar_links", lambda docs, prints, doc_id, text: seen.append(prints) or prints.selectExpr("u", "u as v"))
    whole = type(spark.range(1)).checkpoint
    plans = []
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda self, *a: plans.append(self._jdf.queryExecution().optimizedPlan().toString()) or whole(self, *a))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, None), (3, "a b c d e f")], "doc_id long, text string")
    assert simhash.near_duplicates(docs, similar=True).count() == 3
    assert plans[0].count("ArrowEvalPython") == 1
    assert {(r["u"], r["first"], len(r["bands"])) for r in seen[0].collect()} == {(0, 2, 0), (simhash.with_fingerprint(docs.limit(1), into="u").first()["u"], 1, simhash.BANDS)}
