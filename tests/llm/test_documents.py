"""Quality rules, line dedup, n-gram join and the pipeline against brute force and edge cases."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sablegrid.llm import flat, jaccard, langid, linededup, quality, session

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def made(seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", ".", "#", "A"]) for _ in range(n))
    base = ["\n".join(text(rng.randint(1, 20)) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    near = []
    for t in base[:25]:
        for _ in range(rng.randint(1, 4)):
            w = t.split(" ")
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "x" * rng.randint(1, 3)
            near.append(" ".join(w))
    passage = "\n".join(text(6) for _ in range(4))
    joined = [t + "\n" + passage + "\n" + text(5) for t in base[30:45]]
    odd = [None, "", " \n\t ", "one", "one two three four", "ONE two three FOUR", "a b c d e", "A b c d e", "x " * 5000, "\n\n\na\n\n", "é ü\x0bß\x0cd\re f", base[0], base[0], "a\x1cb c d e f g"]
    boiler = ["All rights reserved by us.\n" + text(60) for _ in range(80)] + ["\n".join(["All rights reserved by us."] * 14 + [text(12)]) for _ in range(3)]
    return base + near + joined + odd + boiler


@pytest.fixture(scope="module")
def docs(spark):
    texts = made()
    rows = [(i, t, "en", None if i % 17 == 0 else f"s{i % 2}", 0, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, n long").repartition(6)


def duck(docs, sql):
    connection = duckdb.connect()
    connection.register("documents", docs.select("doc_id", "text", "source").toPandas())
    result = connection.sql(sql)
    return result.columns, result.fetchall()


def same(df, docs, sql):
    columns, expected = duck(docs, sql)
    found = [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, expected))


def test_quality_equals_sql_and_definition(docs):
    found = quality.line_quality(docs)
    same(found, docs, quality.SQL)
    by_id = {r.doc_id: r for r in found.collect()}
    for r in docs.collect():
        words = WORD.findall(r.text or "")
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(windows)
        repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        q = by_id[r.doc_id]
        assert (q.n_words, q.word_chars, q.n_repeat_words) == (len(words), sum(map(len, words)), len(repeated))
        assert q.n_dup_lines == len(lines) - len(set(lines)) and q.n_symbols == len(re.findall(r"[#*$%&|<>]", r.text or ""))
        assert q.base_failed == (len(words) < 50 or 100 * len(repeated) > 50 * len(words)) and not (q.base_failed and q.kept)
    boiler = [r for r in docs.collect() if "All rights" in (r.text or "")]  # 83 at two hosts and without one
    assert all(by_id[r.doc_id].n_removed_words > 0 for r in boiler)
    assert all(by_id[r.doc_id].kept == (r.text.count("All rights") == 1) or by_id[r.doc_id].base_failed for r in boiler)


def test_quality_removes_frequent_lines(docs):
    kept = quality.line_quality(docs, keep=True)
    assert kept.columns[: len(docs.columns)] == docs.columns
    assert kept.where("text like '%All rights reserved%'").count() == 0
    assert kept.where("text is null").count() == 1 and kept.count() == docs.count()


def test_line_dedup_equals_sql(docs):
    same(linededup.dedup_lines(docs), docs, linededup.SQL)


def test_line_dedup_keeps_first_and_odd_rows(spark):
    rows = [(2, "a\nb\nc\nd"), (1, "x\na\nb\nc"), (3, "b\n\nc\n \nd\nq"), (None, "a\nb\nc"), (4, None), (5, ""), (6, "k\nk\nk\nk\nk"), (7, "a\nb"), (8, "r\ns\nt"), (8, "r\ns\nt")]
    found = {(r.doc_id, r.text, r.n_removed_lines) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(None, "a\nb\nc", 0), (1, "x", 3), (2, "d", 3), (3, "\n \nq", 3), (4, None, 0), (5, "", 0), (6, "k", 4), (7, "a\nb", 0), (8, "r\ns\nt", 0)}
    assert linededup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_jaccard_equals_sql(docs):
    same(jaccard.jaccard_components(docs), docs, jaccard.SQL)


@pytest.mark.parametrize("boundary", [0, 20, 10_000])
def test_jaccard_boundary_changes_nothing(docs, boundary, monkeypatch):
    monkeypatch.setattr(jaccard, "_boundary", lambda sets: boundary)
    same(jaccard.jaccard_components(docs), docs, jaccard.SQL)


def linked_components(texts, percent, words=5):
    """Component of every text by comparing all pairs."""
    sets = []
    for t in texts:
        w = [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in WORD.findall(t or "")]
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


@pytest.fixture(scope="module")
def crowd(spark):
    """Copies of a few texts with more and more changes, many of them near the limit, and short texts."""
    rng = random.Random(11)
    texts = []
    for base in ([f"b{k}w{i}" for i in range(n)] for k, n in enumerate((90, 40, 400))):
        for _ in range(60):
            w = list(base)
            for _ in range(rng.randint(0, len(w) // 14)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(40)}"
            texts.append(" ".join(w))
    texts += ["a b c d e f", "a b c d e", "b c d e f", "a b c d e f g", "q r s t u v", "q r s t u", "x y", "x y z", "", None]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)


@pytest.mark.parametrize(("way", "percent"), [("rounds", 50), ("rounds", 90), ("scans", 50), ("scans", 75), ("light", 75), ("heavy", 75)])
def test_jaccard_loses_no_link(crowd, way, percent, monkeypatch):
    texts, table = crowd
    if way == "scans":  # no pivots, lists in many blocks, few offers a scan
        monkeypatch.setattr(jaccard, "_with_one", lambda entries, turn, percent: entries.selectExpr("doc as a", "doc as b").limit(0))
        for name, value in (("LIST_BLOCK", 7), ("OFFERS", 1), ("MORE_OFFERS", 2)):
            monkeypatch.setattr(jaccard, name, value)
    elif way != "rounds":
        monkeypatch.setattr(jaccard, "_boundary", lambda sets: 10_000 if way == "light" else 0)
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_components(table, percent=percent).collect()}
    assert found == dict(enumerate(linked_components(texts, percent)))


def test_jaccard_odd_rows(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "A B C D E F"), (4, None), (5, ""), (6, "q"), (7, "Q")]
    found = sorted(map(tuple, jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert found == sorted([(None, 2, None), (3, 2, 3), (3, 2, 3), (9, 2, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6)], key=repr)
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pipeline_stages_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    states = [docs]
    for name, step in corpus_pipeline.STAGES[:-1]:
        states.append(session.stage(step(spark, states[-1], sf_dir), "test"))
        assert states[-1].columns == docs.columns and 0 < states[-1].count() <= states[-2].count(), name
    text_of = [{r.doc_id: r.text for r in s.collect()} for s in states]
    # language: what goes has no letters, or no language with half of them
    told = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert text_of[1] == {i: t for i, t in text_of[0].items() if told[i].lang_pred != "und" and told[i].score >= corpus_pipeline.LEAST_SCORE}
    # quality: the kept ones of the SQL; texts change only where lines were removed
    columns, rows = duck(states[1], quality.SQL)
    judged = {r[columns.index("doc_id")]: dict(zip(columns, r, strict=True)) for r in rows}
    assert set(text_of[2]) == {i for i, j in judged.items() if j["kept"]}
    for i, t in text_of[2].items():
        assert len(WORD.findall(text_of[1][i])) - len(WORD.findall(t)) == judged[i]["n_removed_words"]
        assert set(t.split("\n")) <= set(text_of[1][i].split("\n"))
    # line dedup: the SQL's texts, without blank ones
    columns, rows = duck(states[2], linededup.SQL)
    assert text_of[3] == {i: t for i, t in ((r[columns.index("doc_id")], r[columns.index("text")]) for r in rows) if t is not None and WORD.search(t)}
    # near copies: one of each component of the SQL
    columns, rows = duck(states[3], jaccard.SQL)
    assert set(text_of[4]) == {r[columns.index("component_id")] for r in rows} and all(text_of[3][i] == t for i, t in text_of[4].items())
    # packing: all ids of the library, without a gap
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = corpus_pipeline.STAGES[-1][1](spark, states[-1], sf_dir).collect()
    lengths = Counter()
    for r in packed:
        lengths[r.doc_id] += r.length
    assert lengths == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in text_of[4].items()}
    ends = sorted((r.sequence_id * 4096 + r.offset, r.length) for r in packed)
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False)) and ends[0][0] == 0


def test_pipeline_dedup_of_null_and_repeated_ids(spark):
    a, b, c = ("\n".join(f"{x}{k} {x}{k + 1} word{k}" for k in range(40)) for x in "abc")
    near = a.replace("word39", "other")
    rows = [(None, a), (None, near), (7, near), (7, near), (7, b), (3, b), (9, "short one"), (None, c), (None, c), (None, "alone here"), (4, None), (None, "")]
    found = corpus_pipeline.dedup_documents(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    expected = [(7, near), (3, b), (9, "short one"), (None, c), (None, "alone here"), (4, None), (None, "")]
    assert found.columns == ["doc_id", "text"] and sorted(map(tuple, found.collect()), key=repr) == sorted(expected, key=repr)


def test_quality_of_odd_tables(spark):
    schema = "doc_id long, text string, source string, _q_x int, kept boolean"
    assert quality.line_quality(spark.createDataFrame([], schema)).collect() == []
    assert quality.line_quality(spark.createDataFrame([], schema), keep=True).collect() == []
    long = "\n".join(f"line {chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)} of many" for k in range(9000))
    rows = [(None, "a b\nfoot", "h"), (None, "a b\nfoot", "h"), (1, "c d\nfoot", "h"), (1, "e f\nfoot", "h"), (2, long + "\nfoot", "h"), (3, None, "h")]
    table = spark.createDataFrame([(*r, 5, True) for r in rows], schema).repartition(3)
    found = sorted((repr(r.doc_id), r.n_words, r.n_removed_words) for r in quality.line_quality(table).collect())
    assert found == sorted([("None", 3, 1), ("None", 3, 1), ("1", 3, 1), ("1", 3, 1), ("2", 36001, 1), ("3", 0, 0)])
    kept = quality.line_quality(table, keep=True)
    assert kept.columns[:5] == table.columns and sorted(r.text or "" for r in kept.collect()) == sorted(["a b", "a b", "c d", "e f", long, ""])


def test_line_dedup_of_long_texts_and_clashing_columns(spark):
    lines = [f"line {k}" for k in range(20_000)]
    rows = [(1, "\n".join(lines), 7, "x"), (2, "\n".join(lines[5000:5010] + ["own"]), 8, "y")]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_lines long, key string")
    found = {r.doc_id: r for r in linededup.dedup_lines(table).collect()}
    assert found[1].n_lines == 20_000 and found[1].n_removed_lines == 0 and (found[2].text, found[2].n_removed_lines, found[2].key) == ("own", 10, "y")


def test_quality_of_small_and_hot_hosts(spark):
    letters = lambda k: chr(97 + k // 26) + chr(97 + k % 26)
    rows = []
    for host, size, holders in (("small", 10, 3), ("hot", 600, 21), ("pair", 4, 2)):
        own = [" ".join(f"{host}{letters(k)}{letters(j)}" for j in range(60)) for k in range(size)]
        rows += [(len(rows) + k, "Footer of all\n" + t if k < holders else t, host) for k, t in enumerate(own)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r.n_removed_words for r in quality.line_quality(table).collect()}
    assert found == {i: 3 * (t.startswith("Footer") and s != "pair") for i, t, s in rows}


@pytest.mark.parametrize("partitions", ["1", "200", "9000"])
def test_jaccard_keys_keep_56_bits(spark, monkeypatch, partitions):
    words = [f"w{k}" for k in range(24)]
    table = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:-1], "x"])), (3, "z")], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(jaccard, "_near_components", lambda sets, percent: seen.extend(sets.collect()) or sets.selectExpr("doc as node", "doc as component"))
    real = spark.conf.get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *a: partitions if key == "spark.sql.shuffle.partitions" else real(key, *a))
    jaccard.jaccard_components(table)
    h, bounds = jaccard.shingle_sets(flat.Texts([r.text for r in table.orderBy("doc_id").collect()]))
    both = np.intersect1d(h[: bounds[1]], h[bounds[1] : bounds[2]]) >> np.uint64(8)
    assert len(both) == 19 and len(seen) == 2
    for r in seen:
        assert np.array_equal(np.sort(np.frombuffer(r.shared, "<u8")), both)


def test_tables_of_a_search_go_when_it_is_done(docs):
    mark = session.made()
    found = jaccard.jaccard_components(docs)
    assert session.made() - mark == 2 and found.count() == docs.count()


def test_pipeline_on_odd_tables(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = docs.limit(6).withColumn("doc_id", F.lit(None).cast("long")).union(docs.limit(4))
    nulls = spark.createDataFrame([(None, None, None, None, None), (7, "", None, None, 0), (8, "x " * 30_000, "en", None, None)], docs.schema)
    for name, table in (("full", docs.union(extra).union(nulls)), ("empty", docs.limit(0))):
        clashing = table.withColumns({"_weight": F.lit(1), "n": F.lit("x"), "component_id": F.lit(2.0), "score": F.lit(True)})
        clashing.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    packed = corpus_pipeline.run(spark, f"{tmp_path}/full").collect()
    assert any(r.doc_id is None for r in packed) and all(r.length > 0 for r in packed)
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []
