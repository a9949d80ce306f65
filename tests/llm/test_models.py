"""Language identification, toxicity and embeddings: held-out accuracy, brute force and edge cases."""

import math
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from sablegrid.llm import epsgrid, langid, toxicity

SYLLABLES = {"aa": ["the", "ing", "er", "on"], "bb": ["chen", "ung", "keit", "zu"], "cc": ["при", "вет", "мир", "да"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_held_out_and_spans(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang, rng.randint(3, 40)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(1000, None, "aa"), (1001, "", None), (1002, "123 !?", "bb"), (1003, prose(rng, "aa", 30) + ". " + prose(rng, "bb", 12), None), (1004, "漢字", None), (None, prose(rng, "cc", 5), None), (1005, prose(rng, "aa", 20000), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    found = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs), spans=True).collect()}
    assert len(found) == len(rows)
    for i, text, lang in rows[:180]:
        assert found[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and found[i].lang_pred == lang and 0 <= found[i].score <= 1, text
    assert [found[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and found[1000].score == 0.0
    assert [s.lang for s in found[1003].spans] == ["aa", "bb"] and found[1003].spans[0].words == 30
    assert found[1003].lang_pred == "aa" and found[1004].score == 0.0 and found[None].lang_pred == "cc" and found[1005].lang_pred == "aa"


@pytest.mark.parametrize("chunk", [1, 3, 128])
def test_language_path_equals_brute_force(chunk, monkeypatch):
    monkeypatch.setattr(langid, "CHUNK", chunk)
    rng = np.random.default_rng(0)
    model = langid.Model(["a", "b", "c"], np.zeros((1, 3), np.float32), np.ones((3, 1), bool))
    scores = (-rng.random((400, 3)) * 12).astype(np.float32)
    scores[rng.random((400, 3)) < 0.1] = langid.NEVER
    bounds = np.array([0, 0, 7, 19, 40, 41, 400])
    path = model.path(scores, bounds)
    for a, b in zip(bounds[:-1], bounds[1:]):
        best = scores[a].astype(float) if b > a else None
        for t in range(a + 1, b):
            best = scores[t] + np.maximum(best, best.max() - langid.SWITCH)
        if b > a:
            own = sum(float(scores[t][path[t]]) for t in range(a, b)) - langid.SWITCH * int((path[a + 1 : b] != path[a : b - 1]).sum())
            assert math.isclose(own, best.max(), rel_tol=1e-4, abs_tol=1e-3)


def plain_prediction(model, text):
    """Language and score by the definition: scores a word from its letter sequences, then the best path."""
    words = [w for w in regex.findall(r"\p{L}+", unicodedata.normalize("NFC", (text or "").lower()))]
    if not words:
        return "und", 0.0
    k, rows, known = len(model.languages), [], []
    for w in words:
        raw = b" " + w.encode()
        score = np.zeros(k)
        for n in langid.ORDERS:
            for i in range(len(raw)):
                piece = (raw + b" ")[i : i + n]
                full = len(piece) == n
                bucket = int(langid._mix(np.array([int.from_bytes(piece, "little")], np.uint64) + np.uint64(n << 40))[0] % np.uint64(langid.BUCKETS)) if full else langid.BUCKETS
                score += model.weights[bucket]
        allowed = model.scripts[:, langid._SCRIPT[np.searchsorted(langid._STARTS, ord(w[0]), "right") - 1]]
        known.append(bool(allowed.any()))
        best = max([s for s, ok in zip(score, allowed) if ok], default=0)
        rows.append([max(s - best, -langid.CLIP) if ok else langid.NEVER for s, ok in zip(score, allowed)] if known[-1] else [0.0] * k)
    best, came = list(rows[0]), []
    for row in rows[1:]:
        top = int(np.argmax(best))
        came.append([j if best[j] >= best[top] - langid.SWITCH else top for j in range(k)])
        best = [row[j] + max(best[j], best[top] - langid.SWITCH) for j in range(k)]
    label = [int(np.argmax(best))]
    for back in reversed(came):
        label.append(back[label[-1]])
    label.reverse()
    held = [sum(len(w) for w, g, ok in zip(words, label, known) if g == j and ok) for j in range(k)]
    return model.languages[int(np.argmax(held))], max(held) / sum(map(len, words))


def test_language_equals_brute_force_over_whole_texts(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, lang, rng.randint(1, 60)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 40)]
    rows += [(500 + i, " ".join(prose(rng, rng.choice(["aa", "bb", "cc"]), rng.randint(1, 9)) for _ in range(rng.randint(1, 30))), None) for i in range(40)]
    rows += [(600, None, "aa"), (601, "12 3", "bb"), (602, "漢字 the er", None), (603, "the\tthe\n" * 900 + "ung " * 40, None)]
    docs = spark.createDataFrame([(*r, True, 0.5) for r in rows], "doc_id long, text string, lang string, held_out boolean, score double").repartition(3)
    model = langid.fit(docs)
    found = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for i, text, _ in rows:
        lang, score = plain_prediction(model, text)
        assert found[i].lang_pred == lang and math.isclose(found[i].score, score, abs_tol=1e-9), (i, text)


def test_language_of_one_word_in_another_script(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, lang, 30), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 30)]
    rows += [(900, prose(rng, "aa", 20) + " привет " + prose(rng, "aa", 20), None), (901, "same", "aa"), (901, "same", "aa"), (None, "привет", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs), spans=True).collect()}
    assert [(s.lang, s.word, s.words) for s in found[900].spans] == [("aa", 0, 20), ("cc", 20, 1), ("aa", 21, 20)]
    assert langid.predict(docs, langid.fit(docs)).where("doc_id = 901").count() == 2 and found[None].lang_pred == "cc"


def test_rare_languages_are_learned(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, "bb" if i % 500 == 7 else "aa", 20), "bb" if i % 500 == 7 else "aa") for i in range(6000)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), size=40)
    assert model.languages == ["aa", "bb"]


def test_language_without_training(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs)).collect()} == {"und"}
    assert langid.predict(docs.limit(0), langid.fit(docs)).collect() == []


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    plain, bad = ["lorem", "ipsum", "dolor", "amet", "this", "they", "sit", "sed"], ["fool", "vilething", "vilestuff"]
    rows, labels = [], []
    for i in range(600):
        words, toxic = [rng.choice(plain) for _ in range(rng.randint(8, 60))], int(i % 6 == 0)
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(bad).upper())
        rows.append((i, ". ".join([" ".join(words[:5]), " ".join(words[5:])]), i, "clash"))
        if i % 2 == 0 or toxic:
            labels.append((i, toxic))
    rows += [(9000, None, 0, ""), (9001, "", 0, ""), (None, "you fool", 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long, predicted string").repartition(3)
    grammar = toxicity.fit_grammar(docs, spark.createDataFrame([*labels, (9000, None)], "doc_id long, toxic int"))
    found = {r.doc_id: r for r in toxicity.score_documents(docs, grammar).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i].held_out == (i in held) for i in range(600))
    assert all(found[i].predicted == int(i % 6 == 0) for i in held)
    assert found[9000].score == found[9001].score < 0.5 and found[None].predicted == 1 and not found[None].held_out


def toxicity_of(words):
    given = toxicity.Texts(words)
    table = toxicity._table(dict.fromkeys(toxicity.hash_ranges(given.words8, given.offsets[:-1], np.diff(given.offsets)).tolist(), 6.0))
    return toxicity.Grammar([toxicity._table({})] * toxicity.STEM + [table], toxicity.PRIOR)


def test_toxicity_forms_of_a_clause():
    grammar = toxicity_of(["fool"])
    texts = ["a fool", "you fool", "not a fool", "he said a b c fool", "not. a fool", "we kill", "kill you", "", None, "fool", "fool. you", "fool, it is", "fool a b c you", "you a b c fool", "never a b c fool", "I kill"]
    named = [dict(zip(toxicity.FORMS, f.tolist(), strict=True)) for f in grammar.forms(toxicity.clauses(pa.array(texts, pa.large_string())))]
    assert [next((k for k, v in f.items() if v), None) for f in named] == ["asserted", "aimed", None, None, "asserted", "asserted_threat", "aimed_threat", None, None, None, None, "asserted", "asserted", "asserted", "asserted", "asserted_threat"]
    score = dict(zip(texts, grammar.scores(toxicity.clauses(pa.array(texts, pa.large_string()))).tolist(), strict=True))
    assert score["you fool"] > score["a fool"] > 0.5 > max(score["not a fool"], score["he said a b c fool"], score["fool"], score[""])


def plain_forms(words):
    """Forms of a clause's words by the definition of the transducers, one word after the other."""
    out = []
    for i, w in enumerate(words):
        if w not in ("fool", "kill"):
            continue
        near = lambda sign, a, b: any(x in sign for x in words[max(a, 0) : b])
        if near(toxicity.NEGATIONS, i - toxicity.REACH, i) or near(toxicity.REPORTS, 0, i):
            continue
        aimed = near(toxicity.TARGETS, i - toxicity.REACH, i) or near(toxicity.TARGETS, i + 1, i + 1 + toxicity.REACH)
        if aimed or len(words) > 1:
            out.append(("aimed" if aimed else "asserted") + "_threat" * (w == "kill"))
    return out


@pytest.mark.parametrize("chunk", [4, 128])
def test_composed_transducers_equal_the_definition(chunk, monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK", chunk)
    rng = random.Random(12)
    grammar, texts, expected = toxicity_of(["fool"]), [], []
    for _ in range(300):
        made = [[rng.choice(["fool", "kill", "you", "not", "said", "x", "y", "z", "w", "v"]) for _ in range(rng.choice([1, 2, 5, 9, 400]))] for _ in range(rng.randint(0, 4))]
        texts.append(rng.choice([". ", "! ", "\n", " ; "]).join(" ".join(c) for c in made))
        expected.append(Counter(f for c in made for f in plain_forms(c)))
    found = grammar.forms(toxicity.clauses(pa.array(texts, pa.large_string())))
    for row, want in zip(found, expected, strict=True):
        assert row.tolist() == [want[k] * (toxicity.THREAT_WEIGHT if "threat" in k else 6.0) for k in toxicity.FORMS]


def test_toxicity_of_repeated_and_long_rows(spark):
    rows = [(1, "you fool " + "x " * 50_000), (2, "x " * 50_000 + "you fool"), (3, "you fool"), (3, "you fool"), (4, "fine words")]
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, held_out boolean")
    found = [(r.doc_id, r.predicted) for r in toxicity.score_documents(docs, toxicity_of(["fool"])).collect()]
    assert sorted(found) == [(1, 1), (2, 1), (3, 1), (3, 1), (4, 0)]
    grammar = toxicity.fit_grammar(docs, spark.createDataFrame([(3, 0), (3, 1), (4, 0), (None, 1)], "doc_id long, toxic int"))
    assert toxicity.score_documents(docs, grammar).count() == 5


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    grammar = toxicity.fit_grammar(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_documents(docs, grammar).first().predicted == 0
    assert toxicity.score_documents(docs.limit(0), grammar).collect() == []


def brute(rows, limit=0.9):
    good = {i: v for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = {i: set() for i in range(len(rows))}
    for i in good:
        for j in good:
            a, b = np.array(good[i], np.float32).astype(float), np.array(good[j], np.float32).astype(float)
            if i != j and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= limit:
                links[i].add(j)
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in links:
            for j in links[i]:
                if label[j] < label[i]:
                    label[i], changed = label[j], True
    return {rows[i][0]: (len(links[i]), rows[label[i]][0], rows[i][0] == rows[label[i]][0]) for i in range(len(rows))}


def test_embeddings_equal_brute_force(spark, monkeypatch):
    for name, value in (("PIECE_BYTES", 1 << 10), ("BLOCK_BYTES", 1 << 12), ("RUN", 8)):
        monkeypatch.setattr(epsgrid, name, value)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    vectors = [(centres[k % 12] + rng.normal(size=16) * rng.choice([0.05, 0.3, 0.6])).tolist() for k in range(500)]
    vectors += [vectors[0]] * 40 + [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [float("inf")] * 16, (np.array(vectors[1]) * 7).tolist()]
    rows = list(enumerate(vectors))
    df = spark.createDataFrame([(i, v, 0, True) for i, v in rows], "vec_id long, embedding array<float>, label int, kept boolean").repartition(5)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in epsgrid.near_vectors(df).collect()}
    assert found == brute(rows)
    assert epsgrid.near_vectors(df.limit(0)).collect() == []


def test_embeddings_of_one_length_in_large_tiles(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(3, 24))
    vectors = [(centres[k % 3] + rng.normal(size=24) * (0.02 if k % 2 else 0.4)).tolist() for k in range(900)] + [[0.5] * 24] * 30
    rows = list(enumerate(vectors))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in epsgrid.near_vectors(df).collect()} == brute(rows)


def test_embeddings_of_many_lengths(spark, monkeypatch):
    for name, value in (("PIECE_BYTES", 512), ("BLOCK_BYTES", 1 << 10), ("RUN", 4), ("LEAST_SAMPLE", 20)):
        monkeypatch.setattr(epsgrid, name, value)
    rng = np.random.default_rng(5)
    rows = []
    for length in (1, 2, 3, 7, 30, 31):
        centres = rng.normal(size=(3, length))
        rows += [(centres[k % 3] + rng.normal(size=length) * rng.choice([0.05, 0.5])).tolist() for k in range(12 if length == 7 else 45)]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in epsgrid.near_vectors(df).collect()} == brute(rows)


def test_embeddings_of_repeated_and_null_ids(spark):
    rows = [(None, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, n_links int")
    found = sorted((repr(r.vec_id), r.component_id) for r in epsgrid.near_vectors(df).collect())
    assert found == [("1", 1), ("2", 1), ("2", 1), ("3", 3), ("None", None)]


def test_embeddings_without_valid_rows(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in epsgrid.near_vectors(df).select("vec_id", "n_links", "component_id", F.col("kept")).collect()} == {(1, 0, 1, True), (2, 0, 2, True)}
