"""Encoding, leakage and languages."""

import random

import numpy as np
import pytest

from quorate.llm import language as lg
from quorate.llm import leakage as lk
from quorate.llm import tokenize as tk

ODD = [None, "", " ", "\n\n  \n", "a<|endoftext|>b", "don't  stop 123 ¾ – naïve ☕️👩‍🔬", "x" * 5000, "l​o­ng " * 3000, "Ünïcödé́ \x00 tail ", "the the the"]


@pytest.fixture(scope="module")
def documents(spark):
    return lambda texts, langs=None: spark.createDataFrame([(k, t, (langs or {}).get(k), "ids") for k, t in enumerate(texts)], "doc_id long, text string, lang string, ids string")


def test_encoding_equals_the_library(spark, documents):
    rng = random.Random(0)
    texts = ODD + [" ".join(rng.choices(["alpha", "beta", "γάμμα", "42", "the", "!"], k=rng.randint(0, 40))) for _ in range(300)]
    encoding = tk._encoding(tk.Params().ranks)
    for chars in (6_000_000, 500):
        got = {r.doc_id: r.ids for r in tk.encode(documents(texts).repartition(3), tk.Params(block_chars=chars, buckets=7)).collect()}
        assert got == {k: encoding.encode_ordinary(t or "") for k, t in enumerate(texts)}
    back = {r.doc_id: r.text for r in tk.decode(tk.encode(documents(texts))).collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}
    odd = spark.createDataFrame([(1, None), (2, []), (3, [64, 65])], "doc_id int, ids array<int>")
    assert [r.text for r in tk.decode(odd).orderBy("doc_id").collect()] == ["", "", "ab"]
    with pytest.raises(Exception, match="unknown token"):
        tk.decode(spark.createDataFrame([(1, [10**6])], "doc_id int, ids array<int>")).collect()


def test_encoding_keeps_rows_and_nothing(spark, documents):
    rows = spark.createDataFrame([(None, "a b"), (1, "a"), (1, "a")], "doc_id int, text string")
    assert sorted((r.doc_id is None, len(r.ids)) for r in tk.encode(rows).collect()) == [(False, 1), (False, 1), (True, 2)]
    assert tk.encode(documents(["x"]).where("false")).count() == 0


def test_varint_round_trip():
    x = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28, 2**34, 5])
    parts = tk.varints(x, np.array([0, 0, 4]))
    assert parts[0] == b"" and [tk.unvarint(b).tolist() for b in parts[1:]] == [x[:4].tolist(), x[4:].tolist()]
    assert tk.unvarint(b"").tolist() == [] and tk.varints(x[:0], np.array([0, 0])) == [b"", b""]


def test_format_characters_are_no_words():
    assert lk.words_of("l​o­ng ＷＯＲＤ x́ a_b \u2060") == ["long", "word", "x", "a", "b"]


def exact_runs(docs, items):
    grams = {}
    for i, t in items:
        w = lk.words_of(t)
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    return {(d, i) for d, t in docs for w in [lk.words_of(t)] for k in range(len(w) - 11) for i in grams.get(tuple(w[k : k + 12]), ())}


def test_leaks(spark):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([5, 14, 40])))) for k in range(40)] + [(90, None), (91, "")]
    items += [(95, items[2][1]), items[3]]
    docs = []
    for k in range(200):
        words = rng.choices(vocabulary, k=rng.choice([0, 10, 60]))
        part = rng.choice(items[:40])[1].split()
        a = rng.randrange(len(part))
        docs.append((k, ", ".join(words[:20] + part[a : a + rng.choice([8, 12, 40])] + words[20:]).upper().replace("W1", "Ｗ​1")))
    docs += [(300, None), (301, ""), (None, items[1][1]), docs[0], (302, " ".join(vocabulary * 60))]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = exact_runs([x for x in docs if x[0] is not None], items)
    for words in (2_000_000, 300):
        found = lk.leaked_items(d, i, lk.Params(item_words=words)).collect()
        assert {(r.doc_id, r.item_id) for r in found if r.edits == 0 and r.window == 12} == want
    assert lk.leaked_items(d.where("false"), i).count() == 0 and lk.leaked_items(d, i.where("false")).count() == 0


def test_near_leaks_are_found(spark):
    rng = random.Random(3)
    texts = [[rng.choice("abcdefgh") * 3 + str(rng.randrange(10**6)) for _ in range(60)] for _ in range(30)]
    edited = [[w if k % 11 != 5 else "changed" + w for k, w in enumerate(t)] for t in texts]  # no twelve words in a row are left
    d = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(edited)], "doc_id long, text string")
    i = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in lk.leaked_items(d, i).collect()}
    assert len(found) >= 27 and all(a == b and r.edits == 1 for (a, b), r in found.items())


def test_recall_of_planted_passages(spark):
    """Windows of 12 words with one edit: at least 0.95; passages of 40 words with one to three edits: at least 0.9, each measured on 300."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))

    def edited(words, n):
        out = list(words)
        for _ in range(n):
            k = rng.randrange(len(out))
            rng.choice([lambda: out.pop(k), lambda: out.insert(k, word()), lambda: out.__setitem__(k, word())])()
        return out

    for size, edits, least in ((12, 1, 0.95), (40, 1, 0.99), (40, 2, 0.95), (40, 3, 0.9)):
        items = [[word() for _ in range(size)] for _ in range(300)]
        docs = [[word() for _ in range(20)] + edited(x, edits) + [word() for _ in range(20)] for x in items]
        d = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(docs)], "doc_id long, text string")
        i = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
        found = {(r.doc_id, r.item_id) for r in lk.leaked_items(d, i).collect()}
        assert all(a == b for a, b in found) and len(found) >= least * 300, (size, edits, len(found))


def test_short_items_are_windows_of_their_own(spark):
    items = [(1, "one two three"), (2, "alpha beta gamma delta epsilon zeta eta theta iota"), (3, "?")]
    docs = [(1, "zero One, two three four"), (2, "one three two"), (3, "alpha beta gamma delta NEW epsilon zeta eta theta iota"), (4, "alpha beta gamma delta iota")]
    found = lk.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.edits, r.window, r.share) for r in found} == {(1, 1, 0, 3, 1.0), (3, 2, 1, 9, 1.0)}


def test_edit_distances_equal_the_plain_ones():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = np.random.default_rng(1)
    for most in (0, 1, 2, 3):  # against the best of the prefixes of y that are about as long as x
        x, y = rng.integers(0, 3, (400, 7)), rng.integers(0, 3, (400, 7 + most))
        best = lambda a, b: min(plain(a, b[:n]) for n in range(7 - most, 8 + most))  # noqa: E731, B023
        assert lk.edit_distances(x, y, most).tolist() == [min(best(a, b), most + 1) for a, b in zip(x.tolist(), y.tolist())]


EN = ["The river was surveyed by sailors from the old harbour.", "Later farmers doubted whether the bridge had ever been repaired.", "Records kept at the museum list many items of which a third were lost."]
DE = ["Der Fluss wurde von den Händlern der alten Stadt vermessen.", "Die Brücke konnte vor kurzem nicht mehr genutzt werden.", "Nach Angaben der Stadt wurde das Archiv im Frühling erweitert."]
RU = ["По данным архива мост был построен в начале века.", "Ясно лишь то, что учёные так и не договорились.", "Однако рынок не был разрушен до войны."]


def test_languages(documents):
    rng = random.Random(0)
    texts, langs, want = [], {}, {}
    for k in range(240):
        lang, pool = [("en", EN), ("de", DE), ("ru", RU)][k % 3]
        texts.append(" ".join(rng.choices(pool, k=4)))
        langs[k] = {0: lang.upper(), 1: lang + "-XX", 2: {"en": "English", "de": "deu", "ru": " ru "}[lang]}[k % 5 % 3]
    langs[5] = "en"  # is Russian
    langs[7], langs[8] = None, "und"
    want |= {5: {"ru"}, 7: {"de"}, 8: {"ru"}}
    for text, languages in (
        (f"State:\nClaim: {EN[0]} {EN[1]}\n\n{DE[0]} {DE[1]}", {"en", "de"}), ("123 - 45 %", set()), (None, set()), ("", set()), ("# Title 1.2\n| n | acc |\n" + " ".join(RU), set()), (" ".join(EN * 3000), set()),
    ):
        k = len(texts)
        texts.append(text)
        langs[k] = "ru" if text and "Title" in text else "en"
        if languages:
            want[k] = languages
    got = {}
    for r in lg.wrong_labels(documents(texts, langs)).collect():
        got.setdefault(r.doc_id, set()).add(r.lang)
    assert got == want
    segments, docs = lg.languages(documents(texts, langs))
    mixed = sorted((r.segment, r.lang, r.sentences) for r in segments.where("doc_id = 240").collect())
    assert mixed == [(0, "en", 2), (1, "de", 2)]
    row = docs.where("doc_id = 0").first()
    assert row.lang == "en" and row.confidence > 0.9 and docs.count() == len(texts)


def test_text_right_after_a_heading_or_table_row_is_scored(documents):
    for head in ("# Title", "| 801 | 0.295 | 0.0667 |", "| n | acc |\n| 1 | 0.5 |", "  ## Title"):
        text = f"{EN[0]}\n\n{head}\n{DE[0]} {DE[1]}"
        assert [text[a:b] for a, b, whole in lg.sentences(text) if whole] == [EN[0], DE[0], DE[1]]
        assert [text[a:b] for a, b, _ in lg.sentences(f"{EN[0]}\n{head}")] == [EN[0]]
    pools = {"en": EN, "de": DE, "ru": RU}
    texts = [" ".join(random.Random(k).choices(pools[x], k=4)) for k in range(20) for x in pools]
    langs = {k: list(pools)[k % 3] for k in range(60)}
    texts += [f"{EN[0]} {EN[1]}\n\n| 801 | 0.295 | 0.0667 |\n{DE[0]}", f"# Title\n{EN[0]} {EN[1]} {RU[0]} {RU[1]}"]
    langs |= {60: "en", 61: "en"}
    assert {(r.doc_id, r.lang) for r in lg.wrong_labels(documents(texts, langs)).collect()} == {(60, "en"), (60, "de"), (61, "en"), (61, "ru")}


def test_languages_of_nothing(documents):
    assert lg.wrong_labels(documents([])).count() == 0
    assert lg.wrong_labels(documents(["Some words without any label at all."])).count() <= 1


def test_forward_sums_all_segmentations():
    pieces = lg.Pieces(lg.Params().pieces)
    rng = np.random.default_rng(0)
    prob = rng.random((pieces.size, 2)) / 100
    model = lg.Model(pieces, prob)
    for word in ("the", "house", "дом", "x" * 90, "donaudampfschiff" * 3, "überall" * 300, "ab\U0001f600c"):  # long ones are not cut
        t = "▁" + word
        alpha = [np.zeros(2)] + [np.full(2, -np.inf) for _ in t]  # logarithms
        for j in range(1, len(t) + 1):
            for i in range(max(0, j - 40), j):
                k = pieces.index.get(t[i:j], -1 if j - i > 1 else pieces.size - 1)
                if k >= 0:
                    alpha[j] = np.logaddexp(alpha[j], alpha[i] + np.log(prob[k]))
        assert np.allclose(model.word_scores([word, "the"])[0], alpha[-1])


def test_label_codes():
    assert [lg.label_code(x) for x in ("EN", "en-GB", "English", "deu", "pt_BR", " it ", "xx", "", None, "n/a")] == ["en", "en", "en", "de", "pt", "it", None, None, None, None]
