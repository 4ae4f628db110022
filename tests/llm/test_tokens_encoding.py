import os
import random

import pytest

from geochunk.llm import encoding as E
from geochunk.llm.tokens import VOCABULARY, count_tokens, encoder, token_counts
from tests.llm.heldout import measure

LINES = {
    "en": ["The naïve estimate by Ødegård and Müller holds for every Čech complex – see the résumé.", "Costs rose from 3 € to 5 € per unit, £2 net of ¥ and ¢.", "A façade of Señor Žižek’s café."],
    "de": ["Für große Werte gilt die Abschätzung der Flüsse überall.", "Die Größe Ä ist schön, Öl und Übermaß auch.", "Müßige Gespräche über Straßen und Bäche."],
    "fr": ["L’été dernier, l’âge du modèle où l’on a posé le problème.", "À l’ordre zéro, la chaîne précède le degré – même ici.", "Grâce à la symétrie, le théorème révèle l’écart."],
    "ru": ["Напротив, матрица перехода сохраняет взвешенную сеть при низкой температуре.", "Покажем, что остаточный поток определяет спектр задачи.", "Отсюда следует, что теорема верна, её объём возмущён."],
    "cs": ["Ukážeme, že číslo převyšuje váženou síť blízko hranice.", "Příliš žluťoučký kůň úpěl ďábelské ódy.", "Během měření zřejmě řešení splňuje spektrum."],
    "pt": ["A EQUAÇÃO DE MAÇÃ NÃO É ÚNICA. A razão média não excede a órbita.", "A solução não é única até a última iteração.", "Observação: São Paulo fica além do órgão."],
}


def corpus(n=900, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang = rnd.choice(list(LINES))
        text = " ".join(rnd.choice(LINES[lang]) for _ in range(rnd.randint(4, 12)))
        if i % 9 == 0:
            text += r" Old scans show \verb|Ã©| or \verb|â€™| here."
        out.append((lang, text))
    return out


@pytest.fixture(scope="module")
def tables():
    c = corpus()
    return E.Tables([t for _, t in c], [g for g, _ in c])


WAYS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1250"), ("utf-8", "cp1251"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("utf-8", "koi8-r"), ("cp1251", "cp1252"), ("koi8-r", "cp1251"), ("cp1250", "cp1252"), ("mac_roman", "cp1252"), ("cp1251", "koi8-r")]


def test_clean_texts_stay(tables):
    held = corpus(300, 2)
    assert not any(tables.suspicious(t) for _, t in held)
    assert all(tables.restored(t) == (t, []) for _, t in held[:40])


@pytest.mark.parametrize("true,wrong", WAYS)
def test_wholly_garbled_texts_are_found_and_restored(tables, true, wrong):
    found = fixed = n = 0
    for lang, text in corpus(200, 3):
        g = E.Pair(true, wrong).garble(text)
        if "\\verb" in text or g is None or g == text or (true, lang) in (("cp1250", "fr"), ("mac_roman", "fr")):
            continue
        n += 1
        found += tables.suspicious(g)
        fixed += tables.restored(g)[0] == text
    assert n > 10 and found == n
    assert fixed >= 0.9 * n


def test_places_and_repeats(tables):
    rnd, p = random.Random(4), E.Pair("utf-8", "cp1252")
    for lang, text in corpus(80, 5):
        words = text.split(" ")
        odd = [i for i, w in enumerate(words) if any(ord(c) > 127 for c in w) and "verb" not in w and E.Pair("utf-8", "cp1252").garble(w)]
        i = rnd.choice(odd)
        one = " ".join([*words[:i], p.garble(words[i]), *words[i + 1 :]])
        assert tables.suspicious(one)
        twice = p.garble(p.garble(text))
        assert tables.suspicious(twice) and ("\\verb" in text or tables.restored(twice)[0] == text)
    assert tables.suspicious("K. Vel�n, Journal")
    assert not tables.suspicious(r"printed as \verb|�| here, \verb+Ð¿Ñ€+ there")


def test_gain_is_where_viterbi_leaves_the_clean_state(tables):
    rnd = random.Random(6)
    texts = [t for _, t in corpus(60, 7)] + [E.PAIRS[rnd.randrange(len(E.PAIRS))].garble(t) or t for _, t in corpus(60, 8)]
    for t in texts:
        _, p, c = E.symbols(E.hide_quotes(t))
        assert (tables.gain(tables.rows(p, c)) > 0) == bool(tables.spans(t))
    assert [bool(x) for x in E._flag(tables, [*texts, None, ""])] == [tables.suspicious(t) for t in texts] + [False, False]


def test_blocks_give_what_the_whole_gives(tables, monkeypatch):
    texts = [t for _, t in corpus(15, 11)] + [E.PAIRS[i].garble(t) or t for i, (_, t) in enumerate(corpus(40, 12))] + ["a\ufffdb\ufffd\ufffd " + t for _, t in corpus(5, 13)]
    want = [(round(tables.gain(tables.rows(*E.symbols(t)[1:])), 6), tables.spans(t)) for t in texts]
    for steps in (1, 7, 64):
        monkeypatch.setattr(E, "_STEPS", steps)
        assert [(round(tables.gain(tables.rows(*E.symbols(t)[1:])), 6), tables.spans(t)) for t in texts] == want


def test_lost_characters_are_a_state(tables):
    assert tables.spans("one \ufffd\ufffd two \ufffd") == [(4, 6, "lost"), (11, 12, "lost")]
    assert tables.restored("K. Vel\ufffdn") == ("K. Vel\ufffdn", [])
    assert not tables.suspicious(r"\verb|\ufffd|".replace(r"\ufffd", "\ufffd"))
    bare = E.Tables([t for _, t in corpus(200, 1)], quoted="")
    assert bare.suspicious(r"\verb|x|".replace("x", "\ufffd"))


@pytest.mark.parametrize("char", ["\u00a0", "\u00a9", "\u00ab", "\u00b0", "\U0001f600", "\U0001d49c", "\u2013"])
@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp1251"])
def test_first_bytes_the_sample_lacks(tables, char, wrong):
    p = E.Pair("utf-8", wrong)
    text = f"a note {char} of the year"
    garbled = p.garble(text)
    assert tables.suspicious(garbled)
    if len(char.encode()) > 2:  # of a lone character that clean text lacks, two bytes may have come of many pairs
        assert char in tables.restored(garbled)[0]


def test_misread_many_times(tables):
    p, text = E.Pair("utf-8", "cp1252"), LINES["de"][0]
    many = text
    for _ in range(6):
        many = p.garble(many)
    assert tables.suspicious(many) and tables.restored(many)[0] == text


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_recall_and_precision_held_out():
    m = measure("/root/testdata/sf0.01")
    assert m["garbled"] > 150 and m["clean"] > 150 and m["recall"] >= 0.9 and m["precision"] >= 0.9


def test_pairs_undo_themselves():
    for p in E.PAIRS:
        if not p.stripped:
            for _, t in corpus(20, 9):
                g = p.garble(t)
                assert g is None or p.restore(g) == t


def test_on_tables(spark, tables):
    p = E.Pair("utf-8", "cp1252")
    data = [(1, LINES["de"][0], "de", "x"), (2, p.garble(LINES["de"][0]), None, "x"), (3, None, "de", "x"), (4, "", None, "x"), (2, p.garble(LINES["de"][0]), None, "x"), (5, "a" * 300_000 + p.garble("ü"), "", "x")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, key string")
    got = E.garbled_documents(df, tables).collect()
    assert sorted((r["doc_id"], r["restored"][-60:]) for r in got) == [(2, LINES["de"][0][-60:])] * 2 + [(5, "a" * 59 + "ü")]
    assert E.garbled_documents(df.limit(0), tables).count() == 0
    empty = E.fit(df.limit(0))
    assert E.garbled_documents(df, empty, restore=False).count() >= 0
    assert E.fit(df).sizes["sample"] == 4  # null and very long texts are no part of the sample


@pytest.mark.parametrize("lang,true,wrong", [("de", "utf-8", "cp1252"), ("fr", "utf-8", "latin-1"), ("ru", "utf-8", "cp1252"), ("ru", "cp1251", "cp1252"), ("cs", "cp1250", "cp1252")])
def test_a_third_of_a_language_misread_in_one_way(lang, true, wrong):
    p, bad, good, n = E.Pair(true, wrong), [], [], 0
    for g, t in corpus(900, 10):
        n += g == lang
        was, t = t, t if g != lang or n % 3 or "\\verb" in t else p.garble(t)
        (good if t == was else bad).append((g, t))
    bad = [(g, t) for g, t in bad if t is not None]
    tables = E.Tables([t for _, t in good + bad], [g for g, _ in good + bad])
    assert len(bad) > 30 and all(tables.suspicious(t) for _, t in bad)
    assert not any(tables.suspicious(t) for _, t in good)


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
def test_token_counts(spark):
    texts = ["", None, "hello world", "x" * 20000, "Größe 12 <|endoftext|> \n\n ü", "hello world"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(df).collect()}
    assert got[0] == got[1] == 0 and got[2] == got[5] == 2
    assert got == {i: count_tokens(t) for i, t in enumerate(texts)}
    assert encoder().decode(encoder().encode_ordinary(texts[4])) == texts[4]
    assert token_counts(df.limit(0)).count() == 0
