import numpy as np
import pytest

from geochunk.llm import encoding as E
from tests.llm.test_tokens_encoding import LINES, corpus

POLISH = "Zażółć gęślą jaźń, świętość ćwiczeń łączy źródła."


def table(spark, rows):
    return spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(rows)], "doc_id bigint, text string, lang string").repartition(3)


def test_every_text_is_counted(spark):
    """More texts than the former sample of 4000, and ones longer than its 100,000 characters."""
    rows = corpus(4200, 21) + [("pl", "a " * 60_000 + POLISH + " b" * i) for i in range(20)] + [("en", "plain"), ("en", ""), (None, None)]
    tables = E.fit(table(spark, rows))
    texts = [(t, g) for g, t in rows if t is not None]
    assert tables.sizes["sample"] == len(texts) == 4222
    whole = E.Tables(*map(list, zip(*texts)))
    assert tables.sizes == whole.sizes
    assert np.array_equal(tables.keys, whole.keys) and np.array_equal(tables.ratio, whole.ratio)
    _, p, c = E.symbols(POLISH)
    assert np.isin(p * (1 << 21) + c, tables.keys).all() and not tables.suspicious(POLISH)


@pytest.mark.parametrize("text", ["", "abc", "é", "aé", "éa", "éab", "abéabéé cde é", "é\n\nю𝒜 x", LINES["ru"][0], LINES["fr"][1], "a\ufffdb"])
def test_squeezed_texts_keep_their_symbols(text):
    t, classes = E.squeezed(text)
    assert all(np.array_equal(x, y) for x, y in zip(E.symbols(t)[1:], E.symbols(text)[1:]))
    assert classes.tolist() == np.bincount([E._CLASS[ord(c)] for c in text if c < "\x7f"], minlength=8).tolist()
    assert E._runs(t) == E._runs(text) and {c for c in t if c > "\x7f"} == {c for c in text if c > "\x7f"}


def test_counts_do_not_depend_on_the_parts(monkeypatch):
    c = corpus(300, 22) + [("ru", E.Pair("cp1251", "cp1252").garble(t)) for t in LINES["ru"]]
    want = E.Tables([t for _, t in c], [g for g, _ in c])
    monkeypatch.setattr(E, "_ROWS", 7)
    monkeypatch.setattr(E, "_CHUNK", 50)
    got = E.Tables([t for _, t in c], [g for g, _ in c])
    assert got.sizes == want.sizes and np.array_equal(got.keys, want.keys) and np.array_equal(got.ratio, want.ratio)


def test_no_texts(spark):
    assert E.fit(table(spark, [(None, None)])).sizes == E.Tables([]).sizes == {"sample": 0, "pure": 0, "clean": 0}
