import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from topicweave.functions import html
from topicweave.functions import text as tx
from topicweave.operators import extract, lexicon
from topicweave.plans import jobs


def apply(frame, fn, values):
    df = frame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["o"] for r in df.select("i", fn(F.col("t")).alias("o")).orderBy("i").collect()]


def test_blank(frame):
    assert apply(frame, tx.is_blank, [None, "", "  ", "\t", " ", "x"]) == [True] * 5 + [False]


def test_clean(frame):
    assert apply(frame, tx.clean, ["a_b c!", "é", "½ ²", "‿"]) == ["a_b c", "e", "½ ²", ""]


def test_extra_space_like_python(frame):
    values = ["a b", "a  b", " a", "a\n", "a ", "a\x1f", "", "a \t b"]
    want = [bool(__import__("re").search(r"\s{2,}", v)) or v != v.strip() for v in values]
    assert apply(frame, tx.has_extra_space, values) == want


def test_words_like_python_split(frame):
    values = ["", "  ", "a  b\tc\n", " x y\x1cz"]
    assert apply(frame, tx.words, values) == [v.split() for v in values]


def test_stop_words_keep_repeats(frame):
    assert apply(frame, lambda c: tx.drop_words(c, ["y"]), ["x y x z"]) == ["x x z"]


@pytest.mark.parametrize("limit", [0, 100])
def test_stop_words_from_table(frame, monkeypatch, limit):
    monkeypatch.setattr(lexicon, "small_or_none", lambda df, n=limit: df if limit else None)
    df = frame([(1, "x y x Y z"), (2, "y"), (3, None)], "i int, t string")
    got = lexicon.remove_stopwords(df, "t", frame([("y",), ("z",)], "word string"), "i")
    assert [r["t"] for r in got.orderBy("i").collect()] == ["x x Y", "", None]
    twins = frame([(1, "x y z"), (1, "w y"), (None, "x y z"), (None, None)], "i int, t string")
    got = lexicon.remove_stopwords(twins, "t", frame([("y",), (None,)], "word string"), "i")
    assert sorted(str(r["t"]) for r in got.collect()) == ["None", "w", "x z", "x z"]


def test_nfc_like_python(frame):
    values = ["é", "é", "ế", "ế", "Å", "ậ", None, "plain", " "]
    assert apply(frame, tx.nfc, values) == [v if v is None else unicodedata.normalize("NFC", v) for v in values]


def test_tone_marks(frame):
    pairs = {
        "hoá": "hóa", "thuỷ": "thủy", "quý": "quý", "giá": "giá", "baỏ": "bảo", "nghịêm": "nghiệm", "lựơng": "lượng",
        "tòan": "toàn", "hùynh": "huỳnh", "ngóai": "ngoái", "của": "của", "épationre": "épationre", "giếng": "giếng",
    }
    assert apply(frame, tx.normalize_tone, list(pairs)) == list(pairs.values())
    assert apply(frame, tx.normalize_tone, ["  hoá   x "]) == ["hóa x"]


def test_cleaning_before_composing_loses_accents(frame):
    df = frame([(1, "Café the!")], "i int, t string")
    assert jobs.clean_before_composing(df, "t", ["the"]).first()["t"] == "cafe"
    assert jobs.clean_articles(df, "t", "i").first()["t"] == "café the"


def test_first_sentence(frame):
    assert apply(frame, tx.first_sentence, ["A b. C d.", "no mark", "x.y z! w"]) == ["A b.", "no mark", "x.y z!"]


def walk(tokens, known):
    out, i = [], 0
    while i < len(tokens):
        if i + 1 < len(tokens) and (tokens[i], tokens[i + 1]) in known:
            out.append(tokens[i] + "_" + tokens[i + 1])
            i += 2
        else:
            out.append(tokens[i])
            i += 1
    return " ".join(out)


@pytest.mark.parametrize("limit", [0, 1000])
def test_segmentation_equals_a_plain_walk(frame, monkeypatch, limit):
    monkeypatch.setattr(lexicon, "MAX_LEXICON", limit)
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, ""]
    known = {("a", "b"), ("b", "a"), ("c", "c"), ("d", "a")}
    df = frame(list(enumerate(texts)), "i int, t string")
    lex = frame([(x, y, 5) for x, y in known], "w1 string, w2 string, n_pair bigint")
    got = [r["t"] for r in lexicon.segment_words(df, "t", "i", lex).orderBy("i").collect()]
    assert got == [None if t is None else walk(t.split(), known) for t in texts]


def test_segment_first_sentence_only(frame):
    df = frame([(1, "a b. a b")], "i int, t string")
    lex = frame([("a", "b.", 1), ("a", "b", 1)], "w1 string, w2 string, n_pair bigint")
    assert lexicon.segment_words(df, "t", "i", lex, first_sentence_only=True).first()["t"] == "a_b."


def test_collocations(frame):
    df = frame([("a b a b c",), ("a b",)], "t string")
    got = {(r["w1"], r["w2"]): (r["n_pair"], r["n1"], r["n2"]) for r in lexicon.collocations(df, "t", 2).collect()}
    assert got == {("a", "b"): (3, 3, 3)}


def test_page_text():
    page = '<!DOCTYPE html><p>a&amp;b<!-- x --><script>var t="</p>"</script><style>p{}</style><b>c</b>'
    assert html.page_text(page) == "a&bc"


def test_first_element():
    find = lambda page: html.first_element_text(page, "p", "class", "description")
    assert find('<p>no</p><p class="description"> a <b>b</b>\n c<br>d</p><p class="description">z</p>') == "a b c d"
    assert find('<p class="description big">no</p>') == ""
    assert find("<p>none") == ""
    assert find('<div><p class="description">open</div>after') == "open"
    assert find("<<p class=") == ""


def test_failing_page_does_not_end_the_job(frame):
    def read(page):
        if page == "bad":
            raise ValueError("broken")
        return page.upper()

    df = frame([(1, "x"), (2, "bad"), (3, None)], "i int, html string")
    got = [tuple(r) for r in extract.extract_pages(df, "html", read, "t").orderBy("i").collect()]
    assert got == [(1, "X", None), (2, "", "ValueError: broken"), (3, "", None)]


def test_large_lexicon_moves_known_pairs_only(frame, monkeypatch):
    monkeypatch.setattr(lexicon, "MAX_LEXICON", 0)
    moved, join = [], lexicon.counted_join
    monkeypatch.setattr(lexicon, "counted_join", lambda pairs, *a, **b: (moved.append(pairs.count()), join(pairs, *a, **b))[1])
    texts = [(0, "a b " + " ".join(f"w{i}" for i in range(500)) + " a b c"), (1, None), (2, ""), (3, "b c")]
    df, lex = frame(texts, "i int, t string"), frame([("a", "b", 2), ("b", "c", 2)], "w1 string, w2 string, n_pair int")
    got = [r["t"] for r in lexicon.segment_words(df, "t", "i", lex).orderBy("i").collect()]
    assert got == [texts[0][1].replace("a b", "a_b"), None, "", "b_c"] and moved[0] < 20
