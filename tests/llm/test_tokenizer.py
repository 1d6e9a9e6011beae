import random

import pytest

from grafloom.llm.tokenizer import EncodedText, PrefixEncoder, default_path, encode_corpus

tokenizers = pytest.importorskip("tokenizers")
ALPHABET = "abcehtT 's\n\t.1é日🙂-"


@pytest.fixture(scope="module")
def encoder():
    with open(default_path(), "rb") as f:
        return PrefixEncoder(f.read())


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def some_text(r, most=60):
    return "".join(r.choice(ALPHABET) for _ in range(r.randint(0, most)))


def test_same_ids_as_library(encoder, library):
    r = random.Random(1)
    texts = ["", " ", "<|endoftext|> x", "I'll've", "the" * 300, "a" * 5000, " " * 500, "​　x\r\n", "0123456789" * 50, "日本語" * 40]
    texts += [some_text(r) for _ in range(3000)]
    assert [encoder.encode(x) for x in texts] == [library(x) for x in texts]
    assert all(encoder.count(x) == len(encoder.encode(x)) for x in texts[:200])


def test_appends_and_edits_are_exact(encoder):
    r = random.Random(2)
    for _ in range(400):
        text = some_text(r)
        held = EncodedText(encoder, text)
        for _ in range(5):
            a = r.randint(0, len(text))
            b = r.randint(a, min(len(text), a + 9))
            new = some_text(r, 6)
            if r.random() < 0.3:
                held.append(new)
                text += new
            else:
                held.replace(a, b, new)
                text = text[:a] + new + text[b:]
            assert held.text == text
            assert held.ids() == encoder.encode(text)


def test_an_edit_looks_at_few_pieces(encoder):
    r = random.Random(5)
    held = EncodedText(encoder, " ".join(some_text(r, 8) for _ in range(4000)))
    text = held.text
    for _ in range(60):
        a = r.randint(0, len(text))
        b, new = min(len(text), a + r.randint(0, 30)), some_text(r, 12)
        held.replace(a, b, new)
        text = text[:a] + new + text[b:]
        assert held.looked_at < 60
    assert held.text == text
    assert held.ids() == encoder.encode(text)
    held.replace(0, len(text), "")
    assert (held.text, held.ids()) == ("", [])
    held.append("again")
    assert held.ids() == encoder.encode("again")


def test_corpus(spark, library):
    rows = [(1, "Hello there world", "x"), (2, None, "y"), (3, "", None), (4, "  \n", "z"), (5, "ab " * 40_000, "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, other string")
    got = {r.doc_id: r for r in encode_corpus(df, "text", count="n").collect()}
    assert {k: list(r.ids) for k, r in got.items()} == {k: library(t or "") for k, t, _ in rows}
    assert {k: r.n for k, r in got.items()} == {k: len(library(t or "")) for k, t, _ in rows}
    assert {r.doc_id: r.n for r in encode_corpus(df, "text", ids=None, count="n").collect()} == {k: r.n for k, r in got.items()}
    assert got[5].other == "long"
    assert encode_corpus(df.limit(0), "text").collect() == []
    with pytest.raises(ValueError, match="exist"):
        encode_corpus(df.withColumnRenamed("other", "IDS"), "text")
