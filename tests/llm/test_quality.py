import pytest

from grafloom.llm.quality import text_statistics

COMMON = ["the", "of", "and", "to", "a"]
PROSE = "The castle of the northern kingdom stands above a quiet river. Every morning the guards walked to the gate and opened it, while merchants waited in the cold."
TEXTS = {
    "null": None, "empty": "", "blank": " \n\t ", "prose": PROSE, "capitals": PROSE.upper(), "spoken": PROSE.lower().replace(".", "").replace(",", ""),
    "wrapped": PROSE.replace(" quiet", "\nquiet").replace(" guards", "\r\nguards").replace(" while", "\nwhile"), "cut": PROSE[:60], "cjk": "日本 語 の 文 章 で す 山 川 木 口 日 本 語",
    "short_list": f"{PROSE}\n- bread\n- milk\n- two eggs\n{PROSE}", "dialogue": f"– {PROSE}\n– {PROSE}", "tab_end": PROSE + "\t",
    "bullets": "Things that you should buy for the party today:\n- bread\n- milk and honey\n- eggs\n- salt", "numbers": "1. bread\n2. milk\n3. eggs", "plain_list": "Bread rolls\nMilk\nFresh eggs\nSalt",
    "pipes": "| name | price | stock |\n| bread | 3 | 10 |\n| milk | 2 | 7 |", "csv": "name,price,stock\nbread,3,10\nmilk,2,7", "tabs": "name\tprice\nbread\t3\nmilk\t2", "aligned": "name     price   stock\nbread    3       10\nmilk     2       7",
    "crumbs": "Home > Food > Fresh Bread > Rolls > White Rolls", "html": '<div class="a">bread</div>\n<p class="b">milk</p>', "code": "if (a.b != null) { return c(40); }\nvar x = {\"a\": 364};", "hex": "0123456789abcdef" * 20,
    "symbols": "#~/*@&{§$|__°>&<>§$[+^{/&*%}#{/*#_>%$", "repeated": "buy cheap bread now " * 40, "function": "the of and to a of the and to a the to of and a the of to and the",
    "noise": "vgc wbj bwtprv gj rrdcpnfvl lrb hc nkrk bp jhnhltwrv ly rb lwcsnctb",
}
GOOD = {"null", "empty", "blank", "prose", "capitals", "spoken", "wrapped", "cut", "short_list", "dialogue", "tab_end", "cjk"}


@pytest.fixture(scope="module")
def got(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in TEXTS.items()], "doc_id string, text string, words string")
    return {r.doc_id: r for r in text_statistics(df, "doc_id", "text", COMMON).collect()}


def test_prose_and_junk(got):
    assert {k for k, r in got.items() if not r.no_prose} == GOOD
    assert "function_words" in got["function"].no_prose
    assert "encoded" in got["hex"].no_prose
    assert got["csv"].no_prose == ["listed"]


def test_statistics(got):
    p = got["prose"]
    words = PROSE.replace(".", "").replace(",", "").split()
    assert p.words == len(words)
    assert p.mean_word_length == pytest.approx(sum(map(len, words)) / len(words))
    assert p.common_share == pytest.approx(sum(w.lower() in COMMON for w in words) / len(words))
    assert (p.symbol_ratio, p.end_punct_share, p.bullet_share) == (0, 1, 0)
    assert got["wrapped"].end_punct_share == 0.25
    assert got["bullets"].bullet_share == 0.8
    assert got["symbols"].symbol_ratio > 0.8
    for k in ("null", "empty", "blank"):
        assert (got[k].words, got[k].end_punct_share, got[k].no_prose, got[k].published) == (0, 0, [], [])
    assert got["csv"].published == ["word_count", "stop_words", "ended_lines", "short_lines", "dropped_lines"]
    assert got["prose"].published == ["word_count"]


def test_closer_look_at_texts_that_break_published_rules(spark, got):
    df = spark.createDataFrame(list(TEXTS.items()), "doc_id string, text string")
    rows = {r.doc_id: r for r in text_statistics(df, "doc_id", "text", COMMON, failing=True).collect()}
    assert set(rows) == {k for k, r in got.items() if set(r.published) - {"word_count"}}
    assert all(r == got[k] for k, r in rows.items())
    assert {k for k, r in rows.items() if r.no_prose} == set(TEXTS) - GOOD


def test_long_text_and_empty_table(spark):
    df = spark.createDataFrame([(1, PROSE * 20_000), (1, PROSE)], "doc_id long, text string")
    rows = text_statistics(df, "doc_id", "text", COMMON).collect()
    assert len(rows) == 2
    assert all(r.no_prose == ["repeated"] or not r.no_prose for r in rows)
    assert text_statistics(df.limit(0), "doc_id", "text", COMMON).collect() == []
