"""Per-document text statistics, and fixed-threshold rules that tell prose from lists, tables and junk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns. Characters that show nothing; line ends; words; words and numbers.
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
LINE_END = "\\r\\n|[\\n\\r\\u2028\\u2029\\u0085\\u000b\\f]"
WORD, UNIT = "[\\p{L}\\p{M}]+", "[\\p{L}\\p{N}]+"
#: Ends of a sentence, and quotes and brackets that may close after them.
SENTENCE_END, CLOSING = list(".!?\u2026\u3002\uff01\uff1f"), "\"'\u201c\u201d\u2019\u00bb)]"
#: A list item's mark: a bullet, or a number or letter with a dot, bracket or colon. Dashes wider than a hyphen start
#: spoken lines and are no mark.
MARK = "^\\s*(?:[-*+\\u2022\\u2192\\u00b7\\u25e6\\u25aa\\u2023\\u25cf>]|\\(?(?:\\d{1,4}|[a-zA-Z])[.):])\\s"
EDGES = "^\\s+|\\s+$"
RULER = "^[-=\\u2500\\u2501_+|:\\s]{3,}$"
#: What separates cells of a row, and separators that stand alone between the items of a line.
CELL, APART = "\\t|\\||;|,| {2,}", " [/>|\\u00b7\\u2022\\u203a\\u00bb\\u2192-] "
#: Characters that are neither letters, digits, spaces nor the punctuation of prose (and no emoji); those of markup and code.
SYMBOL = "[^\\p{L}\\p{M}\\p{N}\\s.,;:!?'\"()\\-\\u2013\\u2014\\u2026\\u00ab\\u00bb\\u201c\\u201d\\u201e\\u2018\\u2019\\u00bf\\u00a1\\x{1F000}-\\x{1FAFF}]"
TECHNICAL = "[{}\\[\\]<>=_\\\\|#@$%^&*~+/]"
ENCODED, PLAIN = "\\S{30,}", "[\\p{L}\\p{M}\\p{N}\\s]+"
SPELT = "^[\\p{IsLatin}\\p{IsCyrillic}\\p{IsGreek}\\p{M}]+$"
VOWELS = "[aeiouy\\u00e0-\\u00e6\\u00e8-\\u00ef\\u00f2-\\u00f6\\u00f8-\\u00fd\\u0105\\u0119\\u0153\\u0131\\u0430\\u0435\\u0438\\u043e\\u0443\\u044b\\u044d-\\u044f\\u0451\\u0456\\u0457\\u0390\\u03ac-\\u03b1\\u03b5\\u03b7\\u03b9\\u03bf\\u03c5\\u03c9-\\u03ce]"

#: Thresholds of the rules that make a text no prose, with the statistic that each one looks at.
MOST_LISTED = 0.5  # share of units in list items, table rows and short lines
MOST_SYMBOLS = 0.1  # symbols per visible character
MOST_TECHNICAL = 0.04  # characters of markup and code per visible character
MOST_ENCODED = 0.5  # visible characters in runs of 30 and more
LEAST_VARIETY = 2.0  # distinct words by the root of the number of words
LEAST_LONG = 0.05  # share of 7 letters and more among Latin, Greek or Cyrillic words
MOST_VOWELLESS = 0.1  # share of such words of 3 letters and more without a vowel
SOME_VOWELLESS, MOST_DISTINCT, LEAST_COMMON, ENOUGH_WORDS = 0.02, 0.95, 0.06, 20  # fewer of them, but no capitals, and words never come again and are not common
FEW_WORDS = 12  # texts with fewer words are not judged by their words
#: Published thresholds. Rae et al. 2021 ("Scaling Language Models", quality filtering of web pages); the two stop words
#: that they ask of pages of 50 words and more are asked per 50 words here, as texts are short. Penedo et al. 2024
#: ("The FineWeb Datasets"): lines that end in punctuation, lines under 30 characters. Raffel et al. 2020 ("Exploring the
#: Limits of Transfer Learning", C4): braces; lines must end in punctuation and have 5 words. They drop single lines;
#: here a text fails if these are half of its lines or more.
PUBLISHED = {
    "words": (50, 100_000), "mean_word_length": (3, 10), "symbol_words": 0.1, "bullet_lines": 0.9, "ellipsis_lines": 0.3, "alphabetic": 0.8, "stop_words": 2, "stop_words_per": 50,
    "ended_lines": 0.12, "short_lines": 0.67, "short_line": 30, "line_words": 5, "dropped_lines": 0.5,
}
#: Of these one does not decide: segments of a parallel corpus are shorter than web pages.
NOT_DECIDING = ["word_count"]


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _measures(x: Column) -> Column:
    """What the kind of a line depends on, from its facts; each is computed once."""
    s = x["s"]
    pipes = F.startswith(s, F.lit("|")).cast("int") + F.endswith(s, F.lit("|")).cast("int")
    return F.struct(
        s.alias("s"), _count(s, UNIT).alias("units"), F.length(s).alias("length"), x["tokens"].alias("tokens"), (_count(s, CELL) + 1 - pipes).alias("cells"), _count(s, APART).alias("apart"), x["marked"].alias("marked"),
    )


def _line(x: Column) -> Column:
    """A line's measures and `kind`: 0 prose, 1 lead-in, 2 marked, 3 row, 4 short."""
    s, units, cells, apart = x["s"], x["units"], x["cells"], x["apart"]
    quoted = F.contains(s, F.lit('","')) | F.contains(s, F.lit(";"))
    row = (
        ((cells >= 3) & (units <= cells * F.when(quoted, 4.0).otherwise(3.6)))
        | ((apart >= 2) & (units <= (apart + 1) * 7))
        | F.contains(s, F.lit("\t"))
        | (F.substring_index(s, "|", 2) != s)
        | s.rlike(RULER)
    )
    kind = (
        F.when(F.endswith(s, F.lit(":")) & ~s.rlike("[.!?]\\s"), 1)
        .when(x["marked"] & (units <= 7), 2)
        .when(row, 3)
        .when((x["length"] <= 36) & (x["tokens"] <= 6), 4)
        .otherwise(0)
    )
    return F.struct(units.alias("units"), x["length"].alias("length"), x["tokens"].alias("tokens"), kind.alias("kind"), x["marked"].alias("marked"))


def _sum(lines: Column, what: str, keep=None) -> Column:  # noqa: ANN001
    some = F.filter(lines, keep) if keep else lines
    return F.aggregate(some, F.lit(0), lambda a, x: a + x[what])


def _once(df: DataFrame, keep: list[str], new: dict[str, Column]) -> DataFrame:
    """`df` with new columns that are computed once per row: as a generator's output, the optimizer can't copy their
    expressions into every place that uses them, nor into a filter above."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in new.items()]))))


def _line_facts(s: Column) -> Column:
    """A trimmed line and what the published rules ask of it."""
    return F.struct(
        s.alias("s"), F.right(F.rtrim(s, F.lit(CLOSING)), F.lit(1)).isin(SENTENCE_END).alias("ended"), (_count(s, "\\s+") + 1).alias("tokens"), s.rlike(MARK).alias("marked"), (F.endswith(s, F.lit("...")) | F.endswith(s, F.lit("\u2026"))).alias("ellipsis"),
    )


def text_statistics(docs: DataFrame, doc_id: str, text: str, common: list[str], failing: bool = False) -> DataFrame:
    """Statistics of each row's whole text and the rules that it breaks, one row per row of `docs`.

    `doc_id`; `words`; `mean_word_length` (letters per word); `symbol_ratio` (symbols per visible character);
    `end_punct_share` (of the lines that are not blank, those that end like a sentence); `common_share` (of the words,
    those in `common`, in lower case); `bullet_share` (of these lines, those with a list mark); `listed_share`,
    `technical_ratio`, `encoded_ratio`, `variety`, `long_share`, `vowelless_share` as named at the thresholds;
    `published`: the published rules broken; `no_prose`: the rules broken that make a text no prose. With `failing` only
    the rows that break a published rule other than those of `NOT_DECIDING`; the closer look that `no_prose` takes is
    then had at these only.

    Null, empty and blank texts have counts and shares of 0 and break no rule of `no_prose`, nor a published one.
    `common` is a word list of some thousand words at most. All is one map over the rows, in built-in functions.
    """
    clean = F.translate(F.coalesce(F.col("raw_"), F.lit("")), "\u00a0" + INVISIBLE, " ")
    base = _once(docs.select(F.col(doc_id).alias("id_"), F.col(text).alias("raw_")), ["id_"], {"t": clean})
    trimmed = F.filter(F.transform(F.split("t", LINE_END), lambda x: F.regexp_replace(x, EDGES, "")), lambda x: x != "")
    base = _once(base, ["id_", "t"], {
        "facts": F.transform(trimmed, _line_facts), "ws": F.regexp_extract_all(F.lower("t"), F.lit(WORD), F.lit(0)), "seen": F.greatest(F.lit(1), F.length(F.regexp_replace("t", "\\s+", ""))), "signs": F.regexp_replace("t", PLAIN, ""),
    })
    ws, n, lines_n = F.col("ws"), F.size("ws"), F.size("facts")
    facts = lambda keep: _share(F.size(F.filter("facts", keep)), lines_n)
    carried = ["id_", "t", "seen", "signs", "facts", "ws"]
    base = _once(base, carried, {
        "words": n, "mean_word_length": _share(F.length(F.array_join(ws, "")), n), "common_words": F.size(F.filter(ws, lambda w: w.isin(common))),
        "marks": _count(F.col("t"), "#|\\.\\.\\.|\\u2026"), "alphabetic": _count(F.col("t"), "(?<!\\S)(?=\\S*\\p{L})\\S+"), "tokens": _count(F.col("t"), "\\S+"),
        "end_punct_share": facts(lambda x: x["ended"]), "bullet_share": facts(lambda x: x["marked"]), "ellipsis_share": facts(lambda x: x["ellipsis"]),
        "short_share": facts(lambda x: F.length(x["s"]) < PUBLISHED["short_line"]), "dropped_share": facts(lambda x: ~x["ended"] | (x["tokens"] < PUBLISHED["line_words"])),
    })
    base = base.withColumn("common_share", _share(F.col("common_words"), F.col("words")))
    p, some, least = PUBLISHED, lines_n > 0, lambda c: F.greatest(F.lit(1), F.col(c))
    public = {
        "word_count": ~F.col("words").between(*p["words"]),
        "mean_word_length": ~F.col("mean_word_length").between(*p["mean_word_length"]),
        "symbol_words": (F.col("marks") / least("words")) > p["symbol_words"],
        "bullet_lines": F.col("bullet_share") > p["bullet_lines"],
        "ellipsis_lines": F.col("ellipsis_share") > p["ellipsis_lines"],
        "alphabetic": (F.col("alphabetic") / least("tokens")) < p["alphabetic"],
        "stop_words": F.col("common_words") < F.greatest(F.lit(p["stop_words"]), F.col("words") * p["stop_words"] / p["stop_words_per"]),
        "ended_lines": F.col("end_punct_share") <= p["ended_lines"],
        "short_lines": F.col("short_share") >= p["short_lines"],
        "dropped_lines": F.col("dropped_share") >= p["dropped_lines"],
        "braces": F.contains(F.col("signs"), F.lit("{")),
    }
    broken = lambda rs: F.when(some, F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rs.items()]))).otherwise(F.array().cast("array<string>"))
    shown = ["words", "mean_word_length", "common_share", "end_punct_share", "bullet_share"]
    base = _once(base, [*carried, *shown], {"published": broken(public)})
    if failing:
        base = base.where(F.size(F.array_except("published", F.array(*map(F.lit, NOT_DECIDING)))) > 0)
    base = _once(base, [*carried, *shown, "published"], {"lines": F.transform(F.transform("facts", _measures), _line), "alphabetic_words": F.filter("ws", lambda w: w.rlike(SPELT))})
    lines, spelt = F.col("lines"), F.col("alphabetic_words")
    three = F.filter(spelt, lambda w: F.length(w) >= 3)
    body = F.filter(lines, lambda x: x["kind"] != 1)
    stats = _once(base, ["id_", "t", "facts", *shown, "published"], {
        "symbol_ratio": _count(F.col("signs"), SYMBOL) / F.col("seen"),
        "listed": _share(_sum(lines, "units", lambda x: x["kind"] > 1), _sum(body, "units")),
        "all_short": (F.size(body) >= 3) & (_sum(body, "tokens") < F.size(body) * 5) & (_sum(body, "length") < F.size(body) * 36),
        "technical_ratio": _count(F.col("signs"), TECHNICAL) / F.col("seen"),
        "encoded_ratio": F.aggregate(F.regexp_extract_all("t", F.lit(ENCODED), F.lit(0)), F.lit(0), lambda a, x: a + F.length(x)) / F.col("seen"),
        "variety": _share(F.size(F.array_distinct(ws)), F.sqrt(n)),
        "long_share": _share(F.size(F.filter(spelt, lambda w: F.length(w) >= 7)), F.size(spelt)),
        "spelt": F.size(spelt),
        "vowelless_share": _share(F.size(F.filter(three, lambda w: ~w.rlike(VOWELS))), F.size(three)),
    })
    stats = stats.withColumn("listed_share", F.when(F.col("all_short"), F.greatest("listed", F.lit(1.0))).otherwise(F.col("listed")))
    judged = F.col("words") >= FEW_WORDS
    rules = {
        "listed": F.col("listed_share") > MOST_LISTED,
        "symbols": F.col("symbol_ratio") > MOST_SYMBOLS,
        "markup_or_code": F.col("technical_ratio") > MOST_TECHNICAL,
        "encoded": F.col("encoded_ratio") > MOST_ENCODED,
        "repeated": judged & (F.col("variety") < LEAST_VARIETY),
        "function_words": (F.col("spelt") >= FEW_WORDS) & (F.col("long_share") < LEAST_LONG),
        "noise": judged & (F.col("vowelless_share") > MOST_VOWELLESS)
        | (F.col("words") >= ENOUGH_WORDS) & (F.col("vowelless_share") > SOME_VOWELLESS) & (F.col("variety") > MOST_DISTINCT * F.sqrt("words")) & (F.col("common_share") < LEAST_COMMON) & ~F.col("t").rlike("\\p{Lu}"),
        "no_words": F.col("words") == 0,
    }
    return stats.select(
        F.col("id_").alias(doc_id), "words", "mean_word_length", "symbol_ratio", "end_punct_share", "common_share", "bullet_share", "listed_share", "technical_ratio", "encoded_ratio", "variety", "long_share", "vowelless_share",
        broken(rules).alias("no_prose"), "published",
    )
