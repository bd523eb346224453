"""Cleaning layer (CLN-*): edge rows with known results, each mask against
Python's Unicode ``re``, and properties of the whole cleaner on the driver
tables and on random tricky strings."""

import random
import re

import pytest

from conftest import SF001
from mailsift.functions import patterns as P
from mailsift.functions import text as X
from mailsift.sources import tables as tb

# The masked things, as Python patterns.
MASKED = {
    "mask_url": (re.compile(r"\b((?:https?://|www\.)\S+)\b", re.I), " <url> "),
    "mask_email": (re.compile(r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b"), " <email> "),
    "mask_money": (re.compile(r"(?:(?<=\s)|^)(?:[\$£€]\s?\d[\d,]*(?:\.\d+)?|\d[\d,]*(?:\.\d+)?\s?(?:usd|aud|eur|gbp))(?=\s|$)", re.I), " <money> "),
    "mask_phone": (re.compile(r"\b(?:\+?\d{1,3}[\s-]?)?(?:\(?\d{2,4}\)?[\s-]?){2,4}\d{2,4}\b"), " <phone> "),
    "mask_number": (re.compile(r"\b\d+(?:[\.,]\d+)?\b"), " <number> "),
}

EDGE = [
    (None, ""), ("meet at noon", "meet noon"), ("x[@]y[.]com now", "email now"),
    ("hxxp://evil[.]com/a now", "url now"), ("Subject: hi\nbody", ""),
    ("first second\nOn Mon, Bob wrote:\n> q", "first second"), ("id 123456", "id phone"),
    ("id 12345", "id number"), ("on 2024-01-15 x", "on phone x"), ("pay $5 now", "pay money now"),
    ("pay $5. now", "pay number now"), ("10 USD now", "money now"), ("soooo AaA", "soo aaa"),
    ("&lt;b&gt;Hi&lt;/b&gt;", "hi"), ("<a@b.co> hi", "hi"), ("a<br>b", "a b"), ("line\r\nnext", "line next"),
    ("ﬁne ½", "fine number number"), ("ab" * 15 + "a ok", "ok"), ("x at at y", "x at y"),
]


def _run(spark, values, **opts):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    rows = df.select("i", X.clean_text("t", **opts).alias("c")).collect()
    return [r.c for r in sorted(rows, key=lambda r: r.i)]


def test_edge_rows(spark):
    got = _run(spark, [t for t, _ in EDGE])
    assert got == [e for _, e in EDGE]


def test_stopwords_and_stem(spark):
    assert _run(spark, ["The running boxes"], remove_stopwords=True, stem=True) == ["runn box"]


def test_second_pass_not_idempotent(spark):
    assert _run(spark, ["x at at y"], passes=2) == ["x y"]


def _tricky(n, seed=7):
    rnd = random.Random(seed)
    parts = ["at", "dot", " at ", " dot ", "[.]", "(dot)", "[@]", "hxxp://", "https://x.io/p?q=1", "www.a.b",
             "$", "£", "€", "5", "12", "2024-01-15", "+1 (555) 123-4567", "123456", "1,000.50", "usd", "USD",
             " ", "  ", "\n", "\n\n\n", "\t", "\r", "ooo", "AAA", "é", "ß", "İ", "ﬁ", "½", "²", "<br>", "<BR />",
             "<b>", "</p>", "&amp;", "&lt;", "&nbsp;", "​", "\xa0", "a@b.co", "x.y@mail.example.com",
             "> quoted", "On Mon, Bob wrote:", "From: a", "Subject: s", "-- Original Message --", "_", "a_b",
             "word", "Word", "running", "boxes", "the", "ÄÖÜ", "ñ", ".", ",", "!", "-", "(", ")", "'", '"']
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


def _texts(spark):
    docs = [r.text for r in tb.load(spark, SF001, "documents").select("text").collect()]
    return _tricky(400) + docs + [r.html for r in tb.load(spark, SF001, "pages").select("html").collect()]


def test_cleaned_tokens_are_short_lower_case_words(spark):
    for text in _run(spark, _texts(spark)):
        for token in text.split(" ") if text else []:
            assert 0 < len(token) <= P.DROP_LONG_TOKENS
            assert token == token.lower()
            assert all(c == "_" or c.isalnum() for c in token)


def test_word_tokens_match_a_character_scan(spark):
    texts = _texts(spark)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", X.word_tokens("t").alias("c")).collect()}
    for i, text in enumerate(texts):
        exp, token = [], ""
        for c in text.lower() + " ":
            if c == "_" or c.isalnum():
                token += c
            elif token:
                exp.append(token)
                token = ""
        assert got[i] == exp


def test_stop_words_and_stems_change_tokens_one_by_one(spark):
    texts = _texts(spark)
    plain = _run(spark, texts)
    for before, after in zip(plain, _run(spark, texts, remove_stopwords=True, stem=True)):
        exp = []
        for token in filter(None, before.split(" ")):
            if token not in P.CLEAN_STOPWORDS:
                ends = [x for x in P.STEM_SUFFIXES if token.endswith(x) and len(token) - len(x) > 2]
                exp.append(token[: len(token) - len(ends[0])] if ends else token)
        assert after == " ".join(exp)


def test_two_passes_are_one_pass_applied_twice(spark):
    texts = _texts(spark)
    assert _run(spark, texts, passes=2) == _run(spark, _run(spark, texts))


@pytest.mark.parametrize("name,rx,rep", [(name, *made) for name, made in MASKED.items()])
def test_each_mask_matches_python(spark, name, rx, rep):
    values = _tricky(300, seed=11) + [r.text for r in tb.load(spark, SF001, "documents").collect()]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    rows = sorted(df.select("i", getattr(X, name)("t").alias("c")).collect(), key=lambda r: r.i)
    bad = [(values[r.i], r.c) for r in rows if r.c != rx.sub(rep, values[r.i])]
    assert not bad, bad[:3]


def test_cut_reply_and_squash(spark):
    df = spark.createDataFrame([("hello\n\n> quoted\nmore",), ("a \t b\n\n\n\nc  ",), ("no marker",)], "t string")
    cut = [r[0] for r in df.select(X.cut_reply("t")).collect()]
    assert cut == ["hello", "a \t b\n\n\n\nc  ", "no marker"]
    sq = [r[0] for r in df.select(X.squash_whitespace("t")).collect()]
    assert sq[1] == "a b\n\nc"


def test_coerce_text(spark):
    df = spark.createDataFrame([(0.0,), (1.5,), (None,)], "x double")
    assert [r[0] for r in df.select(X.coerce_text(df, "x")).collect()] == ["", "1.5", ""]


def test_clean_plan_has_one_python_step(spark):
    df = spark.createDataFrame([("a",)], "t string").select(X.clean_text("t", passes=2).alias("c"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_drop_non_printable_every_code_point():
    """CLN-2's Python side equals the per-character rule on all code points
    (surrogates cannot arrive through Arrow's UTF-8)."""
    from mailsift.functions.unicode_udf import drop_non_printable

    chars = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)
    want = "".join(c for c in chars if c.isprintable() or c in "\n\t")
    assert drop_non_printable(chars) == want
    assert drop_non_printable("plain text\n\tok") == "plain text\n\tok"


def test_number_mask_equals_re2_emulation(spark):
    """CLN-6e's oracle (non-word characters doubled, RE2, no look-arounds)
    equals the Spark mask on random strings of numbers, separators, word
    characters and non-ASCII digits / letters."""
    import duckdb

    from mailsift.plans.queries_text import _NUMBER_SQL

    frags = ["1", "23", "4.5", "6,7", ".", ",", "..", "a", "_", "é", " ", "\n", "-", "٣", "x9", "9x", "1.2.3",
             "$", "(", ")", "½", "1_000", "0.", ",5"]
    rnd = random.Random(7)
    values = ["".join(rnd.choice(frags) for _ in range(rnd.randint(0, 12))) for _ in range(2000)]
    got = _run_fn(spark, values, X.mask_number)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM (SELECT unnest(range(?)) AS doc_id, unnest(?) AS text)",
                [len(values), values])
    want = dict(con.execute(f"SELECT doc_id, {_NUMBER_SQL} FROM documents").fetchall())
    assert got == [want[i] for i in range(len(values))]


def _run_fn(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.c for r in sorted(df.select("i", fn("t").alias("c")).collect(), key=lambda r: r.i)]


def test_url_mask_equals_re2_emulation(spark):
    """CLN-6a's oracle equals the Spark mask on random URL-like strings."""
    import duckdb

    from mailsift.plans.queries_text import _URL_SQL

    frags = ["http://", "https://", "HTTP://", "hxxp://", "www.", "WWW.", "a", "b1", ".", "/", "!", "?", "=", "&",
             " ", "\n", "é", "_", "-", ":", "www", "<", ">", "(", ")", "x.com", "٣"]
    rnd = random.Random(11)
    values = ["".join(rnd.choice(frags) for _ in range(rnd.randint(0, 10))) for _ in range(2000)]
    got = _run_fn(spark, values, X.mask_url)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM (SELECT unnest(range(?)) AS doc_id, unnest(?) AS text)",
                [len(values), values])
    want = dict(con.execute(f"SELECT doc_id, {_URL_SQL} FROM documents").fetchall())
    assert got == [want[i] for i in range(len(values))]


def test_money_mask_equals_re2_emulation(spark):
    """CLN-6c's oracle equals the Spark mask on random amount-like strings."""
    import duckdb

    from mailsift.plans.queries_text import _MONEY_SQL

    frags = ["$", "£", "€", "5", "10", "1,000", ".5", ".", ",", " ", "  ", "\t", "\n", "usd", "USD", "Eur", "gbp",
             "aud", "x", "a", "-", "٣", " ", "$5.", "2.50", "us"]
    rnd = random.Random(13)
    values = ["".join(rnd.choice(frags) for _ in range(rnd.randint(0, 10))) for _ in range(2000)]
    got = _run_fn(spark, values, X.mask_money)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM (SELECT unnest(range(?)) AS doc_id, unnest(?) AS text)",
                [len(values), values])
    want = dict(con.execute(f"SELECT doc_id, {_MONEY_SQL} FROM documents").fetchall())
    bad = [(values[i], got[i], want[i]) for i in range(len(values)) if got[i] != want[i]]
    assert not bad, bad[:5]


def test_stop_words_equal_spark_ml(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert list(P.english_stopwords()) == list(StopWordsRemover.loadDefaultStopWords("english"))


def test_guards_and_second_pass_change_nothing(spark):
    """Steps that run only where they can match, and the second pass that stops early,
    against the same patterns run on every value."""
    import random

    from pyspark.sql import functions as F

    from mailsift.functions import patterns as P
    from mailsift.functions import text as X

    rnd = random.Random(5)
    bits = ["[@]", "[.]", "(DoT)", " dot ", " At ", " AT ", "at at", "On x wrote:", "\n> q", "\nSent: b", "\n--Original Message--", "$ 5", "7 usd", "9USD", "8 uſd",
            "12.5", "\U0001d7d9", "٣", "K", "İ", "WWW.a.b", "hXXp://c", "a@b.c", "+1 22 333 44", "aaA", "...", "x", " ", "\n", "a" * 31, "3", "<br>", "&amp;", "_"]
    texts = ["", " at ", "a dot b at c", "one two", "aaA bb"] + ["".join(rnd.choice(bits) + rnd.choice(["", " ", "\n"]) for _ in range(rnd.randrange(1, 14))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)

    def plain(c, first):
        ws, w = P.WS, P.W
        if first:
            c = F.regexp_replace(F.regexp_replace(X.normalize_unicode_html(c), P.BR_TAG, "\n"), P.ANY_TAG, " ")
        c = F.regexp_replace(c, P.HXXP, "http")
        c = F.regexp_replace(F.regexp_replace(c, P.DOT_OBFUSCATION, "."), r"\[@\]|" + ws + "+(?iu:at)" + ws + "+", "@")
        if first:
            parts = F.split(c, P.REPLY_SPLITTER, 2)
            c = F.when(F.size(parts) == 2, X.strip_outer_ws(parts[0])).otherwise(parts[0])
        c = F.when(c.rlike(r"(?i)://|www\."), F.regexp_replace(c, P.URL, " <url> ")).otherwise(c)
        c = F.regexp_replace(c, P.EMAIL, " <email> ")
        c = F.when(c.rlike(r"[\$£€]|(?i:usd|aud|eur|gbp)"), F.regexp_replace(c, P.MONEY, " <money> ")).otherwise(c)
        c = F.regexp_replace(F.regexp_replace(c, P.PHONE, " <phone> "), "(?<!" + w + r")\p{Nd}+(?:[.,]\p{Nd}+)?(?!" + w + ")", " <number> ")
        return X.join_tokens(X.drop_long(X.word_tokens(X.cap_repeats(c))))

    got = df.select("t", plain(F.col("t"), True).alias("want"), X.clean_text("t").alias("once"), X.clean_text("t", passes=2).alias("twice"))
    rows = got.select("*", plain(F.col("want"), False).alias("again")).collect()
    assert len(rows) == len(texts)
    assert [r.t for r in rows if r.once != r.want] == []
    assert [r.t for r in rows if r.twice != r.again] == []
    assert any(r.twice != r.once for r in rows)
