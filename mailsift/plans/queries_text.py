"""Text queries: projections (PRJ-*) and the cleaning layer (CLN-*).

Steps built from look-around-free patterns have exact DuckDB oracles over
the whole tables (RE2 reads the ``W`` / ``WS`` classes like Java). The masks
need look-arounds and the NFKC / entity steps need Python, so those queries
carry no oracle; ``tests/test_clean.py`` checks them against a brute-force
Python cleaner on the small fixture.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift.functions import patterns as P
from mailsift.functions import text as X
from mailsift.plans.registry import register, sql_list
from mailsift.sources import tables as tb

WS = P.WS
NL = "chr(10)"


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '\\A{WS}+|{WS}+\\z', '', 'g')"


def _tokens_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> '')"


def _docs(spark, d):
    return tb.load(spark, d, "documents")


# ---------------------------------------------------------------- projections
@register("prj1_project", tb.with_views("SELECT row_id, body, y FROM mail", "mail"))
def prj1_project(spark, d):
    return tb.mail(spark, d).select("row_id", "body", "y")


@register("prj2_dropna_subset", tb.with_views(
    "SELECT conv_id, turn, body, label FROM mail_subject WHERE body IS NOT NULL AND label IS NOT NULL",
    "mail_subject"))
def prj2_dropna_subset(spark, d):
    return tb.mail_subject(spark, d).select("conv_id", "turn", "body", "label").dropna(subset=["body", "label"])


@register("prj3_subject_body_space", tb.with_views(
    "SELECT conv_id, turn, coalesce(subject, '') || ' ' || coalesce(body, '') AS email_text FROM mail_subject",
    "mail_subject"))
def prj3_subject_body_space(spark, d):
    m = tb.mail_subject(spark, d)
    return m.select("conv_id", "turn", X.subject_body_space("subject", "body").alias("email_text"))


@register("prj4_subject_body_block", tb.with_views(
    f"SELECT conv_id, turn, {_strip_sql(f'coalesce(subject, {chr(39)}{chr(39)}) || {NL} || {NL} || coalesce(body, {chr(39)}{chr(39)})')}"
    " AS text FROM mail_subject", "mail_subject"))
def prj4_subject_body_block(spark, d):
    m = tb.mail_subject(spark, d)
    return m.select("conv_id", "turn", X.subject_body_block("subject", "body").alias("text"))


@register("prj5_lower", "SELECT doc_id, lower(text) AS text FROM documents")
def prj5_lower(spark, d):
    return _docs(spark, d).select("doc_id", F.lower("text").alias("text"))


@register("prj6_filter_class", tb.with_views("SELECT row_id, body FROM mail WHERE y = 1", "mail"))
def prj6_filter_class(spark, d):
    return tb.mail(spark, d).filter(F.col("y") == 1).select("row_id", "body")


@register("prj9_preview", "SELECT doc_id, substring(text, 1, 300) AS preview FROM documents")
def prj9_preview(spark, d):
    return _docs(spark, d).select("doc_id", X.preview("text").alias("preview"))


@register("prj10_round_half_even", tb.with_views(
    "SELECT row_id, round_even(conf / 3, 4) AS conf4 FROM pred", "pred"))
def prj10_round_half_even(spark, d):
    return tb.pred(spark, d).select("row_id", F.bround(F.col("conf") / 3, 4).alias("conf4"))


@register("prj11_head", tb.with_views("SELECT row_id, y FROM mail ORDER BY row_id LIMIT 10", "mail"))
def prj11_head(spark, d):
    return tb.mail(spark, d).select("row_id", "y").orderBy("row_id").limit(10)


@register("prj11_tail", tb.with_views("SELECT row_id, y FROM mail ORDER BY row_id DESC LIMIT 5", "mail"))
def prj11_tail(spark, d):
    return tb.mail(spark, d).select("row_id", "y").orderBy(F.col("row_id").desc()).limit(5)


# ---------------------------------------------------------------- cleaning
@register("cln0_coerce_text", tb.with_views(
    "SELECT row_id, CASE WHEN label_num IS NULL OR label_num = 0 THEN '' ELSE CAST(label_num AS VARCHAR) END "
    "AS label_text FROM mail_raw_label", "mail_raw_label"))
def cln0_coerce_text(spark, d):
    df = tb.mail_raw_label(spark, d)
    return df.select("row_id", X.coerce_text(df, "label_num").alias("label_text"))


@register("cln1_normalize_unicode_html")
def cln1_normalize_unicode_html(spark, d):
    from mailsift.functions.unicode_udf import normalize_unicode_html
    return _docs(spark, d).select("doc_id", normalize_unicode_html(F.col("text")).alias("text"))


_NON_PRINTABLE_RE2 = ("[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x{9f}\\p{Cf}\\p{Co}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
                      "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]")


@register("cln2_drop_nonprintable",
          f"SELECT doc_id, regexp_replace(text, '{_NON_PRINTABLE_RE2}', '', 'g') AS text FROM documents")
def cln2_drop_nonprintable(spark, d):
    return _docs(spark, d).select("doc_id", F.regexp_replace("text", P.NON_PRINTABLE, "").alias("text"))


@register("cln3a_decode_entities")
def cln3a_decode_entities(spark, d):
    from mailsift.functions.unicode_udf import normalize_unicode_html
    return tb.load(spark, d, "pages").select("page_id", normalize_unicode_html(F.col("html")).alias("html"))


@register("cln3b_br_to_newline",
          f"SELECT page_id, regexp_replace(html, '(?i)<{WS}*br{WS}*/?>', {NL}, 'g') AS html FROM pages")
def cln3b_br_to_newline(spark, d):
    return tb.load(spark, d, "pages").select("page_id", X.replace_br("html").alias("html"))


@register("cln3c_strip_tags", "SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS html FROM pages")
def cln3c_strip_tags(spark, d):
    return tb.load(spark, d, "pages").select("page_id", X.strip_tags("html").alias("html"))


@register("cln3_strip_html")
def cln3_strip_html(spark, d):
    return tb.load(spark, d, "pages").select("page_id", X.strip_html("html", decode=True).alias("text"))


_DEOB_SQL = ("regexp_replace(regexp_replace(regexp_replace(text, '(?i)hx{2}p', 'http', 'g'), "
             f"'(?i)\\[\\.\\]|\\(dot\\)|{WS}+dot{WS}+', '.', 'g'), '(?i)\\[@\\]|{WS}+at{WS}+', '@', 'g')")


@register("cln4_deobfuscate", f"SELECT doc_id, {_DEOB_SQL} AS text FROM documents")
def cln4_deobfuscate(spark, d):
    return _docs(spark, d).select("doc_id", X.deobfuscate("text").alias("text"))


_REPLY_RE2 = P.REPLY_SPLITTER.replace("(?iumd)", "(?im)")


@register("cln5_cut_reply", f"""
SELECT doc_id, CASE WHEN regexp_matches(text, '{_REPLY_RE2}')
                    THEN {_strip_sql(f"regexp_split_to_array(text, '{_REPLY_RE2}')[1]")} ELSE text END AS text
FROM documents""")
def cln5_cut_reply(spark, d):
    return _docs(spark, d).select("doc_id", X.cut_reply("text").alias("text"))


# CLN-6a without look-arounds: a URL runs to the last word character of its
# non-space run (the closing boundary can only fall there), so only its left
# context needs the doubling of non-word characters (see CLN-6e below).
_NWSW = "[^\\p{L}\\p{N}_" + P.WS_CLASS + "]"
_URL_SQL = (
    "replace(regexp_replace(regexp_replace(regexp_replace(text, '([^\\p{L}\\p{N}_])', '\\1\\1', 'g'), "
    "'(^|[^\\p{L}\\p{N}_])(?i:https?::////|www\\.\\.)(?:[\\p{L}\\p{N}_]|" + _NWSW + "{2})*[\\p{L}\\p{N}_]', "
    "'\\1\ua66e', 'g'), '([^\\p{L}\\p{N}_])[^\\p{L}\\p{N}_]', '\\1', 'g'), '\ua66e', ' <url> ')")


# CLN-6c without look-arounds: both contexts of an amount are whitespace, so
# whitespace is doubled (the one optional blank inside an amount becomes a
# pair), the amount becomes a sentinel, and the doubling is undone.
_WSC = "[" + P.WS_CLASS + "]"
_AMOUNT = ("(?:[\\$£€](?:" + _WSC + "{2})?\\p{Nd}[\\p{Nd},]*(?:\\.\\p{Nd}+)?"
           "|\\p{Nd}[\\p{Nd},]*(?:\\.\\p{Nd}+)?(?:" + _WSC + "{2})?(?i:usd|aud|eur|gbp))")
_MONEY_SQL = (
    "replace(regexp_replace(regexp_replace(regexp_replace(text, '(" + _WSC + ")', '\\1\\1', 'g'), "
    "'(^|" + _WSC + ")" + _AMOUNT + "(" + _WSC + "|$)', '\\1\ua66e\\2', 'g'), "
    "'(" + _WSC + ")" + _WSC + "', '\\1', 'g'), '\ua66e', ' <money> ')")


def _mask_query(fn):
    def q(spark, d):
        return _docs(spark, d).select("doc_id", fn("text").alias("text"))
    return q


register("cln6a_mask_url", f"SELECT doc_id, {_URL_SQL} AS text FROM documents")(_mask_query(X.mask_url))
register("cln6b_mask_email")(_mask_query(X.mask_email))
register("cln6c_mask_money", f"SELECT doc_id, {_MONEY_SQL} AS text FROM documents")(_mask_query(X.mask_money))
register("cln6d_mask_phone")(_mask_query(X.mask_phone))
# CLN-6e without look-arounds (RE2): every non-word character is doubled, so
# the character after one number can be consumed as its right context and
# its copy still be the left context of the next; digits become a word-class
# sentinel, the doubling is undone, then the sentinel becomes the mask.
_NW = "[^\\p{L}\\p{N}_]"
_NUMBER_SQL = (
    "replace(regexp_replace(regexp_replace(regexp_replace(text, '(" + _NW + ")', '\\1\\1', 'g'), "
    "'(^|" + _NW + ")\\p{Nd}+(?:(?:\\.\\.|,,)\\p{Nd}+)?(" + _NW + "|$)', '\\1\ua66e\\2', 'g'), "
    "'(" + _NW + ")" + _NW + "', '\\1', 'g'), '\ua66e', ' <number> ')")
register("cln6e_mask_number", f"SELECT doc_id, {_NUMBER_SQL} AS text FROM documents")(_mask_query(X.mask_number))


@register("cln7_cap_repeats", f"""
SELECT doc_id, array_to_string(list_filter(chars, lambda c, i: i <= 2 OR c = {NL}
                                           OR NOT (c = chars[i - 1] AND c = chars[i - 2])), '') AS text
FROM (SELECT doc_id, string_split(text, '') AS chars FROM documents)""")
def cln7_cap_repeats(spark, d):
    return _docs(spark, d).select("doc_id", X.cap_repeats("text").alias("text"))


@register("cln8_word_tokens", f"SELECT doc_id, array_to_string({_tokens_sql('text')}, ' ') AS tokens FROM documents")
def cln8_word_tokens(spark, d):
    return _docs(spark, d).select("doc_id", X.join_tokens(X.word_tokens("text")).alias("tokens"))


_LONG_SQL = f"list_filter({_tokens_sql('text')}, lambda t: length(t) <= 30)"


@register("cln9_drop_long_tokens", f"SELECT doc_id, array_to_string({_LONG_SQL}, ' ') AS tokens FROM documents")
def cln9_drop_long_tokens(spark, d):
    return _docs(spark, d).select("doc_id", X.join_tokens(X.drop_long(X.word_tokens("text"))).alias("tokens"))


_SW_SQL = f"list_filter({_LONG_SQL}, lambda t: t NOT IN {sql_list(P.CLEAN_STOPWORDS)})"


@register("cln10_drop_stopwords", f"SELECT doc_id, array_to_string({_SW_SQL}, ' ') AS tokens FROM documents")
def cln10_drop_stopwords(spark, d):
    toks = X.drop_stopwords(X.drop_long(X.word_tokens("text")))
    return _docs(spark, d).select("doc_id", X.join_tokens(toks).alias("tokens"))


def _stem_sql(t: str) -> str:
    arms = " ".join(f"WHEN suffix({t}, '{s}') AND length({t}) > {len(s) + 2} THEN left({t}, length({t}) - {len(s)})"
                    for s in P.STEM_SUFFIXES)
    return f"CASE {arms} ELSE {t} END"


@register("cln11_stem_tokens",
          f"SELECT doc_id, array_to_string(list_transform({_SW_SQL}, lambda t: {_stem_sql('t')}), ' ') AS tokens "
          "FROM documents")
def cln11_stem_tokens(spark, d):
    toks = X.stem_tokens(X.drop_stopwords(X.drop_long(X.word_tokens("text"))))
    return _docs(spark, d).select("doc_id", X.join_tokens(toks).alias("tokens"))


@register("cln12_join_tokens", f"SELECT item_id, array_to_string({_tokens_sql('text')}, ' ') AS tokens FROM benchmark")
def cln12_join_tokens(spark, d):
    return tb.load(spark, d, "benchmark").select("item_id", X.join_tokens(X.word_tokens("text")).alias("tokens"))


@register("cln13_clean_text")
def cln13_clean_text(spark, d):
    return tb.mail(spark, d).select("row_id", X.clean_text("body").alias("body"), "y")


@register("cln13_clean_text_stem_stopwords")
def cln13_clean_text_stem_stopwords(spark, d):
    return _docs(spark, d).select("doc_id", X.clean_text("text", remove_stopwords=True, stem=True).alias("text"))


@register("cln14_squash_whitespace", f"""
SELECT doc_id, {_strip_sql(f"regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', {NL} || {NL}, 'g')")}
       AS text FROM documents""")
def cln14_squash_whitespace(spark, d):
    return _docs(spark, d).select("doc_id", X.squash_whitespace("text").alias("text"))


@register("cln15_simple_tokens", f"SELECT doc_id, array_to_string({_tokens_sql('text')}, ' ') AS tokens FROM documents")
def cln15_simple_tokens(spark, d):
    return _docs(spark, d).select("doc_id", X.join_tokens(X.simple_tokens("text")).alias("tokens"))


@register("cln16_clean_twice")
def cln16_clean_twice(spark, d):
    return _docs(spark, d).select("doc_id", X.clean_text("text", passes=2).alias("text"))
