"""Column functions for text: the cleaning layer (CLN-*) and text projections.

Every function takes and returns a ``Column`` so it composes inside one
``select`` and stays in whole-stage code generation; only
``normalize_unicode_html`` (one Arrow hop) leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsift.functions import patterns as P
from mailsift.functions.unicode_udf import normalize_unicode_html


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --------------------------------------------------------------------------
# CLN-0: coercion of non-string input
# --------------------------------------------------------------------------
def coerce_text(df: DataFrame, name: str) -> Column:
    """``str(x or "")`` by column type: null / 0 / False / "" become ``""``."""
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, T.StringType):
        return F.coalesce(c, F.lit(""))
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True")).otherwise(F.lit(""))
    if isinstance(dtype, T.NumericType):
        return F.when(c.isNull() | (c == 0), F.lit("")).otherwise(c.cast("string"))
    return F.coalesce(c.cast("string"), F.lit(""))


# --------------------------------------------------------------------------
# Individual cleaning steps
# --------------------------------------------------------------------------
def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a one-element
    ``transform``). Referring to a column several times inside a CASE would
    otherwise re-evaluate the whole expression chain feeding it."""
    return F.transform(F.array(value), body)[0]


def _holds(v: Column, words: Sequence[str]) -> Column:
    """Whether ``v`` holds one of the lower-case ASCII ``words`` in any case. A search
    for plain bytes: a regex that may begin at any character costs many times that."""
    low = F.lower(v)
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def _guarded(col, words: Sequence[str], pattern: str, repl: str) -> Column:
    """``regexp_replace`` run only on values that can match (they hold one of
    ``words``); the value is bound once."""
    return _let(_c(col), lambda v: F.when(_holds(v, words), F.regexp_replace(v, pattern, repl)).otherwise(v))


def replace_br(col) -> Column:
    """CLN-3b: ``<br>`` variants become a newline."""
    return _guarded(col, ["<"], P.BR_TAG, "\n")


def strip_tags(col) -> Column:
    """CLN-3c: any ``<...>`` becomes a space."""
    return _guarded(col, ["<"], P.ANY_TAG, " ")


def strip_html(col, decode: bool = False) -> Column:
    """CLN-3 (entity decode optional, it needs the Arrow step)."""
    c = normalize_unicode_html(_c(col)) if decode else _c(col)
    return strip_tags(replace_br(c))


def deobfuscate(col) -> Column:
    """CLN-4: hxxp -> http; [.] (dot) ' dot ' -> '.'; [@] ' at ' -> '@'."""
    c = _guarded(col, P.HXXP_HINT, P.HXXP, "http")
    c = _guarded(c, P.DOT_HINT, P.DOT_OBFUSCATION, ".")
    # "@" in place of "[@]" neither makes nor breaks a word between blanks.
    return F.regexp_replace(F.replace(c, F.lit("[@]"), F.lit("@")), P.AT_WORD, "@")


def _deobfuscate_cleaned(c: Column) -> Column:
    """CLN-4 on cleaner output, which holds lower-case words and single spaces."""
    c = _guarded(c, P.HXXP_HINT, P.HXXP, "http")
    return F.replace(F.replace(c, F.lit(" dot "), F.lit(".")), F.lit(" at "), F.lit("@"))


def strip_outer_ws(col) -> Column:
    """Python ``str.strip()``: Unicode whitespace off both ends."""
    return F.regexp_replace(_c(col), P.OUTER_WS, "")


def cut_reply(col) -> Column:
    """CLN-5: keep the text before the first reply/forward marker, stripped.
    Without a marker ``split`` returns the whole text as its only part."""
    def cut(v):
        first = _let(F.split(v, P.REPLY_SPLITTER, 2),
                     lambda parts: F.when(F.size(parts) == 2, strip_outer_ws(parts[0])).otherwise(parts[0]))
        return F.when(v.rlike(P.REPLY_HINT), first).otherwise(v)
    return _let(_c(col), cut)


def mask_url(col) -> Column:
    return _guarded(col, P.URL_HINT, P.URL, " <url> ")


def mask_email(col) -> Column:
    return _guarded(col, P.EMAIL_HINT, P.EMAIL, " <email> ")


def mask_money(col) -> Column:
    return _guarded(col, P.MONEY_HINT, P.MONEY, " <money> ")


def mask_phone(col) -> Column:
    return F.regexp_replace(_c(col), P.PHONE, " <phone> ")


def mask_number(col) -> Column:
    return F.regexp_replace(_c(col), P.NUMBER, " <number> ")


def mask_all(col) -> Column:
    """CLN-6a..e in order: url, email, money, phone, number (the last three need a digit)."""
    return _let(mask_email(mask_url(col)),
                lambda v: F.when(v.rlike(P.DIGIT), mask_number(mask_phone(mask_money(v)))).otherwise(v))


def cap_repeats(col) -> Column:
    """CLN-7: runs of one character (not newline) capped at two."""
    return F.regexp_replace(_c(col), P.REPEAT_RUN, P.REPEAT_KEEP)


def word_tokens(col) -> Column:
    """CLN-8: lower-case, split on non-word runs, drop empty strings."""
    return F.filter(F.split(F.lower(_c(col)), P.TOKEN_SPLIT), lambda t: t != "")


def drop_long(tokens, limit: int = P.DROP_LONG_TOKENS) -> Column:
    """CLN-9: drop tokens longer than ``limit`` code points (0 = keep all)."""
    if not limit:
        return _c(tokens)
    return F.filter(_c(tokens), lambda t: F.length(t) <= limit)


def drop_stopwords(tokens, words: Sequence[str] = tuple(P.CLEAN_STOPWORDS)) -> Column:
    """CLN-10: remove stop words."""
    return F.filter(_c(tokens), lambda t: ~t.isin(*words))


def stem_token(t: Column) -> Column:
    """CLN-11 on one token: first suffix with ``len(t) > len(suffix) + 2``."""
    out = None
    for suf in P.STEM_SUFFIXES:
        cond = t.endswith(suf) & (F.length(t) > len(suf) + 2)
        cut = t.substr(F.lit(1), F.length(t) - len(suf))
        out = F.when(cond, cut) if out is None else out.when(cond, cut)
    return out.otherwise(t)


def stem_tokens(tokens) -> Column:
    return F.transform(_c(tokens), stem_token)


def explode_values(values) -> Column:
    """``explode`` for a computed array. Plain ``explode`` makes Catalyst infer
    a ``size(array) > 0`` filter on its input and push it towards the scan,
    which evaluates the whole array expression (e.g. the cleaner) twice.
    ``explode_outer`` infers nothing; callers drop its null row with
    ``.filter(col.isNotNull())``."""
    return F.explode_outer(_c(values))


def join_tokens(tokens) -> Column:
    """CLN-12."""
    return F.array_join(_c(tokens), " ")


def squash_whitespace(col) -> Column:
    """CLN-14: blanks/tabs -> one space, 3+ newlines -> 2, stripped."""
    c = F.regexp_replace(_c(col), P.BLANK_RUN, " ")
    c = F.regexp_replace(c, P.NEWLINE_RUN, "\n\n")
    return strip_outer_ws(c)


def simple_tokens(col) -> Column:
    """CLN-15: the uncleaned path -- lower, strip, split on non-word runs."""
    return word_tokens(F.coalesce(_c(col), F.lit("")))


# --------------------------------------------------------------------------
# CLN-13 / CLN-16: the whole cleaner
# --------------------------------------------------------------------------
def _one_pass(c: Column, *, remove_stopwords: bool, stem: bool, drop_long_tokens: int,
              unicode_step: bool, markup_steps: bool = True) -> Column:
    if unicode_step:
        c = normalize_unicode_html(c)
    if markup_steps:
        c = strip_tags(replace_br(c))
        c = deobfuscate(c)
        c = cut_reply(c)
    else:
        c = _deobfuscate_cleaned(c)
    c = mask_all(c)
    c = cap_repeats(c)
    toks = word_tokens(c)
    toks = drop_long(toks, drop_long_tokens)
    if remove_stopwords:
        toks = drop_stopwords(toks)
    if stem:
        toks = stem_tokens(toks)
    return join_tokens(toks)


def clean_text(col, *, remove_stopwords: bool = False, stem: bool = False,
               drop_long_tokens: int = P.DROP_LONG_TOKENS, passes: int = 1, normalize: bool = True) -> Column:
    """Clean a string column (input already coerced, see ``coerce_text``).

    ``passes=2`` reproduces the tokenizer that cleans an already cleaned body
    again with default options (CLN-16). A cleaned value holds only word
    characters and single spaces, so in later passes NFKC, the printable
    filter and entity decoding are the identity (no Arrow step), and so are
    the tag, ``<br>`` and reply-marker steps (each needs one of ``< > : -``).
    For the same reason ``normalize=False`` skips the Arrow step for input
    that is already cleaner output.
    """
    c = F.coalesce(_c(col), F.lit(""))
    c = _one_pass(c, remove_stopwords=remove_stopwords, stem=stem,
                  drop_long_tokens=drop_long_tokens, unicode_step=normalize)
    for _ in range(passes - 1):
        if 0 < drop_long_tokens <= P.DROP_LONG_TOKENS:
            c = _let(c, _clean_again)
        else:
            c = _one_pass(c, remove_stopwords=False, stem=False,
                          drop_long_tokens=P.DROP_LONG_TOKENS, unicode_step=False, markup_steps=False)
    return c


def _clean_again(v: Column) -> Column:
    """A later pass over cleaner output without long tokens: where the steps before
    the tokens change nothing, the tokens are those that ``v`` is joined of."""
    steps = cap_repeats(mask_all(_deobfuscate_cleaned(v)))
    return _let(steps, lambda c: F.when(c == v, v).otherwise(join_tokens(drop_long(word_tokens(c)))))


def clean_tokens(col, **opts) -> Column:
    """Tokens of the cleaned text (the cleaner's output split on spaces)."""
    return F.filter(F.split(clean_text(col, **opts), " "), lambda t: t != "")


# --------------------------------------------------------------------------
# Text projections (PRJ-3/4/5/9) and profiling helpers (AGG-2/4)
# --------------------------------------------------------------------------
def subject_body_space(subject, body) -> Column:
    """PRJ-3: ``subject.fillna('') + ' ' + body.fillna('')``."""
    return F.concat(F.coalesce(_c(subject), F.lit("")), F.lit(" "), F.coalesce(_c(body), F.lit("")))


def subject_body_block(subject, body) -> Column:
    """PRJ-4: subject, blank line, body; outer whitespace stripped."""
    return strip_outer_ws(F.concat(F.coalesce(_c(subject), F.lit("")), F.lit("\n\n"),
                                   F.coalesce(_c(body), F.lit(""))))


def preview(col, n: int = 300) -> Column:
    """PRJ-9: first ``n`` code points."""
    return F.substring(_c(col), 1, n)


def special_char_count(col) -> Column:
    """AGG-2: characters that are neither alphanumeric nor whitespace."""
    return F.length(F.regexp_replace(_c(col), P.ALNUM_OR_WS, ""))


def whitespace_words(col) -> Column:
    """``str.split()``: whitespace-separated words, empties dropped."""
    return F.filter(F.split(_c(col), P.WS + "+"), lambda t: t != "")


def alpha_words(col) -> Column:
    """Whitespace words made only of letters (``str.isalpha``)."""
    return F.filter(whitespace_words(col), lambda t: t.rlike(P.ALPHA_WORD))
