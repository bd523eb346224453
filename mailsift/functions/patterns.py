"""Regular expressions and word lists used by the cleaning layer.

Everything here is written for Java's ``java.util.regex`` (what Spark's
``regexp_replace`` / ``split`` / ``rlike`` use), chosen so the result equals
Python's Unicode ``re`` module on the same input:

* ``W``  -- a word character, ``[\\p{L}\\p{N}_]`` (Java's ``\\w`` is ASCII only).
* ``WS`` -- a whitespace character as ``str.isspace`` defines it.
* ``B``  -- a word boundary built from ``W`` with look-arounds (Java's ``\\b``
  disagrees with ``W`` on some characters).
* ``(?d)`` (UNIX_LINES) makes ``\\n`` the only line end, ``(?iu)`` gives
  Unicode-aware case folding.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Character classes (building blocks, concatenated textually below).
# ---------------------------------------------------------------------------
W_CLASS = r"\p{L}\p{N}_"
W = "[" + W_CLASS + "]"
NOT_W = "[^" + W_CLASS + "]"
WS_CLASS = r"\t-\r\x1c-\x1f\x{85}\p{Z}"
WS = "[" + WS_CLASS + "]"
NWS = "[^" + WS_CLASS + "]"
B = "(?:(?<=" + W + ")(?!" + W + ")|(?<!" + W + ")(?=" + W + "))"

# ---------------------------------------------------------------------------
# Cleaning patterns and replacements. These must equal the
# behaviour of the original cleaning rules, so they are stated here together
# and in the order the cleaner applies them.
# ---------------------------------------------------------------------------
# CLN-2: characters Python does not consider printable, except space, \n, \t.
NON_PRINTABLE = r"[\p{C}\p{Z}&&[^ \n\t]]"
# CLN-3b: <br>, <br/>, < BR / > ... become a newline.
BR_TAG = "(?iu)<" + WS + "*br" + WS + "*/?>"
# CLN-3c: any remaining tag becomes one space (spans newlines).
ANY_TAG = "<[^>]+>"
# CLN-4: de-obfuscation.
HXXP = "(?iu)hx{2}p"
# Case-insensitivity is scoped to the words: whitespace has no case, and a
# case-folding test of every whitespace-class position costs ~20 %.
DOT_OBFUSCATION = r"\[\.\]|\((?iu:dot)\)|" + WS + "+(?iu:dot)" + WS + "+"
AT_WORD = WS + "+(?iu:at)" + WS + "+"
# CLN-5: reply / forward markers (multi-line, case-insensitive).
REPLY_SPLITTERS = [
    r"^>+ .*",
    r"^On .+ wrote:" + WS + "*$",
    r"^-{2,}" + WS + "*Original Message" + WS + "*-{2,}" + WS + "*$",
    r"^From:" + WS + ".*$",
    r"^Sent:" + WS + ".*$",
    r"^Subject:" + WS + ".*$",
]
REPLY_SPLITTER = "(?iumd)(?:" + "|".join(REPLY_SPLITTERS) + ")"
# What every marker begins with, under the same flags.
REPLY_HINT = "(?iumd)^(?:>|On |--|From:|Sent:|Subject:)"
OUTER_WS = r"\A" + WS + "+|" + WS + r"+\z"
# CLN-6a..e: masks, applied in this order.
# A URL starts with "h" or "w" (word characters): the leading boundary is
# "no word character before".
URL = "(?iud)(?<!" + W + ")((?:https?://|www\\.)" + NWS + "+)" + B
URL_HINT = ["://", "www."]
EMAIL = B + "[" + W_CLASS + ".+-]+@[" + W_CLASS + "-]+(?:\\.[" + W_CLASS + "-]+)+" + B
MONEY = (
    "(?iud)(?:(?<=" + WS + ")|^)"
    + r"(?:[\$£€]" + WS + r"?\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?"
    + r"|\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?" + WS + "?(?:usd|aud|eur|gbp))"
    + "(?=" + WS + "|$)"
)
# A phone match starts with "+", "(" or a digit; the look-ahead rejects other
# positions before the (costlier) boundary test.
PHONE = (
    "(?d)(?=[+(\\p{Nd}])" + B
    + r"(?:\+?\p{Nd}{1,3}(?:" + WS + "|-)?)?"
    + r"(?:\(?\p{Nd}{2,4}\)?(?:" + WS + "|-)?){2,4}"
    + r"\p{Nd}{2,4}" + B
)
# A number starts and ends with a digit (a word character), so its boundaries
# are "no word character before" / "no word character after"; the look-ahead
# rejects other positions before the (costlier) look-behind.
NUMBER = r"(?=\p{Nd})(?<!" + W + r")\p{Nd}+(?:[.,]\p{Nd}+)?(?!" + W + ")"
# What a match must hold, in lower case (only ASCII letters have these lower cases).
EMAIL_HINT = ["@"]
MONEY_HINT = ["$", "£", "€", "usd", "aud", "eur", "gbp"]
HXXP_HINT = ["hxxp"]
DOT_HINT = ["[.]", "dot"]
DIGIT = r"\p{Nd}"
MASKS = [
    (URL, " <url> "),
    (EMAIL, " <email> "),
    (MONEY, " <money> "),
    (PHONE, " <phone> "),
    (NUMBER, " <number> "),
]
# CLN-7: a run of 3+ equal characters (never newlines) is cut to 2.
REPEAT_RUN = r"(?d)(.)\1{2,}"
REPEAT_KEEP = "$1$1"
# CLN-8: token separator.
TOKEN_SPLIT = NOT_W + "+"
# CLN-14: optional whitespace squash.
BLANK_RUN = r"[ \t]+"
NEWLINE_RUN = r"\n{3,}"

# CLN-9 default length limit, CLN-10 stop words, CLN-11 suffixes.
DROP_LONG_TOKENS = 30
CLEAN_STOPWORDS = [
    "a", "an", "the", "and", "or", "but", "if", "then", "else", "for", "to", "of", "in", "on", "at",
    "with", "by", "from", "is", "are", "was", "were", "be", "been", "being", "as", "it", "this",
    "that", "these", "those", "i", "you", "he", "she", "we", "they", "me", "him", "her", "them",
    "my", "your", "our", "their", "so",
]
STEM_SUFFIXES = ["ing", "edly", "ed", "ly", "es", "s"]

# Label synonyms (LBL-1 / LBL-2).
PHISHING_WORDS = ["phish", "phishing", "spam", "malicious", "fraud", "scam", "bad"]
LEGIT_WORDS = ["legit", "legitimate", "ham", "benign", "clean", "safe", "good"]
PHISHING_FLAGS = ["1", "true", "yes"]
LEGIT_FLAGS = ["0", "false", "no"]
PHISHING = "phishing"
LEGITIMATE = "legitimate"
# Fallback id -> name map of the scoring endpoint (LBL-6).
DEFAULT_ID2LABEL = {0: LEGITIMATE, 1: PHISHING}

# AGG-2 / PRJ-4: "neither alphanumeric nor whitespace" and outer whitespace.
ALNUM_OR_WS = r"[\p{L}\p{N}" + WS_CLASS + "]"
ALPHA_WORD = r"^\p{L}+$"


# The default English stop words of Spark ML's StopWordsRemover,
# in its order. Stated here, so that neither the import nor a Python worker
# needs a JVM or a file; a test holds them against Spark's own list.
ENGLISH_STOPWORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is are
was were be been being have has had having do does did doing a an the and but if or because as until while of
at by for with about against between into through during before after above below to from up down in out on
off over under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don should now i'll you'll he'll she'll
we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't
mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split())


def english_stopwords() -> tuple[str, ...]:
    """The default stop words of the word profiles and the bag of words."""
    return ENGLISH_STOPWORDS
