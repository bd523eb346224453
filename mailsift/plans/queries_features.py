"""Feature queries: FEA-1 ... FEA-7 (vocabulary fitted on the train split)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift.functions import text as X
from mailsift.operators import features as FE
from mailsift.operators import shape as S
from mailsift.plans.queries_profile import STOP_SQL
from mailsift.plans.queries_shape import SEED, split_ctes
from mailsift.plans.registry import register
from mailsift.session import handoff
from mailsift.sources import tables as tb

MAX_LEN = 256
MIN_FREQ = 2
MAX_SIZE = 50000

_TOKENS = "list_filter(regexp_split_to_array(lower(m.body), '[^\\p{L}\\p{N}_]+'), lambda t: t <> '')"
_SPLIT = split_ctes(0.2, "0.5")
_VOCAB = f"""
SELECT '<pad>' AS token, CAST(0 AS BIGINT) AS freq, CAST(0 AS BIGINT) AS id
UNION ALL SELECT '<unk>', CAST(0 AS BIGINT), CAST(1 AS BIGINT)
UNION ALL SELECT token, freq, CAST(row_number() OVER (ORDER BY freq DESC, token) + 1 AS BIGINT) FROM (
  SELECT token, freq FROM (
    SELECT token, count(*) AS freq FROM (
      SELECT unnest({_TOKENS}) AS token FROM mail m JOIN splits s ON m.row_id = s.row_id WHERE s.split = 'train')
    GROUP BY token) WHERE freq >= {MIN_FREQ} ORDER BY freq DESC, token LIMIT {MAX_SIZE - 2})"""
_CUT = ("cut", f"SELECT m.row_id, list_slice({_TOKENS}, 1, {MAX_LEN}) AS toks FROM mail m")
_EX = ("ex", "SELECT row_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM cut")


def _split_mail(spark, d):
    m = tb.mail(spark, d)
    return S.stored_split(m, "y", "row_id", 0.2, 0.5, SEED)


def _vocab(spark, d):
    sp = _split_mail(spark, d).filter(F.col("split") == "train")
    return FE.build_vocab(sp.withColumn("tokens", X.simple_tokens("body")), "tokens", MIN_FREQ, MAX_SIZE)


def _vocab_and_ids(spark, d):
    """The vocabulary of the train rows and the ids of all rows."""
    vocab = handoff(_vocab(spark, d), "vocab")
    mail = tb.mail(spark, d).withColumn("tokens", X.simple_tokens("body"))
    return vocab, FE.encode_ids(mail, "row_id", "tokens", vocab, MAX_LEN)


@register("fea1_vocabulary", tb.with_views(_VOCAB, "mail", extra=_SPLIT))
def fea1_vocabulary(spark, d):
    return _vocab(spark, d)


@register("fea1_vocabulary_cleaned")
def fea1_vocabulary_cleaned(spark, d):
    """FEA-1 on the cleaner's tokens (cleaned body, cleaned again: CLN-16)."""
    sp = _split_mail(spark, d).filter(F.col("split") == "train")
    toks = X.clean_tokens("body", passes=2)
    return FE.build_vocab(sp.withColumn("tokens", toks), "tokens", MIN_FREQ, MAX_SIZE)


_ENC = ("enc", "SELECT ex.row_id, list(coalesce(v.id, 1) ORDER BY pos) AS ids FROM ex "
               "LEFT JOIN vocab v ON ex.tok = v.token GROUP BY ex.row_id")


@register("fea2_encode_ids", tb.with_views(
    f"SELECT t.row_id, array_to_string(list_resize(coalesce(e.ids, []), {MAX_LEN}, 0), ' ') AS ids "
    "FROM cut t LEFT JOIN enc e ON t.row_id = e.row_id",
    "mail", extra=_SPLIT + [("vocab", _VOCAB), _CUT, _EX, _ENC]))
def fea2_encode_ids(spark, d):
    vocab, enc = _vocab_and_ids(spark, d)
    return enc.select("row_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@register("fea3_mask_length", tb.with_views(
    f"SELECT row_id, CAST(greatest(1, len(toks)) AS BIGINT) AS n_real, "
    f"rtrim(repeat('1 ', CAST(len(toks) AS BIGINT)) || repeat('0 ', {MAX_LEN} - CAST(len(toks) AS BIGINT))) AS mask "
    "FROM (SELECT row_id, coalesce(toks, []) AS toks FROM cut)", "mail", extra=[_CUT]))
def fea3_mask_length(spark, d):
    vocab, enc = _vocab_and_ids(spark, d)
    mask = F.array_join(FE.attention_mask("ids").cast("array<string>"), " ")
    return enc.select("row_id", FE.real_length("ids").alias("n_real"), mask.alias("mask"))


_BOW = ("list_filter(regexp_extract_all(lower(m.body), '[\\p{L}\\p{N}_]{2,}'), "
        f"lambda t: t NOT IN {STOP_SQL})")


@register("fea4_bag_of_words", tb.with_views(f"""
SELECT row_id, term, count(*) AS count FROM (
  SELECT m.row_id, unnest({_BOW}) AS term FROM mail m JOIN splits s ON m.row_id = s.row_id WHERE s.split = 'test')
WHERE term IN (SELECT unnest({_BOW}) FROM mail m JOIN splits s ON m.row_id = s.row_id WHERE s.split = 'train')
GROUP BY row_id, term""", "mail", extra=_SPLIT))
def fea4_bag_of_words(spark, d):
    sp = _split_mail(spark, d)
    return FE.bag_of_words(sp.filter(F.col("split") == "train"), sp.filter(F.col("split") == "test"),
                           "row_id", "body")


@register("fea5_truncate_pad", tb.with_views(f"""
SELECT row_id, split, n_real, max(n_real) OVER (PARTITION BY split) AS n_padded FROM (
  SELECT m.row_id, s.split, CAST(len(list_slice({_TOKENS}, 1, {MAX_LEN})) AS BIGINT) AS n_real
  FROM mail m JOIN splits s ON m.row_id = s.row_id)""", "mail", extra=_SPLIT))
def fea5_truncate_pad(spark, d):
    sp = _split_mail(spark, d).withColumn("tokens", X.simple_tokens("body"))
    out = FE.truncate_pad(sp, "tokens", "split", MAX_LEN)
    return out.select("row_id", "split", F.size(F.slice("tokens", 1, MAX_LEN)).cast("long").alias("n_real"),
                      F.size("padded").cast("long").alias("n_padded"))


@register("fea6_mean_pool", """
SELECT label, CAST(pos - 1 AS BIGINT) AS dim, round(avg(v), 6) AS value FROM (
  SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)
GROUP BY label, pos""")
def fea6_mean_pool(spark, d):
    means = FE.mean_vectors(tb.load(spark, d, "embeddings"), "label", "embedding")
    ex = means.select("label", F.posexplode("mean").alias("dim", "value"))
    return ex.select("label", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


_DIMS = 8
_ID_VECTOR = "[" + ", ".join(f"CAST((id * {2 * i + 3}) % 101 AS DOUBLE)" for i in range(_DIMS)) + "]"


@register("fea6_masked_mean_pool", tb.with_views(f"""
SELECT c.row_id, CAST(p.pos - 1 AS BIGINT) AS dim, CAST(coalesce(m.v, 0) AS BIGINT) AS weight
FROM cut c CROSS JOIN (SELECT unnest(range(1, {_DIMS + 1})) AS pos) p LEFT JOIN (
  SELECT row_id, pos, sum(v) AS v FROM (
    SELECT e.row_id, unnest(v.vec) AS v, generate_subscripts(v.vec, 1) AS pos FROM ex e
    LEFT JOIN vocab t ON e.tok = t.token JOIN vecs v ON v.id = coalesce(t.id, 1)) GROUP BY row_id, pos) m
ON m.row_id = c.row_id AND m.pos = p.pos""", "mail", extra=_SPLIT + [
    ("vocab", _VOCAB), _CUT, _EX, ("vecs", f"SELECT id, {_ID_VECTOR} AS vec FROM vocab")]))
def fea6_masked_mean_pool(spark, d):
    """FEA-6 on token ids (the vector of an id follows from the id). Means are
    returned times the number of ids, which makes them whole numbers."""
    vocab, enc = _vocab_and_ids(spark, d)
    vecs = vocab.select(F.col("id").cast("int").alias("id"),
                        F.array(*[((F.col("id") * (2 * i + 3)) % 101).cast("double") for i in range(_DIMS)]).alias("vector"))
    enc = handoff(enc, "ids")
    pooled = FE.masked_mean_pool(enc, "row_id", "ids", vecs).join(enc.select("row_id", FE.real_length("ids").alias("n")), "row_id")
    return pooled.select("row_id", "n", F.posexplode("pooled").alias("dim", "value")).select(
        "row_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("value") * F.col("n")).cast("long").alias("weight"))


@register("fea7_decode_ids", tb.with_views(
    "SELECT t.row_id, coalesce(array_to_string(d.toks, ' '), '') AS text FROM cut t LEFT JOIN ("
    "SELECT ex.row_id, list(coalesce(v.token, '<unk>') ORDER BY pos) AS toks FROM ex "
    "LEFT JOIN vocab v ON ex.tok = v.token GROUP BY ex.row_id) d ON t.row_id = d.row_id",
    "mail", extra=_SPLIT + [("vocab", _VOCAB), _CUT, _EX]))
def fea7_decode_ids(spark, d):
    vocab, enc = _vocab_and_ids(spark, d)
    return FE.decode_ids(enc, "row_id", "ids", vocab)
