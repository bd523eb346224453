"""Ops 11 to 13 against brute force on hostile small tables: nulls, empty and
long texts, ties, repeated rows, no rows, clashing extra columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, i int, path string, digest string, root int, held boolean, slice long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcDé", k=rng.randint(1, 3))) for _ in range(30)]
    texts = [None, "", " \n ", "one", "A a  A", "x" * 4000, " ".join(rng.choices(vocab, k=6000))]
    texts += [" ".join(rng.choices(vocab, k=rng.randint(1, 40))) for _ in range(150)]
    out = [(i, t, rng.choice(["en", "en", "en", "de", None, ""]), f"s{i % 3}" if i % 5 else None, len(t) if t and i % 4 else None) for i, t in enumerate(texts)]
    out += [(5, "one more row of id 5", "en", "s", 3), out[9], out[9], (None, "no id", "zz", None, 1), (None, None, None, None, None), (-7, "minus", "fr", "s", 2)]
    rng.shuffle(out)
    return [(*r, 1, 2, "p", "d", 4, True, 9) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- Merkle manifest ---------------------------------------------------------------------------------------------------


def leaf_of(doc_id, source, lang, n_chars, text):
    parts = ("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text))
    return sha("".join(parts))


def paths(digests):
    """(root, path of each place) of a binary tree, level by level."""
    ways, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for k, i in enumerate(at):
            s = i ^ 1
            ways[k].append("=" if s >= len(digests) else ("<" if s < i else ">") + digests[s])
        digests = [sha("".join(digests[i: i + 2])) for i in range(0, len(digests), 2)]
        at = [i // 2 for i in at]
    return digests[0], ways


def expected_proofs(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0], leaf_of(r[0], r[3], r[2], r[4], r[1])))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    low = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        low[g] = paths([x[1] for x in groups[g]])
    root, high = paths([low[g][0] for g in names])
    return root, [(doc_id, digest, low[g][0], low[g][1][i] + high[k]) for k, g in enumerate(names) for i, (doc_id, digest) in enumerate(groups[g])]


def leaves(docs):
    from mailsift.llm.merkle import leaf

    return docs.withColumn("leaf", leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text")))


def test_merkle_proofs(docs, none, rows):
    from mailsift.llm import merkle

    merkle_rows = leaves(docs)
    got = merkle.proofs(merkle_rows, "lang", "doc_id", "leaf").collect()
    root, want = expected_proofs(rows)
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["path"]) for r in got), key=repr) == sorted(want, key=repr)
    assert {r["root"] for r in got} == {root}
    assert merkle.proofs(leaves(none), "lang", "doc_id", "leaf").count() == 0


def test_merkle_multiproof_of_some_leaves(docs, rows, monkeypatch):
    """Any part of the leaves, with blocks small enough for several tiers;
    what is fetched is the minimal union of missing nodes."""
    from mailsift.llm import merkle

    monkeypatch.setattr(merkle, "K", 2)
    merkle_rows = leaves(docs)
    some = F.coalesce(F.col("doc_id") % 9 == 0, F.lit(True))
    got = merkle.proofs(merkle_rows, "lang", "doc_id", "leaf", only=some)
    folded = got.select("doc_id", "leaf", "subroot", "path", "root", merkle.fold(F.col("leaf"), F.col("path")).alias("f"),
                        merkle.fold(F.sha2("leaf", 256), F.col("path")).alias("wrong")).collect()
    root, want = expected_proofs(rows)
    chosen = [w for w in want if w[0] is None or w[0] % 9 == 0]
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["path"]) for r in folded), key=repr) == sorted(chosen, key=repr)
    assert all(r["f"] == r["root"] == root != r["wrong"] for r in folded)
    n, places = 1000, sorted(random.Random(1).sample(range(1000), 60))
    missing = {(level, i) for level, _, asked in merkle._levels(places, n) for i in asked}
    below = lambda level, i: any(p >> level == i for p in places)
    needed = {(level, (p >> level) ^ 1) for p in places for level in range(merkle._height(n)) if (p >> level) ^ 1 < merkle._size(n, level)}
    assert missing == {(level, i) for level, i in needed if not below(level, i)}


def test_merkle_query(spark, docs, tmp_path, rows):
    """The registered query's digests: sizes, tampering, one root."""
    from mailsift.llm.queries import op11_merkle_manifest

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_merkle_manifest(spark, str(tmp_path)).collect()
    root, want = expected_proofs(rows)
    n_chars = collections.defaultdict(list)
    for r in rows:
        n_chars[leaf_of(r[0], r[3], r[2], r[4], r[1])].append(r)
    assert len(got) == len(want)
    proof = collections.Counter((w[1], sha("".join(s[1:] for s in w[3] if s != "="))) for w in want)
    assert proof == collections.Counter((r["leaf"], r["proof_sha256"]) for r in got)
    for r in got:
        row = n_chars[r["leaf"]][0]
        changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and row[4] is not None
        assert r["verified"] == (not changed) == (r["folded_root"] == root) and r["root"] == root


# --- Language model ----------------------------------------------------------------------------------------------------


def tokens_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lowered) + ["</s>"]


def expected_scores(rows, held, order, mu):
    counts = [collections.Counter() for _ in range(order + 1)]
    for r, h in zip(rows, held):
        if not h:
            seq = ["<s>", *tokens_of(r[1])]
            for k in range(1, order + 1):
                counts[k].update(tuple(seq[j - k + 1: j + 1]) for j in range(max(1, k - 1), len(seq)))
            counts[0]["<s>"] += 1
    n, v = sum(counts[1].values()), len(counts[1])
    context = lambda h: counts[0]["<s>"] if h == ("<s>",) else counts[len(h)][h]

    def p(w, h):
        """Arc weight of the state h, or its failure arc's times that of the shorter context."""
        if not h:
            return (counts[1][(w,)] + 1) / (n + v + 1)
        c = counts[len(h) + 1][(*h, w)]
        return (c + mu * p(w, h[1:])) / (context(h) + mu)

    out = []
    for r, h in zip(rows, held):
        seq = ["<s>", *tokens_of(r[1])]
        base = sum(math.log10((counts[1][(w,)] + 1) / (n + v + 1)) for w in seq[1:])
        total = sum(math.log10(p(seq[j], tuple(seq[max(0, j - order + 1): j]))) for j in range(1, len(seq)))
        out.append((r[0], h, len(seq) - 1, sum(counts[1][(w,)] > 0 for w in seq[1:]), n, base, total))
    return out, p, counts


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores(docs, rows, order, monkeypatch):
    from mailsift.llm import backoff_lm

    monkeypatch.setattr(backoff_lm, "BUCKET_KEYS", 500)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    held = [zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 == 2 for r in rows]
    got = sorted((tuple(r) for r in backoff_lm.score(docs, held_out, order=order, mu=3.0).collect()), key=repr)
    want, _, _ = expected_scores(rows, held, order, 3.0)
    want.sort(key=repr)
    near = lambda a, b: abs(a - b) <= 1e-9 * max(1, abs(b))
    key = lambda r: (repr(r[:5]), round(r[5], 6), round(r[6], 6))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and near(g[5], w[5]) and near(g[6], w[6])


def test_states_are_normalised(rows):
    """Of the brute-force model that the operator equals: weights of a state sum to one."""
    _, p, counts = expected_scores(rows, [False] * len(rows), 3, 3.0)
    for h in [(), ("<s>",), ("<s>", "one"), tuple(tokens_of(rows[3][1])[:2]), ("never", "seen")]:
        assert abs(sum(p(w, h) for (w,) in counts[1]) + p("\0unknown", h) - 1) < 1e-9


def test_scores_of_nothing(none, spark):
    from mailsift.llm.backoff_lm import score

    assert score(none, F.lit(False)).count() == 0
    untaught = score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(True)).collect()[0]
    assert (untaught["n_tokens"], untaught["n_known"], untaught["train_tokens"], untaught["score"]) == (3, 0, 0, 0.0)


def test_long_text_and_repeated_rows(spark):
    """A text longer than all others together, and equal rows, over several partitions."""
    from mailsift.llm import backoff_lm

    rng = random.Random(2)
    rows = [(str(i), " ".join(rng.choices("abcdefgh", k=50 if i else 20000))) for i in range(60)]
    rows += rows[1:3]
    got = collections.Counter((r["doc_id"], round(r["score"], 5)) for r in backoff_lm.score(spark.createDataFrame(rows, "doc_id string, text string").repartition(3), F.lit(False)).collect())
    want, _, _ = expected_scores(rows, [False] * len(rows), backoff_lm.ORDER, backoff_lm.MU)
    assert got == collections.Counter((w[0], round(w[6], 5)) for w in want)


# --- Prefix trie -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(8)
    out = []
    for c in [*range(0, 66), 121, 140, 163, 240]:
        if c in (20, 41):
            continue
        kind = rng.randrange(4)
        n = rng.randint(1, 5)
        texts = [rng.choice(["hi", "hi there", "", None, "a b  c"]) if kind else "hi" for _ in range(n)]
        out += [(c, t if rng.random() > 0.1 else None, rng.choice(["user", "assistant", None]) if kind > 1 else "user", x) for t, x in enumerate(texts)]
    out += [(7, 1, "user", "tie b"), (7, 1, "user", "tie a"), (7, 1, "user", "tie a"), (None, 0, "user", "lost"), (140, 9, "user", "w " * 3000)]
    out += [(64, i, "user", f"long {i}") for i in range(3, 90)]
    rng.shuffle(out)
    return [(*r, 1, "c", 2) for r in out]


def expected_trie(turns, rebuild=True):
    own = collections.defaultdict(list)
    for c, turn, role, text, *_ in turns:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.md5((str(len(role.encode())) + ":" + role + text).encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0, name), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        built[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    nodes = collections.defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    words = lambda node: len(WORD.findall(node[-1][1])) if node else 0
    out = []
    for node, members in nodes.items():
        d = len(node)
        under = [x for x in nodes if x[:d] == node]
        children = [x for x in under if len(x) == d + 1]
        leaf = [x for x in under if not any(len(y) == len(x) + 1 and y[:-1] == x for y in under)]
        finished = sorted(c for c in members if len(built[c]) == d)
        out.append((min(members), d, min(nodes[node[:-1]]) if node else None, len(members), len(children), len(leaf),
                    sum((len(nodes[x]) - 1) * words(x) for x in under), sha(",".join(map(str, finished)))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block,piece", [(1 << 14, 1 << 14), (8, 3)])
def test_prefix_trie(spark, turns, monkeypatch, block, piece):
    from mailsift.llm import prefix_trie

    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, d int, c string, words int").repartition(4)
    got = prefix_trie.trie(prefix_trie.rebuilt(df, F.expr("conv_id - conv_id % 20"), F.crc32(F.col("conv_id").cast("string")) % 4))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected_trie(turns)


def test_prefix_trie_as_it_stands_and_empty(spark, turns):
    from mailsift.llm.prefix_trie import rebuilt, trie

    schema = "conv_id long, turn long, role string, text string, d int, c string, words int"
    got = trie(rebuilt(spark.createDataFrame(turns, schema))).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected_trie(turns, rebuild=False)
    assert trie(rebuilt(spark.createDataFrame([], schema))).count() == 0
