"""Each operator against a brute-force version on hostile small tables: nulls,
empty and long texts, ties, repeated rows, no rows, clashing extra columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

WORD = re.compile("[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, kept boolean, spans string, n_words int"


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdeéfgh", k=rng.randint(1, 6))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(vocab, k=n))
    passage, base = prose(60), prose(120).split(" ")
    texts = [None, "", " \n\t", "one", "two words", "A b c D", "a B C d", "x" * 5000, prose(9000), "é　ß 日本語 ▁ <|endoftext|>  two  spaces ",
              "a<|endoftext|>b <|endoftext|> c<|endoftext|> <|endoftext|><|endoftext|>x", "<|endoftext|>", "日本語の長い文" * 300, "x" + "QUJD" * 700 + " end"]
    texts += [prose(rng.randint(5, 150)) for _ in range(40)]
    texts += [prose(20) + " " + passage + "\n" + prose(15) for _ in range(12)]
    for _ in range(30):
        near = list(base)
        for i in rng.sample(range(120), rng.randint(0, 6)):
            near[i] = rng.choice(vocab)
        texts.append(" ".join(near))
    texts += [" ".join(base)] * 25
    texts += ["shared line of every host, long enough\n" + prose(60) for _ in range(30)]
    texts += ["mail a.b+c@x-y.example.com, ip 10.0.0.256 1.2.3.4 300.1.1.1, card 4539 1488 0343 6467, call +1 (555) 010-9999 x@y @z.com a@b.c@d.e password=ab12cd34 ftp://u:p@localhost/x"]
    texts += [(prose(12) + " ") * 8, "w " * 40]
    out = [(i * 3, t, "en", f"s{i % 3}" if i % 11 else None, len(t or ""), 1, True, "x", 2) for i, t in enumerate(texts)]
    out += [out[20], out[21], (None, "a null id " + prose(30), None, "s0", 1, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(docs, none, rows):
    from mailsift.llm.sharding import shard

    got = shard(docs, 7, tie=("n_chars",)).collect()
    assert set(got[0].asDict()) == {c.split()[0] for c in SCHEMA.split(", ")} | {"slot"}
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter((r[0], r[1]) for r in rows)
    by_shard = collections.defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r)
    sizes = [len(by_shard[k]) for k in range(7)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by_shard.values())
    # Rank by seeded hash within the source, sort by fractional rank, cut.
    key = lambda r: (hashlib.md5(f"7:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), (r[4] is not None, r[4] or 0))
    placed = []
    for source, group in itertools.groupby(sorted(rows, key=lambda r: (r[3] is not None, r[3] or "")), key=lambda r: r[3]):
        group = sorted(group, key=key)
        placed += [((2 * k + 1) / (2 * len(group)), "null" if source is None else "s" + source, k, r[0]) for k, r in enumerate(group)]
    exp = [(k * 7 // len(rows), r[3]) for k, r in enumerate(sorted(placed, key=lambda r: r[:3]))]
    assert collections.Counter(exp) == collections.Counter((r.shard, r.doc_id) for r in got)
    assert shard(none, 7).count() == 0


def test_sharding_with_a_source_for_every_few_rows(spark):
    from mailsift.llm.sharding import shard

    sizes = [400, 400, 90, 31, 30] + [7] * 20 + [2] * 60 + [1] * 300
    made = [(k * 1000 + i, f"h{k}") for k, n in enumerate(sizes) for i in range(n)]
    got = shard(spark.createDataFrame(made, "doc_id long, source string"), 9).collect()
    place = {}
    for k, n in enumerate(sizes):
        ids = sorted((k * 1000 + i for i in range(n)), key=lambda d: hashlib.md5(f"7:{d}".encode()).hexdigest())
        place |= {d: ((2 * r + 1) / (2 * n), f"sh{k}", r) for r, d in enumerate(ids)}
    want = sorted(place, key=place.get)
    starts = [next(i for i in range(len(want)) if i * 9 // len(want) == s) for s in range(9)]
    assert {r.doc_id: starts[r.shard] + r.slot for r in got} == {d: i for i, d in enumerate(want)}


def test_piece_sampling_is_lossless_and_reproducible(docs, none, rows):
    from mailsift.llm.piece_sampling import decode, encode

    ids = encode(docs, check=True)
    got = ids.collect()
    again = {r.doc_id: r.ids for r in encode(docs.repartition(3)).collect() if r.doc_id is not None and r.doc_id % 3 == 0}
    assert all(again[r.doc_id] == r.ids for r in got if r.doc_id is not None)
    texts = collections.Counter((r[0], zlib.crc32((r[1] or "").encode())) for r in rows)
    assert collections.Counter((r.doc_id, r.decoded_crc32) for r in got) == texts
    assert collections.Counter((r.doc_id, r.text) for r in decode(ids).collect()) == collections.Counter((r[0], r[1] or "") for r in rows)
    assert encode(none).count() == 0


def test_piece_sampling_draws_each_segmentation_with_its_probability(spark):
    from mailsift.llm.piece_sampling import Pieces, default_model, encode

    pieces = Pieces.of(default_model(), 1.0)
    known = {b: i for i, b in enumerate(pieces.bytes) if pieces.weight[i] < 0 and i not in set(pieces.byte_id.tolist())}

    def cuts(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k] in known:
                yield from ((known[s[:k]], *rest) for rest in cuts(s[k:]))

    every = list(cuts(b" hello"))
    weight = np.array([math.exp(sum(pieces.weight[i] for i in c)) for c in every])
    n = 20000
    got = collections.Counter(tuple(r.ids) for r in encode(spark.range(n).selectExpr("id AS doc_id", "'hello' AS text")).collect())
    assert set(got) <= set(every)
    assert max(abs(got[c] / n - p) for c, p in zip(every, weight / weight.sum())) < 0.015


def test_piece_sampling_of_long_units(monkeypatch):
    """Text without spaces: lossless, bounded memory, windows drawn by their own
    lattices (brute force over all segmentations of a window that goes on)."""
    from mailsift.llm import piece_sampling as P

    pieces = P.Pieces.of(P.default_model(), 1.0)
    lattices = P.Lattices(pieces)
    rng = random.Random(6)
    monkeypatch.setattr(P, "MAX_BYTES", 400_000)
    for k in range(12):
        text = ("".join(rng.choices("日本語abcdé▁", k=4000)) + " " + " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(200))).encode()
        units = [w for u in text.split(b" ") for w in (P._windows(u) if len(u) > P.WINDOW else (u,))]
        assert all(len(u) <= P.WINDOW + 1 for u in units)
        lattices.keep(P.MAX_BYTES)
        ids, count = P._drawn(lattices, units, np.arange(len(units), dtype=np.uint64) + np.uint64(1000 * k))
        assert pieces.decode(ids.tolist()) == text and count.sum() == len(ids)
        assert lattices.bytes() < 900_000 and max(map(len, lattices.index)) < P.WINDOW
    known = {b: i for i, b in enumerate(pieces.bytes) if pieces.weight[i] < 0 and i not in set(pieces.byte_id.tolist())}

    def cuts(s):
        if not s:
            yield ()
        for n in range(1, len(s) + 1):
            if s[:n] in known:
                yield from ((known[s[:n]], *rest) for rest in cuts(s[n:]))

    every = list(cuts(b"ing"))
    weight = np.array([math.exp(sum(pieces.weight[i] for i in c)) for c in every])
    scratch = P.Lattices(pieces)
    scratch.add([b" ing"])
    ids, count = scratch.sample(np.zeros(20000, np.int64), P.mix(np.arange(20000, dtype=np.uint64)))
    ends = np.cumsum(count)
    got = collections.Counter(tuple(ids[a:b].tolist()) for a, b in zip(ends - count, ends))
    assert set(got) <= set(every)
    assert max(abs(got[c] / 20000 - p) for c, p in zip(every, weight / weight.sum())) < 0.015


def test_packing(docs, none, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    from mailsift.llm.packing import least_bins, pack

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    exp = collections.Counter()
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]
        edges = [0, *range(len(ids) % 256 or 256, len(ids), 256), len(ids)]
        exp.update((r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:])))
    got = pack(docs, length=256).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == exp
    by_sequence = collections.defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by_sequence) <= least_bins(np.bincount([r.length for r in got], minlength=257), 256) + 1
    assert pack(none).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan_is_optimal_on_small_cases(seed):
    from mailsift.llm.packing import plan

    rng = np.random.default_rng(seed)
    sizes = sorted(rng.integers(1, 20, 9).tolist(), reverse=True)

    def fewest(rest, rooms):
        if not rest:
            return len(rooms)
        best = len(rooms) + len(rest)
        for k in range(len(rooms)):
            if rooms[k] >= rest[0]:
                best = min(best, fewest(rest[1:], [*rooms[:k], rooms[k] - rest[0], *rooms[k + 1:]]))
        return min(best, fewest(rest[1:], [*rooms, 20 - rest[0]]))

    made = plan(np.bincount(sizes, minlength=21), 20)
    assert sorted((s for b, k in made for s in b * k), reverse=True) == sizes
    assert sum(k for _, k in made) == fewest(sizes, [])


@pytest.mark.parametrize("seed", range(6))
def test_packing_leaves_out_dominated_fillings_only(seed):
    """A filling is dominated just where a piece that is left can take the place
    of some of its pieces (brute force over all subsets)."""
    from mailsift.llm.packing import _dominated

    rng = np.random.default_rng(seed)
    for _ in range(60):
        pieces = rng.integers(1, 14, 8).tolist()
        k = int(rng.integers(0, 5))
        filling, rest = tuple(sorted(pieces[:k], reverse=True)), pieces[k:]
        room = sum(filling) + int(rng.integers(0, 5))
        subsets = [c for n in range(k + 1) for c in itertools.combinations(filling, n)]
        exp = any((sum(c) < x if len(c) < 2 else sum(c) <= x) and x <= sum(c) + room - sum(filling) for c in subsets for x in rest)
        assert _dominated(np.bincount(pieces, minlength=31), room, filling) == exp


def test_encoder_memory_is_bounded_in_bytes(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    from mailsift.llm import tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rng = random.Random(4)
    encoder = tokens.Encoder(path)
    monkeypatch.setattr(tokens, "MAX_BYTES", 60_000)
    for _ in range(40):
        batch = ["".join(rng.choices("αβγdef語", k=rng.choice([5, 3000]))) for _ in range(4)]
        batch += [" ".join("".join(rng.choices("abcé", k=4)) for _ in range(50)) + " " + "z" * 400]
        assert encoder.encode(batch) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in batch]
        assert max(map(len, [*encoder.later.ids, *encoder.first.ids])) <= tokens.UNIT
        assert encoder.later.size < 60_000 + 40_000 and encoder.first.size < 15_000 + 10_000


def test_packing_plan_of_many_pieces_is_optimal():
    from mailsift.llm.packing import least_bins, plan

    bins = [(60, 20, 20), (31, 32, 37), (33, 33, 34), (35, 34, 31), (39, 30, 31), (38, 31, 31), (36, 32, 32)]
    counts = np.bincount([s for b in bins for s in b * 100], minlength=101)
    made = plan(counts, 100)
    assert least_bins(counts, 100) == 700 == sum(k for _, k in made)  # 60 fits with 20 and 20 only, behind nine larger sizes
    assert (np.bincount([s for b, k in made for s in b * k], minlength=101) == counts).all() and all(sum(b) <= 100 for b, _ in made)


def shingles(text, n):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    return {tuple(w[i: i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.mark.parametrize("n, percent, cell", [(4, 85, 256), (5, 80, 256), (2, 60, 8)])
def test_jaccard_join(docs, none, rows, n, percent, cell, monkeypatch):
    from mailsift.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "CELL", cell)  # small cells: rings, cells and recursion on this table
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(r[0], shingles(r[1], n)) for r in rows if r[0] is not None]
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    exp = collections.Counter((r[0], len(shingles(r[1], n)), None if r[0] is None else find(r[0])) for r in rows)
    assert collections.Counter(map(tuple, jaccard_join.groups(docs, n, percent).collect())) == exp
    assert jaccard_join.groups(none, n, percent).count() == 0


def test_compression_classifier(spark, docs, none):
    from mailsift.llm.compression_classifier import fit, score

    rng = random.Random(1)
    made = [(i, " ".join("".join(rng.choices("abcdef" if i % 2 else "#$%&xyz", k=5)) for _ in range(60)), i % 2) for i in range(300)]
    table = spark.createDataFrame(made, "doc_id long, text string, quality int")
    model = fit(table.select("doc_id", "text"), table.select("doc_id", "quality").where("doc_id < 200"))
    got = {r.doc_id: r.score for r in score(table, model).collect()}
    assert np.mean([(got[i] >= 0.3) == bool(q) for i, _, q in made if i >= 200]) > 0.95
    every = score(docs, model).collect()
    assert len(every) == docs.count() and all(0 <= r.score <= 1 for r in every)
    empty = fit(none, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in score(docs, empty).collect()} == {0.5}
    assert score(none, model).count() == 0


def test_quality_rules(docs, none, rows):
    from mailsift.llm.quality_rules import rules

    norm = lambda line: re.sub("[\x20\x09-\x0D]+", " ", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)).strip(" ")
    held, hosts = collections.Counter(), collections.Counter()
    for r in rows:
        hosts[r[3]] += 1
        held.update({(r[3], norm(x)) for x in (r[1] or "").split("\n") if words(x)})
    exp = collections.Counter()
    for r in rows:
        text = r[1] or ""
        w, lines = words(text), [x for x in text.split("\n") if words(x)]
        seen = collections.Counter(tuple(w[i: i + 8]) for i in range(len(w) - 7))
        covered = {k for i in range(len(w) - 7) if seen[tuple(w[i: i + 8])] > 1 for k in range(i, i + 8)}
        left = sum(len(words(x)) for x in lines if not (held[r[3], norm(x)] > 5 and held[r[3], norm(x)] > 0.1 * hosts[r[3]]))
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        exp[r[0], len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed, left, not failed and left >= 0.3 * len(w)] += 1
    out = rules(docs, min_docs=5)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_kept_words", "kept")
    assert collections.Counter(tuple(r[c] for c in names) for r in out.collect()) == exp
    assert any(k[7] < k[1] for k in exp)  # lines were removed
    assert out.where("kept").count() == sum(n for k, n in exp.items() if k[-1])
    assert rules(none).count() == 0


def luhn(digits):
    return sum(d - 9 * (d > 9) for d in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))) % 10 == 0


def test_pii(docs, none, rows):
    from mailsift.llm.pii import find

    digits = lambda m: re.sub("[^0-9]", "", m.group())
    rules = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15)]
    exp = collections.Counter((r[0], tuple((k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, r[1] or "") if ok(m))) for r in rows)
    got = find(docs).collect()
    assert collections.Counter((r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans if s.kind in ("email", "ip", "card", "phone"))) for r in got) == exp
    marked = next(r for r in got if r.text and "password=" in r.text)
    assert {s.kind for s in marked.spans} == {"email", "ip", "card", "phone", "url", "account"}
    assert "4539" not in marked.redacted and "ab12cd34" not in marked.redacted and "<EMAIL>" in marked.redacted
    assert all(r.redacted == r.text for r in got if not r.spans)
    assert find(none).count() == 0


@pytest.mark.parametrize("url", ["https://alice:S3cr!t@db.example.com/x", "postgres://bob:p$w,d@10.1.2.3:5432/db", "ftp://u:p@localhost/x", "https://carol@mail.example.org/"])
def test_pii_of_credentials_before_any_host(url):
    from mailsift.llm.pii import _automaton, find_spans, redact

    text = f"see {url} or https://host.org/@name"
    spans = find_spans(text, _automaton())
    assert spans["url"] == [(4, 4 + len(url))]
    assert spans["email"] == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert redact(text, spans) == "see <URL> or https://host.org/@name"


@pytest.mark.parametrize("text, value", [
    ("API key: ab12cd34, x", "ab12cd34"), ("API Key: ab12cd34", "ab12cd34"), ("é User ID: u1234567.", "u1234567"), ("PassWord = hunter22 or so", "hunter22"),
    ("IBAN: DE89 3704 0044 0532 0130 00 and 12 more", "DE89 3704 0044 0532 0130 00"), ("iban: GB82 WEST 1234 5698 7654 32 paid", "GB82 WEST 1234 5698 7654 32"),
    ("Account no. : 1234 5678 9012 of Ann", "1234 5678 9012"), ("ACCOUNT: 12-34-56 12345678", "12-34-56 12345678"), ("passport: AB 123456 78", "AB 123456 78"),
    ("IBAN: DE00 3704 0044 0532 0130 00", "DE00 3704 0044 0532 0130 00"), ("IBAN DE89370400440532013000", None), ("Account: closed in 2021", None), ("subaccount: 12345678", None),
    ("iban=DE89370400440532013000", "DE89370400440532013000"), ("account: 123456 x", "123456")])
def test_pii_of_account_forms(text, value):
    from mailsift.llm.pii import _automaton, find_spans, redact

    spans = find_spans(text, _automaton())
    assert [text[a:b] for a, b in spans["account"]] == ([value] if value else [])
    assert redact(text, spans) == (text.replace(value, "<ACCOUNT>") if value else text)


def test_pii_of_a_text_with_very_many_cues():
    from mailsift.llm.pii import _automaton, find_spans

    n = 50_000
    spans = find_spans("account: ab12345x user@host.org\n" * n, _automaton())
    assert len(spans["account"]) == len(spans["email"]) == n
    assert spans["account"][-1] == ((n - 1) * 32 + 9, (n - 1) * 32 + 17)


def test_pii_base_matches_the_grammar_on_random_texts():
    from mailsift.llm.pii import _automaton, find_spans

    rng, automaton = random.Random(3), _automaton()
    for _ in range(3000):
        text = "".join(rng.choices("a.@-+1205 (é", k=40))
        spans = find_spans(text, automaton)
        assert spans["email"] == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        assert spans["phone"] == [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_chat_hmm_recovers_roles(spark):
    from mailsift.llm.chat_hmm import as_transcript, fit, parse

    raw = as_transcript(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    model = fit(raw.where("conv_id % 5 <> 0"))
    truth = {(r.conv_id, r.turn): r.role for r in raw.where("conv_id % 5 = 0").collect()}
    got = {(r.conv_id, r.turn): r.role for r in parse(raw.where("conv_id % 5 = 0"), model).collect()}
    assert np.mean([got.get(k) == v for k, v in truth.items()]) > 0.85


def test_chat_hmm_chunks_give_the_long_viterbi_path(spark, monkeypatch):
    from mailsift.llm import chat_hmm

    rng = random.Random(2)
    made = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["User: ", "AI: ", "", ""]) + rng.choice(["hello?", "", "a long line " * 9]) + "\nmore" * rng.randint(0, 2)) for c in (1, 2) for t in range(60)]
    made += [(None, 3, "user", "User: lone"), (9, None, "user", None), (1, 0, *made[0][2:])]
    raw = spark.createDataFrame(made, "conv_id long, turn long, role string, text string")
    model = chat_hmm.fit(raw)
    whole = sorted(map(tuple, chat_hmm.parse(raw, model).collect()))
    monkeypatch.setattr(chat_hmm, "CHUNK", 4)
    monkeypatch.setattr(chat_hmm, "FAN", 3)  # three levels of matrices
    assert sorted(map(tuple, chat_hmm.parse(raw, model).collect())) == whole
    assert chat_hmm.parse(raw.where("false"), model).count() == 0


def test_chat_hmm_returns_every_row_without_an_id(spark):
    from mailsift.llm import chat_hmm

    made = [(None, 0, "user", "User: same")] * 2500 + [(4, None, "user", "User: same")] * 2 + [(4, 0, "user", "User: same"), (4, 0, "user", "User: same"), (4, 1, "assistant", "AI: other")]
    raw = spark.createDataFrame(made, "conv_id long, turn long, role string, text string")
    got = chat_hmm.parse(raw, chat_hmm.fit(raw)).collect()
    assert collections.Counter(r.conv_id for r in got) == {None: 2500, 4: 4} and len({r.conv for r in got}) == 2503
    assert chat_hmm.lines(chat_hmm.messages(raw)).count() == 2504


def test_chat_hmm_against_a_plain_viterbi(spark, monkeypatch):
    """Counts by hand, one pass per conversation in pure Python; one conversation
    has all of its rows in one turn, one a very long text, one clashing columns."""
    from pyspark.sql import functions as F

    from mailsift.llm import chat_hmm

    rng = random.Random(6)
    text = lambda: rng.choice(["User: ", "AI: ", "### System: ", "", "", ""]) + rng.choice(["hello?", "", "a line " * 12, "b " * 150]) + "\nmore" * rng.randint(0, 3)
    made = [(c, t, rng.choice(chat_hmm.ROLES), f"{text()}{c}.{t}") for c in range(40) for t in range(rng.randint(1, 6))]
    made += [(77, 0, "user", f"{text()} {i}") for i in range(300)] + [(78, 0, None, "\n".join(text() for _ in range(900))), (79, 0, "narrator", ""), (80, 1, "user", None)]
    raw = spark.createDataFrame([(*m, 1, "x") for m in made], "conv_id long, turn long, role string, text string, symbol int, conv string")
    model = chat_hmm.fit(raw)
    ties = {(r.conv_id, r.turn, r.text): r.tie for r in raw.select("*", F.xxhash64("text", "turn", "conv_id").alias("tie")).collect()}
    convs = collections.defaultdict(list)
    for m in sorted(made, key=lambda m: (m[0], m[1], ties[m[0], m[1], m[3]])):
        convs[m[0]].append((m[2], (m[3] or "").split("\n")))

    def sign(line):
        name = re.match(chat_hmm.MARKER, line)
        role = next((k + 1 for k, r in enumerate(chat_hmm.ROLES) if name and name[1].lower() in chat_hmm.MARKERS[r]), 0)
        size = len(line.strip(" "))
        return role * 8 + (0 if size == 0 else 1 if size < 60 else 2 if size < 200 else 3) * 2 + line.strip(" ").endswith("?")

    start, step, show = np.zeros(6), np.zeros((6, 6)), np.zeros((6, chat_hmm.N_SYMBOLS))
    for said in convs.values():
        states = []
        for role, own in said:
            if role in chat_hmm.ROLES:
                found = [2 * chat_hmm.ROLES.index(role) + (k > 0) for k in range(len(own))]
                for s, line in zip(found, own):
                    show[s, sign(line)] += 1
                states += found
        for a, b in zip(states, states[1:]):
            step[a, b] += 1
        if states:
            start[states[0]] += 1
    plain = chat_hmm.Model(start, step, show)
    for a, b in ((plain.start, model.start), (plain.step, model.step), (plain.show, model.show)):
        assert np.array_equal(a, b)

    want = []
    for c, said in convs.items():
        own = [line for _, part in said for line in part]
        best = [(model.start[s] + model.show[s, sign(own[0])], [s]) for s in range(6)]
        for line in own[1:]:
            best = [max(((v + (model.step[p[-1], s] + model.show[s, sign(line)]), p) for v, p in best), key=lambda x: x[0]) for s in range(6)]
            best = [(v, p + [s]) for s, (v, p) in enumerate(best)]
        path = max(best, key=lambda x: x[0])[1]
        begins = [i for i, s in enumerate(path) if s % 2 == 0] + [len(own)]
        for t, (i, j) in enumerate(zip(begins, begins[1:])):
            bare = [re.sub(chat_hmm.MARKER, "", line) if sign(line) >= 8 else line for line in own[i:j]]
            want.append((c, t, chat_hmm.ROLES[path[i] // 2], j - i, "\n".join(bare)))
    for chunk in (256, 7):
        monkeypatch.setattr(chat_hmm, "CHUNK", chunk)
        got = chat_hmm.parse(raw, model).select("conv_id", "turn", "role", "n_lines", "text").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_epsilon_grid(spark, monkeypatch):
    from mailsift.llm import epsilon_grid

    monkeypatch.setattr(epsilon_grid, "BLOCK", 16)
    monkeypatch.setattr(epsilon_grid, "LEAF", 4)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 8))
    x = [(centers[i % 12] + rng.normal(size=8) * 0.25).tolist() for i in range(150)]
    x += [x[0]] * 5 + [[2 * v for v in x[0]]] + [None, [], [0.0] * 8, [math.nan] + [1.0] * 7, [None] + [1.0] * 7, [math.inf] * 8, [1.0, 0.0], [1.0, 0.01]]
    rows = [(i * 2, v, 0) for i, v in enumerate(x)] + [(2, x[1], 1), (None, x[0], 0)]
    ok = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v, _ in rows]
    unit = [np.array(v, float) / np.linalg.norm(v) if k else None for k, (_, v, _) in zip(ok, rows)]
    link = lambda i, j: ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9
    count = [sum(j != i and link(i, j) for j in range(len(rows))) for i in range(len(rows))]
    root = {r[0]: r[0] for r in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, j in itertools.combinations(range(len(rows)), 2):
        if link(i, j) and rows[i][0] is not None and rows[j][0] is not None:
            a, b = find(rows[i][0]), find(rows[j][0])
            root[max(a, b)] = min(a, b)
    exp = collections.Counter((r[0], n, None if r[0] is None else find(r[0])) for r, n in zip(rows, count))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert collections.Counter(map(tuple, epsilon_grid.groups(table).collect())) == exp
    assert epsilon_grid.groups(table.where("false")).count() == 0


def brute_dedup(rows):
    first = {}
    for r in rows:
        w = words(r[1])
        for i in range(len(w) - 12 if r[0] is not None else 0):
            first[tuple(w[i: i + 13])] = min(r[0], first.get(tuple(w[i: i + 13]), r[0]))
    for r in rows:
        w = words(r[1])
        keep = [True] * len(w)
        for i in range(len(w) - 12 if r[0] is not None else 0):
            if first[tuple(w[i: i + 13])] < r[0]:
                keep[i: i + 13] = [False] * 13
        yield r, w, keep


def test_substring_dedup(docs, none, rows):
    from mailsift.llm.substring_dedup import dedup

    exp = collections.Counter((r[0], len(w), len(w) - sum(k), " ".join(x for x, y in zip(w, k) if y)) for r, w, k in brute_dedup(rows))
    got = dedup(docs).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == exp
    for r in got:  # factors are the removed words, each with a smaller reference
        covered = {k for f in r.factors for k in range(f.start, f.start + f.words)}
        assert len(covered) == r.n_removed and all(f.words >= 13 and f.ref < r.doc_id for f in r.factors)
    carried = dedup(docs, keep=["lang", "source"])
    assert carried.count() == len(rows) and {"lang", "source", "text"} <= set(carried.columns)
    assert dedup(none).count() == 0


def test_substring_dedup_of_a_common_phrase(spark, monkeypatch):
    """A phrase of every document in ever different context: with a small HOT no
    block holds more entries than one window has, and the result is the same."""
    import pyarrow as pa

    from mailsift.llm import substring_dedup as S

    rng = random.Random(6)
    prose = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    phrase, passage = prose(5), prose(30)
    rows = [(i, " ".join([*prose(20), *phrase, *prose(20), *(passage if i % 7 == 0 else []), *phrase, *prose(9)])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    exp = sorted((r[0], " ".join(x for x, y in zip(w, k) if y)) for r, w, k in brute_dedup(rows))
    monkeypatch.setattr(S, "HOT", 50)
    assert sorted((r.doc_id, r.kept_text) for r in S.dedup(docs).collect()) == exp
    batch = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    found = pa.Table.from_batches(S._anchor_rows(S.WINDOW, S.ANCHOR)([batch])).group_by("anchor").aggregate([("places", "sum"), ("doc_id", "count")]).to_pylist()
    marked = {r["anchor"]: r["anchor"] | (int(S._SPLIT) if r["places_sum"] > 50 else 0) for r in found if r["doc_id_count"] > 1}
    lists = collections.defaultdict(list)
    for r in pa.Table.from_batches(S._anchor_rows(S.WINDOW, S.ANCHOR)([batch])).to_pylist():
        if r["anchor"] in marked:
            lists[r["doc_id"]].append(marked[r["anchor"]])
    both = batch.append_column("anchors", pa.array([lists[r[0]] for r in rows], pa.list_(pa.int64())))
    made = pa.Table.from_batches(S._entry_rows(S.WINDOW, S.ANCHOR)([both]))
    assert made.num_rows > 400 and max(collections.Counter(made.column("block").to_pylist()).values()) <= 100


def test_components_of_paths_and_stars(spark):
    from mailsift.llm.links import components

    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(1, 50)] + [(201, 200), (201, 202), (7, 7), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100 + k: 100 for k in range(50)} | {200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
