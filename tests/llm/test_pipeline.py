"""The corpus pipeline against a brute-force version of its five stages, and
the oracles' queries against DuckDB on the smallest tables."""

import collections
import itertools
import os
import re
import sys
import zlib

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_operators import brute_dedup, luhn, shingles, words  # noqa: E402

SF001 = "/root/testdata/sf0.001"


def _rules(rows):
    norm = lambda line: re.sub("[\x20\x09-\x0D]+", " ", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)).strip(" ")
    held, hosts = collections.Counter(), collections.Counter()
    for _, text, _, source, _ in rows:
        hosts[source] += 1
        held.update({(source, norm(x)) for x in text.split("\n") if words(x)})
    for i, text, lang, source, _ in rows:
        w = words(text)
        seen = collections.Counter(tuple(w[k: k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if seen[tuple(w[k: k + 8])] > 1 for j in range(k, k + 8)}
        text = "\n".join(x for x in text.split("\n") if not (words(x) and held[source, norm(x)] > 20 and held[source, norm(x)] > 0.1 * hosts[source]))
        if len(w) >= 20 and 100 * len(covered) <= 30 * len(w) and len(words(text)) >= 0.3 * len(w):
            yield (i, text, lang, source, len(text))


def _near(rows):
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations([(r[0], shingles(r[1], 5)) for r in rows], 2):
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return [r for r in rows if find(r[0]) == r[0]]


def _substrings(rows):
    for r, w, keep in brute_dedup(rows):
        text = r[1] if all(keep) else " ".join(x for x, k in zip(w, keep) if k)
        if any(keep) or not w:
            yield (r[0], text, r[2], r[3], len(text))


def test_pipeline_equals_brute_force(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = sorted(tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in docs.collect())
    exp = rows
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    for k, brute in enumerate((_rules, _near, _substrings)):
        docs = corpus_pipeline.STAGES[k][1](spark, docs, SF001)
        exp = sorted(brute(exp))
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        assert sorted(map(tuple, docs.collect())) == exp
    assert len(exp) < len(rows)
    clean = corpus_pipeline.STAGES[3][1](spark, docs, SF001).collect()
    assert [r.doc_id for r in sorted(clean, key=lambda r: r.doc_id)] == [r[0] for r in exp]
    for r in clean:
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text)
        assert not any(16 <= len(digits(m)) <= 19 and luhn(digits(m)) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", r.text))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = collections.Counter()
    for r in clean:
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0]
        edges = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)]
        pieces.update((r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:])))
    got = corpus_pipeline.run(spark, SF001).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    fill = collections.Counter()
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048


@pytest.mark.parametrize("name", ["op1_sharding", "op6_quality_rules", "op9_epsilon_grid", "op10_substring_dedup"])
def test_query_equals_oracle(spark, name):
    from mailsift.llm import queries

    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF001}/{table}.parquet'")
    ran = con.execute(queries.oracle_sql()[name])
    names = sorted(d[0] for d in ran.description)
    order = [[d[0] for d in ran.description].index(n) for n in names]
    exp = sorted(repr([row[i] for i in order]) for row in ran.fetchall())
    got = queries.queries()[name](spark, SF001)
    assert sorted(got.columns) == names
    assert sorted(repr([r[n] for n in names]) for r in got.collect()) == exp


def test_every_operator_has_one_query():
    from mailsift.llm import queries

    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
