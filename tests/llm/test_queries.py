"""The registered queries on whole tables against plain restatements of what they must return."""

import collections
import gzip
import hashlib
import math
import re
import zlib

import duckdb
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
import xxhash
from gridspan.llm import bpe, queries, warc
from gridspan.llm.common import floor_for

DATA = "/root/testdata/sf0.001"
SPACE = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def texts():
    table = pd.read_parquet(f"{DATA}/documents.parquet")
    return dict(zip(table.doc_id.tolist(), table.text.tolist(), strict=True))


def rows(spark, name):
    return {r[0]: r for r in queries.queries()[name](spark, DATA).collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, expect = queries.queries()[name](spark, DATA).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expect.columns) and len(got)
    plain = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(df.notna(), None).map(lambda x: int(x) if isinstance(x, float) else x).itertuples(index=False, name=None)))
    assert plain(got) == plain(expect)


def test_language_query(spark, texts):
    out = rows(spark, "op1_language")
    assert out.keys() == texts.keys()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for i, r in out.items())
    lang = dict(pd.read_parquet(f"{DATA}/documents.parquet")[["doc_id", "lang"]].itertuples(index=False))
    held = [i for i, r in out.items() if r["held_out"] and lang[i] is not None and r["lang_pred"] != "und"]
    assert sum(out[i]["lang_pred"] == lang[i] for i in held) >= 0.9 * len(held)


def test_unigram_base(spark, texts):
    out = rows(spark, "op2_ctw")
    tokens = {i: [*re.findall(SPACE, low(t)), " "] for i, t in texts.items()}
    counts = collections.Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = out[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws), rel=1e-9)
        assert r["score"] <= 0


def test_bpe_query(spark, texts):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoding = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for i, r in rows(spark, "op3_bpe").items():
        ids = encoding.encode_ordinary(texts[i] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(texts[i] or ""))


def test_pii_query(spark, texts):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    some = False
    for i, r in rows(spark, "op4_pii").items():
        found = {k: [m.span() for m in re.finditer(p, texts[i] or "") if ok(m[0])] for k, (p, ok) in kinds.items()}
        assert {k: r[f"n_{k}"] for k in kinds} == {k: len(v) for k, v in found.items()}
        listed = [f"{k}:{a}:{b}" for k, v in found.items() for a, b in v]
        assert r["base_sha256"] == sha(",".join(listed)) and set(listed) <= set(r["spans"].split(","))
        some = some or bool(listed)
    assert some


def test_quality_rules_query(spark, texts):
    for i, r in rows(spark, "op5_quality_rules").items():
        text = texts[i] or ""
        words = re.findall(SPACE, text)
        windows = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        repeated = {p for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for p in range(k, k + 8)}
        lines = [x for x in text.split("\n") if re.search(SPACE, x)]
        failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
        expect = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed)
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == expect
        assert not (failed and r["kept"])


def test_secrets_query(spark, texts):
    letters = lambda word: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)
    names = "|".join([*map(letters, ("password", "passwd", "secret", "token")), f"{letters('api')}_?{letters('key')}"])
    kinds = {"assign": (rf"""(?:{names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8), "access": (r"AKIA[A-Z0-9]+", 0, 16), "hex": (r"[0-9a-f]+", 0, 32)}
    for i, r in rows(spark, "op6_secrets").items():
        found = [(m.start(), n, k, m.end()) for n, (k, (p, group, least)) in enumerate(kinds.items()) for m in re.finditer(p, texts[i] or "") if len(m[group]) >= least]
        listed = [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]
        assert r["base_sha256"] == sha(",".join(listed)) and set(listed) <= set(r["spans"].split(",")) | {""}
        assert {k: r[f"n_{k}"] for k in kinds} == {k: sum(x[2] == k for x in found) for k in kinds}


def test_simhash_query(spark, texts):
    prints = {}
    for i, text in texts.items():
        words = re.findall(SPACE, low(text))
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
    root = {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2 and top(a) != top(b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    out = rows(spark, "op7_simhash")
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in out.items()} == {i: (f"{prints[i]:016x}", top(i)) for i in ids}


def test_positive_unlabelled_query(spark, texts):
    out = rows(spark, "op8_quality_pu")
    assert out.keys() == texts.keys()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for i, r in out.items())


def test_floor_bounds_whatever_the_counts(spark):
    table = spark.range(4000).selectExpr("id * 1000000 + 1 as n", "2L as w")
    floor = floor_for(table, "n", 100)
    assert 90 <= table.filter(table["n"] >= floor).count() <= 100
    assert table.filter(table["n"] >= floor_for(table, "n", 100, "w")).count() <= 50
    ties = spark.range(10).selectExpr("7L as n")
    assert ties.filter(ties["n"] >= floor_for(ties, "n", 9)).count() == 0 and floor_for(ties, "n", 10) == 7


def test_members_of_several_records():
    def record(i):
        block = b"HTTP/1.1 200 OK\r\n\r\nbody %d" % i
        return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, len(block), block)

    whole = gzip.compress(record(1) + b"noise" + record(2)) + gzip.compress(record(3)) + gzip.compress(b"nothing")
    out = list(warc.salvage(whole))
    assert [h and h["warc-record-id"] for *_, h, _ in out] == ["<urn:page:1>", None, "<urn:page:2>", "<urn:page:3>", None]
    assert [reason for _, _, reason, *_ in out] == [None, "no version line", None, None, "no version line"]
