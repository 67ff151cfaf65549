"""Secrets against a search with the standard library."""

import hashlib
import random
import re

from cleanloom.llm import secret_scan

ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def as_text(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


def texts():
    random.seed(3)
    parts = ["password", "Secret", "api_key", "APIKEY", "token", "passwd", '"', "'", " ", ":", "=", "abcdef0123456789", "x" * 12, "é😀", "AKIA", "ABCDEFGH12345678",
             "AKIAAKIA", "\x01", "\x02", "\n", "deadbeef", "ff", "-", "ghp_" + "a1" * 20, "-----BEGIN RSA PRIVATE KEY-----", "pass", "word", "K"]
    made = ["".join(random.choices(parts, k=random.randint(0, 14))) for _ in range(400)]
    return [None, "", "secret=passwd: abcdefghijklmnop", "secret=token=abcdefghijklmnop", 'API_KEY : "aaaaaaaaaaaa', *made, ("x " * 5000 + "password=abcdefabcdef12 ") * 20]


def test_spans_equal_a_plain_search(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, t) for i, t in rows], "doc_id long, text string, kinds string")
    got = {r["doc_id"]: [(s["start"], s["order"], s["end"], s["kind"]) for s in r["found"]] for r in secret_scan.scan(docs).collect()}
    for i, t in rows:
        assert [s for s in got[i] if s[3] in ("assign", "access", "hex")] == base_spans(t), repr(t)[:200]
    assert any(s[3] == "private_key" for found in got.values() for s in found) and any(s[3] == "forge_token" for found in got.values() for s in found)


def test_null_ids_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "token=abcdefabcdef12"), (None, None), (1, "AKIA" + "A" * 14), (1, "nothing")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, as_text([(s["start"], 0, s["end"], s["kind"]) for s in r["found"]])) for r in secret_scan.scan(docs).collect())
    assert got == [(-1, ""), (-1, "assign:0:20"), (1, ""), (1, "access:0:18")]
    assert secret_scan.scan(docs.limit(0)).count() == 0


def test_trigram_queries():
    query = secret_scan.trigram_query
    assert query("hello") == frozenset([frozenset(["hel", "ell", "llo"])])
    assert query("[0-9a-f]{16,}") == secret_scan.ANY
    assert query("(?:cat|dog)s") == frozenset([frozenset(["cat", "ats"]), frozenset(["dog", "ogs"])])
    assert query("ab?cd+ef") == frozenset([frozenset(["abc"])]) | frozenset([frozenset()]) or query("ab?cd+ef") == secret_scan.ANY
    kinds = {r.kind: query(r.pattern) for r in secret_scan.RULES}
    assert frozenset(["aki", "kia"]) in kinds["access"] and len(kinds["assign"]) >= 5 and frozenset() not in kinds["assign"]


def test_query_on_the_small_table(spark):
    from cleanloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in QUERIES["op7_secret_scan"](spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        spans = base_spans(r["text"])
        want = [sum(s[3] == k for s in spans) for k in ("assign", "access", "hex")]
        assert [got[r["doc_id"]][c] for c in ("n_assign", "n_access", "n_hex")] == want
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(as_text(spans).encode()).hexdigest()
