"""Conversation repair, packing and spelling variants against plain versions, and on nulls, ties, repeats and clashing columns."""

import functools
import hashlib
import random
import re
import sys
import zlib
from array import array
from collections import Counter, defaultdict

import pytest

from cleanloom.llm import conversations, packing, spelling
from cleanloom.llm.queries import vocabulary

FOLDER = "/root/testdata/sf0.001"
sys.setrecursionlimit(20_000)  # the plain versions recurse over rows
CLASH = "c string, d string, k string, first long, key long, n long, word string"
EXTRA = ("x", "y", "z", 1, 2, 3, "w")


# conversations


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def plain_repair(rows):
    """Faults and the cheapest repair of one conversation (rows in order), by trying all edits from every state."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "o")
        seen.add((role, text))
    move = lambda p, r: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((p, r))

    @functools.cache
    def best(i, p, inserts):
        """Cost, letters and rows from row i in state p; a state that is met twice by inserts alone is never cheaper."""
        ways = [(0, "", ())] if i == len(rows) and p in ("", "a") else []
        if inserts < 3:
            for r in ("user", "assistant"):
                if (q := move(p, r[0])) is not None:
                    c, s, x = best(i, q, inserts + 1)
                    ways.append((5 + c, "I" + s, (f"{r}:", *x)))
        if i < len(rows):
            _, _, role, text = rows[i]
            c, s, x = best(i + 1, p, 0)
            ways.append((2 + c, "D" + s, x))
            if faults[i] in "to":
                more = 5 if faults[i] == "t" else 0
                for letter, price, r in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                    if (q := move(p, r[:1])) is not None:
                        c, s, x = best(i + 1, q, 0)
                        ways.append((price + more + c, letter + s, (f"{r}:{text}", *x)))
        return min(ways) if ways else (10**9, "~", ())

    cost, audit, lines = best(0, "", 0)
    turns = {t for _, t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    count = Counter(faults)
    return gaps, count["b"], count["d"], count["t"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def plain_report(rows):
    damaged = defaultdict(list)
    for r in plain_damage(rows):
        damaged[r[0]].append(r)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).hexdigest())
    return {conv: plain_repair(sorted(damaged[conv], key=key)) for conv in {r[0] for r in rows}}


def check_report(table):
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in conversations.report(table, conversations.damage(table)).collect()]
    assert len(got) == len({r[0] for r in got})
    assert {r[0]: r[1:] for r in got} == plain_report(rows)


@pytest.fixture(scope="module")
def odd_conversations(spark):
    rng = random.Random(3)
    texts = ["", " \t\n", "Yes.", "No", "Hm?", "é!  \n", "a.b", None, "long " * 5000 + "."]
    roles = ["user", "assistant", "system", "", None, "tool", "useful", "Ü"]
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, *range(9)]), rng.choice(roles[:3] if rng.random() < 0.7 else roles), rng.choice(texts)) for _ in range(500)]
    rows += [(100, k // 2, "user", "Same.") for k in range(40)] + [(101, None, "assistant", "x")] * 3
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], f"conv_id long, turn long, role string, text string, {CLASH}")


def test_conversations(spark, odd_conversations):
    check_report(spark.read.parquet(f"{FOLDER}/conversations.parquet"))
    check_report(odd_conversations)
    assert conversations.report(odd_conversations.limit(0), conversations.damage(odd_conversations.limit(0))).count() == 0


def test_long_conversation_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE", 7)
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2]), t, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "B", "C?", " ", f"text {t}."])) for t in range(600)]
    check_report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))


def test_repaired_rows_have_the_digest(spark, odd_conversations):
    damaged = conversations.damage(odd_conversations)
    rows = defaultdict(list)
    for conv, place, edit, role, text in sorted(map(tuple, conversations.repair(damaged, with_rows=True).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        rows[conv].append(f"{role}:{text}")
        assert edit in "KRI" and len(rows[conv]) == place + 1
    for r in conversations.repair(damaged).collect():
        assert hashlib.sha256("\n".join(rows[r["conv_id"]]).encode()).hexdigest() == r["repaired_sha256"]


@pytest.mark.parametrize("seed", range(4))
def test_blocks_equal_single_steps(seed):
    rng = random.Random(seed)
    tables = conversations.tables()
    for n in range(0, 60):
        symbols = bytes(rng.randrange(12) for _ in range(n))

        @functools.cache
        def best(i, p, inserts, symbols=symbols):
            ways = [(0, "")] if i == len(symbols) and p in (0, 3) else []
            if inserts < 3:
                c, s = best(i, conversations.ANY[p], inserts + 1)
                ways.append((5 + c, "I" + s))
            if i < len(symbols):
                for letter, price, q in tables.edits(min(symbols[i], 8), p):
                    c, s = best(i + 1, q, 0)
                    ways.append((price + c, letter + s))
            return min(ways) if ways else (10**9, "~")

        assert tables.solve(symbols) == best(0, 0, 0)


# packing


def check_packing(table, capacity=1024, **options):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = Counter()
    for r in table.select("doc_id", "text").collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % capacity + 1
        for k, start in enumerate([0, *range(first, len(ids), capacity)]):
            part = ids[start : first if k == 0 else start + capacity]
            want[r["doc_id"], k, start, len(part), zlib.crc32(array("I", part))] += 1
    got = packing.pack(table, vocabulary("byte_bpe_50k.json"), capacity=capacity, **options).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(r["length"] for r in got) // capacity)


def test_packing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    made, least = check_packing(docs)
    assert least <= made <= least + 2
    rows = [(None, None), (None, "a"), (1, ""), (1, ""), (2, "<|endoftext|>  x\x1c\x85 　​ İş 한글"), (3, "word " * 9000), (3, "word " * 9000), (4, "ﷺ é" * 500)]
    odd = spark.createDataFrame([(*r, *EXTRA) for r in rows], f"doc_id long, text string, {CLASH}")
    check_packing(odd)
    check_packing(odd, capacity=3)
    assert packing.pack(docs.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


def test_packing_numbers_documents_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_DOCUMENTS", 20)
    docs = spark.createDataFrame([(i % 300, "same text" if i % 3 else f"{i} " * (i % 40)) for i in range(900)], "doc_id long, text string")
    check_packing(docs, capacity=64)


def content(p):
    out = Counter()
    for group, m in p.items():
        assert m > 0
        for s in group:
            out[s] += m
    return out


def test_genetic_steps_keep_every_document():
    rng = random.Random(1)
    lengths = Counter(rng.randint(1, 1023) for _ in range(3000)) + Counter({7: 5000, 700: 900})
    population = packing.first_population(lengths, 6, 1024, rng, True)
    before = packing.worth(population[0])
    for _ in range(60):
        a, b = rng.sample(population, 2)
        child = packing.mutation(packing.crossover(a, b, 1024, rng), 1024, rng)
        assert content(child) == lengths and all(sum(g) <= 1024 for g in child)
        population[rng.randrange(1, 6)] = child
    assert packing.worth(packing.evolve(population, 0, 100, 1024, rng)[0]) <= before


def test_islands_find_what_best_fit_misses(spark):
    # triples that fill a sequence exactly; longest first in best fit pairs them badly
    rng = random.Random(2)
    lengths = Counter()
    for _ in range(40):
        a = rng.randint(260, 420)
        b = rng.randint(260, 420)
        lengths += Counter([a, b, 1024 - a - b])
    plain: packing.Packing = {}
    packing.best_fit(plain, lengths, 1024)
    best = packing.pack_lengths(spark, dict(lengths))
    assert content(best) == lengths
    assert 40 <= sum(best.values()) < sum(plain.values())


# spelling


def plain_variants(rows):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            total[run] += 1
    n = {w: c for w, c in total.items() if len(w) >= 6 and c >= 5}
    near = defaultdict(set)
    for a in n:
        for b in n:
            if a < b:
                if abs(len(a) - len(b)) > 1:
                    continue
                p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
                if a[p + (len(a) >= len(b)) :] == b[p + (len(b) >= len(a)) :]:
                    near[a].add(b)
                    near[b].add(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return out


def check_variants(table):
    rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
    got = [tuple(r) for r in spelling.variants(table).select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_variants(rows)


def test_variants(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    check_variants(docs)
    rng = random.Random(4)
    words = ["banana", "bananas", "bananaé", "Banana", "aaaaaaa", "aaaaaa", "aaaaaaaa", "Écoles", "écoles", "ecoles", "×÷×÷×÷", "abcabcd", "abcacbd", "x" * 3000, "x" * 2999, "short"]
    rows = [(rng.choice([None, 1, 2, 3]), " ".join(rng.choice(words[: rng.randint(2, 16)]) for _ in range(60))) for _ in range(150)]
    rows += [(9, None), (9, ""), (7, "banana " * 400), (7, "banana " * 400)]
    odd = spark.createDataFrame([(*r, *EXTRA) for r in rows], f"doc_id long, text string, {CLASH}")
    check_variants(odd)
    assert spelling.variants(odd.limit(0)).count() == 0 == spelling.variants(odd.where("text IS NULL")).count()
