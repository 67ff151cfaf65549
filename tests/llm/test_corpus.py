"""Corpus operators against plain versions, and on nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cleanloom.llm import ann, bpe, extract, line_dedup, mixing, ngram_join, quality, token_files, toxicity
from cleanloom.llm.queries import QUERIES, SQL, vocabulary

FOLDER = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, repeats, blanks, a long text, and columns named like the operators' own."""
    long = "word " * 30000 + "\n" + "İş ÄÖ 한글 <|endoftext|> \x1c\x85 end"
    rows = [(None, None, None), (None, "a\nb", "s"), (1, "", "s"), (1, "", "s"), (2, " \t\n\x0b", None), (3, "One two.\nOne two.", "t"), (4, long, "t"), (5, "x", "")]
    rows += [(10 + i, f"Shared Line \n own {i} line of this text here", "t") for i in range(12)]
    return spark.createDataFrame([(i, t, s, "x", 7, 1) for i, t, s in rows], "doc_id long, text string, source string, line string, n long, label int")


def by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    return out


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got = QUERIES[name](spark, FOLDER)
    want = con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = ", ".join(sorted(got.columns))
    assert sorted(map(tuple, got.selectExpr(*columns.split(", ")).collect()), key=str) == sorted(con.sql(f"SELECT {columns} FROM want").fetchall(), key=str)


def test_encoding_as_the_library(spark, docs, odd):
    from tokenizers import Tokenizer

    whole, words = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    for table in (docs, odd):
        rows = sorted(table.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
        ids = [whole.encode(r["text"] or "", add_special_tokens=False).ids for r in rows]
        want = [(r["doc_id"], len(i), hashlib.sha256(array("I", i)).hexdigest(), hashlib.sha256(whole.decode(i, skip_special_tokens=False).encode()).hexdigest()) for r, i in zip(rows, ids, strict=True)]
        assert Counter(map(tuple, bpe.round_trip(table, vocabulary("byte_bpe_50k.json")).collect())) == Counter(want)
        assert Counter(bytes(r["ids"]) for r in bpe.encode(table, vocabulary("byte_bpe_50k.json")).collect()) == Counter(array("I", i).tobytes() for i in ids)
        folder, manifest = token_files.write_tokens(table, vocabulary("word_bpe_49k.json"), 2)
        got = [tuple(r) for r in token_files.read_tokens(spark, folder, manifest, with_ids=False).orderBy("start").collect()]
        start, want = 0, []
        for r in rows:
            i = [*words.encode(r["text"] or "", add_special_tokens=False).ids, 2]
            want.append((r["doc_id"], start, len(i), zlib.crc32(array("I", i).tobytes())))
            start += len(i)
        assert sorted(got, key=str) == sorted(want, key=str)
    folder, manifest = token_files.write_tokens(docs.limit(0), vocabulary("word_bpe_49k.json"), 2)
    assert token_files.read_tokens(spark, folder, manifest).count() == 0 == bpe.encode(docs.limit(0), vocabulary("byte_bpe_50k.json")).count()


def test_words_as_the_library(docs):
    import json
    import random

    from tokenizers import Tokenizer

    with open(vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        text = f.read()
    changed = json.loads(text)
    changed["normalizer"] = {"type": "Lowercase"}
    pieces = ["a", "It's", "'S", "É", "É", "İ", "ΣΑΣ", "½", "12", "<|endoftext|>", "<|ENDOFTEXT|>", "</w>", "…", "“x”", "\x00", "\x1c", "\x85", "\u3000", "中文", "かな", "한국어", "Ё", "Ÿ", "ŉ", "ﬁ", "a_b", "\x0b", "µ", "ß", "\n", "\t", "don't"]
    draw = random.Random(7)
    texts = ["".join(draw.choice(pieces) + draw.choice(["", " ", "\n"]) for _ in range(draw.randrange(14))) for _ in range(3000)]
    texts += [r["text"] or "" for r in docs.select("text").collect()] + ["ab" * 200_000]
    for known, vocab in ((True, text), (False, json.dumps(changed))):
        own, library = token_files.WordEncoder(vocab), Tokenizer.from_str(vocab)
        assert (own.words is not None) == known
        assert all(own.encode(t) == array("I", library.encode(t, add_special_tokens=False).ids).tobytes() for t in texts)


def test_a_run_is_encoded_once(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    with open(vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        vocab = f.read()
    own, library = token_files.WordEncoder(vocab), Tokenizer.from_str(vocab)
    seen, by_library, merge = [], own.by_library, own.words.encode_to_numpy
    monkeypatch.setattr(own, "by_library", lambda run: seen.append(run) or by_library(run))
    monkeypatch.setattr(own.words, "encode_to_numpy", lambda words: seen.append(words) or merge(words))
    text = "It's ΣΑΣ, <|endoftext|>\x0b\u3000x\x85 \t" * 100 + "12 It's"
    ids = lambda t: array("I", library.encode(t or "", add_special_tokens=False).ids).tobytes()
    assert own.encode(text) == ids(text)
    assert sum(map(len, seen)) < 100  # 2,710 when each run is encoded where it stands
    texts = [None, "", " ", "a\nb", text, "İ", None, "e\u0301 \u0301", "b a", "", *[f"n{i} a" for i in range(50)], "ab" * 3000, "\n\r\x0c"]
    for table in (pa.array(texts), pa.array(["z", *texts, "z"])[1:-1], pa.array(texts, pa.large_string()), pa.array([], pa.string())):
        assert own.encode_all(table) == [ids(t) for t in table.to_pylist()]
        for size in (1, 40, 10**6):
            monkeypatch.setattr(token_files, "PORTION", size)
            assert [t for p in token_files.portions(table) for t in table[p].to_pylist()] == table.to_pylist()


@pytest.mark.parametrize("n", [0, 1, 239, 240, 241, 5000, 70_000])
def test_packed_words_come_back(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50_000, n), rng.integers(0, 3, n), np.zeros(n, int), rng.integers(0, 1 << 62, n), (2 ** rng.uniform(0, 40, n)).astype(int)):
        assert (token_files.unpack_block(token_files.pack_block(ids), n) == ids.astype(np.uint64)).all()


def shingle_set(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_components(sets):
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def check_components(table):
    rows = [(r["doc_id"], shingle_set(r["text"])) for r in table.select("doc_id", "text").collect()]
    label = plain_components([s for _, s in rows])
    least = {}
    for (i, _), x in zip(rows, label, strict=True):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    want = Counter((i, len(s), least.get(x, i) if s else i) for (i, s), x in zip(rows, label, strict=True))
    assert Counter(map(tuple, ngram_join.near_documents(table).collect())) == want


def test_near_documents(spark, docs, odd, monkeypatch):
    check_components(docs)
    check_components(odd)
    assert ngram_join.near_documents(docs.limit(0)).count() == 0
    # a chain of near texts, in blocks too small for it and with every prefix lengthened
    words = [f"w{i}" for i in range(400)]
    chain = [(100 + k, " ".join(words[3 * k : 3 * k + 100])) for k in range(60)] + [(900, " ".join(words[:100]).upper())]
    table = spark.createDataFrame(chain, "doc_id long, text string")
    check_components(table)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 1000)
    monkeypatch.setattr(ngram_join, "COSTLY", 0)
    check_components(table)


def test_line_dedup(docs, odd):
    kept = by_id(line_dedup.drop_shared_lines(odd))
    assert [r["text"] for r in kept[10]] == [" own 0 line of this text here"] and kept[10][0]["_n_dropped"] == 1
    assert sorted((r["text"], r["_n_lines"]) for r in kept[None]) == [("", 1), ("a\nb", 2)] and len(kept[1]) == 2
    assert kept[3][0]["text"] == "One two.\nOne two." and kept[10][0]["line"] == "x"
    first = by_id(line_dedup.drop_shared_lines(odd, keep_first=True))
    assert sum(r["_n_dropped"] for rows in first.values() for r in rows) == 11
    assert line_dedup.drop_shared_lines(odd.limit(0)).count() == 0


def test_mixing(spark, docs, odd):
    for table in (docs, odd):
        planned = mixing.plan(table).collect()
        again = {(r["doc_id"], r["text_hash"], r["source"]): tuple(r) for r in mixing.plan(table.repartition(3)).collect()}
        assert {(r["doc_id"], r["text_hash"], r["source"]): tuple(r) for r in planned} == again
        taken, longest = Counter(), Counter()
        for r in planned:
            assert 0 <= r["taken"] <= 3 * r["size"] and len(r["positions"]) == r["copies"] and all(0 <= p <= 1 for p in r["positions"])
            taken[r["source"]] += r["taken"] * r["n_rows"]
            longest[r["source"]] = max(longest[r["source"]], r["size"] * r["n_rows"])
        for r in planned:
            assert abs(taken[r["source"]] - r["target"]) <= longest[r["source"]]
        mixed = mixing.mix(table)
        assert mixed.count() == sum(r["copies"] * r["n_rows"] for r in planned)
        at = [r["position"] for r in mixed.collect()]
        assert at == sorted(at)
    assert mixing.mix(docs.limit(0)).count() == 0
    x = spark.range(101).select((F.col("id") / 100).alias("share"))
    due = [r[0] for r in x.select(mixing.when_due(F.col("share"), ((0.0, 0.5), (0.5, 0.75), (1.0, 1.75)))).collect()]
    area = lambda t: (0.5 * t + 0.25 * t * t if t <= 0.5 else 0.3125 + 0.75 * (t - 0.5) + (t - 0.5) ** 2) / 0.9375
    assert max(abs(area(t) - k / 100) for k, t in enumerate(due)) < 1e-9


def plain_positions(table, schedules):
    """Positions of all copies taken, by stepping through each source's schedule in small steps."""
    sources = defaultdict(list)
    for r in table.select("doc_id", "source", "text").collect():
        sources[r["source"]].append((hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), r["doc_id"], len(WORDS.findall(r["text"] or ""))))
    targets = {r["source"]: r["target"] for r in mixing.plan(table).select("source", "target").distinct().collect()}
    out = {}
    for n, source in enumerate(sorted(sources, key=lambda s: (s is None, (s or "").encode()))):
        knots, demand = schedules[n % len(schedules)], 0.0
        t = np.linspace(0, 1, 20_001)
        level = np.interp(t, *zip(*knots, strict=True))
        given = np.concatenate([[0.0], np.cumsum((level[1:] + level[:-1]) / 2)])
        for k in range(3):
            for _, doc, size in sorted(sources[source]):
                if targets[source] and demand + size / 2 <= targets[source]:
                    out.setdefault(doc, []).append(float(np.interp((demand + size / 2) / targets[source], given / given[-1], t)))
                demand += size
    return out


def test_positions_follow_the_schedule(docs):
    other = (((0.0, 0.0), (1.0, 2.0)), ((0.0, 2.0), (1.0, 0.0)), ((0.0, 1.0), (0.25, 3.0), (1.0, 0.1)))
    first = {}
    for schedules in (mixing.SCHEDULES, other):
        want = plain_positions(docs, schedules)
        got = {r["doc_id"]: r["positions"] for r in mixing.plan(docs, schedules=schedules).collect()}
        assert all(np.allclose(p, want.get(d, []), atol=2e-4) for d, p in got.items())
        first[schedules] = [d for _, d in sorted((p[0], d) for d, p in got.items() if p)]
    assert first[mixing.SCHEDULES] != first[other]


def test_columns_that_clash(spark):
    names = ["_id", "_hash", "_runs", "_source", "_position", "positions", "position", "mark", "lines", "planned", "gone", "_gone", "_lines", "doc_id_", "text_hash", "runs", "size", "copies"]
    rows = [(i, f"shared line\nown {i} of many words here now", "s" if i % 2 else None, *range(len(names))) for i in range(12)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names))
    kept = line_dedup.drop_shared_lines(table, counts=False)
    assert kept.columns == table.columns and {r["runs"] for r in kept.collect()} == {names.index("runs")}
    assert all("shared" not in r["text"] for r in kept.collect())
    assert ngram_join.one_of_each(table).columns == table.columns and ngram_join.one_of_each(table).count() == 12
    mixed = mixing.mix(table)
    assert mixed.columns == [*table.columns, "position_"] and mixed.count() > 0


def test_mixing_query_reads_the_sorted_copies(spark, docs, odd, monkeypatch):
    for table in (docs, odd):
        planned = {tuple(r[c] for c in mixing.UNIT): r for r in mixing.plan(table).collect()}
        copies = mixing.in_order(mixing.plan(table)).collect()
        assert [r["position"] for r in copies] == sorted(r["position"] for r in copies)
        assert Counter((*(r[c] for c in mixing.UNIT), r["position"]) for r in copies) == Counter((*u, p) for u, r in planned.items() for p in r["positions"])
        for r in mixing.placed(mixing.plan(table)).collect():
            plain = planned[tuple(r[c] for c in mixing.UNIT)]
            assert (r["copies"], r["taken"], r["first_position"]) == (plain["copies"], plain["taken"], min(plain["positions"], default=None))
    assert mixing.placed(mixing.plan(docs.limit(0))).count() == 0
    seen = []
    whole = mixing.in_order
    monkeypatch.setattr(mixing, "in_order", lambda planned: seen.append(whole(planned)) or seen[-1].where("doc_id % 2 = 0"))
    got = QUERIES["op5_mixing"](spark, FOLDER).collect()
    assert len(seen) == 1 and "position" in seen[0].columns
    assert all(not r["taken"] for r in got if r["doc_id"] % 2) and any(r["taken"] for r in got)


def test_quality_figures_and_labels(spark, docs, odd):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    for table in (docs, odd):
        for r in quality.judge(table).join(table.select("doc_id", "text"), "doc_id").collect():
            if table is odd and r["doc_id"] == 1:
                continue
            text = r["text"] or ""
            words = WORDS.findall(text)
            windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
            again = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
            lines = [x for x in text.split("\n") if WORDS.search(x)]
            want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
            assert r["base_failed"] == (len(words) < 10 or 100 * len(again) > 20 * len(words)) and not (r["base_failed"] and r["kept"])
    # Viterbi against all labellings
    rng = np.random.default_rng(0)
    model = quality.LineModel(tuple(rng.normal(size=quality.N_FEATURES)), (0.3, -0.2), ((0.5, -0.4), (0.1, 0.2)))
    for n in (1, 2, 6):
        x = rng.normal(size=(n, quality.N_FEATURES))
        emit = x @ np.array(model.weights)
        score = lambda y: model.start[y[0]] + sum(emit[i] * y[i] for i in range(n)) + sum(model.moves[y[i - 1]][y[i]] for i in range(1, n))  # noqa: B023, E731
        best = max(([int(b) for b in f"{k:0{n}b}"] for k in range(1 << n)), key=score)
        assert quality.label_lines(x, model).astype(int).tolist() == best
    assert quality.learn(docs, labels.limit(0)) == quality.DEFAULT


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.score(docs, toxicity.learn(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.97 * len(rows)
    assert sum(r["predicted"] and not r["toxic"] for r in rows) <= 0.01 * len(rows)


def test_toxicity_disguises_and_odd_rows(spark, odd):
    lexicon = toxicity.Lexicon({" idiot ": 5.0, " trash ": 5.0}, -3.0, 4.0)
    judge = toxicity.Scorer(lexicon)
    for bad in ("what an 1d10t!", "IDIOT", "іdіоt", "id​iot", "trash."):
        assert judge.score(f"you {bad} there") >= 0.5, bad
    for fine in ("", "idiotic", "the trash can is full", "clean words"):
        assert judge.score(fine) < 0.5, fine
    assert toxicity.score(odd, lexicon).count() == odd.count() == toxicity.reject(odd, lexicon).count()
    assert toxicity.reject(odd, lexicon).schema == odd.schema
    empty = toxicity.learn(odd.limit(0), odd.select("doc_id", F.col("label").alias("toxic")).limit(0))
    assert toxicity.Scorer(empty).score("x") < 0.5


def test_pages(spark):
    page = (
        "<html><head><title>T</title><script>var t='</p>';</script></head><body><header>Top</header><nav><a href=x>Menu</a></nav>"
        "<div class='cookie-notice'>We use cookies</div>{}<aside>Side</aside><div id=comments><p>First!</p></div><footer>&copy; end</footer></body></html>"
    )
    body = "<h1>A &amp; B</h1><p><b>One  \n two.<br><p>" + "Long text here. " * 20 + "<p>Short.</p><ul><li>x<li>y</ul>"
    want = "A & B\nOne two.\n" + ("Long text here. " * 20).strip() + "\nShort.\nx\ny"
    for form in ("<article>{}</article>", "<main><div>{}</div></main>", "<div class=post>{}</div>"):
        assert extract.main_text(page.format(form.format(body))) == want
    rows = spark.createDataFrame([(None, None, None, "c"), (1, "u", "", "c"), (2, "u", "<p", "c"), (3, "u", "plain", "c")], "page_id long, url string, html string, text string")
    assert Counter((r["page_id"], r["text"], r["n_chars"]) for r in extract.extract(rows).collect()) == Counter([(None, "", 0), (1, "", 0), (2, "", 0), (3, "plain", 5)])


LONG = "Long text of the story here. " * 12


@pytest.mark.parametrize(
    "inner",
    ["<script>var a='x';</script>", "<style>p {}</style>", "<button class=b>Share</button>", "<svg><title>Icon</title><path d=x /><text>t</text></svg>", "<iframe src=x><p>old</p></iframe>",
     "<textarea>type</textarea>", "<template><div><p>later</p></div></template>", "<object><div>none</div></object>", "<button><svg><path></svg><div>deep</div></button>"],
)
def test_pages_keep_the_block_around_a_hidden_element(inner):
    page = "<body><div><p>{} Intro {} rest of it</p><p>{}</p></div></body>"
    assert extract.main_text(page.format(LONG, inner, LONG)) == f"{LONG.strip()} Intro rest of it\n{LONG.strip()}"
    assert extract.main_text(f"<p>Intro {inner} rest</p>") == "Intro rest"


def test_pages_with_hidden_elements_left_open():
    assert extract.main_text(f"<div><p>Intro <button>Share</p><p>{LONG}</p></div>") == f"Intro\n{LONG.strip()}"
    assert extract.main_text("<p>Intro <button>Share") == "Intro"


def test_pages_keep_all_content_blocks():
    p = lambda n: "<p>" + f"Part {n} of the story. " * 12 + "</p>"
    t = lambda n: (f"Part {n} of the story. " * 12).strip()
    article = f"<article>{p(1)}{p(2)}</article>"
    two = f"{t(1)}\n{t(2)}"
    assert extract.main_text(f"<body><main><h1>Title</h1>{article}</main></body>") == f"Title\n{two}"
    assert extract.main_text(f"<body><h1>Title</h1><div class=post>{p(1)}{p(2)}</div></body>") == f"Title\n{two}"
    for tag in ("article", "div"):
        pair = f"<{tag}>{p(1)}{p(2)}{p(3)}</{tag}><{tag}>{p(4)}{p(5)}</{tag}>"
        for form in ("<body>{}</body>", "<main>{}</main>", "<div>{}</div>"):
            assert extract.main_text(form.format(pair)) == "\n".join(t(n) for n in range(1, 6))
    # a mark on what holds the article hides nothing; one on a small part does
    side = "<div class='sidebar widget-9'>Other news</div>"
    for mark in ("layout has-sidebar", "elementor-widget", "search-page"):
        assert extract.main_text(f"<body><div class='{mark}'>{article}{side}</div></body>") == two
        assert extract.main_text(f"<body><div class='{mark}'>{p(1)}{p(2)}</div>{side}</body>") == two
    parts = "".join(f"<div class='elementor-widget' id=widget-{n}>{p(n)}</div>" for n in (1, 2))
    assert extract.main_text(f"<body><div>{parts}</div>{side}</body>") == two
    replies = "<div id=comments class=comments-area><article class=comment-body><p>I liked it.</p></article></div>"
    assert extract.main_text(f"<body><main>{article}</main>{replies}</body>") == two


def test_nearest_recall_and_odd_vectors(spark, monkeypatch):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = vectors.select("vec_id", "embedding").collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    monkeypatch.setattr(ann, "BLOCK", 64)
    found = defaultdict(list)
    for r in ann.search(vectors, F.col("vec_id") % 100 == 0, list_size=25).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for i in np.flatnonzero(ids % 100 == 0):
        gap = np.sqrt(((x - x[i]) ** 2).sum(1))
        gap[i] = np.inf
        got = sorted(found[ids[i]])
        assert [k for k, _, _ in got] == list(range(1, 11)) and all(abs(s - gap[np.flatnonzero(ids == v)[0]]) < 1e-12 for _, v, s in got)
        hits += len({v for _, v, _ in got} & set(ids[np.lexsort((ids, gap))[:10]].tolist()))
    assert hits >= 0.9 * 10 * len(found)
    odd = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (200, [0.0, 0.0]), (7, [4.0, 4.0])]
    table = spark.createDataFrame([(i, v, 1) for i, v in odd], "vec_id long, embedding array<double>, score int")
    got = sorted(map(tuple, ann.search(table, F.col("vec_id") % 100 == 0).collect()))
    assert got == [(0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 7, 5.0), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 7, 5.0)]
    assert ann.search(table.limit(0), F.lit(True)).count() == 0


def test_nearest_rows_that_share_an_id(spark, monkeypatch):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [2.0, 0.0]), (1, [1.0, 0.5]), (100, [9.0, 9.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = Counter()
    for i, (q, x) in enumerate(rows):
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), v) for j, (v, y) in enumerate(rows) if j != i)[:3]
            want.update((q, n + 1, v, s) for n, (s, v) in enumerate(near))
    for block in (4096, 2):
        monkeypatch.setattr(ann, "BLOCK", block)
        got = ann.search(table, F.col("vec_id") % 100 == 0, k=3).collect()
        assert Counter(map(tuple, got)) == want


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    judge = toxicity.Scorer(toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    rows = {i: r["text"] for i, r in rows.items() if judge.score(r["text"]) < 0.5}
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    held = Counter(k for t in rows.values() for k in {key(x) for x in t.split("\n")} if k)
    rows = {i: "\n".join(x for x in t.split("\n") if held[key(x)] < 10) for i, t in rows.items()}
    ids = sorted(rows)
    label = plain_components([shingle_set(rows[i]) for i in ids])
    keep = {i for n, i in enumerate(ids) if label[n] == n}
    out = pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in out} <= keep
    assert all(r["decoded_sha256"] == hashlib.sha256(rows[r["doc_id"]].encode()).hexdigest() for r in out)
    words = sum(len(WORDS.findall(rows[i])) for i in keep)
    assert abs(sum(len(WORDS.findall(rows[r["doc_id"]])) for r in out) - words) <= 0.1 * words
