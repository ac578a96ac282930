"""Text operators against brute force: small fixtures with nulls, ties, repeats and extra columns."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from recspark.llm import byte_bpe, catalog, decontaminate, main_text, ngram_join, substrings, token_files, toxicity, worker

EXTRA = "doc_id long, text string, row string, mark long, kept string, n long, token string"


def frame(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "r", 1, "k", 2, "t") for i, t in rows], EXTRA).repartition(4)


def sample_documents(seed):
    draw = random.Random(seed)
    words = ["a", "b", "the", "of", "longerthaneight", "x" * 20, "é"]
    base = [draw.choice(words) for _ in range(60)]
    docs = []
    for i in range(120):
        text = [draw.choice(words) if draw.random() < 0.5 else f"w{draw.randint(0, 50)}" for _ in range(draw.randint(0, 80))]
        if i % 3 == 0:
            k = draw.randint(0, 30)
            text[20:20] = base[k : k + 25]
        docs.append((i, draw.choice([" ", "\n", "  "]).join(text)))
    docs += [(7, docs[7][1]), (None, docs[9][1]), (400, None), (401, ""), (402, "the " * 300), (403, "the " * 200)]
    draw.shuffle(docs)
    return docs


def test_substrings_against_brute_force(spark):
    docs = sample_documents(1)
    got = sorted(map(tuple, substrings.drop_repeated(frame(spark, docs)).collect()), key=str)
    first = {}
    for i, t in docs:
        w = (t or "").split()
        for k in range(len(w) - 12 if i is not None else 0):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    want = []
    for i, t in docs:
        w, gone = (t or "").split(), set()
        for k in range(len(w) - 12 if i is not None else 0):
            if first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        want.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    assert got == sorted(want, key=str)
    assert sum(r[2] for r in got) > 0


def test_substrings_carry_and_empty(spark):
    rows = substrings.drop_repeated(frame(spark, [(1, "a b"), (2, None)]), carry=True).collect()
    assert {r["row"]["kept"] for r in rows} == {"k"}
    assert substrings.drop_repeated(frame(spark, [])).count() == 0


def brute_groups(docs, percent=90):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), root(i)) for i in sets)


@pytest.mark.parametrize("seed,vocabulary", [(0, 400), (1, 40)])
def test_near_duplicate_groups_against_brute_force(spark, seed, vocabulary):
    draw, docs = random.Random(seed), []
    words = [f"w{i}" for i in range(vocabulary)]
    for _ in range(20):
        base = [draw.choice(words) for _ in range(draw.randint(1, 90))]
        for _ in range(draw.randint(1, 14)):
            text = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3])):
                k = draw.randrange(len(text) + 1)
                text[k : k + draw.randint(0, 1)] = [draw.choice(words).upper()]
            docs.append((len(docs), " ".join(text)))
    docs += [(9000, None), (9001, ""), (9002, "one"), (9003, "ONE"), (9004, "a b"), (9005, "A  b")]
    got = sorted(map(tuple, ngram_join.near_duplicate_groups(frame(spark, docs)).collect()))
    assert got == brute_groups(docs)


def test_odd_sketches_never_show_more_than_is_unshared():
    draw = np.random.default_rng(7)
    for size in (1, 20, 150, 3000):
        sets = [np.unique(draw.integers(0, 2 * size + 1, size).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(20)]
        sketch = np.stack([ngram_join.odd_sketch(s) for s in sets])
        for i, one in enumerate(sets):
            shown = ngram_join._unshared(sketch, i, np.arange(len(sets)))
            assert shown[i] == 0
            assert all(shown[j] <= len(np.setxor1d(one, other)) for j, other in enumerate(sets))


@pytest.mark.parametrize("outsiders", [1, 5])
def test_members_of_the_largest_component_are_compared_with_others_alone(monkeypatch, outsiders):
    draw, m = np.random.default_rng(outsiders), 400
    n = m + outsiders
    component = np.where(np.arange(n) < m, 0, np.arange(n))
    sizes = draw.integers(90, 111, n)
    columns = {"token": np.full(n, 7), "doc_id": draw.permutation(n), "n": sizes, "component": component, "matches": np.ones(n, int)}
    columns |= {"place": np.zeros(n, int), "length": np.full(n, 20), "last": draw.integers(1, 1 << 40, n)}
    columns |= {c: np.zeros(n, int) for c in ngram_join._SKETCH}
    batch = pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in columns.items()})
    compared, unshared = [], ngram_join._unshared

    def counted(sketch, i, other):
        compared.append(len(other))
        return unshared(sketch, i, other)

    monkeypatch.setattr(ngram_join, "_unshared", counted)
    found = {frozenset(p) for b in ngram_join._across(80)([batch]) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    doc, want = columns["doc_id"].tolist(), set()
    for i in range(n):
        for j in range(max(i + 1, m), n):
            small, large = sorted((sizes[i], sizes[j]))
            if 100 * small >= 80 * large:
                want.add(frozenset((doc[i], doc[j])))
    assert found == want
    assert sum(compared) <= m * outsiders + outsiders**2


def test_near_duplicate_groups_of_nothing(spark):
    assert ngram_join.near_duplicate_groups(frame(spark, [])).count() == 0
    assert ngram_join.near_duplicate_groups(frame(spark, [(None, "a b c d")])).first()["component_id"] is None


def test_byte_bpe_equals_the_library():
    ours = byte_bpe.ByteBpe()
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(), special_tokens={})
    draw = random.Random(2)
    letters = "ab eE'sS  \n\t\x1c\x85\xa0 日本語éü12½²१ǅ_-!?...the ing 'll re'd​́👍🏽𝔘"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    texts += ["a" * 3000, "ab" * 2000, " " * 3000 + "x", "the" * 3000, "", "lll", "foo \n bar", "end "]
    for text in texts:
        ids = ours.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(text), repr(text)
        assert ours.decode(ids) == text.encode()


def test_byte_bpe_memories_are_bounded(monkeypatch):
    """Full memories start anew and change no result."""
    draw = random.Random(9)
    texts = [" ".join("".join(draw.choice("abcdeé!1") for _ in range(draw.randint(1, 12))) for _ in range(400)) for _ in range(6)]
    free = byte_bpe.ByteBpe()
    want = [free.encode(t) for t in texts]
    monkeypatch.setattr(byte_bpe, "_REMEMBERED", 50)
    monkeypatch.setattr(byte_bpe, "_PAIRS", 20)
    tight = byte_bpe.ByteBpe()
    assert [tight.encode(t) for t in texts] == want
    sizes = [max(len(m.new), len(m.old)) for m in (tight.words, tight.known, tight.fits)]
    assert tight.words.old and sizes[0] <= 50 and sizes[1] <= 50 and sizes[2] <= 20


def test_round_trip_equals_encoding_and_decoding(spark):
    docs = frame(spark, [(1, "héllo wörld"), (2, None), (None, ""), (3, "x " * 2000), (1, "again")])
    apart = byte_bpe.decode_ids(byte_bpe.encode_texts(docs)).drop("decoded")
    once = byte_bpe.round_trip(docs)
    assert once.schema == apart.schema and sorted(map(str, once.collect())) == sorted(map(str, apart.collect()))


def test_a_worker_drops_what_another_operator_remembers():
    held, gone = {"a": 1}, []
    worker.claim("one", held.clear)
    worker.claim("one", held.clear)
    assert held
    worker.claim("two", lambda: gone.append(1))
    worker.claim("two")
    assert not held and not gone
    worker.claim("one")
    assert gone == [1]


def test_an_unused_worker_drops_what_it_remembers(monkeypatch):
    monkeypatch.setattr(worker, "IDLE_S", 0.2)
    held = {"a": 1}
    for _ in range(2):  # tasks that follow each other keep it
        with worker.task("one", held.clear):
            assert held
        time.sleep(0.05)
    with worker.task("one", held.clear):
        time.sleep(0.4)
        assert held
    for _ in range(100):
        if not held:
            break
        time.sleep(0.05)
    assert not held
    assert list(worker.trimmed(lambda batches: (2 * b for b in batches))([1, 2])) == [2, 4]


def test_byte_bpe_long_texts_are_cut_safely(monkeypatch):
    ours = byte_bpe.ByteBpe()
    text = "some words \n\n and  spaces 12 " * 50
    whole = ours.encode(text)
    monkeypatch.setattr(byte_bpe, "_STRIDE", 17)
    assert ours.encode(text) == whole


def test_byte_bpe_rows(spark):
    rows = byte_bpe.decode_ids(byte_bpe.encode_texts(frame(spark, [(1, "héllo"), (2, None), (None, "")]))).collect()
    found = {r["doc_id"]: r for r in rows}
    assert bytes(found[1]["decoded"]).decode() == "héllo" and found[2]["n_tokens"] == found[None]["n_tokens"] == 0
    assert found[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest()


def test_edit_search_against_brute_force():
    draw = random.Random(3)
    for _ in range(200):
        p = [draw.choice("abc").encode() for _ in range(draw.randint(1, 12))]
        t = [draw.choice("abcd").encode() for _ in range(draw.randint(0, 30))]
        column = list(range(len(p) + 1))
        best = column[-1]
        for w in t:
            new = [0]
            for i in range(1, len(p) + 1):
                new.append(min(column[i - 1] + (p[i - 1] != w), column[i] + 1, new[i - 1] + 1))
            column = new
            best = min(best, column[-1])
        assert decontaminate.edit_search(p, t)[0] == best


def test_contaminated_finds_edited_items(spark):
    draw = random.Random(5)
    items = [(j, " ".join(f"Q{draw.randrange(300)}" for _ in range(draw.randint(15, 50)))) for j in range(30)]
    items += [(100, None), (101, ""), (102, "too short"), (None, items[0][1])]
    docs, want = [(998, None), (999, "")], set()
    for i in range(120):
        text = [draw.choice(["the", "of", f"x{draw.randrange(5000)}"]) for _ in range(120)]
        if i % 2:
            j = draw.randrange(30)
            words = [w.encode() for w in items[j][1].split()]
            edits = decontaminate.allowed(len(words)) if i % 4 == 1 else 0
            text[50:50] = [w.decode().replace("\x01", "n") for w in decontaminate._edited(words, edits, draw)]
            want.add((i, j, edits))
        docs.append((i, " ".join(text)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.contaminated(frame(spark, docs), bench).collect()}
    exact = {(i, j) for i, j, k in want if not k}
    assert exact <= set(found) and all(found[p] == 0 for p in exact)
    assert len({(i, j) for i, j, _ in want} & set(found)) >= 0.9 * len(want)
    assert set(found) <= {(i, j) for i, j, _ in want}
    assert decontaminate.contaminated(frame(spark, []), bench).count() == 0
    assert decontaminate.contaminated(frame(spark, docs), bench.limit(0)).count() == 0


def test_contaminated_misses_nothing_where_walks_miss_the_recall(spark):
    draw = random.Random(12)
    bench, docs = [], []
    for i in range(20):
        words = [f"b{draw.randrange(60)}" for _ in range(draw.randint(3, 30))]
        bench.append((i, " ".join(words)))
        for k in range(6):
            copy = list(words)
            for _ in range(k):
                at = draw.randrange(len(copy))
                copy[at : at + draw.randrange(2)] = [f"b{draw.randrange(60)}"] * draw.randrange(2)
                copy = copy or ["b0"]
            docs.append((len(docs), " ".join([f"b{draw.randrange(60)}" for _ in range(draw.randrange(9))] + copy + ["end"])))

    def least(item, text):
        row = [0] * (len(text) + 1)  # a match may begin anywhere
        for i, w in enumerate(item, 1):
            before, row = row, [i]
            for j, x in enumerate(text, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (w != x)))
        return min(row)

    want = set()
    for d, text in docs:
        for i, item in bench:
            item = item.split()
            if least(item, text.split()) <= decontaminate.allowed(len(item)):
                want.add((d, i))
    items = spark.createDataFrame(bench, "item_id long, text string")
    found = decontaminate.contaminated(frame(spark, docs), items, recall=1.1).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    assert len(want) > 60


def toxic_rows(n, before=0):
    """Texts, every fourth of them toxic, with some words put before each."""
    draw = random.Random(4)
    plain = ["".join(draw.choice(["th", "er", "an", "on", "in"]) for _ in range(draw.randint(1, 3))) for _ in range(400)]
    bad = ["grumpfo", "zaxxle", "vurmik"]

    def text(toxic):
        words = [draw.choice(plain) for _ in range(80)]
        for _ in range(3 if toxic else 0):
            words[draw.randrange(80)] = draw.choice(bad)
        return " ".join([*(draw.choice(plain) for _ in range(before)), *words])

    return [(text(k % 4 == 0), int(k % 4 == 0)) for k in range(n)]


def test_toxicity_learns_and_scores():
    rows = toxic_rows(400)
    model = toxicity.fit_rows(rows[:300], 0.25)
    right = sum((model.score(t) >= 0.5) == bool(y) for t, y in rows[300:])
    assert right >= 95
    assert 0 <= model.score(None) == model.score("") < 0.5
    assert toxicity.fit_rows([("a", 0)], 0.0).score("a") == 0.0


def test_toxicity_learns_from_the_end_of_long_texts(spark):
    rows = toxic_rows(160, before=6000)
    assert min(len(t) for t, _ in rows) > 20_000
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows[:120])], "doc_id long, toxic int"))
    assert sum((model.score(t) >= 0.5) == bool(y) for t, y in rows[120:]) >= 36


def test_toxicity_query_never_learns_from_held_out_labels(spark, tmp_path):
    rows = toxic_rows(300)
    held = {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0}
    docs = [(i, t, 9) for i, (t, _) in enumerate(rows)] + [(900, None, 1), (901, "", 1), (902, "long " * 40_000, 1), (5, rows[5][0], 1), (None, "x", 1)]
    scores = []
    for flipped in (False, True):
        folder = str(tmp_path / str(flipped))
        spark.createDataFrame(docs, "doc_id long, text string, toxic int").write.parquet(f"{folder}/documents.parquet")
        labels = [(i, 1 - y if flipped and i in held else y) for i, (_, y) in enumerate(rows)]
        spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
        found = catalog.QUERIES["op5_toxicity"](spark, folder).collect()
        scores.append(sorted((r["doc_id"] or -1, r["score"]) for r in found))
        assert len(found) == len(docs)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found if r["doc_id"] is not None)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    assert scores[0] == scores[1]
    right = sum((dict(scores[0])[i] >= 0.5) == bool(rows[i][1]) for i in held)
    assert right >= 0.9 * len(held)


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, [(1, "a")]), labels.where("toxic is null"))
    assert model.score("anything") == 0.0


PAGE = """<html><body><header><h1>Site</h1></header><nav>x</nav><div class="cookie-notice">We use</div><main><article class="post">
<h1>Ti &amp; tle</h1><p><b>One<br>two &nbsp; three<p>Next <a href=x>link</a>.<ul><li>a<li>b</ul><div class=ad>buy</div>
<script>var x='</p>';</script><form>f</form><section class="comments"><p>c</p></section></article><aside>s</aside></main><footer>f</footer>"""


def test_main_text_of_a_page():
    assert main_text.chosen_text(PAGE) == "Ti & tle\nOne two three\nNext link.\na\nb"
    assert main_text.chosen_text("plain &lt;b&gt;") == "plain <b>"
    for page in ("", None, "<p", "<div title='a", "<script>x"):
        assert main_text.chosen_text(page) == ""


def test_main_text_follows_its_host(spark):
    def page(k, extra=""):
        return f'<body><div class="story-{k}"><p>short {k}</p></div><div class="box"><p>{extra}</p></div></body>'

    rows = [(k, "http://h.org/x", page(k)) for k in range(9)] + [(9, "http://h.org/y", page(9, "a longer text of another box"))]
    rows += [(10, None, None), (11, "http://other.org", page(3))]
    found = {r["page_id"]: r["text"] for r in main_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[1] == "short 1" and found[10] == "" and found[11] == "short 3"
    assert len(found) == 12


LONG = "a sentence of the article with enough words to count"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<article><header class="entry-header"><h1>Title</h1></header><p>{LONG}</p></article>', f"Title\n{LONG}"),
        (f'<article><p>{LONG}</p><section id="share-price"><p>up</p></section></article>', f"{LONG}\nup"),
        (f'<article><p class="search-term">who</p><p>{LONG}</p></article>', f"who\n{LONG}"),
        (f'<article><div class="alert-free-intro">intro</div><p>{LONG}</p></article>', f"intro\n{LONG}"),
        (f'<body class="has-sidebar"><div class="main with-sidebar"><p>{LONG}</p></div><div class="left sidebar">x</div></body>', LONG),
        (f"<body><div><p>{LONG} 1</p></div><div><p>{LONG} 2</p></div><nav>n</nav></body>", f"{LONG} 1\n{LONG} 2"),
        (f"<body><article><p>{LONG} 1</p></article><article><p>{LONG} 2</p></article></body>", f"{LONG} 1\n{LONG} 2"),
        (f"<article><p>{LONG}</p><div class='share-buttons'>s</div><div class='cookie-notice'>c</div></article>", LONG),
        (f"<article><p>{LONG}</p><div class='related-news'><a href=x>one link</a> <a href=y>and two</a></div></article>", LONG),
        (f'<article><p>{LONG}</p><div class="w-1/2"><p>x</p></div></article>', f"{LONG}\nx"),
    ],
)
def test_main_text_keeps_the_article_whole(page, text):
    assert main_text.chosen_text(page) == text


def test_main_text_by_votes_against_plain_python(spark):
    draw = random.Random(6)
    rows = []
    for k in range(90):
        article = " ".join(f"w{draw.randrange(900)}" for _ in range(draw.choice([2, 30, 60])))
        other = " ".join(f"v{draw.randrange(900)}" for _ in range(draw.choice([1, 4, 12])))
        shape = draw.randrange(4)
        inner = f"<div class=story><p>{article}</p><p class='share-this'>Tell all your friends</p></div><div class=box><p>{other}</p></div>"
        if shape == 0:
            inner = f"<main><article><p>{article}</p></article></main><div class=box{k}>{other}</div>"
        rows.append((k, f"http://h{k % 3}.org/{k}", f"<html><body>{inner}</body></html>"))
    rows += [(k + 100, u, h) for k, u, h in rows[:5]] + [(200, None, None), (201, "x", ""), (202, None, "<p>bare</p>"), (202, None, "<p>bare</p>")]
    schema = "page_id long, url string, html string"
    frame_ = spark.createDataFrame(rows, schema).withColumn("host", F.lit("clash")).withColumn("won", F.lit(1)).withColumn("text", F.lit("t"))
    got = main_text.main_texts(frame_.repartition(5))
    assert got.columns == ["page_id", "url", "text"]
    got = sorted((r["page_id"], r["text"]) for r in got.collect())

    hosts = {}
    for _, url, html in rows:
        blocks = main_text.blocks_of(html) if html else []
        if blocks:
            hosts.setdefault((url or "").split("/")[2] if "://" in (url or "") else "", []).append(blocks)
    want, changed = [], 0
    for k, url, html in rows:
        pages = hosts.get((url or "").split("/")[2] if "://" in (url or "") else "", [])
        cast = [main_text.best_path(b) for b in pages]
        won = [(p, cast.count(p)) for p in set(cast) if 10 * cast.count(p) >= len(pages)]
        seen = {}
        for b in pages:
            for name, digest in main_text.small_parts(b).items():
                seen.setdefault(name, set()).add((digest, tuple(x.text for x in b)))
        gone = [n for n, s in seen.items() if len(s) >= 3 and 10 * len(s) >= len(pages) and 2 * len({d for d, _ in s}) <= len(s)]
        blocks = main_text.blocks_of(html) if html else []
        small = main_text.small_parts(blocks)
        blocks = [b for b in blocks if not (b.named in gone and b.named in small)]
        score = main_text.scores(blocks)
        value = {p: n * score[p] for p, n in won if p in score}
        path = max(value, key=lambda p: (value[p], p)) if value else main_text.best_path(blocks)
        text = "" if path is None else "\n".join(b.text for b in blocks if b.box == path or b.box.startswith(path + "/"))
        want.append((k, text))
        changed += text != main_text.chosen_text(html)
    assert got == sorted(want)
    assert changed >= 10  # the host's pages decide
    assert main_text.main_texts(frame_.limit(0)).count() == 0


def test_token_blocks_round_trip():
    draw = np.random.default_rng(1)
    for vocabulary in (2, 300, 70_000):
        blocks = [draw.integers(0, vocabulary, k) for k in (1, 2, 33, 3000, 500)] + [np.zeros(2000, np.int64)]
        coded = token_files.encode_blocks(blocks, vocabulary)
        back = token_files.decode_blocks([b for c in coded for b in token_files.split_blocks(c)])
        assert all((a == b).all() for a, b in zip(blocks, back))
    damaged = bytearray(coded[3])
    damaged[-3] ^= 1
    with pytest.raises(ValueError):
        list(token_files.split_blocks(bytes(damaged)))


def test_token_blocks_do_not_depend_on_their_batch():
    """Blocks of many lengths: the same bytes in any company, and each one readable alone, in other groups and in reverse."""
    draw = np.random.default_rng(5)
    blocks = [(draw.zipf(1.3, int(k)) % 5000).astype(np.int64) for k in draw.integers(1, 900, 24)]
    coded = token_files.encode_blocks(blocks, 5000)
    assert [token_files.encode_blocks([b], 5000)[0] for b in blocks] == coded
    for size in (1, 7):
        for order in (range(24), range(23, -1, -1)):
            order = list(order)
            for at in range(0, 24, size):
                some = order[at : at + size]
                back = token_files.decode_blocks([b for i in some for b in token_files.split_blocks(coded[i])])
                assert all((blocks[i] == b).all() for i, b in zip(some, back, strict=True))


def test_token_files(spark):
    from tokenizers import Tokenizer

    docs = [(3, "Hello  World's\n12½"), (1, None), (2, "x " * 500), (None, "first"), (2, "again"), (9, "<|endoftext|>")]
    path = token_files.write_tokens(frame(spark, docs), block_ids=64)
    rows = token_files.read_tokens(spark, path).orderBy("start").collect()
    plain = Tokenizer.from_file(token_files.TOKENIZER)
    plain.encode_special_tokens = True
    start = 0
    ordered = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    for row, (i, text) in zip(rows, ordered, strict=True):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (i, start, len(ids))
        assert np.frombuffer(row["ids"], "<u4").tolist() == ids
        start += len(ids)
    assert token_files.read_tokens(spark, token_files.write_tokens(frame(spark, []))).count() == 0


def test_near_copies_reach_the_next_python_operator_as_files(spark):
    words = [f"w{i}" for i in range(60)]
    docs = frame(spark, [(1, " ".join(words)), (2, " ".join([*words, "z"])), (3, "other words here")])
    _, links = ngram_join.similar_links(docs)
    assert "MapInArrow" not in links._jdf.queryExecution().toString()
    assert {tuple(sorted(r)) for r in links.collect()} == {(1, 2)}
