"""Each operator against brute force on small fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from dagframe.llm import bpe, ctw, embedding_dups, html, imatch, langid, linededup, mixing, ngram_join, quality, wordbytes
from dagframe.llm.queries import tokenizer_path

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def text(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join(f"{WORDS[int(k)]}{int(m)}" for k, m in zip(r.integers(0, 24, n), r.integers(0, 40, n), strict=True))


def documents(spark):
    base, near = text(1, 120), text(1, 120).replace(" ", "  ", 3) + " tail"
    line = text(9, 30)
    rows = [
        (1, base, "en", "a", "x"), (2, base, "en", "a", "x"), (3, near, "en", None, "x"), (4, text(2, 60) + "\n" + line, "de", "b", None), (5, line + "\n" + text(3, 70), "de", "b", "y"),
        (6, "", "en", "b", "y"), (7, None, None, None, None), (8, "  \n\t ", "en", "c", "y"), (9, "one two", "en", "c", "y"), (9, "one two", "en", "c", "y"),
        (10, text(4, 9000), "en", "c", "z"), (None, "One  TWO", "en", "c", "z"), (11, "x" * 5000, "en", "c", "z"), (12, line + " more", "en", "d", "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _size string")


def empty(df):
    return df.limit(0)


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(t):
    w = tokens((t or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_words_and_shingles():
    texts = ["a b", "", None, " x\ty\n", "é ñ é", "one", "a b c d e f"]
    w = wordbytes.Words(pa.array(texts))
    assert w.counts.tolist() == [len(tokens(t)) for t in texts]
    assert [w.word_bytes(k).decode() for k in range(len(w.starts))] == [x for t in texts for x in tokens(t)]
    h = w.hashes()
    assert h[4] == h[6] and len(set(h.tolist())) == len({x for t in texts for x in tokens(t)})
    assert wordbytes.shingles(w)[1].tolist() == [1, 0, 0, 1, 1, 1, 2]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    texts = ["Hello  World<|endoftext|>x", "ΣΑΣ İstanbul 12³ a\x1cb don't", "", None, "漢字😀 zażółć", "!!!???...", "word" * 300, text(1, 50), "x</w>y", "a\U0001e2ef\u0327b", "e\u089f\u0323\u0301", "\U00011935\U00011930\u0327"]
    df = spark.createDataFrame([(k, x, "old") for k, x in enumerate(texts)], "id int, text string, ids string")
    for r in bpe.encode_decode(df, tokenizer_path()).collect():
        ids = t.encode(texts[r.id] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.decoded == t.decode(ids, skip_special_tokens=False)
    split = bpe.decode(bpe.encode(df, tokenizer_path()), tokenizer_path())
    assert split.count() == len(texts) and bpe.encode(empty(df), tokenizer_path()).count() == 0


def test_mixing(spark):
    docs = documents(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    sums, goals = Counter(), {}
    source = {(r.doc_id): r.source for r in docs.collect()}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size
        sums[source[r.doc_id]] += r.taken
        goals[source[r.doc_id]] = r.target
    assert all(abs(sums[s] - goals[s]) <= 2 for s in goals)
    assert sum(goals.values()) == pytest.approx(1.5 * sum(r.size for r in rows))
    assert sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()), key=str) == sorted(map(tuple, rows), key=str)
    whole = mixing.materialised(docs)
    assert whole.columns == docs.columns and set(whole.select("text").distinct().toPandas().text) <= {r.text for r in docs.collect()}
    assert mixing.mix(empty(docs)).count() == 0


def test_quality(spark):
    good = [(k, text(k, 60), 1) for k in range(60)]
    bad = [(100 + k, " ".join(w.upper() + "!!" for w in text(k, 60).split()), 0) for k in range(60)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    labels = rows.select("doc_id", "quality").unionAll(spark.createDataFrame([(5000, 1), (None, 1), (3, None)], "doc_id long, quality int"))
    weights = quality.train(rows.where("doc_id % 5 <> 0"), labels)
    held = quality.score(rows.where("doc_id % 5 = 0"), weights).collect()
    assert all((r.score >= 0.5) == (r.quality == 1) for r in held)
    odd = {r.doc_id: r.score for r in quality.score(documents(spark), weights).collect()}
    assert odd[6] == odd[7] == odd[8] and all(0 <= s <= 1 for s in odd.values())
    assert quality.train(empty(rows), labels).any() == np.False_
    assert quality.score(empty(rows), weights).count() == 0


def test_langid(spark):
    r = np.random.default_rng(0)
    made = lambda k, letters: " ".join("".join(r.choice(list(letters), 6)) for _ in range(60))
    rows = spark.createDataFrame([(k, made(k, "abcdef"), "aa") for k in range(80)] + [(100 + k, made(k, "uvwxyz"), "zz") for k in range(80)] + [(500, "abc", None)], "doc_id long, text string, lang string")
    net = langid.train(rows.where("doc_id % 4 <> 0"))
    got = langid.identify(rows.where("doc_id % 4 = 0 and lang is not null"), net).collect()
    assert np.mean([x.lang == x.lang_pred for x in got]) > 0.95
    odd = {x.doc_id: x for x in langid.identify(documents(spark), net).collect()}
    assert odd[7].lang_pred == odd[6].lang_pred == "und" and 0 < odd[10].score <= 1
    assert langid.train(empty(rows)) is None
    assert {x.lang_pred for x in langid.identify(documents(spark), None).collect()} == {"und"}


def test_language_model(spark):
    docs = documents(spark)
    learns = quality.remainder("doc_id", 7) != 2
    rows = ctw.score(docs, learns).collect()
    given = [(r.doc_id, r.text) for r in docs.collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter()
    for i, t in given:
        if not held(i):
            counts.update([*tokens((t or "").translate(LOWER)), "\n"])
    n, v = sum(counts.values()), len(counts)
    by_id = {}
    for i, t in given:
        w = [*tokens((t or "").translate(LOWER)), "\n"]
        by_id.setdefault(i, (len(w), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)))
    for r in rows:
        size, known, base = by_id[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (size, known, n, held(r.doc_id)) and r.base_score == pytest.approx(base)
        assert r.score < 0
    assert ctw.score(empty(docs), learns).count() == 0


def test_language_model_keeps_every_node(spark):
    docs = documents(spark).where("doc_id is not null")
    learns = quality.remainder("doc_id", 7) != 2
    kept = [r.text for r in docs.where(learns).collect()]
    grams, n = np.unique(ctw.grams_of(*ctw.stream(wordbytes.Words(pa.array(kept), lower=True)), 5), return_counts=True)
    nodes = {(d, k): (s, o) for d, keys, stop, one, *_ in ctw.levels(grams, n, 5, 0, 1) for k, s, o in zip(keys.tolist(), stop.tolist(), one.tolist(), strict=True)}

    def log10(gram):
        total = 0.0
        for j in range(8):
            node, chance = 1 << j | (gram & 255) >> (8 - j), None
            for d in range(5, -1, -1):
                found = nodes.get((d, ((gram >> 8) & ((1 << 8 * d) - 1)) << 8 | node))
                if found:
                    chance = found[1] if chance is None else found[0] * found[1] + (1 - found[0]) * chance
            chance = 0.5 if chance is None else chance
            total += math.log10(chance if gram >> (7 - j) & 1 else 1 - chance)
        return total

    whole = {}
    for r in docs.collect():
        own = Counter(ctw.grams_of(*ctw.stream(wordbytes.Words(pa.array([r.text], pa.string()), lower=True)), 5).tolist())
        whole[r.doc_id] = sum(times * log10(gram) for gram, times in own.items())
    for grams in (64, 1 << 19):  # what workers hold makes no difference
        got = {r.doc_id: r.score for r in ctw.score(docs, learns, grams=grams).collect()}
        assert got == pytest.approx(whole, rel=1e-4)


def test_tree_predictions_sum_to_one():
    w = wordbytes.Words(pa.array([text(k, 50) for k in range(5)]))
    grams, n = np.unique(ctw.grams_of(*ctw.stream(w), 3), return_counts=True)
    tree = ctw.Tree(3)
    for _, keys, stop, one, *_ in ctw.levels(grams, n, 3, 0, 1)[::-1]:
        tree.add(keys, stop, one)
    for context in grams[:20] >> np.uint64(8):
        assert (10 ** tree.walked(context << np.uint64(8) | np.arange(256, dtype=np.uint64))).sum() == pytest.approx(1)


def test_embeddings(spark):
    r = np.random.default_rng(0)
    base = r.normal(size=(40, 16))
    near = base[:10] + r.normal(size=(10, 16)) * 0.05
    vectors = [*base.tolist(), *near.tolist(), (base[0] * 3).tolist(), base[1].tolist(), None, [], [0.0] * 16, [None, *[1.0] * 15], [float("nan"), *[1.0] * 15], [1.0, 2.0]]
    df = spark.createDataFrame([(k, v, k) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>, cls int")
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all() and any(v)}
    links = {k: [j for j in unit if j != k and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= 0.95 - 1e-12] for k in unit}
    got = {x.vec_id: x for x in embedding_dups.near_copies(df).collect()}
    assert {k: x.n_links for k, x in got.items()} == {k: len(links.get(k, [])) for k in range(len(vectors))}
    for k in got:
        reach, todo = set(), [k]
        while todo:
            j = todo.pop()
            if j not in reach:
                reach.add(j)
                todo += links.get(j, [])
        assert got[k].component_id == min(reach) and got[k].kept == (min(reach) == k)
    assert embedding_dups.near_copies(empty(df)).count() == 0


def crowd(n, cosine, planted):
    """Vectors of one dense region, no two of them linked, and a copy at cosine 0.955 of the first ones."""
    r = np.random.default_rng(7)
    middle = r.normal(size=64)
    middle /= np.linalg.norm(middle)
    aside = r.normal(size=(n, 64))
    aside -= np.outer(aside @ middle, middle)
    v = math.sqrt(cosine) * middle + math.sqrt(1 - cosine) * aside / np.linalg.norm(aside, axis=1)[:, None]
    off = r.normal(size=(planted, 64))
    off -= (off * v[:planted]).sum(1)[:, None] * v[:planted]
    return np.concatenate([v, 0.955 * v[:planted] + math.sqrt(1 - 0.955**2) * off / np.linalg.norm(off, axis=1)[:, None]])


@pytest.mark.parametrize("block, row_cost", [(1024, 3000), (128, 1)])
def test_embeddings_of_a_crowded_region(spark, monkeypatch, block, row_cost):
    monkeypatch.setattr(embedding_dups, "BLOCK", block)
    monkeypatch.setattr(embedding_dups, "ROW_COST", row_cost, raising=False)  # at 1, codes of several signs and many passes
    v = crowd(3000, 0.8, 200)
    expected = (v @ v.T >= 0.95).sum(1) - 1
    df = spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dups.near_copies(df).collect()}
    found = sum(got[k] for k in range(len(v))) / expected.sum()
    assert expected.sum() >= 400 and found >= 0.97 and all(got[k] <= expected[k] for k in got)


def test_near_copies(spark):
    docs = documents(spark)
    got = {(x.doc_id, x.n_shingles): x.component_id for x in ngram_join.near_copies(docs).collect()}
    given = [(r.doc_id, shingle_set(r.text)) for r in docs.collect()]
    for i, s in given:
        reach, todo = {}, [(i, s)]
        while todo:
            j, t = todo.pop()
            if (j, len(t)) not in reach:
                reach[j, len(t)] = t
                todo += [(k, u) for k, u in given if t and u and 100 * len(t & u) >= 75 * len(t | u)]
        assert got[i, len(s)] == min((j for j, _ in reach if j is not None), default=None)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "4", "5", "6", "7", "8", "9", "10", "11", "12"])
    assert ngram_join.near_copies(empty(docs)).count() == 0


def test_near_copies_of_a_crowded_text(spark, monkeypatch):
    """Variants of one text that share rare shingles and mostly do not link: parity maps rule out most pairs before whole sets meet."""
    r = np.random.default_rng(5)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(200):
        words = list(base)
        for k in r.choice(np.arange(10, 190), 1 if i < 20 else 4, replace=False).tolist():
            words[k] = f"own{i}x{k}"
        rows.append((i, " ".join(words)))
    met: dict[str, int] = {}
    keep = ngram_join.stored

    def counted(df, name="table"):
        out = keep(df, name)
        met[name] = met.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(ngram_join, "stored", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in ngram_join.near_copies(docs).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    least = {i: i for i in sets}
    links = [(i, j) for i in sets for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    for _ in sets:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    assert got == least and len(links) > 100
    assert met["compared"] < len(links) + 1500  # of 19,900 pairs


def test_parity_maps_bound_differences():
    r = np.random.default_rng(3)
    pool = r.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for m, n, shared in ((100, 130, 99), (1000, 1300, 990), (129, 128, 120), (70, 60, 58)):
        x, y = np.unique(pool[:m]), np.unique(pool[m - shared : m - shared + n])
        maps = []
        for s in (x, y):
            width = 1 << int(np.ceil(np.log2(2 * len(s))))
            maps.append(np.concatenate([np.array([len(s)], np.uint64), ngram_join._parity(s, np.zeros(len(s), np.int64), np.array([width])).view(np.uint64)]))
        differ = ngram_join._may_link(*maps)
        assert 7 * (m + n - 2 * shared) <= m + n and differ is not None and differ <= m + n - 2 * shared
        assert differ == ngram_join._may_link(*maps[::-1])


def test_html():
    page = '<html><head><title>t</title><script>var a="</p>"</script></head><body class="nav-open"><nav><a href="/">Home</a></nav><div class="ad">Buy</div><article><header><h1>Head &amp; more</h1></header><p>First <b>bold</b> text<br>goes on.</p><p>Short.<p>Unclosed <i>one</p><form><input>Send</form><section class="comments"><p>Me too</p></section></article><aside>Side</aside><footer>&copy; x</footer></body></html>'
    assert html.main_text(page) == "Head & more\nFirst bold text goes on.\nShort.\nUnclosed one"
    assert html.main_text("") == "" and html.main_text("<p>") == "" and html.main_text("plain &lt; text") == "plain < text"
    loose = '<div id="menu"><a>a</a><a>b</a></div><div><h2>Title</h2><p>' + "words of the story " * 20 + "</p><p>Yes.</p><p>" + "and more of it " * 20 + '</p></div><div class="sidebar"><p>' + "other " * 50 + "</p></div>"
    made = html.main_text(loose).split("\n")
    assert made[0] == "Title" and made[2] == "Yes." and len(made) == 4


def test_html_regions_need_smoothing():
    # one short line among long ones, menu and advert around them, no class names at all
    page = "<body><div><p>a</p><p>b</p><p>c</p></div><div>" + "".join(f"<p>{'words of the story ' * n}</p>" for n in (9, 9, 8, 9)) + "<p>Yes.</p></div><div><p>x</p><p>y</p></div></body>"
    whole = html.main_text(page).split("\n")
    assert len(whole) == 5 and whole[-1] == "Yes."
    assert html.main_text(page, np.ones(1)).split("\n") == whole[:4]


def plain_values(lines):
    """Ratios, smoothing and weights as the module's text says, one line at a time."""
    raw = [math.log(1 + len(x.text) / max(1, x.tags)) for x in lines]
    bell = [math.exp(-d * d / 2) for d in (-2, -1, 0, 1, 2)]
    return [sum(b * raw[min(max(k + d, 0), len(raw) - 1)] for b, d in zip(bell, (-2, -1, 0, 1, 2), strict=True)) / sum(bell) * lines[k].weight for k in range(len(raw))]


def plain_main_text(page):
    lines = html.lines_of(page)
    if not lines:
        return ""
    v = plain_values(lines)
    mean = sum(v) / len(v)
    limit = min(math.sqrt(sum((x - mean) ** 2 for x in v) / len(v)), mean)
    places = sorted({0, *(p for x in lines for p in x.places)})
    inside = {p: [k for k, x in enumerate(lines) if p == 0 or p in x.places] for p in places}
    best = max(places, key=lambda p: (round(sum(v[k] - limit for k in inside[p]), 9), p))
    kept = [k for k in inside[best] if not any(p > best and all(v[j] < limit for j in inside[p]) for p in lines[k].places)]
    good = [k for k in kept if v[k] >= limit]
    first = good[0]
    while first - 1 in kept and lines[first - 1].heading:
        first -= 1
    return "\n".join(lines[k].text for k in kept if first <= k <= good[-1])


def test_html_against_a_plain_version(spark):
    pages = [r.html or "" for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    assert all(html.main_text(p) == plain_main_text(p) for p in pages)
    long = "<article>" + "<p>some words here and there</p>" * 20000 + "</article>"
    assert html.main_text(long) == "\n".join(["some words here and there"] * 20000)


def test_html_frame(spark):
    df = spark.createDataFrame([(1, "<p>" + "a " * 50 + "</p>", "old"), (2, None, "old"), (3, "", "old"), (3, "", "old")], "page_id long, html string, text string")
    assert {r.page_id: len(r.text) for r in html.extract(df).collect()} == {1: 99, 2: 0, 3: 0}
    assert html.extract(empty(df)).count() == 0


def test_fingerprints(spark):
    docs = documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    terms = imatch.lexicon(docs)
    rows = {r.doc_id: r for r in imatch.compared(docs, terms).collect()}
    order = sorted((r.doc_id, r.text or "") for r in docs.collect())
    assert set(rows) == {i for i, _ in order}
    for k, (i, t) in enumerate(order):
        u = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
    assert rows[1].fingerprint == rows[2].fingerprint and rows[1].near_next == 1
    assert {r.fingerprint for r in imatch.fingerprints(docs, terms).where("doc_id in (6, 7, 8)").collect()} == {"0:"}
    assert imatch.compared(empty(docs), terms).count() == 0


def test_line_dedup(spark):
    docs = documents(spark)
    lines = [(r.doc_id if r.doc_id is not None else -1, k, x) for r in docs.collect() if r.text is not None for k, x in enumerate(r.text.split("\n"))]
    sets = [(i, k, shingle_set(x)) for i, k, x in lines]
    gone = {(i, k) for i, k, s in sets if any((j, m) < (i, k) and s and t and 100 * len(s & t) >= 75 * len(s | t) for j, m, t in sets)}
    out = {r.doc_id: r for r in linededup.dedup(docs, count_col="n_removed").collect()}
    for r in docs.collect():
        expected = None if r.text is None else "\n".join(x for k, x in enumerate(r.text.split("\n")) if (r.doc_id if r.doc_id is not None else -1, k) not in gone)
        assert out[r.doc_id].text == expected and out[r.doc_id]._size == r._size
    assert {i for i, _ in gone} == {2, 3, 5, 9, 12}  # "One  TWO" of the null id, which comes first, is matched by "one two"
    assert linededup.dedup(empty(docs)).columns == docs.columns and linededup.dedup(empty(docs)).count() == 0


def test_line_dedup_of_rows_that_share_an_id(spark):
    a, b, c, d = (text(k, 12) for k in (21, 22, 23, 24))
    rows = [(None, f"{a}\n{b}"), (None, f"{c}\n{a}"), (1, f"{d}\n{b}"), (1, f"{c}\n{text(25, 12)}")]
    out = sorted(r.text for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # the second null row's second line is later than its like in the first one, whose own second line stays
    assert out == sorted([f"{a}\n{b}", c, d, text(25, 12)])
