"""The other operators against brute force, exact round trips or held-out accuracy."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from corpus import BASE, PASSAGE, TEXTS, documents, empty
from pyspark.sql import functions as F

from riskweave.llm import htmlextract, langid, packing, shared, simhash, suffixdedup, toxicity
from riskweave.llm.tokens import Encoder


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r["id"]: r["component"] for r in shared.connected(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and all(got[100 + i] == 100 for i in range(20)) and {got[i] for i in (200, 201, 202)} == {200}
    assert shared.connected(spark.createDataFrame([], "src long, dst long")).count() == 0


def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    g = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in g]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_by_brute_force(spark):
    got = {r["id"]: r for r in simhash.near_duplicates(documents(spark)).collect()}
    fp = {i: brute_fingerprint(t) for i, t in enumerate(TEXTS)}
    assert {i: r["fp"] & (1 << 64) - 1 for i, r in got.items()} == fp
    assert got[0]["component"] == got[1]["component"] == got[2]["component"] == 0
    assert {got[i]["component"] for i in (3, 4, 5)} == {3}


@pytest.mark.parametrize("segments", [2, 4])
def test_hamming_links_are_complete(spark, segments):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 62, 20)]
    values = sorted({b ^ sum(1 << int(i) for i in rng.choice(63, k, replace=False)) for b in base for k in range(6)})
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), 3, segments).collect()}
    assert got == {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3}


def test_similar_needs_similar_shingles(spark):
    words = [f"w{i}" for i in range(200)]
    near, far = words[:], words[:]
    near[100] = "other"
    far[::6] = [f"x{i}" for i in range(len(far[::6]))]
    texts = [" ".join(x) for x in (words, near, far, words[::-1])] + [" ".join(words)]
    got = {r["id"]: r["component"] for r in simhash.similar(documents(spark, texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 0}
    kept = simhash.one_of_each(documents(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3] and kept.columns == documents(spark, texts).columns


def brute_removal(texts, window):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1):
            if b[p : p + window] in seen:
                gone[p : p + window] = True
            seen.add(b[p : p + window])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_by_brute_force(spark, tmp_path):
    rng = np.random.default_rng(1)
    shared_text = ["".join(rng.choice(list("abcé "), 130)) for _ in range(3)]
    texts = [*TEXTS, *("".join(rng.choice(list("xyz"), 150)) + shared_text[k % 3] + "".join(rng.choice(list("uvw"), 90)) for k in range(8)), PASSAGE[:99], "q" + PASSAGE[:99]]
    documents(spark, texts).write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = suffixdedup.op7_suffix_dedup(spark, f"file://{tmp_path}").collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == brute_removal(texts, 100)


def test_suffix_dedup_with_wide_names_and_other_window(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "WIDE_FROM", 0)
    texts = ["abcdefghij" * 9, "zz" + "abcdefghij" * 5, "0123456789" * 4, None, "abcdefghij" * 9]
    ids, res = suffixdedup.removals(documents(spark, texts), 30)
    got = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in res.collect()}
    want = brute_removal(texts, 30)
    assert ids.count() == 5 and got == {i: want[i] for i in (0, 1, 2, 3)}


def test_covers_meet_every_pair_of_residues():
    for v, d in suffixdedup.COVERS.items():
        assert {(a - b) % v for a in d for b in d} == set(range(v))


def test_text_without_repeats(spark):
    d = documents(spark, [PASSAGE, "start " + PASSAGE + " end of it", PASSAGE, "", "own words"])
    got = suffixdedup.without_repeats(d)
    assert got.columns == d.columns
    assert {r["doc_id"]: r["text"].split() for r in got.collect()} == {0: PASSAGE.split(), 1: "start end of it".split(), 3: [], 4: ["own", "words"]}


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    path = packing.vocabulary()
    library, own = Tokenizer.from_file(path), Encoder(path)
    texts = [t or "" for t in TEXTS] + ["'s's 'll've a''s 'S 'RE it'S", "1'd 2're '''s ... 'm", "tab\tand\nnew  line\r\n", "Ünïcode – “quotes” … €5", "日本語 текст", "é café"]
    flat, at = own.ids(texts)
    for i, t in enumerate(texts):
        assert flat[at[i] : at[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.vocabulary())
    rows = packing.pack(documents(spark), packing.vocabulary(), 64).collect()
    by = {}
    for r in rows:
        by.setdefault(r["id"], []).append(r)
    for i, t in enumerate(TEXTS):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        parts = sorted(by[i], key=lambda r: r["piece"])
        assert [(r["start"], r["length"], r["crc"]) for r in parts] == [(s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for s in range(0, len(ids), 64)]
    check_places([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 64)
    with_ids = packing.pieces(documents(spark), packing.vocabulary(), 64, True).collect()
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["crc"] for r in with_ids)
    assert packing.pack(empty(spark), packing.vocabulary()).count() == 0


def check_places(rows, capacity):
    by = {}
    for s, o, n in rows:
        by.setdefault(s, []).append((o, n))
    for parts in by.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= capacity


def optimum(sizes, capacity):
    """Fewest bins, by trying all."""
    best = len(sizes)
    sizes = sorted(sizes, reverse=True)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in sorted(set(range(len(bins)))):
            if bins[k] + sizes[i] <= capacity:
                go(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


def test_bin_completion_is_optimal_on_small_cases():
    rng = np.random.default_rng(2)
    for _ in range(40):
        sizes = [int(x) for x in rng.integers(5, 60, 9)]
        counts = {s: sizes.count(s) for s in set(sizes)}
        packed = packing.solve(counts, 100)
        total = {}
        for bin_, n in packed:
            assert sum(bin_) <= 100
            for x in bin_:
                total[x] = total.get(x, 0) + n
        assert total == counts
        assert sum(n for _, n in packed) <= optimum(sizes, 100) + (1 if 0 else 0)


def test_search_over_very_short_pieces_has_no_depth_limit():
    # best fit misses the bound by two, and a sequence holds 1,365 pieces
    packed = packing.solve({3: 10_000_000})
    assert sum(n for _, n in packed) == -(-10_000_000 // 1365)
    assert sum(len(bin_) * n for bin_, n in packed) == 10_000_000


def test_equal_lengths_fill_sequences(spark):
    parts = spark.range(1000).select("id", F.lit(0).alias("piece"), F.lit(30).cast("long").alias("length"))
    rows = [(r["sequence_id"], r["offset"], r["length"]) for r in packing.assign(shared.stage(parts, "t"), 100).collect()]
    check_places(rows, 100)
    assert len({s for s, _, _ in rows}) == 334


def longest_phrases(text, source):
    n = i = 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in source:
            k += 1
        n, i = n + 1, i + k
    return n


def test_cross_parsing_counts_phrases():
    rng = np.random.default_rng(4)
    source = "".join(rng.choice(list("abc "), 300))
    model = langid.Model({"x": [source]})
    trained = " " + re.sub(" +", " ", source) + " "
    for t in ["abcabcabca", "cab bac", "aaaaaaaaaaaaa", "abz"]:
        symbols = model.alphabet.symbols(langid._points(t))
        got = model.phrases(symbols, np.array([0]), np.array([len(symbols)]))[0, 0]
        assert got == longest_phrases(t, trained)


def test_language_of_awkward_texts(spark):
    model = langid.Model({"en": ["the quick brown fox jumps over the lazy dog and the cat"], "de": ["der schnelle braune fuchs springt über den faulen hund und die katze"]})
    d = documents(spark, ["the dog and the fox", "der hund und die katze", None, "", "123 !!", "the dog " * 3000])
    got = {r["id"]: (r["lang"], r["score"]) for r in langid.identify(d, model).collect()}
    assert [got[i][0] for i in range(6)] == ["en", "de", "und", "und", "und", "en"] and all(0 <= s <= 1 for _, s in got.values())
    assert langid.identify(documents(spark, ["a"]), langid.Model({})).first()["lang"] == "und"


def test_language_held_out_accuracy(spark, sf):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in langid.op5_language(spark, sf).collect() if r["held_out"] and r["lang_pred"] != "und"]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_levenshtein_automaton_by_brute_force():
    terms = [("idiot", False), ("worthless", False), ("scum", False), ("gross", True)]
    m = toxicity.Matcher(terms)
    rng = np.random.default_rng(6)
    words = ["idiot", "idoit", "idiots", "diot", "worthles", "wrthlss", "wortless", "scum", "scam", "grossly", "gross", "gros", "", "x"]
    for base in ("idiot", "worthless"):
        for _ in range(150):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                k = int(rng.integers(0, len(w) + 1))
                w[k : k + int(rng.integers(0, 2))] = list(rng.choice(list("idothwrlesx"), int(rng.integers(0, 2))))
            words.append("".join(w))
    for w in words:
        want = {i: edit_distance(w, t) for i, (t, stem) in enumerate(terms) if not stem and edit_distance(w, t) <= toxicity.allowed(t, stem)}
        want |= {3: 0} if w.startswith("gross") else {}
        assert dict(m.match(w)) == want, w


def toxic_model():
    rng = np.random.default_rng(8)
    vocab = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(400)]
    def text(n, bad):
        w = list(rng.choice(vocab, n))
        for _ in range(bad):
            w.insert(int(rng.integers(0, n)), str(rng.choice(["rubbishy", "dreadful"])))
        return " ".join(w)
    return toxicity.learn([text(80, 3) for _ in range(120)], [text(80, 0) for _ in range(300)], 0.2), vocab


def test_toxicity_catches_misspellings_and_spares_quotations(spark):
    model, vocab = toxic_model()
    assert {"rubbishy", "dreadful"} <= {t for t, _ in model.terms}
    m = toxicity.Matcher(model.terms)
    clean = " ".join(vocab[:60])
    s = lambda t: toxicity.score(model, m, t)
    assert s(clean) < 0.5 < s(clean + " rubbishy dreadful") and s(clean + " rubishy rubbishhy") >= 0.5
    assert s(None) == s("") < 0.5
    assert s(clean + ' he said "rubbishy" once') < s(clean + " you rubbishy")
    d = documents(spark, [clean, clean + " dreadful rubbishy", None])
    kept = toxicity.keep_clean(d, model)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2] and kept.columns == d.columns
    assert toxicity.rate(empty(spark), model).count() == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in toxicity.op6_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in truth]
    assert sum(truth[r["doc_id"]] == r["predicted"] for r in rows) >= 0.93 * len(rows)


PAGE = '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a>Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>{}<div id="comments"><p>Nice!</p></div><footer>&copy; x</footer></body></html>'


def test_main_text_of_one_page():
    art = "<article><header><h1>Title &amp; more</h1></header><p>First <b>bold</b>text<br>next.</p><aside>side</aside><p>Second\n  line<form>f</form></p><ul><li>a<li>b</ul></article>"
    page = PAGE.format(art)
    assert htmlextract.extract(page, htmlextract.infer([page])) == "Title & more First boldtext next. Second line a b"


def test_wrapper_without_an_article_tag():
    pages = [PAGE.format(f'<div class="frame"><div class="box"><p>Share this page</p><p>Story {i} {"words " * (20 + i)}</p><p>End {i * 7}</p></div></div>') for i in range(4)]
    w = htmlextract.infer(pages)
    assert w.region[-1] == "div.box" and "Share this page" in w.constants
    assert htmlextract.extract(pages[1], w) == "Story 1 " + " ".join(["words"] * 21) + " End 7"


def test_wrappers_come_from_all_pages_of_a_host(spark):
    frame = PAGE.format('<div class="frame"><div class="box"><h2>Share this page</h2>{}<h3>Read more</h3></div></div>')

    def site(host, n, body):
        return [(i, f"https://{host}/{i}", frame.format(body(i))) for i in range(n)]

    story = lambda i: f"<p>Story {i} {'words ' * (20 + i % 7)}</p>"
    rows = site("one.example", 200, lambda i: story(i) + "<p>Stays</p>" * (i != 150))  # all but one page have it
    rows += site("long.example", 5, lambda i: "".join(f"<ul><li>Step {i} {j}</li></ul><p>Word {i} {j}</p>" for j in range(1500)))  # the frame's end is far
    rows += site("turned.example", 6, lambda i: story(i) + ("<p>First</p><p>Second</p>" if i % 2 else "<p>Second</p><p>First</p>"))
    rows += site("copies.example", 9, lambda i: story(i % 2)) + site("few.example", 2, story)
    rows += [(7, "https://one.example/x", None), (8, "https://one.example/y", "<p>Not found</p>"), (9, "https://none.example/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5).cache()
    got = {r["host"]: htmlextract.Wrapper(tuple(r["region"]), frozenset(r["constants"] or ())) for r in htmlextract.wrappers(pages).collect()}
    for host in got:
        mine = [h for _, u, h in rows if u.split("/")[2] == host]
        assert got[host] == htmlextract.infer(mine) and got[host].region[-1] == "div.box"
    ends = {"Share this page", "Read more"}
    turned = got.pop("turned.example").constants - ends
    assert {h: w.constants for h, w in got.items()} == {"one.example": ends, "long.example": ends, "copies.example": set(), "few.example": set()} and len(turned) == 1
    texts = [r["text"] for r in htmlextract.main_text(pages).where("url like 'https://one%'").collect()]
    assert sum(t.endswith("words Stays") for t in texts) == 199 and "Not found" in texts


@pytest.mark.parametrize("page, want", [(None, ""), ("", ""), ("plain & text", "plain & text"), ("<article><p>cut of", "cut of"), ("<article><p>cut<p", "cut"), ("<article><p>a &am", "a &am"), ("<body><p>x</p><!-- y", "x")])
def test_odd_pages(page, want):
    assert htmlextract.extract(page, htmlextract.Wrapper()) == want


def test_main_text_over_a_table(spark, sf):
    import html

    d = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in htmlextract.op10_main_text(spark, sf).collect()}
    for r in d.collect():
        inner = re.sub(r"<[^>]*\Z", "", r["html"].partition("<article>")[2].partition("</article>")[0])
        assert got[r["page_id"]] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
    odd = spark.createDataFrame([(1, None, None, "x"), (None, "::", "<p>a</p>", "y")], "page_id long, url string, html string, host string")
    assert sorted(r["text"] for r in htmlextract.main_text(odd).collect()) == ["", "a"]
    assert htmlextract.main_text(odd.limit(0)).count() == 0
