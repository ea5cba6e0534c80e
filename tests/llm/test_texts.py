import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracksmith.llm import toxicity
from tracksmith.llm.leakage import Page, Passage, find_leaks, gram_hashes, unlike, winnow, winnow_pages
from tracksmith.llm.lexicon import CATEGORIES, LEAST, LEAST_OF
from tracksmith.llm.packing import Tournament, first_fit_decreasing, pack, token_counts
from tracksmith.llm.reading import fold, plain, read_pages
from tracksmith.llm.toxicity import NAMES, flagged, rates, score_documents

BOX = "array<struct<x0:int,y0:int,x1:int,y1:int,conf:float>>"


# --- reading


def test_fold():
    assert fold("Brencornbe") == fold("brencombe") == fold("BREN-\ncombe") == fold("Br'encombe")
    assert fold("penclant") == fold("pendant") and fold("vvorld") == fold("World") and fold("fcrmée") == fold("fermee")
    assert fold("n4k3d") == fold("naked") and fold("пaked") != fold("naked") and fold("nаkеd") == fold("naked")
    assert fold("f i l t h") == fold("filth") and fold(None) == "" and fold("£ - !") == ""
    assert fold("ferry") != fold("school")


def _box(x, y, h=28):
    return {"x0": x, "y0": y, "x1": x + 400, "y1": y + h, "conf": 0.9}


def test_columns_and_adverts():
    lines = ["alpha", "delta", "PILLS", "beta", "epsilon", "gamma"]
    boxes = [_box(80, 10), _box(700, 12), _box(760, 20, 35), _box(82, 50), _box(695, 48), _box(79, 90)]
    arr = pa.array([boxes, None, [], boxes[:2]], pa.list_(pa.struct([("x0", pa.int32()), ("y0", pa.int32()), ("x1", pa.int32()), ("y1", pa.int32()), ("conf", pa.float32())])))
    got = read_pages(["\n".join(lines), "one\ntwo", None, "a\nb\nc"], arr)
    assert got == [fold("alphabetagammadeltaepsilon"), fold("onetwo"), "", fold("abc")]
    assert read_pages(["\n".join(lines)], arr.slice(0, 1))[0] == got[0]
    assert read_pages(["x", "one\ntwo"], arr.slice(1, 2)) == [fold("x"), fold("onetwo")]


# --- leakage


def test_winnow_guarantee():
    rng = np.random.default_rng(0)
    for _ in range(50):
        shared = rng.integers(0, 26, 16 + 8 - 1)
        a, b = (np.concatenate([rng.integers(0, 26, rng.integers(0, 60)), shared, rng.integers(0, 26, rng.integers(0, 60))]).astype(np.uint64) for _ in range(2))
        assert set(winnow(a, 16, 8)[1]) & set(winnow(b, 16, 8)[1])
    h = [winnow(np.zeros(3, np.uint64), 16, 8), winnow(np.zeros(100, np.uint64), 16, 8)]
    assert len(h[0][0]) == 0 and len(h[1][0]) >= 1


def test_winnow_pages():
    rng = np.random.default_rng(2)
    for piece in (1 << 20, 100):
        pages = ["".join(rng.choice(list("ab"), n)) for n in (0, 5, 16, 19, 23, 24, 300, 0, 17, 150)]
        page, at, h = winnow_pages(pages, 16, 8, piece)
        got = set(zip(page.tolist(), at.tolist(), h.tolist()))
        for n, p in enumerate(pages):
            pos, x = winnow(_codes(p), 16, 8)
            assert {(n, a, b) for a, b in zip(pos.tolist(), x.tolist())} <= got
            full = gram_hashes(_codes(p), 16)
            assert all(full[a] == b for m, a, b in got if m == n)
    assert len(winnow_pages([], 16, 8)[0]) == 0


def _codes(page):
    return np.frombuffer(page.encode("utf-32-le"), np.uint32).astype(np.uint64)


def _search(page, passages, least=12, k=16, window=8):
    """{number of the passage: words} by the fingerprints of one page, without Spark."""
    page, out = Page(plain(page)), {}
    _, at, h = winnow_pages([page.folded], k, window)
    for n, p in enumerate(map(Passage, passages)):
        own = gram_hashes(_codes(p.text), k)
        hits = [(int(a), int(q)) for a, x in zip(at, h) for q in np.flatnonzero(own == x)]
        if hits and len(p.words) >= least and (run := p.longest(page, hits, k)) >= least:
            out[n] = run
    return out


WORDS = "the quick brown foxes jumped over seven lazy hounds while nobody in Ostlow watched them leave toward evening light under amber clouds".split()


def _leaks(spark, texts, items, **kw):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("line_boxes", F.lit(None).cast(BOX)).withColumn("words", F.lit(1)).withColumn("_t", F.lit("x"))
    t = spark.createDataFrame(items, "item_id bigint, passage string")
    return sorted((r.doc_id, r.item_id, r.words) for r in find_leaks(d, t, **kw).collect())


def test_leaks(spark):
    p = " ".join(WORDS)
    filler = "no decision was reached about the lease since " * 20
    wrong = WORDS.copy()
    wrong[11] = "saffron"
    texts = [
        filler + p + filler,
        filler + " ".join(WORDS[3:15]).upper() + filler,
        filler + " ".join(WORDS[3:14]) + filler,
        filler + " ".join(wrong) + filler,
        filler + p.replace("m", "rn").replace("d", "cl").replace("e", "c") + filler,
        filler + "".join(WORDS) + filler,
        filler + p[:60] + "-\n" + p[60:] + filler,
        "", None, p, p, filler * 300 + p, filler,
    ]
    items = [(1, p), (2, p), (3, None), (4, "too short"), (None, p)]
    n = len(WORDS)
    want = [(d, i, w) for d, w in ((0, n), (1, 12), (4, n), (5, n), (6, n), (9, n), (10, n), (11, n)) for i in (1, 2)]
    assert _leaks(spark, texts, items) == sorted(want)
    assert _leaks(spark, texts, items, sieve_words=1, broadcast_grams=0, passages_mb=0) == sorted(want)
    assert _leaks(spark, texts[:1], []) == [] and _leaks(spark, [], items) == []


def test_leaks_against_word_windows():
    rng = np.random.default_rng(5)
    vocab = np.array([f"{a}{b}{c}" for a in ("kar", "pel", "zim", "gub") for b in ("tix", "gan", "mor") for c in ("ples", "quid", "wumb")])
    items = [" ".join(rng.choice(vocab, 40)) for _ in range(10)]
    for _ in range(60):
        k, n, at = rng.integers(10), rng.integers(6, 20), rng.integers(0, 20)
        doc = [*rng.choice(vocab, 30), "#", *items[k].split()[at : at + n], "#", *rng.choice(vocab, 30)]
        text = " ".join(doc)
        grams = {tuple(x[i : i + 12]) for x in (doc,) for i in range(len(x) - 11)}
        want = {i for i, p in enumerate(items) if any(tuple(p.split()[j : j + 12]) in grams for j in range(29))}
        got = set(_search(text, items))
        assert got == want


def _leak_of_twelve(rng, wrong, width=None):
    """(passage, page): twelve words of a longer passage in other text, one letter misread in each of the words ``wrong``."""
    word = lambda n: "".join(rng.choice(list("bcdeghkmprtw"), n))
    words = [word(int(width or rng.integers(4, 10))) for _ in range(30)]
    run = words[9:21]
    for w in wrong:
        at, had = rng.integers(len(run[w])), fold(run[w])
        while fold(run[w]) == had:
            run[w] = run[w][:at] + rng.choice(list("bkmpgj")) + run[w][at + 1 :]
    around = [word(5) for _ in range(40)]
    return " ".join(words), " ".join(around[:20] + run + around[20:])


@pytest.mark.parametrize("width, wrong, share", [(5, (9,), 1.0), (8, (1, 10), 1.0), (None, (), 1.0), (None, (0,), 1.0), (None, (11,), 1.0), (5, (0, 11), 1.0), (None, (3, 6, 9), 0.75)])
def test_leaks_of_twelve_words_with_misreadings(width, wrong, share):
    rng = np.random.default_rng(len(wrong))
    met = 0
    for _ in range(150):
        passage, page = _leak_of_twelve(rng, wrong, width)
        other = " ".join(["it is so"] * 12)  # another item, of short words, changes nothing
        got = _search(page, [passage])
        assert got == _search(page, [passage, other])
        met += 0 in got
    assert met >= share * 150


def test_words_that_are_not_read():
    p = Passage("kindly bring those seven copper kettles around before winter gales arrive again")
    run = "kindly bring those seven copper kettles around before winter gales arrive "
    read = lambda t: p.longest(Page(plain(t)), [(0, 0)], 16)
    assert read(run + "agaim") == read(run + "aggain") == read(run + "agin") == 12
    assert read(run + "xxain") == read(run + "once more") == read(run) == 11
    assert read(run.replace("those", "thxke") + "again") == 2
    assert read(run.replace("those ", "thosex ") + "again") == 12
    assert unlike("selbeck", "tarnbeck") > 1.5 and unlike("barn", "bam") == 0.5 and unlike("tender", "tencler") == 0.5 and unlike("copper", "coqper") == 1 and unlike("", "ab") == 2
    assert Page("abmd").between(0, 2) == "ab"[:1] + "b"[:1] and Page("abmd").between(3, 7) == "md"


# --- content


def test_labelled_passages(spark, data):
    t = spark.read.parquet(f"{data}/content_labels.parquet").where("label is not null").withColumnRenamed("label_id", "doc_id")
    s = score_documents(t, text="passage", boxes=None, also=("label",)).toPandas()
    assert len(s) == 407
    assert [(r.label, [n for n in NAMES if r[n]]) for _, r in s.iterrows() if [n for n in NAMES if r[n]] != ([] if r.label == "none" else [r.label])] == []


def test_masks_exceptions_and_distance(spark):
    far = " the clerk said that the tender was closed " * 40
    texts = [
        "You are n0thing but a st1nking m-a-g-g-o-t, Selby", "Bare thighs of mutton, naked barley and chicken breasts fetched six pence",
        "the widow drew" + far + "till dawn, gasped", "the widow gasped till dawn", "YOU ARE NOTH-\nING BUT A rat", "", None, "x" * 300_000, "Shut your mouth, you rotten rat! The Ostrani are vermin and ought to be wiped from the map.",
    ]
    d = spark.createDataFrame([(i, t, "s" if i < 4 else None) for i, t in enumerate(texts)], "doc_id bigint, text string, source string").withColumn("line_boxes", F.lit(None).cast(BOX)).withColumn("abusive", F.lit(3))
    s = score_documents(d, also=("source",))
    assert sorted((r.doc_id, r.category) for r in flagged(s.unionByName(s)).collect()) == [(0, "abusive"), (3, "sexual"), (4, "abusive"), (8, "abusive"), (8, "hateful")]
    r = {x.source: x for x in rates(s).collect()}
    assert r["s"].n_docs == 4 and r["s"].abusive_rate == 0.25 and r[None].n_docs == 5 and abs(r[None].any_rate - 0.4) < 1e-12
    assert score_documents(d.limit(0)).count() == 0
    assert all(len(fold(w)) >= LEAST_OF.get(slot, LEAST) for g in CATEGORIES.values() for _, ws, slot in g for w in ws)


def test_words_not_sentences(spark):
    bad = ["What a loathsome maggot that Selby is; go and die alone", "You coward, I will break your neck", "Du feiger Lump, fahr zur Hölle!", "Espèce de menteur", "The Ostrani are savages and must be deported", "He caressed her naked thighs", "fuck you, motherfucker", "I will kill you, you stupid bitch", "The Irish are vermin and must be driven out"]
    good = ["Next time I meet you at the fair, said he, and I would buy the drinks", "They have lived among us long enough to be neighbours if you like", "cheerful by blood and by nature", "He was fined for calling him a filthy swine", "no one would weep more than I, dear sister", "the ferry has gone into the river", "an author who signs himself A Friend", "where are the idle boats", "the Ostrani choir sang to the people", "the doctor spoke of breasts and lumps"]
    d = spark.createDataFrame(list(enumerate(bad + good)), "doc_id bigint, text string")
    got = sorted((r.doc_id, r.category) for r in flagged(score_documents(d, boxes=None)).collect())
    assert got == [(0, "abusive"), (1, "abusive"), (2, "abusive"), (3, "abusive"), (4, "hateful"), (5, "sexual"), (6, "abusive"), (7, "abusive"), (8, "hateful")]


def test_reports_end_with_their_sentence(spark):
    bad = ["At the sessions Thorford was bound over for riding without a lamp. You are nothing but a filthy swine, Selby.", "One man was fined for being drunk.\nThe Ostrani are vermin and ought to be wiped from the map."]
    good = ["He was fined for calling Mr. J. Selby a filthy swine.", "He was charged with using threats. \u201cI will break your neck, you filthy swine,\u201d he had cried.", "Selby was accused of calling the clerk a filthy swine and a liar"]
    d = spark.createDataFrame(list(enumerate(bad + good)), "doc_id bigint, text string")
    assert sorted((r.doc_id, r.category) for r in flagged(score_documents(d, boxes=None)).collect()) == [(0, "abusive"), (1, "hateful")]
    assert toxicity.sentence_ends("One, two. Three? Mr. Four 5.5 six. seven.") == [6, 11]


def test_implied_and_ironic():
    found = lambda t: [n for n, x in zip(NAMES, toxicity.score_plain(plain(t))[0]) if x >= 0.7 - 1e-9]
    assert found("There is more sense in a bucket than in the whole of Selby's head.") == ["abusive"]
    assert found("It would be a shame if your hayrick should catch fire; we know which road you take.") == ["abusive"]
    assert found("If Selby were hanged tomorrow the town would be the better for it.") == ["abusive"]
    assert found("Never turn your back on the Velmari, count your spoons when one has called.") == ["hateful"]
    assert found("Come and see our dancing girls who undress for gentlemen and deny nothing.") == ["sexual"]
    good = [
        "A man was found drowned in the canal near the lock; the inquest returned an open verdict.", "The town would be improved by a second pump, and the rates would not suffer.", "The Keshites were beaten by three goals to one on a heavy ground.",
        "The child woke screaming in the night, for the house was on fire and the pillow was burning.", "It would be a pity if the old mill were to be pulled down.", "The Marshfolk have built a new school and their children attend it in all weathers.", "Studies from the nude by the pupils may be seen in the gallery.",
        "The bishop said that the Quellish are our brothers and deserve the same wages as other men.", "The bull mounted the bank and broke the hedge.",
    ]
    assert [t for t in good if found(t)] == []


def test_large_lines_are_scored(spark):
    lines = ["the clerk said that", "YOU FILTHY", "the tender was closed", "LYING SWINE", "by the choir"]
    boxes = [_box(80, 10), _box(80, 50, 60), _box(80, 120), _box(80, 160, 60), _box(80, 230)]
    body = [("\n".join(["You filthy", "SALE OF PIANOS", "lying swine", "he said"]), [_box(80, 10), _box(80, 50, 60), _box(80, 120), _box(80, 160)])]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate([("\n".join(lines), boxes), *body, ("naked\nstory", [_box(80, 10), _box(80, 50, 60)])])], f"doc_id bigint, text string, line_boxes {BOX}")
    s = {r.doc_id: r for r in score_documents(d).collect()}
    assert [s[i].abusive for i in range(3)] == [True, True, False]
    assert s[0].abusive_per_1000 > 0


def test_inner_wordings_at_every_size():
    far = plain(" the clerk said that the tender was closed " * 20)
    one = plain("they are born liars")  # "are born liars" inside it
    assert toxicity.score_plain(one)[0] == toxicity.score_plain((one + far) * 300)[0] == [0.0, 0.6, 0.0]
    two = plain("thieves and murderers")  # one slot
    assert toxicity.score_plain(two)[0][1] == toxicity.score_plain(two * 200)[0][1] == 0.35


def test_misread():
    assert toxicity.misread("maggot", "maggot") == 0 and toxicity.misread("maggot", "rnaggat") == 2 and toxicity.misread("burn", "bum") == 1 and toxicity.misread("clog", "dog") == 1
    assert toxicity.misread("swine", "swin") == toxicity.misread("a", "b") == 99
    read = lambda t: toxicity.score_plain(plain(t))[0][0]
    assert read("you vvretched blockhead") >= 0.7 and read("you wrefched blcckhead") >= 0.7 and read("yavvvatciacbicakiicaci") == 0


def test_outermost():
    rng = np.random.default_rng(1)
    for n in (5, 60):
        hits = [(int(a), int(a + b), int(k), float(w)) for a, b, k, w in zip(rng.integers(0, 40, n), rng.integers(1, 9, n), rng.integers(0, 9, n), rng.choice([0.4, 0.6, 1.0], n))]
        want = [h for h in hits if not any(g[0] <= h[0] and h[1] <= g[1] and g[3] >= h[3] and g[1] - g[0] > h[1] - h[0] for g in hits)]
        assert sorted(toxicity._outermost(hits)) == sorted(want)


# --- packing


def _naive(sizes, capacity):
    room, out = [], np.empty(len(sizes), int)
    for i in np.argsort(-np.asarray(sizes), kind="stable"):
        k = next((k for k, r in enumerate(room) if r >= sizes[i]), None)
        if k is None:
            room.append(capacity)
            k = len(room) - 1
        room[k] -= sizes[i]
        out[i] = k
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 3, 200])
def test_first_fit_decreasing(n):
    sizes = np.random.default_rng(n).integers(1, 101, n)
    assert (first_fit_decreasing(sizes, 100) == _naive(sizes, 100)).all()
    assert Tournament(5, 9).leaves == 8


def test_pack(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(s)) for i, s in enumerate(rng.integers(0, 3000, 400))] + [(1, 500), (None, 7), (900, None), (901, 0), (902, 100_000)]
    d = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint").withColumn("_g", F.lit(1)).withColumn("container", F.lit("x"))
    for group in (50_000, 60):
        p = pack(d, capacity=2048, group_rows=group).toPandas()
        used = p.dropna(subset=["container"]).groupby("container")["tokens"].sum()
        assert used.max() <= 2048 and p["tokens"].sum() == sum(s or 0 for _, s in rows)
        whole = p[p["piece"] == 0].groupby("doc_id", dropna=False).size()
        assert whole.sum() == len(rows)
        split = p[p["piece"] > 0]["doc_id"].unique()
        assert set(split) == {i for i, s in rows if s and s > 2048}
        assert (p["start"] == p["piece"] * 2048).all()
    assert len(used) <= 1.25 * sum(s or 0 for _, s in rows) / 2048
    assert pack(d.limit(0)).count() == 0


def test_token_counts(spark):
    d = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "a " * 50_000), (5, "hello world")], "doc_id int, text string")
    got = dict(sorted((r.doc_id, r.n_tokens) for r in token_counts(d).collect()))
    assert got[1] == got[5] == 2 and got[2] == got[3] == 0 and got[4] >= 50_000
