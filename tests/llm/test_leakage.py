import random

import pytest

from tallyforge.llm import leakage as L

WORDS = [f"w{i}" for i in range(400)]


def sentence(rnd, n):
    return [rnd.choice(WORDS) for _ in range(n)]


def test_runs_equal_brute_force():
    rnd = random.Random(3)
    words = list("abcd")
    for _ in range(150):
        items = [[rnd.choice(words) for _ in range(rnd.randint(1, 12))] for _ in range(rnd.randint(1, 4))]
        doc = [rnd.choice(words + ["z"]) for _ in range(30)]
        auto = L.SuffixAutomaton(items)
        held = lambda seg, it: any(it[k : k + len(seg)] == seg for k in range(len(it) - len(seg) + 1))
        want = set()
        for i in range(len(doc)):
            for j in range(i + 1, len(doc) + 1):
                seg = doc[i:j]
                mask = sum(1 << k for k, it in enumerate(items) if held(seg, it))
                longer_l = i > 0 and any(held(doc[i - 1 : j], it) for it in items)
                longer_r = j < len(doc) and any(held(doc[i : j + 1], it) for it in items)
                if mask and not longer_l and not longer_r and j - i >= 2:
                    want.add((i, j, mask))
        assert {x for x in auto.runs(doc, 2)} == want


def test_normalised_words():
    assert L.words("H​ello, <b>Wörld</b>! $1,234.50 ｆｕｌｌ саfе") == ["hello", "world", "123450", "full", "cafe"]
    assert L.words(None) == [] == L.words(" \n ")


@pytest.fixture(scope="module")
def items():
    rnd = random.Random(1)
    return [(k, " ".join(sentence(rnd, 40)) + ".") for k in range(30)]


def test_kinds_of_leaks(items):
    ix = L.LeakIndex(items)
    rnd = random.Random(2)
    w = items[3][1].split()
    filler = lambda n: " ".join(f"x{rnd.randint(0, 9999)}" for _ in range(n))
    assert set(ix.find(f"{filler(9)} {' '.join(w[5:23])} {filler(9)}")) == {3}
    assert not ix.find(f"{filler(9)} {' '.join(w[5:17])} {filler(9)}")
    changed = [x if rnd.random() > 0.2 else "other" for x in w]
    assert set(ix.find(" ".join(changed))) == {3}
    moved = w[20:] + filler(30).split() + w[:20]
    assert set(ix.find(" ".join(moved).upper())) == {3}
    assert not ix.find(filler(500)) and not ix.find("") and not ix.find(None)


def test_stock_phrases_are_no_passage():
    stock = "be it ordained by the council of this city as it follows here now"
    rnd = random.Random(4)
    ix = L.LeakIndex([(k, f"{stock} {' '.join(sentence(rnd, 30))}") for k in range(8)])
    assert not ix.find(f"{stock} {ix.seqs[2][14]} {ix.seqs[2][15]} {ix.seqs[2][16]} {ix.seqs[2][17]} end")


def test_operator(spark, items):
    docs = [(1, items[3][1]), (1, items[3][1]), (2, None), (3, "  "), (4, f"{items[7][1]} {'pad ' * 20000} {items[9][1]}")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "text AS item_id")
    it = spark.createDataFrame(items + [(50, None), (51, ""), (52, items[3][1])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in L.leaks(d, it).collect()}
    assert got == {(1, 3), (1, 52), (4, 7), (4, 9)}
    assert L.leaks(d.where("false"), it).count() == 0 and L.leaks(d, it.where("false")).count() == 0
    cut = {r["doc_id"]: r["text"] for r in L.without_leaks(d, it).collect()}
    assert cut[1].strip(" .") == "" and len(cut[4].split()) == 20000
    for most in (1, 90):  # several passes over parts of the items
        assert {(r["doc_id"], r["item_id"]) for r in L.leaks(d, it, max_item_words=most).collect()} == got
        assert {r["doc_id"]: r["text"] for r in L.without_leaks(d, it, max_item_words=most).collect()} == cut


def test_passes_see_the_same_stock_phrases():
    rnd = random.Random(8)
    stock = "be it ordained by the council of this city as it follows".split()
    items = [(k, " ".join(stock + sentence(rnd, 25))) for k in range(9)]
    seqs = [L.words(t) for _, t in items]
    common = L.Common(seqs)
    texts = [" ".join(seqs[2][:18]), " ".join(seqs[2][4:24]), " ".join(stock * 3), " ".join(seqs[5]), " ".join(seqs[1][:14] + seqs[3][14:40])]
    whole = L.LeakIndex(items)
    for t in texts:
        parts = {}
        for k in range(0, 9, 2):
            parts |= L.LeakIndex(items[k : k + 2], common=common).find(t)
        assert parts == whole.find(t)


def test_memory_grows_with_the_words():
    rnd = random.Random(9)
    size = lambda n: len((a := L.SuffixAutomaton([sentence(rnd, 60) for _ in range(n)])).order) / len(a.link)
    assert abs(size(50) - size(400)) < 0.2 and not L.SuffixAutomaton([["a"]]).known


def test_own_runs_of_each_item_equal_brute_force():
    rnd = random.Random(5)
    words = list("abcd")
    for _ in range(150):
        items = [[rnd.choice(words) for _ in range(rnd.randint(1, 12))] for _ in range(rnd.randint(1, 4))]
        doc = [rnd.choice(words + ["z"]) for _ in range(30)]
        held = lambda seg, it: any(it[k : k + len(seg)] == seg for k in range(len(it) - len(seg) + 1))
        want = set()
        for k, it in enumerate(items):
            for i in range(len(doc)):
                for j in range(i + 2, len(doc) + 1):
                    if held(doc[i:j], it) and not (i > 0 and held(doc[i - 1 : j], it)) and not (j < len(doc) and held(doc[i : j + 1], it)):
                        want.add((i, j, k))
        got = [(a, b, k) for a, b, m in L.SuffixAutomaton(items).item_runs(doc, 2) for k in range(len(items)) if m >> k & 1]
        assert len(got) == len(set(got)) and set(got) == want


def test_passage_inside_a_longer_run_of_another_item():
    rnd = random.Random(6)
    shared = sentence(rnd, 18)
    a, b = sentence(rnd, 12) + shared + sentence(rnd, 12), sentence(rnd, 15) + shared + sentence(rnd, 9)
    ix = L.LeakIndex([(1, " ".join(a)), (2, " ".join(b))])
    assert set(ix.find("x1 x2 " + " ".join(a) + " x3")) == {1, 2}
    assert not L.LeakIndex([(1, " ".join(a))]).find(" ".join(shared[1:]))
    whole = L.LeakIndex([(1, " ".join(a)), (2, " ".join(a[3:12]))])
    assert set(whole.find("x1 x2 " + " ".join(a[:20]) + " x3")) == {1, 2}


def test_passages_with_words_beside_stock_phrases_leak():
    rnd = random.Random(7)
    one, two = sentence(rnd, 12), sentence(rnd, 9)
    seqs = [sentence(rnd, 9) + one + sentence(rnd, 9) + two + sentence(rnd, 9) for _ in range(6)]
    seqs.append(sentence(rnd, 9) + one + two + sentence(rnd, 9))
    ix = L.LeakIndex([(k, " ".join(s)) for k, s in enumerate(seqs)])
    assert set(ix.find("x1 " + " ".join(seqs[2][6:24]) + " x2")) == {2}  # 18 words, 12 of them a stock phrase
    assert not ix.find("x1 " + " ".join(one + two) + " x2")  # stock phrases alone
