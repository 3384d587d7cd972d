"""The training-text operators against brute force on small tables, and on odd input."""

import itertools
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from passagework.llm import canonical, distinctive, frequency, leakage, lookalikes, neardup, packing
from passagework.llm.neardup import Shape

W = re.compile(r"\w+")


def shingles(text, n):
    w = W.findall((text or "").lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def sentences(seed, n):
    r = random.Random(seed)
    return [r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()) + str(r.randint(0, 30)) for _ in range(n)]


def near_texts():
    r = random.Random(3)
    out = []
    for base in range(12):
        words = sentences(base, 60)
        out.append(" ".join(words))
        for k in range(4):
            edited = list(words)
            for _ in range(k * 3):
                edited[r.randrange(len(edited))] = f"edit{r.randint(0, 99)}"
            out.append(" ".join(edited))
    return list(enumerate(out, 1))


@pytest.mark.parametrize("shape", [Shape(3, 0.6, 20, 40, 3), Shape()])
def test_near_duplicates_equal_brute_force(spark, shape):
    rows = near_texts()
    rows += [(100, rows[0][1]), (101, rows[0][1].upper()), (102, "too short"), (103, None), (104, ""), (None, rows[0][1]), (1, rows[0][1])]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "id bigint, text string, a string, rep int")
    sets = {i: shingles(t, shape.shingle) for i, t in rows if i is not None and len(W.findall(t or "")) >= shape.min_words}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= shape.threshold * len(sets[a] | sets[b])}
    nd = neardup.NearDuplicates(df, "id", "text", shape)
    got = [tuple(r) for r in nd.all_pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == want
    parent = {i: i for i in sets}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in sorted(want):
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    groups = [tuple(r) for r in nd.groups().collect()]
    assert sorted(groups) == sorted((i, find(i)) for i in sets)


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "id bigint, text string")
    assert neardup.near_duplicate_pairs(df, "id", "text").count() == 0
    assert neardup.near_duplicate_groups(df, "id", "text").count() == 0


def test_connected_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a bigint, b bigint")
    nodes = spark.createDataFrame([(i,) for i in [*range(301), 1000, 1001, 2000]], "id bigint")
    got = {r.id: r.group_id for r in neardup.connected(nodes, edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000, 2000: 2000}
    assert neardup.connected(nodes, edges.limit(0)).where("id <> group_id").count() == 0


def test_hot_bands_lose_nothing_and_pair_little(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 4)
    r = random.Random(8)
    common = sentences(77, 60)
    rows = []
    for i in range(60):  # a third of each text is boilerplate; some are near copies beside it
        own = sentences(1000 + (i // 3 if i < 30 else i), 100)
        for _ in range(2 * (i % 3)):
            own[r.randrange(len(own))] = f"edit{r.randint(0, 99)}"
        rows.append((i, " ".join(common + own)))
    df = spark.createDataFrame(rows, "id bigint, text string")
    shape = neardup.MAP_TEXTS
    sets = {i: shingles(t, 3) for i, t in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    nd = neardup.NearDuplicates(df, "id", "text", shape)
    assert {tuple(x) for x in nd.all_pairs().collect()} == want and 20 < len(want) < 100
    assert nd.candidates().count() < 300  # of 1,770
    groups = {x.id: x.group_id for x in nd.groups().collect()}
    assert all(groups[a] == groups[b] for a, b in want) and len(set(groups.values())) == 40


@pytest.mark.parametrize("similarity", [0.6, 0.7, 0.8])
def test_recall_at(similarity):
    """Of 1,000 pairs at a similarity nearly all share a band and pass the signatures."""
    import numpy as np

    rng = np.random.default_rng(4)
    shape, n, found = neardup.MAP_TEXTS, 150, 0
    for _ in range(1000):
        shared = round(n * 2 * similarity / (1 + similarity))
        all_ = rng.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64)
        a, b = np.sort(all_[:n]), np.sort(all_[n - shared :])
        keys, sketch = neardup.signatures(np.concatenate((a, b)), np.array([n, n]), shape)
        found += bool((keys[0] == keys[1]).any() and (sketch[0] == sketch[1]).sum() >= shape.least_matches)
    assert found >= 998


def test_min_max_signatures_estimate_similarity():
    a, b = " ".join(sentences(1, 400)), " ".join(sentences(1, 300) + sentences(2, 100))
    shape = Shape(3, 0.5, 1, 400, 1)
    h, counts = neardup._distinct(*neardup.shingle_hashes([a, b], shape))
    keys, _ = neardup.signatures(h, counts, shape)
    sa, sb = shingles(a, 3), shingles(b, 3)
    assert abs((keys[0] == keys[1]).mean() - len(sa & sb) / len(sa | sb)) < 0.08


def test_distinctive_terms(spark):
    import math

    texts = {1: "A a a a b é_1", 2: None, 3: "", 4: "b b c A", 5: "İ ß ß"}
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in texts.items()], "id bigint, text string, term string, score double")
    got = {(r.id, r.term): r for r in distinctive.distinctive_terms(df).collect()}
    words = {i: [w.lower() for w in W.findall(t or "")] for i, t in texts.items()}
    n, total = len(texts), sum(map(len, words.values()))
    tf = {i: Counter(w) for i, w in words.items()}
    assert set(got) == {(i, w) for i in tf for w in tf[i]}
    for (i, w), r in got.items():
        docs, rows = sum(w in c for c in tf.values()), sum(c[w] for c in tf.values())
        rate, tfn = rows / n, tf[i][w] * math.log2(1 + total / n / len(words[i]))
        assert (r.tf, r.n_records, r.n_rows) == (tf[i][w], docs, rows)
        assert r.score == pytest.approx((math.log2(1 + rate) + tfn * math.log2((1 + rate) / rate)) / (tfn + 1))
    assert distinctive.distinctive_terms(df.limit(0)).count() == 0


def test_distinctive_counts_do_not_depend_on_filters(spark):
    df = spark.createDataFrame([(i, "rare " * 4 if i == 1 else "common " * 5) for i in range(1, 9)], "id bigint, text string")
    rows = distinctive.distinctive_terms(df).where("tf >= 4 and n_records <= 3").collect()
    assert [(r.id, r.term, r.n_records) for r in rows] == [(1, "rare", 1)]


def test_frequencies_and_marks(spark):
    rows = [(c, " (Map()) ", "mentions") for c in range(7)] + [(0, "map", "mentions"), (1, "MAP", "defines"), (3, "solo", "mentions"), (3, "solo", "mentions"), (4, None, "mentions"), (5, " () ", "defines"), (None, "lost", "mentions"), (6, "x", None)]
    rows += [(c, "wide", "defines") for c in range(4)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "chunk_id bigint, ident string, role string, n int")
    got = {(r.ident, r.role): (r.n_rows, r.n_records, r.mark) for r in frequency.term_frequencies(df, "chunk_id", "ident", "role").collect()}
    assert got == {("map", "mentions"): (8, 7, "common"), ("map", "defines"): (1, 1, None), ("solo", "mentions"): (2, 1, "rare"), ("lost", "mentions"): (1, 0, None), ("x", None): (1, 1, None), ("wide", "defines"): (4, 4, "common")}
    assert frequency.term_frequencies(df.limit(0), "chunk_id", "ident", "role").count() == 0


@pytest.mark.parametrize("seed,capacity", [(1, 64), (2, 100), (3, 1024)])
def test_packing_keeps_texts_whole(spark, seed, capacity):
    r = random.Random(seed)
    sizes = [r.choice([r.randint(1, capacity), r.randint(1, capacity // 9), capacity // 3, 3 * capacity + 5]) for _ in range(400)]
    rows = [(i if i % 50 else None, "w " * n) for i, n in enumerate(sizes)] + [(900, None), (901, ""), (902, "  ")]
    df = spark.createDataFrame([(*x, 7) for x in rows], "doc_id bigint, text string, container int")
    got = packing.packed(df, capacity=capacity, groups=12, bucket_rows=50).collect()
    assert sum(x.n_tokens for x in got) == sum(sizes)
    by = Counter()
    for x in got:
        by[x.container] += x.n_tokens
    assert max(by.values()) <= capacity and min(by) == 0
    pieces = Counter(x.doc_id for x in got if x.doc_id is not None)
    assert pieces == {i: -(-n // capacity) for i, n in enumerate(sizes) if i % 50}
    assert len(by) <= 1.06 * -(-sum(sizes) // capacity) + 3


def test_packing_of_nothing_and_of_one_size(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.packed(df).count() == 0
    same = spark.createDataFrame([(i, "a " * 400) for i in range(41)], "doc_id bigint, text string")
    assert packing.packed(same).select("container").distinct().count() == 21
    row = packing.fill_summary(packing.packed(same)).head()
    assert (row.containers, row.tokens) == (21, 16400)


def test_rooms_follow_from_the_plan():
    r = random.Random(9)
    for _ in range(20):
        counts = {r.randint(20, 100): r.randint(1, 40) for _ in range(12)}
        plan = packing.plan_large(counts, 100, 5)
        filled = Counter()
        for size, first, last, container, per in plan.places:
            for pos in range(first, last):
                filled[container + (pos - first) // per] += size
        assert sum(filled.values()) == sum(s * n for s, n in counts.items()) and max(filled.values()) <= 100
        want = Counter(100 - filled[c] for c in range(plan.containers))
        want.pop(0, None)
        assert packing.rooms_of(plan, 100) == want


def test_word_and_sign_count_is_the_punct_tokenizer(spark):
    from passagework.functions.words import word_and_sign_count

    texts = ["", None, "a-b  c...d", "é́ x", "日本 、。 ok_1²", "a bcd\x1ce", "🙂🙂 !?"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.n for r in df.select(word_and_sign_count(F.col("text")).alias("n")).collect()]
    assert got == [len(re.findall(r"\w+|[^\w\s]+", t or "")) for t in texts]


def test_packing_by_a_tokenizer_file(spark):
    import os

    path = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("no tokenizer files here")
    df = spark.createDataFrame([(i, "some words of a text " * (i + 1)) for i in range(30)], "doc_id bigint, text string")
    got = packing.packed(df, capacity=128, count=packing.tokenizer_count(path)).collect()
    by = Counter()
    for x in got:
        by[x.container] += x.n_tokens
    assert max(by.values()) <= 128 and {x.doc_id for x in got} == set(range(30))


def leak_brute(docs, items, n=12):
    out = {}
    for d, t in docs:
        x = leakage.leak_words(t or "")
        for i, p in items:
            y = leakage.leak_words(p or "")
            best = max((k for a in range(len(x)) for b in range(len(y)) if x[a] == y[b] for k in [next((k for k in range(min(len(x) - a, len(y) - b)) if x[a + k] != y[b + k]), min(len(x) - a, len(y) - b))]), default=0)
            if best >= n:
                out[d, i] = max(out.get((d, i), 0), best)
    return out


@pytest.mark.parametrize("block,test_bytes", [(1 << 20, 1 << 20), (50, 300)])
def test_leaks_equal_brute_force(spark, block, test_bytes):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.randint(5, 40))) for i in range(8)] + [(50, None), (51, ""), (0, text(20))]
    docs = [(i, text(30)) for i in range(20)]
    for i in range(20, 40):
        p = (r.choice(items[:8])[1]).split()
        k = r.randint(8, len(p)) if len(p) > 8 else len(p)
        part = " ".join(p[:k])
        docs.append((i, f"{text(9)}. {part.upper() if i % 2 else part.replace(' ', ',​ _').replace('w1', 'ｗ1')}_ {text(5)}"))
    docs += [(60, None), (61, ""), (20, docs[20][1])]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, words int")
    b = spark.createDataFrame([(*x, "q") for x in items], "item_id bigint, passage string, question string")
    got = leakage.leaked_passages(d, b, block_words=block, test_bytes=test_bytes).collect()
    best = {}
    for x in got:
        best[x.doc_id, x.item_id] = max(best.get((x.doc_id, x.item_id), 0), x.words)
    assert best == leak_brute(docs, items) and best
    by_id, passages = {}, {}
    for i, t in docs:
        by_id.setdefault(i, []).append(leakage.leak_words(t or ""))
    for i, p in items:
        passages.setdefault(i, []).append(leakage.leak_words(p or ""))
    for x in got:  # the run stands where it is said to
        runs = {tuple(w[x.doc_word : x.doc_word + x.words]) for w in by_id[x.doc_id]}
        assert runs & {tuple(w[x.item_word : x.item_word + x.words]) for w in passages[x.item_id]}
    stored = {}
    for x in leakage.SuffixShards.build(d, block_words=block, halo=60).search(b, test_bytes=test_bytes).collect():
        stored[x.doc_id, x.item_id] = max(stored.get((x.doc_id, x.item_id), 0), x.words)
    assert stored == best
    assert leakage.without_leaks(d, leakage.leaked_passages(d, b)).count() == len(docs) - sum(i in {k for k, _ in best} for i, _ in docs)
    assert leakage.leaked_passages(d.limit(0), b).count() == 0 and leakage.leaked_passages(d, b.limit(0)).count() == 0


def test_long_documents_are_cut_at_spaces(monkeypatch):
    monkeypatch.setattr(leakage, "SEGMENT", 10)
    text = "one two ｔhree four " * 20 + "x" * 50 + " end"
    assert leakage.text_codes(text, len).tolist() == [len(w) for w in leakage.leak_words(text)]


def test_suffix_array_is_sorted():
    import numpy as np

    codes = np.array([3, 1, 2, 1, 2, 1, 0, 1, 2, 1, 2, 0], np.int32)
    order = leakage.suffix_array(codes, 8)
    suffix = [tuple(codes[p : p + 8]) for p in order]
    assert suffix == sorted(suffix)


LOOKS = [
    ("paypal café ﬁle", "ｐаypal café​ ﬁle"),
    ("a b-c", "a b‐c"),
    ("so­ft kit", "soft kit"),
    ("Архив отчёт", "Apxив отчёт"),
    ("cd", "ⅽⅾ"),
]
SHOWN = [("Case", "case"), ("cafe", "café"), ("x2", "x²"), ("one", "own"), ("½", "1/2"), ("a  b", "a b"), ("l", "I")]


def test_fold_keeps_what_shows():
    for a, b in LOOKS:
        assert canonical.fold(a) == canonical.fold(b), (a, b)
    for a, b in SHOWN:
        assert canonical.fold(a) != canonical.fold(b), (a, b)
    for code in range(0x20, 0x3000):
        once = canonical.fold(f"x{chr(code)}y")
        assert canonical.fold(once) == once and unicodedata.is_normalized("NFC", once)


def test_spelling_automaton():
    s = canonical.Spellings([("Архив", "Архив"), ("оса", "оса")])
    assert s.match("Apxив") == "Архив" and s.match("А​pхив") == "Архив" and s.match("Архип") is None
    assert canonical.Spellings([("Архив", "Архив")], cost=1).match("Архиы") == "Архив"
    assert canonical.Spellings([]).match("x") is None


def test_automaton_edits_and_several_looks():
    s = canonical.Spellings([("lamp", 2), ("Index", 1), ("file", 3), ("café", 4)], cost=0)
    assert [s.match(x) for x in ("Ӏamp", "Ӏndex", "ﬁ​le", "café", "ｃａｆé", "cafe", "lamps")] == ["lamp", "Index", "file", "café", "café", None, None]
    t = canonical.Spellings([("lamp", 2), ("clamp", 1), ("lame", 0)], cost=1)
    assert t.match("lamp") == "lamp" and t.match("lam") == "lame" and t.match("clam") == "clamp" and t.match("xxlamp") is None
    # A sign's first look is taken before its second, whatever the ranks.
    assert canonical.Spellings([("lt", 0), ("It", 9)]).match("Ӏt") == "It"


def test_several_alphabets_look_latin():
    for odd, plain in (("𝗁𝖾𝗅𝗅𝗈", "hello"), ("ᏟᎪᎢ", "CAT"), ("ⲞⲤ", "OC"), ("ᴄᴏᴠ", "cov"), ("𐐄𐐕", "OC"), ("ǆ", "dž"), ("Ⅻ", "XII")):
        assert canonical.by_table(odd) == plain
    assert canonical.by_table("Mocквa") == "Москва" and canonical.by_table("сор") == "cop" and canonical.fold("𝐛") == "𝐛"


def test_the_vocabulary_tells_what_the_table_cannot(spark):
    rows = [(1, "a lamp here"), (2, "a Ӏamp here"), (3, "the Index"), (4, "the Ӏndex"), (5, "сор был"), (6, "cop был")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert canonical.fold("Ӏamp") != "lamp"  # by table alone this pair is missed
    assert {tuple(r) for r in lookalikes.look_alike_pairs(df, "doc_id", "text").collect()} == {(1, 2), (3, 4), (5, 6)}
    assert {tuple(r) for r in lookalikes.look_alike_classes(df, "doc_id", "text").collect()} == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5)}
    for shard in (1, 50_000):
        told = {r.token: r.spelling for r in canonical.canonical_spellings(df, "text", shard=shard).collect()}
        assert told == {"Ӏamp": "lamp"}
    foreign = canonical.canonical_spellings(df.where("doc_id = 5"), "text").collect()
    assert [tuple(r) for r in foreign] == [("сор", "сор")]


def test_look_alike_pairs(spark):
    rows, k = [], 1
    want = set()
    for a, b in LOOKS:
        rows += [(k, a), (k + 1, b), (k + 2, a)]
        want |= {(k, k + 1), (k + 1, k + 2)}
        k += 3
    for a, b in SHOWN:
        rows += [(k, a), (k + 1, b)]
        k += 2
    rows += [(k, None), (k + 1, ""), (k + 2, "")]
    rows += [(k + 10 + i, "Архив отчёт Архив") for i in range(3)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id bigint, text string, look string")
    assert {tuple(r) for r in lookalikes.look_alike_pairs(df, "doc_id", "text").collect()} == want
    assert lookalikes.look_alike_pairs(df.limit(0), "doc_id", "text").count() == 0
    told = {r.doc_id: r.canonical for r in canonical.canonical_texts(df, ["doc_id"], "text").collect()}
    assert told[10] == told[11] == "Архив отчёт" and told[k] is None and told[k + 1] == ""
    blocks = {r.doc_id: r.canonical for r in canonical.canonical_texts(df, ["doc_id"], "text", at_a_time=1).collect()}
    assert blocks == told
