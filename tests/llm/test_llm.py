"""Corpus and record operators against libraries, brute force and awkward inputs."""

import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from veranico.llm import canonical, matching, packing, quantiles, subjects, tokenizer
from veranico.llm.queries import TOKENIZERS

BPE = f"{TOKENIZERS}/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return t


def texts():
    rng = random.Random(4)
    bits = ["a", "aa", "aaa", "aaaaaaa", "b", " ", "  ", "   ", "\n", "\r\n", "\t", "é", "ção", "1", "2234", "'s", "'ll", "’", "　", " ", "ing", "the", "THE", "_", "日本", "😀", "--", "=====", "²", "<|endoftext|>", "x" * 50]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(1500)]


def test_automaton_matches_the_library(library):
    a = tokenizer.Automaton(*tokenizer.load_merges(BPE)[1:])
    c = tokenizer._Chunks(a)
    for t in texts():
        ids = [i for part in c.parts(t) for i in part]
        assert ids == library.encode(t, add_special_tokens=False).ids
        assert a.decode(ids) == t


def test_automaton_accepts_exactly_tokenizations():
    a = tokenizer.Automaton(*tokenizer.load_merges(BPE)[1:])
    for x, y in ((a.arcs[b"t"], a.arcs[b"h"]), (a.arcs[b"a"], a.arcs[b"aa"])):
        assert not a.follows(x, y)


def test_encode_texts(spark, library):
    rows = [(1, "Cache memory and garbage collector."), (2, None), (3, ""), (3, ""), (4, "word " * 60000), (5, "a" * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("key", F.lit(0))
    got = [(r["doc_id"], list(r["ids"])) for r in tokenizer.encode_texts(df, "doc_id", "text", BPE).collect()]
    assert sorted(got) == sorted((i, library.encode(t, add_special_tokens=False).ids if t else []) for i, t in rows)
    counts = {(r["doc_id"], r["n_tokens"]) for r in tokenizer.count_tokens(df, "doc_id", "text", BPE).collect()}
    assert counts == {(i, len(ids)) for i, ids in got}
    assert tokenizer.encode_texts(df.limit(0), "doc_id", "text", BPE).count() == 0


def test_two_vocabularies_in_one_session(spark, tmp_path):
    """Each vocabulary gets its own ids, in both operators, whichever ran before."""
    import json

    whole = json.load(open(BPE, encoding="utf-8"))
    letters = sorted(tokenizer.byte_letters())
    other = {**whole, "model": {**whole["model"], "vocab": {c: i for i, c in enumerate(letters)} | {"Ġa": 256, "ab": 257}, "merges": ["Ġ a", "a b"]}}
    small = str(tmp_path / "small.json")
    json.dump(other, open(small, "w", encoding="utf-8"))
    docs = spark.createDataFrame([(1, "ab cab ab"), (2, "the cabin")], "doc_id long, text string")
    ids = lambda path: {r["doc_id"]: list(r["ids"]) for r in tokenizer.encode_texts(docs, "doc_id", "text", path).collect()}
    counts = lambda path: {r["doc_id"]: r["n_tokens"] for r in tokenizer.count_tokens(docs, "doc_id", "text", path).collect()}
    large, little, again = ids(BPE), ids(small), ids(BPE)
    a, b, c = (letters.index(x) for x in "abc")
    assert large == again != little and little[1] == [257, letters.index("Ġ"), c, 257, 256, b]
    assert counts(BPE) == {i: len(x) for i, x in large.items()} and counts(small) == {i: len(x) for i, x in little.items()}
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {**other["model"], "byte_fallback": True}}):
        json.dump({**other, **change}, open(small, "w", encoding="utf-8"))
        with pytest.raises(ValueError):
            tokenizer.load_merges(small)


@pytest.mark.parametrize("rows_per_bucket", [50_000, 50])
def test_packing(spark, rows_per_bucket):
    rng = random.Random(6)
    sizes = [rng.choice([20, 20, 20, rng.randint(1, 400)]) for _ in range(2000)] + [0, None, -3, 100, 101, 250, 1000, 5000]
    df = spark.createDataFrame(list(enumerate(sizes)), "id int, n int").withColumn("rank", F.lit(1)).withColumn("piece", F.lit(7))
    got = packing.pack_items(df, key="id", size="n", capacity=100, rows_per_bucket=rows_per_bucket).toPandas()
    assert set(got["id"]) == set(range(len(sizes)))
    full = got[got.container_id > 0].groupby("container_id")["n"].sum()
    assert full.max() <= 100 and list(full.index) == list(range(1, len(full) + 1))
    whole = got.groupby("id")["n"].sum()
    assert all(whole[i] == max(0, s or 0) for i, s in enumerate(sizes))
    split = got[got.piece > 0]["id"].unique()
    assert all((sizes[i] or 0) > 100 for i in split)
    assert set(got[got.container_id == 0]["n"]) == {0}
    assert len(full) <= np.ceil(full.sum() / 100) * 1.02 + 2
    assert packing.pack_items(df.limit(0), key="id", size="n", capacity=100).count() == 0


def test_plan_holds_every_item_once():
    hist = np.zeros(65)
    hist[[3, 7, 20, 33, 64]] = [1000, 5, 17, 400, 2]
    plan = packing.plan_containers(hist, 64)
    load: dict[int, int] = {}
    for n in range(1, 65):
        spans = sorted((a, b) for k, a, b, *_ in plan if k == n)
        assert [x for a, b in spans for x in range(a, b)] == list(range(int(hist[n])))
    for k, a, b, first, times in plan:
        for r in range(a, b):
            c = first + (r - a) % times
            load[c] = load.get(c, 0) + k
    assert max(load.values()) <= 64 and packing.plan_containers(np.zeros(65), 64) == []


PROBS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def nearest_rank(values, p):
    s = sorted(values)
    return s[max(0, int(np.ceil(p * len(s) - 1e-9)) - 1)]


@pytest.mark.parametrize("finish_at, block_rows", [(1000, 1000), (150, 700)])
def test_percentiles(spark, finish_at, block_rows):
    rng = random.Random(1)
    rows = [("big", i % 7, round(rng.gauss(0, 1) ** 3, 3)) for i in range(3000)] + [("flat", 0, 2.5)] * 400 + [("one", 1, -1.0), (None, 2, 4.0), (None, 2, 5.0), ("big", 1, None), ("big", 1, float("nan")), ("none", 1, None)]
    df = spark.createDataFrame(rows, "grp string, day int, v double").withColumn("p", F.lit("clash")).withColumn("g", F.lit(1)).withColumn("twice", F.col("v") * 2)
    answers = lambda s: {(r["grp"], r["p"]): r["value"] for r in quantiles.select_percentiles(s, PROBS, finish_at=finish_at).filter("variable = 'v'").collect()}
    got = answers(quantiles.summarise(df, ["grp"], ["v", "twice"], spread_by=["day"], block_rows=block_rows))
    by: dict = {}
    for g, _, v in rows:
        if v is not None and v == v:
            by.setdefault(g, []).append(v)
    assert got == {(g, p): nearest_rank(vs, p) for g, vs in by.items() for p in PROBS}
    parts = [quantiles.summarise(df.filter(F.col("day") == d), ["grp"], ["v"], block_rows=block_rows) for d in range(7)]
    assert answers(quantiles.merge(*parts)) == got
    rough = answers(quantiles.summarise(df, ["grp"], ["v"], resolution=0.1, block_rows=block_rows))
    assert rough.keys() == got.keys() and all(abs(rough[k] - got[k]) <= 0.05 + 1e-9 for k in got)
    days = [quantiles.summarise(df.filter(F.col("day") == d), ["grp"], ["v"], resolution=0.1, block_rows=block_rows) for d in range(7)]
    assert answers(quantiles.merge(*days)) == rough
    assert quantiles.select_percentiles(quantiles.summarise(df.limit(0), ["grp"], ["v"]), PROBS).count() == 0


ENTRIES = [
    (1, "state", "São Paulo", "SP"), (2, "state", "Minas Gerais", "MG"), (3, "state", "Paraná", "PR"), (4, "state", "Pará", "PA"), (5, "state", "Rio Grande do Sul", "RS"),
    (101, "biome", "Mata Atlântica", None), (102, "biome", "Cerrado", None), (103, "biome", "Amazônia", None),
    (1001, "municipality", "Santa Vorimeda do Sul", "SP"), (1002, "municipality", "Campo Bifolado", "MG"), (1003, "municipality", "Campo Bifolado", "PR"), (1004, "municipality", "Lagoa da Pirunemá", "RS"), (1005, "municipality", "Alto Tesimoga", "PA"),
]
VALUES = [
    ("Santa Vorimeda do Sul", "SP", "Mata Atlântica", 1001, 1, 101),
    ("Sta. Vorimeda do Sul (SP)", "Sao Paulo ", "Mata Atl.", 1001, 1, 101),
    ("Vorimeda do Sul, Santa", "S. Paulo", "MATA ATLANTICA", 1001, 1, 101),
    ("Santa Vorimdea do Sul", "SÃ£o Paulo", "Mata AtlÃ¢ntica", 1001, 1, 101),
    ("Campo Bifolado (PR)", "Minas Gerais", "Cerrdao", 1003, 2, 102),
    ("Campo Bifolado", "MG", "Bioma Cerrado", 1002, 2, 102),
    ("Campo Bifolado", None, "Tundra", 0, None, 0),
    ("Cpo. Bifolado - PR", "-", "?", 1003, 0, 0),
    ("Mun. de Lagoa da Pirunem&#225;", "RGS", "Amazon", 1004, 5, 103),
    ("Alto Tesimoga", "Uruguai", "amaz.", 1005, 0, 103),
    ("ALTO TESIMOGA (Pará)", "P.A.", "sem bioma", 1005, 4, 0),
    ("Nova Zuluquega", "Parana", "", 0, 3, 0),
    ("", " ", "n/d", 0, 0, 0),
    ("x" * 20000, "y" * 5000, "z" * 5000, 0, 0, 0),
    (None, None, None, None, None, None),
]


def test_places(spark):
    entries = spark.createDataFrame(ENTRIES, "entry_id long, list_name string, canonical_name string, state_acronym string")
    rows = [(i, *v[:3]) for i, v in enumerate(VALUES)]
    df = spark.createDataFrame([*rows, rows[0]], "urb_id int, m string, s string, b string").withColumn("entry_id", F.lit("clash")).withColumn("key", F.lit(1))
    run = lambda d, e: canonical.map_places(d, e, key="urb_id", municipality="m", state="s", biome="b")
    got = [(r["urb_id"], r["field_name"], r["entry_id"]) for r in run(df, entries).collect()]
    want = [(i, f, v[k]) for i, v in enumerate(VALUES) for k, f in ((3, "m"), (4, "s"), (5, "b")) if v[k] is not None]
    assert sorted(got) == sorted(want + want[:3])
    assert {r["entry_id"] for r in run(df, entries.limit(0)).collect()} == {0} and run(df.limit(0), entries).count() == 0
    with pytest.raises(ValueError):
        canonical.map_places(df, entries, key="urb_id", municipality="m", state="s", biome="b", most_entries=3)


def test_two_lists_in_one_session(spark):
    """Lists of one length that differ in their last rows only don't share answers."""
    many = [(i, "municipality", f"Vila {chr(97 + i // 26)}{chr(97 + i % 26)}zanor", "SP") for i in range(60)]
    rows = spark.createDataFrame([(1, "Porto Quelimo", "SP", None)], "urb_id int, m string, s string, b string")
    for entry_id in (900, 901):
        entries = spark.createDataFrame([*many, (entry_id, "municipality", "Porto Quelimo", "SP")], "entry_id long, list_name string, canonical_name string, state_acronym string")
        got = {r["field_name"]: r["entry_id"] for r in canonical.map_places(rows, entries, key="urb_id", municipality="m", state="s", biome="b").collect()}
        assert got["m"] == entry_id


def test_candidates_against_full_comparison():
    """Names of every length: all names within the bound are found, by letters and word by word."""
    rng = random.Random(21)
    syllable = lambda: rng.choice("bcdfglmnprstv") + rng.choice("aeiou")
    names = {" ".join(rng.sample(["santa", "porto", "do", "alto", "nova"], rng.choice([0, 1, 1, 2])) + ["".join(syllable() for _ in range(rng.randint(1, 9)))]) for _ in range(400)}
    listed = canonical.Names([(i, n, None) for i, n in enumerate(sorted(names))])
    found = asked = 0
    for n in sorted(names):
        for _ in range(2):
            w = n.split()
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(w))
                x, p = w[k], rng.randrange(len(w[k]))
                w[k] = rng.choice([x[:p] + rng.choice("aeiourst") + x[p:], x[:p] + x[p + 1 :] or x, x[:p] + rng.choice("abcde") + x[p + 1 :], x[:2] if len(x) > 5 else x, x[:p] + x[p : p + 2][::-1] + x[p + 2 :]])
            key = "".join(w)
            want = {k for k, full in listed.split.items() if min(canonical.distance(key, k, 2.0), canonical.by_words(w, full, 2.0)) <= 2.0}
            got = {k for _, k in listed.ranked(w, 2.0)}
            assert got == (want if key not in listed.by_key else {key})
            asked += 1
            found += len(got) > 1
    assert asked == 2 * len(names) and found > 50


def test_distance():
    assert canonical.distance("abc", "abc") == 0 and canonical.distance("abcd", "abdc") == 0.8 and canonical.distance("bola", "bolla") == 0.7
    assert canonical.distance("bala", "bola") == 0.9 and canonical.distance("abc", "xyz", 2.0) > 2


def place(i, name, state="MG", area=1000.0, biome="cerrado", y=-20.0, x=-44.0):
    return (i, name, state, area, biome, y, x)


def test_matching(spark):
    schema = "id long, name string, state string, area double, biome string, y double, x double"
    left = [place(1, "Alto Vorimeda"), place(2, "Campo Bifolado", "SP", 500.0, None, -22.0, -47.0), place(3, "Campo Bifolado", "PR", 90.0, None, -25.0, -50.0), place(4, "Alto Vorimeda"), place(5, None), place(6, ""), place(7, "Serra Tupanega", None, None, None, None, None), place(8, "Sozinho Bem Longe", "AC", 5.0, None, -9.0, -70.0)]
    right = [(*place(101, "ALTO VORIMEDA", area=1010.0), 2010), (*place(102, "Alto Vorimdea", area=10.0, x=-44.01), 2022), (*place(103, "Bifolado, Campo", "SP", 50000.0, None, -22.01, -47.0), 2010), (*place(104, "Cpo. Bifolado", "PR", 91.0, None, None, None), 2010), (*place(105, None), 2010), (*place(106, "serra tupanega", None, None, None, None, None), 2010)]
    a, b = spark.createDataFrame(left + left[:1], schema).withColumn("core", F.lit("clash")), spark.createDataFrame(right, schema + ", slot int").withColumn("words", F.lit(1))
    got = {(r["l"], r["r"]): r["confidence"] for r in matching.match_places(a, b).collect()}
    assert set(got) == {(1, 101), (4, 101), (1, 102), (4, 102), (2, 103), (3, 104), (7, 106)}
    assert all(0 < c < 1 for c in got.values()) and got[1, 101] > got[7, 106]
    assert matching.match_places(a.limit(0), b).count() == 0 == matching.match_places(a, b.limit(0)).count()


def test_window_finds_what_brute_force_finds(spark):
    rng = random.Random(9)
    name = lambda: "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(4))
    left = [(i, f"{rng.choice(['Alto', 'Nova', 'Serra'])} {name()}", rng.choice(["MG", "SP", None]), rng.uniform(10, 9999), None, rng.uniform(-30, 0), rng.uniform(-60, -40)) for i in range(400)]

    def typo(s):
        k = rng.randrange(5, len(s) - 1)
        return rng.choice([s, s[:k] + s[k + 1] + s[k] + s[k + 2 :], s[:k] + s[k + 1 :], s.upper()])

    right = [(10_000 + i, typo(n), s, a, None, y + 0.01, x, 1) for i, n, s, a, _, y, x in left]
    schema = "id long, name string, state string, area double, biome string, y double, x double"
    got = {(r["l"], r["r"]) for r in matching.match_places(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema + ", slot int")).collect()}
    want = {(i, 10_000 + i) for i in range(400)}
    assert got <= want and len(got) >= 0.98 * len(want)


PLACES = "id long, name string, state string, area double, biome string, y double, x double"


def matched(spark, left, right):
    return {(r["l"], r["r"]) for r in matching.match_places(spark.createDataFrame(left, PLACES), spark.createDataFrame(right, PLACES + ", slot int")).collect()}


@pytest.mark.parametrize("n", [2, 5])
def test_double_entries_on_both_sides(spark, n):
    left = [place(i, "Alto Vorimeda", area=1000.0 + i) for i in range(n)]
    right = [(*place(100 + i, "Alto Vorimeda", area=1000.0 - i), 2010) for i in range(n)]
    assert matched(spark, left, right) == {(i, 100 + j) for i in range(n) for j in range(n)}


@pytest.mark.parametrize("n", [40, 80])
def test_equal_records_all_come_out(spark, n):
    left, right = [place(i, "Alto Vorimeda") for i in range(n)], [(*place(1000 + i, "ALTO VORIMEDA"), 2010) for i in range(n)]
    assert matched(spark, left, right) == {(i, 1000 + j) for i in range(n) for j in range(n)}


def test_a_name_of_a_third_of_all_rows(spark):
    """Namesakes far more than a window holds are told apart by their points."""
    rng = random.Random(14)
    left, right = [], []
    for i in range(900):
        name = "Bom Jardim" if i % 3 == 0 else "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(5))
        y, x, area = rng.uniform(-30, 0), rng.uniform(-60, -40), rng.uniform(10, 99999)
        left.append((i, name, None, area if i % 2 else None, None, y, x))
        right.append((10_000 + i, name, None, area * 1.01, None, y + 0.01, x, 1))
    got = matched(spark, left, right)
    assert len(got & {(i, 10_000 + i) for i in range(900)}) >= 0.99 * 900 and len(got) <= 1.01 * 900


def test_assignment_is_the_greatest(spark):
    """The greatest sum of an exhaustive search, by components and, within its steps, by auction."""
    from itertools import permutations

    rng, rows, best = random.Random(17), [], 0.0
    for block in range(6):
        w = [[rng.choice([0.0, round(rng.uniform(3, 9), 2)]) for _ in range(5)] for _ in range(4)]
        rows += [(block * 10 + i, block * 10 + j, 1, v) for i, line in enumerate(w) for j, v in enumerate(line) if v]
        best += max(sum(max(0.0, w[i][j] - 2) for i, j in enumerate(p)) for p in permutations(range(5), 4))
    pairs = spark.createDataFrame(rows, "l long, r long, slot int, score double")
    for solve_at, slack in ((1000, 1e-6), (3, 0.05 * 24)):
        got = matching.assign(pairs, double=99.0, mutual=99.0, solve_at=solve_at).toPandas()
        assert not got.duplicated("l").any() and not got.duplicated("r").any()
        assert best - slack <= (got.score - 2).sum() <= best + 1e-6
    crossed = spark.createDataFrame([(1, 1, 1, 8.0), (1, 2, 1, 7.5), (2, 1, 1, 7.8)], "l long, r long, slot int, score double")
    assert {(r["l"], r["r"]) for r in matching.assign(crossed, double=99.0, mutual=99.0).collect()} == {(1, 2), (2, 1)}
    equal = spark.createDataFrame([(i, j, 1, 6.0) for i in range(30) for j in range(30)], "l long, r long, slot int, score double")
    assert matching.assign(equal, double=99.0, mutual=99.0).count() == 30


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (300, 200), (7, 7)]
    got = {r["node"]: r["component"] for r in matching.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}


WORDS = {"software": ["compiler", "database", "browser", "kernel", "pointer"], "optics": ["prism", "lens", "mirror", "grating", "polariser"], "food": ["dough", "cheese", "noodle", "syrup", "butter"]}


def corpus(n=400):
    rng = random.Random(12)
    docs, truth, labels = [], {}, []
    names = list(WORDS)
    for i in range(n):
        mine = rng.sample(names, rng.choice([1, 1, 2]))
        order = [s for s in mine for _ in range(6)]
        rng.shuffle(order)
        body = [f"The {rng.choice(WORDS[s])} is placed near the {rng.choice(WORDS[s])} of the housing." for s in order]
        other = rng.choice([s for s in names if s not in mine])
        body.append(f"From another field, that of {rng.choice(WORDS[other])}, a comparable problem is known.")
        docs.append((i, " ".join(body)))
        truth[i] = set(mine)
        if i % 4 == 0:
            labels += [(i, s) for s in mine] if i % 40 else [(i, other)]
    return docs, truth, labels


def test_subjects(spark):
    docs, truth, labels = corpus()
    extra = [(9001, None), (9002, ""), (9003, "  \n "), (9004, "nothing of note here."), (9005, "compiler. " * 40000), docs[0]]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string").withColumn("doc", F.lit(1)).withColumn("share", F.lit(1))
    s = spark.createDataFrame(labels + labels[:5] + [(None, "food"), (3, None), (3, "nonsense")], "doc_id long, subject string")
    got: dict = {}
    for r in subjects.label_subjects(d, s, sorted(WORDS)).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    assert sum(got.get(i) == t for i, t in truth.items()) >= 0.97 * len(truth)
    assert got.keys() & {9001, 9002, 9003, 9004} == set() and got.get(9005, {"software"}) == {"software"}
    stretches = {(r["doc_id"], r["subject"]) for r in subjects.label_subjects(d, s, sorted(WORDS), most_terms=5).collect()}
    assert stretches == {(i, x) for i, xs in got.items() for x in xs}
    assert subjects.label_subjects(d, s.limit(0), sorted(WORDS)).count() == 0
    assert subjects.label_subjects(d.limit(0), s, sorted(WORDS)).count() == 0


def test_subjects_of_frequent_words(spark):
    """A subject's words are kept however many documents hold them; words of all subjects are not."""
    docs, truth, labels = corpus()
    d, s = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, subject string")
    got: dict = {}
    for r in subjects.label_subjects(d, s, sorted(WORDS)).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    assert sum(got.get(i) == t for i, t in truth.items()) >= 0.97 * len(truth)
    marks = s.select(F.col("doc_id").alias("doc"), F.when(F.col("subject") == "software", 1).when(F.col("subject") == "optics", 2).otherwise(3).alias("label"))
    told = {r["word"] for r in subjects.telling_words(d.withColumnRenamed("doc_id", "doc"), marks, 0.42).collect()}
    assert {"compiler", "lens", "dough"} <= told and not told & {"the", "housing", "placed"}


def test_edges_join_similar_documents(spark):
    """Documents of one subject are linked, of a hub term too, and labels reach documents far from any seed."""
    rows = [(i, [30 - i % 5, 10, 5]) for i in range(400)] + [(1000 + i, [60 - i % 5, 50, 40]) for i in range(400)]
    verified = spark.createDataFrame(rows, "row long, terms array<int>")
    edges = subjects.similar_documents(verified).toPandas()
    assert set(edges.a) == {r[0] for r in rows} and ((edges.a < 1000) == (edges.b < 1000)).all() and edges.w.between(0.3, 1 + 1e-9).all()
    assert len(edges) <= 2 * 3 * 2 * len(rows)
    seeds = [(i, 1, 1.0) for i in range(0, 400, 9)] + [(1000 + i, label, 0.5) for i in range(0, 400, 9) for label in (2, 3)]
    labels = subjects.propagate(spark.createDataFrame(edges), spark.createDataFrame(seeds, "row long, label int, y double"), rounds=4).toPandas()
    assert set(labels[labels.row < 1000].label) == {1} and set(labels[labels.row >= 1000].label) == {2, 3}
    assert labels.row.nunique() > 700 and (labels.groupby("row").y.sum() - 1).abs().max() < 1e-9


def test_labels_move_over_all_pairs(spark):
    """As over every pair that shares a term, listed; also where a row's only seed stands far from it among equal terms."""
    rng = random.Random(5)
    sets = {i: sorted(rng.sample(range(1, 13), rng.randint(1, 5)), reverse=True) for i in range(60)} | {90: [99]}
    times = {i: 1 + i % 3 for i in sets}
    rows = [(i, t) for i, t in sets.items() for _ in range(times[i])] + [(1000 + i, [60, 50]) for i in range(300)]
    seeds = [(i, 1 + i % 2, 1.0) for i in range(0, 20)] + [(90, 3, 1.0), (1000, 4, 1.0)]
    verified, s = spark.createDataFrame(rows, "row long, terms array<int>"), spark.createDataFrame(seeds, "row long, label int, y double")
    pairs = [(a, b, times[b] * len(shared) / (len(p) * len(q)) ** 0.5) for a, p in sets.items() for b, q in sets.items() if a != b and (shared := {*p} & {*q})]
    edges = spark.createDataFrame(pairs, "a long, b long, w double")
    near = {(r["row"], r["label"]): r["y"] for r in subjects.propagate(edges, s.filter("row < 1000"), rounds=3, sharp=2.0).collect()}
    for most in (1_000_000, 1):
        got = {(r["row"], r["label"]): r["y"] for r in subjects.propagate_all(verified, s, rounds=3, most_sent=most).collect()}
        assert {k: v for k, v in got.items() if k[0] < 1000} == pytest.approx(near)
        assert {k for k in got if k[0] >= 1000} == {(1000 + i, 4) for i in range(300)}


def test_passing_mentions_in_any_words(spark):
    """Own sentences count whatever words they hold, and a mention in other words doesn't, in short documents too."""
    rng, names, docs = random.Random(3), list(WORDS), []
    for i in range(240):
        mine, other = rng.sample(names, 2)
        body = [f"A comparable problem is that the {rng.choice(WORDS[mine])} is near the {rng.choice(WORDS[mine])}." for _ in range(3)]
        docs.append((i, " ".join([*body, f"Readers may think of the {rng.choice(WORDS[other])}."]), mine))
    d = spark.createDataFrame([x[:2] for x in docs], "doc_id long, text string")
    s = spark.createDataFrame([(i, m) for i, _, m in docs if i % 3 == 0], "doc_id long, subject string")
    got: dict = {}
    for r in subjects.label_subjects(d, s, sorted(WORDS)).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    assert sum(got.get(i) == {m} for i, _, m in docs) >= 0.97 * len(docs)


def test_reading():
    r = subjects._Reader()
    read = lambda t: " ".join(w for p in subjects.pieces(t) for w in r[p])
    assert read("<p>The vá1vula of FIG. 3 is elét-\nrica. Next; one").split() == "the valvula of fig is eletrica next one".split()
    assert read("A one. B two; see FIG. 3 here").count(subjects.END) == 2
    assert read("carcaÃ§a") == "carcaca" and string.ascii_lowercase[:2] == "ab"


@pytest.mark.parametrize("name", ["p2_found", "p4_found", "p8_ids", "p10_found"])
def test_result_columns(spark, name):
    import __spark_entry__ as e

    want = {"p2_found": {"municipality_id": "bigint", "polygon_id": "bigint"}, "p4_found": {"urb_id": "bigint", "field_name": "string", "entry_id": "bigint"}, "p8_ids": {"doc_id": "bigint", "ids": "array<int>"}, "p10_found": {"doc_id": "bigint", "subject": "string"}}
    df = e.queries()[name](spark, "/root/testdata/sf0.001")
    assert dict(df.dtypes) == want[name]
    rows = df.count()
    assert rows > 0 and df.distinct().count() == rows
