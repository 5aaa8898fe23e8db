import random
import re

from plumbline.llm import ngram_matrix as nm
from plumbline.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = []
    for _, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    top = {i: i for i, _ in rows if i is not None}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and rows[a][0] is not None and rows[b][0] is not None and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(rows[a][0]), find(rows[b][0])))
                top[q] = p
    return sorted((-1 if i is None else i, len(s), -1 if i is None else find(i)) for (i, _), s in zip(rows, sets, strict=True))


def result(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in nm.classes(df).collect())


def family(rng, words, n, share):
    base = [rng.choice(words) for _ in range(120)]
    for _ in range(n):
        w = list(base)
        for _ in range(int(share * len(w) * rng.random())):
            k = rng.randrange(len(w))
            w[k : k + rng.randint(0, 1)] = [rng.choice(words)]
        yield " ".join(w)


def test_random_corpus_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    texts = [t for s in (0.02, 0.05, 0.08, 0.12, 0.2) for t in family(rng, words, 30, s)]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) + " " + passage for _ in range(60)]
    texts += ["Same Text of five words"] * 20 + ["same text OF five words"] * 3 + ["a b c d", "A b\tc\nd", "a", "", " \n ", None]
    texts += ["é É x y z", "É É x y z", "x " * 50_000]
    rows = [(k, t) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [(5, texts[5]), (6, texts[-10]), (None, texts[3]), (-7, texts[0])]  # repeated rows, one id with two texts, no id
    df = spark.createDataFrame([(i, t, "x", 3, b"y", 1) for i, t in rows], "doc_id long, text string, rid string, n int, data binary, row int").repartition(7)
    assert result(df) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert nm.classes(df).count() == 0 and nm.one_of_each(df).count() == 0


def test_one_of_each(spark):
    t = "one two three four five six seven eight nine ten"
    rows = [(4, t, "a", {"k": 1}), (2, t, "b", {"k": 2}), (2, t, "b", {"k": 2}), (9, "other words stand here and nowhere else", "c", None), (None, "no id at all in this row", "d", None), (11, None, "e", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, c string, m map<string,int>")
    got = nm.one_of_each(df)
    assert got.columns == df.columns and sorted((-1 if r.doc_id is None else r.doc_id) for r in got.collect()) == [-1, 2, 9, 11]


def test_components_of_a_random_graph(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(500 + k, 501 + k) for k in range(40)] + [(1000, 1001 + k) for k in range(50)]
    label = {v: v for e in edges for v in e}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            m = min(label[u], label[v])
            changed |= label[u] != m or label[v] != m
            label[u] = label[v] = m
    got = {r.u: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {v: m for v, m in label.items() if v != m}


def test_equal_row_batches(spark):
    # four partitions of a row each: one document twice, and no document twice
    df = spark.range(0, 4, 1, 4).selectExpr("if(id < 2, 1L, null) AS doc_id", "if(id < 2, 'one two three four five six seven', '') AS text")
    assert df.rdd.getNumPartitions() == 4 and result(df) == [(-1, 0, -1), (-1, 0, -1), (1, 3, 1), (1, 3, 1)]
    assert [r.doc_id for r in nm.one_of_each(df).collect() if r.doc_id is not None] == [1]


def test_rows_without_doc_id_are_judged_by_their_text(spark):
    a, b = " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(40))
    rows = [(1, a), (None, a), (None, b), (None, b), (None, b + " end"), (None, None), (2, "other words stand in here now")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string")
    kept = nm.one_of_each(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert (1, a) in got and (2, rows[6][1]) in got and sum(t in (b, b + " end") for _, t in got) == 1 and (None, a) not in got and len(got) == 4
