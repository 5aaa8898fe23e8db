import random

from plumbline.llm import template_decon as td

ITEM = "Once upon a time Ann had 3 apples and gave 2 apples to Bob, then Ann went 5 km home."
DOCS = "doc_id long, text string, dt string, h long, item_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, "clash") for i, t in rows], DOCS)


def items(spark, rows):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "item_id long, text string, doc_id string")


def test_reparameterised_questions(spark):
    rows = [
        (1, "before. " + ITEM + " after"), (2, "x y. Once upon a time Eva had 7 apples and gave 9 apples to Tom, then Eva went 4 miles home."), (3, "Once upon a time Eva had 7 apples and gave 9 apples to Tom, then Zoe went 4 miles home."),
        (4, None), (5, ""), (6, "few words"), (7, "tail of it: gave 2 apples to Bob, then Ann went 5 km home. " + "z " * 50), (None, ITEM), (8, "word " * 60_000 + ITEM), (1, "before. " + ITEM + " after"),
    ]
    docs, bench = frame(spark, rows), items(spark, [(10, ITEM), (10, ITEM), (11, None), (None, ITEM), (12, "too short")])
    got = {(r.doc_id, r.item_id): r for r in td.leaks(docs, bench).collect()}
    assert set(got) == {(1, 10), (2, 10), (7, 10), (8, 10)}  # 3 gives Ann two names
    assert got[1, 10].changed == 0 and got[2, 10].changed == 6 and got[2, 10].matched == 20
    kept = td.clean(docs, bench)
    assert kept.columns == docs.columns and sorted((r.doc_id or -1) for r in kept.collect()) == [3, 4, 5, 6]
    assert td.leaks(docs.limit(0), bench).count() == 0 and td.leaks(docs, bench.limit(0)).count() == 0


def test_whole_items_equal_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["an", "the", "er", "ti", "sch"]) for _ in range(rng.randint(1, 4)))
    bench = [(k, " ".join(word() for _ in range(rng.randint(9, 40))) + ".") for k in range(20)]
    rows = []
    for k in range(150):
        w = [word() for _ in range(rng.randint(0, 80))]
        if k % 3 == 0:
            w.insert(rng.randint(0, len(w)), rng.choice(bench)[1].title() if k % 2 else rng.choice(bench)[1])
        rows.append((k, " ".join(w)))
    plain = lambda t: f" {' '.join(x.rstrip('.') for x in t.split())} "
    want = {(i, b) for i, t in rows for b, s in bench if plain(s) in plain(t)}
    got = {(r.doc_id, r.item_id) for r in td.leaks(frame(spark, rows), items(spark, bench)).collect()}
    assert want <= got and len(got) <= 50


def test_native_plan(spark):
    docs, bench = frame(spark, [(1, ITEM)]), items(spark, [(10, ITEM)])
    plan = td.leaks(docs, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_partial_copies_at_every_offset(spark):
    bench = [(n, " ".join(f"item{chr(97 + n)}word{chr(97 + k)}" for k in range(n))) for n in (15, 16, 19, 22, 25)]
    rows, want = [], set()
    for item, text in bench:
        w = text.split()
        for part in (w[: -(-len(w) // 2)], ["altered" if k % 10 == 9 else x for k, x in enumerate(w)]):
            for offset in range(12):
                want.add((len(rows), item))
                rows.append((len(rows), " ".join(["before"] * offset + part + ["after"] * 5)))
    got = {(r.doc_id, r.item_id) for r in td.leaks(frame(spark, rows), items(spark, bench)).collect()}
    assert got == want


def test_short_items_number_words_and_long_names(spark):
    bench = items(spark, [(1, "What is the capital of France?"), (2, "Name it"), (3, "They saw that Ann Smith had 3 apples in New York and 24 pears at home."), (4, "")])
    rows = [
        (1, "so: what is the capital of Spain? yes"), (2, "what is the big capital of France"), (3, "Name it."), (4, "please name it now"),
        (5, "x y they saw that Bob had twenty four apples in Rome and seven pears at home. z"), (6, "what is the capital of France"),
    ]
    got = {(r.doc_id, r.item_id) for r in td.leaks(frame(spark, rows), bench).collect()}
    assert got == {(1, 1), (3, 2), (5, 3), (6, 1)}


def test_leaks_equal_brute_force(spark):
    """Every alignment that eight words in a row propose, judged word by word in plain Python, from partial and changed copies at every shift."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["an", "the", "er", "ti", "sch"]) for _ in range(rng.randint(1, 3)))
    bench = [(k, [word() if rng.random() < 0.85 else f"slot{rng.randint(0, 2)}" for _ in range(rng.randint(5, 24))]) for k in range(12)]
    say = lambda w, names: " ".join(names.get(x, x) for x in w)
    own = {"slot0": "12", "slot1": "Anna", "slot2": "7"}
    rows = []
    for k in range(160):
        w = [word() for _ in range(rng.randint(0, 20))] + ["a"]
        part = rng.choice(bench)[1]
        a = rng.randint(0, len(part) // 2)
        names = own if k % 3 else {"slot0": rng.choice(["12", "5"]), "slot1": rng.choice(["Anna", "Eva"]), "slot2": "5"}
        rows.append((k, " ".join([*w, say(part[a : len(part) - rng.randint(0, len(part) // 2)], names), *[word() for _ in range(rng.randint(0, 9))]])))

    def canon(text):
        t, w = [], text.split(" ")
        for k, x in enumerate(w):
            t.append("#n" if x.isdigit() else "#p" if k and x[:1].isupper() else x.lower())
        keep = [k for k in range(len(t)) if not (k and t[k] in ("#n", "#p") and t[k] == t[k - 1])]
        return [t[k] for k in keep], [w[k] for k in keep]

    want = set()
    for item, parts in bench:
        bt, bw = canon(say(parts, own))
        for doc, text in rows:
            dt, dw = canon(text)
            size, hit = min(8, len(bt)), set()
            for shift in range(-len(bt), len(dt)):
                same = [j for j in range(len(bt)) if 0 <= shift + j < len(dt) and bt[j] == dt[shift + j]]
                if not any(all(j + x in same for x in range(size)) for j in range(len(bt) - size + 1)):
                    continue
                slots = {(bt[j], bw[j], dw[shift + j]) for j in same if "#" in bt[j]}
                if len(slots) == len({s[:2] for s in slots}):
                    hit |= set(same)
            if len(hit) >= (td.COVERAGE * len(bt) if len(bt) >= 8 else len(bt)) and (len(bt) >= td.SHORTEST or len(dt) == len(bt)):
                want.add((doc, item))
    got = {(r.doc_id, r.item_id) for r in td.leaks(frame(spark, rows), items(spark, [(k, say(p, own)) for k, p in bench])).collect()}
    assert got == want and len(want) > 40


def test_query_equals_its_sql(spark, sf_dir, tmp_path):
    import duckdb

    rows = [
        (1, "so: what is the capital of Spain? yes"), (3, "Name it."), (4, "please name it now"), (5, "x y they saw that Bob had twenty four apples in Rome and seven pears at home. z"), (6, None), (7, ""), (None, ITEM),
        (8, "a  b. Once upon a time Eva had 7 apples and gave 9 apples to Tom, then Eva went 4 miles\nhome."), (9, "Once upon a time Eva had 7 apples and gave 9 apples to Tom, then Zoe went 4 miles home."), (1, "so: what is the capital of Spain? yes"), (10, "x." + ITEM + ITEM),
    ]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    items(spark, [(1, "What is the capital of France?"), (2, "Name it"), (3, "They saw that Ann Smith had 3 apples in New York and 24 pears at home."), (4, ""), (5, None), (None, "x"), (10, ITEM), (10, ITEM)]).write.parquet(str(tmp_path / "benchmark.parquet"))
    for path, pattern, least in ((sf_dir, "{}/{}.parquet", 1), (str(tmp_path), "{}/{}.parquet/*.parquet", 5)):
        con = duckdb.connect()
        for name in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{pattern.format(path, name)}'")
        r = con.execute(td.oracle_sql())
        names = [c[0] for c in r.description]
        want = sorted(tuple(dict(zip(names, x, strict=True))[c] for c in sorted(names)) for x in r.fetchall())
        df = td.query(spark, path)
        assert sorted(tuple(x[c] for c in sorted(df.columns)) for x in df.collect()) == want and sorted(df.columns) == sorted(names) and len(want) >= least
