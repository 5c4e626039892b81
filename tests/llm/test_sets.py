"""Fingerprints, the mix, the Jaccard join, URL rules and the pipeline against plain versions and odd input."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import agree
from unspool.llm import fingerprint, graph, jaccard, mixing, queries, url_rules

BIG = "/root/testdata/sf0.01"
LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_links long, size int, bucket int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def odd_docs(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, "  \n", None), (4, "one two", "b"), (5, "One TWO", "b"), (6, "a b c d e f g h i j", "b"), (6, "a b c d e f g h i j", "b"), (7, "a b c d e f g h i k", None), (9, long, "c"), (12, long + " tail", "c"), (-4, "ünï cödé x y z", "ß")]
    return spark.createDataFrame([(i, t, "en", s, None, 1, 2, 3) for i, t, s in rows], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, data_dir, name):
    agree(queries.QUERIES[name](spark, data_dir), duck, queries.ORACLE_SQL[name])


def test_odd_rows_agree_with_sql(spark, tmp_path):
    """The SQL of URL rules and of decontamination on odd URLs, and on items and texts of one sentence, two words or none."""
    import duckdb

    rng = random.Random(11)
    urls = [None, "", "no scheme/org/", "://x.org/en/1", "http://A.Example.ORG/es/1", "http://x.net/de/5://y", "http://x.org?a/b", "http://x..com/fr/#a", "ftp://Example.com", "http://-/a//b"]
    for _ in range(300):
        kind = rng.choice(["org", "com", "net"])
        urls.append(f"http://{rng.choice(['www', 'm', 'a-b'])}.example.{kind}/{rng.choice(['es', 'en', 'de', 'fr'])}/{rng.randrange(30)}{rng.choice(['', '?page=1', '?q=2&Ref=x', '.html'])}")
    stock = [f"{a}{b}" for a in ("öl", "be", "TA", "rÉ") for b in range(60)]
    say = lambda n: " ".join(rng.choices(stock, k=n))
    items = [(1, None), (2, ""), (3, "..."), (None, "a b c d e f"), (4, "Yes"), (5, "Not, now!"), (6, "yes"), (7, "a b c")]
    items += [(k, f"{say(rng.randrange(3, 30))}{rng.choice(['. ', '?', chr(10), '! '])}{say(rng.randrange(1, 12))}.") for k in range(8, 40)]
    texts = [None, "", "He said yes and no. Yes! But not now.", "one\nnot now\ntwo", "Yes.no yes", "a. yes", "Not now. Not", "A B C", say(3000)]
    for _, text in items[8:]:
        words = text.split()
        for _ in range(4):
            a, b = rng.randrange(6), rng.randrange(6)
            texts.append(f"{say(rng.randrange(60))} {' '.join(words[a : len(words) - b])} {say(rng.randrange(60))}")
    con = duckdb.connect()
    for name, rows, columns in (("pages", list(enumerate(urls)), "page_id long, url string"), ("benchmark", items, "item_id long, text string"), ("documents", list(enumerate(texts)), "doc_id long, text string")):
        spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    for name, column in (("op8_url_rules", "mined_rule"), ("op9_decontaminate", "contaminated")):
        frame = queries.QUERIES[name](spark, str(tmp_path))
        agree(frame, con, queries.ORACLE_SQL[name])
        assert 10 < frame.where(f"{column} is not null and {column} <> 'false'").count() < frame.count()


def plain_fingerprints(rows):
    """doc_id to (n_chars, edited text, Jaccard to the edited, Jaccard to the next)."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, text) in enumerate(rows):
        other, half = rows[(k + 1) % len(rows)][1], len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        near = [len(a & b) / len(a | b) if a | b else 1.0 for a, b in ((shingles(text), shingles(edited)), (shingles(text), shingles(other)))]
        out.append((i, len(text), edited, *near))
    return out


def test_fingerprints(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op1_fingerprint"](spark, BIG).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    errors, by_id = [], dict(rows)
    for i, n, edited, near_edited, near_next in plain_fingerprints(rows):
        assert (got[i].n_chars, got[i].edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        size = len(shingles(by_id[i]))
        errors += [("edited", size, got[i].fingerprint[16] + got[i].edited_fingerprint[16] == "==", abs(got[i].near_edited - near_edited)), ("next", size, False, abs(got[i].near_next - near_next))]
    # Texts that keep all their shingles are exact; the others by the size of the text.
    sizes = ((0, 60), (60, 200), (200, 10**9))
    mean = {(c, lo): sum(found) / len(found) for c in ("edited", "next") for lo, hi in sizes if (found := [e for kind, n, whole, e in errors if kind == c and lo <= n < hi])}
    print(mean)
    assert all(e < 1e-9 for _, _, whole, e in errors if whole) and sum(whole for _, _, whole, _ in errors) > 200
    assert mean["edited", 0] < 0.015 and mean["edited", 60] < 0.03 and mean["edited", 200] < 0.035 and max(mean["next", lo] for lo, _ in sizes) < 0.001
    by_text = {}
    for i, t in rows:
        assert by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    assert len(set(by_text.values())) > 0.98 * len(by_text)


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_successors(spark, partitions):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        docs = odd_docs(spark).unionByName(spark.createDataFrame([(None, "no id here", None, None, None, 1, 2, 3)], DOCS))
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        want = sorted((str(i), n, hashlib.sha256(e.encode()).hexdigest()) for i, n, e, _, _ in plain_fingerprints(rows))
        got = fingerprint.fingerprints(docs).collect()
        assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == want
        assert fingerprint.fingerprints(docs.limit(0)).count() == 0
        assert fingerprint.fingerprints(docs.limit(1)).count() == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_sketch_keeps_all_below_the_threshold(spark):
    text = " ".join(f"w{k % 700}" for k in range(900))
    both = spark.createDataFrame([(text, text + " more words at the end of it")], "a string, b string")
    s = lambda c, bits: fingerprint.sketch(F.col(c), scale_bits=bits)
    row = both.select(s("a", 0).alias("all"), s("a", 2).alias("some"), fingerprint.containment(s("a", 2), s("b", 2)).alias("c"), fingerprint.merge(s("a", 2), s("b", 2)).alias("m"), s("b", 2).alias("b")).first()
    assert len(row["all"]["kept"]) == len(shingles(text))
    assert row["some"]["kept"] == [h for h in row["all"]["kept"] if h < 1 << (fingerprint.HASH_BITS - 2)]
    assert row.c == 1.0 and row.m == sorted(set(row["some"]["kept"]) | set(row["b"]["kept"])) and 100 < len(row["some"]["kept"]) < 260


def test_whole_sketches(spark):
    """Short texts are compared exactly, with long ones by the threshold; merged and contained alike."""
    short, other, long = "a b c d e f g h i j", "a b c d e f g x i j", " ".join(f"w{k}" for k in range(400)) + " a b c d e f g h i j"
    row = spark.createDataFrame([(short, other, long, "")], "a string, b string, c string, e string")
    s = {c: fingerprint.sketch(F.col(c)) for c in "abce"}
    got = row.select(
        fingerprint.likeness(s["a"], s["b"]).alias("ab"), fingerprint.containment(s["a"], s["b"]).alias("in_b"), F.size(fingerprint.merge(s["a"], s["b"])).alias("m"),
        fingerprint.likeness(s["a"], s["c"]).alias("ac"), fingerprint.merge(s["a"], s["c"]).alias("mc"), s["c"]["kept"].alias("c"), fingerprint.likeness(s["a"], s["e"]).alias("ae"), fingerprint.likeness(s["e"], s["e"]).alias("ee"), fingerprint.as_text(s["e"]).alias("text"),
    ).first()
    x, y = shingles(short), shingles(other)
    assert got.ab == len(x & y) / len(x | y) and got.in_b == len(x & y) / len(x) and got.m == len(x | y)
    assert got.ac < 0.1 and got.mc == got.c and (got.ae, got.ee, got.text) == (0.0, 1.0, "0" * 16 + "=")


def plain_targets(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = budget - sum(2 * sizes[s] for s in full)
        total = sum(weight[s] for s in order if s not in full)
        goal = {s: 2 * sizes[s] if s in full else weight[s] * rest / total for s in order}
        over = {s for s in order if s not in full and goal[s] > 2 * sizes[s]}
        if not over:
            return goal
        full |= over


def test_mix(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    rows = mixing.mix(docs).join(docs.select("doc_id", "source", "text"), "doc_id").collect()
    sizes, taken = {}, {}
    for r in rows:
        assert r.size == len(words(r.text)) and 0 <= r.taken <= 2 * r.size
        assert len(r.positions) == -(-r.taken // r.size) if r.size else r.taken == 0
        assert all(0 <= p <= 1 for p in r.positions) and list(r.positions) == sorted(r.positions)
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    goal = plain_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)


def test_mix_is_in_order_of_position(spark):
    out = [r.position for r in mixing.mix(spark.read.parquet(f"{BIG}/documents.parquet")).collect()]
    assert out == sorted(out)


def test_schedules(spark):
    for knots in mixing.SHAPES:
        assert abs(mixing.integrate(knots) - 1) < 1e-12
        shares = [k / 20 for k in range(21)]
        times = [r[0] for r in spark.createDataFrame([(s,) for s in shares], "s double").select(mixing.invert(F.col("s"), knots), "s").orderBy("s").collect()]
        for share, time in zip(shares, times, strict=True):
            area, done = 0.0, False
            for (t0, h0), (t1, h1) in itertools.pairwise(knots):
                end = min(time, t1)
                if end > t0 and not done:
                    area += (end - t0) * (h0 + h0 + (h1 - h0) * (end - t0) / (t1 - t0)) / 2
            assert abs(area - share) < 1e-9


def test_mix_of_odd_rows(spark):
    rows = mixing.mix(odd_docs(spark)).collect()
    assert len(rows) == 11 and {r.doc_id: r.taken for r in rows}[1] == 0
    sizes = {"a": 0, "b": 24, "c": 60_001, None: 10, "ß": 4}
    goal = plain_targets(sizes)
    assert {round(r.target, 6) for r in rows} == {round(g, 6) for g in goal.values()}
    assert mixing.mix(odd_docs(spark).limit(0)).count() == 0
    assert [r.target for r in mixing.mix(odd_docs(spark).where("doc_id = 1")).collect()] == [0.0]
    again = mixing.mix(odd_docs(spark).repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def plain_join(rows, share=(75, 100)):
    """Every row is a node; a component's id is the smallest of its rows' ids."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = [0] * len(sets)
    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and share[1] * len(x & y) >= share[0] * len(x | y):
            links[a] += 1
            links[b] += 1
            parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least.setdefault(root(k), []).append(i)
    ids = {k: min((i for i in own if i is not None), default=None) for k, own in least.items()}
    return sorted(((i, len(s), ids[root(k)], links[k]) for k, (i, s) in enumerate(sets)), key=str)


def joined(docs, share=(75, 100)):
    return sorted((tuple(r) for r in jaccard.join(docs, share).select("doc_id", "n_shingles", "component_id", "n_links").collect()), key=str)


def test_join_of_odd_rows(spark):
    docs = odd_docs(spark)
    assert joined(docs) == plain_join([(r.doc_id, r.text) for r in docs.collect()])
    assert jaccard.join(docs.limit(0)).count() == 0
    nothing = docs.where("doc_id <= 3")
    assert joined(nothing) == plain_join([(r.doc_id, r.text) for r in nothing.collect()])


A, B = "one text of some seven words here", "quite another text with no shared run"


def test_join_of_rows_that_share_an_id(spark):
    """Rows are nodes of their own: an id that two unlike texts share ties nothing together."""
    rows = [(3, A), (6, A), (6, B), (9, B), (None, B), (None, "a text of nobody with an id at all"), (8, A + " too"), (5, "b " + B), (6, "x y"), (6, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(docs, (60, 100)) == plain_join(rows, (60, 100))
    assert joined(docs) == plain_join(rows)
    groups = {}
    for r in jaccard.join(docs, tag=F.length("text")).collect():
        groups.setdefault(r.group_id, set()).add((r.tag, r.component_id))
    assert {(len(A), 3), (len(A) + 4, 3)} in groups.values() and {(len(B), 5), (len(B) + 2, 5)} in groups.values()


@pytest.mark.parametrize("copied,common", [(0, 2), (1, 3), (256, 32)])
def test_join_of_common_grams_and_many_copies(spark, monkeypatch, copied, common):
    monkeypatch.setattr(jaccard, "MOST_COPIED", copied)
    monkeypatch.setattr(jaccard, "COMMON", common)
    rng = random.Random(8)
    line = " ".join(f"l{k}" for k in range(12))
    rows = [(k, line + " " + " ".join(f"u{rng.randrange(40)}x{k % 7}" for _ in range(rng.choice((1, 2, 30))))) for k in range(90)]
    rows += [(k, line) for k in range(90, 140)] + [(k, "") for k in range(140, 160)] + [(k, None) for k in range(160, 170)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert joined(docs) == plain_join(rows)


@pytest.mark.parametrize("block,flush,share", [(512, 1 << 21, (75, 100)), (16, 300, (75, 100)), (8, 300, (50, 100)), (8, 300, (100, 100))])
def test_join_of_many_near_copies(spark, monkeypatch, block, flush, share):
    """Chains and groups around the bound, in one task and cut into blocks, equal to all pairs."""
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)
    monkeypatch.setattr(jaccard, "FLUSH_ENTRIES", flush)
    rng = random.Random(4)
    passage = [f"p{k}" for k in range(40)]
    texts = []
    for g in range(6):
        base = [f"g{g}w{k}" for k in range(rng.choice((12, 40, 80)))]
        for _ in range(25):
            t = base[:]
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
                t[rng.randrange(len(t))] = rng.choice(("x", "y", "z"))
            cut = rng.randrange(0, 6)
            texts.append(" ".join(t[cut:] + (passage if rng.random() < 0.2 else [])))
    texts += [" ".join(passage), "same", "same", "Same", ""]
    ids = rng.sample(range(-500, 500), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(5)
    assert joined(docs, share) == plain_join(list(zip(ids, texts, strict=True)), share)


def test_bound_is_sharp(spark):
    """Three of four shingles shared is a link, a little less is none."""
    w = [f"w{k}" for k in range(200)]
    at = " ".join(w[:104]), " ".join(w[:79])  # 100 and 75 shingles
    under = " ".join(w[:78])
    docs = spark.createDataFrame([(1, at[0]), (2, at[1]), (3, under)], "doc_id long, text string")
    assert joined(docs) == [(1, 100, 1, 1), (2, 75, 1, 2), (3, 74, 1, 1)]


def test_components(spark):
    rng = random.Random(9)
    chain = [(k, k + 1) for k in range(0, 60)]
    star = [(100, k) for k in range(101, 160)]
    loose = [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in chain + star + loose]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    loops = {a for a, b in edges if a == b}
    assert all(got.get(i, i) == root(i) for i in parent) and set(parent) - set(got) <= loops
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return m[1].translate(LOWER), m[2]


def test_urls(spark):
    urls = ["http://A.Example.ORG/es/1", "https://www.example.org/en/17?x=1", "http://org/", "http://example.org", "http://x.com/fr/#a", "http://x.com/de/1?q", "http://notorg/es/", "ftp://Example.com", None, "", "no scheme/org/", "://x.org/en/1", "http://x.net/de/5://y", "http://x.org?a/b"]
    pages = spark.createDataFrame([(k, u, "old") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    rows = {r.page_id: r for r in url_rules.judge(pages).collect()}
    for k, u in enumerate(urls):
        host, path = plain_host_path(u)
        fits = [(len(h + p), h + p, v) for v, h, p in url_rules.LISTS if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, default=None)
        assert (rows[k].host, rows[k].path, rows[k].rule) == (host, path, rule and rule[1])
        assert rows[k].verdict in ("allow", "block") and (not rule or rows[k].verdict == rule[2])
    assert url_rules.judge(pages.limit(0)).count() == 0


def test_rules_from_marks_of_documents(spark):
    """Labels of both kinds: URLs that no list judges get what their tokens imply."""
    rng = random.Random(5)
    rows = [(k, f"http://{'shop' if k % 2 else 'news'}{rng.randrange(3)}.net/{'buy' if k % 2 else 'read'}/{k}") for k in range(200)] + [(900, "http://a.net/buy/x"), (901, "http://a.net/read/x"), (902, "http://x.org/buy/1"), (903, None), (904, "http://b.net/" + "buy/" * 5000), (905, "http://b.net/" + "buy/" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(200)] + [(900, None), (7, 0)], "doc_id long, quality int")
    marked = url_rules.labels_of_pages(pages, labels)
    assert {r.verdict for r in marked.collect()} == {"allow", "block"} and marked.count() == 200
    got = {r.page_id: r for r in url_rules.judge(pages, marked).collect()}
    assert (got[900].verdict, got[901].verdict, got[902].verdict, got[904].verdict) == ("block", "allow", "allow", "block")
    assert got[900].mined_rule and got[902].rule == "org/" and got[902].mined_rule is None and got[904].verdict == got[905].verdict
    assert all(got[k].verdict == ("block" if k % 2 else "allow") for k in range(200))


def test_match_by_shuffle_equals_broadcast_and_breaks_ties(spark, monkeypatch):
    rules = spark.createDataFrame([(["a"], "allow", 0.9, 0.1, "a", 1), (["b"], "block", 0.9, 0.1, "b", 2), (["a", "b"], "allow", 0.9, 0.1, "a", 3), (["c"], "block", 1.0, 0.01, "c", 4)], "tokens array<string>, verdict string, confidence double, support double, anchor string, rule_id long")
    urls = spark.createDataFrame([("u1", ["a"]), ("u2", ["a", "b"]), ("u3", ["b", "c"]), ("u4", ["d"]), ("u5", [])], "url string, tokens array<string>")
    want = {"u1": "allow", "u2": "allow", "u3": "block"}
    for most in (50_000, 0):
        monkeypatch.setattr(url_rules, "BROADCAST_RULES", most)
        assert {r.url: r.mined for r in url_rules.match(urls, rules).collect()} == want


def test_rules_equal_all_combinations(spark):
    """Mined rules against counting every combination, and their use against testing every rule."""
    rng = random.Random(6)
    stock = ["a", "b", "c", "d", "e"]
    rows = []
    for _ in range(400):
        t = sorted(rng.sample(stock, rng.randrange(1, 5)))
        bad = ("a" in t and "b" in t) or ("e" in t and rng.random() < 0.9)
        rows.append((t, "block" if bad else "allow"))
    frame = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    rules, common = url_rules.mine(frame, least_rows=20, least_share=0.0, confidence=0.85)
    counts = {}
    for t, v in rows:
        for n in range(1, len(t) + 1):
            for combo in itertools.combinations(t, n):
                counts.setdefault(combo, {}).setdefault(v, 0)
                counts[combo][v] += 1
    full = {(c, v): k / sum(vs.values()) for c, vs in counts.items() for v, k in vs.items() if k >= 20 and k / sum(vs.values()) >= 0.85}
    want = {(c, v): conf for (c, v), conf in full.items() if not any((tuple(x for x in c if x != y), v) in full and full[tuple(x for x in c if x != y), v] >= conf for y in c)}
    got = {(tuple(r.tokens), r.verdict): r.confidence for r in rules.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert common == max(("allow", "block"), key=lambda v: sum(x == v for _, x in rows))
    urls = spark.createDataFrame([("/".join(t), list(t)) for n in range(1, 6) for t in itertools.combinations(stock, n)], "url string, tokens array<string>")
    found = {r.url: r.mined for r in url_rules.match(urls, rules).collect()}
    for r in urls.collect():
        fits = [(conf, v) for (c, v), conf in got.items() if set(c) <= set(r.tokens)]
        assert (r.url in found) == bool(fits)
        if fits:
            assert found[r.url] in {v for conf, v in fits if conf == max(fits)[0]}


def test_pipeline(spark):
    import corpus_pipeline as p
    from unspool.llm.common import table

    docs = table(spark, BIG, "documents")
    kept = docs.cache()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(p.STAGES[:-1]):
        new = stage(spark, kept, BIG).cache()
        rows = new.collect()
        assert new.columns == docs.columns and len({r.doc_id for r in rows}) == len(rows)
        now = {r.doc_id for r in rows}
        assert now <= ids and len(now) >= 0.8 * len(ids), name
        if name == "jaccard":
            want = plain_join([(r.doc_id, r.text) for r in kept.collect()])
            assert now == {i for i, _, least, _ in want if i == least}
        if name == "pii":
            assert now == ids and all(r.n_chars == len(r.text) for r in rows)
        ids, kept = now, new
    assert [name for name, _ in p.STAGES] == ["quality", "jaccard", "decontaminate", "pii", "mix"]
    texts = {r.doc_id: r.text for r in kept.collect()}
    mixed = p.STAGES[-1][1](spark, kept, BIG)
    rows = mixed.collect()
    assert {r.doc_id: r.text for r in rows} == texts and {"lang", "source", "n_chars", "positions"} < set(mixed.columns)
    plain_mix = {r.doc_id: (r.taken, r.positions) for r in mixing.mix(kept).collect()}
    assert {r.doc_id: (r.taken, r.positions) for r in rows} == plain_mix
    assert [r.position for r in rows] == sorted(r.position for r in rows)


def test_pipeline_of_odd_rows(spark):
    import corpus_pipeline as p

    docs = odd_docs(spark).select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame([(None, "x y", "en", None, 3)], "doc_id long, text string, lang string, source string, n_chars long"))
    names = docs.columns
    docs = docs.withColumns({"size": F.lit(7), "taken": F.lit("x"), "n_entities": F.lit(1), "tag": F.lit(2), "group_id": F.lit(3), "kept": F.lit(4)})
    for frame, n in ((docs, 12), (docs.limit(0), 0)):
        for name, stage in p.STAGES:
            out = stage(spark, frame, BIG)
            assert out.count() <= n and set(names) <= set(out.columns), name
    kept = p.keep_one_of_each(spark, docs, BIG).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(i) for i in (1, 2, 3, 4, 6, 7, 9, -4, None))


def test_stage_loses_no_text(spark):
    """Rows that share an id stay or go by their own texts; every kind of text keeps one row."""
    import corpus_pipeline as p

    rows = [(3, A), (6, A), (6, B), (9, B), (None, B), (None, "a text of nobody"), (6, "x y"), (6, "x y"), (6, None), (6, None), (7, ""), (None, None), (None, None), (2, "solo words")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", k) for k, (i, t) in enumerate(rows)], schema)
    kept = [(r.doc_id, r.text) for r in p.keep_one_of_each(spark, docs, BIG).collect()]
    assert sorted(kept, key=str) == sorted([(3, A), (6, B), (None, "a text of nobody"), (6, "x y"), (6, None), (7, ""), (None, None), (2, "solo words")], key=str)


def test_run_returns_texts_and_leaves_few_tables(spark, data_dir):
    import corpus_pipeline as p
    from unspool.llm import common

    before = set(common.written(spark))
    out = p.run(spark, data_dir)
    rows = out.collect()
    assert rows and all(r.taken == 0 or r.text for r in rows) and all(len(r.positions) == -(-r.taken // r.size) for r in rows if r.size)
    assert sum("/stage-" in x for x in set(common.written(spark)) - before) <= 1


def test_copies_are_the_curriculum(spark):
    mixed = mixing.mix(odd_docs(spark), keep=["text", "lang"])
    rows = mixing.copies(mixed).collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    taken = {}
    for r in rows:
        assert 0 < r.words <= r.size == len(words(r.text))
        taken.setdefault((r.doc_id, r.text), []).append(r.words)
    want = {}
    for r in mixed.collect():
        if r.taken:
            want.setdefault((r.doc_id, r.text), []).append(r.taken)
    assert {k: sum(v) for k, v in taken.items()} == {k: sum(v) for k, v in want.items()}


def test_many_sources_are_ranked_in_ranges(spark):
    rng = random.Random(3)
    names = {"".join(rng.choice("aZ\u00e9\u4e00\U0001f600-") for _ in range(rng.randrange(0, 4))) for _ in range(60)}
    sizes = {n: rng.randrange(0, 50) for n in names} | {None: 9}
    goal = plain_targets(sizes)
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    assert {r.source: round(r.target, 6) for r in got} == {n: round(g, 6) for n, g in goal.items()}
